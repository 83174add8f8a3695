"""The schemas of the article model.  Nothing is inferred from data."""

from pyspark.sql.types import ArrayType, BooleanType, DateType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

S, L, I, B, D = StringType(), LongType(), IntegerType(), BooleanType(), DateType()  # noqa: E741


def struct(**fields) -> StructType:
    return StructType([StructField(name, kind) for name, kind in fields.items()])


DUPLICATE = struct(urlid=L, title=S, similarity=DoubleType())

ARTICLE = struct(
    urlid=L, url=S, title=S, content=S, summary=S, pubdate=D, crawldate=D, processed=B, published=B, source=S,
    source_relevance=I, source_id=S, categories=ArrayType(S), duplicates=ArrayType(DUPLICATE), tfpn=S, image_url=S,
    publish=B, transcript=ArrayType(S), image_path=S,
)
CATEGORY = struct(urlid=L, category=S)
CORPUS_DOCUMENT = struct(urlid=L, url=S, title=S, content=S, adminrate=I)
VOCABULARY = struct(rowid=L, word=S, dftext=L)
SOURCE = struct(source_id=S, title=S, link=S, parser=S, relevance=I)
GOLD = struct(ids=ArrayType(L), label=S)
EXPERIMENT = struct(model=S, tid=I, correct=DoubleType())
