"""Exports: XML of processed articles, the e-mail form, matrices, scores, tables that replace others."""

from __future__ import annotations

import datetime as dt
import html

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, files_of
from ..operators import similarity


def export_xml(articles: DataFrame, path: str) -> None:
    """All processed articles, also rejected ones, with publish and transcript.  The writer escapes what XML needs, once."""
    articles.write.mode("overwrite").format("xml").option("rowTag", "article").option("rootTag", "articles").save(path)


def append_articles(articles: DataFrame, path: str) -> None:
    articles.write.mode("append").parquet(path)


def replace_table(table: DataFrame, path: str) -> None:
    """Put ``table``, which may be read from ``path``, in its place: written beside it first, then renamed.

    A run that dies between the two renames leaves the table as ``.old``, from
    where :func:`recovered` puts it back; one that dies later leaves an ``.old``
    that is deleted by the next.
    """
    spark = table.sparkSession
    recovered(spark, path)
    table.write.mode("overwrite").parquet(f"{path}.new")
    (here, files), (new, _), (old, _) = files_of(spark, path), files_of(spark, f"{path}.new"), files_of(spark, f"{path}.old")
    files.delete(old, True)
    if files.exists(here) and not files.rename(here, old):
        raise OSError(f"cannot move {path}")
    if not files.rename(new, here):
        raise OSError(f"cannot put {path} in place")
    files.delete(old, True)
    spark.catalog.refreshByPath(path)


def recovered(spark: SparkSession, path: str) -> str:
    """``path``, whose table is put back if a run died while it was replacing it."""
    (here, files), (old, _) = files_of(spark, path), files_of(spark, f"{path}.old")
    if not files.exists(here) and files.exists(old) and not files.rename(old, here):
        raise OSError(f"cannot put {path} back")
    return path


def save_text(spark: SparkSession, path: str, content: str) -> None:
    """One file of a text that the driver holds, on any file system."""
    at, files = files_of(spark, path)
    out = files.create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def ordered_text(path: str, *parts: DataFrame) -> None:
    """A folder of text files whose names sort in the order of the parts and their partitions."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.union(part)
    whole.write.mode("overwrite").text(path)


#: Articles of one e-mail.
MOST_MAILED = 500


def email_form(week: DataFrame, as_of: dt.date) -> tuple[str, str]:
    """(subject, HTML) of the week's articles; refuses more than MOST_MAILED.

    The site's own markup (summary, topics, image) is taken as it is, the rest is escaped.
    """
    rows = week.orderBy(F.desc("pubdate"), "title").limit(MOST_MAILED + 1).collect()
    if len(rows) > MOST_MAILED:
        raise ValueError(f"over {MOST_MAILED} articles for one e-mail")
    text = lambda v: html.escape(str(v or ""))
    day = lambda d: f"{d:%B %d, %Y}" if d else ""
    items = [
        f"<h2><a href=\"{text(r['link'])}\">{text(r['title'])}</a></h2>{r['image'] or ''}<p><a href=\"{text(r['url'])}\">{text(r['source'])}</a>, {day(r['pubdate'])}</p><p>{r['summary'] or ''}</p><p>{r['topics'] or ''}</p>"
        for r in rows
    ]
    return f"AI Alert - {as_of:%B %d, %Y}", f"<html><body>{''.join(items)}<p>Copyright {as_of:%Y}</p></body></html>"


def review_page(subject: str, message: str, action: str, hidden: dict[str, str] | None = None) -> str:
    """A page that shows the e-mail and posts it to the mailing list at ``action`` when the button is pressed."""
    safe = lambda v: html.escape(v, quote=True)
    fields = {**(hidden or {}), "message_subject": subject, "email_format": "HTML"}
    inputs = "".join(f'<input type="hidden" name="{safe(k)}" value="{safe(v)}">' for k, v in fields.items())
    form = f'<form action="{safe(action)}" method="post">{inputs}<textarea hidden name="text_message_body">{safe(message)}</textarea><input type="submit" value="Send"></form>'
    return f"<html><body><h1>{safe(subject)}</h1>{form}<h2>Please review the message below.</h2>{message}</body></html>"


#: Columns of a matrix that are written as one piece of a line.
COLUMNS = 1000


def numbered(names: DataFrame) -> DataFrame:
    """(name, at, ord): the names in the order of ``at``, numbered from 0 without a task for all."""
    ordered = checkpointed(names.distinct().orderBy("at", "name").withColumn("id", F.monotonically_increasing_id()))
    part = F.shiftright("id", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for each partition
    return ordered.withColumn("part", part).join(F.broadcast(starts), "part").select("name", "at", (F.col("start") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))).alias("ord"))


def write_matrix(dissimilarity: DataFrame, names: DataFrame, path: str, corner: str | None = None) -> None:
    """A square matrix as text, in the order of the names: a header of the names, then each name with its row.

    ``names``: (name, at) with the text and the sort key of each; the header has
    one field less than a row, unless ``corner`` is given.  Pairs without a row
    of (i, j, d) have d = 1, a name and itself 0.

    Lines are made in pieces of ``COLUMNS`` columns, which meet the distances of
    their columns only; no table of all names is sent to the lines.  The pieces of
    a line are joined in order, as a line is one row of a text file.
    """
    listed = checkpointed(numbered(names))
    n = listed.count()
    blocks, block = -(-n // COLUMNS), F.floor(F.col("ord") / COLUMNS)
    heads = listed.groupBy(block.alias("b")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "name"))), lambda x: x["name"]), ",").alias("text"))
    comma = F.lit(",") if corner is not None else F.when(F.col("b") > 0, F.lit(",")).otherwise(F.lit(""))
    first = F.when(F.col("b") == 0, F.lit(corner or "")).otherwise(F.lit(""))
    header = heads.select(F.lit(-1).cast("long").alias("line"), "b", F.concat(first, comma, "text").alias("value"))
    one, two = (listed.select(F.col("name").alias(k), F.col("ord").alias(f"o{k}")) for k in "ij")
    cells = dissimilarity.join(one, "i").join(two, "j").select(F.col("oi").alias("line"), F.floor(F.col("oj") / COLUMNS).alias("b"), F.struct((F.col("oj") % COLUMNS).alias("at"), "d").alias("cell"))
    known = cells.groupBy("line", "b").agg(F.map_from_entries(F.collect_list("cell")).alias("ds"))
    pieces = listed.select("name", F.col("ord").alias("line"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b")).join(known, ["line", "b"], "left")
    width = F.least(F.lit(COLUMNS), F.lit(n) - F.col("b") * COLUMNS)
    own = lambda x: F.when(F.col("b") * COLUMNS + x == F.col("line"), 0.0).otherwise(1.0)
    values = F.transform(F.sequence(F.lit(0).cast("long"), width - 1), lambda x: F.coalesce(F.try_element_at("ds", x), own(x)).cast("string"))
    body = pieces.select("line", "b", F.concat(F.when(F.col("b") == 0, F.col("name")).otherwise(F.lit("")), F.lit(","), F.array_join(values, ",")).alias("value"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "value"))), lambda x: x["value"]), "")
    header.union(body).groupBy("line").agg(whole.alias("value")).orderBy("line").select("value").write.mode("overwrite").text(path)


def matrix_csv(dissimilarity: DataFrame, path: str) -> None:
    """A square matrix of (i, j, d); each row begins with its name, the header holds the names only."""
    names = dissimilarity.select(F.col("i").cast("string").alias("name")).distinct().withColumn("at", F.col("name"))
    write_matrix(dissimilarity, names, path)


def all_dissimilarities(vectors: DataFrame) -> DataFrame:
    """(i, j, d) of all ordered pairs of documents that share a term, compared by blocks."""
    norms = vectors.groupBy("urlid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    unit = checkpointed(vectors.join(norms, "urlid").where("norm > 0").select("urlid", "term", (F.col("w") / F.col("norm")).alias("w")))
    pairs = similarity.block_pairs(unit, 0.0, "urlid", None).select("i", "j", similarity.dissimilarity(F.col("sim")).alias("d"))
    return pairs.select(F.inline(F.array(F.struct("i", "j", "d"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "d"))))


def corpus_export(vectors: DataFrame, labels: DataFrame, path: str) -> None:
    """The three kinds of dissimilarity matrices: ``models.csv`` of all centroids, one file for each category with its centroid and documents, ``corpus.csv`` of all documents.

    A document of several categories goes by the last of them in ``corpus.csv``.
    The categories are a short list that a person wrote.
    """
    centres = checkpointed(similarity.centroids(vectors, labels))
    named = lambda df, k: df.select(F.col("category").alias(k), "term", "w")
    matrix_csv(similarity.sparse_dissimilarity(named(centres, "i"), named(centres, "j"), "i", "j"), f"{path}/models.csv")
    last = labels.groupBy("urlid").agg(F.max("category").alias("category"))
    between = checkpointed(all_dissimilarities(vectors))
    to_centre = checkpointed(similarity.sparse_dissimilarity(vectors, centres, "urlid", "category"))
    label = lambda key, cat: F.concat_ws(" ", F.col(key).cast("string"), cat)

    def with_names(pairs: DataFrame, of: DataFrame) -> DataFrame:
        one, two = (of.select(F.col("urlid").alias(k), label("urlid", F.col("category")).alias(f"n{k}")) for k in "ij")
        return pairs.join(one, "i").join(two, "j").select(F.col("ni").alias("i"), F.col("nj").alias("j"), "d")

    there = vectors.select("urlid").distinct()
    names = last.join(there, "urlid", "left_semi")
    listed = names.select(label("urlid", F.col("category")).alias("name"), F.col("urlid").alias("at"))
    write_matrix(with_names(between, names), listed, f"{path}/corpus.csv")
    for row in labels.select("category").distinct().orderBy("category").toLocalIterator():
        own = labels.where(F.col("category") == row["category"]).join(there, "urlid", "left_semi").distinct()
        centre = to_centre.where(F.col("category") == row["category"]).select(label("urlid", F.col("category")).alias("n"), "d")
        edges = centre.select(F.lit(row["category"]).alias("i"), F.col("n").alias("j"), "d").union(centre.select("n", F.lit(row["category"]), "d"))
        spots = own.select(label("urlid", F.col("category")).alias("name"), F.col("urlid").alias("at"))
        head = own.sparkSession.createDataFrame([(row["category"], None)], "name string, at long")
        write_matrix(with_names(between, own).union(edges), head.union(spots), f"{path}/{row['category']}.csv")


def scores_csv(scores: DataFrame, path: str) -> None:
    """model, tid, correct."""
    scores.select("model", "tid", "correct").write.mode("overwrite").csv(path, header=True)
