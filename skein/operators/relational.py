"""Keyed table operations: lookups, replacement, marks and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_categories(articles: DataFrame, categories: DataFrame) -> DataFrame:
    """``articles`` with the sorted list of their categories, empty where there is none."""
    lists = categories.groupBy("urlid").agg(F.sort_array(F.collect_list("category")).alias("categories"))
    return articles.join(lists, "urlid", "left").withColumn("categories", F.coalesce("categories", F.array().cast("array<string>")))


def labelled_corpus(corpus: DataFrame, categories: DataFrame) -> DataFrame:
    """(urlid, content, category): the categories of each document, sorted and joined by a space; those without drop out."""
    labels = categories.groupBy("urlid").agg(F.array_join(F.sort_array(F.collect_list("category")), " ").alias("category"))
    return corpus.select("urlid", "content").join(labels, "urlid")


def joined_labels(corpus: DataFrame, categories: DataFrame) -> DataFrame:
    """(urlid, category): the sorted categories of the rows of each document, whatever its text; a row that repeats gives its own again."""
    rows = corpus.select("urlid").join(categories, "urlid")
    return rows.groupBy("urlid").agg(F.array_join(F.sort_array(F.collect_list("category")), " ").alias("category"))


def training_corpus(corpus: DataFrame, categories: DataFrame) -> DataFrame:
    """Labelled documents with a word and without the label NotRelated."""
    rows = labelled_corpus(corpus, categories)
    return rows.where(F.col("content").rlike(r"\w") & ~F.array_contains(F.split("category", " "), "NotRelated"))


def category_counts(categories: DataFrame) -> DataFrame:
    return categories.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def categories_per_document(categories: DataFrame) -> DataFrame:
    return categories.groupBy("urlid").agg(F.count(F.lit(1)).alias("n"))


def insert_if_absent(table: DataFrame, rows: DataFrame, key: str = "url") -> DataFrame:
    """``table`` and those rows whose key it does not have, the first of each key by urlid."""
    first = Window.partitionBy(key).orderBy("urlid")
    new = rows.join(table.select(key), key, "left_anti").withColumn("k_", F.row_number().over(first)).where("k_ = 1").drop("k_")
    return table.unionByName(new.select(*table.columns))


def replace_by_key(table: DataFrame, rows: DataFrame, key: str = "urlid") -> DataFrame:
    """``table`` with all rows of the keys in ``rows`` replaced by these."""
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(rows.select(*table.columns))


def mark(table: DataFrame, keys: DataFrame, flag: str, key: str = "urlid") -> DataFrame:
    """``table`` with the flag set for some keys."""
    hit = keys.select(key).distinct().withColumn("hit_", F.lit(True))
    return table.join(hit, key, "left").withColumn(flag, F.coalesce("hit_", flag)).drop("hit_").select(*table.columns)


def split_at(docs: DataFrame, share: float, predict_share: float = 0.1, key: str = "urlid", seed: str = "") -> DataFrame:
    """(key, part): train for the first share of a shuffled order, then predict for the next tenth.

    The order is the MD5 of seed and key.  Places come from counts of hash
    prefixes and a number within each, so no task sorts all rows.
    """
    marked = docs.select(key, F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))).alias("m")).withColumn("p", F.substring("m", 1, 4))
    sizes = marked.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    everything = Window.orderBy("p")  # over 65,536 prefixes at most
    starts = sizes.select("p", (F.sum("n").over(everything) - F.col("n")).alias("start"), F.sum("n").over(everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
    at = F.col("start") + F.row_number().over(Window.partitionBy("p").orderBy("m", key)) - 1
    placed = marked.join(F.broadcast(starts), "p").withColumn("at", at)
    train = F.floor(F.col("total") * F.lit(share))
    part = F.when(F.col("at") < train, "train").when(F.col("at") < train + F.floor(F.col("total") * F.lit(predict_share)), "predict")
    return placed.select(key, part.alias("part")).where("part is not null")


def between(rows: DataFrame, first: int, last: int, key: str = "urlid") -> DataFrame:
    """The rows whose key is in [first, last]."""
    return rows.where(F.col(key).between(first, last))


def publishable(articles: DataFrame) -> DataFrame:
    """Articles that may be published, are not yet, and have a date."""
    return articles.where(F.col("publishable") & ~F.col("published") & F.col("pubdate").isNotNull())


def latest_first(rows: DataFrame, key: str = "urlid") -> DataFrame:
    """The rows in descending order of the key."""
    return rows.orderBy(F.desc(key))


def spread_subsample(rows: DataFrame, label: str, key: str) -> DataFrame:
    """As many rows of each class as the smallest has, the first by the MD5 of the key.

    Rows are numbered within (class, hash prefix) and the prefixes' counts are
    summed up, so no task sorts a class; prefixes that lie beyond leave before.
    """
    marked = rows.withColumn("m_", F.md5(F.col(key).cast("string"))).withColumn("p_", F.substring("m_", 1, 4))
    sizes = marked.groupBy(F.col(label).alias("l_"), F.col("p_").alias("q_")).agg(F.count(F.lit(1)).alias("n_"))
    least = sizes.groupBy("l_").agg(F.sum("n_").alias("n")).agg(F.min("n").alias("least_"))
    upto = Window.partitionBy("l_").orderBy("q_").rowsBetween(Window.unboundedPreceding, -1)  # 65,536 prefixes at most
    starts = sizes.select("l_", "q_", F.coalesce(F.sum("n_").over(upto), F.lit(0)).alias("start_")).crossJoin(F.broadcast(least)).where("start_ < least_")
    kept = marked.join(starts, F.col(label).eqNullSafe(F.col("l_")) & (F.col("p_") == F.col("q_")))
    at = F.row_number().over(Window.partitionBy("l_", "q_").orderBy("m_", key)) + F.col("start_")
    return kept.withColumn("k_", at).where("k_ <= least_").select(*rows.columns)
