"""Corpora in three files: sparse counts, a label for each row, a word for each column."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window


def numbered(spark: SparkSession, path: str, base: int) -> DataFrame:
    """(n, value): lines by number.  Places are counted per file split, in file order."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id())
    part = lines.withColumn("part", F.shiftrightunsigned("at", 33)).withColumn("k", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = part.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    starts = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("start"))
    return part.join(F.broadcast(starts), "part").select((F.col("start") + F.col("k") + base).alias("n"), "value")


def read(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """((doc, term, tf), (doc, category)) of path.mat, .mat.rlabel and .mat.clabel.

    Documents count from 0 after the header line of the matrix, words from 1;
    counts are cut to whole numbers.
    """
    rows = numbered(spark, f"{path}.mat", -1).where("n >= 0")
    fields = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    pairs = rows.select(F.col("n").alias("doc"), fields.alias("f")).select("doc", "f", F.explode(F.sequence(F.lit(0), F.floor(F.size("f") / 2).cast("int"))).alias("i"))
    pairs = pairs.where(2 * F.col("i") + 1 < F.size("f")).select("doc", F.get("f", 2 * F.col("i")).cast("long").alias("word"), F.get("f", 2 * F.col("i") + 1).cast("double").cast("long").alias("tf"))
    words = numbered(spark, f"{path}.mat.clabel", 1).select(F.col("n").alias("word"), F.trim("value").alias("term"))
    labels = numbered(spark, f"{path}.mat.rlabel", 0).select(F.col("n").alias("doc"), F.trim("value").alias("category"))
    return pairs.join(words, "word").select("doc", "term", "tf"), labels
