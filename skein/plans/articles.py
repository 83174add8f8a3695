"""The article tables as views of the generic tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sources whose articles are published already, and those not yet processed.
PUBLISHED = ["src0", "src1", "src2", "src3"]
PENDING = ["src18", "src19"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles.  The date is n_chars modulo 30 days into January 2024."""
    source = F.col("source")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("urlid"), F.concat(F.lit("https://"), source, F.lit(".example.org/"), F.col("lang"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.substring_index("text", ".", 1).alias("title"), F.col("text").alias("content"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n_chars") % 30).cast("int")).alias("pubdate"),
        (~source.isin(*PENDING)).alias("processed"), source.isin(*PUBLISHED).alias("published"), source, F.substring(source, 4, 9).cast("int").alias("source_relevance"), F.col("lang").alias("category"),
    )


def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(urlid, category): labels as two possible categories."""
    labels = table(spark, sf_dir, "labels")
    both = F.array_compact(F.array(F.when(F.col("quality") == 1, F.lit("good")), F.when(F.col("toxic") == 1, F.lit("toxic"))))
    return labels.select(F.col("doc_id").alias("urlid"), F.explode(both).alias("category"))
