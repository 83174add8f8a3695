"""What the operators of this package share: words and names, and the library's checkpoints and size checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import broadcast_if_small, checkpointed, release, shared_path

__all__ = ["SEPARATORS", "broadcast_if_small", "checkpointed", "fresh", "let", "n_words", "release", "shared_path", "small_batches", "table", "words"]

#: Separators of words: space and the ASCII controls 0x09 to 0x0D.
SEPARATORS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession, size: str = "8m") -> Iterator[None]:
    """Batches that workers get in this block have about ``size`` bytes at most, so that a worker's arrays stay small."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: Column) -> Column:
    """The words of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once a row.

    The optimizer may copy an expression to each of its mentions, also into the
    lambda of an array function, where it would run for each element.  A lambda
    variable over an array of one is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have yet, made from ``names``."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        name = f"__{name}"
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
