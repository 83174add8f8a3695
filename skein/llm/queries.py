"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, infill, kneser_ney, licenses, mixing, near_dup, pii, quality, secrets, sharding, substring, urls
from .common import table
from .oracle import ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def over(digest: Callable[[DataFrame], DataFrame], name: str = "documents") -> Query:
    """A query that applies an operator to a whole table."""
    return lambda spark, sf_dir: digest(table(spark, sf_dir, name))


def queries() -> dict[str, Query]:
    return {
        "op1_pii": over(pii.digest),
        "op2_url_filter": over(urls.digest, "pages"),
        "op3_decontamination": lambda spark, sf_dir: decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
        "op4_secrets": over(secrets.digest),
        "op5_licenses": over(licenses.digest),
        "op6_quality": over(quality.digest),
        "op7_sharding": over(sharding.digest),
        "op8_near_duplicates": over(near_dup.digest),
        "op9_mixing": over(mixing.digest),
        "op10_substrings": over(substring.digest),
        "op11_divergence": over(divergence.digest),
        "op12_infill": over(infill.digest),
        "op13_kneser_ney": over(kneser_ney.digest),
    }


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
