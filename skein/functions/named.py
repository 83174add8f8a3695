"""Functions by name: the plug point for configuration and SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession

from . import text

#: Functions of one text column.
FUNCTIONS: dict[str, Callable[[Column], Column]] = {
    "tokens": text.tokens,
    "stemmed": text.stemmed,
    "escape_html": text.escape_html,
    "unescape_html": text.unescape_html,
    "unescape_backslashes": text.unescape_backslashes,
    "to_ascii": text.to_ascii,
    "truncated": text.truncated,
    "two_sentences": text.two_sentences,
    "ranked_summary": text.ranked_summary,
    "plain_words": text.plain_words,
    "html_title": text.html_title,
    "html_text": text.html_text,
    "html_image": text.html_image,
    "found_date": text.found_date,
}


def named(name: str) -> Callable[[Column], Column]:
    """The function of a name; an unknown one is an error that lists the known."""
    if name not in FUNCTIONS:
        raise KeyError(f"no function {name}; known are {', '.join(sorted(FUNCTIONS))}")
    return FUNCTIONS[name]


def register(spark: SparkSession) -> list[str]:
    """Make the Arrow functions callable from SQL under their names."""
    arrow = {k: f for k, f in FUNCTIONS.items() if hasattr(f, "evalType")}
    for name, f in arrow.items():
        spark.udf.register(name, f)
    return sorted(arrow)
