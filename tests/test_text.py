import datetime as dt

import pytest
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.porter import stem


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'date' if isinstance(v, dt.date) else 'string'}" for k, v in values.items()) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("word", "want"),
    [
        ("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("feed", "feed"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"),
        ("conflated", "conflat"), ("hopping", "hop"), ("falling", "fall"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"),
        ("revival", "reviv"), ("adoption", "adopt"), ("probate", "probat"), ("rate", "rate"), ("controll", "control"), ("Cats", "Cats"), ("9cats", "9cats"), ("is", "is"),
    ],
)
def test_stem(word, want):
    assert stem(word) == want


def test_tokens_split_on_ascii_before_lowering(spark):
    assert one(spark, T.tokens(F.col("t")), t="The café's A_1, b2!") == ["the", "caf", "s", "a_1", "b2"]
    assert one(spark, T.tokens(F.col("t"), ("the",)), t="The cat the") == ["cat"]
    assert one(spark, T.tokens(F.col("t")), t=None) == []


def test_ngrams(spark):
    assert one(spark, T.ngrams(T.tokens(F.col("t")), 2), t="a b c") == ["a b", "b c"]
    assert one(spark, T.ngrams(T.tokens(F.col("t")), 3), t="a b") == []


@pytest.mark.parametrize(
    ("text", "want"),
    [("short", "short..."), ("One. Two three four", "One..."), ("no period in here at all", "no period in..."), ("x" * 30, "x" * 15 + "...")],
)
def test_truncated(spark, text, want):
    assert one(spark, T.truncated(F.col("t"), 15), t=text) == want


def test_truncated_least_above_most():
    with pytest.raises(ValueError, match="above"):
        T.truncated(F.lit("x"), 5, 6)


def test_cleaned_order(spark):
    text = "  Big News - Café  & more\n , then Share this  it ends ."
    assert one(spark, T.cleaned(F.col("t"), F.col("h")), t=text, h="Big News") == "Cafe &amp; more, thenit ends...."


def test_google_source(spark):
    title, source = T.google_source(F.col("t"), F.col("s"))
    assert one(spark, F.struct(title, source), t="A - B - Paper", s="Google News AI") == ("A - B", "Paper via Google News")
    assert one(spark, F.struct(title, source), t="No dash", s="Google News") == ("No dash", "Google News")


def test_two_sentences(spark):
    assert one(spark, T.two_sentences(F.col("t")), t="(Berlin, 3 May) First one. Second! Third.") == "First one. Second!"


@pytest.mark.parametrize(
    ("text", "day"),
    [("Jan. 5, 2012", dt.date(2012, 1, 5)), ("on 3 March 2011.", dt.date(2011, 3, 3)), ("2012-12-31", dt.date(2012, 12, 31)), ("02/03/2012", dt.date(2012, 2, 3)), ("25/03/2012", dt.date(2012, 3, 25)), ("none", None)],
)
def test_found_date(spark, text, day):
    assert one(spark, T.found_date(F.col("t")), t=text) == day


def test_feed_date(spark):
    day = dt.date(2020, 1, 1)
    assert one(spark, T.feed_date(F.col("t"), F.lit(day)), t="Tue, 05 Jun 2012 10:00:00 +0000") == dt.date(2012, 6, 5)
    assert one(spark, T.feed_date(F.col("t"), F.lit(day)), t="bad") == day


def test_escapes(spark):
    assert one(spark, T.escape_html(F.col("t")), t="a<b & c>") == "a&lt;b &amp; c&gt;"
    assert one(spark, T.unescape_html(F.col("t")), t="&#65;&eacute;") == "Aé"
    assert one(spark, T.unescape_backslashes(F.col("t")), t=r"a\:b\\") == "a:b\\"


def test_has_word_not_at_the_edges(spark):
    assert one(spark, T.has_word(F.col("t"), ["bad"]), t="so BAD!") is True
    assert one(spark, T.has_word(F.col("t"), ["bad"]), t="bad start") is False
