"""Quality rules that clean line by line first, with DataFrame functions only.

Line rules (a line with a word fails if any holds):

* punctuation: over ``SYMBOL_SHARE`` of its words carry one of ``#*$%&|<>`` or
  end in two marks of ``!`` and ``?``;
* navigation: ``NAV_MARKS`` or more separators ``|``, one for ``NAV_WORDS`` words
  or fewer;
* boilerplate: it has a stock phrase of web pages in one of four languages; or, in a text with repeated
  five-word windows, ``DULL_WORDS`` or more words of which at most
  ``DULL_SHARE`` are different.

Lines are looked at only in texts that have a symbol, two marks of ``!`` and
``?`` in a row, a stock phrase or a repeated window somewhere; in others no rule
can hold.

Failing lines are removed.  A document is rejected if it fails the base rules
(fewer than ``LEAST_WORDS`` words, or over ``MOST_REPEATED`` % of them in
repeated five-word windows), or if the lines that are left have fewer than
``LEAST_LEFT`` of its words.

Cases: a null text has no words and is rejected; a text of any length is judged
by its lines, and null ids stay null; blank lines neither fail nor
count; repeated rows are judged alike; an empty table gives an empty result;
further columns pass through :func:`clean` unchanged.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SEPARATORS, fresh, let, words

SYMBOLS = r"[#*$%&|<>]"
MARKS = r"[!?]{2}"
ODD = r"[#*$%&|<>]|[!?]{2}"
ODD_WORD = r"[#*$%&|<>]|[!?]{2}$"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20
SYMBOL_SHARE = 0.3
NAV_MARKS = 3
NAV_WORDS = 4
DULL_WORDS = 10
DULL_SHARE = 0.2
LEAST_LEFT = 0.5

#: Stock phrases of web pages, matched in either case.
BOILERPLATE = [
    "all rights reserved", "cookie policy", "enable javascript", "privacy policy",
    "alle rechte vorbehalten", "cookie-richtlinie", "javascript aktivieren", "datenschutzerklärung",
    "tous droits réservés", "politique de cookies", "activer javascript", "politique de confidentialité",
    "todos los derechos reservados", "política de cookies", "habilite javascript", "política de privacidad",
]


def windows(ws: Column) -> Column:
    """A 64-bit hash of each five-word window, in order."""
    return F.when(
        F.size(ws) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(ws) - WINDOW), lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))


def n_repeat_words(df: DataFrame, hashes: str, out: str) -> DataFrame:
    """``df`` with the number of words in windows that occur twice or more.

    Sorted by (hash, place), repeated windows are neighbours; their places,
    sorted again, cover min(window, gap to the next place) words each.  Texts
    without a repeated window take no sort.
    """
    pairs, places = fresh(df, "pairs", "places")
    h = F.col(hashes)
    repeated = F.size(F.array_distinct(h)) < F.size(h)
    zipped = F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i"))
    df = df.withColumn(pairs, F.when(repeated, F.sort_array(zipped)))
    hash_at = lambda i: F.get(F.col(pairs), i)["h"]
    again = F.filter(pairs, lambda x, i: (x["h"] == hash_at(i + 1)) | ((i > 0) & (x["h"] == hash_at(i - 1))))
    df = df.withColumn(places, F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col(places)
    steps = F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW))))
    total = F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn(out, F.coalesce(total, F.lit(0)).cast("long")).drop(pairs, places)


def has_stock(text: Column) -> Column:
    return let(F.lower(text), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE]))


def line_fails(line: Column, repeats: Column) -> Column:
    """Whether a line with a word fails a rule.  ``repeats``: its text has repeated windows."""
    marks = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit("")))

    def by_words(ws: Column) -> Column:
        odd = F.when(line.rlike(ODD), F.size(F.filter(ws, lambda w: w.rlike(ODD_WORD)))).otherwise(0)
        dull = repeats & (F.size(ws) >= DULL_WORDS) & (F.size(F.array_distinct(ws)) <= F.size(ws) * DULL_SHARE)
        return (odd > F.size(ws) * SYMBOL_SHARE) | ((marks >= NAV_MARKS) & (marks * NAV_WORDS >= F.size(ws))) | dull

    return let(F.array_remove(F.split(line, SEPARATORS, -1), ""), by_words) | has_stock(line)


def suspect(text: Column, n_symbols: Column, repeats: Column) -> Column:
    """Whether some line of the text can fail."""
    return (n_symbols > 0) | repeats | text.rlike(MARKS) | has_stock(text)


def judged(docs: DataFrame, prefix: str = "") -> DataFrame:
    """``docs`` with the counts, base_failed, kept_words and kept, each name after ``prefix``."""
    ws, hashes, lines, good = fresh(docs, "ws", "hashes", "lines", "good")
    text = F.coalesce(F.col("text"), F.lit(""))
    n = lambda name: prefix + name
    df = docs.withColumn(ws, words(text))
    df = df.withColumn(n("n_words"), F.size(ws).cast("long"))
    df = df.withColumn(n("word_chars"), F.length(F.array_join(ws, "")).cast("long"))
    df = df.withColumn(n("n_symbols"), (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"))
    df = df.withColumn(lines, F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn(n("n_dup_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"))
    df = df.withColumn(hashes, let(F.col(ws), windows))
    df = n_repeat_words(df, hashes, n("n_repeat_words"))
    total, repeated = F.col(n("n_words")), F.col(n("n_repeat_words"))
    df = df.withColumn(n("base_failed"), (total < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * total))
    look = suspect(text, F.col(n("n_symbols")), repeated > 0)
    df = df.withColumn(good, F.when(look, F.filter(lines, lambda x: ~line_fails(x, repeated > 0))).otherwise(F.col(lines)))
    left = F.when(F.size(good) == F.size(lines), total).otherwise(F.size(words(F.array_join(good, "\n"))).cast("long"))
    df = df.withColumn(n("kept_words"), left)
    df = df.withColumn(n("kept"), ~F.col(n("base_failed")) & (F.col(n("kept_words")) >= LEAST_LEFT * total))
    return df.drop(ws, hashes, lines, good)


def digest(docs: DataFrame) -> DataFrame:
    out = judged(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "kept_words")


def clean(docs: DataFrame) -> DataFrame:
    """The documents that are kept, without their failing lines; the columns stay.

    Rejected rows leave through an empty ``explode``: the optimizer would copy
    the rules into a filter once for each mention.
    """
    mark, left = fresh(docs, "q", "left")
    df = judged(docs, mark)
    text, repeats = F.col("text"), F.col(f"{mark}n_repeat_words") > 0
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~line_fails(x, repeats) | ~x.rlike(r"[^\x20\x09-\x0D]"))
    cleaned = F.when(F.col(f"{mark}kept_words") == F.col(f"{mark}n_words"), text).otherwise(F.array_join(lines, "\n"))
    df = df.withColumn(left, F.explode(F.when(F.col(f"{mark}kept"), F.array(cleaned))))
    return df.select(*[F.col(left).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
