"""Benchmark passages in documents by SimHash, with DataFrame functions only.

Words are lower-cased runs of letters and digits; shingles are five words (all
words of a shorter item).  A document is contaminated by an item if a window of
the item's number of words has a weighted Jaccard similarity (counts as weights)
of 0.8 or more to it.

1. Anchors: a similarity of 0.8 to an item of n shingles takes an overlap of 8 n / 9,
   so at least so many places of the window have shingles of items of that size.
   Of all windows with so many, at every start, those are laid that share more
   than their neighbours: a window whose last place is no such one shares no more
   than the window before it, and one whose first place is none no more than the
   next if that gains one.  Nothing is lost, as chains of such neighbours end at a
   window that is laid.  A text that is shorter than the item is one window.
2. SimHash: 64 bits from the window's shingles; bit b is set if over half of
   them, with multiplicity, have it.
3. Multi-index blocks: fingerprints are cut into ``RADIUS`` + 1 blocks.  Two
   within the radius agree on a block, so joining windows and items of one size
   on (block, value) finds all of them.  At similarity 0.8 about 9.7 bits differ
   (standard deviation 2.9); the radius is four deviations beyond.
4. The weighted similarity of each candidate is computed in full.

Items' shingles are a literal set, or broadcast, only if they are counted to be
few; else narrow rows are shuffled.  Cases: null, empty and short texts and items without words
match nothing; repeated items give a row each id; rows of one id, or without an
id, are one document in ``matches``, whatever their texts; ``clean`` judges each
text for itself and passes columns through; of equal windows the first counts; a
text of any length is looked through from end to end; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, fresh, let

SHINGLE = 5
LEAST = (4, 5)
RADIUS = 22
BLOCKS = RADIUS + 1
#: Up to so many different item shingles are looked up in a literal set, more by a join.
SCALAR_SHINGLES = 20_000
CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", -1), "")


def shingles(ws: Column, k: int) -> Column:
    """Hashes of all windows of k words, in order."""
    windows = F.transform(F.sequence(F.lit(0), F.size(ws) - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return F.when(F.size(ws) >= k, windows).otherwise(F.array().cast("array<bigint>"))


def simhash(window: Column) -> Column:
    """Bit b is set if over half of the hashes have it.  Two 32-bit counters share a long."""
    shifted = lambda x, b: F.call_function("shiftrightunsigned", x, b)
    pair = F.lit((1 << 32) | 1)
    counters = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda b: F.aggregate(window, F.lit(0).cast("long"), lambda a, x: a + shifted(x, b).bitwiseAND(pair)))
    most = lambda c: F.when(2 * c > F.size(window), F.lit(1)).otherwise(F.lit(0)).cast("long")
    bits = F.transform(
        counters,
        lambda c, b: F.call_function("shiftleft", most(c.bitwiseAND(F.lit(0xFFFFFFFF))), b).bitwiseOR(F.call_function("shiftleft", most(shifted(c, F.lit(32))), b + 32)),
    )
    return F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))


def block(fingerprint: Column, i: int) -> Column:
    return F.shiftrightunsigned(fingerprint, CUTS[i]).bitwiseAND(F.lit((1 << (CUTS[i + 1] - CUTS[i])) - 1))


def blocks(fingerprint: Column) -> Column:
    return F.array(*[block(fingerprint, i) for i in range(BLOCKS)])


def overlap(a: Column, b: Column) -> Column:
    """Sum over shingles of the lesser count."""
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    return F.aggregate(F.array_distinct(F.array_intersect(a, b)), F.lit(0), lambda s, x: s + F.least(count(a, x), count(b, x)))


def places_by_array(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, h, n, places) of shared shingles, without a row for each shingle and without a shuffle.

    The items' shingles, SCALAR_SHINGLES at most, are a literal set, which is
    built once and not for each row.  Texts that share none stop there; the
    others meet the shingles of each size.
    """
    listed = ",".join(f"{r['g']}L" for r in grams.select("g").distinct().collect()).replace("-9223372036854775808L", "bigint('-9223372036854775808')")
    shared = F.expr(f"filter(h, x -> x in ({listed}))") if listed else F.array().cast("array<bigint>")
    known = docs.select("doc_id", "h", shared.alias("shared")).where(F.size("shared") > 0)
    sizes = grams.groupBy("n").agg(F.collect_set("g").alias("gs"))
    pairs = known.join(F.broadcast(sizes), F.arrays_overlap("shared", "gs"))
    h = F.col("h")
    of_size = let(F.array_intersect("shared", "gs"), lambda gs: F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.array_contains(gs, F.get(h, i))))
    return pairs.select("doc_id", "h", "n", of_size.alias("places"))


def places_by_join(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """The same for many shingles: narrow rows are joined, then the texts with enough of them are."""
    keyed = docs.withColumn("key", F.xxhash64("h"))
    narrow = keyed.select("doc_id", "key", F.size("h").alias("size"), F.posexplode_outer("h").alias("p", "g")).join(grams, "g")
    found = narrow.groupBy("doc_id", "key", "n", "size").agg(F.sort_array(F.collect_set("p")).alias("places")).where(F.size("places") >= least_shared("size", "n"))
    found = found.withColumnsRenamed({"doc_id": "doc_", "key": "key_"}).drop("size")
    return found.join(keyed, F.col("doc_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("key"))).select("doc_id", "h", "n", "places")


def least_shared(size: str, n: str) -> Column:
    """The least overlap of an item of n shingles and a window of the text for a similarity of LEAST."""
    low, high = LEAST
    return F.ceil((F.least(F.col(size), F.col(n)) + F.col(n)) * low / (low + high)).cast("int")


def windows(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(doc_id, n, start, window) of all windows that may be similar.  docs: (doc_id, h); grams: (g, n).

    A start belongs to the first place at or after it; its window is long enough
    for the ``need``-th place from there, or it is left out.
    """
    known = grams.agg(F.count_distinct("g")).first()[0]
    at = (places_by_array if known <= SCALAR_SHINGLES else places_by_join)(docs, grams).withColumn("size", F.size("h"))
    at = at.withColumn("need", least_shared("size", "n"))
    n, last = F.col("n"), F.greatest(F.lit(0), F.col("size") - F.col("n"))

    def starts(places: Column, p: Column, j: Column) -> Column:
        within = F.slice(places, j + 1, n + 1)
        best = lambda s: ((s == 0) | F.array_contains(within, s + n - 1)) & ((s == p) | (s == last) | ~F.array_contains(within, s + n))
        low = F.greatest(F.lit(0), F.coalesce(F.get(places, j - 1) + 1, F.lit(0)), F.get(places, j + F.col("need") - 1) - n + 1)
        high = F.least(p, last)
        return F.when((j + F.col("need") <= F.size(places)) & (low <= high), F.filter(F.sequence(low, high), best)).otherwise(F.array().cast("array<int>"))

    # The places are bound once, and rows without a window leave after the explode: a filter on
    # an expression is pushed down with a copy of it, which would run in each turn of a lambda.
    laid = let(F.col("places"), lambda ps: F.flatten(F.transform(ps, lambda p, j: starts(ps, p, j))))
    cut = lambda ss: F.transform(ss, lambda s: F.struct(s.alias("start"), F.slice("h", s + 1, F.col("n")).alias("window")))
    return at.select("doc_id", "n", F.explode_outer(let(laid, cut)).alias("x")).where("x is not null").select("doc_id", "n", "x.*")


def found_with(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Matches of the items whose shingles have k words.  docs: (doc_id, ws); items: (item_id, ws)."""
    sized = items.select("item_id", shingles(F.col("ws"), k).alias("h")).withColumn("n", F.size("h"))
    sized = checkpointed(sized.withColumn("fp", simhash(F.col("h"))))
    grams = sized.select("n", F.explode("h").alias("g")).distinct()
    laid = windows(docs.select("doc_id", let(F.col("ws"), lambda ws: shingles(ws, k)).alias("h")), grams)
    keyed = laid.withColumn("fp", let(F.col("window"), simhash)).select("*", F.posexplode_outer(let(F.col("fp"), blocks)).alias("block", "value"))
    index = sized.select("item_id", F.col("n"), F.col("fp").alias("item_fp"), F.posexplode(blocks(F.col("fp"))).alias("block", "value"))
    differ = F.col("fp").bitwiseXOR(F.col("item_fp"))
    near = keyed.join(broadcast_if_small(index), ["n", "block", "value"]).where(F.bit_count(differ) <= RADIUS)
    # A pair that agrees on several blocks is kept at the first.
    near = near.where(let(differ, lambda x: F.array_position(blocks(x), F.lit(0).cast("long"))) == F.col("block") + 1)
    full = near.join(broadcast_if_small(sized.select("item_id", F.col("h").alias("item_h"))), "item_id")
    full = full.withColumn("both", overlap(F.col("window"), F.col("item_h"))).withColumn("all", F.size("window") + F.size("item_h") - F.col("both"))
    return full.where(F.col("both") * LEAST[1] >= F.col("all") * LEAST[0]).select("doc_id", "item_id", "start", (F.col("both") / F.col("all")).alias("similarity"))


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity, start): the best window, the first of equals, of each contaminated document and item."""
    items = benchmark.select("item_id", normal_words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    sizes = items.select(F.least(F.size("ws"), F.lit(SHINGLE)).alias("k")).distinct().collect()  # SHINGLE rows at most
    worded = docs.select("doc_id", normal_words(F.col("text")).alias("ws"))
    out = docs.sparkSession.createDataFrame([], docs.select("doc_id").schema).select("doc_id", F.lit(0).cast(items.schema["item_id"].dataType).alias("item_id"), F.lit(0).alias("start"), F.lit(0.0).alias("similarity"))
    for k in sorted(r["k"] for r in sizes):
        out = out.union(found_with(worded, items.where(F.least(F.size("ws"), F.lit(SHINGLE)) == k), k))
    best = out.groupBy("doc_id", "item_id").agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("m"))
    return best.select("doc_id", "item_id", F.round("m.similarity", 6).alias("similarity"), (-F.col("m.s")).cast("long").alias("start"))


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return matches(docs, benchmark)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a match; columns and rows stay as they are."""
    key, bad = fresh(docs, "key", "bad")
    digest_of = F.md5(F.coalesce(F.col("text"), F.lit("")))
    found = checkpointed(matches(docs.select(digest_of.alias("doc_id"), "text"), benchmark).select(F.col("doc_id").alias(bad)).distinct())
    return docs.withColumn(key, digest_of).join(broadcast_if_small(found), F.col(key) == F.col(bad), "left_anti").drop(key)
