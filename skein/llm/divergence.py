"""How the sources of a language differ in their use of terms.

A term's smoothed share in a group of documents is ``p = 1 + floor(SCALE * (count
+ ADDED) / (N + ADDED * V))``, in whole numbers: ``V`` terms are kept in the
language, those in ``LEAST_DOCUMENTS`` of its documents or more, and ``N`` is
the sum of their counts in the group.  Two sources are as far apart as the sum
of ``|p - q|`` over all kept terms, and a source's own terms are those whose
share there is furthest above the language's.

Most terms are rare and have one of few vectors of counts over the sources.  So
terms of one language with the same sparse vector are one row with their number,
each pair of sources is evaluated once for each different vector, and the result
counts that many times.  Pairs are evaluated for ``CHUNK`` vectors at once, in
tiles of ``TILE`` by ``TILE`` sources: a vector goes to the tiles in which it has
a count, and what it adds there is ``|p - q| - |p0 - q0|``, where ``p0`` and
``q0`` are the shares of an absent term; the absent terms' part is ``V * |p0 -
q0|`` for all.  No task gets more than a chunk in a tile, however large a source
or a language is.  Only the ranks of a source's own terms go back to the
original terms.

Cases: a null text, language or source is read as ''; an empty text has no terms
but its group counts; without kept terms all distances are 0 and there are no
term rows; a language of one source has no pairs; equal values are ranked by name; repeated rows count as often as
they are there; texts of any length count whole; further columns are not read;
an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, small_batches
from .numeric_text import LOWER, STEP, U, gathered, mixed, pieces

# Fixed values of the contract.
LEAST_DOCUMENTS = 30
ADDED = 5
SCALE = 1_000_000_000
RANKS = 50

#: Different vectors that are evaluated at once.
CHUNK = 512

#: Sources along each side of a tile.
TILE = 256

#: Byte values that are in terms: the letters A to Z in either case, and all of characters beyond ASCII.
IN_TERMS = np.zeros(256, bool)
IN_TERMS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def share(count: Column, total: Column, kept: Column) -> Column:
    """p of a count in a group of ``total`` counted and ``kept`` different terms; whole numbers of any size."""
    wide = lambda c: c.cast("decimal(28,0)")
    above, below = wide(count + ADDED) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + kept * ADDED)
    # Without kept terms nothing is shared out, and no share is asked for.
    return F.lit(1) + F.call_function("div", above, F.when(below > 0, below)).cast("long")


def read(docs: DataFrame, lang: str, source: str, text: str) -> DataFrame:
    given = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    return docs.select(given(lang).alias("lang"), given(source).alias("source"), given(text).alias("text"))


def summed(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(an order in which equal keys are neighbours, where each different one begins in it, how often it is there)."""
    order = np.argsort(keys)
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[order][1:] != keys[order][:-1]]))
    return order, new, np.diff(np.append(new, len(keys)))


def batch_counts(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, n, documents) of a batch of (lang, source, text): uses of the term, and documents that have it.

    Terms are told apart by 64-bit hashes within the batch, and written out once for each group.
    """
    lang, source = (batch.column(k).dictionary_encode() for k in (0, 1))
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    found, base = [], 0
    for piece in pieces(batch.column(2), LOWER, IN_TERMS):
        doc = np.repeat(np.arange(piece.docs), np.diff(piece.bounds))
        order, new, n = summed(mixed(piece.hashes + mixed(doc.astype(U) * STEP)))
        at = order[new]
        found.append((group[piece.first + doc[at]], piece.hashes[at], n, base + piece.starts[at], piece.ends[at] - piece.starts[at], piece.data))
        base += len(piece.data)
    if not found:
        return pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())], COUNTED)
    of, h, n, starts, sizes, data = (np.concatenate(x) for x in zip(*found, strict=True))
    order, new, documents = summed(mixed(h + mixed(of.astype(U) * STEP)))
    at = order[new]
    uses = np.add.reduceat(n[order], new) if len(new) else n
    offsets = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes[at])])
    term = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(gathered(data, starts[at], sizes[at]))).cast(pa.string())
    names = [column.dictionary.take(pa.array(code)).cast(pa.string()) for column, code in ((lang, of[at] // len(source.dictionary)), (source, of[at] % len(source.dictionary)))]
    return pa.RecordBatch.from_arrays([*names, term, pa.array(uses), pa.array(documents)], COUNTED)


COUNTED = ["lang", "source", "term", "n", "documents"]


def vectors(rows: DataFrame, least: int) -> DataFrame:
    """(lang, term, total, counts) of the kept terms; counts: (source, n) of the sources that have it, in order.

    Each batch of texts is counted as a whole, so that a group's term is one row of it.
    """
    parts = rows.mapInArrow(lambda batches: map(batch_counts, batches), "lang string, source string, term string, n long, documents long")
    counts = parts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    by_term = counts.groupBy("lang", "term").agg(F.sum("documents").alias("documents"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("counts"))
    return by_term.where(F.col("documents") >= least).select("lang", "term", "total", F.array_sort("counts").alias("counts"))


def groups(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, place, total, kept, lang_total) of all groups: place numbers a language's sources, and the rest is 0 without kept terms."""
    own = kept.select("lang", F.inline("counts")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    # A row for each source of a language.
    place = (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("place")
    there = rows.select("lang", "source").distinct()
    return there.join(own, ["lang", "source"], "left").join(broadcast_if_small(whole), "lang", "left").select("lang", "source", place, zero("total"), zero("kept"), zero("lang_total"))


def term_excess(kept: DataFrame, known: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, item, value, rank): the terms that a source uses most above its language, at most ``ranks``."""
    used = kept.select("lang", "term", F.col("total").alias("everywhere"), F.inline("counts"))
    shared = used.join(broadcast_if_small(known), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("kept")), share(F.col("everywhere"), F.col("lang_total"), F.col("kept"))
    above = shared.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)


def chunk_sums(part: pd.DataFrame) -> pd.DataFrame:
    """What a chunk of vectors adds to the distance of each pair of sources of a tile.

    part: a row for each count of a vector, (vector, times, place, p), and rows of
    vector -1 with the shares of an absent term for all sources of the tile.
    """
    lang, a, b = part["lang"].iloc[0], part["a"].iloc[0], part["b"].iloc[0]
    absent = part["vector"].to_numpy() < 0
    place, p = part["place"].to_numpy(), part["p"].to_numpy()
    ids, row = np.unique(part["vector"].to_numpy()[~absent], return_inverse=True)
    times = np.zeros(len(ids), np.int64)
    times[row] = part["times"].to_numpy()[~absent]

    def side(tile: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sources of a tile, their shares of an absent term, and all shares of the chunk."""
        mine = place // TILE == tile
        at = np.sort(place[mine & absent])
        none = np.zeros(TILE, np.int64)
        none[place[mine & absent] - tile * TILE] = p[mine & absent]
        none = none[at - tile * TILE]
        grid = np.repeat(none[None, :], len(ids), axis=0)
        use = mine[~absent]
        grid[row[use], np.searchsorted(at, place[~absent][use])] = p[~absent][use]
        return at, none, grid

    left, none_left, grid_left = side(a)
    right, none_right, grid_right = side(b)
    sums = np.stack([times @ (np.abs(grid_left[:, [k]] - grid_right) - np.abs(none_left[k] - none_right)[None, :]) for k in range(len(left))])
    one, two = np.nonzero(left[:, None] < right[None, :])
    return pd.DataFrame({"lang": lang, "i": left[one], "j": right[two], "value": sums[one, two]})


def pair_distances(kept: DataFrame, known: DataFrame) -> DataFrame:
    """(lang, source, item, value) of all ordered pairs of sources of a language."""
    alike = kept.groupBy("lang", "counts").agg(F.count(F.lit(1)).alias("times"))
    each = checkpointed(alike.withColumn("vector", F.monotonically_increasing_id()))
    chunks = each.groupBy("lang").agg((F.floor(F.count(F.lit(1)) / CHUNK) + 1).alias("chunks"))
    sizes = known.groupBy("lang").agg((F.floor(F.max("place") / TILE) + 1).alias("tiles")).join(chunks, "lang")
    dealt = broadcast_if_small(known.join(sizes, "lang"))
    cells = each.select("lang", "vector", "times", F.inline("counts")).join(dealt, ["lang", "source"])
    p = share(F.col("n"), F.col("total"), F.col("kept"))
    columns = ["lang", "chunk", "vector", "times", "place", "p", "tiles"]
    seen = cells.select("lang", F.pmod(F.xxhash64("vector"), "chunks").alias("chunk"), "vector", "times", "place", p.alias("p"), "tiles")
    none = dealt.select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.lit(-1).cast("long").alias("vector"), F.lit(0).cast("long").alias("times"), "place", share(F.lit(0), F.col("total"), F.col("kept")).alias("p"), "tiles")
    own = F.floor(F.col("place") / TILE).cast("int")
    rows = seen.union(none.select(*columns)).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))))
    tiled = rows.select("lang", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "chunk", "vector", "times", "place", "p")
    sums = tiled.groupBy("lang", "a", "b", "chunk").applyInPandas(lambda part: chunk_sums(part), "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("sum"))
    side = lambda k, n: known.select("lang", F.col("place").alias(k), F.col("source").alias(f"{k}_name"), F.when(F.col("kept") > 0, share(F.lit(0), F.col("total"), F.col("kept"))).alias(f"{k}_none"), *n)
    # A row for each pair of sources of a language, as the result has.
    pairs = side("i", ["kept"]).join(side("j", []), "lang").where("i < j").join(sums, ["lang", "i", "j"], "left")
    value = F.coalesce("sum", F.lit(0)) + F.col("kept") * F.coalesce(F.abs(F.col("i_none") - F.col("j_none")), F.lit(0))
    both = F.array(F.struct(F.col("i_name").alias("source"), F.col("j_name").alias("item")), F.struct(F.col("j_name").alias("source"), F.col("i_name").alias("item")))
    return pairs.select("lang", F.inline(both), value.alias("value"))


def audit(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCUMENTS, ranks: int = RANKS) -> tuple[DataFrame, DataFrame]:
    """(distances of pairs of sources, terms above their language), each ranked within its group."""
    rows = read(docs, lang, source, text)
    with small_batches(docs.sparkSession):
        kept = checkpointed(vectors(rows, least))
    known = checkpointed(groups(rows, kept))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pair_distances(kept, known).withColumn("rank", F.row_number().over(order))
    return pairs, term_excess(kept, known, ranks)


def digest(docs: DataFrame) -> DataFrame:
    pairs, own = audit(docs)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").union(columns(own, "term"))
