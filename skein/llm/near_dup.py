"""Near-duplicate documents by BagMinHash.

Texts are multisets of five-word shingles (a shorter text is one shingle).  Two
texts are linked if their weighted Jaccard similarity, sum of minima over sum of
maxima of the counts, is 0.8 or more.

BagMinHash (Ertl, 2018): a shingle of count w has a Poisson process of rate w on
each of ``HASHES`` components, built from independent processes for the levels
of the discretised weight.  The levels are grouped into the dyadic blocks (0, 1],
(1, 2], (2, 4], ...; a block is one process of its width's rate, and a point of
it falls on one of its levels, so a point counts for all texts in which the
shingle has at least that count.  The earliest point of each component agrees
between two texts with the probability of their similarity.  Points are made in
order of time for all shingles of many texts at once, until none can be earlier
than a text's latest component.

``BANDS`` bands of ``ROWS`` components are hashed.  A pair of similarity 0.8
shares no band with a probability of (1 - 0.8**4)**20 = 2.6e-5.  Copies of a text
are one node.  Links among the nodes of a bucket are found in three rounds, each
checked on whole multisets:

1. The members of a bucket against its least one.
2. Each bucket that still holds several classes has an origin ``o``: of its
   largest class, the member with the most links so far.  All its members are
   compared with ``o``; what a member has less or more than ``o`` are its
   differences.  Let m and e be their weights and d = 5 m + 4 e; a node is linked
   to ``o`` if and only if d <= |o|.
3. Two nodes whose differences overlap by c share |o| - m1 - m2 + c, so they are
   linked if and only if 9 c >= d1 + d2 - |o|.  Nodes of two classes are not both
   linked to ``o``, so c is 1 at least: only nodes that have a difference in
   common need a check.  They are found by a join on differences, rarest first:
   each node enters it with so many of them that the others could not reach the
   least c any partner asks for.  Differences that the same nodes have are one.

Only pairs that cannot be links or cannot change a class are left out, so the
classes are those of all links between nodes that share a bucket.

Cases: null and empty texts are copies of one another and link to nothing else;
rows that repeat a text are copies, whatever their ids; different texts of one
id, or without an id, are different nodes; ``copy_of`` and ``class_id`` are least
ids, null if there is none; an empty table gives an empty result; a text of any
length is one row; ``one_of_each`` passes the columns through.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import deleted
from ..operators.graphs import components
from .common import broadcast_if_small, checkpointed, fresh, release, shared_path
from .numeric_text import MIX_A, STEP, U, counted, mixed, pieces

SHINGLE = 5
BANDS = 20
ROWS = 4
HASHES = BANDS * ROWS

#: Similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)


def processes(seeds: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, seed, width) of each dyadic block that some level of an element is in."""
    element, seed, width = [np.arange(len(seeds))], [seeds], [np.ones(len(seeds), np.int64)]
    low = 1
    while (more := np.flatnonzero(counts > low)).size:
        element.append(more)
        seed.append(mixed(seeds[more] + np.full(len(more), low, U) * MIX_A))
        width.append(np.full(len(more), low, np.int64))
        low *= 2
    return np.concatenate(element), np.concatenate(seed), np.concatenate(width)


def signatures(docs: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_docs: int, m: int = HASHES) -> np.ndarray:
    """For each document the id of the earliest point of each component; 0 without shingles.

    A block of width 1 is (0, 1]; of width v > 1 or a second one of width 1 it is
    (v, 2 v], whose levels are v + 1 to 2 v.
    """
    element, state, width = processes(mixed(hashes ^ STEP), counts)
    first = np.arange(len(element)) < len(hashes)
    doc, count = docs[element], counts[element]
    earliest, ids = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, U)
    time = np.zeros(len(element))
    while len(doc):
        state = mixed(state + STEP)
        time = time - np.log(((state >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        latest = earliest.reshape(n_docs, m).max(1)
        live = time < latest[doc]
        doc, count, width, first, state, time = doc[live], count[live], width[live], first[live], state[live], time[live]
        draw = mixed(state ^ MIX_A)
        slot = doc * m + (((draw >> U(32)) * U(m)) >> U(32)).astype(np.int64)
        level = width + 1 + (((draw & U(0xFFFFFFFF)) * width.astype(U)) >> U(32)).astype(np.int64)
        counts_for = first | (level <= count)
        s, t, p = slot[counts_for], time[counts_for], state[counts_for]
        np.minimum.at(earliest, s, t)
        won = earliest[s] == t
        ids[s[won]] = p[won]
    return ids.reshape(n_docs, m)


def banded(ids: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each band; the band's number is part of it."""
    out = np.tile(np.arange(1, BANDS + 1, dtype=U) * STEP, (len(ids), 1))
    for r in range(ROWS):
        out = mixed(out * MIX_A + ids[:, r::ROWS])
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_key, bands) of each document; no bands for texts without words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = [], []
            for piece in pieces(batch.column(2)):
                ids = signatures(*counted(*piece.shingles(SHINGLE)), piece.docs)
                some = np.diff(piece.bounds) > 0
                values.append(banded(ids)[some].ravel())
                sizes.append(np.where(some, BANDS, 0))
            if sizes:
                offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32)
                bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bands], names=["doc_id", "copy_key", "bands"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(text).alias("copy_key"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, copy_key string, bands array<long>")


def bags(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count) of the shingles of each text."""
    parts = [(p.first, *counted(*p.shingles(SHINGLE))) for p in pieces(texts)]
    return tuple(np.concatenate(x) for x in ([f + d for f, d, _, _ in parts], [h for _, _, h, _ in parts], [c for *_, c in parts]))


def aligned(texts_a: pa.Array, texts_b: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, count in a, count in b) of the shingles of either text of each pair."""
    (da, ha, ca), (db, hb, cb) = bags(texts_a), bags(texts_b)
    key_a, key_b = mixed(ha + mixed(da.astype(U) * STEP)), mixed(hb + mixed(db.astype(U) * STEP))
    _, ia, ib = np.intersect1d(key_a, key_b, assume_unique=True, return_indices=True)
    in_b, alone = np.zeros(len(da), np.int64), np.ones(len(db), bool)
    in_b[ia], alone[ib] = cb[ib], False
    return np.concatenate([da, db[alone]]), np.concatenate([ha, hb[alone]]), np.concatenate([ca, np.zeros(alone.sum(), np.int64)]), np.concatenate([in_b, cb[alone]])


def similar(texts_a: pa.Array, texts_b: pa.Array) -> np.ndarray:
    """Whether each pair of texts has a weighted Jaccard similarity of LEAST or more."""
    row, _, a, b = aligned(texts_a, texts_b)
    n = len(texts_a)
    shared, either = np.bincount(row, np.minimum(a, b), n), np.bincount(row, np.maximum(a, b), n)
    return (shared * LEAST[1] >= either * LEAST[0]) & (either > 0)


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, text_a, text_b) of (a, b) pairs.  ``texts``: (node, text), a node once."""
    one = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    two = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(two, "b").join(one, "a").select("a", "b", "text_a", "text_b")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (a, b) pairs whose texts are similar."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(similar(batch.column(2), batch.column(3))))

    return with_texts(pairs, texts).mapInArrow(check, "a long, b long")


def differences(spokes: DataFrame, texts: DataFrame) -> DataFrame:
    """(o, node, whole, d, parts) of (a, b) pairs of an origin and a node.

    ``whole`` is the weight of the origin, ``d`` 5 times the weight that the node
    lacks of it and 4 times what it has more; ``parts`` holds each (shingle, weight)
    of these, shingles that it lacks under another hash than those it has more.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, h, a, b = aligned(batch.column(2), batch.column(3))
            n = batch.num_rows
            low, high = LEAST
            whole = np.bincount(row, a, n).astype(np.int64)
            d = np.bincount(row, np.where(a > b, (a - b) * high, (b - a) * low), n).astype(np.int64)
            order = np.argsort(row, kind="stable")
            order = order[a[order] != b[order]]
            offsets = np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32)
            key = np.where(a > b, mixed(h ^ STEP), h)[order]
            parts = pa.StructArray.from_arrays([pa.array(key.view(np.int64)), pa.array(np.abs(a - b)[order])], names=["g", "c"])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole), pa.array(d), pa.ListArray.from_arrays(pa.array(offsets), parts)], names=["o", "node", "whole", "d", "parts"])

    return with_texts(spokes, texts).mapInArrow(compare, "o long, node long, whole long, d long, parts array<struct<g:long,c:long>>")


def labelled(rows: DataFrame, labels: DataFrame, node: str = "node", label: str = "label") -> DataFrame:
    """``rows`` with the class of each node; a node without links is a class of its own."""
    known = broadcast_if_small(labels).select(F.col("node").alias("n_"), F.col("label").alias("l_"))
    return rows.join(known, F.col(node) == F.col("n_"), "left").withColumn(label, F.coalesce("l_", node)).drop("n_", "l_")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further (a, b) links, of which only those between classes are looked at, once for each two."""
    ends = labelled(labelled(links, labels, "a", "x"), labels, "b", "y").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    edges = checkpointed(ends)
    more = components(edges)
    moved = labelled(labels.select("node", F.col("label").alias("was")), more, "was").select("node", "label")
    out = checkpointed(moved.union(more.select("node", "label").join(broadcast_if_small(labels).select("node"), "node", "left_anti")))
    release(edges, more, labels)
    return out


def origins(members: DataFrame, links: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the origin and each other member of the buckets with several classes."""
    # A row for each bucket and class, then for each bucket: its classes' number and the largest.
    sizes = labelled(members, labels).groupBy("h", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = sizes.groupBy("h").agg(F.max(F.struct("k", (-F.col("label")).alias("l"))).alias("m"), F.count(F.lit(1)).alias("classes"))
    largest = largest.where("classes > 1").select("h", (-F.col("m.l")).alias("main"))
    degree = links.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("links"))
    hubs = labels.join(degree, "node", "left").groupBy(F.col("label").alias("main")).agg(F.min(F.struct((-F.coalesce("links", F.lit(0))).alias("k"), "node"))["node"].alias("hub"))
    found = members.join(largest.join(hubs, "main", "left").select("h", F.coalesce("hub", "main").alias("a")), "h")
    return found.where("a <> node").select("a", F.col("node").alias("b")).distinct()


def sharing_differences(diffs: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): nodes of two classes whose differences to one origin may overlap enough for a link.

    diffs: (o, node, whole, d, parts); labels: (node, label) of the linked nodes.
    """
    rows = labelled(labelled(diffs, labels), labels, "o", "main").withColumn("rest", F.col("label") != F.col("main"))
    # Groups with a node outside of the origin's class; any partner's d is at least low, that of one outside at least low_rest.
    lows = checkpointed(rows.groupBy("o").agg(F.min("d").alias("low"), F.min(F.when(F.col("rest"), F.col("d"))).alias("low_rest")).where("low_rest is not null"))
    known = checkpointed(rows.drop("main").join(broadcast_if_small(lows), "o"))
    # Dealt by (o, g) and (o, node), as one origin may have a large share of all rows.
    parts = known.select("o", "node", "rest", F.explode("parts").alias("p")).select("o", "node", "rest", "p.*").repartition("o", "g")
    shared = Window.partitionBy("o", "g")
    posted = parts.select("o", "node", "c", F.count(F.lit(1)).over(shared).alias("n"), F.max("rest").over(shared).alias("wanted"), F.bit_xor(F.xxhash64("node", "c")).over(shared).alias("who"))
    merged = posted.where("n > 1 and wanted").repartition("o", "node").groupBy("o", "node", "n", "who").agg(F.sum("c").alias("c"))
    by_rarity = Window.partitionBy("o", "node").orderBy("n", "who")
    left = F.sum("c").over(by_rarity.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rest_of = merged.select("o", "node", "n", "who", F.sum("c").over(Window.partitionBy("o", "node")).alias("s"), left.alias("left"))
    least_c = lambda partner: F.greatest(F.lit(1), F.ceil((F.col("d") + F.col(partner) - F.col("whole")) / (LEAST[0] + LEAST[1])))
    keyed = rest_of.join(known.drop("parts").repartition("o", "node"), ["o", "node"]).withColumns({"near": F.col("left") >= least_c("low_rest"), "far": F.col("left") >= least_c("low")})
    keyed = checkpointed(keyed.select("o", "n", "who", "node", "label", "rest", "d", "s", "whole", "near", "far").where("near or (rest and far)"))
    release(lows, known)
    x, y = keyed.where("rest and far").alias("x"), keyed.where("near").alias("y")
    same = reduce(and_, [F.col(f"x.{k}") == F.col(f"y.{k}") for k in ("o", "n", "who")])
    reach = (LEAST[0] + LEAST[1]) * F.least("x.s", "y.s") >= F.col("x.d") + F.col("y.d") - F.col("x.whole")
    once = ~F.col("y.rest") | (F.col("x.near") & (F.col("x.node") < F.col("y.node")))
    met = x.join(y, same & (F.col("x.label") != F.col("y.label")) & reach & once)
    return met.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def row_key(copy_key: Column, doc_id: Column) -> Column:
    """A key of a text and an id, also of a null id."""
    return F.concat(copy_key, F.lit(":"), F.coalesce(doc_id.cast("long").cast("string"), F.lit("")))


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Marks of the rows, the different texts as numbered nodes in the order of their least ids, and (node, label) of linked ones."""
    marks = checkpointed(signed(docs))
    heads = marks.groupBy("copy_key").agg(F.min("doc_id").alias("copy_of"), F.first("bands").alias("bands"))
    order = [F.asc_nulls_last("copy_of"), F.col("copy_key")]
    heads = checkpointed(heads.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()))
    entries = heads.select("node", F.explode("bands").alias("h"))
    buckets = entries.groupBy("h").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = checkpointed(entries.join(buckets.select("h", "center"), "h"))
    # Texts of the nodes that share a bucket, each once, for all checks.
    named = heads.join(members.select("node").distinct(), "node").select("node", row_key(F.col("copy_key"), F.col("copy_of")).alias("row_key"))
    text = F.coalesce("text", F.lit(""))
    path = shared_path(docs.sparkSession, "near-dup-texts")
    docs.select(row_key(F.md5(text), F.col("doc_id")).alias("row_key"), text.alias("text")).join(named, "row_key").dropDuplicates(["row_key"]).select("node", "text").write.parquet(path)
    texts = docs.sparkSession.read.schema("node long, text string").parquet(path)

    stars = members.where("node <> center").select(F.col("center").alias("a"), F.col("node").alias("b")).distinct()
    links = checkpointed(verified(stars, texts))
    labels = components(links)
    diffs = checkpointed(differences(origins(members.select("h", "node"), links, labels), texts))
    release(members, links)
    labels = merged(labels, diffs.where("d <= whole").select(F.col("o").alias("a"), F.col("node").alias("b")))
    last = checkpointed(verified(sharing_differences(diffs, labels), texts))
    release(diffs)
    deleted(docs.sparkSession, path)
    labels = merged(labels, last)
    release(last)
    return marks, heads.drop("bands"), labels


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, copy_of, class_id): the least id of the same text, and of its class, for each document."""
    marks, heads, labels = grouped(docs)
    first = heads.select(F.col("node").alias("label"), F.col("copy_of").alias("class_id"), F.lit(True).alias("linked"))
    by_text = heads.join(labels.join(first, "label").drop("label"), "node", "left")
    by_text = by_text.select("copy_key", "copy_of", F.when(F.col("linked"), F.col("class_id")).otherwise(F.col("copy_of")).alias("class_id"))
    return marks.select("doc_id", "copy_key").join(by_text, "copy_key").select("doc_id", "copy_of", "class_id")


def digest(docs: DataFrame) -> DataFrame:
    return classes(docs)


def one_of_each(docs: DataFrame) -> DataFrame:
    """A document of each class, that of the least id, then of the least digest of its text; the columns stay.

    Of rows that repeat id and text, one stays.
    """
    (key,) = fresh(docs, "key")
    _, heads, labels = grouped(docs)
    kept = heads.join(labels.where("label <> node"), "node", "left_anti").select(row_key(F.col("copy_key"), F.col("copy_of")).alias(key))
    keyed = docs.withColumn(key, row_key(F.md5(F.coalesce(F.col("text"), F.lit(""))), F.col("doc_id")))
    return keyed.join(kept, key, "left_semi").dropDuplicates([key]).drop(key)
