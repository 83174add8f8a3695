"""Incremental removal of repeated passages with a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words of a document.  Each word in a window
whose word sequence also starts earlier (smaller id, or same document and
earlier start) is removed.

Fingerprints.  Of each window the least hash of its ``GRAM``-word grams is
selected (winnowing: Schleimer, Wilkerson, Aiken, 2003).  Equal windows select
equal grams at equal places, so windows that are repeated have repeated
fingerprints: none is missed, and about one word in eight is indexed.

Index.  A batch's fingerprints are counted and written as a run: a table of
distinct fingerprints with their first place, hash-bucketed and sorted, never
changed.  Runs have one bucketing, so they are merge-joined without a shuffle,
with one another and with a new batch's; ``compact`` merges them into one.
Fingerprints that occur twice or more over the runs are candidates.  An index
that is kept also holds, as runs of the same form, the first place of each
different passage of the candidates seen so far.  What it holds is written down
with each batch that is done, so another session goes on with :meth:`FingerprintIndex.reopened`;
runs of a batch that was not done are dropped then, and the batch can be judged again.

Verification.  Only windows whose fingerprint is a candidate are hashed in full,
with word hashes that are independent of the fingerprint's, so windows count as
equal if 128 bits agree.  The windows of a document that select one gram travel
as one array.  Of equal arrays the first is kept: each window of the others also
starts earlier, by definition, so these need no more than that.  The windows of
different first arrays are opened and compared, those of a fingerprint within a
task, or, if it has ``HOT`` occurrences or more, by a pre-aggregated join.

New batches.  ``deduplicated(batch, index, past)`` judges the batch against all
that the index has seen: the new run meets the old ones in a merge join, the old
places of candidates are looked up, and only the past documents that hold them
are read again.  The result over several batches is that of one table, if the
batches come in the order of their ids.

Copies of a whole text in a batch are found first and not expanded: a later copy
of 20 words or more loses them all.

Cases: null and short texts keep their words; documents are ordered by id, null
last, and those of one id, or without, by the digest of their texts; rows that
repeat an id with its text are one document; a text of any length is one row; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..checkpoints import deleted, files_of
from .common import broadcast_if_small, checkpointed, shared_path
from .numeric_text import WORDS_BASE, Piece, U, mixed, pieces, spans_hashed

WINDOW = 20
GRAM = 6
SPREAD = WINDOW - GRAM + 1

#: Occurrences from which a fingerprint is hot; this changes the plan, not the result.
HOT = 1000

#: Batches that the query feeds to the index, by id, and runs an index keeps before it compacts.
BATCHES = 2
MOST_RUNS = 4

#: The order of a null id, after all others.
LAST = (1 << 63) - 1
NO_ID = "~"  # sorts after digests

KEY = ["doc", "tie"]

#: Where a run of windows begins, in the order of all, and the place of its gram.
START = ["batch", "doc", "tie", "place", "gram"]


def selected(piece: Piece) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of all windows, of the gram that each selects (the leftmost least), and the grams' hashes by place."""
    n = len(piece.hashes)
    ends = np.repeat(piece.bounds[1:], np.diff(piece.bounds))
    windows = np.flatnonzero(np.arange(n) + WINDOW <= ends)
    if not len(windows):
        return windows, windows, np.zeros(0, U)
    at = np.arange(n - GRAM + 1)
    grams = spans_hashed(piece.hashes, at, at + GRAM, WORDS_BASE)
    least, where, span = grams, at, 1
    while span < SPREAD:  # doubles the reach; the last step overlaps
        step = min(span, SPREAD - span)
        right = least[step:] < least[:-step]
        where = np.where(right, where[step:], where[:-step])
        least = np.where(right, least[step:], least[:-step])
        span += step
    return windows, where[windows], grams


def marked(docs: DataFrame) -> DataFrame:
    """(doc_id, key): the digest of each text."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce("text", F.lit(""))).alias("key"))


def odd_ids(marks: DataFrame) -> DataFrame | None:
    """(odd): the ids of several texts, or None if there are none."""
    several = marks.where("doc_id is not null").groupBy(F.col("doc_id").alias("odd")).agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("odd")
    found = checkpointed(several)
    return broadcast_if_small(found) if found.limit(1).count() else None


def placed(rows: DataFrame, key: Column, odd: DataFrame | None, always: bool) -> DataFrame:
    """``rows`` with (doc, tie), the place of a document in the order of all.

    ``tie`` is the digest ``key`` of the text for ids of several texts, after
    ``NO_ID`` for null ids, else empty; ``always``: for all rows, so that it does
    not depend on others.
    """
    tie = key if always else F.lit("")
    if odd is not None and not always:
        rows = rows.join(odd, F.col("doc_id") == F.col("odd"), "left")
        tie = F.when(F.col("odd").isNotNull(), key).otherwise(F.lit(""))
    tie = F.when(F.col("doc_id").isNull(), F.concat(F.lit(NO_ID), key)).otherwise(tie)
    return rows.withColumn("doc", F.coalesce("doc_id", F.lit(LAST))).withColumn("tie", tie).drop("odd", "doc_id")


def with_text(docs: DataFrame, odd: DataFrame | None = None, always: bool = False) -> DataFrame:
    """(text, doc, tie) of each document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return placed(rows, F.md5("text"), odd, always)


def repeated_names(names: pa.Array, rows: np.ndarray) -> pa.Array:
    return names.take(pa.array(rows))


def fingerprints(rows: DataFrame) -> DataFrame:
    """(h, doc, tie, place) of each selected gram of (doc, tie, text) rows."""

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(2)):
                _, chosen, grams = selected(piece)
                chosen = np.unique(chosen)
                doc = piece.doc_of(chosen)
                at = piece.first + doc
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[chosen].view(np.int64)), repeated_names(batch.column(0), at), repeated_names(batch.column(1), at), pa.array((chosen - piece.bounds[doc]).astype(np.int32))],
                    names=["h", "doc", "tie", "place"],
                )

    return rows.select(*KEY, "text").mapInArrow(select, "h long, doc long, tie string, place int")


class FingerprintIndex:
    """Runs of (h, n, first): a fingerprint, how often it occurred and its first (batch, doc, tie, place).

    ``passages``: runs of (h, first) of the different arrays of candidates,
    written by an index that is kept (``keep``).  ``buckets`` is fixed for all runs.
    ``states`` counts how often what it holds was written down.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, most_runs: int = MOST_RUNS, keep: bool = True):
        self.spark = spark
        self.path = path or shared_path(spark, "fingerprints")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.most_runs = most_runs
        self.keep = keep
        self.batches = self.states = 0
        self.runs: list[str] = []
        self.passages: list[str] = []
        self.merged_away: list[str] = []

    def commit(self) -> None:
        """Write down what the index holds, as the state that :meth:`reopened` finds; the one before, and runs that were merged, are deleted after that."""
        self.states += 1
        row = (self.buckets, self.most_runs, self.batches, self.runs, self.passages)
        state = self.spark.createDataFrame([row], "buckets int, most_runs int, batches int, runs array<string>, passages array<string>")
        state.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/state_{self.states}")
        deleted(self.spark, f"{self.path}/state_{self.states - 1}")
        self.drop(self.merged_away)
        self.merged_away = []

    @classmethod
    def reopened(cls, spark: SparkSession, path: str) -> FingerprintIndex:
        """The index at ``path`` as it was last written down, also by another session, whose tables are declared again."""
        at, files = files_of(spark, path)
        names = [f.getPath().getName() for f in files.listStatus(at)]
        done = [int(n.removeprefix("state_")) for n in names if n.startswith("state_") and files.exists(files_of(spark, f"{path}/{n}/_SUCCESS")[0])]
        if not done:
            raise ValueError(f"no index at {path}")
        row = spark.read.parquet(f"{path}/state_{max(done)}").first()
        index = cls(spark, path, row["buckets"], row["most_runs"])
        index.batches, index.states, index.runs, index.passages = row["batches"], max(done), list(row["runs"]), list(row["passages"])
        held = {*index.runs, *index.passages}
        for name in names:
            if name.startswith("run_") and name not in held:
                spark.sql(f"drop table if exists {name}")
                deleted(spark, f"{path}/{name}")
        for name in sorted(held):
            schema = spark.read.parquet(f"{path}/{name}").schema
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
            spark.sql(f"create table if not exists {name} ({columns}) using parquet clustered by (h) sorted by (h) into {index.buckets} buckets location '{path}/{name}'")
        return index

    def write(self, rows: DataFrame) -> str:
        name = f"run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, "h").sortBy("h").option("path", f"{self.path}/{name}").saveAsTable(name)
        return name

    def drop(self, names: list[str]) -> None:
        """Forget tables and delete their files."""
        for name in names:
            self.spark.sql(f"drop table {name}")
            deleted(self.spark, f"{self.path}/{name}")

    def append(self, rows: DataFrame) -> None:
        """Add a batch of (doc, tie, text) as a run."""
        start = F.struct(F.lit(self.batches).alias("batch"), *KEY, "place") if self.keep else F.lit(None)
        self.runs.append(self.write(fingerprints(rows).groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min(start).alias("first")).select("h", "n", *(["first"] if self.keep else []))))
        self.batches += 1
        if len(self.runs) > self.most_runs:
            self.compact()

    def merged(self, runs: list[str] | None = None) -> DataFrame:
        """(h, n, first) over the runs, by merge joins of the sorted buckets."""
        out = None
        for run in map(self.spark.table, self.runs if runs is None else runs):
            one = run.hint("merge")
            if out is None:
                out = one
                continue
            both = out.withColumnsRenamed({"n": "m", "first": "before"}).join(one, "h", "full")
            first = [F.least("before", "first").alias("first")] if self.keep else []
            out = both.select("h", (F.coalesce("m", F.lit(0)) + F.coalesce("n", F.lit(0))).alias("n"), *first)
        return out

    def compact(self) -> None:
        """Merge the runs into one, and those of passages; the old ones are dropped then, or, if a state that was written down needs them, with the next."""
        old, self.runs = self.runs, [self.write(self.merged())]
        if len(self.passages) > 1:
            old, self.passages = old + self.passages, [self.write(reduce(DataFrame.union, [self.spark.table(p).select("h", "first") for p in self.passages]).distinct())]
        if self.states:
            self.merged_away += old
        else:
            self.drop(old)

    def repeated(self) -> DataFrame:
        return self.merged().where("n > 1")

    def known(self, batch: DataFrame) -> DataFrame:
        """(h, batch, doc, tie, place): the old places of the fingerprints of ``batch`` (h)."""
        firsts = [self.spark.table(run).select("h", "first") for run in [*self.runs, *self.passages]]
        old = reduce(DataFrame.union, firsts).where(F.col("first.batch") < self.batches - 1)
        return old.join(batch.select("h").distinct(), "h", "left_semi").select("h", "first.*").distinct()

    def close(self) -> None:
        """Drop all runs and their files."""
        self.drop([*self.runs, *self.passages, *self.merged_away])
        deleted(self.spark, f"{self.path}/state_{self.states}")
        self.runs, self.passages, self.merged_away = [], [], []


def copies(marks: DataFrame) -> DataFrame:
    """(doc, tie) of documents whose whole text comes earlier too; marks: (doc, tie, key)."""
    start = F.struct(*KEY)
    heads = marks.groupBy("key").agg(F.min(start).alias("head"), F.max(start).alias("last")).where("last > head").select("key", "head")
    return marks.join(heads, "key").where(start > F.col("head")).select(*KEY).distinct()


def runs_of(piece: Piece, listed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows that select a listed gram, that gram of each, its hash, and where each run of them begins."""
    windows, chosen, grams = selected(piece)
    live = np.flatnonzero(listed[chosen]) if len(windows) else windows
    windows, chosen = windows[live], chosen[live]
    new = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (windows[1:] != windows[:-1] + 1)])) if len(live) else live
    return windows, chosen, grams, new


def lists_of(piece: Piece, lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The document and the value of each element of the lists of the piece's documents; a null list is empty."""
    own = lists.slice(piece.first, piece.docs)
    sizes = pc.fill_null(pc.list_value_length(own), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(piece.docs), sizes), own.flatten()


def listed_places(piece: Piece, places: pa.Array) -> np.ndarray:
    """Whether each word of the piece is a listed place of its document."""
    listed = np.zeros(len(piece.hashes), bool)
    doc, values = lists_of(piece, places)
    listed[values.to_numpy(zero_copy_only=False) + piece.bounds[doc]] = True
    return listed


def candidate_windows(rows: DataFrame, flagged: DataFrame) -> DataFrame:
    """(h, START, digest, windows): the full hashes of the windows of each run that selects a flagged gram, and a hash of them.

    ``rows``: (doc, tie, text); ``flagged``: (batch, doc, tie, places).
    """

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch.column(3)):
                windows, chosen, grams, new = runs_of(piece, listed_places(piece, batch.column(4)))
                if not len(windows):
                    continue
                full = spans_hashed(piece.other_hashes(), windows, windows + WINDOW, WORDS_BASE)
                ends = np.append(new[1:], len(windows))
                doc = piece.doc_of(windows[new])
                at = piece.first + doc
                begin = lambda xs: pa.array((xs[new] - piece.bounds[doc]).astype(np.int32))  # noqa: B023, E731
                arrays = pa.ListArray.from_arrays(pa.array(np.append(new, len(windows)).astype(np.int32)), pa.array(full.view(np.int64)))
                digest = spans_hashed(mixed(full), new, ends, WORDS_BASE)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(grams[chosen[new]].view(np.int64)), *[repeated_names(batch.column(k), at) for k in range(3)],
                        begin(windows), begin(chosen), pa.array(digest.view(np.int64)), arrays,
                    ],
                    names=["h", "batch", "doc", "tie", "place", "gram", "digest", "windows"],
                )

    joined = rows.join(flagged, KEY).select("batch", *KEY, "text", "places")
    return joined.mapInArrow(hashed, "h long, batch int, doc long, tie string, place int, gram int, digest long, windows array<long>")


def masks(opened: DataFrame, earlier: Column, by: list[str]) -> DataFrame:
    """``by`` and mask: bit i is set if the window at place + i occurs earlier."""
    bit = F.call_function("shiftleft", F.lit(1), F.col("i"))
    return opened.groupBy(*by).agg(F.coalesce(F.bit_or(F.when(earlier, bit)), F.lit(0)).alias("mask"))


def firsts_cold(runs: DataFrame) -> DataFrame:
    """(h, digest, START, mask) of the first of equal arrays, compared within the fingerprint's task."""
    start = F.struct(*START)
    dealt = runs.repartition("h").withColumn("start", start)
    firsts = dealt.withColumn("least", F.min("start").over(Window.partitionBy("h", "digest"))).where("start = least")
    several = F.min("digest").over(Window.partitionBy("h")) != F.max("digest").over(Window.partitionBy("h"))
    open_ = firsts.withColumn("windows", F.when(several, F.col("windows")))
    opened = open_.select("h", "digest", *START, F.posexplode_outer("windows").alias("i", "w"))
    here = F.struct("batch", "doc", "tie", (F.col("place") + F.col("i")).alias("at"))
    compared = opened.withColumn("here", here).withColumn("least", F.min("here").over(Window.partitionBy("h", "w")))
    return masks(compared, F.col("w").isNotNull() & (F.col("least") < F.col("here")), ["h", "digest", *START])


def firsts_hot(runs: DataFrame) -> DataFrame:
    """The same by pre-aggregated shuffles: no task gets a fingerprint's rows."""
    firsts = runs.groupBy("h", "digest").agg(F.min(F.struct(*START)).alias("start"), F.first("windows").alias("windows")).select("h", "digest", "start.*", "windows")
    here = F.struct("batch", "doc", "tie", (F.col("place") + F.col("i")).alias("at"))
    opened = firsts.select("h", "digest", *START, F.posexplode_outer("windows").alias("i", "w")).withColumn("here", here)
    least = opened.groupBy("h", "w").agg(F.min("here").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w", "least")
    return masks(opened.join(least, ["h", "w"], "left"), F.col("least") < F.col("here"), ["h", "digest", *START])


def kept_words(docs: DataFrame, places: DataFrame, firsts: DataFrame, copy_ids: DataFrame, with_texts: bool = True) -> DataFrame:
    """Counts, digest and, if asked for, text of what is left of each document.

    All windows that select a listed place go, but for the runs of ``firsts``
    (doc, tie, place, mask), of which those in the mask go.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, listed, own, copied = (batch.column(k) for k in range(1, 5))
            copied = copied.to_numpy(zero_copy_only=False)
            out: list[tuple[int, int, str, str | None]] = []
            for piece in pieces(texts):
                windows, _, _, new = runs_of(piece, listed_places(piece, listed))
                # The mask of each run by the window it begins with; all its windows go if it is none of the firsts.
                doc, fields = lists_of(piece, own)
                begins, masks_of = (fields.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
                by_word = np.full(len(piece.hashes) + 1, -1, np.int64)
                by_word[begins + piece.bounds[doc]] = masks_of
                sizes = np.diff(np.append(new, len(windows)))
                bit = np.arange(len(windows)) - np.repeat(new, sizes)
                go = (np.repeat(by_word[windows[new]], sizes) >> bit) & 1 == 1
                edge = np.zeros(len(piece.hashes) + 1, np.int64)
                np.add.at(edge, windows[go], 1)
                np.add.at(edge, windows[go] + WINDOW, -1)
                gone = np.cumsum(edge)[:-1] > 0
                for d, (low, high) in enumerate(zip(piece.bounds[:-1].tolist(), piece.bounds[1:].tolist(), strict=True)):
                    if copied[piece.first + d] and high - low >= WINDOW:
                        gone[low:high] = True
                    ws = piece.data[piece.starts[low] : piece.ends[high - 1]].tobytes().split() if high > low else []
                    n_gone = int(gone[low:high].sum())
                    joined = b" ".join(compress(ws, (~gone[low:high]).tolist()) if n_gone else ws)
                    out.append((len(ws), n_gone, hashlib.sha256(joined).hexdigest(), joined.decode() if with_texts else None))
            columns = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
            )

    mine = firsts.groupBy(*KEY).agg(F.collect_list(F.struct("place", "mask")).alias("own"))
    rows = docs.join(places, KEY, "left").join(mine, KEY, "left").join(copy_ids.withColumn("copied", F.lit(True)), KEY, "left")
    doc_id = F.when(~F.startswith("tie", F.lit(NO_ID)), F.col("doc"))
    rows = rows.select(doc_id.alias("doc_id"), "text", "places", "own", F.coalesce("copied", F.lit(False)).alias("copied"))
    return rows.mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def deduplicated(docs: DataFrame, index: FingerprintIndex | None = None, past: DataFrame | None = None, batches: int = BATCHES, with_texts: bool = True) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of each document, judged against all that the index has seen.

    Without an index, the documents are fed to a new one in ``batches`` of rising
    ids; its runs are compacted, read and dropped.  With one, they are one batch; ``past`` is a table
    with the texts of the earlier ones, of which only those are read that share
    a fingerprint.
    """
    temporary = index is None
    index = index or FingerprintIndex(docs.sparkSession, most_runs=1, keep=False)
    marks = checkpointed(marked(docs))
    odd = None if index.keep else odd_ids(marks)
    rows = with_text(docs, odd, index.keep)
    cuts = (marks.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)])).first()[0] or []) if temporary and batches > 1 else []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = rows if low is None else rows.where(F.col("doc") > low)
        index.append(part if high is None else part.where(F.col("doc") <= high))
    copy_ids = checkpointed(copies(placed(marks, F.col("key"), odd, index.keep)))
    candidates = index.repeated().select("h", (F.col("n") >= HOT).alias("hot"))
    found = fingerprints(rows).join(candidates, "h").join(copy_ids, KEY, "left_anti").withColumn("batch", F.lit(index.batches - 1))
    listed = lambda hot: F.collect_set(F.when(F.col("hot") == F.lit(hot), F.col("place")))
    by_document = lambda spots: checkpointed(spots.groupBy("batch", *KEY).agg(listed(False).alias("cold"), listed(True).alias("hot")))
    earlier = index.keep and index.batches > 1 and past is not None
    found = checkpointed(found) if earlier else found
    flagged = by_document(found)
    dealt = rows.repartition(*KEY)
    sources = [(dealt, flagged)]
    if earlier:
        sources.append((with_text(past, always=True), by_document(index.known(found).join(candidates, "h"))))
    sides = []
    for side, firsts in (("cold", firsts_cold), ("hot", firsts_hot)):
        runs = [candidate_windows(texts, spots.where(F.size(side) > 0).select("batch", *KEY, F.col(side).alias("places"))) for texts, spots in sources]
        sides.append(firsts(reduce(DataFrame.unionByName, runs)))
    firsts = sides[0].union(sides[1])
    now = firsts.where(F.col("batch") == index.batches - 1)
    if index.keep:
        now = checkpointed(now)
        index.passages.append(index.write(now.select("h", F.struct("batch", *KEY, F.col("gram").alias("place")).alias("first"))))
        index.commit()
    places = flagged.select(*KEY, F.concat("cold", "hot").alias("places"))
    out = kept_words(dealt, places, now.select(*KEY, "place", "mask"), copy_ids, with_texts)
    if temporary:
        index.close()
    return out


def digest(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, with_texts=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
