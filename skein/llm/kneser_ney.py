"""Language-model scores: an interpolated, modified Kneser-Ney model of word pairs.

Spark counts the words and the word pairs of the training texts, and the counts
are kept in sorted arrays of 64-bit hashes: a folder of segments in the shared
checkpoint folder, each with the keys of one range of hashes.  Workers map the
segments that a batch of texts needs into memory, sort the batch's keys and look
them up in one pass, so a worker holds a batch and touched pages, never a model.

``words/<segment>``: ``h`` (hashes of words), ``c`` (uses), ``stats`` (for each
word: what follows it in all, how many followers were seen once, twice, more
often, and how many different words it follows).  ``pairs/<segment>``: ``h``
(hashes of pairs of word numbers) and ``c`` (uses).  A word's number is its
segment and, in the last ``bits``, its place there, so pairs are exact but for 64-bit hashes: two of n
words, or of n pairs, have one hash with a probability of n * n / 2**65.

With ``c`` the uses of a pair, ``C`` those of its first word as a context, ``k`` the number of different
words before a word, and ``K`` that of all pairs::

    P(w | v) = max(c(vw) - D(c), 0) / C(v) + g(v) * P(w)
    P(w)     = max(k(w) - d(k), 0) / K + g / (V + 1)

Each level has three discounts from its counts of counts (Chen and Goodman),
and the ``g`` hand on what they take away.  Words that training didn't have share
one place of the ``V + 1``.  After a word that training didn't have, ``P(w)`` holds.
Texts begin after a start mark and end with an end mark, which is scored too.

Cases: a null text is empty and has the end mark only; a null key counts as the
text ''; texts of any length are counted and scored in pieces; rows that repeat
count as often as they are there; without any training text the model knows
nothing and gives each token the probability 1; further columns pass through
:func:`scored` unless they have the name of a result, which replaces them.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..arrays import mapped, put, restored, squeezed
from ..checkpoints import deleted
from . import numeric_text
from .common import checkpointed, shared_path, small_batches
from .numeric_text import STEP, mixed

#: The hashes of the marks before and after a text, those of two blanks, which no word has.
START, END = numeric_text.words_hashed(np.frombuffer(b" \n", np.uint8), np.array([0, 1]), np.array([1, 2]))

#: Fixed values of the contract: the share of held-out keys and what is added to each count.
FOLDS = 10
ADDED = 0.1

#: Tokens that are counted at once, and that are scored at once.
BATCH = 1 << 21
SCORED = 1 << 19

#: Bytes of text that are hashed at once; a byte takes some 60 bytes of memory then.
HASHED = 1 << 18

#: Bytes of text for a segment, and the least number of segments.
SEGMENT = 24 << 20
LEAST_SEGMENTS = 256


@dataclass(frozen=True)
class Model:
    """Where the arrays are, and what concerns all words: sums and discounts of both levels."""

    folder: str
    segments: int
    bits: int
    tokens: int
    kept: int
    pairs: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    word_left: float

    def saved(self, spark: SparkSession) -> Model:
        """The same, described in its folder, so that :func:`opened` finds it in another session."""
        row = (self.segments, self.bits, self.tokens, self.kept, self.pairs, list(self.pair_discounts), list(self.word_discounts), self.word_left)
        schema = "segments int, bits int, tokens long, kept long, pairs long, pair_discounts array<double>, word_discounts array<double>, word_left double"
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/about")
        return self


def opened(spark: SparkSession, folder: str) -> Model:
    """The model that was written to ``folder``."""
    row = spark.read.parquet(f"{folder}/about").first()
    return Model(folder, row["segments"], row["bits"], row["tokens"], row["kept"], row["pairs"], tuple(row["pair_discounts"]), tuple(row["word_discounts"]), row["word_left"])


def hashes(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, texts, hashes, where each text's begin) of some texts at once; a text's words stand between the marks."""
    for piece in numeric_text.pieces(texts, numeric_text.LOWER, size=HASHED):
        offsets = piece.bounds + 2 * np.arange(piece.docs + 1)
        flat = np.empty(offsets[-1], np.uint64)
        flat[offsets[:-1]], flat[offsets[1:] - 1] = START, END
        flat[np.arange(len(piece.hashes)) + 2 * np.repeat(np.arange(piece.docs), np.diff(piece.bounds)) + 1] = piece.hashes
        yield piece.first, piece.docs, flat, offsets


def held_out(key: Column, folds: int = FOLDS) -> Column:
    """Whether the documents of a key are kept out of training."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


# Arrays in the shared folder.


def paired(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """A hash for each pair of word numbers."""
    return mixed(mixed(v.astype(np.uint64) + STEP) ^ (w.astype(np.uint64) * STEP))


def segment_of(h: np.ndarray, segments: int) -> np.ndarray:
    """The segment of hashes: ranges of equal width of their scrambled upper half."""
    return ((h.astype(np.uint64) >> np.uint64(32)) * np.uint64(segments) >> np.uint64(32)).astype(np.int64)


def found(folder: str, h: np.ndarray, segments: int) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray]]:
    """For sorted different hashes: (segment, its part of them, whether each is there, its place there) of each segment that has some."""
    at = segment_of(h, segments)
    edges = np.searchsorted(at, np.arange(segments + 1))
    for s in np.flatnonzero(np.diff(edges)):
        part = slice(edges[s], edges[s + 1])
        keys = mapped(f"{folder}/{s}.h", np.uint64)
        spot = np.searchsorted(keys, h[part])
        hit = spot < len(keys)
        hit[hit] = keys[spot[hit]] == h[part][hit]
        yield int(s), part, hit, spot


def number(folder: str, h: np.ndarray, segments: int, bits: int) -> np.ndarray:
    """The numbers of sorted different words, -1 for those that training didn't have."""
    out = np.full(len(h), -1, np.int64)
    for s, part, hit, spot in found(f"{folder}/words", h, segments):
        out[part] = np.where(hit, (s << bits) + spot, -1)
    return out


# Counting.


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, whether each begins a text) of about ``BATCH`` tokens, of one text at least."""
    have, size = [], 0

    def flat() -> tuple[np.ndarray, np.ndarray]:
        whole = np.concatenate([h for h, _ in have]), np.concatenate([b for _, b in have])
        have.clear()
        return whole

    for batch in batches:
        for _, _, h, offsets in hashes(batch.column(0)):
            begins = np.zeros(len(h), bool)
            begins[offsets[:-1]] = True
            have.append((h, begins))
            size += len(h)
            if size >= BATCH:
                size = 0
                yield flat()
    if have:
        yield flat()


def begun(values: np.ndarray) -> np.ndarray:
    """Where each of the different values in order begins."""
    return np.flatnonzero(np.concatenate([np.ones(min(1, len(values)), bool), values[1:] != values[:-1]]))


def counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different values in order, how often each is there or the sum of its weights)."""
    if weights is None:
        values = np.sort(values)
        first = begun(values)
        return values[first], np.diff(first, append=len(values))
    order = np.argsort(values, kind="stable")
    values = values[order]
    first = begun(values)
    return values[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64)


#: What a pair has of its second word.
LOWER_HALF = 0xFFFFFFFF


def pairs_in(h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(different words in order, different pairs in order, how often each is there) of texts; a pair is the places of its words, the first in the upper half.

    Pairs are sorted where they are, by themselves: sorted by hashes they would need an order and copies of it.
    """
    names = np.unique(h)
    at = np.searchsorted(names, h)
    pairs = at[:-1] << 32
    pairs |= at[1:]
    del at
    pairs[begins[1:]] = -1  # what ends a text and begins the next one is no pair
    pairs.sort()
    pairs = pairs[np.count_nonzero(begins[1:]) :]
    first = begun(pairs)
    return names, pairs[first], np.diff(first, append=len(pairs))


#: Rows that are sent from a worker at once.
SENT = 1 << 16


def sent(columns: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The columns in batches of ``SENT`` rows."""
    size = len(next(iter(columns.values())))
    for k in range(0, size, SENT):
        yield pa.RecordBatch.from_arrays([pa.array(x[k : k + SENT]) for x in columns.values()], list(columns))


def narrow(n: np.ndarray) -> np.ndarray:
    """Whole numbers in the fewest bytes that hold them all."""
    return n.astype(np.min_scalar_type(int(n.max()))) if n.size else n.astype(np.uint8)


def numbers(path: str, n: int, width: int = 1) -> np.ndarray:
    """``n`` rows of ``width`` numbers that were written by :func:`narrow`."""
    raw = mapped(path, np.uint8)
    return raw.view(f"u{len(raw) // (n * width)}").reshape(n, width)


def packed(n: np.ndarray) -> bytes:
    """Whole numbers in the fewest bytes, all first bytes before all second ones, compressed."""
    n = narrow(n)
    return squeezed(np.ascontiguousarray(n.view(np.uint8).reshape(len(n), -1).T))


def unpacked(data: bytes, size: int) -> np.ndarray:
    """The ``size`` numbers of :func:`packed`."""
    raw = np.ascontiguousarray(restored(data, np.uint8).reshape(-1, size).T)
    return raw.view(f"u{raw.shape[1]}").ravel().astype(np.uint64)


def word_counts(texts: DataFrame, folder: str, segments: int) -> tuple[int, int, int]:
    """(tokens, different tokens, bits of a place) of the training texts, whose words are written with their uses."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, _ in joined(batches):
            h, n = counted(h)
            yield from sent({"segment": segment_of(h, segments), "h": h.view(np.int64), "n": n})

    def write(part: pa.Table) -> pa.Table:
        s = part.column("segment")[0].as_py()
        h, n = counted(part.column("h").to_numpy().view(np.uint64), part.column("n").to_numpy())
        n = np.where(h == START, 0, n)  # the start mark is a context, no token
        put(f"{folder}/words/{s}.h", h)
        put(f"{folder}/words/{s}.c", narrow(n))
        return pa.table({"tokens": [int(n.sum())], "kept": [int((n > 0).sum())], "size": [len(h)]})

    rows = texts.mapInArrow(count, "segment long, h long, n long").groupBy("segment").applyInArrow(write, "tokens long, kept long, size long")
    total = rows.agg(F.sum("tokens").alias("tokens"), F.sum("kept").alias("kept"), F.max("size").alias("size")).first()
    return total["tokens"] or 0, total["kept"] or 0, max(4, (total["size"] or 0).bit_length())


STATS = ["total", "ones", "twos", "more", "before"]


def pair_counts(texts: DataFrame, folder: str, segments: int, bits: int) -> DataFrame:
    """(id, total, ones, twos, more, before) of the word numbers of training, whose pairs are written with their uses.

    Pairs are dealt by their hash, so that no word's pairs meet in one task; each
    segment gives its share of the sums for each word.  They travel in the order
    of their first words, those of a batch and a segment packed in a row, so that
    Spark sorts rows of many pairs and its executors hold few of them at once.
    Rows of id -1 to -4 have in ``total`` how many pairs were seen so often.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, begins in joined(batches):
            names, pairs, n = pairs_in(h, begins)
            del h, begins
            ids = number(folder, names, segments, bits)
            at = np.empty(len(pairs), np.min_scalar_type(segments))
            for k in range(0, len(pairs), SENT):
                part = pairs[k : k + SENT]
                at[k : k + SENT] = segment_of(paired(ids[part >> 32], ids[part & LOWER_HALF]), segments)
            order = np.argsort(at, kind="stable")  # within a segment by first words, whose numbers rise with their hashes
            edges = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.bincount(at, minlength=segments))])
            del at
            for s in np.flatnonzero(np.diff(edges)):
                part = order[edges[s] : edges[s + 1]]
                v, w = ids[pairs[part] >> 32], ids[pairs[part] & LOWER_HALF]
                row = [s, len(part), packed(np.diff(v.view(np.uint64), prepend=np.uint64(0))), packed(w.view(np.uint64)), packed(n[part])]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], ["segment", "size", *"vwn"])
            del names, pairs, n, ids, order

    def write(part: pa.Table) -> pa.Table:
        s, sizes = part.column("segment")[0].as_py(), part.column("size").to_pylist()
        v, w, n = (np.concatenate([unpacked(x.as_py(), size) for x, size in zip(part.column(c), sizes, strict=True)]) for c in "vwn")
        ends = np.cumsum(sizes)
        for a, b in zip(ends - sizes, ends, strict=True):
            np.cumsum(v[a:b], out=v[a:b])
        v, w, n = (x.view(np.int64) for x in (v, w, n))
        key = paired(v, w)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = begun(key)
        n = np.add.reduceat(n[order], first)
        key, v, w = key[first], v[order[first]], w[order[first]]
        del order, first
        put(f"{folder}/pairs/{s}.h", key)
        put(f"{folder}/pairs/{s}.c", narrow(n))
        ids = np.union1d(np.unique(v), np.unique(w))
        of_v, of_w = np.searchsorted(ids, v), np.searchsorted(ids, w)
        sums = [np.bincount(of_v, n, len(ids)), *(np.bincount(of_v, test, len(ids)) for test in (n == 1, n == 2, n > 2)), np.bincount(of_w, minlength=len(ids))]
        seen = [[int((n == k).sum())] for k in (1, 2, 3, 4)]
        columns = [np.concatenate([x.astype(np.int64), np.zeros(4, np.int64)]) for x in sums]
        columns[0][len(ids) :] = np.ravel(seen)
        return pa.table({"id": np.concatenate([ids, [-1, -2, -3, -4]]), **dict(zip(STATS, columns, strict=True))})

    schema = ", ".join(f"{c} long" for c in ["id", *STATS])
    rows = texts.mapInArrow(count, "segment long, size long, v binary, w binary, n binary").groupBy("segment").applyInArrow(write, schema)
    return rows.groupBy("id").agg(*[F.sum(c).alias(c) for c in STATS])


def write_stats(stats: DataFrame, folder: str, bits: int) -> dict[str, int]:
    """The sums of each word are written next to its hash.

    Returns how many pairs were seen once to four times (``seen1`` to ``seen4``),
    how many words come after one to four different ones (``before1`` to
    ``before4``) and after more than two (``more``), and all pairs (``pairs``).
    """

    def write(part: pa.Table) -> pa.Table:
        s, ids = part.column("segment")[0].as_py(), part.column("id").to_numpy()
        if s < 0:
            return pa.table({"name": [f"seen{-k}" for k in ids], "n": part.column("total")})
        out = np.zeros((len(mapped(f"{folder}/words/{s}.h", np.uint64)), len(STATS)), np.int64)
        out[ids & ((1 << bits) - 1)] = np.stack([part.column(c).to_numpy() for c in STATS], axis=1)
        put(f"{folder}/words/{s}.stats", narrow(out))
        before = out[:, STATS.index("before")]
        sums = {f"before{k}": int((before == k).sum()) for k in (1, 2, 3, 4)} | {"more": int((before > 2).sum()), "pairs": int(before.sum())}
        return pa.table({"name": list(sums), "n": list(sums.values())})

    rows = stats.withColumn("segment", F.shiftright("id", bits)).groupBy("segment").applyInArrow(write, "name string, n long")
    return {r["name"]: r["n"] for r in rows.groupBy("name").agg(F.sum("n").alias("n")).collect()}


def discounts(seen: list[int]) -> tuple[float, ...]:
    """What is taken from counts of one, two and more, after how many have counts of one to four; a half of the count where that is undefined or out of range."""
    ones, twos, threes, fours = seen
    rate = ones / (ones + 2 * twos) if ones else 0.0
    out = []
    for k, (n, more) in enumerate([(ones, twos), (twos, threes), (threes, fours)], 1):
        d = k - (k + 1) * rate * more / n if n and more and rate else -1.0
        out.append(d if 0 < d < k else k / 2)
    return tuple(out)


@contextmanager
def shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of each query that is run in this block are deleted when it ends; none is run again."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def train(docs: DataFrame, text: str = "text", folder: str | None = None) -> Model:
    """A model of the texts, written to ``folder``, a new one in the checkpoint folder if there is none."""
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "kneser-ney")
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text}`")))).first()[0] or 0
    segments = max(LEAST_SEGMENTS, 1 + size // SEGMENT)
    texts = docs.select(F.col(f"`{text}`").cast("string").alias("text"))
    with shuffles_deleted(spark), small_batches(spark):
        n, kept, bits = word_counts(texts, folder, segments)
        sums = write_stats(pair_counts(texts, folder, segments, bits), folder, bits)
    count = lambda name: [sums.get(f"{name}{k}", 0) for k in (1, 2, 3, 4)]
    taken, pairs = discounts(count("before")), sums.get("pairs", 0)
    left = sum(d * c for d, c in zip(taken, [*count("before")[:2], sums["more"]], strict=True)) / pairs if pairs else 1.0
    return Model(folder, segments, bits, n, kept, pairs, discounts(count("seen")), taken, left).saved(spark)


# Scoring.


def after_discount(n: np.ndarray, taken: tuple[float, ...]) -> np.ndarray:
    return n - np.array([0.0, *taken])[np.minimum(n, 3).astype(np.int64)]


def looked_up(model: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, uses, stats) of sorted different words; -1 and zeros for those that training didn't have."""
    ids, uses, stats = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64), np.zeros((len(h), len(STATS)), np.int64)
    for s, part, hit, spot in found(f"{model.folder}/words", h, model.segments):
        at, where = spot[hit], np.arange(part.start, part.stop)[hit]
        if len(at):
            size = len(mapped(f"{model.folder}/words/{s}.h", np.uint64))
            ids[where] = (s << model.bits) + at
            uses[where] = numbers(f"{model.folder}/words/{s}.c", size)[at, 0]
            stats[where] = numbers(f"{model.folder}/words/{s}.stats", size, len(STATS))[at]
    return ids, uses, stats


def pair_uses(model: Model, keys: np.ndarray) -> np.ndarray:
    """The uses of sorted different pairs."""
    out = np.zeros(len(keys), np.int64)
    for s, part, hit, spot in found(f"{model.folder}/pairs", keys, model.segments):
        if hit.any():
            size = len(mapped(f"{model.folder}/pairs/{s}.h", np.uint64))
            out[np.arange(part.start, part.stop)[hit]] = numbers(f"{model.folder}/pairs/{s}.c", size)[spot[hit], 0]
    return out


def token_scores(model: Model, h: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether training has it, base score, log10 probability) of each token of texts after their start marks; 0 for the marks."""
    names, at = np.unique(h, return_inverse=True)
    ids, uses, stats = looked_up(model, names)
    plain = np.log10((uses + ADDED) / (model.tokens + ADDED * (model.kept + 1)))
    before = stats[:, 4]
    alone = np.maximum(after_discount(before, model.word_discounts), 0) / max(model.pairs, 1) + model.word_left / (model.kept + 1)
    total = stats[:, 0]
    left = np.where(total > 0, stats[:, 1:4] @ np.array(model.pair_discounts) / np.maximum(total, 1), 1.0)
    second = np.flatnonzero(~begins)
    v, w = at[second - 1], at[second]
    known = (ids[v] >= 0) & (ids[w] >= 0)
    keys, where = np.unique(paired(ids[v[known]], ids[w[known]]), return_inverse=True)
    n = np.zeros(len(second), np.int64)
    n[known] = pair_uses(model, keys)[where]
    p = np.maximum(after_discount(n, model.pair_discounts), 0) / np.maximum(total[v], 1) + left[v] * alone[w]
    out = [np.zeros(len(h), bool), np.zeros(len(h)), np.zeros(len(h))]
    out[0][second], out[1][second], out[2][second] = uses[w] > 0, plain[w], np.log10(p)
    return out[0], out[1], out[2]


def text_scores(model: Model, h: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """[tokens, known tokens, base score, score] of texts, ``SCORED`` tokens at once."""
    begins = np.zeros(len(h), bool)
    begins[offsets[:-1]] = True
    n = len(offsets) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    sums = [np.diff(offsets) - 1, np.zeros(n, np.int64), np.zeros(n), np.zeros(n)]
    for a in range(0, len(h), SCORED):
        early = max(a - 1, 0)  # the word before the piece is its first context
        first = begins[early : a + SCORED].copy()
        first[0] = True
        known, base, score = (x[a - early :] for x in token_scores(model, h[early : a + SCORED], first))
        of = text[a : a + SCORED]
        sums[1] += np.bincount(of, known, n).astype(np.int64)
        sums[2] += np.bincount(of, base, n)
        sums[3] += np.bincount(of, score, n)
    return sums


RESULTS = ["n_tokens", "n_known", "base_score", "score", "perplexity"]


def scored(docs: DataFrame, model: Model, text: str = "text", with_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens, n_known, base_score, score and perplexity of each text, which itself is left out without ``with_text``."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    at = kept.columns.index(text)
    back = [k for k in range(len(kept.columns)) if with_text or k != at]
    names = [kept.columns[k] for k in back]
    kinds = [LongType(), LongType(), DoubleType(), DoubleType(), DoubleType()]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: list[list[np.ndarray]] = []
            have: list[tuple[np.ndarray, np.ndarray]] = []

            def flush() -> None:
                sizes = np.concatenate([np.diff(o) for _, o in have])
                parts.append(text_scores(model, np.concatenate([h for h, _ in have]), np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])))
                have.clear()

            for _, _, h, offsets in hashes(batch.column(at)):
                have.append((h, offsets))
                if sum(len(x) for x, _ in have) >= SCORED:
                    flush()
            if have:
                flush()
            sums = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in range(4)]
            sums.append(10.0 ** (-sums[3] / sums[0]))
            whole = [pa.array(x.astype(np.int64 if k < 2 else float)) for k, x in enumerate(sums)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in back), *whole], [*names, *RESULTS])

    return kept.mapInArrow(score, StructType([*(kept.schema.fields[k] for k in back), *(StructField(c, t) for c, t in zip(RESULTS, kinds, strict=True))]))


def digest(docs: DataFrame) -> DataFrame:
    """Scores of all documents by a model of those that are not held out; the model is deleted when they are written."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(rows.where(~F.col("held_out")))
    short = rows.select("doc_id", "held_out", "text")
    with small_batches(spark):
        out = checkpointed(scored(short, model, with_text=False))
    deleted(spark, model.folder)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
