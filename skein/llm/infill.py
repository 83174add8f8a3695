"""Fill-in-the-middle: whole batches of texts are cut and put together again in Arrow's UTF-8 buffers.

A text is a run of units: characters (code points), words or lines.  Two cuts of
a text come from the hash of its key; what lies before, between and after them
is its prefix, middle and suffix, which are written in the order prefix, suffix,
middle (``psm``) or suffix, prefix, middle (``spm``), each behind its sentinel.
A text that is empty, has a sentinel in it, or is not chosen, stays ``plain``.

The kernel never loops over texts.  A table of 256 entries gives the class of
each byte; a unit starts where two adjacent bytes say so, and at the start of a
text; running sums of the starts, read relative to the text's first byte, number
the units of each text, and one ``searchsorted`` in the sums finds the bytes of
all cuts of the batch.  Pieces and sentinels are then gathered with one index.
Batches are taken in slices of about ``SLICE`` bytes, so that memory is bounded
by that and the longest text.

Cases: a null text is read as empty and comes out empty and plain; an empty one
likewise; a text of any length is cut whole; a null key hashes as the text
``null``; rows that repeat a key and text come out alike; an empty table gives an
empty result; the columns ``form``, ``n``, ``prefix``, ``middle`` and
``rewritten`` of :func:`rewritten` replace those of the table that have their
names, and all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import fresh
from .numeric_text import gathered

# Fixed values of the contract: sentinels, the salt, the shares of rewritten texts and of spm among them.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SALT = "1"
REWRITTEN_SHARE = 90
SPM_SHARE = 20

#: Bytes of text that are cut at once.
SLICE = 8 << 20

PLAIN, PSM, SPM = 0, 1, 2
FORMS = ["plain", "psm", "spm"]
UNITS = ["char", "word", "line"]
RESULTS = ["form", "n", "prefix", "middle", "rewritten"]


def byte_classes(unit: str) -> np.ndarray:
    """The class of each byte value: 0 a byte that goes on with a character, 1 blank, 2 newline, 3 any other first byte."""
    out = np.full(256, 3, np.uint8)
    out[0x80:0xC0] = 0
    if unit != "char":
        out[[0x20, *range(0x09, 0x0E)]] = 1
    if unit == "line":
        out[0x0A] = 2
    return out


def starts_of_units(data: np.ndarray, unit: str) -> np.ndarray:
    """For each byte, whether a unit starts there; words take the blanks before them along, lines the newline after."""
    kind = byte_classes(unit)[data]
    before = np.concatenate([np.full(1, 1, np.uint8), kind[:-1]])
    if unit == "char":
        return kind != 0
    if unit == "line":
        return before == 2
    return (kind == 1) & (before != 1)


def cuts(data: np.ndarray, first: np.ndarray, last: np.ndarray, hashes: np.ndarray, unit: str) -> tuple[np.ndarray, np.ndarray]:
    """(units of each text, byte offsets of its two cuts).

    ``first``, ``last``: where the bytes of each text start and end; ``hashes``:
    two rows of numbers, whose remainders by (units + 1) are the cuts.
    """
    start = starts_of_units(data, unit)
    start[first[last > first]] = True
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(start)])  # unit starts before each byte
    n = upto[last] - upto[first]
    at = np.sort(hashes % (n + 1), axis=0)
    found = np.searchsorted(upto, upto[first] + at + 1) - 1  # the byte of the start with that number
    return n, np.where(at == n, last, found)


def characters(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Code points between byte offsets."""
    upto = np.concatenate([np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80)])
    return upto[last] - upto[first]


def put_together(data: np.ndarray, offsets: np.ndarray, form: np.ndarray, hashes: np.ndarray, unit: str = "char") -> dict[str, np.ndarray]:
    """Units, code points of prefix and middle, and the rewritten texts as offsets and bytes."""
    first, last = offsets[:-1], offsets[1:]
    n, (a, b) = cuts(data, first, last, hashes, unit)
    form = np.where(n == 0, PLAIN, form)
    marks = [np.frombuffer(m.encode(), np.uint8) for m in (PREFIX, SUFFIX, MIDDLE)]
    at = len(data) + np.cumsum([0, *map(len, marks)])
    whole = np.concatenate([data, *marks])
    spm, cut = form == SPM, form != PLAIN
    mark = lambda k: np.full(len(form), at[k])
    width = lambda k: np.where(cut, len(marks[k]), 0)
    # Sentinel and piece three times; a plain text is one piece.
    starts = np.stack([np.where(spm, mark(1), mark(0)), np.where(cut, np.where(spm, b, first), first), np.where(spm, mark(0), mark(1)), np.where(spm, first, b), mark(2), a], axis=1)
    second = np.where(cut, np.where(spm, a - first, last - b), 0)
    sizes = np.stack([np.where(spm, width(1), width(0)), np.where(cut, np.where(spm, last - b, a - first), last - first), np.where(spm, width(0), width(1)), second, width(2), np.where(cut, b - a, 0)], axis=1)
    out = gathered(whole, starts.ravel(), sizes.ravel())
    return {"n": n, "form": form, "prefix": characters(data, first, a), "middle": characters(data, a, b), "offsets": np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes.sum(axis=1))]), "bytes": out}


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy unless a null has to be read as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    at = np.frombuffer(offsets, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8))[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Runs of texts of about ``size`` bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1)
        yield at, to
        at = to


def numbered(key: Column, salt: str) -> list[Column]:
    """The first four 8-digit groups of the hex SHA-256 of salt, colon and key, as numbers."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def rewritten(docs: DataFrame, key: str = "doc_id", text: str = "text", unit: str = "char", share: int = REWRITTEN_SHARE, spm_share: int = SPM_SHARE, salt: str = SALT) -> DataFrame:
    """``docs`` with form, n (units), prefix and middle (code points, null if plain) and the rewritten text."""
    if unit not in UNITS:
        raise ValueError(f"a unit is one of {UNITS}")
    if {key.lower(), text.lower()} & set(RESULTS):
        raise ValueError(f"key and text may not be called one of {RESULTS}")
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in RESULTS])
    one, two, form, read = fresh(kept, "h1", "h2", "form", "text")
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    h1, h2, h3, h4 = numbered(F.col(f"`{key}`"), salt)
    marked = F.lit(False)
    for m in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(body, F.lit(m))
    choice = F.when(marked | (F.pmod(h3, F.lit(100)) >= share), PLAIN).when(F.pmod(h4, F.lit(100)) < spm_share, SPM).otherwise(PSM)
    given = kept.select(*[F.col(f"`{c}`") for c in kept.columns], body.alias(read), h1.alias(one), h2.alias(two), choice.alias(form))
    names = kept.columns
    width = len(names)
    added = [StructField(c, t) for c, t in zip(RESULTS, [StringType(), LongType(), LongType(), LongType(), StringType()], strict=True)]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, offsets = text_buffers(batch.column(width))
            hashes = np.stack([batch.column(width + k).to_numpy(zero_copy_only=False) for k in (1, 2)])
            forms = batch.column(width + 3).to_numpy(zero_copy_only=False)
            for a, b in slices(offsets, SLICE):
                out = put_together(whole[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], forms[a:b], hashes[:, a:b], unit)
                plain = out["form"] == PLAIN
                texts = pa.LargeStringArray.from_buffers(b - a, pa.py_buffer(np.ascontiguousarray(out["offsets"])), pa.py_buffer(out["bytes"]))
                named = pa.array(np.array(FORMS)[out["form"]])
                new = [named, pa.array(out["n"]), pa.array(out["prefix"], mask=plain), pa.array(out["middle"], mask=plain), texts.cast(pa.string()) if out["offsets"][-1] < 1 << 31 else texts]
                yield pa.RecordBatch.from_arrays([c.slice(a, b - a) for c in batch.columns[:width]] + new, [*names, *RESULTS])

    return given.mapInArrow(cut, StructType([*kept.schema.fields, *added]))


def restored(text: Column, form: Column) -> Column:
    """The text that was rewritten, from the result and its form.

    No sentinel is in a text that is not plain, and none can arise where a piece
    meets one, so the first of each is the one that was put there.
    """
    between = lambda left, right: F.substring_index(F.substr(text, F.instr(text, left) + F.lit(len(left))), right, 1)
    after = lambda left: F.substring_index(text, left, -1)
    psm = F.concat(between(PREFIX, SUFFIX), after(MIDDLE), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), after(MIDDLE), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def digest(docs: DataFrame) -> DataFrame:
    """Form, cuts and checksums of each document."""
    out = rewritten(docs.select("doc_id", "text")).drop("text")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", "n", "form", F.col("prefix").alias("prefix_chars"), F.col("middle").alias("middle_chars"),
        sha(F.col("rewritten")).alias("output_sha256"), sha(restored(F.col("rewritten"), F.col("form"))).alias("restored_sha256"),
    )
