"""Mixing of sources to target weights, as a time-varying curriculum.

Each source has a share of the training words and a schedule that says when it
is wanted.  The integral of the schedule is the cumulative demand; inverting it
at the offset of a copy of a document gives that copy's training position in
[0, 1].  Only window sums over pieces of bounded size are used; the words of a text are
counted once, into a narrow checkpoint.

Targets: sources in code point order, null last, have weights 5, 2, 1, repeating.
A target stops at ``MOST`` times its source's size and the excess is shared out
again by weight.  That fixed point is min(cap, level * weight) for one level,
found from running sums over the sources.

Copies: documents are laid out in the order of the MD5 of their id.  Copy r of a
document whose words start at offset c has offset r * source_size + c, and is
taken if its middle lies before the target.  So a document is taken 0 to
``MOST`` times, and a source's words differ from its target by less than one
document.

Cases: a null text has size 0 and takes nothing; a null source is a source of
its own; a source of size 0 has target 0; repeated rows count each; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, n_words

# The weights by rank, and the most copies of a document.
WEIGHTS = [5.0, 2.0, 1.0]
MOST = 3

#: Slope of the schedules by rank: a source with slope a has the weight
#: 1 + a - 2 a t at time t, so its integral over [0, 1] is 1.
SLOPES = [-0.5, 0.0, 0.5]

#: Rows of a source in a piece of its order, on average; the number of pieces
#: grows with the table up to 16**5, and the order does not depend on it.
PIECE_ROWS = 500


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, rank, target) from (source, source_size); a row for each source."""
    rank = Window.orderBy(F.asc_nulls_last("source"))
    ranked = sizes.withColumn("rank", F.row_number().over(rank).cast("int"))
    at = (F.col("rank") - 1) % len(WEIGHTS)
    weighed = ranked.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (at + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(float(MOST)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    summed = weighed.select(
        "*",
        (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))).alias("left_words"),
        (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))).alias("left_weight"),
    )
    # The level is the first left_words / left_weight whose own source is not above its cap.
    level = F.when(F.col("left_words") / F.col("left_weight") * F.col("w") <= F.col("cap"), F.col("left_words") / F.col("left_weight"))
    whole = by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    levelled = summed.withColumn("level", F.first(level, ignorenulls=True).over(whole))
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    return levelled.select("source", "source_size", "rank", F.coalesce(target, F.lit(0.0)).alias("target"))


def position(offset: Column, target: Column, slope: Column) -> Column:
    """The time at which a source's cumulative demand reaches ``offset``.

    The demand up to time t is target * ((1 + a) t - a t^2).
    """
    u = F.least(F.lit(1.0), offset / target)
    root = F.sqrt(F.greatest(F.lit(0.0), (1 + slope) * (1 + slope) - 4 * slope * u))
    return F.when(slope == 0, u).otherwise(((1 + slope) - root) / (2 * slope))


def pieces(rows: int) -> int:
    """How many pieces the order of a source is cut into, a power of two."""
    return min(1 << 20, max(16, 1 << (rows // PIECE_ROWS).bit_length()))


def plan(docs: DataFrame, keys: list[str]) -> DataFrame:
    """``docs`` with columns source_size, target, taken, copies and positions.

    ``docs`` has doc_id, source, size and ``keys``, which settle the order among
    documents with one id; it must not have the new names yet.
    """
    own, piece, mark, offset = fresh(docs, "own", "piece", "mark", "offset")
    n = pieces(docs.count())
    rows = docs.withColumn(own, F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    rows = rows.withColumn(mark, F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = rows.withColumn(piece, F.floor(F.conv(F.substring(mark, 1, 5), 16, 10).cast("long") * n / (1 << 20)).cast("int"))
    per_piece = rows.groupBy(own, piece).agg(F.sum("size").alias("n"), F.first("source").alias("source"))
    per_source = per_piece.groupBy("source").agg(F.sum("n").alias("source_size"))
    upto = Window.partitionBy(own).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    starts = per_piece.select(F.col(own).alias("o_"), F.col(piece).alias("p_"), F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("b_"))
    aims = targets(per_source).select(
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("o_"), F.col("source_size").alias("z_"), F.col("rank").alias("r_"), F.col("target").alias("t_")
    )
    within = Window.partitionBy(own, piece).orderBy(mark, *keys).rowsBetween(Window.unboundedPreceding, -1)
    laid = rows.withColumn(offset, F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = starts.join(aims, "o_")
    joined = laid.join(placed, (F.col(own) == F.col("o_")) & (F.col(piece) == F.col("p_")))
    middle = [F.lit(r) * F.col("z_") + F.col("b_") + F.col(offset) + F.col("size") / 2 for r in range(MOST)]
    slope = F.element_at(F.array(*map(F.lit, SLOPES)), ((F.col("r_") - 1) % len(SLOPES) + 1).cast("int"))
    spots = F.array(*[F.when((F.col("size") > 0) & (m < F.col("t_")), position(m, F.col("t_"), slope)) for m in middle])
    out = joined.withColumn("positions", F.array_compact(spots)).withColumn("copies", F.size("positions"))
    out = out.withColumn("taken", F.col("size") * F.col("copies")).withColumn("source_size", F.col("z_")).withColumn("target", F.col("t_"))
    return out.drop(own, piece, mark, offset, "o_", "p_", "b_", "z_", "r_", "t_")


def laid(planned: DataFrame) -> DataFrame:
    """The training order: a row for each copy of :func:`plan`, range-sorted by its position ``where``."""
    copies = planned.withColumn("where", F.explode("positions"))
    return copies.repartitionByRange("where", "doc_id").sortWithinPartitions("where", "doc_id")


def digest(docs: DataFrame) -> DataFrame:
    """What the training order takes of each document; see :func:`plan`.

    The order is laid out and written, without the texts; a document's words and
    ``position``, that of its first copy, are read off it.
    """
    rows = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("text_md5"))
    planned = checkpointed(plan(checkpointed(rows.withColumn("row", F.monotonically_increasing_id())), ["text_md5"]).select("row", "doc_id", "size", "source_size", "target", "positions"))
    order = checkpointed(laid(planned.select("row", "doc_id", "size", "positions")).select("row", "size", "where"))
    found = order.groupBy("row").agg(F.sum("size").alias("taken"), F.min("where").alias("first"))
    return planned.join(found, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.round("first", 9).alias("position"))


def mixed(docs: DataFrame) -> DataFrame:
    """The training order with the columns of ``docs``: each copy that the mix takes."""
    kept = docs.columns
    own = {c: f"own_{i}" if c not in ("doc_id", "source", "text") else c for i, c in enumerate(kept)}
    safe = docs.select(*[F.col(f"`{c}`").alias(own[c]) for c in kept])
    safe = safe.withColumns({"size": n_words(F.col("text")), "text_md5": F.md5(F.coalesce("text", F.lit("")))})
    return laid(plan(safe, ["text_md5"])).select(*[F.col(own[c]).alias(c) for c in kept])
