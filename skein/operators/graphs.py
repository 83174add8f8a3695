"""Connected components of an edge table, distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import broadcast_if_small, checkpointed, release

#: Rounds after which a graph that still changes is reported; each at least doubles the reach.
MOST_ROUNDS = 60


#: Edges that are reduced to stars at once.
STARRED = 1 << 20


def starred(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as those between ``one`` and ``two``: of each node but the least of its component, to that."""
    ids, at = np.unique(np.concatenate([one, two]), return_inverse=True)
    a, b = np.split(at, 2)
    label, old = np.arange(len(ids)), None
    while old is None or (label != old).any():
        old = label.copy()
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        label = label[label]
    own = np.flatnonzero(label != np.arange(len(ids)))
    return ids[own], ids[label[own]]


def stars(edges: DataFrame) -> DataFrame:
    """(a, b) edges of the same components: of ``STARRED`` edges each node keeps one, to the least node that they join it to."""

    def reduced(have: list[pd.DataFrame]) -> pd.DataFrame:
        a, b = starred(*(np.concatenate([part[c].to_numpy() for part in have]) for c in "ab"))
        return pd.DataFrame({"a": a, "b": b})

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        have, size = [], 0
        for part in parts:
            have.append(part)
            size += len(part)
            if size >= STARRED:
                yield reduced(have)
                have, size = [], 0
        if have:
            yield reduced(have)

    return edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInPandas(each, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for each node of the (a, b) edges; label is the least node of its component.

    Each round gives a node the least label among its own, its neighbours' and
    that of its label (pointer jumping).  Labels only fall, and the loop ends
    when no label fell.  Edges, first reduced to stars, and labels stay in
    tables; labels are broadcast in rounds in which their table is small.  A
    round's table is deleted when the next one is written.
    """
    edges = checkpointed(stars(edges))
    one, two = edges.select(F.col("a").alias("node"), F.col("b").alias("next")), edges.select(F.col("b").alias("node"), F.col("a").alias("next"))
    both = checkpointed(one.union(two).where("node <> next"))
    labels = checkpointed(both.groupBy("node").agg(F.min("next").alias("m")).select("node", F.least("node", "m").alias("label")))
    for _ in range(MOST_ROUNDS):
        known = broadcast_if_small(labels).select("node", "label")
        near = both.join(known.withColumnRenamed("node", "next"), "next").select("node", "label", F.lit(None).cast("long").alias("old"))
        least = labels.select("node", "label", F.col("label").alias("old")).union(near).groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        roots = known.select(F.col("node").alias("r"), F.col("label").alias("l2"))
        jumped = least.join(roots, F.col("label") == F.col("r"), "left").select("node", "old", F.least("label", F.coalesce("l2", "label")).alias("label"))
        fallen = checkpointed(jumped)
        release(labels)
        if fallen.where("label < old").isEmpty():
            release(both)
            out = fallen.select("node", "label")
            out.checkpoint_file, out.checkpoint_bytes = fallen.checkpoint_file, fallen.checkpoint_bytes
            return out
        labels = fallen
    raise RuntimeError(f"labels still fall after {MOST_ROUNDS} rounds")
