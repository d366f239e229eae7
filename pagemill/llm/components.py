"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node that the edges (a, b) join them to."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch's edges as stars around the smallest node."""
    for batch in batches:
        if batch.num_rows:
            both = np.concatenate([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            ids, code = np.unique(both, return_inverse=True)
            label = roots(code[: batch.num_rows], code[batch.num_rows :], len(ids))
            far = np.flatnonzero(label != np.arange(len(ids)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(ids[label[far]])], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a long, b long), which are read once; root is the smallest
    node of its component.  The result is a table of `written`.

    Large-star and small-star rounds: each hangs every node's larger, then
    smaller, neighbours on the smallest one, until all edges form stars.  The
    number of rounds grows with the logarithm of a component's diameter.
    """
    stars = edges.select("a", "b").where("a <> b").mapInArrow(_forest, "u long, v long").distinct()
    now = written(stars, "edges")
    while True:
        # large star: both directions, the larger neighbours of u go to the smallest of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        former, now = now, written(small.where("u <> v").distinct(), "edges")
        forget(former)
        # done when all edges are stars: every node hangs on one root at most, and no root hangs on another
        ends = now.select(F.col("u").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(now.select(F.col("v").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
        loose = ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 OR (below = 1 AND above = 1)")
        if loose.isEmpty():
            break
    found = written(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
    forget(now)
    return found
