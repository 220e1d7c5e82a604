"""Connected components: forests of bounded tasks, then alternating stars as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  for pa.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, spread_join, store

#: Edges of which a task makes one forest, at most; each is two longs or two names of 16 bytes.
LOCAL = 1 << 16


def spanning_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest member of each node's component, of ``n`` nodes by number."""
    root = np.arange(n)
    while True:
        least = root.copy()
        np.minimum.at(least, left, root[right])
        np.minimum.at(least, right, root[left])
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _forests(edges: DataFrame, n: int, local: int) -> DataFrame:
    """Edges from each node to the smallest of its component, among some ``local`` edges of a task at a time."""

    def forest(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        ends = [pa.concat_arrays([b.column(c) for b in held]) for c in ("a", "b")]
        names = pa.compute.unique(pa.concat_arrays(ends))
        names = names.take(pa.compute.sort_indices(names))
        left, right = (pa.compute.index_in(e, names).to_numpy() for e in ends)
        root = spanning_roots(len(names), left, right)
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.RecordBatch.from_arrays([names.take(pa.array(moved)), names.take(pa.array(root[moved]))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [], 0
        for whole in batches:
            for begin in range(0, whole.num_rows, local):
                batch = whole.slice(begin, local)
                if held and count + batch.num_rows > local:
                    yield forest(held)
                    held, count = [], 0
                held.append(batch)
                count += batch.num_rows
        if held:
            yield forest(held)

    edges = edges.select("a", "b")
    return edges.coalesce(max(1, -(-n // local))).mapInArrow(run, edges.schema)


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to itself."""
    near = _both_ways(edges)
    least = near.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.min("a")).alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = spread_join(near.where("b > a"), "a", least, "u", "degree", 2 * n)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    least = down.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("degree"))
    moved = spread_join(down, "a", least, "u", "degree", n)
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 64, local: int = LOCAL) -> DataFrame:
    """(node, root) of every node of ``edges(a, b)``; the root is the smallest node.

    Tasks first make forests of at most ``local`` edges each; one that has all
    edges is the answer.  Of others, stars move edges between tasks: each
    round is written to the shared folder in place of the one before; rounds
    end when the edges no longer change, which takes about the logarithm of
    the longest path, or fit into one forest.  Hubs are joined by broadcast,
    at most a thousand of them, so no task holds a star's neighbours.
    """

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    spark = edges.sparkSession
    edges = edges.where("a <> b")
    n = edges.count()
    now, path = store(_forests(edges, n, local), "components")
    before, settled = state(now), n <= local
    for _ in range(most_rounds):
        if settled:
            break
        last = before[0] <= local
        new, new_path = store(_forests(now, before[0], local) if last else _small_star(_large_star(now, before[0]), before[0]), "components")
        after = state(new)
        discard(spark, path)
        now, path, before, settled = new, new_path, after, last or after == before
    if not settled:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
