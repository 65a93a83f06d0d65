"""Connected components: contraction inside partitions, alternating with large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.session import cut, discard

#: Edges that one task contracts to the end: two ids each, so some 16 MB. More go through rounds.
ONE_TASK = 1_000_000

#: Edges that are contracted at once: some 50 MB with what that takes.
AT_ONCE = 1 << 19


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes that the edges (u, v) name, and the least node of each one's component among these edges."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    up = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, high, low)
        while not np.array_equal(up, up[up]):
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[up]


def stars_of(batches: Iterable[pa.RecordBatch], most: int | None = None) -> tuple[np.ndarray, np.ndarray] | None:
    """All edges of the ``batches`` (two columns of ids) as stars: nodes with the least one of their component, where that is another.

    Edges are contracted ``most`` at a time, or as many as there are stars so far if these are more, so what is held follows the nodes, not the edges.
    """
    most = most or AT_ONCE
    stars, held, n = None, [], 0

    def contract() -> None:
        nonlocal stars, held, n
        ends = [np.concatenate([*([] if stars is None else [stars[i]]), *(b.column(i).to_numpy(zero_copy_only=False) for b in held)]) for i in (0, 1)]
        nodes, root = roots_of(*ends)
        apart = nodes != root
        stars, held, n = (nodes[apart], root[apart]), [], 0

    for whole in batches:
        for start in range(0, len(whole), most):
            held.append(whole.slice(start, most))
            n += len(held[-1])
            if n >= max(most, 0 if stars is None else len(stars[0])):
                contract()
    if held:
        contract()
    return stars


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges of each partition as stars (u, v): every node with the least one of its component there. The nodes of a partition, one scan or
    shuffle split, fit a task."""
    kinds = dict(edges.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = None

        def seen() -> Iterator[pa.RecordBatch]:
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field(0).type
                yield batch

        stars = stars_of(seen())
        if stars is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x in stars], ["u", "v"])

    return edges.select("u", "v").mapInArrow(run, f"u {kinds['u']}, v {kinds['u']}")


def _least(pairs: DataFrame) -> DataFrame:
    """Of undirected ``pairs`` (u, v): each node u with the least of itself and its neighbours. Partial aggregates, so a hub is no hot key."""
    return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` (its least node) of every node that ``edges`` name; direction and repetition of edges don't matter.

    Edges with a null end are ignored, a self-loop makes its node a component of its own, an empty table gives no rows. Every partition of
    edges is contracted to stars first, without a shuffle. Up to ``ONE_TASK`` edges are then one task's work; else each round is a few joins
    on the remaining star edges, written to the shared folder, so lineage stays short and a lost executor costs one round.
    """
    named = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    named = cut(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "edges")
    nodes = named.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    stars = cut(_contracted(named.filter("u <> v")), "edges")
    before = None
    for _ in range(max_rounds):
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now[0] <= ONE_TASK:
            old, stars = stars, cut(_contracted(stars.coalesce(1)), "edges")
            discard(old)
            break
        if now == before:
            break
        before = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both).hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.join(_least(large).hint("merge"), "u")
        hooked = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, stars = stars, cut(hooked.union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct(), "edges")
        discard(old)
    else:
        raise RuntimeError("the components did not settle")
    # Stars are as many as nodes, in a file of a few bytes each, which Spark would send through the driver: a merge, never a broadcast.
    named_stars = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).hint("merge")
    return nodes.join(named_stars, "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )
