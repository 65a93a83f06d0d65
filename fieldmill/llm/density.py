"""Clusters of mutually similar records: density clustering over overlapping spatial cells.

Vectors are reduced to their leading principal axes (learned on a bounded sample); cuts at sparse places of these axes make the cells, and
a vector within a margin of a cut lies in the cells on both sides. Cells too large by exact counts are divided further. Each cell is
clustered on its own, with the full vectors: points with enough similar ones are core, similar core points are one cluster, others join
the core beside them. Clusters of different cells that share a core point are the same cluster: the links between their least members
are merged as connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.llm import codes as C
from fieldmill.llm.neighbours import _INDEX, Reader, _index_batch
from fieldmill.operators.components import connected_components
from fieldmill.session import cut, partitions

_LINK = "id bigint, root bigint, core boolean"
_LINKS = [pa.int64(), pa.int64(), pa.bool_()]
_LINK_NAMES = ["id", "root", "core"]

#: Cells of the similarity matrix of a cell that are held at once.
_BLOCK = 1_000_000


def _join_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``label`` (each point's root) after the roots ``a`` and ``b`` are joined, pair by pair, under the least."""
    up = np.arange(len(label))
    while len(a):
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(up, high, low)
        while not (up == up[up]).all():
            up = up[up]
        a, b = up[a], up[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return up[label]


Pairs = tuple[np.ndarray, np.ndarray]


def local_clusters(ids: np.ndarray, similar: Callable[[int, int], Pairs], min_core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, least id of its local cluster, whether core) of the points of a cell that are in a cluster, without the roots themselves.

    ``similar(s, e)`` gives the places (i, j) of similar points with i in s..e, in the order of i; pairs are made for a block of rows at a
    time and never kept, so a cell of n points costs memory in proportion to n. Points with ``min_core`` similar ones (itself included)
    are core and join clusters; others join the core point beside them whose cluster has the least root. ``ids`` are in order.
    """
    n = len(ids)
    step = max(1, _BLOCK // n)
    whole = similar(0, n) if step >= n else None
    block = (lambda s: whole) if whole is not None else (lambda s: similar(s, min(n, s + step)))
    core = sum(np.bincount(block(s)[0], minlength=n) for s in range(0, n, step)) >= min_core
    label = np.arange(n)
    edge = np.zeros(n, bool)
    for s in range(0, n, step):
        i, j = block(s)
        if not core.all():
            edge[i[~core[i] & core[j]]] = True
            both = core[i] & core[j]
            i, j = i[both], j[both]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        who = i[start]
        while len(who):
            beside, own = label[j], label[who]
            low, high = np.minimum.reduceat(beside, start), np.maximum.reduceat(beside, start)
            less, more = low != own, high != own
            if not less.any() and not more.any():
                break
            label = _join_labels(label, np.concatenate([own[less], own[more]]), np.concatenate([low[less], high[more]]))
    joined = np.where(core, label, n)
    for s in sorted({i // step * step for i in np.flatnonzero(edge).tolist()}):
        i, j = block(s)
        beside = ~core[i] & core[j]
        np.minimum.at(joined, i[beside], label[j[beside]])
    keep = (joined < n) & (joined != np.arange(n))
    return ids[keep], ids[joined[keep]], core[keep]


def _merged(links: DataFrame, min_size: int) -> DataFrame:
    """Links (id, local root, core) to root_id, member_id, size of the clusters of at least ``min_size``. Only core points merge clusters."""
    every = cut(links.groupBy("id", "root").agg(F.max("core").alias("core")), "links")
    links = every.filter("core").select("id", "root")
    own = links.groupBy("id").agg(F.min("root").alias("root"))
    joined = links.join(own.withColumnRenamed("root", "least"), "id").filter("root <> least").select("root", "least").distinct()
    chained = own.join(every.select(F.col("root").alias("id")).distinct(), "id", "left_semi")
    merged = connected_components(joined.union(chained.select(F.col("id").alias("root"), F.col("root").alias("least"))), "root", "least")
    names = merged.select(F.col("node").alias("root"), "component")
    named = own.join(names, "root", "left").select(F.coalesce("component", "root").alias("root_id"), F.col("id").alias("member_id"))
    # Least members of local clusters that another one took in are members too, without a link of their own.
    taken = merged.select(F.col("component").alias("root_id"), F.col("node").alias("member_id"))
    cores = own.select("id").union(every.select("root")).distinct()
    border = every.filter("not core").join(cores, "id", "left_anti").join(names, "root", "left")
    border = border.groupBy("id").agg(F.min(F.coalesce("component", "root")).alias("root_id")).select("root_id", F.col("id").alias("member_id"))
    # The root of a cluster is its least member, which a border point may be.
    grouped = named.union(taken).union(border)
    least = grouped.groupBy("root_id").agg(F.least(F.min("member_id"), F.first("root_id")).alias("least"))
    both = grouped.union(grouped.select("root_id", F.col("root_id").alias("member_id"))).join(least, "root_id")
    members = cut(both.select(F.col("least").alias("root_id"), "member_id").filter("root_id <> member_id").distinct(), "members")
    sizes = members.groupBy("root_id").agg((F.count("*") + 1).alias("size")).filter(F.col("size") >= min_size)
    return members.join(sizes, "root_id")


def vector_clusters(
    df: DataFrame, id_col: str, vec_col: str, dim: int, min_sim: float = 0.96, min_size: int = 5, min_core: int = 5,
    cell_rows: int = 768, margin: float = 0.6, sample_rows: int = 20_000, hot_rows: int = 16_384,
) -> DataFrame:
    """``root_id``, ``member_id``, ``size``: each member but the root (the least id) of every density cluster of at least ``min_size``
    vectors; two are similar from a cosine of ``min_sim`` up (in double, rounded to 6 decimals).

    Usable vectors are ``dim`` finite numbers, not all zero; others and null ids are in no cluster. Rows repeated under an id count once;
    bit-identical vectors are linked without being compared in pairs. An empty table gives no rows. ``min_core`` is the number of similar
    points (itself included) that makes a core point; a point beside the cores of several clusters goes to the one of least root.
    ``margin``: the overlap on each side of a cut, as a multiple of the typical difference of a projection between vectors just
    ``min_sim`` alike. Cells above ``hot_rows`` rows are divided; those that can't be, as their rows are all alike, are laid out in blocks
    around a ball of mutually similar rows.
    """
    total = df.count()
    rows = C.usable_vectors(C.fixed_sample(df, id_col, sample_rows, total, vec_col).column(0).combine_chunks(), dim)[1]
    sample = C.unit(rows) if len(rows) else rows.astype(np.float64)
    bits = int(np.clip(round(np.log2(max(total, 1) / cell_rows)), 1, dim))
    width = margin * np.sqrt(2 * max(0.0, 1 - min_sim) / dim)
    reduction = C.learn_rotation(sample, bits, quantise=False, width=width)
    limit = round(min_sim, 6) - 5e-7

    def base(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows, code = C.both_sides(reduction.project(u), width)
        return rows, C.mix(code)

    reader = Reader(lambda column: C.usable_vectors(column, dim), min_core - 1)
    index = C.BucketIndex(base, 1, width, cell_rows)

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, values, _, kept, _, _ = reader.read(batch)
        return ids[kept], C.unit(values[kept]) if len(kept) else np.zeros((0, dim))

    source = df.select(F.col(id_col).cast("bigint").alias("id"), vec_col).filter("id is not null")
    index.refine(source, points, dim, hot_rows, lambda: reader.look(source, hot_rows // 4), least=min_sim)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, _, kept, rest, rep = reader.read(batch)
            if len(ids):
                r, keys = index.places(C.unit(values[kept]) if len(kept) else np.zeros((0, dim)), ids[kept])
                yield _index_batch(ids, values, kept, rest, rep, r, keys)

    def kernel(key: int, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        u = C.unit(values)
        small = u.astype(np.float32)

        def similar(s: int, e: int) -> Pairs:
            sim = small[s:e] @ small.T
            at = np.flatnonzero(sim.ravel() >= np.float32(limit - 1e-5))
            i, j = np.divmod(at, len(ids))
            i += s
            close = np.flatnonzero(sim.ravel()[at] < np.float32(limit + 1e-5))  # too close to call in single precision
            if len(close):
                good = np.ones(len(at), bool)
                good[close] = np.einsum("ij,ij->i", u[i[close]], u[j[close]]) >= limit
                i, j = i[good], j[good]
            return i, j

        yield local_clusters(ids, similar, min_core)

    built = source.mapInArrow(build, _INDEX)
    links = C.by_bucket(built, kernel, "<f4", dim, _LINK_NAMES, _LINKS, _LINK, C.task_count(df, 2 * total, 4 * dim + 24))
    return _merged(links.select("id", "root", F.coalesce("core", F.lit(True)).alias("core")), min_size)


class Cliques:
    """Squares, one reach wide, of crowded cells in two coordinates: whatever lies in one is mutually similar, so a square with enough points is
    one cluster of core points, by a count and a least id alone. Only its outer band (of each Arrow batch) has to be compared with others:
    a point outside is similar to as many of the band as of the square, up to the number that makes a core point."""

    def __init__(self, min_core: int):
        self.min_core = min_core
        self.keys, self.roots, self.dense = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    @staticmethod
    def _square(points: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        y, group = points
        return C.mix(group, *np.floor(y).astype(np.int64).T, 9) if len(y) else np.zeros(0, np.int64)

    def look(self, df: DataFrame, read: Callable, index: C.GridIndex) -> None:
        """Counts the squares that meet a crowded cell; the driver holds those with enough points, at most nine a crowded cell."""
        self.dense = index.dense
        dense, square = index.dense, self._square

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, points = read(batch)
                rows, keys = index.places(points)
                crowded = np.zeros(len(ids), bool)
                crowded[rows[C.find(keys, dense)[0]]] = True
                at = np.flatnonzero(crowded)
                k, back = np.unique(square(points)[at], return_inverse=True)
                low = np.full(len(k), np.iinfo(np.int64).max)
                np.minimum.at(low, back, ids[at])
                yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(np.bincount(back, minlength=len(k)), pa.int64()), pa.array(low, pa.int64())], ["k", "n", "low"])

        found = df.mapInArrow(run, "k bigint, n bigint, low bigint").groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low"))
        rows = sorted((r["k"], r["low"]) for r in found.filter(F.col("n") >= self.min_core).collect())
        self.keys, self.roots = (np.array(x, dtype=np.int64) for x in zip(*rows)) if rows else (self.keys, self.roots)

    def thinned(self, points: tuple[np.ndarray, np.ndarray], rows: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """Rows and keys without the inner points of cliques in crowded cells; then the places of all clique points there and their roots."""
        crowded = C.find(keys, self.dense)[0]
        mine = np.zeros(len(points[0]), bool)
        mine[rows[crowded]] = True
        at = np.flatnonzero(mine)
        square = self._square(points)[at]
        hit, k = C.find(square, self.keys)
        at, square = at[hit], square[hit]
        inner = np.zeros(len(points[0]), bool)
        inner[at] = True
        inner[at[C.outer_band(points[0][at], square, self.min_core)]] = False
        keep = ~(crowded & inner[rows])
        return rows[keep], keys[keep], at, self.roots[k]


def box_clusters(
    df: DataFrame, id_col: str, group_col: str, columns: list[str], reach: list[float], min_size: int = 3, min_core: int = 3,
    cells: float = 4.0, hot_rows: int = 16_384,
) -> DataFrame:
    """As ``vector_clusters`` for a few numbers within a group: two records are similar if they differ by at most ``reach`` in each column.

    Cells are ``cells`` reaches wide (two, where rows are dense) and overlap by a reach on each side, so a point's neighbours all lie in its
    cell. Of cells that stay crowded, in two columns, squares of mutually similar records are clusters without being compared in pairs; in
    cells that are crowded even so, every pair meets, but a point counts as core by its similar ones in one pair of blocks.
    Rows with a null or NaN column, id or group are in no cluster.
    """
    dim = len(columns)
    vector = F.array(*(F.col(c).cast("double") for c in columns)).alias("v")
    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), vector, F.col(group_col).cast("bigint").alias("g"))
    for c in range(dim):
        narrow = narrow.filter(F.col("v")[c].isNotNull() & ~F.isnan(F.col("v")[c]) & (F.abs(F.col("v")[c]) < float("inf")))
    narrow = narrow.filter("id is not null and g is not null")
    total = narrow.count()
    slack = np.array(reach) + 1e-9

    def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) + 0.0
        return np.arange(len(values)), values

    reader = Reader(usable, min_core - 1, group=2)
    index = C.GridIndex(cells, probe=1.0)  # so each point's neighbours are counted in full

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        ids, values, group, kept, _, _ = reader.read(batch)
        return ids[kept], (values[kept] / slack, group[kept])

    thin = Cliques(min_core) if dim == 2 else None
    index.refine(narrow, points, hot_rows, lambda: reader.look(narrow, hot_rows // 4), apart=thin is not None)
    if thin is not None and len(index.dense):
        thin.look(narrow, points, index)
        remaining = lambda p: thin.thinned(p, *index.places(p))[:2]
        index.pairs = {k: int(np.ceil(n / (hot_rows / 2))) for k, n in C.hot_buckets(narrow, points, remaining, hot_rows).items()}

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, group, kept, rest, rep = reader.read(batch)
            if len(ids):
                place = (values[kept] / slack, group[kept])
                if thin is None or not len(index.dense):
                    r, keys = index.places(place, ids[kept])
                else:
                    r, keys, at, root = thin.thinned(place, *index.places(place))
                    r, keys = C.in_blocks(r, keys, ids[kept], index.pairs)
                    own = ids[kept[at]] != root  # all of a clique are linked to its least id, in the index or not
                    rest, rep = np.concatenate([rest, kept[at[own]]]), np.concatenate([rep, root[own]])
                yield _index_batch(ids, values, kept, rest, rep, r, keys)

    def kernel(key: int, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        def similar(s: int, e: int) -> Pairs:
            good = np.ones((e - s, len(ids)), bool)
            for j in range(dim):
                good &= np.abs(values[s:e, None, j] - values[None, :, j]) <= slack[j]
            i, j = np.nonzero(good)
            return i + s, j

        yield local_clusters(ids, similar, min_core)

    built = narrow.mapInArrow(build, _INDEX)
    links = C.by_bucket(built, kernel, "<f8", dim, _LINK_NAMES, _LINKS, _LINK, C.task_count(df, 2 * total, 8 * dim + 24))
    return _merged(links.select("id", "root", F.coalesce("core", F.lit(True)).alias("core")), min_size)


def describe_clusters(clusters: DataFrame, df: DataFrame, id_col: str, vec_col: str, dim: int, typical: int = 3) -> DataFrame:
    """``root_id``, ``size``, ``typical``: the ids of the members closest to the cluster's mean direction, the medoid first."""
    spark = df.sparkSession
    everyone = clusters.select("root_id", "member_id", "size").union(clusters.select("root_id", F.col("root_id").alias("member_id"), "size").distinct())
    vectors = df.select(F.col(id_col).cast("bigint").alias("member_id"), F.col(vec_col).alias("f")).filter(F.size("f") == dim)
    joined = cut(everyone.join(vectors, "member_id").dropDuplicates(["root_id", "member_id"]), "members")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values = C.usable_vectors(batch.column(1), dim)
            if len(at):
                roots, inverse = np.unique(batch.column(0).to_numpy()[at], return_inverse=True)
                total = np.zeros((len(roots), dim))
                np.add.at(total, inverse, C.unit(values))
                yield pa.RecordBatch.from_arrays([pa.array(roots), pa.array(total.tolist(), pa.list_(pa.float64()))], ["root_id", "part"])

    parts = joined.select("root_id", "f").mapInArrow(sums, "root_id bigint, part array<double>")
    each = parts.groupBy("root_id").agg(*(F.sum(F.col("part")[d]).alias(f"c{d}") for d in range(dim)))
    centre = each.select("root_id", F.array(*(F.col(f"c{d}") for d in range(dim))).alias("centre"))
    dot = F.aggregate(F.zip_with("f", "centre", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    norm = F.sqrt(F.aggregate("f", F.lit(0.0), lambda a, b: a + b.cast("double") * b))
    scored = joined.join(centre, "root_id").select("root_id", "member_id", "size", F.round(dot / norm, 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("score"), "member_id"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= typical)
    grouped = best.groupBy("root_id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("rank", "member_id"))).alias("t"))
    return grouped.select("root_id", "size", F.col("t.member_id").alias("typical")).repartition(partitions(spark), "root_id")


def describe_boxes(clusters: DataFrame, df: DataFrame, id_col: str, group_col: str, columns: list[str], reach: list[float], typical: int = 3) -> DataFrame:
    """``describe_clusters`` for the clusters of ``box_clusters``: the members closest to the mean of the columns, each scaled by its reach.

    The sum of squared distances to all members is least at the member closest to their mean, so the first one is the medoid.
    """
    everyone = clusters.select("root_id", "member_id", "size").union(clusters.select("root_id", F.col("root_id").alias("member_id"), "size").distinct())
    scaled = [(F.col(c).cast("double") / r).alias(f"x{i}") for i, (c, r) in enumerate(zip(columns, reach))]
    known = df.select(F.col(id_col).cast("bigint").alias("member_id"), F.col(group_col).alias("grp"), *scaled)
    for i in range(len(columns)):
        known = known.filter(F.col(f"x{i}").isNotNull() & ~F.isnan(f"x{i}"))
    known = known.filter("grp is not null").drop("grp")
    joined = cut(everyone.join(known, "member_id").dropDuplicates(["root_id", "member_id"]), "members")
    means = joined.groupBy("root_id").agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(len(columns))))
    gap = sum(((F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{i}") - F.col(f"m{i}")) for i in range(len(columns))), F.lit(0.0))
    rank = F.row_number().over(Window.partitionBy("root_id").orderBy(F.round(gap, 9), "member_id"))
    best = joined.join(means, "root_id").withColumn("rank", rank).filter(F.col("rank") <= typical)
    grouped = best.groupBy("root_id").agg(F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("rank", "member_id"))).alias("t"))
    return grouped.select("root_id", "size", F.col("t.member_id").alias("typical"))
