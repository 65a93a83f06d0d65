"""Most similar vectors for every vector, by multi-index hashing.

Rotations learned on a bounded sample give each vector a binary code of ``tables`` substrings; each substring is one index, and a vector
is stored under all of them. Two codes that differ in fewer than ``tables`` bits agree in at least one substring (pigeonhole), so looking
the substrings up retrieves every code within a Hamming radius of ``tables`` - 1; what meets is reranked with the float vectors, exactly.
Positions use the cell numbers of rotated coordinates as their code and probe the values within half the radius: no pair is missed.

Of vectors that are bit for bit alike, only the k + 1 least ids of an Arrow batch (of a content with very many copies: of the table) enter
the index: others can't be anyone's k best, and their own best are those of the last one kept. Buckets too large by exact counts are
divided by further bits (``codes.BucketIndex``).
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.llm import codes as C
from fieldmill.operators.knn import knn_join
from fieldmill.session import cut

_INDEX = "key bigint, id bigint, v binary, rep bigint"
_NAMES = ["key", "id", "v", "rep"]
_FOUND = "a bigint, b bigint, cost int"
_TYPES = [pa.int64(), pa.int64(), pa.int32()]


def _without_copies(ids: np.ndarray, content: np.ndarray, raw: np.ndarray, k: int, heavy: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places kept for the index; places of the copies beyond k + 1; for each of these the kept id whose neighbours are also its own.

    ``content``: digests of the rows of ``raw``. ``heavy``: contents with very many copies (sorted) and the k + 1 ids kept of each.
    """
    order = np.lexsort((ids, content))
    new = np.append(True, (content[order][1:] != content[order][:-1]) | (raw[order][1:] != raw[order][:-1]).any(axis=1)) if len(raw) else np.zeros(0, bool)
    fresh = new | np.append(True, ids[order][1:] != ids[order][:-1]) if len(raw) else new
    order, new = order[fresh], new[fresh]
    start = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(start, np.diff(np.append(start, len(order))))
    head = np.repeat(start, np.diff(np.append(start, len(order))))
    rest = rank > k
    rep = ids[order[np.minimum(head + k, len(order) - 1)]] if len(order) else ids
    if heavy is not None and len(heavy[0]):
        hit, at = C.find(content[order], heavy[0])
        rest[hit] = ~(heavy[1][at] == ids[order[hit]][:, None]).any(axis=1)
        rep = rep.copy()
        rep[hit] = heavy[1][at, k]
    return order[~rest], order[rest], rep[rest]


class Reader:
    """Ids, values and copies of a batch (id, vector[, group]); ``heavy`` is filled by ``look``, once there are hot buckets."""

    def __init__(self, usable, k: int, places: int = 1, group: int | None = None):
        self.usable, self.k, self.at, self.group = usable, k, places, group
        self.heavy: tuple[np.ndarray, np.ndarray] | None = None

    def _content(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        at, values = self.usable(batch.column(self.at))
        ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
        group = batch.column(self.group).to_numpy(zero_copy_only=False)[at] if self.group is not None else None
        raw = np.ascontiguousarray(values).view(np.int32).reshape(len(values), -1)
        if group is not None:
            raw = np.concatenate([raw, np.ascontiguousarray(group, dtype=np.int64).view(np.int32).reshape(len(group), -1)], axis=1)
        return ids, values, group, raw, C.content_of(raw)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """ids, values, group, kept, rest, rep."""
        ids, values, group, raw, content = self._content(batch)
        return ids, values, group, *_without_copies(ids, content, raw, self.k, self.heavy)

    def look(self, df: DataFrame, least: int) -> None:
        def contents(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
            found = self._content(batch)
            return found[0], found[4]

        self.heavy = C.heavy_contents(df, contents, self.k + 1, least)


def _index_batch(ids: np.ndarray, values: np.ndarray, kept: np.ndarray, rest: np.ndarray, rep: np.ndarray, rows: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(keys, kind="stable")
    at = kept[rows[order]]
    body = pa.RecordBatch.from_arrays([pa.array(keys[order]), pa.array(ids[at]), C.binary_rows(values[at]), pa.nulls(len(at), pa.int64())], _NAMES)
    if not len(rest):
        return body
    tail = pa.RecordBatch.from_arrays([pa.array(C.mix(ids[rest])), pa.array(ids[rest]), pa.nulls(len(rest), pa.binary()), pa.array(rep)], _NAMES)
    return pa.Table.from_batches([body, tail]).combine_chunks().to_batches()[0]


def _best(cost: np.ndarray, limit: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (row, column) within ``limit`` that may be among a row's k least costs; ``cost`` is approximate, in units of 1e-6."""
    n = cost.shape[1]
    bound = np.full(len(cost), limit + 4.0, dtype=cost.dtype)
    if n > k + 1:
        bound = np.minimum(bound, np.partition(cost, k - 1, axis=1)[:, k - 1] + 4)
    return np.nonzero(cost <= bound[:, None])


def _ranked(a: np.ndarray, b: np.ndarray, cost: np.ndarray, ids: np.ndarray, limit: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    good = cost <= limit
    a, b, cost = a[good], b[good], cost[good]
    order = np.lexsort((ids[b], cost, a))
    a, b, cost = a[order], b[order], cost[order]
    start = np.flatnonzero(np.append(True, a[1:] != a[:-1])) if len(a) else np.zeros(0, int)
    rank = np.arange(len(a)) - np.repeat(start, np.diff(np.append(start, len(a))))
    keep = rank < k
    return a[keep], b[keep], cost[keep]


def _finish(found: DataFrame, k: int) -> DataFrame:
    """The k best of each row over all buckets, copies given the neighbours of their kept one: a, b, cost."""
    found = cut(found, "found")
    tasks = C.task_count(found, found.count(), 40)
    best = found.filter("cost is not null").repartition(tasks, "a").groupBy("a").agg(
        F.slice(F.array_sort(F.collect_set(F.struct("cost", "b"))), 1, k).alias("best")
    )
    copies = found.filter("cost is null").groupBy("a").agg(F.min("b").alias("rep"))
    lists = best.union(copies.join(best.select(F.col("a").alias("rep"), "best"), "rep").select("a", "best"))
    return lists.select("a", F.explode("best").alias("x")).select("a", F.col("x.b").alias("b"), F.col("x.cost").alias("cost"))


def cosine_neighbours(
    df: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, min_sim: float = 0.96, tables: int = 4,
    bucket_rows: int = 256, sample_rows: int = 20_000, hot_rows: int = 16_384,
) -> DataFrame:
    """``a``, ``b``, ``similarity``: for every usable vector its ``k`` best others of at least ``min_sim`` (cosine in double, rounded to 6
    decimals; ties: smaller id first), with a small loss.

    Usable are ``dim`` finite numbers, not all zero; others, and rows with a null id, have no neighbours and are nobody's. Rows repeated
    under an id count once. An empty table gives no rows. A pair is compared if its codes, of ``tables`` times log2(rows / ``bucket_rows``)
    bits, differ in fewer than ``tables`` of them (or in more, all outside one substring). ``sample_rows`` bounds the rows that the
    rotations are learned on. Buckets above ``hot_rows`` are divided.
    """
    total = df.count()
    rows = C.usable_vectors(C.fixed_sample(df, id_col, sample_rows, total, vec_col).column(0).combine_chunks(), dim)[1]
    sample = C.unit(rows) if len(rows) else rows.astype(np.float64)
    bits = int(np.clip(round(np.log2(max(total, 1) / bucket_rows)), 1, dim))
    each = min(tables, max(1, dim // bits))  # substrings that one rotation gives
    turns = [C.learn_rotation(sample, bits * min(each, tables - t), seed=7 + t) for t in range(0, tables, each)]
    limit = -int(round(min_sim * 1e6))

    def substrings(u: np.ndarray) -> list[np.ndarray]:
        y = np.concatenate([t.project(u) for t in turns], axis=1)
        return [C.mix(t, C.codes_of(y[:, t * bits : (t + 1) * bits])) for t in range(tables)]

    def base(u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.tile(np.arange(len(u)), tables), np.concatenate(substrings(u))

    reader = Reader(lambda column: C.usable_vectors(column, dim), k)
    index = C.BucketIndex(base, tables, 0.0, bucket_rows)

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        ids, values, _, kept, _, _ = reader.read(batch)
        return ids[kept], C.unit(values[kept]) if len(kept) else np.zeros((0, dim))

    source = df.select(F.col(id_col).cast("bigint").alias("id"), vec_col).filter("id is not null")
    index.refine(source, points, dim, hot_rows, lambda: reader.look(source, hot_rows // 4))

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, _, kept, rest, rep = reader.read(batch)
            if len(ids):
                r, keys = index.places(C.unit(values[kept]) if len(kept) else np.zeros((0, dim)), ids[kept])
                yield _index_batch(ids, values, kept, rest, rep, r, keys)

    def kernel(key: int, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        u = C.unit(values)
        small = u.astype(np.float32)
        own = substrings(u)
        here = [t for t in range(tables) if (own[t] == key).all()]
        earlier = own[: here[0]] if here else []
        step = max(1, 4_000_000 // len(ids))
        for s in range(0, len(ids), step):
            cost = (small[s : s + step] @ small.T) * np.float32(-1e6)
            cost[np.arange(len(cost)), np.arange(s, s + len(cost))] = 1e9
            i, j = _best(cost, limit, k)
            i = i + s
            a, b, c = _ranked(i, j, np.rint(np.einsum("ij,ij->i", u[i], u[j]) * -1e6).astype(np.int64), ids, limit, k)
            seen = np.zeros(len(a), bool)  # a pair is reported in the first index in which its substrings agree
            for x in earlier:
                seen |= x[a] == x[b]
            yield ids[a[~seen]], ids[b[~seen]], c[~seen]

    built = source.mapInArrow(build, _INDEX)
    found = C.by_bucket(built, kernel, "<f4", dim, ["a", "b", "cost"], _TYPES, _FOUND, C.task_count(df, tables * total, 4 * dim + 24))
    return _finish(found, k).select("a", "b", (F.col("cost") / F.lit(-1e6)).alias("similarity"))


def position_neighbours(
    df: DataFrame, id_col: str, group_col: str, axes: list[str], k: int = 5, radius: float = 0.12, cells: float = 4.0,
    sample_rows: int = 20_000, hot_rows: int = 16_384,
) -> DataFrame:
    """``a``, ``b``, ``distance``: for every usable position its ``k`` nearest others of its group within ``radius`` (Euclidean, in
    double, rounded to 6 decimals; ties: smaller id first); none is missed.

    Usable are finite numbers on all axes; others, and rows whose id or group is null, have no neighbours. Rows repeated under an id
    count once. The code of a position is that of its cell (``cells`` radii wide, one where the rows are dense) on each rotated axis, and
    the probes are all cells within half a radius. Cells of one radius with more than ``hot_rows`` rows are left to the adaptive exact join.
    """
    total = df.count()
    dim = len(axes)
    vector = F.array(*(F.col(c).cast("float") for c in axes)).alias("v")
    narrow = df.select(F.col(id_col).cast("bigint").alias("id"), vector, F.col(group_col).cast("bigint").alias("g")).filter("id is not null and g is not null")
    sample = C.usable_vectors(C.fixed_sample(narrow, "id", sample_rows, total, "v").column(0).combine_chunks(), dim, nonzero=False)[1]
    rotation = C.learn_rotation(sample.astype(np.float64), dim, quantise=False)
    limit = int(round(radius * 1e6))

    def usable(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        at, values = C.usable_vectors(column, dim, nonzero=False)
        return at, values + np.float32(0)  # no negative zero

    reader = Reader(usable, k, group=2)
    index = C.GridIndex(cells)

    def scaled(values: np.ndarray) -> np.ndarray:
        return rotation.project(values.astype(np.float64)) / radius

    def points(batch: pa.RecordBatch) -> tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]:
        ids, values, group, kept, _, _ = reader.read(batch)
        return ids[kept], (scaled(values[kept]), group[kept])

    index.refine(narrow, points, hot_rows, lambda: reader.look(narrow, hot_rows // 4), apart=True)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, group, kept, rest, rep = reader.read(batch)
            if len(ids):
                rows, keys = index.places((scaled(values[kept]), group[kept]), ids[kept])
                sparse = ~C.find(keys, index.dense)[0]
                yield _index_batch(ids, values, kept, rest, rep, rows[sparse], keys[sparse])

    def crowded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, group, kept, _, _ = reader.read(batch)
            rows, keys = index.places((scaled(values[kept]), group[kept]))
            hit = C.find(keys, index.dense)[0]
            at = kept[rows[hit]]
            xyz = [pa.array(values[at, i].astype(np.float64)) for i in range(dim)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[hit]), pa.array(ids[at]), *xyz], ["cell", "id", *(f"x{i}" for i in range(dim))])

    def kernel(key: int, ids: np.ndarray, values: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        x = values.astype(np.float64)
        near = x - x.mean(axis=0)
        size = (near * near).sum(axis=1)
        step = max(1, 4_000_000 // len(ids))
        for s in range(0, len(ids), step):
            square = size[s : s + step, None] + size - 2 * (near[s : s + step] @ near.T)
            cost = np.sqrt(np.maximum(square, 0)) * 1e6
            cost[np.arange(len(cost)), np.arange(s, s + len(cost))] = 1e12
            i, j = _best(cost, limit, k)
            i = i + s
            a, b, c = _ranked(i, j, np.rint(np.sqrt(((x[i] - x[j]) ** 2).sum(axis=1)) * 1e6).astype(np.int64), ids, limit, k)
            yield ids[a], ids[b], c

    built = narrow.mapInArrow(build, _INDEX)
    found = C.by_bucket(built, kernel, "<f4", dim, ["a", "b", "cost"], _TYPES, _FOUND, C.task_count(df, 2 * total, 4 * dim + 24))
    if len(index.dense):
        # Cells that stay crowded at the reach of the search: their points' neighbours are far nearer, which the adaptive join makes use of.
        rows = narrow.mapInArrow(crowded, ", ".join(["cell bigint, id bigint", *(f"x{i} double" for i in range(dim))]))
        rows = cut(rows.dropDuplicates(["cell", "id"]).withColumn("point", F.struct("cell", "id")), "crowded")
        near = knn_join(rows, rows, k + 8, "point", [f"x{i}" for i in range(dim)], "cell")  # more than k, as costs are rounded
        cost = F.rint(F.col("dist") * 1e6).cast("int").alias("cost")
        found = found.union(near.select(F.col("src.id").alias("a"), F.col("dst.id").alias("b"), cost).filter(F.col("cost") <= limit))
    return _finish(found, k).select("a", "b", (F.col("cost") / F.lit(1e6)).alias("distance"))


def neighbour_recall(df: DataFrame, found: DataFrame, id_col: str, vec_col: str, dim: int, k: int = 5, min_sim: float = 0.96, every: int = 100) -> DataFrame:
    """One row: how many of the true ``k`` best partners, found by comparing every row whose id is divisible by ``every`` with all rows,
    ``found`` (a, b) has: queries, pairs, hits, recall (1 without pairs).

    The queries are the stated query set; they are broadcast in blocks of a documented size, each a scan of the table.
    """
    usable = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).filter("id is not null")
    asked = cut(usable.filter(F.col("id") % every == 0).dropDuplicates(["id"]), "queries")
    pieces = max(1, -(-asked.count() // 16_384))
    parts = []
    for piece in range(pieces):
        table = asked.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(pieces)) == piece).toArrow()
        at, values = C.usable_vectors(table.column(1).combine_chunks(), dim)
        ask, q = table.column(0).to_numpy()[at], C.unit(values) if len(at) else np.zeros((0, dim))

        def run(batches: Iterable[pa.RecordBatch], ask=ask, q=q) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at, values = C.usable_vectors(batch.column(1), dim)
                ids = batch.column(0).to_numpy(zero_copy_only=False)[at]
                u = C.unit(values) if len(at) else np.zeros((0, dim))
                for s in range(0, len(ids), 1024):
                    sim = np.rint((u[s : s + 1024] @ q.T) * 1e6)
                    i, j = np.nonzero(sim >= round(min_sim * 1e6))
                    other = ids[s + i] != ask[j]
                    i, j = i[other], j[other]
                    yield pa.RecordBatch.from_arrays([pa.array(ask[j]), pa.array(ids[s + i]), pa.array(-sim[i, j].astype(np.int32))], ["a", "b", "cost"])

        parts.append(usable.mapInArrow(run, _FOUND))
    pairs = parts[0]
    for part in parts[1:]:
        pairs = pairs.union(part)
    best = pairs.distinct().groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("cost", "b"))), 1, k).alias("x")).select("a", F.explode("x.b").alias("b"))
    hit = best.join(found.select("a", "b", F.lit(1).alias("hit")).distinct(), ["a", "b"], "left")
    total = hit.agg(F.count_distinct("a").alias("queries"), F.count("*").alias("pairs"), F.coalesce(F.sum("hit"), F.lit(0)).alias("hits"))
    return total.select("queries", "pairs", "hits", F.when(F.col("pairs") > 0, F.col("hits") / F.col("pairs")).otherwise(1.0).alias("recall"))


def as_pairs(neighbours: DataFrame, rows: int = 0, k: int = 5) -> DataFrame:
    """Unordered pairs gid_a < gid_b in which one is among the other's best. ``rows``: of the searched table, for the number of tasks."""
    pairs = neighbours.select(F.least("a", "b").alias("gid_a"), F.greatest("a", "b").alias("gid_b"))
    return pairs.repartition(C.task_count(neighbours, rows * k, 24), "gid_a").distinct()
