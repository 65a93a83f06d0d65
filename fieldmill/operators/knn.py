"""Exact nearest neighbours of positions: blocks of space cut at medians of a sample, each searched on its own, then those that a query's ball reaches into."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.session import cut, discard, partitions

#: A block, a part of a group's space that one call searches, holds about four times as many references.
FEW = 4096


def squared(a: list[str], b: list[str]) -> Column:
    gaps = [F.col(x) - F.col(y) for x, y in zip(a, b)]
    return sum((g * g for g in gaps[1:]), gaps[0] * gaps[0])


def _cell_keys(group: np.ndarray, x: np.ndarray, level: int) -> np.ndarray:
    """A 64-bit key of each point's group and cell of width 2 ** ``level``."""
    key = group.astype(np.int64).view(np.uint64)
    for column in np.floor(x / 2.0**level).astype(np.int64).view(np.uint64).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key = key ^ (key >> np.uint64(29))
    return key


def _sample(right: DataFrame, q: list[str], rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed group and position of a bounded sample of references, by a hash of their id, and how many references there are."""
    total = right.count()
    share = min(1 << 20, int(1.05 * rows / max(total, 1) * (1 << 20)) + 1)
    table = right.filter(F.pmod(F.xxhash64("dst"), F.lit(1 << 20)) < share).select(F.xxhash64("grp").alias("g"), *q).limit(rows).toArrow()
    return table.column("g").to_numpy(), np.stack([table.column(c).to_numpy() for c in q], axis=1), total


def _with_levels(left: DataFrame, right: DataFrame, p: list[str], q: list[str], extent: float, k: int, rows: int = 20_000) -> DataFrame:
    """``left`` with ``lev``: cells of width 2 ** lev around a query should hold about k / 2 references, by the density of a bounded sample of
    hashed ids around it. So dense places get narrow cells and sparse ones wide, and points far away change nothing elsewhere."""
    group, data, total = _sample(right, q, rows)
    dim = len(q)
    top = int(np.ceil(np.log2(max(extent, 1e-9))))
    wanted = max(1.0, k / 2) / max(1.0, total / max(len(data), 1))  # sampled points in a cell that holds about k / 2
    known: list[tuple[int, np.ndarray, np.ndarray]] = []
    for level in range(top, top - 50, -1):
        keys, counts = np.unique(_cell_keys(group, data, level), return_counts=True)
        enough = counts >= 4
        if not enough.any():
            break
        known.append((level, keys[enough], counts[enough]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(dim)], axis=1)
            g = batch.column(2 + dim).to_numpy(zero_copy_only=False)
            lev = np.full(len(x), float(top))
            for level, keys, counts in known:  # the finest cell with enough sampled points tells the density
                at = np.minimum(np.searchsorted(keys, mine := _cell_keys(g, x, level)), len(keys) - 1)
                hit = keys[at] == mine
                lev[hit] = level - np.log2(counts[at[hit]] / wanted) / dim
            out = np.clip(np.rint(lev), top - 50, top).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(2 + dim)), pa.array(out)], ["grp", "src", *p, "lev"])

    kinds = dict(left.dtypes)
    schema = ", ".join([f"grp {kinds['grp']}, src {kinds['src']}", *(f"{c} double" for c in p), "lev int"])
    return left.select("grp", "src", *p, F.xxhash64("grp").alias("_g")).mapInArrow(run, schema)


class Blocks:
    """Blocks of space: of each group, halves of halves at the medians of a sample, down to ``most`` sampled points. Groups of fewer are
    spread over ``spare`` further blocks by their hash. Every point of a group lies in exactly one block, and equal places in the same."""

    def __init__(self, group: np.ndarray, data: np.ndarray, most: float, spare: int):
        self.axis, self.value, self.child, self.leaves, self.spare = [], [], [], 0, spare
        order = np.argsort(group, kind="stable")
        names, starts = np.unique(group[order], return_index=True)
        parts = [(g, x) for g, x in zip(names, np.split(data[order], starts[1:])) if len(x) > most and np.ptp(x, axis=0).max() > 0]
        self.groups = np.array([g for g, _ in parts], np.int64)
        self.roots = np.array([self._halve(x, most) for _, x in parts], np.int64)
        self.axis, self.value, self.child = np.array(self.axis, np.int64), np.array(self.value), np.array(self.child, np.int64).reshape(-1, 2)

    def _halve(self, x: np.ndarray, most: float) -> int:
        node, spans = len(self.axis), np.ptp(x, axis=0)
        if len(x) <= most or not spans.max() > 0:
            for held, v in ((self.axis, -1), (self.value, 0.0), (self.child, (self.leaves, 0))):
                held.append(v)
            self.leaves += 1
            return node
        a = int(spans.argmax())
        v = np.median(x[:, a])
        v = v if v > x[:, a].min() else x[x[:, a] > v, a].min()
        self.axis.append(a)
        self.value.append(float(v))
        self.child.append((0, 0))
        self.child[node] = (self._halve(x[x[:, a] < v], most), self._halve(x[x[:, a] >= v], most))
        return node

    def _root(self, group: np.ndarray) -> np.ndarray:
        """Node of each one's group, or -1."""
        if not len(self.groups):
            return np.full(len(group), -1)
        at = np.minimum(np.searchsorted(self.groups, group), len(self.groups) - 1)
        return np.where(self.groups[at] == group, self.roots[at], -1)

    def of(self, group: np.ndarray, x: np.ndarray) -> np.ndarray:
        node = self._root(group)
        out = self.leaves + np.mod(group, self.spare)
        rows = np.flatnonzero(node >= 0)
        node = node[rows]
        while len(rows):
            leaf = self.axis[node] < 0
            out[rows[leaf]] = self.child[node[leaf], 0]
            rows, node = rows[~leaf], node[~leaf]
            node = self.child[node, (x[rows, self.axis[node]] >= self.value[node]).astype(int)]
        return out

    def reached(self, group: np.ndarray, x: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows and the blocks, other than their own, of which a part lies within the squared distance ``bound`` of them."""
        node = self._root(group)
        rows = np.flatnonzero(node >= 0)
        node, gap = node[rows], np.zeros((len(rows), x.shape[1]))
        found = []
        while len(rows):
            leaf = self.axis[node] < 0
            apart = leaf & (gap.max(axis=1) > 0)
            found.append((rows[apart], self.child[node[apart], 0]))
            rows, node, gap = rows[~leaf], node[~leaf], gap[~leaf]
            a, v = self.axis[node], self.value[node]
            side = (x[rows, a] >= v).astype(int)
            far = gap.copy()
            # A query on the cut itself is at no distance from the other half, but isn't in it.
            far[np.arange(len(rows)), a] = np.maximum(np.abs(x[rows, a] - v), np.finfo(float).tiny)
            near = (far * far).sum(axis=1) <= bound[rows] * (1 + 1e-9)
            rows, node, gap = np.concatenate([rows, rows[near]]), np.concatenate([self.child[node, side], self.child[node, 1 - side][near]]), np.concatenate([gap, far[near]])
        return tuple(np.concatenate([f[i] for f in found] or [np.zeros(0, np.int64)]) for i in (0, 1))


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of every a to every b, summed axis by axis as in ``squared``."""
    out = 0.0
    for i in range(a.shape[1]):
        gap = a[:, None, i] - b[None, :, i]
        out = out + gap * gap
    return out


def nearest(at: np.ndarray, own: np.ndarray, to: np.ndarray, code: np.ndarray, k: int, bound: np.ndarray, leaf: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``at``, rows of ``to`` and squared distances: the ``k`` nearest of each (ties: smaller row of ``to``) whose code isn't its ``own``,
    not beyond ``bound``. The references are cut into boxes of ``leaf`` (and 2 k) at most; a query meets the boxes that its nearest box leaves possible."""
    most, todo, boxes = max(leaf, 2 * (k + 1)), [np.arange(len(to))] if len(to) else [], []
    while todo:
        rows = todo.pop()
        spans = np.ptp(to[rows], axis=0)
        if len(rows) <= most or not spans.max() > 0:
            boxes.append(np.sort(rows))
        else:
            rows = rows[np.argpartition(to[rows, spans.argmax()], len(rows) // 2)]
            todo += [rows[: len(rows) // 2], rows[len(rows) // 2 :]]
    none = np.zeros(0, np.int64)
    if not boxes or not len(at):
        return none, none, np.zeros(0)
    low, high = (np.stack([f(to[rows], axis=0) for rows in boxes]) for f in (np.min, np.max))
    out = []
    step = max(1, 2_000_000 // len(boxes))
    for first in range(0, len(at), step):
        x = at[first : first + step]
        apart = 0.0
        for i in range(x.shape[1]):
            gap = np.maximum(np.maximum(low[None, :, i] - x[:, None, i], x[:, None, i] - high[None, :, i]), 0)
            apart = apart + gap * gap
        home = apart.argmin(axis=1)
        order = np.argsort(home, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            for mine in (rows[i : i + 512] for i in range(0, len(rows), 512)):
                most_far, inside = bound[first + mine].copy(), boxes[home[mine[0]]]
                if len(inside) >= k:
                    d2 = _squares(x[mine], to[inside])
                    d2[code[inside][None, :] == own[first + mine][:, None]] = np.inf
                    most_far = np.minimum(most_far, np.partition(d2, k - 1, axis=1)[:, k - 1])
                met = np.flatnonzero((apart[mine] <= most_far[:, None] * (1 + 1e-9)).any(axis=0))
                if not len(met):
                    continue
                refs = np.sort(np.concatenate([boxes[b] for b in met]))
                for part in np.array_split(np.arange(len(mine)), -(-len(mine) * len(refs) // 4_000_000)):
                    some = mine[part]
                    d2 = _squares(x[some], to[refs])
                    d2[code[refs][None, :] == own[first + some][:, None]] = np.nan
                    i, j = np.nonzero(d2 <= most_far[part][:, None])
                    d = d2[i, j]
                    best = np.lexsort((j, d, i))
                    i, j, d = i[best], j[best], d[best]
                    kept = np.arange(len(i)) - np.searchsorted(i, i) < k
                    out.append((first + some[i[kept]], refs[j[kept]], d[kept]))
    return tuple(np.concatenate([o[c] for o in out] or [none]) for c in range(3))


def _in_block(asked: pa.Table, refs: pa.Table, p: list[str], q: list[str], k: int, exclude_self: bool, bound: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Rows of ``asked`` (ascending), their nearest ``refs`` of the same group in one block, and the squared distances."""
    refs = refs.take(pc.sort_indices(refs.column("dst")))
    names = pa.chunked_array([*asked.column("grp").chunks, *refs.column("grp").chunks], asked.schema.field("grp").type).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ours, theirs = names[: len(asked)], names[len(asked) :]
    ids = refs.column("dst").combine_chunks().dictionary_encode()
    code = ids.indices.to_numpy(zero_copy_only=False)
    src = asked.column("src").combine_chunks().cast(ids.dictionary.type)
    own = pc.fill_null(pc.index_in(src, value_set=ids.dictionary), -1).to_numpy(zero_copy_only=False) if exclude_self else np.full(len(asked), -1)
    at, to = (np.stack([x.column(c).to_numpy() for c in cs], axis=1) for x, cs in ((asked, p), (refs, q)))
    order, there = np.argsort(ours, kind="stable"), np.argsort(theirs, kind="stable")  # stable: references stay in the order of their ids
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for rows in np.split(order, np.flatnonzero(np.diff(ours[order])) + 1) if len(order) else []:
        low, high = np.searchsorted(theirs[there], ours[rows[0]], "left"), np.searchsorted(theirs[there], ours[rows[0]], "right")
        these = there[low:high]
        i, j, d2 = nearest(at[rows], own[rows], to[these], code[these], k, bound[rows])
        found.append((rows[i], these[j], d2))
    i, j, d2 = (np.concatenate([f[c] for f in found]) for c in range(3))
    best = np.argsort(i, kind="stable")
    return i[best], refs.column("dst").combine_chunks().take(pa.array(j[best])), d2[best]


def knn_join(queries: DataFrame, refs: DataFrame, k: int, key: str, axes: list[str], group: str, exclude_self: bool = True) -> DataFrame:
    """``grp``, ``src``, ``dst``, ``rank``, ``dist``: the ``k`` nearest ``refs`` of each query in its group (ties: smaller id first), exactly.

    Self is excluded by id (then queries must be among the refs), so a duplicate of a point is its neighbour at distance 0. Fewer than k in a
    group: all of them. Null ids, groups or coordinates take no part; coordinates must be finite. Every query is answered in its own block
    of space first; where its k-th distance reaches into other blocks (all blocks of the group, if it has fewer than k) it is asked there
    too, for what lies within that distance, and the answers are ranked together. A query goes to few blocks, and no join is made.
    """
    spark = queries.sparkSession
    p, q = [f"p{i}" for i in range(len(axes))], [f"q{i}" for i in range(len(axes))]
    whole = " and ".join(f"{c} is not null" for c in [key, group, *axes])
    left = queries.filter(whole).select(F.col(group).alias("grp"), F.col(key).alias("src"), *(F.col(a).cast("double").alias(c) for a, c in zip(axes, p)))
    right = refs.filter(whole).select(F.col(group).alias("grp"), F.col(key).alias("dst"), *(F.col(a).cast("double").alias(c) for a, c in zip(axes, q)))
    # Of points at one place only the k + 1 smallest ids can be anyone's neighbours, so a place with very many stays a small block.
    same = F.row_number().over(Window.partitionBy("grp", *q).orderBy("dst"))
    known = cut(right.withColumn("same", same).filter(F.col("same") <= k + 1).drop("same"), "knn")
    hashed, data, total = _sample(known, q, 20_000)
    held = 4 * max(FEW, k + 1)
    # A sampled point stands for total / len(data) references; fewer than 16 of them say too little about a block.
    blocks = Blocks(hashed, data, max(16 if len(data) < total else 1, held * len(data) / max(total, 1)), max(1, total // held))
    kinds, n = dict(left.dtypes) | dict(known.dtypes), max(partitions(spark), total // 100_000)

    def placed(df: DataFrame, name: str, at: list[str]) -> DataFrame:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.stack([batch.column(2 + i).to_numpy(zero_copy_only=False) for i in range(len(at))], axis=1)
                hashes = batch.column(2 + len(at))
                block = pa.array(blocks.of(hashes.to_numpy(zero_copy_only=False), x).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*batch.columns, block], ["grp", name, *at, "g", "block"])

        schema = ", ".join([f"grp {kinds['grp']}, {name} {kinds[name]}", *(f"{c} double" for c in at), "g bigint, block bigint"])
        return df.select("grp", name, *at, F.xxhash64("grp").alias("g")).mapInArrow(run, schema)

    left, right = cut(placed(left, "src", p), "knn"), placed(known, "dst", q).drop("g")
    # Blocks that far more queries than references lie in are several tasks' work, each with all references of the block.
    heavy = {r["block"]: -(-r["n"] // (4 * held)) for r in left.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * held).collect()}
    repeated = not left.groupBy("src").agg(F.count("*").alias("n")).filter("n > 1").isEmpty()

    def apart(df: DataFrame) -> DataFrame:
        return df.repartition(n, "block", "part").groupBy("block", "part")  # so many tasks: little data, much work

    def spread(df: DataFrame, shares: dict[int, int], name: str | None) -> DataFrame:
        if not shares:
            return df.withColumn("part", F.lit(0))
        times = F.coalesce(F.create_map(*(F.lit(v) for pair in shares.items() for v in pair))[F.col("block")], F.lit(1))
        return df.withColumn("part", F.pmod(F.xxhash64(name), times).cast("int") if name else F.explode(F.sequence(F.lit(0), times - 1)))

    shape = ", ".join([f"grp {kinds['grp']}, src {kinds['src']}, dst {kinds['dst']}, d2 double, rank bigint, open boolean", *(f"{c} double" for c in p), "block bigint"])

    def own_block(asked: pa.Table, there: pa.Table) -> pa.Table:
        i, dst, d2 = _in_block(asked, there, p, q, k, exclude_self, np.full(len(asked), np.inf))
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        bound = np.full(len(asked), np.inf)
        bound[i[rank == k]] = d2[rank == k]
        x = np.stack([asked.column(c).to_numpy() for c in p], axis=1)
        rows, block = blocks.reached(asked.column("g").to_numpy(), x, bound)
        going = np.full(len(asked), repeated)
        going[rows] = True
        take, on = pa.array(np.concatenate([i, rows])), len(i)
        names, src = (asked.column(c).take(take).combine_chunks() for c in ("grp", "src"))
        blank = np.arange(len(take)) < on  # found neighbours come first, then the blocks still to be asked, with the bound
        columns = [names, src, pa.concat_arrays([dst, pa.nulls(len(rows), dst.type)]), pa.array(np.concatenate([d2, bound[rows]])), pa.array(np.concatenate([rank, np.zeros(len(rows), np.int64)]))]
        columns += [pa.array(going[np.concatenate([i, rows])]), *(pa.array(x[np.concatenate([i, rows]), c], mask=blank) for c in range(len(p)))]
        columns.append(pa.array(np.concatenate([np.zeros(on, np.int64), block]), mask=blank))
        return pa.table(columns, names=["grp", "src", "dst", "d2", "rank", "open", *p, "block"])

    first = cut(apart(spread(left, heavy, "src")).cogroup(apart(spread(right, heavy, None))).applyInArrow(own_block, shape), "knn")
    discard(left)

    def other_block(asked: pa.Table, there: pa.Table) -> pa.Table:
        i, dst, d2 = _in_block(asked, there, p, q, k, exclude_self, asked.column("d2").to_numpy())
        take = pa.array(i)
        return pa.table([*(asked.column(c).take(take).combine_chunks() for c in ("grp", "src")), dst, pa.array(d2)], names=["grp", "src", "dst", "d2"])

    asks = first.filter("rank = 0").select("grp", "src", "d2", *p, "block")
    much = {r["block"]: -(-r["n"] // (4 * held)) for r in asks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > 4 * held).collect()}
    more = apart(spread(asks, much, "src")).cogroup(apart(spread(right, much, None))).applyInArrow(other_block, f"grp {kinds['grp']}, src {kinds['src']}, dst {kinds['dst']}, d2 double")
    going = first.filter("rank > 0 and open").select("grp", "src", "dst", "d2").union(more)
    ranked = going.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))).filter(F.col("rank") <= k)
    done = cut(ranked.select("grp", "src", "dst", F.col("rank").cast("bigint").alias("rank"), "d2"), "knn")
    discard(known)
    out = first.filter("rank > 0 and not open").select("grp", "src", "dst", "rank", "d2").union(done)
    return out.select("grp", "src", "dst", "rank", F.sqrt("d2").alias("dist"))


class NeighbourTables:
    """The neighbours of one set of points for several k: the widest table made so far serves every smaller k by its ranks.

    It belongs to the caller, who made it for just these points and lets go of it with ``release``; nothing is shared between queries.
    """

    def __init__(self, points: DataFrame, key: str, axes: list[str], group: str):
        self.points, self.key, self.axes, self.group = points, key, axes, group
        self.k, self.table = 0, None

    def of(self, k: int) -> DataFrame:
        if k > self.k:
            self.release()
            self.k, self.table = k, cut(knn_join(self.points, self.points, k, self.key, self.axes, self.group), "near")
        return self.table.filter(F.col("rank") <= k)

    def release(self) -> None:
        if self.table is not None:
            discard(self.table)
        self.k, self.table = 0, None


def morton(axes: list[Column], bits: int = 10) -> Column:
    """Morton code of coordinates in 0..1: their bits, interleaved, the first axis lowest."""
    top = (1 << bits) - 1
    code = F.lit(0).cast("bigint")
    for i, a in enumerate(axes):
        cell = F.least(F.greatest(F.floor(a * (1 << bits)), F.lit(0)), F.lit(top)).cast("bigint")
        for b in range(bits):
            code = code.bitwiseOR(F.shiftleft(F.shiftright(cell, b).bitwiseAND(F.lit(1)), b * len(axes) + i))
    return code


def mean_square_distance(knn: DataFrame, k: int = 3) -> DataFrame:
    """Mean squared distance of each point to its ``k`` nearest others."""
    return knn.filter(F.col("rank") <= k).groupBy("src").agg(F.avg(F.col("dist") * F.col("dist")).alias("d2"))
