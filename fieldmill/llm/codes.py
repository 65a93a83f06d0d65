"""Vectors in Arrow batches, learned rotated binary codes, and buckets streamed through Python workers."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmill.session import partitions


def usable_vectors(column: pa.Array, dim: int, nonzero: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Places and float32 values of the vectors with ``dim`` finite numbers (and, if asked, not all zero)."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, dim), np.float32)
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
    good = np.isfinite(values).all(axis=1)
    if nonzero:
        good &= (values != 0).any(axis=1)
    return at[good], values[good]


def unit(values: np.ndarray) -> np.ndarray:
    """Rows of length one, in double; the largest component is taken out first, so no square overflows or vanishes."""
    x = values.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


@dataclass
class Rotation:
    """``(x - mean) @ axes - cuts``: the signs are the code, the magnitudes its confidence."""

    mean: np.ndarray
    axes: np.ndarray
    cuts: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.axes - self.cuts


def learn_rotation(x: np.ndarray, bits: int, quantise: bool = True, rounds: int = 25, seed: int = 7, width: float = 0.0) -> Rotation:
    """Principal axes of a sample, turned (iterative quantisation) so that signs lose little; cuts at the medians.

    With a ``width`` a cut is moved, between the 43rd and 57th percentile, to where the fewest values lie within it.
    """
    dim = x.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(dim)
    z = x - mean
    _, vectors = np.linalg.eigh(z.T @ z if len(x) else np.eye(dim))
    axes = vectors[:, ::-1][:, :bits]
    if quantise and len(x) > bits:
        rng = np.random.default_rng(seed)
        turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
        y = z @ axes
        for _ in range(rounds):
            u, _, vt = np.linalg.svd(np.sign(y @ turn).T @ y)
            turn = (u @ vt).T
        axes = axes @ turn
    cuts = np.median(z @ axes, axis=0) if len(x) else np.zeros(bits)
    if width and len(x):
        for j, y in enumerate(np.sort(z @ axes, axis=0).T):
            places = np.quantile(y, np.linspace(0.43, 0.57, 81))
            places = places[np.argsort(np.abs(np.arange(81) - 40), kind="stable")]  # of equals the one nearest to the median
            cuts[j] = places[np.argmin(np.searchsorted(y, places + width) - np.searchsorted(y, places - width))]
    return Rotation(mean, axes, cuts)


def codes_of(y: np.ndarray) -> np.ndarray:
    return (y > 0) @ (1 << np.arange(y.shape[1], dtype=np.int64))


def both_sides(y: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and codes: each row's own code and those with the bits within ``width`` of the cut flipped in all ways."""
    rows, codes = np.arange(len(y)), codes_of(y)
    for j in range(y.shape[1]):
        near = np.abs(y[rows, j]) < width
        rows, codes = np.concatenate([rows, rows[near]]), np.concatenate([codes, codes[near] ^ (1 << j)])
    return rows, codes


def mix(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit key from several integers."""
    h = np.uint64(0x243F6A8885A308D3)
    with np.errstate(over="ignore"):
        for part in parts:
            h = (h ^ np.asarray(part).astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h = h ^ (h >> np.uint64(29))
    return np.asarray(h).view(np.int64)


def fixed_sample(df: DataFrame, id_col: str, rows: int, total: int, *columns: str) -> pa.Table:
    """About ``rows`` rows (never more), chosen by a hash of the id; only for fitting."""
    share = min(1 << 20, int(1.05 * rows / max(total, 1) * (1 << 20)) + 1)
    return df.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(11)), F.lit(1 << 20)) < share).select(*columns).limit(rows).toArrow()


@dataclass
class Split:
    """Hot buckets and how their rows are told apart: the sides of hyperplanes through the bucket's mean, in ``tables`` groups."""

    keys: np.ndarray
    means: np.ndarray
    bits: np.ndarray
    axes: np.ndarray  # (tables, dim, most bits)


@dataclass
class Ball:
    """Hot buckets of mutually similar rows: within half the angle of the mean direction any two rows are similar. Such rows go to one
    block each; the others (few), and the least id of the ball, which ties its blocks together, go to every block."""

    keys: np.ndarray
    centres: np.ndarray
    roots: np.ndarray
    blocks: np.ndarray
    least: float

    def inside(self, u: np.ndarray, k: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ij->i", u, self.centres[k]) >= self.least


def find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which ``keys`` are among the sorted ``wanted`` ones, and where."""
    if not len(wanted):
        return np.zeros(len(keys), bool), np.zeros(0, np.int64)
    k = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
    hit = wanted[k] == keys
    return hit, k[hit]


def hot_buckets(df: DataFrame, read: Callable[[pa.RecordBatch], tuple], places: Callable, hot_rows: int) -> dict[int, int]:
    """Keys with more than ``hot_rows`` rows and their exact numbers of rows, counted in each batch before they are added up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, n = np.unique(places(read(batch)[1])[1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])

    counts = df.mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    return {r["key"]: r["n"] for r in counts.filter(F.col("n") > hot_rows).collect()}


class GridIndex:
    """The cells of points (coordinates in units of the reach, beside their group): the numbers of a cell on each axis are its code, of
    which a point also probes the values that ``probe`` reaches lead to. From half a reach on, two points within a reach share a cell; from a
    whole one on, the cell that a point lies in has all points within its reach. Cells with more rows than wanted, by exact counts, are divided into cells of twice the probe in the same way; what is still too large is worked off in pairs of
    blocks, or (``apart``) left to the caller as ``dense`` cells."""

    def __init__(self, cells: float, probe: float = 0.5):
        self.cells, self.probe = cells, probe
        self.fine = self.dense = np.zeros(0, np.int64)
        self.pairs: dict[int, int] = {}

    def _around(self, y: np.ndarray, cells: float) -> tuple[np.ndarray, np.ndarray]:
        y = y / cells
        cell = np.floor(y)
        part, edge = y - cell, self.probe * (1 + 1e-6) / cells
        rows, codes = np.arange(len(y)), cell.astype(np.int64)
        for j in range(y.shape[1]):
            low, high = part[rows, j] <= edge, part[rows, j] >= 1 - edge
            below, above = codes[low], codes[high]
            below[:, j] -= 1
            above[:, j] += 1
            rows, codes = np.concatenate([rows, rows[low], rows[high]]), np.concatenate([codes, below, above])
        return rows, codes

    def places(self, points: tuple[np.ndarray, np.ndarray], ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        y, group = points
        rows, codes = self._around(y, self.cells)
        keys = mix(group[rows], *codes.T)
        hit, _ = find(keys, self.fine)
        if hit.any():
            at, codes = self._around(y[rows[hit]], 2 * self.probe)
            rows, keys = np.concatenate([rows[~hit], rows[hit][at]]), np.concatenate([keys[~hit], mix(keys[hit][at], *codes.T, 7)])
        return (rows, keys) if ids is None else in_blocks(rows, keys, ids, self.pairs)

    def refine(self, df: DataFrame, read: Callable[[pa.RecordBatch], tuple], hot_rows: int, copies: Callable[[], None], apart: bool = False) -> None:
        hot = hot_buckets(df, read, self.places, hot_rows)
        if hot:
            copies()
            self.fine = np.array(sorted(hot_buckets(df, read, self.places, hot_rows)), dtype=np.int64)
            hot = hot_buckets(df, read, self.places, hot_rows)
            if apart:
                self.dense = np.array(sorted(hot), dtype=np.int64)
            else:
                self.pairs = {k: int(np.ceil(n / (hot_rows / 2))) for k, n in hot.items()}


def outer_band(y: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Places of the points (in two coordinates) that, for some pair of directions, fewer than ``depth`` points of their group exceed in both.

    Whatever lies beyond an edge or corner of a group's points meets at least as many of these as of all of them, up to ``depth``."""
    out = np.zeros(len(y), bool)
    for sx in (1, -1):
        for sy in (1, -1):
            order = np.lexsort((-sy * y[:, 1], -sx * y[:, 0], group))
            now, best = None, []
            for i in order.tolist():
                if group[i] != now:
                    now, best = group[i], []
                value = sy * y[i, 1]
                if len(best) < depth or value > best[0]:
                    out[i] = True
                    heapq.heappush(best, value) if len(best) < depth else heapq.heapreplace(best, value)
    return np.flatnonzero(out)


class BucketIndex:
    """The bucket keys of vectors: those that ``base`` gives, and finer ones for the buckets that exact counts show to be too large.

    A hot bucket is an index of its own: by ``tables`` codes of random hyperplanes through its mean, as many bits each as bring it below
    the wanted size. A row within ``width`` of a hyperplane lies on both sides, which grids and overlapping cells need. What no level
    divides any more, and is no ball of mutually similar rows, is worked off in pairs of blocks, so every pair of rows still meets.
    """

    def __init__(self, base: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], tables: int, width: float, wanted: int):
        self.base, self.tables, self.width, self.wanted = base, tables, width, wanted
        self.levels: list[Split] = []
        self.ball: Ball | None = None
        self.pairs: dict[int, int] = {}

    def places(self, u: np.ndarray, ids: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``u`` and the keys they lie under. Without ``ids``: before hot buckets are laid out in blocks."""
        rows, keys = self.base(u)
        for depth, level in enumerate(self.levels):
            hit, k = find(keys, level.keys)
            if hit.any():
                made = [(rows[~hit], keys[~hit])]
                made += [self._finer(u, rows[hit], keys[hit], k, level, depth, t) for t in range(self.tables)]
                rows, keys = (np.concatenate(x) for x in zip(*made))
        if ids is None:
            return rows, keys
        if self.ball is not None:
            hit, k = find(keys, self.ball.keys)
            if hit.any():
                r, n = rows[hit], self.ball.blocks[k]
                single = self.ball.inside(u[r], k) & (ids[r] != self.ball.roots[k])
                own = np.abs(mix(ids[r], 5)) % n
                many = np.flatnonzero(~single)
                block = np.concatenate([own[single], *(np.arange(n[i]) for i in many)]).astype(np.int64)
                at = np.concatenate([np.flatnonzero(single), np.repeat(many, n[many])]).astype(np.int64)
                rows, keys = np.concatenate([rows[~hit], r[at]]), np.concatenate([keys[~hit], mix(keys[hit][at], block, 3)])
        return in_blocks(rows, keys, ids, self.pairs)

    def _finer(self, u, rows, keys, k, level: Split, depth: int, t: int) -> tuple[np.ndarray, np.ndarray]:
        y = (u[rows] - level.means[k]) @ level.axes[t]
        used = np.arange(y.shape[1]) < level.bits[k][:, None]
        code = ((y > 0) & used) @ (1 << np.arange(y.shape[1], dtype=np.int64))
        at = np.arange(len(rows))
        if self.width:
            for j in range(y.shape[1]):
                near = used[at, j] & (np.abs(y[at, j]) < self.width)
                at, code = np.concatenate([at, at[near]]), np.concatenate([code, code[near] ^ (1 << j)])
        return rows[at], mix(keys[at], code, 1000 * (depth + 1) + t)

    def refine(
        self, df: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], dim: int, hot_rows: int,
        copies: Callable[[], None], least: float | None = None, most_levels: int = 6,
    ) -> None:
        """Adds levels until no bucket has more than ``hot_rows`` rows, counted over all rows of ``df``; ``read`` gives ids and points of a
        batch, ``copies`` is called once if there are hot buckets and may make ``read`` leave out heavy copies. The driver holds the hot
        buckets only: at most copies times rows / ``hot_rows``, each with its mean. ``least``: the similarity that makes balls."""
        hot = hot_buckets(df, read, self.places, hot_rows)
        if hot:
            copies()
            hot = hot_buckets(df, read, self.places, hot_rows)
        gone = np.inf
        for depth in range(most_levels + 1):
            if not hot:
                return
            load = sum(hot.values())
            keys = np.array(sorted(hot), dtype=np.int64)
            count = np.array([hot[k] for k in keys])
            if depth == most_levels or load > 0.8 * gone:
                break
            means = self._means(df, read, dim, keys, count)
            bits = np.clip(np.ceil(np.log2(count / self.wanted)), 1, dim).astype(np.int64)
            rng = np.random.default_rng(101 + depth)
            axes = np.stack([np.linalg.qr(rng.normal(size=(dim, dim)))[0][:, : bits.max()] for _ in range(self.tables)])
            self.levels.append(Split(keys, means, bits, axes))
            gone, hot = load, hot_buckets(df, read, self.places, hot_rows)
        if least is not None:
            keys, count = self._balls(df, read, dim, keys, count, hot_rows, least)
        self.pairs = {int(k): int(np.ceil(n / (hot_rows / 2))) for k, n in zip(keys, count)}

    def _means(self, df: DataFrame, read, dim: int, keys: np.ndarray, count: np.ndarray) -> np.ndarray:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u = read(batch)[1]
                rows, found = self.places(u)
                hit, k = find(found, keys)
                here, back = np.unique(k, return_inverse=True)
                total = np.zeros((len(here), dim))
                np.add.at(total, back, u[rows[hit]])
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), *(pa.array(total[:, d]) for d in range(dim))], ["k", *(f"c{d}" for d in range(dim))])

        parts = df.mapInArrow(run, ", ".join(["k bigint", *(f"c{d} double" for d in range(dim))]))
        out = np.zeros((len(keys), dim))
        for r in parts.groupBy("k").agg(*(F.sum(f"c{d}").alias(f"c{d}") for d in range(dim))).collect():
            out[r["k"]] = [r[f"c{d}"] for d in range(dim)]
        return out / count[:, None]

    def _balls(self, df: DataFrame, read, dim: int, keys: np.ndarray, count: np.ndarray, hot_rows: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Lays hot buckets with few rows outside their ball out in blocks; the others are given back."""
        centres = self._means(df, read, dim, keys, count)
        centres /= np.maximum(np.sqrt((centres * centres).sum(axis=1, keepdims=True)), 1e-12)
        half = float(np.sqrt((1 + least) / 2)) + 1e-9  # cosine of half the angle
        trial = Ball(keys, centres, np.zeros(len(keys), np.int64), np.ones(len(keys), np.int64), half)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, u = read(batch)
                rows, found = self.places(u)
                hit, k = find(found, keys)
                good = trial.inside(u[rows[hit]], k)
                k, r = k[good], ids[rows[hit][good]]
                here, back = np.unique(k, return_inverse=True)
                low = np.full(len(here), np.iinfo(np.int64).max)
                np.minimum.at(low, back, r)
                yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(np.bincount(back, minlength=len(here)), pa.int64()), pa.array(low, pa.int64())], ["k", "n", "low"])

        inside, low = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for r in df.mapInArrow(run, "k bigint, n bigint, low bigint").groupBy("k").agg(F.sum("n").alias("n"), F.min("low").alias("low")).collect():
            inside[r["k"]], low[r["k"]] = r["n"], r["low"]
        tight = (count - inside <= hot_rows) & (inside > 0)
        if tight.any():
            self.ball = Ball(keys[tight], centres[tight], low[tight], np.ceil(inside[tight] / (hot_rows / 2)).astype(np.int64), half)
        return keys[~tight], count[~tight]


def in_blocks(rows: np.ndarray, keys: np.ndarray, ids: np.ndarray, hot: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of hot keys go to each pair of blocks that holds theirs, so every pair of rows still meets, in tasks of bounded size."""
    for key in set(np.unique(keys).tolist()) & set(hot) if hot else ():
        blocks = hot[key]
        at = np.flatnonzero(keys == key)
        own = np.abs(mix(ids[rows[at]])) % blocks
        other = np.arange(blocks)
        low, high = np.minimum(own[:, None], other), np.maximum(own[:, None], other)
        keep = keys != key
        rows, keys = (
            np.concatenate([rows[keep], np.repeat(rows[at], blocks)]),
            np.concatenate([keys[keep], mix(key, (low * blocks + high).ravel())]),
        )
    return rows, keys


def content_of(values: np.ndarray, *extra: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each row of values and the numbers beside it."""
    raw = np.ascontiguousarray(values).view(np.int32).reshape(len(values), -1)
    return mix(*raw.T, *extra) if len(raw) else np.zeros(0, np.int64)


def heavy_contents(df: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], keep: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Contents that more than ``least`` rows share, sorted, and the ``keep`` least ids of each. ``read`` gives ids and contents of a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, content = read(batch)
            order = np.lexsort((ids, content))
            ids, content = ids[order], content[order]
            start = np.flatnonzero(np.append(True, content[1:] != content[:-1])) if len(ids) else np.zeros(0, np.int64)
            n = np.diff(np.append(start, len(ids)))
            many = n > 1
            lists = [np.unique(ids[s : s + m])[:keep].tolist() for s, m in zip(start[many], n[many])]
            yield pa.RecordBatch.from_arrays([pa.array(content[start[many]], pa.int64()), pa.array(n[many], pa.int64()), pa.array(lists, pa.list_(pa.int64()))], ["c", "n", "ids"])

    parts = df.mapInArrow(run, "c bigint, n bigint, ids array<bigint>")
    # Only copies that meet in a batch count; a content with more than ``least`` copies in so many rows does.
    heavy = parts.groupBy("c").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, keep).alias("ids")).filter(F.col("n") > least)
    rows = sorted((r["c"], r["ids"]) for r in heavy.filter(F.size("ids") == keep).collect())
    return np.array([c for c, _ in rows], dtype=np.int64), np.array([i for _, i in rows], dtype=np.int64).reshape(-1, keep)


#: Bytes of an index that one task works off: about a second of comparing.
TASK_BYTES = 10 << 20


def task_count(df: DataFrame, rows: int, row_bytes: int) -> int:
    """As many tasks as keep each one's part of an index small, whatever the table's size."""
    return max(partitions(df.sparkSession), -(-rows * row_bytes // TASK_BYTES))


Kernel = Callable[[int, np.ndarray, np.ndarray], Iterable[tuple[np.ndarray, ...]]]


def by_bucket(index: DataFrame, kernel: Kernel, dtype: str, dim: int, names: list[str], types: list[pa.DataType], schema: str, tasks: int) -> DataFrame:
    """Streams each bucket of ``index`` (key, id, v, rep) through ``kernel(key, ids, values)``; rows without v pass on as (id, rep, null...).

    One shuffle on the key; buckets arrive in key order and one is held at a time. A row repeated under its id counts once.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        current = None
        ready: list[tuple[np.ndarray, ...]] = []

        def flush() -> None:
            if not held:
                return
            ids = np.concatenate([x[0] for x in held])
            values = np.concatenate([x[1] for x in held])
            held.clear()
            ids, first = np.unique(ids, return_index=True)
            if len(ids) > 1:
                ready.extend(kernel(current, ids, values[first]))

        def out(least: int) -> Iterator[pa.RecordBatch]:
            if sum(len(x[0]) for x in ready) > least:
                arrays = [pa.array(np.concatenate(c)).cast(t) for c, t in zip(zip(*ready), types)]
                ready.clear()
                yield pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            if not len(batch):
                continue
            if batch.column(2).null_count:
                lost = batch.filter(batch.column(2).is_null())
                yield pa.RecordBatch.from_arrays([lost.column(1), lost.column(3), *(pa.nulls(len(lost), t) for t in types[2:])], names)
                batch = batch.filter(batch.column(2).is_valid())
                if not len(batch):
                    continue
            key = batch.column(0).to_numpy(zero_copy_only=False)
            ids = batch.column(1).to_numpy(zero_copy_only=False)
            column = batch.column(2).cast(pa.binary())
            buffers = column.buffers()
            offsets = np.frombuffer(buffers[1], np.int32)[column.offset : column.offset + len(column) + 1]
            raw = buffers[2] if buffers[2] is not None else b""
            values = np.frombuffer(raw, dtype=dtype, count=(offsets[-1] - offsets[0]) // np.dtype(dtype).itemsize, offset=offsets[0]).reshape(-1, dim)
            edges = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for s, e in zip(edges, np.append(edges[1:], len(key))):
                if key[s] != current:
                    flush()
                    current = key[s]
                held.append((ids[s:e], values[s:e]))
            yield from out(200_000)
        flush()
        yield from out(0)

    return index.repartition(tasks, "key").sortWithinPartitions("key").mapInArrow(run, schema)


def binary_rows(values: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values, without a loop."""
    data = np.ascontiguousarray(values)
    width = data.dtype.itemsize * data.shape[1]
    offsets = np.arange(len(data) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(data), [None, pa.py_buffer(offsets), pa.py_buffer(data.tobytes())])
