"""Vector arithmetic, nearest centres, votes and Lloyd steps over array columns."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound on centres (or prompts) that are sent to every task: with 4096 of 1024 dimensions 32 MB.
MOST_CENTRES = 4096


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def normalise(a: Column | str, eps: float = 1e-6) -> Column:
    """``a`` over its length, or over ``eps`` if it is shorter."""
    length = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x / length)


def group_means(df: DataFrame, by: list[str], vec: str, unit: bool = True) -> DataFrame:
    """Mean vector of each group (scaled to length one): partial sums by dimension, so groups of any size are no one task's work."""
    parts = df.select(*by, F.posexplode(vec).alias("_i", "_v")).groupBy(*by, "_i").agg(F.avg("_v").alias("_m"))
    means = parts.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("centre"))
    return means.withColumn("centre", normalise("centre")) if unit else means


def vote(df: DataFrame, by: list[str], label: str, weight: str) -> DataFrame:
    """The label of greatest total weight in each group (ties: least label) and its share of the group's weight."""
    totals = df.groupBy(*by, label).agg(F.sum(weight).alias("_s"))
    group = Window.partitionBy(*by)
    rank = F.row_number().over(group.orderBy(F.desc(F.round("_s", 9)), label))
    share = F.col("_s") / F.greatest(F.sum("_s").over(group), F.lit(1e-6))
    return totals.withColumn("_k", rank).withColumn("share", share).filter("_k = 1").drop("_k", "_s")


def whole_vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and values (in double) of the vectors of a batch that have ``dim`` known numbers."""
    fits = pc.fill_null(pc.equal(pc.list_value_length(column), dim), False)
    at = np.flatnonzero(fits.to_numpy(zero_copy_only=False))
    flat = column.take(pa.array(at)).flatten()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if flat.null_count:
        known = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        at, values = at[known], values[known]
    return at, values


def collect_centres(centres: DataFrame, label: str, vec: str) -> tuple[list, np.ndarray]:
    """A bounded set of centres on the driver, in the order of their labels; more than ``MOST_CENTRES`` are an error."""
    rows = centres.select(label, vec).orderBy(label).limit(MOST_CENTRES + 1).collect()
    if len(rows) > MOST_CENTRES:
        raise ValueError(f"more than {MOST_CENTRES} centres")
    return [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.float64).reshape(len(rows), -1)


def score_centres(df: DataFrame, key: str, vec: str, labels: list, matrix: np.ndarray, most: int = 1) -> DataFrame:
    """``key``, ``rank``, ``label``, ``score``: the ``most`` centres of greatest dot product with each vector (ties within 1e-9: first).

    One matrix product an Arrow batch; there is no join. Null and wrongly sized vectors give no rows.
    """
    kind = df.schema[key].dataType.simpleString()
    names = pa.array(labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                if not len(labels):
                    continue
                at, vectors = whole_vectors(part.column(1), matrix.shape[1])
                if not len(at):
                    continue
                scores = vectors @ matrix.T
                order = np.argsort(-np.round(scores, 9), axis=1, kind="stable")[:, :most]
                width = order.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(np.repeat(at, width))), pa.array(np.tile(np.arange(1, width + 1, dtype=np.int64), len(at))),
                        names.take(pa.array(order.ravel())), pa.array(np.take_along_axis(scores, order, 1).ravel()),
                    ],
                    [key, "rank", "label", "score"],
                )

    label_kind = {pa.string(): "string", pa.int64(): "bigint"}.get(names.type, "bigint")
    return df.select(key, vec).mapInArrow(run, f"`{key}` {kind}, rank bigint, label {label_kind}, score double")


def nearest_centre(df: DataFrame, key: str, vec: str, centres: DataFrame, label: str, centre: str) -> DataFrame:
    """Each vector's centre of greatest dot product."""
    return score_centres(df, key, vec, *collect_centres(centres, label, centre)).select(key, "label", "score")


def lloyd(df: DataFrame, key: str, vec: str, start: DataFrame, steps: int = 12) -> DataFrame:
    """Spherical k-means: ``label``, ``centre`` after ``steps`` rounds; a centre without members stays. ``start``: label, centre."""
    labels, matrix = collect_centres(start, "label", "centre")
    for _ in range(steps):
        assigned = score_centres(df, key, vec, labels, matrix).select(key, "label")
        means = group_means(df.select(key, vec).join(assigned, key), ["label"], vec).select("label", "centre").collect()
        for r in means:
            matrix[labels.index(r["label"])] = r["centre"]
    return df.sparkSession.createDataFrame([(k, [float(x) for x in v]) for k, v in zip(labels, matrix)], "label bigint, centre array<double>")


def covariance(df: DataFrame, vec: str, dim: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean, covariance and count of a vector column: a dim x dim partial sum a batch, added up on the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dim), np.zeros((dim, dim))
        for batch in batches:
            x = whole_vectors(batch.column(0), dim)[1]
            x = x[np.isfinite(x).all(axis=1)]
            n, one, two = n + len(x), one + x.sum(axis=0), two + x.T @ x
        flat = np.concatenate([one, two.ravel()]).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([flat], pa.list_(pa.float64()))], ["n", "s"])

    parts = df.select(vec).mapInArrow(run, "n bigint, s array<double>").select("n", F.posexplode("s").alias("i", "v"))
    rows = parts.groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).orderBy("i").collect()
    if not rows or not rows[0]["n"]:
        return np.zeros(dim), np.zeros((dim, dim)), 0
    total = rows[0]["n"]
    flat = np.array([r["v"] for r in rows])
    mean = flat[:dim] / total
    return mean, flat[dim:].reshape(dim, dim) / total - np.outer(mean, mean), total


def principal_axes(df: DataFrame, vec: str, dim: int, axes: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and the leading axes as rows; each axis points so that its largest component is positive."""
    mean, cov, _ = covariance(df, vec, dim)
    _, v = np.linalg.eigh(cov)
    out = v[:, ::-1][:, :axes].T
    signs = np.sign(out[np.arange(len(out)), np.abs(out).argmax(axis=1)])
    return mean, out * np.where(signs == 0, 1, signs)[:, None]
