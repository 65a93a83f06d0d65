"""Cameras, rotations, projections and splats as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Real spherical-harmonic constants of degrees 0 to 4.
SH0 = 0.28209479177387814
SH1 = 0.4886025119029199
SH2 = (1.0925484305920792, -1.0925484305920792, 0.31539156525252005, -1.0925484305920792, 0.5462742152960396)


SH3 = (-0.5900435899266435, 2.890611442640554, -0.4570457994644658, 0.3731763325901154, -0.4570457994644658, 1.445305721320277, -0.5900435899266435)
SH4 = (2.5033429417967046, -1.7701307697799304, 0.9461746957575601, -0.6690465435572892, 0.10578554691520431, -0.6690465435572892, 0.47308734787878004, -1.7701307697799304, 0.6258357354491761)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def base_colour(c: Column) -> Column:
    """Colour of a base coefficient, clamped to 0..1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), SH0 * c + 0.5))


def colour_base(rgb: Column) -> Column:
    return (rgb - 0.5) / SH0


def third_scale(scales: Column) -> Column:
    """The flat axis that two-axis models get: eight below the smaller one, not below -12 (log scales)."""
    return F.greatest(F.array_min(scales) - 8, F.lit(-12.0))


def backend(scales: Column) -> Column:
    """'2dgs' for two scales, '3dgs' for three; other counts are an error, null stays null."""
    bad = F.raise_error(F.concat(F.lit("scales: "), F.size(scales).cast("string"))).cast("string")
    return F.when(scales.isNull(), None).when(F.size(scales) == 2, "2dgs").when(F.size(scales) == 3, "3dgs").otherwise(bad)


def unit_quaternion(q: Column) -> list[Column]:
    length = F.sqrt(sum((q[i] * q[i] for i in range(1, 4)), q[0] * q[0]))
    return [q[i] / length for i in range(4)]


def rotation_matrix(q: list[Column]) -> list[list[Column]]:
    w, x, y, z = q
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


def quaternion_product(a: list[Column], b: list[Column]) -> list[Column]:
    aw, ax, ay, az = a
    bw, bx, by, bz = b
    return [
        aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw,
    ]


def covariance6(q: Column, scales: Column) -> list[Column]:
    """Upper triangle of R diag(s)^2 R^T: xx, xy, xz, yy, yz, zz; ``scales`` are lengths."""
    r = rotation_matrix(unit_quaternion(q))
    entry = lambda i, j: sum((r[i][k] * r[j][k] * scales[k] * scales[k] for k in (1, 2)), r[i][0] * r[j][0] * scales[0] * scales[0])
    return [entry(0, 0), entry(0, 1), entry(0, 2), entry(1, 1), entry(1, 2), entry(2, 2)]


def focal_to_fov(focal: Column, pixels: Column) -> Column:
    return 2 * F.atan(pixels / (2 * focal))


def fov_to_focal(fov: Column, pixels: Column) -> Column:
    return pixels / (2 * F.tan(fov / 2))


def ndc_to_pixel(v: Column, size: Column | int) -> Column:
    return ((v + 1) * size - 1) / 2


def pixel_to_point(row: Column, col: Column, depth: Column, focal: Column, cx: Column, cy: Column, transposed: bool = True) -> list[Column]:
    """Point seen at a pixel. ``transposed``: the row is taken as x, as in tables made that way; else the column is x."""
    u, v = (row, col) if transposed else (col, row)
    return [(u - cx) * depth / focal, (v - cy) * depth / focal, depth]


def sh_colour(coefficients: list[Column], direction: list[Column], degree: int) -> Column:
    """Spherical-harmonic value of degree 0 to 4 in a unit direction; ``coefficients`` has at least (degree + 1)^2. Other degrees are an error."""
    if degree not in range(5) or len(coefficients) < (degree + 1) ** 2:
        raise ValueError(f"degree {degree} with {len(coefficients)} coefficients")
    x, y, z = direction
    xx, yy, zz = x * x, y * y, z * z
    out = SH0 * coefficients[0]
    if degree > 0:
        out = out - SH1 * y * coefficients[1] + SH1 * z * coefficients[2] - SH1 * x * coefficients[3]
    if degree > 1:
        basis = [x * y, y * z, 2 * zz - xx - yy, x * z, xx - yy]
        for constant, b, c in zip(SH2, basis, coefficients[4:9]):
            out = out + constant * b * c
    if degree > 2:
        level = 4 * zz - xx - yy
        basis = [y * (3 * xx - yy), x * y * z, y * level, z * (2 * zz - 3 * xx - 3 * yy), x * level, z * (xx - yy), x * (xx - 3 * yy)]
        for constant, b, c in zip(SH3, basis, coefficients[9:16]):
            out = out + constant * b * c
    if degree > 3:
        basis = [
            x * y * (xx - yy), y * z * (3 * xx - yy), x * y * (7 * zz - 1), y * z * (7 * zz - 3), zz * (35 * zz - 30) + 3,
            x * z * (7 * zz - 3), (xx - yy) * (7 * zz - 1), x * z * (xx - 3 * yy), xx * (xx - 3 * yy) - yy * (3 * xx - yy),
        ]
        for constant, b, c in zip(SH4, basis, coefficients[16:25]):
            out = out + constant * b * c
    return out


def matrix_quaternion(m: list[list[Column]]) -> list[Column]:
    """The unit quaternion (w, x, y, z), w not negative, of a rotation matrix: from the largest of its four components, so none is divided by
    something small."""
    trace = m[0][0] + m[1][1] + m[2][2]
    four = [1 + trace, 1 + 2 * m[0][0] - trace, 1 + 2 * m[1][1] - trace, 1 + 2 * m[2][2] - trace]  # each is 4 times a component squared
    sums = {(0, 1): m[2][1] - m[1][2], (0, 2): m[0][2] - m[2][0], (0, 3): m[1][0] - m[0][1], (1, 2): m[0][1] + m[1][0], (1, 3): m[0][2] + m[2][0], (2, 3): m[1][2] + m[2][1]}
    best = F.greatest(*four)
    out = []
    for i in range(4):
        value = F.lit(None).cast("double")
        for k in reversed(range(4)):
            size = 2 * F.sqrt(four[k])
            value = F.when(four[k] == best, size / 4 if i == k else sums[min(i, k), max(i, k)] / size).otherwise(value)
        out.append(value)
    sign = F.when(out[0] < 0, -1.0).otherwise(1.0)
    return [v * sign for v in out]


def transform_splats(df: DataFrame, matrix: list[list[float]], offset: list[float], xyz: tuple[str, str, str] = ("x", "y", "z"), rot: str = "rot", scale: str = "scale") -> DataFrame:
    """Splats under the affine map ``matrix`` * p + ``offset``: positions mapped, rotations and (log) scales such that each splat's covariance
    is the mapped one (singular values of matrix * rotation * scales; largest axes first).

    Two scales stay two: the flat third axis takes part and is left out again. Rows with a null position, rotation or scale have null results
    there. Other columns stay. One batched decomposition an Arrow batch.
    """
    import numpy as np
    import pyarrow as pa

    a, b = np.array(matrix, dtype=np.float64), np.array(offset, dtype=np.float64)
    cells = [F.when(F.col(rot).isNotNull(), F.array(*unit_quaternion(F.col(rot).cast("array<double>")))).alias("_q")]
    third = F.when(F.size(scale) == 2, third_scale(F.col(scale))).otherwise(F.get(scale, F.lit(2)))
    cells.append(F.when(F.size(scale).isin(2, 3), F.array(F.col(scale)[0], F.col(scale)[1], third).cast("array<double>")).alias("_s"))
    kept = [c for c in df.columns if c not in (*xyz, rot, scale)]
    source = df.select(*kept, *(F.col(c).cast("double").alias(c) for c in xyz), *cells, F.size(scale).alias("_n"))
    types = {f.name: f.dataType.simpleString() for f in source.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`{c}` double" for c in xyz), f"`{rot}` array<double>", f"`{scale}` array<double>"])

    def run(batches):
        for batch in batches:
            n, k = len(batch), len(kept)
            p = np.stack([batch.column(k + i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype(np.float64)
            quaternions, scales, sizes = (batch.column(k + i).to_pylist() for i in (3, 4, 5))
            good = [i for i in range(n) if quaternions[i] is not None and scales[i] is not None and None not in quaternions[i] and None not in scales[i]]
            q, s = np.array([quaternions[i] for i in good]).reshape(-1, 4), np.exp(np.array([scales[i] for i in good]).reshape(-1, 3))
            w, x, y, z = q.T
            r = np.stack([
                np.stack([1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], axis=1),
                np.stack([2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], axis=1),
                np.stack([2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)], axis=1),
            ], axis=1)
            u, d, _ = np.linalg.svd(a @ (r * s[:, None, :]))
            u[:, :, 2] *= np.sign(np.linalg.det(u))[:, None]  # a proper rotation
            new_q, new_s = [None] * n, [None] * n
            for i, turn, size in zip(good, _quaternions(u).tolist(), np.log(np.maximum(d, 1e-300)).tolist()):
                new_q[i], new_s[i] = turn, size[: sizes[i]]
            moved = p @ a.T + b
            arrays = [pa.array(moved[:, i], from_pandas=True) for i in range(3)] + [pa.array(v, pa.list_(pa.float64())) for v in (new_q, new_s)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), *arrays], [*kept, *xyz, rot, scale])

    return source.mapInArrow(run, schema)


def _quaternions(m):
    """``matrix_quaternion`` for an array (n, 3, 3)."""
    import numpy as np

    t = np.trace(m, axis1=1, axis2=2)
    four = np.stack([1 + t, *(1 + 2 * m[:, i, i] - t for i in range(3))], axis=1)
    odd = np.stack([m[:, 2, 1] - m[:, 1, 2], m[:, 0, 2] - m[:, 2, 0], m[:, 1, 0] - m[:, 0, 1]], axis=1)
    even = m + m.transpose(0, 2, 1)
    outer = np.zeros((len(m), 4, 4))  # four times the products of the components
    outer[:, range(4), range(4)] = four
    outer[:, 0, 1:] = outer[:, 1:, 0] = odd
    for i in range(3):
        for j in range(3):
            if i != j:
                outer[:, 1 + i, 1 + j] = even[:, i, j]
    k = four.argmax(axis=1)
    at = np.arange(len(m))
    q = outer[at, k] / (2 * np.sqrt(four[at, k]))[:, None]
    return q * np.where(q[:, :1] < 0, -1, 1)


def position_encoding(x: Column, bands: int) -> Column:
    """x, then sin and cos of x times the powers of two."""
    waves = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.array(F.sin(x * F.pow(F.lit(2.0), k)), F.cos(x * F.pow(F.lit(2.0), k)))))
    return F.concat(F.array(x), waves)


def log_lerp(step: Column, steps: int, start: float, end: float) -> Column:
    """Exponential schedule: the logarithm goes linearly from start to end."""
    t = F.least(F.greatest(step / F.lit(steps), F.lit(0.0)), F.lit(1.0))
    return F.exp(F.log(F.lit(start)) * (1 - t) + F.log(F.lit(end)) * t)


def screen_splats(points: DataFrame, width: int, height: int, focal: float) -> DataFrame:
    """Adds px, py, depth and conic (ca, cb, cc) and radius of splats seen along z (camera at z = -``focal`` away is the caller's).

    ``points`` has x, y, depth, s (a round scale) and alpha. The screen covariance gets 0.3 added on its diagonal; radius is 3 sigma.
    """
    f = F.lit(float(focal))
    on = points.filter("depth > 0.2")
    on = on.withColumn("px", ndc_to_pixel(F.col("x") / F.col("depth") * f * 2 / width, width)).withColumn("py", ndc_to_pixel(F.col("y") / F.col("depth") * f * 2 / height, height))
    jx, jy = -f * F.col("x") / (F.col("depth") * F.col("depth")), -f * F.col("y") / (F.col("depth") * F.col("depth"))
    j, s2 = f / F.col("depth"), F.col("s") * F.col("s")
    a, b, c = s2 * (j * j + jx * jx) + 0.3, s2 * jx * jy, s2 * (j * j + jy * jy) + 0.3
    on = on.withColumns({"va": a, "vb": b, "vc": c})
    det = F.col("va") * F.col("vc") - F.col("vb") * F.col("vb")
    mid = (F.col("va") + F.col("vc")) / 2
    top = mid + F.sqrt(F.greatest(F.lit(0.1), mid * mid - det))
    return on.withColumns({"ca": F.col("vc") / det, "cb": -F.col("vb") / det, "cc": F.col("va") / det, "radius": F.ceil(3 * F.sqrt(top)).cast("int")}).drop("va", "vb", "vc")


def splat_tiles(splats: DataFrame, width: int, height: int, tile: int = 16) -> DataFrame:
    """One row for each tile (tx, ty) that a splat's square of ``radius`` touches: a spatial range join."""
    clamp = lambda v, n: F.least(F.greatest(v, F.lit(0)), F.lit(n)).cast("int")
    out = splats
    for a, size in (("x", width), ("y", height)):
        n = -(-size // tile)
        low, high = clamp(F.floor((F.col(f"p{a}") - F.col("radius")) / tile), n), clamp(F.floor((F.col(f"p{a}") + F.col("radius") + tile - 1) / tile), n)
        out = out.withColumn(f"t{a}", F.explode(F.when(high > low, F.sequence(low, high - 1)).otherwise(F.array().cast("array<int>"))))
    return out


def blend(samples: DataFrame, by: list[str], order: list[str], values: list[str], least_alpha: float = 1 / 255, stop: float = 1e-4) -> DataFrame:
    """Front-to-back blending of ``values`` with ``alpha`` for each group: sums of value * alpha * transmittance, and ``left``.

    Samples under ``least_alpha`` are skipped; a group ends before the first sample that would bring the transmittance under ``stop``.
    """
    order_by = Window.partitionBy(*by).orderBy(*order)
    kept = samples.filter(F.col("alpha") >= least_alpha).withColumn("_a", F.least("alpha", F.lit(0.99)))
    through = F.exp(F.sum(F.log(1 - F.col("_a"))).over(order_by.rowsBetween(Window.unboundedPreceding, 0)))
    kept = kept.withColumn("_after", through).filter(F.col("_after") >= stop).withColumn("_w", F.col("_a") * F.col("_after") / (1 - F.col("_a")))
    return kept.groupBy(*by).agg(*(F.sum(F.col(v) * F.col("_w")).alias(v) for v in values), F.min("_after").alias("left"))


def shade(splats: DataFrame, width: int, height: int, tile: int = 16) -> DataFrame:
    """``y``, ``x``, ``alpha`` samples: each splat's opacity at the pixels of its square inside the frame."""
    tiles = splat_tiles(splats, width, height, tile)
    steps = F.sequence(F.lit(0), F.lit(tile - 1))
    spread = tiles.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    spread = spread.withColumn("y", F.col("ty") * tile + F.col("dy")).withColumn("x_", F.col("tx") * tile + F.col("dx"))
    gx, gy = F.col("px") - F.col("x_"), F.col("py") - F.col("y")
    power = -0.5 * (F.col("ca") * gx * gx + F.col("cc") * gy * gy) - F.col("cb") * gx * gy
    out = spread.filter((F.col("y") < height) & (F.col("x_") < width)).withColumn("power", power).filter("power <= 0")
    return out.withColumn("alpha", F.least(F.lit(0.99), F.col("alpha") * F.exp("power"))).drop("x").withColumnRenamed("x_", "x").drop("dx", "dy", "power")


def ssim(pixels: DataFrame, by: list[str], half: int = 5, sigma: float = 1.5) -> DataFrame:
    """Mean structural similarity of a and b (columns of ``pixels`` with y, x) for each group, with a Gaussian window; beyond the frame is 0."""
    import math

    g = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-half, half + 1)]
    total = sum(g)
    kernel = F.array(*(F.lit(v / total) for v in g))
    steps = F.sequence(F.lit(-half), F.lit(half))
    near = pixels.withColumn("dy", F.explode(steps)).withColumn("dx", F.explode(steps))
    w = F.element_at(kernel, F.col("dy") + half + 1) * F.element_at(kernel, F.col("dx") + half + 1)
    near = near.withColumn("w", w).withColumn("cy", F.col("y") + F.col("dy")).withColumn("cx", F.col("x") + F.col("dx"))
    m = {"ma": "a", "mb": "b", "aa": "a * a", "bb": "b * b", "ab": "a * b"}
    sums = near.groupBy(*by, "cy", "cx").agg(*(F.sum(F.expr(f"w * ({e})")).alias(n) for n, e in m.items()))
    inside = sums.join(pixels.select(*by, F.col("y").alias("cy"), F.col("x").alias("cx")), [*by, "cy", "cx"])
    va, vb, vab = F.col("aa") - F.col("ma") * F.col("ma"), F.col("bb") - F.col("mb") * F.col("mb"), F.col("ab") - F.col("ma") * F.col("mb")
    value = ((2 * F.col("ma") * F.col("mb") + 1e-4) * (2 * vab + 9e-4)) / ((F.col("ma") * F.col("ma") + F.col("mb") * F.col("mb") + 1e-4) * (va + vb + 9e-4))
    return inside.groupBy(*by).agg(F.avg(value).alias("ssim"))
