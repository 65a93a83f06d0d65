"""Aggregates and reports over run results, scales and points."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.ranks import numbered, running_total


def mean_or_zero(x: Column) -> Column:
    """Mean of the known values; 0.0 of none."""
    return F.coalesce(F.avg(x), F.lit(0.0))


def known(x: Column) -> Column:
    """A number, with NaN as null."""
    return F.when(~F.isnan(x.cast("double")), x)


def joined_set(x: Column, sep: str = ", ") -> Column:
    """Distinct known values in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(x)), sep)


def stage_aggregate(df: DataFrame, by: list[str], means: list[str], lists: list[str]) -> DataFrame:
    """One row a group: rows, joined distinct ``lists``, and the mean of each of ``means`` (also those named total_*)."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), *(joined_set(F.col(c)).alias(f"{c}_set") for c in lists), *(mean_or_zero(known(F.col(c))).alias(c) for c in means))


def parsed_means(df: DataFrame, by: list[str], columns: list[str], distinct: str) -> DataFrame:
    """Means over text columns of what parses as a number (empty and other texts don't count), and the number of distinct ``distinct``."""
    return df.groupBy(*by).agg(F.count_distinct(distinct).alias("n"), *(mean_or_zero(F.col(c).try_cast("double")).alias(c) for c in columns))


def winner(df: DataFrame, keys: list[str], ties: list[str], per: list[str] | None = None) -> DataFrame:
    """The row first by ``keys`` descending (nulls last), then by ``ties`` ascending; one for each group ``per``.

    Without groups this is a top-1, which needs no common partition.
    """
    order = [*(F.desc_nulls_last(k) for k in keys), *(F.asc(t) for t in ties)]
    if not per:
        return df.orderBy(*order).limit(1)
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter("_rank = 1").drop("_rank")


def ecdf(df: DataFrame, value: str, out: str = "cdf", per: list[str] | None = None) -> DataFrame:
    """Empirical distribution of each value: min(1, count(<= v) / max(n - 1, 1)).

    Counts are made on distinct values, whose running totals go over ranges of values; rows get them by a join.
    """
    by = per or []
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    upto = running_total(counts, by, [value], F.col("_n"), "_upto")
    total = counts.groupBy(*by).agg(F.sum("_n").alias("_all"))
    table = upto.join(total, by) if by else upto.crossJoin(F.broadcast(total))  # without groups: one row
    table = table.withColumn(out, F.least(F.lit(1.0), F.col("_upto") / F.greatest(F.col("_all") - 1, F.lit(1)))).select(*by, value, out)
    return df.join(table, [*by, value], "left")


def probit_of(p: Column, low: float = 1e-4) -> Column:
    """Normal quantile of a clamped probability (rational approximation by Acklam; error under 1.2e-9)."""
    # Coefficients of the published approximation.
    a = (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239)
    b = (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0)
    c = (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
    d = (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0)
    poly = lambda cs, x: reduce(lambda acc, k: acc * x + k, cs[1:], F.lit(cs[0]))
    p = F.least(F.greatest(p, F.lit(low)), F.lit(1 - low))
    q = p - 0.5
    middle = poly(a, q * q) * q / poly(b, q * q)
    tail = lambda x: poly(c, F.sqrt(-2 * F.log(x))) / poly(d, F.sqrt(-2 * F.log(x)))
    return F.when(p < 0.02425, tail(p)).when(p > 1 - 0.02425, -tail(1 - p)).otherwise(middle)


def quantiles(df: DataFrame, value: str, at: list[float], by: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation."""
    return df.groupBy(*(by or [])).agg(*(F.percentile(value, F.lit(q)).alias(f"q{int(round(q * 100)):02d}") for q in at))


def robust_extent(df: DataFrame, axes: list[str], by: list[str]) -> DataFrame:
    """Length of the vector of the axes' 10-90 % ranges."""
    spans = [(F.percentile(a, F.lit(0.9)) - F.percentile(a, F.lit(0.1))) for a in axes]
    return df.groupBy(*by).agg(F.sqrt(sum((s * s for s in spans[1:]), spans[0] * spans[0])).alias("extent"))


def spread(df: DataFrame, axes: list[str], by: list[str]) -> DataFrame:
    """Length of the vector of twice the axes' sample deviations; 0 for fewer than two points."""
    parts = [F.pow(2 * F.stddev_samp(a), F.lit(2)) for a in axes]
    return df.groupBy(*by).agg(F.coalesce(F.when(F.count("*") >= 2, F.sqrt(sum(parts[1:], parts[0]))), F.lit(0.0)).alias("spread"))


def min_max(df: DataFrame, value: str, out: str, by: list[str], flat: float = 1e-8) -> DataFrame:
    """Values of each group scaled to 0..1; 1 where a group has no range."""
    span = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    scaled = F.when(F.col("_high") - F.col("_low") < flat, 1.0).otherwise((F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low")))
    return df.join(span, by).withColumn(out, scaled).drop("_low", "_high")


def bounding(df: DataFrame, axes: list[str], by: list[str], factor: float = 1.1) -> DataFrame:
    """Centroid of positions and ``radius``: the greatest distance from it, times ``factor``."""
    centre = df.groupBy(*by).agg(*(F.avg(a).alias(f"c{a}") for a in axes))
    d2 = sum((F.pow(F.col(a) - F.col(f"c{a}"), F.lit(2)) for a in axes[1:]), F.pow(F.col(axes[0]) - F.col(f"c{axes[0]}"), F.lit(2)))
    return df.join(centre, by).groupBy(*by).agg(*(F.first(f"c{a}").alias(f"c{a}") for a in axes), (F.sqrt(F.max(d2)) * factor).alias("radius"))


def ema(df: DataFrame, by: list[str], order: list[str], value: str, keep: float = 0.6) -> DataFrame:
    """Exponential moving average of each group's known values in order, started at 0: the last one.

    It is the sum of the values, each weighted by ``keep`` to the power of how many come after it, so a group is never held whole.
    """
    known_rows = df.filter(F.col(value).isNotNull()).select(*by, *order, F.col(value).cast("double").alias("_v"))
    placed = numbered(known_rows, by, order, "_i")
    sizes = known_rows.groupBy(*by).agg(F.count("*").alias("_n"))
    weight = F.pow(F.lit(keep), (F.col("_n") - F.col("_i")).cast("double")) * (1 - keep)
    return placed.join(sizes, by).groupBy(*by).agg(F.sum(F.col("_v") * weight).alias("ema"))


def psnr(mse: Column) -> Column:
    return 20 * F.log10(1 / F.sqrt(mse))


def stratified_sample(df: DataFrame, label: str, key: str, total: int, seed: str = "s") -> DataFrame:
    """About ``total`` rows over the labels in proportion (largest remainders first; a label never gives more than it has).

    Rows of a label are taken in the order of a hash of ``key``; a label whose quota is full takes no remainder. All rows if there are
    no more than ``total``.
    """
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    whole = Window.partitionBy()  # over labels only
    exact = F.col("n") * F.lit(float(total)) / F.sum("n").over(whole)
    quota = counts.withColumn("all", F.sum("n").over(whole)).withColumn("exact", exact).withColumn("base", F.least(F.floor("exact"), F.col("n")))
    quota = quota.withColumn("room", F.col("base") < F.col("n")).withColumn("left", F.lit(total) - F.sum("base").over(whole))
    rank = F.row_number().over(Window.partitionBy("room").orderBy(F.desc(F.col("exact") - F.floor("exact")), label))
    take = F.when(F.col("all") <= total, F.col("n")).otherwise(F.col("base") + F.when(F.col("room") & (rank <= F.col("left")), 1).otherwise(0))
    hashed = df.withColumn("_hash", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    place = F.row_number().over(Window.partitionBy(label).orderBy("_hash", key))
    near = hashed.join(F.broadcast(quota.withColumn("take", take).select(label, "take", "n")), label)
    # Rows whose hash is far beyond their label's share can't be taken and aren't sorted, so a label costs what is taken of it.
    share = F.conv(F.substring("_hash", 1, 8), 16, 10).cast("double") / 2**32
    near = near.filter((F.col("take") >= F.col("n")) | (share * F.col("n") <= F.col("take") + 10 * F.sqrt("take") + 100))
    return near.withColumn("_place", place).filter("_place <= take").drop("_place", "take", "_hash", "n")


def running_offsets(df: DataFrame, by: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """Inclusive running total of ``value`` in each group."""
    return running_total(df, by, order, F.col(value), out)


def wide_scales(df: DataFrame, by: list[str], scale: str, metrics: list[str], scales: list[float]) -> DataFrame:
    """Pivot: a column ``scale_<s>_<metric>`` for each scale and metric; a missing pair is null."""
    out = []
    for s in scales:
        prefix = "scale_" + f"{s:.2f}".replace(".", "p")
        out += [F.max(F.when(F.col(scale) == s, F.col(m))).alias(f"{prefix}_{m}") for m in metrics]
    return df.groupBy(*by).agg(*out)


def long_scales(df: DataFrame, by: list[str], metrics: list[str], scales: list[float]) -> DataFrame:
    """Unpivot of ``wide_scales``: one row a scale, none where all its metrics are null."""
    rows = F.array(*(F.struct(F.lit(s).alias("scale"), *(F.col("scale_" + f"{s:.2f}".replace(".", "p") + f"_{m}").alias(m) for m in metrics)) for s in scales))
    out = df.select(*by, F.explode(rows).alias("r")).select(*by, "r.*")
    return out.filter(reduce(lambda a, b: a | b, (F.col(m).isNotNull() for m in metrics)))


def scale_prefixes(columns: list[str]) -> list[tuple[str, float]]:
    """The prefixes ``scale_<whole>p<part>`` that column names begin with, and their scales, in the order of these."""
    found = {m[1] for c in columns if (m := re.match(r"(scale_\d+p\d+)_", c))}
    return sorted(((p, float(p.removeprefix("scale_").replace("p", "."))) for p in found), key=lambda x: x[1])


def level_slices(lengths: DataFrame, by: list[str], level: str, n: str) -> DataFrame:
    """``first``, ``stop``: where the rows of each level lie in the arrays that hold all levels of a group one after the other."""
    upto = running_total(lengths, by, [level], F.col(n), "stop")
    return upto.select(*by, level, (F.col("stop") - F.col(n)).alias("first"), "stop")


def zip_check(left: DataFrame, right: DataFrame, by: list[str], order: str, values: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Two tables compared row by row in their order: the greatest difference of any of ``values`` in each group, and whether they are the same
    (as many rows, none farther apart than ``tolerance``). Groups that one side lacks are not the same."""
    a, b = (numbered(df.select(*by, order, *values), by, [order], "_i") for df in (left, right))
    b = b.select(*by, "_i", *(F.col(v).alias(f"_{v}") for v in values), F.lit(True).alias("_there"))
    gap = F.greatest(*(F.abs(F.col(v) - F.col(f"_{v}")) for v in values)) if len(values) > 1 else F.abs(F.col(values[0]) - F.col(f"_{values[0]}"))
    both = a.withColumn("_here", F.lit(True)).join(b, [*by, "_i"], "full_outer")
    most = F.max(gap)
    paired = F.bool_and(F.col("_here").isNotNull() & F.col("_there").isNotNull())
    return both.groupBy(*by).agg(most.alias("gap"), (paired & (F.coalesce(most, F.lit(0.0)) <= tolerance)).alias("same"))


def external_labels(points: DataFrame, outside: DataFrame, key: str, axes: list[str], tolerance: float = 1e-5) -> DataFrame:
    """``key``, ``label``, ``state`` of each point: the label of the outside table, if it has the key and (where it gives coordinates) lies no
    farther off than ``tolerance`` on any axis ('moved' otherwise); -1 for those and for points it lacks ('absent')."""
    other = outside.select(key, F.col("label").alias("_label"), *(F.col(a).alias(f"_{a}") for a in axes), F.lit(True).alias("_there"))
    far = F.lit(False)
    for a in axes:
        far = far | F.coalesce(F.abs(F.col(a) - F.col(f"_{a}")) > tolerance, F.lit(False))
    state = F.when(F.col("_there").isNull(), "absent").when(far, "moved").otherwise("taken")
    joined = points.join(other, key, "left").withColumn("state", state)
    return joined.select(key, F.when(F.col("state") == "taken", F.coalesce("_label", F.lit(-1))).otherwise(-1).cast("bigint").alias("label"), "state")


def markdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """One line of a Markdown table a row: floats with four digits, nulls empty."""
    cells = [F.coalesce(F.format_string("%.4f", F.col(c)) if dict(df.dtypes)[c] in ("double", "float") else F.col(c).cast("string"), F.lit("")) for c in columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
