"""Row filters and predicates over point, mask and view tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmill.operators.ranks import numbered


def keep_or_all(df: DataFrame, hit: Column, by: list[str] | None = None) -> DataFrame:
    """Rows where ``hit`` holds; where it holds for no row (of a group ``by``), all rows. A null ``hit`` is no hit."""
    hits = F.coalesce(hit.cast("int"), F.lit(0))
    marked = df.withColumn("_hit", hits)
    totals = marked.groupBy(*(by or [])).agg(F.max("_hit").alias("_any"))
    joined = marked.join(totals, by) if by else marked.join(F.broadcast(totals))  # without groups: a single row
    return joined.filter("_hit = 1 or coalesce(_any, 0) = 0").select(*df.columns)


class SelectionStack:
    """Successive selections of one table: each narrows the one before (where it hits nothing, all rows stay), the last one or all of them can
    be taken back. Nothing runs before ``rows`` is used; every version is a plan over the same table."""

    def __init__(self, df: DataFrame):
        self.versions = [df]

    def select(self, hit: Column) -> SelectionStack:
        self.versions.append(keep_or_all(self.versions[-1], hit))
        return self

    def undo(self) -> SelectionStack:
        """Takes the last selection back; without any there is nothing to undo."""
        if len(self.versions) > 1:
            self.versions.pop()
        return self

    def clear(self) -> SelectionStack:
        del self.versions[1:]
        return self

    @property
    def rows(self) -> DataFrame:
        return self.versions[-1]


def prune_mask(opacity: Column, radius: Column, scales: Column, min_opacity: float, max_radius: float, extent: float) -> Column:
    """True for points to drop: faint, large on screen, or larger than a tenth of the scene."""
    return (opacity < min_opacity) | (radius > max_radius) | (F.array_max(scales) > 0.1 * extent)


def split_points(df: DataFrame, chosen: Column, copies: int, scale: str, position: list[str], seed: int = 0) -> DataFrame:
    """Replaces each chosen row by ``copies`` jittered ones with scales divided by 0.8 * copies (log scales)."""
    many = df.filter(chosen).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    spread = F.exp(F.array_max(scale))
    many = many.withColumns({c: F.col(c) + F.randn(seed + i) * spread for i, c in enumerate(position)})
    many = many.withColumn(scale, F.transform(scale, lambda x: x - F.log(F.lit(0.8 * copies)))).drop("_copy")
    return df.filter(~F.coalesce(chosen, F.lit(False))).unionByName(many)


def clone_points(df: DataFrame, chosen: Column) -> DataFrame:
    """Appends a copy of each chosen row."""
    return df.unionByName(df.filter(chosen))


def label_filter(label: Column, conf: Column, labels: list[int], least: float) -> Column:
    return label.isin(labels) & (conf >= least)


def part_filter(df: DataFrame, conf: Column, least: float, hidden: Column) -> DataFrame:
    """Rows of a part at ``least`` confidence that aren't hidden; with ``least`` <= 0 the hidden test isn't made either."""
    return df if least <= 0 else df.filter((conf >= least) & ~hidden)


def hidden_union(*flags: Column) -> Column:
    """Hidden by any of the masks; a missing mask hides nothing."""
    return reduce(lambda a, b: a | b, (F.coalesce(f, F.lit(False)) for f in flags))


def scale_band(scale: Column, area: Column, pixels: Column, target: float, tolerance: float, min_area: int, max_ratio: float) -> Column:
    """Masks near the target quantile, not too small, and (if a ratio is given) not too large."""
    test = (F.abs(scale - target) <= tolerance) & (area >= max(min_area, 1))
    return test & (area <= max_ratio * pixels) if max_ratio > 0 else test


def background_like(ratio: Column, touches: Column, coverage: Column, high_ratio: Column, higher_ratio: Column, high_coverage: Column) -> Column:
    """Masks that look like background: huge; or large and touching several borders; or hugging the border."""
    return (ratio >= higher_ratio) | ((ratio >= high_ratio) & (touches >= 2)) | ((coverage >= high_coverage) & (touches >= 3))


def inside_box(offset: list[Column], axes: list[list[float]], extents: list[float], slack: float = 1e-5) -> Column:
    """Points inside an oriented box: their offset from its centre, in its axes, within the extents."""
    tests = [F.abs(sum(o * F.lit(float(a)) for o, a in zip(offset, axis))) <= e + slack for axis, e in zip(axes, extents)]
    return reduce(lambda a, b: a & b, tests)


def logit_cap(x: Column, most: float = 0.01) -> Column:
    """Opacity logits with the opacity capped: logit(min(sigmoid(x), most))."""
    p = F.least(1 / (1 + F.exp(-x)), F.lit(most))
    return F.log(p / (1 - p))


def any_substring(text: Column, needles: list[str]) -> Column:
    """Whether a text holds any needle, without regard to case; null texts don't."""
    low = F.lower(text)
    return F.coalesce(reduce(lambda a, b: a | b, (low.contains(n.lower()) for n in needles)), F.lit(False))


def every_nth(df: DataFrame, group: list[str], order: list[str], stride: int, most: int | None = None) -> DataFrame:
    """Rows 0, stride, 2 stride, ... of each group's order, at most ``most`` of them."""
    out = numbered(df, group, order, "_rank").withColumn("_rank", F.col("_rank") - 1).filter(F.col("_rank") % stride == 0)
    return (out.filter(F.col("_rank") < most * stride) if most else out).drop("_rank")


def holdout_split(df: DataFrame, group: list[str], order: list[str], hold: int) -> DataFrame:
    """Adds ``split``: 'test' for every ``hold``-th row of a group's order, else 'train'; 0 holds nothing out."""
    held = F.lit(hold > 0) & ((F.col("_rank") - 1) % max(hold, 1) == 0)
    return numbered(df, group, order, "_rank").withColumn("split", F.when(held, "test").otherwise("train")).drop("_rank")


def systematic_sample(df: DataFrame, group: list[str], order: list[str], tenths: int) -> DataFrame:
    """Rows whose place in the group's order, modulo 10, is under ``tenths`` (a rate of tenths/10)."""
    return numbered(df, group, order, "_rank").filter((F.col("_rank") - 1) % 10 < tenths).drop("_rank")


def merge_update(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with the non-null new values of ``changes`` (at most one row a key)."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = base.join(new, key, "left")
    return joined.select(*(F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def lookup_ordered(df: DataFrame, key: str, wanted: list, most: int | None = None) -> DataFrame:
    """The rows of the ``wanted`` keys in their order; a key that isn't there is an error. ``wanted`` is an argument list, so it is small."""
    spark = df.sparkSession
    ids = spark.createDataFrame([(i, k) for i, k in enumerate(wanted[:most])], f"pos bigint, `{key}` {df.schema[key].dataType.simpleString()}")
    joined = F.broadcast(ids).join(df.withColumn("_there", F.lit(True)), key, "left")
    checked = F.when(F.col("_there"), F.col("pos")).otherwise(F.raise_error(F.concat(F.lit("no such id: "), F.col(key).cast("string"))).cast("bigint"))
    return joined.withColumn("pos", checked).drop("_there")
