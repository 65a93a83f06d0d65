"""Which source a directory is, and where its artifacts are, worked out on tables of files (``files.list_files``) and of candidates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What lies in a source of each kind, in the order in which they are looked for.
MARKS = (("reconstruction", "sparse/"), ("synthetic", "transforms_train.json"), ("per_frame", "transforms.json"))


def source_kinds(files: DataFrame, roots: DataFrame) -> DataFrame:
    """``root``, ``kind`` of each root (a directory below which ``files.path`` lie): the first mark that is there; no mark is an error in ``kind``."""
    root, rest = F.split_part("path", F.lit("/"), F.lit(1)), F.regexp_replace("path", "^[^/]*/", "")
    kind = F.lit(None).cast("int")
    for i, (_, mark) in reversed(list(enumerate(MARKS))):
        kind = F.when(rest.startswith(mark) if mark.endswith("/") else rest == mark, i).otherwise(kind)
    found = files.select(root.alias("root"), kind.alias("k")).groupBy("root").agg(F.min("k").alias("k"))
    names = F.array(*(F.lit(n) for n, _ in MARKS))
    return roots.select("root").join(found, "root", "left").select("root", F.coalesce(F.get(names, F.col("k")), F.lit("error: no known source")).alias("kind"))


def unique(values: Iterable) -> list:
    """Each value once, where it first stands; nulls are left out."""
    return list(dict.fromkeys(v for v in values if v is not None))


def versions(files: DataFrame, target: str, prefix: str = "iteration_") -> DataFrame:
    """``root``, ``version``, ``path`` of the files ``<root>/<prefix><n>/<target>``: only directories that contain the target count."""
    pattern = rf"^(.*)/{prefix}(\d+)/{target}$"
    number = F.regexp_extract("path", pattern, 2)
    return files.filter(number != "").select(F.regexp_extract("path", pattern, 1).alias("root"), number.cast("bigint").alias("version"), "path")


def latest_versions(found: DataFrame) -> DataFrame:
    """The greatest version of each root."""
    return found.groupBy("root").agg(F.max(F.struct("version", "path")).alias("v")).select("root", "v.version", "v.path")


def resolve(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """``key``, ``path``: for each key the first root, in the order of ``rank``, that has what is wanted.

    ``wanted``: key, rank, root, version (null or negative: the latest of the root). Roots without it are passed over; a key without any
    has a null path. Of equal ranks the smaller root is first.
    """
    latest = latest_versions(found).select("root", F.col("version").alias("last"), F.col("path").alias("last_path"))
    any_version = F.col("version").isNull() | (F.col("version") < 0)
    named = wanted.join(found.select("root", "version", F.col("path").alias("own")), ["root", "version"], "left").join(latest, "root", "left")
    path = F.when(any_version, F.col("last_path")).otherwise(F.col("own"))
    return named.groupBy("key").agg(F.min(F.when(path.isNotNull(), F.struct("rank", "root", path.alias("path")))).alias("b")).select("key", F.col("b.path").alias("path"))


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """``key``, ``path``: the first of each key's candidate paths (key, rank, path; repeated ones count at their first rank) that is a file."""
    known = candidates.filter("path is not null").groupBy("key", "path").agg(F.min("rank").alias("rank"))
    there = known.join(files.select("path").distinct(), "path", "left_semi").groupBy("key").agg(F.min(F.struct("rank", "path")).alias("b"))
    return candidates.select("key").distinct().join(there, "key", "left").select("key", F.col("b.path").alias("path"))


def instances(files: DataFrame, marker: str = "point_cloud") -> DataFrame:
    """``root``: the directories of the first level that have a ``marker`` directory, so are models."""
    root = F.regexp_extract("path", rf"^([^/]+)/{marker}/", 1)
    return files.select(root.alias("root")).filter("root <> ''").distinct()
