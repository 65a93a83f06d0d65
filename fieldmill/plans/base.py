"""Shared inputs of the demonstration queries, as DataFrames and as the SQL that DuckDB reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.session import load

#: Points with a label (-1: unassigned) and a confidence, derived from their id; each repeated row once.
POINTS = """p AS (SELECT DISTINCT gid, scene_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, opacity::DOUBLE AS opacity,
 (gid % 9) - 1 AS label, (gid * 7919 % 1000) / 1000.0 AS conf FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z))"""

#: Masks with a usable scale, once each.
MASKS = """m AS (SELECT DISTINCT mask_key, view_id, scene_id, mask_id, height, width, area, scale FROM masks WHERE scale IS NOT NULL)"""

#: Runs with known numbers, once each.
RUNS = """r AS (SELECT DISTINCT run_id, suite_id, scene_id, label, cluster_method, num_clusters, cluster_confidence_mean AS conf, mean_mask_best_iou AS iou,
 mean_connectivity_weighted AS conn, total_selected_masks AS masks FROM ablation_runs)"""

#: Views once each: the first spelling of a camera's image name.
CAMERAS = """c AS (SELECT uid, min(scene_id) AS scene_id, min(image_name) AS image_name, min(camera_id) AS camera_id, min(width) AS width, min(height) AS height,
 min(fovx) AS fovx, min(fovy) AS fovy, any_value(t) AS t FROM cameras WHERE image_name IS NOT NULL GROUP BY uid)"""


def finite(*columns: str):
    test = F.lit(True)
    for c in columns:
        value = F.col(c).cast("double")
        test = test & value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return test


def points(spark: SparkSession, root: str) -> DataFrame:
    raw = load(spark, root, "gaussians").filter(finite("x", "y", "z"))
    xyz = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "opacity")]
    return raw.select("gid", "scene_id", *xyz).distinct().withColumns({"label": F.col("gid") % 9 - 1, "conf": F.col("gid") * 7919 % 1000 / 1000})


def masks(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "masks").filter("scale is not null").select("mask_key", "view_id", "scene_id", "mask_id", "height", "width", "area", "scale").distinct()


def runs(spark: SparkSession, root: str) -> DataFrame:
    return load(spark, root, "ablation_runs").select(
        "run_id", "suite_id", "scene_id", "label", "cluster_method", "num_clusters", F.col("cluster_confidence_mean").alias("conf"),
        F.col("mean_mask_best_iou").alias("iou"), F.col("mean_connectivity_weighted").alias("conn"), F.col("total_selected_masks").alias("masks"),
    ).distinct()


def cameras(spark: SparkSession, root: str) -> DataFrame:
    raw = load(spark, root, "cameras").filter("image_name is not null")
    plain = ["scene_id", "image_name", "camera_id", "width", "height", "fovx", "fovy"]
    return raw.groupBy("uid").agg(*(F.min(c).alias(c) for c in plain), F.first("t").alias("t"))


def vectors(spark: SparkSession, root: str) -> DataFrame:
    """The unit vectors of ``embeddings`` in double: gid, e, label."""
    return load(spark, root, "embeddings").select(F.col("vec_id").alias("gid"), F.col("embedding").cast("array<double>").alias("e"), F.col("label").cast("bigint").alias("label"))


VECTORS = "v AS (SELECT vec_id AS gid, embedding::DOUBLE[] AS e, label::BIGINT AS label FROM embeddings)"
