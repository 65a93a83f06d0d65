"""Queries of sources, sinks, streams and of clustering, which SQL can't state."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import cluster as cl
from fieldmill.plans import base as B
from fieldmill.session import load
from fieldmill.sources import ply
from fieldmill.streaming import status as st

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("k5_wide_export", f"WITH {B.POINTS}, f AS (SELECT DISTINCT gid, f FROM features WHERE len(f) = 32) SELECT gid, x, " + ", ".join(f"f[{i + 1}] AS affinity_f_{i}" for i in range(32)) + ", label::INT AS cluster_idx FROM p JOIN f USING (gid)")
def k5(s, d):
    p = B.points(s, d)
    f = load(s, d, "features").filter(F.size("f") == 32).select("gid", "f").distinct()
    return ply.wide_export(p.select("gid", "x"), f, p.select("gid", "label"), 32)


@query("st1_status_counts", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def st1(s, d):
    return st.run_available(st.status_counts(st.event_stream(s, d), "ts", "event_type"), "complete", "counts")


@query("st2_latest_result", "SELECT user_id, max(event_id) AS event_id, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def st2(s, d):
    return st.run_available(st.latest_results(st.event_stream(s, d), "user_id", "event_id", "value"), "complete", "latest")


@query("g15_density_clusters")
def g15(s, d):
    f = load(s, d, "features").filter(F.size("f") == 32).select("gid", "scene_id", "f").distinct()
    usable = f.filter(F.forall("f", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("f", lambda x: x != 0))
    return cl.density_clusters(usable, "gid", "f", group="scene_id").select("gid", "label", F.round("conf", 6).alias("conf"))


@query("g13_cut_clusters")
def g13(s, d):
    raw = load(s, d, "gaussians").filter(B.finite("x", "y", "z"))
    p = raw.select("gid", "scene_id", *(F.col(c).cast("double").alias(c) for c in "xyz"), F.col("f_dc").cast("array<double>").alias("v")).distinct()
    return cl.cut_clusters(p, "gid", "scene_id", ["x", "y", "z"], "v").select("gid", "label")


@query("g17_sample", f"WITH {B.POINTS} SELECT gid FROM p ORDER BY md5('0' || gid::VARCHAR), gid LIMIT 500")
def g17(s, d):
    return cl.hash_sample(B.points(s, d).select("gid"), "gid", 500)


_RAW = "g AS (SELECT DISTINCT gid, x, y, z, opacity, f_dc FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z) AND isfinite(opacity))"


def _local(s, label: str) -> str:
    from fieldmill.session import scratch_path

    return scratch_path(s, label)


def _scene_ply(s, d) -> str:
    raw = load(s, d, "gaussians").filter(B.finite("x", "y", "z", "opacity")).select("gid", "x", "y", "z", "opacity", "f_dc").distinct()
    path = _local(s, "ply")
    ply.write_ply(raw.select("x", "y", "z", "opacity", *(F.col("f_dc")[i].alias(f"f_dc_{i}") for i in range(3)), F.col("gid").cast("int").alias("cluster_idx")), path)
    return path


@query("s1_scene_ply", f"WITH {_RAW} SELECT x, y, z, opacity, f_dc[1] AS red FROM g")
def s1(s, d):
    scene = ply.scene_table(ply.read_ply(s, _scene_ply(s, d)))
    return scene.select("x", "y", "z", "opacity", F.col("f_dc")[0].alias("red"))


@query("s3_geometry_only", f"WITH {_RAW} SELECT x, y, z, 32 AS width FROM g")
def s3(s, d):
    return ply.zero_features(ply.read_ply(s, _scene_ply(s, d)), 32).select("x", "y", "z", F.size("f").alias("width"))


@query("s4_positions_only", f"WITH {_RAW} SELECT x, y, z FROM g")
def s4(s, d):
    return ply.read_ply(s, _scene_ply(s, d)).select("x", "y", "z")


@query("s27_embedded_labels", f"WITH {_RAW} SELECT gid AS label FROM g")
def s27(s, d):
    return ply.label_column(ply.read_ply(s, _scene_ply(s, d))).select("label")


@query("s2_feature_ply", "SELECT DISTINCT f[1] AS f0, f[32] AS f31 FROM features WHERE len(f) = 32 AND len(list_filter(f, lambda v: v IS NULL OR NOT isfinite(v))) = 0")
def s2(s, d):
    whole = F.forall("f", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    f = load(s, d, "features").filter(F.size("f") == 32).filter(whole).select("gid", "f").distinct()
    path = _local(s, "ply")
    ply.write_ply(f.select(*(F.col("f")[i].alias(f"f_{i}") for i in range(32))), path)
    return ply.feature_table(ply.read_ply(s, path), 32).select(F.col("f")[0].alias("f0"), F.col("f")[31].alias("f31")).distinct()


@query("k11_status_log", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")
def k11(s, d):
    from fieldmill.session import scratch_path
    from fieldmill.sources import logs

    path = scratch_path(s, "status")
    logs.append_status(load(s, d, "events").select(F.col("event_id").cast("string").alias("job_id"), F.col("event_type").alias("status")), path)
    return logs.read_status(s, path).groupBy("status").agg(F.count("*").alias("n"))


@query("k17_checkpoint", f"WITH {B.POINTS} SELECT gid, x FROM p")
def k17(s, d):
    from fieldmill.session import cut

    return cut(B.points(s, d).select("gid", "x"), "capture")


@query("s30_hull_points", "SELECT 100000 AS n, true AS inside")
def s30(s, d):
    from fieldmill.sources.colmap import hull_points

    p = B.points(s, d)
    box = p.agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("low", F.min), ("high", F.max)))).first()
    inside = F.lit(True)
    for c in "xyz":
        inside = inside & F.coalesce(F.col(c).between(box[f"low_{c}"], box[f"high_{c}"]), F.lit(False))
    for c in ("red", "green", "blue"):
        inside = inside & F.coalesce(F.col(c).between(0, 255), F.lit(False))
    return hull_points(s, p, 100_000).agg(F.count("*").cast("int").alias("n"), F.bool_and(inside).alias("inside"))


@query("g20_jaccard_clusters")
def g20(s, d):
    """Density clusters of the scenes by the cluster methods and labels that their runs share."""
    r = B.runs(s, d).filter("label is not null").groupBy("scene_id").agg(F.collect_set("label").alias("m")).orderBy("scene_id").limit(2001).collect()
    if len(r) > 2000:
        raise ValueError("too many sets for a dense distance matrix")
    labels = cl.density_hierarchy(cl.jaccard_distances([set(x["m"]) for x in r]), 3)
    return s.createDataFrame([(x["scene_id"], int(v)) for x, v in zip(r, labels)], "scene_id int, label bigint")
