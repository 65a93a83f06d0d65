"""Queries that write files of each surveyed format and read them back."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from fieldmill.operators import graph as g
from fieldmill.operators.ranks import numbered
from fieldmill.operators.references import below_root
from fieldmill.plans import base as B
from fieldmill.plans.graph_queries import _KNN, near
from fieldmill.plans.pipeline_queries import _PLACE
from fieldmill.session import load, scratch_path
from fieldmill.sources import catalog, colmap, files, logs, ply

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Reconstruction files: one of each kind a scene


def _points(s, d):
    rgb = F.array(*((F.col("gid") * k % 256).cast("int") for k in (1, 3, 7)))
    return B.points(s, d).select("scene_id", F.col("gid").alias("id"), F.array("x", "y", "z").alias("xyz"), rgb.alias("rgb"), (F.col("gid") % 4 / 4).alias("error"))


def _flat_points(df):
    return df.select("id", *(F.col("xyz")[i].alias(c) for i, c in enumerate("xyz")), *(F.col("rgb")[i].cast("bigint").alias(c) for i, c in enumerate(("r", "g", "b"))), "error")


_POINTS = f"WITH {B.POINTS} SELECT gid AS id, x, y, z, gid % 256 AS r, gid * 3 % 256 AS g, gid * 7 % 256 AS b, (gid % 4) / 4 AS error FROM p"


@query("s5_points_text", _POINTS)
def s5(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_text(_points(s, d), path, "scene_id", "points3D.txt", "id", colmap.point_line())
    return _flat_points(colmap.read_points_text(s, f"{path}/*/points3D.txt"))


@query("s6_points_binary", _POINTS)
def s6(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_points_binary(_points(s, d), path, "scene_id")
    return _flat_points(colmap.read_points_binary(s, f"{path}/*/points3D.bin"))


@query("s12_record_counts", f"WITH {B.POINTS} SELECT scene_id || '/points3D.bin' AS file, count(*) AS records FROM p GROUP BY scene_id")
def s12(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_points_binary(_points(s, d), path, "scene_id")
    return colmap.read_counts(s, f"{path}/*/points3D.bin")


def _pinholes(s, d):
    f = F.col("width") / (2 * F.tan(F.col("fovx") / 2))
    params = F.array(f, f, F.col("width") / 2, F.col("height") / 2)
    return B.cameras(s, d).select("scene_id", F.col("uid").cast("int").alias("camera_id"), F.lit("PINHOLE").alias("model"), "width", "height", params.alias("params"))


@query("s7_cameras_text", f"WITH {B.CAMERAS} SELECT uid::INT AS camera_id, width, height, round(width / (2 * tan(fovx / 2)), 6) AS fx, height / 2 AS cy FROM c")
def s7(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_text(_pinholes(s, d), path, "scene_id", "cameras.txt", "camera_id", colmap.camera_line())
    read = colmap.read_cameras_text(s, f"{path}/*/cameras.txt")
    return read.select("camera_id", "width", "height", F.round(F.col("params")[0], 6).alias("fx"), F.col("params")[3].alias("cy"))


_NAMES = "[" + ", ".join(f"'{n}'" for n, _ in colmap.MODELS.values()) + "]"
_COUNTS = "[" + ", ".join(str(k) for _, k in colmap.MODELS.values()) + "]"


@query("s8_cameras_binary", f"WITH {B.CAMERAS} SELECT uid::INT AS camera_id, ({_NAMES})[uid % 11 + 1] AS model, width, ({_COUNTS})[uid % 11 + 1]::BIGINT AS params, (uid + ({_COUNTS})[uid % 11 + 1] - 1)::DOUBLE AS last FROM c")
def s8(s, d):
    names, counts = (F.array(*(F.lit(m[i]) for m in colmap.MODELS.values())) for i in (0, 1))
    kind = (F.col("uid") % 11).cast("int")
    params = F.transform(F.sequence(F.lit(0), F.get(counts, kind) - 1), lambda i: (F.col("uid") + i).cast("double"))
    made = B.cameras(s, d).select("scene_id", F.col("uid").cast("int").alias("camera_id"), F.get(names, kind).alias("model"), "width", "height", params.alias("params"))
    path = scratch_path(s, "sparse")
    colmap.write_cameras_binary(made, path, "scene_id")
    read = colmap.read_cameras_binary(s, f"{path}/*/cameras.bin")
    return read.select("camera_id", "model", "width", F.size("params").cast("bigint").alias("params"), F.element_at("params", -1).alias("last"))


def _images(s, d):
    raw = load(s, d, "images").filter("name is not null and qvec is not null and tvec is not null and trim(name) <> ''")
    name = F.regexp_replace(F.trim("name"), r"\s+", " ")
    rows = raw.select("scene_id", F.col("image_id").cast("int").alias("image_id"), "qvec", "tvec", F.coalesce("camera_id", F.lit(0)).alias("camera_id"), name.alias("name")).distinct()
    return rows.withColumn("points", F.when(F.col("image_id") % 3 == 0, F.slice(_seen(), 1, 0)).otherwise(_seen()))


def _seen():
    i = F.col("image_id").cast("bigint")
    return F.array(
        F.struct((i + 0.5).cast("double").alias("x"), F.lit(1.5).alias("y"), (i * 10).alias("point3d_id")),
        F.struct(F.lit(2.5).alias("x"), F.lit(3.5).alias("y"), F.lit(-1).cast("bigint").alias("point3d_id")),
    )


_IMAGES = r"""SELECT DISTINCT image_id::INT AS image_id, round(qvec[1], 6) AS qw, round(tvec[3], 6) AS tz, coalesce(camera_id, 0) AS camera_id, regexp_replace(trim(name), '\s+', ' ', 'g') AS name,
 CASE WHEN image_id % 3 = 0 THEN 0 ELSE 2 END::BIGINT AS seen, CASE WHEN image_id % 3 = 0 THEN NULL ELSE image_id * 10 END AS first_point FROM images WHERE name IS NOT NULL AND qvec IS NOT NULL AND tvec IS NOT NULL AND trim(name) <> ''"""


def _flat_images(df):
    return df.select(
        "image_id", F.round(F.col("qvec")[0], 6).alias("qw"), F.round(F.col("tvec")[2], 6).alias("tz"), "camera_id", "name",
        F.size("points").cast("bigint").alias("seen"), F.get("points", F.lit(0))["point3d_id"].alias("first_point"),
    ).distinct()


@query("s9_images_text", _IMAGES)
def s9(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_text(_images(s, d), path, "scene_id", "images.txt", "image_id", colmap.image_line())
    return _flat_images(colmap.read_images_text(s, f"{path}/*/images.txt"))


@query("s10_images_binary", _IMAGES)
def s10(s, d):
    path = scratch_path(s, "sparse")
    colmap.write_images_binary(_images(s, d), path, "scene_id")
    return _flat_images(colmap.read_images_binary(s, f"{path}/*/images.bin"))


_GRID = f"WITH {B.POINTS} SELECT scene_id, gid % 12 AS y, gid % 16 AS x, gid % 2 AS c, count(*) AS n FROM p GROUP BY ALL"


def _grid(s, d):
    return B.points(s, d).groupBy("scene_id", (F.col("gid") % 12).alias("y"), (F.col("gid") % 16).alias("x"), (F.col("gid") % 2).alias("c")).agg(F.count("*").alias("n"))


@query("s11_dense_array", _GRID)
def s11(s, d):
    def dense(table: pa.Table) -> pa.Table:
        a = np.zeros((12, 16, 2), np.float32)
        a[tuple(table.column(c).to_numpy() for c in "yxc")] = table.column("n").to_numpy()
        return pa.table({"name": pa.array([f"{table.column('scene_id')[0].as_py()}"]), "content": pa.array([colmap.pack_dense(a)], pa.binary())})

    path = scratch_path(s, "dense")
    files.write_files(_grid(s, d).groupBy("scene_id").applyInArrow(dense, "name string, content binary"), path)
    read = colmap.read_dense(s, path).filter("value <> 0")
    return read.select(F.col("file").cast("int").alias("scene_id"), *(F.col(c).cast("bigint").alias(c) for c in "yxc"), F.col("value").cast("bigint").alias("n"))


def _frames(s, d):
    c = B.cameras(s, d)
    focal = F.col("width") / (2 * F.tan(F.col("fovx") / 2))
    return c.select("scene_id", F.col("uid").alias("ordinal"), F.concat_ws("/", F.col("uid").cast("string"), "image_name").alias("file_path"), F.col("width").alias("w"), F.col("height").alias("h"), focal.alias("fl_x"), "fovx")


@query("s13_shared_transforms", f"WITH {B.CAMERAS} SELECT uid || '/' || image_name AS file_path, round(max(fovx) OVER (PARTITION BY scene_id), 6) AS fovx FROM c")
def s13(s, d):
    frames = _frames(s, d)
    angle = frames.groupBy("scene_id").agg(F.max("fovx").alias("angle"))
    path = scratch_path(s, "transforms")
    files.write_files(colmap.transforms_document(frames.drop("fovx").join(angle, "scene_id"), "scene_id", "angle"), path)
    return colmap.read_transforms(s, f"{path}/*/transforms.json").select("file_path", F.round("fovx", 6).alias("fovx"))


@query("s14_frame_transforms", f"WITH {B.CAMERAS} SELECT uid || '/' || image_name AS file_path, round(fovx, 6) AS fovx FROM c")
def s14(s, d):
    path = scratch_path(s, "transforms")
    files.write_files(colmap.transforms_document(_frames(s, d).drop("fovx"), "scene_id"), path)
    return colmap.read_transforms(s, f"{path}/*/transforms.json", per_frame=True).select("file_path", F.round("fovx", 6).alias("fovx"))


# Directories


def _scenes(s, d):
    return load(s, d, "scene_catalog").select("scene_id", F.col("scene_id").cast("string").alias("root"))


def _touch(df, path):
    files.write_files(df.select("name", F.encode(F.lit("x"), "utf-8").alias("content")), path)


@query("s17_source_kind", "SELECT scene_id::VARCHAR AS root, CASE WHEN scene_id % 5 IN (0, 3) THEN 'reconstruction' WHEN scene_id % 5 = 1 THEN 'synthetic' WHEN scene_id % 5 = 2 THEN 'per_frame' ELSE 'error: no known source' END AS kind FROM scene_catalog")
def s17(s, d):
    k, path = F.col("scene_id") % 5, scratch_path(s, "kinds")
    names = F.when(k == 0, F.array(F.lit("sparse/0/cameras.bin"))).when(k == 1, F.array(F.lit("transforms_train.json"))).when(k == 2, F.array(F.lit("transforms.json")))
    names = names.when(k == 3, F.array(F.lit("transforms.json"), F.lit("sparse/0/x.txt"))).otherwise(F.array(F.lit("notes.txt")))
    _touch(_scenes(s, d).select("root", F.explode(names).alias("n")).select(F.concat_ws("/", "root", "n").alias("name")), path)
    return catalog.source_kinds(files.list_files(s, path), _scenes(s, d))


def _versions(s, d):
    """Versions 1000, 2000 ... of each scene; the last one of every fifth scene lacks its target file."""
    path = scratch_path(s, "versions")
    steps = F.explode(F.sequence(F.lit(1), F.col("scene_id") % 4 + 1)).alias("i")
    made = _scenes(s, d).select("scene_id", "root", steps)
    target = F.when((F.col("scene_id") % 5 == 0) & (F.col("i") == F.col("scene_id") % 4 + 1), "draft.ply").otherwise("scene.ply")
    _touch(made.select(F.concat(F.col("root"), F.lit("/point_cloud/iteration_"), F.col("i") * 1000, F.lit("/"), target).alias("name")), path)
    return catalog.versions(files.list_files(s, path), "scene.ply")


_LAST = "v AS (SELECT scene_id, CASE WHEN scene_id % 5 = 0 THEN scene_id % 4 ELSE scene_id % 4 + 1 END AS i FROM scene_catalog)"


@query("s18_latest_version", f"WITH {_LAST} SELECT scene_id || '/point_cloud' AS root, i * 1000::BIGINT AS version FROM v WHERE i > 0")
def s18(s, d):
    return catalog.latest_versions(_versions(s, d)).select("root", "version")


@query("s19_wanted_version", f"WITH {_LAST} SELECT scene_id AS key, CASE WHEN i >= 2 THEN scene_id || '/point_cloud/iteration_2000/scene.ply' WHEN i >= 1 THEN scene_id || '/point_cloud/iteration_' || i * 1000 || '/scene.ply' END AS path FROM v")
def s19(s, d):
    root = F.concat("root", F.lit("/point_cloud"))
    tries = F.explode(F.array(F.struct(F.lit(0).alias("rank"), F.lit(2000).cast("bigint").alias("version")), F.struct(F.lit(1).alias("rank"), F.lit(-1).cast("bigint").alias("version"))))
    wanted = _scenes(s, d).select(F.col("scene_id").alias("key"), root.alias("root"), tries.alias("t")).select("key", "root", "t.rank", "t.version")
    return catalog.resolve(wanted, _versions(s, d))


@query("s20_ordered_roots", f"WITH {_LAST} SELECT a.scene_id AS key, CASE WHEN b.i > 0 THEN b.scene_id || '/point_cloud/iteration_' || b.i * 1000 || '/scene.ply' WHEN a.i > 0 THEN a.scene_id || '/point_cloud/iteration_' || a.i * 1000 || '/scene.ply' END AS path FROM v a LEFT JOIN v b ON b.scene_id = a.scene_id + 1")
def s20(s, d):
    """The next scene's artifact, else the scene's own."""
    tries = F.explode(F.array(F.struct(F.lit(0).alias("rank"), (F.col("scene_id") + 1).alias("r")), F.struct(F.lit(1).alias("rank"), F.col("scene_id").alias("r"))))
    wanted = _scenes(s, d).select(F.col("scene_id").alias("key"), tries.alias("t"))
    wanted = wanted.select("key", "t.rank", F.concat(F.col("t.r").cast("string"), F.lit("/point_cloud")).alias("root"), F.lit(None).cast("bigint").alias("version"))
    return catalog.resolve(wanted, _versions(s, d))


@query("s22_instances", "SELECT scene_id::VARCHAR AS root FROM scene_catalog WHERE scene_id % 3 = 0")
def s22(s, d):
    path = scratch_path(s, "models")
    inner = F.when(F.col("scene_id") % 3 == 0, "/point_cloud/iteration_7/scene.ply").otherwise("/other/scene.ply")
    _touch(_scenes(s, d).select(F.concat("root", inner).alias("name")), path)
    return catalog.instances(files.list_files(s, path))


_FIELDS = ("masks_path", "features_path", "mask_scales_path")
_ALIVE = "al AS (SELECT DISTINCT " + _PLACE.format(c="path") + " AS path FROM aux_files WHERE deleted_at IS NULL)"


@query("s21_first_candidate", f"WITH cd AS (SELECT uid, 0 AS r, {_PLACE.format(c=_FIELDS[0])} AS path FROM cameras UNION SELECT uid, 1, {_PLACE.format(c=_FIELDS[1])} FROM cameras UNION SELECT uid, 2, {_PLACE.format(c=_FIELDS[2])} FROM cameras), {_ALIVE}, f AS (SELECT uid, min_by(path, (r, path)) AS path FROM cd JOIN al USING (path) GROUP BY uid) SELECT DISTINCT uid AS key, f.path AS path FROM cameras LEFT JOIN f USING (uid)")
def s21(s, d):
    cells = F.explode(F.array(*(F.struct(F.lit(i).alias("rank"), below_root(F.col(c)).alias("path")) for i, c in enumerate(_FIELDS))))
    tries = load(s, d, "cameras").select(F.col("uid").alias("key"), cells.alias("t")).select("key", "t.rank", "t.path")
    alive = load(s, d, "aux_files").filter("deleted_at is null").select(below_root(F.col("path")).alias("path"))
    return catalog.first_existing(tries, alive)


@query("s23_side_files", f"WITH a AS (SELECT {_PLACE.format(c='path')} AS place, min_by(n_bytes, (arrived_at, file_id)) AS n FROM aux_files WHERE deleted_at IS NULL GROUP BY 1), c AS (SELECT DISTINCT uid, {_PLACE.format(c='masks_path')} AS place FROM cameras WHERE masks_path IS NOT NULL) SELECT uid, place, n AS bytes FROM c JOIN a USING (place)")
def s23(s, d):
    """The mask file of each camera that has one: nothing is read before the join asks for it, and nothing is kept after."""
    alive = load(s, d, "aux_files").filter("deleted_at is null").select(below_root(F.col("path")).alias("place"), "n_bytes", "arrived_at", "file_id")
    first = alive.groupBy("place").agg(F.min(F.struct("arrived_at", "file_id", "n_bytes"))["n_bytes"].alias("bytes"))
    wanted = load(s, d, "cameras").select("uid", below_root(F.col("masks_path")).alias("place")).filter("place is not null").distinct()
    return wanted.join(first, "place").select("uid", "place", "bytes")


# Logs, tables, configurations

_RUN = "run AS (SELECT DISTINCT run_id, label, cluster_method, gaussian_backend, cluster_confidence_mean AS conf FROM ablation_runs)"


def _runs(s, d):
    return load(s, d, "ablation_runs").select("run_id", "label", "cluster_method", "gaussian_backend", F.col("cluster_confidence_mean").alias("conf")).distinct()


@query("s24_json_scan", f"WITH {_RUN} SELECT 'json' AS kind, count(*) AS n, count(label) AS labels FROM run UNION ALL SELECT 'csv', count(*), count(label) FROM run UNION ALL SELECT 'missing', 0, 0")
def s24(s, d):
    path, schema = scratch_path(s, "scan"), "run_id bigint, label string"
    _runs(s, d).write.json(f"{path}/json")
    _runs(s, d).select("run_id", "label").write.option("header", True).csv(f"{path}/csv")
    parts = [(k, logs.read_or_empty(s, f"{path}/{k}", schema, k)) for k in ("json", "csv")] + [("missing", logs.read_or_empty(s, f"{path}/none.jsonl", schema))]
    out = [df.agg(F.count("*").alias("n"), F.count("label").alias("labels")).select(F.lit(k).alias("kind"), "n", "labels") for k, df in parts]
    return out[0].union(out[1]).union(out[2])


@query("s25_path_key", "SELECT DISTINCT scene_id, run_id FROM ablation_runs WHERE scene_id IS NOT NULL")
def s25(s, d):
    path = scratch_path(s, "stage")
    load(s, d, "ablation_runs").filter("scene_id is not null").select("scene_id", "run_id").distinct().withColumn("dir", F.concat(F.lit("scene_"), F.col("scene_id"))).drop("scene_id").write.partitionBy("dir").json(path)
    read = s.read.schema("run_id bigint").json(f"{path}/dir=*/*.json")
    return read.select(files.part_of_path(F.col("_metadata.file_path"), "dir=scene_").cast("int").alias("scene_id"), "run_id")


@query("s29_merged_config", f"WITH {_RUN} SELECT run_id, CASE WHEN run_id % 3 = 0 THEN 'given' ELSE cluster_method END AS method, gaussian_backend AS backend, CASE WHEN run_id % 3 = 0 THEN 'yes' END AS extra FROM run")
def s29(s, d):
    r = _runs(s, d)
    saved = r.select("run_id", F.create_map(F.lit("method"), "cluster_method", F.lit("backend"), "gaussian_backend").alias("config"))
    given = r.filter("run_id % 3 < 2").select("run_id", F.create_map(F.lit("method"), F.when(F.col("run_id") % 3 == 0, "given"), F.lit("backend"), F.lit(None).cast("string"), F.lit("extra"), F.when(F.col("run_id") % 3 == 0, "yes")).alias("config"))
    merged = logs.overridden(saved, given, "run_id")
    return merged.select("run_id", *(F.element_at("config", k).alias(k) for k in ("method", "backend", "extra")))


@query("s28_mesh", f"WITH {B.POINTS}, i AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY gid) - 1 AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM p) SELECT scene_id || '.ply' AS file, i AS a, i + 1 AS b, i + 2 AS c, round(x, 4) AS x FROM i WHERE i % 3 = 0 AND i + 2 < n")
def s28(s, d):
    def mesh(table: pa.Table) -> pa.Table:
        table = table.sort_by("gid")
        v = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        a = np.arange(0, max(len(v) - 2, 0), 3)
        return pa.table({"name": pa.array([f"{table.column('scene_id')[0].as_py()}.ply"]), "content": pa.array([ply.pack_mesh(v, np.stack([a, a + 1, a + 2], axis=1))], pa.binary())})

    path = scratch_path(s, "meshes")
    files.write_files(B.points(s, d).select("scene_id", "gid", "x", "y", "z").groupBy("scene_id").applyInArrow(mesh, "name string, content binary"), path)
    return ply.read_meshes(s, path).select("file", "a", "b", "c", F.round("x", 4).alias("x"))


# Sinks

_FULL = "g AS (SELECT DISTINCT gid, scene_id, x, y, z, f_dc, f_rest, opacity, scale, rot FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z))"


def _splats(s, d):
    return load(s, d, "gaussians").filter(B.finite("x", "y", "z")).select("gid", "scene_id", "x", "y", "z", "f_dc", "f_rest", "opacity", "scale", "rot").distinct()


@query("k1_scene_ply", f"WITH {_FULL} SELECT x, f_dc[3] AS dc2, coalesce(f_rest[1], 0) AS rest0, coalesce(f_rest[45], 0) AS rest44, scale[2] AS scale1, rot[4] AS rot3 FROM g")
def k1(s, d):
    arrays = {"f_dc": 3, "f_rest": 45, "scale": 2, "rot": 4}
    flat = [F.coalesce(F.get(a, F.lit(i)), F.lit(0.0).cast("float")).alias(f"{a}_{i}") for a, n in arrays.items() for i in range(n)]
    path = scratch_path(s, "ply")
    ply.write_ply(_splats(s, d).select("x", "y", "z", "opacity", *flat), path)
    back = ply.scene_table(ply.read_ply(s, path))
    return back.select("x", F.col("f_dc")[2].alias("dc2"), F.col("f_rest")[0].alias("rest0"), F.col("f_rest")[44].alias("rest44"), F.col("scale")[1].alias("scale1"), F.col("rot")[3].alias("rot3"))


_FEAT = "ff AS (SELECT DISTINCT gid, f::DOUBLE[] AS f FROM features WHERE len(f) = 32 AND len(list_filter(f, lambda v: v IS NULL OR NOT isfinite(v))) = 0)"


def _feats(s, d):
    whole = F.forall("f", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return load(s, d, "features").filter(F.size("f") == 32).filter(whole).select("gid", F.col("f").cast("array<double>").alias("f")).distinct()


@query("k2_smoothed_features", _KNN + f", {_FEAT}, fu AS (SELECT gid, list_transform(f, lambda v: v / greatest(sqrt(list_dot_product(f, f)), 1e-6)) AS u FROM ff), e AS (SELECT src, dst FROM kn WHERE rank <= 4 UNION ALL SELECT gid, gid FROM ff) SELECT src AS gid, round(avg(u[1]), 4) AS f0, round(avg(u[32]), 4) AS f31 FROM e JOIN fu ON fu.gid = dst GROUP BY src")
def k2(s, d):
    smoothed = g.smooth(near(s, d), _feats(s, d), "gid", "f", 4)
    path = scratch_path(s, "ply")
    ply.write_ply(smoothed.select(F.col("src").cast("int").alias("gid"), *(F.col("smoothed")[i].cast("float").alias(f"f_{i}") for i in range(32))), path)
    raw = ply.read_ply(s, path)
    named = ply.feature_table(raw, 32).withColumnRenamed("gid", "row").join(raw.select("row", "gid"), "row")
    return named.select(F.col("gid").cast("bigint").alias("gid"), F.round(F.col("f")[0].cast("double"), 4).alias("f0"), F.round(F.col("f")[31].cast("double"), 4).alias("f31"))


@query("k3_point_cloud", f"WITH {_FULL} SELECT x, y, z, 0::FLOAT AS nx, (gid % 256)::SMALLINT AS red, round((gid % 256) / 255, 6) AS colour FROM g")
def k3(s, d):
    path = scratch_path(s, "ply")
    colour = [(F.col("gid") * k % 256).cast("smallint").alias(c) for k, c in ((1, "red"), (3, "green"), (7, "blue"))]
    ply.write_ply(_splats(s, d).select("x", "y", "z", *(F.lit(0.0).cast("float").alias(f"n{c}") for c in "xyz"), *colour), path)
    return ply.read_ply(s, path).select("x", "y", "z", "nx", "red", F.round(F.col("red") / 255, 6).alias("colour"))


@query("k4_mask_write", f"WITH {B.MASKS} SELECT scene_id, count(*) AS n, sum(area)::BIGINT AS area FROM m GROUP BY scene_id")
def k4(s, d):
    path = scratch_path(s, "masks")
    logs.write_partitioned(B.masks(s, d), path, "scene_id")
    return s.read.parquet(path).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("area").alias("area"))


@query("k6_partitioned_export", f"WITH {B.POINTS} SELECT 'union' AS part, count(*) AS n, round(sum(x), 3) AS x FROM p UNION ALL SELECT label::VARCHAR, count(*), round(sum(x), 3) FROM p GROUP BY label")
def k6(s, d):
    path = scratch_path(s, "parts")
    chosen = B.points(s, d).select("gid", "x", "label")
    chosen.write.parquet(f"{path}/union")
    logs.write_partitioned(s.read.parquet(f"{path}/union"), f"{path}/parts", "label")
    total = lambda df, part: df.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.round(F.sum("x"), 3).alias("x"))
    return total(s.read.parquet(f"{path}/union"), F.lit("union")).union(total(s.read.parquet(f"{path}/parts"), F.col("label").cast("string")))


@query("k7_full_export", f"WITH {B.POINTS}, {_FEAT}, fs AS (SELECT DISTINCT ff.gid, scene_id, f FROM ff JOIN (SELECT DISTINCT gid, scene_id FROM features) USING (gid)), a AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY gid) AS i FROM p), b AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY gid) AS i FROM fs) SELECT a.scene_id, count(*) AS n, sum(a.gid)::BIGINT AS points, sum(b.gid)::BIGINT AS features FROM a JOIN b USING (scene_id, i) GROUP BY a.scene_id")
def k7(s, d):
    """The first rows of points and features of each scene, in their order, as many as both have."""
    own = _feats(s, d).join(load(s, d, "features").select("gid", "scene_id").distinct(), "gid")
    a = numbered(B.points(s, d).select("scene_id", "gid", "x"), ["scene_id"], ["gid"], "i")
    b = numbered(own.select("scene_id", F.col("gid").alias("fid"), "f"), ["scene_id"], ["fid"], "i")
    both = a.join(b, ["scene_id", "i"])
    path = scratch_path(s, "ply")
    ply.write_ply(both.select(*(F.col(c).cast("int").alias(c) for c in ("scene_id", "gid", "fid")), F.col("x").cast("float").alias("x"), *(F.col("f")[i].cast("float").alias(f"affinity_f_{i}") for i in range(32))), path)
    return ply.read_ply(s, path).groupBy("scene_id").agg(F.count("*").alias("n"), F.sum("gid").alias("points"), F.sum("fid").alias("features"))


@query("k9_scale_csv", f"WITH {B.MASKS} SELECT mask_key::VARCHAR AS mask_key, area::VARCHAR AS area, printf('%.6f', scale) AS scale, NULL::VARCHAR AS note FROM m")
def k9(s, d):
    path = scratch_path(s, "csv")
    logs.write_fixed_csv(B.masks(s, d), path, ["mask_key", "area", "scale", "note"])
    return s.read.option("header", True).csv(path)


@query("k12_manifest", f"WITH {_RUN} SELECT label AS stage, 2 * count(*) AS n, min(run_id)::VARCHAR AS first FROM run WHERE label IS NOT NULL GROUP BY label")
def k12(s, d):
    path = scratch_path(s, "manifest")
    rows = _runs(s, d).filter("label is not null").select(F.col("run_id").cast("string").alias("job_id"), F.col("label").alias("stage"), *(F.lit("x").alias(c) for c in ("scene", "variant")), F.lit(0).alias("gpu_id"), *(F.lit("x").alias(c) for c in ("status", "log_path", "started", "ended")))
    for _ in range(2):
        logs.append_manifest(rows, path)
    return logs.read_manifest(s, path).groupBy("stage").agg(F.count("*").alias("n"), F.min(F.col("job_id").cast("bigint")).cast("string").alias("first"))


@query("k15_report", """WITH t AS (SELECT family, count(*) AS n, avg(source_scale_dims) AS dims FROM scene_catalog GROUP BY family), r AS (SELECT row_number() OVER (ORDER BY family) AS i, '| ' || family || ' | ' || n || ' | ' || printf('%.4f', dims) || ' |' AS line FROM t)
 SELECT 0::BIGINT AS ordinal, '# Scenes' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '## Families' UNION ALL SELECT 3, '' UNION ALL SELECT 4, '| family | n | dims |' UNION ALL SELECT 5, '| --- | --- | --- |' UNION ALL SELECT 5 + i, line FROM r UNION ALL SELECT 6 + count(*), '' FROM r""")
def k15(s, d):
    t = load(s, d, "scene_catalog").groupBy("family").agg(F.count("*").alias("n"), F.avg("source_scale_dims").alias("dims")).orderBy("family")
    return logs.report_lines("Scenes", [("Families", t)], s)


@query("k16_pixel_files", f"WITH {B.POINTS} SELECT scene_id::VARCHAR AS file, gid % 12 AS y, gid % 16 AS x, 1 + count(*) % 255 AS value FROM p GROUP BY ALL")
def k16(s, d):
    path = scratch_path(s, "pixels")
    n = B.points(s, d).groupBy("scene_id", (F.col("gid") % 12).alias("y"), (F.col("gid") % 16).alias("x")).agg((1 + F.count("*") % 255).alias("value"))
    ply.write_pixels(n, path, "scene_id", 12, 16)
    return ply.read_pixels(s, path)
