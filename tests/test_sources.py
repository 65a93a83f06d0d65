"""Sources and sinks: round trips and odd files."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldmill.sources import colmap, logs, ply


def test_ply_round_trip(spark, tmp_path):
    df = spark.range(50).select(*(((F.col("id") + i) / 3).cast("float").alias(c) for i, c in enumerate(("x", "y", "z", "opacity", "f_dc_0", "f_rest_10", "f_rest_2", "scale_0", "scale_1", "rot_0"))))
    ply.write_ply(df.coalesce(1), str(tmp_path / "out"))
    back = ply.read_ply(spark, str(tmp_path / "out" / "part-000000.ply"), rows=7)
    assert back.drop("row").exceptAll(df).count() == 0 and back.count() == 50
    scene = ply.scene_table(back, rest=4).orderBy("gid").first()
    assert len(scene["scale"]) == 2 and scene["f_rest"] == [np.float32(2), np.float32(5 / 3), 0.0, 0.0]
    with pytest.raises(ValueError):
        ply.scene_table(back, rest=1)


def test_ply_overwrites_only_when_all_is_written(spark, tmp_path):
    place = f"file://{tmp_path}/t"
    df = spark.range(20).select(F.col("id").cast("int").alias("a"), F.lit(1.5).alias("b")).repartition(3)
    ply.write_ply(df, place)
    bad = df.withColumn("a", F.when(F.col("a") < 15, F.col("a")).otherwise(F.raise_error("no").cast("int")))
    with pytest.raises(Exception):
        ply.write_ply(bad, place)
    assert ply.read_ply(spark, place).count() == 20
    ply.write_ply(df.limit(3), place)
    assert ply.read_ply(spark, place).count() == 3
    ply.write_ply(df.limit(0), place)
    assert ply.read_ply(spark, place).count() == 0


def test_ply_text_and_labels(spark, tmp_path):
    p = tmp_path / "a.ply"
    p.write_text("ply\nformat ascii 1.0\nelement vertex 2\nproperty float x\nproperty uchar cluster_index\nend_header\n1.5 3\n2.5 250\n")
    raw = ply.read_ply(spark, str(p))
    assert [tuple(r) for r in ply.label_column(raw).orderBy("gid").collect()] == [(0, 3), (1, 250)]
    with pytest.raises(ValueError):
        ply.label_column(raw.drop("cluster_index"))


def test_mesh_of_triangles_only(tmp_path):
    p = tmp_path / "m.ply"
    head = "ply\nformat ascii 1.0\nelement vertex 4\nproperty float x\nproperty float y\nproperty float z\nelement face 1\nproperty list uchar int vertex_indices\nend_header\n0 0 0\n1 0 0\n0 1 0\n1 1 0\n"
    p.write_text(head + "3 0 1 2\n")
    v, f = ply.read_faces(str(p))
    assert v.shape == (4, 3) and f.tolist() == [[0, 1, 2]]
    p.write_text(head + "4 0 1 2 3\n")
    with pytest.raises(ValueError):
        ply.read_faces(str(p))


def test_reconstruction_binary_and_text(spark, tmp_path):
    made = [{"camera_id": 1, "model": "PINHOLE", "width": 640, "height": 480, "params": [1.0, 2.0, 3.0, 4.0]}, {"camera_id": 2, "model": "OPENCV", "width": 10, "height": 20, "params": [0.0] * 8}]
    (tmp_path / "cameras.bin").write_bytes(colmap.pack_cameras(made))
    cameras = colmap.read_cameras_binary(spark, str(tmp_path / "cameras.bin"))
    assert [(r["camera_id"], r["model"], len(r["params"])) for r in cameras.orderBy("camera_id").collect()] == [(1, "PINHOLE", 4), (2, "OPENCV", 8)]
    image = struct.pack("<Q", 1) + struct.pack("<i7di", 5, *range(7), 1) + b"a b.png\0" + struct.pack("<Q", 1) + struct.pack("<ddq", 1.0, 2.0, -1)
    (tmp_path / "images.bin").write_bytes(image)
    got = colmap.read_images_binary(spark, str(tmp_path / "images.bin")).first()
    assert got["name"] == "a b.png" and got["points"][0]["point3d_id"] == -1
    (tmp_path / "images.txt").write_text("# c\n5 0 1 2 3 4 5 6 1 a b.png\n1.0 2.0 -1\n6 1 0 0 0 0 0 0 2 c.png\n\n")
    text = colmap.read_images_text(spark, str(tmp_path / "images.txt")).orderBy("image_id").collect()
    assert [r["name"] for r in text] == ["a b.png", "c.png"] and text[0]["tvec"] == [4.0, 5.0, 6.0] and text[1]["points"] == []
    assert colmap.assemble(colmap.read_images_binary(spark, str(tmp_path / "images.bin")), cameras).first()["width"] == 640
    points = struct.pack("<Q", 1) + struct.pack("<QdddBBBd", 9, 1.0, 2.0, 3.0, 4, 5, 6, 0.5) + struct.pack("<Q", 2) + b"\0" * 16
    (tmp_path / "points3D.bin").write_bytes(points)
    (tmp_path / "points3D.txt").write_text("# c\n9 1 2 3 4 5 6 0.5 1 2\n")
    binary, plain = colmap.read_points_binary(spark, str(tmp_path / "points3D.bin")), colmap.read_points_text(spark, str(tmp_path / "points3D.txt"))
    assert binary.first() == plain.first()
    (tmp_path / "cameras.txt").write_text("1 PINHOLE 640 480 1 2 3 4\n")
    assert colmap.read_cameras_text(spark, str(tmp_path / "cameras.txt")).first()["params"] == [1.0, 2.0, 3.0, 4.0]


def test_dense_arrays_are_in_column_order(spark, tmp_path):
    a = np.arange(6, dtype="<f4").reshape(2, 3, 1)
    (tmp_path / "d.bin").write_bytes(b"3&2&1&" + a.transpose(1, 0, 2).reshape(-1, order="F").tobytes())
    got = {(r["y"], r["x"]): r["value"] for r in colmap.read_dense(spark, str(tmp_path / "d.bin")).collect()}
    assert got == {(y, x): float(a[y, x, 0]) for y in range(2) for x in range(3)}


def test_logs_that_are_missing_torn_or_uneven(spark, tmp_path):
    assert logs.read_status(spark, str(tmp_path / "none.jsonl")).count() == 0
    (tmp_path / "s.jsonl").write_text('{"job_id":"a","oom_fallback_level":1}\n{"job_id":"b","detected_oom":true,"extra":1}\n{"job_id":"c"}\n{"job_i')
    status = logs.read_status(spark, str(tmp_path / "s.jsonl"))
    assert sorted(r["job_id"] for r in logs.oom_rows(status).collect()) == ["a", "b"]
    assert logs.merged_config({"a": 1, "b": 2}, {"a": None, "b": 3}) == {"a": 1, "b": 3}
    logs.append_manifest(spark.createDataFrame([("j", "A")], "job_id string, stage string"), str(tmp_path / "m"))
    assert logs.read_manifest(spark, str(tmp_path / "none.csv")).count() == 0


def test_transforms(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"camera_angle_x": 0.5, "frames": [{"file_path": "a", "w": 100, "fl_x": 50.0}, {"file_path": "b", "w": 100, "fl_x": 100.0}]}')
    shared = colmap.read_transforms(spark, str(tmp_path / "t.json")).orderBy("ordinal").collect()
    own = colmap.read_transforms(spark, str(tmp_path / "t.json"), per_frame=True).orderBy("ordinal").collect()
    assert shared[1]["fovx"] == 0.5 and abs(own[0]["fovx"] - 2 * np.arctan(1)) < 1e-12


def test_catalog(spark, tmp_path):
    from fieldmill.sources import catalog, files

    root = tmp_path / "models x"
    for name in ("m/point_cloud/iteration_7/scene.ply", "m/point_cloud/iteration_30/other.ply", "n/point_cloud/iteration_12/scene.ply", "n/transforms.json", "o/sparse/0/cameras.bin", "o/transforms.json", "p/x.txt"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x")
    listed = files.list_files(spark, f"file://{root}")
    assert listed.count() == 7 and files.list_files(spark, f"file://{root}/none").count() == 0
    found = catalog.versions(listed, "scene.ply")
    assert sorted((r["root"], r["version"]) for r in catalog.latest_versions(found).collect()) == [("m/point_cloud", 7), ("n/point_cloud", 12)]
    wanted = spark.createDataFrame([("a", 0, "none", None), ("a", 1, "m/point_cloud", None), ("b", 0, "m/point_cloud", 30), ("b", 1, "n/point_cloud", -1), ("c", 0, "m/point_cloud", 30)], "key string, rank int, root string, version bigint")
    got = {r["key"]: r["path"] for r in catalog.resolve(wanted, found).collect()}
    assert got == {"a": "m/point_cloud/iteration_7/scene.ply", "b": "n/point_cloud/iteration_12/scene.ply", "c": None}
    tries = spark.createDataFrame([("k", 0, "no"), ("k", 1, "p/x.txt"), ("k", 2, "n/transforms.json"), ("k", 3, "p/x.txt"), ("l", 0, None)], "key string, rank int, path string")
    assert {r["key"]: r["path"] for r in catalog.first_existing(tries, listed).collect()} == {"k": "p/x.txt", "l": None}
    assert sorted(r["root"] for r in catalog.instances(listed).collect()) == ["m", "n"]
    roots = spark.createDataFrame([(c,) for c in "mnop"], "root string")
    kinds = {r["root"]: r["kind"] for r in catalog.source_kinds(listed, roots).collect()}
    assert kinds["n"] == "per_frame" and kinds["o"] == "reconstruction" and kinds["m"] == kinds["p"] == "error: no known source"
    assert catalog.unique([3, None, 1, 3]) == [3, 1]


def test_hull_query_checks_every_axis_and_colour(spark, data, monkeypatch):
    from fieldmill.plans.io_queries import s30
    from fieldmill.sources import colmap

    assert tuple(s30(spark, data).first()) == (100_000, True)
    drawn = colmap.hull_points
    assert drawn(spark, spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 3.0, 5.0)], "x double, y double, z double"), 100_000).count() == 100_000
    for column in ("y", "z", "red", "green", "blue"):
        monkeypatch.setattr(colmap, "hull_points", lambda *a, c=column: drawn(*a).withColumn(c, F.lit(10_000_000)))
        assert not s30(spark, data).first()["inside"]
