"""Camera models, images and points of structure-from-motion, text and binary, and camera files in JSON."""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmill.operators.ranks import numbered
from fieldmill.sources.files import write_files

# Camera models by number, with the number of their parameters.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}

CAMERAS = "camera_id int, model string, width bigint, height bigint, params array<double>"
IMAGES = "image_id int, qvec array<double>, tvec array<double>, camera_id int, name string, points array<struct<x:double,y:double,point3d_id:bigint>>"
POINTS = "id bigint, xyz array<double>, rgb array<int>, error double"


def _take(data: bytes, at: int, form: str) -> tuple[tuple, int]:
    size = struct.calcsize("<" + form)
    return struct.unpack_from("<" + form, data, at), at + size


def parse_cameras(data: bytes) -> Iterator[tuple]:
    (n,), at = _take(data, 0, "Q")
    for _ in range(n):
        (camera, model, width, height), at = _take(data, at, "iiQQ")
        name, params = MODELS[model]
        values, at = _take(data, at, f"{params}d")
        yield camera, name, width, height, list(values)


def parse_images(data: bytes) -> Iterator[tuple]:
    (n,), at = _take(data, 0, "Q")
    for _ in range(n):
        (image, *pose, camera), at = _take(data, at, "i7di")
        stop = data.index(b"\0", at)
        name, at = data[at:stop].decode(), stop + 1
        (count,), at = _take(data, at, "Q")
        flat, at = _take(data, at, "ddq" * count)
        points = [{"x": flat[i], "y": flat[i + 1], "point3d_id": flat[i + 2]} for i in range(0, 3 * count, 3)]
        yield image, pose[:4], pose[4:], camera, name, points


def parse_points(data: bytes) -> Iterator[tuple]:
    (n,), at = _take(data, 0, "Q")
    for _ in range(n):
        (point, x, y, z, r, g, b, error), at = _take(data, at, "QdddBBBd")
        (track,), at = _take(data, at, "Q")
        at += 8 * track
        yield point, [x, y, z], [r, g, b], error


def _binary(spark: SparkSession, path: str, parse: Callable[[bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.replace(", ", "\n").split("\n")]
    empty = spark.createDataFrame([], schema)
    arrow = empty.toArrow().schema

    def run(batches):
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for row in parse(content):
                    rows.append(dict(zip(names, row)))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def parse_header(data: bytes, form: str) -> tuple:
    """The values of a little-endian ``form`` at the beginning of a file (the low-level reader of all the binary ones)."""
    return _take(data, 0, form)[0]


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``records``: the record count that stands at the head of each binary file."""

    def run(batches):
        for batch in batches:
            counts = [parse_header(x, "Q")[0] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["file", "records"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+/[^/]+)$", 1).alias("file"), "content")
    return files.mapInArrow(run, "file string, records bigint")


def read_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_cameras, CAMERAS)


def read_images_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_images, IMAGES)


def read_points_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_points, POINTS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).filter("value not like '#%' and trim(value) <> ''").select(F.split(F.trim("value"), r"\s+").alias("w"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    """Only PINHOLE cameras are allowed in text form; another model is an error."""
    w = F.col("w")
    model = F.when(w[1] == "PINHOLE", w[1]).otherwise(F.raise_error(F.concat(F.lit("camera model "), w[1])).cast("string"))
    rest = F.slice(w, 5, F.size(w) - 4).cast("array<double>")
    return _lines(spark, path).select(w[0].cast("int").alias("camera_id"), model.alias("model"), w[2].cast("bigint").alias("width"), w[3].cast("bigint").alias("height"), rest.alias("params"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.col("w")
    return _lines(spark, path).select(w[0].cast("bigint").alias("id"), F.slice(w, 2, 3).cast("array<double>").alias("xyz"), F.slice(w, 5, 3).cast("array<int>").alias("rgb"), w[7].cast("double").alias("error"))


def parse_images_text(text: str) -> Iterator[tuple]:
    lines = [x for x in text.split("\n") if not x.startswith("#")]
    i = 0
    while i < len(lines):
        words = lines[i].split()
        i += 1
        if len(words) < 10:
            continue
        flat = (lines[i] if i < len(lines) else "").split()
        i += 1
        points = [{"x": float(flat[j]), "y": float(flat[j + 1]), "point3d_id": int(flat[j + 2])} for j in range(0, len(flat) - 2, 3)]
        yield int(words[0]), [float(v) for v in words[1:5]], [float(v) for v in words[5:8]], int(words[8]), " ".join(words[9:]), points


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines an image, so a file is read as a whole; files are of one reconstruction each."""
    return _binary(spark, path, lambda data: parse_images_text(data.decode()), IMAGES)


def parse_dense(data: bytes) -> np.ndarray:
    """``width&height&channels&`` and float32 in column order: an array (height, width, channels)."""
    parts = data[:64].split(b"&", 3)
    width, height, channels = (int(p) for p in parts[:3])
    start = sum(len(p) + 1 for p in parts[:3])
    return np.frombuffer(data[start:], dtype="<f4", count=width * height * channels).reshape((width, height, channels), order="F").transpose(1, 0, 2)


def read_dense(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``y``, ``x``, ``c``, ``value`` of dense arrays."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = parse_dense(content)
                y, x, c = (v.ravel() for v in np.indices(a.shape))
                yield pa.RecordBatch.from_arrays([pa.array([name] * a.size), *(pa.array(v.astype(np.int32)) for v in (y, x, c)), pa.array(a.ravel())], ["file", "y", "x", "c", "value"])

    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "([^/]+)$", 1).alias("file"), "content")
    return files.mapInArrow(run, "file string, y int, x int, c int, value float")


def _packed(df: DataFrame, by: str, name: str, pack: Callable[[list[dict]], bytes]) -> DataFrame:
    """One row a group (a reconstruction): its file name and the packed content. A file is one task's work, as the format counts first."""

    def whole(table: pa.Table) -> pa.Table:
        return pa.table({"name": pa.array([f"{table.column(by)[0].as_py()}/{name}"]), "content": pa.array([pack(table.to_pylist())], pa.binary())})

    return df.groupBy(by).applyInArrow(whole, "name string, content binary")


def pack_cameras(rows: list[dict]) -> bytes:
    numbers = {name: (i, n) for i, (name, n) in MODELS.items()}
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        i, n = numbers[r["model"]]
        out.append(struct.pack(f"<iiQQ{n}d", r["camera_id"], i, r["width"], r["height"], *r["params"]))
    return b"".join(out)


def pack_images(rows: list[dict]) -> bytes:
    out = [struct.pack("<Q", len(rows))]
    for r in rows:
        flat = [v for p in r["points"] for v in (p["x"], p["y"], p["point3d_id"])]
        out.append(struct.pack("<i7di", r["image_id"], *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0")
        out.append(struct.pack("<Q" + "ddq" * len(r["points"]), len(r["points"]), *flat))
    return b"".join(out)


def pack_points(rows: list[dict]) -> bytes:
    return struct.pack("<Q", len(rows)) + b"".join(struct.pack("<QdddBBBdQ", r["id"], *r["xyz"], *r["rgb"], r["error"], 0) for r in rows)


def pack_dense(a: np.ndarray) -> bytes:
    """An array (height, width, channels) as ``parse_dense`` reads it."""
    height, width, channels = a.shape
    return f"{width}&{height}&{channels}&".encode() + a.astype("<f4").transpose(1, 0, 2).tobytes(order="F")


def write_cameras_binary(df: DataFrame, folder: str, by: str) -> int:
    """Cameras (camera_id, model, width, height, params) of each group ``by`` as ``<group>/cameras.bin``."""
    return write_files(_packed(df, by, "cameras.bin", pack_cameras), folder)


def write_images_binary(df: DataFrame, folder: str, by: str) -> int:
    return write_files(_packed(df, by, "images.bin", pack_images), folder)


def write_points_binary(df: DataFrame, folder: str, by: str) -> int:
    return write_files(_packed(df, by, "points3D.bin", pack_points), folder)


def write_text(df: DataFrame, folder: str, by: str, name: str, order: str, line: Column, head: str = "# written by a table") -> int:
    """A text file a group: ``head``, then ``line`` of each row in the order of ``order``."""
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    body = F.concat(F.lit(head + "\n"), F.array_join(F.transform("lines", lambda x: x["l"]), "\n"), F.lit("\n"))
    files = df.groupBy(by).agg(lines.alias("lines")).select(F.concat(F.col(by).cast("string"), F.lit(f"/{name}")).alias("name"), F.encode(body, "utf-8").alias("content"))
    return write_files(files, folder)


def camera_line() -> Column:
    return F.concat_ws(" ", "camera_id", "model", "width", "height", F.array_join(F.transform("params", lambda p: p.cast("string")), " "))


def image_line() -> Column:
    """Two lines: the pose and name, then the points seen."""
    numbers = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), p["point3d_id"].cast("string"))), " ")
    return F.concat(F.concat_ws(" ", F.col("image_id").cast("string"), numbers("qvec"), numbers("tvec"), F.col("camera_id").cast("string"), "name"), F.lit("\n"), points)


def point_line() -> Column:
    numbers = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), " ")
    return F.concat_ws(" ", F.col("id").cast("string"), numbers("xyz"), numbers("rgb"), F.col("error").cast("string"))


def transforms_document(frames: DataFrame, by: str, angle: str | None = None) -> DataFrame:
    """``name``, ``content``: a transforms file a group, frames (ordinal, file_path, w, h, fl_x ...) in order, with a shared angle if one is named."""
    cells = [c for c in frames.columns if c not in (by, "ordinal", angle)]
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*cells).alias("f")))), lambda x: x["f"])
    doc = frames.groupBy(by).agg(listed.alias("frames"), *([F.first(angle).alias("camera_angle_x")] if angle else []))
    return doc.select(F.concat(F.col(by).cast("string"), F.lit("/transforms.json")).alias("name"), F.encode(F.to_json(F.struct(*[c for c in doc.columns if c != by])), "utf-8").alias("content"))


def assemble(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Images with their camera's model and size, by camera_id; an image without a camera is dropped."""
    return images.join(cameras.select("camera_id", "model", "width", "height", "params"), "camera_id")


def read_transforms(spark: SparkSession, path: str, per_frame: bool = False) -> DataFrame:
    """Frames of a transforms file: file_path, 4x4 matrix, horizontal angle (shared, or from each frame's fl_x and w)."""
    schema = "camera_angle_x double, frames array<struct<file_path:string,transform_matrix:array<array<double>>,w:bigint,h:bigint,fl_x:double,fl_y:double,cx:double,cy:double>>"
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    frames = doc.select("camera_angle_x", F.posexplode("frames").alias("ordinal", "f"))
    angle = 2 * F.atan(F.col("f.w") / (2 * F.col("f.fl_x"))) if per_frame else F.col("camera_angle_x")
    return frames.select("ordinal", F.col("f.file_path").alias("file_path"), F.col("f.transform_matrix").alias("matrix"), angle.alias("fovx"))


def next_version(spark: SparkSession, names: DataFrame, prefix: str) -> DataFrame:
    """``latest`` of directory names ``prefix<number>``; no such name gives null."""
    number = F.regexp_extract("name", f"^{prefix}(\\d+)$", 1).try_cast("int")
    return names.select(number.alias("n")).agg(F.max("n").alias("latest"))


def hull_points(spark: SparkSession, cameras: DataFrame, rows: int, seed: int = 0) -> DataFrame:
    """``rows`` random positions in the box of camera positions (x, y, z), with random colours."""
    box = cameras.agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))))  # one row
    drawn = spark.range(rows).join(F.broadcast(box))
    return drawn.select("id", *((F.col(f"low{c}") + F.rand(seed + i) * (F.col(f"high{c}") - F.col(f"low{c}"))).alias(c) for i, c in enumerate("xyz")), *((F.rand(seed + 9 + i) * 255).cast("int").alias(c) for i, c in enumerate(("red", "green", "blue"))))


def natural_order(df: DataFrame, name: str) -> DataFrame:
    """``place``: rows by the number at the end of a name's stem, then by name."""
    number = F.regexp_extract(F.substring_index(name, ".", 1), r"(\d+)$", 1).try_cast("bigint")
    return numbered(df.withColumn("_suffix", number), [], [F.asc_nulls_first("_suffix"), name], "place").drop("_suffix")
