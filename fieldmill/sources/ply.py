"""PLY files as a Spark data source: ``spark.read.format("ply")`` reads the scalar properties of one element, in row ranges; writing gives
binary files of bounded size. Register with ``register(spark)``. Paths are those of any file system that Arrow knows."""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from fieldmill.sources.files import file_system

# Type names of the format, with their numpy and Spark types.
TYPES = {
    "char": ("i1", "tinyint"), "int8": ("i1", "tinyint"), "uchar": ("u1", "smallint"), "uint8": ("u1", "smallint"),
    "short": ("i2", "smallint"), "int16": ("i2", "smallint"), "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "bigint"), "uint32": ("u4", "bigint"),
    "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
NAMES = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}


@dataclass
class Header:
    order: str
    elements: list[tuple[str, int, list[tuple[str, str, str | None]]]]
    size: int


def _open(path: str) -> io.BufferedReader:
    system, place = file_system(path)
    return io.BufferedReader(system.open_input_file(place), 1 << 20)


def read_header(path: str) -> Header:
    order, elements, size = "", [], 0
    with _open(path) as f:
        if f.readline().strip() != b"ply":
            raise ValueError(f"{path} is no PLY file")
        while raw := f.readline():
            words = raw.decode("ascii", "replace").split()
            if not words:
                continue
            if words[0] == "format":
                order = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}[words[1]]
                size = words[1] == "ascii"
            elif words[0] == "element":
                elements.append((words[1], int(words[2]), []))
            elif words[0] == "property":
                elements[-1][2].append((words[-1], words[3], words[2]) if words[1] == "list" else (words[-1], words[1], None))
            elif words[0] == "end_header":
                break
        size = f.tell()
    return Header(order, elements, size)


@dataclass
class Rows(InputPartition):
    path: str
    start: int
    stop: int
    first: int


class PlyReader(DataSourceReader):
    """A file, or the files ``*.ply`` of a directory (all of one layout) as one table; ``row`` counts through them."""

    def __init__(self, options: dict) -> None:
        self.element, self.rows = options.get("element", "vertex"), int(options.get("rows", 1_000_000))
        system, place = file_system(options["path"])
        names = [options["path"]]
        if system.get_file_info(place).type == fs.FileType.Directory:
            listed = system.get_file_info(fs.FileSelector(place))
            names = sorted(f"{options['path'].rstrip('/')}/{x.base_name}" for x in listed if x.base_name.endswith(".ply") and x.base_name[0] not in "._")
        self.files = [(f, read_header(f)) for f in names]
        if not self.files:
            raise ValueError(f"no PLY file in {place}")
        self.fields = next((p for n, _, p in self.files[0][1].elements if n == self.element), [])
        for name, header in self.files:
            order = [n for n, _, _ in header.elements]
            before = header.elements[: order.index(self.element) + 1] if self.element in order else []
            if any(f[2] for _, _, p in before for f in p):
                raise ValueError("an element with lists, or behind lists, is read with read_faces")
            if before and before[-1][2] != self.fields:
                raise ValueError(f"{name} has another layout")

    def partitions(self) -> list[Rows]:
        out, first = [], 0
        for name, header in self.files:
            count = next((c for n, c, _ in header.elements if n == self.element), 0)
            out += [Rows(name, a, min(a + self.rows, count), first + a) for a in range(0, count, self.rows)]
            first += count
        return out or [Rows(self.files[0][0], 0, 0, 0)]

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        header = dict(self.files)[part.path]
        kinds = np.dtype([(n, header.order + TYPES[t][0]) for n, t, _ in self.fields])
        before = [(c, p) for n, c, p in header.elements[: [n for n, _, _ in header.elements].index(self.element)]]
        with _open(part.path) as f:
            if header.order:
                skip = sum(c * sum(np.dtype(TYPES[t][0]).itemsize for _, t, _ in p) for c, p in before)
                f.seek(header.size + skip + part.start * kinds.itemsize)
                data = np.frombuffer(f.read((part.stop - part.start) * kinds.itemsize), dtype=kinds)
            else:
                f.seek(header.size)
                for _ in range(sum(c for c, _ in before) + part.start):
                    f.readline()
                lines = [tuple(f.readline().split()) for _ in range(part.stop - part.start)]
                data = np.array([tuple(float(v) for v in x) for x in lines], dtype=kinds)
        wanted = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32(), "bigint": pa.int64(), "float": pa.float32(), "double": pa.float64()}
        arrays = [pa.array(np.ascontiguousarray(data[n]).astype(data[n].dtype.newbyteorder("="))).cast(wanted[TYPES[t][1]]) for n, t, _ in self.fields]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + len(data))), *arrays], ["row", *(n for n, _, _ in self.fields)])


#: Bytes of data at which a writing task begins another file.
FILE_BYTES = 64 << 20


class PlyWriter(DataSourceArrowWriter):
    """Each task writes its batches to drafts of bounded size; the commit takes away the files of before and names the drafts, an abort
    removes them. So a failed job leaves the old table as it was."""

    def __init__(self, path: str, fields: list[tuple[str, str]], overwrite: bool) -> None:
        self.path, self.fields, self.overwrite = path, fields, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        kinds = np.dtype([(n, "<" + TYPES[NAMES[t]][0]) for n, t in self.fields])
        system, folder = file_system(self.path)
        system.create_dir(folder, recursive=True)
        message = WriterCommitMessage()
        message.drafts = []
        held: list[np.ndarray] = []

        def flush() -> None:
            count = sum(len(x) for x in held)
            lines = ["ply", "format binary_little_endian 1.0", f"element vertex {count}", *(f"property {NAMES[t]} {n}" for n, t in self.fields), "end_header"]
            draft = f"{folder}/.{uuid.uuid4().hex}.tmp"
            with system.open_output_stream(draft) as sink:
                sink.write(("\n".join(lines) + "\n").encode())
                for x in held:
                    sink.write(x.tobytes())
            message.drafts.append((draft, count))
            held.clear()

        for batch in batches:
            data = np.empty(len(batch), dtype=kinds)
            for i, (n, _) in enumerate(self.fields):
                column = batch.column(i)
                data[n] = (column.fill_null(float("nan")) if pa.types.is_floating(column.type) else column).to_numpy(zero_copy_only=False)
            held.append(data)
            if sum(x.nbytes for x in held) >= FILE_BYTES:
                flush()
        if held or not message.drafts:
            flush()
        return message

    def commit(self, messages: list) -> None:
        system, folder = file_system(self.path)
        drafts = [d for m in messages if m is not None for d in m.drafts]
        kept = [d for d in drafts if d[1]] or drafts[:1]
        if self.overwrite:
            for old in system.get_file_info(fs.FileSelector(folder)):
                if old.base_name.startswith("part-") and old.base_name.endswith(".ply"):
                    system.delete_file(old.path)
        for i, (draft, _) in enumerate(kept):
            system.move(draft, f"{folder}/part-{i:06d}.ply")
        for draft, _ in drafts:
            if (draft, 0) in drafts and system.get_file_info(draft).type == fs.FileType.File:
                system.delete_file(draft)

    def abort(self, messages: list) -> None:
        system, _ = file_system(self.path)
        for m in messages:
            for draft, _ in m.drafts if m is not None else ():
                if system.get_file_info(draft).type == fs.FileType.File:
                    system.delete_file(draft)


class PlySource(DataSource):
    """Options: path, element (vertex), rows (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "ply"

    def schema(self) -> str:
        reader = PlyReader(self.options)
        return ", ".join(["row bigint", *(f"`{n}` {TYPES[t][1]}" for n, t, _ in reader.fields)])

    def reader(self, schema) -> PlyReader:
        return PlyReader(self.options)

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        fields = [(f.name, f.dataType.simpleString()) for f in schema.fields]
        if bad := [t for _, t in fields if t not in NAMES]:
            raise ValueError(f"PLY has no {bad[0]}")
        return PlyWriter(self.options["path"], fields, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PlySource)


def read_ply(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    return spark.read.format("ply").options(path=path, **options).load()


def write_ply(df: DataFrame, path: str) -> None:
    register(df.sparkSession)
    df.write.format("ply").mode("overwrite").option("path", path).save()


def _gather(columns: list[str], prefix: str) -> list[str]:
    """Columns ``prefix`` + number, by their number."""
    found = [c for c in columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    return sorted(found, key=lambda c: int(c[len(prefix) :]))


def _array(columns: list[str], pad: int = 0) -> Column:
    return F.array(*(F.col(c) for c in columns), *(F.lit(0.0).cast("float") for _ in range(pad)))


def scene_table(raw: DataFrame, rest: int = 45) -> DataFrame:
    """Splat columns to arrays: f_dc, f_rest (zero-filled to ``rest``; more are an error), scale, rot."""
    c = raw.columns
    more = _gather(c, "f_rest_")
    if len(more) > rest:
        raise ValueError(f"{len(more)} rest coefficients, {rest} expected")
    arrays = {"f_dc": _array(_gather(c, "f_dc_")), "f_rest": _array(more, rest - len(more)), "scale": _array(_gather(c, "scale_")), "rot": _array(_gather(c, "rot_"))}
    return raw.select(F.col("row").alias("gid"), "x", "y", "z", "opacity", *(a.alias(n) for n, a in arrays.items()))


def feature_table(raw: DataFrame, width: int) -> DataFrame:
    """f_0 .. f_{width-1} as one array; another width is an error."""
    found = _gather(raw.columns, "f_")
    if len(found) != width:
        raise ValueError(f"{len(found)} features, {width} expected")
    return raw.select(F.col("row").alias("gid"), _array(found).alias("f"))


def zero_features(raw: DataFrame, width: int) -> DataFrame:
    """Geometry only: a zero vector a row."""
    return raw.select(F.col("row").alias("gid"), "x", "y", "z", F.array_repeat(F.lit(0.0).cast("float"), width).alias("f"))


def label_column(raw: DataFrame) -> DataFrame:
    """``gid``, ``label`` from the first of cluster_idx, cluster_index, label that is there; none is an error."""
    name = next((c for c in ("cluster_idx", "cluster_index", "label") if c in raw.columns), None)
    if name is None:
        raise ValueError("no label column")
    return raw.select(F.col("row").alias("gid"), F.col(name).cast("bigint").alias("label"))


def wide_export(points: DataFrame, features: DataFrame, labels: DataFrame, width: int) -> DataFrame:
    """Geometry with affinity_f_<i> columns and cluster_idx (-1 where there is none), joined by gid."""
    spread = features.select("gid", *(F.get("f", F.lit(i)).alias(f"affinity_f_{i}") for i in range(width)))
    named = labels.select("gid", F.col("label").cast("int").alias("cluster_idx"))
    return points.join(spread, "gid").join(named, "gid", "left").withColumn("cluster_idx", F.coalesce("cluster_idx", F.lit(-1)))


def read_faces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Vertices (V, 3) and triangles (F, 3) of a mesh file on the driver; meshes are small side inputs. Other polygons are an error."""
    h = read_header(path)
    with _open(path) as f:
        f.seek(h.size)
        if not h.order:
            rows = [[float(v) for v in line.split()] for line in f.read().splitlines() if line.strip()]
            n = h.elements[0][1]
            v, t = np.array([r[:3] for r in rows[:n]]), rows[n:]
        else:
            n, fields = h.elements[0][1], h.elements[0][2]
            kinds = np.dtype([(a, h.order + TYPES[t][0]) for a, t, _ in fields])
            data = np.frombuffer(f.read(n * kinds.itemsize), dtype=kinds)
            v = np.stack([data[a].astype(float) for a in "xyz"], axis=1)
            _, kind, count = h.elements[1][2][0]
            face = np.dtype([("n", h.order + TYPES[count][0]), ("v", h.order + TYPES[kind][0], 3)])
            t = [[int(r["n"]), *r["v"].tolist()] for r in np.frombuffer(f.read(), dtype=face)]
    if any(int(r[0]) != 3 for r in t):
        raise ValueError("only triangles")
    faces = np.array([r[1:4] for r in t], dtype=np.int64).reshape(-1, 3)
    if len(faces) and (faces.min() < 0 or faces.max() >= len(v)):
        raise ValueError("a face names no vertex")
    return v, faces


def pack_mesh(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary mesh file of triangles."""
    head = ["ply", "format binary_little_endian 1.0", f"element vertex {len(vertices)}", *(f"property float {c}" for c in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    rows = np.empty(len(faces), dtype=[("n", "u1"), ("v", "<i4", 3)])
    rows["n"], rows["v"] = 3, faces
    return ("\n".join(head) + "\n").encode() + np.ascontiguousarray(vertices, dtype="<f4").tobytes() + rows.tobytes()


def read_meshes(spark: SparkSession, path: str) -> DataFrame:
    """``file``, ``a``, ``b``, ``c`` and the corner coordinates of ``a`` (x, y, z) of every triangle of the mesh files at ``path``, one task a file."""

    def run(batches):
        for batch in batches:
            for name in batch.column(0).to_pylist():
                v, f = read_faces(name)
                base = pa.array([name.rpartition("/")[2]] * len(f), pa.string())
                corner = v[f[:, 0]] if len(f) else np.zeros((0, 3))
                yield pa.RecordBatch.from_arrays([base, *(pa.array(f[:, i]) for i in range(3)), *(pa.array(corner[:, i].astype(np.float64)) for i in range(3))], ["file", "a", "b", "c", "x", "y", "z"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path")
    return files.mapInArrow(run, "file string, a bigint, b bigint, c bigint, x double, y double, z double")


def write_pixels(df: DataFrame, folder: str, by: str, height: int, width: int) -> int:
    """One grey image file (binary PGM) a group: ``value`` 0..255 at ``y``, ``x``; other pixels are 0."""
    from fieldmill.sources.files import write_files

    def whole(table: pa.Table) -> pa.Table:
        image = np.zeros((height, width), np.uint8)
        image[table.column("y").to_numpy(), table.column("x").to_numpy()] = table.column("value").to_numpy()
        name = f"{table.column(by)[0].as_py()}.pgm"
        return pa.table({"name": pa.array([name]), "content": pa.array([f"P5 {width} {height} 255\n".encode() + image.tobytes()], pa.binary())})

    return write_files(df.select(by, "y", "x", "value").groupBy(by).applyInArrow(whole, "name string, content binary"), folder)


def read_pixels(spark: SparkSession, folder: str) -> DataFrame:
    """``file``, ``y``, ``x``, ``value`` of the pixels of grey image files that aren't 0."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                head, _, body = content.partition(b"\n")
                width, height = (int(v) for v in head.split()[1:3])
                image = np.frombuffer(body, np.uint8).reshape(height, width)
                y, x = np.nonzero(image)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(y), pa.string()), pa.array(y), pa.array(x), pa.array(image[y, x].astype(np.int64))], ["file", "y", "x", "value"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pgm").load(folder).select(F.regexp_extract("path", r"([^/]+)\.pgm$", 1).alias("file"), "content")
    return files.mapInArrow(run, "file string, y bigint, x bigint, value bigint")
