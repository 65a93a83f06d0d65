"""Files seen from Python workers, on any file system that Arrow knows: opening, writing from a table, listing as a table."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path on it; without a scheme it is a local (or mounted) one."""
    if re.match(r"[a-z0-9]+:/", path):
        return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def write_files(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Writes each row's ``content`` (binary) to the file ``name`` below ``folder``; how many were written.

    A file gets its name only when it is whole, and a repeated attempt writes the same bytes under it, so lost tasks do no harm. Null names
    or contents write nothing.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for place, data in zip(names, batch.column(1)):
                target = f"{root}/{place}"
                parent = target.rpartition("/")[0]
                system.create_dir(parent, recursive=True)
                draft = f"{parent}/_{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as sink:
                    sink.write(data.as_buffer())
                system.move(draft, target)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string())], ["name"])

    whole = df.select(F.col(name).cast("string"), F.col(content).cast("binary")).filter(F.col(name).isNotNull() & F.col(content).isNotNull())
    return whole.mapInArrow(run, "name string").count()


def list_files(spark: SparkSession, root: str, name: str = "*") -> DataFrame:
    """``path`` (below ``root``), ``bytes``, ``changed`` of the files called ``name`` (a glob) below ``root``; contents are not read.

    The listing is a scan, so it is as parallel as one. A missing folder is empty.
    """
    from fieldmill.sources.logs import exists

    if not exists(spark, root):
        return spark.createDataFrame([], "path string, bytes bigint, changed timestamp")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root)
    base = re.sub(r"^[a-z0-9]+:/+", "/", root).rstrip("/")
    below = F.expr("replace(path, '%20', ' ')").substr(F.instr("path", F.lit(base).cast("string")) + len(base) + 1, F.length("path"))
    return found.select(below.alias("path"), F.col("length").alias("bytes"), F.col("modificationTime").alias("changed"))


def part_of_path(path: Column, prefix: str) -> Column:
    """The name of the directory that begins with ``prefix``, without it; null if there is none."""
    found = F.regexp_extract(path, rf"(?:^|/){re.escape(prefix)}([^/]*)/", 1)
    return F.when(found != "", found)
