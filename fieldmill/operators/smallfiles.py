"""Consolidation of very many tiny record files into few well-sized, sorted files with range metadata.

External merge sort without a shuffle. First every task turns its rows into *runs*: sorted Parquet files of bounded size. Then the key space
is cut into ranges of about equal bytes by keys that the runs report, and each range is one task's k-way merge of the already sorted files
that reach into it. A task writes Parquet and begins a new file whenever the bytes written reach the target (or the file group changes).

Tasks name files uniquely and report them; a store is what its stored manifest (``_manifest/v=N``) lists, so files of lost or repeated
attempts are never read. Consolidating more records into a store merges the store's own files (they are sorted runs too) that the new
key ranges touch, leaves the others alone, and writes the next version of the manifest.
"""

from __future__ import annotations

import bisect
import json
import math
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fieldmill.session import scratch_path
from fieldmill.sources.files import file_system

#: Bytes of a row group in runs and stores: the unit that a merge holds of each file it reads.
GROUP_BYTES = 1 << 20
#: Most files merged at once; more are merged in several passes.
FAN_IN = 128
_REPORT = "path string, file_no int, rows bigint, bytes bigint, first binary, last binary, marks array<struct<key:binary,bytes:bigint>>"
_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)


def _shallow(body: str, at: int) -> tuple[dict, int]:
    """As ``raw_decode`` for an object nested deeper than the decoder goes: inner values are left out of the result."""
    depth, keep, last = 0, [], at
    for m in _BRACES.finditer(body, at):
        mark = m[0]
        if mark in "{[":
            if depth == 1:
                keep += [body[last : m.start()], "null"]
            depth += 1
        elif mark in "}]":
            depth -= 1
            if depth == 1:
                last = m.end()
            elif not depth:
                return json.loads("".join([*keep, body[last : m.end()]])), m.end()
    raise ValueError("the object breaks off")


def objects_in(body: str, keys: list[str]) -> list[tuple[dict, str]]:
    """Each complete JSON object of ``body`` that has all ``keys``, with its text, inner objects included in it; others are looked into."""
    decode, found, at = json.JSONDecoder().raw_decode, [], body.find("{")
    while at >= 0:
        end = at + 1
        try:
            try:
                value, stop = decode(body, at)
            except RecursionError:
                value, stop = _shallow(body, at)
            if all(value.get(k) is not None for k in keys):
                found.append((value, body[at:stop]))
                end = stop
        except (ValueError, RecursionError):
            pass
        at = body.find("{", end)
    return found


def _typed(value: object, kind: pa.DataType) -> object | None:
    """A JSON value as the key type, or None: whole numbers within range, texts as they are."""
    if pa.types.is_integer(kind):
        whole = isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
        return int(value) if whole and -(1 << kind.bit_width - 1) <= value < 1 << kind.bit_width - 1 else None
    return value if isinstance(value, str) else None


def extract_records(files: DataFrame, body: str, keys: dict[str, str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each complete JSON object in ``body``: ``keep``, the typed ``keys`` and the object's text as ``record``.

    An object that breaks off, isn't valid JSON or lacks a key (or has one that doesn't fit its type: bigint, int or string) gives no row;
    null, empty and blank bodies give none. Objects stand one a line, in an array or in any mixture, of any length and with inner objects;
    records of one body keep their number. A torn object ends where the next one begins.
    """
    kept = [f"`{c}` {files.schema[c].dataType.simpleString()}" for c in keep]
    schema = ", ".join([*kept, *(f"`{k}` {t}" for k, t in keys.items()), "record string"])
    names, kinds = list(keys), list(to_arrow_schema(files.sparkSession.createDataFrame([], ", ".join(f"`{k}` {t}" for k, t in keys.items())).schema).types)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, values, texts, held = [], [[] for _ in names], [], 0

            def out() -> pa.RecordBatch:
                place = pa.array(at, pa.int64())
                made = pa.RecordBatch.from_arrays(
                    [*(batch.column(i).take(place) for i in range(len(keep))), *(pa.array(v, k) for v, k in zip(values, kinds)), pa.array(texts, pa.string())], [*keep, *names, "record"]
                )
                for x in (at, texts, *values):
                    x.clear()
                return made

            for i, text in enumerate(batch.column(len(keep))):
                text = text.as_py()
                for value, raw in objects_in(text, names) if text else ():
                    key = [_typed(value[k], t) for k, t in zip(names, kinds)]
                    if None not in key:
                        at.append(i)
                        texts.append(raw)
                        for v, x in zip(values, key):
                            v.append(x)
                        held += len(raw) + 64
                        if held > 8 << 20:
                            yield out()
                            held = 0
            if at:
                yield out()

    source = F.col(body).alias("_body")
    return files.select(*keep, source).mapInArrow(run, schema)


def _token(row: tuple) -> tuple:
    """A key as a comparable tuple: nulls first."""
    return tuple((v is not None, v) for v in row)


def _key_at(table: pa.Table, order: list[str], i: int) -> tuple:
    return tuple(table.column(c)[i].as_py() for c in order)


def _pack(key: tuple) -> bytes:
    import pickle

    return pickle.dumps(key)


def _unpack(key: bytes) -> tuple:
    import pickle

    return pickle.loads(key)


def _below(table: pa.Table, order: list[str], bound: tuple | None, start: int = 0, inclusive: bool = False) -> int:
    """How many rows of a sorted table come before ``bound`` (or up to it)."""
    if bound is None:
        return table.num_rows
    find = bisect.bisect_right if inclusive else bisect.bisect_left
    return find(range(table.num_rows), _token(bound), lo=start, key=lambda i: _token(_key_at(table, order, i)))


def _sorted(table: pa.Table, order: list[str]) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start")).combine_chunks()


def _first_of_key(table: pa.Table, keys: list[str], before: tuple | None) -> pa.Table:
    """The first row of each run of equal keys; none for a key that equals ``before``."""
    if not table.num_rows:
        return table
    fresh = None
    for c in keys:
        column = table.column(c).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        new = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        fresh = new if fresh is None else pc.or_(fresh, new)
    head = before is None or _token(_key_at(table, keys, 0)) != _token(before)
    return table.filter(pa.concat_arrays([pa.array([head]), fresh]))


class _Writer:
    """Sorted tables in, Parquet files out: a new file whenever the bytes written reach the target or the value of ``split`` changes."""

    def __init__(self, folder: str, order: list[str], target: int, split: str | None = None, mark_bytes: int = 0):
        self.fs, self.folder = file_system(folder)
        self.uri, self.order, self.target, self.split, self.mark_bytes = folder, order, target, split, mark_bytes
        self.unit = min(GROUP_BYTES, target, mark_bytes or target)
        self.reports: list[dict] = []
        self.open: dict | None = None

    def write(self, table: pa.Table) -> None:
        while table.num_rows:
            part = table
            if self.split:
                lead = _key_at(table, [self.split], 0)
                part = table.slice(0, _below(table, [self.split], lead, inclusive=True))
                if self.open and self.open["lead"] != lead:
                    self.close()
            else:
                lead = None
            step = max(1, int(part.num_rows * self.unit / max(part.nbytes, 1)))
            part = part.slice(0, step)
            if self.open is None:
                name = f"part-{uuid.uuid4().hex}.parquet"
                sink = self.fs.open_output_stream(f"{self.folder}/{name}")
                writer = pq.ParquetWriter(sink, part.schema, compression="zstd")
                self.open = {"lead": lead, "sink": sink, "writer": writer, "rows": 0, "raw": 0, "marks": [], "path": f"{self.uri}/{name}", "first": _key_at(part, self.order, 0)}
            o = self.open
            o["writer"].write_table(part, row_group_size=part.num_rows)
            o["rows"] += part.num_rows
            o["raw"] += part.nbytes
            o["last"] = _key_at(part, self.order, part.num_rows - 1)
            if self.mark_bytes and o["raw"] >= self.mark_bytes:
                o["marks"].append((o["last"], o["raw"]))
                o["raw"] = 0
            if o["sink"].tell() >= self.target:
                self.close()
            table = table.slice(part.num_rows)

    def close(self) -> None:
        if self.open is None:
            return
        o, self.open = self.open, None
        o["writer"].close()
        size = o["sink"].tell()
        o["sink"].close()
        if self.mark_bytes and o["raw"]:
            o["marks"].append((o["last"], o["raw"]))
        marks = [{"key": _pack(k), "bytes": b} for k, b in o["marks"]]
        self.reports.append({"path": o["path"], "file_no": len(self.reports), "rows": o["rows"], "bytes": size, "first": _pack(o["first"]), "last": _pack(o["last"]), "marks": marks})

    def report(self) -> Iterator[pa.RecordBatch]:
        self.close()
        if self.reports:
            mark = pa.list_(pa.struct([("key", pa.binary()), ("bytes", pa.int64())]))
            schema = pa.schema([("path", pa.string()), ("file_no", pa.int32()), ("rows", pa.int64()), ("bytes", pa.int64()), ("first", pa.binary()), ("last", pa.binary()), ("marks", mark)])
            yield pa.RecordBatch.from_pylist(self.reports, schema)


def _write_runs(records: DataFrame, order: list[str], folder: str, run_bytes: int, unique: list[str] | None, mark_bytes: int) -> list:
    """Sorted files of at most about ``run_bytes`` (in memory) of the rows of each task; their reports, as stored, are returned."""
    schema = to_arrow_schema(records.schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        writer = _Writer(folder, order, 1 << 62, mark_bytes=mark_bytes)

        def flush() -> None:
            table = _sorted(pa.Table.from_batches(held, held[0].schema), order)
            writer.write(_first_of_key(table, unique, None) if unique else table)
            writer.close()

        for batch in batches:
            if len(batch):
                held.append(batch.cast(schema) if batch.schema != schema else batch)
                size += batch.nbytes
                if size >= run_bytes:
                    flush()
                    held, size = [], 0
        if held:
            flush()
        yield from writer.report()

    return _stored(records.mapInArrow(run, _REPORT), folder)


def _stored(reports: DataFrame, folder: str) -> list:
    """Reports are committed as a table first: only files of attempts that succeeded are in it."""
    at = f"{folder}/_reports-{uuid.uuid4().hex}"
    reports.write.parquet(at)
    return reports.sparkSession.read.schema(_REPORT).parquet(at).collect()


def _touching(source: pq.ParquetFile, order: list[str], low: tuple | None, high: tuple | None) -> list[int]:
    """Row groups that may hold keys in [low, high): by the least and greatest value of each column, where known."""
    names, out = source.schema_arrow.names, []
    for g in range(source.metadata.num_row_groups):
        group, first, last = source.metadata.row_group(g), [], []
        for c in order:
            stats = group.column(names.index(c)).statistics
            if stats is None or not stats.has_min_max or stats.null_count is None or stats.null_count:
                break
            first.append(stats.min)
            last.append(stats.max)
        n = len(first)
        try:
            after = high is not None and n and _token(tuple(first)) > _token(high[:n])
            before = low is not None and n and _token(tuple(last)) < _token(low[:n])
        except TypeError:  # a statistic of another type than the value: no pruning
            after = before = False
        if not after and not before:
            out.append(g)
    return out


def _pieces(path: str, order: list[str], low: tuple | None, high: tuple | None, schema: pa.Schema) -> Iterator[pa.Table]:
    """The rows of a sorted file with keys in [low, high), one row group at a time."""
    system, place = file_system(path)
    with system.open_input_file(place) as handle:
        source = pq.ParquetFile(handle)
        for g in _touching(source, order, low, high):
            table = source.read_row_group(g).cast(schema)
            a = _below(table, order, low) if low is not None else 0
            b = _below(table, order, high, a)
            if b > a:
                yield table.slice(a, b - a)


def merge_sorted(sources: list[tuple[tuple, Callable[[], Iterator[pa.Table]]]], order: list[str]) -> Iterator[pa.Table]:
    """K-way merge of sorted streams of tables, a block at a time: all rows up to the least last key among the blocks held.

    ``sources`` are (first key, opener); a source is opened only when the merge comes to its first key, so files one after the other in
    the key space are never open together.
    """
    waiting = sorted(((_token(k), i, opener) for i, (k, opener) in enumerate(sources)), key=lambda s: s[:2], reverse=True)
    held: list[list] = []  # [table, stream]
    while held or waiting:
        while waiting and (not held or waiting[-1][0] <= min(h[2] for h in held)):
            stream = waiting.pop()[2]()
            table = next(stream, None)
            if table is not None:
                held.append([table, stream, _token(_key_at(table, order, table.num_rows - 1))])
        if not held:
            continue
        safe, parts, rest = min(h[2] for h in held), [], []
        bound = tuple(v for _, v in safe)
        for table, stream, last in held:
            n = table.num_rows if last <= safe else _below(table, order, bound, inclusive=True)
            if n:
                parts.append(table.slice(0, n))
            table = table.slice(n) if n < table.num_rows else next(stream, None)
            if table is not None:
                rest.append([table, stream, _token(_key_at(table, order, table.num_rows - 1))])
        held = rest
        yield parts[0] if len(parts) == 1 else _sorted(pa.concat_tables(parts), order)


def _cuts(reports: list, range_bytes: int) -> list[tuple]:
    """Keys that cut everything reported into ranges of about ``range_bytes``."""
    marks = sorted(((_unpack(m["key"]), m["bytes"]) for r in reports for m in r["marks"]), key=lambda m: _token(m[0]))
    cuts, size = [], 0
    for key, n in marks[:-1]:
        size += n
        if size >= range_bytes and (not cuts or _token(key) > _token(cuts[-1])):
            cuts.append(key)
            size = 0
    return cuts


def _depth(reports: list) -> int:
    """Most files that share a key."""
    events = sorted([(_token(_unpack(r["first"])), 0) for r in reports] + [(_token(_unpack(r["last"])), 1) for r in reports])
    open_now = most = 0
    for _, closing in events:
        open_now += -1 if closing else 1
        most = max(most, open_now)
    return most


def _merge(spark: SparkSession, groups: list[list], cuts: list[tuple], order: list[str], unique: list[str] | None, folder: str, schema, target: int, split: str | None, mark_bytes: int) -> list:
    """Each group of files merged, one task a key range; the reports of the new files."""
    arrow = to_arrow_schema(schema)
    width = len(unique or order)
    # A key that counts once may not be cut in two.
    inner = list(dict.fromkeys(c[:width] for c in cuts))
    bounds = [_token(c) for c in inner]
    packed = [None, *map(_pack, inner), None]
    tasks = []
    for files in groups:
        touching: dict[int, list] = {}  # range: its files; a file is looked up, not compared with every range
        for f in sorted(files, key=lambda f: (_token(_unpack(f["first"])), f["path"])):
            first, last = (bisect.bisect_right(bounds, _token(_unpack(f[c])[:width])) for c in ("first", "last"))
            for r in range(first, last + 1):
                touching.setdefault(r, []).append(f)
        for r, mine in sorted(touching.items()):
            tasks.append((len(tasks), packed[r], packed[r + 1], [f["path"] for f in mine], [f["first"] for f in mine]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = _Writer(folder, order, target, split, mark_bytes)
        for batch in batches:
            for task in batch.to_pylist():
                low, high = (task[c] and _unpack(task[c]) for c in ("low", "high"))
                key = order[: len(low or high or order)]
                sources = [(_unpack(k), lambda p=p: _pieces(p, key, low, high, arrow)) for p, k in zip(task["paths"], task["firsts"])]
                before = None
                for table in merge_sorted(sources, order):
                    if unique:
                        last = _key_at(table, unique, table.num_rows - 1)
                        table, before = _first_of_key(table, unique, before), last
                    writer.write(table)
                writer.close()
        yield from writer.report()

    plan = spark.createDataFrame(tasks, "task int, low binary, high binary, paths array<string>, firsts array<binary>")
    return _stored(plan.repartition(max(1, min(len(tasks), 20_000))).mapInArrow(run, _REPORT), folder)


def store_files(spark: SparkSession, path: str) -> tuple[int, list]:
    """The latest version of a store's manifest (0: there is no store) and the reports of its files."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_manifest")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return 0, []
    found = [int(m[1]) for s in system.listStatus(place) if (m := re.search(r"v=(\d+)$", s.getPath().toString())) and system.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    version = max(found, default=0)
    return version, spark.read.schema(_REPORT).parquet(f"{path}/_manifest/v={version}").collect() if version else []


def consolidate(
    records: DataFrame, keys: list[str], path: str, target_bytes: int = 128 << 20, run_bytes: int = 256 << 20, then: tuple[str, ...] = (),
    unique: bool = False, split: str | None = None, range_bytes: int | None = None, fan_in: int = FAN_IN,
) -> DataFrame:
    """Merges ``records`` into the store at ``path`` (made if it isn't there), sorted by ``keys``; returns the manifest.

    No record is lost or doubled: duplicates in, duplicates out. With ``unique`` each key stays once, the row first by the columns ``then``
    (reduced already inside the runs, so a key with a third of all rows is small when ranges are merged). Without it, equal keys are told
    apart by ``then`` and a number of their own, so a hot key is cut into ranges like any other. Files are closed when ``target_bytes`` are
    written, to one row group (1 MB) more, and where the key column ``split`` changes. Keys are whole numbers, texts, dates or timestamps;
    nulls come first. An empty table writes an empty store with an empty manifest. The driver holds a report a file and a key for each
    eighth of a range (1 GB unless given): about 800 000 keys for 100 TB.
    """
    spark, width = records.sparkSession, len(keys)
    bad = [c for c in [*keys, *then] if records.schema[c].dataType.typeName() in ("double", "float", "array", "map", "struct")]
    if bad:
        raise ValueError(f"no order for the columns {bad}")
    if split and split != keys[0]:
        raise ValueError("split must be the first key")
    own = "_number"
    numbered = records if unique else records.withColumn(own, F.xxhash64(F.monotonically_increasing_id(), F.lit(uuid.uuid4().hex)))
    order = [*keys, *then, *([] if unique else [own])]
    single = list(keys) if unique else None
    range_bytes = range_bytes or max(target_bytes, 1 << 30)
    marks = max(1, range_bytes // 8)
    runs = f"{path}/_runs-{uuid.uuid4().hex}"
    _make_folder(spark, runs)
    version, standing = store_files(spark, path)
    reports = _write_runs(numbered, order, runs, run_bytes, single, marks)
    touched = []
    if reports:
        low, high = (f(_token(_unpack(r[c])) for r in reports) for f, c in ((min, "first"), (max, "last")))
        touched = [r for r in standing if _token(_unpack(r["first"]))[:width] <= high[:width] and _token(_unpack(r["last"]))[:width] >= low[:width]]
    kept = [r for r in standing if r not in touched]
    files = reports + touched
    schema = numbered.schema
    while len(files) > fan_in and _depth(files) > fan_in:
        files.sort(key=lambda r: _token(_unpack(r["first"])))
        n = math.ceil(len(files) / fan_in)
        files = _merge(spark, [files[i::n] for i in range(n)], _cuts(files, range_bytes * max(1, n // 2)), order, single, runs, schema, 1 << 62, None, marks)
    made = _merge(spark, [files], _cuts(files, range_bytes), order, single, path, schema, target_bytes, split, marks) if files else []
    rows = sorted([r.asDict(recursive=True) for r in kept + made], key=lambda r: _token(_unpack(r["first"])))
    table = spark.createDataFrame([tuple(r[c] for c in ("path", "file_no", "rows", "bytes", "first", "last", "marks")) for r in rows], _REPORT)
    table.coalesce(1).write.parquet(f"{path}/_manifest/v={version + 1}")
    if not made and not kept:
        records.limit(0).write.parquet(f"{path}/_empty-{version + 1}")
    _remove(spark, runs)
    return manifest(spark, path, keys, records.select(*keys).schema)


def _hadoop(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _make_folder(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.mkdirs(place)


def _remove(spark: SparkSession, path: str) -> None:
    system, place = _hadoop(spark, path)
    system.delete(place, True)


def manifest(spark: SparkSession, path: str, keys: list[str], schema=None) -> DataFrame:
    """Range metadata of a store, from its stored manifest: file, bytes, rows, first_key and last_key of each file."""
    if schema is None:
        schema = read_store(spark, path).select(*keys).schema
    rows = [(r["path"].rpartition("/")[2], r["bytes"], r["rows"], _unpack(r["first"])[: len(keys)], _unpack(r["last"])[: len(keys)]) for r in store_files(spark, path)[1]]
    span = ", ".join(f"`{c}`: {schema[c].dataType.simpleString()}" for c in keys)
    return spark.createDataFrame(rows, f"file string, bytes bigint, rows bigint, first_key struct<{span}>, last_key struct<{span}>")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The records of a store: the files that its latest manifest lists and no others."""
    version, rows = store_files(spark, path)
    if not version:
        raise ValueError(f"{path} is no store")
    found = spark.read.parquet(*[r["path"] for r in rows]) if rows else spark.read.parquet(f"{path}/_empty-{version}")
    return found.drop("_number")


def vacuum(spark: SparkSession, path: str) -> int:
    """Deletes the data files of a store that its latest manifest doesn't list (replaced ones, and those of lost attempts), and older
    manifests; how many files went. Readers of older versions and running consolidations must be done."""
    system, place = _hadoop(spark, path)
    version, rows = store_files(spark, path)
    kept = {r["path"].rpartition("/")[2] for r in rows} | {f"_empty-{version}", "_manifest"}
    gone = 0
    for status in system.listStatus(place) if system.exists(place) else ():
        if status.getPath().getName() not in kept:
            gone += system.delete(status.getPath(), True)
    _, manifests = _hadoop(spark, f"{path}/_manifest")
    for status in system.listStatus(manifests) if system.exists(manifests) else ():
        if status.getPath().getName() != f"v={version}":
            system.delete(status.getPath(), True)
    return gone


def tiny_files(spark: SparkSession, path: str) -> DataFrame:
    """Files on disk as a table (path, n_bytes, body, arrived_at) for ``extract_records``; a scan packs many of them into one task. Bodies that
    aren't UTF-8 have their bad bytes replaced."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    listed = found.select("path", F.col("length").alias("n_bytes"), F.col("content").alias("body"), F.col("modificationTime").alias("arrived_at"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.decode("utf-8", "replace") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), batch.column(3)], ["path", "n_bytes", "body", "arrived_at"])

    return listed.mapInArrow(run, "path string, n_bytes bigint, body string, arrived_at timestamp")


def consolidate_files(
    files: DataFrame, body: str = "body", kind: str = "kind", keys: dict[str, str] | None = None,
    arrival: str = "arrived_at", path: str | None = None, target_bytes: int = 128 << 20, **options: int,
) -> tuple[str, DataFrame]:
    """All records of the tiny files, each key once (of unequal deliveries the first to arrive), as a sorted store: its path and manifest.

    Files of the store hold one ``kind`` each. Keys have their declared types; the rest of a record is its text.
    """
    keys = keys or {"uid": "bigint", "idx": "int"}
    path = path or scratch_path(files.sparkSession, "store")
    records = extract_records(files, body, keys, keep=(kind, arrival))
    return path, consolidate(records, [kind, *keys], path, target_bytes, then=(arrival, "record"), unique=True, split=kind, **options)
