"""JSON, JSON-lines and CSV logs: scans that take missing files as empty, and append sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUS = (
    "job_id string, stage string, scene string, status string, log_path string, gpu_id int, oom_fallback_level int, return_code int, "
    "detected_oom boolean, retry_planned boolean, duration_sec double, actual_config map<string,string>, timestamp string"
)
MANIFEST = "job_id string, stage string, scene string, variant string, gpu_id int, status string, log_path string, started string, ended string"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(place)
    return found is not None and len(found) > 0


def read_status(spark: SparkSession, path: str) -> DataFrame:
    """Status records; fields that a status doesn't have are null, torn lines are left out, a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], STATUS)
    return spark.read.schema(STATUS).option("mode", "DROPMALFORMED").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    if not exists(spark, path):
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("header", True).csv(path)


def append_status(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("append").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, part: str) -> None:
    """One directory a part; few files each, however many tasks hold its rows."""
    df.repartition(part, F.pmod(F.xxhash64(*df.columns[:1]), F.lit(4))).write.mode("overwrite").partitionBy(part).parquet(path)


def merged_config(saved: dict, given: dict) -> dict:
    """Saved values, replaced by the given ones that aren't null."""
    return saved | {k: v for k, v in given.items() if v is not None}


def read_or_empty(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    """A JSON, JSON-lines or CSV (with header) scan with a schema; a missing file is an empty table, torn lines are left out."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("mode", "DROPMALFORMED")
    return reader.option("header", True).csv(path) if kind == "csv" else reader.json(path)


def write_fixed_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """CSV with a header of exactly ``columns`` in their order; doubles with six decimals, nulls empty, missing columns empty."""
    kinds = dict(df.dtypes)
    cell = lambda c: F.lit(None).cast("string") if c not in kinds else F.format_string("%.6f", F.col(c)) if kinds[c] in ("double", "float") else F.col(c).cast("string")
    shown = [F.when(F.col(c).isNotNull(), cell(c)).alias(c) if c in kinds else cell(c).alias(c) for c in columns]
    df.select(*shown).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def report_lines(title: str, sections: list[tuple[str, DataFrame]], spark: SparkSession) -> DataFrame:
    """``ordinal``, ``line`` of a Markdown report: a title, and for each section its heading and a table of its (few) rows in their order.

    Reports are read by people, so a section has at most 1 000 rows; more are an error. Floats have four digits, nulls are empty.
    """
    out = [f"# {title}", ""]
    for heading, df in sections:
        rows = df.limit(1001).collect()
        if len(rows) > 1000:
            raise ValueError(f"section {heading} has more than 1000 rows")
        text = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
        out += [f"## {heading}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(map(text, r)) + " |" for r in rows] + [""]
    return spark.createDataFrame(list(enumerate(out)), "ordinal bigint, line string")


def overridden(saved: DataFrame, given: DataFrame, key: str) -> DataFrame:
    """Configurations as maps, by ``key``: the saved values, replaced by the given ones that aren't null (``config`` in both)."""
    new = given.select(key, F.map_filter("config", lambda k, v: v.isNotNull()).alias("_new"))
    rest = F.map_filter("config", lambda k, v: ~F.coalesce(F.map_contains_key("_new", k), F.lit(False)))
    merged = F.when(F.col("_new").isNull(), F.col("config")).otherwise(F.map_concat(rest, "_new"))
    return saved.join(new, key, "left").select(key, merged.alias("config"))


def oom_rows(status: DataFrame) -> DataFrame:
    """Records of jobs that ran out of memory or on a fallback level."""
    return status.filter("coalesce(oom_fallback_level, 0) > 0 or coalesce(detected_oom, false)")
