"""Queries of the data-pipeline operators of the core (small files, drifting schemas, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.operators import drift, references, smallfiles
from fieldmill.session import cut, load


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    path, _ = smallfiles.consolidate_files(load(spark, root, "aux_files"))
    return smallfiles.read_store(spark, path).select("kind", "uid", "idx")


def _manifest(spark: SparkSession, root: str) -> DataFrame:
    return smallfiles.consolidate_files(load(spark, root, "aux_files"), target_bytes=1 << 20, run_bytes=8 << 20, range_bytes=8 << 20)[1]


def p1_manifest(spark: SparkSession, root: str) -> DataFrame:
    return _manifest(spark, root).select("rows", "first_key", "last_key")


def p1_ranges(spark: SparkSession, root: str) -> DataFrame:
    """The manifest summed up for each kind: records, least and greatest key, and how many files overlap the one before."""
    before = Window.partitionBy("first_key.kind").orderBy("first_key")
    files = _manifest(spark, root).withColumn("over", (F.col("first_key") <= F.lag("last_key").over(before)).cast("int"))
    mixed = (F.col("first_key.kind") != F.col("last_key.kind")).cast("int")
    return files.groupBy(F.col("first_key.kind").alias("kind")).agg(
        F.sum("rows").alias("rows"), F.min("first_key.uid").alias("first_uid"), F.max("last_key.uid").alias("last_uid"),
        F.coalesce(F.sum("over"), F.lit(0)).cast("bigint").alias("overlaps"), F.sum(mixed).cast("bigint").alias("mixed"),
    )


def _drift(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    files = drift.single_files(load(spark, root, "result_files"))
    fields = cut(drift.read_fields(files), "fields")
    return files, fields, drift.schema_changes(fields)


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return _drift(spark, root)[2]


def p3_table(spark: SparkSession, root: str) -> DataFrame:
    files, fields, changes = _drift(spark, root)
    rows, types = drift.typed_values(fields, changes)
    return drift.consistent_table(files, rows, types)


def p3_failed_casts(spark: SparkSession, root: str) -> DataFrame:
    _, fields, changes = _drift(spark, root)
    return drift.failed_casts(*drift.typed_values(fields, changes))


def p3_statistics(spark: SparkSession, root: str) -> DataFrame:
    """The statistics by file summed up for each stream: leaf paths of each type, in how many files and rows."""
    fields = drift.read_fields(drift.single_files(load(spark, root, "result_files")))
    return drift.drift_statistics(fields).filter("path not like '%.%'").select("stream_id", "path", "type", "files", "rows")


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    cameras, images, masks, files = (load(spark, root, t) for t in ("cameras", "images", "masks", "aux_files"))
    named = cameras.withColumn("stem", references.stem(F.col("image_name")))
    stems = images.withColumn("stem", references.stem(F.col("name")))
    found = [
        ("cameras", "image_name", references.reference_states(named, "uid", ["scene_id", "stem"], "created_at", stems, ["scene_id", "stem"], "arrived_at", "deleted_at")),
        ("masks", "uid", references.reference_states(masks, "mask_key", ["uid"], "created_at", cameras, ["uid"], "arrived_at")),
    ]
    # The three path fields lead to the same files: their references are stacked and joined once.
    fields = ("features_path", "masks_path", "mask_scales_path")
    cells = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), references.below_root(F.col(c)).alias("place")) for c in fields))).alias("cell")
    led = cameras.select("uid", "created_at", cells).filter("cell.place is not null").select(F.struct("cell.field", "uid").alias("ref"), "cell.place", "created_at")
    places = files.select(references.below_root(F.col("path")).alias("place"), "arrived_at", "deleted_at")
    paths = references.reference_states(led, "ref", ["place"], "created_at", places, ["place"], "arrived_at", "deleted_at")
    paths = paths.select(F.lit("cameras").alias("ref_table"), F.col("ref_id.field").alias("ref_field"), F.col("ref_id.uid").alias("ref_id"), "state", "period")
    parts = [f.select(F.lit(t).alias("ref_table"), F.lit(c).alias("ref_field"), "ref_id", "state", "period") for t, c, f in found]
    return parts[0].union(parts[1]).union(paths)


def p4_report(spark: SparkSession, root: str) -> DataFrame:
    return references.orphan_report(p4_found(spark, root))


QUERIES = {
    "p1_found": p1_found, "p1_manifest": p1_manifest, "p1_ranges": p1_ranges, "p3_found": p3_found, "p3_table": p3_table, "p3_statistics": p3_statistics, "p3_failed_casts": p3_failed_casts,
    "p4_found": p4_found, "p4_report": p4_report,
}

_PLACE = r"""nullif(list_reduce(string_split(replace({c}, '\', '/'), '/'), lambda a, x: CASE WHEN x IN ('', '.') THEN a
  WHEN x = '..' THEN regexp_replace(a, '/?[^/]*$', '') WHEN a = '' THEN x ELSE a || '/' || x END, ''), '')"""

_P4 = """
WITH c AS (SELECT DISTINCT uid, scene_id, image_name, features_path, masks_path, mask_scales_path, created_at FROM cameras),
refs AS (
 SELECT 'cameras' AS ref_table, 'image_name' AS ref_field, uid AS ref_id, created_at, 'image' AS t, scene_id || '/' || split_part(image_name, '.', 1) AS k FROM c
 UNION ALL SELECT 'cameras', 'features_path', uid, created_at, 'file', {f} FROM c
 UNION ALL SELECT 'cameras', 'masks_path', uid, created_at, 'file', {m} FROM c
 UNION ALL SELECT 'cameras', 'mask_scales_path', uid, created_at, 'file', {s} FROM c
 UNION ALL SELECT DISTINCT 'masks', 'uid', mask_key, created_at, 'camera', uid::VARCHAR FROM masks),
targets AS (
 SELECT 'image' AS t, scene_id || '/' || split_part(name, '.', 1) AS k, arrived_at, deleted_at FROM images
 UNION ALL SELECT 'file', {p}, arrived_at, deleted_at FROM aux_files
 UNION ALL SELECT 'camera', uid::VARCHAR, arrived_at, NULL FROM cameras),
states AS (SELECT t, k, count(*) FILTER (deleted_at IS NULL) AS alive, min(arrived_at) FILTER (deleted_at IS NULL) AS earliest FROM targets WHERE k IS NOT NULL GROUP BY t, k),
found AS (SELECT DISTINCT ref_table, ref_field, ref_id,
 CASE WHEN alive IS NULL THEN 'missing' WHEN alive = 0 THEN 'deleted' WHEN earliest > created_at THEN 'late' END AS state, strftime(created_at, '%Y-%m') AS period
 FROM refs LEFT JOIN states USING (t, k) WHERE k IS NOT NULL)
"""
_P4 = _P4.format(**{a: _PLACE.format(c=c) for a, c in zip("fmsp", ("features_path", "masks_path", "mask_scales_path", "path"))})

SQL = {
    "p1_found": r"""
WITH o AS (SELECT kind, unnest(regexp_extract_all(body, '\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\}')) AS r FROM aux_files)
SELECT DISTINCT kind, (r->>'uid')::BIGINT AS uid, (r->>'idx')::INT AS idx FROM o WHERE json_valid(r) AND r->>'uid' IS NOT NULL AND r->>'idx' IS NOT NULL""",
    "p1_ranges": """WITH r AS (SELECT kind, unnest(json_extract(CASE WHEN ltrim(body, ' \n\r\t' || chr(65279)) LIKE '[%' THEN body END, '$[*]')) AS r FROM aux_files WHERE json_valid(body)
 UNION ALL SELECT kind, trim(x, ' ,[]' || chr(13) || chr(9) || chr(65279)) FROM (SELECT kind, unnest(string_split(body, chr(10))) AS x FROM aux_files) WHERE json_valid(trim(x, ' ,[]' || chr(13) || chr(9) || chr(65279)))),
 k AS (SELECT DISTINCT kind, (r->>'uid')::BIGINT AS uid, (r->>'idx')::INT AS idx FROM r WHERE r->>'uid' IS NOT NULL AND r->>'idx' IS NOT NULL)
 SELECT kind, count(*) AS rows, min(uid) AS first_uid, max(uid) AS last_uid, 0::BIGINT AS overlaps, 0::BIGINT AS mixed FROM k GROUP BY kind""",
    "p3_statistics": """WITH f AS (SELECT DISTINCT file_id, stream_id, body FROM result_files WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
 k AS (SELECT stream_id, k, json_type(body, '$."' || k || '"') AS t, body->>('$."' || k || '"') AS v, body FROM (SELECT *, unnest(json_keys(body)) AS k FROM f))
 SELECT stream_id, k AS path, CASE WHEN t IN ('UBIGINT', 'BIGINT', 'HUGEINT') THEN 'integer' WHEN t = 'DOUBLE' THEN 'decimal' WHEN t = 'VARCHAR' THEN 'string' WHEN t = 'BOOLEAN' THEN 'boolean' ELSE 'list' END AS type,
 count(*) AS files, count(*) AS rows FROM k WHERE t NOT IN ('OBJECT', 'NULL') AND k NOT LIKE '%.%' GROUP BY ALL""",
    "p4_found": _P4 + "SELECT * FROM found WHERE state IS NOT NULL",
    "p4_report": _P4 + "SELECT ref_table, ref_field, state, period, count(*) AS refs FROM found WHERE state IS NOT NULL GROUP BY ALL",
}
