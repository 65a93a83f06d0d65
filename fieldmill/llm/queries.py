"""Named queries of the language-model operators over the test tables, with production parameters on whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldmill.llm.density import box_clusters, describe_boxes, describe_clusters, vector_clusters
from fieldmill.llm.mixing import mix_shards, mix_shares, mix_sources
from fieldmill.llm.neighbours import as_pairs, cosine_neighbours, neighbour_recall, position_neighbours
from fieldmill.llm.spans import shared_intervals, shared_passages, shared_share
from fieldmill.llm.tokenizer import decode_corpus, encode_corpus
from fieldmill.session import load


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    features, gaussians = load(spark, root, "features"), load(spark, root, "gaussians")
    feature = as_pairs(cosine_neighbours(features, "gid", "f", dim=32, k=5, min_sim=0.96), features.count())
    place = as_pairs(position_neighbours(gaussians, "gid", "scene_id", ["x", "y", "z"], k=5, radius=0.12), gaussians.count())
    return feature.select(F.lit("feature").alias("space"), "*").union(place.select(F.lit("xyz").alias("space"), "*"))


def recall_figures(spark: SparkSession, root: str) -> DataFrame:
    """Every vector whose id is divisible by 100 against all rows: its true best partners and how many of them the index finds."""
    features = load(spark, root, "features")
    return neighbour_recall(features, cosine_neighbours(features, "gid", "f", dim=32, k=5, min_sim=0.96), "gid", "f", dim=32, k=5, min_sim=0.96)


def p2_recall(spark: SparkSession, root: str) -> DataFrame:
    """Queries and true pairs of ``recall_figures``, and whether 0.99 of the pairs are found."""
    return recall_figures(spark, root).select("queries", "pairs", (F.col("recall") >= 0.99).alias("reached"))


def _gaussian_clusters(spark: SparkSession, root: str) -> DataFrame:
    return vector_clusters(load(spark, root, "features"), "gid", "f", dim=32, min_sim=0.96, min_size=5)


_RUN = ("run_id", "suite_id", ["num_clusters", "cluster_confidence_mean"], [3, 0.02])


def _run_clusters(spark: SparkSession, root: str) -> DataFrame:
    return box_clusters(load(spark, root, "ablation_runs"), *_RUN, min_size=3)


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    both = _gaussian_clusters(spark, root).select(F.lit("gaussian").alias("entity"), "root_id", "member_id")
    return both.union(_run_clusters(spark, root).select(F.lit("run").alias("entity"), "root_id", "member_id"))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    vectors = describe_clusters(_gaussian_clusters(spark, root), load(spark, root, "features"), "gid", "f", dim=32)
    runs = describe_boxes(_run_clusters(spark, root), load(spark, root, "ablation_runs"), *_RUN)
    return vectors.select(F.lit("gaussian").alias("entity"), "*").union(runs.select(F.lit("run").alias("entity"), "*"))


def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode_corpus(load(spark, root, "documents"), "doc_id", "text")


def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every text again from its ids, as a digest."""
    text = F.col("text")
    return decode_corpus(p6_ids(spark, root), "doc_id", "ids").select("doc_id", F.md5(text).alias("digest"), F.length(text).cast("bigint").alias("n_chars"))


def _mix(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    return mix_sources(load(spark, root, "documents"), load(spark, root, "mix_targets"))


def p7_mix(spark: SparkSession, root: str) -> DataFrame:
    return _mix(spark, root)[0]


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    return mix_shares(*_mix(spark, root))


def p7_kept(spark: SparkSession, root: str) -> DataFrame:
    """Whether each share is met to 0.001 (of the sources that have texts) and no record is used too often."""
    shares = p7_shares(spark, root).withColumn("there", F.col("records") > 0)
    total = F.sum(F.when(F.col("there"), F.col("target_share"))).over(Window.partitionBy("mix_id"))
    met = F.abs(F.col("actual_share") - F.when(F.col("there"), F.col("target_share")).otherwise(0.0) / total) <= 0.001
    return shares.select("mix_id", "source", "target_share", "there", (met & (F.col("most_repeats") <= F.col("max_repeats"))).alias("kept"))


def p7_shards(spark: SparkSession, root: str) -> DataFrame:
    return mix_shards(_mix(spark, root)[0])


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_intervals(load(spark, root, "documents"), "doc_id", "text", min_len=200)


def p8_share(spark: SparkSession, root: str) -> DataFrame:
    return shared_share(load(spark, root, "documents"), "doc_id", "text", min_len=200)


def p8_passages(spark: SparkSession, root: str) -> DataFrame:
    return shared_passages(load(spark, root, "documents"), "doc_id", "text", min_len=200)


QUERIES = {
    "p2_found": p2_found, "p2_recall": p2_recall, "p5_found": p5_found, "p5_clusters": p5_clusters,
    "p6_ids": p6_ids, "p6_decoded": p6_decoded, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_shards": p7_shards, "p7_kept": p7_kept,
    "p8_found": p8_found, "p8_share": p8_share, "p8_passages": p8_passages,
}
_UNIT = """f AS (SELECT DISTINCT gid, f::DOUBLE[] AS f FROM features WHERE len(f) = 32 AND len(list_filter(f, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(f, lambda v: v <> 0)) > 0),
 u AS (SELECT gid, list_transform(f, lambda v: v / sqrt(list_dot_product(f, f))) AS u FROM f),
 s AS (SELECT a.gid AS a, b.gid AS b, round(list_dot_product(a.u, b.u), 6) AS s FROM u a JOIN u b ON a.gid <> b.gid WHERE round(list_dot_product(a.u, b.u), 6) >= 0.96)"""

_WINDOWS = """d AS (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 200), w AS (SELECT doc_id, i, substring(text, i + 1, 200) AS t FROM (SELECT doc_id, text, unnest(range(length(text) - 199)) AS i FROM d)),
 k AS (SELECT t FROM w GROUP BY t HAVING min(doc_id) < max(doc_id)), h AS (SELECT doc_id, i FROM w SEMI JOIN k USING (t)),
 o AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS n FROM h), g AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM o),
 r AS (SELECT doc_id, min(i)::INT AS span_start, (max(i) + 200)::INT AS span_end FROM g GROUP BY doc_id, g)"""

_CLUSTERS = f"""WITH RECURSIVE {_UNIT}, c(node, root) AS (SELECT gid, gid FROM u UNION SELECT s.b, c.root FROM c JOIN s ON s.a = c.node),
 g AS (SELECT node, min(root) AS root FROM c GROUP BY node),
 q AS (SELECT DISTINCT run_id, suite_id, num_clusters AS n, cluster_confidence_mean AS k FROM ablation_runs WHERE num_clusters IS NOT NULL AND isfinite(cluster_confidence_mean)),
 l AS (SELECT a.run_id AS a, b.run_id AS b FROM q a JOIN q b ON a.suite_id = b.suite_id AND abs(a.n - b.n) <= 3 AND abs(a.k - b.k) <= 0.02 + 1e-9),
 t(node, root) AS (SELECT run_id, run_id FROM q UNION SELECT l.b, t.root FROM t JOIN l ON l.a = t.node), h AS (SELECT node, min(root) AS root FROM t GROUP BY node)"""

SQL: dict[str, str] = {
    "p2_recall": f"WITH {_UNIT}, n AS (SELECT a, b FROM s WHERE a % 100 = 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5) SELECT count(DISTINCT a) AS queries, count(*) AS pairs, true AS reached FROM n",
    "p5_found": f"""{_CLUSTERS}
 SELECT 'gaussian' AS entity, root AS root_id, node AS member_id FROM (SELECT *, count(*) OVER (PARTITION BY root) AS z FROM g) WHERE z >= 5 AND node <> root
 UNION ALL SELECT 'run', root, node FROM (SELECT *, count(*) OVER (PARTITION BY root) AS z FROM h) WHERE z >= 3 AND node <> root""",
    "p5_clusters": f"""{_CLUSTERS}, gz AS (SELECT root, node, count(*) OVER (PARTITION BY root) AS z FROM g QUALIFY z >= 5), hz AS (SELECT root, node, count(*) OVER (PARTITION BY root) AS z FROM h QUALIFY z >= 3),
 gc AS (SELECT root, list(x ORDER BY i) AS c FROM (SELECT root, i, sum(x) AS x FROM (SELECT root, generate_subscripts(u.u, 1) AS i, unnest(u.u) AS x FROM gz JOIN u ON gid = node) GROUP BY ALL) GROUP BY root),
 gs AS (SELECT root, node, z, row_number() OVER (PARTITION BY root ORDER BY round(list_dot_product(u.u, c), 6) DESC, node) AS k FROM gz JOIN u ON gid = node JOIN gc USING (root)),
 hm AS (SELECT root, node, z, n / 3.0::DOUBLE AS x, k / 0.02 AS y, avg(n / 3.0::DOUBLE) OVER (PARTITION BY root) AS mx, avg(k / 0.02) OVER (PARTITION BY root) AS my FROM hz JOIN q ON run_id = node),
 hs AS (SELECT root, node, z, row_number() OVER (PARTITION BY root ORDER BY round((x - mx) * (x - mx) + (y - my) * (y - my), 9), node) AS k FROM hm)
 SELECT 'gaussian' AS entity, root AS root_id, z AS size, list(node ORDER BY k) FILTER (k <= 3) AS typical FROM gs GROUP BY ALL UNION ALL SELECT 'run', root, z, list(node ORDER BY k) FILTER (k <= 3) FROM hs GROUP BY ALL""",
    "p8_passages": f"""WITH {_WINDOWS}, c AS (SELECT doc_id, span_start, substring(text, span_start + 1, span_end - span_start) AS passage FROM r JOIN d USING (doc_id)), f AS (SELECT passage, doc_id, min(span_start) AS s FROM c GROUP BY ALL)
 SELECT md5(passage) AS digest, length(passage) AS n_chars, count(*) AS records, min(doc_id) AS first_record, min_by(s, doc_id) AS first_start, passage FROM f GROUP BY passage""",

    "p2_found": f"""WITH {_UNIT}, n AS (SELECT 'feature' AS space, a, b FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5),
 p AS (SELECT DISTINCT gid, scene_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z)),
 e AS (SELECT a.gid AS a, b.gid AS b, round(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)), 6) AS d FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.gid <> b.gid),
 m AS (SELECT 'xyz' AS space, a, b FROM e WHERE d <= 0.12 QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) <= 5)
 SELECT DISTINCT space, least(a, b) AS gid_a, greatest(a, b) AS gid_b FROM (FROM n UNION ALL FROM m)""",
    "p6_decoded": "SELECT doc_id, md5(coalesce(text, '')) AS digest, length(coalesce(text, '')) AS n_chars FROM documents",
    "p7_kept": r"""WITH t AS (SELECT mix_id, nullif(regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g'), '') AS source, sum(weight) AS w FROM mix_targets WHERE weight > 0 GROUP BY ALL),
 d AS (SELECT DISTINCT regexp_replace(lower(trim(source)), '[\s\-_]+', '_', 'g') AS source FROM documents WHERE length(text) > 0)
 SELECT mix_id, source, round(w / sum(w) OVER (PARTITION BY mix_id), 6) AS target_share, source IN (SELECT source FROM d WHERE source IS NOT NULL) AS there, true AS kept FROM t WHERE source IS NOT NULL""",
    "p8_found": f"WITH {_WINDOWS} SELECT * FROM r",
    "p8_share": f"""WITH {_WINDOWS}, x AS (SELECT doc_id, sum(span_end - span_start)::BIGINT AS c, count(*) AS n FROM r GROUP BY doc_id), y AS (SELECT doc_id, max(coalesce(length(text), 0)) AS n_chars FROM documents GROUP BY doc_id)
 SELECT doc_id, n_chars, coalesce(c, 0) AS shared_chars, coalesce(n, 0) AS spans, round(CASE WHEN n_chars > 0 THEN coalesce(c, 0) / n_chars ELSE 0 END, 6) AS share FROM y LEFT JOIN x USING (doc_id)""",
}
