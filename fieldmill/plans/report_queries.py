"""Queries of aggregates, rankings, pivots and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldmill.operators import aggregates as ag
from fieldmill.operators.ranks import numbered
from fieldmill.plans import base as B
from fieldmill.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


P, M, R, C, V = (f"WITH {x} " for x in (B.POINTS, B.MASKS, B.RUNS, B.CAMERAS, B.VECTORS))
_N = "CASE WHEN isfinite(r.{0}) THEN r.{0} END"


def _mean(c):
    return f"round(coalesce(avg({_N.format(c)}), 0), 6) AS {c}"


_STAGE = R + f", a AS (SELECT split_part(label, '_', 1) AS label, count(*) AS n, string_agg(DISTINCT cluster_method, ', ' ORDER BY cluster_method) AS methods, {_mean('iou')}, {_mean('conf')}, {_mean('conn')} FROM r GROUP BY 1)"


def _stage(s, d):
    r = B.runs(s, d).withColumn("label", F.substring_index("label", "_", 1))
    out = ag.stage_aggregate(r, ["label"], ["iou", "conf", "conn"], ["cluster_method"])
    return out.select("label", "n", F.col("cluster_method_set").alias("methods"), *(F.round(c, 6).alias(c) for c in ("iou", "conf", "conn")))


@query("a1_stage_aggregate", _STAGE + "SELECT * FROM a")
def a1(s, d):
    return _stage(s, d)


@query("w3_winner", _STAGE + "SELECT * FROM a ORDER BY iou DESC, conn DESC, conf DESC, label LIMIT 1")
def w3(s, d):
    return ag.winner(_stage(s, d), ["iou", "conn", "conf"], ["label"])


@query("pv7_next_stage", _STAGE + ", w AS (SELECT label FROM a ORDER BY iou DESC, conn DESC, conf DESC, label LIMIT 1) SELECT scene_id, CASE (SELECT label FROM w) WHEN 'base' THEN 0 WHEN 'sh0' THEN 1 WHEN 'mesh' THEN 2 ELSE 3 END AS mode FROM scene_catalog")
def p7w(s, d):
    best = ag.winner(_stage(s, d), ["iou", "conn", "conf"], ["label"]).select("label")  # one row
    mode = F.when(F.col("label") == "base", 0).when(F.col("label") == "sh0", 1).when(F.col("label") == "mesh", 2).otherwise(3)
    return load(s, d, "scene_catalog").join(F.broadcast(best)).select("scene_id", mode.alias("mode"))


@query("a2_parsed_means", "SELECT event_type, count(DISTINCT user_id) AS n, round(coalesce(avg(try_cast(props->>'k' AS DOUBLE)), 0), 6) AS k FROM events GROUP BY event_type")
def a2(s, d):
    e = load(s, d, "events").withColumn("k", F.get_json_object("props", "$.k"))
    return ag.parsed_means(e, ["event_type"], ["k"], "user_id").select("event_type", "n", F.round("k", 6).alias("k"))


@query("a3_conditional_means", R + "SELECT scene_id, sum(masks)::BIGINT AS masks, round(coalesce(avg(CASE WHEN isfinite(iou) THEN iou END) FILTER (masks > 1000), 0), 6) AS iou FROM r GROUP BY scene_id")
def a3(s, d):
    iou = ag.mean_or_zero(F.when(F.col("masks") > 1000, ag.known(F.col("iou"))))
    return B.runs(s, d).groupBy("scene_id").agg(F.sum("masks").cast("bigint").alias("masks"), F.round(iou, 6).alias("iou"))


@query("a4_cluster_sizes", P + ", c AS (SELECT scene_id, label, count(*) AS n, avg(conf) AS r FROM p WHERE label >= 0 GROUP BY ALL) SELECT scene_id, min(n) AS low, median(n) AS mid, max(n) AS high, round(round(avg(r), 12), 6) AS mean, round(sum(r * n) / greatest(sum(n), 1), 6) AS weighted FROM c GROUP BY scene_id")
def a4(s, d):
    c = B.points(s, d).filter("label >= 0").groupBy("scene_id", "label").agg(F.count("*").alias("n"), F.avg("conf").alias("r"))
    return c.groupBy("scene_id").agg(
        F.min("n").alias("low"), F.median("n").alias("mid"), F.max("n").alias("high"), F.round(F.round(F.avg("r"), 12), 6).alias("mean"),  # ties don't hang on the order of sums
        F.round(F.sum(F.col("r") * F.col("n")) / F.greatest(F.sum("n"), F.lit(1)), 6).alias("weighted"),
    )


@query("a7_quantile_gates", M + "SELECT scene_id, round(quantile_cont(area / (height::BIGINT * width), 0.9), 6) AS q90, round(quantile_cont(area / (height::BIGINT * width), 0.95), 6) AS q95 FROM m GROUP BY scene_id")
def a7(s, d):
    m = B.masks(s, d).withColumn("ratio", F.col("area") / (F.col("height").cast("bigint") * F.col("width")))
    return ag.quantiles(m, "ratio", [0.9, 0.95], ["scene_id"]).select("scene_id", F.round("q90", 6).alias("q90"), F.round("q95", 6).alias("q95"))


_EXT = "sqrt(" + " + ".join(f"pow(quantile_cont({a}, 0.9) - quantile_cont({a}, 0.1), 2)" for a in "xyz") + ")"
_STD = "coalesce(CASE WHEN count(*) >= 2 THEN sqrt(" + " + ".join(f"pow(2 * stddev_samp({a}), 2)" for a in "xyz") + ") END, 0)"


@query("a9_robust_extent", P + f"SELECT scene_id, label, round({_EXT}, 6) AS extent FROM p GROUP BY ALL")
def a9(s, d):
    return ag.robust_extent(B.points(s, d), ["x", "y", "z"], ["scene_id", "label"]).select("scene_id", "label", F.round("extent", 6).alias("extent"))


@query("a10_spread", P + f"SELECT scene_id, label, round({_STD}, 6) AS spread FROM p GROUP BY ALL")
def a10(s, d):
    return ag.spread(B.points(s, d), ["x", "y", "z"], ["scene_id", "label"]).select("scene_id", "label", F.round("spread", 6).alias("spread"))


@query("a11_mask_scale", P + f"SELECT scene_id, label, round(CASE label % 3 WHEN 0 THEN count(*) WHEN 1 THEN {_STD} ELSE sqrt(count(*) * {_EXT}) END, 6) AS scale FROM p WHERE label >= 0 GROUP BY scene_id, label")
def a11(s, d):
    p = B.points(s, d).filter("label >= 0")
    by = ["scene_id", "label"]
    joined = p.groupBy(*by).agg(F.count("*").alias("n")).join(ag.spread(p, ["x", "y", "z"], by), by).join(ag.robust_extent(p, ["x", "y", "z"], by), by)
    how = F.col("label") % 3
    scale = F.when(how == 0, F.col("n").cast("double")).when(how == 1, F.col("spread")).otherwise(F.sqrt(F.col("n") * F.col("extent")))
    return joined.select(*by, F.round(scale, 6).alias("scale"))


@query("a14_score_vote", P + ", v AS (SELECT scene_id, round(x) AS cell, label, sum(conf) AS s FROM p WHERE label >= 0 GROUP BY ALL) SELECT scene_id, cell, label, round(s / greatest(t, 1e-6), 6) AS share FROM (SELECT *, sum(s) OVER (PARTITION BY scene_id, cell) AS t, row_number() OVER (PARTITION BY scene_id, cell ORDER BY round(s, 9) DESC, label) AS k FROM v) WHERE k = 1")
def a14(s, d):
    from fieldmill.operators.vectors import vote

    p = B.points(s, d).filter("label >= 0").withColumn("cell", F.round("x"))
    return vote(p, ["scene_id", "cell"], "label", "conf").select("scene_id", "cell", "label", F.round("share", 6).alias("share"))


@query("a16_class_scores", V + ", z AS (SELECT label, e FROM v), u AS (SELECT label, generate_subscripts(e, 1) AS cls, unnest(e) AS v FROM z), m AS (SELECT cls, avg(v) AS a, stddev_samp(v) AS sd FROM u GROUP BY cls), c AS (SELECT label, cls, avg((v - a) / sd) AS s FROM u JOIN m USING (cls) GROUP BY ALL) SELECT label, cls, round(s, 6) AS score FROM c QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(s, 9) DESC, cls) = 1")
def a16(s, d):
    u = B.vectors(s, d).select("label", F.posexplode("e").alias("cls", "v")).withColumn("cls", (F.col("cls") + 1).cast("bigint"))
    m = u.groupBy("cls").agg(F.avg("v").alias("a"), F.stddev_samp("v").alias("sd"))
    c = u.join(m, "cls").groupBy("label", "cls").agg(F.avg((F.col("v") - F.col("a")) / F.col("sd")).alias("s"))
    return ag.winner(c.withColumn("r", F.round("s", 9)), ["r"], ["cls"], ["label"]).select("label", "cls", F.round("s", 6).alias("score"))


@query("a18_bounding", P + ", c AS (SELECT scene_id, avg(x) AS cx, avg(y) AS cy, avg(z) AS cz FROM p GROUP BY 1) SELECT scene_id, round(any_value(cx), 6) AS cx, round(any_value(cy), 6) AS cy, round(any_value(cz), 6) AS cz, round(sqrt(max(pow(x - cx, 2) + pow(y - cy, 2) + pow(z - cz, 2))) * 1.1, 6) AS radius FROM p JOIN c USING (scene_id) GROUP BY scene_id")
def a18(s, d):
    return ag.bounding(B.points(s, d), ["x", "y", "z"], ["scene_id"]).select("scene_id", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "cz", "radius")))


@query("a21_min_max", P + "SELECT gid, round(CASE WHEN max(x) OVER w - min(x) OVER w < 1e-8 THEN 1 ELSE (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) END, 6) AS n FROM p WINDOW w AS (PARTITION BY scene_id)")
def a21(s, d):
    return ag.min_max(B.points(s, d), "x", "n", ["scene_id"]).select("gid", F.round("n", 6).alias("n"))


@query("a22_running_stats", "SELECT user_id, max(value) AS top, round(coalesce(sum(value) / nullif(count(value), 0), 0), 6) AS mean FROM events GROUP BY user_id")
def a22(s, d):
    return load(s, d, "events").groupBy("user_id").agg(F.max("value").alias("top"), F.round(F.coalesce(F.try_divide(F.sum("value"), F.count("value")), F.lit(0.0)), 6).alias("mean"))


@query("a23_image_metrics", V + ", u AS (SELECT label, unnest(e) AS p, unnest(list_reverse(e)) AS q FROM v) SELECT label, round(avg(abs(p - q)), 6) AS l1, round(avg(pow(p - q, 2)), 6) AS mse, round(20 * log10(1 / sqrt(avg(pow(p - q, 2)))), 6) AS psnr FROM u GROUP BY label")
def a23(s, d):
    u = B.vectors(s, d).select("label", F.explode(F.arrays_zip("e", F.reverse("e").alias("r"))).alias("z")).select("label", F.col("z.e").alias("p"), F.col("z.r").alias("q"))
    mse = F.avg(F.pow(F.col("p") - F.col("q"), F.lit(2)))
    return u.groupBy("label").agg(F.round(F.avg(F.abs(F.col("p") - F.col("q"))), 6).alias("l1"), F.round(mse, 6).alias("mse"), F.round(ag.psnr(mse), 6).alias("psnr"))


@query("a27_status", "SELECT event_type, count(*) AS n, max_by(event_id, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS latest FROM events GROUP BY event_type")
def a27(s, d):
    return load(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.struct("ts", "event_id")).event_id.alias("latest"))


@query("a28_quantile_clamp", M + ", q AS (SELECT scene_id, quantile_cont(scale, 0.75) AS b FROM m GROUP BY 1) SELECT mask_key, round(least(scale, b), 9) AS scale FROM m JOIN q USING (scene_id)")
def a28(s, d):
    m = B.masks(s, d)
    return m.join(ag.quantiles(m, "scale", [0.75], ["scene_id"]), "scene_id").select("mask_key", F.round(F.least("scale", "q75"), 9).alias("scale"))


@query("a29_ema", "SELECT user_id, round(list_reduce(list_prepend(0.0, list(value ORDER BY ts, event_id)), lambda a, x: a * 0.6 + x * (1 - 0.6)), 6) AS ema FROM events WHERE value IS NOT NULL GROUP BY user_id")
def a29(s, d):
    return ag.ema(load(s, d, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", F.round("ema", 6).alias("ema"))


# Rankings


@query("w1_ecdf", M + "SELECT mask_key, round(least(1, count(*) OVER (ORDER BY scale RANGE UNBOUNDED PRECEDING) / greatest(count(*) OVER () - 1, 1)), 6) AS cdf FROM m")
def w1(s, d):
    return ag.ecdf(B.masks(s, d), "scale").select("mask_key", F.round("cdf", 6).alias("cdf"))


def _horner(cs, x: str) -> str:
    out = repr(cs[0])
    for c in cs[1:]:
        out = f"({out} * {x} + {c!r})"
    return out


# Coefficients of Acklam's approximation of the normal quantile.
_PROBIT = (
    (-39.69683028665376, 220.9460984245205, -275.9285104469687, 138.3577518672690, -30.66479806614716, 2.506628277459239),
    (-54.47609879822406, 161.5858368580409, -155.6989798598866, 66.80131188771972, -13.28068155288572, 1.0),
    (-0.007784894002430293, -0.3223964580411365, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783),
    (0.007784695709041462, 0.3224671290700398, 2.445134137142996, 3.754408661907416, 1.0),
)


@query("w2_probit", M + ", c AS (SELECT mask_key, least(greatest(least(1, count(*) OVER (PARTITION BY scene_id ORDER BY scale RANGE UNBOUNDED PRECEDING) / greatest(count(*) OVER (PARTITION BY scene_id) - 1, 1)), 1e-4), 1 - 1e-4) AS p FROM m), "
 "q AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM c) SELECT mask_key, round(CASE WHEN p < 0.02425 THEN "
 + f"{_horner(_PROBIT[2], 't')} / {_horner(_PROBIT[3], 't')} WHEN p > 1 - 0.02425 THEN -{_horner(_PROBIT[2], 't')} / {_horner(_PROBIT[3], 't')} ELSE {_horner(_PROBIT[0], 'r')} * q / {_horner(_PROBIT[1], 'r')} END, 6) AS z FROM q")
def w2(s, d):
    return ag.ecdf(B.masks(s, d), "scale", per=["scene_id"]).select("mask_key", F.round(ag.probit_of(F.col("cdf")), 6).alias("z"))


_SCALES = R + ", q AS (SELECT label, (run_id % 3) * 0.25 + 0.25 AS scale, max(CASE WHEN isfinite(iou) THEN iou END) AS iou, max(CASE WHEN isfinite(conf) THEN conf END) AS conf FROM r GROUP BY ALL)"


def _by_scale(s, d):
    r = B.runs(s, d).withColumn("scale", F.col("run_id") % 3 * 0.25 + 0.25)
    return r.groupBy("label", "scale").agg(F.max(ag.known(F.col("iou"))).alias("iou"), F.max(ag.known(F.col("conf"))).alias("conf"))


@query("w4_scale_winners", _SCALES + "SELECT scale::DOUBLE AS scale, label FROM q QUALIFY row_number() OVER (PARTITION BY scale ORDER BY iou DESC NULLS LAST, label) = 1")
def w4(s, d):
    return ag.winner(_by_scale(s, d), ["iou"], ["label"], ["scale"]).select("scale", "label")


@query("w5_nulls_first", R + ", a AS (SELECT run_id, CASE WHEN isfinite(iou) THEN iou END AS iou FROM r) SELECT run_id, row_number() OVER (ORDER BY iou DESC NULLS FIRST, run_id) AS place FROM a QUALIFY place <= 50")
def w5(s, d):
    top = B.runs(s, d).select("run_id", ag.known(F.col("iou")).alias("iou")).orderBy(F.desc_nulls_first("iou"), "run_id").limit(50)
    return top.select("run_id", F.row_number().over(Window.orderBy(F.desc_nulls_first("iou"), "run_id")).cast("bigint").alias("place"))


@query("w6_custom_order", R + "SELECT DISTINCT split_part(label, '_', 1) AS variant, CASE split_part(label, '_', 1) WHEN 'base' THEN 0 WHEN 'sh0' THEN 1 WHEN 'mesh' THEN 2 ELSE 99 END AS place FROM r WHERE label IS NOT NULL")
def w6(s, d):
    v = B.runs(s, d).filter("label is not null").select(F.substring_index("label", "_", 1).alias("variant")).distinct()
    return v.withColumn("place", F.when(F.col("variant") == "base", 0).when(F.col("variant") == "sh0", 1).when(F.col("variant") == "mesh", 2).otherwise(99))


@query("w9_focus_limit", P + "SELECT gid FROM p ORDER BY label = 2 DESC, round(pow(x - 8, 2) + pow(y, 2) + pow(z, 2), 9), gid LIMIT 100")
def w9(s, d):
    d2 = F.round(F.pow(F.col("x") - 8, F.lit(2)) + F.pow("y", F.lit(2)) + F.pow("z", F.lit(2)), 9)
    return B.points(s, d).orderBy(F.desc(F.col("label") == 2), d2, "gid").limit(100).select("gid")


@query("w10_margin", P + ", v AS (SELECT scene_id, label, round(sum(conf), 6) AS s FROM p GROUP BY ALL) SELECT scene_id, label, round(s - lead_s, 6) AS margin FROM (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS lead_s FROM v WINDOW w AS (PARTITION BY scene_id ORDER BY s DESC, label)) WHERE k = 1")
def w10(s, d):
    v = B.points(s, d).groupBy("scene_id", "label").agg(F.round(F.sum("conf"), 6).alias("s"))
    w = Window.partitionBy("scene_id").orderBy(F.desc("s"), "label")
    return v.withColumn("k", F.row_number().over(w)).withColumn("n", F.lead("s").over(w)).filter("k = 1").select("scene_id", "label", F.round(F.col("s") - F.col("n"), 6).alias("margin"))


@query("w11_stratified", P + """, c AS (SELECT label, count(*) AS n FROM p GROUP BY 1), q AS (SELECT *, n * 1000.0::DOUBLE / sum(n) OVER () AS exact, sum(n) OVER () AS total FROM c),
 b AS (SELECT *, least(floor(exact), n) AS base FROM q), t AS (SELECT *, base < n AS room, 1000 - sum(base) OVER () AS rest FROM b),
 k AS (SELECT *, row_number() OVER (PARTITION BY room ORDER BY exact - floor(exact) DESC, label) AS i FROM t),
 z AS (SELECT label, CASE WHEN total <= 1000 THEN n ELSE base + CASE WHEN room AND i <= rest THEN 1 ELSE 0 END END AS take FROM k)
 SELECT gid, label FROM (SELECT gid, label, take, row_number() OVER (PARTITION BY label ORDER BY md5('s' || gid::VARCHAR), gid) AS o FROM p JOIN z USING (label)) WHERE o <= take""")
def w11(s, d):
    return ag.stratified_sample(B.points(s, d).select("gid", "label"), "label", "gid", 1000)


@query("w12_offsets", M + "SELECT mask_key, sum(area) OVER (PARTITION BY scene_id ORDER BY mask_key)::BIGINT AS upto FROM m")
def w12(s, d):
    return ag.running_offsets(B.masks(s, d), ["scene_id"], ["mask_key"], "area", "upto").select("mask_key", "upto")


@query("w13_ranges", P + "SELECT scene_id, label, min(i) AS first, max(i) + 1 AS stop FROM (SELECT scene_id, label, row_number() OVER (PARTITION BY scene_id ORDER BY label, gid) - 1 AS i FROM p) GROUP BY ALL")
def w13(s, d):
    counts = B.points(s, d).groupBy("scene_id", "label").agg(F.count("*").alias("n"))
    stop = F.sum("n").over(Window.partitionBy("scene_id").orderBy("label"))
    return counts.select("scene_id", "label", (stop - F.col("n")).alias("first"), stop.alias("stop"))


@query("w15_robust_core", P + ", m AS (SELECT scene_id, median(x) AS mx, median(y) AS my FROM p GROUP BY 1), k AS (SELECT scene_id, x, y, row_number() OVER (PARTITION BY scene_id ORDER BY round(pow(x - mx, 2) + pow(y - my, 2), 9), gid) AS i, count(*) OVER (PARTITION BY scene_id) AS n FROM p JOIN m USING (scene_id)) SELECT scene_id, bool_and(x BETWEEN 0 AND 12) AS inside FROM k WHERE i <= ceil(0.95 * n) GROUP BY scene_id")
def w15(s, d):
    p = B.points(s, d)
    m = p.groupBy("scene_id").agg(F.median("x").alias("mx"), F.median("y").alias("my"), F.count("*").alias("n"))
    d2 = F.round(F.pow(F.col("x") - F.col("mx"), F.lit(2)) + F.pow(F.col("y") - F.col("my"), F.lit(2)), 9)
    k = numbered(p.join(m, "scene_id").withColumn("d2", d2), ["scene_id"], ["d2", "gid"], "i")
    return k.filter(F.col("i") <= F.ceil(0.95 * F.col("n"))).groupBy("scene_id").agg(F.bool_and(F.col("x").between(0, 12)).alias("inside"))


@query("w18_suffix_order", C + "SELECT uid, row_number() OVER (PARTITION BY scene_id ORDER BY try_cast(regexp_extract(split_part(image_name, '.', 1), '(\\d+)$', 1) AS INT) NULLS FIRST, uid) AS place FROM c")
def w18(s, d):
    number = F.regexp_extract(F.substring_index("image_name", ".", 1), r"(\d+)$", 1).try_cast("int")
    return numbered(B.cameras(s, d).withColumn("k", number), ["scene_id"], [F.asc_nulls_first("k"), "uid"], "place").select("uid", "place")


@query("w19_medians", M + "SELECT scene_id, median(area) AS middle, quantile_disc(area, 0.5) AS low_middle FROM m GROUP BY scene_id")
def w19(s, d):
    return B.masks(s, d).groupBy("scene_id").agg(F.median("area").alias("middle"), F.expr("percentile_disc(0.5) within group (order by area)").cast("bigint").alias("low_middle"))


@query("w20_handle_pick", P + "SELECT label % 2 AS kind, gid FROM (SELECT *, round((pow(x - 5, 2) + pow(y, 2)) / CASE label % 2 WHEN 0 THEN 0.01 ELSE 0.04 END, 9) AS r FROM p WHERE label >= 0) WHERE r <= 1 QUALIFY row_number() OVER (PARTITION BY label % 2 ORDER BY r, gid) = 1")
def w20(s, d):
    r = F.round((F.pow(F.col("x") - 5, F.lit(2)) + F.pow("y", F.lit(2))) / F.when(F.col("label") % 2 == 0, 0.01).otherwise(0.04), 9)
    p = B.points(s, d).filter("label >= 0").withColumn("kind", F.col("label") % 2).withColumn("r", r).filter("r <= 1")
    return p.groupBy("kind").agg(F.min(F.struct("r", "gid")).gid.alias("gid"))


# Pivots and report shapes

_PIV = ", ".join(f"max({m}) FILTER (scale = {s}) AS scale_{t}_{m}" for s, t in ((0.25, "0p25"), (0.5, "0p50"), (0.75, "0p75")) for m in ("iou", "conf"))
_ALL = [0.25, 0.5, 0.75]


def _wide(s, d):
    return ag.wide_scales(_by_scale(s, d), ["label"], "scale", ["iou", "conf"], _ALL)


@query("pv1_pivot_scales", _SCALES + f"SELECT label, {_PIV} FROM q GROUP BY label")
def pv1(s, d):
    return _wide(s, d)


@query("pv4_unpivot_scales", _SCALES + "SELECT label, scale::DOUBLE AS scale, iou, conf FROM q WHERE iou IS NOT NULL OR conf IS NOT NULL")
def pv4(s, d):
    return ag.long_scales(_wide(s, d), ["label"], ["iou", "conf"], _ALL)


@query("pv2_prefixes", _SCALES + "SELECT DISTINCT 'scale_' || replace(printf('%.2f', scale), '.', 'p') AS prefix, scale::DOUBLE AS scale FROM q WHERE scale IS NOT NULL")
def pv2(s, d):
    return s.createDataFrame(ag.scale_prefixes(_wide(s, d).columns), "prefix string, scale double")


@query("pv3_scale_columns", _SCALES + f"SELECT label, scale_0p50_iou, scale_0p50_conf FROM (SELECT label, {_PIV} FROM q GROUP BY label)")
def pv3(s, d):
    wide = _wide(s, d)
    return wide.select("label", *(c for c in wide.columns if c.startswith("scale_0p50_")))


@query("pv5_scales", _SCALES + "SELECT DISTINCT scale::DOUBLE AS scale FROM q")
def pv5(s, d):
    return _by_scale(s, d).select("scale").distinct()


@query("pv6_expand_jobs", "SELECT stage, scene_name, variant FROM (VALUES ('A', 'base'), ('A', 'sh0'), ('B', 'mesh')) t(stage, variant), scene_catalog")
def pv6(s, d):
    variants = F.array(*(F.struct(F.lit(a).alias("stage"), F.lit(b).alias("variant")) for a, b in (("A", "base"), ("A", "sh0"), ("B", "mesh"))))
    return load(s, d, "scene_catalog").select("scene_name", F.explode(variants).alias("v")).select("v.stage", "scene_name", "v.variant")


@query("pv8_retry_ladder", "SELECT level, CASE WHEN level >= 1 THEN 512 ELSE 768 END AS rays, CASE WHEN level >= 2 THEN 8000 ELSE 12000 END AS sample FROM range(0, 4) t(level)")
def pv8(s, d):
    ladder = F.map_concat(F.create_map(F.lit("rays"), F.when(F.col("id") >= 1, 512).otherwise(768)), F.create_map(F.lit("sample"), F.when(F.col("id") >= 2, 8000).otherwise(12000)))
    return s.range(4).withColumn("m", ladder).select(F.col("id").alias("level"), F.col("m")["rays"].alias("rays"), F.col("m")["sample"].alias("sample"))


@query("pv9_validators", C + "SELECT 'width' AS rule, uid FROM c WHERE width < 900 UNION ALL SELECT 'angle', uid FROM c WHERE fovx <= fovy UNION ALL SELECT 'camera', uid FROM c WHERE camera_id IS NULL")
def pv9(s, d):
    c = B.cameras(s, d)
    rules = {"width": "width < 900", "angle": "fovx <= fovy", "camera": "camera_id is null"}
    broken = F.filter(F.array(*(F.when(F.expr(test), F.lit(name)) for name, test in rules.items())), lambda x: x.isNotNull())
    return c.select(F.explode(broken).alias("rule"), "uid")


@query("k8_sorted_columns", "SELECT gaussian_backend, scene_id, scene_name, NULL::VARCHAR AS split FROM scene_catalog UNION ALL SELECT NULL, scene_id, NULL, 'all' FROM (SELECT DISTINCT scene_id FROM scene_catalog)")
def k8(s, d):
    catalog = load(s, d, "scene_catalog")
    both = catalog.select("scene_name", "scene_id", "gaussian_backend").unionByName(catalog.select("scene_id").distinct().withColumn("split", F.lit("all")), allowMissingColumns=True)
    return both.select(*sorted(both.columns))


@query("k10_markdown", _STAGE + "SELECT '| ' || coalesce(label, '') || ' | ' || n || ' | ' || printf('%.4f', iou) || ' |' AS line FROM a")
def k10(s, d):
    return ag.markdown(_stage(s, d), ["label", "n", "iou"])


@query("k13_camera_json", C + "SELECT uid, '{\"id\":' || uid || ',\"img_name\":\"' || image_name || '\",\"width\":' || width || '}' AS doc FROM c")
def k13(s, d):
    return B.cameras(s, d).select("uid", F.to_json(F.struct(F.col("uid").alias("id"), F.col("image_name").alias("img_name"), "width")).alias("doc"))


@query("k14_job_paths", C + "SELECT uid, printf('renders/%05d/%s.png', uid, split_part(image_name, '.', 1)) AS path FROM c")
def k14(s, d):
    return B.cameras(s, d).select("uid", F.format_string("renders/%05d/%s.png", F.col("uid"), F.substring_index("image_name", ".", 1)).alias("path"))


# Joins of tables


@query("j1_lookup", C + "SELECT uid, scene_name, family FROM c JOIN scene_catalog USING (scene_id)")
def j1(s, d):
    return B.cameras(s, d).join(load(s, d, "scene_catalog"), "scene_id").select("uid", "scene_name", "family")


_FEAT = "f AS (SELECT DISTINCT gid, f FROM features WHERE f IS NOT NULL)"


@query("j2_aligned", f"WITH {B.POINTS}, {_FEAT} SELECT gid, x, len(f) AS width FROM p JOIN f USING (gid)")
def j2(s, d):
    f = load(s, d, "features").filter("f is not null").select("gid", "f").distinct()
    return B.points(s, d).join(f, "gid").select("gid", "x", F.size("f").alias("width"))


@query("j3_label_colour", P + "SELECT gid, coalesce(red, 0) AS red FROM p LEFT JOIN (VALUES (0, 200), (1, 150), (2, 100), (3, 50)) t(label, red) USING (label)")
def j3(s, d):
    palette = s.createDataFrame([(0, 200), (1, 150), (2, 100), (3, 50)], "label bigint, red int")  # an argument, not data
    return B.points(s, d).join(F.broadcast(palette), "label", "left").select("gid", F.coalesce("red", F.lit(0)).alias("red"))


@query("j9_semi", P + "SELECT gid FROM p WHERE scene_id IN (SELECT scene_id FROM scene_catalog WHERE gaussian_backend = '2dgs')")
def j9(s, d):
    return B.points(s, d).join(load(s, d, "scene_catalog").filter("gaussian_backend = '2dgs'"), "scene_id", "left_semi").select("gid")


@query("j10_anti", P + "SELECT gid FROM p WHERE scene_id NOT IN (SELECT scene_id FROM scene_catalog WHERE gaussian_backend = '2dgs')")
def j10(s, d):
    return B.points(s, d).join(load(s, d, "scene_catalog").filter("gaussian_backend = '2dgs'"), "scene_id", "left_anti").select("gid")


@query("j19_zip_check", P + """, a AS (SELECT scene_id, x, y, row_number() OVER (PARTITION BY scene_id ORDER BY gid) AS i FROM p),
 b AS (SELECT scene_id, x + CASE WHEN gid % 97 = 0 THEN 0.001 ELSE 0.000001 END AS x, y, row_number() OVER (PARTITION BY scene_id ORDER BY gid) AS i FROM p WHERE scene_id % 7 <> 3 OR gid <> (SELECT max(gid) FROM p q WHERE q.scene_id = p.scene_id)),
 j AS (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, greatest(abs(a.x - b.x), abs(a.y - b.y)) AS g, a.i IS NOT NULL AND b.i IS NOT NULL AS paired FROM a FULL JOIN b ON a.scene_id = b.scene_id AND a.i = b.i)
 SELECT scene_id, round(max(g), 9) AS gap, bool_and(paired) AND max(g) <= 1e-5 AS same FROM j GROUP BY scene_id""")
def j19(s, d):
    """Positions against a second table: some moved beyond the tolerance, and in some scenes the last row is missing."""
    a = B.points(s, d).select("scene_id", "gid", "x", "y")
    last = a.groupBy("scene_id").agg(F.max("gid").alias("gid")).filter("scene_id % 7 = 3")
    b = a.join(last, ["scene_id", "gid"], "left_anti").withColumn("x", F.col("x") + F.when(F.col("gid") % 97 == 0, 0.001).otherwise(0.000001))
    return ag.zip_check(a, b, ["scene_id"], "gid", ["x", "y"]).withColumn("gap", F.round("gap", 9))


@query("j21_target_scale", _SCALES + "SELECT label, round(iou, 6) AS iou FROM q WHERE abs(scale - 0.5) < 1e-6")
def j21(s, d):
    return _by_scale(s, d).filter(F.abs(F.col("scale") - 0.5) < 1e-6).select("label", F.round("iou", 6).alias("iou"))


@query("s26_external_labels", P + "SELECT gid, CASE WHEN gid % 11 = 0 OR gid % 7 = 0 THEN -1 ELSE gid % 5 END AS label, CASE WHEN gid % 11 = 0 THEN 'absent' WHEN gid % 7 = 0 THEN 'moved' ELSE 'taken' END AS state FROM p")
def s26(s, d):
    """An outside table that lacks every eleventh point, has others elsewhere, and numbers labels its own way."""
    p = B.points(s, d)
    moved = F.when(F.col("gid") % 7 == 0, F.col("y") + 1).otherwise(F.col("y") + 1e-7)
    outside = p.filter("gid % 11 <> 0").select("gid", (F.col("gid") % 5).alias("label"), "x", moved.alias("y"), F.lit(None).cast("double").alias("z"))
    return ag.external_labels(p, outside, "gid", ["x", "y", "z"])


@query("s32_level_offsets", """WITH n AS (SELECT view_id, mask_id % 4 AS level, count(DISTINCT mask_key) AS n FROM masks WHERE view_id IS NOT NULL GROUP BY ALL), o AS (SELECT *, sum(n) OVER (PARTITION BY view_id ORDER BY level)::BIGINT AS stop FROM n),
 a AS (SELECT view_id, list(mask_key ORDER BY mask_id % 4, mask_key) AS rows FROM (SELECT DISTINCT view_id, mask_id, mask_key FROM masks WHERE view_id IS NOT NULL) GROUP BY view_id)
 SELECT view_id, level, stop - n AS first, stop, list_slice(rows, (stop - n + 1)::BIGINT, stop::BIGINT) AS keys FROM o JOIN a USING (view_id)""")
def s32(s, d):
    """All levels of a view in one array, split again by the levels' lengths."""
    m = load(s, d, "masks").filter("view_id is not null").select("view_id", (F.col("mask_id") % 4).alias("level"), "mask_key").distinct()
    rows = m.groupBy("view_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "mask_key"))), lambda x: x["mask_key"]).alias("rows"))
    slices = ag.level_slices(m.groupBy("view_id", "level").agg(F.count("*").alias("n")), ["view_id"], "level", "n")
    part = F.slice("rows", (F.col("first") + 1).cast("int"), (F.col("stop") - F.col("first")).cast("int"))
    return slices.join(rows, "view_id").select("view_id", "level", "first", "stop", part.alias("keys"))
