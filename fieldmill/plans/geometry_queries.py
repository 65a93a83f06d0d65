"""Queries of activations, rotations, projections, splats and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.functions import geometry as ge
from fieldmill.operators import vectors as vc
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


_G = "WITH g AS (SELECT DISTINCT gid, scene_id, x::DOUBLE AS x, y::DOUBLE AS y, z::DOUBLE AS z, opacity::DOUBLE AS opacity, f_dc::DOUBLE[] AS f_dc, scale::DOUBLE[] AS scale, rot::DOUBLE[] AS rot FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z)) "
_C = f"WITH {B.CAMERAS} "


def full(s, d):
    raw = load(s, d, "gaussians").filter(B.finite("x", "y", "z"))
    one = [F.col(c).cast("double").alias(c) for c in ("x", "y", "z", "opacity")]
    return raw.select("gid", "scene_id", *one, *(F.col(c).cast("array<double>").alias(c) for c in ("f_dc", "scale", "rot"))).distinct()


@query("d1_activated", _G + "SELECT gid, round(1 / (1 + exp(-opacity)), 6) AS opacity, round(exp(list_max(scale)), 6) AS size, round(greatest(0, least(1, 0.28209479177387814 * f_dc[1] + 0.5)), 6) AS red, round(rot[1] / sqrt(list_dot_product(rot, rot)), 6) AS w FROM g")
def d1(s, d):
    g = full(s, d)
    return g.select("gid", F.round(ge.sigmoid(F.col("opacity")), 6).alias("opacity"), F.round(F.exp(F.array_max("scale")), 6).alias("size"), F.round(ge.base_colour(F.col("f_dc")[0]), 6).alias("red"), F.round(ge.unit_quaternion(F.col("rot"))[0], 6).alias("w"))


@query("d2_third_scale", _G + "SELECT gid, CASE len(scale) WHEN 2 THEN '2dgs' WHEN 3 THEN '3dgs' END AS backend, round(CASE len(scale) WHEN 2 THEN greatest(list_min(scale) - 8, -12) ELSE scale[3] END, 6) AS third FROM g")
def d2(s, d):
    third = F.when(F.size("scale") == 2, ge.third_scale(F.col("scale"))).otherwise(F.get("scale", F.lit(2)))
    return full(s, d).select("gid", ge.backend(F.col("scale")).alias("backend"), F.round(third, 6).alias("third"))


_R = "q AS (SELECT gid, rot[1] / n AS w, rot[2] / n AS a, rot[3] / n AS b, rot[4] / n AS c, exp(scale[1]) AS s0, exp(scale[2]) AS s1, exp(CASE len(scale) WHEN 2 THEN greatest(list_min(scale) - 8, -12) ELSE scale[3] END) AS s2 FROM (SELECT *, sqrt(list_dot_product(rot, rot)) AS n FROM g))"


@query("d3_covariance", _G + ", " + _R + ", m AS (SELECT gid, [1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)] AS r0, [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)] AS r1, [s0 * s0, s1 * s1, s2 * s2] AS s FROM q) SELECT gid, round(r0[1] * r0[1] * s[1] + r0[2] * r0[2] * s[2] + r0[3] * r0[3] * s[3], 6) AS xx, round(r0[1] * r1[1] * s[1] + r0[2] * r1[2] * s[2] + r0[3] * r1[3] * s[3], 6) AS xy FROM m")
def d3(s, d):
    third = F.when(F.size("scale") == 2, ge.third_scale(F.col("scale"))).otherwise(F.get("scale", F.lit(2)))
    g = full(s, d).withColumn("s", F.transform(F.array(F.col("scale")[0], F.col("scale")[1], third), F.exp))
    cov = ge.covariance6(F.col("rot"), F.col("s"))
    return g.select("gid", F.round(cov[0], 6).alias("xx"), F.round(cov[1], 6).alias("xy"))


@query("x11_quaternion", _G + ", " + _R + "SELECT gid, round(w * 0.8 - a * 0.6, 6) AS pw, round(w * 0.6 + a * 0.8, 6) AS px FROM q")
def x11(s, d):
    q = ge.unit_quaternion(F.col("rot"))
    p = ge.quaternion_product(q, [F.lit(0.8), F.lit(0.6), F.lit(0.0), F.lit(0.0)])
    return full(s, d).select("gid", F.round(p[0], 6).alias("pw"), F.round(p[1], 6).alias("px"))


@query("x12_focal", _C + "SELECT uid, round(width / (2 * tan(fovx / 2)), 6) AS fx, round(2 * atan(height / (2 * (width / (2 * tan(fovx / 2))))), 6) AS fovy2 FROM c")
def x12(s, d):
    fx = ge.fov_to_focal(F.col("fovx"), F.col("width"))
    return B.cameras(s, d).select("uid", F.round(fx, 6).alias("fx"), F.round(ge.focal_to_fov(fx, F.col("height")), 6).alias("fovy2"))


@query("x13_projection", _G + "SELECT gid, round(((x / (z + 1) + 1) * 800 - 1) / 2, 6) AS px, round(((y / (z + 1) + 1) * 600 - 1) / 2, 6) AS py FROM g")
def x13(s, d):
    w = F.col("z") + 1
    return full(s, d).select("gid", F.round(ge.ndc_to_pixel(F.col("x") / w, 800), 6).alias("px"), F.round(ge.ndc_to_pixel(F.col("y") / w, 600), 6).alias("py"))


@query("x14_sh", "WITH g AS (SELECT DISTINCT gid, f_dc::DOUBLE[] AS f, f_rest::DOUBLE[] AS r FROM gaussians WHERE f_rest IS NOT NULL) SELECT gid, round(0.28209479177387814 * f[1] - 0.4886025119029199 * 0.6 * r[1] + 0.4886025119029199 * 0.48 * r[2] - 0.4886025119029199 * 0.64 * r[3], 6) AS v FROM g")
def x14(s, d):
    g = load(s, d, "gaussians").filter("f_rest is not null").select("gid", F.col("f_dc").cast("array<double>").alias("f"), F.col("f_rest").cast("array<double>").alias("r")).distinct()
    value = ge.sh_colour([F.col("f")[0], *(F.col("r")[i] for i in range(3))], [F.lit(0.64), F.lit(0.6), F.lit(0.48)], 1)
    return g.select("gid", F.round(value, 6).alias("v"))


_SH = "WITH g AS (SELECT DISTINCT gid, f_dc::DOUBLE[] AS f, f_rest::DOUBLE[] AS r FROM gaussians WHERE f_rest IS NOT NULL), c AS (SELECT gid, list_concat([f[1]], r) AS k FROM g) "
# The direction is (0.64, 0.6, 0.48); each term is a constant times its polynomial there.
_X, _Y, _Z = 0.64, 0.6, 0.48
_TERMS = {
    3: [(0.28209479177387814, 1), (-0.4886025119029199, _Y), (0.4886025119029199, _Z), (-0.4886025119029199, _X), (1.0925484305920792, _X * _Y), (-1.0925484305920792, _Y * _Z), (0.31539156525252005, 2 * _Z**2 - _X**2 - _Y**2), (-1.0925484305920792, _X * _Z), (0.5462742152960396, _X**2 - _Y**2),
        (-0.5900435899266435, 3 * _X**2 * _Y - _Y**3), (2.890611442640554, _X * _Y * _Z), (-0.4570457994644658, _Y * (4 * _Z**2 - _X**2 - _Y**2)), (0.3731763325901154, 2 * _Z**3 - 3 * _Z * (_X**2 + _Y**2)), (-0.4570457994644658, _X * (4 * _Z**2 - _X**2 - _Y**2)), (1.445305721320277, _Z * (_X**2 - _Y**2)), (-0.5900435899266435, _X**3 - 3 * _X * _Y**2)],
    4: [(2.5033429417967046, _X**3 * _Y - _X * _Y**3), (-1.7701307697799304, _Z * (3 * _X**2 * _Y - _Y**3)), (0.9461746957575601, _X * _Y * (7 * _Z**2 - 1)), (-0.6690465435572892, _Y * (7 * _Z**3 - 3 * _Z)), (0.10578554691520431, 35 * _Z**4 - 30 * _Z**2 + 3), (-0.6690465435572892, _X * (7 * _Z**3 - 3 * _Z)), (0.47308734787878004, (_X**2 - _Y**2) * (7 * _Z**2 - 1)), (-1.7701307697799304, _Z * (_X**3 - 3 * _X * _Y**2)), (0.6258357354491761, _X**4 - 6 * _X**2 * _Y**2 + _Y**4)],
}


def _sh_sql(degree: int) -> str:
    terms = _TERMS[3] + (_TERMS[4] if degree == 4 else [])
    return _SH + "SELECT gid, round(" + " + ".join(f"({c!r}) * ({p!r}) * k[{i + 1}]" for i, (c, p) in enumerate(terms)) + ", 6) AS v FROM c"


def _sh(s, d, degree: int):
    g = load(s, d, "gaussians").filter("f_rest is not null").select("gid", F.concat(F.slice("f_dc", 1, 1), "f_rest").cast("array<double>").alias("k")).distinct()
    value = ge.sh_colour([F.col("k")[i] for i in range(25)], [F.lit(_X), F.lit(_Y), F.lit(_Z)], degree)
    return g.select("gid", F.round(value, 6).alias("v"))


@query("x14_sh_degree3", _sh_sql(3))
def x14c(s, d):
    return _sh(s, d, 3)


@query("x14_sh_degree4", _sh_sql(4))
def x14d(s, d):
    return _sh(s, d, 4)


@query("x11_matrix_quaternion", _G + ", " + _R + "SELECT gid, " + ", ".join(f"round(CASE WHEN w < 0 THEN -{c} ELSE {c} END, 6) AS q{i}" for i, c in enumerate("wabc")) + " FROM q")
def x11m(s, d):
    m = ge.rotation_matrix(ge.unit_quaternion(F.col("rot")))
    flat = full(s, d).select("gid", *(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3)))
    q = ge.matrix_quaternion([[F.col(f"m{i}{j}") for j in range(3)] for i in range(3)])
    return flat.select("gid", *(F.round(v, 6).alias(f"q{i}") for i, v in enumerate(q)))


_MAP = [[0.8, -0.6, 0.1], [0.9, 1.2, 0.0], [0.0, 0.3, 0.5]]


@query("x17_affine_splats", _G + ", " + _R + ", m AS (SELECT gid, [1 - 2 * (b * b + c * c), 2 * (a * b - w * c), 2 * (a * c + w * b)] AS r0, [2 * (a * b + w * c), 1 - 2 * (a * a + c * c), 2 * (b * c - w * a)] AS r1, [2 * (a * c - w * b), 2 * (b * c + w * a), 1 - 2 * (a * a + b * b)] AS r2, [s0, s1, s2] AS s FROM q WHERE s2 IS NOT NULL), "
 "t AS (SELECT gid, [ (0.8 * r0[k] - 0.6 * r1[k] + 0.1 * r2[k]) * s[k] FOR k IN [1, 2, 3]] AS t0, [(0.9 * r0[k] + 1.2 * r1[k]) * s[k] FOR k IN [1, 2, 3]] AS t1 FROM m) "
 "SELECT gid, round(0.8 * x - 0.6 * y + 0.1 * z + 1, 5) AS x, round(list_dot_product(t0, t0), 6) AS xx, round(list_dot_product(t0, t1), 6) AS xy FROM t JOIN g USING (gid) WHERE len(scale) = 3")
def x17s(s, d):
    moved = ge.transform_splats(full(s, d).filter(F.size("scale") == 3).select("gid", "x", "y", "z", "rot", "scale"), _MAP, [1.0, 0.0, -2.0])
    cov = ge.covariance6(F.col("rot"), F.transform("scale", F.exp))
    return moved.select("gid", F.round("x", 5).alias("x"), F.round(cov[0], 6).alias("xx"), F.round(cov[1], 6).alias("xy"))


@query("x16_unproject", _C + "SELECT uid, round((10 - width / 2) * 2 / (width / (2 * tan(fovx / 2))), 6) AS x, round((20 - height / 2) * 2 / (width / (2 * tan(fovx / 2))), 6) AS y FROM c")
def x16(s, d):
    focal = ge.fov_to_focal(F.col("fovx"), F.col("width"))
    x, y, _ = ge.pixel_to_point(F.lit(10), F.lit(20), F.lit(2.0), focal, F.col("width") / 2, F.col("height") / 2)
    return B.cameras(s, d).select("uid", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("x17_affine", _G + "SELECT gid, round(0.8 * x - 0.6 * y + 1, 6) AS x, round(0.6 * x + 0.8 * y - 1, 6) AS y FROM g")
def x17(s, d):
    return full(s, d).select("gid", F.round(0.8 * F.col("x") - 0.6 * F.col("y") + 1, 6).alias("x"), F.round(0.6 * F.col("x") + 0.8 * F.col("y") - 1, 6).alias("y"))


@query("x18_encoding", _G + "SELECT gid, generate_subscripts(e, 1) - 1 AS i, round(unnest(e), 6) AS v FROM (SELECT gid, [y, sin(y), cos(y), sin(2 * y), cos(2 * y), sin(4 * y), cos(4 * y)] AS e FROM g)")
def x18(s, d):
    return full(s, d).select("gid", F.posexplode(ge.position_encoding(F.col("y"), 3)).alias("i", "v")).select("gid", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("x19_schedule", "SELECT event_id, round(exp(ln(0.01) * (1 - least(event_id / 8000, 1)) + ln(0.0001) * least(event_id / 8000, 1)), 9) AS rate FROM events")
def x19(s, d):
    return load(s, d, "events").select("event_id", F.round(ge.log_lerp(F.col("event_id"), 8000, 0.01, 0.0001), 9).alias("rate"))


@query("x20_sanitise", "SELECT stream_id, regexp_replace(stream_id, '[^A-Za-z0-9]', '_', 'g') AS name FROM (SELECT DISTINCT stream_id FROM result_files)")
def x20(s, d):
    return load(s, d, "result_files").select("stream_id").distinct().select("stream_id", F.regexp_replace("stream_id", "[^A-Za-z0-9]", "_").alias("name"))


@query("x21_scale_prefix", f"WITH {B.MASKS} SELECT mask_key, 'scale_' || replace(printf('%.2f', round(scale, 2)), '.', 'p') AS prefix FROM m")
def x21(s, d):
    return B.masks(s, d).select("mask_key", F.concat(F.lit("scale_"), F.replace(F.format_string("%.2f", F.round("scale", 2)), F.lit("."), F.lit("p"))).alias("prefix"))


@query("x22_paths", "SELECT DISTINCT path, regexp_extract(path, '([^/]+)$', 1) AS base, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\\.[^.]*$', '') AS stem FROM aux_files")
def x22(s, d):
    base = F.regexp_extract("path", "([^/]+)$", 1)
    return load(s, d, "aux_files").select("path").distinct().select("path", base.alias("base"), F.regexp_replace(base, r"\.[^.]*$", "").alias("stem"))


@query("x23_env_values", "SELECT event_id, try_cast(props->>'k' AS INT) AS k, lower(event_type) IN ('1', 'true', 'yes', 'view') AS flag FROM events")
def x23(s, d):
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.lower("event_type").isin("1", "true", "yes", "view").alias("flag"))


@query("x24_config_regex", "SELECT doc_id, regexp_extract(text, 'job=([0-9a-f]+)', 1) AS job FROM documents WHERE regexp_matches(text, 'job=[0-9a-f]+')")
def x24(s, d):
    docs = load(s, d, "documents")
    return docs.filter(F.col("text").rlike("job=[0-9a-f]+")).select("doc_id", F.regexp_extract("text", "job=([0-9a-f]+)", 1).alias("job"))


@query("x25_json_defaults", "SELECT DISTINCT file_id, coalesce(try_cast(body->>'total_selected_masks' AS BIGINT), 0) AS masks, coalesce(body->'summary'->>'gaussian_backend', body->>'gaussian_backend', 'unknown') AS backend FROM result_files")
def x25(s, d):
    v = lambda p: F.get_json_object("body", p)
    return load(s, d, "result_files").select("file_id", F.coalesce(v("$.total_selected_masks").try_cast("bigint"), F.lit(0)).alias("masks"), F.coalesce(v("$.summary.gaussian_backend"), v("$.gaussian_backend"), F.lit("unknown")).alias("backend")).distinct()


@query("x26_view_id", "SELECT DISTINCT uid, coalesce(image_name, lpad(uid::VARCHAR, 7, '0')) AS view_id FROM cameras")
def x26(s, d):
    return load(s, d, "cameras").select("uid", F.coalesce("image_name", F.lpad(F.col("uid").cast("string"), 7, "0")).alias("view_id")).distinct()


@query("x29_overlay", _G + "SELECT gid, round(greatest(0, least(1, 0.35 * f_dc[1] + 0.65 * f_dc[2])), 6) AS mixed FROM g")
def x29(s, d):
    return full(s, d).select("gid", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.35 * F.col("f_dc")[0] + 0.65 * F.col("f_dc")[1])), 6).alias("mixed"))


@query("x30_number_text", "SELECT DISTINCT file_id, coalesce(printf('%.4f', try_cast(body->>'mean_mask_best_iou' AS DOUBLE)), body->>'mean_mask_best_iou') AS shown FROM result_files")
def x30(s, d):
    v = F.get_json_object("body", "$.mean_mask_best_iou")
    number = v.try_cast("double")
    shown = F.when(number.isNotNull(), F.format_string("%.4f", number)).otherwise(v)
    return load(s, d, "result_files").select("file_id", shown.alias("shown")).distinct()


@query("x31_log_tail", "SELECT doc_id, CASE WHEN length(text) > 40 THEN '...' || right(text, 40) ELSE text END AS tail FROM documents WHERE text IS NOT NULL")
def x31(s, d):
    return load(s, d, "documents").filter("text is not null").select("doc_id", F.when(F.length("text") > 40, F.concat(F.lit("..."), F.right("text", F.lit(40)))).otherwise(F.col("text")).alias("tail"))


@query("x32_resize", _C + "SELECT uid, CASE WHEN width > 1200 THEN 1200 ELSE width END AS w, round(height * least(1200 / width, 1))::BIGINT AS h FROM c")
def x32(s, d):
    return B.cameras(s, d).select("uid", F.when(F.col("width") > 1200, 1200).otherwise(F.col("width")).cast("bigint").alias("w"), F.round(F.col("height") * F.least(1200 / F.col("width"), F.lit(1.0))).cast("bigint").alias("h"))


@query("x33_list_parse", "SELECT label, len(string_split(label, '_')) AS parts FROM (SELECT DISTINCT label FROM ablation_runs WHERE label IS NOT NULL)")
def x33(s, d):
    return load(s, d, "ablation_runs").filter("label is not null").select("label").distinct().select("label", F.size(F.split("label", "_")).cast("bigint").alias("parts"))


# Splats: the points of a scene seen along z from 1.5 away, on a frame of 64 x 64

_S = _G + """, s0 AS (SELECT gid, scene_id, (x - avg(x) OVER (PARTITION BY scene_id)) * 0.02 AS x, y AS y, z + 1.5 AS depth, 0.02 AS s, 1 / (1 + exp(-coalesce(opacity, 0))) AS alpha, f_dc[1] AS c FROM g),
 s1 AS (SELECT *, ((x / depth * 60.0 * 2 / 64 + 1) * 64 - 1) / 2 AS px, ((y / depth * 60.0 * 2 / 64 + 1) * 64 - 1) / 2 AS py, 60.0 / depth AS j, -60.0 * x / (depth * depth) AS jx, -60.0 * y / (depth * depth) AS jy FROM s0 WHERE depth > 0.2),
 s2 AS (SELECT *, s * s * (j * j + jx * jx) + 0.3 AS va, s * s * jx * jy AS vb, s * s * (j * j + jy * jy) + 0.3 AS vc FROM s1), s3 AS (SELECT *, va * vc - vb * vb AS det, (va + vc) / 2 AS mid FROM s2),
 s4 AS (SELECT *, vc / det AS ca, -vb / det AS cb, va / det AS cc, ceil(3 * sqrt(mid + sqrt(greatest(0.1, mid * mid - det))))::INT AS radius FROM s3),
 s5 AS (SELECT *, least(greatest(floor((px - radius) / 16), 0), 4)::INT AS x0, least(greatest(floor((px + radius + 15) / 16), 0), 4)::INT AS x1, least(greatest(floor((py - radius) / 16), 0), 4)::INT AS y0, least(greatest(floor((py + radius + 15) / 16), 0), 4)::INT AS y1 FROM s4),
 s6 AS (SELECT *, unnest(range(x0, x1)) AS tx FROM s5), tl AS (SELECT *, unnest(range(y0, y1)) AS ty FROM s6),
 p1 AS (SELECT *, tx * 16 + unnest(range(16)) AS qx FROM tl), p2 AS (SELECT *, ty * 16 + unnest(range(16)) AS qy FROM p1),
 p3 AS (SELECT *, -0.5 * (ca * (px - qx) * (px - qx) + cc * (py - qy) * (py - qy)) - cb * (px - qx) * (py - qy) AS power FROM p2),
 sh AS (SELECT scene_id, gid, qy, qx, depth, c, least(0.99, alpha * exp(power)) AS alpha FROM p3 WHERE power <= 0),
 b1 AS (SELECT *, exp(sum(ln(1 - least(alpha, 0.99))) OVER (PARTITION BY scene_id, qy, qx ORDER BY depth, gid ROWS UNBOUNDED PRECEDING)) AS rest FROM sh WHERE alpha >= 1 / 255),
 b2 AS (SELECT scene_id, qy, qx, sum(c * alpha * rest / (1 - alpha)) AS c, min(rest) AS rest FROM b1 WHERE rest >= 1e-4 GROUP BY ALL)
"""


def _splats(s, d):
    g = full(s, d)
    g = g.join(g.groupBy("scene_id").agg(F.avg("x").alias("middle")), "scene_id")
    middle = F.col("middle")
    p = g.select("gid", "scene_id", ((F.col("x") - middle) * 0.02).alias("x"), "y", (F.col("z") + 1.5).alias("depth"), F.lit(0.02).alias("s"), ge.sigmoid(F.coalesce("opacity", F.lit(0.0))).alias("alpha"), F.col("f_dc")[0].alias("c"))
    return ge.screen_splats(p, 64, 64, 60.0)


@query("x15_conic", _S + "SELECT gid, round(ca, 6) AS ca, round(cb, 6) AS cb, round(cc, 6) AS cc, radius FROM s4")
def x15(s, d):
    return _splats(s, d).select("gid", *(F.round(c, 6).alias(c) for c in ("ca", "cb", "cc")), "radius")


@query("j17_tiles", _S + "SELECT gid, tx, ty FROM tl")
def j17(s, d):
    return ge.splat_tiles(_splats(s, d), 64, 64).select("gid", F.col("tx").cast("bigint").alias("tx"), F.col("ty").cast("bigint").alias("ty"))


@query("w14_blend", _S + "SELECT scene_id, round(sum(c), 3) AS total, count(*) FILTER (rest < 0.99) AS covered FROM b2 GROUP BY scene_id")
def w14(s, d):
    out = ge.blend(ge.shade(_splats(s, d), 64, 64), ["scene_id", "y", "x"], ["depth", "gid"], ["c"])
    return out.groupBy("scene_id").agg(F.round(F.sum("c"), 3).alias("total"), F.count(F.when(F.col("left") < 0.99, 1)).alias("covered"))


@query("j18_pick", _S + "SELECT gid FROM s4 WHERE (px - 32) * (px - 32) + (py - 32) * (py - 32) <= greatest(radius, 4) * greatest(radius, 4)")
def j18(s, d):
    d2 = (F.col("px") - 32) * (F.col("px") - 32) + (F.col("py") - 32) * (F.col("py") - 32)
    reach = F.greatest(F.col("radius"), F.lit(4))
    return _splats(s, d).filter(d2 <= reach * reach).select("gid")


@query("z11_seed_pick", _S + ", k AS (SELECT *, round(exp(-((px - 32) * (px - 32) + (py - 32) * (py - 32)) / 32) / (depth + 1e-4), 9) AS w FROM s4) SELECT scene_id, gid FROM k QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY w DESC, gid) = 1")
def z11(s, d):
    d2 = (F.col("px") - 32) * (F.col("px") - 32) + (F.col("py") - 32) * (F.col("py") - 32)
    w = F.round(F.exp(-d2 / 32) / (F.col("depth") + 1e-4), 9)
    return _splats(s, d).withColumn("w", w).groupBy("scene_id").agg(F.max(F.struct("w", (-F.col("gid")).alias("n"))).alias("b")).select("scene_id", (-F.col("b.n")).alias("gid"))


@query("z14_box_corners", "SELECT i, (((i & 1) * 2 - 1) * 0.5 + 1)::DOUBLE AS x, ((((i >> 1) & 1) * 2 - 1) * 0.25)::DOUBLE AS y, ((((i >> 2) & 1) * 2 - 1) * 0.125)::DOUBLE AS z FROM range(8) t(i)")
def z14(s, d):
    sign = lambda b: (F.shiftright("id", b).bitwiseAND(F.lit(1)) * 2 - 1).cast("double")
    return s.range(8).select(F.col("id").alias("i"), (sign(0) * 0.5 + 1).alias("x"), (sign(1) * 0.25).alias("y"), (sign(2) * 0.125).alias("z"))


@query("a24_ssim", _S + """, kw AS (SELECT i, exp(-(i * i) / 4.5) AS w FROM range(-5, 6) t(i)), kk AS (SELECT a.i AS dy, b.i AS dx, a.w * b.w / (SELECT sum(w) * sum(w) FROM kw) AS w FROM kw a, kw b),
 im AS MATERIALIZED (SELECT scene_id, qy, qx, c AS a, c * 0.9 AS b FROM b2), nr AS (SELECT scene_id, qy + dy AS qy, qx + dx AS qx, sum(w * a) AS ma, sum(w * b) AS mb, sum(w * a * a) AS aa, sum(w * b * b) AS bb, sum(w * a * b) AS ab FROM im, kk GROUP BY ALL)
 SELECT scene_id, round(avg((2 * ma * mb + 1e-4) * (2 * (ab - ma * mb) + 9e-4) / ((ma * ma + mb * mb + 1e-4) * (aa - ma * ma + bb - mb * mb + 9e-4))), 6) AS ssim FROM nr JOIN im USING (scene_id, qy, qx) GROUP BY scene_id""")
def a24(s, d):
    out = ge.blend(ge.shade(_splats(s, d), 64, 64), ["scene_id", "y", "x"], ["depth", "gid"], ["c"])
    return ge.ssim(out.select("scene_id", "y", "x", F.col("c").alias("a"), (F.col("c") * 0.9).alias("b")), ["scene_id"]).select("scene_id", F.round("ssim", 6).alias("ssim"))


def axes_sql(rows: str, dim: int, axes: int, squarings: int = 14) -> str:
    """CTEs that end in ``ax`` (k, i, a): the leading axes of the vectors ``rows`` (key, i, x), by squaring the covariance until its first
    axis is all that is left, and taking that away. Each axis points so that its largest component is positive."""
    out = [f"rw AS ({rows})", "mu AS MATERIALIZED (SELECT i, avg(x) AS m FROM rw GROUP BY i)", "cn AS MATERIALIZED (SELECT key, i, x - m AS x FROM rw JOIN mu USING (i))",
           "c0 AS MATERIALIZED (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) / (SELECT count(DISTINCT key) FROM rw) AS v FROM cn a JOIN cn b USING (key) GROUP BY ALL)"]
    for k in range(axes):
        now = f"c{k}"
        for t in range(squarings):
            out.append(f"s{k}_{t} AS MATERIALIZED (SELECT a.i AS i, b.j AS j, sum(a.v * b.v) AS v FROM (SELECT i, j, v / (SELECT sum(v) FROM {now} WHERE i = j) AS v FROM {now}) a JOIN (SELECT i, j, v / (SELECT sum(v) FROM {now} WHERE i = j) AS v FROM {now}) b ON a.j = b.i GROUP BY ALL)")
            now = f"s{k}_{t}"
        out.append(f"t{k} AS MATERIALIZED (SELECT i, v / (SELECT sqrt(sum(v * v)) FROM {now} WHERE j = (SELECT max_by(i, v) FROM {now} WHERE i = j)) AS a FROM {now} WHERE j = (SELECT max_by(i, v) FROM {now} WHERE i = j))")
        out.append(f"a{k} AS MATERIALIZED (SELECT i, a * sign((SELECT max_by(a, abs(a)) FROM t{k})) AS a FROM t{k})")
        out.append(f"l{k} AS MATERIALIZED (SELECT sum(x.a * v * y.a) AS l FROM c{k} JOIN a{k} x ON x.i = c{k}.i JOIN a{k} y ON y.i = c{k}.j)")
        out.append(f"c{k + 1} AS MATERIALIZED (SELECT c.i, c.j, v - l * x.a * y.a AS v FROM c{k} c JOIN a{k} x ON x.i = c.i JOIN a{k} y ON y.i = c.j, l{k})")
    out.append("ax AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, i, a FROM a{k}" for k in range(axes)) + ")")
    return ", ".join(out)


_PCA = "WITH " + axes_sql("SELECT vec_id AS key, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings", 64, 3) + ", pc AS (SELECT key AS gid, " + ", ".join(f"sum(x * a) FILTER (k = {k}) AS pc{k}" for k in range(3)) + " FROM cn JOIN ax USING (i) GROUP BY key) "


@query("a19_pca", _PCA + "SELECT gid, " + ", ".join(f"round(pc{k}, 5) AS pc{k}" for k in range(3)) + " FROM pc")
def a19(s, d):
    v = B.vectors(s, d)
    mean, axes = vc.principal_axes(v, "e", 64, 3)
    parts = [vc.dot(F.transform("e", lambda x: x), F.array(*map(F.lit, a.tolist()))) - float(a @ mean) for a in axes]
    return v.select("gid", *(F.round(p, 5).alias(f"pc{i}") for i, p in enumerate(parts)))


@query("g19_feature_map", _PCA + "SELECT gid, " + ", ".join(f"round((pc{k} - min(pc{k}) OVER ()) / greatest(max(pc{k}) OVER () - min(pc{k}) OVER (), 1e-8), 4) AS {c}" for k, c in enumerate(("red", "green", "blue"))) + " FROM pc")
def g19f(s, d):
    """Colours of feature vectors: their three principal components, each scaled to 0..1."""
    v = B.vectors(s, d)
    mean, axes = vc.principal_axes(v, "e", 64, 3)
    parts = v.select("gid", *((vc.dot("e", F.array(*map(F.lit, a.tolist()))) - float(a @ mean)).alias(c) for a, c in zip(axes, ("red", "green", "blue"))))
    span = parts.agg(*(f(c).alias(f"{n}_{c}") for c in ("red", "green", "blue") for n, f in (("low", F.min), ("high", F.max))))  # one row
    scaled = [F.round((F.col(c) - F.col(f"low_{c}")) / F.greatest(F.col(f"high_{c}") - F.col(f"low_{c}"), F.lit(1e-8)), 4).alias(c) for c in ("red", "green", "blue")]
    return parts.join(F.broadcast(span)).select("gid", *scaled)


@query("a20_oriented_box", f"WITH {B.POINTS}, " + axes_sql("SELECT gid AS key, unnest([1, 2, 3]) AS i, unnest([x, y, z]) AS x FROM p WHERE label = 2", 3, 3) + ", lo AS (SELECT key, k, sum(x * a) AS v FROM cn JOIN ax USING (i) GROUP BY ALL) SELECT " + ", ".join(f"round(quantile_cont(abs(v), 0.98) FILTER (k = {k}) * 1.05, 5) AS extent{k}" for k in range(3)) + " FROM lo")
def a20(s, d):
    p = B.points(s, d).filter("label = 2").withColumn("v", F.array("x", "y", "z"))
    mean, axes = vc.principal_axes(p, "v", 3, 3)
    local = [sum((F.col(c) - float(m)) * float(a) for c, m, a in zip("xyz", mean, axis)) for axis in axes]
    return p.agg(*(F.round(F.percentile(F.abs(v), F.lit(0.98)) * 1.05, 5).alias(f"extent{i}") for i, v in enumerate(local)))
