"""Queries of filters, set algebra, labels and selection states."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import filters as fl
from fieldmill.operators import labels as lb
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


P, M, R, C = (f"WITH {x} " for x in (B.POINTS, B.MASKS, B.RUNS, B.CAMERAS))


@query("f1_keep_or_all", P + "SELECT gid, scene_id FROM (SELECT *, coalesce(opacity > 4, false) AS hit, max(coalesce(opacity > 4, false)::INT) OVER (PARTITION BY scene_id) AS anyhit FROM p) WHERE hit OR anyhit = 0")
def f1(s, d):
    return fl.keep_or_all(B.points(s, d), F.col("opacity") > 4, ["scene_id"]).select("gid", "scene_id")


@query("f1_nothing_hit", P + "SELECT gid FROM p")
def f1b(s, d):
    return fl.keep_or_all(B.points(s, d), F.col("opacity") > 1e9).select("gid")


@query("f2_undo", P + "SELECT gid FROM p WHERE label >= 0")
def f2(s, d):
    return fl.SelectionStack(B.points(s, d)).select(F.col("label") >= 0).select(F.col("conf") >= 0.5).undo().rows.select("gid")


@query("f2_undo_all", P + "SELECT 'two' AS step, gid FROM p WHERE label >= 0 AND conf >= 0.5 UNION ALL SELECT 'three', gid FROM p WHERE label >= 0 AND conf >= 0.5 UNION ALL SELECT 'none', gid FROM p")
def f2a(s, d):
    """A third selection hits nothing, so it keeps all of the second; then everything is taken back (once more than there are selections)."""
    stack = fl.SelectionStack(B.points(s, d)).select(F.col("label") >= 0).select(F.col("conf") >= 0.5)
    two = stack.rows
    three = stack.select(F.col("conf") > 9).rows
    none = stack.clear().undo().rows
    return two.select(F.lit("two").alias("step"), "gid").union(three.select(F.lit("three"), "gid")).union(none.select(F.lit("none"), "gid"))


@query("f3_prune", P + "SELECT gid FROM p WHERE NOT coalesce(conf < 0.25, false)")
def f3(s, d):
    return B.points(s, d).filter(~F.coalesce(F.col("conf") < 0.25, F.lit(False))).select("gid")


_SC = "g AS (SELECT DISTINCT gid, opacity::DOUBLE AS opacity, x::DOUBLE AS x, scale::DOUBLE[] AS scale FROM gaussians WHERE isfinite(x))"


def _scaled(s, d):
    return load(s, d, "gaussians").filter(B.finite("x")).select("gid", F.col("opacity").cast("double").alias("opacity"), F.col("x").cast("double").alias("x"), F.col("scale").cast("array<double>").alias("scale")).distinct()


@query("f4_prune_predicate", f"WITH {_SC} SELECT gid FROM g WHERE 1 / (1 + exp(-opacity)) < 0.5 OR abs(x) > 10 OR exp(list_max(scale)) > 0.1 * 0.4")
def f4(s, d):
    test = fl.prune_mask(1 / (1 + F.exp(-F.col("opacity"))), F.abs("x"), F.transform("scale", F.exp), 0.5, 10, 0.4)
    return _scaled(s, d).filter(test).select("gid")


@query("f5_clone", P + "SELECT gid, label FROM p UNION ALL SELECT gid, label FROM p WHERE conf > 0.9")
def f5(s, d):
    return fl.clone_points(B.points(s, d).select("gid", "label", "conf"), F.col("conf") > 0.9).select("gid", "label")


@query("f6_split", f"WITH {_SC}, t AS (SELECT coalesce(list_max(scale) > -3.5, false) AS big FROM g) SELECT big, count(*) * CASE WHEN big THEN 2 ELSE 1 END AS n FROM t GROUP BY big")
def f6(s, d):
    out = fl.split_points(_scaled(s, d).withColumn("big", F.coalesce(F.array_max("scale") > -3.5, F.lit(False))), F.col("big"), 2, "scale", ["x"])
    return out.groupBy("big").agg(F.count("*").alias("n"))


@query("f7_label_filter", P + "SELECT gid FROM p WHERE label IN (1, 3, 5) AND conf >= 0.6")
def f7(s, d):
    return B.points(s, d).filter(fl.label_filter(F.col("label"), F.col("conf"), [1, 3, 5], 0.6)).select("gid")


@query("f8_part_filter", P + "SELECT 'on' AS mode, gid FROM p WHERE label = 2 AND conf >= 0.5 AND NOT coalesce(opacity < 0, false) UNION ALL SELECT 'off', gid FROM p WHERE label = 2")
def f8(s, d):
    part = B.points(s, d).filter("label = 2")
    hidden = F.coalesce(F.col("opacity") < 0, F.lit(False))
    on, off = (fl.part_filter(part, F.col("conf"), t, hidden).select(F.lit(m).alias("mode"), "gid") for m, t in (("on", 0.5), ("off", 0.0)))
    return on.union(off)


@query("f9_hidden_union", P + "SELECT gid FROM p WHERE coalesce(opacity < 0, false) OR label < 0 OR conf < 0.1")
def f9(s, d):
    return B.points(s, d).filter(fl.hidden_union(F.col("opacity") < 0, F.col("label") < 0, F.col("conf") < 0.1)).select("gid")


@query("f10_soft_delete", P + "SELECT gid, CASE WHEN label < 0 THEN 0.0 ELSE opacity END AS opacity FROM p")
def f10(s, d):
    return B.points(s, d).select("gid", F.when(F.col("label") < 0, 0.0).otherwise(F.col("opacity")).alias("opacity"))


@query("f11_override", P + "SELECT gid, coalesce(CASE WHEN conf > 0.8 THEN 0.5 END, x) AS x FROM p")
def f11(s, d):
    return B.points(s, d).select("gid", F.coalesce(F.when(F.col("conf") > 0.8, 0.5), F.col("x")).alias("x"))


@query("f12_frustum_cull", P + "SELECT gid FROM p WHERE z + 0.25 > 0.2")
def f12(s, d):
    return B.points(s, d).filter(F.col("z") + 0.25 > 0.2).select("gid")


@query("f13_marquee", P + "SELECT gid FROM p WHERE x BETWEEN 1 AND 9 AND y BETWEEN -0.1 AND 0.1 AND label >= 0")
def f13(s, d):
    return B.points(s, d).filter(F.col("x").between(1, 9) & F.col("y").between(-0.1, 0.1) & (F.col("label") >= 0)).select("gid")


@query("f14_box_clip", P + ", q AS (SELECT gid, scene_id, abs((x - 5) * 0.8 + y * 0.6) <= 3 + 1e-5 AND abs((x - 5) * -0.6 + y * 0.8) <= 2 + 1e-5 AND abs(z) <= 0.1 + 1e-5 AS hit FROM p) SELECT gid FROM (SELECT *, bool_or(hit) OVER (PARTITION BY scene_id) AS anyhit FROM q) WHERE hit OR NOT anyhit")
def f14(s, d):
    box = fl.inside_box([F.col("x") - 5, F.col("y"), F.col("z")], [[0.8, 0.6, 0], [-0.6, 0.8, 0], [0, 0, 1]], [3, 2, 0.1])
    return fl.keep_or_all(B.points(s, d), box, ["scene_id"]).select("gid")


@query("f15_scale_band", M + "SELECT mask_key FROM m WHERE abs(scale - 0.5) <= 0.2 AND area >= 500 AND area <= 0.03 * (height::BIGINT * width)")
def f15(s, d):
    pixels = F.col("height").cast("bigint") * F.col("width")
    return B.masks(s, d).filter(fl.scale_band(F.col("scale"), F.col("area"), pixels, 0.5, 0.2, 500, 0.03)).select("mask_key")


@query("f16_background", M + ", q AS (SELECT mask_key, area / (height::BIGINT * width) AS ratio, mask_key % 5 AS touches FROM m), t AS (SELECT quantile_cont(ratio, 0.9) AS a, quantile_cont(ratio, 0.95) AS b FROM q) SELECT mask_key FROM q, t WHERE ratio >= b OR ratio >= a AND touches >= 2 OR touches / 4.0 >= 1.0 AND touches >= 3")
def f16(s, d):
    q = B.masks(s, d).select("mask_key", (F.col("area") / (F.col("height").cast("bigint") * F.col("width"))).alias("ratio"), (F.col("mask_key") % 5).alias("touches"))
    gates = q.agg(F.percentile("ratio", F.lit(0.9)).alias("a"), F.percentile("ratio", F.lit(0.95)).alias("b"))  # one row
    test = fl.background_like(F.col("ratio"), F.col("touches"), F.col("touches") / 4, F.col("a"), F.col("b"), F.lit(1.0))
    return q.join(F.broadcast(gates)).filter(test).select("mask_key")


@query("f17_fallback_rows", "SELECT event_id, (props->>'k')::INT AS k FROM events WHERE (props->>'k')::INT > 50 OR event_type = 'error'")
def f17(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return load(s, d, "events").filter((k > 50) | (F.col("event_type") == "error")).select("event_id", k.alias("k"))


@query("f18_oom_log", "SELECT doc_id FROM documents WHERE contains(lower(text), 'status=failed') OR contains(lower(text), 'out of memory')")
def f18(s, d):
    return load(s, d, "documents").filter(fl.any_substring(F.col("text"), ["status=FAILED", "out of memory"])).select("doc_id")


@query("f19_scene_filter", "SELECT scene_id, scene_name FROM scene_catalog WHERE family = 'object_ring' AND scene_name IN (SELECT scene_name FROM scene_catalog WHERE source_scale_dims = 3)")
def f19(s, d):
    catalog = load(s, d, "scene_catalog")
    names = catalog.filter("source_scale_dims = 3").select("scene_name").distinct()
    return catalog.filter("family = 'object_ring'").join(names, "scene_name", "left_semi").select("scene_id", "scene_name")


@query("f20_ordered_lookup", "SELECT pos, scene_id, scene_name FROM (VALUES (0, 7), (1, 3), (2, 12)) AS w(pos, scene_id) JOIN scene_catalog USING (scene_id)")
def f20(s, d):
    return fl.lookup_ordered(load(s, d, "scene_catalog").select("scene_id", "scene_name"), "scene_id", [7, 3, 12, 1], 3).select("pos", "scene_id", "scene_name")


@query("f21_stride", C + "SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY scene_id ORDER BY image_name, uid) - 1 AS i FROM c) WHERE i % 4 = 0 AND i < 40")
def f21(s, d):
    return fl.every_nth(B.cameras(s, d), ["scene_id"], ["image_name", "uid"], 4, 10).select("uid")


@query("f22_degenerate", M + "SELECT view_id FROM m GROUP BY view_id HAVING count(DISTINCT area) >= 2")
def f22(s, d):
    return B.masks(s, d).groupBy("view_id").agg(F.count_distinct("area").alias("n")).filter("n >= 2").select("view_id")


@query("f23_opacity_reset", P + "SELECT gid, round(ln(least(1 / (1 + exp(-opacity)), 0.01) / (1 - least(1 / (1 + exp(-opacity)), 0.01))), 6) AS opacity FROM p WHERE opacity IS NOT NULL")
def f23(s, d):
    return B.points(s, d).filter("opacity is not null").select("gid", F.round(fl.logit_cap(F.col("opacity")), 6).alias("opacity"))


@query("f25_merge_update", P + "SELECT gid, CASE WHEN conf > 0.7 THEN x * 2 ELSE x END AS x, label FROM p")
def f25(s, d):
    base = B.points(s, d).select("gid", "x", "label", "conf")
    changes = base.filter("conf > 0.7").select("gid", (F.col("x") * 2).alias("x"))
    return fl.merge_update(base, changes, "gid", ["x"]).select("gid", "x", "label")


@query("s15_systematic_sample", C + "SELECT uid FROM (SELECT uid, row_number() OVER (PARTITION BY scene_id ORDER BY image_name, uid) - 1 AS i FROM c) WHERE i % 10 < 3")
def s15(s, d):
    return fl.systematic_sample(B.cameras(s, d), ["scene_id"], ["image_name", "uid"], 3).select("uid")


@query("s16_train_test", C + "SELECT uid, CASE WHEN (row_number() OVER (PARTITION BY scene_id ORDER BY image_name, uid) - 1) % 8 = 0 THEN 'test' ELSE 'train' END AS split FROM c")
def s16(s, d):
    return fl.holdout_split(B.cameras(s, d), ["scene_id"], ["image_name", "uid"], 8).select("uid", "split")


# Set operations


@query("u1_append_offset", P + ", a AS (SELECT gid, label FROM p WHERE scene_id < 20), b AS (SELECT gid, label FROM p WHERE scene_id >= 20) SELECT gid, label FROM a UNION ALL SELECT gid, (SELECT max(label) FROM a) + dense_rank() OVER (ORDER BY label) FROM b")
def u1(s, d):
    p = B.points(s, d).select("gid", "label", "scene_id")
    return lb.append_labelled(p.filter("scene_id < 20").drop("scene_id"), p.filter("scene_id >= 20").drop("scene_id"), "label")


@query("u2_union_distinct", P + "SELECT gid FROM p WHERE label = 1 UNION SELECT gid FROM p WHERE conf > 0.5")
def u2(s, d):
    p = B.points(s, d)
    return p.filter("label = 1").select("gid").union(p.filter("conf > 0.5").select("gid")).distinct()


@query("u3_intersect", P + "SELECT gid FROM p WHERE label = 1 INTERSECT SELECT gid FROM p WHERE conf > 0.5")
def u3(s, d):
    p = B.points(s, d)
    return p.filter("label = 1").select("gid").intersect(p.filter("conf > 0.5").select("gid"))


@query("u4_except", P + "SELECT gid FROM p WHERE label = 1 EXCEPT SELECT gid FROM p WHERE conf > 0.5")
def u4(s, d):
    p = B.points(s, d)
    return p.filter("label = 1").select("gid").exceptAll(p.filter("conf > 0.5").select("gid")).distinct()


@query("u5_toggle", P + "SELECT gid FROM (SELECT gid FROM p WHERE label IN (1, 2) UNION ALL SELECT gid FROM p WHERE label IN (2, 3)) GROUP BY gid HAVING count(*) = 1")
def u5(s, d):
    p = B.points(s, d)
    return lb.toggle(p.filter("label in (1, 2)").select("gid"), p.filter("label in (2, 3)").select("gid"))


@query("u6_first_occurrence", "SELECT uid, min(image_name) AS image_name FROM cameras GROUP BY uid")
def u6(s, d):
    return lb.first_occurrence(load(s, d, "cameras").filter("image_name is not null").select("uid", "image_name"), ["uid"], ["image_name"]).union(
        load(s, d, "cameras").groupBy("uid").agg(F.min("image_name").alias("image_name")).filter("image_name is null")
    )


@query("u7_copy_selection", P + "SELECT gid, label FROM p UNION ALL SELECT gid, (SELECT max(label) FROM p) + 1 FROM p WHERE label = 4")
def u7(s, d):
    return lb.copy_selection(B.points(s, d).select("gid", "label"), F.col("label") == 4, "label")


@query("u8_delete_relabel", P + "SELECT gid, CASE WHEN label < 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY label < 0 ORDER BY label) - 1 END AS dense FROM p WHERE label <> 3")
def u8(s, d):
    return lb.dense_labels(B.points(s, d).filter("label <> 3").select("gid", "label"), "label").select("gid", "dense")


@query("u9_camera_list", C + ", q AS (SELECT uid, scene_id, CASE WHEN (row_number() OVER (PARTITION BY scene_id ORDER BY image_name, uid) - 1) % 8 = 0 THEN 0 ELSE 1 END AS train FROM c) SELECT uid, scene_id, row_number() OVER (PARTITION BY scene_id ORDER BY train, uid) - 1 AS id FROM q")
def u9(s, d):
    split = fl.holdout_split(B.cameras(s, d), ["scene_id"], ["image_name", "uid"], 8)
    return numbered(split, ["scene_id"], ["split", "uid"], "id").select("uid", "scene_id", (F.col("id") - 1).alias("id"))


# Labels


@query("l1_dense_relabel", P + "SELECT gid, dense_rank() OVER (ORDER BY label) - 1 AS dense FROM p")
def l1(s, d):
    return lb.dense_labels(B.points(s, d).select("gid", "label"), "label", keep_negative=False).select("gid", "dense")


@query("l2_dense_nonnegative", P + "SELECT gid, CASE WHEN label < 0 THEN -1 ELSE dense_rank() OVER (PARTITION BY label < 0 ORDER BY label) - 1 END AS dense FROM p WHERE label <> 2")
def l2(s, d):
    return lb.dense_labels(B.points(s, d).filter("label <> 2").select("gid", "label"), "label").select("gid", "dense")


@query("l3_confidence", P + "SELECT gid, CASE WHEN label >= 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM p")
def l3(s, d):
    return B.points(s, d).select("gid", F.when(F.col("label") >= 0, 1.0).otherwise(0.0).alias("confidence"))


@query("l4_offset", P + "SELECT gid, 100 + dense_rank() OVER (ORDER BY label) - 1 AS moved FROM p")
def l4(s, d):
    return lb.offset_labels(B.points(s, d).select("gid", "label"), "label", F.lit(100)).select("gid", F.col("moved").cast("bigint").alias("moved"))


@query("l5_import_block", P + "SELECT gid, CASE WHEN bool_or(opacity IS NULL) OVER (PARTITION BY scene_id) THEN 0 ELSE label END AS label FROM p")
def l5(s, d):
    p = B.points(s, d).select("gid", "scene_id", "label", "opacity")
    broken = p.groupBy("scene_id").agg(F.bool_or(F.col("opacity").isNull()).alias("broken"))
    return p.join(broken, "scene_id").select("gid", F.when(F.col("broken"), F.lit(0)).otherwise(F.col("label")).cast("bigint").alias("label"))


@query("l7_fingerprint", P + "SELECT scene_id, label, count(*) AS members, count(*)::VARCHAR || ':' || sha256(string_agg(gid::VARCHAR, ',' ORDER BY gid)) AS fingerprint FROM p GROUP BY scene_id, label")
def l7(s, d):
    return lb.fingerprints(B.points(s, d), ["scene_id", "label"], "gid")


@query("l9_grid_cell", P + ", q AS (SELECT gid, ceil((x - min(x) OVER ()) / 0.5) AS a, ceil((y - min(y) OVER ()) / 0.5) AS b, ceil((z - min(z) OVER ()) / 0.5) AS c FROM p) SELECT gid, dense_rank() OVER (ORDER BY a, b, c) - 1 AS cell FROM q")
def l9(s, d):
    return lb.grid_cell(B.points(s, d), ["x", "y", "z"], 0.5).select("gid", "cell")


@query("l10_parts", P + "SELECT scene_id, label AS cluster_id, min(gid) AS seed_index, string_agg(gid::VARCHAR, ',' ORDER BY gid) AS members FROM p WHERE label IN (0, 4) GROUP BY ALL")
def l10(s, d):
    return B.points(s, d).filter("label in (0, 4)").groupBy("scene_id", F.col("label").alias("cluster_id")).agg(
        F.min("gid").alias("seed_index"), F.array_join(F.array_sort(F.collect_list("gid")), ",").alias("members")
    )


@query("a5_histogram", P + ", c AS (SELECT label, count(*) AS n FROM p WHERE label >= 0 AND label <> 5 GROUP BY label) SELECT i AS label, coalesce(n, 0)::BIGINT AS n FROM range(0, (SELECT max(label) FROM c) + 1) t(i) LEFT JOIN c ON c.label = i")
def a5(s, d):
    return lb.histogram(B.points(s, d).filter("label <> 5"), "label")


# Selection states: pending and active parts, keyed by fingerprint

_PARTS = P + ", f AS (SELECT scene_id, label, count(*)::VARCHAR || ':' || sha256(string_agg(gid::VARCHAR, ',' ORDER BY gid)) AS fp FROM p GROUP BY scene_id, label), pend AS (SELECT fp FROM f WHERE label BETWEEN 0 AND 4), act AS (SELECT fp FROM f WHERE label BETWEEN 3 AND 6)"


def _parts(s, d):
    f = lb.fingerprints(B.points(s, d), ["scene_id", "label"], "gid").select("scene_id", "label", F.col("fingerprint").alias("fp"))
    return f.filter("label between 0 and 4").select("fp"), f.filter("label between 3 and 6").select("fp")


@query("z2_pending_to_active", _PARTS + ", one AS (SELECT min(fp) AS fp FROM pend) SELECT 'active' AS state, fp FROM (SELECT fp FROM act UNION SELECT fp FROM one) UNION ALL SELECT 'pending', fp FROM pend WHERE fp <> (SELECT fp FROM one)")
def z2(s, d):
    pend, act = _parts(s, d)
    one = pend.agg(F.min("fp").alias("fp"))
    active = act.union(one.join(act, "fp", "left_anti"))
    return active.select(F.lit("active").alias("state"), "fp").union(pend.join(one, "fp", "left_anti").select(F.lit("pending"), "fp"))


@query("z3_active_to_pending", _PARTS + ", one AS (SELECT max(fp) AS fp FROM act) SELECT 'active' AS state, fp FROM act WHERE fp <> (SELECT fp FROM one) UNION ALL SELECT 'pending', fp FROM (SELECT fp FROM pend UNION SELECT fp FROM one)")
def z3(s, d):
    pend, act = _parts(s, d)
    one = act.agg(F.max("fp").alias("fp"))
    pending = pend.union(one.join(pend, "fp", "left_anti"))
    return act.join(one, "fp", "left_anti").select(F.lit("active").alias("state"), "fp").union(pending.select(F.lit("pending"), "fp"))


@query("z4_bulk_add", _PARTS + "SELECT fp FROM act UNION SELECT fp FROM pend")
def z4(s, d):
    pend, act = _parts(s, d)
    return act.union(pend.join(act, "fp", "left_anti"))


@query("z5_bulk_remove", _PARTS + "SELECT fp FROM act WHERE fp NOT IN (SELECT fp FROM pend)")
def z5(s, d):
    pend, act = _parts(s, d)
    return act.join(pend, "fp", "left_anti")


@query("z6_visible_union", P + "SELECT DISTINCT gid FROM p WHERE label BETWEEN 3 AND 6 AND NOT coalesce(opacity < 0, false)")
def z6(s, d):
    p = B.points(s, d)
    members = p.filter("label between 3 and 6").groupBy("scene_id", "label").agg(F.collect_set("gid").alias("members")).select(F.explode("members").alias("gid")).distinct()
    return members.join(p.filter("opacity < 0").select("gid"), "gid", "left_anti")


@query("z7_visible_export", P + "SELECT label, count(*) FILTER (conf >= 0.3 AND NOT coalesce(opacity < 0, false)) AS visible, count(*) AS exported FROM p WHERE label >= 0 GROUP BY label")
def z7(s, d):
    seen = (F.col("conf") >= 0.3) & ~F.coalesce(F.col("opacity") < 0, F.lit(False))
    return B.points(s, d).filter("label >= 0").groupBy("label").agg(F.count(F.when(seen, 1)).alias("visible"), F.count("*").alias("exported"))


@query("z8_restore", P + "SELECT gid, CASE WHEN label = 2 THEN x + 1 WHEN label = 3 THEN x + 1 ELSE x END AS x, opacity FROM p")
def z8(s, d):
    """A snapshot of one label's positions; three labels are moved and all opacities of one emptied; the snapshot is restored."""
    before = B.points(s, d).select("gid", "label", "x", "opacity")
    version = lb.take_snapshot(before, "gid", ["x", "opacity"], F.col("label") == 1)
    edited = before.withColumn("x", F.when(F.col("label").between(1, 3), F.col("x") + 1).otherwise(F.col("x")))
    edited = edited.withColumn("opacity", F.when(F.col("label") == 1, F.lit(None)).otherwise(F.col("opacity")))
    return lb.restore_snapshot(edited, version, "gid").select("gid", "x", "opacity")


@query("z8_restore_rows", P + "SELECT gid, label FROM p")
def z8r(s, d):
    before = B.points(s, d).select("gid", "label")
    version = lb.take_snapshot(before, "gid", ["label"])
    edited = lb.copy_selection(before.filter("label <> 3"), F.col("label") == 1, "label")
    return lb.restore_rows(edited, version, "gid")


@query("z9_history", """WITH RECURSIVE e AS (SELECT user_id, event_id, CASE event_type WHEN 'error' THEN 'undo' WHEN 'signup' THEN 'redo' ELSE 'push' END AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 h(user_id, i, u, r) AS (SELECT DISTINCT user_id, 0::BIGINT, []::BIGINT[], []::BIGINT[] FROM events UNION ALL
 SELECT h.user_id, e.i, CASE WHEN k = 'push' THEN list_append(u, event_id)[-20:] WHEN k = 'undo' THEN u[:len(u) - 1] WHEN len(r) > 0 THEN list_append(u, r[-1])[-20:] ELSE u END,
 CASE WHEN k = 'push' THEN [] WHEN k = 'undo' AND len(u) > 0 THEN list_append(r, u[-1]) WHEN k = 'undo' THEN r ELSE r[:len(r) - 1] END FROM h JOIN e ON e.user_id = h.user_id AND e.i = h.i + 1)
 SELECT user_id, u AS undo, r AS redo FROM h QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1""")
def z9(s, d):
    kind = F.when(F.col("event_type") == "error", "undo").when(F.col("event_type") == "signup", "redo").otherwise("push")
    steps = load(s, d, "events").withColumn("kind", kind)
    return lb.replay_history(steps, "user_id", ["ts", "event_id"], "kind", "event_id").withColumnRenamed("session", "user_id")


@query("z9_last_entries", "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 20")
def z9l(s, d):
    return lb.push_history(load(s, d, "events").select(F.col("event_id").alias("seq"), "event_type")).withColumnRenamed("seq", "event_id")


@query("z10_staged_import", P + ", a AS (SELECT gid, label FROM p WHERE scene_id <= 30), b AS (SELECT gid, label FROM p WHERE scene_id > 30) SELECT 'commit' AS branch, gid, label FROM a UNION ALL SELECT 'commit', gid, (SELECT max(label) FROM a) + dense_rank() OVER (ORDER BY label) FROM b UNION ALL SELECT 'cancel', gid, label FROM a")
def z10(s, d):
    p = B.points(s, d).select("gid", "label", "scene_id")
    base, added = p.filter("scene_id <= 30").drop("scene_id"), p.filter("scene_id > 30").drop("scene_id")
    return lb.append_labelled(base, added, "label").select(F.lit("commit").alias("branch"), "gid", "label").union(base.select(F.lit("cancel"), "gid", "label"))
