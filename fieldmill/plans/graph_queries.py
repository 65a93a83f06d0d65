"""Queries of neighbour tables, affinity graphs and label refinement; every scene is a cloud of its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import graph as g
from fieldmill.operators import knn as kn
from fieldmill.operators import vectors as vc
from fieldmill.plans import base as B
from fieldmill.session import cut, load

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 16

_F = "q AS (SELECT DISTINCT gid, scene_id, f_dc::DOUBLE[] AS v FROM gaussians WHERE isfinite(x) AND isfinite(y) AND isfinite(z)), u AS (SELECT gid, scene_id, v, list_transform(v, lambda e: e / greatest(sqrt(list_dot_product(v, v)), 1e-6)) AS u FROM q)"
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
_KNN = f"""WITH RECURSIVE {B.POINTS}, {_F},
 kn AS (SELECT grp, src, dst, rank, sqrt(d2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM
  (SELECT a.scene_id AS grp, a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.gid <> b.gid)) WHERE rank <= {K}),
 lo AS (SELECT grp, src, median(dist) AS m FROM kn WHERE rank <= 4 GROUP BY ALL), bs AS (SELECT grp, greatest(median(m), 1e-3) AS b FROM lo WHERE m > 0 GROUP BY grp),
 ls AS (SELECT grp, src, CASE WHEN m > 0 THEN greatest(m, coalesce(b, 1e-3)) ELSE coalesce(b, 1e-3) END AS scale FROM lo LEFT JOIN bs USING (grp)),
 sp AS (SELECT kn.*, exp(-0.5 * pow(dist / (greatest(s.scale, t.scale, 1e-3) * 2.5), 2)) AS spatial FROM kn JOIN ls s ON s.src = kn.src JOIN ls t ON t.src = kn.dst),
 aw AS (SELECT sp.src, sp.dst, spatial * exp((greatest(-1, least(1, list_dot_product(a.u, b.u))) - 1) / 0.2) AS w FROM sp JOIN u a ON a.gid = sp.src JOIN u b ON b.gid = sp.dst),
 af AS (SELECT src, dst, max(w) AS w FROM (SELECT * FROM aw WHERE w > 1e-6 UNION ALL SELECT dst, src, w FROM aw WHERE w > 1e-6) GROUP BY ALL),
 ae AS (SELECT DISTINCT least(kn.src, dst) AS a, greatest(kn.src, dst) AS b FROM kn JOIN ls s ON s.src = kn.src JOIN ls t ON t.src = kn.dst WHERE dist <= 2.5 * greatest(s.scale, t.scale)),
 be AS (SELECT a, b FROM ae UNION SELECT b, a FROM ae),
 cc(node, root) AS (SELECT gid, gid FROM p UNION SELECT be.b, cc.root FROM cc JOIN be ON be.a = cc.node),
 co AS (SELECT node AS gid, min(root) AS component FROM cc GROUP BY node)
"""


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = _KNN + sql
        return f

    return add


def near(s, d, k=K):
    """The ``k`` nearest of each point: the first ranks of a wider table, so a query that reads only those asks for no more."""
    p = B.points(s, d)
    return kn.knn_join(p, p, k, "gid", ["x", "y", "z"], "scene_id")


def features(s, d):
    raw = load(s, d, "gaussians").filter(B.finite("x", "y", "z"))
    return raw.select("gid", "scene_id", F.col("f_dc").cast("array<double>").alias("v")).distinct()


@query("j4_knn", "SELECT src, dst, rank, round(dist, 6) AS dist FROM kn")
def j4(s, d):
    return near(s, d).select("src", "dst", "rank", F.round("dist", 6).alias("dist"))


_REF = ", rf AS (SELECT * FROM p WHERE label = 0)"


@query("j5_knn_reference", _REF + f", x AS (SELECT a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN rf b USING (scene_id)) SELECT src, dst FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 3")
def j5(s, d):
    p = B.points(s, d)
    return kn.knn_join(p, p.filter("label = 0"), 3, "gid", ["x", "y", "z"], "scene_id", exclude_self=False).select("src", "dst")


@query("j7_nearest_vertex", _REF + f", x AS (SELECT a.gid AS src, b.gid AS vid, {_D2} AS d2 FROM p a JOIN rf b USING (scene_id)) SELECT src, vid FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, vid) = 1")
def j7(s, d):
    p = B.points(s, d)
    return kn.knn_join(p, p.filter("label = 0"), 1, "gid", ["x", "y", "z"], "scene_id", exclude_self=False).select("src", F.col("dst").alias("vid"))


@query("g1_local_scale", "SELECT src, round(scale, 6) AS scale FROM ls")
def g1(s, d):
    return g.local_scale(near(s, d)).select("src", F.round("scale", 6).alias("scale"))


@query("g2_affinity", "SELECT src, dst, round(w, 6) AS w FROM af")
def g2(s, d):
    return g.affinity_edges(near(s, d), features(s, d), "gid", "v").select("src", "dst", F.round("w", 6).alias("w"))


@query("g3_colour_weight", "SELECT kn.src, kn.dst, round(exp(-1.5 * list_distance(a.v, b.v) * list_distance(a.v, b.v) / 0.125), 6) AS w FROM kn JOIN q a ON a.gid = kn.src JOIN q b ON b.gid = kn.dst")
def g3(s, d):
    f = features(s, d)
    pairs = g.meet(near(s, d).select("src", "dst"), f.select(F.col("gid").alias("src"), F.col("v").alias("a")), "src")
    pairs = g.meet(pairs, f.select(F.col("gid").alias("dst"), F.col("v").alias("b")), "dst")
    return pairs.select("src", "dst", F.round(g.colour_weight(F.col("a"), F.col("b"), 1.5, 0.25), 6).alias("w"))


_FACES = ", fc AS (SELECT a.src AS x, a.dst AS y, b.dst AS z FROM kn a JOIN kn b ON a.src = b.src AND a.rank = 1 AND b.rank = 2), ma AS (SELECT x AS u, y AS v FROM fc UNION SELECT y, x FROM fc UNION SELECT y, z FROM fc UNION SELECT z, y FROM fc UNION SELECT z, x FROM fc UNION SELECT x, z FROM fc UNION SELECT x, x FROM fc UNION SELECT y, y FROM fc UNION SELECT z, z FROM fc)"


def _faces(s, d):
    n = near(s, d)
    one, two = (n.filter(F.col("rank") == r).select("src", F.col("dst").alias(c)) for r, c in ((1, "y"), (2, "z")))
    return one.join(two, "src").withColumnRenamed("src", "x")


@query("g4_mesh_adjacency", _FACES + "SELECT u, v FROM ma")
def g4(s, d):
    return g.mesh_adjacency(_faces(s, d), ["x", "y", "z"])


@query("j12_mesh_boost", _FACES + "SELECT src, dst, CASE WHEN ma.u IS NULL THEN 1.0 ELSE 1.5 END::DOUBLE AS boost FROM kn LEFT JOIN ma ON ma.u = src AND ma.v = dst")
def j12(s, d):
    linked = g.mesh_adjacency(_faces(s, d), ["x", "y", "z"]).select(F.col("u").alias("src"), F.col("v").alias("dst"), F.lit(1.5).alias("m"))
    return near(s, d).join(linked, ["src", "dst"], "left").select("src", "dst", F.coalesce("m", F.lit(1.0)).alias("boost"))


@query("g5_connectivity", "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM kn")
def g5(s, d):
    return g.knn_edges(near(s, d))


def _parts(s, d):
    return g.components_of(B.points(s, d).select("gid", "scene_id"), "gid", g.adaptive_edges(near(s, d)))


@query("g6_components", "SELECT gid, component FROM co")
def g6(s, d):
    return _parts(s, d).select("gid", "component")


@query("g7_adaptive_edges", "SELECT a, b FROM ae")
def g7(s, d):
    return g.adaptive_edges(near(s, d))


@query("g8_seed_component", ", sd AS (SELECT scene_id, min(gid) AS gid FROM p GROUP BY 1) SELECT gid FROM co WHERE component IN (SELECT component FROM co JOIN sd USING (gid))")
def g8(s, d):
    parts = _parts(s, d)
    seeds = B.points(s, d).groupBy("scene_id").agg(F.min("gid").alias("gid"))
    return parts.join(parts.join(seeds.select("gid"), "gid").select("component").distinct(), "component", "left_semi").select("gid")


_RES = ", sz AS (SELECT scene_id, component, count(*) AS n FROM co JOIN p USING (gid) GROUP BY ALL), vs AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY n DESC, component) = 1 OR n > 20 AS visible FROM sz)"


@query("g9_residue", _RES + "SELECT gid, visible FROM co JOIN p USING (gid) JOIN vs USING (scene_id, component)")
def g9(s, d):
    return g.split_residue(_parts(s, d), "scene_id", 20).select("gid", "visible")


@query("g10_cut_score", ", t AS (SELECT scene_id AS grp, sum(w) FILTER (a.x > 10 AND NOT b.x > 10) AS c, sum(w) FILTER (a.x > 10) AS l, sum(w) FILTER (NOT a.x > 10) AS r FROM (SELECT af.*, a.scene_id FROM af JOIN p a ON a.gid = af.src) e JOIN p a ON a.gid = e.src JOIN p b ON b.gid = e.dst GROUP BY 1) SELECT grp, round(CASE WHEN coalesce(l, 0) > 1e-8 AND coalesce(r, 0) > 1e-8 THEN coalesce(c, 0) / l + coalesce(c, 0) / r END, 6) AS score FROM t".replace("SELECT scene_id AS grp", "SELECT e.scene_id AS grp"))
def g10(s, d):
    sides = B.points(s, d).select(F.col("scene_id").alias("grp"), "gid", (F.col("x") > 10).alias("side"))
    edges = g.affinity_edges(near(s, d), features(s, d), "gid", "v")
    return g.cut_score(edges, sides, "gid", "side").select("grp", F.round("score", 6).alias("score"))


@query("g14_propagate", _REF + f""", x AS (SELECT a.scene_id AS grp, a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN p b ON a.scene_id = b.scene_id AND b.conf > 0.5 AND b.label >= 0),
 n AS (SELECT *, sqrt(d2) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM x) WHERE rank <= 6), l2 AS (SELECT grp, src, median(dist) AS m FROM n WHERE rank <= 4 GROUP BY ALL),
 b2 AS (SELECT grp, greatest(median(m), 1e-3) AS b FROM l2 WHERE m > 0 GROUP BY grp), s2 AS (SELECT src, CASE WHEN m > 0 THEN greatest(m, coalesce(b, 1e-3)) ELSE coalesce(b, 1e-3) END AS scale FROM l2 LEFT JOIN b2 USING (grp)),
 vt AS (SELECT n.src, r.label, sum(exp(-0.5 * pow(dist / greatest(scale * 2.5, 1e-3), 2)) * exp((greatest(-1, least(1, list_dot_product(a.u, b.u))) - 1) / 0.2)) AS s FROM n JOIN s2 ON s2.src = n.src JOIN u a ON a.gid = n.src JOIN u b ON b.gid = n.dst JOIN p r ON r.gid = n.dst GROUP BY ALL)
 SELECT src, label, round(s / greatest(sum(s) OVER (PARTITION BY src), 1e-6), 6) AS share FROM vt QUALIFY row_number() OVER (PARTITION BY src ORDER BY round(s, 9) DESC, label) = 1""")
def g14(s, d):
    p = B.points(s, d)
    refs = p.filter("conf > 0.5 and label >= 0")
    n = kn.knn_join(p, refs, 6, "gid", ["x", "y", "z"], "scene_id", exclude_self=False)
    f = features(s, d)
    return g.propagate(n, f, refs.join(f.select("gid", "v"), "gid"), "gid", "v", "label").select("src", "label", F.round("share", 6).alias("share"))


@query("g16_refine", """, lb AS (SELECT p.gid, p.scene_id AS grp, p.label, p.conf, u.u FROM p JOIN u USING (gid)),
 ie AS (SELECT DISTINCT src AS a, dst AS b FROM (SELECT src, dst FROM kn UNION ALL SELECT dst, src FROM kn) e JOIN lb x ON x.gid = src JOIN lb y ON y.gid = dst WHERE x.label = y.label AND x.label >= 0),
 c2(node, root) AS (SELECT gid, gid FROM p UNION SELECT ie.b, c2.root FROM c2 JOIN ie ON ie.a = c2.node), cp AS (SELECT node AS gid, min(root) AS component FROM c2 GROUP BY node),
 rw AS (SELECT lb.*, component FROM lb JOIN cp USING (gid)), sz AS (SELECT grp, label, component, count(*) AS n, avg(conf) AS c FROM rw WHERE label >= 0 GROUP BY ALL),
 kd AS (SELECT *, row_number() OVER (PARTITION BY grp, label ORDER BY n DESC, component) = 1 AS core FROM sz), ki AS (SELECT *, NOT core AND (n < 12 OR c < 0.6) AS residue FROM kd),
 rr AS (SELECT rw.*, coalesce(core, false) AS core, coalesce(residue, false) AS residue FROM rw LEFT JOIN ki USING (grp, label, component)),
 ct AS (SELECT r.component, t.label AS target, count(*) AS t, avg(spatial) AS sp FROM sp JOIN rr r ON r.gid = sp.src AND r.residue JOIN rr t ON t.gid = sp.dst AND t.core GROUP BY ALL),
 d1 AS (SELECT grp, label, generate_subscripts(u, 1) AS i, unnest(u) AS e FROM rr WHERE core), m1 AS (SELECT grp, label, i, avg(e) AS e FROM d1 GROUP BY ALL), n1 AS (SELECT grp, label AS target, list(e ORDER BY i) AS c FROM m1 GROUP BY ALL),
 d3 AS (SELECT grp, component, generate_subscripts(u, 1) AS i, unnest(u) AS e FROM rr WHERE residue), m3 AS (SELECT grp, component, i, avg(e) AS e FROM d3 GROUP BY ALL), n3 AS (SELECT grp, component, list(e ORDER BY i) AS c FROM m3 GROUP BY ALL),
 sc AS (SELECT ct.component, ct.target, round(0.45 * t / sum(t) OVER (PARTITION BY ct.component) + 0.35 * greatest(0, least(1, (list_dot_product(n3.c, n1.c) / greatest(sqrt(list_dot_product(n3.c, n3.c)), 1e-6) / greatest(sqrt(list_dot_product(n1.c, n1.c)), 1e-6) + 1) * 0.5)) + 0.2 * sp, 9) AS score FROM ct JOIN n3 USING (component) JOIN n1 ON n1.grp = n3.grp AND n1.target = ct.target),
 bt AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM sc WINDOW w AS (PARTITION BY component ORDER BY score DESC, target)), bb AS (SELECT * FROM bt WHERE k = 1 AND score >= 0.15 AND score - second >= 0.05)
 SELECT gid, CASE WHEN residue THEN coalesce(target, -1) ELSE label END AS label, round(CASE WHEN residue THEN coalesce(score, 0) ELSE conf END, 6) AS conf FROM rr LEFT JOIN bb USING (component)""")
def g16(s, d):
    p = g.meet(B.points(s, d), features(s, d).select("gid", "v"), "gid").withColumnRenamed("scene_id", "grp")
    return g.refine_labels(p, near(s, d), "gid", "v", min_size=12).select("gid", "label", F.round("conf", 6).alias("conf"))


@query("e5_neighbour_tables", "SELECT 3 AS k, src, dst FROM kn WHERE rank <= 3 UNION ALL SELECT 12, src, dst FROM kn WHERE rank <= 12 UNION ALL SELECT 5, src, dst FROM kn WHERE rank <= 5")
def e5(s, d):
    """The connectivity, scale and smoothing neighbours of the same points: one join for the widest of those asked for."""
    known = kn.NeighbourTables(B.points(s, d), "gid", ["x", "y", "z"], "scene_id")
    known.of(12)
    parts = [known.of(k).select(F.lit(k).alias("k"), "src", "dst") for k in (3, 12, 5)]
    return parts[0].union(parts[1]).union(parts[2])


@query("e1_mean_square", "SELECT src, round(avg(dist * dist), 6) AS d2 FROM kn WHERE rank <= 3 GROUP BY src")
def e1(s, d):
    return kn.mean_square_distance(near(s, d, 3)).select("src", F.round("d2", 6).alias("d2"))


_SM = ", e AS (SELECT src, dst FROM kn WHERE rank <= 4 UNION ALL SELECT gid, gid FROM p), x AS (SELECT e.src, generate_subscripts(u, 1) AS i, unnest(u) AS v FROM e JOIN u ON u.gid = e.dst), sm AS (SELECT src, i, avg(v) AS v FROM x GROUP BY ALL)"


@query("e2_smooth", _SM + "SELECT src, i - 1 AS i, round(v, 6) AS v FROM sm")
def e2(s, d):
    out = g.smooth(near(s, d, 4), features(s, d), "gid", "v", 4)
    return out.select("src", F.posexplode("smoothed").alias("i", "v")).select("src", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("e3_smooth_part", _SM + ", o AS (SELECT gid AS src, generate_subscripts(u, 1) AS i, unnest(u) AS v FROM u) SELECT src, i - 1 AS i, round(CASE WHEN i <= 2 THEN sm.v ELSE o.v END, 6) AS v FROM sm JOIN o USING (src, i)")
def e3(s, d):
    out = g.smooth_part(near(s, d, 4), features(s, d), "gid", "v", 4, 2)
    return out.select("src", F.posexplode("smoothed").alias("i", "v")).select("src", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("a30_laplacian", """, s2 AS (SELECT src, greatest(avg(dist * dist), 1e-6) AS s FROM kn WHERE rank <= 4 GROUP BY 1),
 w AS (SELECT grp, kn.src, exp(-dist * dist / greatest(2 * s, 1e-6)) * greatest((list_dot_product(a.u, b.u) + 1) * 0.5, 0) AS w, list_distance(a.u, b.u) * list_distance(a.u, b.u) AS d2 FROM kn JOIN s2 USING (src) JOIN u a ON a.gid = kn.src JOIN u b ON b.gid = kn.dst),
 e AS (SELECT grp, src, sum(w * d2) / greatest(sum(w), 1e-6) AS e FROM w GROUP BY ALL) SELECT grp, round(avg(e), 6) AS energy FROM e GROUP BY grp""")
def a30(s, d):
    return g.laplacian_energy(near(s, d), features(s, d), "gid", "v").select("grp", F.round("energy", 6).alias("energy"))


@query("a4_connectivity", f""", x AS (SELECT a.scene_id, a.label, a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN p b ON a.scene_id = b.scene_id AND a.label = b.label AND a.gid <> b.gid AND a.label >= 0),
 n AS (SELECT src, dst FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 3), b3 AS (SELECT src AS a, dst AS b FROM n UNION SELECT dst, src FROM n),
 c3(node, root) AS (SELECT gid, gid FROM p WHERE label >= 0 UNION SELECT b3.b, c3.root FROM c3 JOIN b3 ON b3.a = c3.node), k3 AS (SELECT node AS gid, min(root) AS c FROM c3 GROUP BY 1),
 z AS (SELECT scene_id, label, c, count(*) AS n FROM k3 JOIN p USING (gid) GROUP BY ALL), r AS (SELECT scene_id, label, sum(n) AS size, max(n) / sum(n) AS ratio FROM z GROUP BY ALL)
 SELECT scene_id, round(avg(ratio), 6) AS mean, round(sum(ratio * size) / greatest(sum(size), 1), 6) AS weighted FROM r GROUP BY scene_id""")
def a4c(s, d):
    p = B.points(s, d).filter("label >= 0").withColumn("part", F.col("scene_id") * 100 + F.col("label"))
    parts = g.components_of(p, "gid", g.knn_edges(kn.knn_join(p, p, 3, "gid", ["x", "y", "z"], "part")))
    sizes = parts.groupBy("scene_id", "label", "component").agg(F.count("*").alias("n"))
    r = sizes.groupBy("scene_id", "label").agg(F.sum("n").alias("size"), (F.max("n") / F.sum("n")).alias("ratio"))
    weighted = F.sum(F.col("ratio") * F.col("size")) / F.greatest(F.sum("size"), F.lit(1))
    return r.groupBy("scene_id").agg(F.round(F.avg("ratio"), 6).alias("mean"), F.round(weighted, 6).alias("weighted"))


@query("w21_morton", ", n AS (SELECT gid, [" + ", ".join(f"least(greatest(floor(({a} - min({a}) OVER (PARTITION BY scene_id)) / greatest(max({a}) OVER (PARTITION BY scene_id) - min({a}) OVER (PARTITION BY scene_id), 1e-9) * 1024), 0), 1023)::BIGINT" for a in "xyz") + "] AS c FROM p) SELECT gid, (" + " + ".join(f"(((c[{i + 1}] >> {b}) & 1) << {b * 3 + i})" for i in range(3) for b in range(10)) + ")::BIGINT AS code FROM n")
def w21(s, d):
    p = B.points(s, d)
    span = p.groupBy("scene_id").agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for f, n in ((F.min, "low"), (F.max, "high"))))
    axes = [(F.col(c) - F.col(f"low{c}")) / F.greatest(F.col(f"high{c}") - F.col(f"low{c}"), F.lit(1e-9)) for c in "xyz"]
    return p.join(span, "scene_id").select("gid", kn.morton(axes).alias("code"))


# Vectors

_V = B.VECTORS + ", cm AS (SELECT label, i, avg(x) AS m FROM (SELECT label, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM v) GROUP BY ALL), c0 AS (SELECT label, list(m ORDER BY i) AS c FROM cm GROUP BY 1), ce AS (SELECT label, list_transform(c, lambda x: x / greatest(sqrt(list_dot_product(c, c)), 1e-6)) AS c FROM c0)"


def vquery(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, f"WITH {_V} " + sql
        return f

    return add


@vquery("a6_group_means", "SELECT label, generate_subscripts(c, 1) - 1 AS i, round(unnest(c), 6) AS v FROM ce")
def a6(s, d):
    c = vc.group_means(B.vectors(s, d), ["label"], "e")
    return c.select("label", F.posexplode("centre").alias("i", "v")).select("label", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@vquery("j8_nearest_centre", "SELECT gid, ce.label AS label, round(list_dot_product(e, c), 6) AS score FROM v, ce QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(list_dot_product(e, c), 9) DESC, ce.label) = 1")
def j8(s, d):
    v = B.vectors(s, d)
    return vc.nearest_centre(v, "gid", "e", vc.group_means(v, ["label"], "e"), "label", "centre").select("gid", "label", F.round("score", 6).alias("score"))


@vquery("j20_prompt_scores", "SELECT gid, ce.label AS label, round(list_dot_product(e, c), 6) AS score FROM v, ce WHERE ce.label < 3")
def j20(s, d):
    v = B.vectors(s, d)
    labels, matrix = vc.collect_centres(vc.group_means(v, ["label"], "e").filter("label < 3"), "label", "centre")
    return vc.score_centres(v, "gid", "e", labels, matrix, most=3).select("gid", "label", F.round("score", 6).alias("score"))


@vquery("g18_lloyd_step", ", a1 AS (SELECT gid, e, ce.label AS k FROM v, ce QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(list_dot_product(e, c), 9) DESC, ce.label) = 1) SELECT k AS label, count(*) AS n, round(avg(e[1]), 6) AS first FROM a1 GROUP BY k")
def g18(s, d):
    v = B.vectors(s, d)
    near = vc.nearest_centre(v, "gid", "e", vc.group_means(v, ["label"], "e"), "label", "centre").select("gid", F.col("label").alias("k"))
    return v.join(near, "gid").groupBy(F.col("k").alias("label")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("e")[0]), 6).alias("first"))


@vquery("l6_merge_small", ", n AS (SELECT label, count(*) AS n FROM v GROUP BY 1), t AS (SELECT a.label, b.label AS target FROM n a JOIN ce x USING (label), n b JOIN ce y USING (label) WHERE a.n < 50 AND b.n >= 50 QUALIFY row_number() OVER (PARTITION BY a.label ORDER BY round(list_dot_product(x.c, y.c), 9) DESC, b.label) = 1), m AS (SELECT gid, CASE WHEN (SELECT count(*) FROM n WHERE n >= 50) = 0 THEN 0 ELSE coalesce(target, v.label) END AS l FROM v LEFT JOIN t ON t.label = v.label) SELECT gid, dense_rank() OVER (ORDER BY l) - 1 AS label FROM m")
def l6(s, d):
    from fieldmill.operators.cluster import merge_small

    return merge_small(B.vectors(s, d), "gid", "e", "label", 50)


@vquery("x6_gated_similarity", ", z AS (SELECT gid, list_transform(e, lambda x, i: CASE WHEN i <= 32 THEN x ELSE 0 END) AS g FROM v), y AS (SELECT gid, list_transform(g, lambda x: x / greatest(sqrt(list_dot_product(g, g)), 1e-6)) AS g FROM z) SELECT gid, list_bool_or([round((list_dot_product(g, c) + 1) / 2, 9) >= 0.6 FOR c IN (SELECT list(c ORDER BY label) FROM ce WHERE label < 2)]) AS hit FROM y")
def x6(s, d):
    v = B.vectors(s, d)
    prompts = vc.collect_centres(vc.group_means(v, ["label"], "e").filter("label < 2"), "label", "centre")[1]
    gated = vc.normalise(F.transform("e", lambda x, i: F.when(i < 32, x).otherwise(0.0)))
    tests = [F.round((vc.dot("g", F.array(*map(F.lit, q.tolist()))) + 1) / 2, 9) >= 0.6 for q in prompts]
    return v.withColumn("g", gated).select("gid", (tests[0] | tests[1]).alias("hit"))


@vquery("x8_relevancy", ", s AS (SELECT gid, max(list_dot_product(e, c)) FILTER (ce.label = 0) AS pos, list(list_dot_product(e, c)) FILTER (ce.label IN (1, 2, 3)) AS neg FROM v, ce GROUP BY gid) SELECT gid, round(list_min(list_transform(neg, lambda n: 1 / (1 + exp(10 * (n - pos))))), 6) AS relevancy FROM s")
def x8(s, d):
    v = B.vectors(s, d)
    c = vc.collect_centres(vc.group_means(v, ["label"], "e").filter("label < 4"), "label", "centre")[1]
    pos, *neg = (vc.dot("e", F.array(*map(F.lit, q.tolist()))) for q in c)
    return v.select("gid", F.round(F.array_min(F.array(*(1 / (1 + F.exp(10 * (n - pos))) for n in neg))), 6).alias("relevancy"))


@vquery("x7_prompt_rule", ", s AS (SELECT gid, max(list_dot_product(e, c)) FILTER (ce.label < 2) AS pos, max(list_dot_product(e, c)) FILTER (ce.label IN (2, 3)) AS neg FROM v, ce GROUP BY gid) SELECT gid, round(CASE WHEN round(pos, 9) < round(neg, 9) OR round(pos, 9) < 0.1 THEN 0 ELSE pos END, 6) AS score FROM s")
def x7(s, d):
    v = B.vectors(s, d)
    c = vc.collect_centres(vc.group_means(v, ["label"], "e").filter("label < 4"), "label", "centre")[1]
    a, b, x, y = (vc.dot("e", F.array(*map(F.lit, q.tolist()))) for q in c)
    pos, neg = F.greatest(a, b), F.greatest(x, y)
    score = F.when((F.round(pos, 9) < F.round(neg, 9)) | (F.round(pos, 9) < 0.1), 0.0).otherwise(pos)
    return v.select("gid", F.round(score, 6).alias("score"))


@vquery("x1_normalise", "SELECT gid, round(list_dot_product(e, e) / greatest(sqrt(list_dot_product(e, e)), 1e-6), 6) AS length FROM v")
def x1(s, d):
    return B.vectors(s, d).select("gid", F.round(vc.dot("e", vc.normalise("e")), 6).alias("length"))


@vquery("x5_scale_gate", "SELECT gid, round(list_sum(list_transform(e, lambda x, i: x * CASE WHEN i <= floor((1 - (gid % 10) / 10.0) * 64) THEN 1 ELSE 0 END)), 6) AS total FROM v")
def x5(s, d):
    most = F.floor((1 - F.col("gid") % 10 / 10) * 64)
    gated = F.transform("e", lambda x, i: F.when(i < most, x).otherwise(0.0))
    return B.vectors(s, d).select("gid", F.round(F.aggregate(gated, F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("j6_knn_sample", f", rf AS (SELECT * FROM p WHERE conf > 0.5), x AS (SELECT a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN rf b USING (scene_id)) SELECT src, dst FROM x QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= 4")
def j6(s, d):
    p = B.points(s, d)
    return kn.knn_join(p, p.filter("conf > 0.5"), 4, "gid", ["x", "y", "z"], "scene_id", exclude_self=False).select("src", "dst")


_CONTACT = ", rs AS (SELECT gid AS src, label AS component FROM p WHERE conf < 0.4), k AS (SELECT gid AS dst, label AS target FROM p WHERE conf >= 0.4), t AS (SELECT component, target, count(*) AS t, avg(spatial) AS sp FROM sp JOIN rs USING (src) JOIN k USING (dst) GROUP BY ALL)"


def _contacts(s, d):
    p = B.points(s, d)
    low = p.filter("conf < 0.4").select(F.col("gid").alias("src"), F.col("label").alias("component"))
    return g.contact_scores(g.spatial_terms(near(s, d)), low, p.filter("conf >= 0.4").select(F.col("gid").alias("src"), "label"))


@query("j11_contacts", _CONTACT + "SELECT component, target, t FROM t")
def j11(s, d):
    return _contacts(s, d).select("component", "target", "t")


@query("a15_contact_ratio", _CONTACT + "SELECT component, target, round(t / sum(t) OVER (PARTITION BY component), 6) AS contact, round(sp, 6) AS spatial FROM t")
def a15(s, d):
    return _contacts(s, d).select("component", "target", F.round("contact", 6).alias("contact"), F.round("sp", 6).alias("spatial"))


@query("x4_falloff", "SELECT src, dst, round(spatial, 6) AS w FROM sp")
def x4(s, d):
    return g.spatial_terms(near(s, d)).select("src", "dst", F.round("spatial", 6).alias("w"))


@query("x3_feature_affinity", "SELECT src, dst, round(exp((greatest(-1, least(1, list_dot_product(a.u, b.u))) - 1) / 0.2), 6) AS w, round(greatest(-1, least(1, list_dot_product(a.u, b.u))), 6) AS cosine FROM kn JOIN u a ON a.gid = src JOIN u b ON b.gid = dst")
def x3(s, d):
    f = features(s, d).select("gid", vc.normalise("v").alias("u"))
    pairs = near(s, d).join(f.select(F.col("gid").alias("src"), F.col("u").alias("a")), "src").join(f.select(F.col("gid").alias("dst"), F.col("u").alias("b")), "dst")
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vc.dot("a", "b")))
    return pairs.select("src", "dst", F.round(F.exp((cosine - 1) / 0.2), 6).alias("w"), F.round(cosine, 6).alias("cosine"))


_SHARES = [(0.1, 4, 0.5), (0.5, 4, 0.3), (1.5, 16, 0.2)]


@query("e4_multi_resolution", ", " + ", ".join(
    f"n{t} AS (SELECT src, dst FROM (SELECT a.gid AS src, b.gid AS dst, {_D2} AS d2 FROM p a JOIN p b ON a.scene_id = b.scene_id AND ('0x' || substr(md5('e' || b.gid::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < {share}) QUALIFY row_number() OVER (PARTITION BY src ORDER BY d2, dst) <= {k}), "
    f"x{t} AS (SELECT src, i, {w} * avg(v) AS v FROM (SELECT src, generate_subscripts(u, 1) AS i, unnest(u) AS v FROM n{t} JOIN u ON u.gid = dst) GROUP BY ALL)" for t, (share, k, w) in enumerate(_SHARES)
) + " SELECT src, i - 1 AS i, round(x0.v + x1.v + x2.v, 6) AS v FROM x0 JOIN x1 USING (src, i) JOIN x2 USING (src, i)")
def e4(s, d):
    """Subsets of a tenth, of half and (one and a half) of all points, with 4, 4 and 16 neighbours."""
    out = g.subset_smoothing(B.points(s, d), features(s, d), "gid", "scene_id", ["x", "y", "z"], "v", _SHARES)
    return out.select("src", F.posexplode("smoothed").alias("i", "v")).select("src", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("e4_weighted_smoothing", ", x AS (SELECT k, src, i, avg(v) AS v FROM (SELECT k, e.src, generate_subscripts(u, 1) AS i, unnest(u) AS v FROM (SELECT 2 AS k, src, dst FROM kn WHERE rank <= 2 UNION ALL SELECT 2, gid, gid FROM p UNION ALL SELECT 6, src, dst FROM kn WHERE rank <= 6 UNION ALL SELECT 6, gid, gid FROM p) e JOIN u ON u.gid = e.dst) GROUP BY ALL) SELECT src, i - 1 AS i, round(sum(v * CASE k WHEN 2 THEN 0.7 ELSE 0.3 END), 6) AS v FROM x GROUP BY ALL")
def e4w(s, d):
    n, f = cut(near(s, d, 6), "near"), features(s, d)
    out = g.multi_resolution([(g.smooth(n, f, "gid", "v", 2), 0.7), (g.smooth(n, f, "gid", "v", 6), 0.3)])
    return out.select("src", F.posexplode("smoothed").alias("i", "v")).select("src", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@query("f24_initial_splats", ", e AS (SELECT src, avg(dist * dist) AS d2 FROM kn WHERE rank <= 3 GROUP BY 1) SELECT gid, round(ln(sqrt(greatest(coalesce(d2, 1e-7), 1e-7))), 6) AS scale, round((gid % 256 / 255.0 - 0.5) / 0.28209479177387814, 6) AS red FROM p LEFT JOIN e ON e.src = gid")
def f24(s, d):
    p = B.points(s, d).withColumn("red", F.col("gid") % 256)
    out = g.initial_splats(p, near(s, d, 3), "gid", ["red", "red", "red"])
    return out.select("gid", F.round(F.col("scale")[0], 6).alias("scale"), F.round(F.col("f_dc")[0], 6).alias("red"))


@query("z13_seed_part", ", sd AS (SELECT scene_id, min(gid) AS seed FROM p GROUP BY 1), pt AS (SELECT seed, list(gid ORDER BY gid) AS m FROM co JOIN p USING (gid) JOIN sd USING (scene_id) WHERE component = (SELECT component FROM co c2 WHERE c2.gid = seed) GROUP BY seed) SELECT seed, len(m) AS members, len(m)::VARCHAR || ':' || sha256(array_to_string(m, ',')) AS fingerprint FROM pt")
def z13(s, d):
    from fieldmill.operators.labels import fingerprints

    parts = cut(_parts(s, d), "parts")  # read twice
    first = F.min(F.struct("gid", "component")).alias("first")
    chosen = parts.groupBy("scene_id").agg(first).select("scene_id", "first.component", F.col("first.gid").alias("seed"))
    return fingerprints(g.meet(parts, chosen, ["scene_id", "component"]), ["seed"], "gid")


@query("z1_active_group")
def z1(s, d):
    """Filter parts, unite them, clip them to their box, split off residue, and take a preview over the labels."""
    from fieldmill.operators import aggregates as ag
    from fieldmill.operators import filters as fl

    p = B.points(s, d).filter("label between 1 and 4")
    chosen = fl.part_filter(p, F.col("conf"), 0.2, F.coalesce(F.col("opacity") < 0, F.lit(False))).dropDuplicates(["gid"])
    mean, axes = vc.principal_axes(chosen.withColumn("v", F.array("x", "y", "z")), "v", 3, 3)
    offset = [F.col(c) - float(m) for c, m in zip("xyz", mean)]
    local = [F.abs(sum(o * float(a) for o, a in zip(offset, axis))) for axis in axes]
    extent = chosen.agg(*(F.percentile(v, F.lit(0.98)) for v in local)).first()
    clipped = fl.keep_or_all(chosen, fl.inside_box(offset, axes.tolist(), [float(e or 0) for e in extent]))
    clipped = cut(clipped, "clipped")
    edges = g.meet(g.meet(g.adaptive_edges(near(s, d)), clipped.select(F.col("gid").alias("a")), "a"), clipped.select(F.col("gid").alias("b")), "b")
    shown = g.split_residue(g.components_of(clipped, "gid", edges.select("a", "b")), "scene_id", 3).filter("visible")
    return ag.stratified_sample(shown.select("gid", "label"), "label", "gid", 500)


# Masks as sets, codes and prompts


@vquery("x2_cosine", "SELECT gid, round(greatest(-1, least(1, list_dot_product(e, c))), 6) AS cosine FROM v JOIN ce USING (label)")
def x2(s, d):
    v = B.vectors(s, d)
    both = v.join(vc.group_means(v, ["label"], "e"), "label")
    return both.select("gid", F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), vc.dot("e", "centre"))), 6).alias("cosine"))


@vquery("x9_templates", ", t AS (SELECT 'a photo of ' || n_name AS text FROM nation UNION ALL SELECT 'the ' || n_name || ' part' FROM nation) SELECT text FROM t")
def x9(s, d):
    templates = F.array(F.lit("a photo of {}"), F.lit("the {} part"))
    return load(s, d, "nation").select(F.explode(F.transform(templates, lambda t: F.replace(t, F.lit("{}"), F.col("n_name")))).alias("text"))


@vquery("x9_prompt_vectors", ", t AS (SELECT n_nationkey AS prompt, n_nationkey * 2 + k AS gid, k FROM nation, range(2) r(k)), u AS (SELECT prompt, list_transform(e, lambda x: x * (k + 1)) AS e FROM t JOIN v USING (gid)), n AS (SELECT prompt, list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-6)) AS e FROM u), m AS (SELECT prompt, i, avg(x) AS m FROM (SELECT prompt, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM n) GROUP BY ALL), c AS (SELECT prompt, list(m ORDER BY i) AS c FROM m GROUP BY 1) SELECT prompt, round(c[1] / greatest(sqrt(list_dot_product(c, c)), 1e-6), 6) AS first, round(c[64] / greatest(sqrt(list_dot_product(c, c)), 1e-6), 6) AS last FROM c")
def x9v(s, d):
    """The vector of each prompt: its templates' vectors (of any length) made unit, averaged and made unit again."""
    t = load(s, d, "nation").select(F.col("n_nationkey").alias("prompt"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).withColumn("gid", (F.col("prompt") * 2 + F.col("k")).cast("bigint"))
    vectors = t.join(B.vectors(s, d), "gid").withColumn("e", F.transform("e", lambda x: x * (F.col("k") + 1))).withColumn("u", vc.normalise("e"))
    return vc.group_means(vectors, ["prompt"], "u").select("prompt", F.round(F.col("centre")[0], 6).alias("first"), F.round(F.col("centre")[63], 6).alias("last"))


@vquery("l8_codes", "SELECT gid, CASE WHEN gid % 50 = 0 THEN -1 ELSE label END AS decoded FROM v")
def l8(s, d):
    """Codes mixed with the next label's, some of them emptied."""
    v = B.vectors(s, d).select("gid", "label")
    labels = v.select("label").distinct()
    codes = g.label_codes(labels, "label")
    other = codes.select(F.col("label").alias("next"), F.col("code").alias("more"))
    mixed = v.withColumn("next", (F.col("label") + 1) % 10).join(codes, "label").join(other, "next", "left")
    value = F.transform(F.zip_with("code", F.coalesce("more", "code"), lambda a, b: a * 0.8 + b * 0.3), lambda x: F.when(F.col("gid") % 50 == 0, 0.0).otherwise(x))
    return g.decode_labels(mixed.select("gid", value.alias("e")), "gid", "e", labels, "label").withColumnRenamed("label", "decoded")


@vquery("x28_palette", "SELECT gid, label * 25 AS red FROM v")
def x28(s, d):
    v = B.vectors(s, d)
    colours = v.select("label").distinct().withColumn("red", F.col("label") * 25)
    return v.join(colours, "label", "left").select("gid", F.coalesce("red", F.lit(0)).alias("red"))


def _lloyd_sql(steps: int) -> str:
    """``ce`` after so many rounds, as ``k<steps>`` (label, c)."""
    out, now = "", "ce"
    for t in range(steps):
        out += f", w{t} AS MATERIALIZED (SELECT gid, e, z.label AS k FROM v, {now} z QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(list_dot_product(e, c), 9) DESC, z.label) = 1)"
        out += f", m{t} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM (SELECT k, generate_subscripts(e, 1) AS i, unnest(e) AS x FROM w{t}) GROUP BY ALL) GROUP BY k)"
        out += f", k{t + 1} AS MATERIALIZED (SELECT z.label, coalesce(list_transform(m.c, lambda x: x / greatest(sqrt(list_dot_product(m.c, m.c)), 1e-6)), z.c) AS c FROM {now} z LEFT JOIN m{t} m ON m.k = z.label)"
        now = f"k{t + 1}"
    return out


_LLOYD = _lloyd_sql(12)


def _means(s, d):
    v = B.vectors(s, d)
    return vc.lloyd(v, "gid", "e", vc.group_means(v, ["label"], "e"), 12)


@vquery("g18_kmeans", _LLOYD + " SELECT label, generate_subscripts(c, 1) - 1 AS i, round(unnest(c), 6) AS v FROM k12")
def g18k(s, d):
    return _means(s, d).select("label", F.posexplode("centre").alias("i", "v")).select("label", F.col("i").cast("bigint").alias("i"), F.round("v", 6).alias("v"))


@vquery("g19_cluster_map", _LLOYD + " SELECT gid, k12.label * 25 AS colour FROM v, k12 QUALIFY row_number() OVER (PARTITION BY gid ORDER BY round(list_dot_product(e, c), 9) DESC, k12.label) = 1")
def g19(s, d):
    return vc.nearest_centre(B.vectors(s, d), "gid", "e", _means(s, d), "label", "centre").select("gid", (F.col("label") * 25).alias("colour"))


@query("g11_split", "SELECT DISTINCT scene_id AS grp, true AS agrees FROM p")
def g11(s, d):
    """The best split of each scene's affinity graph: its score is that of the cut aggregated over the edges, its sides are large enough."""
    import numpy as np
    import pyarrow as pa

    from fieldmill.operators import cluster as cl

    p = B.points(s, d).select("gid", F.col("scene_id").alias("grp"))
    edges = cut(g.affinity_edges(near(s, d), features(s, d), "gid", "v"), "edges")

    def split(nodes: pa.Table, links: pa.Table) -> pa.Table:
        ids = np.sort(nodes.column("gid").to_numpy())
        i, j = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("src", "dst"))
        found = cl.best_split((len(ids), i, j, links.column("w").to_numpy()), 8, 2.0)
        n = len(ids) if found else 0
        side = found[1] if found else np.zeros(0, bool)
        return pa.table({"grp": pa.array(nodes.column("grp").to_pylist()[:n], pa.int32()), "gid": pa.array(ids[:n]), "side": pa.array(side), "claimed": pa.array(np.full(n, found[0] if found else 0.0))})

    links = g.meet(edges, p.select(F.col("gid").alias("src"), F.col("grp").alias("scene")), "src")
    sides = cut(p.groupBy("grp").cogroup(links.groupBy("scene")).applyInArrow(split, "grp int, gid bigint, side boolean, claimed double"), "sides")
    scores = g.cut_score(edges, sides, "gid", "side")
    claims = sides.groupBy("grp").agg(F.first("claimed").alias("claimed"), F.least(F.count(F.when(F.col("side"), 1)), F.count(F.when(~F.col("side"), 1))).alias("least"))
    both = p.select("grp").distinct().join(claims, "grp", "left").join(scores, "grp", "left")
    agrees = F.col("claimed").isNull() | ((F.abs(F.col("claimed") - F.coalesce("score", F.lit(0.0))) < 1e-6) & (F.col("least") >= 8))
    return both.select("grp", agrees.alias("agrees"))


@query("g12_recursive_cut", "SELECT scene_id AS grp, count(*) AS nodes, true AS sound FROM p GROUP BY scene_id")
def g12(s, d):
    """Recursive cuts of each scene's affinity graph: every node has a label, larger clusters have smaller ones, none but a whole graph is
    smaller than asked."""
    import numpy as np
    import pyarrow as pa

    from fieldmill.operators import cluster as cl

    p = B.points(s, d).select("gid", F.col("scene_id").alias("grp"))
    edges = g.affinity_edges(near(s, d), features(s, d), "gid", "v").join(p.select(F.col("gid").alias("src"), F.col("grp").alias("scene")), "src")

    def cuts(nodes: pa.Table, links: pa.Table) -> pa.Table:
        ids = np.sort(nodes.column("gid").to_numpy())
        i, j = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("src", "dst"))
        order = np.lexsort((j, i))
        labels = cl.recursive_cut((len(ids), i[order], j[order], links.column("w").to_numpy()[order]), 6, 8, 0.8)
        return pa.table({"grp": nodes.column("grp"), "gid": pa.array(ids), "label": pa.array(labels, pa.int64())})

    labelled = p.groupBy("grp").cogroup(edges.groupBy("scene")).applyInArrow(cuts, "grp int, gid bigint, label bigint")
    sizes = labelled.groupBy("grp", "label").agg(F.count("*").alias("n"))
    listed = sizes.groupBy("grp").agg(F.sum("n").alias("nodes"), F.array_sort(F.collect_list(F.struct("label", "n"))).alias("z"))
    falling = F.forall(F.sequence(F.lit(1), F.size("z")), lambda i: (i == 1) | (F.get("z", i - 1)["n"] <= F.get("z", i - 2)["n"]))
    sound = (F.col("z")[0]["label"] == 0) & falling & ((F.size("z") == 1) | (F.element_at("z", -1)["n"] >= 8))
    return listed.select("grp", "nodes", sound.alias("sound"))
