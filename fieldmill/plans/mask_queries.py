"""Queries over masks. Pixels are squares derived from each mask's number and area, as the tables hold no pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldmill.operators import masks as mk
from fieldmill.session import load

QUERIES: dict = {}
SQL: dict[str, str] = {}

SIDE = 27  # pixels of the derived frames, each way

_PIX = """WITH q AS (SELECT DISTINCT view_id, mask_id::BIGINT AS mask_id, (mask_id * 13) % 20 AS x0, (mask_id * 7) % 20 AS y0, 2 + area % 7 AS side FROM masks),
 q2 AS (SELECT *, unnest(range(side)) AS i FROM q), q3 AS (SELECT *, unnest(range(side)) AS j FROM q2),
 pix AS (SELECT DISTINCT view_id, mask_id, (y0 + i)::BIGINT AS y, (x0 + j)::BIGINT AS x FROM q3),
 ar AS (SELECT view_id, mask_id, count(*) AS area FROM pix GROUP BY ALL),
 pr AS (SELECT view_id, a, b, common, u.area AS area_a, v.area AS area_b, common / (u.area + v.area - common) AS iou FROM
  (SELECT a.view_id, a.mask_id AS a, b.mask_id AS b, count(*) AS common FROM pix a JOIN pix b ON a.view_id = b.view_id AND a.y = b.y AND a.x = b.x AND a.mask_id < b.mask_id GROUP BY ALL)
  JOIN ar u USING (view_id) JOIN ar v USING (view_id) WHERE u.mask_id = a AND v.mask_id = b),
 st AS (SELECT unnest([-1, 0, 1]) AS s), nb AS (SELECT view_id, mask_id, y + a.s AS y, x + b.s AS x, count(*) AS n FROM pix, st a, st b GROUP BY ALL),
 dil AS (SELECT view_id, mask_id, y, x FROM nb WHERE y BETWEEN 0 AND 26 AND x BETWEEN 0 AND 26), ero AS (SELECT view_id, mask_id, y, x FROM nb WHERE n = 9)
"""


def pixels(s, d):
    q = load(s, d, "masks").select(
        "view_id", F.col("mask_id").cast("bigint").alias("mask_id"), (F.col("mask_id") * 13 % 20).alias("x0"), (F.col("mask_id") * 7 % 20).alias("y0"), (2 + F.col("area") % 7).alias("side")
    ).distinct()
    places = F.sequence(F.lit(0).cast("bigint"), F.col("side") - 1)
    return q.withColumn("i", F.explode(places)).withColumn("j", F.explode(places)).select("view_id", "mask_id", (F.col("y0") + F.col("i")).alias("y"), (F.col("x0") + F.col("j")).alias("x")).distinct()


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = (_PIX.replace("WITH q", "WITH RECURSIVE q", 1) if name == "w7_greedy" else _PIX) + sql
        return f

    return add


@query("a8_border_stats", """SELECT view_id, mask_id, count(*) AS area, count(*) / 729 AS ratio,
 max((y = 0)::INT) + max((y = 26)::INT) + max((x = 0)::INT) + max((x = 26)::INT) AS touches,
 (sum((y = 0)::INT) + sum((y = 26)::INT) + sum((x = 0)::INT) + sum((x = 26)::INT)) / 108 AS coverage FROM pix GROUP BY ALL""")
def a8(s, d):
    return mk.mask_stats(pixels(s, d), SIDE, SIDE)


@query("a26_boxes", "SELECT view_id, mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pix GROUP BY ALL")
def a26(s, d):
    return mk.mask_boxes(pixels(s, d))


@query("a26_square_boxes", """, bx AS (SELECT view_id, mask_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pix GROUP BY ALL),
 sq AS (SELECT *, least(ceil(greatest(x1 - x0 + 1, y1 - y0 + 1) * 1.5), 27)::BIGINT AS side FROM bx)
 SELECT view_id, mask_id, greatest(0, least(floor((x0 + x1 + 1) / 2 - side / 2), 27 - side))::BIGINT AS sx, greatest(0, least(floor((y0 + y1 + 1) / 2 - side / 2), 27 - side))::BIGINT AS sy, side FROM sq""")
def a26b(s, d):
    return mk.square_boxes(mk.mask_boxes(pixels(s, d)), 0.25, SIDE)


@query("j13_mask_iou", "SELECT view_id, a, b, common, round(iou, 6) AS iou FROM pr")
def j13(s, d):
    return mk.mask_pairs(pixels(s, d)).select("view_id", "a", "b", "common", F.round("iou", 6).alias("iou"))


@query("a13_mean_iou", """, e AS (SELECT view_id, a AS mask_id, iou FROM pr UNION ALL SELECT view_id, b, iou FROM pr), n AS (SELECT view_id, count(*) AS n FROM ar GROUP BY 1),
 t AS (SELECT view_id, mask_id, sum(iou) AS total FROM e GROUP BY ALL)
 SELECT view_id, round(avg(CASE WHEN n > 1 THEN coalesce(total, 0) / (n - 1) ELSE 0 END), 6) AS mean_iou FROM ar LEFT JOIN t USING (view_id, mask_id) JOIN n USING (view_id) GROUP BY view_id""")
def a13(s, d):
    return mk.mean_pair_iou(pixels(s, d)).select("view_id", F.round("mean_iou", 6).alias("mean_iou"))


_OVER = """, lab AS (SELECT view_id, y, x, max(mask_id) % 4 AS label FROM pix GROUP BY ALL), sz AS (SELECT view_id, label, count(*) AS size FROM lab GROUP BY ALL),
 ov AS (SELECT view_id, mask_id, label, count(*) AS common FROM pix JOIN lab USING (view_id, y, x) GROUP BY ALL),
 sc AS (SELECT view_id, mask_id, label, common / greatest(area + size - common, 1) AS iou, common / size AS precision, common / area AS recall FROM ov JOIN ar USING (view_id, mask_id) JOIN sz USING (view_id, label))"""


def _labels(s, d):
    return pixels(s, d).groupBy("view_id", "y", "x").agg((F.max("mask_id") % 4).alias("label"))


@query("j16_overlap", _OVER + "SELECT view_id, mask_id, label, common FROM ov")
def j16(s, d):
    return pixels(s, d).join(_labels(s, d), ["view_id", "y", "x"]).groupBy("view_id", "mask_id", "label").agg(F.count("*").alias("common"))


@query("a12_best_overlap", _OVER + "SELECT view_id, mask_id, label, round(iou, 6) AS iou, round(precision, 6) AS precision, round(recall, 6) AS recall FROM sc QUALIFY row_number() OVER (PARTITION BY view_id, mask_id ORDER BY iou DESC, label) = 1")
def a12(s, d):
    best = mk.best_overlap(pixels(s, d), _labels(s, d))
    return best.select("view_id", "mask_id", "label", *(F.round(c, 6).alias(c) for c in ("iou", "precision", "recall")))


@query("a17_mean_category_iou", _OVER + ", b AS (SELECT view_id, mask_id, label, iou FROM sc QUALIFY row_number() OVER (PARTITION BY view_id, mask_id ORDER BY iou DESC, label) = 1), k AS (SELECT label, view_id, avg(iou) AS v FROM b GROUP BY ALL) SELECT label, round(avg(v), 6) AS iou FROM k GROUP BY label")
def a17(s, d):
    best = mk.best_overlap(pixels(s, d), _labels(s, d))
    return best.groupBy("label", "view_id").agg(F.avg("iou").alias("v")).groupBy("label").agg(F.round(F.avg("v"), 6).alias("iou"))


@query("j15_comembership", "SELECT DISTINCT view_id, a.x AS x, a.y AS y FROM pix a JOIN (SELECT view_id, mask_id FROM pix WHERE y = 10 AND x = 10) USING (view_id, mask_id)")
def j15(s, d):
    pix = pixels(s, d)
    with_ray = pix.filter("y = 10 and x = 10").select("view_id", "mask_id")
    return pix.join(with_ray, ["view_id", "mask_id"], "left_semi").select("view_id", "x", "y").distinct()


@query("w17_exclusive_claim", "SELECT view_id, y, x, max_by(mask_id, area * 1000 + mask_id) AS mask_id FROM pix JOIN ar USING (view_id, mask_id) GROUP BY view_id, y, x")
def w17(s, d):
    pix = pixels(s, d)
    areas = pix.groupBy("view_id", "mask_id").agg(F.count("*").alias("area"))
    return mk.exclusive_claims(pix.join(areas, ["view_id", "mask_id"]), "area")


@query("w16_largest_masks", "SELECT view_id, mask_id, area FROM ar QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY area DESC, mask_id) <= 3")
def w16(s, d):
    from pyspark.sql import Window

    areas = pixels(s, d).groupBy("view_id", "mask_id").agg(F.count("*").alias("area"))
    return areas.withColumn("r", F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("area"), "mask_id"))).filter("r <= 3").drop("r")


@query("x27_erode", "SELECT * FROM ero")
def x27e(s, d):
    return mk.erode(pixels(s, d))


@query("x27_dilate", "SELECT * FROM dil")
def x27d(s, d):
    return mk.dilate(pixels(s, d), SIDE, SIDE)


@query("x27_majority", ", w AS (SELECT view_id, mask_id, y + a.s AS y, x + b.s AS x, count(*) AS n, bool_or(a.s = 0 AND b.s = 0) AS own FROM pix, st a, st b GROUP BY ALL) SELECT view_id, mask_id, y, x FROM w WHERE n >= 5 AND own")
def x27m(s, d):
    return mk.majority(pixels(s, d))


@query("x27_boundary", "SELECT * FROM dil EXCEPT SELECT * FROM ero")
def x27b(s, d):
    return mk.boundary_band(pixels(s, d), SIDE, SIDE)


@query("u10_exclusive_growth", ", fr AS (SELECT * FROM dil d WHERE NOT EXISTS (SELECT 1 FROM pix p WHERE p.view_id = d.view_id AND p.y = d.y AND p.x = d.x)) SELECT view_id, mask_id, y, x FROM pix UNION ALL SELECT view_id, min(mask_id), y, x FROM fr GROUP BY view_id, y, x HAVING count(*) = 1")
def u10(s, d):
    return mk.exclusive_growth(pixels(s, d), SIDE, SIDE)


@query("a25_pixel_weight", ", w AS (SELECT view_id, y, x, 1 / avg(area) AS w FROM pix JOIN ar USING (view_id, mask_id) GROUP BY ALL), sp AS (SELECT view_id, min(w) AS low, max(w) AS high FROM w GROUP BY 1) SELECT view_id, y, x, round(CASE WHEN high - low > 1e-12 THEN 1 + 9 * (w - low) / (high - low) ELSE 1 END, 6) AS weight FROM w JOIN sp USING (view_id)")
def a25(s, d):
    return mk.pixel_weights(pixels(s, d)).select("view_id", "y", "x", F.round("weight", 6).alias("weight"))


@query("w7_greedy", """, rk AS (SELECT view_id, mask_id, row_number() OVER (PARTITION BY view_id ORDER BY area DESC, mask_id) AS r FROM ar),
 fo AS (SELECT view_id, mask_id, list(b) AS foes FROM (SELECT view_id, a AS mask_id, b FROM pr WHERE iou > 0.2 UNION SELECT view_id, b, a FROM pr WHERE iou > 0.2) GROUP BY ALL),
 rf AS MATERIALIZED (SELECT rk.*, coalesce(foes, []) AS foes FROM rk LEFT JOIN fo USING (view_id, mask_id)),
 k(view_id, r, kept) AS (SELECT DISTINCT view_id, 0::BIGINT, []::BIGINT[] FROM ar UNION ALL SELECT k.view_id, rf.r, CASE WHEN list_has_any(kept, foes) THEN kept ELSE list_append(kept, mask_id) END FROM k JOIN rf ON rf.view_id = k.view_id AND rf.r = k.r + 1)
 SELECT view_id, unnest(kept) AS mask_id FROM (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY r DESC) = 1)""")
def w7(s, d):
    pix = pixels(s, d)
    areas = pix.groupBy("view_id", "mask_id").agg((-F.count("*")).alias("order"))
    return mk.greedy_suppress(areas, mk.mask_pairs(pix), ["order"], 0.2)


@query("w8_matrix_nms", """, rk AS (SELECT view_id, mask_id, row_number() OVER (PARTITION BY view_id ORDER BY (mask_id * 37) % 11 DESC, mask_id) AS rank FROM ar),
 kn AS (SELECT pr.*, u.rank AS ra, v.rank AS rb FROM pr JOIN rk u ON u.view_id = pr.view_id AND u.mask_id = a JOIN rk v ON v.view_id = pr.view_id AND v.mask_id = b),
 lost AS (SELECT view_id, CASE WHEN ra > rb THEN a ELSE b END AS mask_id FROM kn WHERE iou > 0.2 UNION SELECT view_id, a FROM kn WHERE common > 0.5 * area_a AND area_b >= 2 * area_a UNION SELECT view_id, b FROM kn WHERE common > 0.5 * area_b AND area_a >= 2 * area_b),
 mr AS (SELECT rk.*, l.mask_id IS NOT NULL AS lost FROM rk LEFT JOIN lost l USING (view_id, mask_id))
 SELECT view_id, mask_id FROM (SELECT *, bool_and(lost) OVER (PARTITION BY view_id) AS gone FROM mr) WHERE NOT lost OR gone AND rank <= 3""")
def w8(s, d):
    pix = pixels(s, d)
    scores = pix.select("view_id", "mask_id").distinct().withColumn("score", F.col("mask_id") * 37 % 11)
    return mk.matrix_suppress(scores, mk.mask_pairs(pix), 0.2, 0.5)


@query("j14_jaccard", ", it AS (SELECT DISTINCT view_id || '/' || mask_id AS item, view_id || '/' || y || '/' || x AS member FROM pix), n AS (SELECT item, count(*) AS n FROM it GROUP BY 1), c AS (SELECT a.item AS a, b.item AS b, count(*) AS c FROM it a JOIN it b USING (member) WHERE a.item < b.item GROUP BY ALL) SELECT a, b, round(1 - c / (u.n + v.n - c), 6) AS distance FROM c JOIN n u ON u.item = a JOIN n v ON v.item = b")
def j14(s, d):
    from fieldmill.operators.graph import jaccard_pairs

    items = pixels(s, d).select(F.concat_ws("/", "view_id", "mask_id").alias("item"), F.concat_ws("/", "view_id", "y", "x").alias("member"))
    return jaccard_pairs(items, "item", "member").select("a", "b", F.round("distance", 6).alias("distance"))


@query("x10_pixel_scores", ", s AS (SELECT view_id, mask_id, (mask_id * 37 % 11) / 10 AS score, area FROM ar) SELECT view_id, y, x, round(sum(score * area) / sum(area), 6) AS score FROM pix JOIN s USING (view_id, mask_id) GROUP BY view_id, y, x")
def x10(s, d):
    pix = pixels(s, d)
    scored = pix.groupBy("view_id", "mask_id").agg(F.count("*").alias("area")).withColumn("score", F.col("mask_id") * 37 % 11 / 10)
    return pix.join(scored, ["view_id", "mask_id"]).groupBy("view_id", "y", "x").agg(F.round(F.sum(F.col("score") * F.col("area")) / F.sum("area"), 6).alias("score"))


@query("z12_patch_vote", ", s AS (SELECT view_id, mask_id % 4 AS label, sum(exp(-((y - 13) * (y - 13) + (x - 13) * (x - 13)) / 50)) AS s FROM pix GROUP BY ALL) SELECT view_id, label, round(s / greatest(sum(s) OVER (PARTITION BY view_id), 1e-6), 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY view_id ORDER BY round(s, 9) DESC, label) = 1")
def z12(s, d):
    from fieldmill.operators.vectors import vote

    d2 = (F.col("y") - 13) * (F.col("y") - 13) + (F.col("x") - 13) * (F.col("x") - 13)
    voted = pixels(s, d).select("view_id", (F.col("mask_id") % 4).alias("label"), F.exp(-d2 / 50).alias("w"))
    return vote(voted, ["view_id"], "label", "w").select("view_id", "label", F.round("share", 6).alias("share"))
