"""Neighbours, components, clustering and geometry against brute force and planted answers."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fieldmill.functions import geometry as ge
from fieldmill.operators import aggregates as ag
from fieldmill.operators import cluster as cl
from fieldmill.operators import filters as fl
from fieldmill.operators import graph as gr
from fieldmill.operators import knn as kn
from fieldmill.operators import labels as lb
from fieldmill.operators import masks as mk
from fieldmill.operators import vectors as vc
from fieldmill.operators import components as co
from fieldmill.operators.components import connected_components


def cloud(spark, n=120, seed=0):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, 3)) * [5, 0.2, 0.2]
    x[1] = x[0]
    x[-1] = [400, 0, 0]
    return x, spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(x)] + [(n, None, 0.0, 0.0, 0.0), (n + 1, 0, None, 0.0, 0.0)], "gid bigint, s int, x double, y double, z double")


@pytest.mark.parametrize("few", [4096, 0, 20])
def test_knn_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(kn, "FEW", few)
    x, df = cloud(spark)
    got = {}
    for r in kn.knn_join(df, df, 4, "gid", ["x", "y", "z"], "s").collect():
        got.setdefault(r["src"], {})[r["rank"]] = r["dst"]
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        others = sorted((d[j], j) for j in range(len(x)) if j != i and j % 2 == i % 2)[:4]
        assert [got[i][k] for k in (1, 2, 3, 4)] == [j for _, j in others]
    assert kn.knn_join(df.limit(0), df.limit(0), 3, "gid", ["x", "y", "z"], "s").count() == 0


def test_far_points_do_not_widen_the_cells(spark, monkeypatch):
    monkeypatch.setattr(kn, "FEW", 50)
    r = np.random.default_rng(3)
    x = np.concatenate([r.uniform(0, 1, (1500, 2)), [[1e9, 0], [-1e9, 5]]])
    df = spark.createDataFrame([(i, 0, *map(float, v)) for i, v in enumerate(x)], "gid bigint, s int, x double, y double")
    left = df.select(F.col("s").alias("grp"), F.col("gid").alias("src"), F.col("x").alias("p0"), F.col("y").alias("p1"))
    right = df.select(F.col("s").alias("grp"), F.col("gid").alias("dst"), F.col("x").alias("q0"), F.col("y").alias("q1"))
    levels = {v["src"]: v["lev"] for v in kn._with_levels(left, right, ["p0", "p1"], ["q0", "q1"], 2e9, 4).collect()}
    assert max(levels[i] for i in range(1500)) < -2 and levels[1500] > 20
    got = {}
    for v in kn.knn_join(df, df, 4, "gid", ["x", "y"], "s").collect():
        got.setdefault(v["src"], []).append((v["rank"], v["dst"]))
    for i in (*range(0, 1500, 50), 1500, 1501):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert [b for _, b in sorted(got[i])] == [j for _, j in sorted((d[j], j) for j in range(len(x)) if j != i)[:4]]


def test_fewer_points_than_neighbours(spark):
    df = spark.createDataFrame([(1, 0, 0.0), (2, 0, 3.0), (3, 1, 0.0)], "gid bigint, s int, x double")
    assert sorted((r["src"], r["dst"]) for r in kn.knn_join(df, df, 5, "gid", ["x"], "s").collect()) == [(1, 2), (2, 1)]


@pytest.mark.parametrize("one_task", [1_000_000, 0])
def test_components_whatever_the_direction(spark, monkeypatch, one_task):
    from fieldmill.operators import components

    monkeypatch.setattr(components, "ONE_TASK", one_task)
    r = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)] + [(7, None)]
    root = {v: v for e in edges for v in e if None not in e}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if b is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    df = spark.createDataFrame(edges, "u bigint, v bigint").repartition(5)
    assert {x["node"]: x["component"] for x in connected_components(df, "u", "v").collect()} == {v: find(v) for v in root}
    assert connected_components(df.limit(0), "u", "v").count() == 0


def test_density_hierarchy_finds_planted_clusters():
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(40, 3)) * 0.05 + c for c in ([0, 0, 0], [3, 0, 0], [0, 3, 0])] + [r.uniform(8, 20, (6, 3))])
    labels = cl.density_hierarchy(x, 10)
    assert [len(set(labels[i * 40 : i * 40 + 40])) for i in range(3)] == [1, 1, 1]
    assert len({labels[0], labels[40], labels[80]}) == 3
    assert (cl.density_hierarchy(x[:5], 10) == -1).all()


def test_cuts_separate_planted_blocks():
    r = np.random.default_rng(3)
    w = r.uniform(0.8, 1, (60, 60)) * (np.arange(60)[:, None] // 20 == np.arange(60) // 20) + 1e-3
    w = np.maximum(w, w.T)
    labels = cl.recursive_cut(w, max_clusters=8, min_size=5, limit=0.2)
    assert [len(set(labels[i * 20 : i * 20 + 20])) for i in range(3)] == [1, 1, 1] and len(set(labels)) == 3
    apart = np.kron(np.eye(2), np.ones((10, 10)))
    assert cl.best_split(cl._graph(apart), 5, 0.1)[0] == 0.0 and cl.best_split(cl._graph(apart), 11, 0.1) is None


def test_swept_scores_equal_their_definition():
    r = np.random.default_rng(5)
    w = r.uniform(0, 1, (40, 40)) * (r.uniform(0, 1, (40, 40)) < 0.2)
    w = np.maximum(w, w.T)
    value = np.round(r.normal(size=40), 1)  # with ties
    cuts = np.array([-9.0, -0.5, 0.0, 0.3, 9.0])
    score, size = cl.sweep_scores(cl._graph(w), value, cuts)
    for c, got, n in zip(cuts, score, size):
        a = value <= c
        left, right, across = w[a].sum(), w[~a].sum(), w[np.ix_(a, ~a)].sum()
        want = across / left + across / right if min(left, right) > 1e-8 else np.inf
        assert n == a.sum() and (got == want or abs(got - want) < 1e-9)


def test_sparse_cuts_equal_dense_ones():
    r = np.random.default_rng(7)
    x = np.sort(r.uniform(0, 20, 700))
    w = np.exp(-((x[:, None] - x) ** 2) * 4) * (np.abs(x[:, None] - x) < 1)
    np.fill_diagonal(w, 0)
    d = 1 / np.sqrt(w.sum(axis=1))
    values, vectors = np.linalg.eigh(np.eye(700) - d[:, None] * w * d)
    found = cl._fiedler(cl._graph(w))
    assert abs(abs(found @ vectors[:, 1]) - 1) < 1e-6


def test_cut_query_cuts_each_scene(spark, tmp_path):
    # Three scenes at one place, two blocks of 200 points each; and one scene under the least cluster size.
    r = np.random.default_rng(8)
    made = []
    for scene in range(3):
        for block in range(2):
            for _ in range(200):
                x, y, z = (r.normal(size=3) + [40 * block, 0, 0]).tolist()
                made.append((len(made), scene, x, y, z, [1.0, float(block), float(scene)]))
    made += [(1200 + i, 3, *r.normal(size=3).tolist(), [1.0, 0.0, 0.0]) for i in range(40)]
    spark.createDataFrame(made, "gid bigint, scene_id int, x float, y float, z float, f_dc array<float>").write.parquet(f"{tmp_path}/gaussians.parquet")
    from fieldmill.plans.io_queries import g13

    got = {x["gid"]: x["label"] for x in g13(spark, str(tmp_path)).collect()}
    assert len(got) == 1240 and set(got.values()) == set(range(7))
    assert all(got[i] == got[i // 200 * 200] for i in range(1200)) and all(got[1200 + i] == got[1200] for i in range(40))


def test_density_clusters_cover_all_rows(spark):
    r = np.random.default_rng(4)
    made = [(i, (np.eye(3)[i % 3] + r.normal(size=3) * 0.02).tolist()) for i in range(90)] + [(90, None)]
    df = spark.createDataFrame(made, "gid bigint, v array<double>")
    got = {x["gid"]: x["label"] for x in cl.density_clusters(df, "gid", "v", min_size=8).collect()}
    assert len(got) == 90 and all(got[i] == got[i % 3] for i in range(90)) and len(set(got.values())) == 3


def test_density_clusters_of_every_scene_are_found(spark):
    # 240 groups of 12 in four scenes: a sample of 2 000 pooled rows leaves most of them under 10 rows.
    r = np.random.default_rng(5)
    centres = r.normal(size=(240, 32))
    made = [(i, i % 240 % 4, (centres[i % 240] + r.normal(size=32) * 0.02).tolist()) for i in range(2880)]
    df = spark.createDataFrame(made, "gid bigint, s int, v array<double>")
    got = {x["gid"]: (x["label"], x["conf"]) for x in cl.density_clusters(df, "gid", "v", group="s").collect()}
    assert len(got) == 2880 and {v[0] for v in got.values()} == set(range(240))
    assert all(got[i][0] == got[i % 240][0] and got[i][1] > 0.9 for i in got)
    few = cl.group_sample(df, "gid", "s", 100)
    assert [x["count"] for x in few.groupBy("s").count().collect()] == [100] * 4


def test_density_query_finds_small_groups(spark, tmp_path):
    from fieldmill.plans.io_queries import g15

    r = np.random.default_rng(6)
    centres = r.normal(size=(400, 32))
    made = [(i, i % 400 % 5, (centres[i % 400] + r.normal(size=32) * 0.02).tolist()) for i in range(4800)]
    spark.createDataFrame(made, "gid bigint, scene_id int, f array<float>").write.parquet(f"{tmp_path}/features.parquet")
    assert g15(spark, str(tmp_path)).select("label").distinct().count() == 400


def test_local_scale_never_falls_below_the_group_median(spark):
    _, df = cloud(spark, 40)
    near = kn.knn_join(df, df, 4, "gid", ["x", "y", "z"], "s")
    scales = gr.local_scale(near).groupBy("grp").agg(F.min("scale").alias("low"), F.median("scale").alias("mid")).collect()
    assert all(r["low"] > 0 and r["low"] <= r["mid"] for r in scales)


def test_empty_selection_means_everything(spark):
    df = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, None)], "g int, v int")
    assert fl.keep_or_all(df, F.col("v") == 1).count() == 2
    assert fl.keep_or_all(df, F.col("v") == 9).count() == 4
    assert fl.keep_or_all(df.limit(0), F.col("v") == 1).count() == 0


def test_relabel_is_idempotent_and_keeps_order(spark):
    df = spark.createDataFrame([(v,) for v in (7, -3, 7, 2, None, -1, 40)], "l bigint")
    once = [r["dense"] for r in lb.dense_labels(df, "l").orderBy("l").collect()]
    assert once == [None, -1, -1, 0, 1, 1, 2]
    again = lb.dense_labels(lb.dense_labels(df, "l", "m"), "m", "n").filter("not m <=> n")
    assert again.count() == 0


def test_toggle_twice_is_identity(spark):
    a, b = (spark.createDataFrame([(v,) for v in vs], "v int") for vs in ((1, 2, 3, 3), (3, 4)))
    assert sorted(r[0] for r in lb.toggle(lb.toggle(a, b), b).collect()) == [1, 2, 3]


@pytest.mark.parametrize("total", [0, 1, 7, 10, 25, 99])
def test_stratified_quotas_add_up(spark, total):
    df = spark.createDataFrame([(i, i % 7 % 3) for i in range(25)], "id bigint, l int")
    assert ag.stratified_sample(df, "l", "id", total).count() == min(total, 25)


def test_distribution_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 1, 2, 5, 9)] + [(None,)], "v double")
    got = [r["cdf"] for r in ag.ecdf(df, "v").orderBy("v").collect()]
    assert got == [None, 0.5, 0.5, 0.75, 1.0, 1.0]


def test_mean_of_nothing_is_zero(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 2.0)], "k string, v double")
    assert {r["k"]: r["v"] for r in ag.stage_aggregate(df, ["k"], ["v"], []).collect()} == {"a": 0.0, "b": 2.0}


def test_winner_ties_go_to_the_first_label(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None)], "k string, v double")
    assert ag.winner(df, ["v"], ["k"]).first()["k"] == "a"


def test_blend_weights_stay_below_one_and_stop(spark):
    made = [("p", float(d), 0.9, 1.0) for d in range(12)] + [("q", 1.0, 0.001, 1.0)]
    df = spark.createDataFrame(made, "p string, depth double, alpha double, c double")
    got = {r["p"]: r for r in ge.blend(df, ["p"], ["depth"], ["c"]).collect()}
    assert "q" not in got and 0.99 < got["p"]["c"] <= 1 and got["p"]["left"] >= 1e-4 - 1e-12


def test_greedy_compares_with_kept_masks_only(spark):
    masks = spark.createDataFrame([("v", i, i) for i in (1, 2, 3)] + [("w", 9, 1)], "view_id string, mask_id bigint, rank int")
    pairs = spark.createDataFrame([("v", 1, 2, 0.9), ("v", 2, 3, 0.9)], "view_id string, a bigint, b bigint, iou double")
    got = sorted((r["view_id"], r["mask_id"]) for r in mk.greedy_suppress(masks, pairs, ["rank"], 0.5).collect())
    assert got == [("v", 1), ("v", 3), ("w", 9)]


def test_matrix_suppression_compares_with_every_better_mask(spark):
    scores = spark.createDataFrame([("v", i, 10 - i) for i in (1, 2, 3)], "view_id string, mask_id bigint, score int")
    pairs = spark.createDataFrame([("v", 1, 2, 9, 10, 10, 0.9), ("v", 2, 3, 9, 10, 10, 0.9)], "view_id string, a bigint, b bigint, common int, area_a int, area_b int, iou double")
    assert [r["mask_id"] for r in mk.matrix_suppress(scores, pairs, 0.5, 0.95).collect()] == [1]


def test_kmeans_keeps_empty_centres(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1])], "gid bigint, e array<double>")
    start = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, -1.0])], "label bigint, centre array<double>")
    got = {r["label"]: r["centre"] for r in vc.lloyd(df, "gid", "e", start, 2).collect()}
    assert got[1] == [0.0, -1.0] and got[0][0] > 0.9


def test_too_many_centres_are_refused(spark):
    many = spark.range(vc.MOST_CENTRES + 1).select(F.col("id").alias("label"), F.array(F.lit(1.0)).alias("centre"))
    with pytest.raises(ValueError):
        vc.collect_centres(many, "label", "centre")


def test_similarity_of_an_image_with_itself(spark):
    pixels = spark.createDataFrame([("i", y, x, float(x * y % 5) / 5, float(x * y % 5) / 5) for y in range(9) for x in range(9)], "k string, y int, x int, a double, b double")
    assert abs(ge.ssim(pixels, ["k"]).first()["ssim"] - 1) < 1e-9


@pytest.mark.parametrize("parts", [1, 7])
def test_running_totals_over_ranges_equal_a_plain_sum(spark, parts):
    from fieldmill.operators.ranks import numbered, running_total

    r = np.random.default_rng(parts)
    made = [(i, None if r.random() < 0.2 else ("hot" if r.random() < 0.5 else f"g{r.integers(9)}"), float(r.integers(30)), None if r.random() < 0.1 else int(r.integers(9))) for i in range(700)]
    df = spark.createDataFrame(made, "id bigint, grp string, t double, v int").repartition(parts)
    got = {x["id"]: (x["total"], x["place"]) for x in running_total(numbered(df, ["grp"], [F.desc("t"), "id"], "place"), ["grp"], ["t", "id"], F.col("v"), "total").collect()}
    for i, g, t, _ in made:
        upto = [v for a, b, c, v in made if b == g and (c, a) <= (t, i) and v is not None]
        place = sum(b == g and (-c, a) <= (-t, i) for a, b, c, _ in made)
        assert got[i] == (sum(upto) if upto else None, place)
    assert numbered(df.limit(0), [], ["id"], "n").count() == 0
    assert sorted(x["n"] for x in numbered(df, [], ["id"], "n").collect()) == list(range(1, 701))


def test_knn_joins_nothing(spark, monkeypatch):
    # Rows exploded to cells pass for small tables, which the driver would broadcast; blocks are searched without any join.
    from pyspark.sql.classic.dataframe import DataFrame

    def refused(*_, **__):
        raise AssertionError("a join")

    monkeypatch.setattr(kn, "FEW", 20)
    monkeypatch.setattr(DataFrame, "join", refused)
    r = np.random.default_rng(11)
    x = np.round(r.normal(size=(900, 3)) * [9, 3, 1])  # many ties, many points at one place
    x[:40] = 0
    df = spark.createDataFrame([(i, i % 2, *map(float, v)) for i, v in enumerate(x)], "gid bigint, s int, x double, y double, z double")
    got = {}
    for v in kn.knn_join(df, df, 5, "gid", ["x", "y", "z"], "s").collect():
        got.setdefault(v["src"], []).append((v["rank"], v["dst"]))
    for i in range(len(x)):
        d = ((x - x[i]) ** 2).sum(axis=1)
        assert [b for _, b in sorted(got[i])] == [j for _, j in sorted((d[j], j) for j in range(len(x)) if j != i and j % 2 == i % 2)[:5]]


@pytest.mark.parametrize("of", ["pairs", "overlap"])
def test_pixels_are_not_broadcast(spark, data, of):
    from fieldmill.plans import mask_queries as mq

    found = mk.mask_pairs(mq.pixels(spark, data)) if of == "pairs" else mk.best_overlap(mq.pixels(spark, data), mq._labels(spark, data))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pixels = [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "y#" in line]
    assert not pixels and (of == "overlap" or "BroadcastHashJoin" not in plan)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_components_and_refinement_are_not_broadcast(spark, data):
    # Stars and labelled points are as many as the points, in files small enough for Spark to send them through the driver.
    from fieldmill.plans import graph_queries as gq

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 400, 2)], "a bigint, b bigint")
    assert "BroadcastHashJoin" not in _plan(connected_components(edges, "a", "b"))
    plan = _plan(gq.QUERIES["g16_refine"](spark, data))
    # What a scene, or a label in it, has one row for may be sent; what has a row for each point or component may not.
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[grp#" not in line]


#: Queries that read only the first ranks of their neighbours, and how many.
FIRST_RANKS = {"e1_mean_square": 3, "e2_smooth": 4, "f24_initial_splats": 3, "e3_smooth_part": 4, "e4_weighted_smoothing": 6}


@pytest.mark.parametrize("name", FIRST_RANKS)
def test_no_more_neighbours_than_read(spark, data, monkeypatch, name):
    from fieldmill.plans import graph_queries as gq

    asked, join = [], kn.knn_join
    monkeypatch.setattr(kn, "knn_join", lambda a, b, k, *rest, **more: asked.append(k) or join(a, b, k, *rest, **more))
    gq.QUERIES[name](spark, data)
    assert asked == [FIRST_RANKS[name]]


@pytest.mark.parametrize("name", ["g3_colour_weight", "g7_adaptive_edges", "g9_residue"])
def test_points_are_not_broadcast(spark, data, name):
    from fieldmill.plans import graph_queries as gq

    plan = _plan(gq.QUERIES[name](spark, data))
    assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and "[grp#" not in line]


@pytest.mark.parametrize("name", ["g11_split", "g13_cut_clusters", "z1_active_group"])
def test_points_are_not_broadcast_on_the_way(spark, data, monkeypatch, name):
    # These queries write tables on the way, so their last plan doesn't show these joins.
    from fieldmill.plans import graph_queries as gq
    from fieldmill.plans.registry import collect

    plans = []
    for module in (gq, cl):
        monkeypatch.setattr(module, "cut", lambda df, label="cut", write=module.cut: plans.append(_plan(df)) or write(df, label))
    monkeypatch.setattr(gr, "components_of", lambda p, key, edges, found=gr.components_of: plans.append(_plan(edges)) or found(p, key, edges))
    plans.append(_plan(collect()[0][name](spark, data)))
    keys = ("[src#", "[dst#", "[gid#", "[a#", "[b#")
    assert len(plans) > 1 and not [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and any(k in line for k in keys)]


def test_seed_parts_are_not_broadcast(spark, data, monkeypatch):
    # Components are written once and merged with one row a scene; neither a plan on the way nor the last one sends a table through the driver.
    from fieldmill.plans import graph_queries as gq

    plans = []
    monkeypatch.setattr(gq, "cut", lambda df, label="cut", write=gq.cut: plans.append(_plan(df)) or write(df, label))
    plans.append(_plan(gq.QUERIES["z13_seed_part"](spark, data)))
    assert len(plans) == 2 and "SortMergeJoin" in plans[1]
    assert not [line for plan in plans for line in plan.splitlines() if "BroadcastHashJoin" in line and "[grp#" not in line]


def test_seed_part_of_each_scene(spark, data, monkeypatch):
    # Two scenes, each with the component of its least id, and others that must not come along.
    from fieldmill.plans import graph_queries as gq

    rows = [(1, 7, 1), (2, 7, 1), (3, 7, 3), (4, 8, 4), (5, 8, 5), (6, 8, 4), (9, 8, 4), (1, 7, 1)]
    monkeypatch.setattr(gq, "_parts", lambda s, d: s.createDataFrame(rows, "gid bigint, scene_id int, component bigint"))
    got = {r["seed"]: (r["members"], r["fingerprint"]) for r in gq.QUERIES["z13_seed_part"](spark, data).collect()}
    sums = {1: "1,2", 4: "4,6,9"}
    assert got == {k: (m.count(",") + 1, f"{m.count(',') + 1}:{hashlib.sha256(m.encode()).hexdigest()}") for k, m in sums.items()}


@pytest.mark.parametrize("most", [1, 7, 64, 10_000])
def test_edges_are_contracted_piece_by_piece(monkeypatch, most):
    # What one contraction holds follows the nodes, however many edges the task reads, and the stars are those of all edges at once.
    r = np.random.default_rng(most)
    u, v = np.sort(r.integers(0, 300, size=(2, 4000)), axis=0)[::-1]
    v = np.maximum(v, u // 25 * 25)  # twelve components
    sizes, find = [], co.roots_of
    monkeypatch.setattr(co, "roots_of", lambda a, b: sizes.append(len(a)) or find(a, b))
    batches = [pa.RecordBatch.from_arrays([pa.array(u[i : i + 900]), pa.array(v[i : i + 900])], ["u", "v"]) for i in range(0, 4000, 900)]
    nodes, root = co.stars_of(iter(batches), most)
    want, least = find(u, v)
    assert dict(zip(nodes, root)) == {n: m for n, m in zip(want, least) if n != m} and len(set(least)) > 10
    assert max(sizes) <= 2 * (300 + most)
    assert co.stars_of(iter([]), most) is None
