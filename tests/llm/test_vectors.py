"""Neighbours and clusters against brute force, with odd vectors, copies, ties and hot groups."""

import numpy as np
import pytest

from fieldmill.llm import codes, density, neighbours

NAN = float("nan")


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    made = [(int(i), [float(np.float32(v)) for v in row], "c") for i, row in zip(ids, x)]
    odd = [(9001, None, "c"), (9002, [1.0] * 3, "c"), (9003, [0.0] * 8, "c"), (9004, [NAN] + [1.0] * 7, "c"), (9005, [float("inf")] + [0.0] * 7, "c"), (9006, [None] + [1.0] * 7, "c"), (None, [1.0] * 8, "c")]
    return spark.createDataFrame(made + odd, "gid bigint, f array<float>, key string").repartition(3)


def brute(x, ids, k, least):
    x = np.asarray(x, np.float32).astype(float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 6)
    out = set()
    for i in range(len(x)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(x)) if ids[j] != ids[i] and s[i, j] >= least)[:k]
        out |= {(min(ids[i], b), max(ids[i], b)) for _, b in near}
    return out


def planted(seed, groups=30, size=8, spread=0.03):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(groups, 8))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = np.repeat(centres, size, axis=0) + r.normal(size=(groups * size, 8)) * spread
    return x * r.uniform(0.2, 5, (len(x), 1))


@pytest.mark.parametrize("options", [{}, {"bucket_rows": 16}, {"bucket_rows": 64, "hot_rows": 20}])
def test_neighbours_reach_the_recall(spark, options):
    x = planted(1)
    x[5] = x[4]
    x[6] = 2 * x[4]
    want = brute(x, list(range(len(x))), 5, 0.96)
    got = {tuple(r) for r in neighbours.as_pairs(neighbours.cosine_neighbours(table(spark, x), "gid", "f", 8, **options)).collect()}
    assert got <= want | got & want and len(got & want) >= 0.95 * len(want)
    assert len(got - want) <= 0.02 * len(want)


@pytest.mark.parametrize("hot", [16_384, 40])
def test_a_third_of_all_rows_are_copies(spark, hot):
    x = planted(2, 20, 6)
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0)])
    ids = list(range(100, 100 + len(x)))
    got = {tuple(r) for r in neighbours.as_pairs(neighbours.cosine_neighbours(table(spark, x, ids), "gid", "f", 8, hot_rows=hot)).collect()}
    want = brute(x, ids, 5, 0.96)
    assert len(got ^ want) <= 0.02 * len(want)


def test_rows_repeated_under_an_id_and_empty_tables(spark):
    x = planted(3, 3, 4)
    df = table(spark, np.concatenate([x, x]), [*range(12), *range(12)])
    got = {tuple(r) for r in neighbours.as_pairs(neighbours.cosine_neighbours(df, "gid", "f", 8)).collect()}
    assert got == brute(x, list(range(12)), 5, 0.96)
    assert neighbours.cosine_neighbours(df.limit(0), "gid", "f", 8).count() == 0


@pytest.mark.parametrize("hot", [16_384, 30])
def test_positions_lose_nothing(spark, hot):
    r = np.random.default_rng(4)
    x = np.concatenate([r.uniform(0, 1, (150, 3)) * [6, 0.3, 0.3], np.repeat([[1.0, 0, 0]], 12, axis=0), r.normal(size=(60, 3)) * 0.05 + [3, 0, 0]]).astype(np.float32)
    group = [i % 2 for i in range(len(x))]
    made = [(i, g, *map(float, v)) for i, (g, v) in enumerate(zip(group, x))] + [(900, 0, None, 0.0, 0.0), (901, None, 0.0, 0.0, 0.0), (902, 0, NAN, 0.0, 0.0)]
    df = spark.createDataFrame(made, "gid bigint, scene_id int, x float, y float, z float").repartition(2)
    found = neighbours.position_neighbours(df, "gid", "scene_id", ["x", "y", "z"], k=5, radius=0.12, hot_rows=hot)
    got = {tuple(v) for v in neighbours.as_pairs(found).collect()}
    y, want = x.astype(float), set()
    for i in range(len(y)):
        d = np.round(np.sqrt(((y - y[i]) ** 2).sum(axis=1)), 6)
        near = sorted((d[j], j) for j in range(len(y)) if j != i and group[j] == group[i] and d[j] <= 0.12)[:5]
        want |= {(min(i, j), max(i, j)) for _, j in near}
    assert got == want


def components(near):
    label = list(range(len(near)))
    while True:
        new = [min([label[j] for j in np.flatnonzero(near[i])] + [label[i]]) for i in range(len(near))]
        if new == label:
            return label
        label = new


@pytest.mark.parametrize("options", [{}, {"cell_rows": 16}, {"hot_rows": 20, "cell_rows": 64}])
def test_clusters_equal_linked_components(spark, options):
    x = np.concatenate([planted(5, 25, 7), np.repeat(planted(6, 1, 1), 40, axis=0)]).astype(np.float32)
    got = {tuple(r) for r in density.vector_clusters(table(spark, x), "gid", "f", 8, min_core=2, **options).select("root_id", "member_id").collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    label = components(np.round(u @ u.T, 6) >= 0.96)
    want = {(a, i) for i, a in enumerate(label) if a != i and label.count(a) >= 5}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("hot", [16_384, 12])
def test_boxes_equal_linked_components(spark, hot):
    r = np.random.default_rng(7)
    made = [(i, i % 3, int(r.integers(0, 40)), float(np.round(r.uniform(0, 0.4), 3))) for i in range(200)]
    odd = [(900, 0, None, 0.1), (901, 0, 3, None), (902, 0, 3, NAN), (903, None, 3, 0.1), (made[0][0], *made[0][1:])]
    df = spark.createDataFrame(made + odd, "run_id bigint, suite_id bigint, n int, c double").repartition(2)
    got = {tuple(v) for v in density.box_clusters(df, "run_id", "suite_id", ["n", "c"], [3, 0.02], min_core=2, hot_rows=hot).select("root_id", "member_id").collect()}
    a = np.array([m[1:] for m in made])
    near = (a[:, None, 0] == a[None, :, 0]) & (abs(a[:, None, 1] - a[None, :, 1]) <= 3) & (abs(a[:, None, 2] - a[None, :, 2]) <= 0.02 + 1e-9)
    label = components(near)
    assert got == {(x, i) for i, x in enumerate(label) if x != i and label.count(x) >= 3}
    assert density.box_clusters(df.limit(0), "run_id", "suite_id", ["n", "c"], [3, 0.02]).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_crowded_boxes_equal_brute_force(spark, seed):
    r = np.random.default_rng(20 + seed)
    # Most rows in one suite, dense blobs at several distances, loose points between them.
    centres = np.array([[10, 0.1], [13.5, 0.1], [10, 0.125], [16.8, 0.131], [30, 0.5]])
    x = np.concatenate([c + r.normal(size=(200, 2)) * [0.5, 0.003] for c in centres] + [np.stack([r.uniform(5, 35, 60), r.uniform(0, 0.6, 60)], axis=1)])
    suite = [0 if r.random() < 0.9 else 1 for _ in x]
    df = spark.createDataFrame([(i, g, float(v[0]), float(v[1])) for i, (g, v) in enumerate(zip(suite, x))], "run_id bigint, suite_id bigint, n double, c double").repartition(2)
    near = np.equal.outer(suite, suite) & (abs(x[:, None, 0] - x[None, :, 0]) <= 3 + 1e-9) & (abs(x[:, None, 1] - x[None, :, 1]) <= 0.02 + 1e-9)
    want = {(min(m), i) for m in dbscan(near, 4).values() for i in m if i != min(m) and len(m) >= 4}
    for hot in (350, 16_384):
        got = density.box_clusters(df, "run_id", "suite_id", ["n", "c"], [3, 0.02], min_size=4, min_core=4, hot_rows=hot)
        assert {tuple(v) for v in got.select("root_id", "member_id").collect()} == want


def test_outer_bands_keep_counts_beyond_edges():
    r = np.random.default_rng(31)
    y, group = np.round(r.uniform(0, 1, (400, 2)), 2), r.integers(0, 3, 400)
    band = codes.outer_band(y, group, 3)
    assert len(band) < 250
    kept = np.zeros(400, bool)
    kept[band] = True
    for _ in range(300):
        (a, b), g, sx, sy = r.uniform(0, 1, 2), r.integers(3), *r.choice([1, -1], 2)
        beyond = (group == g) & (sx * y[:, 0] >= sx * a) & ((sy * y[:, 1] >= sy * b) | (r.random() < 0.3))
        assert min((beyond & kept).sum(), 3) == min(beyond.sum(), 3)


def test_descriptions(spark):
    x = planted(8, 4, 6)
    df = table(spark, x)
    clusters = density.vector_clusters(df, "gid", "f", 8)
    got = density.describe_clusters(clusters, df, "gid", "f", 8).collect()
    assert [r["size"] for r in got] == [6] * len(got) and all(len(r["typical"]) == 3 for r in got)


def test_run_clusters_are_described(spark, data):
    from fieldmill.llm import queries

    members = {}
    for r in queries.p5_found(spark, data).collect():
        members.setdefault((r["entity"], r["root_id"]), {r["root_id"]}).add(r["member_id"])
    got = queries.p5_clusters(spark, data).collect()
    assert {(r["entity"], r["root_id"]): r["size"] for r in got} == {k: len(v) for k, v in members.items()}
    rows = spark.read.parquet(f"{data}/ablation_runs.parquet").collect()
    place = {r["run_id"]: np.array([(r["num_clusters"] or 0) / 3, (r["cluster_confidence_mean"] or 0) / 0.02]) for r in rows}
    runs = [r for r in got if r["entity"] == "run"]
    assert runs
    for r in runs:
        own = sorted(members["run", r["root_id"]])
        assert set(r["typical"]) <= set(own) and len(r["typical"]) == 3
        cost = {a: sum(((place[a] - place[b]) ** 2).sum() for b in own) for a in own}
        assert cost[r["typical"][0]] <= min(cost.values()) + 1e-6


def local(near, min_core):
    def similar(s, e):
        i, j = np.nonzero(near[s:e])
        return i + s, j

    return density.local_clusters(np.arange(len(near)), similar, min_core)


def test_border_points_do_not_join_clusters():
    near = np.eye(6, dtype=bool)
    for a, b in ((0, 1), (0, 2), (2, 3), (3, 4), (3, 5)):
        near[a, b] = near[b, a] = True
    ids, root, core = local(near, 3)
    assert dict(zip(ids.tolist(), zip(root.tolist(), core.tolist()))) == {1: (0, False), 2: (0, True), 3: (0, True), 4: (0, False), 5: (0, False)}
    assert len(local(near, 9)[0]) == 0


def dbscan(near, min_core):
    core = near.sum(axis=1) >= min_core
    label = components(near & core[:, None] & core[None, :] | np.eye(len(near), dtype=bool))
    out = {}
    for i in range(len(near)):
        beside = [label[j] for j in np.flatnonzero(near[i] & core)]
        if beside:
            out[i] = label[i] if core[i] else min(beside)
    members = {}
    for i, c in out.items():
        members.setdefault(c, []).append(i)
    return members


@pytest.mark.parametrize("seed", range(4))
def test_local_clusters_equal_brute_force(monkeypatch, seed):
    r = np.random.default_rng(seed)
    x = r.uniform(0, 1, (120, 2))
    near = ((x[:, None] - x) ** 2).sum(axis=2) <= 0.006
    monkeypatch.setattr(density, "_BLOCK", [4_000_000, 500, 1300, 7000][seed])
    ids, root, core = local(near, 4)
    got = {}
    for i, c in zip(ids.tolist(), root.tolist()):
        got.setdefault(c, {c}).add(i)
    want = {c: set(m) for c, m in dbscan(near, 4).items()}
    # Roots are the least core points here; the least member of all may be a border point.
    assert sorted(map(sorted, got.values())) == sorted(sorted(m) for m in want.values() if len(m) > 1)
    assert all(core[ids == i] for i in ids if near[i].sum() >= 4)


@pytest.mark.parametrize("options", [{}, {"cell_rows": 32}, {"hot_rows": 40, "cell_rows": 64}])
def test_chains_of_sparse_points_are_no_cluster(spark, options):
    r = np.random.default_rng(9)
    turn = np.linspace(0, 1.5, 12)
    chain = np.stack([np.cos(turn), np.sin(turn), *[np.zeros(12)] * 6], axis=1)  # each like its neighbours only
    x = np.concatenate([chain, planted(10, 12, 9), r.normal(size=(60, 8))]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(min(m), i) for m in dbscan(np.round(u @ u.T, 6) >= 0.96, 5).values() for i in m if i != min(m) and len(m) >= 5}
    got = {tuple(v) for v in density.vector_clusters(table(spark, x), "gid", "f", 8, **options).select("root_id", "member_id").collect()}
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(want)


@pytest.mark.parametrize("hot", [60, 200])
def test_a_third_of_all_rows_in_one_ball(spark, hot):
    r = np.random.default_rng(11)
    ball = np.eye(8)[0] + r.normal(size=(400, 8)) * 0.02  # mutually similar, no two equal
    edge = np.eye(8)[0] + np.eye(8)[1] * 0.3 + r.normal(size=(20, 8)) * 0.01  # beside the ball's far side only
    x = np.concatenate([planted(12, 60, 8), ball, edge]).astype(np.float32)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    want = {(min(m), i) for m in dbscan(np.round(u @ u.T, 6) >= 0.96, 5).values() for i in m if i != min(m) and len(m) >= 5}
    got = {tuple(v) for v in density.vector_clusters(table(spark, x), "gid", "f", 8, hot_rows=hot, cell_rows=32).select("root_id", "member_id").collect()}
    assert len(got & want) >= 0.98 * len(want) and len(got - want) <= 0.02 * len(want)


def test_a_dense_cell_needs_little_memory():
    import tracemalloc

    r = np.random.default_rng(12)
    u = codes.unit((np.ones(32) + r.normal(size=(16_384, 32)) * 0.02).astype(np.float32)).astype(np.float32)
    tracemalloc.start()

    def similar(s, e):
        i, j = np.nonzero(u[s:e] @ u.T >= 0.96)
        return i + s, j

    ids, root, core = density.local_clusters(np.arange(len(u)), similar, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(ids) == len(u) - 1 and not root.any() and core.all() and peak < 300e6


def test_neighbours_in_hot_buckets_that_are_no_copies(spark):
    r = np.random.default_rng(13)
    pairs = np.repeat(np.eye(8)[0] + r.normal(size=(150, 8)) * 0.05, 2, axis=0)
    x = pairs + r.normal(size=pairs.shape) * 0.001
    got = {tuple(v) for v in neighbours.as_pairs(neighbours.cosine_neighbours(table(spark, x), "gid", "f", 8, k=1, bucket_rows=32, hot_rows=64)).collect()}
    want = brute(x, list(range(len(x))), 1, 0.96)
    assert len(got & want) >= 0.9 * len(want)


def test_recall_is_counted_against_all_rows(spark):
    x = planted(14, 10, 6)
    df = table(spark, x)
    found = neighbours.cosine_neighbours(df, "gid", "f", 8)
    full = neighbours.neighbour_recall(df, found, "gid", "f", 8, every=5).first()
    assert full["queries"] == 12 and full["pairs"] > 40 and full["recall"] > 0.95
    part = neighbours.neighbour_recall(df, found.filter("b % 2 = 0"), "gid", "f", 8, every=5).first()
    assert part["hits"] == found.filter("a % 5 = 0 and b % 2 = 0").count() and part["pairs"] == full["pairs"]


def test_usable_vectors_and_probes():
    import pyarrow as pa

    at, values = codes.usable_vectors(pa.array([[1.0, 2.0], None, [0.0, 0.0], [1.0], [None, 1.0], [NAN, 1.0]], pa.list_(pa.float32())), 2)
    assert at.tolist() == [0] and values.tolist() == [[1.0, 2.0]]
    rows, found = codes.both_sides(np.array([[0.01, 0.5], [0.5, 0.5]]), 0.1)
    assert sorted(zip(rows.tolist(), found.tolist())) == [(0, 2), (0, 3), (1, 3)]
