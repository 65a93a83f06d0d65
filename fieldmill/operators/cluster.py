"""Clustering of a bounded sample and its extension to all rows: density hierarchy, normalised cuts, merging of small clusters.

The sample size is a parameter with a documented bound; each group's (scene's) sample is clustered in one task. Everything after the
sample (nearest centres, propagation, merging) runs over all rows.
"""

from __future__ import annotations

import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators import graph as g
from fieldmill.operators import knn as kn
from fieldmill.operators import vectors as vc
from fieldmill.operators.labels import dense_labels
from fieldmill.session import cut, partitions

#: Greatest sample: 20 000 rows of 32 doubles are 5 MB.
MOST_SAMPLE = 20_000


def hash_sample(df: DataFrame, key: str, rows: int, seed: str = "0") -> DataFrame:
    """``rows`` rows in the order of a hash of the key: the same at every run, whatever the partitions."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(min(rows, MOST_SAMPLE))


def group_sample(df: DataFrame, key: str, group: str, rows: int, seed: str = "0") -> DataFrame:
    """Up to ``rows`` rows of each group, by the order of ``hash_sample``.

    Rows whose hash is far beyond their group's share are dropped before the sort, so a hot group is not one task's sort.
    """
    rows = min(rows, MOST_SAMPLE)
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_n"))
    hashed = df.withColumn("_h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))))
    near = hashed.join(F.broadcast(sizes), F.col(group).eqNullSafe(F.col("_g")))
    place = F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 2**32
    near = near.filter(place * F.col("_n") <= rows + 10 * rows**0.5 + 100).repartition(partitions(df.sparkSession), group)
    rank = F.row_number().over(Window.partitionBy(group).orderBy("_h", key))
    return near.withColumn("_rank", rank).filter(F.col("_rank") <= rows).select(df.columns)


def merge_small_within(df: DataFrame, key: str, group: str, vec: str, label: str, least: int) -> DataFrame:
    """``merge_small`` in each group by itself (none large in a group: it becomes one cluster); labels go on from group to group."""
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    centres = cut(vc.group_means(df, [group, label], vec).join(counts, [group, label]), "centres")
    large = centres.filter(F.col("n") >= least).select(group, F.col(label).alias("_target"), F.col("centre").alias("_to"))
    pairs = centres.filter(F.col("n") < least).join(large, group, "left")
    rank = F.row_number().over(Window.partitionBy(group, label).orderBy(F.desc(F.round(vc.dot("centre", "_to"), 9)), "_target"))
    moved = pairs.withColumn("_k", rank).filter("_k = 1").select(group, label, F.coalesce("_target", F.lit(0)).alias("_l"))
    named = moved.union(centres.filter(F.col("n") >= least).select(group, label, F.col(label).alias("_l")))
    dense = named.withColumn("_new", (F.dense_rank().over(Window.orderBy(group, "_l")) - 1).cast("bigint")).select(group, label, "_new")
    return df.select(key, group, label).join(F.broadcast(dense), [group, label]).select(key, group, F.col("_new").alias("label"))


def merge_small(df: DataFrame, key: str, vec: str, label: str, least: int) -> DataFrame:
    """Clusters under ``least`` rows join the large one of most similar centre (none large: all become 0); labels are renumbered."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    centres = vc.group_means(df, [label], vec).join(counts, label)
    large = centres.filter(F.col("n") >= least)
    labels, matrix = vc.collect_centres(large, label, "centre")
    if not labels:
        return df.select(key, F.lit(0).cast("bigint").alias("label"))
    small = centres.filter(F.col("n") < least).select(F.col(label).alias("_small"), "centre")
    target = vc.score_centres(small, "_small", "centre", labels, matrix).select("_small", F.col("label").alias("_target"))
    moved = df.select(key, label).join(target, F.col(label) == F.col("_small"), "left").select(key, F.coalesce("_target", label).alias("_l"))
    return dense_labels(moved, "_l", "label", keep_negative=False).select(key, F.col("label").cast("bigint").alias("label"))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a column of equally wide vectors."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-6)


def density_hierarchy(x: np.ndarray, min_size: int = 10, epsilon: float = 0.0) -> np.ndarray:
    """HDBSCAN labels of a matrix (-1: noise): mutual-reachability spanning tree, condensed tree, excess of mass, epsilon merge.

    Euclidean, min_samples = min_size, a single cluster is not allowed. Rows of distances are made one at a time, never all.
    """
    n = len(x)
    if n < max(2, 2 * min_size):
        return np.full(n, -1)
    square = (x * x).sum(axis=1)
    near = min(min_size, n) - 1
    core = np.empty(n)
    for i in range(0, n, 64):
        gaps = (-2 * x[i : i + 64]) @ x.T
        gaps += square
        gaps += square[i : i + 64, None]
        gaps.partition(near, axis=1)
        core[i : i + 64] = np.maximum(gaps[:, near], 0)
    # Squared distances to the points still outside; the arrays are packed whenever half of them are inside.
    out, px, ps, pc = np.arange(n), x, square.copy(), core.copy()
    best, source = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    at, tree, spent = 0, [], 1
    pc[0] = np.inf
    for _ in range(n - 1):
        reach = px @ (-2 * x[at])
        reach += ps
        reach += square[at]
        np.maximum(reach, pc, out=reach)
        np.maximum(reach, core[at], out=reach)
        closer = reach < best
        best[closer], source[closer] = reach[closer], at
        k = int(best.argmin())
        nxt = int(out[k])
        tree.append((float(np.sqrt(best[k])), int(source[k]), nxt))
        best[k] = pc[k] = np.inf
        at, spent = nxt, spent + 1
        if 2 * spent > len(out):
            kept = np.flatnonzero(pc < np.inf)
            out, px, ps, pc, best, source, spent = out[kept], px[kept], ps[kept], pc[kept], best[kept], source[kept], 0
    tree.sort()
    parent = list(range(2 * n - 1))
    size, kids, height = [1] * n + [0] * (n - 1), {}, {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for i, (d, a, b) in enumerate(tree):
        new, left, right = n + i, find(a), find(b)
        kids[new], height[new], size[new] = (left, right), max(d, 1e-12), size[left] + size[right]
        parent[left] = parent[right] = new

    def members(node: int) -> list[int]:
        stack, out = [node], []
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v]
        return out

    # Condensed tree: a cluster goes on along its larger side until both sides are large enough.
    birth, children, stability, points = {}, {}, {}, {}
    stack = [(2 * n - 2, 0, 0.0)]
    count = 1
    birth[0] = 0.0
    while stack:
        node, c, born = stack.pop()
        points[c], stability[c], children[c] = node, 0.0, []
        while True:
            if node < n:
                break
            level = 1 / height[node]
            a, b = kids[node]
            if size[a] >= min_size and size[b] >= min_size:
                stability[c] += (level - born) * size[node]
                for k in (a, b):
                    children[c].append(count)
                    birth[count] = level
                    stack.append((k, count, level))
                    count += 1
                break
            for k in (a, b):
                if size[k] < min_size:
                    stability[c] += (level - born) * size[k]
            bigger = a if size[a] >= size[b] else b
            if size[bigger] < min_size:
                break
            node = bigger
    chosen: dict[int, list[int]] = {}
    for c in sorted(stability, reverse=True):
        below = [x for k in children[c] for x in chosen[k]]
        total = sum(stability[k] for k in below)
        chosen[c] = below if c == 0 or (below and total > stability[c]) else [c]
    final = chosen[0]
    if epsilon > 0:
        up = {k: c for c, ks in children.items() for k in ks}
        raised = set()
        for c in final:
            while c in up and up[c] != 0 and birth[c] > 1 / epsilon:
                c = up[c]
            raised.add(c)
        final = [c for c in raised if not any(a in raised for a in _ancestors(c, up))]
    labels = np.full(n, -1)
    for label, found in enumerate(sorted((members(points[c]) for c in final), key=min)):
        labels[found] = label
    return labels


def _ancestors(c: int, up: dict[int, int]) -> list[int]:
    out = []
    while c in up:
        c = up[c]
        out.append(c)
    return out


def jaccard_distances(members: list[set]) -> np.ndarray:
    """Distances 1 - |a and b| / |a or b| of a bounded list of sets (two empty ones: 0)."""
    n = len(members)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i):
            union = len(members[i] | members[j])
            out[i, j] = out[j, i] = 1 - len(members[i] & members[j]) / union if union else 0.0
    return out


def density_clusters(df: DataFrame, key: str, vec: str, sample_rows: int = MOST_SAMPLE, min_size: int = 10, epsilon: float = 0.01, group: str | None = None) -> DataFrame:
    """``key``, ``label``, ``conf`` of all rows: density clusters of a sample, then every row to the nearest cluster mean (noise too).

    Vectors are equally wide. With ``group`` each group has a sample and clusters of its own (labels go on from group to group); a group is one task's hierarchy.
    No cluster found: all -1 with confidence 0. Confidence is the cosine, moved to 0..1. Null vectors have no label.
    """
    spark = df.sparkSession
    known = df.filter(F.col(vec).isNotNull()).select(key, (F.col(group).cast("bigint") if group else F.lit(0).cast("bigint")).alias("grp"), F.col(vec).alias("u"))
    known = cut(known, "vectors")

    def means(table: pa.Table) -> pa.Table:
        table = table.sort_by(key)
        x = _matrix(table.column("u").combine_chunks())
        labels = density_hierarchy(x, min_size, epsilon)
        found = np.unique(labels[labels >= 0])
        centres = [x[labels == k].mean(axis=0) for k in found]
        centres = [c / max(np.linalg.norm(c), 1e-6) for c in centres]
        grp = table.column("grp").combine_chunks().take(pa.array(np.zeros(len(found), dtype=np.int64)))
        return pa.table({"grp": grp, "label": pa.array(found, pa.int64()), "centre": pa.array([c.tolist() for c in centres], pa.list_(pa.float64()))})

    sample = group_sample(known, key, "grp", sample_rows).repartition(partitions(spark), "grp")
    rows = sample.groupBy("grp").applyInArrow(means, "grp bigint, label bigint, centre array<double>").collect()
    rows.sort(key=lambda r: (r["grp"] is not None, r["grp"], r["label"]))
    first, matrices = {}, {}
    for i, r in enumerate(rows):
        first.setdefault(r["grp"], i)
        matrices.setdefault(r["grp"], []).append(r["centre"])
    matrices = {g: np.array(m) for g, m in matrices.items()}
    kind = known.schema[key].dataType.simpleString()

    def nearest(batches):
        for batch in batches:
            for part in (batch.slice(i, 4096) for i in range(0, len(batch), 4096)):
                groups, vectors = np.array(part.column(1).to_pylist(), dtype=object), _matrix(part.column(2))
                label, conf = np.full(len(part), -1, dtype=np.int64), np.zeros(len(part))
                for g in set(groups.tolist()) & set(matrices):
                    at = np.flatnonzero(np.equal(groups, g))
                    scores = vectors[at] @ matrices[g].T
                    best = np.round(scores, 9).argmax(axis=1)
                    label[at], conf[at] = first[g] + best, (scores[np.arange(len(at)), best] + 1) / 2
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label), pa.array(conf)], [key, "label", "conf"])

    return known.mapInArrow(nearest, f"`{key}` {kind}, label bigint, conf double")


#: A weighted graph: number of nodes, both ends and weight of each edge (both ways).
Graph = tuple[int, np.ndarray, np.ndarray, np.ndarray]


def _graph(w: np.ndarray | Graph) -> Graph:
    if isinstance(w, tuple):
        return w
    i, j = np.nonzero(w)
    return len(w), i, j, w[i, j]


def _part(graph: Graph, nodes: np.ndarray) -> Graph:
    n, i, j, w = graph
    place = np.full(n, -1)
    place[nodes] = np.arange(len(nodes))
    kept = (place[i] >= 0) & (place[j] >= 0)
    return len(nodes), place[i[kept]], place[j[kept]], w[kept]


def _leading(apply, first: np.ndarray, tol: float = 1e-8, width: int = 64, keep: int = 8, rounds: int = 150) -> np.ndarray | None:
    """The leading eigenvector of a symmetric map besides the known ``first``: Lanczos with restarts from its ``keep`` best directions.

    Not within 1e-3 (the reference's tolerance) after all rounds: None.
    """
    n = len(first)
    q, a = np.zeros((width + 1, n)), np.zeros((width, n))
    start = np.random.default_rng(0).normal(size=n)  # has a share of every direction, smooth ones too
    start -= first * (first @ start)
    q[0], have = start / np.linalg.norm(start), 0
    for _ in range(rounds):
        m, closed = width, False
        for k in range(have, width):
            a[k] = apply(q[k])
            a[k] -= first * (first @ a[k])
            rest = a[k].copy()
            for _ in range(2):
                rest -= first * (first @ rest)
                rest -= (q[: k + 1] @ rest) @ q[: k + 1]
            length = np.linalg.norm(rest)
            if length < 1e-12:
                m, closed = k + 1, True
                break
            q[k + 1] = rest / length
        t = q[:m] @ a[:m].T
        values, s = np.linalg.eigh((t + t.T) / 2)
        best = s[:, -1] @ q[:m]
        error = np.linalg.norm(s[:, -1] @ a[:m] - values[-1] * best)
        if closed or error <= tol:
            return best
        top = s[:, -keep:].T
        q[:keep], a[:keep], q[keep] = top @ q[:m], top @ a[:m], q[m]
        have = keep
    return best if error <= 1e-3 else None


def _fiedler(graph: Graph) -> np.ndarray | None:
    n, i, j, w = graph
    degree = np.bincount(i, weights=w, minlength=n)
    if (degree > 1e-8).sum() < 2:
        return None
    d = 1 / np.sqrt(np.maximum(degree, 1e-8))
    scaled = w * d[i] * d[j]
    try:
        if n <= 256:
            dense = np.eye(n)
            np.subtract.at(dense, (i, j), scaled)
            vector = np.linalg.eigh(dense)[1][:, 1]
        else:  # the shifted matrix, on its edges only
            first = np.sqrt(np.maximum(degree, 1e-8))
            vector = _leading(lambda x: x + np.bincount(i, weights=scaled * x[j], minlength=n), first / np.linalg.norm(first))
    except np.linalg.LinAlgError:
        return None
    if vector is None:
        return None
    lead = np.flatnonzero(np.abs(vector) > 1e-12)
    return vector * np.sign(vector[lead[0]]) if len(lead) else vector


def _components(graph: Graph) -> np.ndarray:
    n, i, j, w = graph
    i, j = i[w > 0], j[w > 0]
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sweep_scores(graph: Graph, value: np.ndarray, thresholds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Normalised cut and left size of each cut ``value <= threshold``: the weights are summed along the nodes in the order of ``value``
    once, and every cut is a difference of these running totals. A side without weight makes the score infinite."""
    n, i, j, w = graph
    place = np.empty(n, np.int64)
    place[np.argsort(value, kind="stable")] = np.arange(n)
    size = np.searchsorted(np.sort(value), thresholds, side="right")

    def upto(where: np.ndarray) -> np.ndarray:
        return np.append(0.0, np.cumsum(np.bincount(where, weights=w, minlength=n)))[size]

    left = upto(place[i])
    across = left - upto(np.maximum(place[i], place[j]))
    right = w.sum() - left
    with np.errstate(divide="ignore", invalid="ignore"):
        score = np.where((left > 1e-8) & (right > 1e-8), across / left + across / right, np.inf)
    return score, size


def best_split(graph: Graph, least: int, limit: float) -> tuple[float, np.ndarray] | None:
    """(score, which nodes are left) of the best split into two sides of ``least`` nodes or more with a score up to ``limit``; None: there
    is none. An unconnected graph is split at score 0, its largest component from the rest; else cuts of the second eigenvector at its
    quartiles and at 0 are tried."""
    n = graph[0]
    if n < max(4, 2 * least):
        return None
    root, size = np.unique(_components(graph), return_inverse=True, return_counts=True)[1:]
    if len(size) > 1:
        left = root == size.argmax()
        return (0.0, left) if least <= left.sum() <= n - least else None
    vector = _fiedler(graph)
    if vector is None:
        return None
    tried = np.unique(np.append(np.quantile(vector, (0.25, 0.5, 0.75)), 0.0))
    score, size = sweep_scores(graph, vector, tried)
    score[(size < least) | (n - size < least)] = np.inf
    k = int(score.argmin())
    return (float(score[k]), vector <= tried[k]) if score[k] <= limit else None


def recursive_cut(w: np.ndarray | Graph, max_clusters: int = 24, min_size: int = 128, limit: float = 0.12) -> np.ndarray:
    """Labels by splitting, again and again, the cluster whose best split has the least score; larger clusters get smaller labels."""
    graph = _graph(w)
    final: list[np.ndarray] = []
    queue: list[tuple[float, int, np.ndarray, np.ndarray]] = []  # score, age, nodes, which are left
    age = itertools.count()

    def enter(nodes: np.ndarray) -> None:
        split = best_split(_part(graph, nodes), min_size, limit)
        if split:
            heapq.heappush(queue, (split[0], next(age), nodes, split[1]))
        else:
            final.append(nodes)

    enter(np.arange(graph[0]))
    while queue and len(queue) + len(final) < max_clusters:
        _, _, nodes, left = heapq.heappop(queue)
        enter(nodes[left])
        enter(nodes[~left])
    clusters = final + [entry[2] for entry in queue]
    labels = np.full(graph[0], -1)
    for label, nodes in enumerate(sorted((c for c in clusters if len(c)), key=lambda c: (-len(c), c[0]))):
        labels[nodes] = label
    return labels


def cut_clusters(points: DataFrame, key: str, group: str, axes: list[str], vec: str, sample_rows: int = MOST_SAMPLE, k: int = 16, max_clusters: int = 24, min_size: int = 128, limit: float = 0.12) -> DataFrame:
    """``key``, ``label``, ``conf`` of all rows, each group (scene) by itself: affinity graph of a sample, recursive normalised cuts, small
    clusters merged, labels propagated to all rows by neighbour votes, small ones merged again. Labels go on from group to group.

    A group's graph is cut in one task, on its edges (``sample_rows`` times 2 k at most). Rows with a null group or coordinate have no label.
    """
    spark = points.sparkSession
    known = cut(points.select(F.col(key).cast("bigint").alias(key), F.col(group).cast("bigint").alias("grp"), *axes, vc.normalise(vec).alias("u")), "points")
    sample = cut(group_sample(known, key, "grp", sample_rows), "sample")
    near = cut(kn.knn_join(sample, sample, k, key, axes, "grp"), "near")
    edges = g.affinity_edges(near, sample, key, "u")
    edges = g.meet(edges, sample.select(F.col(key).alias("src"), "grp"), "src")

    def cuts(nodes: pa.Table, links: pa.Table) -> pa.Table:
        ids = np.sort(nodes.column(key).to_numpy())
        i, j = (np.searchsorted(ids, links.column(c).to_numpy()) for c in ("src", "dst"))
        order = np.lexsort((j, i))
        labels = recursive_cut((len(ids), i[order], j[order], links.column("w").to_numpy()[order]), max_clusters, min_size, limit)
        grp = pa.array(np.full(len(ids), nodes.column("grp")[0].as_py() if len(ids) else 0, dtype=np.int64))
        return pa.table({"grp": grp, key: pa.array(ids), "label": pa.array(labels, pa.int64())})

    tasks = partitions(spark)
    nodes = sample.select("grp", key).repartition(tasks, "grp").groupBy("grp")
    links = edges.select("grp", "src", "dst", "w").repartition(tasks, "grp").groupBy("grp")
    named = cut(nodes.cogroup(links).applyInArrow(cuts, f"grp bigint, `{key}` bigint, label bigint"), "cuts")
    merged = merge_small_within(g.meet(sample, named.select(key, "label"), key), key, "grp", "u", "label", min_size)
    refs = cut(g.meet(sample, merged.select(key, "label"), key), "refs")
    near = cut(kn.knn_join(known, refs, k, key, axes, "grp", exclude_self=False), "near")
    votes = cut(g.propagate(near, known, refs, key, "u", "label").withColumnRenamed("src", key).select(key, "label", "share"), "votes")
    final = merge_small_within(g.meet(known, votes.select(key, "label"), key), key, "grp", "u", "label", min_size)
    return g.meet(final, votes.select(key, F.col("share").alias("conf")), key).select(key, "label", "conf")
