"""Affinity graphs, smoothing, cuts and residue rules over neighbour tables (grp, src, dst, rank, dist)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldmill.operators.components import connected_components
from fieldmill.operators.vectors import dot, group_means, normalise, vote
from fieldmill.session import cut, discard


def meet(a: DataFrame, b: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A merge join: both sides grow with the points. Spark judges a table by its compressed file and a vector as one number, so under the usual
    threshold of 10 MB it would send hundreds of thousands of rows through the driver."""
    return a.join(b.hint("merge"), on, how)


def local_scale(knn: DataFrame, first: int = 4, least: float = 1e-3) -> DataFrame:
    """``scale`` of each point: the median of its first distances, but never below its group's median of these (nor below ``least``)."""
    local = knn.filter(F.col("rank") <= first).groupBy("grp", "src").agg(F.median("dist").alias("m"))
    base = local.filter("m > 0").groupBy("grp").agg(F.median("m").alias("b"))
    floor = F.greatest(F.coalesce("b", F.lit(least)), F.lit(least))
    return local.join(base, "grp", "left").select("grp", "src", F.greatest(F.when(F.col("m") > 0, F.col("m")).otherwise(floor), floor).alias("scale"))


def colour_weight(a: Column, b: Column, weight: float, sigma: float) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x - y)
    return F.exp(-weight * dot(gap, gap) / max(2 * sigma * sigma, 1e-6))


def spatial_terms(knn: DataFrame, scale: float = 2.5, weight: float = 1.0, both: bool = True) -> DataFrame:
    """``spatial``: exp(-weight/2 (d / sigma)^2) with sigma from the local scales of both ends (or of the source's only)."""
    local = local_scale(knn)
    near = meet(knn, local.select("src", F.col("scale").alias("s0")), "src")
    if both:
        near = meet(near, local.select(F.col("src").alias("dst"), F.col("scale").alias("s1")), "dst")
        sigma = F.greatest("s0", "s1", F.lit(1e-3)) * scale
    else:
        sigma = F.greatest(F.col("s0") * scale, F.lit(1e-3))
    ratio = F.col("dist") / sigma
    return near.select("grp", "src", "dst", "rank", "dist", F.exp(-0.5 * weight * ratio * ratio).alias("spatial"))


def symmetric(edges: DataFrame) -> DataFrame:
    """Both directions of each edge with the greater weight."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    return edges.select("src", "dst", "w").union(back).groupBy("src", "dst").agg(F.max("w").alias("w"))


def affinity_edges(knn: DataFrame, features: DataFrame, key: str, vec: str, temperature: float = 0.2, scale: float = 2.5, colour: float = 0.0, sigma: float = 0.25, boost: Column | None = None) -> DataFrame:
    """``src``, ``dst``, ``w`` both ways: spatial times feature (times colour, times mesh boost) affinity; weights up to 1e-6 are dropped.

    ``features``: a vector a point, made unit here (the colour term takes it as it is). ``boost`` may use src and dst.
    """
    f = features.select(F.col(key).alias("k"), F.col(vec).alias("raw"), normalise(vec).alias("u"))
    near = meet(spatial_terms(knn, scale), f.select(F.col("k").alias("src"), F.col("raw").alias("ra"), F.col("u").alias("ua")), "src")
    near = meet(near, f.select(F.col("k").alias("dst"), F.col("raw").alias("rb"), F.col("u").alias("ub")), "dst")
    likeness = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("ua", "ub")))
    w = F.col("spatial") * F.exp((likeness - 1) / temperature)
    w = w * colour_weight(F.col("ra"), F.col("rb"), colour, sigma) if colour > 0 else w
    w = w * boost if boost is not None else w
    return symmetric(near.select("src", "dst", w.alias("w")).filter("w > 1e-6"))


def mesh_adjacency(faces: DataFrame, corners: list[str]) -> DataFrame:
    """Vertex pairs (u, v) that share a face edge, both ways, and each vertex with itself."""
    a, b, c = (F.col(x) for x in corners)
    pairs = F.array(*(F.struct(x.alias("u"), y.alias("v")) for x, y in ((a, b), (b, a), (b, c), (c, b), (c, a), (a, c), (a, a), (b, b), (c, c))))
    return faces.select(F.explode(pairs).alias("e")).select("e.u", "e.v").distinct()


def knn_edges(knn: DataFrame) -> DataFrame:
    """Unweighted neighbour pairs, each once, smaller id first."""
    return knn.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def adaptive_edges(knn: DataFrame, factor: float = 2.5) -> DataFrame:
    """Neighbour pairs no farther apart than ``factor`` times the greater local scale of their ends."""
    local = local_scale(knn).select("src", "scale")
    near = meet(meet(knn, local.withColumnRenamed("scale", "s0"), "src"), local.select(F.col("src").alias("dst"), F.col("scale").alias("s1")), "dst")
    return knn_edges(near.filter(F.col("dist") <= factor * F.greatest("s0", "s1")))


def components_of(points: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """``component`` of every point; those without an edge are their own."""
    found = connected_components(edges, "a", "b").select(F.col("node").alias(key), "component")
    return meet(points, found, key, "left").withColumn("component", F.coalesce("component", key))


def split_residue(parts: DataFrame, group: str, most: int = 1000) -> DataFrame:
    """``visible``: the largest component of each group (ties: least id) always, others only above ``most`` rows."""
    sizes = parts.groupBy(group, "component").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "component"))
    shown = sizes.withColumn("visible", (rank == 1) | (F.col("n") > most)).select(group, "component", "visible")
    return meet(parts, shown, [group, "component"])


def cut_score(edges: DataFrame, sides: DataFrame, key: str, side: str) -> DataFrame:
    """Normalised cut of a two-sided split per group of ``sides`` (grp, key, side boolean): null where a side has no weight."""
    a = sides.select("grp", F.col(key).alias("src"), F.col(side).alias("sa"))
    b = sides.select(F.col(key).alias("dst"), F.col(side).alias("sb"))
    both = meet(meet(edges, a, "src"), b, "dst")
    crossing = F.sum(F.when(F.col("sa") & ~F.col("sb"), F.col("w")).otherwise(0.0))
    left, right = (F.sum(F.when(F.col("sa") == x, F.col("w")).otherwise(0.0)) for x in (True, False))
    rows = both.groupBy("grp").agg(crossing.alias("cut"), left.alias("l"), right.alias("r"))
    return rows.select("grp", F.when((F.col("l") > 1e-8) & (F.col("r") > 1e-8), F.col("cut") / F.col("l") + F.col("cut") / F.col("r")).alias("score"))


def propagate(knn: DataFrame, queries: DataFrame, refs: DataFrame, key: str, vec: str, label: str, temperature: float = 0.2, scale: float = 2.5) -> DataFrame:
    """``label``, ``share`` of each query by its neighbours' votes: feature times spatial affinity; a reference votes for itself too."""
    q = queries.select(F.col(key).alias("src"), normalise(vec).alias("ua"))
    r = refs.select(F.col(key).alias("dst"), normalise(vec).alias("ub"), F.col(label).alias("label"))
    near = meet(meet(spatial_terms(knn, scale, both=False), q, "src"), r, "dst")
    likeness = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot("ua", "ub")))
    return vote(near.withColumn("w", F.col("spatial") * F.exp((likeness - 1) / temperature)), ["src"], "label", "w")


def smooth(knn: DataFrame, features: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Mean of the unit features of each point and its ``k`` nearest others."""
    f = features.select(F.col(key).alias("dst"), normalise(vec).alias("u"))
    near = knn.filter(F.col("rank") <= k).select("src", "dst").union(features.select(F.col(key).alias("src"), F.col(key).alias("dst")))
    return group_means(meet(near, f, "dst"), ["src"], "u", unit=False).withColumnRenamed("centre", "smoothed")


def smooth_part(knn: DataFrame, features: DataFrame, key: str, vec: str, k: int, dims: int) -> DataFrame:
    """Only the first ``dims`` components smoothed, the others as they are (unit)."""
    own = features.select(F.col(key).alias("src"), normalise(vec).alias("u"), F.size(vec).alias("n"))
    return meet(smooth(knn, features, key, vec, k), own, "src").select("src", F.concat(F.slice("smoothed", 1, dims), F.slice("u", F.lit(dims + 1), F.greatest(F.col("n") - dims, F.lit(0)))).alias("smoothed"))


def laplacian_energy(knn: DataFrame, features: DataFrame, key: str, vec: str, first: int = 4) -> DataFrame:
    """Graph energy a group: mean over points of the row-normalised, affinity-weighted squared feature differences to neighbours."""
    f = features.select(F.col(key).alias("k"), normalise(vec).alias("u"))
    local = knn.filter(F.col("rank") <= first).groupBy("src").agg(F.greatest(F.avg(F.col("dist") * F.col("dist")), F.lit(1e-6)).alias("s2"))
    near = meet(meet(knn, local, "src"), f.select(F.col("k").alias("src"), F.col("u").alias("ua")), "src")
    near = meet(near, f.select(F.col("k").alias("dst"), F.col("u").alias("ub")), "dst")
    gap = F.zip_with("ua", "ub", lambda x, y: x - y)
    w = F.exp(-F.col("dist") * F.col("dist") / F.greatest(2 * F.col("s2"), F.lit(1e-6))) * F.greatest((dot("ua", "ub") + 1) * 0.5, F.lit(0.0))
    rows = near.select("grp", "src", w.alias("w"), dot(gap, gap).alias("d2")).groupBy("grp", "src").agg((F.sum(F.col("w") * F.col("d2")) / F.greatest(F.sum("w"), F.lit(1e-6))).alias("e"))
    return rows.groupBy("grp").agg(F.avg("e").alias("energy"))


def contact_scores(near: DataFrame, residue: DataFrame, core: DataFrame) -> DataFrame:
    """``component``, ``target``, ``t``, ``sp``, ``contact``: edges from residue rows (src, component) to core rows (src, label) of each
    label, their mean spatial term, and their share among the component's edges to core rows."""
    ends = core.select(F.col("src").alias("dst"), F.col("label").alias("target"))
    totals = meet(meet(near, residue, "src"), ends, "dst").groupBy("component", "target").agg(F.count("*").alias("t"), F.avg("spatial").alias("sp"))
    return totals.withColumn("contact", F.col("t") / F.sum("t").over(Window.partitionBy("component")))


def refine_labels(points: DataFrame, knn: DataFrame, key: str, vec: str, min_size: int = 128, min_conf: float = 0.6, min_score: float = 0.15, min_margin: float = 0.05) -> DataFrame:
    """Labels after residue refinement (grp, key, label, conf): components of each label on the neighbour graph; the largest is its core.
    Others that are small or unsure go to the core label they touch best, by contact, centre likeness and closeness, or become -1.

    Core labels never change and only core rows attract, so one pass over all residue components gives what a loop would.
    """
    p = points.select("grp", F.col(key).alias("src"), F.col(vec).alias("vec"), "label", "conf").withColumn("u", normalise("vec"))
    lab = p.select("src", "label")
    inner = meet(meet(knn_edges(knn), lab.select(F.col("src").alias("a"), F.col("label").alias("la")), "a"), lab.select(F.col("src").alias("b"), F.col("label").alias("lb")), "b").filter("la = lb and la >= 0")
    parts = cut(components_of(p.drop("vec").withColumnRenamed("src", "id"), "id", inner.select("a", "b")).withColumnRenamed("id", "src"), "parts")
    sizes = parts.filter("label >= 0").groupBy("grp", "label", "component").agg(F.count("*").alias("n"), F.avg("conf").alias("c"))
    rank = F.row_number().over(Window.partitionBy("grp", "label").orderBy(F.desc("n"), "component"))
    kinds = sizes.withColumn("core", rank == 1).withColumn("residue", ~F.col("core") & ((F.col("n") < min_size) | (F.col("c") < min_conf)))
    rows = meet(parts, kinds.select("grp", "label", "component", "core", "residue"), ["grp", "label", "component"], "left")
    rows = cut(rows.withColumn("core", F.coalesce("core", F.lit(False))).withColumn("residue", F.coalesce("residue", F.lit(False))), "rows")  # read five times
    discard(parts)
    totals = contact_scores(spatial_terms(knn), rows.filter("residue").select("src", "component"), rows.filter("core").select("src", "label"))
    centres = group_means(rows.filter("core"), ["grp", "label"], "u").select("grp", F.col("label").alias("target"), F.col("centre").alias("cc"))
    own = group_means(rows.filter("residue"), ["grp", "component"], "u").select("grp", "component", F.col("centre").alias("rc"))
    scored = meet(totals, own, "component").join(centres, ["grp", "target"])
    like = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (dot("rc", "cc") + 1) * 0.5))
    scored = scored.withColumn("score", F.round(0.45 * F.col("contact") + 0.35 * like + 0.2 * F.col("sp"), 9))
    order = Window.partitionBy("component").orderBy(F.desc("score"), "target")
    best = scored.withColumn("k", F.row_number().over(order)).withColumn("second", F.coalesce(F.lead("score").over(order), F.lit(0.0))).filter("k = 1")
    best = best.filter((F.col("score") >= min_score) & (F.col("score") - F.col("second") >= min_margin)).select("component", "target", "score")
    joined = meet(rows, best, "component", "left")
    return joined.select(
        "grp", F.col("src").alias(key),
        F.when(F.col("residue"), F.coalesce("target", F.lit(-1))).otherwise(F.col("label")).alias("label"),
        F.when(F.col("residue"), F.coalesce("score", F.lit(0.0))).otherwise(F.col("conf")).alias("conf"),
    )


def initial_splats(points: DataFrame, knn: DataFrame, key: str, colours: list[str], rest: int = 45) -> DataFrame:
    """Splat columns of a plain point cloud: scales from the distance to the three nearest, opacity 0.1, no rotation, base colours."""
    from fieldmill.functions.geometry import colour_base
    from fieldmill.operators.knn import mean_square_distance

    d2 = mean_square_distance(knn).select(F.col("src").alias(key), "d2")
    scale = F.log(F.sqrt(F.greatest(F.coalesce("d2", F.lit(1e-7)), F.lit(1e-7))))
    dc = F.array(*(colour_base(F.col(c) / 255) for c in colours))
    return meet(points, d2, key, "left").select(key, dc.alias("f_dc"), F.array_repeat(F.lit(0.0), rest).alias("f_rest"), F.array_repeat(scale, 3).alias("scale"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))).alias("rot"), F.log(F.lit(0.1 / 0.9)).alias("opacity"))


def multi_resolution(smoothed: list[tuple[DataFrame, float]]) -> DataFrame:
    """Weighted sum of several smoothings (src, smoothed) of the same points."""
    out = smoothed[0][0].select("src", F.transform("smoothed", lambda x: x * smoothed[0][1]).alias("smoothed"))
    for df, w in smoothed[1:]:
        out = meet(out, df.select("src", F.col("smoothed").alias("_more")), "src").select("src", F.zip_with("smoothed", "_more", lambda a, b: a + b * w).alias("smoothed"))
    return out


def subset_smoothing(points: DataFrame, features: DataFrame, key: str, group: str, axes: list[str], vec: str, plan: list[tuple[float, int, float]], seed: str = "e") -> DataFrame:
    """``src``, ``smoothed``: weighted sum, over ``plan`` (share, k, weight), of the mean unit feature of each point's ``k`` nearest points in a
    random subset of that share (by a hash of the key, the same at every run; 1 and more is all). A point in the subset is its own nearest.
    """
    from fieldmill.operators.knn import knn_join

    f = features.select(F.col(key).alias("dst"), normalise(vec).alias("u"))
    place = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    parts = []
    for share, k, weight in plan:
        near = knn_join(points, points.filter(place < share), k, key, axes, group, exclude_self=False)
        mean = group_means(meet(near.select("src", "dst"), f, "dst"), ["src"], "u", unit=False)
        parts.append((mean.withColumnRenamed("centre", "smoothed"), weight))
    return multi_resolution(parts)


def jaccard_pairs(df: DataFrame, item: str, member: str) -> DataFrame:
    """``a`` < ``b``, ``distance``: Jaccard distance of items that share a member, by an inverted index; all other pairs are at 1."""
    rows = df.select(item, member).distinct()
    sizes = rows.groupBy(item).agg(F.count("*").alias("n"))
    a, b = rows.select(member, F.col(item).alias("a")), rows.select(member, F.col(item).alias("b"))
    both = a.join(b, member).filter("a < b").groupBy("a", "b").agg(F.count("*").alias("c"))
    both = both.join(sizes.select(F.col(item).alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col(item).alias("b"), F.col("n").alias("nb")), "b")
    return both.select("a", "b", (1 - F.col("c") / (F.col("na") + F.col("nb") - F.col("c"))).alias("distance"))


def label_codes(labels: DataFrame, label: str, width: int = 32) -> DataFrame:
    """``code``: +-1 values of a label from bits of its hash, the same at every run (see ``decode_labels``)."""
    bit = lambda i: F.pmod(F.xxhash64(F.col(label), i), F.lit(2)).cast("double") * 2 - 1
    return labels.select(label, F.transform(F.sequence(F.lit(0), F.lit(width - 1)), bit).alias("code"))


def decode_labels(coded: DataFrame, key: str, vec: str, labels: DataFrame, label: str, width: int = 32) -> DataFrame:
    """``key``, ``label``: the label whose code is most like the vector (least label of equals); -1 for vectors no longer than 1e-6."""
    from fieldmill.operators.vectors import nearest_centre, norm

    there = coded.filter(norm(vec) > 1e-6)
    found = nearest_centre(there, key, vec, label_codes(labels, label, width), label, "code").select(key, F.col("label"))
    return coded.select(key).join(found, key, "left").select(key, F.coalesce("label", F.lit(-1)).cast("bigint").alias("label"))
