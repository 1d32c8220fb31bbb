"""Spatial neighbours, scan statistic, majority smoothing and components."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.tables import scratch

KEEP = (4, 9)  # fixed value: a unit keeps its label if its own share is at least 4 of 9


def materialised(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder and read back, so that a loop's lineage stays short."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def grid_neighbours(cells: DataFrame, unit: str, eight: bool = True) -> DataFrame:
    """(src, dst) of cells (unit, row, col) side by side, or also corner to corner; an equi-join on cell ids."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0) and (eight or not i or not j)]
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in steps]))
    a = cells.select(F.col(unit).alias("src"), "row", "col", at.alias("s")).select("src", (F.col("row") + F.col("s.i")).alias("row"), (F.col("col") + F.col("s.j")).alias("col"))
    return a.join(cells.select(F.col(unit).alias("dst"), "row", "col"), ["row", "col"]).select("src", "dst")


def shared_boundaries(segments: DataFrame, unit: str) -> DataFrame:
    """(src, dst) of units with a boundary segment (x1, y1, x2, y2) in common; segments count in either direction."""
    a, b = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))
    s = segments.select(F.col(unit).alias("u"), F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).distinct()
    return s.select(F.col("u").alias("src"), "p", "q").join(s.select(F.col("u").alias("dst"), "p", "q"), ["p", "q"]).where("src <> dst").select("src", "dst").distinct()


def distance_neighbours(points: DataFrame, threshold: float, unit: str = "unit", x: str = "lat", y: str = "lon") -> DataFrame:
    """(src, dst) of distinct points within the threshold; points meet by the grid cells around theirs."""
    cell = lambda c: F.floor(F.col(c) / threshold)
    a = points.select(F.col(unit).alias("src"), F.col(x).alias("x1"), F.col(y).alias("y1"), cell(x).alias("i"), cell(y).alias("j"))
    b = points.select(F.col(unit).alias("dst"), F.col(x).alias("x2"), F.col(y).alias("y2"), F.explode(F.sequence(cell(x) - 1, cell(x) + 1)).alias("i"), cell(y).alias("j0"))
    b = b.select("dst", "x2", "y2", "i", F.explode(F.sequence(F.col("j0") - 1, F.col("j0") + 1)).alias("j"))
    d = F.sqrt((F.col("x1") - F.col("x2")) ** 2 + (F.col("y1") - F.col("y2")) ** 2)
    return a.join(b, ["i", "j"]).where((d <= threshold) & (d > 0)).select("src", "dst")


def adjacency_report(edges: DataFrame, nodes: DataFrame, node: str = "unit") -> DataFrame:
    """n, isolated, least, most and mean neighbours, and edges without their reverse."""
    deg = nodes.select(F.col(node).alias("u")).join(edges.groupBy(F.col("src").alias("u")).agg(F.count(F.lit(1)).alias("k")), "u", "left").select(F.coalesce("k", F.lit(0)).alias("k"))
    one_way = edges.join(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), ["src", "dst"], "left_anti").agg(F.count(F.lit(1)).alias("asymmetric"))
    s = deg.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("k") == 0).cast("bigint")).alias("isolated"), F.min("k").alias("least"), F.max("k").alias("most"), F.round(F.avg("k"), 6).alias("mean"))
    return s.join(F.broadcast(one_way), F.lit(True))  # one row each


def graph_report(edges: DataFrame, n: int) -> DataFrame:
    """Entries, density, sparsity and weighted degree of an edge table (src, dst, weight)."""
    e = edges.agg(F.count(F.lit(1)).alias("nnz"), F.round(F.sum("weight"), 6).alias("weight"))
    return e.select("nnz", (F.col("nnz") / F.lit(float(n * max(1, n - 1)))).alias("density"), (1 - F.col("nnz") / F.lit(float(n * n))).alias("sparsity"), F.round(F.col("weight") / n, 6).alias("mean_weighted_degree"))


def observed_expected(df: DataFrame, group: str, y: str = "y", p: str = "p") -> DataFrame:
    """(group, base, correct, c, b): misses c of each group and the misses b expected from its share of positives."""
    g = df.groupBy(group).agg(F.sum((F.col(y) == 1).cast("bigint")).alias("base"), F.sum(((F.col(y) == 1) & (F.col(p) == 1)).cast("bigint")).alias("correct"))
    whole = Window.partitionBy(F.lit(1))  # as many rows as groups
    c = F.col("base") - F.col("correct")
    b = F.coalesce(F.try_divide((F.sum(c).over(whole) * F.col("base")).cast("double"), F.sum("base").over(whole)), F.lit(0.0))
    return g.select(group, "base", "correct", c.cast("double").alias("c"), b.alias("b"))


def top_half(df: DataFrame, key: str, score: str, flex: float = 0.1) -> DataFrame:
    """(key, side): side 0 holds the better half by score; within ``flex`` of half, it ends where scores fall to 0."""
    r = df.select(key, score, F.row_number().over(Window.orderBy(F.desc(score), key)).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))
    half = F.ceil(F.col("n") / 2)
    lo, hi = F.ceil(half * F.lit(1 - flex)), F.ceil(half * F.lit(1 + flex))
    stop = F.min(F.when((F.col("k") > lo) & (F.col("k") <= F.least(hi, F.col("n"))) & (F.col(score) <= 0), F.col("k") - 1)).over(Window.partitionBy(F.lit(1)))
    size = F.greatest(F.coalesce(stop, half), F.lit(1))
    return r.select(key, F.when(F.col("k") <= size, 0).otherwise(1).alias("side"))


def scan_scores(cb: DataFrame, key: str, q: float) -> DataFrame:
    """Poisson log-likelihood ratio of each group at relative risk q."""
    g = F.col("c") * F.lit(math.log(q)) + F.col("b") * F.lit(1 - q) if q > 0 else F.lit(0.0)
    return cb.select(key, "c", "b", g.alias("score"))


def scan_start(cb: DataFrame) -> float:
    """Risk of the quarter of the groups with the most misses for what is expected."""
    r = cb.select("c", "b", F.row_number().over(Window.orderBy(F.desc(F.coalesce(F.try_divide("c", "b"), F.lit(0.0))), F.desc("c"))).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(F.lit(1))).alias("n"))
    return _risk(r.where(F.col("k") <= F.ceil(F.col("n") / 4)).agg(F.sum("c").alias("c"), F.sum("b").alias("b")).first())


def _risk(s) -> float:
    q = s["c"] / s["b"] if s and s["b"] else 0.0
    return q if q and q > 0 else 1.0


def scan(cb: DataFrame, key: str, rounds: int = 50, flex: float = 0.1) -> DataFrame:
    """Bi-partition of groups (key, c, b) by a scan statistic: score, take the better half, refit the risk, to a fixed point.

    A frontier table has a row for each group, so each round is one small job.
    """
    q, sides = scan_start(cb), None
    for _ in range(rounds):
        scored = scan_scores(cb, key, q)
        sides = top_half(scored, key, "score", flex)
        joined = scored.join(sides, key)
        new = _risk(joined.where("side = 0").agg(F.sum("c").alias("c"), F.sum("b").alias("b")).first())
        if abs(new - q) < 1e-12:
            break
        q = new
    return scan_scores(cb, key, q).join(sides, key).select(key, "side", "score")


def majority_sweep(labels: DataFrame, edges: DataFrame, unit: str = "unit", label: str = "label") -> DataFrame:
    """One synchronous round: a unit whose own label has under 4/9 of its neighbourhood (itself included) takes the most frequent other label, the lowest on ties. Isolated and negative ones stay."""
    votes = edges.select(F.col("src").alias(unit), F.col("dst")).join(labels.select(F.col(unit).alias("dst"), F.col(label).alias("vote")), "dst").where("vote >= 0")
    votes = votes.groupBy(unit, "vote").agg(F.count(F.lit(1)).alias("k"))
    j = labels.join(votes, unit, "left")
    own = F.sum(F.when(F.col("vote") == F.col(label), F.col("k")).otherwise(0)) + 1
    total = F.coalesce(F.sum("k"), F.lit(0)) + 1
    other = F.min_by("vote", F.when(F.col("vote") != F.col(label), F.struct(-F.col("k"), F.col("vote"))))
    has_other = F.max((F.col("vote") != F.col(label)).cast("int"))
    g = j.groupBy(unit, label).agg(own.alias("own"), total.alias("total"), other.alias("other"), has_other.alias("has_other"))
    move = (F.col(label) >= 0) & (F.col("total") > 1) & (F.col("own") * KEEP[1] < F.col("total") * KEEP[0]) & (F.col("has_other") == 1)
    return g.select(unit, F.when(move, F.col("other")).otherwise(F.col(label)).alias(label))


def smoothed(labels: DataFrame, edges: DataFrame, rounds: int = 3, unit: str = "unit", label: str = "label") -> DataFrame:
    for _ in range(rounds):
        labels = materialised(majority_sweep(labels, edges, unit, label), "labels")
    return labels


def connected_components(edges: DataFrame, nodes: DataFrame, node: str = "unit", most: int = 50) -> DataFrame:
    """(node, component) with the smallest node of each component: labels spread over edges, two hops a round."""
    e = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    cur = nodes.select(F.col(node), F.col(node).alias("component"))
    for _ in range(most):
        low = e.join(cur.select(F.col(node).alias("dst"), "component"), "dst").groupBy(F.col("src").alias(node)).agg(F.min("component").alias("low"))
        step = cur.join(low, node, "left").select(node, F.least("component", F.coalesce("low", "component")).alias("c"), F.col("component").alias("was"))
        jump = step.select(F.col(node).alias("c"), F.col("c").alias("cc"))
        nxt = materialised(step.join(jump, "c").select(node, F.least("c", "cc").alias("component"), "was"), "components")
        cur = nxt.select(node, "component")
        if nxt.where("component <> was").limit(1).count() == 0:
            return cur
    raise RuntimeError("components did not converge")


def absorb_small_components(labels: DataFrame, edges: DataFrame, least: int = 5, unit: str = "unit", label: str = "label") -> DataFrame:
    """Components of equal labels with at most ``least`` units take the label of the largest component."""
    lab = labels.select(F.col(unit).alias("u"), F.col(label).alias("l"))
    same = edges.join(lab.select(F.col("u").alias("src"), F.col("l").alias("a")), "src").join(lab.select(F.col("u").alias("dst"), F.col("l").alias("b")), "dst").where("a = b").select("src", "dst")
    comp = connected_components(same, labels, unit).join(labels, unit)
    sizes = comp.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.min(label).alias("l"))
    main = sizes.agg(F.min_by("l", F.struct(-F.col("k"), F.col("component"))).alias("m")).first()["m"]
    return comp.join(sizes.select("component", "k"), "component").select(unit, F.when(F.col("k") <= least, F.lit(main)).otherwise(F.col(label)).alias(label))


def label_components(labels: DataFrame, edges: DataFrame, unit: str = "unit", label: str = "label") -> DataFrame:
    """(label, units, components): how many pieces each label is in."""
    lab = labels.select(F.col(unit).alias("u"), F.col(label).alias("l"))
    same = edges.join(lab.select(F.col("u").alias("src"), F.col("l").alias("a")), "src").join(lab.select(F.col("u").alias("dst"), F.col("l").alias("b")), "dst").where("a = b").select("src", "dst")
    return connected_components(same, labels, unit).join(labels, unit).groupBy(label).agg(F.count(F.lit(1)).alias("units"), F.count_distinct("component").alias("components"))


def refined_map(labels: DataFrame, edges: DataFrame, rounds: int = 2, unit: str = "unit", label: str = "cluster_id") -> DataFrame:
    """(unit, cluster_id_original, cluster_id, reassigned) after smoothing."""
    new = smoothed(labels.select(unit, label), edges, rounds, unit, label)
    return labels.select(unit, F.col(label).alias(f"{label}_original")).join(new, unit).withColumn("reassigned", F.col(label) != F.col(f"{label}_original"))


def unit_groups(units: DataFrame, how: str, **options) -> DataFrame:
    """(unit, group_id) by ``unit``, ``grid`` (step), ``country``, ``zone`` (columns) or ``kmeans`` (k, columns)."""
    from tessera.operators.panel import dense_group_id

    if how == "unit":
        return dense_group_id(units, ["unit"]).select("unit", "group_id")
    if how == "country":
        return dense_group_id(units, ["admin0"]).select("unit", "group_id")
    if how == "zone":
        return dense_group_id(units, options["columns"]).select("unit", "group_id")
    if how == "grid":
        step = options["step"]
        e = units.agg(F.min("lat").alias("y"), F.min("lon").alias("x"), F.max("lon").alias("x1")).first()
        n = int((e["x1"] - e["x"]) // step) + 1
        return units.select("unit", (F.floor((F.col("lat") - e["y"]) / step) * n + F.floor((F.col("lon") - e["x"]) / step)).cast("bigint").alias("group_id"))
    if how == "kmeans":
        from tessera.operators.models import kmeans_labels

        return kmeans_labels(units, options["columns"], options["k"]).select("unit", F.col("label").cast("bigint").alias("group_id"))
    raise ValueError(how)


def _t_tail(t: float, df: int) -> float:
    """P(T > t): for whole degrees of freedom a finite sum over powers of the cosine of atan(t / sqrt(df))."""
    angle = math.atan(t / math.sqrt(df))
    sin, cos = math.sin(angle), math.cos(angle)
    odd, total, term = df % 2, 0.0, cos if df % 2 else 1.0
    for k in range(1 + odd, df, 2):
        total += term
        term *= cos * cos * k / (k + 1)
    within = (angle + sin * total) * 2 / math.pi if odd else sin * total
    return (1 - within) / 2


def critical_t(df: int, level: float = 0.05) -> float:
    """The one-sided critical value of t to three places, at any level below one half."""
    df, low, high = max(df, 1), 0.0, 1.0
    if df > 200:  # the expansion in 1 / df is right to more places than are kept
        z = NormalDist().inv_cdf(1 - level)
        return round(z + (z**3 + z) / (4 * df) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * df * df), 3)
    while _t_tail(high, df) > level:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_tail(mid, df) > level else (low, mid)
    return round(high, 3)


def class_one_test(df: DataFrame, split: str, base: str, y: str = "y", clear: float = 0.01) -> DataFrame:
    """(n, mean_diff, t, accept) of the hits among true class 1: accept above ``clear``; reject at 0 or below; else t > 1."""
    diff = (F.col(split) == 1).cast("double") - (F.col(base) == 1).cast("double")
    s = df.where(F.col(y) == 1).agg(F.count(F.lit(1)).alias("n"), F.avg(diff).alias("m"), F.stddev_pop(diff).alias("s"))
    t = F.try_divide(F.col("m"), F.try_divide(F.col("s"), F.sqrt("n")))
    accept = F.when(F.col("m").isNull(), False).when(F.col("m") > clear, True).when(F.col("m") <= 0, False).otherwise(F.coalesce(t > 1, F.lit(True)))
    return s.select("n", F.round("m", 6).alias("mean_diff"), F.round(t, 6).alias("t"), F.coalesce(accept, F.lit(False)).alias("accept"))


def paired_test(df: DataFrame, split: str, base: str, level: float = 0.05, effect: float = 0.5, least: float = 0.0005) -> bool:
    """A paired t-test with a critical value, an effect size and a least mean difference."""
    d = F.col(split) - F.col(base)
    s = df.agg(F.count(F.lit(1)).alias("n"), F.avg(d).alias("m"), F.stddev_samp(d).alias("s")).first()
    if not s["n"] or s["n"] < 2 or s["m"] is None or s["m"] < least:
        return False
    if not s["s"]:
        return True
    return s["m"] / (s["s"] / math.sqrt(s["n"])) > critical_t(s["n"] - 1, level) and s["m"] / s["s"] >= effect


def grid_meet(todo: DataFrame, shapes: DataFrame, key: str, d2, cell: float, box: tuple) -> DataFrame:
    """(key, d2, best) for each row of ``todo`` (key, lat, lon): the nearest of ``shapes``, ties to the smaller ``id``.

    ``box`` names the shapes' columns of least and greatest lat and lon, ``d2`` is the squared distance. A round's cells
    are twice as wide as the last one's; a point meets the shapes of the nine cells around it, and what is within one
    cell's width is final. So a far point costs rounds by the logarithm of its distance. Points without finite
    coordinates have no nearest shape; without shapes the result is empty.
    """
    finite = lambda c: F.abs(F.col(c).cast("double")) < 1e300
    todo, out = todo.select(key, "lat", "lon").where(finite("lat") & finite("lon")).distinct(), None
    some = shapes.limit(1).count() > 0
    while True:
        at = lambda c: F.floor(F.col(c) / cell)  # noqa: E731, B023
        spread = F.array(*map(F.lit, (-1, 0, 1)))
        cells = shapes.withColumn("__x", F.explode(F.sequence(at(box[0]), at(box[1])))).withColumn("__y", F.explode(F.sequence(at(box[2]), at(box[3]))))
        near = todo.withColumn("__i", F.explode(spread)).withColumn("__j", F.explode(spread)).withColumn("__x", at("lat") + F.col("__i")).withColumn("__y", at("lon") + F.col("__j"))
        met = near.join(cells, ["__x", "__y"]).withColumn("d2", d2)
        best = met.groupBy(key, "lat", "lon").agg(F.min(F.struct("d2", F.col("id").alias("best"))).alias("__b"))
        found = materialised(best.select(key, "lat", "lon", "__b.d2", "__b.best").where(F.col("d2") <= cell * cell), "nearest")
        out = found if out is None else out.unionByName(found)
        todo = materialised(todo.join(found, [key, "lat", "lon"], "left_anti"), "open")
        if not some or todo.limit(1).count() == 0:
            return out.select(key, "d2", "best")
        cell *= 2


def in_polygons(points: DataFrame, segments: DataFrame, key: str, cell: float = 8.0) -> DataFrame:
    """(key, unit, inside): the polygon that holds each point (lat, lon), else the one with the nearest border.

    ``segments`` (unit, x1, y1, x2, y2) are the borders, x along lat. A point is inside if a ray along x crosses the
    border an odd number of times. Points meet polygons by cells of their boxes; ties go to the smaller unit.
    """
    at = lambda c: F.floor(F.col(c) / cell)
    boxes = segments.groupBy("unit").agg(F.min(F.least("x1", "x2")).alias("a"), F.max(F.greatest("x1", "x2")).alias("b"), F.min(F.least("y1", "y2")).alias("c"), F.max(F.greatest("y1", "y2")).alias("e"))
    cells = boxes.withColumn("__x", F.explode(F.sequence(at("a"), at("b")))).withColumn("__y", F.explode(F.sequence(at("c"), at("e"))))
    placed = points.select(key, "lat", "lon").withColumn("__x", at("lat")).withColumn("__y", at("lon"))
    could = placed.join(cells, ["__x", "__y"]).where("lat between a and b and lon between c and e").select(key, "lat", "lon", "unit")
    ray = ((F.col("y1") > F.col("lon")) != (F.col("y2") > F.col("lon"))) & (F.col("lat") < F.col("x1") + (F.col("lon") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1")))
    crossed = could.join(segments, "unit").groupBy(key, "unit").agg(F.sum(F.coalesce(ray, F.lit(False)).cast("int")).alias("n"))
    inside = materialised(crossed.where("n % 2 = 1").groupBy(key).agg(F.min("unit").alias("unit")), "inside")
    rest = points.select(key, "lat", "lon").join(inside, key, "left_anti")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((F.col("lat") - F.col("x1")) * dx + (F.col("lon") - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    d2 = (F.col("lat") - F.col("x1") - t * dx) ** 2 + (F.col("lon") - F.col("y1") - t * dy) ** 2
    sides = segments.select(F.col("unit").alias("id"), "x1", "y1", "x2", "y2", F.least("x1", "x2").alias("__a"), F.greatest("x1", "x2").alias("__b"), F.least("y1", "y2").alias("__c"), F.greatest("y1", "y2").alias("__e"))
    near = grid_meet(rest, sides, key, d2, cell, ("__a", "__b", "__c", "__e"))
    return inside.select(key, "unit", F.lit(True).alias("inside")).unionByName(near.select(key, F.col("best").alias("unit"), F.lit(False).alias("inside")))
