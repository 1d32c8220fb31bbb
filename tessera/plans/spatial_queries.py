"""Spatial operators, consensus of plans, splits in time, partition trees and models."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tessera.operators import consensus as C
from tessera.operators import joins as J
from tessera.operators import models as L
from tessera.operators import spatial as G
from tessera.operators import splits as X
from tessera.operators import tree as T
from tessera.operators.panel import lags, max_normalised
from tessera.plans import fixtures as V
from tessera.plans.fixtures import EDGES, PANEL, PLANS, PREDICTIONS, SUPPLY, UNITS, sql

QUERIES: dict[str, tuple] = {}


def query(name: str, text: str | None = None):
    def add(f):
        QUERIES[name] = (f, text)
        return f

    return add


@query("rook_edges", sql(EDGES, select="SELECT src, dst FROM v_edge"))
def _(spark, d):
    return V.edges(spark, d)


@query("queen_edges", sql(UNITS, select="SELECT a.unit AS src, b.unit AS dst FROM v_unit a, v_unit b WHERE a.unit <> b.unit AND abs(a.lat - b.lat) <= 4 AND abs(a.lon - b.lon) <= 4"))
def _(spark, d):
    cells = V.units(spark, d).select("unit", (F.col("lat") / 4).cast("int").alias("row"), (F.col("lon") / 4).cast("int").alias("col"))
    return G.grid_neighbours(cells, "unit", eight=True)


@query("boundary_edges", sql(EDGES, select="SELECT src, dst FROM v_edge"))
def _(spark, d):
    u = V.units(spark, d)
    x, y = F.col("lat"), F.col("lon")
    side = lambda a, b, c, e: F.struct(a.alias("x1"), b.alias("y1"), c.alias("x2"), e.alias("y2"))
    s = u.select("unit", F.explode(F.array(side(x, y, x + 4, y), side(x + 4, y, x + 4, y + 4), side(x + 4, y + 4, x, y + 4), side(x, y + 4, x, y))).alias("s")).select("unit", "s.*")
    return G.shared_boundaries(s, "unit")


@query("distance_neighbors", sql(UNITS, select="SELECT a.unit AS src, b.unit AS dst FROM v_unit a, v_unit b WHERE sqrt((a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2) BETWEEN 0.001 AND 6"))
def _(spark, d):
    return G.distance_neighbours(V.units(spark, d), 6.0)


@query("degree_stats", sql(EDGES, select="SELECT count(*) AS n, sum((k = 0)::INT)::BIGINT AS isolated, min(k)::BIGINT AS least, max(k)::BIGINT AS most, round(avg(k), 6) AS mean, 0::BIGINT AS asymmetric FROM (SELECT u.unit, count(dst) AS k FROM v_unit u LEFT JOIN v_edge ON src = unit GROUP BY u.unit)"))
def _(spark, d):
    return G.adjacency_report(V.edges(spark, d), V.units(spark, d))


@query("nearest_outlier", sql(UNITS, select="SELECT unit, nearest, d2 FROM (SELECT a.unit, b.unit AS nearest, (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2 AS d2, row_number() OVER (PARTITION BY a.unit ORDER BY (a.lat - b.lat) ** 2 + (a.lon - b.lon) ** 2, b.unit) AS k FROM v_unit a, v_unit b WHERE a.unit % 3 = 0 AND b.unit % 3 <> 0) WHERE k = 1"))
def _(spark, d):
    u = V.units(spark, d)
    return J.nearest(u.where("unit % 3 = 0"), u.where("unit % 3 <> 0"))


@query("unit_centroids", sql(UNITS, select="SELECT region, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon, count(*) AS n, string_agg(unit::VARCHAR, ',' ORDER BY unit) AS units, min(lat) AS lat_min, max(lat) AS lat_max FROM v_unit GROUP BY region"))
def _(spark, d):
    return V.units(spark, d).groupBy("region").agg(F.round(F.avg("lat"), 6).alias("lat"), F.round(F.avg("lon"), 6).alias("lon"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.sort_array(F.collect_list("unit")), lambda c: c.cast("string")), ",").alias("units"), F.min("lat").alias("lat_min"), F.max("lat").alias("lat_max"))


@query("unit_profiles", sql(SUPPLY, select="SELECT unit, round(avg(q), 6) AS q_mean, round(stddev_samp(q), 6) AS q_std FROM v_supply GROUP BY unit"))
def _(spark, d):
    p = L.unit_profiles(V.supply(spark, d), "unit", ["q"])
    return p.select("unit", F.round("q_mean", 6).alias("q_mean"), F.round("q_std", 6).alias("q_std"))


@query("group_sums", sql(PREDICTIONS, select="SELECT unit, sum((y = 0)::INT)::BIGINT AS y_0, sum((y = 1)::INT)::BIGINT AS y_1 FROM v_pred GROUP BY unit"))
def _(spark, d):
    return V.predictions(spark, d).groupBy("unit").agg(*[F.sum((F.col("y") == k).cast("bigint")).alias(f"y_{k}") for k in (0, 1)])


_CB = PREDICTIONS + ", v_cb AS (SELECT unit, base, correct, (base - correct)::DOUBLE AS c, coalesce((sum(base - correct) OVER () * base)::DOUBLE / nullif(sum(base) OVER (), 0), 0) AS b FROM (SELECT unit, sum((y = 1)::INT)::BIGINT AS base, sum((y = 1 AND part = 1)::INT)::BIGINT AS correct FROM v_pred GROUP BY unit))"


def _cb(spark, d):
    return G.observed_expected(V.predictions(spark, d), "unit", "y", "part")


@query("class_stat_c_b", sql(_CB, select="SELECT * FROM v_cb"))
def _(spark, d):
    return _cb(spark, d)


@query("scan_one_step", sql(_CB, select="SELECT unit, round(c * ln(1.2) + b * (1 - 1.2::DOUBLE), 6) AS score FROM v_cb"))
def _(spark, d):
    return G.scan_scores(_cb(spark, d), "unit", 1.2).select("unit", F.round("score", 6).alias("score"))


@query("top_half_split", sql(_CB, select="SELECT unit, CASE WHEN k <= size THEN 0 ELSE 1 END AS side FROM (SELECT *, greatest(coalesce(min(CASE WHEN k > ceil(h * 0.9) AND k <= least(ceil(h * 1.1), n) AND score <= 0 THEN k - 1 END) OVER (), h), 1) AS size FROM (SELECT unit, score, row_number() OVER (ORDER BY score DESC, unit) AS k, count(*) OVER () AS n, ceil(count(*) OVER () / 2.0) AS h FROM (SELECT unit, (c - b)::DOUBLE AS score FROM v_cb)))"))
def _(spark, d):
    return G.top_half(_cb(spark, d).select("unit", (F.col("c") - F.col("b")).alias("score")), "unit", "score")


@query("scan_partition")
def _(spark, d):
    return G.scan(G.materialised(_cb(spark, d), "cb"), "unit").select("unit", "side", F.round("score", 6).alias("score"))


_LABEL = EDGES + ", v_label AS (SELECT unit, (unit * 7 % 3)::INTEGER AS label FROM v_unit)"
_SWEEP = """SELECT unit, CASE WHEN total > 1 AND own * 9 < total * 4 AND other IS NOT NULL THEN other ELSE label END::INTEGER AS label FROM (
SELECT l.unit, l.label, 1 + coalesce(sum(k) FILTER (WHERE vote = l.label), 0) AS own, 1 + coalesce(sum(k), 0) AS total, arg_min(vote, (-k) * 1000 + vote) FILTER (WHERE vote <> l.label) AS other
FROM v_label l LEFT JOIN (SELECT src, label AS vote, count(*) AS k FROM {edges} JOIN v_label ON dst = unit GROUP BY 1, 2) v ON l.unit = v.src GROUP BY l.unit, l.label)"""


def _labels(spark, d):
    return V.units(spark, d).select("unit", (F.col("unit") * 7 % 3).cast("int").alias("label"))


@query("majority_sweep", sql(_LABEL, select=_SWEEP.format(edges="v_edge")))
def _(spark, d):
    return G.majority_sweep(_labels(spark, d), V.edges(spark, d))


@query("grid_majority", sql(_LABEL + ", v_queen AS (SELECT a.unit AS src, b.unit AS dst FROM v_unit a, v_unit b WHERE a.unit <> b.unit AND abs(a.lat - b.lat) <= 4 AND abs(a.lon - b.lon) <= 4)", select=_SWEEP.format(edges="v_queen")))
def _(spark, d):
    cells = V.units(spark, d).select("unit", (F.col("lat") / 4).cast("int").alias("row"), (F.col("lon") / 4).cast("int").alias("col"))
    return G.majority_sweep(_labels(spark, d), G.grid_neighbours(cells, "unit"))


_SAME = _LABEL + ", v_same AS (SELECT e.src, e.dst FROM v_edge e JOIN v_label a ON e.src = a.unit JOIN v_label b ON e.dst = b.unit WHERE a.label = b.label)"
_COMPONENTS = "WITH RECURSIVE " + sql(_SAME, select="").removeprefix("WITH ") + ", reach AS (SELECT unit AS a, unit AS b FROM v_unit UNION SELECT r.a, s.dst FROM reach r JOIN v_same s ON r.b = s.src), v_comp AS (SELECT a AS unit, min(b) AS component FROM reach GROUP BY a)"


@query("components", _COMPONENTS + " SELECT unit, component FROM v_comp")
def _(spark, d):
    lab = _labels(spark, d)
    e = V.edges(spark, d).join(lab.select(F.col("unit").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("unit").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
    return G.connected_components(e.select("src", "dst"), lab)


@query("component_sizes", _COMPONENTS + " SELECT component, count(*) AS n, count(*)::DOUBLE / (SELECT count(*) FROM v_comp) AS share FROM v_comp GROUP BY component")
def _(spark, d):
    lab = _labels(spark, d)
    e = V.edges(spark, d).join(lab.select(F.col("unit").alias("src"), F.col("label").alias("a")), "src").join(lab.select(F.col("unit").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
    comp = G.materialised(G.connected_components(e.select("src", "dst"), lab), "comp")
    return comp.groupBy("component").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.col("n") / F.lit(float(comp.count())))


@query("small_components_absorbed", _COMPONENTS + ", sizes AS (SELECT component, count(*) AS k, min(label) AS l FROM v_comp JOIN v_label USING (unit) GROUP BY component) SELECT c.unit, CASE WHEN k <= 2 THEN (SELECT l FROM sizes ORDER BY k DESC, component LIMIT 1) ELSE label END AS label FROM v_comp c JOIN sizes USING (component) JOIN v_label l ON l.unit = c.unit")
def _(spark, d):
    return G.absorb_small_components(_labels(spark, d), V.edges(spark, d), 2)


@query("label_components", _COMPONENTS + " SELECT label, count(*) AS units, count(DISTINCT component) AS components FROM v_comp JOIN v_label USING (unit) GROUP BY label")
def _(spark, d):
    return G.label_components(_labels(spark, d), V.edges(spark, d))


@query("refined_map", sql(_LABEL, select="SELECT unit, label AS cluster_id_original, new_label AS cluster_id, label <> new_label AS reassigned FROM v_label JOIN (SELECT unit, label AS new_label FROM (" + _SWEEP.format(edges="v_edge") + ")) USING (unit)"))
def _(spark, d):
    return G.refined_map(_labels(spark, d).withColumnRenamed("label", "cluster_id"), V.edges(spark, d), rounds=1)


@query("unit_groups_grid", sql(UNITS, select="SELECT unit, (floor(lat / 8.0) * 3 + floor(lon / 8.0))::BIGINT AS group_id FROM v_unit"))
def _(spark, d):
    return G.unit_groups(V.units(spark, d), "grid", step=8.0)


@query("unit_groups_country", sql(UNITS, select="SELECT unit, (dense_rank() OVER (ORDER BY admin0) - 1)::BIGINT AS group_id FROM v_unit"))
def _(spark, d):
    return G.unit_groups(V.units(spark, d), "country")


@query("unit_groups_kmeans")
def _(spark, d):
    p = L.unit_profiles(V.supply(spark, d), "unit", ["q", "r"])
    return G.unit_groups(p, "kmeans", columns=["q_mean", "r_mean"], k=5)


@query("sig_test_mean_t", sql(PREDICTIONS, select="SELECT n, round(m, 6) AS mean_diff, round(t, 6) AS t, coalesce(CASE WHEN m > 0.01 THEN true WHEN m <= 0 THEN false ELSE coalesce(t > 1, true) END, false) AS accept FROM (SELECT count(*) AS n, avg(x) AS m, avg(x) / nullif(stddev_pop(x) / sqrt(count(*)), 0) AS t FROM (SELECT (part - pooled)::DOUBLE AS x FROM v_pred WHERE y = 1))"))
def _(spark, d):
    return G.class_one_test(V.predictions(spark, d), "part", "pooled")


# consensus

_W = PLANS + ", v_weight AS (SELECT plan, greatest(ln(p / (1 - p)) - ln(q / (1 - q)), 0) AS weight FROM (SELECT plan, greatest(least(any_value(f1), 1 - 1e-6), 1e-6) AS p, greatest(least(any_value(f1_base), 1 - 1e-6), 1e-6) AS q FROM v_plan GROUP BY plan)), v_pair AS (SELECT a.unit AS i, b.unit AS j, sum(weight) AS s FROM v_plan a JOIN v_plan b ON a.plan = b.plan AND a.partition_id = b.partition_id AND a.unit <= b.unit JOIN v_weight w ON a.plan = w.plan WHERE weight > 0 GROUP BY 1, 2)"


@query("universe", sql(PLANS, select="SELECT DISTINCT unit FROM v_plan WHERE partition_id <> 's-1'"))
def _(spark, d):
    return C.universe(V.plans(spark, d))


@query("logit_weight", sql(_W, select="SELECT plan, round(weight, 6) AS weight FROM v_weight"))
def _(spark, d):
    return C.plan_weights(V.plans(spark, d)).select("plan", F.round("weight", 6).alias("weight"))


def _pairs(spark, d):
    p = G.materialised(V.plans(spark, d), "plans")
    return C.co_association(p, C.plan_weights(p))


@query("coassociation", sql(_W, select="SELECT i, j, round(s, 5) AS s FROM v_pair"))
def _(spark, d):
    return _pairs(spark, d).select("i", "j", F.round("s", 5).alias("s"))


_HAV = "degrees(2 * asin(least(sqrt(sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2), 1.0)))"


@query("haversine_kernel", sql(UNITS, select=f"SELECT i, j, round(distance, 6) AS distance, round(exp(-(distance ** 2) / 50.0), 6) AS kernel FROM (SELECT a.unit AS i, b.unit AS j, {_HAV} AS distance FROM v_unit a, v_unit b WHERE a.unit <= b.unit)"))
def _(spark, d):
    u = V.units(spark, d)
    # every pair of one group of units: a bounded table, met by a constant key
    a = u.select(F.lit(0).alias("k"), F.col("unit").alias("i"))
    pairs = a.join(u.select(F.lit(0).alias("k"), F.col("unit").alias("j")), "k").where("i <= j").select("i", "j", F.lit(1.0).alias("s"))
    return C.with_distance(pairs, u).select("i", "j", F.round("distance", 6).alias("distance"), F.round("kernel", 6).alias("kernel"))


@query("knn_topk", sql(_W, select="WITH" + " both_ways AS (SELECT i AS src, j AS dst, s FROM v_pair WHERE i <> j UNION ALL SELECT j, i, s FROM v_pair WHERE i <> j), top AS (SELECT src, dst, s FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(s, 5) DESC, dst) AS k FROM both_ways) WHERE k <= 5) SELECT src, dst, round(max(s), 5) AS weight FROM (SELECT src, dst, s FROM top UNION ALL SELECT dst, src, s FROM top) GROUP BY 1, 2").replace("\nWITH both_ways", ",\nboth_ways"))
def _(spark, d):
    g = C.knn_graph(_pairs(spark, d).withColumn("s", F.round("s", 5)), "s", 5)
    return g.select("src", "dst", F.round("weight", 5).alias("weight"))


@query("graph_report", sql(_W, select="SELECT count(*) AS nnz, count(*) / (25 * 24.0)::DOUBLE AS density, 1 - count(*) / 625.0::DOUBLE AS sparsity FROM (SELECT i, j FROM v_pair WHERE i <> j UNION ALL SELECT j, i FROM v_pair WHERE i <> j)"))
def _(spark, d):
    return G.graph_report(C.knn_graph(_pairs(spark, d), "s", 1000), 25).select("nnz", "density", "sparsity")


@query("normalised_similarity", sql(_W, select="SELECT i, j, round(s / max(s) OVER (), 6) AS w FROM v_pair"))
def _(spark, d):
    p = G.materialised(_pairs(spark, d), "pairs")
    return max_normalised(p, "s", "w").select("i", "j", F.round("w", 6).alias("w"))


@query("consensus_map")
def _(spark, d):
    return C.consensus_map(G.materialised(V.plans(spark, d), "plans"), V.units(spark, d), clusters=4, k=8)


@query("power_iteration")
def _(spark, d):
    p = G.materialised(V.plans(spark, d), "plans")
    graph = G.materialised(C.knn_graph(C.co_association(p, C.plan_weights(p)), "s", 8), "graph")
    return C.power_iteration_labels(graph, 3, C.universe(p))


# splits

_ROWS = "SELECT 'test' AS kind, unit, month FROM v_panel WHERE {test} UNION ALL SELECT 'train', unit, month FROM v_panel WHERE {train} AND unit IN (SELECT unit FROM v_panel WHERE {test})"


def _both(train, test):
    return test.select(F.lit("test").alias("kind"), "unit", "month").unionByName(train.select(F.lit("train").alias("kind"), "unit", "month"))


@query("monthly_split", sql(PANEL, select=_ROWS.format(test="month = DATE '1999-05-01'", train="month < DATE '1999-01-01' AND month >= DATE '1996-02-01'")))
def _(spark, d):
    return _both(*X.monthly_split(V.panel(spark, d), datetime.date(1999, 5, 1), 4))


@query("quarter_split", sql(PANEL, select=_ROWS.format(test="year(month) = 1999 AND quarter(month) = 2", train="month < DATE '1999-04-01' AND month >= DATE '1996-04-01'")))
def _(spark, d):
    return _both(*X.quarterly_split(V.panel(spark, d), 1999, 2))


@query("annual_split", sql(PANEL, select=_ROWS.format(test="year(month) = 2000", train="year(month) BETWEEN 1997 AND 1999")))
def _(spark, d):
    return _both(*X.annual_split(V.panel(spark, d), 2000))


@query("split_correspondence", sql(PANEL + ", " + UNITS, select="SELECT DISTINCT p.unit, region AS partition_id FROM v_panel p JOIN v_unit u ON p.unit = u.unit WHERE year(month) BETWEEN 1997 AND 1999 AND p.unit IN (SELECT unit FROM v_panel WHERE year(month) = 2000)"))
def _(spark, d):
    train, _ = X.annual_split(V.panel(spark, d), 2000)
    return X.correspondence(train, V.units(spark, d).select("unit", F.col("region").alias("partition_id")))


_HASH = "(row_id * 2654435761) % 1000003"


@query("group_val_split", sql(PREDICTIONS, select=f"SELECT row_id, (k <= least(greatest(1, ceil(n * 0.2)), n - 1))::INTEGER AS set FROM (SELECT row_id, count(*) OVER (PARTITION BY unit) AS n, row_number() OVER (PARTITION BY unit ORDER BY {_HASH}, row_id) AS k FROM v_pred)"))
def _(spark, d):
    return X.group_validation(V.predictions(spark, d), "unit", "row_id", order=F.expr(_HASH.replace("2654435761", "2654435761L"))).select("row_id", "set")


@query("split_coverage", sql(PREDICTIONS, select="SELECT unit, count(*) AS total_count, sum((row_id % 5 > 0)::INT)::BIGINT AS train_count, sum((row_id % 5 = 0)::INT)::BIGINT AS val_count, sum((row_id % 5 = 0)::INT) = 0 AND count(*) > 1 AS uncovered FROM v_pred GROUP BY unit"))
def _(spark, d):
    return X.split_coverage(V.predictions(spark, d).withColumn("set", (F.col("row_id") % 5 == 0).cast("int")), "unit")


@query("group_folds", sql(PREDICTIONS, select="SELECT unit, majority, ((row_number() OVER (PARTITION BY majority ORDER BY (unit * 7) % 25, unit) - 1) % 5)::INTEGER AS fold FROM (SELECT unit, (sum(y) * 2 > count(*))::INTEGER AS majority FROM v_pred GROUP BY unit)"))
def _(spark, d):
    return X.group_folds(V.predictions(spark, d), "unit", order=F.expr("(unit * 7) % 25"))


# trees

_BRANCH = "v_branch AS (SELECT o_custkey AS group_id, lpad(bin(o_orderkey % 8), 3, '0')[1:(o_orderkey % 3 + 1)::BIGINT] AS branch_id FROM orders)"


def _branches(spark, d):
    o = V.read(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("group_id"), F.expr("substring(lpad(bin(o_orderkey % 8), 3, '0'), 1, cast(o_orderkey % 3 + 1 as int))").alias("branch_id"))


@query("latest_branch", sql(_BRANCH, select="SELECT group_id, branch_id FROM (SELECT *, row_number() OVER (PARTITION BY group_id ORDER BY length(branch_id) DESC, branch_id DESC) AS k FROM v_branch) WHERE k = 1"))
def _(spark, d):
    return T.deepest_branch(_branches(spark, d))


_ROUNDS = UNITS + ", v_round AS (SELECT '' AS branch_id, unit, (unit % 2)::INTEGER AS side FROM v_unit UNION ALL SELECT '0', unit, (unit % 4 // 2)::INTEGER FROM v_unit WHERE unit % 2 = 0 AND unit <> 8 UNION ALL SELECT '1', unit, (unit % 4 // 2)::INTEGER FROM v_unit WHERE unit % 2 = 1 OR unit = 4)"


def _rounds(spark, d):
    u = V.units(spark, d)
    half = (F.floor(F.col("unit") % 4 / 2)).cast("int").alias("side")
    return u.select(F.lit("").alias("branch_id"), "unit", (F.col("unit") % 2).cast("int").alias("side")).unionByName(u.where("unit % 2 = 0 and unit <> 8").select(F.lit("0").alias("branch_id"), "unit", half)).unionByName(u.where("unit % 2 = 1 or unit = 4").select(F.lit("1").alias("branch_id"), "unit", half))


@query("terminal_lineage", sql(_ROUNDS, select="SELECT a.unit, a.side::VARCHAR || coalesce(b.side::VARCHAR, '') AS terminal FROM v_round a LEFT JOIN v_round b ON a.unit = b.unit AND b.branch_id = a.side::VARCHAR WHERE a.branch_id = ''"))
def _(spark, d):
    return T.expected_terminals(_rounds(spark, d), 2)


@query("scope_audit", sql(_ROUNDS, select="SELECT branch_id, sum(s) ::BIGINT AS in_scope, sum(g)::BIGINT AS from_parent, sum(s * (1 - g))::BIGINT AS extra, sum(g * (1 - s))::BIGINT AS lost FROM (SELECT branch_id, unit, max(s) AS s, max(g) AS g FROM (SELECT branch_id, unit, 1 AS s, 0 AS g FROM v_round WHERE branch_id <> '' UNION ALL SELECT branch_id || side::VARCHAR, unit, 0, 1 FROM v_round WHERE branch_id = '') GROUP BY 1, 2) GROUP BY branch_id"))
def _(spark, d):
    return T.scope_audit(_rounds(spark, d))


@query("branch_correspondence", sql(UNITS, select="SELECT unit, CASE WHEN unit < 5 THEN '010' WHEN unit < 9 THEN '011' END AS partition_id FROM v_unit"))
def _(spark, d):
    u = V.units(spark, d)
    return T.branch_correspondence(u, u.where("unit < 5"), u.where("unit >= 5 and unit < 9"), "01", full=True)


@query("keep_parent", sql(PREDICTIONS, select="WITH f AS (SELECT CASE k WHEN 0 THEN '' WHEN 1 THEN lpad(bin(unit % 2), 1, '0') ELSE lpad(bin(unit % 4), 2, '0') END AS branch_id, k, round(2.0 * sum(y * part)::DOUBLE / nullif(sum(y) + sum(part), 0), 9) AS f1 FROM v_pred, (SELECT unnest([1, 2]) AS k) GROUP BY 1, 2) SELECT c.branch_id, CASE WHEN coalesce(c.f1 > p.f1, true) THEN c.branch_id ELSE p.branch_id END AS model_branch FROM f c LEFT JOIN f p ON p.branch_id = c.branch_id[1:-2] AND length(c.branch_id) = 2").replace("\nWITH f AS", ",\nf AS"))
def _(spark, d):
    p = V.predictions(spark, d)
    f1 = F.round(F.try_divide(2.0 * F.sum(F.col("y") * F.col("part")), (F.sum("y") + F.sum("part")).cast("double")), 9).alias("f1")
    at = lambda k: p.groupBy(F.lpad(F.bin(F.col("unit") % (1 << k)), k, "0").alias("branch_id")).agg(f1)
    both = at(1).unionByName(at(2))
    return T.keep_parent(both, both)


@query("group_performance", sql(PREDICTIONS, select="SELECT branch_id, unit, k AS class, sum((y = k)::INT)::BIGINT AS n, coalesce(2.0 * sum((y = k AND pooled = k)::INT)::DOUBLE / nullif(sum((y = k)::INT) + sum((pooled = k)::INT), 0), 0) AS f1_base, coalesce(2.0 * sum((y = k AND part = k)::INT)::DOUBLE / nullif(sum((y = k)::INT) + sum((part = k)::INT), 0), 0) AS f1_split FROM (SELECT *, bin(unit % 2) AS branch_id FROM v_pred), (SELECT unnest([0, 1]) AS k) GROUP BY 1, 2, 3"))
def _(spark, d):
    return T.group_performance(V.predictions(spark, d).withColumn("branch_id", F.bin(F.col("unit") % 2)), "unit").drop("diff")


@query("node_rows", sql(PREDICTIONS, select="SELECT row_id, CASE WHEN unit < 10 THEN (unit % 2)::VARCHAR ELSE '0' END AS branch_id FROM v_pred WHERE month < DATE '1996-01-01'"))
def _(spark, d):
    p = T.initial_state(V.predictions(spark, d).where("month < date'1996-01-01'"), "row_id", "unit")
    sides = V.units(spark, d).where("unit < 10").select("unit", (F.col("unit") % 2).cast("int").alias("side"))
    s = T.split_rows(p, sides, "unit")
    return T.recombined(T.node_rows(s, "0"), T.node_rows(s, "1")).select("row_id", "branch_id")


@query("class_one_hits", sql(PREDICTIONS, select="SELECT row_id, part::DOUBLE AS score FROM v_pred WHERE y = 1"))
def _(spark, d):
    return T.hit_scores(V.predictions(spark, d), "part").select("row_id", "score")


@query("raster_blocks", "SELECT r::INTEGER AS row, c::INTEGER AS col, (r // 4 * 3 + c // 4)::BIGINT AS block FROM (SELECT unnest(range(0, 7)) AS r), (SELECT unnest(range(0, 10)) AS c)")
def _(spark, d):
    return T.raster_blocks(spark, 7, 10, 4)


@query("branch_of_location", sql(UNITS, select="SELECT unit, CASE WHEN floor(lat / 4) < 5 AND floor(lon / 4) < 4 THEN (floor(lat / 8) * 2 + floor(lon / 8))::BIGINT::VARCHAR ELSE '' END AS branch_id FROM v_unit"))
def _(spark, d):
    r = T.raster_blocks(spark, 5, 4, 2).withColumn("branch_id", F.col("block").cast("string"))
    return T.branch_of_location(V.units(spark, d), r, 4.0).select("unit", "branch_id")


# models; results of fits can't be had in SQL


def _frame(spark, d):
    """Panel rows with lag features, a partition and a set by time."""
    p = lags(V.panel(spark, d), ["y", "v", "n"], [1, 2, 4]).dropna()
    f = ["y_lag_1", "y_lag_2", "y_lag_4", "v_lag_1", "n_lag_1"]
    rows = p.select("unit", "month", "y", *[F.col(c).cast("double").alias(c) for c in f], (F.col("unit") % 2).cast("int").alias("partition_id"), (F.year("month") >= 1999).cast("int").alias("set"))
    return G.materialised(rows, "frame"), f


@query("partitioned_trees")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.partitioned_fit(df, f, "partition_id", "tree", depth=4).where("set = 1").select("unit", "month", "y", "pooled", "part")


@query("random_forest")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.fit_predict(df, f, "forest", trees=10, depth=5).where("set = 1").select("unit", "month", "y", "p")


@query("boosted_trees")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.fit_predict(df, f, "boosted", trees=5, depth=3).where("set = 1").select("unit", "month", "y", "p")


@query("logistic_baseline")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.fit_predict(df, f[:3], "logistic").where("set = 1").select("unit", "month", "y", "p")


@query("two_layer")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.two_layer(df, f[:3], f, "tree", depth=3).where("set = 1").select("unit", "month", "y", "p1", "wrong", "p")


@query("depth_selection")
def _(spark, d):
    df, f = _frame(spark, d)
    return spark.createDataFrame([(L.choose_depth(df, f, (2, 4, None)),)], "depth int")


@query("oof_errors")
def _(spark, d):
    df, f = _frame(spark, d)
    o = L.oof_predictions(df, f, "unit", folds=3, depth=3)
    return o.groupBy("unit").agg(F.count(F.lit(1)).alias("n_oof"), F.avg((F.col("y") != F.col("p")).cast("double")).alias("pct_err_all"))


@query("routed_predictions")
def _(spark, d):
    df, f = _frame(spark, d)
    models = {b: L.fitted(df.where(("set = 0" if b == "" else f"set = 0 and partition_id = {b}")), f, "tree", depth=3) for b in ("", "0", "1")}
    branches = V.units(spark, d).where("unit <> 3").select("unit", (F.col("unit") % 2).cast("string").alias("branch_id"))
    return L.routed(df.where("set = 1"), branches, models, f, "unit").select("unit", "month", "branch_id", "p")


_FRAME = PANEL + ", v_frame AS (SELECT unit, month, y, (unit % 2)::INT AS partition_id, (year(month) >= 1999)::INT AS set FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY month) AS k FROM v_panel) WHERE k > 4)"


@query("smote_balance", sql(_FRAME, "v_class AS (SELECT partition_id, y, count(*) AS n FROM v_frame WHERE set = 0 GROUP BY 1, 2)", select="SELECT partition_id, y, FALSE AS synthetic, n FROM v_class UNION ALL SELECT partition_id, y, TRUE, most - n FROM (SELECT *, max(n) OVER w AS most, count(*) OVER w AS classes, row_number() OVER (PARTITION BY partition_id ORDER BY n, y) AS k FROM v_class WINDOW w AS (PARTITION BY partition_id)) WHERE k = 1 AND classes = 2 AND n >= 2 AND most > n"))
def _(spark, d):
    df, f = _frame(spark, d)
    return L.smote(df.where("set = 0"), f, "partition_id").groupBy("partition_id", "y", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query("tree_rules")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.tree_rules(L.fitted(df.where("set = 0"), f, "tree", depth=3), f)


@query("tree_nodes")
def _(spark, d):
    df, f = _frame(spark, d)
    return L.node_frame(spark, L.fitted(df.where("set = 0"), f, "tree", depth=3), f)


@query("partition_tree")
def _(spark, d):
    df, f = _frame(spark, d)
    return T.grow(df, "unit", lambda rows: L.fit_predict(rows, f, "tree", depth=3), V.edges(spark, d), max_depth=2)


@query("kmeans_features")
def _(spark, d):
    e = V.read(spark, d, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    return L.kmeans_labels(e, [f"x{i}" for i in range(64)], 10).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def _(spark, d):
    from tessera.streaming.monthly import windowed_counts

    return windowed_counts(V.read(spark, d, "events"))


