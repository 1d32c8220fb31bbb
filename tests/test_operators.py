"""Hand-made cases of operators whose edges SQL on the tables doesn't reach."""

import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import settings
from tessera.operators import consensus, joins, metrics, models, panel, spatial, splits, tree
from tessera.sources import tables


@pytest.mark.parametrize(
    ("values", "strategy", "fill"),
    [
        ([1.0, 5.0, None], "max_plus", 500.0), ([0.0, -2.0, None], "max_plus", 100.0), ([-3.0, -1.0, None], "max_plus", -100.0), ([None, None], "max_plus", 0.0),
        ([2.0, 4.0, None], "min_minus", -198.0), ([4.0, 4.0, None], "min_minus", -396.0), ([0.0, None], "extreme_low", -100.0), ([1.0, 3.0, None], "extreme_high", 203.0), ([0.0, None], "extreme_high", 100.0), ([-2.0, None], "extreme_high", 198.0),
    ],
)
def test_imputer(spark, values, strategy, fill):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    out = panel.OutOfRangeImputer(["x"], strategy).fit(df).transform(df)
    assert {r["x"] for r in out.collect() if values[r["i"]] is None} == {fill}


def test_imputer_counts_nan_and_infinity_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    assert sorted(r["x"] for r in panel.OutOfRangeImputer(["x"]).fit(df).transform(df).collect()) == [1.0, 100.0, 100.0]


def test_majority(spark):
    # 1 is alone among 0s; 5 is isolated; -1 stays; a tie takes the lowest label
    labels = spark.createDataFrame([(1, 7), (2, 0), (3, 0), (4, 0), (5, 9), (6, -1), (7, 5), (8, 2), (9, 3)], "unit long, label int")
    pairs = [(1, 2), (1, 3), (1, 4), (6, 2), (7, 8), (7, 9)]
    edges = spark.createDataFrame([p for a, b in pairs for p in ((a, b), (b, a))], "src long, dst long")
    out = {r["unit"]: r["label"] for r in spatial.majority_sweep(labels, edges).collect()}
    assert out[1] == 0 and out[5] == 9 and out[6] == -1 and out[7] == 2


def test_top_half_bounds(spark):
    one = spark.createDataFrame([(1, 0.5)], "g int, s double")
    assert spatial.top_half(one, "g", "s").first()["side"] == 0
    ten = spark.createDataFrame([(i, float(6 - i)) for i in range(20)], "g int, s double")
    assert spatial.top_half(ten, "g", "s").where("side = 0").count() in (9, 10, 11)


def test_exactly_one_match(spark):
    left = spark.createDataFrame([(0,), (1,), (2,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k int, v string")
    out = {r["k"]: (r["status"], r["v"]) for r in joins.exactly_one_match(left, right, ["k"], ["v"]).collect()}
    assert out == {0: ("no_match", None), 1: ("success", "a"), 2: ("multiple_matches", None)}


def test_degenerate_groups(spark):
    df = spark.createDataFrame([("same", 1, 1), ("same", 1, 1), ("other", 0, 1), ("mixed", 1, 1), ("mixed", 0, 1)], "g string, y int, p int")
    out = {r["g"]: (r["precision"], r["f1"]) for r in metrics.degenerate_group_metrics(df, ["g"]).collect()}
    assert out["same"] == (1.0, 1.0) and out["other"] == (0.0, 0.0) and out["mixed"][0] == 0.5


@pytest.mark.parametrize(("split", "base", "accept"), [([1, 1, 1, 0], [0, 1, 1, 0], True), ([1, 0], [1, 0], False), ([0, 1], [1, 1], False)])
def test_class_one_test(spark, split, base, accept):
    df = spark.createDataFrame([(1, s, b) for s, b in zip(split, base, strict=True)], "y int, s int, b int")
    assert spatial.class_one_test(df, "s", "b").first()["accept"] is accept


def test_class_one_test_without_positives(spark):
    df = spark.createDataFrame([(0, 1, 0)], "y int, s int, b int")
    assert spatial.class_one_test(df, "s", "b").first()["accept"] is False


def test_critical_values():
    assert spatial.critical_t(1) == 6.314 and spatial.critical_t(10) == 1.812
    assert spatial.critical_t(3) == 2.353 and spatial.critical_t(20) == 1.725 and spatial.critical_t(10**9, 0.01) == 2.326


def test_positional_and_calendar_lag(spark):
    df = spark.createDataFrame([(1, datetime.date(2020, m, 1), m) for m in (1, 2, 4)], "unit int, month date, v int")
    a = {r["month"].month: r["v_lag_1"] for r in panel.lags(df, ["v"], [1]).collect()}
    b = {r["month"].month: r["v_cal_1"] for r in panel.calendar_lag(df, ["v"], 1).collect()}
    assert a == {1: None, 2: 1, 4: 2} and b == {1: None, 2: 1, 4: None}


def test_monthly_window_is_one_month_short(spark):
    months = settings.months_between("2010-01", "2015-12")
    df = spark.createDataFrame([(1, m) for m in months], "unit int, month date")
    train, test = splits.monthly_split(df, datetime.date(2015, 1, 1), 4)
    assert test.count() == 1 and train.count() == 35
    assert train.agg(F.max("month")).first()[0] == datetime.date(2014, 8, 1)
    with pytest.raises(ValueError):
        splits.monthly_split(df, datetime.date(2015, 1, 1), 0)


def test_group_validation_leaves_single_rows_in_training(spark):
    df = spark.createDataFrame([("a", 1), *[("b", i) for i in range(2, 12)]], "g string, k int")
    out = {r["g"]: r["v"] for r in splits.group_validation(df, "g", "k").groupBy("g").agg(F.sum("set").alias("v")).collect()}
    assert out == {"a": 0, "b": 2}


def test_settings():
    assert [settings.scope_to_lag(s) for s in range(4)] == [1, 4, 8, 12]
    for bad in ((4, 4, 12), (3, 6, 9), (4, 8)):
        with pytest.raises(ValueError):
            settings.checked_lags(bad)
    assert settings.month_of("2023-2") == datetime.date(2023, 2, 1)
    assert settings.flag("Yes") and not settings.flag("off", True) and settings.flag("?", True)
    assert settings.columns_to_drop(["a", "year_1", "b"], ["a"], ["year_*"], ["b"]) == ["a", "year_1"]
    assert settings.best_depth([(3, 0.1), (5, 0.4), (7, 0.4)]) == 5 and settings.best_depth([(3, 0.0), (5, 0.0), (7, 0.0)]) == 5
    assert settings.cluster_count(None, 4) == 4
    with pytest.raises(ValueError):
        settings.cluster_count(0, None)


def test_coverage_guard(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "unit int")
    with pytest.raises(ValueError):
        joins.with_partition(df, spark.createDataFrame([(1, "a")], "unit int, partition_id string"))


def test_checked_join_and_coordinates(spark):
    df = spark.createDataFrame([(1,), (1,)], "unit int")
    with pytest.raises(ValueError):
        joins.checked_join(df, df, "unit")
    pairs = spark.createDataFrame([(1, 2, 1.0)], "i int, j int, s double")
    with pytest.raises(Exception, match="coordinates"):
        consensus.with_distance(pairs, spark.createDataFrame([(1, 0.0, 0.0)], "unit int, lat double, lon double")).collect()


def test_components_of_a_long_chain(spark):
    n = 40
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)], "src int, dst int")
    out = spatial.connected_components(edges, spark.range(n + 2).withColumnRenamed("id", "unit"))
    assert {r["unit"]: r["component"] for r in out.collect()} == {**{i: 0 for i in range(n + 1)}, n + 1: n + 1}


def test_knn_graph_is_symmetric(spark):
    pairs = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.9), (2, 3, 0.1), (1, 1, 2.0)], "i int, j int, s double")
    g = {(r["src"], r["dst"]): r["weight"] for r in consensus.knn_graph(pairs, "s", 1).collect()}
    assert g == {(1, 3): 0.9, (3, 1): 0.9, (1, 2): 0.5, (2, 1): 0.5}


def test_every_group_in_one_branch(spark):
    df = spark.createDataFrame([(1, ""), (1, "0"), (1, "01"), (2, "1")], "group_id int, branch_id string")
    assert {r["group_id"]: r["branch_id"] for r in tree.deepest_branch(df).collect()} == {1: "01", 2: "1"}


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    from tessera.streaming.monthly import streamed, windowed_counts

    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = streamed(spark, str(tmp_path / "in"), e.schema, str(tmp_path / "out"), str(tmp_path / "check"))
    want = windowed_counts(e)
    top = want.agg(F.max("start")).first()[0]
    kept = got.count()
    assert kept and got.join(want, ["start", "event_type", "n"]).count() == kept
    assert got.where(F.col("start") < F.lit(top) - F.expr("interval 3 days")).count() == want.where(F.col("start") < F.lit(top) - F.expr("interval 3 days")).count()


def test_nearest_far_away_and_without_targets(spark):
    points = spark.createDataFrame([(1, 5e7, -3e7), (2, 0.4, 0.0), (3, None, 1.0), (4, float("nan"), 1.0), (5, 1.0, 0.0)], "unit int, lat double, lon double")
    targets = spark.createDataFrame([(7, 0.0, 0.0), (8, 2.0, 0.0), (9, 2.0, 0.0)], "unit int, lat double, lon double")
    assert {r["unit"]: r["nearest"] for r in joins.nearest(points, targets).collect()} == {1: 8, 2: 7, 5: 7}
    assert joins.nearest(points, targets.where("false")).count() == 0
    assert joins.nearest(points.where("false"), targets).count() == 0


def test_points_in_a_concave_polygon(spark):
    u = [(0, 0), (6, 0), (6, 6), (4, 6), (4, 2), (2, 2), (2, 6), (0, 6)]  # two arms around a gap
    far = [(100, 0), (104, 0), (104, 4)]
    s = [(k, float(a), float(b), float(c), float(d)) for k, ring in ((1, u), (2, far)) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1], strict=True)]
    segments = spark.createDataFrame(s, "unit int, x1 double, y1 double, x2 double, y2 double")
    points = spark.createDataFrame([(1, 1.0, 5.0), (2, 5.0, 5.0), (3, 3.0, 5.0), (4, 103.0, 1.0), (5, 60.0, 1.0), (6, 3.0, 1.0), (7, None, 1.0)], "p int, lat double, lon double")
    got = {r["p"]: (r["unit"], r["inside"]) for r in spatial.in_polygons(points, segments, "p").collect()}
    assert got == {1: (1, True), 2: (1, True), 3: (1, False), 4: (2, True), 5: (2, False), 6: (1, True)}


def test_csv_columns_by_name(spark, tmp_path):
    path = tables.write_csv(spark.createDataFrame([("007", 1, "x"), ("010", None, "y")], "code string, n int, more string"), f"file://{tmp_path}/t")
    got = tables.read_csv(spark, path, "n int, code string")
    assert got.columns == ["n", "code"] and {tuple(r) for r in got.collect()} == {(1, "007"), (None, "010")}
    assert tables.first_existing(spark, [f"file://{tmp_path}/no", path]) == path
    with pytest.raises(FileNotFoundError):
        tables.first_existing(spark, [f"file://{tmp_path}/no"])


@pytest.fixture(scope="module")
def two_sided(spark):
    """y is 1 where x is over 10; partition 1 has it the other way round; the last partition is too small for a model."""
    rows = [(i, i % 20, float(i % 20), 0.0, int(i % 20 > 10) if part == 0 else int(i % 20 <= 10), part, int(i // 20 % 5 == 0)) for part in (0, 1) for i in range(part * 400, part * 400 + 400)]
    rows += [(9_000 + i, i, float(i), 0.0, int(i > 10), 2, 0) for i in range(20)]
    return spark.createDataFrame(rows, "id int, unit int, x double, z double, y int, part_id int, set int")


def test_tree_table_and_rules(spark, two_sided):
    df = two_sided.where("part_id = 0")
    model = models.fitted(df, ["z", "x"], "tree", depth=4)
    nodes = models.node_frame(spark, model, ["z", "x"]).orderBy("id").collect()
    assert len(nodes[0]) == 15
    assert [(r["parent"], r["left"], r["right"], r["feature_index"], r["samples"], r["confidence"]) for r in nodes] == [(-1, 1, 2, 1, 400, 0.55), (0, -1, -1, -1, 220, 1.0), (0, -1, -1, -1, 180, 1.0)]
    assert 10 <= nodes[0]["threshold"] < 11 and nodes[1]["class_distribution"] == '{"0": 220.0, "1": 0.0}'
    rules = [(r["rule"], r["class"], r["confidence"], r["samples"]) for r in models.tree_rules(model, ["z", "x"]).collect()]
    t = f"{nodes[0]['threshold']:.6f}"
    assert rules == [(f"x <= {t}", 0, 1.0, 220), (f"x > {t}", 1, 1.0, 180)]
    one = models.fitted(df.where("y = 1"), ["z"], "tree")
    assert [r["rule"] for r in models.tree_rules(one, ["z"]).collect()] == ["ROOT"]


def test_partitions_have_models_of_their_own(two_sided):
    out = models.partitioned_fit(two_sided, ["x"], "part_id", "tree", depth=3)
    r = {(r["part_id"]): (r["n"], r["hits"], r["same"]) for r in out.groupBy("part_id").agg(F.count("*").alias("n"), F.sum((F.col("part") == F.col("y")).cast("int")).alias("hits"), F.sum((F.col("part") == F.col("pooled")).cast("int")).alias("same")).collect()}
    assert r[0] == (400, 400, r[0][2]) and r[1] == (400, 400, r[1][2]) and r[2][2] == r[2][0] == 20


@pytest.mark.parametrize(("kind", "params"), [("forest", {"trees": 5, "depth": 4}), ("boosted", {"trees": 3, "depth": 3}), ("logistic", {}), ("tree", {"depth": 3})])
def test_kinds_of_models_learn_a_threshold(two_sided, kind, params):
    out = models.fit_predict(two_sided.where("part_id = 0"), ["x"], kind, **params).where("set = 1")
    assert out.where("p = y").count() == out.count() > 0


def test_second_layer_flips_what_the_first_gets_wrong(two_sided):
    both = two_sided.where("part_id < 2").withColumn("part", F.col("part_id").cast("double")).withColumn("y", F.expr("cast(x > 10 and (part_id = 0 or x <= 15) as int)"))
    out = models.two_layer(both, ["x"], ["x", "part"], "tree", depth=4).where("set = 1")
    assert out.where("p <> y").count() == 0 and out.where("(wrong = 1) <> (p1 <> y)").count() == 0 and out.where("wrong = 1").count() > 0


def test_depth_and_routes(two_sided):
    band = two_sided.withColumn("y", F.expr("cast(x between 5 and 12 as int)"))  # takes two cuts
    assert models.choose_depth(band, ["x"], (1, 2, 5)) == 2
    zero, one = (models.fitted(two_sided.where(f"part_id = {k}"), ["x"], "tree", depth=2) for k in (0, 1))
    branches = two_sided.where("unit < 10").select(F.col("unit").alias("g")).distinct().withColumn("branch_id", F.lit("1"))
    out = models.routed(two_sided.withColumnRenamed("unit", "g"), branches, {"": zero, "1": one}, ["x"], "g")
    assert out.where("branch_id = '1' and p <> cast(x <= 10 as int) or branch_id = '' and p <> cast(x > 10 as int)").count() == 0
    assert out.select("branch_id").distinct().count() == 2


def test_out_of_fold_predictions_see_none_of_their_unit(spark):
    # a unit's number tells its class, and no other unit's does: what a fold's model says of a unit comes from others
    rows = [(u, float(u), int(u >= 5)) for u in range(10) for _ in range(20)]
    df = spark.createDataFrame(rows, "unit int, x double, y int")
    out = models.oof_predictions(df, ["x"], "unit", folds=5, depth=3)
    assert out.count() == 200 and out.groupBy("unit").agg(F.count_distinct("fold").alias("n")).where("n > 1").count() == 0
    assert out.where("unit in (0, 9) and p <> y").count() == 0


def test_power_iteration_without_edges(spark):
    graph = spark.createDataFrame([], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(1,), (2,)], "unit long")
    assert consensus.power_iteration_labels(graph, 3).count() == 0
    assert sorted(map(tuple, consensus.power_iteration_labels(graph, 3, nodes).collect())) == [(1, -1), (2, -1)]
    some = spark.createDataFrame([(1, 2, 1.0), (2, 1, 1.0)], "src long, dst long, weight double")
    nodes = spark.createDataFrame([(1,), (2,), (3,)], "unit long")
    found = {r["unit"]: r["label"] for r in consensus.power_iteration_labels(some, 2, nodes).collect()}
    assert set(found) == {1, 2, 3} and found[3] == -1 and min(found[1], found[2]) >= 0


def test_consensus_map_without_a_plan_that_beats_its_base(spark):
    rows = [("p", u, "1", 0.3, 0.6) for u in (3, 5, 9)]
    plans = spark.createDataFrame(rows, "plan string, unit long, partition_id string, f1 double, f1_base double")
    units = spark.createDataFrame([(3, 0.0, 0.0), (5, 0.0, 50.0), (9, 4.0, 4.0)], "unit long, lat double, lon double")
    assert sorted(map(tuple, consensus.consensus_map(plans, units, clusters=4).collect())) == [(3, 0, False), (5, 0, True), (9, 0, True)]
    assert consensus.consensus_map(plans.where("unit < 0"), units, clusters=4).count() == 0
    with pytest.raises(ValueError, match="no coordinates"):
        consensus.consensus_map(plans, units.where("unit <> 5"), clusters=4)
