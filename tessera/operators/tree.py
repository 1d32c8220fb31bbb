"""Partition trees: branch labels are binary paths, the root's is empty, and deeper branches win."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import spatial


def initial_state(df: DataFrame, key: str, group: str) -> DataFrame:
    """Rows with an empty branch, ready for ``set`` and splits."""
    return df.withColumn("row_id", F.col(key)).withColumn("branch_id", F.lit("")).withColumn("group_id", F.col(group))


def node_rows(df: DataFrame, branch: str, part: int | None = None) -> DataFrame:
    """The rows of a node, perhaps only those of one set."""
    rows = df.where(F.col("branch_id") == branch)
    return rows if part is None else rows.where(F.col("set") == part)


def relabelled(df: DataFrame, ids: DataFrame, key: str, branch: str) -> DataFrame:
    """Rows with these ids in another branch."""
    j = df.join(ids.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left")
    return j.withColumn("branch_id", F.when(F.col("__k").isNotNull(), F.lit(branch)).otherwise(F.col("branch_id"))).drop("__k")


def split_rows(df: DataFrame, sides: DataFrame, group: str) -> DataFrame:
    """Rows moved to the child of their group's side; groups without a side go to side 0."""
    j = df.join(sides.select(F.col(group).alias("__g"), "side"), F.col(group) == F.col("__g"), "left")
    return j.withColumn("branch_id", F.concat("branch_id", F.coalesce("side", F.lit(0)).cast("string"))).drop("__g", "side")


def recombined(side0: DataFrame, side1: DataFrame) -> DataFrame:
    return side0.unionByName(side1)


def deepest_branch(table: DataFrame, group: str = "group_id") -> DataFrame:
    """(group, branch_id): of all branches that hold a group the deepest, ties to the larger path."""
    return table.groupBy(group).agg(F.max_by("branch_id", F.struct(F.length("branch_id"), F.col("branch_id"))).alias("branch_id"))


def hit_scores(df: DataFrame, p: str, y: str = "y") -> DataFrame:
    """1 for a hit and 0 for a miss, of the rows whose true class is 1."""
    return df.where(F.col(y) == 1).select("*", (F.col(p) == 1).cast("double").alias("score"))


def keep_parent(child: DataFrame, parent: DataFrame, key: str = "branch_id") -> DataFrame:
    """(branch_id, model_branch): a child whose F1 doesn't beat its parent's uses the parent's model."""
    p = parent.select(F.col(key).alias("__p"), F.col("f1").alias("f1_parent"))
    up = F.expr("substring(branch_id, 1, length(branch_id) - 1)")
    j = child.select(key, "f1", up.alias("up")).join(p, F.col("up") == F.col("__p"), "left")
    return j.select(key, F.when(F.coalesce(F.col("f1") > F.col("f1_parent"), F.lit(True)), F.col(key)).otherwise(F.col("up")).alias("model_branch"))


def valid_node(df: DataFrame, least: int = 0) -> bool:
    """Whether a node has at least ``least`` rows (and any)."""
    return df.limit(max(1, least)).count() >= max(1, least)


def grow(df: DataFrame, group: str, fit: Callable[[DataFrame], DataFrame], edges: DataFrame | None = None, min_depth: int = 1, max_depth: int = 3, least: int = 0) -> DataFrame:
    """(group_id, branch_id): split nodes breadth first by the scan statistic of the misses of ``fit``.

    ``fit`` takes a node's rows (``y``, ``set``) and returns them with ``p``, predictions of a model fitted on set 0. A
    split is kept if the class-1 test accepts it on the validation rows, or above ``min_depth`` in any case.
    """
    state = df.select("*", F.lit("").alias("branch_id")) if "branch_id" not in df.columns else df
    frontier, done = [""], []
    for depth in range(max_depth - 1):
        following = []
        for branch in frontier:
            node = spatial.materialised(fit(node_rows(state, branch)).select(*df.columns, "branch_id", "p"), "node")
            groups = node.select(group).distinct().limit(2).count()
            if not valid_node(node, least) or groups < 2:
                done.append(node.select(group, "branch_id").distinct())
                continue
            cb = spatial.materialised(spatial.observed_expected(node.where("set = 1"), group), "stat")
            sides = spatial.scan(cb, group).select(group, "side")
            if edges is not None:
                sides = spatial.smoothed(sides, edges, 1, group, "side")
            moved = spatial.materialised(split_rows(node.withColumnRenamed("p", "base"), sides, group), "split")
            children = [fit(moved.where(F.col("branch_id") == branch + s)) for s in "01"]
            judged = recombined(*children)
            keep = depth < min_depth or spatial.class_one_test(judged.where("set = 1"), "p", "base").first()["accept"]
            if keep:
                following += [branch + "0", branch + "1"]
                state = spatial.materialised(state.where(F.col("branch_id") != branch).unionByName(moved.select(*state.columns)), "state")
            else:
                done.append(node.select(group, "branch_id").distinct())
        frontier = following
        if not frontier:
            break
    out = state.where(F.col("branch_id").isin(*frontier)).select(group, "branch_id").distinct() if frontier else None
    for x in done:
        out = x if out is None else out.unionByName(x)
    return out


def expected_terminals(rounds: DataFrame, depth: int) -> DataFrame:
    """(unit, terminal) from per-branch flags (branch_id, unit, side): a unit that a round leaves out stays where it was."""
    cur = rounds.select("unit").distinct().withColumn("terminal", F.lit(""))
    for _ in range(depth):
        step = rounds.select(F.col("branch_id").alias("b"), F.col("unit").alias("u"), "side")
        j = cur.join(step, (F.col("unit") == F.col("u")) & (F.col("terminal") == F.col("b")), "left")
        cur = j.select("unit", F.concat("terminal", F.coalesce(F.col("side").cast("string"), F.lit(""))).alias("terminal"))
    return cur


def scope_audit(rounds: DataFrame) -> DataFrame:
    """(branch_id, in_scope, from_parent, extra, lost): a branch's units against those its parent gave it."""
    scope = rounds.where("branch_id <> ''").select("branch_id", "unit", F.lit(1).alias("s"))
    given = rounds.select(F.concat("branch_id", F.col("side").cast("string")).alias("branch_id"), "unit", F.lit(1).alias("g")).join(scope.select("branch_id").distinct(), "branch_id", "left_semi")
    j = scope.join(given, ["branch_id", "unit"], "full")
    n = lambda c: F.sum(c.cast("bigint"))
    return j.groupBy("branch_id").agg(n(F.col("s").isNotNull()).alias("in_scope"), n(F.col("g").isNotNull()).alias("from_parent"), n(F.col("g").isNull()).alias("extra"), n(F.col("s").isNull()).alias("lost"))


def branch_correspondence(units: DataFrame, side0: DataFrame, side1: DataFrame, branch: str, full: bool = False) -> DataFrame:
    """(unit, partition_id) of one branch's children; ``full`` adds all other units with a null partition."""
    label = lambda df, s: df.select("unit", F.lit(branch + s).alias("partition_id"))
    both = label(side0, "0").unionByName(label(side1, "1"))
    return units.select("unit").join(both, "unit", "left") if full else both


def raster_blocks(spark, rows: int, columns: int, step: int) -> DataFrame:
    """(row, col, block): pixels with their block; the last blocks may be ragged."""
    across = -(-columns // step)
    grid = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("int").alias("row"), (F.col("id") % columns).cast("int").alias("col"))
    return grid.withColumn("block", (F.floor(F.col("row") / step) * across + F.floor(F.col("col") / step)).cast("bigint"))


def branch_of_location(points: DataFrame, raster: DataFrame, step: float) -> DataFrame:
    """The branch of a raster cell for each point."""
    at = points.select("*", F.floor(F.col("lat") / step).cast("int").alias("row"), F.floor(F.col("lon") / step).cast("int").alias("col"))
    return at.join(raster.select("row", "col", "branch_id"), ["row", "col"], "left").withColumn("branch_id", F.coalesce("branch_id", F.lit(""))).drop("row", "col")


def group_performance(df: DataFrame, group: str) -> DataFrame:
    """(branch_id, group, class, n, f1_base, f1_split, diff) of pooled and branch predictions."""
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col("y") == k).cast("int").alias("t"), (F.col("pooled") == k).cast("int").alias("a"), (F.col("part") == k).cast("int").alias("b")) for k in (0, 1)])).alias("e")
    e = df.select("branch_id", group, each).select("branch_id", group, "e.*")
    f1 = lambda c: F.coalesce(F.try_divide(2.0 * F.sum(F.col("t") * F.col(c)), (F.sum("t") + F.sum(c)).cast("double")), F.lit(0.0))
    return e.groupBy("branch_id", group, "class").agg(F.sum("t").alias("n"), f1("a").alias("f1_base"), f1("b").alias("f1_split")).withColumn("diff", F.col("f1_split") - F.col("f1_base"))


