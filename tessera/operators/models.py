"""Per-partition models on pyspark.ml: fitting, routing, balancing, rules."""

from __future__ import annotations

import json
import re

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_DEPTH = 30  # fixed value: the deepest tree that pyspark.ml takes
DEPTHS = (3, 5, 7, 10, 15, 20, None)
LEAST_ROWS = 50


def classifier(kind: str, seed: int = 5, **params):
    """``forest``, ``tree``, ``boosted`` or ``logistic`` with the pipeline's defaults.

    Boosting has no L1 or L2 term here; depth None is ``MAX_DEPTH``.
    """
    depth = params.pop("depth", None)
    common = {"featuresCol": "features", "labelCol": "y", "predictionCol": "p"}
    if kind == "forest":
        return RandomForestClassifier(numTrees=params.pop("trees", 100), maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), seed=seed, **common, **params)
    if kind == "tree":
        return DecisionTreeClassifier(maxDepth=min(depth or MAX_DEPTH, MAX_DEPTH), seed=seed, **common, **params)
    if kind == "boosted":
        return GBTClassifier(maxIter=params.pop("trees", 100), maxDepth=depth or 6, stepSize=0.1, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed, **common, **params)
    if kind == "logistic":
        return LogisticRegression(maxIter=1000, regParam=params.pop("regularisation", 0.0), elasticNetParam=0.0, **common, **params)
    raise ValueError(kind)


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="features", handleInvalid="skip").transform(df)


def fitted(df: DataFrame, features: list[str], kind: str = "tree", **params):
    return classifier(kind, **params).fit(assembled(df.withColumn("y", F.col("y").cast("double")), features))


def predicted(model, df: DataFrame, features: list[str]) -> DataFrame:
    """Rows with ``p`` (int) and nothing else new."""
    out = model.transform(assembled(df, features))
    return out.select(*df.columns, F.col("p").cast("int").alias("p"))


def fit_predict(df: DataFrame, features: list[str], kind: str = "tree", **params) -> DataFrame:
    """Fit on set 0 and predict all; with one class in training that class is the prediction."""
    train = df.where("set = 0")
    s = train.agg(F.min("y").alias("lo"), F.max("y").alias("hi")).first()
    if s["lo"] is None or s["lo"] == s["hi"]:
        return df.drop("p").withColumn("p", F.lit(s["lo"] if s["lo"] is not None else 0).cast("int"))
    return predicted(fitted(train, features, kind, **params), df.drop("p"), features)


def partitioned_fit(df: DataFrame, features: list[str], partition: str, kind: str = "tree", least: int = LEAST_ROWS, **params) -> DataFrame:
    """Rows with ``pooled`` and ``part``: a model for all and one for each partition.

    A partition with under ``least`` training rows, with one class, or unmapped (-1) takes the pooled prediction. The
    number of partitions bounds the loop; each is one fit on its own rows.
    """
    pooled_model = fitted(df.where("set = 0"), features, kind, **params)
    pooled = predicted(pooled_model, df, features).withColumnRenamed("p", "pooled")
    stats = df.where("set = 0").groupBy(partition).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("y").alias("k")).collect()
    usable = sorted(r[partition] for r in stats if r["n"] >= least and r["k"] > 1 and str(r[partition]) != "-1")
    out = pooled.where(~F.coalesce(F.col(partition).isin(*usable), F.lit(False)) if usable else F.lit(True)).withColumn("part", F.col("pooled"))
    for value in usable:
        mine = pooled.where(F.col(partition) == value)
        model = fitted(df.where((F.col("set") == 0) & (F.col(partition) == value)), features, kind, **params)
        out = out.unionByName(predicted(model, mine, features).withColumnRenamed("p", "part"))
    return out


def routed(df: DataFrame, branches: DataFrame, models: dict, features: list[str], group: str = "group_id") -> DataFrame:
    """Each row by its group's branch's model; a group unknown to the map goes to the root's."""
    j = df.join(branches.select(F.col(group).alias("__g"), F.col("branch_id").alias("__b")), F.col(group) == F.col("__g"), "left")
    j = j.withColumn("__b", F.coalesce("__b", F.lit(""))).drop("__g")
    out = None
    for branch, model in sorted(models.items()):
        part = predicted(model, j.where(F.col("__b") == branch), features)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("__b", "branch_id")


def two_layer(df: DataFrame, first: list[str], second: list[str], kind: str = "tree", **params) -> DataFrame:
    """A second model predicts where the first is wrong, and flips it there: ``p1``, ``wrong``, ``p``."""
    one = fit_predict(df, first, kind, **params).withColumnRenamed("p", "p1")
    errors = one.select("*", F.col("y").alias("__y")).withColumn("y", (F.col("p1") != F.col("__y")).cast("int"))
    two = fit_predict(errors, [*second, "p1"], kind, **params).withColumn("y", F.col("__y")).drop("__y").withColumnRenamed("p", "wrong")
    return two.withColumn("p", F.when(F.col("wrong") == 1, 1 - F.col("p1")).otherwise(F.col("p1")))


def choose_depth(df: DataFrame, features: list[str], depths=DEPTHS, kind: str = "tree"):
    """The depth with the best class-1 F1 on set 1."""
    from tessera.functions.settings import best_depth
    from tessera.operators.metrics import confusion, prf

    scores = []
    for d in depths:
        m = prf(fit_predict(df, features, kind, depth=d).where("set = 1").agg(*confusion()), "zero").first()
        scores.append((d, m["f1"]))
    return best_depth(scores)


def oof_predictions(df: DataFrame, features: list[str], unit: str, folds: int = 5, kind: str = "tree", **params) -> DataFrame:
    """Every row predicted by a model that saw none of its unit."""
    from tessera.operators.splits import group_folds

    placed = df.drop("set").join(group_folds(df, unit, folds=folds).select(unit, "fold"), unit)
    out = None
    for f in range(folds):
        part = fit_predict(placed.withColumn("set", (F.col("fold") == f).cast("int")), features, kind, **params).where("set = 1")
        out = part if out is None else out.unionByName(part)
    return out


def smote(df: DataFrame, features: list[str], by: str, k: int = 5, seed: int = 5, cell_rows: int = 5_000) -> DataFrame:
    """The rows of each partition and new ones between minority rows and near minority rows, until the classes are even.

    Nothing is added where a partition has one class or under two minority rows. Minority rows meet in cells of bounded
    size, dealt by a hash; so no task takes a whole large partition.
    """
    counts = df.groupBy(by, "y").agg(F.count(F.lit(1)).alias("n"))
    s = counts.groupBy(by).agg(F.min_by("y", F.struct("n", "y")).alias("minority"), F.min("n").alias("least"), F.max("n").alias("most"), F.count(F.lit(1)).alias("classes")).where("classes = 2 and least >= 2 and most > least")
    s = s.withColumn("cells", F.ceil(F.col("least") / cell_rows).cast("int"))
    few = df.join(s, by).where(F.col("y") == F.col("minority")).withColumn("cell", F.pmod(F.xxhash64(*features), F.col("cells")))
    few = few.withColumn("share", (F.col("most") - F.col("least")) / F.col("least"))
    schema = df.select(by, *features, "y").schema

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(features)
        x = rows[features].to_numpy(float)
        wanted = int(round(len(x) * float(rows["share"].iloc[0])))
        near = min(k, len(x) - 1)
        if wanted <= 0 or near < 1:
            return pd.DataFrame({c.name: [] for c in schema}).astype({c.name: object for c in schema})
        rng = np.random.default_rng([seed, len(x), int(rows["cell"].iloc[0])])
        order = [np.argsort(((x - v) ** 2).sum(1), kind="stable")[1 : near + 1] for v in x]
        a = np.arange(wanted) % len(x)
        b = np.array([order[i][rng.integers(near)] for i in a])
        new = x[a] + rng.random(wanted)[:, None] * (x[b] - x[a])
        out = pd.DataFrame(new, columns=features)
        out[by], out["y"] = rows[by].iloc[0], rows["y"].iloc[0]
        return out[[c.name for c in schema]]

    made = few.select(by, *features, "y", "share", "cell").groupBy(by, "cell").applyInPandas(fill, schema)
    return df.select(by, *features, "y", F.lit(False).alias("synthetic")).unionByName(made.withColumn("synthetic", F.lit(True)))


def kmeans_labels(df: DataFrame, columns: list[str], k: int, seed: int = 42, scale: bool = True) -> DataFrame:
    """Rows with ``label``; columns standardised unless told otherwise, nulls as 0."""
    v = VectorAssembler(inputCols=columns, outputCol="raw").transform(df.fillna(0.0, subset=columns))
    v = StandardScaler(inputCol="raw", outputCol="vector", withMean=True).fit(v).transform(v) if scale else v.withColumnRenamed("raw", "vector")
    model = KMeans(k=k, seed=seed, featuresCol="vector", predictionCol="label").fit(v)
    return model.transform(v).select(*df.columns, F.col("label").cast("int").alias("label"))


def unit_profiles(df: DataFrame, unit: str, columns: list[str]) -> DataFrame:
    """Mean and sample deviation of each column by unit."""
    return df.groupBy(unit).agg(*[f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_samp))])


def node_table(model, features: list[str]) -> list[dict]:
    """A row for each node, numbered from the root with left sides first. Bounded by the tree's size.

    ``counts`` are weighted by class, ``samples`` are rows; a leaf's children and feature_index are -1, the root's parent.
    """
    rows: list[dict] = []
    todo = [(model._java_obj.rootNode() if hasattr(model, "_java_obj") else model._call_java("rootNode"), -1, "", 0)]
    while todo:
        node, parent, side, depth = todo.pop()
        stats, leaf, i = node.impurityStats(), node.subtreeDepth() == 0, len(rows)
        counts = [float(x) for x in stats.stats()]
        total, index = sum(counts), -1 if leaf else int(node.split().featureIndex())
        rows.append({"id": i, "parent": parent, "depth": depth, "leaf": leaf, "left": -1, "right": -1, "feature_index": index, "feature": None if leaf else features[index], "threshold": None if leaf else float(node.split().threshold()), "impurity": float(node.impurity()), "samples": int(stats.rawCount()), "weighted_samples": total, "prediction": float(node.prediction()), "confidence": round(max(counts) / total, 4) if total else 0.0, "counts": counts})
        if side:
            rows[parent][side] = i
        if not leaf:
            todo += [(node.rightChild(), i, "right", depth + 1), (node.leftChild(), i, "left", depth + 1)]
    return rows


def node_frame(spark, model, features: list[str]) -> DataFrame:
    """The node table with its classes' weights as text of JSON."""
    rows = [{**{k: v for k, v in r.items() if k != "counts"}, "class_distribution": json.dumps({str(k): x for k, x in enumerate(r["counts"])})} for r in node_table(model, features)]
    kinds = {"leaf": "boolean", "feature": "string", "class_distribution": "string", **dict.fromkeys(("threshold", "impurity", "weighted_samples", "prediction", "confidence"), "double"), "samples": "bigint"}
    names = list(rows[0])
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} {kinds.get(n, 'int')}" for n in names))


def tree_rules(model, features: list[str]) -> DataFrame:
    """(rule, class, confidence, samples, conditions) of each leaf, most samples first; a tree of one leaf has rule ROOT."""
    nodes = node_table(model, features)
    paths: list[list[str]] = [[]]
    for r in nodes[1:]:  # a parent comes before its children
        up = nodes[r["parent"]]
        paths.append([*paths[r["parent"]], f"{up['feature']} {'<=' if up['left'] == r['id'] else '>'} {up['threshold']:.6f}"])
    leaves = sorted((r for r in nodes if r["leaf"]), key=lambda r: (-r["samples"], r["id"]))
    out = [(" AND ".join(paths[r["id"]]) or "ROOT", int(r["prediction"]), r["confidence"], r["samples"], paths[r["id"]]) for r in leaves]
    return SparkSession.active().createDataFrame(out, "rule string, class int, confidence double, samples bigint, conditions array<string>")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, [float(x) for x in model.featureImportances.toArray()], strict=True), key=lambda x: (-x[1], x[0]))


def probability(model, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(assembled(df, features))
    return out.select(*df.columns, vector_to_array("probability")[1].alias("score"))


def checkpoint_name(name: str) -> str:
    """A model file's name from any path and suffix: ``tree_<branch>``, the root without a branch."""
    m = re.search(r"([01]*)(?:\.[A-Za-z]+)?$", name.rsplit("/", 1)[-1])
    return f"tree_{m[1]}" if m and m[1] else "tree_"


ADAPTERS = {"gf": "forest", "xgb": "boosted", "dt": "tree"}


def adapter(name: str, **params):
    """The model of a short name, fitted and predicted in one way."""
    kind = ADAPTERS[name]
    return lambda df, features: fit_predict(df, features, kind, **params)
