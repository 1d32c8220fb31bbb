"""Connected components of an edge table by alternating star contractions.

Edges that fit one task, by a bound, take one union there. Beyond it every round is a few equi-joins and aggregations; edges stay distributed and each round is written to the shared
folder, which cuts the lineage. Before the first round each task replaces its own edges by a spanning forest, so a node
with very many edges arrives with at most one edge from each task to each of its local roots.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import forget, lean, written


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) for the edges of one task."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            further = new[new]
            if (further == new).all():
                break
            new = further
        if (new == root).all():
            return nodes, nodes[root]
        root = new


#: So many edges (16 bytes each) are joined in one task.
ONE_TASK = 1_000_000


def _stars(batches):
    """The nodes of all edges of one task with their components."""
    a, b = [], []
    for batch in batches:
        a.append(np.asarray(batch.column(0), np.int64))
        b.append(np.asarray(batch.column(1), np.int64))
    if a:
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "component"])


def _forest(batches):
    a, b = [], []
    size = 0

    def flush():
        nodes, roots = local_roots(np.concatenate(a), np.concatenate(b))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])

    for batch in batches:
        a.append(np.asarray(batch.column(0), np.int64))
        b.append(np.asarray(batch.column(1), np.int64))
        size += batch.num_rows
        if size > 2_000_000:
            yield flush()
            a, b, size = [], [], 0
    if size:
        yield flush()


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """``(node, component)`` for every node of ``edges`` (its first two columns, long), component its smallest node.

    Self-loops and repeated edges change nothing; rows with a null end are left out; an empty table gives an empty one.
    """
    first, second = edges.columns[:2]
    e = edges.select(F.col(first).cast("long").alias("a"), F.col(second).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    cur = written(e.mapInArrow(lean(_forest), "a long, b long"), "edges")
    if cur.count() <= one_task:
        return cur.coalesce(1).mapInArrow(lean(_stars), "node long, component long")
    cur = written(cur.distinct(), "edges")

    def state(df):
        r = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        return r["n"], r["h"]

    seen = state(cur)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        # large star: neighbours above a node move to the smallest node near it
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        nxt = written(small, "edges")
        now = state(nxt)
        forget(cur)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not converge")
    return cur.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
