"""Nearest neighbours by cross-polytope hashing and an exact scan for what the hashes leave open.

A hash rotates a unit vector by three rounds of random signs and a fast Hadamard transform and takes the signed axis
nearest to it; one more hash with fewer axes sets the number of buckets of a table to about a row count over
``bucket_rows``. Queries probe, besides their own, the buckets of the next-nearest axes. What shares a probed bucket is
ranked by the exact distance of the original vectors. The probed buckets of a table also give a distance under which no
other bucket has a vector. Queries with fewer than k found, or whose k-th lies no nearer than that, are held against all
vectors, in blocks of queries; so the result is exact whatever the hashes do, and they only spare scans.

Equal vectors are one class, of which only the smallest ids can be among the nearest, so large groups of copies cost no
more than one vector. Buckets over a bound are dealt to several tasks. All rows are indexed; nothing is fitted.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import column_of, lean, partitions, table, written

CHUNK = 4096


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform along the last axis (a power of two), scaled to keep lengths."""
    n = x.shape[-1]
    h = 1
    while h < n:
        y = x.reshape(*x.shape[:-1], n // (2 * h), 2, h)
        x = np.concatenate([y[..., :1, :] + y[..., 1:, :], y[..., :1, :] - y[..., 1:, :]], axis=-2).reshape(x.shape)
        h *= 2
    return x / np.sqrt(n)


class Tables:
    """Hash functions for vectors of one dimension."""

    def __init__(self, dim: int, tables: int, buckets: int, seed: int = 11):
        self.size = 1 << max(1, (dim - 1).bit_length())
        per = 2 * self.size
        full = max(1, int(np.log(max(buckets, per)) / np.log(per) + 1e-9))
        rest = buckets / per**full
        last = 1 << int(np.log2(rest)) if rest >= 2 else 1  # buckets of the last, smaller hash
        self.axes = [self.size] * full + ([last // 2] if last > 1 else [])
        rng = np.random.default_rng([seed, dim])
        self.signs = rng.choice([-1.0, 1.0], (tables, len(self.axes), 3, self.size))
        self.tables = tables

    def scores(self, unit: np.ndarray, t: int) -> list[np.ndarray]:
        """Of each hash of table t: how near each signed axis is."""
        x = np.zeros((len(unit), self.size))
        x[:, : unit.shape[1]] = unit
        out = []
        for axes, s in zip(self.axes, self.signs[t], strict=True):
            y = hadamard(hadamard(hadamard(x * s[0]) * s[1]) * s[2])[:, :axes]
            out.append(np.concatenate([y, -y], 1))
        return out

    def codes(self, unit: np.ndarray, t: int) -> np.ndarray:
        code = np.zeros(len(unit), np.int64)
        for s in self.scores(unit, t):
            code = code * s.shape[1] + s.argmax(1)
        return code

    def probes(self, unit: np.ndarray, t: int, number: int) -> tuple[list[np.ndarray], np.ndarray]:
        """The buckets of each row that lose least against its own, its own first, and how near the others may come.

        What is in the bucket of axis a has that coordinate as its largest, so its distance to a row is at least the row's
        loss there over the root of 2; of several hashes one has at least the mean of the squared losses.
        """
        code, loss = np.zeros((len(unit), 1), np.int64), np.zeros((len(unit), 1))
        for s in self.scores(unit, t):
            k = min(number, s.shape[1])
            best = np.argsort(-s, axis=1, kind="stable")[:, :k]
            top = np.take_along_axis(s, best, 1)
            part = (top[:, :1] - top) ** 2
            code = (code[:, :, None] * s.shape[1] + best[:, None, :]).reshape(len(unit), -1)
            loss = (loss[:, :, None] + part[:, None, :]).reshape(len(unit), -1)
            keep = np.argsort(loss, axis=1, kind="stable")[:, :number]
            code, loss = np.take_along_axis(code, keep, 1), np.take_along_axis(loss, keep, 1)
        every = code.shape[1] == np.prod([2.0 * a for a in self.axes])
        return list(code), np.full(len(unit), np.inf) if every else np.sqrt(loss[:, -1] / (2 * len(self.axes)))


def valid_vectors(batch: pa.RecordBatch):
    """(ids, vectors as rows of doubles) by dimension, of the vectors that take part."""
    ids, column = column_of(batch, "vec_id"), column_of(batch, "embedding")
    by_size: dict[int, tuple[list, list]] = {}
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    ids = ids.to_pylist()
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if size <= 0:
            continue
        flat = column.take(pa.array(at)).flatten()
        x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(at), size) + 0.0  # no minus zero
        ok = np.isfinite(x).all(1) & (x != 0).any(1) & np.array([ids[i] is not None for i in at], bool)
        if ok.any():
            by_size[int(size)] = [ids[i] for i in at[ok]], x[ok]
    return by_size.items()


def _key(row: np.ndarray) -> bytes:
    return hashlib.blake2b(row.tobytes(), digest_size=16).digest()


def _classes_of_task(most: int):
    """(key, vector, id): of equal vectors in a task only the ``most`` smallest ids."""

    def run(batches):
        held: dict[bytes, tuple[bytes, list]] = {}

        def flush():
            rows = [(k, v, i) for k, (v, ids) in held.items() for i in ids]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], ["key", "vector", "id"])

        for b in batches:
            for _, (ids, x) in valid_vectors(b):
                for i, row in zip(ids, x, strict=True):
                    k = _key(row)
                    if k not in held:
                        held[k] = row.tobytes(), []
                    mine = held[k][1]
                    if i not in mine:
                        mine.append(i)
                        if len(mine) > most:
                            mine.remove(max(mine))
            if len(held) > 50_000:
                yield flush()
        if held:
            yield flush()

    return run


def _queries_of(batches):
    for b in batches:
        out = [(i, _key(row)) for _, (ids, x) in valid_vectors(b) for i, row in zip(ids, x, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.binary())], ["query_id", "key"])


def _unit(vecs: list, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 and the lengths before."""
    x = np.frombuffer(b"".join(vecs)).reshape(len(vecs), size)
    # scaled first, so that no square leaves the range of doubles
    most = np.abs(x).max(1)
    unit = x / most[:, None]
    length = np.sqrt((unit**2).sum(1))
    with np.errstate(over="ignore"):
        return unit / length[:, None], np.minimum(most * length, np.finfo(float).max)


def _hashed(tables: int, buckets: int, probes: int, vectors: bool):
    """A row for each table and bucket of a class, or for each probed bucket (probes > 0)."""

    def run(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            reps, vecs = column_of(b, "rep").to_pylist(), column_of(b, "vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), CHUNK):
                    part = at[lo : lo + CHUNK]
                    unit, _ = _unit([vecs[i] for i in part], size)
                    h = made.setdefault(int(size), Tables(int(size), tables, buckets))
                    for t in range(tables):
                        codes = h.probes(unit, t, probes)[0] if probes else h.codes(unit, t)[:, None]
                        n = [len(c) for c in codes]
                        rows = np.repeat(part, n)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size), pa.int32()), pa.array(np.full(len(rows), t), pa.int32()), pa.array(np.concatenate(list(codes)), pa.int64()), pa.array([reps[i] for i in rows], pa.int64()), *([pa.array([vecs[i] for i in rows], pa.binary())] if vectors else [])], ["dim", "t", "bucket", "rep", "vector"][: 4 + vectors])

    return run


def _reach(tables: int, buckets: int, probes: int):
    """Of each class a distance under which nothing is outside its probed buckets."""

    def run(batches):
        made: dict[int, Tables] = {}
        for b in batches:
            reps, vecs = column_of(b, "rep").to_pylist(), column_of(b, "vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in vecs])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                for lo in range(0, len(at), CHUNK):
                    part = at[lo : lo + CHUNK]
                    unit, length = _unit([vecs[i] for i in part], size)
                    h = made.setdefault(int(size), Tables(int(size), tables, buckets))
                    far = np.max([h.probes(unit, t, probes)[1] for t in range(tables)], axis=0)
                    far = np.maximum(far - 1e-9, 0) * length  # rounding
                    yield pa.RecordBatch.from_arrays([pa.array([reps[i] for i in part], pa.int64()), pa.array(far, pa.float64())], ["q", "reach"])

    return run


def _scanned(held, k: int):
    """Of each query of a broadcast block the k nearest classes among a task's; what is beyond its ``cut`` is left out."""

    def run(batches):
        blocks, found = {}, {}
        for size, (reps, y, cut) in held.value.items():
            blocks[size] = reps, y, (y**2).sum(1), cut.copy()
        for b in batches:
            reps, vecs = np.asarray(column_of(b, "rep")), column_of(b, "vector").to_pylist()
            sizes = np.array([len(v) // 8 for v in vecs])
            for size in np.unique(sizes):
                if size not in blocks:
                    continue
                at = np.flatnonzero(sizes == size)
                queries, ys, yy, cut = blocks[size]
                for lo in range(0, len(at), CHUNK):
                    part = at[lo : lo + CHUNK]
                    x, mine = np.frombuffer(b"".join(vecs[i] for i in part)).reshape(len(part), size), reps[part]
                    xx = (x**2).sum(1)
                    for q0 in range(0, len(queries), 512):
                        y, some = ys[q0 : q0 + 512], slice(q0, q0 + 512)
                        both = xx[:, None] + yy[some]
                        # squares that rounding can only make smaller; what isn't a number may be near
                        low = both - 2 * (x @ y.T) - 1e-9 * both
                        may = ~(low > cut[some] ** 2 * (1 + 1e-9))
                        for j in np.flatnonzero(may.any(0)):
                            near = np.flatnonzero(may[:, j])
                            near = near[mine[near] != queries[q0 + j]]
                            d = np.sqrt(((x[near] - y[j]) ** 2).sum(1))
                            d0, r0 = found.get((size, q0 + j), (np.zeros(0), np.zeros(0, np.int64)))
                            ok = d <= cut[q0 + j]
                            d, r = np.concatenate([d0, d[ok]]), np.concatenate([r0, mine[near[ok]]])
                            order = np.lexsort((r, d))[:k]
                            found[size, q0 + j] = d[order], r[order]
                            if len(order) == k:
                                cut[q0 + j] = min(cut[q0 + j], d[order[-1]])
        for (size, j), (d, r) in found.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(d), blocks[size][0][j]), pa.int64()), pa.array(d, pa.float64()), pa.array(r, pa.int64())], ["q", "d", "rep"])

    def quiet(batches):
        with np.errstate(over="ignore", invalid="ignore"):
            yield from run(batches)

    return quiet


def _scan(classes: DataFrame, unsure: DataFrame, k: int, block_bytes: int) -> DataFrame | None:
    """``(q, d, rep)``: the k nearest classes of every row (rep, vector, cut) of ``unsure``, from all classes."""
    context, out = classes.sparkSession.sparkContext, None
    total = unsure.agg(F.sum(F.length("vector") + 16).alias("n")).first()["n"] or 0
    blocks = -(-total // block_bytes)
    for n in range(blocks):
        some = unsure.where(F.pmod(F.xxhash64("rep"), F.lit(blocks)) == n).toArrow()
        by_size: dict[int, list] = {}
        for row in zip(*(some.column(c).to_pylist() for c in ("rep", "vector", "cut")), strict=True):
            by_size.setdefault(len(row[1]) // 8, []).append(row)
        held = context.broadcast({size: (np.array([r[0] for r in rows]), np.frombuffer(b"".join(r[1] for r in rows)).reshape(-1, size), np.array([r[2] for r in rows])) for size, rows in by_size.items()})
        part = classes.select("rep", "vector").mapInArrow(lean(_scanned(held, k)), "q long, d double, rep long")
        out = part if out is None else out.unionByName(part)
    return out


def _ranked(k: int):
    """Of each group's queries the k nearest classes in it; queries come first, and classes pass in chunks."""

    def run(batches):
        last, state = None, None

        def chunk_done(s):
            x = np.frombuffer(b"".join(s["v"])).reshape(len(s["v"]), -1)
            reps = np.array(s["r"])
            for n, (q, y) in enumerate(s["q"]):
                with np.errstate(over="ignore"):
                    d = np.sqrt(((x - y) ** 2).sum(1))
                ok = reps != q
                dd, rr = d[ok], reps[ok]
                if len(dd) > k:
                    cut = np.partition(dd, k - 1)[k - 1]
                    near = dd <= cut
                    dd, rr = dd[near], rr[near]
                best = s["best"][n] + list(zip(dd.tolist(), rr.tolist(), strict=True))
                s["best"][n] = sorted(best)[:k]
            s["v"], s["r"] = [], []

        def group_done(s):
            if s["v"]:
                chunk_done(s)
            return [(q, d, r) for (q, _), best in zip(s["q"], s["best"], strict=True) for d, r in best]

        out = []

        def emit():
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.int64())], ["q", "d", "rep"])

        for b in batches:
            for dim, t, bucket, salt, side, rep, vector in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, t, bucket, salt) != last:
                    if state and state["q"]:
                        out += group_done(state)
                    if len(out) > 50_000:
                        yield emit()
                        out.clear()
                    last, state = (dim, t, bucket, salt), {"q": [], "v": [], "r": [], "best": []}
                if side == 0:
                    state["q"].append((rep, np.frombuffer(vector)))
                    state["best"].append([])
                elif state["q"]:
                    state["v"].append(vector)
                    state["r"].append(rep)
                    if len(state["v"]) >= CHUNK:
                        chunk_done(state)
        if state and state["q"]:
            out += group_done(state)
        if out:
            yield emit()

    return run


def nearest_neighbours(vectors: DataFrame, is_query, k: int = 10, tables: int = 10, probes: int = 8, bucket_rows: int = 256, most_rows: int = 20_000, most_queries: int = 2_000, block_bytes: int = 8 << 20) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k nearest of every query, all candidates if they are fewer, by Euclidean distance, ties to the smaller vec_id.

    ``vectors`` has vec_id, embedding; ``is_query`` is a condition on vec_id. Every other row is a candidate. Vectors
    that are null, zero, or hold a null or non-finite component take no part; vectors of different lengths are never
    compared. Rows of one vec_id and equal vectors count once. Tables with few rows get more probes, so that fewer
    queries need a scan; so do tables with many buckets. Extra columns are ignored; an empty table gives an empty result.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    task = src.mapInArrow(lean(_classes_of_task(k + 1)), "key binary, vector binary, id long")
    ids = F.slice(F.array_sort(F.collect_set("id")), 1, k + 1)  # a task sends k + 1 ids at most
    classes = written(task.groupBy("key").agg(F.first("vector").alias("vector"), ids.alias("ids")).withColumn("rep", F.col("ids")[0]), "vectors")
    queries = written(src.where(is_query).mapInArrow(lean(_queries_of), "query_id long, key binary").distinct().join(classes.select("key", "rep"), "key").select("query_id", "rep"), "queries")
    n = classes.count()
    buckets = max(1, n // bucket_rows)
    number = int(np.ceil(probes * max((10_240 / max(n, 1)) ** 0.3, 1.0, (buckets / 128) ** 0.5)))

    asked = classes.join(queries.select("rep").distinct(), "rep", "left_semi").select("rep", "vector")
    place = ["dim", "t", "bucket"]
    kinds = "dim int, t int, bucket long, rep long"
    where = classes.select("rep", "vector").mapInArrow(lean(_hashed(tables, buckets, 0, True)), f"{kinds}, vector binary")
    probed = asked.mapInArrow(lean(_hashed(tables, buckets, number, True)), f"{kinds}, vector binary")
    # only buckets over a bound are dealt out; their list is short: each holds at least so many rows
    rows = where.groupBy(*place).count().where(F.col("count") > most_rows).select(*place, F.ceil(F.col("count") / most_rows).cast("int").alias("parts"))
    many = probed.groupBy(*place).count().where(F.col("count") > most_queries).select(*place, F.ceil(F.col("count") / most_queries).cast("int").alias("sets"))
    deals = written(rows.join(many, place, "full").select(*place, F.coalesce("parts", F.lit(1)).alias("parts"), F.coalesce("sets", F.lit(1)).alias("sets")), "deals")

    def dealt(df, side):
        d = df.join(deals, place, "left").withColumns({"parts": F.coalesce("parts", F.lit(1)), "sets": F.coalesce("sets", F.lit(1))})
        part = F.pmod(F.xxhash64("rep"), F.col("parts"))
        mine = F.pmod(F.xxhash64("rep"), F.col("sets"))
        salts = F.transform(F.sequence(F.lit(0), F.col("sets") - 1), lambda s: s * F.col("parts") + part) if side else F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: mine * F.col("parts") + p)
        return d.select(*place, F.explode(salts.cast("array<bigint>")).alias("salt"), F.lit(side).alias("side"), "rep", "vector")

    met = dealt(where, 1).unionByName(dealt(probed, 0))
    key = [*place, "salt"]
    found = met.repartition(partitions(spark), *key).sortWithinPartitions(*key, "side", "rep").mapInArrow(lean(_ranked(k)), "q long, d double, rep long")
    best = found.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", "rep"))), 1, k).alias("near"))  # tables * probes * k at most
    none = F.array().cast("array<struct<d:double,rep:bigint>>")
    reach = asked.mapInArrow(lean(_reach(tables, buckets, number)), "q long, reach double")
    hashed = written(asked.withColumnRenamed("rep", "q").join(reach, "q").join(best, "q", "left").withColumn("near", F.coalesce("near", none)), "hashed")
    cut = F.when(F.size("near") == k, F.col("near")[k - 1]["d"]).otherwise(F.lit(float("inf")))
    unsure = hashed.withColumn("cut", cut).where(F.col("cut") * (1 + 1e-9) >= F.col("reach")).where("reach < double('inf')").select(F.col("q").alias("rep"), "vector", (F.col("cut") * (1 + 1e-9)).alias("cut"))
    scanned = _scan(classes, unsure, k, block_bytes)
    near = hashed.select("q", "near")
    if scanned is not None:
        exact = scanned.groupBy("q").agg(F.collect_list(F.struct("d", "rep")).alias("exact"))  # k a task at most
        near = near.join(exact, "q", "left").select("q", F.coalesce(F.slice(F.array_sort("exact"), 1, k), "near").alias("near"))
    near = near.select("q", F.explode(F.concat("near", F.array(F.struct(F.lit(0.0).alias("d"), F.col("q").alias("rep"))))).alias("c"))
    named = near.select("q", "c.d", "c.rep").join(classes.select("rep", "ids"), "rep").select("q", F.explode(F.transform("ids", lambda i: F.struct(F.col("d"), i.alias("id")))).alias("c"))
    lists = named.groupBy("q").agg(F.slice(F.array_sort(F.collect_list("c")), 1, k + 1).alias("list"))  # (k + 1) ** 2 at most
    mine = queries.join(lists, queries["rep"] == lists["q"]).select("query_id", F.slice(F.filter("list", lambda c: c["id"] != F.col("query_id")), 1, k).alias("list"))
    return mine.select("query_id", F.posexplode("list").alias("at", "c")).select("query_id", (F.col("at") + 1).alias("rank"), F.col("c.id").alias("vec_id"), F.col("c.d").alias("score"))


def op3_nearest(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose vec_id is divisible by 100."""
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
