"""Benchmark decontamination by greedy string tiling.

Texts and test items become word hashes (case and punctuation don't count). Documents join the items with which they
share a seed of ``least`` words: windows of the document are looked up in the items' windows. For each such pair tiles
are marked greedily: Karp-Rabin window hashes give all matches of unmarked words along each diagonal, the longest ones
are marked in both texts, and the search repeats until no match of ``least`` words is left. Tiles may come in any order,
so a reordered passage still covers its item. An item whose words are covered to ``coverage`` or more contaminates.

Items go to the executors in blocks of bounded size, each against all documents; nothing is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytewords import PUNCTUATION, U, mix, words
from tessera.llm.common import Utf8, column_of, lean, table

_STEP = U(0xD6E8FEB86659FD93)
BLOCK_BYTES = 8 << 20


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of k words."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        out = out * _STEP + h[i : len(h) - k + 1 + i]
    return mix(out)


def _pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with a[i] == b[j]."""
    order = np.argsort(b, kind="stable")
    s = b[order]
    lo, hi = np.searchsorted(s, a, "left"), np.searchsorted(s, a, "right")
    n = hi - lo
    i = np.repeat(np.arange(len(a)), n)
    return i, order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


def _runs(wd: np.ndarray, wi: np.ndarray, hits: np.ndarray, least: int, most_windows: int):
    """(starts in doc, starts in item, words) of maximal matches, ordered by their ends but for one stretch of hits."""
    held: dict[int, tuple[int, int, int]] = {}  # by diagonal, the matches that reach the end of the stretch
    end = -2
    for at in range(0, len(hits), most_windows):
        part = hits[at : at + most_windows]
        i, j = _pairs(wd[part], wi)
        i = part[i]
        # runs of windows along a diagonal are maximal matches
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(i - j) != 0))) if len(i) else np.zeros(0, np.int64)
        si, sj, n = i[start], j[start], np.diff(np.append(start, len(i)))
        for r in np.flatnonzero(si == end + 1):
            before = held.pop(int(si[r] - sj[r]), None)
            if before:
                si[r], sj[r], n[r] = before[0], before[1], before[2] + n[r]
        over = list(held.values())
        end = int(part[-1])
        going = si + n - 1 == end
        held = {int(d - t): (int(d), int(t), int(m)) for d, t, m in zip(si[going], sj[going], n[going], strict=True)}
        done = np.array(over, np.int64).reshape(-1, 3), np.stack([si, sj, n], 1)[~going]
        d, t, m = np.concatenate(done).T
        yield d, t, m + least - 1
    d, t, m = np.array(list(held.values()), np.int64).reshape(-1, 3).T
    yield d, t, m + least - 1


def greedy_tiles(doc: np.ndarray, item: np.ndarray, least: int, most_windows: int = 200_000) -> list[tuple[int, int, int]]:
    """Tiles (start in doc, start in item, words), longest first; no word of either is in two tiles.

    A document with more than ``most_windows`` windows of the item is searched in stretches of so many, so memory is
    bounded; in each round the longest matches of all stretches are found before any is marked, so tiles are the same.
    """
    wd, wi = windows(doc, least), windows(item, least)
    hits = np.flatnonzero(np.isin(wd, wi))
    taken, free = np.zeros(len(doc), bool), np.ones(len(item), bool)
    out = []

    def mark(starts_d, starts_t, longest):
        for r in np.lexsort((starts_t, starts_d)):
            d, t = int(starts_d[r]), int(starts_t[r])
            if taken[d : d + longest].any() or not free[t : t + longest].all():
                continue
            taken[d : d + longest] = True
            free[t : t + longest] = False
            out.append((d, t, longest))

    if len(hits) > most_windows:
        # windows by their number among the item's; -1 is gone
        every, wi = np.unique(wi, return_inverse=True)
        number = np.full(len(wd), -1)
        number[hits] = np.searchsorted(every, wd[hits])
        starts = np.arange(len(wi))
        while len(hits):
            longest = max(int(n.max(initial=0)) for _, _, n in _runs(number, wi, hits, least, most_windows))
            if not longest:
                break
            for d, t, n in _runs(number, wi, hits, least, most_windows):
                mark(d[n == longest], t[n == longest], longest)
            busy_d = np.concatenate([[0], np.cumsum(taken)])
            busy_i = np.concatenate([[0], np.cumsum(~free)])
            wi[busy_i[starts + least] != busy_i[starts]] = -1
            hits = hits[(busy_d[hits + least] == busy_d[hits]) & np.isin(number[hits], wi)]
        return out
    i, j = _pairs(wd[hits], wi)
    i = hits[i]
    while len(i):
        # runs of windows along a diagonal are maximal matches
        order = np.lexsort((i, i - j))
        i, j = i[order], j[order]
        start = np.flatnonzero(np.append(True, (np.diff(i) != 1) | (np.diff(i - j) != 0)))
        length = np.diff(np.append(start, len(i))) + least - 1
        longest = int(length.max())
        mark(i[start[length == longest]], j[start[length == longest]], longest)
        # windows that touch a marked word are gone
        busy_d = np.concatenate([[0], np.cumsum(taken)])
        busy_i = np.concatenate([[0], np.cumsum(~free)])
        ok = (busy_d[i + least] == busy_d[i]) & (busy_i[j + least] == busy_i[j])
        i, j = i[ok], j[ok]
    return out


class TestItems:
    """One block of items as word hashes, with an index of their windows."""

    def __init__(self, ids: list, texts: list[str | None], least: int):
        found = Utf8(pa.array(texts, pa.large_string()))
        h, counts = words(found.data, found.offsets, apart=PUNCTUATION)
        ends = np.cumsum(counts)
        self.least = least
        self.items = [(ids[r], h[ends[r] - counts[r] : ends[r]]) for r in range(len(ids)) if counts[r] >= least]
        seeds = [windows(w, least) for _, w in self.items]
        every = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        which = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        order = np.lexsort((which, every))
        self.seeds, self.which = every[order], which[order]
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(every & U((1 << 22) - 1)).astype(np.int64)] = True

    def candidates(self, w: np.ndarray) -> np.ndarray:
        """Items that share a window."""
        at = np.flatnonzero(self.filter[(w & U((1 << 22) - 1)).astype(np.int64)])
        if not len(at):
            return at
        got = np.unique(w[at])
        lo, hi = np.searchsorted(self.seeds, got, "left"), np.searchsorted(self.seeds, got, "right")
        return np.unique(np.concatenate([self.which[x:y] for x, y in zip(lo, hi, strict=True)])) if (hi > lo).any() else at[:0]

    def found_in(self, texts: Utf8):
        """(row, item id, item's words, tiles) of every candidate pair."""
        k = self.least
        for i, j in texts.slices():
            h, counts = words(texts.data, texts.offsets[i : j + 1], apart=PUNCTUATION)
            w = windows(h, k)
            if not len(w) or not self.filter[(w & U((1 << 22) - 1)).astype(np.int64)].any():
                continue
            ends = np.cumsum(counts)
            for r in range(j - i):
                lo, hi = int(ends[r] - counts[r]), int(ends[r])
                if hi - lo >= k:
                    for c in self.candidates(w[lo : hi - k + 1]):
                        item, item_words = self.items[c]
                        yield i + r, item, len(item_words), greedy_tiles(h[lo:hi], item_words, k)


def _blocks(benchmark: DataFrame, least: int, block_bytes: int):
    """The items, block by block; a block's size is bounded (but for one longer item)."""
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.lower(F.col("text").cast("string")).alias("text")).where("text is not null")
    size = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    for b in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).toArrow()
        yield TestItems(part.column("item_id").to_pylist(), part.column("text").to_pylist(), least)


TILES = "doc_id long, item_id long, coverage double, matched_words int, item_words int, tiles array<struct<doc_start:int,item_start:int,words:int>>"


def contaminations(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, least: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each document and test item that it contains: coverage, words and tiles (starts count words).

    ``docs`` has doc_id, text; ``benchmark`` item_id, text. Null, empty and short texts (under ``least`` words) contain
    nothing and are contained nowhere. Repeated rows count each; items with equal texts are each reported. Extra columns
    are ignored; empty tables give an empty result.
    """
    spark = docs.sparkSession
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    out = None
    kind = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("words", pa.int32())]))
    for block in _blocks(benchmark, least, block_bytes):
        held = spark.sparkContext.broadcast(block)

        def run(batches, held=held):
            for b in batches:
                rows = []
                for r, item, n, tiles in held.value.found_in(Utf8(column_of(b, "text"))):
                    got = sum(t[2] for t in tiles)
                    if got >= coverage * n:
                        rows.append((r, item, got / n, got, n, [{"doc_start": d, "item_start": t, "words": x} for d, t, x in tiles]))
                if rows:
                    at = pa.array([x[0] for x in rows], pa.int64())
                    yield pa.RecordBatch.from_arrays([column_of(b, "doc_id").take(at), pa.array([x[1] for x in rows], pa.int64()), pa.array([x[2] for x in rows], pa.float64()), pa.array([x[3] for x in rows], pa.int32()), pa.array([x[4] for x in rows], pa.int32()), pa.array([x[5] for x in rows], kind)], ["doc_id", "item_id", "coverage", "matched_words", "item_words", "tiles"])

        part = src.mapInArrow(lean(run), TILES)
        out = part if out is None else out.unionByName(part)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = 0.5, least: int = 5, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that contain no test item (as ``contaminations`` has it)."""
    spark = docs.sparkSession
    at = docs.columns.index("text")
    for block in _blocks(benchmark, least, block_bytes):
        held = spark.sparkContext.broadcast(block)
        lower = "__lower_text"
        while lower in docs.columns:
            lower += "_"

        def run(batches, held=held):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for r, _, n, tiles in held.value.found_in(Utf8(b.column(b.num_columns - 1))):
                    if sum(t[2] for t in tiles) >= coverage * n:
                        keep[r] = False
                kept = b.filter(pa.array(keep))
                yield pa.RecordBatch.from_arrays(kept.columns[:-1], kept.schema.names[:-1])

        docs = docs.withColumn(lower, F.lower(docs[docs.columns[at]].cast("string"))).mapInArrow(lean(run), docs.schema)
    return docs


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    """Whole documents that contain items of ``benchmark``."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
