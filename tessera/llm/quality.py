"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

Every occurrence of a word is a feature of value ``1 / sqrt(words)``; statistics of the text and its recorded length are
features with their standardised values. Each feature has a weight and a short vector; the pairwise interactions
``sum_{i<j} <v_i, v_j> x_i x_j`` are ``(|sum_i v_i x_i|^2 - sum_i |v_i x_i|^2) / 2``, so a score takes linear time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytewords import U, words
from tessera.llm.common import Utf8, column_of, lean, table
from tessera.llm.labelled import labelled_sample, training_part

CELLS = 1 << 15
_KIND = np.zeros(256, np.int64)  # 0 other ASCII sign
_KIND[[0x20, *range(0x09, 0x0E)]] = 1
_KIND[0x0A] = 2
_KIND[48:58] = 3
_KIND[65:91] = 4
_KIND[97:123] = 5
_KIND[128:192] = 6  # continues a character
_KIND[192:256] = 7
_KIND[[ord(c) for c in ".,;:'\"()-?"]] = 8
_KIND[ord("!")] = 9
STATISTICS = 14


def text_statistics(data: np.ndarray, offsets: np.ndarray, hashes: np.ndarray, counts: np.ndarray, n_chars: np.ndarray) -> np.ndarray:
    """(rows x STATISTICS) numbers about each text: shares of kinds of bytes, word length, repetition, sizes."""
    rows = len(counts)
    lo = int(offsets[0])
    size = np.diff(offsets)
    kind = _KIND[data[lo : int(offsets[-1])]]
    row = np.repeat(np.arange(rows), size)
    table_ = np.bincount(row * 10 + kind, minlength=rows * 10).reshape(rows, 10)
    chars = np.maximum(size - table_[:, 6], 1)
    letters = table_[:, 4] + table_[:, 5] + table_[:, 7]
    ends = np.cumsum(counts)
    distinct = np.array([len(np.unique(hashes[e - n : e])) for e, n in zip(ends, counts, strict=True)])
    n = np.maximum(counts, 1)
    return np.stack([
        table_[:, 0] / chars, table_[:, 3] / chars, table_[:, 4] / np.maximum(letters, 1), table_[:, 8] / chars, table_[:, 9] / chars,
        table_[:, 2] / n, letters / chars, chars / n / 10, distinct / n, np.log1p(counts) / 5, np.log1p(chars) / 8,
        table_[:, 0] / n, table_[:, 9] / n, np.where(np.isfinite(n_chars), np.log1p(np.maximum(np.nan_to_num(n_chars), 0)) / 8, 0.0),
    ], 1)


class FactorisationMachine:
    def __init__(self, factors: int = 6, seed: int = 9):
        rng = np.random.default_rng(seed)
        n = CELLS + STATISTICS
        self.bias, self.w = 0.0, np.zeros(n)
        self.v = rng.normal(0, 0.02, (n, factors))
        self.mean, self.scale = np.zeros(STATISTICS), np.ones(STATISTICS)

    def _sums(self, cells, counts, stats):
        """Linear part and, of the vectors, sum and sum of squares of each document."""
        x = 1 / np.sqrt(np.maximum(counts, 1))
        z = np.clip((stats - self.mean) / self.scale, -5, 5)
        linear = self.bias + z @ self.w[CELLS:]
        s = z @ self.v[CELLS:]
        q = (z**2) @ (self.v[CELLS:] ** 2)
        has = np.flatnonzero(counts)
        if len(has):
            starts = (np.cumsum(counts) - counts)[has]
            linear[has] += np.add.reduceat(self.w[cells], starts) * x[has]
            v = self.v[cells]
            s[has] += np.add.reduceat(v, starts, axis=0) * x[has, None]
            q[has] += np.add.reduceat(v * v, starts, axis=0) * (x[has] ** 2)[:, None]
        return linear, s, q, x, z

    def raw(self, cells, counts, stats) -> np.ndarray:
        linear, s, q, _, _ = self._sums(cells, counts, stats)
        return linear + 0.5 * (s**2 - q).sum(1)

    def score(self, cells, counts, stats) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(cells, counts, stats), -30, 30)))

    def fit(self, docs: list[np.ndarray], stats: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 4) -> None:
        rng = np.random.default_rng(seed)
        base = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
        self.bias = float(np.log(base / (1 - base)))
        self.mean, self.scale = stats.mean(0), stats.std(0) + 1e-6
        mw, vw, mv, vv = np.zeros_like(self.w), np.zeros_like(self.w), np.zeros_like(self.v), np.zeros_like(self.v)
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(docs))
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                cells = np.concatenate([docs[i] for i in part])
                counts = np.array([len(docs[i]) for i in part])
                linear, s, q, x, z = self._sums(cells, counts, stats[part])
                err = (1 / (1 + np.exp(-np.clip(linear + 0.5 * (s**2 - q).sum(1), -30, 30))) - y[part]) / len(part)
                row = np.repeat(np.arange(len(part)), counts)
                ex = err[row] * x[row]
                gw = np.bincount(cells, ex, minlength=CELLS)
                exx = np.bincount(cells, ex * x[row], minlength=CELLS)
                gv = np.stack([np.bincount(cells, ex * s[row, f], minlength=CELLS) for f in range(s.shape[1])], 1) - self.v[:CELLS] * exx[:, None]
                gw = np.concatenate([gw, z.T @ err])
                gv = np.concatenate([gv, (z * err[:, None]).T @ s - self.v[CELLS:] * ((z**2).T @ err)[:, None]])
                self.bias -= rate * err.sum()
                t += 1
                for p, g, m, v in ((self.w, gw + decay * self.w, mw, vw), (self.v, gv + decay * self.v, mv, vv)):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)


def _inputs(texts: Utf8, i: int, j: int, n_chars: np.ndarray):
    at = texts.offsets[i : j + 1]
    h, counts = words(texts.data, at)
    return (h & U(CELLS - 1)).astype(np.int64), counts, text_statistics(texts.data, at, h, counts, n_chars[i:j])


def _numbers(column: pa.Array) -> np.ndarray:
    return np.asarray(column.cast(pa.float64()).fill_null(np.nan))


def _cells(batches):
    for b in batches:
        texts, n = Utf8(column_of(b, "text")), _numbers(column_of(b, "n_chars"))
        cells, counts, stats = _inputs(texts, 0, len(texts), n)
        cut = np.concatenate([[0], np.cumsum(counts)])
        yield pa.RecordBatch.from_arrays([pa.array([cells[a:z].astype(np.int32).tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary()), column_of(b, "y"), column_of(b, "h")], ["cells", "stats", "y", "h"])


def _with_length(docs: DataFrame) -> DataFrame:
    n = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), n.alias("n_chars"))


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = 8_000) -> FactorisationMachine:
    """Train on at most ``rows`` labelled rows of the training part."""
    sample = labelled_sample(_with_length(docs), labels, "quality", ["text", "n_chars"], rows)
    got = sample.mapInArrow(lean(_cells), "cells binary, stats binary, y int, h long").toArrow().sort_by("h")
    model = FactorisationMachine()
    if got.num_rows:
        stats = np.frombuffer(b"".join(got.column("stats").to_pylist())).reshape(-1, STATISTICS)
        model.fit([np.frombuffer(c, np.int32) for c in got.column("cells").to_pylist()], stats, np.array(got.column("y").to_pylist(), np.float64))
    return model


def score_quality(docs: DataFrame, model: FactorisationMachine, threshold: float = 0.3) -> DataFrame:
    """``(doc_id, score, predicted)`` for every row of ``docs`` (doc_id, text and, if there, n_chars).

    Null and empty texts get the score of a text without words; a null length counts as unknown. Repeated rows are scored
    each; extra columns are ignored; an empty table gives an empty result, and without labels all scores are one half.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            texts, n = Utf8(column_of(b, "text")), _numbers(column_of(b, "n_chars"))
            score = np.concatenate([held.value.score(*_inputs(texts, i, j, n)) for i, j in texts.slices()] or [np.zeros(0)])
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return _with_length(docs).mapInArrow(lean(run), "doc_id long, score double, predicted int")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of whole documents, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    model = learn_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).withColumn("held_out", F.coalesce(~training_part(), F.lit(False)))
