"""Toxicity by a convolutional text classifier, trained in numpy.

A word's vector is the sum of two hashed embeddings, of the word and of its first four bytes (so a stem is known in words
not seen before). Filters of several widths slide over a document's words, each filter's maximum over the whole text is
kept, and a logistic layer turns the maxima into a score. Gradients pass only through the windows that gave a maximum.
Flags use a threshold for each language, chosen on a part of the sample that training left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bytewords import PUNCTUATION, U, mix, word_spans
from tessera.llm.common import Utf8, column_of, lean, table
from tessera.llm.labelled import labelled_sample, training_part

WORDS, STEMS = 1 << 15, 1 << 14
_FOLD = np.arange(256, dtype=np.uint64)
_FOLD[65:91] += U(32)


def word_ids(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell of each word, cell of its stem, number of words by row)."""
    h, start, end = word_spans(data, offsets, apart=PUNCTUATION)
    stem = np.zeros(len(h), np.uint64)
    for i in range(4):
        at = start + i
        inside = at < end
        stem = (stem << U(8)) | np.where(inside, _FOLD[data[np.where(inside, at, start)]], U(0))
    return (h & U(WORDS - 1)).astype(np.int32), (mix(stem) & U(STEMS - 1)).astype(np.int32), np.diff(np.searchsorted(start, offsets))


class ConvolutionalClassifier:
    """``widths`` x ``filters`` filters over words of ``dim`` numbers."""

    def __init__(self, dim: int = 8, widths: tuple = (1, 2, 3), filters: int = 8, seed: int = 3):
        rng = np.random.default_rng(seed)
        draw = lambda *s, scale=0.1: rng.normal(0, scale, s).astype(np.float32)
        self.widths, self.filters = widths, filters
        self.p = {"word": draw(WORDS, dim), "stem": draw(STEMS, dim), "out": draw(len(widths) * filters, scale=0.3), "bias": np.zeros(1, np.float32)}
        for w in widths:
            self.p[f"w{w}"] = draw(w, dim, filters, scale=0.4)
            self.p[f"b{w}"] = np.zeros(filters, np.float32)
        self.thresholds: dict[str, float] = {}

    def _laid_out(self, words: np.ndarray, stems: np.ndarray, counts: np.ndarray):
        """Vectors with room for a window to run over each document's end; where each document's windows begin."""
        pad = max(self.widths) - 1
        row = np.repeat(np.arange(len(counts)), counts)
        x = np.zeros((len(words) + pad * len(counts), self.p["word"].shape[1]), np.float32)
        place = np.arange(len(words)) + pad * row
        x[place] = self.p["word"][words] + self.p["stem"][stems]
        starts = np.cumsum(counts) - counts + pad * np.arange(len(counts))
        return x, place, starts

    def features(self, words, stems, counts):
        """(documents x filters) maxima, for documents with a word."""
        x, _, starts = self._laid_out(words, stems, counts)
        pad = max(self.widths) - 1
        n = len(x) - pad
        out = []
        for w in self.widths:
            k = self.p[f"w{w}"]
            y = x[:n] @ k[0]
            for j in range(1, w):
                y += x[j : j + n] @ k[j]
            # windows that begin in the room after a document see zeros first; they count for none
            keep = np.ones(n + pad, bool)
            for j in range(pad):
                keep[starts + counts + j] = False
            y[~keep[:n]] = -np.inf
            out.append(np.maximum.reduceat(y, starts, axis=0) + self.p[f"b{w}"])
        return np.maximum(np.concatenate(out, 1), 0)

    def score(self, words, stems, counts) -> np.ndarray:
        z = np.full(len(counts), float(self.p["bias"][0]))
        has = np.flatnonzero(counts)
        if len(has):
            z[has] += self.features(words, stems, counts[has]) @ self.p["out"]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        base = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
        self.p["bias"][:] = np.log(base / (1 - base))
        docs_at = np.array([i for i, d in enumerate(docs) if len(d[0])], np.int64)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step = 0
        weight = {1: 0.5 / base, 0: 0.5 / (1 - base)}
        for _ in range(max(epochs, -(-600 * batch // max(len(docs_at), 1)))):  # few documents need more rounds
            order = rng.permutation(docs_at)
            for lo in range(0, len(order), batch):
                part = order[lo : lo + batch]
                words = np.concatenate([docs[i][0] for i in part])
                stems = np.concatenate([docs[i][1] for i in part])
                counts = np.array([len(docs[i][0]) for i in part])
                target = y[part].astype(np.float64)
                step += 1
                grads = self._gradients(words, stems, counts, target, np.array([weight[int(t)] for t in target]))
                for k, (rows, g) in grads.items():
                    if rows is None:
                        m[k] = 0.9 * m[k] + 0.1 * g
                        v[k] = 0.99 * v[k] + 0.01 * g * g
                        self.p[k] -= rate * m[k] / (np.sqrt(v[k]) + 1e-6)
                    else:  # only the rows that a maximum came from
                        v[k][rows] = 0.9 * v[k][rows] + 0.1 * g * g
                        self.p[k][rows] -= rate * g / (np.sqrt(v[k][rows]) + 1e-6)

    def _gradients(self, words, stems, counts, target, weight):
        x, place, starts = self._laid_out(words, stems, counts)
        pad = max(self.widths) - 1
        n = len(x) - pad
        ends = starts + counts
        pooled, where = [], []
        for w in self.widths:
            k = self.p[f"w{w}"]
            y = x[:n] @ k[0]
            for j in range(1, w):
                y += x[j : j + n] @ k[j]
            best = np.stack([s + y[s:e].argmax(0) for s, e in zip(starts, np.minimum(ends, n), strict=True)])
            where.append(best)
            pooled.append(np.take_along_axis(y, best, 0) + self.p[f"b{w}"])
        f = np.maximum(np.concatenate(pooled, 1), 0)
        z = f @ self.p["out"] + self.p["bias"][0]
        err = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * weight / len(counts)).astype(np.float32)
        out = {"out": (None, f.T @ err), "bias": (None, np.array([err.sum()], np.float32))}
        df = err[:, None] * self.p["out"][None] * (f > 0)
        gx_at, gx = [], []
        for i, w in enumerate(self.widths):
            d = df[:, i * self.filters : (i + 1) * self.filters]
            out[f"b{w}"] = (None, d.sum(0))
            g = np.zeros_like(self.p[f"w{w}"])
            for j in range(w):
                seen = x[where[i] + j]  # documents x filters x dim
                g[j] = np.einsum("dfe,df->ef", seen, d)
                gx_at.append((where[i] + j).ravel())
                gx.append((d[:, :, None] * self.p[f"w{w}"][j].T[None]).reshape(-1, x.shape[1]))
            out[f"w{w}"] = (None, g)
        at, g = np.concatenate(gx_at), np.concatenate(gx)
        back = np.full(len(x), -1, np.int64)
        back[place] = np.arange(len(words))
        real = back[at] >= 0
        at, g = back[at[real]], g[real]
        for k, ids in (("word", words), ("stem", stems)):
            rows, inverse = np.unique(ids[at], return_inverse=True)
            total = np.zeros((len(rows), g.shape[1]), np.float32)
            np.add.at(total, inverse, g)
            out[k] = (rows, total)
        return out

    def calibrate(self, scores: np.ndarray, y: np.ndarray, langs: np.ndarray, least: int = 5) -> None:
        """For each language the threshold with the best F1; 0.5 where fewer than ``least`` examples are toxic."""
        for lang in sorted({x for x in langs if x is not None}):
            mine = langs == lang
            s, t = scores[mine], y[mine]
            if t.sum() < least:
                continue
            order = np.argsort(-s, kind="stable")
            hit = np.cumsum(t[order])
            f1 = 2 * hit / (np.arange(len(s)) + 1 + t.sum())
            last = np.append(s[order][1:] != s[order][:-1], True)  # equal scores stay together
            best = int(np.flatnonzero(last)[f1[last].argmax()])
            below = s[order][best + 1] if best + 1 < len(s) else 0.0
            self.thresholds[lang] = float((s[order][best] + below) / 2)


def _cells(batches):
    for b in batches:
        texts = Utf8(column_of(b, "text"))
        w, s, n = word_ids(texts.data, texts.offsets)
        cut = np.concatenate([[0], np.cumsum(n)])
        yield pa.RecordBatch.from_arrays([pa.array([w[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary()), pa.array([s[a:z].tobytes() for a, z in zip(cut, cut[1:], strict=False)], pa.binary()), column_of(b, "lang"), column_of(b, "y"), column_of(b, "h")], ["words", "stems", "lang", "y", "h"])


def learn_toxicity(docs: DataFrame, labels: DataFrame, rows: int = 6_000, calibration: int = 5) -> ConvolutionalClassifier:
    """Train on at most ``rows`` labelled rows of the training part; one in ``calibration`` only sets thresholds."""
    sample = labelled_sample(docs, labels, "toxic", ["text", "lang"], rows)
    got = sample.mapInArrow(lean(_cells), "words binary, stems binary, lang string, y int, h long").toArrow().sort_by("h")
    every = [(np.frombuffer(w, np.int32), np.frombuffer(s, np.int32)) for w, s in zip(got.column("words").to_pylist(), got.column("stems").to_pylist(), strict=True)]
    y = np.array(got.column("y").to_pylist(), np.int64)
    model = ConvolutionalClassifier()
    if not len(y):
        return model
    left = np.arange(len(y)) % calibration == 0
    use = np.flatnonzero(~left)
    model.fit([every[i] for i in use], y[use])
    scores = np.array([model.score(w, s, np.array([len(w)]))[0] for (w, s), out in zip(every, left, strict=True) if out])
    model.calibrate(scores, y[left], np.array(got.column("lang").to_pylist(), object)[left])
    return model


def score_toxicity(docs: DataFrame, model: ConvolutionalClassifier) -> DataFrame:
    """``(doc_id, score, predicted, lang_threshold, flagged)`` for every row of ``docs`` (doc_id, text, lang).

    The score knows the text only; ``flagged`` holds it against its language's threshold (0.5 for a language without
    one, or null). Null and empty texts get the score of a text without words. Repeated rows are scored each; extra
    columns are ignored; an empty table gives an empty result, and without labels all scores are near one half.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            texts = Utf8(column_of(b, "text"))
            score = np.concatenate([m.score(*word_ids(texts.data, texts.offsets[i : j + 1])) for i, j in texts.slices(1 << 19)] or [np.zeros(0)])
            limit = np.array([m.thresholds.get(x, 0.5) for x in column_of(b, "lang").to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([column_of(b, "doc_id"), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32)), pa.array(limit), pa.array(score >= limit)], ["doc_id", "score", "predicted", "lang_threshold", "flagged"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    return src.mapInArrow(lean(run), "doc_id long, score double, predicted int, lang_threshold double, flagged boolean")


def op4_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of whole documents, learned where crc32(doc_id) mod 5 is not 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).withColumn("held_out", F.coalesce(~training_part(), F.lit(False)))
