"""Language identification as a mixture of languages.

Each learned language has smoothed log-likelihoods of letter trigrams (bytes of the lower-cased text, hashed into a
fixed table). A document's words are drawn from an unknown mixture of the languages: expectation-maximisation estimates
the proportions from the words' likelihoods, and the set of languages is chosen by penalised likelihood, the best single
language unless more languages raise the log-likelihood by more than ``penalty * log(words)`` each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import Utf8, column_of, forget, lean, table, written

CELLS = 1 << 16
_CLASS = np.zeros(256, np.uint32)
for _b in range(26):
    _CLASS[97 + _b] = _CLASS[65 + _b] = _b + 1
_CLASS[128:256] = np.arange(128) + 27


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(table cell of each letter byte's trigram, first trigram of each word, words by row) of rows ``offsets[i]:offsets[i+1]`` of data."""
    lo = int(offsets[0])
    c = _CLASS[data[lo : int(offsets[-1])]]
    n = len(c)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    edges = (offsets - lo).astype(np.int64)
    before, after = np.empty_like(c), np.empty_like(c)
    before[0] = after[-1] = 0
    before[1:], after[:-1] = c[:-1], c[1:]
    before[edges[:-1][edges[:-1] < n]] = 0
    after[edges[1:][edges[1:] > 0] - 1] = 0
    at = np.flatnonzero(c)
    cells = (((before[at] * np.uint32(157) + c[at]) * np.uint32(157) + after[at]) * np.uint32(2654435761)) >> np.uint32(16)
    first = np.flatnonzero(before[at] == 0)
    return cells, first, np.diff(np.searchsorted(at[first], edges))


def _counts(batches):
    found: dict[str, np.ndarray] = {}
    for b in batches:
        texts, langs = Utf8(column_of(b, "text")), column_of(b, "lang").to_pylist()
        for i in range(len(texts)):
            cells, _, _ = trigrams(texts.data, texts.offsets[i : i + 2])
            if langs[i] not in found:
                found[langs[i]] = np.zeros(CELLS, np.int64)
            found[langs[i]] += np.bincount(cells, minlength=CELLS)
    for lang, n in found.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n[at], pa.int64())], ["lang", "cell", "n"])


class LanguageModel:
    def __init__(self, langs: list[str], counts: np.ndarray, smoothing: float = 0.5):
        self.langs = langs
        total = counts.sum(1, keepdims=True) if len(langs) else counts
        self.table = np.ascontiguousarray(np.log((counts + smoothing) / (total + smoothing * CELLS)).T.astype(np.float32)) if len(langs) else counts

    def infer(self, data: np.ndarray, offsets: np.ndarray, rounds: int = 12, penalty: float = 3.0) -> np.ndarray:
        """Proportions (rows x languages) of the chosen language sets; zeros for rows without a word."""
        cells, first, words = trigrams(data, offsets)
        rows, k = len(words), len(self.langs)
        out = np.zeros((rows, k))
        if not len(first) or not k:
            return out
        ll = np.add.reduceat(self.table[cells], first, axis=0).astype(np.float64)
        return self._mixtures(ll, words, out, rounds, penalty)

    def _mixtures(self, ll: np.ndarray, words: np.ndarray, out: np.ndarray, rounds: int, penalty: float) -> np.ndarray:
        k = ll.shape[1]
        has = np.flatnonzero(words)
        words = words[has]
        starts = np.cumsum(words) - words
        top = ll.max(1)
        like = np.exp(ll - top[:, None])
        row = np.repeat(np.arange(len(has)), words)
        share = np.full((len(has), k), 1.0 / k)
        for _ in range(rounds):
            r = like * share[row]
            r /= r.sum(1, keepdims=True)
            share = np.add.reduceat(r, starts, axis=0) / words[:, None]
        best = np.add.reduceat(np.log((like * share[row]).sum(1)), starts)
        single = np.add.reduceat(ll - top[:, None], starts, axis=0)
        first = single.argmax(1)
        cost = penalty * np.log(words + 1.0)
        chosen = np.zeros_like(share)
        chosen[np.arange(len(has)), first] = 1
        for d in np.flatnonzero(best - single[np.arange(len(has)), first] > cost):  # only these may hold more languages
            part = like[starts[d] : starts[d] + words[d]]
            order = np.argsort(-share[d], kind="stable")
            score = single[d, first[d]] - cost[d]
            for size in range(2, k + 1):
                use = np.sort(order[:size])
                p = np.maximum(share[d, use], 1e-6)
                p /= p.sum()
                for _ in range(rounds):
                    r = part[:, use] * p
                    r /= np.maximum(r.sum(1, keepdims=True), 1e-300)
                    p = r.mean(0)
                now = np.log(np.maximum((part[:, use] * p).sum(1), 1e-300)).sum() - size * cost[d]
                if now <= score:
                    break
                score = now
                chosen[d] = 0
                chosen[d, use] = p
        out[has] = chosen
        return out


def learn_languages(labelled: DataFrame, rows_per_language: int = 1500) -> LanguageModel:
    """Learn from (text, lang); of each language at most ``rows_per_language`` distinct texts, those with the smallest hashes, or all if they are fewer."""
    every = 1 << 30
    rank = Window.partitionBy("lang").orderBy("h", "text")
    labelled = labelled.where("lang is not null and text is not null")
    rows = labelled.select("lang", "text", F.pmod(F.xxhash64("text"), F.lit(every)).alias("h"))
    # of a language with many distinct texts only those under a bound on the hash, about twice as many as wanted, are shuffled
    distinct = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}  # a row for each language
    bounds = {lang: int(every * 2 * rows_per_language / n) for lang, n in distinct.items() if n > 2 * rows_per_language}
    while True:
        under = rows
        if bounds:
            limit = F.create_map(*[F.lit(x) for kv in bounds.items() for x in kv])[F.col("lang")]
            under = rows.where(limit.isNull() | (F.col("h") < limit))
        some = under.dropDuplicates(["lang", "text"]).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= rows_per_language).select("lang", "text")
        if not bounds:
            break
        some = written(some, "sample")
        passed = {r["lang"]: r["count"] for r in some.groupBy("lang").count().collect()}
        short = {lang for lang in bounds if passed.get(lang, 0) < rows_per_language}
        if not short:
            break
        forget(some)
        raised = {lang: 4 * bound if lang in short else bound for lang, bound in bounds.items()}
        bounds = {lang: bound for lang, bound in raised.items() if bound < every}
    got = some.mapInArrow(lean(_counts), "lang string, cell long, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(got.column("lang").to_pylist()))
    counts = np.zeros((len(langs), CELLS))
    if langs:
        counts[np.searchsorted(langs, got.column("lang").to_numpy(zero_copy_only=False).astype(str)), got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return LanguageModel(langs, counts)


def identify_languages(docs: DataFrame, model: LanguageModel, key: str = "doc_id") -> DataFrame:
    """``(key, lang_pred, score, languages)`` for every row: the largest share's language, its share, and all chosen shares.

    A null text, or one without a letter, is ``und`` with score 0 and no languages; so is all, if nothing was learned.
    """
    schema = docs.select(key).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        names = np.array([*m.langs, "und"], object)
        for b in batches:
            column = column_of(b, "text")
            texts = Utf8(column)
            letter = np.asarray(pc.fill_null(pc.match_substring_regex(column.cast(pa.large_string()), r"\p{L}"), False))
            pred, score, shares = [], [], []
            for i, j in texts.slices(max(1 << 16, (4 << 20) // max(4, len(m.langs)))):
                p = m.infer(texts.data, texts.offsets[i : j + 1])
                ok = letter[i:j] & (p.sum(1) > 0) if len(m.langs) else np.zeros(j - i, bool)
                if not len(m.langs):
                    p = np.zeros((j - i, 1))
                at = p.argmax(1)
                pred.extend(names[np.where(ok, at, len(m.langs))])
                score.extend(np.where(ok, p[np.arange(j - i), at], 0.0))
                shares.extend([(m.langs[x], float(p[r, x])) for x in np.flatnonzero(p[r])] if ok[r] else [] for r in range(j - i))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.map_(pa.string(), pa.float64()))], [key, "lang_pred", "score", "languages"])

    return docs.select(key, F.col("text").cast("string").alias("text")).mapInArrow(lean(run), f"{schema}, lang_pred string, score double, languages map<string,double>")


def keep_identified(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of which a language can be told."""
    at = docs.columns.index("text")
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            texts = Utf8(b.column(at))
            keep = np.asarray(pc.fill_null(pc.match_substring_regex(b.column(at).cast(pa.large_string()), r"\p{L}"), False)).copy()
            for i, j in texts.slices(max(1 << 16, (4 << 20) // max(4, len(m.langs)))):
                keep[i:j] &= m.infer(texts.data, texts.offsets[i : j + 1]).sum(1) > 0
            yield b.filter(pa.array(keep))

    return docs.mapInArrow(lean(run), docs.schema)


def held_out(of: int, remainder: int):
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(of)) == remainder


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of whole documents, learned where crc32(doc_id) mod 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = learn_languages(docs.where(~F.coalesce(held_out(3, 1), F.lit(False))).select("text", "lang"))
    return identify_languages(docs.select("doc_id", "text"), model).select("doc_id", F.coalesce(held_out(3, 1), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
