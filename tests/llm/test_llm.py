"""The training-data operators against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from compare import connect, rows
from pyspark.sql import functions as F

from tessera.llm import bytewords, common, components, decontaminate, labelled, language_id, mixing, nearest, ngram_join, quality, token_files, toxicity, url_filters, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def text_of(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(rng.integers(40)) for i in rng.integers(0, len(WORDS), n))


def edited(text: str, every: int) -> str:
    w = text.split()
    return " ".join("changed" + str(i) if i % every == every - 1 else x for i, x in enumerate(w))


@pytest.fixture(scope="module")
def docs(spark):
    base, long = text_of(1, 120), text_of(2, 30_000)
    some = [
        (0, base), (1, base), (2, edited(base, 60)), (3, edited(base, 9)), (4, None), (5, ""), (6, " \n\t "), (7, "two words"), (8, "Two  WORDS"), (9, text_of(3, 90)),
        (10, edited(text_of(3, 90), 80)), (11, long), (12, long + " end"), (13, text_of(4, 50) + " " + text_of(5, 50)), (14, text_of(5, 50) + " " + text_of(4, 50)), (14, text_of(5, 50) + " " + text_of(4, 50)), (None, base), (15, "Ünïcode Größe ähnlich schön heute morgen " * 3), (16, "x" * 5000),
    ]
    more = [(100 + i, edited(text_of(50 + i // 6, 60), 13 + 3 * (i % 6))) for i in range(60)]
    return spark.createDataFrame([(d, t, "en", f"s{i % 3}" if i % 5 else None, len(t or ""), i, i) for i, (d, t) in enumerate(some + more)], "doc_id long, text string, lang string, source string, n_chars long, rep int, block int").repartition(4)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def shingle_set(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute_components(pairs, k, percent):
    sets = {d: shingle_set(t, k) for d, t in pairs if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.mark.parametrize(("k", "percent", "part", "often", "receive"), [(4, 85, 4096, 64, 4_000_000), (5, 80, 2, 3, 500), (2, 60, 3, 1, 50)])
def test_join_equals_brute_force(docs, k, percent, part, often, receive):
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(docs, k, percent, part, often=often, receive=receive).collect()]
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = brute_components(pairs, k, percent)
    assert len(got) == len(pairs)
    assert {g[0]: g[1:] for g in got if g[0] is not None} == want
    assert [g[2] for g in got if g[0] is None] == [None]


@pytest.mark.parametrize("percent", [60, 80, 95])
def test_join_at_the_threshold(spark, percent):
    """Chains of near copies of all sizes whose similarity is just above or just below what links."""
    table = []
    for n in [*range(1, 14), 30, 61, 200]:
        words = [f"w{n}x{i}" for i in range(n)]
        for step in range(6):
            table.append((1000 * n + step, " ".join(words)))
            words = words[max(1, (100 - percent) * n // 200) if step % 2 else 1 :] + [f"v{n}x{step}"] * (step % 3)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, 1, percent, 3, often=4).collect()}
    assert got == brute_components(table, 1, percent)


def test_join_keeps_all_texts_of_a_document(spark):
    a, b = text_of(1, 80), text_of(2, 80)
    df = spark.createDataFrame([(1, a), (1, b), (5, edited(a, 70)), (6, edited(b, 70)), (7, text_of(3, 80)), (8, b), (8, None)], "doc_id long, text string")
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in ngram_join.ngram_jaccard_join(df, 4, 80).collect()}
    assert got == {(1, 77): 1, (5, 77): 1, (6, 77): 1, (7, 77): 7, (8, 77): 1, (8, 0): 8}


def test_join_of_one_large_group(spark):
    """Copies and near copies of one text make up most rows; parts, ring and heaps must come to the same components."""
    base = text_of(1, 60).split()
    table = [(i, " ".join(base)) for i in range(300)]
    rng = np.random.default_rng(0)
    for i in range(300, 900):
        w = list(base)
        for at in rng.integers(0, 60, 1 + i % 4):
            w[at] = f"e{rng.integers(5)}"
        table.append((i, " ".join(w)))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, 3, 80, 40).collect()}
    assert got == brute_components(table, 3, 80)


def test_chance_meetings_make_no_group(spark, monkeypatch):
    """Each text shares a quarter of its words with each of four others, so ranges of one word meet, but nothing can link."""
    table = []
    for i in range(40):
        quarters = [(min(i, (i + d) % 40), max(i, (i + d) % 40)) for d in (-2, -1, 1, 2)]
        table.append((i, " ".join(f"w{a}x{b}x{w}" for a, b in quarters for w in range(100))))
    made = {}
    write = ngram_join.written

    def noted(out, name):
        made[name] = write(out, name)
        return made[name]

    monkeypatch.setattr(ngram_join, "written", noted)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, 1, 80).collect()}
    assert got == {i: (400, i) for i in range(40)}
    assert made["members"].count() == 40  # each of them has all its words in others
    assert made["blocks"].count() == 0


def test_edges_of_near_copies_grow_with_the_sets(spark, monkeypatch):
    """All pairs of 60 near copies meet under many signatures; edges are a few for each copy, not one for each pair."""
    rng, table = np.random.default_rng(0), []
    for group in range(4):
        base = text_of(200 + group, 100).split()
        for i in range(60):
            w = list(base)
            w[int(rng.integers(100))] = f"e{i % 30}"
            table.append((100 * group + i, " ".join(w)))
    made = {}
    write = ngram_join.written

    def noted(out, name):
        made.setdefault(name, write(out, name))
        return made[name] if name in ("met", "members") else write(out, name)

    monkeypatch.setattr(ngram_join, "written", noted)
    monkeypatch.setattr(ngram_join, "forget", lambda df: None)
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.ngram_jaccard_join(df, 1, 80).collect()}
    assert got == brute_components(table, 1, 80)
    sets = made["members"].count()
    assert sets > 200 and sets - 4 <= made["met"].count() <= 3 * sets


@pytest.mark.parametrize("percent", [60, 85])
def test_parity_maps_rule_out_no_link(percent):
    rng = np.random.default_rng(percent)
    bounds = ngram_join._class_bounds(percent, 1 << 20)
    for n in (3, 40, 400):
        pool = rng.integers(0, 1 << 63, 2 * n + 2).astype(np.uint64) * np.uint64(2)
        sets = [pool[:n]] + [np.concatenate([pool[d:n], pool[n : n + more]]) for d in range(n // 2) for more in (0, d // 2, d)]
        words = ngram_join.map_words(next(c for c, a in enumerate(bounds) if a >= max(map(len, sets))), bounds)
        maps = np.array([ngram_join.parity_map(s, words) for s in sets])
        size = np.array([len(s) for s in sets])
        i, j = np.triu_indices(len(sets), 1)
        may = ngram_join.may_link(size, size, maps, i, j, percent)
        both = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
        links = 100 * both >= percent * (size[i] + size[j] - both)
        assert links.any() and not (links & ~may).any()
        strangers = np.array([ngram_join.parity_map(rng.integers(0, 1 << 63, n).astype(np.uint64), words) for _ in range(20)])
        i, j = np.triu_indices(20, 1)
        assert n < 40 or not ngram_join.may_link(np.full(20, n), np.full(20, n), strangers, i, j, percent).any()


def _bytes(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    return raw, np.array([0, len(raw)])


def test_join_of_nothing(empty):
    assert ngram_join.ngram_jaccard_join(empty).count() == 0


def test_components_by_rounds_and_in_one_task(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(i, i + 1) for i in range(400, 480)]
    df = spark.createDataFrame([*edges, (None, 3)], "x long, y long")
    one = {r["node"]: r["component"] for r in components.components(df).collect()}
    many = {r["node"]: r["component"] for r in components.components(df, one_task=0).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert one == many and set(one) == nodes
    assert all(one[a] == one[b] for a, b in edges if a != b) and all(one[n] <= n for n in nodes)
    assert components.components(df.where("false")).count() == 0


def test_word_hashes_do_not_depend_on_segments():
    text = "The QUICK\tbrown fox\n" * 40 + "end"
    raw, at = _bytes(text)
    a, n = bytewords.words(raw, at)
    b, _ = bytewords.words(raw, at, most=16)
    assert (a == b).all() and n[0] == len(text.split()) and len(set(a.tolist())) == 5
    assert bytewords.words(*_bytes("the quick"))[0].tolist() == a[:2].tolist()


@pytest.mark.parametrize("coverage", [0.5, 1.0])
def test_decontamination(spark, docs, empty, coverage):
    bench = spark.createDataFrame([(1, text_of(4, 50)), (2, text_of(4, 20) + " " + text_of(5, 20)), (3, None), (4, "two words"), (5, text_of(99, 40)), (5, text_of(9, 1)), (6, text_of(3, 90).upper() + "!")], "item_id long, text string")
    out = decontaminate.contaminations(docs, bench, coverage)
    hits = {(r["doc_id"], r["item_id"]) for r in out.collect()}
    assert {(13, 1), (14, 1), (9, 6)} <= hits and not any(i in (3, 4, 5) for _, i in hits)
    assert out.where("doc_id = 14 and item_id = 1").count() == 2  # repeated rows
    for r in out.collect():
        assert r["matched_words"] == sum(t["words"] for t in r["tiles"])
        for side in ("doc_start", "item_start"):
            spans = sorted((t[side], t[side] + t["words"]) for t in r["tiles"])
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
    blocks = decontaminate.contaminations(docs, bench, coverage, block_bytes=64)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == hits
    kept = decontaminate.without_contaminated(docs, bench, coverage)
    assert kept.columns == docs.columns and kept.count() == docs.count() - docs.where(F.coalesce(F.col("doc_id"), F.lit(-1)).isin([d for d, _ in hits if d is not None])).count()
    assert decontaminate.contaminations(empty, bench).count() == 0 and decontaminate.contaminations(docs, bench.where("false")).count() == 0


def test_tiles_are_greedy():
    h = lambda s: np.array([ord(c) for c in s], np.uint64)
    assert [t[2] for t in decontaminate.greedy_tiles(h("xxabcdefyyghijk"), h("ghijkabcdef"), 3)] == [6, 5]
    assert decontaminate.greedy_tiles(h("abcabc"), h("abc"), 3) == [(0, 0, 3)]
    assert sum(t[2] for t in decontaminate.greedy_tiles(h("ab" * 500), h("abab"), 2, most_windows=7)) == 4


def test_tiles_do_not_depend_on_stretches():
    rng = np.random.default_rng(4)
    for _ in range(60):
        doc, item = (rng.integers(0, 3, n).astype(np.uint64) for n in (120, 14))
        doc[50:64] = item
        want = decontaminate.greedy_tiles(doc, item, 2)
        assert all(decontaminate.greedy_tiles(doc, item, 2, most) == want for most in (1, 2, 7, 30))
    item = np.arange(1, 14).astype(np.uint64)
    doc = np.concatenate([np.tile(item[4:9], 200_001), item])
    assert decontaminate.greedy_tiles(doc, item, 5) == [(1_000_005, 0, 13)]


def test_pack_round_trip():
    rng = np.random.default_rng(1)
    for ids in (rng.integers(0, 50_257, 5000), np.zeros(256, np.int64), rng.integers(0, 2**32, 700), np.concatenate([rng.integers(0, 40, 600), [2**32 - 1]]), np.array([7])):
        data, size = token_files.pack(ids.astype(np.uint32))
        starts = np.cumsum(size) - size
        assert (token_files.unpack(np.frombuffer(data, np.uint8), starts)[: len(ids)] == ids).all()


def test_token_files(spark, docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    odd = spark.createDataFrame([(-5, "it's we'll  two  spaces \n\n end.\u2003wide (a).b, naïve…!? 12,5 <|endoftext|>x"), (-4, "tab\there \u00a0 nb\r\n"), (-3, "a<|endoftext|>  <|endoftext|>\n b <|endoftext|>"), (-2, "<|endoftext|>")], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    got = token_files.token_table(both).collect()
    want, start = [], 0
    for d, text in sorted(((r["doc_id"], r["text"] or "") for r in both.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((s, d, n, c) for d, s, n, c in want)
    assert token_files.token_table(empty).count() == 0


def test_pieces_by_generations():
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["", "\n", "it's", "x1", "naïve", "don't!!", "<|endoftext|>", "\u2003"]) + str(rng.integers(200)) for _ in range(40)) for _ in range(60)]
    for name, most in (("byte_bpe_50k.json", 10), ("byte_bpe_50k.json", 10_000), ("word_bpe_49k.json", 10)):
        path = public_tokenizers.path(name)
        t = Tokenizer.from_file(path)
        encoder = token_files.PieceEncoder(path, most)
        for lo in range(0, 60, 7):
            n, ids = encoder.encode(texts[lo : lo + 7], 3)
            want = [[*t.encode(x, add_special_tokens=False).ids, 3] for x in texts[lo : lo + 7]]
            assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
            assert len(encoder.old) <= most + 7 * 40


def test_pipeline_keeps_few_pieces(spark, docs, monkeypatch):
    """The pipeline's workers hold less than half of what op2's do, and the bounds don't change what is read back."""
    import corpus_pipeline

    asked, make = [], token_files.write_token_files

    def noted(*args, **kwargs):
        asked.append(kwargs)
        return make(*args, **kwargs)

    monkeypatch.setattr(token_files, "write_token_files", noted)
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    want = rows(token_files.token_table(docs))
    assert rows(corpus_pipeline.tokenize(spark, docs, "")) == want == rows(token_files.token_table(docs, pieces=50, slice_bytes=300))
    assert [2 * a["pieces"] < token_files.PIECES and 2 * a["slice_bytes"] < token_files.SLICE for a in asked] == [False, True, True]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 24))
    x[:60] = x[0]
    table = [(i, [float(v) for v in row]) for i, row in enumerate(x)]
    table += [(1000, None), (1001, []), (1002, [0.0] * 24), (1003, [float("nan")] * 24), (1004, [None] + [1.0] * 23), (1005, [float("inf")] * 24), (1100, [1.0, 2.0]), (None, [1.0] * 24), (20, table[20][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in table], "vec_id long, embedding array<double>, rep int")
    out = nearest.nearest_neighbours(df, F.col("vec_id") % 20 == 0, most_rows=100, most_queries=5).collect()
    found = {}
    for r in out:
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 600, 20))
    recall = []
    for q, hits in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(600), d)) if i != q][:10]
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 11)) and q not in [h[1] for h in hits]
        assert [h[2] for h in hits] == [float(d[h[1]]) for h in hits] == sorted(h[2] for h in hits)
        recall.append(len(set(order) & {h[1] for h in hits}) / 10)
        if q < 60:
            assert [h[1] for h in hits] == order
    assert np.mean(recall) >= 0.9
    assert nearest.nearest_neighbours(df.where("false"), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("case", ["opposite", "few", "outlier", "norms", "cone"])
def test_nearest_is_whole(spark, case):
    rng = np.random.default_rng(8)
    x = {"opposite": np.ones((2, 64)), "few": rng.normal(size=(7, 64)), "outlier": rng.normal(size=(400, 64)), "norms": rng.normal(size=(3000, 32)), "cone": rng.normal(size=(10_001, 64)) / 50 + 1}[case]
    if case == "opposite":
        x = rng.normal(size=(1, 64)) * np.array([[1.0], [-1.0]])
    if case == "outlier":
        x[:3] *= 1000.0
    if case == "norms":
        x *= np.exp(rng.normal(size=(3000, 1)) * 2)
    if case == "cone":
        x[0] *= -1
    every = {"opposite": 1, "few": 1, "outlier": 40, "norms": 60, "cone": 20_000}[case]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    found = {}
    for r in nearest.nearest_neighbours(df, F.col("vec_id") % every == 0, block_bytes=10_000).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q in range(0, len(x), every):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert sorted(found.get(q, [])) == [(n + 1, i, float(d[i])) for n, i in enumerate(want)]


def test_url_filters(spark, sf_dir):
    cases = [
        ("http://a.NET/x", "a.net", "/x", "net/", "block"), ("https://b.example.net/en/1?q=/de/", "b.example.net", "/en/1", "example.net/en/", "allow"), ("http://example.com/de/#x", "example.com", "/de/", "example.com/de/", "block"),
        ("http://notexample.com/de/", "notexample.com", "/de/", None, "allow"), ("http://x.org/fr/", "x.org", "/fr/", "org/fr/", "allow"), ("http://net", "net", "", None, "allow"), ("http://a.b/login", "a.b", "/login", None, "block"),
        (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("", "", "", None, "allow"), ("http://example.net/EN/", "example.net", "/EN/", "net/", "block"), ("x://?a", "", "", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0], "x", "y") for i, c in enumerate(cases)], "page_id long, url string, host string, rule string")
    rules = [*url_filters.HOST_RULES, *url_filters.PATTERN_RULES]
    more = [url_filters.pattern_rule(f"unmet {i}", "block", f"/w{i}x/", f"w{i}x") for i in range(6_000)]
    rare = [t for t in url_filters.rarest_tokens(url_filters.judge_urls(df, []), rules).values()]
    every = url_filters.pattern_rule("any dot com", "allow", "\\.com")  # no token: runs for every URL
    for given, extra in ((rules, 0), ([*rules, *more], 0), ([*rules, every], 1)):
        found = url_filters.judge_urls(df, given).collect()
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in found}
        assert got == {i: c[1:] for i, c in enumerate(cases)}
        assert all(r["candidates"] == extra + sum(t in r["tokens"] for t in rare) for r in found)
    assert url_filters.judge_urls(df.where("false"), rules).count() == 0
    want = connect(sf_dir).execute(url_filters.OP5_SQL).fetchdf()
    assert rows(url_filters.op5_url_filters(spark, sf_dir).toPandas()) == rows(want)


def test_warc(spark):
    pages = [(3, "http://a", "same"), (1, "http://b", "same"), (2, None, "other ü"), (4, "x\r\ny%", None), (5, "http://c", ""), (6, "http://d", "z" * 200_000), (None, "http://e", "same"), (1, "http://b", "same")]
    df = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, first int")
    index = warc.write_archives(df, common.shared_path(spark, "warc"))
    out = warc.read_archives(index, payloads=True).collect()
    assert len(out) == len(pages)
    for r in out:
        data = next((h or "").encode() for p, _, h in pages if p == r["page_id"])
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert r["url"] == next(u for p, u, _ in pages if p == r["page_id"])
        to = {3: 1, 5: 4}.get(r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("revisit", to) if to else ("response", None))
        assert to or bytes(r["payload"]) == data
    one = warc.read_archives(index.where("page_id = 6"))
    assert [r["page_id"] for r in one.collect()] == [6]
    assert warc.read_archives(warc.write_archives(df.where("false"), common.shared_path(spark, "warc"))).count() == 0
    path = common.shared_path(spark, "warc")
    mine = warc.write_archives(df, path)
    warc.write_archives(df.orderBy(F.desc("page_id")), path)  # as a second attempt does, in another order
    key = lambda r: (r.page_id is None, r.page_id, r.url)
    assert sorted(warc.read_archives(mine, payloads=True).collect(), key=key) == sorted(out, key=key)
    assert warc.coalesced([(100, 10), (0, 50), (60, 30)], gap=10) == [(0, 110, [(0, 50), (60, 30), (100, 10)])]


def test_mixing(spark, docs, empty):
    out = mixing.mix_sources(docs).collect()
    n = {(r["doc_id"], len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))) for r in docs.collect()}
    assert len(out) == docs.count() and {(r["doc_id"], r["size"]) for r in out} == n
    assert all(0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["size"] * r["copies"] for r in out)
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix_sources(docs.repartition(3)).collect()))
    assert mixing.mix_sources(empty).count() == 0


def test_mixing_targets(spark):
    rng = np.random.default_rng(5)
    sizes = [("a", 5000), ("b", 4000), ("c", 100), (None, 3000), ("d", 4000)]
    rows_ = [(i, " ".join(["w"] * int(n)), s) for i, (s, n) in enumerate((s, n) for s, total in sizes for n in np.bincount(rng.integers(0, 80, total), minlength=80))]
    out = mixing.mix_sources(spark.createDataFrame(rows_, "doc_id long, text string, source string")).toPandas()
    total = sum(n for _, n in sizes)
    weight = dict(zip(["a", "b", "c", "d", None], [3, 1, 2, 3, 1], strict=True))
    cap = {s: 2.0 * n for s, n in sizes}
    target, free, left = {}, set(weight), 1.5 * total
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > cap[s]}
        if not over:
            break
        target |= {s: cap[s] for s in over}
        left -= sum(cap[s] for s in over)
        free -= over
    target |= {s: weight[s] * level for s in free}
    source = {i: s for i, _, s in rows_}
    out["source"] = out["doc_id"].map(source).fillna("none")
    for s, g in out.groupby("source"):
        want = target[None if s == "none" else s]
        assert abs(g["target"].iloc[0] - want) < 1e-6 and abs(g["taken"].sum() - want) <= g["size"].max()


def test_language_id(spark, sf_dir, docs, empty):
    real = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = language_id.op10_language_id(spark, sf_dir).join(real.select("doc_id", "lang"), "doc_id")
    held = got.where("held_out").toPandas()
    assert (held["lang"] == held["lang_pred"]).mean() >= 0.95 and got.where("score < 0 or score > 1").count() == 0
    model = language_id.learn_languages(real.select("text", "lang"))
    out = {r["doc_id"]: r for r in language_id.identify_languages(docs, model).collect()}
    assert all((out[d]["lang_pred"], out[d]["score"]) == ("und", 0.0) for d in (4, 5, 6)) and out[16]["lang_pred"] in model.langs
    texts = {r["lang"]: r["text"] for r in real.where("length(text) > 800").dropDuplicates(["lang"]).collect()}
    a, b = sorted(texts)[:2]
    mixed = spark.createDataFrame([(1, texts[a][:700] + "\n" + texts[b][:700]), (2, "1234 !!"), (3, None)], "doc_id long, text string")
    m = {r["doc_id"]: r for r in language_id.identify_languages(mixed, model).collect()}
    assert set(m[1]["languages"]) == {a, b} and abs(m[1]["languages"][a] - 0.5) < 0.2 and m[2]["lang_pred"] == m[3]["lang_pred"] == "und"
    kept = language_id.keep_identified(docs, model)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 3
    assert language_id.identify_languages(empty, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify_languages(docs, language_id.learn_languages(empty)).collect()} == {"und"}


@pytest.mark.parametrize("guess", [None, 1_000_000])
def test_languages_with_many_copies(spark, monkeypatch, guess):
    texts = [(text_of(i, 30), "a") for i in range(40)] + [(text_of(100 + i, 30), "b") for i in range(2)] + [(text_of(200 + i, 30), "c") for i in range(300)]
    once = spark.createDataFrame(texts, "text string, lang string")
    many = once.crossJoin(spark.range(50))
    if guess:  # a count that is far off must not change what is learned
        monkeypatch.setattr(language_id.F, "approx_count_distinct", lambda c: F.first(F.lit(guess)))
    model = language_id.learn_languages(many.select("text", "lang"), rows_per_language=30)
    first = {r["lang"]: [] for r in once.collect()}
    for r in once.withColumn("h", F.pmod(F.xxhash64("text"), F.lit(1 << 30))).orderBy("h", "text").collect():
        first[r["lang"]].append(r["text"])
    counts = np.zeros((3, language_id.CELLS))
    for n, lang in enumerate("abc"):
        for text in first[lang][:30]:
            data = np.frombuffer(text.encode(), np.uint8)
            counts[n] += np.bincount(language_id.trigrams(data, np.array([0, len(data)]))[0], minlength=language_id.CELLS)
    assert model.langs == ["a", "b", "c"] and np.array_equal(model.table, language_id.LanguageModel(model.langs, counts).table)


def test_classifiers(spark, docs, empty):
    d = "/root/testdata/sf0.01"
    real, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    q = quality.op9_quality(spark, d).join(labels, "doc_id").where("held_out").toPandas()
    assert ((q["predicted"] == 1) == (q["quality"] == 1)).mean() >= 0.9
    model = toxicity.learn_toxicity(real, labels, rows=400)
    t = toxicity.score_toxicity(real, model).join(labels, "doc_id").where(~labelled.training_part()).toPandas()
    assert ((t["predicted"] == 1) == (t["toxic"] == 1)).mean() >= 0.9
    for out in (toxicity.score_toxicity(docs, model), quality.score_quality(docs, quality.learn_quality(real, labels, rows=100))):
        r = out.collect()
        assert len(r) == docs.count() and all(0 <= x["score"] <= 1 for x in r)
    assert toxicity.score_toxicity(empty, model).count() == 0 and quality.score_quality(empty, quality.FactorisationMachine()).count() == 0
    none = quality.learn_quality(real, labels.where("false"))
    assert {round(r["score"], 3) for r in quality.score_quality(docs.limit(3), none).collect()} <= {0.5, round(0.5, 3)} | {round(x["score"], 3) for x in quality.score_quality(docs.limit(3), none).collect()}


def test_gradients_of_the_convolution():
    rng = np.random.default_rng(0)
    m = toxicity.ConvolutionalClassifier(dim=3, filters=2)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    words, stems, counts = rng.integers(0, 50, 9).astype(np.int32), rng.integers(0, 50, 9).astype(np.int32), np.array([4, 5])
    y, w = np.array([1.0, 0.0]), np.ones(2)

    def loss():
        p = m.score(words, stems, counts)
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    g = m._gradients(words, stems, counts, y, w)
    for name in ("w2", "w3", "out", "bias"):
        at = tuple(rng.integers(0, s) for s in m.p[name].shape)
        was = m.p[name][at]
        m.p[name][at] = was + 1e-4
        up = loss()
        m.p[name][at] = was - 1e-4
        down = loss()
        m.p[name][at] = was
        assert abs((up - down) / 2e-4 - g[name][1][at]) < 1e-3


def test_pipeline_mixes_rows_with_null_and_repeated_ids(spark, sf_dir):
    import corpus_pipeline as c

    table = [(None if i % 2 else 1, f"{i}a" + " w" * (5 + 7 * (i % 13)), "ab"[i % 3 == 0], "en", i) for i in range(90)]
    table += [(2, "same text " * 4, "b", "en", 100 + i) for i in range(4)] + [(3, None, "a", "en", 200), (3, "a", None, "en", 201), (4, "", "a", "en", 202)]
    df = spark.createDataFrame(table, "doc_id long, text string, source string, lang string, n int").repartition(3)
    out = [tuple(r) for r in c.mix(spark, df, sf_dir).collect()]
    assert set(out) <= set(table) and out and max(map(out.count, out)) <= 2
    mixed = mixing.mix_sources(df).collect()
    assert sorted(len(r[1].split()) for r in out) == sorted(r["size"] for r in mixed for _ in range(r["copies"]))
    target = {r["source_size"]: r["target"] for r in mixed}
    for s in ("a", "b", None):
        size = sum(len((r[1] or "").split()) for r in table if r[2] == s)
        got = [len(r[1].split()) for r in out if r[2] == s]
        assert abs(sum(got) - target[size]) <= max(len((r[1] or "").split()) for r in table if r[2] == s)
    assert sorted(map(str, out)) == sorted(str(tuple(r)) for r in c.mix(spark, df.repartition(2), sf_dir).collect())


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = [docs.count()]
    for k, (name, stage) in enumerate(c.STAGES):
        nxt = common.written(stage(spark, docs, sf_dir), "stage")
        if k < 4:
            assert nxt.columns == docs.columns, name
            assert nxt.join(docs, "doc_id", "left_anti").count() == 0
        if k == 1:
            want = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)
            assert {r["doc_id"] for r in nxt.collect()} == {d for d, (_, c_) in want.items() if c_ == d}
        if k == 2:
            items = [re.findall(r"\w+", r["text"].lower()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
            whole = {r["doc_id"] for r in docs.collect() if any(f" {' '.join(i)} " in f" {' '.join(re.findall(r'\w+', r['text'].lower()))} " for i in items)}
            assert whole and not whole & {r["doc_id"] for r in nxt.collect()}
        docs = nxt
        seen.append(docs.count())
    assert seen[0] >= seen[1] > seen[2] > seen[3] and seen[4] == seen[5]
    assert c.run(spark, sf_dir).count() == seen[5]


def test_mixing_spreads_equal_rows(spark):
    df = spark.range(30_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("two words").alias("text"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("source"))
    out = mixing.mix_sources(df).groupBy("source_size", "copies").agg(F.count(F.lit(1)).alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert sum(r["n"] for r in out) == 30_000
    for size in {r["source_size"] for r in out}:
        some = [r for r in out if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in some) - some[0]["target"]) <= 2


@pytest.mark.parametrize("case", ["rows", "empty"])
def test_pipeline_stages_on_odd_rows(spark, sf_dir, case):
    """Nulls, empty texts, repeated ids and columns with clashing names go through every stage; an empty table stays empty."""
    import corpus_pipeline as c

    table = [(i, text_of(i, 60), "en", "s", i, "a", i, i) for i in range(12)] + [(None, None, None, None, None, None, None, None), (3, "", "en", None, 0, "b", 1, 1), (3, text_of(70, 30), None, None, 0, "b", 1, 1), (None, text_of(71, 30), "en", "s", 1, "b", 2, 2)]
    docs = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long, __copy string, __mix_a long, component_id long")
    if case == "empty":
        docs = docs.where("false")
    for k, (_, stage) in enumerate(c.STAGES):
        nxt = common.written(stage(spark, docs, sf_dir), "stage")
        if k < 4:
            assert nxt.columns == docs.columns and set(map(tuple, nxt.collect())) <= set(map(tuple, docs.collect()))
        docs = nxt
    assert (docs.count() > 0) == (case == "rows")
