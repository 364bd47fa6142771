"""Operators of the optional subpackage against brute force, and on nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import json
import os
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from termloom.llm import bpe, chat, decontaminate, graph, langid, line_dedup, lm_score, settle, simhash, sketch, token_codec, token_count, url_filter
from termloom.llm.queries import TOOLS, tokenizer_file
from termloom.llm.scratch import Scratch, shared_folder

DOCS = "doc_id long, text string"
ODD = [(None, None), (1, None), (2, ""), (3, "   \n "), (4, "Same text here"), (4, "Same text here"), (5, "Same text here"), (6, "éß 中文 \U0001f600 Σας <|endoftext|> it's"), (7, "word " * 5000), (8, "x" * 3000)]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def odd(spark):
    # an extra column whose name is used inside
    return spark.createDataFrame([(i, t, "q") for i, t in ODD], DOCS + ", _text string")


# ---- tokens ----


@pytest.fixture(scope="module")
def libraries():
    tokenizers = pytest.importorskip("tokenizers")
    return {n: tokenizers.Tokenizer.from_file(tokenizer_file(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def random_texts(n):
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|startoftext|>", "'ll", " the", "and", "été", "  ", "\n\t", "keitüng", "\u0558", "\u2028", "Σ", "ΑΣ", "a\u0301", "１", "²", "x" * 40]
    return ["".join(rng.choice(parts) if rng.random() < 0.5 else chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x3000)])) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_codec_equals_the_library(spark, libraries):
    library = libraries["word_bpe_49k.json"]
    texts = random_texts(400) + [t or "" for _, t in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    got = {r.doc_id: r for r in token_codec.encode_documents(df, tokenizer_file("word_bpe_49k.json"), ("ids", "decoded", "n_tokens", "ids_sha256", "decoded_sha256")).collect()}
    for i, t in enumerate(texts):
        ids = library.encode(t, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        assert (got[i].ids, got[i].decoded, got[i].n_tokens) == (ids, back, len(ids)), t
        assert (got[i].ids_sha256, got[i].decoded_sha256) == (sha(" ".join(map(str, ids))), sha(back))


def test_a_worker_keeps_few_words(libraries, monkeypatch):
    """An executor of two cores may have four workers, each with words of its own."""
    with open(tokenizer_file("word_bpe_49k.json"), encoding="utf-8") as f:
        codec = token_codec.Codec(f.read())
    monkeypatch.setattr(codec.vocabulary, "encode", lambda word: [40_000, 40_001, 40_002])
    tracemalloc.start()
    try:
        for start in range(0, 700_000, 10_000):
            codec.encode(" ".join(f"word{'abcdefghij'[i % 10]}" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(start, start + 10_000)))
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 50 << 20


def test_counts_equal_the_library(spark, libraries):
    library = libraries["byte_bpe_50k.json"]
    texts = random_texts(400) + [t or "" for _, t in ODD]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    for r in token_count.count_tokens(df, tokenizer_file("byte_bpe_50k.json")).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 1024)


def test_merging_takes_the_lowest_leftmost_pair():
    rng = random.Random(3)
    ranks = {(a, b): r for r, (a, b) in enumerate(rng.sample([(a, b) for a in range(8) for b in range(8)], 40))}
    made = [rng.randrange(8) for _ in ranks]
    for _ in range(300):
        symbols = [rng.randrange(8) for _ in range(rng.randint(0, 20))]
        want = list(symbols)
        while found := sorted((ranks[p], i) for i, p in enumerate(zip(want, want[1:], strict=False)) if p in ranks):
            r, i = found[0]
            want[i : i + 2] = [made[r]]
        assert bpe.merge_symbols(symbols, ranks, made) == want


# ---- near copies ----


def components(values, near):
    parent = list(range(len(values)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(values)):
        for j in range(i):
            if near(values[i], values[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, v in enumerate(values):
        groups.setdefault(find(i), []).append(v)
    return sorted(sorted(g) for g in groups.values())


def brute_print(text):
    import xxhash

    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).translate({c: " " for c in range(9, 14)}).split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("part", [1 << 21, 40])
def test_components(spark, monkeypatch, part):
    monkeypatch.setattr(graph, "PART", part)  # 40: the joins have to go on
    rng = random.Random(24)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100), (7, -5)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    linked = {frozenset(e) for e in edges}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    assert {n: min(g) for g in components(nodes, lambda a, b: frozenset((a, b)) in linked) for n in g} == got
    assert graph.connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("group", [2048, 16])
def test_trie_join_keeps_all_components(spark, group):
    rng = np.random.default_rng(1)
    values = {0}
    for base in rng.integers(0, 2**63, 12, dtype=np.uint64):
        x = int(base)
        for _ in range(25):
            for _ in range(int(rng.integers(0, 4))):
                x ^= 1 << int(rng.integers(0, 64))
            values.add(x)
    values = [int(v) for v in np.array(sorted(values), np.uint64).view(np.int64)]
    links = simhash.near_pairs(spark.createDataFrame([(v,) for v in values], "fp long"), Scratch(spark, "t"), 2, group)
    root = {r.node: r.root for r in graph.connected_components(links, Scratch(spark, "t")).collect()}
    got = {}
    for v in values:
        got.setdefault(root.get(v, v), []).append(v)
    assert sorted(sorted(g) for g in got.values()) == components(values, lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count() <= 2)


def test_near_duplicates_of_odd_rows(spark):
    rows = simhash.near_duplicates(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        text = next(t for i, t in ODD if i == r.doc_id) or ""
        assert r.fp & (2**64 - 1) == brute_print(text)
    assert {r.component_id for r in rows if r.fp == 0} == {1} and {r.component_id for r in rows if r.doc_id in (4, 5)} == {4}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    kept = simhash.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 6, 7, 8]


@pytest.mark.parametrize("block", [1024, 2])
def test_one_of_each_near_group_stays(spark, monkeypatch, block):
    monkeypatch.setattr(settle, "BLOCK", block)  # 2: groups go in many blocks
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(5000)}"
    passage = [word() for _ in range(60)]
    texts = []
    for i in range(60):
        base = [word() for _ in range(rng.randint(3, 120))] + (passage if i % 2 else [])
        for _ in range(rng.choice([1, 1, 4])):
            other = list(base)
            for _ in range(rng.randint(0, 4)):
                other[rng.randrange(len(other))] = word()
            texts.append(" ".join(other))
    rows = [*enumerate(texts), (900, texts[0].upper()), (None, texts[1]), (None, "none other has these words"), (None, "none other has these words")]
    sets = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    of = {t.lower(): sets(t) for _, t in rows}
    groups = components(sorted(of), lambda a, b: 5 * len(of[a] & of[b]) >= 4 * len(of[a] | of[b]))
    assert 60 < len(groups) < len(texts)
    want = [min(((i is None, i) for i, t in rows if t.lower() in g), key=lambda x: (x[0], x[1] or 0))[1] for g in groups]
    got = [r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, DOCS)).collect()]
    order = lambda i: -1 if i is None else i
    assert sorted(got, key=order) == sorted(want, key=order)


def line_likeness(a, b):
    a, b = ({x[i : i + 5] for i in range(max(1, len(x) - 4))} for x in (a, b))
    return len(a & b) / len(a | b)


def brute_lines(rows):
    first, parent = {}, {}
    lines = [((d is None, d or 0), at, line_dedup.normal(x)) for d, t in rows for at, x in enumerate((t or "").split("\n"))]
    names = sorted({n for *_, n in lines if n})
    for g in components(names, lambda a, b: line_likeness(a, b) >= 0.8):
        parent |= dict.fromkeys(g, g[0])
    for key, at, n in lines:
        if n:
            first[parent[n]] = min(first.get(parent[n], (key, at)), (key, at))
    out = []
    for d, t in rows:
        keep = [x for at, x in enumerate((t or "").split("\n")) if not (n := line_dedup.normal(x)) or first[parent[n]] == ((d is None, d or 0), at)]
        out.append((d, None if t is None else "\n".join(keep)))
    return out


def clustered(rng, n):
    """Sets of words of likeness 0.6 to 1 around a few centres, and some that share little."""
    sets = []
    for _ in range(n):
        base = [f"{rng.randrange(3)}-{i}" for i in range(60)] if rng.random() < 0.8 else []
        sets.append({w if rng.random() < 0.93 else f"x{rng.randrange(400)}" for w in base} | {f"x{rng.randrange(400)}" for _ in range(rng.randint(1, 8))})
    return sets


def test_blocks_join_all_alike_members():
    rng = random.Random(21)
    for n in (1, 2, 40, 120):
        sets = clustered(rng, n)
        before = np.array([rng.randrange(n) if rng.random() < 0.3 else i + 1000 for i in range(n)])
        hashes = [[hash(w) & (2**64 - 1) for w in sorted(x)] for x in sets]
        shingles = settle.distinct(lambda x: (np.array([h for i in x for h in hashes[i]], np.uint64), np.array([len(hashes[i]) for i in x])), list(range(n)))
        links = settle.block_links(before, shingles, 0.8)
        assert len(links) < n
        joined = {int(c): int(c) for c in before}
        for a, b in links:
            joined = {k: joined[a] if v == joined[b] else v for k, v in joined.items()}
        near = lambda i, j: before[i] == before[j] or len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        got = {}
        for i in range(n):
            got.setdefault(joined[int(before[i])], []).append(i)
        assert sorted(sorted(g) for g in got.values()) == components(range(n), near)


def test_one_letter_and_one_word_changed(spark):
    rng = random.Random(22)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=rng.randint(4, 9)))
    rows, caught = [], []
    for i in range(60):
        words = [word() for _ in range(13)]
        line = " ".join(words)[: 49 + i % 30] if i % 2 else " ".join(words)
        other = line[:25] + "#" + line[26:] if i % 2 else line.replace(words[6], words[6][:2], 1)
        assert line_likeness(line, other) >= 0.8
        rows += [(2 * i, line), (2 * i + 1, other)]
    got = {r.doc_id: r.n_dropped for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()}
    caught = [got[2 * i + 1] for i in range(60)]
    assert sum(caught) >= 57 and not any(got[2 * i] for i in range(60))


def test_line_dedup_of_odd_rows(spark):
    long = "".join(random.Random(23).choices("abcdefghijklmnop", k=200_000))
    rows = [(*r, "q", 7, "d", 3) for r in ODD] + [(9, long, "q", 7, "d", 3), (10, "z" + long[:150_000] + "#" + long[150_000:], "q", 7, "d", 3)]
    df = spark.createDataFrame(rows, DOCS + ", _text string, n_lines int, doc string, line int")
    got = line_dedup.dedup_lines(df)
    assert got.columns == ["doc_id", "text", "_text", "doc", "line", "n_lines", "n_dropped"]
    found = {}
    for r in got.collect():
        found.setdefault(r.doc_id, []).append((r.text, r.n_lines, r.n_dropped))
    assert found[1] == [(None, 0, 0)] and found[2] == [("", 0, 0)] and found[3] == [("   \n ", 0, 0)] and found[None] == [(None, 0, 0)]
    assert found[4] == [("Same text here", 1, 0)] * 2 and found[5] == [("", 1, 1)]
    assert [found[i][0][1:] for i in (9, 10)] == [(1, 0), (1, 1)]


def test_bits_take_few_bytes_in_the_driver(spark):
    Scratch(spark, "bits")  # sets the session's Arrow batches
    n = 1 << 18
    ids = np.concatenate([np.arange(n) * 37, -np.arange(n) * 101])
    nodes = spark.range(n).select(F.explode(F.array(F.col("id") * 37, F.col("id") * -101)).alias("node"))
    tracemalloc.start()
    got = line_dedup._bit_table(nodes)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    at = ids & ((1 << 27) - 1)
    want = np.zeros(1 << 22, np.uint32)
    np.bitwise_or.at(want, at >> 5, np.uint32(1) << (at & 31).astype(np.uint32))
    assert (got == want).all() and want.max() >= 1 << 31
    assert peak < got.nbytes + 16 * np.count_nonzero(want)


def test_shingles_hash_alike_in_any_script():
    """Plain letters take a shorter way to the same hashes."""
    plain, other = ["one line here", "ab", "x" * 40], ["é", "\U0001f600 中文 line", "\ud800 half"]
    alone = [h for x in plain + other for h in line_dedup.shingle_hashes([x])[0].tolist()]
    assert line_dedup.shingle_hashes(plain + other)[0].tolist() == alone
    h = 0
    for c in "a line"[:5]:
        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
    h ^= h >> 29
    assert line_dedup.shingle_hashes(["a lin"])[0].tolist() == [h * 0xBF58476D1CE4E5B9 % 2**64]


def test_tables_leave_nothing_behind_once_read(spark):
    """The files of the exchanges behind a written table go at once, and so do line dedup's groups with their tables."""
    files = lambda: {f for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}
    setting, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    was = spark.conf.get(setting, None)
    saved = Scratch(spark, "clean").save(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 10
    while files() - before and time.time() < end:
        time.sleep(0.2)
    assert not files() - before
    assert saved.count() == 7 and spark.conf.get(setting, None) == was
    found = line_dedup.dedup_lines(spark.createDataFrame([(1, "one line here\nand another"), (2, "one line here")], "doc_id long, text string"), name="left-behind")
    assert not [p for p in os.listdir(shared_folder(spark).removeprefix("file:")) if p.startswith("left-behind-groups")]
    assert {r["doc_id"]: r["n_dropped"] for r in found.collect()} == {1: 0, 2: 1}


def test_line_dedup(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 8))) for _ in range(300)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(8, 40))] for _ in range(25)]
    shared = " ".join(rng.choices(vocabulary, k=30))
    rows = []
    for d in range(70):
        lines = []
        for _ in range(rng.randint(0, 5)):
            words = list(rng.choice(base)) if rng.random() < 0.6 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 25))]
            if rng.random() < 0.5:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            lines.append(rng.choice([" ", "  "]).join(words) + (" " + shared if rng.random() < 0.3 else ""))
        rows.append((d, "\n".join(lines)))
    rows += [(None, rows[3][1]), (200, None), (201, ""), (7, rows[7][1])]
    order = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    got = [(r.doc_id, r.text) for r in line_dedup.dedup_lines(spark.createDataFrame(rows, DOCS)).collect()]
    assert sorted(got, key=order) == sorted(brute_lines(rows), key=order)
    assert line_dedup.dedup_lines(odd(spark).limit(0)).count() == 0


# ---- URLs ----


def test_urls(spark):
    rules = spark.sql("SELECT * FROM VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block') t(host, path, verdict)")
    urls = [None, "", "nothing", "http://A.Example.ORG/es/x?q#f", "http://example.org/en/12", "http://badexample.org/en/12", "https://x.com/de/", "https://x.com", "a://b://c/d", "http://y.com/fr/1", "http://y.com/fr/1", "http:///p"]
    pages = spark.createDataFrame([(i % 11, u, "h") for i, u in enumerate(urls)] + [(None, None, "h")], "page_id long, url string, host string")
    got = sorted((tuple(r) for r in url_filter.judge_urls(pages, rules).collect()), key=str)
    want = [
        (0, "", "", None, "allow"), (None, "", "", None, "allow"), (1, "", "", None, "allow"), (2, "", "", None, "allow"),
        (3, "a.example.org", "/es/x", "example.org/es/", "block"), (4, "example.org", "/en/12", "example.org/en/1", "block"),
        (5, "badexample.org", "/en/12", "org/", "allow"), (6, "x.com", "/de/", "com/de/", "block"), (7, "x.com", "", None, "allow"),
        (8, "b:", "//c/d", None, "allow"), (9, "y.com", "/fr/1", "com/fr/", "allow"), (10, "y.com", "/fr/1", "com/fr/", "allow"), (0, "", "/p", None, "allow"),
    ]
    assert got == sorted(want, key=str)
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), "block").collect()} == {"block"}


# ---- language ----


def test_language(spark):
    rng = random.Random(1)
    words = {"aa": "der die und ist nicht das".split(), "bb": "the of and is not that".split()}
    rows = [(i, " ".join(rng.choices(words[c], k=12)), c, f"h{i % 3}.{c}") for i in range(200) for c in [rng.choice("ab") * 2]]
    df = spark.createDataFrame(rows, DOCS + ", lang string, source string")
    model = langid.fit(df.where("doc_id < 100"), "lang", "doc_id")
    found = langid.identify(df.where("doc_id >= 100"), F.lit(None).cast("string"), F.col("source"), "lang", "doc_id", model=model).collect()
    assert sum(r._language == r.lang for r in found) >= 0.98 * len(found)  # held out, undeclared
    odd_rows = odd(spark).withColumns({"lang": F.lit("aa-XX"), "source": F.lit(None).cast("string")})
    got = {(r.doc_id, r.text): (r._language, r._confidence) for r in langid.identify(odd_rows, F.col("lang"), F.col("source"), "lang", "doc_id", model=model).collect()}
    assert got[None, None] == got[2, ""] == got[3, "   \n "] == (None, 0.0) and got[4, "Same text here"][0] in ("aa", "bb")
    assert langid.identify(df.limit(0), F.col("lang"), F.col("source"), "lang", "doc_id").count() == 0
    assert langid.fit(df, "lang", "doc_id", sample=50).languages == ("aa", "bb")


def test_texts_in_no_fitted_language_are_rejected(spark):
    rng = random.Random(14)
    words = {"aa": "der die und ist nicht das ein haus".split(), "bb": "the of and is not that house".split(), "cc": "olen tulossa kotiin koska sataa vettä".split()}
    rows = [(i, " ".join(rng.choices(words[c], k=30)), c, "h") for i in range(300) for c in [rng.choice(["aa", "bb"])]]
    model = langid.fit(spark.createDataFrame(rows, DOCS + ", lang string, source string"), "lang", "doc_id")
    other = [(1000 + i, " ".join(rng.choices(words["cc"], k=30)), rng.choice(["aa", "cc", None]), "h") for i in range(50)]
    other += [(2000, "我们今天去公园散步,天气很好,大家都很高兴。", "aa", "h"), (2001, "Сегодня мы пошли гулять в парк", None, "h"), (2002, "qxzj vvkp wwqx zzkj", "bb", "h")]
    df = spark.createDataFrame(rows + other, DOCS + ", lang string, source string")
    got = langid.identify(df, F.col("lang"), F.col("source"), "lang", "doc_id", model=model).collect()
    assert all((r._confidence >= 0.5) == (r.doc_id < 1000) for r in got)
    assert all(r._language == r.lang for r in got if r.doc_id < 1000)


def test_rare_languages_keep_a_model_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(langid, "LEAST", 20, raising=False)
    rng = random.Random(15)
    words = {"aa": "der die und ist nicht das".split(), "bb": "the of and is not that".split(), "cc": "olen tulossa kotiin koska sataa".split()}
    rows = [(i, " ".join(rng.choices(words[c], k=12)), c, "h") for i in range(3000) for c in ["cc" if i < 3 else rng.choice(["aa", "bb"])]] + [(None, "%%% 1", "dd", "h")]
    df = spark.createDataFrame(rows, DOCS + ", lang string, source string")
    assert langid.fit(df, "lang", "doc_id", sample=60).languages == ("aa", "bb", "cc")
    got = {r.doc_id: r._language for r in langid.identify(df, F.lit(None).cast("string"), F.col("source"), "lang", "doc_id", sample=60).collect()}
    assert [got[i] for i in range(3)] == ["cc"] * 3


def test_labels_are_read_like_declarations(spark):
    words = {"aa": "der die und ist nicht das", "bb": "the of and is not that"}
    labels = ["aa", "AA", "aa-CH", "bb", " bb_x", "english", "bbb", "", None]
    rows = [(i, words["aa" if i % 9 < 3 else "bb"], labels[i % 9], "h") for i in range(180)]
    df = spark.createDataFrame(rows, DOCS + ", lang string, source string")
    assert langid.fit(df, "lang", "doc_id").languages == ("aa", "bb")
    got = langid.identify(df, F.col("lang"), F.col("source"), "lang", "doc_id").collect()
    assert all(r._language == ("aa" if r.doc_id % 9 < 3 else "bb") for r in got)


def test_pages_by_markup_suffix_and_host(spark, tmp_path):
    from termloom.llm.queries import pages_language_id

    words = {"de": "der die und ist nicht das ein haus", "en": "the of and is not that house"}
    rows = [(i, f"http://h{i % 3}.{c}/x", f'<html lang="{c}-XX"><script>the of</script><p>{words[c]} {words[c]}</p></html>') for i in range(60) for c in ["de" if i % 2 else "en"]]
    rows += [(100, "http://h0.de/y", f"<html><p>{words['de']}</p></html>"), (101, None, None), (102, "x", "<html lang=de></html>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.language for r in pages_language_id(spark, str(tmp_path)).collect()}
    assert got == {i: "de" if i % 2 else "en" for i in range(60)} | {100: "de", 101: None, 102: None}


# ---- language model ----


find_tokens = re.compile(r"\w+|[^\w\s]").findall


def test_tokens_cut_together_are_those_of_each_text(monkeypatch):
    texts = random_texts(400) + [t or "" for _, t in ODD] + ["a\x00b\x1cc \x85", "İΑΣ\u0307 ΟΔΟΣ Σ", "_a_b-c", "é" * 9, "中" * 300, "." * 300, " " * 300, "ab, " * 300]
    texts += ["".join(chr(c) for c in range(n, n + 64)) for n in range(0, 0xD800, 64)]
    want = []
    for text in texts:
        found = find_tokens(text.lower())
        ids = [xxhash.xxh3_64_intdigest(t) & ~15 | xxhash.xxh3_64_intdigest(t[-2:], 1) % 16 for t in found]
        want.append([i - (i >> 63 << 64) for i in ids])
    sizes = {len(t.encode()) for text in texts for t in find_tokens(text.lower())}
    assert sizes >= {*range(1, 18)}
    for look in (7, 100, 1 << 17):  # texts cut into bits, and laid together
        monkeypatch.setattr(lm_score, "_LOOK", look)
        assert [lm_score.token_ids(t).tolist() for t in texts] == want
        assert [i.tolist() for i in lm_score.tokens_of(texts)] == want
    assert lm_score.tokens_of([]) == []


def test_cutting_into_tokens_takes_less_time_than_the_expression_alone():
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrstéü", k=rng.randint(1, 12))) for _ in range(30_000)]
    text = " ".join(rng.choices(words, k=300_000))
    lm_score.token_ids(text)

    def least(call):
        took = []
        for _ in range(3):
            start = time.process_time()
            call()
            took.append(time.process_time() - start)
        return min(took)

    assert least(lambda: lm_score.token_ids(text)) < least(lambda: find_tokens(text.lower()))


@pytest.mark.parametrize("n", [0, 1, 48, 5000])
def test_places_are_those_of_a_binary_search(n):
    rng = np.random.default_rng(n)
    ends = np.array([-(2**63), -1, 0, 2**63 - 1])
    for ordered in (rng.integers(-(2**63), 2**63 - 1, n), np.arange(n), np.append(rng.integers(-(2**63), 2**63 - 1, n), ends)):
        ordered = np.unique(ordered)
        ids = np.concatenate([ends, ordered, ordered[1:] - 1, ordered[:-1] + 1, rng.integers(-(2**63), 2**63 - 1, 500)])
        at, there = lm_score._Places(ordered).find(ids)
        assert (at == np.searchsorted(ordered, ids)).all() and (there == np.isin(ids, ordered)).all()


def test_a_step_of_training_follows_the_gradient():
    rng = np.random.default_rng(4)
    context, target = rng.integers(0, lm_score.CLASSES + 1, (2 * lm_score.SIDE, 300)), rng.integers(0, lm_score.CLASSES, 300)
    net = lm_score.Net.from_flat(lm_score.Net.start().flat())
    memory = [np.zeros(p.shape) for p in net.parts]
    net.step(context, target, memory)
    start = lm_score.Net.start()
    loss = lambda net: -net.log_p(context, target).astype(np.float64).mean()
    assert loss(net) < loss(start)
    for part, m in zip(range(4), memory, strict=True):
        at = np.unravel_index(m.argmax(), m.shape)
        up, down = lm_score.Net.start(), lm_score.Net.start()
        up.parts[part][at] += 0.01
        down.parts[part][at] -= 0.01
        assert abs(loss(up) - loss(down)) / 0.02 == pytest.approx(m[at] ** 0.5, rel=0.02)


def test_scores_prefer_real_order_and_match_brute_force(spark):
    rng = random.Random(2)
    text = lambda: " ".join(f"{a} {b} {c} ." for a, b, c in ((rng.choice(["the", "a"]), rng.choice(["cat", "dog", "cow"]), rng.choice(["runs", "eats"])) for _ in range(40)))
    df = spark.createDataFrame([(i, text()) for i in range(200)], DOCS).coalesce(2)
    scorer = lm_score.fit(df)
    mixed = []
    for _ in range(20):
        words = text().split()
        rng.shuffle(words)
        mixed.append(" ".join(words))
    held = [text() for _ in range(20)]
    a = scorer.score([lm_score.token_ids(t) for t in held])
    b = scorer.score([lm_score.token_ids(t) for t in mixed])
    assert a.min() > b.max()
    ids = lm_score.token_ids(held[0])
    pad = np.concatenate([[lm_score.CLASSES] * 2, scorer.class_of[ids], [lm_score.CLASSES] * 2])
    one = sum(scorer.net.log_p(np.array([[pad[i - 2]], [pad[i - 1]], [pad[i + 1]], [pad[i + 2]]]), pad[i : i + 1])[0] + scorer.share[ids[i - 2]] for i in range(2, len(pad) - 2))
    assert a[0] == pytest.approx(one, rel=1e-4) and scorer._long(ids) == pytest.approx(one, rel=1e-4)
    got = lm_score.score_documents(odd(spark), scorer=scorer).collect()
    assert len(got) == len(ODD) and [(r.n_tokens, r.log_likelihood, r.mean_log_likelihood) for r in got if r.doc_id == 2] == [(0, 0.0, None)]
    assert lm_score.score_documents(odd(spark).limit(0)).count() == 0


@pytest.mark.parametrize("head", [1 << 15, 30])
def test_every_word_has_its_own_count_and_depends_on_its_neighbours(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)  # 30: most words' counts are joined
    rng = random.Random(12)
    frequent = [f"f{i}" for i in range(lm_score.OWN)]
    words = [f"{c}{i}ng" for i in range(40) for c in "ab"]  # one ending, hence one class
    rows = [(i, " ".join(x for _ in range(30) for x in (*rng.choices(frequent, k=3), rng.choice(words)))) for i in range(80)]
    rows += [(100 + i, " ".join([f"f{i % 48} f0 aonceng f0"] * 4)) for i in range(20)] + [(200, "f1 neverng f1"), (201, (" ".join(frequent * 4) + " z9ng ") * 50)]
    df = spark.createDataFrame(rows, DOCS)
    scorer = lm_score.fit(df.where("doc_id != 200"))
    ids = lm_score.token_ids(" ".join([*words, "aonceng", "z9ng", "neverng"]))
    assert len(set(ids.tolist())) == len(ids) and len(set(scorer.class_of[ids].tolist())) == 1
    context = [lm_score.token_ids("f0 f5 f0 f5"), lm_score.token_ids("f9 f20 f21 f5")]
    p = []
    for c in context:
        texts = [np.concatenate([c[:2], [i], c[2:]]) for i in ids]
        classes = [scorer.class_of[t] for t in texts]
        fixed = np.array([scorer.net.log_p(*lm_score.windows([k])).sum() for k in classes])
        p.append(np.exp(scorer.score(texts) - fixed))
        assert p[-1].sum() == pytest.approx(1, rel=1e-4)  # a distribution over the class's words and one not seen
    by = dict(zip([*words, "aonceng", "z9ng", "neverng"], zip(*p, strict=True), strict=True))
    assert by["aonceng"][0] / by["aonceng"][1] > 1.2 * by["b3ng"][0] / by["b3ng"][1] and min(by["neverng"]) > 0
    got = {r.doc_id: r for r in lm_score.score_documents(df, scorer=scorer).collect()}
    want = scorer.score([lm_score.token_ids(t) for _, t in rows])
    assert len(got) == len(rows) and all(got[i].log_likelihood == pytest.approx(x, rel=1e-6) for (i, _), x in zip(rows, want, strict=True))


# ---- decontamination ----


def test_retrieval_equals_exhaustive_scoring(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 30)))) for i in range(90)]
    table = spark.createDataFrame([*items, (900, None), (901, " "), items[0]], "item_id long, text string")
    index = next(decontaminate.build_indexes(table))
    for _ in range(200):
        terms = sorted(set(rng.sample(range(len(index.terms)), 40)))
        scores = np.zeros(len(index.ids))
        for t in terms:
            scores[index.items[t]] += index.weights[t]
        limit = rng.choice([0.2, 0.4, 0.6])
        assert [i for i, _ in index.retrieve(terms, limit)] == [i for i, s in enumerate(scores) if s >= limit]


def test_leaks(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(3000)]
    item = lambda: " ".join(rng.choices(vocabulary, k=20)) + ". " + " ".join(rng.choices(vocabulary, k=8)) + "."
    items = [(i, item()) for i in range(30)]
    noise = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, noise(rng.randint(0, 400)) + (" " + items[i][1].upper().replace(" ", "\n") + " " if i < 15 else " ") + noise(rng.randint(0, 400))) for i in range(40)]
    rows += [(None, items[3][1]), (50, None), (51, ""), (0, rows[0][1])]
    d, b = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = sorted([(i, i) for i in range(15)] + [(0, 0), (None, 3)], key=str)
    pairs = lambda: sorted(((r.doc_id, r.item_id) for r in decontaminate.find_leaks(d, b).collect()), key=str)
    assert pairs() == want
    assert sorted(r.doc_id for r in decontaminate.drop_leaks(d, b).collect()) == [*range(15, 40), 50, 51]
    assert decontaminate.find_leaks(d.limit(0), b).count() == decontaminate.find_leaks(d, b.limit(0)).count() == 0
    monkeypatch.setattr(decontaminate, "SHARD_CHARS", 500)  # several indexes find the same, each of bounded size
    assert pairs() == want
    assert max(sum(map(len, (items[i][1] for i in x.ids))) for x in decontaminate.build_indexes(b)) < 5 * 500


@pytest.mark.parametrize("shard", [50_000, 20])
def test_partial_leaks_equal_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
    rng = random.Random(16)
    vocabulary = [f"v{i}" for i in range(1500)]
    common = vocabulary[:25]
    words = lambda n, c=0.5: [rng.choice(common if rng.random() < c else vocabulary) for _ in range(n)]
    # the common words lie at one end, so a half may weigh little
    parts = [(words(rng.randint(2, 25), 0.95), words(rng.randint(1, 25), 0.1)) for _ in range(50)]
    items = [(i, " ".join(q) + ". " + " ".join(a) + ".") for i, (q, a) in enumerate(parts)] + [(90, " ".join(words(12)))]
    rows = []
    for q, a in parts:
        whole = q + a
        n = len(whole)
        for piece in (q, a, whole, whole[: n // 2 + 3], whole[n // 2 - 3 :], whole[n // 4 : 3 * n // 4 + 3]):
            rows.append((len(rows), " ".join(words(rng.randint(0, 150), 0.2) + piece + words(rng.randint(0, 150), 0.2))))
    of = {i: [decontaminate.grams(decontaminate._words(x)) for x in decontaminate.split_item(t)] for i, t in items}
    want = set()
    for d, t in rows:
        w = t.split()
        there = {tuple(w[i : i + n]) for n in range(1, 6) for i in range(len(w) - n + 1)}
        for i, (q, a) in of.items():
            both, question = len(q & there) + len(a & there), len(q & there)
            long = max(map(len, q)) == 5
            if 2 * both >= len(q) + len(a) or (long and 2 * question >= len(q)):
                want.add((d, i))
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")).collect()}
    # n-grams a passage apart do not count together
    assert len(want) > 150 and got <= want and all(len(rows[d][1].split()) > 128 for d, _ in want - got) and len(want - got) <= 0.02 * len(want)
    assert all((6 * i, i) in got for i, (q, _) in enumerate(parts) if len(q) >= 5)  # questions alone


# ---- sketches ----


@pytest.mark.parametrize("share", [0, 1])
def test_short_texts_are_as_alike_as_their_shingles(spark, share):
    rng = random.Random(18)
    rows = [(i, " ".join(rng.choices(["aa", "bb", "c", "dddd", "e"] if share else [f"s{i}" for i in range(500)], k=rng.randint(5, 60)))) for i in range(150)]
    shingles = lambda t: {tuple(w[i : i + 5]) for w in [t.lower().split()] for i in range(max(1, len(w) - 4))}
    by = {r.doc_id: r for r in sketch.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()}
    for i, t in rows:
        a, b, c = (shingles(x) for x in (t, sketch.edited(t, rows[i - 1][1]), rows[i - 1][1]))
        assert by[i].near_edited == pytest.approx(len(a & b) / len(a | b)) and by[i].near_next == pytest.approx(len(a & c) / len(a | c))


def test_sketches(spark):
    rng = random.Random(8)
    vocabulary = [f"s{i}" for i in range(900)]
    rows = [(3 * i, " ".join(rng.choices(vocabulary, k=rng.randint(300, 900)))) for i in range(60)]
    rows += [(1, rows[0][1]), (None, "a b c"), (2, None), (4, "")]
    got = sketch.fingerprint_documents(spark.createDataFrame(rows, DOCS)).collect()
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    by = {r.doc_id: r for r in got}
    shingles = lambda t: {tuple(t.lower().split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t.split() else set()
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        n = len(t) // 3
        changed = t[: len(t) - n] + following[:n]
        r = by[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), sha(changed))
        a, b = shingles(t), shingles(changed)
        if len(a) > 250:
            assert r.near_edited == pytest.approx(len(a & b) / len(a | b), abs=0.25)
    assert by[0].fingerprint == by[1].fingerprint
    a, b = by[3].fingerprint, by[6].fingerprint
    assert sketch.containment(a, sketch.merge(a, b)) == 1.0 and sketch.likeness(a, a) == 1.0
    assert sketch.fingerprint_documents(odd(spark)).count() == len(ODD) and sketch.fingerprint_documents(odd(spark).limit(0)).count() == 0
    one = sketch.fingerprint_documents(odd(spark).where("doc_id = 8")).first()
    assert one.near_next == 1.0


# ---- chats ----


def test_chats(spark):
    call = lambda i, name="search", a=None: json.dumps({"tool_calls": [{"id": i, "name": name, "arguments": {"query": "x"} if a is None else a}]})
    result = lambda i: json.dumps({"tool_call_id": i, "content": {"b": 1, "a": [2]}})
    wait = lambda i: {"expression": {"$result": i}}
    rows = [
        (1, 0, "user", "hi"), (1, 0, "user", "hi"), (1, 1, "assistant", call("a")), (1, 2, "tool", result("a")),
        (2, 0, "tool", result("b")), (2, 1, "assistant", call("b")), (2, 2, "assistant", call("c", "calculate", wait("d"))), (2, 3, "assistant", call("d", a={"query": ""})), (2, 4, "tool", result("d")),
        (3, 0, "assistant", call("x", "calculate", wait("y"))), (3, 1, "assistant", call("y", "calculate", wait("x"))), (3, 2, "tool", result("x")), (3, 3, "tool", result("y")),
        (4, 0, "tool", result("none")), (None, None, None, None), (5, 0, "tool", '{"tool_call_id": "\\ud800"}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df, TOOLS).collect()
    assert len(got) == len(rows)
    place = {(r.conv_id, r.turn): (r.order_turn, r.order_depth) for r in got}
    assert sorted((k for k in place if k[0] == 2), key=lambda k: (*place[k], k)) == [(2, 1), (2, 0), (2, 3), (2, 4), (2, 2)]
    errors = {(r.conv_id, r.turn): r.error for r in got}
    assert errors[2, 3] == "$.query: too short" and errors[2, 2] is None and errors[4, 0] == "no such call" and errors[3, 2] == errors[3, 0] == "cycle"
    line = next(r.json for r in got if (r.conv_id, r.turn) == (1, 2))
    assert line == '{"content":"{\\"a\\":[2],\\"b\\":1}","role":"tool","tool_call_id":"a"}'
    assert chat.format_chats(df.limit(0)).count() == 0
    assert chat.schema_error({"query": "a", "z": 1}, TOOLS["search"]) == "$.z: not allowed" and chat.schema_error({"query": True}, TOOLS["search"]) == "$.query: not of type string"


def test_odd_calls(spark):
    call = lambda **c: json.dumps({"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x"}} | c]})
    rows = [
        (1, 0, "assistant", call(name=["x"])), (2, 0, "assistant", call(arguments={"$result": "a"})), (3, 0, "user", call()),
        (4, 0, "assistant", '{"tool_calls": [{"id": "a", "name": "search", "arguments": {"query": "x", "limit": 1e400}}]}'),
        (5, 0, "assistant", json.dumps({"tool_calls": [], "mood": 1})), (6, 0, "assistant", call(arguments={"query": {"$result": "zz"}})),
        (7, 0, "assistant", call(arguments={"query": {"$result": ["zz"]}})), (8, 0, "user", "long " * 400_000),
    ]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, k int, call string")
    got = {r.conv_id: r for r in chat.format_chats(df, TOOLS).collect()}
    assert {i: r.error for i, r in got.items()} == {1: 'unknown tool ["x"]', 2: "$.query: missing", 3: None, 4: None, 5: "unknown key mood", 6: "refers to no call", 7: "$.query: not of type string", 8: None}
    assert json.loads(got[4].json) == {"role": "assistant", "content": rows[3][3]} and len(json.loads(got[8].json)["content"]) == 2_000_000
    with pytest.raises(ValueError):
        chat.format_chats(df, {"search": {"type": "object", "properties": {"q": {"pattern": "a"}}}})


def test_places_equal_a_plain_topological_order(spark):
    rng = random.Random(25)
    rows, want = [], {}
    for c in range(25):
        n = rng.randint(1, 7)
        waits = {i: sorted({rng.randrange(n) for _ in range(rng.randint(0, 2))} - {i}) if c % 4 == 0 else sorted({rng.randrange(i) for _ in range(rng.randint(0, 2))} if i else set()) for i in range(n)}
        turns = rng.sample(range(40), 2 * n)
        called, answered = turns[:n], turns[n:]
        for i in range(n):
            arguments = {"expression": "e"} | {f"w{j}": {"$result": f"c{j}"} for j in waits[i]}
            rows.append((c, called[i], "assistant", json.dumps({"tool_calls": [{"id": f"c{i}", "name": "calculate", "arguments": arguments}]})))
            rows.append((c, answered[i], "tool", json.dumps({"tool_call_id": f"c{i}", "content": "r"})))
        before = {answered[i]: [called[i]] for i in range(n)} | {called[i]: [answered[j] for j in waits[i]] for i in range(n)}

        def place(t, path, before=before):
            if t in path:
                return None
            asks = [place(p, {*path, t}) for p in before[t]]
            if None in asks:
                return None
            return max([(t, 0), *((at, depth + 1) for at, depth in asks)])

        for t in before:
            want[c, t] = place(t, set())
    schema = "conv_id long, turn long, role string, text string"
    got = {(r.conv_id, r.turn): None if r.error == "cycle" else (r.order_turn, r.order_depth) for r in chat.format_chats(spark.createDataFrame(rows, schema), TOOLS).collect()}
    assert got == want and any(w is None for w in want.values()) and any(w and w[1] > 2 for w in want.values())
