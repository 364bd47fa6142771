"""Operators on small hand-written collections and graphs."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from termloom.config import EngineConfig, QueryType, Ranking, TokenizerConfig
from termloom.functions import postings
from termloom.functions.distance import indel_distance
from termloom.functions.text import STANDARD_PATTERNS, basename, diacritics, glob_regex, shorten
from termloom.operators import evaluation, feedback, index, kgram, links, search, spelling
from termloom.plans.engine import SearchEngine
from termloom.sources import files


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def ids(df, column="doc_id"):
    return sorted(r[column] for r in df.collect())


def terms(spark, text, **options):
    return index.token_arrays(docs(spark, text), TokenizerConfig(**options)).first()["terms"]


def test_statistics_count_empty_documents(spark):
    d = docs(spark, "Apple pie, apple", "pie", "", None)
    assert {(r.doc_id, r["len"]) for r in index.doc_lengths(d).collect()} == {(0, 3), (1, 1), (2, 0), (3, 0)}
    toks = index.tokens(d)
    assert {(r.doc_id, r.term): r.tf for r in index.term_freq(toks).collect()} == {(0, "apple"): 2, (0, "pie"): 1, (1, "pie"): 1}
    assert {r.term: r.df for r in index.doc_freq(index.term_freq(toks)).collect()} == {"apple": 1, "pie": 2}
    assert tuple(index.corpus_stats(d).first()) == (4, 4, 2)


def test_tokens_with_patterns(spark):
    text = "Mail a.b@c.org at 18:15:34, it's 7,919,900 or 2.4.1; re-do 24/7 and file.txt $200"
    found = terms(spark, text, patterns=STANDARD_PATTERNS)
    assert found == ["mail", "a.b@c.org", "at", "18:15:34", "it's", "7,919,900", "or", "2.4.1", "re-do", "24/7", "and", "file.txt", "$200"]
    assert terms(spark, "Plain, words") == ["plain", "words"]
    assert terms(spark, "a-b!", remove_punctuation=False) == ["a", "-", "b", "!"]
    assert terms(spark, "Été Åke", remove_diacritics=True) == ["ete", "ake"]
    assert terms(spark, "one two", flush_last=False) == ["one"]
    marked, plain = diacritics()
    assert len(marked) == len(plain) and plain[marked.index("Š")] == "S" and plain[marked.index("ž")] == "z"


def test_boolean_and_phrase(spark):
    toks = index.tokens(docs(spark, "a b c", "a c b", "a b a b", "b a")).persist()
    assert ids(search.phrase(toks, ["a", "b"])) == [0, 2]
    assert ids(search.phrase(toks, ["a", "b", "a"])) == [2]
    assert ids(search.phrase(toks, ["b", "b"])) == []
    assert ids(search.boolean_and(toks, ["a", "c"])) == [0, 1]
    assert ids(search.boolean_or(toks, ["c", "zz"])) == [0, 1]
    assert [r.term for r in search.missing_terms(toks, ["a", "zz", "y*"]).collect()] == ["zz"]
    for slots in (["a", "b"], ["b", "c"]):
        assert set(ids(search.phrase(toks, slots))) <= set(ids(search.boolean_and(toks, slots))) <= set(ids(search.boolean_or(toks, slots)))


def test_strict_intersection_starts_anew(spark):
    toks = index.tokens(docs(spark, "x", "y", "z", "z"))
    assert ids(search.boolean_and(toks, ["x", "y", "z"])) == []
    assert ids(search.boolean_and_strict(toks, ["x", "y", "z"])) == [2, 3]


def test_tf_idf_integer_quotient(spark):
    arrays = index.token_arrays(docs(spark, "a b", "a a c", "b", "d"))
    got = {r.doc_id: r.score for r in search.tf_idf(arrays, ["a", "b"]).collect()}
    idf = math.log10(2)
    assert got == pytest.approx({0: idf / 2 + idf / 2, 1: idf * 2 / 3, 2: idf})
    twice = {r.doc_id: r.score for r in search.tf_idf(arrays, ["a", "a"]).collect()}
    assert twice[1] == pytest.approx(2 * idf * 2 / 3)
    common = {r.doc_id: r.score for r in search.tf_idf(index.token_arrays(docs(spark, "a", "a b", "b c")), ["a"]).collect()}
    assert common == {0: 0.0, 1: 0.0}


def test_paging_breaks_ties_by_document(spark):
    scored = spark.createDataFrame([(i, 1.0) for i in range(25)], "doc_id long, score double")
    assert [r.doc_id for r in search.page(scored, 11, 20).orderBy("rank").collect()] == list(range(10, 20))


def test_kgrams_and_wildcards(spark):
    voc = spark.createDataFrame([(t,) for t in ("ma", "math", "maths", "mathematics", "path", "banana", "a.b")], "term string")
    grams = kgram.kgram_index(voc)
    assert grams.where("term = 'banana' and gram = 'an'").count() == 1
    assert ids(kgram.lookup_all(grams, ["^m", "s$"]), "term") == ["mathematics", "maths"]
    with pytest.raises(ValueError):
        kgram.lookup_all(grams, ["abc"])
    for glob, want in {"ma*": ["ma", "math", "mathematics", "maths"], "*th": ["math", "path"], "m*s": ["mathematics", "maths"], "ma": ["ma"], "a.*": ["a.b"]}.items():
        assert ids(kgram.expand(voc, glob), "term") == want
    assert glob_regex("a.b*") == "^(?:a\\.b.*)$"


def indel(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (0 if x == y else 2)))
        row = new
    return row[-1]


def test_edit_distance(spark):
    random.seed(1)
    pairs = [("kitten", "sitting"), ("abc", "abd"), ("math", "mathematics"), ("", "ab"), ("ab", ""), ("", "")]
    pairs += [("".join(random.choices("abc", k=random.randint(0, 7))), "".join(random.choices("abc", k=random.randint(0, 7)))) for _ in range(40)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", indel_distance(F.col("a"), F.col("b")).alias("d")).collect():
        assert r.d == indel(r.a, r.b)


def test_spelling(spark):
    d = docs(spark, "keit und keit", "keit und", "zeit und")
    engine = SearchEngine.over(d)
    assert engine.suggest("keitt und")[0] == "keit und"
    assert engine.suggest("q und") == []
    freq = engine.index.terms
    # keit shares ke, ei, it of 4 grams in all; zeit ei, it of 5
    assert spelling.best(spelling.suggest(freq, "keiit")) == ["keit", "zeit"]
    short = spark.createDataFrame([(t, 1) for t in ("ke", "kei", "eit", "keit", "eeee")], "term string, cf long")
    # sizes only, repeats counted: 4 letters or more, against the 4 bigrams of keeit; eeee has three, all the same
    assert ids(spelling.suggest(short, "keeit", EngineConfig(max_edit=9), strict=True), "term") == ["eeee", "keit"]


def test_feedback(spark):
    arrays = index.token_arrays(docs(spark, *[f"t{i} a" for i in range(12)]))
    marks = [i in (0, 3, 11) for i in range(12)]
    got = {r.term: r.weight for r in feedback.feedback_weights(arrays, ["a"], list(range(12)), marks).collect()}
    assert got == pytest.approx({"a": 1.2, "t0": 0.8 / 3 / 2, "t3": 0.8 / 3 / 2})
    strict = feedback.feedback_weights(arrays, ["a"], list(range(12)), marks, strict=True)
    assert strict.where("term = 'a'").count() == 2


def edges(spark, *pairs):
    return spark.createDataFrame(list(pairs), "src long, dst long")


def test_pagerank(spark):
    ring = {r.id: r.score for r in links.pagerank(edges(spark, (1, 2), (2, 3), (3, 1)), epsilon=1e-9).collect()}
    assert ring == pytest.approx({1: 1 / 3, 2: 1 / 3, 3: 1 / 3})
    alone = spark.createDataFrame([(3,)], "id long")
    loose = {r.id: r.score for r in links.pagerank(edges(spark, (1, 2), (1, 2)), alone, epsilon=1e-9).collect()}
    assert sum(loose.values()) == pytest.approx(1) and loose[2] > loose[1] == pytest.approx(loose[3])


def test_hits(spark):
    got = {r.id: (r.hub, r.authority) for r in links.hits(edges(spark, (1, 11), (1, 12), (2, 11), (2, 12), (2, 13)), epsilon=1e-9).collect()}
    assert all(got[i][1] == 0 for i in (1, 2)) and all(got[i][0] == 0 for i in (11, 12, 13))
    assert sum(h * h for h, _ in got.values()) == pytest.approx(1) and sum(a * a for _, a in got.values()) == pytest.approx(1)
    assert ids(links.base_set(edges(spark, (1, 2), (3, 1), (4, 5)), spark.createDataFrame([(1,)], "id long")), "id") == [1, 2, 3]


def test_walks_approach_pagerank(spark):
    graph = edges(spark, (0, 1), (1, 2), (2, 0), (2, 1), (1, 3))
    exact = {r.id: r.score for r in links.pagerank(graph, epsilon=1e-10).collect()}
    got = {r.id: r.score for r in links.monte_carlo(graph, 3000, 2).collect()}
    # no walk is cut: without boredom, all walk on to the node without links
    ends = {r.id: r.score for r in links.monte_carlo(edges(spark, *[(i, i + 1) for i in range(60)]), 1, 5, bored=0.0).collect()}
    assert ends[60] > ends[0] > -1
    assert sum(got.values()) == pytest.approx(1)
    assert max(abs(got[i] - exact[i]) for i in exact) < 0.02


def test_walks_at_rest_are_not_carried_on(spark, monkeypatch):
    sizes = []
    save = links.Scratch.save

    def counted(self, df):
        out = save(self, df)
        if "alive" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(links.Scratch, "save", counted)
    # every walk ends where the link leads; only the source's walk takes a second step
    got = {r.id: r.score for r in links.monte_carlo(edges(spark, (0, 1)), 4, 4, bored=-1.0).collect()}
    assert got == {0: 4 / 12, 1: 8 / 12} and sizes == [8, 4]


def test_engine_and_evaluation(spark):
    d = docs(spark, "red fox", "red red dog", "blue fox", "green", "green", "green")
    ranks = spark.createDataFrame([(0, 0.5), (1, 0.25)], "doc_id long, score double")
    e = SearchEngine.over(d, ranks=ranks, edges=edges(spark, (0, 1), (2, 1)))
    assert ids(e.search("red fox")) == [0]
    assert ids(e.search("red nothing")) == [] and e.missing("red nothing") == ["nothing"]
    assert ids(e.search("red fox", QueryType.PHRASE)) == [0]
    assert {r.doc_id: r.score for r in e.search("red", QueryType.RANKED, Ranking.PAGERANK).collect()} == {0: 0.5, 1: 0.25}
    assert ids(e.search("red fox", QueryType.RANKED, Ranking.HITS)) == [0, 1, 2]
    assert e.search("red fox", QueryType.RANKED, Ranking.COMBINATION).count() == 3
    judged = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, grade int")
    q = evaluation.quality(spark.createDataFrame([(0, 1), (1, 2)], "doc_id long, rank int"), judged).first()
    assert (q["precision"], q["recall"], q["ndcg"]) == (0.1, 1.0, 1.0)


def test_index_comes_back(spark, tmp_path):
    d = docs(spark, "a b a", "b", "math mathematics path ma", "")
    index.Index.write(d, str(tmp_path / "i"))
    loaded = index.Index.load(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, loaded.postings("a").collect())) == [(0, 0), (0, 2)]
    assert sorted(map(tuple, loaded.docs.select("doc_id", "len").collect())) == [(0, 3), (1, 1), (2, 4), (3, 0)]
    assert {tuple(r) for r in loaded.terms.where("term in ('a', 'b')").collect()} == {("a", 1, 2), ("b", 2, 2)}
    for glob, want in {"ma*": ["ma", "math", "mathematics"], "*th": ["math", "path"], "m*s": ["mathematics"], "*": ["a", "b", "ma", "math", "mathematics", "path"]}.items():
        assert ids(loaded.expand(glob), "term") == want
    plan = loaded.frequencies(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("]")[0]
    assert loaded.frequencies(["m*", "b"]).count() == 5 and loaded.frequencies(["zz"]).count() == 0 and loaded.frequencies(["z*"]).count() == 0


ODD = ("Straße İstanbul ΣΑΣ ǅ", "日本語 テスト漢", "𝒳𝓎𐐀 x²½ Ⅷ٣", "", None, "a\u0301b _c", "é1-2_3é", "🙂ok🙂", "ab", "cd", "é", "no\u00a0break\u200bwidth", "Ωé" * 9)


def test_index_cuts_texts_like_the_tokeniser(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "CHUNK", 2)
    d = docs(spark, *ODD, "x x y", "y x", "x")
    for config in (TokenizerConfig(), TokenizerConfig(remove_diacritics=True), TokenizerConfig(case_folding=False), TokenizerConfig(flush_last=False), TokenizerConfig(patterns=STANDARD_PATTERNS)):
        stored = index.Index.of(d.repartition(3), str(tmp_path / str(hash(config))), config)
        want = sorted(map(tuple, index.tokens(d, config).select("term", "doc_id", "off").collect()))
        assert sorted(map(tuple, stored.tokens.select("term", "doc_id", "off").collect())) == want
        assert sorted(map(tuple, stored.docs.select("doc_id", "len").collect())) == sorted(map(tuple, index.doc_lengths(d, config).collect()))


def test_index_groups_tokens_before_it_shuffles_them(spark, tmp_path):
    d = docs(spark, *["a b a"] * 40).coalesce(1)
    stored = index.Index.of(d, str(tmp_path / "i"))
    # a row a term, not one for each of its 40 documents, and only the tables that are asked for
    assert {(r.term, r.n, r.total) for r in stored.rows.collect()} == {("a", 40, 80), ("b", 40, 40)}
    assert stored.counts.count() == 80 and [x.name for x in (tmp_path / "i").iterdir()] == ["postings"]


def test_weighted_terms_keep_the_postings_where_they_are(spark, tmp_path):
    stored = index.Index.of(docs(spark, "a b a", "b c", "c"), str(tmp_path / "i"))
    weights = spark.createDataFrame([("a", 2.0), ("c", 1.0), ("zz", 1.0)], "term string, w double")
    got = stored.weighted(weights)
    assert sorted((r.term, r.doc_id, r.tf, r.len, r.df, r.w) for r in got.collect()) == [("a", 0, 2, 3, 1, 2.0), ("c", 1, 1, 2, 2, 1.0), ("c", 2, 1, 1, 2, 1.0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_files(spark, tmp_path):
    lines = spark.createDataFrame([("1;2,3,",), ("2;",), ("3;1,1,",)], "value string")
    assert sorted((tuple(r) for r in files.parse_links(lines).collect()), key=str) == [(1, 2), (1, 3), (2, None), (3, 1)]
    titles = spark.createDataFrame([(1, "a=b")], "id long, title string")
    ranks = spark.createDataFrame([(1, 0.5)], "id long, score double")
    files.write_ranks(ranks, titles, str(tmp_path / "r"))
    assert tuple(files.read_ranks(spark, str(tmp_path / "r")).first()) == ("a=b", 0.5, "1")
    many = spark.range(100).select("id", (F.col("id") * 37 % 100 / 128).alias("score"))
    files.write_ranks(many, spark.range(100).select("id", F.concat(F.lit("t"), "id").alias("title")), str(tmp_path / "rr"))
    written = [float(x.value.split("=")[1].split(";")[0]) for x in spark.read.text(str(tmp_path / "rr")).withColumn("f", F.input_file_name()).orderBy("f", F.monotonically_increasing_id()).collect()]
    assert len(written) == 100 and written == sorted(written, reverse=True)
    files.write_link_to_doc(spark.createDataFrame([(4, 9)], "node_id long, doc_id long"), str(tmp_path / "m"))
    assert tuple(files.read_link_to_doc(spark, str(tmp_path / "m")).first()) == (4, 9)
    assert files.top_lines(spark.createDataFrame([(21, 0.034579556), (2, 0.5)], "id long, score double"), 2) == ["2: 0.50000", "21: 0.03458"]
    (tmp_path / "p").write_text("// note\n\n  a+ \nb\n")
    assert files.read_patterns(spark, str(tmp_path / "p")) == ("a+", "b")
    files.write_top(spark.createDataFrame([(21, 0.034579556)], "id long, score double"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()["value"] == "21: 0.034580"
    (tmp_path / "c" / "x").mkdir(parents=True)
    (tmp_path / "c" / "x" / "one.txt").write_text("hello\nthere")
    assert [r.text for r in files.read_collection(spark, str(tmp_path / "c")).collect()] == ["hello\nthere"]
    files.write_doc_info(spark.createDataFrame([(1, "a;b", 3)], "doc_id long, name string, len int"), str(tmp_path / "d"))
    assert tuple(files.read_doc_info(spark, str(tmp_path / "d")).first()) == (1, "a;b", 3)


def test_small_strings(spark):
    df = spark.createDataFrame([("a/b\\c.txt", "x" * 51)], "p string, t string")
    assert tuple(df.select(basename(F.col("p")), shorten(F.col("t"))).first()) == ("c.txt", "x" * 50 + "...")
