"""The stages on a small corpus with planted copies, repeated lines, leaks and texts without letters."""

from __future__ import annotations

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(9)
    words = {"en": [f"{a}{b}" for a in ("th", "on", "er") for b in ("ing", "at", "ed", "ly")], "de": [f"{a}{b}" for a in ("sch", "ge", "ver") for b in ("ung", "keit", "lich", "ß")]}
    line = lambda c: " ".join(rng.choices(words[c], k=14)) + f" n{rng.random()}"
    items = [(i, line("en") + ". " + line("en") + ".") for i in range(5)]
    rows = [(i, "\n".join(line(c) for _ in range(4)), c, f"h{i % 2}", 0) for i in range(40) for c in [rng.choice(["en", "de"])]]
    rows.append((100, rows[0][1], "en", "h0", 0))  # an exact copy
    rows.append((101, line("en") + "\n" + rows[1][1].split("\n")[0], "en", "h0", 0))  # a repeated line
    rows.append((102, line("en") + "\n" + items[2][1], "en", "h1", 0))  # a leak
    rows.append((103, "%%% 123", "en", "h1", 0))
    rows.append((104, None, None, None, None))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        new = stage(spark, docs, str(tmp_path))
        if name != "bpe":
            assert new.columns == corpus_pipeline.COLUMNS
        new.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append({r.doc_id: r for r in docs.collect()})
    assert set(kept[0]) == {*range(40), 100, 101, 102}
    assert set(kept[1]) == {*range(40), 101, 102} and kept[1][101].text == rows[41][1].split("\n")[0] and kept[1][101].n_chars == len(kept[1][101].text)
    assert set(kept[3]) == {*range(40), 101}
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == set(kept[4]) == set(kept[3])


def test_stage_two_brings_no_rows_of_lines_to_the_driver(spark, monkeypatch):
    rng = random.Random(11)
    lines = [" ".join(f"w{rng.randrange(10_000)}" for _ in range(12)) for _ in range(300)]
    docs = spark.createDataFrame([(i, lines[i % 300] + f"\nonly here {rng.random()} {rng.random()}", "en", "h", 0) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    frame, rows = type(docs), []
    plain = frame.collect
    monkeypatch.setattr(frame, "collect", lambda self: rows.append(plain(self)) or rows[-1])
    out = dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, "")
    assert sum(map(len, rows)) <= 10  # counts, whatever the number of lines that occur again
    monkeypatch.undo()
    assert sum(len(r.text.split("\n")) for r in out.collect()) == 900
