"""The pipeline's stages one after the other, each against what it must do."""

from __future__ import annotations

import random
from collections import Counter

import corpus_pipeline

from test_corpus import groups, prose


def test_stages(spark, tmp_path):
    rng = random.Random(20)
    words = {"en": ["the", "thing", "with", "house", "and"], "de": ["der", "schön", "über", "haus", "und"]}
    passage = prose(rng, 60, 9000)
    rows = []
    for i in range(160):
        lang = rng.choice(list(words))
        text = " ".join(rng.choice(words[lang]) + str(rng.randrange(300)) for _ in range(rng.randrange(20, 200)))
        if i % 9 == 0:
            text += " " + passage
        rows.append((i, text, lang, rng.choice(["a", "a", "a", "b", None]), len(text)))
    rows += [(200 + i, rows[i][1], *rows[i][2:]) for i in range(20)]
    rows += [(300, None, "en", "a", 0), (301, "12 !", "en", "a", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    sf, now, by = str(tmp_path), spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, sf).write.parquet(str(tmp_path / name))
        now = by[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert now.columns == columns
    ids = lambda n: Counter(r["doc_id"] for r in by[n].collect())
    assert ids("language_id") == Counter(r[0] for r in rows if r[0] < 300)
    want, _ = groups([r for r in rows if r[0] < 300], 5)
    assert ids("near_dedup") == Counter(set(want))
    assert ids("passage_dedup") == ids("near_dedup")
    left = [r["text"] for r in by["passage_dedup"].collect()]
    assert sum(passage in t for t in left) == 1
    before = {r["doc_id"]: r["text"] for r in by["passage_dedup"].collect()}
    for r in by["source_mix"].collect():
        assert before[r["doc_id"]].startswith(r["text"].rstrip()) and r["n_chars"] == len(r["text"])
    assert max(ids("source_mix").values()) <= 3
    assert by["packing"].agg({"length": "sum"}).first()[0] > 0
    whole = corpus_pipeline.run(spark, sf)
    key = lambda df: Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert key(whole) == key(by["packing"])


CLASH = "_gone _id _spans _size _source _takes _words _row _length _text_hash _letters _text _hash slot words rep band component_id key doc size no".split()


def test_stages_with_clashing_columns_and_odd_rows(spark):
    """Extra columns of helpers' names, nulls in every column, repeated rows, and a very long text."""
    rng = random.Random(31)
    word = lambda: rng.choice(["the", "thing", "with", "house"]) + str(rng.randrange(4000))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(60, 120))), "en", rng.choice(["a", None]), 1) for i in range(30)]
    rows += [(3, rows[3][1], "en", "a", 1)] * 2 + [(None, rows[4][1], None, None, None), (40, None, None, None, None), (41, "", "en", "a", 0), (42, " ".join(word() for _ in range(60_000)), "en", "a", 1)]
    rows.append((43, rows[-1][1], "en", "b", 1))
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"kept {c}") for c in CLASH})
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        whole = stage(spark, docs, "")
        now = spark.createDataFrame(stage(spark, now, "").collect(), docs.schema)
        for found in (whole, now):
            assert found.columns == docs.columns and found.filter(" or ".join(f"`{c}` is null or `{c}` <> 'kept {c}'" for c in CLASH)).count() == 0
        ids = Counter(r["doc_id"] for r in whole.collect())
        if name == "language_id":
            assert ids == Counter(r[0] for r in rows if r[1])
        if name == "near_dedup":
            assert ids[43] == 0 and ids[42] == ids[40] == ids[41] == ids[None] == 1
        if name == "passage_dedup":
            assert sum(ids.values()) == len(rows)
        if name == "source_mix":
            assert set(ids) <= {r[0] for r in rows if r[1]} and ids[40] == ids[41] == 0
    assert corpus_pipeline.STAGES[-1][1](spark, now, "").count() > 0


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, _row string")
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, "")
        assert found.count() == 0, name
        assert name == "packing" or found.columns == docs.columns


def test_identified_language_reaches_the_sequences(spark):
    """Missing and wrong labels are replaced by what the text is, and no sequence has two languages."""
    rng = random.Random(41)
    words = {"en": ["the", "thing", "with", "house", "and"], "de": ["der", "schön", "über", "haus", "und"]}
    rows, true = [], {}
    for i in range(200):
        true[i] = lang = rng.choice(list(words))
        label = None if i % 10 == 3 else next(v for v in words if v != lang) if i % 25 == 7 else lang
        rows.append((i, " ".join(rng.choice(words[lang]) for _ in range(60)), label, "a", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    named = dict(corpus_pipeline.STAGES)
    known = spark.createDataFrame(named["language_id"](spark, docs, "").collect(), docs.schema)
    assert {r["doc_id"]: r["lang"] for r in known.collect()} == true
    found, whole = {}, Counter()
    for r in named["packing"](spark, known, "").collect():
        found.setdefault(r["sequence_id"], set()).add(true[r["doc_id"]])
        whole[r["doc_id"]] += r["length"]
    assert all(len(v) == 1 for v in found.values()) and set(whole) == set(true)
