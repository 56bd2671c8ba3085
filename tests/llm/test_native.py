"""Licence scans and fingerprints against plain Python."""

from __future__ import annotations

import hashlib
import random
import re

import pytest

from strandlake.llm.op1_licenses import PHRASES, licences
from strandlake.llm.op4_merkle import edits, fingerprints

NOTICE = "Licensed under the Apache License, Version 2.0."
GPL = "This work is licensed under the GNU General Public License, version 3."


def test_licences_against_python(documents):
    rng = random.Random(1)
    pieces = [NOTICE, GPL, "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "cc by cc by", "of the", "Éa wörd", "gnu general\npublic,license", "apache", "license", "İx"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(9)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "..."), (103, NOTICE), (103, NOTICE), (None, "mit license"), (104, "w " * 30_000 + GPL)]
    got = {}
    for r in licences(documents(rows)).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows) and len(got[103]) == 2
    for doc_id, text in rows:
        fold = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold)
        at = [(i, label) for phrase, label in PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        for r in got[doc_id]:
            assert r["n_words"] == len(words)
            assert r["n_base"] == len(at)
            assert r["first_word"] == min((i for i, _ in at), default=None)
            assert r["last_word"] == max((i for i, _ in at), default=None)
            base = sorted({label for _, label in at})
            assert r["base_labels"] == ",".join(base)
            assert set(base) <= set(r["labels"].split(","))
            assert 0 <= r["score"] <= 1
    assert got[103][0]["labels"] == "apache,apache-2.0"
    assert "gpl-3.0" in got[104][0]["labels"]


def test_a_notice_with_a_word_put_in_is_one_span(documents):
    text = "foo licensed under the famous apache license version 2 0 bar"
    (r,) = licences(documents([(1, text)])).collect()
    assert r["labels"] == "apache,apache-2.0" and 0.6 < r["score"] <= 1


def test_a_template_of_any_length(documents, monkeypatch):
    from strandlake.llm import op1_licenses

    rng = random.Random(30)
    own = [f"t{i}" for i in range(150)]
    monkeypatch.setattr(op1_licenses, "NOTICES", ((" ".join(own), "long"),))
    edited, half, shuffled = list(own), own[:75], list(own)
    edited[70:70] = ["put", "in"]
    rng.shuffle(shuffled)
    texts = [own, edited, half, shuffled, own[75:] + own[:75], ["x"] * 50 + own * 2]
    got = {r["doc_id"]: r["labels"] for r in licences(documents([(i, " ".join(t)) for i, t in enumerate(texts)])).collect()}
    assert got == {0: "long", 1: "long", 2: "", 3: "", 4: "", 5: "long"}


def test_empty_tables(documents):
    assert licences(documents([])).count() == 0
    assert fingerprints(documents([])).count() == 0


def brute_tree(text):
    """(root, sections); a section is (hash, paragraphs); a paragraph (hash, pieces as texts)."""
    sections, now, hashes = [], [], []
    lines = text.split("\n")
    for i, line in enumerate(lines):
        digest = hashlib.sha256(line.encode()).hexdigest()
        now.append((digest[:16], re.findall(r"[^.!?\n]{1,48}[.!?]*|[.!?\n]+", line)))
        hashes.append(digest)
        if digest.endswith("0") or i == len(lines) - 1:
            sections.append((hashlib.sha256("".join(hashes).encode()).hexdigest(), now))
            now, hashes = [], []
    return hashlib.sha256("".join(h for h, _ in sections).encode()).hexdigest(), sections


def brute_likeness(one, two):
    """Branches in common first, then below the others."""
    a, b = brute_tree(one), brute_tree(two)
    if a[0] == b[0]:
        return 1.0
    same, (x, y) = 0, [{h: own for h, own in t[1]} for t in (a, b)]
    same += sum(max(1, len(p)) for h in x.keys() & y.keys() for _, p in x[h])
    x, y = [{h: p for s in i.keys() - j.keys() for h, p in i[s]} for i, j in ((x, y), (y, x))]
    same += sum(max(1, len(x[h])) for h in x.keys() & y.keys())
    x, y = [{q for h in i.keys() - j.keys() for q in i[h]} for i, j in ((x, y), (y, x))]
    return (same + len(x & y)) / either if (either := same + len(x | y)) else 0.0


def test_fingerprints_against_python(documents):
    rng = random.Random(2)
    words = ["alpha", "beta.", "gamma\n", "delta é", "Sentence ends. ", "𝄞"]
    rows = [(i * 3, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(2600)]
    rows += [(1, None), (2, ""), (4, "x"), (5, "x"), (7, "long line " * 20_000), (None, "last one here")]
    rng.shuffle(rows)
    got = {r["doc_id"]: r for r in fingerprints(documents(rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    by_text = {}
    for (doc_id, text), (_, following) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        text, following, r = text or "", following or "", got[doc_id]
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        assert r["n_chars"] == len(text)
        assert r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert (r["edited_fingerprint"] == r["fingerprint"]) == (edited == text)
        root, sections = brute_tree(text)
        shape = [[len(p) for _, p in own] for _, own in sections]
        lines = [[p for p in line.split(":")[1].split(",")] for line in r["fingerprint"].split("/")[1:]]
        assert r["fingerprint"].startswith(root + "/") and [[len(q.split(".")) if (q := p.split("=")[1]) else 0 for p in own] for own in lines] == shape
        assert r["near_edited"] == pytest.approx(brute_likeness(text, edited))
        assert r["near_next"] == pytest.approx(brute_likeness(text, following))
    assert len(set(by_text.values())) == len(by_text)
    assert got[4]["near_next"] == 1 and got[1]["near_next"] == 1


def test_one_row_and_equal_rows(documents):
    (r,) = fingerprints(documents([(5, "abcd")])).collect()
    assert r["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert fingerprints(documents([(5, "abcd"), (5, "abcd"), (5, "zz")])).count() == 3
    assert fingerprints(documents([(None, "abcd"), (None, "x")])).count() == 2


def test_ranges_split_rows_of_one_id(documents, monkeypatch):
    """A third of the rows has no id: ranges go by the text's hash too, and the order stays whole."""
    from strandlake.llm import op4_merkle

    monkeypatch.setattr(op4_merkle, "RANGE_ROWS", 10)
    rows = [(None if i % 3 == 0 else i, f"text {i}") for i in range(300)] + [(7, "text 7")] * 3
    got = op4_merkle.followed(documents(rows)).collect()
    assert len(got) == len(rows)
    after, before = sorted(r["next_text"] for r in got), sorted(t for _, t in rows)
    assert after == before
    known = sorted((i, t) for i, t in rows if i is not None)
    follows = {r["text"]: r["next_text"] for r in got if r["doc_id"] not in (None, 7)}
    assert all(follows[t] == u for (i, t), (_, u) in zip(known, known[1:], strict=False) if i != 7)


def test_edits_are_located(spark):
    df = spark.createDataFrame([("a\nb\nc\nd", "a\nb\nX\nd"), ("a\nb", "a\nb"), ("a\nb", None)], "one string, two string")
    assert [r["edited_paragraphs"] for r in edits(df, "one", "two").collect()] == [[2], [], [0, 1]]
