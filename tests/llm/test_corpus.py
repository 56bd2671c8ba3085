"""Mixing, near-duplicates, passages, scoring, packing, search, archives and language identification against plain Python."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from strandlake.llm import op3_mixing, op5_topk, op6_minhash, op7_passages, op8_ppm, op9_packing, op10_langid
from strandlake.llm.graph import components
from strandlake.llm.op2_warc import archived
from strandlake.llm.warc import LoserTree, url_key

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def prose(rng, n, words=400):
    return " ".join(rng.choice([f"w{i}" for i in range(words)]) for _ in range(n))


# ---- mixing ----


def filled(sizes):
    """Targets by resharing until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, full, out = float(sum(sizes.values())), set(), {}
    while True:
        rest = [s for s in order if s not in full]
        total = sum(weight[s] for s in rest)
        over = [s for s in rest if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            return out | {s: left * weight[s] / total for s in rest}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            full.add(s)


def test_mixing(documents):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(1, 200)), "en", rng.choice(["big"] * 6 + ["a", "b", "ü", None])) for i in range(400)]
    rows += [(900, None, "en", "a"), (901, "", "en", "zero"), (901, "", "en", "zero"), (None, "x y", "en", "b")]
    got = op3_mixing.mixed(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(SPACED.findall(r[1] or ""))
    aim, taken = filled(sizes), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(aim[r["source"]])
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for s, t in aim.items():
        assert abs(taken[s] - t) <= 8 * op3_mixing.BLOCK
    again = op3_mixing.mixed(documents(rows).repartition(7)).collect()
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert op3_mixing.mixed(documents([])).count() == 0
    assert [r["taken"] for r in op3_mixing.mixed(documents([(1, None), (2, "")])).collect()] == [0, 0]


def test_schedule_is_even(spark):
    aims = spark.createDataFrame([(0, 5.0), (1, 2.0), (2, 1.0)], "no long, target double")
    slots = op3_mixing.ranked(op3_mixing.schedule(spark, aims, 1600), 100).orderBy("slot").collect()
    assert [r["slot"] for r in slots] == list(range(1600))
    seen = Counter()
    for r in slots:
        assert r["rank"] == seen[r["no"]]
        seen[r["no"]] += 1
        n = r["slot"] + 1
        assert abs(seen[0] - n * 5 / 8) <= 8 and abs(seen[2] - n / 8) <= 8


def test_mix_against_the_schedule(documents):
    """Slot after slot in plain Python: each takes the next block of its source's words."""
    rng = random.Random(21)
    rows = [(i, prose(rng, rng.randrange(0, 90)), "en", rng.choice(["big"] * 5 + ["a", "b", None])) for i in range(150)]
    got = op3_mixing.mixed(documents(rows)).collect()
    source = {r[0]: r[3] for r in rows}
    order, sizes, block = defaultdict(list), defaultdict(int), op3_mixing.BLOCK
    for r in op3_mixing.sizes(documents(rows)).orderBy("_at").collect():
        order[r["source"]] += [r["doc_id"]] * r["size"]
        sizes[r["source"]] += r["size"]
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    aim, whole = filled(sizes), sum(sizes.values())
    ends = list(itertools.accumulate(aim[s] / whole for s in names))
    taken, first, at = Counter(), {}, Counter()
    for i in range(-(-whole // block)):
        u = i * op3_mixing.PHI % 1
        s = names[min(sum(e <= u for e in ends), len(names) - 1)]
        for w in range(at[s], min(at[s] + block, 3 * sizes[s])):
            taken[order[s][w % sizes[s]]] += 1
            first.setdefault((order[s][w % sizes[s]], w // sizes[s]), i)
        at[s] += block
    assert {r["doc_id"]: r["taken"] for r in got if r["taken"]} == dict(taken)
    slots = {(r["doc_id"], k): c["slot"] for r in got for k, c in enumerate(r["copies"])}
    assert slots == first and all(source[r["doc_id"]] == r["source"] for r in got)


def test_mixed_documents_have_the_words_taken(documents):
    rng = random.Random(4)
    rows = [(i, prose(rng, rng.randrange(1, 60)), "en", rng.choice(["big", "big", "small"])) for i in range(80)]
    # Alone in its source, so that a part of it is taken.
    rows.append((90, prose(rng, 30_000), "en", "long"))
    docs = documents(rows)
    taken = {r["doc_id"]: r["taken"] for r in op3_mixing.mixed(docs).collect()}
    found, text = Counter(), dict((r[0], r[1]) for r in rows)
    out = op3_mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    in_order = [r["doc_id"] for r in out.collect()]
    slot = {(r["doc_id"], k): c["slot"] for r in op3_mixing.mixed(docs).collect() for k, c in enumerate(r["copies"])}
    assert in_order == [i for _, i in sorted((s, i) for (i, _), s in slot.items())]
    for r in out.collect():
        found[r["doc_id"]] += len(r["text"].split())
        assert text[r["doc_id"]].startswith(r["text"].rstrip()) and r["n_chars"] == len(r["text"])
    assert {k: v for k, v in taken.items() if v} == dict(found)


# ---- near-duplicates ----


def sets(rows, k):
    out = []
    for _, text, *_ in rows:
        words = SPACED.findall(fold(text))
        out.append({tuple(words)} if 0 < len(words) < k else {tuple(words[i : i + k]) for i in range(len(words) - k + 1)})
    return out


def groups(rows, k):
    own, parent = sets(rows, k), list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(own[i] & own[j])
        if rows[i][0] is not None and rows[j][0] is not None and both and 100 * both >= 80 * len(own[i] | own[j]):
            parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return [least.get(find(i)) for i in range(len(rows))], own


def near_copies(rng, n):
    rows, i = [], 0
    while len(rows) < n:
        words = prose(rng, rng.randrange(3, 160)).split()
        for _ in range(rng.choice([1, 1, 2, 6, 20])):
            copy = list(words)
            for _ in range(rng.randrange(4)):
                copy[rng.randrange(len(copy))] = f"edit{i}"
            rows.append((i, (" " if i % 3 else "\n").join(copy).upper() if i % 5 == 0 else " ".join(copy)))
            i += 1
    return rows


def test_parities_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (0, 1, 5, 100, 1500, 9000):
        x = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        for share in (0.0, 0.05, 0.3, 1.0):
            y = np.unique(np.r_[x[: int(n * (1 - share))], rng.integers(0, 1 << 63, int(n * share)).astype(np.uint64)])
            apart = len(np.setxor1d(x, y))
            differ = int(np.bitwise_count((op6_minhash.parities(x) ^ op6_minhash.parities(y)).view(np.uint64)).sum())
            assert differ <= apart and (apart > op6_minhash.PARITIES // 32 or differ >= 0.9 * apart)


def test_mixtures_of_frequent_lines(spark, documents):
    """Documents that share most lines in other mixtures, which the pairs left over are made of, against all pairs."""
    rng = random.Random(5)
    lines = [" ".join(f"w{i}x{j}" for j in range(8)) for i in range(24)]
    rows = [(i, " ".join(rng.sample(lines, 20)) if i % 3 else " ".join(x for x in lines if rng.random() > 0.12)) for i in range(70)]
    grams = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in rows for w in [t.split()]}
    least = {i: i for i in grams}
    linked = [(a, b) for a, b in itertools.combinations(grams, 2) if 100 * len(grams[a] & grams[b]) >= 80 * len(grams[a] | grams[b])]
    for _ in rows:
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
    found = {r.doc_id: r.component_id for r in op6_minhash.near_duplicates(documents(rows), 4).collect()}
    assert linked and len(set(least.values())) > 5
    assert found == least


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(documents, k):
    rng = random.Random(k)
    rows = near_copies(rng, 250) + [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (None, "one two"), (1005, "x " * 40_000)]
    want, own = groups(rows, k)
    got = {r["doc_id"]: r for r in op6_minhash.near_duplicates(documents(rows), k).collect()}
    assert len(got) == len(rows)
    for (doc_id, *_), component, s in zip(rows, want, own, strict=True):
        r = got[doc_id]
        assert r["n_shingles"] == len(s)
        assert (r["component_id"], r["kept"]) == (component, component == doc_id)
    kept = op6_minhash.keep_one(documents(rows), k)
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == sorted(i or -1 for (i, *_), c in zip(rows, want, strict=True) if c == i or c is None)
    assert kept.columns == documents(rows).columns
    assert op6_minhash.near_duplicates(documents([]), k).count() == 0


def test_links_that_only_chain(documents):
    """Versions of one text, each 0.8 alike to the next and less to the others, and texts of common lines: no link is lost."""
    rng = random.Random(61)
    base, rows = [f"b{i}" for i in range(200)], []
    for i in range(60):
        own = list(base)
        for j in range(0, i * 3, 3):
            own[(j * 7) % 200] = f"v{j}"
        rows.append((i, " ".join(own)))
    lines = [" ".join(f"l{i}x{j}" for j in range(9)) for i in range(12)]
    rows += [(100 + i, " ".join(lines[k] for k in sorted(rng.sample(range(12), rng.randrange(6, 12))))) for i in range(120)]
    want, _ = groups(rows, 4)
    got = {r["doc_id"]: r["component_id"] for r in op6_minhash.near_duplicates(documents(rows), 4).collect()}
    assert [got[i] for i, _ in rows] == want


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    same = [(op6_minhash.superminhash(np.unique(a[:n])) == op6_minhash.superminhash(np.unique(a[n // 4 : n // 4 + n]))).mean() for n in (40, 200, 1000, 2000)]
    assert abs(np.mean(same) - 0.6) < 0.12
    whole = op6_minhash.superminhash(np.unique(a))
    assert (whole == op6_minhash.superminhash(np.unique(np.r_[a, a]))).all()


def test_components(spark):
    rng = random.Random(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7000, x) for x in range(6000, 6050)]
    parent = {}

    def find(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: find(i) for a, b in edges if a != b for i in (a, b)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- passages ----


def test_compact_windows_against_all_ranges():
    rng = np.random.default_rng(7)
    for n in (1, 5, 12, 60, 200):
        ranks = rng.integers(1, 40, n).astype(np.uint64)
        ranks[rng.random(n) < 0.03] = 0
        width = 5
        found = set(zip(*(x.tolist() for x in op7_passages.compact_windows(ranks, width)), strict=True))
        seen = set()
        for i in range(n):
            for j in range(i + width - 1, n):
                part = ranks[i : j + 1]
                if (part == 0).any():
                    continue
                inside = [w for w in found if w[0] <= i and j <= w[2] and i <= w[1] <= j]
                assert len(inside) == 1 and inside[0][1] == i + int(part.argmin())
                seen.add(inside[0])
        assert seen == found


def test_overlaps_against_all_runs():
    rng = np.random.default_rng(71)
    for n in (5, 9, 40, 150):
        width = 5
        ranks = [rng.permutation(n).astype(np.uint64) + 1 for _ in range(2)]
        cuts = rng.random(n) < 0.04
        for r in ranks:
            r[cuts] = 0
        one, two = (op7_passages.compact_windows(r, width) for r in ranks)
        wanted, before = [], None
        for s in range(n - width + 1):
            now = None if cuts[s : s + width].any() else tuple(int(s + r[s : s + width].argmin()) for r in ranks)
            if now is not None and now != before:
                wanted.append((*now, s))
            before = now
        i, j, at = op7_passages.overlaps(one, two, width)
        assert list(zip(one[1][i].tolist(), two[1][j].tolist(), at.tolist(), strict=True)) == wanted


def covered(rows):
    """(document, word) for all words of passages that an earlier document has, over all pairs."""
    own = {i: op7_passages.shingles(op7_passages.word_hashes(t), 5) for i, t in rows}
    out = set()
    for (i, _), (j, _) in itertools.combinations(sorted(rows), 2):
        for first, n, _ in op7_passages.shared_passages(own[i], own[j]):
            out |= {(j, w) for w in range(first, first + n)}
    return out


def test_passages_against_all_pairs(spark, documents):
    """Edited passages, some with a frequent line inside, some shared in part with the least document; over 1 and 16 partitions."""
    rng = random.Random(83)
    line = [f"line{i}" for i in range(12)]
    rows, i = [(0, " ".join([*(f"o{rng.getrandbits(32)}" for _ in range(40)), *line, *(f"o{rng.getrandbits(32)}" for _ in range(40))]))], 1
    for group in range(40):
        passage = [f"p{group}x{j}" for j in range(rng.randrange(52, 110))]
        if group % 2:
            passage[20:20] = line
        for _ in range(rng.choice([2, 3, 6])):
            own = list(passage)
            for _ in range(rng.choice([0, 1, 1, 2]) if len(own) > 80 else rng.choice([0, 1])):
                own[rng.randrange(len(own))] = f"edit{rng.getrandbits(32)}"
            if group % 4 == 3 and rng.random() < 0.3:
                own = own[: len(own) // 2]
            rows.append((i, " ".join([*(f"a{rng.getrandbits(32)}" for _ in range(rng.randrange(60))), *own, *(f"z{rng.getrandbits(32)}" for _ in range(rng.randrange(60)))])))
            i += 1
    for _ in range(60):
        rows.append((i, " ".join([*(f"u{rng.getrandbits(32)}" for _ in range(30)), *line, *(f"u{rng.getrandbits(32)}" for _ in range(30))])))
        i += 1
    wanted, seen = covered(rows), []
    for parts in (1, 16):
        found = op7_passages.passages(documents(rows).repartition(parts)).collect()
        seen.append(sorted(tuple(r) for r in found))
    assert seen[0] == seen[1]
    got = {(r[0], w) for r in seen[0] for w in range(r[2], r[2] + r[3])}
    print("recall", len(got) / len(wanted))
    assert got <= wanted and len(got) >= 0.98 * len(wanted)


def test_passages_after_the_rounds(documents):
    """Documents that meet by one frequent line, eight clusters each with a passage of its own around it: no round's pivot is
    of the last ones' cluster."""
    rng = random.Random(91)
    line = [f"line{i}" for i in range(49)]
    fresh = lambda n: [f"u{rng.getrandbits(48)}" for _ in range(n)]
    heads = [[f"h{c}x{j}" for j in range(12)] for c in range(8)]
    rows = [(i, " ".join([*fresh(20), *line, *fresh(20)])) for i in range(4)]
    # Every second word of a line's end differs from cluster to cluster, so that the line alone is no passage.
    own = [[*h, *(w if j % 4 or j < 24 else f"c{c}{j}" for j, w in enumerate(line))] for c, h in enumerate(heads)]
    rows += [(10 + 8 * k + c, " ".join([*fresh(9), *own[c], *fresh(9)])) for k in range(2) for c in range(8)]
    wanted = covered(rows)
    assert {d for d, _ in wanted} >= set(range(18, 26))
    for rounds in (1, 3):
        got = {(r["doc_id"], w) for r in op7_passages.passages(documents(rows), rounds).collect() for w in range(r["first_word"], r["first_word"] + r["n_words"])}
        assert got == wanted, rounds


def test_looked_up_shingles_meet_every_passage():
    """Whatever misses a passage has, one of its shingles that are looked up isn't among them."""
    rng, width = np.random.default_rng(92), op7_passages.WIDTH
    for _ in range(300):
        length = int(rng.integers(width, 260))
        late = np.arange(1000, 1000 + length, dtype=np.uint32)
        miss = np.zeros(length, bool)
        for _ in range(int(rng.integers(0, length // 9 + 2))):
            at = int(rng.integers(0, length)) if rng.random() < 0.4 else int(length / 2 + rng.integers(-5, 5))
            miss[at % length] = True
        n = rng.integers(2, 9, length)
        n[miss & (rng.random(length) < 0.5)] = 0
        places = op7_passages.looked_up(n, np.zeros(length, bool))
        assert (n[places] > 0).all()
        if op7_passages.shared_passages(late[~miss], late):
            assert (~miss[places]).any()
    # 37 hits, nine misses, 37 hits: the most misses that every window of a passage can have.
    n = np.r_[np.full(37, 2), np.full(9, 5), np.full(37, 2)]
    late = np.arange(83, dtype=np.uint32)
    assert op7_passages.shared_passages(late[n == 2], late) and (n[op7_passages.looked_up(n, np.zeros(83, bool))] == 2).any()
    assert not len(op7_passages.looked_up(n, np.ones(83, bool)))


def test_passages(documents):
    rng = random.Random(8)
    passage, other = prose(rng, 70, 5000).split(), prose(rng, 51, 5000).split()
    short = prose(rng, 30, 5000)
    rows, inside = [], set()
    for i in range(120):
        words = prose(rng, rng.randrange(60, 300), 5000).split()
        at = rng.randrange(len(words))
        if i % 4 == 0:
            own = list(passage)
            if i % 8 == 0:
                own[35] = f"edit{i}"
            words[at:at], _ = own, inside.add(i)
        elif i % 4 == 1:
            words[at:at], _ = other, inside.add(i)
        elif i % 4 == 2:
            words[at:at] = short.split()
        rows.append((i, " ".join(words)))
    rows += [(500, None), (501, ""), (None, " ".join(passage)), (502, rows[0][1])]
    inside.add(502)
    got = op7_passages.passages(documents(rows)).collect()
    assert {r["doc_id"] for r in got} | {r["other_id"] for r in got} == inside
    assert all(r["other_id"] < r["doc_id"] and r["n_words"] >= 50 and r["similarity"] >= 0.8 for r in got)
    docs = documents(rows)
    left = op7_passages.remove_repeats(docs)
    assert left.columns == docs.columns
    left = {r["doc_id"]: r for r in left.collect()}
    assert len(left) == len(rows)
    text = dict(rows)
    for i, r in left.items():
        if i not in inside or i in (0, 1):
            assert r["text"] == text[i]
    for words in (passage[:34], other):
        assert sum(" ".join(words) in (r["text"] or "") for i, r in left.items() if i is not None) == 1
    assert op7_passages.passages(documents([])).count() == 0


def test_passages_at_the_least_similarity(documents):
    rng = random.Random(82)
    rows = []
    for i in range(300):
        passage = [f"p{i}x{j}" for j in range(50)]
        edited = list(passage)
        edited[25] = f"edit{i}"
        for k, own in enumerate((passage, edited)):
            rows.append((2 * i + k, " ".join([*(f"a{rng.getrandbits(32)}" for _ in range(40)), *own, *(f"z{rng.getrandbits(32)}" for _ in range(40))])))
    got = {(r["a"], r["b"]) for r in op7_passages.candidates(documents(rows)).collect()}
    # All bands miss a run at the least similarity with probability 0.017.
    assert len({(2 * i, 2 * i + 1) for i in range(300)} - got) <= 12


def test_batches_of_written_tables_are_bounded(spark):
    """Rows of 100 kB come to Python in batches of a few MB, and the session's own settings are as before."""
    from pyspark.sql import functions as F

    from strandlake.llm.common import BATCH_BYTES, cut

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    large = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = cut(large.mapInArrow(sizes, "n long, size long")).collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) <= BATCH_BYTES + 200_000
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before


def test_passages_in_a_looser_stretch():
    rng = random.Random(81)
    early = [f"v{i}" for i in range(400)]
    late = list(early)
    for i in [*range(0, 155, 8), *range(245, 400, 8)]:
        late[i] = f"edit{i}"
    late[200] = "edit"
    hashed = [op7_passages.shingles(op7_passages.word_hashes(" ".join(x)), 5) for x in (early, late)]
    found = op7_passages.shared_passages(*hashed)
    assert set(range(153, 245)) <= {i for first, n, _ in found for i in range(first, first + n)}
    assert all(n >= 50 and similar >= 0.8 for _, n, similar in found)
    # What is covered is what any span of 46 or more shingles that is alike enough covers, by brute force.
    for _ in range(60):
        hits = [rng.random() < rng.choice((0.8, 0.9, 0.97)) for _ in range(150)]
        at = [i for i, h in enumerate(hits) if h]
        wanted = set()
        for i, a in enumerate(at):
            for j in range(i, len(at)):
                span, k = at[j] - a + 1, j - i + 1
                if span >= 46 and k / (2 * span - k) >= 0.8 - 1e-12:
                    wanted |= set(range(a, at[j] + 1))
        spans = op7_passages.alike_spans(np.array(at))
        assert {x for a, b, _ in spans for x in range(a, b + 1)} == wanted
        assert all(k == sum(hits[a : b + 1]) and k / (2 * (b - a + 1) - k) >= 0.8 for a, b, k in spans)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in itertools.pairwise(spans))


def test_cutting_words_out():
    assert op7_passages.without(" a b  c\nd é f", [(1, 2), (4, 1)]) == " a d f"
    assert op7_passages.without("a b", [(0, 2)]) == ""


# ---- language-model scoring ----


def ppm(train, text):
    order, mark = op8_ppm.ORDER, bytes([op8_ppm.MARK])
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in train:
        s = mark * order + (t or "").encode() + mark
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][s[i - k : i]][s[i]] += 1
    s, total = mark * order + (text or "").encode() + mark, 0.0
    for i in range(order, len(s)):
        out, p = set(), 1.0
        for k in range(order, -1, -1):
            own = {b: n for b, n in counts[k].get(s[i - k : i], {}).items() if b not in out}
            if not own:
                continue
            whole = sum(own.values()) + len(own)
            if s[i] in own:
                p *= own[s[i]] / whole
                break
            p *= len(own) / whole
            out |= set(own)
        else:
            p /= 256 - len(out)
        total += math.log10(p)
    return total


def test_scoring(documents):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choices(["the", "Cat", "sät", "on\n", "a", "mat", f"x{i}"], k=rng.randrange(1, 12)))) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "\x00zz é 𝄞"), (None, "the cat"), (5, rows[5][1])]
    held = [zlib.crc32(str("" if i is None else i).encode()) % 5 == 1 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    tokens = lambda t: [*SPACED.findall(fold(t)), "\n"]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    got = sorted(op8_ppm.scored(documents(rows)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert len(got) == len(rows)
    for ((i, t), h), r in zip(sorted(zip(rows, held, strict=True), key=lambda x: (x[0][0] is None, x[0][0] or 0)), got, strict=True):
        assert (r["doc_id"], r["held_out"], r["train_tokens"], r["n_tokens"]) == (i, h, n, len(tokens(t)))
        assert r["n_known"] == sum(x in c for x in tokens(t))
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in tokens(t)))
        assert r["score"] == pytest.approx(ppm(train, t))
    assert op8_ppm.scored(documents([])).count() == 0


def test_scoring_in_pieces_and_split_contexts(documents, monkeypatch):
    """Long texts in pieces, many parts, and hot contexts in shares: the same scores."""
    rng = random.Random(19)
    rows = [(i, " ".join(rng.choices(["the", "then", "bathe", "Cat", "sät", "on\n", "a", f"x{i % 7}"], k=rng.randrange(1, 60)))) for i in range(60)]
    rows += [(100, " ".join(rng.choices(["ab", "abc", "é" * 50], k=4000))), (101, "x" * 9000), (102, None)]
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    key = lambda r: r["doc_id"]
    whole = sorted(op8_ppm.scored(documents(rows)).collect(), key=key)
    for name, value in (("AT_ONCE", 256), ("PART_BYTES", 2000), ("BUCKET", 20)):
        monkeypatch.setattr(op8_ppm, name, value)
    units = [u for us in op8_ppm._units(pa.array([t for _, t in rows])) for u in us]
    assert len(units) > len(rows) and b"".join(u[2] for u in units if u[0] == 60) == rows[60][1].encode()
    split = sorted(op8_ppm.scored(documents(rows)).collect(), key=key)
    for a, b in zip(whole, split, strict=True):
        assert (a["doc_id"], a["n_tokens"], a["n_known"], a["train_tokens"]) == (b["doc_id"], b["n_tokens"], b["n_known"], b["train_tokens"])
        assert a["score"] == pytest.approx(b["score"]) and a["base_score"] == pytest.approx(b["base_score"])
    for i in (0, 7, 60, 62):
        assert split[i]["score"] == pytest.approx(ppm(train, rows[i][1]))


def test_symbols_of_a_context_share_one(documents):
    train = ["abracadabra", "abc abd", "b"]
    keys = sorted({k for t in train for k in op8_ppm.gram_codes([t])[0].tolist()})
    prefix = keys[3] >> 8 << 8
    wanted = np.array(sorted({*keys, *range(prefix, prefix + 256)}), np.uint64)
    all_codes = Counter(k for t in train for k in op8_ppm.gram_codes([t])[0].tolist())
    counts = np.array([all_codes[int(k)] for k in wanted])

    def level(bits):
        c = Counter()
        for k, n in zip(wanted.tolist(), counts.tolist(), strict=True):
            c[k & bits] += n
        return np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)])

    logs = op8_ppm.log_probabilities(wanted, counts, level(0xFFFF), level(0xFF))
    here = (wanted >> np.uint64(8)) == prefix >> 8
    assert (10 ** logs[here]).sum() == pytest.approx(1)


# ---- packing ----


def test_packing(documents):
    from tokenizers import Tokenizer

    rng = random.Random(10)
    pieces = ["the", "  two", "\n\n x", "<|endoftext|>", "é𝄞", "it's", "\t \t", "123", "..!"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randrange(40)))) for i in range(200)]
    rows += [(300, None), (301, ""), (302, prose(rng, 5000)), (302, prose(rng, 50)), (None, "x")]
    whole = Tokenizer.from_file(op9_packing.tokenizer_path())
    got = op9_packing.packed(documents(rows)).collect()
    of = defaultdict(list)
    for i, t in rows:
        of[i].append([*whole.encode(t or "", add_special_tokens=False).ids, 0])
    pieces_of = Counter()
    for r in got:
        # Rows of one id are told apart by their length.
        ids = next(x for x in of[r["doc_id"]] if len(x) == r["doc_tokens"])
        part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        pieces_of.update((r["doc_id"], len(ids), k) for k in range(r["start"], r["start"] + r["length"]))
    assert pieces_of == Counter((i, len(x), k) for i, own in of.items() for x in own for k in range(len(x)))
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    padding, lengths = 0, Counter()
    for own in by.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 1024
        lengths[at] += 1
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert padding < 1024
    # Shorter tiers have windows of their own.
    assert lengths[64] > 5 and lengths[1024]
    assert op9_packing.packed(documents([])).count() == 0


def test_tiers_pack_and_fill():
    rng = np.random.default_rng(22)
    for lengths in (rng.integers(1, 1025, 700), rng.integers(300, 500, 700), rng.integers(1, 40, 700), np.full(90, 1024), np.array([1])):
        lengths = np.sort(lengths)[::-1]
        for tiers in (op9_packing.TIERS, (1024,)):
            parts = op9_packing.pack(lengths, tiers)
            held, ends = defaultdict(list), Counter()
            for i, start, n, k, offset in parts:
                assert n > 0
                held[i].append((start, n))
                ends[k] += n
            for i, n in enumerate(lengths):
                at = 0
                for start, k in sorted(held[i]):
                    assert start == at
                    at += k
                assert at == n
            for k in ends:
                at = 0
                for offset, n in sorted((o, n) for _, _, n, s, o in parts if s == k):
                    assert offset == at
                    at += n
            assert sum(1024 - n for n in ends.values() if n & (n - 1)) < 2 * 1024
            short = [n for n in ends.values() if n < 1024]
            if len(tiers) == 1:
                assert len(short) <= 1
            elif 300 <= lengths.min() < 512:
                assert len(short) > 100 and ends.most_common()[0][1] <= 1024


def test_step_groups_are_even():
    rng = np.random.default_rng(23)
    fill = rng.choice([64, 128, 256, 512, 1024], 3000)
    of = op9_packing.steps(np.arange(3000), fill)
    loads = np.bincount(of, fill)
    assert loads.max() - loads.min() <= 64 and loads.max() <= op9_packing.STEP


def test_encoder_agrees_on_white_space():
    from tokenizers import Tokenizer

    rng, path = random.Random(11), op9_packing.tokenizer_path()
    own, whole = op9_packing.encoder(path), Tokenizer.from_file(path)
    assert own.in_words
    for _ in range(1500):
        text = "".join(rng.choices([" ", "  ", "\n", "\t", "a", "B1", "'s", "é", ".", " ", "　", " the"], k=rng.randrange(14)))
        assert np.frombuffer(own.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def test_encoder_agrees_on_batches(monkeypatch):
    """Words that are encoded together have the ids that they have in their texts."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(op9_packing.Encoder, "AT_ONCE", 3)
    monkeypatch.setattr(op9_packing.Encoder, "TEXTS", 4)
    rng, path = random.Random(24), op9_packing.tokenizer_path()
    own, whole = op9_packing.Encoder(path), Tokenizer.from_file(path)
    words = ["", "\n", "it's", "'s", "a\nb", "a\n", "\ta", "é𝄞", "\u3000x", "x\u3000", "\xa0", "\x1c", "\x85a", "<|endoftext|>", "\u0120", "12", "...", "!\n\n?", "日本語"]
    for _ in range(150):
        few = [*rng.choices(words, k=3), *("".join(rng.choices("abcdé,-1", k=rng.randrange(1, 7))) for _ in range(12))]
        texts = [None, "", *(" ".join(rng.choices(few, k=rng.randrange(1, 30))) for _ in range(8))]
        for text, got in zip(texts, own.batch(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == whole.encode(text or "", add_special_tokens=False).ids, repr(text)


# ---- search ----


def test_search_is_exact(documents):
    rng = random.Random(12)
    rows = [(i, prose(rng, rng.randrange(0, 60), 80)) for i in range(300)] + [(400, None), (401, ""), (None, "w1 w2"), (500, "w1 w1 W1 w2"), (600, "unseen")]
    docs = documents(rows)
    known = [(i, SPACED.findall(fold(t))) for i, t in rows if i is not None]
    n, mean = len(known), sum(len(w) for _, w in known) / len(known)
    df = Counter(x for _, w in known for x in set(w))
    got = defaultdict(list)
    for r in op5_topk.search(docs, docs.filter("doc_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["doc_id"], r["score"]))
    for q, words in known:
        if q % 100:
            continue
        scores = []
        for i, w in known:
            c = Counter(w)
            s = sum(m * math.log(1 + (n - df[x] + 0.5) / (df[x] + 0.5)) * c[x] * 2.2 / (c[x] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for x, m in Counter(words).items() if x in c)
            if s > 0:
                scores.append((i, s))
        best = sorted(scores, key=lambda x: (-x[1], x[0]))[:10]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in best])
        assert {i for i, s in got[q] if s > best[-1][1] * (1 + 1e-9)} == {i for i, s in best if s > best[-1][1] * (1 + 1e-9)}
    assert op5_topk.search(documents([]), documents([])).count() == 0
    # Each row of a repeated id is a query; rows of one id are each an answer; a long text is a query and an answer.
    two = documents([(100, "w1 w2 w3"), (100, "w50 w51"), (100, "w1 w2 w3"), (200, "w9 " * 40_000)])
    alone = {t: [(r["doc_id"], r["rank"], r["score"]) for r in op5_topk.search(docs, documents([(100, t)])).orderBy("rank").collect()] for t in ("w1 w2 w3", "w50 w51")}
    found = Counter((r["doc_id"], r["rank"], r["score"]) for r in op5_topk.search(docs, two).filter("query_id = 100").collect())
    assert found == Counter([*alone["w1 w2 w3"], *alone["w50 w51"], *alone["w1 w2 w3"]])
    assert Counter(r["query_id"] for r in op5_topk.search(two, two).collect()) == {100: 5, 200: 1}


def test_shards_agree_with_one_index(documents, monkeypatch):
    rng = random.Random(13)
    lengths, owner, terms = [], [], []
    for i in range(500):
        own = [rng.randrange(50) for _ in range(rng.randrange(1, 40))]
        lengths.append(len(own))
        owner += [i] * len(own)
        terms += own
    weights = np.linspace(0.1, 3, 50)
    index = op5_topk.Shard(np.arange(500), np.array(lengths), np.array(owner), np.array(terms), weights, 20.0)
    query, times = np.arange(0, 50, 3), np.ones(17)
    doc, score = index.search(query, times, 500, 0.0)
    top, best = index.search(query, times, 7, 0.0)
    order = np.lexsort((doc, -score))[:7]
    assert set(top) == set(doc[order]) and sorted(best) == pytest.approx(sorted(score[order]))
    assert len(index.search(query, times, 7, float(score.max()) + 1)[0]) == 0
    # The pivot leaves out terms, never an answer: from each floor on, all that reach it.
    for floor in np.quantile(score, [0.2, 0.6, 0.9, 0.99]):
        many, found = index.search(query, times, 500, float(floor))
        assert set(many) == set(doc[score >= floor])
        assert dict(zip(many.tolist(), found.tolist(), strict=True)) == {d: s for d, s in zip(doc.tolist(), score.tolist(), strict=True) if s >= floor}


def test_common_terms_bound_every_score():
    """The matrix of common terms changes no answer, and hardly a document more than the answers is scored whole."""
    rng = np.random.default_rng(31)
    owner = np.repeat(np.arange(900), rng.integers(1, 60, 900))
    terms = np.minimum(rng.geometric(0.04, len(owner)) - 1, 199)
    lengths, weights, row = np.bincount(owner, minlength=900), np.linspace(0.2, 5, 200), np.full(200, -1, np.int32)
    row[:40] = rng.permutation(40)
    plain, index = (op5_topk.Shard(np.arange(900), lengths, owner, terms, weights, 30.0, r) for r in (None, row))
    scored, whole = [], index.scores
    index.scores = lambda docs, *rest: scored.append(len(docs)) or whole(docs, *rest)
    for _ in range(40):
        query, times = np.unique(np.minimum(rng.geometric(0.04, 30) - 1, 199), return_counts=True)
        common = np.zeros((1, 40), np.float32)
        common[0, row[query[query < 40]]] = times[query < 40]
        bounds, greatest = index.products(common)
        every = plain.search(query, times.astype(float), 900, 0.0)
        for floor in (0.0, *np.quantile(every[1], [0.3, 0.9, 0.995])):
            want = sorted((-s, d) for d, s in zip(*(x.tolist() for x in every), strict=True) if s >= floor)[:10]
            got = index.search(query, times.astype(float), 10, float(floor), (bounds[0], greatest[0]))
            assert sorted((-s, d) for d, s in zip(*(x.tolist() for x in got), strict=True)) == want
    assert sum(scored) < 40 * 4 * 60


def test_documents_are_scored_once():
    rng = np.random.default_rng(32)
    owner = np.repeat(np.arange(900), rng.integers(1, 60, 900))
    terms = np.minimum(rng.geometric(0.04, len(owner)) - 1, 199)
    index = op5_topk.Shard(np.arange(900), np.bincount(owner, minlength=900), owner, terms, np.linspace(0.2, 5, 200), 30.0)
    scored, whole = [], index.scores
    index.scores = lambda docs, *rest: scored.extend(docs.tolist()) or whole(docs, *rest)
    for _ in range(20):
        query, times = np.unique(np.minimum(rng.geometric(0.04, 30) - 1, 199), return_counts=True)
        scored.clear()
        assert len(index.search(query, times.astype(float), 10, 0.0)[0]) == 10
        assert len(scored) == len(set(scored)) > 0


# ---- archives ----


def test_archives(spark):
    rng = random.Random(14)
    body = "<p>" + "x" * 120
    rows = [(i, rng.choice(["http://www.B.org/a?z=1&a=2", "https://a.com/é", None, "bad url \n x"]), rng.choice([body, f"<b>{i}</b>", "short", None, "é" * 90, f"{i}" * 60])) for i in range(300)]
    rows += [(None, "http://a.com", body), (7, rows[7][1], rows[7][2])]
    history, records = archived(spark.createDataFrame(rows, "page_id long, url string, html string"))
    least = {}
    for i, _, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100 and i is not None:
            least[raw] = min(i, least.get(raw, i))
    want = Counter()
    for i, _, html in rows:
        raw = (html or "").encode()
        first = least.get(raw, i)
        want[i, len(raw), hashlib.sha256(raw).hexdigest(), "response" if first == i else "revisit", None if first == i else first] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in records.collect()) == want
    keys = [(r["urlkey"], r["ts"]) for r in history.collect()]
    assert keys == sorted(keys) and len(keys) == len(rows)
    assert archived(spark.createDataFrame([], "page_id long, url string, html string"))[1].count() == 0


def test_loser_tree():
    rng = random.Random(15)
    for k in (0, 1, 2, 3, 5, 8, 13):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert [x for _, x in LoserTree(runs)] == sorted(x for r in runs for x in r)
    assert url_key("HTTP://user@www.B.org:80/a?z=1&a=2#f") == "org,b)/a?a=2&z=1"


# ---- language identification ----


def test_language_identification(documents):
    rng = random.Random(16)
    words = {"en": ["the", "thing", "with", "house"], "de": ["der", "schön", "über", "haus"], "fr": ["été", "que", "eau", "maison"]}
    rows = []
    for i in range(300):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choices(words[lang], k=rng.randrange(3, 30))), lang if i % 10 else None))
    rows += [(400, None, "en"), (401, "", "en"), (402, "123 !?", "en"), (None, "der haus", "de"), (403, "the " * 30_000, "en")]
    docs = documents(rows)
    model = op10_langid.language_model(docs)
    got = {r["doc_id"]: r for r in op10_langid.identify(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text, lang in rows:
        r = got[i]
        assert r["held_out"] == (zlib.crc32(str("" if i is None else i).encode()) % 4 == 2) and 0 <= r["score"] <= 1
        assert (r["lang_pred"] == "und") == (i in (400, 401, 402))
    right = [got[i]["lang_pred"] == lang for i, _, lang in rows if i is not None and i < 400 and lang and got[i]["held_out"]]
    assert np.mean(right) > 0.97
    # Repeated rows, and more languages than any list of them: all are learned.
    many = documents([(j, f"{chr(0x100 + j % 70) * 3} {chr(0x100 + j % 70) * 2} {j % 7}", f"l{j % 70}") for j in range(1400)] + [(3, rows[3][1], "en")] * 3)
    wide = op10_langid.language_model(many)
    assert len(wide.langs) >= 70
    assert op10_langid.identify(many, wide).count() == 1403
    kept = op10_langid.keep_known(docs, model)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    assert {r["lang_pred"] for r in op10_langid.identify(documents([(1, "abc", None)]), None).collect()} == {"und"}
    assert op10_langid.identify(documents([]), op10_langid.language_model(documents([]))).count() == 0


def test_topk_reads_texts_once_for_all_blocks_of_queries(documents, monkeypatch):
    """each block of queries read and split all texts twice. A part that goes first changes no row."""
    rng = random.Random(4)
    docs = documents([(i, " ".join(f"w{min(rng.randrange(60), rng.randrange(60))}" for _ in range(rng.randrange(40)))) for i in range(240)] + [(240, None), (None, "w1 w2")])
    queries = docs.filter("doc_id % 20 = 0")
    plain = sorted(map(tuple, op5_topk.search(docs, queries).collect()))
    made, read = [], op5_topk._postings
    monkeypatch.setattr(op5_topk, "_postings", lambda *a: made.append(1) or read(*a))
    monkeypatch.setattr(op5_topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(op5_topk, "SHARD", 16)
    monkeypatch.setattr(op5_topk, "LEAD", 3)
    parts = sorted(map(tuple, op5_topk.search(docs, queries).collect()))
    assert [r[:3] for r in parts] == [r[:3] for r in plain] and np.allclose([r[3] for r in parts], [r[3] for r in plain])
    assert len(made) == 1 and len(plain) >= 100
