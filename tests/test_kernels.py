"""Alignment kernels, intervals and streams against plain Python."""

from __future__ import annotations

import itertools
import random
from functools import lru_cache

import numpy as np
from pyspark.sql import functions as F

from strandlake.functions import seq
from strandlake.operators.align import Scores, best_chain, dixon, fit_frechet, global_path, global_score, rescore
from strandlake.operators.intervals import as_of, loci, overlaps
from strandlake.operators.ranks import numbered
from strandlake.streaming.windows import deduplicated, events_stream, sessions, top_values, tumbling

S = Scores()


def plain(a, b, s=S, local=False):
    @lru_cache(None)
    def h(i, j, state):
        if i == j == 0:
            return 0 if state == "h" else -(10**9)
        options = [0] if local and state == "h" else []
        if state == "h":
            if i and j:
                options.append(h(i - 1, j - 1, "h") + (s.match if a[i - 1] == b[j - 1] else s.mismatch))
            options += [h(i, j, "e"), h(i, j, "f")]
        if state == "e":
            options = [max(h(i, j - 1, "h") - s.gap_open, h(i, j - 1, "e")) - s.gap_extend] if j else [-(10**9)]
        if state == "f":
            options = [max(h(i - 1, j, "h") - s.gap_open, h(i - 1, j, "f")) - s.gap_extend] if i else [-(10**9)]
        return max(options)

    if local:
        return max(h(i, j, "h") for i in range(len(a) + 1) for j in range(len(b) + 1))
    return h(len(a), len(b), "h")


def words(seed, n):
    rng = random.Random(seed)
    for _ in range(n):
        yield "".join(rng.choices("acgt", k=rng.randrange(12))), "".join(rng.choices("acgt", k=rng.randrange(12)))


def test_scores_and_paths_against_the_recurrence():
    for a, b in words(1, 120):
        assert global_score(a, b) == plain(a, b)
        assert global_score(a, b, local=True) == plain(a, b, local=True)
        score, cigar = global_path(a, b)
        assert score == plain(a, b) == rescore(cigar)[0]


def test_golden_alignments():
    assert global_path("acgtacgt", "acgacgt") == (7 * 2 - 8 - 3, global_path("acgtacgt", "acgacgt")[1])
    assert global_path("acgtacgt", "acgacgt")[1].count("I") == 1
    assert global_score("ttttACGTACGTtttt", "ggACGTACGTgg", local=True) == 16
    left, right = "acgacgacgacgacg", "cttcttcttcttctt"
    assert global_path(left + right, left + "gt" + "a" * 36 + "ag" + right, Scores(), spliced=True) == (60 - 20, "15=40N15=")
    assert global_path(left + right, left + "gc" + "a" * 36 + "ag" + right, Scores(), spliced=True)[0] == 60 - 25
    assert global_score("acgt" * 9, "acgt" * 9) == 72


def test_chains_against_all_subsets():
    rng = random.Random(2)
    for _ in range(60):
        hits = [(rng.randrange(40), rng.randrange(40), rng.randrange(2, 9)) for _ in range(rng.randrange(7))]
        best = 0
        for n in range(1, len(hits) + 1):
            for own in itertools.permutations(hits, n):
                ok = all(u < x and v < y and 2 * (u + w - x) <= min(k, w) and 2 * (v + w - y) <= min(k, w) for (u, v, w), (x, y, k) in itertools.pairwise(own))
                if ok:
                    best = max(best, sum(2 * k for _, _, k in own) - sum(3 + abs((x - y) - (u - v)) for (u, v, _), (x, y, _) in itertools.pairwise(own)))
        assert best_chain(hits)[0] == best


def test_outliers_and_fit():
    assert dixon([1, 2, 3, 100]) == [100] and dixon([1, 1, 1]) == [] and dixon([1, 2, 3, 4]) == []
    rng = np.random.default_rng(3)
    x = np.round(15 + 60 / (-np.log(rng.random(4000))) ** (1 / 2.5)).astype(int)
    lengths, counts = np.unique(x, return_counts=True)
    mu, th, k, _ = fit_frechet(lengths, counts)
    assert abs(mu + th - 75) < 8 and 1.5 < k < 4


def test_loci(spark):
    rows = [("+", 1, 5), ("+", 5, 9), ("+", 10, 12), ("+", 11, 30), ("+", 31, 31), ("-", 1, 5)]
    df = spark.createDataFrame(rows, "strand string, s long, e long")
    for width in (3, 7, 1000):
        got = {(r["strand"], r["s"]): r["locus"] for r in loci(df, ["strand"], "s", "e", [], width=width).collect()}
        assert got == {("+", 1): 1, ("+", 5): 1, ("+", 10): 2, ("+", 11): 2, ("+", 31): 3, ("-", 1): 1}


def test_joins_of_intervals(spark):
    rng = random.Random(4)
    ranges = lambda n: [(i, k := rng.randrange(300), k + rng.randrange(60)) for i in range(n)]
    a, b = ranges(60), ranges(60)
    x, y = spark.createDataFrame([(1, *r) for r in a], "k int, i long, s long, e long"), spark.createDataFrame([(1, *r) for r in b], "k int, j long, t long, u long")
    want = {(i, j) for (i, s, e), (j, t, u) in itertools.product(a, b) if s <= u and t <= e}
    for width in (16, 4096):
        got = [(r["i"], r["j"]) for r in overlaps(x, y, ["k"], ("s", "e"), ("t", "u"), width).collect()]
        assert len(got) == len(want) and set(got) == want
        last = {r["i"]: r["t"] for r in as_of(x, y, ["k"], "s", "t", ["j"], width).join(y.select("j", "t"), "j", "left").collect()}
        assert last == {i: max((t for _, t, _ in b if t <= s), default=None) for i, s, _ in a}


def test_sequence_properties(spark):
    df = spark.createDataFrame([("acgtnryacg",), ("",), ("aaa",)], "s string")
    r = df.select("s", seq.revcomp(seq.revcomp(F.col("s"))).alias("twice"), F.length(seq.complement(F.col("s"))).alias("n"), seq.translate(F.lit("atggcctaa")).alias("p"), seq.translate(F.lit("tga"), code=2).alias("w"), F.size(seq.kmers(F.col("s"), 3)).alias("k")).collect()
    assert all(x["s"] == x["twice"] and x["n"] == len(x["s"]) and x["p"] == "MA*" and x["w"] == "W" for x in r)
    assert [x["k"] for x in r] == [4, 0, 1] or r[0]["k"] == 3
    assert seq.prosite("N-{P}-[ST]-x(2)") == "N[^P][ST].{2}" and seq.motif("tnr") == "t[acgt][ag]"


def test_streams_agree_with_batches(spark, tmp_path):
    rng = random.Random(5)
    base = 1_700_000_000
    rows = [(i, base + rng.randrange(40_000), rng.randrange(5), rng.choice("ab"), float(i % 17)) for i in range(400)]
    df = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double").select("event_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"), "user_id", "event_type", "value", F.lit("{}").alias("props"))
    df.repartition(4).write.parquet(str(tmp_path / "in"))

    def run(f, mode, name):
        events = events_stream(spark, str(tmp_path / "in"), files_each=100)
        q = f(events).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    got = {(r["start"].timestamp() // 1, r["event_type"]): r["n"] for r in run(tumbling, "complete", "s1")}
    want = {}
    for _, s, _, t, _ in rows:
        want[s // 3600 * 3600, t] = want.get((s // 3600 * 3600, t), 0) + 1
    assert got == want
    assert sum(r["n"] for r in run(sessions, "complete", "s2")) == 400
    assert len(run(deduplicated, "append", "s3")) == 400
    top = {}
    for r in run(top_values, "update", "s4"):
        top.setdefault(r["user_id"], []).append(r["value"])
    for user, best in top.items():
        assert sorted(best, reverse=True)[:3] == sorted((v for _, _, u, _, v in rows if u == user), reverse=True)[:3]


def test_numbers_of_rows(spark):
    df = spark.range(0, 3000, 3).withColumn("x", (F.col("id") * 7919) % 3001)
    want = {x: i for i, x in enumerate(sorted((i * 7919) % 3001 for i in range(0, 3000, 3)), 1)}
    for each in (64, 5000):
        assert {r["x"]: r["n"] for r in numbered(df, "x", "n", each).collect()} == want
