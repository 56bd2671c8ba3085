"""Queries over scoring models, length distributions and intron sets."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq
from ..sources.views import DNA_SQL, INTRON_SQL, dna, intron, table
from .registry import query

_MARKOV = f"""{DNA_SQL}, w AS (SELECT quality, substr(dna, p, 4) AS word FROM (SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, dna, unnest(range(1, length(dna) - 2)) AS p FROM dna d JOIN labels l ON d.doc_id = l.doc_id WHERE length(dna) >= 4)),
c AS (SELECT word, count(*) FILTER (WHERE quality = 1) AS fg, count(*) FILTER (WHERE quality = 0) AS bg FROM w GROUP BY word),
m AS (SELECT word, log10(((fg + 1) / (sum(fg) OVER v + 4)) / ((bg + 1) / (sum(bg) OVER v + 4))) AS score FROM c WINDOW v AS (PARTITION BY substr(word, 1, 3)))"""


def markov(spark, sf):
    """word, score: log odds of the fourth base after three, in good texts over others. 256 rows at most."""
    w = dna(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id").select("quality", F.explode(seq.kmers(F.col("dna"), 4)).alias("word"))
    c = w.groupBy("word").agg(F.count(F.when(F.col("quality") == 1, 1)).alias("fg"), F.count(F.when(F.col("quality") == 0, 1)).alias("bg"))
    v = Window.partitionBy(F.substring("word", 1, 3))
    return c.select("word", F.log10(((F.col("fg") + 1) / (F.sum("fg").over(v) + 4)) / ((F.col("bg") + 1) / (F.sum("bg").over(v) + 4))).alias("score"))


@query("STA10", f"WITH {_MARKOV} SELECT word, round(score, 6) AS score FROM m")
def markov_logodds(spark, sf):
    return markov(spark, sf).select("word", F.round("score", 6).alias("score"))


@query("STA11 WIN05", f"""
WITH {_MARKOV}, x AS (SELECT doc_id, substr(dna, p, 4) AS word FROM (SELECT doc_id, dna, unnest(range(1, length(dna) - 2)) AS p FROM dna WHERE length(dna) >= 4)) SELECT doc_id, round(sum(score), 5) AS potential, round(1000 * avg(score), 5) AS per_kb FROM x JOIN m USING (word) GROUP BY doc_id""")
def markov_potential(spark, sf):
    x = dna(spark, sf).select("doc_id", F.explode(seq.kmers(F.col("dna"), 4)).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    j = x.join(F.broadcast(markov(spark, sf)), "word")
    return j.groupBy("doc_id").agg(F.round(F.sum(F.col("n") * F.col("score")), 5).alias("potential"), F.round(1000 * F.sum(F.col("n") * F.col("score")) / F.sum("n"), 5).alias("per_kb"))


@query("WIN09", f"""
WITH {_MARKOV}, x AS (SELECT doc_id, p, score FROM (SELECT doc_id, p, substr(dna, p, 4) AS word FROM (SELECT doc_id, dna, unnest(range(1, length(dna) - 2)) AS p FROM dna WHERE length(dna) >= 4)) JOIN m USING (word)),
s AS (SELECT doc_id, p % 3 AS phase, sum(score) AS s FROM x GROUP BY 1, 2) SELECT doc_id, phase, round(s, 5) AS potential FROM s""")
def markov_phase_potential(spark, sf):
    x = dna(spark, sf).select("doc_id", F.posexplode(seq.kmers(F.col("dna"), 4)).alias("i", "word")).groupBy("doc_id", ((F.col("i") + 1) % 3).cast("long").alias("phase"), "word").agg(F.count("*").alias("n"))
    return x.join(F.broadcast(markov(spark, sf)), "word").groupBy("doc_id", "phase").agg(F.round(F.sum(F.col("n") * F.col("score")), 5).alias("potential"))


# A donor profile, log10 odds by column.
DONOR = ({"a": -0.3, "c": -0.5, "g": 0.5, "t": -0.4}, {"a": -1.0, "c": -1.2, "g": -1.1, "t": 0.58}, {"a": 0.35, "c": -1.0, "g": 0.2, "t": -0.9}, {"a": 0.45, "c": -0.6, "g": -0.5, "t": -0.4}, {"a": -0.6, "c": -0.7, "g": 0.5, "t": -0.5})


@query("WIN08 STA26", f"""
WITH {DNA_SQL}, m(col, b, score) AS (VALUES {", ".join(f"({i}, '{b}', CAST({s} AS DOUBLE))" for i, c in enumerate(DONOR) for b, s in c.items())}),
w AS (SELECT substr(dna, p, 5) AS word, doc_id, p FROM (SELECT doc_id, dna, unnest(range(1, length(dna) - 3)) AS p FROM dna WHERE length(dna) >= 5)), k AS (SELECT DISTINCT word FROM w),
s AS (SELECT word, round(sum(score), 6) AS score FROM (SELECT word, unnest(range(0, 5)) AS col FROM k) x JOIN m ON m.col = x.col AND m.b = substr(word, CAST(x.col + 1 AS BIGINT), 1) GROUP BY word)
SELECT doc_id, max(score) AS best, min_by(p, (-score, p)) AS best_at, count(*) FILTER (WHERE score >= 1) AS good FROM w JOIN s USING (word) GROUP BY doc_id""")
def pssm_scan(spark, sf):
    maps = [F.create_map(*[F.lit(x) for kv in c.items() for x in kv]) for c in DONOR]
    score = F.round(sum((F.element_at(m, F.substring("word", i, 1)) for i, m in enumerate(maps, 1)), F.lit(0.0)), 6)
    w = dna(spark, sf).select("doc_id", F.posexplode(seq.kmers(F.col("dna"), 5)).alias("i", "word")).select("doc_id", (F.col("i") + 1).cast("long").alias("p"), score.alias("score"))
    t = w.groupBy("doc_id").agg(F.min(F.struct((-F.col("score")).alias("m"), "p")).alias("t"), F.count(F.when(F.col("score") >= 1, 1)).alias("good"))
    return t.select("doc_id", (-F.col("t.m")).alias("best"), F.col("t.p").alias("best_at"), "good")


_HIST = INTRON_SQL + ", h AS (SELECT cid, ilen AS len, count(*) AS frq FROM intron GROUP BY cid, ilen)"


def hist(spark, sf):
    return intron(spark, sf).groupBy("cid", F.col("ilen").alias("len")).agg(F.count("*").alias("frq"))


@query("AGG18 FLT17", f"WITH {_HIST} SELECT * FROM h WHERE frq >= 2 AND len BETWEEN 20 AND 110")
def hist_ild(spark, sf):
    return hist(spark, sf).filter("frq >= 2 and len between 20 and 110")


@query("AGG22", f"""
WITH {_HIST} SELECT cid, CAST(sum(frq) AS BIGINT) AS n, round(sum(frq * len) / sum(frq), 6) AS mean, round(sum(frq * len * len) / sum(frq) - pow(sum(frq * len) / sum(frq), 2), 5) AS variance, round(exp(sum(frq * ln(len)) / sum(frq)), 6) AS geomean FROM h GROUP BY cid""")
def hist_moments(spark, sf):
    n, x = F.sum("frq"), F.sum(F.col("frq") * F.col("len"))
    return hist(spark, sf).groupBy("cid").agg(n.alias("n"), F.round(x / n, 6).alias("mean"), F.round(F.sum(F.col("frq") * F.col("len") * F.col("len")) / n - F.pow(x / n, F.lit(2)), 5).alias("variance"), F.round(F.exp(F.sum(F.col("frq") * F.log("len")) / n), 6).alias("geomean"))


@query("AGG22 AGG23", f"""
WITH {_HIST}, c AS (SELECT *, sum(frq) OVER (PARTITION BY cid ORDER BY len) AS cum, sum(frq) OVER (PARTITION BY cid) AS n FROM h), q AS (SELECT unnest([0.1, 0.25, 0.5, 0.75, 0.9]) AS q)
SELECT cid, CAST(q AS DOUBLE) AS q, round(min(len - (cum - q * n) / frq), 6) AS value FROM c, q WHERE cum >= q * n GROUP BY cid, q""")
def hist_quantiles(spark, sf):
    """Quantiles that fall inside a class are interpolated."""
    w = Window.partitionBy("cid")
    c = hist(spark, sf).withColumns({"cum": F.sum("frq").over(w.orderBy("len")), "n": F.sum("frq").over(w)})
    x = c.withColumn("q", F.explode(F.array(*[F.lit(v) for v in (0.1, 0.25, 0.5, 0.75, 0.9)]))).filter(F.col("cum") >= F.col("q") * F.col("n"))
    return x.groupBy("cid", "q").agg(F.round(F.min(F.col("len") - (F.col("cum") - F.col("q") * F.col("n")) / F.col("frq")), 6).alias("value"))


@query("AGG24", f"""
WITH {_HIST}, b AS (SELECT cid, CAST(floor(20 * log10(len)) AS BIGINT) AS bin, sum(frq) + 1 AS m FROM h GROUP BY 1, 2) SELECT cid, bin, round(m / sum(m) OVER (PARTITION BY cid), 6) AS share FROM b""")
def hist_logbins(spark, sf):
    b = hist(spark, sf).groupBy("cid", F.floor(20 * F.log10("len")).alias("bin")).agg((F.sum("frq") + 1).alias("m"))
    return b.select("cid", "bin", F.round(F.col("m") / F.sum("m").over(Window.partitionBy("cid")), 6).alias("share"))


_PAIR = _HIST + """, p AS (SELECT cid, len, frq / sum(frq) OVER (PARTITION BY cid) AS p FROM h), k AS (SELECT a.c AS i, a.c + 1 AS j FROM (SELECT DISTINCT cid AS c FROM h) a JOIN (SELECT DISTINCT cid AS c FROM h) b ON b.c = a.c + 1),
l AS (SELECT i, j, len FROM k JOIN h ON h.cid = i UNION SELECT i, j, len FROM k JOIN h ON h.cid = j),
m AS (SELECT l.i, l.j, l.len, coalesce(a.p, 0) AS p, coalesce(b.p, 0) AS q FROM l LEFT JOIN p a ON a.cid = l.i AND a.len = l.len LEFT JOIN p b ON b.cid = l.j AND b.len = l.len)"""


def pairs(spark, sf):
    """i, j, len, p, q: the distributions of neighbouring chromosomes side by side."""
    h = hist(spark, sf).withColumn("p", F.col("frq") / F.sum("frq").over(Window.partitionBy("cid")))
    one = h.select(F.col("cid").alias("i"), (F.col("cid") + 1).alias("j"), "len", "p")
    two = h.select((F.col("cid") - 1).alias("i"), F.col("cid").alias("j"), "len", F.col("p").alias("q"))
    both = h.select("cid").distinct()
    k = both.select(F.col("cid").alias("i")).join(both.select((F.col("cid") - 1).alias("i")), "i", "left_semi")
    return one.join(two, ["i", "j", "len"], "full").join(k, "i", "left_semi").fillna(0.0, ["p", "q"])


_JS = "CASE WHEN {0} > 0 THEN {0} * ln({0} / ((p + q) / 2)) ELSE 0 END"
_DIST = {
    "ec": ("sqrt(sum(pow(p - q, 2)))", lambda p, q: F.sqrt(F.sum(F.pow(p - q, F.lit(2))))),
    "e2": ("sum(pow(p - q, 2))", lambda p, q: F.sum(F.pow(p - q, F.lit(2)))),
    "mh": ("sum(abs(p - q))", lambda p, q: F.sum(F.abs(p - q))),
    "cs": ("acos(least(1, sum(p * q) / sqrt(sum(p * p) * sum(q * q))))", lambda p, q: F.acos(F.least(F.lit(1.0), F.sum(p * q) / F.sqrt(F.sum(p * p) * F.sum(q * q))))),
    "js": (f"0.5 * sum({_JS.format('p')}) + 0.5 * sum({_JS.format('q')})", lambda p, q: 0.5 * F.sum(F.when(p > 0, p * F.log(p / ((p + q) / 2))).otherwise(0.0)) + 0.5 * F.sum(F.when(q > 0, q * F.log(q / ((p + q) / 2))).otherwise(0.0))),
    "ja": ("1 - sum(least(p, q)) / sum(greatest(p, q))", lambda p, q: 1 - F.sum(F.least(p, q)) / F.sum(F.greatest(p, q))),
    "kl": ("sum((p - q) * ln((p + 1e-4) / (q + 1e-4)))", lambda p, q: F.sum((p - q) * F.log((p + 1e-4) / (q + 1e-4)))),
    "ua": ("1 - sum(least(p, q))", lambda p, q: 1 - F.sum(F.least(p, q))),
}


def _distance(name):
    sql, column = _DIST[name]

    @query("STA17 JON17", f"WITH {_PAIR} SELECT i, j, round({sql}, 6) AS distance FROM m GROUP BY i, j", f"dist_{name}")
    def run(spark, sf):
        return pairs(spark, sf).groupBy("i", "j").agg(F.round(column(F.col("p"), F.col("q")), 6).alias("distance"))


for _name in _DIST:
    _distance(_name)


@query("STA16", f"""
WITH {_PAIR}, c AS (SELECT i, j, sum(p) OVER w AS cp, sum(q) OVER w AS cq FROM m WINDOW w AS (PARTITION BY i, j ORDER BY len)) SELECT i, j, round(max(abs(cp - cq)), 6) AS ks, round(sqrt(avg(pow(cp - cq, 2))), 6) AS rmsd FROM c GROUP BY i, j""")
def dist_ks(spark, sf):
    w = Window.partitionBy("i", "j").orderBy("len")
    c = pairs(spark, sf).select("i", "j", (F.sum("p").over(w) - F.sum("q").over(w)).alias("d"))
    return c.groupBy("i", "j").agg(F.round(F.max(F.abs("d")), 6).alias("ks"), F.round(F.sqrt(F.avg(F.pow("d", F.lit(2)))), 6).alias("rmsd"))


_MU, _TH, _K = 15.0, 60.0, 2.5
_CDF = f"exp(-pow((len - {_MU}) / {_TH}, -{_K}))"
_PDF = f"{_K} / {_TH} * pow((len - {_MU}) / {_TH}, -1 - {_K}) * {_CDF}"


def frechet(x):
    z = (x - _MU) / _TH
    cdf = F.exp(-F.pow(z, F.lit(-_K)))
    return _K / _TH * F.pow(z, F.lit(-1 - _K)) * cdf, cdf


@query("STA13 STA14", f"SELECT len, round({_PDF}, 9) AS pdf, round({_CDF}, 9) AS cdf, round({_MU} + {_TH} / pow(-ln({_CDF}), 1 / {_K}), 5) AS back FROM (SELECT unnest(range(40, 1001)) AS len)")
def frechet_pdf_cdf(spark, sf):
    """A Fréchet component, its distribution and the quantile that leads back."""
    pdf, cdf = frechet(F.col("id"))
    return spark.range(40, 1001).select(F.col("id").alias("len"), F.round(pdf, 9).alias("pdf"), F.round(cdf, 9).alias("cdf"), F.round(_MU + _TH / F.pow(-F.log(cdf), F.lit(1 / _K)), 5).alias("back"))


@query("STA21", f"WITH d AS (SELECT len, {_PDF} AS pdf FROM (SELECT unnest(range(20, 1001)) AS len)) SELECT len, round(10 * log10(pdf / max(pdf) OVER ()), 5) AS penalty FROM d")
def intron_penalty_table(spark, sf):
    d = spark.range(20, 1001).select(F.col("id").alias("len"), frechet(F.col("id"))[0].alias("pdf"))  # a table of lengths
    return d.select("len", F.round(10 * F.log10(F.col("pdf") / F.max("pdf").over(Window.partitionBy())), 5).alias("penalty"))


@query("STA25", "SELECT n, 3 * n + 8 AS affine, CASE WHEN n = 0 THEN 0 WHEN n <= 10 THEN 3 * n + 8 ELSE least(3 * n + 8, n + 28) END AS double_affine, 3 * n + 8 + CASE WHEN n % 3 = 0 THEN 0 ELSE 30 END AS frame_aware FROM (SELECT unnest(range(0, 301)) AS n)")
def gap_costs(spark, sf):
    n = F.col("n")
    costs = spark.range(301).select(F.col("id").alias("n"))
    return costs.select("n", (3 * n + 8).alias("affine"), F.when(n == 0, 0).when(n <= 10, 3 * n + 8).otherwise(F.least(3 * n + 8, n + 28)).alias("double_affine"), (3 * n + 8 + F.when(n % 3 == 0, 0).otherwise(30)).alias("frame_aware"))


@query("STA23", "SELECT a, b, bit_count(a & b) AS shared, CASE WHEN a & b > 0 THEN 2 ELSE -6 END AS score FROM (SELECT unnest(range(1, 16)) AS a), (SELECT unnest(range(1, 16)) AS b)".replace("bit_count(a & b)", "CAST(bit_count(a & b) AS BIGINT)").replace("a & b > 0", "(a & b) > 0"))
def ambiguity_scores(spark, sf):
    """Nucleotide sets of four bits match where they overlap. 15 x 15 sets."""
    a = spark.range(1, 16).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(15).cast("long"))).alias("b"))
    both = F.col("a").bitwiseAND(F.col("b"))
    return a.select("a", "b", F.bit_count(both).cast("long").alias("shared"), F.when(both > 0, 2).otherwise(-6).alias("score"))


@query("STA22", """
WITH m1 AS (SELECT a, b, CASE WHEN a = b THEN 0.97 WHEN abs(a - b) = 2 THEN 0.02 ELSE 0.005 END AS p FROM (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b)),
m2 AS (SELECT x.a, y.b, sum(CAST(x.p AS DOUBLE) * y.p) AS p FROM m1 x JOIN m1 y ON x.b = y.a GROUP BY x.a, y.b), m4 AS (SELECT x.a, y.b, sum(x.p * y.p) AS p FROM m2 x JOIN m2 y ON x.b = y.a GROUP BY x.a, y.b)
SELECT a, b, round(p, 6) AS p, round(10 * log10(p / 0.25), 4) AS score FROM m4""")
def pam_power(spark, sf):
    """A substitution matrix to the fourth power by joins, and its log odds."""
    a = spark.range(4).select(F.col("id").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("b"))
    m = a.withColumn("p", F.when(F.col("a") == F.col("b"), 0.97).when(F.abs(F.col("a") - F.col("b")) == 2, 0.02).otherwise(0.005))
    for _ in range(2):
        m = m.select("a", F.col("b").alias("k"), F.col("p").alias("x")).join(m.select(F.col("a").alias("k"), "b", F.col("p").alias("y")), "k").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p"))
    return m.select("a", "b", F.round("p", 6).alias("p"), F.round(10 * F.log10(F.col("p") / 0.25), 4).alias("score"))


_POS = INTRON_SQL + ", pos AS (SELECT DISTINCT cid AS member, donor % 5000 AS pos, phase FROM intron)"


def positions(spark, sf):
    return intron(spark, sf).select(F.col("cid").alias("member"), (F.col("donor") % 5000).alias("pos"), "phase").distinct()


@query("SET03 AGG21", f"""
WITH {_POS}, n AS (SELECT member, count(*) AS n FROM pos GROUP BY member), c AS (SELECT a.member AS i, b.member AS j, count(*) AS common FROM pos a JOIN pos b ON a.pos = b.pos AND a.phase = b.phase AND a.member < b.member GROUP BY 1, 2)
SELECT i, j, common, round((x.n + y.n - 2 * common) / (x.n + y.n), 6) AS distance FROM c JOIN n x ON x.member = i JOIN n y ON y.member = j""")
def intron_set_distance(spark, sf):
    p = positions(spark, sf)
    n = p.groupBy("member").agg(F.count("*").alias("n"))
    c = p.withColumnRenamed("member", "i").join(p.withColumnRenamed("member", "j"), ["pos", "phase"]).filter("i < j").groupBy("i", "j").agg(F.count("*").alias("common"))
    j = c.join(F.broadcast(n.select(F.col("member").alias("i"), F.col("n").alias("x"))), "i").join(F.broadcast(n.select(F.col("member").alias("j"), F.col("n").alias("y"))), "j")
    return j.select("i", "j", "common", F.round((F.col("x") + F.col("y") - 2 * F.col("common")) / (F.col("x") + F.col("y")), 6).alias("distance"))


@query("SET04", f"WITH {_POS} SELECT min(member) AS member, pos, phase FROM pos GROUP BY pos, phase HAVING count(*) = 1")
def intron_private(spark, sf):
    return positions(spark, sf).groupBy("pos", "phase").agg(F.min("member").alias("member"), F.count("*").alias("n")).filter("n = 1").drop("n")


@query("AGG21 JON16", f"WITH {_POS} SELECT pos, phase, count(*) AS members, count(*) * (count(*) - 1) // 2 AS pairs, string_agg(CAST(member AS VARCHAR), ',' ORDER BY member) AS list FROM pos GROUP BY pos, phase")
def intron_common(spark, sf):
    g = positions(spark, sf).groupBy("pos", "phase").agg(F.count("*").alias("members"), F.array_sort(F.collect_list("member")).alias("l"))
    return g.select("pos", "phase", "members", F.floor(F.col("members") * (F.col("members") - 1) / 2).alias("pairs"), F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("list"))


@query("RES01 RES02", f"""
WITH {_POS}, b AS (SELECT pos, count(*) AS bonus FROM pos GROUP BY pos) SELECT member, pos - 1000 AS shifted, phase, bonus FROM pos JOIN b USING (pos) WHERE pos BETWEEN 1000 AND 3000""")
def intron_profile_cut(spark, sf):
    """A slice of the profile with the bonus of each place."""
    p = positions(spark, sf).filter("pos between 1000 and 3000")
    return p.join(p.groupBy("pos").agg(F.count("*").alias("bonus")), "pos").select("member", (F.col("pos") - 1000).alias("shifted"), "phase", "bonus")


@query("RES04 RES05", f"WITH {INTRON_SQL} SELECT gene_id, intron_no, donor - 1 AS boundary, phase, ends, CASE WHEN ends LIKE 'GT%' THEN 20 WHEN ends LIKE 'GC%' THEN 10 ELSE 0 END - CASE WHEN phase = 2 AND mmc5 > 2 THEN 30 ELSE 0 END AS signal FROM intron")
def junction_report(spark, sf):
    signal = F.when(F.col("ends").startswith("GT"), 20).when(F.col("ends").startswith("GC"), 10).otherwise(0) - F.when((F.col("phase") == 2) & (F.col("mmc5") > 2), 30).otherwise(0)
    return intron(spark, sf).select("gene_id", "intron_no", (F.col("donor") - 1).alias("boundary"), "phase", "ends", signal.alias("signal"))


@query("STA20", f"""SELECT round({_MU} + {_TH} * pow({_K} / (1 + {_K}), 1 / {_K}), 5) AS mode, round({_MU} + {_TH} / pow(ln(2), 1 / {_K}), 5) AS median, round({_MU} + {_TH} / pow(-ln(0.25), 1 / {_K}), 5) AS q1, round({_MU} + {_TH} / pow(-ln(0.75), 1 / {_K}), 5) AS q3""")
def mixture_report(spark, sf):
    q = lambda p: round(_MU + _TH / (-math.log(p)) ** (1 / _K), 5)
    return spark.range(1).select(F.lit(round(_MU + _TH * (_K / (1 + _K)) ** (1 / _K), 5)).alias("mode"), F.lit(q(0.5)).alias("median"), F.lit(q(0.25)).alias("q1"), F.lit(q(0.75)).alias("q3"))
