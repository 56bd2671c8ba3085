"""The smaller operators: junction scans, feature parsing, layouts, expectations, clusters of members."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import seq
from ..operators.align import clades, differences, medoids, protein_score
from ..sources.views import DNA_SQL, EXON_SQL, INTRON_SQL, dna, exon, table
from .align import _per_pair, pairs as neighbours
from .models import pam_power
from .msa import msa, planes
from .records import rec_feature_join
from .registry import query


@query("SRC13", f"WITH {DNA_SQL} SELECT doc_id, CAST(i AS BIGINT) AS junction, substr(dna, 60 * i + 26, 10) AS wings FROM (SELECT doc_id, dna, unnest(range(0, (length(dna) + 25) // 60)) AS i FROM dna)")
def seq_junction_windows(spark, sf):
    """Five bases on both sides of the end of each exon of 30."""
    wings = F.regexp_extract_all("dna", F.lit("[acgt]{25}([acgt]{10})(?:[acgt]{25}|[acgt]*$)"), F.lit(1))
    j = dna(spark, sf).select("doc_id", F.posexplode(wings).alias("junction", "wings"))
    return j.select("doc_id", F.col("junction").cast("long").alias("junction"), "wings")


@query("SRC14", f"WITH {EXON_SQL} SELECT gene_id, strand, exon_no AS part, gleft AS from_, gright AS to_ FROM exon")
def src_feature_ranges(spark, sf):
    """Parses join(..) and complement(..) back to ranges."""
    f = rec_feature_join(spark, sf)
    ends = lambda g: F.regexp_extract_all("feature", F.lit(r"<?(\d+)\.\.>?(\d+)"), F.lit(g))
    x = f.select("gene_id", F.when(F.col("feature").startswith("complement"), "-").otherwise("+").alias("strand"), F.posexplode(F.arrays_zip(ends(1).alias("a"), ends(2).alias("b"))).alias("p", "r"))
    return x.select("gene_id", "strand", (F.col("p") + 1).cast("long").alias("part"), F.col("r.a").cast("long").alias("from_"), F.col("r.b").cast("long").alias("to_"))


@query("SNK02 SNK15", f"""
WITH {INTRON_SQL}, o AS (SELECT gene_id, exon_no, 'M' || elen || CASE WHEN nleft IS NULL THEN '' ELSE ' D' || (nleft - gright - 1) END AS op FROM i0)
SELECT gene_id, 'Gap=' || string_agg(op, ' ' ORDER BY exon_no) AS attribute FROM o GROUP BY gene_id""")
def rec_gap_attribute(spark, sf):
    nxt = F.lead("gleft").over(Window.partitionBy("gene_id").orderBy("exon_no"))
    op = F.concat(F.lit("M"), "elen", F.when(nxt.isNull(), "").otherwise(F.concat(F.lit(" D"), nxt - F.col("gright") - 1)))
    ops = exon(spark, sf).select("gene_id", "exon_no", op.alias("op")).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("exon_no", "op"))).alias("o"))
    return ops.select("gene_id", F.concat(F.lit("Gap="), F.array_join(F.transform("o", lambda x: x["op"]), " ")).alias("attribute"))


@query("WIN10", f"""
WITH {DNA_SQL}, w AS (SELECT doc_id, p, substr(dna, p, 4) AS k FROM (SELECT doc_id, dna, unnest(range(1, length(dna) - 2)) AS p FROM dna WHERE length(dna) >= 4)),
s AS (SELECT doc_id, p, k, max(CASE WHEN k LIKE 'ct_a' THEN p END) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS branch FROM w)
SELECT doc_id, p AS acceptor, branch FROM s WHERE k LIKE 'ag%' AND branch IS NOT NULL""")
def seq_branch_points(spark, sf):
    """The last branch signal at most 30 bases before an acceptor: only signals are rows, not bases."""
    w = dna(spark, sf).select("doc_id", F.posexplode(seq.kmers(F.col("dna"), 4)).alias("i", "k")).filter(F.col("k").rlike("^(ag|ct.a)"))
    w = w.select("doc_id", (F.col("i") + 1).cast("long").alias("p"), "k")
    last = F.max(F.when(F.col("k").startswith("ct"), F.col("p"))).over(Window.partitionBy("doc_id").orderBy("p").rangeBetween(-30, 0))
    return w.withColumn("branch", last).filter("k like 'ag%' and branch is not null").select("doc_id", F.col("p").alias("acceptor"), "branch")


@query("STA24", """
WITH m1 AS (SELECT a, b, CASE WHEN a = b THEN 0.97 WHEN abs(a - b) = 2 THEN 0.02 ELSE 0.005 END AS p FROM (SELECT unnest(range(0, 4)) AS a), (SELECT unnest(range(0, 4)) AS b)),
m2 AS (SELECT x.a, y.b, sum(CAST(x.p AS DOUBLE) * y.p) AS p FROM m1 x JOIN m1 y ON x.b = y.a GROUP BY x.a, y.b), m4 AS (SELECT x.a, y.b, sum(x.p * y.p) AS p FROM m2 x JOIN m2 y ON x.b = y.a GROUP BY x.a, y.b)
SELECT a % 2 AS class_a, b % 2 AS class_b, round(avg(round(10 * log10(p / 0.25), 4)), 4) AS score FROM m4 GROUP BY 1, 2""")
def reduced_matrix(spark, sf):
    return pam_power(spark, sf).groupBy((F.col("a") % 2).alias("class_a"), (F.col("b") % 2).alias("class_b")).agg(F.round(F.avg("score"), 4).alias("score"))


@query("RES06", f"WITH {DNA_SQL} SELECT doc_id, round(greatest(length(dna) - 7, 0) * (1 - pow(1 - 1 / pow(4, 8), 256)), 6) AS expected FROM dna")
def block_expectation(spark, sf):
    """Words of eight that a random block of 256 bases would share with each sequence."""
    return dna(spark, sf).select("doc_id", F.round(F.greatest(F.length("dna") - 7, F.lit(0)) * (1 - (1 - 1 / 4**8) ** 256), 6).alias("expected"))


@query("STA28")
def random_normals(spark, sf):
    """Gaussian numbers of each document by hashes of its id: the same in every run."""
    u = lambda seed: (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    return table(spark, sf, "documents").select("doc_id", F.round(F.sqrt(-2 * F.log(u(1))) * F.cos(2 * 3.141592653589793 * u(2)), 9).alias("z"))


def _grouped(spark, sf, f, column):
    rows = F.sort_array(F.collect_list(F.struct("member", "gap", "low", "high")))
    families = planes(spark, sf).filter("label is not null").groupBy("label").agg(rows.alias("m"), F.count("*").alias("n")).filter("n > 1")
    families = families.select("label", *[F.col("m")[c].alias(c) for c in ("member", "gap", "low", "high")])

    def run(batches):
        for pdf in batches:
            rows = []
            for label, own, *bits in zip(pdf["label"], pdf["member"], pdf["gap"], pdf["low"], pdf["high"], strict=True):
                rows += [(label, m, c) for m, c in f(own.tolist(), differences(*bits)).items()]
            yield pd.DataFrame(rows, columns=["label", "member", column])

    # A family is one alignment: three words a member, and distances made as they are asked for.
    return families.mapInPandas(run, f"label long, member long, {column} long")


@query("AGG29")
def msa_clades(spark, sf):
    return _grouped(spark, sf, lambda own, d: clades(own, d, 0.25), "master")


@query("AGG30")
def msa_medoids(spark, sf):
    return _grouped(spark, sf, lambda own, d: medoids(own, d, 0.2), "medoid")


@query("ALN06")
def align_protein(spark, sf):
    """Each item's translation against the next item."""
    table_, schema = seq.codons(), "item_id long, score long"
    return neighbours(spark, sf).select("item_id", F.split(seq.translate(F.col("a")), r"\*").getItem(0).alias("a"), "b").mapInPandas(_per_pair(lambda a, b: (protein_score(a, b, table_),), schema), schema)


@query("SNK01 SNK19")
def align_layout(spark, sf):
    """Each family as an interleaved alignment of 40 columns, with names and residue numbers."""

    def run(batches):
        for pdf in batches:
            out = []
            for label, member, r in zip(pdf["label"], pdf["member"], pdf["r"], strict=True):
                text, done = "".join(r), 0
                for block, at in enumerate(range(0, len(text), 40)):
                    part = text[at : at + 40]
                    done += len(part.replace("-", ""))
                    out.append((label, block, member, f"{member:<10d}{part} {done}"))
            yield pd.DataFrame(out, columns=["label", "block", "member", "line"])

    return msa(spark, sf).mapInPandas(run, "label long, block long, member long, line string")
