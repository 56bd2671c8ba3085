"""Queries over gene, exon and intron records."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals
from ..operators.records import CANONICAL, PRESETS, bed12, canonical, first_by, gene_loci, gff3, passing
from ..sources.views import EXON_SQL, GENE_SQL, INTRON_SQL, exon, gene, intron, table
from .registry import query

LOCI = """
l0 AS (SELECT *, CASE WHEN gstart > max(gend) OVER (PARTITION BY cid, strand ORDER BY gstart, gend, nexn, gene_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
       WHEN row_number() OVER (PARTITION BY cid, strand ORDER BY gstart, gend, nexn, gene_id) = 1 THEN 1 ELSE 0 END AS opens FROM kept),
l AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY cid, strand ORDER BY gstart, gend, nexn, gene_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS locus FROM l0)"""


def _where(name: str) -> str:
    f = PRESETS[name]
    return f"pmatch >= {f.match} AND pcover >= {f.cover} AND gscore >= {f.score} AND bmmc <= {f.bmmc} AND bunp <= {f.bunp} AND ng <= {f.ng}"


@query("FLT01 JON04 WIN01 AGG17 SRT02", f"""
WITH {GENE_SQL}, kept AS (SELECT * FROM gene WHERE {_where('mild')}), {LOCI}
SELECT cid, strand, locus, min(gstart) AS locus_start, max(gend) AS locus_end, count(*) AS isoforms, CAST(sum(nexn) AS BIGINT) AS exons, round(max(gscore), 6) AS best_score
FROM l GROUP BY cid, strand, locus""")
def rec_locus_report(spark, sf):
    found = gene_loci(passing(gene(spark, sf), PRESETS["mild"]))
    return found.groupBy("cid", "strand", "locus").agg(F.min("gstart").alias("locus_start"), F.max("gend").alias("locus_end"), F.count("*").alias("isoforms"), F.sum("nexn").alias("exons"), F.round(F.max("gscore"), 6).alias("best_score")).orderBy("cid", "strand", "locus_start")


@query("WIN01 AGG16", f"""
WITH {GENE_SQL}, kept AS (SELECT * FROM gene), {LOCI}
SELECT cid, strand, locus, gene_id, rlen, nexn FROM (SELECT *, row_number() OVER (PARTITION BY cid, strand, locus ORDER BY rlen DESC, gene_id) AS r FROM l) WHERE r = 1""")
def rec_best_per_locus(spark, sf):
    return first_by(gene_loci(gene(spark, sf)), ["cid", "strand", "locus"], -F.col("rlen"), F.col("gene_id")).select("cid", "strand", "locus", "gene_id", "rlen", "nexn")


@query("WIN03 AGG15", f"""
WITH {INTRON_SQL}
SELECT cid, strand, donor, acceptor, count(*) AS evidence, max(mch) AS mch, min_by(gene_id, (-mch, gene_id, intron_no)) AS gene_id FROM intron GROUP BY ALL""".replace("GROUP BY ALL", "GROUP BY cid, strand, donor, acceptor"))
def rec_unique_intron(spark, sf):
    found = intron(spark, sf).groupBy("cid", "strand", "donor", "acceptor").agg(F.count("*").alias("evidence"), F.max("mch").alias("mch"), F.min(F.struct(-F.col("mch"), "gene_id", "intron_no")).alias("m"))
    return found.select("cid", "strand", "donor", "acceptor", "evidence", "mch", F.col("m.gene_id").alias("gene_id"))


@query("AGG14", f"""
WITH {EXON_SQL}
SELECT cid, strand, gleft, gright, count(*) AS uses, min(gene_id) AS first_gene FROM exon GROUP BY cid, strand, gleft, gright""")
def rec_exon_ids(spark, sf):
    """Shared exons get one identity (their place) and how often they are used."""
    return exon(spark, sf).groupBy("cid", "strand", "gleft", "gright").agg(F.count("*").alias("uses"), F.min("gene_id").alias("first_gene"))


def _preset(name):
    @query("FLT01", f"WITH {GENE_SQL} SELECT gene_id, cid, strand, gstart, gend, gscore FROM gene WHERE {_where(name)}", f"rec_filter_preset_{name}")
    def run(spark, sf):
        return passing(gene(spark, sf), PRESETS[name]).select("gene_id", "cid", "strand", "gstart", "gend", "gscore")


for _name in PRESETS:
    _preset(_name)


@query("FLT02", f"""
WITH {INTRON_SQL}, bad AS (SELECT DISTINCT gene_id FROM intron WHERE mmc5 + mmc3 > 6 OR ilen % 7 > 4)
SELECT gene_id, cid, strand, nexn FROM gene WHERE gene_id NOT IN (SELECT gene_id FROM bad)""")
def rec_junction_filter(spark, sf):
    """A transcript with one failing junction is rejected whole."""
    bad = intron(spark, sf).filter("mmc5 + mmc3 > 6 or ilen % 7 > 4")
    return gene(spark, sf).join(bad, "gene_id", "left_anti").select("gene_id", "cid", "strand", "nexn")


_LEVELS = [f"ends IN {CANONICAL}", "ends LIKE 'ATA%'", "(substr(ends,1,1)<>'G')::INT + (substr(ends,2,1)<>'T')::INT + (substr(ends,3,1)<>'A')::INT + (substr(ends,4,1)<>'G')::INT <= 1", "true"]


def _canonical(level):
    @query("FLT03", f"WITH {INTRON_SQL} SELECT gene_id, intron_no, ends FROM intron WHERE " + " OR ".join(_LEVELS[: level + 1]), f"rec_canonical_level_{level}")
    def run(spark, sf):
        return intron(spark, sf).filter(canonical(F.col("ends"), level)).select("gene_id", "intron_no", "ends")


for _level in range(4):
    _canonical(_level)


def _chrom(name, order_sql, order):
    @query("AGG13 SRT01", f"WITH {GENE_SQL}, c AS (SELECT cid, count(*) AS genes, CAST(sum(nexn) AS BIGINT) AS exons FROM gene GROUP BY cid) SELECT cid, genes, exons, row_number() OVER (ORDER BY {order_sql}) AS place FROM c", f"rec_chrom_order_{name}")
    def run(spark, sf):
        c = gene(spark, sf).groupBy("cid").agg(F.count("*").alias("genes"), F.sum("nexn").alias("exons"))
        return c.withColumn("place", F.row_number().over(Window.orderBy(*order())).cast("long"))  # one row a chromosome


_chrom("alpha", "CAST(cid AS VARCHAR)", lambda: [F.col("cid").cast("string")])
_chrom("abund", "genes DESC, cid", lambda: [F.desc("genes"), F.col("cid")])


@query("SNK00", f"""
WITH {GENE_SQL}, e AS (SELECT *, coalesce(sum(elen) OVER (PARTITION BY gene_id ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM exon)
SELECT gene_id, CAST(-2 AS BIGINT) AS line_no, concat_ws(chr(9), 'chr' || cid, 'est', 'gene', gstart, gend, '.', strand, '.', 'ID=gene' || gene_id) AS line FROM gene
UNION ALL SELECT gene_id, -1, concat_ws(chr(9), 'chr' || cid, 'est', 'mRNA', gstart, gend, '.', strand, '.', 'ID=mRNA' || gene_id || ';Parent=gene' || gene_id) FROM gene
UNION ALL SELECT gene_id, exon_no, concat_ws(chr(9), 'chr' || cid, 'est', 'cds', gleft, gright, '.', strand, CAST((3 - done % 3) % 3 AS BIGINT), 'ID=cds' || gene_id || '.' || exon_no || ';Parent=mRNA' || gene_id) FROM e""")
def rec_gff3_lines(spark, sf):
    return gff3(gene(spark, sf), exon(spark, sf))


@query("SNK03", f"""
WITH {GENE_SQL}, b AS (SELECT gene_id, string_agg(CAST(elen AS VARCHAR), ',' ORDER BY gleft, elen) AS sizes, list(gleft ORDER BY gleft, elen) AS starts FROM exon GROUP BY gene_id)
SELECT gene_id, concat_ws(chr(9), 'chr' || cid, gstart - 1, gend, 'gene' || gene_id, CAST(least(1000, floor(pcover * 10)) AS BIGINT), strand, gstart - 1, gend, '0', nexn, sizes, array_to_string(list_transform(starts, lambda x: x - gstart), ',')) AS line
FROM gene JOIN b USING (gene_id)""")
def rec_bed_lines(spark, sf):
    return bed12(gene(spark, sf), exon(spark, sf))


@query("SNK05", f"""
WITH {INTRON_SQL} SELECT gene_id, intron_no, concat_ws(chr(9), 'chr' || cid, strand, donor, acceptor, phase, mch, mmc5 + mmc3, ilen, ends) AS line FROM intron""")
def rec_intron_lines(spark, sf):
    return intron(spark, sf).select("gene_id", "intron_no", F.concat_ws("\t", F.concat(F.lit("chr"), "cid"), "strand", "donor", "acceptor", "phase", "mch", F.col("mmc5") + F.col("mmc3"), "ilen", "ends").alias("line"))


@query("SNK04", f"""
WITH {GENE_SQL}
SELECT gene_id, exon_no AS line_no, concat_ws(' ', 'chr' || cid, gleft, gright, elen, mmc, strand) AS line FROM exon
UNION ALL SELECT gene_id, 1000000, concat_ws(' ', '@', 'chr' || cid, strand, '(', gstart, gend, ')', nexn, mmc) FROM gene""")
def rec_exon_lines(spark, sf):
    e = exon(spark, sf).select("gene_id", F.col("exon_no").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("chr"), "cid"), "gleft", "gright", "elen", "mmc", "strand").alias("line"))
    return e.union(gene(spark, sf).select("gene_id", F.lit(1000000).cast("long"), F.concat_ws(" ", F.lit("@"), F.concat(F.lit("chr"), "cid"), "strand", F.lit("("), "gstart", "gend", F.lit(")"), "nexn", "mmc")))


@query("WIN02", f"""
WITH {GENE_SQL}, kept AS (SELECT * FROM gene), {LOCI}, e AS (SELECT cid, strand, locus, max(gend) AS locus_end FROM l GROUP BY cid, strand, locus)
SELECT gene_id, locus, locus_end FROM l JOIN e USING (cid, strand, locus) WHERE {_where('medium')}""")
def rec_locus_end_lookahead(spark, sf):
    """Filtered genes, with the ends of loci of all genes."""
    every = gene_loci(gene(spark, sf))
    ends = every.groupBy("cid", "strand", "locus").agg(F.max("gend").alias("locus_end"))
    return passing(every, PRESETS["medium"]).join(ends, ["cid", "strand", "locus"]).select("gene_id", "locus", "locus_end")


@query("WIN16", f"""
WITH {EXON_SQL}, o AS (SELECT *, max(gright) OVER (PARTITION BY cid ORDER BY gleft, gright, gene_id, exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM exon),
r AS (SELECT *, sum(CASE WHEN reach IS NULL OR gleft > reach THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY gleft, gright, gene_id, exon_no ROWS UNBOUNDED PRECEDING) AS run FROM o)
SELECT cid, min(gleft) AS left_end, max(gright) AS right_end, count(*) AS parts FROM r GROUP BY cid, run""")
def rec_interval_union(spark, sf):
    runs = intervals.loci(exon(spark, sf), ["cid"], "gleft", "gright", ["gene_id", "exon_no"], "run")
    return runs.groupBy("cid", "run").agg(F.min("gleft").alias("left_end"), F.max("gright").alias("right_end"), F.count("*").alias("parts")).drop("run")


@query("AGG12", f"""
WITH {EXON_SQL}, e AS (SELECT *, lag(mmc, 1, 0) OVER (PARTITION BY gene_id ORDER BY exon_no) AS m3 FROM exon)
SELECT gene_id, count(*) AS nexn, min(gleft) AS gstart, max(gright) AS gend, CAST(sum(mmc) AS BIGINT) AS mmc, CAST(sum(CASE WHEN exon_no > 1 THEN mmc + m3 ELSE 0 END) AS BIGINT) AS bmmc, round(100.0 * sum(elen - mmc) / sum(elen), 6) AS pmatch FROM e GROUP BY gene_id""")
def rec_gene_rollup(spark, sf):
    e = exon(spark, sf).withColumn("m3", F.lag("mmc", 1, 0).over(Window.partitionBy("gene_id").orderBy("exon_no")))
    return e.groupBy("gene_id").agg(F.count("*").alias("nexn"), F.min("gleft").alias("gstart"), F.max("gright").alias("gend"), F.sum("mmc").alias("mmc"), F.sum(F.when(F.col("exon_no") > 1, F.col("mmc") + F.col("m3")).otherwise(0)).alias("bmmc"), F.round(100.0 * F.sum(F.col("elen") - F.col("mmc")) / F.sum("elen"), 6).alias("pmatch"))


@query("WIN04", f"""
WITH {EXON_SQL} SELECT gene_id, exon_no, CAST(sum(mmc) OVER (PARTITION BY gene_id ORDER BY exon_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS BIGINT) AS near_mmc FROM exon""")
def rec_junction_neighbourhood(spark, sf):
    w = Window.partitionBy("gene_id").orderBy("exon_no").rowsBetween(-9, 0)
    return exon(spark, sf).select("gene_id", "exon_no", F.sum("mmc").over(w).alias("near_mmc"))


@query("RES03", f"""
WITH {INTRON_SQL} SELECT gene_id, intron_no, CAST(sum(ilen) OVER (PARTITION BY gene_id ORDER BY intron_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS intron_to_end FROM intron""")
def rec_to_gene_end(spark, sf):
    w = Window.partitionBy("gene_id").orderBy("intron_no").rowsBetween(0, Window.unboundedFollowing)
    return intron(spark, sf).select("gene_id", "intron_no", F.sum("ilen").over(w).alias("intron_to_end"))


@query("SRT05", f"""
WITH {INTRON_SQL} SELECT gene_id, intron_no, donor, row_number() OVER (PARTITION BY gene_id ORDER BY CASE WHEN strand = '-' THEN -donor ELSE donor END) AS place FROM intron""")
def rec_minus_reverse(spark, sf):
    w = Window.partitionBy("gene_id").orderBy(F.when(F.col("strand") == "-", -F.col("donor")).otherwise(F.col("donor")))
    return intron(spark, sf).select("gene_id", "intron_no", "donor", F.row_number().over(w).cast("long").alias("place"))


@query("SRT02 SRT03 SRT04", f"WITH {GENE_SQL} SELECT gene_id, cid, strand, gstart, gend, nexn FROM gene")
def rec_gene_sort(spark, sf):
    """Range-partitioned by chromosome and place, sorted inside."""
    return gene(spark, sf).select("gene_id", "cid", "strand", "gstart", "gend", "nexn").repartitionByRange("cid", "strand", "gstart", "gend", "nexn", "gene_id").sortWithinPartitions("cid", "strand", "gstart", "gend", "nexn", "gene_id")


@query("SET01", """
SELECT 0 AS file_no, r_name AS name FROM region UNION ALL SELECT 1, n_name FROM nation UNION ALL SELECT 2, s_name FROM supplier""".replace("0 AS file_no", "CAST(0 AS BIGINT) AS file_no"))
def rec_union_tagged(spark, sf):
    parts = [table(spark, sf, t).select(F.lit(i).cast("long").alias("file_no"), F.col(c).alias("name")) for i, (t, c) in enumerate((("region", "r_name"), ("nation", "n_name"), ("supplier", "s_name")))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("FLT12", f"WITH {INTRON_SQL} SELECT gene_id, intron_no, ilen FROM intron WHERE ilen BETWEEN 30 AND 100")
def rec_intron_length_bounds(spark, sf):
    return intron(spark, sf).filter(F.col("ilen").between(30, 100)).select("gene_id", "intron_no", "ilen")


@query("AGG19", f"""
WITH {INTRON_SQL} SELECT cid, count(*) AS introns, count(*) FILTER (WHERE ends = 'GTAG') AS gtag, count(*) FILTER (WHERE ends = 'GCAG') AS gcag, count(*) FILTER (WHERE ends = 'ATAC') AS atac,
 round(100.0 * count(*) FILTER (WHERE ends IN {CANONICAL}) / count(*), 6) AS canonical_pct FROM intron GROUP BY cid""")
def rec_junction_tetramers(spark, sf):
    n = lambda e: F.count(F.when(F.col("ends") == e, 1))
    return intron(spark, sf).groupBy("cid").agg(F.count("*").alias("introns"), n("GTAG").alias("gtag"), n("GCAG").alias("gcag"), n("ATAC").alias("atac"), F.round(100.0 * F.count(F.when(F.col("ends").isin(*CANONICAL), 1)) / F.count("*"), 6).alias("canonical_pct"))


@query("WIN12 AGG31", f"""
WITH {INTRON_SQL}, c AS (SELECT ends, ilen, count(*) AS copies FROM intron GROUP BY ends, ilen) SELECT ends, count(*) AS distinct_lengths, max(copies) AS most_copies FROM c GROUP BY ends""")
def rec_junction_dedup(spark, sf):
    return intron(spark, sf).groupBy("ends", "ilen").agg(F.count("*").alias("copies")).groupBy("ends").agg(F.count("*").alias("distinct_lengths"), F.max("copies").alias("most_copies"))


@query("SNK17", f"""
WITH {INTRON_SQL}, o AS (SELECT gene_id, exon_no, elen || 'M' || CASE WHEN nleft IS NULL THEN '' ELSE (nleft - gright - 1) || 'N' END AS op FROM i0)
SELECT gene_id, string_agg(op, '' ORDER BY exon_no) AS cigar FROM o GROUP BY gene_id""")
def rec_cigar(spark, sf):
    """Exons match, introns are skipped."""
    nxt = F.lead("gleft").over(Window.partitionBy("gene_id").orderBy("exon_no"))
    op = F.concat(F.col("elen"), F.lit("M"), F.when(nxt.isNull(), "").otherwise(F.concat(nxt - F.col("gright") - 1, F.lit("N"))))
    ops = exon(spark, sf).select("gene_id", "exon_no", op.alias("op")).groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("exon_no", "op"))).alias("o"))
    return ops.select("gene_id", F.array_join(F.transform("o", lambda x: x["op"]), "").alias("cigar"))


@query("SNK10", f"""
WITH {INTRON_SQL}, o AS (SELECT gene_id, exon_no, elen || 'M' || CASE WHEN nleft IS NULL THEN '' ELSE (nleft - gright - 1) || 'N' END AS op FROM i0), c AS (SELECT gene_id, string_agg(op, '' ORDER BY exon_no) AS cigar FROM o GROUP BY gene_id)
SELECT gene_id, concat_ws(chr(9), 'gene' || gene_id, CASE WHEN strand = '-' THEN 16 ELSE 0 END, 'chr' || cid, gstart, 30, cigar, '*', 0, 0, '*', '*', 'NM:i:' || mmc, 'AS:i:' || CAST(gscore AS BIGINT)) AS line FROM gene JOIN c USING (gene_id)""")
def rec_sam_lines(spark, sf):
    j = gene(spark, sf).join(rec_cigar(spark, sf), "gene_id")
    return j.select("gene_id", F.concat_ws("\t", F.concat(F.lit("gene"), "gene_id"), F.when(F.col("strand") == "-", "16").otherwise("0"), F.concat(F.lit("chr"), "cid"), "gstart", F.lit("30"), "cigar", F.lit("*"), F.lit("0"), F.lit("0"), F.lit("*"), F.lit("*"), F.concat(F.lit("NM:i:"), "mmc"), F.concat(F.lit("AS:i:"), F.col("gscore").cast("long"))).alias("line"))


@query("SNK18", f"""
WITH {GENE_SQL}, j AS (SELECT gene_id, strand, string_agg(gleft || '..' || gright, ',' ORDER BY exon_no) AS p FROM exon GROUP BY gene_id, strand)
SELECT gene_id, CASE WHEN strand = '-' THEN 'complement(join(' || p || '))' ELSE 'join(' || p || ')' END AS feature FROM j""")
def rec_feature_join(spark, sf):
    j = exon(spark, sf).groupBy("gene_id", "strand").agg(F.array_sort(F.collect_list(F.struct("exon_no", F.concat("gleft", F.lit(".."), "gright").alias("p")))).alias("x"))
    joined = F.concat(F.lit("join("), F.array_join(F.transform("x", lambda e: e["p"]), ","), F.lit(")"))
    return j.select("gene_id", F.when(F.col("strand") == "-", F.concat(F.lit("complement("), joined, F.lit(")"))).otherwise(joined).alias("feature"))


@query("SRC10", f"WITH {GENE_SQL} SELECT gene_id, cid, strand, gstart, gend, nexn FROM gene WHERE cid BETWEEN 3 AND 7")
def rec_chrom_batch(spark, sf):
    """One batch of chromosomes: the filter goes down to the scan of orders."""
    return gene(spark, sf).filter(F.col("cid").between(3, 7)).select("gene_id", "cid", "strand", "gstart", "gend", "nexn")


@query("JON12", f"""
WITH {GENE_SQL}, p AS (SELECT p_partkey AS probe_id, CAST(p_partkey % 24 AS BIGINT) AS cid, CAST(floor(p_retailprice * 100) AS BIGINT) AS pstart, CAST(floor(p_retailprice * 100) + p_size * 10 AS BIGINT) AS pend FROM part)
SELECT gene_id, probe_id, greatest(gstart, pstart) AS from_, least(gend, pend) AS to_ FROM gene JOIN p ON gene.cid = p.cid AND gstart <= pend AND pstart <= gend""")
def interval_overlap_join(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("probe_id"), (F.col("p_partkey") % 24).alias("cid"), F.floor(F.col("p_retailprice") * 100).alias("pstart"), F.floor(F.floor(F.col("p_retailprice") * 100) + F.col("p_size") * 10).alias("pend"))
    j = intervals.overlaps(gene(spark, sf).select("gene_id", "cid", "gstart", "gend"), p, ["cid"], ("gstart", "gend"), ("pstart", "pend"))
    return j.select("gene_id", "probe_id", F.greatest("gstart", "pstart").alias("from_"), F.least("gend", "pend").alias("to_"))


@query("JON11", f"""
WITH {GENE_SQL}, b AS (SELECT CAST(p_partkey % 24 AS BIGINT) AS cid, CAST(floor(p_retailprice * 100) AS BIGINT) AS bstart, max(p_partkey) AS block FROM part GROUP BY 1, 2)
SELECT gene_id, gene.cid, gstart, block FROM gene ASOF LEFT JOIN b ON gene.cid = b.cid AND gene.gstart >= b.bstart""")
def asof_block_chrom(spark, sf):
    b = table(spark, sf, "part").groupBy((F.col("p_partkey") % 24).alias("cid"), F.floor(F.col("p_retailprice") * 100).alias("bstart")).agg(F.max("p_partkey").alias("block"))
    return intervals.as_of(gene(spark, sf).select("gene_id", "cid", "gstart"), b, ["cid"], "gstart", "bstart", ["block"])


@query("JON13", f"""
WITH {GENE_SQL}, w AS (SELECT gene_id, cid, gstart - 500 AS ws, gend + 500 AS we FROM gene)
SELECT w.gene_id, min(o.gstart) AS ext_start, max(o.gend) AS ext_end, count(*) AS touched FROM w JOIN gene o ON o.cid = w.cid AND o.gstart <= we AND o.gend >= ws GROUP BY w.gene_id""")
def interval_extend(spark, sf):
    """A gene's range widened to the genes near it."""
    w = gene(spark, sf).select("gene_id", "cid", (F.col("gstart") - 500).alias("ws"), (F.col("gend") + 500).alias("we"))
    j = intervals.overlaps(w, gene(spark, sf).select("cid", "gstart", "gend"), ["cid"], ("ws", "we"), ("gstart", "gend"))
    return j.groupBy("gene_id").agg(F.min("gstart").alias("ext_start"), F.max("gend").alias("ext_end"), F.count("*").alias("touched"))


@query("SRT07 SRT08 WIN14", f"""
WITH {GENE_SQL} SELECT cid, gene_id, gscore, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY cid ORDER BY gscore DESC, gene_id) AS r FROM gene) WHERE r <= 4""")
def rec_top_paralogs(spark, sf):
    w = Window.partitionBy("cid").orderBy(F.desc("gscore"), "gene_id")
    return gene(spark, sf).withColumn("place", F.row_number().over(w).cast("long")).filter("place <= 4").select("cid", "gene_id", "gscore", "place")


@query("FLT04 FLT05", f"WITH {GENE_SQL} SELECT gene_id, gscore, rlen FROM gene WHERE gscore >= 35 AND rlen >= 90")
def rec_score_and_length(spark, sf):
    return gene(spark, sf).filter("gscore >= 35 and rlen >= 90").select("gene_id", "gscore", "rlen")


@query("AGG20", f"""
WITH {GENE_SQL} SELECT strand, CAST(floor(10 * (gstart % 1000) / 1000) AS BIGINT) AS decile, count(*) AS genes, count(DISTINCT cid) AS chroms FROM gene GROUP BY 1, 2""")
def rec_decile_summary(spark, sf):
    return gene(spark, sf).groupBy("strand", F.floor(10 * (F.col("gstart") % 1000) / 1000).alias("decile")).agg(F.count("*").alias("genes"), F.count_distinct("cid").alias("chroms"))


@query("FLT10 JON10", f"""
WITH {GENE_SQL}, s AS (SELECT cid, strand, gene_id, gstart, gend, lead(gene_id) OVER w AS next_gene, lead(gstart) OVER w AS next_start FROM gene WINDOW w AS (PARTITION BY cid, strand ORDER BY gstart, gend, gene_id))
SELECT gene_id, next_gene, gend + 1 AS gap_from, next_start - 1 AS gap_to FROM s WHERE next_start > gend + 1 AND next_start - gend <= 2000""")
def halfgene_stitch(spark, sf):
    """The gap between neighbours on a strand, to be searched again."""
    w = Window.partitionBy("cid", "strand").orderBy("gstart", "gend", "gene_id")
    s = gene(spark, sf).withColumns({"next_gene": F.lead("gene_id").over(w), "next_start": F.lead("gstart").over(w)})
    return s.filter("next_start > gend + 1 and next_start - gend <= 2000").select("gene_id", "next_gene", (F.col("gend") + 1).alias("gap_from"), (F.col("next_start") - 1).alias("gap_to"))
