"""Sequence, gene, exon and intron views over the driver's tables, and the same as SQL fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace(F.lower("text"), "[^acgt]", "").alias("dna"))


def prot(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = F.regexp_replace("text", "[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]", "")
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.upper(kept).alias("prot"))


def exon(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")
    x = lines.select(
        F.col("l_orderkey").alias("gene_id"), F.row_number().over(order).cast("long").alias("exon_no"),
        (F.floor("l_quantity") * 3).alias("elen"), (F.col("l_partkey") % 97 + 20).alias("ilen"), (F.col("l_suppkey") % 5).alias("mmc"),
    )
    before = Window.partitionBy("gene_id").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("off", F.coalesce(F.sum(F.col("elen") + F.col("ilen")).over(before), F.lit(0)))
    head = orders.select(
        F.col("o_orderkey").alias("gene_id"), (F.col("o_custkey") % 24).alias("cid"),
        F.when(F.col("o_orderstatus") == "F", "-").otherwise("+").alias("strand"), F.floor("o_totalprice").alias("gstart"),
    )
    return x.join(head, "gene_id").select(
        "gene_id", "exon_no", "cid", "strand", "elen", "ilen", "mmc",
        (F.col("gstart") + F.col("off")).alias("gleft"), (F.col("gstart") + F.col("off") + F.col("elen") - 1).alias("gright"),
    )


def gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exon(spark, sf_dir).groupBy("gene_id", "cid", "strand").agg(
        F.min("gleft").alias("gstart"), F.max("gright").alias("gend"), F.count("*").alias("nexn"), F.sum("mmc").alias("mmc"), F.sum("elen").alias("rlen")
    )
    return found.withColumns(
        {
            "bmmc": F.col("mmc") % 7, "bunp": F.col("nexn") % 4, "ng": F.col("mmc") % 4, "gscore": F.floor(F.col("rlen") / 4).cast("double"),
            "pmatch": (100 - F.col("gene_id") % 30).cast("double"), "pcover": (100 - F.col("rlen") % 20).cast("double"),
        }
    )


def intron(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Between consecutive exons: donor is the next base after an exon, acceptor the last before the next one."""
    order = Window.partitionBy("gene_id").orderBy("exon_no")
    x = exon(spark, sf_dir).withColumns(
        {"nleft": F.lead("gleft").over(order), "nmmc": F.lead("mmc").over(order), "cds": F.sum("elen").over(order.rowsBetween(Window.unboundedPreceding, 0))}
    )
    ends = F.element_at(F.array(*[F.lit(e) for e in ENDS]), (F.col("ilen") % len(ENDS) + 1).cast("int"))
    return x.filter("nleft is not null").select(
        "gene_id", F.col("exon_no").alias("intron_no"), "cid", "strand", (F.col("gright") + 1).alias("donor"), (F.col("nleft") - 1).alias("acceptor"),
        (F.col("nleft") - F.col("gright") - 1).alias("ilen"), (F.col("cds") % 3).alias("phase"), F.col("mmc").alias("mmc5"), F.col("nmmc").alias("mmc3"), (F.col("elen") - F.col("mmc")).alias("mch"), ends.alias("ends"),
    )


#: Four letters at an intron's two ends, dealt by its length.
ENDS = ("GTAG", "GTAG", "GCAG", "GTAG", "ATAC", "ATAA", "GTAG", "GTTG", "CTAC", "GGAG", "ATAG")

DNA_SQL = "dna AS (SELECT doc_id, lang, regexp_replace(lower(text), '[^acgt]', '', 'g') AS dna FROM documents)"
PROT_SQL = "prot AS (SELECT doc_id, lang, upper(regexp_replace(text, '[^ACDEFGHIKLMNPQRSTVWYacdefghiklmnpqrstvwy]', '', 'g')) AS prot FROM documents)"
EXON_SQL = """
x0 AS (
  SELECT l_orderkey AS gene_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS exon_no,
         CAST(floor(l_quantity) AS BIGINT) * 3 AS elen, 20 + CAST(l_partkey % 97 AS BIGINT) AS ilen, CAST(l_suppkey % 5 AS BIGINT) AS mmc
  FROM lineitem),
x1 AS (
  SELECT x0.*, CAST(o_custkey % 24 AS BIGINT) AS cid, CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '+' END AS strand, CAST(floor(o_totalprice) AS BIGINT) AS gstart,
         coalesce(sum(elen + ilen) OVER (PARTITION BY gene_id ORDER BY exon_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off
  FROM x0 JOIN orders ON o_orderkey = gene_id),
exon AS (SELECT gene_id, exon_no, cid, strand, elen, ilen, mmc, CAST(gstart + off AS BIGINT) AS gleft, CAST(gstart + off + elen - 1 AS BIGINT) AS gright FROM x1)"""
GENE_SQL = EXON_SQL + """,
g0 AS (SELECT gene_id, cid, strand, min(gleft) AS gstart, max(gright) AS gend, count(*) AS nexn, CAST(sum(mmc) AS BIGINT) AS mmc, CAST(sum(elen) AS BIGINT) AS rlen FROM exon GROUP BY gene_id, cid, strand),
gene AS (SELECT *, mmc % 7 AS bmmc, nexn % 4 AS bunp, mmc % 4 AS ng, CAST(floor(rlen / 4) AS DOUBLE) AS gscore, CAST(100 - gene_id % 30 AS DOUBLE) AS pmatch, CAST(100 - rlen % 20 AS DOUBLE) AS pcover FROM g0)"""
INTRON_SQL = GENE_SQL + f""",
i0 AS (SELECT *, lead(gleft) OVER w AS nleft, lead(mmc) OVER w AS nmmc, sum(elen) OVER (PARTITION BY gene_id ORDER BY exon_no ROWS UNBOUNDED PRECEDING) AS cds FROM exon WINDOW w AS (PARTITION BY gene_id ORDER BY exon_no)),
intron AS (SELECT gene_id, exon_no AS intron_no, cid, strand, gright + 1 AS donor, nleft - 1 AS acceptor, nleft - gright - 1 AS ilen, CAST(cds % 3 AS BIGINT) AS phase, mmc AS mmc5, nmmc AS mmc3, elen - mmc AS mch,
  {list(ENDS)}[1 + (ilen % {len(ENDS)})] AS ends FROM i0 WHERE nleft IS NOT NULL)"""
