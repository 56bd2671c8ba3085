"""Gene, exon and intron records: filters, loci, best and unique records, and report lines."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import loci


@dataclass(frozen=True)
class RecordFilter:
    bmmc: int
    bunp: int
    canonical: int
    exon_bmmc: int
    exon_bunp: int
    ng: int
    score: float
    match: float
    cover: float


# Filter presets.
PRESETS = {
    "mild": RecordFilter(5, 3, 2, 10, 6, 3, 35, 75, 75),
    "medium": RecordFilter(3, 2, 1, 6, 4, 2, 35, 93, 93),
    "stringent": RecordFilter(1, 1, 0, 2, 2, 1, 35, 97, 97),
}
# Canonical ends.
CANONICAL = ("GTAG", "GCAG", "ATAC")


def passing(genes: DataFrame, f: RecordFilter) -> DataFrame:
    return genes.filter((F.col("pmatch") >= f.match) & (F.col("pcover") >= f.cover) & (F.col("gscore") >= f.score) & (F.col("bmmc") <= f.bmmc) & (F.col("bunp") <= f.bunp) & (F.col("ng") <= f.ng))


def canonical(ends: Column, level: int) -> Column:
    """0: one of three ends; 1: AT-AN too; 2: at most one letter from GTAG too; 3: any."""
    if level >= 3:
        return F.lit(True)
    found = ends.isin(*CANONICAL)
    if level >= 1:
        found = found | ends.startswith("ATA")
    if level >= 2:
        found = found | (sum(((F.substring(ends, i, 1) != c).cast("int") for i, c in enumerate("GTAG", 1)), F.lit(0)) <= 1)
    return found


def gene_loci(genes: DataFrame) -> DataFrame:
    return loci(genes, ["cid", "strand"], "gstart", "gend", ["nexn", "gene_id"])


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row of each group, the first in the given order: a partial maximum, no sort of whole groups."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_r"))).alias("_m")).select(*keys, *[F.col(f"_m._r.{c}").alias(c) for c in rest])


def gff3(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """gene_id, line_no, line: gene, mRNA and coding lines with their phases."""
    tail = F.concat_ws("\t", F.concat(F.lit("chr"), "cid"), F.lit("est"))
    g = genes.select("gene_id", F.explode(F.array(
        F.struct(F.lit(-2).cast("long").alias("line_no"), F.concat_ws("\t", tail, F.lit("gene"), "gstart", "gend", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=gene"), "gene_id")).alias("line")),
        F.struct(F.lit(-1).cast("long").alias("line_no"), F.concat_ws("\t", tail, F.lit("mRNA"), "gstart", "gend", F.lit("."), "strand", F.lit("."), F.concat(F.lit("ID=mRNA"), "gene_id", F.lit(";Parent=gene"), "gene_id")).alias("line")),
    )).alias("x")).select("gene_id", "x.*")
    before = Window.partitionBy("gene_id").orderBy("exon_no").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.sum("elen").over(before), F.lit(0))
    e = exons.select("gene_id", F.col("exon_no").alias("line_no"), F.concat_ws("\t", tail, F.lit("cds"), "gleft", "gright", F.lit("."), "strand", ((3 - done % 3) % 3).cast("string"), F.concat(F.lit("ID=cds"), "gene_id", F.lit("."), "exon_no", F.lit(";Parent=mRNA"), "gene_id")).alias("line"))
    return g.union(e)


def bed12(genes: DataFrame, exons: DataFrame) -> DataFrame:
    blocks = exons.groupBy("gene_id").agg(F.array_sort(F.collect_list(F.struct("gleft", "elen"))).alias("b"))
    j = genes.join(blocks, "gene_id")
    sizes, starts = F.array_join(F.transform("b", lambda x: x["elen"].cast("string")), ","), F.array_join(F.transform("b", lambda x: (x["gleft"] - F.col("gstart")).cast("string")), ",")
    score = F.least(F.lit(1000), F.floor(F.col("pcover") * 10)).cast("long")
    return j.select("gene_id", F.concat_ws("\t", F.concat(F.lit("chr"), "cid"), (F.col("gstart") - 1).cast("string"), "gend", F.concat(F.lit("gene"), "gene_id"), score.cast("string"), "strand", (F.col("gstart") - 1).cast("string"), "gend", F.lit("0"), F.col("nexn").cast("string"), sizes, starts).alias("line"))
