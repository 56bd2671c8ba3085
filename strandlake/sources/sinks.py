"""Sinks: records as parquet, reports as text, several at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What to do with what is there already.
POLICY = {"ask": "error", "never": "ignore", "always": "overwrite"}


def write_records(genes: DataFrame, exons: DataFrame, names: DataFrame, folder: str, policy: str = "ask") -> None:
    """The three record tables; genes and exons by chromosome, so that batches of chromosomes are partitions."""
    genes.write.mode(POLICY[policy]).partitionBy("cid").parquet(f"{folder}/gene_record")
    exons.write.mode(POLICY[policy]).partitionBy("cid").parquet(f"{folder}/exon_record")
    names.write.mode(POLICY[policy]).parquet(f"{folder}/query_name")


def write_lines(lines: DataFrame, path: str, order: list[str], policy: str = "ask", gzip: bool = False) -> None:
    """A report's lines in order."""
    out = lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line")
    out.write.mode(POLICY[policy]).option("compression", "gzip" if gzip else "none").text(path)


def fan_out(reports: Mapping[int, DataFrame], prefix: str, order: list[str], policy: str = "ask") -> list[str]:
    """Several reports of the same records, each once: ``prefix.O<mode>``."""
    paths = []
    for mode, lines in sorted(reports.items()):
        write_lines(lines, path := f"{prefix}.O{mode & 15}", order, policy)
        paths.append(path)
    return paths


def write_word_index(words: DataFrame, folder: str, policy: str = "ask", block: int = 256) -> None:
    """(doc_id, p, word) as blocks of each word and how many blocks each has."""
    index = words.select("word", "doc_id", F.floor(F.col("p") / block).alias("block")).distinct()
    index.write.mode(POLICY[policy]).parquet(f"{folder}/kmer_index")
    index.groupBy("word").agg(F.count("*").alias("nblk")).write.mode(POLICY[policy]).parquet(f"{folder}/kmer_stats")
