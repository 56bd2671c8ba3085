"""Sequence files, parameter tables and layered settings."""

from __future__ import annotations

import re
from collections.abc import Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: How entries of each format begin, and where their residues are.
FORMATS = {
    "fasta": (r"^>", r"^>(\S*)[^\n]*", r"^>[^\n]*\n?|^;[^\n]*\n?|[^A-Za-z*-]"),
    "genbank": (r"^LOCUS ", r"^LOCUS +(\S+)", r"(?s)^.*?\nORIGIN[^\n]*\n|[^A-Za-z*-]"),
    "embl": (r"^ID   ", r"^ID   ([^; ]+)", r"(?s)^.*?\nSQ   [^\n]*\n|[^A-Za-z*-]"),
    "swiss": (r"^ID   ", r"^ID   ([^; ]+)", r"(?s)^.*?\nSQ   [^\n]*\n|[^A-Za-z*-]"),
    "pir": (r"^>[A-Z][A-Z0-9];", r"^>[A-Z][A-Z0-9];(\S+)", r"^>[^\n]*\n[^\n]*\n?|[^A-Za-z-]"),
}
_SPLIT = {"fasta": "\n>", "pir": "\n>", "genbank": "\n//", "embl": "\n//", "swiss": "\n//"}


def sniff(first_line: str) -> str:
    """The format that the first line that isn't a comment shows."""
    for name, begins in (("pir", r"^>[A-Z][A-Z0-9];"), ("fasta", "^>"), ("genbank", "^LOCUS "), ("embl", "^ID   "), ("nexus", "^#NEXUS"), ("msf", r"^!!|.* MSF:"), ("nbrf", "^ENTRY ")):
        if re.match(begins, first_line):
            return name
    return "bare"


def sequences(spark: SparkSession, path: str, kind: str = "fasta") -> DataFrame:
    """name, residues of every entry of the files at ``path`` (gzip too), one record an entry however many lines it has."""
    _, name, drop = FORMATS[kind]
    rows = spark.read.option("lineSep", _SPLIT[kind]).text(path)
    text = F.regexp_replace("value", r"^\s+", "")
    if kind in ("fasta", "pir"):
        text = F.when(text.startswith(">"), text).otherwise(F.concat(F.lit(">"), text))
    entry = rows.select(text.alias("t")).filter(F.length(F.regexp_replace("t", r"[>\s]", "")) > 0)
    return entry.select(F.regexp_extract("t", name, 1).alias("name"), F.regexp_replace("t", "(?m)" + drop, "").alias("residues")).filter("name <> ''")


def build(sequences: DataFrame, table: str, buckets: int = 16) -> None:
    """A database of sequences: bucketed and sorted by name, so that lookups and joins by name need no shuffle."""
    sequences.write.bucketBy(buckets, "name").sortBy("name").mode("overwrite").saveAsTable(table)


def word_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="word string, n long", comment="#")


def length_histogram(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep=" ", schema="len long, frq long", comment="#")


def substitution_matrix(spark: SparkSession, path: str) -> DataFrame:
    """a, b, score of a matrix in the usual layout: a line of letters, then a line for each."""
    lines = spark.read.text(path).filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
    cells = lines.select(F.split(F.trim("value"), r"\s+").alias("c"))
    head = cells.filter(F.size("c") == F.length(F.array_join("c", ""))).select(F.col("c").alias("letters"))  # one line
    body = cells.filter(F.size("c") > 1).filter(F.element_at("c", 2).rlike("^-?[0-9]"))
    j = body.join(F.broadcast(head.limit(1)))
    each = j.select(F.element_at("c", 1).alias("a"), F.explode(F.arrays_zip("letters", F.slice("c", 2, 64).alias("score"))).alias("x"))
    return each.select("a", F.col("x.letters").alias("b"), F.col("x.score").cast("double").alias("score")).filter("b is not null and score is not null")


def setting(name: str, *layers: Mapping[str, str] | str | Path, default: str | None = None) -> str | None:
    """The first value of ``name``: layers are mappings or parameter files of ``-name value`` words, nearest first."""
    for layer in layers:
        found = layer if isinstance(layer, Mapping) else parameters(layer)
        if name in found:
            return found[name]
    return default


def parameters(path: str | Path) -> dict[str, str]:
    words = Path(path).read_text(encoding="utf-8").split() if Path(path).exists() else []
    out = {}
    for i, w in enumerate(words):
        if w.startswith("-") and len(w) > 1 and not w[1].isdigit():
            out[w.lstrip("-")] = words[i + 1] if i + 1 < len(words) and not words[i + 1].startswith("-") else ""
    return out


def size(text: str) -> int:
    """A number with k, M or G (powers of 1024)."""
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([kKmMgG]?)\s*", text)
    if not m:
        raise ValueError(f"not a size: {text!r}")
    return int(float(m[1]) * 1024 ** " kmg".index(m[2].lower() or " "))
