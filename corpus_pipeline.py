"""From raw documents to packed training sequences, a stage after the other.

Defined cases, for every stage: an empty table gives an empty one; columns of any name pass through, extra ones included,
in all stages but the last, which returns pieces. Null and empty texts have no language and go in the first stage; a
stage called by itself keeps them (near_dedup, passage_dedup), drops them (source_mix: they have no words to take) or
packs their closing id alone (packing). Rows with a null id are no one's copy and stay. Repeated rows are one group for
near_dedup and equal documents for the mix. A null source is a source. Very long texts go whole through every stage.
The near-duplicate stage works on shingles of five words (the query op6 on four) at a similarity of 0.8.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm import op3_mixing, op6_minhash, op7_passages, op9_packing, op10_langid
from strandlake.llm.common import cut, read


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (no text, no letter) go; the others' ``lang`` becomes the identified language, by which
    they are packed. Its label, where there was one, has been learned from."""
    return op10_langid.keep_known(docs, op10_langid.language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the least id."""
    return op6_minhash.keep_one(docs)


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A repeated passage stays in the document with the least id alone."""
    return op7_passages.remove_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them, in the order of its schedule."""
    return op3_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences, each of one language."""
    return op9_packing.packed(docs, within="lang" if "lang" in docs.columns else None)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

#: Hashes, models and tokenisers aren't SQL; tests hold each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
