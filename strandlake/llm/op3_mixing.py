"""Mixing sources to target weights by a low-discrepancy schedule.

Slot i of the mix is the golden-ratio point frac(i * phi); through the cumulative targets it falls to one source, and
its rank among that source's slots is the number of the block that it takes: a source's documents are shuffled, laid end
to end and round again, and cut into blocks of equal numbers of words. Slots and blocks are joined by source and rank. A
document takes the words of its blocks that a slot has asked for, and its place in the mix is its first such slot. So a
source's words are spread evenly at any length of the mix, and a source takes its target to within a few blocks.

Defined cases: a null source is a source, after all others; a null text has size 0; documents of size 0 are kept and
take nothing; an empty table gives no row; repeated rows are documents of their own; with all sizes 0 all targets are 0;
columns of any name may stand beside those that are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACED_WORD, carried, cut, discard, fraction, prefixes, read, running_total, tasks

#: Words of a slot; times that a source may be taken at most; the sources' weights in turn.
BLOCK, MOST_TIMES, WEIGHTS = 16, 3, (5, 2, 1)
#: Sources that may be broadcast; slots counted together.
BROADCAST_SOURCES, RUN = 20_000, 1 << 16
#: Targets are laid end to end on a line of this length.
LINE = 1 << 52
#: The golden ratio's fraction, and that of 2**20 times it: both parts of i keep their precision.
PHI, PHI_HIGH = 0.6180339887498949, 0.6180339887498949 * (1 << 20) % 1


def words_in(text: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACED_WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    hashed = F.xxhash64("text")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", words_in("text").alias("size"), hashed.alias("text_hash"), fraction(F.col("doc_id"), hashed, F.lit("shuffle")).alias("_at"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_TIMES) -> DataFrame:
    """source, source_size, no (its number in code point order), target: shares by weight of all words; what is over
    ``most`` times a source's size is reshared.

    The resharing ends where target = min(most * size, level * weight) for one level, which rises with each source that
    turns out to be over its limit.
    """
    found = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("_one", F.lit(1))
    found = cut(prefixes(found, [F.col("source").asc_nulls_last()], no="_one").drop("_one"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("no") % len(weights) + 1).cast("int"))
    limit = (F.col("source_size") * most).cast("double")
    whole, level, full = float(found.agg(F.sum("source_size")).first()[0] or 0), 0.0, -1
    while whole:
        over = limit < weight * level
        at_limit, rest, n = found.agg(F.sum(F.when(over, limit)), F.sum(F.when(~over, weight)), F.count(F.when(over, 1))).first()
        if n == full:
            break
        level, full = (whole - (at_limit or 0.0)) / rest, n
    return found.select("source", "source_size", "no", F.least(limit, weight * level).alias("target"))


def point(i: Column) -> Column:
    """frac(i * phi)."""
    low, high = (i % (1 << 20)).cast("double"), F.floor(i / (1 << 20)).cast("double")
    x = low * PHI + (high * PHI_HIGH) % 1.0
    return x - F.floor(x)


def schedule(spark: SparkSession, aims: DataFrame, slots: int) -> DataFrame:
    """slot, no of a mix of ``slots`` slots, for ``aims`` (no, target)."""
    whole, n = aims.agg(F.sum("target"), F.count("*")).first()
    ranges = max(1024, n)
    if not whole:
        return spark.createDataFrame([], "slot long, no long")
    lengths = aims.select("no", F.floor(F.col("target") / whole * LINE).alias("_length"))
    spans = prefixes(lengths, [F.col("no")], _from="_length")
    spans = spans.withColumn("_to", F.when(F.col("no") == n - 1, F.lit(LINE)).otherwise(F.col("_from") + F.col("_length"))).filter("_from < _to")
    spans = spans.withColumn("_range", F.explode(F.sequence(F.floor(F.col("_from") / LINE * ranges), F.floor((F.col("_to") - 1) / LINE * ranges))))
    spans = spans.select("no", "_from", "_to", "_range")
    if n <= BROADCAST_SOURCES:
        spans = F.broadcast(spans)
    drawn = spark.range(slots).select(F.col("id").alias("slot"), F.floor(point(F.col("id")) * LINE).alias("_u"))
    return drawn.withColumn("_range", F.floor(F.col("_u") / LINE * ranges)).join(spans, "_range").filter("_from <= _u and _u < _to").select("slot", "no")


def ranked(slots: DataFrame, run: int = RUN) -> DataFrame:
    """slot, no, rank: its number within its source; counted by runs of slots, so that no source is one task's."""
    runs = slots.withColumn("_run", F.floor(F.col("slot") / run))
    counts = runs.groupBy("no", "_run").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("no").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("no", "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("no", "_run").orderBy("slot")) - 1
    return runs.withColumn("_inside", inside).join(starts, ["no", "_run"]).select("slot", "no", (F.col("_start") + F.col("_inside")).alias("rank"))


def mixed(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row a document: doc_id, source, text_hash, size, source_size, target, taken; copies: (slot, words) of each round in which it's taken."""
    sized = cut(sizes(docs))
    aims = cut(targets(sized))
    spark = docs.sparkSession
    words = aims.agg(F.sum("source_size")).first()[0] or 0
    slots = cut(ranked(schedule(spark, aims, -(-words // block))))
    drawn = slots.groupBy("no").agg(F.count("*").alias("_slots"))
    asked = F.least(F.coalesce("_slots", F.lit(0)) * block, F.col("source_size") * MOST_TIMES)
    of = aims.join(drawn, "no", "left").select(F.col("source").alias("_source"), "no", "source_size", "target", asked.alias("_asked"))
    if aims.count() <= BROADCAST_SOURCES:
        of = F.broadcast(of)
    laid = running_total(sized, "source", "_at", "size", "first", ["doc_id", "size"])
    laid = cut(laid.join(of, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "_at"))
    # Blocks: what each round of a document has of each run of ``block`` words.
    rounds = F.sequence(F.lit(0), F.ceil(F.col("_asked") / F.col("source_size")).cast("int") - 1)
    blocks = laid.filter("size > 0 and _asked > 0").select("no", "first", "size", "_asked", "source_size", F.explode(rounds).alias("_round"))
    begin = F.col("_round") * F.col("source_size") + F.col("first")
    blocks = blocks.select("no", "first", "_round", begin.alias("_begin"), F.least(begin + F.col("size"), "_asked").alias("_end")).filter("_begin < _end")
    blocks = blocks.withColumn("rank", F.explode(F.sequence(F.floor(F.col("_begin") / block), F.floor((F.col("_end") - 1) / block))))
    met = blocks.join(slots, ["no", "rank"])
    had = F.least(F.col("_end"), (F.col("rank") + 1) * block) - F.greatest(F.col("_begin"), F.col("rank") * block)
    by_round = [(F.col("_round") == r) for r in range(MOST_TIMES)]
    copies = [F.struct(F.min(F.when(c, F.col("slot"))).alias("slot"), F.sum(F.when(c, had)).alias("words")) for c in by_round]
    taken = met.groupBy("no", "first").agg(F.sum(had).alias("taken"), F.filter(F.array(*copies), lambda c: c["words"] > 0).alias("copies"))
    # A source's documents that have words begin at places of their own.
    key = [F.col("no"), F.when(F.col("size") > 0, F.col("first"))]
    placed = laid.withColumns({"_no": key[0], "_first": key[1]}).drop("no", "first")
    out = placed.join(taken, (F.col("_no") == F.col("no")) & (F.col("_first") == F.col("first")), "left")
    none = F.array().cast("array<struct<slot:bigint,words:bigint>>")
    discard(sized)
    return out.select("doc_id", "source", "text_hash", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", none).alias("copies"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents, with the columns of ``docs``, in the order of the schedule: whole rounds as copies, then the
    first words of one more.

    ``n_chars``, where there is one, is the length of the text that is left.
    """
    plan = cut(mixed(docs.select("doc_id", "source", "text")).filter("taken > 0"))
    slots = (plan.agg(F.max(F.element_at(F.transform("copies", lambda c: c["slot"]), -1))).first()[0] or 0) + 1
    # Equal rows share what they take, in the order of its size.
    same = ["doc_id", "text_hash", "source"]
    plan = plan.groupBy(*same, "size").agg(F.collect_list("copies").alias("_all"))
    rows = carried(docs, F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_hash"), F.col("source").alias("_source"), F.col("text").alias("_text"))
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("_id", "_hash", "_source").orderBy("_hash")))
    joined = rows.join(plan, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_hash") == F.col("text_hash")) & F.col("_source").eqNullSafe(F.col("source")))
    each = joined.select("_row", "_text", "size", F.inline(F.element_at(F.array_sort("_all"), F.col("_nth"))))
    # Words with the white space after them: a repeated group would recurse as deep as the words are many.
    parts = F.regexp_extract_all("_text", F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    head = F.array_join(F.slice(parts, F.lit(1), F.col("words").cast("int")), "")
    each = each.select("_row", "slot", F.when(F.col("words") == F.col("size"), F.col("_text")).otherwise(head).alias("_new"))
    pieces = tasks(docs.sparkSession, slots * BLOCK, 1 << 20)
    each = each.repartitionById(pieces, F.floor(F.col("slot") / slots * pieces).cast("int")).sortWithinPartitions("slot")
    changed = {"text": F.col("_new")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.char_length("_new"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return each.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
