"""Document fingerprints: a Merkle tree over sections and paragraphs, with DataFrame functions alone.

A text's lines are its paragraphs; a paragraph's leaves are its pieces (parts of sentences, at most 48 code points); a
section is a run of paragraphs, closed after one whose hash ends with a chosen digit, so that an edit moves no far
boundary. A node is the hash of its children. The fingerprint is the tree: the root (SHA-256 over the sections' own
SHA-256) and below it each section with its paragraphs and their pieces, all hashes shortened:

    root/section:paragraph=piece.piece,paragraph=piece/section:...

Equal texts have equal roots and fingerprints, and different texts differ in their roots. Likeness is read from two
fingerprints alone. Equal roots give 1. Else sections that both have count with all their pieces; of the other sections,
paragraphs that both have; only inside the others are pieces compared. It is the share of pieces in common of all found.
``edits`` locates changed paragraphs by descending in the same way.

Defined cases: a null text is empty; two empty texts have likeness 1, an empty and another 0; ids in ascending order,
null ids last, equal ids by their text's hash; equal rows are each returned; one row alone is followed by itself; an
empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fraction, read

#: Rows of a range of ids, wanted; ranges at most; sampled rows a range.
RANGE_ROWS, MOST_RANGES, SAMPLED = 1024, 50_000, 20
#: The last digit of a paragraph's hash that closes a section.
CLOSER = "0"
PIECE = r"[^.!?\n]{1,48}[.!?]*|[.!?\n]+"
#: Hexadecimal digits that are left of a section's or paragraph's hash, and of a piece's.
NODE, LEAF = 16, 8


def _paragraph(p: Column) -> Column:
    """hash (whole), line: ``hash=piece.piece`` of a paragraph's text."""
    whole = F.sha2(p, 256)
    pieces = F.transform(F.regexp_extract_all(p, F.lit(PIECE), F.lit(0)), lambda x: F.right(F.lpad(F.hex(F.xxhash64(x)), 16, "0"), F.lit(LEAF)))
    return F.struct(whole.alias("hash"), F.concat(F.left(whole, F.lit(NODE)), F.lit("="), F.array_join(pieces, ".")).alias("line"))


def tree(text: Column) -> Column:
    """The sections: hash (of its paragraphs' whole hashes), line ``hash:paragraph,paragraph``."""
    paragraphs = F.transform(F.split(text, "\n"), _paragraph)
    # Sections as strings: each paragraph is its whole hash and its line; "/" closes a section.
    closed = F.transform(paragraphs, lambda p: F.concat(p["hash"], F.lit(","), p["line"], F.when(F.endswith(p["hash"], F.lit(CLOSER)), F.lit("/")).otherwise(F.lit(";"))))
    parts = F.array_remove(F.split(F.array_join(closed, ""), "/"), "")

    def section(s: Column) -> Column:
        own = F.array_remove(F.split(s, ";"), "")
        whole = F.sha2(F.array_join(F.transform(own, lambda x: F.left(x, F.lit(64))), ""), 256)
        return F.struct(whole.alias("hash"), F.concat(F.left(whole, F.lit(NODE)), F.lit(":"), F.array_join(F.transform(own, lambda x: F.substr(x, F.lit(66))), ",")).alias("line"))

    return F.transform(parts, section)


def fingerprint(sections: Column) -> Column:
    """The fingerprint of a tree."""
    root = F.sha2(F.array_join(F.transform(sections, lambda s: s["hash"]), ""), 256)
    return F.concat(root, F.lit("/"), F.array_join(F.transform(sections, lambda s: s["line"]), "/"))


def _sections(print_: Column) -> Column:
    """The distinct sections of a fingerprint, as lines."""
    return F.array_distinct(F.slice(F.split(print_, "/"), F.lit(2), F.size(F.split(print_, "/"))))


def _below(lines: Column, mark: str, between: str) -> Column:
    """The distinct children of nodes ``hash<mark>child<between>child``."""
    return F.array_distinct(F.array_remove(F.flatten(F.transform(lines, lambda s: F.split(F.substring_index(s, mark, -1), between))), ""))


def _leaves(lines: Column) -> Column:
    """How many pieces there are under nodes; an empty paragraph counts as one."""
    each = lambda s: F.length(s) - F.length(F.translate(s, ".=", ""))  # noqa: E731  a "=" a paragraph, a "." between pieces
    return F.aggregate(lines, F.lit(0), lambda n, s: n + each(s))


def likeness(a: Column, b: Column, df: DataFrame, out: str) -> DataFrame:
    """``df`` with ``out``, the likeness of the fingerprints ``a`` and ``b``: a column for each level, so that each is made once."""
    n = lambda x: f"_{out}_{x}"
    df = df.withColumns({n("a"): _sections(a), n("b"): _sections(b)})
    levels = []
    for mark, between in ((":", ","), ("=", r"\.")):
        x, y = F.col(n("a")), F.col(n("b"))
        df = df.withColumn(n(f"same{len(levels)}"), _leaves(F.array_intersect(x, y)))
        df = df.withColumns({n("a2"): F.array_except(x, y), n("b2"): F.array_except(y, x)})
        df = df.withColumns({n("a"): _below(F.col(n("a2")), mark, between), n("b"): _below(F.col(n("b2")), mark, between)})
        levels.append(n(f"same{len(levels)}"))
    both = F.size(F.array_intersect(n("a"), n("b"))).alias("both")
    df = df.withColumn(n("both"), both)
    same = F.col(levels[0]) + F.col(levels[1]) + F.col(n("both"))
    either = same + F.size(n("a")) + F.size(n("b")) - 2 * F.col(n("both"))
    found = F.when(F.left(a, F.lit(64)) == F.left(b, F.lit(64)), F.lit(1.0)).when(either == 0, F.lit(0.0)).otherwise(same / either)
    return df.withColumn(out, found).drop(n("a"), n("b"), n("a2"), n("b2"), n("both"), *levels)


def edits(df: DataFrame, text: str, other: str) -> DataFrame:
    """``df`` with ``edited_paragraphs``: the places, from 0, of the paragraphs of ``text`` in sections that the tree of
    ``other`` lacks and that are not in a section of it either."""
    mine, theirs = (fingerprint(tree(F.coalesce(F.col(c), F.lit("")))) for c in (text, other))
    lines = lambda s: F.split(F.substring_index(s, ":", -1), ",")
    places = F.flatten(F.transform(F.slice(F.split(mine, "/"), 2, 1 << 30), lambda s: F.transform(lines(s), lambda p: F.struct(s.alias("s"), p.alias("p")))))
    same = F.left(mine, F.lit(64)) == F.left(theirs, F.lit(64))
    found = df.withColumns({"_places": places, "_theirs": _sections(theirs)}).withColumn("_paragraphs", F.array_distinct(F.flatten(F.transform("_theirs", lines))))
    lacking = lambda x: ~F.array_contains("_theirs", x["s"]) & ~F.array_contains("_paragraphs", x["p"])
    numbered = F.filter(F.transform("_places", lambda x, i: F.when(lacking(x), i)), lambda i: i.isNotNull())
    return found.withColumn("edited_paragraphs", F.when(same, F.array().cast("array<int>")).otherwise(numbered)).drop("_places", "_theirs", "_paragraphs")


def followed(docs: DataFrame) -> DataFrame:
    """doc_id, text, next_text for each row. Texts cross the network once: ranges of (id, hash) begin at sampled rows, and
    each range's first row is also sent to the range before, as what its last row is followed by."""
    at = F.struct(F.col("doc_id").isNull().alias("n"), F.coalesce("doc_id", F.lit(0)).alias("i"), F.col("_hash").alias("h"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // RANGE_ROWS))
    keys = rows.select(at.alias("at"))
    found = {tuple(r["at"]) for r in keys.filter(fraction("at.i", "at.h", F.lit("range")) < min(1.0, ranges * SAMPLED / max(n, 1))).distinct().limit(4 * ranges * SAMPLED).collect()}
    least = keys.agg(F.min("at").alias("at")).first()["at"]
    found = sorted(found)
    starts = sorted({found[i * len(found) // ranges] for i in range(ranges)} if found else set()) if ranges > 1 else []
    starts = sorted({*starts, *([] if least is None else [tuple(least)])})
    last = max(0, len(starts) - 1)
    # One literal for all starts: a plan with a node for each would take minutes.
    listed = json.dumps([{"n": a, "i": b, "h": c} for a, b, c in starts])
    steps = F.from_json(F.lit(listed), "array<struct<n:boolean,i:bigint,h:bigint>>")
    placed = rows.withColumn("_own", _range_of(steps, at, len(starts)) if starts else F.lit(0))
    placed = placed.withColumn("_head", F.get(steps, F.col("_own")) == at if starts else F.lit(False))
    before = F.when(F.col("_own") == 0, F.lit(last)).otherwise(F.col("_own") - 1)
    own, ghost = F.struct(F.col("_own").alias("range"), F.lit(0).alias("ghost")), F.struct(before.alias("range"), F.lit(1).alias("ghost"))
    placed = placed.withColumn("_at", F.explode(F.when(F.col("_head"), F.array(own, ghost)).otherwise(F.array(own))))
    order = Window.partitionBy("_range").orderBy("_ghost", F.col("doc_id").asc_nulls_last(), "_hash")
    placed = placed.select("doc_id", "text", F.col("_at.range").alias("_range"), F.col("_at.ghost").alias("_ghost"), "_hash")
    return placed.withColumn("next_text", F.lead("text").over(order)).filter("_ghost = 0").select("doc_id", "text", "next_text")


def _range_of(steps: Column, at: Column, n: int) -> Column:
    """The number of the last step that isn't above ``at``: steps are found by halves."""
    middle = lambda s: F.floor((s["low"] + s["high"]) / 2).cast("int")

    def halve(s: Column, _: Column) -> Column:
        go, above = s["high"] - s["low"] > 1, F.get(steps, middle(s)) > at
        return F.struct(F.when(go & ~above, middle(s)).otherwise(s["low"]).alias("low"), F.when(go & above, middle(s)).otherwise(s["high"]).alias("high"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(n.bit_length())), F.struct(F.lit(0).alias("low"), F.lit(n).alias("high")), halve)["low"]


def fingerprints(docs: DataFrame) -> DataFrame:
    """The contract's row for every row of ``docs``."""
    pairs = followed(docs)
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    pairs = pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.col("next_text"), F.lit(1), half)))
    pairs = pairs.withColumns({"_own": tree(F.col("text")), "_edited": tree(F.col("edited")), "_next": tree(F.col("next_text")), "edited_sha256": F.sha2("edited", 256)})
    pairs = pairs.select("doc_id", "n_chars", "edited_sha256", *[fingerprint(F.col(c)).alias(o) for c, o in (("_own", "fingerprint"), ("_edited", "edited_fingerprint"), ("_next", "_next"))])
    pairs = likeness(F.col("fingerprint"), F.col("edited_fingerprint"), pairs, "near_edited")
    pairs = likeness(F.col("fingerprint"), F.col("_next"), pairs, "near_next")
    return pairs.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def op4_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read(spark, sf_dir, "documents"))
