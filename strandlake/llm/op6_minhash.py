"""Near-duplicate documents by SuperMinHash, banding, verification on whole sets, and union by stars.

1. One pass over the texts: the set of word shingles, its key (128 bits), its SuperMinHash signature, its bands.
   SuperMinHash throws every element once per round into a slot of its own permutation, with a value that grows by
   round, and stops at the round after which no slot can fall: a text with many shingles needs one or two rounds.
2. Equal sets are one representative from here on (the least id).
3. Members of a band's bucket are paired with its first member, pairs are verified on whole sets, links make components.
4. Buckets whose members are still in several components are searched further: the components' least members are paired
   with the bucket's; then members of different components are joined by their rarest shared shingles, which leaves out
   only pairs that their sets' sizes and shingles rule out for sure.
So a group of thousands of copies costs about as many pairs as it has members, and a link is only left untested inside
one component, where it changes nothing.

Defined cases: null and empty texts have no shingles and are linked with nothing; so are rows with a null id (component
null, kept); rows of one id are one node; a very long text has a long set, worked on in pieces; an empty table gives no
row; columns of any name may stand beside those that are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import carried, cut, discard, mixed, read, shingles, slices, word_hashes
from .graph import components

#: Bands and rows of a band. A pair at similarity 0.8 is in no common bucket with probability (1 - 0.8**3)**22 = 1.4e-7.
BANDS, ROWS = 22, 3
#: Rows (two ids and two keys at most, so about 20 MB) that may be broadcast; beyond, both sides are shuffled.
BROADCAST_ROWS = 400_000
#: Bits of a set's parities; the bound they give is sharp for sets that differ in fewer shingles than that.
PARITIES = 2048
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(elements: np.ndarray, slots: int = BANDS * ROWS) -> np.ndarray:
    """The signature of distinct 64-bit elements: per slot the least (round, random) thrown into it, as one number."""
    least = np.full(slots, _TOP, np.uint64)
    for at in range(0, len(elements), 4096):
        part = elements[at : at + 4096]
        rows, order, worst = np.arange(len(part)), None, int(least.max())
        for j in range(slots):
            if worst < j << 40:
                break
            drawn = mixed(part, j + 1)
            value = (drawn >> np.uint64(24)) | np.uint64(j << 40)
            other = j + ((drawn & np.uint64(0xFFFFFF)) * np.uint64(slots - j) >> np.uint64(24)).astype(np.int64)
            if j == 0:
                slot = first = other
            else:
                if order is None:
                    order = np.tile(np.arange(slots, dtype=np.int16), (len(part), 1))
                    order[rows, first] = 0
                slot = order[rows, other].astype(np.int64)
                order[rows, other] = order[:, j]
            np.minimum.at(least, slot, value)
            worst = int(least.max())
    return least


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(BANDS, ROWS)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        out = mixed(out ^ parts[:, r], r + 1)
    return out


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (shingles), key, bands of every row of ``docs``."""

    def run(batches):
        import xxhash

        for batch in batches:
            for first, texts in slices(batch.column("text")):
                n, keys, bits = [], [], []
                for text in texts:
                    own = np.unique(shingles(word_hashes(text), k))
                    n.append(len(own))
                    keys.append(xxhash.xxh3_128_digest(own.tobytes()))
                    bits.append(bands(superminhash(own)).view(np.int64) if len(own) else np.empty(0, np.int64))
                lengths = np.cumsum([0, *map(len, bits)]).astype(np.int32)
                listed = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate(bits)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(texts)), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), listed], ["doc_id", "n", "key", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, key binary, bands array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """key, set (sorted shingles' bytes) of the representatives in ``wanted`` (rep, key)."""

    def run(batches):
        import xxhash

        for batch in batches:
            for first, texts in slices(batch.column("text")):
                own = [np.unique(shingles(word_hashes(t), k)).tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([batch.column("key").slice(first, len(texts)), pa.array([xxhash.xxh3_128_digest(s) for s in own], pa.binary()), pa.array(own, pa.large_binary()).cast(pa.binary())], ["want", "key", "set"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, F.col("doc_id") == F.col("rep")).select("key", "text")
    return texts.mapInArrow(run, "want binary, key binary, set binary").filter("want = key").select("key", "set")


def parities(elements: np.ndarray) -> np.ndarray:
    """For each of PARITIES parts of the hashes whether it has an odd number of distinct ``elements``, as bits of numbers.

    Two sets differ in at least one element wherever a parity differs, so in no fewer than there are such places.
    """
    odd = np.bincount((elements % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _few(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast, if its rows are few enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _verified(library: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, a_key, b, b_key) whose sets in ``library`` are ``percent`` alike or more: a, b."""
    wanted = cut(pairs.select(F.col("a_key").alias("key")).union(pairs.select("b_key")).distinct())
    sets = library.join(_few(wanted), "key", "left_semi")

    def run(batches):
        for batch in batches:
            alike = []
            for x, y in zip(batch.column("a_set").to_pylist(), batch.column("b_set").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                alike.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(alike, pa.bool_()))

    joined = _few(pairs).join(sets.select(F.col("key").alias("a_key"), F.col("set").alias("a_set")), "a_key").drop("a_key")
    joined = joined.join(sets.select(F.col("key").alias("b_key"), F.col("set").alias("b_set")), "b_key").select("a", "b", "a_set", "b_set")
    return joined.mapInArrow(run, "a long, b long")


def _paired(a: str, b: str) -> list:
    """Columns a, a_key, b, b_key of a pair of members, the lesser representative first."""
    first = F.col(f"{a}.rep") < F.col(f"{b}.rep")
    pick = lambda x, y, f: F.when(first, F.col(f"{x}.{f}")).otherwise(F.col(f"{y}.{f}"))
    return [pick(a, b, "rep").alias("a"), pick(a, b, "key").alias("a_key"), pick(b, a, "rep").alias("b"), pick(b, a, "key").alias("b_key")]


def links(docs: DataFrame, marked: DataFrame, k: int, percent: int) -> DataFrame:
    """node, component over the representatives of ``marked`` (sketches of ``docs``) that have a link."""
    alone = marked.filter("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = cut(alone.select("rep", "key", "n", F.explode("bands").alias("band")))
    # Least members and counts meet map-side; a band with most of the rows can be split in the joins.
    firsts = cut(rows.groupBy("band").agg(F.min(F.struct("rep", "key")).alias("f"), F.count("*").alias("_size")).filter("_size > 1").select("band", "f"))
    buckets = cut(rows.join(firsts, "band"))
    discard(rows, firsts)
    first = buckets.select(F.struct("rep", "key").alias("m"), "f").filter("m.rep <> f.rep")
    tested = cut(first.select(*_paired("m", "f")).distinct())
    # The sets of all that are in a bucket with others, fetched once for all rounds.
    shared = cut(buckets.select("rep", "key").distinct())
    library = cut(_sets(docs, _few(shared), k))
    found = cut(_verified(library, tested, percent))
    joined = components(found)
    for further in (_chained, _rest):
        left = cut(buckets.drop("f").join(joined, F.col("rep") == F.col("node"), "left").withColumn("c", F.coalesce("component", "rep")).drop("node", "component"))
        split = left.groupBy("band").agg(F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low <> _high").select("band")
        left = cut(left.join(split, "band", "left_semi"))
        pairs = cut(further(left, library, percent).join(tested.select("a", "b"), ["a", "b"], "left_anti").select("a", "a_key", "b", "b_key"))
        discard(left)
        if pairs.isEmpty():
            continue
        tested = tested.union(pairs)
        found = cut(found.union(_verified(library, pairs, percent)))
        joined = components(found)
    return joined


def _chained(left: DataFrame, library: DataFrame, percent: int) -> DataFrame:
    """The least member of each component in a bucket with the least member of all that isn't in that component's."""
    heads = left.groupBy("band", "c").agg(F.min(F.struct("rep", "key", "n", "c")).alias("m"))
    lead = heads.groupBy("band").agg(F.min("m").alias("o"))
    alike = 100 * F.least("m.n", "o.n") >= percent * F.greatest("m.n", "o.n")
    return heads.join(lead, "band").filter(F.col("m.c") != F.col("o.c")).filter(alike).select(*_paired("m", "o")).distinct()


def _rest(left: DataFrame, library: DataFrame, percent: int) -> DataFrame:
    """All pairs across components of members that can be alike at all, found by what they share and not by their bucket.

    Only shingles that two components have count here: a set of n with s of them shares s at most, so it goes if s is too
    few. Of the others, pairs that are alike enough have one of each other's rarest shingles in common: of a set of n,
    n - ceil(percent n) + 1 in one order for all, those of one component first and then by how many sets have them. So a
    frequent shingle makes no pair unless sets have little else. Where they have, the join compares parities, which rule a
    pair out for sure: sets of m and n at the similarity differ in (m + n) (100 - percent) / (100 + percent) at most. None
    that is alike enough is left out.
    """
    members = cut(left.select("rep", "key", "n", "c").distinct())

    def spread(batches):
        for batch in batches:
            rep, n, c = (batch.column(x).to_numpy() for x in ("rep", "n", "c"))
            for i, own in enumerate(batch.column("set").to_pylist()):
                own = np.frombuffer(own, np.int64)
                for at in range(0, len(own), 1 << 16):
                    part = own[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), x)) for x in (rep[i], n[i], c[i])] + [pa.array(part)], ["rep", "n", "c", "shingle"])

    sets = library.join(_few(members), "key").select("rep", "n", "c", "set").dropDuplicates(["rep"])
    each = cut(sets.mapInArrow(spread, "rep long, n long, c long, shingle long"))
    across = each.groupBy("shingle").agg(F.count("*").alias("d"), F.min("c").alias("_low"), F.max("c").alias("_high")).filter("_low <> _high").select("shingle", "d")
    each = cut(each.join(across, "shingle"))
    enough = each.groupBy("rep").agg(F.count("*").alias("s")).join(members.select("rep", "n"), "rep").filter(f"100 * s >= {percent} * n").select("rep", "s")
    # A set's shingles at a time, so no group is larger than a document.
    order = Window.partitionBy("rep").orderBy("d", "shingle")
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - (F.col("n") - F.col("s"))
    enough = cut(enough)
    rare = each.join(_few(enough), "rep").withColumn("_at", F.row_number().over(order)).filter(F.col("_at") <= prefix)

    def marked(batches):
        for batch in batches:
            bits = [parities(np.frombuffer(own, np.uint64)) for own in batch.column("set").to_pylist()]
            lengths = np.arange(len(bits) + 1, dtype=np.int32) * (PARITIES // 64)
            listed = pa.ListArray.from_arrays(pa.array(lengths), pa.array(np.concatenate([np.empty(0, np.int64), *bits])))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("rep", "key", "c", "n", "s")] + [listed], ["rep", "key", "c", "n", "s", "bits"])

    whole = library.join(_few(cut(members.join(enough, "rep"))), "key").select("rep", "key", "c", "n", "s", "set")
    whole = cut(whole.mapInArrow(marked, "rep long, key binary, c long, n long, s long, bits array<long>").dropDuplicates(["rep"]))
    rare = cut(rare.select("rep", "shingle").join(whole, "rep").select("shingle", F.struct("rep", "key", "c", "n", "s", "bits").alias("m")))
    both, size = F.least("m.s", "o.s"), F.col("m.n") + F.col("o.n")
    alike = (F.col("m.c") != F.col("o.c")) & (F.col("m.rep") < F.col("o.rep")) & (100 * both >= percent * (size - both))
    differ = sum((F.bit_count(F.col("m.bits")[i].bitwiseXOR(F.col("o.bits")[i])) for i in range(PARITIES // 64)), F.lit(0))
    alike &= (100 + percent) * differ <= (100 - percent) * size
    return rare.join(rare.withColumnsRenamed({"m": "o", "shingle": "_shingle"}), (F.col("shingle") == F.col("_shingle")) & alike).select(*_paired("m", "o")).distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The contract's row for every row of ``docs``, for shingles of ``k`` words."""
    marked = cut(sketches(docs, k))
    joined = links(docs, marked, k, percent)
    reps = marked.filter("doc_id is not null and n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"))
    reps = reps.join(joined, F.col("rep") == F.col("node"), "left").select(F.col("key").alias("_key"), F.coalesce("component", "rep").alias("component"))
    rows = marked.select("doc_id", "n", "key").join(reps, F.col("key") == F.col("_key"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component"))
    return rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` without the documents that are near-duplicates of one with a lesser id; columns as they are."""
    gone = near_duplicates(docs.select("doc_id", "text"), k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return carried(docs, F.col("doc_id").cast("long").alias("_id")).join(gone, F.col("_id") == F.col("_gone"), "left_anti").select("_row.*")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), k=4)


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS g
  FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS i, b.doc_id AS j FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
l AS (SELECT i, j FROM p UNION ALL SELECT j, i FROM p),
r AS (SELECT doc_id AS i, doc_id AS j FROM documents UNION SELECT r.i, l.j FROM r JOIN l ON r.j = l.i),
c AS (SELECT i, min(j) AS component_id FROM r GROUP BY i)
SELECT s.doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN c ON c.i = s.doc_id
"""
