"""Language-model scoring by prediction by partial matching.

The trie holds every byte context of up to ORDER bytes with the counts of what followed it in the learning texts. A byte
is predicted in its longest context that was seen; a byte new there escapes to the next shorter one (escape estimate: the
distinct bytes seen, method C), where bytes that the longer context had already are excluded, down to equal shares of the
bytes never seen. A text is its bytes and a closing symbol, after ORDER opening symbols.

The trie is never sent whole to a task. Documents are dealt into parts of bounded size; each part asks for the
ORDER + 1 grams (and words) that it has. Counts and answers move by the gram, and a part gets back what it asked for.
Grams are answered in buckets by their last two context bytes; contexts with more grams than a bucket should have are
split by the byte before, and what shorter contexts need goes to each share. So a bucket has a bound whatever the texts.

Defined cases: a null text is empty (the closing symbol alone); a null id counts as an id of empty text; equal rows are
each scored; a very long text is worked on in pieces that end at white space; without learning texts bytes have equal
shares; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHashes, cut, discard, read, slices, tasks

ORDER = 4
#: A byte that UTF-8 never has: opens and closes a text.
MARK = 0xFF
#: Bytes of texts in a part; bytes worked on at once; grams of a bucket, wanted.
PART_BYTES, AT_ONCE, BUCKET = 28 << 20, 2 << 20, 40_000
#: Words' keys are below zero, grams' from zero. The end token's key is that of white space, which no word has.
_SIGN = np.uint64(1 << 63)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")

_words = WordHashes()


def _units(column):
    """Lists of (row, the ORDER bytes before, bytes, whether they end the text), of bounded size together."""
    out, held = [], 0
    for first, texts in slices(column, AT_ONCE):
        for i, text in enumerate(texts, first):
            raw, at = (text or "").encode("utf-8", "surrogatepass"), 0
            while True:
                end = at + AT_ONCE
                space = _SPACE.search(raw, end) if end < len(raw) else None
                end = space.end() if space else len(raw)
                before = raw[at - ORDER : at] if at else bytes([MARK]) * ORDER
                out.append((i, before, raw[at:end], end == len(raw)))
                held += end - at
                if held >= AT_ONCE:
                    yield out
                    out, held = [], 0
                if end == len(raw):
                    break
                at = end
    if out:
        yield out


def _word_keys(raw: bytes, ends: bool) -> np.ndarray:
    own = raw.lower().split()
    if ends:
        own.append(b"\n")
    return np.fromiter(map(_words.__getitem__, own), np.uint64, len(own)) | _SIGN


def _codes(units: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """The ORDER + 1 bytes up to each predicted symbol as a number, for all units; and how many each unit has."""
    joined = np.frombuffer(b"".join(x for _, before, raw, ends in units for x in (before, raw, bytes([MARK]) if ends else b"")), np.uint8)
    lengths = np.array([len(raw) + ends for _, _, raw, ends in units], np.int64)
    codes = joined[: len(joined) - ORDER].astype(np.uint64)
    for i in range(1, ORDER + 1):
        codes = (codes << np.uint64(8)) | joined[i : len(joined) - ORDER + i]
    starts = np.concatenate([[0], np.cumsum(lengths + ORDER)[:-1]])
    wanted = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
    return codes[wanted], lengths


def gram_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The grams of whole texts, and how many each has."""
    return _codes([(i, bytes([MARK]) * ORDER, (t or "").encode("utf-8", "surrogatepass"), True) for i, t in enumerate(texts)])


class Places:
    """Finds the places of many keys among distinct sorted keys: a table of hashes first, then halving for the few that clash."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, int(len(keys)).bit_length() + 2)
        self.table = np.zeros(1 << self.bits, np.int32)
        self.table[self._at(keys)] = np.arange(len(keys), dtype=np.int32)

    def _at(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Places of keys that are all there."""
        at = self.table[self._at(wanted)]
        clash = np.flatnonzero(self.keys[at] != wanted)
        if len(clash):
            at[clash] = np.searchsorted(self.keys, wanted[clash])
        return at


def _merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([k for k, _ in found])
    distinct, at = np.unique(keys, return_inverse=True)
    return distinct, np.bincount(at, np.concatenate([n for _, n in found]), len(distinct)).astype(np.int64)


def count_part(rows: pa.Table) -> pa.Table:
    """part, key, count: the distinct grams and words of a part's texts, with their counts in its learning texts."""
    part, found = rows.column("part")[0].as_py(), []
    for batch in rows.to_batches():
        held = batch.column("held_out").to_numpy(zero_copy_only=False)
        for units in _units(batch.column("text")):
            learn = ~held[[u[0] for u in units]]
            codes, lengths = _codes(units)
            found.append(_counted(codes, np.repeat(learn, lengths)))
            words = [_word_keys(raw, ends) for _, _, raw, ends in units]
            found.append(_counted(np.concatenate(words), np.repeat(learn, [len(w) for w in words])))
            if len(found) >= 16:
                found = [_merged(found)]
    keys, counts = _merged(found)
    return pa.table({"part": pa.array(np.full(len(keys), part, np.int32)), "key": pa.array(keys.view(np.int64)), "cnt": pa.array(counts)})


def _counted(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with their numbers in learning texts."""
    if learn.all():
        distinct, counts = np.unique(keys, return_counts=True)
        return distinct, counts.astype(np.int64)
    kept, counts = np.unique(keys[learn], return_counts=True)
    other = np.setdiff1d(np.unique(keys[~learn]), kept, assume_unique=True)
    return np.concatenate([kept, other]), np.concatenate([counts, np.zeros(len(other), np.int64)]).astype(np.int64)


def log_probabilities(keys: np.ndarray, counts: np.ndarray, pairs: tuple, singles: tuple, triples: tuple | None = None) -> np.ndarray:
    """log10 probability of the last byte of each gram after the others.

    ``keys``, ``counts``: distinct grams, with all that share their last three context bytes; ``triples``, ``pairs`` and
    ``singles``: distinct grams of three, two and one bytes with their counts, all that share the last two, one and no
    context bytes with a gram. Without ``triples``, ``keys`` has all that share the last two context bytes.
    """
    out, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    above = None  # of the next longer order: grams, counts, context of each, (seen, distinct) of each context
    for k in range(ORDER, -1, -1):
        width = np.uint64((1 << 8 * (k + 1)) - 1)
        given = {2: triples, 1: pairs, 0: singles}.get(k)
        if given is None:
            grams, at = np.unique(keys & width, return_inverse=True)
            n = np.bincount(at, counts, len(grams))
        else:
            grams, n = given
            order = np.argsort(grams)
            grams, n = grams[order], n[order].astype(float)
            at = np.minimum(np.searchsorted(grams, keys & width), max(len(grams) - 1, 0))
        contexts, own = np.unique(grams >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(own, n, len(contexts)), np.bincount(own, n > 0, len(contexts))
        context = own[at]
        n_here, total_here, distinct_here = n[at], total[context], distinct[context].astype(float)
        if above is not None:
            grams_up, n_up, own_up, total_up, distinct_up, context_up = above
            shorter = np.minimum(np.searchsorted(grams, grams_up & width), len(grams) - 1)
            taken = np.bincount(own_up, np.where(n_up > 0, n[shorter], 0.0), len(total_up))
            total_here = total_here - taken[context_up]
            distinct_here = distinct_here - distinct_up[context_up]
        whole = total_here + distinct_here
        hit = open_ & (n_here > 0)
        out[hit] += np.log10(n_here[hit] / whole[hit])
        fell = open_ & (n_here == 0) & (whole > 0)
        out[fell] += np.log10(distinct_here[fell] / whole[fell])
        open_ &= n_here == 0
        above = grams, n, own, total, distinct, context
    seen = int((singles[1] > 0).sum())
    out[open_] -= np.log10(256 - seen) if seen < 256 else 0.0
    return out


def _score(docs: pa.Table, answers: pa.Table) -> pa.Table:
    keys = answers.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    keys, values = keys[order], answers.column("value").to_numpy()[order]
    words = np.searchsorted(keys, _SIGN)
    gram_at, word_at = Places(keys[:words]), Places(keys[words:])
    counts, values = values[words:], values[:words]
    logs, out = np.log10(counts + 0.5), []
    for batch in docs.to_batches():
        n_tokens, n_known = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
        base, score = np.zeros(len(batch)), np.zeros(len(batch))
        for units in _units(batch.column("text")):
            rows = np.array([u[0] for u in units])
            codes, lengths = _codes(units)
            owner = np.repeat(rows, lengths)
            score += np.bincount(owner, values[gram_at.find(codes)], len(batch))
            own = [_word_keys(raw, ends) for _, _, raw, ends in units]
            n = np.array([len(w) for w in own], np.int64)
            at, owner = word_at.find(np.concatenate(own)), np.repeat(rows, n)
            n_tokens += np.bincount(owner, minlength=len(batch))
            n_known += np.bincount(owner, counts[at] > 0, len(batch)).astype(np.int64)
            base += np.bincount(owner, logs[at], len(batch))
        out.append((n_tokens, n_known, base, score))
    found = docs.select(["doc_id", "held_out"])
    for name, column in zip(("n_tokens", "n_known", "_base", "score"), zip(*out, strict=True), strict=True):
        found = found.append_column(name, pa.array(np.concatenate(column)))
    return found


def answered_grams(spark: SparkSession, grams: DataFrame) -> DataFrame:
    """key, value: the log probability of every gram of ``grams`` (key, cnt), in buckets of bounded size."""
    triples = cut(grams.groupBy(F.col("key").bitwiseAND(0xFFFFFF).alias("key")).agg(F.sum("cnt").alias("cnt"), F.count("*").alias("n")))
    # Of two bytes there are 65,536 at most: pairs go to all tasks, and so do the contexts that are split.
    found = triples.groupBy(F.col("key").bitwiseAND(0xFFFF).alias("key")).agg(F.sum("cnt").alias("cnt")).toArrow()
    pairs = found.column("key").to_numpy().view(np.uint64), found.column("cnt").to_numpy()
    last, of = np.unique(pairs[0] & np.uint64(0xFF), return_inverse=True)
    shared = spark.sparkContext.broadcast((pairs, (last, np.bincount(of, pairs[1], len(last)))))
    context = F.shiftright("key", 8).bitwiseAND(0xFFFF).alias("context")
    split = F.broadcast(triples.groupBy(context).agg(F.ceil(F.sum("n") / BUCKET).alias("shares")).filter("shares > 1"))
    buckets = max(1, -(-grams.count() // BUCKET))

    def bucketed(df: DataFrame, share, level: int) -> DataFrame:
        joined = df.select("*", context).join(split, "context", "left").withColumn("shares", F.coalesce("shares", F.lit(1)))
        return joined.withColumn("share", share).select(F.pmod(F.xxhash64("context", "share"), F.lit(buckets)).alias("bucket"), F.lit(level).alias("level"), "key", "cnt")

    rows = bucketed(grams, F.shiftright("key", 24).bitwiseAND(0xFF) % F.col("shares"), ORDER).union(bucketed(triples, F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)), 2))

    def answer(rows: pa.Table) -> pa.Table:
        level, keys, counts = rows.column("level").to_numpy(), rows.column("key").to_numpy().view(np.uint64), rows.column("cnt").to_numpy()
        own = level == ORDER
        # Two shares of one context may be in one bucket.
        triple, at = np.unique(keys[~own], return_index=True)
        values = log_probabilities(keys[own], counts[own], *shared.value, (triple, counts[~own][at]))
        return pa.table({"key": pa.array(keys[own].view(np.int64)), "value": pa.array(values)})

    out = cut(rows.groupBy("bucket").applyInArrow(answer, "key long, value double"))
    shared.destroy()
    discard(triples)
    return out


def scored(docs: DataFrame) -> DataFrame:
    """The contract's row for every row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    parts = max(1, -(-(docs.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0) // PART_BYTES))
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 1
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"), F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(parts)).cast("int").alias("part"))
    keyed = tasks(spark, 4 * parts, 1)
    asked = cut(rows.groupBy("part").applyInArrow(count_part, "part int, key long, cnt long"))
    trie = cut(asked.select("key", "cnt").repartition(keyed, "key").groupBy("key").agg(F.sum("cnt").alias("cnt")))
    words = trie.filter("key < 0")
    answers = answered_grams(spark, trie.filter("key >= 0")).union(words.select("key", F.col("cnt").cast("double")))
    answered = asked.select("part", "key").join(answers.repartition(keyed, "key"), "key").select("part", "key", "value")
    out = rows.groupBy("part").cogroup(answered.groupBy("part")).applyInArrow(_score, "doc_id long, held_out boolean, n_tokens long, n_known long, _base double, score double")
    totals = words.agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("train_tokens"), F.count(F.when(F.col("cnt") > 0, 1)).alias("_distinct"))
    base = F.col("_base") - F.col("n_tokens") * F.log10(F.col("train_tokens") + 0.5 * (F.col("_distinct") + 1))
    # One row, so nothing is multiplied.
    return out.join(F.broadcast(totals), F.lit(True)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", base.alias("base_score"), "score")


def op8_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read(spark, sf_dir, "documents"))
