"""Repeated passages by compact windows.

Every hash function gives each shingle (five words) a random rank. A compact window (left, centre, right) stands for all
runs of shingles inside it that contain the centre: they all have the centre as their minimum, so runs of two texts share
a signature exactly where windows with one centre shingle meet. The windows of a text are the nodes of the Cartesian tree
over its ranks; those wide enough for a passage are the minima of sliding windows, so the tree is only built over these.

Hash functions go by twos. The windows of both are joined by their intervals: where they overlap in a passage's width, the
runs inside have both minima, and the pair of centres is their signature. Texts meet by signature, so that two functions
must agree on an interval as wide as a passage. In a meeting every occurrence is paired with the least document. Pairs are
verified on whole texts: a passage is a run of at least PASSAGE words of the later document whose shingles, at a Jaccard
similarity of 0.8 or more, are in the earlier one. Occurrences that no verified passage covers go on: the least of them
that hasn't been is next paired with those that share LATER signatures with it, for ROUNDS rounds. So a passage found in
thousands of documents costs as many pairs as occurrences, not their square.

Rounds end, and some occurrences may still be in no passage. For them every other document that they meet counts, by an exact
bound: wherever a document has a passage of another, WIDTH shingles in a row lack MISSED of it at most. So shingles that no
second document has are misses for sure, windows with more of them go, as do those that are reported already; of each
other window so many of the rarest shingles are looked up that one of them must be found, and all documents that have it
are verified.

Every repeated passage is reported with an earlier document that has it, not with all of them. The rows depend on the
documents alone, not on how they are dealt to tasks.

Defined cases: null and short texts have no window; rows with a null id take no part (and stay as they are); rows of one
id count as one document; equal texts are one long passage; an empty table gives no row; columns of any name may stand
beside those that are read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import carried, cut, discard, mixed, read, shingles, slices, word_hashes

#: At similarity 0.8 a function agrees on a run with probability 0.8, two with 0.64: all BANDS miss it with 0.36 ** 4,
#: 0.017; at 0.9 with 0.0013. A passage has several runs, and longer ones more.
SHINGLE, PASSAGE, SIMILAR, BANDS = 5, 50, 0.8, 4
#: Rounds, and signatures that pairs of later rounds have in common at least.
ROUNDS, LATER = 3, 2
WIDTH = PASSAGE - SHINGLE + 1
#: Hits that a miss takes: n hits in a span have a Jaccard similarity n / (2 span - n) of SIMILAR just if n >= MISS (span - n).
MISS = 8
#: Shingles missing in a row inside one passage at most: two words put in, left out or changed close to each other.
GAP = 9
#: Misses that the best WIDTH shingles in a row of a passage have at most. A passage of L shingles misses L / 9. From 2 WIDTH
#: shingles on, one of two runs apart has half of that or less; below, its first and last runs overlap in 2 WIDTH - L
#: shingles, and have the most if all misses are there: 9, at L from 81 to 83.
MISSED = 9
#: Ids (8 bytes each) that may be broadcast; beyond, both sides are shuffled.
BROADCAST_IDS = 1_000_000


def sliding(x: np.ndarray, width: int, op: np.ufunc, pad: int) -> np.ndarray:
    """op over every ``width`` neighbours: of blocks, what ends in the one is joined with what begins the next."""
    blocks = np.full(-(-len(x) // width) * width, pad, x.dtype)
    blocks[: len(x)] = x
    blocks = blocks.reshape(-1, width)
    from_left = op.accumulate(blocks, axis=1).ravel()
    from_right = op.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return op(from_right[:n], from_left[width - 1 : width - 1 + n])


def compact_windows(ranks: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, centre, right), bounds inclusive, of all windows of at least ``width``. A rank of 0 parts texts.

    Of equal ranks the first is the centre. Whatever bounds a wide window has a wider one itself, so the tree's other
    nodes needn't be looked at.
    """
    if len(ranks) < width:
        return (np.empty(0, np.int64),) * 3
    least = sliding(ranks, width, np.minimum, 0xFFFFFFFFFFFFFFFF)
    side = np.zeros(width - 1, ranks.dtype)
    wide = sliding(np.concatenate([side, least, side]), width, np.maximum, 0)
    at = np.flatnonzero((ranks == wide) | (ranks == 0))
    values = ranks[at].tolist()
    left, right, stack = [-1] * len(values), [len(values)] * len(values), []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[stack.pop()] = i
        if stack:
            left[i] = stack[-1]
        stack.append(i)
    bounds = np.concatenate([at, [len(ranks), -1]])
    lows, highs = bounds[np.array(left)] + 1, bounds[np.array(right)] - 1
    lows[np.array(left) < 0] = 0
    keep = (ranks[at] > 0) & (highs - lows + 1 >= width)
    return lows[keep], at[keep], highs[keep]


def starts_of(left: np.ndarray, centre: np.ndarray, right: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first, last): the places where runs of ``width`` begin that a window stands for. All windows' together are all runs."""
    return np.maximum(left, centre - width + 1), np.minimum(centre, right - width + 1)


def overlaps(one: tuple, two: tuple, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in one, place in two, first begin) of all windows of two functions that overlap in ``width`` around both
    centres: an interval join. Both have an interval for each run of ``width``, so the joined intervals begin where
    either's do."""
    # Centres come in order, and so do their runs' beginnings.
    begins = [starts_of(*w, width)[0] for w in (one, two)]
    at = np.union1d(*begins)
    of = [np.searchsorted(b, at, side="right") - 1 if len(b) else at for b in begins]
    return of[0], of[1], at


def windows(docs: DataFrame) -> DataFrame:
    """sig, doc, at: signatures of runs of WIDTH shingles, and where the first with it begins. A signature is once in a row
    of ``docs``."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, texts in slices(batch.column("text"), 2 << 20):
                rows, owner, place = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
                for i, text in enumerate(texts):
                    words = word_hashes(text)
                    if len(words) >= PASSAGE:
                        own = shingles(words, SHINGLE) | np.uint64(1)
                        rows += [own, np.zeros(1, np.uint64)]
                        owner.append(np.full(len(own) + 1, ids[first + i]))
                        place.append(np.arange(len(own) + 1))
                shingled, owners, places = np.concatenate(rows), np.concatenate(owner), np.concatenate(place)
                if len(shingled) > 1:
                    for band in range(BANDS):
                        sig, at = signatures(shingled, band)
                        # A document's first place of each; places of a document come in order.
                        own = np.unique(mixed(sig ^ mixed(owners[at].view(np.uint64), band)), return_index=True)[1]
                        sig, at = sig[own], at[own]
                        yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(owners[at]), pa.array(places[at].astype(np.int32))], ["sig", "doc", "at"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null").mapInArrow(run, "sig long, doc long, at int")


def signatures(shingled: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """(signature, begin) of the runs of WIDTH in texts parted by 0, for the two functions of a band."""
    found = []
    for f in (2 * band, 2 * band + 1):
        ranks = mixed(shingled, f + 101) | np.uint64(1)
        ranks[shingled == 0] = 0
        found.append((ranks, compact_windows(ranks, WIDTH)))
    (ranks, one), (others, two) = found
    i, j, at = overlaps(one, two, WIDTH)
    return mixed(mixed(ranks[one[1][i]], band + 1) ^ others[two[1][j]], band + 1), at


def meetings(docs: DataFrame) -> DataFrame:
    """sig, doc, at of the signatures that come more than once."""
    rows = cut(windows(docs))
    often = cut(rows.groupBy("sig").count().filter("count > 1").select("sig"))
    # With nothing above that needs its order, the join splits a signature with most of the rows.
    out = cut(rows.join(often, "sig", "left_semi"))
    discard(rows, often)
    return out


def pivoted(met: DataFrame, least: int = 1) -> DataFrame:
    """a, b: the least document of each signature of ``met`` with each other one, for pairs that have ``least`` signatures so."""
    # Minima meet map-side; written, both sides of the join come straight from its shuffle, so a signature with most of the
    # rows is split.
    pivots = cut(met.groupBy("sig").agg(F.min("doc").alias("a")))
    pairs = met.join(pivots, "sig").filter("doc <> a").groupBy("a", F.col("doc").alias("b")).agg(F.count("*").alias("_n"))
    return pairs.filter(F.col("_n") >= least).select("a", "b")


def candidates(docs: DataFrame) -> DataFrame:
    """a, b (a < b): the pairs of the first round."""
    return pivoted(meetings(docs))


def spans_of(found: DataFrame) -> DataFrame:
    """doc_id, _spans: the passages of each document."""
    return found.groupBy("doc_id").agg(F.collect_set(F.struct("first_word", "n_words")).alias("_spans"))


def unreported(met: DataFrame, found: DataFrame, least: int = 2) -> DataFrame:
    """The occurrences of ``met`` of which half or more is in no passage of ``found``, without the least of each signature and
    signatures of fewer than ``least`` documents."""
    joined = met.join(spans_of(found), F.col("doc") == F.col("doc_id"), "left")
    inside = lambda s: F.least(s["first_word"] + s["n_words"] - SHINGLE + 1, F.col("at") + WIDTH) - F.greatest(s["first_word"], F.col("at"))
    left = joined.filter(~F.coalesce(F.exists("_spans", lambda s: 2 * inside(s) >= WIDTH), F.lit(False))).select("sig", "doc", "at")
    pivots = met.groupBy("sig").agg(F.min("doc").alias("_pivot"), F.count("*").alias("_n")).filter(F.col("_n") >= least).drop("_n")
    return left.join(pivots, "sig").filter("doc <> _pivot").drop("_pivot")


def uncovered(met: DataFrame, found: DataFrame) -> DataFrame:
    """``unreported`` occurrences that meet one another."""
    left = unreported(met, found)
    # One alone has no one left to meet in a round.
    return left.join(left.groupBy("sig").count().filter("count > 1"), "sig", "left_semi")


def looked_up(n: np.ndarray, reported: np.ndarray) -> np.ndarray:
    """Places of shingles of which every document has one that shares a passage not ``reported`` yet.

    ``n`` counts for each place the documents with its shingle, 0 where there is no second one. Each window of WIDTH places
    that can have MISSED misses or fewer, and has more places that aren't reported, gets more than MISSED places that miss
    for sure or are looked up.
    """
    if len(n) < WIDTH:
        return np.empty(0, np.int64)
    total = lambda x: np.diff(np.r_[0, np.cumsum(x)][[np.arange(len(n) - WIDTH + 1), np.arange(WIDTH, len(n) + 1)]], axis=0)[0]
    chosen = n == 0
    begins = np.flatnonzero((total(chosen) <= MISSED) & (total(~reported) > MISSED))
    for i in begins.tolist():
        own = chosen[i : i + WIDTH]
        lacks = MISSED + 1 - np.count_nonzero(own)
        if lacks > 0:
            free = np.flatnonzero(~own)
            # Of equally rare ones the last, which is in more of the windows to come.
            own[free[np.lexsort((-free, n[i + free]))[:lacks]]] = True
    return np.flatnonzero(chosen & (n > 0))


def rest(own: DataFrame, met: DataFrame, found: DataFrame, tested: DataFrame) -> DataFrame:
    """a, b: all pairs not ``tested`` that may share a passage which the rounds haven't found."""
    # Where two documents meet, both have been paired.
    left = cut(unreported(met, found, 3).select("sig", "doc"))
    late = cut(left.select("doc").distinct())
    taking_part = cut(met.join(left.select("sig").distinct(), "sig", "left_semi").select("doc").distinct())

    def each(batches):
        for batch in batches:
            for first, sets in slices(batch.column("_own")):
                parts = [np.unique(np.frombuffer(x, "<i4")) for x in sets]
                docs = np.repeat(batch.column("_doc").to_numpy()[first : first + len(sets)], [len(x) for x in parts])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(parts)), pa.array(docs)], ["shingle", "doc"])

    def rarest(batches):
        for batch in batches:
            ids, spans = batch.column("_doc").to_pylist(), batch.column("_spans").to_pylist()
            places, docs = [np.empty(0, np.int32)], []
            for i, doc in enumerate(ids):
                shingled = np.frombuffer(batch.column("_own")[i].as_py(), "<i4")
                known, often = (batch.column(c)[i].values.to_numpy() for c in ("_shared", "_often"))
                order = np.argsort(known)
                known, often = known[order], often[order]
                at = np.minimum(np.searchsorted(known, shingled), len(known) - 1)
                reported = np.zeros(len(shingled), bool)
                for s in spans[i] or ():
                    reported[s["first_word"] : s["first_word"] + s["n_words"] - SHINGLE + 1] = True
                places.append(np.unique(shingled[looked_up(np.where(known[at] == shingled, often[at], 0), reported)]))
                docs.append(np.full(len(places[-1]), doc))
            if docs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(places)), pa.array(np.concatenate(docs))], ["shingle", "b"])

    sets = own.select(F.col("_doc"), "_own")
    rows = cut(sets.join(taking_part, F.col("_doc") == F.col("doc"), "left_semi").mapInArrow(each, "shingle int, doc long"))
    often = cut(rows.groupBy("shingle").agg(F.count("*").cast("int").alias("n")).filter("n > 1"))
    shared = cut(rows.join(often, "shingle"))
    known = shared.join(late, "doc", "left_semi").groupBy("doc").agg(F.collect_list("shingle").alias("_shared"), F.collect_list("n").alias("_often"))
    asked = sets.join(known, F.col("_doc") == F.col("doc")).join(spans_of(found), F.col("_doc") == F.col("doc_id"), "left")
    asked = cut(asked.select("_doc", "_own", "_shared", "_often", "_spans").mapInArrow(rarest, "shingle int, b long"))
    pairs = asked.join(shared.select("shingle", F.col("doc").alias("a")), "shingle").filter("a < b").select("a", "b").distinct()
    out = cut(pairs.join(tested, ["a", "b"], "left_anti"))
    discard(left, late, taking_part, rows, often, shared, asked)
    return out


def alike_spans(at: np.ndarray) -> list[tuple[int, int, int]]:
    """(first, last, hits): spans that cover all there is of WIDTH shingles or more at the similarity, as few as can be.

    ``at`` has the places of hits, ascending. A span of n hits is alike enough if n - MISS * misses isn't negative, so with
    running totals the farthest end of each beginning is the last total that isn't below the beginning's. Spans that lie in
    others go first; of those left, which may overlap, a greedy cover is taken.
    """
    after = (MISS + 1) * np.arange(len(at)) + 1 - MISS * (at - at[0])
    farthest = np.maximum.accumulate(after[::-1])[::-1]
    # farthest falls, so -farthest is sorted: the last j with farthest[j] >= after[i] - 1.
    last = np.searchsorted(-farthest, 1 - after, side="right") - 1
    new = np.ones(len(at), bool)
    new[1:] = last[1:] > np.maximum.accumulate(last)[:-1]
    first = np.flatnonzero(new & (at[last] - at + 1 >= WIDTH))
    out: list[int] = []
    for i in first.tolist():
        # The one before isn't needed where this one and the one before that leave no gap.
        if len(out) > 1 and i <= last[out[-2]] + 1:
            out.pop()
        out.append(i)
    return [(int(at[i]), int(at[last[i]]), int(last[i]) - i + 1) for i in out]


def shared_passages(early: np.ndarray, late: np.ndarray) -> list[tuple[int, int, float]]:
    """(first word, words, similarity) of the passages of ``late`` that ``early`` has; both are shingles' hashes."""
    known = np.unique(early)
    if not len(known) or len(late) < WIDTH:
        return []
    hit = known[np.minimum(np.searchsorted(known, late), len(known) - 1)] == late
    at = np.flatnonzero(hit)
    if len(at) < WIDTH * SIMILAR:
        return []
    found = []
    breaks = np.flatnonzero(np.diff(at) > GAP + 1)
    for i, j in zip([0, *(breaks + 1)], [*breaks, len(at) - 1], strict=True):
        for first, last, n in alike_spans(at[i : j + 1]):
            span = last - first + 1
            found.append((first, span + SHINGLE - 1, n / (2 * span - n)))
    return found


PASSAGES = "doc_id long, other_id long, first_word int, n_words int, similarity double"


def shingled(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """_doc, _own: the shingles of the documents of ``pairs`` (a, b), as numbers of 32 bits: as long as the text, and two pairs
    in a few billion agree by chance."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    taking_part = cut(pairs.select(F.col("a").alias("_id")).union(pairs.select("b")).distinct())
    if taking_part.count() <= BROADCAST_IDS:
        texts = texts.join(F.broadcast(taking_part), F.col("doc_id") == F.col("_id"), "left_semi")
    else:
        texts = texts.join(taking_part, F.col("doc_id") == F.col("_id"), "left_semi")

    def hashed(batches):
        for batch in batches:
            for first, own in slices(batch.column("text")):
                sets = [shingles(word_hashes(t), SHINGLE).astype("<u4").tobytes() for t in own]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(own)), pa.array(sets, pa.binary())], ["_doc", "_own"])

    out = cut(texts.select("doc_id", "text").mapInArrow(hashed, "_doc long, _own binary"))
    discard(taking_part)
    return out


def verified(own: DataFrame, pairs: DataFrame) -> DataFrame:
    """The passages of each pair (a, b): those of ``b`` that ``a`` has."""

    def run(batches):
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            rows = []
            for first, early in slices(batch.column("a_own")):
                late = batch.column("b_own").slice(first, len(early)).to_pylist()
                for i, (x, y) in enumerate(zip(early, late, strict=True), first):
                    rows += [(b[i], a[i], *p) for p in shared_passages(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "other_id", "first_word", "n_words", "similarity"])

    joined = pairs.join(own.select(F.col("_doc").alias("b"), F.col("_own").alias("b_own")), "b")
    joined = joined.join(own.select(F.col("_doc").alias("a"), F.col("_own").alias("a_own")), "a")
    return cut(joined.select("a", "b", "a_own", "b_own").mapInArrow(run, PASSAGES))


def passages(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, other_id, first_word, n_words, similarity: passages of a document that one with a lesser id has too."""
    whole = met = meetings(docs)
    pairs = tested = cut(pivoted(met))
    # Who meets anyone is in a pair of the first round.
    own = shingled(docs, pairs)
    found = verified(own, pairs)
    for _ in range(rounds - 1):
        met = cut(uncovered(met, found))
        pairs = cut(pivoted(met, LATER).join(tested, ["a", "b"], "left_anti"))
        if pairs.isEmpty():
            break
        tested = tested.union(pairs)
        found = found.union(verified(own, pairs))
    pairs = rest(own, whole, found, tested)
    if not pairs.isEmpty():
        found = found.union(verified(own, pairs))
    discard(own, whole)
    return found


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` less the words of ``spans`` (first word, words), with the white space after each."""
    raw = text.encode("utf-8", "surrogatepass")
    words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    out, at = [], 0
    for first, n in sorted(spans):
        begin = words[first][0] if first < len(words) else len(raw)
        end = words[first + n][0] if first + n < len(words) else len(raw)
        if begin > at:
            out.append(raw[at:begin])
        at = max(at, end)
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with every repeated passage left only in the document with the least id; columns as they are.

    ``n_chars``, where there is one, is the new text's length.
    """
    found = passages(docs.select("doc_id", "text")).groupBy(F.col("doc_id").alias("_id")).agg(F.collect_set(F.struct("first_word", "n_words")).alias("_spans"))
    found = cut(found)
    counted = "n_chars" in docs.columns

    def run(batches):
        for batch in batches:
            texts, spans = batch.column("_text").to_pylist(), batch.column("_spans").to_pylist()
            new = [t if t is None else without(t, [(s["first_word"], s["n_words"]) for s in own]) for t, own in zip(texts, spans, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(new, pa.string()), pa.array([len(t or "") for t in new], pa.int64())], ["_row", "_text", "_chars"])

    rows = carried(docs, F.col("doc_id").cast("long").alias("_doc"), F.col("text").alias("_text")).join(found, F.col("_doc") == F.col("_id"), "left")
    changed = rows.filter("_id is not null").select("_row", "_text", "_spans").mapInArrow(run, StructType([StructField("_row", docs.schema), StructField("_text", StringType()), StructField("_chars", LongType())]))
    new = {"text": F.col("_text")} | ({"n_chars": F.col("_chars").cast(docs.schema["n_chars"].dataType)} if counted else {})
    changed = changed.select(*[new.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])
    return rows.filter("_id is null").select("_row.*").union(changed)


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages(read(spark, sf_dir, "documents"))
