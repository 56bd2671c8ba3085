"""Hierarchical multi-length packing of tokenised documents.

A document's ids (and a closing id 0) are cut into full windows of the longest tier and one rest, which is routed to the
smallest context tier that holds it. Per pack group (a bounded number of documents, dealt by hash, so that no source or
group of copies meets in one task) tiers are packed from the longest to the shortest, each into windows of its own
length: a tier's rests go best-fit, longest first, into its windows; gaps that are left are filled from shorter tiers,
first with the longest rest that fits and at last with the head of one, whose tail stays for its own tier. So a window is
full, as long as its tier, and needs no padding; only what is left at a group's end is padded.
Sequences are then dealt to step groups, each to the one with the fewest ids, so that steps carry about equal numbers.

Defined cases: a null or empty text is the closing id alone; an empty table gives no piece; repeated rows and null ids
are packed like others; a very long text is one task's, cut into windows; other columns are never read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, slices, tasks

WINDOW, TIERS, CLOSE = 1024, (64, 128, 256, 512, 1024), 0
#: Documents of a pack group; ids of a step group.
GROUP_DOCS, STEP = 4096, 64 * WINDOW
TOKENIZER = "byte_bpe_50k.json"
#: Bytes and rows of texts that are encoded together; a longer text comes alone.
BATCH = 32 << 20, 10_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Texts -> their ids as little-endian unsigned 32-bit bytes.

    With the byte-level pre-tokeniser a space after a character that isn't white space always begins a new pre-token, so
    texts are cut there into words, and each distinct word of a batch is encoded once: many together, as one text with
    spaces between. As no word has a space in it, the ids whose token begins with one are the words' first. Nothing is kept
    from batch to batch. Texts with white space around a space, those with a special token's string, and all texts of other
    tokenisers are encoded whole.
    """

    #: Words encoded at once; texts whose ids are put together at once.
    AT_ONCE, TEXTS = 200, 256
    AROUND = re.compile(r"\s \s")
    #: A space's byte is written as this letter in a token.
    SPACE = "\u0120"

    def __init__(self, path: str):
        # A task has one core; the library's threads would take those of others.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        self.special = [t["content"] for t in spec["added_tokens"]]
        before = spec.get("pre_tokenizer") or {}
        self.in_words = before.get("type") == "ByteLevel" and bool(before.get("use_regex")) and not before.get("add_prefix_space") and not spec.get("normalizer") and not any(" " in s for s in self.special)
        vocabulary = self.whole.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(self.SPACE)]] = True

    def _encoded(self, text: str) -> np.ndarray:
        # The library's call without offsets, which is the quicker one.
        (found,) = self.whole.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, "<u4")

    def _after_space(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of all, first, number) of each of ``words`` as it is after a space."""
        # White space at a word's end would meet the next word's space.
        together = pc.and_(pc.equal(pc.utf8_trim_whitespace(words), words), pc.greater(pc.binary_length(words), 0)).to_numpy(zero_copy_only=False)
        found, sizes = [], []
        some = words.filter(pa.array(together)).to_pylist()
        for i in range(0, len(some), self.AT_ONCE):
            ids = self._encoded(" " + " ".join(own := some[i : i + self.AT_ONCE]))
            first = np.flatnonzero(self.begins[ids])
            if len(first) != len(own):
                raise ValueError("a token of this vocabulary goes over the beginning of a word")
            found.append(ids)
            sizes.append(np.diff(first, append=len(ids)))
        for w in words.filter(pa.array(~together)).to_pylist():
            found.append(ids := self._encoded(" " + w))
            sizes.append(np.array([len(ids)]))
        number, first = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        at, in_order = np.argsort(~together, kind="stable"), np.concatenate(sizes)
        number[at], first[at] = in_order, np.cumsum(in_order) - in_order
        return np.concatenate(found), first, number

    def batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text; null has none."""
        heads, rests = [], []
        for text in texts:
            rest = None
            if not text:
                own = b""
            elif not self.in_words or any(s in text for s in self.special) or self.AROUND.search(text):
                own = self._encoded(text).tobytes()
            else:
                head, space, after = text.partition(" ")
                own = self._encoded(head).tobytes() if head else b""
                rest = after if space else None
            heads.append(own)
            rests.append(rest)
        split = pc.split_pattern(pa.array(rests, pa.string()), " ")
        words = split.flatten().dictionary_encode()
        if not len(words):
            yield from heads
            return
        flat, first, number = self._after_space(words.dictionary)
        which = words.indices.to_numpy()
        last = np.cumsum(pc.fill_null(pc.list_value_length(split), 0).to_numpy(), dtype=np.int64)
        for i in range(0, len(texts), self.TEXTS):
            until = last[i : i + self.TEXTS]
            begin = last[i - 1] if i else 0
            own = which[begin : until[-1]]
            each = number[own]
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.repeat(first[own] - ends[:-1], each) + np.arange(ends[-1])]
            bounds = [0, *ends[until - begin].tolist()]
            for head, x, y in zip(heads[i : i + self.TEXTS], bounds[:-1], bounds[1:], strict=True):
                yield head + ids[x:y].tobytes()

    def ids(self, text: str | None) -> bytes:
        return next(self.batch([text]))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def cut_up(ids: bytes, window: int = WINDOW) -> list[tuple[int, int, int, bytes]]:
    """(start, length, crc32, ids) of full windows and of the rest; a full window's ids aren't needed any more."""
    view, n = memoryview(ids), len(ids) // 4
    parts = [(s, min(window, n - s), view[4 * s : 4 * min(s + window, n)]) for s in range(0, n, window)]
    return [(s, k, zlib.crc32(part), b"" if k == window else _narrow(bytes(part))) for s, k, part in parts]


def _narrow(ids: bytes) -> bytes:
    """``ids`` in two bytes each where all are below 65,536."""
    wide = np.frombuffer(ids, "<u4")
    return wide.astype("<u2").tobytes() if int(wide.max()) < 1 << 16 else ids


def _part_crc(ids: bytes, whole: int, start: int, length: int) -> int:
    """crc32 of some of a piece of ``whole`` ids."""
    return zlib.crc32(np.frombuffer(ids, "<u2" if len(ids) == 2 * whole else "<u4")[start : start + length].astype("<u4").tobytes())


def pieces(docs: DataFrame, path: str | None = None, within: str | None = None) -> DataFrame:
    """The pieces of every document of ``docs`` (doc_id, text); ``ids`` of those that may be cut again; ``_within``, the
    document's value of the column ``within``."""
    path = path or tokenizer_path()

    def run(batches):
        encode = encoder(path).batch
        close = np.array([CLOSE], "<u4").tobytes()
        for batch in batches:
            ids = batch.column("doc_id")
            for first, texts in slices(batch.column("text"), *BATCH):
                at, found, totals = [], [], []
                for i, own_ids in enumerate(encode(texts)):
                    own = cut_up(data := own_ids + close)
                    at += [i] * len(own)
                    found += own
                    totals += [len(data) // 4] * len(own)
                *numbers, kept = zip(*found, strict=True)
                columns = [pa.array(np.array(x, np.int64)) for x in (*numbers, totals)]
                own = [c.slice(first, len(texts)).take(pa.array(at)) for c in (ids, batch.column("_within"))]
                yield pa.RecordBatch.from_arrays([own[0], *columns, pa.array(kept, pa.binary()), own[1]], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids", "_within"])

    apart = (F.lit(None) if within is None else F.col(within)).cast("string").alias("_within")
    return docs.select(F.col("doc_id").cast("long"), "text", apart).mapInArrow(run, f"{PIECES}, ids binary, _within string")


def tier(length: int) -> int:
    return next(t for t in TIERS if t >= length)


class Rests:
    """Pieces (number, start, length) by length."""

    def __init__(self):
        self.by: dict[int, list[tuple[int, int]]] = {}
        self.has = 0  # bit n: there is a piece of n ids

    def add(self, number: int, start: int, length: int) -> None:
        self.by.setdefault(length, []).append((number, start))
        self.has |= 1 << length

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The longest piece of at most ``most`` ids."""
        length = (self.has & ((2 << most) - 1)).bit_length() - 1
        if length < 0:
            return None
        own = self.by[length]
        number, start = own.pop()
        if not own:
            self.has &= ~(1 << length)
        return number, start, length


def pack(lengths: np.ndarray, tiers: tuple[int, ...] = TIERS) -> list[tuple[int, int, int, int, int]]:
    """(number, start in it, length, sequence, offset) of the parts of pieces of ``lengths`` ids, none over the longest tier."""
    out: list[tuple[int, int, int, int, int]] = []
    waiting = {t: Rests() for t in tiers}
    for i in reversed(range(len(lengths))):
        waiting[next(t for t in tiers if t >= lengths[i])].add(i, 0, int(lengths[i]))
    sequences = 0
    for at in reversed(range(len(tiers))):
        length = tiers[at]
        # The tier's own rests, best fit: the fullest window that has room.
        windows: list[list] = []
        by_room: dict[int, list[int]] = {}
        open_ = 0  # bit r: a window with room r is open
        while (own := waiting[length].take(length)) is not None:
            fitting = open_ >> own[2]
            if fitting:
                room = own[2] + (fitting & -fitting).bit_length() - 1
                k = by_room[room].pop()
                if not by_room[room]:
                    open_ &= ~(1 << room)
            else:
                room, k = length, len(windows)
                windows.append([])
            windows[k].append(own)
            if room > own[2]:
                by_room.setdefault(room - own[2], []).append(k)
                open_ |= 1 << (room - own[2])
        # The fullest first; a window that nothing shorter fills takes from the emptiest, so that one a tier is left at most.
        windows.sort(key=lambda w: -sum(p[2] for p in w))
        shorter = [waiting[t] for t in reversed(tiers[:at])]
        k = 0
        while k < len(windows):
            own = windows[k]
            room = length - sum(p[2] for p in own)
            while room and (found := _filling(room, shorter, waiting, tiers) or _stolen(room, windows, k)):
                own.append(found)
                room -= found[2]
            offset = 0
            for number, start, n in own:
                out.append((number, start, n, sequences, offset))
                offset += n
            sequences += 1
            k += 1
    return _joined(out, tiers)


def _filling(room: int, shorter: list[Rests], waiting: dict[int, Rests], tiers: tuple[int, ...]) -> tuple[int, int, int] | None:
    """The longest rest of shorter tiers that fits, else the head of the shortest there is, whose tail waits on."""
    for rests in shorter:
        if (found := rests.take(room)) is not None:
            return found
    source = next((w for w in reversed(shorter) if w.has), None)
    if source is None:
        return None
    number, start, n = source.take((source.has & -source.has).bit_length() - 1)
    waiting[next(t for t in tiers if t >= n - room)].add(number, start + room, n - room)
    return number, start, room


def _stolen(room: int, windows: list[list], k: int) -> tuple[int, int, int] | None:
    """A piece, or the head of one, of the last window, if that isn't window ``k`` itself."""
    if len(windows) == k + 1:
        return None
    number, start, n = windows[-1].pop()
    if n > room:
        windows[-1].append((number, start + room, n - room))
    elif not windows[-1]:
        windows.pop()
    return number, start, min(n, room)


def _joined(parts: list[tuple[int, int, int, int, int]], tiers: tuple[int, ...]) -> list[tuple[int, int, int, int, int]]:
    """Windows that found no more to fill them, and don't end at a tier's length, are put together in windows of the longest."""
    fill: dict[int, int] = {}
    for _, _, n, k, _ in parts:
        fill[k] = fill.get(k, 0) + n
    short = sorted((k for k, n in fill.items() if n not in tiers), key=lambda k: (-fill[k], k))
    rooms: list[list[int]] = []  # [sequence, ids so far]
    moved: dict[int, tuple[int, int]] = {}
    for k in short:
        to = next((r for r in rooms if r[1] + fill[k] <= tiers[-1]), None)
        if to is None:
            rooms.append(to := [k, 0])
        moved[k] = (to[0], to[1])
        to[1] += fill[k]
    return [(i, s, n, *((moved[k][0], moved[k][1] + o) if k in moved else (k, o))) for i, s, n, k, o in parts]


def steps(sequence: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The step group of each part's sequence: the longest first, each to the group with the fewest ids."""
    names, at = np.unique(sequence, return_inverse=True)
    fill = np.bincount(at, lengths)
    loads = [(0, g) for g in range(max(1, int(-(-fill.sum() // STEP))))]
    of = np.empty(len(fill), np.int64)
    for k in np.argsort(-fill, kind="stable"):
        ids, g = heapq.heappop(loads)
        of[k] = g
        heapq.heappush(loads, (ids + int(fill[k]), g))
    return of[at]


def packed(docs: DataFrame, path: str | None = None, within: str | None = None) -> DataFrame:
    """Every piece of every document with its sequence, offset and step group. With ``within``, a sequence has documents of
    one value of that column alone (null is a value)."""
    groups = max(1, docs.count() // GROUP_DOCS)
    cut_pieces = pieces(docs, path, within)
    dealt = cut_pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))

    def run(batches):
        whole = pd.concat(list(batches), ignore_index=True)
        for group, rows in whole.groupby("_group", sort=True):
            rows = rows.sort_values(["length", "doc_id", "start", "ids_crc32", "doc_tokens"], ascending=[False, True, True, True, True])
            parts, first = [], 0
            values = rows["_within"].fillna("").to_numpy() + np.where(rows["_within"].isna(), "", "=")
            for value in np.unique(values.astype(object)):
                # Of pieces of one value; numbers of all the group's pieces, sequences after those before.
                own = np.flatnonzero(values == value)
                of = pack(rows["length"].to_numpy()[own])
                parts += [(own[i], s, n, first + k, o) for i, s, n, k, o in of]
                first += max(k for _, _, _, k, _ in of) + 1
            parts.sort()
            number, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*parts, strict=True))
            out = rows.iloc[number].reset_index(drop=True)
            each = zip(out["ids_crc32"].to_list(), out["ids"].to_list(), out["length"].to_list(), start.tolist(), length.tolist(), strict=True)
            crc = [c if n == whole else _part_crc(ids, whole, s, n) for c, ids, whole, s, n in each]
            out = out.assign(start=out["start"] + start, length=length, ids_crc32=crc, sequence_id=(int(group) << 32) + sequence, offset=offset, step_group=(int(group) << 32) + steps(sequence, length))
            yield out.drop(columns=["_group", "ids", "_within"])

    def guarded(batches):
        kept = [b for b in batches if len(b)]
        return run(kept) if kept else iter(())

    return dealt.repartition(min(groups, tasks(docs.sparkSession, groups, 1)), "_group").mapInPandas(guarded, f"{PIECES}, sequence_id long, offset long, step_group long")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))
