"""Language identification by string kernels.

Kernel: for n of 1, 2 and 3 the byte n-grams present in both texts, over the root of the product of the numbers
present in each (blended spectrum, presence only), summed over n. A bounded sample of labelled rows gives the n-gram
vocabulary, the Nyström landmarks and one-versus-rest kernel ridge regressions. Texts are scored in batches: a presence
matrix times the landmarks' matrix times the coefficients.

Defined cases: a null text or one without a letter is ``und`` with score 0; without any labelled row all are ``und``;
a null id counts as an id of empty text; repeated rows are each predicted; a very long text is predicted alone in its
batch; an empty table gives no row; columns of any name may stand beside those that are read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import carried, cut, fraction, read, slices

ORDERS = (1, 2, 3)
#: The most n-grams kept of each order: those in most sampled texts.
KEPT = {1: 128, 2: 1024, 3: 2944}
#: Rows of a language in the sample at most; rows of all languages, as long as each has SAMPLE_LEAST. Every language of a
#: labelled row is learned.
SAMPLE_EACH, SAMPLE_MOST, SAMPLE_LEAST = 800, 12_000, 8
LANDMARKS, RIDGE = 160, 1e-3
UNKNOWN = "und"


@dataclass
class Model:
    grams: dict[int, np.ndarray]  # by order: the n-grams' codes
    landmarks: np.ndarray  # columns: scaled presence vectors
    weights: np.ndarray  # landmarks x languages
    langs: list[str]


_tables: dict[int, tuple] = {}


def _table(grams: dict[int, np.ndarray]) -> tuple[dict[int, np.ndarray], int]:
    """By order: n-gram code -> place in the vector, the last place for all others."""
    key = hash(tuple((n, g.tobytes()) for n, g in sorted(grams.items())))
    if key not in _tables:
        _tables.clear()
        places, at, width = {}, 0, sum(map(len, grams.values()))
        for n in ORDERS:
            places[n] = np.full(256**n, width, np.int16)
            places[n][grams[n]] = np.arange(at, at + len(grams[n]), dtype=np.int16)
            at += len(grams[n])
        _tables[key] = places, width
    return _tables[key]


def _codes(texts: list[str | None]) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """The n-gram codes at every byte of the joined texts, and each byte's text. Texts are two zero bytes apart."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    joined = np.frombuffer(b"\0\0".join([*raw, b""]), np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), [len(r) + 2 for r in raw])
    one = joined.astype(np.uint32)
    two = (one[:-1] << np.uint32(8)) | one[1:]
    three = (two[:-1] << np.uint32(8)) | one[2:]
    return {1: one, 2: two, 3: three}, owner


def _presence(texts: list[str | None], grams: dict[int, np.ndarray]) -> np.ndarray:
    places, width = _table(grams)
    found = np.zeros((len(texts), width + 1), np.float32)
    codes, owner = _codes(texts)
    base = owner.astype(np.int64) * (width + 1)
    flat = found.ravel()
    for n in ORDERS:
        flat[base[: len(codes[n])] + places[n][codes[n]]] = 1
    return found[:, :width]


def _scaled(found: np.ndarray, grams: dict[int, np.ndarray]) -> np.ndarray:
    at = 0
    for n in ORDERS:
        part = found[:, at : at + len(grams[n])]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1))
        at += len(grams[n])
    return found


def _sample(docs: DataFrame) -> DataFrame | None:
    """id, lang, text: a bounded sample of labelled learning rows, as many of each language at most; None without any."""
    rows = docs.filter("not _held and lang is not null and _letters")
    rows = rows.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "lang", "text", fraction(F.col("doc_id"), F.xxhash64("text"), F.lit("sample")).alias("_at"))
    counts = cut(rows.groupBy("lang").agg(F.count("*").alias("_rows")))
    langs = counts.count()
    if not langs:
        return None
    each = max(SAMPLE_LEAST, min(SAMPLE_EACH, SAMPLE_MOST // langs))
    # Rows that can be among a language's first by a hash; then the first themselves.
    near = rows.join(counts, "lang").filter(F.col("_at") * F.col("_rows") < 2 * each + 20)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("_at", "id"))
    return cut(near.withColumn("_nth", first).filter(F.col("_nth") <= each).select("id", "lang", "text"))


def fit(docs: DataFrame) -> Model | None:
    """Learns from ``docs`` (doc_id, text, lang, _held, _letters)."""
    sample = _sample(docs)
    if sample is None:
        return None

    def gram_counts(batches):
        for batch in batches:
            for _, texts in slices(batch.column("text")):
                codes, owner = _codes(texts)
                for n in ORDERS:
                    seen = np.unique(owner[: len(codes[n])].astype(np.int64) << 24 | codes[n]) & 0xFFFFFF
                    code, count = np.unique(seen, return_counts=True)
                    yield pa.RecordBatch.from_pydict({"n": pa.array(np.full(len(code), n, np.int32)), "code": pa.array(code), "count": pa.array(count)})

    total = sample.mapInArrow(gram_counts, "n int, code long, count long").groupBy("n", "code").agg(F.sum("count").alias("count"))
    grams = {n: np.sort(np.array([r["code"] for r in total.filter((F.col("n") == n) & (F.col("code") % 256 != 0)).orderBy(F.desc("count"), "code").limit(KEPT[n]).collect()], np.int64)) for n in ORDERS}

    def presence(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text")):
                bits = np.packbits(_presence(texts, grams).astype(bool), axis=1)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("lang"), pa.array([b.tobytes() for b in bits], pa.binary())], ["id", "lang", "bits"])

    rows = sorted((r["lang"], r["id"], bytes(r["bits"])) for r in sample.mapInArrow(presence, "id string, lang string, bits binary").collect())
    width = sum(map(len, grams.values()))
    found = np.array([np.unpackbits(np.frombuffer(b, np.uint8))[:width] for _, _, b in rows], np.float32).reshape(len(rows), width)
    return _solve(_scaled(found, grams).astype(np.float64), [r[0] for r in rows], grams)


def _solve(x: np.ndarray, labels: list[str], grams: dict[int, np.ndarray]) -> Model:
    langs = sorted(set(labels))
    of = np.array([langs.index(v) for v in labels])
    # Landmarks take turns over the languages, evenly through each one's rows.
    turns = sorted((i / len(own), j) for own in (np.flatnonzero(of == k) for k in range(len(langs))) for i, j in enumerate(own))
    by_rank = sorted(range(len(turns)), key=lambda i: (i * 0.6180339887498949) % 1)
    marks = x[sorted(turns[i][1] for i in by_rank[:LANDMARKS])]
    value, vector = np.linalg.eigh(marks @ marks.T)
    keep = value > 1e-8 * max(value.max(), 1e-12)
    root = vector[:, keep] / np.sqrt(value[keep])
    nystrom = x @ marks.T @ root
    each = 1 / np.maximum(np.bincount(of, minlength=len(langs)), 1)
    weight = each[of][:, None] / len(langs)
    target = np.where(of[:, None] == np.arange(len(langs)), 1.0, -1.0)
    solved = np.linalg.solve(nystrom.T @ (weight * nystrom) + RIDGE * np.eye(nystrom.shape[1]), nystrom.T @ (weight * target))
    return Model(grams, np.ascontiguousarray(marks.T, np.float32), (root @ solved).astype(np.float32), langs)


def predict_batch(texts: list[str | None], model: Model | None) -> tuple[list[str], np.ndarray]:
    if model is None:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    out = _scaled(_presence(texts, model.grams), model.grams) @ model.landmarks @ model.weights
    e = np.exp(4.0 * (out - out.max(axis=1, keepdims=True)))
    best = out.argmax(axis=1)
    return [model.langs[i] for i in best], (e.max(axis=1) / e.sum(axis=1)).astype(np.float64)


def marked(docs: DataFrame) -> DataFrame:
    """docs with _held (crc32 of the id modulo 4 is 2) and _letters."""
    return docs.withColumns(
        {
            "_held": F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2,
            "_letters": F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)),
        }
    )


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches):
        for batch in batches:
            for first, texts in slices(batch.column("text"), most_rows=256):
                part = batch.slice(first, len(texts))
                lang, score = predict_batch(texts, shared.value)
                known = np.array(part.column("_letters").to_pylist(), bool)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("_held"), pa.array([v if k else UNKNOWN for v, k in zip(lang, known, strict=True)], pa.string()), pa.array(np.where(known, score, 0.0))],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    return marked(docs.select("doc_id", "text")).mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` whose text has a language, with the columns that ``docs`` has; ``lang``, where there is one, is the
    identified language. Without a model: those with a letter, as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def decide(batches):
        for batch in batches:
            for first, texts in slices(batch.column("_text"), most_rows=256):
                lang, _ = predict_batch(texts, shared.value)
                letters = batch.column("_letters").slice(first, len(texts)).to_pylist()
                keep = pa.array([k and (v != UNKNOWN or shared.value is None) for k, v in zip(letters, lang, strict=True)], pa.bool_())
                found = pa.RecordBatch.from_arrays([batch.column("_row").slice(first, len(texts)), pa.array(lang, pa.string())], ["_row", "_found"])
                yield found.filter(keep)

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("_letters")
    kept = carried(docs, F.col("text").alias("_text"), letters).mapInArrow(decide, StructType().add("_row", docs.schema).add("_found", "string"))
    changed = {"lang": F.col("_found")} if model is not None else {}
    return kept.select(*[changed.get(c, F.col("_row").getField(c)).alias(c) for c in docs.columns])


def language_model(docs: DataFrame) -> Model | None:
    return fit(marked(docs.select("doc_id", "text", "lang")))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return identify(docs, language_model(docs))
