"""Pieces that the training-data operators share."""

from __future__ import annotations

import tempfile
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Letters A-Z alone are folded; every other code point stays.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word between ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a temporary folder; on a cluster a machine's own
    folder would be lost with the machine, so there the setting is required.
    """
    found = spark.sparkContext.getCheckpointDir()
    if found:
        return found
    wanted = spark.conf.get("spark.checkpoint.dir", None)
    if not wanted:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        wanted = tempfile.mkdtemp(prefix="checkpoint-")
    spark.sparkContext.setCheckpointDir(wanted)
    return spark.sparkContext.getCheckpointDir()


#: Settings while a table is written. Batches to Python are bounded: the JVM builds each outside its heap, in buffers that
#: double, and Python holds it again. A row that is larger comes alone.
BATCH_BYTES, BATCH_ROWS = 4 << 20, 2048
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
    "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
}


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and go on from there, so that lost executors cost no rework.

    What the writing shuffled is deleted once it is written; the table goes by ``discard`` or at the session's end.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/table-{uuid4().hex}"
    before = {k: spark.conf.get(k, None) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    path, files = _folder(spark, folder)
    files.deleteOnExit(path)
    out = spark.read.schema(df.schema).parquet(folder)
    out._written = folder
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``cut`` that nothing reads any more."""
    for t in tables:
        path, files = _folder(t.sparkSession, t._written)
        files.delete(path, True)


def _folder(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def carried(docs: DataFrame, *parts: Column) -> DataFrame:
    """``_row``, a struct of all columns of ``docs``, and ``parts``: what an operator adds can't clash with a column.
    ``select("_row.*")`` gives the columns back."""
    return docs.select(F.struct("*").alias("_row"), *parts)


def tasks(spark: SparkSession, rows: int, each: int, most: int = 20_000) -> int:
    """Partitions for ``rows`` rows at about ``each`` a partition."""
    return max(spark.sparkContext.defaultParallelism, min(most, -(-rows // each)))


def folded(text: Column) -> Column:
    """A-Z to lower case; a null text is empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def fraction(*cols: Column) -> Column:
    """A hash of the columns as a number from 0 to below 1."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 12).cast("double") / F.lit(float(1 << 52))


def running_total(df: DataFrame, group: str, order: str, value: str, out: str, ties: list[str]) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same group before this one.

    ``order`` is a uniform number in [0, 1). Each group is cut into equal ranges of it, so a group with most
    of the rows still spreads over many tasks: totals of ranges first, then sums inside each range.
    A null group is a group.
    """
    from pyspark.sql import Window

    ranges = tasks(df.sparkSession, df.count(), 2048, 1 << 16)
    cut_up = df.withColumn("_range", F.floor(F.col(order) * ranges).cast("int"))
    whole = cut_up.groupBy(group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = whole.select(
        F.col(group).alias("_group"), F.col("_range").alias("_range_of"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start")
    )
    inside = Window.partitionBy(group, "_range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut_up.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(starts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_range") == F.col("_range_of")))
        .withColumn(out, F.col("_start") + F.col("_inside"))
        .drop("_range", "_inside", "_group", "_range_of", "_start")
    )


def prefixes(df: DataFrame, order: list[Column], **sums: str) -> DataFrame:
    """Adds for each ``out="value"`` the sum of the whole number ``value`` over all rows that come before in ``order``.

    Rows are cut into ranges of the order; ranges are summed first, a row a range, then rows inside each. The order must
    tell rows apart.
    """
    from pyspark.sql import Window

    ranges = tasks(df.sparkSession, df.count(), 1 << 16)
    ranged = cut(df.repartitionByRange(ranges, *order).withColumn("_range", F.spark_partition_id()))
    # A row for each range.
    by = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("_range").agg(*[F.sum(v).alias(f"_sum_{out}") for out, v in sums.items()])
    starts = starts.select("_range", *[F.coalesce(F.sum(f"_sum_{out}").over(by), F.lit(0)).alias(f"_start_{out}") for out in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranged.join(F.broadcast(starts), "_range")
    return joined.select(*df.columns, *[(F.col(f"_start_{out}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(out) for out, v in sums.items()])


# ---- vectorised hashing of words, for operators that run Python over Arrow batches ----

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the result."""
    x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xE9846AF9B1A615D)
    x ^= x >> np.uint64(28)
    return x


class WordHashes(dict):
    """word (bytes) -> 64-bit hash. Words are remembered up to a bound, then forgotten together."""

    MOST = 400_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_words = WordHashes()


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words between ASCII white space of a text folded to lower case (A-Z only)."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """One hash for every k consecutive words; of fewer than k words, one for them all."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        out = mixed(out ^ hashes[i : n - width + 1 + i], width)
    return out


def slices(column, most_bytes: int = 4 << 20, most_rows: int = 1024):
    """(first, texts) of an Arrow string column, in runs of bounded size; a longer text comes alone."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    first, held = 0, 0
    for i, n in enumerate(lengths):
        if i > first and (held + n > most_bytes or i - first >= most_rows):
            yield first, column.slice(first, i - first).to_pylist()
            first, held = i, 0
        held += int(n)
    if first < len(lengths):
        yield first, column.slice(first).to_pylist()
