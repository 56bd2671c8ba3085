"""WARC archives with an external index merge.

1. Payload digests are grouped (partial sums first): of equal payloads the least page is the response.
2. Tasks write gzip records to archives of bounded size in the shared folder. Each archive's captures, sorted by URL key
   and time, are one run of the index. A task that is run again writes new files; only the files that the index names count.
3. The runs are cut at common bounds of (URL key, time, page) and every range is merged by a loser tree over its runs:
   one globally ordered capture history. A URL with most of the captures spans many ranges.
4. The archives are read back by file and offset.

Defined cases: a null html is an empty payload; a null url has an empty key; a null page id is after all others (among
equal payloads it revisits the least id, without any id each is a response); equal ids with equal payloads are of one
type; an empty table gives no row; other columns are never read.
"""

from __future__ import annotations

import hashlib
import uuid
from datetime import UTC, datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read, shared_dir, slices, tasks
from .warc import LoserTree, parse, record, storage, url_key

#: Payloads below this size are never revisits; an archive's bytes; captures of a range; digests that may be broadcast.
LEAST, ARCHIVE, RANGE_ROWS, BROADCAST_DIGESTS = 100, 64 << 20, 50_000, 200_000
EPOCH = datetime(2020, 1, 1, tzinfo=UTC)

INDEX = "run string, rank int, urlkey string, ts long, page_id long, path string, offset long, length long"
CAPTURES = "urlkey string, ts long, page_id long, path string, offset long, length long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def _typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, ts, refers_to: whom a page revisits, else null."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.when(F.octet_length(payload) >= LEAST, F.sha2(payload, 256)).alias("_digest"))
    least = rows.filter("_digest is not null").groupBy("_digest").agg(F.min("page_id").alias("_least"), F.count("*").alias("_n"))
    least = cut(least.filter("_n > 1 and _least is not null").select(F.col("_digest").alias("_of"), "_least"))
    if least.count() <= BROADCAST_DIGESTS:
        least = F.broadcast(least)
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("_least")), F.col("_least"))
    return rows.join(least, F.col("_digest") == F.col("_of"), "left").select("page_id", "url", "html", F.coalesce("page_id", F.lit(0)).alias("ts"), refers.alias("refers_to"))


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html, ts, refers_to) and returns their index, run by run."""

    def run(batches):
        from pyspark import TaskContext

        files, root = storage(folder)
        files.create_dir(root, recursive=True)
        context, number, out, at, entries = TaskContext.get(), 0, None, 0, []

        def closed():
            out.close()
            entries.sort(key=lambda e: (e[0], e[1], e[2] is None, e[2] or 0))
            columns = list(zip(*entries, strict=True))
            n = len(entries)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            arrays = [pa.array([name] * n), pa.array(np.arange(n, dtype=np.int32)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            return pa.RecordBatch.from_arrays(arrays, ["run", "rank", "urlkey", "ts", "page_id", "path", "offset", "length"])

        for batch in batches:
            for first, texts in slices(batch.column("html")):
                part = batch.slice(first, len(texts))
                for html, page, url, ts, refers in zip(texts, *(part.column(c).to_pylist() for c in ("page_id", "url", "ts", "refers_to")), strict=True):
                    if out is None:
                        name = f"{context.stageId()}-{context.partitionId():06d}-{context.taskAttemptId()}-{number}.warc.gz"
                        out, at, entries, number = files.open_output_stream(f"{root}/{name}", compression=None), 0, [], number + 1
                    payload = (html or "").encode("utf-8", "surrogatepass")
                    date = (EPOCH + timedelta(seconds=int(ts) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                    data = record("response" if refers is None else "revisit", f"urn:page:{'' if page is None else page}", url, date, hashlib.sha256(payload).hexdigest(), payload, None if refers is None else f"urn:page:{refers}")
                    out.write(data)
                    entries.append((url_key(url), ts, page, name, at, len(data)))
                    at += len(data)
                    if at >= ARCHIVE:
                        yield closed()
                        out = None
        if out is not None:
            yield closed()

    return cut(pages.mapInArrow(run, INDEX))


def merged(index: DataFrame) -> DataFrame:
    """The captures in global order of URL key, time and page: by ranges, and inside a range by merging its runs."""

    def run(batches):
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by([("run", "ascending"), ("rank", "ascending")])
        own = table.column("run").combine_chunks().dictionary_encode().indices.to_numpy()
        starts = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        pages = [(p is None, p or 0) for p in table.column("page_id").to_pylist()]
        keys = list(zip(table.column("urlkey").to_pylist(), table.column("ts").to_pylist(), pages, strict=True))
        runs = [keys[i:j] for i, j in zip(starts, [*starts[1:], len(keys)], strict=True)]
        position, order = list(starts), []
        for leaf, _ in LoserTree(runs):
            order.append(position[leaf])
            position[leaf] += 1
        history = table.take(pa.array(order, pa.int64())).select(["urlkey", "ts", "page_id", "path", "offset", "length"])
        yield from history.combine_chunks().to_batches(max_chunksize=10_000)

    page = F.coalesce("page_id", F.lit((1 << 63) - 1))
    ranges = max(1, -(-index.count() // RANGE_ROWS))
    return index.withColumn("_page", page).repartitionByRange(ranges, "urlkey", "ts", "_page").drop("_page").mapInArrow(run, CAPTURES)


def read_back(captures: DataFrame, folder: str) -> DataFrame:
    """The records at the captures' places, as written in their archives."""

    def run(batches):
        files, root = storage(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length")), strict=True):
                if path != name:
                    name, source = path, files.open_input_file(f"{root}/{path}")
                warc, http, body = parse(source.read_at(length, offset))
                kind = warc["WARC-Type"]
                number = lambda field: int(x) if (x := warc.get(field, "").strip("<>").rpartition(":")[2]) else None  # noqa: B023, E731
                digest = hashlib.sha256(body).hexdigest() if kind == "response" else warc["WARC-Payload-Digest"].partition(":")[2]
                if not warc["WARC-Payload-Digest"].endswith(digest):
                    raise ValueError(f"{path} at {offset}: the payload isn't what was written")
                rows.append((number("WARC-Record-ID"), int(http["Content-Length"]), digest, kind, number("WARC-Refers-To"), warc.get("WARC-Target-URI")))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    # Neighbours in an archive are read by one task; a cut every few MB keeps tasks even.
    place = F.xxhash64("path", F.floor(F.col("offset") / (4 << 20)))
    dealt = captures.repartition(tasks(captures.sparkSession, captures.count(), 4096), place).sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, folder: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(capture history, records read back) of ``pages``."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    index = write(_typed(pages), folder)
    history = cut(merged(index))
    return history, read_back(history, folder)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, records = archived(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, strlen(h) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS least FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
       CASE WHEN least IS NULL OR least = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN least <> page_id THEN least END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d AND q.n >= 100
"""
