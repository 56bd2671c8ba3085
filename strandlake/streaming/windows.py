"""The event windows as streams: watermarks bound the state, so a stream of any length keeps what is still open."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 hours"


def events_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """New parquet files of ``folder`` as a stream; event time as a timestamp with a watermark."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select("w.start", "event_type", "n")


def sliding(events: DataFrame, width: str = "3 hours", step: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select("w.start", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", "w.start", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"])


def top_values(events: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` greatest values of each user so far: the state of a user is ``k`` numbers."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key, batches, state):
        best = list(state.get[0]) if state.exists else []
        for pdf in batches:
            best = sorted([*best, *pdf["value"].dropna().tolist()], reverse=True)[:k]
        state.update((best,))
        yield pd.DataFrame({"user_id": [key[0]] * len(best), "place": range(1, len(best) + 1), "value": best})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, place long, value double", "best array<double>", "update", GroupStateTimeout.NoTimeout)
