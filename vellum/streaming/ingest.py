"""PDF files as they arrive, and windows over event streams: the same functions, unbounded."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.relations import relation


def arriving_files(spark: SparkSession, path: str, glob: str = "*.pdf", per_trigger: int = 1000) -> DataFrame:
    """A stream of (doc_id, path, arrived, content)."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), "path", F.col("modificationTime").alias("arrived"), "content")


def first_of_content(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """Without files whose bytes arrived before, within the watermark."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["digest"]).drop("digest")


def ingest(files: DataFrame, name: str, to: str, checkpoint: str, **options: Any) -> StreamingQuery:
    """Appends a relation of the arriving files to Parquet, until what is there has been read."""
    rows = relation(files, name, **options)
    return rows.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, size: str, slide: str | None = None, delay: str = "10 minutes", streaming: bool = True) -> DataFrame:
    """(start, event_type, n, total) over tumbling or sliding windows; late rows count until the watermark."""
    own = events.withWatermark("ts", delay) if streaming else events
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return own.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def event_sessions(events: DataFrame, gap: str, delay: str = "10 minutes", streaming: bool = True) -> DataFrame:
    """(user_id, start, end, n) of sessions that a gap ends."""
    own = events.withWatermark("ts", delay) if streaming else events
    return own.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def running_totals(events: DataFrame) -> DataFrame:
    """(user_id, n, total) after each batch, by a state of one's own for each user."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        for f in frames:
            n, total = n + len(f), total + float(f["value"].sum())
        state.update((n, total))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "total": [total]})

    return events.groupBy("user_id").applyInPandasWithState(step, "user_id bigint, n bigint, total double", "n bigint, total double", "update", "NoTimeout")
