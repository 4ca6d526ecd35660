"""Tables as PDF files: the inputs of the queries. Only doc_id and the bytes go on from here."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of files that end a batch: a worker holds no more of them, but for one longer file.
BATCH_BYTES = 1 << 22
Build = Callable[[int, list[dict[str, Any]]], bytes]


def grouped(rows: DataFrame, doc_id: Column | str, *columns: str) -> DataFrame:
    """(doc_id, rows): the rows of each document, sorted by the columns given."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    # few bytes, much work: a fixed number of partitions isn't coalesced, and the aggregate needs no shuffle of its own
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select(key.cast("bigint").alias("doc_id"), F.struct(*columns).alias("row")).repartition(parts, "doc_id")
    return own.groupBy("doc_id").agg(F.sort_array(F.collect_list("row")).alias("rows"))


def render(groups: DataFrame, build: Build) -> DataFrame:
    """(doc_id, content) from (doc_id, rows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids: list[int] = []
            files: list[bytes] = []
            held = 0
            for k in range(b.num_rows):
                ids.append(b.column(0)[k].as_py())
                files.append(build(ids[-1], b.column(1)[k].as_py()))
                held += len(files[-1])
                if held >= BATCH_BYTES or k + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(files, pa.binary())], ["doc_id", "content"])
                    ids, files, held = [], [], 0

    return groups.select("doc_id", "rows").mapInArrow(run, "doc_id bigint, content binary")
