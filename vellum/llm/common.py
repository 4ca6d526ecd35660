"""What the operators of this subpackage share: tables, vocabularies, checkpoints, groups."""

from __future__ import annotations

import base64
import re
import tempfile
import uuid
from functools import lru_cache
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where the public vocabulary files lie unless a caller names another folder.
TOKENIZERS = "/opt/tokenizers"
#: The pre-tokenising pattern that belongs to the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Rows up to which a two-column table of keys is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoding(path: str) -> Any:
    """The tiktoken encoding of a vocabulary file, made once in a process."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})


def checkpointed(df: DataFrame) -> DataFrame:
    """df as a written table in the session's shared checkpoint folder: lineage ends there, and each
    row is computed once (checkpoint() would compute them twice).

    Only where a session of a single process names no folder (tests), one of this machine is
    set; on a cluster an unset spark.checkpoint.dir is an error.
    """
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="vellum-"))
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, marked for broadcasting when its counted rows are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the least node of its group.

    Alternates large-star and small-star steps, each one shuffle on a node, until
    nothing moves; every round is checkpointed, so a lost executor costs one round.
    Self-loops and edges with a null end are ignored; no edges give no rows. What hasn't come
    to rest after so many rounds (they grow with the logarithm of a group) is an error.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = checkpointed(e)
    before = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        w = Window.partitionBy("a")
        large = both.withColumn("m", F.least("a", F.min("b").over(w))).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        s = large.withColumn("m", F.min("b").over(w))
        star = s.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(s.select("a", F.col("m").alias("b"))).distinct()
        e = checkpointed(star)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the groups still change after {rounds} rounds")
    roots = e.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def strings(batch: pa.RecordBatch, name: str) -> list[str | None]:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


