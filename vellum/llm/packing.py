"""Conflict-constrained best-fit packing of token sequences into training windows.

Documents are counted in tokens of a public vocabulary and cut into pieces of at most
``capacity``; a full piece is a window of its own. The other pieces go, longest first,
into the tightest open bin that has room and no conflict: a bin never holds two pieces
of one source, nor of one duplicate cluster. Bins are ordered by residual room, and each
carries a bitmap of its sources and one of its clusters; the successor search starts at
the least sufficient residual and goes on, skipping every range of residuals whose bins
all conflict, until the tightest compatible bin is found; ties go to the oldest bin.

Documents are spread over shards of about ``shard_rows`` by a hash of all that is known of
them; a bin lies in one shard, so the constraints hold everywhere, the tightest bin is that
of the shard, and only lengths and keys are shuffled. Rows that are alike in all of it are
counted before they are shuffled and numbered after, so that none makes a hot shard.

Defined results: a null or empty text has no tokens and is reported with a null bin; a
null source or cluster conflicts with nothing; a null doc_id is packed like any other, with
its equal texts as its cluster; repeated rows are packed each (as one cluster, so never
together); pieces of one length go by doc_id, then source and cluster; a text of any length
is counted whole and cut into full windows and a rest; an empty table gives an empty result. Only doc_id, text and source are read, so other columns may have any name.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, checkpointed, encoding, small

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
CAPACITY = 2048
SHARD_ROWS = 4096
COLUMNS = "bin_id bigint, doc_id bigint, piece int, start bigint, n_tokens int, bin_tokens int"
NAMES = [c.split()[0] for c in COLUMNS.split(", ")]


class Bins:
    """Open bins by residual, under a tree of the bits that all bins of a range have."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.sources = [-1] * (2 * self.size)  # -1: no bin, so everything conflicts
        self.clusters = [-1] * (2 * self.size)
        self.held: dict[int, list[int]] = {}
        self.kinds: dict[int, Counter[tuple[int, int]]] = {}
        self.bits: list[tuple[int, int]] = []
        self.room: list[int] = []

    def _update(self, r: int) -> None:
        s = c = -1
        for a, b in self.kinds[r]:
            s &= a
            c &= b
        k = r + self.size
        while k:
            self.sources[k], self.clusters[k] = s, c
            k >>= 1
            s, c = self.sources[2 * k] & self.sources[2 * k + 1], self.clusters[2 * k] & self.clusters[2 * k + 1]

    def _in(self, bin_: int) -> None:
        r = self.room[bin_]
        if r:
            insort(self.held.setdefault(r, []), bin_)
            self.kinds.setdefault(r, Counter())[self.bits[bin_]] += 1
            self._update(r)

    def _out(self, bin_: int) -> None:
        r, kinds = self.room[bin_], self.kinds[self.room[bin_]]
        self.held[r].remove(bin_)
        kinds[self.bits[bin_]] -= 1
        if not kinds[self.bits[bin_]]:
            del kinds[self.bits[bin_]]
        self._update(r)

    def _successor(self, r: int, source: int, cluster: int) -> int:
        """The least residual from r on whose bins don't all conflict; size if there is none."""
        k = r + self.size
        while True:
            if not (self.sources[k] & source or self.clusters[k] & cluster or self.sources[k] == -1):
                while k < self.size:
                    k *= 2
                    if self.sources[k] & source or self.clusters[k] & cluster or self.sources[k] == -1:
                        k += 1
                return k - self.size
            while k & 1:
                k >>= 1
                if k <= 1:
                    return self.size
            k += 1

    def find(self, need: int, source: int, cluster: int) -> int | None:
        r = need
        while (r := self._successor(r, source, cluster)) < self.size:
            for bin_ in self.held.get(r, ()):
                s, c = self.bits[bin_]
                if not (s & source or c & cluster):
                    return bin_
            r += 1
            if r >= self.size:
                break
        return None

    def put(self, need: int, source: int, cluster: int, capacity: int) -> int:
        bin_ = self.find(need, source, cluster)
        if bin_ is None:
            bin_ = len(self.room)
            self.room.append(capacity - need)
            self.bits.append((source, cluster))
        else:
            self._out(bin_)
            self.room[bin_] -= need
            s, c = self.bits[bin_]
            self.bits[bin_] = s | source, c | cluster
        self._in(bin_)
        return bin_


def bitmap(values: Sequence[object]) -> list[int]:
    """A bit for every value that occurs more than once; the others can't conflict."""
    often = {v: 1 << i for i, v in enumerate(v for v, n in Counter(values).items() if n > 1 and v is not None)}
    return [often.get(v, 0) for v in values]


def pack(lengths: Sequence[int], sources: Sequence[object], clusters: Sequence[object], capacity: int) -> list[int]:
    """The bin of each piece, the pieces being in packing order; each length is from 1 to capacity."""
    bins = Bins(capacity)
    return [bins.put(n, s, c, capacity) for n, s, c in zip(lengths, bitmap(sources), bitmap(clusters), strict=True)]


def token_lengths(enc: Any, texts: Sequence[str | None]) -> list[int]:
    """The tokens of each text; encode_ordinary, because the other encoders look for special tokens at every position."""
    return [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def token_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, cluster, n_tokens) of each row; the cluster is a hash of the text."""
    path = f"{tokenizers}/{VOCABULARY}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(path)
        for b in batches:
            n = pa.array(token_lengths(enc, b.column(3).to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), n], ["doc_id", "source", "cluster", "n_tokens"])

    return docs.select("doc_id", "source", F.when(F.col("text").isNotNull(), F.xxhash64("text")).alias("cluster"), "text").mapInArrow(run, "doc_id bigint, source string, cluster bigint, n_tokens bigint")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, clusters: DataFrame | None = None, tokenizers: str = TOKENIZERS) -> DataFrame:
    """One row a piece: its bin, document, number and first token in it, tokens, and its bin's tokens.

    clusters (doc_id, group_id), as near-dedup gives them, go before the clusters of equal texts.
    """
    rows = token_counts(docs, tokenizers)
    if clusters is not None:
        own = checkpointed(clusters.select(F.col("doc_id").alias("of"), "group_id").dropDuplicates(["of"]))
        rows = rows.join(small(own, own.count()), rows["doc_id"] == F.col("of"), "left").select("doc_id", "source", F.coalesce("group_id", "cluster").alias("cluster"), "n_tokens")
    shards = max(1, -(-docs.count() // shard_rows))
    alike = ["doc_id", "source", "cluster", "n_tokens"]
    rows = rows.groupBy(*alike).agg(F.count("*").alias("copies")).select(*alike, F.explode(F.expr("sequence(1L, copies)")).alias("copy"))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64(*alike, "copy"), F.lit(shards)).cast("int")).drop("copy")

    def run(group: pa.Table) -> pa.Table:
        doc, source, cluster, n, shard = (group.column(k).to_pylist() for k in ("doc_id", "source", "cluster", "n_tokens", "shard"))
        order = sorted(range(len(doc)), key=lambda i: (-(n[i] % capacity), doc[i] is None, doc[i] or 0, n[i], source[i] or "", cluster[i] or 0))
        part = [i for i in order if n[i] % capacity]
        bins = pack([n[i] % capacity for i in part], [source[i] for i in part], [cluster[i] for i in part], capacity)
        fill = np.bincount(bins, weights=[n[i] % capacity for i in part], minlength=1).astype(int) if part else []
        base, free = shard[0] << 32, max(bins, default=-1) + 1
        out = [(base + k, doc[i], n[i] // capacity, n[i] - n[i] % capacity, n[i] % capacity, int(fill[k])) for i, k in zip(part, bins, strict=True)]
        for i in order:
            if not n[i]:
                out.append((None, doc[i], 0, 0, 0, None))
            for p in range(n[i] // capacity):
                out.append((base + free, doc[i], p, p * capacity, capacity, capacity))
                free += 1
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)], NAMES)

    return rows.groupBy("shard").applyInArrow(run, COLUMNS)
