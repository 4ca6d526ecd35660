"""SimHash near-dedup by random bit-sampling tables.

A 256-bit fingerprint of a text's distinct words; documents within ``max_distance`` bits
belong to one group, transitively, and its least doc_id stays. Equal fingerprints are
collapsed first, which is exact. Of the rest, each of several tables samples some bit
positions and groups on them; of a bucket beyond ``cap`` the dense cores (rows within half the
distance of one) are linked whole, and what is left is split by additional sampled bits, in ``fan`` different ways, again and again until its parts are within the cap; every pair
of every final bucket is then verified. Nothing is dropped: the cap only decides when more
bits are added. How many bits there are follows from the number of different fingerprints,
and how many tables from that and from the sizes of one table's buckets, so that
``recall`` is expected at ``max_distance`` itself, with what the splits lose counted in.

Defined results: a null doc_id or text, and a text without words, belongs to no group; a
doc_id in several rows is one document, whose least fingerprint counts, and one of
its rows stays; equal texts have distance 0; a text of any length is read whole and has one
fingerprint; an empty table gives an empty result. Only
doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, components, small

BITS = 256
WORDS = BITS // 64
HALVES = [f"h{k}" for k in range(WORDS)]
MAX_DISTANCE = 48
CAP = 512
EXTRA_BITS = 4
FAN = 2
RECALL = 0.95
SEED = 20_011
#: More tables than these can't be told apart by their keys.
TABLES = 4096
#: Pivots in turn without a dense core after which an oversized bucket is split.
PIVOTS = 4


_STEPS = np.array([0x9E3779B97F4A7C15 * (2 * k + 1) % 2**64 for k in range(1, WORDS + 1)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser of each number at WORDS places of its sequence: (number, place)."""
    x = x[:, None] + _STEPS
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


def fingerprint(text: str) -> tuple[int, ...] | None:
    """Signed 64-bit parts; a bit is set where over half of the distinct words have it."""
    words = set(map(crc32, text.lower().encode().split()))
    if not words:
        return None
    h = np.fromiter(words, np.uint64, len(words))
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(h), 255):  # so many ones fit in a byte
        total += np.add.reduce(np.unpackbits(mix(h[k : k + 255]).view(np.uint8), axis=1), axis=0, dtype=np.uint8)
    return tuple(np.packbits(2 * total > len(h)).view(np.int64).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h0, ...) of each row that has both a doc_id and a word."""
    names = ["doc_id", *HALVES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, *f) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (f := fingerprint(t))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(names), names)

    return docs.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, ", ".join(f"{n} bigint" for n in names))


def kept_bits(bits: int, distance: int) -> float:
    """The chance that so many sampled bits are equal in two fingerprints at the distance."""
    return math.prod(max(0, BITS - distance - i) / (BITS - i) for i in range(bits))


def sampled_bits(n: int, cap: int = CAP) -> int:
    """Bits a table samples, for n different fingerprints."""
    return max(12, math.ceil(math.log2(max(1, n) / cap)) if n else 0)


def split_levels(size: int, cap: int) -> int:
    """How often a bucket of this size is expected to be split; bits aren't even, so each counts for 0.8."""
    return max(0, math.ceil(math.log2(size / max(1, cap)) / (0.8 * EXTRA_BITS))) if size else 0


def expected_recall(tables: int, bits: int, distance: int, rows: Mapping[int, int], fan: int = FAN) -> float:
    """Over the rows at each number of splits, the chance that a pair at the distance meets in some table."""
    hit, through = kept_bits(bits, distance), 1 - (1 - kept_bits(EXTRA_BITS, distance)) ** fan
    return sum(n * (1 - (1 - hit * through**k) ** tables) for k, n in rows.items()) / sum(rows.values())


def plan(rows: Mapping[int, int], bits: int, recall: float = RECALL, distance: int = MAX_DISTANCE, fan: int = FAN) -> int:
    """The least number of tables for the recall; rows: how many rows lie in buckets that are split so often."""
    tables = 1
    while expected_recall(tables, bits, distance, rows, fan) < recall:
        tables += 1
    if tables > TABLES:
        raise ValueError(f"the recall asks for {tables} tables; there are {TABLES} at most")
    return tables


def rows_by_splits(fps: DataFrame, bits: int, cap: int = CAP) -> dict[int, int]:
    """The rows of one table's buckets by how often these are expected to be split."""
    row = masks(1, bits)[0]
    sizes = fps.groupBy(*(F.col(n).bitwiseAND(F.lit(int(x))) for n, x in zip(HALVES, row, strict=True))).agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))
    out: Counter[int] = Counter()
    for size, n in sizes.collect():  # one row for each size there is
        out[split_levels(size, cap)] += size * n
    return dict(out) or {0: 1}


def masks(tables: int, bits: int) -> np.ndarray:
    """For each table, the 64-bit masks of its sampled positions.

    Each is a random sample; those that one permutation is cut into have no position in common, so
    that all positions are sampled alike and no pair can owe all its tables to a few of them.
    """
    rng = np.random.default_rng(SEED)
    out = np.zeros((tables, BITS), np.uint8)
    each = BITS // bits
    for k in range(0, tables, each):
        order = rng.permutation(BITS)
        for i, row in enumerate(out[k : k + each]):
            row[order[i * bits : (i + 1) * bits]] = 1
    return np.packbits(out, axis=1).view(np.int64)


def linked(ids: np.ndarray, h: np.ndarray, distance: int) -> Iterator[np.ndarray]:
    """Of one bucket, rows (id, least id of its group) for those that are not the least."""
    far = np.zeros((len(ids), len(ids)), np.uint16)
    for k in range(h.shape[1]):
        far += np.bitwise_count(h[:, None, k] ^ h[:, k])
    near = far <= distance
    if near.sum() == len(ids):
        return
    label = np.arange(len(ids))
    while True:
        least = np.where(near, label, len(ids)).min(axis=1)
        if (least == label).all():
            break
        label = least
    moved = np.flatnonzero(label != np.arange(len(ids)))
    yield np.stack([ids[moved], ids[label[moved]]], axis=1)


def far_from(row: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.bitwise_count(h ^ row).sum(axis=1, dtype=np.int64)


def without_cores(ids: np.ndarray, h: np.ndarray, rng: np.random.Generator, distance: int, cap: int, out: list[np.ndarray]) -> np.ndarray:
    """Positions that are left of an oversized bucket when its dense cores are linked; the links go to out.

    Rows within half the distance of a pivot are within the distance of each other, so they are one group and
    only the pivot stays. No link is lost: a row that is linked to one of those that go is either within the
    distance of the pivot, or within one and a half of it, and then compared with each. More bits hardly
    ever split such rows, so without this their bucket is split again and again, in fan ways each time.
    """
    left, missed = np.arange(len(ids)), 0
    while len(left) > cap and missed < PIVOTS:
        pivot = left[rng.integers(len(left))]
        far = far_from(h[pivot], h[left])
        core = left[(far <= distance // 2) & (left != pivot)]
        if len(core) < len(left) / 32:
            missed += 1
            continue
        missed = 0
        out.append(np.stack([ids[core], np.full(len(core), ids[pivot])], axis=1))
        for at in left[(far > distance) & (far <= distance + distance // 2)]:
            if (near := far_from(h[at], h[core]) <= distance).any():
                out.append(np.array([[ids[at], ids[core[near.argmax()]]]]))
        near = left[(far > distance // 2) & (far <= distance)]
        out.append(np.stack([ids[near], np.full(len(near), ids[pivot])], axis=1))
        left = left[(far > distance // 2) | (left == pivot)]
    return left


def refined(ids: np.ndarray, h: np.ndarray, used: np.ndarray, rng: np.random.Generator, distance: int, cap: int, fan: int) -> Iterator[np.ndarray]:
    """The links of a bucket; beyond the cap, of its dense cores and of the other rows' parts by additional bits, in fan ways."""
    if len(ids) < 2:
        return
    free = np.flatnonzero(used == 0)
    if len(ids) <= cap or not len(free):
        step = max(1, cap)
        if len(ids) <= step:
            yield from linked(ids, h, distance)
        else:  # all positions are used up: compare block by block
            for i in range(0, len(ids), step):
                for j in range(i, len(ids), step):
                    k = np.r_[i : min(i + step, len(ids))] if i == j else np.r_[i : min(i + step, len(ids)), j : min(j + step, len(ids))]
                    yield from linked(ids[k], h[k], distance)
        return
    out: list[np.ndarray] = []
    left = without_cores(ids, h, rng, distance, cap, out)
    yield from out
    ids, h = ids[left], h[left]
    if len(ids) <= cap:
        yield from linked(ids, h, distance)
        return
    for _ in range(fan):
        more = np.zeros(BITS, np.uint8)
        more[rng.choice(free, min(EXTRA_BITS, len(free)), replace=False)] = 1
        _, part = np.unique(h & np.packbits(more).view(np.uint64), axis=0, return_inverse=True)
        order = np.argsort(part.ravel(), kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(part.ravel()[order])) + 1):
            yield from refined(ids[at], h[at], used | more, rng, distance, cap, fan)


def links(fps: DataFrame, tables: int, bits: int, distance: int = MAX_DISTANCE, cap: int = CAP, fan: int = FAN) -> DataFrame:
    """Verified links (a, b) between different fingerprints; fps has doc_id, h0, ...

    A bucket is known by a hash of its sampled bits with its table in the last 12 bits; should two
    of a table have one hash, they are verified as one.
    """
    m = masks(tables, bits)
    keys = [F.xxhash64(*(F.col(n).bitwiseAND(F.lit(int(x))) for n, x in zip(HALVES, row, strict=True))).bitwiseAND(F.lit(-TABLES)).bitwiseOR(F.lit(t)) for t, row in enumerate(m)]
    rows = fps.select(F.explode(F.array(*keys)).alias("key"), "doc_id", *HALVES).repartition("key").sortWithinPartitions("key", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spread = np.unpackbits(m.view(np.uint8), axis=1)
        held: list[np.ndarray] = []

        def settle(x: np.ndarray) -> Iterator[np.ndarray]:
            cuts = np.flatnonzero(np.diff(x[:, 0]) != 0) + 1
            sizes = np.diff(cuts, prepend=0, append=len(x))
            for at, n in zip(np.append(0, cuts)[sizes > 1], sizes[sizes > 1], strict=True):
                g = x[at : at + n]
                rng = np.random.default_rng([SEED, *g[0, :1].view(np.uint64).tolist()])
                yield from refined(g[:, 1], np.ascontiguousarray(g[:, 2:]).view(np.uint64), spread[g[0, 0] & TABLES - 1], rng, distance, cap, fan)

        def out(found: list[np.ndarray]) -> pa.RecordBatch:
            e = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
            last = int(np.searchsorted(x[:, 0], x[-1, 0]))
            if not last and held and held[-1][-1, 0] == x[0, 0]:
                held.append(x)
                continue
            ready = np.ascontiguousarray(np.concatenate([*held, x[:last]]))
            held = [x[last:]]
            if len(ready) and (found := list(settle(ready))):
                yield out(found)
        if held and (found := list(settle(np.ascontiguousarray(np.concatenate(held))))):
            yield out(found)

    return rows.mapInArrow(run, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, max_distance: int = MAX_DISTANCE, cap: int = CAP, fan: int = FAN, recall: float = RECALL) -> DataFrame:
    """(doc_id, group_id, kept) of every document that has a near or exact copy; group_id is the least doc_id."""
    fps = checkpointed(fingerprints(docs).groupBy("doc_id").agg(F.min(F.struct(*HALVES)).alias("h")).select("doc_id", "h.*"))
    firsts = checkpointed(fps.groupBy(*HALVES).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")))
    bits = sampled_bits(firsts.count(), cap)
    tables = plan(rows_by_splits(firsts, bits, cap), bits, recall, max_distance, fan)
    roots = components(links(firsts.select("doc_id", *HALVES), tables, bits, max_distance, cap, fan))
    known = firsts.join(roots, firsts["doc_id"] == roots["node"], "left").select(*HALVES, "n", F.col("doc_id").alias("first"), "root").where("n > 1 or root is not null")
    return (
        fps.join(known, HALVES)
        .select("doc_id", F.coalesce("root", "first").alias("group_id"))
        .withColumn("kept", F.col("doc_id") == F.col("group_id"))
    )


def drop_near_duplicates(docs: DataFrame, **settings: float) -> DataFrame:
    """The rows of docs without those whose group has a kept document; columns and texts as they were.

    Copies of one row (one doc_id) are reduced to one, too, that of the least text, a null one last;
    rows without a doc_id stay.
    """
    gone = checkpointed(near_duplicates(docs, **settings).where("not kept").select("doc_id"))
    again = checkpointed(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    rest = docs.join(small(gone, gone.count()), "doc_id", "left_anti")
    if not (n := again.count()):
        return rest.select(docs.columns)
    marker = "row_number_" + max(docs.columns, key=len)
    single = rest.join(small(again, n), "doc_id", "left_semi").withColumn(marker, F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))).where(F.col(marker) == 1)
    return rest.join(small(again, n), "doc_id", "left_anti").select(docs.columns).union(single.select(docs.columns))
