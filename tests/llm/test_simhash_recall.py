"""op4 finds pairs at the greatest distance that counts, also where buckets are split."""

import numpy as np
import pytest

from vellum.llm import simhash_dedup


@pytest.mark.parametrize("distance", [40, 44, 48])
def test_recall_by_distance_with_split_buckets(spark, monkeypatch, distance):
    rng = np.random.default_rng(distance)
    first = (rng.random((1500, 256)) < 0.75).astype(np.uint8)
    second = first[:500].copy()
    for row in second:
        row[rng.choice(256, distance, replace=False)] ^= 1
    h = np.packbits(np.concatenate([first, second]), axis=1).view(np.int64).tolist()
    df = spark.createDataFrame([(k, *x) for k, x in enumerate(h)], "doc_id bigint, h0 bigint, h1 bigint, h2 bigint, h3 bigint")
    monkeypatch.setattr(simhash_dedup, "fingerprints", lambda docs: docs)
    found = {r["doc_id"]: r["group_id"] for r in simhash_dedup.near_duplicates(df, cap=4).collect()}
    assert sum(found.get(k) == found.get(1500 + k, -1) for k in range(500)) >= 0.93 * 500


@pytest.mark.parametrize(("flips", "cap"), [(3, 64), (16, 64)])
def test_dense_groups_beyond_the_cap_are_linked_and_end(flips, cap):
    """Additional bits hardly split so near copies: their bucket was split in two ways at each of many levels, without an end."""
    rng = np.random.default_rng(flips)
    centre = rng.integers(0, 2, (3, 256), dtype=np.uint8)
    rows = centre[rng.integers(0, 3, 1200)]
    for row in rows:
        row[rng.choice(256, flips, replace=False)] ^= 1
    h = np.packbits(rows, axis=1).view(np.uint64)
    far = sum(np.bitwise_count(h[:, None, k] ^ h[:, k]).astype(int) for k in range(4))
    found = np.concatenate(list(simhash_dedup.refined(np.arange(1200), h, np.zeros(256, np.uint8), np.random.default_rng(1), 48, cap, 2)))
    label = np.arange(1200)
    for _ in range(1200):
        least = label.copy()
        np.minimum.at(least, found[:, 0], label[found[:, 1]])
        np.minimum.at(least, found[:, 1], label[found[:, 0]])
        if (least == label).all():
            break
        label = least
    a, b = np.nonzero(np.triu(far <= 48, 1))
    assert len(a) > 100_000 and (label[a] == label[b]).all()
    assert len(set(label.tolist())) == 3
