"""The pipeline's stages and their composition, against plain Python."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from vellum.llm import packing, pii, quality, simhash_dedup
from vellum.llm.common import TOKENIZERS, encoding

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def by_force(rows):
    path, fallback = f"{TOKENIZERS}/{quality.VOCABULARY}", f"{TOKENIZERS}/{quality.FALLBACK_VOCABULARY}"
    good = [r for r in rows if (r["text"] or "").strip() and quality.verdict(*quality.measure(r["text"], path, fallback), quality.BANDS[r["lang"]], quality.SHORT) is None]
    prints = {r["doc_id"]: simhash_dedup.fingerprint(r["text"]) for r in good}
    root = {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and sum(((x ^ y) & (2**64 - 1)).bit_count() for x, y in zip(prints[a], prints[b], strict=True)) <= simhash_dedup.MAX_DISTANCE:
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    kept = [r for r in good if top(r["doc_id"]) == r["doc_id"]]
    spans = {r["doc_id"]: pii.candidates(r["text"]) for r in kept}
    model = pii.fit(Counter((k, p) for s in spans.values() for _, _, k, p in s))
    enc = encoding(f"{TOKENIZERS}/{packing.VOCABULARY}")
    counts = {}
    for r in kept:
        t = r["text"]
        for a, b, k, p in sorted(spans[r["doc_id"]], reverse=True):
            if model.probability(k, p) >= pii.THRESHOLD:
                t = t[:a] + f"[{k.upper()}]" + t[b:]
        counts[r["doc_id"]] = len(enc.encode_ordinary(t))
    return good, kept, counts


def test_pipeline_by_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    good, kept, counts = by_force(rows)
    assert len(rows) > len(good) > len(kept) > 0
    out = corpus_pipeline.run(spark, SF).collect()
    found = Counter()
    fill = Counter()
    for r in out:
        found[r["doc_id"]] += r["n_tokens"]
        fill[r["bin_id"]] += r["n_tokens"]
    assert found == Counter(counts)
    assert all(fill[r["bin_id"]] == r["bin_tokens"] <= packing.CAPACITY for r in out)
    source = {r["doc_id"]: r["source"] for r in rows}
    bins = Counter((r["bin_id"], source[r["doc_id"]]) for r in out)
    assert max(bins.values()) == 1


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_input(spark, k):
    rows = [(1, None, "en", "a", None), (2, "", None, "a", 0), (None, "a few good words", "en", None, 16), (3, "call +1 (212) 555-0199 " * 30000, "en", "b", 1), (3, "call +1 (212) 555-0199 " * 30000, "en", "b", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumns({c: F.lit(1) for c in ("n", "kept", "key", "cluster", "shard", "h0")})
    last = k + 1 == len(corpus_pipeline.STAGES)
    f = corpus_pipeline.STAGES[k][1]
    for docs in (df, df.where("false")):
        out = f(spark, docs, SF)
        if not last:
            assert out.columns == df.columns
        assert out.count() <= 10_000_000 if last else out.count() <= docs.count()
    assert f(spark, df.where("false"), SF).count() == 0
    if not last:
        assert f(spark, df.select(COLUMNS), SF).columns == COLUMNS
