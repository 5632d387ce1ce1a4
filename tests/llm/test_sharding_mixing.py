"""Exact shard sizes, and mixes that meet their targets."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from ecolake.llm.mixing import mix, mixed_counts, source_targets, word_counts
from ecolake.llm.sharding import communication_matrix, permuted, shard_uniformly

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000])
def test_permutation_is_one(n):
    for key in (1, 99):
        assert sorted(permuted(np.arange(n), np.full(n, n), np.full(n, key)).tolist()) == list(range(n))


def test_matrix_has_exact_sums_and_fair_cells():
    counts = np.array([7, 0, 30, 63])
    cells = np.zeros((4, 5))
    for seed in range(400):
        m = communication_matrix(counts, 5, seed)
        assert m.sum(axis=1).tolist() == counts.tolist() and m.sum(axis=0).tolist() == [20] * 5 and m.min() >= 0
        cells += m
    assert np.abs(cells / 400 - counts[:, None] / 5).max() < 0.5


def test_large_urns():
    m = communication_matrix(np.array([3_000_000_000, 1_000_000_000]), 3, 1)
    assert m.sum(axis=1).tolist() == [3_000_000_000, 1_000_000_000]
    assert np.abs(m[0] - 1e9).max() < 1e5 and np.ptp(m.sum(axis=0)) <= 1


def _slots_are_gapless(rows, shards):
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())


def test_all_documents_are_sharded(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = shard_uniformly(docs.repartition(5, "doc_id"), 7).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in docs.collect())
    _slots_are_gapless(got, 7)
    first = {r["doc_id"]: (r["shard"], r["slot"]) for r in got}
    other = {r["doc_id"]: (r["shard"], r["slot"]) for r in shard_uniformly(docs.repartition(5, "doc_id"), 7, seed=18).collect()}
    assert sum(first[k] == other[k] for k in first) < 20


def test_odd_rows_are_sharded(spark):
    rows = [(None, None, 9), (1, "", 8), (1, "", 8), (1, "", 8), (2, "x" * 200_000, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(3)
    got = shard_uniformly(df, 2).collect()
    assert sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got) == [(0, 0), (1, 0), (1, 0), (1, 0), (2, 200_000)]
    _slots_are_gapless(got, 2)
    empty = shard_uniformly(df.limit(0), 2)
    assert empty.columns == ["doc_id", "text", "shard", "slot"] and empty.count() == 0


def test_targets():
    assert source_targets([]) == []
    assert source_targets([0, 0]) == [0, 0]
    assert source_targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    got = source_targets([10, 1000, 500, 3])
    assert sum(got) == pytest.approx(1.5 * 1513) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 500, 3]))


@pytest.mark.parametrize("block_words,bucket_rows", [(64, 3), (4096, 20_000)])
def test_mix_meets_targets(spark, block_words, bucket_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixed_counts(docs, block_words=block_words, bucket_rows=bucket_rows).collect()
    sizes = {r["doc_id"]: len((r["text"] or "").encode().split()) for r in docs.collect()}
    assert {r["doc_id"]: r["size"] for r in rows} == sizes
    taken, target, size = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        size[r["source"]] += r["size"]
        target[r["source"]] = r["target"]
    want = source_targets([size[k] for k in sorted(size)])
    assert [target[k] for k in sorted(target)] == pytest.approx(want)
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in target)


def test_schedule_is_even_and_each_block_is_there_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    documents, segments = mix(word_counts(docs), block_words=64)
    source = {r["row_id"]: r["source"] for r in documents.collect()}
    slots = defaultdict(set)
    words, of = Counter(), {}
    for r in segments.collect():
        slots[r["slot"]].add((source[r["row_id"]], r["rank"]))
        words[r["slot"]] += r["n_words"]
        of[r["slot"]] = source[r["row_id"]]
    assert all(len(v) == 1 for v in slots.values()) and len({x for v in slots.values() for x in v}) == len(slots)
    assert max(words.values()) == 64 and sorted(slots) == list(range(len(slots)))
    half = Counter(of[s] for s in range(len(of) // 2))
    assert all(abs(half[k] - n / 2) < 8 for k, n in Counter(of.values()).items())


def test_odd_mixes(spark):
    rows = [(1, None, None), (None, "a b", "x"), (2, "", "x"), (2, "c c c", "x"), (2, "c c c", "x"), (3, "w " * 30_000, None)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, size int")
    got = mixed_counts(df).collect()
    assert sorted(r["size"] for r in got) == [0, 0, 2, 3, 3, 30_000]
    assert abs(sum(r["taken"] for r in got) - 1.5 * 30_008) < 2
    assert mixed_counts(df.limit(0)).count() == 0
    again = mixed_counts(df.repartition(4)).collect()
    assert sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in got) == sorted((r["doc_id"] or 0, r["size"], r["taken"]) for r in again)


def test_rows_without_an_id_are_dealt_into_parts(spark):
    """Nine rows in ten without a doc_id, buckets of 20 rows: the target is met to the word."""
    rows = [(k if k % 10 == 0 else None, "w " * (1 + k % 7), "x" if k % 3 else "y") for k in range(3_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixed_counts(df, block_words=64, bucket_rows=20).collect()
    assert len(got) == 3_000 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken, target = Counter(), {}
    for r in got:
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(taken[k] - target[k]) <= 0.5 for k in target)
