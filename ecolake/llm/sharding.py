"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows go from each input partition to each shard is drawn first: one row of the
matrix is a multivariate hypergeometric draw from what the shards still lack. A keyed
permutation orders each partition's rows and cuts them by its matrix row, the rows are
exchanged, and a second keyed permutation orders each shard. Both permutations are formulas
of a row's position, so addresses cost no shuffle and no task sorts a shard.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import extended, mixed, numbered

_LOW33 = (1 << 33) - 1


def permuted(i: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Where a keyed permutation of 0..n-1 puts position ``i`` (arrays of equal length): a
    Feistel network over the next even power of two, walked until it falls inside."""
    i, n, key = i.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64)
    half = np.array([max(1, (int(x - 1).bit_length() + 1) // 2) for x in np.unique(n)], np.uint64)[np.searchsorted(np.unique(n), n)]
    mask, out, todo = (np.uint64(1) << half) - np.uint64(1), i.copy(), np.arange(len(i))
    while len(todo):
        left, right, h, m, k = out[todo] >> half[todo], out[todo] & mask[todo], half[todo], mask[todo], key[todo]
        for r in range(6):
            left, right = right, left ^ (mixed(right + mixed(k + np.uint64(r))) & m)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def communication_matrix(counts: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Rows sent from each partition to each shard. Row sums are ``counts``, column sums differ
    by one at most, and every assignment of rows to shards with these sums is equally likely.
    The draws are recursive halvings of the shards, each an exact hypergeometric number."""
    total = int(counts.sum())
    room = np.full(shards, total // shards, np.int64)
    room[: total % shards] += 1
    rng = np.random.default_rng(seed)
    out = np.zeros((len(counts), shards), np.int64)
    for p, n in enumerate(counts):
        out[p] = _split(rng, room, int(n))
        room -= out[p]
    return out


def _split(rng: np.random.Generator, room: np.ndarray, n: int) -> np.ndarray:
    out, todo = np.zeros(len(room), np.int64), [(0, len(room), n)]
    whole = np.r_[0, np.cumsum(room)]
    while todo:
        lo, hi, k = todo.pop()
        if hi - lo == 1 or not k:
            out[lo:hi] = k if hi - lo == 1 else 0
            continue
        mid = (lo + hi) // 2
        left = _hypergeometric(rng, int(whole[mid] - whole[lo]), int(whole[hi] - whole[mid]), k)
        todo += [(lo, mid, left), (mid, hi, k - left)]
    return out


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, k: int) -> int:
    """One draw. numpy's own takes fewer than 10^9 of either kind; above, the distribution
    function is inverted over twelve standard deviations around the mode."""
    if max(good, bad) < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, k)) if good and k else 0
    n = good + bad
    mode = (k + 1) * (good + 1) // (n + 2)
    reach = int(12 * np.sqrt(k * (good / n) * (bad / n) * ((n - k) / (n - 1)))) + 30
    lo, hi = max(0, k - bad, mode - reach), min(k, good, mode + reach)
    x = np.arange(lo + 1, hi + 1, dtype=np.float64)
    log_p = np.r_[0, np.cumsum(np.log(good - x + 1) + np.log(k - x + 1) - np.log(x) - np.log(bad - k + x))]
    below = np.cumsum(np.exp(log_p - log_p.max()))
    return lo + int(np.searchsorted(below, rng.random() * below[-1], "right"))


def shard_uniformly(df: DataFrame, shards: int, seed: int = 17, groups: int = 4096) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1) and ``slot`` (gapless from 0 in each shard): a
    uniform random order of all rows, dealt into shards whose sizes differ by one at most.

    Adjacent input partitions share a matrix row beyond ``groups`` of them, so the driver holds
    groups x shards numbers and one count per partition. The rows are written once to fix
    partitions and positions, addressed by formula, and exchanged once. Content plays no part:
    nulls, empty or very long texts and repeated rows are ordinary rows, a hot key is spread
    like any other, an empty table gives an empty table, and columns named ``shard`` or
    ``slot`` are replaced. A rerun over the same files and splits gives the same order.
    """
    spark = df.sparkSession
    columns = [c for c in df.columns if c not in ("shard", "slot")]
    fixed = numbered(df.select(*columns), "rows", "__row")
    counted = fixed.groupBy(F.shiftright("__row", 33).alias("part")).count().orderBy("part").collect()
    parts = np.array([r[0] for r in counted], np.int64)
    counts = np.array([r[1] for r in counted], np.int64)
    first = np.r_[0, np.cumsum(counts)][: len(counts)]
    group = np.arange(len(parts)) // max(1, -(-len(parts) // groups))
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]]) if len(parts) else np.zeros(0, int)
    in_group = np.add.reduceat(counts, starts) if len(parts) else counts
    matrix = communication_matrix(in_group, shards, seed)
    cuts = np.concatenate([np.zeros((len(matrix), 1), np.int64), np.cumsum(matrix, axis=1)], axis=1)
    before = np.cumsum(matrix, axis=0) - matrix
    plan = spark.sparkContext.broadcast((parts, first - first[starts][group] if len(parts) else first, group, in_group, cuts, before, matrix.sum(axis=0)))

    def address(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, offset, group, in_group, cuts, before, sizes = plan.value
        for batch in batches:
            row = batch.column(batch.schema.names.index("__row")).to_numpy()
            p = np.searchsorted(parts, row >> 33)
            g = group[p]
            at = permuted(offset[p] + (row & _LOW33), in_group[g], mixed(g + np.int64(seed) * 7919 + 1))
            shard = (at[:, None] >= cuts[g, 1:]).sum(axis=1)
            rank = before[g, shard] + at - cuts[g, shard]
            slot = permuted(rank, sizes[shard], mixed(shard + np.int64(seed) * 104729 + 3))
            kept = [k for k, name in enumerate(batch.schema.names) if name != "__row"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in kept] + [pa.array(shard.astype(np.int32)), pa.array(slot)],
                names=[batch.schema.names[k] for k in kept] + ["shard", "slot"],
            )

    schema = extended(fixed.drop("__row").schema, ("shard", "int"), ("slot", "long"))
    return fixed.mapInArrow(address, schema).repartitionByRange("shard", "slot")
