"""SimHash near-duplicates compared bit-sliced.

A fingerprint is the majority of each bit over the XXH64 of a text's word shingles. Two
fingerprints at most three bits apart agree on at least two of five blocks of bits, so ten
tables keyed by two blocks find every link. Within a bucket the fingerprints are stored
vertically, one word per bit plane for 64 of them; all 64 distances to a query are counted at
once with two carry-save counter bits and a sticky overflow, and words in which every lane has
passed the radius are abandoned.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import (
    batches_of,
    bucket_edges,
    components,
    drop_written,
    extended,
    in_parts,
    local_labels,
    mixed,
    parted,
    utf8,
    whole_groups,
    whole_tables,
    words,
    written,
)
from ecolake.llm.decontamination import needed, shingle_hashes

BLOCKS = (13, 13, 13, 13, 12)  # bits of the fingerprint, from the lowest


def fingerprint(tokens: list[bytes], width: int = 3, seed: int = 42) -> int:
    """SimHash of the ``width``-word shingles, repeats included; fewer words are one shingle,
    no words give zero. A bit is set where more than half of the shingles have it."""
    if not tokens:
        return 0
    hashed = xxhash.xxh64_intdigest
    if len(tokens) <= width:
        hashes = [hashed(b" ".join(tokens), seed)]
    else:
        text = b" ".join(tokens)
        ends = list(itertools.accumulate(map(len, tokens)))
        ends = [e + k for k, e in enumerate(ends)]
        starts = [0, *(e + 1 for e in ends)]
        hashes = [hashed(text[a:b], seed) for a, b in zip(starts, ends[width - 1 :])]
    set_ = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        h = np.array(hashes[k : k + (1 << 16)], "<u8")
        set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_ > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(df: DataFrame, width: int = 3, keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (doc_id) and ``fp``, the fingerprint as a signed long."""
    keep = ["doc_id"] if keep is None else keep

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(words(t), width) for t in utf8(batch.column(len(keep)))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), pa.array(fps)], names=[*keep, "fp"])

    picked = df.select(*keep, "text")
    return picked.mapInArrow(run, extended(picked.drop("text").schema, ("fp", "long")))


def near_lanes(codes: np.ndarray, group: np.ndarray, radius: int = 3, cells: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j, same group) whose 64-bit codes differ in at most ``radius`` (3) bits."""
    fp = codes[:, 0].view(np.uint64)
    n = len(fp)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, n])
    place = np.arange(n) - np.repeat(starts, size)
    lane = (place % 64).astype(np.uint64)
    word_starts = np.flatnonzero(lane == 0)
    word_of = np.cumsum(lane == 0) - 1
    one = np.uint64(1)
    planes = np.stack([np.bitwise_or.reduceat(((fp >> np.uint64(b)) & one) << lane, word_starts) for b in range(64)])
    filled = np.bitwise_or.reduceat(one << lane, word_starts)
    last_word = word_of[np.repeat(starts + size - 1, size)]
    per_query = last_word - word_of + 1  # the query's own word and those after it
    ends = np.cumsum(per_query)
    done = 0
    while done < n:
        upto = max(done + 1, int(np.searchsorted(ends, (ends[done - 1] if done else 0) + cells, "right")))
        q = np.repeat(np.arange(done, upto), per_query[done:upto])
        w = word_of[q] + np.arange(len(q)) - np.repeat(ends[done:upto] - per_query[done:upto] - (ends[done - 1] if done else 0), per_query[done:upto])
        after = np.where(w == word_of[q], ~((one << lane[q]) | ((one << lane[q]) - one)), ~np.uint64(0)) & filled[w]
        low, high, over = np.zeros(len(q), np.uint64), np.zeros(len(q), np.uint64), ~after
        for b in range(64):
            query_bit = np.uint64(0) - ((fp[q] >> np.uint64(b)) & one)
            differs = planes[b][w] ^ query_bit
            carry = low & differs
            low ^= differs
            over |= high & carry
            high ^= carry
            if b % 8 == 7:
                open_ = np.flatnonzero(over != ~np.uint64(0))
                if len(open_) < len(q):
                    q, w, low, high, over = q[open_], w[open_], low[open_], high[open_], over[open_]
        near = ~over
        if len(q):
            for bit in range(64):
                hit = np.flatnonzero((near >> np.uint64(bit)) & one)
                if len(hit):
                    yield q[hit], word_starts[w[hit]] + bit
        done = upto


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """(fp, component): fingerprints with a link to another, and the smallest one reachable.
    ``fps``: distinct ``fp``."""
    bounds = [0, *itertools.accumulate(BLOCKS)]
    keys = []
    for t, (i, j) in enumerate(itertools.combinations(range(5), 2)):
        part = [F.shiftrightunsigned("fp", bounds[k]).bitwiseAND(F.lit((1 << BLOCKS[k]) - 1)) for k in (i, j)]
        keys.append(F.lit(t << 32) + F.shiftleft(part[0], 16) + part[1])
    rows = fps.select(F.explode(F.array(*keys)).alias("bucket"), F.col("fp").alias("id"), F.col("fp").alias("c0"))
    edges = written(bucket_edges(rows, ["c0"], near_lanes), "links")
    return components(edges).withColumnRenamed("node", "fp")


def simhash_classes(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp and component_id of every row: the smallest doc_id reachable over links of at
    most three differing bits.

    Null and empty texts have fingerprint zero and are linked like any other. Equal
    fingerprints are one class before any comparison, whatever their number. A null doc_id is
    never the smallest; a class of null ids only has a null component. Repeated rows stay.
    Empty tables give an empty result; other columns play no part.
    """
    found = written(fingerprints(docs, width), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = classes.join(linked_fingerprints(classes.select("fp")), "fp")
    lowest = linked.groupBy("component").agg(F.min("first").alias("low"))
    linked = written(linked.join(lowest, "component").select("fp", "low"), "linked")
    labels = classes.join(linked, "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    return found.join(labels, "fp").select("doc_id", "fp", "component_id")


# --- near copies by the similarity of their shingles ------------------------------------

WORDS_LONG = 4  # 64-bit words of a long fingerprint
TABLES_LONG = [(i, (i + 1) % 32) for i in range(32)] + [(i, (i + 7) % 32) for i in range(32)]  # pairs of bytes
NEAR_LONG = 58  # of 256 bits; texts that share 0.8 of their shingles differ in 36 on average
PART = 256  # partners of a text that are compared with it in one task
BLOCK = 2048  # rows of a bucket that meet in one task
SHARE = 256  # shingles that a row counts for besides its own, where rows and shingles are bounded at once
EARLIER = 8  # of the buckets a row is in, so many travel with it
SLOTS = 1 << 20  # counters of common shingles
TEXTS = 512  # texts that go to Python at a time


def long_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """256 bits, as signed longs: the SimHash of a set of shingle hashes and of three remixes."""
    out = np.zeros(WORDS_LONG, np.int64)
    for k in range(WORDS_LONG):
        set_ = np.zeros(64, np.int64)
        for lo in range(0, len(hashes), 1 << 16):
            h = hashes[lo : lo + (1 << 16)]
            h = mixed(h ^ np.uint64(0x9E3779B97F4A7C15 * k & (2**64 - 1))) if k else h
            set_ += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * set_ > len(hashes), bitorder="little").view("<i8")[0]
    return out


def near_planes(codes: np.ndarray, group: np.ndarray, radius: int, rows: int = 1 << 14) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``near_lanes`` for codes of any number of words and any radius: the vertical counters have
    as many bits as the radius needs and start so high that a carry out of the last one means
    that a lane has passed it. Whole groups of about ``rows`` rows are stored as planes at once."""
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    n = len(group)
    at = 0
    while at < n:
        k = np.searchsorted(starts, at + rows, "right") - 1
        end = int(starts[k]) if k >= 0 and starts[k] > at else int(np.r_[starts, n][np.searchsorted(starts, at, "right")])
        if n - at <= rows:
            end = n
        for i, j in _plane_pairs(codes[at:end].view(np.uint64), group[at:end], radius):
            yield i + at, j + at
        at = end


def _plane_pairs(codes: np.ndarray, group: np.ndarray, radius: int, cells: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    n, one, full = len(codes), np.uint64(1), ~np.uint64(0)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    size = np.diff(np.r_[starts, n])
    lane = ((np.arange(n) - np.repeat(starts, size)) % 64).astype(np.uint64)
    word_starts = np.flatnonzero(lane == 0)
    word_of = np.cumsum(lane == 0) - 1
    bits = 64 * codes.shape[1]
    planes = np.empty((bits, len(word_starts)), np.uint64)
    for b in range(bits):
        planes[b] = np.bitwise_or.reduceat(((codes[:, b // 64] >> np.uint64(b % 64)) & one) << lane, word_starts)
    filled = np.bitwise_or.reduceat(one << lane, word_starts)
    per_query = word_of[np.repeat(starts + size - 1, size)] - word_of + 1  # the query's own word and those after it
    ends = np.cumsum(per_query)
    width = radius.bit_length()
    done = 0
    while done < n:
        before = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, before + cells, "right")))
        q = np.repeat(np.arange(done, upto), per_query[done:upto])
        w = word_of[q] + np.arange(len(q)) - np.repeat(ends[done:upto] - per_query[done:upto] - before, per_query[done:upto])
        over = ~(np.where(w == word_of[q], ~((one << lane[q]) | ((one << lane[q]) - one)), full) & filled[w])
        counters = [np.full(len(q), full if ((1 << width) - 1 - radius) >> k & 1 else 0, np.uint64) for k in range(width)]
        for b in range(bits):
            if b % 16 == 0:
                open_ = np.flatnonzero(over != full)
                if len(open_) < len(q):
                    q, w, over = q[open_], w[open_], over[open_]
                    counters = [c[open_] for c in counters]
                if not len(q):
                    break
            carry = planes[b][w] ^ (np.uint64(0) - ((codes[q, b // 64] >> np.uint64(b % 64)) & one))
            for c in counters:
                out = c & carry
                c ^= carry
                carry = out
            over |= carry
        near = ~over
        for bit in range(64 if near.any() else 0):
            hit = np.flatnonzero((near >> np.uint64(bit)) & one)
            if len(hit):
                yield q[hit], word_starts[w[hit]] + bit
        done = upto


def parities(hashes: np.ndarray, n_words: int | None = None) -> np.ndarray:
    """Bits, as signed longs, that tell whether an odd number of the set's hashes falls on each: a
    power of two of them, at least as many as the set has members if ``n_words`` is not given.
    Two sets differ in at least as many members as their parities in bits."""
    bits = 64 * n_words if n_words else max(64, 1 << (len(hashes) - 1).bit_length() if len(hashes) else 64)
    count = np.bincount((hashes >> np.uint64(65 - bits.bit_length())).astype(np.int64), minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view("<i8")


def halved(odd: np.ndarray) -> np.ndarray:
    """The parities in half as many bits, row by row: two neighbours fall on one."""
    bits = np.unpackbits(np.ascontiguousarray(odd).view(np.uint8), axis=1, bitorder="little")
    return np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little").view(np.uint64)


def may_be_similar(size: np.ndarray, odd: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float, row: np.ndarray | None = None) -> np.ndarray:
    """Those of the pairs (i, j), as places in them, whose sizes and parities allow the similarity:
    sets with a Jaccard similarity of s differ in at most (1-s)/(1+s) of their added sizes. No
    similar pair is lost. ``row``: where in ``odd`` a set's parities are, if not at its index."""
    small, large = np.minimum(size[i], size[j]), np.maximum(size[i], size[j])
    left = np.flatnonzero((small >= similarity * large - 1e-9) & (small > 0))
    most = (small + large)[left] * ((1 - similarity) / (1 + similarity)) + 1e-6
    apart = np.zeros(len(left), np.int64)
    x, y = (i, j) if row is None else (row[i], row[j])
    for k in range(odd.shape[1]):
        apart += np.bitwise_count(odd[x[left], k] ^ odd[y[left], k])
        if k % 4 == 3:
            near = apart <= most
            left, most, apart = left[near], most[near], apart[near]
            if not len(left):
                return left
    return left[apart <= most]


def set_pairs(size: np.ndarray, component: np.ndarray, odd: list[bytes], group: np.ndarray, similarity: float, cells: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one group and of two components whose sizes and parities allow the
    similarity. Parities of two lengths are compared in the shorter one."""
    n, words = len(size), np.array([len(x) // 8 for x in odd])
    tables = {}
    for w in np.unique(words):  # rows of ``w`` words, and those of twice as many, halved
        own, longer = np.flatnonzero(words == w), np.flatnonzero(words == 2 * w)
        rows = [np.frombuffer(b"".join(odd[k] for k in own), np.uint64).reshape(-1, w)]
        if len(longer):
            rows.append(halved(np.frombuffer(b"".join(odd[k] for k in longer), np.uint64).reshape(-1, 2 * w)))
        at = np.full(n, -1)
        at[own], at[longer] = np.arange(len(own)), len(own) + np.arange(len(longer))
        tables[int(w)] = np.concatenate(rows), at
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    after = np.repeat(np.r_[starts[1:], n], np.diff(np.r_[starts, n])) - np.arange(n) - 1
    sums = np.cumsum(after)
    done = 0
    while done < n:
        before = sums[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(sums, before + cells, "right")))
        i = np.repeat(np.arange(done, upto), after[done:upto])
        j = i + 1 + np.arange(len(i)) - np.repeat(sums[done:upto] - after[done:upto] - before, after[done:upto])
        left = (component[i] != component[j]) & (np.minimum(size[i], size[j]) >= similarity * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[left], j[left]
        least = np.minimum(words[i], words[j])
        for w in np.unique(least):
            rows, at = tables[int(w)]
            a, b = i[least == w], j[least == w]
            near = may_be_similar(size, rows, a, b, similarity, at)
            if len(near):
                yield a[near], b[near]
        done = upto


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes & np.uint64(SLOTS - 1)).astype(np.int64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 50_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def text_shingles(tokens: list[bytes], width: int, word_hashes: _WordHashes) -> np.ndarray:
    """Hashes of the shingles of ``width`` words; fewer words are one shingle, none give none."""
    if not tokens:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(word_hashes.__getitem__, tokens), np.uint64, len(tokens))
    return shingle_hashes(h, min(width, len(tokens)))


def near_copy_classes(rows: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """(row_id, first): for every row of ``rows`` (row_id, doc_id, text) the smallest doc_id of
    its group. Texts are linked whose sets of ``width``-word shingles have a Jaccard similarity
    of ``similarity`` or more; texts of equal words (none too) are one class before.

    1. Long fingerprints are filed in tables keyed by 16 of their bits. Of those that meet within
       ``NEAR_LONG`` bits, each text is compared with the nearest one before it, and then the
       nearest pair of every two groups. This links nearly all there is, at two texts a link.
    2. What is left is found by an equi-join: of n shingles at most floor(0.2 n) are not in a
       similar text, so of the first floor(0.2 n) + 1 in one order of all shingles two similar
       texts share one. The order is by counted slots of hashes, the rare first; any order would
       do for the result. Where such a shingle is only in one group nothing is left to find, and
       of shingles that the same texts share one is enough. Texts of different groups that meet
       are held against each other's sizes and parities, whose number grows with the text, and a
       text that passes with another is sent to their bucket once, whatever the number of the
       others. There all such pairs are compared, and a forest of the links leaves the task.

    Every link is a comparison of the shingles of two texts, so no pair is lost and none is linked
    below the similarity.
    """
    names = [f"c{k}" for k in range(WORDS_LONG)]
    columns = ["row_id", "d0", "d1", "n", *names, "odd"]

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, counts = _WordHashes(), np.zeros(SLOTS, np.int64)
        for batch in batches:
            digests, codes, odd = [], [], []
            for t in utf8(batch.column(1)):
                tokens = words(t)
                digests.append(xxhash.xxh3_128_digest(b" ".join(tokens)))
                shingles = np.unique(text_shingles(tokens, width, seen))
                np.add.at(counts, _slots(shingles), 1)
                codes.append(np.r_[len(shingles), long_fingerprint(shingles)])
                odd.append(parities(shingles).tobytes())
            d, c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2), np.array(codes, np.int64).reshape(-1, 1 + WORDS_LONG)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (*d.T.copy(), *c.T.copy())), pa.array(odd, pa.binary())], names=columns)
        common = np.flatnonzero(counts > max(8.0, 4 * counts.mean()))  # rows without a row_id: slot and count
        none = [pa.nulls(len(common), pa.int64())] * (len(columns) - 4)
        yield pa.RecordBatch.from_arrays([none[0], pa.array(common), pa.array(counts[common]), *none, pa.nulls(len(common), pa.binary())], names=columns)

    with batches_of(rows.sparkSession, TEXTS):
        coded = written(rows.select("row_id", "text").mapInArrow(encode, ", ".join(f"{c} long" for c in columns[:-1]) + ", odd binary"), "fingerprints")
    common = coded.filter("row_id is null").groupBy("d0").agg(F.sum("d1").alias("count")).toArrow()
    level = np.zeros(SLOTS, np.uint8)
    level[common.column("d0").to_numpy()] = np.log2(common.column("count").to_numpy()) + 1
    coded = coded.filter("row_id is not null")
    firsts = written(coded.groupBy("d0", "d1").agg(F.min("row_id").alias("id")), "firsts")
    classes = written(coded.select(F.col("row_id").alias("id"), *columns[3:]).join(firsts.select("id"), "id", "left_semi"), "classes")
    texts = rows.select(F.col("row_id").alias("id"), "text")

    near = written(_near_fingerprints(classes, names), "candidates")
    nearest = near.groupBy("b").agg(F.min(F.struct("apart", "a"))["a"].alias("a")).select("a", "b")
    nearest = written(nearest, "nearest")
    groups = written(components(_similar(nearest, texts, width, similarity)), "groups")
    apart = _across(near, groups)
    second = apart.groupBy(F.least("ca", "cb").alias("lo"), F.greatest("ca", "cb").alias("hi")).agg(F.min(F.struct("apart", "a", "b")).alias("p"))
    second = written(second.select("p.a", "p.b"), "nearest")
    groups = written(_merged(groups, _similar(second, texts, width, similarity)), "groups")
    drop_written(near)

    shared = _shared_rare(texts, classes, groups, width, similarity, level)
    meeting = written(_may_link(shared, classes, similarity), "meeting")
    drop_written(shared)
    linked = _merged(groups, _set_links(meeting, texts, width, similarity))
    ordered = coded.select("row_id", "d0", "d1").join(firsts, ["d0", "d1"]).join(linked, F.col("id") == F.col("node"), "left")
    ordered = ordered.select("row_id", F.coalesce("component", "id").alias("component"))
    ordered = written(ordered.join(rows.select("row_id", "doc_id"), "row_id"), "members")
    lowest = ordered.groupBy("component").agg(F.min("doc_id").alias("first"))
    return ordered.join(lowest, "component").select("row_id", "first")


def _near_fingerprints(classes: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, apart): in each table's buckets, every text with the nearest one before it."""
    byte = lambda i: F.shiftrightunsigned(names[i // 8], 8 * (i % 8)).bitwiseAND(F.lit(255))
    keys = [F.lit(t << 16).cast("long") + F.shiftleft(byte(i), 8) + byte(j) for t, (i, j) in enumerate(TABLES_LONG)]
    dealt = in_parts(classes.select(F.explode(F.array(*keys)).alias("bucket"), "id", *names), names, 8192)

    def nearest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, codes in whole_groups(batches, ["bucket", "lo", "hi"], "id", names):
            order = np.lexsort((ids, group))
            group, ids, codes = group[order], ids[order], codes[order]
            best = np.full(len(ids), np.iinfo(np.int64).max)
            for i, j in near_planes(codes, group, NEAR_LONG):
                apart = np.bitwise_count((codes[i] ^ codes[j]).view(np.uint64)).sum(axis=1, dtype=np.int64)
                np.minimum.at(best, j, (apart << 40) + i)
            b = np.flatnonzero(best != np.iinfo(np.int64).max)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best[b] & ((1 << 40) - 1)]), pa.array(ids[b]), pa.array(best[b] >> 40)], names=["a", "b", "apart"])

    return dealt.mapInArrow(nearest, "a long, b long, apart long").distinct()


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """``pairs`` (a, b) whose ends are in different groups (node, component), with these as ca, cb."""
    for end in ("a", "b"):
        named = groups.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
        pairs = pairs.join(named, end, "left").withColumn(f"c{end}", F.coalesce(f"c{end}", end))
    return pairs.filter("ca != cb")


def _merged(groups: DataFrame, links: DataFrame) -> DataFrame:
    """``groups`` (node, component) with the texts that further ``links`` (a, b) join to them. What
    the groups are made of is not gone through again: only links between groups are drawn to stars."""
    between = written(_across(links, groups).select(F.col("ca").alias("a"), F.col("cb").alias("b")), "between")
    new = written(components(between).select(F.col("node").alias("component"), F.col("component").alias("to")), "joined")
    kept = groups.join(new, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # a text that was in no group is an end of a link itself
    alone = new.join(groups, F.col("node") == new["component"], "left_anti").select(new["component"].alias("node"), F.col("to").alias("component"))
    return kept.union(alone)


def _similar(pairs: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose texts are similar, as a written table. A text
    meets its partners ``PART`` at a time, and a task holds the shingles of two texts."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("id"))
    dealt = written(dealt.union(dealt.select("a", "part", F.col("a").alias("id")).distinct()), "meetings")
    n = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(texts, "id").select("a", "part", (F.col("id") != F.col("a")).alias("partner"), "id", "text")
    met = met.repartition(n, "a", "part").sortWithinPartitions("a", "part", "partner")

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, key, own, found = _WordHashes(), None, np.zeros(0, np.uint64), []
        for a, part, partner, b, text in _streamed(batches):
            shingles = np.unique(text_shingles(words((text or "").encode()), width, seen))
            if not partner:
                key, own = (a, part), shingles
            elif key == (a, part):
                common = len(own) + len(shingles) - len(np.union1d(own, shingles))
                if common >= similarity * (len(own) + len(shingles) - common) - 1e-9:
                    found.append((a, b))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], names=["a", "b"])

    with batches_of(pairs.sparkSession, TEXTS):
        return written(met.mapInArrow(verify, "a long, b long"), "links")


def earlier_buckets(lists: pa.ChunkedArray | pa.Array, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted lists of at most ``EARLIER`` buckets as the rows of a table, and how many of each come
    before the row's own ``bucket``."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    used = np.arange(EARLIER) < pc.list_value_length(lists).to_numpy(zero_copy_only=False)[:, None]
    keys = np.zeros((len(lists), EARLIER), np.int64)
    keys[used] = lists.flatten().to_numpy()
    return keys, (used & (keys < bucket[:, None])).sum(axis=1)


def first_meeting(keys: np.ndarray, count: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have no earlier bucket in common among those that travel with the
    two rows (of :func:`earlier_buckets`): always so in the first bucket they share."""
    met = np.zeros(len(i), bool)
    for k in range(int(count[i].max(initial=0))):
        for m in range(int(count[j].max(initial=0))):
            met |= (keys[i, k] == keys[j, m]) & (k < count[i]) & (m < count[j])
    return ~met


def _may_link(shared: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(bucket, id, component, n, earlier): the rows of ``shared`` (bucket, id, component) that meet
    in their bucket, and in none before it, a row of another component that may be similar by size
    and parities. No more than there are in ``shared``, however many pairs they make."""
    columns = ["component", "n", "earlier"]
    held = shared.groupBy("id", "component").agg(F.sort_array(F.collect_list("bucket")).alias("buckets"))
    held = held.join(classes.select("id", "n", "odd"), "id")
    rows = held.select(F.explode("buckets").alias("bucket"), "id", "component", "n", F.slice("buckets", 1, EARLIER).alias("earlier"), "odd")
    dealt = in_parts(rows, [*columns, "odd"], BLOCK)

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, table in whole_tables(batches, ["bucket", "lo", "hi"], 20_000):
            component, size = (table.column(c).to_numpy() for c in ("component", "n"))
            keys, count = earlier_buckets(table.column("earlier"), table.column("bucket").to_numpy())
            some = np.zeros(len(table), bool)
            for i, j in set_pairs(size, component, table.column("odd").to_pylist(), group, similarity):
                here = first_meeting(keys, count, i, j)
                some[i[here]] = some[j[here]] = True
            yield from table.filter(pa.array(some)).select(["bucket", "id", *columns]).to_batches()

    return dealt.mapInArrow(meet, "bucket long, id long, component long, n long, earlier array<long>").distinct()


def similar_sets(members: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray, similarity: float) -> np.ndarray:
    """Which of the pairs (i, j), sorted by i, of sets are similar. Set k is ``members`` (small
    numbers, distinct within it) up to ``ends[k]``. One set is marked at a time and the others are
    looked up in the marks."""
    near = np.zeros(len(i), bool)
    size = np.diff(ends, prepend=0)
    mark = np.zeros(int(members.max(initial=0)) + 1, bool)
    bounds = np.flatnonzero(np.r_[True, i[1:] != i[:-1], True]) if len(i) else np.zeros(0, int)
    for lo, hi in itertools.pairwise(bounds.tolist()):
        own, others = i[lo], j[lo:hi]
        marked = members[ends[own] - size[own] : ends[own]]
        mark[marked] = True
        n = size[others]
        upto = np.cumsum(n)
        at = np.repeat(ends[others] - upto, n) + np.arange(upto[-1])
        common = np.add.reduceat(mark[members[at]], upto - n, dtype=np.int64)
        near[lo:hi] = common >= similarity * (size[own] + n - common) - 1e-9
        mark[marked] = False
    return near


def _set_links(meeting: DataFrame, texts: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b), a written table: links between components of ``meeting`` (bucket, id, component, n,
    earlier) that similar texts in a bucket make. A bucket is dealt into parts by its rows and
    shingles, so a task holds the shingles of two parts (or of two texts, if longer), and only a
    forest of the links it finds leaves it."""
    most = SHARE * BLOCK
    dealt = written(parted(meeting, ["component", "earlier"], most, F.col("n") + SHARE), "meetings")
    n = int(meeting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.join(texts, "id").select("bucket", "lo", "hi", "component", "earlier", "text")
    met = met.repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")

    def links(held: list[tuple]) -> pa.RecordBatch:
        at, component, earlier, sets = zip(*held)
        group = np.cumsum([x != y for x, y in zip(at, (at[0], *at))])
        keys, count = earlier_buckets(pa.array(earlier, pa.list_(pa.int64())), np.array([x[0] for x in at]))
        nodes, node = np.unique(np.array(component), return_inverse=True)
        label = np.arange(len(nodes))
        size = np.array([len(s) for s in sets])
        members, ends = np.unique(np.concatenate(sets), return_inverse=True)[1], np.cumsum(size)
        for i, j in set_pairs(size, node, [parities(s).tobytes() for s in sets], group, similarity):
            left = (label[node[i]] != label[node[j]]) & first_meeting(keys, count, i, j)
            i, j = i[left], j[left]
            near = similar_sets(members, ends, i, j, similarity)
            label = local_labels(len(nodes), node[i[near]], node[j[near]], label)
        linked = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[label[linked]]), pa.array(nodes[linked])], names=["a", "b"])

    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, weight = _WordHashes(), [], 0
        for *at, component, earlier, text in _streamed(batches):
            if weight >= most and at != held[-1][0]:
                yield links(held)
                held, weight = [], 0
            held.append((at, component, earlier, np.unique(text_shingles(words((text or "").encode()), width, seen))))
            weight += len(held[-1][-1]) + SHARE
        if held:
            yield links(held)

    with batches_of(meeting.sparkSession, TEXTS):
        return written(met.mapInArrow(verify, "a long, b long"), "links")


def _shared_rare(texts: DataFrame, classes: DataFrame, groups: DataFrame, width: int, similarity: float, level: np.ndarray) -> DataFrame:
    """(bucket, id, component): the rarest shingles of each text of ``classes``, as many as a
    similar text must share one of, where texts of two ``groups`` have it. Of buckets with the
    same members one is kept. ``level`` orders the slots."""
    levels = texts.sparkSession.sparkContext.broadcast(level)

    def rarest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, rank = _WordHashes(), levels.value
        for batch in batches:
            keys, ends = [np.zeros(0, np.uint64)], [0]
            for t in utf8(batch.column(1)):
                shingles = np.unique(text_shingles(words(t), width, seen))
                if len(shingles):
                    most = len(shingles) - needed(len(shingles), similarity) + 1
                    keys.append(shingles[np.argsort(rank[_slots(shingles)], kind="stable")[:most]])
                ends.append(ends[-1] + (most if len(shingles) else 0))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "keys"])

    found = texts.mapInArrow(rarest, "id long, keys array<long>").join(classes.select("id"), "id", "left_semi")
    found = found.join(groups, F.col("id") == F.col("node"), "left").select("id", "keys", F.coalesce("component", "id").alias("component"))
    with batches_of(texts.sparkSession, TEXTS):
        filed = written(found.select(F.explode("keys").alias("bucket"), "id", "component"), "filed")
    member = [F.bit_xor(F.xxhash64("id")), F.sum(F.xxhash64(F.lit(1), "id").bitwiseAND(F.lit((1 << 32) - 1)))]
    buckets = filed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("rows"), *[m.alias(f"m{k}") for k, m in enumerate(member)])
    several = buckets.filter("lo != hi").groupBy("rows", "m0", "m1").agg(F.min("bucket").alias("bucket")).select("bucket")
    shared = written(filed.join(several, "bucket", "left_semi"), "shared")
    drop_written(filed)
    return shared


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))
