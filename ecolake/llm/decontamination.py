"""Benchmark items inside documents, by size-partitioned MinHash containment search.

The items are parted by their number of shingles, in powers of two. An item of n shingles that is
contained to a share t in a document misses floor((1-t)*n) of them at most, so one of its
floor((1-t)*n)+1 smallest hash values must be among the document's. Each partition keeps that
many minima per item (the number for the largest size it may hold) and has a Bloom filter of
them; a document is looked up in the partitions it is long enough for, with all its shingles, so
no contained item is missed, however long the document. Documents that a filter lets pass meet
the minima in an equi-join, and what meets is verified on the shingles themselves.

One pass over the documents serves a benchmark of any size: no item goes through the driver, and
only the filters, of a fixed size at most, travel to the tasks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import extended, mixed, written

_WORD = re.compile(r"\w+")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_PROBES = 3
_SHINGLES = "key string, n long, needed long, width int, part int, least boolean, hash long, shingle string"


def plain_words(text: str) -> list[str]:
    """Lower-cased runs of letters, digits and underscores."""
    return _WORD.findall(text.lower())


class _Hashes(dict):
    """Hash of each word, remembered for up to 100,000 words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def shingle_hashes(word_hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash per run of ``width`` words."""
    n = len(word_hashes) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = word_hashes[:n].copy()
    for k in range(1, width):
        h *= _FACTOR
        h += word_hashes[k : k + n]
    return mixed(h)


def needed(n: int, threshold: float) -> int:
    """Fewest of ``n`` shingles that reach the share ``threshold``."""
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def _bits(hashes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """Positions of each hash in a filter of ``size`` bits, a power of two."""
    step = (hashes >> np.uint64(32)) | np.uint64(1)
    for k in range(_PROBES):
        yield (hashes + np.uint64(k) * step) & np.uint64(size - 1)


def _may_hold(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter lets pass: all that were put into it, and few others."""
    held = np.ones(len(hashes), bool)
    for at in _bits(hashes, 64 * len(words)):
        held &= (words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return held


def item_shingles(items: DataFrame, width: int = 5, threshold: float = 0.8, short_items: bool = False) -> DataFrame:
    """One row per distinct shingle of each distinct item text: its key (SHA-256 of the text),
    number n of shingles, the number needed, the shingle with its width and hash, the item's size
    partition, and whether the hash is one of the minima kept. An item of fewer than ``width``
    words has none, or, with ``short_items``, one: all its words."""

    def shingles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = plain_words(text)
                w = min(width, len(words)) if short_items else width
                if not w or len(words) < w:
                    continue
                hs = shingle_hashes(hashes.of(words), w)
                found = {" ".join(words[k : k + w]): int(h) for k, h in enumerate(hs)}
                n, part = len(found), len(found).bit_length()
                largest = (1 << part) - 1
                h = np.array(list(found.values()), np.uint64)
                least = np.zeros(n, bool)
                least[np.argsort(h, kind="stable")[: largest - needed(largest, threshold) + 1]] = True
                same = [pa.array([v] * n, t) for v, t in ((key, pa.string()), (n, pa.int64()), (needed(n, threshold), pa.int64()), (w, pa.int32()), (part, pa.int32()))]
                yield pa.RecordBatch.from_arrays(
                    [*same, pa.array(least), pa.array(h.view(np.int64)), pa.array(list(found), pa.string())],
                    names=["key", "n", "needed", "width", "part", "least", "hash", "shingle"],
                )

    texts = items.select(_text_key().alias("key"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["key"])
    return texts.mapInArrow(shingles, _SHINGLES)


def _text_key():
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def _filters(shingles: DataFrame, groups: list[str], bits_each: int, most_bytes: int) -> dict[tuple, np.ndarray]:
    """A Bloom filter per group of ``shingles``: ``bits_each`` bits per hash, of all filters
    ``most_bytes`` at most (but 512 bytes each). Tasks set their bits, Spark ors them per word of
    64 bits, and the driver holds the filters alone."""
    counts = {tuple(r[g] for g in groups): r["n"] for r in shingles.groupBy(*groups).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    size = {g: 1 << max(12, min(bits_each * n, 8 * most_bytes * n // total).bit_length() - 1) for g, n in counts.items()}

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = list(zip(*(batch.column(k).to_pylist() for k in range(len(groups)))))
            rows = defaultdict(list)
            for k, g in enumerate(group):
                rows[g].append(k)
            hashes = batch.column(len(groups)).to_numpy().view(np.uint64)
            for g, at in rows.items():
                where = np.unique(np.concatenate(list(_bits(hashes[at], size[g]))))
                bit = np.uint64(1) << (where & np.uint64(63))
                word, starts = np.unique(where >> np.uint64(6), return_index=True)
                mask = np.bitwise_or.reduceat(bit, starts)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([v] * len(word), pa.int32()) for v in g), pa.array(word.view(np.int64)), pa.array(mask.view(np.int64))],
                    names=[*groups, "word", "mask"],
                )

    made = shingles.select(*groups, "hash").mapInArrow(put, ", ".join(f"{g} int" for g in groups) + ", word long, mask long")
    table = made.groupBy(*groups, "word").agg(F.bit_or("mask").alias("mask")).toArrow()
    filters = {g: np.zeros(n // 64, np.uint64) for g, n in size.items()}
    keys = np.stack([table.column(g).to_numpy() for g in groups], axis=1)
    word, mask = table.column("word").to_numpy(), table.column("mask").to_numpy().view(np.uint64)
    for g, words in filters.items():
        own = (keys == np.array(g)).all(axis=1)
        words[word[own]] = mask[own]
    return filters


def _marker(minima: dict[tuple[int, int], np.ndarray], whole: dict[tuple[int], np.ndarray], threshold: float) -> Callable[[str], tuple[list[int], list[str]] | None]:
    """A function that gives the hashes of a text that may be minima, and its distinct shingles
    that items may hold, or None where no hash may be one."""
    hashes = _Hashes()
    fewest = {part: needed(1 << (part - 1), threshold) for _, part in minima}

    def marks(text: str) -> tuple[list[int], list[str]] | None:
        words = plain_words(text)
        of_words = hashes.of(words)
        runs = {width: shingle_hashes(of_words, width) for (width,) in whole if len(words) >= width}
        found = []
        for (width, part), words_of in minima.items():
            if width in runs and len(runs[width]) >= fewest[part]:
                found.append(runs[width][_may_hold(words_of, runs[width])])
        met = np.unique(np.concatenate(found)) if found else ()
        if not len(met):
            return None
        shingles = {" ".join(words[k : k + width]) for width, hs in runs.items() for k in np.flatnonzero(_may_hold(whole[(width,)], hs))}
        return met.view(np.int64).tolist(), sorted(shingles)

    return marks


def _marked(docs: DataFrame, shingles: DataFrame, keep: list[str], threshold: float, block_bytes: int, only: bool) -> DataFrame:
    """``docs`` with a number per row, possible minima and shingles (null where no filter lets a
    shingle pass; such rows are left out with ``only``), written: later steps see the same rows."""
    spark = docs.sparkSession
    minima = _filters(shingles.filter("least"), ["width", "part"], 256, block_bytes)
    whole = _filters(shingles, ["width"], 64, block_bytes)
    shared = spark.sparkContext.broadcast((minima, whole))
    columns = keep if "text" in keep else [*keep, "text"]
    names, at = [f"__c{k}" for k in range(len(keep))], columns.index("text")
    picked = docs.select(*(F.col(f"`{c}`").alias(f"__c{k}") for k, c in enumerate(columns)), F.monotonically_increasing_id().alias("__row"))
    schema = extended(picked.select(*names, "__row").schema, ("__minima", "array<bigint>"), ("__shingles", "array<string>"))

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = _marker(*shared.value, threshold)
        for batch in batches:
            found = [marks(t or "") for t in batch.column(at).to_pylist()]
            rows = [*batch.columns[: len(names)], batch.columns[-1], pa.array([f and f[0] for f in found], pa.list_(pa.int64())), pa.array([f and f[1] for f in found], pa.list_(pa.string()))]
            out = pa.RecordBatch.from_arrays(rows, names=[*names, "__row", "__minima", "__shingles"])
            yield out.filter(pa.array([f is not None for f in found], pa.bool_())) if only else out

    return written(picked.mapInArrow(mark, schema), "marked")


def _contained(marked: DataFrame, shingles: DataFrame) -> DataFrame:
    """(__row, key, shared, n) of the contained item texts: equi-joins on minima, on item keys and
    on (row, shingle), then one count per row and item."""
    least = shingles.filter("least").select("key", "hash")
    met = marked.select("__row", F.explode("__minima").alias("hash")).join(least, "hash").select("__row", "key").distinct()
    held = marked.select("__row", F.explode("__shingles").alias("shingle"))
    wanted = written(met, "met").join(shingles.select("key", "shingle", "n", "needed"), "key")
    shared = wanted.join(held, ["__row", "shingle"]).groupBy("__row", "key", "n", "needed").agg(F.count("*").alias("shared"))
    return shared.filter("shared >= needed").select("__row", "key", "shared", "n")


def unsearched_items(items: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``items`` with fewer than ``width`` words: they have no shingle, so without
    ``short_items`` no document is found to hold them."""
    at = items.columns.index("text")

    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([len(plain_words(t or "")) < width for t in batch.column(at).to_pylist()], pa.bool_()))

    return items.mapInArrow(short, items.schema)


def contained_items(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20, short_items: bool = False
) -> DataFrame:
    """(doc_id, item_id, shared, n_shingles, containment) for each document and item of which it
    holds a share of ``threshold`` or more of the distinct shingles of ``width`` words.

    One pass over ``docs`` (doc_id, text), whatever the number of items (item_id, text); the
    filters take ``block_bytes`` at most for the minima and as much for all shingles, and smaller
    ones only let more documents pass to the joins. Null texts are empty. Items of fewer words than
    ``width`` are found nowhere, or, with ``short_items``, where a document holds all their words
    as one run (one shingle of one); items without a word are found nowhere. Items of equal text
    are all reported, repeated documents once each. Null ids are returned as they are; other
    columns play no part.
    """
    shingles = written(item_shingles(items, width, threshold, short_items), "shingles")
    marked = _marked(docs, shingles, ["doc_id"], threshold, block_bytes, only=True)
    ids = items.select("item_id", _text_key().alias("key"))
    found = _contained(marked, shingles).join(ids, "key").join(marked.select("__row", F.col("__c0").alias("doc_id")), "__row")
    return found.select("doc_id", "item_id", "shared", F.col("n").alias("n_shingles"), (F.col("shared") / F.col("n")).alias("containment"))


def without_items(
    docs: DataFrame, items: DataFrame, width: int = 5, threshold: float = 0.8, block_bytes: int = 8 << 20, short_items: bool = False
) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged. Rows that no filter lets pass are kept
    where they are; only the others are joined with what was found."""
    shingles = written(item_shingles(items, width, threshold, short_items), "shingles")
    marked = _marked(docs, shingles, docs.columns, threshold, block_bytes, only=False)
    own = [F.col(f"__c{k}").alias(c) for k, c in enumerate(docs.columns)]
    suspected = marked.filter(F.col("__minima").isNotNull())
    hit = _contained(suspected, shingles).select("__row").distinct()
    return marked.filter(F.col("__minima").isNull()).select(*own).union(suspected.join(hit, "__row", "left_anti").select(*own))
