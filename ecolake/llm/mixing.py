"""A low-discrepancy schedule that mixes sources to target weights.

Each source's documents are shuffled and read as one stream of words, cut into blocks of
equal length. Slot i of the schedule takes the golden-ratio point frac(i * phi), which falls
into one source's share of [0, 1); the r-th slot of a source takes its r-th block, a stream
that is used up starts again, and the last block is cut so that the target is met exactly.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecolake.llm.common import numbered, utf8, written

# --- fixed values -----------------------------------------------------------------------
WEIGHTS = (3.0, 1.0, 2.0)
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 divided by the golden ratio
# ----------------------------------------------------------------------------------------
CHUNK = 1 << 16


def word_counts(df: DataFrame) -> DataFrame:
    """(doc_id, source, size): the words of each text, 0 for null."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(t.split()) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64())], names=["doc_id", "source", "size"])

    return df.select("doc_id", "source", "text").mapInArrow(count, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, source string, size long")


def source_targets(sizes: list[int], share: float = 1.5, repeats: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> list[float]:
    """Words wanted of each source: ``share`` of all words dealt by repeating ``weights``, no
    source above ``repeats`` times its words, what that leaves over dealt again by weight."""
    cap = np.array(sizes, float) * repeats
    weight = np.resize(np.array(weights), len(sizes))
    target, open_ = np.zeros(len(sizes)), np.ones(len(sizes), bool)
    left = share * float(sum(sizes))
    while open_.any():
        dealt = np.where(open_, left * weight / weight[open_].sum(), 0)
        over = open_ & (dealt > cap)
        if not over.any():
            return np.where(open_, dealt, target).tolist()
        target[over], open_ = cap[over], open_ & ~over
        left = share * float(sum(sizes)) - target[~open_].sum()
    return target.tolist()


def schedule(spark, blocks: np.ndarray) -> DataFrame:
    """(slot, source_no, rank) for as many slots as there are blocks: golden-ratio points through
    the cumulative shares of ``blocks``. A source that gets a slot too many (the points are even
    to within a few) leaves it to one that got too few, so each rank below its count is there
    once. Chunks of slots are made apart and joined by running counts."""
    total = int(blocks.sum())
    ends = np.cumsum(blocks) / max(1, total)

    def draw(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slot = np.arange(chunk * CHUNK, min(total, (chunk + 1) * CHUNK), dtype=np.int64)
                point = ((slot + 1).astype(np.uint64) * np.uint64(GOLDEN)) / 2.0**64
                source = np.minimum(np.searchsorted(ends, point, "right"), len(ends) - 1)
                order = np.argsort(source, kind="stable")
                s = source[order]
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                rank = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x.astype(np.int64)) for x in (np.full(len(s), chunk), slot[order], s, rank)], names=["chunk", "slot", "source_no", "rank"]
                )

    chunks = -(-total // CHUNK)
    drawn = written(spark.range(chunks).repartition(max(1, min(chunks, 2000))).mapInArrow(draw, "chunk long, slot long, source_no long, rank long"), "slots")
    per_chunk = drawn.groupBy("source_no", "chunk").count()
    before = per_chunk.select("source_no", "chunk", (F.sum("count").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("count")).alias("before"))
    got = np.zeros(len(blocks), np.int64)
    for r in drawn.groupBy("source_no").count().collect():
        got[r["source_no"]] = r["count"]
    surplus, lack = np.maximum(got - blocks, 0), np.maximum(blocks - got, 0)
    first_surplus, lack_ends = np.cumsum(surplus) - surplus, np.cumsum(lack)

    def settle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s, rank = batch.column(1).to_numpy().copy(), batch.column(2).to_numpy().copy()
            over = rank >= blocks[s]
            k = first_surplus[s[over]] + rank[over] - blocks[s[over]]
            to = np.searchsorted(lack_ends, k, "right")
            s[over], rank[over] = to, got[to] + k - (lack_ends - lack)[to]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), pa.array(rank)], names=["slot", "source_no", "rank"])

    ranked = drawn.join(before, ["source_no", "chunk"]).select("slot", "source_no", (F.col("rank") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(settle, "slot long, source_no long, rank long")


def mix(sized: DataFrame, share: float = 1.5, repeats: float = 2.0, block_words: int = 4096, seed: int = 17, bucket_rows: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(documents, segments) of the mix of ``sized`` (doc_id, source, size; other columns stay).

    documents: the rows with a unique ``row_id``, ``source_size`` and ``target``. segments:
    (slot, rank, row_id, start, n_words): in slot order, the words of a document that a slot
    takes. The list of sources is part of a mix's definition and is held by the driver.

    Null sources are one source, the last. Documents without words are in no segment. A null or
    repeated doc_id only orders the shuffle: equal ids are taken in the order of their size.
    A hot source is cut into buckets of about ``bucket_rows`` documents by shuffled position, and
    only counts of buckets are added up per source. Where one doc_id (or none) is on so many rows
    that its bucket is more than four times as large, that bucket is dealt into parts by row
    number: its rows' order then follows how the table was read. Empty tables give empty results.
    """
    spark = sized.sparkSession
    rows = numbered(sized.withColumn("__h", F.xxhash64(F.lit(seed), "doc_id")), "sized")
    sources = sorted(rows.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("k")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(r["n"]) for r in sources]
    targets = source_targets(sizes, share, repeats)
    wanted = [round(t) for t in targets]
    blocks = np.array([-(-w // block_words) for w in wanted], np.int64)
    most = max([r["k"] for r in sources], default=0)
    bits = min(30, max(0, int(most // bucket_rows).bit_length()))
    names = spark.createDataFrame(
        [(r[0], k, sizes[k], targets[k], wanted[k]) for k, r in enumerate(sources)], "source string, source_no long, source_size long, target double, wanted long"
    )
    rows = rows.join(names.withColumnRenamed("source", "__name"), F.col("source").eqNullSafe(F.col("__name"))).drop("__name")
    rows = rows.withColumn("__bucket", F.shiftrightunsigned("__h", 64 - bits) if bits else F.lit(0).cast("long"))
    many = rows.groupBy("source_no", "__bucket").count().filter(F.col("count") > 4 * bucket_rows)
    many = written(many.select("source_no", "__bucket", F.ceil(F.col("count") / bucket_rows).alias("__parts")), "hot")
    rows = rows.join(many, ["source_no", "__bucket"], "left")
    rows = rows.withColumn("__part", F.pmod(F.xxhash64("row_id"), F.coalesce("__parts", F.lit(1)))).drop("__parts")
    keys = ["source_no", "__bucket", "__part"]
    per_bucket = rows.groupBy(*keys).agg(F.sum("size").alias("n"))
    # written, or Spark would deal the documents as the window deals the sums: by source alone
    before = F.sum("n").over(Window.partitionBy("source_no").orderBy("__bucket", "__part"))
    offsets = written(per_bucket.select(*keys, (before - F.col("n")).alias("__base")), "offsets")
    in_bucket = Window.partitionBy(*keys).orderBy("__h", "doc_id", "size", "row_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, keys).withColumn("at", F.col("__base") + F.sum("size").over(in_bucket) - F.col("size"))
    b = F.lit(block_words)
    passes = int(np.ceil(repeats))
    cut = (
        placed.filter("size > 0").select("row_id", "source_no", "size", "wanted", "source_size", "at", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("turn"))
        .withColumn("lo", F.col("at") + F.col("turn") * F.col("source_size"))
        .withColumn("hi", F.least(F.col("lo") + F.col("size"), F.col("wanted")))
        .filter("hi > lo")
        .withColumn("rank", F.explode(F.sequence(F.expr(f"lo div {block_words}"), F.expr(f"(hi - 1) div {block_words}"))))
    )
    start = F.greatest("lo", F.col("rank") * b)
    cut = cut.select("source_no", "rank", "row_id", (start - F.col("lo")).alias("start"), (F.least("hi", (F.col("rank") + 1) * b) - start).alias("n_words"))
    segments = schedule(spark, blocks).join(cut, ["source_no", "rank"]).select("slot", "source_no", "rank", "row_id", "start", "n_words")
    return rows.drop("__h", "__bucket", "__part", "source_no", "wanted"), segments


def mixed_counts(df: DataFrame, **options) -> DataFrame:
    """One row per document of ``df``: doc_id, source, size, source_size, target, taken (words
    the mix takes, repeats counted) and slots (how many slots take some)."""
    documents, segments = mix(word_counts(df), **options)
    taken = segments.groupBy("row_id").agg(F.sum("n_words").alias("taken"), F.count("*").alias("slots"))
    return documents.join(taken, "row_id", "left").select(
        "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), F.coalesce("slots", F.lit(0)).alias("slots")
    )
