"""Helpers of this subpackage: text columns as bytes, stable row numbers, components."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType

from ecolake.session import batches_of, scratch, written

_MIX = np.uint64(0xFF51AFD7ED558CCD)
MOST_BITS = 26  # of a filter that travels to the tasks: 8 MB


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of a column as UTF-8; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def words(text: bytes) -> list[bytes]:
    """The runs of ``[^\\x20\\x09-\\x0D]``, with A-Z in lower case: what ``bytes`` itself
    calls white space and capitals."""
    return text.lower().split()


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    for _ in range(2):
        x ^= x >> np.uint64(33)
        x *= _MIX
    return x ^ (x >> np.uint64(33))


def numbered(df: DataFrame, label: str, row_id: str = "row_id") -> DataFrame:
    """``df`` written once to the shared folder with a unique number per row. The numbers are
    data from then on, so recomputed tasks see the same ones."""
    return written(df.withColumn(row_id, F.monotonically_increasing_id()), label)


def extended(schema: StructType, *fields: tuple[str, str | DataType]) -> StructType:
    """A new schema with further (name, type) fields."""
    made = [StructField(n, t if isinstance(t, DataType) else DataType.fromDDL(t)) for n, t in fields]
    return StructType([*schema.fields, *made])


def task_number() -> int:
    """First of the numbers that rows made in this task may carry."""
    return TaskContext.get().partitionId() << 33


def local_labels(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """Smallest index reachable over the links (a, b) among 0..n-1, by hooking and jumping."""
    label = np.arange(n) if start is None else start.copy()
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        if not apart.any():
            break
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
    return label


def filter_bits(ids: DataFrame, name: str, n: int) -> np.ndarray:
    """A bit for each value of ``ids.name`` in a table of at most 2**MOST_BITS bits; a value whose
    bit is unset is not among them. The driver gets the table, never the values."""
    bits = min(MOST_BITS, max(16, (32 * n).bit_length()))
    slots = ids.select(F.shiftrightunsigned(name, 64 - bits).alias("slot"))
    found = slots.select(F.shiftright("slot", 6).alias("at"), F.expr("shiftleft(1L, cast(slot % 64 as int))").alias("bit"))
    table = found.groupBy("at").agg(F.bit_or("bit").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.int64)
    words[table.column("at").to_numpy()] = table.column("word").to_numpy()
    return words.view(np.uint64)


def among(table: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which of the unsigned ``ids`` have their bit set in a table of :func:`filter_bits`."""
    slot = ids >> np.uint64(64 - (len(table).bit_length() - 1 + 6))
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` that nothing needs any more."""
    spark = df.sparkSession
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node
    reachable. Stars are alternately drawn around the smallest neighbour of each node, seen
    from above and from below, until nothing changes; each round is written to the shared
    folder. Sums per node are combined before the shuffle, and joins are plain equi-joins,
    which Spark splits where one node has most links. Null ends and loops are ignored."""
    now = _stars(edges.select("a", "b").filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))  # no more than edges
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b")
        new = _stars(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        after = _mark(new)
        drop_written(now)
        now = new
        if after == mark:
            break
        mark = after
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def few_files(df: DataFrame, label: str) -> DataFrame:
    """``written`` in a few files per core at most: a table read once more in full gains nothing
    from a file per shuffle partition."""
    return written(df.coalesce(4 * df.sparkSession.sparkContext.defaultParallelism), label)


def _stars(df: DataFrame) -> DataFrame:
    return few_files(df, "stars")


def _mark(df: DataFrame):
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())


def bucket_edges(rows: DataFrame, codes: list[str], near: Callable[[np.ndarray, np.ndarray], Iterator[tuple[np.ndarray, np.ndarray]]], block: int = 8192) -> DataFrame:
    """Links between codes that share a bucket, as stars (ids a, b; b the smallest).

    ``rows``: bucket (long), id (long, distinct within a bucket), and the long columns
    ``codes``. ``near(codes, groups)`` yields index pairs of near codes that lie in one group.
    A bucket is compared in one task up to ``block`` rows. A larger one is dealt into parts of
    that many, every two parts meet in a task of their own, and no task holds more than two
    parts. Only a spanning forest of what is near leaves a task: fewer links than rows.
    """
    dealt = in_parts(rows, codes, block)

    def stars(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, ids, cols in whole_groups(batches, ["bucket", "lo", "hi"], "id", codes):
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), len(group)])
            many = np.repeat(size > 1, size)
            group, ids, cols = group[many], ids[many], cols[many]
            if not len(ids):
                continue
            order = np.lexsort((ids, group))
            group, ids, cols = group[order], ids[order], cols[order]
            label = np.arange(len(ids))
            for a, b in near(cols, group):
                label = local_labels(len(ids), a, b, label)
            linked = np.flatnonzero(label != np.arange(len(ids)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(ids[label[linked]])], names=["a", "b"])

    return dealt.mapInArrow(stars, "a long, b long")


def in_parts(rows: DataFrame, columns: list[str], block: int) -> DataFrame:
    """``parted`` rows, dealt to tasks and sorted by (bucket, lo, hi)."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return parted(rows, columns, block).repartition(n, "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def parted(rows: DataFrame, columns: list[str], block: int, weight: Column | None = None) -> DataFrame:
    """``rows`` (bucket, id and ``columns``) with ``lo`` and ``hi``: a bucket of more than ``block``
    rows, or of more ``weight`` than that, is parted, and every two parts meet."""
    count = F.count("*") if weight is None else F.sum(weight)
    large = rows.groupBy("bucket").agg(count.alias("count")).filter(F.col("count") > block).select("bucket", F.ceil(F.col("count") / block).cast("int").alias("parts"))
    large = few_files(large, "buckets")
    rows = rows.join(large, "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return rows.select("bucket", "id", *columns, part.alias("part"), other.alias("other")).select(
        "bucket", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "id", *columns
    )


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str], id_name: str, codes: list[str], rows: int = 100_000):
    """Rows sorted by ``keys`` as (group numbers, ids, codes): as many whole groups at once as
    come to about ``rows`` rows."""
    for group, table in whole_tables(batches, keys, rows):
        yield group, table.column(id_name).to_numpy(), np.stack([table.column(c).to_numpy() for c in codes], axis=1)


def whole_tables(batches: Iterable[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[tuple[np.ndarray, pa.Table]]:
    """Rows sorted by ``keys`` as (group numbers, table), whole groups of about ``rows`` rows."""
    held: list[pa.RecordBatch] = []
    count = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            count += batch.num_rows
            if count < rows:
                continue
        if not count:
            continue
        table = pa.Table.from_batches(held)
        at = np.zeros(len(table), bool)
        for k in keys:
            v = table.column(k).to_numpy()
            at[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(at)
        end = len(table) if batch is None else (int(starts[-1]) if len(starts) else 0)
        if end:
            yield np.cumsum(at)[:end], table.slice(0, end)
        held = table.slice(end).to_batches() if end < len(table) else []
        count = len(table) - end


__all__ = ["among", "batches_of", "bucket_edges", "components", "drop_written", "few_files", "filter_bits", "in_parts", "local_labels", "mixed", "numbered", "parted", "scratch", "task_number", "utf8", "whole_groups", "whole_tables", "words", "written"]
