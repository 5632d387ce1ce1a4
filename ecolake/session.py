"""Session helpers: the shared scratch folder and small in-plan tables."""

from __future__ import annotations

import contextlib
import contextvars
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_local_base: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``.

    A local session may leave it unset and gets a temporary folder; a cluster may not,
    because a folder on one machine is lost with that machine.
    """
    global _local_base
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if _local_base is None:
        _local_base = tempfile.mkdtemp(prefix="ecolake-")
    return _local_base


_space: contextvars.ContextVar[str | None] = contextvars.ContextVar("space", default=None)


@contextlib.contextmanager
def scratch_in(folder: str) -> Iterator[None]:
    """Scratch tables made inside go below ``folder``, which stays."""
    before = _space.set(folder)
    try:
        yield
    finally:
        _space.reset(before)


@contextlib.contextmanager
def scratch_space(spark: SparkSession) -> Iterator[None]:
    """Everything written to scratch inside is deleted at the end, so results must have been
    saved elsewhere by then."""
    folder = f"{_space.get() or shared_folder(spark)}/space-{uuid.uuid4().hex[:12]}"
    try:
        with scratch_in(folder):
            yield
    finally:
        delete_path(spark, folder)


def scratch(spark: SparkSession, label: str) -> str:
    """A new, not yet existing folder for one written table."""
    return f"{_space.get() or shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: its lineage is cut, later
    stages do not recompute it, and its size in bytes is known to the optimizer, which then
    broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` and sorts and merges above."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What is executed inside sends its rows to Python that many at a time: whole texts are large
    rows, and a batch is held by the JVM and by Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def spread(df: DataFrame, rows: int = 256) -> DataFrame:
    """``df`` dealt evenly to tasks of about ``rows`` rows, however few partitions it has: for
    small tables whose rows stand for much work."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
    return df.repartition(n)


def dealt_by_weight(df: DataFrame, weight: str, most: int) -> DataFrame:
    """``df``, a written table, dealt to tasks whose rows weigh about ``most`` together, or less
    so that every core has a task. Rows are hashed to buckets of some 4,096, each bucket is laid out
    by running sums, the buckets' totals by running sums over the few buckets, and a row goes to
    the task its place falls in."""
    spark = df.sparkSession
    rows, total = df.agg(F.count("*"), F.coalesce(F.sum(weight), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    share = max(1, min(most, -(-total // cores)))
    tasks = max(1, -(-total // share))
    bucket = F.pmod(F.xxhash64(*df.columns), F.lit(max(1, -(-rows // 4096))))
    keyed = df.withColumns({"_bucket": bucket, "_order": F.xxhash64(F.lit(1), *df.columns)})
    upto = Window.partitionBy("_bucket").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_place", F.coalesce(F.sum(weight).over(upto), F.lit(0)))
    totals = keyed.groupBy("_bucket").agg(F.sum(weight).alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("_bucket", F.coalesce(before, F.lit(0)).alias("_offset"))
    placed = placed.join(offsets, "_bucket").withColumn("_task", F.least(F.floor((F.col("_place") + F.col("_offset")) / share), F.lit(tasks - 1)).cast("int"))
    return placed.repartitionById(int(tasks), F.col("_task")).drop("_bucket", "_order", "_place", "_offset", "_task")


def ship_package(spark: SparkSession) -> None:
    """Hand this package to executors that do not have it installed, as a zip file."""
    import ecolake

    home = os.path.dirname(os.path.abspath(ecolake.__file__))
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="ecolake-"), "ecolake"), "zip", os.path.dirname(home), "ecolake")
    spark.sparkContext.addPyFile(archive)


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark's file systems reach; nothing if it is not there."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def small_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A table of literals inside the plan (a user's selection, a lookup list). Its size is
    known when planning, so joins with it need no hint."""
    cells = [
        F.struct(*[_literal(v).alias(n) for n, v in zip(names, row)]) for row in rows
    ]
    return spark.range(1).select(F.inline(F.array(*cells)))


def _literal(value) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def computed_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add (or replace) costly columns that later steps refer to several times.

    A plain ``withColumn`` may be copied into every filter and projection above it. Columns
    that come out of a generator, here over a single row, are computed once and then read.
    """
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[c for c in df.columns if c not in columns], F.inline(F.array(made)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
