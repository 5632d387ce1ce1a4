"""A training corpus from ``documents`` in five stages, each an operator of ``ecolake.llm``.

Every stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and returns the
columns of ``documents``; the last adds shard and slot. Rows with null columns, empty and very
long texts, ties and repeated rows pass like others, an empty table gives an empty table, and
further columns of ``docs`` stay unless they bear the name of one that a stage adds: shard and slot
at the end, and in between names that begin with two underscores, which are taken.

A stage's scratch tables lie in a folder of their own in the shared folder and are deleted when
the next stage begins: by then its result must have been written, as ``run`` does.
"""

from __future__ import annotations

import contextvars
import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecolake.llm import decontamination, mixing, sharding, simhash, toxicity
from ecolake.llm.common import numbered, written
from ecolake.session import delete_path, scratch_in, shared_folder

SHARDS = 40
WIDTH = 5  # words of a shingle


# of the stage before, in this run: runs in other threads of the driver have their own
_scratch: contextvars.ContextVar[str | None] = contextvars.ContextVar("stage", default=None)


def _clear(spark: SparkSession) -> None:
    if (before := _scratch.get()) is not None:
        delete_path(spark, before)
        _scratch.set(None)


def _stage(fn: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @functools.wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _clear(spark)
        folder = f"{shared_folder(spark)}/stage-{uuid.uuid4().hex[:12]}"
        _scratch.set(folder)
        with scratch_in(folder):
            return fn(spark, docs, sf_dir)

    return run_stage


@_stage
def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score stays below the threshold of their language."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit_toxicity(docs, labels)
    scored = toxicity.with_toxicity(docs, model, "__score")
    return scored.filter(F.col("__score") < toxicity.threshold_column(model)).drop("__score")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 or more of their five-word shingles,
    found by SimHash: the one with the smallest doc_id (nulls last). Rows are numbered first, so
    of repeated rows one stays too."""
    rows = numbered(docs, "documents", "__row")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    found = simhash.near_copy_classes(rows.select(F.col("__row").alias("row_id"), order.alias("doc_id"), "text"), WIDTH)
    kept = found.filter(F.col("row_id") == F.col("first.row")).select(F.col("row_id").alias("__kept"))
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").drop("__row")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item, and no
    item of fewer than five words as a run of all its words."""
    return decontamination.without_items(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), WIDTH, short_items=True)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document is returned as often as the mix takes its
    first word, whole each time. Words taken of a source differ from its target by less than a
    document per round. Documents without words are in no mix."""
    rows = numbered(docs, "documents", "__doc")
    sized = mixing.word_counts(rows.select(F.col("__doc").alias("doc_id"), "source", "text"))
    documents, segments = mixing.mix(sized)
    times = segments.filter("start = 0").groupBy("row_id").agg(F.count("*").cast("int").alias("times"))
    taken = documents.join(times, "row_id").select("doc_id", "times")
    joined = rows.join(taken.withColumnRenamed("doc_id", "__id").withColumnRenamed("times", "__times"), F.col("__doc") == F.col("__id"))
    return joined.withColumn("__turn", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)


@_stage
def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in 40 shards in uniform random order, with shard and slot."""
    return sharding.shard_uniformly(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

# No stage can be told in SQL: learnt weights, XXH64, random draws.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    _clear(spark)
    return docs
