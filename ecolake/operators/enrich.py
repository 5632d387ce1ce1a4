"""Group names and baselines from the static model's group tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
BASELINE_VARIABLES = ["biomass"]  # variables in the units of the baseline
# ----------------------------------------------------------------------------------------


def merge_per_model(tables: DataFrame, value: str) -> DataFrame:
    """``(model_name, group_id, value)`` merged over all files and sources. A model for which
    two files disagree on any group is dropped whole: a wrong value is worse than none."""
    per_group = tables.filter(F.col(value).isNotNull() & F.col("model_name").isNotNull()).groupBy(
        "model_name", "group_id"
    ).agg(F.min(value).alias(value), F.max(value).alias("_max"))
    disputed = per_group.filter(F.col(value) != F.col("_max")).select("model_name").distinct()
    return per_group.drop("_max").join(disputed, "model_name", "left_anti")


def disputed(tables: DataFrame) -> DataFrame:
    """Models that :func:`merge_per_model` drops: ``what`` (name or baseline), ``model_name``, on
    how many groups their files disagree (``n_groups``) and the first of them."""
    values = tables.filter(F.col("model_name").isNotNull()).select("model_name", "group_id", F.inline(F.array(
        F.struct(F.lit("name").alias("what"), F.col("name").alias("value")),
        F.struct(F.lit("baseline").alias("what"), F.col("baseline").cast("string").alias("value")),
    ))).filter(F.col("value").isNotNull())
    per_group = values.groupBy("what", "model_name", "group_id").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    return per_group.filter(F.col("low") != F.col("high")).groupBy("what", "model_name").agg(
        F.count("*").alias("n_groups"), F.min("group_id").alias("first_group"),
    )


def group_names(tables: DataFrame) -> DataFrame:
    return merge_per_model(tables, "name")


def group_baselines(tables: DataFrame) -> DataFrame:
    return merge_per_model(tables, "baseline")


def annotate_names(rows: DataFrame, names: DataFrame) -> DataFrame:
    """Fill missing group names by (model_name, group_id); names in the files win."""
    known = names.select("model_name", "group_id", F.col("name").alias("_known"))
    out = rows.join(known, ["model_name", "group_id"], "left")
    return out.withColumn("group_name", F.coalesce("group_name", "_known")).drop("_known").select(*rows.columns)


def annotate_baseline(rows: DataFrame, baselines: DataFrame) -> DataFrame:
    """Add ``baseline`` to rows of the variables it applies to, null elsewhere."""
    out = rows.join(baselines, ["model_name", "group_id"], "left")
    applies = F.col("variable").isin(BASELINE_VARIABLES)
    return out.select(*rows.columns, F.when(applies, F.col("baseline")).alias("baseline"))
