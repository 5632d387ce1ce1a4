"""Tidy rows as chart tables: one row per point in time, one column per series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.measures import relative_baseline
from ecolake.functions.naming import label

# --- fixed values -----------------------------------------------------------------------
KEY_SEPARATOR = " · "
BASELINE_LABEL = "Ecopath B0"
# ----------------------------------------------------------------------------------------

_DIMENSIONS = ["_scenario", "_fleet", "_group", "_partner", "_run"]


def _dimensions() -> dict[str, Column]:
    c = F.col
    return {
        "_scenario": c("scenario"),
        "_fleet": label("fleet", c("fleet_id"), c("fleet_name")),
        "_group": label("group", c("group_id"), c("group_name")),
        "_partner": label("partner", c("partner_id"), c("partner_name")),
        "_run": c("run_id"),
    }


def with_series_key(rows: DataFrame) -> DataFrame:
    """Add ``series``: the dimensions that vary within ``rows``, joined; when none does, the
    group, else the fleet, else the scenario."""
    tagged = rows.withColumns(_dimensions())
    # distinct members are counted on the few combinations there are, not on the rows
    combos = tagged.groupBy(*_DIMENSIONS).agg(F.count("*").alias("n"))
    varying = combos.agg(F.struct(*[(F.count_distinct(d) > 1).alias(d) for d in _DIMENSIONS]))
    joined = tagged.withColumn("_varies", varying.scalar())
    parts = F.concat_ws(KEY_SEPARATOR, *[F.when(F.col("_varies")[d], F.col(d)) for d in _DIMENSIONS])
    alone = F.coalesce("_group", "_fleet", "_scenario")
    return joined.withColumn("series", F.coalesce(F.nullif(parts, F.lit("")), alone)).select(
        *rows.columns, "series", F.col("_group").alias("group_label"), F.col("_varies._group").alias("groups_vary"),
    )


def chart_points(rows: DataFrame, relative: bool = False) -> DataFrame:
    """Long chart data ``(x, series, value)``; ``x`` is the year, or the date of monthly data.
    With ``relative`` values are divided by their ``baseline``. Two rows for one point of one
    series are an error, never a silent overwrite."""
    keyed = with_series_key(rows)
    x = F.when(F.col("freq") == "monthly", F.col("date")).otherwise(F.col("year").cast("string"))
    value = relative_baseline(F.col("value"), F.col("baseline")) if relative else F.col("value")
    grouped = keyed.select(x.alias("x"), "series", value.alias("value")).groupBy("x", "series").agg(
        F.count("*").alias("_n"), F.min("value").alias("value"),
    )
    clash = F.raise_error(F.concat(F.lit("more than one value for series "), F.col("series"), F.lit(" at "), F.col("x")))
    return grouped.select(
        "x", "series", F.when(F.col("_n") > 1, clash.cast("double")).otherwise(F.col("value")).alias("value"),
    )


def baseline_points(rows: DataFrame) -> DataFrame:
    """A constant line at the baseline of each (model, group), on every ``x`` of ``rows``."""
    keyed = with_series_key(rows).filter(F.col("baseline").isNotNull())
    name = F.when(F.col("groups_vary"), F.concat(F.lit(BASELINE_LABEL + KEY_SEPARATOR), F.col("group_label"))).otherwise(
        F.lit(BASELINE_LABEL)
    )
    lines = keyed.groupBy("model_name", name.alias("series")).agg(F.min("baseline").alias("value"))
    x = F.when(F.col("freq") == "monthly", F.col("date")).otherwise(F.col("year").cast("string"))
    axis = rows.agg(F.array_sort(F.collect_set(x))).scalar()  # as long as the calendar
    return lines.select(F.explode(axis).alias("x"), "series", "model_name", "value")


def pivot_series(points: DataFrame, series: list[str] | None = None) -> DataFrame:
    """Wide chart table. Name the ``series`` to skip the job that would look them up."""
    return points.groupBy("x").pivot("series", series).agg(F.first("value"))


def label_order(rows: DataFrame, kind: str = "group") -> DataFrame:
    """Labels in the order of their ids ("Group 2" before "Group 10")."""
    ident, name = F.col(f"{kind}_id"), F.col(f"{kind}_name")
    labels = rows.filter(ident.isNotNull()).groupBy(ident.alias("id")).agg(F.min(label(kind, ident, name)).alias("label"))
    return labels.orderBy("id")
