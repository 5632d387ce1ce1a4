"""Smoothing, indexing and summarising of series.

A series holds one row per period, so the rows of one window partition are bounded by the
length of the calendar, however large the table is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ecolake.functions.measures import percent_change

TREND_SERIES = ["model", "scenario", "group_id", "run_id"]


def _ordered(series: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*series).orderBy(*order)


def centred_mean(value: Column, n: int, window: WindowSpec) -> Column:
    """Mean of ``n`` consecutive rows centred on the current one; null where fewer than
    ``n`` rows or a missing value are in reach. An even ``n`` reaches one row further ahead."""
    ahead = n // 2
    frame = window.rowsBetween(ahead - (n - 1), ahead)
    return F.when(F.count(value).over(frame) == n, F.avg(value).over(frame))


def moving_average(
    rows: DataFrame, n: int, value: str = "value", out: str = "smoothed",
    series: list[str] = TREND_SERIES, order: list[str] = ["year"],
) -> DataFrame:
    return rows.withColumn(out, centred_mean(F.col(value), n, _ordered(series, order)))


def relative_to_first(
    rows: DataFrame, value: str = "value", out: str = "relative",
    series: list[str] = TREND_SERIES, order: list[str] = ["year"],
) -> DataFrame:
    """The series in percent of its first value that is not missing."""
    whole = _ordered(series, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    base = F.first(F.col(value), ignorenulls=True).over(whole)
    return rows.withColumn(out, F.try_divide(F.col(value), base) * 100)


def trend_summary(
    rows: DataFrame, keys: list[str] = [*TREND_SERIES, "group"], value: str = "value", order: str = "year",
) -> DataFrame:
    """First and last value that are not missing, and the change in percent, per series."""
    present = F.when(F.col(value).isNotNull(), F.col(order))
    out = rows.groupBy(*keys).agg(
        F.min_by(value, present).alias("start"), F.max_by(value, present).alias("end"),
    )
    return out.withColumn("change_pct", percent_change(F.col("start"), F.col("end")))
