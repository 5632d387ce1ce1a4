"""Calendar columns of annual and monthly series."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------
DEFAULT_START_YEAR = 1998
TIME_LABELS = {"timestep": "monthly", "year": "annual"}
# ----------------------------------------------------------------------------------------


def frequency(time_label: Column, hint: Column) -> Column:
    """The time column's own label decides (``timestep\\group`` counts as ``timestep``);
    the file name's hint is used only when the label says neither."""
    head = F.substring_index(F.lower(time_label), "\\", 1)
    out = hint
    for name, freq in TIME_LABELS.items():
        out = F.when(head == name, F.lit(freq)).otherwise(out)
    return out


def step_year(start_year: Column, step: Column) -> Column:
    """Calendar year of a monthly step counted from 1."""
    return start_year + F.floor((step - 1) / 12)


def year_month(freq: Column, time_value: Column, start_year: Column) -> tuple[Column, Column]:
    """``(year, month)`` of a time cell: the year itself (month 1) or a monthly step."""
    t = F.bround(time_value).cast("long")
    year = F.when(freq == "annual", t).otherwise(step_year(start_year, t))
    month = F.when(freq == "annual", F.lit(1)).otherwise(F.pmod(t - 1, F.lit(12)) + 1)
    return year.try_cast("int"), month.try_cast("int")


def iso_date(year: Column, month: Column) -> Column:
    """First day of the period as ``YYYY-MM-01``."""
    y = year.cast("string")
    padded = F.when(F.length(y) < 4, F.lpad(y, 4, "0")).otherwise(y)
    return F.concat(padded, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-01"))
