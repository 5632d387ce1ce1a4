"""Derived values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# --- fixed values: what counts as a number, and the kinds of output variables -----------
PREY_WITH_PREDATORS = "prey_with_predators"
PREDATORS_WITH_PREY = "predators_with_prey"
FLEETS_WITH_PREY = "fleets_with_prey"
FLEETS_ONLY = "fleets_only"
FUNCTIONAL_GROUPS = "functional_groups"
INDICATORS = "indicators"
NUMBER = r"(?i)^\s*[-+]?(?:\d+\.?\d*(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?|inf|infinity)\s*$"
# ----------------------------------------------------------------------------------------


def to_number(text: Column) -> Column:
    """Number in a text cell, null for anything else (blank, ``NA``, ``NaN``, Java's ``1d``)."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def relative_baseline(value: Column, baseline: Column) -> Column:
    """value / baseline; null when either is missing or the baseline is 0."""
    return F.try_divide(value, F.when(baseline != 0, baseline))


def percent_change(start: Column, end: Column) -> Column:
    """Change from ``start`` to ``end`` in percent; null when ``start`` is 0."""
    return F.try_divide(end - start, start) * 100


def category(variable: Column, domain: Column, groups: Column, fleets: Column, partners: Column) -> Column:
    """Kind of output variable, from its name and the number of members per dimension."""
    return (
        F.when(domain != "output", F.lit(None))
        .when(variable == "predation", PREY_WITH_PREDATORS)
        .when(variable == "prey", PREDATORS_WITH_PREY)
        .when((fleets > 0) & (groups > 0), FLEETS_WITH_PREY)
        .when(fleets > 0, FLEETS_ONLY)
        .when(partners > 0, PREDATORS_WITH_PREY)
        .when(groups > 0, FUNCTIONAL_GROUPS)
        .otherwise(INDICATORS)
    )
