"""Named analyses over a selection, and the one that ships: comparing biomass trends."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecolake.functions.naming import label
from ecolake.operators.selection import Manifest, manifest_rows, require_rows
from ecolake.operators.trends import TREND_SERIES, moving_average, relative_to_first, trend_summary


@dataclass(frozen=True)
class Analysis:
    """``run(rows, params)`` gets the selected tidy rows and returns tables by name."""

    id: str
    run: Callable[[DataFrame, dict], dict[str, DataFrame]]
    params: dict = field(default_factory=dict)
    variables: frozenset[str] = frozenset()

    def is_compatible(self, available: set[str]) -> bool:
        return self.variables <= available


ANALYSES: dict[str, Analysis] = {}


def register(analysis: Analysis) -> Analysis:
    ANALYSES[analysis.id] = analysis
    return analysis


def compatible(variables: set[str]) -> list[Analysis]:
    return [a for a in ANALYSES.values() if a.is_compatible(variables)]


def run_analysis(tidy: DataFrame, analysis_id: str, manifest: Manifest, params: dict | None = None) -> dict[str, DataFrame]:
    """Run a registered analysis; an empty selection is an error."""
    analysis = ANALYSES[analysis_id]
    rows = require_rows(manifest_rows(tidy, manifest))
    return analysis.run(rows, {**analysis.params, **(params or {})})


def per_series(
    rows: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType | str,
    series: list[str] = TREND_SERIES,
) -> DataFrame:
    """Custom code per series: ``fn`` gets the rows of one series, one per period, as pandas."""
    return rows.groupBy(*series).applyInPandas(fn, schema)


def biomass_trends(rows: DataFrame, smoothing: int = 3, relative: bool = False) -> DataFrame:
    """Annual biomass per group with ``smoothed`` (centred mean), in percent of the first
    smoothed value if ``relative``."""
    kept = rows.filter(
        (F.col("variable") == "biomass") & (F.col("freq") == "annual") & F.col("group_id").isNotNull()
    ).withColumn("group", F.coalesce("group_name", label("group", F.col("group_id"), F.lit(None).cast("string"))))
    out = moving_average(kept, smoothing)
    return relative_to_first(out, "smoothed", "smoothed") if relative else out


def biomass_trend_compare(rows: DataFrame, params: dict) -> dict[str, DataFrame]:
    trends = biomass_trends(rows, int(params["smoothing"]), bool(params["relative"]))
    return {"trends": trends, "summary": trend_summary(trends)}


register(Analysis(
    id="biomass_trend_compare", run=biomass_trend_compare,
    params={"smoothing": 3, "relative": False}, variables=frozenset({"biomass"}),
))
