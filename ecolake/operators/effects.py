"""Effects of scenarios: series paired with a baseline, and spreads over the runs of an ensemble.

One deterministic run has no variance, so nothing here treats years or cells as samples: bands are
taken over runs only, and a request for them is refused where there is one run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.session import written

# --- fixed values -----------------------------------------------------------------------
NEAR_ZERO = 1e-9  # baselines nearer to zero have no relative change
EPSILON = 1e-9  # added to both sides of a log response ratio
BANDS = [0.05, 0.25, 0.5, 0.75, 0.95]
# ----------------------------------------------------------------------------------------

SERIES_KEY = ["model", "domain", "variable", "freq", "date", "year", "month", "group_id", "group_name", "fleet_id", "fleet_name", "partner_id", "partner_name", "run_id"]


def effects(value: Column, baseline: Column) -> dict[str, Column]:
    """``absolute``, ``percent`` (null where the baseline is near zero) and ``log_ratio`` (null
    where either side is negative) of a value against its baseline."""
    far = F.abs(baseline) > NEAR_ZERO
    positive = (value >= 0) & (baseline >= 0)
    return {
        "absolute": value - baseline,
        "percent": F.when(far, F.try_divide(value - baseline, baseline) * 100),
        "log_ratio": F.when(positive, F.log((value + EPSILON) / (baseline + EPSILON))),
    }


def paired_effect(rows: DataFrame, baseline: str, key: list[str] | None = None, value: str = "value") -> DataFrame:
    """Every scenario against ``baseline`` on equal keys (all of a series' key but the scenario).

    One row per (key, other scenario of the model): the value, the ``baseline`` value, the effects,
    and ``status``: ``paired``, ``no_baseline`` (the key is not in the baseline) or ``no_scenario``
    (the scenario lacks it). Two values of one (key, scenario) are an error. Scenarios of a key are
    put together in one grouping, so nothing is joined with itself; the list of a model's scenarios,
    one short row per model, tells which are missing.
    """
    key = [k for k in (key or SERIES_KEY) if k in rows.columns]
    model = "model" if "model" in key else None
    named = rows.select(*key, "scenario", F.col(value).alias("_v"))
    own = F.struct("scenario", F.col("_v").alias("v"))
    held = named.groupBy(*key).agg(F.array_sort(F.collect_list(own)).alias("_all"))
    twice = F.size("_all") != F.size(F.array_distinct(F.transform("_all", lambda s: s["scenario"])))
    held = held.withColumn("_all", F.when(twice, F.raise_error(F.lit("two values of one scenario and key"))).otherwise(F.col("_all")))
    scenarios = named.groupBy(*([F.col(model).alias("_model")] if model else [])).agg(F.array_sort(F.collect_set("scenario")).alias("_scenarios"))
    scenarios = written(scenarios, "scenarios")
    held = held.join(scenarios, F.col(model).eqNullSafe(F.col("_model"))).drop("_model") if model else held.withColumn("_scenarios", scenarios.select("_scenarios").scalar())
    base = F.get(F.filter("_all", lambda s: s["scenario"] == baseline), F.lit(0))
    held = held.withColumns({"_base": base, "scenario": F.explode(F.filter("_scenarios", lambda s: s != baseline))})
    of = lambda s: F.get(F.filter("_all", lambda x: x["scenario"] == s), F.lit(0))
    held = held.withColumn("_own", of(F.col("scenario"))).filter(F.col("_own").isNotNull() | F.col("_base").isNotNull())
    status = F.when(F.col("_own").isNull(), "no_scenario").when(F.col("_base").isNull(), "no_baseline").otherwise("paired")
    held = held.select(*key, "scenario", F.col("_own.v").alias(value), F.col("_base.v").alias("baseline"), status.alias("status"))
    return held.withColumns(effects(F.col(value), F.col("baseline")))


def unmatched(paired: DataFrame) -> DataFrame:
    """How many keys have no counterpart, per scenario and side."""
    return paired.filter("status <> 'paired'").groupBy("scenario", "status").agg(F.count("*").alias("keys"))


def ensemble_kinds(rows: DataFrame) -> DataFrame:
    """Per (model, scenario): its number of runs and whether it is a ``single`` run, an ``ensemble``
    or ``mixed`` (rows with a run beside rows without one)."""
    runs = rows.groupBy("model", "scenario", "run_id").agg(F.count("*").alias("n"))
    out = runs.groupBy("model", "scenario").agg(F.count("run_id").alias("runs"), F.bool_or(F.col("run_id").isNull()).alias("bare"))
    kind = F.when(F.col("bare") & (F.col("runs") > 0), "mixed").when(F.col("runs") > 1, "ensemble").otherwise("single")
    return out.select("model", "scenario", "runs", kind.alias("kind"))


def require_ensemble(rows: DataFrame) -> DataFrame:
    """``rows`` unchanged; an error that names the first (model, scenario) that is no ensemble. Also
    for no rows, for nothing is known of their runs."""
    kinds = ensemble_kinds(rows)
    if kinds.isEmpty():
        raise ValueError("no rows, so no ensemble")
    bad = kinds.filter("kind <> 'ensemble'").orderBy("model", "scenario").first()
    if bad is not None:
        raise ValueError(f"{bad['model']}, {bad['scenario']}: {bad['kind']} ({bad['runs']} runs); quantiles need an ensemble of runs")
    return rows


def quantile_bands(rows: DataFrame, probabilities: list[float] | None = None, key: list[str] | None = None, value: str = "value") -> DataFrame:
    """Exact quantiles of the runs' values (linear between neighbours) per scenario and key, as
    columns ``q05``, ``q25``, ..., with the number of ``runs`` and their ``mean``. A run that lacks a
    key is not counted there; a run's two values of one key are an error, for a run is one sample."""
    probabilities = probabilities or BANDS
    key = [k for k in (key or SERIES_KEY) if k in rows.columns and k != "run_id"]
    per_run = require_ensemble(rows).groupBy("scenario", *key, "run_id").agg(F.max(value).alias("_v"), F.count("*").alias("_n"))
    one = F.when(F.col("_n") > 1, F.raise_error(F.lit("two values of one run and key"))).otherwise(F.col("_v"))
    out = per_run.withColumn("_v", one).groupBy("scenario", *key).agg(
        F.count("_v").alias("runs"), F.avg("_v").alias("mean"), F.percentile("_v", F.array(*map(F.lit, probabilities))).alias("_q"),
    )
    names = [f"q{round(100 * p):02d}" for p in probabilities]
    return out.select("scenario", *key, "runs", "mean", *[F.get("_q", F.lit(k)).alias(n) for k, n in enumerate(names)])
