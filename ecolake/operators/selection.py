"""Filters and selections on time series and maps."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.session import small_table

QUERY_COLUMNS = [
    "model", "model_name", "scenario", "variable", "freq", "date", "year", "month",
    "group_id", "group_name", "fleet_id", "fleet_name", "partner_id", "partner_name", "value", "run_id",
]
QUERY_ORDER = [
    "model", "scenario", "group_id", "group_name", "fleet_id", "fleet_name", "partner_name", "year", "month",
]


def _conditions(
    *, model=None, scenario=None, group=None, group_id=None, fleet=None, fleet_id=None,
    year_from=None, year_to=None, month_from=None, month_to=None,
) -> list[Column]:
    c = F.col
    lower = lambda names: [n.lower() for n in names or []]
    lists = [
        (c("model"), model), (c("scenario"), scenario), (F.lower("group_name"), lower(group)),
        (c("group_id"), group_id), (F.lower("fleet_name"), lower(fleet)), (c("fleet_id"), fleet_id),
    ]
    bounds = [
        (c("year") >= year_from, year_from), (c("year") <= year_to, year_to),
        (c("month") >= month_from, month_from), (c("month") <= month_to, month_to),
    ]
    return [col.isin(list(v)) for col, v in lists if v] + [cond for cond, v in bounds if v is not None]


def query_timeseries(tidy: DataFrame, variable: str, freq: str = "annual", **filters) -> DataFrame:
    """Rows of one variable. Lists (``model, scenario, group, group_id, fleet, fleet_id``)
    restrict when not empty, names match whatever their case; ``year_*`` bound the calendar
    year and ``month_*`` the month of the year across all years.

    Plain comparisons on stored columns: partitions and Parquet row groups are skipped.
    """
    wanted = [F.col("variable") == variable, F.col("freq") == freq, *_conditions(**filters)]
    return tidy.filter(reduce(Column.__and__, wanted)).select(*QUERY_COLUMNS)


def in_query_order(rows: DataFrame) -> DataFrame:
    """Presentation order of a query result, missing values last."""
    return rows.orderBy(*[F.asc_nulls_last(k) for k in QUERY_ORDER])


@dataclass
class Manifest:
    """A selection: variables (names, or ``{"variable", "scenarios"}`` with scenarios of
    their own) and the filters all of them share."""

    variables: list
    freq: str = "annual"
    scenarios: list[str] | None = None
    filters: dict = field(default_factory=dict)

    @classmethod
    def from_dict(cls, manifest: dict) -> "Manifest":
        renamed = {"groups": "group", "group_ids": "group_id", "fleets": "fleet", "fleet_ids": "fleet_id"}
        shared = [*renamed, "year_from", "year_to", "month_from", "month_to"]
        return cls(
            variables=list(manifest.get("variables") or []),
            freq=manifest.get("freq", "annual"),
            scenarios=manifest.get("scenarios"),
            filters={renamed.get(k, k): manifest[k] for k in shared if manifest.get(k) is not None},
        )

    def items(self) -> list[tuple[str, list[str] | None]]:
        return [
            (v["variable"], v.get("scenarios")) if isinstance(v, dict) else (v, self.scenarios)
            for v in self.variables
        ]


def _per_item(rows: DataFrame, conditions: list[Column]) -> DataFrame:
    """Rows matching any condition, once per condition met, tagged with its position
    ``item``. One scan; the disjunction itself is pushed down."""
    met = F.array_compact(F.array(*[F.when(cond, F.lit(i)) for i, cond in enumerate(conditions)]))
    return rows.filter(reduce(Column.__or__, conditions)).withColumn("item", F.explode(met))


def manifest_rows(tidy: DataFrame, manifest: Manifest) -> DataFrame:
    """All rows a manifest selects, with ``item`` = position of the variable in it. A
    variable listed twice is returned twice."""
    chosen = [
        (F.col("variable") == name) & (F.col("scenario").isin(scenarios) if scenarios else F.lit(True))
        for name, scenarios in manifest.items()
    ]
    if not chosen:
        return tidy.limit(0).select(*QUERY_COLUMNS, F.lit(0).alias("item"))
    shared = [F.col("freq") == manifest.freq, *_conditions(**manifest.filters)]
    rows = tidy.filter(reduce(Column.__and__, shared)).select(*QUERY_COLUMNS)
    return _per_item(rows, chosen)


def require_rows(rows: DataFrame) -> DataFrame:
    """The rows, or a ``ValueError`` when the selection is empty."""
    if rows.isEmpty():
        raise ValueError("no data matches the selection (0 rows); widen the filters")
    return rows


def list_rasters(
    rasters: DataFrame, scenario: str, variable: str,
    group: str | None = None, fleet: str | None = None, year: int | None = None, model: str | None = None,
) -> DataFrame:
    """Maps of one scenario and variable (of one ``model`` if given), without their long source
    columns; ``run_id`` tells the runs of an ensemble apart."""
    wanted = [F.col("scenario") == scenario, F.col("variable") == variable]
    if model is not None:
        wanted.append(F.col("model") == model)
    if group:
        wanted.append(F.lower("group_name") == group.lower())
    if fleet:
        wanted.append(F.lower("fleet_name") == fleet.lower())
    if year is not None:
        wanted.append(F.col("year") == year)
    return rasters.filter(reduce(Column.__and__, wanted)).select(
        "id", "model", "model_name", "scenario", "domain", "variable",
        "group_id", "group_name", "fleet_id", "fleet_name", "year", "run_id",
    )


def get_raster(rasters: DataFrame, raster_id: str, model: str | None = None) -> DataFrame:
    """The index rows with one id (none if unknown): a row per model that has it, or that of
    ``model``."""
    found = rasters.filter(F.col("id") == raster_id)
    return found if model is None else found.filter(F.col("model") == model)


@dataclass
class MapItem:
    """Maps of one variable: entities (groups or fleets) and a year range of their own."""

    variable: str
    year_from: int
    year_to: int
    entities: list[str] = field(default_factory=list)


def select_maps(rasters: DataFrame, scenario: str, items: list[MapItem], model: str | None = None) -> DataFrame:
    """Maps chosen for export, tagged with the position ``item`` of the choice that took
    them; maps without an entity need only the year range."""
    entity = F.coalesce(F.nullif("group_name", F.lit("")), F.nullif("fleet_name", F.lit("")))
    rows = rasters.filter(F.col("scenario") == scenario).withColumn("entity", entity)
    if model is not None:
        rows = rows.filter(F.col("model") == model)
    conditions = [
        (F.col("variable") == i.variable) & F.col("year").between(i.year_from, i.year_to)
        & (F.col("entity").isNull() | (F.col("entity").isin(i.entities) if i.entities else F.lit(False)))
        for i in items
    ]
    return _per_item(rows, conditions)


def select_maps_summary(selected: DataFrame, items: list[MapItem]) -> DataFrame:
    """Per chosen variable: what was asked for and how many maps that gave (``missing`` = none)."""
    asked = small_table(selected.sparkSession, ["item", "variable", "entities", "years"], [
        (n, i.variable, ", ".join(sorted(set(i.entities))) or "all", f"{i.year_from}-{i.year_to}")
        for n, i in enumerate(items)
    ])
    counted = selected.groupBy("item").agg(F.count("*").alias("maps"))
    return asked.join(counted, "item", "left").withColumn("maps", F.coalesce("maps", F.lit(0))).withColumn(
        "missing", F.col("maps") == 0
    )


def gate_scenarios(
    index: DataFrame, models: list[str], scenarios: list[str], overrides: dict[tuple[str, str, str], list[str]] | None = None,
) -> DataFrame:
    """Scenarios each variable may plot. An output scenario needs both its model and itself
    chosen, drivers (no model) are always in; an override for (domain, variable, freq)
    keeps only those of its scenarios that are available anyway.

    ``index`` is :func:`ecolake.operators.catalog.variable_index`.
    """
    available = F.transform(
        F.filter("combos", lambda c: c["model"].isNull() | (c["model"].isin(models) & c["scenario"].isin(scenarios))),
        lambda c: c["scenario"],
    )
    out = index.select("domain", "variable", "freq", F.array_distinct(available).alias("available"))
    effective = F.col("available")
    for (domain, variable, freq), chosen in (overrides or {}).items():
        hit = (F.col("domain") == domain) & (F.col("variable") == variable) & (F.col("freq") == freq)
        kept = F.array_intersect(F.array(*map(F.lit, chosen)).cast("array<string>"), F.col("available"))
        effective = F.when(hit, kept).otherwise(effective)
    return out.withColumn("effective", effective)
