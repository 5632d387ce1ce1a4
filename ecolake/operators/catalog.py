"""The catalog of datasets and the lists and trees derived from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.measures import category
from ecolake.schema import SLICE


def dimension_members(tidy: DataFrame) -> DataFrame:
    """What each slice holds: a row per combination of dimension members (``group_id``, ``fleet_id``,
    ``partner_id``, with a name each) and model name, its number of rows and its years. Map-side
    combining shrinks the values to a handful of rows per task, and menus read only this table:
    :func:`catalog_of_members` and :func:`list_dimension` take it in place of the values."""
    return tidy.groupBy(*SLICE, "model_name", "group_id", "fleet_id", "partner_id").agg(
        F.min("group_name").alias("group_name"), F.min("fleet_name").alias("fleet_name"), F.min("unit").alias("label"),
        F.count("*").alias("n_rows"), F.min("year").alias("year_min"), F.max("year").alias("year_max"),
    )


def catalog_datasets(tidy: DataFrame) -> DataFrame:
    """One row per (model, scenario, domain, variable, freq)."""
    return catalog_of_members(dimension_members(tidy))


def catalog_of_members(members: DataFrame) -> DataFrame:
    """The catalog from :func:`dimension_members`: distinct members are counted on that small table."""
    keys = SLICE
    out = members.groupBy(*keys).agg(
        F.min("model_name").alias("model_name"), F.min("label").alias("label"),
        F.sum("n_rows").alias("n_rows"), F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.count_distinct("group_id").alias("n_groups"),
        F.count_distinct("fleet_id").alias("n_fleets"),
        F.count_distinct("partner_id").alias("n_partners"),
    )
    c = F.col
    return out.withColumn(
        "category", category(c("variable"), c("domain"), c("n_groups"), c("n_fleets"), c("n_partners"))
    )


def list_datasets(catalog: DataFrame, scenario: str | None = None) -> DataFrame:
    """Catalog rows, of one scenario if given, in name order."""
    out = catalog.filter(F.col("scenario") == scenario) if scenario else catalog
    return out.orderBy(*[F.asc_nulls_last(k) for k in ("scenario", "domain", "variable", "freq", "model")])


def _labelled(catalog: DataFrame, scenarios: DataFrame) -> DataFrame:
    labels = scenarios.select(F.col("id").alias("scenario"), F.col("label").alias("scenario_label"))
    return catalog.join(labels, "scenario", "left")


def list_scenarios(catalog: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Scenarios with their label, number of datasets and year span."""
    return _labelled(catalog, scenarios).groupBy("scenario").agg(
        F.min("scenario_label").alias("label"), F.min("domain").alias("domain"),
        F.min("model").alias("model"), F.min("model_name").alias("model_name"),
        F.count("*").alias("n_datasets"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
    )


def list_models(catalog: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Models with their output scenarios nested as ``array<struct<scenario, label>>``."""
    output = catalog.filter((F.col("domain") == "output") & F.col("model").isNotNull())
    per_scenario = _labelled(output, scenarios).groupBy("model", "scenario").agg(
        F.min("model_name").alias("model_name"), F.min("scenario_label").alias("label"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.count("*").alias("n_datasets"),
    )
    node = F.struct("scenario", F.coalesce(F.nullif("label", F.lit("")), "scenario").alias("label"))
    return per_scenario.groupBy("model").agg(
        F.min("model_name").alias("model_name"),
        F.array_sort(F.collect_list(node)).alias("scenarios"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.sum("n_datasets").alias("n_datasets"),
    )


def scenario_tree(catalog: DataFrame) -> DataFrame:
    """Nested navigation: (model, scenario) -> domains -> variables. The catalog has one row
    per dataset, so the nested lists are as long as the menus they fill."""
    variable = F.struct(
        "variable", "freq", "label", "category", "year_min", "year_max", "n_groups", "n_fleets", "n_partners",
    )
    domains = catalog.groupBy("model", "scenario", "domain").agg(
        F.min("model_name").alias("model_name"), F.array_sort(F.collect_list(variable)).alias("variables"),
    )
    return domains.groupBy("model", "scenario").agg(
        F.min("model_name").alias("model_name"),
        F.array_sort(F.collect_list(F.struct("domain", "variables"))).alias("domains"),
    )


def variable_index(catalog: DataFrame) -> DataFrame:
    """Per (domain, variable, freq): which (model, scenario) pairs offer it, the year span and
    the largest number of members per dimension."""
    first = F.min(F.struct("scenario", "model", "label", "category"))
    out = catalog.groupBy("domain", "variable", "freq").agg(
        first.alias("_first"),
        F.array_sort(F.collect_set(F.struct("scenario", "model", "model_name"))).alias("combos"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.max("n_groups").alias("n_groups"), F.max("n_fleets").alias("n_fleets"),
        F.max("n_partners").alias("n_partners"),
    )
    return out.withColumns({
        "label": F.coalesce("_first.label", "variable"), "category": F.col("_first.category"),
        "scenarios": F.array_distinct(F.transform("combos", lambda c: c["scenario"])),
    }).drop("_first")


def list_dimension(
    members: DataFrame, dimension: str, variables: list[str], freq: str = "annual",
    scenarios: list[str] | None = None, names: DataFrame | None = None,
) -> DataFrame:
    """Groups or fleets present in ``variables``: ``id``, ``name``, sorted ``variables``. ``members``
    is the stored table of :func:`dimension_members`, or tidy rows where none is at hand.

    A group the files do not name takes the name its models' group tables give it
    (``names``: model_name, group_id, name); differing names are joined with " / ".
    """
    ident, name = f"{dimension}_id", f"{dimension}_name"
    rows = members.filter(F.col("variable").isin(variables) & (F.col("freq") == freq) & F.col(ident).isNotNull())
    if scenarios:
        rows = rows.filter(F.col("scenario").isin(scenarios))
    # one row per (id, variable, model) before anything is collected or joined
    rows = rows.groupBy(F.col(ident).alias("id"), "variable", "model_name").agg(F.min(name).alias("name"))
    if dimension == "group" and names is not None:
        known = names.select("model_name", F.col("group_id").alias("id"), F.col("name").alias("_known"))
        rows = rows.join(known, ["model_name", "id"], "left")
    else:
        rows = rows.withColumn("_known", F.lit(None).cast("string"))
    out = rows.groupBy("id").agg(
        F.min("name").alias("name"), F.array_sort(F.collect_set("variable")).alias("variables"),
        F.array_sort(F.collect_set("_known")).alias("_known"),
    )
    joined = F.nullif(F.array_join("_known", " / "), F.lit(""))
    return out.select("id", F.coalesce("name", joined).alias("name"), "variables")


def raster_layers(rasters: DataFrame) -> DataFrame:
    """Map layers per (model, scenario, domain, variable); members counted by id or else by
    name."""
    keys = ["model", "scenario", "domain", "variable"]
    rows = rasters.select(
        *keys, "model_name", "year",
        F.coalesce(F.col("group_id").cast("string"), "group_name").alias("_group"),
        F.coalesce(F.col("fleet_id").cast("string"), "fleet_name").alias("_fleet"),
    )
    members = rows.groupBy(*keys, "_group", "_fleet").agg(
        F.min("model_name").alias("model_name"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.count("*").alias("n_rasters"),
    )
    return members.groupBy(*keys).agg(
        F.min("model_name").alias("model_name"),
        F.count_distinct("_group").alias("n_groups"), F.count_distinct("_fleet").alias("n_fleets"),
        F.min("year_min").alias("year_min"), F.max("year_max").alias("year_max"),
        F.sum("n_rasters").alias("n_rasters"),
    )


def data_kind(runs: Column, has_series: Column, has_maps: Column) -> Column:
    """Kind of source: several runs beat mixed content, which beats maps or series alone."""
    return (
        F.when(runs > 1, "montecarlo").when(has_series & has_maps, "mixed")
        .when(has_maps, "spatial").when(has_series, "timeseries")
    )


def source_kind(tidy: DataFrame, rasters: DataFrame) -> DataFrame:
    """One row: kind of the source and the largest number of runs any scenario has."""
    series = tidy.groupBy("model", "scenario", "run_id").agg(F.count("*").alias("n"))
    maps = rasters.groupBy("model", "scenario", "run_id").agg(F.count("*").alias("n"))
    tagged = series.withColumn("_maps", F.lit(False)).unionByName(maps.withColumn("_maps", F.lit(True)))
    per = tagged.groupBy("_maps", "model", "scenario").agg(F.count_distinct("run_id").alias("runs"))
    out = per.agg(
        F.coalesce(F.greatest(F.max("runs"), F.lit(1)), F.lit(1)).alias("run_count"),
        F.coalesce(F.bool_or(~F.col("_maps")), F.lit(False)).alias("has_series"),
        F.coalesce(F.bool_or("_maps"), F.lit(False)).alias("has_maps"),
    )
    return out.withColumn("kind", data_kind(F.col("run_count"), F.col("has_series"), F.col("has_maps")))
