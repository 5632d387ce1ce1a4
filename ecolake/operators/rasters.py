"""The index of maps: identity of every map file, duplicates, collisions, value ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.naming import slugify
from ecolake.schema import RASTER_INDEX
from ecolake.sources.grids import input_names, output_names, with_run_info


def output_maps(files: DataFrame, run_info: DataFrame) -> DataFrame:
    """Recognised output maps with their run's identity. ``run_id`` is the directory when the
    (model, scenario) has maps in more than one, else null."""
    known = output_names(files).filter(F.col("variable").isNotNull())
    maps = with_run_info(known, run_info)
    # directories carry the identity, so they are counted, not the maps
    dirs = maps.select(F.col("model").alias("_model"), F.col("scenario").alias("_scenario"), "dir").distinct()
    runs_per = dirs.groupBy("_model", "_scenario").agg(F.count("*").alias("n_dirs"))
    same = F.col("model").eqNullSafe(F.col("_model")) & (F.col("scenario") == F.col("_scenario"))
    runs = maps.join(runs_per, same, "left")
    return runs.select(
        "model", "model_name", "scenario", F.lit("output").alias("domain"), "variable",
        F.when(F.col("entity_type") == "group", F.col("entity_name")).alias("group_name"),
        F.when(F.col("entity_type") == "fleet", F.col("entity_name")).alias("fleet_name"),
        "year", F.when(F.col("n_dirs") > 1, F.col("dir")).alias("run_id"),
        "dir", "name", "path", "crs_wkt",
    )


def input_maps(files: DataFrame) -> DataFrame:
    """Driver maps, one per (scenario, variable, year): of mirrored copies the first in path
    order is kept. A minimum per key, combined on the map side, so many copies of one map
    never meet in one task."""
    dated = input_names(files).filter(F.col("year").isNotNull())
    kept = dated.groupBy("scenario", "variable", "year").agg(F.min(F.struct("path", "dir", "name")).alias("f"))
    none = lambda kind: F.lit(None).cast(kind)
    return kept.select(
        none("string").alias("model"), none("string").alias("model_name"), "scenario",
        F.lit("input").alias("domain"), "variable", none("string").alias("group_name"),
        none("string").alias("fleet_name"), "year", none("string").alias("run_id"),
        "f.dir", "f.name", "f.path", none("string").alias("crs_wkt"),
    )


def raster_id() -> Column:
    """``scenario|domain|variable|entity|year``, with ``|run`` for one of several runs."""
    entity = F.coalesce(slugify(F.coalesce("group_name", "fleet_name")), F.lit("none"))
    year = F.col("year").cast("string")
    return F.concat_ws("|", "scenario", "domain", "variable", entity, year, "run_id")


def _identified(maps: DataFrame) -> DataFrame:
    order = F.struct((F.col("domain") != "output").alias("input"), "dir", "name", "path")
    return maps.withColumn("id", raster_id()).withColumn("_order", order)


def raster_index(maps: DataFrame) -> DataFrame:
    """Index rows, one per model and id. Of several maps with one id (more than one map a year) the
    first in (directory, name) order is kept; see :func:`raster_collisions` for the rest."""
    rest = [c for c in maps.columns if c not in ("dir", "name", "path")]
    kept = _identified(maps).groupBy(F.col("model").alias("_model"), "id").agg(F.min_by(F.struct("path", *rest), "_order").alias("m"))
    folder = F.concat(
        F.lit("model="), F.coalesce("m.model", F.lit("__HIVE_DEFAULT_PARTITION__")), F.lit("/scenario="), F.col("m.scenario"), F.lit("/domain="), F.col("m.domain"),
        F.lit("/variable="), F.col("m.variable"),
    )
    made = {"id": F.col("id"), "path": folder, "source_path": F.col("m.path"), "source_crs_wkt": F.col("m.crs_wkt")}
    columns = []
    for field in RASTER_INDEX:
        if field.name in made:
            value = made[field.name]
        elif field.name in rest:
            value = F.col(f"m.{field.name}")
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return kept.select(*columns)


def raster_collisions(maps: DataFrame) -> DataFrame:
    """Maps left out of the index because an earlier one of their model has their id, with a
    message."""
    all_maps = _identified(maps)
    shared = all_maps.groupBy(F.col("model").alias("_model"), F.col("id").alias("_id")).agg(
        F.count("*").alias("n"), F.min("_order").alias("first"),
    ).filter(F.col("n") > 1)
    same = (F.col("id") == F.col("_id")) & F.col("model").eqNullSafe(F.col("_model"))
    later = all_maps.join(shared, same).filter(F.col("_order") > F.col("first"))
    message = F.concat(
        F.lit("duplicate map id "), F.col("id"), F.lit(": "), F.col("name"), F.lit(" and "),
        F.col("first.name"), F.lit(" are both of the same year"),
    )
    return later.select("id", "name", "path", F.col("first.path").alias("kept_path"), message.alias("message"))


def raster_range(cells: DataFrame) -> DataFrame:
    """Smallest and largest value of each map without NODATA; 0, 0 for an empty map."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return cells.groupBy("raster_id").agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("min"), F.coalesce(F.max(value), F.lit(0.0)).alias("max"),
    )


def raster_range_all(cells: DataFrame) -> DataFrame:
    """The same over all given maps, for a shared colour scale."""
    value = F.when(~F.isnan("value"), F.col("value"))
    return cells.agg(
        F.coalesce(F.min(value), F.lit(0.0)).alias("min"), F.coalesce(F.max(value), F.lit(0.0)).alias("max"),
    )


def undated_maps(files: DataFrame) -> DataFrame:
    """Driver maps whose name holds no year."""
    return input_names(files).filter(F.col("year").isNull()).select("path", "name")


def mirrored_maps(files: DataFrame) -> DataFrame:
    """Driver maps left out because an earlier path holds the same scenario, variable and year."""
    dated = input_names(files).filter(F.col("year").isNotNull())
    keys = ["scenario", "variable", "year"]
    first = dated.groupBy(*keys).agg(F.min("path").alias("kept_path"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return dated.join(first, keys).filter(F.col("path") != F.col("kept_path")).select("path", "name", "kept_path")


def unrecognised_maps(files: DataFrame) -> DataFrame:
    """Map files whose name is no known output map."""
    return output_names(files).filter(F.col("variable").isNull()).select("path", "name")
