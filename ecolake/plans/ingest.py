"""Loading one source: raw folder in, stored tables out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecolake.operators.catalog import catalog_of_members, dimension_members
from ecolake.operators.rasters import (
    input_maps, mirrored_maps, output_maps, raster_collisions, raster_index, undated_maps, unrecognised_maps,
)
from ecolake.plans.report import scan_report
from ecolake.schema import MODELS, RASTER_INDEX, SCENARIOS, SLICE
from ecolake.session import scratch_space, written
from ecolake.sinks.store import (
    clear_cells, conform, dim_models, dim_scenarios, materialise_cells, replace_slices, replace_source, scan_sources, source_path,
)
from ecolake.sources.files import SPLIT_BYTES, list_files, with_heads
from ecolake.sources.grids import RUN_INFO, MeasuredGrids, grid_rows, measured_grids, read_run_info, row_cells
from ecolake.sources.identify import group_tables, identify_input, identify_output, with_layer
from ecolake.sources.model_csv import assign_run_id, discover_input, run_directories, series_files, trend_files


def open_maps(index: DataFrame, split_bytes: int = SPLIT_BYTES) -> MeasuredGrids:
    """The files of index rows, opened by their ``source_path``: headers and outcomes. Those that
    cannot be read or are no whole grid have status ``error``."""
    return measured_grids(index.withColumns({"path": F.col("source_path"), "raster_id": F.col("id")}), split_bytes)


def materialise_maps(wanted: DataFrame, root: str, source_id: str, split_bytes: int = SPLIT_BYTES) -> None:
    """Store the cells of the wanted index rows, opening only files that are not stored yet. Files
    are dealt to tasks by their bytes, whatever the index's partitions. What became of each map is
    in the store's outcomes."""
    keys = ["model", "scenario", "domain", "variable"]

    def parse(missing: DataFrame) -> tuple[DataFrame, DataFrame]:
        opened = open_maps(missing, split_bytes)
        outcomes = opened.maps.select("model", "id", "domain", F.col("status").alias("outcome"), F.col("fault").alias("reason"))
        return row_cells(grid_rows(opened, "raster_id", *keys), "raster_id", *keys), outcomes

    with scratch_space(wanted.sparkSession):
        materialise_cells(wanted, root, source_id, parse)


def _save(df: DataFrame, root: str, table: str, source_id: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{root}/{table}/source_id={source_id}")


def save_catalog(spark: SparkSession, root: str, source_id: str) -> None:
    """Dimension members and catalog of a source's series, stored so that menus need not read the
    values again. The values are gone through once, the catalog is made of the members."""
    _save(dimension_members(scan_sources(spark, root, [source_id])), root, "members", source_id)
    _save(catalog_of_members(spark.read.parquet(source_path(root, "members", source_id))), root, "catalog", source_id)


def rescan_slices(rows: DataFrame, root: str, source_id: str) -> None:
    """Replace the slices of a source that ``rows`` contain, and renew the members of these slices
    alone: those of all others are kept as they are stored, and the catalog is made of the members."""
    spark = rows.sparkSession
    with scratch_space(spark):
        slices = replace_slices(rows, root, source_id)
        here = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SLICE]
        same = reduce(lambda a, b: a & b, here)
        touched = slices.select(*[F.col(c).alias(f"_{c}") for c in SLICE])
        path = source_path(root, "members", source_id)
        spark.catalog.refreshByPath(source_path(root, "timeseries", source_id))
        new = dimension_members(scan_sources(spark, root, [source_id]).join(touched, same, "left_semi"))
        members = written(spark.read.parquet(path).join(touched, same, "left_anti").unionByName(new), "members")
        _save(members, root, "members", source_id)
        spark.catalog.refreshByPath(path)
        _save(catalog_of_members(members), root, "catalog", source_id)
        spark.catalog.refreshByPath(source_path(root, "catalog", source_id))


def folder_heads(listed: DataFrame, part: str = "table") -> DataFrame:
    """Listed files with the head of those that can be told by it (CSV, the given part, and text); maps and other files have none. Every file is opened once."""
    none = F.lit(None).cast("string")
    rest = listed.filter(~F.col("suffix").isin(".csv", ".txt")).withColumns({"text": none, "head_bytes": F.lit(None).cast("long"), "read_error": none})
    csv = with_heads(listed.filter(F.col("suffix") == ".csv"), part)
    return csv.unionByName(with_heads(listed.filter(F.col("suffix") == ".txt"))).unionByName(rest)


def read_group_tables(heads: DataFrame) -> DataFrame:
    """Group tables of the static model. Heads tell which files may have one, and only those are
    read to the end."""
    static = with_layer(heads.filter(F.col("suffix") == ".csv")).filter(F.col("layer") == "ecopath")
    return group_tables(with_heads(static.drop("layer", "model_name", "scenario_name"), "whole"))


def ingest_output(
    spark: SparkSession, folder: str, root: str, source_id: str, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Load model output below ``folder`` into the store; returns the scan report.

    The folder is listed once and everything is told from that table.

    1. Series: heads of the CSV files, then their lines by ranges, into the store.
    2. Maps: index rows from file names and run descriptions; no map is opened. Cells stored
       from an earlier scan are cleared, for the files may have changed.
    3. What is there: files per model layer, the static model's group tables, and the catalog.
    """
    with scratch_space(spark):
        _load_output(spark, folder, root, source_id, split_bytes)
    return spark.read.parquet(f"{root}/reports/source_id={source_id}")


def _load_output(spark: SparkSession, folder: str, root: str, source_id: str, split_bytes: int) -> None:
    listed = written(list_files(spark, folder), "listed")
    heads = written(folder_heads(listed), "folder-heads")
    rows, found = series_files(heads.filter(F.col("suffix") == ".csv"), split_bytes)
    directories = written(run_directories(found.filter("scenario is not null")), "run-directories")
    replace_source(assign_run_id(rows, directories), root, source_id)
    clear_cells(spark, root, source_id)

    names = listed.filter(F.col("suffix") == ".asc")
    info = read_run_info(with_heads(listed.filter(F.col("name") == RUN_INFO), "whole"))
    maps = written(output_maps(names, info), "maps")
    _save(raster_index(maps), root, "rasters", source_id)

    runs = found.filter("scenario is not null").groupBy("model", "scenario").agg(F.min(F.struct("path", "model_name", "scenario_label")).alias("f"))
    runs = runs.select("model", "scenario", "f.model_name", "f.scenario_label")
    _save(conform(dim_scenarios(runs), SCENARIOS), root, "scenarios", source_id)
    _save(conform(dim_models(runs), MODELS), root, "models", source_id)

    _save(identify_output(heads), root, "layers", source_id)
    _save(read_group_tables(heads), root, "groups", source_id)
    save_catalog(spark, root, source_id)

    none = F.lit(None).cast("string")
    collisions = written(raster_collisions(maps).select("path", "name", "message"), "collisions")
    indexed = maps.join(collisions.select("path"), "path", "left_anti")
    outcomes = (
        found.select(F.lit("csv").alias("kind"), "status", "name", "message")
        .unionByName(indexed.select(F.lit("map").alias("kind"), F.lit("ok").alias("status"), "name", none.alias("message")))
        .unionByName(collisions.select(F.lit("map").alias("kind"), F.lit("error").alias("status"), "name", "message"))
        .unionByName(unrecognised_maps(names).select(
            F.lit("map").alias("kind"), F.lit("unrecognised").alias("status"), "name", none.alias("message"),
        ))
    )
    _save(scan_report(outcomes), root, "reports", source_id)


def ingest_input(
    spark: SparkSession, folder: str, root: str, source_id: str, split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """Load driver trends, the index of driver maps and the kinds of input below ``folder``;
    returns the scan report: trends and maps that were loaded, that could not be, maps without a
    year, and mirrored copies."""
    with scratch_space(spark):
        _load_input(spark, folder, root, source_id, split_bytes)
    return spark.read.parquet(f"{root}/reports/source_id={source_id}")


def _load_input(spark: SparkSession, folder: str, root: str, source_id: str, split_bytes: int) -> None:
    listed = written(list_files(spark, folder), "listed")
    _save(identify_input(folder_heads(listed, "top")), root, "kinds", source_id)
    rows, trends = trend_files(listed, split_bytes)
    replace_source(rows, root, source_id)
    clear_cells(spark, root, source_id)
    none = F.lit(None).cast("string")
    scenarios = discover_input(listed).select("scenario").distinct().select(
        F.col("scenario").alias("id"), F.upper("scenario").alias("label"), F.lit("input").alias("domain"),
        none.alias("model"), none.alias("model_name"),
    )
    _save(conform(scenarios, SCENARIOS), root, "scenarios", source_id)
    names = listed.filter(F.col("suffix") == ".asc")
    maps = written(input_maps(names), "maps")
    _save(conform(raster_index(maps), RASTER_INDEX), root, "rasters", source_id)
    save_catalog(spark, root, source_id)
    copies = F.concat(F.lit("a copy of "), "kept_path")
    outcomes = (
        trends.select(F.lit("trend").alias("kind"), "status", "name", "message")
        .unionByName(maps.select(F.lit("map").alias("kind"), F.lit("ok").alias("status"), "name", none.alias("message")))
        .unionByName(undated_maps(names).select(F.lit("map").alias("kind"), F.lit("undated").alias("status"), "name", none.alias("message")))
        .unionByName(mirrored_maps(names).select(F.lit("map").alias("kind"), F.lit("copy").alias("status"), "name", copies.alias("message")))
    )
    _save(scan_report(outcomes), root, "reports", source_id)
