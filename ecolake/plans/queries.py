"""The registered queries: each operator applied to the test tables.

Nested results are written out as text (``array_join``) so that any two engines compare them
the same way; the operators themselves return real arrays and structs.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecolake.functions import measures, naming, periods
from ecolake.operators import areas, catalog, charts, crs, effects, enrich, rasters, selection, trends, zonal
from ecolake.plans import analysis, bindings, ingest, report
from ecolake.schema import CELLS, RASTER_INDEX, SCENARIOS, TIDY
from ecolake.session import batches_of, delete_path, scratch, scratch_in, written
from ecolake.sinks import export, store
from ecolake.sources import files as raw_files
from ecolake.sources import grids, identify, model_csv

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query. What it writes to scratch lies in a folder of its own, which its result
    reads; a later call of the same query in the session deletes the folder of the one before."""
    before: dict[str, str] = {}

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        if session in before:
            delete_path(spark, before.pop(session))
        before[session] = scratch(spark, f"query-{fn.__name__}")
        with scratch_in(before[session]):
            return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _text(items: Column) -> Column:
    return F.array_join(items, "; ")


VALUES = ["model", "scenario", "variable", "freq", "date", "year", "month", "group_id", "group_name",
          "fleet_id", "partner_name", "value", "unit"]

# --- fixed test areas in lon/lat: a polygon with a hole, a two-part area, one off the grid ---
AREAS = [
    ("Gulf / North", '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":'
     '{"type":"Polygon","coordinates":[[[10.1,54.2],[13.4,54.6],[13.1,57.7],[10.3,57.2],[10.1,54.2]],'
     '[[11.1,55.1],[12.2,55.2],[12.1,56.3],[11.2,56.1],[11.1,55.1]]]}}]}'),
    ("South", '{"type":"Feature","properties":{},"geometry":{"type":"MultiPolygon","coordinates":'
     '[[[[10.6,54.1],[11.9,54.1],[11.2,55.6],[10.6,54.1]]],[[[12.6,56.1],[13.9,56.2],[13.2,57.9],[12.6,56.1]]]]}}'),
    ("Far", '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{},"geometry":'
     '{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,1],[0,0]]]}},'
     '{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[11,55]}}]}'),
]


# --- sources -----------------------------------------------------------------------------

@query
def discover_output(spark, sf_dir):
    return model_csv.discover_output(bindings.series_files(spark, sf_dir))


@query
def csv_headers(spark, sf_dir):
    headed = model_csv.with_headers(bindings.series_files(spark, sf_dir))
    return headed.select("rel", F.explode("headers").alias("key", "content"))


@query
def csv_sections(spark, sf_dir):
    cut = model_csv.with_sections(bindings.series_files(spark, sf_dir))
    return cut.select("rel", "unit", F.array_join("header", "|").alias("header"), F.size("lines").alias("n_lines"))


@query
def csv_shapes(spark, sf_dir):
    parsed = model_csv.parsed_files(bindings.series_files(spark, sf_dir))
    return parsed.select("rel", "shape", "freq", "variable", "target", "start_year", "status")


def _layout(spark, sf_dir, shape):
    return model_csv.read_layout(bindings.series_files(spark, sf_dir), shape).select(*VALUES)


@query
def read_wide_by_id(spark, sf_dir):
    return _layout(spark, sf_dir, "wide_by_id")


@query
def read_wide_by_name(spark, sf_dir):
    return _layout(spark, sf_dir, "wide_by_name")


@query
def read_long(spark, sf_dir):
    return _layout(spark, sf_dir, "long")


@query
def read_single(spark, sf_dir):
    return _layout(spark, sf_dir, "single")


@query
def read_ragged(spark, sf_dir):
    return model_csv.read_layout(bindings.ragged_files(spark, sf_dir), "wide_by_id").select(*VALUES)


@query
def read_trend(spark, sf_dir):
    return model_csv.read_trends(bindings.trend_files(spark, sf_dir)).select(
        "scenario", "domain", "variable", "freq", "date", "year", "month", "value", "unit"
    )


def _grid_folder(spark, sf_dir) -> DataFrame:
    """The test grids as real files, listed: ``path``, ``raster_id`` and what is declared of them."""
    given = bindings.grid_files(spark, sf_dir)
    folder = _folder(spark, given.select(F.concat(F.lit("/raw/grids/"), "raster_id", F.lit(".asc")).alias("path"), "text"))
    named = given.select(F.concat("raster_id", F.lit(".asc")).alias("name"), "raster_id", "crs_wkt", "vec_id", "label")
    return written(raw_files.list_files(spark, folder, "*.asc").select("name", "path").join(named, "name"), "listed")


@query
def read_grid_cells(spark, sf_dir):
    return grids.grid_cells(grids.read_grids(bindings.grid_files(spark, sf_dir)), "raster_id")


@query
def read_grid_files(spark, sf_dir):
    """The same from files, dealt to tasks by their bytes."""
    opened = grids.measured_grids(_grid_folder(spark, sf_dir))
    return grids.row_cells(grids.grid_rows(opened, "raster_id"), "raster_id")


@query
def read_grid_ranges(spark, sf_dir):
    """The same from files cut into ranges of 150 bytes: no grid is in one range."""
    opened = grids.measured_grids(_grid_folder(spark, sf_dir), split_bytes=150)
    return grids.row_cells(grids.grid_rows(opened, "raster_id"), "raster_id")


@query
def raster_names_output(spark, sf_dir):
    named = grids.output_names(bindings.map_files(spark, sf_dir))
    year = periods.step_year(F.lit(periods.DEFAULT_START_YEAR), F.col("step")).cast("int")
    return named.select("rel", "variable", "entity_type", "entity_name", "step", year.alias("year"))


@query
def raster_names_input(spark, sf_dir):
    return grids.input_names(bindings.input_map_files(spark, sf_dir)).select("rel", "scenario", "variable", "year")


@query
def raster_runinfo(spark, sf_dir):
    info = grids.read_run_info(bindings.run_info_files(spark, sf_dir))
    maps = grids.output_names(bindings.map_files(spark, sf_dir)).filter(F.col("variable").isNotNull())
    return grids.with_run_info(maps, info).select("rel", "model", "model_name", "scenario", "start_year", "year", "crs_wkt")


@query
def scan_store(spark, sf_dir):
    first, second, missing = (scratch(spark, "scan") for _ in range(3))
    store.write_slices(bindings.biomass(spark, sf_dir), first)
    store.write_slices(bindings.drivers(spark, sf_dir), second)
    return store.scan_store(spark, [first, second, missing]).select(*VALUES, "domain")


@query
def identify_output(spark, sf_dir):
    found = bindings.series_files(spark, sf_dir).select("path", "text").unionByName(
        bindings.run_info_files(spark, sf_dir).select("path", "text")
    ).unionByName(bindings.group_table_files(spark, sf_dir).select("path", "text")).unionByName(
        bindings.map_files(spark, sf_dir).select("path", F.lit("").alias("text"))
    )
    out = identify.identify_output(raw_files.with_path_parts(found, "/raw"))
    return out.select("layer", "files", "maps", "n_models", "n_scenarios", _text(F.col("models")).alias("models"), _text(F.col("scenarios")).alias("scenarios"))


@query
def identify_input(spark, sf_dir):
    trends_ = bindings.trend_files(spark, sf_dir).select("path", "text")
    maps = bindings.input_map_files(spark, sf_dir).select("path", F.lit("").alias("text"))
    regions = bindings.table(spark, sf_dir, "region").select("r_name")
    models = regions.select(F.concat(F.lit("/raw/m/"), "r_name", F.lit(".ewemdb")).alias("path"), F.lit("x").alias("text"))
    fits = bindings.table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(
        F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.count("*").alias("n"),
    ).select(
        F.concat(F.lit("/raw/ts/fit "), "n_regionkey", F.lit(".csv")).alias("path"),
        F.concat(F.lit("Title,"), "names", F.lit("\nPool code,"), F.repeat(F.lit("1,"), F.col("n").cast("int")), F.lit("\nType,0\n1999,1\n")).alias("text"),
    )
    found = raw_files.with_path_parts(trends_.unionByName(maps).unionByName(models).unionByName(fits), "/raw")
    return identify.identify_input(found).withColumn("names", _text(F.col("names")))


@query
def ecopath_tables(spark, sf_dir):
    return identify.group_tables(bindings.group_table_files(spark, sf_dir)).select(
        "path", "model_name", "group_id", "name", "baseline"
    )


@query
def validate_source(spark, sf_dir):
    series = raw_files.with_path_parts(bindings.wide_by_id_files(spark, sf_dir), "/raw")
    out = identify.validate_output(series).unionByName(identify.validate_input(series))
    return out.unionByName(identify.validate_input(bindings.trend_files(spark, sf_dir)).withColumn(
        "check", F.concat(F.lit("trends: "), "check")
    ))


# --- whole folders, written as files and read back ---------------------------------------

def _folder(spark, files: DataFrame) -> str:
    """``files`` (path below /raw, text) as real files in the shared folder, blanks, ``+`` and
    ``%`` in the name of it."""
    root = scratch(spark, "raw data + 100%")
    parts = files.select(
        F.regexp_replace(F.substring_index("path", "/raw/", -1), "/[^/]*$", "").alias("folder"), F.substring_index("path", "/", -1).alias("file"), "text",
    )
    with batches_of(spark, export.TEXTS_AT_ONCE):
        export.write_named_texts(parts.repartition(spark.sparkContext.defaultParallelism), root).write.format("noop").mode("overwrite").save()
    return root


def _output_folder(spark, sf_dir) -> str:
    texts = [m(spark, sf_dir).select("path", "text") for m in (bindings.series_files, bindings.group_table_files, bindings.run_info_files)]
    maps = bindings.map_files(spark, sf_dir).select("path", F.lit("ncols 1\n").alias("text"))
    return _folder(spark, texts[0].unionByName(texts[1]).unionByName(texts[2]).unionByName(maps))


@query
def discover_files(spark, sf_dir):
    listed = raw_files.list_files(spark, _folder(spark, bindings.series_files(spark, sf_dir)), "*.csv")
    return model_csv.discover_output(raw_files.with_heads(listed))


@query
def ingest_output(spark, sf_dir):
    root = scratch(spark, "store")
    ingest.ingest_output(spark, _output_folder(spark, sf_dir), root, "one", split_bytes=100_000)
    return store.scan_sources(spark, root).select(*VALUES)


@query
def ingest_report(spark, sf_dir):
    found = ingest.ingest_output(spark, _output_folder(spark, sf_dir), scratch(spark, "store"), "one")
    return found.select("kind", "status", "files")


@query
def ingest_input(spark, sf_dir):
    maps = bindings.input_map_files(spark, sf_dir).select("path", F.lit("ncols 1\n").alias("text"))
    folder = _folder(spark, bindings.trend_files(spark, sf_dir).select("path", "text").unionByName(maps))
    return ingest.ingest_input(spark, folder, scratch(spark, "store"), "drivers").select("kind", "status", "files")


@query
def stored_rasters(spark, sf_dir):
    """The map index as ingest stores it."""
    root = scratch(spark, "store")
    ingest.ingest_output(spark, _output_folder(spark, sf_dir), root, "one")
    index = store.read_table(spark, store.source_path(root, "rasters", "one"), RASTER_INDEX)
    return index.select(*[c for c in INDEX if c not in ("path", "source_path")], F.substring_index("source_path", "/", -1).alias("name"))


@query
def stored_members(spark, sf_dir):
    """Groups of the stored members after a rescan of some slices; the values are not read."""
    root = scratch(spark, "store")
    biomass = bindings.biomass(spark, sf_dir)
    store.replace_source(biomass.unionByName(bindings.catch_fleet_group(spark, sf_dir)), root, "one")
    ingest.save_catalog(spark, root, "one")
    ingest.rescan_slices(biomass.filter((F.col("scenario") == "a") & (F.col("group_id") <= 3)), root, "one")
    members = spark.read.parquet(store.source_path(root, "members", "one"))
    return members.groupBy("scenario", "variable").agg(F.count_distinct("group_id").alias("n_groups"), F.sum("n_rows").alias("n_rows"))


@query
def stored_catalog(spark, sf_dir):
    root = scratch(spark, "store")
    ingest.ingest_output(spark, _output_folder(spark, sf_dir), root, "one")
    entries = spark.read.parquet(f"{root}/catalog/source_id=one")
    return entries.select("model", "scenario", "variable", "freq", "n_rows", "year_min", "year_max", "n_groups", "n_fleets")


# --- sinks -------------------------------------------------------------------------------

@query
def store_roundtrip(spark, sf_dir):
    path = scratch(spark, "slices")
    biomass = bindings.biomass(spark, sf_dir)
    store.write_slices(biomass.unionByName(bindings.totalcatch(spark, sf_dir)), path)
    store.write_slices(biomass.filter(F.col("scenario") == "a").withColumn("value", F.col("value") * 2), path)
    return store.read_table(spark, path, TIDY).select(*VALUES, "domain")


@query
def dim_scenarios(spark, sf_dir):
    runs = model_csv.discover_output(bindings.series_files(spark, sf_dir))
    return store.dim_scenarios(runs, model_csv.discover_input(bindings.trend_files(spark, sf_dir)))


@query
def dim_models(spark, sf_dir):
    runs = model_csv.discover_output(bindings.series_files(spark, sf_dir))
    return store.dim_models(runs)


@query
def materialize_files(spark, sf_dir):
    """Pixels on demand from files named by the index; the second request opens only new ones."""
    given = bindings.grid_files(spark, sf_dir)
    folder = _folder(spark, given.select(F.concat(F.lit("/raw/grids/"), "raster_id", F.lit(".asc")).alias("path"), "text"))
    named = given.select(F.concat("raster_id", F.lit(".asc")).alias("name"), "raster_id", "vec_id", "label")
    index = written(raw_files.list_files(spark, folder, "*.asc").select("name", F.col("path").alias("source_path")).join(named, "name").select(
        F.col("raster_id").alias("id"), F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"),
        F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("scenario"), F.lit("output").alias("domain"),
        F.concat(F.lit("v"), F.col("label").cast("string")).alias("variable"), "source_path",
    ), "index")
    root = scratch(spark, "cells")
    for wanted in (index.filter(F.col("variable") < "v5"), index):
        ingest.materialise_maps(wanted, root, "e")
    return store.read_cells(spark, root, "e").select(*[f for f in CELLS.fieldNames() if f != "geometry"])


def _parsed_grids(spark, sf_dir):
    return grids.read_grids(bindings.grid_files(spark, sf_dir))


@query
def materialize_cells(spark, sf_dir):
    root = scratch(spark, "cells")
    maps = written(bindings.grid_files(spark, sf_dir).select(
        F.col("raster_id").alias("id"), "text", F.concat(F.lit("s"), (F.col("vec_id") % 3).cast("string")).alias("scenario"),
        F.lit("output").alias("domain"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("variable"),
        F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"),
    ), "maps")

    def parse(missing):
        parsed = grids.read_grids(missing.withColumnRenamed("id", "raster_id"))
        return grids.grid_cells(parsed, "raster_id", "model", "scenario", "domain", "variable")

    for wanted in (maps.filter(F.col("variable") < "v5"), maps):  # the second request finds half of it stored
        store.materialise_cells(wanted, root, "e", parse)
    return store.read_cells(spark, root, "e").select(*[f for f in CELLS.fieldNames() if f != "geometry"])


@query
def materialize_outcomes(spark, sf_dir):
    """What became of maps opened on demand, a fourth of which are cut short, hold a word or are
    gone; read by ranges of 300 bytes."""
    v = F.col("vec_id")
    given = bindings.grid_files(spark, sf_dir)
    short, word = F.regexp_replace("text", r"\s+\S+\s*$", "\n"), F.regexp_replace("text", r"(\S+)\s*$", "land\n")
    text = F.when(v % 12 == 1, short).when(v % 12 == 5, word).otherwise(F.col("text"))
    folder = _folder(spark, given.filter(v % 12 != 9).select(F.concat(F.lit("/raw/grids/"), "raster_id", F.lit(".asc")).alias("path"), text.alias("text")))
    none = F.lit(None).cast("string")
    index = given.select(
        F.col("raster_id").alias("id"), none.alias("model"), F.lit("s").alias("scenario"), F.lit("output").alias("domain"), F.lit("biomass").alias("variable"),
        F.concat(F.lit(f"{folder}/grids/"), "raster_id", F.lit(".asc")).alias("source_path"),
    )
    root = scratch(spark, "cells")
    index = written(index, "index")
    for _ in range(2):  # maps that failed are tried again, the others are not
        ingest.materialise_maps(index, root, "e", split_bytes=300)
    stored = store.read_cells(spark, root, "e").groupBy("raster_id").agg(F.count("*").alias("cells"))
    found = store.read_outcomes(spark, root, "e").join(stored, "raster_id", "left")
    gone = F.contains("reason", F.lit("Failed to open"))
    return found.select("raster_id", "outcome", F.when(gone, "gone").otherwise(F.col("reason")).alias("reason"), F.coalesce("cells", F.lit(0)).alias("cells"))


@query
def replace_source(spark, sf_dir):
    root = scratch(spark, "sources")
    biomass, total = bindings.biomass(spark, sf_dir), bindings.totalcatch(spark, sf_dir)
    store.replace_source(biomass.unionByName(total), root, "one")
    store.replace_source(biomass, root, "two")
    store.replace_source(bindings.drivers(spark, sf_dir), root, "three")
    store.replace_source(biomass.filter(F.col("scenario") == "r"), root, "one")  # rescan: slices go away
    store.remove_source(spark, root, "three")
    return store.scan_sources(spark, root).select("source_id", *VALUES)


@query
def export_csv(spark, sf_dir):
    path = scratch(spark, "csv")
    rows = selection.query_timeseries(bindings.tidy(spark, sf_dir), "biomass", scenario=["a", "n"])
    export.export_csv(rows, path)
    back = spark.read.schema(rows.schema).option("header", True).csv(path)
    return back.select("model", "scenario", "variable", "freq", "date", "year", "month", "group_id", "value")


def _indexed_grids(spark, sf_dir):
    v = F.col("vec_id")
    parsed = _parsed_grids(spark, sf_dir).withColumns({
        "model_name": F.concat(F.lit("Model "), (v % 2).cast("string")), "model": F.lit(None).cast("string"),
        "scenario": F.concat(F.lit("s"), (v % 3).cast("string")), "variable": F.lit("biomass"),
        "group_name": F.concat(F.lit("Label no. "), F.col("raster_id")), "fleet_name": F.lit(None).cast("string"),
        "year": (1998 + v % 50).cast("int"),
    })
    return crs.with_crs(parsed).filter(F.col("crs_status") == "ok")


@query
def export_ascii(spark, sf_dir):
    maps = _indexed_grids(spark, sf_dir)
    windows = written(export.area_windows_as_arrays(_area_rows(spark, sf_dir)), "windows")
    out = export.ascii_grids(maps, windows).unionByName(export.ascii_grids(maps))
    return out.filter(F.col("text").isNotNull()).select("folder", "file", "text")


@query
def export_ascii_files(spark, sf_dir):
    maps, target = written(_indexed_grids(spark, sf_dir), "maps"), scratch(spark, "export + 1%")
    export.export_ascii(maps, target, written(export.area_windows_as_arrays(_area_rows(spark, sf_dir)), "windows"), [n for n, _ in AREAS])
    export.export_ascii(maps, target)
    return raw_files.read_texts(spark, target, "*.asc").select(F.col("parent").alias("folder"), F.col("name").alias("file"), "text")


@query
def map_outcomes(spark, sf_dir):
    return crs.map_outcomes(crs.with_crs(_parsed_grids(spark, sf_dir))).select("raster_id", "outcome", "reason")


# --- scalar functions --------------------------------------------------------------------

@query
def fn_slugify(spark, sf_dir):
    docs = bindings.table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(naming.slugify(F.col("text"))).alias("slug"))


@query
def fn_variable(spark, sf_dir):
    parts = bindings.table(spark, sf_dir, "part")
    suffix = F.element_at(F.array(*map(F.lit, ["_annual", "_monthly", ""])), (F.col("p_partkey") % 3 + 1).cast("int"))
    prefix = F.element_at(F.array(*map(F.lit, ["predation_", "prey_", "", "Catch-"])), (F.col("p_partkey") % 4 + 1).cast("int"))
    named = parts.select("p_partkey", F.concat(prefix, "p_name", F.lit(" "), "p_type", suffix).alias("stem"))
    return named.select("p_partkey", "stem", F.inline(F.array(naming.file_variable(F.col("stem")))))


@query
def fn_freq(spark, sf_dir):
    orders = bindings.table(spark, sf_dir, "orders")
    label = F.element_at(F.array(*map(F.lit, ["timestep\\group", "Year", "time", "year\\group"])), (F.col("o_orderkey") % 4 + 1).cast("int"))
    hint = F.when(F.col("o_orderstatus") == "F", "monthly").otherwise("annual")
    return orders.select("o_orderkey", periods.frequency(label, hint).alias("freq"))


@query
def fn_period(spark, sf_dir):
    lines = bindings.table(spark, sf_dir, "lineitem")
    step = F.col("l_quantity") + F.col("l_discount")  # whole steps after rounding
    year, month = periods.year_month(F.lit("monthly"), step, F.lit(1998))
    return lines.select("l_orderkey", "l_linenumber", year.alias("year"), month.alias("month")).withColumn(
        "date", periods.iso_date(F.col("year"), F.col("month"))
    )


@query
def fn_file_stem(spark, sf_dir):
    customers = bindings.table(spark, sf_dir, "customer")
    stem = naming.file_stem(
        F.concat(F.lit(" Gulf / "), "c_mktsegment"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")), F.lit("ssp1_a002"),
        F.lit("catch__x"), F.when(F.col("c_nationkey") > 5, F.concat("c_name", F.lit(" sp."))), F.col("c_nationkey"),
    )
    return customers.select("c_custkey", stem.alias("stem"))


@query
def fn_label(spark, sf_dir):
    suppliers = bindings.table(spark, sf_dir, "supplier")
    ident = F.when(F.col("s_suppkey") % 3 > 0, F.col("s_nationkey"))
    name = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name"))
    return suppliers.select("s_suppkey", naming.label("fleet", ident, name).alias("label"))


# --- selections --------------------------------------------------------------------------

FLAT = ["model", "model_name", "scenario", "variable", "freq", "date", "year", "month", "group_id", "group_name",
        "fleet_id", "partner_name", "value"]


@query
def query_timeseries(spark, sf_dir):
    rows = selection.query_timeseries(
        bindings.tidy(spark, sf_dir), "catch_fleet_group", model=["model_o"], scenario=["a", "r"],
        group_id=[1, 2, 3], fleet_id=[1, 5, 7, 11], year_from=1996, year_to=1999,
    )
    return selection.in_query_order(rows).select(*FLAT)


@query
def query_seasonal(spark, sf_dir):
    rows = selection.query_timeseries(bindings.tidy(spark, sf_dir), "biomass", "monthly", month_from=6, month_to=8)
    return rows.select(*FLAT)


def _stored_catalog(spark, sf_dir):
    """The catalog as ingest stores it; menus read this small table, never the values."""
    return written(catalog.catalog_datasets(bindings.tidy(spark, sf_dir)), "catalog")


def _stored_members(spark, sf_dir):
    """Dimension members as ingest stores them."""
    return written(catalog.dimension_members(bindings.tidy(spark, sf_dir)), "members")


@query
def list_datasets(spark, sf_dir):
    return catalog.list_datasets(_stored_catalog(spark, sf_dir), "a")


@query
def manifest_rows(spark, sf_dir):
    manifest = selection.Manifest.from_dict({
        "variables": ["totalcatch", {"variable": "biomass", "scenarios": ["a"]}, {"variable": "biomass", "scenarios": ["a", "n"]}],
        "scenarios": ["a", "r"], "freq": "annual", "year_from": 1997,
    })
    return selection.manifest_rows(bindings.tidy(spark, sf_dir), manifest).select(*FLAT, "item")


def _maps(spark, sf_dir):
    out = rasters.output_maps(bindings.map_files(spark, sf_dir), grids.read_run_info(bindings.run_info_files(spark, sf_dir)))
    return out.unionByName(rasters.input_maps(bindings.input_map_files(spark, sf_dir)))


def _index(spark, sf_dir):
    return rasters.raster_index(_maps(spark, sf_dir))


@query
def list_rasters(spark, sf_dir):
    return selection.list_rasters(_index(spark, sf_dir), "scn_0", "biomass", group="LABEL 3", year=None)


@query
def get_raster(spark, sf_dir):
    return selection.get_raster(_index(spark, sf_dir), "scn_0|output|biomass|label_3|2004").select(
        "id", "scenario", "domain", "variable", "year", "source_path"
    )


MAP_ITEMS = [
    selection.MapItem("biomass", 2003, 2030, ["Label 1", "Label 4"]), selection.MapItem("effort", 2001, 2050, ["Label 8"]),
    selection.MapItem("catch", 2001, 2002, ["Label 77"]), selection.MapItem("biomass", 2006, 2040, ["Label 4"]),
]


@query
def select_maps(spark, sf_dir):
    return selection.select_maps(_index(spark, sf_dir), "scn_0", MAP_ITEMS).select("item", "id", "entity", "year")


@query
def select_maps_summary(spark, sf_dir):
    chosen = selection.select_maps(_index(spark, sf_dir), "scn_0", MAP_ITEMS)
    return selection.select_maps_summary(chosen, MAP_ITEMS)


@query
def gate_scenarios(spark, sf_dir):
    index = catalog.variable_index(_stored_catalog(spark, sf_dir))
    gated = selection.gate_scenarios(
        index, ["model_f"], ["a", "n"], {("output", "biomass", "annual"): ["n", "r"], ("input", "click", "annual"): []},
    )
    return gated.select("domain", "variable", "freq", _text("available").alias("available"), _text("effective").alias("effective"))


# --- names and baselines -----------------------------------------------------------------

def _names(spark, sf_dir):
    return enrich.group_names(bindings.group_table_rows(spark, sf_dir))


def _baselines(spark, sf_dir):
    return enrich.group_baselines(bindings.group_table_rows(spark, sf_dir))


@query
def ecopath_names(spark, sf_dir):
    return _names(spark, sf_dir)


@query
def ecopath_baseline(spark, sf_dir):
    return _baselines(spark, sf_dir)


@query
def annotate_names(spark, sf_dir):
    names = written(_names(spark, sf_dir), "names")
    return enrich.annotate_names(bindings.tidy(spark, sf_dir), names).select(*FLAT)


@query
def ecopath_conflicts(spark, sf_dir):
    return enrich.disputed(bindings.group_table_rows(spark, sf_dir))


def _with_baseline(spark, sf_dir):
    baselines = written(_baselines(spark, sf_dir), "baselines")
    return enrich.annotate_baseline(bindings.tidy(spark, sf_dir), baselines)


@query
def annotate_baseline(spark, sf_dir):
    return _with_baseline(spark, sf_dir).select(*FLAT, "baseline")


@query
def relative_baseline(spark, sf_dir):
    rows = _with_baseline(spark, sf_dir).filter(F.col("variable") == "biomass")
    ratio = measures.relative_baseline(F.col("value"), F.col("baseline"))
    return rows.select("model", "scenario", "freq", "date", "group_id", F.round(ratio, 6).alias("ratio"))


# --- catalog -----------------------------------------------------------------------------

@query
def catalog_datasets(spark, sf_dir):
    return catalog.catalog_datasets(bindings.tidy(spark, sf_dir))


@query
def list_scenarios(spark, sf_dir):
    return catalog.list_scenarios(
        _stored_catalog(spark, sf_dir), store.merge_scenarios(bindings.scenarios(spark, sf_dir))
    )


@query
def list_models(spark, sf_dir):
    out = catalog.list_models(
        _stored_catalog(spark, sf_dir), store.merge_scenarios(bindings.scenarios(spark, sf_dir))
    )
    nested = F.transform("scenarios", lambda s: F.concat(s["scenario"], F.lit("="), s["label"]))
    return out.withColumn("scenarios", _text(nested))


@query
def scenario_tree(spark, sf_dir):
    tree = catalog.scenario_tree(_stored_catalog(spark, sf_dir))
    return tree.select("model", "model_name", "scenario", F.explode("domains").alias("d")).select(
        "model", "model_name", "scenario", F.col("d.domain").alias("domain"),
        _text(F.transform("d.variables", lambda v: F.concat_ws(
            "|", v["variable"], v["freq"], v["category"], *[v[k].cast("string") for k in ("year_min", "year_max", "n_groups", "n_fleets")]
        ))).alias("variables"),
    )


@query
def variable_index(spark, sf_dir):
    index = catalog.variable_index(_stored_catalog(spark, sf_dir))
    combos = F.transform("combos", lambda c: F.concat_ws("/", c["scenario"], c["model"]))
    return index.withColumns({"combos": _text(combos), "scenarios": _text(F.col("scenarios"))})


@query
def list_groups(spark, sf_dir):
    out = catalog.list_dimension(
        _stored_members(spark, sf_dir), "group", ["biomass", "catch_fleet_group"], scenarios=["a", "n"], names=_names(spark, sf_dir)
    )
    return out.withColumn("variables", _text(F.col("variables")))


@query
def list_fleets(spark, sf_dir):
    out = catalog.list_dimension(_stored_members(spark, sf_dir), "fleet", ["biomass", "catch_fleet_group"])
    return out.withColumn("variables", _text(F.col("variables")))


@query
def raster_layers(spark, sf_dir):
    return catalog.raster_layers(_index(spark, sf_dir))


@query
def assign_run_id(spark, sf_dir):
    rows = bindings.ensemble(spark, sf_dir)
    out = model_csv.assign_run_id(rows, written(model_csv.run_directories(rows), "run-directories"))
    return out.select("model", "scenario", "run_id", "year", "group_id", "value")


@query
def source_kind(spark, sf_dir):
    rows = bindings.ensemble(spark, sf_dir)
    directories = written(model_csv.run_directories(rows), "run-directories")
    return catalog.source_kind(model_csv.assign_run_id(rows, directories), _index(spark, sf_dir))


def _outcomes(spark, sf_dir):
    parsed = model_csv.parsed_files(bindings.series_files(spark, sf_dir))
    unknown = rasters.unrecognised_maps(bindings.map_files(spark, sf_dir))
    none = F.lit(None).cast("string")
    return parsed.select(F.lit("csv").alias("kind"), "status", "name", "message").unionByName(
        unknown.select(F.lit("map").alias("kind"), F.lit("unrecognised").alias("status"), "name", none.alias("message"))
    )


@query
def scan_report(spark, sf_dir):
    out = report.scan_report(_outcomes(spark, sf_dir))
    return out.withColumn("examples", _text(F.col("examples")))


@query
def scan_warnings(spark, sf_dir):
    return report.scan_warnings(report.scan_report(_outcomes(spark, sf_dir)))


@query
def merge_scenarios(spark, sf_dir):
    return store.merge_scenarios(bindings.scenarios(spark, sf_dir))


@query
def combine_sources(spark, sf_dir):
    out = bindings.scenarios(spark, sf_dir).filter(F.col("domain") == "output").drop("model")
    return store.combine([out, bindings.driver_scenarios(spark, sf_dir)], SCENARIOS)


# --- trends and charts -------------------------------------------------------------------

@query
def moving_average(spark, sf_dir):
    rows = bindings.biomass(spark, sf_dir)
    out = trends.moving_average(rows, 3, out="odd")
    out = trends.moving_average(out, 4, out="even")
    return out.select("model", "scenario", "group_id", "year", F.round("odd", 6).alias("odd"), F.round("even", 6).alias("even"))


@query
def relative_to_first(spark, sf_dir):
    rows = bindings.biomass(spark, sf_dir).withColumn("value", F.when(F.col("year") > 1995, F.col("value")))
    out = trends.relative_to_first(rows)
    return out.select("model", "scenario", "group_id", "year", F.round("relative", 6).alias("relative"))


@query
def trend_summary(spark, sf_dir):
    rows = bindings.biomass(spark, sf_dir).withColumn("value", F.when(F.col("year") < 2001, F.col("value")))
    out = trends.trend_summary(rows, ["model", "scenario", "group_id"])
    return out.select("model", "scenario", "group_id", "start", "end", F.round("change_pct", 6).alias("change_pct"))


@query
def label_order(spark, sf_dir):
    rows = bindings.catch_fleet_group(spark, sf_dir)
    return charts.label_order(rows, "fleet")


def _chart_rows(spark, sf_dir):
    return selection.query_timeseries(bindings.tidy(spark, sf_dir), "biomass", scenario=["a", "n"], model=["model_f"], group_id=[1, 2])


@query
def pivot_series(spark, sf_dir):
    series = [f"{s}{charts.KEY_SEPARATOR}Group {g}" for s in "an" for g in (1, 2)]
    return charts.pivot_series(charts.chart_points(_chart_rows(spark, sf_dir)), series)


@query
def chart_points(spark, sf_dir):
    rows = selection.query_timeseries(bindings.tidy(spark, sf_dir), "catch_fleet_group", scenario=["a"], model=["model_o"])
    return charts.chart_points(rows)


@query
def baseline_lines(spark, sf_dir):
    rows = _with_baseline(spark, sf_dir).filter((F.col("variable") == "biomass") & (F.col("freq") == "annual") & (F.col("scenario") == "a"))
    return charts.baseline_points(rows)


@query
def biomass_trend_compare(spark, sf_dir):
    rows = selection.manifest_rows(bindings.tidy(spark, sf_dir), selection.Manifest(["biomass"]))
    out = analysis.biomass_trend_compare(rows, {"smoothing": 3, "relative": True})["trends"]
    return out.select("model", "scenario", "group_id", "group", "year", F.round("smoothed", 6).alias("smoothed"))


@query
def analysis_plugin(spark, sf_dir):
    tables = analysis.run_analysis(
        bindings.tidy(spark, sf_dir), "biomass_trend_compare", selection.Manifest(["biomass"], scenarios=["a", "r"]), {"smoothing": 2},
    )
    out = tables["summary"]
    return out.select("model", "scenario", "group_id", "group", "start", "end", F.round("change_pct", 6).alias("change_pct"))


@query
def analysis_per_series(spark, sf_dir):
    def slope(rows):
        """Median of the slopes between every two years of a series, which no outlier moves."""
        x, y = rows["year"].to_numpy("float64"), rows["value"].to_numpy("float64")
        i, j = np.triu_indices(len(x), 1)
        line = rows.iloc[:1][["model", "scenario", "group_id"]].copy()
        line["slope"] = float(np.median((y[j] - y[i]) / (x[j] - x[i]))) if len(i) else None
        return line

    rows = bindings.biomass(spark, sf_dir)
    out = analysis.per_series(rows, slope, "model string, scenario string, group_id int, slope double")
    return out.withColumn("slope", F.round("slope", 6))


# --- scenarios against a baseline, ensembles ----------------------------------------------

@query
def scenario_effect(spark, sf_dir):
    rows = bindings.tidy(spark, sf_dir).filter((F.col("domain") == "output") & (F.col("freq") == "annual") & F.col("variable").isin("biomass", "totalcatch", "catch_fleet_group"))
    out = effects.paired_effect(rows, "a")
    return out.select(
        "model", "scenario", "variable", "year", "group_id", "fleet_id", "status", "value", "baseline", "absolute",
        F.round("percent", 6).alias("percent"), F.round("log_ratio", 6).alias("log_ratio"),
    )


@query
def scenario_unmatched(spark, sf_dir):
    rows = bindings.tidy(spark, sf_dir).filter(F.col("variable") == "catch_fleet_group")
    return effects.unmatched(effects.paired_effect(rows, "n"))


def _runs(spark, sf_dir):
    rows = bindings.ensemble(spark, sf_dir)
    return model_csv.assign_run_id(rows, written(model_csv.run_directories(rows), "run-directories"))


@query
def ensemble_kinds(spark, sf_dir):
    rows = _runs(spark, sf_dir)
    bare = rows.filter((F.col("scenario") == "r") & (F.col("year") == 1995)).withColumn("run_id", F.lit(None).cast("string"))
    return effects.ensemble_kinds(rows.unionByName(bare))


@query
def quantile_bands(spark, sf_dir):
    out = effects.quantile_bands(_runs(spark, sf_dir).filter(F.col("scenario").isin("a", "r")))
    return out.select("model", "scenario", "year", "group_id", "runs", *[F.round(c, 6).alias(c) for c in ("mean", "q05", "q25", "q50", "q75", "q95")])


# --- maps --------------------------------------------------------------------------------

INDEX = ["id", "model", "model_name", "scenario", "domain", "variable", "group_name", "fleet_name", "year", "run_id", "path", "source_path"]


@query
def raster_index(spark, sf_dir):
    return _index(spark, sf_dir).select(*INDEX)


@query
def dedupe_input_maps(spark, sf_dir):
    return rasters.input_maps(bindings.input_map_files(spark, sf_dir)).select("scenario", "variable", "year", "path")


@query
def raster_collisions(spark, sf_dir):
    return rasters.raster_collisions(_maps(spark, sf_dir)).select("id", "path", "kept_path", "message")


@query
def grid_meta(spark, sf_dir):
    return grids.grid_meta(grids.grid_headers(bindings.grid_files(spark, sf_dir)), "raster_id")


def _cells(spark, sf_dir):
    return grids.grid_cells(crs.with_crs(_parsed_grids(spark, sf_dir)).filter(F.col("crs_status") == "ok"), "raster_id", "crs")


@query
def raster_range(spark, sf_dir):
    return rasters.raster_range(grids.grid_cells(_parsed_grids(spark, sf_dir), "raster_id"))


@query
def raster_range_files(spark, sf_dir):
    opened = grids.measured_grids(_grid_folder(spark, sf_dir), split_bytes=150)
    return rasters.raster_range(grids.grid_rows(opened, "raster_id").select("raster_id", F.explode("values").alias("value")))


@query
def raster_range_all(spark, sf_dir):
    return rasters.raster_range_all(grids.grid_cells(_parsed_grids(spark, sf_dir), "raster_id"))


@query
def grid_crs(spark, sf_dir):
    return _headers(spark, sf_dir).select("raster_id", "crs", "crs_status")


@query
def crs_mismatch(spark, sf_dir):
    return crs.crs_mismatches(_headers(spark, sf_dir)).select("raster_id", "crs", "reason")


@query
def crs_candidates(spark, sf_dir):
    bad = crs.crs_mismatches(_headers(spark, sf_dir))
    return crs.crs_candidates(bad)


def _headers(spark, sf_dir):
    return crs.with_crs(grids.grid_headers(bindings.grid_files(spark, sf_dir)))


def _grids_ok(spark, sf_dir):
    return _headers(spark, sf_dir).filter(F.col("crs_status") == "ok")


@query
def cells_lonlat(spark, sf_dir):
    out = crs.cells_lonlat(_cells(spark, sf_dir))
    return out.select("raster_id", "crs", "row", "col", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "value")


@query
def regrid_nearest(spark, sf_dir):
    lookup = written(crs.lookup_rows(crs.regrid_lookup(_grids_ok(spark, sf_dir))), "lookup")
    out = crs.regrid_rows(_rows(spark, sf_dir), lookup, "raster_id")
    return out.select("raster_id", "out_row", "out_col", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), "value")


def _rows(spark, sf_dir):
    """The cells of the test maps, a row at a time."""
    return grids.array_rows(crs.with_crs(_parsed_grids(spark, sf_dir)).filter(F.col("crs_status") == "ok"), "raster_id", "crs")


def _areas(spark):
    """The test areas as a table; no area is a literal of a plan."""
    return written(areas.area_table(spark, AREAS), "areas")


def _area_rows(spark, sf_dir):
    return written(areas.area_rows(areas.area_windows(_grids_ok(spark, sf_dir), _areas(spark))), "area-rows")


def _masked(spark, sf_dir):
    return areas.mask_rows(_rows(spark, sf_dir), _area_rows(spark, sf_dir))


@query
def aoi_mask(spark, sf_dir):
    return areas.masked_cells(_masked(spark, sf_dir), "raster_id")


@query
def aoi_crop(spark, sf_dir):
    out = areas.masked_cells(_masked(spark, sf_dir), "raster_id", "row0", "col0", "rows", "cols")
    at = {"row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0")}
    return out.withColumns(at).select("raster_id", "area", "row", "col", "rows", "cols", "value")


@query
def aoi_skipped(spark, sf_dir):
    return areas.skipped(_grids_ok(spark, sf_dir).select("raster_id"), _masked(spark, sf_dir), _areas(spark))


@query
def aoi_union(spark, sf_dir):
    out = areas.union_rows(_rows(spark, sf_dir), _area_rows(spark, sf_dir))
    cells = out.select("raster_id", "row", F.posexplode(F.arrays_zip("values", "inside")).alias("col", "c"))
    return cells.filter("c.inside").select("raster_id", "row", "col", F.col("c.values").alias("value"))


@query
def crs_from_wkt(spark, sf_dir):
    """Systems told by their parameters, and where the south-west corner of each grid lies."""
    headers = grids.grid_headers(bindings.grid_files(spark, sf_dir).filter(F.col("vec_id") % 2 == 1)).withColumn("crs_wkt", bindings.told_wkt())
    placed = crs.cells_lonlat(crs.with_crs(headers).withColumns({"x": F.col("xll"), "y": F.col("yll")}))
    return placed.select("raster_id", "crs_status", F.round("lon", 7).alias("lon"), F.round("lat", 7).alias("lat"))


MAP_KEY = ["raster_id", "model", "scenario", "variable", "year"]


def _keyed_rows(spark, sf_dir):
    """The test maps with the keys of models, scenarios and years, a row of cells at a time."""
    parsed = bindings.with_map_keys(crs.with_crs(_parsed_grids(spark, sf_dir)).filter(F.col("crs_status") == "ok"))
    return grids.array_rows(parsed, "crs", *MAP_KEY)


def _weighed(spark, sf_dir, rows):
    weights = written(zonal.cell_areas(_grids_ok(spark, sf_dir)), "weights")
    return zonal.weighted_rows(zonal.with_kinds(rows), weights)


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def zonal_summary(spark, sf_dir):
    masked = areas.mask_rows(_keyed_rows(spark, sf_dir), _area_rows(spark, sf_dir))
    return _rounded(zonal.zonal_summary(_weighed(spark, sf_dir, masked), MAP_KEY))


@query
def inside_outside(spark, sf_dir):
    rows = _keyed_rows(spark, sf_dir)
    whole = _weighed(spark, sf_dir, rows)
    masked = _weighed(spark, sf_dir, areas.mask_rows(rows, _area_rows(spark, sf_dir)))
    sides = zonal.inside_outside(whole, masked, MAP_KEY)
    paired = zonal.paired_sides(sides, "base", ["model", "variable", "year"])
    percents = {f"{s}_percent": F.round(f"{s}_percent", 2) for s in ("inside", "outside")}  # of baselines as small as 1e-5
    return _rounded(paired.withColumns(percents))


@query
def map_difference(spark, sf_dir):
    out = zonal.map_difference(_keyed_rows(spark, sf_dir), "base", ["model", "variable", "year"])
    cells = out.select("model", "variable", "year", "scenario", "row", F.posexplode(F.arrays_zip("values", "baseline")).alias("col", "c"))
    return cells.select("model", "variable", "year", "scenario", "row", "col", F.col("c.values").alias("difference"), F.col("c.baseline").alias("baseline"))


@query
def cell_trend(spark, sf_dir):
    out = zonal.cell_trend(_keyed_rows(spark, sf_dir), ["model", "variable", "scenario"])
    return _rounded(out.select("model", "variable", "scenario", "row", "col", "years", "slope", "intercept", "r2"))


@query
def aoi_parse(spark, sf_dir):
    geo = bindings.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("area "), F.col("c_custkey").cast("string")).alias("area"), (F.col("c_nationkey") - 12.5).alias("x"),
        (F.col("c_acctbal") / 1000).alias("y"), (F.col("c_custkey") % 3).alias("k"),
    )
    p = lambda dx, dy: F.concat(F.lit("["), (F.col("x") + dx).cast("string"), F.lit(","), (F.col("y") + dy).cast("string"), F.lit("]"))
    ring = F.concat(F.lit("["), p(0, 0), F.lit(","), p(2, 0), F.lit(","), p(2, 3), F.lit(","), p(0, 0), F.lit("]"))
    shape = F.when(F.col("k") == 0, F.concat(F.lit('{"type":"Polygon","coordinates":['), ring, F.lit("]}"))).when(
        F.col("k") == 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":[['), ring, F.lit("],["), ring, F.lit(","), ring, F.lit("]]}"))
    ).otherwise(F.concat(F.lit('{"type":"Point","coordinates":'), p(0, 0), F.lit("}")))
    feature = F.concat(F.lit('{"type":"Feature","properties":{},"geometry":'), shape, F.lit("}"))
    collection = F.concat(F.lit('{"type":"FeatureCollection","features":['), feature, F.lit("]}"))
    geo = geo.select("area", F.when(F.col("k") == 1, feature).otherwise(collection).alias("geojson"))
    return areas.parse_areas(geo).drop("polygons")
