"""What kind of files a folder holds, told by names and the head of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecolake.functions.csvline import split_csv, split_lines
from ecolake.functions.measures import to_number
from ecolake.functions.naming import strip
from ecolake.session import computed_once
from ecolake.sources.grids import INPUT_YEAR, output_names
from ecolake.sources.model_csv import (
    MAP_SCENARIO_FIELD, MODEL_FIELD, SCENARIO_FIELD, header_blocks, with_headers,
)

# --- fixed values -----------------------------------------------------------------------
MODEL_LAYERS = ["ecospace", "ecosim", "ecopath"]  # deepest first
MODEL_FILE_SUFFIXES = [".ewemdb", ".eweaccdb"]
SERIES_LABELS = ["title", "weight", "pool code", "pool code 2", "type"]
# ----------------------------------------------------------------------------------------


def smallest(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """The ``k`` alphabetically first distinct values per key, as a sorted array. Only ``k``
    rows per key and task leave the map side (the rank filter runs before the shuffle)."""
    order = Window.partitionBy(*keys).orderBy(value)
    kept = (
        df.filter(F.col(value).isNotNull()).select(*keys, value).distinct()
        .withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)
    )
    return kept.groupBy(*keys).agg(F.array_sort(F.collect_list(value)).alias(name))


def with_layer(files: DataFrame) -> DataFrame:
    """Add ``layer`` (deepest model layer among the header blocks; maps belong to the
    spatial one), ``model_name`` and ``scenario_name``. ``text`` may be just the head."""
    readable = F.col("suffix").isin(".csv", ".txt")
    out = computed_once(files, _head=F.when(readable, header_blocks(F.col("text"))))
    layer = F.when(F.col("suffix") == ".asc", MODEL_LAYERS[0])
    for name in MODEL_LAYERS:
        layer = layer.when(F.array_contains("_head.names", name), name)
    field = lambda name: F.nullif(F.try_element_at("_head.fields", F.lit(name)), F.lit(""))
    return out.withColumn("layer", layer).withColumns({
        "model_name": field(MODEL_FIELD),
        "scenario_name": F.when(F.col("layer") == "ecospace", field(MAP_SCENARIO_FIELD))
        .when(F.col("layer") == "ecosim", field(SCENARIO_FIELD)),
    }).drop("_head")


def identify_output(files: DataFrame, names: int = 20) -> DataFrame:
    """Per model layer: number of files and maps, how many model and scenario names there are
    (``n_models``, ``n_scenarios``), and the first ``names`` of each; :func:`layer_names` has all."""
    layered = with_layer(files).filter(F.col("layer").isNotNull()).select(
        "layer", "suffix", "model_name", "scenario_name",
    )
    per_name = layered.groupBy("layer", "model_name", "scenario_name").agg(
        F.count("*").alias("files"), F.count_if(F.col("suffix") == ".asc").alias("maps"),
    )
    counts = per_name.groupBy("layer").agg(
        F.sum("files").alias("files"), F.sum("maps").alias("maps"),
        F.count_distinct("model_name").alias("n_models"), F.count_distinct("scenario_name").alias("n_scenarios"),
    )
    models = smallest(layered, ["layer"], "model_name", names, "models")
    scenarios = smallest(layered, ["layer"], "scenario_name", names, "scenarios")
    return counts.join(models, "layer", "left").join(scenarios, "layer", "left").withColumns({
        "models": F.coalesce("models", F.array().cast("array<string>")),
        "scenarios": F.coalesce("scenarios", F.array().cast("array<string>")),
    })


def layer_names(files: DataFrame) -> DataFrame:
    """Every model and scenario name per layer: ``layer``, ``kind`` (model or scenario), ``name``
    and number of files."""
    layered = with_layer(files).filter(F.col("layer").isNotNull())
    named = layered.select("layer", F.inline(F.array(
        F.struct(F.lit("model").alias("kind"), F.col("model_name").alias("name")),
        F.struct(F.lit("scenario").alias("kind"), F.col("scenario_name").alias("name")),
    )))
    return named.filter(F.col("name").isNotNull()).groupBy("layer", "kind", "name").agg(F.count("*").alias("files"))


def _series_rows(text: Column) -> Column:
    return F.filter(F.transform(split_lines(text), split_csv), lambda c: (F.size(c) > 1) | (F.get(c, F.lit(0)) != ""))


def is_series_input(text: Column) -> Column:
    """A fitting time-series table: ``Title`` first, then labelled rows with ``Type`` among
    the next five, all of them known labels or whole numbers."""
    rows = _series_rows(text)
    label = lambda c: F.lower(strip(F.get(c, F.lit(0))))
    labels = F.transform(F.slice(rows, 2, 5), label)
    known = F.forall(labels, lambda l: l.isin(*SERIES_LABELS) | l.rlike("^-*[0-9]+$"))
    return F.coalesce((label(F.get(rows, F.lit(0))) == "title") & F.array_contains(labels, "type") & known, F.lit(False))


def with_input_kind(files: DataFrame) -> DataFrame:
    """Add ``kind`` of model input and, for time-series tables, their number of ``series``."""
    kind = (
        F.when(F.col("suffix").isin(*MODEL_FILE_SUFFIXES), "ecopath_model")
        .when(F.col("suffix").isin(".asc", ".shp"), "ecospace_maps")
        .when((F.col("suffix") == ".csv") & F.lower("name").startswith("trend_"), "driver_trends")
        .when((F.col("suffix") == ".csv") & is_series_input(F.col("text")), "ecosim_timeseries")
    )
    series = F.greatest(F.lit(0), F.size(F.get(_series_rows(F.col("text")), F.lit(0))) - 1)
    return computed_once(files, kind=kind).withColumn(
        "series", F.when(F.col("kind") == "ecosim_timeseries", series)
    )


def identify_input(files: DataFrame, names_kept: int = 20) -> DataFrame:
    """Per kind of model input: files (shape files apart), series, how many names model files
    have and the first ``names_kept`` of them."""
    found = with_input_kind(files).filter(F.col("kind").isNotNull()).select("kind", "suffix", "name", "series")
    counts = found.groupBy("kind").agg(
        F.count_if(F.col("suffix") != ".shp").alias("files"),
        F.count_if(F.col("suffix") == ".shp").alias("shapefiles"),
        F.coalesce(F.sum("series"), F.lit(0)).alias("series"),
        F.count_distinct(F.when(F.col("kind") == "ecopath_model", F.col("name"))).alias("n_names"),
    )
    names = smallest(found.filter(F.col("kind") == "ecopath_model"), ["kind"], "name", names_kept, "names")
    return counts.join(names, "kind", "left").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>"))
    )


def group_tables(files: DataFrame) -> DataFrame:
    """Group tables of the static model: one row per (file, group) with the group's ``name``
    (when the second column is ``Group``) and its ``baseline`` biomass (column ``B``)."""
    has_table = F.contains(F.col("text"), F.lit("GroupNo"))
    static = with_layer(files.filter(has_table)).filter(F.col("layer") == "ecopath")
    rows = F.filter(F.transform(split_lines(F.col("text")), split_csv), lambda c: F.get(c, F.lit(0)) != "")
    at = F.array_position(F.transform("_rows", lambda c: strip(F.get(c, F.lit(0)))), "GroupNo")
    head = F.transform(F.get("_rows", F.col("_at").cast("int") - 1), strip)
    table = computed_once(computed_once(static, _rows=rows), _at=at).filter(F.col("_at") > 0).withColumn("_head", head)
    lines = table.select(
        "path", "model_name", "_head",
        F.explode(F.slice("_rows", F.col("_at").cast("int") + 1, F.size("_rows"))).alias("c"),
    )
    cell = lambda i: F.get("c", i)
    b = F.array_position("_head", "B").cast("int")
    return lines.select(
        "path", "model_name", strip(cell(F.lit(0))).alias("_id"),
        F.when(F.get("_head", F.lit(1)) == "Group", strip(cell(F.lit(1)))).alias("name"),
        F.when(b > 0, to_number(F.try_element_at("c", F.when(b > 0, b)))).alias("baseline"),
    ).filter(F.col("_id").rlike("^[0-9]+$")).select(
        "path", "model_name", F.col("_id").cast("int").alias("group_id"), "name", "baseline",
    ).filter(F.col("name").isNotNull() | F.col("baseline").isNotNull())


def _any(df: DataFrame, check: str) -> DataFrame:
    """One row telling whether ``df`` has a row. Partitions are tried a few at a time and reading
    stops at the first row."""
    found = not df.isEmpty()
    return df.sparkSession.range(1).select(F.lit(check).alias("check"), F.lit(found).alias("found"))


def validate_output(files: DataFrame) -> DataFrame:
    """Is there any model output here: a time-series export, or a map with a known name?"""
    csv = with_headers(files.filter(F.col("suffix") == ".csv")).filter(F.col("scenario").isNotNull())
    maps = output_names(files.filter(F.col("suffix") == ".asc").select("name")).filter(F.col("variable").isNotNull())
    return _any(csv, "output_csv").unionByName(_any(maps, "output_map"))


def validate_input(files: DataFrame) -> DataFrame:
    """Is there any model input here: a driver trend, a dated map, or a recognised input file?"""
    trends = files.filter(F.col("name").rlike(r"^trend_.*\.csv$"))
    maps = files.filter((F.col("suffix") == ".asc") & F.col("name").rlike(INPUT_YEAR))
    known = with_input_kind(files).filter(F.col("kind").isNotNull())
    return (
        _any(trends, "trend_csv").unionByName(_any(maps, "input_map")).unionByName(_any(known, "recognised_input"))
    )
