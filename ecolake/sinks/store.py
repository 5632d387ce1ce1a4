"""The store: partitioned Parquet tables, one folder per source.

``<root>/timeseries/source_id=<id>/model=/scenario=/domain=/variable=/freq=`` holds the series
and ``<root>/cells/source_id=<id>/model=/scenario=/domain=/variable=`` the map cells. A source
is rewritten or removed without touching any other.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecolake.schema import CELLS, LEDGER, MAP_OUTCOMES, SLICE, TIDY
from ecolake.session import delete_path, written

CELL_SLICE = ["model", "scenario", "domain", "variable"]
TABLES = ["timeseries", "cells", "cells_ledger", "map_outcomes", "rasters", "scenarios", "models", "layers", "groups", "reports", "kinds", "members", "catalog"]


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order and type; missing ones null, others dropped."""
    return df.select(*[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema
    ])


def _write(df: DataFrame, path: str, keys: list[str], mode: str, dynamic: bool = False) -> None:
    # Rebalancing gives each slice few files, and splits the slices too big for one task.
    # The mode is stated, so that no setting of the session changes what an overwrite replaces.
    writer = df.hint("rebalance", *keys).write.partitionBy(*keys).mode(mode)
    writer.option("partitionOverwriteMode", "dynamic" if dynamic else "static").parquet(path)


def write_slices(rows: DataFrame, path: str) -> None:
    """Write tidy rows, replacing exactly the slices they contain. No rows is an error."""
    tidy = conform(rows, TIDY)
    if tidy.isEmpty():
        raise ValueError("refusing to write an empty dataset")
    _write(tidy, path, SLICE, "overwrite", dynamic=True)


def replace_slices(rows: DataFrame, root: str, source_id: str) -> DataFrame:
    """Replace exactly the slices of one source that ``rows`` contain; returns these slices."""
    tidy = conform(rows, TIDY)
    if tidy.isEmpty():
        raise ValueError("refusing to write an empty dataset")
    slices = written(tidy.select(*SLICE).distinct(), "slices")
    _write(tidy, source_path(root, "timeseries", source_id), SLICE, "overwrite", dynamic=True)
    return slices


def source_path(root: str, table: str, source_id: str) -> str:
    return f"{root}/{table}/source_id={source_id}"


def replace_source(rows: DataFrame, root: str, source_id: str) -> None:
    """Make ``rows`` all there is of one source; slices it no longer has disappear."""
    _write(conform(rows, TIDY), source_path(root, "timeseries", source_id), SLICE, "overwrite")


def remove_source(spark: SparkSession, root: str, source_id: str) -> None:
    """Remove one source from every table; the store stays readable, even when nothing is left."""
    for table in TABLES:
        delete_path(spark, source_path(root, table, source_id))
        spark.catalog.refreshByPath(f"{root}/{table}")


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stored table with the given schema; an empty one when the folder is not there. The
    schema is given, so no file is opened to infer it and ids stay text."""
    try:
        return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())
    except AnalysisException as failure:
        if failure.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def scan_store(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The tidy tables of several folders as one, by column name. Filters on scenario,
    domain, variable and freq skip partitions, others skip Parquet row groups."""
    out = spark.createDataFrame([], TIDY)
    for path in paths:
        out = out.unionByName(read_table(spark, path, TIDY), allowMissingColumns=True)
    return out


def scan_sources(spark: SparkSession, root: str, source_ids: list[str] | None = None) -> DataFrame:
    """All (or the given) sources of one store, with their ``source_id``."""
    schema = T.StructType([*TIDY.fields, T.StructField("source_id", T.StringType())])
    out = read_table(spark, f"{root}/timeseries", schema)
    return out.filter(F.col("source_id").isin(source_ids)) if source_ids is not None else out


def combine(tables: list[DataFrame], schema: T.StructType) -> DataFrame:
    """Tables of several sources as one, conformed to ``schema``."""
    out = conform(tables[0], schema)
    for table in tables[1:]:
        out = out.unionByName(conform(table, schema))
    return out


def merge_scenarios(scenarios: DataFrame) -> DataFrame:
    """One row per scenario id; one known from outputs beats the same id from drivers."""
    order = F.struct((F.col("domain") != "output").alias("driver"), "model", "label")
    rest = [c for c in scenarios.columns if c != "id"]
    kept = scenarios.groupBy("id").agg(F.min_by(F.struct(*rest), order).alias("s"))
    return kept.select("id", *[F.col(f"s.{c}").alias(c) for c in rest])


def dim_scenarios(runs: DataFrame, drivers: DataFrame | None = None) -> DataFrame:
    """Scenario table from discovered runs (and driver files, labelled with their id in capitals)."""
    out = runs.select(
        F.col("scenario").alias("id"), F.col("scenario_label").alias("label"),
        F.lit("output").alias("domain"), "model", "model_name",
    )
    if drivers is not None:
        none = F.lit(None).cast("string")
        out = out.unionByName(drivers.select("scenario").distinct().select(
            F.col("scenario").alias("id"), F.upper("scenario").alias("label"),
            F.lit("input").alias("domain"), none.alias("model"), none.alias("model_name"),
        ))
    return merge_scenarios(out)


def dim_models(runs: DataFrame) -> DataFrame:
    """Model table (id, name) from discovered runs."""
    return runs.groupBy(F.col("model").alias("id")).agg(F.min("model_name").alias("name"))


def unstored_maps(wanted: DataFrame, spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """Those of the wanted index rows (``model``, ``id``) whose cells are not stored. Which maps
    are is told by a ledger with a row per map, never by the cells."""
    ledger = read_table(spark, source_path(root, "cells_ledger", source_id), LEDGER)
    same = F.col("id").eqNullSafe(F.col("_id")) & F.col("model").eqNullSafe(F.col("_model"))
    return wanted.join(ledger.select(F.col("model").alias("_model"), F.col("raster_id").alias("_id")), same, "left_anti")


def materialise_cells(wanted: DataFrame, root: str, source_id: str, parse) -> None:
    """Store the cells of the wanted maps that are not stored yet. ``wanted`` are index rows
    (``model``, ``id``, ``source_path``); ``parse(missing)`` reads those files and returns cells, or
    cells and an outcome per map (``model``, ``id``, ``domain``, ``outcome``, ``reason``). Maps that
    are not ``ok`` have an outcome in the store (:func:`read_outcomes`), stay out of the ledger and
    are tried again by the next call. The cells are written first and the ledger after them, so a
    call that failed between the two is made good by clearing the source's cells."""
    spark = wanted.sparkSession
    missing = written(unstored_maps(wanted, spark, root, source_id).select(*wanted.columns), "missing")
    parsed = parse(missing)
    cells, outcomes = parsed if isinstance(parsed, tuple) else (parsed, missing.withColumns({"outcome": F.lit("ok"), "reason": F.lit(None).cast("string")}))
    append_cells(cells, root, source_id)
    tried = conform(outcomes.withColumn("raster_id", F.col("id")), MAP_OUTCOMES)
    same = F.col("raster_id").eqNullSafe(F.col("_id")) & F.col("model").eqNullSafe(F.col("_model"))
    now = tried.select(F.col("raster_id").alias("_id"), F.col("model").alias("_model"))
    kept = read_outcomes(spark, root, source_id).join(now, same, "left_anti")
    tried = written(kept.unionByName(tried), "outcomes")
    good = tried.filter("outcome = 'ok'").join(now, same, "left_semi")
    conform(good, LEDGER).write.mode("append").parquet(source_path(root, "cells_ledger", source_id))
    path = source_path(root, "map_outcomes", source_id)
    tried.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
    spark.catalog.refreshByPath(path)


def read_outcomes(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    """What became of every map that was opened on demand (``outcome``, ``reason``)."""
    return read_table(spark, source_path(root, "map_outcomes", source_id), MAP_OUTCOMES)


def append_cells(cells: DataFrame, root: str, source_id: str) -> None:
    _write(conform(cells, CELLS), source_path(root, "cells", source_id), CELL_SLICE, "append")


def read_cells(spark: SparkSession, root: str, source_id: str) -> DataFrame:
    return read_table(spark, source_path(root, "cells", source_id), CELLS)


def clear_cells(spark: SparkSession, root: str, source_id: str, domain: str | None = None) -> None:
    """Drop the stored cells of a source, or of one domain of it (its coordinate system
    changed). Cells are partitioned by domain, so folders are deleted and nothing is rewritten."""
    cells, ledger = source_path(root, "cells", source_id), source_path(root, "cells_ledger", source_id)
    outcomes = source_path(root, "map_outcomes", source_id)
    if domain is None:
        for path in (ledger, cells, outcomes):
            delete_path(spark, path)
    else:
        entries = read_table(spark, ledger, LEDGER)
        kept = written(entries.filter(~F.col("domain").eqNullSafe(domain)), "ledger")
        folders = read_cells(spark, root, source_id).filter(F.col("domain").eqNullSafe(domain))
        gone = {f.rsplit("/variable=", 1)[0] for f in folders.inputFiles() if f"/domain={domain}/" in f}
        tried = written(read_outcomes(spark, root, source_id).filter(~F.col("domain").eqNullSafe(domain)), "outcomes")
        for table, path in ((kept, ledger), (tried, outcomes)):
            table.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(path)
        for folder in gone:
            delete_path(spark, folder)
    for path in (cells, ledger, outcomes):
        spark.catalog.refreshByPath(path)
