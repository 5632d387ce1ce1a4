"""Exports: selections as CSV, maps as ESRI ASCII grids."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ecolake.functions.naming import file_stem, name_part
from ecolake.session import batches_of
from ecolake.sources.files import open_path

# --- fixed values -----------------------------------------------------------------------
FULL_AREA = "full-area"
NUMBER_FORMAT = "%.15g"
TEXTS_AT_ONCE = 256  # maps that a Python worker holds: their cells, flags and texts
# ----------------------------------------------------------------------------------------


def export_csv(rows: DataFrame, path: str) -> None:
    """A selection as a folder of CSV files, each with a header line."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def area_windows_as_arrays(area: DataFrame) -> DataFrame:
    """:func:`ecolake.operators.areas.area_rows` (or ``area_cells``) with one row per (geometry, crs,
    area) and the window's ``inside`` flags as an array, row by row. As long as one grid."""
    by_row = area.schema["inside"].dataType.simpleString().startswith("array")
    flags = F.array_sort(F.collect_list(F.struct("row", "inside") if by_row else F.struct("row", "col", "inside")))
    inside = F.transform(flags, lambda s: s["inside"])
    return area.groupBy("geometry", "crs", "area", "row0", "col0", "rows", "cols").agg(
        (F.flatten(inside) if by_row else inside).alias("inside")
    )


@F.pandas_udf(T.StringType())
def _grid_text(
    cells: pd.Series, ncols: pd.Series, nrows: pd.Series, xll: pd.Series, yll: pd.Series, cellsize: pd.Series,
    nodata: pd.Series, row0: pd.Series, col0: pd.Series, rows: pd.Series, cols: pd.Series, inside: pd.Series,
) -> pd.Series:
    texts = []
    for c, w, h, x, y, cs, none, r0, c0, r, k, flags in zip(
        cells, ncols, nrows, xll, yll, cellsize, nodata, row0, col0, rows, cols, inside
    ):
        grid = np.array(c, dtype="float64").reshape(h, w)[r0:r0 + r, c0:c0 + k]
        grid = np.where(np.isnan(grid), none, grid)
        if flags is not None:
            grid = np.where(np.asarray(flags, dtype=bool).reshape(r, k), grid, none)
            if (grid == none).all():
                texts.append(None)
                continue
        number = lambda v: NUMBER_FORMAT % v
        head = (
            f"ncols {k}\nnrows {r}\nxllcorner {number(x + c0 * cs)}\n"
            f"yllcorner {number(y + (h - r0 - r) * cs)}\ncellsize {number(cs)}\nNODATA_value {number(none)}\n"
        )
        texts.append(head + "\n".join(" ".join(number(v) for v in line) for line in grid) + "\n")
    return pd.Series(texts, dtype="object")


def _stem(maps: DataFrame):
    """Name of a map's file; the run of an ensemble is part of it."""
    run = F.col("run_id") if "run_id" in maps.columns else F.lit(None).cast("string")
    return file_stem(
        F.col("area"), F.coalesce("model_name", "model"), F.col("scenario"), F.col("variable"),
        F.coalesce(F.nullif("group_name", F.lit("")), F.nullif("fleet_name", F.lit(""))), F.col("year").cast("string"), run,
    )


def ascii_grids(grids: DataFrame, windows: DataFrame | None = None) -> DataFrame:
    """One row per (map, area): ``folder``, ``file`` and ``text``; ``text`` is null when the
    area holds no value of the map.

    ``grids`` are parsed maps with the columns of the index; each is formatted whole in its
    own row. ``windows`` is :func:`area_windows_as_arrays` (one
    row per grid geometry and area); without it the full grid is written.
    """
    if windows is None:
        full = grids.withColumns({
            "area": F.lit(FULL_AREA), "row0": F.lit(0), "col0": F.lit(0), "rows": F.col("nrows"),
            "cols": F.col("ncols"), "inside": F.lit(None).cast("array<boolean>"),
        })
    else:
        # all maps of a model share one grid, so the key is split as often as there are tasks, and
        # the few windows are repeated
        parts = int(grids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = windows.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        part = F.pmod(F.xxhash64("raster_id"), F.lit(parts)).cast("int")
        full = grids.withColumn("_part", part).join(dealt, ["geometry", "crs", "_part"]).drop("_part")
    stem = _stem(full)
    text = _grid_text(*[F.col(c) for c in (
        "cells", "ncols", "nrows", "xll", "yll", "cellsize", "nodata", "row0", "col0", "rows", "cols", "inside",
    )])
    return full.select(
        "area", "raster_id", name_part(F.col("area")).alias("folder"),
        F.concat(stem, F.lit(".asc")).alias("file"), text.alias("text"),
    )


def write_named_texts(texts: DataFrame, target: str) -> DataFrame:
    """Write each ``text`` to ``<target>/<folder>/<file>`` from the executors; returns what was
    written. Files appear under their name only when complete, so a task that is lost and run
    again leaves no half-written file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = set()
        for pdf in batches:
            for folder, name, text in zip(pdf["folder"], pdf["file"], pdf["text"]):
                filesystem, base = open_path(posixpath.join(target, folder))
                if base not in made:
                    filesystem.create_dir(base, recursive=True)
                    made.add(base)
                temporary = posixpath.join(base, f".{uuid.uuid4().hex}")
                with filesystem.open_output_stream(temporary) as out:
                    out.write(text.encode("utf-8"))
                filesystem.move(temporary, posixpath.join(base, name))
            yield pdf[["folder", "file"]].assign(bytes=pdf["text"].str.len())

    usable = texts.filter(F.col("text").isNotNull()).select("folder", "file", "text")
    return usable.mapInPandas(write, "folder string, file string, bytes long")


def export_ascii(grids: DataFrame, target: str, windows: DataFrame | None = None, areas: list[str] | None = None) -> dict[str, int]:
    """Write maps as grid files; returns the number of files and of skipped (map, area) pairs,
    and leaves the lists themselves beside the files as ``_manifest/written`` and ``/skipped``.
    Two maps that would get one name are an error, told before anything is written."""
    texts = ascii_grids(grids, windows)
    twice = texts.groupBy("folder", "file").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"{twice['count']} maps would be written as {twice['folder']}/{twice['file']}")
    done = write_named_texts(texts, target)
    spark = grids.sparkSession
    with batches_of(spark, TEXTS_AT_ONCE):
        done.write.mode("overwrite").parquet(f"{target}/_manifest/written")
    wrote = spark.read.parquet(f"{target}/_manifest/written")
    if areas is None:
        return {"files": wrote.count(), "skipped": 0}
    asked = grids.withColumn("area", F.explode(F.array(*map(F.lit, areas))))
    stem = _stem(asked)
    asked = asked.select(
        name_part(F.col("area")).alias("folder"), F.concat(stem, F.lit(".asc")).alias("file"),
    )
    # names are many and pack well: by the size of their table alone the driver would collect them
    missing = asked.join(wrote.hint("merge"), ["folder", "file"], "left_anti").withColumn("reason", F.lit("the area holds no value of this map"))
    missing.write.mode("overwrite").parquet(f"{target}/_manifest/skipped")
    return {"files": wrote.count(), "skipped": spark.read.parquet(f"{target}/_manifest/skipped").count()}
