"""Statistics of areas and cells: weighted by true cell areas, by the kind of the variable, and
paired over scenarios and years.

Everything goes by rows of cells (``values`` from column ``col`` on, see ``sources.grids.grid_rows``):
a row of a map meets the row of its grid that knows the cells' areas, and the row of an area that
knows which cells are inside, and leaves as a few sums that combine before any shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.geodesy import GRS80, to_lonlat
from ecolake.operators.crs import geometries
from ecolake.operators.effects import effects
from ecolake.session import small_table, written

# --- fixed values: how a variable adds up over an area ----------------------------------
DENSITY, RATE, FRACTION = "density", "rate", "fraction"
VARIABLE_KINDS = [
    ("biomass", DENSITY),
    ("catch", DENSITY),
    ("discards", DENSITY),
    ("effort", DENSITY),
    ("habitat_capacity", FRACTION),
]
# ----------------------------------------------------------------------------------------

_ROW = ["geometry", "crs", "row"]


def _authalic(lat: Column) -> Column:
    """Height of a parallel in the equal-area cylindrical projection of the ellipsoid, in radians
    times half the squared radius: areas there are true."""
    a, f = GRS80
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    s = F.sin(F.radians(lat))
    return (a * a / 2) * (1 - e2) * (s / (1 - e2 * s * s) + F.atanh(e * s) / e)


def cell_areas(grids: DataFrame) -> DataFrame:
    """True areas in square kilometres per row of each (geometry, crs): ``areas``, one per column.

    A cell's corners are placed in degrees and the quadrangle between them is measured in the
    equal-area cylindrical projection: exact for cells in degrees, and for small cells of any
    other system, whatever it does to areas itself. A corner that cannot be placed gives null.
    """
    c = F.col
    rows = geometries(grids).withColumn("row", F.explode(F.sequence(F.lit(0), c("nrows") - 1))).repartition("geometry", "crs", "row")
    top = c("yll") + c("cellsize") * (c("nrows") - c("row"))

    def line(y: Column) -> Column:
        placed = lambda k: to_lonlat(c("crs"), c("xll") + c("cellsize") * k, y)
        at = F.transform(F.sequence(F.lit(0), c("ncols")), placed)
        return F.transform(at, lambda p: F.struct(F.radians(p["a"]).alias("x"), _authalic(p["b"]).alias("y")))

    lined = rows.withColumns({"_n": line(top), "_s": line(top - c("cellsize"))})

    def area(k: Column) -> Column:
        nw, ne, se, sw = F.get("_n", k), F.get("_n", k + 1), F.get("_s", k + 1), F.get("_s", k)
        return F.abs((nw["x"] - se["x"]) * (ne["y"] - sw["y"]) - (ne["x"] - sw["x"]) * (nw["y"] - se["y"])) / 2e6

    return lined.select(*_ROW, F.transform(F.sequence(F.lit(0), c("ncols") - 1), area).alias("areas"))


def with_kinds(maps: DataFrame, kinds: list[tuple[str, str]] | None = None) -> DataFrame:
    """Add ``kind``: how the variable adds up over an area; null for one that is not known."""
    return maps.join(small_table(maps.sparkSession, ["variable", "kind"], kinds or VARIABLE_KINDS), "variable", "left")


def weighted_rows(rows: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of cells with ``areas``, the true area of each value's cell."""
    met = rows.join(areas, _ROW)
    return met.withColumn("areas", F.slice("areas", F.col("col") + 1, F.size("values")))


def _sums(parts: Column, chosen) -> Column:
    """Count, area and area-weighted sum of the chosen cells that have a value."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("a"), F.lit(0.0).alias("va"))
    counts = lambda p: p["values"].isNotNull() & ~F.isnan(p["values"]) & chosen(p)
    return F.aggregate(F.filter(parts, counts), none, lambda s, p: F.struct(
        (s["n"] + 1).alias("n"), (s["a"] + p["areas"]).alias("a"), (s["va"] + p["values"] * p["areas"]).alias("va"),
    ))


def _stats(prefix: str, n: Column, a: Column, va: Column) -> dict[str, Column]:
    """Sum and mean of a side by the variable's kind: a density has both, a fraction has a mean only,
    a rate has neither, for its mean would need the biomass as weight."""
    kind, some = F.col("kind"), n > 0
    return {
        f"{prefix}cells": n,
        f"{prefix}area_km2": F.when(some, a).otherwise(0.0),
        f"{prefix}sum": F.when(some & (kind == DENSITY), va),
        f"{prefix}mean": F.when(some & kind.isin(DENSITY, FRACTION), F.try_divide(va, a)),
    }


def zonal_summary(masked: DataFrame, key: list[str]) -> DataFrame:
    """Per map (``key`` and ``kind``) and area: cells with a value, their true area, sum and mean.
    ``masked`` are :func:`weighted_rows` cut to areas (``operators.areas.mask_rows`` of rows, then
    weighted), with ``inside``."""
    part = _sums(F.arrays_zip("values", "inside", "areas"), lambda p: p["inside"])
    sums = masked.select(*key, "kind", "area", part.alias("s")).groupBy(*key, "kind", "area").agg(
        F.sum("s.n").alias("n"), F.sum("s.a").alias("a"), F.sum("s.va").alias("va")
    )
    stats = _stats("", F.col("n"), F.col("a"), F.col("va"))
    return sums.select(*key, "kind", "area", *[v.alias(k) for k, v in stats.items()])


def rate_means(masked: DataFrame, weights: DataFrame, key: list[str], weight_key: list[str]) -> DataFrame:
    """Mean of a rate per map and area, weighted by biomass (and not by area): ``weights`` are rows
    of biomass maps (``weight``, values from the same column on) that meet the rate's rows on
    ``weight_key`` and their place. Cells without a weight do not count."""
    other = weights.select(*weight_key, *_ROW, "col", F.col("values").alias("weight"))
    met = masked.filter(F.col("kind") == RATE).join(other.withColumnRenamed("col", "_col"), [*weight_key, *_ROW])
    lined = F.slice("weight", F.col("col") - F.col("_col") + 1, F.size("values"))
    met = met.filter((F.col("col") >= F.col("_col")) & (F.col("col") < F.col("_col") + F.size("weight"))).withColumn("weight", lined)
    zipped = F.filter(F.arrays_zip("values", "inside", "weight", "areas"), lambda p: p["inside"] & p["values"].isNotNull() & (p["weight"] > 0))
    none = F.struct(F.lit(0.0).alias("w"), F.lit(0.0).alias("vw"))
    part = F.aggregate(zipped, none, lambda s, p: F.struct(
        (s["w"] + p["weight"] * p["areas"]).alias("w"), (s["vw"] + p["values"] * p["weight"] * p["areas"]).alias("vw"),
    ))
    sums = met.select(*key, "area", part.alias("s")).groupBy(*key, "area").agg(F.sum("s.w").alias("w"), F.sum("s.vw").alias("vw"))
    return sums.select(*key, "area", F.try_divide("vw", "w").alias("mean"))


def inside_outside(rows: DataFrame, masked: DataFrame, key: list[str]) -> DataFrame:
    """Per map and area both sides of it: cells, true area, sum and mean inside, and the same of the
    rest of the map. ``rows`` are the whole maps (:func:`weighted_rows` with ``kind``), ``masked`` the
    same cut to areas. The outside is the map less the inside; the number of cells, a whole number,
    tells whether there is one."""
    total = rows.select(*key, "kind", _sums(F.arrays_zip("values", "areas"), lambda p: F.lit(True)).alias("s")).groupBy(*key, "kind").agg(
        F.sum("s.n").alias("tn"), F.sum("s.a").alias("ta"), F.sum("s.va").alias("tva")
    )
    part = _sums(F.arrays_zip("values", "inside", "areas"), lambda p: p["inside"])
    inner = masked.select(*key, "area", part.alias("s")).groupBy(*key, "area").agg(
        F.sum("s.n").alias("n"), F.sum("s.a").alias("a"), F.sum("s.va").alias("va")
    )
    c = F.col
    both = total.join(inner, key)
    stats = _stats("inside_", c("n"), c("a"), c("va")) | _stats("outside_", c("tn") - c("n"), c("ta") - c("a"), c("tva") - c("va"))
    return both.select(*key, "kind", "area", *[v.alias(k) for k, v in stats.items()])


def paired_sides(sides: DataFrame, baseline: str, key: list[str]) -> DataFrame:
    """:func:`inside_outside` of every scenario against ``baseline``: effect inside, effect outside
    and the difference of the two changes. ``key`` is the map's without ``scenario``."""
    sides = written(sides.select(*key, "area", "scenario", "inside_mean", "outside_mean"), "sides")
    base = sides.filter(F.col("scenario") == baseline).select(*key, "area", F.col("inside_mean").alias("inside_base"), F.col("outside_mean").alias("outside_base"))
    met = sides.filter(F.col("scenario") != baseline).join(base, [*key, "area"])
    out = dict(
        [(f"inside_{k}", v) for k, v in effects(F.col("inside_mean"), F.col("inside_base")).items()]
        + [(f"outside_{k}", v) for k, v in effects(F.col("outside_mean"), F.col("outside_base")).items()]
    )
    met = met.withColumns(out)
    return met.withColumn("contrast", F.col("inside_absolute") - F.col("outside_absolute"))


def map_difference(rows: DataFrame, baseline: str, key: list[str]) -> DataFrame:
    """Rows of cells of every scenario less those of ``baseline``: ``values`` are the differences (null
    where either side has none), ``baseline`` the values they are taken from. Maps meet on ``key`` (all but
    the scenario), their grid, and the place of the array's first cell, an equi-join of rows."""
    base = rows.filter(F.col("scenario") == baseline).select(*key, *_ROW, "col", F.col("values").alias("baseline"))
    met = rows.filter(F.col("scenario") != baseline).join(base, [*key, *_ROW, "col"])
    return met.withColumn("values", F.zip_with("values", "baseline", lambda v, b: v - b))


def cell_trend(rows: DataFrame, key: list[str]) -> DataFrame:
    """Linear trend over the years of each cell: number of ``years`` with a value, ``slope`` per year,
    ``intercept`` and ``r2`` (null below two years). ``key`` is the map's without ``year``. The sums of a
    cell's regression combine in the tasks, so a cell's years need not meet."""
    cells = rows.select(*key, "geometry", "crs", "row", F.col("col").alias("_first"), "year", F.posexplode("values").alias("_at", "value"))
    cells = cells.filter(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("col", F.col("_first") + F.col("_at"))
    years = F.count("*")
    return cells.groupBy(*key, "geometry", "crs", "row", "col").agg(
        years.alias("years"), F.regr_slope("value", "year").alias("slope"), F.regr_intercept("value", "year").alias("intercept"), F.regr_r2("value", "year").alias("r2"),
    )
