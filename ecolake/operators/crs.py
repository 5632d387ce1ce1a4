"""Coordinate systems of maps.

All maps of a model share one grid, so positions are worked out once per ``geometry`` (a few
rows) and joined to the cells, never computed per map.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.geodesy import CANDIDATE_CRS, GEOGRAPHIC, WGS84, from_lonlat, known_crs, to_lonlat, told_crs
from ecolake.session import computed_once, let
from ecolake.sources.grids import GRID_COLUMNS, center_x, center_y, row_cells

# --- fixed values -----------------------------------------------------------------------
EDGE_POINTS = 21  # points added to each edge before it is projected
EPSG_IN_WKT = r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$'
UTM_IN_WKT = r'(?i)^PROJCS\["[^"]*(?:WGS|ETRS)[^"]*UTM[ _]*zone[ _]*(\d{1,2})([NS])"'
DEGREES_OF_WGS84 = r'(?i)^GEOGCS\["[^"]*WGS[ _]*(?:19)?84'  # without an authority of its own
# ----------------------------------------------------------------------------------------


def bounds() -> tuple[Column, Column, Column, Column]:
    """``(xmin, ymin, xmax, ymax)`` of a grid row."""
    c = F.col
    return c("xll"), c("yll"), c("xll") + c("cellsize") * c("ncols"), c("yll") + c("cellsize") * c("nrows")


def _in_degrees(west: Column, south: Column, east: Column, north: Column) -> Column:
    return west.between(-180, 180) & east.between(-180, 180) & south.between(-90, 90) & north.between(-90, 90)


def with_crs(grids: DataFrame, map_crs: str | None = None, wkt: str = "crs_wkt") -> DataFrame:
    """Add ``crs`` and ``crs_status``. The user's ``map_crs`` beats the declared one
    (``wkt``, whose strings may be single-quoted), which beats WGS 84. Status ``mismatch``: a
    system in degrees with coordinates that cannot be degrees; ``unknown``: a system this
    library has no projection for (never guessed). A code this library has is taken first, then
    the declared projection and its parameters (``geodesy.told_crs``), then names."""
    grids = computed_once(grids, _wkt=F.replace(F.col(wkt), F.lit("'"), F.lit('"')))
    clean = F.col("_wkt")
    code = F.nullif(F.regexp_extract(clean, EPSG_IN_WKT, 1), F.lit(""))
    geographic = clean.startswith("GEOGCS") & clean.rlike(DEGREES_OF_WGS84)
    coded = F.concat(F.lit("EPSG:"), code)
    zone = F.concat(
        F.when(F.upper(F.regexp_extract(clean, UTM_IN_WKT, 2)) == "S", "EPSG:327").otherwise("EPSG:326"), F.lpad(F.regexp_extract(clean, UTM_IN_WKT, 1), 2, "0")
    )
    declared = F.coalesce(
        F.when(clean.isNull(), WGS84), let(coded, lambda c: F.when(known_crs(c), c)), let(clean, told_crs), coded,
        F.when(geographic, WGS84), F.when(clean.rlike(UTM_IN_WKT), zone),
    )
    grids = computed_once(grids, crs=F.lit(map_crs) if map_crs else declared)
    crs = F.col("crs")
    in_degrees = F.coalesce(crs.isin(*GEOGRAPHIC), F.lit(False))
    if not map_crs:
        in_degrees = in_degrees | F.coalesce(clean.startswith("GEOGCS"), F.lit(False))
    status = (
        F.when(in_degrees & ~_in_degrees(*bounds()), "mismatch")
        .when(~F.coalesce(known_crs(crs), F.lit(False)), "unknown").otherwise("ok")
    )
    return grids.withColumn("crs_status", status).drop("_wkt")


def map_outcomes(grids: DataFrame) -> DataFrame:
    """One row per map with its ``status``, ``fault`` and coordinate system: ``outcome`` (``ok``,
    ``error``, ``unknown``, ``mismatch``) and the ``reason`` why it is not used."""
    xmin, ymin, xmax, ymax = bounds()
    span = lambda a, b: F.concat(F.format_number(a, 0), F.lit(" to "), F.format_number(b, 0))
    outcome = F.when(F.col("status") != "ok", "error").otherwise(F.col("crs_status"))
    reason = (
        F.when(outcome == "error", F.col("fault")).when(outcome == "unknown", F.concat(F.lit("no projection for "), F.coalesce("crs", F.lit("the declared system"))))
        .when(outcome == "mismatch", F.concat(F.lit("not degrees: x "), span(xmin, xmax), F.lit(", y "), span(ymin, ymax)))
    )
    return grids.withColumns({"outcome": outcome, "reason": reason})


def crs_mismatches(grids: DataFrame) -> DataFrame:
    """Grids whose coordinates are impossible in their coordinate system, with the reason."""
    xmin, ymin, xmax, ymax = bounds()
    span = lambda a, b: F.concat(F.format_number(a, 0), F.lit(" to "), F.format_number(b, 0))
    reason = F.concat(
        F.lit("x "), span(xmin, xmax), F.lit(", y "), span(ymin, ymax),
        F.lit(" cannot be degrees, as "), F.coalesce("crs", F.lit("the declared system")), F.lit(" has it"),
    )
    return grids.filter(F.col("crs_status") == "mismatch").withColumn("reason", reason)


def lonlat_extents(grids: DataFrame) -> DataFrame:
    """``west, south, east, north`` in degrees per (geometry, crs), from densified edges; null
    when a point cannot be placed or the result is off the globe."""
    xmin, ymin, xmax, ymax = bounds()
    part = F.col("i") / F.lit(EDGE_POINTS + 1)
    x, y = xmin + (xmax - xmin) * part, ymin + (ymax - ymin) * part
    edges = F.array(
        F.struct(x.alias("x"), ymin.alias("y")), F.struct(x.alias("x"), ymax.alias("y")),
        F.struct(xmin.alias("x"), y.alias("y")), F.struct(xmax.alias("x"), y.alias("y")),
    )
    points = grids.select("geometry", "crs", *GRID_COLUMNS[:5]).distinct().withColumn(
        "i", F.explode(F.sequence(F.lit(0), F.lit(EDGE_POINTS + 1)))
    ).withColumn("p", F.explode(edges))
    placed = computed_once(points.select("geometry", "crs", "p"), at=to_lonlat(F.col("crs"), F.col("p.x"), F.col("p.y")))
    extent = placed.select("geometry", "crs", F.col("at.a").alias("lon"), F.col("at.b").alias("lat")).groupBy("geometry", "crs").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"),
        F.bool_and(F.col("lon").isNotNull() & F.col("lat").isNotNull()).alias("placed"),
    )
    sides = ["west", "south", "east", "north"]
    good = F.col("placed") & _in_degrees(*map(F.col, sides))
    return extent.select("geometry", "crs", *[F.when(good, F.col(s)).alias(s) for s in sides])


def crs_candidates(grids: DataFrame) -> DataFrame:
    """For each grid geometry, where it would lie under every candidate system: extent in
    degrees rounded to 2 decimals, or null. For the user to choose from."""
    options = F.array(*[F.struct(F.lit(code).alias("crs"), F.lit(name).alias("crs_name")) for code, name in CANDIDATE_CRS])
    tried = grids.select("geometry", *GRID_COLUMNS[:5]).distinct().select("*", F.inline(options))
    extents = lonlat_extents(tried)
    names = tried.select("geometry", "crs", "crs_name")
    return names.join(extents, ["geometry", "crs"]).select(
        "geometry", "crs", "crs_name", *[F.round(s, 2).alias(s) for s in ("west", "south", "east", "north")],
    )


def geometries(grids: DataFrame) -> DataFrame:
    """The distinct grids behind the maps: one row per (geometry, crs)."""
    return grids.select("geometry", "crs", *GRID_COLUMNS[:5]).distinct()


def cells_lonlat(cells: DataFrame) -> DataFrame:
    """Cells with ``lon, lat``, projected where they are: ``cells`` need ``x``, ``y`` and ``crs``
    and are not shuffled."""
    placed = computed_once(cells, _at=to_lonlat(F.col("crs"), F.col("x"), F.col("y")))
    return placed.withColumns({"lon": F.col("_at.a"), "lat": F.col("_at.b")}).drop("_at")


def regrid_lookup(grids: DataFrame) -> DataFrame:
    """Which source cell each cell of a regular lon/lat grid takes, once per (geometry, crs) that
    is not in degrees already. The rows of the target are spread over the tasks.

    The target covers the extent in degrees with square cells that keep the number of cells
    along the diagonal. A target cell whose centre lies outside the source grid is left out.
    """
    metric = grids.filter(~F.col("crs").isin(*GEOGRAPHIC))
    g = geometries(metric).join(lonlat_extents(metric), ["geometry", "crs"]).filter(F.col("west").isNotNull())
    width, height = F.col("east") - F.col("west"), F.col("north") - F.col("south")
    res = F.hypot(width, height) / F.hypot(F.col("ncols"), F.col("nrows"))
    g = g.withColumn("res", res).withColumns({
        "out_cols": F.greatest(F.lit(1), F.round(width / F.col("res")).cast("int")),
        "out_rows": F.greatest(F.lit(1), F.round(height / F.col("res")).cast("int")),
    })
    rows = g.withColumn("out_row", F.explode(F.sequence(F.lit(0), F.col("out_rows") - 1))).repartition("geometry", "crs", "out_row")
    target = rows.withColumn(
        "out_col", F.explode(F.sequence(F.lit(0), F.col("out_cols") - 1))
    ).withColumns({
        "lon": F.col("west") + F.col("res") * (F.col("out_col") + 0.5),
        "lat": F.col("north") - F.col("res") * (F.col("out_row") + 0.5),
    })
    top = F.col("yll") + F.col("cellsize") * F.col("nrows")
    placed = computed_once(target, at=from_lonlat(F.col("crs"), F.col("lon"), F.col("lat"))).withColumns({
        "col": F.floor((F.col("at.a") - F.col("xll")) / F.col("cellsize")).cast("int"),
        "row": F.floor((top - F.col("at.b")) / F.col("cellsize")).cast("int"),
    })
    inside = F.col("col").between(0, F.col("ncols") - 1) & F.col("row").between(0, F.col("nrows") - 1)
    return placed.filter(inside).select("geometry", "crs", "row", "col", "out_row", "out_col", "lon", "lat")


def lookup_rows(lookup: DataFrame) -> DataFrame:
    """:func:`regrid_lookup` with all target cells that take from one source row as one array."""
    target = F.struct("col", "out_row", "out_col", "lon", "lat")
    return lookup.groupBy("geometry", "crs", "row").agg(F.collect_list(target).alias("targets"))


def regrid_rows(rows: DataFrame, lookup: DataFrame, *keep: str) -> DataFrame:
    """Maps on the regular lon/lat grid: every value is copied from the source cell under the
    target's centre, none is interpolated. Maps in degrees are on one and stay as they are.

    ``rows`` are rows of cells (``values`` from column ``col`` on) with ``crs``, ``lookup`` is
    :func:`lookup_rows`: one row of a map meets one row of its grid, and cells are made only then.
    """
    c = F.col
    degrees = c("crs").isin(*GEOGRAPHIC)
    met = rows.filter(~degrees).join(lookup, ["geometry", "crs", "row"])
    inside = lambda t: (t["col"] >= c("col")) & (t["col"] < c("col") + F.size("values"))
    taken = F.transform(F.filter("targets", inside), lambda t: F.struct(
        t["out_row"].alias("out_row"), t["out_col"].alias("out_col"), t["lon"].alias("lon"), t["lat"].alias("lat"),
        F.get("values", t["col"] - c("col")).alias("value"),
    ))
    copied = met.select(*keep, F.inline(taken))
    same = row_cells(rows.filter(degrees), *keep).select(
        *keep, c("row").alias("out_row"), c("col").alias("out_col"), c("x").alias("lon"), c("y").alias("lat"), "value"
    )
    return copied.unionByName(same)


def regrid_nearest(cells: DataFrame, lookup: DataFrame) -> DataFrame:
    """Maps on the regular lon/lat grid: every value is copied from the source cell under the
    target's centre, none is interpolated. Maps in degrees are on one and stay as they are.
    ``lookup`` is :func:`regrid_lookup`."""
    degrees = F.col("crs").isin(*GEOGRAPHIC)
    copied = cells.filter(~degrees).drop("x", "y").join(lookup, ["geometry", "crs", "row", "col"]).drop("row", "col")
    same = cells.filter(degrees).withColumnsRenamed({"row": "out_row", "col": "out_col", "x": "lon", "y": "lat"})
    return copied.unionByName(same)
