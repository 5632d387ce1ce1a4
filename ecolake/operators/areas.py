"""Areas of interest: polygons in lon/lat against the cells of maps.

Areas are a table. Their polygons become a table of edges, which meet the grids they may touch in
an equi-join on tiles of ten degrees, are projected once per coordinate system, and are cut by the
rows of a grid: each crossing of a row's centre line switches the cells from some column on between
outside and inside. Switches are counted per (row, column) and runs are read off in column order,
so no group is larger than a row of a grid, however many vertices an area has.

Maps meet the result once per row of cells (geometry, crs, row), which no single map or area can
make hot, and keep the row's values as arrays until the very end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecolake.functions.geodesy import from_lonlat
from ecolake.operators.crs import geometries, lonlat_extents
from ecolake.session import computed_once, written
from ecolake.sources.grids import GRID_COLUMNS, center_x, center_y

# --- fixed values -----------------------------------------------------------------------
TILE_DEGREES = 10
# ----------------------------------------------------------------------------------------
_GEOMETRY = "struct<type: string, coordinates: string>"
_FEATURES = f"struct<type: string, geometry: {_GEOMETRY}, features: array<struct<geometry: {_GEOMETRY}>>>"
_POLYGON = "array<array<array<double>>>"


def polygons(geojson: Column) -> Column:
    """Polygons (arrays of rings of ``[lon, lat]``) of a GeoJSON text: those of its Polygon and
    MultiPolygon features; a single Feature counts as a collection of one."""
    doc = F.from_json(geojson, _FEATURES)
    features = F.transform(F.coalesce(doc["features"], F.array().cast(f"array<struct<geometry: {_GEOMETRY}>>")), lambda f: f["geometry"])
    shapes = F.when(doc["type"] == "Feature", F.array(doc["geometry"])).otherwise(features)

    def parts(shape: Column) -> Column:
        single = F.array(F.from_json(shape["coordinates"], _POLYGON))
        several = F.from_json(shape["coordinates"], f"array<{_POLYGON}>")
        return F.when(shape["type"] == "Polygon", single).when(shape["type"] == "MultiPolygon", several)

    usable = F.filter(shapes, lambda s: s["type"].isin("Polygon", "MultiPolygon"))
    return F.flatten(F.transform(usable, parts))


def parse_areas(areas: DataFrame) -> DataFrame:
    """Areas (``area``, ``geojson``) with their number of polygons, rings and vertices, and
    their extent in degrees."""
    points = F.flatten(F.flatten("polygons"))
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return computed_once(areas, polygons=polygons(F.col("geojson"))).select(
        "area", "polygons", F.size("polygons").alias("n_polygons"),
        F.size(F.flatten("polygons")).alias("n_rings"), F.size(points).alias("n_points"),
        F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
        F.array_max(xs).alias("east"), F.array_max(ys).alias("north"),
    )


def area_table(spark: SparkSession, areas: list[tuple[str, str]]) -> DataFrame:
    """(name, GeoJSON) pairs of a request as a table (``area``, ``geojson``)."""
    return spark.createDataFrame(areas, "area string, geojson string")


def area_edges(areas: DataFrame) -> DataFrame:
    """Every edge of the areas (``area``, ``geojson``): ``polygon`` it belongs to and its ends in
    degrees. Rings that are open are closed."""
    rings = computed_once(areas.select("area", "geojson"), polygons=polygons(F.col("geojson"))).select("area", F.posexplode("polygons").alias("polygon", "rings"))
    rings = rings.select("area", "polygon", F.explode("rings").alias("ring"))
    ends = F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1))
    edges = computed_once(rings.withColumn("ends", ends), e=F.arrays_zip("ring", "ends")).select("area", "polygon", F.explode("e").alias("e"))
    at = lambda end, k: F.get(F.col(f"e.{end}"), F.lit(k))
    return edges.select("area", "polygon", at("ring", 0).alias("lon1"), at("ring", 1).alias("lat1"), at("ends", 0).alias("lon2"), at("ends", 1).alias("lat2"))


def _tiles(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Tiles that a box touches; a box with a null side touches all of them."""
    most = 360 // TILE_DEGREES - 1
    tile = lambda v, half, missing, last: F.least(F.greatest(F.floor((F.coalesce(v, F.lit(missing)) + half) / TILE_DEGREES), F.lit(0)), F.lit(last)).cast("int")
    xs = F.sequence(tile(west, 180, -180, most), tile(east, 180, 180, most))
    ys = F.sequence(tile(south, 90, -90, most // 2), tile(north, 90, 90, most // 2))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: x * 100 + y)))


def area_windows(grids: DataFrame, areas: DataFrame | list[tuple[str, str]]) -> DataFrame:
    """Per (geometry, crs, area) the window of rows and columns the area's bounding box touches
    (``row0, row1, col0, col1``, half-open), repeated on each edge of its polygons, in the grid's
    coordinates. Areas that touch no cell have no row. A written table.

    Straight edges in degrees may bend beyond their box in other coordinates, so areas meet grids
    in tiles of their box widened by its own size; the windows are exact.
    """
    if isinstance(areas, list):
        areas = area_table(grids.sparkSession, areas)
    edges = written(area_edges(areas), "area-edges")
    box = edges.groupBy("area").agg(
        F.least(F.min("lon1"), F.min("lon2")).alias("w"), F.least(F.min("lat1"), F.min("lat2")).alias("s"),
        F.greatest(F.max("lon1"), F.max("lon2")).alias("e"), F.greatest(F.max("lat1"), F.max("lat2")).alias("n"),
    )
    wide, high = F.greatest(F.lit(1.0), F.col("e") - F.col("w")), F.greatest(F.lit(1.0), F.col("n") - F.col("s"))
    tiled = box.select("area", F.explode(_tiles(F.col("w") - wide, F.col("s") - high, F.col("e") + wide, F.col("n") + high)).alias("tile"))
    grid = written(geometries(grids), "geometries")
    placed = lonlat_extents(grid).select("geometry", "crs", F.explode(_tiles(*map(F.col, ("west", "south", "east", "north")))).alias("tile"))
    pairs = written(placed.join(tiled, "tile").select("geometry", "crs", "area").distinct(), "area-pairs")

    known = pairs.select("crs", "area").distinct().join(edges, "area")
    ends = computed_once(known, p=from_lonlat(F.col("crs"), F.col("lon1"), F.col("lat1")), q=from_lonlat(F.col("crs"), F.col("lon2"), F.col("lat2")))
    lines = written(ends.select("crs", "area", "polygon", F.col("p.a").alias("x1"), F.col("p.b").alias("y1"), F.col("q.a").alias("x2"), F.col("q.b").alias("y2")), "edges")
    reach = lines.groupBy("crs", "area").agg(
        F.min("x1").alias("west"), F.max("x1").alias("east"), F.min("y1").alias("south"), F.max("y1").alias("north")
    )
    c, cs = F.col, F.col("cellsize")
    top = c("yll") + cs * c("nrows")
    windows = pairs.join(reach, ["crs", "area"]).join(grid, ["geometry", "crs"]).withColumns({
        "col0": F.greatest(F.lit(0), F.floor((c("west") - c("xll")) / cs)).cast("int"),
        "col1": F.least(c("ncols"), F.ceil((c("east") - c("xll")) / cs)).cast("int"),
        "row0": F.greatest(F.lit(0), F.floor((top - c("north")) / cs)).cast("int"),
        "row1": F.least(c("nrows"), F.ceil((top - c("south")) / cs)).cast("int"),
    }).filter((c("row0") < c("row1")) & (c("col0") < c("col1")))
    windows = windows.select(*_KEY, *GRID_COLUMNS[:5])
    return written(windows.join(lines, ["crs", "area"]), "area-windows")


_KEY = ["geometry", "crs", "area", "row0", "col0", "row1", "col1"]


def _switches(windows: DataFrame) -> DataFrame:
    """(window, polygon, row, col): from column ``col`` of a row on, cells change between outside and
    inside. An edge is given only the rows that it crosses; it counts at its lower end, not at its
    upper one. A cell belongs to what is left of its centre, so areas are half-open."""
    c = F.col
    row_at = lambda y: c("nrows") - 0.5 - (y - c("yll")) / c("cellsize")
    first = F.greatest(c("row0"), F.floor(row_at(F.greatest("y1", "y2"))).cast("int"))
    last = F.least(c("row1") - 1, F.ceil(row_at(F.least("y1", "y2"))).cast("int"))
    crossed = windows.withColumns({"first": first, "last": last}).filter(c("first") <= c("last")).withColumn(
        "row", F.explode(F.sequence(c("first"), c("last")))
    )
    y = center_y(c("row"))
    crossed = crossed.filter((c("y1") > y) != (c("y2") > y)).withColumn("x", c("x1") + F.try_divide((y - c("y1")) * (c("x2") - c("x1")), c("y2") - c("y1")))
    near = F.ceil((c("x") - c("xll")) / c("cellsize") - 0.5).cast("int")
    exact = F.when(center_x(c("near") - 1) >= c("x"), c("near") - 1).when(center_x(c("near")) < c("x"), c("near") + 1).otherwise(c("near"))
    at = crossed.withColumn("near", near).withColumn("col", F.greatest(exact, c("col0"))).filter(c("col") < c("col1"))
    counted = at.groupBy(*_KEY, "polygon", "row", "col").agg(F.count("*").alias("k"))
    return counted.filter(c("k") % 2 == 1).drop("k")


def area_spans(windows: DataFrame) -> DataFrame:
    """(window, row, from, to): runs of columns inside any of an area's polygons, holes respected.
    Runs of one row do not overlap."""
    c = F.col
    line = Window.partitionBy(*_KEY, "polygon", "row").orderBy("col")
    runs = _switches(windows).withColumns({"n": F.row_number().over(line), "to": F.lead("col", 1).over(line)}).filter(c("n") % 2 == 1)
    steps = runs.select(*_KEY, "row", F.inline(F.array(
        F.struct(c("col"), F.lit(1).alias("step")), F.struct(F.coalesce("to", "col1").alias("col"), F.lit(-1).alias("step")),
    )))
    steps = steps.groupBy(*_KEY, "row", "col").agg(F.sum("step").alias("step"))
    row = Window.partitionBy(*_KEY, "row").orderBy("col")
    covered = steps.withColumns({"deep": F.sum("step").over(row), "to": F.lead("col").over(row)})
    return covered.filter(c("deep") > 0).select(*_KEY, "row", c("col").alias("from"), "to")


def area_rows(windows: DataFrame) -> DataFrame:
    """Every row of every window: ``inside``, a flag per column from ``col0`` on, and the window
    (``row0, col0, rows, cols``). As many rows as one map per area has, whatever the number of maps."""
    c = F.col
    lines = windows.select(*_KEY).distinct().withColumn("row", F.explode(F.sequence(c("row0"), c("row1") - 1)))
    spans = area_spans(windows).groupBy(*_KEY, "row").agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("spans"))
    out = lines.join(spans, [*_KEY, "row"], "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<from: int, to: int>>")))
    # a gap and a run for each span, and the gap behind the last
    flags = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.concat(
        F.array_repeat(F.lit(False), F.coalesce(F.get("spans", i)["from"], c("col1")) - F.coalesce(F.get("spans", i - 1)["to"], c("col0"))),
        F.array_repeat(F.lit(True), F.coalesce(F.get("spans", i)["to"] - F.get("spans", i)["from"], F.lit(0))),
    ))
    return out.select(
        "geometry", "crs", "area", "row", F.flatten(flags).alias("inside"), "row0", "col0",
        (c("row1") - c("row0")).alias("rows"), (c("col1") - c("col0")).alias("cols"),
    )


def area_cells(windows: DataFrame) -> DataFrame:
    """Every cell of every window with ``inside`` (its centre lies in one of the polygons,
    holes respected) and the window (``row0, col0, rows, cols``)."""
    out = area_rows(windows).select("geometry", "crs", "area", "row", "row0", "col0", "rows", "cols", F.posexplode("inside").alias("at", "inside"))
    return out.select("geometry", "crs", "area", "row", (F.col("col0") + F.col("at")).cast("int").alias("col"), "inside", "row0", "col0", "rows", "cols")


_ROW_KEY = ["geometry", "crs", "row"]
_CELL_KEY = [*_ROW_KEY, "col"]


def mask_rows(rows: DataFrame, area: DataFrame) -> DataFrame:
    """Rows of cells (``values`` from column ``col`` on, with ``geometry`` and ``crs``) cut to each
    area's window: ``values`` and ``inside``, from column ``col`` on. Each area is kept apart. One
    row of cells meets one row of an area (:func:`area_rows`); no cell travels alone."""
    c = F.col
    met = rows.join(area, _ROW_KEY)
    first = F.greatest(c("col"), c("col0"))
    last = F.least(c("col") + F.size("values"), c("col0") + c("cols"))
    cut = met.withColumns({"_first": first, "_n": last - first}).filter(c("_n") > 0)
    return cut.withColumns({
        "values": F.slice("values", c("_first") - c("col") + 1, c("_n")), "inside": F.slice("inside", c("_first") - c("col0") + 1, c("_n")),
    }).withColumn("col", c("_first")).drop("_first", "_n")


def masked_cells(masked: DataFrame, *keep: str) -> DataFrame:
    """Cells of :func:`mask_rows`: ``keep``, ``area``, ``row``, ``col``, ``inside`` and ``value``, null
    outside the area."""
    cells = masked.select(*keep, "area", "row", F.col("col").alias("_first"), F.posexplode(F.arrays_zip("values", "inside")).alias("_at", "_c"))
    return cells.select(
        *keep, "area", "row", (F.col("_first") + F.col("_at")).alias("col"), F.col("_c.inside").alias("inside"),
        F.when(F.col("_c.inside"), F.col("_c.values")).alias("value"),
    )


def union_rows(rows: DataFrame, area: DataFrame) -> DataFrame:
    """Rows of cells with ``inside``, a flag per value: in any of the areas. Areas of one row are put
    together before a map's row meets them."""
    c = F.col
    spans = area.select(*_ROW_KEY, "col0", F.struct("col0", "inside").alias("part"))
    parts = spans.groupBy(*_ROW_KEY).agg(F.collect_list("part").alias("parts"))
    met = rows.join(parts, _ROW_KEY)
    within = lambda at: F.exists("parts", lambda p: F.coalesce(F.get(p["inside"], F.when(at >= p["col0"], at - p["col0"])), F.lit(False)))
    flags = F.transform(F.sequence(F.lit(0), F.size("values") - 1), lambda i: within(c("col") + i))
    return met.withColumn("inside", flags).drop("parts")


def mask(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Single cells of each area's window, values outside the area null. Each area is kept apart.
    ``cells`` need ``geometry`` and ``crs``; ``area`` is :func:`area_cells`. Whole maps are better
    masked by rows (:func:`mask_rows`)."""
    return cells.join(area, _CELL_KEY).withColumn("value", F.when(F.col("inside"), F.col("value")))


def crop(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Like :func:`mask`, with ``row`` and ``col`` counted from the window's corner."""
    return mask(cells, area).withColumns({
        "row": F.col("row") - F.col("row0"), "col": F.col("col") - F.col("col0"),
    })


def union(cells: DataFrame, area: DataFrame) -> DataFrame:
    """Cells inside any of the areas, each once."""
    covered = area.filter("inside").select(*_CELL_KEY).distinct()
    return cells.join(covered, _CELL_KEY, "left_semi")


def skipped(maps: DataFrame, masked: DataFrame, areas: DataFrame | list[str]) -> DataFrame:
    """(map, area) pairs without a single value inside, so nothing to export. ``masked`` are rows of
    :func:`mask_rows` with ``raster_id``; ``areas`` the names that were asked for."""
    if isinstance(areas, list):
        areas = maps.sparkSession.createDataFrame([(a,) for a in areas], "area string")
    names = areas.select("area").distinct().agg(F.collect_list("area").alias("names")).scalar()
    pairs = maps.select("raster_id", F.explode(names).alias("area"))
    hit = F.exists(F.arrays_zip("values", "inside"), lambda z: z["inside"] & z["values"].isNotNull())
    filled = masked.filter(hit).select("raster_id", "area").distinct()
    return pairs.join(filled, ["raster_id", "area"], "left_anti")
