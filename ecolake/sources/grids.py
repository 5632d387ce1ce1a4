"""ESRI ASCII map grids: contents, file names, and the run description beside them.

Grids given as texts are parsed in their own row. Grids in files go through :func:`measured_grids`
and :func:`grid_rows`: files are cut into byte ranges, dealt to tasks by bytes, and the numbers in
each range are counted; running sums per file then tell which cells a range holds, and a second
reading gives the cells, a grid row (or the part of it in a range) at a time. No grid needs to
fit a task.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecolake.functions.measures import to_number
from ecolake.functions.naming import slugify, strip
from ecolake.functions.periods import DEFAULT_START_YEAR, step_year
from ecolake.session import computed_once, dealt_by_weight, small_table, spread, written
from ecolake.sources.files import READ_BYTES, SPLIT_BYTES, open_path, with_heads
from ecolake.sources.model_csv import MODEL_FIELD, SCENARIO_FIELD, START_YEAR_FIELD, header_fields

# --- fixed values: map exports ----------------------------------------------------------
OUTPUT_NAME = r"(?i)^([A-Za-z]+)-(.+)-(\d+)\.asc$"
OUTPUT_PREFIXES = [
    # file prefix, variable, kind of entity
    ("ecospacemapbiomass", "biomass", "group"),
    ("ecospacemapcatch", "catch", "group"),
    ("ecospacemapdiscards", "discards", "group"),
    ("ecospacemapeffort", "effort", "fleet"),
    ("layerhabitatcapacity", "habitat_capacity", "group"),
]
INPUT_YEAR = r"((?:19|20)\d{2})"
RUN_INFO = "Ecospace RunInfo.txt"
CRS_FIELD = "CoordinateSystemWKT"
DEFAULT_NODATA = -9999.0
MISSING = "nan"
HEADER_LINES = r"(?i)^(?:\s*(?:ncols|nrows|xllcorner|yllcorner|xllcenter|yllcenter|cellsize|nodata_value)\s+\S+)+"
# ----------------------------------------------------------------------------------------

ROW_PART = 1 << 16  # cells of one array at most
LONGEST_TOKEN = 1 << 22
TASK_BYTES = 16 << 20
_SPACES = [b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"]
_SPACE = re.compile(rb"[ \t\n\r\x0b\x0c]")
_PLAIN = re.compile(rb"[0-9eE+\-. \t\n\r\x0b\x0c]*")
_NUMBER = re.compile(rb"(?i)[-+]?(?:\d+\.?\d*(?:e[-+]?\d+)?|\.\d+(?:e[-+]?\d+)?|inf|infinity)")

GRID_COLUMNS = ["ncols", "nrows", "xll", "yll", "cellsize", "nodata"]


def grid_headers(files: DataFrame) -> DataFrame:
    """Header columns of grid texts (``ncols, nrows, xll, yll, cellsize, nodata``) and
    ``geometry``, a key shared by all maps on the same grid. ``text`` may be just the head."""
    head = F.regexp_extract(F.col("text"), HEADER_LINES, 0)

    def field(name: str) -> Column:
        return to_number(F.regexp_extract(F.col("_head"), rf"(?i)(?:^|\s){name}\s+(\S+)", 1))

    cs = field("cellsize")
    out = computed_once(
        computed_once(files, _head=head), ncols=field("ncols").cast("int"), nrows=field("nrows").cast("int"),
        xll=F.coalesce(field("xllcorner"), field("xllcenter") - cs / 2),
        yll=F.coalesce(field("yllcorner"), field("yllcenter") - cs / 2),
        cellsize=cs, nodata=F.coalesce(field("nodata_value"), F.lit(DEFAULT_NODATA)), _skip=F.length("_head"),
    ).drop("_head")
    return out.withColumn("geometry", F.concat_ws("|", *[F.col(c).cast("string") for c in GRID_COLUMNS[:5]]))


def read_grids(files: DataFrame) -> DataFrame:
    """:func:`grid_headers` with ``cells`` (array of numbers, rows north to south; ``nan`` is a
    missing one), ``status`` and, where that is ``error``, the ``fault``. One row per file, no
    shuffle. For texts at hand; files go through :func:`measured_grids`."""
    body = F.substring(F.col("text"), F.col("_skip") + 1, F.length("text"))
    out = computed_once(grid_headers(files), _tokens=F.split(strip(body), r"\s+"))
    odd = F.get(F.filter("_tokens", lambda t: to_number(t).isNull() & (F.lower(t) != MISSING) & (t != "")), F.lit(0))
    out = computed_once(out, cells=F.transform("_tokens", to_number), _odd=odd)
    numbers = F.when(F.get("_tokens", F.lit(0)) == "", 0).otherwise(F.size("cells"))
    fault = grid_fault(numbers, F.col("_odd"))
    return computed_once(out, fault=fault).withColumn("status", F.when(F.col("fault").isNull(), "ok").otherwise("error")).drop("_skip", "_tokens", "_odd")


def grid_fault(numbers: Column, odd: Column) -> Column:
    """What makes a grid unusable, null if nothing does: a part of its header is not there, a token
    is no number, or there are not as many numbers as cells."""
    of = [F.coalesce(F.col(c).cast("string"), F.lit("?")) for c in ("ncols", "nrows")]
    placed = F.col("xll").isNotNull() & F.col("yll").isNotNull() & (F.col("cellsize") > 0)
    whole = (numbers == F.col("ncols").cast("long") * F.col("nrows")) & (F.col("ncols") > 0) & (F.col("nrows") > 0)
    return (
        F.when(odd.isNotNull(), F.concat(F.lit("'"), odd, F.lit("' is not a number")))
        .when(~F.coalesce(whole, F.lit(False)), F.concat(numbers.cast("string"), F.lit(" numbers for a grid of "), of[0], F.lit(" by "), of[1]))
        .when(~F.coalesce(placed, F.lit(False)), "no corner or cell size")
    )


@dataclass(frozen=True)
class MeasuredGrids:
    """``maps``: a row per file with header columns, ``geometry``, ``status`` and ``fault``;
    ``ranges``: the byte ranges of the good ones and the number of their first cell."""

    maps: DataFrame
    ranges: DataFrame
    split_bytes: int


_RANGE = ["path", "_map", "_start", "_end", "bytes", "_skip"]


def measured_grids(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> MeasuredGrids:
    """Headers and outcomes of grid files (``path`` and columns of the caller's), whatever their
    size and however few partitions ``files`` has. Files that cannot be read, that hold a token
    that is no number, or not as many numbers as cells, have status ``error`` and a ``fault``."""
    heads = grid_headers(with_heads(spread(files), "grid"))
    # a byte order mark is in the file, not in the text
    in_bytes = lambda text: F.octet_length(F.encode(text, "utf-8"))
    skip = in_bytes(F.substring("text", F.lit(1), F.col("_skip"))) + F.col("head_bytes") - in_bytes(F.col("text"))
    heads = heads.withColumn("_skip", skip).drop("text")
    heads = written(heads.withColumn("_map", F.monotonically_increasing_id()), "grid-heads")
    begin = F.coalesce("_skip", F.lit(0)).cast("long")
    cut = heads.filter(F.col("read_error").isNull() & (F.col("bytes") > 0)).withColumn("_skip", begin).withColumn(
        "_start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    )
    cut = cut.withColumn("_end", F.least(F.col("_start") + split_bytes, F.col("bytes"))).filter(F.col("_end") > F.col("_skip"))
    ranges = written(cut.select(*_RANGE, (F.col("_end") - F.col("_start")).alias("_bytes")), "grid-ranges")
    dealt = dealt_by_weight(ranges, "_bytes", max(split_bytes, TASK_BYTES))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_counted(*r) for r in zip(*(batch.column(batch.schema.names.index(c)).to_pylist() for c in ("path", "_start", "_end", "bytes", "_skip")))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.names.index("_map")), batch.column(batch.schema.names.index("_start")), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()), pa.array([f[2] for f in found], pa.string())],
                names=["_map", "_start", "numbers", "odd", "lost"],
            )

    counted = written(dealt.mapInArrow(count, "_map long, _start long, numbers long, odd string, lost string"), "grid-counts")
    sums = counted.groupBy("_map").agg(F.sum("numbers").alias("numbers"), F.min("odd").alias("odd"), F.min("lost").alias("lost"))
    maps = heads.join(sums, "_map", "left")
    fault = F.coalesce("read_error", "lost", grid_fault(F.coalesce("numbers", F.lit(0)), F.col("odd")))
    maps = maps.withColumn("fault", fault).withColumn("status", F.when(F.col("fault").isNull(), "ok").otherwise("error"))
    maps = written(maps.drop("_skip", "numbers", "odd", "lost", "read_error", "head_bytes"), "grids")
    before = F.sum("numbers").over(Window.partitionBy("_map").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1))
    first = counted.select("_map", "_start", F.coalesce(before, F.lit(0)).alias("_first"))
    good = maps.filter("status = 'ok'").select("_map")
    return MeasuredGrids(maps, written(ranges.join(first, ["_map", "_start"]).join(good, "_map", "left_semi"), "grid-ranges"), split_bytes)


def grid_rows(grids: MeasuredGrids, *keep: str) -> DataFrame:
    """The cells of the good grids as arrays: ``row``, ``col`` of the first value and ``values``
    (null for NODATA), with ``geometry``, the header columns and the ``keep`` columns of the map.
    A grid row is in one array, or in several where a range or ``ROW_PART`` cells end inside."""
    dealt = dealt_by_weight(grids.ranges.join(grids.maps.select("_map", "ncols", "nodata"), "_map"), "_bytes", max(grids.split_bytes, TASK_BYTES))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = [batch.column(batch.schema.names.index(c)).to_pylist() for c in ("_map", "_first", "ncols", "nodata", "path", "_start", "_end", "bytes", "_skip")]
            held, count = [], 0
            for map_, first, ncols, nodata, *where in zip(*cells):
                for values, _ in _range_numbers(*where):
                    held.append(_row_parts(map_, first, ncols, nodata, values))
                    first, count = first + len(values), count + len(values)
                    if count >= ROW_PART:
                        yield _row_batch(held)
                        held, count = [], 0
            if held:
                yield _row_batch(held)

    parts = dealt.mapInArrow(read, "_map long, row int, col int, values array<double>")
    return parts.join(grids.maps.select("_map", "geometry", *GRID_COLUMNS, *keep), "_map").drop("_map")


def array_rows(grids: DataFrame, *keep: str) -> DataFrame:
    """:func:`grid_rows` of grids parsed from texts (:func:`read_grids`)."""
    good = grids.filter(F.col("status") == "ok").withColumn("row", F.explode(F.sequence(F.lit(0), F.col("nrows") - 1)))
    values = F.slice("cells", F.col("row") * F.col("ncols") + 1, F.col("ncols"))
    known = F.transform(values, lambda v: F.when(v != F.col("nodata"), v))
    return good.select("row", F.lit(0).alias("col"), known.alias("values"), "geometry", *GRID_COLUMNS, *keep)


def row_cells(rows: DataFrame, *keep: str) -> DataFrame:
    """:func:`grid_cells` of arrays of cells."""
    cells = rows.select(*keep, "geometry", *GRID_COLUMNS, "row", F.col("col").alias("_first"), F.posexplode("values").alias("_at", "value"))
    cells = cells.withColumn("col", F.col("_first") + F.col("_at"))
    return cells.select(*keep, "geometry", "row", "col", center_x(F.col("col")).alias("x"), center_y(F.col("row")).alias("y"), "value")


def _row_parts(map_: int, first: int, ncols: int, nodata: float, values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Consecutive cells from number ``first`` on, cut where a grid row or ``ROW_PART`` ends: map, row,
    first column and number of cells of each part, the values, and which of them are missing."""
    ends = np.union1d(np.arange(ncols - first % ncols, len(values), ncols), np.arange(ROW_PART, len(values), ROW_PART))
    bounds = np.r_[0, ends, len(values)].astype(np.int64)
    at = first + bounds[:-1]
    return np.full(len(at), map_), (at // ncols).astype(np.int32), (at % ncols).astype(np.int32), np.diff(bounds), values, np.isnan(values) | (values == nodata)


def _row_batch(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """The parts of several ranges as one batch: a range may hold a few cells only."""
    map_, row, col, size, values, missing = (np.concatenate(p) for p in zip(*parts))
    lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), pa.array(values, mask=missing))
    return pa.RecordBatch.from_arrays([pa.array(map_), pa.array(row), pa.array(col), lists], names=["_map", "row", "col", "values"])


def _counted(path: str, start: int, end: int, size: int, skip: int) -> tuple[int, str | None, str | None]:
    """How many numbers begin in a range, a token among them that is none, and a fault in reading."""
    n, odd = 0, None
    try:
        for values, bad in _range_numbers(path, start, end, size, skip):
            n, odd = n + len(values), odd or bad
    except OSError as fault:
        return n, odd, str(fault)
    return n, odd, None


def _range_numbers(path: str, start: int, end: int, size: int, skip: int) -> Iterator[tuple[np.ndarray, str | None]]:
    """(numbers, a token that is none or null) of the tokens that begin in [start, end) and behind
    the first ``skip`` bytes, some at a time; NaN for ``nan`` and for what is no number."""
    filesystem, inner = open_path(path)
    with filesystem.open_input_file(inner) as stream:
        for block in _token_blocks(stream, max(start, skip), end, size, start > skip):
            tokens = block.split()
            if not tokens:
                continue
            try:
                if _PLAIN.fullmatch(block):
                    yield np.array(tokens).astype(np.float64), None
                    continue
            except ValueError:
                pass
            fits = [_NUMBER.fullmatch(t) is not None for t in tokens]
            odd = next((t for t, f in zip(tokens, fits) if not f and t.lower() != MISSING.encode()), None)
            values = np.array([float(t) if f else np.nan for t, f in zip(tokens, fits)])
            yield values, odd and odd[:40].decode("utf-8", "replace")


def _token_blocks(stream, start: int, end: int, size: int, inside: bool) -> Iterator[bytes]:
    """Bytes whose tokens are those that begin in [start, end). ``inside``: one may run over start."""
    at = start - 1 if inside else start
    stream.seek(at)
    held, skip = bytearray(), inside
    while at < end:
        held += stream.read(READ_BYTES)
        done = at + len(held) >= size
        stop = len(held) if done else _last_space(held) + 1
        if not stop and len(held) <= LONGEST_TOKEN:
            continue
        stop = stop or len(held)
        if at + stop > end:  # up to the end of the token that holds the range's last byte
            tail = _SPACE.search(held, end - at - 1, stop)
            stop = tail.start() if tail else stop
        block = bytes(held[:stop])
        if skip:
            gap = _SPACE.search(block)
            block, skip = (block[gap.start():], False) if gap else (b"", True)
        yield block
        at += stop
        del held[:stop]
        if done:
            return


def _last_space(held: bytearray) -> int:
    return max(held.rfind(c) for c in _SPACES)


def center_x(col: Column) -> Column:
    return F.col("xll") + F.col("cellsize") * (col + 0.5)


def center_y(row: Column) -> Column:
    return F.col("yll") + F.col("cellsize") * (F.col("nrows") - row - 0.5)


def grid_cells(grids: DataFrame, *keep: str) -> DataFrame:
    """Long form of parsed grids: ``row`` and ``col`` (from the north-west corner), the cell
    centre ``x, y`` in the grid's own coordinates, and ``value`` (null for NODATA)."""
    exploded = grids.filter(F.col("status") == "ok").select(
        *keep, "geometry", *GRID_COLUMNS, F.posexplode("cells").alias("pos", "v"),
    ).withColumns({
        "row": F.floor(F.col("pos") / F.col("ncols")).cast("int"),
        "col": F.pmod("pos", "ncols").cast("int"),
    })
    return exploded.select(
        *keep, "geometry", "row", "col", center_x(F.col("col")).alias("x"), center_y(F.col("row")).alias("y"),
        F.when(F.col("v") != F.col("nodata"), F.col("v")).alias("value"),
    )


def grid_meta(grids: DataFrame, *keep: str) -> DataFrame:
    """Width, height, cell size and bounds of each grid."""
    c = F.col
    return grids.select(
        *keep, c("ncols").alias("width"), c("nrows").alias("height"), "cellsize",
        c("xll").alias("xmin"), c("yll").alias("ymin"),
        (c("xll") + c("cellsize") * c("ncols")).alias("xmax"),
        (c("yll") + c("cellsize") * c("nrows")).alias("ymax"),
    )


def output_names(files: DataFrame) -> DataFrame:
    """Split output map names into ``variable``, ``entity_type``, ``entity_name`` and
    ``step``; all null for a name that is not a known map."""
    prefix = F.lower(F.regexp_extract("name", OUTPUT_NAME, 1))
    step = F.regexp_extract("name", OUTPUT_NAME, 3)
    known = small_table(files.sparkSession, ["_prefix", "variable", "entity_type"], OUTPUT_PREFIXES)
    named = files.withColumn("_prefix", prefix).join(known, "_prefix", "left").drop("_prefix")
    found = F.col("variable").isNotNull()
    return named.withColumns({
        "entity_name": F.when(found, strip(F.regexp_extract("name", OUTPUT_NAME, 2))),
        "step": F.when(found, step.try_cast("long")),
    })


def input_names(files: DataFrame) -> DataFrame:
    """``variable`` (slug of the folder), ``scenario`` (slug of the folder above) and
    ``year`` (first year-like number in the name; null if there is none) of driver maps."""
    return files.withColumns({
        "variable": slugify(F.col("parent")),
        "scenario": slugify(F.col("grandparent")),
        "year": F.nullif(F.regexp_extract("name", INPUT_YEAR, 1), F.lit("")).try_cast("int"),
    })


def read_run_info(files: DataFrame) -> DataFrame:
    """What each run description says, one row per directory."""
    h = F.col("_h")
    field = lambda name: F.nullif(F.try_element_at(h, F.lit(name)), F.lit(""))
    return computed_once(files.filter(F.col("name") == RUN_INFO), _h=header_fields(F.col("text"))).select(
        "dir", field(MODEL_FIELD).alias("model_name"), field(SCENARIO_FIELD).alias("scenario_label"),
        field(START_YEAR_FIELD).try_cast("int").alias("start_year"), field(CRS_FIELD).alias("crs_wkt"),
    )


def with_run_info(maps: DataFrame, run_info: DataFrame) -> DataFrame:
    """Give each map the description found in its own folder. Without one the scenario is the
    name of the folder above (the folder's own name at the top) and the first year the default."""
    out = maps.join(run_info, "dir", "left")
    folder = F.coalesce(F.nullif(F.col("grandparent"), F.lit("")), F.col("parent"))
    return out.withColumns({
        "scenario": slugify(F.coalesce("scenario_label", folder)),
        "model": slugify(F.col("model_name")),
        "start_year": F.coalesce("start_year", F.lit(DEFAULT_START_YEAR)),
    }).drop("scenario_label").withColumn(
        "year", step_year(F.col("start_year"), F.col("step")).cast("int")
    )
