"""Time-series CSV exports: header block, data section, and the four table layouts.

A file is parsed inside its own row: the header and the marker lines are found with
regular expressions on the whole text, and only the data lines are exploded. One scan, no
shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.functions.csvline import (
    broken_quotes, first_cell, has_content, split_csv, split_lines,
)
from ecolake.functions.measures import to_number
from ecolake.functions.naming import file_variable, slugify, strip
from ecolake.functions.periods import DEFAULT_START_YEAR, frequency, iso_date, year_month
from ecolake.schema import TIDY, TIDY_COLUMNS
from ecolake.session import computed_once, let, written
from ecolake.sources.files import SPLIT_BYTES, with_heads, with_lines

# --- fixed values: the export format ----------------------------------------------------
SCENARIO_FIELD = "EcosimScenario"
MAP_SCENARIO_FIELD = "EcospaceScenario"
MODEL_FIELD = "ModelName"
START_YEAR_FIELD = "StartYear"
UNKNOWN_MODEL = "Unknown model"
BLOCK_START, BLOCK_END = "<HEADER", "/>"
HEADER_END_LINE = (
    r'(?m)^(?:"\s*<HEADER[^"\r\n]*end[^"\r\n]*/>\s*"|[ \t]*<HEADER[^",\r\n]*end[^",\r\n]*/>[ \t]*)(?:,.*)?$'
)
DATA_LINE = r'(?m)^([ \t]*"?[ \t]*Data[ \t]*"?[ \t]*(?:,.*)?)$'
LONG_COLUMNS = ["fleet", "group", "value"]
TREND_NAME = r"^trend_.*\.csv$"
NO_START = "start year is not a number"
BROKEN_CELL = "a quoted cell runs over its line"
BAD_CELL = "a time or number cell cannot be read"
# ----------------------------------------------------------------------------------------

_CONTENT_LINE = r'(?m)^(.*[^,\s"].*)$'


def _block_name(cell: Column) -> Column:
    """Name inside ``<HEADER name/>``; empty for every other cell."""
    return strip(F.regexp_extract(strip(cell), r"^<HEADER(.*)/>$", 1))


def _is_block(cell: Column) -> Column:
    clean = strip(cell)
    return clean.startswith(BLOCK_START) & clean.endswith(BLOCK_END)


def _last_wins(entries: Column) -> Column:
    """Map of an array of (k, v) structs in which a later key replaces an earlier one."""
    def keyed(es: Column) -> Column:
        keys = F.array_distinct(F.transform(es, lambda e: e["k"]))
        newest = lambda k: F.element_at(F.filter(es, lambda e: e["k"] == k), -1)["v"]
        return F.map_from_arrays(keys, F.transform(keys, newest))

    return let(entries, keyed)


def _pairs(rows: Column) -> Column:
    kept = F.filter(rows, lambda c: (F.size(c) >= 2) & ~_is_block(F.get(c, F.lit(0))))
    return F.transform(kept, lambda c: F.struct(
        strip(F.get(c, F.lit(0))).alias("k"), strip(F.get(c, F.lit(1))).alias("v"),
    ))


def header_fields(text: Column) -> Column:
    """``key -> value`` of the header block; without an end marker the whole file is header."""
    head = F.get(F.split(text, HEADER_END_LINE, 2), F.lit(0))
    return _last_wins(_pairs(F.transform(split_lines(head), split_csv)))


def header_blocks(text: Column) -> Column:
    """``struct(names, fields)`` of the header blocks alone: block names in order and a
    ``key -> value`` map. A title above the first block is not a field, and nothing after the
    ``end`` block is looked at."""
    head = F.get(F.split(text, HEADER_END_LINE, 2), F.lit(0))

    def read(rows: Column) -> Column:
        blocks = F.filter(rows, lambda c: _is_block(F.get(c, F.lit(0))))
        first = F.array_position(F.transform(rows, lambda c: _is_block(F.get(c, F.lit(0)))), True)
        body = F.when(first > 0, F.slice(rows, first.cast("int"), F.size(rows)))
        return F.struct(
            F.transform(blocks, lambda c: _block_name(F.get(c, F.lit(0)))).alias("names"),
            _last_wins(_pairs(body)).alias("fields"),
        )

    return let(F.filter(F.transform(split_lines(head), split_csv), lambda c: F.get(c, F.lit(0)) != ""), read)


def with_headers(files: DataFrame) -> DataFrame:
    """Add ``headers`` (map), and the identity told by it: ``model``, ``model_name``,
    ``scenario``, ``scenario_label`` (null when the file is not a time-series export)."""
    out = computed_once(files, headers=header_fields(F.col("text")))
    given = F.nullif(F.try_element_at("headers", F.lit(MODEL_FIELD)), F.lit(""))
    scenario = F.nullif(F.try_element_at("headers", F.lit(SCENARIO_FIELD)), F.lit(""))
    named = out.withColumns({"model_name": F.coalesce(given, F.lit(UNKNOWN_MODEL)), "scenario_label": scenario})
    return named.withColumns({"model": slugify(F.col("model_name")), "scenario": slugify(F.col("scenario_label"))})


def discover_output(files: DataFrame) -> DataFrame:
    """Runs found by content: one row per (model, scenario) named in the files themselves,
    with labels, number of files and number of directories. Folder names do not matter."""
    found = with_headers(files).filter(F.col("scenario").isNotNull())
    per_dir = found.groupBy("model", "scenario", "dir").agg(
        F.min(F.struct("path", "model_name", "scenario_label")).alias("first"),
        F.count("*").alias("files"),
    )
    return per_dir.groupBy("model", "scenario").agg(
        F.min("first").alias("first"), F.sum("files").alias("n_files"), F.count("*").alias("n_dirs"),
    ).select(
        "model", F.col("first.model_name").alias("model_name"),
        "scenario", F.col("first.scenario_label").alias("scenario_label"), "n_files", "n_dirs",
    )


def with_sections(files: DataFrame) -> DataFrame:
    """Locate the data section: ``unit`` (the label behind ``Data``), ``header`` (trimmed
    cells of the first line with content after it) and ``lines`` (data lines with content).
    ``header`` is null when there is no data section."""
    body = let(F.split(F.col("text"), HEADER_END_LINE, 2), lambda p: F.element_at(p, -1))
    cut = computed_once(files, _body=body)
    cut = computed_once(cut, _data=F.split("_body", DATA_LINE, 2))
    marked = F.size("_data") == 2
    label = strip(F.get(split_csv(F.regexp_extract("_body", DATA_LINE, 1)), F.lit(1)))
    cut = computed_once(
        cut.withColumn("_after", F.when(marked, F.get("_data", F.lit(1)))), unit=F.when(marked, label),
        _header=F.nullif(F.regexp_extract("_after", _CONTENT_LINE, 1), F.lit("")),
        _rest=F.get(F.split("_after", _CONTENT_LINE, 2), F.lit(1)),
    ).drop("_body", "_data", "_after")
    return computed_once(
        cut, header=F.transform(split_csv(F.col("_header")), strip),
        lines=F.filter(split_lines(F.coalesce("_rest", F.lit(""))), has_content),
    ).drop("_header", "_rest")


def with_shapes(files: DataFrame, head_only: bool = False) -> DataFrame:
    """Add ``shape``, ``freq``, ``start_year``, ``variable``, ``target`` and the file's
    ``status`` (``ok``, ``unsupported`` or ``error``) with a ``message``.

    Needs the columns of :func:`with_headers` and :func:`with_sections`. With ``head_only`` the
    data lines were not read, so having none means nothing.
    """
    first = F.lower(F.get("header", F.lit(0)))
    width = F.size("header")
    digits = F.forall(
        F.filter(F.slice("header", 2, F.greatest(width, F.lit(1))), lambda h: h != ""),
        lambda h: h.rlike("^[0-9]+$"),
    )
    shape = (
        F.when(F.col("header").isNull(), F.lit(None).cast("string"))
        .when((F.size("lines") == 0) & ~F.lit(head_only), "empty")
        .when(first.isin("year", "timestep") & (F.slice("header", 2, 3) == F.array(*map(F.lit, LONG_COLUMNS))), "long")
        .when((width == 2) & (F.lower(F.get("header", F.lit(1))) == "value"), "single")
        .when(first.endswith("\\group") & digits, "wide_by_id")
        .when(first.endswith("\\group"), "wide_by_name")
        .otherwise("unknown")
    )
    stated = F.try_element_at("headers", F.lit(START_YEAR_FIELD))
    start = F.when(stated.isNull(), F.lit(DEFAULT_START_YEAR)).otherwise(stated.try_cast("int"))
    named = file_variable(F.col("stem"))
    out = computed_once(files, shape=shape, start_year=start, _named=named).withColumns({
        "variable": F.col("_named.variable"),
        "target": F.col("_named.target"),
        "freq": frequency(first, F.col("_named.freq_hint")),
    })
    bad_time = F.exists("lines", _unusable_time(F.col("shape"), F.col("freq"), F.col("start_year")))
    message = (
        F.when(F.col("shape").isNull(), "no data section")
        .when(F.col("start_year").isNull(), NO_START)
        .when(F.col("shape") == "unknown", F.concat(F.lit("unrecognised layout: "), F.array_join("header", ",")))
        .when(F.exists("lines", broken_quotes), BROKEN_CELL)
        .when(bad_time, BAD_CELL)
    )
    out = computed_once(out, message=message).drop("_named")
    status = F.when(F.col("shape").isNull(), "unsupported").when(F.col("message").isNotNull(), "error")
    return out.withColumn("status", status.otherwise("ok"))


def _unusable_time(shape: Column, freq: Column, start_year: Column):
    """Predicate over data lines: the period is unreadable (in the wide layouts only lines
    that hold a value count), or an id of the long layout is not a whole number."""
    def whole(cell: Column) -> Column:
        n = to_number(cell)
        return n.isNull() | (n == F.floor(n))

    def bad(line: Column) -> Column:
        year, _ = year_month(freq, to_number(first_cell(line)), start_year)
        cells = split_csv(line)
        filled = F.exists(F.slice(cells, 2, F.size(cells)), lambda c: to_number(c).isNotNull())
        no_time = year.isNull() & F.when(shape.startswith("wide"), filled).otherwise(True)
        bad_id = (shape == "long") & ~(
            whole(F.coalesce(F.get(cells, F.lit(1)), F.lit(""))) & whole(F.coalesce(F.get(cells, F.lit(2)), F.lit("")))
        )
        return no_time | bad_id

    return bad


def parsed_files(files: DataFrame) -> DataFrame:
    """One row per time-series export with everything but its values read."""
    found = with_headers(files).filter(F.col("scenario").isNotNull())
    return with_shapes(with_sections(found))


def values(parsed: DataFrame) -> DataFrame:
    """Explode parsed files into tidy rows (plus ``path`` and ``dir``).

    Short lines are padded and long ones cut to the header's width. The wide layouts drop
    empty cells, the long and single ones keep them as null values.
    """
    usable = parsed.filter(F.col("status") == "ok").filter(F.col("shape") != "empty")
    return line_values(usable.select(*_PER_FILE, F.explode("lines").alias("line")))


_PER_FILE = [
    "path", "dir", "model", "model_name", "scenario", "variable", "freq", "unit", "target", "start_year", "shape", "header",
]


def line_values(lines: DataFrame, *keep: str, outer: bool = False) -> DataFrame:
    """Tidy rows of single data lines (``line``) that carry what is known of their file. With
    ``outer`` a line without values still gives one row."""
    lines = lines.withColumn("cells", split_csv(F.col("line")))

    def cell(col: Column, i: int) -> Column:
        return to_number(F.get(col, F.lit(i)))

    def entry(column: Column, fleet: Column, group: Column, value: Column) -> Column:
        return F.struct(
            column.alias("column"), fleet.alias("fleet"), group.alias("group"), value.alias("value")
        )

    none_s, none_d = F.lit(None).cast("string"), F.lit(None).cast("double")
    width = F.greatest(F.size("header"), F.lit(1))
    named = F.arrays_zip(
        F.slice("header", 2, width).alias("h"), F.slice("cells", 2, width - 1).alias("c"),
    )
    wide = F.filter(
        F.transform(
            F.filter(named, lambda z: z["h"] != ""),
            lambda z: entry(z["h"], none_d, none_d, to_number(z["c"])),
        ),
        lambda e: e["value"].isNotNull(),
    )
    long = F.array(entry(none_s, cell(F.col("cells"), 1), cell(F.col("cells"), 2), cell(F.col("cells"), 3)))
    single = F.array(entry(none_s, none_d, none_d, cell(F.col("cells"), 1)))
    entries = (
        F.when(F.col("shape").startswith("wide"), wide).when(F.col("shape") == "long", long).otherwise(single)
    )
    year, month = year_month(F.col("freq"), F.col("t"), F.col("start_year"))
    by_name = F.col("shape") == "wide_by_name"
    return lines.select(
        "path", "dir", "model", "model_name", "scenario", "variable", "freq", "unit", "target",
        "start_year", "shape", *keep, cell(F.col("cells"), 0).alias("t"),
        (F.explode_outer(entries) if outer else F.explode(entries)).alias("e"),
    ).withColumns({"year": year, "month": month}).select(
        "model", "model_name", "scenario", F.lit("output").alias("domain"), "variable", "freq",
        iso_date(F.col("year"), F.col("month")).alias("date"), "year", "month",
        F.when(F.col("shape") == "wide_by_id", F.col("e.column").try_cast("int"))
        .otherwise(F.col("e.group").cast("int")).alias("group_id"),
        F.when(by_name, F.col("target")).alias("group_name"),
        F.col("e.fleet").cast("int").alias("fleet_id"),
        F.lit(None).cast("string").alias("fleet_name"),
        F.lit(None).cast("int").alias("partner_id"),
        F.when(by_name, F.col("e.column")).alias("partner_name"),
        F.col("e.value").alias("value"), "unit", F.lit(None).cast("string").alias("run_id"),
        "path", "dir", "shape", *keep,
    )


def read_layout(files: DataFrame, *shapes: str) -> DataFrame:
    """Tidy rows of the files in the given layouts (``wide_by_id``, ``wide_by_name``,
    ``long``, ``single``; none given = all)."""
    parsed = parsed_files(files)
    if shapes:
        parsed = parsed.filter(F.col("shape").isin(*shapes))
    return values(parsed).select(*TIDY_COLUMNS)


def series_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, files)`` of the time-series exports among listed CSV files of any size: tidy rows
    (or given with their heads to the line of columns, ``with_heads(.., "table")``) as from
    :func:`values`, and one row per file with its run, ``shape``, ``status`` and
    ``message`` as from :func:`parsed_files`. Files that cannot be read are there with status
    ``error``.

    The head of each file tells its layout. All other lines are read once, by ranges, parsed
    once and written once, with a mark on those that cannot be used; a file with such a line is
    an error and gives no rows.
    """
    heads = with_headers(files if "text" in files.columns else with_heads(files, "table"))
    unread = heads.filter(F.col("read_error").isNotNull())
    known = with_shapes(with_sections(heads.filter(F.col("scenario").isNotNull())), head_only=True)
    per_file = [*_PER_FILE, "name", "scenario_label", "message", "bytes", "head_bytes"]
    known = written(known.select(*per_file), "heads")

    lines = with_lines(known.filter("shape is not null"), split_bytes).filter(has_content(F.col("line")))
    unusable = _unusable_time(F.col("shape"), F.col("freq"), F.col("start_year"))
    fault = F.when(broken_quotes(F.col("line")), BROKEN_CELL).when(unusable(F.col("line")), BAD_CELL)
    parsed = written(line_values(lines.withColumn("fault", fault), "fault", outer=True), "staged")
    seen = parsed.groupBy("path").agg(F.count("*").alias("n"), F.max(F.col("fault") == BROKEN_CELL).alias("broken"), F.max(F.col("fault") == BAD_CELL).alias("bad"))
    empty = F.col("n").isNull() & F.col("shape").isNotNull()
    found = known.join(written(seen, "seen"), "path", "left").withColumn(
        "message", F.when(empty, F.when(F.col("start_year").isNull(), NO_START)).when(F.col("message").isNotNull(), F.col("message"))
        .when(F.col("broken"), BROKEN_CELL).when(F.col("bad"), BAD_CELL)
    ).withColumn("shape", F.when(empty, "empty").otherwise(F.col("shape")))
    status = F.when(F.col("shape").isNull(), "unsupported").when(F.col("message").isNotNull(), "error").otherwise("ok")
    outcome = ["path", "dir", "name", "model", "model_name", "scenario", "scenario_label", "shape", "status", "message"]
    none = F.lit(None).cast("string")
    lost = unread.select("path", "dir", "name", *[none.alias(c) for c in outcome[3:8]], F.lit("error").alias("status"), F.col("read_error").alias("message"))
    found = written(found.withColumn("status", status).select(*outcome).unionByName(lost), "files")

    faulty = written(found.filter("status <> 'ok'").select("path"), "faulty")
    kept = parsed.join(faulty, "path", "left_anti").drop("fault")
    return kept.filter(~F.col("shape").startswith("wide") | F.col("value").isNotNull()), found


def run_directories(parsed: DataFrame) -> DataFrame:
    """Number of directories each (model, scenario) was found in."""
    return (
        parsed.select("model", "scenario", "dir").distinct()
        .groupBy("model", "scenario").agg(F.count("*").alias("n_dirs"))
    )


def assign_run_id(rows: DataFrame, directories: DataFrame) -> DataFrame:
    """``run_id`` = directory when the (model, scenario) spans more than one, else null.

    ``directories`` is :func:`run_directories`, one row per scenario; hand it over as a
    written table and the join needs no shuffle of ``rows``.
    """
    joined = rows.drop("run_id").join(directories, ["model", "scenario"], "left")
    return joined.withColumn("run_id", F.when(F.col("n_dirs") > 1, F.col("dir"))).drop("n_dirs")


def read_trends(files: DataFrame) -> DataFrame:
    """Driver trends (``trend_*.csv``) of whole texts; see :func:`trend_values`."""
    return trend_values(files.filter(F.col("name").rlike(TREND_NAME)).select(
        "grandparent", "parent", F.explode(F.slice(split_lines(F.col("text")), 2, F.length("text") + 1)).alias("line"),
    ))


def trend_files(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(rows, files)`` of the driver trends among listed files of any size: tidy rows, and one
    row per file (``path``, ``name``, ``status``, ``message``)."""
    heads = written(with_heads(files.filter(F.col("name").rlike(TREND_NAME)), "line"), "trend-heads")
    usable = heads.filter("read_error is null").select("path", "bytes", "head_bytes", "grandparent", "parent")
    found = heads.select(
        "path", "name", F.when(F.col("read_error").isNull(), "ok").otherwise("error").alias("status"), F.col("read_error").alias("message"),
    )
    return trend_values(with_lines(usable, split_bytes)), found


def trend_values(lines: DataFrame) -> DataFrame:
    """Tidy rows of trend lines behind the first: scenario and variable come from the folders
    above the file, the year from the first four digits of a line's label. Lines without a year
    or a number are skipped."""
    cells = lines.select(
        slugify(F.col("grandparent")).alias("scenario"), F.col("parent").alias("unit"), split_csv(F.col("line")).alias("cells"),
    )
    rows = cells.select(
        "scenario", "unit",
        F.regexp_extract(F.get("cells", F.lit(0)), r"(\d{4})", 1).try_cast("int").alias("year"),
        to_number(F.get("cells", F.lit(1))).alias("value"),
    ).filter(F.col("year").isNotNull() & F.col("value").isNotNull())
    known = {
        "domain": F.lit("input"), "variable": slugify(F.col("unit")), "freq": F.lit("annual"),
        "month": F.lit(1), "date": iso_date(F.col("year"), F.lit(1)),
    }
    out = rows.withColumns(known)
    return out.select(*[
        F.col(f.name) if f.name in out.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in TIDY
    ])


def discover_input(files: DataFrame) -> DataFrame:
    """Driver trend files with the scenario and driver their folders name (no content read)."""
    return files.filter(F.col("name").rlike(TREND_NAME)).select(
        slugify(F.col("grandparent")).alias("scenario"), F.col("parent").alias("driver"), "path",
    )
