"""The test tables seen as model results.

Spark derives everything here from the given tables: tidy series from line items, driver
series from events, group tables from nations, map grids from embeddings, and the texts of raw
export files from all of them. Whatever grows with the tables is aggregated on the map side
before it moves; a file text holds one calendar of one series or the 64 cells of one grid.
"""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ecolake.functions.naming import slugify
from ecolake.functions.periods import iso_date
from ecolake.schema import TIDY
from ecolake.sinks.store import conform
from ecolake.sources.files import with_path_parts

START_YEAR = 1995
DEGREES_WKT = "GEOGCS['WGS 84',DATUM['WGS_1984'],AUTHORITY['EPSG','4326']]"
METRES_WKT = "PROJCS['ETRS89 / LAEA Europe',GEOGCS['ETRS89'],AUTHORITY['EPSG','3035']]"


@lru_cache(maxsize=256)
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the folder is listed and the schema read once per session."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tidy series -------------------------------------------------------------------------

def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("Model "), c("l_linestatus")).alias("model_name"),
        F.lower("l_returnflag").alias("scenario"),
        c("l_linenumber").alias("group_id"), c("l_quantity").alias("q"),
        F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        "l_orderkey", "l_partkey", "l_suppkey",
    )


def _series(rows: DataFrame, variable: str, freq: str, *dims: str, domain: str = "output", unit: str | None = None) -> DataFrame:
    month = F.col("month") if freq == "monthly" else F.lit(1)
    keys = ["model_name", "scenario", "year", *(["month"] if freq == "monthly" else []), *dims]
    out = rows.groupBy(*keys).agg(F.sum("q").alias("value"))
    return conform(out.withColumns({
        "model": slugify(F.col("model_name")), "domain": F.lit(domain), "variable": F.lit(variable),
        "freq": F.lit(freq), "month": month, "date": iso_date(F.col("year"), month), "unit": F.lit(unit),
    }), TIDY)


def biomass(spark: SparkSession, sf_dir: str, freq: str = "annual") -> DataFrame:
    return _series(_lines(spark, sf_dir), "biomass", freq, "group_id", unit="Biomass")


def totalcatch(spark: SparkSession, sf_dir: str, freq: str = "annual") -> DataFrame:
    return _series(_lines(spark, sf_dir), "totalcatch", freq, unit="Total catch")


def catch_fleet_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    fleets = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("fleet_id"))
    rows = _lines(spark, sf_dir).join(fleets, F.col("l_suppkey") == F.col("s_suppkey"))
    return _series(rows, "catch_fleet_group", "annual", "fleet_id", "group_id", unit="CatchFleetGroup")


def predation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational series: owner = part type, partner = market segment of the customer."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("partner_name"))
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("group_name"))
    rows = (
        _lines(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
    )
    return _series(rows, "predation", "annual", "group_name", "partner_name", unit="Predation")


def drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver series from events: one "year" per day of the month, mean value."""
    rows = _driver_means(spark, sf_dir)
    return conform(rows.withColumns({
        "scenario": F.lit("bau"), "domain": F.lit("input"), "variable": F.col("event_type"), "freq": F.lit("annual"),
        "month": F.lit(1), "date": iso_date(F.col("year"), F.lit(1)), "unit": F.initcap("event_type"),
    }), TIDY)


def _driver_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 2000 + F.dayofmonth("ts")
    return table(spark, sf_dir, "events").groupBy("event_type", day.alias("year")).agg(
        F.round(F.avg("value"), 6).alias("value")
    )


def tidy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of the above as one table. A filter on the variable leaves only its own scan."""
    parts = [
        biomass(spark, sf_dir), biomass(spark, sf_dir, "monthly"), totalcatch(spark, sf_dir),
        totalcatch(spark, sf_dir, "monthly"), catch_fleet_group(spark, sf_dir), predation(spark, sf_dir),
        drivers(spark, sf_dir),
    ]
    return reduce(DataFrame.unionByName, parts)


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual biomass per directory: scenarios ``a`` and ``r`` ran five times, ``n`` once."""
    sample = F.concat(F.lit("Sample_"), (F.col("l_suppkey") % 5).cast("string"))
    lines = _lines(spark, sf_dir).withColumn("dir", F.when(F.col("scenario") == "n", "single").otherwise(sample))
    out = lines.groupBy("model_name", "scenario", "dir", "group_id", "year").agg(F.sum("q").alias("value"))
    full = out.withColumns({
        "model": slugify(F.col("model_name")), "domain": F.lit("output"), "variable": F.lit("biomass"),
        "freq": F.lit("annual"), "month": F.lit(1), "date": iso_date(F.col("year"), F.lit(1)),
        "unit": F.lit("Biomass"),
    })
    kept = [f for f in TIDY if f.name != "run_id"]
    return full.select("dir", *[
        F.col(f.name).cast(f.dataType).alias(f.name) if f.name in full.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in kept
    ])


def group_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group tables of three files per model (one per return flag): names from nations,
    baselines from quantities. Two files of Model F disagree on a name, those of Model O on
    baselines."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_returnflag", "l_linenumber").agg(
        F.min("l_quantity").alias("low"), F.sum("l_quantity").alias("total")
    )
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    odd = (F.col("l_linestatus") == "F") & (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 3)
    return rows.join(nations, F.col("l_linenumber") == F.col("n_nationkey")).select(
        F.col("l_returnflag").alias("source"), F.concat(F.lit("Model "), F.col("l_linestatus")).alias("model_name"),
        F.col("l_linenumber").alias("group_id"),
        F.when(odd, F.concat("n_name", F.lit(" x"))).otherwise(F.col("n_name")).alias("name"),
        F.when(F.col("l_linestatus") == "F", F.col("low")).otherwise(F.col("total")).alias("baseline"),
    )


def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scenario table: output scenarios from return flags, the driver scenario from events."""
    none = F.lit(None).cast("string")
    out = table(spark, sf_dir, "lineitem").select("l_returnflag").distinct().select(
        F.lower("l_returnflag").alias("id"), F.concat(F.lit("Scenario "), "l_returnflag").alias("label"),
        F.lit("output").alias("domain"), none.alias("model"), none.alias("model_name"),
    )
    return out.unionByName(driver_scenarios(spark, sf_dir))


def driver_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver scenarios named like the first letter of an event type (``a``..: some share the
    id of an output scenario) and ``bau``."""
    none = F.lit(None).cast("string")
    ids = table(spark, sf_dir, "events").select(
        F.explode(F.array(F.lit("bau"), F.substring("event_type", 3, 1))).alias("id")
    ).distinct()
    return ids.select(
        "id", F.upper("id").alias("label"), F.lit("input").alias("domain"), none.alias("model"), none.alias("model_name"),
    )


# --- raw files ---------------------------------------------------------------------------

def _head(model_name: Column, scenario: Column) -> Column:
    return F.concat(
        F.lit('"<HEADER software/>"\nEwEVersion,"6.7"\n"<HEADER ecopath/>"\nModelName,"'), model_name,
        F.lit('"\n"<HEADER ecosim/>"\nEcosimScenario,"'), scenario,
        F.lit(f'"\nStartYear,{START_YEAR}\n"<HEADER end/>"\n\n'),
    )


def _text(lines: DataFrame, keys: list[str], label: str, header: str | None = None) -> DataFrame:
    """One text per key from ``(order, line)`` rows, with the given header or that of the rows;
    ordered inside the file."""
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "line"))), lambda s: s["line"]), "\n")
    head = F.lit(header) if header is not None else F.min("header")
    return lines.groupBy(*keys).agg(body.alias("_body"), head.alias("_header")).withColumn(
        "text", F.concat(
            _head(F.col("model_name"), F.upper("scenario")), F.lit(f"Data,{label}\n\n"), "_header", F.lit("\n"), "_body", F.lit("\n"),
        ),
    )


def _members(rows: DataFrame, member: str) -> Column:
    """The distinct members of a dimension in order, as a one-value subquery: few, whatever the
    number of rows."""
    return rows.select(member).distinct().agg(F.array_sort(F.collect_list(member)).alias("members")).scalar()


def _wide_lines(rows: DataFrame, keys: list[str], order: Column, member: str, first: str, name=lambda m: m.cast("string")) -> DataFrame:
    """``(keys, order, line, header)`` with a column for each member that the data have."""
    held = rows.groupBy(*keys, order.alias("order")).agg(F.map_from_entries(F.collect_list(F.struct(member, "value"))).alias("_values"))
    wide = held.withColumn("_members", _members(rows, member))
    cells = F.transform("_members", lambda m: F.coalesce(F.try_element_at("_values", m).cast("string"), F.lit("")))
    header = F.concat_ws(",", F.lit(first), F.array_join(F.transform("_members", name), ","))
    return wide.select(*keys, "order", F.concat_ws(",", F.col("order").cast("string"), F.array_join(cells, ",")).alias("line"), header.alias("header"))


_RUN = ["model_name", "scenario"]


def _files(texts: DataFrame, *path: Column | str) -> DataFrame:
    parts = [F.lit(p) if isinstance(p, str) else p for p in path]
    return texts.select(F.concat_ws("/", F.lit("/raw"), *parts).alias("path"), "text")


def wide_by_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual and monthly biomass in the wide layout with group numbers. The monthly file has
    no frequency in its name; its ``timestep`` column tells."""
    annual = _text(_wide_lines(biomass(spark, sf_dir), _RUN, F.col("year"), "group_id", "year\\group"), _RUN, "Biomass")
    step = (F.col("year") - START_YEAR) * 12 + F.col("month")
    monthly = _text(_wide_lines(biomass(spark, sf_dir, "monthly"), _RUN, step, "group_id", "timestep\\group"), _RUN, "Biomass")
    return _files(annual, F.col("model_name"), F.col("scenario"), "biomass_annual.csv").unionByName(
        _files(monthly, F.col("model_name"), F.col("scenario"), "Biomass.csv")
    )


def wide_by_name_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predation in the wide layout with (quoted) partner names that hold a comma."""
    keys = [*_RUN, "group_name"]
    quoted = lambda m: F.concat(F.lit('"'), m, F.lit(', adult"'))
    lines = _wide_lines(predation(spark, sf_dir), keys, F.col("year"), "partner_name", "year\\group", quoted)
    name = F.concat(F.lit("predation_"), F.col("group_name"), F.lit("_annual.csv"))
    return _files(_text(lines, keys, "Predation"), F.col("model_name"), F.col("scenario"), name)


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catch per fleet and group in the long layout."""
    rows = catch_fleet_group(spark, sf_dir)
    order = F.struct("year", "fleet_id", "group_id")
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in ("year", "fleet_id", "group_id", "value")])
    texts = _text(rows.select(*_RUN, order.alias("order"), line.alias("line")), _RUN, "CatchFleetGroup", "year,fleet,group,value")
    return _files(texts, F.col("model_name"), F.col("scenario"), "catch-fleet-group_annual.csv")


def single_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Total catch in the single-series layout."""
    rows = totalcatch(spark, sf_dir)
    line = F.concat_ws(",", F.col("year").cast("string"), F.col("value").cast("string"))
    texts = _text(rows.select(*_RUN, F.col("year").alias("order"), line.alias("line")), _RUN, "Total catch", "year,value")
    return _files(texts, F.col("model_name"), F.col("scenario"), "totalcatch_annual.csv")


def odd_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files a scan must not load: an export without a table, one with an unreadable year, and
    a CSV that is no export; one of each per model and scenario."""
    runs = _lines(spark, sf_dir).select(*_RUN).distinct()
    head = _head(F.col("model_name"), F.upper("scenario"))
    folder = [F.col("model_name"), F.col("scenario"), "odd"]
    map_csv = runs.select("*", F.concat(head, F.lit("Variable,EcospaceMapBiomass\n1,2\n3,4\n")).alias("text"))
    broken = runs.select("*", F.concat(head, F.lit("Data,Broken\n\nyear,value\n1999,1\nlater,2\n")).alias("text"))
    notes = runs.select("*", F.concat(F.lit("a,b\n1,"), "scenario", F.lit("\n")).alias("text"))
    return (
        _files(map_csv, *folder, "map.csv").unionByName(_files(broken, *folder, "broken_annual.csv"))
        .unionByName(_files(notes, *folder, "notes.csv"))
    )


def trend_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver trends: ``BAU/<Driver>/trend_<driver>.csv`` with a quoted label per line."""
    rows = _driver_means(spark, sf_dir)
    line = F.concat(F.lit('"'), F.initcap("event_type"), F.lit("_"), F.col("year").cast("string"), F.lit('",'), F.col("value").cast("string"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("year", line.alias("line")))), lambda s: s["line"]), "\n")
    texts = rows.groupBy("event_type").agg(body.alias("_body")).withColumn("text", F.concat(F.lit('"","mr.mean"\n'), "_body"))
    return with_path_parts(_files(
        texts, "input", "BAU", F.initcap("event_type"), F.concat(F.lit("trend_"), "event_type", F.lit(".csv")),
    ), "/raw")


def group_table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The static model's group table, one file per model and source."""
    rows = group_table_rows(spark, sf_dir)
    line = F.concat(F.col("group_id").cast("string"), F.lit(',"'), F.col("name"), F.lit('",'), F.col("baseline").cast("string"), F.lit(",1.5"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("group_id", line.alias("line")))), lambda s: s["line"]), "\n")
    head = F.concat(F.lit('"<HEADER software/>"\nEwEVersion,"6.7"\n"<HEADER ecopath/>"\nModelName,"'), F.col("model_name"), F.lit('"\n"<HEADER end/>"\n'))
    texts = rows.groupBy("model_name", "source").agg(body.alias("_body")).withColumn(
        "text", F.concat(head, F.lit("GroupNo,Group,B,PB\n"), F.col("_body"), F.lit("\n"))
    )
    return with_path_parts(_files(texts, F.col("model_name"), F.col("source"), "basic_estimates.csv"), "/raw")


def series_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A raw output folder: all layouts, and the files that must not be loaded."""
    makers = [wide_by_id_files, wide_by_name_files, long_files, single_files, odd_files]
    return with_path_parts(reduce(DataFrame.unionByName, [m(spark, sf_dir) for m in makers]), "/raw")


# --- maps --------------------------------------------------------------------------------

def grid_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One grid text per embedding: 8 x 8 cells, even ids on a grid in degrees, odd ids on one
    in metres. Of the latter half declare degrees (wrongly), half their real system. A fifth
    of the maps lacks its first column, every 97th all cells."""
    v = F.col("vec_id")
    blank = (v % 97 == 0)
    cells = F.transform("embedding", lambda x, i: F.when(blank | ((v % 5 == 0) & (i % 8 == 0)), "-9999").otherwise(x.cast("double").cast("string")))
    head = F.when(
        v % 2 == 0, "ncols 8\nnrows 8\nxllcorner 10\nyllcorner 54\ncellsize 0.5\nNODATA_value -9999\n"
    ).otherwise("ncols 8\nnrows 8\nxllcorner 4535378\nyllcorner 3432716\ncellsize 4000\nNODATA_value -9999\n")
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.array_join(F.slice(cells, r * 8 + 1, 8), " ")), "\n")
    wkt = F.when((v % 4 == 3), METRES_WKT).otherwise(DEGREES_WKT)
    return with_path_parts(map_names(spark, sf_dir, "embedding").select(
        "path", F.concat(head, lines, F.lit("\n")).alias("text"), v.cast("string").alias("raster_id"), wkt.alias("crs_wkt"), "vec_id", "label",
    ), "/raw")


def told_wkt() -> Column:
    """A projected system without any code, as text, by ``vec_id``: transverse Mercator about a
    meridian that is no zone's, with an origin of its own for some, and systems that must not be
    guessed: another datum, feet, a projection that is not known."""
    v = F.col("vec_id")
    lon0 = (F.lit(9.25) + v % 7).cast("string")
    datum = F.when(v % 11 == 3, 'GEOGCS["Pulkovo 1942",DATUM["Pulkovo_1942",SPHEROID["Krassowsky",6378245,298.3]]').otherwise(
        'GEOGCS["WGS 84",DATUM["WGS_1984",SPHEROID["WGS 84",6378137,298.257223563]]'
    )
    kind = F.when(v % 11 == 5, "Polyconic").otherwise("Transverse_Mercator")
    unit = F.when(v % 11 == 7, 'UNIT["US survey foot",0.304800609601219]').otherwise('UNIT["metre",1]')
    return F.concat(
        F.lit('PROJCS["Own strip",'), datum, F.lit(',PRIMEM["Greenwich",0],UNIT["degree",0.0174532925199433]],PROJECTION["'), kind,
        F.lit('"],PARAMETER["latitude_of_origin",'), F.when(v % 3 == 0, "50").otherwise("0"), F.lit('],PARAMETER["central_meridian",'), lon0,
        F.lit('],PARAMETER["scale_factor",0.9998],PARAMETER["false_easting",4500000],PARAMETER["false_northing",'),
        F.when(v % 3 == 0, "3000000").otherwise("-2500000"), F.lit("],"), unit, F.lit("]"),
    )


def with_map_keys(grids: DataFrame) -> DataFrame:
    """Maps of ``vec_id`` as those of models with three scenarios, a year each, on the model's one
    grid; two years of three are biomass, the third habitat capacity."""
    v = F.col("vec_id")
    names = F.array(*map(F.lit, ["base", "low", "high"]))
    year = F.floor(v / 12).cast("int")
    return grids.withColumns({
        "model": F.concat(F.lit("m"), (v % 4).cast("string")), "scenario": F.element_at(names, (F.floor(v / 4) % 3 + 1).cast("int")),
        "year": 1998 + year, "variable": F.when(year % 3 == 2, "habitat_capacity").otherwise("biomass"),
    })


def large_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few and long wide files: a line per order, a column per line number; one file per state."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_linestatus", "l_orderkey", "l_linenumber").agg(F.sum("l_quantity").alias("value"))
    lines = _wide_lines(rows, ["l_linestatus"], F.col("l_orderkey"), "l_linenumber", "timestep\\group")
    keyed = lines.select(F.concat(F.lit("Model "), "l_linestatus").alias("model_name"), F.lit("all").alias("scenario"), "order", "line", "header")
    return _files(_text(keyed, _RUN, "Biomass"), F.col("model_name"), "biomass_monthly.csv")


def ragged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wide biomass files whose lines are as long as they like: of even years they end behind the
    fourth group, of odd years they go on behind the last column."""
    lines = _wide_lines(biomass(spark, sf_dir), _RUN, F.col("year"), "group_id", "year\\group")
    cells = F.split("line", ",")
    uneven = F.when(F.col("order") % 2 == 0, F.array_join(F.slice(cells, 1, 5), ",")).otherwise(F.concat("line", F.lit(",99,x,,98")))
    return with_path_parts(_files(_text(lines.withColumn("line", uneven), _RUN, "Biomass"), F.col("model_name"), F.col("scenario"), "biomass_annual.csv"), "/raw")


def map_names(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    """Output map names: variable by label (label 9 has a name no scan knows), scenario by
    id; scenario 1 ran in two folders, scenario 2 has no run description. Several steps fall
    into one year, so some maps collide."""
    v, label = F.col("vec_id"), F.col("label")
    prefix = (
        F.when(label <= 4, "EcospaceMapBiomass").when(label <= 6, "EcospaceMapCatch")
        .when(label == 7, "LayerHabitatCapacity").when(label == 8, "EcospaceMapEffort").otherwise("biodiv_ind")
    )
    step = F.lpad(((v % 8) * 12 + F.floor(v / 8) % 12 + 1).cast("string"), 5, "0")
    name = F.concat(prefix, F.lit("-Label "), label.cast("string"), F.lit("-"), step, F.lit(".asc"))
    run = F.when(v % 3 == 1, F.concat(F.lit("Sample_"), (v % 2).cast("string"))).otherwise("single")
    folder = F.concat_ws("/", F.lit("/raw/maps"), run, F.concat(F.lit("Scn "), (v % 3).cast("string")), F.lit("asc"))
    return table(spark, sf_dir, "embeddings").select(F.concat_ws("/", folder, name).alias("path"), "vec_id", "label", *keep)


def map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names as a folder listing: each path once."""
    return with_path_parts(map_names(spark, sf_dir).select("path").distinct(), "/raw")


def run_info_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run descriptions beside the maps of scenarios 0 and 1, with a title above the header."""
    folders = map_files(spark, sf_dir).select("dir", "grandparent").distinct().filter(F.col("grandparent") != "Scn 2")
    text = F.concat(
        F.lit('Map output\n"<HEADER ecopath/>"\nModelName,"Model E"\n"<HEADER ecosim/>"\nEcosimScenario,"'), F.col("grandparent"),
        F.lit(f'"\nStartYear,2001\n"<HEADER ecospace/>"\nEcospaceScenario,"'), F.col("grandparent"),
        F.lit(f' space"\nCoordinateSystemWKT,"{DEGREES_WKT}"\n"<HEADER end/>"\n'),
    )
    return with_path_parts(folders.select(
        F.concat_ws("/", F.lit("/raw"), "dir", F.lit("Ecospace RunInfo.txt")).alias("path"), text.alias("text"),
    ), "/raw")


def input_map_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Driver map names; every map also has a mirrored copy in another folder."""
    v, label = F.col("vec_id"), F.col("label")
    scenario = F.when(v % 2 == 0, "BAU").otherwise("HAS")
    name = F.concat(F.lit("d"), v.cast("string"), F.lit("_"), (1998 + v % 50).cast("string"), F.lit("_map.asc"))
    base = F.explode(F.array(F.lit("/raw/input"), F.lit("/raw/Connected xml")))
    return with_path_parts(table(spark, sf_dir, "embeddings").select("vec_id", "label", base.alias("base")).select(
        F.concat_ws("/", "base", scenario, F.concat(F.lit("Driver "), label.cast("string")), name).alias("path")
    ), "/raw")
