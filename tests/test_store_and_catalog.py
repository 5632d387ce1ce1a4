import pytest
from conftest import head, rows, write
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from ecolake.functions.naming import name_part, slugify
from ecolake.operators import catalog, charts, effects, selection, trends
from ecolake.operators.enrich import annotate_names, group_names
from ecolake.plans import analysis
from ecolake.plans.ingest import ingest_input, ingest_output, rescan_slices
from ecolake.plans.report import scan_warnings
from ecolake.schema import CELLS, SCENARIOS, TIDY
from ecolake.session import shared_folder
from ecolake.sinks import store

BODY = "Data,Biomass\n\nyear\\group,1,2,3\n" + "".join(f"{y},{y % 4 + 0.5},{10 - y % 6},{y % 9 * 2 + 1}\n" for y in range(1998, 2006))
RUN = '"<HEADER ecopath/>"\nModelName,"Test Model"\n"<HEADER ecosim/>"\nEcosimScenario,"test_scenario"\nStartYear,1998\n"<HEADER end/>"\n'


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("loaded")
    raw, root = base / "raw", str(base / "store")
    write(raw / "run" / "biomass_annual.csv", head() + BODY)
    write(raw / "run" / "catch_annual.csv", head() + "Data,Catch\n\nyear\\group,1,2,3\n2004,0,0.5,0.25\n2005,0,0.4,0.2\n")
    write(raw / "run" / "catch-fleet-group_annual.csv", head() + "Data,CFG\n\nyear,fleet,group,value\n2004,1,2,0.1\n2004,1,3,0.2\n2004,2,2,0.3\n2004,5,3,0.4\n")
    write(raw / "run" / "broken_annual.csv", head() + "Data,X\n\nyear,value\n?,1\n")
    write(raw / "run" / "map.csv", head() + "Variable,M\n1,2\n")
    write(raw / "run" / "asc" / "Ecospace RunInfo.txt", RUN)
    write(raw / "basic_estimates.csv", '"<HEADER ecopath/>"\nModelName,"Test Model"\n"<HEADER end/>"\nGroupNo,Group,B\n2,"Cod, juvenile",1.9\n')
    for step in ("00001", "00002", "00013"):
        write(raw / "run" / "asc" / f"EcospaceMapBiomass-Cod-{step}.asc", "ncols 1\n")
    write(raw / "run" / "asc" / "biodiv_ind_x-00001.asc", "ncols 1\n")
    report = ingest_output(spark, str(raw), root, "out")
    drivers = base / "drivers"
    write(drivers / "test_scenario" / "Bottom o2" / "trend_b.csv", '"","m"\n"b_1998",0.5\n"b_1999",0.6\n')
    write(drivers / "BAU" / "sst" / "sst_1998.asc", "ncols 1\n")
    write(drivers / "BAU" / "sst" / "average.asc", "ncols 1\n")
    write(base / "drivers" / "mirror" / "BAU" / "sst" / "sst_1998.asc", "ncols 1\n")
    found = ingest_input(spark, str(drivers), root, "in")
    assert rows(found, "kind", "status", "files") == [("map", "copy", 1), ("map", "ok", 1), ("map", "undated", 1), ("trend", "ok", 1)]
    assert scan_warnings(found).count() == 2
    return root, report


def test_report_of_a_scan(loaded):
    _, report = loaded
    got = {(r["kind"], r["status"]): (r["files"], r["examples"]) for r in report.collect()}
    assert got[("csv", "ok")][0] == 3 and got[("csv", "error")] == (1, ["broken_annual.csv"])
    assert got[("csv", "unsupported")] == (1, ["map.csv"])
    assert got[("map", "ok")][0] == 2 and got[("map", "error")][0] == 1 and got[("map", "unrecognised")] == (1, ["biodiv_ind_x-00001.asc"])
    assert scan_warnings(report).count() == 4


def tidy(spark, root):
    return store.scan_sources(spark, root).drop("source_id")


def test_loaded_series_and_dimensions(spark, loaded):
    root, _ = loaded
    assert tidy(spark, root).count() == 24 + 6 + 4 + 2
    tables = [spark.read.parquet(f"{root}/scenarios/source_id={s}") for s in ("out", "in")]
    merged = store.merge_scenarios(store.combine(tables, SCENARIOS))
    assert rows(merged, "id", "domain", "label") == [("test_scenario", "output", "test_scenario")]
    assert rows(spark.read.parquet(f"{root}/models/source_id=out"), "id", "name") == [("test_model", "Test Model")]
    index = spark.read.parquet(f"{root}/rasters")
    assert rows(index, "id", "source_id") == [
        ("bau|input|sst|none|1998", "in"), ("test_scenario|output|biomass|cod|1998", "out"), ("test_scenario|output|biomass|cod|1999", "out"),
    ]


def test_large_and_small_files_load_alike(spark, loaded, tmp_path):
    """The same folder read in ranges of a few lines and of whole files."""
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    for sample in ("one", "two"):
        write(raw / sample / "biomass_annual.csv", head() + BODY)
        write(raw / sample / "broken_annual.csv", head() + "Data,X\n\nyear,value\n?,1\n")
    small = ingest_output(spark, str(raw), root, "small")
    large = ingest_output(spark, str(raw), root, "large", split_bytes=40)
    shown = ("run_id", "variable", "year", "group_id", "value")
    loaded_rows = {s: rows(store.scan_sources(spark, root, [s]), *shown) for s in ("small", "large")}
    assert loaded_rows["small"] == loaded_rows["large"] and len(loaded_rows["small"]) == 48
    assert {r[0] for r in loaded_rows["large"]} == {"one", "two"}
    assert rows(small, "kind", "status", "files") == rows(large, "kind", "status", "files") == [("csv", "error", 2), ("csv", "ok", 2)]


def test_identification_is_stored(spark, loaded):
    root, _ = loaded
    layers = spark.read.parquet(f"{root}/layers/source_id=out")
    assert rows(layers, "layer", "files", "maps") == [("ecopath", 1, 0), ("ecosim", 6, 0), ("ecospace", 4, 4)]
    assert rows(spark.read.parquet(f"{root}/kinds/source_id=in"), "kind", "files") == [("driver_trends", 1), ("ecospace_maps", 3)]
    tables = spark.read.parquet(f"{root}/groups")
    named = annotate_names(selection.query_timeseries(tidy(spark, root), "catch", group_id=[2]), group_names(tables))
    assert {r["group_name"] for r in named.collect()} == {"Cod, juvenile"}


def test_catalog_and_dimensions(spark, loaded):
    series = tidy(spark, loaded[0])
    found = {r["variable"]: (r["n_rows"], r["n_groups"], r["n_fleets"], r["category"]) for r in catalog.catalog_datasets(series).collect()}
    assert found == {
        "biomass": (24, 3, 0, "functional_groups"), "catch": (6, 3, 0, "functional_groups"),
        "catch_fleet_group": (4, 2, 3, "fleets_with_prey"), "bottom_o2": (2, 0, 0, None),
    }
    groups = catalog.list_dimension(series, "group", ["catch", "catch_fleet_group"])
    assert {r["id"]: (r["name"], r["variables"]) for r in groups.collect()} == {
        1: (None, ["catch"]), 2: (None, ["catch", "catch_fleet_group"]), 3: (None, ["catch", "catch_fleet_group"]),
    }
    fleets = catalog.list_dimension(series, "fleet", ["catch", "catch_fleet_group"])
    assert rows(fleets, "id") == [(1,), (2,), (5,)]
    differ = spark.createDataFrame([("Test Model", 1, "Cod"), ("Other", 1, "Seal")], "model_name string, group_id int, name string")
    both = series.filter(F.col("variable") == "catch").unionByName(series.filter(F.col("variable") == "catch").withColumn("model_name", F.lit("Other")))
    named = {r["id"]: r["name"] for r in catalog.list_dimension(both, "group", ["catch"], names=differ).collect()}
    assert named == {1: "Cod / Seal", 2: None, 3: None}


def test_filters_reach_the_partitions(spark, loaded):
    rows_ = selection.query_timeseries(tidy(spark, loaded[0]), "catch_fleet_group", fleet_id=[1, 2], group_id=[2], year_from=2004)
    assert rows(rows_, "fleet_id", "group_id", "value") == [(1, 2, 0.1), (2, 2, 0.3)]
    plan = rows_._jdf.queryExecution().executedPlan().toString()
    assert "variable#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "In(group_id" in plan or "EqualTo(group_id" in plan


def test_manifest(spark, loaded):
    series = tidy(spark, loaded[0])
    manifest = selection.Manifest.from_dict({"variables": ["catch", {"variable": "biomass", "scenarios": ["test_scenario"]}, "catch"], "group_ids": [2], "year_from": 2004})
    got = selection.manifest_rows(series, manifest)
    assert rows(got, "item", "variable", "year") == [
        (0, "catch", 2004), (0, "catch", 2005), (1, "biomass", 2004), (1, "biomass", 2005), (2, "catch", 2004), (2, "catch", 2005),
    ]
    with pytest.raises(ValueError):
        selection.require_rows(selection.manifest_rows(series, selection.Manifest(["nothing"])))
    assert selection.manifest_rows(series, selection.Manifest([])).isEmpty()


def test_shipped_analysis(spark, loaded):
    series = tidy(spark, loaded[0])
    out = analysis.run_analysis(series, "biomass_trend_compare", selection.Manifest(["biomass"], filters={"group_id": [2, 3]}))
    value = lambda g, y: {2: 10 - y % 6, 3: y % 9 * 2 + 1}[g]
    smoothed = {(r["group_id"], r["year"]): r["smoothed"] for r in out["trends"].collect()}
    for g in (2, 3):
        assert smoothed[(g, 1998)] is None and smoothed[(g, 2005)] is None
        for y in range(1999, 2005):
            assert smoothed[(g, y)] == pytest.approx(sum(value(g, y + d) for d in (-1, 0, 1)) / 3)
    summary = {r["group"]: (r["start"], r["end"]) for r in out["summary"].collect()}
    assert summary == {f"Group {g}": (value(g, 1998), value(g, 2005)) for g in (2, 3)}
    assert [a.id for a in analysis.compatible({"biomass", "catch"})] == ["biomass_trend_compare"] and not analysis.compatible({"catch"})


def test_moving_average_edges(spark):
    data = spark.createDataFrame([("m", "s", 1, None, y, v) for y, v in ((1, 1.0), (2, 2.0), (5, None), (6, 4.0), (7, 6.0), (8, 8.0))],
                                 "model string, scenario string, group_id int, run_id string, year int, value double")
    even = {r["year"]: r["smoothed"] for r in trends.moving_average(data, 2).collect()}
    assert even == {1: 1.5, 2: None, 5: None, 6: 5.0, 7: 7.0, 8: None}
    indexed = {r["year"]: r["relative"] for r in trends.relative_to_first(data.filter("year > 2")).collect()}
    assert indexed == {5: None, 6: 100.0, 7: 150.0, 8: 200.0}


def test_chart_keys_and_duplicates(spark, loaded):
    series = tidy(spark, loaded[0])
    one = selection.query_timeseries(series, "catch", group_id=[2])
    assert {r["series"] for r in charts.chart_points(one).collect()} == {"Group 2"}
    wide = charts.pivot_series(charts.chart_points(selection.query_timeseries(series, "catch_fleet_group")))
    assert set(wide.columns) == {"x", "Fleet 1 · Group 2", "Fleet 1 · Group 3", "Fleet 2 · Group 2", "Fleet 5 · Group 3"}
    with pytest.raises(PySparkException):
        charts.chart_points(one.unionByName(one)).collect()


def test_slices_are_replaced_alone(spark, tmp_path, loaded):
    path = str(tmp_path / "slices")
    series = tidy(spark, loaded[0])
    store.write_slices(series, path)
    store.write_slices(series.filter("variable = 'catch' and year = 2004"), path)
    got = {r["variable"]: r["count"] for r in store.read_table(spark, path, TIDY).groupBy("variable").count().collect()}
    assert got == {"biomass": 24, "catch": 3, "catch_fleet_group": 4, "bottom_o2": 2}
    with pytest.raises(ValueError):
        store.write_slices(series.limit(0), path)


def test_removing_sources_leaves_a_readable_store(spark, tmp_path, loaded):
    root = str(tmp_path / "store")
    assert store.scan_sources(spark, root).isEmpty() and store.scan_store(spark, [root]).schema == TIDY
    series = tidy(spark, loaded[0])
    store.replace_source(series, root, "a")
    store.replace_source(series.filter("variable = 'catch'"), root, "b")
    store.replace_source(series.filter("variable = 'biomass'"), root, "a")
    assert rows(store.scan_sources(spark, root).select("source_id", "variable").distinct(), "source_id", "variable") == [("a", "biomass"), ("b", "catch")]
    store.remove_source(spark, root, "a")
    store.remove_source(spark, root, "b")
    assert store.scan_sources(spark, root).isEmpty()
    assert catalog.catalog_datasets(store.scan_sources(spark, root)).isEmpty()


def test_cells_are_read_once_and_cleared_by_domain(spark, tmp_path):
    root, asked = str(tmp_path / "cells"), []
    maps = spark.createDataFrame([("a", "output"), ("b", "input"), ("c", "output")], "id string, domain string").withColumn("model", F.lit("m"))

    def parse(missing):
        asked.append({r["id"] for r in missing.collect()})
        return missing.select("model", F.lit("s").alias("scenario"), "domain", F.lit("v").alias("variable"), F.col("id").alias("raster_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), F.lit(1.5).alias("value"))

    for wanted in (maps.filter("id <> 'c'"), maps):
        store.materialise_cells(wanted, root, "x", parse)
    assert asked == [{"a", "b"}, {"c"}]
    other = maps.filter("id = 'a'").withColumn("model", F.lit("n"))
    assert rows(store.unstored_maps(other, spark, root, "x"), "id", "model") == [("a", "n")]
    store.clear_cells(spark, root, "x", "output")
    left = store.read_cells(spark, root, "x")
    assert rows(left, "raster_id", "domain") == [("b", "input")] and left.schema == CELLS


def test_gating(spark):
    index = spark.createDataFrame(
        [("output", "b", "annual", [("s1", "m1", "M1"), ("s1", "m2", "M2"), ("s2", "m1", "M1")]), ("input", "d", "annual", [("drv", None, None)])],
        "domain string, variable string, freq string, combos array<struct<scenario: string, model: string, model_name: string>>",
    )
    got = {r["variable"]: (r["available"], r["effective"]) for r in selection.gate_scenarios(
        index, ["m2"], ["s1", "s2"], {("output", "b", "annual"): ["s2", "s1"]}).collect()}
    assert got == {"b": (["s1"], ["s1"]), "d": (["drv"], ["drv"])}


def test_names(spark):
    df = spark.createDataFrame([("  Fjord__No  7: Ærø? ",), ("--",), ("Reef (inner)",), ("Mysis cf. mixta",)], "t string")
    assert [r[0] for r in df.select(slugify(F.col("t"))).collect()] == ["fjord__no_7_ærø", "", "reef_inner", "mysis_cf_mixta"]
    assert [r[0] for r in df.select(name_part(F.col("t"))).collect()][1:] == ["x", "Reef-inner", "Mysis-cf.-mixta"]


def test_scratch_is_local_only_in_local_mode(spark):
    assert shared_folder(spark) == shared_folder(spark)


def test_models_that_share_a_scenario_keep_their_slices(spark, tmp_path):
    path = str(tmp_path / "slices")
    row = lambda model, value: spark.createDataFrame([(model, "s", "output", "biomass", "annual", 2001, value)], "model string, scenario string, domain string, variable string, freq string, year int, value double")
    store.write_slices(row("north", 1.0), path)
    store.write_slices(row("south", 2.0), path)
    store.write_slices(row("north", 3.0), path)
    assert rows(store.read_table(spark, path, TIDY), "model", "value") == [("north", 3.0), ("south", 2.0)]


def test_session_settings_do_not_change_what_is_replaced(spark, tmp_path):
    root = str(tmp_path / "store")
    row = lambda variable: spark.createDataFrame([("m", "s", "output", variable, "annual", 2001, 1.0)], "model string, scenario string, domain string, variable string, freq string, year int, value double")
    kept = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.replace_source(row("catch").union(row("biomass")), root, "x")
        store.replace_source(row("catch"), root, "x")
        assert rows(store.scan_sources(spark, root), "variable") == [("catch",)]
        store.remove_source(spark, root, "x")
        assert store.scan_sources(spark, root).isEmpty()
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", kept)


def test_a_removed_source_leaves_no_table(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    write(raw / "biomass_annual.csv", head() + BODY)
    ingest_output(spark, str(raw), root, "gone")
    store.remove_source(spark, root, "gone")
    assert not list((tmp_path / "store").rglob("source_id=gone"))


def test_menus_are_stored_and_renewed_by_slice(spark, tmp_path):
    raw, root = tmp_path / "raw", str(tmp_path / "store")
    write(raw / "biomass_annual.csv", head() + BODY)
    write(raw / "catch_annual.csv", head() + "Data,Catch\n\nyear\\group,1,2,9\n2004,0,0.5,0.25\n")
    ingest_output(spark, str(raw), root, "one")
    members = lambda: spark.read.parquet(f"{root}/members/source_id=one")
    assert rows(catalog.list_dimension(members(), "group", ["biomass", "catch"]), "id") == [(1,), (2,), (3,), (9,)]
    assert rows(catalog.catalog_of_members(members()), "variable", "n_rows") == rows(spark.read.parquet(f"{root}/catalog/source_id=one"), "variable", "n_rows") == [("biomass", 24), ("catch", 3)]
    rescan_slices(tidy(spark, root).filter("variable = 'catch' and group_id < 9"), root, "one")
    assert rows(catalog.list_dimension(members(), "group", ["catch"]), "id") == [(1,), (2,)]
    assert rows(spark.read.parquet(f"{root}/catalog/source_id=one"), "variable", "n_rows", "n_groups") == [("biomass", 24, 3), ("catch", 2, 2)]
    assert store.scan_sources(spark, root).count() == 26


def test_results_come_in_query_order(spark):
    """The order a table is shown in, missing values last, whatever the partitions."""
    keys = selection.QUERY_ORDER
    data = tidy_rows(spark, [("n", 2004, 2), ("n", 2003, None), ("a", 2004, 1), (None, 2001, 3), ("a", 2004, None), ("n", 2003, 1)])
    got = [tuple(r[k] for k in keys) for r in selection.in_query_order(data.repartition(5)).collect()]
    assert len(got) == 6 and got == sorted(got, key=lambda row: [(v is None, v or 0) if not isinstance(v, str) else (False, v) for v in row])
    assert got[0][keys.index("scenario")] == "a" and got[-1][keys.index("scenario")] is None


def tidy_rows(spark, members):
    made = spark.createDataFrame([(s, y, g, 1.0) for s, y, g in members], "scenario string, year int, group_id int, value double")
    return store.conform(made, TIDY)


SERIES = "model string, scenario string, variable string, year int, group_id int, run_id string, value double"


def test_paired_effects(spark):
    row = lambda s, y, g, v: ("m", s, "b", y, g, None, v)
    data = spark.createDataFrame([row("base", 1, 1, 2.0), row("a", 1, 1, 3.0), row("a", 2, 1, 5.0), row("base", 3, None, 0.0), row("a", 3, None, 4.0), row("base", 4, 1, 1.0), row("z", 1, 1, -2.0)], SERIES)
    got = {(r["scenario"], r["year"]): r for r in effects.paired_effect(data, "base").collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        ("a", 1): "paired", ("a", 2): "no_baseline", ("a", 3): "paired", ("a", 4): "no_scenario", ("z", 1): "paired", ("z", 3): "no_scenario", ("z", 4): "no_scenario",
    }
    assert (got["a", 1]["absolute"], got["a", 1]["percent"]) == (1.0, 50.0) and got["a", 1]["log_ratio"] == pytest.approx(0.405465108)
    assert got["a", 3]["percent"] is None and got["z", 1]["log_ratio"] is None
    assert rows(effects.unmatched(effects.paired_effect(data, "base")), "scenario", "status", "keys") == [("a", "no_baseline", 1), ("a", "no_scenario", 1), ("z", "no_scenario", 2)]
    with pytest.raises(PySparkException, match="two values"):
        effects.paired_effect(data.union(data), "base").collect()


def test_bands_need_an_ensemble(spark):
    data = spark.createDataFrame([("m", "s", "b", 1, 1, f"r{k}", float(k)) for k in range(5)] + [("m", "s", "b", 2, 1, "r0", 9.0)], SERIES)
    got = {r["year"]: r for r in effects.quantile_bands(data, [0.0, 0.5, 0.9]).collect()}
    assert (got[1]["runs"], got[1]["mean"], got[1]["q00"], got[1]["q50"], got[1]["q90"]) == (5, 2.0, 0.0, 2.0, 3.6)
    assert (got[2]["runs"], got[2]["q50"]) == (1, 9.0)
    for bad in (data.filter("run_id = 'r0'"), data.withColumn("run_id", F.nullif("run_id", F.lit("r1"))), data.limit(0)):
        with pytest.raises(ValueError, match="ensemble"):
            effects.quantile_bands(bad)
    with pytest.raises(PySparkException, match="two values"):
        effects.quantile_bands(data.union(data)).collect()
