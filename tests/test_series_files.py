import gzip
import io

import pytest
from conftest import head, rows, write
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ecolake.session import written
from ecolake.sources import files
from ecolake.sources.files import EOL_BYTES as EOL
from ecolake.sources.files import list_files, read_texts, with_heads
from ecolake.sources.model_csv import (
    assign_run_id, discover_output, parsed_files, read_layout, read_trends, run_directories, series_files, values, with_headers,
)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("raw") / "Ünïcode + plus%20dir"
    write(root / "a" / "catch_annual.csv", head(start=2004) + "Data,Catch\n\nyear\\group,1,2,3\n2004,0,0.5,0.25\n2005,0,0.4,\n")
    write(root / "a" / "Biomass.csv", "﻿" + head() + "Data,Biomass\n\ntimestep\\group,1,2\n1,0.01,0.02\n13,0.011,NA\n")
    write(root / "a" / "CatchFleetGroup.csv", head() + "Data,Catch\n\ntimestep,fleet,group,value\n1,1,1,0.001\n13,1,1,x\n13,2,1\n")
    write(root / "a" / "predation_cod adult_annual.csv", head() + 'Data,Predation\r\n\r\nyear\\group,"Seal, grey","Big ""Cod"""\r\n2004,0.1,0.2,9\r\n')
    write(root / "a" / "fib_annual.csv", head() + "Data,FIB\n,,\nyear,value\n2004,1.5\n2005,\n")
    write(root / "b" / "broken_annual.csv", head() + "Data,X\n\nyear,value\n2004,1\nlater,2\n")
    write(root / "b" / "layout_annual.csv", head() + "Data,X\n\nregion,age,value\n1,2,3\n")
    write(root / "b" / "map.csv", head() + "Variable,EcospaceMapBiomass\n1,2\n")
    write(root / "b" / "startyear.csv", head(start="soon") + "Data,X\n\nyear,value\n1,2\n")
    write(root / "b" / "empty.csv", head() + "Data,X\n\nyear,value\n")
    write(root / "b" / "split.csv", head() + 'Data,X\n\nyear\\group,"Two\nlines",b\n2004,1,2\n')
    write(root / "notes.csv", "a,b\n1,2\n")
    return str(root)


def layout(spark, folder, name):
    return read_layout(read_texts(spark, folder).filter(F.col("name") == name))


def test_status_of_every_file(spark, folder):
    found = {r["name"]: (r["status"], r["shape"]) for r in parsed_files(read_texts(spark, folder)).collect()}
    assert "notes.csv" not in found
    assert found["map.csv"] == ("unsupported", None)
    assert found["empty.csv"] == ("ok", "empty")
    bad = {n for n, (status, _) in found.items() if status == "error"}
    assert bad == {"broken_annual.csv", "layout_annual.csv", "startyear.csv", "split.csv"}
    assert {found[n][1] for n in ("catch_annual.csv", "Biomass.csv")} == {"wide_by_id"}


def test_wide_by_id_drops_empty_cells(spark, folder):
    got = rows(layout(spark, folder, "catch_annual.csv"), "year", "group_id", "value", "date", "unit", "freq")
    assert len(got) == 5
    assert (2004, 2, 0.5, "2004-01-01", "Catch", "annual") in got


def test_monthly_steps_from_the_header_not_the_name(spark, folder):
    got = rows(layout(spark, folder, "Biomass.csv"), "year", "month", "group_id", "value")
    assert got == [(1998, 1, 1, 0.01), (1998, 1, 2, 0.02), (1999, 1, 1, 0.011)]


def test_long_keeps_null_values_and_pads_short_lines(spark, folder):
    df = layout(spark, folder, "CatchFleetGroup.csv")
    got = {(r["year"], r["fleet_id"], r["group_id"], r["value"]) for r in df.collect()}
    assert got == {(1998, 1, 1, 0.001), (1999, 1, 1, None), (1999, 2, 1, None)}
    assert {r["variable"] for r in df.collect()} == {"catchfleetgroup"}


def test_relational_names_with_commas_and_quotes(spark, folder):
    got = rows(layout(spark, folder, "predation_cod adult_annual.csv"), "variable", "group_name", "partner_name", "value")
    assert got == [("predation", "cod adult", 'Big "Cod"', 0.2), ("predation", "cod adult", "Seal, grey", 0.1)]


def test_single_series(spark, folder):
    got = {(r["year"], r["value"], r["group_id"]) for r in layout(spark, folder, "fib_annual.csv").collect()}
    assert got == {(2004, 1.5, None), (2005, None, None)}


def test_a_file_with_an_unreadable_period_gives_no_rows(spark, folder):
    assert layout(spark, folder, "broken_annual.csv").isEmpty()


def test_head_only_reading_finds_the_same_runs(spark, folder):
    listed = list_files(spark, folder, "*.csv")
    heads = with_heads(listed)
    whole = rows(discover_output(read_texts(spark, folder)), "model", "scenario", "n_files", "n_dirs")
    assert rows(discover_output(heads), "model", "scenario", "n_files", "n_dirs") == whole == [("test_model", "test_scenario", 11, 2)]


def test_many_texts_are_listed_by_tasks(spark, tmp_path):
    """The driver holds no name of a file, and those are read that Spark's own reader would read."""
    root = tmp_path / "many + %20#x"
    texts = {f"f{i % 3}/deep/t{i}.asc": f"text {i}\n" for i in range(200)} | {"top#1.asc": "a\r\nb", "_k=1/v.asc": "1", "mark.asc": "\ufeffmarked"}
    for name, text in texts.items():
        write(root / name, text)
    for name in ("_no.asc", ".no.asc", "_no/a.asc", ".no/a.asc", "no.csv", "f0/no.ASC"):
        write(root / name, "no")
    write(root / "empty.asc", "")
    (root / "bytes.asc").write_bytes(b"\xffa")
    (root / "zip.asc.gz").write_bytes(gzip.compress(b"zipped"))
    found = read_texts(spark, str(root), "*.{asc,asc.gz}")
    assert not [f for f in found.inputFiles() if ".asc" in f]
    got = {r["path"].split("#x/")[1]: r["text"] for r in found.select("path", "text").collect()}
    assert got == texts | {"mark.asc": "marked", "bytes.asc": "\ufffda", "zip.asc.gz": "zipped"}
    assert found.count() == len(got)
    places = rows(found.filter("name in ('t7.asc', 'top#1.asc')"), "name", "stem", "parent", "grandparent")
    assert places == [("t7.asc", "t7", "deep", "f1"), ("top#1.asc", "top#1", root.name, tmp_path.name)]
    spark_reads = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{asc,asc.gz}").text(str(root), wholetext=True)
    assert spark_reads.count() == len(got)
    assert rows(read_texts(spark, f"{tmp_path}/many*/f2", "t*.asc"), "name") == sorted((f"t{i}.asc",) for i in range(2, 200, 3))
    assert rows(read_texts(spark, str(root / "top#1.asc"), "*"), "name", "text") == [("top#1.asc", "a\r\nb")]
    assert read_texts(spark, str(root), "*.none").isEmpty()
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_texts(spark, str(root / "nowhere"))


def test_last_header_value_wins(spark):
    text = head() + ""
    text = text.replace("StartYear,1998", "StartYear,1998\nStartYear, 2001 ")
    df = with_headers(spark.createDataFrame([("/x/a.csv", text)], "path string, text string"))
    assert df.first()["headers"]["StartYear"] == "2001"


def test_runs_in_several_directories_get_a_run_id(spark, tmp_path):
    body = "Data,Biomass\n\nyear\\group,1,2\n1998,1,2\n1999,3,4\n"
    for sample in ("Sample_00001", "Sample_00002"):
        write(tmp_path / sample / "ecosim_x" / "biomass_annual.csv", head() + body)
    write(tmp_path / "other" / "biomass_annual.csv", head(scenario="single") + body)
    write(tmp_path / "same" / "biomass_annual.csv", head(model="Second", scenario="test_scenario") + body)
    parsed = parsed_files(read_texts(spark, str(tmp_path)))
    out = assign_run_id(values(parsed), run_directories(parsed))
    got = {(r["model"], r["scenario"], r["run_id"]) for r in out.collect()}
    assert got == {
        ("test_model", "test_scenario", "Sample_00001/ecosim_x"), ("test_model", "test_scenario", "Sample_00002/ecosim_x"),
        ("test_model", "single", None), ("second", "test_scenario", None),
    }


def test_trends_skip_line_one_and_unusable_lines(spark, tmp_path):
    write(tmp_path / "BAU" / "Bottom o2" / "trend_BAU.csv", '"","mr.mean"\n"Obott_1998",260.5\n"none",1\n"Obott_1999",NA\n"Obott_2000",3\n')
    write(tmp_path / "BAU" / "sst" / "trend_x.csv", "1998,0.5\n1999,0.6\n")
    got = rows(read_trends(read_texts(spark, str(tmp_path), "trend_*.csv")), "scenario", "variable", "year", "value", "unit")
    assert got == [("bau", "bottom_o2", 1998, 260.5, "Bottom o2"), ("bau", "bottom_o2", 2000, 3.0, "Bottom o2"), ("bau", "sst", 1999, 0.6, "sst")]


def test_parsing_needs_no_shuffle(spark, folder):
    plan = values(parsed_files(read_texts(spark, folder)))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("split_bytes", [7, 150, 64 << 20])
def test_ranges_of_any_size_give_the_same(spark, folder, split_bytes):
    """Rows, shapes and messages do not depend on how files are cut."""
    parsed = parsed_files(read_texts(spark, folder))
    shown = ("path", "year", "month", "group_id", "group_name", "fleet_id", "partner_name", "value", "unit", "freq", "variable")
    key = lambda df: sorted(str([r[c] for c in shown]) for r in df.collect())
    outcome = lambda df: sorted((r["name"], str(r["shape"]), r["status"], str(r["message"])) for r in df.collect())
    rows_, files = series_files(list_files(spark, folder, "*.csv"), split_bytes)
    assert key(rows_) == key(values(parsed))
    assert outcome(files) == outcome(parsed)


@pytest.mark.parametrize("eol", ["\n", "\r\n", "\r"])
def test_line_ends_and_long_heads(spark, tmp_path, eol):
    """A head longer than any buffer, blank lines before the columns, every kind of line end."""
    notes = "".join(f"Note {k},{'x' * 200}\n" for k in range(400))
    text = head().replace("StartYear", notes + "StartYear") + "Data,Biomass\n\n,,\n\nyear\\group,1,2\n1998,1,2\n\n1999,3,4"
    (tmp_path / "biomass_annual.csv").write_bytes(b"\xef\xbb\xbf" + text.replace("\n", eol).encode())
    for split_bytes in (3, 5, 1 << 20):
        rows_, files = series_files(list_files(spark, str(tmp_path), "*.csv"), split_bytes)
        assert rows(rows_, "year", "group_id", "value") == [(1998, 1, 1.0), (1998, 2, 2.0), (1999, 1, 3.0), (1999, 2, 4.0)]
        assert rows(files, "shape", "status") == [("wide_by_id", "ok")]


def test_a_file_that_cannot_be_read_stops_nothing(spark, tmp_path):
    body = "Data,Biomass\n\nyear\\group,1\n1998,1\n"
    write(tmp_path / "biomass_annual.csv", head() + body)
    gone = write(tmp_path / "catch_annual.csv", head() + body)
    listed = written(list_files(spark, str(tmp_path), "*.csv"), "listed")
    gone.unlink()
    rows_, files = series_files(listed)
    assert rows_.count() == 1 and rows(files, "name", "status") == [("biomass_annual.csv", "ok"), ("catch_annual.csv", "error")]


def test_headers_behind_a_long_preamble(spark, tmp_path):
    """The end mark ends a header, not a number of lines; what is no export is gone through and left."""
    body = "Data,Biomass\n\nyear\\group,1\n1998,1\n"
    notes = lambda n: "".join(f"note {k},{k}\n" for k in range(n))
    for k, n in enumerate((0, 7, 5000)):
        write(tmp_path / f"{k}" / "biomass_annual.csv", notes(n) + head(scenario=f"s{k}") + body)
    write(tmp_path / "notes.csv", notes(3000))
    write(tmp_path / "late.csv", notes(50) + "ModelName,Late\nEcosimScenario,late\n" + notes(20))
    listed = list_files(spark, str(tmp_path), "*.csv")
    rows_, files = series_files(listed, 4000)
    assert rows(rows_, "scenario", "value") == [("s0", 1.0), ("s1", 1.0), ("s2", 1.0)]
    assert rows(files, "name", "scenario", "status") == [("biomass_annual.csv", f"s{k}", "ok") for k in range(3)] + [("late.csv", "late", "unsupported")]
    heads = with_heads(listed, "table").collect()
    assert max(len(r["text"]) for r in heads) < 1000 and {r["head_bytes"] for r in heads if r["name"] == "notes.csv"} == {len(notes(3000))}
    assert rows(discover_output(with_heads(listed)), "scenario") == [("late",), ("s0",), ("s1",), ("s2",)]


def test_a_line_longer_than_a_read_is_searched_once(monkeypatch):
    """Lines of many reads, cut anywhere, come whole; what was searched is not searched again."""
    monkeypatch.setattr(files, "READ_BYTES", 1 << 10)
    data = b"a" * 300_000 + b"\r\n" + b"b" * 5 + b"\r" + b"c" * 200_000 + b"\n\n" + b"d" * 70_000
    searched = []

    class Counting:
        def finditer(self, held, begin):
            searched.append(len(held) - begin)
            return EOL.finditer(held, begin)

    monkeypatch.setattr(files, "EOL_BYTES", Counting())
    for cut in (1, 299_999, 300_001, 300_002, 300_003, 400_000, len(data) - 1):
        got = [line for start, end in ((0, cut), (cut, len(data))) for lines in files._range_lines(io.BytesIO(data), start, end, len(data), start > 0) for line in lines]
        assert [len(x) for x in got] == [300_000, 5, 200_000, 0, 70_000]
    assert sum(searched) < 7 * 3 * len(data)
