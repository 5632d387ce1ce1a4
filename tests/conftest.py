import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("ecolake-tests")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


HEAD = (
    '"<HEADER software/>"\nEwEVersion,"6.7.0.19540"\n"<HEADER ecopath/>"\nModelName,"{model}"\n'
    '"<HEADER ecosim/>"\nEcosimScenario,{scenario}\nStartYear,{start}\n"<HEADER end/>"\n\n'
)


def head(model="Test Model", scenario="test_scenario", start=1998):
    return HEAD.format(model=model, scenario=scenario, start=start)


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return path


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.select(*columns).collect())
