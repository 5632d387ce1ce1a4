"""What a scan did with each file, counted and in words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.sources.identify import smallest


def scan_report(outcomes: DataFrame, examples_kept: int = 3) -> DataFrame:
    """Per (``kind``, ``status``): number of files and the first ``examples_kept`` names.

    ``outcomes`` has one row per file: ``kind`` (``csv``, ``trend`` or ``map``), ``status``
    (``ok``, ``unsupported``, ``unrecognised``, ``undated``, ``copy``, ``error``), ``name`` and
    ``message``.
    """
    counts = outcomes.groupBy("kind", "status").agg(
        F.count("*").alias("files"), F.min(F.when(F.col("message").isNotNull(), F.struct("name", "message"))).alias("first"),
    )
    examples = smallest(outcomes, ["kind", "status"], "name", examples_kept, "examples")
    return counts.join(examples, ["kind", "status"]).select(
        "kind", "status", "files", "examples",
        F.concat(F.col("first.name"), F.lit(": "), F.col("first.message")).alias("first_message"),
    )


def scan_warnings(report: DataFrame) -> DataFrame:
    """One sentence per kind of thing that was found and not loaded; no rows if all was."""
    n = F.col("files").cast("string")
    sentence = (
        F.when(F.col("status") == "unrecognised", F.concat(
            n, F.lit(" map files were not loaded: their names match no known map (e.g. "),
            F.array_join("examples", ", "), F.lit(")"),
        )).when(F.col("status") == "undated", F.concat(
            n, F.lit(" map files were not loaded: no year in their names (e.g. "), F.array_join("examples", ", "), F.lit(")"),
        )).when(F.col("status") == "copy", F.concat(n, F.lit(" map files were left out as copies of others")))
        .when(F.col("status") == "unsupported", F.concat(n, F.lit(" CSV files have no time-series table and were skipped")))
        .when(F.col("status") == "error", F.concat(
            n, F.lit(" "), F.col("kind"), F.lit(" files could not be loaded. First: "), F.col("first_message"),
        ))
    )
    return report.filter(F.col("status") != "ok").select("kind", "status", sentence.alias("warning"))
