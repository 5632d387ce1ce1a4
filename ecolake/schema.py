"""Fixed schemas of the stored tables and the value lists they rely on."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


# One row per value of a time series.
TIDY = _schema(
    ("model", _S), ("model_name", _S), ("scenario", _S), ("domain", _S),
    ("variable", _S), ("freq", _S), ("date", _S), ("year", _I), ("month", _I),
    ("group_id", _I), ("group_name", _S), ("fleet_id", _I), ("fleet_name", _S),
    ("partner_id", _I), ("partner_name", _S), ("value", _D), ("unit", _S), ("run_id", _S),
)
TIDY_COLUMNS = TIDY.fieldNames()

# One row per map. ``path`` is the partition of the cells table the map belongs to.
RASTER_INDEX = _schema(
    ("id", _S), ("model", _S), ("model_name", _S), ("scenario", _S), ("domain", _S),
    ("variable", _S), ("group_id", _I), ("group_name", _S), ("fleet_id", _I),
    ("fleet_name", _S), ("year", _I), ("run_id", _S), ("path", _S),
    ("source_path", _S), ("source_crs_wkt", _S),
)

SCENARIOS = _schema(("id", _S), ("label", _S), ("domain", _S), ("model", _S), ("model_name", _S))
MODELS = _schema(("id", _S), ("name", _S))

# One row per grid cell of a stored map.
CELLS = _schema(
    ("model", _S), ("scenario", _S), ("domain", _S), ("variable", _S), ("raster_id", _S), ("geometry", _S),
    ("row", _I), ("col", _I), ("x", _D), ("y", _D), ("value", _D),
)

# One row per map whose cells are stored.
LEDGER = _schema(("model", _S), ("raster_id", _S), ("domain", _S))

# One row per map that was opened: ``ok``, or ``error`` with the reason.
MAP_OUTCOMES = _schema(("model", _S), ("raster_id", _S), ("domain", _S), ("outcome", _S), ("reason", _S))

# A catalog entry is one of these slices.
SLICE = ["model", "scenario", "domain", "variable", "freq"]
