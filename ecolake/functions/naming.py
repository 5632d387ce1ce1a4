"""Names: slugs, variables named by files, display labels and export file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANKS = " \t\r\n\f\x0b\xa0"


def strip(text: Column) -> Column:
    """Trim every kind of white space (SQL's own TRIM knows only the space)."""
    return F.btrim(text, F.lit(_BLANKS))


def slugify(text: Column) -> Column:
    """Lower-case identifier: runs of anything but letters, digits and ``_`` become one
    ``_``, none at the ends. Letters of every alphabet survive."""
    joined = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]+", "_")
    return F.btrim(joined, F.lit("_"))


def stem(file_name: Column) -> Column:
    """File name without its last suffix."""
    return F.regexp_replace(file_name, r"(?<=.)\.[^.]*$", "")


# --- fixed values: file-name conventions of the exports -------------------------------
FREQ_SUFFIX = r"_(annual|monthly)$"
RELATIONAL_PREFIXES = ("predation", "prey")
# ---------------------------------------------------------------------------------------


def file_variable(file_stem_: Column) -> Column:
    """``struct(variable, freq_hint, target)`` told by a file's stem.

    A relational file names its owner after the prefix; for any other file the
    whole stem is the variable.
    """
    base = F.regexp_replace(file_stem_, FREQ_SUFFIX, "")
    hint = F.when(file_stem_.endswith("_monthly"), "monthly").otherwise("annual")
    variable, target = slugify(base), F.lit(None).cast("string")
    for prefix in RELATIONAL_PREFIXES:
        owned = base.startswith(prefix + "_")
        variable = F.when(owned, F.lit(prefix)).otherwise(variable)
        target = F.when(owned, strip(F.substring(base, len(prefix) + 2, 1 << 20))).otherwise(target)
    return F.struct(variable.alias("variable"), hint.alias("freq_hint"), target.alias("target"))


def label(kind: str, ident: Column, name: Column) -> Column:
    """The name where there is one, else ``Group 7`` / ``Fleet 7``, else null."""
    given = F.nullif(name, F.lit(""))
    return F.coalesce(given, F.concat(F.lit(kind.capitalize() + " "), ident.cast("string")))


def name_part(text: Column) -> Column:
    """One field of an export file name: only letters, digits, ``.``, ``-`` and single ``_``."""
    clean = F.regexp_replace(strip(text), r"[^A-Za-z0-9._-]+", "-")
    clean = F.regexp_replace(F.regexp_replace(clean, "-{2,}", "-"), "_{2,}", "_")
    clean = F.btrim(clean, F.lit("-._"))
    return F.when(clean == "", "x").otherwise(clean)


def file_stem(
    area: Column, model: Column, scenario: Column, variable: Column, entity: Column, years: Column,
    run: Column | None = None,
) -> Column:
    """Export file stem that spells out the whole selection, fields joined by ``__``; a run
    follows its scenario, and a null one is left out."""
    parts = [
        area, F.coalesce(F.nullif(model, F.lit("")), F.lit("no-model")), scenario, *([] if run is None else [run]), variable,
        F.coalesce(F.nullif(entity, F.lit("")), F.lit("all")), years,
    ]
    return F.concat_ws("__", *[name_part(p.cast("string")) for p in parts])
