"""Splitting CSV lines inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EOL = r"\r\n|\n|\r"
# A field after its comma: quoted (quotes doubled inside) or plain. Linear in the line.
_FIELD = r',("[^"]*(?:""[^"]*)*"(?=,|$)|[^,]*)'


def split_lines(text: Column) -> Column:
    return F.split(text, EOL)


def split_csv(line: Column) -> Column:
    """Cells of one CSV line. Lines without a quote, nearly all of them, take the cheap way."""
    fields = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(_FIELD), F.lit(1))
    return F.when(F.contains(line, F.lit('"')), F.transform(fields, _unquote)).otherwise(
        F.split(line, ",")
    )


def _unquote(cell: Column) -> Column:
    inner = F.regexp_extract(cell, r'^"(.*)"$', 1)
    return F.when(cell.startswith('"') & (F.length(inner) > 0), F.replace(inner, F.lit('""'), F.lit('"'))).when(
        cell == '""', ""
    ).otherwise(cell)


def first_cell(line: Column) -> Column:
    """First cell of a line, without splitting the rest."""
    quoted = F.regexp_extract(line, r'^"([^"]*)"', 1)
    return F.when(line.startswith('"'), quoted).otherwise(F.substring_index(line, ",", 1))


def has_content(line: Column) -> Column:
    """False for lines whose cells are all blank."""
    return line.rlike(r'[^,\s"]')


def broken_quotes(line: Column) -> Column:
    """A quoted cell that runs over the end of its line (an odd number of quotes)."""
    return F.contains(line, F.lit('"')) & (
        F.pmod(F.length(line) - F.length(F.replace(line, F.lit('"'))), F.lit(2)) == 1
    )
