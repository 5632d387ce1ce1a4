"""Folders of raw files as DataFrames.

Every reader works on a *files* DataFrame: one row per file with ``path``, the parts of the
path, and ``text`` where content is needed. Heads are read line by line to where they end, and
the lines behind them by byte ranges, so neither the number nor the size of files matters.
"""

from __future__ import annotations

import io
import itertools
import os
import re
from collections.abc import Iterable, Iterator
from functools import reduce
from urllib.parse import urlparse

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ecolake.functions.naming import stem
from ecolake.session import dealt_by_weight, spread, written

# --- fixed values -----------------------------------------------------------------------
FIRST_LINES = 6  # with content, that tell a table of fitting series
BLOCK_MARK = "<HEADER"
FIELD_MARK = re.compile(r"ModelName|StartYear|EcosimScenario|EcospaceScenario|CoordinateSystemWKT")
GRID_FIELDS = ("ncols", "nrows", "xllcorner", "yllcorner", "xllcenter", "yllcenter", "cellsize", "nodata_value")
END_MARK = re.compile(r"<HEADER[^\r\n]*end")
DATA_MARK = re.compile(r'[ \t]*"?[ \t]*Data[ \t]*"?[ \t]*(?:,|\r|\n|$)')
EOL_BYTES = re.compile(rb"\r\n|\n|\r")
_LISTED_PATH = re.compile(r"(?s)(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/]*))?(/.*)")
# ----------------------------------------------------------------------------------------
TEXTS_AT_ONCE = 64
NAMES_AT_ONCE = 4096
LISTING_TASKS = 4  # per core
OPEN_BYTES = 4 << 10  # a small file weighs these more
TEXTS_BYTES = 8 << 20
READ_BYTES = 1 << 20
SPLIT_BYTES = 64 << 20


def _decoded(path: Column) -> Column:
    """File metadata is percent-encoded; a literal ``+`` must stay one."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def with_path_parts(files: DataFrame, root: str = "") -> DataFrame:
    """Add ``dir`` (relative to ``root``, ``.`` at the top), ``name``, ``stem``, ``suffix``,
    ``parent`` and ``grandparent`` (folder names) to files that have a ``path``."""
    base = urlparse(root).path.rstrip("/") if root else ""
    path = F.col("path")
    if base:
        rel = F.substring(path, F.locate(base + "/", path) + len(base) + 1, F.length(path))
    else:
        rel = path
    name = F.substring_index(path, "/", -1)
    folders = F.split(path, "/")
    return files.withColumns({
        "rel": rel,
        "dir": F.when(F.contains(rel, F.lit("/")), F.regexp_replace(rel, "/[^/]*$", "")).otherwise("."),
        "name": name,
        "stem": stem(name),
        "suffix": F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]*)$", 1)),
        "parent": F.coalesce(F.try_element_at(folders, F.lit(-2)), F.lit("")),
        "grandparent": F.coalesce(F.try_element_at(folders, F.lit(-3)), F.lit("")),
    })


def _root(path: str) -> str:
    return path if urlparse(path).scheme else os.path.abspath(path)


def list_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Names and sizes of all files below ``root``; contents are not opened (the binary
    source reads a file only when its ``content`` column is asked for). Spark reads some 32 files in
    a task; a listing is a few rows for each, so it is put together to a few tasks per core, and
    written down it is as few files, whatever the folder."""
    root = _root(root)
    listed = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
        .select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("length").alias("bytes"))
        .coalesce(LISTING_TASKS * spark.sparkContext.defaultParallelism)
    )
    return with_path_parts(listed, root)


def read_texts(spark: SparkSession, root: str, glob: str = "*.csv") -> DataFrame:
    """Files below ``root`` as one text each, for files that are known to be small, however many they
    are: they are listed and read by tasks, and the driver holds no name. Files that are large go
    through :func:`with_heads` and :func:`with_lines`. A store that Arrow does not reach is read by
    Spark's own reader, for which the driver lists all files."""
    root = _root(root)
    found = _found(spark, root)
    if found is None:
        whole = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(root, wholetext=True)
        texts = whole.select(_decoded(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("text"))
    else:
        texts = _texts(_below(spark, found, glob))
    return with_path_parts(texts.withColumn("text", F.regexp_replace("text", "^﻿", "")), root)


def _found(spark: SparkSession, root: str) -> list[tuple[str, bool, int]] | None:
    """(path, is a folder, bytes) of ``root``, or of what it stands for as a pattern; None if there is
    nothing or Arrow does not reach it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    filesystem = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [(s.getPath().toString(), s.isDirectory(), s.getLen()) for s in filesystem.globStatus(path) or []]
    try:
        for at, _, _ in found:
            _open_listed(at)
    except (OSError, ValueError, NotImplementedError):
        return None
    return found or None


def _below(spark: SparkSession, found: list[tuple[str, bool, int]], glob: str) -> DataFrame:
    """``path`` of the files with content in and below ``found`` whose names ``glob`` fits, hidden ones
    left out as Spark's readers do; a written table, dealt to tasks by files and bytes. Tasks list
    the folders, all of one depth at a time."""
    schema = "path string, folder boolean, bytes long"

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                listed = ((f"{folder.rstrip('/')}/{name}", *rest) for name, *rest in _listed(folder) if not _hidden(name))
                while some := list(itertools.islice(listed, NAMES_AT_ONCE)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), (pa.string(), pa.bool_(), pa.int64()))], names=["path", "folder", "bytes"])

    level = spark.createDataFrame(found, schema)
    levels = [level]
    while not (folders := level.filter("folder").select("path")).isEmpty():
        level = written(spread(folders).mapInArrow(entries, schema), "listing")
        levels.append(level)
    fits = f"(?s)\\A(?:{spark._jvm.org.apache.hadoop.fs.GlobPattern.compile(glob).pattern()})\\z"
    named = F.substring_index("path", "/", -1).rlike(fits)
    files = reduce(DataFrame.unionByName, levels).filter(~F.col("folder") & (F.col("bytes") > 0) & named)
    weighed = files.select("path", (F.col("bytes") + OPEN_BYTES).alias("_weight"))
    return written(dealt_by_weight(weighed, "_weight", TEXTS_BYTES).select("path"), "listed-texts")


def _texts(files: DataFrame) -> DataFrame:
    """``path`` and ``text`` of each listed file, read whole and, if its name says so, uncompressed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for path in itertools.chain.from_iterable(batch.column(0).to_pylist() for batch in batches):
            filesystem, inner = _open_listed(path)
            with filesystem.open_input_stream(inner) as stream:
                held.append((path, stream.read()))
            size += len(held[-1][1]) + OPEN_BYTES
            if size >= READ_BYTES:
                yield _text_batch(held)
                held, size = [], 0
        if held:
            yield _text_batch(held)

    # bytes that are no UTF-8 are left to Spark
    return files.mapInArrow(read, "path string, text binary").withColumn("text", F.col("text").cast("string"))


def _text_batch(texts: list[tuple[str, bytes]]) -> pa.RecordBatch:
    paths, contents = zip(*texts)
    return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "text"])


def _listed(folder: str) -> Iterator[tuple[str, bool, int]]:
    """(name, is a folder, bytes) of what lies in a folder; a local one is gone through entry by entry."""
    from pyarrow import fs

    filesystem, inner = _open_listed(folder)
    if not isinstance(filesystem, fs.LocalFileSystem):
        for info in filesystem.get_file_info(fs.FileSelector(inner)):
            yield info.base_name, info.type == fs.FileType.Directory, info.size or 0
        return
    with os.scandir(inner) as found:
        for entry in found:
            try:
                yield entry.name, entry.is_dir(), entry.stat().st_size
            except FileNotFoundError:  # gone since, or a link to nothing
                continue


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _open_listed(path: str):
    """:func:`open_path` of a path as Hadoop writes it: not percent-encoded, any character in a name."""
    scheme, store, inner = _LISTED_PATH.fullmatch(path).groups()
    filesystem, top = open_path(f"{scheme or 'file'}://{store or ''}/")
    return filesystem, top.rstrip("/") + inner


def with_heads(files: DataFrame, part: str = "header") -> DataFrame:
    """Add ``text``, a part of each listed file read line by line: ``whole``; ``line``, the first
    one; ``top``, the first six with content; ``grid``, the lines of a map grid's header; ``header``, everything to the end mark of the
    header block; or ``table``, everything up to and with the line that names the columns.

    A file without an end mark, or without a table, is read through once, as its fields may stand
    anywhere; of ``header`` and ``table`` only lines that can matter are kept (the first six with
    content, marks, known fields, the line of columns), so no file's size is held in memory.
    ``head_bytes`` is where the part ends, ``bytes`` the size of the file. A file that cannot be
    opened or read has a null ``text`` and its fault in ``read_error``.
    """
    columns = [f for f in files.schema.fields if f.name not in ("text", "bytes", "head_bytes", "read_error")]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in columns] + ["text string", "bytes long", "head_bytes long", "read_error string"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), TEXTS_AT_ONCE):
                some = pdf.iloc[start:start + TEXTS_AT_ONCE]
                found = [_head(p, part) for p in some["path"]]
                size = pd.Series([f[1] for f in found], index=some.index, dtype="Int64")
                ends = pd.Series([f[2] for f in found], index=some.index, dtype="Int64")
                yield some.assign(text=[f[0] for f in found], bytes=size, head_bytes=ends, read_error=[f[3] for f in found])

    return files.select(*[f.name for f in columns]).mapInPandas(read, schema)


def with_lines(heads: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The lines behind the head of each file (``path``, ``bytes``, ``head_bytes``; the other
    columns are repeated) as ``line``. Files are cut into ranges of ``split_bytes`` that any task
    may read: a range has the lines that begin in it, so no file needs a task of its own.
    ``heads`` should be a written table."""
    cut = heads.filter(F.col("head_bytes") < F.col("bytes")).withColumn(
        "_start", F.explode(F.sequence(F.col("head_bytes"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
    )
    schema = StructType([*heads.schema.fields, StructField("line", StringType())])
    names = heads.columns
    total = heads.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(-(-total // max(split_bytes, 16 << 20))), heads.sparkSession.sparkContext.defaultParallelism)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {n: k for k, n in enumerate(batch.schema.names)}
            cells = [batch.column(at[n]).to_pylist() for n in ("path", "bytes", "head_bytes", "_start")]
            for i, (path, size, head, start) in enumerate(zip(*cells)):
                filesystem, inner = open_path(path)
                with filesystem.open_input_file(inner) as stream:
                    for lines in _range_lines(stream, start, min(start + split_bytes, size), size, start > head):
                        of = batch.take(pa.array([i] * len(lines), pa.int32()))
                        yield pa.RecordBatch.from_arrays([*(of.column(at[n]) for n in names), pa.array(lines, pa.string())], names=[*names, "line"])

    return cut.repartition(tasks).mapInArrow(read, schema)


def _range_lines(stream, start: int, end: int, size: int, inside: bool) -> Iterator[list[str]]:
    """Lists of the lines that begin in [start, end). ``inside``: a line may run over start."""
    at = start - 1 if inside else start
    stream.seek(at)
    held, skip, searched = bytearray(), inside, 0
    while at < end:
        held += stream.read(READ_BYTES)
        done = at + len(held) >= size
        lines = []
        begin = 0
        for m in EOL_BYTES.finditer(held, searched):
            if m.end() == len(held) and not done:
                break  # the rest of a line end may follow
            if at + begin >= end:
                break
            if skip:
                skip = False
            else:
                lines.append(bytes(held[begin:m.start()]))
            begin = m.end()
        if done and not skip and begin < len(held) and at + begin < end:
            lines.append(bytes(held[begin:]))
        at += begin
        del held[:begin]
        searched = max(0, len(held) - 1)  # a line longer than a read is searched once
        if lines:
            yield [x.decode("utf-8", "replace") for x in lines]
        if done:
            return


_clients: dict[tuple[str, str], object] = {}


def open_path(path: str):
    """(filesystem, path inside it) for a plain path or a URI; works inside tasks, which keep
    one client per scheme and host."""
    from pyarrow import fs

    parts = urlparse(path)
    if not parts.scheme or parts.scheme == "file":
        return fs.LocalFileSystem(), parts.path if parts.scheme else path
    key = (parts.scheme, parts.netloc)
    if key not in _clients:
        _clients[key] = fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", f"{parts.scheme}://{parts.netloc}/"))[0]
    return _clients[key], parts.path if parts.scheme == "hdfs" else f"{parts.netloc}{parts.path}"


def _head(path: str, part: str) -> tuple[str | None, int | None, int | None, str | None]:
    try:
        filesystem, inner = open_path(path)
        with filesystem.open_input_file(inner) as stream:
            size = stream.size()
            lines = io.TextIOWrapper(stream, encoding="utf-8", errors="surrogateescape", newline="")
            taken, end = [], 0
            for line, kept in [(lines.read(), True)] if part == "whole" else _PARTS[part](lines):
                end += len(line.encode("utf-8", "surrogateescape"))
                if kept:
                    taken.append(line)
    except OSError as fault:
        return None, None, None, str(fault)
    text = "".join(taken).encode("utf-8", "surrogateescape").decode("utf-8", "replace")
    return text.removeprefix("\ufeff"), size, end, None


def _has_content(line: str) -> bool:
    return bool(line.strip(" \t\r\n,\"\ufeff"))


def _first_line(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    for line in itertools.islice(lines, 1):
        yield line, True


def _grid_lines(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """Lines that begin with a field of a grid's header, and blank ones before the last of them."""
    blank = []
    for line in lines:
        first = line.removeprefix("\ufeff").split(maxsplit=1)[:1]
        if not first:
            blank.append(line)
        elif first[0].lower() in GRID_FIELDS:
            for b in blank:
                yield b, True
            blank = []
            yield line, True
        else:
            return


def _top_lines(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    contents = 0
    for line in lines:
        contents += _has_content(line)
        yield line, True
        if contents == FIRST_LINES:
            return


def _header_lines(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    contents = 0
    for line in lines:
        contents += _has_content(line)
        yield line, contents <= FIRST_LINES or BLOCK_MARK in line or FIELD_MARK.search(line) is not None
        if END_MARK.search(line):
            return


def _table_lines(lines: Iterable[str]) -> Iterator[tuple[str, bool]]:
    """To the first line with content behind the data mark. The mark counts behind the header's
    end, or where no header block has begun."""
    block = ended = marked = False
    contents = 0
    for line in lines:
        content = _has_content(line)
        contents += content
        if marked and content:
            yield line, True
            return
        starts = BLOCK_MARK in line
        block, ended = block or starts, ended or bool(END_MARK.search(line))
        now = (ended or not block) and DATA_MARK.match(line) is not None
        marked = marked or now
        yield line, contents <= FIRST_LINES or starts or now or (not ended and FIELD_MARK.search(line) is not None)


_PARTS = {"line": _first_line, "top": _top_lines, "grid": _grid_lines, "header": _header_lines, "table": _table_lines}
