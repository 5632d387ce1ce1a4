"""Token totals for every context limit from an exact histogram of encoded lengths.

Documents are encoded once and only counted by length. Suffix sums over the lengths then
answer, for any limit, how many documents fit, how many tokens remain when longer ones are
truncated, and any quantile, without touching a document again.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ecolake.llm.common import extended, written

# --- fixed values -----------------------------------------------------------------------
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# ----------------------------------------------------------------------------------------
LONG = 20_000  # characters of one kind in a row that the encoder's own pattern search may not survive
_PATTERN = regex.compile(PATTERN)
_LONG = regex.compile(rf"\p{{L}}{{{LONG},}}+|\p{{N}}{{{LONG},}}+|\s{{{LONG},}}+|[^\s\p{{L}}\p{{N}}]{{{LONG},}}+")
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PAGE = 512

_encodings: dict[int, tiktoken.Encoding] = {}


def encoding(vocabulary: bytes) -> tiktoken.Encoding:
    """The byte-pair encoding of a vocabulary file's bytes, made once in a process."""
    key = hash(vocabulary)
    if key not in _encodings:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_count(text: str, vocabulary: tiktoken.Encoding) -> int:
    """Number of tokens of a text, special tokens being ordinary text. The encoder cuts a text by a
    recursive search, which a very long run of letters, digits, signs or blanks overflows; a text
    with such a run is cut by the same pattern elsewhere, and its pieces encoded one by one."""
    if len(text) < LONG or _LONG.search(text) is None:
        return len(vocabulary.encode_to_numpy(text, disallowed_special=()))
    clean = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")  # as the encoder does
    return sum(len(vocabulary._encode_single_piece(m.group())) for m in _PATTERN.finditer(clean))


def length_histogram(docs: DataFrame, by: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """(``by``, n_tokens, n_docs): documents of each encoded length. The vocabulary is a file of
    a public tokenizer that the driver reads and sends to the tasks (under a megabyte).

    Special tokens in a text are ordinary text. Null and empty texts have length 0. Null is a
    group of its own. Each task adds up before the shuffle, so a hot group is a few rows each.
    """
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoding(sent.value)
        for batch in batches:
            lengths = [token_count(t, known) if t else 0 for t in batch.column(1).to_pylist()]
            found = Counter(zip(batch.column(0).to_pylist(), lengths))
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in found], batch.column(0).type), pa.array([k[1] for k in found], pa.int64()), pa.array(list(found.values()), pa.int64())],
                names=[by, "n_tokens", "n_docs"],
            )

    picked = docs.select(by, "text")
    counted = picked.mapInArrow(count, extended(picked.select(by).schema, ("n_tokens", "long"), ("n_docs", "long")))
    return counted.groupBy(by, "n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_answers(histogram: DataFrame, by: str = "source") -> DataFrame:
    """For each length that occurs in a group, taken as the context limit: documents of that
    length, at most that long and longer, all tokens, tokens kept when longer documents are cut
    at the limit, and the quantile the limit is. Limits in between keep
    ``kept_tokens + n_longer * (limit - context_limit)`` tokens.

    Lengths are added up in pages of ``PAGE`` lengths first, so no window is longer than a page
    or the number of pages."""
    h = written(histogram.withColumn("page", F.expr(f"n_tokens div {PAGE}")), "histogram")
    pages = h.groupBy(by, "page").agg(F.sum("n_docs").alias("docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("tokens"))
    across, whole = Window.partitionBy(by).orderBy("page"), Window.partitionBy(by)
    pages = pages.select(
        F.col(by).alias("__by"), F.col("page").alias("__page"),
        (F.sum("docs").over(across) - F.col("docs")).alias("docs_before"), (F.sum("tokens").over(across) - F.col("tokens")).alias("tokens_before"),
        F.sum("docs").over(whole).alias("all_docs"), F.sum("tokens").over(whole).alias("all_tokens"),
    )
    in_page = Window.partitionBy(by, "page").orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    h = h.withColumns({"docs_in": F.sum("n_docs").over(in_page), "tokens_in": F.sum(F.col("n_docs") * F.col("n_tokens")).over(in_page)})
    fit = F.col("docs_before") + F.col("docs_in")
    return h.join(pages, F.col(by).eqNullSafe(F.col("__by")) & (F.col("page") == F.col("__page"))).select(
        by, F.col("n_tokens").alias("context_limit"), "n_docs", fit.alias("n_fit"), (F.col("all_docs") - fit).alias("n_longer"),
        F.col("all_tokens").alias("total_tokens"),
        (F.col("tokens_before") + F.col("tokens_in") + (F.col("all_docs") - fit) * F.col("n_tokens")).alias("kept_tokens"),
        (fit / F.col("all_docs")).alias("quantile"),
    )


def truncated_totals(answers: DataFrame, limits: list[int], by: str = "source") -> DataFrame:
    """(``by``, limit, kept_tokens, n_longer) for any limits, from ``suffix_answers``."""
    wanted = answers.sparkSession.createDataFrame([(x,) for x in limits], "limit long")
    below = answers.select(by, "context_limit", "n_longer", "kept_tokens", "total_tokens", (F.col("n_fit") + F.col("n_longer")).alias("n"))
    best = below.join(wanted, F.col("context_limit") <= F.col("limit")).groupBy(by, "limit").agg(
        F.max_by(F.struct("context_limit", "n_longer", "kept_tokens"), "context_limit").alias("b")
    )
    none = below.groupBy(by).agg(F.max("n").alias("n")).join(wanted)
    joined = none.withColumnRenamed(by, "g").join(best, F.col("g").eqNullSafe(F.col(by)) & (none["limit"] == best["limit"]), "left")
    kept = F.col("b.kept_tokens") + F.col("b.n_longer") * (none["limit"] - F.col("b.context_limit"))
    return joined.select(F.col("g").alias(by), none["limit"], F.coalesce(kept, F.col("n") * none["limit"]).alias("kept_tokens"), F.coalesce("b.n_longer", "n").alias("n_longer"))


def length_quantiles(answers: DataFrame, shares: list[float], by: str = "source") -> DataFrame:
    """(``by``, share, n_tokens): the smallest length that at least ``share`` of the documents
    of the group do not exceed."""
    wanted = answers.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    return answers.join(wanted, F.col("quantile") >= F.col("share")).groupBy(by, "share").agg(F.min("context_limit").alias("n_tokens"))
