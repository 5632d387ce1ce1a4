"""A quality classifier: logistic regression on hashed word n-grams, trained online by
follow-the-regularised-leader (proximal, one learning rate per coordinate).

A text is the sequence of its words and runs of signs. Two kinds of n-grams are hashed into one
table: of the words themselves (1 and 2), and of their shapes (1 to 3): case, length class, or
the signs. A feature weighs the square root of its share among the text's n-grams, so texts of
every length are vectors of length one and a score is a sparse dot product.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import extended, mixed

_TOKEN = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n+")
BITS = 18
WORD_GRAMS = 2
SHAPE_GRAMS = 3
SAMPLE_ROWS = 8_000
ROUNDS = 4
STRETCH = 1 << 15  # tokens that are hashed at once


def shape(token: str) -> str:
    """Signs by their first three, words by case and whether they are short."""
    if not token[0].isalnum():
        return token[:3]
    case = "a" if token.islower() else "A" if token.isupper() else "Aa" if token.istitle() else "0" if token.isdigit() else "x"
    return case + ("" if len(token) < 4 else "+" if len(token) < 20 else "++")


class _Hashes(dict):
    """Numbers of the tokens seen; ``table`` has two hashes of each: of the word, of its shape."""

    def __init__(self) -> None:
        self.table = np.empty((1 << 12, 2), np.uint64)

    def __missing__(self, token: str) -> int:
        k = len(self)
        if k == len(self.table):
            self.table = np.concatenate([self.table, np.empty_like(self.table)])
        self.table[k] = xxhash.xxh64_intdigest("w" + token.lower()), xxhash.xxh64_intdigest("s" + shape(token))
        self[token] = k
        return k

    def of(self, tokens: list[str]) -> np.ndarray:
        """(tokens, 2) hashes. What was seen is forgotten when it has become much."""
        if len(self) > 100_000:
            self.clear()
        at = np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))
        return self.table[at]  # which may be another array by now


def grams(text: str, hashes: _Hashes) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, values) of a text: int32 numbers below 2**BITS, ascending, and floats whose
    squares add up to one. A text without tokens has none."""
    tokens = _TOKEN.findall(text)
    count = np.zeros(0, np.int64)
    found: list[np.ndarray] = []
    for lo in range(0, len(tokens), STRETCH):
        # n-grams begin in the stretch and may end behind it
        both = hashes.of(tokens[lo : lo + STRETCH + max(WORD_GRAMS, SHAPE_GRAMS) - 1])
        begin = min(STRETCH, len(tokens) - lo)
        for h, most in ((both[:, 0], WORD_GRAMS), (both[:, 1], SHAPE_GRAMS)):
            joined = np.zeros(len(h), np.uint64)
            for n in range(most):
                if len(h) <= n:
                    break
                joined = mixed(joined[: len(h) - n] ^ h[n:])
                found.append((joined[:begin] >> np.uint64(64 - BITS)).astype(np.int32))
        if len(found) > 64:
            count = _counted(found, count)
            found = []
    if len(count):
        count = _counted(found, count)
        at = np.flatnonzero(count)
        count = count[at]
    elif found:
        at, count = np.unique(np.concatenate(found), return_counts=True)
    else:
        return np.zeros(0, np.int32), np.zeros(0)
    return at.astype(np.int32), np.sqrt(count / count.sum())


def _counted(found: list[np.ndarray], count: np.ndarray) -> np.ndarray:
    more = np.bincount(np.concatenate(found), minlength=1 << BITS) if found else np.zeros(1 << BITS, np.int64)
    return more + count if len(count) else more


class Leader:
    """Weights of the regularised leader: ``z`` adds up adjusted gradients, ``n`` their squares.
    A coordinate whose ``|z|`` stays within ``l1`` has weight zero."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)  # the last is the offset

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = (_logistic(float(w @ x)) - label) * x
        step = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - step * w
        self.n[at] += g * g


def _logistic(x: float) -> float:
    return 1 / (1 + np.exp(-min(max(x, -30.0), 30.0)))


def fit_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 13, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, offset) after ``rounds`` passes in shuffled order; without rows all are zero."""
    leader, rng = Leader(), np.random.default_rng(seed)
    rows = [(np.r_[at, np.int32(1 << BITS)], np.r_[x, 1.0]) for at, x in rows]
    for _ in range(rounds):
        for k in rng.permutation(len(rows)):
            leader.update(*rows[k], labels[k])
    w = leader.weights(np.arange((1 << BITS) + 1))
    return w[:-1].astype(np.float32), float(w[-1])


def _fold(doc_id: str) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5, F.lit(-1))


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, seed: int = 13) -> tuple[np.ndarray, float]:
    """(weights, offset), learnt from at most ``sample_rows`` labelled rows, those of smallest
    hash among the doc_ids whose crc32 as text mod 5 is not 0.

    Labels other than 0 and 1 are passed over, of labels that disagree the larger counts, and of
    rows with one doc_id the text of smallest hash is learnt from. N-grams are hashed where the
    rows are; the passes of the learner run in one task over the bounded sample, and the driver
    gets 2**BITS weights.
    """
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("y"))
    wanted = known.filter(_fold("doc_id") != 0).select("doc_id", F.col("y").cast("double").alias("y"), F.xxhash64(F.lit(seed), "doc_id").alias("h"))
    wanted = wanted.orderBy("h", "doc_id").limit(sample_rows)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).join(wanted, "doc_id").groupBy("h", "doc_id", "y").agg(F.min(F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Hashes()
        for batch in batches:
            made = [grams(t, seen) for t in batch.column(3).to_pylist()]
            lists = [pa.array([list_[k] for list_ in made], t) for k, t in ((0, pa.list_(pa.int32())), (1, pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), *lists], names=["h", "doc_id", "y", "at", "x"])

    schema = extended(rows.drop("text").schema, ("at", "array<int>"), ("x", "array<double>"))

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels = [], []
        for batch in batches:
            labels += batch.column(2).to_pylist()
            at, x = batch.column(3), batch.column(4)
            rows += [(at[k].values.to_numpy().copy(), x[k].values.to_numpy().copy()) for k in range(batch.num_rows)]
        w, offset = fit_leader(rows, np.array(labels), seed)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([offset])], names=["w", "offset"])

    found = rows.mapInArrow(hashed, schema).repartition(1).sortWithinPartitions("h", "doc_id").mapInArrow(fit, "w binary, offset double").collect()
    return (np.frombuffer(bytes(found[0]["w"]), np.float32), found[0]["offset"]) if found else (np.zeros(1 << BITS, np.float32), 0.0)


def with_quality(df: DataFrame, model: tuple[np.ndarray, float], score: str = "score") -> DataFrame:
    """``df`` with the column ``score`` of its ``text`` (replaced if there); map-only. Null and
    empty texts have no n-grams and get the score of the offset."""
    picked = df.drop(score)
    at = picked.columns.index("text")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (w, offset), seen = sent.value, _Hashes()
        for batch in batches:
            scores = []
            for t in batch.column(at).to_pylist():
                where, x = grams(t or "", seen)
                scores.append(_logistic(float(w[where] @ x) + offset))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, score])

    return picked.mapInArrow(run, extended(picked.schema, (score, "double")))


def quality_scores(docs: DataFrame, labels: DataFrame, at_least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted (score >= ``at_least``) of every row of ``docs``.

    Learns nothing from rows that are held out (crc32 of doc_id as text mod 5 is 0). Null and
    empty texts get the score of the offset, null doc_ids are not held out and never learnt from,
    repeated rows and ties are scored alike, empty tables give an empty result, and without any
    usable label every score is 0.5. Whole texts count, however long; columns other than doc_id
    and text play no part.
    """
    scored = with_quality(docs.select("doc_id", "text"), fit_quality(docs, labels))
    return scored.select("doc_id", (_fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= at_least).cast("int").alias("predicted"))
