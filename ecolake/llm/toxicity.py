"""A convolutional text classifier for toxicity, trained in parallel on all labelled rows.

A word is the sum of hashed embeddings of itself and of its first four letters, two buckets
each, so that a chance collision of one bucket has half the weight at most. Filters of widths
one to three run over the words, each filter's maximum over the text is kept, and a logistic
layer gives the score. Embeddings start at zero: a word never seen adds nothing.

All labelled rows are fitted: they are written once, and in each round every task takes the
weights of the round before through its own rows, and the tasks' weights are averaged in a
shuffle by blocks of buckets. The driver holds one model, whose size is fixed. A fifth of the rows
is held back: the round with the least loss on them is kept, and per language a threshold is
calibrated on them, which only serves to reject documents and never changes a score.
"""

from __future__ import annotations

import itertools
import pickle
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecolake.llm.common import among, batches_of, drop_written, extended, filter_bits
from ecolake.session import written

_WORD = re.compile(r"[^\W_]+")
BUCKETS = 1 << 17
DIM = 12
WIDTHS = (1, 2, 3)
FILTERS = 12
FILE_ROWS = 4_096  # labelled rows of a file, at least; a task of a round reads one or more
BLOCK_ROWS, BLOCK_BYTES = 4_096, 32 << 20  # that a task holds and shuffles at once
SCORED_ROWS = 256
WORDS_HELD = 200_000
LEAST_ROUNDS, MOST_ROUNDS = 2, 8
VISITS = 60_000  # where rows are few, rounds are many, and a round shows each row up to 8 times
BATCH = 32
RATE = 0.1
KEEP = 0.5  # share of a row's words that is shown, so that no single word can be learned by heart
CHUNK = 1 << 13  # buckets that are averaged together
BINS = 10_000  # of scores, in the calibration
UNKNOWN = 0.05  # score of every text where no label is known
STRETCH = 1 << 14  # words that are convolved at once


def _buckets_of(word: str) -> tuple[int, int, int, int]:
    """Bucket numbers of a word: two of the word, two of its first letters."""
    a = xxhash.xxh3_64_intdigest("w" + word)
    b = xxhash.xxh3_64_intdigest("p" + word[:4])
    return a % BUCKETS, (a >> 32) % BUCKETS, b % BUCKETS, (b >> 32) % BUCKETS


class _Buckets(dict):
    """Bucket numbers of each word."""

    def __missing__(self, word: str) -> tuple[int, int, int, int]:
        if len(self) > 100_000:
            self.clear()
        self[word] = got = _buckets_of(word)
        return got


class _Words(dict):
    """Numbers of the words met so far, in order, and the buckets of all of them."""

    def __init__(self) -> None:
        super().__init__()
        self.rows = array("i")

    def __missing__(self, word: str) -> int:
        number = len(self)
        self[word] = number
        self.rows.extend(_buckets_of(word))
        return number

    def numbers(self, text: str) -> np.ndarray:
        return np.array(list(map(self.__getitem__, _WORD.findall(text.lower()))), np.int32)

    def table(self) -> np.ndarray:
        return np.array(self.rows, np.int32).reshape(-1, 4)


def bucket_rows(text: str, buckets: _Buckets) -> np.ndarray:
    """(words, 4) bucket numbers of a text."""
    found = _WORD.findall(text.lower())
    return np.array([buckets[w] for w in found], np.int32).reshape(-1, 4)


@dataclass
class Model:
    embedding: np.ndarray  # BUCKETS x DIM
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray
    weight: np.ndarray
    offset: float
    thresholds: dict[str, float]

    def pooled(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of every filter over the text (at least 0) and where it begins (-1: nowhere)."""
        best, place = np.zeros(len(WIDTHS) * FILTERS, np.float32), np.full(len(WIDTHS) * FILTERS, -1, np.int64)
        for lo in range(0, len(rows), STRETCH):
            part = rows[lo : lo + STRETCH + max(WIDTHS) - 1]
            e = self.embedding[part].sum(axis=1)
            for k, width in enumerate(WIDTHS):
                n = min(len(part) - width + 1, STRETCH)
                if n < 1:
                    continue
                out = e[:n] @ self.filters[k][0]
                for j in range(1, width):
                    out += e[j : j + n] @ self.filters[k][j]
                top = out.argmax(axis=0)
                value = out[top, np.arange(FILTERS)] + self.bias[k * FILTERS : (k + 1) * FILTERS]
                at = slice(k * FILTERS, (k + 1) * FILTERS)
                place[at] = np.where(value > best[at], top + lo, place[at])
                best[at] = np.maximum(best[at], value)
        return best, place

    def score(self, rows: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.pooled(rows)[0] @ self.weight + self.offset, -30, 30))))


@dataclass
class State:
    """A model in training with AdaGrad's sums of squares: one per bucket, and one per dense weight."""

    model: Model
    bucket_squares: np.ndarray
    squares: np.ndarray

    def dense(self) -> np.ndarray:
        m = self.model
        return np.concatenate([*[f.ravel() for f in m.filters], m.bias, m.weight, [m.offset]]).astype(np.float32)

    def set_dense(self, values: np.ndarray) -> None:
        at = 0
        for f in [*self.model.filters, self.model.bias, self.model.weight]:
            f[...] = values[at : at + f.size].reshape(f.shape)
            at += f.size
        self.model.offset = float(values[at])


def begin(rate_of: float, seed: int) -> State:
    """The state before the first round; ``rate_of`` is the share of toxic rows."""
    rng = np.random.default_rng(seed)
    n = len(WIDTHS) * FILTERS
    share = float(np.clip(rate_of, 1e-3, 1 - 1e-3))
    filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
    m = Model(np.zeros((BUCKETS, DIM), np.float32), filters, np.full(n, 0.01, np.float32), rng.normal(0, 0.5, n).astype(np.float32), float(np.log(share / (1 - share))), {})
    state = State(m, np.zeros(BUCKETS, np.float32), np.zeros(0, np.float32))
    state.squares = np.zeros_like(state.dense())
    return state


def _forward(m: Model, table: np.ndarray, docs: list[np.ndarray], vectors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word numbers in a row, maxima, their places in that row) of several texts: what
    :meth:`Model.pooled` gives of each. ``table`` has the buckets of the words and ``vectors``, if
    known, the sums of their embeddings."""
    n = len(WIDTHS) * FILTERS
    ids = np.concatenate(docs)
    best, place = np.zeros((len(docs), n), np.float32), np.full((len(docs), n), -1, np.int64)
    begins = np.cumsum([0, *map(len, docs)])
    if len(ids) > 4 * STRETCH:
        for d, numbers in enumerate(docs):
            best[d], where = m.pooled(table[numbers])
            place[d] = np.where(where >= 0, where + begins[d], -1)
        return ids, best, place
    e = np.ascontiguousarray((m.embedding[table[ids]].sum(axis=1) if vectors is None else vectors[ids]).T)
    for k, width in enumerate(WIDTHS):
        out = m.filters[k][0].T @ e
        for j in range(1, width):
            out[:, :-j] += (m.filters[k][j].T @ e)[:, j:]
        at = slice(k * FILTERS, (k + 1) * FILTERS)
        for d in range(len(docs)):
            lo, hi = begins[d], begins[d + 1] - width + 1
            if hi <= lo:
                continue
            top = out[:, lo:hi].argmax(axis=1) + lo
            value = out[np.arange(FILTERS), top] + m.bias[at]
            place[d, at] = np.where(value > 0, top, -1)
            best[d, at] = np.maximum(value, 0)
    return ids, best, place


def _probability(m: Model, pooled: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(pooled @ m.weight + m.offset, -30, 30)))


def _step(state: State, table: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> None:
    """One AdaGrad step on the logistic loss; gradients flow through each filter's maximum only."""
    m = state.model
    ids, pooled, place = _forward(m, table, docs)
    err = (_probability(m, pooled) - labels) / len(docs)
    back = (err[:, None] * m.weight * (place >= 0)).astype(np.float32)
    g_filters, words, grads = [np.zeros_like(f) for f in m.filters], [], []
    if len(ids):
        for k, width in enumerate(WIDTHS):
            at = slice(k * FILTERS, (k + 1) * FILTERS)
            for j in range(width):
                # a filter without a maximum has no gradient, whatever word stands for it
                found = ids[np.where(place[:, at] >= 0, place[:, at] + j, 0)]
                g_filters[k][j] = np.einsum("dfe,df->ef", m.embedding[table[found]].sum(axis=2), back[:, at])
                words.append(found.ravel())
                grads.append((m.filters[k][j].T[None] * back[:, at, None]).reshape(-1, DIM))
        where, total = _summed(np.concatenate(words), np.concatenate(grads))
        where, total = _summed(table[where].ravel(), np.repeat(total, table.shape[1], axis=0))
        state.bucket_squares[where] += (total * total).mean(axis=1)
        m.embedding[where] -= RATE * total / (np.sqrt(state.bucket_squares[where]) + 1e-6)[:, None]
    grad = np.concatenate([*[g.ravel() for g in g_filters], back.sum(axis=0), err @ pooled + 1e-5 * m.weight, [err.sum()]]).astype(np.float32)
    state.squares += grad * grad
    state.set_dense(state.dense() - RATE * grad / (np.sqrt(state.squares) + 1e-6))


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(values[order], starts, axis=0)


def show(state: State, table: np.ndarray, docs: list[np.ndarray], labels: np.ndarray, rng: np.random.Generator) -> None:
    """Take the state through some rows, in random order and with a part of their words."""
    order = rng.permutation(len(docs))
    for lo in range(0, len(order), BATCH):
        part = order[lo : lo + BATCH]
        _step(state, table, [docs[d][rng.random(len(docs[d])) < KEEP] for d in part], labels[part])


class _Scorer:
    """Scores of texts told by word numbers; each word's embeddings are summed up once."""

    def __init__(self, model: Model) -> None:
        self.model, self.words, self.table, self.vectors = model, None, None, None

    def __call__(self, words: _Words, docs: list[np.ndarray]) -> np.ndarray:
        if words is not self.words:
            self.words, self.table, self.vectors = words, None, np.zeros((0, DIM), np.float32)
        if self.table is None or len(self.table) < len(words):
            self.table = words.table()
            new = self.model.embedding[self.table[len(self.vectors):]].sum(axis=1)
            self.vectors = np.concatenate([self.vectors, new])
        found = [np.zeros(0)]
        for lo in range(0, len(docs), BATCH):
            found.append(_probability(self.model, _forward(self.model, self.table, docs[lo : lo + BATCH], self.vectors)[1]))
        return np.concatenate(found)


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = 5, passes: int = 40) -> Model:
    """A model of texts at hand, all of them shown ``passes`` times. Their languages play no part:
    thresholds are calibrated by :func:`fit_toxicity`."""
    rng = np.random.default_rng(seed)
    state, words = begin(float(labels.mean()), seed), _Words()
    docs = [words.numbers(t) for t in texts]
    for _ in range(passes):
        show(state, words.table(), docs, labels, rng)
    return state.model


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[_Words, list[np.ndarray], np.ndarray, np.ndarray, list[str | None]]]:
    """Rows of the written table as (words, texts as word numbers, labels, held back, languages),
    so many at a time."""
    words, held, count, size = _Words(), [], 0, 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            count, size = count + batch.num_rows, size + batch.nbytes
        if not count or (batch is not None and count < BLOCK_ROWS and size < BLOCK_BYTES):
            continue
        t = pa.Table.from_batches(held)
        words = words if len(words) < WORDS_HELD else _Words()
        docs = [words.numbers(x or "") for x in t.column("text").to_pylist()]
        yield words, docs, t.column("toxic").to_numpy().astype(float), t.column("held").to_numpy(), t.column("lang").to_pylist()
        held, count, size = [], 0, 0


def _round(rows: DataFrame, state: State, number: int, seed: int, passes: int) -> tuple[State, float]:
    """The state after a round over ``rows``, and the mean loss of the state before on those held back."""
    sc = rows.sparkSession.sparkContext
    sent = sc.broadcast(state)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, part = sent.value, TaskContext.get().partitionId()
        now = pickle.loads(pickle.dumps(before))
        rng = np.random.default_rng([seed, number, part])
        loss = n_held = n_shown = 0
        scored = _Scorer(before.model)
        for words, docs, labels, held, _ in _blocks(batches):
            p = np.clip(scored(words, [d for d, h in zip(docs, held) if h]), 1e-6, 1 - 1e-6)
            loss -= float(np.log(np.where(labels[held] == 1, p, 1 - p)).sum())
            n_held += int(held.sum())
            docs, labels, table = [d for d, h in zip(docs, held) if not h], labels[~held], words.table()
            n_shown += len(docs)
            for _ in range(passes):
                show(now, table, docs, labels, rng)
        if not n_held and not n_shown:
            return
        made = [(-1, pickle.dumps((now.dense(), now.squares, n_shown, loss, n_held)))]
        touched = np.flatnonzero(now.bucket_squares != before.bucket_squares)
        for chunk in np.unique(touched // CHUNK):
            where = touched[touched // CHUNK == chunk]
            made.append((int(chunk), pickle.dumps((where, now.model.embedding[where], now.bucket_squares[where]))))
        for chunk, data in made:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], names=["chunk", "part", "data"])

    def average(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, None
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if chunk != last:
                    if sums is not None:
                        yield averaged(last, sums)
                    last, sums = chunk, None
                sums = _added(sums, chunk, pickle.loads(data))
        if sums is not None:
            yield averaged(last, sums)

    def averaged(chunk: int, sums: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([pickle.dumps(sums)], pa.binary())], names=["chunk", "data"])

    made = rows.mapInArrow(fit, "chunk int, part int, data binary")
    dealt = made.repartition(min(BUCKETS // CHUNK + 1, sc.defaultParallelism), "chunk").sortWithinPartitions("chunk", "part")
    with batches_of(rows.sparkSession, 2 * BATCH):
        found = dealt.mapInArrow(average, "chunk int, data binary").collect()
    sent.destroy()
    after, loss = pickle.loads(pickle.dumps(state)), 0.0
    for r in found:
        sums = pickle.loads(bytes(r["data"]))
        if r["chunk"] < 0:
            dense, squares, n, loss, n_held = sums
            if n:
                after.set_dense((dense / n).astype(np.float32))
                after.squares = (squares / n).astype(np.float32)
            loss = loss / n_held if n_held else 0.0
        else:
            parts, embedding, squares = sums
            at = np.flatnonzero(parts)
            after.model.embedding[r["chunk"] * CHUNK + at] = (embedding[at] / parts[at, None]).astype(np.float32)
            after.bucket_squares[r["chunk"] * CHUNK + at] = (squares[at] / parts[at]).astype(np.float32)
    return after, loss


def _added(sums: list | None, chunk: int, found: tuple) -> list:
    """Sums over tasks: dense weights by the rows a task was shown; a bucket counts for each task
    that met it."""
    if chunk < 0:
        dense, squares, n, loss, n_held = found
        made = [dense.astype(float) * n, squares.astype(float) * n, n, loss, n_held]
        return made if sums is None else [a + b for a, b in zip(sums, made)]
    where, embedding, squares = found
    sums = sums or [np.zeros(CHUNK, np.int64), np.zeros((CHUNK, DIM)), np.zeros(CHUNK)]
    for total, value in zip(sums, (1, embedding, squares)):
        total[where - chunk * CHUNK] += value
    return sums


def calibrated(scored: DataFrame, least: int = 8) -> dict[str, float]:
    """Per language the score between its classes, of rows with ``lang``, ``toxic`` and ``score``: the
    threshold of the best F1, in the middle of the gap it lies in, between 0.25 and 0.9. Languages
    with fewer than ``least`` rows of a class keep 0.5. All rows are counted, scores in ``BINS`` bins."""
    bins = scored.filter(F.col("lang").isNotNull()).groupBy("lang", F.floor(F.col("score") * BINS).alias("bin")).agg(
        F.count("*").alias("n"), F.sum("toxic").alias("hits"), F.min("score").alias("low"), F.max("score").alias("high"),
    )
    down = Window.partitionBy("lang").orderBy(F.desc("bin"))
    upto, whole = down.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("lang")
    tried = bins.select(
        "lang", "bin", (2 * F.sum("hits").over(upto) / (F.sum("n").over(upto) + F.sum("hits").over(whole))).alias("f1"),
        ((F.col("low") + F.coalesce(F.lead("high").over(down), F.lit(0.0))) / 2).alias("threshold"),
        F.sum("hits").over(whole).alias("ones"), (F.sum("n").over(whole) - F.sum("hits").over(whole)).alias("zeros"),
    ).filter((F.col("ones") >= least) & (F.col("zeros") >= least))
    best = tried.groupBy("lang").agg(F.max_by("threshold", F.struct("f1", "bin")).alias("threshold"))
    return {r["lang"]: float(np.clip(r["threshold"], 0.25, 0.9)) for r in best.collect()}


def labelled_rows(docs: DataFrame, labels: DataFrame, seed: int = 5) -> DataFrame:
    """``h`` (a hash), ``text``, ``toxic``, ``lang`` and ``held`` (a fifth, held back) of every labelled
    row whose crc32(doc_id as text) mod 5 is not 0. Labels other than 0 and 1 and repeated labels of a
    document that disagree (the larger counts) are settled before, and of rows with one doc_id the
    text of smallest hash is taken. Rows are dealt by doc_id to tasks of about ``FILE_ROWS`` rows and
    sorted by ``h``.

    A filter of the labelled ids goes to the tasks, so that texts without a label stay where they
    are, and the others are shuffled once; the join decides."""
    own = F.col("doc_id").try_cast(docs.schema["doc_id"].dataType)
    known = labels.filter(F.col("toxic").isin(0, 1)).select(own.alias("doc_id"), "toxic").filter("doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = written(known.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0), "known-labels")
    n = known.count()
    sent = docs.sparkSession.sparkContext.broadcast(filter_bits(known.select(F.xxhash64("doc_id").alias("id")), "id", n))

    @F.arrow_udf("boolean")
    def may_be_known(ids: pa.Array) -> pa.Array:
        return pa.array(among(sent.value, ids.to_numpy(zero_copy_only=False).view(np.uint64)))

    files = max(1, -(-n // FILE_ROWS))
    one = F.min(F.struct(F.xxhash64("text", "lang"), "text", "lang")).alias("one")
    found = docs.select("doc_id", "text", "lang").filter(may_be_known(F.xxhash64("doc_id"))).repartition(files, "doc_id")
    rows = found.join(known.repartition(files, "doc_id"), "doc_id").groupBy("doc_id", "toxic").agg(one)
    h = F.xxhash64(F.lit(seed), "doc_id")
    return rows.select(
        h.alias("h"), "one.text", "toxic", "one.lang", (F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(5)) == 0).alias("held"),
    ).sortWithinPartitions("h")


def fit_toxicity(docs: DataFrame, labels: DataFrame, seed: int = 5) -> Model:
    """Fit on all :func:`labelled_rows`, in rounds (see above): two, or up to eight where rows are
    few, fewer if two in a row brought nothing. Which rows share a task follows the written files
    and the cores.
    With no labels at all the model gives every text the score ``UNKNOWN``, which rejects none."""
    spark = docs.sparkSession
    rows = written(labelled_rows(docs, labels, seed), "labelled")
    n, share = rows.filter("not held").agg(F.count("*"), F.avg("toxic")).first()
    state = begin(share or 0.0, seed)
    if not n:  # nothing is known of any text, so none is called toxic
        state.model.weight[:], state.model.offset = 0, float(np.log(UNKNOWN / (1 - UNKNOWN)))
        drop_written(rows)
        return state.model
    passes = max(2, min(8, VISITS // (MOST_ROUNDS * n)))
    rounds = max(LEAST_ROUNDS, min(MOST_ROUNDS, -(-VISITS // (passes * n))))
    best, since = (np.inf, state), 0
    for number in range(rounds + 1):  # the last is for the loss of the one before
        last = number == rounds
        after, loss = _round(rows.filter("held") if last else rows, state, number, seed, 0 if last else passes)
        if number and loss > best[0] - 1e-4:
            since += 1
        if number and (loss < best[0] - 1e-4 or not loss):
            best, since = (loss, state), 0
        if since == 2:
            break
        state = after
    m = best[1].model
    sent = spark.sparkContext.broadcast(m)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _Scorer(sent.value)
        for words, texts, toxic, _, langs in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(toxic.astype(np.int64)), pa.array(scored(words, texts))], names=["lang", "toxic", "score"])

    with batches_of(spark, 2 * BATCH):
        m.thresholds = calibrated(rows.filter("held").mapInArrow(score, "lang string, toxic long, score double"))
    sent.destroy()
    drop_written(rows)
    return m


def with_toxicity(df: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``df`` with the column ``score`` of its ``text`` (replaced if there); map-only. Null and
    empty texts have no words and get the score of the logistic layer's bias."""
    picked = df.drop(score)
    at = picked.columns.index("text")
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored, words = _Scorer(sent.value), _Words()
        for batch in batches:
            found = [np.zeros(0)]
            for lo in range(0, batch.num_rows, SCORED_ROWS):
                words = words if len(words) < WORDS_HELD else _Words()
                found.append(scored(words, [words.numbers(t or "") for t in batch.column(at).slice(lo, SCORED_ROWS).to_pylist()]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(found))], names=[*batch.schema.names, score])

    return picked.mapInArrow(run, extended(picked.schema, (score, "double")))


def threshold_column(model: Model, lang: str = "lang"):
    """Threshold of the row's language, 0.5 for null and for languages that have none."""
    out = F.lit(0.5)
    for name, value in sorted(model.thresholds.items()):
        out = F.when(F.col(lang) == name, F.lit(value)).otherwise(out)
    return F.coalesce(out, F.lit(0.5))


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.5), threshold of the language and whether
    the document is rejected (score >= threshold), for every row of ``docs``.

    Languages beyond the list of the sample, nulls, empty and very long texts, repeated rows and
    empty tables all have a defined score; columns other than doc_id, text and lang play no part.
    """
    model = fit_toxicity(docs, labels)
    scored = with_toxicity(docs.select("doc_id", "lang", "text"), model)
    return scored.select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), threshold_column(model).alias("threshold"), (F.col("score") >= threshold_column(model)).alias("rejected"),
    )
