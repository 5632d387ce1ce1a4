"""Document likelihood under a subword lattice.

The pieces of an existing tokenizer's vocabulary span a lattice over each word: every way of
cutting the word into pieces is a path. A forward recursion in log space adds up the paths,
so a word's probability is the sum over all its segmentations. The vocabulary's own scores
weigh the pieces first; two rounds of expected counts over the words of the training texts
then fit the weights. Words of the training texts are a further level: their discounted
frequency comes first, and the mass discounted from them is spread by the lattice over all
words, so that the model is a proper distribution over word sequences.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ecolake.llm.common import extended, mixed, task_number, utf8, words, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"  # what the vocabulary writes before a word
DISCOUNT = 0.75
HEAD_WORDS = 250_000  # most frequent words that every scoring task holds
PRIOR_PIECES = 2_000.0  # weight of the vocabulary's own scores, in pieces
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_TABLE_BITS = 20
WORDS_AT_ONCE, WORD_BYTES = 60_000, 8 << 20  # that a task cuts into pieces
LEAST_LOG = -600.0  # of a probability that is summed as it is


@dataclass
class Lattice:
    """Pieces by hash. ``first`` begin a word, ``inner`` follow; a byte is an inner piece too."""

    hashes: list[np.ndarray]  # sorted, of first and inner pieces
    ids: list[np.ndarray]
    longest: list[int]
    byte_ids: np.ndarray
    bare: int  # the piece that is only the start of a word
    log_p: np.ndarray  # natural logarithm by piece
    log_stop: float
    log_go: float
    starts: list[np.ndarray]  # hashes of all beginnings of first and of inner pieces, whole ones too

    def tables(self) -> list[np.ndarray]:
        """By the first bits of a hash: 1 if a piece may begin so, 2 more if it may be one."""
        out = []
        for h, starts in zip(self.hashes, self.starts):
            t = np.zeros(1 << _TABLE_BITS, np.uint8)
            t[starts >> np.uint64(64 - _TABLE_BITS)] = 1
            t[h >> np.uint64(64 - _TABLE_BITS)] = 3
            out.append(t)
        return out


def _hash(points: np.ndarray) -> np.ndarray:
    """Hash of each row of code points."""
    h = np.full(len(points), 7, np.uint64)
    for k in range(points.shape[1]):
        h = h * _FACTOR + points[:, k].astype(np.uint64) + np.uint64(1)
    return mixed(h)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def vocabulary_lattice(path: str = VOCABULARY) -> Lattice:
    """The lattice of a sentencepiece model and its own scores. Unigram scores are logarithms of
    probabilities; the scores of merges are ranks, of which Zipf's law makes probabilities."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    scores = np.array([model.get_score(k) for k in range(n)])
    if (scores == np.round(scores)).all():
        scores = -np.log(10.0 - scores)
    byte_ids, groups, bare = np.full(256, -1), ([], []), -1
    for k in range(n):
        piece = model.id_to_piece(k)
        if model.is_byte(k):
            byte_ids[int(piece[1:-1], 16)] = k
        elif piece == START:
            bare = k
        elif not (model.is_control(k) or model.is_unknown(k) or model.is_unused(k)):
            body = piece.removeprefix(START)
            if body and START not in body:
                groups[0 if piece.startswith(START) else 1].append((body, k))
    extra = int((byte_ids < 0).sum())  # a vocabulary without bytes or bare start gets them
    byte_ids[byte_ids < 0] = n + np.arange(extra)
    if bare < 0:
        bare = n + extra
    scores = np.concatenate([scores, np.full(n + extra + 1 - n, scores.min())])
    hashes, ids, longest, starts = [], [], [], []
    for group in groups:
        h, k, begun = [], [], [np.zeros(0, np.uint64)]
        for length in sorted({len(b) for b, _ in group}):
            same = [(b, i) for b, i in group if len(b) == length]
            points = np.stack([_points(b) for b, _ in same])
            h.append(_hash(points))
            begun += [_hash(points[:, :size]) for size in range(1, length + 1)]
            k += [i for _, i in same]
        h, k = np.concatenate(h) if h else np.zeros(0, np.uint64), np.array(k, np.int64)
        order = np.argsort(h)
        hashes.append(h[order]), ids.append(k[order]), longest.append(max((len(b) for b, _ in group), default=1)), starts.append(np.unique(np.concatenate(begun)))
    lattice = Lattice(hashes, ids, longest, byte_ids, bare, scores, np.log(0.3), np.log(0.7), starts)
    lattice.log_p = _normalised(lattice, np.exp(scores - scores.max()))
    return lattice


def _normalised(lattice: Lattice, weight: np.ndarray) -> np.ndarray:
    """Logarithms of the weights, adding up to one among first and among inner pieces."""
    out = np.full(len(weight), -np.inf)
    first = np.r_[lattice.ids[0], lattice.bare]
    inner = np.unique(np.r_[lattice.ids[1], lattice.byte_ids])
    for at in (first, inner):
        out[at] = np.log(weight[at] / weight[at].sum())
    return out


def _edges(lattice: Lattice, tables: list[np.ndarray], points: np.ndarray, kind: int, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, words, pieces) of the pieces that start at position ``i``. ``points`` has a row per
    position; words are followed as long as a piece may begin like them."""
    rows, h = np.arange(points.shape[1]), np.full(points.shape[1], 7, np.uint64)
    for length in range(1, min(lattice.longest[kind], len(points) - i) + 1):
        at = points[i + length - 1]
        h = h * _FACTOR + (at if len(rows) == len(at) else at[rows]) + np.uint64(1)
        full = mixed(h)
        found = tables[kind][full >> np.uint64(64 - _TABLE_BITS)]
        maybe = np.flatnonzero(found == 3)
        if len(maybe):
            wanted = full[maybe]
            at = np.minimum(np.searchsorted(lattice.hashes[kind], wanted), len(lattice.hashes[kind]) - 1)
            hit = lattice.hashes[kind][at] == wanted
            if hit.any():
                yield length, rows[maybe[hit]], lattice.ids[kind][at[hit]]
        left = np.flatnonzero(found)
        if not len(left):
            return
        if len(left) < len(rows):
            rows, h = rows[left], h[left]


def _byte_log_p(lattice: Lattice, points: np.ndarray) -> np.ndarray:
    """Log probability of each character spelt by bytes, with a step between its bytes."""
    value = np.zeros(int(points.max(initial=0)) + 1)
    for c in np.flatnonzero(np.bincount(points.ravel())):
        spelt = lattice.byte_ids[list(chr(int(c)).encode("utf-8", "surrogatepass"))]
        value[c] = lattice.log_p[spelt].sum() + (len(spelt) - 1) * lattice.log_go
    return value[points]


def forward(lattice: Lattice, tables: list[np.ndarray], points: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Natural logarithm of the probability of words of equal length, one per row of code points,
    summed over all segmentations. With ``counts`` (by piece) the expected uses of each piece are
    added to it from a backward recursion.

    Sums are taken of probabilities, and of their logarithms where a word's could come near the
    smallest numbers: being spelt by bytes is one of the segmentations, so no sum is below that."""
    byte_p = _byte_log_p(lattice, points)
    least = byte_p.sum(axis=1) + points.shape[1] * lattice.log_go + lattice.log_p[lattice.bare] + lattice.log_stop
    total = np.empty(len(points))
    for rows, summed in ((least > LEAST_LOG, _summed_plain), (least <= LEAST_LOG, _summed_logs)):
        if rows.all():
            return summed(lattice, tables, points, byte_p, counts)
        if rows.any():
            total[rows] = summed(lattice, tables, points[rows], byte_p[rows], counts)
    return total


def _summed_plain(lattice: Lattice, tables: list[np.ndarray], points: np.ndarray, byte_p: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """:func:`forward` of words whose probabilities are far from the smallest numbers."""
    n, length = points.shape
    p, go, spelt = np.exp(lattice.log_p), np.exp(lattice.log_go), np.exp(byte_p.T)
    alpha, across = np.zeros((length + 1, n)), np.ascontiguousarray(points.T, np.uint64)
    kept: list[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]] = [[] for _ in range(length + 1)]  # by position, the first pieces last
    for size, rows, pieces in _edges(lattice, tables, across, 0, 0):
        alpha[size, rows] += p[pieces]
        if counts is not None:
            kept[-1].append((size, rows, pieces, p[pieces]))
    alpha[0] = p[lattice.bare]
    for i in range(length):
        step = alpha[i] * go
        alpha[i + 1] += step * spelt[i]
        for size, rows, pieces in _edges(lattice, tables, across, 1, i):
            own = p[pieces]
            alpha[i + size, rows] += step[rows] * own
            if counts is not None:
                kept[i].append((size, rows, pieces, own * go))
    stop = np.exp(lattice.log_stop)
    total = alpha[length] * stop
    if counts is not None:
        beta = np.zeros((length + 1, n))
        beta[length] = stop / total
        for i in range(length - 1, -1, -1):
            spelt[i] *= go * beta[i + 1]
            beta[i] = spelt[i]
            for size, rows, pieces, own in kept[i]:
                after = own * beta[i + size, rows]
                beta[i, rows] += after
                counts += np.bincount(pieces, alpha[i, rows] * after, len(counts))
        for size, rows, pieces, own in kept[-1]:
            counts += np.bincount(pieces, own * beta[size, rows], len(counts))
        counts[lattice.bare] += (p[lattice.bare] * beta[0]).sum()
        _count_bytes(lattice, points, (alpha[:length] * spelt).T, counts)
    return np.log(total)


def _count_bytes(lattice: Lattice, points: np.ndarray, used: np.ndarray, counts: np.ndarray) -> None:
    """Add the uses of each place's character, spelt by bytes, to the counts of the bytes."""
    uses = np.bincount(points.ravel(), used.ravel())
    for c in np.flatnonzero(uses):
        for b in chr(int(c)).encode("utf-8", "surrogatepass"):
            counts[lattice.byte_ids[b]] += uses[c]


def _summed_logs(lattice: Lattice, tables: list[np.ndarray], points: np.ndarray, byte_p: np.ndarray, counts: np.ndarray | None) -> np.ndarray:
    """:func:`forward` of any words, in logarithms."""
    n, length = points.shape
    alpha, across = np.full((length + 1, n), -np.inf), np.ascontiguousarray(points.T, np.uint64)
    kept: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    for size, rows, pieces in _edges(lattice, tables, across, 0, 0):
        alpha[size, rows] = np.logaddexp(alpha[size, rows], lattice.log_p[pieces])
        if counts is not None:
            kept.append((-1, size, rows, pieces))
    alpha[0] = lattice.log_p[lattice.bare]
    for i in range(length):
        step = alpha[i] + lattice.log_go
        alpha[i + 1] = np.logaddexp(alpha[i + 1], step + byte_p[:, i])
        for size, rows, pieces in _edges(lattice, tables, across, 1, i):
            alpha[i + size, rows] = np.logaddexp(alpha[i + size, rows], step[rows] + lattice.log_p[pieces])
            if counts is not None:
                kept.append((i, size, rows, pieces))
    total = alpha[length] + lattice.log_stop
    if counts is not None:
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = lattice.log_stop
        for i in range(length - 1, -1, -1):
            beta[i] = lattice.log_go + byte_p[:, i] + beta[i + 1]
            for at, size, rows, pieces in kept:
                if at == i:
                    beta[i, rows] = np.logaddexp(beta[i, rows], lattice.log_go + lattice.log_p[pieces] + beta[i + size, rows])
        for at, size, rows, pieces in kept:
            before = 0.0 if at < 0 else alpha[at, rows] + lattice.log_go
            counts += np.bincount(pieces, np.exp(before + lattice.log_p[pieces] + beta[max(at, 0) + size, rows] - total[rows]), len(counts))
        counts[lattice.bare] += np.exp(lattice.log_p[lattice.bare] + beta[0] - total).sum()
        used = np.exp(alpha[:length].T + lattice.log_go + byte_p + beta[1:].T - total[:, None])
        _count_bytes(lattice, points, used, counts)
    return total


def by_length(texts: list[str], most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers, code points) of texts of equal length, some characters at a time."""
    lengths = np.array([len(t) for t in texts])
    order = np.argsort(lengths, kind="stable")
    lo = 0
    while lo < len(order):
        size = lengths[order[lo]]
        hi = min(int(np.searchsorted(lengths[order], size, "right")), lo + max(1, most // max(1, int(size))))
        at = order[lo:hi]
        yield at, _points("".join(texts[k] for k in at)).reshape(len(at), size)
        lo = hi


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of words joined to ``WORDS_AT_ONCE`` rows or ``WORD_BYTES``, so that words of equal
    length are many."""
    held, count, size = [], 0, 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append(batch)
            count, size = count + batch.num_rows, size + batch.nbytes
        if held and (batch is None or count >= WORDS_AT_ONCE or size >= WORD_BYTES):
            yield pa.concat_batches(held)
            held, count, size = [], 0, 0


def word_table(docs: DataFrame, train: str = "train") -> DataFrame:
    """(word, c, n): uses of each word in rows where ``train`` holds, and in all. Tasks count
    before the shuffle and hand on what they have whenever it comes to 200,000 words."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for counts in _counted(batches):
            keys = sorted(counts[0].keys() | counts[1].keys())
            c = np.fromiter((counts[1][k] for k in keys), np.int64, len(keys))
            n = c + np.fromiter((counts[0][k] for k in keys), np.int64, len(keys))
            for lo in range(0, len(keys), 20_000):
                part = slice(lo, lo + 20_000)
                yield pa.RecordBatch.from_arrays([pa.array(keys[part], pa.binary()).cast(pa.string()), pa.array(c[part]), pa.array(n[part])], names=["word", "c", "n"])

    def _counted(batches):
        counts = (Counter(), Counter())
        for batch in batches:
            for t, in_train in zip(utf8(batch.column(0)), batch.column(1).to_pylist()):
                counts[bool(in_train)].update(words(t))
                if len(counts[0]) + len(counts[1]) > 200_000:
                    yield counts
                    counts = (Counter(), Counter())
        yield counts

    return docs.select("text", train).mapInArrow(count, "word string, c long, n long").groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def fit_lattice(lattice: Lattice, vocabulary: DataFrame, rounds: int = 2) -> Lattice:
    """Weights from ``rounds`` rounds of expected piece counts over the words of ``vocabulary``
    (word), each word once; the vocabulary's own scores count as ``PRIOR_PIECES`` pieces. Tasks
    return one number per piece that they met."""
    spark = vocabulary.sparkSession
    prior = np.where(np.isfinite(lattice.log_p), np.exp(lattice.log_p), 0)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            tables, counts, n = own.tables(), np.zeros(len(own.log_p)), 0
            for batch in _gathered(batches):
                texts = batch.column(0).to_pylist()
                n += len(texts)
                for _, points in by_length(texts):
                    forward(own, tables, points, counts)
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1]), pa.array(np.r_[counts[at], float(n)])], names=["piece", "uses"])

        found = vocabulary.select("word").mapInArrow(expect, "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect()
        weight = np.zeros(len(lattice.log_p))
        n_words = 0.0
        for r in found:
            if r["piece"] < 0:
                n_words = r["uses"]
            else:
                weight[r["piece"]] = r["uses"]
        pieces = weight.sum()
        stop = (n_words + 30) / (pieces + 100) if pieces else 0.3
        lattice = Lattice(lattice.hashes, lattice.ids, lattice.longest, lattice.byte_ids, lattice.bare, lattice.log_p, float(np.log(stop)), float(np.log1p(-stop)), lattice.starts)
        lattice.log_p = _normalised(lattice, weight + PRIOR_PIECES * prior + 1e-3)
    return lattice


def lattice_scores(df: DataFrame, lattice: Lattice, column: str = "lattice") -> DataFrame:
    """``df`` with the log10 probability of its ``word`` under the lattice; map-only."""
    sent = df.sparkSession.sparkContext.broadcast(lattice)
    at = df.columns.index("word")

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        tables = own.tables()
        for batch in _gathered(batches):
            texts = batch.column(at).to_pylist()
            out = np.zeros(len(texts))
            for rows, points in by_length(texts):
                out[rows] = forward(own, tables, points) / np.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, column])

    return df.mapInArrow(score, extended(df.schema, (column, "double")))


class _Places(dict):
    """Numbers of the words that every task holds, -1 of all others."""

    def __missing__(self, word: bytes) -> int:
        return -1


def document_scores(docs: DataFrame, vocabulary: str = VOCABULARY, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    Rows whose crc32(doc_id as text) mod 5 is 1 are held out, all others (null ids too) are
    learnt from. A text is its words and one end. Null and empty texts are one end; a very long
    word is scored whole. Repeated rows each count, other columns play no part; without any row
    to learn from, the vocabulary's own scores and the smoothing terms are left.

    The ``head_words`` most frequent words go to every task. All other words of a document, known
    or not, are joined to their scores by word, so no word is left out at any size.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    picked = docs.select("doc_id", held.alias("held_out"), "text")
    counted = written(word_table(picked.withColumn("train", ~F.col("held_out"))), "words")
    n_docs = picked.filter(~F.col("held_out")).count()
    sums = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.coalesce(F.sum((F.col("c") > 0).cast("long")), F.lit(0))).first()
    in_words, types = int(sums[0]), int(sums[1])
    n_train, n_types = in_words + n_docs, types + (1 if n_docs else 0)
    lattice = fit_lattice(vocabulary_lattice(vocabulary), counted.filter("c > 0")) if types else vocabulary_lattice(vocabulary)

    end_p = (n_docs + 0.5) / (n_train + 1.0)
    below = n_train + 0.5 * (n_types + 1)
    base_of = lambda c: (F.log10((c + 0.5) / F.lit(below)) if below else F.lit(0.0))
    spread = DISCOUNT * types / in_words if in_words else 1.0
    own = (F.greatest(F.col("c") - DISCOUNT, F.lit(0.0)) / F.lit(float(in_words))) if in_words else F.lit(0.0)
    own = own * F.lit(1 - end_p)
    by_lattice = F.col("lattice") + F.lit(float(np.log10((1 - end_p) * spread)))
    top = F.greatest(F.log10(F.nullif(own, F.lit(0.0))), by_lattice)  # null if the word is new
    score = F.when(own > 0, top + F.log10(F.pow(10.0, F.log10(own) - top) + F.pow(10.0, by_lattice - top))).otherwise(by_lattice)
    scored = written(lattice_scores(counted, lattice).select("word", "n", (F.col("c") > 0).alias("known"), base_of(F.col("c")).alias("base"), score.alias("score")), "scores")

    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted((r["step"], r["count"]) for r in scored.groupBy(step.alias("step")).count().collect())
    least, room = (sizes[-1][0] + 1 if sizes else 0), head_words
    for s, k in reversed(sizes):
        if k > room:
            break
        least, room = s, room - k
    head = scored.filter(step >= least).select(F.col("word").cast("binary").alias("word"), "known", "base", "score").toArrow()
    end = (float(np.log10((n_docs + 0.5) / below)) if below else 0.0, float(np.log10(end_p)))
    sent = picked.sparkSession.sparkContext.broadcast((head.column("word").to_pylist(), *(head.column(k).to_numpy() for k in ("known", "base", "score")), end, n_docs > 0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, base, score, end, end_known = sent.value
        place = _Places((w, k) for k, w in enumerate(names))
        known, base, score = np.r_[known, False], np.r_[base, 0.0], np.r_[score, 0.0]
        row = task_number()
        for batch in batches:
            ids, tokens, sums_known, sums_base, sums_score = [], [], [], [], []
            tail_row, tail_word, tail_uses = [], [], []
            for t in utf8(batch.column(2)):
                own = words(t)
                uses = Counter(own)
                at = np.fromiter(map(place.__getitem__, uses), np.int64, len(uses))
                k = np.fromiter(uses.values(), np.int64, len(uses))
                ids.append(row), tokens.append(len(own) + 1)
                sums_known.append(int((k * known[at]).sum()) + end_known), sums_base.append(float((k * base[at]).sum()) + end[0]), sums_score.append(float((k * score[at]).sum()) + end[1])
                if (rest := at < 0).any():
                    own = list(itertools.compress(uses, rest.tolist()))
                    tail_row += [row] * len(own)
                    tail_word += own
                    tail_uses += map(uses.__getitem__, own)
                row += 1
            n, m = len(ids), len(tail_row)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids + tail_row, pa.int64()), pa.concat_arrays([batch.column(0), pa.nulls(m, batch.column(0).type)]), pa.concat_arrays([batch.column(1), pa.nulls(m, pa.bool_())]),
                    pa.array([None] * n + tail_word, pa.binary()).cast(pa.string()), pa.array([None] * n + tail_uses, pa.int64()), pa.array(tokens + [None] * m, pa.int64()),
                    pa.array(sums_known + [None] * m, pa.int64()), pa.array(sums_base + [None] * m, pa.float64()), pa.array(sums_score + [None] * m, pa.float64()),
                ],
                names=["row_id", "doc_id", "held_out", "word", "uses", "n_tokens", "n_known", "base_score", "score"],
            )

    kind = picked.schema["doc_id"].dataType.simpleString()
    parts = written(picked.mapInArrow(run, f"row_id long, doc_id {kind}, held_out boolean, word string, uses long, n_tokens long, n_known long, base_score double, score double"), "scored")
    tail = parts.filter("word is not null").select("row_id", "word", "uses").join(scored.filter(step < least).select("word", "known", "base", F.col("score").alias("s")), "word")
    tail = tail.groupBy("row_id").agg(F.sum(F.when(F.col("known"), F.col("uses")).otherwise(0)).alias("k"), F.sum(F.col("uses") * F.col("base")).alias("b"), F.sum(F.col("uses") * F.col("s")).alias("s"))
    return parts.filter("word is null").join(tail, "row_id", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("b", F.lit(0.0))).alias("base_score"), (F.col("score") + F.coalesce("s", F.lit(0.0))).alias("score"),
    )
