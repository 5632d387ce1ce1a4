"""Collocations mined from vertically partitioned suffix trees.

The text is a sequence of words, cut into pieces. A phrase's occurrences are the leaves below its
node in the suffix tree, and as phrases have ``WORDS`` words at most, the tree is truncated at
that depth. It is never built whole: prefixes are counted round by round, a prefix that occurs
less often than the threshold is given up, one with more rows than the memory budget is extended
by a word, and the prefixes that are left are dealt into groups of about the budget. Each group's
subtrees are built independently from its sorted suffixes, and the frequency of a node is the
total of its leaves.

Words travel as 64-bit numbers, hashed from language and word. All distinct words are checked for
equal numbers, and hashed anew if two are found, so counts are exact.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ecolake.llm.common import among, drop_written, filter_bits, mixed, utf8, written

WORDS = 5  # words of the longest phrase, and depth of the trees
BUDGET = 1 << 18  # suffix rows of a group
HELD = 1 << 18  # words whose suffixes a task counts at once

_CUT = bytes.maketrans(b".,;:!?\x0b\x0c\r" + bytes(range(65, 91)), b"\n" * 9 + bytes(range(97, 123)))
_NAMES = [f"w{k}" for k in range(WORDS)]
_SCHEMA = ", ".join(f"{c} long" for c in _NAMES)


def pieces(text: bytes) -> list[list[bytes]]:
    """Words of every piece: A-Z in lower case, pieces end at ``[.,;:!?\\x0A-\\x0D]``, words at
    blanks and tabs."""
    return [p.split() for p in text.translate(_CUT).split(b"\n")]


class _Numbers(dict):
    """Number of a word: its hash, seeded by language. Zero is kept for the end of a piece."""

    def __init__(self, lang: str, seed: int):
        self.seed = xxhash.xxh64_intdigest(lang, seed)

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, self.seed) or 1
        return h


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, bytes]]:
    yield from zip(batch.column(0).to_pylist(), utf8(batch.column(1)))


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(lang, word, id, n) of every distinct word of every language, counted in the tasks first."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}

        def flushed() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                words = list(counts)
                numbers = _Numbers(lang, seed)
                ids = np.array([numbers[w] for w in words], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(words, pa.binary()), pa.array(ids), pa.array(list(counts.values()), pa.int64())], names=["lang", "word", "id", "n"])
            held.clear()

        for batch in batches:
            for lang, text in _by_language(batch):
                counts = held.setdefault(lang, {})
                for w in itertools.chain.from_iterable(pieces(text)):
                    counts[w] = counts.get(w, 0) + 1
            if sum(map(len, held.values())) > 300_000:
                yield from flushed()
        yield from flushed()

    made = _texts(docs).mapInArrow(run, "lang string, word binary, id long, n long")
    return made.groupBy("lang", "word", "id").agg(F.sum("n").alias("n"))


def pair_number(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit number of two words in a row, for filters only."""
    return mixed(mixed(a) + b)


def _counted_pairs(ids: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pairs of frequent words in a row, and how often they occur in ``ids``."""
    ok = (ids != 0) & among(frequent, ids)
    at = np.flatnonzero(ok[:-1] & ok[1:])
    return _counted(np.stack([ids[at], ids[at + 1]], axis=1))


def _counted_suffixes(ids: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct suffixes of up to ``WORDS`` words, as far as their pairs may be frequent, that have
    three words at least, and how often they occur in ``ids``."""
    ids = np.r_[ids, np.zeros(WORDS, np.uint64)]
    link = np.zeros(len(ids), np.int64)
    link[:-1] = (ids[:-1] != 0) & (ids[1:] != 0) & among(pairs, pair_number(ids[:-1], ids[1:]))
    reach, rows = link.copy(), np.zeros((len(ids), WORDS), np.uint64)
    rows[:, 0] = ids
    for d in range(1, WORDS):
        rows[: len(ids) - d, d] = np.where(reach[: len(ids) - d] > 0, ids[d:], 0)
        reach[: len(ids) - d] &= link[d:]
        reach[len(ids) - d :] = 0
    return _counted(rows[rows[:, 2] != 0])


def _counted(rows: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows and their numbers, column by column."""
    if not len(rows):
        return (*rows.T, np.zeros(0, np.int64))
    rows = rows[np.lexsort(rows.T[::-1])]
    at = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)])
    return (*rows[at].T, np.diff(np.r_[at, len(rows)]))


def counted_runs(docs: DataFrame, seed: int, count: Callable[[np.ndarray], tuple[np.ndarray, ...]], names: list[str]) -> DataFrame:
    """``count`` over the words of all texts, as numbers with a zero after every piece, some
    ``HELD`` words at once; a text is never cut between two calls within a piece."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[str, _Numbers] = {}
        held: list[int] = []

        def flushed() -> pa.RecordBatch:
            columns = count(np.array(held, np.uint64))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=[*names, "n"])

        for batch in batches:
            for lang, text in _by_language(batch):
                known = numbers.get(lang) or numbers.setdefault(lang, _Numbers(lang, seed))
                for piece in pieces(text):
                    if piece:
                        held.extend(map(known.__getitem__, piece))
                        held.append(0)
                        if len(held) > HELD:
                            yield flushed()
            if len(numbers) > 64:
                numbers.clear()
        if held:
            yield flushed()

    return _texts(docs).mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))


def vertical_partitions(suffixes: DataFrame, budget: int) -> tuple[DataFrame, list[DataFrame]]:
    """(dealt, heavy): the suffix rows with ``length``, the words of the prefix they are dealt by;
    and per round the prefixes with more rows than the budget, of 1, 2, ... words, with their
    frequency ``f``. A prefix is extended until its rows are within the budget or it is as long as
    the tree is deep, when its rows are copies of one suffix from different tasks."""
    dealt, heavy = suffixes.withColumn("length", F.lit(1)), []
    for d in range(1, WORDS):
        prefix = _NAMES[:d]
        now = dealt.filter((F.col("length") == d) & (F.col(_NAMES[d - 1]) != 0))
        large = now.groupBy(*prefix).agg(F.count("*").alias("rows"), F.sum("n").alias("f")).filter(F.col("rows") > budget)
        large = written(large.select(*prefix, "f"), "heavy")
        if large.isEmpty():
            break
        heavy.append(large)
        extended = dealt.join(large.select(*prefix, F.lit(True).alias("more")), prefix, "left")
        dealt = extended.withColumn("length", F.when((F.col("length") == d) & F.col("more"), d + 1).otherwise(F.col("length"))).drop("more")
    return dealt, heavy


def subtree_nodes(dealt: DataFrame, groups: int) -> DataFrame:
    """(w0.., depth, length, n): nodes of three words and more of the subtrees of each of ``groups``
    groups. Groups hold whole prefixes; their suffixes are sorted by Spark and swept once, keeping one open node
    per depth. A node no deeper than the prefix of its rows is in several groups, with a part of
    its leaves in each."""
    prefix = [F.when(F.col("length") > k, F.col(c)).otherwise(0) for k, c in enumerate(_NAMES)]
    placed = dealt.withColumn("group", F.pmod(F.xxhash64(*prefix), F.lit(groups)))
    placed = placed.repartition(groups, "group").sortWithinPartitions(*_NAMES).select(*_NAMES, "length", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[int, tuple[np.ndarray, int, int]] = {}

        def made(depth: int, nodes: np.ndarray, length: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            full = np.zeros((len(nodes), WORDS), np.int64)
            full[:, :depth] = nodes
            return pa.RecordBatch.from_arrays([*(pa.array(c) for c in full.T.copy()), pa.array(np.full(len(nodes), depth, np.int64)), pa.array(length), pa.array(n)], names=[*_NAMES, "depth", "length", "n"])

        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(WORDS)], axis=1)
            length, n = batch.column(WORDS).to_numpy().astype(np.int64), batch.column(WORDS + 1).to_numpy()
            for depth in range(3, WORDS + 1):
                deep = np.flatnonzero(rows[:, depth - 1] != 0)
                if not len(deep):
                    continue
                at = rows[deep, :depth]
                starts = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]).any(axis=1)])
                nodes, sums, lengths = at[starts], np.add.reduceat(n[deep], starts), length[deep][starts]
                if depth in open_:
                    node, sum_, long_ = open_.pop(depth)
                    if (node == nodes[0]).all():
                        sums[0] += sum_
                    else:
                        yield made(depth, node[None], np.array([long_]), np.array([sum_]))
                open_[depth] = nodes[-1].copy(), int(sums[-1]), int(lengths[-1])
                if len(nodes) > 1:
                    yield made(depth, nodes[:-1], lengths[:-1], sums[:-1])
        for depth, (node, sum_, long_) in open_.items():
            yield made(depth, node[None], np.array([long_]), np.array([sum_]))

    return placed.mapInArrow(run, f"{_SCHEMA}, depth long, length long, n long")


def phrase_counts(docs: DataFrame, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(words, phrases): every distinct word (lang, word, id, n), and every phrase of 2 to
    ``WORDS`` words that occurs ``least`` times or more: ``p``, its words' ids, and ``f``."""
    for seed in itertools.count(7):
        words = written(word_counts(docs, seed), "words")
        if words.groupBy("id").count().filter("count > 1").isEmpty():
            break
        drop_written(words)
    frequent = words.filter(F.col("n") >= least).select("id")
    bits = docs.sparkSession.sparkContext.broadcast(filter_bits(frequent, "id", frequent.count()))
    pairs = counted_runs(docs, seed, lambda ids: _counted_pairs(ids, bits.value), _NAMES[:2])
    pairs = written(pairs.groupBy(*_NAMES[:2]).agg(F.sum("n").alias("f")).filter(F.col("f") >= least), "pairs")

    def numbers(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (batch.column(k).to_numpy().view(np.uint64) for k in range(2))
            yield pa.RecordBatch.from_arrays([pa.array(pair_number(a, b).view(np.int64))], names=["pair"])

    numbered = pairs.select(*_NAMES[:2]).mapInArrow(numbers, "pair long")
    pair_bits = docs.sparkSession.sparkContext.broadcast(filter_bits(numbered, "pair", pairs.count()))
    suffixes = written(counted_runs(docs, seed, lambda ids: _counted_suffixes(ids, pair_bits.value), _NAMES), "suffixes")
    dealt, heavy = vertical_partitions(suffixes, budget)
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = subtree_nodes(dealt, max(tasks, -(-suffixes.count() // budget)))
    whole = nodes.filter((F.col("depth") >= F.col("length")) & (F.col("n") >= least))
    deep = written(whole.select(F.slice(F.array(*_NAMES), F.lit(1), F.col("depth").cast("int")).alias("p"), F.col("n").alias("f")), "phrases")
    found = pairs.select(F.array(*_NAMES[:2]).alias("p"), "f").union(deep)
    for table in heavy[2:]:  # prefixes of three and more words that were extended: counted then
        known = table.filter(F.col("f") >= least)
        found = found.union(known.select(F.array(*[c for c in known.columns if c != "f"]).alias("p"), "f"))
    return words, found


def _open_phrases(phrases: DataFrame) -> DataFrame:
    """``phrases`` without those that a phrase of one word more holds as often. (A longer one that
    does implies one of one word more.)"""
    longer = phrases.filter(F.size("p") > 2)
    short = F.size("p") - 1
    parts = longer.select(F.explode(F.array(F.slice("p", F.lit(1), short), F.slice("p", F.lit(2), short))).alias("p"), "f")
    most = parts.groupBy("p").agg(F.max("f").alias("within"))
    return phrases.join(most, "p", "left").filter("within is null or within < f").drop("within")


def _scored(rows: Iterable[tuple[int, int, int, list[tuple[int, int, int]]]]) -> Iterator[tuple[int, int, int]]:
    """(l, r, score) of the cut of lowest floored score, the shortest first part among equals:
    whole numbers of any size."""
    for a, n, cuts in rows:
        score, _, left, right = min((1000 * a * n // (left * right), k, left, right) for k, left, right in cuts)
        yield left, right, score


def collocations(docs: DataFrame, least: int = 100, top: int = 2000, budget: int = BUDGET) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score: per language the ``top`` phrases of 2 to ``WORDS``
    words by score, then frequency, then their bytes.

    Null texts are empty, a null language is ``und``; empty texts and tables give nothing, repeated
    rows count again, ties are settled by the phrase's bytes, texts of any length are counted
    whole, and other columns play no part.
    """
    words, phrases = phrase_counts(docs, least, budget)
    phrases = written(phrases, "frequencies")
    singles = words.filter(F.col("n") >= least).select(F.array("id").alias("part"), F.col("n").alias("f"))
    known = singles.union(phrases.select(F.col("p").alias("part"), "f"))
    kept = _open_phrases(phrases)
    size = F.size("p")
    cuts = kept.select("p", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumns({"left": F.slice("p", F.lit(1), F.col("k")), "right": F.slice("p", F.col("k") + 1, size - F.col("k"))})
    cuts = cuts.join(known.select(F.col("part").alias("left"), F.col("f").alias("l")), "left").join(known.select(F.col("part").alias("right"), F.col("f").alias("r")), "right")
    gathered = cuts.groupBy("p", "a").agg(F.collect_list(F.struct("k", "l", "r")).alias("cuts"))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    named = written(words.filter(F.col("n") >= least).join(totals, "lang").select("id", "lang", "word", "total"), "names")
    gathered = gathered.join(named.select("id", "lang", "total"), F.element_at("p", 1) == F.col("id"))
    gathered = gathered.select("lang", "p", "a", F.col("total").alias("n"), "cuts")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cuts = [[(c["k"], c["l"], c["r"]) for c in row] for row in batch.column(4).to_pylist()]
            made = list(_scored(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), cuts)))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *(pa.array([m[k] for m in made], pa.int64()) for k in range(3))], names=["lang", "p", "a", "n", "l", "r", "score"])

    scored = gathered.mapInArrow(run, "lang string, p array<long>, a long, n long, l long, r long, score long")
    likely = scored.withColumn("part", F.pmod(F.xxhash64("p"), F.lit(32)))
    for keys in (["lang", "part"], ["lang"]):  # what is not among the first of its part is not among the first of all
        place = F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("score"), F.desc("a")))
        likely = likely.withColumn("place", place).filter(F.col("place") <= top)
    likely = written(likely.drop("place", "part"), "likely")
    spelt = likely.select("lang", "p", F.posexplode("p").alias("k", "id")).join(named.select("id", "word"), "id")
    spelt = spelt.groupBy("lang", "p").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "word"))), lambda x: F.decode(x["word"], "utf-8")), " ").alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = likely.join(spelt, ["lang", "p"]).withColumn("rank", F.row_number().over(last).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
