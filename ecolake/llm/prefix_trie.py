"""The prefix trie of conversations, built by bursting containers.

Every conversation is the sequence of its turns' numbers. A container holds the sequences that
share one prefix, its head. A container of more than ``limit`` distinct sequences bursts: its head
moves down to the end of the longest prefix they all share, and the sequences are dealt by their
next turn into containers of their own. Containers that remain are sorted and swept once, with
the open path on a stack, into trie nodes. What bursting left above them, chains and branching
nodes, is summed up from below, round by round.

Equal sequences are one row with a count from the start, so copies never swell a container.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ecolake.llm.common import written

LIMIT = 2048  # distinct sequences of a container
CHUNK = 1 << 16  # characters of joined conversation numbers that travel as one row
NO_ENDS = hashlib.sha256(b"").hexdigest()

_KEY = ["k1", "k2", "depth"]  # two hashes of the prefix at the head, and its length
_PARENT = ["p1", "p2", "pdepth"]


def turn_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes): the turns of every conversation in order, as numbers that equal
    turns share and the UTF-8 bytes of their texts.

    Null turns come first; rows of one turn number are ordered by role and text, and a repeated
    row is a turn of its own. A number is a 64-bit hash of role and text. A second hash tells
    whether two turns got one number; then all are hashed anew.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", role.alias("role"), text.alias("text"))
    for seed in itertools.count(11):
        made = rows.withColumns({"id": F.xxhash64(F.lit(seed), "role", "text"), "check": F.xxhash64("text", "role", F.lit(seed))})
        place = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
        size = F.octet_length(F.encode("text", "utf-8")).cast("long")
        placed = written(made.select("conv_id", "id", "check", size.alias("size"), place.alias("place")), "turns")
        if placed.groupBy("id").agg((F.min("check") != F.max("check")).alias("two")).filter("two").isEmpty():
            break
    turns = F.sort_array(F.collect_list(F.struct("place", "id", "size")))
    return placed.groupBy("conv_id").agg(turns.alias("t")).select("conv_id", F.col("t.id").alias("ids"), F.col("t.size").alias("sizes"))


def rebuilt(sequences: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """Every conversation c with its first h turns, h = crc32(c as text) mod ``most``, replaced by
    the first h of conversation c - c mod ``family``: all if that has fewer, none if it is not
    there. Turns of c after its first h follow."""
    first = sequences.filter(F.col("conv_id") % family == 0)
    heads = first.select(F.col("conv_id").alias("base"), F.slice("ids", 1, most - 1).alias("head_ids"), F.slice("sizes", 1, most - 1).alias("head_sizes"))
    own = sequences.withColumn("base", F.col("conv_id") - F.col("conv_id") % family)
    own = own.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int"))

    def joined(name: str) -> Column:
        head = F.slice(F.coalesce(f"head_{name}", F.expr("cast(array() as array<bigint>)")), F.lit(1), F.col("h"))
        return F.concat(head, F.slice(name, F.col("h") + 1, F.greatest(F.size(name) - F.col("h"), F.lit(0))))

    return own.join(heads, "base", "left").select("conv_id", joined("ids").alias("ids"), joined("sizes").alias("sizes"))


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """(conv_id, ids, sizes, n, ends): every distinct sequence, with its smallest conversation,
    its conversations' number and the SHA-256 of their ascending, comma-joined decimal numbers.

    Members are range-partitioned by sequence and number, so those of one common sequence lie in
    many tasks; each joins its stretch of numbers into a few long strings, and only these travel
    to the one task that feeds them to the hash in order.
    """
    keyed = written(sequences.withColumns({"k1": F.xxhash64(F.lit(1), "ids"), "k2": F.xxhash64(F.lit(2), "ids")}), "rebuilt")
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    members = keyed.select("k1", "k2", "conv_id").repartitionByRange(n, "k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id")

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["k1", "k2", "first", "n", "part"]
        for some in _batched(_chunks(_streamed(batches))):
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in some[:4]), pa.array(some[4], pa.string())], names=names)

    chunks = members.mapInArrow(joined, "k1 long, k2 long, first long, n long, part string")
    chunks = chunks.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2", "first")

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _batched(_digests(_streamed(batches))):
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in some[:2]), pa.array(some[2], pa.string())], names=["first", "n", "ends"])

    digests = chunks.mapInArrow(hashed, "first long, n long, ends string")
    return written(keyed.join(digests, F.col("conv_id") == F.col("first")).select("conv_id", "ids", "sizes", "n", "ends"), "sequences")


def _chunks(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(k1, k2, first, n, joined) for stretches of rows (k1, k2, conv_id) of one key."""
    for key, group in itertools.groupby(rows, key=lambda r: r[:2]):
        held, length = [], 0
        for *_, conv in group:
            held.append(conv)
            length += len(str(conv)) + 1
            if length >= CHUNK:
                yield (*key, held[0], len(held), ",".join(map(str, held)))
                held, length = [], 0
        if held:
            yield (*key, held[0], len(held), ",".join(map(str, held)))


def _digests(rows: Iterable[tuple]) -> Iterator[tuple]:
    for _, group in itertools.groupby(rows, key=lambda r: r[:2]):
        sha, first, n = hashlib.sha256(), None, 0
        for *_, begin, count, part in group:
            sha.update(part.encode() if first is None else b"," + part.encode())
            first, n = begin if first is None else first, n + count
        yield first, n, sha.hexdigest()


def _streamed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)))


def _batched(rows: Iterable[tuple], size: int = 4096) -> Iterator[list[tuple]]:
    """Rows as tuples of columns, ``size`` rows at a time."""
    rows = iter(rows)
    while some := list(itertools.islice(rows, size)):
        yield list(zip(*some))


def _prefix_key(length: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), F.slice("ids", F.lit(1), length)).alias(f"k{seed}") for seed in (1, 2)]


def burst(sequences: DataFrame, limit: int = LIMIT) -> tuple[DataFrame, list[tuple[DataFrame, DataFrame]]]:
    """(containers, rounds): the sequences with the keys of their final container and of the head
    above it; and per round the heads that burst (with ``upto``, the depth they moved down to, and
    ``chain``, the text sizes from their first depth to that) and the sequences that end there.

    A round parts each container it bursts into two at least. Sizes and shared prefixes come from
    the least and the greatest sequence of a container, which are combined before any shuffle.
    """
    nothing = [F.lit(None).cast(t).alias(p) for p, t in zip(_PARENT, ("long", "long", "int"))]
    live = sequences.select("*", *_prefix_key(F.lit(0)), F.lit(0).alias("depth"), *nothing)
    done, rounds = [], []
    differ = F.array_position(F.zip_with("low.ids", "high", lambda a, b: ~a.eqNullSafe(b)), True)
    while True:
        found = live.groupBy(*_KEY, *_PARENT).agg(F.count("*").alias("rows"), F.min(F.struct("ids", "sizes")).alias("low"), F.max("ids").alias("high"))
        shared = F.when(differ > 0, differ - 1).otherwise(F.size("high")).cast("int")
        large = found.filter(F.col("rows") > limit).withColumn("upto", shared)
        chain = F.concat(F.when(F.col("depth") == 0, F.array(F.lit(0).cast("long"))).otherwise(F.expr("cast(array() as array<bigint>)")), F.slice("low.sizes", F.greatest("depth", F.lit(1)), F.col("upto") - F.greatest("depth", F.lit(1)) + 1))
        heads = written(large.select(*_KEY, *_PARENT, "upto", chain.alias("chain")), "heads")
        if heads.isEmpty():
            done.append(live)
            break
        marked = written(live.join(heads.select(*_KEY, "upto"), _KEY, "left"), "burst")
        done.append(marked.filter("upto is null").drop("upto"))
        rounds.append((heads, marked.filter("size(ids) = upto").select(*_KEY, "conv_id", "n", "ends")))
        above = [F.col(k).alias(p) for k, p in zip(_KEY, _PARENT)]
        below = F.col("upto") + 1
        live = marked.filter("size(ids) > upto").select(*sequences.columns, *_prefix_key(below), below.alias("depth"), *above)
    containers = done[0]
    for more in done[1:]:
        containers = containers.unionByName(more)
    return containers, rounds


_NODE = "conv_id long, depth int, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


class _Open:
    """A node of the open path: its numbers so far and its closed children, which wait for it to
    know their parent's smallest conversation."""

    __slots__ = ("conv", "n", "children", "leaves", "saved", "ends", "size", "waiting")

    def __init__(self, size: int):
        self.conv, self.n, self.children, self.leaves, self.saved, self.ends, self.size, self.waiting = None, 0, 0, 0, 0, NO_ENDS, size, []

    def add(self, conv: int, n: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.n += n


def swept_nodes(depth: int, rows: Iterable[tuple]) -> Iterator[tuple]:
    """Nodes of one container as tuples of ``_NODE``; the last is that at ``depth``, whose parent is
    unknown here. ``rows``: (ids, sizes, conv, n, ends) in ascending order of ids."""
    path: list[_Open] = []
    before: list[int] = []

    def close() -> Iterator[tuple]:
        node = path.pop()
        node.leaves = node.leaves or 1
        node.saved += (node.n - 1) * node.size
        for d, child in node.waiting:
            yield child.conv, d, node.conv, child.n, child.children, child.leaves, child.saved, child.ends
        if path:
            up = path[-1]
            up.add(node.conv, node.n)
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            node.waiting = []
            up.waiting.append((depth + len(path), node))
        else:
            yield node.conv, depth, None, node.n, node.children, node.leaves, node.saved, node.ends

    for ids, sizes, conv, n, ends in rows:
        if not path:
            path.append(_Open(sizes[depth - 1] if depth else 0))
        shared = depth
        while shared < len(ids) and shared < len(before) and ids[shared] == before[shared]:
            shared += 1
        while len(path) > shared - depth + 1:
            yield from close()
        for d in range(shared, len(ids)):
            path.append(_Open(sizes[d]))
        path[-1].add(conv, n)
        path[-1].ends = ends
        before = ids
    while path:
        yield from close()


def trie_nodes(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the trie over distinct ``sequences`` (conv_id, ids, sizes, n, ends)."""
    containers, rounds = burst(sequences, limit)
    n = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = [*_KEY, *_PARENT, "ids", "sizes", "conv_id", "n", "ends"]
    sorted_ = containers.select(*columns).repartition(n, "k1", "k2").sortWithinPartitions(*_KEY, "ids")

    def swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for key, group in itertools.groupby(_streamed(batches), key=lambda r: r[:6]):
                for node in swept_nodes(key[2], (r[6:] for r in group)):
                    yield (*key[3:], node[1] == key[2], *node)

        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.string()]
        for some in _batched(rows()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(some, kinds)], names=names)

    schema = f"p1 long, p2 long, pdepth int, top boolean, {_NODE}"
    names = [c.split()[0] for c in schema.split(", ")]
    nodes = written(sorted_.mapInArrow(swept, schema), "nodes")
    if not rounds:
        return nodes.select(*names[4:])

    tops = nodes.filter("top").select(*names)
    below, chains, owners = tops, [], []
    for heads, ended in reversed(rounds):
        sums = below.groupBy(*_PARENT).agg(F.sum("n_convs").alias("cn"), F.min("conv_id").alias("first"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
        sums = sums.select(*[F.col(p).alias(k) for k, p in zip(_KEY, _PARENT)], "cn", "first", "children", "leaves", "saved")
        head = heads.join(sums, _KEY).join(ended, _KEY, "left")
        head = head.withColumns({"n": F.col("cn") + F.coalesce("n", F.lit(0)), "conv_id": F.least("first", "conv_id")})
        head = head.select("*", F.posexplode("chain").alias("step", "__size"))
        end = F.col("depth") + F.col("step") == F.col("upto")
        rest = F.aggregate(F.slice("chain", F.col("step") + 1, F.size("chain")), F.lit(0).cast("long"), lambda a, x: a + x)
        made = head.select(
            *_KEY, *_PARENT, (F.col("step") == 0).alias("top"), "conv_id", (F.col("depth") + F.col("step")).alias("node_depth"),
            F.when(F.col("step") > 0, F.col("conv_id")).alias("parent_conv_id"), F.col("n").alias("n_convs"), F.when(end, F.col("children")).otherwise(1).alias("n_children"),
            F.col("leaves").alias("n_leaves"), (F.col("saved") + (F.col("n") - 1) * rest).alias("saved_tokens"), F.when(end, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
        )
        made = written(made, "chains")
        owners.append(made.filter("top").select(*[F.col(k).alias(p) for k, p in zip(_KEY, _PARENT)], F.col("conv_id").alias("owner")))
        made = made.drop("depth").withColumnRenamed("node_depth", "depth").select(*names)
        chains.append(made)
        below = made.filter("top").union(tops)
    owner = owners[0]
    for more in owners[1:]:
        owner = owner.union(more)
    every = nodes
    for more in chains:
        every = every.union(more)
    inner = every.filter(~F.col("top"))
    tops = every.filter("top").join(owner, _PARENT, "left").withColumn("parent_conv_id", F.col("owner"))
    return inner.select(*names[4:]).union(tops.select(*names[4:]))


def conversation_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations: conv_id (smallest member),
    depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256.

    Null roles and texts are empty ones, null turns come first, ties are ordered by role and text,
    repeated rows are turns of their own, and rows without a conv_id belong to no conversation.
    Conversations that are rebuilt to nothing end at the root. An empty table has no node, not
    even the root. Other columns play no part. The turns' numbers of one conversation (16 bytes a
    turn, never the texts) travel as one row.
    """
    nodes = trie_nodes(distinct_sequences(rebuilt(turn_sequences(conversations))), limit)
    return nodes.withColumn("depth", F.col("depth").cast("long"))
