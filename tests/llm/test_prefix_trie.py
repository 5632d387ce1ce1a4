"""The conversation trie against a trie of dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from ecolake.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, n_convs long"


def brute(rows: list[tuple]) -> list[tuple]:
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(turns):
        h = zlib.crc32(str(c).encode()) % 9
        made = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
        for d in range(len(made) + 1):
            members[made[:d]].append(c)
        ends[made].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in children[node]]
        size = len(node[-1][1].encode()) if node else 0
        sums[node] = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * size
        text = ",".join(map(str, ends[node]))
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(children[node]), *sums[node], hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, limit):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    return sorted(map(tuple, prefix_trie.conversation_trie(df, limit).collect()), key=str)


def conversations(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for c in range(60):
        if rng.random() < 0.2:  # copies of one conversation
            rows += [(c, t, "user", f"copy {t}") for t in range(6)]
        else:
            rows += [(c, t, rng.choice(["user", "bot", None]), rng.choice(["hi", "wie geht's", "ça va", None, ""])) for t in range(rng.randrange(1, 9))]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [1, 3, 1000])
def test_nodes_are_those_of_a_plain_trie(spark, limit):
    rows = conversations(4)
    assert found(spark, rows, limit) == brute(rows)


def test_long_shared_prefixes_burst_at_their_end(spark):
    rows = [(c, t, "u", "same" if t < 30 else f"{c} {t}") for c in range(0, 55, 5) for t in range(32)] + [(5, 32, "u", "more")]
    assert found(spark, rows, 4) == brute(rows)


def test_odd_rows(spark):
    rows = [
        (1, 0, "u", "only"), (7, 3, None, None), (7, None, "u", "first"), (7, 3, None, None), (7, 3, "a", "tie"), (7, 3, "a", "a tie"),
        (None, 0, "u", "nobody"), (10, 0, "u", "base"), (11, 5, "u", "ü" * 40_000), (12, 0, "u", "base"), (12, 0, "u", "base"), (20, None, None, None),
    ]
    for limit in (1, 100):
        assert found(spark, rows, limit) == brute(rows)
    assert found(spark, [], 10) == []


def test_numbers_of_many_members_are_hashed_in_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 40)
    rows = [(c, 0, "u", "x") for c in range(0, 3000, 5)]
    assert found(spark, rows, 10) == brute(rows)


def test_a_hash_collision_is_seen(spark, monkeypatch):
    seen = []
    original = prefix_trie.F.xxhash64

    def clashing(*cols):
        seed = getattr(cols[0], "_jc", None) and cols[0]._jc.toString()
        if len(cols) == 3 and seed == "11":
            seen.append(seed)
            return prefix_trie.F.lit(1).cast("long")
        return original(*cols)

    monkeypatch.setattr(prefix_trie.F, "xxhash64", clashing)
    rows = conversations(5)
    assert found(spark, rows, 1000) == brute(rows)
    assert seen
