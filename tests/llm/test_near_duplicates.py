"""SimHash, embeddings, containment and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from ecolake.llm import common, decontamination, embeddings, simhash

SF = "/root/testdata/sf0.001"


def _components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(0, 60)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, k) for k in range(301, 400)] + [(5, 5)]
    got = dict(common.components(spark.createDataFrame(links, "a long, b long")).collect())
    want = _components(400, links)
    assert got == {k: want[k] for k in {x for a, b in links if a != b for x in (a, b)}}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_take_in_further_links(spark):
    """Groups with further links are the components of all links; only links between groups are drawn anew."""
    rng = np.random.default_rng(3)
    first = [(int(a), int(b)) for a, b in rng.integers(0, 300, (150, 2)) if a != b]
    more = [(int(a), int(b)) for a, b in rng.integers(0, 400, (60, 2)) if a != b]
    frame = lambda links: spark.createDataFrame(links, "a long, b long")
    groups = common.written(common.components(frame(first)), "groups")
    got = [(r["node"], r["component"]) for r in simhash._merged(groups, frame(more)).collect()]
    want = _components(400, first + more)
    ends = {x for link in first for x in link} | {x for a, b in more for x in (a, b)}
    assert len(got) == len(dict(got)) and set(dict(got)) == ends and all(want[n] == c for n, c in got)
    same = simhash._merged(groups, frame(first)).collect()
    assert sorted(map(tuple, same)) == sorted(map(tuple, groups.collect()))


def _plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()[:400]
    texts = [(r["doc_id"], r["text"]) for r in docs]
    texts += [(10_000 + k, t) for k, (_, t) in enumerate(texts[:9])] + [(20_000, None), (20_001, ""), (20_002, " \t"), (None, texts[0][1]), (20_003, "one two"), (20_003, "ONE  two")]
    texts += [(30_000 + k, t + " " + "tail word" * (k % 3)) for k, (_, t) in enumerate(texts[:60])]
    fps = [_plain_fingerprint(t) for _, t in texts]
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    assert any(fps[i] != fps[j] for i, j in links)
    comp = _components(len(fps), links)
    low = {}
    for k, c in enumerate(comp):
        if texts[k][0] is not None:
            low[c] = min(low.get(c, 1 << 60), texts[k][0])
    want = sorted(((d is None, d or 0, f if f < 1 << 63 else f - (1 << 64), low.get(c)) for (d, _), f, c in zip(texts, fps, comp)))
    df = spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["fp"], r["component_id"]) for r in simhash.simhash_classes(df).collect())
    assert got == want
    assert simhash.simhash_classes(df.limit(0)).count() == 0


def test_large_buckets_are_dealt_into_parts(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(1 << 62))
    fps = sorted({centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (150, 2))})
    rows = spark.createDataFrame([(7, f, f) for f in fps], "bucket long, id long, c0 long")
    edges = common.bucket_edges(rows, ["c0"], simhash.near_lanes, block=16)
    got = dict(common.components(edges).collect())
    links = [(i, j) for i in range(len(fps)) for j in range(i) if bin(fps[i] ^ fps[j]).count("1") <= 3]
    want = _components(len(fps), links)
    assert got == {fps[k]: fps[want[k]] for k in {x for pair in links for x in pair}}


def test_embeddings_against_brute_force(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").limit(900).collect()
    vectors = [(r["vec_id"], r["embedding"]) for r in df]
    rng = np.random.default_rng(2)
    for k in range(60):  # near copies down to the threshold
        v = np.array(vectors[k][1])
        noise = rng.normal(size=len(v))
        noise -= v * (noise @ v) / (v @ v)
        c = rng.uniform(0.952, 1)
        vectors.append((50_000 + k, (c * v / np.linalg.norm(v) + np.sqrt(1 - c * c) * noise / np.linalg.norm(noise)).astype(np.float32).tolist()))
    vectors += [(60_000 + k, vectors[0][1]) for k in range(5)] + [(60_010, [2 * x for x in vectors[0][1]])]
    odd = [(70_000, None), (70_001, [0.0] * 64), (70_002, [float("nan")] * 64), (70_003, [None] + [1.0] * 63), (70_004, []), (70_005, [1.0, 0.0]), (70_006, [1.0, 1e-3])]
    x = np.array([v for _, v in vectors], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.95
    np.fill_diagonal(near, False)
    comp = _components(len(x), list(zip(*np.nonzero(near))))
    ids = [i for i, _ in vectors]
    low = {c: min(i for i, d in zip(ids, comp) if d == c) for c in set(comp)}
    want = {i: (int(n), low[c]) for i, n, c in zip(ids, near.sum(1), comp)}
    frame = spark.createDataFrame([(*v, 5) for v in vectors + odd], "vec_id long, embedding array<float>, n_links int")
    rows = embeddings.embedding_classes(frame).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows}
    assert len(rows) == len(vectors) + len(odd)
    assert {k: got[k] for k, _ in odd} == {**{k: (0, k) for k in range(70_000, 70_005)}, 70_005: (1, 70_005), 70_006: (1, 70_005)}
    assert sum(got[k][0] for k in want) >= 0.97 * sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k] == want[k] for k in want) >= 0.97 * len(want)
    assert got[60_000][0] == want[60_000][0] >= 6
    assert embeddings.embedding_classes(frame.limit(0)).count() == 0


def test_distances_of_codes_with_the_sign_bit():
    codes = np.array([[0, 5], [-1, 5], [-(1 << 63), 5], [1, 4], [-1, 4]])
    got = {(int(i), int(j)) for a, b in embeddings.near_codes(codes, np.zeros(5, int), 2) for i, j in zip(a, b)}
    assert got == {(0, 2), (0, 3), (1, 4)}


def test_dense_group_larger_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 50)
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(size=(1, 64)) + 0.05 * rng.normal(size=(180, 64)), rng.normal(size=(40, 64))])
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = (u @ u.T >= 0.95).sum(1) - 1
    df = spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(v)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.embedding_classes(df).collect()}
    assert [got[k][0] for k in range(220)] == want.tolist()
    assert {got[k][1] for k in range(180)} == {0}


@pytest.mark.parametrize("block_bytes", [1500, 1 << 20])
def test_containment_against_brute_force(spark, block_bytes):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = "word%d " * 300 % tuple(range(300))
    docs += [(1000, clean + items[0][1].upper() + clean), (1001, clean + " ".join(items[1][1].split()[:-3])), (1002, clean + " ".join(items[1][1].split()[:8])), (1003, None), (1004, ""), (None, items[2][1])]
    docs += [(1005, clean * 40 + items[3][1].replace(" ", " \n")), (1005, clean * 40 + items[3][1].replace(" ", " \n"))]
    items += [(900, "two words"), (901, None), (902, items[0][1]), (None, items[1][1])]

    def key(x):
        return -1 if x is None else x

    def shingles(text):
        w = decontamination.plain_words(text or "")
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}

    want = []
    sets = [(i, shingles(t)) for i, t in items]
    for d, t in docs:
        own = shingles(t)
        want += [(key(d), key(i), len(own & s)) for i, s in sets if s and len(own & s) >= 0.8 * len(s) - 1e-9]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [(key(r["doc_id"]), key(r["item_id"]), r["shared"]) for r in decontamination.contained_items(frame, bench, block_bytes=block_bytes).collect()]
    assert sorted(got) == sorted(want) and {1000, 1001, 1005, -1} <= {g[0] for g in got}
    kept = decontamination.without_items(frame, bench, block_bytes=block_bytes)
    assert kept.columns == frame.columns
    hit = {w[0] for w in want}
    assert sorted(key(r["doc_id"]) for r in kept.collect()) == sorted(key(d) for d, _ in docs if key(d) not in hit)
    assert decontamination.contained_items(frame.limit(0), bench).count() == 0
    assert decontamination.contained_items(frame, bench.limit(0)).count() == 0


@pytest.mark.parametrize("radius", [3, 58])
def test_bit_planes_find_every_near_code(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(-(2**63), 2**63, (40, 4))
    codes = base[rng.integers(0, 40, 700)].copy()
    for row in codes.view(np.uint8).reshape(700, 32):
        for bit in rng.integers(0, 256, rng.integers(0, radius + 2)):
            row[bit // 8] ^= 1 << (bit % 8)
    group = np.sort(rng.integers(0, 9, 700))
    group[:300] = 0
    apart = np.bitwise_count(codes.view(np.uint64)[:, None] ^ codes.view(np.uint64)[None]).sum(axis=2)
    i, j = np.nonzero(np.triu((apart <= radius) & (group[:, None] == group[None]), 1))
    for rows in (100, 1 << 14):
        got = [(int(a), int(b)) for x, y in simhash.near_planes(codes, group, radius, rows) for a, b in zip(x, y)]
        assert len(i) > 300 and sorted(got) == list(zip(i.tolist(), j.tolist()))


def test_no_similar_pair_is_passed_over():
    """Sizes and parities may let other pairs pass, but never hold back a similar one."""
    rng = np.random.default_rng(8)
    for n in (5, 40, 900, 6000):
        for n_words in (16, 64):
            x = rng.integers(0, 2**64, n, np.uint64)
            y = np.r_[x[: n - n // 9], rng.integers(0, 2**64, n // 9, np.uint64)]  # similarity 0.8 or a little more
            sets = [x, y, x[: int(np.ceil(0.8 * n))]]
            odd = np.stack([simhash.parities(s, n_words) for s in sets]).view(np.uint64)
            got = simhash.may_be_similar(np.array([len(s) for s in sets]), odd, np.array([0, 0]), np.array([1, 2]), 0.8)
            assert got.tolist() == [0, 1]


def test_items_without_a_shingle_are_told(spark):
    rows = [(1, "one two three four"), (2, "one, two: three four five!"), (3, None), (4, ""), (None, "a-b")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    assert sorted(((r["item_id"] or 0), r["text"]) for r in decontamination.unsearched_items(items).collect() if r["text"]) == [(0, "a-b"), (1, "one two three four")]
    assert decontamination.unsearched_items(items).count() == 4


def test_short_items_and_sql(spark, tmp_path):
    """Items of one to four words are found as whole runs; the SQL twin agrees on the same rows."""
    import duckdb

    from ecolake.llm import queries

    filler = " ".join(f"w{k}" for k in range(400))
    docs = [(1, f"{filler} The Answer, is: 42 {filler}"), (2, "answer is"), (3, filler), (4, None), (5, "the answer was is 42"), (6, "quux"), (6, "quux"), (None, "a quux b"), (7, "quuxes"), (8, "")]
    items = [(1, "answer is 42"), (2, "QUUX"), (3, ""), (4, None), (5, "?!"), (6, "the answer is 42"), (None, "answer is"), (7, "quux "), (8, "w1 w2 w3 w4 w5 w6 w7 w8")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame, bench = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] or -1, r["item_id"] or -1, r["shared"], r["n_shingles"], r["containment"]) for r in decontamination.contained_items(frame, bench, short_items=True).collect())
    long = [(d, 8, 4, 4, 1.0) for d in (1, 3)]
    assert got == sorted([(1, 1, 1, 1, 1.0), (1, 6, 1, 1, 1.0), (1, -1, 1, 1, 1.0), (2, -1, 1, 1, 1.0), *long, *((d, i, 1, 1, 1.0) for d in (6, 6, -1) for i in (2, 7))])
    kept = decontamination.without_items(frame, bench, short_items=True).collect()
    assert sorted(r["doc_id"] for r in kept) == [4, 5, 7, 8]
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'" + (" WHERE doc_id IS NOT NULL" if t == "documents" else " WHERE item_id IS NOT NULL"))
    told = set(con.sql(queries.ORACLE["op2_decontamination"]).fetchall())
    assert told == {g for g in got if g[0] != -1 and g[1] != -1}


def test_long_texts_that_share_a_line_are_told_apart():
    """Three thousand sets of five thousand shingles with a line in common: sizes and parities, which
    grow with the sets, leave the similar pairs alone, also where parities of two lengths meet."""
    rng = np.random.default_rng(3)
    line = rng.integers(0, 2**64, 12, np.uint64)
    sets = [np.r_[line, rng.integers(0, 2**64, 5_000, np.uint64)] for _ in range(3_000)]
    sets[7] = np.r_[sets[5][:4_600], rng.integers(0, 2**64, 400, np.uint64)]
    base = rng.integers(0, 2**64, 4_200, np.uint64)
    sets[20], sets[21] = base, base[:4_000]  # 8,192 and 4,096 bits
    odd = [simhash.parities(s).tobytes() for s in sets]
    assert {len(odd[20]), len(odd[21])} == {1024, 512}
    assert np.array_equal(simhash.halved(np.frombuffer(odd[20], np.uint64)[None])[0], simhash.parities(sets[20], 64).view(np.uint64))
    size, component = np.array([len(s) for s in sets]), np.arange(len(sets))
    met = lambda c: {(int(i), int(j)) for a, b in simhash.set_pairs(size, c, odd, np.zeros(len(sets), int), 0.8) for i, j in zip(a, b)}
    assert met(component) == {(5, 7), (20, 21)}
    assert met(np.where(component == 7, 5, component)) == {(20, 21)}
