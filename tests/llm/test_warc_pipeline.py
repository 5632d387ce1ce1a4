"""Archives read back whole, and the pipeline stage by stage."""

import gzip
import hashlib

import pytest

import corpus_pipeline
from ecolake.llm import warc

SF = "/root/testdata/sf0.001"


def _pages(spark):
    rows = [(k, f"http://a/{k}?x y", f"<p>{k}" + "text " * (k % 7) * 30) for k in range(60)]
    rows += [(100 + k, None, "same payload " * 20) for k in range(5)] + [(110, "u", "short"), (111, "u", "short"), (112, "é\n", None), (None, "n", "same payload " * 20), (113, "n", "")]
    rows += [(104, None, "same payload " * 20), (114, "big", "x" * 3_000_000)]
    return rows, spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, size int").repartition(3)


@pytest.mark.parametrize("split_bytes", [150, 1000, 8 << 20])
def test_round_trip(spark, split_bytes):
    rows, df = _pages(spark)
    got = sorted(((r["page_id"] if r["page_id"] is not None else -1), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archived_pages(spark, df, split_bytes).collect())
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == body and p is not None]
        revisit = len(body) >= 100 and page_id != min(same)
        want.append(((page_id if page_id is not None else -1), len(body), hashlib.sha256(body).hexdigest(), "revisit" if revisit else "response", min(same) if revisit else None))
    assert got == sorted(want)
    assert warc.archived_pages(spark, df.limit(0)).count() == 0


def test_payloads_and_members(spark):
    rows, df = _pages(spark)
    archives = warc.write_archives(df)
    records = warc.read_archives(archives, 500).collect()
    assert sorted(bytes(r["payload"]).decode() for r in records if r["record_type"] == "response" and r["page_id"] and int(r["page_id"]) < 60) == sorted(h for p, _, h in rows if p is not None and p < 60)
    for a in archives.collect():
        fs, path = warc.open_store(a["path"])
        whole = fs.open_input_file(path).read()
        assert len(whole) == a["bytes"] and gzip.decompress(whole).count(b"WARC/1.1\r\n") == a["records"]


@pytest.mark.parametrize("split_bytes", [64, 300, 1000, 5000])
def test_archive_inside_a_record(spark, tmp_path, split_bytes):
    """Records inside a payload that is stored uncompressed look like records of the archive."""
    import zlib

    inner = b"".join(warc.record_bytes(900 + k, "http://inner/", "response", "0", 0, b"inner " * 4, None, None) for k in range(30))
    body = b"HTTP/1.1 200 OK\r\n\r\n" + inner
    head = warc.VERSION + f"WARC-Type: response\r\nWARC-Page-ID: 1\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    z = zlib.compressobj(0, zlib.DEFLATED, 31)
    outer = z.compress(head + body + b"\r\n\r\n") + z.flush()
    plain = [warc.record_bytes(k, "http://plain/", "response", "0", 2, b"ok", None, None) for k in (0, 2, 3)]
    file = tmp_path / "nested.warc.gz"
    file.write_bytes(plain[0] + outer + plain[1] + plain[2])
    archives = spark.createDataFrame([(f"file://{file}", file.stat().st_size)], "path string, bytes long")
    got = sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_archives(archives, split_bytes).collect())
    assert got == [("0", 2), ("1", len(inner)), ("2", 2), ("3", 2)]


@pytest.mark.parametrize("split_bytes", [90, 700, 1 << 20])
def test_archives_of_others(spark, tmp_path, split_bytes):
    """Records of any type and WARC version; behind a damaged one reading goes on, and it is told."""
    import zlib

    def member(version, kind, block, *fields):
        lines = [f"WARC-Type: {kind}", *fields, f"Content-Length: {len(block)}"]
        return gzip.compress(version + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")

    records = [member(b"WARC/1.0", "warcinfo", b"software: x\r\n"), member(b"WARC/1.0", "request", b"GET / HTTP/1.1\r\n\r\n"), member(b"WARC/1.1", "response", b"dns answer", "Content-Type: text/dns")]
    records += [member(b"WARC/1.0", "response", b"HTTP/1.1 200 OK\r\n\r\nbody %d" % k, f"WARC-Target-URI: http://h/{k}") for k in range(40)]
    broken = bytearray(records[20])
    broken[25:40] = bytes(15)
    with pytest.raises(zlib.error):
        zlib.decompress(bytes(broken), 31)
    records[20] = bytes(broken)
    file = tmp_path / "others.warc.gz"
    file.write_bytes(b"".join(records))
    archives = spark.createDataFrame([(f"file://{file}", file.stat().st_size)], "path string, bytes long")
    got = warc.read_archives(archives, split_bytes).collect()
    assert sorted(r["url"] for r in got if r["url"]) == sorted(f"http://h/{k}" for k in range(40) if k != 17)
    assert {(r["record_type"], r["payload_bytes"], r["payload_digest"]) for r in got if r["record_type"] in ("warcinfo", "request")} == {("warcinfo", None, None), ("request", None, None)}
    assert [bytes(r["payload"]) for r in got if r["payload"] == b"dns answer"] == [b"dns answer"]
    assert [(r["offset"], r["payload_bytes"]) for r in got if r["record_type"] == "damaged"] == [(sum(map(len, records[:20])), len(broken))]
    assert len(got) == 43


# --- pipeline ---------------------------------------------------------------------------


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "decontamination", "mixing", "sharding"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    last = corpus_pipeline.run(spark, SF)
    assert last.columns == [*docs.columns, "shard", "slot"] and last.count() > 100


def test_odd_rows_pass_all_stages(spark):
    rows = [(None, None, None, None, None, 1), (1, "", "en", None, 0, 2), (2, "a b c", "en", "s", 5, 3), (2, "a b c", "en", "s", 5, 3), (3, "w%d " * 30_000 % tuple(range(30_000)), None, "s", 1, 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp int")
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, df, SF)
        assert got.columns[: len(df.columns)] == df.columns, name
        found = sorted((r["doc_id"] if r["doc_id"] is not None else -1) for r in got.collect())
        assert {2, 3} <= set(found), name
        if name in ("toxicity", "decontamination", "sharding"):
            assert found == [-1, 1, 2, 2, 3]
        if name == "simhash_near_dedup":
            assert found == [1, 2, 3]  # no words at all is one group
        assert stage(spark, df.limit(0), SF).count() == 0


def test_near_copies_leave_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ids = sorted(texts)
    sets = {}
    for d, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    pairs = 0
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            small, large = sorted((len(sets[a]), len(sets[b])))
            if small >= 0.8 * large and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                pairs += sets[a] != sets[b]
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    want = {find(d) for d in ids}
    assert pairs >= 10 and want <= kept and len(kept - want) <= 0.1 * pairs


def test_near_copies_at_every_similarity(spark):
    """Groups of edited copies, larger than a part, with a third of all rows equal."""
    import random

    rng = random.Random(5)
    base = [[f"w{rng.randrange(10**6)}" for _ in range(300)] for _ in range(30)]
    rows = []
    for g, tokens in enumerate(base):
        rows.append((g * 1000, " ".join(tokens)))
        for k in range(1, 20 if g else 400):
            own = list(tokens)
            for _ in range(k % 4):
                own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
            rows.append((g * 1000 + k, " ".join(own)))
        near = list(tokens)
        for at in range(0, 300, 10):  # every shingle differs in a tenth of the words: similarity below 0.5
            near[at] = "other"
        rows.append((g * 1000 + 999, " ".join(near)))
    rows += [(50_000 + k, " ".join(base[1])) for k in range(500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect())
    assert kept == sorted([g * 1000 for g in range(30)] + [g * 1000 + 999 for g in range(30)])


def test_no_near_copy_is_lost(spark):
    """Pairs at 0.8 exactly that no third text connects: short ones, where fingerprints find fewest,
    and longer ones that share a frequent passage with all others."""
    import random

    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**7)}"
    rows = []
    for k in range(0, 800, 2):
        tokens = [word() for _ in range(9)]  # five shingles, and four of them
        rows += [(k, " ".join(tokens)), (k + 1, " ".join(tokens[:8]))]
    passage = [word() for _ in range(12)]
    for k in range(1000, 1200, 2):
        tokens = passage + [word() for _ in range(92)]  # a hundred shingles, eighty of them and seventy-nine
        rows += [(k, " ".join(tokens)), (k + 1, " ".join(tokens[: 84 if k < 1150 else 83]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect())
    assert kept == sorted([*range(0, 800, 2), *range(1000, 1200, 2), *range(1151, 1200, 2)])


def test_every_near_copy_of_the_documents(spark):
    """The documents kept are those of brute force, without a pair lost."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF).collect()}
    sets = {}
    for r in docs.collect():
        w = (r["text"] or "").encode().lower().split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    first = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            x, y = first[a], first[b]
            if a < b and x != y and 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                first = {d: min(x, y) if f in (x, y) else f for d, f in first.items()}
    assert kept == set(first.values())


def test_a_group_below_the_similarity_sends_each_text_once(spark, monkeypatch):
    """Texts that nearly all pairs of miss the similarity by little: what is written on the way
    follows the rows that share a shingle, not their pairs, in parts and in one, and no link is lost."""
    import random

    from ecolake.llm import simhash

    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**7)}"
    passages = [[word() for _ in range(94)] for _ in range(2)]
    texts, own = {}, []
    for k in range(600):
        own = own[:10] + [word() for _ in range(3)] if k % 20 == 1 else [word() for _ in range(13)]
        texts[k] = passages[k % 40 // 20][k % 4 : 91 + k % 4] + own
    sets = {k: {tuple(t[x : x + 5]) for x in range(len(t) - 4)} for k, t in texts.items()}
    first, close = {k: k for k in sets}, 0
    for a in sets:
        for b in range(a + 1, len(sets)):
            shared = len(sets[a] & sets[b]) / len(sets[a] | sets[b])
            close += 0.7 <= shared < 0.8
            if shared >= 0.8 and first[a] != first[b]:
                x, y = sorted((first[a], first[b]))
                first = {d: x if f == y else f for d, f in first.items()}
    assert close > 60_000 and 10 < len(sets) - len(set(first.values())) < 300
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    real, made = simhash.written, []

    def counted(table, label):
        got = real(table, label)
        made.append((label, got.count()))
        return got

    monkeypatch.setattr(simhash, "written", counted)
    for block in (simhash.BLOCK, 200):
        monkeypatch.setattr(simhash, "BLOCK", block)
        made.clear()
        kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, df, SF).collect()}
        assert kept == set(first.values())
        at = [label for label, _ in made].index("shared")
        shared = made[at][1]
        parts = 1 if block > 600 else 4
        assert all(n <= parts * shared for _, n in made[at:] if _ != "members"), made
