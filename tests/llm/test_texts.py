"""Language model, toxicity, token counts and HTML against brute force."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ecolake.llm import html_extract, lm_scoring, token_counts, toxicity

SF = "/root/testdata/sf0.001"


# --- language model ---------------------------------------------------------------------


def _every_cut(lattice, word):
    """Probability of a word by enumerating its segmentations."""
    known = [dict(zip(h.tolist(), k.tolist())) for h, k in zip(lattice.hashes, lattice.ids)]

    def piece(kind, text):
        return known[kind].get(int(lm_scoring._hash(lm_scoring._points(text)[None])[0]))

    def rest(i):
        if i == len(word):
            return math.exp(lattice.log_stop)
        total = 0.0
        for j in range(i + 1, len(word) + 1):
            k = piece(1, word[i:j])
            p = math.exp(lattice.log_p[k]) if k is not None else 0.0
            if j == i + 1:
                raw = list(word[i].encode())
                p += math.exp(lattice.log_p[lattice.byte_ids[raw]].sum() + (len(raw) - 1) * lattice.log_go)
            total += p and math.exp(lattice.log_go) * p * rest(j)
        return total

    total = math.exp(lattice.log_p[lattice.bare]) * rest(0)
    for j in range(1, len(word) + 1):
        k = piece(0, word[:j])
        total += math.exp(lattice.log_p[k]) * rest(j) if k is not None else 0.0
    return total


def test_forward_adds_up_all_segmentations():
    lattice = lm_scoring.vocabulary_lattice()
    tables = lattice.tables()
    for word in ("the", "thhaing", "größe", "a", "☃x", "\U0001f600"):
        got = lm_scoring.forward(lattice, tables, lm_scoring._points(word)[None])[0]
        assert got == pytest.approx(math.log(_every_cut(lattice, word)))
    long = lm_scoring.forward(lattice, tables, lm_scoring._points("ab" * 2000)[None])[0]
    assert np.isfinite(long) and long < -2000


def test_expected_counts_are_derivatives():
    lattice = lm_scoring.vocabulary_lattice()
    points = lm_scoring._points("thhaingé")[None]
    counts = np.zeros(len(lattice.log_p))
    base = lm_scoring.forward(lattice, lattice.tables(), points, counts)[0]
    for k in [*np.argsort(-counts)[:8], lattice.byte_ids["é".encode()[0]]]:
        lattice.log_p[k] += 1e-5
        assert (lm_scoring.forward(lattice, lattice.tables(), points)[0] - base) / 1e-5 == pytest.approx(counts[k], abs=1e-3)
        lattice.log_p[k] -= 1e-5


@pytest.mark.parametrize("head_words", [50, 250_000])
def test_document_scores(spark, head_words):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()][:80]
    docs += [(5001, None), (5002, ""), (None, "The the nullword"), (5003, "once " * 500 + "z" * 3000), (5003, "Once")]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, score int")
    rows = lm_scoring.document_scores(df, head_words=head_words).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 5 == 1
    tokens = [((t or "").encode().lower().split() + [None]) for _, t in docs]
    c = Counter(w for (d, _), ws in zip(docs, tokens) if not held(d) for w in ws)
    n, v = sum(c.values()), len(c)
    want = sorted(
        (d or -1, held(d), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for (d, _), ws in zip(docs, tokens)
    )
    got = sorted((r["doc_id"] or -1, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows)
    assert got == want
    assert all(np.isfinite(r["score"]) and r["score"] < 0 for r in rows)
    likely = {r["doc_id"]: r["score"] for r in rows}
    assert likely[5002] > likely[5003]


def test_head_and_tail_agree_and_nothing_to_learn_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    a, b = ({r["doc_id"]: r["score"] for r in lm_scoring.document_scores(docs, head_words=n).collect()} for n in (0, 1_000_000))
    assert a == pytest.approx(b)
    one = spark.createDataFrame([(k, "some words") for k in range(40) if zlib.crc32(str(k).encode()) % 5 == 1], "doc_id long, text string")
    rows = lm_scoring.document_scores(one).collect()
    assert rows and all(r["held_out"] and r["train_tokens"] == 0 and r["n_known"] == 0 and np.isfinite(r["score"]) for r in rows)
    assert lm_scoring.document_scores(one.limit(0)).count() == 0


def test_model_is_a_distribution():
    """All words of up to three letters of a small alphabet together stay below one."""
    lattice = lm_scoring.vocabulary_lattice()
    words = [a + b + c for a in "abc" for b in ["", *"abc"] for c in (["", *"abc"] if b else [""])]
    total = sum(np.exp(lm_scoring.forward(lattice, lattice.tables(), p)).sum() for _, p in lm_scoring.by_length(words))
    assert 0 < total < 1


def test_words_are_followed_as_long_as_a_piece_may_begin_like_them():
    """Both ways of summing agree, in totals and in expected counts, and no piece is looked for
    behind the longest beginning of one."""
    lattice = lm_scoring.vocabulary_lattice()
    tables = lattice.tables()
    words = ["wordwordword", "information", "xqzjvkwpyfbd", "\u6f22\u5b57" * 5, "na\u00efvet\u00e9sse", "\U0001f600" * 30, "x" * 200]
    for _, points in lm_scoring.by_length(words):
        byte_p = lm_scoring._byte_log_p(lattice, points)
        counts = [np.zeros(len(lattice.log_p)) for _ in range(3)]
        total = lm_scoring.forward(lattice, tables, points, counts[0])
        logs = lm_scoring._summed_logs(lattice, tables, points, byte_p, counts[1])
        assert np.allclose(total, logs, rtol=1e-12) and np.allclose(counts[0], counts[1], rtol=1e-9, atol=1e-9)
        if (byte_p.sum(axis=1) > -500).all():
            assert np.allclose(lm_scoring._summed_plain(lattice, tables, points, byte_p, counts[2]), logs, rtol=1e-12)
    assert [a.all() for a in (np.isin(h, s) for h, s in zip(lattice.hashes, lattice.starts))] == [True, True]
    rows = pa.RecordBatch.from_arrays([pa.array(["a"] * 10)], names=["word"])
    assert [b.num_rows for b in lm_scoring._gathered([rows] * 7)] == [70]


# --- toxicity ---------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter("lang = 'en'").select("doc_id", "text", "lang")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    rows = toxicity.toxic_scores(docs, labels).filter("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 300
    hit = sum(r["predicted"] == 1 and r["toxic"] == 1 for r in rows)
    assert hit >= 0.85 * sum(r["toxic"] for r in rows) and hit >= 0.9 * sum(r["predicted"] for r in rows)


def test_all_labelled_rows_are_learnt_from(spark):
    """A word that only the labelled rows of largest hash hold: a sample of the smallest misses it."""
    ids = spark.range(11_000).select(F.col("id").alias("doc_id"), (F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0).alias("out"))
    late = [r[0] for r in ids.filter("not out").orderBy(F.xxhash64(F.lit(5), "doc_id").desc()).limit(600).collect()]
    out = [r[0] for r in ids.filter("out").limit(200).collect()]
    toxic = set(late) | set(out[:100])
    kept = [r[0] for r in ids.filter("not out").collect()] + out
    assert len(kept) - len(out) - len(late) > 8_000
    docs = spark.createDataFrame([(k, f"some {'grumble' if k in toxic else 'plain'} words number{k}", "en") for k in kept], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, int(k in toxic)) for k in kept], "doc_id long, toxic int")
    assert toxicity.labelled_rows(docs, labels).count() == len(kept) - len(out)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxic_scores(docs, labels).filter("held_out").collect()}
    assert all(got[k] == 1 for k in out[:100]) and not any(got[k] for k in out[100:])


def test_texts_without_a_label_are_not_shuffled(spark, tmp_path):
    """Of many texts few are labelled: texts go through one exchange, and only those of labelled rows."""
    spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"), F.lit("en").alias("lang")).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    labels = spark.range(0, 8_000, 40).select(F.col("id").cast("int").alias("doc_id"), (F.col("id") % 80 == 0).cast("int").alias("toxic"))
    expected = {r[0] for r in docs.join(labels, "doc_id").filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).select("text").collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = toxicity.labelled_rows(docs, labels)
        plan = found._jdf.queryExecution().executedPlan().toString()
        texts = [r["text"] for r in found.collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert set(texts) == expected and len(texts) == len(expected)
    dealt = plan.split("Exchange ")[1:]  # the texts' and the labels'
    assert len(dealt) == 2 and "ArrowEvalPython [may_be_known" in dealt[0]


def test_odd_texts_are_scored(spark):
    rows = [(k, "you idiot " * 3 + f"filler{k}", "en", k) for k in range(60)] + [(100 + k, f"fine words filler{k} here", "en", k) for k in range(60)]
    rows += [(300, None, None, 0), (301, "", "xx", 0), (None, "idiot", "en", 0), (302, "unseen tokens " * 40_000 + "idiot", "en", 0), (302, "fine", "en", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(60)] + [(None, 1), (7, None), (99, 1)], "doc_id long, toxic int")
    got = toxicity.toxic_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    by = {(r["doc_id"], k): r for k, r in enumerate(got)}
    score = {r["doc_id"]: r["predicted"] for r in by.values()}
    assert all(score[k] == 1 for k in range(60)) and all(score[100 + k] == 0 for k in range(60)) and score[None] == 1 and score[300] == score[301]
    assert max(r["predicted"] for r in got if r["doc_id"] == 302) == 1
    assert [r["held_out"] for r in got if r["doc_id"] is None] == [False]
    assert toxicity.toxic_scores(docs.limit(0), labels).count() == 0
    unknown = toxicity.toxic_scores(docs, labels.limit(0)).collect()
    assert len({r["score"] for r in unknown}) == 1 and not any(r["predicted"] or r["rejected"] for r in unknown)


def test_stretches_do_not_change_the_maximum(monkeypatch):
    m = toxicity.train(["good text", "bad word idiot"] * 20, np.array([0.0, 1.0] * 20), ["en"] * 40)
    rows = toxicity.bucket_rows("good text idiot word bad text " * 50, toxicity._Buckets())
    whole = m.pooled(rows)[0]
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    assert m.pooled(rows)[0] == pytest.approx(whole)


# --- token counts -----------------------------------------------------------------------


def test_totals_for_every_limit(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text", "source")
    docs = docs.union(spark.createDataFrame([(None, None), ("", None), ("<|endoftext|> " * 3, None), ("word " * 20_000, "src0")], "text string, source string"))
    with open(token_counts.VOCABULARY, "rb") as f:
        encode = token_counts.encoding(f.read()).encode_ordinary
    lengths = {}
    for r in docs.collect():
        lengths.setdefault(r["source"], []).append(len(encode(r["text"] or "")))
    answers = token_counts.suffix_answers(token_counts.length_histogram(docs))
    rows = answers.collect()
    assert len(rows) == sum(len(set(v)) for v in lengths.values())
    for r in rows:
        own, limit = lengths[r["source"]], r["context_limit"]
        assert r["n_docs"] == own.count(limit) and r["n_fit"] == sum(x <= limit for x in own) and r["n_longer"] == sum(x > limit for x in own)
        assert r["total_tokens"] == sum(own) and r["kept_tokens"] == sum(min(x, limit) for x in own)
        assert r["quantile"] == pytest.approx(sum(x <= limit for x in own) / len(own))
    limits = [0, 1, 77, 512, 4096, 10**6]
    got = {(r["source"], r["limit"]): (r["kept_tokens"], r["n_longer"]) for r in token_counts.truncated_totals(answers, limits).collect()}
    assert got == {(s, x): (sum(min(n, x) for n in own), sum(n > x for n in own)) for s, own in lengths.items() for x in limits}
    quantiles = {(r["source"], r["share"]): r["n_tokens"] for r in token_counts.length_quantiles(answers, [0.5, 1.0]).collect()}
    for s, own in lengths.items():
        assert quantiles[s, 1.0] == max(own) and quantiles[s, 0.5] == sorted(own)[math.ceil(len(own) / 2) - 1]
    assert token_counts.suffix_answers(token_counts.length_histogram(docs.limit(0))).count() == 0


def test_long_runs_are_counted_as_short_ones_are(monkeypatch):
    """Texts cut by the pattern elsewhere have the encoder's tokens; runs that overflow it are counted."""
    import random

    with open(token_counts.VOCABULARY, "rb") as f:
        known = token_counts.encoding(f.read())
    rng = random.Random(2)
    parts = ["a" * 30, "é" * 21, "7" * 25, "%$" * 15, " " * 40, "\n" * 23, " \t\u00a0\u2003" * 9, "it's", " we'll", "\x1c\x85", "𝔘ß", "\u0301", " x", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    plain = [token_counts.token_count(t, known) for t in texts]
    assert plain == [len(known.encode(t, disallowed_special=())) for t in texts]
    monkeypatch.setattr(token_counts, "LONG", 1)
    monkeypatch.setattr(token_counts, "_LONG", token_counts.regex.compile("(?s)."))
    assert [token_counts.token_count(t, known) for t in texts] == plain
    monkeypatch.undo()
    one = known._encode_single_piece("a" * 1000)
    assert token_counts.token_count("a" * 1_000_000, known) == len(known._encode_single_piece("a" * 1_000_000)) > len(one)
    assert token_counts.token_count("x" + " " * 1_000_000 + "y", known) >= 3


# --- HTML -------------------------------------------------------------------------------

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body class="has-sidebar"><header>Site</header><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">Cookies?</div><div id="main"><div class="post p{n}"><h1>Head &amp; tail</h1><p>First <b>bo</b>ld<br>line<p>Second&nbsp;par\n\n  here &lt;3'
    '<script>var x = "</p><p>no";</script><form><input>Sign<button>up</button></form><ul><li>One<li>Two</ul><div class="ad">Buy</div>{more}</div>'
    '<div class="comments"><p>Great article, really long comment text goes here and on and on</p></div></div><aside>Side</aside><!-- gone --><footer>&copy; Foot</footer></body></html>'
)
TEXT = "Head & tail First bold line Second par here <3 One Two"


def test_pages(spark):
    rows = [(k, f"http://Host.example/{k}", PAGE.format(n=k, more="")) for k in range(9)]
    rows += [(20, "https://host.example:80/x", PAGE.format(n=1, more="<p>Cut <a href=x>link").split("</div><div class=\"comments")[0])]
    rows += [(21, None, None), (22, "", ""), (23, "not a url", "plain &amp; text"), (24, "http://other/", "<p>one<p>two<td>three</td>"), (24, "http://other/", "<p>one<p>two<td>three</td>")]
    rows += [(25, "http://long/", "<article>" + "<p>word word</p>" * 30_000 + "</article>"), (26, "http://deep/", "<div>" * 3000 + "deep" + "</div>" * 3000), (27, "http://broken/", "<a href='x <b>text</b> <p")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    got = html_extract.main_texts(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {r["page_id"]: r["text"] for r in got}
    assert all(text[k] == TEXT for k in range(9))
    assert text[20] == TEXT + " Cut link" and text[21] == text[22] == "" and text[23] == "plain & text" and text[24] == "one two three"
    assert text[25] == " ".join(["word word"] * 30_000) and text[26] == "deep"
    assert html_extract.main_texts(df.limit(0)).count() == 0


def test_hosts_agree_on_a_path(spark):
    usual = "<body><div class='box'><p>{0}</p></div><div class='tail'><p>{1}</p></div></body>"
    rows = [(k, "http://h/", usual.format("main text " * 30, "x")) for k in range(9)] + [(9, "http://h/", usual.format("short", "tail text " * 90))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_extract.main_texts(df).collect()}[9] == "short"


def test_synthetic_pages_are_their_articles(spark):
    import re
    from html import unescape

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(pages).collect()}
    for r in pages.collect():
        inner = r["html"].split("<article>")[1].split("</article>")[0]
        assert got[r["page_id"]] == " ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inner))).split())


def test_names_and_titles_do_not_cut_the_article():
    html = (
        "<body><article><h2 id='search'>Search</h2><section id='related-work'><p>Related work</p></section><ol><li id='form-2'>Item</ol>"
        "<p><span class='ad-hoc'>Ad hoc</span> <a title='The hidden forest' href=x>forest</a> <math><mi>x</mi></math></p>"
        "<div class='cookie-notice'>no</div><ul class='share'><li>no</ul><p hidden>no</p><p style='display: none'>no</p></article></body>"
    )
    assert html_extract.text_of([html_extract.parsed(html)]) == "Search Related work Item Ad hoc forest x"


def test_blocks_beside_the_body_stay(spark):
    """Pages without an article keep title, lead and closing block, however long the body, and a
    page of a minority template on the host keeps its text."""
    page = "<body><nav>Menu</nav><div id=main><div class=title><h1>Title {0}</h1></div><div class=lead><p>Lead</div><div class=body><p>{1}</p></div><div class=end>End</div></div></body>"
    rows = [(k, "http://h/", page.format(k, "long text " * 400)) for k in range(9)] + [(9, "http://h/", page.format(9, "short"))]
    rows += [(10, "http://h/", "<body><div class=body><p>teaser</p></div><div class=story><p>" + "other text " * 50 + "</p></div></body>")]
    rows += [(20 + k, "http://g/", "<body><div class=body><p>" + "words " * 50 + "</p></div></body>") for k in range(9)]
    rows += [(30, "http://g/", "<body><div class=body><p>teaser</p></div><div class=story><p>" + "other text " * 50 + "</p></div></body>")]
    got = {r["page_id"]: r["text"] for r in html_extract.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(10):
        assert got[k] == f"Title {k} Lead " + ("long text " * 400 if k < 9 else "short ") + "End"
    assert got[10] == got[30] == "teaser " + ("other text " * 50).strip() and got[20] == ("words " * 50).strip()
