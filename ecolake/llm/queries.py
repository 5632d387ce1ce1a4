"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ecolake.llm import (
    collocations,
    decontamination,
    embeddings,
    html_extract,
    lm_scoring,
    mixing,
    prefix_trie,
    quality,
    sharding,
    simhash,
    token_counts,
    toxicity,
    warc,
)

SHARDS = 40


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 40 shards whose counts differ by one at most."""
    text = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = _table(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law")
    )
    return sharding.shard_uniformly(docs, SHARDS).withColumn("grown_shard", F.lit(None).cast("int"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the share of each item's shingles."""
    return decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), short_items=True)


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every text under the lattice model, beside a word count baseline."""
    return lm_scoring.document_scores(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back by byte ranges."""
    return warc.archived_pages(spark, _table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    return toxicity.toxic_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector at a cosine of 0.95 or more."""
    return embeddings.embedding_classes(_table(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document at three differing bits or fewer."""
    found = simhash.simhash_classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source and length: totals, quantile and truncated total with it as context limit."""
    return token_counts.suffix_answers(token_counts.length_histogram(_table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mixed_counts(_table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_extract.main_texts(_table(spark, sf_dir, "pages"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the prefix trie of the rebuilt conversations."""
    return prefix_trie.conversation_trie(_table(spark, sf_dir, "conversations"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding, op2_decontamination, op3_lm_scoring, op4_warc, op5_toxicity, op6_embedding_dedup, op7_simhash, op8_token_counts, op9_mixing, op10_html,
        op11_prefix_trie, op12_collocations, op13_quality,
    )
}

# SQL can express these. The others draw at random, learn, or need hashes, tokenizers or trees
# that DuckDB lacks, and are tested against brute force in tests/llm.
_WORDS = "SELECT {key} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS w FROM {table}"
_RUNS = "SELECT DISTINCT id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM ({of}), unnest(range(1, len(w) - k + 2)) AS u(i)"
# CRC-32 bit by bit, over the decimal digits.
_CRC = """xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
 lambda crc, b: list_reduce(list_prepend(xor(crc, b), CAST(range(8) AS BIGINT[])), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)))))"""
_TRIE = f"""WITH t AS (SELECT conv_id, list(struct_pack(r := coalesce(role, ''), x := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
 FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, CAST({_CRC.format("conv_id")} % 9 AS BIGINT) AS h FROM t),
c AS (SELECT h.conv_id, list_concat(coalesce(b.own[1 : h.h], []), h.own[h.h + 1 :]) AS s FROM h LEFT JOIN t AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
p AS (SELECT conv_id, d, s[1 : d] AS s, len(s) = d AS ends FROM c, unnest(range(len(s) + 1)) AS u(d)),
n AS (SELECT s, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY s, d),
k AS (SELECT a.s, a.d, a.conv_id, a.n_convs, a.ends_sha256, b.conv_id AS parent, (a.n_convs - 1) * strlen(coalesce(a.s[-1].x, '')) AS saved,
 NOT EXISTS (SELECT 1 FROM n AS z WHERE z.d = a.d + 1 AND z.s[1 : a.d] = a.s) AS leaf FROM n AS a LEFT JOIN n AS b ON b.d = a.d - 1 AND b.s = a.s[1 : a.d - 1]),
u AS (SELECT m.s[1 : e] AS s, e AS d, count(*) FILTER (m.d = e + 1) AS n_children, count(*) FILTER (m.leaf) AS n_leaves, sum(m.saved) AS saved_tokens FROM k AS m, unnest(range(m.d + 1)) AS v(e) GROUP BY 1, 2)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, k.parent AS parent_conv_id, k.n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM k JOIN u USING (s, d)"""
_PHRASES = r"""WITH q AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM q)),
g AS (SELECT lang, array_to_string(w[i : i + k - 1], ' ') AS s, k, count(*) AS f FROM w, unnest(range(1, len(w) + 1)) AS a(i), unnest(range(1, 6)) AS b(k) WHERE i + k - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
c AS (SELECT lang, s, string_split(s, ' ') AS v, k, f FROM g WHERE k > 1),
m AS (SELECT lang, s, max(f) AS f FROM (SELECT lang, array_to_string(v[i : i + j - 1], ' ') AS s, f FROM c, unnest(range(1, 6)) AS a(i), unnest(range(2, 5)) AS b(j) WHERE j < k AND i + j - 1 <= k) GROUP BY ALL),
o AS (SELECT c.* FROM c LEFT JOIN m USING (lang, s) WHERE m.f IS NULL OR 100 * m.f < 100 * c.f),
x AS (SELECT o.lang, o.s, o.f AS a, y.f AS l, z.f AS r, n.n, h, CAST(1000 AS HUGEINT) * o.f * n.n // (CAST(y.f AS HUGEINT) * z.f) AS score FROM o, unnest(range(1, 5)) AS u(h), g AS y, g AS z, n
 WHERE h < o.k AND y.lang = o.lang AND z.lang = o.lang AND n.lang = o.lang AND y.s = array_to_string(o.v[: h], ' ') AND z.s = array_to_string(o.v[h + 1 :], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, h) = 1),
t AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(s)) AS rank, s AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM b)
SELECT * FROM t WHERE rank <= 2000"""
ORACLE: dict[str, str] = {
    # items of fewer than five words are one run of all their words
    "op2_decontamination": f"""WITH b AS ({_RUNS.format(of="SELECT id, w, least(5, len(w)) AS k FROM (" + _WORDS.format(key="item_id", table="benchmark") + ") WHERE len(w) > 0")}),
d AS ({_RUNS.format(of="SELECT id, w, k FROM (" + _WORDS.format(key="doc_id", table="documents") + "), (SELECT DISTINCT k FROM b)")}),
n AS (SELECT id, count(*) AS n FROM b GROUP BY id),
c AS (SELECT d.id AS doc_id, b.id AS item_id, count(*) AS shared FROM d JOIN b USING (k, s) GROUP BY d.id, b.id)
SELECT doc_id, item_id, shared, n AS n_shingles, CAST(shared AS DOUBLE) / n AS containment FROM c JOIN n ON item_id = id WHERE shared >= 0.8 * n - 1e-9""",
    "op11_prefix_trie": _TRIE,
    "op12_collocations": _PHRASES,
    "op4_warc": """WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, '')) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)""",
}
