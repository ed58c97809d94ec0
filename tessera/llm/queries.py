"""The queries op1 to op10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .exact_dedup import exact_dedup
from .iso_media import media_features, store_media
from .mixing import mix
from .ngram_join import ngram_jaccard_join
from .quality import classify, held_out, train_on_labels
from .sentencepiece_codec import piece_digests
from .token_counts import count_tokens
from .token_files import token_file_digests
from .url_filter import filter_urls
from .warc import warc_round_trip


def tokenizer(name: str) -> str:
    """Path of a vocabulary file; these aren't part of the repository."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = train_on_labels(docs, _table(spark, sf_dir, "labels"))
    return classify(docs, net, carry=["doc_id"]).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_iso_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(_table(spark, sf_dir, "documents"), carry=["doc_id"]))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(_table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(_table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"), carry=["doc_id"])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "domain", "lang", "source", "tokens", "epochs", "copies", "cut_tokens")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), 1024, carry=["doc_id"])


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY payload) ELSE page_id END AS holder FROM p)
SELECT page_id, n AS payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN holder = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN holder != page_id THEN holder END AS refers_to
FROM q
"""

_AFTER = "CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END"
_CANONICAL = """CASE WHEN host = '' THEN NULL ELSE 'https://' || regexp_replace(host, '^(www|m)\\.', '') || regexp_replace(path, '(\\.html?|/)+$', '')
  || regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*(\\?[^#]*)', 1), '([?&])((utm_[a-z]+|ref|fbclid|gclid)=[^&]*(&|$))+', '\\1', 'g'), '[?&]$', '') END"""
_RULE = """CASE WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""
#: Without links inside the pages, which the tables don't have, a URL's only alias is its canonical form.
OP5_SQL = f"""
WITH parts AS (SELECT *, coalesce(translate(regexp_extract({_AFTER}, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
  coalesce(regexp_extract({_AFTER}, '^[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
judged AS (SELECT *, {_RULE} AS rule, {_CANONICAL} AS canonical FROM parts),
target AS (SELECT DISTINCT canonical, regexp_extract(canonical, '://([^/?#]*)', 1) AS host, regexp_extract(canonical, '://[^/?#]*([^?#]*)', 1) AS path FROM judged WHERE canonical IS NOT NULL),
rules AS (SELECT canonical, rule FROM judged WHERE canonical IS NOT NULL UNION ALL SELECT canonical, {_RULE} FROM target),
says AS (SELECT canonical, bool_or(rule IN ('net/', 'example.com/de/')) AS blocked, bool_or(rule IN ('example.net/en/', 'org/fr/')) AS allowed FROM rules GROUP BY canonical)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN coalesce(blocked, false) AND NOT coalesce(allowed, false) THEN 'block' ELSE 'allow' END AS verdict
FROM judged LEFT JOIN says USING (canonical)
"""

OP8_SQL = f"""
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS content FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(content) AS text_sha256
FROM t WINDOW w AS (PARTITION BY content)
"""


def _fill(nodes: str, parents: str, name: str) -> str:
    """One level of budgets, as in the operator: ``nodes`` has weight, capacity and its parent's budget."""
    group = f"PARTITION BY {parents}" if parents else ""
    before = f"({group} ORDER BY ratio, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""SELECT * EXCLUDE (budget, lvl, sat), CASE WHEN sat THEN capacity ELSE weight * max(CASE WHEN NOT sat THEN lvl END) OVER ({group}) END AS budget
  FROM (SELECT *, ratio <= lvl * (1 + 1e-12) AS sat FROM (SELECT *, (budget - coalesce(sum(capacity) OVER {before}, 0.0)) / (sum(weight) OVER ({group}) - coalesce(sum(weight) OVER {before}, 0.0)) AS lvl
  FROM (SELECT *, capacity / weight AS ratio FROM ({nodes}))))"""


_W1 = "CASE domain WHEN 'curated' THEN 2.0::DOUBLE ELSE 1.0 END"
_W2 = "CASE lang WHEN 'en' THEN 2.0::DOUBLE ELSE 1.0 END"
OP7_SQL = f"""
WITH d AS (SELECT doc_id, CASE WHEN substr(md5(coalesce(source, '')), 1, 1) < '8' THEN 'curated' ELSE 'web' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS total FROM d GROUP BY ALL),
l1 AS (SELECT domain, {_W1} AS weight, sum(total * 4)::DOUBLE AS capacity FROM leaf GROUP BY ALL),
b1 AS ({_fill("SELECT *, least(floor(0.9::DOUBLE * (SELECT sum(total) FROM leaf)), sum(capacity) OVER ()) AS budget FROM l1", "", "domain")}),
l2 AS (SELECT domain, lang, {_W2} AS weight, sum(total * 4)::DOUBLE AS capacity FROM leaf GROUP BY ALL),
b2 AS ({_fill("SELECT l2.*, b1.budget FROM l2 JOIN b1 USING (domain)", "domain", "lang")}),
l3 AS (SELECT domain, lang, source, 1.0::DOUBLE AS weight, (total * 4)::DOUBLE AS capacity, total FROM leaf),
b3 AS ({_fill("SELECT l3.*, b2.budget FROM l3 JOIN b2 USING (domain, lang)", "domain, lang", "source")}),
plan AS (SELECT domain, lang, source, total, floor(budget + 1e-6)::BIGINT AS budget FROM b3),
e AS (SELECT *, CASE WHEN total > 0 THEN budget // total ELSE 0 END AS epochs FROM plan),
k AS (SELECT d.*, epochs, budget - epochs * total AS rest, ('0x' || substr(md5('11:' || epochs || ':' || doc_id), 1, 15))::BIGINT AS key FROM d JOIN e USING (domain, lang, source)),
c AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY key, doc_id) AS through FROM k)
SELECT doc_id, domain, lang, source, tokens::BIGINT AS tokens, epochs, epochs + CASE WHEN rest > 0 AND through <= rest THEN 1 ELSE 0 END AS copies,
  CASE WHEN through > rest AND through - tokens < rest THEN rest - (through - tokens) ELSE 0 END::BIGINT AS cut_tokens FROM c
"""

QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_quality": op2_quality,
    "op3_warc": op3_warc,
    "op4_iso_media": op4_iso_media,
    "op5_url_filters": op5_url_filters,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_mixing": op7_mixing,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_token_files": op9_token_files,
    "op10_token_counts": op10_token_counts,
}
#: The others are no SQL: tests hold them against the libraries, brute force, round trips or held-out labels.
ORACLE_SQL = {"op3_warc": OP3_SQL, "op5_url_filters": OP5_SQL, "op7_mixing": OP7_SQL, "op8_exact_dedup": OP8_SQL}
