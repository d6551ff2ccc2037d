"""The thin queries that apply each operator to its whole table, and their SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equity_jobs.llm import covertree, imatch, kmeans_tree, langid, mixing, pieces, pii, repair, resample, secret_scan, simhash, urlrules, warc
from equity_jobs.llm.common import table

MODEL = "piece_bpe_32k.model"
URL_RULES = ["block net/", "allow example.net/en/", "block example.com/de/", "allow org/fr/"]


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"), split_bytes=4 << 20)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), model_path())


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_likeness(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge_urls(table(spark, sf_dir, "pages"), urlrules.rules_frame(spark, URL_RULES))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: str, spans: Column) -> Column:
    return F.size(F.filter(spans["kind"], F.lit(kind).__eq__)).cast("bigint").alias(f"n_{kind}")


def op6_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", "spans", base.alias("base")).select("doc_id", *(_count(k, F.col("base")) for k in pii.KINDS), F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.learn(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.identify(docs, model).withColumn("held_out", langid.held_out(F.col("doc_id")))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


MIX_TARGETS = {"high": 0.8, "low": 0.2, "toxic": 0.0}
MIX_KEPT = ["high", "low"]


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    mixed, domains = mixing.mix(docs, mixing.domain_of(labels), MIX_TARGETS, MIX_KEPT)
    posteriors = [F.round(F.get("p", i), 6).alias(f"p_{d}") for i, d in enumerate(domains)]
    return mixed.select("doc_id", F.col("tokens").cast("bigint").alias("tokens"), *posteriors, F.round("rate", 6).alias("rate"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.top_k(table(spark, sf_dir, "embeddings"))


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "format")
    counts = [_count(k, F.col("spans")) for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans_tree.nearest(table(spark, sf_dir, "embeddings"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.summary(repair.repair(repair.damaged(table(spark, sf_dir, "conversations"))))


OP4_SQL = """
WITH parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(verdict, rule_host, rule_path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT p.*, r.verdict, r.rule_host || r.rule_path AS rule
  FROM parts p LEFT JOIN rules r ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)),
best AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS n FROM fits)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best WHERE n = 1
"""

OP1_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
f AS (SELECT payload, min(page_id) AS first FROM p GROUP BY payload),
d AS (SELECT p.page_id, strlen(p.payload)::BIGINT AS payload_bytes, sha1(p.payload) AS hex, f.first FROM p JOIN f USING (payload)),
bits AS (
  SELECT *, list_aggregate(list_transform(range(0, 4), lambda i: list_aggregate(list_transform(range(0, 8), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, (1 + 10 * i)::BIGINT, 10))::BIGINT >> (35 - 5 * j)::BIGINT) & 31)::INTEGER, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM bits
"""

OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

#: crc(s, c): CRC-32 of every string of asked(s). The register is linear: each byte adds what it
#: becomes after the bytes that follow it, and the length adds what the initial ones become.
CRC_SQL = """
crc_bytes(b, c) AS (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384)) FROM range(256) r(i)),
crc_most(n) AS (SELECT coalesce(max(strlen(s)), 0) FROM asked),
crc_after(d, b, c) AS (
  SELECT 0::BIGINT, b, c FROM crc_bytes
  UNION ALL SELECT d + 1, r.b, xor(t.c, r.c >> 8) FROM crc_after r JOIN crc_bytes t ON t.b = (r.c & 255) JOIN crc_most m ON d + 1 < m.n),
crc_start(n, c) AS (
  SELECT 0::BIGINT, 4294967295::BIGINT
  UNION ALL SELECT r.n + 1, xor(t.c, r.c >> 8) FROM crc_start r JOIN crc_bytes t ON t.b = (r.c & 255) JOIN crc_most m ON r.n < m.n),
crc_hex AS (SELECT DISTINCT s, hex(encode(s)) AS h, strlen(s) AS n FROM asked WHERE s <> ''),
crc_each AS (SELECT s, h, n, unnest(range(n)) AS i FROM crc_hex),
crc AS (
  SELECT e.s, xor(xor(bit_xor(a.c), any_value(l.c)), 4294967295) AS c
  FROM crc_each e JOIN crc_after a ON a.d = e.n - 1 - e.i AND a.b = ('0x' || substr(e.h, (2 * e.i + 1)::BIGINT, 2))::BIGINT JOIN crc_start l ON l.n = e.n
  GROUP BY e.s)"""

OP11_SQL = f"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS k, doc_id, text, true AS own FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, text, false FROM benchmark),
lists AS (SELECT k, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
words AS (SELECT k, own, unnest(w) AS w, unnest(range(len(w))) AS i FROM lists),
follow AS (SELECT k, own, w, lead(w, 1) OVER p AS w2, lead(w, 2) OVER p AS w3 FROM words WINDOW p AS (PARTITION BY k ORDER BY i)),
runs AS (
  SELECT k, own, w AS s FROM follow UNION ALL SELECT k, own, w || ' ' || w2 FROM follow WHERE w2 IS NOT NULL
  UNION ALL SELECT k, own, w || ' ' || w2 || ' ' || w3 FROM follow WHERE w3 IS NOT NULL),
held AS (SELECT k, own, s, count(*) AS n FROM runs GROUP BY ALL),
asked AS (SELECT DISTINCT s FROM held),
{CRC_SQL},
placed AS (SELECT k, own, n, c % 10000 AS bucket FROM held JOIN crc USING (s)),
sums AS (SELECT coalesce(sum(n) FILTER (own), 0)::DOUBLE AS all_s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS all_t FROM placed),
counts AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM placed GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (all_s + 10000) / ((s + 1) * (all_t + 10000))))::BIGINT AS g FROM counts, sums),
weights AS (SELECT k, sum(n)::BIGINT AS n_features, sum(n * g)::BIGINT AS weight FROM placed JOIN gain USING (bucket) WHERE own GROUP BY k),
scored AS (
  SELECT t.k, t.doc_id, coalesce(w.n_features, 0) AS n_features, coalesce(w.weight, 0) AS weight, len(l.w) AS n_words,
         coalesce(w.weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || t.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM texts t JOIN lists l USING (k) LEFT JOIN weights w USING (k) WHERE t.own),
ranks AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_words >= 20),
size AS (SELECT 5 * count(*) // 100 AS n FROM ranks)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= size.n THEN r END AS rank FROM scored LEFT JOIN ranks USING (k), size
"""

OP13_SQL = f"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
asked AS (SELECT DISTINCT s FROM given),
{CRC_SQL},
planted AS (SELECT g.*, c % 20 AS f FROM given g JOIN crc USING (s)),
spoilt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN f = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM planted WHERE f <> 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen,
         lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
  FROM spoilt),
rows_ AS (
  SELECT conv_id, turn, role, text, n, before, role[1:1] AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' END AS fault
  FROM placed),
-- state, inserted turn, its letter and price, then the wanted initial (D: none, the row goes) and the next state
moves(st, turn_in, letter, price, wanted, nxt) AS (VALUES
  ('0', NULL, '', 0, 's', 'S'), ('0', NULL, '', 0, 'u', 'U'), ('0', 'user:', 'I', 3, 'a', 'A'), ('S', NULL, '', 0, 'u', 'U'), ('S', 'user:', 'I', 3, 'a', 'A'),
  ('U', NULL, '', 0, 'a', 'A'), ('U', 'assistant:', 'I', 3, 'u', 'U'), ('A', NULL, '', 0, 'u', 'U'), ('A', 'user:', 'I', 3, 'a', 'A'),
  ('0', NULL, '', 4, 'D', '0'), ('S', NULL, '', 4, 'D', 'S'), ('U', NULL, '', 4, 'D', 'U'), ('A', NULL, '', 4, 'D', 'A')),
paths(conv_id, n, st, best) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '0', {{'cost': 0::BIGINT, 'audit': '', 'said': []::VARCHAR[]}} FROM conversations
  UNION ALL
  SELECT p.conv_id, p.n + 1, m.nxt, min({{
    'cost': p.best.cost + m.price + CASE WHEN m.wanted = 'D' THEN 0 ELSE CASE WHEN m.wanted = r.initial THEN 0 ELSE 3 END + CASE WHEN r.fault = 'truncated' THEN 3 ELSE 0 END END,
    'audit': p.best.audit || m.letter || CASE WHEN m.wanted = 'D' THEN 'D' WHEN m.wanted = r.initial THEN 'K' ELSE 'R' END,
    'said': list_concat(p.best.said, CASE WHEN m.turn_in IS NULL THEN [] ELSE [m.turn_in] END,
      CASE WHEN m.wanted = 'D' THEN [] WHEN m.wanted = r.initial THEN [r.role || ':' || r.text] WHEN m.wanted = 'u' THEN ['user:' || r.text] ELSE ['assistant:' || r.text] END)}})
  FROM paths p JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.n = p.n + 1 JOIN moves m ON m.st = p.st
  WHERE m.wanted = 'D' OR (coalesce(r.fault, '') NOT IN ('blank', 'duplicate') AND (m.wanted = r.initial OR m.wanted IN ('u', 'a')))
  GROUP BY p.conv_id, p.n, m.nxt),
ends(st, letters, added) AS (VALUES ('0', '', []::VARCHAR[]), ('A', '', []), ('U', 'I', ['assistant:']), ('S', 'II', ['user:', 'assistant:'])),
sizes AS (SELECT c.conv_id, coalesce(max(r.n), 0) AS n FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN rows_ r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id),
final AS (
  SELECT p.conv_id, min({{'cost': p.best.cost + 3 * strlen(e.letters), 'audit': p.best.audit || e.letters, 'said': list_concat(p.best.said, e.added)}}) AS best
  FROM paths p JOIN sizes s ON s.conv_id IS NOT DISTINCT FROM p.conv_id AND s.n = p.n JOIN ends e ON e.st = p.st GROUP BY p.conv_id),
tally AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM rows_ GROUP BY conv_id)
SELECT f.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, f.best.cost::BIGINT AS cost, f.best.audit AS audit, sha256(array_to_string(f.best.said, chr(10))) AS repaired_sha256
FROM final f LEFT JOIN tally t ON t.conv_id IS NOT DISTINCT FROM f.conv_id
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_imatch": op3_imatch,
    "op4_url_filters": op4_url_filters,
    "op5_mixing": op5_mixing,
    "op6_personal_data": op6_personal_data,
    "op7_language_id": op7_language_id,
    "op8_simhash": op8_simhash,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_secret_scans": op10_secret_scans,
    "op11_resampling": op11_resampling,
    "op12_nearest": op12_nearest,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {"op1_warc": OP1_SQL, "op4_url_filters": OP4_SQL, "op9_exact_top_k": OP9_SQL, "op11_resampling": OP11_SQL, "op13_conversation_repair": OP13_SQL}
