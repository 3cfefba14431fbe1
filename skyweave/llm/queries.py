"""One query per operator over its whole table, and its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyweave.llm.bestfit import packed_documents
from skyweave.llm.conversations import repaired
from skyweave.llm.decontaminate import contamination
from skyweave.llm.hmm import scored
from skyweave.llm.kdshards import sharded
from skyweave.llm.langid import identified
from skyweave.llm.linededup import line_digests
from skyweave.llm.quality import quality_verdicts
from skyweave.llm.secret_scan import found_secrets
from skyweave.llm.simhash import simhash_groups
from skyweave.llm.texts import prepare
from skyweave.llm.tokens import token_counts
from skyweave.llm.warc import archived_pages
from skyweave.llm.whitening import whitened

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    """Where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op3_simhash_groups(spark, sf_dir):
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id"
    )


@_query
def op5_best_fit_packing(spark, sf_dir):
    return packed_documents(_table(spark, sf_dir, "documents"), vocabulary(), capacity=1024)


@_query
def op10_token_counts(spark, sf_dir):
    return token_counts(_table(spark, sf_dir, "documents"), vocabulary(), limit=1024)


@_query
def op9_quality_rules(spark, sf_dir):
    return quality_verdicts(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@_query
def op7_benchmark_decontamination(spark, sf_dir):
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query
def op6_secret_scan(spark, sf_dir):
    return found_secrets(_table(spark, sf_dir, "documents"))


@_query
def op1_warc_archives(spark, sf_dir):
    pages = archived_pages(_table(spark, sf_dir, "pages"), payloads=False)
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op1_warc_archives"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha1(coalesce(html, '')) AS digest FROM pages
), g AS (
  SELECT digest, size, max(page_id) AS first_id FROM p WHERE size >= 1000 GROUP BY digest, size HAVING count(*) > 1
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (digest, size)"""


@_query
def op2_kd_tree_shards(spark, sf_dir):
    return sharded(_table(spark, sf_dir, "documents"), 8)


@_query
def op8_language_id(spark, sf_dir):
    return identified(_table(spark, sf_dir, "documents"))


@_query
def op4_hidden_markov_scores(spark, sf_dir):
    return scored(_table(spark, sf_dir, "documents"))


@_query
def op11_line_dedup(spark, sf_dir):
    return line_digests(_table(spark, sf_dir, "documents"), min_docs=10)


_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
ORACLES["op11_line_dedup"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents
), l AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS place FROM d
), k AS (
  SELECT *, translate(trim(line, {_BLANKS}), {_AZ}) AS key FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), marked AS (
  SELECT k.*, common.key IS NOT NULL AS gone FROM k LEFT JOIN common USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r"""


@_query
def op12_embedding_whitening(spark, sf_dir):
    return whitened(_table(spark, sf_dir, "embeddings"), components=16)


@_query
def op13_conversation_repair(spark, sf_dir):
    return repaired(_table(spark, sf_dir, "conversations"))


# DuckDB has no CRC-32: bit by bit over the characters of ``conv:turn``, which are ASCII.
_CRC_BIT = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
_CRC_BYTE = "list_reduce([{start}, 1, 2, 3, 4, 5, 6, 7, 8], lambda c, _: " + _CRC_BIT.format(x="c") + ")"
ORACLES["op13_conversation_repair"] = f"""
WITH RECURSIVE src AS (
  SELECT row_number() OVER () AS r, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations
), crc AS (
  SELECT name, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT name FROM src)
  UNION ALL
  SELECT name, i + 1, {_CRC_BYTE.format(start="CAST(xor(c, ascii(substr(name, i + 1, 1))) AS BIGINT)")} FROM crc WHERE i < length(name)
), kinds AS (
  SELECT name, xor(c, 4294967295) % 20 AS kind FROM crc WHERE i = length(name)
), hit AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src JOIN kinds USING (name) WHERE kind <> 0
), convs AS (
  SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)
), placed AS (
  SELECT k, turn, role, text, left(role, 1) AS ini, rtrim(text, {_BLANKS}) AS solid,
         row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text, copy) AS i,
         row_number() OVER (PARTITION BY k, role, text ORDER BY turn NULLS FIRST, copy) AS seen
  FROM hit h JOIN convs c ON h.conv_id IS NOT DISTINCT FROM c.conv_id
), e AS (
  SELECT *, CASE WHEN solid = '' THEN 1 WHEN seen > 1 THEN 2 WHEN right(solid, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
         lag(ini) OVER (PARTITION BY k ORDER BY i) || ini AS pair FROM placed
), inserted(p, q, c, a, made) AS (
  VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 5, 'I', ['user:']),
         (0, 3, 10, 'II', ['user:', 'assistant:']), (1, 2, 5, 'I', ['user:']), (1, 3, 10, 'II', ['user:', 'assistant:']),
         (2, 3, 5, 'I', ['assistant:']), (3, 2, 5, 'I', ['user:'])
), step(q, ini, r) AS (
  VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), edits AS (
  SELECT k, i, q, q AS r, 2 AS c, 'D' AS a, []::VARCHAR[] AS made FROM e, (VALUES (0), (1), (2), (3)) s(q)
  UNION ALL
  SELECT k, i, q, r, CASE WHEN fault = 3 THEN 5 ELSE 0 END, 'K', [role || ':' || text] FROM e JOIN step USING (ini) WHERE fault IN (0, 3)
  UNION ALL
  SELECT k, i, q, r, CASE WHEN fault = 3 THEN 6 ELSE 1 END, 'R', [CASE s.ini WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM e, step s WHERE fault IN (0, 3) AND s.ini <> 's'
), dp AS (
  SELECT k, CAST(0 AS BIGINT) AS i, 0 AS st, {{'c': 0, 'a': '', 'made': []::VARCHAR[]}} AS best FROM convs
  UNION ALL
  SELECT d.k, d.i + 1, o.r, min({{'c': best.c + n.c + o.c, 'a': best.a || n.a || o.a, 'made': best.made || n.made || o.made}})
  FROM dp d JOIN inserted n ON n.p = d.st JOIN edits o ON o.k = d.k AND o.i = d.i + 1 AND o.q = n.q GROUP BY d.k, d.i, o.r
), done AS (
  SELECT d.k, min({{'c': best.c + n.c, 'a': best.a || n.a, 'made': best.made || n.made}}) AS b
  FROM dp d JOIN inserted n ON n.p = d.st AND n.q IN (0, 3)
  JOIN (SELECT k, coalesce(max(i), 0) AS last FROM convs LEFT JOIN e USING (k) GROUP BY k) l ON l.k = d.k AND l.last = d.i GROUP BY d.k
)
SELECT any_value(conv_id) AS conv_id, CASE WHEN count(turn) = 0 THEN 0 ELSE max(turn) - min(turn) + 1 - count(DISTINCT turn) END AS gaps,
       count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
       count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, CAST(any_value(b.c) AS BIGINT) AS cost, any_value(b.a) AS audit,
       sha256(array_to_string(any_value(b.made), chr(10))) AS repaired_sha256
FROM convs LEFT JOIN e USING (k) JOIN done USING (k) GROUP BY k"""


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), {az}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(az=_AZ)
ORACLES["op7_benchmark_decontamination"] = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS m FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, m, array_to_string(w[i : i + m - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - m + 2)) AS i FROM b)
), dw AS (
  SELECT r, m, i, array_to_string(w[i : i + m - 1], ' ') AS win
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m)
), hit AS (
  SELECT r, m, i, item_id FROM dw JOIN bw USING (m, win)
), marks AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY r
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(ids, sha256('')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN marks USING (r) LEFT JOIN items USING (r)"""
