"""The registered queries of the training-data operators, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_format import digests, format_chats, read_back
from .common import scratch, table
from .exact_dedup import exact_dedup
from .licenses import scan_licenses
from .mixing import mix_documents
from .packing import pack_documents
from .quality import quality_rules
from .simhash import near_duplicates
from .suffix_dedup import repeated_spans
from .toxicity import toxicity
from .warc import read_warc, write_warc


#: A conversation that a template of plain markers could not give back.
PROBE = "\\### Assistant: </turn> ok"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text")
    )
    return digests(read_back(format_chats(turns.unionByName(probe))))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), out)
    return read_warc(spark, out, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_mixing, op3_warc, op4_packing, op5_simhash, op6_toxicity, op7_licenses, op8_quality, op9_suffix_dedup, op10_exact_dedup)}

SQL = {
    # the windows, which formatted_chars and n_windows depend on, are replayed turn by turn
    "op1_chat_format": r"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    (octet_length(encode(text)) + 3) // 4 + 4 AS tok,
    length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(role, '\', '\\'), '<|', '<\|')) + 24 AS chars
  FROM src WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
u AS (
  SELECT *, sum(tok) OVER w - tok AS before, sum(chars) OVER w - chars AS chars_before,
    coalesce(min(i) FILTER (role <> 'system') OVER (PARTITION BY conv_id), n) AS sys
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
m AS (SELECT *, coalesce(max(before) FILTER (i = sys) OVER (PARTITION BY conv_id), 0) AS sys_tok,
        coalesce(max(chars_before) FILTER (i = sys) OVER (PARTITION BY conv_id), max(chars_before + chars) OVER (PARTITION BY conv_id)) AS sys_chars FROM u),
h AS (
  SELECT m.*, CASE WHEN h2.before IS NOT NULL AND m.before - h2.before <= 256 THEN m.before - h2.before WHEN h1.before IS NOT NULL AND m.before - h1.before <= 256 THEN m.before - h1.before ELSE 0 END AS hist,
    CASE WHEN h2.before IS NOT NULL AND m.before - h2.before <= 256 THEN m.chars_before - h2.chars_before WHEN h1.before IS NOT NULL AND m.before - h1.before <= 256 THEN m.chars_before - h1.chars_before ELSE 0 END AS hist_chars
  FROM m LEFT JOIN m h1 ON m.conv_id = h1.conv_id AND h1.i = m.i - 1 AND h1.i >= m.sys LEFT JOIN m h2 ON m.conv_id = h2.conv_id AND h2.i = m.i - 2 AND h2.i >= m.sys),
r AS (
  SELECT conv_id, i, before AS base, 1 AS wins, CAST(0 AS HUGEINT) AS extra FROM h WHERE i = sys
  UNION ALL
  SELECT h.conv_id, h.i,
    CASE WHEN h.before + h.tok - r.base > 1024 - h.sys_tok THEN h.before - CASE WHEN h.hist + h.tok <= 1024 - h.sys_tok THEN h.hist ELSE 0 END ELSE r.base END,
    CASE WHEN h.before + h.tok - r.base > 1024 - h.sys_tok THEN r.wins + 1 ELSE r.wins END,
    CASE WHEN h.before + h.tok - r.base > 1024 - h.sys_tok THEN r.extra + h.sys_chars + CASE WHEN h.hist + h.tok <= 1024 - h.sys_tok THEN h.hist_chars ELSE 0 END ELSE r.extra END
  FROM r JOIN h ON h.conv_id = r.conv_id AND h.i = r.i + 1),
e AS (SELECT conv_id, max(wins) AS wins, max(extra) AS extra FROM r GROUP BY conv_id),
a AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '') AS loss, sum(chars) AS chars FROM t GROUP BY conv_id)
SELECT a.conv_id, n_turns, turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(chars + coalesce(extra, 0) AS BIGINT) AS formatted_chars, CAST(coalesce(wins, 1) AS BIGINT) AS n_windows
FROM a LEFT JOIN e USING (conv_id)""",
    "op3_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM d""",
    "op8_quality": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source AS host, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
g AS (SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS t FROM d WHERE len(w) >= 3),
gr AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g),
pos AS (SELECT DISTINCT rid, i + k AS p FROM gr, (SELECT unnest([0, 1, 2]) AS k) WHERE c > 1),
rep AS (SELECT rid, count(*) AS n_rep FROM pos GROUP BY rid),
ln AS (SELECT rid, host, unnest(ls) AS raw FROM d),
nl AS (SELECT rid, host, translate(trim(regexp_replace(raw, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS l FROM ln),
lc AS (SELECT rid, host, l, count(*) AS n, len(string_split(l, ' ')) AS words FROM nl GROUP BY rid, host, l),
f AS (
  SELECT host, l FROM lc JOIN (SELECT host AS hh, count(*) AS hd FROM d GROUP BY host) h ON host IS NOT DISTINCT FROM hh
  GROUP BY host, l, hd HAVING count(*) > 20 AND count(*) > 0.01 * hd),
rm AS (SELECT rid, sum(words * n) AS rw, sum(n) AS rl FROM lc JOIN f ON lc.host IS NOT DISTINCT FROM f.host AND lc.l = f.l GROUP BY rid),
b AS (
  SELECT rid, doc_id, len(w) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
    length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines FROM d),
x AS (SELECT b.*, coalesce(n_rep, 0) AS n_repeat_words, CAST(coalesce(rw, 0) AS BIGINT) AS n_removed_words, CAST(coalesce(rl, 0) AS BIGINT) AS n_removed_lines
  FROM b LEFT JOIN rep USING (rid) LEFT JOIN rm USING (rid)),
y AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM x)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_removed_words > 0 AND n_words - n_removed_words < 0.2 * n_words) AS kept, n_removed_words, n_removed_lines FROM y""",
    "op10_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
g AS (SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, sha256(norm) AS text_sha256 FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g""",
}
