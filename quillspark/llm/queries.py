"""The registered queries of this folder and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, fingerprint, gif, mixing, negatives, packing, pii, quality, setjoin, token_counts, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_capture_index": warc.op1_warc,
        "op2_oph_minhash_fingerprints": fingerprint.op2_fingerprints,
        "op3_entropy_mixing": mixing.op3_mixing,
        "op4_pii_boosting": pii.op4_pii,
        "op5_byte_bpe": bpe.op5_bpe,
        "op6_gif_media": gif.op6_gif,
        "op7_token_packing": packing.op7_packing,
        "op8_quality_rules": quality.op8_quality,
        "op9_toxicity_mil": toxicity.op9_toxicity,
        "op10_ngram_jaccard_join": setjoin.op10_jaccard,
        "op11_token_counts": token_counts.op11_token_counts,
        "op12_hard_negatives": negatives.op12_negatives,
        "op13_filter_audit": audit.op13_audit,
        **{name: query for name, (query, _) in CHECKS.items()},
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_capture_index": warc.ORACLE_OP1,
        "op10_ngram_jaccard_join": setjoin.ORACLE_OP10,
        "op12_hard_negatives": negatives.ORACLE_OP12,
        "op13_filter_audit": audit.ORACLE_OP13,
        **{name: sql for name, (_, sql) in CHECKS.items()},
    }


# ---------------------------------------------------------------- what SQL can say of the others
def _part(query, *columns: str):
    return lambda spark, sf_dir: query(spark, sf_dir).select(*columns)


_CRC = """list_reduce(list_prepend(4294967295, string_split(doc_id::VARCHAR, '')::VARCHAR[].list_transform(lambda c: ascii(c)::BIGINT)),
  lambda crc, c: xor(crc // 256, list_reduce(list_prepend(xor(crc % 256, c), range(8)), lambda v, k: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END)))"""

_TARGETS = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3]::DOUBLE AS weight FROM d GROUP BY source),
-- a level is a target for each unit of weight; a source is capped below the level that is 2 * size / weight
c AS (SELECT a.source_size * 2.0 / a.weight AS level,
  (SELECT sum(least(b.source_size * 2.0, b.weight * (a.source_size * 2.0 / a.weight))) FROM s b) AS filled FROM s a),
total AS (SELECT 1.5 * sum(source_size) AS share FROM s),
-- between two of these levels what is filled grows in proportion
low AS (SELECT coalesce(max(level), 0) AS level FROM c, total WHERE filled <= share),
t AS (SELECT s.*, least(2.0 * source_size, weight * (low.level + (SELECT (share - coalesce((SELECT sum(least(b.source_size * 2.0, b.weight * low.level)) FROM s b), 0)) / nullif(sum(CASE WHEN b.source_size * 2.0 > b.weight * low.level THEN b.weight ELSE 0 END), 0) FROM s b, total GROUP BY share))) AS target FROM s, low)
SELECT doc_id, size, source_size, round(target, 4) AS target FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source"""

_EDITED = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
n AS (SELECT doc_id, text, length(text) AS n, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC)) AS nxt FROM d)
SELECT doc_id, n AS n_chars, sha256(substr(text, 1, n - n // 3) || substr(nxt, 1, n // 3)) AS edited_sha256 FROM n"""

_LUHN = "list_sum(list_transform(range(1, len(d) + 1), lambda i: CASE WHEN (len(d) - i) % 2 = 1 THEN CASE WHEN 2 * d[i]::INT > 9 THEN 2 * d[i]::INT - 9 ELSE 2 * d[i]::INT END ELSE d[i]::INT END)) % 10 = 0"


def _found(kind: str, place: int, pattern: str, check: str) -> str:
    """The checked matches of a pattern with their places: what is between matches tells where they begin."""
    return rf"""SELECT doc_id, '{kind}' AS kind, {place} AS place, start, start + length(m) AS stop FROM (
  SELECT doc_id, m, regexp_replace(m, '[^0-9]', '', 'g') AS d, (list_sum(list_transform(gaps[1:k], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:k - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (
    SELECT doc_id, ms, gaps, unnest(ms) AS m, generate_subscripts(ms, 1) AS k FROM (
      SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split_regex(text, '{pattern}') AS gaps FROM d))) WHERE {check}"""


_BASE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), found AS ("
    + " UNION ALL ".join(
        (
            _found("email", 0, "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+", "true"),
            _found("ip", 1, "[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+", "list_bool_and(list_transform(string_split(m, '.'), lambda p: coalesce(TRY_CAST(p AS HUGEINT) <= 255, false)))"),
            _found("card", 2, "[0-9](?:[\\x20-]?[0-9])+", f"len(d) BETWEEN 14 AND 19 AND {_LUHN}"),
            _found("phone", 3, "\\+[0-9][\\x20().0-9-]+[0-9]", "len(d) BETWEEN 10 AND 15"),
        )
    )
    + """), per AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM found GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(spans, '')) AS base_sha256 FROM d LEFT JOIN per USING (doc_id)"""
)

_PAYLOAD = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT doc_id, octet_length(b) AS n, b, greatest(1, ceil(octet_length(b) / 576.0))::BIGINT * 576 AS whole FROM d)
SELECT doc_id, n AS n_bytes, whole AS payload_bytes, sha256(b || repeat('\\xFF'::BLOB, whole - n)) AS payload_sha256 FROM p"""

#: Queries that return the columns of an operator which SQL can express, with the SQL.
CHECKS: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {
    "check_op2_edited_texts": (_part(fingerprint.op2_fingerprints, "doc_id", "n_chars", "edited_sha256"), _EDITED),
    "check_op3_targets": (lambda spark, sf_dir: mixing.op3_mixing(spark, sf_dir).selectExpr("doc_id", "size", "source_size", "round(target, 4) AS target"), _TARGETS),
    "check_op4_base_spans": (_part(pii.op4_pii, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"), _BASE),
    "check_op6_payloads": (_part(gif.op6_gif, "doc_id", "n_bytes", "payload_bytes", "payload_sha256"), _PAYLOAD),
    "check_op8_held_out": (_part(quality.op8_quality, "doc_id", "held_out"), f"SELECT doc_id, xor({_CRC}, 4294967295) % 3 = 1 AS held_out FROM documents"),
    "check_op9_held_out": (_part(toxicity.op9_toxicity, "doc_id", "held_out"), f"SELECT doc_id, xor({_CRC}, 4294967295) % 4 = 2 AS held_out FROM documents"),
}
