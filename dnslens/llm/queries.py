"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    fingerprints,
    fuzzy_lines,
    host_rules,
    language,
    lm_scoring,
    mixing,
    packing,
    secret_scan,
    shingle_join,
    suffix_dedup,
    turn_repair,
    vector_codes,
    warc,
)
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_pairs(table(spark, sf_dir, "documents"))


def op3_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.quality(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


OP3_SQL = r"""
WITH words AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), windows AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS n
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words)
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM windows WHERE n > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM words)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), judged AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM judged
), hosts AS (
  SELECT source, count(*) AS n, sum(base_failed::INT) AS f FROM based GROUP BY source
), prior AS (
  SELECT avg(f / n) AS m, var_pop(f / n) AS v FROM hosts
), rates AS (
  SELECT source, CASE WHEN v = 0 THEN m
    ELSE (f + m * greatest(0, m * (1 - m) / v - 1)) / (n + greatest(0, m * (1 - m) / v - 1)) END AS rate
  FROM hosts, prior
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= 0.5 AS kept
FROM based JOIN rates ON based.source IS NOT DISTINCT FROM rates.source
"""


def op4_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fuzzy_lines.without_repeated_lines(table(spark, sf_dir, "documents"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256")
    return cut.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", kept)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scoring.score(table(spark, sf_dir, "documents"))
    return scored.withColumn("log_score", F.round("log_score", 4))


OP5_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), tokens AS (
  SELECT doc_id, i, w[i] AS w, w[i - 1] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM words)
), counted AS (
  SELECT doc_id, i, w, c,
         count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS f_w,
         CASE WHEN i > 1 THEN count(*) OVER (PARTITION BY c, w) - count(*) OVER (PARTITION BY doc_id, c, w)
              ELSE 0 END AS f_cw
  FROM tokens
), sizes AS (
  SELECT doc_id, len(w) AS n, sum(len(w)) OVER () AS total FROM words
), scored AS (
  SELECT doc_id, f_cw = 0 AND i > 1 AS back,
         CASE WHEN f_cw > 0 THEN ln(f_cw / lag(f_w) OVER (PARTITION BY doc_id ORDER BY i))
              WHEN f_w > 0 THEN ln(0.4) + ln(f_w / (total - n))
              ELSE 2 * ln(0.4) - ln(total - n + 1.0) END AS score
  FROM counted JOIN sizes USING (doc_id)
)
SELECT doc_id, CAST(any_value(n) AS BIGINT) AS n_words, CAST(coalesce(sum(back::INT), 0) AS BIGINT) AS n_backed_off,
       round(coalesce(sum(score), 0), 4) AS log_score
FROM sizes LEFT JOIN scored USING (doc_id) GROUP BY doc_id
"""


def op6_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shingle_join.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP7_SQL = """
WITH payloads AS (
  SELECT page_id, encode(coalesce(html, '')) AS body, sha1(coalesce(html, '')) AS digest FROM pages
), grouped AS (
  SELECT page_id, octet_length(body) AS n, digest, max(page_id) OVER (PARTITION BY digest) AS winner FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> winner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> winner THEN winner END AS refers_to
FROM grouped
"""


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.Mix(table(spark, sf_dir, "documents"))
    return mix.taken().select("doc_id", "size", "source_size", "target", "taken")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.window_pieces(table(spark, sf_dir, "documents"))
    placed = packing.place(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compressed(table(spark, sf_dir, "embeddings"))


def _moved(r: int) -> str:
    """Assignment of all parts to the entries of round ``r``, and the entries after it."""
    return f"""
assigned{r} AS MATERIALIZED (
  SELECT n, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT n, p, e, sum((x - c) * (x - c)) AS d FROM parts JOIN book{r} USING (p, j) GROUP BY n, p, e
  ) GROUP BY n, p
), means{r} AS (
  SELECT p, best.e AS e, j, CAST(floor(sum(x) / count(*)) AS BIGINT) AS c
  FROM assigned{r} JOIN parts USING (n, p) GROUP BY p, best.e, j
), book{r + 1} AS MATERIALIZED (
  SELECT p, e, j, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m USING (p, e, j)
)"""


OP11_SQL = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT n, CAST(k // (len // 16) AS BIGINT) AS p, CAST(k % (len // 16) AS BIGINT) AS j, v[k + 1] AS x
  FROM (SELECT n, v, len(v) AS len, unnest(range(len(v))) AS k FROM kept)
), book0 AS (
  SELECT p, n - 1 AS e, j, x AS c FROM parts WHERE n <= 64
), {_moved(0)}, {_moved(1)}, assigned2 AS (
  SELECT n, p, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT n, p, e, sum((x - c) * (x - c)) AS d FROM parts JOIN book2 USING (p, j) GROUP BY n, p, e
  ) GROUP BY n, p
), coded AS (
  SELECT n, string_agg(format('{{:02x}}', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM assigned2 GROUP BY n
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(c, ',' ORDER BY p, e, j)) FROM book2) AS codebooks_sha256
FROM coded JOIN kept USING (n)
"""


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(table(spark, sf_dir, "documents"))


def _crc32(text: str) -> str:
    """The CRC-32 of an ASCII text in DuckDB, which has no such function."""
    return f"""xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda c: ord(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)),
      lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"""


def _matches(kind: str, pattern: str) -> str:
    """The leftmost matches of a pattern, with their places from the texts between them."""
    return f"""
  SELECT doc_id, '{kind}' AS kind, m[i] AS match,
         list_sum(list_transform(s[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: length(x))), 0)
           AS start
  FROM (SELECT doc_id, m, s, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_split_to_array(t, '{pattern}') AS s FROM texts
  ))"""


_ANY_CASE = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)
    for word in ("password", "passwd", "secret", "token", "api_?key")
)
_ASSIGN = rf"""({_ANY_CASE})["'']?\x20*[:=]\x20*["'']?"""
_ALNUM = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_BASE62 = " + ".join(f"(strpos('{_ALNUM}', substr(match, {35 + k}, 1)) - 1) * {62 ** (5 - k)}" for k in range(6))

OP12_SQL = rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), found AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'github', 'npm'], kind) AS rank FROM (
  {_matches("assign", _ASSIGN + "[A-Za-z0-9+/_.=-]+")}
  WHERE length(regexp_replace(m[i], '^{_ASSIGN}', '')) >= 6
  UNION ALL {_matches("access", "AKIA[A-Z0-9]+")} WHERE length(m[i]) >= 20
  UNION ALL {_matches("hex", "[0-9a-f]+")} WHERE length(m[i]) >= 24
  UNION ALL SELECT * FROM ({_matches("github", "gh[pousr]_[A-Za-z0-9]+")} WHERE length(m[i]) = 40
  UNION ALL {_matches("npm", "npm_[A-Za-z0-9]+")} WHERE length(m[i]) = 40)
  WHERE {_crc32("substr(match, 5, 30)")} = {_BASE62})
), spans AS (
  SELECT doc_id, kind, start, rank, format('{{}}:{{}}:{{}}', kind, start, start + length(match)) AS span FROM found
)
SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256(coalesce(string_agg(span, ',' ORDER BY start, rank) FILTER (rank <= 3), '')) AS base_sha256,
       coalesce(string_agg(span, ',' ORDER BY start, rank), '') AS spans
FROM texts LEFT JOIN spans USING (doc_id) GROUP BY doc_id
"""


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repaired_digests(table(spark, sf_dir, "conversations"))


OP13_SQL = rf"""
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d
  FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role,
         CASE d WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(CASE d WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM drawn WHERE d <> 0
), ordered AS (
  SELECT *, coalesce(conv_id::VARCHAR, '') AS c, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, unhex(sha256(length(role) || ':' || role || text))) AS i,
         regexp_extract(text, '([^ 	-])[ 	-]*$', 1) AS last
  FROM damaged
), flagged AS MATERIALIZED (
  SELECT *, last = '' AS blank, last <> '' AND n > 1 AS duplicate, last NOT IN ('', '.', '!', '?') AND n = 1 AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS n FROM ordered)
), moves(p, initial, q, cost, label) AS (
  VALUES (0, 's', 1, 0, 'K'), (0, 'u', 2, 0, 'K'), (1, 'u', 2, 0, 'K'), (3, 'u', 2, 0, 'K'), (2, 'a', 3, 0, 'K'),
         (0, 'a', 3, 2, 'IK'), (1, 'a', 3, 2, 'IK'), (3, 'a', 3, 2, 'IK'), (2, 'u', 2, 2, 'IK'),
         (0, NULL, 2, 2, 'R'), (1, NULL, 2, 2, 'R'), (3, NULL, 2, 2, 'R'), (2, NULL, 3, 2, 'R'),
         (0, NULL, 3, 4, 'IR'), (1, NULL, 3, 4, 'IR'), (3, NULL, 3, 4, 'IR'), (2, NULL, 2, 4, 'IR'),
         (0, NULL, 0, 3, 'D'), (1, NULL, 1, 3, 'D'), (2, NULL, 2, 3, 'D'), (3, NULL, 3, 3, 'D')
), paths(c, i, q, best) AS (
  SELECT DISTINCT coalesce(conv_id::VARCHAR, ''), 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]}}
  FROM conversations
  UNION ALL
  SELECT r.c, r.i, m.q, min({{
    'cost': best.cost + m.cost + CASE WHEN truncated AND label <> 'D' THEN 1 ELSE 0 END, 'audit': best.audit || label,
    'lines': best.lines || CASE WHEN label[1] = 'I' THEN [CASE m.q WHEN 2 THEN 'assistant:' ELSE 'user:' END] ELSE [] END
      || CASE label[-1] WHEN 'K' THEN [role || ':' || text]
           WHEN 'R' THEN [CASE m.q WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] ELSE [] END}})
  FROM paths JOIN flagged r ON r.c = paths.c AND r.i = paths.i + 1 JOIN moves m ON m.p = paths.q
  WHERE label = 'D' OR (NOT blank AND NOT duplicate AND (m.initial IS NULL OR m.initial = r.initial))
  GROUP BY r.c, r.i, m.q
), tails(q, cost, label, lines) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (1, 4, 'II', ['user:', 'assistant:']), (2, 2, 'I', ['assistant:']), (3, 0, '', [])
), ended AS (
  SELECT c, min({{'cost': best.cost + t.cost, 'audit': best.audit || t.label, 'lines': best.lines || t.lines}}) AS best
  FROM paths JOIN tails t USING (q) LEFT JOIN (SELECT c, max(i) AS n FROM flagged GROUP BY c) USING (c)
  WHERE i = coalesce(n, 0) GROUP BY c
), facts AS (
  SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, sum(blank::INT) AS blank,
         sum(duplicate::INT) AS duplicate, sum(truncated::INT) AS truncated,
         count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY c ORDER BY i) AS before FROM flagged) GROUP BY c
)
SELECT DISTINCT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, best.cost::BIGINT AS cost, best.audit AS audit,
       sha256(array_to_string(best.lines, chr(10))) AS repaired_sha256
FROM conversations JOIN ended ON ended.c = coalesce(conv_id::VARCHAR, '') LEFT JOIN facts USING (c)
"""


QUERIES: dict[str, Query] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_fingerprints": op2_fingerprints,
    "op3_host_rules": op3_host_rules,
    "op4_fuzzy_lines": op4_fuzzy_lines,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_shingle_join": op6_shingle_join,
    "op7_warc": op7_warc,
    "op8_language": op8_language,
    "op9_mixing": op9_mixing,
    "op10_packing": op10_packing,
    "op11_vector_codes": op11_vector_codes,
    "op12_secret_scan": op12_secret_scan,
    "op13_turn_repair": op13_turn_repair,
}

ORACLE_SQL: dict[str, str] = {
    "op3_host_rules": OP3_SQL,
    "op5_lm_scoring": OP5_SQL,
    "op7_warc": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_secret_scan": OP12_SQL,
    "op13_turn_repair": OP13_SQL,
}
