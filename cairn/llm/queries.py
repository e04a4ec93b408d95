"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import decontaminate, exact, langid, licenses, lines, manifest, mixing, near, quality, repair, secret_scan, toxicity, warc
from cairn.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


@query(
    "op4_exact_dedup",
    """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)""",
)
def op4_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = exact.exact_groups(table(spark, folder, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query("op7_ngram_jaccard_join")
def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    found = near.near_classes(table(spark, folder, "documents"))
    return found.select("doc_id", "class_id", "n_links", "n_texts", "copies")


@query("op2_secret_scan")
def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.secrets(table(spark, folder, "documents"))


@query(
    "op9_source_mix",
    r"""WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('mix0|' || coalesce(CAST(doc_id AS VARCHAR), 't' || text, '')), 1, 13) AS BIGINT) AS u
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2 * sum(size)::DOUBLE AS cap,
         [2, 3, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) % 3)] AS weight
  FROM d GROUP BY source
), o AS (
  SELECT *, (1.5 * sum(source_size) OVER ()
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, CASE WHEN weight * level > cap THEN cap
         ELSE weight * (SELECT max(level) FROM o WHERE weight * level <= cap) END AS target
  FROM o
), p AS (
  SELECT *, CASE WHEN target >= 2 * source_size THEN 2 WHEN target >= source_size THEN 1 ELSE 0 END AS whole FROM t
), r AS (
  SELECT d.doc_id, d.size, d.u, p.*, sum(d.size) OVER (PARTITION BY d.source ORDER BY d.u) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.u) AS here
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, CAST(target AS DOUBLE) AS target,
       CAST(size * (whole + CASE WHEN whole < 2 AND 2 * upto - here < 2 * (target - whole * source_size) AND size > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r""",
)
def op9_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents"), F.array("source"))
    return mixed.select("doc_id", "size", F.col("source_sizes")[0].alias("source_size"), F.col("targets")[0].alias("target"), "taken")


@query(
    "op10_warc_zstd",
    """WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, unhex(sha1(coalesce(html, '')))::BIT::VARCHAR AS bits,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS most
  FROM pages
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
           + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = most THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> most THEN most END AS refers_to
FROM p""",
)
def op10_warc_zstd(spark: SparkSession, folder: str) -> DataFrame:
    read = warc.archive_round_trip(table(spark, folder, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op3_language_id")
def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(table(spark, folder, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op1_quality")
def op1_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.classify(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op5_decontamination")
def op5_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_license_scan")
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    # A document's place is its source and language; its name is its id.
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan(table(spark, folder, "documents"), path).withColumnRenamed("id", "doc_id")


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII string in SQL, a byte at a time."""
    byte = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda s: ord(s)::BIGINT)), lambda c, b: {byte}), 4294967295)"


def _cell(column: str) -> str:
    return f"coalesce(octet_length(encode(CAST({column} AS VARCHAR))) || ':' || CAST({column} AS VARCHAR), '-')"


_LEAF = lambda text: "sha256(" + " || ".join(_cell(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


@query(
    "op11_merkle_manifest",
    f"""WITH RECURSIVE l AS MATERIALIZED (
  SELECT doc_id, source, {_LEAF("text")} AS leaf,
         CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {_LEAF("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS found
  FROM documents
), ranked AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM l
), up(source, h, pos, digest, n) AS (
  SELECT source, 0, pos, leaf, n FROM ranked
  UNION ALL
  SELECT source, h + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM up WHERE n > 1 GROUP BY source, h, pos // 16, n
), subroots AS MATERIALIZED (
  SELECT source, digest AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM up WHERE n = 1
), top(h, pos, digest, n) AS (
  SELECT 0, place, subroot, n FROM subroots
  UNION ALL
  SELECT h + 1, pos // 16, sha256(string_agg(digest, '' ORDER BY pos)), (n + 15) // 16 FROM top WHERE n > 1 GROUP BY h, pos // 16, n
), runs AS MATERIALIZED (
  SELECT source, h, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM up WHERE n > 1 GROUP BY source, h, pos // 16
), top_runs AS MATERIALIZED (
  SELECT h, pos // 16 AS run, list(digest ORDER BY pos) AS kids FROM top WHERE n > 1 GROUP BY h, pos // 16
), climb(doc_id, source, leaf, h, pos, now, said, over) AS (
  SELECT doc_id, source, leaf, 0, pos, coalesce(found, leaf), '', n = 1 FROM ranked
  UNION ALL
  SELECT c.doc_id, c.source, c.leaf, c.h + 1, c.pos // 16,
         sha256(array_to_string(kids[1:c.pos % 16], '') || now || array_to_string(kids[c.pos % 16 + 2:], '')),
         said || array_to_string(kids[1:c.pos % 16], '') || array_to_string(kids[c.pos % 16 + 2:], ''),
         NOT EXISTS (SELECT 1 FROM runs r2 WHERE r2.source IS NOT DISTINCT FROM c.source AND r2.h = c.h + 1)
  FROM climb c JOIN runs r ON r.source IS NOT DISTINCT FROM c.source AND r.h = c.h AND r.run = c.pos // 16
), at_top AS MATERIALIZED (
  SELECT doc_id, c.source, leaf, subroot, place, now, said FROM climb c JOIN subroots s ON s.source IS NOT DISTINCT FROM c.source WHERE over
), finish(doc_id, leaf, subroot, h, pos, now, said) AS (
  SELECT doc_id, leaf, subroot, 0, place, now, said FROM at_top
  UNION ALL
  SELECT doc_id, leaf, subroot, f.h + 1, pos // 16,
         sha256(array_to_string(kids[1:pos % 16], '') || now || array_to_string(kids[pos % 16 + 2:], '')),
         said || array_to_string(kids[1:pos % 16], '') || array_to_string(kids[pos % 16 + 2:], '')
  FROM finish f JOIN top_runs r ON r.h = f.h AND r.run = f.pos // 16
), root AS (SELECT digest AS root FROM top WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(said) AS proof_sha256, now AS folded_root, now = root AS verified
FROM finish, root WHERE h = (SELECT max(h) FROM finish)""",
)
def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.tampered_audit(table(spark, folder, "documents"))


@query(
    "op12_line_dedup",
    r"""WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS n FROM documents
), k AS MATERIALIZED (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), r AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(r.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (r.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN r ON k.key = r.key GROUP BY doc_id""",
)
def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = lines.drop_repeated_lines(table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


@query(
    "op13_conversation_repair",
    f"""WITH RECURSIVE c AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS code
  FROM conversations
), d AS (
  SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE code WHEN 0 THEN [] WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM c
), o AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS own, rtrim(text, {_WHITE}) AS bare
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)
), f AS MATERIALIZED (
  SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN i > min(i) OVER (PARTITION BY conv_id, role, text) THEN 'duplicate'
                 WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault,
         coalesce(lag(own) OVER (PARTITION BY conv_id ORDER BY i) || own NOT IN ('su', 'ua', 'au'), false) AS odd
  FROM o
), enter(p, q, cost, audit) AS (
  VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 2, 'I'), (1, 2, 2, 'I'), (2, 3, 2, 'I'), (3, 2, 2, 'I'),
         (0, 3, 4, 'II'), (1, 3, 4, 'II'), (2, 2, 4, 'II'), (3, 3, 4, 'II')
), act(p, own, letter, q, cost) AS (
  VALUES (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0), (3, 'u', 'K', 2, 0),
         (0, NULL, 'R', 2, 2), (1, NULL, 'R', 2, 2), (2, NULL, 'R', 3, 2), (3, NULL, 'R', 2, 2),
         (0, NULL, 'D', 0, 3), (1, NULL, 'D', 1, 3), (2, NULL, 'D', 2, 3), (3, NULL, 'D', 3, 3)
), move AS MATERIALIZED (
  SELECT e.p, a.own, a.letter, a.q, e.cost + a.cost AS cost, e.audit || a.letter AS audit FROM enter e JOIN act a ON a.p = e.q
), walk(conv_id, i, q, best) AS (
  SELECT conv_id, 0::BIGINT, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM f WHERE i = 1
  UNION ALL
  SELECT w.conv_id, w.i + 1, m.q, min({{'cost': w.best.cost + m.cost + CASE WHEN m.letter <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || m.audit}})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN move m ON m.p = w.q AND (m.own IS NULL OR m.own = f.own) AND (m.letter = 'D' OR f.fault IS NULL OR f.fault = 'truncated')
  GROUP BY w.conv_id, w.i, m.q
), done AS MATERIALIZED (
  SELECT w.conv_id, min({{'cost': best.cost + e.cost, 'audit': best.audit || e.audit}}) AS best
  FROM walk w JOIN (SELECT conv_id, max(i) AS i FROM f GROUP BY conv_id) z ON z.conv_id IS NOT DISTINCT FROM w.conv_id AND z.i = w.i
  JOIN enter e ON e.p = w.q AND e.q IN (0, 3) GROUP BY w.conv_id
), letters AS (
  SELECT conv_id, unnest(string_split(best.audit, '')) AS letter, generate_subscripts(string_split(best.audit, ''), 1) AS k FROM done WHERE best.audit <> ''
), placed AS (
  SELECT *, sum((letter <> 'I')::INT) OVER w AS i, sum((letter <> 'D')::INT) OVER w AS out FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
), said AS (
  SELECT p.conv_id, p.letter, p.k, p.out, f.role, f.text, bool_or(p.letter = 'K' AND p.out = 1 AND f.own = 's') OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.letter <> 'I'
), texts AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS t
  FROM (SELECT conv_id, letter, k, out, role, text, coalesce(led, false) AS led FROM said) WHERE letter <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (odd) AS illegal
  FROM f GROUP BY conv_id
)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.cost, 0) AS cost, coalesce(best.audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM a.conv_id
LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM a.conv_id""",
)
def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(table(spark, folder, "conversations"))
