"""Registered queries of the subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sirenflow.llm import chat_repair, conversation_audit, decontaminate, html_extract, license_scan, merkle, mixing, quality_lines, simhash, substring_dedup, token_count, toxicity, warc
from sirenflow.llm.common import ascii_lower


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: text without repeated lines and sentences, and the removed spans."""
    return substring_dedup.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "text", "removed", "removed_chars")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as files source/lang/doc_id: own licence and what directories hand down."""
    docs = _table(spark, sf_dir, "documents")
    return license_scan.scan(docs.withColumn("path", F.concat_ws("/", F.coalesce("source", F.lit("_")), F.coalesce("lang", F.lit("_")), F.col("doc_id").cast("string"))))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.fingerprint_components(_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_repair.repair_chats(_table(spark, sf_dir, "conversations"))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op8_quality_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_lines.quality(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item: one row per document text and item."""
    found = decontaminate.contained(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), "n_found", "n_shingles")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_round_trip(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: digests of the manifest, and whether a row whose text is lower-cased for every third crc still leads to the root."""
    text = F.col("text")
    low = merkle.leaf_digest(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars")], ascii_lower(text))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, low)
    m = merkle.manifest(_table(spark, sf_dir, "documents"), also={"tampered": tampered})
    m = m.withColumn("folded_root", merkle.fold(F.col("path"), F.coalesce("tampered", "leaf")))
    return m.select("doc_id", "leaf", "subroot", "root", merkle.digest(merkle.siblings(F.col("path"))).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_conversation_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged by rule: their faults, and the cheapest edits that repair their roles."""
    turns = _table(spark, sf_dir, "conversations")
    return conversation_audit.audit(conversation_audit.damaged(turns), turns.select(F.col("conv_id").alias("conv")))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents: bytes and tokens of the whole text."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return token_count.token_counts(_table(spark, sf_dir, "documents"), f.read())


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_license_scan, op3_source_mix, op4_simhash, op5_toxicity, op6_chat_repair, op7_html_extract, op8_quality_lines, op9_decontaminate, op10_warc, op11_merkle_manifest, op12_conversation_audit, op13_token_counts, pipeline)
}

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

ORACLE = {
    "op3_source_mix": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(len({_WORDS}), 0)::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 AS w
  FROM d GROUP BY source
), o AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER q, 0) AS lw,
         sum(w) OVER () - coalesce(sum(w) OVER q, 0) AS lk
  FROM s WINDOW q AS (ORDER BY 3 * source_size / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT lw, lk FROM o WHERE cap * lk > lw * w ORDER BY cap / w, source IS NULL, source LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN cap * o.lk <= o.lw * w OR l.lw IS NULL THEN cap::DOUBLE ELSE l.lw::DOUBLE * w / l.lk END AS target
  FROM o LEFT JOIN l ON true
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, d.source, floor(t.target)::BIGINT AS budget,
         (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.size ROWS UNBOUNDED PRECEDING) - d.size)::BIGINT AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * size
        + least(greatest(budget - CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END * source_size - before, 0), size))::BIGINT AS taken, source
FROM p""",
    "op8_quality_lines": r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, text IS NULL AS none, md5(text) AS tk, coalesce('h' || source, 'n') AS host FROM documents
), w AS (
  SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM d
), win AS (
  SELECT rid, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS s FROM w
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM win) WHERE n > 1
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid
), ln AS (
  SELECT rid, host, tk, unnest(string_split(text, chr(10))) AS line FROM d
), nl AS (
  SELECT rid, host, tk, line, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), dl AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM nl GROUP BY rid
), hd AS (
  SELECT host, count(DISTINCT coalesce(tk, 'null')) AS n FROM d GROUP BY host
), over_limit AS (
  SELECT host, norm FROM (SELECT host, norm, count(DISTINCT tk) AS n FROM nl GROUP BY host, norm) x JOIN hd USING (host) WHERE x.n > 10 AND x.n * 100 > hd.n * 2
), lost AS (
  SELECT rid, sum(len(string_split(norm, ' '))) AS n FROM nl JOIN over_limit USING (host, norm) GROUP BY rid
), b AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(d.text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         coalesce(dl.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS lost
  FROM d JOIN w USING (rid) LEFT JOIN dl USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       n_words - lost AS n_left, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND (n_words - lost) * 100 >= n_words * 50 AS kept
FROM b""",
    "op9_decontaminate": r"""
WITH it AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}]+'), lambda x: x <> '') AS w FROM benchmark
), ik AS (
  SELECT item_id, w, least(len(w), 5) AS k FROM it WHERE len(w) > 0
), ish AS (
  SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s FROM ik
), n AS (
  SELECT item_id, count(*) AS n FROM ish GROUP BY item_id
), dw AS (
  SELECT doc_id, md5(text) AS tk, list_filter(regexp_split_to_array(lower(text), '[\x00-/:-@\[-`{-\x{BF}\x{2000}-\x{206F}\x{3000}-\x{303F}\x{FF00}-\x{FF0F}]+'), lambda x: x <> '') AS w FROM documents
), dsh AS (
  SELECT DISTINCT doc_id, tk, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS s
  FROM dw, (SELECT DISTINCT k FROM ik) WHERE len(w) >= k
)
SELECT doc_id, item_id, count(*)::INT AS n_found, any_value(n.n)::INT AS n_shingles
FROM dsh JOIN ish USING (k, s) JOIN n USING (item_id)
GROUP BY doc_id, tk, item_id HAVING count(*) >= ceil(round(any_value(n.n) * 0.8, 9))""",
    "op10_warc": r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, html, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex, max(page_id) OVER (PARTITION BY html) AS top FROM p
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT) >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN NULL ELSE top END AS refers_to,
       CASE WHEN page_id IS NOT DISTINCT FROM top THEN true END AS intact
FROM d""",
}
#: crc32 of a list of codes, as SQL: the usual reflected polynomial, a byte and eight bits a step.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({s}, ''), lambda ch: ascii(ch)::BIGINT)), lambda c, x: list_reduce(list_concat([xor(c, x)], range(8)), lambda y, bit: CASE WHEN y & 1 = 1 THEN xor(y >> 1, 3988292384) ELSE y >> 1 END)), 4294967295)"

ORACLE["op11_merkle_manifest"] = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce('v' || lang, '') AS g, text,
         coalesce(octet_length(encode(doc_id::VARCHAR)) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
         || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(n_chars::VARCHAR)) || ':' || n_chars, '-') AS head,
         coalesce(octet_length(encode(text)) || ':', '-') AS mark
  FROM documents
), l AS (
  SELECT doc_id, g, sha256(head || mark || coalesce(text, '')) AS leaf,
         CASE WHEN {_CRC.format(s="doc_id::VARCHAR")} % 3 = 0 THEN sha256(head || mark || coalesce(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')) END AS low
  FROM d
), r AS (
  SELECT *, row_number() OVER () AS rid, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM l
), u AS (
  SELECT g, 0 AS lv, i, n, leaf AS h FROM r
  UNION ALL
  SELECT g, lv + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY g, lv, i // 8
), s AS (
  SELECT g, lv, h AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM u WHERE n = 1
), t AS (
  SELECT 0 AS lv, i, n, subroot AS h FROM s
  UNION ALL
  SELECT lv + 1, i // 8, (any_value(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY lv, i // 8
), p AS (
  SELECT r.rid, u.lv, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i < r.i >> (3 * u.lv)), '') AS a, coalesce(string_agg(u.h, '' ORDER BY u.i) FILTER (u.i > r.i >> (3 * u.lv)), '') AS b
  FROM r JOIN u ON u.g = r.g AND u.n > 1 AND u.i >> 3 = r.i >> (3 * u.lv + 3) GROUP BY r.rid, u.lv
  UNION ALL
  SELECT r.rid, s.lv + t.lv, coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i < s.i >> (3 * t.lv)), ''), coalesce(string_agg(t.h, '' ORDER BY t.i) FILTER (t.i > s.i >> (3 * t.lv)), '')
  FROM r JOIN s USING (g) JOIN t ON t.n > 1 AND t.i >> 3 = s.i >> (3 * t.lv + 3) GROUP BY r.rid, s.lv, t.lv
), f AS (
  SELECT rid, 0 AS lv, coalesce(low, leaf) AS h FROM r
  UNION ALL
  SELECT f.rid, f.lv + 1, sha256(p.a || f.h || p.b) FROM f JOIN p USING (rid, lv)
), e AS (
  SELECT rid, max_by(h, lv) AS folded_root FROM f GROUP BY rid
), q AS (
  SELECT rid, string_agg(a || b, '' ORDER BY lv) AS sib FROM p GROUP BY rid
)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(sib, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM r JOIN s USING (g) JOIN e USING (rid) LEFT JOIN q USING (rid), (SELECT h AS root FROM t WHERE n = 1)"""

ORACLE["op12_conversation_audit"] = rf"""
WITH RECURSIVE src AS (
  SELECT coalesce('v' || conv_id, '') AS g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations
), kinds AS (
  SELECT *, {_CRC.format(s="name")} % 20 AS kind FROM src
), hurt AS (
  SELECT g, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0
), num AS (
  SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, md5(text), copy) AS k FROM hurt
), flt AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY k) > 1 THEN 'd'
                 WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') THEN 't' END AS fault,
         lag(role[1]) OVER (PARTITION BY g ORDER BY k) || role[1] AS two
  FROM num
), x AS (
  SELECT *, CASE WHEN fault IN ('b', 'd') THEN '-' WHEN role[1] IN ('s', 'u', 'a') THEN role[1] ELSE 'x' END AS sym, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra FROM flt
), c AS (
  SELECT g, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM x GROUP BY g
), b AS (
  SELECT g, n + 1 AS k, [0, 6, 3, 0] AS v FROM c
  UNION ALL
  SELECT g, k, [least(d0, d2 + 3, d3 + 6), least(d1, d2 + 3, d3 + 6), least(d2, d3 + 3), least(d3, d2 + 3)] FROM (
    SELECT g, x.k, least(4 + v[1], CASE WHEN sym <> '-' THEN 3 + extra + v[3] END, CASE sym WHEN 's' THEN extra + v[2] WHEN 'u' THEN extra + v[3] END) AS d0,
           least(4 + v[2], CASE WHEN sym <> '-' THEN 3 + extra + v[3] END, CASE sym WHEN 'u' THEN extra + v[3] END) AS d1,
           least(4 + v[3], CASE WHEN sym <> '-' THEN 3 + extra + v[4] END, CASE sym WHEN 'a' THEN extra + v[4] END) AS d2,
           least(4 + v[4], CASE WHEN sym <> '-' THEN 3 + extra + v[3] END, CASE sym WHEN 'u' THEN extra + v[3] END) AS d3
    FROM b JOIN x USING (g) WHERE x.k = b.k - 1)
), t AS (
  SELECT g, 1::BIGINT AS k, 0 AS st, '' AS audit, NULL::VARCHAR AS rep FROM c
  UNION ALL
  SELECT g, CASE e WHEN 'I' THEN k ELSE k + 1 END, CASE e WHEN 'D' THEN st WHEN 'K' THEN kt ELSE put END, audit || e,
         CASE e WHEN 'D' THEN rep ELSE coalesce(rep || chr(10), '') || CASE e WHEN 'K' THEN role || ':' || text ELSE CASE put WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE e WHEN 'R' THEN text ELSE '' END END END
  FROM (
    SELECT *, CASE WHEN sym IS NULL THEN 'I' WHEN 4 + f[st + 1] = h[st + 1] THEN 'D' WHEN 3 + h[put + 1] = h[st + 1] THEN 'I' WHEN extra + f[kt + 1] = h[st + 1] THEN 'K' ELSE 'R' END AS e
    FROM (
      SELECT t.*, x.sym, x.extra, x.role, x.text, here.v AS h, later.v AS f, [2, 2, 3, 2][st + 1] AS put,
             CASE WHEN sym = 's' AND st = 0 THEN 1 WHEN sym = 'u' AND st <> 2 THEN 2 WHEN sym = 'a' AND st = 2 THEN 3 END AS kt
      FROM t JOIN c USING (g) JOIN b AS here ON here.g = t.g AND here.k = t.k LEFT JOIN x ON x.g = t.g AND x.k = t.k LEFT JOIN b AS later ON later.g = t.g AND later.k = t.k + 1
      WHERE NOT (t.k = n + 1 AND st IN (0, 3))))
), done AS (
  SELECT t.g, audit, sha256(coalesce(rep, '')) AS sha FROM t JOIN c USING (g) WHERE t.k = n + 1 AND st IN (0, 3)
)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(v[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('v' || conv_id, '') AS g FROM conversations) a LEFT JOIN c USING (g) LEFT JOIN done USING (g) LEFT JOIN (SELECT g, v FROM b WHERE k = 1) USING (g)"""
