"""Registered queries of the training-data operators, and their SQL where SQL can say them."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import DataFrame, SparkSession

from vectorloom.llm import bestfit, chat, codes, decontam, lines, minhash, packing, periods, quality, suffix, tokens, warc, winnow
from vectorloom.sources.tables import read_table


def op1_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapse_and_render(read_table(spark, sf_dir, "conversations"))


OP1_SQL = r"""
WITH c AS (
  SELECT conv_id, list(struct_pack(r := role, t := text) ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS m
  FROM (SELECT DISTINCT conv_id, turn, role, text FROM conversations) GROUP BY conv_id
), k AS (
  SELECT min(conv_id) AS conv_id, m FROM c GROUP BY m
), p AS (
  SELECT DISTINCT m[1:n] AS m FROM k, unnest(range(1, len(m))) AS t(n)
), w AS (
  SELECT * FROM k WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.m = k.m)
), s AS (
  SELECT w.conv_id, len(w.m) AS n_turns, c.turn, c.role, c.text,
         (row_number() OVER (PARTITION BY c.conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1) // 256 AS block
  FROM w JOIN (SELECT DISTINCT conv_id, turn, role, text FROM conversations) c ON c.conv_id IS NOT DISTINCT FROM w.conv_id
)
SELECT conv_id, CAST(block + 1 AS INTEGER) AS part, n_turns,
       string_agg('<|im_start|>' || coalesce(role, 'unknown') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
                  ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM s GROUP BY conv_id, block, n_turns
"""


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")).drop("tkey")


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_digest(read_table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH l AS (
  SELECT doc_id, i, ls[i] AS line,
         translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS t(i)
), f AS (
  SELECT k, min(doc_id) AS d FROM l WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2
)
SELECT l.doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE f.d <> l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.d IS NULL OR f.d = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f ON l.k = f.k
GROUP BY l.doc_id
"""


def op5_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.ordered_history(read_table(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "capture", "place")


OP5_SQL = r"""
WITH q AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d,
         replace(replace(replace(replace(CASE WHEN coalesce(url, '') = '' THEN 'urn:missing' ELSE url END, ' ', '%20'),
                 chr(9), '%09'), chr(10), '%0A'), chr(13), '%0D') AS url
  FROM pages
), r AS (
  SELECT *, contains(url, '://') AS web, regexp_replace(substr(url, strpos(url, '://') + 3), '#.*$', '') AS rest FROM q
), h AS (
  SELECT *, regexp_extract(rest, '^[^/?]*') AS host FROM r
), p AS (
  SELECT page_id, n, d, strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0) % 100000000), '%Y%m%d%H%M%S') AS capture,
         CASE WHEN NOT web THEN lower(url)
              ELSE array_to_string(list_reverse(string_split(regexp_replace(lower(regexp_replace(regexp_replace(host, '^.*@', ''), ':.*$', '')),
                                   '^www[.]', ''), '.')), ',')
                   || ')' || coalesce(nullif(rtrim(lower(substr(rest, length(host) + 1)), '/'), ''), '/') END AS url_key
  FROM h
), f AS (
  SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d HAVING count(*) > 1
)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
       CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to,
       url_key, capture, row_number() OVER (ORDER BY url_key, capture, page_id) - 1 AS place
FROM p LEFT JOIN f ON p.d = f.d
"""


def op6_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.pack_matrices(read_table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(read_table(spark, sf_dir, "documents"))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4)


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))
                                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), l AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2
), e AS (
  SELECT u, v FROM l JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)
), r AS (
  SELECT doc_id AS node, doc_id AS root FROM documents
  UNION
  SELECT e.v, r.root FROM r JOIN e ON e.u = r.node
)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, c.root AS component_id, w.doc_id = c.root AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT node, min(root) AS root FROM r GROUP BY node) c ON c.node = w.doc_id
"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op10_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_along_curve(read_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.code_digest(read_table(spark, sf_dir, "embeddings"))


_NEAREST = """a{r} AS (
  SELECT vec_id, label, pos, arg_min(entry, d * 64 + entry) AS entry, min(d) AS error, any_value(x1) AS x1, any_value(x2) AS x2,
         any_value(x3) AS x3, any_value(x4) AS x4
  FROM (SELECT p.*, entry, (x1 - y1) * (x1 - y1) + (x2 - y2) * (x2 - y2) + (x3 - y3) * (x3 - y3) + (x4 - y4) * (x4 - y4) AS d
        FROM p JOIN c{r} USING (pos))
  GROUP BY vec_id, label, pos
)"""
_MEANS = """c{r} AS (
  SELECT pos, entry, coalesce(floor(avg1), y1)::BIGINT AS y1, coalesce(floor(avg2), y2)::BIGINT AS y2,
         coalesce(floor(avg3), y3)::BIGINT AS y3, coalesce(floor(avg4), y4)::BIGINT AS y4
  FROM c{q} LEFT JOIN (
    SELECT pos, entry, sum(x1) / count(*) AS avg1, sum(x2) / count(*) AS avg2, sum(x3) / count(*) AS avg3, sum(x4) / count(*) AS avg4
    FROM a{q} GROUP BY pos, entry) USING (pos, entry)
)"""
OP11_SQL = r"""
WITH k AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT vec_id, label, pos, v[4 * pos + 1] AS x1, v[4 * pos + 2] AS x2, v[4 * pos + 3] AS x3, v[4 * pos + 4] AS x4
  FROM k, unnest(range(16)) AS t(pos)
), c0 AS (
  SELECT pos, entry, x1 AS y1, x2 AS y2, x3 AS y3, x4 AS y4
  FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM k) USING (vec_id) WHERE entry < 64
), """ + ", ".join([_NEAREST.format(r=0), _MEANS.format(r=1, q=0), _NEAREST.format(r=1), _MEANS.format(r=2, q=1),
                    _NEAREST.format(r=2)]) + r""", v AS (
  SELECT vec_id, label, string_agg(printf('%02x', entry), '' ORDER BY pos) AS code, sum(error)::BIGINT AS error FROM a2 GROUP BY vec_id, label
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(y1 || ',' || y2 || ',' || y3 || ',' || y4, ',' ORDER BY pos, entry)) FROM c2) AS codebooks_sha256
FROM v
"""


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bestfit.pack_best_fit(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.run_digest(read_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_chat_snapshots, op2_benchmark_decontamination, op3_suffix_dedup, op4_line_dedup, op5_warc_index,
             op6_token_packing, op7_winnowing, op8_minhash_near_dedup, op9_quality_classifier, op10_curve_packing, op11_vector_codes,
             op12_best_fit_packing, op13_periodic_runs)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL where it can say the whole result; the others are tested against brute force in ``tests/llm``."""
    return {"op1_chat_snapshots": OP1_SQL, "op4_line_dedup": OP4_SQL, "op5_warc_index": OP5_SQL,
            "op8_minhash_near_dedup": OP8_SQL, "op11_vector_codes": OP11_SQL}
