"""Registry of checked queries: one Spark query and (mostly) one DuckDB oracle per key.

Each query takes ``(spark, sf_dir)`` and reads the driver tables, or data
Spark derives from them, in full. The oracle is an independent SQL
statement over the same tables; names of output columns match, and every
non-integer value that depends on summation order is rounded to 6 places in
both. Keys without an oracle (training, telemetry, file round trips) are
checked for rows only and have their own unit tests.
"""

from __future__ import annotations

import math
from typing import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectorloom.functions import vector as V
from vectorloom.functions.keys import split_name
from vectorloom.operators import encode as E
from vectorloom.operators import grid as G
from vectorloom.operators import metrics as M
from vectorloom.operators import report as R
from vectorloom.operators import sampling as S
from vectorloom.operators import text as X
from vectorloom.operators import training as C
from vectorloom.operators import vectors as VO
from vectorloom.sources import corpus as SC
from vectorloom.sources import runs as RU
from vectorloom.sources.export import vector_export
from vectorloom.sources.tables import read_table
from vectorloom.session import scratch_path

# Parameters of the registered queries.
SEED = 42
SAMPLE_N = 500
TRAIN_N = 500
TEST_N = 100
TRUNC_DIM = 32
PREVIEW_N = 10
BATCH_SIZE = 16
HASH_DIM = 64
MAX_LENGTH = 256

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn
    return wrap


def _r(c, digits: int = 6):
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


def _embeddings(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _documents(spark, sf_dir):
    return read_table(spark, sf_dir, "documents")


def _parts(spark) -> int | None:
    """Partitions to deal texts into before encoding (a narrow scan); unset: as scanned."""
    n = spark.conf.get("spark.vectorloom.encode.partitions", None)
    return int(n) if n else None


# ---------------------------------------------------------------- SQL views

_CORPUS = """
corpus AS (
  SELECT doc_id,
         CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split,
         text, lang
  FROM (SELECT *, ('0x' || substr(md5('split:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS b
        FROM documents) d)"""

_VOCAB = """
vocab AS (
  SELECT CAST(dense_rank() OVER (ORDER BY label_name) - 1 AS INTEGER) AS label, label_name
  FROM (SELECT DISTINCT lang AS label_name FROM corpus WHERE split = 'train' AND lang IS NOT NULL) v)"""

_LABELLED = """
labelled AS (
  SELECT c.doc_id, c.split, c.text, v.label, c.lang AS label_name
  FROM corpus c LEFT JOIN vocab v ON c.lang = v.label_name)"""

_TOKS = "string_split_regex(trim(text), '\\s+')"

_CODES = f"""
tok AS (SELECT doc_id, unnest({_TOKS}) AS t FROM documents),
h AS (SELECT doc_id, md5(t) AS m FROM tok),
hb AS (SELECT doc_id, CAST(('0x' || substr(m, 1, 8))::BIGINT % {HASH_DIM} AS INTEGER) AS b,
              CASE WHEN ('0x' || substr(m, 9, 1))::INTEGER < 8 THEN 1 ELSE -1 END AS s FROM h),
agg AS (SELECT doc_id, b, sum(s) AS v FROM hb GROUP BY doc_id, b)"""

_HASHED_SQL = _CODES + f""",
cells AS (SELECT d.doc_id, r.i FROM documents d, range({HASH_DIM}) r(i)),
hashed AS (
  SELECT c.doc_id, list(CAST(coalesce(a.v, 0) AS FLOAT) ORDER BY c.i) AS embedding
  FROM cells c LEFT JOIN agg a ON a.doc_id = c.doc_id AND a.b = c.i
  GROUP BY c.doc_id)"""

_UNIT_SQL = "WITH " + _HASHED_SQL + """,
norms AS (SELECT doc_id, embedding,
                 greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12) AS norm
          FROM hashed),
unit AS (SELECT doc_id, text, list_transform(embedding, lambda x: round(CAST(x / norm AS FLOAT)::DOUBLE, 6)) AS vector
         FROM norms JOIN documents USING (doc_id))"""


def _adam_sql(configs: list[dict]) -> str:
    """CTEs of full-batch Adam from zero weights over the train split's hashed vectors.

    ``w{e}`` holds the weights and ``l{e}`` the losses of epoch e per configuration.
    """
    grid = ", ".join(f"({i}, {c['lr']!r}::DOUBLE, {c['epochs']})" for i, c in enumerate(configs))
    parts = [_CORPUS.strip(), _VOCAB, _LABELLED, _CODES, f"""
x AS MATERIALIZED (
  SELECT l.doc_id, l.split, l.label AS y, a.b AS dim, a.v::DOUBLE AS x
  FROM labelled l JOIN agg a USING (doc_id) WHERE l.split IN ('train', 'test')
  UNION ALL SELECT doc_id, split, label, {HASH_DIM}, 1.0 FROM labelled WHERE split IN ('train', 'test'))""", """
xt AS MATERIALIZED (SELECT * FROM x WHERE split = 'train' AND y IS NOT NULL)""", """
rows_n AS (SELECT count(DISTINCT doc_id)::DOUBLE AS n FROM xt)""", f"""
cfg(c, lr, epochs) AS (VALUES {grid})""", f"""
w0 AS (SELECT c, lr, epochs, label, r.i::INTEGER AS dim, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v
       FROM cfg, vocab, range({HASH_DIM + 1}) r(i))"""]
    for e in range(1, max(c["epochs"] for c in configs) + 1):
        parts += [f"""
z{e} AS (SELECT c, doc_id, y, label, sum(x * w) AS z FROM xt JOIN w{e - 1} USING (dim)
         WHERE epochs >= {e} GROUP BY c, doc_id, y, label)""", f"""
p{e} AS MATERIALIZED (
  SELECT c, doc_id, y, label, zc - ln(sum(exp(zc)) OVER (PARTITION BY c, doc_id)) AS logp
  FROM (SELECT c, doc_id, y, label, z - max(z) OVER (PARTITION BY c, doc_id) AS zc FROM z{e}) t)""", f"""
l{e} AS (SELECT c, {e} AS epoch, -sum(logp) / any_value(n) AS loss FROM p{e}, rows_n WHERE label = y GROUP BY c)""", f"""
g{e} AS (SELECT c, label, dim, sum((exp(logp) - CASE WHEN label = p.y THEN 1 ELSE 0 END) * x) / any_value(n) AS g
         FROM p{e} p JOIN xt USING (doc_id), rows_n GROUP BY c, label, dim)""", f"""
u{e} AS (SELECT c, lr, epochs, label, dim, w, CASE WHEN epochs < {e} THEN m ELSE 0.9 * m + 0.1 * coalesce(g, 0) END AS m,
                CASE WHEN epochs < {e} THEN v ELSE 0.999 * v + 0.001 * coalesce(g, 0) * coalesce(g, 0) END AS v
         FROM w{e - 1} LEFT JOIN g{e} USING (c, label, dim))""", f"""
w{e} AS MATERIALIZED (
  SELECT c, lr, epochs, label, dim, m, v, CASE WHEN epochs < {e} THEN w ELSE
         w - lr * (m / (1 - 0.9 ** {e})) / (sqrt(v / (1 - 0.999 ** {e})) + 1e-8) END AS w FROM u{e})"""]
    losses = " UNION ALL ".join(f"SELECT * FROM l{e}" for e in range(1, max(c["epochs"] for c in configs) + 1))
    return "WITH " + ",".join(parts) + f""",
losses AS (SELECT c, CAST(epoch AS INTEGER) AS epoch, loss FROM ({losses}) u)"""


_EV = """
ev AS (
  SELECT *, event_type <> 'error' AS ok, ['0.6b', '4b', '8b'][user_id % 3 + 1] AS ms FROM events)"""

_EMB_RUNS = _EV + """,
emb0 AS (
  SELECT *, ['768', '1024', 'default', '512'][(event_id // 2) % 4 + 1] AS req,
         CAST(CASE ms WHEN '0.6b' THEN 1024 WHEN '4b' THEN 2560 WHEN '8b' THEN 4096 END AS INTEGER) AS native
  FROM ev),
emb_runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id,
         ms AS model_size,
         CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 5 = 0 THEN 'mlx' ELSE 'torch' END AS backend,
         CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device,
         req AS requested_dimension,
         CAST(500 AS INTEGER) AS num_samples,
         CAST(CASE ms WHEN '0.6b' THEN 16 WHEN '4b' THEN 8 WHEN '8b' THEN 4 END AS INTEGER) AS batch_size,
         CAST(256 AS INTEGER) AS max_length,
         CAST(CASE WHEN ok THEN 500 END AS INTEGER) AS actual_num_samples,
         CASE WHEN ok THEN native END AS native_hidden_size,
         CAST(CASE WHEN ok THEN
           CASE WHEN req = 'default' THEN native
                WHEN TRY_CAST(req AS INTEGER) IS NULL OR TRY_CAST(req AS INTEGER) < 1 THEN NULL
                ELSE least(TRY_CAST(req AS INTEGER), native) END END AS INTEGER) AS output_dimension,
         value AS embed_generation_time_sec,
         CASE WHEN ok AND value <> 0 THEN 500.0::DOUBLE / value END AS throughput_samples_per_sec,
         CASE WHEN ok THEN 1.0::DOUBLE END AS mean_l2_norm,
         CASE WHEN ok THEN 0.0::DOUBLE END AS std_l2_norm,
         CASE WHEN ok THEN round(value / 100, 4) END AS peak_mem_gb,
         CASE WHEN ok THEN 'success' ELSE 'failed' END AS status,
         CASE WHEN NOT ok THEN 'run failed: ' || props END AS error,
         ts AS started_at
  FROM emb0)"""

_CLS_RUNS = """
cls0 AS (
  SELECT *, CASE WHEN (event_id // 3) % 2 = 0 THEN 'frozen' ELSE 'lora' END AS md,
         event_type <> 'view' AS given,
         CASE WHEN ok THEN round(value / 4, 4) END AS tr
  FROM ev),
cls_runs AS (
  SELECT CAST(event_id AS VARCHAR) AS run_id,
         ms AS model_size, md AS mode,
         CASE WHEN event_id % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device,
         CAST(2000 AS INTEGER) AS train_samples,
         CAST(500 AS INTEGER) AS test_samples,
         CAST(CASE WHEN given THEN 1 + event_id % 10 END AS INTEGER) AS epochs,
         CAST(CASE WHEN given THEN 8 * (1 + user_id % 4) END AS INTEGER) AS batch_size,
         CAST(256 AS INTEGER) AS max_length,
         CASE WHEN given THEN 0.0001::DOUBLE * (1 + event_id % 10) END AS lr,
         CAST(CASE WHEN ok THEN 151 END AS INTEGER) AS num_classes,
         CAST(CASE WHEN ok THEN 2000 END AS INTEGER) AS actual_train_samples,
         CAST(CASE WHEN ok THEN 500 END AS INTEGER) AS actual_test_samples,
         CASE WHEN ok AND md = 'frozen' THEN value END AS embed_extraction_time_sec,
         CASE WHEN ok AND md = 'frozen' AND value <> 0 THEN 2500.0::DOUBLE / value END
           AS embed_extraction_samples_per_sec,
         CASE WHEN ok AND md = 'frozen' THEN round(value / 100, 4) END AS embed_extraction_peak_mem_gb,
         tr AS train_time_sec,
         CASE WHEN ok THEN round(value / 50, 4) END AS train_peak_mem_gb,
         CASE WHEN md = 'frozen' THEN (CASE WHEN ok THEN value END) + tr ELSE tr END AS total_time_sec,
         CASE WHEN ok THEN round(value / 600, 6) END AS accuracy,
         CASE WHEN ok THEN round(value / 700, 6) END AS macro_f1,
         CASE WHEN ok THEN round(value / 650, 6) END AS weighted_f1,
         CASE WHEN ok THEN 'success' ELSE 'failed' END AS status,
         CASE WHEN NOT ok THEN 'run failed: ' || props END AS error,
         ts AS started_at
  FROM cls0)"""

_RUNS = "WITH " + _EMB_RUNS.strip() + "," + _CLS_RUNS + "\n"


def _key_sql(id_col: str) -> str:
    return f"md5('{SEED}:' || CAST({id_col} AS VARCHAR))"


def _pos_sql(id_col: str) -> str:
    return f"CAST(row_number() OVER (ORDER BY {_key_sql(id_col)}, {id_col}) - 1 AS BIGINT)"


def _round_list_sql(expr: str) -> str:
    return f"list_transform({expr}, lambda x: round(x::DOUBLE, 6))"


# ---------------------------------------------------------- S: sources

@register("labelled_corpus", "WITH " + _CORPUS.strip() + "," + _VOCAB + "," + _LABELLED + """
SELECT doc_id, split, text, label, label_name FROM labelled""")
def q_labelled_corpus(spark, sf_dir):
    return SC.labelled_corpus(spark, sf_dir)


@register("sample_texts", "WITH " + _CORPUS.strip() + f"""
SELECT doc_id, text, position FROM (
  SELECT doc_id, text, {_pos_sql('doc_id')} AS position FROM corpus WHERE split = 'test') t
WHERE position < {SAMPLE_N}""")
def q_sample_texts(spark, sf_dir):
    return SC.sample_texts(spark, sf_dir, SAMPLE_N, "test", SEED)


@register("split_counts", "WITH " + _CORPUS.strip() + """
SELECT split, count(*) AS n_rows FROM corpus GROUP BY split""")
def q_split_counts(spark, sf_dir):
    return SC.split_counts(spark, sf_dir)


@register("backend_default", _RUNS + """
SELECT run_id, CASE WHEN event_type_is_click THEN 'torch' ELSE backend END AS backend
FROM (SELECT r.run_id, r.backend, e.event_type = 'click' AS event_type_is_click
      FROM emb_runs r JOIN events e ON r.run_id = CAST(e.event_id AS VARCHAR)) t""")
def q_backend_default(spark, sf_dir):
    """Records from ``click`` events predate the backend key (absent);
    signups carry an explicit null. Only the absent key defaults to torch."""
    runs = RU.embedding_runs(spark, sf_dir, carry=("event_type",))
    record = [c for c in runs.columns if c not in ("started_at", "event_type")]
    js = RU.runs_as_json_text(runs, absent_when=F.col("event_type") == "click", columns=record)
    return js.select("run_id", RU.resolve_backend_default(F.col("json")).alias("backend"))


def _runs_roundtrip(spark, sf_dir):
    runs = RU.embedding_runs(spark, sf_dir)
    path = scratch_path(spark, "runs")
    RU.write_runs(runs, path)
    return RU.read_runs(spark, path, RU.EMBEDDING_RUN_SCHEMA)


@register("read_runs", _RUNS + """
SELECT run_id, model_size, backend, device, requested_dimension, num_samples, batch_size, max_length,
       actual_num_samples, native_hidden_size, output_dimension, embed_generation_time_sec,
       throughput_samples_per_sec, mean_l2_norm, std_l2_norm, peak_mem_gb, status, error, started_at
FROM emb_runs""")
def q_read_runs(spark, sf_dir):
    """Run records written as a JSON table and read back with an explicit schema."""
    return _runs_roundtrip(spark, sf_dir)


_RUN_FIELDS = [f.name for f in RU.EMBEDDING_RUN_SCHEMA.fields if f.name != "status"]


@register("write_runs", _RUNS + f"""
SELECT status, run_id, CAST({len(_RUN_FIELDS)} AS INTEGER) AS n_keys,
       CAST({" + ".join(f"({c} IS NULL)::INTEGER" for c in _RUN_FIELDS)} AS INTEGER) AS n_null_keys,
       model_size, output_dimension, embed_generation_time_sec, error, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%f') AS started_at
FROM emb_runs""")
def q_write_runs(spark, sf_dir):
    """The lines as written, per status folder: every key is there, nulls are explicit."""
    path = scratch_path(spark, "runs")
    RU.write_runs(RU.embedding_runs(spark, sf_dir), path)
    lines = spark.read.schema("value string, status string").text(path)
    record = F.from_json("value", "map<string,string>")
    text = lambda name: F.col("record")[name]
    return lines.withColumn("record", record).select(
        "status", text("run_id").alias("run_id"), F.size("record").alias("n_keys"),
        F.size(F.map_filter("record", lambda _, v: v.isNull())).alias("n_null_keys"), text("model_size").alias("model_size"),
        text("output_dimension").cast("int").alias("output_dimension"),
        text("embed_generation_time_sec").cast("double").alias("embed_generation_time_sec"),
        text("error").alias("error"), text("started_at").alias("started_at"))


@register("load_runs", _RUNS + """,
logged AS (
  SELECT r.*, e.event_type, e.event_id FROM emb_runs r JOIN events e ON r.run_id = CAST(e.event_id AS VARCHAR)),
latest AS (
  SELECT * FROM logged QUALIFY row_number() OVER (
    PARTITION BY model_size, backend, device, requested_dimension, event_type ORDER BY started_at DESC, event_id DESC) = 1)
SELECT 'record' AS kind, run_id, model_size, CASE WHEN event_type = 'click' THEN 'torch' ELSE backend END AS backend, device,
       requested_dimension, output_dimension, status, error, embed_generation_time_sec, peak_mem_gb, started_at
FROM latest
UNION ALL
SELECT 'broken', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM latest WHERE event_type = 'view'""")
def q_load_runs(spark, sf_dir):
    """A folder with one indented JSON file for the latest run of every configuration, read back.

    Click records have no backend key, signups a null one; view records lie there a second time, cut off; a
    folder inside holds records that must not be read.
    """
    runs = RU.embedding_runs(spark, sf_dir, carry=("event_type", "event_id"))
    fields = [f.name for f in RU.EMBEDDING_RUN_SCHEMA.fields]
    cell = ["model_size", "backend", "device", "requested_dimension", "event_type"]
    newest = F.max_by(F.struct(*fields), F.struct("started_at", "event_id")).alias("run")
    latest = runs.groupBy(*cell).agg(newest).select("event_type", "run.*").persist()
    path = scratch_path(spark, "run-files")
    click = F.col("event_type") == "click"
    for part, names in ((latest.where(~click), fields), (latest.where(click), [f for f in fields if f != "backend"])):
        (part.select(*names).write.mode("append").option("maxRecordsPerFile", 1).option("pretty", True)
         .option("ignoreNullFields", False).option("timestampNTZFormat", RU.TIMESTAMP_FORMAT).json(path))
    cut = RU.runs_as_json_text(latest.where(F.col("event_type") == "view").drop("event_type", "started_at"))
    (cut.select(F.expr("left(json, length(json) - 9)").alias("value"))
     .write.mode("append").option("maxRecordsPerFile", 1).text(path))
    latest.select(*fields).write.json(f"{path}/older")
    latest.unpersist()
    records, broken = RU.load_runs(spark, path, pattern="*.{json,txt}")
    shown = ["run_id", "model_size", "backend", "device", "requested_dimension", "output_dimension", "status", "error",
             "embed_generation_time_sec", "peak_mem_gb", "started_at"]
    return records.select(F.lit("record").alias("kind"), *shown).unionByName(
        broken.select(F.lit("broken").alias("kind")), allowMissingColumns=True)


@register("run_log", _RUNS + """,
logged AS (
  SELECT r.*, e.event_type FROM emb_runs r JOIN events e ON r.run_id = CAST(e.event_id AS VARCHAR))
SELECT 'record' AS kind, CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS commit, run_id, model_size,
       CASE WHEN event_type = 'click' THEN 'torch' ELSE backend END AS backend, device, requested_dimension,
       CASE WHEN event_type = 'error' THEN 'success' ELSE status END AS status,
       CASE WHEN event_type <> 'error' THEN error END AS error, embed_generation_time_sec, started_at
FROM logged
UNION ALL
SELECT 'broken', 2, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM logged WHERE event_type = 'view'""")
def q_run_log(spark, sf_dir):
    """All records logged, failed runs logged again after a repeat, cut-off lines of the view runs, read back.

    Click records have no backend key, signups a null one; a cut-off line leaves its run's record as it was.
    """
    runs = RU.embedding_runs(spark, sf_dir, carry=("event_type",))
    fields = [c for c in runs.columns if c != "event_type"]
    as_text = lambda df: RU.runs_as_json_text(
        df.withColumn("started_at", F.date_format("started_at", RU.TIMESTAMP_FORMAT)),
        absent_when=F.col("event_type") == "click", columns=fields)
    path = scratch_path(spark, "run-log")
    RU.append_run_log(as_text(runs), path, 0)
    repeated = runs.where(F.col("event_type") == "error")
    RU.append_run_log(as_text(repeated.withColumn("status", F.lit("success")).withColumn("error", F.lit(None).cast("string"))),
                      path, 1)
    cut = as_text(runs.where(F.col("event_type") == "view")).withColumn("json", F.expr("left(json, length(json) - 9)"))
    RU.append_run_log(cut, path, 2)
    records, broken = RU.read_run_log(spark, path)
    shown = ["commit", "run_id", "model_size", "backend", "device", "requested_dimension", "status", "error",
             "embed_generation_time_sec", "started_at"]
    return records.select(F.lit("record").alias("kind"), *shown).unionByName(
        broken.select(F.lit("broken").alias("kind"), "commit"), allowMissingColumns=True)


@register("vector_export", _UNIT_SQL + f"""
SELECT doc_id, 'hashed_dim{HASH_DIM}_cpu' AS file_name, text, 'hashed' AS model_size, 'spark' AS backend,
       'cpu' AS device, CAST({HASH_DIM} AS INTEGER) AS native_hidden_size,
       CAST({HASH_DIM} AS INTEGER) AS output_dimension, vector
FROM unit""")
def q_vector_export(spark, sf_dir):
    """Every document's unit hashed vector as a JSON document with its file name, read back."""
    docs = _documents(spark, sf_dir)
    enc = E.encode_hashed(docs.select("doc_id", "text"), HASH_DIM, carry=["text"], num_partitions=_parts(spark))
    out = vector_export(VO.l2_normalize(enc), "hashed", "spark", "cpu", HASH_DIM)
    fields = F.from_json("json", "text string, model_size string, backend string, device string, "
                                 "native_hidden_size int, output_dimension int, vector array<float>")
    return (out.select("doc_id", "file_name", fields.alias("r")).select("doc_id", "file_name", "r.*")
               .withColumn("vector", V.to_double_rounded("vector")))


# ---------------------------------------------------------- P: sampling

@register("seeded_order", f"""
SELECT doc_id, {_key_sql('doc_id')} AS sort_key, {_pos_sql('doc_id')} AS position FROM documents""")
def q_seeded_order(spark, sf_dir):
    return S.seeded_order(_documents(spark, sf_dir).select("doc_id"), "doc_id", SEED)


@register("sample_n", f"""
SELECT doc_id, position FROM (SELECT doc_id, {_pos_sql('doc_id')} AS position FROM documents) t
WHERE position < {SAMPLE_N}""")
def q_sample_n(spark, sf_dir):
    return S.sample_n(_documents(spark, sf_dir).select("doc_id"), SAMPLE_N, "doc_id", SEED).select("doc_id", "position")


@register("sample_shortfall", "WITH " + _CORPUS.strip() + f"""
SELECT CAST({SAMPLE_N} AS BIGINT) AS requested, count(*) AS available,
       least(CAST({SAMPLE_N} AS BIGINT), count(*)) AS taken, count(*) < {SAMPLE_N} AS shortfall
FROM corpus WHERE split = 'test'""")
def q_sample_shortfall(spark, sf_dir):
    c = SC.corpus(spark, sf_dir).where(F.col("split") == "test")
    return S.sample_shortfall(c, SAMPLE_N, "doc_id", SEED)


@register("train_test_split", "WITH " + _CORPUS.strip() + "," + _VOCAB + "," + _LABELLED + f"""
SELECT doc_id, split, label, position FROM (
  SELECT doc_id, split, label,
         CAST(row_number() OVER (PARTITION BY split ORDER BY {_key_sql('doc_id')}, doc_id) - 1 AS BIGINT) AS position
  FROM labelled WHERE split IN ('train', 'test')) t
WHERE (split = 'train' AND position < {TRAIN_N}) OR (split = 'test' AND position < {TEST_N})""")
def q_train_test_split(spark, sf_dir):
    lc = SC.labelled_corpus(spark, sf_dir).select("doc_id", "split", "label")
    return S.train_test_split(lc, TRAIN_N, TEST_N, "doc_id", SEED).select("doc_id", "split", "label", "position")


@register("label_vocab", "WITH " + _CORPUS.strip() + "," + _VOCAB + """
SELECT label, label_name FROM vocab""")
def q_label_vocab(spark, sf_dir):
    return S.label_vocab(SC.corpus(spark, sf_dir))


@register("runs_sorted", _RUNS + """
SELECT run_id, model_size, backend, device, requested_dimension,
       CAST(row_number() OVER (ORDER BY coalesce(model_size, ''), coalesce(backend, ''), coalesce(device, ''),
                                        coalesce(requested_dimension, ''), run_id) - 1 AS BIGINT) AS position
FROM emb_runs""")
def q_runs_sorted(spark, sf_dir):
    runs = RU.embedding_runs(spark, sf_dir).select("run_id", "model_size", "backend", "device", "requested_dimension")
    return R.runs_sorted(runs)


@register("cls_runs_sorted", _RUNS + """
SELECT run_id, model_size, mode, device,
       CAST(row_number() OVER (ORDER BY coalesce(model_size, ''), coalesce(mode, ''), coalesce(device, ''), run_id)
            - 1 AS BIGINT) AS position
FROM cls_runs""")
def q_cls_runs_sorted(spark, sf_dir):
    runs = RU.classification_runs(spark, sf_dir).select("run_id", "model_size", "mode", "device")
    return R.runs_sorted(runs, ("model_size", "mode", "device"))


@register("runs_ranked", _RUNS + """
SELECT run_id, model_size, backend, device, requested_dimension, dim_rank,
       CAST(row_number() OVER (ORDER BY model_size ASC NULLS LAST, backend ASC NULLS LAST, device ASC NULLS LAST,
                                        dim_rank ASC NULLS LAST, requested_dimension ASC NULLS LAST, run_id)
            - 1 AS BIGINT) AS position
FROM (SELECT *, CAST(CASE requested_dimension WHEN '768' THEN 0 WHEN '1024' THEN 1 WHEN 'default' THEN 2 END
                     AS INTEGER) AS dim_rank FROM emb_runs) t""")
def q_runs_ranked(spark, sf_dir):
    runs = RU.embedding_runs(spark, sf_dir).select("run_id", "model_size", "backend", "device", "requested_dimension")
    return R.runs_ranked(runs)


# ---------------------------------------------------------- T: text

@register("tokens_truncated", f"""
SELECT doc_id, CAST(len(toks) AS INTEGER) AS n_tokens, toks[1:{MAX_LENGTH}] AS tokens,
       CAST(len(toks[1:{MAX_LENGTH}]) AS INTEGER) AS n_kept
FROM (SELECT doc_id, {_TOKS} AS toks FROM documents) t""")
def q_tokens_truncated(spark, sf_dir):
    return X.tokens_truncated(_documents(spark, sf_dir), "text", "doc_id", MAX_LENGTH)


@register("truncation_report", f"""
SELECT count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens,
       CAST(sum(CASE WHEN n > {MAX_LENGTH} THEN 1 ELSE 0 END) AS BIGINT) AS n_truncated,
       CAST(sum(greatest(n - {MAX_LENGTH}, 0)) AS BIGINT) AS tokens_lost
FROM (SELECT len({_TOKS}) AS n FROM documents) t""")
def q_truncation_report(spark, sf_dir):
    return X.truncation_report(_documents(spark, sf_dir), "text", MAX_LENGTH)


@register("batch_assign", f"""
SELECT doc_id, sort_key, position, CAST(position // {BATCH_SIZE} AS BIGINT) AS batch_id FROM (
  SELECT doc_id, {_key_sql('doc_id')} AS sort_key, {_pos_sql('doc_id')} AS position FROM documents) t""")
def q_batch_assign(spark, sf_dir):
    return X.batch_assign(_documents(spark, sf_dir).select("doc_id"), BATCH_SIZE, "doc_id", SEED)


_PADDED_SQL = f"""
WITH t AS (
  SELECT doc_id, {_TOKS}[1:{MAX_LENGTH}] AS tokens, {_pos_sql('doc_id')} AS position FROM documents),
b AS (SELECT *, CAST(len(tokens) AS INTEGER) AS n_kept, CAST(position // {BATCH_SIZE} AS BIGINT) AS batch_id FROM t),
m AS (SELECT *, max(n_kept) OVER (PARTITION BY batch_id) AS batch_len FROM b)"""


@register("left_padded", _PADDED_SQL + """
SELECT doc_id, batch_id, position, n_kept, batch_len,
       list_concat(list_transform(range(batch_len - n_kept), lambda i: '<pad>'), tokens) AS input_tokens,
       list_concat(list_transform(range(batch_len - n_kept), lambda i: 0),
                   list_transform(range(n_kept), lambda i: 1)) AS attention_mask
FROM m""")
def q_left_padded(spark, sf_dir):
    return X.left_padded(_documents(spark, sf_dir), BATCH_SIZE, "text", "doc_id", MAX_LENGTH, SEED)


@register("padding_waste", _PADDED_SQL + """
SELECT batch_id, count(*) AS rows, max(n_kept) AS batch_len, CAST(sum(n_kept) AS BIGINT) AS real_tokens,
       CAST(max(n_kept) * count(*) AS BIGINT) AS padded_tokens,
       round(1.0 - sum(n_kept)::DOUBLE / nullif(max(n_kept) * count(*), 0), 6) AS waste
FROM b GROUP BY batch_id""")
def q_padding_waste(spark, sf_dir):
    df = X.padding_waste(_documents(spark, sf_dir), BATCH_SIZE, "text", "doc_id", MAX_LENGTH, SEED)
    return df.withColumn("waste", _r("waste"))


# ---------------------------------------------------------- V: vectors

@register("encode_hashed", f"""
WITH {_HASHED_SQL}
SELECT doc_id, embedding FROM hashed""")
def q_encode_hashed(spark, sf_dir):
    return E.encode_hashed(_documents(spark, sf_dir), HASH_DIM, num_partitions=_parts(spark))


@register("encode_udf", _UNIT_SQL + """
SELECT doc_id, vector AS embedding FROM unit""")
def q_encode_udf(spark, sf_dir):
    """V1: the pluggable encoder path (hashed stand-in), normalised, native width."""
    enc = E.HashedEncoder(HASH_DIM)
    out = E.encode(_documents(spark, sf_dir), enc, "text", "doc_id", BATCH_SIZE, None, True,
                   num_partitions=_parts(spark))
    return out.withColumn("embedding", V.to_double_rounded("embedding"))


@register("last_token_pool", """
SELECT conv_id,
       arg_max([length(text)::DOUBLE, turn::DOUBLE], turn) FILTER (WHERE role <> 'system') AS pooled,
       max(turn) FILTER (WHERE role <> 'system') AS pooled_position
FROM conversations GROUP BY conv_id""")
def q_last_token_pool(spark, sf_dir):
    """V3 on conversations: turn = position, system turns = padding (mask 0)."""
    conv = read_table(spark, sf_dir, "conversations")
    long_form = conv.select(
        "conv_id", "turn",
        F.when(F.col("role") != "system", F.lit(1)).otherwise(F.lit(0)).alias("mask"),
        F.array(F.length("text").cast("double"), F.col("turn").cast("double")).alias("hidden"))
    return E.last_token_pool(long_form, "conv_id", "turn", "mask", "hidden")


@register("mrl_truncate", f"""
SELECT vec_id, {_round_list_sql(f'embedding[1:{TRUNC_DIM}]')} AS embedding FROM embeddings""")
def q_mrl_truncate(spark, sf_dir):
    df = VO.mrl_truncate(_embeddings(spark, sf_dir).select("vec_id", "embedding"), TRUNC_DIM)
    return df.select("vec_id", V.to_double_rounded("embedding").alias("embedding"))


@register("effective_dim", _RUNS + """
SELECT run_id, requested_dimension,
       CAST(CASE model_size WHEN '0.6b' THEN 1024 WHEN '4b' THEN 2560 WHEN '8b' THEN 4096 END AS INTEGER) AS native,
       CAST(CASE WHEN requested_dimension = 'default'
                   THEN CASE model_size WHEN '0.6b' THEN 1024 WHEN '4b' THEN 2560 WHEN '8b' THEN 4096 END
                 WHEN TRY_CAST(requested_dimension AS INTEGER) IS NULL
                      OR TRY_CAST(requested_dimension AS INTEGER) < 1 THEN NULL
                 ELSE least(TRY_CAST(requested_dimension AS INTEGER),
                            CASE model_size WHEN '0.6b' THEN 1024 WHEN '4b' THEN 2560 WHEN '8b' THEN 4096 END)
            END AS INTEGER) AS effective_dim
FROM emb_runs""")
def q_effective_dim(spark, sf_dir):
    runs = RU.embedding_runs(spark, sf_dir)
    native = F.element_at(G.literal_map(RU.NATIVE_HIDDEN), F.col("model_size")).cast("int")
    return runs.select("run_id", "requested_dimension", native.alias("native"),
                       RU.effective_dimension(F.col("requested_dimension"), native).cast("int").alias("effective_dim"))


_NORM = "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))"


@register("l2_normalize", f"""
SELECT vec_id, {_round_list_sql(f'list_transform(embedding, lambda x: (x::DOUBLE / greatest({_NORM}, 1e-12))::FLOAT)')}
       AS embedding FROM embeddings""")
def q_l2_normalize(spark, sf_dir):
    df = VO.l2_normalize(_embeddings(spark, sf_dir).select("vec_id", "embedding"))
    return df.select("vec_id", V.to_double_rounded("embedding").alias("embedding"))


_UNIT = f"list_transform(embedding, lambda x: (x::DOUBLE / greatest({_NORM}, 1e-12))::FLOAT)"


@register("renormalize_truncated", f"""
WITH u AS (SELECT vec_id, ({_UNIT})[1:{TRUNC_DIM}] AS t FROM embeddings),
n AS (SELECT vec_id, t, sqrt(list_sum(list_transform(t, lambda x: x::DOUBLE * x::DOUBLE))) AS nn FROM u)
SELECT vec_id, CASE WHEN nn > 0 THEN {_round_list_sql('list_transform(t, lambda x: (x::DOUBLE / nn)::FLOAT)')} END
       AS embedding FROM n""")
def q_renormalize_truncated(spark, sf_dir):
    df = VO.renormalize_truncated(_embeddings(spark, sf_dir).select("vec_id", "embedding"), TRUNC_DIM)
    return df.select("vec_id", V.to_double_rounded("embedding").alias("embedding"))


@register("mrl_path_check", f"""
WITH a AS (
  SELECT vec_id, embedding[1:{TRUNC_DIM}] AS tr, ({_UNIT})[1:{TRUNC_DIM}] AS ut FROM embeddings),
b AS (
  SELECT vec_id, tr, ut,
         sqrt(list_sum(list_transform(tr, lambda x: x::DOUBLE * x::DOUBLE))) AS n1,
         sqrt(list_sum(list_transform(ut, lambda x: x::DOUBLE * x::DOUBLE))) AS n2 FROM a),
c AS (
  SELECT vec_id, list_transform(tr, lambda x: (x::DOUBLE / greatest(n1, 1e-12))::FLOAT) AS p1,
         CASE WHEN n2 > 0 THEN list_transform(ut, lambda x: (x::DOUBLE / n2)::FLOAT) END AS p2 FROM b)
SELECT vec_id, round(list_max(list_transform(list_zip(p1, p2), lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))), 6)
       AS max_abs_diff FROM c""")
def q_mrl_path_check(spark, sf_dir):
    df = VO.mrl_path_check(_embeddings(spark, sf_dir), TRUNC_DIM)
    return df.withColumn("max_abs_diff", _r("max_abs_diff"))


@register("norm_stats", f"""
WITH n AS (SELECT sqrt(list_sum(list_transform(embedding[1:{TRUNC_DIM}], lambda x: x::DOUBLE * x::DOUBLE))) AS nn
           FROM embeddings)
SELECT count(*) AS n_vectors, round(avg(nn), 6) AS mean_l2_norm, round(stddev_pop(nn), 6) AS std_l2_norm FROM n""")
def q_norm_stats(spark, sf_dir):
    df = VO.norm_stats(VO.mrl_truncate(_embeddings(spark, sf_dir).select("embedding"), TRUNC_DIM))
    return df.select("n_vectors", _r("mean_l2_norm").alias("mean_l2_norm"), _r("std_l2_norm").alias("std_l2_norm"))


@register("vector_summary", """
WITH s AS (
  SELECT vec_id, len(embedding) AS width,
         list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS ss,
         list_sum(list_transform(embedding, lambda x: x::DOUBLE)) AS sm,
         list_min(embedding)::DOUBLE AS mn, list_max(embedding)::DOUBLE AS mx FROM embeddings)
SELECT vec_id, CAST(width AS INTEGER) AS width, round(sqrt(ss), 6) AS l2_norm,
       round(mn, 6) AS min_value, round(mx, 6) AS max_value, round(sm / width, 6) AS mean_value,
       round(sqrt(greatest(ss / width - (sm / width) * (sm / width), 0)), 6) AS std_value
FROM s""")
def q_vector_summary(spark, sf_dir):
    df = VO.vector_summary(_embeddings(spark, sf_dir))
    return df.select("vec_id", "width", *[_r(c).alias(c) for c in
                                          ("l2_norm", "min_value", "max_value", "mean_value", "std_value")])


@register("vector_preview", f"""
SELECT vec_id, {_round_list_sql(f'embedding[1:{PREVIEW_N}]')} AS head,
       {_round_list_sql(f'embedding[greatest(len(embedding) - {PREVIEW_N}, 0) + 1:len(embedding)]')} AS tail
FROM embeddings""")
def q_vector_preview(spark, sf_dir):
    df = VO.vector_preview(_embeddings(spark, sf_dir), PREVIEW_N)
    return df.select("vec_id", V.to_double_rounded("head").alias("head"), V.to_double_rounded("tail").alias("tail"))


# ---------------------------------------------------------- C: training

@register("softmax_grad0", """
WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS dim
           FROM embeddings WHERE label IS NOT NULL),
c AS (SELECT label, dim, sum(x) AS s, count(*) AS n_k FROM e GROUP BY label, dim),
w AS (SELECT label, dim, s, sum(s) OVER (PARTITION BY dim) AS tot,
             CAST(sum(n_k) OVER (PARTITION BY dim) AS DOUBLE) AS n_all,
             CAST(count(*) OVER (PARTITION BY dim) AS DOUBLE) AS k FROM c)
SELECT label, CAST(dim AS INTEGER) AS dim, round(tot / (k * n_all) - s / n_all, 6) AS grad, round(ln(k), 6) AS loss
FROM w""")
def q_softmax_grad0(spark, sf_dir):
    df = C.softmax_grad0(_embeddings(spark, sf_dir), "embedding", "label")
    return df.select("label", "dim", _r("grad").alias("grad"), _r("loss").alias("loss"))


_PREDICT_SQL = """
WITH s AS (SELECT vec_id, label, embedding,
                  ('0x' || substr(md5('split:' || CAST(vec_id AS VARCHAR)), 1, 8))::BIGINT % 100 AS b
           FROM embeddings),
e AS (SELECT vec_id, label, b, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM s),
cen AS (SELECT label AS k, dim, round(avg(x), 6) AS w FROM e WHERE b < 80 AND label IS NOT NULL GROUP BY label, dim),
sc AS (SELECT e.vec_id, cen.k, sum(e.x * cen.w) AS score FROM e JOIN cen ON e.dim = cen.dim GROUP BY e.vec_id, cen.k),
best AS (SELECT vec_id, k FROM (
  SELECT vec_id, k, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, k ASC) AS rn FROM sc) t WHERE rn = 1)
SELECT s.vec_id, s.label AS truth, CAST(best.k AS INTEGER) AS pred FROM s JOIN best ON s.vec_id = best.vec_id"""


@register("linear_predict", _PREDICT_SQL)
def q_linear_predict(spark, sf_dir):
    """C4: centroid head fitted on the train split, argmax over every vector."""
    emb = _embeddings(spark, sf_dir)
    train = emb.where(split_name("vec_id") == "train")
    W, classes = C.collect_weights(C.class_centroids(train, "embedding", "label"))
    return C.linear_predict(emb, W, classes, "embedding", "label", "vec_id")


@register("align", _PREDICT_SQL)
def q_align(spark, sf_dir):
    """M5: predictions kept apart from their truth, paired by id."""
    truth = _embeddings(spark, sf_dir).select("vec_id", F.col("label").alias("truth"))
    return M.align(truth, q_linear_predict(spark, sf_dir).select("vec_id", "pred"), "vec_id")


@register("head_gradient", _PREDICT_SQL.partition("sc AS (")[0] + """
tr AS (SELECT vec_id, label, dim - 1 AS dim, x FROM e WHERE b < 80 AND label IS NOT NULL
       UNION ALL SELECT vec_id, label, len(embedding), 1.0 FROM s WHERE b < 80 AND label IS NOT NULL),
z AS (SELECT vec_id, label AS y, k, sum(x * w) AS z FROM tr JOIN cen ON tr.dim = cen.dim - 1 GROUP BY vec_id, label, k),
p AS (SELECT vec_id, y, k, c - ln(sum(exp(c)) OVER (PARTITION BY vec_id)) AS logp
      FROM (SELECT vec_id, y, k, z - max(z) OVER (PARTITION BY vec_id) AS c FROM z) t),
l AS (SELECT -sum(logp) / count(*) AS loss, count(*) AS n FROM p WHERE k = y)
SELECT CAST(k AS INTEGER) AS label, CAST(dim AS INTEGER) AS dim,
       round(sum((exp(logp) - CASE WHEN k = y THEN 1 ELSE 0 END) * x) / any_value(n), 6) AS grad,
       round(any_value(loss), 6) AS loss, any_value(n) AS n_rows
FROM p JOIN tr USING (vec_id), l GROUP BY k, dim""")
def q_head_gradient(spark, sf_dir):
    """Loss and gradient of the centroid head over its train split, in one pass."""
    train = _embeddings(spark, sf_dir).where(split_name("vec_id") == "train")
    W, classes = C.collect_weights(C.class_centroids(train, "embedding", "label"))
    loss, n, grad = C.head_gradient(train, W, classes, "embedding", "label")
    cells = [(int(k), j, float(g)) for k, row in zip(classes, grad) for j, g in enumerate(row)]   # model-sized, checked
    return spark.createDataFrame(cells, "label int, dim int, grad double").select(
        "label", "dim", _r("grad").alias("grad"), _r(F.lit(loss)).alias("loss"), F.lit(n).cast("long").alias("n_rows"))


def _features(spark, sf_dir):
    """(train features, test features, number of classes), encoded per split."""
    from vectorloom.plans.classification import split_features
    frames, k = split_features(spark, sf_dir, HASH_DIM, num_partitions=_parts(spark))
    return frames["train"], frames["test"], k


@register("fit_head")
def q_fit_head(spark, sf_dir):
    """Spark ML head on raw hashed vectors, language as the label; test metrics, and the certificate of the fit."""
    train, test, k = _features(spark, sf_dir)
    model, preds = C.fit_head(train, test, k, "features", "label", max_iter=100)
    mets = M.classification_metrics(preds)
    W = np.column_stack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()])
    loss, _, grad = C.head_gradient(train, W)
    return mets.select("*", F.lit(int(model.summary.totalIterations)).alias("iterations"),
                       F.lit(loss).cast("double").alias("final_loss"),
                       F.lit(float(np.abs(grad).max())).alias("gradient_max"))


CURVE = [{"lr": 1e-3, "epochs": 10}]
MINI_BATCH, MINI_LR = 32, 1e-3


def _minibatch_sql(batch: int, lr: float, seed: int) -> str:
    """One epoch of mini-batch Adam as a recursion over the steps; the state is the weights and moments."""
    logits = """(SELECT doc_id, y, label, n, zc - ln(sum(exp(zc)) OVER (PARTITION BY doc_id)) AS logp FROM (
      SELECT doc_id, y, label, n, z - max(z) OVER (PARTITION BY doc_id) AS zc FROM (
        SELECT x.doc_id, x.y, s.label, any_value(k.n) AS n, sum(x.x * s.w) AS z
        FROM s JOIN xt x ON x.step = s.t AND x.dim = s.dim JOIN sizes k ON k.step = s.t GROUP BY x.doc_id, x.y, s.label)))"""
    return f"""WITH RECURSIVE {_CORPUS.strip()},{_VOCAB},{_LABELLED},{_CODES},
ids AS MATERIALIZED (
  SELECT doc_id, label AS y, (row_number() OVER (ORDER BY md5('{seed}:' || CAST(doc_id AS VARCHAR)), doc_id) - 1) // {batch} AS step
  FROM labelled WHERE split = 'train' AND label IS NOT NULL),
xt AS MATERIALIZED (
  SELECT step, doc_id, y, b AS dim, v::DOUBLE AS x FROM ids JOIN agg USING (doc_id)
  UNION ALL SELECT step, doc_id, y, {HASH_DIM}, 1.0 FROM ids),
sizes AS MATERIALIZED (SELECT step, count(*)::DOUBLE AS n FROM ids GROUP BY step),
s AS (
  SELECT 0::BIGINT AS t, label, r.i::INTEGER AS dim, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v,
         NULL::DOUBLE AS loss, NULL::DOUBLE AS n
  FROM vocab, range({HASH_DIM + 1}) r(i)
  UNION ALL
  SELECT t + 1, label, dim, w - {lr!r} * (m1 / (1 - 0.9 ** (t + 1))) / (sqrt(v1 / (1 - 0.999 ** (t + 1))) + 1e-8), m1, v1, loss, n
  FROM (
    SELECT s.t, s.label, s.dim, s.w, 0.9 * s.m + 0.1 * coalesce(g.g, 0) AS m1,
           0.999 * s.v + 0.001 * coalesce(g.g, 0) * coalesce(g.g, 0) AS v1,
           (SELECT -sum(logp) FILTER (WHERE label = y) / any_value(n) FROM {logits} p) AS loss,
           (SELECT any_value(n) FROM {logits} p) AS n
    FROM s LEFT JOIN (
      SELECT p.label, x.dim, sum((exp(p.logp) - CASE WHEN p.label = p.y THEN 1 ELSE 0 END) * x.x) / any_value(p.n) AS g
      FROM {logits} p JOIN xt x USING (doc_id) GROUP BY p.label, x.dim) g ON g.label = s.label AND g.dim = s.dim
    WHERE s.t < (SELECT max(step) + 1 FROM ids)) u
)
SELECT 1::INTEGER AS epoch, (t - 1)::INTEGER AS step, any_value(n)::BIGINT AS n_rows, round(any_value(loss), 6) AS loss
FROM s WHERE t > 0 GROUP BY t"""


@register("minibatch_curve", _minibatch_sql(MINI_BATCH, MINI_LR, C.epoch_seed(SEED, 1)))
def q_minibatch_curve(spark, sf_dir):
    """C2 at the reference's batch size: one epoch over the whole train split, the loss of every step."""
    train, _, k = _features(spark, sf_dir)
    return C.minibatch_curve(train, k, HASH_DIM, MINI_BATCH, "doc_id", 1, MINI_LR, seed=SEED).withColumn("loss", _r("loss"))


SWEEP = [{"lr": lr, "epochs": ep} for lr in (1e-3, 1e-2, 1e-1) for ep in (3, 10)]


@register("loss_curve", _adam_sql(CURVE) + """
SELECT epoch, round(loss, 6) AS loss FROM losses""")
def q_loss_curve(spark, sf_dir):
    """Ten epochs of full-batch Adam at the frozen-mode learning rate."""
    train, _, k = _features(spark, sf_dir)
    return C.loss_curve(train, k, HASH_DIM, **CURVE[0]).withColumn("loss", _r("loss"))


@register("sweep_heads", _adam_sql(SWEEP) + f""",
zt AS (SELECT c, doc_id, y, label, sum(x * w) AS z FROM x JOIN w{max(c["epochs"] for c in SWEEP)} USING (dim)
       WHERE split = 'test' GROUP BY c, doc_id, y, label),
pred AS (SELECT c, doc_id, y, label AS pred FROM zt
         QUALIFY row_number() OVER (PARTITION BY c, doc_id ORDER BY z DESC, label) = 1),
cls AS (SELECT c, cls, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
          SELECT c, y AS cls, 1 AS t, 0 AS p, CASE WHEN y = pred THEN 1 ELSE 0 END AS tp FROM pred
          UNION ALL SELECT c, pred, 0, 1, 0 FROM pred) u GROUP BY c, cls),
f AS (SELECT *, 2.0 * tp / (support + predicted) AS f1 FROM cls WHERE cls IS NOT NULL),
mets AS (SELECT c, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, count(*) AS n_classes
         FROM f GROUP BY c),
acc AS (SELECT c, count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred GROUP BY c)
SELECT CAST(c AS INTEGER) AS config_id, lr, CAST(epochs AS INTEGER) AS epochs, CAST(NULL AS INTEGER) AS batch_size,
       round(loss, 6) AS final_loss, CAST(n AS BIGINT) AS n, round(accuracy, 6) AS accuracy,
       round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1, n_classes
FROM cfg JOIN losses USING (c) JOIN mets USING (c) JOIN acc USING (c) WHERE losses.epoch = cfg.epochs""")
def q_sweep_heads(spark, sf_dir):
    """A grid of (lr, epochs) heads trained together, scored on the test split."""
    train, test, k = _features(spark, sf_dir)
    out = C.sweep_heads(train, test, k, HASH_DIM, SWEEP)
    return out.select(*[_r(c).alias(c) if c in ("final_loss", "accuracy", "macro_f1", "weighted_f1") else c
                        for c in out.columns])


ADAPTER_EPOCHS = 3


def _stream_sql(start: str, place: str) -> str:
    """Number ``place`` (from 1), in [0, 1), of the SplitMix64 stream that starts at ``start``."""
    wrap = lambda e: f"(({e}) % 18446744073709551616::UHUGEINT)::UBIGINT"
    b = wrap(f"({start})::UHUGEINT + ({place})::UHUGEINT * {0x9E3779B97F4A7C15}::UHUGEINT")
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        b = f"(SELECT {wrap(f'xor(b, b >> {shift})::UHUGEINT * {mult}::UHUGEINT')} FROM (SELECT {b} AS b) t)"
    return f"(SELECT (xor(b, b >> 31) >> 11)::DOUBLE / {1 << 53} FROM (SELECT {b} AS b) t)"


def _adapter_sql(epochs: int, lr: float = 2e-4) -> str:
    """Full-batch AdamW of adapter and head, written on the small products of the factors.

    With ``wb = W B``, ``q = dz' H`` and ``p = dz' xd`` (sums over the rows): grad W = dz' x + s q B', grad B = s W' q,
    grad A = s wb' p. So no row of adapted vectors is ever formed.
    """
    d, r, s, drop = HASH_DIM, C.ADAPTER_RANK, C.ADAPTER_ALPHA / C.ADAPTER_RANK, C.ADAPTER_DROPOUT

    def logits(e: int, rows: str, cells: str, hidden: str) -> str:
        return f"""
SELECT t.doc_id, t.y, w.i AS label, w.w + coalesce(l.z, 0) + {s} * coalesce(a.z, 0) AS z
FROM {rows} t JOIN p{e} w ON w.blk = 'W' AND w.j = {d}
LEFT JOIN (SELECT doc_id, p.i AS label, sum(x * w) AS z FROM {cells} JOIN p{e} p ON blk = 'W' AND j = dim GROUP BY doc_id, p.i) l
  ON l.doc_id = t.doc_id AND l.label = w.i
LEFT JOIN (SELECT doc_id, label, sum(h * wb) AS z FROM {hidden} JOIN wb{e} USING (r) GROUP BY doc_id, label) a
  ON a.doc_id = t.doc_id AND a.label = w.i"""

    wb = lambda e: f"""
wb{e} AS MATERIALIZED (SELECT w.i AS label, b.j AS r, sum(w.w * b.w) AS wb FROM p{e} w JOIN p{e} b ON w.j = b.i
                       WHERE w.blk = 'W' AND b.blk = 'B' GROUP BY w.i, b.j)"""  # noqa: E731
    start = f"(2 * {_stream_sql(str(SEED), 'place + 1')} - 1) / sqrt({d}::DOUBLE)"
    parts = [_CORPUS.strip(), _VOCAB, _LABELLED, _CODES, """
rows_t AS MATERIALIZED (SELECT doc_id, label AS y FROM labelled WHERE split = 'train' AND label IS NOT NULL)""", """
rows_e AS MATERIALIZED (SELECT doc_id, label AS y FROM labelled WHERE split = 'test')""", """
x_t AS MATERIALIZED (SELECT doc_id, b AS dim, v::DOUBLE AS x FROM rows_t JOIN agg USING (doc_id))""", """
x_e AS MATERIALIZED (SELECT doc_id, b AS dim, v::DOUBLE AS x FROM rows_e JOIN agg USING (doc_id))""", """
rows_n AS (SELECT count(*)::DOUBLE AS n FROM rows_t)""", f"""
p0 AS MATERIALIZED (
  SELECT blk, i, j, CASE WHEN blk = 'B' THEN 0.0::DOUBLE ELSE {start} END AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (
    SELECT 'A' AS blk, a.i::INTEGER AS i, b.j::INTEGER AS j, a.i * {d} + b.j AS place FROM range({r}) a(i), range({d}) b(j)
    UNION ALL SELECT 'B', a.i::INTEGER, b.j::INTEGER, {r * d} + a.i * {r} + b.j FROM range({d}) a(i), range({r}) b(j)
    UNION ALL SELECT 'W', label, b.j::INTEGER, {2 * r * d} + label * {d + 1} + b.j FROM vocab, range({d + 1}) b(j)) u)"""]
    for e in range(1, epochs + 1):
        h = f"('0x' || substr(md5('{C.epoch_seed(SEED, e)}:' || CAST(doc_id AS VARCHAR)), 1, 15))::BIGINT"
        parts += [wb(e - 1), f"""
xd{e} AS MATERIALIZED (SELECT doc_id, dim, x / {1 - drop!r} AS x FROM x_t WHERE {_stream_sql(h, 'dim + 1')} >= {drop!r})""", f"""
h{e} AS MATERIALIZED (SELECT doc_id, i AS r, sum(x * w) AS h FROM xd{e} JOIN p{e - 1} ON blk = 'A' AND j = dim GROUP BY doc_id, i)""", f"""
z{e} AS ({logits(e - 1, 'rows_t', 'x_t', f'h{e}')})""", f"""
s{e} AS MATERIALIZED (
  SELECT doc_id, y, label, zc - ln(sum(exp(zc)) OVER (PARTITION BY doc_id)) AS logp
  FROM (SELECT doc_id, y, label, z - max(z) OVER (PARTITION BY doc_id) AS zc FROM z{e}) t)""", f"""
l{e} AS (SELECT {e} AS epoch, -sum(logp) / any_value(n) AS loss FROM s{e}, rows_n WHERE label = y)""", f"""
dz{e} AS MATERIALIZED (SELECT doc_id, label, (exp(logp) - CASE WHEN label = y THEN 1 ELSE 0 END) / n AS dz FROM s{e}, rows_n)""", f"""
q{e} AS MATERIALIZED (SELECT label, r, sum(dz * h) AS q FROM dz{e} JOIN h{e} USING (doc_id) GROUP BY label, r)""", f"""
g{e} AS MATERIALIZED (
  SELECT blk, i, j, sum(g) AS g FROM (
    SELECT 'W' AS blk, label AS i, dim AS j, sum(dz * x) AS g FROM dz{e} JOIN x_t USING (doc_id) GROUP BY label, dim
    UNION ALL SELECT 'W', label, {d}, sum(dz) FROM dz{e} GROUP BY label
    UNION ALL SELECT 'W', q.label, b.i, {s} * sum(q.q * b.w) FROM q{e} q JOIN p{e - 1} b ON b.blk = 'B' AND b.j = q.r GROUP BY q.label, b.i
    UNION ALL SELECT 'B', w.j, q.r, {s} * sum(w.w * q.q) FROM q{e} q JOIN p{e - 1} w ON w.blk = 'W' AND w.i = q.label AND w.j < {d} GROUP BY w.j, q.r
    UNION ALL SELECT 'A', wb.r, c.dim, {s} * sum(wb.wb * c.p) FROM wb{e - 1} wb JOIN (
      SELECT label, dim, sum(dz * x) AS p FROM dz{e} JOIN xd{e} USING (doc_id) GROUP BY label, dim) c USING (label) GROUP BY wb.r, c.dim) u
  GROUP BY blk, i, j)""", f"""
p{e} AS MATERIALIZED (
  SELECT blk, i, j, w * (1 - {lr!r} * {C.ADAMW_WEIGHT_DECAY!r}) - {lr!r} * (m / (1 - 0.9 ** {e})) / (sqrt(v / (1 - 0.999 ** {e})) + 1e-8) AS w, m, v
  FROM (SELECT blk, i, j, w, 0.9 * m + 0.1 * coalesce(g, 0) AS m, 0.999 * v + 0.001 * coalesce(g, 0) * coalesce(g, 0) AS v
        FROM p{e - 1} LEFT JOIN g{e} USING (blk, i, j)) u)"""]
    losses = " UNION ALL ".join(f"SELECT * FROM l{e}" for e in range(1, epochs + 1))
    return "WITH " + ",".join(parts) + "," + wb(epochs) + f""",
he AS MATERIALIZED (SELECT doc_id, i AS r, sum(x * w) AS h FROM x_e JOIN p{epochs} ON blk = 'A' AND j = dim GROUP BY doc_id, i),
pred AS (SELECT doc_id, y, label AS pred FROM ({logits(epochs, 'rows_e', 'x_e', 'he')}) z
         QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY z DESC, label) = 1),
cls AS (SELECT cls, sum(t) AS support, sum(p) AS predicted, sum(tp) AS tp FROM (
          SELECT y AS cls, 1 AS t, 0 AS p, CASE WHEN y = pred THEN 1 ELSE 0 END AS tp FROM pred
          UNION ALL SELECT pred, 0, 1, 0 FROM pred) u GROUP BY cls),
f AS (SELECT *, 2.0 * tp / (support + predicted) AS f1 FROM cls WHERE cls IS NOT NULL),
mets AS (SELECT avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1, count(*) AS n_classes FROM f),
acc AS (SELECT count(*) AS n, avg(CASE WHEN y = pred THEN 1.0 ELSE 0.0 END) AS accuracy FROM pred)
SELECT CAST(epoch AS INTEGER) AS epoch, round(loss, 6) AS loss, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1,
       round(weighted_f1, 6) AS weighted_f1, n_classes, CAST({2 * r * d} AS INTEGER) AS trainable_params
FROM ({losses}) l, mets, acc"""


@register("fit_adapter", _adapter_sql(ADAPTER_EPOCHS))
def q_fit_adapter(spark, sf_dir):
    """Adapter + head, full-batch AdamW, three epochs; per-epoch loss with test metrics."""
    train, test, k = _features(spark, sf_dir)
    curve, preds, trainable = C.fit_adapter(train, test, k, HASH_DIM, epochs=ADAPTER_EPOCHS, seed=SEED, key="doc_id")
    mets = M.classification_metrics(preds)
    row = mets.first()
    loss = spark.createDataFrame(curve, "epoch int, loss double")
    value = lambda f: _r(F.lit(row[f.name])) if f.name in ("accuracy", "macro_f1", "weighted_f1") else F.lit(row[f.name])
    return loss.select("epoch", _r("loss").alias("loss"), *[value(f).cast(f.dataType).alias(f.name) for f in mets.schema.fields],
                       F.lit(trainable).alias("trainable_params"))


@register("param_counts", _RUNS + """
SELECT run_id, model_size,
       CAST(16 * native AS BIGINT) AS trainable_params,
       CAST(params + 16 * native AS BIGINT) AS total_params,
       round(100.0 * (16 * native) / (params + 16 * native), 6) AS trainable_pct,
       CAST(num_classes * (native + 1) AS BIGINT) AS head_params
FROM (SELECT run_id, model_size, num_classes,
             CASE model_size WHEN '0.6b' THEN 1024 WHEN '4b' THEN 2560 WHEN '8b' THEN 4096 END AS native,
             CASE model_size WHEN '0.6b' THEN 600000000 WHEN '4b' THEN 4000000000 WHEN '8b' THEN 8000000000 END
               AS params
      FROM cls_runs WHERE mode = 'lora') t""")
def q_param_counts(spark, sf_dir):
    runs = RU.classification_runs(spark, sf_dir).where(F.col("mode") == "lora")
    native = F.element_at(G.literal_map(RU.NATIVE_HIDDEN), F.col("model_size"))
    params = F.element_at(G.literal_map({k: int(v) for k, v in RU.MODEL_PARAMS.items()}), F.col("model_size"))
    df = C.param_counts(runs, native, params, F.col("num_classes"))
    return df.withColumn("trainable_pct", _r("trainable_pct"))


@register("mode_defaults", _RUNS + """
SELECT run_id, mode,
       CAST(coalesce(epochs, CASE WHEN mode = 'frozen' THEN 10 ELSE 3 END) AS INTEGER) AS epochs,
       CAST(coalesce(batch_size, CASE WHEN mode = 'frozen' THEN 32 ELSE 8 END) AS INTEGER) AS batch_size,
       round(coalesce(lr, CASE WHEN mode = 'frozen' THEN 0.001 ELSE 0.0002 END), 6) AS lr
FROM cls_runs""")
def q_mode_defaults(spark, sf_dir):
    df = C.mode_defaults(RU.classification_runs(spark, sf_dir))
    return df.withColumn("lr", _r("lr"))


# ---------------------------------------------------------- M: metrics

# The stop-word rule used as a language "prediction".
_GUESS_SQL = """CASE WHEN contains(text, ' the ') THEN 'en'
            WHEN contains(text, ' und ') OR contains(text, ' die ') THEN 'de'
            WHEN contains(text, ' el ') OR contains(text, ' los ') THEN 'es'
            WHEN contains(text, ' le ') OR contains(text, ' la ') THEN 'fr'
            ELSE 'en' END"""


def _lang_guess(text):
    t = F.col(text)
    return (F.when(t.contains(" the "), "en")
             .when(t.contains(" und ") | t.contains(" die "), "de")
             .when(t.contains(" el ") | t.contains(" los "), "es")
             .when(t.contains(" le ") | t.contains(" la "), "fr")
             .otherwise("en"))


def _pairs(spark, sf_dir):
    """(doc_id, truth, pred): the prediction is made on the row that holds the
    truth, so pairing needs no join (``M.align`` is for predictions stored
    apart from their truth)."""
    docs = _documents(spark, sf_dir)
    return docs.select("doc_id", F.col("lang").alias("truth"), _lang_guess("text").alias("pred"))


_PAIRS_SQL = f"""
WITH j AS (SELECT t.doc_id, t.lang AS truth, p.pred FROM documents t
           JOIN (SELECT doc_id, {_GUESS_SQL} AS pred FROM documents) p ON t.doc_id = p.doc_id),
e AS (SELECT truth AS cls, 1 AS t, 0 AS p, CASE WHEN truth = pred THEN 1 ELSE 0 END AS tp FROM j
      UNION ALL SELECT pred AS cls, 0 AS t, 1 AS p, 0 AS tp FROM j),
c AS (SELECT cls, CAST(sum(t) AS BIGINT) AS support, CAST(sum(p) AS BIGINT) AS predicted,
             CAST(sum(tp) AS BIGINT) AS true_pos FROM e WHERE cls IS NOT NULL GROUP BY cls),
f AS (SELECT *, coalesce(2.0::DOUBLE * true_pos / nullif(support + predicted, 0), 0.0) AS f1 FROM c)"""


@register("accuracy", _PAIRS_SQL + """
SELECT count(*) AS n, round(avg(CASE WHEN truth = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM j""")
def q_accuracy(spark, sf_dir):
    df = M.accuracy(_pairs(spark, sf_dir))
    return df.select("n", _r("accuracy").alias("accuracy"))


@register("macro_f1", _PAIRS_SQL + """
SELECT round(avg(f1), 6) AS macro_f1, count(*) AS n_classes FROM f""")
def q_macro_f1(spark, sf_dir):
    df = M.f1_scores(_pairs(spark, sf_dir))
    return df.select(_r("macro_f1").alias("macro_f1"), "n_classes")


@register("weighted_f1", _PAIRS_SQL + """
SELECT round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM f""")
def q_weighted_f1(spark, sf_dir):
    df = M.f1_scores(_pairs(spark, sf_dir))
    return df.select(_r("weighted_f1").alias("weighted_f1"))


@register("class_report", _PAIRS_SQL + """
SELECT cls, support, predicted, true_pos, round(f1, 6) AS f1 FROM f""")
def q_class_report(spark, sf_dir):
    df = M.class_report(_pairs(spark, sf_dir))
    return df.withColumn("f1", _r("f1"))


@register("throughput", _RUNS + """
SELECT 'embedding' AS kind, run_id,
       round(CASE WHEN embed_generation_time_sec <> 0 THEN actual_num_samples / embed_generation_time_sec END, 6)
         AS throughput
FROM emb_runs
UNION ALL
SELECT 'classification' AS kind, run_id,
       round(CASE WHEN embed_extraction_time_sec <> 0
                  THEN (actual_train_samples + actual_test_samples) / embed_extraction_time_sec END, 6) AS throughput
FROM cls_runs""")
def q_throughput(spark, sf_dir):
    e = RU.embedding_runs(spark, sf_dir).select(
        F.lit("embedding").alias("kind"), "run_id",
        _r(M.throughput("actual_num_samples", "embed_generation_time_sec")).alias("throughput"))
    c = RU.classification_runs(spark, sf_dir).select(
        F.lit("classification").alias("kind"), "run_id",
        _r(M.throughput(F.col("actual_train_samples") + F.col("actual_test_samples"),
                        "embed_extraction_time_sec")).alias("throughput"))
    return e.unionByName(c)


@register("total_time", _RUNS + """
SELECT run_id, mode, round(CASE WHEN mode = 'frozen' THEN embed_extraction_time_sec + train_time_sec
                                ELSE train_time_sec END, 6) AS total_time_sec
FROM cls_runs""")
def q_total_time(spark, sf_dir):
    runs = RU.classification_runs(spark, sf_dir)
    return runs.select("run_id", "mode", _r(M.total_time()).alias("total_time_sec"))


def _telemetry(spark, sf_dir):
    return E.encode_telemetry(_documents(spark, sf_dir), E.HashedEncoder(HASH_DIM), "text", "doc_id",
                              BATCH_SIZE, None, True, num_partitions=_parts(spark))


@register("batch_telemetry", """
SELECT count(*) AS done, true AS timed, true AS batches_full FROM documents""")
def q_batch_telemetry(spark, sf_dir):
    """M8: progress every 10th mini-batch and the last, per task; what is sure of the lines, clocks apart.

    ``batches_full``: no line's running count is short of full batches but a task's last.
    """
    lines = M.batch_telemetry(_telemetry(spark, sf_dir))
    per_task = lines.groupBy("task_id").agg(
        F.max("done").alias("done"), F.min(F.col("samples_per_sec") > 0).alias("timed"),
        F.min((F.col("done") == (F.col("batch_no") + 1) * BATCH_SIZE)
              | (F.col("batch_no") == F.col("last_batch"))).alias("full"))
    return per_task.agg(F.sum("done").alias("done"), F.min("timed").alias("timed"),
                        F.min("full").alias("batches_full"))


def _replayed(spark, sf_dir):
    """A telemetry table derived from ``events``: 16 tasks, many batches, clocks that tie."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select((F.col("user_id") % 16).cast("int").alias("task_id"), F.col("event_id").alias("batch_no"),
                     (1 + F.col("event_id") % 32).alias("rows"),
                     (F.round(F.col("value") * 1000) + 1).cast("long").alias("elapsed_ns"),
                     (F.col("user_id") * 1_000_000).alias("rss_growth"),
                     (F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 60_000_000) * 60_000_000).alias("ended_at"))


_REPLAY_SQL = """WITH tel AS (
  SELECT CAST(user_id % 16 AS INTEGER) AS task_id, event_id AS batch_no, 1 + event_id % 32 AS "rows",
         CAST(round(value * 1000) + 1 AS BIGINT) AS elapsed_ns, user_id * 1000000 AS rss_growth,
         epoch_us(ts) // 60000000 * 60000000 AS ended_at FROM events)"""


@register("telemetry_lines", _REPLAY_SQL + """
SELECT task_id, batch_no, CAST(done AS BIGINT) AS done, CAST(spent AS BIGINT) AS elapsed_ns, last_batch,
       round(done * 1e9 / spent, 6) AS samples_per_sec
FROM (SELECT task_id, batch_no, sum("rows") OVER w AS done, sum(elapsed_ns) OVER w AS spent,
             max(batch_no) OVER (PARTITION BY task_id) AS last_batch
      FROM tel WINDOW w AS (PARTITION BY task_id ORDER BY batch_no)) t
WHERE batch_no % 10 = 0 OR batch_no = last_batch""")
def q_telemetry_lines(spark, sf_dir):
    """M8 per task over a replayed telemetry table: every figure of every line."""
    return M.batch_telemetry(_replayed(spark, sf_dir)).withColumn("samples_per_sec", _r("samples_per_sec"))


@register("run_progress", _REPLAY_SQL + """,
r AS (SELECT ended_at, "rows", CAST(sum("rows") OVER w AS BIGINT) AS done, CAST(sum("rows") OVER () AS BIGINT) AS total,
             min(ended_at) OVER () AS started FROM tel WINDOW w AS (ORDER BY ended_at, task_id, batch_no)),
c AS (SELECT *, unnest(range((done - "rows") * 10 // total + 1, done * 10 // total + 1)) AS k FROM r)
SELECT k * 100 / 10.0 AS percent, done, total, ended_at, (ended_at - started) / 1e6 AS elapsed_sec,
       CASE WHEN ended_at > started THEN round(done / ((ended_at - started) / 1e6), 6) END AS samples_per_sec
FROM c""")
def q_run_progress(spark, sf_dir):
    """M8 for the whole run: the moments at which each tenth of its rows was done, all tasks merged by their clocks."""
    return M.run_progress(_replayed(spark, sf_dir)).withColumn("samples_per_sec", _r("samples_per_sec"))


@register("telemetry_totals", _REPLAY_SQL + """,
t AS (SELECT task_id, sum("rows") AS n, sum(elapsed_ns) AS ns, max(rss_growth) AS grown FROM tel GROUP BY task_id)
SELECT count(*) AS tasks, CAST(sum(n) AS BIGINT) AS "rows", round(sum(ns) / 1e9, 6) AS busy_sec,
       round(max(ns) / 1e9, 6) AS slowest_task_sec, round(max(grown) / 1e9, 6) AS peak_rss_growth_gb FROM t""")
def q_telemetry_totals(spark, sf_dir):
    """M9 over the replayed telemetry table: every figure."""
    out = M.task_resources(_replayed(spark, sf_dir))
    return out.select("tasks", "rows", *[_r(c).alias(c) for c in ("busy_sec", "slowest_task_sec", "peak_rss_growth_gb")])


@register("task_resources", """
SELECT count(*) AS rows, true AS timed, true AS measured FROM documents""")
def q_task_resources(spark, sf_dir):
    """M9: wall time and memory growth of the encoder's tasks, totalled; what is sure of them, clocks apart."""
    r = M.task_resources(_telemetry(spark, sf_dir))
    return r.select("rows", ((F.col("busy_sec") >= F.col("slowest_task_sec")) & (F.col("busy_sec") > 0)).alias("timed"),
                    (F.col("peak_rss_growth_gb") >= 0).alias("measured"))


@register("inspect_texts", _UNIT_SQL + f"""
SELECT doc_id, CAST(len(vector) AS INTEGER) AS width, list_min(vector) AS min_value, list_max(vector) AS max_value,
       vector[1:{PREVIEW_N}] AS head, vector[{HASH_DIM - PREVIEW_N + 1}:{HASH_DIM}] AS tail,
       'hashed-64_dim{HASH_DIM}_cuda' AS file_name
FROM unit""")
def q_inspect_texts(spark, sf_dir):
    """Every document encoded on its own, summarised and previewed."""
    from vectorloom.plans.inspection import inspect_texts
    r = inspect_texts(_documents(spark, sf_dir), E.HashedEncoder(HASH_DIM), n=PREVIEW_N)
    return r.select("doc_id", "width", _r("min_value").alias("min_value"), _r("max_value").alias("max_value"),
                    V.to_double_rounded("head").alias("head"), V.to_double_rounded("tail").alias("tail"), "file_name")


def _sheet_sql(value: str) -> str:
    return f"""
SELECT '{value}' AS sheet, CAST(NULL AS BIGINT) AS position, CAST(NULL AS VARCHAR) AS run_id, model_size, backend, device,
       requested_dimension AS dimension, round(avg({value}), 6) AS value
FROM emb_runs
WHERE status = 'success' AND model_size IS NOT NULL AND backend IS NOT NULL AND device IS NOT NULL
  AND requested_dimension IN ('768', '1024', 'default')
GROUP BY model_size, backend, device, requested_dimension HAVING avg({value}) IS NOT NULL"""


@register("write_report", _RUNS + f"""
SELECT 'raw_results' AS sheet,
       CAST(row_number() OVER (ORDER BY model_size ASC NULLS LAST, backend ASC NULLS LAST, device ASC NULLS LAST,
                                        dim_rank ASC NULLS LAST, requested_dimension ASC NULLS LAST, run_id)
            - 1 AS BIGINT) AS position, run_id, model_size, backend, device, requested_dimension AS dimension,
       round(throughput_samples_per_sec, 6) AS value
FROM (SELECT *, CAST(CASE requested_dimension WHEN '768' THEN 0 WHEN '1024' THEN 1 WHEN 'default' THEN 2 END
                     AS INTEGER) AS dim_rank FROM emb_runs) t
UNION ALL {_sheet_sql('throughput_samples_per_sec')} UNION ALL {_sheet_sql('peak_mem_gb')}""")
def q_write_report(spark, sf_dir):
    """The three sheets written as tables and read back, cell by cell."""
    paths = R.write_report(RU.embedding_runs(spark, sf_dir), scratch_path(spark, "report"))
    out = spark.read.parquet(paths["raw_results"]).select(
        F.lit("raw_results").alias("sheet"), "position", "run_id", "model_size", "backend", "device",
        F.col("requested_dimension").alias("dimension"), _r("throughput_samples_per_sec").alias("value"))
    for sheet in ("throughput_samples_per_sec", "peak_mem_gb"):
        wide = spark.read.parquet(paths[sheet])
        cells = wide.unpivot(["model_size", "backend", "device"], R.DIMENSION_ORDER, "dimension", "value").where("value IS NOT NULL")
        out = out.unionByName(cells.withColumn("value", _r("value")).withColumn("sheet", F.lit(sheet)), allowMissingColumns=True)
    return out


# ---------------------------------------------------------- R: grid & reports

def _grid_values_sql() -> str:
    rows, i = [], 0
    total = len(G.GRID_MODELS) * len(G.GRID_DEVICES) * len(G.GRID_DIMENSIONS)
    for m in G.GRID_MODELS:
        for d in G.GRID_DEVICES:
            for k in G.GRID_DIMENSIONS:
                i += 1
                rows.append(f"({i}, {total}, '{m}', '{d}', '{k}', {RU.GRID_BATCH_SIZES[m]})")
    return ("SELECT * FROM (VALUES " + ", ".join(rows) +
            ") g(ordinal, total, model_size, device, dimension, batch_size)")


@register("run_grid", _RUNS + f""",
grid AS ({_grid_values_sql()}),
obs AS (SELECT model_size, device, requested_dimension AS dimension, count(*) AS n_runs,
               CAST(sum(CASE WHEN status = 'success' THEN 1 ELSE 0 END) AS BIGINT) AS n_success
        FROM emb_runs WHERE backend = 'torch' GROUP BY ALL)
SELECT CAST(g.ordinal AS INTEGER) AS ordinal, CAST(g.total AS INTEGER) AS total, g.model_size, g.device, g.dimension,
       CAST(g.batch_size AS INTEGER) AS batch_size,
       CAST(coalesce(o.n_runs, 0) AS BIGINT) AS n_runs, CAST(coalesce(o.n_success, 0) AS BIGINT) AS n_success
FROM grid g LEFT JOIN obs o ON g.model_size = o.model_size AND g.device = o.device AND g.dimension = o.dimension""")
def q_run_grid(spark, sf_dir):
    return G.grid_coverage(G.run_grid(spark), RU.embedding_runs(spark, sf_dir))


@register("precision_plan", _RUNS + """
SELECT model_size, backend, device, count(*) AS n_runs,
       CASE WHEN backend = 'mlx' THEN 'mxfp8'
            WHEN device = 'cuda' AND model_size IN ('4b', '8b') THEN 'nf4'
            WHEN device = 'cuda' THEN 'fp16'
            WHEN device = 'cpu' AND model_size IN ('4b', '8b') THEN 'bf16'
            WHEN device = 'cpu' THEN 'fp32' END AS precision
FROM emb_runs GROUP BY model_size, backend, device""")
def q_precision_plan(spark, sf_dir):
    return G.precision_plan(RU.embedding_runs(spark, sf_dir))


@register("capacity_plan", _RUNS + """
SELECT model_size, mode, device, n_runs, round(req, 6) AS required_gb, avail AS available_gb,
       CASE WHEN model_size IN ('4b', '8b') AND mode = 'lora' AND device = 'cpu' THEN 'unsupported'
            WHEN avail IS NULL OR req IS NULL THEN 'unknown'
            WHEN avail < req THEN 'insufficient' ELSE 'ok' END AS verdict
FROM (SELECT model_size, mode, device, count(*) AS n_runs,
             CASE device WHEN 'cpu' THEN 16.0::DOUBLE WHEN 'cuda' THEN 8.0::DOUBLE END AS avail,
             CASE WHEN device = 'cuda' THEN p * (CASE WHEN model_size IN ('4b', '8b') THEN 0.6 ELSE 2.0 END) / 1e9 * 1.5
                  WHEN device = 'cpu' THEN p * (CASE WHEN model_size = '0.6b' THEN 4.0 ELSE 2.0 END) / 1e9 * 1.3 END
               AS req
      FROM (SELECT *, CASE model_size WHEN '0.6b' THEN 0.6e9 WHEN '4b' THEN 4e9 WHEN '8b' THEN 8e9 END::DOUBLE AS p
            FROM cls_runs) r
      GROUP BY model_size, mode, device, p) t""")
def q_capacity_plan(spark, sf_dir):
    df = G.capacity_plan(RU.classification_runs(spark, sf_dir))
    return df.withColumn("required_gb", _r("required_gb"))


@register("grid_validation", _RUNS + """
SELECT 'embedding' AS kind, run_id,
       CASE WHEN model_size NOT IN ('0.6b', '4b', '8b') OR model_size IS NULL THEN 'unknown model size'
            WHEN backend NOT IN ('torch', 'mlx') OR backend IS NULL THEN 'unknown backend'
            WHEN backend = 'torch' AND device IS NULL THEN 'device required for torch backend'
            WHEN backend = 'torch' AND device NOT IN ('cpu', 'cuda') THEN 'unknown device'
            WHEN requested_dimension <> 'default' AND TRY_CAST(requested_dimension AS INTEGER) IS NULL
              THEN 'dimension is not an integer'
            WHEN requested_dimension <> 'default' AND TRY_CAST(requested_dimension AS INTEGER) < 1
              THEN 'dimension must be >= 1' END AS reject_reason
FROM emb_runs
UNION ALL
SELECT 'classification' AS kind, run_id,
       CASE WHEN CAST(run_id AS BIGINT) % 5 = 0 AND mode <> 'frozen' THEN 'mlx supports frozen runs only'
            WHEN model_size NOT IN ('0.6b', '4b') OR model_size IS NULL
              THEN 'classification supports 0.6b and 4b only'
            WHEN mode NOT IN ('frozen', 'lora') OR mode IS NULL THEN 'unknown mode'
            WHEN device NOT IN ('cpu', 'cuda') OR device IS NULL THEN 'unknown device' END AS reject_reason
FROM cls_runs""")
def q_grid_validation(spark, sf_dir):
    """Why a record's configuration is refused; adapters on mlx included."""
    df = G.grid_validation(RU.embedding_runs(spark, sf_dir), RU.classification_runs(spark, sf_dir, with_backend=True))
    return df.select("kind", "run_id", "reject_reason")


@register("runs_union", _RUNS + """
SELECT * FROM emb_runs UNION ALL BY NAME SELECT * FROM cls_runs""")
def q_runs_union(spark, sf_dir):
    return R.runs_union(RU.embedding_runs(spark, sf_dir), RU.classification_runs(spark, sf_dir))


def _pivot_sql(value: str) -> str:
    cols = ", ".join(f"round(avg({value}) FILTER (WHERE requested_dimension = '{d}'), 6) AS \"{d}\""
                     for d in R.DIMENSION_ORDER)
    nonnull = " OR ".join(f"\"{d}\" IS NOT NULL" for d in R.DIMENSION_ORDER)
    return _RUNS + f"""
SELECT * FROM (
  SELECT model_size, backend, device, {cols}
  FROM emb_runs
  WHERE status = 'success' AND model_size IS NOT NULL AND backend IS NOT NULL AND device IS NOT NULL
  GROUP BY model_size, backend, device) p
WHERE {nonnull}"""


def _round_pivot(df: DataFrame) -> DataFrame:
    return df.select("model_size", "backend", "device", *[_r(d).alias(d) for d in R.DIMENSION_ORDER])


@register("throughput_pivot", _pivot_sql("throughput_samples_per_sec"))
def q_throughput_pivot(spark, sf_dir):
    return _round_pivot(R.throughput_pivot(RU.embedding_runs(spark, sf_dir)))


@register("memory_pivot", _pivot_sql("peak_mem_gb"))
def q_memory_pivot(spark, sf_dir):
    return _round_pivot(R.memory_pivot(RU.embedding_runs(spark, sf_dir)))


def _dec_text(expr: str, digits: int) -> str:
    return f"CAST(CAST(round(CAST({expr} AS DECIMAL(38, 10)), {digits}) AS DECIMAL(38, {digits})) AS VARCHAR)"


def _fmt_sql(c: str, is_float: bool) -> str:
    if is_float:
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE {_dec_text(c + '::DOUBLE', 3)} END"
    return f"coalesce(CAST({c} AS VARCHAR), '-')"


_FLOAT_COLS = {"embed_generation_time_sec", "throughput_samples_per_sec", "peak_mem_gb", "mean_l2_norm",
               "embed_extraction_time_sec", "embed_extraction_samples_per_sec", "train_time_sec",
               "total_time_sec", "train_peak_mem_gb", "accuracy", "macro_f1"}


def _report_sql(view: str, columns, keys) -> str:
    order = ", ".join(f"coalesce({k}, '')" for k in keys) + ", run_id"
    sel = ", ".join(f"{_fmt_sql(k, k in _FLOAT_COLS)} AS \"{label}\"" for k, label in columns)
    return _RUNS + f"""
SELECT CAST(row_number() OVER (ORDER BY {order}) - 1 AS BIGINT) AS position, {sel} FROM {view}"""


@register("report_embedding", _report_sql("emb_runs", R.EMBEDDING_COLUMNS,
                                          ("model_size", "backend", "device", "requested_dimension")))
def q_report_embedding(spark, sf_dir):
    return R.report_embedding(RU.embedding_runs(spark, sf_dir))


@register("report_classification", _report_sql("cls_runs", R.CLASSIFICATION_COLUMNS,
                                               ("model_size", "mode", "device")))
def q_report_classification(spark, sf_dir):
    return R.report_classification(RU.classification_runs(spark, sf_dir))


_CELLS_SQL = """,
cells AS (SELECT model_size, backend, device, requested_dimension, avg(throughput_samples_per_sec) AS throughput
          FROM emb_runs WHERE status = 'success' AND backend IS NOT NULL
          GROUP BY model_size, backend, device, requested_dimension)"""


@register("gpu_speedup", _RUNS + _CELLS_SQL + """
SELECT g.model_size, g.backend, g.requested_dimension, round(g.throughput, 6) AS gpu_throughput,
       round(c.throughput, 6) AS cpu_throughput, round(g.throughput / nullif(c.throughput, 0), 6) AS speedup,
       CASE WHEN g.throughput / nullif(c.throughput, 0) IS NULL THEN 'n/a'
            ELSE """ + _dec_text("g.throughput / nullif(c.throughput, 0)", 2) + """ || 'x' END AS speedup_label
FROM (SELECT * FROM cells WHERE device = 'cuda') g
LEFT JOIN (SELECT * FROM cells WHERE device = 'cpu') c
  ON g.model_size = c.model_size AND g.backend = c.backend AND g.requested_dimension = c.requested_dimension""")
def q_gpu_speedup(spark, sf_dir):
    df = R.gpu_speedup(RU.embedding_runs(spark, sf_dir))
    return df.select("model_size", "backend", "requested_dimension", _r("gpu_throughput").alias("gpu_throughput"),
                     _r("cpu_throughput").alias("cpu_throughput"), _r("speedup").alias("speedup"), "speedup_label")


@register("size_step_ratio", _RUNS + _CELLS_SQL + """
SELECT model_size, backend, device, round(throughput, 6) AS throughput,
       lag(model_size) OVER w AS smaller_model,
       round(lag(throughput) OVER w / nullif(throughput, 0), 6) AS step_ratio
FROM (SELECT *, CASE model_size WHEN '0.6b' THEN 0.6e9 WHEN '4b' THEN 4e9 WHEN '8b' THEN 8e9 END AS params
      FROM cells WHERE requested_dimension = 'default') t
WINDOW w AS (PARTITION BY backend, device ORDER BY params)""")
def q_size_step_ratio(spark, sf_dir):
    df = R.size_step_ratio(RU.embedding_runs(spark, sf_dir))
    return df.select("model_size", "backend", "device", _r("throughput").alias("throughput"), "smaller_model",
                     _r("step_ratio").alias("step_ratio"))


@register("run_ids", _RUNS + """
SELECT 'embedding' AS kind, run_id,
       strftime(started_at, '%Y%m%d_%H%M%S') || '_' || model_size || '_embed_d' ||
       CASE WHEN requested_dimension = 'default' THEN requested_dimension
            ELSE CAST(TRY_CAST(requested_dimension AS INTEGER) AS VARCHAR) END || '_' ||
       CASE WHEN backend = 'mlx' THEN 'mlx' ELSE device END AS run_name
FROM emb_runs
UNION ALL
SELECT 'classification' AS kind, run_id,
       strftime(started_at, '%Y%m%d_%H%M%S') || '_' || model_size || '_' || mode || '_' || device AS run_name
FROM cls_runs""")
def q_run_ids(spark, sf_dir):
    return G.run_ids(RU.embedding_runs(spark, sf_dir), RU.classification_runs(spark, sf_dir))


@register("status_counts", _RUNS + """
SELECT 'embedding' AS kind, status, count(*) AS n_runs FROM emb_runs GROUP BY status
UNION ALL
SELECT 'classification' AS kind, status, count(*) AS n_runs FROM cls_runs GROUP BY status""")
def q_status_counts(spark, sf_dir):
    e = RU.embedding_runs(spark, sf_dir).withColumn("kind", F.lit("embedding"))
    c = RU.classification_runs(spark, sf_dir).withColumn("kind", F.lit("classification"))
    return R.status_counts(e.select("kind", "status").unionByName(c.select("kind", "status")), ("kind", "status"))


@register("device_label", _RUNS + """
SELECT run_id, backend, device, CASE WHEN backend = 'mlx' THEN 'mlx' ELSE device END AS device_label
FROM emb_runs""")
def q_device_label(spark, sf_dir):
    runs = RU.embedding_runs(spark, sf_dir)
    return runs.select("run_id", "backend", "device",
                       G.device_label(F.col("backend"), F.col("device")).alias("device_label"))


_NEED_SQL = f"""CASE WHEN device = 'cuda'
         THEN p * (CASE WHEN model_size IN ('4b', '8b') THEN {G.CUDA_BYTES_QUANTIZED} ELSE {G.CUDA_BYTES} END)
              / 1e9 * {G.CUDA_MARGIN}
         ELSE p * (CASE WHEN model_size = '0.6b' THEN {G.CPU_BYTES_SMALL} ELSE {G.CPU_BYTES} END)
              / 1e9 * {G.CPU_MARGIN} END"""


@register("failure_capture", _RUNS + f""",
pre AS (
  SELECT *, CASE model_size WHEN '0.6b' THEN 0.6e9 WHEN '4b' THEN 4e9 WHEN '8b' THEN 8e9 END::DOUBLE AS p,
         CASE device WHEN 'cpu' THEN 16.0 WHEN 'cuda' THEN 8.0 END::DOUBLE AS have,
         TRY_CAST(requested_dimension AS INTEGER) AS dim
  FROM emb_runs
), chk AS (
  SELECT run_id, status AS own_status, error AS own_error,
         CASE WHEN coalesce(model_size, '') NOT IN ('0.6b', '4b', '8b') THEN 'unknown model size'
              WHEN coalesce(backend, '') NOT IN ('torch', 'mlx') THEN 'unknown backend'
              WHEN backend = 'torch' AND device IS NULL THEN 'device required for torch backend'
              WHEN backend = 'torch' AND device NOT IN ('cpu', 'cuda') THEN 'unknown device'
              WHEN requested_dimension <> 'default' AND dim IS NULL THEN 'dimension is not an integer'
              WHEN requested_dimension <> 'default' AND dim < 1 THEN 'dimension must be >= 1'
              WHEN backend = 'mlx' THEN NULL
              WHEN have < {_NEED_SQL} THEN 'capacity: insufficient' END AS error
  FROM pre
)
SELECT run_id, CASE WHEN error IS NULL AND own_status <> 'failed' THEN 'success' ELSE 'failed' END AS status,
       CASE WHEN error IS NOT NULL THEN error WHEN own_status = 'failed' THEN own_error END AS error
FROM chk""")
def q_failure_capture(spark, sf_dir):
    """Status and error from the validation and capacity columns, then from the run itself."""
    return G.failure_capture(RU.embedding_runs(spark, sf_dir))


REFUSE_ABOVE = 1000


@register("failure_isolation", "WITH " + _HASHED_SQL + f""",
n AS (SELECT doc_id, len({_TOKS}) AS n FROM documents)
SELECT doc_id, CASE WHEN n > {REFUSE_ABOVE} THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN n > {REFUSE_ABOVE} THEN 'ValueError: ' || n || ' tokens exceed {REFUSE_ABOVE}' END AS error,
       CASE WHEN n <= {REFUSE_ABOVE} THEN {_round_list_sql('embedding')} END AS embedding
FROM hashed JOIN n USING (doc_id)""")
def q_failure_isolation(spark, sf_dir):
    """An encoder that fails on any batch with an overlong text; those texts fail alone, the rest get their vectors."""
    out = E.encode(_documents(spark, sf_dir), E.HashedEncoder(HASH_DIM, REFUSE_ABOVE, refuse=True), "text", "doc_id", BATCH_SIZE,
                   num_partitions=_parts(spark), isolate=True)
    return out.select("doc_id", "status", "error", V.to_double_rounded("embedding").alias("embedding"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
