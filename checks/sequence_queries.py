"""Sliding-sequence queries (group E)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import sequences as Q
from checks.audit_view import AUDIT_SQL, audit_events

LENGTH, STRIDE, MIN_BAD, VOCAB = 20, 5, 5, 6
LABELS = ["benign", "malicious"]


def events(spark, sf_dir):
    prepared = Q.prepare_sequence_events(audit_events(spark, sf_dir), LABELS)
    return prepared.withColumn("segment", F.col("attack_run_id"))


def text_of(column):
    return F.array_join(F.transform(column, lambda s: F.array_join(s.cast("array<string>"), ",")), ";")


CATEGORY_SQL = """CASE
  WHEN txt LIKE '%/root/.ssh%' THEN 'root_ssh' WHEN txt LIKE '%.ssh%' OR txt LIKE '%authorized_keys%' THEN 'ssh'
  WHEN txt LIKE '%/etc/sudoers%' THEN 'sudoers'
  WHEN txt LIKE '%/etc/passwd%' OR txt LIKE '%/etc/shadow%' OR txt LIKE '%/etc/group%' THEN 'identity'
  WHEN txt LIKE '%/etc/systemd%' OR txt LIKE '%/lib/systemd%' THEN 'systemd'
  WHEN txt LIKE '%/etc/cron%' OR txt LIKE '%/var/spool/cron%' THEN 'cron'
  WHEN txt LIKE '%/etc%' THEN 'etc' WHEN txt LIKE '%/dev/shm%' THEN 'dev_shm' WHEN txt LIKE '%/tmp%' THEN 'tmp'
  WHEN txt LIKE '%/home%' THEN 'home' WHEN txt LIKE '%/var/log%' THEN 'var_log' WHEN txt LIKE '%/proc%' THEN 'proc'
  WHEN saddr <> '' OR lower(key) LIKE '%network%' THEN 'network' ELSE 'none' END"""

EVENTS_SQL = f"""{AUDIT_SQL},
chosen AS (
  SELECT *, {CATEGORY_SQL} AS path_category
  FROM (SELECT *, lower(paths || '|' || path || '|' || cwd) AS txt FROM audit_paths)
  WHERE manual_label IN ('benign', 'malicious')
),
ordered AS (
  SELECT *, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY attack_run_id) AS seg_n,
    least(greatest((ts_us - coalesce(lag(ts_us) OVER w, ts_us)) / 1000000.0, 0), 60) AS gap
  FROM chosen WINDOW w AS (PARTITION BY attack_run_id ORDER BY ts_us, event_no)
)"""

NUMERIC_SQL = [
    "ln(1 + gap)", "ln(1 + record_count)", "ln(1 + path_count)",
    "ln(1 + CASE WHEN argc = '' THEN 0 ELSE CAST(argc AS INT) END)",
    "(success = 'yes')::INT", "(success = 'no')::INT", "(command <> '')::INT", "(saddr <> '')::INT",
    "(uid = '0')::INT", "(euid = '0')::INT", "(auid = '4294967295')::INT", "(uid <> euid)::INT",
]

VOCAB_SQL = f"""tokens AS (
  SELECT unnest([{", ".join(f"'{c}'" for c in S.TOKEN_COLUMNS)}]) AS "column",
         unnest([{", ".join(S.TOKEN_COLUMNS)}]) AS token FROM chosen
),
vocab AS (
  SELECT "column", token, CAST(r + 1 AS INTEGER) AS id FROM (
    SELECT "column", token, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, token) AS r
    FROM tokens WHERE token <> '' GROUP BY "column", token)
  WHERE r <= {VOCAB - 2}
)"""

ENCODED_SQL = f"""{EVENTS_SQL}, {VOCAB_SQL},
encoded AS (
  SELECT o.*, {" || ',' || ".join(f"coalesce(v_{c}.id, 1)" for c in S.TOKEN_COLUMNS)} AS ids,
    {" || ".join(f"CAST({x} AS VARCHAR)" for x in NUMERIC_SQL[4:])} AS flags
  FROM ordered o {" ".join(f'LEFT JOIN vocab v_{c} ON v_{c}.column = {chr(39)}{c}{chr(39)} AND v_{c}.token = o.{c}' for c in S.TOKEN_COLUMNS)}
)"""

SEQUENCES_SQL = f"""{ENCODED_SQL},
placed AS (
  SELECT *, unnest(range(CAST(greatest(0, ceil((pos - {LENGTH} + 1) / {STRIDE}.0)) AS BIGINT), pos // {STRIDE} + 1)) AS k FROM encoded
),
sequences AS (
  SELECT attack_run_id, k, min(ts_us) AS start_us, max(ts_us) AS end_us,
    arg_min(event_id, pos) AS start_event_id, arg_max(event_id, pos) AS end_event_id,
    count(*) AS event_count, count(*) FILTER (manual_label = 'benign') AS benign_event_count,
    count(*) FILTER (manual_label = 'malicious') AS malicious_event_count,
    string_agg(ids, ';' ORDER BY pos) AS x_cat, string_agg(flags, ';' ORDER BY pos) AS flags
  FROM placed WHERE k * {STRIDE} + {LENGTH} <= seg_n GROUP BY attack_run_id, k
),
segments AS (
  SELECT attack_run_id, min(ts_us) AS seen, greatest(0, (count(*) - {LENGTH}) // {STRIDE} + 1) * (count(*) >= {LENGTH})::INT AS n
  FROM chosen GROUP BY attack_run_id
),
numbered AS (
  SELECT s.*, k + CAST(coalesce(f.first_id, 0) AS BIGINT) AS sequence_id,
    CASE WHEN malicious_event_count >= {MIN_BAD} THEN 'malicious' ELSE 'benign' END AS sequence_label,
    CASE WHEN malicious_event_count >= {MIN_BAD} THEN 1 ELSE 0 END AS y
  FROM sequences s JOIN (
    SELECT attack_run_id, sum(n) OVER (ORDER BY seen ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS first_id
    FROM segments) f USING (attack_run_id)
)"""


def path_categories(spark, sf_dir):
    return events(spark, sf_dir).select("event_id", "path_category", "exe_basename", "manual_label")


def numeric(spark, sf_dir):
    ordered = Q.with_numeric_features(Q.order_events(events(spark, sf_dir), ["segment"]))
    named = [F.round(F.col("numeric")[i].cast("double"), 4).alias(c) for i, c in enumerate(S.NUMERIC_COLUMNS)]
    return ordered.df.select("event_id", F.col("_pos").alias("pos"), *named)


def vocabulary(spark, sf_dir):
    return Q.learn_vocab(events(spark, sf_dir), VOCAB)


def encoded(spark, sf_dir):
    rows = events(spark, sf_dir)
    found = Q.encode(rows, Q.learn_vocab(rows, VOCAB))
    return found.select("event_id", F.array_join(F.col("tokens").cast("array<string>"), ",").alias("ids"))


def build(spark, sf_dir, **limits):
    return Q.build_sequences(audit_events(spark, sf_dir), length=LENGTH, stride=STRIDE,
                             min_malicious=MIN_BAD, vocab_size=VOCAB, **limits)[0]


def manifest(spark, sf_dir):
    found = build(spark, sf_dir)
    return found.select(
        "sequence_id", "segment_id", "start_us", "end_us", "start_event_id", "end_event_id",
        *[F.col(c).cast("bigint").alias(c) for c in (
            "event_count", "benign_event_count", "malicious_event_count", "y")], "sequence_label")


def tensors(spark, sf_dir):
    found = build(spark, sf_dir)
    flags = F.transform("x_num", lambda s: F.array_join(F.slice(s, 5, 8).cast("array<int>"), ""))
    return found.select("sequence_id", text_of("x_cat").alias("x_cat"), F.array_join(flags, ";").alias("flags"))


def inference(spark, sf_dir):
    rows = audit_events(spark, sf_dir)
    vocab = Q.learn_vocab(Q.prepare_sequence_events(rows), VOCAB)
    found = Q.inference_sequences(rows, vocab, LENGTH, STRIDE)
    return found.select("source", "sequence_id", "start_us", "end_us", "start_event_id", "end_event_id",
                        F.col("event_count").cast("bigint").alias("event_count"))


INFERENCE_PARTS = f"""lined AS (SELECT source, ts_us, event_id, row_number() OVER (PARTITION BY source ORDER BY ts_us, event_no) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM audit),
spread AS (SELECT *, unnest(range(CAST(greatest(0, ceil((pos - {LENGTH} + 1) / {STRIDE}.0)) AS BIGINT), pos // {STRIDE} + 1)) AS sequence_id FROM lined),
seqs AS (SELECT source, sequence_id, min(ts_us) AS start_us, max(ts_us) AS end_us, arg_min(event_id, pos) AS start_event_id,
  arg_max(event_id, pos) AS end_event_id, count(*) AS event_count
FROM spread WHERE sequence_id * {STRIDE} + {LENGTH} <= n GROUP BY source, sequence_id)"""
INFERENCE_SQL = f"{AUDIT_SQL},\n{INFERENCE_PARTS}"


QUERIES = {
    "sequence_path_categories": path_categories,
    "sequence_numeric_features": numeric,
    "sequence_vocabulary": vocabulary,
    "sequence_encoding": encoded,
    "sequence_manifest": manifest,
    "sequence_arrays": tensors,
    "inference_sequences": inference,
}

ORACLES = {
    "sequence_path_categories": f"WITH {EVENTS_SQL} SELECT event_id, path_category, exe_basename, manual_label FROM chosen",
    "sequence_numeric_features": f"WITH {EVENTS_SQL} SELECT event_id, pos, " + ", ".join(
        f"round(CAST({sql} AS DOUBLE), 4) AS {name}" for sql, name in zip(NUMERIC_SQL, S.NUMERIC_COLUMNS, strict=True)
    ) + " FROM ordered",
    "sequence_vocabulary": f'WITH {EVENTS_SQL}, {VOCAB_SQL} SELECT "column", token, id FROM vocab',
    "sequence_encoding": f"WITH {ENCODED_SQL} SELECT event_id, ids FROM encoded",
    "sequence_manifest": f"""WITH {SEQUENCES_SQL} SELECT sequence_id, attack_run_id AS segment_id, start_us, end_us,
        start_event_id, end_event_id, event_count, benign_event_count, malicious_event_count,
        CAST(y AS BIGINT) AS y, sequence_label FROM numbered""",
    "sequence_arrays": f"WITH {SEQUENCES_SQL} SELECT sequence_id, x_cat, flags FROM numbered",
    "inference_sequences": f"WITH {INFERENCE_SQL} SELECT * FROM seqs",
}
