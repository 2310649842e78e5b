"""Tumbling-window queries (group D)."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions import text as X
from auditloom.operators import sketches as K
from auditloom.operators import windows as W
from auditloom.session import materialise
from checks.audit_view import AUDIT_SQL, WINDOW_US, audit_events

TOP = 4


def windowed(spark, sf_dir):
    return W.assign_windows(W.prepare_events(audit_events(spark, sf_dir)), WINDOW_US)


BASE_SQL_ORIGIN = "(SELECT source, min(ts_us) AS origin_us FROM audit GROUP BY source)"
WINDOWED_SQL = f"""{AUDIT_SQL},
windowed AS (
  SELECT *, lower(paths || '|' || path) AS all_paths, (ts_us - origin_us) // {WINDOW_US} AS window_id,
    origin_us + ((ts_us - origin_us) // {WINDOW_US}) * {WINDOW_US} AS window_start_us
  FROM audit_paths JOIN {BASE_SQL_ORIGIN} USING (source)
)"""


def prepared(spark, sf_dir):
    return W.prepare_events(audit_events(spark, sf_dir)).select(
        "event_id", "ts_us", "exe_basename", "all_paths",
        F.col("record_count_num").cast("bigint").alias("record_count"))


def assigned(spark, sf_dir):
    return windowed(spark, sf_dir).select("source", "event_id", "window_id", "window_start_us", "window_end_us")


def features(columns):
    def run(spark, sf_dir):
        found = W.window_features(windowed(spark, sf_dir))
        return found.select("source", "window_id", *[
            F.round(c, 6).alias(c) if c.endswith("_mean") else F.col(c) for c in columns])
    return run


VOLUME = ["event_count", "record_count_sum", "record_count_mean", "path_count_sum", "path_count_mean"]
CONDITIONAL = ["execve_count", "command_count", "success_yes_count", "success_no_count", "root_uid_count",
               "root_euid_count", "unset_auid_count", "failed_execve_count", "network_event_count"]
DISTINCT = [f"unique_{c}_count" for c in S.DISTINCT_FIELDS]
PATHS = list(S.PATH_FAMILIES)

FEATURE_SQL = {
    "event_count": "count(*)",
    "record_count_sum": "CAST(sum(record_count) AS BIGINT)",
    "record_count_mean": "round(avg(record_count), 6)",
    "path_count_sum": "CAST(sum(path_count) AS BIGINT)",
    "path_count_mean": "round(avg(path_count), 6)",
    "execve_count": "count(*) FILTER (syscall = 'execve')",
    "command_count": "count(*) FILTER (command <> '')",
    "success_yes_count": "count(*) FILTER (success = 'yes')",
    "success_no_count": "count(*) FILTER (success = 'no')",
    "root_uid_count": "count(*) FILTER (uid = '0')",
    "root_euid_count": "count(*) FILTER (euid = '0')",
    "unset_auid_count": "count(*) FILTER (auid = '4294967295')",
    "failed_execve_count": "count(*) FILTER (syscall = 'execve' AND success = 'no')",
    "network_event_count": "CAST(sum((syscall IN ('socket','connect','accept','accept4','bind','listen','sendto'))::INT"
                           " + (saddr <> '')::INT + contains(key, 'network')::INT) AS BIGINT)",
    **{f"unique_{c}_count": f"count(DISTINCT nullif({c}, ''))" for c in S.DISTINCT_FIELDS},
    "tmp_path_event_count": "count(*) FILTER (all_paths LIKE '%/tmp%')",
    "home_path_event_count": "count(*) FILTER (all_paths LIKE '%/home%')",
    "etc_path_event_count": "count(*) FILTER (all_paths LIKE '%/etc%')",
    "ssh_path_event_count": "count(*) FILTER (all_paths LIKE '%.ssh%' OR all_paths LIKE '%authorized_keys%')",
    "root_ssh_path_event_count": "count(*) FILTER (all_paths LIKE '%/root/.ssh%')",
    "var_log_path_event_count": "count(*) FILTER (all_paths LIKE '%/var/log%')",
    "dev_shm_path_event_count": "count(*) FILTER (all_paths LIKE '%/dev/shm%')",
}


def features_sql(columns):
    picked = ", ".join(f"{FEATURE_SQL[c]} AS {c}" for c in columns)
    return f"WITH {WINDOWED_SQL} SELECT source, window_id, {picked} FROM windowed GROUP BY source, window_id"


def labelled(spark, sf_dir):
    return W.window_features(windowed(spark, sf_dir)).select("source", "window_id", *S.LABEL_FEATURES)


LABEL_SQL = """
  count(*) FILTER (manual_label = 'benign') AS label_benign_count,
  count(*) FILTER (manual_label = 'malicious') AS label_malicious_count,
  count(*) FILTER (manual_label = 'ambiguous') AS label_ambiguous_count,
  count(*) FILTER (manual_label = '') AS label_unlabeled_count,
  CASE WHEN count(*) FILTER (manual_label = 'malicious') > 0 THEN 'malicious'
    WHEN count(*) FILTER (manual_label = 'ambiguous') > 0 THEN 'ambiguous'
    WHEN count(*) FILTER (manual_label = 'benign') > 0 AND count(*) FILTER (manual_label = '') = 0 THEN 'benign'
    WHEN count(*) FILTER (manual_label = 'benign') > 0 THEN 'weak_benign' ELSE 'unlabeled' END AS window_label"""

CATEGORY_SQL = f"""{WINDOWED_SQL},
named AS (
  SELECT source, window_id, family, coalesce(nullif(trim(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'missing') AS value
  FROM (SELECT source, window_id, unnest(['syscall','primary_type','key','comm','exe_basename']) AS family,
               unnest([syscall, primary_type, key, comm, exe_basename]) AS raw FROM windowed)
),
counted AS (SELECT family, value, count(*) AS n FROM named GROUP BY family, value),
learnt AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY family ORDER BY n DESC, value) AS INTEGER) AS rank FROM counted)
  WHERE rank <= {TOP}
)"""


def top_categories(spark, sf_dir):
    return W.top_categories(W.value_counts(windowed(spark, sf_dir), ["source"]), TOP)


def category_counts(spark, sf_dir):
    values = W.value_counts(windowed(spark, sf_dir), ["source"])
    return W.category_counts(values, W.learn_schema(values, TOP))


def aligned(spark, sf_dir):
    """Feature vectors, one row per (window, feature) so that SQL can follow."""
    found, schema = W.build_window_features(audit_events(spark, sf_dir), WINDOW_US, top=TOP)
    named = F.arrays_zip(F.array(*[F.lit(n) for n in schema.names]).alias("feature"),
                         F.col("features").alias("value"))
    return found.select("source", "window_id", F.inline(named)).select(
        "source", "window_id", "feature", F.round("value", 6).alias("value"))


ALIGNED_SQL = f"""WITH {CATEGORY_SQL},
base AS (SELECT source, window_id, {", ".join(f"CAST({FEATURE_SQL[c]} AS DOUBLE) AS {c}" for c in S.BASE_FEATURES)}
  FROM windowed GROUP BY source, window_id),
long AS (UNPIVOT base ON COLUMNS(* EXCLUDE (source, window_id)) INTO NAME feature VALUE value),
hits AS (SELECT source, window_id, family, value, count(*) AS n FROM named GROUP BY ALL)
SELECT source, window_id, feature, value FROM long
UNION ALL
SELECT b.source, b.window_id,
  CASE l.family WHEN 'primary_type' THEN 'type' WHEN 'exe_basename' THEN 'exe' ELSE l.family END || '_' || l.value || '_count',
  CAST(coalesce(h.n, 0) AS DOUBLE)
FROM (SELECT source, window_id FROM base) b CROSS JOIN learnt l
LEFT JOIN hits h ON h.source = b.source AND h.window_id = b.window_id AND h.family = l.family AND h.value = l.value"""


WIDER = [1, 4]


def rolled_up(spark, sf_dir):
    """Distinct counts of windows and of windows four times as wide: exact ones, and whether those from merged sketches agree.

    Wide sketches come from narrow ones alone. Four standard errors are allowed, and one value.
    """
    events = windowed(spark, sf_dir)
    narrow = materialise(K.distinct_sketches(events), "distinct-sketches")
    out = None
    for factor in WIDER:
        found = K.distinct_estimates(K.widen(narrow, factor)).withColumnsRenamed({"source": "_s", "window_id": "_w", "field": "_f"})
        wide = events.withColumn("window_id", F.floor(F.col("window_id") / factor).cast("bigint"))
        exact = W.value_counts(wide, ["source"]).where(F.col("field").isin(S.DISTINCT_FIELDS) & (F.col("value") != "")).groupBy(
            "source", "window_id", "field").agg(F.count(F.lit(1)).alias("n"))
        met = exact.join(found, (F.col("source") == F.col("_s")) & (F.col("window_id") == F.col("_w")) & (F.col("field") == F.col("_f")))
        near = F.abs(F.col("estimate") - F.col("n")) <= F.greatest(F.lit(1.0), 4 * 1.04 / 2 ** (K.HLL_BITS / 2) * F.col("n"))
        part = met.select("source", F.lit(factor).alias("width"), "window_id", "field", "n", near.cast("int").alias("sketch_agrees"))
        out = part if out is None else out.unionByName(part)
    return out


QUERIES = {
    "rolled_up_distinct_counts": rolled_up,
    "prepared_events": prepared,
    "tumbling_windows": assigned,
    "window_volume": features(VOLUME),
    "window_conditional_counts": features(CONDITIONAL),
    "window_distinct_counts": features(DISTINCT),
    "window_path_counts": features(PATHS),
    "window_labels": labelled,
    "top_category_schema": top_categories,
    "window_category_counts": category_counts,
    "window_feature_vectors": aligned,
}

ORACLES = {
    "rolled_up_distinct_counts": f"""WITH {WINDOWED_SQL}, wide AS (
        SELECT w.*, width, window_id // width AS wide_id FROM windowed w, (SELECT unnest({WIDER})::INTEGER AS width)),
        long AS (SELECT source, width, wide_id, unnest([{", ".join(f"'{c}'" for c in S.DISTINCT_FIELDS)}]) AS field, unnest([{", ".join(S.DISTINCT_FIELDS)}]) AS value FROM wide)
        SELECT source, width, CAST(wide_id AS BIGINT) AS window_id, field, count(DISTINCT value) AS n, 1 AS sketch_agrees FROM long WHERE value <> '' GROUP BY ALL""",
    "prepared_events": f"""WITH {AUDIT_SQL} SELECT event_id, ts_us, exe_basename,
        lower(paths || '|' || path) AS all_paths, record_count FROM audit_paths""",
    "tumbling_windows": f"""WITH {WINDOWED_SQL} SELECT source, event_id, window_id, window_start_us,
        window_start_us + {WINDOW_US} AS window_end_us FROM windowed""",
    "window_volume": features_sql(VOLUME),
    "window_conditional_counts": features_sql(CONDITIONAL),
    "window_distinct_counts": features_sql(DISTINCT),
    "window_path_counts": features_sql(PATHS),
    "window_labels": f"WITH {WINDOWED_SQL} SELECT source, window_id, {LABEL_SQL} FROM windowed GROUP BY source, window_id",
    "top_category_schema": f"WITH {CATEGORY_SQL} SELECT family, value, n, rank FROM learnt",
    "window_category_counts": f"""WITH {CATEGORY_SQL} SELECT source, window_id, family, value, count(*) AS n
        FROM named WHERE (family, value) IN (SELECT (family, value) FROM learnt) GROUP BY ALL""",
    "window_feature_vectors": ALIGNED_SQL,
}
