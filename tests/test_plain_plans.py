"""Plans that tasks can take along, and logs cut by size."""

from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import seqmodel, sequences
from auditloom.operators.small import attach_row
from auditloom.sources.audit_log import read_raw
from checks.log_queries import date_files


def test_no_subquery_inside_expressions(spark):
    rows = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("segment_id"), (F.col("id") % 2).cast("int").alias("y"), "id")
    marks = seqmodel.group_split(rows, label=None)
    assert marks.where("is_validation").count() == 10
    total = attach_row(rows, rows.agg(F.sum("id").alias("total")))
    assert {r["total"] for r in total.collect()} == {780}
    vocab = spark.createDataFrame([("syscall", "open \u00e9\"", 2), ("syscall", "close", 3)], "column string, token string, id int")
    events = spark.createDataFrame([("open \u00e9\"",), ("close",), ("other",), (None,)], "syscall string")
    from auditloom import schema as S
    events = events.select("syscall", *[F.lit("").alias(c) for c in S.TOKEN_COLUMNS if c != "syscall"])
    found = sequences.encode(events, vocab)
    at = S.TOKEN_COLUMNS.index("syscall")
    assert [r["tokens"][at] for r in found.collect()] == [2, 3, 1, 1]
    for frame in (marks, total, found):
        assert "scalar-subquery" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_files_of_a_generation_keep_their_order(spark, tmp_path):
    folders = [f"{tmp_path}/audit.log.1", f"{tmp_path}/audit.log"]
    # the younger generation is written first
    for folder, start, codec in ((folders[1], 50, None), (folders[0], 0, "gzip")):
        spark.range(start, start + 50, 1, 5).selectExpr("cast(id AS string) AS value").write.text(folder, compression=codec)
    date_files(spark, folders)
    rows = read_raw(spark, f"{tmp_path}/*/*.txt*").orderBy("pos").collect()
    assert [int(r["value"]) for r in rows] == list(range(100))


def test_event_projection_stays_out_of_one_large_method(spark):
    texts = ["", "x", "12", " 7 ", "NaN", "0x", None]
    rows = spark.createDataFrame([("h", str(i), str(i), t, t) for i, t in enumerate(texts)], "source string, timestamp string, event_id string, argc string, uid string")
    events = sequences.prepare_sequence_events(rows)
    ordered = sequences.with_numeric_features(sequences.order_events(events, ["source"])).df
    found = {r["event_id"]: r["numeric"] for r in ordered.collect()}
    at = S.NUMERIC_COLUMNS.index("argc_log1p")
    assert [round(found[str(i)][at], 4) for i in range(len(texts))] == [0, 0, 2.5649, 2.0794, 0, 0, 0]
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    lines = [line for line in plan.split("\n") if "Project [" in line and "try_cast(argc" in line or "try_cast(CASE WHEN RLIKE(argc" in line]
    # blank texts are not cast, and whole-stage code, marked by a star, does not hold the numbers
    assert lines and all("RLIKE(argc" in line and "*(" not in line for line in lines)
