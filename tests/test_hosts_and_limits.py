"""Hosts stay apart, caps are gone, and workers import the package from any folder."""

import os
import subprocess
import sys

from pyspark.sql import functions as F

from auditloom.operators import evaluation as E
from auditloom.operators import iforest as I
from auditloom.operators import sequences as Q
from auditloom.operators.small import checked
from auditloom.sources.runs import intervals_from_metadata


def events(spark, hosts):
    rows = [(h, str(i), f"{1000 + i * (1 + k)}.000000", "benign" if i % 3 else "malicious", f"cmd{i % 4}", "run-1")
            for k, h in enumerate(hosts) for i in range(23)]
    return spark.createDataFrame(rows, "source string, event_id string, timestamp string, manual_label string, comm string, attack_run_id string")


def test_sequences_of_two_hosts_equal_each_alone(spark):
    both = events(spark, ["a", "b"])
    vocab = Q.learn_vocab(Q.prepare_sequence_events(both, ["benign", "malicious"]), 32)

    def rows(df):
        found, _ = Q.build_sequences(df, vocab, 5, 3, min_malicious=1, hosts=["source"])
        return sorted((r["source"], r["start_us"], r["y"], str(r["x_cat"]), str(r["x_num"])) for r in found.collect())

    alone = rows(both.where("source = 'a'")) + rows(both.where("source = 'b'"))
    assert rows(both) == sorted(alone) and len(alone) == 2 * 7
    short = Q.too_short(both.where("source = 'a' OR event_id < 3"), 20).collect()
    assert [(r["source"], r["needed"]) for r in short] == [("b", 20)]


def test_any_number_of_thresholds(spark):
    scores = spark.range(500).select((F.col("id") / 500).alias("s"), (F.col("id") % 3 == 0).cast("int").alias("y_true"))
    thresholds = spark.range(1500).select((F.col("id") / 1500).alias("threshold"), F.lit(0.1).alias("target_fpr"))
    found = E.evaluate_thresholds(thresholds, scores, "s", max_group_rows=300, chunk_rows=100)
    rows = {round(r["threshold"] * 1500): r for r in found.collect()}
    assert len(rows) == 1500
    for i in (0, 1, 3, 700, 1499):
        above = [k for k in range(500) if k / 500 >= i / 1500]
        assert rows[i]["tp"] == sum(k % 3 == 0 for k in above) and rows[i]["fp"] == sum(k % 3 > 0 for k in above)
        assert rows[i]["tp"] + rows[i]["fn"] == 167 and rows[i]["eval_windows"] == 500


def test_samples_of_very_many_rows(spark):
    rows = spark.range(200_000).select("id", F.array(F.lit(0.0)).alias("vector"))
    # as if these were the first of 10^6 rows: one hash a row, and still an even draw
    sample = I.sample_rows(rows, ["id"], 10, 64, 1_000_000, 1)
    drawn = sample.groupBy("tree").count().collect()
    assert len(drawn) == 10 and all(10 <= r["count"] <= 64 for r in drawn)
    assert I.sample_rows(rows, ["id"], 300, 256, 10**12, 1).count() <= 3
    few = I.sample_rows(rows.limit(100), ["id"], 5, 64, 100, 1).groupBy("tree").count().collect()
    assert all(r["count"] == 64 for r in few)


def test_small_tables_are_measured_before_they_are_fetched(spark):
    wide = spark.range(40).select("id", F.repeat(F.lit("x"), 3_000_000).alias("text"))
    found, small = checked(wide)
    assert not small and found.count() == 40
    assert checked(spark.range(5).select(F.lit("a").alias("t")))[1]
    assert not checked(spark.range(5).select(F.lit("a").alias("t")), 4)[1]


def test_metadata_folders_with_special_characters(spark, tmp_path):
    text = "run_id=r\ntarget_start_epoch=1.0\ntarget_end_epoch=2.0\n"
    root = tmp_path / "a+b (c) d"
    for folder in ("one", "chains/two", "capabilities"):
        (root / folder).mkdir(parents=True)
        (root / folder / "metadata.txt").write_text(text)
    found = intervals_from_metadata(spark, str(root)).collect()
    assert len(found) == 1 and "/one/" in found[0]["metadata_path"]


def test_workers_import_the_package_from_a_foreign_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path / 'shared')!r}).getOrCreate()
from auditloom.operators.iforest import fit_iforest
rows = spark.range(40).select(F.lit("h").alias("source"), F.col("id").alias("window_id"), F.array(F.col("id").cast("double")).alias("features"))
model = fit_iforest(rows, trees=3)
print("scored", model.transform(rows, 0.0).where("iforest_anomaly_score IS NOT NULL").count())
spark.stop()
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH" and not k.startswith(("SPARK", "PYSPARK"))}
    env["SPARK_LOCAL_IP"] = "127.0.0.1"
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "scored 40" in ran.stdout, ran.stderr[-2000:]


def test_entry_without_the_text_operators(tmp_path):
    """A copy without ``auditloom/llm``, ``tests/llm`` and the pipeline still lists and loads the other queries."""
    import shutil

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", ".git", "__pycache__", ".pytest_cache")
    shutil.copytree(root, tmp_path / "copy", ignore=skip)
    script = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(len(q), 'pipeline' in q, set(o) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path / "copy", env=env, capture_output=True, text=True, timeout=100)
    assert ran.stdout.split()[1:] == ["False", "True"], ran.stderr[-2000:]
