import pytest
from pyspark.sql import DataFrameReader

from auditloom import schema as S
from auditloom.operators import anchor as A
from auditloom.operators import review as R
from auditloom.sources.runs import intervals_from_metadata
from auditloom.sources.slices import read_review_slices, with_slice_name, write_review_slices
from checks.anchor_queries import write_metadata

FIELDS = "run_id string, chain_id string, delivery string, payload string, category string, privilege string, " \
         "target_start_epoch string, target_end_epoch string, target_start_iso string, target_end_iso string"


def intervals(spark, rows):
    return spark.createDataFrame(
        [(name, "c", "d", f"p/{name}", "cat", "root", str(a), str(b), "i", "j") for name, a, b in rows], FIELDS)


CASES = [(96.9, "", "outside"), (97, "A", "pre_context"), (107, "A", "attack_window"), (110, "A", "attack_window"),
         (112, "B", "attack_window"), (117.5, "B", "post_context"), (118, "C", "pre_context"),
         (121, "C", "attack_window"), (124, "C", "post_context"), (124.1, "", "outside")]


@pytest.mark.parametrize("limits", [{}, {"limit": 1, "max_group_rows": 2, "chunk_rows": 2}])
def test_anchor_cases(spark, limits):
    ranked = A.prepare_intervals(intervals(spark, [("C", 120, 121), ("A", 100, 110), ("B", 105, 115)]))
    events = spark.createDataFrame([(str(t), str(i)) for i, (t, _, _) in enumerate(CASES)],
                                   "timestamp string, event_id string")
    if limits:
        segments = A.timeline(ranked, [], 3_000_000, 3_000_000, max_group_rows=1, chunk_rows=1)
        assert segments.count() == A.timeline(ranked, [], 3_000_000, 3_000_000).count()
    found = A.anchor_events(events, ranked, **({"max_group_rows": 2, "chunk_rows": 2} if limits else {}))
    got = {r["event_id"]: (r["attack_run_id"], r["anchor_phase"]) for r in found.collect()}
    assert got == {str(i): (run, phase) for i, (_, run, phase) in enumerate(CASES)}
    stats = A.anchor_stats(found).first()
    assert tuple(stats) == (10, 8, 4, 2, 2)


def owner_by_rule(t, rows, buffer):
    best = None
    for rank, (name, a, b) in enumerate(sorted(rows, key=lambda r: (r[1], r[2]))):
        if a <= t <= b:
            return name
        if a - buffer <= t <= b + buffer:
            near = (min(abs(t - a), abs(t - b)), rank, name)
            best = min(best, near) if best else near
    return best[2] if best else ""


def test_anchor_equals_rule_on_random_intervals(spark):
    import random

    random.seed(7)
    rows = []
    for i in range(60):
        a = random.randint(0, 900)
        rows.append((f"r{i:02d}", a, a + random.choice([0, 1, 3, 20, 90])))
    moments = list(range(-20, 1050))
    ranked = A.prepare_intervals(intervals(spark, rows))
    events = spark.createDataFrame([(str(t), str(t)) for t in moments], "timestamp string, event_id string")
    for before in (0, 6):
        found = A.anchor_events(events, ranked, before * 1_000_000, before * 1_000_000)
        got = {int(r["event_id"]): r["attack_run_id"] for r in found.collect()}
        assert got == {t: owner_by_rule(t, rows, before) for t in moments}


def test_bad_intervals_fail(spark):
    events = spark.createDataFrame([("1.0", "1")], "timestamp string, event_id string")
    for rows, message in (([("A", "x", 2)], "bad target_start_epoch"), ([("A", 3, 2)], "ends before it starts")):
        with pytest.raises(Exception, match=message):
            A.anchor_events(events, A.prepare_intervals(intervals(spark, rows))).collect()
    with pytest.raises(ValueError, match="run_id"):
        A.prepare_intervals(events)


def candidate(spark, blanks, phase="attack_window", label=""):
    described = [c for c in S.REVIEW_COLUMNS if c not in ("manual_label", "manual_note")]
    keep = ["anchor_phase", "attack_run_id", "timestamp", "event_id", "attack_payload"]
    free = [c for c in described if c not in keep]
    row = {c: "x" for c in described} | dict.fromkeys(free[:blanks], " ") | {
        "anchor_phase": phase, "manual_label": label, "manual_note": ""}
    return R.review_candidates(spark.createDataFrame([row])).first()["manual_label"]


def test_review_defaults(spark):
    assert candidate(spark, 14) == "ambiguous"
    assert candidate(spark, 13) == "benign"
    assert candidate(spark, 22, "pre_context") == "benign"
    assert candidate(spark, 22, label="malicious") == "malicious"


REVIEW = "attack_run_id string, event_id string, manual_label string, manual_note string, review_source string, review_row bigint"


def test_review_label_rules(spark):
    rows = [("r", "1", " Malicious", "n", "b.csv", 1), ("r", "1", "malicious", "n", "a.csv", 9),
            ("r", "2", "none", "", "a.csv", 2), ("", "3", "benign", "", "a.csv", 3), ("r", "4", "benign", "", "a.csv", 4)]
    labels = R.load_review_labels(spark.createDataFrame(rows, REVIEW))
    assert sorted(map(tuple, labels.collect())) == [("r", "1", "malicious", "n", "a.csv"), ("r", "4", "benign", "", "a.csv")]
    events = spark.createDataFrame([("r", "1", "p"), ("r", "2", "p"), ("", "4", "")],
                                   "attack_run_id string, event_id string, attack_payload string")
    merged = R.merge_labels(events, labels)
    assert sorted((r["event_id"], r["manual_label"], r["review_source"]) for r in merged.collect()) == [
        ("1", "malicious", "a.csv"), ("2", "", ""), ("4", "", "")]
    assert sorted(map(tuple, R.label_stats(merged).collect())) == [("malicious", 1, 1, 0), ("unlabeled", 2, 0, 2)]
    assert sorted(map(tuple, R.payload_label_stats(merged).collect())) == [("p", "malicious", 1), ("p", "unlabeled", 1)]
    clash = spark.createDataFrame(rows + [("r", "4", "benign", "other", "c.csv", 5)], REVIEW)
    assert R.label_conflicts(clash).count() == 1
    with pytest.raises(Exception, match="conflicting labels"):
        R.load_review_labels(clash).collect()
    with pytest.raises(Exception, match="unsupported manual_label"):
        R.load_review_labels(spark.createDataFrame([("r", "1", "maybe", "", "a", 1)], REVIEW)).collect()


def test_slices_round_trip(spark, tmp_path):
    rows = [{c: f"{c}{i}" for c in S.REVIEW_COLUMNS} | {
        "attack_run_id": f"run {i % 2}/x", "attack_payload": "a/b c", "timestamp": str(10 - i), "event_id": str(i),
        "manual_label": "benign", "manual_note": 'said "no", twice'} for i in range(6)]
    path = str(tmp_path / "slices")
    write_review_slices(spark.createDataFrame(rows), path)
    names = sorted(p.name for p in (tmp_path / "slices").iterdir() if p.is_dir())
    assert names == ["slice_name=run_0_x__a_b_c", "slice_name=run_1_x__a_b_c"]
    back = read_review_slices(spark, path)
    labels = R.load_review_labels(back)
    assert labels.count() == 6
    assert {r["manual_note"] for r in labels.collect()} == {'said "no", twice'}
    one = back.where("attack_run_id = 'run 0/x'").orderBy("review_row").select("timestamp").collect()
    assert [r[0] for r in one] == ["6", "8", "10"]


def test_one_file_names_the_columns_of_slices(spark, tmp_path, monkeypatch):
    rows = [{c: f"{c}{i}" for c in S.REVIEW_COLUMNS} | {"attack_run_id": f"run{i % 4}", "manual_label": "benign", "timestamp": str(i)} for i in range(8)]
    path = str(tmp_path / "a folder")
    write_review_slices(spark.createDataFrame(rows), path)
    inferred, read = [], DataFrameReader.csv
    # without a schema of its own the reader goes through all files of a folder
    monkeypatch.setattr(DataFrameReader, "csv", lambda self, at, **more: (inferred.append(at), read(self, at, **more))[1])
    back = read_review_slices(spark, path)
    assert [at.endswith(".csv") for at in inferred] == [True, False]
    assert back.columns == [*S.REVIEW_COLUMNS, "review_source", "review_row"]
    assert sorted(r["slice_name"] for r in with_slice_name(back).collect()) == sorted(f"run{i % 4}__attack_payload{i % 4}" for i in range(8))


def test_intervals_from_metadata(spark, tmp_path):
    def put(folder, text):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "metadata.txt").write_text(text)

    put("b", "run_id=b\ntarget_start_epoch=10.1\ntarget_end_epoch=11\nsuccess=false\nsuccess=true\npayload=x=y=z\n")
    put("a", "run_id=a\ntarget_start_epoch=9.5\ntarget_end_epoch=9.9\n")
    put("none", "run_id=n\ntarget_start_epoch=9.5\n")
    put("chains/c", "run_id=c\ntarget_start_epoch=1\ntarget_end_epoch=2\n")
    put("capabilities/c", "run_id=c\ntarget_start_epoch=1\ntarget_end_epoch=2\n")
    found = intervals_from_metadata(spark, str(tmp_path)).collect()
    assert [(r["run_id"], r["success"], r["payload"]) for r in found] == [("a", "", ""), ("b", "true", "x=y=z")]
    assert A.prepare_intervals(spark.createDataFrame(found)).count() == 2
    assert found[0]["metadata_path"].endswith("a/metadata.txt")


def test_run_files_are_dealt_by_their_number(spark, tmp_path):
    names = [c for c in S.INTERVAL_COLUMNS if c != "metadata_path"]
    rows = [tuple(f"{c}{i}" if "epoch" not in c else f"{i}.5" for c in names) for i in (*range(7), 3)]
    rows = [tuple(f"run{i}" if c == "run_id" else v for c, v in zip(names, row, strict=True)) for i, row in zip((*range(7), 3), rows, strict=True)]
    path = str(tmp_path / "runs")
    write_metadata(spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)), path, 2)
    files = list((tmp_path / "runs").rglob("*.txt"))
    assert len(files) == 7  # one file a run id, also where the id repeats
    assert 2 <= len({f.parent for f in files}) <= 4  # tasks by the number of files, each with one folder
    found = intervals_from_metadata(spark, path, "*.txt").drop("metadata_path").collect()
    assert sorted(tuple(r) for r in found) == sorted(set(rows))
