"""Stages and operators do the work that their method names, on all rows."""

from pyspark.sql import functions as F

import corpus_pipeline
from auditloom.llm import licences


def test_every_paragraph_is_classified(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"word{i} speaks of rivers and hills\n\nnothing here {i}") for i in range(30)], "doc_id long, text string")
    model, seen = licences.fit(docs), []
    score = model.probabilities
    monkeypatch.setattr(model, "probabilities", lambda rows: (seen.append(rows.count()), score(rows))[1])
    licences.scan(docs, model).collect()
    assert seen == [60]


def test_every_paragraph_trains_the_licence_model(spark, monkeypatch):
    lines = F.transform(F.sequence(F.lit(1), F.lit(10)), lambda i: F.concat_ws(" ", F.lit("rivers and"), F.element_at(F.array(F.lit("license"), F.lit("software")), 1 + i % 2), "id", i))
    docs = spark.range(450).select(F.nullif("id", F.lit(7)).alias("doc_id"), F.array_join(lines, "\n\n").alias("text"))
    learn, score, seen = licences.LogisticRegression.fit, licences.Model.probabilities, []

    def learned(self, rows):
        seen.append(rows.where("family = 'unknown'").agg(F.sum("weight")).first()[0])
        return learn(self, rows)

    def scored(self, rows):
        seen.append(rows.agg(F.sum("kept_back")).first()[0])
        return score(self, rows)

    monkeypatch.setattr(licences, "BACKGROUND", 1e9, raising=False)
    monkeypatch.setattr(licences.LogisticRegression, "fit", learned)
    monkeypatch.setattr(licences.Model, "probabilities", scored)
    licences.fit(docs)
    assert sum(seen) == 4500 and 1300 < seen[1] < 1700


def test_near_stage_compares_fingerprints(spark):
    # one text of repeats with two endings: equal fingerprints, few common five-word shingles
    texts = ["a b c " * 200 + " ".join(f"{end}{i}" for i in range(12)) for end in "xy"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
