"""A training corpus in five stages, each an operator over all that the one before kept."""

from __future__ import annotations

from auditloom.llm import decontaminate, line_templates, near_texts, packing, quality, simhash
from auditloom.llm.queries import word_bpe
from auditloom.session import materialise


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and the certified cutoffs."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark, docs, sf_dir):
    """All documents, without lines whose template recurs across texts."""
    return line_templates.drop_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near fingerprints, then of those left with five-word shingles of similarity 0.8."""
    return near_texts.keep_one(materialise(simhash.keep_one(docs), "pipeline-fingerprints"))


def decontamination(spark, docs, sf_dir):
    """Documents without benchmark passages; those mostly made of them go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sequence_packing(spark, docs, sf_dir):
    """Pieces of the kept documents in training sequences, with their ids."""
    return packing.pack(docs, word_bpe())


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
    ("decontamination", decontamination), ("sequence_packing", sequence_packing),
]

# Fitted cutoffs, near-duplicate components and token ids are beyond SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """Apply the stages to ``documents``; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


def pipeline(spark, sf_dir):
    return run(spark, sf_dir)
