"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from auditloom.llm import (
    decontaminate,
    html_text,
    lexical,
    licences,
    line_templates,
    ngram_lm,
    packing,
    pfor,
    quality,
    simhash,
    suffix_dedup,
    toxicity,
    vector_codes,
)
from auditloom.llm.texts import documents


def word_bpe() -> str:
    """File of the public tokenizer that the token queries are defined on."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_licences(spark, sf_dir):
    return licences.scan(documents(spark, sf_dir))


def op2_packing(spark, sf_dir):
    return packing.digest(packing.pack(documents(spark, sf_dir), word_bpe()))


def op3_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir))


def op4_decontamination(spark, sf_dir):
    return decontaminate.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality(spark, sf_dir):
    return quality.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_kneser_ney(spark, sf_dir):
    return ngram_lm.report(documents(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    return suffix_dedup.report(documents(spark, sf_dir))


def op8_token_files(spark, sf_dir):
    return pfor.read_tokens(pfor.write_tokens(documents(spark, sf_dir), word_bpe()))


def op9_toxicity(spark, sf_dir):
    return toxicity.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op10_line_templates(spark, sf_dir):
    return line_templates.report(documents(spark, sf_dir))


def op11_html_text(spark, sf_dir):
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_vector_codes(spark, sf_dir):
    return vector_codes.report(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_lexical(spark, sf_dir):
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_licences, op2_packing, op3_simhash, op4_decontamination, op5_quality, op6_kneser_ney, op7_suffix_dedup,
    op8_token_files, op9_toxicity, op10_line_templates, op11_html_text,
    op12_vector_codes, op13_lexical)}
ORACLES = {
    "op4_decontamination": decontaminate.ORACLE, "op12_vector_codes": vector_codes.ORACLE, "op13_lexical": lexical.ORACLE}
