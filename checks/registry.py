"""All registered queries and their SQL."""

from __future__ import annotations

from checks import (
    anchor_queries,
    evaluation_queries,
    log_queries,
    model_queries,
    score_queries,
    sequence_queries,
    stream_queries,
    window_queries,
)

MODULES = [window_queries, sequence_queries, log_queries, anchor_queries, score_queries, evaluation_queries, model_queries, stream_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}


def flagship(spark, sf_dir):
    """Alert intervals: sequences and windows fused, merged and summarised."""
    return QUERIES["alert_intervals"](spark, sf_dir)
