"""Folders for queries that write a table and read it back."""

import uuid

from auditloom.session import scratch_root


def fresh(spark, name: str) -> str:
    return f"{scratch_root(spark)}/check-{name}-{uuid.uuid4().hex}"
