"""Stated query items, dealt into blocks of bounded size that tasks build and write."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm import shared_files
from auditloom.shipping import ship

BLOCK_BYTES = 2 << 20


def build(items: DataFrame, name: str, make: Callable[[pa.Table], object], block_bytes: int = BLOCK_BYTES) -> list[str]:
    """Files of ``make(items of a block)``, each pickled into the shared folder by the task that built it.

    Equal rows count once. Items are dealt by their hash, so a block holds about
    ``block_bytes`` of text, or one longer item; more items make more blocks. Only
    the files' names reach the driver, in the order of the blocks. An empty table
    gives no file.
    """
    items = items.distinct()
    size = items.agg(F.sum(F.lit(16) + F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0]
    if size is None:
        return []
    spark = items.sparkSession
    ship(spark)
    folder = shared_files.new_folder(spark, name)
    blocks = -(-size // block_bytes)

    def built(table: pa.Table) -> pa.Table:
        block = table.column("block")[0].as_py()
        path = shared_files.put(folder, f"{name}-{block:05d}", pickle.dumps(make(table.drop_columns(["block"]))))
        return pa.table({"block": [block], "path": [path]})

    dealt = items.withColumn("block", F.pmod(F.xxhash64(*items.columns), F.lit(blocks)).cast("int"))
    rows = dealt.groupBy("block").applyInArrow(built, "block long, path string").collect()
    return [r["path"] for r in sorted(rows, key=lambda r: r["block"])]


_held: dict[str, object] = {}


def load(path: str):
    """A block's content; a worker keeps the last one."""
    if path not in _held:
        _held.clear()
        _held[path] = pickle.loads(shared_files.get(path))
    return _held[path]
