"""Connected components of a link table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.session import checkpointed


LINKS_A_TASK = 250_000


def _dealt(rows: DataFrame, tasks: int) -> DataFrame:
    """``rows`` in at most ``tasks`` tasks; a table for more keeps the session's number, which adaptive execution may split."""
    return rows.coalesce(tasks) if tasks < int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def _star(links: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One round. ``large``: a node's larger neighbours move to its least one; else itself and its smaller ones."""
    if large:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
    joined = _dealt(both.join(least, F.col("a") == F.col("node")), tasks)
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return _dealt(moved.where("a <> b").distinct(), tasks)


def components(links: DataFrame) -> DataFrame:
    """``(node, component)``: for each node of a link, the least node it can reach.

    ``links`` has columns ``a`` and ``b`` of one ordered type. A hub with any
    number of links is aggregated before the shuffle and split by adaptive
    execution in the join. Each round is checkpointed to the shared folder, and
    the rounds end when one changes nothing: every other one moves a node to a smaller
    neighbour, so they do end, after about the square of the logarithm of the
    nodes in practice. A round has tasks by its number of links: a small table in
    many tasks leaves a file a task and shuffle. Links of a node with itself and null
    ends are ignored; an empty table gives no rows.
    """
    links = checkpointed(links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b").distinct())
    last, tasks = None, max(1, -(-links.count() // LINKS_A_TASK))
    links = _dealt(links, tasks)
    while True:
        links = checkpointed(_star(_star(links, True, tasks), False, tasks))
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == last or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        last, tasks = now, max(1, -(-now[0] // LINKS_A_TASK))
