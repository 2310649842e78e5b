"""Events put together from records that arrive over several batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions import text as X
from auditloom.operators.events import build_events, extract_records
from auditloom.streaming.runs import event_time


def stream_events(lines: DataFrame, watermark: str = "1 minute", **options) -> DataFrame:
    """Events of a stream of log lines ``(source, pos, value)``, each once the watermark has passed it.

    ``pos`` is any ordered value that places the lines of an event (a log offset,
    a line number). The records of an event share its time, which is part of the
    key: ids that restart stay apart. State holds one row for each record kind
    and path name of an open event, then one for the event; both leave when the
    watermark passes the event's time. Records that come later are dropped and
    counted in the run's progress. The columns are those of
    ``events.build_events``.
    """
    records = extract_records(lines).withColumn("event_time", event_time(X.epoch_us(F.col("timestamp"))))
    records = records.withWatermark("event_time", watermark)
    return build_events(records, ["source", "event_id", "timestamp", "event_time"], **options)
