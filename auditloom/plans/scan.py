"""End-to-end scoring of a log, from events to alerts."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.functions.text import MICROS, epoch_us
from auditloom.operators import alerts as H
from auditloom.operators import fusion as G
from auditloom.operators.events import load_events
from auditloom.operators.iforest import IForestModel
from auditloom.operators.seqmodel import SequenceModel, score_sequences
from auditloom.operators.sequences import inference_sequences, too_short, with_tie
from auditloom.operators.intervals import overlap_pairs
from auditloom.operators.small import solid_keys
from auditloom.operators.windows import build_window_features, with_defaults
from auditloom.plans import report as J
from auditloom.session import materialise
from auditloom.sources.tables import require_columns, write_table


@dataclass(frozen=True)
class ScanParameters:
    window_us: int = 10 * MICROS
    sequence_length: int = 50
    stride: int = 10
    iforest_threshold: float = S.IFOREST_THRESHOLD
    combined_threshold: float = S.COMBINED_THRESHOLD
    lstm_threshold: float | None = None
    lstm_weight: float = S.SEQUENCE_WEIGHT
    alert_gap_us: int = 5 * MICROS
    top_events: int = 8

    def __post_init__(self) -> None:
        positive = {"window_us", "sequence_length", "stride", "top_events"}
        for name in positive:
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be positive")
        for name in ("iforest_threshold", "alert_gap_us"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        for name in ("combined_threshold", "lstm_weight", "lstm_threshold"):
            value = getattr(self, name)
            if value is not None and not 0.0 <= value <= 1.0:
                raise ValueError(f"{name} must be between 0 and 1")


@dataclass(frozen=True)
class Scan:
    """Stage tables of one scan, in order."""

    events: DataFrame
    windows: DataFrame
    sequences: DataFrame
    combined: DataFrame
    members: DataFrame
    alerts: DataFrame
    unscored: DataFrame          # sources with too few events for one sequence
    parameters: ScanParameters
    inputs: dict[str, str] = field(default_factory=dict)

    def ranked(self, n: int | None = None) -> DataFrame:
        return G.rank_alerts(self.combined, n, ["source", "sequence_id"])

    def summary(self, **inputs: str) -> DataFrame:
        return J.summary_lines(self.alerts, self.combined, asdict(self.parameters), {**self.inputs, **inputs})

    def report(self, items: int = J.REPORT_ITEMS, output_dir: str = "") -> DataFrame:
        return J.full_report(self.alerts, self.combined, asdict(self.parameters), {**self.inputs, "output_dir": output_dir}, items)

    def alert_windows(self) -> DataFrame:
        """``source, alert_id, window_id``: the windows that the sequences of an alert overlap."""
        windows = G.window_scores(self.windows, self.parameters.iforest_threshold).select(
            "source", "window_id", F.col("window_start_us").alias("_ws"), F.col("window_end_us").alias("_we"))
        members = self.members.select("source", "alert_id", "start_us", "end_us")
        pairs = overlap_pairs(members, windows, ["source"], ("start_us", "end_us"), ("_ws", "_we"))
        return pairs.select("source", "alert_id", "window_id").distinct()

    def write(self, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
        for name in ("events", "windows", "sequences", "combined", "alerts", "unscored"):
            write_table(getattr(self, name), f"{path}/{name}", fmt, mode)
        write_table(self.ranked(), f"{path}/ranked", fmt, mode)
        write_table(H.alert_members(self.members), f"{path}/alert_members", fmt, mode)
        write_table(self.alert_windows(), f"{path}/alert_windows", fmt, mode)
        self.summary(output_dir=path).write.mode(mode).text(f"{path}/summary")
        self.report(output_dir=path).select("value").write.mode(mode).text(f"{path}/report")


def _complete(events: DataFrame) -> DataFrame:
    """Events with a time, a source and every column that evidence is drawn from."""
    require_columns(events, ["timestamp", "event_id"], "events")
    events = with_defaults(events, ["source", *H.EVIDENCE.values(), "path", "paths"])
    if "ts_us" not in events.columns:
        events = events.withColumn("ts_us", epoch_us(F.col("timestamp")))
    return solid_keys(events, ["source"]).where("ts_us IS NOT NULL")


def scan_events(events: DataFrame, forest: IForestModel, model: SequenceModel, vocab: DataFrame,
                parameters: ScanParameters | None = None, order: list[str] | None = None,
                **limits: int) -> Scan:
    """Score parsed events.

    Events, scored windows and scored sequences are each written once: two
    stages read every one of them, and no later stage repeats an earlier one.
    """
    p = parameters or ScanParameters()
    events = materialise(_complete(events), "events")
    features, _ = build_window_features(events, p.window_us, forest.schema)
    windows = materialise(forest.transform(features, p.iforest_threshold), "windows")
    ordered, tie = with_tie(events, order[0] if order else None)
    found = inference_sequences(ordered, vocab, p.sequence_length, p.stride, tie=tie, **limits)
    scored = score_sequences(found, model, p.lstm_threshold).drop("x_cat", "x_num")
    sequences = materialise(scored, "sequences")
    if sequences.isEmpty():
        raise ValueError(f"no source has the {p.sequence_length} events that one sequence needs")
    joined = G.overlap_scores(sequences, windows, threshold=p.iforest_threshold, norm_by=["source"], lists=False)
    combined = materialise(G.combine(joined, p.lstm_weight, p.combined_threshold), "combined")
    members = H.alert_sessions(combined, p.alert_gap_us, **limits)
    members = materialise(members, "members")
    alerts = materialise(H.with_evidence(
        H.summarise_alerts(members, lists=False), events, p.top_events, order, **limits), "alerts")
    return Scan(events, windows, sequences, combined, members, alerts, too_short(events, p.sequence_length), p)


def scan(spark: SparkSession, forest: IForestModel, model: SequenceModel, vocab: DataFrame,
         raw: str | list[str] | None = None, parsed: str | list[str] | None = None, source: str = "",
         parameters: ScanParameters | None = None, **options) -> Scan:
    """Score a raw log or a parsed event table."""
    events = load_events(spark, raw, parsed, source, **options)
    order = ["first_pos"] if "first_pos" in events.columns else None
    given = raw if raw is not None else parsed
    inputs = {"input": given if isinstance(given, str) else "|".join(given or []), "input_type": "raw" if raw is not None else "parsed"}
    return replace(scan_events(events, forest, model, vocab, parameters, order), inputs=inputs)


def alert_list(alerts: DataFrame) -> DataFrame:
    """Alerts with every list as text, in the exported column layout."""
    texts = {name: F.array_join(J.evidence_text(name, 1 << 20), " || " if name == "top_event_commands" else "|")
             for name in [*H.EVIDENCE, H.PATH_EVIDENCE]}
    return alerts.withColumns({**texts, "combined_reason_summary": F.array_join("combined_reason_summary", "|")})
