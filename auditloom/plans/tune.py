"""Training, calibration and evaluation as one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom import schema as S
from auditloom.operators import evaluation as E
from auditloom.operators import fusion as G
from auditloom.operators.iforest import IForestModel, fit_iforest
from auditloom.operators.seqmodel import SequenceModel, fit_sequence_classifier, group_split, score_sequences
from auditloom.operators.sequences import build_sequences, with_tie
from auditloom.operators.windows import build_window_features
from auditloom.plans.scan import ScanParameters
from auditloom.session import materialise


@dataclass(frozen=True)
class Tuned:
    forest: IForestModel
    model: SequenceModel
    vocab: DataFrame
    calibration: DataFrame       # thresholds from held-out benign windows
    calibrated: DataFrame        # the same thresholds on labelled windows
    window_sweep: DataFrame
    sequence_scores: DataFrame   # validation sequences with probabilities
    sequence_metrics: DataFrame
    sequence_sweep: DataFrame
    decisions: DataFrame         # validation sequences with all detector decisions
    detectors: DataFrame
    combined_sweep: DataFrame


def tune(baseline: DataFrame, holdout: DataFrame, labelled: DataFrame,
         parameters: ScanParameters | None = None, trees: int = 300, top: int = 50, vocab_size: int = 256,
         min_malicious: int = 5, validation_share: float = 0.25, seed: int = 42,
         segment: str = "attack_run_id", tie: str | None = None, **limits: int) -> Tuned:
    """Fit both detectors, choose thresholds on benign data and measure them on labels.

    Every step keeps to one host: sequences, the windows they overlap and the
    scaling of window scores are taken per ``source``. ``tie`` names the column
    with the input order of events; without it a hash of the row settles ties.
    ``baseline`` and ``holdout`` are benign events, ``labelled`` reviewed ones.
    Feature tables are written once because every later step reads them again.
    """
    p = parameters or ScanParameters()
    train, schema = build_window_features(baseline, p.window_us, top=top)
    train = materialise(train, "train-windows")
    forest = fit_iforest(train, trees=trees, seed=seed, schema=schema, **limits)

    def scored_windows(events: DataFrame, name: str) -> DataFrame:
        return materialise(forest.transform(
            build_window_features(events, p.window_us, schema)[0], p.iforest_threshold), name)

    held, marked = scored_windows(holdout, "holdout-windows"), scored_windows(labelled, "labelled-windows")
    calibration = E.calibrate(held, **limits)
    frame = E.window_eval_frame(marked)

    ordered, tie = with_tie(labelled, tie)
    sequences, vocab = build_sequences(ordered, length=p.sequence_length, stride=p.stride, segment=segment,
                                       min_malicious=min_malicious, vocab_size=vocab_size, tie=tie, hosts=["source"], **limits)
    vocab = materialise(vocab, "vocab")
    sequences = materialise(sequences, "sequences")
    split = group_split(sequences, share=validation_share, seed=seed, **limits)
    threshold = S.SEQUENCE_THRESHOLD if p.lstm_threshold is None else p.lstm_threshold
    model = fit_sequence_classifier(split.where(~F.col("is_validation")), threshold)
    scores = score_sequences(split.where("is_validation"), model).drop("x_cat", "x_num", "is_validation")
    scores = materialise(E.sequence_eval_frame(scores), "validation")

    fused = G.overlap_scores(scores, marked, "sequence", p.iforest_threshold, by=["source"], norm_by=["source"], lists=False)
    decided = materialise(E.mark_all(G.decisions(fused, threshold, p.combined_threshold, p.lstm_weight)), "decisions")
    return Tuned(
        forest, model, vocab, calibration, E.evaluate_thresholds(calibration, frame),
        E.threshold_sweep(frame, "iforest_anomaly_score", **limits), scores,
        E.binary_metrics(scores, threshold=threshold, **limits),
        E.threshold_sweep(scores, "lstm_malicious_probability", **limits),
        decided, E.compare_detectors(decided), E.threshold_sweep(decided, "combined_score", **limits))
