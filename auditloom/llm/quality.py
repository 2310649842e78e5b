"""Quality rules whose cutoffs carry an exact bound on false rejection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.texts import shield
from auditloom.operators.small import attach_row, checked
from auditloom.session import materialise

BLANK = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
REPEAT_WORDS = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30

# A rule rejects values above its cutoff; the candidate cutoffs are fixed before any label is seen.
GRIDS = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0, 1.5, 2.0, 2.5],
    "upper_rate": [0.05, 0.08, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8],
    "mark_rate": [0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.65, 0.8, 1.0, 1.5],
    "dup_line_rate": [0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.5, 0.6, 0.7, 0.8],
    "repeat_rate": [0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.18, 0.2, 0.22, 0.25, 0.28],
    "same_word_rate": [0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9],
}
MAX_FALSE_REJECTION = 0.03
MISTAKE = 0.05
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _pairs(array: str, gap: int) -> Column:
    """Hashes of each element with the one ``gap`` places on."""
    size = F.greatest(F.size(array) - gap, F.lit(0))
    return F.zip_with(F.slice(array, F.lit(1), size), F.slice(array, F.lit(gap + 1), size), lambda a, b: F.xxhash64(a, b))


def with_features(docs: DataFrame, prefix: str = "__") -> DataFrame:
    """``docs`` with counts and rates of each whole text, in columns that begin with ``prefix``.

    Windows of eight words are hashed by doubling (pairs, fours, eights), so a
    word is touched a fixed number of times. Only texts with a repeated window
    sort their windows to count the words inside.
    """
    p = prefix
    text = F.coalesce("text", F.lit(""))
    at = docs.withColumn(f"{p}words", F.array_remove(F.split(text, BLANK), ""))
    at = at.withColumns({
        f"{p}lines": F.filter(F.split(text, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]")),
        f"{p}ones": F.transform(f"{p}words", lambda w: F.xxhash64(w)),
    })
    at = at.withColumn(f"{p}twos", _pairs(f"{p}ones", 1))
    at = at.withColumn(f"{p}fours", _pairs(f"{p}twos", 2))
    at = at.withColumn(f"{p}eights", _pairs(f"{p}fours", 4))
    ranked = F.array_sort(F.transform(f"{p}eights", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    at = at.withColumn(f"{p}ranked", F.when(F.size(F.array_distinct(f"{p}eights")) < F.size(f"{p}eights"), ranked))
    same = F.zip_with(
        F.slice(f"{p}ranked", F.lit(1), F.size(f"{p}ranked") - 1), F.slice(f"{p}ranked", F.lit(2), F.size(f"{p}ranked") - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    at = at.withColumn(f"{p}found", F.when(F.col(f"{p}ranked").isNotNull(), F.array_sort(F.array_distinct(F.flatten(F.array_compact(same))))))
    steps = F.zip_with(
        F.slice(f"{p}found", F.lit(1), F.size(f"{p}found") - 1), F.slice(f"{p}found", F.lit(2), F.size(f"{p}found") - 1),
        lambda a, b: F.least(b - a, F.lit(REPEAT_WORDS)))
    covered = F.aggregate(steps, F.lit(REPEAT_WORDS), lambda s, x: s + x)

    def gone(chars: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")

    at = at.withColumns({
        f"{p}n_words": F.size(f"{p}words").cast("long"),
        f"{p}word_chars": F.length(F.concat_ws("", f"{p}words")).cast("long"),
        f"{p}n_symbols": gone(SYMBOLS),
        f"{p}n_upper": gone(UPPER),
        f"{p}n_marks": gone("!"),
        f"{p}n_lines": F.size(f"{p}lines").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}lines") - F.size(F.array_distinct(f"{p}lines"))).cast("long"),
        f"{p}n_repeat_words": F.when(F.col(f"{p}found").isNotNull(), covered).otherwise(0).cast("long"),
        f"{p}n_distinct": F.size(F.array_distinct(f"{p}ones")).cast("long"),
    }).drop(*[p + x for x in ("words", "lines", "ones", "twos", "fours", "eights", "ranked", "found")])

    def rate(top, bottom) -> Column:
        return F.coalesce(F.try_divide(top, bottom), F.lit(0.0))

    words, chars = F.col(f"{p}n_words"), F.col(f"{p}word_chars")
    # in longer texts common words recur, so distinct words are held against the square root of the count as well
    return at.withColumns({
        f"{p}symbol_rate": rate(F.col(f"{p}n_symbols"), words),
        f"{p}upper_rate": rate(F.col(f"{p}n_upper"), chars),
        f"{p}mark_rate": rate(F.col(f"{p}n_marks"), words),
        f"{p}dup_line_rate": rate(F.col(f"{p}n_dup_lines"), F.col(f"{p}n_lines")),
        f"{p}repeat_rate": rate(F.col(f"{p}n_repeat_words"), words),
        f"{p}same_word_rate": 1 - F.least(F.lit(1.0), rate(F.col(f"{p}n_distinct"), F.least(words.cast("double"), 10 * F.sqrt(words)))),
        f"{p}base_failed": (words < MIN_WORDS) | (100 * F.col(f"{p}n_repeat_words") > MAX_REPEAT_PERCENT * words),
        f"{p}stratum": F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit(""),
    })


def binomial_tail(k: Column, n: Column, p: float) -> Column:
    """``P(X <= k)`` for a binomial X of ``n`` trials with probability ``p``, summed in logarithms.

    Exact up to rounding. Where ``k`` is not below the mean the tail is no
    small number, and 1 is returned without summing.
    """
    zero = F.struct((n * F.log(F.lit(1 - p))).alias("term"), (n * F.log(F.lit(1 - p))).alias("total"))

    def step(state, i):
        term = state["term"] + F.log((n - i + 1) / i) + F.log(F.lit(p / (1 - p)))
        high, low = F.greatest(state["total"], term), F.least(state["total"], term)
        return F.struct(term.alias("term"), (high + F.log1p(F.exp(low - high))).alias("total"))

    summed = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k.cast("int"))).otherwise(F.array().cast("array<int>")), zero, step, lambda s: F.exp(s["total"]))
    return F.when(k < n * p, summed).otherwise(F.lit(1.0))


def fit_cutoffs(labelled: DataFrame, prefix: str = "__", max_false_rejection: float = MAX_FALSE_REJECTION, mistake: float = MISTAKE) -> DataFrame:
    """``(stratum, rule, cutoff)`` of the rules that the labels certify.

    ``labelled`` has the features of all labelled documents and ``good``. For
    each stratum, rule and candidate cutoff the good documents above the cutoff
    are counted. The cutoff is certified if, were its true rate of false
    rejection above ``max_false_rejection`` divided by the rules, so few would
    occur with a probability of at most ``mistake`` divided by all tests
    (Bonferroni over strata, rules and candidates). So with probability
    ``1 - mistake`` no stratum loses more than ``max_false_rejection`` of its
    good documents to all its rules together. A certified cutoff must also reject
    a hundred bad documents for each good one; of those, the most lenient one
    stays that still rejects 99 % of the bad documents which the strictest
    rejects. A stratum with too few labels gets no cutoff: it loses
    nothing.
    """
    rules = list(GRIDS)

    def passed(rule: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(g) for g in GRIDS[rule]]), lambda cutoff: F.col(prefix + rule) > cutoff))

    value = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), passed(r).alias("passed")) for r in rules])).alias("v")
    counted = labelled.select(F.col(f"{prefix}stratum").alias("stratum"), "good", value).groupBy("stratum", "v.rule", "v.passed").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    above = Window.partitionBy("stratum", "rule").orderBy(F.desc("passed")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("stratum", "rule")
    ranked = counted.withColumns({
        "good_above": F.sum("good").over(above), "bad_above": F.sum("bad").over(above), "all_good": F.sum("good").over(whole),
    }).where("passed > 0")
    grids = F.create_map(*[x for r in rules for x in (F.lit(r), F.array(*[F.lit(g) for g in GRIDS[r]]))])
    ranked = ranked.withColumn("cutoff", F.element_at(grids[F.col("rule")], F.col("passed")))
    ranked = attach_row(ranked, labelled.agg(F.count_distinct(f"{prefix}stratum").alias("strata")))
    tests = sum(map(len, GRIDS.values())) * F.greatest(F.lit(1), F.col("strata"))
    tail = binomial_tail(F.col("good_above"), F.col("all_good"), max_false_rejection / len(rules))
    certified = ranked.where(tail <= mistake / tests)
    best = F.max("bad_above").over(whole)
    useful = certified.where("bad_above > 0 AND 100 * good_above <= bad_above")
    kept = useful.withColumn("best", best).where("bad_above >= 0.99 * best")
    return kept.groupBy("stratum", "rule").agg(F.max("cutoff").alias("cutoff"))


def _cutoffs(features: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per stratum: ``stratum`` and a map from rule to cutoff, as a written table.

    Documents that fail the base rules anyway do not count. A document labelled
    more than once counts as good only if all its labels say so.
    """
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") >= 1).alias("good"))
    labelled = features.where("NOT __base_failed").join(marks, F.col("doc_id") == F.col("__id"))
    fitted = fit_cutoffs(labelled).groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs"))
    return materialise(fitted, "quality-cutoffs")


def _verdict(features: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Features with ``__kept``; the cutoffs are one row per stratum."""
    joined = features.join(cutoffs.withColumnsRenamed({"stratum": "__s", "cutoffs": "__cutoffs"}), F.col("__stratum") == F.col("__s"), "left")
    failed = [F.col("__base_failed")] + [F.coalesce(F.col(f"__{rule}") > F.col("__cutoffs")[rule], F.lit(False)) for rule in GRIDS]
    # one predicate over both sides: a filter on it stays above the features, which are then computed once
    return joined.withColumn("__kept", F.greatest(*[f.cast("int") for f in failed]) == 0).drop("__s", "__cutoffs")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: counts, rates, ``base_failed`` and ``kept``.

    Null and empty texts have no words and fail the base rule. A null ``lang`` is
    a stratum of its own. Repeated rows are judged one by one, ties with a cutoff
    are kept, other columns are ignored. Without labels only the base rules
    reject; an empty table gives no rows.
    """
    features = materialise(with_features(docs.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns])).drop("text"), "quality-features")
    judged = _verdict(features, _cutoffs(features, labels))
    return judged.select("doc_id", *[F.col(f"__{c}").alias(c) for c in COUNTS], *[F.col(f"__{r}").alias(r) for r in GRIDS],
                         F.col("__base_failed").alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their own columns.

    The features are computed once and written without texts; the cutoffs are
    fitted from that table, and the rows that fail are taken out by their id, the
    hash of their text and their stratum, from a broadcast of checked size or by a
    shuffle. Null and empty texts fail the base rule; a null ``lang`` is a stratum
    of its own; repeated rows stay or go together, ties with a cutoff stay; extra
    columns of any name pass through; without labels only the base rules reject;
    an empty table gives no rows.
    """
    rows = shield(docs)
    own = F.xxhash64(F.coalesce("text", F.lit(""))).alias("__own")
    features = with_features(rows.select("doc_id", "text", *[c for c in ("lang",) if c in docs.columns]))
    features = materialise(features.select("*", own).drop("text"), "quality-features")
    failed = _verdict(features, _cutoffs(features, labels)).where("NOT __kept")
    failed, small = checked(failed.select(F.col("doc_id").alias("__id"), F.col("__own").alias("__hash"), F.col("__stratum").alias("__lang")).distinct())
    stratum = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    met = F.col("doc_id").eqNullSafe(F.col("__id")) & (own == F.col("__hash")) & (stratum == F.col("__lang"))
    return rows.join(F.broadcast(failed) if small else failed, met, "left_anti").toDF(*docs.columns)
