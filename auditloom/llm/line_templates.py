"""Line dedup with a tree of line templates of fixed depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.texts import among, shield
from auditloom.operators.small import checked
from auditloom.session import materialise

# a token with a digit, from its first character on; every step forward is final
NUMBERED = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9]*+[0-9][^\x20\x09-\x0D]*+"
DEPTH = 3
MIN_TOKENS = 3
MIN_TEXTS = 10
SHORT_TEXTS = 100
LONG_TOKENS = 8
WORD_CHARS = 6
SIMILARITY = 0.6
CLOSE = 0.8
VARIABLE = "<*>"


def _tokens(line: Column) -> Column:
    """Tokens of a line; those with a digit are one variable field."""
    masked = F.when(line.rlike("[0-9]"), F.regexp_replace(line, NUMBERED, VARIABLE)).otherwise(line)
    for blank in "\t\x0b\x0c\r":
        masked = F.replace(masked, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(masked, " "), "")


def _leaf(depth: int) -> Column:
    return F.xxhash64(F.size("tokens"), F.slice("tokens", 1, depth))


def _weight(tokens: Column) -> Column:
    """Fixed tokens, or the words that their characters make up in a script without blanks."""
    fixed = F.array_remove(tokens, VARIABLE)
    return F.greatest(F.size(fixed), F.floor(F.length(F.array_join(fixed, "")) / WORD_CHARS).cast("int"))


def needed(size: Column, weight: Column, min_texts: int) -> Column:
    """Texts that must share a template: two for a long one, more where chance repeats are real."""
    few = F.when(weight >= LONG_TOKENS, min(2, min_texts)).when(weight * 2 > LONG_TOKENS, max(min_texts * 2 // 5, min(2, min_texts)))
    short = F.when(size < MIN_TOKENS, max(SHORT_TEXTS, min_texts)).otherwise(min_texts)
    return F.coalesce(F.when(weight >= SIMILARITY * size, few), short)


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def line_table(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """One narrow row per line with a fixed token, without its text; written once.

    ``leaf`` is the line's place in the tree: its number of tokens and its first
    ``depth`` tokens. ``template`` stands for all its tokens, ``size`` is their
    number and ``weight`` the number of those that are fixed. Lines of variable
    tokens alone count from ``MIN_TOKENS`` tokens on. ``line_hash`` finds the line
    again without splitting others.
    """
    lines = _lines(docs).select("doc_id", "text_hash", "pos", F.xxhash64("line").alias("line_hash"), _tokens(F.col("line")).alias("tokens"))
    lines = lines.select(
        "doc_id", "text_hash", "pos", "line_hash", _leaf(depth).alias("leaf"), F.xxhash64("tokens").alias("template"),
        F.size("tokens").alias("size"), _weight(F.col("tokens")).alias("weight"))
    # a filter before the table is written would split every line twice
    return materialise(lines, "line-table").where((F.col("weight") > 0) | (F.col("size") >= MIN_TOKENS))


def token_fields(docs: DataFrame, lines: DataFrame, wanted: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``(leaf, template, fields)`` of the templates in ``wanted`` leaves: a hash of every token after the first ones.

    Lines of other leaves go before any shuffle and before they are split. Those
    that pass by chance belong to no wanted leaf and end with the next join.
    """
    known = among(lines, "leaf", wanted).select("line_hash")
    text = among(_lines(docs).select("line", F.xxhash64("line").alias("line_hash")), "line_hash", known)
    split = text.select(_tokens(F.col("line")).alias("tokens")).withColumn("leaf", _leaf(depth)).where(F.size("tokens") > depth)
    fields = F.transform(F.slice("tokens", depth + 1, F.greatest(F.size("tokens") - depth, F.lit(1))), lambda t: F.hash(t))
    return split.select("leaf", F.xxhash64("tokens").alias("template"), fields.alias("fields")).groupBy("leaf", "template").agg(F.any_value("fields").alias("fields"))


def recurring(docs: DataFrame, lines: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY) -> DataFrame:
    """``(leaf, template, first_id, group)`` of the templates that enough different texts share.

    Copies of one text count once. A template recurs by itself, or as part of its
    leaf: a token of a leaf is fixed if more than half of the leaf's texts agree
    in it and variable otherwise. The templates that agree in ``similarity`` of
    all tokens after the first ones with the fixed ones count together if
    ``min_texts`` texts have them, those that agree in ``CLOSE`` also if fewer
    do. ``group`` is what counts together, ``first_id`` the least document of it.
    """
    per_text = lines.groupBy("leaf", "template", "text_hash").agg(F.min("doc_id").alias("doc_id"), F.any_value("size").alias("size"), F.any_value("weight").alias("weight"))
    counted = per_text.groupBy("leaf", "template").agg(
        F.count("*").alias("texts"), F.min("doc_id").alias("first_id"), F.min("size").alias("size"), F.min("weight").alias("weight"))
    counted = materialise(counted, "line-templates")
    least = needed(F.col("size"), F.col("weight"), min_texts)
    own = counted.where(F.col("texts") >= least).select("leaf", "template", "first_id", F.col("template").alias("group"))
    leaves = counted.where(F.col("size") > DEPTH).groupBy("leaf").agg(
        F.sum("texts").alias("all"), F.count("*").alias("kinds"), F.max("size").alias("size"), F.max("weight").alias("weight"))
    # as many texts as the longest of the leaf's templates needs
    leaves = materialise(leaves.where((F.col("all") >= least) & (F.col("kinds") > 1)).select("leaf", "all"), "line-leaves")
    fields = materialise(token_fields(docs, lines, leaves), "line-fields")
    crowded = counted.join(fields.withColumnsRenamed({"leaf": "__leaf", "template": "__template"}), (F.col("leaf") == F.col("__leaf")) & (F.col("template") == F.col("__template")))
    crowded = materialise(crowded.drop("__leaf", "__template").join(leaves, "leaf"), "line-crowded")
    votes = crowded.select("leaf", "all", "texts", F.posexplode("fields").alias("at", "value")).groupBy("leaf", "all", "at", "value").agg(F.sum("texts").alias("n"))
    fixed = votes.where(F.col("n") * 2 > F.col("all")).groupBy("leaf").agg(F.map_from_entries(F.collect_list(F.struct("at", "value"))).alias("fixed"))
    agreed = F.aggregate(
        F.transform("fields", lambda value, at: F.when(F.col("fixed")[at] == value, 1).otherwise(0)), F.lit(0), lambda a, b: a + b)
    share = F.col("agreed") / F.size("fields")
    close = crowded.join(fixed, "leaf").withColumn("agreed", agreed).where(share >= similarity)
    close = close.select("leaf", "template", "texts", "first_id", "size", "weight", (share >= CLOSE).alias("near"))
    totals = close.groupBy("leaf").agg(
        F.sum("texts").alias("together"), F.min("first_id").alias("first"), F.sum(F.when(F.col("near"), F.col("texts"))).alias("together_near"),
        F.min(F.when(F.col("near"), F.col("first_id"))).alias("first_near"), F.min("size").alias("size"), F.min(F.when(F.col("near"), F.col("weight"))).alias("weight"))
    # of a template's tokens at least this part is fixed in the group
    certain = F.floor(F.col("weight") * CLOSE).cast("int")
    wide = F.col("together") >= min_texts
    totals = totals.where(wide | (F.col("together_near") >= needed(F.col("size"), certain, min_texts)))
    totals = totals.select("leaf", wide.alias("wide"), F.when(wide, F.col("first")).otherwise(F.col("first_near")).alias("first"))
    grouped = close.select("leaf", "template", "near").join(totals, "leaf").where("wide OR near").select("leaf", "template", F.col("first").alias("first_id"), F.col("leaf").alias("group"))
    both = own.unionByName(grouped)
    return both.groupBy("leaf", "template").agg(F.min("first_id").alias("first_id"), F.max("group").alias("group"))


def drops(docs: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY, keep_first: bool = True) -> DataFrame:
    """``(doc_id, text_hash, dropped)``: the numbers of the lines to drop, for documents that lose any.

    With ``keep_first`` the document with the least id keeps a template, so that
    no content is lost to the corpus.
    """
    lines = line_table(docs)
    # written apart from the join, so that the rows of one common line can be split
    found = materialise(recurring(docs, lines, min_texts, similarity), "line-recurring").withColumnsRenamed({"leaf": "__leaf", "template": "__template"})
    found, small = checked(found)
    hit = lines.join(F.broadcast(found) if small else found, (F.col("leaf") == F.col("__leaf")) & (F.col("template") == F.col("__template")))
    if keep_first:
        hit = hit.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    return hit.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set("pos")).alias("dropped"))


def drop_lines(docs: DataFrame, min_texts: int = MIN_TEXTS, similarity: float = SIMILARITY, keep_first: bool = True) -> DataFrame:
    """``docs`` with all columns; recurring lines are cut out of ``text``.

    A line recurs if enough different texts have its template: two where eight or
    more of its tokens are fixed and few variable, ``min_texts`` where five are
    not, something between for those in the middle, and ``SHORT_TEXTS`` for lines
    of one or two short tokens. Tokens with a digit and tokens that vary within a
    leaf of the tree are variable. Blank lines stay, and one or two tokens with
    digits alone. A document that loses no line
    comes back unchanged; one that loses all has an empty text. Null text stays
    null. Repeated rows are treated alike, ties in ``doc_id`` too; rows with null
    ``doc_id`` take part. Extra columns pass through; empty tables give no rows.
    """
    gone = drops(docs, min_texts, similarity, keep_first)
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), F.col("dropped").alias("__dropped"))
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = shield(docs)
    joined = rows.withColumn("__own", own).join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("__dropped", at)), "\n")
    return joined.withColumn("text", F.when(F.col("__dropped").isNull(), F.col("text")).otherwise(left)).select(*rows.columns).toDF(*docs.columns)


def report(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, those dropped, and the text that stays."""
    gone = drops(docs).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), "dropped")
    text = F.coalesce("text", F.lit(""))
    own = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("__own"))
    joined = own.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__hash")), "left")
    kept = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(
        F.array_join(F.filter(F.split("text", "\n"), lambda line, at: ~F.array_contains("dropped", at)), "\n"))
    return joined.select(
        "doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"),
        F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(F.coalesce("dropped", F.array().cast("array<int>")), ",").alias("dropped_lines"), F.sha2(kept, 256).alias("kept_sha256"))
