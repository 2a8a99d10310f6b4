"""Error rates, error types and confusion of hypotheses against references.

Inputs hold ``ref`` and ``hyp`` as token arrays. An empty reference is an error unless ``on_empty='skip'``; null
sequences give no row; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from utterlake.errors import EmptyReference
from utterlake.functions.arrays import keep_labels
from utterlake.functions.distance import alignment, token_distance


def with_error_rate(pairs: DataFrame, on_empty: str = "error") -> DataFrame:
    """``pairs`` with ``distance`` and ``error_rate`` (a fraction of the reference's length)."""
    rows = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").withColumn("distance", token_distance(F.col("ref"), F.col("hyp")))
    if on_empty == "skip":
        rows = rows.where(F.size("ref") > 0)
    empty = F.raise_error(F.lit("the reference is empty")).cast("double")
    return rows.withColumn("error_rate", F.when(F.size("ref") == 0, empty).otherwise(F.col("distance") / F.size("ref")))


def require_references(pairs: DataFrame) -> DataFrame:
    """``pairs``; an empty reference is an error that names its rows."""
    bad = [r[0] for r in pairs.where(F.size("ref") == 0).select(pairs.columns[0]).limit(5).collect()]
    if bad:
        raise EmptyReference(f"empty references: {bad}")
    return pairs


def mean_error_rate(pairs: DataFrame, on_empty: str = "error") -> DataFrame:
    """Macro mean over utterances: ``error_rate, n``."""
    return with_error_rate(pairs, on_empty).agg(F.avg("error_rate").alias("error_rate"), F.count("*").alias("n"))


def filtered_error_rate(pairs: DataFrame, labels: Column | None, on_empty: str = "error") -> DataFrame:
    """``mean_error_rate`` over the tokens in ``labels`` alone; -1 if there is no row at all."""
    rows = pairs.withColumn("ref", keep_labels(F.col("ref"), labels)).withColumn("hyp", keep_labels(F.col("hyp"), labels))
    return mean_error_rate(rows, on_empty).select(F.coalesce("error_rate", F.lit(-1.0)).alias("error_rate"), "n")


def error_rate_by_speaker(pairs: DataFrame, speakers: DataFrame) -> DataFrame:
    """``speaker, error_rate, n`` of utterances whose prefix has a speaker; with the mean weighted by n over all."""
    rates = with_error_rate(pairs, "skip").select("prefix", "error_rate").join(speakers.select("prefix", "speaker"), "prefix")
    by = rates.groupBy("speaker").agg(F.avg("error_rate").alias("error_rate"), F.count("*").alias("n"))
    whole = by.agg((F.sum(F.col("error_rate") * F.col("n")) / F.sum("n")).alias("all_error_rate"))
    return by.join(F.broadcast(whole))


def arrow_counts(pairs: DataFrame) -> DataFrame:
    """``ref, hyp, count`` of all aligned pairs of labels; the empty string is a gap."""
    arrows = pairs.where("ref IS NOT NULL AND hyp IS NOT NULL").select(F.explode(alignment("ref", "hyp")).alias("a"))
    return arrows.groupBy(F.col("a.ref").alias("ref"), F.col("a.hyp").alias("hyp")).agg(F.count("*").alias("count"))


def error_types(arrows: DataFrame) -> DataFrame:
    """One row: ``substitutions, deletions, insertions, matches``."""
    gap, wrong = F.lit(""), F.col("ref") != F.col("hyp")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0)).cast("bigint")
    return arrows.agg(
        total(wrong & (F.col("ref") != gap) & (F.col("hyp") != gap)).alias("substitutions"),
        total(wrong & (F.col("hyp") == gap)).alias("deletions"),
        total(wrong & (F.col("ref") == gap)).alias("insertions"),
        total(~wrong).alias("matches"),
    )


def deletions_by_label(arrows: DataFrame) -> DataFrame:
    """``label, count`` of deleted labels, commonest first."""
    return arrows.where("hyp = '' AND ref <> ''").groupBy(F.col("ref").alias("label")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "label")


def top_labels(arrows: DataFrame, width: int = 25) -> DataFrame:
    """The ``width`` commonest reference labels (a top-k report), ties in code point order."""
    return arrows.where("ref <> ''").groupBy(F.col("ref").alias("label")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "label").limit(width)


def confusion(arrows: DataFrame, width: int = 25) -> DataFrame:
    """``ref, hyp, count`` for all pairs of the commonest labels, zeros included."""
    kept = F.broadcast(top_labels(arrows, width).select("label"))
    axis = kept.select(F.col("label").alias("ref")).join(kept.select(F.col("label").alias("hyp")))  # width x width cells
    return axis.join(arrows, ["ref", "hyp"], "left").select("ref", "hyp", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def join_by_line(hyps: DataFrame, refs: DataFrame) -> DataFrame:
    """Hypotheses and references of the same line: ``line_no, ref, hyp``."""
    return refs.select("line_no", F.col("tokens").alias("ref")).join(hyps.select("line_no", F.col("tokens").alias("hyp")), "line_no")
