"""Filters, deduplication and durations of utterance tables.

Order is semantic in this domain; ``seq`` holds it. Null text never passes a filter on text; an empty table stays
empty; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.functions.text import is_blank

WORDS = r"([\p{L}\p{M}\p{N}'’-]+)"


def remove_duplicates(df: DataFrame, order: str = "seq", keys: Sequence[str] = ("start_time", "end_time", "text")) -> DataFrame:
    """The first row in ``order`` of each (start_time, end_time, text), whatever medium, prefix or speaker.

    Whole rows are combined map-side before the shuffle, so a much repeated row does not gather in one task. Nulls count
    as equal; of rows that tie in order too, the least remains.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    kept = df.groupBy(*keys).agg(F.min(F.struct(F.col(order), *[F.col(c) for c in rest])).alias("__row"))
    return kept.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def remove_blank_text(df: DataFrame, text: str = "text") -> DataFrame:
    return df.where(~is_blank(F.col(text)))


def remove_too_short(df: DataFrame, step_ms: int = 10) -> DataFrame:
    """Rows whose duration has at least one step for each code point of the text."""
    return df.where((F.col("end_time") - F.col("start_time")) / F.lit(float(step_ms)) >= F.length("text"))


def remove_blank_or_short(df: DataFrame, step_ms: int = 10) -> DataFrame:
    """``remove_blank_text`` and ``remove_too_short`` in one predicate.

    A lambda binds the text once: pushed below a projection, two filters would compute a segmented text twice.
    """
    span = (F.col("end_time") - F.col("start_time")) / F.lit(float(step_ms))
    return df.where(F.exists(F.array("text"), lambda t: (span >= F.length(t)) & ~is_blank(t)))


def shorter_than(df: DataFrame, most_ms: int = 10_000) -> DataFrame:
    return df.where(F.col("end_time") - F.col("start_time") < most_ms)


def of_speakers(df: DataFrame, speakers: Sequence[str] | None) -> DataFrame:
    """Rows of the named speakers; no names keep all."""
    return df.where(F.col("speaker").isin(*speakers)) if speakers else df


def of_tiers(df: DataFrame, tier_prefixes: Sequence[str], tier: str = "tier") -> DataFrame:
    """Rows whose tier name starts with one of the prefixes; each row once."""
    hit = F.lit(False)
    for p in tier_prefixes:
        hit = hit | F.col(tier).startswith(p)
    return df.where(hit)


def lower_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORDS), F.lit(1))


def not_code_switched(df: DataFrame, words: DataFrame, key: str = "seq", word: str = "word") -> DataFrame:
    """Rows in which no word stands in ``words``, by a left anti join, so that a list of any size will do."""
    listed = words.where(F.col(word).isNotNull()).select(F.lower(F.trim(word)).alias("__word")).distinct()
    hits = df.where("text IS NOT NULL").select(F.col(key).alias("__key"), F.explode(F.array_distinct(lower_words(F.col("text")))).alias("__word"))
    hits = hits.join(listed, "__word").select("__key").distinct()
    return df.where("text IS NOT NULL").join(hits, F.col(key) == F.col("__key"), "left_anti")


def code_switch_report(df: DataFrame, words: DataFrame, key: str = "seq") -> DataFrame:
    """First listed word of each row that holds one: ``seq, word``."""
    listed = words.select(F.lower(F.trim("word")).alias("w")).distinct()
    hits = df.where("text IS NOT NULL").select(F.col(key).alias("seq"), F.posexplode(lower_words(F.col("text"))).alias("pos", "w")).join(listed, "w")
    return hits.groupBy("seq").agg(F.min_by("w", "pos").alias("word"))


def code_switch_totals(rows: DataFrame, words: DataFrame) -> DataFrame:
    """One row: ``utterances`` with a text, and how many of them are ``code_switched``."""
    switched = code_switch_report(rows, words).agg(F.count("*").alias("code_switched"))
    whole = rows.where("text IS NOT NULL").agg(F.count("*").alias("utterances"))
    return whole.join(F.broadcast(switched))  # one row each


def word_list(words: DataFrame, exceptions: Sequence[str] = (), additions: Sequence[str] = ()) -> DataFrame:
    """A word list in lower case, without the exceptions (words of the target language) and with additions."""
    spark = words.sparkSession
    kept = words.select(F.lower(F.trim("word")).alias("word")).where("word <> ''").distinct()
    if exceptions:
        kept = kept.where(~F.col("word").isin(*exceptions))
    if additions:
        kept = kept.unionByName(spark.createDataFrame([(a,) for a in additions], "word string")).distinct()
    return kept


def with_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_ms", F.col("end_time") - F.col("start_time"))


def total_duration(df: DataFrame) -> DataFrame:
    """One row; 0 for an empty table."""
    return df.agg(F.coalesce(F.sum(F.col("end_time") - F.col("start_time")), F.lit(0)).cast("bigint").alias("total_ms"))


def speaker_durations(df: DataFrame, order: str = "seq") -> DataFrame:
    """``speaker, duration_ms, first_seq``: a null speaker is one speaker; ``first_seq`` gives first-seen order."""
    span = F.col("end_time") - F.col("start_time")
    return df.groupBy("speaker").agg(F.sum(span).cast("bigint").alias("duration_ms"), F.min(order).alias("first_seq"), F.count("*").alias("n"))


def speaker_rows(df: DataFrame, order: str = "seq") -> DataFrame:
    """Rows with their position among those of their speaker.

    Positions instead of one list per speaker: a speaker of a third of all rows would not fit in a row. Positions come
    from counts of blocks of ``order`` and places inside them, so no task sees more than a block of one speaker.
    """
    block = F.floor(F.col(order) / 100_000)
    counts = df.groupBy("speaker", block.alias("__block")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy("speaker").orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select(F.col("speaker").alias("__speaker"), F.col("__block").alias("__at"), F.coalesce(before, F.lit(0)).alias("__before"))
    rows = df.withColumn("__block", block).withColumn("__nth", F.row_number().over(W.partitionBy("speaker", "__block").orderBy(order)))
    rows = rows.join(counts, F.col("speaker").eqNullSafe(F.col("__speaker")) & F.col("__block").eqNullSafe(F.col("__at")))
    return rows.select(*df.columns, (F.col("__before") + F.col("__nth")).alias("speaker_pos"))
