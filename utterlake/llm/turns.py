"""Transcripts into clean speaker turns.

Fields come out of the text with SQL expressions, speakers may be filled forward by windows, marked noise is removed
and consecutive rows of one person become a turn by gaps-and-islands identifiers. Runs form inside time shards of a
transcription first; only the first and the last run of each shard meet per transcription.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.llm.clutter import says_speech, tidy, without_annotations, without_hesitation, without_times, written_front
from utterlake.llm.unify import fold_lookalikes
from utterlake.session import materialize

#: Length of a time shard; numbers of seq that share a shard where the start is null; copies of the persons in joins.
SHARD_MS, UNTIMED, SALT = 600_000, 4096, 16
NOBODY = "unknown"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}']+"), lambda t: t != "")


def speaker_index(speakers: DataFrame) -> DataFrame:
    """``key`` (surname, or code without punctuation, in lower case), ``code``, ``firsts`` (other parts of the name; null for a code)."""
    names = speakers.where("speaker_code IS NOT NULL").select(F.col("speaker_code").alias("code"), _tokens(fold_lookalikes(F.col("full_name"))).alias("t"))
    surnames = names.where(F.size("t") > 1).select(F.element_at("t", -1).alias("key"), "code", F.slice("t", 1, F.size("t") - 1).alias("firsts"))
    return names.select(F.array_join(_tokens(F.col("code")), "").alias("key"), "code", F.lit(None).cast("array<string>").alias("firsts")).unionByName(surnames)


def label_persons(labels: DataFrame, speakers: DataFrame) -> DataFrame:
    """``label``, ``code`` for each distinct ``label`` that names exactly one person of ``speakers``.

    A label names a person by code or by surname, alone or with first names or their initials, in any order, case or
    punctuation; what follows in brackets does not count. Nulls, roles and placeholders give no row.
    """
    plain = F.regexp_replace(F.regexp_replace(F.lower(fold_lookalikes(F.col("label"))), r"(?<=\S)\s*[\[(].*$", ""), r"^\s*(?:spk|speaker)\s*:", "")
    asked = labels.where("label IS NOT NULL").select("label").distinct().select("label", _tokens(plain).alias("tokens"))
    asked = asked.select("label", "tokens", F.explode(F.array_distinct(F.concat("tokens", F.array(F.array_join("tokens", ""))))).alias("key"))
    found = asked.join(speaker_index(speakers), "key")
    rest = F.array_remove("tokens", F.col("key"))
    first = lambda t: F.exists("firsts", lambda f: (t == f) | ((F.length(t) == 1) & f.startswith(t)))
    fits = F.col("firsts").isNull() | F.forall(rest, first)
    return found.where(fits).groupBy("label").agg(F.min("code").alias("code"), F.max("code").alias("other")).where("code = other").select("label", "code")


def _named(rows: DataFrame, column: str, persons: DataFrame, code: str) -> DataFrame:
    """``rows`` with the person that ``column`` names. A label may stand in a third of all rows: its rows are dealt out
    under a salt and the persons, one row for each label, copied; null labels, which name nobody, are dealt out too."""
    salt = F.pmod(F.xxhash64("seq"), F.lit(SALT)).cast("int")
    key = F.coalesce(F.col(column), F.concat(F.lit("\u0000"), F.pmod(F.col("seq"), F.lit(1024)).cast("string")))
    keys = persons.select(F.col("label").alias("__label"), F.col("code").alias(code), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("__salt"))
    return rows.withColumn("__label", key).withColumn("__salt", salt).join(keys, ["__label", "__salt"], "left").drop("__label", "__salt")


def spoken_rows(utterances: DataFrame, speakers: DataFrame, with_text: bool = False) -> DataFrame:
    """Rows in which something is spoken, with their person: ``path, seq, start, end, tid, person[, clean]``.

    ``person`` is the speaker code the label means, else that of the name written in front of the speech, else null.
    Rows of one transcription with equal start, end and text come once, the smallest seq (nulls count as equal).
    """
    rows = utterances.where("text IS NOT NULL AND seq IS NOT NULL").select(
        F.col("org_transcription_path").alias("path"), "seq", F.col("start_time").alias("start"), F.col("end_time").alias("end"),
        F.struct(F.xxhash64("text").alias("h"), F.length("text").alias("n")).alias("tid"), "speaker", fold_lookalikes(F.col("text")).alias("folded"),
    )
    # One projection for each step, so that no step's expression is repeated in the next.
    cut = rows.withColumn("t", without_times(F.col("folded"))).withColumn("front", written_front(F.col("t")))
    cut = cut.withColumn("whole", without_annotations(F.col("t"))).withColumn("rest", without_annotations(F.when(F.col("front") != "", F.expr("substring(t, length(front) + 1)"))))
    cut = cut.withColumn("says", says_speech(F.col("whole"))).withColumn("says_after", F.when(F.col("rest").isNotNull(), says_speech(F.col("rest"))))
    cut = cut.withColumn("written", F.nullif(F.regexp_replace("front", r"^[^\p{L}]+|[^\p{L}\p{N}]+$", ""), F.lit("")))
    if with_text:
        cut = cut.withColumn("clean", tidy(without_hesitation(F.col("whole")))).withColumn("clean_after", tidy(without_hesitation(F.coalesce("rest", "whole"))))
    # The rows are filtered after they are written: below the projections the filter would parse every text twice.
    cut = materialize(cut.drop("folded", "t", "front", "rest", "whole"), "spoken").where("says OR says_after")
    labels = cut.select(F.explode(F.array("speaker", "written")).alias("label"))
    persons = label_persons(labels.where("label IS NOT NULL").distinct(), speakers)
    persons = materialize(persons, "persons")
    cut = _named(_named(cut, "speaker", persons, "c1"), "written", persons, "c2")
    cut = cut.where(F.when(F.col("c2").isNotNull(), F.col("says_after")).otherwise(F.col("says")))
    kept = ["path", "seq", "start", "end", "tid", F.coalesce("c1", "c2").alias("person")]
    if with_text:
        kept.append(F.when(F.col("c2").isNotNull(), F.col("clean_after")).otherwise(F.col("clean")).alias("clean"))
    return cut.select(*kept)


def speaker_turns(utterances: DataFrame, speakers: DataFrame, fill_forward: bool = False, with_text: bool = False, shard_ms: int = SHARD_MS) -> DataFrame:
    """One row per clean turn: ``path, first_seq, last_seq, speaker_code``.

    With ``fill_forward`` a row without a person takes the last person before it in its transcription; without, it
    belongs to ``unknown``. With ``with_text`` a turn comes in parts of at most one time shard, each with ``part``,
    ``start_ms``, ``end_ms`` and the clean ``text`` of its rows in order, so that a turn of any length is never held in
    one place. Null text or seq: no row; null path: a transcription of its own; null start: before all others; ties in
    start: by seq; an empty table gives no rows; other columns are ignored.
    """
    rows = spoken_rows(utterances, speakers, with_text)
    rows = rows.withColumn("copy", F.row_number().over(W.partitionBy("path", "start", "end", "tid").orderBy("seq"))).where("copy = 1")
    # Rows without a start come first, in order of seq, in shards of their own.
    untimed = F.lit(-(2**62)) + F.floor(F.col("seq") / UNTIMED)
    rows = rows.withColumn("shard", F.coalesce(F.floor(F.col("start") / shard_ms), untimed))
    order = W.partitionBy("path", "shard").orderBy("start", "seq")
    if fill_forward:
        rows = rows.withColumn("person", F.last("person", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0)))
    else:
        rows = rows.withColumn("person", F.coalesce("person", F.lit(NOBODY)))
    rows = rows.withColumn("nth", F.row_number().over(order)).withColumn("before", F.lag("person").over(order))
    rows = rows.withColumn("fresh", F.when((F.col("nth") == 1) | ~F.col("person").eqNullSafe(F.col("before")), 1).otherwise(0))
    rows = rows.withColumn("run", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    at = F.struct("start", "seq")
    more = [F.min("start").alias("start_ms"), F.max("end").alias("end_ms"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "seq", "clean"))), lambda x: x["clean"]), " ").alias("text")] if with_text else []
    runs = rows.groupBy("path", "shard", "run").agg(F.first("person").alias("person"), F.min_by("seq", at).alias("first_seq"), F.max_by("seq", at).alias("last_seq"), *more)
    runs = runs.withColumn("runs", F.max("run").over(W.partitionBy("path", "shard")))
    runs = materialize(runs, "runs")
    extra = [c for c in ("start_ms", "end_ms", "text") if c in runs.columns]
    along = W.partitionBy("path").orderBy("shard", "run")
    edge = runs.where("run = 1 OR run = runs")
    if fill_forward:
        edge = edge.withColumn("person", F.last("person", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, 0)))
    edge = edge.withColumn("person", F.coalesce("person", F.lit(NOBODY)))
    goes_on = F.lag("person").over(along).eqNullSafe(F.col("person")) & (F.lag("shard").over(along) != F.col("shard"))
    edge = edge.withColumn("turn", F.sum(F.when(goes_on, 0).otherwise(1)).over(along.rowsBetween(W.unboundedPreceding, 0)))
    inner = runs.where("run > 1 AND run < runs").withColumn("person", F.coalesce("person", F.lit(NOBODY)))
    if with_text:
        of_turn = W.partitionBy("path", "turn")
        edge = edge.withColumn("part", F.row_number().over(of_turn.orderBy("shard", "run")))
        whole = of_turn.orderBy("shard", "run").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        edge = edge.withColumn("last_seq", F.last("last_seq").over(whole)).withColumn("first_seq", F.first("first_seq").over(whole))
        inner = inner.withColumn("part", F.lit(1))
        extra = ["part", *extra]
    else:
        place = F.struct("shard", "run")
        edge = edge.groupBy("path", "turn").agg(F.min_by("first_seq", place).alias("first_seq"), F.max_by("last_seq", place).alias("last_seq"), F.first("person").alias("person"))
    columns = ["path", "first_seq", "last_seq", F.col("person").alias("speaker_code"), *extra]
    return edge.select(*columns).unionByName(inner.select(*columns))
