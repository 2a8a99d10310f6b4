"""Registered queries on the library's corpus operators, each over its whole tables, with the SQL that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.functions import arrays, inventories, text
from utterlake.functions.distance import alignment, cluster_errors, weighted_distance_column, word_error_rate
from utterlake.operators import batching, features, labels, reports, scoring, splits, training, utterances
from utterlake.pipeline import clean_utterances
from utterlake.sources import annotations
from utterlake.streaming import ingest
from utterlake.session import shared_dir, table

QUERIES: dict = {}
SQL: dict[str, str] = {}
_INVENTORY = inventories.TONAL_PHONEMES + inventories.TONES + [inventories.TONE_GROUP]


def query(sql: str | None = None):
    """Register a query under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _quote(pattern: str) -> str:
    return pattern.replace("'", "''")


def _alternatives(tokens) -> str:
    """The longest tokens first, escaped for RE2."""
    ordered = sorted(set(tokens), key=lambda t: (-len(t), t))
    return _quote("|".join(t.replace("|", r"\|") for t in ordered))


_SPACE = r"[\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_STRIP = _SPACE.replace(r"\x{20}", r"\x{1c}-\x{20}")
_DEDUP = """SELECT * EXCLUDE (rn) FROM (
  SELECT seq, start_time, end_time, text, speaker, prefix, row_number() OVER (PARTITION BY start_time, end_time, text ORDER BY seq) AS rn FROM utterances) WHERE rn = 1"""


# ---- filters, deduplication, durations


@query(_DEDUP)
def utter_dedup(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").select("seq", "start_time", "end_time", "text", "speaker", "prefix")
    return utterances.remove_duplicates(rows)


@query(rf"SELECT seq, text FROM utterances WHERE regexp_replace(text, '{_STRIP}', '', 'g') <> ''")
def utter_nonblank(spark: SparkSession, d: str) -> DataFrame:
    return utterances.remove_blank_text(table(spark, d, "utterances").select("seq", "text"))


@query("SELECT seq, prefix FROM utterances WHERE (end_time - start_time) / 10.0 >= length(text)")
def utter_long_enough(spark: SparkSession, d: str) -> DataFrame:
    return utterances.remove_too_short(table(spark, d, "utterances")).select("seq", "prefix")


@query("SELECT seq, end_time - start_time AS duration_ms FROM utterances WHERE end_time - start_time < 10000")
def utter_shorter_than(spark: SparkSession, d: str) -> DataFrame:
    return utterances.with_duration(utterances.shorter_than(table(spark, d, "utterances"))).select("seq", "duration_ms")


@query("SELECT seq, split_part(prefix, '.', 2) AS tier FROM utterances WHERE split_part(prefix, '.', 2) LIKE 'xv%' OR split_part(prefix, '.', 2) LIKE 'rf%'")
def utter_of_tiers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").select("seq", F.split_part("prefix", F.lit("."), F.lit(2)).alias("tier"))
    return utterances.of_tiers(rows, ["xv", "rf"])


@query("SELECT seq, speaker FROM utterances WHERE speaker IN ('Interviewer', 'SPEAKER')")
def utter_of_speakers(spark: SparkSession, d: str) -> DataFrame:
    return utterances.of_speakers(table(spark, d, "utterances").select("seq", "speaker"), ["Interviewer", "SPEAKER"])


@query("SELECT CAST(coalesce(sum(end_time - start_time), 0) AS BIGINT) AS total_ms FROM utterances")
def total_duration(spark: SparkSession, d: str) -> DataFrame:
    return utterances.total_duration(table(spark, d, "utterances"))


@query(
    rf"""WITH u AS ({_DEDUP}), s AS (
  SELECT *, array_to_string(regexp_extract_all(text, '({_alternatives(_INVENTORY)})', 1), ' ') AS seg FROM u
) SELECT speaker, CAST(sum(end_time - start_time) AS BIGINT) AS duration_ms, min(seq) AS first_seq, count(*) AS n
FROM s WHERE regexp_replace(seg, '{_STRIP}', '', 'g') <> '' AND (end_time - start_time) / 10.0 >= length(seg) GROUP BY speaker"""
)
def speaker_durations(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: duplicates out, labels of the tonal inventory, empty and too short rows out, time per speaker."""
    rows = table(spark, d, "utterances").select("seq", "start_time", "end_time", "text", "speaker")
    return utterances.speaker_durations(clean_utterances(rows, lambda c: text.segment_tokens(c, _INVENTORY)))


@query("SELECT seq, speaker, row_number() OVER (PARTITION BY speaker ORDER BY seq) AS speaker_pos FROM utterances")
def speaker_rows(spark: SparkSession, d: str) -> DataFrame:
    return utterances.speaker_rows(table(spark, d, "utterances").select("seq", "speaker"))


_WORDS = r"[\p{L}\p{M}\p{N}''’-]+"
_ENGLISH = f"SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{_WORDS}')) AS word FROM lang_samples WHERE lang = 'eng'"


def _english(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lang_samples").where("lang = 'eng'")
    return utterances.word_list(rows.select(F.explode(utterances.lower_words(F.col("text"))).alias("word")), exceptions=["a", "en"], additions=["microphone"])


_ENGLISH_LIST = f"(SELECT word FROM ({_ENGLISH}) WHERE word NOT IN ('a', 'en') UNION SELECT 'microphone')"


@query(f"SELECT seq FROM utterances WHERE text IS NOT NULL AND NOT list_has_any(regexp_extract_all(lower(text), '{_WORDS}'), (SELECT list(word) FROM {_ENGLISH_LIST}))")
def not_code_switched(spark: SparkSession, d: str) -> DataFrame:
    return utterances.not_code_switched(table(spark, d, "utterances", spread=True).select("seq", "text"), _english(spark, d)).select("seq")


@query(
    f"""WITH w AS (SELECT seq, regexp_extract_all(lower(text), '{_WORDS}') AS ws, (SELECT list(word) FROM {_ENGLISH_LIST}) AS e FROM utterances WHERE text IS NOT NULL)
SELECT seq, list_filter(ws, lambda x: list_contains(e, x))[1] AS word FROM w WHERE list_has_any(ws, e)"""
)
def code_switch_report(spark: SparkSession, d: str) -> DataFrame:
    return utterances.code_switch_report(table(spark, d, "utterances", spread=True).select("seq", "text"), _english(spark, d))


@query(f"SELECT count(*) AS utterances, count(*) FILTER (WHERE list_has_any(regexp_extract_all(lower(text), '{_WORDS}'), (SELECT list(word) FROM {_ENGLISH_LIST}))) AS code_switched FROM utterances WHERE text IS NOT NULL")
def code_switch_totals(spark: SparkSession, d: str) -> DataFrame:
    return utterances.code_switch_totals(table(spark, d, "utterances", spread=True).select("seq", "text"), _english(spark, d))


@query(
    rf"""WITH u AS (SELECT * FROM ({_DEDUP.replace('FROM utterances', "FROM utterances WHERE speaker IS NOT NULL AND end_time - start_time < 10000")}))
SELECT seq, start_time, end_time, speaker, lower(text) AS text FROM u WHERE regexp_replace(lower(text), '{_STRIP}', '', 'g') <> '' AND (end_time - start_time) / 10.0 >= length(lower(text))"""
)
def filtered_utterances(spark: SparkSession, d: str) -> DataFrame:
    """The whole cleaning with a filter of one's own."""
    rows = table(spark, d, "utterances").select("seq", "start_time", "end_time", "text", "speaker")
    return clean_utterances(rows, F.lower, F.col("speaker").isNotNull() & (F.col("end_time") - F.col("start_time") < 10_000))


# ---- segmentation and text


@query(rf"SELECT seq, trim(regexp_replace(regexp_replace(text, '{_SPACE}', '', 'g'), '(?s)(.)', '\1 ', 'g')) AS chars FROM utterances")
def segment_chars(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances", spread=True).select("seq", text.segment_chars(F.col("text")).alias("chars"))


@query(f"SELECT seq, array_to_string(regexp_extract_all(text, '({_alternatives(_INVENTORY)})', 1), ' ') AS labels FROM utterances")
def segment_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances", spread=True).select("seq", text.segment_tokens(F.col("text"), _INVENTORY).alias("labels"))


@query(f"SELECT seq, array_to_string(regexp_extract_all(lower(text), '({_alternatives(inventories.ORTHOGRAPHIC)})', 1), ' ') AS labels FROM utterances")
def segment_orthographic(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances", spread=True).select("seq", text.segment_orthographic(F.col("text")).alias("labels"))


def _tonal_all(label_type: str) -> str:
    fillers = ["əəə…|mmm…|ə…|mm…|m…"] if inventories.TONAL_TYPES[label_type][0] else []
    return _quote(
        "|".join(
            [r"\[[^\]]*\]", *fillers, *inventories.THREE, *inventories.TWO, "˧[̩̍]", *inventories.ONE, *inventories.CONTOUR_TONES, *inventories.LEVEL_TONES]
            + [r"[|ǀ◊ \t\n]", *(("\\" + s) if s in "$*.?()|+" else s for s in inventories.SYMBOLS)]
        )
    )


def _tonal_query(label_type: str) -> None:
    """Labels of every utterance that holds nothing but tonal text; the others come without labels."""
    kept = ", ".join("'" + _quote(t) + "'" for t in inventories.tonal_labels(label_type))
    sql = f"""WITH t AS (
  SELECT seq, text, regexp_extract_all(text, '{_tonal_all(label_type)}') AS f, regexp_replace(text, '{_tonal_all(label_type)}', '', 'g') = '' OR contains(text, 'BEGAIEMENT') AS recognised FROM utterances
), m AS (
  SELECT *, list_transform(f, lambda x: CASE WHEN x IN ('˧̩', '˧̍') THEN '*˧' WHEN x = 'ə…' THEN 'əəə…' WHEN x IN ('m…', 'mm…') THEN 'mmm…' WHEN x = 'wæ̃' THEN 'w̃æ' WHEN x IN ('ǀ', '◊') THEN '|' ELSE x END) AS g FROM t
)
SELECT seq, recognised, CASE WHEN contains(text, 'BEGAIEMENT') THEN '' WHEN recognised THEN replace(array_to_string(list_filter(g, lambda x: x IN ({kept}, '*˧')), ' '), '*˧', '˧') END AS labels FROM m"""

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "utterances", spread=True).select("seq", "text")
        whole = (text.tonal_residue(F.col("text"), label_type) == "") | F.col("text").contains("BEGAIEMENT")
        rows = rows.withColumn("recognised", whole)
        return rows.select("seq", "recognised", F.when(F.col("recognised"), text.segment_tonal(F.col("text"), label_type)).alias("labels"))

    run.__name__ = "segment_tonal" if label_type == "phonemes_and_tones" else f"segment_tonal_{label_type}"
    query(sql)(run)


for _type in inventories.TONAL_TYPES:
    _tonal_query(_type)


@query(
    """WITH c AS (
  SELECT seq, unnest(string_split(text, '')) AS c, generate_subscripts(string_split(text, ''), 1) AS i FROM utterances WHERE text <> ''
), s AS (
  SELECT *, sum(CASE c WHEN '[' THEN 1 WHEN ']' THEN -1 ELSE 0 END) OVER w AS s FROM c WINDOW w AS (PARTITION BY seq ORDER BY i ROWS UNBOUNDED PRECEDING)
), e AS (
  SELECT *, s - least(0, min(s) OVER (PARTITION BY seq ORDER BY i ROWS UNBOUNDED PRECEDING)) AS depth FROM s
), f AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY seq ORDER BY i), 0) AS before FROM e)
SELECT seq, coalesce(string_agg(c, '' ORDER BY i) FILTER (WHERE before = 0 AND c <> '['), '') AS text FROM f GROUP BY seq
UNION ALL SELECT seq, text FROM utterances WHERE text = '' OR text IS NULL"""
)
def remove_brackets(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances", spread=True).select("seq", text.remove_brackets_content(F.col("text")).alias("text"))


@query(rf"SELECT seq, array_to_string(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}]+(?:-[\p{{L}}\p{{M}}\p{{N}}]+)*[''’]?'), ' ') AS words FROM utterances")
def normalise_translation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances", spread=True).select("seq", text.normalise_translation(F.col("text"), remove_brackets=False).alias("words"))


@query(r"SELECT seq, word, regexp_matches(word, '(?i)^[+-]?((\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)(e[+-]?\d(_?\d)*)?|inf(inity)?|nan)$') AS is_number FROM (SELECT seq, unnest(list_distinct(string_split(text, ' '))) AS word FROM utterances)")
def is_number(spark: SparkSession, d: str) -> DataFrame:
    words = table(spark, d, "utterances", spread=True).select("seq", F.explode(F.array_distinct(F.split("text", " "))).alias("word"))
    return words.select("seq", "word", text.is_number(F.col("word")).alias("is_number"))


@query(
    r"""SELECT seq, split_part(regexp_extract(prefix, '[^/]*$'), '.', 1) AS story, regexp_extract(org_media_path, '[^/]*$') AS base, regexp_replace(regexp_extract(org_media_path, '[^/]*$'), '\.[^.]*$', '') AS stem,
  replace(prefix, '_', '\_') AS tex, start_time / 1000.0::DOUBLE AS start_s FROM utterances"""
)
def prefix_parts(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("org_media_path")
    return table(spark, d, "utterances").select(
        "seq", text.story_of(F.col("prefix")).alias("story"), text.base_name(path).alias("base"), text.stem(path).alias("stem"),
        text.latex_escape(F.col("prefix")).alias("tex"), text.millisecs_to_secs(F.col("start_time")).alias("start_s"),
    )


# ---- labels


_TOKENS = r"list_filter(regexp_split_to_array(split_part(labels, chr(10), 1), '\s+'), lambda t: t <> '')"
_VOCAB = f"SELECT 'pad' AS label, 0 AS idx UNION ALL SELECT label, row_number() OVER (ORDER BY label) FROM (SELECT DISTINCT unnest({_TOKENS}) AS label FROM label_lines)"


@query(f"SELECT label, CAST(idx AS INTEGER) AS idx FROM ({_VOCAB})")
def label_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return labels.label_vocabulary(table(spark, d, "label_lines"))


@query(f"WITH v AS ({_VOCAB}), m AS (SELECT map(list(label), list(idx)) AS m FROM v) SELECT prefix, label_type, list_transform({_TOKENS}, lambda t: CAST(m[t] AS BIGINT)) AS indices FROM label_lines, m")
def labels_to_indices(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "label_lines")
    return labels.encode_labels(lines, labels.label_vocabulary(lines)).select("prefix", "label_type", "indices")


@query(f"SELECT prefix, label_type, array_to_string({_TOKENS}, ' ') AS labels FROM label_lines")
def indices_to_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels to indices and back."""
    lines = table(spark, d, "label_lines")
    vocabulary = labels.label_vocabulary(lines)
    known = vocabulary.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("v"))
    rows = labels.encode_labels(lines, vocabulary).join(F.broadcast(known))
    return rows.select("prefix", "label_type", F.array_join(arrays.indices_to_labels(F.col("indices"), F.col("v")), " ").alias("labels"))


@query("SELECT DISTINCT prefix FROM utterances SEMI JOIN label_lines USING (prefix)")
def transcribed_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return labels.transcribed_prefixes(table(spark, d, "utterances"), table(spark, d, "label_lines"))


_STEM = r"regexp_replace(regexp_extract({0}, '[^/]*$'), '(.)\.[^.]*$', '\1')"
_UNTRAN = f"SELECT {_STEM.format('org_media_path')} AS prefix FROM recordings WHERE org_media_path IS NOT NULL AND {_STEM.format('org_media_path')} NOT IN (SELECT {_STEM.format('org_transcription_path')} FROM recordings WHERE org_transcription_path IS NOT NULL)"


@query(_UNTRAN)
def untranscribed_media(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "recordings")
    return labels.untranscribed_media(rows.select(F.col("org_media_path").alias("path")), rows.where("org_transcription_path IS NOT NULL").select(F.col("org_transcription_path").alias("path")))


@query(f"SELECT prefix FROM label_lines WHERE trim(prefix) <> '' UNION {_UNTRAN}")
def untranscribed_union(spark: SparkSession, d: str) -> DataFrame:
    return labels.untranscribed_union(table(spark, d, "label_lines"), untranscribed_media(spark, d))


@query("SELECT prefix, 'feat/' || prefix || '.fbank.npy' AS feat_path, 'label/' || prefix || '.phonemes' AS label_path FROM label_lines")
def feature_label_paths(spark: SparkSession, d: str) -> DataFrame:
    return labels.feature_label_paths(table(spark, d, "label_lines"), "fbank", "phonemes")


# ---- splits and batches

_RANK = "row_number() OVER (ORDER BY md5('0:' || {0}), {0}) - 1"
_SPLIT = f"""WITH p AS (SELECT DISTINCT prefix FROM label_lines), n AS (SELECT count(*) AS n FROM p), z AS (
  SELECT n, CAST(floor(0.9 * n) AS BIGINT) AS t0, CAST(floor(CAST(floor(0.9 * n) AS BIGINT) + 0.05 * n) AS BIGINT) AS v0 FROM n
), y AS (SELECT CASE WHEN v0 = t0 THEN t0 - 1 ELSE t0 END AS t, v0 AS v FROM z)
SELECT prefix, rank, CASE WHEN rank < t THEN 'train' WHEN rank < v THEN 'valid' ELSE 'test' END AS split FROM (SELECT prefix, {_RANK.format('prefix')} AS rank FROM p), y"""


@query(_SPLIT)
def split_assign(spark: SparkSession, d: str) -> DataFrame:
    return splits.divide(table(spark, d, "label_lines").select("prefix").distinct())


@query("SELECT org_media_path AS prefix, count(DISTINCT lang) AS splits FROM utterances WHERE lang IS NOT NULL GROUP BY 1 HAVING count(DISTINCT lang) > 1")
def split_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Recordings that would stand in more than one split if languages were splits."""
    rows = table(spark, d, "utterances").where("lang IS NOT NULL")
    return splits.overlapping(rows.select(F.col("org_media_path").alias("prefix"), F.col("lang").alias("split")))


_STORIES = "SELECT min(s) AS a, max(s) AS b FROM (SELECT split_part(regexp_extract(prefix, '[^/]*$'), '.', 1) AS s FROM utterances)"


@query(
    f"""WITH st AS ({_STORIES}), u AS (SELECT prefix, split_part(regexp_extract(prefix, '[^/]*$'), '.', 1) AS s FROM utterances)
SELECT prefix, CASE s WHEN a THEN 'valid' WHEN b THEN 'test' ELSE 'train' END AS split, CASE WHEN s IN (a, b) THEN try_cast(regexp_extract(prefix, '[^.]*$') AS BIGINT) END AS split_order FROM u, st"""
)
def story_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").select("prefix")
    ends = rows.agg(F.min(text.story_of(F.col("prefix"))).alias("a"), F.max(text.story_of(F.col("prefix"))).alias("b")).first()
    return splits.story_splits(rows, ends["a"], ends["b"])


_HELD = "SELECT DISTINCT prefix, 'valid' AS split FROM label_lines WHERE label_type = 'phonemes' AND prefix LIKE 'TEXT/%' UNION ALL SELECT DISTINCT prefix, 'test' FROM label_lines WHERE label_type <> 'phonemes' AND prefix LIKE 'TEXT/%'"


def _held_lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, d, "label_lines").where("prefix LIKE 'TEXT/%'")
    return lines.where("label_type = 'phonemes'").select("prefix").distinct(), lines.where("label_type <> 'phonemes'").select("prefix").distinct()


@query(f"WITH h AS ({_HELD}) SELECT prefix, 'train' AS split FROM (SELECT DISTINCT prefix FROM utterances WHERE end_time - start_time <= 10000) WHERE prefix NOT IN (SELECT prefix FROM h) UNION ALL SELECT prefix, split FROM h")
def complete_splits(spark: SparkSession, d: str) -> DataFrame:
    valid, test = _held_lists(spark, d)
    rows = table(spark, d, "utterances")
    sizes = rows.select("prefix", ((F.col("end_time") - F.col("start_time")) / 10).alias("frames"))
    return splits.complete_splits(rows, sizes, valid=valid, test=test)


@query(
    f"""WITH h AS ({_HELD}) SELECT prefix, 'train' AS split FROM (SELECT DISTINCT prefix FROM utterances WHERE prefix LIKE 'TEXT/%') WHERE prefix NOT IN (SELECT prefix FROM h)
UNION ALL SELECT DISTINCT prefix, 'train' FROM utterances WHERE prefix NOT LIKE 'TEXT/%' UNION ALL SELECT prefix, split FROM h"""
)
def record_type_splits(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").select("prefix").distinct()
    valid, test = _held_lists(spark, d)
    return splits.record_type_splits(rows.where("prefix LIKE 'TEXT/%'"), rows.where("prefix NOT LIKE 'TEXT/%'"), valid, test)


@query("SELECT seq, (end_time - start_time) // 10 AS frames FROM utterances WHERE (end_time - start_time) // 10 <= 500")
def filter_by_size(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").select("seq", F.expr("(end_time - start_time) div 10").alias("frames"))
    return splits.filter_by_size(rows, 500)


_FRAMES = "SELECT seq, greatest(coalesce((end_time - start_time) // 10, 0), 0) AS frames FROM utterances"


def _frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "utterances").select("seq", F.greatest(F.coalesce(F.expr("(end_time - start_time) div 10"), F.lit(0)), F.lit(0)).alias("frames"))


@query(f"SELECT seq, frames, row_number() OVER (ORDER BY frames, seq) - 1 AS pos, (row_number() OVER (ORDER BY frames, seq) - 1) // 64 AS batch FROM ({_FRAMES})")
def make_batches(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order of size, in batches of 64."""
    return batching.make_batches(_frames(spark, d), 64, ["frames", "seq"])


@query(f"WITH b AS (SELECT seq, frames, (row_number() OVER (ORDER BY frames, seq) - 1) // 64 AS batch FROM ({_FRAMES})) SELECT seq, batch, frames, max(frames) OVER (PARTITION BY batch) AS padded FROM b")
def batch_pad_lengths(spark: SparkSession, d: str) -> DataFrame:
    return batching.pad_lengths(batching.make_batches(_frames(spark, d), 64, ["frames", "seq"])).select("seq", "batch", "frames", "padded")


@query(f"SELECT batch, {_RANK.format('CAST(batch AS VARCHAR)').replace('), CAST(batch AS VARCHAR))', '), batch)')} AS batch_order FROM (SELECT DISTINCT (row_number() OVER (ORDER BY frames, seq) - 1) // 64 AS batch FROM ({_FRAMES}))")
def shuffled_batches(spark: SparkSession, d: str) -> DataFrame:
    return batching.shuffled_batches(batching.make_batches(_frames(spark, d), 64, ["frames", "seq"])).select("batch", "batch_order").distinct()


@query("SELECT seq FROM (SELECT seq, row_number() OVER (ORDER BY md5('0:' || CAST(seq AS VARCHAR)), seq) - 1 AS rank FROM utterances) WHERE rank < 1024")
def sample_rows(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 1024 rows for a small training set."""
    return batching.sample_rows(table(spark, d, "utterances").select("seq"), 1024, "seq").select("seq")


@query("SELECT org_media_path, count(*) AS n, CAST(CASE WHEN count(*) >= 512 THEN 16 WHEN count(*) < 4 THEN 1 WHEN count(*) < 128 THEN 4 ELSE count(*) // 32 END AS INTEGER) AS batch_size FROM utterances GROUP BY 1")
def batch_sizes(spark: SparkSession, d: str) -> DataFrame:
    counts = table(spark, d, "utterances").groupBy("org_media_path").agg(F.count("*").alias("n"))
    return counts.withColumn("batch_size", batching.batch_size_for(F.col("n")))


@query(f"WITH v AS ({_VOCAB}) SELECT prefix, label_type, CAST(pos - 1 AS INTEGER) AS pos, CAST(idx AS BIGINT) AS value FROM (SELECT prefix, label_type, unnest({_TOKENS}) AS label, generate_subscripts({_TOKENS}, 1) AS pos FROM label_lines) JOIN v USING (label)")
def sparse_targets(spark: SparkSession, d: str) -> DataFrame:
    rows = labels_to_indices(spark, d).select(F.struct("prefix", "label_type").alias("row"), "indices")
    return batching.sparse_targets(rows).select("row.prefix", "row.label_type", "pos", "value")


@query(f"WITH x AS (SELECT prefix, label_type, list_transform({_TOKENS}, lambda t: [CAST(length(t) AS FLOAT), CAST(0.5 AS FLOAT)]) AS f FROM label_lines), m AS (SELECT max(len(f)) AS m FROM x) SELECT prefix, label_type, f || list_transform(range(m - len(f)), lambda i: [CAST(0 AS FLOAT), CAST(0 AS FLOAT)]) AS padded FROM x, m")
def zero_pad(spark: SparkSession, d: str) -> DataFrame:
    rows = labels.label_tokens(table(spark, d, "label_lines")).select("prefix", "label_type", F.transform("tokens", lambda t: F.array(F.length(t).cast("float"), F.lit(0.5).cast("float"))).alias("f"))
    longest = rows.agg(F.max(F.size("f"))).first()[0] or 0
    return rows.select("prefix", "label_type", arrays.zero_pad(F.col("f"), F.lit(longest), 2).alias("padded"))


@query("SELECT seq, [[start_time, start_time + 2, start_time + 1, start_time + 3], [end_time, end_time + 2, end_time + 1, end_time + 3]] AS flat FROM utterances")
def collapse(spark: SparkSession, d: str) -> DataFrame:
    """Two frames of two features by two channels."""
    frame = lambda c: F.array(F.array(F.col(c), F.col(c) + 1), F.array(F.col(c) + 2, F.col(c) + 3))
    return table(spark, d, "utterances").select("seq", arrays.collapse(F.array(frame("start_time"), frame("end_time"))).alias("flat"))


@query(f"WITH v AS ({_VOCAB}), n AS (SELECT count(*) AS n FROM v) SELECT label, list_transform(range(n), lambda j: CAST(j = idx AS INTEGER)) AS onehot FROM v, n")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    vocabulary = labels.label_vocabulary(table(spark, d, "label_lines"))
    return vocabulary.select("label", arrays.one_hot(F.array("idx"), vocabulary.count())[0].alias("onehot"))


def _label_rows(spark: SparkSession, d: str) -> DataFrame:
    """Label lines as rows of a corpus: features of three numbers for each label, in batches of 16 by length."""
    rows = labels.label_tokens(table(spark, d, "label_lines")).groupBy("prefix").agg(F.min("tokens").alias("tokens"))
    width = lambda t, k: (F.length(t) + k).cast("float")
    rows = rows.select("prefix", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("labels"), F.transform("tokens", lambda t: F.array(*[width(t, k) for k in range(3)])).alias("feats"))
    return batching.make_batches(rows, 16, ["n", "prefix"])


_LABEL_ROWS = f"""l AS (SELECT prefix, min({_TOKENS}) AS tokens FROM label_lines GROUP BY prefix),
k AS (SELECT prefix, tokens, row_number() OVER (ORDER BY len(tokens), prefix) - 1 AS pos FROM l), b AS (SELECT *, pos // 16 AS batch FROM k)"""


@query(
    f"""WITH {_LABEL_ROWS}, m AS (SELECT *, max(len(tokens)) OVER (PARTITION BY batch) AS longest FROM b)
SELECT batch, list(prefix ORDER BY pos) AS prefixes, list(CAST(len(tokens) AS INTEGER) ORDER BY pos) AS lens,
  list(list_transform(tokens, lambda t: [CAST(length(t) AS FLOAT), CAST(length(t) + 1 AS FLOAT), CAST(length(t) + 2 AS FLOAT)]) || list_transform(range(longest - len(tokens)), lambda i: [CAST(0 AS FLOAT), CAST(0 AS FLOAT), CAST(0 AS FLOAT)]) ORDER BY pos) AS x FROM m GROUP BY batch"""
)
def batch_features(spark: SparkSession, d: str) -> DataFrame:
    """Padded features of every batch, as a model loads them."""
    return batching.padded_batches(_label_rows(spark, d), 3)


@query(f"WITH v AS ({_VOCAB}), {_LABEL_ROWS} SELECT batch, pos % 16 AS row, CAST(nth - 1 AS INTEGER) AS pos, CAST(idx AS BIGINT) AS value FROM (SELECT batch, pos, unnest(tokens) AS label, generate_subscripts(tokens, 1) AS nth FROM b) JOIN v USING (label)")
def batch_targets(spark: SparkSession, d: str) -> DataFrame:
    """Sparse targets of every batch: features and labels are joined by prefix."""
    rows = _label_rows(spark, d)
    encoded = labels.encode_labels(rows.select("prefix", "labels"), labels.label_vocabulary(table(spark, d, "label_lines")))
    return batching.load_batch(rows, encoded, 3)[1].select("batch", F.col("row").cast("bigint").alias("row"), "pos", "value")


@query("SELECT CAST(n // 64 * 64 AS BIGINT) AS num_train, 64 AS batch_size FROM (SELECT count(*) AS n FROM label_lines) UNION ALL SELECT n // 8 * 8, 8 FROM (SELECT count(*) AS n FROM label_lines) UNION ALL SELECT 64, 2")
def reader_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Rows and batches of readers over the label lines: by default, with a batch size, with a number of rows."""
    n = table(spark, d, "label_lines").count()
    found = [batching.reader_sizing(n), batching.reader_sizing(n, batch_size=8), batching.reader_sizing(n, num_train=64)]
    return spark.createDataFrame([(s.num_train, s.batch_size) for s in found], "num_train bigint, batch_size int")


# ---- scores: label lines against the labels of the utterance they were made from


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """``prefix, ref, hyp, speaker``: given labels, and tonal labels found in the text; first import of each prefix."""
    first = table(spark, d, "utterances").where("text IS NOT NULL").groupBy("prefix").agg(F.min_by(F.struct("text", "speaker"), "seq").alias("u"))
    lines = labels.label_tokens(table(spark, d, "label_lines")).groupBy("prefix").agg(F.min("tokens").alias("ref"))
    hyp = text.tokens_of(F.lower("u.text"), _INVENTORY)
    return lines.join(first, "prefix").select("prefix", "ref", hyp.alias("hyp"), F.col("u.speaker").alias("speaker"))


# Tokens of a pair as one ASCII character each, because the string distance of the oracle counts bytes.
_SCORED = f"""WITH u AS (SELECT prefix, arg_min(struct_pack(t := text, s := speaker), seq) AS u FROM utterances WHERE text IS NOT NULL GROUP BY prefix),
l AS (SELECT prefix, min({_TOKENS}) AS ref FROM label_lines GROUP BY prefix),
p AS (SELECT prefix, ref, regexp_extract_all(lower(u.u.t), '({_alternatives(_INVENTORY)})', 1) AS hyp, u.u.s AS speaker FROM l JOIN u USING (prefix))"""
_CODED = "array_to_string(list_transform({0}, lambda t: chr(CAST(32 + list_position(list_distinct(ref || hyp), t) AS INTEGER))), '')"
_RATES = f"{_SCORED}, r AS (SELECT prefix, speaker, len(ref) AS n, levenshtein({_CODED.format('ref')}, {_CODED.format('hyp')}) AS d FROM p WHERE len(ref) > 0)"


@query(f"{_RATES} SELECT prefix, CAST(n AS INTEGER) AS ref_len, d AS distance, round(d / n, 6) AS error_rate, round(100.0 * (d / n), 6) AS wer FROM r")
def edit_distance(spark: SparkSession, d: str) -> DataFrame:
    rows = scoring.with_error_rate(_pairs(spark, d), "skip")
    return rows.select("prefix", F.size("ref").alias("ref_len"), "distance", F.round("error_rate", 6).alias("error_rate"), F.round(F.lit(100.0) * F.col("error_rate"), 6).alias("wer"))


@query(f"{_RATES} SELECT round(avg(d / n), 6) AS error_rate, count(*) AS n FROM r")
def mean_error_rate(spark: SparkSession, d: str) -> DataFrame:
    return scoring.mean_error_rate(_pairs(spark, d), "skip").select(F.round("error_rate", 6).alias("error_rate"), "n")


@query(
    f"""{_SCORED}, k AS (SELECT prefix, list_filter(ref, lambda t: list_contains({list(inventories.ONE)}, t)) AS ref, list_filter(hyp, lambda t: list_contains({list(inventories.ONE)}, t)) AS hyp FROM p)
SELECT coalesce(round(avg(d / n), 6), -1.0) AS error_rate, count(*) AS n FROM (SELECT len(ref) AS n, levenshtein({_CODED.format('ref')}, {_CODED.format('hyp')}) AS d FROM k WHERE len(ref) > 0)"""
)
def filtered_error_rate(spark: SparkSession, d: str) -> DataFrame:
    kept = F.array(*[F.lit(x) for x in inventories.ONE])
    return scoring.filtered_error_rate(_pairs(spark, d), kept, "skip").select(F.round("error_rate", 6).alias("error_rate"), "n")


@query(f"{_RATES}, b AS (SELECT speaker, avg(d / n) AS e, count(*) AS n FROM r GROUP BY speaker) SELECT speaker, round(e, 6) AS error_rate, n, round((SELECT sum(e * n) / sum(n) FROM b), 6) AS all_error_rate FROM b")
def error_rate_by_speaker(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d)
    found = scoring.error_rate_by_speaker(pairs.select("prefix", "ref", "hyp"), pairs.select("prefix", "speaker"))
    return found.select("speaker", F.round("error_rate", 6).alias("error_rate"), "n", F.round("all_error_rate", 6).alias("all_error_rate"))


def _table_of(change: int) -> str:
    """Rows of the table of edit costs of each pair: every cost from the row above, then added targets by a running least."""
    return f"""t AS (
  SELECT prefix, ref, hyp, 0 AS i, [range(0, len(hyp) + 1)] AS rows FROM p
  UNION ALL
  SELECT prefix, ref, hyp, i + 1, list_append(rows, list_transform(range(0, len(hyp) + 1), lambda k: list_min(least_[1:k + 1]) + k)) FROM (
    SELECT *, list_transform(range(0, len(hyp) + 1), lambda k: (CASE WHEN k = 0 THEN rows[i + 1][1] + 1 ELSE least(rows[i + 1][k + 1] + 1, rows[i + 1][k] + CASE WHEN hyp[k] = ref[i + 1] THEN 0 ELSE {change} END) END) - k) AS least_
    FROM t WHERE i < len(ref))
)"""


# The way back takes a pair before a reference label before a hypothesis label.
_STEPS = f"""{_SCORED.replace('WITH u AS', 'WITH RECURSIVE u AS')}, {_table_of(1)}, b AS (
  SELECT prefix, ref, hyp, rows, len(ref) AS m, len(hyp) AS n, 0 AS step, '' AS r, '' AS h FROM t WHERE i = len(ref)
  UNION ALL
  SELECT prefix, ref, hyp, rows, m - (move <> 2)::BIGINT, n - (move <> 1)::BIGINT, step + 1, CASE WHEN move <> 2 THEN ref[m] ELSE '' END, CASE WHEN move <> 1 THEN hyp[n] ELSE '' END FROM (
    SELECT *, CASE WHEN m > 0 AND n > 0 AND rows[m + 1][n + 1] = rows[m][n] + (ref[m] <> hyp[n])::BIGINT THEN 0 WHEN m > 0 AND rows[m + 1][n + 1] = rows[m][n + 1] + 1 THEN 1 ELSE 2 END AS move
    FROM b WHERE m > 0 OR n > 0)
), arrows AS (SELECT r AS ref, h AS hyp, count(*) AS count FROM b WHERE step > 0 GROUP BY 1, 2)"""


@query(f"{_STEPS} SELECT * FROM arrows")
def arrow_counts(spark: SparkSession, d: str) -> DataFrame:
    return scoring.arrow_counts(_pairs(spark, d))


@query(
    f"""{_STEPS} SELECT CAST(coalesce(sum(count) FILTER (WHERE ref <> hyp AND ref <> '' AND hyp <> ''), 0) AS BIGINT) AS substitutions, CAST(coalesce(sum(count) FILTER (WHERE ref <> '' AND hyp = ''), 0) AS BIGINT) AS deletions,
CAST(coalesce(sum(count) FILTER (WHERE ref = '' AND hyp <> ''), 0) AS BIGINT) AS insertions, CAST(coalesce(sum(count) FILTER (WHERE ref = hyp), 0) AS BIGINT) AS matches FROM arrows"""
)
def error_types(spark: SparkSession, d: str) -> DataFrame:
    return scoring.error_types(scoring.arrow_counts(_pairs(spark, d)))


@query(f"{_STEPS} SELECT ref AS label, CAST(sum(count) AS BIGINT) AS count FROM arrows WHERE hyp = '' AND ref <> '' GROUP BY 1")
def deletions_by_label(spark: SparkSession, d: str) -> DataFrame:
    return scoring.deletions_by_label(scoring.arrow_counts(_pairs(spark, d)))


@query(
    f"""{_STEPS}, top AS (SELECT ref AS label FROM arrows WHERE ref <> '' GROUP BY 1 ORDER BY sum(count) DESC, 1 LIMIT 25)
SELECT a.label AS ref, b.label AS hyp, coalesce(c.count, 0) AS count FROM top a CROSS JOIN top b LEFT JOIN arrows c ON c.ref = a.label AND c.hyp = b.label"""
)
def confusion_top(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 25 commonest labels."""
    return scoring.confusion(scoring.arrow_counts(_pairs(spark, d)))


@query(
    f"""{_STEPS}, o AS (SELECT prefix, step, r, h, r = h AS ok FROM b WHERE step > 0
), g AS (SELECT *, sum(CASE WHEN ok OR before IS NULL OR before THEN 1 ELSE 0 END) OVER (PARTITION BY prefix ORDER BY step DESC ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, lag(ok) OVER (PARTITION BY prefix ORDER BY step DESC) AS before FROM o)
), c AS (SELECT coalesce(string_agg(r, ' ' ORDER BY step DESC) FILTER (WHERE r <> ''), '') AS ref, coalesce(string_agg(h, ' ' ORDER BY step DESC) FILTER (WHERE h <> ''), '') AS hyp FROM g GROUP BY prefix, cluster)
SELECT ref, hyp, count(*) AS count FROM c WHERE ref <> hyp GROUP BY 1, 2"""
)
def clustered_errors(spark: SparkSession, d: str) -> DataFrame:
    pairs = _pairs(spark, d).select("prefix", F.explode(cluster_errors(alignment("ref", "hyp"))).alias("c"))
    wrong = pairs.where("NOT c.ref <=> c.hyp")
    return wrong.groupBy(F.array_join("c.ref", " ").alias("ref"), F.array_join("c.hyp", " ").alias("hyp")).agg(F.count("*").alias("count"))


def _highlight(side: str) -> str:
    return rf"coalesce(string_agg(CASE WHEN r = h THEN {side} ELSE '\hl{{' || {side} || '}}' END, '' ORDER BY step DESC) FILTER (WHERE step > 0), '')"


@query(rf"{_STEPS} SELECT replace(prefix, '_', '\_') AS prefix, {_highlight('r')} AS ref_tex, {_highlight('h')} AS hyp_tex FROM b GROUP BY prefix")
def latex_alignments(spark: SparkSession, d: str) -> DataFrame:
    return reports.highlighted(_pairs(spark, d)).select(text.latex_escape(F.col("prefix")).alias("prefix"), "ref_tex", "hyp_tex")


@query(f"{_RATES} SELECT prefix, round(100.0 * d / n, 6) AS wer FROM r")
def word_error_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = _pairs(spark, d).where(F.size("ref") > 0)
    return rows.select("prefix", F.round(word_error_rate(F.col("ref"), F.col("hyp")), 6).alias("wer"))


@query(f"{_SCORED.replace('WITH u AS', 'WITH RECURSIVE u AS')}, {_table_of(2)} SELECT prefix, CAST(rows[len(ref) + 1][len(hyp) + 1] AS BIGINT) AS distance FROM t WHERE i = len(ref)")
def weighted_distances(spark: SparkSession, d: str) -> DataFrame:
    """Edit distance in which changing a label costs two."""
    return _pairs(spark, d).select("prefix", weighted_distance_column(2)(F.col("ref"), F.col("hyp")).alias("distance"))


@query(r"""SELECT seq AS line_no, list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '') AS ref, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda t: t <> '') AS hyp FROM utterances WHERE text IS NOT NULL""")
def joined_lines(spark: SparkSession, d: str) -> DataFrame:
    """Two files of token lines, joined by line."""
    rows = table(spark, d, "utterances").where("text IS NOT NULL")
    tokens = lambda c: F.filter(F.split(c, r"\s+"), lambda t: t != "")
    side = lambda c: rows.select(F.col("seq").alias("line_no"), tokens(c).alias("tokens"))
    return scoring.join_by_line(side(F.lower("text")), side(F.col("text")))


# ---- series, logs, slices


@query(
    """SELECT event_id, user_id, round((1 * (coalesce(lead(value, 1) OVER w, last_value(value) OVER a) - coalesce(lag(value, 1) OVER w, first_value(value) OVER a))
  + 2 * (coalesce(lead(value, 2) OVER w, last_value(value) OVER a) - coalesce(lag(value, 2) OVER w, first_value(value) OVER a))) / 10.0, 6) AS delta
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id), a AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def delta_features(spark: SparkSession, d: str) -> DataFrame:
    return features.delta_over(table(spark, d, "events"), "user_id", "event_id", "value").select("event_id", "user_id", F.round("delta", 6).alias("delta"))


_LOG = "SELECT CAST(user_id AS VARCHAR) AS run, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS INTEGER) AS epoch, abs(value) / (SELECT max(abs(value)) FROM events) AS valid_ler, abs(value) / (SELECT max(abs(value)) FROM events) / 2 AS last_batch_ler FROM events"


@query(
    f"""WITH l AS ({_LOG}), b AS (
  SELECT *, valid_ler < least(coalesce(min(valid_ler) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 2.0), 2.0) AS better FROM l
), s AS (
  SELECT *, epoch - coalesce(max(CASE WHEN better THEN epoch END) OVER (PARTITION BY run ORDER BY epoch ROWS UNBOUNDED PRECEDING), 0) AS since FROM b
), t AS (
  SELECT *, min(CASE WHEN NOT better AND (epoch >= 100 OR (since >= 3 AND epoch >= 4 AND valid_ler <= 1.0 AND last_batch_ler <= 0.3)) THEN epoch END) OVER (PARTITION BY run) AS stop_epoch FROM s
)
SELECT run, arg_max(epoch, epoch) FILTER (WHERE better) AS best_epoch, round(min(valid_ler) FILTER (WHERE better), 6) AS best_valid_ler, first(stop_epoch) AS stop_epoch
FROM t WHERE stop_epoch IS NULL OR epoch <= stop_epoch GROUP BY run"""
)
def early_stop(spark: SparkSession, d: str) -> DataFrame:
    """Every user's events as the log of a run."""
    rows = table(spark, d, "events")
    top = rows.agg(F.max(F.abs("value"))).first()[0]
    log = rows.select(F.col("user_id").cast("string").alias("run"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("epoch"), (F.abs("value") / top).alias("valid_ler"), (F.abs("value") / top / 2).alias("last_batch_ler"))
    return training.stopping_points(log, 100, 4, 3).select("run", "best_epoch", F.round("best_valid_ler", 6).alias("best_valid_ler"), "stop_epoch")


@query("SELECT event_type AS run, user_id AS epoch, round(avg(value), 6) AS training_ler, arg_max(value, event_id) AS last_batch_ler, count(*) AS batches FROM events GROUP BY 1, 2")
def epoch_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("run"), F.col("user_id").alias("epoch"), F.col("event_id").alias("batch"), F.col("value").alias("ler"))
    return training.epoch_rates(rows).withColumn("training_ler", F.round("training_ler", 6))


@query("SELECT coalesce(max(o_orderkey), -1) + 1 AS next_run FROM orders")
def next_run(spark: SparkSession, d: str) -> DataFrame:
    return training.next_run(table(spark, d, "orders").select(F.concat(F.col("o_orderkey").cast("string"), F.lit(".log")).alias("name")))


@query(
    f"""WITH s AS ({_SPLIT}), f AS (SELECT prefix, greatest(coalesce((end_time - start_time) // 10, 0), 0) AS frames FROM utterances)
SELECT coalesce(split, 'total') AS split, round(sum(frames) * 10 / 60000.0, 6) AS minutes FROM s JOIN f USING (prefix) GROUP BY ROLLUP (split)"""
)
def split_minutes(spark: SparkSession, d: str) -> DataFrame:
    frames = table(spark, d, "utterances").select("prefix", F.greatest(F.coalesce(F.expr("(end_time - start_time) div 10"), F.lit(0)), F.lit(0)).alias("frames"))
    rows = split_assign(spark, d).join(frames, "prefix").select("split", "frames")
    return training.split_minutes(rows).select("split", F.round("minutes", 6).alias("minutes"))


_SLICES = "SELECT org_media_path, unnest(range(0, duration_ms // 10000 + 1)) AS slice FROM recordings WHERE duration_ms >= 0"


@query(f"SELECT org_media_path, slice, slice * 10000 AS slice_start, (slice + 1) * 10000 AS slice_end FROM ({_SLICES})")
def fixed_slices(spark: SparkSession, d: str) -> DataFrame:
    return features.fixed_slices(table(spark, d, "recordings"), "org_media_path", "duration_ms", 10_000)


@query(
    f"""SELECT s.org_media_path, s.slice, count(*) AS n FROM ({_SLICES}) s JOIN utterances u ON u.org_media_path = s.org_media_path
AND u.end_time > u.start_time AND u.start_time < (s.slice + 1) * 10000 AND u.end_time > s.slice * 10000 GROUP BY 1, 2"""
)
def slice_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Utterances that reach into each slice: intervals meet slices on equal slice numbers, not by a range join."""
    rows = table(spark, d, "utterances").where("end_time > start_time AND end_time > 0")
    touched = rows.select("org_media_path", F.explode(F.expr("sequence(greatest(start_time, 0) div 10000, (end_time - 1) div 10000)")).alias("slice"))
    counts = touched.groupBy("org_media_path", "slice").agg(F.count("*").alias("n"))
    return fixed_slices(spark, d).select("org_media_path", "slice").join(counts, ["org_media_path", "slice"])


@query(
    """WITH a AS (SELECT org_transcription_path AS path, split_part(prefix, '.', 2) AS tier, start_time, end_time, text, speaker, seq, org_media_path FROM utterances)
SELECT org_media_path, path AS org_transcription_path, regexp_replace(regexp_extract(path, '[^/]*$'), '(.)\\.[^.]*$', '\\1') || '.' || tier || '.' || (row_number() OVER (PARTITION BY path, tier ORDER BY start_time, seq) - 1) AS prefix,
  start_time + 500 AS start_time, end_time + 500 AS end_time, text, speaker FROM a WHERE tier LIKE 'xv%' OR tier LIKE 'A_%'"""
)
def tier_utterances(spark: SparkSession, d: str) -> DataFrame:
    """Utterances as annotations of their tiers, numbered and shifted by a time origin."""
    rows = table(spark, d, "utterances").select(
        F.col("org_transcription_path").alias("path"), F.col("org_media_path").alias("media"), F.lit(500).cast("bigint").alias("time_origin"), F.split_part("prefix", F.lit("."), F.lit(2)).alias("tier"),
        F.col("speaker").alias("participant"), F.col("start_time").alias("start"), F.col("end_time").alias("end"), "text", F.col("seq").alias("pos"), F.lit(None).cast("string").alias("error"),
    )
    return annotations.utterances_of(rows, ["xv", "A_"]).drop("tier", "n")


# ---- streaming


@query("SELECT date_trunc('day', received_at) AS window_start, speaker, count(*) AS n, CAST(sum(end_time - start_time) AS BIGINT) AS duration_ms FROM utterances GROUP BY ALL")
def daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the whole table."""
    rows = table(spark, d, "utterances").withColumn("received_at", F.col("received_at").cast("timestamp"))
    return ingest.windowed_counts(rows).select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "speaker", "n", "duration_ms")


@query("SELECT date_trunc('day', received_at) AS window_start, speaker, count(*) AS n, CAST(sum(end_time - start_time) AS BIGINT) AS duration_ms FROM utterances GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same by a stream that is drained to its end, every update kept by key."""
    stream = ingest.utterance_stream(spark, f"{d}/utterances.parquet", table(spark, d, "utterances").schema)
    found = ingest.run_to_folder(ingest.windowed_counts(stream), f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", ["window_start", "window_end", "speaker"])
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "speaker", "n", "duration_ms")


@query(
    """WITH a AS (SELECT org_transcription_path, received_at, CASE WHEN received_at - lag(received_at) OVER w < INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh FROM utterances WINDOW w AS (PARTITION BY org_transcription_path ORDER BY received_at)),
b AS (SELECT *, sum(fresh) OVER (PARTITION BY org_transcription_path ORDER BY received_at ROWS UNBOUNDED PRECEDING) AS s FROM a)
SELECT org_transcription_path, min(received_at) AS session_start, max(received_at) + INTERVAL 30 MINUTES AS session_end, count(*) AS n FROM b GROUP BY org_transcription_path, s"""
)
def import_sessions(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "utterances").withColumn("received_at", F.col("received_at").cast("timestamp"))
    found = ingest.sessions(rows)
    return found.select("org_transcription_path", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("session_start", "session_end")], "n")


@query("SELECT seq FROM (SELECT seq, recorded_at, max(recorded_at) OVER (ORDER BY seq ROWS UNBOUNDED PRECEDING) AS top FROM utterances LEFT JOIN recordings USING (org_media_path)) WHERE recorded_at < top - INTERVAL 1 DAY")
def late_rows(spark: SparkSession, d: str) -> DataFrame:
    """Utterances that came after one of a recording made more than a day later."""
    rows = table(spark, d, "utterances").select("seq", "org_media_path").join(table(spark, d, "recordings").select("org_media_path", "recorded_at"), "org_media_path", "left")
    return ingest.late_rows(rows, "recorded_at").select("seq")
