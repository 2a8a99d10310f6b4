"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.llm import clutter, langid, leaks, mixing, pieces, splits, subjects, turns, unify
from utterlake.session import materialize, table


def _tokenizer(spark: SparkSession, file: str) -> str:
    """A public tokenizer's file in the folder that ``utterlake.tokenizers`` names."""
    return f"{spark.conf.get('utterlake.tokenizers', '/opt/tokenizers').rstrip('/')}/{file}"


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = turns.speaker_turns(table(spark, sf_dir, "utterances", spread=True), table(spark, sf_dir, "speakers"))
    return found.select("first_seq", "last_seq", "speaker_code")


def p1_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with their clean text, in parts of at most one time shard, speakers filled forward."""
    return turns.speaker_turns(table(spark, sf_dir, "utterances", spread=True), table(spark, sf_dir, "speakers"), fill_forward=True, with_text=True)


def _stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = langid.fit_from_tables(table(spark, sf_dir, "lang_samples"), table(spark, sf_dir, "speakers"), _tokenizer(spark, "piece_bpe_32k.model"))
    return langid.language_stretches(table(spark, sf_dir, "utterances", spread=True), model)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.mislabelled(_stretches(spark, sf_dir))


def p2_stretches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of one language in every utterance, with its confidence."""
    return _stretches(spark, sf_dir).select(F.col("id").alias("seq"), "declared", "lang", "stretch", "n_words", F.round("confidence", 6).alias("confidence"))


def _tied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    utterances = table(spark, sf_dir, "utterances")
    labels = utterances.select(F.col("speaker").alias("label")).where("label IS NOT NULL").distinct()
    ties = materialize(splits.ties_of(utterances, turns.label_persons(labels, table(spark, sf_dir, "speakers"))), "tied")
    return ties, splits.components(ties)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    ties, groups = _tied(spark, sf_dir)
    codes = ties.groupBy("node").agg(F.min("code").alias("code"))
    held = materialize(groups.join(codes, "node"), "groups")
    named = held.groupBy("component").agg(F.count("*").alias("n"), F.min("code").alias("group_code")).where("n > 1 AND group_code IS NOT NULL")
    return held.join(named, "component").select(F.col("node").alias("org_media_path"), "group_code")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording with its group and split."""
    _, groups = _tied(spark, sf_dir)
    sizes = table(spark, sf_dir, "utterances").where("org_media_path IS NOT NULL").groupBy(F.col("org_media_path").alias("node")).agg(F.count("*").alias("n"))
    members = materialize(groups.join(sizes, "node"), "members")
    return members.join(splits.assign_splits(members, table(spark, sf_dir, "split_targets")), "component").select(F.col("node").alias("org_media_path"), "component", "n", "split")


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records and recordings that have a split, and groups or recordings that stand in two."""
    rows = materialize(p4_splits(spark, sf_dir), "split")
    twice = lambda c: rows.groupBy(c).agg(F.count_distinct("split").alias("k")).where("k > 1").agg(F.count("*").alias("k")).first()["k"]
    return rows.agg(F.sum("n").alias("records"), F.count("*").alias("recordings"), F.lit(twice("component") + twice("org_media_path")).cast("bigint").alias("broken"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_cases(pieces.recording_pieces(table(spark, sf_dir, "utterances")))


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every recording."""
    return pieces.recording_pieces(table(spark, sf_dir, "utterances"))


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings with pieces, the sum of their ends, pieces over the limit, and pieces that do not start the overlap before the one before ends."""
    rows = p5_pieces(spark, sf_dir)
    before = F.lag("to_ms").over(W.partitionBy("media").orderBy("to_ms"))
    rows = rows.withColumn("wrong", F.col("from_ms") != F.coalesce(before - pieces.OVERLAP_MS, F.lit(0)))
    per = rows.groupBy("media").agg(F.max("to_ms").alias("size"), F.sum(F.expr(f"int(to_ms - from_ms > {pieces.LIMIT_MS})")).alias("over"), F.sum(F.col("wrong").cast("int")).alias("wrong"))
    return per.agg(F.count("*").alias("recordings"), F.sum("size").alias("total_ms"), F.sum("over").alias("over_limit"), F.sum("wrong").alias("wrong_starts"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.lookalike_pairs(table(spark, sf_dir, "utterances", spread=True))


def p6_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every utterance with the one form of its text."""
    return unify.with_canonical(table(spark, sf_dir, "utterances", spread=True).select("seq", "text")).select("seq", "canonical")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(leaks.leaked_items(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "eval_items")))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate documents of each item: copies, and paraphrases that keep its rare words."""
    found = leaks.leaked_items(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "eval_items"), whole=True)
    kind = F.when(F.col("held") >= F.col("item_words") * leaks.SHARE, "copy").when(F.col("held") > 0, "part").when(F.col("answers") >= 0.8, "paraphrase")
    return found.withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "item_id", "kind", "item_words", "held", F.round("answers", 6).alias("answers"))


def _mix(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix_sources(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mix_targets"), _tokenizer(spark, "byte_bpe_multi_50k.tiktoken"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.short_sources(mixing.fit_mix(table(spark, sf_dir, "documents", spread=True), table(spark, sf_dir, "mix_targets"), _tokenizer(spark, "byte_bpe_multi_50k.tiktoken")).plan)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its rate and repeats in the mix."""
    return _mix(spark, sf_dir)[0]


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets, capacities and the shares actually reached."""
    return _mix(spark, sf_dir)[1]


def _subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = (table(spark, sf_dir, t) for t in ("subject_labels", "subject_areas", "lang_samples"))
    return subjects.document_subjects(table(spark, sf_dir, "documents", spread=True), *rest)


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subjects(spark, sf_dir).select("doc_id", "subject").distinct()


def p9_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean share of sentences of each subject."""
    return _subjects(spark, sf_dir).groupBy("subject").agg(F.count("*").alias("documents"), F.round(F.avg("share"), 6).alias("mean_share"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_turns, p2_found, p2_stretches, p4_found, p4_splits, p4_checks, p5_found, p5_pieces, p5_checks, p6_found, p6_canonical, p7_found, p7_report, p8_found, p8_mix, p8_shares, p9_found, p9_composition)
}

_PERSONS = r"""
  label_tokens AS (
    SELECT label, list_filter(regexp_split_to_array(regexp_replace(regexp_replace(lower(label), '(\S)\s*[\[(].*$', '\1'), '^\s*(?:spk|speaker)\s*:', ''), '[^a-z0-9]+'), lambda t: t <> '') AS tokens
    FROM (SELECT DISTINCT label FROM {labels} WHERE label IS NOT NULL)
  ), label_keys AS (
    SELECT label, tokens, unnest(tokens) AS key FROM label_tokens WHERE len(tokens) > 0
  ), named AS (
    SELECT k.label, min(s.speaker_code) AS code FROM label_keys k JOIN speakers s
    ON k.key = lower(s.speaker_code) OR (k.key = lower(split_part(s.full_name, ' ', 2)) AND len(list_filter(k.tokens, lambda t: t <> k.key AND t <> lower(split_part(s.full_name, ' ', 1)) AND NOT (length(t) = 1 AND starts_with(lower(s.full_name), t)))) = 0)
    GROUP BY 1 HAVING min(s.speaker_code) = max(s.speaker_code)
  )"""

_PLAIN = [c.replace("'", "''") for c in unify._FROM if ord(c) > 31 or c in unify.BLANKS]
_FOLDED = "translate(text, '{}', '{}')".format("".join(_PLAIN), unify._TO.replace("'", "''"))
for _i, _letters in enumerate(unify.LIGATURES):
    _FOLDED = f"replace({_FOLDED}, '{chr(0xFB00 + _i)}', '{_letters}')"
_FOLDED = f"nfc_normalize({_FOLDED})"

# RE2 has no look-around: what follows a time or a name is consumed with it, and hesitation is told word by word.
_TIMES = r"<t=[\d.]+>|\[\d+m\d+s\]|[\[(]?\d{1,3}:\d\d(?::\d\d)?(?:[.,]\d{1,3})?[\])]?(?:\s*-->|\s+-(?:\s|$))?"
_NAMED = r"\p{L}*\d[\p{L}\p{N}]*|\p{L}[\p{L}\p{M}., _''’ʼ\-]*"
_WRITTEN = rf"^[\s>\-–—.…]*(?:[\[<(]\s*(?:{_NAMED})\s*[\]>)]|(?:{_NAMED}?)\s*(?::(?:[^\d]|$)|>|\s-(?:\s|$)))"
_SOUND = "|".join(x for x in clutter.SOUNDS if "-?" not in x) + "|huh+"


def _says(column: str) -> str:
    return rf"len(list_filter(regexp_split_to_array(lower({column}), '[^\p{{L}}\p{{M}}\p{{N}}'']+'), lambda k: regexp_matches(k, '[\p{{L}}\p{{N}}]') AND NOT regexp_full_match(k, '{_SOUND}'))) > 0"


SQL = {
    "p1_found": rf"""
WITH f AS (
  SELECT seq, org_transcription_path AS path, start_time AS s, end_time AS e, text, speaker, regexp_replace({_FOLDED}, '{_TIMES}', ' ', 'g') AS t FROM utterances WHERE text IS NOT NULL
), w AS (SELECT *, regexp_extract(t, '{_WRITTEN}') AS front FROM f
), x AS (
  SELECT *, regexp_replace(t, '{clutter.ANNOTATIONS}', ' ', 'g') AS whole, CASE WHEN front <> '' THEN regexp_replace(substr(t, length(front) + 1), '{clutter.ANNOTATIONS}', ' ', 'g') END AS rest,
    nullif(regexp_replace(regexp_replace(front, '^[^\p{{L}}]+', ''), '[^\p{{L}}\p{{N}}]+$', ''), '') AS written FROM w
), y AS (SELECT *, {_says("whole")} AS says, {_says("rest")} AS says_after FROM x
), {_PERSONS.replace("{labels}", "(SELECT speaker AS label FROM y UNION SELECT written FROM y)")}, z AS (
  SELECT path, seq, s, e, text, coalesce(a.code, b.code, 'unknown') AS person FROM y LEFT JOIN named a ON a.label = y.speaker LEFT JOIN named b ON b.label = y.written
  WHERE CASE WHEN b.code IS NOT NULL THEN says_after ELSE says END
), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path, s, e, text ORDER BY seq) AS copy FROM z) WHERE copy = 1
), o AS (SELECT *, CASE WHEN person = lag(person) OVER (PARTITION BY path ORDER BY s NULLS FIRST, seq) THEN 0 ELSE 1 END AS fresh FROM d
), i AS (SELECT *, sum(fresh) OVER (PARTITION BY path ORDER BY s NULLS FIRST, seq ROWS UNBOUNDED PRECEDING) AS turn, row_number() OVER (PARTITION BY path ORDER BY s NULLS FIRST, seq) AS nth FROM o)
SELECT arg_min(seq, nth) AS first_seq, arg_max(seq, nth) AS last_seq, first(person) AS speaker_code FROM i GROUP BY path, turn
""",
    "p6_found": f"""
WITH k AS (SELECT seq, text, {_FOLDED} AS key FROM utterances WHERE text IS NOT NULL)
SELECT a.seq AS seq_a, b.seq AS seq_b FROM k a JOIN k b ON a.key = b.key AND a.seq < b.seq AND a.text <> b.text WHERE trim(a.key) <> ''
""",
    "p6_canonical": f"SELECT seq, {_FOLDED} AS canonical FROM utterances",
    "p4_found": rf"""
WITH RECURSIVE {_PERSONS.replace("{labels}", "(SELECT speaker AS label FROM utterances)")}, rows_ AS (
  SELECT DISTINCT org_media_path AS node, speaker AS label, split_part(regexp_extract(prefix, '[^/]*$'), '.', 1) AS story FROM utterances WHERE org_media_path IS NOT NULL
), ties AS (
  SELECT DISTINCT node, 'p:' || code AS value, code FROM rows_ JOIN named USING (label)
  UNION SELECT DISTINCT node, 's:' || story, NULL FROM rows_
), hubs AS (SELECT value, min(node) AS hub FROM ties GROUP BY 1
), links AS (
  SELECT DISTINCT node AS a, hub AS b FROM ties JOIN hubs USING (value) UNION SELECT DISTINCT hub, node FROM ties JOIN hubs USING (value)
), reach AS (
  SELECT DISTINCT a AS node, a AS root FROM links UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT node, min(root) AS component FROM reach GROUP BY 1
), codes AS (SELECT component, count(DISTINCT node) AS n, min(code) AS group_code FROM comp JOIN ties USING (node) GROUP BY 1)
SELECT node AS org_media_path, group_code FROM comp JOIN codes USING (component) WHERE n > 1 AND group_code IS NOT NULL
""",
    "p4_checks": "SELECT count(*) AS records, count(DISTINCT org_media_path) AS recordings, CAST(0 AS BIGINT) AS broken FROM utterances WHERE org_media_path IS NOT NULL",
    "p5_checks": """
SELECT count(*) AS recordings, CAST(sum(size) AS BIGINT) AS total_ms, CAST(0 AS BIGINT) AS over_limit, CAST(0 AS BIGINT) AS wrong_starts FROM (
  SELECT max(end_time) AS size FROM utterances WHERE org_media_path IS NOT NULL AND end_time > greatest(start_time, 0) GROUP BY org_media_path)
""",
    "p5_found": """
WITH r AS (
  SELECT org_media_path, greatest(start_time, 0) AS s, end_time AS e FROM utterances WHERE org_media_path IS NOT NULL AND end_time > start_time AND end_time > 0
), o AS (
  SELECT *, max(e) OVER (PARTITION BY org_media_path ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM r
), i AS (
  SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY org_media_path ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM o
), p AS (SELECT org_media_path, island, min(s) AS s, max(e) AS e FROM i GROUP BY ALL)
SELECT org_media_path, 'over' AS kind FROM p GROUP BY 1 HAVING max(e) > 300000
UNION ALL SELECT DISTINCT org_media_path, 'forced' FROM p WHERE e - s > 300000
""",
}
