"""Annotation files as utterance rows: time-aligned tier files and sentence files, both XML.

Files are listed and read by Spark (``binaryFile``, recursive); each is parsed where it lies, in Arrow batches. Ids and
times come from window functions, so the result does not depend on the order of files.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.errors import UtterlakeError
from utterlake.functions.text import stem

_TIERS = "path string, media string, time_origin bigint, tier string, participant string, start bigint, end bigint, text string, pos bigint, error string"
_SENTENCES = "path string, root string, kind string, pos bigint, transcription string, start_s double, end_s double, translations array<string>, error string"


def _local(path: str) -> str:
    return path.removeprefix("file://").removeprefix("file:")


def _files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path", "content")


def parse_tiers(content: bytes) -> tuple[list[dict], list[tuple[str, str | None, int, int, str]]]:
    """Media descriptors (url, origin), and (tier, participant, start, end, text) of every aligned annotation in order.

    A reference annotation takes the times of the annotation it refers to.
    """
    root = ElementTree.fromstring(content)
    media = [{"url": m.get("RELATIVE_MEDIA_URL"), "origin": m.get("TIME_ORIGIN")} for m in root.iter("MEDIA_DESCRIPTOR")]
    slots = {s.get("TIME_SLOT_ID"): s.get("TIME_VALUE") for s in root.iter("TIME_SLOT")}
    times: dict[str, tuple[int, int]] = {}
    for a in root.iter("ALIGNABLE_ANNOTATION"):
        lo, hi = slots.get(a.get("TIME_SLOT_REF1")), slots.get(a.get("TIME_SLOT_REF2"))
        if lo is not None and hi is not None:
            times[a.get("ANNOTATION_ID")] = (int(lo), int(hi))
    refers = {a.get("ANNOTATION_ID"): a.get("ANNOTATION_REF") for a in root.iter("REF_ANNOTATION")}
    rows = []
    for tier in root.iter("TIER"):
        for a in tier.iter():
            if a.tag in ("ALIGNABLE_ANNOTATION", "REF_ANNOTATION"):
                name, seen = a.get("ANNOTATION_ID"), set()
                while name not in times and name in refers and name not in seen:
                    seen.add(name)
                    name = refers[name]
                if name in times:
                    rows.append((tier.get("TIER_ID"), tier.get("PARTICIPANT"), *times[name], a.findtext("ANNOTATION_VALUE") or ""))
    return media, rows


def tier_annotations(spark: SparkSession, root: str, pattern: str = "*.eaf", known_media: Sequence[str] | None = None) -> DataFrame:
    """Annotations of all tiers below ``root``; ``error`` tells why a file gave none.

    The medium of a file is the first descriptor whose file exists (on the shared file system, or in ``known_media``).
    """
    known = None if known_media is None else set(known_media)

    def exists(path: str) -> bool:
        import os

        return path in known if known is not None else os.path.isfile(path)

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                path = _local(path)
                try:
                    media, rows = parse_tiers(bytes(content))
                except ElementTree.ParseError as error:
                    out.append((path, None, None, None, None, None, None, None, None, f"not XML: {error}"))
                    continue
                near = [(posixpath.normpath(posixpath.join(posixpath.dirname(path), m["url"])), m["origin"]) for m in media if m["url"]]
                found = next(((p, o) for p, o in near if exists(p)), None)
                if found is None:
                    out.append((path, None, None, None, None, None, None, None, None, f"no media file among {[p for p, _ in near]}"))
                    continue
                origin = int(found[1] or 0)
                out += [(path, found[0], origin, tier, who, lo, hi, text, k, None) for k, (tier, who, lo, hi, text) in enumerate(rows)]
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _TIERS.split(", ")]).astype({c: "Int64" for c in ("time_origin", "start", "end", "pos")})

    return _files(spark, root, pattern).mapInPandas(parse, _TIERS)


def utterances_of(annotations: DataFrame, tier_prefixes: Sequence[str]) -> DataFrame:
    """Utterance rows of the tiers whose name starts with one of the prefixes.

    Within a tier annotations are ordered by start, ties by place; the id is file stem, tier and number; both times are
    shifted by the time origin. ``seq`` follows path, tier and number.
    """
    hit = F.lit(False)
    for p in tier_prefixes:
        hit = hit | F.col("tier").startswith(p)
    number = F.row_number().over(W.partitionBy("path", "tier").orderBy("start", "pos")) - 1
    rows = annotations.where(F.col("error").isNull() & hit).withColumn("n", number)
    return rows.select(
        F.col("media").alias("org_media_path"), F.col("path").alias("org_transcription_path"),
        F.concat_ws(".", stem(F.col("path")), "tier", F.col("n").cast("string")).alias("prefix"),
        (F.col("start") + F.col("time_origin")).alias("start_time"), (F.col("end") + F.col("time_origin")).alias("end_time"),
        "text", F.col("participant").alias("speaker"), "tier", "n",
    )


def read_utterances(spark: SparkSession, root: str, tier_prefixes: Sequence[str], known_media: Sequence[str] | None = None) -> DataFrame:
    """All utterances below ``root``; a file that cannot be read, or whose medium is missing, is an error."""
    found = tier_annotations(spark, root, known_media=known_media)
    bad = found.where("error IS NOT NULL").select("path", "error").limit(5).collect()
    if bad:
        raise UtterlakeError("; ".join(f"{r['path']}: {r['error']}" for r in bad))
    return utterances_of(found, tier_prefixes)


def tier_summary(annotations: DataFrame) -> DataFrame:
    """What tiers there are: ``path, tier, participant, annotations, total_ms``."""
    rows = annotations.where("error IS NULL")
    return rows.groupBy("path", "tier", "participant").agg(F.count("*").alias("annotations"), F.sum(F.col("end") - F.col("start")).alias("total_ms"))


def parse_sentences(content: bytes) -> tuple[str, list[tuple[str, str | None, float, float, list[str | None]]]]:
    """Root tag and (kind, transcription, start, end, translations) of sentences and words that have audio times."""
    root = ElementTree.fromstring(content)
    if root.tag != "TEXT" and "WORDLIST" not in root.tag:
        raise UtterlakeError(f"the root is {root.tag}, neither a text nor a word list")
    rows = []
    for unit in root:
        audio = unit.find("AUDIO")
        if unit.tag in ("S", "W") and audio is not None:
            forms = unit.findall("FORM")
            phonological = [f for f in forms if f.get("kindOf") == "phono"]
            chosen = forms[0] if len(forms) == 1 else phonological[-1] if phonological else None
            text = None if chosen is None else chosen.text
            rows.append((unit.tag, text, float(audio.get("start")), float(audio.get("end")), [t.text for t in unit.findall("TRANSL")]))
    return root.tag, rows


def sentences(spark: SparkSession, root: str, pattern: str = "*.xml") -> DataFrame:
    """Sentences and words of all files below ``root``: times in seconds, all translations; ``error`` per bad file."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                path = _local(path)
                try:
                    tag, rows = parse_sentences(bytes(content))
                    out += [(path, tag, kind, k, text, lo, hi, said, None) for k, (kind, text, lo, hi, said) in enumerate(rows)]
                except (ElementTree.ParseError, UtterlakeError, TypeError, ValueError) as error:
                    out.append((path, None, None, None, None, None, None, None, str(error)))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SENTENCES.split(", ")]).astype({"pos": "Int64"})

    return _files(spark, root, pattern).mapInPandas(parse, _SENTENCES)
