"""Label tables: vocabularies, prefixes, what is and is not transcribed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.errors import LabelMismatch, NoPrefixes
from utterlake.functions.arrays import PAD, labels_to_indices
from utterlake.functions.text import stem


def label_tokens(labels: DataFrame, column: str = "labels") -> DataFrame:
    """``labels`` with ``tokens``: the white-space separated tokens of the first line."""
    first = F.substring_index(F.col(column), "\n", 1)
    return labels.withColumn("tokens", F.filter(F.split(first, r"\s+"), lambda t: t != ""))


def label_set(labels: DataFrame, column: str = "labels") -> DataFrame:
    """Distinct labels: ``label``."""
    return label_tokens(labels, column).select(F.explode("tokens").alias("label")).distinct()


def label_vocabulary(labels: DataFrame, column: str = "labels") -> DataFrame:
    """``label, idx``: padding at 0, then the labels in code point order. Bounded by the number of different labels."""
    whole = label_set(labels, column).agg(F.sort_array(F.collect_list("label")).alias("v"))
    return whole.select(F.posexplode(F.concat(F.array(F.lit(PAD)), "v")).alias("idx", "label")).select("label", "idx")


def encode_labels(labels: DataFrame, vocabulary: DataFrame, column: str = "labels") -> DataFrame:
    """``labels`` with ``indices`` of its tokens; an unknown label is an error."""
    lookup = vocabulary.agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "label"))), lambda x: x["label"]).alias("__v"))
    return label_tokens(labels, column).join(F.broadcast(lookup)).withColumn("indices", labels_to_indices(F.col("tokens"), F.col("__v"))).drop("__v")


def check_label_set(found: DataFrame, given: DataFrame, subset: bool = False) -> None:
    """Raise unless the labels found are those given (``subset``: are among them). Both are vocabularies."""
    extra = [r["label"] for r in found.join(given, "label", "left_anti").limit(20).collect()]
    lacking = [] if subset else [r["label"] for r in given.join(found, "label", "left_anti").limit(20).collect()]
    if extra or lacking:
        raise LabelMismatch(f"labels not given: {extra}; labels not found: {lacking}")


def transcribed_prefixes(media: DataFrame, labels: DataFrame) -> DataFrame:
    """Prefixes with both a medium and labels: semi join."""
    return media.select("prefix").distinct().join(labels.select("prefix"), "prefix", "left_semi")


def determine_prefixes(media: DataFrame, labels: DataFrame) -> DataFrame:
    """``transcribed_prefixes`` in order; none is an error."""
    found = transcribed_prefixes(media, labels)
    if found.isEmpty():
        raise NoPrefixes("no prefix has both a medium and labels")
    return found.orderBy("prefix")


def untranscribed_media(media: DataFrame, transcriptions: DataFrame, path: str = "path") -> DataFrame:
    """Media whose stem no transcription has: anti join; repeated media stay repeated."""
    known = transcriptions.select(stem(F.col(path)).alias("prefix")).distinct()
    return media.select(stem(F.col(path)).alias("prefix")).where("prefix IS NOT NULL").join(known, "prefix", "left_anti")


def untranscribed_union(listed: DataFrame, discovered: DataFrame) -> DataFrame:
    """Listed and discovered untranscribed prefixes, each once."""
    return listed.select(F.trim("prefix").alias("prefix")).where("prefix <> ''").unionByName(discovered.select("prefix")).distinct()


def feature_label_paths(prefixes: DataFrame, feat_type: str, label_type: str) -> DataFrame:
    """Paths of the features and labels of each prefix."""
    return prefixes.select("prefix", F.concat(F.lit("feat/"), "prefix", F.lit(f".{feat_type}.npy")).alias("feat_path"), F.concat(F.lit("label/"), "prefix", F.lit(f".{label_type}")).alias("label_path"))
