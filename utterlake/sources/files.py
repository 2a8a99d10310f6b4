"""Label directories, prefix lists, token lines, word lists and audio headers as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.errors import NoPrefixes, UtterlakeError


def _relative(spark: SparkSession, root: str):
    """Path below ``root`` without its last suffix."""
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    full = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toUri().getPath().rstrip("/")
    inner = F.regexp_replace(F.col("path"), r"^file:/*", "/")
    return F.regexp_replace(F.substring_index(inner, full + "/", -1), r"\.[^./]*$", "")


def read_labels(spark: SparkSession, root: str, label_type: str) -> DataFrame:
    """``prefix, label_type, labels`` of the files below ``root`` whose name ends with ``label_type``; first lines only."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{label_type}").load(root)
    text = F.decode("content", "UTF-8")
    return files.select(_relative(spark, root).alias("prefix"), F.lit(label_type).alias("label_type"), F.substring_index(text, "\n", 1).alias("labels"))


def media_prefixes(spark: SparkSession, root: str, suffix: str = "wav") -> DataFrame:
    """``prefix, path, size`` of the media below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{suffix}").load(root)
    return files.select(_relative(spark, root).alias("prefix"), "path", F.col("length").alias("size"))


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """``prefix, line_no`` of a list, stripped; an empty list is an error."""
    rows = read_lines(spark, path).select(F.trim("value").alias("prefix"), "line_no").where("prefix <> ''")
    if rows.isEmpty():
        raise NoPrefixes(f"{path} holds no prefix")
    return rows


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``value, line_no`` of one text file; numbered from 0 within the file, which is read whole."""
    text = spark.read.option("wholetext", "true").text(path).select(F.regexp_replace("value", r"\r?\n$", "").alias("value"))
    return text.select(F.posexplode(F.split("value", r"\r?\n")).alias("line_no", "value")).select("value", F.col("line_no").cast("bigint").alias("line_no"))


def read_token_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, tokens``: one sequence a line, as hypotheses and references are stored."""
    return read_lines(spark, path).select("line_no", F.filter(F.split("value", r"\s+"), lambda t: t != "").alias("tokens"))


def read_word_list(spark: SparkSession, path: str) -> DataFrame:
    """``word`` of a list with a word on each line; never fetched from elsewhere."""
    return spark.read.text(path).select(F.lower(F.trim("value")).alias("word")).where("word <> ''").distinct()


def read_wavs(spark: SparkSession, root: str) -> DataFrame:
    """``prefix, path, content`` of the wav files below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)
    return files.select(_relative(spark, root).alias("prefix"), F.regexp_replace("path", r"^file:/*", "/").alias("path"), "content")


def wav_lengths(wavs: DataFrame) -> DataFrame:
    """``prefix, rate, n_samples, seconds, empty`` from the headers of ``wavs`` (``prefix, content``)."""
    from utterlake.operators.features import wav_header

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prefix, head, length in zip(batch["prefix"], batch["head"], batch["length"]):
                rate, samples = wav_header(bytes(head), length)
                out.append((prefix, rate, samples, samples / rate, samples == 0))
            yield pd.DataFrame(out, columns=["prefix", "rate", "n_samples", "seconds", "empty"])

    head = F.substring("content", 1, 1 << 16)  # the sound itself stays where it is
    return wavs.select("prefix", head.alias("head"), F.length("content").alias("length")).mapInPandas(run, "prefix string, rate int, n_samples bigint, seconds double, empty boolean")


def reject_empty(lengths: DataFrame) -> DataFrame:
    """``lengths``; an empty recording is an error."""
    bad = [r["prefix"] for r in lengths.where("empty").select("prefix").limit(5).collect()]
    if bad:
        raise UtterlakeError(f"empty recordings: {bad}")
    return lengths
