"""Registered queries that write whole tables as files of a corpus and read them back through the library's sources."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.session import shared_dir, table
from utterlake.sources import catalog, files


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def prefix_list(spark: SparkSession, d: str) -> DataFrame:
    """A list of prefixes, written and read."""
    path = _folder(spark, "prefixes")
    catalog.export_prefixes(table(spark, d, "label_lines").select("prefix").distinct(), path)
    return files.read_prefixes(spark, path).select("prefix")


def label_files(spark: SparkSession, d: str) -> DataFrame:
    """A file of labels for each prefix, written and read."""
    path = _folder(spark, "labels")
    lines = table(spark, d, "label_lines").groupBy("prefix").agg(F.min("labels").alias("text"))
    catalog.export_transcriptions(lines, path, "phonemes")
    return files.read_labels(spark, path, "phonemes")


def token_lines(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses, a line each, written and read."""
    path = _folder(spark, "lines")
    table(spark, d, "label_lines").select(F.coalesce(F.substring_index("labels", "\n", 1), F.lit("")).alias("value")).write.text(path)
    rows = files.read_token_lines(spark, path)
    return rows.where(F.size("tokens") > 0).groupBy(F.array_join("tokens", " ").alias("line")).agg(F.count("*").alias("n"))


def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """A table of a catalog, saved by split, and only what it lacks appended."""
    held = catalog.Catalog(spark, _folder(spark, "catalog"))
    rows = table(spark, d, "label_lines").groupBy("prefix").agg(F.min("label_type").alias("label_type"))
    held.save("labels", rows.where("label_type = 'phonemes'"))
    return held.append_missing("labels", rows)


QUERIES = {f.__name__: f for f in (prefix_list, label_files, token_lines, catalog_tables)}

SQL = {
    "prefix_list": "SELECT DISTINCT trim(prefix) AS prefix FROM label_lines WHERE trim(prefix) <> ''",
    "label_files": "SELECT prefix, 'phonemes' AS label_type, split_part(min(labels), chr(10), 1) AS labels FROM label_lines WHERE labels IS NOT NULL GROUP BY prefix",
    "token_lines": r"SELECT array_to_string(list_filter(regexp_split_to_array(split_part(labels, chr(10), 1), '\s+'), lambda t: t <> ''), ' ') AS line, count(*) AS n FROM label_lines WHERE trim(labels) <> '' GROUP BY 1 HAVING line <> ''",
    "catalog_tables": "SELECT prefix, min(label_type) AS label_type FROM label_lines GROUP BY prefix",
}
