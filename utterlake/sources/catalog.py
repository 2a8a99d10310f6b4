"""The corpus catalog: tables of a corpus in one folder, text exports, run descriptions, settings."""

from __future__ import annotations

import configparser
import json
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake import __version__
from utterlake.errors import NoPrefixes


@dataclass(frozen=True)
class Settings:
    """Paths; a file's ``[PATHS]`` section overrides the defaults."""

    corpora: str = "./corpora"
    target: str = "./data"
    experiments: str = "./exp"
    word_list: str = "./words.txt"

    @classmethod
    def read(cls, path: str) -> Settings:
        parser = configparser.ConfigParser()
        parser.read(path)
        given = dict(parser["PATHS"]) if parser.has_section("PATHS") else {}
        return cls(**{f.name: given[f.name] for f in fields(cls) if f.name in given})


class Catalog:
    """Parquet tables below one folder; reading prunes columns and pushes filters down as any table does."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def exists(self, name: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return bool(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at))

    def save(self, name: str, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        writer = df.write.mode("overwrite")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(self.path(name))
        return self.load(name)

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def append_missing(self, name: str, df: DataFrame, key: str = "prefix") -> DataFrame:
        """Only rows whose key the table lacks are written."""
        if self.exists(name):
            df.join(self.load(name).select(key), key, "left_anti").write.mode("append").parquet(self.path(name))
            return self.load(name)
        return self.save(name, df)

    def describe(self, name: str, facts: Mapping[str, object]) -> None:
        """A small JSON description beside the tables, with the version."""
        row = json.dumps({"version": __version__, **facts}, ensure_ascii=False, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(self.path(name))

    def description(self, name: str) -> dict:
        return json.loads(self.spark.read.text(self.path(name)).first()[0])


def export_transcriptions(utterances: DataFrame, root: str, extension: str, lazy: bool = False) -> None:
    """One text file per utterance, ``root/prefix.extension``, written from the executors to a shared file system.

    ``lazy`` leaves existing files. Null prefixes or texts are not written.
    """

    def write(rows) -> None:
        import os

        for r in rows:
            path = os.path.join(root, f"{r['prefix']}.{extension}")
            if lazy and os.path.exists(path):
                continue
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as file:
                file.write(r["text"] + "\n")

    utterances.where("prefix IS NOT NULL AND text IS NOT NULL").select("prefix", "text").foreachPartition(write)


def export_prefixes(prefixes: DataFrame, path: str) -> None:
    """A prefix on each line; none is an error."""
    if prefixes.isEmpty():
        raise NoPrefixes(f"no prefixes for {path}")
    prefixes.select("prefix").write.mode("overwrite").text(path)


def story_prefix_names(splits: DataFrame, split: str = "test") -> DataFrame:
    """Base names of a split's prefixes, in its order."""
    return splits.where(F.col("split") == split).orderBy("split_order").select(F.substring_index("prefix", "/", -1).alias("prefix"))
