"""Deterministic train, valid and test splits, and orders by size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.errors import NoPrefixes, UtterlakeError
from utterlake.functions.text import story_of

BUCKETS = 4096


def split_sizes(n: int) -> tuple[int, int, int]:
    """Train, valid and test sizes of ``n`` items: nine tenths, a twentieth, the rest, none of them empty."""
    if n < 3:
        raise NoPrefixes(f"{n} items cannot be split into three groups")
    train = int(0.9 * n)
    valid = int(train + 0.05 * n)
    if valid == n:
        valid -= 1
    if train == valid:
        train -= 1
    return train, valid - train, n - valid


def hash_rank(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    """``df`` with ``rank`` from 0: the place of ``key`` in the order of md5(seed:key), then key.

    Ranks form on two levels: places inside 4096 slices of the hash space, and the sizes of the slices before. Keys
    must differ; no task sees more than a slice.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    rows = df.withColumn("__md5", digest).withColumn("__slice", F.substring("__md5", 1, 3))
    sizes = rows.groupBy("__slice").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.select("__slice", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(W.partitionBy("__slice").orderBy("__md5", key)) - 1
    return rows.withColumn("__nth", nth).join(offsets, "__slice").withColumn("rank", (F.col("__nth") + F.col("__before")).cast("bigint")).drop("__md5", "__slice", "__n", "__nth", "__before")


def divide(prefixes: DataFrame, seed: int = 0, key: str = "prefix") -> DataFrame:
    """``prefixes`` with ``split`` and ``rank``; fewer than three are an error. Prefixes must differ."""
    train, valid, _ = split_sizes(prefixes.count())
    ranked = hash_rank(prefixes, key, seed)
    return ranked.withColumn("split", F.when(F.col("rank") < train, "train").when(F.col("rank") < train + valid, "valid").otherwise("test"))


def complete_splits(prefixes: DataFrame, sizes: DataFrame | None = None, most_frames: int = 1000, train: DataFrame | None = None, valid: DataFrame | None = None, test: DataFrame | None = None, seed: int = 0) -> DataFrame:
    """``prefix, split``: all three lists are taken as they are; none divides what is not too long; valid and test leave
    the rest for training; other combinations are an error."""
    named = [(n, d) for n, d in (("train", train), ("valid", valid), ("test", test)) if d is not None]
    lists = [d.select("prefix", F.lit(n).alias("split")) for n, d in named]
    if len(named) == 3:
        return lists[0].unionByName(lists[1]).unionByName(lists[2])
    fitting = prefixes.select("prefix").distinct()
    if sizes is not None:
        fitting = fitting.join(sizes.where(F.col("frames") <= most_frames).select("prefix"), "prefix", "left_semi")
    if not named:
        return divide(fitting, seed).select("prefix", "split")
    if [n for n, _ in named] != ["valid", "test"]:
        raise UtterlakeError(f"splits given only for {[n for n, _ in named]}")
    held = lists[0].unionByName(lists[1])
    return fitting.join(held, "prefix", "left_anti").select("prefix", F.lit("train").alias("split")).unionByName(held)


def record_type_splits(stories: DataFrame, words: DataFrame, valid: DataFrame, test: DataFrame, train_from: str = "text_and_wordlist") -> DataFrame:
    """Held-out stories for valid and test; training from the other stories, the word lists or both."""
    if train_from not in ("text", "wordlist", "text_and_wordlist"):
        raise UtterlakeError(f"training from {train_from!r} is not supported")
    held = valid.select("prefix", F.lit("valid").alias("split")).unionByName(test.select("prefix", F.lit("test").alias("split")))
    rest = stories.select("prefix").join(held, "prefix", "left_anti")
    train = {"text": rest, "wordlist": words.select("prefix"), "text_and_wordlist": rest.unionByName(words.select("prefix"))}[train_from]
    return train.select("prefix", F.lit("train").alias("split")).unionByName(held)


def story_splits(prefixes: DataFrame, valid_story: str | None, test_story: str | None) -> DataFrame:
    """``prefix, split, split_order``: one story for valid, one for test; both are needed or neither.

    Held-out prefixes are ordered by the number that ends them; training has no order.
    """
    if bool(valid_story) != bool(test_story):
        raise UtterlakeError("a valid story needs a test story and the other way round")
    story = story_of(F.col("prefix"))
    split = F.when(story == F.lit(valid_story), "valid").when(story == F.lit(test_story), "test").otherwise("train")
    number = F.expr("try_cast(substring_index(prefix, '.', -1) AS bigint)")
    return prefixes.select("prefix", split.alias("split")).withColumn("split_order", F.when(F.col("split") != "train", number))


def overlapping(splits: DataFrame) -> DataFrame:
    """Prefixes that stand in more than one split: ``prefix, splits``."""
    return splits.groupBy("prefix").agg(F.size(F.collect_set("split")).cast("bigint").alias("splits")).where("splits > 1")


def ensure_no_overlap(splits: DataFrame) -> None:
    found = overlapping(splits).limit(5).collect()
    if found:
        raise UtterlakeError(f"prefixes in more than one split: {[r['prefix'] for r in found]}")


def filter_by_size(df: DataFrame, most: int, size: str | Column = "frames") -> DataFrame:
    """Rows of at most ``most`` frames."""
    return df.where((F.col(size) if isinstance(size, str) else size) <= most)


def sort_by_size(df: DataFrame, size: str = "frames", ties: Sequence[str] = ("seq",)) -> DataFrame:
    """Ascending by size; ``ties`` keep the earlier order, so the sort is stable."""
    return df.orderBy(size, *ties)
