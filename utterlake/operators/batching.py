"""Batches: sizes, chunks, padding, sparse targets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.errors import UtterlakeError
from utterlake.functions.arrays import zero_pad
from utterlake.operators.splits import hash_rank


def batch_size_for(num_train: Column) -> Column:
    """Batch size by the number of training rows: 16 from 512 on, 1 below 4, 4 below 128, else a thirty-second."""
    return F.when(num_train >= 512, 16).when(num_train < 4, 1).when(num_train < 128, 4).otherwise(F.floor(num_train / 32)).cast("int")


@dataclass(frozen=True)
class Sizing:
    """How many rows to train on and in what batches."""

    num_train: int
    batch_size: int


def reader_sizing(available: int, num_train: int | None = None, batch_size: int | None = None) -> Sizing:
    """Defaults: batches of 64, as many whole batches as there are rows. A number of rows alone sets batches of a
    thirty-second of it, at least 1 and at most 64. Rows that are no whole number of batches are an error."""
    if batch_size is None:
        batch_size = 64 if num_train is None else min(64, max(1, num_train // 32))
    if batch_size < 1:
        raise ValueError("a batch needs at least one row")
    if num_train is None:
        num_train = available // batch_size * batch_size
    if num_train % batch_size:
        raise UtterlakeError(f"{num_train} rows are no whole number of batches of {batch_size}")
    if num_train > available:
        raise UtterlakeError(f"{num_train} rows asked for, {available} there")
    return Sizing(num_train, batch_size)


def numbered(df: DataFrame, order: list[str], block_rows: int = 200_000) -> DataFrame:
    """``df`` with ``pos``, its place from 0 in ``order`` (which must tell rows apart).

    The rows are range-partitioned; each partition counts its rows, and the counts before give each place its offset, so
    no window runs over the whole table.
    """
    parts = max(1, -(-df.count() // block_rows))
    ranged = df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id())
    from utterlake.session import materialize

    ranged = materialize(ranged, "numbered")
    counts = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(W.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    nth = F.row_number().over(W.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__nth", nth).join(offsets, "__part").withColumn("pos", (F.col("__nth") + F.col("__before")).cast("bigint")).drop("__part", "__nth", "__before")


def make_batches(df: DataFrame, batch_size: int, order: list[str]) -> DataFrame:
    """``df`` with ``pos`` and ``batch``: consecutive chunks; the last may be short; size 0 is an error."""
    if batch_size < 1:
        raise ValueError("a batch needs at least one row")
    return numbered(df, order).withColumn("batch", F.expr(f"pos div {batch_size}"))


def sample_rows(df: DataFrame, num_train: int, key: str, seed: int = 0) -> DataFrame:
    """The first ``num_train`` rows in a seeded hash order of ``key``: a sampling operator; the same at every call."""
    return hash_rank(df, key, seed).where(F.col("rank") < num_train)


def shuffled_batches(df: DataFrame, batch: str = "batch", seed: int = 0) -> DataFrame:
    """``df`` with ``batch_order``, a seeded order of its batches."""
    order = hash_rank(df.select(batch).distinct(), batch, seed).select(batch, F.col("rank").alias("batch_order"))
    return df.join(order, batch)


def pad_lengths(df: DataFrame, frames: str = "frames", batch: str = "batch") -> DataFrame:
    """``df`` with ``padded``: the greatest number of frames in its batch."""
    return df.withColumn("padded", F.max(frames).over(W.partitionBy(batch)))


def padded_batches(df: DataFrame, width: int, feats: str = "feats", batch: str = "batch", order: str = "pos") -> DataFrame:
    """One row per batch: ``batch, prefixes, x, lens``; features are padded to the batch's longest.

    A batch is bounded by its size, so a row holds no unbounded group.
    """
    longest = F.max(F.size(feats)).over(W.partitionBy(batch))
    rows = df.withColumn("__x", zero_pad(F.col(feats), longest, width)).select(batch, F.struct(order, "prefix", F.size(feats).alias("len"), F.col("__x").alias("x")).alias("r"))
    rows = rows.groupBy(batch).agg(F.sort_array(F.collect_list("r")).alias("r"))
    return rows.select(batch, F.col("r.prefix").alias("prefixes"), F.col("r.x").alias("x"), F.col("r.len").alias("lens"))


def sparse_targets(df: DataFrame, row: str = "row", indices: str = "indices") -> DataFrame:
    """Coordinates of targets: ``row, pos, value``, one row for each label."""
    return df.select(F.col(row), F.posexplode(indices).alias("pos", "value"))


def dense_shape(sparse: DataFrame, rows: int) -> tuple[int, int]:
    """Rows and width of the dense matrix; targets that are all empty are an error."""
    width = sparse.agg(F.max("pos")).first()[0]
    if width is None:
        raise UtterlakeError("all targets are empty")
    return rows, width + 1


def load_batch(batched: DataFrame, encoded: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Padded features of each batch and sparse targets of its rows, which are joined by prefix."""
    features = padded_batches(batched, width)
    row = F.row_number().over(W.partitionBy("batch").orderBy("pos")) - 1
    targets = batched.select("batch", "pos", "prefix").withColumn("row", row).join(encoded.select("prefix", "indices"), "prefix")
    return features, targets.select("batch", "row", F.posexplode("indices").alias("pos", "value"))
