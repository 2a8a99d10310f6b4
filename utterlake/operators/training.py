"""Training logs: epoch error rates, early stopping as window queries, run numbers, corpus lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def epoch_rates(batches: DataFrame) -> DataFrame:
    """``run, epoch, training_ler, last_batch_ler, batches`` of a log of batches (``run, epoch, batch, ler``)."""
    return batches.groupBy("run", "epoch").agg(F.avg("ler").alias("training_ler"), F.max_by("ler", "batch").alias("last_batch_ler"), F.count("*").alias("batches"))


def stopping_points(log: DataFrame, max_epochs: int = 100, min_epochs: int = 0, patience: int = 10, max_train_ler: float = 0.3, max_valid_ler: float = 1.0, start: float = 2.0) -> DataFrame:
    """``run, best_epoch, best_valid_ler, stop_epoch`` of each run's log (``run, epoch, valid_ler, last_batch_ler``).

    An epoch improves if its validation rate is below all before it and below ``start``. Training stops at the first
    epoch that does not improve and is the last allowed, or comes ``patience`` epochs after the best with enough epochs
    and both rates low enough. A run that never stops has a null ``stop_epoch``; epochs after the stop do not count.
    """
    by = W.partitionBy("run").orderBy("epoch")
    before = F.coalesce(F.min("valid_ler").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(start))
    rows = log.withColumn("better", F.col("valid_ler") < F.least(before, F.lit(start)))
    rows = rows.withColumn("nth", F.row_number().over(by))
    best_at = F.max(F.when(F.col("better"), F.col("nth"))).over(by.rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("since", F.col("nth") - F.coalesce(best_at, F.lit(0)))
    quiet = (F.col("since") >= patience) & (F.col("epoch") >= min_epochs) & (F.col("valid_ler") <= max_valid_ler) & (F.col("last_batch_ler") <= max_train_ler)
    rows = rows.withColumn("stops", ~F.col("better") & ((F.col("epoch") >= max_epochs) | quiet))
    rows = rows.withColumn("stop_epoch", F.min(F.when(F.col("stops"), F.col("epoch"))).over(W.partitionBy("run")))
    done = rows.where(F.col("stop_epoch").isNull() | (F.col("epoch") <= F.col("stop_epoch")))
    best = F.when(F.col("better"), F.struct("valid_ler", "epoch"))
    return done.groupBy("run").agg(F.min(best).alias("b"), F.first("stop_epoch").alias("stop_epoch")).select("run", F.col("b.epoch").alias("best_epoch"), F.col("b.valid_ler").alias("best_valid_ler"), "stop_epoch")


def next_run(runs: DataFrame, name: str = "name") -> DataFrame:
    """``next_run``: one more than the greatest number that names a run (before its first dot), 0 if there is none."""
    number = F.substring_index(F.col(name), ".", 1)
    greatest = F.max(F.when(number.rlike(r"^\d+$"), F.try_to_number(number, F.lit("9" * 18)).cast("bigint")))
    return runs.agg((F.coalesce(greatest, F.lit(-1)) + 1).alias("next_run"))


def split_minutes(lengths: DataFrame, hop_ms: int = 10) -> DataFrame:
    """``split, minutes`` of a table ``split, frames``, and a row ``total``."""
    minutes = (F.sum("frames") * F.lit(float(hop_ms)) / 60_000.0).alias("minutes")
    return lengths.rollup("split").agg(minutes, F.grouping("split").alias("g")).select(F.when(F.col("g") == 1, "total").otherwise(F.col("split")).alias("split"), "minutes")
