"""Streaming ingest of utterances: event-time deduplication, windows, sessions and late rows. Additions of this library.

``received_at`` is the event time of the stream. Rows later than the watermark are dropped by the stateful operators;
``late_rows`` finds such rows of a table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DELAY = "1 day"


def utterance_stream(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 1000) -> DataFrame:
    """Parquet files of utterances as they arrive; event times with zone, as watermarks need."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():  # a stream reads folders
        reader, path = reader.option("pathGlobFilter", at.getName()), at.getParent().toString()
    stream = reader.parquet(path)
    return stream.withColumn("received_at", F.col("received_at").cast("timestamp"))


def deduplicated(stream: DataFrame, delay: str = DELAY) -> DataFrame:
    """One row per (start_time, end_time, text) within the watermark; state older than that is let go."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["start_time", "end_time", "text"])


def windowed_counts(stream: DataFrame, width: str = "1 day", slide: str | None = None, delay: str = DELAY) -> DataFrame:
    """Rows and spoken time per speaker and tumbling or sliding window."""
    window = F.window("received_at", width, slide) if slide else F.window("received_at", width)
    rows = stream.withWatermark("received_at", delay).groupBy(window.alias("w"), "speaker")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("end_time") - F.col("start_time")).alias("duration_ms")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "speaker", "n", "duration_ms")


def sessions(stream: DataFrame, gap: str = "30 minutes", delay: str = DELAY) -> DataFrame:
    """Import sessions of each transcription: rows that arrive less than ``gap`` apart."""
    rows = stream.withWatermark("received_at", delay).groupBy(F.session_window("received_at", gap).alias("w"), "org_transcription_path")
    return rows.agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "org_transcription_path", "n")


def late_rows(batch: DataFrame, event: str, order: str = "seq", delay_days: int = 1) -> DataFrame:
    """Rows of a finished table whose event time lies more than ``delay_days`` before one that came earlier in ``order``.

    These are the rows a stream with that watermark would drop. The running maximum of event times forms on two levels:
    inside blocks of ``order``, and over the blocks before. Rows without an event time are never late.
    """
    from pyspark.sql import Window as W

    block = F.floor(F.col(order) / 50_000)
    rows = batch.withColumn("__block", block).withColumn("__at", F.col(event).cast("timestamp"))
    local = F.max("__at").over(W.partitionBy("__block").orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    tops = rows.groupBy("__block").agg(F.max("__at").alias("__top"))
    before = F.max("__top").over(W.partitionBy(F.lit(0)).orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    tops = tops.select("__block", before.alias("__before"))
    seen = F.greatest(F.col("__local"), F.col("__before"))
    rows = rows.withColumn("__local", local).join(tops, "__block")
    return rows.where(F.col("__at") < seen - F.expr(f"INTERVAL {delay_days} DAYS")).select(*batch.columns)


def run_to_folder(stream: DataFrame, folder: str, keys: list[str] | None = None, checkpoint: str | None = None) -> DataFrame:
    """Drain what is there: every batch's changed rows go to a part of ``folder``; the latest row of each key comes back,
    or, without ``keys``, every row that was appended.

    Nothing is held on the driver, and a batch that is run again after a failure replaces its own part.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/parts/{number}")

    writer = stream.writeStream.outputMode("update" if keys else "append").option("checkpointLocation", checkpoint or f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(put).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/parts/*")
    if not keys:
        return rows.drop("__batch")
    others = [c for c in rows.columns if c not in (*keys, "__batch")]
    latest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "__batch").alias("__row"))
    return latest.select(*keys, *[F.col(f"__row.{c}").alias(c) for c in others])
