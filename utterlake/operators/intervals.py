"""Continuous periods and gaps of intervals, merged on two levels.

An interval is clipped at the borders of fixed time shards. Pieces merge inside their shard (first level); only
coverage that touches a border is stitched per entity (second level), so an entity with a huge number of intervals
never meets in one task: the second level sees at most three rows for each entity and shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.session import materialize

SHARD_MS = 600_000

def _spread() -> list[Column]:
    """Least and greatest original start and end of what a period is made of."""
    return [F.min("os0").alias("os0"), F.max("os1").alias("os1"), F.min("oe0").alias("oe0"), F.max("oe1").alias("oe1")]


def _coalesce(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Merge rows [ps, pe) of each group ``by`` that overlap or touch."""
    before = W.partitionBy(*by).orderBy("ps", "pe").rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*by).orderBy("ps", "pe").rowsBetween(W.unboundedPreceding, 0)
    end = F.max("pe").over(before)
    return (
        df.withColumn("fresh", F.when(end.isNull() | (F.col("ps") > end), 1).otherwise(0))
        .withColumn("island", F.sum("fresh").over(upto))
        .groupBy(*by, "island")
        .agg(F.min("ps").alias("ps"), F.max("pe").alias("pe"), *_spread())
        .drop("island")
    )


def merge_periods(df: DataFrame, keys: Sequence[str], start: str = "start_time", end: str = "end_time", shard_ms: int = SHARD_MS) -> DataFrame:
    """Periods of each entity ``keys``: columns ``keys``, ``from_ms``, ``to_ms`` and ``single``.

    Periods join if the next starts at or before the end reached so far. ``single`` is true if all intervals of the
    period are the same (start, end). Rows with a null bound or with end not after start give nothing; a null key is
    an entity of its own; repeated rows change nothing; an empty input gives no rows; other columns are ignored.
    Intervals may be of any length: one that covers whole shards is kept as one run of shards, not as a row for each.
    """
    w = F.lit(shard_ms).cast("bigint")
    rows = df.where(F.col(end) > F.col(start)).select(
        F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.col(start).cast("bigint").alias("s"), F.col(end).cast("bigint").alias("e")
    )
    rows = rows.withColumn("a", F.expr(f"s div {shard_ms}") - F.when((F.col("s") < 0) & (F.col("s") % w != 0), 1).otherwise(0)).withColumn(
        "b", F.expr(f"(e - 1) div {shard_ms}") - F.when((F.col("e") - 1 < 0) & ((F.col("e") - 1) % w != 0), 1).otherwise(0)
    )

    def piece(shard: Column, span: bool, lo: Column, hi: Column) -> Column:
        return F.struct(shard.cast("bigint").alias("shard"), F.lit(span).alias("span"), lo.cast("bigint").alias("ps"), hi.cast("bigint").alias("pe"))

    a, b, s, e = F.col("a"), F.col("b"), F.col("s"), F.col("e")
    head, tail, whole = piece(a, False, s, F.least((a + 1) * w, e)), piece(b, False, b * w, e), piece(a + 1, True, (a + 1) * w, b * w)
    pieces = F.when(a == b, F.array(head)).when(b - a == 1, F.array(head, tail)).otherwise(F.array(head, tail, whole))
    local = _coalesce(
        rows.select("k", F.inline(pieces), s.alias("os0"), s.alias("os1"), e.alias("oe0"), e.alias("oe1")), ["k", "shard", "span"]
    )
    local = materialize(local, "periods")
    is_open = F.col("span") | (F.col("ps") == F.col("shard") * w) | (F.col("pe") == (F.col("shard") + 1) * w)
    # Shards under a run of whole shards: what lies inside them belongs to the stitched period.
    closed, spans = local.where(~is_open), local.where("span").select("k", "shard", F.expr(f"pe div {shard_ms} - 1").alias("upto"))
    held = closed.join(spans.select("k").distinct(), "k", "left_semi").select("k", "shard").distinct().withColumn("upto", F.lit(None).cast("bigint"))
    reach = F.max("upto").over(W.partitionBy("k").orderBy("shard").rangeBetween(W.unboundedPreceding, 0))
    under = held.unionByName(spans).select("k", "shard", (reach >= F.col("shard")).alias("under"), F.col("upto").isNull().alias("asked")).where("under AND asked").select("k", "shard")
    inside = closed.join(under, ["k", "shard"], "left_semi").groupBy("k", "shard").agg(F.min("ps").alias("ps"), F.max("pe").alias("pe"), *_spread())
    stitched = _coalesce(local.where(is_open).drop("shard", "span").unionByName(inside.drop("shard")), ["k"])
    closed = closed.join(under, ["k", "shard"], "left_anti").drop("shard", "span")
    return stitched.unionByName(closed).select(
        *[F.col(f"k.k{i}").alias(k) for i, k in enumerate(keys)],
        F.col("ps").alias("from_ms"),
        F.col("pe").alias("to_ms"),
        ((F.col("os0") == F.col("os1")) & (F.col("oe0") == F.col("oe1"))).alias("single"),
    )


def gaps_between(periods: DataFrame, keys: Sequence[str], least_ms: int = 1, shard_ms: int = SHARD_MS) -> DataFrame:
    """Stretches of at least ``least_ms`` between one period's end and the next one's start: ``keys``, ``from_ms``, ``to_ms``.

    ``periods`` are disjoint, as ``merge_periods`` gives them. The next period is looked up inside a time shard first;
    only the first and the last period of each shard meet per entity. Null keys are an entity; an empty input gives no
    rows.
    """
    k = F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(keys)])
    rows = periods.select(k.alias("k"), F.floor(F.col("from_ms") / shard_ms).alias("shard"), F.col("from_ms").alias("ps"), F.col("to_ms").alias("pe"))
    local = W.partitionBy("k", "shard").orderBy("ps")
    rows = rows.select("k", "ps", "pe", F.lead("ps").over(local).alias("after"), F.row_number().over(local).alias("nth"))
    rows = materialize(rows, "gaps")
    edge = rows.where("after IS NULL OR nth = 1")
    edge = edge.select("k", "pe", "after", F.lead("ps").over(W.partitionBy("k").orderBy("ps")).alias("next")).where("after IS NULL").select("k", "pe", F.col("next").alias("after"))
    found = rows.where("after IS NOT NULL").select("k", "pe", "after").unionByName(edge).where(F.col("after") - F.col("pe") >= least_ms)
    return found.select(*[F.col(f"k.k{i}").alias(c) for i, c in enumerate(keys)], F.col("pe").alias("from_ms"), F.col("after").alias("to_ms"))


def periods_and_gaps(df: DataFrame, keys: Sequence[str], gap_ms: int = 5_000, start: str = "start_time", end: str = "end_time", shard_ms: int = SHARD_MS) -> DataFrame:
    """Merged periods and gaps in one table: ``keys``, ``kind``, ``from_ms``, ``to_ms``.

    ``merged``: periods of two or more different intervals; ``gap``: stretches of at least ``gap_ms`` between periods.
    Nulls, ties, repeated rows and empty inputs as in ``merge_periods``.
    """
    periods = materialize(merge_periods(df, keys, start, end, shard_ms), "merged")
    merged = periods.where(~F.col("single")).select(*keys, F.lit("merged").alias("kind"), "from_ms", "to_ms")
    return merged.unionByName(gaps_between(periods, keys, gap_ms, shard_ms).select(*keys, F.lit("gap").alias("kind"), "from_ms", "to_ms"))
