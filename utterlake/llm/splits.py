"""Splits that keep related records together.

Records and what they share form a bipartite graph. Its components come from parallel hooking and shortcutting over a
table of parents; subset-sum bitsets over the multiplicities of component sizes choose the totals of the splits.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.session import discard, materialize

SALT = 16
BUCKETS = 1024


def components(edges: DataFrame, node: str = "node", value: str = "value") -> DataFrame:
    """``node``, ``component`` (its least node) of the graph in which nodes that share a value are tied.

    Each round takes the least parent around each value and hands it to the value's nodes (a value of very many nodes
    is combined before the shuffle and joined under a salt), hooks the old parents to it and shortcuts parents to
    their parents; rounds end when nothing changes. Null nodes are left out, null values tie nothing; a node without
    values is alone; repeated edges change nothing; an empty table gives no rows.
    """
    edges = edges.select(F.col(node).alias("node"), F.col(value).alias("value")).where(F.col("node").isNotNull()).distinct()
    edges = materialize(edges, "edges")
    ties = edges.where("value IS NOT NULL").withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALT)).cast("int"))
    parents = edges.select("node", F.col("node").alias("parent")).distinct()
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    while True:
        around = ties.join(parents, "node").groupBy("value").agg(F.min("parent").alias("least")).withColumn("salt", salts)
        offered = ties.join(around, ["value", "salt"]).groupBy("node").agg(F.min("least").alias("offer"))
        seen = materialize(parents.join(offered, "node", "left").withColumn("offer", F.least("parent", F.coalesce("offer", "parent"))), "offers")
        hooks = seen.where("offer < parent").groupBy(F.col("parent").alias("root")).agg(F.min("offer").alias("hook"))
        hooked = seen.join(hooks, F.col("parent") == F.col("root"), "left").select("node", F.col("parent").alias("old"), F.least("offer", F.coalesce("hook", "parent")).alias("parent"))
        hooked = materialize(hooked, "hooked")
        above = hooked.select(F.col("node").alias("up"), F.col("parent").alias("grand"))
        short = hooked.join(above, F.col("parent") == F.col("up"), "left").select("node", "old", F.least("parent", F.coalesce("grand", "parent")).alias("parent"))
        short = materialize(short, "parents")
        done = short.where("parent < old").isEmpty()
        for old in (seen, hooked):
            discard(old)
        parents = short.select("node", "parent")
        if done:
            return parents.withColumnRenamed("parent", "component")


def ties_of(utterances: DataFrame, persons: DataFrame) -> DataFrame:
    """``node`` (recording), ``value``, ``code``: what ties recordings, persons (with code) and stories.

    ``persons`` are ``label``, ``code`` of labels that name somebody. A recording without ties keeps a null value.
    """
    rows = utterances.where("org_media_path IS NOT NULL").select(
        F.col("org_media_path").alias("node"), F.col("speaker").alias("label"), F.split_part(F.element_at(F.split("prefix", "/"), -1), F.lit("."), F.lit(1)).alias("story")
    )
    rows = rows.groupBy("node", "label", "story").agg(F.count("*").alias("n"))
    rows = materialize(rows, "ties")
    named = rows.where("label IS NOT NULL").select("node", "label").distinct().join(persons, "label").select("node", F.concat(F.lit("p:"), "code").alias("value"), "code")
    stories = rows.select("node", F.concat(F.lit("s:"), "story").alias("value"), F.lit(None).cast("string").alias("code"))
    return named.unionByName(stories).distinct()


def _ones(bits: int) -> np.ndarray:
    """Places of the set bits, in order."""
    held = np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), dtype=np.uint8)
    some = np.flatnonzero(held)
    row, bit = np.nonzero(np.unpackbits(held[some, None], axis=1, bitorder="little"))
    return some[row] * 8 + bit


def choose_totals(sizes: Sequence[tuple[int, int]], shares: Sequence[tuple[str, float]]) -> dict[str, dict[int, int]]:
    """For each split how many components of each size it takes; ``sizes`` are (size, count).

    The split of the largest share takes what remains. The others, from the least share on, take the subset whose total
    is closest to share x all (below wins ties), found among all subset sums up to twice the target. Sizes count in full
    at any total: a bitset holds the sums, and each sum remembers the step that first reached it (two bytes for most
    histograms), which is all that the way back needs. The steps end once the target is met.

    Among the best choices one lies near the share itself of each size: sums of differences of either sign, put in a
    good order, stay within twice the greatest size, so two that are equal could be cut out. So all but a few components
    of each size are taken or left at their share, and the bitset grows with the sizes, not with the number of records.
    """
    left = {int(s): int(n) for s, n in sizes if s > 0 and n > 0}
    total = sum(s * n for s, n in left.items())
    order = sorted(shares, key=lambda x: (x[1], x[0]))
    chosen: dict[str, dict[int, int]] = {}
    for name, share in order[:-1]:
        target = round(share * total)
        unit = math.gcd(*left) or 1  # every sum is a multiple of it, so nothing is rounded
        near = 3 * max((s // unit for s in left if s <= 2 * target), default=0) + len(left) + 1
        sure = {s: max(0, int(share * n) - near) for s, n in left.items() if s <= 2 * target}
        target -= sum(s * n for s, n in sure.items())
        aim, limit = target // unit, 2 * target // unit
        steps: list[tuple[int, int]] = []
        for s in sorted(left, reverse=True):
            n, chunk = min(left[s] - sure.get(s, 0), limit // (s // unit)), 1
            while n > 0:
                k = min(chunk, n)
                steps.append((s, k))
                n, chunk = n - k, chunk * 2
        mask = (1 << (limit + 1)) - 1
        first = np.zeros(limit + 1, dtype=np.min_scalar_type(len(steps)))
        bits = 1
        for step, (s, k) in enumerate(steps):
            grown = bits | (bits << (s // unit * k)) & mask
            first[_ones(grown ^ bits)] = step
            bits = grown
            if target % unit == 0 and bits >> aim & 1:
                break
        low = (bits & ((1 << (aim + 1)) - 1)).bit_length() - 1
        above = bits >> (aim + 1)
        high = aim + 1 + ((above & -above).bit_length() - 1) if above else None
        at = high if high is not None and high * unit - target < target - low * unit else low
        taken = {s: n for s, n in sure.items() if n}
        while at:  # what is left of a sum without its last step was reached before that step
            s, k = steps[int(first[at])]
            taken[s] = taken.get(s, 0) + k
            at -= s // unit * k
        for s, k in taken.items():
            left[s] -= k
            if not left[s]:
                del left[s]
        chosen[name] = taken
    chosen[order[-1][0]] = dict(left)
    return chosen


def assign_splits(members: DataFrame, targets: DataFrame, component: str = "component", weight: str = "n") -> DataFrame:
    """``component``, ``size``, ``split`` so that the splits' shares of the weight are as close as the components allow.

    ``members`` hold a component and a weight per record (null weight: 0). ``targets``: ``split_name``, ``share`` (a
    fixed, small table). Only the histogram of component sizes visits the driver: its rows number less than the square
    root of twice the total weight. Components of one size are ranked by a hash of their name, on two levels.
    """
    whole = members.where(F.col(component).isNotNull()).groupBy(F.col(component).alias("component")).agg(F.coalesce(F.sum(weight), F.lit(0)).cast("bigint").alias("size"))
    whole = materialize(whole.withColumn("bucket", F.pmod(F.xxhash64("component"), F.lit(BUCKETS)).cast("int")), "components")
    shares = [(r["split_name"], float(r["share"])) for r in targets.where("split_name IS NOT NULL AND share IS NOT NULL").collect()]
    histogram = [(r["size"], r["n"]) for r in whole.groupBy("size").agg(F.count("*").alias("n")).collect()]
    chosen = choose_totals(histogram, shares)
    largest = max(shares, key=lambda x: (x[1], x[0]))[0] if shares else None
    quotas = []
    for s, _ in histogram:
        at = 0
        for name, taken in chosen.items():
            if name != largest and taken.get(s):
                quotas.append((s, name, at, at + taken[s]))
                at += taken[s]
    ranges = whole.sparkSession.createDataFrame(quotas, "size bigint, split string, first bigint, past bigint")
    ranges = ranges.groupBy("size").agg(F.collect_list(F.struct("split", "first", "past")).alias("ranges"))
    before = F.sum("k").over(W.partitionBy("size").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offsets = whole.groupBy("size", "bucket").agg(F.count("*").alias("k")).select("size", "bucket", F.coalesce(before, F.lit(0)).alias("offset"))
    ranked = whole.withColumn("nth", F.row_number().over(W.partitionBy("size", "bucket").orderBy("component"))).join(offsets, ["size", "bucket"])
    rank = F.col("nth") - 1 + F.col("offset")
    hit = F.filter("ranges", lambda r: (rank >= r["first"]) & (rank < r["past"]))
    return ranked.join(ranges, "size", "left").select("component", "size", F.coalesce(F.try_element_at(hit, F.lit(1))["split"], F.lit(largest)).alias("split"))
