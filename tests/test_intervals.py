import random

import pytest

from utterlake.operators.intervals import gaps_between, merge_periods, periods_and_gaps

SCHEMA = "m string, s string, start_time bigint, end_time bigint, shard string, k int"


def brute(rows):
    out = set()
    for key in {(r[0], r[1]) for r in rows}:
        some = sorted({(r[2], r[3]) for r in rows if (r[0], r[1]) == key and r[2] is not None and r[3] is not None and r[3] > r[2]})
        merged = []
        for a, b in some:
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
                merged[-1][2] += 1
            else:
                merged.append([a, b, 1])
        out |= {(*key, a, b, n == 1) for a, b, n in merged}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merge_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for _ in range(400):
        a = rng.randrange(-300, 3000)
        rows.append((rng.choice(["a", "b", None]), rng.choice(["x", "y"]), a, a + rng.choice([0, 1, 5, 30, 100, 101, 950]), "extra", 1))
    rows += rows[:30] + [("a", "x", None, 5, None, None), ("a", "x", 5, None, None, None), ("long", "x", -10_000, 10_000, None, None), ("long", "x", -9_000, -8_990, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in merge_periods(df, ["m", "s"], shard_ms=100).collect()}
    assert got == brute(rows)


def test_gaps(spark):
    rows = [("a", "x", 0, 10, None, None), ("a", "x", 10, 20, None, None), ("a", "x", 5020, 5030, None, None), ("a", "x", 10029, 11000, None, None), ("b", "x", 0, 1, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r) for r in periods_and_gaps(df, ["m", "s"], 5000, shard_ms=1000).collect()}
    assert got == {("a", "x", "merged", 0, 20), ("a", "x", "gap", 20, 5020)}
    periods = merge_periods(df, ["m", "s"], shard_ms=1000)
    assert {tuple(r) for r in gaps_between(periods, ["m", "s"], 1, 1000).collect()} == {("a", "x", 20, 5020), ("a", "x", 5030, 10029)}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert periods_and_gaps(df, ["m", "s"]).count() == 0
