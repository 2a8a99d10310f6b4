import random

import pytest
from pyspark.sql import functions as F

from utterlake.functions import distance as d

SCHEMA = "ref array<string>, hyp array<string>"


def plain(a, b, sub=1):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (0 if x == y else sub)))
        row = after
    return row[-1]


def pairs(n=120, seed=1):
    rng = random.Random(seed)
    make = lambda: [rng.choice(["a", "bb", "ə", "ʈʂʰ", "😀", "x"]) for _ in range(rng.randrange(0, 14))]
    return [(make(), make()) for _ in range(n)]


def test_literals():
    for a, b, sub, want in (("", "", 1, 0), ("tide", "tile", 1, 1), ("tide", "tile", 2, 2), ("stone", "tones", 1, 2), ([7, 8, 9, 7], [], 1, 4), ([7, 8, 9, 7], [9], 1, 3)):
        assert d.weighted_distance(a, b, replace=lambda x, y: 0 if x == y else sub) == want
    # Costs of one's own: inside the table adding costs delete, along the border insert.
    assert d.weighted_distance("a", "ab", insert=lambda x: 5, delete=lambda x: 2) == 2
    assert d.weighted_distance("", "ab", insert=lambda x: 5, delete=lambda x: 2) == 10


def test_distance_and_alignment(spark):
    given = pairs()
    df = spark.createDataFrame([*given, (None, ["a"]), ([], [])], SCHEMA)
    rows = df.select("ref", "hyp", d.token_distance(F.col("ref"), F.col("hyp")).alias("n"), d.alignment("ref", "hyp").alias("a"), d.cluster_errors(d.alignment("ref", "hyp")).alias("c")).collect()
    for r in rows:
        if r["ref"] is None:
            assert r["n"] is None and r["a"] is None
            continue
        assert r["n"] == plain(r["ref"], r["hyp"])
        assert [x["ref"] for x in r["a"] if x["ref"]] == r["ref"] and [x["hyp"] for x in r["a"] if x["hyp"]] == r["hyp"]
        assert sum(x["ref"] != x["hyp"] for x in r["a"]) == r["n"]
        assert [t for x in r["c"] for t in x["ref"]] == r["ref"] and [t for x in r["c"] for t in x["hyp"]] == r["hyp"]
        assert all(a["ref"] == a["hyp"] or b["ref"] == b["hyp"] for a, b in zip(r["c"], r["c"][1:]))
        assert [(x["ref"], x["hyp"]) for x in r["a"]] == d.align(r["ref"], r["hyp"])


def test_ties_and_costs():
    assert d.align("ab", "ba") == [("a", "b"), ("b", "a")]
    assert d.align("a", "b", replace=lambda x, y: 3 * (x != y)) == [("", "b"), ("a", "")]


def test_many_tokens(spark):
    a, b = [str(k) for k in range(7000)], [str(k) for k in range(1, 7000)]
    assert spark.createDataFrame([(a, b)], SCHEMA).select(d.token_distance(F.col("ref"), F.col("hyp"))).first()[0] == 1


def test_weighted_column(spark):
    given = pairs(40, 5)
    rows = spark.createDataFrame(given, SCHEMA).select(d.weighted_distance_column(3)("ref", "hyp")).collect()
    assert [r[0] for r in rows] == [plain(a, b, 3) for a, b in given]


def test_word_error_rate(spark):
    df = spark.createDataFrame([(["a", "b"], ["a", "c"])], SCHEMA)
    assert df.select(d.word_error_rate(F.col("ref"), F.col("hyp"))).first()[0] == 50.0
    with pytest.raises(Exception, match="reference is empty"):
        spark.createDataFrame([([], ["a"])], SCHEMA).select(d.word_error_rate(F.col("ref"), F.col("hyp"))).collect()
