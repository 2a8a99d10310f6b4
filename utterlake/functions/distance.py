"""Edit distance, alignment and error rates of token sequences."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

_PAIRS = ArrayType(StructType([StructField("ref", StringType()), StructField("hyp", StringType())]))
_PRIVATE = 0xE000


#: One code point for each different token of a pair; pairs of more tokens compute theirs.
_ALPHABET = "".join(map(chr, range(_PRIVATE, 0xF900)))


def token_distance(ref: Column, hyp: Column) -> Column:
    """Unit-cost edit distance of two token arrays, in the JVM.

    Tokens are numbered within the pair and written as one private-use code point each, so that the native string
    distance counts tokens. Null if either is null.
    """

    def pair(p: Column) -> Column:
        few = F.size(p["both"]) <= len(_ALPHABET)
        short = lambda t: F.substr(F.lit(_ALPHABET), F.array_position(p["both"], t).cast("int"), F.lit(1))
        long = lambda t: _code_point(F.array_position(p["both"], t))
        coded = lambda tokens: F.when(few, F.array_join(F.transform(tokens, short), "")).otherwise(F.array_join(F.transform(tokens, long), ""))
        return F.levenshtein(coded(p["ref"]), coded(p["hyp"])).cast("bigint")

    # A lambda over one element binds the pair's tokens once; written inline they would be gathered for every token.
    bound = F.array(F.struct(F.array_distinct(F.concat(ref, hyp)).alias("both"), ref.alias("ref"), hyp.alias("hyp")))
    return F.transform(bound, pair)[0]


def _code_point(n: Column) -> Column:
    """A string of one code point for n from 1 on; UTF-8 bytes, beyond the surrogates."""
    n = n + _PRIVATE
    two = lambda x: F.lpad(F.hex(x), 2, "0")
    three = F.concat(two(F.lit(0xE0) + F.shiftright(n, 12)), two(F.lit(0x80) + F.shiftright(n, 6).bitwiseAND(63)), two(F.lit(0x80) + n.bitwiseAND(63)))
    return F.decode(F.unhex(three), "UTF-8")


def word_error_rate(ref: Column, hyp: Column) -> Column:
    """Edit distance in percent of the reference's length; an empty reference is an error."""
    empty = F.raise_error(F.lit("the reference is empty")).cast("double")
    return F.when(F.size(ref) == 0, empty).otherwise(F.lit(100.0) * token_distance(ref, hyp) / F.size(ref))


def weighted_distance(source: Sequence, target: Sequence, insert: Callable = lambda x: 1, delete: Callable = lambda x: 1, replace: Callable = lambda x, y: int(x != y)) -> int:
    """Edit distance with costs of one's own.

    Consuming a source element costs ``insert(element)``, adding a target element costs ``delete(element)`` inside the
    table and ``insert(element)`` along its border; costs are whole numbers.
    """
    row = [0]
    for t in target:
        row.append(row[-1] + int(insert(t)))
    for s in source:
        step = int(insert(s))
        after = [row[0] + step]
        for j, t in enumerate(target):
            after.append(min(row[j + 1] + step, row[j] + int(replace(s, t)), after[j] + int(delete(t))))
        row = after
    return row[-1]


def align(source: Sequence[str], target: Sequence[str], insert: Callable | None = None, delete: Callable | None = None, replace: Callable | None = None) -> list[tuple[str, str]]:
    """Pairs of aligned elements, the empty string for a gap.

    Among equal costs a pair beats consuming a source element, which beats adding a target element. Moving down costs
    ``insert(target element)``, moving right ``delete(source element)``; the borders cost one each.
    """
    m, n = len(source), len(target)
    down = [1] * n if insert is None else [insert(t) for t in target]
    right = [1] * m if delete is None else [delete(s) for s in source]
    cost = np.zeros((m + 1, n + 1))
    cost[0], cost[:, 0] = np.arange(n + 1), np.arange(m + 1)
    move = np.zeros((m + 1, n + 1), dtype=np.int8)  # 0 pair, 1 source, 2 target
    move[0, 1:], move[1:, 0] = 2, 1
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            change = int(source[i - 1] != target[j - 1]) if replace is None else replace(source[i - 1], target[j - 1])
            options = (cost[i - 1, j - 1] + change, cost[i - 1, j] + down[j - 1], cost[i, j - 1] + right[i - 1])
            best = min(range(3), key=options.__getitem__)
            cost[i, j], move[i, j] = options[best], best
    pairs = []
    while m or n:
        step = move[m, n]
        m, n = m - (step != 2), n - (step != 1)
        pairs.append((source[m] if step != 2 else "", target[n] if step != 1 else ""))
    return pairs[::-1]


def align_units(source: Sequence[str], target: Sequence[str]) -> list[tuple[str, str]]:
    """``align`` with unit costs, a row of the table at a time."""
    m, n = len(source), len(target)
    code = {t: k for k, t in enumerate(dict.fromkeys([*source, *target]))}
    t = np.array([code[x] for x in target], dtype=np.int64)
    along = np.arange(n + 1)
    cost = np.zeros((m + 1, n + 1), dtype=np.int64)
    cost[0] = along
    for i in range(1, m + 1):
        row = cost[i - 1] + 1
        row[1:] = np.minimum(row[1:], cost[i - 1, :-1] + (t != code[source[i - 1]]))
        cost[i] = np.minimum.accumulate(row - along) + along
    pairs = []
    while m or n:
        if m and n and cost[m, n] == cost[m - 1, n - 1] + (source[m - 1] != target[n - 1]):
            m, n = m - 1, n - 1
            pairs.append((source[m], target[n]))
        elif m and cost[m, n] == cost[m - 1, n] + 1:
            m -= 1
            pairs.append((source[m], ""))
        else:
            n -= 1
            pairs.append(("", target[n]))
    return pairs[::-1]


@F.pandas_udf(_PAIRS)
def alignment(ref: pd.Series, hyp: pd.Series) -> pd.Series:
    """``align_units`` over columns, in Arrow batches; null if either is null."""
    return pd.Series([None if r is None or h is None else [{"ref": a, "hyp": b} for a, b in align_units(list(r), list(h))] for r, h in zip(ref, hyp)])


def weighted_distance_column(replace_cost: int) -> Callable[[Column, Column], Column]:
    """Column function of the edit distance in which changing an element costs ``replace_cost``."""

    @F.pandas_udf(LongType())
    def distance(ref: pd.Series, hyp: pd.Series) -> pd.Series:
        change = lambda x, y: 0 if x == y else replace_cost
        return pd.Series([None if r is None or h is None else weighted_distance(list(r), list(h), replace=change) for r, h in zip(ref, hyp)], dtype="Int64")

    return distance


def cluster_errors(pairs: Column) -> Column:
    """Alignment with each run of mismatches merged to one (ref tokens, hyp tokens); matches stay alone; gaps go."""
    empty = F.array().cast("array<struct<ref:array<string>,hyp:array<string>,ok:boolean>>")
    solid = lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(F.array(x))

    def add(done: Column, pair: Column) -> Column:
        ok = pair["ref"] == pair["hyp"]
        one = F.struct(solid(pair["ref"]).alias("ref"), solid(pair["hyp"]).alias("hyp"), ok.alias("ok"))
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(F.concat(last["ref"], one["ref"]).alias("ref"), F.concat(last["hyp"], one["hyp"]).alias("hyp"), F.lit(False).alias("ok"))
        merge = ~ok & (F.size(done) > 0) & ~F.coalesce(last["ok"], F.lit(True))
        return F.when(merge, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))).otherwise(F.concat(done, F.array(one)))

    return F.transform(F.aggregate(pairs, empty, add), lambda x: F.struct(x["ref"].alias("ref"), x["hyp"].alias("hyp")))
