"""Oversized recordings cut into pieces at natural boundaries.

Dynamic programming over boundary positions minimises cut penalties and imbalance of size, under a greatest length and
with a fixed overlap. The periods that utterances cover are merged first (two levels). A recording is solved block by
block, exactly: every block gives the least cost from each place near the end of the block before it to each place near
its own end; these small tables are chained along the recording, and each block then finds its part of the best path.
No task holds more than one block of one recording.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.operators.intervals import gaps_between, merge_periods
from utterlake.session import materialize

LIMIT_MS, OVERLAP_MS = 300_000, 2_000
BLOCK_MS = 4 * 3_600_000
GRID_MS = 5_000  # cuts that no pause offers, and cuts in very long pauses
#: Cost of a cut inside covered time, of a cut in a pause of no length, of any cut, and weight of imbalance.
FORCED, TIGHT, EACH, BALANCE = 100.0, 1.0, 0.05, 0.5
PIECES = "media string, from_ms bigint, to_ms bigint, cut string, stretch_ms bigint"


def cut_positions(lo: int, hi: int, units: list[tuple[int, int, int]], span: int, size: int, grid: int = GRID_MS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions from ``lo`` to before ``hi``, their penalties and the length of the covered stretch each lies in (0: in a pause).

    ``units`` are pauses (0) and covered stretches longer than ``span`` (1) as (start, end, kind) in order, whole even
    where they reach beyond the bounds, so that every block sees the same positions. Pauses offer their edges, their
    middle and, where they are long, a grid; long stretches a grid. 0 and ``size``, the ends, are positions of their own.
    """
    found: dict[int, tuple[float, int]] = {}
    steps = lambda a, past: range(a + grid * max(1, -(-(lo - a) // grid)), min(past, hi), grid)
    for a, b, kind in units:
        if kind:
            for q in steps(a, b):
                found.setdefault(q, (FORCED, b - a))
            continue
        pen, mid = TIGHT / (1 + (b - a) / 1000), (a + b) // 2
        for p, x in ((a, 0.1), (mid, 0.0), (b, 0.1)):
            found.setdefault(p, (pen + x, 0))
        if b - a > 4 * grid:
            for q in (*steps(a, mid - grid // 2), *steps(mid, b - grid + 1)):
                found.setdefault(q, (pen, 0))
    found = {p: x for p, x in found.items() if lo <= p < hi and 0 < p < size}
    found |= {p: (0.0, 0) for p in (0, size) if lo <= p < hi}
    at = np.array(sorted(found), dtype=np.int64)
    return at, np.array([found[int(p)][0] for p in at]), np.array([found[int(p)][1] for p in at], dtype=np.int64)


def ideal_size(size: int, limit: int, overlap: int) -> float:
    """Length of pieces of equal size."""
    return size / (1 + max(1, -(-(size - limit) // (limit - overlap))))


def least_costs(at: np.ndarray, cost: np.ndarray, entries: int, limit: int, overlap: int, ideal: float) -> tuple[np.ndarray, np.ndarray]:
    """Least cost (entries x positions) from each of the first ``entries`` positions to each later one, and the position before it."""
    n, span = len(at), limit - overlap
    best, back = np.full((entries, n), np.inf), np.zeros((entries, n), dtype=np.int64)
    best[np.arange(entries), np.arange(entries)] = 0.0
    firsts = np.searchsorted(at, at - span)
    for j in range(entries, n):
        i = 0 if at[0] == 0 and at[j] <= limit else int(firsts[j])
        if i < j:
            of = best[:, i:j] + BALANCE * ((at[j] - at[i:j] - ideal) / ideal) ** 2
            k = of.argmin(axis=1)
            best[:, j] = of[np.arange(entries), k] + cost[j] + EACH
            back[:, j] = i + k
    return best, back


def _path(back: np.ndarray, at: int, to: int) -> list[int]:
    path = [to]
    while path[-1] != at:
        path.append(int(back[path[-1]]))
    return path[::-1]


def best_cuts(at: np.ndarray, cost: np.ndarray, limit: int, overlap: int) -> list[int]:
    """Indices of the chosen positions, from the first, which is 0, to the last, that minimise penalties and imbalance."""
    if at[-1] <= limit:
        return [0, len(at) - 1]
    return _path(least_costs(at, cost, 1, limit, overlap, ideal_size(int(at[-1]), limit, overlap))[1][0], 0, len(at) - 1)


def recording_pieces(utterances: DataFrame, media: str = "org_media_path", limit_ms: int = LIMIT_MS, overlap_ms: int = OVERLAP_MS, block_ms: int = BLOCK_MS) -> DataFrame:
    """``media, from_ms, to_ms, cut, stretch_ms``: pieces of each recording from 0 to its last end.

    ``cut`` tells where a piece ends: ``pause``, ``forced`` (inside covered time; ``stretch_ms`` is the length of that
    stretch) or ``end``. The price of the cuts does not depend on the length of blocks. Only rows with end after start count, and
    what lies before 0 is clipped. A null recording, null times or an empty table give nothing; ties and repeated rows
    change nothing; other columns are ignored.
    """
    if not 0 <= overlap_ms < limit_ms or block_ms < 2 * limit_ms:
        raise ValueError("the overlap must be less than the limit, and a block at least two limits")
    span = limit_ms - overlap_ms
    rows = utterances.where(F.col(media).isNotNull() & F.col("start_time").isNotNull() & (F.col("end_time") > F.greatest(F.col("start_time"), F.lit(0))))
    rows = rows.select(F.col(media).alias("media"), F.greatest("start_time", F.lit(0)).alias("start_time"), "end_time")
    periods = materialize(merge_periods(rows, ["media"]).select("media", "from_ms", "to_ms"), "coverage")
    sizes = periods.groupBy("media").agg(F.max("to_ms").alias("size"), F.min("from_ms").alias("first"))
    short = sizes.where(F.col("size") <= limit_ms).select("media", F.lit(0).cast("bigint").alias("from_ms"), F.col("size").alias("to_ms"), F.lit("end").alias("cut"), F.lit(0).cast("bigint").alias("stretch_ms"))
    over = materialize(sizes.where(F.col("size") > limit_ms).withColumn("blocks", F.expr(f"size div {block_ms} + 1")), "oversized")
    held = periods.join(over.select("media"), "media", "left_semi")
    pauses = gaps_between(held, ["media"]).select("media", "from_ms", "to_ms").unionByName(over.where("first > 0").select("media", F.lit(0).cast("bigint").alias("from_ms"), F.col("first").alias("to_ms")))
    units = pauses.withColumn("kind", F.lit(0)).unionByName(held.where(F.col("to_ms") - F.col("from_ms") > span).withColumn("kind", F.lit(1)))
    # A block also sees what lies within a limit before it: the places where a piece that ends in it may start.
    units = units.withColumn("block", F.explode(F.expr(f"sequence(from_ms div {block_ms}, (to_ms + {limit_ms}) div {block_ms})")))
    units = units.groupBy("media", "block").agg(F.sort_array(F.collect_list(F.struct("from_ms", "to_ms", "kind"))).alias("u"))
    blocks = over.select("media", "size", F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "blocks").join(units, ["media", "block"], "left")
    blocks = blocks.select("media", "block", "blocks", "size", "u.from_ms", "u.to_ms", F.col("u.kind").alias("kinds"))
    blocks = materialize(blocks.repartition("media", "block"), "blocks")

    def places(block: int, size: int, a, b, kinds) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
        """Number of entries, and the positions of a block with those before it."""
        lo, hi = block * block_ms, (block + 1) * block_ms
        units = [] if a is None else list(zip(map(int, a), map(int, b), map(int, kinds)))
        at, cost, stretch = cut_positions(max(0, lo - limit_ms), hi, units, span, size)
        return int((at < lo).sum()) if block else 1, at, cost, stretch

    def cross(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m, block, count, size, a, b, kinds in batch.itertuples(index=False):
                entries, at, cost, _ = places(block, size, a, b, kinds)
                best, _ = least_costs(at, cost, entries, limit_ms, overlap_ms, ideal_size(size, limit_ms, overlap_ms))
                ends = [len(at) - 1] if block == count - 1 else np.flatnonzero(at >= (block + 1) * block_ms - limit_ms)
                out.append((m, block, entries, np.ascontiguousarray(best[:, ends]).tobytes()))
            yield pd.DataFrame(out, columns=["media", "block", "entries", "costs"])

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of a recording come in order; its best path is known at the last."""

        def chosen(media: str, backs: list[np.ndarray], sofar: np.ndarray) -> list[tuple]:
            way, out = int(sofar.argmin()), []
            for block in range(len(backs) - 1, -1, -1):
                out.append((media, block, int(backs[block][way]), way))
                way = int(backs[block][way])
            return out

        media, backs, sofar = None, [], np.zeros(1)
        for batch in batches:
            out = []
            for m, _, entries, raw in batch.itertuples(index=False):
                if m != media:
                    if media is not None:
                        out += chosen(media, backs, sofar)
                    media, backs, sofar = m, [], np.zeros(1)
                total = sofar[:, None] + np.frombuffer(raw).reshape(entries, -1)
                backs.append(total.argmin(axis=0))
                sofar = total.min(axis=0)
            yield pd.DataFrame(out, columns=["media", "block", "entry", "way"])
        if media is not None:
            yield pd.DataFrame(chosen(media, backs, sofar), columns=["media", "block", "entry", "way"])

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for m, block, count, size, a, b, kinds, entry, way in batch.itertuples(index=False):
                entries, at, cost, stretch = places(block, size, a, b, kinds)
                ends = [len(at) - 1] if block == count - 1 else np.flatnonzero(at >= (block + 1) * block_ms - limit_ms)
                _, back = least_costs(at, cost, entries, limit_ms, overlap_ms, ideal_size(size, limit_ms, overlap_ms))
                path = _path(back[entry], entry, int(ends[way]))
                for i, j in zip(path, path[1:]):
                    inside = int(stretch[j])
                    kind = "end" if at[j] == size else "forced" if inside else "pause"
                    out.append((m, int(max(at[i] - overlap_ms, 0)), int(at[j]), kind, inside))
            yield pd.DataFrame(out, columns=["media", "from_ms", "to_ms", "cut", "stretch_ms"])

    tables = blocks.where("blocks > 1").mapInPandas(cross, "media string, block bigint, entries int, costs binary")
    ways = tables.repartition("media").sortWithinPartitions("media", "block").mapInPandas(chain, "media string, block bigint, entry int, way int")
    ways = ways.unionByName(over.where("blocks = 1").select("media", F.lit(0).cast("bigint").alias("block"), F.lit(0).alias("entry"), F.lit(0).alias("way")))
    found = blocks.join(materialize(ways, "ways"), ["media", "block"]).select("media", "block", "blocks", "size", "from_ms", "to_ms", "kinds", "entry", "way")
    return short.unionByName(found.mapInPandas(cut, PIECES))


def piece_cases(pieces: DataFrame, limit_ms: int = LIMIT_MS) -> DataFrame:
    """``org_media_path, kind``: recordings that were cut (``over``) and those with a cut no pause could take (``forced``)."""
    by = pieces.groupBy("media").agg(F.max("to_ms").alias("size"), F.max(F.when(F.col("cut") == "forced", F.col("stretch_ms")).otherwise(0)).alias("stretch"))
    kinds = F.array_compact(F.array(F.when(F.col("size") > limit_ms, F.lit("over")), F.when(F.col("stretch") > limit_ms, F.lit("forced"))))
    return by.select(F.col("media").alias("org_media_path"), F.explode(kinds).alias("kind"))
