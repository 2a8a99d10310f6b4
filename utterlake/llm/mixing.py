"""Mixing sources to target shares of tokens.

A classifier fitted on all labelled documents (naive Bayes over table fields and the words of the text, counted in one
distributed pass) predicts for documents without a source how likely each source is. Rates of documents, between 0 and
the repeats allowed to their expected source, are fitted by projected-gradient least squares on the expected tokens of
each source: documents of equal posterior move together, so each step is one pass over a small table that keeps their
rates. Documents are then drawn in the order of a hash until the tokens of their source are reached.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.session import discard, materialize

#: A public tokenizer's ranks and its pattern; see the README of that folder.
RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The fit ends when a step moves less than this share of all tokens. Steps cannot overshoot, so it always does.
TOLERANCE = 1e-4
FIELDS = ("collection", "kind", "lang")
#: Hash space of the classifier's features; strength of the pull of a source's use of a feature to the use in all
#: sources; the number of table fields that a text may outweigh; one labelled document in so many calibrates.
FEATURES, SHRINK, TEXT_WEIGHT, HELD_OUT = 1 << 15, 50.0, 10.0, 20
#: Exponents of the evidence among which calibration on held-out documents chooses; 0 leaves the sources' own shares.
TEMPERATURES = (0.0, 0.1, 0.2, 0.35, 0.5, 0.7, 0.85, 1.0)
#: Posteriors are kept in steps of this size, so that documents that differ by less move together.
STEP = 1 / 64
#: Levels of the hash order inside a source; only rows of one level are put in order.
LEVELS = 1024
_KEPT = 400_000
_ENCODERS: dict = {}
_TERMS: dict[str, int] = {}


def _encoder(path: str):
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        _ENCODERS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def with_tokens(docs: DataFrame, columns: list[str], text: str = "text", ranks: str = RANKS) -> DataFrame:
    """``columns`` of every document and its ``tokens`` in a public tokenizer; a null text has none."""
    rows = docs.select(*columns, F.col(text).alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema) + ", tokens bigint"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks).encode_ordinary
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tokens = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], tokens], [*batch.schema.names[:-1], "tokens"])

    return rows.mapInArrow(count, schema)


def text_features(text: str) -> list[int]:
    """Hashed different words of a text."""
    known = _TERMS
    if len(known) > _KEPT:
        known.clear()
    found = set()
    for word in set(text.split()):
        k = known.get(word)
        if k is None:
            k = known[word] = zlib.crc32(word.lower().encode()) % FEATURES
        found.add(k)
    return sorted(found)


def _field_feature(name: str, value: str | None) -> int:
    return zlib.crc32(f"{name}={'' if value is None else '=' + value}".encode()) % FEATURES


def described(docs: DataFrame, names: list[str], fields: tuple[str, ...] = FIELDS, text: str = "text", ranks: str = RANKS) -> DataFrame:
    """One pass over the texts: every document with its tokens, and the counts that the classifier needs.

    Rows of documents hold ``row, doc_id, source, tokens``, and ``features`` (one for each field, then those of the
    text) where the source is null or, ``held_out``, known but kept for calibration. Rows of counts have no ``row``:
    ``features`` and ``counts`` of one source in one task, ``FEATURES`` standing for the documents themselves.
    """
    rows = docs.select("doc_id", "source", *[F.col(f).cast("string").alias(f"__{f}") for f in fields], F.col(text).alias("__text"))
    key = docs.schema["doc_id"].dataType.simpleString()
    kept = set(names)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at = _encoder(ranks).encode_ordinary, TaskContext.get().partitionId() << 40
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            tokens, features, held = [], [], []
            for source, *values, t in zip(*columns):
                tokens.append(len(encode(t)) if t else 0)
                found = None
                if source is None or source in kept:
                    found = [_field_feature(f, v) for f, v in zip(fields, values)]
                    found += text_features(t) if t else []
                out = source is not None and found is not None and zlib.crc32(repr((values, (t or "")[:200], len(t or ""))).encode()) % HELD_OUT == 0
                held.append(out)
                if found is None or source is None or out:
                    features.append(found)
                    continue
                features.append(None)
                if source not in counts:
                    counts[source] = np.zeros(FEATURES + 1, dtype=np.int64)
                np.add.at(counts[source], found, 1)
                counts[source][FEATURES] += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(at, at + n), pa.int64()), batch.column(0), batch.column(1), pa.array(tokens, pa.int64()), pa.array(held), pa.array(features, pa.list_(pa.int32())), pa.nulls(n, pa.list_(pa.int32()))],
                ["row", "doc_id", "source", "tokens", "held_out", "features", "counts"],
            )
            at += n
            none = pa.nulls(len(counts), batch.schema.field(0).type)
        if counts:
            ids = [np.flatnonzero(c).astype(np.int32) for c in counts.values()]
            values = [c[k].astype(np.int32) for c, k in zip(counts.values(), ids)]
            size = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(size, pa.int64()), none, pa.array(list(counts), pa.string()), pa.nulls(size, pa.int64()), pa.nulls(size, pa.bool_()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.int32()))],
                ["row", "doc_id", "source", "tokens", "held_out", "features", "counts"],
            )

    return rows.mapInArrow(describe, f"row bigint, doc_id {key}, source string, tokens bigint, held_out boolean, features array<int>, counts array<int>")


@dataclass
class SourceModel:
    """Log shares of the sources and log ratios (sources x features) of their use of each feature to that of all."""

    prior: np.ndarray
    ratios: np.ndarray
    fields: int

    def evidence(self, features: np.ndarray) -> np.ndarray:
        """What a document's features say for each source; a text counts as ``TEXT_WEIGHT`` fields at most."""
        own, words = features[: self.fields], features[self.fields :]
        e = self.ratios[:, own].sum(axis=1)
        if len(words):
            e = e + self.ratios[:, words].mean(axis=1) * min(TEXT_WEIGHT, len(words))
        return e

    def posterior(self, features: np.ndarray, temperature: float) -> np.ndarray:
        z = self.prior + temperature * self.evidence(features)
        z = np.exp(z - z.max())
        return z / z.sum()


def fit_sources(rows: DataFrame, names: list[str], fields: int) -> SourceModel:
    """The classifier from the counts in ``rows``; at most sources x features figures visit the driver."""
    counts = rows.where("row IS NULL").select("source", F.explode(F.arrays_zip("features", "counts")).alias("x"))
    counts = counts.groupBy("source", F.col("x.features").alias("feature")).agg(F.sum("x.counts").alias("n")).toPandas()
    held = np.zeros((len(names), FEATURES + 1))
    held[counts["source"].map({s: k for k, s in enumerate(names)}).to_numpy(dtype=np.int64), counts["feature"].to_numpy(dtype=np.int64)] = counts["n"].to_numpy()
    n = held[:, FEATURES]
    overall = held[:, :FEATURES].sum(axis=0) / max(n.sum(), 1)
    ratios = np.zeros((len(names), FEATURES), dtype=np.float32)
    met = overall > 0  # what no labelled document has says nothing
    ratios[:, met] = np.log((held[:, :FEATURES][:, met] + SHRINK * overall[met]) / (n[:, None] + SHRINK) / overall[met])
    return SourceModel(np.log(n + 1e-9) - np.log(n.sum() + 1e-9), ratios, fields)


def source_posteriors(rows: DataFrame, names: list[str], fields: int) -> DataFrame:
    """``row, p``: how likely a document without a source is of each of ``names``, in steps of ``STEP``.

    The exponent of the evidence is the one of ``TEMPERATURES`` that gives held-out documents their own source with the
    greatest likelihood. Without labelled documents every source is as likely as any other.
    """
    model = fit_sources(rows, names, fields)
    held = rows.sparkSession.sparkContext.broadcast(model)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(TEMPERATURES))
        for batch in batches:
            for source, features in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, t in enumerate(TEMPERATURES):
                    total[k] -= np.log(max(held.value.posterior(np.array(features, dtype=np.int64), t)[names.index(source)], 1e-12))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(TEMPERATURES)), pa.int32()), pa.array(total)], ["k", "loss"])

    tried = rows.where("held_out").select("source", "features").mapInArrow(losses, "k int, loss double")
    loss = {r["k"]: r["loss"] for r in tried.groupBy("k").agg(F.sum("loss").alias("loss")).collect()}
    best = TEMPERATURES[min(loss, key=lambda k: (loss[k], k))] if loss else 0.0

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [_stepped(held.value.posterior(np.array(f, dtype=np.int64), best)).tolist() for f in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.list_(pa.float64()))], ["row", "p"])

    return rows.where("row IS NOT NULL AND source IS NULL").select("row", "features").mapInArrow(predict, "row bigint, p array<double>")


def _stepped(p: np.ndarray) -> np.ndarray:
    """``p`` in whole steps that sum to 1: what rounding down leaves over goes to the largest remainders."""
    whole = np.floor(p / STEP)
    left = int(round(1 / STEP - whole.sum()))
    whole[np.argsort(whole * STEP - p, kind="stable")[:left]] += 1
    return whole * STEP


def reachable(shares: list[float], capacity: list[float], total: float) -> list[float]:
    """Tokens that each source aims at. A source that cannot reach its share gives all it may; the others make up for
    it in proportion to their own shares, so the mix keeps its size while they can."""
    aims, open_ = list(capacity), [k for k, s in enumerate(shares) if s > 0]
    wanted = total * sum(shares)
    for k, s in enumerate(shares):
        if s <= 0:
            aims[k] = 0.0
    while open_:
        left = wanted - sum(aims[k] for k, s in enumerate(shares) if s > 0 and k not in open_)
        each = left / sum(shares[k] for k in open_)
        full = [k for k in open_ if shares[k] * each > capacity[k]]
        if not full:
            for k in open_:
                aims[k] = shares[k] * each
            break
        open_ = [k for k in open_ if k not in full]
    return aims


@dataclass
class Fit:
    """Documents with their rates, and the plan per source."""

    docs: DataFrame
    plan: DataFrame
    names: list[str]


def _dot(values: list[float]) -> str:
    """SQL of the product of ``p`` with ``values``."""
    return f"aggregate(zip_with(p, array({', '.join(f'{float(v)!r}D' for v in values)}), (a, b) -> a * b), 0D, (a, b) -> a + b)"


def fit_mix(docs: DataFrame, targets: DataFrame, ranks: str = RANKS, fields: tuple[str, ...] = FIELDS) -> Fit:
    """Rates of all documents by projected-gradient least squares.

    ``docs`` of the result has ``row, doc_id, source, tokens, p, rate``; ``plan`` has for each source of ``targets``
    (a small table) its ``target_share, max_repeats, tokens, capacity, target_tokens``, the ``aimed_tokens`` that its own
    documents and those without a source can reach, ``expected_tokens`` of all and ``fitted_tokens`` of its own.
    """
    goals = [(r["source"], float(r["target_share"] or 0), int(r["max_repeats"] or 0)) for r in targets.where("source IS NOT NULL").orderBy("source").collect()]
    names, shares, repeats = ([g[k] for g in goals] for k in range(3))
    size = len(names)
    rows = materialize(described(docs, names, fields, ranks=ranks), "described")
    own = dict.fromkeys(names, 0)
    total = 0
    for r in rows.where("row IS NOT NULL").groupBy(F.when(F.col("source").isin(names), F.col("source")).alias("source")).agg(F.sum("tokens").alias("n")).collect():
        total += r["n"]
        if r["source"] is not None:
            own[r["source"]] = r["n"]
    schema = "source string, target_share double, max_repeats int, tokens bigint, capacity bigint, target_tokens double, aimed_tokens double, expected_tokens double, fitted_tokens double"
    kept = rows.where("row IS NOT NULL").select("row", "doc_id", "source", "tokens")
    if not names:
        none = kept.select("*", F.array().cast("array<double>").alias("p"), F.lit(0.0).alias("rate"))
        return Fit(none, docs.sparkSession.createDataFrame([], schema), names)
    soft = materialize(source_posteriors(rows, names, len(fields)), "posteriors")
    unnamed = kept.where("source IS NULL").join(soft, "row")
    one = [[float(i == k) for i in range(size)] for k in range(size)]
    hard = docs.sparkSession.createDataFrame([(one[k], int(own[names[k]])) for k in range(size)], "p array<double>, tokens bigint")
    groups = hard.unionByName(unnamed.groupBy("p").agg(F.sum("tokens").alias("tokens"))).groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens"))
    groups = materialize(groups.selectExpr("p", "tokens", f"{_dot(repeats)} AS most", "0D AS rate"), "rates")
    per = lambda weight: [f"coalesce(sum(p[{k}] * tokens * {weight}), 0D)" for k in range(size)]
    totals = lambda table, weight: list(table.selectExpr(f"array({', '.join(per(weight))}) AS x").first()["x"])
    mass, most = totals(groups, "1D"), totals(groups, "most")
    aims = reachable(shares, most, total)
    reached = [0.0] * size
    while True:
        # A step of one in the metric of the documents' tokens is never longer than the inverse of the curvature.
        step = [(x - a) / m if m > 0 else 0.0 for x, a, m in zip(reached, aims, mass)]
        before, old = reached, groups
        groups = materialize(groups.selectExpr("p", "tokens", "most", f"greatest(0D, least(most, rate - {_dot(step)})) AS rate"), "rates")
        reached = totals(groups, "rate")
        discard(old)
        if sum(abs(x - y) for x, y in zip(reached, before)) <= TOLERANCE * max(total, 1):
            break
    alone = {tuple(r["p"]).index(1.0): r["rate"] for r in groups.where("array_max(p) = 1").collect()}  # one row for each source
    fitted = [float(alone.get(k, 0.0)) for k in range(size)]
    plan = [(names[k], shares[k], repeats[k], int(own[names[k]]), int(own[names[k]]) * repeats[k], shares[k] * total, aims[k], reached[k], fitted[k] * own[names[k]]) for k in range(size)]
    rates = docs.sparkSession.createDataFrame([(names[k], one[k], fitted[k]) for k in range(size)], "source string, p array<double>, rate double")
    named = kept.where("source IS NOT NULL").join(F.broadcast(rates), "source", "left")  # a row for each source of the small table
    named = named.select("row", "doc_id", "source", "tokens", F.coalesce("p", F.lit([0.0] * size)).alias("p"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
    unnamed = unnamed.join(groups.select("p", "rate"), "p").select("row", "doc_id", "source", "tokens", "p", "rate")
    return Fit(named.unionByName(unnamed), docs.sparkSession.createDataFrame(plan, schema), names)


def draw(fit: Fit) -> DataFrame:
    """``doc_id, source, tokens, rate, repeats, p``: whole repeats of every document.

    Everybody gets the rate rounded down; one more goes to documents in the order of a hash of doc_id (divided by the
    rest of the rate) until the tokens that the rests stand for are reached, to within half a document in each source.
    Rows are summed on levels of that order first, so only those of the level in which the sum is reached are sorted.
    """
    stratum = F.coalesce("source", F.concat(F.lit("\u0000"), F.array_position("p", F.array_max("p")).cast("string")))
    rest = F.col("rate") - F.floor("rate")
    hash_ = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("\u0000"), F.col("row").cast("string")))), F.lit(1_000_003)) / 1_000_003.0
    rows = materialize(fit.docs, "rated").withColumn("stratum", stratum).withColumn("rest", rest).withColumn("place", F.when(F.col("rest") > 0, hash_ / F.col("rest")))
    rows = rows.withColumn("level", F.floor(F.col("place") / (1 + F.col("place")) * LEVELS))
    levels = rows.where("rest > 0").groupBy("stratum", "level").agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rest")).alias("w"))
    along = W.partitionBy("stratum").orderBy("level")
    levels = levels.withColumn("upto", F.sum("t").over(along)).withColumn("want", F.sum("w").over(W.partitionBy("stratum")))
    edges = levels.where("upto >= want").groupBy("stratum").agg(F.min("level").alias("edge"), F.min_by(F.col("want") - F.col("upto") + F.col("t"), "level").alias("need"))
    rows = rows.join(F.broadcast(edges), "stratum", "left")  # at most two rows for each source of the small table
    columns = ["doc_id", "source", "tokens", "rate"]
    sure = rows.where("edge IS NULL OR level IS NULL OR level <> edge").select(*columns, F.when(F.col("level") < F.col("edge"), 1).otherwise(0).alias("more"), "p")
    running = F.sum("tokens").over(W.partitionBy("stratum").orderBy("place", "doc_id", "row").rowsBetween(W.unboundedPreceding, 0))
    border = rows.where("level = edge").select(*columns, F.when(running - F.col("tokens") / 2 <= F.col("need"), 1).otherwise(0).alias("more"), "p")
    return sure.unionByName(border).select(*columns, (F.floor("rate") + F.col("more")).cast("int").alias("repeats"), "p")


def mix_sources(docs: DataFrame, targets: DataFrame, ranks: str = RANKS, fields: tuple[str, ...] = FIELDS) -> tuple[DataFrame, DataFrame]:
    """The mix (``doc_id, source, tokens, rate, repeats``) and its report per source of ``targets``.

    The report has the columns of the plan (see ``fit_mix``), the ``drawn_tokens`` of the source's own documents, the
    ``unlabelled_tokens`` of documents without a source that count for it by posterior, and ``aimed_share`` and
    ``actual_share`` of the mix. A source aims at its share of the tokens of all documents; what a source lacks is made
    up by the others in proportion to their shares. Documents of sources outside ``targets`` are not drawn; a target
    without documents draws nothing; null shares and repeats count as 0; null texts hold no tokens; repeated rows count
    each; an empty table gives an empty mix and zeros.
    """
    fit = fit_mix(docs, targets, ranks, fields)
    mix = materialize(draw(fit), "mix")
    size = len(fit.names)
    repeated = F.col("tokens") * F.col("repeats")
    soft = mix.where("source IS NULL").selectExpr(*[f"coalesce(sum(p[{k}] * tokens * repeats), 0D) AS s{k}" for k in range(size)], "count(*) AS n").first()
    unlabelled = docs.sparkSession.createDataFrame([(n, float(soft[k])) for k, n in enumerate(fit.names)], "source string, unlabelled_tokens double")
    drawn = mix.where("source IS NOT NULL").groupBy("source").agg(F.sum(repeated).cast("bigint").alias("drawn_tokens"))
    report = fit.plan.join(drawn, "source", "left").withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0).cast("bigint"))).join(unlabelled, "source")
    whole = W.partitionBy(F.lit(0))  # one row for each source
    share = lambda c: F.coalesce(F.try_divide(c, F.sum(c).over(whole)), F.lit(0.0))
    report = report.withColumn("aimed_share", share(F.col("aimed_tokens"))).withColumn("actual_share", share(F.col("drawn_tokens") + F.col("unlabelled_tokens")))
    return mix.drop("p"), report


def short_sources(plan: DataFrame) -> DataFrame:
    """``source``: those whose documents, repeated as often as allowed, hold fewer tokens than their share.

    The fit gives the candidates: sources whose own documents stay below the share at their fitted rates, among them all
    whose rates ended at the repeats allowed. An exact check of the capacity leaves those that cannot do better.
    """
    return plan.where(F.col("fitted_tokens") < F.col("target_tokens")).where(F.col("capacity") < F.col("target_tokens")).select("source")
