"""Acoustic models: an interface, a bidirectional recurrent network with CTC in numpy, decoding over tables.

Decoding runs where the features lie, in Arrow batches. Training sums the gradients of each batch over partitions and
steps on the driver, whose memory holds parameters only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.errors import UtterlakeError
from utterlake.session import discard, materialize

BEAM = 100


class AcousticModel(Protocol):
    """Anything that gives (frames x classes) scores; the last class is the blank, class 0 is padding."""

    def logits(self, feats: np.ndarray) -> np.ndarray: ...


def log_softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=-1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=-1, keepdims=True))


def ctc_greedy(logits: np.ndarray) -> list[int]:
    """Best class of each frame, repeats merged, blanks dropped."""
    best, blank = logits.argmax(axis=1), logits.shape[1] - 1
    return [int(c) for k, c in enumerate(best) if c != blank and (k == 0 or c != best[k - 1])]


def ctc_beam(logits: np.ndarray, width: int = BEAM, merge_repeated: bool = True) -> list[int]:
    """Likeliest label sequence by prefix beam search; ``merge_repeated`` then joins equal neighbours."""
    probs, blank = log_softmax(logits), logits.shape[1] - 1
    beams: dict[tuple[int, ...], tuple[float, float]] = {(): (0.0, -np.inf)}  # log mass ending in blank, in a label
    for row in probs:
        after: dict[tuple[int, ...], list[float]] = {}

        def put(prefix: tuple[int, ...], slot: int, mass: float) -> None:
            cell = after.setdefault(prefix, [-np.inf, -np.inf])
            cell[slot] = np.logaddexp(cell[slot], mass)

        likely = np.argsort(-row)[: min(len(row), width)]
        for prefix, (b, n) in beams.items():
            both = np.logaddexp(b, n)
            for c in likely:
                c = int(c)
                if c == blank:
                    put(prefix, 0, both + row[c])
                elif prefix and c == prefix[-1]:
                    put(prefix, 1, n + row[c])
                    put((*prefix, c), 1, b + row[c])
                else:
                    put((*prefix, c), 1, both + row[c])
        ranked = sorted(after.items(), key=lambda x: (-np.logaddexp(*x[1]), x[0]))[:width]
        beams = {p: (c[0], c[1]) for p, c in ranked}
    best = max(beams.items(), key=lambda x: np.logaddexp(*x[1]))[0]
    return [c for k, c in enumerate(best) if not merge_repeated or k == 0 or c != best[k - 1]]


def ctc_loss(logits: np.ndarray, target: list[int]) -> tuple[float, np.ndarray]:
    """Negative log likelihood of ``target`` and its gradient in the logits."""
    y, blank = log_softmax(logits), logits.shape[1] - 1
    path = [blank] + [x for c in target for x in (c, blank)]
    n, frames = len(path), len(y)
    a, b = np.full((frames, n), -np.inf), np.full((frames, n), -np.inf)
    skip = [k > 1 and path[k] != blank and path[k] != path[k - 2] for k in range(n)]
    a[0, : min(2, n)] = y[0, path[: min(2, n)]]
    for t in range(1, frames):
        for k in range(n):
            m = a[t - 1, k]
            if k:
                m = np.logaddexp(m, a[t - 1, k - 1])
            if skip[k]:
                m = np.logaddexp(m, a[t - 1, k - 2])
            a[t, k] = m + y[t, path[k]]
    b[-1, max(0, n - 2) :] = 0.0
    for t in range(frames - 2, -1, -1):
        step = b[t + 1] + y[t + 1, path]
        for k in range(n):
            m = step[k]
            if k + 1 < n:
                m = np.logaddexp(m, step[k + 1])
            if k + 2 < n and skip[k + 2]:
                m = np.logaddexp(m, step[k + 2])
            b[t, k] = m
    total = np.logaddexp.reduce(a[-1, max(0, n - 2) :])
    if not np.isfinite(total):
        raise UtterlakeError("the target does not fit into the frames")
    grad = np.exp(y)
    occupied = np.exp(a + b - total)
    for k, c in enumerate(path):
        grad[:, c] -= occupied[:, k]
    return -float(total), grad


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _lstm(x: np.ndarray, p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict]:
    """One direction of a peephole LSTM over (frames x inputs)."""
    size = len(p["ci"])
    h, c = np.zeros(size), np.zeros(size)
    kept: dict[str, list] = {k: [] for k in ("i", "f", "g", "o", "c", "h", "c0", "h0")}
    drive = x @ p["wx"] + p["b"]
    for t in range(len(x)):
        z = drive[t] + h @ p["wh"]
        zi, zf, zg, zo = np.split(z, 4)
        i, f, g = _sigmoid(zi + p["ci"] * c), _sigmoid(zf + p["cf"] * c + 1.0), np.tanh(zg)
        new = f * c + i * g
        o = _sigmoid(zo + p["co"] * new)
        for k, v in zip(kept, (i, f, g, o, new, o * np.tanh(new), c, h)):
            kept[k].append(v)
        h, c = kept["h"][-1], new
    out = {k: np.array(v) for k, v in kept.items()}
    return out["h"], out | {"x": x}


def _lstm_back(dh: np.ndarray, s: dict, p: dict[str, np.ndarray]) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    grads = {k: np.zeros_like(v) for k, v in p.items()}
    dz = np.zeros((len(dh), p["wx"].shape[1]))
    next_h, next_c = np.zeros(dh.shape[1]), np.zeros(dh.shape[1])
    for t in range(len(dh) - 1, -1, -1):
        i, f, g, o, c, c0 = (s[k][t] for k in ("i", "f", "g", "o", "c", "c0"))
        up, flat = dh[t] + next_h, np.tanh(c)
        do = up * flat * o * (1 - o)
        dc = next_c + up * o * (1 - flat**2) + do * p["co"]
        di, df, dg = dc * g * i * (1 - i), dc * c0 * f * (1 - f), dc * i * (1 - g**2)
        grads["ci"] += di * c0
        grads["cf"] += df * c0
        grads["co"] += do * c
        dz[t] = np.concatenate([di, df, dg, do])
        next_h = dz[t] @ p["wh"].T
        next_c = dc * f + di * p["ci"] + df * p["cf"]
    grads["wx"], grads["wh"], grads["b"] = s["x"].T @ dz, s["h0"].T @ dz, dz.sum(axis=0)
    return dz @ p["wx"].T, grads


@dataclass
class RecurrentCtc:
    """Layers of forward and backward peephole LSTMs, joined, then a linear layer to labels, padding and blank."""

    num_feats: int
    num_labels: int
    num_layers: int = 3
    hidden: int = 250
    seed: int = 0
    params: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.params:
            return
        rng, width = np.random.default_rng(self.seed), self.num_feats
        for layer in range(self.num_layers):
            for way in "fb":
                n = f"{layer}{way}."
                scale = np.sqrt(6 / (width + 5 * self.hidden))
                self.params[n + "wx"] = rng.uniform(-scale, scale, (width, 4 * self.hidden))
                self.params[n + "wh"] = rng.uniform(-scale, scale, (self.hidden, 4 * self.hidden))
                self.params[n + "b"] = np.zeros(4 * self.hidden)
                for peep in ("ci", "cf", "co"):
                    self.params[n + peep] = rng.uniform(-scale, scale, self.hidden)
            width = 2 * self.hidden
        self.params["w"] = rng.normal(0, np.sqrt(1 / width), (width, self.num_labels + 2))
        self.params["b"] = np.zeros(self.num_labels + 2)

    def _part(self, name: str) -> dict[str, np.ndarray]:
        return {k[len(name) :]: v for k, v in self.params.items() if k.startswith(name)}

    def _forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        saved = []
        for layer in range(self.num_layers):
            ahead, s1 = _lstm(x, self._part(f"{layer}f."))
            back, s2 = _lstm(x[::-1], self._part(f"{layer}b."))
            x = np.hstack([ahead, back[::-1]])
            saved.append((s1, s2))
        return x @ self.params["w"] + self.params["b"], [saved, x]

    def logits(self, feats: np.ndarray) -> np.ndarray:
        return self._forward(np.asarray(feats, dtype=np.float64))[0]

    def gradient(self, feats: np.ndarray, target: list[int]) -> tuple[float, dict[str, np.ndarray]]:
        scores, (saved, top) = self._forward(np.asarray(feats, dtype=np.float64))
        loss, d = ctc_loss(scores, target)
        grads = {"w": top.T @ d, "b": d.sum(axis=0)}
        d = d @ self.params["w"].T
        for layer in range(self.num_layers - 1, -1, -1):
            s1, s2 = saved[layer]
            d1, g1 = _lstm_back(d[:, : self.hidden], s1, self._part(f"{layer}f."))
            d2, g2 = _lstm_back(d[:, self.hidden :][::-1], s2, self._part(f"{layer}b."))
            grads |= {f"{layer}f.{k}": v for k, v in g1.items()} | {f"{layer}b.{k}": v for k, v in g2.items()}
            d = d1 + d2[::-1]
        return loss, grads

    def description(self) -> dict:
        return {"num_feats": self.num_feats, "num_labels": self.num_labels, "num_layers": self.num_layers, "hidden": self.hidden, "beam": BEAM}


def batch_gradient(model: RecurrentCtc, rows: DataFrame) -> tuple[float, dict[str, np.ndarray], int]:
    """Mean loss, mean gradient and number of rows (``feats, indices``), summed in the partitions."""
    held = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = 0.0, {}, 0
        for batch in batches:
            for feats, target in zip(batch["feats"], batch["indices"]):
                loss, grads = held.value.gradient(np.stack(list(feats)), [int(c) for c in target])
                total, n = total + loss, n + 1
                for k, v in grads.items():
                    sums[k] = sums[k] + v if k in sums else v
        if n:
            yield pd.DataFrame({"loss": [total], "n": [n], "grads": [pickle.dumps(sums)]})

    parts = rows.select("feats", "indices").mapInPandas(run, "loss double, n bigint, grads binary").collect()  # one row a partition
    n = sum(p["n"] for p in parts)
    if not n:
        raise UtterlakeError("a batch has no rows")
    sums: dict[str, np.ndarray] = {}
    for p in parts:
        for k, v in pickle.loads(p["grads"]).items():
            sums[k] = sums[k] + v if k in sums else v
    return sum(p["loss"] for p in parts) / n, {k: v / n for k, v in sums.items()}, n


def adam(model: RecurrentCtc, grads: dict[str, np.ndarray], state: dict, rate: float = 1e-3, fade: tuple[float, float] = (0.9, 0.999)) -> None:
    """One step of Adam in place; ``state`` keeps its moments."""
    state["t"] = state.get("t", 0) + 1
    for k, g in grads.items():
        m = state[k + ".m"] = fade[0] * state.get(k + ".m", 0) + (1 - fade[0]) * g
        v = state[k + ".v"] = fade[1] * state.get(k + ".v", 0) + (1 - fade[1]) * g * g
        model.params[k] -= rate * m / (1 - fade[0] ** state["t"]) / (np.sqrt(v / (1 - fade[1] ** state["t"])) + 1e-8)


def transcribe(model: AcousticModel, feats: DataFrame, vocabulary: list[str], beam: int = BEAM, merge_repeated: bool = True) -> DataFrame:
    """``prefix, hyp`` for every row of ``feats`` (``prefix, feats``): all batches are decoded."""
    held = feats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prefix, x in zip(batch["prefix"], batch["feats"]):
                scores = held.value.logits(np.stack(list(x)))
                best = ctc_greedy(scores) if beam <= 1 else ctc_beam(scores, beam, merge_repeated)
                out.append((prefix, [vocabulary[c] for c in best if 0 < c < len(vocabulary)]))
            yield pd.DataFrame(out, columns=["prefix", "hyp"])

    return feats.select("prefix", "feats").mapInPandas(run, "prefix string, hyp array<string>")


def train(model: RecurrentCtc, batched: DataFrame, valid: DataFrame, vocabulary: list[str], max_epochs: int = 100, min_epochs: int = 0, patience: int = 10, max_train_ler: float = 0.3, max_valid_ler: float = 1.0, rate: float = 1e-3, beam: int = 1, callback: Callable[[dict], None] | None = None, keep_hyps: Callable[[int, DataFrame], None] | None = None) -> tuple[RecurrentCtc, list[dict]]:
    """Train until the rules of ``training.stopping_points`` stop; the best parameters and the log of epochs.

    ``batched`` holds ``batch, prefix, feats, indices, ref``; ``valid`` holds ``prefix, feats, ref``. Both are written
    once, the batches in their order, so that a batch is read by itself. The training error is that at the end of an
    epoch; ``keep_hyps`` gets the epoch and the decoded validation rows (``prefix, ref, hyp``) of each.
    """
    from utterlake.operators.scoring import mean_error_rate, with_error_rate

    batched = materialize(batched.select("batch", "prefix", "feats", "indices", "ref").repartitionByRange("batch").sortWithinPartitions("batch"), "batches")
    valid = materialize(valid.select("prefix", "feats", "ref"), "valid")
    ids = [r["batch"] for r in batched.select("batch").distinct().orderBy("batch").collect()]
    if not ids:
        raise UtterlakeError("no training batch")
    state, log, best, best_params, since = {}, [], 2.0, None, 0
    for epoch in range(1, 10**9):
        for b in ids:
            adam(model, batch_gradient(model, batched.where(F.col("batch") == b))[1], state, rate)
        told = with_error_rate(batched.select("batch", "prefix", "ref").join(transcribe(model, batched, vocabulary, beam), "prefix"), "skip")
        by_batch = {r["batch"]: r["ler"] for r in told.groupBy("batch").agg(F.avg("error_rate").alias("ler")).collect()}
        rates = [float(by_batch.get(b) or 0.0) for b in ids]
        hyps = valid.select("prefix", "ref").join(transcribe(model, valid, vocabulary, beam), "prefix")
        if keep_hyps:
            hyps = materialize(hyps, "hyps")
            keep_hyps(epoch, hyps)
        valid_ler = float(mean_error_rate(hyps, "skip").first()["error_rate"] or 0.0)
        entry = {"epoch": epoch, "training_ler": float(np.mean(rates)), "valid_ler": valid_ler, "last_batch_ler": rates[-1]}
        log.append(entry)
        if callback:
            callback({k: entry[k] for k in ("epoch", "training_ler", "valid_ler")})
        if entry["valid_ler"] < best:
            best, since, best_params = entry["valid_ler"], 0, {k: v.copy() for k, v in model.params.items()}
            continue
        since += 1
        if epoch >= max_epochs or (since >= patience and epoch >= min_epochs and entry["valid_ler"] <= max_valid_ler and rates[-1] <= max_train_ler):
            break
    if best_params is None:
        raise UtterlakeError("no epoch improved")
    model.params = best_params
    for kept in (batched, valid):
        discard(kept)
    return model, log
