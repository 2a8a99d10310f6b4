"""Audio features: framing, filter banks, cepstra and deltas in numpy, in Arrow batches; windows of recordings in SQL."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.errors import UtterlakeError

WINDOW_S, HOP_S, EMPHASIS, CEPSTRA, LIFTER = 0.025, 0.01, 0.97, 13, 22
TYPES = ("fbank", "mfcc13_d", "fbank_and_pitch", "pitch")


def wav_header(content: bytes, length: int | None = None) -> tuple[int, int]:
    """Rate and number of samples a channel from the chunks before the sound; ``length`` is that of the whole file."""
    length = len(content) if length is None else length
    at, fmt = 12, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", content[at + 8 : at + 24])
        elif name == b"data" and fmt is not None:
            return fmt[2], min(size, length - at - 8) // max(1, fmt[1] * fmt[5] // 8)
        at += 8 + size + size % 2
    rate, samples = read_wav(content)  # no usual header: say what is wrong with it
    return rate, len(samples)


def read_wav(content: bytes) -> tuple[int, np.ndarray]:
    """Rate and samples (frames x channels) of uncompressed PCM in a RIFF container."""
    if len(content) < 12 or content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        raise UtterlakeError("not a RIFF/WAVE file")
    at, fmt, data = 12, None, b""
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt ":
            fmt = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if fmt is None or fmt[0] not in (1, 0xFFFE):
        raise UtterlakeError("not uncompressed PCM")
    _, channels, rate, _, _, bits = fmt
    kinds = {8: np.uint8, 16: "<i2", 32: "<i4"}
    if bits not in kinds:
        raise UtterlakeError(f"{bits} bits a sample are not supported")
    kind = np.dtype(kinds[bits])
    whole = len(data) // (kind.itemsize * channels) * kind.itemsize * channels
    samples = np.frombuffer(data[:whole], dtype=kind).reshape(-1, channels)
    return rate, samples if bits != 8 else samples.astype(np.int16) - 128


def write_wav(rate: int, samples: np.ndarray) -> bytes:
    """16-bit PCM in a RIFF container."""
    samples = samples.reshape(len(samples), -1)
    body, channels = samples.astype("<i2").tobytes(), samples.shape[1]
    out = io.BytesIO()
    out.write(b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * channels * 2, channels * 2, 16))
    out.write(b"data" + struct.pack("<I", len(body)) + body)
    return out.getvalue()


def mono_16k(rate: int, samples: np.ndarray, target: int = 16_000) -> np.ndarray:
    """Channels averaged and the rate changed by linear interpolation; an approximation of an audio converter."""
    mono = samples.astype(np.float64).mean(axis=1)
    if rate == target or not len(mono):
        return np.round(mono).astype(np.int16)
    n = round(len(mono) * target / rate)
    if rate > target:  # a moving mean over one new sample keeps what would fold over
        k = max(1, round(rate / target))
        mono = np.convolve(mono, np.ones(k) / k, mode="same")
    return np.round(np.interp(np.arange(n) * rate / target, np.arange(len(mono)), mono)).astype(np.int16)


def _frames(signal: np.ndarray, rate: int) -> np.ndarray:
    """Overlapping windows of the emphasised signal, the last one filled with zeros."""
    size, hop = int(WINDOW_S * rate + 0.5), int(HOP_S * rate + 0.5)
    sharp = np.append(signal[:1], signal[1:] - EMPHASIS * signal[:-1]).astype(np.float64)
    count = 1 if len(sharp) <= size else 1 + -(-(len(sharp) - size) // hop)
    sharp = np.append(sharp, np.zeros(max(0, (count - 1) * hop + size - len(sharp))))
    return np.lib.stride_tricks.sliding_window_view(sharp, size)[::hop][:count]


def _power(signal: np.ndarray, rate: int) -> np.ndarray:
    frames = _frames(signal, rate)
    n = 512
    while n < frames.shape[1]:
        n *= 2
    return np.abs(np.fft.rfft(frames, n)) ** 2 / n


def _mel_banks(filters: int, bins: int, rate: int) -> np.ndarray:
    """Triangular filters, evenly spaced in mel from 0 to half the rate."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), filters + 2)
    at = np.floor((2 * (bins - 1) + 1) * 700 * (10 ** (mel / 2595) - 1) / rate)
    banks, k = np.zeros((filters, bins)), np.arange(bins)
    for f in range(filters):
        lo, mid, hi = at[f : f + 3]
        up, down = (k >= lo) & (k < mid), (k >= mid) & (k < hi)
        banks[f, up] = (k[up] - lo) / (mid - lo)
        banks[f, down] = (hi - k[down]) / (hi - mid)
    return banks


def _positive(x: np.ndarray) -> np.ndarray:
    return np.where(x <= 0, np.finfo(float).eps, x)


def mfcc(rate: int, signal: np.ndarray) -> np.ndarray:
    """13 liftered cepstra a frame, the first replaced by the log energy."""
    power = _power(signal, rate)
    filters = 26
    log = np.log(_positive(power @ _mel_banks(filters, power.shape[1], rate).T))
    n = np.arange(filters)
    basis = np.cos(np.pi * np.outer(np.arange(CEPSTRA), n + 0.5) / filters) * np.sqrt(2 / filters)
    basis[0] /= np.sqrt(2)
    cepstra = (log @ basis.T) * (1 + LIFTER / 2 * np.sin(np.pi * np.arange(CEPSTRA) / LIFTER))
    cepstra[:, 0] = np.log(_positive(power.sum(axis=1)))
    return cepstra


def delta(feats: np.ndarray, n: int = 2) -> np.ndarray:
    """Regression slopes over ``n`` frames on either side, edges repeated."""
    wide = np.pad(feats, ((n, n), (0, 0)), mode="edge")
    steps = np.arange(-n, n + 1)
    return sum(k * wide[n + k : n + k + len(feats)] for k in steps) / (steps**2).sum()


def fbank(rate: int, signal: np.ndarray) -> np.ndarray:
    """Log energy and 40 log mel filters: 41 features a frame."""
    power = _power(signal, rate)
    return np.hstack([mfcc(rate, signal)[:, :1], np.log(_positive(power @ _mel_banks(40, power.shape[1], rate).T))])


def features_of(rate: int, signal: np.ndarray, feat_type: str) -> np.ndarray:
    """Frames x features (x channels): ``fbank`` is (T, 123) flat, ``mfcc13_d`` is (T, 13, 2)."""
    if len(signal) == 0:
        raise UtterlakeError("empty wav")
    if feat_type == "fbank":
        x = fbank(rate, signal)
        return np.hstack([x, delta(x), delta(delta(x))])
    if feat_type == "mfcc13_d":
        x = mfcc(rate, signal)
        return np.stack([x, delta(x)], axis=2)
    raise UtterlakeError(f"features {feat_type!r} cannot be extracted from audio alone" if feat_type in TYPES else f"unknown feature type {feat_type!r}")


def extract_features(wavs: DataFrame, feat_type: str = "fbank", pitches: DataFrame | None = None) -> DataFrame:
    """``prefix, n_frames, feats`` of ``wavs`` (``prefix``, ``content``); three-dimensional features are flattened per frame.

    ``fbank_and_pitch`` and ``pitch`` take the pitch from ``pitches`` (``prefix, feats``), since it is not extracted here.
    """
    if feat_type in ("fbank_and_pitch", "pitch"):
        if pitches is None:
            raise UtterlakeError(f"features {feat_type!r} need a table of pitches")
        rows = pitches.join(wavs.select("prefix"), "prefix", "left_semi")
        rows = combine_with_pitch(extract_features(wavs), rows) if feat_type == "fbank_and_pitch" else rows
        return rows.select("prefix", F.size("feats").cast("bigint").alias("n_frames"), "feats")
    if feat_type not in ("fbank", "mfcc13_d"):
        raise UtterlakeError(f"unknown feature type {feat_type!r}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prefix, content in zip(batch["prefix"], batch["content"]):
                rate, samples = read_wav(bytes(content))
                x = features_of(rate, samples[:, 0], feat_type)
                x = x.reshape(len(x), -1).astype(np.float32)
                out.append((prefix, len(x), list(x)))
            yield pd.DataFrame(out, columns=["prefix", "n_frames", "feats"])

    return wavs.select("prefix", "content").mapInPandas(run, "prefix string, n_frames bigint, feats array<array<float>>")


def num_feats(feats: DataFrame) -> int:
    """Width of the features of a corpus; a corpus without any frame is an error."""
    first = feats.where(F.size("feats") > 0).select(F.size(F.col("feats")[0]).alias("n")).first()
    if first is None:
        raise UtterlakeError("no features")
    return int(first["n"])


def missing_features(wavs: DataFrame, feats: DataFrame) -> DataFrame:
    """Only what has no features yet."""
    return wavs.join(feats.select("prefix"), "prefix", "left_anti")


def combine_with_pitch(fbanks: DataFrame, pitches: DataFrame) -> DataFrame:
    """Filter banks and pitch side by side: ``prefix, feats``; both hold ``feats`` per prefix.

    Pitch may lack up to two frames, which are filled with zeros in front; any other difference is an error.
    """
    both = fbanks.select("prefix", F.col("feats").alias("f")).join(pitches.select("prefix", F.col("feats").alias("p")), "prefix")
    lacking = F.size("f") - F.size("p")
    zero = F.array_repeat(F.transform(F.col("p")[0], lambda x: F.lit(0.0).cast("float")), F.greatest(lacking, F.lit(0)))
    wrong = F.raise_error(F.concat(F.lit("frames of filter banks and pitch differ: "), F.col("prefix"))).cast("array<array<float>>")
    joined = F.zip_with("f", F.concat(zero, "p"), lambda a, b: F.concat(a, b))
    return both.select("prefix", F.when((lacking < 0) | (lacking > 2), wrong).otherwise(joined).alias("feats"))


def delta_over(series: DataFrame, key: str, frame: str, value: str, n: int = 2) -> DataFrame:
    """``series`` with ``delta`` of ``value``: the same slopes as ``delta``, as a window over frames; edges repeat."""
    by = W.partitionBy(key).orderBy(frame)
    whole = by.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)  # one value for all frames of a key
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    total = sum(F.lit(k) * (F.coalesce(F.lead(value, k).over(by), last) - F.coalesce(F.lag(value, k).over(by), first)) for k in range(1, n + 1))
    return series.withColumn("delta", total / F.lit(2.0 * sum(k * k for k in range(1, n + 1))))


def fixed_slices(recordings: DataFrame, key: str, length: str, size: int = 10) -> DataFrame:
    """Tumbling slices of each recording: ``key, slice, slice_start, slice_end``; one more than whole slices fit."""
    rows = recordings.where(F.col(length) >= 0).select(key, F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col(length) / size))).alias("slice"))
    return rows.select(key, "slice", (F.col("slice") * size).alias("slice_start"), ((F.col("slice") + 1) * size).alias("slice_end"))


def cut_audio(wavs: DataFrame, utterances: DataFrame, path: str = "org_media_path") -> DataFrame:
    """PCM of each utterance's interval: ``prefix, content`` of 16-bit wav; joined with ``wavs`` (``path``, ``content``).

    Intervals travel to their recording as one array per file part of at most 512 intervals, so that a recording is
    decoded once for many and no row grows without bound.
    """
    part = F.floor((F.row_number().over(W.partitionBy(path).orderBy("start_time", "prefix")) - 1) / 512)
    cuts = utterances.where("end_time > start_time").withColumn("__part", part).groupBy(path, "__part").agg(F.collect_list(F.struct("prefix", "start_time", "end_time")).alias("cuts"))
    rows = cuts.join(wavs.select(F.col("path").alias(path), "content"), path).select("content", "cuts")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content, some in zip(batch["content"], batch["cuts"]):
                rate, samples = read_wav(bytes(content))
                parts = [(c["prefix"], write_wav(rate, samples[c["start_time"] * rate // 1000 : c["end_time"] * rate // 1000])) for c in some]
                yield pd.DataFrame(parts, columns=["prefix", "content"])

    return rows.mapInPandas(run, "prefix string, content binary")


def convert_audio(wavs: DataFrame) -> DataFrame:
    """``prefix, content`` with 16 kHz mono 16-bit audio."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([(p, write_wav(16_000, mono_16k(*read_wav(bytes(c))))) for p, c in zip(batch["prefix"], batch["content"])], columns=["prefix", "content"])

    return wavs.select("prefix", "content").mapInPandas(run, "prefix string, content binary")
