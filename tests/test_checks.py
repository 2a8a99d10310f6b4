import struct

import pytest
from pyspark.sql import functions as F

from utterlake import pipeline
from utterlake.errors import DirtyInput, EmptyReference, UtterlakeError
from utterlake.operators import features, scoring
from utterlake.session import shared_dir


def wav(samples, channels=1):
    data = b"".join(struct.pack("<h", x) for x in samples)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, 8000, 8000 * 2 * channels, 2 * channels, 16) + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"data" + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(body)) + body


def test_header_tells_the_length():
    whole = wav(range(4000), 2)
    assert features.wav_header(whole) == features.wav_header(whole[:80], len(whole)) == (8000, 2000)
    with pytest.raises(UtterlakeError):
        features.wav_header(b"RIFFxxxx")


def test_directories_are_checked(spark, tmp_path):
    (tmp_path / "wav").mkdir()
    with pytest.raises(DirtyInput, match="label"):
        pipeline.Corpus.from_folder(spark, str(tmp_path), str(tmp_path / "out"), "phonemes")


def test_empty_references_are_named(spark):
    rows = spark.createDataFrame([("a", ["x"], ["x"]), ("b", [], ["x"])], "prefix string, ref array<string>, hyp array<string>")
    with pytest.raises(EmptyReference, match="b"):
        scoring.require_references(rows)
    assert scoring.require_references(rows.where(F.size("ref") > 0)).count() == 1


def test_pitch_comes_from_a_table(spark):
    wavs = spark.createDataFrame([("a", wav([k % 50 * 100 for k in range(4000)]))], "prefix string, content binary")
    plain = features.extract_features(wavs).first()
    pitch = spark.createDataFrame([("a", [[1.0, 2.0]] * plain["n_frames"]), ("b", [[0.0, 0.0]])], "prefix string, feats array<array<float>>")
    both = features.extract_features(wavs, "fbank_and_pitch", pitch)
    assert both.first()["n_frames"] == plain["n_frames"] and features.num_feats(both) == 125
    assert features.num_feats(features.extract_features(wavs, "pitch", pitch)) == 2
    with pytest.raises(UtterlakeError):
        features.extract_features(wavs, "pitch")
    with pytest.raises(UtterlakeError):
        features.num_feats(both.where("false"))


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda *a: None)

    class Session:
        conf = Conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(UtterlakeError):
        shared_dir(Session)
