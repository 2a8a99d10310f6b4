import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.errors import LabelMismatch, NoPrefixes, UtterlakeError
from utterlake.functions import arrays
from utterlake.operators import batching, features, labels, scoring, splits, training, utterances

UTTER = "seq bigint, start_time bigint, end_time bigint, text string, speaker string, other string"


def utter(spark, rows):
    return spark.createDataFrame([(*r, "z")[:6] if len(r) == 5 else r for r in rows], UTTER)


def test_duplicates_keep_the_first(spark):
    df = utter(spark, [(3, 1, 2, "t", "a"), (1, 1, 2, "t", "b"), (2, 1, 2, "u", None), (5, 1, None, None, "c"), (4, 1, None, None, "d")])
    assert sorted((r["seq"], r["speaker"]) for r in utterances.remove_duplicates(df).collect()) == [(1, "b"), (2, None), (4, "d")]
    assert utterances.remove_duplicates(utter(spark, [])).count() == 0


def test_filters(spark):
    df = utter(spark, [(1, 1673900, 1673923, " kunkare bu yoh", "a"), (2, 23155, 25965, "Mani mandak karrulkngeyyo.", "a"), (3, 0, 10, " \u001c\t", "b"), (4, 0, 40, "abcd", None), (5, 0, 1, None, None)])
    assert [r["seq"] for r in utterances.remove_too_short(df).orderBy("seq").collect()] == [2, 4]
    assert [r["seq"] for r in utterances.remove_blank_text(df).orderBy("seq").collect()] == [1, 2, 4]
    assert utterances.total_duration(utter(spark, [])).first()[0] == 0
    found = {r["speaker"]: (r["duration_ms"], r["first_seq"]) for r in utterances.speaker_durations(df).collect()}
    assert found == {"a": (2833, 1), "b": (10, 3), None: (41, 4)}
    words = spark.createDataFrame([(" BU ",), (None,)], "word string")
    assert [r["seq"] for r in utterances.not_code_switched(df, words).orderBy("seq").collect()] == [2, 3, 4]


def test_labels(spark):
    lines = spark.createDataFrame([("test1", "phonemes", "ɖ ɯ ɕ i k v̩\nmore"), ("test2", "phonemes", "g v̩ tsʰ i"), ("e", "phonemes", ""), ("n", "phonemes", None)], "prefix string, label_type string, labels string")
    vocabulary = labels.label_vocabulary(lines)
    rows = vocabulary.orderBy("idx").collect()
    assert [r["label"] for r in rows] == ["pad", *sorted({"ɖ", "ɯ", "ɕ", "i", "k", "v̩", "g", "tsʰ"})] and [r["idx"] for r in rows] == list(range(9))
    back = labels.encode_labels(lines, vocabulary).where("prefix = 'test1'").first()["indices"]
    assert [rows[k]["label"] for k in back] == ["ɖ", "ɯ", "ɕ", "i", "k", "v̩"]
    with pytest.raises(Exception, match="unknown label"):
        labels.encode_labels(lines, vocabulary.where("label <> 'i'")).collect()
    given = spark.createDataFrame([("1",), ("2",)], "label string")
    with pytest.raises(LabelMismatch):
        labels.check_label_set(labels.label_set(lines), given)
    labels.check_label_set(given.limit(1), given, subset=True)
    media = spark.createDataFrame([("w/untranscribed1.wav",), ("w/1.wav",)], "path string")
    assert [r["prefix"] for r in labels.untranscribed_media(media, spark.createDataFrame([("l/1.phonemes",)], "path string")).collect()] == ["untranscribed1"]
    with pytest.raises(NoPrefixes):
        labels.determine_prefixes(lines.select("prefix"), lines.where("false"))


def test_split_sizes_and_rules(spark):
    want = {3: (1, 1, 1), 10: (8, 1, 1), 20: (18, 1, 1), 21: (18, 1, 2), 100: (90, 5, 5), 1004: (903, 50, 51), 1024: (921, 51, 52)}
    assert {n: splits.split_sizes(n) for n in want} == want
    with pytest.raises(NoPrefixes):
        splits.split_sizes(2)
    prefixes = spark.range(100).select(F.concat(F.lit("p"), "id").alias("prefix"))
    found = splits.divide(prefixes).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {"train": 90, "valid": 5, "test": 5}
    one, two = prefixes.limit(1), prefixes.orderBy("prefix").limit(3)
    with pytest.raises(UtterlakeError):
        splits.complete_splits(prefixes, train=one)
    rest = splits.complete_splits(prefixes, valid=prefixes.where("prefix = 'p1'"), test=prefixes.where("prefix = 'p2'"))
    assert rest.where("split = 'train'").count() == 98
    with pytest.raises(UtterlakeError):
        splits.ensure_no_overlap(two.select("prefix", F.lit("train").alias("split")).unionByName(two.select("prefix", F.lit("test").alias("split"))))
    with pytest.raises(UtterlakeError):
        splits.story_splits(prefixes, "a", None)


def test_batches(spark):
    four = spark.createDataFrame([(k,) for k in range(4)], "seq bigint")
    for size, want in ((1, 4), (2, 2), (10, 1)):
        assert batching.make_batches(four, size, ["seq"]).select("batch").distinct().count() == want
    with pytest.raises(ValueError):
        batching.make_batches(four, 0, ["seq"])
    assert [r["pos"] for r in batching.numbered(four, ["seq"], block_rows=1).orderBy("seq").collect()] == [0, 1, 2, 3]
    assert batching.reader_sizing(1000) == batching.Sizing(960, 64)
    assert batching.reader_sizing(1000, num_train=96) == batching.Sizing(96, 3)
    with pytest.raises(UtterlakeError):
        batching.reader_sizing(1000, 100, 64)
    rows = spark.createDataFrame([(0, 0, "a", [[1.0], [2.0]]), (0, 1, "b", [[3.0]])], "batch int, pos bigint, prefix string, feats array<array<float>>")
    r = batching.padded_batches(rows, 1).first()
    assert r["lens"] == [2, 1] and r["x"] == [[[1.0], [2.0]], [[3.0], [0.0]]]
    targets = batching.sparse_targets(spark.createDataFrame([(0, [5, 6]), (1, [])], "row int, indices array<bigint>"))
    assert batching.dense_shape(targets, 2) == (2, 2)
    with pytest.raises(UtterlakeError):
        batching.dense_shape(targets.where("false"), 2)
    with pytest.raises(Exception, match="longer"):
        rows.select(arrays.zero_pad(F.col("feats"), F.lit(1), 1)).collect()


def test_scores(spark):
    rows = spark.createDataFrame([("p1", ["a", "b"], ["a"]), ("p2", ["a", "b", "c", "d"], ["a", "x", "c", "d", "e"]), ("p3", ["b"], ["b"])], "prefix string, ref array<string>, hyp array<string>")
    assert scoring.mean_error_rate(rows).first()["error_rate"] == pytest.approx((0.5 + 0.5 + 0) / 3)
    assert scoring.filtered_error_rate(rows.where("false"), F.array(F.lit("a"))).first()["error_rate"] == -1.0
    arrows = scoring.arrow_counts(rows)
    assert scoring.error_types(arrows).first().asDict() == {"substitutions": 1, "deletions": 1, "insertions": 1, "matches": 5}
    assert scoring.confusion(arrows, 2).where("ref = 'b' AND hyp = 'b'").first()["count"] == 1
    with pytest.raises(Exception, match="reference is empty"):
        scoring.mean_error_rate(spark.createDataFrame([("p", [], ["a"])], rows.schema)).collect()
    by = {r["speaker"]: r for r in scoring.error_rate_by_speaker(rows, spark.createDataFrame([("p1", "s"), ("p2", "s"), ("p3", None)], "prefix string, speaker string")).collect()}
    assert by["s"]["n"] == 2 and by[None]["error_rate"] == 0 and by["s"]["all_error_rate"] == pytest.approx(1 / 3)


def brute_stop(log, max_epochs, min_epochs, patience, max_train, max_valid):
    best, since, at = 2.0, 0, None
    for epoch, valid, last in log:
        if valid < best:
            best, since, at = valid, 0, epoch
        else:
            since += 1
            if epoch >= max_epochs or (since >= patience and epoch >= min_epochs and valid <= max_valid and last <= max_train):
                return at, epoch
    return at, None


def test_early_stop_equals_loop(spark):
    rng = np.random.default_rng(0)
    logs = {str(k): [(e + 1, float(rng.random() * 1.5), float(rng.random())) for e in range(int(rng.integers(1, 40)))] for k in range(30)}
    df = spark.createDataFrame([(k, e, v, t) for k, rows in logs.items() for e, v, t in rows], "run string, epoch int, valid_ler double, last_batch_ler double")
    for r in training.stopping_points(df, 30, 5, 3, 0.6, 1.2).collect():
        assert (r["best_epoch"], r["stop_epoch"]) == brute_stop(logs[r["run"]], 30, 5, 3, 0.6, 1.2)
    assert training.next_run(spark.createDataFrame([("0",), ("12.txt",), ("x",), (None,)], "name string")).first()[0] == 13
    assert training.next_run(spark.createDataFrame([], "name string")).first()[0] == 0


def tone(freq, rate=44100, seconds=0.5, channels=1):
    x = (np.sin(2 * np.pi * freq * np.arange(int(rate * seconds)) / rate) * 20000).astype(np.int16)
    return features.write_wav(rate, np.repeat(x[:, None], channels, axis=1))


def test_audio(spark):
    wavs = spark.createDataFrame([("a", bytearray(tone(440))), ("b", bytearray(tone(880, channels=2)))], "prefix string, content binary")
    done = features.convert_audio(wavs)
    rate, samples = features.read_wav(bytes(done.where("prefix = 'b'").first()["content"]))
    assert rate == 16000 and samples.shape == (8000, 1)
    rows = {r["prefix"]: r for r in features.extract_features(done).collect()}
    assert rows["a"]["n_frames"] == 49 and len(rows["a"]["feats"][0]) == 123
    banks = np.array(rows["a"]["feats"])[:, 1:41].mean(axis=0)
    assert banks.argmax() < np.array(rows["b"]["feats"])[:, 1:41].mean(axis=0).argmax()
    assert features.features_of(rate, samples[:, 0], "mfcc13_d").shape == (49, 13, 2)
    with pytest.raises(UtterlakeError):
        features.features_of(16000, np.zeros(0), "fbank")
    x = np.arange(12.0).reshape(-1, 1) ** 2
    df = spark.createDataFrame([("k", i, float(v)) for i, (v,) in enumerate(x)], "k string, f int, v double")
    assert [r["delta"] for r in features.delta_over(df, "k", "f", "v").orderBy("f").collect()] == pytest.approx(features.delta(x)[:, 0].tolist())
    cut = features.cut_audio(spark.createDataFrame([("m", bytearray(tone(440)))], "path string, content binary"), spark.createDataFrame([("m", "u1", 100, 300), ("m", "u2", 5, 5)], "org_media_path string, prefix string, start_time bigint, end_time bigint"))
    assert len(features.read_wav(bytes(cut.first()["content"]))[1]) == 8820 and cut.count() == 1


def test_pitch(spark):
    schema = "prefix string, feats array<array<float>>"
    fb, ok, bad = ([("a", [[1.0], [2.0], [3.0]])], [("a", [[7.0, 8.0], [9.0, 9.0]])], [("a", [[7.0]] * 5)])
    got = features.combine_with_pitch(spark.createDataFrame(fb, schema), spark.createDataFrame(ok, schema)).first()["feats"]
    assert got == [[1.0, 0.0, 0.0], [2.0, 7.0, 8.0], [3.0, 9.0, 9.0]]
    with pytest.raises(Exception, match="differ"):
        features.combine_with_pitch(spark.createDataFrame(fb, schema), spark.createDataFrame(bad, schema)).collect()


def test_collapse_and_one_hot(spark):
    r = spark.range(1).select(arrays.collapse(F.lit([[[1, 2], [3, 4], [5, 6]]])).alias("c"), arrays.one_hot(F.lit([1, 0]), 3).alias("o")).first()
    assert r["c"] == [[1, 3, 5, 2, 4, 6]] and r["o"] == [[0, 1, 0], [1, 0, 0]]
