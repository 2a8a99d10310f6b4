import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake import pipeline
from utterlake.errors import NoPrefixes, UtterlakeError
from utterlake.functions.text import segment_chars
from utterlake.operators import features
from utterlake.operators.model import RecurrentCtc, ctc_beam, ctc_greedy, ctc_loss, transcribe
from utterlake.sources import annotations, catalog, files
from utterlake.streaming import ingest

TIERS = """<?xml version="1.0" encoding="UTF-8"?>
<ANNOTATION_DOCUMENT><HEADER><MEDIA_DESCRIPTOR RELATIVE_MEDIA_URL="./gone.wav"/><MEDIA_DESCRIPTOR RELATIVE_MEDIA_URL="./rec.wav" TIME_ORIGIN="1000"/></HEADER>
<TIME_ORDER><TIME_SLOT TIME_SLOT_ID="t1" TIME_VALUE="500"/><TIME_SLOT TIME_SLOT_ID="t2" TIME_VALUE="900"/><TIME_SLOT TIME_SLOT_ID="t3" TIME_VALUE="0"/><TIME_SLOT TIME_SLOT_ID="t4" TIME_VALUE="400"/></TIME_ORDER>
<TIER TIER_ID="xv@M" PARTICIPANT="Mark"><ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a1" TIME_SLOT_REF1="t1" TIME_SLOT_REF2="t2"><ANNOTATION_VALUE>later</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION>
<ANNOTATION><ALIGNABLE_ANNOTATION ANNOTATION_ID="a2" TIME_SLOT_REF1="t3" TIME_SLOT_REF2="t4"><ANNOTATION_VALUE>first</ANNOTATION_VALUE></ALIGNABLE_ANNOTATION></ANNOTATION></TIER>
<TIER TIER_ID="rf"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a3" ANNOTATION_REF="a2"><ANNOTATION_VALUE>ref</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION></TIER>
<TIER TIER_ID="other"/></ANNOTATION_DOCUMENT>"""
SENTENCES = """<TEXT id="x"><HEADER/><S id="1"><AUDIO start="0.5" end="1.25"/><FORM kindOf="phono">tə˧</FORM><FORM kindOf="ortho">te</FORM><TRANSL xml:lang="fr">oui</TRANSL><TRANSL xml:lang="en">yes</TRANSL></S>
<S id="2"><FORM>silent</FORM></S><W id="3"><AUDIO start="2" end="3"/><FORM>mo</FORM></W></TEXT>"""


def test_tiers(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "rec.eaf").write_text(TIERS, encoding="utf-8")
    with pytest.raises(UtterlakeError, match="no media file"):
        annotations.read_utterances(spark, str(tmp_path), ["xv"])
    (tmp_path / "sub" / "rec.wav").write_bytes(b"")
    rows = {r["prefix"]: r for r in annotations.read_utterances(spark, str(tmp_path), ["xv", "rf"]).collect()}
    assert set(rows) == {"rec.xv@M.0", "rec.xv@M.1", "rec.rf.0"}
    first = rows["rec.xv@M.0"]
    assert (first["start_time"], first["end_time"], first["text"], first["speaker"]) == (1000, 1400, "first", "Mark")
    assert rows["rec.rf.0"]["start_time"] == 1000 and rows["rec.rf.0"]["speaker"] is None
    assert annotations.tier_summary(annotations.tier_annotations(spark, str(tmp_path))).count() == 2


def test_sentences(spark, tmp_path):
    (tmp_path / "a.xml").write_text(SENTENCES, encoding="utf-8")
    (tmp_path / "b.xml").write_text("<OTHER/>", encoding="utf-8")
    rows = annotations.sentences(spark, str(tmp_path)).orderBy("path", "pos").collect()
    good = [r for r in rows if r["error"] is None]
    assert [(r["kind"], r["transcription"], r["start_s"], r["translations"]) for r in good] == [("S", "tə˧", 0.5, ["oui", "yes"]), ("W", "mo", 2.0, [])]
    assert any("neither" in (r["error"] or "") for r in rows)
    media = spark.createDataFrame([("a", "/m/a.wav"), ("a_HEADMIC", "/m/a_HEADMIC.wav")], "stem string, path string")
    found = pipeline.sentence_utterances(annotations.sentences(spark, str(tmp_path)), "phonemes_and_tones", media).orderBy("prefix").collect()
    assert [(r["prefix"], r["start_time"], r["end_time"], r["text"], r["org_media_path"]) for r in found] == [("TEXT/a.0", 500, 1250, "t ə ˧", "/m/a_HEADMIC.wav"), ("TEXT/a.1", 2000, 3000, "m o", "/m/a_HEADMIC.wav")]
    slices = pipeline.untranscribed_slices(spark.createDataFrame([("x", 20.0), ("y", 3.5)], "prefix string, seconds double"))
    assert {(r["prefix"], r["start_time"], r["end_time"]) for r in slices.collect()} == {("x.0", 0, 10000), ("x.1", 10000, 20000), ("x.2", 20000, 30000), ("y.0", 0, 10000)}


def test_files_and_catalog(spark, tmp_path):
    (tmp_path / "label" / "TEXT").mkdir(parents=True)
    (tmp_path / "label" / "TEXT" / "s.1.phonemes").write_text("a b\nignored", encoding="utf-8")
    found = files.read_labels(spark, str(tmp_path / "label"), "phonemes").collect()
    assert [(r["prefix"], r["labels"]) for r in found] == [("TEXT/s.1", "a b")]
    (tmp_path / "p.txt").write_text("foo\nbar \nbaz\n")
    assert [r["prefix"] for r in files.read_prefixes(spark, str(tmp_path / "p.txt")).orderBy("line_no").collect()] == ["foo", "bar", "baz"]
    (tmp_path / "e.txt").write_text("\n")
    with pytest.raises(NoPrefixes):
        files.read_prefixes(spark, str(tmp_path / "e.txt"))
    (tmp_path / "h.txt").write_text("a  b c\n\nd\n")
    assert [r["tokens"] for r in files.read_token_lines(spark, str(tmp_path / "h.txt")).orderBy("line_no").collect()] == [["a", "b", "c"], [], ["d"]]
    store = catalog.Catalog(spark, str(tmp_path / "cat"))
    df = spark.createDataFrame([("a", 1)], "prefix string, n int")
    store.append_missing("t", df)
    assert store.append_missing("t", df.unionByName(spark.createDataFrame([("b", 2)], df.schema))).count() == 2
    store.describe("about", {"hidden": 3})
    assert store.description("about")["hidden"] == 3
    catalog.export_transcriptions(spark.createDataFrame([("d/x.1", "a b"), (None, "c")], "prefix string, text string"), str(tmp_path / "out"), "phonemes")
    assert (tmp_path / "out" / "d" / "x.1.phonemes").read_text() == "a b\n"
    (tmp_path / "s.ini").write_text("[PATHS]\ntarget = /t\n")
    assert catalog.Settings.read(str(tmp_path / "s.ini")).target == "/t"


def brute_ctc(logits, target):
    import itertools

    p = np.exp(logits - np.log(np.exp(logits).sum(axis=1, keepdims=True)))
    blank, total = logits.shape[1] - 1, 0.0
    for path in itertools.product(range(logits.shape[1]), repeat=len(logits)):
        merged = [c for k, c in enumerate(path) if c != blank and (k == 0 or c != path[k - 1])]
        if merged == target:
            total += np.prod([p[t, c] for t, c in enumerate(path)])
    return -np.log(total)


def test_ctc_equals_brute_force():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(5, 4))
    for target in ([1], [1, 1], [2, 1], []):
        loss, grad = ctc_loss(x, target)
        assert loss == pytest.approx(brute_ctc(x, target))
        for t, c in ((0, 0), (2, 3), (4, 1)):
            y = x.copy()
            y[t, c] += 1e-5
            assert (ctc_loss(y, target)[0] - loss) / 1e-5 == pytest.approx(grad[t, c], abs=1e-3)
    sequences = [[], [1], [2], [1, 2], [2, 1], [0], [0, 1], [1, 0], [0, 2], [2, 0]]
    best = min(sequences, key=lambda s: ctc_loss(x, s)[0])
    got = ctc_beam(x, 100, merge_repeated=False)
    assert ctc_loss(x, got)[0] <= ctc_loss(x, best)[0] + 1e-9
    sure = np.full((4, 3), -9.0)
    sure[[0, 1, 2, 3], [1, 1, 2, 0]] = 9
    assert ctc_greedy(sure) == [1, 0] and ctc_beam(sure, 5) == [1, 0]


def test_gradient_of_the_network():
    rng = np.random.default_rng(1)
    model = RecurrentCtc(3, 2, num_layers=2, hidden=4)
    x, target = rng.normal(size=(6, 3)), [1, 2]
    loss, grads = model.gradient(x, target)
    for name in ("0f.wx", "0b.wh", "1f.ci", "1b.co", "0f.cf", "1f.b", "w", "b"):
        flat = model.params[name].reshape(-1)
        k = len(flat) // 2
        kept = flat[k]
        flat[k] = kept + 1e-5
        up = model.gradient(x, target)[0]
        flat[k] = kept
        assert (up - loss) / 1e-5 == pytest.approx(grads[name].reshape(-1)[k], abs=1e-3), name


def test_corpus_end_to_end(spark, tmp_path):
    notes = {"A": 440.0, "B": 660.0, "C": 880.0}
    names = {"train1": "B C", "train2": "A B C", "train3": "C A", "valid": "C", "test1": "A B", "x6": "A", "x7": "B A", "x8": "C C", "x9": "A C", "x10": "B"}
    (tmp_path / "wav").mkdir()
    (tmp_path / "label").mkdir()
    for name, spelled in names.items():
        parts = [np.sin(2 * np.pi * notes[n] * np.arange(3200) / 16000) * 15000 for n in spelled.split()]
        (tmp_path / "wav" / f"{name}.wav").write_bytes(features.write_wav(16000, np.concatenate(parts).astype(np.int16)))
        (tmp_path / "label" / f"{name}.notes").write_text(spelled + "\n")
    (tmp_path / "wav" / "free.wav").write_bytes(features.write_wav(16000, np.ones(1600, dtype=np.int16)))
    corpus = pipeline.Corpus.from_folder(spark, str(tmp_path), str(tmp_path / "cat"), "notes")
    assert corpus.vocabulary() == ["pad", "A", "B", "C"]
    assert {r["split"]: r["count"] for r in corpus.catalog.load("splits").groupBy("split").count().collect()} == {"train": 8, "valid": 1, "test": 1}
    assert [r["prefix"] for r in corpus.catalog.load("untranscribed").collect()] == ["free"]
    assert {r["split"] for r in corpus.minutes().collect()} == {"train", "valid", "test", "total"}
    seen = []
    model, log = pipeline.train_ready(corpus, hidden=5, num_layers=1, min_epochs=1, patience=1, max_epochs=2, callback=seen.append)
    assert len(log) >= 1 and seen[0].keys() == {"epoch", "training_ler", "valid_ler"}
    assert transcribe(model, corpus.examples("test"), corpus.vocabulary()).count() == 1
    assert pipeline.evaluate(model, corpus, beam=5).first()["n"] == 1
    assert pipeline.save_run(corpus.catalog, model, log) == 0 and pipeline.save_run(corpus.catalog, model, log) == 1
    assert corpus.catalog.load("train_log").count() == 2 * len(log) and corpus.catalog.description("run_1")["hidden"] == 5


def test_clean_order(spark):
    rows = spark.createDataFrame([(1, 0, 50, "a b", "s"), (2, 0, 50, "a b", "t"), (3, 0, 10, "abc", "s"), (4, 0, 10, "  ", "s")], "seq bigint, start_time bigint, end_time bigint, text string, speaker string")
    assert [(r["seq"], r["text"]) for r in pipeline.clean_utterances(rows, segment_chars, F.col("speaker") == "s").collect()] == [(1, "a b")]


def test_stream_deduplicates(spark, tmp_path):
    rows = "SELECT * FROM VALUES (1, 0, 5, 'a', 's', TIMESTAMP '2020-01-01 00:00:00'), (2, 0, 5, 'a', 's', TIMESTAMP '2020-01-01 01:00:00'), (3, 0, 6, 'a', 's', TIMESTAMP '2020-01-01 02:00:00') AS t(seq, start_time, end_time, text, speaker, received_at)"
    df = spark.sql(rows)
    df.write.parquet(str(tmp_path / "in"))
    stream = ingest.utterance_stream(spark, str(tmp_path / "in"), df.schema)
    assert ingest.run_to_folder(ingest.deduplicated(stream), str(tmp_path / "out")).count() == 2
