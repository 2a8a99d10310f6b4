"""The usual path: annotations or a prepared folder to a corpus, its splits, batches, training and scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.errors import DirtyInput, UtterlakeError
from utterlake.functions.text import segment_tonal, stem
from utterlake.operators import batching, features, labels, scoring, splits, training, utterances
from utterlake.operators.model import RecurrentCtc, train, transcribe
from utterlake.schema import TRAIN_LOG
from utterlake.sources import annotations, files
from utterlake.sources.catalog import Catalog


def clean_utterances(rows: DataFrame, segment: Callable[[Column], Column], keep: Column | None = None) -> DataFrame:
    """Filter, drop duplicates, segment, drop empty and too short rows: this order is part of the result."""
    if keep is not None:
        rows = rows.where(keep)
    rows = utterances.remove_duplicates(rows)
    return utterances.remove_blank_or_short(rows.withColumn("text", segment(F.col("text"))))


def sentence_utterances(sentences: DataFrame, label_type: str, media: DataFrame | None = None) -> DataFrame:
    """Utterances of sentence files: tonal labels of each sentence or word, times in ms.

    The prefix is ``TEXT/`` or ``WORDLIST/``, the file's stem and the number of the sentence; sentences without labels go,
    their number stays taken. ``media`` (``stem, path``) gives the recording of a file; without it the path is the
    file's stem. A recording named ``<stem>_HEADMIC`` is preferred.
    """
    name = stem(F.col("path"))
    rows = sentences.where("error IS NULL").select("path", name.alias("stem"), F.when(F.col("root") == "TEXT", "TEXT").otherwise("WORDLIST").alias("kind"), "pos", "start_s", "end_s", segment_tonal(F.coalesce("transcription", F.lit("")), label_type).alias("text"))
    if media is not None:
        plain = media.select(F.regexp_replace("stem", "_HEADMIC$", "").alias("stem"), F.struct(F.when(F.col("stem").endswith("_HEADMIC"), 0).otherwise(1).alias("rank"), "path").alias("m"))
        rows = rows.join(plain.groupBy("stem").agg(F.min("m").alias("m")), "stem").withColumn("medium", F.col("m.path"))
    else:
        rows = rows.withColumn("medium", F.col("stem"))
    prefix = F.concat(F.col("kind"), F.lit("/"), F.concat_ws(".", "stem", F.col("pos").cast("string")))
    ms = lambda c: F.round(F.col(c) * 1000).cast("bigint")
    return rows.where("text <> ''").select(
        F.col("medium").alias("org_media_path"), F.col("path").alias("org_transcription_path"), prefix.alias("prefix"), ms("start_s").alias("start_time"), ms("end_s").alias("end_time"), "text", F.lit(None).cast("string").alias("speaker")
    )


def untranscribed_slices(lengths: DataFrame, seconds: int = 10) -> DataFrame:
    """Ten-second pieces of recordings without transcription: ``prefix, org_media_path, start_time, end_time``."""
    rows = features.fixed_slices(lengths.select("prefix", F.floor("seconds").alias("whole")), "prefix", "whole", seconds)
    return rows.select(F.concat_ws(".", "prefix", F.col("slice").cast("string")).alias("prefix"), F.col("prefix").alias("org_media_path"), (F.col("slice_start") * 1000).alias("start_time"), (F.col("slice_end") * 1000).alias("end_time"))


@dataclass
class Corpus:
    """Tables of a corpus in a catalog: ``utterances, labels, feats, splits``."""

    catalog: Catalog
    label_type: str
    feat_type: str = "fbank"

    @classmethod
    def from_annotations(cls, spark: SparkSession, source: str, target: str, segment: Callable[[Column], Column], label_type: str, tier_prefixes: Sequence[str], keep: Column | None = None, feat_type: str = "fbank", speakers: Sequence[str] | None = None, media: DataFrame | None = None) -> Corpus:
        """Read annotation files, clean, cut audio (if ``media`` has it), extract features and split."""
        corpus = cls(Catalog(spark, target), label_type, feat_type)
        raw = annotations.read_utterances(spark, source, tier_prefixes)
        raw = batching.numbered(raw, ["org_transcription_path", "tier", "n"]).withColumnRenamed("pos", "seq")
        rows = corpus.catalog.save("utterances", utterances.of_speakers(clean_utterances(raw, segment, keep), speakers))
        corpus.catalog.save("labels", rows.select("prefix", F.lit(label_type).alias("label_type"), F.col("text").alias("labels")))
        if media is not None:
            corpus.add_features(features.cut_audio(media, rows))
        corpus.split()
        return corpus

    @classmethod
    def from_sentences(cls, spark: SparkSession, source: str, target: str, label_type: str, feat_type: str = "fbank", media: DataFrame | None = None) -> Corpus:
        """Sentence files; ``media`` (``stem, path, content``) adds features."""
        corpus = cls(Catalog(spark, target), label_type, feat_type)
        rows = corpus.catalog.save("utterances", sentence_utterances(annotations.sentences(spark, source), label_type, media))
        corpus.catalog.save("labels", rows.select("prefix", F.lit(label_type).alias("label_type"), F.col("text").alias("labels")))
        if media is not None:
            corpus.add_features(features.cut_audio(media.select("path", "content"), rows))
        corpus.split()
        return corpus

    @classmethod
    def from_folder(cls, spark: SparkSession, folder: str, target: str, label_type: str, feat_type: str = "fbank") -> Corpus:
        """A prepared folder with ``wav/`` and ``label/``."""
        held = Catalog(spark, folder)
        lacking = [name for name in ("wav", "label") if not held.exists(name)]
        if lacking:
            raise DirtyInput(f"{folder} has no {' and no '.join(lacking)}")
        corpus = cls(Catalog(spark, target), label_type, feat_type)
        found = files.read_labels(spark, f"{folder}/label", label_type)
        wavs = files.read_wavs(spark, f"{folder}/wav")
        both = labels.determine_prefixes(wavs, found)
        corpus.catalog.save("labels", found.join(both, "prefix", "left_semi"))
        corpus.catalog.save("untranscribed", wavs.select("prefix").join(found.select("prefix"), "prefix", "left_anti"))
        corpus.add_features(wavs)
        corpus.split()
        return corpus

    def add_features(self, wavs: DataFrame) -> DataFrame:
        """Only what has no features yet is extracted."""
        if self.catalog.exists("feats"):
            wavs = features.missing_features(wavs, self.catalog.load("feats"))
        files.reject_empty(files.wav_lengths(wavs))
        return self.catalog.append_missing("feats", features.extract_features(features.convert_audio(wavs), self.feat_type))

    def split(self, most_frames: int = 1000, seed: int = 0) -> DataFrame:
        sizes = self.catalog.load("feats").select("prefix", F.col("n_frames").alias("frames")) if self.catalog.exists("feats") else None
        prefixes = self.catalog.load("labels").select("prefix")
        if sizes is not None:
            prefixes = prefixes.join(sizes.select("prefix"), "prefix", "left_semi")
        rows = self.catalog.save("splits", splits.complete_splits(prefixes, sizes, most_frames, seed=seed))
        splits.ensure_no_overlap(rows)
        return rows

    def vocabulary(self) -> list[str]:
        return [r["label"] for r in labels.label_vocabulary(self.catalog.load("labels")).orderBy("idx").collect()]

    def minutes(self) -> DataFrame:
        lengths = self.catalog.load("splits").join(self.catalog.load("feats").select("prefix", F.col("n_frames").alias("frames")), "prefix")
        return training.split_minutes(lengths.select("split", "frames"))

    def examples(self, split: str) -> DataFrame:
        """``prefix, feats, n_frames, indices, ref`` of a split."""
        lab = self.catalog.load("labels")
        rows = labels.encode_labels(lab, labels.label_vocabulary(lab)).select("prefix", "indices", F.col("tokens").alias("ref"))
        kept = self.catalog.load("splits").where(F.col("split") == split).select("prefix")
        return rows.join(kept, "prefix", "left_semi").join(self.catalog.load("feats"), "prefix")


@dataclass
class CorpusReader:
    """Seeded subset of the training rows in batches of similar size; valid and test as one batch each."""

    corpus: Corpus
    num_train: int | None = None
    batch_size: int | None = None
    seed: int = 0

    def train_batches(self) -> DataFrame:
        rows = self.corpus.examples("train")
        sizing = batching.reader_sizing(rows.count(), self.num_train, self.batch_size)
        chosen = batching.sample_rows(rows, sizing.num_train, "prefix", self.seed).drop("rank")
        return batching.shuffled_batches(batching.make_batches(chosen, sizing.batch_size, ["n_frames", "prefix"]), seed=self.seed)

    def held_out(self, split: str) -> DataFrame:
        if split not in ("valid", "test"):
            raise UtterlakeError(f"{split!r} is no held-out split")
        return self.corpus.examples(split).withColumn("batch", F.lit(0))


def evaluate(model: RecurrentCtc, corpus: Corpus, split: str = "test", beam: int = 100) -> DataFrame:
    """Hypotheses and references of a split, saved as ``hyps``, and their mean error rate: ``error_rate, n``."""
    rows = corpus.examples(split)
    hyps = transcribe(model, rows, corpus.vocabulary(), beam)
    saved = corpus.catalog.save("hyps", rows.select("prefix", "ref").join(hyps, "prefix"))
    found = scoring.mean_error_rate(scoring.require_references(saved))
    corpus.catalog.save(f"{split}_score", found)
    return found


def save_run(catalog: Catalog, model: RecurrentCtc, log: list[dict], hyps: DataFrame | None = None) -> int:
    """Keep a run's log, best scores, description and, as ``train`` gives them, hypotheses under the next free number."""
    runs = catalog.load("train_log").select(F.col("run").alias("name")).distinct() if catalog.exists("train_log") else catalog.spark.createDataFrame([], "name string")
    number = training.next_run(runs).first()["next_run"]
    rows = [(str(number), e["epoch"], e["training_ler"], e["valid_ler"], e["last_batch_ler"]) for e in log]
    catalog.append_missing("train_log", catalog.spark.createDataFrame(rows, TRAIN_LOG), "run")
    best = min(log, key=lambda e: (e["valid_ler"], e["epoch"]))
    catalog.describe(f"run_{number}", {**model.description(), "best_epoch": best["epoch"], "best_valid_ler": best["valid_ler"], "best_training_ler": best["training_ler"]})
    if hyps is not None:
        catalog.save(f"run_{number}_hyps", hyps)
    return number


def train_ready(corpus: Corpus, hidden: int = 250, num_layers: int = 2, **stopping) -> tuple[RecurrentCtc, list[dict]]:
    """A small network on all training rows with the batch size their number suggests."""
    rows = corpus.examples("train")
    n = rows.count()
    size = 16 if n >= 512 else 1 if n < 4 else 4 if n < 128 else n // 32
    batched = CorpusReader(corpus, n // size * size, size).train_batches()
    vocabulary = corpus.vocabulary()
    width = features.num_feats(corpus.catalog.load("feats"))
    model = RecurrentCtc(width, len(vocabulary) - 1, num_layers, hidden)
    return train(model, batched, corpus.examples("valid"), vocabulary, **({"min_epochs": 20, "patience": 3} | stopping))
