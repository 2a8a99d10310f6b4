"""Subject areas of documents: sentence evidence, then a chain of calibrated classifiers decoded by beam search.

A term model, fitted by expectation maximisation on labelled documents, gives every sentence its subject; the shares of
sentences are structure features beside the document's terms, source and kind. Classifiers in a chain, each seeing the
labels before it, model which subjects occur together; their probabilities are calibrated on held-out folds and a beam
search finds the likeliest combination of subjects.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from utterlake.llm.langid import _HAS_HAN, NAME, PieceModel, _core, fit_from_tables
from utterlake.llm.unify import fold_lookalikes
from utterlake.session import materialize

NONE = "none"
#: Labelled documents used for fitting and terms in them, at most (those of the least hash of doc_id); hash space of terms.
MOST_LABELLED, MOST_LABELLED_TERMS, TERMS = 20_000, 16_000_000, 1 << 18
#: A document is about a subject in at least this share of its sentences; width of the beam.
SHARE, BEAM = 0.25, 8
EM_ROUNDS, STRAY, SHRINK, FEW = 15, 0.03, 60.0, 3.0
_CUT = re.compile(r"[.!?。！？]+[\"'”’)\]]*|\n\s*\n|\n(?=\s*(?:[A-Z0-9À-ÞŊƏͰ-Ͽ一-鿿'ʼ(\[]))")
_CUT_TONES = re.compile(r"[.!?。！？]+[\"'”’)\]]*|\n")
_TONES = re.compile("[˥˧˩]")
_INITIAL = re.compile(r"(?:^|\s)[^\W\d_㐀-䶿一-鿿豈-﫿]$")


class SentenceTerms:
    """Sentences of folded texts as hashed terms: words in lower case, Chinese by pairs of characters."""

    KEPT = 400_000

    def __init__(self, keep_words: bool = False) -> None:
        self.known: dict[str, tuple[int, ...]] = {}
        self.words: dict[int, str] | None = {} if keep_words else None

    def _new(self, token: str) -> tuple[int, ...]:
        found: list[int] = []
        if _HAS_HAN.search(token):
            for run in re.findall("[㐀-䶿一-鿿豈-﫿]+", token):
                found += [zlib.crc32(run[k : k + 2].encode()) % TERMS for k in range(max(1, len(run) - 1))]
        else:
            word = _core(unicodedata.normalize("NFC", token)).lower()
            if word and any(c.isalpha() for c in word):
                found.append(zlib.crc32(word.encode()) % TERMS)
                if self.words is not None:
                    self.words.setdefault(found[0], word)
        if self.words is not None and _HAS_HAN.search(token):
            self.words |= dict.fromkeys(found, "的")
        if len(token) < 40:
            if len(self.known) > self.KEPT:
                self.known.clear()
            self.known[token] = tuple(found)
        return tuple(found)

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Terms in order and the number of terms of each sentence; sentences without terms are left out.

        A lone letter before a full stop is an initial and belongs to what follows.
        """
        terms: list[int] = []
        sizes: list[int] = []
        known, before = self.known, 0
        for sentence in (_CUT_TONES if _TONES.search(text) else _CUT).split(text):
            for token in sentence.split():
                found = known.get(token)
                terms += self._new(token) if found is None else found
            size = len(terms) - before
            if size > 1 or (size == 1 and not _INITIAL.search(sentence)):
                sizes.append(size)
                before = len(terms)
        if len(terms) > before:
            sizes.append(len(terms) - before)
        return np.array(terms, dtype=np.int64), np.array(sizes, dtype=np.int64)


def language_scores(words: dict[int, str], model: PieceModel) -> np.ndarray:
    """Log scores (terms x languages) of the words behind the terms, relative to the likeliest language."""
    langs = [i for i, x in enumerate(model.langs) if x != NAME]
    out = np.zeros((TERMS, len(langs)), dtype=np.float32)
    if words:
        scores = model.scores(list(words.values()))[:, langs]
        out[list(words)] = np.maximum(scores - scores.max(axis=1, keepdims=True), -5.0)
    return out


def sentence_scores(weights: np.ndarray, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log scores of each subject for each sentence."""
    return np.add.reduceat(weights[terms], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)


def _posteriors(scores: np.ndarray, prior: np.ndarray) -> np.ndarray:
    z = scores + np.log(prior)
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit_terms(docs: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, language: np.ndarray, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights (terms x subjects + none): log odds of each term against its use in all sentences of its language.

    ``labels`` are 0/1 per document and subject; ``language`` (terms x languages) are log scores that tell a sentence's
    language. A sentence is about a labelled subject or about none; other subjects keep a small share, because labels
    may be wrong. Counts are shrunk towards the term's use in the language, so rare words such as names say little.
    """
    k = labels.shape[1]
    terms = np.concatenate([np.zeros(0, dtype=np.int64)] + [t for t, _ in docs])
    sizes = np.concatenate([np.zeros(0, dtype=np.int64)] + [s for _, s in docs])
    owner = np.repeat(np.arange(len(docs)), [len(s) for _, s in docs])
    weights = np.zeros((TERMS, k + 1), dtype=np.float32)
    if not len(terms):
        return weights
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    spoken = np.add.reduceat(language[terms], starts, axis=0).argmax(axis=1)
    used, terms = np.unique(terms, return_inverse=True)
    row, langs = np.repeat(np.arange(len(sizes)), sizes), language.shape[1]
    votes = np.zeros((len(used), langs))
    np.add.at(votes, (terms, spoken[row]), 1)
    of = votes.argmax(axis=1)
    total = np.bincount(terms, minlength=len(used)).astype(float)
    overall = total / np.bincount(of, weights=total, minlength=langs)[of]
    share = labels / np.maximum(labels.sum(axis=1, keepdims=True), 1)
    bare = labels.sum(axis=1) == 0
    prior = np.concatenate([0.6 * share, np.where(bare, 1.0, 0.4)[:, None]], axis=1) * (1 - STRAY) + STRAY / (k + 1)
    prior = (prior / prior.sum(axis=1, keepdims=True))[owner]
    z, local = prior.copy(), np.zeros((len(used), k + 1))
    for _ in range(rounds):
        for c in range(k + 1):
            n = np.bincount(terms, weights=z[row, c], minlength=len(used))
            whole = np.bincount(of, weights=n, minlength=langs)[of]
            local[:, c] = np.log((n + SHRINK * overall) / (whole + SHRINK) / overall + 1e-9)
            # A term met once or twice moves by no more than its count bears.
            local[:, c] *= total / (total + FEW)
        np.clip(local, -3.0, 5.0, out=local)
        z = _posteriors(np.add.reduceat(local[terms], starts, axis=0), prior)
    weights[used] = local
    return weights


@dataclass
class Chain:
    """Term weights, the classifiers of the chain and what they were fitted on."""

    subjects: list[str]
    order: list[int]
    weights: np.ndarray
    sources: list[str]
    kinds: list[str]
    links: list[np.ndarray] = field(default_factory=list)
    platt: list[tuple[float, float]] = field(default_factory=list)


def document_features(weights: np.ndarray, terms: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Structure and term features of one document: for each subject the share of its sentences, whether that reaches
    ``SHARE``, and the mean evidence of its terms; then the share of sentences about none and the log of their number."""
    k = weights.shape[1] - 1
    if not len(sizes):
        return np.zeros(3 * k + 2)
    prior = np.full(k + 1, 0.5 / k)
    prior[k] = 0.5
    scores = sentence_scores(weights, terms, sizes)
    share = np.bincount((scores + np.log(prior)).argmax(axis=1), minlength=k + 1) / len(sizes)
    evidence = np.maximum(scores[:, :k], 0).sum(axis=0) / len(terms)
    return np.concatenate([share[:k] * 4, share[:k] >= SHARE, evidence, [share[k], np.log(len(sizes))]])


def _marks(values: Sequence[str | None], known: Sequence[str]) -> np.ndarray:
    """One-hot rows; a null or unknown value is all zeros."""
    at = {v: i for i, v in enumerate(known)}
    out = np.zeros((len(values), len(known)))
    for r, v in enumerate(values):
        if v in at:
            out[r, at[v]] = 1
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 25) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last column of ``x`` is the intercept and is not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[-1] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * np.maximum(p * (1 - p), 1e-5)[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _design(features: np.ndarray, k: int, subject: int, before: np.ndarray) -> np.ndarray:
    """Columns of one link: the subject's own features, the strongest of the others, the rest, the labels before it."""
    own = features[:, [subject, k + subject, 2 * k + subject]]
    others = np.delete(features[:, : 3 * k].reshape(-1, 3, k), subject, axis=2).max(axis=2)
    return np.concatenate([own, others, features[:, 3 * k :], before, np.ones((len(features), 1))], axis=1)


def _fit_links(features: np.ndarray, labels: np.ndarray, order: Sequence[int]) -> list[np.ndarray]:
    k = labels.shape[1]
    return [_logistic(_design(features, k, s, labels[:, list(order[:n])]), labels[:, s]) for n, s in enumerate(order)]


def fit_chain(labelled: pd.DataFrame, subjects: Sequence[str], language: np.ndarray) -> Chain:
    """Fit on rows (``terms, sizes, source, kind, subjects``), the last a list of labels; ``none`` and unknown labels mark no subject.

    Features of each half of the documents come from terms fitted on the other half, so that the chain and its
    calibration see what they will meet; the final terms come from all. ``language``: see ``language_scores``.
    """
    k = len(subjects)
    labels = np.zeros((len(labelled), k))
    for r, found in enumerate(labelled["subjects"]):
        for s in found:
            if s in subjects:
                labels[r, list(subjects).index(s)] = 1
    docs = list(zip(labelled["terms"], labelled["sizes"]))
    sources, kinds = (sorted({v for v in labelled[c] if v is not None}) for c in ("source", "kind"))
    marks = np.concatenate([_marks(list(labelled["source"]), sources), _marks(list(labelled["kind"]), kinds)], axis=1)
    order = sorted(range(k), key=lambda s: (-labels[:, s].sum(), s))
    half = np.arange(len(docs)) % 2
    features = np.zeros((len(docs), 3 * k + 2))
    for h in (0, 1):
        fit = np.flatnonzero(half != h)
        weights = fit_terms([docs[r] for r in fit], labels[fit], language)
        for r in np.flatnonzero(half == h):
            features[r] = document_features(weights, *docs[r])
    features = np.concatenate([features, marks], axis=1)
    platt = []
    logits = np.zeros_like(labels)
    for h in (0, 1):
        fit, held = half != h, half == h
        if fit.any() and held.any():
            for n, (s, w) in enumerate(zip(order, _fit_links(features[fit], labels[fit], order))):
                logits[held, n] = _design(features[held], k, s, labels[held][:, order[:n]]) @ w
    for n, s in enumerate(order):
        a, b = _logistic(np.stack([np.clip(logits[:, n], -12, 12), np.ones(len(docs))], axis=1), labels[:, s], ridge=0.1)
        platt.append((max(float(a), 0.05), float(b)))
    return Chain(list(subjects), order, fit_terms(docs, labels, language), sources, kinds, _fit_links(features, labels, order), platt)


def decode(chain: Chain, features: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Likeliest labels (documents x subjects) and the probability of each combination, by beam search along the chain."""
    n, k = len(features), len(chain.subjects)
    labels, score = np.zeros((n, 1, k)), np.zeros((n, 1))
    for link, s in enumerate(chain.order):
        width = labels.shape[1]
        flat = labels.reshape(n * width, k)
        z = _design(np.repeat(features, width, axis=0), k, s, flat[:, chain.order[:link]]) @ chain.links[link]
        a, b = chain.platt[link]
        z = (a * np.clip(z, -12, 12) + b).reshape(n, width)
        no, yes = score - np.logaddexp(0, z), score - np.logaddexp(0, -z)
        both = np.concatenate([no, yes], axis=1)
        kept = np.argsort(-both, axis=1, kind="stable")[:, :beam]
        score = np.take_along_axis(both, kept, axis=1)
        added = np.concatenate([labels, labels], axis=1)
        added[:, width:, s] = 1
        labels = np.take_along_axis(added, kept[:, :, None], axis=1)
    total = np.logaddexp.reduce(score, axis=1) if n else np.zeros(0)
    return labels[:, 0], np.exp(score[:, 0] - total)


def labelled_terms(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED, most_terms: int = MOST_LABELLED_TERMS) -> tuple[pd.DataFrame, dict[int, str]]:
    """``source, kind, subjects, terms, sizes`` of labelled documents, and a word behind each of their terms.

    At most ``most`` documents with at most ``most_terms`` terms in all, those of the least hash of doc_id: the texts
    are split where they lie, and only hashed terms reach the driver.
    """
    found = labels.where("doc_id IS NOT NULL AND subject IS NOT NULL").groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    found = found.withColumn("place", F.xxhash64("doc_id")).orderBy("place", "doc_id").limit(most)
    # At most ``most`` ids and label lists: a proven bound, so the documents are not shuffled.
    rows = docs.where("text IS NOT NULL").select("doc_id", fold_lookalikes(F.col("text")).alias("text"), "source", "kind")
    rows = rows.join(F.broadcast(found), "doc_id").select("place", "text", "source", "kind", "subjects")
    columns = ["place", "source", "kind", "subjects", "terms", "sizes", "n", "words"]

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut = SentenceTerms(keep_words=True)
        for batch in batches:
            out = []
            for place, text, source, kind, about in batch.itertuples(index=False):
                terms, sizes = cut(text)
                out.append((place, source, kind, list(about), terms.astype(np.int32).tobytes(), sizes.astype(np.int32).tobytes(), len(terms), None))
            yield pd.DataFrame(out, columns=columns)
        yield pd.DataFrame([(None, None, None, None, None, None, None, cut.words or {})], columns=columns)

    schema = "place bigint, source string, kind string, subjects array<string>, terms binary, sizes binary, n bigint, words map<int, string>"
    held = materialize(rows.mapInPandas(split, schema), "labelled")
    upto = F.sum("n").over(W.partitionBy(F.lit(0)).orderBy("place", "terms").rowsBetween(W.unboundedPreceding, 0))  # rows of a bounded sample
    sample = held.where("words IS NULL").withColumn("upto", upto).where(F.col("upto") <= most_terms).drop("upto", "words", "n").orderBy("place", "terms").toPandas()
    for c in ("terms", "sizes"):
        sample[c] = [np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in sample[c]]
    words = held.where("words IS NOT NULL").select(F.explode("words").alias("term", "word")).groupBy("term").agg(F.min("word").alias("word"))
    return sample, {r["term"]: r["word"] for r in words.collect()}


def document_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, samples: DataFrame) -> DataFrame:
    """``doc_id, subject, share, probability``: the subjects of every document.

    ``share`` is that of the document's sentences, ``probability`` that of the chosen combination. A null or wordless
    text has no subject; null source and kind are no feature; texts are read whole; repeated rows come out repeated;
    other columns are ignored; without any labelled document or area there is no row.
    """
    schema = "doc_id bigint, subject string, share double, probability double"
    subjects = [r["subject"] for r in areas.where("subject IS NOT NULL").select("subject").distinct().orderBy("subject").collect() if r["subject"] != NONE]
    rows, words = labelled_terms(docs, labels)
    if not subjects or not len(rows):
        return docs.sparkSession.createDataFrame([], schema)
    held = docs.sparkSession.sparkContext.broadcast(fit_chain(rows, subjects, language_scores(words, fit_from_tables(samples))))

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, split = held.value, _SPLIT
        k = len(chain.subjects)
        for batch in batches:
            features = np.zeros((len(batch), 3 * k + 2))
            for r, text in enumerate(batch["text"]):
                features[r] = document_features(chain.weights, *split(text))
            marks = [_marks(list(batch["source"]), chain.sources), _marks(list(batch["kind"]), chain.kinds)]
            chosen, sure = decode(chain, np.concatenate([features, *marks], axis=1))
            at, which = np.nonzero((chosen > 0) & (features[:, :k] > 0))
            yield pd.DataFrame({"doc_id": batch["doc_id"].to_numpy()[at], "subject": [chain.subjects[s] for s in which], "share": features[at, which] / 4, "probability": sure[at]})

    rows = docs.where("text IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), fold_lookalikes(F.col("text")).alias("text"), "source", "kind")
    return rows.mapInPandas(find, schema)


_SPLIT = SentenceTerms()
