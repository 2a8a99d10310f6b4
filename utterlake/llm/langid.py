"""Language of texts and of the stretches in them, by unigram pieces summed over all segmentations.

For each language the pieces of a fixed public vocabulary have probabilities, fitted by expectation maximisation on
labelled sentences. A word's probability is the sum over all its segmentations into pieces (forward algorithm). Words
keep their scores in the worker; a Viterbi pass with a price for changing the language cuts a text into stretches.
Invented names have a model of their own and count for no language.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from utterlake.llm.clutter import SOUNDS, without_annotations, without_times
from utterlake.llm.unify import fold_lookalikes, fold_text
from utterlake.session import discard, materialize

#: The vocabulary file; its folder is described in its README.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONGEST_PIECE = 16
#: Words of a language in a row (characters for Chinese) that count as a stretch.
LEAST_WORDS, LEAST_CHARACTERS = 5, 8
#: The most nats that one word says against a language: a likelihood ratio of about 150, beyond which the model's tails
#: decide more than the word. A change of language costs a little more, so that no single word makes a stretch, and a
#: word that says all it may against a language is no word of it and breaks a row.
CLIP, CHANGE = 5.0, 6.0
NAME = "*name"
_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]|[^㐀-䶿一-鿿豈-﫿]+")
_HAS_HAN = re.compile("[㐀-䶿一-鿿豈-﫿]")
_EDGES = " .,!?…，。、；：！？¿¡;:\"“”«»()[]{}<>|/\\—–-~♪*=+#&@'’‘_`“”„"
_SOUND = re.compile("(?:" + "|".join(SOUNDS) + ")", re.IGNORECASE)
SEGMENTS = "id bigint, declared string, lang string, stretch int, first_word int, n_words int, longest int, confidence double"


def _core(part: str) -> str:
    """``part`` without punctuation around it; an apostrophe may be a letter, so one that touches a letter stays."""
    core = part.strip(_EDGES)
    if core:
        at = part.find(core)
        if at and part[at - 1] == "'":
            core = "'" + core
            at -= 1
        if part[at + len(core) : at + len(core) + 1] == "'":
            core += "'"
    return core


def words_of(text: str) -> list[str]:
    """Words of a cleaned text, Chinese by character; case is kept."""
    parts = (p for token in unicodedata.normalize("NFC", text).split() for p in (_HAN.findall(token) if _HAS_HAN.search(token) else (token,)))
    return [core for core in map(_core, parts) if core]


class PieceModel:
    """Piece probabilities of each language over one vocabulary."""

    def __init__(self, langs: Sequence[str], pieces: dict[str, int], probs: np.ndarray):
        self.langs, self.pieces, self.probs = list(langs), pieces, probs
        self.names = self.langs.index(NAME) if NAME in self.langs else -1

    def edges(self, word: str) -> Iterator[tuple[int, int, list[int]]]:
        """(start, end, piece ids) of the lattice; a character without a piece is its bytes."""
        n = len(word)
        for j in range(1, n + 1):
            for i in range(max(0, j - LONGEST_PIECE), j):
                k = self.pieces.get(word[i:j])
                if k is not None:
                    yield i, j, [k]
                elif i == j - 1:
                    yield i, j, [self.pieces[f"<0x{b:02X}>"] for b in word[i].encode()]

    def score(self, word: str) -> np.ndarray:
        """Log probability of ``word`` in each language, summed over all segmentations."""
        word = "▁" + word
        n, get, probs = len(word), self.pieces.get, self.probs
        alpha: list[np.ndarray] = [np.ones(len(self.langs))]
        shift = 0.0  # log of what the rows of alpha have been divided by
        for j in range(1, n + 1):
            total = None
            for i in range(max(0, j - LONGEST_PIECE), j):
                k = get(word[i:j])
                if k is not None:
                    step = alpha[i] * probs[k]
                elif i == j - 1:
                    step = alpha[i] * probs[[self.pieces[f"<0x{b:02X}>"] for b in word[i].encode()]].prod(axis=0)
                else:
                    continue
                total = step if total is None else total + step
            alpha.append(total)
            if n > 24 and (top := total.max()) < 1e-100:
                top = max(top, 1e-280)
                for i in range(max(0, j + 1 - LONGEST_PIECE), j + 1):
                    alpha[i] = alpha[i] / top
                shift += math.log(top)
        return np.log(np.maximum(alpha[-1], 1e-300)) + shift


    def scores(self, words: Sequence[str]) -> np.ndarray:
        """``score`` of many words at once: words of one length share the steps of the forward algorithm."""
        out = np.empty((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for r, w in enumerate(words):
            by_length.setdefault(len(w), []).append(r)
        get, none = self.pieces.get, len(self.probs)
        probs = np.vstack([self.probs, np.zeros(len(self.langs))])  # the last row stands for no piece
        for length, rows in by_length.items():
            if length > 24 or len(rows) < 4:
                for r in rows:
                    out[r] = self.score(words[r])
                continue
            marked = ["▁" + words[r] for r in rows]
            alpha = [np.ones((len(rows), len(self.langs)))]
            for j in range(1, length + 2):
                total = np.zeros((len(rows), len(self.langs)))
                for i in range(max(0, j - LONGEST_PIECE), j):
                    ids = np.array([get(w[i:j], none) for w in marked])
                    if (ids < none).any():
                        total += alpha[i] * probs[ids]
                    if i == j - 1:
                        for k in np.flatnonzero(ids == none):
                            total[k] += alpha[i][k] * self.probs[[self.pieces[f"<0x{b:02X}>"] for b in marked[k][i].encode()]].prod(axis=0)
                alpha.append(total)
            out[rows] = np.log(np.maximum(alpha[-1], 1e-300))
        return out


def vocabulary(path: str = VOCABULARY) -> dict[str, int]:
    """Piece -> id of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {model.id_to_piece(i): i for i in range(model.get_piece_size())}


def expected_pieces(pieces: dict[str, int], words: Sequence[str], counts: Sequence[int], p: np.ndarray | None = None) -> np.ndarray:
    """Expected uses of each piece in ``words`` under ``p``, over all segmentations; without ``p``, its edges in their lattices.

    Words of one length share the steps of the forward and the backward pass.
    """
    total = np.zeros(len(pieces))
    by_length: dict[int, list[int]] = {}
    for r, w in enumerate(words):
        by_length.setdefault(len(w) + 1, []).append(r)
    for length, rows in by_length.items():
        marked = ["▁" + words[r] for r in rows]
        edges = []
        for j in range(1, length + 1):
            for i in range(max(0, j - LONGEST_PIECE), j):
                ids = np.array([pieces.get(w[i:j], -1) for w in marked])
                spelt = {k: [pieces[f"<0x{b:02X}>"] for b in marked[k][i].encode()] for k in np.flatnonzero(ids < 0)} if i == j - 1 else {}
                edges.append((i, j, ids, spelt))
        uses = [np.ones(len(rows))] * len(edges)
        if p is not None:
            weights = [np.where(ids >= 0, p[ids], 0.0) for _, _, ids, _ in edges]
            for x, (_, _, _, spelt) in zip(weights, edges):
                for k, some in spelt.items():
                    x[k] = p[some].prod()
            ahead, back = np.zeros((2, length + 1, len(rows)))
            ahead[0] = back[length] = 1.0
            for (i, j, _, _), x in zip(edges, weights):
                ahead[j] += ahead[i] * x
            for (i, j, _, _), x in zip(reversed(edges), reversed(weights)):
                back[i] += back[j] * x
            whole = ahead[length]
            each = np.divide(np.array([counts[r] for r in rows], dtype=float), whole, out=np.zeros(len(rows)), where=whole > 0)
            uses = [each * ahead[i] * x * back[j] for (i, j, _, _), x in zip(edges, weights)]
        for (_, _, ids, spelt), n in zip(edges, uses):
            np.add.at(total, ids[ids >= 0], n[ids >= 0])
            for k, some in spelt.items():
                np.add.at(total, some, n[k])
    return total


class NameWords:
    """The words of all full names with their counts, kept in a table; only sums over pieces reach the driver."""

    def __init__(self, speakers: DataFrame, pieces: dict[str, int]):
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = Counter(x.lower() for n in batch["full_name"] for x in words_of(fold_text(n)))
                yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

        rows = speakers.where("full_name IS NOT NULL").select("full_name").mapInPandas(count, "word string, n bigint")
        self.table = materialize(rows.groupBy("word").agg(F.sum("n").alias("n")), "names")
        self.size, self.held = len(pieces), speakers.sparkSession.sparkContext.broadcast(pieces)

    def expected(self, p: np.ndarray | None = None) -> np.ndarray:
        """``expected_pieces`` summed over all words."""
        held = self.held

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(len(held.value))
            for batch in batches:
                total += expected_pieces(held.value, batch["word"].tolist(), batch["n"].tolist(), p)
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": at, "n": total[at]})

        out = np.zeros(self.size)
        for r in self.table.mapInPandas(add, "piece bigint, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect():
            out[r["piece"]] = r["n"]
        return out


def fit_pieces(samples: Iterable[tuple[str, str]], names: Iterable[str] | DataFrame = (), path: str = VOCABULARY, rounds: int = 4, smooth: float = 0.002) -> PieceModel:
    """Fit on (language, text) pairs and on invented names, a list or a table with ``full_name`` of any number of rows.

    Each language's probabilities are a mixture of expected piece counts and a uniform share ``smooth`` over the pieces
    seen in any language and the bytes. Capitalised words inside a sentence that look more like a name than like the
    other words of their language are left out of the language.
    """
    pieces = vocabulary(path)
    words: dict[str, Counter] = {}
    inner: dict[str, Counter] = {}
    for lang, text in samples:
        found = words_of(fold_text(text))
        for k, w in enumerate(found):
            words.setdefault(lang, Counter())[w.lower()] += 1
            if k and w[0].isupper():
                inner.setdefault(lang, Counter())[w.lower()] += 1
    for lang, some in inner.items():
        for w, n in some.items():
            if n == words[lang][w] <= 2:  # never met in lower case nor as a first word
                del words[lang][w]
    langs = sorted(words)
    spread = NameWords(names, pieces) if isinstance(names, DataFrame) else None
    met: list[int] = []  # pieces of the names in the table
    if spread:
        met = np.flatnonzero(spread.expected()).tolist()
    elif names := Counter(x.lower() for n in names for x in words_of(fold_text(n))):
        words[NAME] = names
    if met or NAME in words:
        langs.append(NAME)
    model = PieceModel(langs, pieces, np.zeros((len(pieces), len(langs))))
    used = sorted({k for c in words.values() for w in c for _, _, ids in model.edges("▁" + w) for k in ids} | {k for p, k in pieces.items() if p.startswith("<0x")} | set(met))
    for c, lang in enumerate(langs):
        p = np.zeros(len(pieces))
        p[used] = 1 / len(used)
        lattices = [(n, len(w) + 1, list(model.edges("▁" + w))) for w, n in words.get(lang, {}).items()]
        for _ in range(rounds):
            expected = spread.expected(p) if spread and lang == NAME else np.zeros(len(pieces))
            for n, length, edges in lattices:
                weights = [math.prod(p[k] for k in ids) for _, _, ids in edges]
                ahead, back = [1.0] + [0.0] * length, [0.0] * length + [1.0]
                for (i, j, _), x in zip(edges, weights):
                    ahead[j] += ahead[i] * x
                for (i, j, _), x in zip(reversed(edges), reversed(weights)):
                    back[i] += back[j] * x
                if ahead[length] > 0:
                    for (i, j, ids), x in zip(edges, weights):
                        for k in ids:
                            expected[k] += n * ahead[i] * x * back[j] / ahead[length]
            p = np.zeros(len(pieces))
            p[used] = smooth / len(used)
            p += (1 - smooth) * expected / max(expected.sum(), 1e-9)
        p[p == 0] = smooth / len(pieces) / 10
        model.probs[:, c] = p
    if spread:
        discard(spread.table)
    return model


class Segmenter:
    """Cuts texts into stretches; keeps the scores of words it has met."""

    KEPT = 300_000

    def __init__(self, model: PieceModel, least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS):
        self.model, self.least_words, self.least_characters = model, least_words, least_characters
        self.langs = [x for x in model.langs if x != NAME]
        self._forget()

    def _forget(self) -> None:
        self.tokens: dict[str, tuple[int, ...]] = {}
        self.rows = np.zeros((1024, len(self.langs)), dtype=np.float32)
        self.best: list[int] = []
        self.foreign: list[int] = []  # bit set of the languages whose rows the word breaks

    @staticmethod
    def _is_word(word: str) -> bool:
        return any(c.isalpha() for c in word) and not any(c.isdigit() for c in word) and not _SOUND.fullmatch(word)

    def learn(self, texts: Iterable[str]) -> None:
        """Score the words of ``texts`` that are met for the first time, all together."""
        if len(self.tokens) > self.KEPT:
            self._forget()
        fresh = {token for text in texts for token in text.split()} - self.tokens.keys()
        cores = {_core(unicodedata.normalize("NFC", part)) for token in fresh for part in (_HAN.findall(token) if _HAS_HAN.search(token) else (token,))}
        words = [w for w in cores if w and w not in self.tokens and self._is_word(w)]
        low = list(dict.fromkeys(w.lower() for w in words))
        known = dict(zip(low, self.model.scores(low)))
        for w in words:
            self.tokens[w] = self._word(w, known[w.lower()])

    def _word(self, word: str, scores: np.ndarray | None = None) -> tuple[int, ...]:
        """Row of the word's scores; none for what is no word of any language."""
        if scores is None and not self._is_word(word):
            return ()
        n, low = self.model.names, word.lower()
        if scores is None:
            scores = self.model.score(low)
        lang = np.delete(scores, n) if n >= 0 else scores
        if n >= 0 and word[0].isupper() and scores[n] > lang.max():
            return ()
        k = len(self.best)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = np.maximum(lang - lang.max(), -CLIP)
        self.best.append(int(lang.argmax()))
        self.foreign.append(sum(1 << int(c) for c in np.flatnonzero(self.rows[k] <= -CLIP)))
        return (k,)

    def _token(self, token: str) -> tuple[int, ...]:
        """Rows of a white-space token that is met for the first time."""
        found: tuple[int, ...] = ()
        for part in _HAN.findall(token) if _HAS_HAN.search(token) else (token,):
            core = _core(unicodedata.normalize("NFC", part))
            known = self.tokens.get(core)
            if known is None:
                known = self.tokens[core] = self._word(core) if core else ()
            found += known
        if len(token) < 40 and not _HAS_HAN.search(token):
            self.tokens[token] = found
        return found

    def stretches(self, text: str) -> list[tuple[str, int, int, int, float]]:
        """(language, first word, words, longest run in a row, confidence) of each stretch, in order."""
        tokens, ids = self.tokens, []
        for token in text.split():
            known = tokens.get(token)
            ids += self._token(token) if known is None else known
        if not ids:
            return []
        e = self.rows[ids]
        total = e.sum(axis=0)
        top = int(total.argmax())
        if -total[top] < CHANGE:  # no change of language can pay
            return [self._stretch(ids, 0, len(ids), top, total)]
        some = sorted({self.best[k] for k in ids} | {top})
        e2 = e[:, some]
        score, back, here = e2[0], [], np.arange(len(some))
        for row in e2[1:]:
            j = int(score.argmax())
            jump = score[j] - CHANGE
            stay = score >= jump
            back.append(np.where(stay, here, j))
            score = np.where(stay, score, jump) + row
        at = int(score.argmax())
        path = [at]
        for b in reversed(back):
            at = int(b[at])
            path.append(at)
        path.reverse()
        found, i = [], 0
        while i < len(path):
            j = i
            while j < len(path) and path[j] == path[i]:
                j += 1
            found.append(self._stretch(ids, i, j, some[path[i]], e[i:j].sum(axis=0)))
            i = j
        return found

    def _stretch(self, ids: list[int], i: int, j: int, lang: int, total: np.ndarray) -> tuple[str, int, int, int, float]:
        """A word that says all it may against the language breaks the row.

        The confidence is the language's share of the likelihood of the stretch; see the test of its calibration.
        """
        run = longest = 0
        foreign = self.foreign
        for k in ids[i:j]:
            run = 0 if foreign[k] >> lang & 1 else run + 1
            if run > longest:
                longest = run
        confidence = 1.0 / float(np.exp(np.minimum(total - total[lang], 50.0)).sum())
        return self.langs[lang], i, j - i, longest, confidence

    def counts(self, lang: str, longest: int) -> bool:
        return longest >= (self.least_characters if lang == "cmn" else self.least_words)


def language_stretches(df: DataFrame, model: PieceModel, key: str = "seq", text: str = "text", declared: str = "lang", whole: bool = False) -> DataFrame:
    """One row per stretch: ``id, declared, lang, stretch, first_word, n_words, longest, confidence``.

    ``n_words`` counts words (Chinese: characters) without names and clutter, ``longest`` the longest run of them in a
    row. Null keys, null, empty and wordless texts give no row; texts of any length are read whole; repeated rows come out
    repeated; other columns are ignored. ``whole`` gives one row per text: its commonest language.
    """
    rows = df.where(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(declared).alias("declared"), fold_lookalikes(F.col(text)).alias("text"))
    # One projection for each step, so that no step's expression is repeated in the next.
    rows = rows.withColumn("text", without_times(F.col("text"))).withColumn("text", without_annotations(F.col("text")))
    held = df.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        segmenter = _segmenter(held)
        for batch in batches:
            out = []
            segmenter.learn(batch["text"])
            for i, d, t in zip(batch["id"], batch["declared"], batch["text"]):
                parts = segmenter.stretches(t)
                if whole and parts:
                    size: Counter = Counter()
                    for lang, _, n, _, _ in parts:
                        size[lang] += n
                    lang = max(size, key=lambda x: (size[x], x))
                    own = [p for p in parts if p[0] == lang]
                    out.append((i, d, lang, 0, own[0][1], size[lang], max(p[3] for p in own), sum(p[2] * p[4] for p in own) / sum(size.values())))
                else:
                    out += [(i, d, lang, k, *rest) for k, (lang, *rest) in enumerate(parts)]
            frame = pd.DataFrame(out, columns=["id", "declared", "lang", "stretch", "first_word", "n_words", "longest", "confidence"])
            yield frame.astype({"stretch": "int32", "first_word": "int32", "n_words": "int32", "longest": "int32"})

    return rows.mapInPandas(cut, SEGMENTS)


_KEPT: dict = {}


def _segmenter(held) -> Segmenter:
    """One segmenter per worker process, so that words keep their scores between batches and tasks."""
    value = held.value
    if _KEPT.get("of") is not value:
        _KEPT["of"], _KEPT["segmenter"] = value, Segmenter(PieceModel(*value))
    return _KEPT["segmenter"]


def fit_from_tables(samples: DataFrame, speakers: DataFrame | None = None, path: str = VOCABULARY) -> PieceModel:
    """Fit on ``lang_samples`` (``lang``, ``text``; a fixed table) and on the names of all ``speakers``."""
    rows = [(r["lang"], r["text"]) for r in samples.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").collect()]
    return fit_pieces(rows, () if speakers is None else speakers, path)


def mislabelled(stretches: DataFrame, least_words: int = LEAST_WORDS, least_characters: int = LEAST_CHARACTERS) -> DataFrame:
    """``seq, lang``: each language of a text whose declared language is null, ``und`` or wrong, or that holds several.

    ``stretches`` may hold several rows of one text; they are gathered per id with map-side combining.
    """
    counted = stretches.where(F.col("longest") >= F.when(F.col("lang") == "cmn", least_characters).otherwise(least_words))
    texts = counted.groupBy("id").agg(F.collect_set("lang").alias("langs"), F.first("declared", ignorenulls=True).alias("declared"))
    wrong = F.col("declared").isNull() | (F.col("declared") == "und") | (F.size("langs") > 1) | ~F.array_contains("langs", F.col("declared"))
    return texts.where(wrong).select(F.col("id").alias("seq"), F.explode("langs").alias("lang"))
