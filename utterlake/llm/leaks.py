"""Evaluation texts in a training corpus: latent semantic retrieval, then exact checks.

One pass over the corpus turns texts into words and counts document frequencies. Passages of the evaluation items get
TF-IDF vectors and a randomised SVD whose sketch is summed over partitions; its leading directions are the latent space.
Every document is cut into overlapping windows, which are projected into that space; their cosine with the passages of
the items whose essential terms the document holds finds candidates. Candidates are checked by dynamic programming over
words, items and errors, which finds every passage that keeps the allowance, and by the item's rare words, its answers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.llm.langid import _HAN, _HAS_HAN, _core
from utterlake.llm.unify import fold_text
from utterlake.session import materialize

#: Hash space of terms; size and stride of a document's windows in words.
TERMS, WINDOW, STRIDE = 1 << 19, 24, 8
#: A candidate's least cosine in the latent space, and the least share of a window's length that lies in that space:
#: twelve words of a passage in a window of 24 make 0.25 at even weights.
COSINE, INSIDE = 0.5, 0.2
#: Words of a passage of an item and of its overlap with the next: any window's words stand in one passage. Passages
#: that share a latent space, about; share of their squared length that its directions hold, in all and of each at least.
SPAN, OVERLAP, TOGETHER, ENERGY, LEAST_HELD = 96, 24, 512, 0.95, 0.5
#: Latent spaces whose items one pass over the corpus searches; bounds what is broadcast.
SPACES = 16
#: Words of a passage at least, words to one error at most, share of an item's words.
PASSAGE, PER_ERROR, SHARE = 12, 8, 0.5
#: An item's other terms together stay below this share of its length: a window without essential terms is far from it.
SLIGHT = 0.2
_WORD_CACHE = 400_000


class Tokens:
    """Words of texts as 32-bit terms; folding, case and composition are settled once for each white-space token."""

    def __init__(self) -> None:
        self.one: dict[str, int] = {}
        self.more: dict[str, tuple[int, ...]] = {}

    def _new(self, token: str) -> None:
        folded = fold_text(token).lower()
        found = []
        for part in _HAN.findall(folded) if _HAS_HAN.search(folded) else folded.replace("-", " ").replace("—", " ").replace("/", " ").split():
            word = _core(part).strip("'")
            if word:
                found.append(zlib.crc32(word.encode()))
        self.one[token] = found[0] if len(found) == 1 else -1
        if len(found) != 1:
            self.more[token] = tuple(found)

    def __call__(self, text: str) -> np.ndarray:
        """Terms of the text's words in order."""
        if len(self.one) > _WORD_CACHE:
            self.one.clear(), self.more.clear()
        tokens = text.split()
        terms = list(map(self.one.get, tokens))
        if None in terms:
            for token, term in zip(tokens, terms):
                if term is None:
                    self._new(token)
            terms = list(map(self.one.get, tokens))
        if -1 in terms:
            terms = [x for token, term in zip(tokens, terms) for x in ((term,) if term >= 0 else self.more[token])]
        return np.array(terms, dtype=np.int64)


_TOKENS = Tokens()


def _plain(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.where(F.col(key).isNotNull() & F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))


def corpus_words(docs: DataFrame) -> DataFrame:
    """One pass over ``docs`` (``id``, ``text``): the words of each as a row of 32-bit terms, and counts.

    Rows of documents hold ``id, words``; the last row of each task holds ``terms`` and in how many of its documents
    each stands (``found``), with -1 for the documents themselves.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(TERMS, dtype=np.int64), 0
        names = ["id", "words", "terms", "found"]
        lists = pa.list_(pa.int64())
        for batch in batches:
            words = [_TOKENS(t) for t in batch.column(1).to_pylist()]
            for w in words:
                seen[np.unique(w % TERMS)] += 1
            k = len(words)
            n += k
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([w.astype(np.uint32).tobytes() for w in words], pa.binary()), pa.nulls(k, lists), pa.nulls(k, lists)], names)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([np.append(at, -1)], lists), pa.array([np.append(seen[at], n)], lists)], names)

    return docs.select("id", "text").mapInArrow(count, "id bigint, words binary, terms array<bigint>, found array<bigint>")


def document_frequencies(words: DataFrame) -> tuple[np.ndarray, int]:
    """Documents in which each hashed term stands, over the whole corpus (see ``corpus_words``), and their number."""
    rows = words.where("id IS NULL").select(F.explode(F.arrays_zip("terms", "found")).alias("x"))
    rows = rows.groupBy(F.col("x.terms").alias("term")).agg(F.sum("x.found").alias("df")).toPandas()
    out = np.zeros(TERMS, dtype=np.float64)
    real = rows[rows["term"] >= 0]
    out[real["term"].to_numpy()] = real["df"].to_numpy()
    return out, int(rows.loc[rows["term"] < 0, "df"].sum())


def term_weights(df: np.ndarray, n: int) -> np.ndarray:
    """Squared inverse document frequency, which lets rare words such as names decide."""
    return ((np.log((n + 1) / (df + 1)) + 0.1) ** 2).astype(np.float32)


def item_passages(items: DataFrame) -> DataFrame:
    """``item`` (a number for each row of ``items``), ``id``, ``part``, ``words`` of overlapping passages of ``SPAN`` words."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for item, i, t in zip(batch["item"], batch["id"], batch["text"]):
                w = _TOKENS(t)
                out += [(item, i, k, w[at : at + SPAN].tobytes()) for k, at in enumerate(range(0, max(1, len(w) - OVERLAP), SPAN - OVERLAP))]
            yield pd.DataFrame(out, columns=["item", "id", "part", "words"])

    rows = items.select(F.monotonically_increasing_id().alias("item"), "id", "text")
    return materialize(rows.mapInPandas(cut, "item bigint, id bigint, part int, words binary"), "passages")


class Latent:
    """A latent space: its terms, their coordinates (terms x rank), and passages as unit vectors in it.

    ``items`` numbers the item of each passage; ``postings`` has for each term the passages that need it: a passage's
    other terms together hold less than ``SLIGHT`` of its length.
    """

    def __init__(self, items: np.ndarray, terms: np.ndarray, axes: np.ndarray, rows: np.ndarray):
        self.items, self.terms = items, terms
        self.axes = axes.astype(np.float32)
        within = rows @ axes
        self.passages = (within / np.maximum(np.linalg.norm(within, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        held: list[list[int]] = [[] for _ in terms]
        for k, row in enumerate(rows):
            own = np.flatnonzero(row)
            order = own[np.argsort(row[own], kind="stable")]
            for t in order[np.sqrt(np.cumsum(row[order] ** 2)) >= SLIGHT]:
                held[t].append(k)
        self.postings = [np.array(x, dtype=np.int32) for x in held]

    def open(self) -> Latent:
        """Ready for look-ups by term: ``place`` and ``vital`` over the hash space."""
        self.place = np.full(TERMS, -1, dtype=np.int32)
        self.place[self.terms] = np.arange(len(self.terms))
        self.vital = np.zeros(TERMS, dtype=bool)
        self.vital[self.terms[[len(x) > 0 for x in self.postings]]] = True
        return self

    def nearest(self, terms: np.ndarray, weights: np.ndarray, cosine: float) -> dict[int, float]:
        """Items near to a window of a document, with the greatest cosine of each. ``terms`` are the document's words."""
        marks = self.vital[terms]
        if not marks.any():
            return {}
        near = np.unique(np.concatenate([self.postings[p] for p in np.unique(self.place[terms[marks]])]))
        best = np.zeros(len(near), dtype=np.float32)
        slots = max(1, -(-(len(terms) - WINDOW) // STRIDE) + 1)
        per = WINDOW // STRIDE
        for b in range(0, slots, 512):  # a bounded stretch of the document
            count = min(512, slots - b)
            part = terms[b * STRIDE : (b + count - 1) * STRIDE + WINDOW]
            a = weights[part]
            slot = np.arange(len(part)) // STRIDE
            # A word stands in the windows that start in its own stride and in those before it.
            square = np.bincount(slot, weights=a.astype(np.float64) ** 2, minlength=count + per)
            length = np.sqrt(np.convolve(square, np.ones(per))[per - 1 : per - 1 + count])
            at = np.flatnonzero(self.place[part] >= 0)
            if not len(at):
                continue
            used, column = np.unique(self.place[part[at]], return_inverse=True)
            strides = np.bincount(slot[at] * len(used) + column, weights=a[at], minlength=(count + per) * len(used)).reshape(-1, len(used))
            sums = np.cumsum(np.concatenate([np.zeros((1, len(used))), strides]), axis=0)
            windows = (sums[per : per + count] - sums[:count]).astype(np.float32)
            z = windows @ self.axes[used]
            inside = np.linalg.norm(z, axis=1)
            keep = inside > np.maximum(INSIDE * length, 1e-6)
            if keep.any():
                np.maximum(best, ((z[keep] / inside[keep, None]) @ self.passages[near].T).max(axis=0), out=best)
        found: dict[int, float] = {}
        for k in np.flatnonzero(best >= cosine):
            item = int(self.items[near[k]])
            found[item] = max(float(best[k]), found.get(item, 0.0))
        return found


def fit_latent(passages: DataFrame, weights: np.ndarray, seed: int = 7) -> Latent:
    """Randomised SVD of the passages' TF-IDF rows (``item``, ``words``), summed over partitions.

    One pass over the passages sums A'(A G) and (A G)'(A G) for a Gaussian G; what visits the driver is bounded by the
    hash space and the passages of one space. The rank is the least that holds ``ENERGY`` of the squared length.
    """
    width = max(1, passages.count())

    def gauss(terms: np.ndarray) -> np.ndarray:
        return np.stack([np.random.default_rng([seed, int(t)]).standard_normal(width) for t in terms]) if len(terms) else np.zeros((0, width))

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        gram = np.zeros((width, width))
        ids, words = [], []
        for batch in batches:
            for i, raw in zip(batch["item"], batch["words"]):
                w = np.frombuffer(raw, dtype=np.int64)
                ids.append(int(i)), words.append(w)
                terms, n = np.unique(w % TERMS, return_counts=True)
                if len(terms):
                    a = n * weights[terms]
                    a = a / max(np.linalg.norm(a), 1e-9)
                    y = a @ gauss(terms)
                    gram += np.outer(y, y)
                    for k, x in zip(terms, a):
                        sums[int(k)] = sums.get(int(k), 0) + x * y
        keys = np.array(sorted(sums), dtype=np.int64)
        matrix = np.stack([sums[k] for k in keys]) if len(keys) else np.zeros((0, width))
        yield pd.DataFrame({"terms": [keys.tobytes()], "sums": [matrix.tobytes()], "gram": [gram.tobytes()], "ids": [np.array(ids, dtype=np.int64).tobytes()], "sizes": [np.array([len(w) for w in words], dtype=np.int64).tobytes()], "words": [np.concatenate([np.zeros(0, dtype=np.int64), *words]).tobytes()]})

    parts = passages.coalesce(8).mapInPandas(sketch, "terms binary, sums binary, gram binary, ids binary, sizes binary, words binary").collect()
    terms = np.unique(np.concatenate([np.zeros(0, dtype=np.int64)] + [np.frombuffer(p["terms"], dtype=np.int64) for p in parts]))
    sums, gram = np.zeros((len(terms), width)), np.zeros((width, width))
    ids: list[int] = []
    words: list[np.ndarray] = []
    for p in parts:
        sums[np.searchsorted(terms, np.frombuffer(p["terms"], dtype=np.int64))] += np.frombuffer(p["sums"]).reshape(-1, width)
        gram += np.frombuffer(p["gram"]).reshape(width, width)
        ids += np.frombuffer(p["ids"], dtype=np.int64).tolist()
        cuts = np.cumsum(np.frombuffer(p["sizes"], dtype=np.int64))[:-1]
        words += np.split(np.frombuffer(p["words"], dtype=np.int64), cuts) if p["ids"] else []
    # Q = Y R^-1 with R from the gram matrix; B = Q'A has the right singular vectors.
    values, vectors = np.linalg.eigh(gram)
    held = values > max(values.max(initial=0), 1e-12) * 1e-9
    b = (vectors[:, held] / np.sqrt(values[held])).T @ sums.T
    left, s, right = np.linalg.svd(b, full_matrices=False)
    rank = 1 + int(np.searchsorted(np.cumsum(s**2), ENERGY * (s**2).sum())) if len(s) else 0
    rows = np.zeros((len(words), len(terms)))
    for r, w in enumerate(words):
        t, n = np.unique(w % TERMS, return_counts=True)
        a = n * weights[t]
        rows[r, np.searchsorted(terms, t)] = a / max(np.linalg.norm(a), 1e-9)
    axes = right[:rank].T
    # Passages that the leading directions hold to less than half get directions for what is left of them.
    held = (rows @ axes) @ axes.T
    lost = (held**2).sum(axis=1) < LEAST_HELD * (rows**2).sum(axis=1)
    if lost.any():
        left, sizes, _ = np.linalg.svd((rows - held)[lost].T, full_matrices=False)
        axes = np.concatenate([axes, left[:, sizes > 1e-6]], axis=1)
    return Latent(np.array(ids, dtype=np.int64), terms, axes, rows)


def _item_words(passages: DataFrame) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
    """Ids and words of the items, joined from their passages, and the place of each item number."""
    ids: list[int] = []
    words: list[np.ndarray] = []
    place: dict[int, int] = {}
    for r in passages.orderBy("item", "part").collect():
        w = np.frombuffer(r["words"], dtype=np.int64)
        if r["item"] not in place:
            place[r["item"]] = len(ids)
            ids.append(r["id"]), words.append(w)
        else:
            words[-1] = np.concatenate([words[-1], w[OVERLAP:]])
    return ids, words, place


def _grams(words: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the word grams, in order; 64-bit products wrap."""
    n = len(words) - gram + 1
    return sum(words[k : n + k] * np.int64(m) for k, m in zip(range(gram), (1, 6364136223846793005, 1442695040888963407, 3935559000370003845)))


class Grams:
    """Word grams of a document in order of their hashes, for look-ups by items."""

    def __init__(self, doc: np.ndarray, gram: int = 4):
        self.gram, self.words = gram, len(doc)
        grams = _grams(doc, gram) if len(doc) >= gram else doc[:0]
        self.order = np.argsort(grams, kind="stable")
        self.sorted = grams[self.order]

    def met(self, item: np.ndarray) -> np.ndarray:
        """Which word grams of ``item`` the document holds."""
        a = _grams(item, self.gram) if len(item) >= self.gram else item[:0]
        if not len(a) or not len(self.sorted):
            return np.zeros(len(a), dtype=bool)
        return self.sorted[np.minimum(np.searchsorted(self.sorted, a), len(self.sorted) - 1)] == a

    def pairs(self, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal grams in the item and in the document."""
        a = _grams(item, self.gram) if len(item) >= self.gram else item[:0]
        lo, hi = np.searchsorted(self.sorted, a, "left"), np.searchsorted(self.sorted, a, "right")
        i = np.repeat(np.arange(len(a)), hi - lo)
        return i, self.order[np.arange(len(i)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)] if len(i) else i


def _covered(places: np.ndarray, n: int, gram: int) -> np.ndarray:
    """Words of an item that stand in the grams at ``places``."""
    cover = np.zeros(n, dtype=bool)
    for k in range(gram):
        cover[places + k] = True
    return cover


def _most(fits: np.ndarray) -> int:
    """The most words in stretches (start x end) that do not overlap."""
    n = len(fits)
    best = np.zeros(n + 1, dtype=np.int64)
    ends = fits.any(axis=0)
    for b in range(1, n + 1):
        best[b] = best[b - 1]
        if ends[b]:
            a = np.flatnonzero(fits[:, b])
            best[b] = max(best[b], int((best[a] + b - a).max()))
    return int(best[n])


def bands(item: np.ndarray, grams: Grams, passage: int = PASSAGE, per_error: int = PER_ERROR) -> tuple[int, list[tuple[int, int]]]:
    """A bound on the words of ``item`` that a document can hold, and the stretches of it that can hold them.

    The offsets between item and document inside a passage differ by no more than its errors, so its unbroken grams lie
    in one of the overlapping bands of offsets. Each error takes at most ``gram`` words out of unbroken grams: itself
    and a run too short for one. So a passage of L words has at least L - gram x (L // per_error) words in them.
    """
    n, gram = len(item), grams.gram
    i, j = grams.pairs(item)
    if n < passage or not len(i):
        return 0, []
    width = max(1, n // per_error)
    band = (j - i) // width
    sizes = np.arange(n + 1)
    slack = np.where(sizes >= passage, sizes - gram * (sizes // per_error), 2 * n)[np.maximum(sizes[None, :] - sizes[:n, None], 0)]
    fits = np.zeros((n, n + 1), dtype=bool)
    regions: list[tuple[int, int]] = []
    order = np.argsort(band, kind="stable")
    i, band = i[order], band[order]
    ids, first = np.unique(band, return_index=True)
    past = np.append(first[1:], len(band))
    for k in np.unique(np.concatenate([ids, ids - 1])):
        lo, hi = np.searchsorted(ids, k), np.searchsorted(ids, k + 2)
        places = i[first[lo] : past[hi - 1]]
        if len(places) + gram - 1 < passage - gram:
            continue
        sums = np.concatenate([[0], np.cumsum(_covered(places, n, gram))])
        held = sums[None, :] - sums[:n, None] >= slack
        if held.any():
            fits |= held
            a, b = max(0, int(k - 1) * width), min(grams.words, n + int(k + 3) * width)
            if regions and a <= regions[-1][0] + 2 * width:
                regions[-1] = (regions[-1][0], b)
            else:
                regions.append((a, b))
    return _most(fits) if regions else 0, regions


def longest_run(item: np.ndarray, grams: Grams) -> int:
    """The longest run of words of ``item`` that a document holds unchanged, 0 below the size of a gram."""
    i, j = grams.pairs(item)
    if not len(i):
        return 0
    sort = np.lexsort((i, j - i))
    i, d = i[sort], (j - i)[sort]
    breaks = np.flatnonzero((np.diff(i) != 1) | (np.diff(d) != 0))
    return int(np.diff(np.concatenate([[-1], breaks, [len(i) - 1]])).max()) + grams.gram - 1


def _passages(item: np.ndarray, doc: np.ndarray, passage: int, per_error: int, found: np.ndarray) -> None:
    """Mark in ``found`` (start x end) every stretch of ``item`` that a stretch of ``doc`` equals within its errors.

    For all starts at once, the least errors of the item's words so far against any stretch of the document that ends at
    each place. A passage starts and ends on equal words. A start is given up once no end could make up for its errors.
    """
    n, m = len(item), len(doc)
    far = n + m
    along = np.arange(m, dtype=np.int32)
    starts = np.zeros(0, dtype=np.int64)
    rows = np.zeros((0, m), dtype=np.int32)  # rows[s, j]: the last word compared with is doc[j]
    for b in range(n):
        same = doc == item[b]
        paired = np.full_like(rows, far)
        paired[:, 1:] = rows[:, :-1]
        ended = np.where(same, paired, far).min(axis=1, initial=far) if len(rows) else np.zeros(0, dtype=np.int64)
        size = b + 1 - starts
        good = (size >= passage) & (ended * per_error <= size)
        found[starts[good], b + 1] = True
        new = np.minimum(paired + ~same, rows + 1)
        new = np.minimum.accumulate(new - along, axis=1) + along  # words added in the document
        if same.any() and n - b >= passage:
            starts = np.append(starts, b)
            new = np.concatenate([new, np.minimum.accumulate(np.where(same, 0, far) - along)[None].astype(np.int32) + along])
        alive = new.min(axis=1, initial=far) * per_error <= n - starts if len(new) else np.zeros(0, dtype=bool)
        rows, starts = (new, starts) if alive.all() else (new[alive], starts[alive])


def held_words(item: np.ndarray, doc: np.ndarray, passage: int = PASSAGE, per_error: int = PER_ERROR, least: float = 0, grams: Grams | None = None, most: int = 8192) -> int:
    """Words of ``item`` that ``doc`` holds in passages of at least ``passage`` words with at most one error in ``per_error``.

    An error is a changed, added or dropped word; a passage starts and ends on equal words. Among all passages those
    are chosen that do not overlap in the item and hold the most of its words. They are looked for in the bands of
    unbroken word grams, which every passage has; long stretches are cut with overlap, so that a document of any length
    takes bounded memory. The answer is 0 where ``least`` cannot be reached.
    """
    n = len(item)
    bound, regions = bands(item, grams or Grams(doc), passage, per_error)
    if bound < max(least, passage):
        return 0
    found = np.zeros((n, n + 1), dtype=bool)
    longest = n + n // per_error
    step = max(most, 4 * longest)
    for lo, hi in regions:
        for x in range(lo, max(lo + 1, hi - longest), step - longest):
            _passages(item, doc[x : min(x + step, hi)], passage, per_error, found)
    return _most(found)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", cosine: float = COSINE, whole: bool = False) -> DataFrame:
    """Candidates with their checks: ``doc_id, item_id, cosine, item_words, held, answers``.

    Without ``whole`` candidates that cannot hold the share come with 0, and one whose unchanged words reach it with those.

    ``held`` counts the item's words held in passages, ``answers`` the share of the item's rarest words (its names and
    answers) that stand anywhere in the document, which marks paraphrases. Every document and every item is compared:
    one pass over the words of the corpus for every ``SPACES`` latent spaces. Null keys or texts give no row; texts
    without words hold nothing; repeated rows come out repeated; texts of any length are read whole; other columns are
    ignored; an empty table gives no rows.
    """
    docs, items = _plain(docs, doc_key, text), _plain(items, item_key, text)
    corpus = materialize(corpus_words(docs), "words")
    df, n = document_frequencies(corpus)
    weights = term_weights(df, n)
    passages = item_passages(items)
    blocks = max(1, -(-passages.count() // TOGETHER))
    block = F.pmod(F.xxhash64("item"), F.lit(blocks))  # an item's passages stay together
    corpus = corpus.where("id IS NOT NULL").select("id", "words")
    found = None
    for first in range(0, blocks, SPACES):
        part = _searched(corpus, passages, block, range(first, min(first + SPACES, blocks)), weights, cosine, whole)
        found = part if found is None else found.unionByName(part)
    return found


def _searched(corpus: DataFrame, passages: DataFrame, block, some: range, weights: np.ndarray, cosine: float, whole: bool) -> DataFrame:
    """``leaked_items`` for the items of some blocks."""
    latents = [fit_latent(passages.where(block == k), weights) for k in some]
    ids, texts, number = _item_words(passages.where(block.between(some[0], some[-1])))
    for latent in latents:
        latent.items = np.array([number[int(x)] for x in latent.items], dtype=np.int64)
    held = corpus.sparkSession.sparkContext.broadcast((latents, ids, texts, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        latents, ids, texts, weights = held.value
        spaces = [latent.open() for latent in latents]
        rare = [np.unique(w[weights[w % TERMS] >= np.quantile(weights[w % TERMS], 0.8)]) if len(w) else w for w in texts]
        for batch in batches:
            out = []
            for d, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = np.frombuffer(raw, dtype=np.uint32).astype(np.int64)
                terms = words % TERMS
                nearest: dict[int, float] = {}
                for space in spaces:
                    nearest |= space.nearest(terms, weights, cosine)
                grams = Grams(words) if nearest else None
                for k in sorted(nearest):
                    item = texts[k]
                    answers = float(np.isin(rare[k], words).mean()) if whole and len(rare[k]) else 0.0
                    least = PASSAGE if whole else max(SHARE * len(item), PASSAGE)
                    met, count = np.flatnonzero(grams.met(item)), 0
                    if len(met) and 2 * _covered(met, len(item), grams.gram).sum() >= least:
                        run = 0 if whole else longest_run(item, grams)
                        count = run if run >= least else held_words(item, words, least=least, grams=grams)
                    out.append((d, ids[k], nearest[k], len(item), count, answers))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64()))], ["doc_id", "item_id", "cosine", "item_words", "held", "answers"])

    return corpus.mapInArrow(search, "doc_id bigint, item_id bigint, cosine double, item_words bigint, held bigint, answers double")


def leaks(candidates: DataFrame, share: float = SHARE) -> DataFrame:
    """``doc_id, item_id`` where the document holds at least ``share`` of the item's words."""
    return candidates.where((F.col("item_words") > 0) & (F.col("held") >= F.col("item_words") * share)).select("doc_id", "item_id").distinct()
