import random
import re
import unicodedata

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from utterlake.llm import langid, leaks, mixing, pieces, splits, subjects, turns, unify

UTTER = "seq bigint, org_media_path string, org_transcription_path string, prefix string, start_time bigint, end_time bigint, text string, speaker string, lang string, canonical string, person string, key string, shard string"
PEOPLE = [("S0000001", "Tapa Tosomela"), ("S0000002", "Viku Gimudapi"), ("S0000003", None), (None, "No Code")]


def utter(spark, rows):
    """Rows of (seq, path, start, end, text, speaker[, lang]); the other columns clash with names used inside."""
    full = [(r[0], f"{r[1]}.wav" if r[1] else None, r[1], f"{r[1]}.xv.{r[0]}", r[2], r[3], r[4], r[5], r[6] if len(r) > 6 else None, "c", "p", "k", "s") for r in rows]
    return spark.createDataFrame(full, UTTER)


def people(spark):
    return spark.createDataFrame([(*p, "here", 1950) for p in PEOPLE], "speaker_code string, full_name string, community string, birth_year int")


# ---- turns


def test_labels_name_persons(spark):
    labels = ["Tapa Tosomela", "TOSOMELA", "Tosomela, Tapa", "t. tosomela", "tapa_tosomela", "Tapa Tosomela [M, 34]", "Spk: Tapa Tosomela:", " s0000001 ", "V. Tosomela", "Tapa", "unknown", "?", "", None, "x" * 3000]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    found = {r["label"]: r["code"] for r in turns.label_persons(df, people(spark)).collect()}
    assert found == dict.fromkeys(labels[:8], "S0000001")


def test_labels_of_many_words_name_persons(spark):
    labels = ["S0000001 - main speaker of the story", "Tosomela, Tapa T. T. T.", "tapa tapa tosomela tapa tosomela", "the brother of Tapa Tosomela himself"]
    df = spark.createDataFrame([(x,) for x in labels], "label string")
    assert {r["label"]: r["code"] for r in turns.label_persons(df, people(spark)).collect()} == dict.fromkeys(labels[:3], "S0000001")


def brute_turns(rows):
    """Turns of rows (seq, path, start, end, person, text) that are spoken."""
    out = set()
    for path in {r[1] for r in rows}:
        some = sorted((r for r in rows if r[1] == path), key=lambda r: (r[2] is not None, r[2] or 0, r[0]))
        kept, seen = [], set()
        for r in some:
            if (r[2], r[3], r[5]) not in seen:
                seen.add((r[2], r[3], r[5]))
                kept.append(r)
        at = 0
        while at < len(kept):
            end = at
            while end + 1 < len(kept) and kept[end + 1][4] == kept[at][4]:
                end += 1
            out.add((kept[at][0], kept[end][0], kept[at][4]))
            at = end + 1
    return out


def test_names_and_codes_of_any_shape(spark):
    who = [("x7-q", None), ("K12", "Anne-Marie O'Brien"), ("S0000009", "Ana " + "Maria" * 12)]
    speakers = spark.createDataFrame([(*p, "here", 1950) for p in who], "speaker_code string, full_name string, community string, birth_year int")
    texts = ["Anne-Marie O'Brien: we went home", "[K12] we went home", "K12> we went home", "Ana " + "Maria" * 12 + ": we went home", "then K12 said: we went home", "Who: we went home"]
    got = {r["seq"]: r["person"] for r in turns.spoken_rows(utter(spark, [(k, "a", k, k + 1, t, None) for k, t in enumerate(texts)]), speakers).collect()}
    assert got == {0: "K12", 1: "K12", 2: "K12", 3: "S0000009", 4: None, 5: None}
    labels = spark.createDataFrame([("X7-Q",), ("O'Brien, A.-M.",), ("(x7q)",)], "label string")
    assert {r["label"]: r["code"] for r in turns.label_persons(labels, speakers).collect()} == {"X7-Q": "x7-q", "O'Brien, A.-M.": "K12", "(x7q)": "x7-q"}


def test_rows_without_a_start(spark):
    """They come first, in order of seq, over several shards; copies go however far apart."""
    rows = [(k, "a", None, None, f"words {k % 9000}", ["S0000001", "S0000002"][k >= 9500]) for k in range(0, 20000, 10)] + [(5, "a", 0, 1, "more", "S0000001")]
    got = [(r["first_seq"], r["last_seq"], r["speaker_code"]) for r in turns.speaker_turns(utter(spark, rows), people(spark)).collect()]
    assert got == [(0, 5, "S0000001")]
    rows[-1] = (5, "a", 0, 1, "more", "S0000002")
    got = {(r["first_seq"], r["last_seq"], r["speaker_code"]) for r in turns.speaker_turns(utter(spark, rows), people(spark)).collect()}
    assert got == {(0, 8990, "S0000001"), (5, 5, "S0000002")}


@pytest.mark.parametrize("seed", [0, 1])
def test_turns_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    said = {"Tapa Tosomela": "S0000001", "V. Gimudapi": "S0000002", "SPEAKER": "unknown", None: "unknown"}
    rows = []
    for k in range(300):
        who = rng.choice(list(said))
        start = rng.choice([None, *range(0, 4000, 37)])
        rows.append((k, rng.choice(["a", "b", None]), start, rng.choice([None, 5000]), rng.choice(["yes.", "no, no."]), who))
    found = turns.speaker_turns(utter(spark, rows), people(spark), shard_ms=500).collect()
    expected = brute_turns([(r[0], r[1], r[2], r[3], said[r[5]], r[4]) for r in rows])
    assert {(r["first_seq"], r["last_seq"], r["speaker_code"]) for r in found} == expected


def test_clutter_and_written_names(spark):
    rows = [
        (1, "a", 0, 9, "[2m00s] <Viku Gimudapi> mmm… (dog barks)", "Tapa Tosomela"), (2, "a", 10, 19, "00:00:12,233 --> S0000002> uh-huh, yes", None), (3, "a", 20, 29, "Gimudapi, Viku - 05:19 - well", "?"),
        (4, "a", 30, 39, "【noise】 ((laughs)) *coughs* =claps= ♪ … 嗯", "Tapa Tosomela"), (5, "a", 40, 49, "Tapa Tosomela: uhm,", None), (6, "a", 50, 59, None, None), (7, "a", 60, 69, "", "x"), (8, "a", 70, 79, "word " * 20_000, "Interviewer"),
    ]
    got = turns.speaker_turns(utter(spark, rows), people(spark)).collect()
    assert {(r["first_seq"], r["last_seq"], r["speaker_code"]) for r in got} == {(2, 3, "S0000002"), (8, 8, "unknown")}
    filled = turns.speaker_turns(utter(spark, rows), people(spark), fill_forward=True, with_text=True).collect()
    assert [(r["first_seq"], r["last_seq"], r["part"], r["text"][:14]) for r in filled] == [(2, 8, 1, "yes well word ")]
    assert turns.speaker_turns(utter(spark, []), people(spark).where("false")).count() == 0


def test_forward_fill_across_shards(spark):
    rows = [(1, "a", 0, 9, "one", "Tosomela"), (2, "a", 700, 900, "two", None), (3, "a", 1600, 1700, "three", None), (4, "a", 1650, 1700, "four", "Gimudapi")]
    got = turns.speaker_turns(utter(spark, rows), people(spark), fill_forward=True, shard_ms=500).collect()
    assert {(r["first_seq"], r["last_seq"], r["speaker_code"]) for r in got} == {(1, 3, "S0000001"), (4, 4, "S0000002")}


# ---- languages


SENTENCES = {
    "eng": ["the old woman found the wooden boat near the river", "a stranger carried the heavy box on the road", "my uncle cleaned the broken pot before dark", "the children hid the red blanket behind the house"],
    "spa": ["la anciana encontró la canoa de madera cerca del río", "una forastera llevó la caja pesada de camino a casa", "mi tío limpió la olla rota antes del anochecer", "los niños escondió la manta roja detrás de la casa"],
    "cmn": ["那位老太太在河边找到了那条木船", "一个外地人在回家的路上拿走了很重的箱子", "我叔叔天黑之前洗干净了破了的锅"],
}


@pytest.fixture(scope="module")
def model():
    return langid.fit_pieces([(la, t) for la, some in SENTENCES.items() for t in some], ["Mapovene Kodakubun", "Tapa Tosomela", "Nedinole Gasilopu"])


def brute_score(model, word, lang):
    """Sum over all segmentations, by recursion."""
    c = model.langs.index(lang)

    def rest(at, text):
        if at == len(text):
            return 1.0
        total = 0.0
        for j in range(at + 1, len(text) + 1):
            k = model.pieces.get(text[at:j])
            if k is not None:
                total += model.probs[k, c] * rest(j, text)
            elif j == at + 1:
                total += np.prod([model.probs[model.pieces[f"<0x{b:02X}>"], c] for b in text[at].encode()]) * rest(j, text)
        return total

    return np.log(rest(0, "▁" + word))


def test_forward_equals_all_segmentations(model):
    for word in ("boat", "río", "木船", "xq", "ŋ", "woman"):
        for lang in ("eng", "spa", "cmn"):
            assert model.score(word)[model.langs.index(lang)] == pytest.approx(brute_score(model, word, lang))
    assert np.isfinite(model.score("a" * 4000)).all()
    assert model.probs.sum(axis=0) == pytest.approx(1, abs=0.05)


def test_stretches(spark, model):
    rows = [
        (1, "a", 0, 1, "The old woman found the boat, (laughs) uhm la anciana encontró la canoa de madera", None, "eng"), (2, "a", 0, 1, "那位老太太在河边找到了那条木船。", None, "cmn"), (3, "a", 0, 1, "mi tío limpió la olla rota", None, "und"),
        (4, "a", 0, 1, "yes", None, None), (5, "a", 0, 1, None, None, "eng"), (6, "a", 0, 1, "", None, "eng"), (7, "a", 0, 1, "a stranger carried the heavy box " * 3000, None, "spa"), (8, "a", 0, 1, "Mapovene Kodakubun Nedinole Gasilopu Mapovene", None, None),
    ]
    found = langid.language_stretches(utter(spark, rows), model)
    assert {(r["seq"], r["lang"]) for r in langid.mislabelled(found).collect()} == {(1, "eng"), (1, "spa"), (3, "spa"), (7, "eng")}
    assert all(0 < r["confidence"] <= 1 for r in found.collect())
    assert {r["id"] for r in langid.language_stretches(utter(spark, rows), model, whole=True).collect()} == {1, 2, 3, 4, 7}
    assert langid.mislabelled(langid.language_stretches(utter(spark, []), model)).count() == 0


def test_all_names_fit_the_model(spark):
    """Those at the end of the alphabet too, in any number; without names there is no model of them."""
    rng = random.Random(4)
    names = [f"{x.capitalize()} {y.capitalize()}" for x, y in zip(words(rng, 4500), words(rng, 4500))] + ["Zuzo Zozuŋꜩ"] * 9
    rows = [(la, t) for la, some in SENTENCES.items() for t in some]
    samples = spark.createDataFrame(rows, "lang string, text string")
    speakers = spark.createDataFrame([(n,) for n in [*names, None, ""]], "full_name string")
    got, want = langid.fit_from_tables(samples, speakers.repartition(3)), langid.fit_pieces(rows, names)
    assert got.langs == want.langs and got.names >= 0
    assert got.probs == pytest.approx(want.probs, rel=1e-9)
    assert langid.fit_from_tables(samples, speakers.where("false")).langs == langid.fit_pieces(rows).langs


def test_confidence_is_calibrated():
    """On fragments of held-out samples, confidence and accuracy agree to within 0.05 on average."""
    rows = list(pd.read_parquet("/root/testdata/sf0.001/lang_samples.parquet")[["lang", "text"]].itertuples(index=False, name=None))
    sure, right = [], []
    for h in (0, 1):
        held = langid.fit_pieces([r for k, r in enumerate(rows) if k % 2 != h])
        cut = langid.Segmenter(held)
        for lang, text in rows[h::2]:
            w = langid.words_of(text)
            for n in (1, 2, 3):
                for part in (w[a : a + n] for a in range(0, len(w) - n + 1, n)):
                    if len(found := cut.stretches(" ".join(part))) == 1:
                        sure.append(found[0][4]), right.append(found[0][0] == lang)
    sure, right = np.array(sure), np.array(right)
    level = np.minimum((sure * 10).astype(int), 9)
    assert len(sure) > 3000 and sum(abs(sure[level == k].sum() - right[level == k].sum()) for k in range(10)) / len(sure) < 0.05


def test_held_out_accuracy():
    con = pytest.importorskip("duckdb").connect()
    rows = con.execute("SELECT sample_id, lang, text FROM '/root/testdata/sf0.001/lang_samples.parquet'").fetchall()
    fitted = langid.fit_pieces([(la, t) for i, la, t in rows if i % 4], [])
    cut = langid.Segmenter(fitted)
    held = [(la, cut.stretches(unify.fold_text(t))) for i, la, t in rows if i % 4 == 0]
    assert sum(bool(p) and max(p, key=lambda x: x[2])[0] == la for la, p in held) >= 0.97 * len(held)


# ---- splits


def test_components_equal_union_find(spark):
    rng = random.Random(4)
    edges = [(f"n{rng.randrange(120)}", f"v{rng.randrange(150)}") for _ in range(170)] + [(f"chain{k}", f"c{k + d}") for k in range(40) for d in (0, 1)] + [("alone", None), (None, "v1"), ("n0", "v0"), ("n0", "v0")]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for n, v in edges:
        if n and v:
            parent[find("￿" + v)] = find(n)
        elif n:
            find(n)
    groups = {}
    for n in {e[0] for e in edges if e[0]}:
        groups.setdefault(find(n), set()).add(n)
    expected = {n: min(g) for g in groups.values() for n in g}
    df = spark.createDataFrame([(n, v, "x") for n, v in edges], "node string, value string, parent string")
    assert {r["node"]: r["component"] for r in splits.components(df).collect()} == expected
    assert splits.components(df.where("false")).count() == 0


def test_choose_totals_is_closest():
    rng = random.Random(5)
    for _ in range(30):
        sizes = {rng.randrange(1, 40): rng.randrange(1, 4) for _ in range(5)}
        total = sum(s * n for s, n in sizes.items())
        target = round(0.2 * total)
        sums = {0}
        for s, n in sizes.items():
            for _ in range(n):
                sums |= {x + s for x in sums}
        chosen = splits.choose_totals(list(sizes.items()), [("test", 0.2), ("train", 0.8)])
        got = sum(s * k for s, k in chosen["test"].items())
        assert abs(got - target) == min(abs(x - target) for x in sums if x <= 2 * target)
        assert all(chosen["test"].get(s, 0) + chosen["train"].get(s, 0) == n for s, n in sizes.items())


@pytest.mark.parametrize("size", [3, 5, 14, 38])
def test_large_totals_are_exact(size):
    """Ten million rows: a multiple of the size lies within half a size of 5 %, and with some ones 5 % is met exactly."""
    n = 10_000_000 // size
    shares = [("test", 0.05), ("valid", 0.05), ("train", 0.9)]
    chosen = splits.choose_totals([(size, n)], shares)
    for name in ("test", "valid"):
        assert abs(sum(s * k for s, k in chosen[name].items()) - 0.05 * size * n) <= size / 2 + 1
    sizes = {size: n, 977: 40, 1: 60}
    total = sum(s * k for s, k in sizes.items())
    chosen = splits.choose_totals(list(sizes.items()), shares)
    for name in ("test", "valid"):
        assert sum(s * k for s, k in chosen[name].items()) == round(0.05 * total)
    assert all(sum(chosen[name].get(s, 0) for name in chosen) == k for s, k in sizes.items())


def test_totals_of_very_many_records():
    """The shares are met to the record, and the bitset stays small, at 10^10 records."""
    for n in (10**6, 10**8, 10**10):
        histogram = [(1, n), (3, n // 10), (5, n // 20)]
        total = sum(s * k for s, k in histogram)
        chosen = splits.choose_totals(histogram, [("train", 0.8), ("valid", 0.1), ("test", 0.1)])
        for name, share in (("valid", 0.1), ("test", 0.1)):
            assert sum(s * k for s, k in chosen[name].items()) == round(share * total)
        assert all(sum(c.get(s, 0) for c in chosen.values()) == k for s, k in histogram)
    rng = random.Random(3)
    for _ in range(20):  # against the same sums without taking any for sure
        histogram = [(s, rng.randrange(200, 600)) for s in rng.sample(range(4, 40, 2), 3)]
        total = sum(s * k for s, k in histogram)
        sums = {0}
        for s, k in histogram:
            sums = {x + s * c for x in sums for c in range(min(k, total // 10 // s + 20) + 1) if x + s * c <= total // 5}
        chosen = splits.choose_totals(histogram, [("a", 0.9), ("b", 0.1)])
        got = sum(s * k for s, k in chosen["b"].items())
        assert abs(got - round(0.1 * total)) == min(abs(x - round(0.1 * total)) for x in sums)


def test_assign_splits(spark):
    members = spark.createDataFrame([(f"c{k}", k % 7 + 1, "e") for k in range(300)] + [("c0", 4, "e"), (None, 3, "e"), ("z", None, "e")], "component string, n int, split string")
    targets = spark.createDataFrame([("test", 0.05), ("train", 0.9), ("valid", 0.05)], "split_name string, share double")
    rows = splits.assign_splits(members, targets).collect()
    assert len(rows) == 301 and len({r["component"] for r in rows}) == 301
    total = sum(r["size"] for r in rows)
    for name in ("test", "valid"):
        assert abs(sum(r["size"] for r in rows if r["split"] == name) - 0.05 * total) <= 1
    assert splits.assign_splits(members.where("false"), targets).count() == 0


# ---- pieces


def test_best_cuts_equal_brute_force():
    import itertools

    rng = random.Random(6)
    for _ in range(25):
        inner = sorted(rng.sample(range(1, 60), 7))
        at, cost = np.array([0, *inner, 60]), np.array([0.0, *[rng.random() for _ in inner], 0.0])
        limit, overlap = 25, 3

        def price(path):
            total, count = 60, 1 + max(1, -(-(60 - limit) // (limit - overlap)))
            ideal, value = total / count, 0.0
            for i, j in zip(path, path[1:]):
                if at[j] - at[i] > (limit if at[i] == 0 else limit - overlap):
                    return np.inf
                value += cost[j] + pieces.EACH + pieces.BALANCE * ((at[j] - at[i] - ideal) / ideal) ** 2
            return value

        best = min(price((0, *c, 8)) for n in range(8) for c in itertools.combinations(range(1, 8), n))
        if np.isfinite(best):
            assert price(pieces.best_cuts(at, cost, limit, overlap)) == pytest.approx(best)


@pytest.mark.parametrize("seed", range(3))
def test_pieces_keep_the_limit(spark, seed):
    rng = random.Random(seed)
    rows, k = [], 0
    for media in ("a", "b", "c", "long"):
        at = 0
        for _ in range(400 if media == "long" else 60):
            k += 1
            length = rng.choice([10, 80, 200, 299, 300, 301, 650]) * 100
            rows.append((k, media, at, at + length, "t", None))
            at += length + rng.choice([0, 0, 1, 50, 5000, 80_000])
    rows += [(9001, "null", None, 5, "t", None), (9002, "null", 5, None, "t", None), (9003, "back", 9, 3, "t", None), (9004, None, 0, 400_000, "t", None), (9005, "a", 0, 10, "t", None)]
    found = pieces.recording_pieces(utter(spark, rows), limit_ms=30_000, overlap_ms=200, block_ms=600_000).collect()
    by = {}
    for r in found:
        by.setdefault(r["media"], []).append(r)
    assert set(by) == {"a.wav", "b.wav", "c.wav", "long.wav"}
    for media, some in by.items():
        some.sort(key=lambda r: r["from_ms"])
        cover = sorted((r[2], r[3]) for r in rows if r[1] and f"{r[1]}.wav" == media and r[2] is not None and r[3] and r[3] > r[2])
        assert some[0]["from_ms"] == 0 and some[-1]["to_ms"] == max(e for _, e in cover) and some[-1]["cut"] == "end"
        assert all(r["to_ms"] - r["from_ms"] <= 30_000 for r in some)
        for x, y in zip(some, some[1:]):
            assert y["from_ms"] == x["to_ms"] - 200
            merged = []
            for a, b in cover:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            stretch = [b - a for a, b in merged if a < x["to_ms"] < b]
            assert (x["cut"] == "forced") == bool(stretch)
            if stretch:
                assert x["stretch_ms"] == stretch[0] and stretch[0] > 29_800
    # Blocks change nothing: the sum of the prices is the same as over the whole recording at once.
    whole = pieces.recording_pieces(utter(spark, rows), limit_ms=30_000, overlap_ms=200, block_ms=10**9).collect()
    blocks = pieces.recording_pieces(utter(spark, rows), limit_ms=30_000, overlap_ms=200, block_ms=60_000).collect()
    cover = sorted((r[2], r[3]) for r in rows if r[1] == "long")
    merged = []
    for a, b in cover:
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    size, span = merged[-1][1], 29_800
    units = [(0, merged[0][0], 0)] * (merged[0][0] > 0) + sorted([(a[1], b[0], 0) for a, b in zip(merged, merged[1:])] + [(a, b, 1) for a, b in merged if b - a > span])
    at, cost, _ = pieces.cut_positions(0, 10**9, units, span, size)
    prices, ideal = dict(zip(at.tolist(), cost)), pieces.ideal_size(size, 30_000, 200)

    def price(some):
        ends = [0, *sorted(r["to_ms"] for r in some if r["media"] == "long.wav")]
        return sum(prices[y] + pieces.EACH + pieces.BALANCE * ((y - x - ideal) / ideal) ** 2 for x, y in zip(ends, ends[1:]))

    assert price(whole) == pytest.approx(price(found), rel=1e-9) and price(whole) == pytest.approx(price(blocks), rel=1e-9)
    with pytest.raises(ValueError):
        pieces.recording_pieces(utter(spark, rows), limit_ms=100, overlap_ms=100)
    assert pieces.recording_pieces(utter(spark, [])).count() == 0


# ---- look-alikes


def test_lookalikes(spark):
    base = "Kọ́n a-b 'x' fin: Mapo"
    same = ["Ｋọ́n a-b 'x' fin: Mapo", "Kọ́n a‑b ʼxʼ ﬁn: Маро", "Kọ́n a-b ’x’ f​i­n: Mapo", "Kọ́n a-b 'x' fin⁠: Mapo"]
    other = ["kọ́n a-b 'x' fin: Mapo", "Kọn a-b 'x' fin: Mapo", "Kọ́n  a-b 'x' fin: Mapo", "Kọ́n a-b 'x' fin: Mäpo", " ", "　", "​", "", None]
    texts = [base, base, *same, *other, "Long " * 5000, "Ｌong " * 5000]
    df = utter(spark, [(k, "a", 0, 1, t, None) for k, t in enumerate(texts)])
    got = {(r["seq_a"], r["seq_b"]) for r in unify.lookalike_pairs(df).collect()}
    key = {k: unify.fold_text(t).strip() for k, t in enumerate(texts) if t is not None}
    expected = {(a, b) for a in key for b in key if a < b and key[a] and key[a] == key[b] and texts[a] != texts[b]}
    assert got == expected and (2, 4) in got and (0, 1) not in got and not any({a, b} & set(range(6, 15)) for a, b in got)
    canonical = {r["seq"]: r["canonical"] for r in unify.with_canonical(df).collect()}
    assert len(canonical) == len(texts) and len({canonical[k] for k in range(6)}) == 1 and canonical[0] != canonical[6] and canonical[14] is None
    assert unify.lookalike_pairs(df.where("false")).count() == 0 and unify.with_canonical(df.where("false")).count() == 0


def test_hot_texts_and_rare_forms(spark):
    """A text that makes up most rows meets its look-alikes; letters of further scripts, wide signs and numerals fold."""
    rows = [(k, "a", 0, 1, "Mapo Kon" if k < 300 else ["Ｍapo Kon", "Марo Kon", "Μaрo Kon"][k % 3], None) for k in range(306)]
    pairs = {(r["seq_a"], r["seq_b"]) for r in unify.lookalike_pairs(utter(spark, rows)).collect()}
    assert pairs == {(a, b) for a in range(306) for b in range(300, 306) if a < b and rows[a][4] != rows[b][4]}
    df = unify.with_canonical(utter(spark, rows))
    assert {r["canonical"] for r in df.collect()} == {"Mapo Kon"} and df.count() == 306
    assert unify.fold_text("ᎪᏢ ՕհՏ νϲ Ⅹ ￠ Ӏ") == "AP OhS vc X ¢ I"
    assert {unify.fold_text(c) for c in "𝐀αаı"} == {"𝐀", "α", "a", "ı"}


def test_only_unordered_marks_visit_python():
    """Whatever NFC would change is found by the pattern that sends texts to Python."""
    pattern = re.compile(unify._UNORDERED.replace("\\\\", "\\").replace("\\p{M}", "[̀-ͯ]"))
    for base in map(chr, [*range(0x20, 0x370), *range(0x1E00, 0x1F00)]):
        for mark in map(chr, range(0x300, 0x370)):
            text = base + mark
            assert unicodedata.normalize("NFC", text) == text or pattern.search(text), (hex(ord(base)), hex(ord(mark)))
    for c in map(chr, range(0x20, 0x3000)):
        assert unicodedata.normalize("NFC", c) == c or pattern.search(c), hex(ord(c))


# ---- leaks


def words(rng, n):
    return ["".join(rng.choice("bdgkmnprst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n)]


def brute_held(item, doc):
    """Longest passage only, between equal words: over all pairs of intervals, edit distance at most an eighth."""
    best = 0
    for a in range(len(item)):
        for b in range(a + 12, len(item) + 1):
            for c in range(len(doc)):
                row = list(range(b - a + 1))
                for d in range(c, min(len(doc), c + (b - a) * 9 // 8 + 1)):
                    after = [row[0] + 1]
                    for k in range(1, b - a + 1):
                        after.append(min(row[k] + 1, after[-1] + 1, row[k - 1] + (item[a + k - 1] != doc[d])))
                    row = after
                    if row[-1] * 8 <= b - a and b - a > best and item[a] == doc[c] and item[b - 1] == doc[d]:
                        best = b - a
    return best


def bound(item, doc):
    return leaks.bands(np.array(item), leaks.Grams(np.array(doc)))[0]


def altered(rng, part, wrong):
    """``part`` with a word changed, dropped or added at ``wrong`` inner places."""
    out = list(part)
    for k in sorted(rng.sample(range(1, len(part) - 1), wrong), reverse=True):
        out[k : k + 1] = rng.choice([[5000 + k], [], [5000 + k, part[k]]])
    return out


@pytest.mark.parametrize("size", [12, 14, 16, 20, 24, 32, 40, 56, 64])
def test_no_allowed_passage_is_lost(size):
    """Every number of errors that the size allows, anywhere inside; two passages of one item; bounds hold."""
    rng = random.Random(size)
    other = lambda n: [rng.randrange(2000, 3000) for _ in range(n)]
    for wrong in range(1, size // 8 + 1):
        for _ in range(12):
            item = [rng.randrange(1000) for _ in range(round(size / 0.7))]
            at = rng.randrange(len(item) - size + 1)
            doc = other(30) + altered(rng, item[at : at + size], wrong) + other(30)
            held = leaks.held_words(np.array(item), np.array(doc))
            assert bound(item, doc) >= held >= size
            twice = item + other(3) + [rng.randrange(1000, 2000) for _ in range(size)]
            doc = other(9) + altered(rng, twice[-size:], wrong) + other(9) + doc
            assert bound(twice, doc) >= leaks.held_words(np.array(twice), np.array(doc)) >= 2 * size


def test_held_words_against_brute_force():
    rng = random.Random(8)
    for trial in range(6):
        item = [rng.randrange(1000) for _ in range(24)]
        doc = [rng.randrange(1000) for _ in range(6)] + item[4:20] + [rng.randrange(1000) for _ in range(6)]
        if trial % 3 == 1:
            doc[12] = 5000
        if trial % 3 == 2:
            del doc[13]
        held = leaks.held_words(np.array(item), np.array(doc))
        assert held == brute_held(item, doc) >= 12
        assert bound(item, doc) >= held and leaks.longest_run(np.array(item), leaks.Grams(np.array(doc))) <= 16
    long = np.array([*range(100_000, 150_000), *item, *range(200_000, 250_000)])
    assert leaks.held_words(np.array(item), long) == 24


def test_errors_near_the_ends_of_a_passage():
    rng = random.Random(12)
    for size, wrong in [(12, [k]) for k in range(1, 11)] + [(16, [4, 10]), (16, [2, 13]), (16, [1, 5]), (20, [2, 17]), (24, [1, 2, 22])]:
        for kind in ("change", "drop", "add"):
            item = [rng.randrange(1000) for _ in range(24)]
            part = item[:size]
            for k in reversed(wrong):
                part[k : k + 1] = {"change": [5000], "drop": [], "add": [5000, part[k]]}[kind]
            doc = [rng.randrange(2000, 3000) for _ in range(5)] + part + [rng.randrange(2000, 3000) for _ in range(5)]
            assert leaks.held_words(np.array(item), np.array(doc)) == brute_held(item, doc) >= size


def test_leaks(spark):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, 40)), "x", "t") for k in range(12)] + [(90, None, "x", "t"), (91, "", "x", "t")]
    docs = []
    for k in range(120):
        filler = words(rng, 60)
        docs.append((k, " ".join(filler), "s"))
    whole = items[0][1].split()
    changed = [w if n % 9 else "zzz" for n, w in enumerate(items[1][1].split())]
    docs += [
        (200, " ".join(words(rng, 30) + whole + words(rng, 30)), "s"), (201, " ".join(changed).upper().replace(" ", ",\n"), "s"), (202, " ".join(whole[:19] + words(rng, 20)), "s"),
        (203, " ".join(whole[:14] + words(rng, 20) + whole[20:34]), "s"), (204, " ".join(words(rng, 3000) + items[2][1].split()), "s"), (205, None, "s"), (206, "", "s"), (None, items[3][1], "s"), (200, " ".join(whole), "s"),
    ]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, id string")
    i = spark.createDataFrame(items, "item_id bigint, text string, lang string, task string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(leaks.leaked_items(d, i)).collect()}
    assert found == {(200, 0), (201, 1), (203, 0), (204, 2)}
    assert leaks.leaks(leaks.leaked_items(d, i.where("false"))).count() == 0 and leaks.leaks(leaks.leaked_items(d.where("false"), i)).count() == 0
    report = leaks.leaked_items(d, i, whole=True).where("doc_id = 202").first()
    assert report["held"] == 19 and report["item_words"] == 40


def test_long_items_and_many_items(spark):
    """An item of 1,000 words held in scattered passages of twelve words, and more items than share a latent space."""
    rng = random.Random(15)
    texts = [words(rng, 1000), *(words(rng, 30) for _ in range(700))]
    pieces_ = [x for at in range(0, 1000, 20) for x in texts[0][at : at + 12] + words(rng, 12)]
    docs = [(0, " ".join(pieces_)), *((k, " ".join(words(rng, 20) + texts[k][5:25] + words(rng, 20))) for k in range(1, 701, 10)), (9999, " ".join(words(rng, 2000)))]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(leaks.leaked_items(d, i)).collect()}
    assert found == {(k, k) for k, _ in docs[:-1]}


def test_recall_of_the_latent_index(spark):
    """Against the cosine of all windows with all items without any bound or projection."""
    rng = random.Random(10)
    items = spark.createDataFrame([(k, " ".join(words(rng, 30))) for k in range(40)], "id bigint, text string")
    texts = [r["text"].split() for r in items.orderBy("id").collect()]
    docs = [(k, " ".join(words(rng, 20) + texts[k % 40][5:25] + words(rng, 20))) for k in range(80)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaked_items(d, items.withColumnRenamed("id", "item_id")).collect()}
    assert sum((k, k % 40) in got for k in range(80)) >= 72


# ---- mixing


def test_mix(spark):
    docs = [(k, "word " * (5 + k % 7), "eng", ["big", "mid", "small"][k % 10 > 5 + (k % 10 > 8)] if k % 10 < 9 else "small", "c", "k") for k in range(400)]
    docs += [(900 + k, "word word", None, None, None, "k") for k in range(20)] + [(990, None, None, "big", None, None), (991, "", None, "other", None, None), (None, "word", None, "mid", None, None)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, collection string, kind string").withColumn("tokens", F.lit("clash")).withColumn("rate", F.lit(1))
    goals = spark.createDataFrame([("big", 0.3, 1), ("mid", 0.2, 2), ("small", 0.4, 2), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    mix, report = mixing.mix_sources(d, goals)
    rows = {r["source"]: r for r in report.collect()}
    counted = {r["source"]: r["t"] for r in mixing.with_tokens(d, ["source"]).groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sum(counted.values())
    short = {r["source"] for r in mixing.short_sources(report).collect()}
    assert short == {s for s, share, most in (("big", 0.3, 1), ("mid", 0.2, 2), ("small", 0.4, 2), ("none", 0.1, 3)) if counted.get(s, 0) * most < share * total} and "none" in short
    for s, r in rows.items():
        assert r["tokens"] == counted.get(s, 0) and r["drawn_tokens"] <= r["capacity"]
        if s not in short:
            assert r["drawn_tokens"] + r["unlabelled_tokens"] == pytest.approx(r["aimed_tokens"], abs=30)
            assert r["aimed_tokens"] > r["target_tokens"]  # makes up for what others lack
    assert sum(r["actual_share"] for r in rows.values()) == pytest.approx(1)
    assert sum(r["drawn_tokens"] + r["unlabelled_tokens"] for r in rows.values()) == pytest.approx(mix.selectExpr("sum(tokens * repeats)").first()[0])
    assert mix.count() == len(docs) and mix.where("source = 'other' AND repeats > 0").count() == 0
    empty, none = mixing.mix_sources(d.where("false"), goals)
    assert empty.count() == 0 and none.count() == 4


def test_shortage_is_made_up_in_proportion():
    assert mixing.reachable([0.5, 0.3, 0.2], [1000.0, 1000.0, 1000.0], 100) == [50, 30, 20]
    assert mixing.reachable([0.5, 0.3, 0.2], [1000.0, 1000.0, 0.0], 100) == pytest.approx([62.5, 37.5, 0])
    assert mixing.reachable([0.5, 0.3, 0.2], [55.0, 1000.0, 0.0], 100) == pytest.approx([55, 45, 0])
    assert mixing.reachable([0.5, 0.3], [10.0, 10.0], 100) == [10, 10]


def test_posteriors_tell_sources_apart(spark):
    rng = random.Random(8)
    docs = []
    for k in range(600):
        s = ["red", "blue"][k % 2]
        docs.append((k, " ".join("rb"[(s == "red") != (rng.random() < 0.8)] + str(rng.randrange(40)) for _ in range(12)), s if k >= 60 else None, s))
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, truth string").select("*", *[F.lit(None).cast("string").alias(c) for c in mixing.FIELDS])
    rows = mixing.materialize(mixing.described(d, ["blue", "red"]), "t")
    found = rows.join(mixing.source_posteriors(rows, ["blue", "red"], len(mixing.FIELDS)), "row").join(d.select("doc_id", "truth"), "doc_id").collect()
    assert len(found) == 60 and all(sum(r["p"]) == pytest.approx(1) for r in found)
    assert sum((r["p"][1] > 0.5) == (r["truth"] == "red") for r in found) >= 57
    # Sources that no feature tells apart keep their shares.
    d = spark.createDataFrame([(k, "same words", ["a", "b", "a", None][k % 4], None, None, None) for k in range(400)], "doc_id bigint, text string, source string, collection string, kind string, lang string")
    rows = mixing.materialize(mixing.described(d, ["a", "b"]), "t")
    assert all(r["p"][0] == pytest.approx(2 / 3, abs=0.05) for r in mixing.source_posteriors(rows, ["a", "b"], len(mixing.FIELDS)).collect())


# ---- subjects


AREAS = {"law": "court judge verdict lawsuit statute".split(), "sport": "match goal referee team score".split(), "music": "song violin melody chorus drum".split()}
PLAIN = "the woman carried a box near river house blanket rope old knife after rain".split()


def sentence(rng, area=None):
    some = [rng.choice(PLAIN) for _ in range(6)]
    if area:
        some[1], some[4] = rng.choice(AREAS[area]), rng.choice(AREAS[area])
    return " ".join(some).capitalize() + "."


def made(rng, n):
    rows = []
    for k in range(n):
        about = rng.sample(sorted(AREAS), rng.choice([0, 1, 1, 2]))
        parts = [a for a in about for _ in range(4)] + [None] * 4 + [rng.choice(sorted(AREAS))] * (rng.random() < 0.4)
        rng.shuffle(parts)
        rows.append((k, " ".join(sentence(rng, a) for a in parts), rng.choice(["s1", None]), "story", set(about)))
    return rows


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(11)
    rows = made(rng, 320)
    labels = [(k, s) for k, _, _, _, about in rows[:200] for s in (about or {"none"})]
    labels += [(k, rng.choice(sorted(AREAS))) for k in range(0, 200, 25)] + [(None, "law"), (3, None), (5000, "law")]
    docs = [(k, t, s, kind, "clash") for k, t, s, kind, _ in rows] + [(800, None, None, None, "x"), (801, "", None, None, "x"), (802, rows[0][1] * 300, "s1", None, "x"), (None, "text", None, None, "x")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string, kind string, subjects string")
    la = spark.createDataFrame(labels, "doc_id bigint, subject string")
    areas = spark.createDataFrame([(a, "") for a in AREAS], "subject string, description string")
    samples = spark.createDataFrame([("eng", " ".join(PLAIN))], "lang string, text string")
    found = {(r["doc_id"], r["subject"]) for r in subjects.document_subjects(d, la, areas, samples).collect()}
    truth = {(k, s) for k, _, _, _, about in rows[200:] for s in about}
    held = {x for x in found if x[0] is not None and 200 <= x[0] < 320}
    assert len(held & truth) >= 0.95 * len(truth) and len(held & truth) >= 0.95 * len(held)
    assert not any(x[0] in (800, 801) for x in found)
    assert {s for k, s in found if k == 802} == {s for k, s in found if k == 0}
    assert subjects.document_subjects(d, la.where("false"), areas, samples).count() == 0
    assert subjects.document_subjects(d.where("false"), la, areas, samples).count() == 0


def test_beam_finds_the_likeliest_combination():
    rng = np.random.default_rng(12)
    k, n = 4, 15
    chain = subjects.Chain([f"s{x}" for x in range(k)], [2, 0, 3, 1], np.zeros((1, 1)), [], [], platt=[(1.0, 0.0)] * k)
    features = rng.random((n, 3 * k + 2))
    chain.links = [rng.normal(size=3 + 3 + 2 + link + 1) for link in range(k)]
    got, _ = subjects.decode(chain, features, beam=32)

    def score(row, labels):
        total = 0.0
        for link, s in enumerate(chain.order):
            z = subjects._design(row[None], k, s, np.array([[labels[x] for x in chain.order[:link]]], dtype=float).reshape(1, link)) @ chain.links[link]
            total -= np.logaddexp(0, -z[0] if labels[s] else z[0])
        return total

    for row, labels in zip(features, got):
        best = max(([int(c) for c in f"{x:04b}"] for x in range(16)), key=lambda y: score(row, y))
        assert labels.astype(int).tolist() == best


def test_no_rows_break_fitting():
    cut = subjects.SentenceTerms(keep_words=True)
    terms, sizes = cut("one two three.")
    frame = pd.DataFrame({"terms": [terms], "sizes": [sizes], "source": [None], "kind": [None], "subjects": [["law"]]})
    chain = subjects.fit_chain(frame, ["law", "sport"], subjects.language_scores(cut.words, langid.fit_pieces([("eng", "one two three")])))
    assert len(chain.links) == 2


def test_short_sentences_count():
    size = lambda text: subjects.SentenceTerms()(text)[1].tolist()
    assert size("Yes. The court gave a verdict. No. Why?") == [1, 5, 1, 1]
    assert size("R. Mudamuba spoke. 1. \n\n K. Rana left. 好。") == [3, 3, 1] and size("A.") == [1] and size("...") == []


def test_three_subjects_of_one_document(spark):
    """A document may be about any number of subjects that hold a quarter of its sentences."""
    rng = random.Random(21)
    rows = []
    for k in range(400):
        about = rng.sample(sorted(AREAS), rng.choice([0, 1, 2, 3]))
        parts = [a for a in about for _ in range(5)] + [None] * 2
        rng.shuffle(parts)
        rows.append((k, " ".join(sentence(rng, a) for a in parts), "s", "story", set(about)))
    d = spark.createDataFrame([r[:4] for r in rows], "doc_id bigint, text string, source string, kind string")
    la = spark.createDataFrame([(r[0], s) for r in rows[:300] for s in (r[4] or {"none"})], "doc_id bigint, subject string")
    samples = spark.createDataFrame([("eng", " ".join(PLAIN))], "lang string, text string")
    found: dict[int, set[str]] = {}
    for r in subjects.document_subjects(d, la, spark.createDataFrame([(a, "") for a in AREAS], "subject string, description string"), samples).collect():
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    three = [r for r in rows[300:] if len(r[4]) == 3]
    assert len(three) > 10 and sum(found.get(r[0]) == r[4] for r in three) >= 0.6 * len(three)


def test_the_fitting_sample_is_bounded(spark):
    d = spark.createDataFrame([(k, "one two three four.", "s", "k") for k in range(50)], "doc_id bigint, text string, source string, kind string")
    la = spark.createDataFrame([(k, "law") for k in range(50)], "doc_id bigint, subject string")
    rows, words_ = subjects.labelled_terms(d, la, most=40, most_terms=100)
    assert len(rows) == 25 and len(words_) == 4 and len(subjects.labelled_terms(d, la, most=10)[0]) == 10


def test_every_character_folds_as_the_table_says(spark):
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10010)]]
    rows = spark.createDataFrame([(c,) for c in chars], "c string").select("c", unify.fold_lookalikes(F.col("c")).alias("f")).collect()
    assert [r["c"] for r in rows if r["f"] != r["c"].translate(unify._TABLE)] == []
