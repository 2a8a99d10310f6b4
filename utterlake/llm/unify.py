"""One form for texts that look the same on the page.

Look-alike letters, full-width forms and blanks are mapped in SQL, invisible characters go, combining marks take
their composed order, and the mapped values are grouped under accent-sensitive Unicode collation, where case and
marks still count. The least text of each class is its canonical member.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from utterlake.session import materialize

# Letters of other scripts drawn like a Latin one, by script, beside the Latin letter.
CYRILLIC, CYRILLIC_AS = "АВЕЅІЈКМНОРСТУХаеѕіјорсухәһԁԛԝѴѵӀӏҮԌԜԚ", "ABESIJKMHOPCTYXaesijopcyxəhdqwVvIlYGWQ"
GREEK, GREEK_AS = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονϳϲϹͿ", "ABEZHIKMNOPTYXovjcCJ"
LATIN, LATIN_AS = "ɡǝǀ", "gə|"
ARMENIAN, ARMENIAN_AS = "ՍՏՕհոսօ", "USOhnuo"
CHEROKEE, CHEROKEE_AS = "ᎠᎪᎬᎫᎢᎡᎳᎷᎻᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DAEJTRWMHGZVSLCPKB"
# Marks drawn alike (apostrophes, hyphens that do not break, one-dot leader, ratio sign).
MARKS, MARKS_AS = "\u2019\u02bc\u2010\u2011\u2024\u2236", "''--.:"
#: Blanks of one character.
BLANKS = "\t\n\u000b\f\r\u0085  " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
#: Characters without any visible form: controls, soft hyphen, zero-width and directional marks, variation selectors.
INVISIBLE = (
    "".join(map(chr, [*range(0x00, 0x09), *range(0x0E, 0x20), *range(0x7F, 0x85), *range(0x86, 0xA0)]))
    + "­͏؜ᅟᅠ឴឵᠋᠌᠍᠎﻿"
    + "".join(map(chr, [*range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), *range(0xFE00, 0xFE10)]))
)
#: Wide forms, and Roman numerals of one letter, by their compatibility forms; styled letters have another shape.
_WIDE = "".join(c for c in map(chr, [*range(0xFF01, 0xFF5F), *range(0xFFE0, 0xFFE7), *range(0x2160, 0x2180)]) if len(unicodedata.normalize("NFKC", c)) == 1)
_WIDE_AS = unicodedata.normalize("NFKC", _WIDE)
LIGATURES = ["ff", "fi", "fl", "ffi", "ffl"]  # from U+FB00 on
_FROM = CYRILLIC + GREEK + LATIN + ARMENIAN + CHEROKEE + MARKS + _WIDE + BLANKS + INVISIBLE
_TO = CYRILLIC_AS + GREEK_AS + LATIN_AS + ARMENIAN_AS + CHEROKEE_AS + MARKS_AS + _WIDE_AS + " " * len(BLANKS)


def _outside(changed: str) -> str:
    """Pattern of one character of ``changed``: the negated class of all others, the widest ranges first, so that a
    plain character is settled by the first few comparisons."""
    points = sorted({-1, 0xD7FF, 0xDFFF, 0x10000} | set(map(ord, changed)))
    ranges = [(a + 1, b - 1) for a, b in zip(points, points[1:]) if b - a > 1 and not 0xD7FF <= a < 0xDFFF]
    ranges = sorted(ranges, key=lambda r: (r[0] > 0x7E, r[0] - r[1])) + [(0x10000, 0x10FFFF), (0xD7FF, 0xD7FF)]
    return "[^" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges) + "]"


_NEEDS = _outside(_FROM + "".join(map(chr, range(0xFB00, 0xFB05))))


def fold_lookalikes(text: Column) -> Column:
    """``text`` with look-alike letters, wide forms, blanks and ligatures mapped and invisible characters removed; null stays null."""
    folded = F.translate(text, _FROM, _TO)
    for i, letters in enumerate(LIGATURES):
        folded = F.replace(folded, F.lit(chr(0xFB00 + i)), F.lit(letters))
    return F.when(text.rlike(_NEEDS), folded).otherwise(text)


def fold_text(text: str) -> str:
    """``fold_lookalikes`` and composed marks for one Python string."""
    text = text.translate(_TABLE)
    return text if text.isascii() else unicodedata.normalize("NFC", text)


_TABLE = {ord(a): (_TO[i] if i < len(_TO) else None) for i, a in reversed(list(enumerate(_FROM)))} | {0xFB00 + i: x for i, x in enumerate(LIGATURES)}


@F.pandas_udf(StringType())
def _composed(text: pd.Series) -> pd.Series:
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


#: Marks that compose with Latin letters, letters they may compose with, and characters NFC replaces.
_MARKS = "\\u0300-\\u0314\\u031b\\u0323-\\u0328\\u032d\\u032e\\u0330\\u0331\\u0338\\u0342\\u0345"
_BELOW = "\\u0302\\u0304\\u0306\\u0307\\u031b\\u0323-\\u0328\\u032d\\u032e\\u0330\\u0331"
#: A character beyond U+02FF decides; what stands before it is looked at only then.
_UNORDERED = (
    f"[^\\x00-\\u02ff](?:(?<=[A-Za-z\\u00a8\\u00c0-\\u024f\\u0292][{_MARKS}])|(?<=\\p{{M}}\\p{{M}})|(?<=[\\u1e00-\\u1eff][{_BELOW}])|(?<=[<=>]\\u0338)|(?<=[\\u0370-\\u1dff\\u1f00-\\uffff]\\p{{M}})"
    "|(?<=[\\u0340\\u0341\\u0343\\u0344\\u0374\\u037e\\u0387\\u0958-\\u095f\\u09dc-\\u09df\\u0a33-\\u0a5e\\u0b5c\\u0b5d\\u0f43-\\u0fb9\\u1100-\\u11ff\\u1f71-\\u1ffd\\u2000\\u2001\\u2126\\u212a\\u212b\\u2329\\u232a\\u2adc\\uf900-\\ufaff]))"
)


def with_visual_key(df: DataFrame, text: str, out: str = "key") -> DataFrame:
    """``df`` with the mapped value of ``text`` in ``out``; texts whose values are equal under UNICODE collation look the same.

    Only texts whose marks may not be in composed order visit Python for that: collation does not reorder marks.
    """
    df = df.withColumn("__folded", fold_lookalikes(F.col(text)))
    df = df.withColumn("__composed", _composed(F.when(F.col("__folded").rlike(_UNORDERED), F.col("__folded"))))
    return df.withColumn(out, F.coalesce("__composed", "__folded")).drop("__folded", "__composed")


#: Copies of the few rows of one side of a join whose other side may hold a hot value.
SALT = 16


def _letters(key: str) -> Column:
    """Hash of the letters and figures of ``key``. Texts of one class share it: neither the collation nor invisible
    characters touch them."""
    return F.xxhash64(F.regexp_replace(key, "[^\\p{L}\\p{N}]+", ""))


def with_canonical(df: DataFrame, text: str = "text", out: str = "canonical") -> DataFrame:
    """``df`` with the canonical member of each text's class in ``out``.

    The canonical member is the least folded value of the class, so it is the same whatever the order of rows. A null
    text gets null, a text without anything visible its own class of blanks or the empty text; repeated rows get the
    same value; a column named ``out`` that is there already is replaced; an empty table stays empty.

    Most folded values are alone in their class and stand for themselves. Only values whose letters stand in two
    different values are grouped under the collation, and only those that are not canonical are joined back, by hash.
    """
    held = with_visual_key(df.drop(out), text, "__key")
    held = held.withColumn("__letters", _letters("__key")).withColumn("__h", F.xxhash64("__key")).withColumn("__g", F.hash("__key"))
    held = materialize(held, "folded")
    some = held.where("__key IS NOT NULL").groupBy("__letters").agg(*[f(c).alias(f"{n}{c}") for c in ("__h", "__g") for n, f in (("least", F.min), ("most", F.max))])
    some = materialize(some.where("least__h < most__h OR least__g < most__g").select("__letters"), "shared")
    values = held.join(some, "__letters", "left_semi").select("__key", "__h", "__g").distinct()
    values = values.withColumn("__class", F.collate("__key", "UNICODE"))
    least = values.groupBy("__class").agg(F.min("__key").alias("__least"))
    changed = values.join(least, "__class").where(F.col("__key") != F.col("__least")).select("__h", "__g", F.col("__key").alias("__value"), "__least")
    changed = materialize(changed, "changed").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALT)).cast("int")
    held = held.withColumn("__salt", salt).join(changed, ["__h", "__g", "__salt"], "left")
    form = F.when(F.col("__value") == F.col("__key"), F.col("__least")).otherwise(F.col("__key"))
    return held.withColumn(out, form).drop("__key", "__letters", "__h", "__g", "__salt", "__value", "__least")


def lookalike_pairs(df: DataFrame, key: str = "seq", text: str = "text") -> DataFrame:
    """Pairs ``(seq_a, seq_b)``, seq_a < seq_b, whose texts differ in characters but are in one class.

    Equal texts are no pair; nor are texts that are null or show nothing. Within a class the commonest text (the least
    among ties) is the hub: pairs come from rows of the other texts joined with the class, so a class in which one
    text makes up a third of all rows yields no candidates beyond its pairs and those among its rarer copies.
    A repeated key gives each pair once.
    """
    rows = df.select(F.col(key).alias("seq"), F.col(text).alias("text")).where("seq IS NOT NULL AND text IS NOT NULL")
    # Only rows whose letters stand in two different texts go on. Two hashes stand for a text.
    keyed = with_visual_key(rows, "text").withColumn("letters", _letters("key"))
    keyed = materialize(keyed.select("seq", "key", "letters", F.xxhash64("text").alias("tid"), F.hash("text").alias("tie")).where(F.trim("key") != ""), "keyed")
    sides = [f(c).alias(f"{n}_{c}") for c in ("tid", "tie") for n, f in (("least", F.min), ("most", F.max))]
    shared = keyed.groupBy("letters").agg(*sides).where("least_tid < most_tid OR least_tie < most_tie").select("letters")
    rows = materialize(keyed.join(shared, "letters", "left_semi").select("seq", "tid", "tie", "key"), "suspects")
    # Texts first, so that the collation is applied once for each distinct text.
    texts = rows.groupBy("key", "tid", "tie").agg(F.count("*").alias("n"))
    texts = texts.withColumn("class", F.collate("key", "UNICODE"))
    hub = F.row_number().over(W.partitionBy("class").orderBy(F.desc("n"), "key", "tid", "tie"))
    texts = texts.withColumn("nth", hub).withColumn("of", F.count("*").over(W.partitionBy("class"))).withColumn("canonical", F.min("key").over(W.partitionBy("class")))
    texts = texts.where("of > 1").select("tid", "tie", F.col("key").alias("tkey"), "canonical", (F.col("nth") == 1).alias("hub"))
    # A text or a class may hold a third of all rows: its rows are dealt out under a salt, the few rows that meet them copied.
    salt, salts = F.pmod(F.xxhash64("seq"), F.lit(SALT)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))
    texts = materialize(texts, "lookalikes").withColumn("salt", salts)
    held = rows.withColumn("salt", salt).join(texts, ["tid", "tie", "salt"]).where(F.col("key") == F.col("tkey")).select("seq", "tid", "tie", "key", "canonical", "hub")
    held = materialize(held, "lookalike-rows")
    a = held.where("NOT hub").select(F.col("seq").alias("a"), F.col("tid").alias("ta"), F.col("tie").alias("ua"), F.col("key").alias("ka"), "canonical", salts.alias("salt"))
    b = held.select(F.col("seq").alias("b"), F.col("tid").alias("tb"), F.col("tie").alias("ub"), F.col("key").alias("kb"), "canonical", "hub", salt.alias("salt"))
    differ = (F.col("ta") != F.col("tb")) | (F.col("ua") != F.col("ub")) | (F.col("ka") != F.col("kb"))
    pairs = a.join(b, ["canonical", "salt"]).where(differ & (F.col("hub") | (F.col("a") < F.col("b"))) & (F.col("a") != F.col("b")))
    return pairs.select(F.least("a", "b").alias("seq_a"), F.greatest("a", "b").alias("seq_b")).distinct()
