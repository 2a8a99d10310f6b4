"""Text expressions: segmentation into labels, brackets, numbers, paths. All are columns that Catalyst plans.

Texts keep their code points: nothing is normalised unless a function says so.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from utterlake.functions import inventories as inv

# The white-space characters that segmentation removes.
WHITE_SPACE = r"[\u0009-\u000d \u0085   -     　]"
#: White space at the ends of a text also includes the four separators U+001C to U+001F.
STRIPPED = r"[\u0009-\u000d\u001c- \u0085   -     　]"


def _quoted(token: str) -> str:
    """``token`` as a literal of a Java pattern."""
    return re.sub(r"([\\^$.|?*+()\[\]{}\-/])", r"\\\1", token)


def in_order(tokens: Iterable[str]) -> str:
    """Pattern that takes the first of ``tokens`` that matches.

    Tokens are grouped by their first code point, in order inside each group; tokens of other first code points cannot
    match at the same place, so the groups' order is free, and a matcher tries few alternatives at each character.
    """
    groups: dict[str, list[str]] = {}
    for t in tokens:
        groups.setdefault(t[0], []).append(t[1:])
    alone = [c for c, rests in groups.items() if set(rests) == {""}]
    parts = [f"{_quoted(c)}(?:{'|'.join(map(_quoted, dict.fromkeys(rests)))})" for c, rests in groups.items() if c not in alone]
    return "|".join(parts + ([f"[{''.join(map(_quoted, alone))}]"] if alone else []))


def alternation(tokens: Iterable[str]) -> str:
    """Pattern that takes the longest of ``tokens`` first."""
    ordered = sorted(set(tokens), key=lambda t: (-len(t), t))
    if not ordered or "" in ordered:
        raise ValueError("an inventory needs tokens, none of them empty")
    return in_order(ordered)


def is_blank(text: Column) -> Column:
    """Whether nothing but white space is in ``text``; null for null."""
    return F.regexp_replace(text, STRIPPED, "") == ""


def segment_chars(text: Column) -> Column:
    """``text`` without white space, its code points separated by spaces; null stays null."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, WHITE_SPACE, ""), r"(?s)(.)", "$1 "))


def tokens_of(text: Column, inventory: Iterable[str]) -> Column:
    """The tokens of ``inventory`` in ``text``, longest match first; characters that start none are skipped."""
    return F.regexp_extract_all(text, F.lit(f"({alternation(inventory)})"), F.lit(1))


def segment_tokens(text: Column, inventory: Iterable[str]) -> Column:
    """``tokens_of`` separated by spaces; null stays null."""
    return F.array_join(tokens_of(text, inventory), " ")


def segment_orthographic(text: Column, inventory: Sequence[str] = tuple(inv.ORTHOGRAPHIC)) -> Column:
    """Lower case, then longest-match segmentation with an orthographic inventory."""
    return segment_tokens(F.lower(text), inventory)


def _tonal_pattern(label_type: str) -> str:
    """Whatever a tonal text may hold, in the order in which it is tried."""
    fillers = ["əəə…", "mmm…", "ə…", "mm…", "m…"] if inv.TONAL_TYPES[label_type][0] else []
    phones = inv.THREE + inv.TWO + ["˧\u0329", "˧\u030d"] + inv.ONE
    return in_order(fillers + phones + inv.CONTOUR_TONES + inv.LEVEL_TONES + inv.TONE_GROUP_MARKS + inv.SYMBOLS + [" ", "\t", "\n"]) + r"|\[[^\]]*\]"


def tonal_residue(text: Column, label_type: str = "phonemes_and_tones") -> Column:
    """What no label, symbol or bracketed remark takes: empty for a tonal text."""
    return F.regexp_replace(text, _tonal_pattern(label_type), "")


def segment_tonal(text: Column, label_type: str) -> Column:
    """Labels of a tonal text, separated by spaces.

    One pattern takes, in this order, fillers, phones of three, two and one code points, tones, bracketed remarks,
    tone-group marks and symbols; what the label type leaves out is dropped after matching. A text that holds
    ``BEGAIEMENT`` is empty. A character that nothing takes, or a ``[`` that is never closed, is an error; null stays
    null.
    """
    if label_type not in inv.TONAL_TYPES:
        raise ValueError(f"unrecognized label type: {label_type}")
    kept = inv.tonal_labels(label_type)
    found = F.regexp_extract_all(text, F.lit(f"({_tonal_pattern(label_type)})"), F.lit(1))
    left = tonal_residue(text, label_type)

    def label(t: Column) -> Column:
        # A mid tone that carries a stray mark stays whatever the label type; it is told apart until the end.
        t = F.when(t.isin("˧\u0329", "˧\u030d"), "\u0000˧").otherwise(t)
        t = F.when(t == "ə…", "əəə…").when(t.isin("m…", "mm…"), "mmm…").when(t == inv.THREE[4], inv.THREE[5]).otherwise(t)
        return F.when(t.isin(*inv.TONE_GROUP_MARKS), inv.TONE_GROUP).otherwise(t)

    labels = F.filter(F.transform(found, label), lambda t: t.isin(*kept) | t.startswith("\u0000"))
    joined = F.replace(F.array_join(labels, " "), F.lit("\u0000"), F.lit(""))
    wrong = F.raise_error(F.concat(F.lit("next character not recognized: "), F.substring(left, 1, 1))).cast("string")
    return F.when(text.isNull(), F.lit(None).cast("string")).when(text.contains("BEGAIEMENT"), "").when(left != "", wrong).otherwise(joined)


def normalise_translation(text: Column, remove_brackets: bool = True) -> Column:
    """Words of a translation in lower case, without punctuation and bracketed remarks, separated by single spaces.

    Words are runs of letters, marks and digits with inner hyphens; an elided article ends with its apostrophe.
    """
    plain = remove_brackets_content(text) if remove_brackets else text
    return F.array_join(F.regexp_extract_all(F.lower(plain), F.lit(r"([\p{L}\p{M}\p{N}]+(?:-[\p{L}\p{M}\p{N}]+)*['’]?)"), F.lit(1)), " ")


def remove_brackets_content(text: Column, brackets: str = "[]") -> Column:
    """``text`` without what stands in brackets, nested ones included.

    A closing bracket outside stays; an opening one that is never closed takes the rest. The text is split at brackets,
    so the fold sees pieces, not characters.
    """
    opens, closes = brackets
    either = f"[{_quoted(opens)}{_quoted(closes)}]"
    pieces = F.split(text, f"(?={either})|(?<={either})")
    state = F.struct(F.lit(0).alias("depth"), F.lit("").alias("out"))

    def step(s: Column, piece: Column) -> Column:
        depth, out = s["depth"], s["out"]
        after = F.when(piece == opens, depth + 1).when((piece == closes) & (depth > 0), depth - 1).otherwise(depth)
        said = F.when((depth == 0) & (piece != opens), F.concat(out, piece)).otherwise(out)
        return F.struct(after.alias("depth"), said.alias("out"))

    plain = F.when(text.contains(opens), F.aggregate(pieces, state, step, lambda s: s["out"]))
    return plain.otherwise(text)


def is_number(text: Column) -> Column:
    """Whether ``text`` reads as a floating-point number (underscores between digits, inf and nan included)."""
    digits = r"\d(?:_?\d)*"
    number = rf"(?i)[+-]?(?:(?:{digits}\.?(?:{digits})?|\.{digits})(?:e[+-]?{digits})?|inf(?:inity)?|nan)"
    return text.rlike(rf"^{STRIPPED}*{number}{STRIPPED}*$")


def story_of(prefix: Column) -> Column:
    """File part of a prefix up to its first dot."""
    return F.substring_index(base_name(prefix), ".", 1)


def base_name(path: Column) -> Column:
    """What follows the last slash."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """Base name without its last suffix; a name that starts with its only dot keeps it."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def latex_escape(text: Column) -> Column:
    """Underscores escaped for LaTeX."""
    return F.replace(text, F.lit("_"), F.lit("\\_"))


def millisecs_to_secs(ms: Column) -> Column:
    return ms / F.lit(1000.0)


def frames_to_minutes(frames: Column, hop_ms: int = 10) -> Column:
    return frames * F.lit(float(hop_ms)) / F.lit(60_000.0)
