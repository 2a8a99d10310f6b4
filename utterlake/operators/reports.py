"""Text and LaTeX reports. They format bounded results (counts, a test set) on the driver, in order."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from utterlake.errors import UtterlakeError
from utterlake.functions.distance import alignment
from utterlake.functions.text import latex_escape
from utterlake.operators.scoring import confusion, deletions_by_label, error_types, top_labels


def format_error_types(arrows: DataFrame) -> str:
    """Counts of each error type, then deletions by label."""
    t = error_types(arrows).first()
    lines = [f"{name:<16}{count}" for name, count in (("Substitutions", t["substitutions"]), ("Deletions", t["deletions"]), ("Insertions", t["insertions"]))]
    return "\n".join([*lines, "", "Deletions:", *(f"{r['label']:<5}{r['count']}" for r in deletions_by_label(arrows).collect())]) + "\n"


def format_confusion(arrows: DataFrame, labels: Iterable[str], width: int = 25) -> str:
    """A square table over the commonest reference labels; a label set is needed."""
    if not list(labels):
        raise UtterlakeError("a confusion matrix needs a label set")
    axis = [r["label"] for r in top_labels(arrows, width).collect()]
    cells = {(r["ref"], r["hyp"]): r["count"] for r in confusion(arrows, width).collect()}
    rows = [[""] + axis] + [[a] + [str(cells.get((a, b), 0)) for b in axis] for a in axis]
    return "\n".join(" ".join(f"{c:<4}" for c in row).rstrip() for row in rows)


def _document(rows: Iterator[tuple[str, ...]]) -> str:
    head = [r"\documentclass{article}", r"\usepackage{fontspec,xcolor,booktabs,longtable}", r"\newcommand{\hl}[1]{\textcolor{red}{#1}}", r"\begin{document}", r"\begin{longtable}{ll}", r"\toprule"]
    body = [line for row in rows for line in (*row, r"\midrule")]
    return "\n".join([*head, *body, r"\end{longtable}", r"\end{document}"]) + "\n"


def highlighted(pairs: DataFrame) -> DataFrame:
    """``pairs`` with ``ref_tex`` and ``hyp_tex``: aligned labels, mismatches wrapped for highlighting."""
    mark = lambda side: F.array_join(F.transform("__a", lambda p: F.when(p["ref"] == p["hyp"], p[side]).otherwise(F.concat(F.lit("\\hl{"), p[side], F.lit("}")))), "")
    return pairs.withColumn("__a", alignment("ref", "hyp")).withColumn("ref_tex", mark("ref")).withColumn("hyp_tex", mark("hyp")).drop("__a")


def latex_alignments(pairs: DataFrame, order: str = "line_no") -> str:
    """References over hypotheses of a test set, errors highlighted."""
    rows = highlighted(pairs).orderBy(order).select(latex_escape(F.trim("prefix")).alias("prefix"), "ref_tex", "hyp_tex").toLocalIterator()
    return _document((rf"Utterance ID: & {r['prefix']} \\", rf"Ref: & {r['ref_tex']} \\", rf"Hyp: & {r['hyp_tex']} \\") for r in rows)


def untranscribed_order(hyps: DataFrame) -> DataFrame:
    """Hypotheses ordered by recording and piece number: the first two fields of the prefix."""
    return hyps.orderBy(F.substring_index("prefix", ".", 1), F.expr("try_cast(split(prefix, '[.]')[1] AS int)"))


def latex_untranscribed(hyps: DataFrame) -> str:
    rows = untranscribed_order(hyps).select(latex_escape(F.trim("prefix")).alias("prefix"), "hyp").toLocalIterator()
    return _document((rf"Utterance ID: & {r['prefix']} \\", rf"Hypothesis: & {r['hyp']} \\") for r in rows)
