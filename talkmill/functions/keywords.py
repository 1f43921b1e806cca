"""Keyword counting as regular expressions over a reduced text.

A group's score is the number of non-overlapping, leftmost-first matches of its
keywords as whole words.  With dozens of groups, running every group's pattern
over every text is what costs.  So each text is first reduced, in one scan, to
its *runs*: stretches of taxonomy words joined by the separators that occur
inside keywords (a blank, a hyphen).  Runs are kept one per line.

The reduction does not change any count.  A keyword match is a sequence of
taxonomy words joined by such separators, so it lies inside one run; and the
characters around a run are not word characters, as a line break is not one
either.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from talkmill.functions.once import sql_text
from talkmill.functions.text import fold_original

# Java's \b treats numerals and combining marks in its own way, so the word
# boundary is spelled out: letters, numerals and the underscore are word characters.
WORD_CHARS = r"\p{L}\p{N}_"
NOT_AFTER_WORD = f"(?<![{WORD_CHARS}])"
NOT_BEFORE_WORD = f"(?![{WORD_CHARS}])"

TURN_START, TURN_END = "\u0002", "\u0003"

_META = re.compile(r"([\\^$.|?*+()\[\]{}&~#-])")
_WORDS = re.compile(r"\w+")


def _quote(s: str) -> str:
    return _META.sub(r"\\\1", s)


def group_pattern(keywords: Iterable[str]) -> str:
    """Pattern of one keyword group for folded text, keeping the list order."""
    alternatives = "|".join(_quote(k.lower()) for k in keywords)
    return f"{NOT_AFTER_WORD}(?:{alternatives}){NOT_BEFORE_WORD}"


def prefix_pattern(endings: dict[str, str]) -> str:
    """One pattern for many words, sharing prefixes; each word carries its own ending.

    A flat alternation would try every word at every word start.
    """
    by_first: dict[str, dict[str, str]] = {}
    for word, ending in endings.items():
        by_first.setdefault(word[:1], {})[word[1:]] = ending
    here = by_first.pop("", {}).get("")
    parts = [_quote(ch) + prefix_pattern(rest) for ch, rest in sorted(by_first.items())]
    if here is not None:
        parts.append(here)
    return parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"


def _split(keyword: str) -> tuple[list[str], list[str]]:
    """Words of a keyword and the separators between them."""
    return _WORDS.findall(keyword), [s for s in re.split(r"\w+", keyword) if s]


def _separators(keywords: list[str]) -> str:
    seps = sorted({s for k in keywords for s in _split(k)[1]}) or [" "]
    return f"(?:{'|'.join(_quote(s) for s in seps)})"


def run_pattern(keywords: Iterable[str], *, at_edges: bool = False) -> str:
    """Pattern of a run: keyword words joined by separators found inside keywords.

    A word that is no keyword by itself and only opens some longer one starts a
    run only when a separator and an inner word follow.  With ``at_edges`` any
    keyword word may start a run, because the text that will stand next to this
    one may complete the keyword.
    """
    keywords = [k.lower() for k in keywords]
    split = [_split(k)[0] for k in keywords]
    starts = {ws[0]: NOT_BEFORE_WORD for ws in split}
    inner = {w: NOT_BEFORE_WORD for ws in split for w in ws[1:]}
    if not inner:
        return f"{NOT_AFTER_WORD}{prefix_pattern(starts)}"
    if at_edges:
        starts = inner = starts | inner
    goes_on = f"{_separators(keywords)}{prefix_pattern(inner)}"
    start = prefix_pattern(starts)
    if not at_edges:
        alone = {ws[0]: NOT_BEFORE_WORD for ws in split if len(ws) == 1}
        opening = {w: "" for w in starts if w not in alone}
        choices = [prefix_pattern(alone)] if alone else []
        if opening:
            choices.append(f"{prefix_pattern(opening)}(?={goes_on})")
        start = f"(?:{'|'.join(choices)})"
    return f"{NOT_AFTER_WORD}{start}(?:{goes_on})*+"


def reduce_text(folded: Column, keywords: Iterable[str]) -> Column:
    """Folded text reduced to its runs, one per line; empty without any."""
    runs = F.regexp_extract_all(folded, F.lit(run_pattern(keywords)), F.lit(0))
    return F.array_join(runs, "\n")


def turn_runs(folded: Column, keywords: Iterable[str]) -> Column:
    """Runs of one piece of a longer text, one per line.

    A run that touches the start or the end of the piece carries a mark there.
    """
    run = run_pattern(keywords, at_edges=True)
    marked = F.concat(F.lit(TURN_START), folded, F.lit(TURN_END))
    pattern = rf"(?:^{TURN_START})?+{run}(?:{TURN_END}\z)?+"
    return F.array_join(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), "\n")


def joinable(runs: Column) -> Column:
    """Turn the result of ``turn_runs`` into a piece that can be joined by a blank.

    A line break at an end says that no run touches that end, so nothing can
    connect across it.  ``"\\n"`` alone is a piece without any run.  ``runs``
    should be a column of its own, as it is used several times.
    """
    left = F.when(F.startswith(runs, F.lit(TURN_START)), "").otherwise("\n")
    right = F.when(F.endswith(runs, F.lit(TURN_END)), "").otherwise("\n")
    inner = F.translate(runs, TURN_START + TURN_END, "")
    return F.when(runs == "", "\n").otherwise(F.concat(left, inner, right))


def group_counts(reduced: str, groups: list[Iterable[str]]) -> Column:
    """Matches of every group in a column of reduced texts, as ``array<int>``.

    Most texts have no run at all and stop early.
    """
    none = ", ".join("0" for _ in groups)
    counts = ", ".join(
        f"regexp_count(`{reduced}`, {sql_text(group_pattern(g))})" for g in groups
    )
    return F.expr(f"CASE WHEN `{reduced}` = '' THEN array({none}) ELSE array({counts}) END")


def has_keyword(text: Column | str, keywords: Iterable[str]) -> Column:
    """True where a keyword occurs as a whole word, in any case."""
    return F.rlike(fold_original(text), F.lit(group_pattern(keywords)))


def count_keywords(text: Column | str, keywords: Iterable[str]) -> Column:
    """Number of keyword matches in a text, in any case."""
    return F.regexp_count(fold_original(text), F.lit(group_pattern(keywords))).cast("bigint")
