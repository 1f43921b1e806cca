"""Scalar text functions, all plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 characters that count as white space when a text is stripped.
WHITESPACE = (
    "\u0009\u000a\u000b\u000c\u000d\u001c\u001d\u001e\u001f\u0020\u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Bucket edges, preview length, prefix read by language identification.
SIMPLE_MAX, MEDIUM_MAX = 100, 500
PREVIEW_CHARS = 300
DETECTION_CHARS = 1000
COMPLEXITIES = ["simple", "medium", "complex"]

# Phrases that mark a follow-up.
FOLLOW_UP_PHRASES = ["follow up", "followup", "additional"]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Trim Unicode white space at both ends (plain ``trim`` takes blanks only)."""
    return F.btrim(_col(c), F.lit(WHITESPACE))


def is_blank(c: Column | str) -> Column:
    return strip(c) == ""


def fold(c: Column | str) -> Column:
    """Lower-case text in which long s and dotless i equal s and i.

    ``translate`` rebuilds the whole string, so it only runs where one of the
    two characters occurs.
    """
    low = F.lower(_col(c))
    rare = F.contains(low, F.lit("ſ")) | F.contains(low, F.lit("ı"))
    return F.when(rare, F.translate(low, "ſı", "si")).otherwise(low)


def fold_original(c: Column | str) -> Column:
    """``fold`` for patterns that see the text before lower-casing.

    There a dotted capital I is one letter and equals i; lower-casing first
    would split it into i and a combining dot.
    """
    c = _col(c)
    dotted = F.contains(c, F.lit("İ"))
    return fold(F.when(dotted, F.translate(c, "İ", "i")).otherwise(c))


def text_hash(c: Column | str) -> Column:
    """First 16 hex digits of the MD5 of the UTF-8 text."""
    return F.substring(F.md5(_col(c)), 1, 16)


def detection_prefix(c: Column | str) -> Column:
    """The part of a text that language identification is defined on."""
    return F.substring(_col(c), 1, DETECTION_CHARS)


def char_length(c: Column | str) -> Column:
    """Length in code points."""
    return F.char_length(_col(c)).cast("bigint")


def complexity_cli(length: Column | str) -> Column:
    """Length bucket of the batch job; length 0 has no bucket."""
    n = _col(length)
    return (
        F.when(n <= 0, F.lit(None).cast("string"))
        .when(n <= SIMPLE_MAX, "simple")
        .when(n <= MEDIUM_MAX, "medium")
        .when(n > MEDIUM_MAX, "complex")
    )


def complexity_upload(length: Column | str) -> Column:
    """Length bucket of the upload analysis; length 0 is simple."""
    n = _col(length)
    return (
        F.when(n <= SIMPLE_MAX, "simple").when(n <= MEDIUM_MAX, "medium").otherwise("complex")
    )


def complexity_rank(c: Column | str) -> Column:
    """Sort position of a complexity label."""
    return F.array_position(F.array(*[F.lit(x) for x in COMPLEXITIES]), _col(c))


def preview(c: Column | str) -> Column:
    c = _col(c)
    cut = F.concat(F.substring(c, 1, PREVIEW_CHARS), F.lit("…"))
    return F.when(F.char_length(c) > PREVIEW_CHARS, cut).otherwise(c)


def _occurrences(c: Column, phrase: str) -> Column:
    """How often an ASCII phrase occurs: the bytes lost when it is taken out."""
    without = F.replace(c, F.lit(phrase), F.lit(""))
    return F.floor((F.octet_length(c) - F.octet_length(without)) / F.lit(len(phrase)))


def question_marks(c: Column | str) -> Column:
    return _occurrences(_col(c), "?").cast("bigint")


def follow_ups(c: Column | str) -> Column:
    """Occurrences of the follow-up phrases, in any case and inside words too.

    No phrase can overlap another, so they are counted one by one.
    """
    folded = fold_original(c)
    counts = [_occurrences(folded, p) for p in FOLLOW_UP_PHRASES]
    return sum(counts[1:], counts[0]).cast("bigint")
