"""Texts cut at blanks where neither of two kinds of tokenizer can join both sides.

A border is a blank (U+0020) before a character that is not white space and after one that is neither a blank
nor U+2581. Byte-level BPE splits its words there, as a blank before a non-space opens a word of the
pattern. A sentencepiece model writes the blank as U+2581 and merges over the border only into an entry with U+2581 behind
another character; ``safe_for`` looks for such entries. Between two borders, tokens do not depend on
what stands beyond them, so each distinct piece is encoded once.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np

#: Texts longer than this are handled in parts that end at a border.
PART = 2_000_000
#: Pieces to encode are joined to strings of about so many characters.
JOINED = 20_000

_BORDER = re.compile("(?<![ ▁])(?= \\S)")
#: Without any of these, every blank is a border.
_UNEVEN = re.compile(" \\s| \\Z|\\A |▁")
_INNER = re.compile("[^▁]▁")
#: Inside a word: after a Latin letter before punctuation, and before a line end.
_FINE = re.compile("(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[.,;:!?])|(?<=\\S)(?=\n)")


def safe_for(entries: Iterable[str]) -> bool:
    """No entry of the vocabulary reaches over a border."""
    return not any(_INNER.search(entry) for entry in entries)


def fine_for(entries: Iterable[str]) -> bool:
    """No entry of the vocabulary reaches over a border within words."""
    return not any(_FINE.search(entry) or "\n" in entry for entry in entries)


def cut_word(word: str) -> list[str]:
    """The pieces of a word at such borders, where neither kind of tokenizer joins both sides either: byte-level BPE never puts
    letters and punctuation, or anything and white space behind it, into one word of its pattern."""
    return _FINE.split(word)


def parts(text: str, most: int = PART) -> Iterator[str]:
    """The text in consecutive parts that end at borders, of about so many characters."""
    start = 0
    while len(text) - start > most:
        found = _BORDER.search(text, start + most)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:] if start else text


def cut(text: str) -> list[str]:
    """The pieces between borders; joined they are the text. All but the first begin with a blank."""
    if _UNEVEN.search(text):
        return [piece for piece in _BORDER.split(text) if piece]
    first, *rest = text.split(" ")
    return ([first] if first else []) + [" " + piece for piece in rest]


def joinable(piece: str) -> bool:
    """Pieces of which this holds may follow each other in any order and keep their borders."""
    return bool(_BORDER.match(piece)) and piece[-1] not in " ▁"


def batched(pieces: list[str]) -> Iterator[list[str]]:
    """The pieces in lists whose members may be joined and encoded in one call; others are alone."""
    together, size = [], 0
    for piece in pieces:
        if not joinable(piece):
            yield [piece]
            continue
        together.append(piece)
        size += len(piece)
        if size > JOINED:
            yield together
            together, size = [], 0
    if together:
        yield together


def byte_letters() -> dict[str, int]:
    """The letter of byte-level vocabularies for every byte: its own if visible, else the next from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


def byte_entries(tokenizer) -> list[bytes]:
    """The bytes of every entry of a byte-level tokenizer, by id; those of an added one are its string's."""
    letters = byte_letters()
    added = {number: token.content for number, token in tokenizer.get_added_tokens_decoder().items()}
    entries = tokenizer.get_vocab(with_added_tokens=True)
    raw = [b""] * (max(entries.values()) + 1)
    for entry, number in entries.items():
        raw[number] = added[number].encode() if number in added else bytes(letters[c] for c in entry)
    return raw


def byte_widths(tokenizer) -> np.ndarray:
    return np.array([len(entry) for entry in byte_entries(tokenizer)], np.int64)
