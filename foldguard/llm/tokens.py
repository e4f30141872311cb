"""Pieces of text that a byte-level BPE encodes independently of each other.

The tokenizer first cuts a text into words by a pattern, then merges bytes inside each. A single space or line feed between
two characters that are no white space always starts a new word, so a text may be cut there and the pieces
encoded apart: their ids, put together, are those of the whole text. Words repeat, so each worker keeps the result of pieces
it has seen, in a table that is emptied when it is full.
"""

from __future__ import annotations

import re
from itertools import filterfalse, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_TWO_BLANKS = re.compile(r"\s\s")
_LINES = re.compile(r"(?<=\S)\n(?=\S)")
_SPACES = re.compile(r"(?<=\S) (?=\S)")
_ODD = r"\x00|[\s\x0b\x1c-\x1f\x{85}\p{Z}]{2}"  # what ``pieces`` looks for, in the words of Arrow's patterns

#: Pieces remembered by one worker.
REMEMBERED = 400_000
LONGEST_REMEMBERED = 64


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(text: str) -> list[str]:
    """``text`` cut at single spaces and line feeds; a space goes with what follows, a line feed stands alone."""
    if "\0" not in text and not _TWO_BLANKS.search(text):
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
    out: list[str] = []
    for i, line in enumerate(_LINES.split(text)):
        if i:
            out.append("\n")
        first, *rest = _SPACES.split(line)
        out.append(first)
        out.extend([" " + x for x in rest])
    return out


def distinct_pieces(texts: pa.Array) -> tuple[list[str], pa.Array, np.ndarray]:
    """The different ones of the ``pieces`` of all texts; for every piece, in order, its place among them; the pieces of each text."""
    texts = texts.cast(pa.large_string())
    odd = pc.match_substring_regex(texts, _ODD)
    plain = pc.if_else(odd, "", texts)
    cut = pc.split_pattern(pc.replace_substring(pc.replace_substring(plain, " ", "\0 "), "\n", "\0\n\0"), "\0")
    one_by_one = np.flatnonzero(odd.to_numpy(zero_copy_only=False))
    if len(one_by_one):
        own = pa.array([pieces(t) for t in texts.take(pa.array(one_by_one)).to_pylist()], cut.type)
        place = np.arange(len(texts))
        place[one_by_one] = len(texts) + np.arange(len(one_by_one))
        cut = pa.concat_arrays([cut, own]).take(pa.array(place))
    encoded = cut.flatten().dictionary_encode()
    return encoded.dictionary.to_numpy(zero_copy_only=False).tolist(), encoded.indices, np.asarray(pc.list_value_length(cut))


class Remembered(dict):
    """Results by piece; ``solve`` gives those of a list of new pieces. Long pieces are not remembered for long."""

    def __init__(self, solve, limit: int = REMEMBERED):
        self.solve, self.limit = solve, limit
        self.long: list[str] = []

    def results(self, words: list[str]) -> list:
        """Results of ``words``, which are all different; short new ones are remembered."""
        if len(self) > self.limit:
            self.clear()
        found = list(map(self.get, words))
        new = [p for p, r in zip(words, found, strict=True) if r is None]
        solved = self.solve(new)
        self.update((p, r) for p, r in zip(new, solved, strict=True) if len(p) <= LONGEST_REMEMBERED)
        rest = iter(solved)
        return [next(rest) if r is None else r for r in found]

    def keep_first(self, kept: int) -> None:
        """Only the ``kept`` pieces that were met first stay: frequent pieces are met early."""
        if len(self) > kept:
            first = dict(islice(self.items(), kept))
            self.clear()
            self.update(first)

    def learn(self, texts: list[list[str]]) -> None:
        """After this, every piece of ``texts`` has its result."""
        if len(self) > self.limit:
            self.clear()
            self.long.clear()
        new = list(set().union(*[filterfalse(self.__contains__, t) for t in texts]))
        self.update(zip(new, self.solve(new), strict=True))
        self.long += [p for p in new if len(p) > LONGEST_REMEMBERED]

    def forget_long(self) -> None:
        for p in self.long:
            del self[p]
        self.long.clear()
