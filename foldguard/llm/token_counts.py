"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For each prefix of a word the last token of its encoding and the number of its tokens are stored. A token may end
a prefix when it goes on from the encoding of what stands before it, that is when the tokenizer would leave the two
neighbours as they are; exactly one token does. So the counts of all prefixes follow from those of shorter ones, and
questions like "how many tokens has this prefix" or "how much of the text fits the budget" need no second encoding.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .base import id_and_text, runs
from .tokens import LONGEST_REMEMBERED, REMEMBERED, Remembered, pieces, vocabulary_path

# The pattern that the tokenizer cuts words by.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: itself if printable, else one from 256 on."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(others)}


class PrefixCounter:
    """Token counts of all prefixes of a text, for one vocabulary file of a byte-level BPE."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            content = json.load(f)
        byte = _printable_bytes()
        raw = {token: bytes(byte[c] for c in token) for token in content["model"]["vocab"]}
        self.tokens = set(raw.values())
        self.longest = max(map(len, self.tokens))
        merges = [m.split(" ") if isinstance(m, str) else m for m in content["model"]["merges"]]
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(merges)}
        self.special = [t["content"] for t in content["added_tokens"]]
        self.cut_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words, self.plain_word = regex.compile(WORDS), regex.compile(r" ?\p{L}+")
        self.known_words: dict[bytes, list[int]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}

    def _merged(self, parts: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of ``parts``, by merging the pair of lowest rank until none is left."""
        rank = self.rank
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: rank.get((parts[i], parts[i + 1]), 1 << 30))
            pair = (parts[best], parts[best + 1])
            if pair not in rank:
                break
            out, i = [], 0
            while i < len(parts):
                if i + 1 < len(parts) and (parts[i], parts[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _goes_on(self, before: bytes, token: bytes) -> bool:
        """Whether the tokenizer keeps ``token`` apart from the token before it; without one, whether it is one token."""
        known = self.fits.get((before, token))
        if known is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            whole = before + token
            known = self._merged([whole[i : i + 1] for i in range(len(whole))]) == ([before, token] if before else [token])
            self.fits[before, token] = known
        return known

    def of_word(self, word: bytes) -> list[int]:
        """Tokens of ``word[:j]`` for j = 0 … len(word)."""
        known = self.known_words.get(word)
        if known is not None:
            return known
        n, tokens, longest, fits = len(word), self.tokens, self.longest, self.fits
        counts, last = [0] * (n + 1), [b""] * (n + 1)
        for j in range(1, n + 1):
            for i in range(j - 1, j - longest - 1 if j > longest else -1, -1):
                token = word[i:j]
                if token in tokens:
                    before = last[i]
                    good = fits.get((before, token))
                    if good is None:
                        good = self._goes_on(before, token)
                    if good:
                        counts[j], last[j] = counts[i] + 1, token
                        break
        if n <= LONGEST_REMEMBERED:
            if len(self.known_words) > REMEMBERED:
                self.known_words.clear()
            self.known_words[word] = counts
        return counts

    def _counts_of_characters(self, word: str) -> list[int]:
        """Tokens of ``word[:i]`` for i = 1 … len(word), where a prefix of ``word`` is one word as well."""
        by_byte = self.of_word(word.encode("utf-8", "surrogatepass"))
        if len(by_byte) == len(word) + 1:
            return by_byte[1:]
        out, end = [], 0
        for c in word:
            end += len(c.encode("utf-8", "surrogatepass"))
            out.append(by_byte[end])
        return out

    def _of_segment(self, text: str) -> list[int]:
        """Tokens of ``text[:i]`` for i = 0 … len(text), without special strings."""
        out, base, done = [0], 0, ""
        for match in self.words.finditer(text):
            word = match.group()
            counts = [base + c for c in self._counts_of_characters(word)]
            whole_word = counts[-1]
            if word[0] == "'" and len(word) > 1 and word[1].isalpha():
                for i in range(1, len(word)):  # the beginning of a contraction is cut into words otherwise
                    counts[i - 1] = base + sum(self.of_word(c.encode("utf-8", "surrogatepass"))[-1] for c in self.words.findall(word[:i]))
            if done[-1:].isspace() and word[0].isspace():
                # The blanks before this word and its own first one are one word of the prefix that ends here.
                blanks = len(done) - len(done.rstrip())
                whole = done[len(done) - blanks :] + word[0]
                counts[0] = out[len(done) - blanks] + sum(self.of_word(c.encode())[-1] for c in self.words.findall(whole))
            out += counts
            base = whole_word if len(word) > 1 else base + self.of_word(word.encode("utf-8", "surrogatepass"))[-1]
            done = text[: match.end()]
        return out

    def of_piece(self, text: str) -> bytes | np.ndarray:
        """Tokens of ``text[:i]`` for i = 0 … len(text); a special string is one token once it is complete.

        Counts below 256 come as bytes, which take little room and index to numbers.
        """
        counts = self._of_piece(text)
        return bytes(counts) if max(counts) < 256 else np.array(counts, np.int32)

    def _of_piece(self, text: str) -> list[int]:
        if self.plain_word.fullmatch(text):
            return [0, *self._counts_of_characters(text)]
        if not self.cut_special or not self.cut_special.search(text):
            return self._of_segment(text)
        out, base = [0], 0
        for k, part in enumerate(self.cut_special.split(text)):
            if not part:
                continue
            counts = self._of_segment(part)
            if k % 2:
                before = text[: len(out) - 1]
                counts = [base + c for c in counts]
                start = self._open_start(before)
                for i in range(1, len(part)):  # not complete yet: ordinary text that may go on with what stands before it
                    counts[i] = self._of_piece(before[:start])[-1] + self._of_segment(before[start:] + part[:i])[-1]
                counts[-1] = base + 1
                out += counts[1:]
                base += 1
            else:
                out += [base + c for c in counts[1:]]
                base += counts[-1]
        return out

    def _open_start(self, before: str) -> int:
        """Where the text after the last special string begins."""
        last = 0
        for match in self.cut_special.finditer(before):
            last = match.end()
        return last

    def of_text(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i, 0 and the whole included."""
        out, base = [np.zeros(1, np.int64)], 0
        for piece in pieces(text):
            counts = self._of_piece(piece)
            out.append(base + np.array(counts[1:], np.int64))
            base += counts[-1]
        return np.concatenate(out)


class _Counts(Remembered):
    """Remembered counts, with the total of each piece at hand."""

    def __init__(self, counter: PrefixCounter):
        super().__init__(lambda new: [counter.of_piece(p) for p in new])
        self.totals: dict[str, int] = {}

    def update(self, items) -> None:
        items = list(items)
        super().update(items)
        self.totals.update((p, int(c[-1])) for p, c in items)

    def clear(self) -> None:
        super().clear()
        self.totals.clear()

    def __delitem__(self, piece: str) -> None:
        super().__delitem__(piece)
        del self.totals[piece]


_COUNTERS: dict[str, _Counts] = {}


def _counter(path: str) -> _Counts:
    if path not in _COUNTERS:
        _COUNTERS[path] = _Counts(PrefixCounter(path))
    return _COUNTERS[path]


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, prefixes: bool = False) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit, fit_chars`` and, on demand, ``prefix_tokens``.

    ``fit_chars`` is the length in code points of the longest prefix of at most ``limit`` tokens (the whole text if it
    fits); ``prefix_tokens`` holds the count of every prefix, the empty one first. Special strings in a text are single
    tokens, as the library's default has it. Null texts count as empty: 0 bytes, 0 tokens. Every row is counted by itself,
    repeated ones too; a NULL ``doc_id`` stays NULL; an empty table gives no rows; other columns are not read.
    """
    path = path or vocabulary_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _counter(path)
        for batch in runs(batches):
            texts = batch.column("text").to_pylist()
            cut = [pieces(t) for t in texts]
            known.learn(cut)
            total = known.totals
            n_tokens, fits, tables = [], [], []
            for text, parts in zip(texts, cut, strict=True):
                n = sum(map(total.__getitem__, parts))
                n_tokens.append(n)
                fit = len(text)
                if n > limit:
                    # Counts at the ends of pieces only grow: the answer lies in the piece that crosses the limit.
                    before = fit = 0
                    for part in parts:
                        if before + total[part] > limit:
                            fit += max(i for i, c in enumerate(known[part]) if before + c <= limit)
                            break
                        before, fit = before + total[part], fit + len(part)
                fits.append(fit)
                if prefixes:
                    table, base = [0], 0
                    for part in parts:
                        table += [base + int(c) for c in known[part][1:]]
                        base += total[part]
                    tables.append(table)
            known.forget_long()
            columns = [
                batch.column("doc_id"),
                pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()),
                pa.array(n_tokens, pa.int64()),
                pa.array([n > limit for n in n_tokens]),
                pa.array(fits, pa.int64()),
            ]
            names = ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"]
            if prefixes:
                columns.append(pa.array(tables, pa.list_(pa.int32())))
                names.append("prefix_tokens")
            yield pa.RecordBatch.from_arrays(columns, names)

    kinds = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return id_and_text(docs).mapInArrow(count, kinds + ", prefix_tokens array<int>" * prefixes)
