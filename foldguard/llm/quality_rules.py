"""Quality rules: how far a document's character classes and common words lie from those of known languages.

References are learned from the corpus itself: per value of ``lang`` the mean share of each character class over all
documents that pass the base rules, and the shares of the language's common short words, counted over all of them.
A document is compared with every reference by the Jensen-Shannon distance (base 2, 0 to 1); the nearest reference
counts, so a wrong or missing language label does no harm. Short documents say little about shares, so each test has a
minimum length below which it is not applied. Nor is a test applied where no reference can speak for the document: both need a
reference whose language is written in the document's script, the common-word test also one of the language that the document is
labelled with. An unlabelled document in a known script is taken for one of the known languages.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import BLANK_BYTES, SHORT_RUN_CHARS, lent, reachable, runs

#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
WINDOW = 8

CLASSES = ("lower", "upper", "other letter", "mark", "digit", "blank", "line break", "sentence", "symbol", "other")


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 20  # base: fewer words fail
    max_repeat_percent: int = 30  # base: a larger share of words in repeated windows fails
    short_min_words: int = 40  # below, the character test is not applied
    short_max_distance: float = 0.38  # character test up to class_min_words: few words scatter widely
    class_min_words: int = 100
    max_class_distance: float = 0.19  # character test from class_min_words on
    word_min_words: int = 100  # below, the common-word test is not applied
    max_word_distance: float = 0.6
    common_word_letters: int = 5  # common words are at most this long ...
    common_word_share: float = 0.002  # ... and at least this share of their language's words (so at most 1 / share each)
    reference_min_words: int = 50  # shorter documents are not learned from
    reference_max_symbols: float = 0.1  # nor those with more symbols per word
    reference_max_capitals: float = 0.3  # nor those with a larger share of capitals among their cased letters
    reference_min_documents: int = 20  # languages with fewer such documents have no reference; nothing rejects theirs for it
    script_share: float = 0.2  # scripts with at least this share of a language's letters are its own

    def base_failed(self, n_words: np.ndarray, n_repeat: np.ndarray) -> np.ndarray:
        return (n_words < self.min_words) | (100 * n_repeat > self.max_repeat_percent * n_words)


@functools.cache
def _class_table() -> np.ndarray:
    """The class of every code point, from its Unicode category."""
    by_category = {"Ll": 0, "Lu": 1, "Lt": 1, "Lo": 2, "Lm": 2, "Nd": 4, "Nl": 4, "No": 4, "Zs": 5, "Zl": 6, "Zp": 6}
    table = np.full(sys.maxunicode + 1, 9, np.uint8)
    for cp in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(cp))
        table[cp] = by_category.get(category, 3 if category[0] == "M" else 8 if category[0] in "SP" else 9)
    table[[ord(c) for c in ".,;:!?'\"()-¿¡«»’“”"]] = 7
    table[[9, 32]] = 5
    table[[10, 11, 12, 13]] = 6
    return table


@functools.cache
def _script_table() -> tuple[np.ndarray, list[str]]:
    """The script of every letter and mark by number, from the first word of its Unicode name, and the names; 0 is none."""
    no_script = ("COMBINING", "MODIFIER", "FEMININE", "MASCULINE", "VARIATION", "MATHEMATICAL", "FULLWIDTH", "HALFWIDTH", "SUPERSCRIPT", "SUBSCRIPT")
    names = {"": 0}
    table = np.zeros(sys.maxunicode + 1, np.uint8)
    for cp in np.flatnonzero(_class_table() <= 3):
        name = unicodedata.name(chr(cp), "").split(" ")[0].split("-")[0]
        if name not in no_script and (name in names or len(names) < 256):
            table[cp] = names.setdefault(name, len(names))
    table[[0xAA, 0xB5, 0xBA]] = 0
    return table, list(names)


class _Measured:
    """Counts of a run of texts; words are numbered within the run."""

    def __init__(self, texts: list[str | None]):
        n = len(texts)
        texts = [t or "" for t in texts]
        coded = [t.encode("utf-8", "surrogatepass") for t in texts]
        words = [b.split() for b in coded]
        self.n_words = np.array([len(w) for w in words], np.int64)
        self.doc = np.repeat(np.arange(n), self.n_words)
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        self.ids = np.fromiter((number.setdefault(w, len(number)) for ws in words for w in ws), np.int64, int(self.n_words.sum()))
        blanks = [len(b) - len(b.translate(None, BLANK_BYTES)) for b in coded]
        self.word_chars = np.array([len(t) - k for t, k in zip(texts, blanks, strict=True)], np.int64)
        symbols = SYMBOLS.encode()
        self.n_symbols = np.array([len(b) - len(b.translate(None, symbols)) for b in coded], np.int64)
        self.n_dup_lines = np.array([_repeated_lines(t) for t in coded], np.int64)
        self.n_repeat_words = self._in_repeated_windows(n)
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        where = np.repeat(np.arange(n), [len(t) for t in texts])
        k = len(CLASSES)
        self.classes = np.bincount(where * k + _class_table()[points], minlength=n * k).reshape(n, k).astype(float)
        # Scripts are looked up for all but ASCII letters, which are Latin.
        table, self.script_names = _script_table()
        k, latin = len(self.script_names), self.script_names.index("LATIN")
        far = points >= 128
        self.scripts = np.bincount(where[far] * k + table[points[far]], minlength=n * k).reshape(n, k)
        letters = ((points | 32) >= 97) & ((points | 32) <= 122)
        self.scripts[:, latin] += np.bincount(where[letters], minlength=n)
        self.scripts[:, 0] = 0

    def _in_repeated_windows(self, n: int) -> np.ndarray:
        """Words inside a window that occurs twice or more in their text; exact, by ranking windows of 2, 4, 8 words."""
        rank, size = self.ids, 1
        while size < WINDOW and len(rank) > size:
            pairs = rank[:-size] * (int(rank.max()) + 1) + rank[size:]
            rank = np.unique(pairs, return_inverse=True)[1]
            size *= 2
        total = len(self.ids)
        if size < WINDOW or len(rank) == 0:
            return np.zeros(n, np.int64)
        starts = np.flatnonzero(self.doc[: total - WINDOW + 1] == self.doc[WINDOW - 1 :])
        if len(starts) == 0:
            return np.zeros(n, np.int64)
        key = self.doc[starts] * (int(rank.max()) + 1) + rank[starts]
        _, back, count = np.unique(key, return_inverse=True, return_counts=True)
        again = starts[count[back] > 1]
        change = np.zeros(total + 1, np.int64)
        np.add.at(change, again, 1)
        np.add.at(change, again + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
        return np.bincount(self.doc[covered], minlength=n)

    def script(self) -> np.ndarray:
        """The script of most letters of each text; empty where fewer than half of its characters but blanks have a script."""
        names = np.array(self.script_names, dtype=object)[self.scripts.argmax(axis=1)] if len(self.scripts) else np.zeros(0, object)
        return np.where(2 * self.scripts.sum(axis=1) >= np.maximum(self.word_chars, 1), names, "")

    def common_forms(self, letters: int) -> list[str]:
        """For each word of the vocabulary its lower-case form if it is short and made of letters, else an empty text."""
        forms = []
        for w in self.vocabulary:
            form = ""
            if len(w) <= 4 * letters + 4:
                form = w.decode("utf-8", "replace").strip(".,;:!?'\"()").lower()
                form = form if len(form) <= letters and form.isalpha() else ""
            forms.append(form)
        return forms


def _repeated_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.strip(BLANK_BYTES)]
    return len(lines) - len(set(lines))


def _shares(counts: np.ndarray) -> np.ndarray:
    return counts / np.maximum(counts.sum(axis=-1, keepdims=True), 1e-300)


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``p`` to ``q``: the square root of the divergence in bits."""
    m = (p + q) / 2

    def divergence(a: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(axis=1)

    return np.sqrt(np.clip((divergence(p) + divergence(np.broadcast_to(q, p.shape))) / 2, 0, 1))


@dataclass(frozen=True)
class References:
    """By language: shares of character classes, shares of common words with the rest in the last place, and its scripts.

    A language speaks for the documents of each script that at least ``script_share`` of its letters belong to; one without
    scripts, for all.
    """

    classes: dict[str, np.ndarray]
    words: dict[str, dict[str, float]]
    scripts: dict[str, set[str]] = field(default_factory=dict)

    def speaks_for(self, scripts: np.ndarray) -> np.ndarray:
        """Whether a reference is written in each of these scripts; texts without a script are compared with all."""
        if any(not self.scripts.get(lang) for lang in self.classes):
            return np.ones(len(scripts), bool)
        known = ["", *set().union(*self.scripts.values())]
        return np.isin(scripts.astype(str), known)


def learn_references(docs: DataFrame, rules: QualityRules = QualityRules()) -> References:
    """References of all languages, from every document that passes the base rules.

    What reaches the driver is bounded: one row of class shares and of scripts per language, and at most
    ``1 / common_word_share`` words per language. Documents without a language or text teach nothing.
    """

    @lent
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, chars=SHORT_RUN_CHARS):
            langs = np.array(batch.column("lang").to_pylist(), dtype=object)
            m = _Measured(batch.column("text").to_pylist())
            good = ~rules.base_failed(m.n_words, m.n_repeat_words) & (m.n_words >= rules.reference_min_words)
            good &= m.n_symbols <= rules.reference_max_symbols * m.n_words
            good &= m.classes[:, 1] <= rules.reference_max_capitals * m.classes[:, :2].sum(axis=1)
            forms = np.array(m.common_forms(rules.common_word_letters), dtype=object)
            for lang in set(langs[good]):
                mine = good & (langs == lang)
                share = _shares(m.classes[mine]).sum(axis=0)
                counts = np.bincount(m.ids[mine[m.doc]], minlength=len(forms))
                used = np.flatnonzero((counts > 0) & (forms != ""))
                letters = m.scripts[mine].sum(axis=0)
                seen = np.flatnonzero(letters)
                names = [f"class {i}" for i in range(len(share))] + ["documents", "words"] + [f"script {m.script_names[i]}" for i in seen] + [f"word {w}" for w in forms[used]]
                values = [*share, float(mine.sum()), float(m.n_words[mine].sum()), *letters[seen].astype(float), *counts[used].astype(float)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(names)), pa.array(names), pa.array(values, pa.float64())], ["lang", "what", "value"]
                )

    labelled = reachable(docs).filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    sums = labelled.mapInArrow(partial, "lang string, what string, value double").groupBy("lang", "what").agg(F.sum("value").alias("value"))
    sums = stage(sums, "quality-sums")
    # Languages with too few documents are left out before anything comes to the driver.
    enough = sums.filter((F.col("what") == "documents") & (F.col("value") >= rules.reference_min_documents)).select("lang")
    totals = sums.filter("NOT what LIKE 'word %'").join(enough, "lang", "left_semi").collect()
    total: dict[str, dict[str, float]] = {}
    for r in totals:
        total.setdefault(r.lang, {})[r.what] = r.value
    total = {k: v for k, v in total.items() if v["documents"] >= rules.reference_min_documents}
    classes = {k: _shares(np.array([v[f"class {i}"] for i in range(len(CLASSES))])) for k, v in total.items()}
    scripts = {}
    for lang, v in total.items():
        letters = {what[7:]: n for what, n in v.items() if what.startswith("script ")}
        scripts[lang] = {name for name, n in letters.items() if n >= rules.script_share * sum(letters.values())}
    words = sums.filter("what LIKE 'word %'").join(
        sums.filter("what = 'words'").select("lang", F.col("value").alias("all_words")), "lang"
    ).filter(F.col("value") >= rules.common_word_share * F.col("all_words"))
    common: dict[str, dict[str, float]] = {k: {} for k in classes}
    for r in words.collect():
        if r.lang in common:
            common[r.lang][r.what[5:]] = r.value / r.all_words
    return References(classes, common, scripts)


_VERDICT = (
    "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
    "class_distance double, word_distance double, base_failed boolean, kept boolean"
)


def quality_rules(docs: DataFrame, references: References, rules: QualityRules = QualityRules(), with_input: bool = False) -> DataFrame:
    """One row per document with its counts, distances and verdict; ``with_input`` puts a struct of all input columns first.

    Null and empty texts have no words and fail the base rules. A distance is NULL where the text is too short for it or
    no reference can speak for it; a NULL distance rejects nothing. Rows that repeat are judged one by one; an empty table gives
    no rows. Without ``with_input`` no column but ``doc_id``, ``text`` and, if there is one, ``lang`` is read.
    """
    langs, labelled = sorted(references.classes), "lang" in docs.columns
    forms = sorted({w for lang in langs for w in references.words[lang]})
    place = {w: i for i, w in enumerate(forms)}
    word_reference = {}
    for lang in langs:
        q = np.zeros(len(forms) + 1)
        for w, share in references.words[lang].items():
            q[place[w]] = share
        q[-1] = max(0.0, 1 - q.sum())
        word_reference[lang] = q

    @lent
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches, chars=SHORT_RUN_CHARS):
            m = _Measured(batch.column("text").to_pylist())
            n, k = batch.num_rows, len(forms) + 1
            to = np.array([place.get(f, k - 1) for f in m.common_forms(rules.common_word_letters)] or [k - 1], np.int64)
            base = rules.base_failed(m.n_words, m.n_repeat_words)
            by_class, by_word = np.full(n, np.nan), np.full(n, np.nan)
            if langs:
                spoken = references.speaks_for(m.script())
                labels = batch.column("lang").to_pylist() if labelled else [None] * n
                named = spoken & np.array([x is None or x in references.classes for x in labels], bool)
                rows = np.flatnonzero((m.n_words >= rules.short_min_words) & spoken)
                p = _shares(m.classes[rows])
                by_class[rows] = np.min([distance(p, references.classes[x]) for x in langs], axis=0) if len(rows) else []
                rows = np.flatnonzero((m.n_words >= rules.word_min_words) & named)
                for part in np.array_split(rows, max(1, len(rows) * k // 2_000_000)):
                    inside = np.isin(m.doc, part)
                    at = np.searchsorted(part, m.doc[inside])
                    p = _shares(np.bincount(at * k + to[m.ids[inside]], minlength=len(part) * k).reshape(len(part), k).astype(float))
                    by_word[part] = np.min([distance(p, word_reference[x]) for x in langs], axis=0) if len(part) else []
            most = np.where(m.n_words >= rules.class_min_words, rules.max_class_distance, rules.short_max_distance)
            kept = ~base & ~(by_class > most) & ~(by_word > rules.max_word_distance)
            head = [batch.column("row")] if with_input else [batch.column("doc_id")]
            names = ["row"] if with_input else ["doc_id"]
            yield pa.RecordBatch.from_arrays(
                head
                + [pa.array(x, pa.int64()) for x in (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words)]
                + [pa.array(x, pa.float64(), mask=np.isnan(x)) for x in (by_class, by_word)]
                + [pa.array(base), pa.array(kept)],
                names + [x.split()[0] for x in _VERDICT.split(", ")],
            )

    def judge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Texts are read inside the rows, so that they are not sent twice.
        return judge(batch.append_column("text", batch.column("row").field(place_of_text)) for batch in batches)

    lang = [F.col("lang").cast("string").alias("lang")] if labelled else []
    if with_input:
        place_of_text = [c.lower() for c in docs.columns].index("text")
        one = reachable(docs).select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), *lang)
        return one.mapInArrow(judge_rows, f"row {one.schema['row'].dataType.simpleString()}, {_VERDICT}")
    both = reachable(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), *lang)
    return both.mapInArrow(judge, f"doc_id bigint, {_VERDICT}")
