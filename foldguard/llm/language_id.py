"""Language identification by a linear-chain conditional random field over words.

Every word of a line gets a label. Its score for a language is the sum of learned weights of its features: affixes, character
n-grams and, for frequent words, their frequency class in each language's lexicon; learned transitions tie neighbours, so a
word without marks of its own follows its context and a switch of language inside a line is possible. Forward-backward gives
every word's probabilities; a document gets the language with the largest mean over its words that have a letter.

* Lexicons are counted over all learning documents. A word that is frequent overall is frequent in some part, so one
  pass proposes words part by part and a second counts the proposed ones everywhere.
* Weights are fitted on a sample of at most ``documents_per_language`` documents of each language, of at most ``most_chars``
  characters each, the ones with the smallest hashes; this is the only bounded input.
* Prediction is one pass over all texts without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from .base import id_and_text, reachable, runs

BUCKETS = 1 << 16
#: Punctuation that is not part of a word.
STRIPPED = ".,;:!?'\"()[]{}<>|*#$%&«»¿¡-–—…“”’/\\"


@dataclass(frozen=True)
class CrfSettings:
    documents_per_language: int = 150
    most_chars: int = 6000  # longer documents are not learned from (the lexicons count them)
    lexicon_share: float = 0.0005  # lexicon words have at least this share of their language's words
    chain_words: int = 60
    epochs: int = 6
    rate: float = 0.3
    decay: float = 1e-6
    seed: int = 7


@dataclass
class Crf:
    languages: list[str]
    lexicon: dict[str, list[int]] = field(default_factory=dict)  # word -> feature numbers
    weights: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS, 0)))
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


def is_held_out(doc_id: Column | str) -> Column:
    """The documents that nothing is learned from: crc32 of the id as text, modulo 5, is 0."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def word_form(word: str) -> str:
    return word.strip(STRIPPED).lower()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(40)) % np.uint64(BUCKETS - 1) + np.uint64(1)


def features(forms: list[str], lexicon: dict[str, list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and the word that each belongs to.

    Character n-grams of 2 and 3 with the word's ends marked, prefixes of 3 and suffixes of 3 and 4 characters, the lexicon
    classes. Number 0 is left free.
    """
    sizes = np.array([len(w) + 2 for w in forms], np.int64)
    points = np.frombuffer("".join(f"\x02{w}\x03" for w in forms).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    word = np.repeat(np.arange(len(forms)), sizes)
    starts = np.cumsum(sizes) - sizes
    found, owner = [], []
    base, gram = np.uint64(0x100000001B3), points.copy()
    for order in range(2, 6):
        if len(points) < order:
            break
        gram = gram[:-1] * base + points[order - 1 :]
        same = word[: len(gram)] == word[order - 1 :]
        if order <= 3:
            at = np.flatnonzero(same)
        else:
            ends = starts + sizes - order  # suffixes of 3 and 4 characters and the end mark
            at = ends[(ends >= starts)]
            if order == 4:
                at = np.union1d(at, starts[sizes >= order])  # and prefixes of 3
        found.append(_mixed(gram[at] * base + np.uint64(order)))
        owner.append(word[at])
    listed = [(i, f) for i, w in enumerate(forms) if w in lexicon for f in lexicon[w]]
    if listed:
        owner.append(np.array([i for i, _ in listed], np.int64))
        found.append(np.array([f for _, f in listed], np.uint64))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


def emissions(forms: list[str], crf: Crf) -> np.ndarray:
    """Score of each word for each language."""
    numbers, word = features(forms, crf.lexicon)
    out = np.zeros((len(forms), len(crf.languages)))
    for i in range(len(crf.languages)):
        out[:, i] = np.bincount(word, crf.weights[numbers, i], minlength=len(forms))
    return out


def forward_backward(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, transitions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of every word's labels, and expected counts of transitions over all chains.

    ``scores`` holds the words of all chains one after another; all chains go one step at a time, the longest first.
    """
    k = scores.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[order], lengths[order]
    move = np.exp(transitions - transitions.max(initial=0.0))
    potential = np.exp(scores - scores.max(axis=1, keepdims=True))
    ahead = np.empty_like(scores)
    steps = int(lengths[0]) if len(lengths) else 0
    live = len(lengths) - np.searchsorted(lengths[::-1], np.arange(1, steps + 1))  # chains with a word at each step
    state = None
    for t in range(steps):
        at = starts[: live[t]] + t
        state = potential[at] if t == 0 else (state[: live[t]] @ move) * potential[at]
        state = state / state.sum(axis=1, keepdims=True)
        ahead[at] = state
    both, expected = np.empty_like(scores), np.zeros((k, k))
    back = np.zeros((0, k))
    for t in range(steps - 1, -1, -1):
        at = starts[: live[t]] + t
        grown = np.full((live[t], k), 1.0)
        if len(back):
            message = back * potential[at[: len(back)] + 1]
            pair = ahead[at[: len(back)]][:, :, None] * move[None] * message[:, None, :]
            expected += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            grown[: len(back)] = message @ move.T
            grown[: len(back)] /= grown[: len(back)].sum(axis=1, keepdims=True)
        back = grown
        p = ahead[at] * back
        both[at] = p / p.sum(axis=1, keepdims=True)
    return both, expected


def count_lexicons(labelled: DataFrame, share: float) -> dict[str, dict[str, float]]:
    """By language the words of at least ``share`` of its words, with their shares; at most ``1 / share`` words each.

    Words are counted exactly, per run of texts first, then per task, then over all; only frequent ones reach the driver.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in runs(batches):
            raw: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                raw.setdefault(lang, Counter()).update(text.split())
            for lang, counts in raw.items():
                forms: Counter = Counter()
                for w, n in counts.items():
                    forms[word_form(w)] += n
                words, numbers = ["", *forms], [counts.total(), *forms.values()]
                if "" in forms:  # words of punctuation alone count in the total only
                    i = words.index("", 1)
                    del words[i], numbers[i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(words)), pa.array(words), pa.array(numbers, pa.int64())], ["lang", "word", "n"]
                )

    sums = stage(labelled.mapInArrow(counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "lexicon")
    total = sums.filter("word = ''").select("lang", F.col("n").alias("all_n"))
    frequent = sums.filter("word != ''").join(total, "lang").filter(F.col("n") >= share * F.col("all_n"))
    out: dict[str, dict[str, float]] = {}
    for r in frequent.select("lang", "word", (F.col("n") / F.col("all_n")).alias("share")).collect():
        out.setdefault(r.lang, {})[r.word] = r.share
    return out


def lexicon_features(lexicons: dict[str, dict[str, float]], languages: list[str]) -> dict[str, list[int]]:
    """For each lexicon word one feature per language that has it: the language and how frequent it is there, in powers of 4."""
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        for w, share in lexicons.get(lang, {}).items():
            level = int(np.clip(-np.log(share) / np.log(4), 0, 7))
            out.setdefault(w, []).append(int(_mixed(np.array([(i + 1) * 1009 + level], np.uint64) * np.uint64(0x100000001B3))[0]))
    return out


def _chains(texts: list[str], labels: list[int], words: int, rng: np.random.Generator) -> list[tuple[list[str], list[int]]]:
    """Lines of the sample as chains; every second one goes on with a line of another document, as code-switched text does."""
    lines = []
    for text, label in zip(texts, labels, strict=True):
        for line in text.split("\n"):
            parts = line.split()
            for i in range(0, len(parts), words):
                lines.append((parts[i : i + words], [label] * len(parts[i : i + words])))
    out = []
    for i, (parts, marks) in enumerate(lines):
        if i % 2 and lines:
            other, other_marks = lines[int(rng.integers(len(lines)))]
            cut, other_cut = int(rng.integers(1, len(parts) + 1)), int(rng.integers(1, len(other) + 1))
            parts, marks = parts[:cut] + other[:other_cut], marks[:cut] + other_marks[:other_cut]
        out.append((parts, marks))
    return out


def fit(texts: list[str], langs: list[str], lexicons: dict[str, dict[str, float]], settings: CrfSettings = CrfSettings()) -> Crf:
    """Weights by stochastic gradient ascent (AdaGrad) of the chains' log-likelihood; the same input gives the same weights."""
    languages = sorted(set(langs))
    k, rng = len(languages), np.random.default_rng(settings.seed)
    crf = Crf(languages, lexicon_features(lexicons, languages), np.zeros((BUCKETS, k)), np.zeros((k, k)))
    chains = [c for c in _chains(texts, [languages.index(x) for x in langs], settings.chain_words, rng) if c[0]]
    forms: dict[str, int] = {}
    coded = [(np.array([forms.setdefault(word_form(w), len(forms)) for w in ws]), np.array(marks)) for ws, marks in chains]
    numbers, word = features(list(forms), crf.lexicon)
    by_word = np.argsort(word, kind="stable")
    numbers, first = numbers[by_word], np.searchsorted(word[by_word], np.arange(len(forms) + 1))
    seen_w, seen_t = np.full((BUCKETS, k), 1e-3), np.full((k, k), 1e-3)
    for _ in range(settings.epochs):
        turn = rng.permutation(len(coded))
        for at in range(0, len(turn), 128):
            group = [coded[i] for i in turn[at : at + 128]]
            ids, marks = np.concatenate([g[0] for g in group]), np.concatenate([g[1] for g in group])
            lengths = np.array([len(g[0]) for g in group])
            starts = np.cumsum(lengths) - lengths
            used, back = np.unique(ids, return_inverse=True)
            size = first[used + 1] - first[used]
            places = np.repeat(first[used] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            own, owner = numbers[places], np.repeat(np.arange(len(used)), size)
            scores = np.stack([np.bincount(owner, crf.weights[own, i], minlength=len(used)) for i in range(k)], axis=1)
            p, expected = forward_backward(scores[back], starts, lengths, crf.transitions)
            miss = -p
            miss[np.arange(len(marks)), marks] += 1
            by_used = np.stack([np.bincount(back, miss[:, i], minlength=len(used)) for i in range(k)], axis=1)
            touched, where = np.unique(own, return_inverse=True)
            step = np.stack([np.bincount(where, by_used[owner, i], minlength=len(touched)) for i in range(k)], axis=1)
            step = step / len(group) - settings.decay * crf.weights[touched]
            seen_w[touched] += step**2
            crf.weights[touched] += settings.rate * step / np.sqrt(seen_w[touched])
            inner = np.ones(len(marks), bool)
            inner[starts] = False
            pairs = np.flatnonzero(inner)
            actual = np.bincount(marks[pairs - 1] * k + marks[pairs], minlength=k * k).reshape(k, k)
            step = (actual - expected) / len(group)
            seen_t += step**2
            crf.transitions += settings.rate * step / np.sqrt(seen_t)
    return crf


def learning_rows(docs: DataFrame) -> DataFrame:
    """Texts and labels that may be learned from: labelled documents with a text that are not held out."""
    return docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out("doc_id")).select(
        "doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )


def train(docs: DataFrame, settings: CrfSettings = CrfSettings()) -> Crf:
    """A fitted model; ``docs`` has ``doc_id, text, lang``. Without any labelled document the model has no language."""
    rows = learning_rows(reachable(docs))
    lexicons = count_lexicons(rows.select("lang", "text"), settings.lexicon_share)
    key = F.xxhash64("doc_id", F.lit(settings.seed))
    usable = rows.filter(F.length("text").between(1, settings.most_chars)).select("lang", key.alias("key"), "doc_id")
    # The smallest hashes of each language, kept per task before anything is shuffled.
    chosen = _smallest(usable, settings.documents_per_language).select("lang", "doc_id").distinct()
    # A row for each of them, however often an id repeats: no language gets fewer because another has more.
    texts = rows.filter(F.length("text").between(1, settings.most_chars)).join(F.broadcast(chosen), ["lang", "doc_id"], "left_semi")
    sample = texts.groupBy("lang", "doc_id").agg(F.min("text").alias("text")).orderBy("lang", "doc_id").collect()
    if not sample:
        return Crf([])
    return fit([r.text for r in sample], [r.lang for r in sample], lexicons, settings)


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows with the smallest key of each language; every task passes on ``n`` per language at most."""

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = pd.DataFrame({"lang": pd.Series(dtype=object), "key": pd.Series(dtype="int64"), "doc_id": pd.Series(dtype="int64")})
        for batch in batches:
            best = pd.concat([best, batch]).sort_values(["key", "doc_id"]).groupby("lang", sort=False).head(n)
        yield best

    kinds = "lang string, key bigint, doc_id bigint"
    few = rows.mapInPandas(keep, kinds)
    return few.groupBy("lang").applyInPandas(lambda x: x.sort_values(["key", "doc_id"]).head(n), kinds)


def predict(docs: DataFrame, crf: Crf) -> DataFrame:
    """One row per document: ``doc_id, held_out, lang_pred, score, switches``.

    ``lang_pred`` is ``und`` with score 0 for texts that are null or have no letter, and where nothing was learned. ``score`` is
    the mean probability of the language over the words that have a letter, ``switches`` counts neighbouring words of a line whose
    likeliest languages differ. Ties go to the first language by name. Each row is judged by its text alone; rows may repeat,
    a NULL ``doc_id`` is not held out, an empty table gives no rows, other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)  # fixed size: buckets x languages, and the bounded lexicon

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        k = len(model.languages)
        number: dict[bytes, int] = {}
        known, lettered = np.zeros((1024, k)), np.zeros(1024, bool)
        for batch in runs(batches):
            texts = batch.column("text").to_pylist()
            if len(number) > 300_000:
                number.clear()
            before = len(number)
            lines, line_doc = [], []
            for i, text in enumerate(texts):
                if text is not None and k:
                    own = [x for x in (line.split() for line in text.encode("utf-8", "surrogatepass").split(b"\n")) if x]
                    lines += own
                    line_doc += [i] * len(own)
            lengths = np.array([len(x) for x in lines], np.int64)
            ids = np.fromiter((number.setdefault(w, len(number)) for ws in lines for w in ws), np.int64, int(lengths.sum()))
            new = [w.decode("utf-8", "replace") for w in list(number)[before:]]
            if len(number) > len(known):
                grow = max(len(number), 2 * len(known)) - len(known)
                known, lettered = np.concatenate([known, np.zeros((grow, k))]), np.concatenate([lettered, np.zeros(grow, bool)])
            if new:
                forms = [word_form(w) for w in new]
                known[before : len(number)] = emissions(forms, model)
                lettered[before : len(number)] = [w.isalpha() or any(map(str.isalpha, w)) for w in new]
            n = len(texts)
            sums, words, switches = np.zeros((n, max(k, 1))), np.zeros(n), np.zeros(n, np.int64)
            if len(ids):
                starts = np.cumsum(lengths) - lengths
                p, _ = forward_backward(known[ids], starts, lengths, model.transitions)
                doc = np.repeat(np.array(line_doc), lengths)
                use = lettered[ids]
                sums = np.stack([np.bincount(doc[use], p[use, i], minlength=n) for i in range(k)], axis=1)
                words = np.bincount(doc[use], minlength=n)
                best = p.argmax(axis=1)
                turned = np.flatnonzero(best[1:] != best[:-1]) + 1
                turned = turned[~np.isin(turned, starts)]
                switches = np.bincount(doc[turned], minlength=n)
            mean = sums / np.maximum(words, 1)[:, None]
            best = mean.argmax(axis=1)
            some = words > 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("held_out"),
                    pa.array([model.languages[b] if s else "und" for b, s in zip(best, some, strict=True)]),
                    pa.array(np.where(some, np.clip(mean.max(axis=1), 0, 1), 0.0)), pa.array(switches, pa.int64()),
                ],
                ["doc_id", "held_out", "lang_pred", "score", "switches"],
            )

    slim = id_and_text(docs, keep_null=True).withColumn("held_out", is_held_out("doc_id"))
    return slim.mapInArrow(judge, "doc_id bigint, held_out boolean, lang_pred string, score double, switches bigint")
