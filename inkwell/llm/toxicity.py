"""Toxicity by a weighted lexicon.

Texts are folded first: compatibility forms, case, homoglyphs (Cyrillic, Greek and full-width look-alikes) and digits
or signs that stand for letters (l counts as i, as 1 may stand for both); then every run of letters is a word. Lexicon
entries are words, beginnings of words (their inflections count) or phrases with a weight; exceptions are words or
phrases that an entry must not be found in. One Aho-Corasick automaton finds all of both in one pass over the whole
text; matches that lie inside a match of an exception are dropped, and of the entries found in one word the heaviest
counts. The sum of the weights, divided by a power of the number of words, is put on a logistic curve.

The lexicon can be given or learned from labelled rows: document frequencies of words, word beginnings and pairs of
words among toxic and clean documents are counted in the tasks, and all terms whose log-odds are clear enough become
entries. Exceptions are learned next: clean words that begin like an entry, and phrases of two or three words around an
entry that stand in clean documents and hardly in toxic ones. A word that is used both ways, so that its log-odds are
positive but not clear enough, is looked at once more: where such phrases stand around it, its documents are counted
again without the places inside them, and if it is clear enough then, the word becomes an entry and its phrases
exceptions. The curve's rows are weighted by how frequent their class
is among all ids that may be learned from.

Defined results: null, empty and word-free texts have no matches and the score of none; a null doc_id is scored, but
never learned from; repeated rows are scored one by one, and of the texts of a repeated id the first in order is learned
from; ids with both labels are not learned from; with labels of one class only, or none, and no lexicon given,
every score is 0. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkwell.llm.common import id_crc, materialize, slices
from inkwell.llm.quality import class_weights, labelled_sample, logistic, rated_ids

# Look-alikes of Latin letters, and what is written for letters.
LOOKALIKES = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "т": "t", "у": "y", "ѵ": "v", "ԝ": "w", "х": "x", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "μ": "m", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʏ": "y", "ɩ": "i"}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "l": "i"}
_FOLD = str.maketrans(SUBSTITUTES | {k: SUBSTITUTES.get(v, v) for k, v in LOOKALIKES.items()})
_BETWEEN = re.compile(r"[\W\d_]+")
#: Stands between folded words.
MARK = "\x01"
BEGINNINGS = (4, 5, 6, 7)


def fold(text: str | None) -> str:
    """Folded words, with MARK before, between and after them."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return MARK + _BETWEEN.sub(MARK, text.lower().translate(_FOLD)).strip(MARK) + MARK


@dataclass(frozen=True)
class ToxicityModel:
    """entries: folded pattern (MARK at its start, and at its end for whole words) to weight; exceptions: patterns."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 0.0
    intercept: float = -60.0
    power: float = 0.25

    def score(self, value: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * value + self.intercept, -60, 60)))


def lexicon_model(words: dict[str, float], exceptions: tuple[str, ...] = (), slope: float = 4.0, intercept: float = -4.0) -> ToxicityModel:
    """A model from a hand-made lexicon of words or phrases (a * at the end: also longer words) and exception phrases."""
    entries = {(fold(w[:-1])[:-1] if w.endswith("*") else fold(w)): weight for w, weight in words.items()}
    return ToxicityModel(entries, tuple(map(fold, exceptions)), slope, intercept)


class Matcher:
    """Sum of weights found in a text, and its number of words."""

    def __init__(self, model: ToxicityModel):
        self.power, self.automaton = model.power, ahocorasick.Automaton()
        for p, w in model.entries.items():
            self.automaton.add_word(p, (len(p), w))
        for p in model.exceptions:
            self.automaton.add_word(p, (len(p), None))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def spans(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the matches that count: one for each place where a word begins."""
        if self.empty:
            return []
        best: dict[int, tuple[int, float]] = {}
        safe = []
        for last, (size, weight) in self.automaton.iter(folded):
            start = last - size + 1
            if weight is None:
                safe.append((start, last + 1))
            elif start not in best or weight > best[start][1]:
                best[start] = (last + 1, weight)
        if safe:
            reach, at, safe = -1, 0, sorted(safe)
            for start in sorted(best):
                while at < len(safe) and safe[at][0] <= start:
                    reach, at = max(reach, safe[at][1]), at + 1
                if best[start][0] <= reach:
                    del best[start]
        return [(s, e, w) for s, (e, w) in sorted(best.items())]

    def __call__(self, text: str | None) -> tuple[float, int]:
        folded = fold(text)
        total = sum(w for _, _, w in self.spans(folded))
        words = folded.count(MARK) - 1 if len(folded) > 2 else 0
        return (total / max(1, words) ** self.power, words)


def _counted(sample: DataFrame, make: Callable[[], Callable[[str], set[str]]]) -> DataFrame:
    """term, toxic, clean: in how many documents of the sample (label, text) each term of their folded texts stands;
    make gives the function that finds the terms, once in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms_of = make()
        for b in slices(batches):
            found = (Counter(), Counter())
            for label, text in zip(b.column("label").to_pylist(), b.column("text").to_pylist(), strict=True):
                found[label].update(terms_of(fold(text)))
            seen = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(seen, pa.string()), pa.array([found[1][t] for t in seen], pa.int64()), pa.array([found[0][t] for t in seen], pa.int64())], ["term", "toxic", "clean"])

    return sample.select("label", "text").mapInArrow(run, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def terms(folded: str) -> set[str]:
    """The words, word beginnings and pairs of words of a folded text."""
    row = [w for w in folded.split(MARK) if w]
    words = set(row)
    return {MARK + w + MARK for w in words} | {MARK + w[:n] for w in words for n in BEGINNINGS if len(w) >= n} | {f"{MARK}{a}{MARK}{b}{MARK}" for a, b in zip(row, row[1:], strict=False)}


class Phrases:
    """Callable on a folded text: the phrases of two and three words that hold a match of the lexicon."""

    def __init__(self, model: ToxicityModel):
        self.match = Matcher(model)

    def __call__(self, folded: str) -> set[str]:
        out: set[str] = set()
        marks = [i for i, c in enumerate(folded) if c == MARK]
        for start, end, _ in self.match.spans(folded):
            i = bisect_left(marks, start)
            j = max(i + 1, bisect_left(marks, end - 1))  # the words between marks i and j hold the match
            for size in (2, 3):
                for first in range(max(0, j - size), min(i, len(marks) - 1 - size) + 1):
                    out.add(folded[marks[first] : marks[first + size] + 1])
        return out


class Outside:
    """Callable on a folded text: the entries found outside the model's exceptions."""

    def __init__(self, model: ToxicityModel):
        self.match = Matcher(model)

    def __call__(self, folded: str) -> set[str]:
        return {folded[start:end] for start, end, _ in self.match.spans(folded)}


def choose_entries(weights: dict[str, float]) -> dict[str, float]:
    """Of the terms that are clear enough those that say something new: a term that begins with, ends with or holds
    another one must weigh clearly more."""
    kept: dict[str, float] = {}
    for term in sorted(weights, key=lambda t: (t.count(MARK) > 2, len(t), t)):
        inside = [kept[term[:n]] for n in range(2, len(term)) if term[:n] in kept]
        if term.count(MARK) > 2:
            words = [f"{MARK}{w}{MARK}" for w in term.strip(MARK).split(MARK)]
            inside += [kept[w[:n]] for w in words for n in range(2, len(w) + 1) if w[:n] in kept]
        if not inside or weights[term] > max(inside) + 2.0:
            kept[term] = weights[term]
    return kept


def fit_toxicity(
    documents: DataFrame, labels: DataFrame, *, train: Column | None = None, lexicon_docs: int = 5000, calibration_docs: int = 2500, min_docs: int = 4, min_weight: float = 3.0, min_doubtful: float = 0.5, min_exception: float = 1.0, power: float = 0.25
) -> ToxicityModel:
    """Learn lexicon and curve from labelled rows: at most lexicon_docs and calibration_docs of each class. Terms in
    min_docs toxic documents whose log-odds reach min_weight become entries, all of them; what stands in min_docs clean
    documents with log-odds of -min_exception or less, exceptions. Words whose log-odds reach min_doubtful only become
    entries if they reach min_weight without the places inside such phrases. A quarter of the ids, told apart by their crc32, is
    kept for the curve."""
    train = F.lit(True) if train is None else train
    aside = (F.floor(id_crc(F.col("doc_id")) / 7) % 4) == 0
    rated = rated_ids(labels, "toxic", train)
    sample = materialize(labelled_sample(documents, rated.filter(~aside), lexicon_docs), "lexicon-sample")
    sizes = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return ToxicityModel(power=power)
    odds = lambda c, n: F.log((F.col(c) + 0.5) / (F.lit(n) - F.col(c) + 0.5))
    weighed = lambda counts: counts.withColumn("weight", odds("toxic", n_toxic) - odds("clean", n_clean)).filter(F.col("toxic") + F.col("clean") >= min_docs)
    counts = materialize(weighed(_counted(sample, lambda: terms)), "terms")
    found = {r["term"]: r["weight"] for r in counts.filter((F.col("toxic") >= min_docs) & (F.col("weight") >= min(min_doubtful, min_weight))).collect()}
    kept = choose_entries({t: w for t, w in found.items() if w >= min_weight})
    doubtful = {t: w for t, w in found.items() if w < min_weight and t.endswith(MARK) and t.count(MARK) == 2 and not any(t[:n] in kept for n in range(2, len(t) + 1))}
    shared = documents.sparkSession.sparkContext.broadcast(ToxicityModel(kept | doubtful))
    harmless = (F.col("clean") >= min_docs) & (F.col("weight") <= -min_exception)
    phrases = [r["term"] for r in weighed(_counted(sample, lambda: Phrases(shared.value))).filter(harmless).select("term").collect()]
    inside = {f"{MARK}{w}{MARK}" for p in phrases for w in p.strip(MARK).split(MARK)}
    again = {t: w for t, w in doubtful.items() if t in inside}
    if again:
        outside = documents.sparkSession.sparkContext.broadcast(ToxicityModel(again, tuple(phrases)))
        clear = weighed(_counted(sample, lambda: Outside(outside.value))).filter((F.col("toxic") >= min_docs) & (F.col("weight") >= min_weight))
        kept |= {r["term"]: r["weight"] for r in clear.collect()}
    around = Matcher(ToxicityModel(kept))
    phrases = [p for p in phrases if around.spans(p)]
    starts = [t for t in kept if not t.endswith(MARK)]
    doubt = F.lit(False)
    for n in BEGINNINGS:
        some = [t for t in starts if len(t) == n + 1]
        if some:
            doubt = doubt | F.substring("term", 1, n + 1).isin(some)
    alone = F.length(F.replace(F.col("term"), F.lit(MARK), F.lit(""))) == F.length("term") - 2
    words = counts.filter(F.col("term").endswith(MARK) & alone & (F.col("weight") < 0) & doubt)
    exceptions = tuple(sorted({*phrases, *(r["term"] for r in words.select("term").collect())}))
    model = ToxicityModel(kept, exceptions, power=power)
    held = _values(labelled_sample(documents, rated.filter(aside), calibration_docs), model, ["doc_id", "label"]).select("doc_id", "value", "label").orderBy("doc_id").collect()
    y = np.array([r["label"] for r in held], dtype=float)
    if len(set(y)) < 2:
        return ToxicityModel(kept, exceptions, 2.0, -2.0, power)
    by_class = class_weights(rated.filter(aside), Counter(r["label"] for r in held))
    weights, intercept = logistic(np.array([[r["value"]] for r in held], dtype=float), y, np.array([by_class[r["label"]] for r in held]))
    return ToxicityModel(kept, exceptions, float(weights[0]), intercept, power)


def _values(documents: DataFrame, model: ToxicityModel, keep: list[str]) -> DataFrame:
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(shared.value)
        for b in slices(batches):
            done = [match(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array([d[0] for d in done], pa.float64()), pa.array([d[1] for d in done], pa.int64())], [*keep, "value", "n_words"])

    schema = ", ".join(f"`{k}` {documents.schema[k].dataType.simpleString()}" for k in keep) + ", value double, n_words long"
    return documents.select(*keep, "text").mapInArrow(run, schema)


def score_toxicity(documents: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, value (normalised weight), n_words, score of every row, each whole text read once."""
    x = F.lit(float(model.slope)) * F.col("value") + F.lit(float(model.intercept))
    score = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), x))))
    return _values(documents.select("doc_id", "text"), model, ["doc_id"]).withColumn("score", score)
