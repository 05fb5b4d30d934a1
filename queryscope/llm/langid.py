"""Language identification by word-first backoff.

A known word scores by its log frequency in each language. An unseen word falls back to the longest order of character
n-grams (with word borders) of which the model knows any, down to single letters; a word without known letters says
nothing. A text's language has the greatest sum over all its words.

The model is fitted on a bounded sample: about ``SAMPLE_ROWS`` labelled rows, picked by a hash of the id (all, if there are
fewer). Words and n-grams are counted on Spark; those seen at least ``MIN_COUNT`` times make the model, whose size is
bounded by the sample. Scoring covers whole texts.

A language always wins, so ``identify`` can add the ``evidence`` for it: the mean over the text's character trigrams (with word
borders) of log(p * n), where p is the trigram's smoothed frequency in the language that won and n the number of trigrams
known there. Text like the language's own is above 0 (its distance from even use of all trigrams). A trigram that the
language lacks is below -1, mostly far below, so unlearned scripts and languages and letters at random have evidence below
0. Where such junk was labelled and learned, its evidence is about the log of its share of the language's text.

Defined cases: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing was learned (evidence null);
letters that the model never saw leave all languages equal (the first in order wins); ties go to the first in order;
rows without language or text teach nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from queryscope.llm.common import bounded_sample, lean, replace_columns, texts_of, type_of

#: labelled rows that the model is fitted on, at most about
SAMPLE_ROWS = 24_000
MIN_COUNT = 3
#: longest character n-gram
ORDER = 4
#: n-grams that a prediction's evidence counts
TRIGRAM = 3
#: words remembered by a worker beside the model's own
MEMORY = 400_000

WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case (a run may hold a few letter-like numerals)."""
    return WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Character n-grams; longer than one letter, with word borders."""
    if n == 1:
        return [c for c in word if c.isalpha()]
    marked = f"^{word}$"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies: one row per word or n-gram, one column per language."""

    langs: list[str]
    words: dict[str, int]
    grams: list[dict[str, int]]  # by order
    rows: np.ndarray
    #: evidence of each trigram, in the order of ``grams[TRIGRAM]``, and of an unknown one
    gains: np.ndarray
    memory: dict[str, int] = field(default_factory=dict)

    def unseen(self, word: str) -> np.ndarray | None:
        for n in range(len(self.grams) - 1, 0, -1):
            known = [self.grams[n][g] for g in grams_of(word, n) if g in self.grams[n]]
            if known:
                return self.rows[known].mean(0)
        return None

    def evidence(self, word: str) -> np.ndarray:
        """Sum of the evidence of a word's trigrams (as many as letters) in each language."""
        index, first = self.grams[TRIGRAM], len(self.words) + sum(map(len, self.grams[:TRIGRAM]))
        return self.gains[[index[g] - first if g in index else -1 for g in grams_of(word, TRIGRAM)]].sum(0)


class Scorer:
    """A model with a bounded memory of unseen words; ``known``: evidence of the model's words, if evidence is wanted."""

    def __init__(self, model: Model, known: np.ndarray | None = None):
        self.model, self.known = model, known
        self.reset()

    def reset(self) -> None:
        n = len(self.model.words)
        self.place = dict(self.model.words)
        self.table = np.zeros((n + MEMORY, len(self.model.langs)), np.float32)
        self.table[:n] = self.model.rows[:n]
        if self.known is not None:
            self.backing = np.zeros((n + MEMORY, len(self.model.langs)), np.float32)
            self.backing[:n] = self.known
        self.used = n

    def score(self, text: str) -> tuple[str, float, float | None]:
        """Language, score, and the evidence if it is wanted."""
        words = words_of(text)
        langs = self.model.langs
        if not langs or not any(w.isalpha() or any(map(str.isalpha, w)) for w in words):
            return "und", 0.0, None
        total, n = np.zeros(len(langs)), 0
        backed, letters = np.zeros(len(langs)), 0
        for k in range(0, len(words), MEMORY):
            part = words[k : k + MEMORY]
            found = list(map(self.place.get, part))
            if None in found:
                new = {w for w, i in zip(part, found) if i is None}
                if self.used + len(new) > len(self.table):
                    self.reset()
                    new = {w for w in part if w not in self.place}
                for w in new:
                    row = self.model.unseen(w)
                    if row is not None:
                        self.table[self.used] = row
                    if self.known is not None:
                        self.backing[self.used] = self.model.evidence(w)
                    self.place[w] = self.used
                    self.used += 1
                found = list(map(self.place.__getitem__, part))
            total += self.table[found].sum(0, dtype=np.float64)
            n += len(part)
            if self.known is not None:
                backed += self.backing[found].sum(0, dtype=np.float64)
                letters += sum(map(len, part))
        best = int(np.argmax(total))
        share = np.exp((total - total[best]) / n * min(n, 20))
        return langs[best], float(1.0 / share.sum()), None if self.known is None else float(backed[best] / letters)


def _counts(rows: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """(lang, n, gram, k): words (n = 0) and their n-grams, counted per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for lang, words in seen.items():
                yield batch(lang, 0, words)
                for n in range(1, ORDER + 1):
                    grams: Counter = Counter()
                    for w, k in words.items():
                        for g in grams_of(w, n):
                            grams[g] += k
                    yield batch(lang, n, grams)
            seen.clear()

        def batch(lang: str, n: int, c: Counter) -> pa.RecordBatch:
            m = len(c)
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * m, pa.string()), pa.array([n] * m, pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())],
                names=["lang", "n", "gram", "k"],
            )

        for b in batches:
            for lang, text in zip(b.column(lang_col).to_pylist(), texts_of(b, text_col)):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > MEMORY:
                yield from out()
        yield from out()

    part = rows.select(lang_col, text_col).mapInArrow(lean(run), "lang string, n int, gram string, k bigint")
    return part.groupBy("lang", "n", "gram").agg(F.sum("k").alias("k"))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS) -> Model:
    """Model from rows with text and language; reads a bounded sample (module docstring)."""
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = _counts(bounded_sample(known, id_col, rows), text_col, lang_col)
    table = counts.where(F.col("k") >= MIN_COUNT).toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    at = {x: i for i, x in enumerate(langs)}
    words: dict[str, int] = {}
    grams: list[dict[str, int]] = [{} for _ in range(ORDER + 1)]
    lang, order, gram, k = (table.column(c).to_pylist() for c in ("lang", "n", "gram", "k"))
    places, gains = [], np.zeros((1, len(langs)))
    for n in range(ORDER + 1):
        index = words if n == 0 else grams[n]
        start = len(places)
        own = [i for i, m in enumerate(order) if m == n]
        for i in own:
            if gram[i] not in index:
                index[gram[i]] = start + len(index)
        raw = np.zeros((len(index), len(langs)))
        for i in own:
            raw[index[gram[i]] - start, at[lang[i]]] += k[i]
        scale = raw.sum(0) + 0.5 * max(1, len(index))
        logs = np.log((raw + 0.5) / scale)
        places.extend(logs)
        if n == TRIGRAM:
            gains = np.vstack([logs, np.log(0.5 / scale)]) + np.log(np.maximum(1, (raw > 0).sum(0)))
    return Model(langs, words, grams, np.array(places, np.float32).reshape(len(places), len(langs)), gains)


def identify(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", evidence: bool = False) -> DataFrame:
    """``keep`` columns, lang_pred and score (0 to 1) per row, and ``evidence`` if wanted (module docstring)."""
    rows = docs.select(*dict.fromkeys([*keep, text_col]))
    backing = np.array([model.evidence(w) for w in model.words], np.float32).reshape(len(model.words), len(model.langs)) if evidence else None
    sent = docs.sparkSession.sparkContext.broadcast((model, backing))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for b in batches:
            got = [scorer.score(t) for t in texts_of(b, text_col)]
            new = {"lang_pred": pa.array([x for x, _, _ in got], pa.string()), "score": pa.array([s for _, s, _ in got], pa.float64())}
            if evidence:
                new["evidence"] = pa.array([e for _, _, e in got], pa.float64())
            yield replace_columns(b, keep, **new)

    schema = ", ".join(f"`{c}` {type_of(rows, c)}" for c in keep)
    return rows.mapInArrow(lean(run), f"{schema}, lang_pred string, score double{', evidence double' if evidence else ''}")
