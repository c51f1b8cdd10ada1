"""Language identification with word-first backoff.

A known word scores its log frequency in each language; an unseen word falls back to its character n-grams,
longest first: each position takes the longest n-gram the training texts hold, and the word scores their
mean. The model is fitted on a bounded number of labelled texts, ``sample_docs`` per language by a hash
of the id, each whole: words and n-grams are counted in Spark, and only those used often enough are collected.
Prediction reads whole texts, a batch at a time.

Defined results: null texts and texts without a letter are ``und`` with score 0; equal scores go to the
language that sorts first; without any labelled text every text is ``und``. Labels that are null are not learned, and
of more than 200 labels those with the most ids are. Rows that repeat an id are predicted like any other, but an id is learned once
per language, by its smallest text. Further columns stay, but for those named like a result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_remainder, one_text_rows, sampled, store

SAMPLE_DOCS, LONGEST, WORD_PRIOR, BACKOFF = 800, 4, 0.1, 2.0
CACHED, COUNTED = 250_000, 100_000
#: What a worker may spend on unseen words: their scores, and about so many bytes for each word itself.
CACHED_BYTES, WORD_BYTES = 40 << 20, 150
_WORD = re.compile(r"[^\W\d_]+")
UNDETERMINED = "und"


def _has_letter(word: str) -> bool:
    return word[0].isalpha() or any(map(str.isalpha, word))


class _Rows(dict):
    """word -> row of the score matrix; unseen words are backed off and kept in a bounded number of further rows."""

    def __init__(self, model: Model):
        super().__init__((word, k) for k, word in enumerate(model.words))
        self.model, self.known = model, len(model.words)
        self.scores = np.zeros((self.known + model.cached, len(model.languages)))
        if self.known:
            self.scores[: self.known] = list(model.words.values())

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.scores):
            raise OverflowError
        self.scores[row] = self.model.back_off(word)
        self[word] = row
        return row


class _Longest(dict):
    """window -> score of the longest known n-gram that it begins with, or None; a bounded number of them is kept."""

    def __init__(self, grams: list[dict[str, list[float]]]):
        super().__init__()
        self.grams = grams

    def __missing__(self, window: str) -> list[float] | None:
        if len(self) >= CACHED:
            self.clear()
        self[window] = found = next((score for size in range(len(window), 0, -1) if (score := self.grams[size - 1].get(window[:size]))), None)
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, word, n), a bounded number of words at a time."""
    counts: Counter = Counter()

    def flushed() -> pa.RecordBatch:
        langs, words = zip(*counts) if counts else ((), ())
        out = pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts.values(), pa.int64())], ["lang", "word", "n"])
        counts.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts.update((lang, m[0]) for m in _WORD.finditer(text.as_py().lower()))
            if len(counts) >= COUNTED:
                yield flushed()
    yield flushed()


class Sample:
    """The texts to learn from, rows(doc_id, lang, text): counted in Spark; iterates as (language, text)."""

    def __init__(self, rows: DataFrame):
        self.rows = rows

    def __iter__(self) -> Iterator[tuple[str, str]]:
        return ((r.lang, r.text) for r in self.rows.orderBy("lang", "doc_id").toLocalIterator())

    def languages(self) -> list[str]:
        return sorted(r.lang for r in self.rows.select("lang").distinct().collect())

    def counts(self, longest: int, least_uses: int) -> Iterator[tuple[int, str, dict[str, int]]]:
        """(0 for a word or else the n-gram's length, feature, uses per language) of features used ``least_uses`` times or more."""
        counted = self.rows.select("lang", "text").mapInArrow(_count, "lang string, word string, n long")
        words = store(counted.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        padded = F.concat(F.lit(" "), "word", F.lit(" "))
        ends = lambda size: F.sequence(F.lit(1), F.length(padded) - size + 1)
        grams = lambda size: F.when(F.length(padded) >= size, F.transform(ends(size), lambda k: F.substr(padded, k, F.lit(size))))
        features = words.select("lang", F.lit(0).alias("kind"), F.col("word").alias("feature"), "n")
        for size in range(1, longest + 1):
            features = features.unionByName(words.select("lang", F.lit(size).alias("kind"), F.explode(grams(size)).alias("feature"), "n"))
        uses = features.groupBy("kind", "feature", "lang").agg(F.sum("n").alias("n")).groupBy("kind", "feature")
        for r in uses.agg(F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where(F.col("total") >= least_uses).collect():
            yield r.kind, r.feature, r.by


class Model:
    """words and grams: feature -> log frequency per language, centred on the mean over languages."""

    def __init__(self, languages: list[str], words: dict[str, list[float]], grams: list[dict[str, list[float]]]):
        self.languages, self.words, self.grams = languages, words, grams
        self.cached = max(1, min(CACHED, CACHED_BYTES // (8 * len(languages) + WORD_BYTES)))
        self._rows: _Rows | None = None
        self._longest = _Longest(grams)

    @classmethod
    def fit(cls, texts: Sample, longest: int = LONGEST, least_uses: int = 2) -> Model:
        """Words and n-grams used less than ``least_uses`` times are left to shorter n-grams."""
        languages = texts.languages()
        tables: list[dict[str, list[float]]] = [{} for _ in range(longest + 1)]
        for kind, feature, counts in texts.counts(longest, least_uses):
            tables[kind][feature] = [counts.get(lang, 0) for lang in languages]
        for table in tables:
            if table:
                freq = np.array(list(table.values()), float) + WORD_PRIOR
                logs = np.log(freq / freq.sum(0))
                table.update(zip(table, (logs - logs.mean(1, keepdims=True)).tolist()))
        return cls(languages, tables[0], tables[1:])

    def back_off(self, word: str) -> list[float]:
        """The score of an unseen word, from the longest known n-gram at each of its positions."""
        padded, longest, best = f" {word} ", len(self.grams), self._longest
        found = [score for k in range(len(padded)) if (score := best[padded[k : k + longest]])]
        share = BACKOFF * max(1, len(found))
        return [sum(x) / share for x in zip(*found)] if found else [0.0] * len(self.languages)

    def _part(self, words: list[str]) -> np.ndarray:
        if self._rows is None:
            self._rows = _Rows(self)
        try:
            return self._rows.scores[np.fromiter(map(self._rows.__getitem__, words), np.intp, len(words))].sum(0)
        except OverflowError:  # start the further rows anew, which hold as many words as a part has
            self._rows = None
            return self._part(words)

    def _total(self, words: list[str]) -> np.ndarray:
        """The scores' sum, added in parts of fixed size, so that it does not depend on what the rows hold."""
        return sum(self._part(words[k : k + self.cached]) for k in range(0, len(words), self.cached))

    def predict(self, text: str | None) -> tuple[str, float]:
        """The language, and its share of the likelihood, damped by the root of the number of words."""
        words = _WORD.findall((text or "").lower())
        if not self.languages or not any(map(_has_letter, words)):
            return UNDETERMINED, 0.0
        total = self._total(words) / math.sqrt(len(words))
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def held_out(doc_id):
    return id_remainder(doc_id, 3) == 1


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from a sample, bounded as said, of the labelled rows that are not held out."""
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    picked = sampled(known.select("doc_id", "lang"), "lang", sample_docs)
    return Model.fit(Sample(one_text_rows(known.select("doc_id", "lang", "text"), picked, "lang")))


def predict(documents: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """documents with the predicted language and its score, in columns of these names."""
    shipped = documents.sparkSession.sparkContext.broadcast((model.languages, model.words, model.grams))

    @F.arrow_udf("struct<language string, score double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shipped.value)
        for texts in batches:
            found = [own.predict(x.as_py()) for x in texts]  # one text at a time becomes a string
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], ["language", "score"])

    run = run.asNondeterministic()  # else a filter on the score runs it a second time, in workers of its own
    held = fresh("language", documents.columns)
    found = documents.withColumn(held, run("text"))
    return found.withColumns({names[0]: F.col(f"{held}.language"), names[1]: F.col(f"{held}.score")}).drop(held)
