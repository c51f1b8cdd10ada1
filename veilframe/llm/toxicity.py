"""Toxicity by a character n-gram linear classifier with naive Bayes feature scaling.

A text's features are the distinct character n-grams of its distinct words (padded with a space on either
side). Each is scaled by its log-count ratio between toxic and other training texts; a logistic model over
the scaled features is fitted by full-batch gradient steps on a bounded sample of labelled texts:
``sample_docs`` per class, by a hash of the id. Executors count the n-grams of the whole sampled texts and then look up
those that the model uses, so the driver holds ids of features, never texts. Of the n-grams of ``LEAST_DOCS`` texts or
more, the model uses the ``FEATURES`` whose ratio stands out most from its own sampling error. Scoring reads whole texts.

Defined results: null and empty texts have no features and score the model's bias, as does a text of unseen
n-grams; without labelled rows of both classes every score is the share of toxic labels (0 without any).
Rows that repeat an id are scored like any other, but an id is learned once per label, by its smallest text; labels
that are null or neither 0 nor 1 are not learned. Further columns stay, but for those named like a result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import id_remainder, one_text_rows, sampled, store

SIZES, SAMPLE_DOCS, FEATURES, LEAST_DOCS, THRESHOLD = (3, 4, 5), 1200, 4000, 5, 0.3
STEPS, RATE, RIDGE, CACHED, COUNTED = 300, 1.0, 4e-4, 250_000, 400_000
_WORD = re.compile(r"[^\W\d_]+")


def word_grams(word: str) -> set[str]:
    padded = f" {word} "
    return {padded[k : k + n] for n in SIZES for k in range(len(padded) - n + 1)}


def distinct_words(text: str | None) -> set[str]:
    return set(_WORD.findall((text or "").lower()))


class _Found(dict):
    """word -> ids of its n-grams that the model uses; a bounded number of words is kept."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHED:
            self.clear()
        found = self[word] = tuple(self.ids[g] for g in word_grams(word) if g in self.ids)
        return found


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(y, text) -> (gram, n0, n1): in how many texts of either label, a bounded number of n-grams at a time."""
    counts: tuple[Counter, Counter] = Counter(), Counter()

    def flushed() -> pa.RecordBatch:
        grams = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), *(pa.array([c[g] for g in grams], pa.int64()) for c in counts)], ["gram", "n0", "n1"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            counts[y].update({g for word in distinct_words(text.as_py()) for g in word_grams(word)})
            if sum(map(len, counts)) >= COUNTED:
                yield flushed()
    yield flushed()


class Model:
    def __init__(self, bias: float, ids: dict[str, int], weights: np.ndarray):
        self.bias, self.ids, self.weights = bias, ids, weights
        self._found = _Found(ids)

    @classmethod
    def constant(cls, share: float) -> Model:
        """share: the part of toxic labels, the score of every text where one class is missing."""
        return cls(float(np.log((share + 1e-3) / (1 - share + 1e-3))), {}, np.zeros(0))

    @classmethod
    def fit(cls, rows: list[np.ndarray], toxic: list[int], scale: np.ndarray, ids: dict[str, int]) -> Model:
        """rows: the features of each text; scale: their log-count ratios; ids: their n-grams."""
        labels = np.array(toxic, float)
        n = np.array([len(labels) - labels.sum(), labels.sum()])
        flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        # Both classes weigh the same: a short text with one telling word must count as much as a long one.
        weight = np.where(labels == 1, 0.5 / n[1], 0.5 / n[0])
        length = max(1.0, np.sqrt((scale[flat] ** 2).sum() / len(rows)))
        w, bias = np.zeros(len(scale)), 0.0
        speed_w, speed_b = np.zeros_like(w), 0.0
        for _ in range(STEPS):
            margin = np.bincount(owner, (w * scale)[flat], len(rows)) / length + bias
            error = (1 / (1 + np.exp(-margin)) - labels) * weight
            gradient = np.bincount(flat, error[owner], len(scale)) * scale / length + RIDGE / max(1, len(scale)) * w
            speed_w, speed_b = 0.9 * speed_w - RATE * gradient * 10, 0.9 * speed_b - RATE * error.sum()
            w, bias = w + speed_w, bias + speed_b
        return cls(float(bias), ids, w * scale / length)

    def features(self, text: str | None) -> set[int]:
        found: set[int] = set()
        get = self._found
        for word in distinct_words(text):
            if ids := get[word]:
                found.update(ids)
        return found

    def score(self, text: str | None) -> float:
        found = self.features(text)
        margin = self.bias + (self.weights[sorted(found)].sum() if found else 0.0)
        return float(1 / (1 + np.exp(-np.clip(margin, -500, 500))))


def held_out(doc_id):
    return id_remainder(doc_id, 4) == 2


def chosen(rows: DataFrame, sizes: tuple[int, int], features: int = FEATURES) -> list:
    """The (gram, ratio) of the model, the most telling first, ties by n-gram. rows(y, text); sizes: texts of either label."""
    counts = rows.select("y", "text").mapInArrow(_count, "gram string, n0 long, n1 long").groupBy("gram").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    ratio = F.log((F.col("n1") + 1) / (sizes[1] + 2)) - F.log((F.col("n0") + 1) / (sizes[0] + 2))
    strength = F.abs(F.col("ratio")) / F.sqrt(1 / (F.col("n0") + 1) + 1 / (F.col("n1") + 1))
    return counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("ratio", ratio).orderBy(F.desc(strength), "gram").limit(features).select("gram", "ratio").collect()


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}  # two rows
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    picked = store(sampled(known, "y", sample_docs), "picked")
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = one_text_rows(rows, picked, "y")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model.constant(share)
    listed = chosen(rows, (sizes[0], sizes[1]))
    ids = {r.gram: k for k, r in enumerate(listed)}
    shipped = documents.sparkSession.sparkContext.broadcast(ids)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(0.0, shipped.value, np.zeros(0))
        for batch in batches:
            used = pa.array([np.sort(np.fromiter(own.features(x.as_py()), np.int32)) for x in batch.column(2)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), used], ["doc_id", "y", "used"])

    # At most FEATURES numbers a text of the sample.
    made = rows.select("doc_id", "y", "text").mapInArrow(look_up, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, y int, used array<int>").toArrow().sort_by([("y", "ascending"), ("doc_id", "ascending")])
    used = [x.values.to_numpy() for x in made.column("used")]
    return Model.fit(used, made.column("y").to_pylist(), np.array([r.ratio for r in listed]), ids)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """documents with score and predicted."""
    shipped = documents.sparkSession.sparkContext.broadcast((model.bias, model.ids, model.weights))

    @F.pandas_udf(DoubleType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shipped.value)
        for texts in batches:
            yield pd.Series([own.score(x) for x in texts], dtype="float64")

    run = run.asNondeterministic()  # else a filter on the score would run it a second time
    return documents.withColumn("score", run("text")).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
