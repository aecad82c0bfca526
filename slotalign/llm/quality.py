"""A quality classifier from supervised subword embeddings.

A text is the average of the vectors of its features: its words (runs without blanks, case and marks kept; a
word like the one before it is read as "ditto") and its byte 3- and 4-grams, hashed to 2^18 buckets. A softmax over the classes follows. Vectors and output
weights are learned together by stochastic gradient descent on a bounded sample of labelled texts
(``MAX_TEXTS``); learning stops there because its matrix must fit one process, scoring covers all texts.

As the output is linear in the average, each bucket's vector is folded into one number before scoring:
tasks get a table of fixed size, and a text is scored by summing entries of it.

Defined results: a text without features (NULL, empty) gets the score of a zero vector. NULL labels are no
labels; of repeated labels of one id the smallest counts; labels of unknown ids are ignored. If all labels
agree, or there are none, every score is the smoothed share of class 1. Repeated rows get equal scores.
Columns named like the results are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import add_columns, small_slices
from .words import BASE, powers_of

BUCKET_BITS = 18
GRAMS = (3, 4)
DIMENSIONS = 8
MAX_TEXTS = 2000
EPOCHS = 4
RATE = 10.0
DITTO = 0
SEED = 7


class Features:
    """Feature buckets of texts; make one per task."""

    def __init__(self) -> None:
        self.powers = self.inverses = np.ones(1, np.uint64)
        self.blank = np.zeros(256, np.int8)
        self.blank[[9, 10, 11, 12, 13, 32]] = 1

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For words and for each gram size: buckets, and where each text begins and ends among them."""
        texts = pc.fill_null(texts, "")
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        offsets = np.frombuffer(texts.buffers()[1], kind)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
        raw = texts.buffers()[2]
        data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw else np.empty(0, np.uint8)
        offsets = offsets - offsets[0]
        if len(self.powers) <= len(data):
            self.powers, self.inverses = (powers_of(b, len(data) + 1) for b in (BASE, pow(BASE, -1, 1 << 64)))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.powers[:len(data)], out=sums[1:])
        inside = 1 - self.blank[data]
        begins, ends = np.zeros(len(data) + 1, bool), np.zeros(len(data) + 1, bool)
        begins[:-1], ends[1:] = inside, inside
        apart = np.zeros(len(data) + 1, bool)
        apart[offsets] = True
        starts = np.flatnonzero(begins & (~ends | apart))
        stops = np.flatnonzero(ends & (~begins | apart))
        low, high = self.spans(starts, offsets[:-1], offsets[1:])
        hashes = (sums[stops] - sums[starts]) * self.inverses[starts]
        ditto = np.zeros(len(starts), bool)
        ditto[1:] = hashes[1:] == hashes[:-1]
        ditto[low[low < high]] = False
        words = self.buckets(sums, starts, stops, 1)
        words[ditto] = DITTO
        yield words, low, high
        for size in GRAMS:
            count = max(0, len(data) - size + 1)
            starts = np.arange(count)
            low = np.minimum(offsets[:-1], count)
            yield self.buckets(sums, starts, starts + size, size), low, np.clip(offsets[1:] - size + 1, low, count)

    def buckets(self, sums: np.ndarray, starts: np.ndarray, stops: np.ndarray, salt: int) -> np.ndarray:
        hashes = ((sums[stops] - sums[starts]) * self.inverses[starts] + np.uint64(salt)) * np.uint64(0xD6E8FEB86659FD93)
        hashes ^= hashes >> np.uint64(32)
        return ((hashes * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)

    @staticmethod
    def spans(starts: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.searchsorted(starts, low), np.searchsorted(starts, high)


@dataclass(frozen=True)
class QualityModel:
    """One number per bucket and a bias; the score is their logistic sum, the softmax of two classes."""

    weights: np.ndarray
    bias: float

    def scores(self, features: Features, texts: pa.Array) -> np.ndarray:
        totals, counts = np.zeros(len(texts)), np.zeros(len(texts))
        for buckets, low, high in features.of(texts):
            sums = np.concatenate([[0.0], np.cumsum(self.weights[buckets], dtype=np.float64)])
            totals += sums[high] - sums[low]
            counts += high - low
        return 1.0 / (1.0 + np.exp(-np.clip(totals / np.maximum(counts, 1.0) + self.bias, -700, 700)))


def learn(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE,
          dimensions: int = DIMENSIONS, seed: int = SEED) -> QualityModel:
    """Fit vectors and softmax weights to texts given as distinct buckets and their shares of the text."""
    used = np.unique(np.concatenate([b for b, _ in rows])) if rows else np.empty(0, np.int64)
    positive = (labels.sum() + 0.5) / (len(labels) + 1.0)
    weights = np.zeros(1 << BUCKET_BITS, np.float32)
    if len(np.unique(labels)) < 2 or not len(used):
        return QualityModel(weights, float(np.log(positive / (1 - positive))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dimensions, 1 / dimensions, (len(used), dimensions))
    output, bias = rng.normal(0, 0.1, (2, dimensions)), np.log([1 - positive, positive])
    places = [np.searchsorted(used, b) for b, _ in rows]
    steps, done = epochs * len(rows), 0
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            step = rate * (1 - done / steps)
            mine, share = vectors[places[i]], rows[i][1]
            hidden = share @ mine
            logits = output @ hidden + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[labels[i]] -= 1.0
            # The average dilutes a feature by the length of its text; its norm restores the step.
            vectors[places[i]] -= (step / (share @ share) ** 0.5) * np.outer(share, error @ output)
            output -= 0.1 * step * np.outer(error, hidden)
            bias -= 0.01 * step * error
            done += 1
    weights[used] = vectors @ (output[1] - output[0])
    return QualityModel(weights, float(bias[1] - bias[0]))


def text_features(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """Distinct buckets (INT) and their shares (FLOAT) of each labelled text, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for part in small_slices(batch):
                found = list(features.of(part.column(text)))
                packed, shares = [], []
                for row in range(part.num_rows):
                    own, times = np.unique(np.concatenate([b[low[row]:high[row]] for b, low, high in found]), return_counts=True)
                    packed.append(own.astype(np.int32).tobytes())
                    shares.append((times / max(1, times.sum())).astype(np.float32).tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("_order"), part.column(label).cast(pa.int32()), pa.array(packed, pa.binary()), pa.array(shares, pa.binary())],
                    names=["_order", "label", "buckets", "shares"])

    return labelled.select("_order", label, text).mapInArrow(run, "_order long, label int, buckets binary, shares binary")


def train_quality(documents: DataFrame, labels: DataFrame, label: str, allowed: Column, doc_id: str = "doc_id",
                  text: str = "text", max_texts: int = MAX_TEXTS) -> QualityModel:
    """Learn from at most ``max_texts`` labelled documents among those that ``allowed`` admits.

    The sample is the smallest hashes of the ids: the same rows wherever the tables are stored.
    """
    known = labels.where(F.col(label).isin(0, 1)).groupBy(doc_id).agg(F.min(label).alias(label)).where(allowed)
    order = F.xxhash64(F.col(doc_id).cast("string"))
    sample = known.where(F.col(doc_id).isNotNull()).select(doc_id, label, order.alias("_order")).orderBy("_order", doc_id).limit(max_texts)
    # At most max_texts narrow rows are broadcast; of repeated documents one text is used.
    chosen = documents.select(doc_id, F.coalesce(text, F.lit("")).alias(text)).join(F.broadcast(sample), doc_id) \
        .groupBy(doc_id, "_order", label).agg(F.min(text).alias(text))
    rows = text_features(chosen, text, label).toArrow().sort_by("_order")
    pairs = [(np.frombuffer(b, np.int32).astype(np.int64), np.frombuffer(s, np.float32).astype(np.float64))
             for b, s in zip(rows["buckets"].to_pylist(), rows["shares"].to_pylist())]
    return learn(pairs, rows["label"].to_numpy().astype(np.int64))


def with_quality(documents: DataFrame, model: QualityModel, text: str = "text", score: str = "score") -> DataFrame:
    """``documents`` with the probability of class 1 of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def work():
        features, same_model = Features(), QualityModel(*shared.value)
        return lambda part: [pa.array(same_model.scores(features, part.column(text)), pa.float64())]

    return add_columns(documents, {score: T.DoubleType()}, work)
