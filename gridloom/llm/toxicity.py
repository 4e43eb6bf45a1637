"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The model is fitted in one task on a bounded sample of whole labelled texts (of
each class ``SAMPLE`` rows at most, and no further row once these hold
``SAMPLE_BYTES``), and its intercept is moved to the class balance of all
labelled rows. L1 leaves few weights, which are sent to all workers; every whole
text is then scored in one narrow pass.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import documents, keep_rows, release
from .text import chunks, words

#: Labelled rows of each class that the model is fitted on, those with the least hash of doc_id.
SAMPLE = 4_000
#: Bytes of text of each class after which no further row is taken; the order has nothing to do with length, so long texts are learned from like short ones.
SAMPLE_BYTES = 32 << 20
ALPHA, BETA, L2, EPOCHS = 2.0, 1.0, 0.01, 8
#: L1 is the least value and this share of the positive examples, which must ask for a weight.
L1_SHARE, L1_LEAST = 0.01, 2.5
_KINDS = tuple(np.uint64(x) for x in (0x8F1BBCDCBFA53E0B, 0xC2B2AE3D27D4EB4F, 0x27D4EB2F165667C5, 0x165667B19E3779F9))


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of words, word pairs and pairs with one word skipped, and the text of each."""
    h, _, _, at = words(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    a, b, c, d = _KINDS
    pair, skip = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    top = lambda x: (x ^ (x >> np.uint64(29))) * a >> np.uint64(32)
    found = [top(h), top(h[:-1] * b + h[1:])[pair], top(h[:-2] * c + h[2:] * d)[skip]]
    return np.concatenate(found).astype(np.uint32), np.concatenate([doc, doc[1:][pair], doc[2:][skip]])


@dataclass
class Model:
    bias: float
    keys: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._seen = np.zeros(1 << 20, bool)
        self._seen[self.keys & np.uint32((1 << 20) - 1)] = True

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability of each text; a feature counts once however often it occurs."""
        total = np.full(len(offsets) - 1, self.bias)
        if len(self.keys):
            h, doc = features(data, offsets)
            may = np.flatnonzero(self._seen[h & np.uint32((1 << 20) - 1)])
            h, doc = h[may], doc[may]
            at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            hit = self.keys[at] == h
            once = np.unique(doc[hit] * len(self.keys) + at[hit])
            total += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def ftrl(examples: list[np.ndarray], labels: np.ndarray, size: int, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float | None = None, l2: float = L2) -> tuple[float, np.ndarray]:
    """Bias and weights after passes over examples of distinct feature numbers, each with value 1."""
    z, root = np.zeros(size), np.zeros(size)  # root: of the coordinate's sum of squared gradients
    l1 = L1_LEAST + L1_SHARE * float(labels.sum()) if l1 is None else l1
    bias, grown = 0.0, 0.0

    def weight(z, root):
        return -(z - np.sign(z) * l1) / ((beta + root) / alpha + l2)

    for _ in range(epochs):
        for x, y in zip(examples, labels):
            zx, rx = z[x], root[x]
            some = np.flatnonzero(np.abs(zx) > l1)  # the others' weights are 0
            w = weight(zx[some], rx[some])
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + w.sum()))))
            g = p - y
            after = np.sqrt(rx * rx + g * g)
            zx += g
            zx[some] -= (after[some] - rx[some]) / alpha * w
            z[x], root[x] = zx, after
            grown += g * g
            bias -= alpha / (beta + math.sqrt(grown)) * g
    return bias, np.where(np.abs(z) <= l1, 0.0, weight(z, root))


def _fit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task: ordered rows (doc_id, toxic, size, features) to rows (key, weight); key null is the bias, -1 and -2 are the rows of class 0 and 1 learned from."""
    rows, labels, held = [], [], [0, 0]
    for batch in batches:
        for y, n, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
            if held[y] < SAMPLE_BYTES:
                held[y] += n
                labels.append(y)
                rows.append(np.frombuffer(x.as_buffer().to_pybytes(), np.uint32))
    if rows:
        every = np.concatenate(rows)
        every.sort()
        again = every[1:][every[1:] == every[:-1]]  # a feature of one example can't tell about others
        keys = again[np.r_[True, again[1:] != again[:-1]]] if len(again) else again
        del every, again
        for k, x in enumerate(rows):
            at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1)).astype(np.int32)
            rows[k] = at[keys[at] == x] if len(keys) else at[:0]
        bias, weights = ftrl(rows, np.array(labels, float), len(keys))
        some = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array([None, -1, -2, *keys[some].tolist()], pa.int64()), pa.array([bias, labels.count(0), labels.count(1), *weights[some].tolist()], pa.float64())], ["key", "weight"])
        del rows
        release()


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in chunks(batch.column(3)):
            h, doc = features(data, offsets)
            own = np.unique(doc.astype(np.uint64) << np.uint64(32) | h)
            at = np.searchsorted(own, np.arange(b - a + 1).astype(np.uint64) << np.uint64(32))
            lists = [own[i:j].astype(np.uint32).tobytes() for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(k)[a:b] for k in range(3)), pa.array(lists, pa.binary())], ["doc_id", "toxic", "size", "features"])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the texts of ``docs`` that ``labels`` (doc_id, toxic 0 or 1) marks.

    Rows with null id or label are left out; of several labels of an id the
    largest holds. Without both classes the score is constant: the share of the
    class there is, or 0 without labels.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return Model(50.0 if 1 in n else -50.0, np.zeros(0, np.uint32), np.zeros(0))
    pick = lambda y: marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    chosen = pick(0).unionByName(pick(1))
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")  # at most 2 * SAMPLE rows are sent
    sized = texts.select("doc_id", "toxic", F.octet_length("text").cast("long").alias("size"), "text")
    found = (
        sized.mapInArrow(_extract, "doc_id long, toxic int, size long, features binary")
        .repartition(1).sortWithinPartitions(F.xxhash64("doc_id"), "doc_id", "features")
        .mapInArrow(_fit_rows, "key long, weight double").collect()
    )
    of = {r.key: r.weight for r in found}
    used = [of.get(-1, 0), of.get(-2, 0)]
    if not all(used):
        return Model(math.log(n[1] / n[0]), np.zeros(0, np.uint32), np.zeros(0))
    keys = sorted(k for k in of if k is not None and k >= 0)
    shift = math.log(n[1] / n[0]) - math.log(used[1] / used[0])
    return Model(of[None] + shift, np.array(keys, np.uint32), np.array([of[k] for k in keys], float))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns; null and empty texts have the model's prior."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.keys, model.weights))

    def make():
        own = Model(*held.value)
        return lambda column: np.concatenate([np.zeros(0, bool), *(own.scores(data, offsets) < threshold for _, _, data, offsets in chunks(column))])

    return keep_rows(docs, make)


def held_out(column: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 5 == 0, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of each row of ``docs``; null and empty texts get the model's prior."""
    held = docs.sparkSession.sparkContext.broadcast((model.bias, model.keys, model.weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*held.value)
        for batch in batches:
            found = [own.scores(data, offsets) for _, _, data, offsets in chunks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate([np.zeros(0), *found]))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
