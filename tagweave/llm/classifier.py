"""Quality classifier: hashed word n-grams, logistic regression trained with follow-the-regularised-leader.

Four families of features are hashed into one weight vector: words, word pairs, word shapes (``Aa.`` for
``House.``, ``A!!`` for ``LOUD!!``) and pairs of shapes (a word said twice in a row is a pair of its own). A feature's value is its share of the family's
n-grams, times a constant, so a score is a sparse dot product of shares and weights and doesn't depend on length.

Training reads a bounded sample of labelled rows (``train_rows`` rows of at most ``train_chars`` characters)
in one executor task; only the weight vector (4 bytes x 2^bits) travels. Scoring reads whole texts.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import id_text, kept, table, words

BITS, SCALE = 18, 20.0
SEED = {"word": 0x9E3779B97F4A7C15, "pair": 0xC2B2AE3D27D4EB4F}


def shape(word: bytes) -> bytes:
    """Runs of upper case, lower case, digits and each mark, collapsed to one sign each."""
    text = re.sub(r"[^\W\d_]", lambda m: "A" if m[0].isupper() else "a", word.decode("utf-8", "replace"))
    return re.sub(r"(.)\1{2,}", r"\1\1", re.sub(r"([Aa0])\1+", r"\1", re.sub(r"\d", "0", text))).encode()[:24]


class Hasher:
    """Word -> hashes of the word and of its shape, memoised up to a bound."""

    def __init__(self, most: int = 400_000):
        self.most, self.memo = most, {}

    def __call__(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        memo = self.memo
        missing = {w for w in tokens if w not in memo}
        if missing:
            if len(memo) + len(missing) > self.most:
                memo.clear()
                missing = set(tokens)
            for w in missing:
                memo[w] = zlib.crc32(w.lower()) << 32 | zlib.crc32(shape(w), 7)
        both = np.fromiter(map(memo.__getitem__, tokens), np.uint64, len(tokens))
        return both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)


def families(tokens: list[bytes], hasher: Hasher, bits: int = BITS) -> list[np.ndarray]:
    """Indices of the n-grams of each family."""
    if not tokens:
        return []
    drop = np.uint64(64 - bits)
    found = []
    hashes = hasher(tokens)
    again = hashes[0][:-1] == hashes[0][1:]
    for kind, h in enumerate(hashes):
        a = h * np.uint64(SEED["word"]) + np.uint64(kind)
        found.append(a * np.uint64(SEED["pair"]) >> drop)
        if len(h) > 1:
            pair = a[:-1] * np.uint64(3) + a[1:] * np.uint64(5) + np.uint64(7)
            if kind:
                pair = np.where(again, np.uint64(11), pair)
            found.append(pair * np.uint64(SEED["pair"]) >> drop)
    return [x.astype(np.int64) for x in found]


def shares(text: str | None, hasher: Hasher, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    parts = families(words(text), hasher, bits)
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    at, inverse = np.unique(np.concatenate(parts), return_inverse=True)
    weights = np.concatenate([np.full(len(p), SCALE / len(p)) for p in parts])
    return at, np.bincount(inverse, weights)


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


class Ftrl:
    """Per-coordinate FTRL-Proximal; the last coordinate is the bias."""

    def __init__(self, bits: int = BITS, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) > self.l1, w, 0.0)

    def update(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def trained(rows: list[tuple[str | None, int]], epochs: int = 4, bits: int = BITS) -> np.ndarray:
    hasher, model = Hasher(), Ftrl(bits)
    held = [(*shares(t, hasher, bits), y) for t, y in rows]
    for _ in range(epochs):
        for at, x, y in held:
            model.update(at, x, y)
    return model.weights(slice(None)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_rows: int = 6000, train_chars: int = 20_000, fold: int = 5) -> np.ndarray:
    """Weights from labelled rows whose crc32(doc_id as text) mod ``fold`` isn't 0: the ``train_rows`` with the
    smallest id hashes among them, without null labels and texts over ``train_chars``. An id with labels of both
    kinds counts as 0; of rows that share an id each is learnt. No rows: zero weights."""
    usable = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % fold != 0))
    chosen = usable.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id")).limit(train_rows)
    inner = id_text(docs)
    rows = inner.join(F.broadcast(chosen), "doc_id").where(F.char_length(F.coalesce("text", F.lit(""))) <= train_chars)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = sorted((zlib.crc32(str(d).encode()), d, t or "", y) for b in batches for d, t, y in zip(*(b.column(i).to_pylist() for i in range(3))))
        yield pa.RecordBatch.from_arrays([pa.array([trained([x[2:] for x in held]).tobytes()], pa.binary())], names=["w"])

    return np.frombuffer(rows.select("doc_id", "text", "y").repartition(1).mapInArrow(run, "w binary").first()[0], np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Defined cases: null, empty and wordless texts get the score of the bias alone; repeated rows are scored
    each; null ids stay null; an empty table gives no rows; further columns are never read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        bits, hasher = (len(w) - 1).bit_length() - 1, kept("hasher", Hasher)
        for batch in batches:
            scores = []
            for i in range(0, batch.num_rows, 256):
                for t in batch.column(1).slice(i, 256).to_pylist():
                    parts = families(words(t), hasher, bits)
                    scores.append(sigmoid(float(w[-1]) + SCALE * sum(float(w[p].mean(dtype=np.float64)) for p in parts)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "score", "predicted"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, score double, predicted int")


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns kept, without a join."""
    from ..shipping import ship

    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    where = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        bits, hasher = (len(w) - 1).bit_length() - 1, kept("hasher", Hasher)
        for batch in batches:
            keep = []
            for i in range(0, batch.num_rows, 256):
                for t in batch.column(where).slice(i, 256).to_pylist():
                    parts = families(words(t), hasher, bits)
                    keep.append(sigmoid(float(w[-1]) + SCALE * sum(float(w[p].mean(dtype=np.float64)) for p in parts)) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = score(docs, train(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return found.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_quality_classifier": op6_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
