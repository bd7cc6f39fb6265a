"""Quality classification: logistic regression on hashed word n-grams.

Features are the words, word pairs, and the shapes of words and pairs of shapes
(upper case, digits, a run of one symbol, a repeated word ...) of a whole text,
hashed to 2**18 weights with values by share of the text. Training follows the
regularised leader for each coordinate (FTRL-proximal) over a bounded sample of labelled
documents; a score is the logistic of a sparse dot product.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 18
#: Labelled documents to learn from, about so many at most, chosen by a hash of the id.
TRAIN_DOCS = 12_000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 1e-4, 1e-4
TOKENS = re.compile(r"\w+|[^\w\s]+")
SHAPES = ["first", "same", "lower", "title", "upper", "digits", "mixed", "symbol", "symbols"]
#: Words whose hashes a task remembers at once.
CACHE = 1 << 18


def word_hash(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass"))


def shape(word: str) -> int:
    if not (word[0].isalnum() or word[0] == "_"):
        kind = "symbol" if len(word) == 1 else "symbols"
    elif word.isdigit():
        kind = "digits"
    elif word.islower():
        kind = "lower"
    elif word.istitle():
        kind = "title"
    elif word.isupper():
        kind = "upper"
    else:
        kind = "mixed"
    return SHAPES.index(kind)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (x >> np.uint64(64 - BITS)).astype(np.int64)


class Hasher:
    """Word hashes and shapes, remembered for frequent words."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def codes(self, words: list[str]) -> np.ndarray:
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = []
        for w in words:
            code = known.get(w)
            if code is None:
                code = known[w] = word_hash(w) << 4 | shape(w)
            out.append(code)
        return np.array(out, np.uint64)

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Distinct weight indices and values; the last index, 2**BITS, is the bias."""
        codes = self.codes(TOKENS.findall(text or ""))
        words, shapes = codes >> np.uint64(4), codes & np.uint64(15)
        shapes[1:][words[1:] == words[:-1]] = SHAPES.index("same")
        before = np.concatenate([[np.uint64(0)], shapes[:-1]]) if len(shapes) else shapes
        one, two = np.uint64(1 << 40), np.uint64(2 << 40)
        parts = [
            _mix(words),
            _mix(one | words[:-1] * np.uint64(31) ^ words[1:]) if len(words) else words.astype(np.int64),
            _mix(two | shapes),
            _mix(two | before << np.uint64(4) | shapes | np.uint64(1 << 30)),
        ]
        found, n = np.unique(np.concatenate(parts), return_counts=True)
        return np.append(found, 1 << BITS), np.append(n / max(1, len(codes)), 1.0)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS) -> np.ndarray:
    """Weights after ``epochs`` passes over (indices, values, label) in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(at) -> np.ndarray:
        big = np.abs(z[at]) > L1
        return np.where(big, -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(epochs):
        for at, x, label in rows:
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - label) * x
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    return weights(slice(None))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = Hasher()
    for batch in batches:
        at, x = [], []
        for text in batch.column("text").to_pylist():
            found, values = hasher.features(text)
            at.append(found.astype("<i4").tobytes())
            x.append(values.astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([batch.column("order"), batch.column("label"), pa.array(at), pa.array(x)], ["order", "label", "at", "x"])


def _learn(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for r in batch.to_pylist():
                rows.append((np.frombuffer(r["at"], "<i4"), np.frombuffer(r["x"], "<f4").astype(np.float64), r["label"]))
        if rows:
            yield pa.RecordBatch.from_pydict({"w": [ftrl(rows, epochs).astype("<f8").tobytes()]})

    return run


def fit(docs: DataFrame, labels: DataFrame, label_col: str, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights learned from the documents that ``labels`` marks 0 or 1.

    About ``train_docs`` labelled rows at most, so that one task can take the updates
    in order of a hash of the id. Null labels and ids are left out. Without any
    label all weights are 0.
    """
    marked = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("__id"), F.col(label_col).cast("long").alias("label"))
    marked = marked.where(F.col("__id").isNotNull()).withColumn("order", F.xxhash64("__id", F.lit(6)))
    share = min(1.0, train_docs / max(1, marked.count()))
    sample = marked.where(F.pmod("order", F.lit(1 << 20)) < int(share * (1 << 20)))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(sample, "__id")
    features = rows.select("order", "label", "text").mapInArrow(_featurise, "order long, label long, at binary, x binary")
    learned = features.repartition(1).sortWithinPartitions("order", "label", "at").mapInArrow(_learn(epochs), "w binary").first()
    return np.frombuffer(bytes(learned["w"]), "<f8") if learned else np.zeros((1 << BITS) + 1)


def score(docs: DataFrame, weights: np.ndarray, text_col: str = "text", name: str = "score") -> DataFrame:
    """Adds ``name`` (replacing a column so named): the probability of label 1 of each whole
    text; a null or empty text gets that of the bias alone."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w, hasher = shared.value, Hasher()
        for texts in batches:
            out = np.empty(len(texts))
            for i, text in enumerate(texts):
                at, x = hasher.features(text)
                out[i] = w[at] @ x
            yield pd.Series(1 / (1 + np.exp(-np.clip(out, -35, 35))))

    return docs.withColumn(name, probability.asNondeterministic()(F.col(text_col)))
