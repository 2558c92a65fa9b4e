"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Tokens are words and runs of punctuation in their own case; features are the hashes of tokens and of adjacent pairs (a token
repeated is one pair whatever the token), each worth 1 / sqrt(number of features), so a score is one sparse dot product with the weights. ``train`` takes at most
``max_rows`` labelled rows (the bound of the sample, chosen by hash of the id), deals them into ``shards`` groups that learn side
by side in tasks, and averages their weights; the model has ``2 ** bits`` weights whatever the input. ``score`` runs over
whole texts in tasks and looks at nothing but the text.

Defined results: null and empty texts score the bias alone; null ids and null labels teach nothing; of several labels of an id the
largest holds; repeated rows are scored each; without labelled rows all weights are 0 and every score 0.5. Further columns are ignored by
``scores`` and kept by ``keep_good``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Tokens whose hashes a task remembers at most.
MEMO = 300_000
#: The pair of a token with itself has one hash for all tokens.
REPEAT = np.uint32(0x5EED)


class Hasher:
    """Token hashes, remembered for the tokens of a task up to a bound."""

    def __init__(self, bits: int):
        self.mask, self.known = np.uint32((1 << bits) - 1), {}

    def features(self, text: str) -> np.ndarray:
        known = self.known
        if len(known) > MEMO:
            known.clear()
        tokens = TOKEN.findall(text)
        try:
            h = np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))
        except KeyError:
            for t in set(tokens).difference(known):
                known[t] = zlib.crc32(t.encode("utf-8", "surrogatepass"))
            h = np.fromiter(map(known.__getitem__, tokens), np.uint32, len(tokens))
        mixed = h[:-1] * np.uint32(2654435761) ^ (h[1:] * np.uint32(40503) + np.uint32(0x9E3779B9))
        mixed ^= mixed >> np.uint32(15)
        mixed[h[:-1] == h[1:]] = REPEAT
        return np.concatenate([h, mixed]) & self.mask


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """Weights after ``epochs`` passes; the last entry is the bias."""
    size = (1 << bits) + 1
    z, n = np.zeros(size), np.zeros(size)

    def weights(at):
        zi = z[at]
        w = -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2)
        return np.where(np.abs(zi) > l1, w, 0.0)

    for _ in range(epochs):
        for features, label in rows:
            at, counts = np.unique(features, return_counts=True)
            at = np.append(at.astype(np.int64), size - 1)
            x = np.append(counts / np.sqrt(max(len(features), 1)), 1.0)
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return weights(np.arange(size))


def train(docs: DataFrame, labels: DataFrame, bits: int = 18, max_rows: int = 12_000, shards: int = 4, epochs: int = 3, alpha: float = 0.3,
          beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality") -> np.ndarray:
    """Weights learnt from ``labels`` rows that have a document. The caller leaves out the rows to be held out."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null") \
        .groupBy("id").agg(F.max("label").alias("label"))
    total = known.count()
    draw = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(1 << 30))
    known = known.withColumn("draw", draw)
    if total > max_rows:
        known = known.where(F.col("draw") < int((1 << 30) * (max_rows / total)))
    # the sample's size is bounded by max_rows, so it may be broadcast; orderBy-limit keeps the bound exact
    known = known.orderBy("draw", "id").limit(max_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")) \
        .join(F.broadcast(known), "id").withColumn("shard", (F.col("draw") % shards).cast("int"))

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        hasher = Hasher(bits)
        rows = rows.sort_values(["draw", "id"])
        ready = [(hasher.features(t), int(y)) for t, y in zip(rows["text"], rows["label"])]
        return pd.DataFrame({"n": [len(ready)], "weights": [ftrl(ready, bits, epochs, alpha, beta, l1, l2).astype("<f4").tobytes()]})

    learnt = rows.groupBy("shard").applyInPandas(learn, "n long, weights binary").collect()  # at most `shards` models of fixed size
    if not learnt:
        return np.zeros((1 << bits) + 1, "f4")
    return np.average([np.frombuffer(r["weights"], "<f4") for r in learnt], axis=0, weights=[r["n"] for r in learnt]).astype("f4")


def _score(features: np.ndarray, weights: np.ndarray) -> float:
    """The sparse dot product, squashed."""
    margin = weights[features].sum(dtype=np.float64) / np.sqrt(max(len(features), 1)) + weights[-1]
    return float(1 / (1 + np.exp(-np.clip(margin, -35, 35))))


def scores(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score`` of every row."""
    bits = int(len(weights) - 1).bit_length() - 1

    def tasks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = Hasher(bits)
        for batch in batches:
            yield batch[["id"]].assign(score=[_score(hasher.features(text), weights) for text in batch["text"]])

    # ids pass through Python as text: a nullable number would come back rounded
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(tasks, "id string, score double").withColumn("id", F.col("id").cast(docs.schema[id_col].dataType))


def held_out(c: Column) -> Column:
    """Rows whose labels teach nothing: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(c.cast("string")) % 5 == 0, F.lit(False))


def keep_good(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, with all their columns, scored where they are: no row is shuffled."""
    bits = int(len(weights) - 1).bit_length() - 1

    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        hasher = Hasher(bits)
        for batch in texts:
            yield pd.Series([_score(hasher.features(text), weights) for text in batch], dtype="float64")

    column = F.pandas_udf(score, T.DoubleType())(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return docs.where(column >= threshold)
