"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its words and their character n-grams, hashed into
a fixed table; a softmax over two classes reads it, and both are trained by stochastic gradient
descent in numpy. Training takes at most ``max_rows`` labelled rows, those of the smallest
hash of doc_id: executors turn their whole texts into bags of features, and the driver holds only
these, as 32-bit numbers. Scoring reads every whole text. Only the text is an input of a score.

Null and empty texts score as the mean of no vectors, i.e. by the bias. Without labelled rows every score
is 0.5. A doc_id with several labels has their least; repeated rows are scored each for itself, and of their
texts the least trains. A null doc_id is not held out and trains nothing. Ties of a score do not
matter, as each row has its own. Empty tables give no rows; extra columns are not read. A very long text is one
bag of its distinct features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small, stored, table
from .shingling import BYTE_BASE, WORD_BASE, _power, mixed

BUCKETS = 1 << 16
DIM = 16
THRESHOLD = 0.7
NGRAMS = (3, 4)
#: The bounded sample that is fitted: labelled rows, at most.
MAX_ROWS = 6_000
EPOCHS = 8
RATE = 0.5
#: A document's step is spread over its features; this scales it to that of a text of as many.
FEATURES = 50
#: Words whose features are made at once.
WORDS = 20_000


def features(words: list[str], buckets: int = BUCKETS) -> np.ndarray:
    """The hashed features of words, repeats counted: each word and the character n-grams of it
    between marks of its start and end. The marks are white space, which no word holds."""
    c = np.frombuffer(("\n" + " \n".join(words) + " ").encode("utf-32-le", "surrogatepass"), "u4").astype("u8")
    start, end = c == 10, c == 32
    first, last = np.flatnonzero(start) + 1, np.flatnonzero(end)
    sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(c * _power(BYTE_BASE, len(c))[: len(c)])])
    parts = [mixed((sums[last] - sums[first]) * _power(pow(BYTE_BASE, -1, 1 << 64), len(c))[first])]
    for n in NGRAMS:
        size = max(0, len(c) - n + 1)
        gram, inside = np.zeros(size, "u8"), np.ones(size, bool)
        for k in range(n):
            gram = gram * np.uint64(WORD_BASE) + c[k : k + size]
            if k:
                inside &= ~start[k : k + size] & ~end[k - 1 : k - 1 + size]
        parts.append(gram[inside])
    return (mixed(np.concatenate(parts)) % np.uint64(buckets)).astype("int64")


def slices(text: str) -> Iterator[list[str]]:
    words = text.split()
    for a in range(0, len(words), WORDS):
        yield words[a : a + WORDS]


def bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a whole text and their weights, which sum to 1."""
    parts = [np.unique(features(words), return_counts=True) for words in slices(text)]
    if not parts:
        return np.zeros(0, "int32"), np.zeros(0, "float32")
    ids, at = np.unique(np.concatenate([i for i, _ in parts]), return_inverse=True)
    weight = np.bincount(at, np.concatenate([n for _, n in parts]))
    return ids.astype("int32"), (weight / weight.sum()).astype("float32")


def train(bags: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, output weights, output bias) from (feature ids, weights, label) rows."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    out, bias = np.zeros((2, DIM)), np.zeros(2)
    steps, done = max(1, epochs * len(bags)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(bags)):
            ids, weight, y = bags[k]
            lr = rate * (1 - done / steps)
            done += 1
            mean = weight @ vectors[ids]
            z = out @ mean + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = p @ out
            out -= lr * np.outer(p, mean)
            bias -= lr * p
            vectors[ids] -= lr * FEATURES * np.outer(weight, back)
    return vectors.astype("float32"), out, bias


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS):
    """The model learnt from the labelled rows that are not held out."""
    marked = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = stored(marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "fitted-rows")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(small(chosen), "doc_id")
    rows = texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [bag(t) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["quality"].astype("int32"), "ids": [i.tobytes() for i, _ in made], "weights": [w.tobytes() for _, w in made]})

    bags = stored(rows.mapInPandas(run, "doc_id long, y int, ids binary, weights binary"), "bags")
    # Of max_rows rows, one partition at a time; only the arrays stay.
    return train([(np.frombuffer(bytes(r.ids), "int32"), np.frombuffer(bytes(r.weights), "float32"), r.y) for r in bags.orderBy("doc_id").toLocalIterator()])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def score(docs: DataFrame, model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(model)  # BUCKETS * DIM float32, 4 MB, whatever the input

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vectors, out, bias = shipped.value
        for batch in batches:
            scores = []
            for text in batch["text"]:
                total, n = np.zeros(DIM), 0
                for words in slices(text):
                    ids = features(words)
                    total += vectors[ids].sum(0, dtype="float64")
                    n += len(ids)
                z = out @ (total / max(n, 1)) + bias
                scores.append(1 / (1 + np.exp(z[0] - z[1])))
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "held_out": batch["held_out"], "score": scores})

    source = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    scored = source.mapInPandas(run, "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
