"""Quality classifier: supervised subword embeddings.

Every word has features: the word itself, its character n-grams, and one that says that
it repeats the word before, hashed into ``BUCKETS`` vectors. A document is the average of the vectors of all its features, its
label a softmax over a linear layer; vectors and layer are learned together by stochastic
gradient descent in numpy. It is trained on at most ``TRAIN_ROWS`` labelled rows, chosen
by a hash of the key, in one task; that bound also bounds the task.

Once learned, the layer's difference of the two labels is a number per bucket, and the
score of a document is the average of its features' numbers through a sigmoid: what tasks
hold is one array of ``BUCKETS`` numbers, and each distinct word is worked out once.

Defined cases: a null or empty text has no features and the score of the bias; texts are
used whole, in training too; equal rows are scored alike; rows with a null label or key
train nothing; without any labelled row every score is 0.5; an empty table gives no rows;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelgraph.llm.word_scores import WordSums, each_part, words_of

BUCKETS = 1 << 17
WIDTH = 16
GRAMS = (3, 4)
#: Bound of the labelled rows that train, and passes over them.
TRAIN_ROWS = 6_000
EPOCHS = 8
#: The bucket of "the word before once more".
AGAIN = BUCKETS
RATE = 0.4


@dataclass(frozen=True)
class Model:
    numbers: np.ndarray
    bias: float


def features(word: bytes) -> list[int]:
    """Buckets of a word and of its character n-grams with marks of both ends."""
    import xxhash

    marked = "<" + word.decode("utf-8", "replace") + ">"
    grams = [marked[i:i + n] for n in GRAMS for i in range(len(marked) - n + 1)]
    return [xxhash.xxh32_intdigest(g) % BUCKETS for g in (marked, *grams)]


def _bag(text: str | None, known: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    words, parts = words_of(text), []
    for word in words:
        if word not in known:
            known[word] = np.asarray(features(word), np.int32)
        parts.append(known[word])
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    again = sum(a == b for a, b in zip(words, words[1:], strict=False))
    parts.append(np.full(again, AGAIN, np.int32))
    buckets, counts = np.unique(np.concatenate(parts), return_counts=True)
    return buckets, counts / counts.sum()


def descend(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 7) -> Model:
    """Stochastic gradient descent over documents, the rate falling to nothing."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS + 1, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, EPOCHS * len(bags)), 0
    for _ in range(EPOCHS):
        for k in draw.permutation(len(bags)):
            rate = RATE * (1 - done / steps)
            done += 1
            buckets, shares = bags[k]
            hidden = shares @ vectors[buckets] if len(buckets) else np.zeros(WIDTH)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[k]] -= 1
            if len(buckets):
                # The average spreads a step over all features: undone by the least share's inverse.
                vectors[buckets] -= (rate * min(len(buckets), 50)) * np.outer(shares, p @ layer)
            layer -= rate * np.outer(p, hidden)
            bias -= rate * p
    return Model(vectors @ (layer[1] - layer[0]), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Model from ``docs`` (key, text) and ``labels`` (key, label)."""
    good = labels.where("key is not null and label in (0, 1)").select("key", F.col("label").cast("int"))
    part = min(1.0, rows / max(1, good.count()))
    place = F.pmod(F.xxhash64("key", F.lit("train")), F.lit(1 << 30))
    chosen = good.where(place < F.lit(int(part * (1 << 30)))).limit(2 * rows)
    # At most 2 * rows pairs of numbers by the limit above.
    sample = docs.select("key", "text").join(F.broadcast(chosen), "key")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "text"], kind="stable")
        known: dict[bytes, np.ndarray] = {}
        bags = [_bag(t if isinstance(t, str) else None, known) for t in frame["text"]]
        model = descend(bags, frame["label"].to_numpy())
        return pd.DataFrame({"numbers": [model.numbers.astype("<f4").tobytes()], "bias": [model.bias]})

    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "numbers binary, bias double").collect()
    if not found:
        return Model(np.zeros(BUCKETS + 1, np.float32), 0.0)
    return Model(np.frombuffer(bytes(found[0]["numbers"]), "<f4"), found[0]["bias"])


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, score): 0 to 1, higher where label 1 is likelier."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bias = shared.value.numbers, shared.value.bias

        def value(words: list[bytes]) -> np.ndarray:
            cells = [features(w) for w in words]
            sizes = np.fromiter(map(len, cells), np.int64, len(cells))
            flat = np.fromiter((c for x in cells for c in x), np.int64, int(sizes.sum()))
            sums = np.add.reduceat(numbers[flat].astype(np.float64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            return np.stack([sums, sizes], axis=1)

        totals = WordSums(value, 2)
        for part in each_part(batches):
            sums = totals.sums(part.column(1).to_pylist())
            total = sums[:, 2] + sums[:, 1] * float(numbers[AGAIN])
            logit = total / np.maximum(sums[:, 3] + sums[:, 1], 1) + bias
            result = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(result)], names=["doc_id", "score"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, score double")
