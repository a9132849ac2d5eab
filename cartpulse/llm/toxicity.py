"""Toxicity by character n-grams and naive Bayes log-count ratios.

Wang and Manning's NBSVM: binary features (which character n-grams a text has,
hashed) are scaled by the log-count ratio of their document counts in the two
classes, and a linear classifier (logistic loss, L2) is trained on them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.langid import held_out

ORDERS = (3, 4, 5)
BITS = 19
THRESHOLD = 0.3
# The training sample: at most so many labelled rows a class reach the driver; longer texts are left out of it (not cut).
TRAIN_ROWS = 800
TRAIN_CHARS = 8_000
MIN_DOCS = 3  # an n-gram in fewer training documents has no ratio
MIN_RATIO = 0.4  # n-grams about as common in both classes carry no weight
PIECE = 1 << 16  # characters hashed at once

_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def features(text: str, last: np.ndarray) -> np.ndarray:
    """Distinct hashed n-grams of the whole text.  ``last``: a scratch array of 2**BITS int32 of any values."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), dtype="<u4")
    found = []
    for at in range(0, len(codes), PIECE):
        part = codes[at : at + PIECE + max(ORDERS) - 1]
        rolling = part.copy()
        for n in range(2, max(ORDERS) + 1):
            if len(rolling) < 2:
                break
            rolling = (rolling[:-1] * _STEP) ^ part[n - 1 :]
            if n in ORDERS:
                found.append(((rolling + np.uint32(n)) * _MIX >> np.uint32(32 - BITS)).astype(np.int32))
    if not found:
        return np.zeros(0, dtype=np.int32)
    slots = np.concatenate(found)
    # each slot once: the place that was noted last stands for it
    places = np.arange(len(slots), dtype=np.int32)
    last[slots] = places
    return slots[last[slots] == places]


class Model:
    """Weights by slot and an intercept."""

    def __init__(self, weights: np.ndarray, intercept: float):
        self.weights, self.intercept = weights.astype(np.float32), float(intercept)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        last = np.zeros(1 << BITS, dtype=np.int32)
        raw = np.empty(len(texts))
        for i, text in enumerate(texts):
            raw[i] = self.weights[features(text or "", last)].sum(dtype=np.float64)
        return 1.0 / (1.0 + np.exp(-np.clip(raw + self.intercept, -30, 30)))


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, rounds: int = 120, l2: float = 1e-3) -> Model:
    """Ratios, then logistic regression on the scaled features by Nesterov's gradient steps.

    ``prior``: share of label 1 among all labelled rows; the intercept is moved from the sample's share to it.
    """
    width = 1 << BITS
    labels = labels.astype(float)
    if not len(rows) or labels.min() == labels.max():
        p = min(max(prior, 1e-3), 1 - 1e-3)
        return Model(np.zeros(width), float(np.log(p / (1 - p))))
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    slot = np.concatenate(rows)
    positive = np.bincount(slot[labels[at] == 1], minlength=width) + 1.0
    negative = np.bincount(slot[labels[at] == 0], minlength=width) + 1.0
    docs = positive + negative - 2
    n1, n0 = labels.sum(), (1 - labels).sum()
    ratio = np.log((positive / (n1 + 2)) / (negative / (n0 + 2)))
    ratio[docs < MIN_DOCS] = 0
    used = np.abs(ratio[slot]) > MIN_RATIO
    at, slot = at[used], slot[used]
    names, slot = np.unique(slot, return_inverse=True)
    scale = ratio[names]
    value = scale[slot]
    n = len(rows)
    lipschitz = 0.25 * (np.bincount(at, weights=value**2, minlength=n).max() + 1)
    step = 1.0 / (lipschitz + l2)
    w, b = np.zeros(len(names)), 0.0
    w_past, b_past = w, b
    balance = np.where(labels == 1, 0.5 / n1, 0.5 / n0)
    for k in range(rounds):
        m = k / (k + 3)
        wy, by = w + m * (w - w_past), b + m * (b - b_past)
        z = np.bincount(at, weights=value * wy[slot], minlength=n) + by
        error = balance * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels)
        gradient = np.bincount(slot, weights=value * error[at], minlength=len(names)) + l2 * wy / n
        w_past, b_past = w, b
        w, b = wy - step * gradient * n * 0.5, by - step * error.sum() * n * 0.5
    weights = np.zeros(width)
    weights[names] = w * scale
    p = min(max(prior, 1e-3), 1 - 1e-3)
    return Model(weights, b + np.log(p / (1 - p)))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Learn from labelled rows that aren't held out, on a sample of at most ``TRAIN_ROWS`` a class.

    The rows are chosen by a hash of the key with thresholds from exact counts over all labels; n-grams are
    hashed by the tasks, and the driver gets their slots only.
    """
    marked = (
        labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y"))
        .filter(F.col("k").isNotNull() & F.col("y").isin(0, 1) & ~held_out("k"))
    )
    counts = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return fit([], np.zeros(0), 0.5)
    prior = counts.get(1, 0) / sum(counts.values())
    share = F.create_map(*(F.lit(x) for y, n in sorted(counts.items()) for x in (y, min(1 << 30, int((1 << 30) * TRAIN_ROWS * 0.9 / n) + 1))))
    chosen = (
        marked.filter(F.pmod(F.xxhash64("k", F.lit(11)), F.lit(1 << 30)) < share[F.col("y")])
        .groupBy("k").agg(F.max("y").alias("y"))
        .limit(2 * TRAIN_ROWS)
    )
    sample = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).filter(F.length("t") <= TRAIN_CHARS).join(F.broadcast(chosen), "k")

    def slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = np.zeros(1 << BITS, dtype=np.int32)
        for batch in batches:
            yield pd.DataFrame({"k": batch["k"], "y": batch["y"], "s": [features(t or "", last).tobytes() for t in batch["t"]]})

    kind = docs.schema[key].dataType.simpleString()
    rows = sample.mapInPandas(slots, f"k {kind}, y int, s binary").groupBy("k").agg(F.min(F.struct("y", "s")).alias("x")).select("k", "x.y", "x.s").limit(2 * TRAIN_ROWS).collect()
    rows.sort(key=lambda r: r["k"])
    return fit([np.frombuffer(r["s"], dtype=np.int32) for r in rows], np.array([r["y"] for r in rows]), prior)


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per row of ``docs``: ``keep`` columns, score (0 to 1), predicted (score >= ``THRESHOLD``).

    Only the text is looked at, and all of it.  A null text counts as an empty one: it gets the score of the intercept.
    """

    @F.pandas_udf("double")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(model.scores(batch.tolist()))

    return docs.select(*(F.col(c) for c in keep), of(F.col(text)).alias("score")).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
