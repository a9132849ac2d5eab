"""Document quality by co-training (Blum and Mitchell): a text view and a page-metadata view.

Each view has a logistic classifier.  In every round each labels a pool of unlabelled
documents, and those it is most confident of become training rows of the other view.  At the end both are
calibrated on labelled rows kept apart for it, and a logistic combination of the calibrated views scores all documents.
Samples that reach the driver are bounded (``TRAIN_ROWS``, ``POOL_ROWS``) and hold short feature vectors, not texts.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.langid import held_out

TRAIN_ROWS = 3000  # labelled rows
POOL_ROWS = 6000  # unlabelled rows
ROUNDS = 6
EXCHANGED = 150  # pseudo-labels that a view hands over a round
THRESHOLD = 0.5
SOURCES = 32  # slots for hashed sources

_UPPER = bytes(range(65, 91))


def text_view(text: str | None) -> list[float]:
    """Shape of the whole text: repetition, symbols, case, words, lines."""
    text = text or ""
    n = max(len(text), 1)
    words = text.split()
    m = max(len(words), 1)
    counts = Counter(words)
    raw = text.encode("utf-8", "surrogatepass")
    lines = text.split("\n")
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.log1p(m),
        len(counts) / m,
        math.log(len(counts) + 1) / math.log(m + 1) if m > 1 else 1.0,
        max(counts.values(), default=0) / m,
        runs / m,
        sum(map(text.count, "*#%&$")) / n,
        text.count("!") / n,
        text.count("|") / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / n,
        sum(map(text.count, "0123456789")) / n,
        text.count(".") / m,
        min(n / m, 30.0) / 10,
        len(set(lines)) / len(lines),
        text.count("<") / n,
        text.count("{") / n,
    ]


def metadata_view(source: str | None, lang: str | None, n_chars: float | None) -> list[float]:
    """What is known of a page without its text: source and language (hashed), length on record."""
    size = math.log1p(max(n_chars, 0)) if n_chars is not None and n_chars == n_chars else 0.0
    slots = [0.0] * (SOURCES + 8)
    slots[zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    slots[SOURCES + zlib.crc32((lang or "").encode()) % 8] = 1.0
    return [size / 10, (size / 10) ** 2, float(n_chars is None), *slots]


class Logistic:
    """L2 logistic regression on standardised features, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, l2: float = 1.0, rounds: int = 15):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._design(x)
        self.w = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = _sigmoid(z @ self.w)
            step = z.T @ (p - y) + l2 * self.w
            curve = (z * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ z + l2 * np.eye(len(self.w))
            self.w -= np.linalg.solve(curve, step)

    def _design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([z, np.ones((len(z), 1))])

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self._design(x) @ self.w, -20, 20)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Model:
    """The two views and their calibrated combination; a constant if the labels have one class only."""

    def __init__(self, views: list[Logistic], scales: list[Logistic], both: Logistic | None, constant: float):
        self.views, self.scales, self.both, self.constant = views, scales, both, constant

    def calibrated(self, xs: list[np.ndarray]) -> np.ndarray:
        return np.column_stack([s.logit(v.logit(x)[:, None]) for v, s, x in zip(self.views, self.scales, xs, strict=True)])

    def scores(self, xs: list[np.ndarray]) -> np.ndarray:
        if self.both is None:
            return np.full(len(xs[0]), self.constant)
        return _sigmoid(self.both.logit(self.calibrated(xs)))


def co_train(labelled: list[np.ndarray], y: np.ndarray, pool: list[np.ndarray], rounds: int = ROUNDS, exchanged: int = EXCHANGED) -> Model:
    """``labelled`` and ``pool``: one matrix per view.  Every fourth labelled row is kept for calibration."""
    apart = np.arange(len(y)) % 4 == 3
    if len(y) < 8 or min(y[~apart].min(), y[apart].min()) == max(y[~apart].max(), y[apart].max()) or len(set(y[~apart])) < 2 or len(set(y[apart])) < 2:
        return Model([], [], None, float(y.mean()) if len(y) else 0.5)
    xs = [[x[~apart]] for x in labelled]
    ys = [[y[~apart]] for _ in labelled]
    free = np.ones(len(pool[0]), dtype=bool)
    share = y[~apart].mean()
    views = [Logistic(np.vstack(x), np.concatenate(t)) for x, t in zip(xs, ys, strict=True)]
    for _ in range(rounds):
        for me, other in ((0, 1), (1, 0)):
            at = np.flatnonzero(free)
            if not len(at):
                break
            logit = views[me].logit(pool[me][at])
            order = np.argsort(logit)
            many = min(exchanged, len(at) // 2)
            up = max(1, int(round(many * share)))
            chosen = [(at[order[::-1][:up]], 1.0, logit[order[::-1][:up]] > 1), (at[order[: max(1, many - up)]], 0.0, logit[order[: max(1, many - up)]] < -1)]
            for rows, label, sure in chosen:
                rows = rows[sure]
                free[rows] = False
                xs[other].append(pool[other][rows])
                ys[other].append(np.full(len(rows), label))
        views = [Logistic(np.vstack(x), np.concatenate(t)) for x, t in zip(xs, ys, strict=True)]
    scales = [Logistic(v.logit(x[apart])[:, None], y[apart]) for v, x in zip(views, labelled, strict=True)]
    model = Model(views, scales, None, float(y.mean()))
    model.both = Logistic(model.calibrated([x[apart] for x in labelled]), y[apart])
    return model


def _views(batch: pd.DataFrame) -> list[np.ndarray]:
    text = np.array([text_view(t) for t in batch["t"].tolist()], dtype=float).reshape(len(batch), -1)
    meta = np.array(
        [metadata_view(s, l, None if n is None or n != n else float(n)) for s, l, n in zip(batch["s"].tolist(), batch["l"].tolist(), batch["n"].tolist(), strict=True)],
        dtype=float,
    ).reshape(len(batch), -1)
    return [text, meta]


def _columns(docs: DataFrame, key: str, text: str) -> DataFrame:
    has = {c for c in docs.columns}
    extra = {"s": ("source", "string"), "l": ("lang", "string"), "n": ("n_chars", "double")}
    return docs.select(
        F.col(key).alias("k"), F.col(text).alias("t"),
        *((F.col(c) if c in has else F.lit(None)).cast(kind).alias(a) for a, (c, kind) in extra.items()),
    )


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Learn from labelled rows that aren't held out and a pool of rows that have no label; both drawn by a hash of the key."""
    rows = _columns(docs, key, text).filter(F.col("k").isNotNull())
    marked = labels.select(F.col(key).alias("k"), F.col(label).cast("double").alias("y")).filter(F.col("k").isNotNull() & F.col("y").isin(0.0, 1.0))
    usable = marked.filter(~held_out("k"))
    n_marked, n_rows = usable.count(), rows.count()
    draw = lambda seed, most, of: F.pmod(F.xxhash64("k", F.lit(seed)), F.lit(1 << 30)) < min(1 << 30, int((1 << 30) * 0.9 * most / max(of, 1)) + 1)
    chosen = usable.filter(draw(21, TRAIN_ROWS, n_marked)).groupBy("k").agg(F.max("y").alias("y")).limit(TRAIN_ROWS)

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            a, b = _views(batch)
            yield pd.DataFrame({"k": batch["k"].astype(str), "y": batch["y"], "a": list(a), "b": list(b)})

    schema = "k string, y double, a array<double>, b array<double>"
    learn = rows.join(F.broadcast(chosen), "k").mapInPandas(vectors, schema).groupBy("k").agg(F.min(F.struct("y", "a", "b")).alias("x")).select("k", "x.*").limit(TRAIN_ROWS).collect()
    pool = (
        rows.filter(draw(22, POOL_ROWS, n_rows) & ~held_out("k")).join(marked.select("k"), "k", "left_anti").withColumn("y", F.lit(0.0))
        .limit(POOL_ROWS).mapInPandas(vectors, schema).collect()
    )
    learn.sort(key=lambda r: r["k"])
    pool.sort(key=lambda r: r["k"])
    width = (len(text_view("")), len(metadata_view(None, None, None)))
    matrix = lambda rs, c, w: np.array([r[c] for r in rs], dtype=float).reshape(len(rs), w)
    return co_train(
        [matrix(learn, "a", width[0]), matrix(learn, "b", width[1])], np.array([r["y"] for r in learn]),
        [matrix(pool, "a", width[0]), matrix(pool, "b", width[1])],
    )


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1, higher: better), predicted.

    Whole texts are looked at; a null text counts as an empty one, and null or missing metadata as unknown.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame({"k": batch["k"], "score": model.scores(_views(batch))})
            yield out

    kind = docs.schema[key].dataType.simpleString()
    return (
        _columns(docs, key, text).mapInPandas(run, f"k {kind}, score double")
        .select(F.col("k").alias(key), held_out("k").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
