"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits a node along a random direction, again and again; vectors within a spill of the
threshold (``SPILL`` of the spread that unit vectors of that dimension have along a direction) go to both sides (spill overlap), so a close pair is seldom torn apart in one tree and hardly ever
in all of them.  Vectors are compared within leaves, in double precision, and links are united.

* The trees are fitted on a bounded sample (``SAMPLE`` vectors) on the driver; every vector is put into its leaves.
  Of several random directions and thresholds a node takes the one with the fewest sample vectors near
  it, so dense groups stay whole and are seldom copied.  A node that is dense even there is no longer split.
* Trees are added until of ``PROBES`` pairs at the very threshold (a sample vector and one made for it) ``MISSED`` at most share no leaf.
  Where ``MOST_TREES`` don't reach that (vectors of few dimensions), the vectors of that length are one leaf: all its pairs are compared.
* Equal vectors are one class with a count (64-bit hash of the array), so copies aren't compared.
* A leaf above ``LEAF_ROWS`` is cut into blocks and each pair of blocks is a task of its own: all its pairs are compared.
  So a group of near copies is compared in full; its cost grows with the square of its blocks.
* A pair that shares leaves of several trees counts once: in the least leaf that both have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import checked_broadcast, component_roots, written

SAMPLE = 16_384
TREES = 4  # at least
MOST_TREES = 24
PROBES, MISSED = 2048, 0.001
DENSE = 2.5  # a node isn't split where its vectors lie so many times denser than those of a uniform sphere
SPILL = 0.2  # of the spread of unit vectors along a direction, 1 / sqrt(dimension)
LEAF_TARGET = 256
LEAF_ROWS = 1024
DIRECTIONS = 4


class Tree:
    """Nodes as arrays: direction, threshold, children (negative: leaf number, minus 1)."""

    def __init__(self, sample: np.ndarray, leaf: int, rng: np.random.Generator):
        self.directions, self.thresholds, self.kids, self.leaves = [], [], [], 0
        self.spill = SPILL / np.sqrt(sample.shape[1])
        self.root = self._grow(sample, leaf, rng, 0)

    def _grow(self, x: np.ndarray, leaf: int, rng: np.random.Generator, depth: int) -> int:
        split = self._split(x, rng) if len(x) > leaf and depth < 40 else None
        if split is None:
            self.leaves += 1
            return -self.leaves
        direction, threshold, at = split
        me = len(self.kids)
        self.directions.append(direction)
        self.thresholds.append(threshold)
        self.kids.append([0, 0])
        left = self._grow(x[at <= threshold + self.spill], leaf, rng, depth + 1)
        right = self._grow(x[at >= threshold - self.spill], leaf, rng, depth + 1)
        self.kids[me] = [left, right]
        return me

    def _split(self, x: np.ndarray, rng: np.random.Generator) -> tuple | None:
        best = None
        for _ in range(DIRECTIONS):
            direction = rng.standard_normal(x.shape[1])
            direction /= np.linalg.norm(direction)
            at = x @ direction
            for threshold in np.quantile(at, np.linspace(0.35, 0.65, 7)):
                near = int((np.abs(at - threshold) <= self.spill).sum())
                if best is None or near < best[0]:
                    best = (near, direction, float(threshold), at)
        near, direction, threshold, at = best
        if near > DENSE * 0.4 * np.sqrt(x.shape[1]) * 2 * self.spill * len(x):
            return None
        larger = max((at <= threshold + self.spill).sum(), (at >= threshold - self.spill).sum())
        return None if larger > 0.9 * len(x) else (direction, threshold, at)

    def put(self, x: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(leaf number, positions of the rows of ``x`` in it)."""
        out, stack = [], [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out.append((-node - 1, rows))
                continue
            at = x[rows] @ self.directions[node]
            left, right = self.kids[node]
            stack.append((left, rows[at <= self.thresholds[node] + self.spill]))
            stack.append((right, rows[at >= self.thresholds[node] - self.spill]))
        return [(leaf, rows) for leaf, rows in out if len(rows)]


def unit(vectors: list) -> np.ndarray:
    """Rows of unit length in double precision (scaled first, so that no square overflows)."""
    x = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _apart(tree: Tree, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which rows of ``x`` share no leaf of the tree with the same row of ``y``?"""
    codes = [np.concatenate([leaf * len(z) + rows for leaf, rows in tree.put(z)]) for z in (x, y)]
    apart = np.ones(len(x), dtype=bool)
    apart[np.intersect1d(*codes) % len(x)] = False
    return apart


def _grown(x: np.ndarray, leaf: int, trees: int, cosine: float, seed: list[int]) -> list[Tree | None]:
    """``trees`` or more trees, until pairs at the threshold meet; [None], a single leaf, if ``MOST_TREES`` don't bring them together."""
    rng = np.random.default_rng([*seed, MOST_TREES])
    ours = x[rng.permutation(len(x))[:PROBES]]
    away = rng.standard_normal(ours.shape)
    away -= (away * ours).sum(axis=1, keepdims=True) * ours
    away /= np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-300)
    theirs = cosine * ours + np.sqrt(max(0.0, 1 - cosine * cosine)) * away
    forest: list[Tree] = []
    missed = np.ones(len(ours), dtype=bool)
    while len(forest) < trees or (missed.mean() > MISSED and len(forest) < MOST_TREES):
        forest.append(Tree(x, leaf, np.random.default_rng([*seed, len(forest)])))
        missed &= _apart(forest[-1], ours, theirs)
    return [None] if missed.mean() > MISSED else forest


def fit_forest(sample: list, total: int, trees: int = TREES, seed: int = 5, cosine: float = 0.9) -> dict[int, list[Tree | None]]:
    """A forest per number of components: vectors of different lengths never link."""
    out = {}
    by: dict[int, list] = {}
    for v in sample:
        by.setdefault(len(v), []).append(v)
    leaf = max(8, LEAF_TARGET * len(sample) // max(total, 1))
    for width, vectors in sorted(by.items()):
        x = unit(vectors)
        out[width] = _grown(x, leaf, trees, cosine, [seed, width])
    return out


def _leaves(forest: dict[int, list[Tree | None]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            widths = batch["vector"].map(len)
            for width, rows in batch.groupby(widths):
                x = unit(rows["vector"].tolist())
                leaves: list[list[int]] = [[] for _ in range(len(x))]
                # a width that the sample lacks, or that no trees separate well, has one leaf
                for t, tree in enumerate(forest.get(int(width), [None])):
                    for leaf, at in tree.put(x) if tree else [(0, np.arange(len(x)))]:
                        name = (int(width) << 40) + (t << 32) + leaf
                        for i in at:
                            leaves[i].append(name)
                yield pd.DataFrame({"class": rows["class"].to_numpy(), "leaves": leaves})

    return run


def _compare(cosine: float):
    """All pairs of a leaf's block, or of two blocks: per class the links first seen here, and the least class it is connected with here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        leaf = int(group["leaf"].iloc[0])
        x = unit(group["vector"].tolist())
        block = group["block"].to_numpy()
        copies = group["copies"].to_numpy().astype(np.int64)
        names = group["class"].to_numpy().astype(np.int64)
        links = x @ x.T >= cosine
        np.fill_diagonal(links, False)
        if block.min() != block.max():
            links &= block[:, None] != block[None, :]
        # pairs that meet in a lesser leaf are counted there
        mine = [[l for l in ls if l < leaf] for ls in group["leaves"]]
        lesser, at = np.unique(np.array([l for ls in mine for l in ls], dtype=np.int64), return_inverse=True)
        seen = np.zeros((len(x), len(lesser)), dtype=np.float32)
        seen[np.repeat(np.arange(len(x)), [len(ls) for ls in mine]), at] = 1
        first = links & ~(seen @ seen.T > 0) if len(lesser) else links
        label = names.copy()
        while True:
            lower = np.minimum(label, np.where(links, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            if (lower == label).all():
                break
            label = lower
        return pd.DataFrame({"class": names, "near": label, "links": first.astype(np.int64) @ copies})

    return run


def near_vectors(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, trees: int = TREES
) -> DataFrame:
    """One row per row of ``vectors``: key, n_links, component_id (smallest key reachable by links), kept.

    Vectors that are null, empty, zero, or have null or non-finite components link with nothing; neither do vectors
    of different lengths.  A null key is no component's id unless nothing else is there.  Rows that repeat a
    key are rows of their own; repeated vectors link with each other.
    """
    # no own column names clash with those of the table: only two of its columns are read
    rows = vectors.select(F.col(key).alias("name"), F.col(vector).alias("vector"))
    sound = (
        F.col("vector").isNotNull()
        & ~F.coalesce(F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
        & F.coalesce(F.exists("vector", lambda v: v != 0), F.lit(False))
    )
    rows = rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("vector")))
    classes = written(
        rows.filter("class is not null")
        .groupBy("class")
        .agg(F.first("vector").alias("vector"), F.count(F.lit(1)).alias("copies"), F.min("name").alias("least")),
        "vector-classes",
    )
    total = classes.count()
    share = min(1.0, SAMPLE * 0.95 / max(total, 1))
    drawn = classes.filter(F.pmod(F.xxhash64("class", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    sample = [r["vector"] for r in drawn.orderBy("class").select("vector").limit(SAMPLE).collect()]
    forest = fit_forest(sample, total, trees, cosine=cosine)
    homes = written(classes.mapInPandas(_leaves(forest), "class long, leaves array<long>"), "vector-leaves")
    sizes = (
        homes.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("leaf", F.ceil(F.col("n") / LEAF_ROWS).cast("int").alias("blocks"))
    )
    dealt = (
        homes.select("class", "leaves", F.explode("leaves").alias("leaf"))
        .join(checked_broadcast(written(sizes, "vector-leaf-sizes")), "leaf")
        .withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "other"))
        .withColumn("high", F.greatest("block", "other"))
        .drop("other", "blocks")
    )
    found = written(
        dealt.join(classes.select("class", "vector", "copies"), "class")
        .groupBy("leaf", "low", "high")
        .applyInPandas(_compare(cosine), "class long, near long, links long"),
        "vector-links",
    )
    links = found.groupBy("class").agg(F.sum("links").alias("links"))
    ties = found.filter("class <> near").select(F.col("class").alias("a"), F.col("near").alias("b")).distinct()
    roots = component_roots(ties)
    placed = (
        classes.select("class", "copies", "least")
        .join(links, "class", "left")
        .join(roots.select(F.col("node").alias("class"), "root"), "class", "left")
        .select(
            "class", "least", F.coalesce("root", "class").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")
        )
    )
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    placed = placed.join(ids, "root").select("class", "n_links", "component_id")
    return (
        rows.select("name", "class")
        .join(placed, "class", "left")
        .select(
            F.col("name").alias(key),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("class").isNull(), F.col("name")).otherwise(F.col("component_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))
    )
