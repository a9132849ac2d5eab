"""Plain versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np


class Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def jaccard(rows: list[tuple], n: int, num: int, den: int) -> list[tuple]:
    """(key, size of the set, smallest key connected) for rows (key, text)."""
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
        sets.append(set() if not words else {tuple(words)} if len(words) < n else {tuple(words[i : i + n]) for i in range(len(words) - n + 1)})
    union, holders = Union(len(rows)), {}
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders.get(x, ())).items():
            if den * both >= num * (len(s) + len(sets[j]) - both):
                union.join(i, j)
        for x in s:
            holders.setdefault(x, []).append(i)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[union.root(i)] = min(least.get(union.root(i), key), key)
    return sorted(((key, len(sets[i]), least.get(union.root(i))) for i, (key, _) in enumerate(rows)), key=str)


def cosine(rows: list[tuple], least_cosine: float = 0.9) -> list[tuple]:
    """(key, links, smallest key connected) for rows (key, vector)."""
    union, links = Union(len(rows)), [0] * len(rows)
    by_width: dict[int, list[int]] = {}
    for i, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            by_width.setdefault(len(v), []).append(i)
    for at in by_width.values():
        x = np.array([rows[i][1] for i in at], dtype=np.float64)
        x /= np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= least_cosine
        np.fill_diagonal(near, False)
        for a, i in enumerate(at):
            links[i] = int(near[a].sum())
            for b in np.flatnonzero(near[a]):
                union.join(i, at[b])
    least: dict[int, int] = {}
    for i, (key, _) in enumerate(rows):
        least[union.root(i)] = min(least.get(union.root(i), key), key)
    return sorted((key, links[i], least[union.root(i)]) for i, (key, _) in enumerate(rows))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (2 if k % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _digits(m: str) -> str:
    return re.sub("[^0-9]", "", m)


PERSONAL = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(_digits(m)) <= 19 and luhn(_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(_digits(m)) <= 15),
]


def personal(text: str | None) -> tuple:
    """(counts by kind, digest of the spans, spans)."""
    spans, counts = [], []
    for kind, pattern, ok in PERSONAL:
        found = [f"{kind}:{m.start()}:{m.end()}" for m in re.finditer(pattern, text or "") if ok(m.group())]
        counts.append(len(found))
        spans += found
    return (*counts, hashlib.sha256(",".join(spans).encode()).hexdigest(), ",".join(spans))
