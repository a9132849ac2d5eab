"""Product codes for vectors, trained exactly with adaptive distance bounds (after Drake and Hamerly).

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts, each with its own codebook.
A part's codebook is trained by rounds of k-means on integers: every part goes to its nearest entry (squared
Euclidean distance, ties to the lower index), then an entry becomes the componentwise floor of its parts' mean.

Between rounds each row keeps, per part, its entry with an upper bound of the distance, its b next closest entries
with ordered lower bounds, and one outer bound for all entries beyond those (``_State``).  When entries move, the
bounds move by the drifts.  A part whose upper bound stays below its first lower bound keeps its entry unseen; one
below the outer bound compares its entry with the leading entries whose bounds it meets; only the others meet the
whole codebook.  Bounds are floating point, rounded outwards; wherever they leave a doubt, distances are compared
as integers, so the result is that of plain k-means to the last digit.  b adapts to how deep the last round had to look.

A round is one pass over the state table, written to the shared folder with the sums of its parts (as base-2**32
digits, summed by Spark), after which the state before it is deleted.  Only codebooks reach the driver: ``entries``
times the vector's width, whatever the table's size.  No row is shuffled before the sums over labels.

Nulls: vectors that are null or hold null or non-finite components are left out.  Vectors shorter than the widest one
(an empty one too) are filled with zeros, as is a width that ``parts`` doesn't divide.  The first codebooks come from the
rows with the smallest ids (nulls last, then by vector, repeated ids row by row); with fewer rows than ``entries`` they are
smaller.  Repeated rows count each.  A component too large for 64-bit distances makes the table run on
Python integers without bounds; ``error`` then stops at the largest long.  An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import released, written

ENTRIES, PARTS, ROUNDS, SCALE = 256, 4, 4, 1024
# Closest entries whose bounds a row keeps per part: at first, and the range for adaptation.
B_FIRST, B_LEAST, B_MOST = 16, 4, 32
# b becomes the depth that this share of the parts with a doubt did not exceed.
DEPTH_SHARE = 0.9
LONG_MAX = (1 << 63) - 1


@dataclass
class _State:
    """Per row and part: entry, upper (n, parts); near, lower (n, parts, b), lower ascending; outer (n, parts)."""

    entry: np.ndarray
    upper: np.ndarray
    near: np.ndarray
    lower: np.ndarray
    outer: np.ndarray

    def packed(self) -> pa.Array:
        n = len(self.entry)
        fields = (self.entry, self.near, self.upper, self.lower, self.outer)
        rows = np.concatenate([np.ascontiguousarray(a.reshape(n, -1)).view(np.uint8) for a in fields], axis=1)
        offsets = np.arange(n + 1, dtype=np.int32) * rows.shape[1]
        return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])

    @classmethod
    def unpacked(cls, column: pa.Array, parts: int, b: int) -> "_State":
        rows = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)
        out, at = [], 0
        for kind, shape in ((np.uint8, (parts,)), (np.uint8, (parts, b)), (np.float32, (parts,)), (np.float32, (parts, b)), (np.float32, (parts,))):
            size = math.prod(shape) * np.dtype(kind).itemsize
            out.append(np.ascontiguousarray(rows[:, at : at + size]).view(kind).reshape(len(rows), *shape))
            at += size
        entry, near, upper, lower, outer = out
        return cls(entry, upper, near, lower, outer)


def _up(x: np.ndarray) -> np.ndarray:
    """float32 no smaller than ``x``, two steps above for what rounding in float64 may have cost."""
    y = x.astype(np.float32)
    return np.nextafter(np.nextafter(y, np.float32(np.inf)), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    y = x.astype(np.float32)
    return np.nextafter(np.nextafter(y, np.float32(-np.inf)), np.float32(-np.inf))


def _integers(column: pa.Array, width: int, scale: int, wide: bool) -> np.ndarray:
    """Rows of floor(scale * x), filled with zeros: int64, or Python integers if ``wide``."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if wide:
        scaled = np.array([int(x) * scale if abs(x) >= 1 << 53 else math.floor(x * scale) for x in values.tolist()], dtype=object)
    else:
        scaled = np.floor(values * scale).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(sizes) and sizes.min() == width:
        return scaled.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), dtype=scaled.dtype)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(scaled)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = scaled
    return out


def _squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Integer squared distances (rows, entries)."""
    if x.dtype == object:
        return np.array([[sum(int(d) ** 2 for d in row - e) for e in entries] for row in x], dtype=object).reshape(len(x), len(entries))
    bound = 4 * x.shape[1] * max(int(np.abs(x).max(initial=0)), int(np.abs(entries).max(initial=0))) ** 2
    kind = np.float64 if bound < 1 << 53 else np.int64  # both exact here; the former by fast matrix products
    a, c = x.astype(kind), entries.astype(kind)
    return ((a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)


def _full(x: np.ndarray, entries: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """entry, upper, near, lower, outer of rows compared with the whole codebook."""
    squares = _squares(x, entries)
    entry = squares.argmin(axis=1) if len(x) else np.zeros(0, dtype=np.int64)
    n, k = squares.shape
    near, lower = np.repeat(entry[:, None], b, axis=1).astype(np.uint8), np.zeros((n, b), dtype=np.float32)
    if x.dtype == object:  # no bounds: every part is compared again
        return entry.astype(np.uint8), np.full(n, np.inf, np.float32), near, np.full((n, b), -np.inf, np.float32), np.full(n, -np.inf, np.float32)
    distance = np.sqrt(squares.astype(np.float64))
    best = distance[np.arange(n), entry]
    distance[np.arange(n), entry] = np.inf
    kept = min(b, k - 1)
    if kept < k - 1:
        order = np.argpartition(distance, kept, axis=1)
        outer, order = distance[np.arange(n), order[:, kept]], order[:, :kept]
    else:
        order, outer = np.argsort(distance, axis=1)[:, :kept], np.full(n, np.inf)
    order = np.take_along_axis(order, np.take_along_axis(distance, order, axis=1).argsort(axis=1), axis=1)
    near[:, :kept] = order
    lower[:, :kept] = _down(np.take_along_axis(distance, order, axis=1))
    lower[:, kept:] = _down(outer)[:, None]
    return entry.astype(np.uint8), _up(best), near, lower, _down(outer)


def _resized(near: np.ndarray, lower: np.ndarray, outer: np.ndarray, entry: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Bounds for b entries: the ones cut off join the outer bound, added places name the row's own entry under that bound."""
    old = near.shape[1]
    if b < old:
        return near[:, :b], lower[:, :b], np.minimum(outer, lower[:, b])
    more = np.repeat(entry[:, None], b - old, axis=1)
    return np.concatenate([near, more], axis=1), np.concatenate([lower, np.repeat(outer[:, None], b - old, axis=1)], axis=1), outer


def _moved(x: np.ndarray, entries: np.ndarray, drift: np.ndarray, old: tuple[np.ndarray, ...], b: int) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
    """One part's state after its entries moved by ``drift``, and how many leading bounds each row had to look behind
    (0: none, b + 1: all)."""
    entry, upper, near, lower, outer = old
    near, lower, outer = _resized(near, lower, outer, entry, b)
    upper = _up(upper.astype(np.float64) + drift[entry])
    lower = _down(lower.astype(np.float64) - drift[near])
    outer = _down(outer.astype(np.float64) - drift.max(initial=0))
    lower = np.minimum.accumulate(np.concatenate([lower, outer[:, None]], axis=1)[:, ::-1], axis=1)[:, ::-1][:, :-1]
    entry, near, lower, depth = entry.copy(), near.copy(), lower.copy(), np.zeros(len(x), dtype=np.int64)
    doubt = np.flatnonzero(~(upper < lower[:, 0]))
    if len(doubt):
        own = ((x[doubt] - entries[entry[doubt]]) ** 2).sum(axis=1)
        upper[doubt] = _up(np.sqrt(own.astype(np.float64)))
        doubt = doubt[~(upper[doubt] < lower[doubt, 0])]
    depth[doubt] = (lower[doubt] <= upper[doubt, None]).sum(axis=1)
    whole = doubt[~(upper[doubt] < outer[doubt])]
    some = np.setdiff1d(doubt, whole, assume_unique=True)
    depth[whole] = b + 1
    reach = 1
    while len(some):  # rows of like depth together, so that few needless entries are gathered
        now, some = some[depth[some] <= reach], some[depth[some] > reach]
        if len(now):
            z = min(reach, b)
            which = np.concatenate([entry[now, None], near[now, :z]], axis=1).astype(np.int64)
            squares = ((x[now, None, :] - entries[which]) ** 2).sum(axis=2)
            order = np.lexsort((which, squares), axis=1)  # nearest first, ties to the lower index
            which, squares = np.take_along_axis(which, order, axis=1), np.take_along_axis(squares, order, axis=1)
            distance = np.sqrt(squares.astype(np.float64))
            entry[now], upper[now] = which[:, 0], _up(distance[:, 0])
            bounds = np.concatenate([_down(distance[:, 1:]), lower[now, z:]], axis=1)
            names = np.concatenate([which[:, 1:].astype(np.uint8), near[now, z:]], axis=1)
            order = bounds.argsort(axis=1, kind="stable")
            near[now], lower[now] = np.take_along_axis(names, order, axis=1), np.take_along_axis(bounds, order, axis=1)
        reach *= 2
    if len(whole):
        entry[whole], upper[whole], near[whole], lower[whole], outer[whole] = _full(x[whole], entries, b)
    return (entry, upper, near, lower, outer), depth


def _digits(part: int, entry: int, position: int, total: int) -> Iterator[tuple[int, int, int, int, int]]:
    """``total`` as digits in base 2**32, the last one signed."""
    at = 0
    while not -(1 << 31) <= total < 1 << 31:
        total, low = total >> 32, total & 0xFFFFFFFF
        yield part, entry, position, at, low
        at += 1
    yield part, entry, position, at, total


@dataclass
class _Pass:
    """One pass over the rows: assigns every part to its nearest of ``books`` (old ones: ``before``)."""

    books: list[np.ndarray]
    before: list[np.ndarray] | None
    width: int
    scale: int
    wide: bool
    b: int
    b_before: int

    def _assigned(self, batch: pa.RecordBatch) -> tuple[np.ndarray, _State, np.ndarray]:
        parts, each = len(self.books), self.width // len(self.books)
        x = _integers(batch.column("vector"), self.width, self.scale, self.wide)
        old = _State.unpacked(batch.column("state"), parts, self.b_before) if self.before is not None else None
        new, depths = [], []
        for p, entries in enumerate(self.books):
            piece = x[:, p * each : (p + 1) * each]
            if old is None or self.wide:
                new.append(_full(piece, entries, self.b))
                depths.append(np.full(len(x), self.b + 1))
            else:
                drift = np.sqrt(((entries - self.before[p]).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-9)
                state = (old.entry[:, p], old.upper[:, p], old.near[:, p], old.lower[:, p], old.outer[:, p])
                moved, depth = _moved(piece, entries, drift, state, self.b)
                new.append(moved)
                depths.append(depth)
        return x, _State(*(np.stack(field, axis=1) for field in zip(*new))), np.stack(depths, axis=1)

    def round(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their new state; at the end one row with the digits of the sums, counts (position -1) and depths (entry -1)."""
        parts, each = len(self.books), self.width // len(self.books)
        sums = [np.zeros((len(e), each), dtype=object) for e in self.books]
        counts, depths = [np.zeros(len(e), dtype=np.int64) for e in self.books], np.zeros(self.b + 2, dtype=np.int64)
        last = None
        for last in batches:
            if not last.num_rows:
                continue
            x, state, depth = self._assigned(last)
            for p in range(parts):
                inside = np.zeros((len(sums[p]), each), dtype=x.dtype)
                np.add.at(inside, state.entry[:, p], x[:, p * each : (p + 1) * each])
                sums[p] += inside
                counts[p] += np.bincount(state.entry[:, p], minlength=len(counts[p]))
            depths += np.bincount(depth.ravel(), minlength=self.b + 2)
            nothing = pa.nulls(last.num_rows, _SUMS)
            columns = [last.column("vec_id"), last.column("label"), last.column("vector"), state.packed(), nothing]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "label", "vector", "state", "sums"])
        if last is None or not sum(int(c.sum()) for c in counts):
            return
        digits = [
            d
            for p in range(parts)
            for e in np.flatnonzero(counts[p])
            for d in (*(d for i in range(each) for d in _digits(p, int(e), i, int(sums[p][e, i]))), (p, int(e), -1, 0, int(counts[p][e])))
        ]
        digits += [(0, -1, z, 0, int(n)) for z, n in enumerate(depths) if n]
        row = [dict(zip(("part", "entry", "position", "digit", "value"), d)) for d in digits]
        empty = [pa.nulls(1, last.schema.field(c).type) for c in ("vec_id", "label", "vector")]
        yield pa.RecordBatch.from_arrays([*empty, pa.nulls(1, pa.binary()), pa.array([row], _SUMS)], names=["vec_id", "label", "vector", "state", "sums"])

    def codes(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """vec_id, label, code, error."""
        each = self.width // len(self.books)
        for batch in batches:
            x, state, _ = self._assigned(batch)
            error = np.zeros(len(x), dtype=x.dtype)
            for p, entries in enumerate(self.books):
                error = error + ((x[:, p * each : (p + 1) * each] - entries[state.entry[:, p]]) ** 2).sum(axis=1)
            code = [row.tobytes().hex() for row in np.ascontiguousarray(state.entry)]
            error = pa.array([min(int(e), LONG_MAX) for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), error], names=["vec_id", "label", "code", "error"])


_SUMS = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("position", pa.int32()), ("digit", pa.int32()), ("value", pa.int64())]))
_SUMS_SQL = "array<struct<part:int,entry:int,position:int,digit:int,value:long>>"


def usable(embeddings: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label, vector of the rows whose vector and all its components are present and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.filter(F.col(vector).isNotNull() & finite).select("vec_id", "label", F.col(vector).alias("vector"))


def _next_books(state: DataFrame, books: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The codebooks of a round's sums, and how often each depth was met."""
    totals = (
        state.filter(F.col("sums").isNotNull())
        .select(F.inline("sums"))
        .groupBy("part", "entry", "position", "digit")
        .agg(F.sum("value").alias("value"))
        .collect()  # a few numbers for each component of each entry
    )
    sums, counts, depths = {}, {}, np.zeros(B_MOST + 2, dtype=np.int64)
    for r in totals:
        if r["entry"] < 0:
            depths[r["position"]] += r["value"]
        elif r["position"] < 0:
            counts[r["part"], r["entry"]] = r["value"]
        else:
            key = (r["part"], r["entry"], r["position"])
            sums[key] = sums.get(key, 0) + (r["value"] << (32 * r["digit"]))
    new = [b.copy() for b in books]
    for (p, e), n in counts.items():
        for i in range(new[p].shape[1]):
            new[p][e, i] = sums[p, e, i] // n
    return new, depths


def _adapted(b: int, depths: np.ndarray) -> int:
    """b for the next round from the depths of the parts with a doubt."""
    met = depths[1:].cumsum()
    if not met[-1]:
        return max(B_LEAST, b // 2)
    depth = int(np.searchsorted(met, DEPTH_SHARE * met[-1])) + 1
    return min(B_MOST, max(B_LEAST, 2 * b if depth > b else depth))


def compress(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of the rows (vec_id, label, vector, as :func:`usable` gives them): vec_id, label, code (two hex digits a part),
    error (squared distance, summed over parts); and the codebooks, arrays of integers (entry, position), one per part."""
    if not 0 < entries <= 256:
        raise ValueError("a code digit pair names at most 256 entries")
    size, largest = rows.agg(F.max(F.size("vector")), F.max(F.array_max(F.transform("vector", lambda x: F.abs(x.cast("double")))))).first()
    width = -(-(size or 0) // parts) * parts
    wide = 4 * max(width, 1) * (int(largest or 0) * scale + scale) ** 2 >= 1 << 62
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()  # at most ``entries`` rows
    start = _integers(first.column("vector"), width, scale, wide)
    each = width // parts
    books, before, b = [start[:, p * each : (p + 1) * each].copy() for p in range(parts)], None, min(B_FIRST, B_MOST)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    stated = f"vec_id {kinds['vec_id']}, label {kinds['label']}, vector {kinds['vector']}, state binary, sums {_SUMS_SQL}"
    state, b_before = rows, b
    for _ in range(rounds):
        step = _Pass(books, before, width, scale, wide, b, b_before)
        after = written(state.mapInArrow(step.round, stated), "codes-round")
        if before is not None:
            released(state)
        found, depths = _next_books(after, books)
        before, books, state = books, found, after.filter("sums IS NULL").drop("sums")
        state.written_path = after.written_path
        b_before, b = b, _adapted(b, depths)
    step = _Pass(books, before, width, scale, wide, b, b_before)
    coded = written(state.mapInArrow(step.codes, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"), "codes")
    if before is not None:
        released(state)
    return coded, books


def codebooks_hash(books: list[np.ndarray]) -> str:
    """SHA-256 of the integers by part, entry and position, in decimals joined by commas."""
    return hashlib.sha256(",".join(str(int(v)) for book in books for entry in book for v in entry).encode()).hexdigest()


def decoded(code: str, books: list[np.ndarray], scale: int = SCALE) -> list[float]:
    """The vector that a code stands for."""
    return [int(v) / scale for p, book in enumerate(books) for v in book[int(code[2 * p : 2 * p + 2], 16)]]


def vector_codes(embeddings: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error (the errors summed over the rows with the same label, nulls together; at most the
    largest long), codebooks_sha256."""
    coded, books = compress(usable(embeddings))
    top = F.lit(LONG_MAX).cast("decimal(38,0)")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(F.least(F.sum(F.col("error").cast("decimal(38,0)")), top).cast("long").alias("label_error"))
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_hash(books)).alias("codebooks_sha256")
    )
