"""Packing documents into fixed-length sequences by linear grouping.

Fernandez de la Vega and Lueker's scheme on exact token counts:

1. Every document is tokenised and closed with an end id; longer ones are
   cut into full sequences and a remainder (a piece each).
2. The histogram of piece lengths (at most ``capacity`` rows, whatever the
   corpus) goes to the driver.  Large lengths, sorted, are cut into groups of
   equal cardinality and rounded up to their group's maximum.
3. The few rounded sizes are packed by column generation (configurations
   priced by a knapsack), rounded down, the rest best-fit decreasing.
4. Actual lengths are substituted for the rounded ones, and small lengths
   are best-fit into the room that is left, all in runs of equal sequences.
5. The plan (runs per length) is sent to the tasks, and each piece looks up its
   sequence by its number within its length.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import numbered, positioned

CAPACITY = 2048
END_ID = 0
BATCH_CHARS = 4_000_000
BATCH_TEXTS = 256  # so many are Python strings at a time
CACHED_WORDS = 200_000  # a worker's word cache is emptied beyond this: workers live on, and later stages run beside it
_MARKS = ".,;:!?|%#*&$"  # none starts a special token or a contraction

# Byte-level vocabularies write a byte that is no visible Latin-1 character as the next free one from 256 on (the space here stays).
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTES = {b: 256 + n for n, b in enumerate(_HIDDEN) if b != 32}

_encoders: dict[str, "WordEncoder"] = {}


def _is_latin(text: str) -> bool:
    """Has the text Latin-1 characters only?"""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordEncoder:
    """Token ids of a text as little-endian 32-bit bytes, with a cache of words.

    The tokenizer splits at white space before anything else, so the ids of a
    text are those of its space- or line-separated parts, joined.  Arrow splits a batch of
    texts and numbers its distinct words; only these are looked up, and the ids are put together by position.
    """

    def __init__(self, path: str):
        import os

        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.cache: dict[str, bytes] = {}
        # For lower-case Latin-1 letters normalising and splitting do nothing, so this one leaves them out
        self.letters = Tokenizer(self.tokenizer.model)  # one model in memory
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        return list(self.encoded(texts))

    def encoded(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text; about ``BATCH_CHARS`` characters are worked on at a time."""
        some, size = [], 0
        for text in texts:
            if _is_latin(text) and "<|" not in text:
                text = text.lower()  # as the tokenizer does; fewer words to learn
            some.append(text.replace("\n", " "))
            size += len(text)
            if size > BATCH_CHARS:
                yield from self._encode(some)
                some, size = [], 0
        if some:
            yield from self._encode(some)

    def _encode(self, texts: list[str]) -> Iterator[bytes]:
        parts = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = parts.values.dictionary_encode()
        which = words.indices.to_numpy()
        ids = self._known(words.dictionary.to_pylist(), np.bincount(which) > 1)
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        first = np.cumsum(sizes) - sizes
        many = sizes[which]
        stop = np.cumsum(many)
        at = np.repeat(first[which] - (stop - many), many)
        at += np.arange(len(at))
        data = np.frombuffer(b"".join(ids), dtype="<u4")[at].tobytes()
        cuts = 4 * np.concatenate([[0], stop])[parts.offsets.to_numpy()]
        return (data[begin:end] for begin, end in pairwise(cuts.tolist()))

    def _known(self, words: list[str], repeated: np.ndarray) -> list[bytes]:
        """The ids of distinct words.  Words that are ``repeated`` in the batch are kept for the next ones: most others never come again."""
        ids = list(map(self.cache.get, words))
        missing = [k for k, x in enumerate(ids) if x is None]
        if missing:
            got = self._learned([words[k] for k in missing])
            if len(self.cache) > CACHED_WORDS:
                self.cache.clear()
            for k, again in zip(missing, repeated[missing].tolist(), strict=True):
                ids[k] = got[words[k]]
                if again:
                    self.cache[words[k]] = ids[k]
        return ids

    def _learned(self, new: list[str]) -> dict[str, bytes]:
        """The ids of words (and of some of their parts) that aren't in the cache.

        A run of letters is one word to the tokenizer, and its last id is a word's end: such words are
        encoded in one call and cut at the ends.  Marks after letters are a word of their own.
        """
        cache = self.cache
        got: dict[str, bytes] = {}
        plain: dict[str, None] = {}
        rest, marked = set(), []
        for word in new:
            if word.isalpha():
                plain[word] = None
            else:
                stem = word.rstrip(_MARKS)
                # normalising may turn a letter into a letter and a mark, which would join the marks that follow
                if len(stem) < len(word) and stem.isalpha() and (stem.isascii() or unicodedata.normalize("NFC", stem).lower().isalpha()):
                    tail = word[len(stem) :]
                    marked.append((word, stem, tail))
                    got[stem], got[tail] = cache.get(stem), cache.get(tail)
                    if got[stem] is None:
                        plain[stem] = None
                    if got[tail] is None:
                        rest.add(tail)
                else:
                    rest.add(word)
        ascii_ = [w for w in plain if w.isascii()]
        wide = [w for w in plain if not w.isascii()]
        latin = [w for w in wide if _is_latin(w)]
        if len(latin) < len(wide):
            rest.update(set(wide).difference(latin))
        runs = [some[at : at + 1000] for some in (ascii_, latin) for at in range(0, len(some), 1000)]
        seen = [x if x.isascii() else x.encode().decode("latin-1").translate(_BYTES) for x in (" ".join(some).lower() for some in runs)]
        for some, found in zip(runs, self.letters.encode_batch_fast(seen, add_special_tokens=False), strict=True):
            ids = np.array(found.ids, dtype="<u4")
            ends = np.flatnonzero(self.is_end[ids]) + 1
            if len(ends) != len(some):
                rest.update(some)
                continue
            data, begin = ids.tobytes(), 0
            for word, end in zip(some, (4 * ends).tolist(), strict=True):
                got[word] = data[begin:end]
                begin = end
        odd = list(rest)
        for word, found in zip(odd, self.tokenizer.encode_batch_fast(odd, add_special_tokens=False), strict=True):
            got[word] = np.array(found.ids, dtype="<u4").tobytes()
        for word, stem, tail in marked:
            got[word] = got[stem] + got[tail]
        return got


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def token_pieces(
    docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Pieces of each document: key, piece, start, length, ids_crc32 (and ids, binary, if asked).

    A null or empty text has the end id alone.  Pieces but the last are ``capacity`` long.
    """
    end = np.array([END_ID], dtype="<u4").tobytes()
    width = 4 * capacity

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_path)
        for batch in batches:
            keys, column = batch.columns
            texts = ("" if x is None else x for at in range(0, len(column), BATCH_TEXTS) for x in column.slice(at, BATCH_TEXTS).to_pylist())
            rows = []
            for k, ids in enumerate(encoder.encoded(texts)):
                ids += end
                for piece, begin in enumerate(range(0, len(ids), width)):
                    part = ids[begin : begin + width]
                    rows.append((k, piece, begin // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            k, *out = zip(*rows, strict=True) if rows else [()] * 6
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            columns = {key: keys.take(pa.array(k, pa.int64()))}
            columns |= {name: pa.array(x, kind) for name, x, kind in zip(names, out, kinds, strict=False)}
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    kind = docs.schema[key].dataType.simpleString()
    names = ["piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(pieces, schema)


# A run is [first sequence, number of sequences, lengths in each of them, room left in each].
class Plan:
    """Runs of equal sequences, and where the pieces of each length go."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.used: dict[int, int] = defaultdict(int)  # pieces of a length that have a place
        self.places: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # length: (first piece, sequence, offset)
        self.room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room: runs (first sequence, number)

    def put(self, length: int, sequence: int, n: int, offset: int) -> None:
        self.places[length].append((self.used[length], sequence, offset))
        self.used[length] += n

    def open(self, lengths: list[int], n: int) -> None:
        """``n`` new sequences that hold ``lengths``."""
        offset = 0
        for length in lengths:
            self.put(length, self.sequences, n, offset)
            offset += length
        self.room[self.capacity - offset].append((self.sequences, n))
        self.sequences += n

    def best_fit(self, length: int, n: int) -> None:
        """``n`` pieces of ``length`` into the fullest sequences that have room, then into new ones."""
        fits = sorted(r for r, runs in self.room.items() if r >= length and runs)
        for room in fits:
            each = room // length
            while n and self.room[room]:
                first, many = self.room[room].pop()
                full = min(many, n // each)
                if full:
                    self.fill(first, full, room, length, each)
                    n -= full * each
                if full < many and n:
                    self.fill(first + full, 1, room, length, n)
                    full, n = full + 1, 0
                if full < many:
                    self.room[room].append((first + full, many - full))
            if not n:
                return
        each = self.capacity // length
        if n // each:
            self.open([length] * each, n // each)
        if n % each:
            self.open([length] * (n % each), 1)

    def fill(self, first: int, many: int, room: int, length: int, each: int) -> None:
        for k in range(each):
            self.put(length, first, many, self.capacity - room + k * length)
        self.room[room - each * length].append((first, many))


def configurations(sizes: list[int], counts: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Few sizes, many pieces: ([pieces of each size], sequences) by column generation, rounded down.

    Gilmore and Gomory's linear program, with the knapsack over ``capacity`` as pricing.
    """
    k = len(sizes)
    need = np.array(counts, dtype=float)
    columns = np.diag([capacity // s for s in sizes]).astype(float)
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    x = inverse @ need
    for _ in range(40 * k + 100):
        price = inverse.sum(axis=0)
        best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for s in np.argsort(sizes):  # unbounded knapsack, by size
            size, value = sizes[s], price[s]
            if value <= 0:
                continue
            for low in range(size, capacity + 1, size):
                high = min(low + size, capacity + 1)
                with_it = best[low - size : high - size] + value
                better = with_it > best[low:high] + 1e-12
                best[low:high][better] = with_it[better]
                choice[low:high][better] = s
        if best[capacity] <= 1 + 1e-7:
            break
        column, left = np.zeros(k), capacity
        while left > 0:
            s = choice[left]
            if s < 0:
                left -= 1
                continue
            column[s] += 1
            left -= sizes[s]
        move = inverse @ column
        ratio = np.where(move > 1e-9, x / np.where(move > 1e-9, move, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        columns[:, out] = column
        pivot = inverse[out] / move[out]
        inverse = inverse - np.outer(move, pivot)
        inverse[out] = pivot
        x = np.maximum(inverse @ need, 0)
    whole = np.floor(x + 1e-6).astype(int)
    return [(columns[:, j].astype(int).tolist(), int(whole[j])) for j in range(k) if whole[j]]


def plan_lengths(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = 96, small: int | None = None) -> Plan:
    """Where the pieces of each length go.  Works on counts: its cost hangs on the number of lengths, not pieces."""
    small = capacity // 4 if small is None else small
    plan = Plan(capacity)
    if histogram.get(capacity):
        plan.open([capacity], histogram[capacity])
    large = sorted((s for s in histogram if small < s < capacity and histogram[s]), reverse=True)
    total = sum(histogram[s] for s in large)
    members: list[list[list[int]]] = []  # groups of [length, pieces], largest first
    room = 0
    for s in large:
        if room <= 0:
            members.append([])
            room = max(1, -(-total // groups))
        members[-1].append([s, histogram[s]])
        room -= histogram[s]
    rounded = [g[0][0] for g in members]
    left = [sum(n for _, n in g) for g in members]
    for pattern, n in configurations(rounded, left, capacity) if members else []:
        wanted = [j for j, a in enumerate(pattern) for _ in range(a)]
        while n:  # runs in which each place has one actual length
            n_of = {j: wanted.count(j) for j in set(wanted)}
            if any(left[j] < a for j, a in n_of.items()):
                break
            run, lengths, taken = n, [], defaultdict(int)
            for j in wanted:
                # the places of a group draw on its lengths in turn
                k, skip = 0, taken[j]
                while skip >= members[j][k][1]:
                    skip -= members[j][k][1]
                    k += 1
                lengths.append((j, k))
                taken[j] += 1
            for j, k in set(lengths):
                run = min(run, members[j][k][1] // lengths.count((j, k)))
            run = max(run, 1)
            plan.open([members[j][k][0] for j, k in lengths], run)
            for j, k in lengths:
                members[j][k][1] -= run
                left[j] -= run
            for j in n_of:
                members[j] = [m for m in members[j] if m[1]]
            n -= run
    rest = {s: histogram[s] - plan.used[s] for s in histogram if 0 < s < capacity}
    for s in sorted(rest, reverse=True):
        if rest[s]:
            plan.best_fit(s, rest[s])
    return plan


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    groups: int = 96,
) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    Nothing but the histogram of lengths and the plan (runs per length, at
    most a few per length and configuration) passes through the driver.  Pieces of one
    length are numbered in blocks (``common.numbered``), so a length shared by a third of
    all pieces is no hot key.  Null keys, repeated rows and
    empty tables need no care: rows never meet by key.
    """
    rows = positioned(token_pieces(docs, tokenizer_path, key, text, capacity))
    histogram = {int(r["length"]): int(r["n"]) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    pieces = numbered(rows, ["length"], "_number")
    plan = plan_lengths(histogram, capacity, groups)
    places = {s: tuple(np.array(c, dtype=np.int64) for c in zip(*p, strict=True)) for s, p in plan.places.items()}

    @F.pandas_udf("struct<sequence_id:long,offset:long>")
    def place(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence = np.zeros(len(length), dtype=np.int64)
        offset = np.zeros(len(length), dtype=np.int64)
        of, numbers = length.to_numpy(), number.to_numpy()
        order = np.argsort(of, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(of[order])) + 1):
            if rows.size:
                first, begin, at = places[int(of[rows[0]])]
                run = np.searchsorted(first, numbers[rows], side="right") - 1
                sequence[rows] = begin[run] + numbers[rows] - first[run]
                offset[rows] = at[run]
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return pieces.withColumn("_place", place("length", "_number")).select(
        key, "piece", "start", "length", "ids_crc32", F.col("_place.sequence_id").alias("sequence_id"), F.col("_place.offset").alias("offset")
    )
