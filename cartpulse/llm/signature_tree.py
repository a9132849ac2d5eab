"""N-gram Jaccard join with signature trees (Mamoulis, Cheung and Lian's similarity search, as a join).

A document is the set of its word n-grams.  Two documents link when
``den * |A and B| >= num * |A or B|``; linked documents share a component.

1. Equal sets are one class (a 64-bit hash of the set), so copies are never paired.
2. The root of the tree deals classes out.  Its entries are size ranges, and in each range the token space is cut
   into P parts.  Two linked sets of a range differ in at most H tokens, so at least P - H parts hold
   the same tokens in both: each set is filed under the hash of its tokens in each part,
   and every linked pair meets in a subtree (exactly: no sampling, no probability; keys and classes are cut to 48 bits
   there, and two that happen to be alike only make sets meet that are then compared).  A batch's keys leave it packed, one row
   per bucket of keys, as they are most of what this join moves.  Every set leaves out its P - H - 1 weakest parts, those
   with the fewest rare n-grams, by one order of all parts: at least one more part agrees, and the strongest of them stays in both.
   So documents that merely share a common passage, or an n-gram by chance, rarely meet: such meetings grow with the square
   of the table and would make most of it one subtree.  Which n-grams count as frequent is read off
   a bounded sample of texts; whatever it says, the same pairs are found, at another cost.
3. Classes that meet, directly or through others, form a subtree (connected components in Spark), and their texts
   are gathered.  In a subtree, hierarchical nodes hold OR-combined token bitmaps and size ranges; a dual
   traversal from the top prunes pairs of nodes whose maximum possible overlap can't reach the threshold, and
   pairs that are already in one component; what is left is compared exactly.
4. Subtrees above ``GROUP_TOKENS`` tokens are cut into blocks, and every pair of blocks is a task of its own, so no
   task holds more than two blocks (or one text, if it is longer).  Links found in block pairs meet in a second
   run of connected components.

A group of near copies that is a third of all rows costs a number of block pairs that grows with the square
of its blocks; no way without that is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import at_most, component_roots, written
from cartpulse.operators.prefilter import maybe_among

GROUP_TOKENS = 1_000_000  # n-grams of a block: 8 MB of hashes
LEAF = 32
BITMAP_WORDS = 64  # 64-bit words of a bitmap: 4096 bits
RANGE = 1.25  # ratio of the ends of a size range
SAMPLE_TEXTS = 4096  # texts in which frequent n-grams are looked for: those that two of them share
FREQUENT = 400_000  # at most so many, the most frequent ones
CACHED_WORDS = 500_000
BUCKET_CHARS = 5_000_000  # characters of text whose keys share a bucket: about half a million keys
SPARE = 2  # one part more for every two tokens that may differ, as many as are left out
HELD_KEYS = 400_000  # keys that a task holds before it packs them: a few MB
PACKED_BITS = 48  # of a key (beyond those that choose its bucket) and of a class

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_S = np.uint64(29)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_words = _Words()


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _S)) * _A
    x = (x ^ (x >> _S)) * _B
    return x ^ (x >> _S)


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of the whole text.

    A-Z are lower-cased, words are runs of anything but ASCII white space.  Fewer than ``n``
    words: the whole sequence is the one n-gram.  No word: none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(_words.__getitem__, words), dtype=np.uint64, count=len(words))
    width = min(n, len(words))
    count = len(words) - width + 1
    out = np.full(count, width, dtype=np.uint64)
    for k in range(width):
        out = mixed(out + hashes[k : k + count])
    return np.unique(out)


def set_hash(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes())


class Ranges:
    """Size ranges, and how many parts and spare parts each has."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]

    def of(self, size: int) -> list[int]:
        """The ranges a set of ``size`` is filed in: its own, and the next if a partner can be there."""
        largest = size * self.den // self.num
        while self.low[-1] <= largest:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * max(RANGE, self.den / self.num))))
        own = int(np.searchsorted(self.low, size, side="right")) - 1
        return [own] + [own + 1] * (largest >= self.low[own + 1])

    def parts(self, k: int) -> tuple[int, int]:
        """(P, spare) of range k; P is 0 where linked sets are equal ones."""
        while len(self.low) <= k + 1:
            self.low.append(max(self.low[-1] + 1, math.ceil(self.low[-1] * max(RANGE, self.den / self.num))))
        most = 2 * (self.low[k + 1] - 1)
        differ = (self.den - self.num) * most // (self.den + self.num)
        if not differ:
            return 0, 0
        spare = 1 + differ // SPARE
        return differ + 1 + spare, spare


def part_keys(tokens: np.ndarray, ranges: Ranges, frequent: np.ndarray | None = None) -> np.ndarray:
    """The keys a set is filed under.  ``frequent``: sorted hashes of n-grams that make no part stronger."""
    out = []
    rare = np.ones(len(tokens), dtype=bool)
    if frequent is not None and len(frequent):
        at = np.searchsorted(frequent, tokens)
        at[at == len(frequent)] = 0
        rare = frequent[at] != tokens
    for k in ranges.of(len(tokens)):
        parts, spare = ranges.parts(k)
        if not parts:
            continue
        part = (tokens % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        sizes = np.bincount(part, minlength=parts)
        ends = np.cumsum(sizes)
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mixed(tokens[order]), dtype=np.uint64)])
        keys = sums[ends] - sums[ends - sizes]
        keys = mixed(keys + mixed(np.arange(parts, dtype=np.uint64) + np.uint64(k << 32)))
        # both of a pair leave out their ``spare`` weakest parts by one order: the strongest of the parts that agree stays in both
        strength = np.bincount(part[rare], minlength=parts)
        out.append(keys[np.lexsort((keys, strength))[spare:]])
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _packed(keys: np.ndarray, owners: np.ndarray) -> bytes:
    """``PACKED_BITS`` of each key and of its owner, 12 bytes a pair."""
    pairs = np.stack([keys, owners], axis=1).astype("<u8").view(np.uint8).reshape(-1, 2, 8)
    return pairs[:, :, : PACKED_BITS // 8].tobytes()


def _unpacked(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    narrow = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(-1, 2, PACKED_BITS // 8)
    wide = np.zeros((len(narrow), 2, 8), dtype=np.uint8)
    wide[:, :, : PACKED_BITS // 8] = narrow
    pairs = wide.view("<u8")[:, :, 0].astype(np.int64)
    return pairs[:, 0], pairs[:, 1]


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)


def _by_bucket(keys: list[np.ndarray], owners: list[int], buckets: int) -> tuple[np.ndarray, pa.Array]:
    """Buckets, and their packed keys: each key with the smallest of its owners, to whom the others are tied by a key of the two."""
    key, owner = np.concatenate(keys), np.repeat(np.array(owners, dtype=np.uint64), [len(k) for k in keys])
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.concatenate([[True], key[1:] != key[:-1]])
    head = owner[first][np.cumsum(first) - 1]
    ties = np.unique(np.stack([owner[~first], head[~first]], axis=1), axis=0)
    tied = mixed(ties[:, 0] + mixed(ties[:, 1]))
    key = np.concatenate([key[first], tied, tied])
    owner = np.concatenate([owner[first], ties[:, 0], ties[:, 1]])
    place = _bucket(key, buckets)
    order = np.argsort(place, kind="stable")
    places, starts = np.unique(place[order], return_index=True)
    ends = [*starts[1:].tolist(), len(order)]
    packed = _packed(key[order], owner[order])
    wide = 2 * PACKED_BITS // 8
    return places, pa.array([packed[i * wide : j * wide] for i, j in zip(starts.tolist(), ends, strict=True)], pa.binary())


def _file(n: int, num: int, den: int, frequent: np.ndarray, buckets: int):
    """Per batch: a row (bucket, class, document) per document; per ``HELD_KEYS`` keys a row (bucket, packed keys and classes) per bucket.

    Of the classes held that share a key only the smallest is filed under it; the others are tied to
    that one by a key of the two.  So a key shared by a third of all rows leaves a task once for so many keys.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges(num, den)
        for batch in batches:
            doc = batch.column("_key")
            schema = pa.schema([("bucket", pa.int64()), ("packed", pa.binary()), ("class", pa.int64()), ("doc", doc.type), ("size", pa.int64())])

            def row_per_bucket(keys: list[np.ndarray], owners: list[int], schema: pa.Schema = schema) -> pa.RecordBatch:
                places, packed = _by_bucket(keys, owners, buckets)
                return pa.record_batch([places, packed, *(pa.nulls(len(places), schema.field(c).type) for c in ("class", "doc", "size"))], schema=schema)

            classes, sizes, seen = [], [], set()
            keys, owners, held = [], [], 0
            for text in batch.column("_text"):
                tokens = shingles(text.as_py(), n)
                sizes.append(len(tokens))
                h = set_hash(tokens) if len(tokens) else 0
                classes.append(h)
                if len(tokens) and h not in seen:
                    seen.add(h)
                    own = part_keys(tokens, ranges, frequent)
                    if len(own):
                        keys.append(own)
                        owners.append(h)
                        held += len(own)
                if held >= HELD_KEYS:
                    yield row_per_bucket(keys, owners)
                    keys, owners, held = [], [], 0
            if keys:
                yield row_per_bucket(keys, owners)
            classes = np.array(classes, dtype=np.uint64)
            spread = _bucket(mixed(classes + mixed(np.arange(len(classes), dtype=np.uint64))), buckets)
            none = pa.nulls(len(classes), pa.binary())
            yield pa.record_batch([spread, none, classes.view(np.int64), doc, np.array(sizes, dtype=np.int64)], schema=schema)

    return run


def _meet(table: pa.Table) -> pa.Table:
    """A bucket's documents as they are, and (class, least) for classes under one key, least the smallest of them; both cut to ``PACKED_BITS``."""
    docs = table.filter(table.column("packed").is_null())
    doc = docs.column("doc")
    out = [docs.column("class"), doc, docs.column("size"), pa.nulls(len(docs), pa.int64())]
    names = ["class", "doc", "size", "least"]
    own = pa.table(out, names=names)
    if not (packed := table.column("packed").drop_null().to_pylist()):
        return own
    key, owner = _unpacked(packed)
    order = np.argsort(key)
    key, owner = key[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    least = np.repeat(np.minimum.reduceat(owner, starts), np.diff(np.append(starts, len(key))))
    ties = np.unique(np.stack([owner, least], axis=1)[owner != least], axis=0)
    none = [pa.nulls(len(ties), doc.type), pa.nulls(len(ties), pa.int64())]
    return pa.concat_tables([own, pa.table([pa.array(ties[:, 0]), *none, pa.array(ties[:, 1])], names=names)])


class Tree:
    """Levels of nodes over sorted sets, leaves first: OR-combined bitmaps, size ranges, and slack.

    Slack is the most by which a set's size exceeds the number of its bits (tokens that share a bit).
    """

    def __init__(self, sets: list[np.ndarray]):
        # similar sets next to each other: by smallest hashes
        order = sorted(range(len(sets)), key=lambda i: (sets[i][:2].tolist(), len(sets[i])))
        self.ids = order
        self.sets = [sets[i] for i in order]
        bits = np.zeros((len(sets), BITMAP_WORDS), dtype=np.uint64)
        for i, tokens in enumerate(self.sets):
            at = (mixed(tokens) % np.uint64(64 * BITMAP_WORDS)).astype(np.int64)
            np.bitwise_or.at(bits[i], at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        size = np.array([len(s) for s in self.sets], dtype=np.int64)
        slack = size - np.bitwise_count(bits).sum(axis=1, dtype=np.int64)
        self.levels = [(bits, size, size, slack)]
        width = LEAF
        while len(self.levels[-1][1]) > 1:
            b, low, high, s = self.levels[-1]
            at = np.arange(0, len(low), width)
            self.levels.append((
                np.bitwise_or.reduceat(b, at, axis=0), np.minimum.reduceat(low, at),
                np.maximum.reduceat(high, at), np.maximum.reduceat(s, at),
            ))
            width = 4

    def width(self, level: int) -> int:
        return LEAF if level == 1 else 4


class Links:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.root(i), self.root(j)
        self.up[max(a, b)] = min(a, b)


def join_trees(a: Tree, b: Tree, num: int, den: int, links: Links, shift_a: int = 0, shift_b: int = 0) -> None:
    """Dual traversal: links every pair (one of ``a``, one of ``b``) that reaches the threshold, unless already connected.

    ``links`` works on positions of the sets as the trees were given them, plus the shifts.
    """
    same = a is b
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        if la > 1 or lb > 1 or (la == 1) != (lb == 1):
            if la >= lb:
                kids = range(i * a.width(la), min((i + 1) * a.width(la), len(a.levels[la - 1][1])))
                pairs = [(la - 1, k, lb, j) for k in kids]
            else:
                kids = range(j * b.width(lb), min((j + 1) * b.width(lb), len(b.levels[lb - 1][1])))
                pairs = [(la, i, lb - 1, k) for k in kids]
            for pa, k, pb, m in pairs:
                if same and pa == pb and m > k:
                    continue
                if _possible(a.levels[pa], k, b.levels[pb], m, num, den):
                    stack.append((pa, k, pb, m))
            continue
        if la == 1:
            x = range(i * LEAF, min((i + 1) * LEAF, len(a.sets)))
            y = range(j * LEAF, min((j + 1) * LEAF, len(b.sets)))
        else:  # single sets
            x, y = range(i, i + 1), range(j, j + 1)
        bx, sx, _, _ = (v[x.start : x.stop] for v in a.levels[0])
        by, sy, _, _ = (v[y.start : y.stop] for v in b.levels[0])
        both = bx[:, None, :] & by[None, :, :]
        shared = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
        # every bit of one that the other lacks is a token that the other lacks
        ux = sx[:, None] - (np.bitwise_count(bx).sum(axis=1, dtype=np.int64)[:, None] - shared)
        uy = sy[None, :] - (np.bitwise_count(by).sum(axis=1, dtype=np.int64)[None, :] - shared)
        most = np.minimum(ux, uy)
        hopeful = (den + num) * most >= num * (sx[:, None] + sy[None, :])
        for p, q in zip(*np.nonzero(hopeful), strict=True):
            u, v = x.start + int(p), y.start + int(q)
            if same and v >= u:
                continue
            ia, ib = a.ids[u] + shift_a, b.ids[v] + shift_b
            if links.root(ia) != links.root(ib) and linked(a.sets[u], b.sets[v], num, den):
                links.join(ia, ib)


def _possible(x: tuple, i: int, y: tuple, j: int, num: int, den: int) -> bool:
    """Can some set below node i and some set below node j reach the threshold?"""
    low, high = int(x[1][i]) + int(y[1][j]), min(int(x[2][i]), int(y[2][j]))
    if num * max(int(x[1][i]), int(y[1][j])) > den * high:
        return False
    shared = int(np.bitwise_count(x[0][i] & y[0][j]).sum())
    most = min(high, shared + int(x[3][i]), shared + int(y[3][j]))
    return (den + num) * most >= num * low


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    both = int((b[at] == a).sum())
    return den * both >= num * (len(a) + len(b) - both)


def _compare(n: int, num: int, den: int):
    """One task's subtrees (or two blocks of one): each class tied to the smallest class it is connected with here."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for tree, rows in group.groupby("tree", sort=False):
            found = {}
            for text, name, block in zip(rows["_text"], rows["class"], rows["block"], strict=True):
                if name not in found:
                    tokens = shingles(text, n)
                    # rows that repeat a key with another text belong to another class
                    if set_hash(tokens) == int(name) % (1 << 64):
                        found[name] = (int(block), tokens)
            names = sorted(found)
            links = Links(len(names))
            blocks = sorted({found[k][0] for k in names})
            trees = {}
            for block in blocks:
                inside = [i for i, k in enumerate(names) if found[k][0] == block]
                trees[block] = (Tree([found[names[i]][1] for i in inside]), inside)
            for block, (t, inside) in trees.items():
                t.ids = [inside[i] for i in t.ids]
            if len(blocks) == 1:
                t = trees[blocks[0]][0]
                join_trees(t, t, num, den, links)
            elif blocks:
                join_trees(trees[blocks[0]][0], trees[blocks[1]][0], num, den, links)
            out += [(int(tree), k, names[links.root(i)]) for i, k in enumerate(names)]
        return pd.DataFrame(out, columns=["tree", "class", "near"]).astype({"tree": "int64", "class": "int64", "near": "int64"})

    return run


def frequent_shingles(docs: DataFrame, text: str, n: int) -> tuple[np.ndarray, int]:
    """Sorted hashes of the n-grams that at least two of ``SAMPLE_TEXTS`` different texts share (at most ``FREQUENT``); the characters of all texts."""
    texts = docs.select(F.col(text).alias("_text")).filter(F.length("_text") > 0)
    rows, chars = texts.agg(F.count(F.lit(1)), F.sum(F.length("_text").cast("long"))).first()
    share = int((1 << 30) * min(1.0, 0.95 * SAMPLE_TEXTS / max(rows, 1))) + 1
    sample = texts.filter(F.pmod(F.xxhash64("_text", F.lit(13)), F.lit(1 << 30)) < share).distinct().limit(SAMPLE_TEXTS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["_text"].tolist():
                yield pd.DataFrame({"token": shingles(t, n).view(np.int64)})

    counts = sample.mapInPandas(run, "token long").groupBy("token").count().filter("count > 1")
    found = counts.orderBy(F.desc("count"), "token").limit(FREQUENT).select("token").toPandas()
    return np.sort(found["token"].to_numpy(dtype=np.int64).view(np.uint64)), chars or 0


def jaccard_components(
    docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = 3, num: int = 9, den: int = 10
) -> DataFrame:
    """One row per row of ``docs``: key, n_shingles, component_id (smallest key reachable by links, itself included).

    Null, empty and blank texts have no n-gram and link with nothing: their component is themselves.
    Null keys take part, but are no component's id unless nothing else is there (then null).  Rows that
    repeat a key are rows of their own.  Other columns of ``docs`` play no part.
    """
    kind = docs.schema[key].dataType.simpleString()
    frequent, chars = frequent_shingles(docs, text, n)
    filed = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(
        _file(n, num, den, frequent, min(1 << 20, math.ceil(chars / BUCKET_CHARS) or 1)),
        f"bucket long, packed binary, class long, doc {kind}, size long",
    )
    # a bucket's keys lie side by side after one shuffle; a key's smallest class stands for it
    met = written(filed.groupBy("bucket").applyInArrow(_meet, f"class long, doc {kind}, size long, least long"), "jaccard-met")
    rows = met.filter("size is not null").select("class", "doc", "size")
    meeting = met.filter("size is null").select(F.col("class").alias("a"), F.col("least").alias("b")).distinct()
    subtrees = written(component_roots(meeting).select("node", F.col("root").alias("tree")), "jaccard-trees")

    named = (
        rows.filter("size > 0").withColumn("node", F.col("class").bitwiseAND(F.lit((1 << PACKED_BITS) - 1))).join(subtrees, "node").groupBy("class", "tree").agg(F.min("doc").alias("doc"), F.max("size").alias("size"))
    )
    members = written(named, "jaccard-members")
    totals = members.groupBy("tree").agg(F.sum("size").alias("total"))
    all_tokens = totals.agg(F.sum("total")).first()[0] or 0
    bins = max(1, math.ceil(4 * all_tokens / GROUP_TOKENS))
    sizes = totals.select("tree", F.ceil(F.col("total") / GROUP_TOKENS).cast("int").alias("blocks"))
    dealt = (
        members.join(sizes, "tree")
        .withColumn("block", F.when(F.col("blocks") == 1, 0).otherwise(F.pmod(F.xxhash64("class"), F.col("blocks"))).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("task", F.when(F.col("blocks") == 1, F.format_string("s%d", F.pmod(F.xxhash64("tree"), F.lit(bins)))).otherwise(
            F.format_string("b%d-%d-%d", "tree", F.least("block", "other"), F.greatest("block", "other"))))
        .select("doc", "class", "tree", "block", "blocks", "task")
    )
    # a block paired with itself is its own task; the pair (i, j) compares across only
    side = written(dealt, "jaccard-dealt")
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter(F.col("_text").isNotNull())
    if at_most(side):
        side = F.broadcast(side)
    else:  # texts that meet none stay where they are
        texts = maybe_among(texts.withColumn("_hash", F.xxhash64("_key")), side.select(F.xxhash64("doc").alias("_hash")), "_hash").drop("_hash")
    gathered = texts.join(side, F.col("_key").eqNullSafe(F.col("doc"))).select("_text", "class", "tree", "block", "task")
    near = written(
        gathered.groupBy("task").applyInPandas(_compare(n, num, den), "tree long, class long, near long"), "jaccard-near"
    )
    ties = near.filter("class <> near").select(F.col("class").alias("a"), F.col("near").alias("b")).distinct()
    final = component_roots(ties)

    placed = rows.join(final.select(F.col("node").alias("class"), "root"), "class", "left").withColumn(
        "root", F.coalesce("root", "class")
    )
    least = placed.filter("size > 0").groupBy("root").agg(F.min("doc").alias("component_id"))
    linked_rows = placed.filter("size > 0").join(least, "root").select("doc", "size", "component_id")
    alone = rows.filter("size = 0").select("doc", "size", F.col("doc").alias("component_id"))
    return linked_rows.unionByName(alone).select(F.col("doc").alias(key), F.col("size").alias("n_shingles"), "component_id")
