"""Prefix trie of conversations by fixed-length block hashing.

A node of depth d is a distinct sequence of the first d turns (role, text).  A sequence is known by its
depth and two 64-bit fingerprints: the XOR of hashes of (MD5 of the turn, position).  XOR takes parts in
any order, so a fingerprint comes from partial aggregates and running windows over short blocks, and no
conversation is ever gathered in one place.

1. Every conversation is cut into blocks of ``BLOCK`` turns; conversations are grouped by the digests of
   their successive blocks (one row per conversation and block is shuffled, not one per turn).
2. Where a group goes on with one block only, that block's turns are nodes with the group's members, as
   they stand.  Only where siblings diverge (several next blocks, one ending early included) their
   distinct blocks are opened into turns and grouped again.
3. Sums over subtrees need no walk by level.  Nodes with one member form plain chains.  Every other node
   is credited to its smallest member; a member's credits are summed once and added to the nodes above the
   one where it starts to be the smallest, which are the prefixes of its own blocks.

The result's rows are the nodes; member lists are hashed as a stream of sorted chunks, as SHA-256 can't be
computed in parts.  Hot keys (a conversation with a third of all turns, a third of conversations with one
first turn, thousands of copies) meet pre-aggregated rows, joins that adaptive execution can split, or
windows over at most 2**``SPAN_BITS`` rows.

Nulls: a null role or text counts as empty; a null turn number comes first; rows without ``conv_id``
belong to no conversation and are left out.  Turns with the same number are ordered by the MD5 of role and
text; repeated rows are turns of their own.  Other columns are ignored.  An empty table has no node.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartpulse.llm.common import numbered, positioned, released, written

# Turns of a block.
BLOCK = 4
# A running window holds at most 2**SPAN_BITS rows of one key.
SPAN_BITS = 12
# Ids of a chunk of a member list.
CHUNK_BITS = 12
NODE = ["depth", "f1", "f2"]
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, own (position of the turn in its conversation from 0), digest, n_chars: whole texts, one row per turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    narrow = written(
        conversations.filter(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").alias("turn"),
            F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
            F.char_length(text).cast("long").alias("n_chars"),
        ),
        "trie-turns",
    )
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    ordered = positioned(narrow.repartitionByRange(*order).sortWithinPartitions(*order))
    released(narrow)
    return numbered(ordered.drop("turn"), ["conv_id"], "own", block_bits=SPAN_BITS)


def regrafted(own: DataFrame, group: int = 100, heads: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt so that prefixes are shared: (conversations, their turns).

    With h = crc32(decimal conv_id) % ``heads``, conversation c starts with the first h turns of conversation
    c - c % ``group`` (SQL's remainder, of the sign of c; all if it has fewer, none if it is absent) and goes on with its own turns after its first h.
    Conversations: conv_id, length.  Turns: conv_id, length, depth (from 1), digest, n_chars.
    """
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")
    head = F.array_sort(F.collect_list(F.struct("own", "digest", "n_chars")))  # under ``heads`` turns
    firsts = own.filter(F.col("own") < heads - 1).groupBy(F.col("conv_id").alias("_first")).agg(head.alias("_turns"))
    counted = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("_n")).select("*", h.alias("_h"))
    convs = counted.join(firsts, F.col("conv_id") - F.col("conv_id") % group == F.col("_first"), "left").select(
        "conv_id", "_h", "_n", F.coalesce(F.slice("_turns", F.lit(1), F.col("_h")), F.array().cast(firsts.schema["_turns"].dataType)).alias("_head")
    )
    convs = convs.select("*", (F.size("_head") + F.greatest(F.col("_n") - F.col("_h"), F.lit(0))).cast("long").alias("length"))
    grafted = convs.select("conv_id", "length", F.inline("_head")).withColumn("depth", F.col("own") + 1)
    kept = (
        own.filter(F.col("own") >= h)
        .join(convs.select("conv_id", "length", (F.size("_head") - F.col("_h") + 1).alias("_shift")), "conv_id")
        .withColumn("depth", F.col("own") + F.col("_shift"))
    )
    columns = ["conv_id", "length", F.col("depth").cast("long"), "digest", "n_chars"]
    return convs.select("conv_id", "length"), grafted.select(*columns).unionByName(kept.select(*columns))


def _before(rows: DataFrame, key: str, order: str, op: str, names: dict[str, str]) -> DataFrame:
    """``rows`` plus, for each column of ``names``, its total over the key's rows before this one in the order of the
    number ``order``; ``op`` is ``bit_xor`` or ``sum``.

    Rows are summed inside spans of 2**SPAN_BITS numbers, and a span's start over the spans before it.
    """
    rows = rows.withColumn("_span", F.shiftright(order, SPAN_BITS))
    total = {c: F.expr(f"{op}({c})") for c in names}
    spans = rows.groupBy(key, "_span").agg(*[t.alias(c) for c, t in total.items()])
    over_spans = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    starts = spans.select(key, "_span", *[t.over(over_spans).alias(f"_start_{c}") for c, t in total.items()]).filter("_span > 0")
    inside = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = rows.select("*", *[t.over(inside).alias(f"_in_{c}") for c, t in total.items()]).join(starts, [key, "_span"], "left")
    sign = {"bit_xor": "^", "sum": "+"}[op]
    new = [F.expr(f"coalesce(_start_{c}, 0L) {sign} coalesce(_in_{c}, 0L)").alias(name) for c, name in names.items()]
    return both.select(*[c for c in rows.columns if c != "_span"], *new)


def blocks(rebuilt: DataFrame) -> DataFrame:
    """One row per conversation and block: conv_id, block (from 0), turns, p1, p2 (fingerprint before it), e1, e2 (with it),
    ends (the conversation's last one)."""
    keyed = rebuilt.select(
        "conv_id",
        "length",
        F.floor((F.col("depth") - 1) / BLOCK).cast("long").alias("block"),
        F.struct("depth", F.xxhash64("digest", "depth").alias("k1"), F.xxhash64("depth", "digest").alias("k2"), "n_chars").alias("turn"),
    )
    cut = keyed.groupBy("conv_id", "block").agg(
        F.array_sort(F.collect_list("turn")).alias("turns"),  # at most BLOCK
        F.bit_xor("turn.k1").alias("x1"),
        F.bit_xor("turn.k2").alias("x2"),
        F.first("length").alias("length"),
    )
    placed = _before(cut, "conv_id", "block", "bit_xor", {"x1": "p1", "x2": "p2"})
    ends = F.element_at("turns", -1)["depth"] == F.col("length")
    return placed.select(
        "conv_id", "block", "turns", "p1", "p2", F.expr("p1 ^ x1").alias("e1"), F.expr("p2 ^ x2").alias("e2"), ends.alias("ends")
    )


def _opened(rows: DataFrame, *keep: str) -> DataFrame:
    """The turns of blocks as nodes: depth, f1, f2 (with the turn), q1, q2 (before it), n_chars, last (of its block), and ``keep``."""
    running = [f"transform(turns, (t, i) -> aggregate(slice(turns, 1, i + 1), p{k}, (a, x) -> a ^ x.k{k})) AS r{k}" for k in "12"]
    flat = rows.selectExpr(*keep, "turns", *running).selectExpr(*keep, "r1", "r2", "size(turns) AS _size", "posexplode(turns) AS (_i, _turn)")
    return flat.selectExpr(
        *keep,
        "_turn.depth AS depth",
        "r1[_i] AS f1",
        "r2[_i] AS f2",
        "r1[_i] ^ _turn.k1 AS q1",
        "r2[_i] ^ _turn.k2 AS q2",
        "_turn.n_chars AS n_chars",
        "_i = _size - 1 AS last",
    )


def nodes(cut: DataFrame) -> DataFrame:
    """The nodes below the root: depth, f1, f2, q1, q2 (parent), n_convs, conv_id (smallest member), n_chars, n_ends.

    ``cut`` is :func:`blocks`.  Conversations are grouped by blocks; blocks beside others are opened into turns and grouped again.
    """
    here, way = ["block", "p1", "p2"], ["e1", "e2", F.size("turns").alias("size")]
    grouped = written(
        cut.groupBy(*here, *way).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.first("turns").alias("turns")
        ),
        "trie-blocks",
    )
    # All conversations start at the root: its blocks are always taken as diverging, so that no join meets its key.
    deeper = grouped.filter("block > 0")
    ways = deeper.groupBy(*here).agg((F.count(F.lit(1)) > 1).alias("diverge"))
    marked = deeper.join(ways, here).unionByName(grouped.filter("block = 0").withColumn("diverge", F.lit(True)))
    keep = ["n_convs", "conv_id", "n_ends", "diverge"]
    opened = _opened(marked, *keep).withColumn("n_ends", F.when(F.col("last"), F.col("n_ends")).otherwise(F.lit(0).cast("long"))).drop("last")
    chains = opened.filter("NOT diverge").drop("diverge")
    split = opened.filter("diverge").groupBy(*NODE).agg(
        F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"),
        F.sum("n_ends").alias("n_ends"),
        *[F.first(c).alias(c) for c in ("q1", "q2", "n_chars")],
    )
    out = written(chains.unionByName(split), "trie-nodes")
    released(grouped)
    return out


def _hashed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each node's chunks, which come in order, joined by commas: nothing but the running hash is held."""
    key, digest = None, None
    for frame in frames:
        done = []
        for *node, chunk in zip(*(frame[c] for c in (*NODE, "ids"))):
            if node != key:
                if key is not None:
                    done.append((*key, digest.hexdigest()))
                key, digest = node, hashlib.sha256(chunk.encode())
            else:
                digest.update(b"," + chunk.encode())
        yield pd.DataFrame(done, columns=[*NODE, "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=[*NODE, "ends_sha256"])


def member_hashes(ends: DataFrame) -> DataFrame:
    """depth, f1, f2, ends_sha256 from (depth, f1, f2, conv_id): the node's ids in numerical order, joined by commas, hashed.

    A global sort, chunks of at most 2**CHUNK_BITS neighbouring ids, then one stream of chunks per node.
    """
    order = [*NODE, "conv_id"]
    ordered = positioned(ends.repartitionByRange(*order).sortWithinPartitions(*order))
    chunks = (
        ordered.withColumn("chunk", F.shiftright("_pos", CHUNK_BITS))
        .groupBy(*NODE, "chunk")
        .agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string"))).alias("ids"))
    )
    streams = chunks.repartition(*NODE).sortWithinPartitions(*NODE, "chunk")
    return streams.select(*NODE, "ids").mapInPandas(_hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(convs: DataFrame, cut: DataFrame) -> DataFrame:
    """All nodes of the conversations ``convs`` (conv_id, length), whose written blocks are ``cut``.

    conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless
    nodes of the subtree), saved_tokens (over the subtree: members but one, times the code points of the last text), ends_sha256.
    """
    below = nodes(cut)
    tops = below.filter("depth = 1")
    root = (
        convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.count(F.when(F.col("length") == 0, 1)).alias("n_ends"))
        .crossJoin(tops.agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("n_single")))  # one row each
        .filter("n_convs > 0")
    )
    zero = F.lit(0).cast("long")
    kinds = [F.lit(0).cast("long").alias(c) for c in (*NODE, "n_chars")]
    shared = below.filter("n_convs > 1")
    parent = shared.select((F.col("depth") + 1).alias("depth"), F.col("f1").alias("q1"), F.col("f2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    # A parent with one member has the node's own only member.
    inner = below.filter("depth > 1").join(parent, ["depth", "q1", "q2"], "left")
    tree = written(
        inner.select("*", F.col("parent_conv_id").isNotNull().alias("under"))
        .withColumn("parent_conv_id", F.coalesce("parent_conv_id", "conv_id"))
        .unionByName(tops.crossJoin(F.broadcast(root.select(F.col("conv_id").alias("parent_conv_id")))).withColumn("under", F.lit(False))),  # one row
        "trie-tree",
    )
    kids = (
        tree.filter("under")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("f1"), F.col("q2").alias("f2"))
        .agg(F.count(F.lit(1)).alias("n_children"), F.count(F.when(F.col("n_convs") == 1, 1)).alias("n_single"))
    )
    many = tree.filter("n_convs > 1").drop("under", "q1", "q2").join(kids, NODE, "left")
    many = many.unionByName(root.select("*", *kinds, F.lit(None).cast("long").alias("parent_conv_id")))
    # What a shared node adds to its own subtree: chains that start below it (or itself, childless), and its saving.
    children, single = F.coalesce("n_children", zero), F.coalesce("n_single", zero)
    many = written(
        many.withColumn("n_children", children)
        .withColumn("leaves", F.when(F.col("n_children") == 0, 1).otherwise(single).cast("long"))
        .withColumn("saved", (F.col("n_convs") - 1) * F.col("n_chars"))
        .drop("n_single", "n_chars"),
        "trie-shared",
    )
    credit = many.groupBy("conv_id").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("depth").alias("start"))
    credit = written(credit, "trie-credit")
    paths = _opened(
        cut.join(credit.filter("start > 1"), "conv_id").filter(F.col("block") * BLOCK + 1 < F.col("start")), "leaves", "saved", "start"
    ).filter("depth < start")
    columns = [*NODE, "leaves", "saved"]
    above = credit.filter("start > 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "leaves", "saved")
    from_below = paths.select(*columns).unionByName(above).groupBy(*NODE).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
    before = _before(many, "conv_id", "depth", "sum", {"leaves": "leaves_before", "saved": "saved_before"}).drop("leaves", "saved")
    totals = before.join(credit.drop("start"), "conv_id").join(from_below, NODE, "left")
    ends = (
        cut.filter("ends")
        .select(F.element_at("turns", -1)["depth"].alias("depth"), F.col("e1").alias("f1"), F.col("e2").alias("f2"), "conv_id")
        .join(many.filter("depth > 0").select(*NODE), NODE, "left_semi")
        .unionByName(convs.filter("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in NODE], "conv_id"))
    )
    hashes = written(member_hashes(ends), "trie-hashes")
    shared_rows = totals.join(hashes, NODE, "left").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves") - F.col("leaves_before") + F.coalesce("more_leaves", zero)).alias("n_leaves"),
        (F.col("saved") - F.col("saved_before") + F.coalesce("more_saved", zero)).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_HASH)).alias("ends_sha256"),
    )
    own = F.when(F.col("n_ends") > 0, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(EMPTY_HASH))
    chain_rows = tree.filter("n_convs = 1").select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        (F.lit(1) - F.col("n_ends")).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"),
        own.alias("ends_sha256"),
    )
    return chain_rows.unionByName(shared_rows)


def prefix_trie(conversations: DataFrame, regraft: bool = True) -> DataFrame:
    """The trie of a table of turns (conv_id, turn, role, text); ``regraft`` as in :func:`regrafted`, else as they stand."""
    own = turns(conversations)
    if regraft:
        convs, rebuilt = regrafted(own)
    else:
        lengths = own.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
        convs, rebuilt = lengths, own.withColumn("depth", F.col("own") + 1).join(lengths, "conv_id")
    return trie(written(convs, "trie-conversations"), written(blocks(rebuilt), "trie-cut"))
