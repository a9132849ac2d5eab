import hashlib
import zlib
from collections import defaultdict

import pytest

from cartpulse.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, _pos string, block string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows, regraft=True):
    """The nodes of rows (conv_id, turn, role, text) from plain dictionaries."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own[conv].append(((turn is not None, turn or 0, mark), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6 if regraft else 0
        path = tuple(own.get(int(c / 100) * 100, [])[:h] + own[c][h:] if regraft else own[c])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[k] for k in children[node]]
        saved = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        totals[node] = (sum(x for x, _ in below) or 1, saved + sum(x for _, x in below))
    return sorted(
        (
            min(members[n]),
            len(n),
            min(members[n[:-1]]) if n else None,
            len(members[n]),
            len(children[n]),
            *totals[n],
            hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest(),
        )
        for n in members
    )


def held(spark, rows, regraft=True):
    table = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(5)
    got = prefix_trie.prefix_trie(table, regraft)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[:2])


@pytest.mark.parametrize("regraft,span_bits,chunk_bits", [(True, 1, 1), (False, 12, 2)])
def test_equals_brute_force(spark, monkeypatch, regraft, span_bits, chunk_bits):
    monkeypatch.setattr(prefix_trie, "SPAN_BITS", span_bits)
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", chunk_bits)
    rows = []
    for c in range(0, 320, 1 if span_bits == 12 else 2):
        if c == 100:
            continue  # its hundred has no first conversation
        for t in range(1 + (c * 7) % 11):
            role = None if (c + t) % 13 == 0 else ("user", "assistant")[t % 2]
            text = [None, "", "hello", "ça va?", "x" * 300, "🙂 ok"][(t * t + c // 40) % 6] if c % 5 else f"own {c} {t}"
            rows.append((c, t if t else None, role, text))
    rows += [(1000 + c, t, "user", f"copy {t}") for c in range(40) for t in range(9)]  # copies, all alike from their own turns on
    rows += [(-7, 0, "user", "negative"), (2_000_000, 3, "user", "alone"), (2_000_000, 3, "user", "alone")]  # repeated row
    rows += [(None, 0, "user", "no conversation")] * 5
    rows += [(5000, t, "user", f"turn {t}") for t in range(200)]  # long
    rows += [(5001, t, "user", f"turn {t}") for t in range(150)]
    rows += [(7000, 1, "user", "same turn number a"), (7000, 1, "user", "same turn number b"), (7100, 0, "user", "word " * 50_000)]
    assert held(spark, rows, regraft) == sorted(brute(rows, regraft), key=lambda r: r[:2])


def test_one_conversation_and_none(spark):
    assert held(spark, [(None, 0, "user", "x")]) == []
    for rows in ([(101, 0, None, None)], [(c, 0, "user", "same") for c in (100, 200, 300)]):
        assert held(spark, rows) == sorted(brute(rows), key=lambda r: r[:2])


def test_whole_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in table.collect()]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(table).collect()), key=lambda r: r[:2])
    assert got == sorted(brute(rows), key=lambda r: r[:2])
