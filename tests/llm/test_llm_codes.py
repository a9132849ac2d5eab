import hashlib
import math

import numpy as np
import pytest

from cartpulse.llm import vector_codes

SCHEMA = "vec_id long, embedding array<double>, label int, state string, vector string, error string"


def brute(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, hash) of rows (vec_id, vector, label), in Python integers."""
    kept = [(k, v, t) for k, v, t in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // 4) * 4
    whole = [[int(x) * 1024 if abs(x) >= 1 << 53 else math.floor(x * 1024) for x in v] + [0] * (width - len(v)) for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))[:entries]
    each = width // 4
    codes, errors, books = [""] * len(kept), [0] * len(kept), []
    for p in range(4):
        parts = [v[p * each : (p + 1) * each] for v in whole]
        book = [parts[i] for i in first]

        def nearest(part):
            return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

        for _ in range(rounds):
            at = [nearest(part)[1] for part in parts]
            for e in set(at):
                mine = [part for part, i in zip(parts, at) if i == e]
                book[e] = [sum(column) // len(mine) for column in zip(*mine)]
        for r, part in enumerate(parts):
            error, i = nearest(part)
            codes[r] += f"{i:02x}"
            errors[r] += error
        books.append(book)
    by_label = {}
    for (_, _, t), e in zip(kept, errors):
        by_label[t] = by_label.get(t, 0) + e
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    top = (1 << 63) - 1
    return sorted(((k, c, min(e, top), min(by_label[t], top), digest) for (k, _, t), c, e in zip(kept, codes, errors)), key=str)


def held(spark, rows):
    table = spark.createDataFrame([(*r, "x", None, "y") for r in rows], SCHEMA).repartition(3)
    got = vector_codes.vector_codes(table)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in got.collect()), key=str)


def clouds(n, width, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, width))
    return [(int(i), [float(np.float32(x)) for x in centres[i % 40] + spread * rng.normal(size=width)], int(i) % 5) for i in rng.permutation(n)]


@pytest.mark.parametrize("b_first,b_least,b_most", [(16, 4, 32), (2, 1, 3)])
def test_equals_brute_force(spark, monkeypatch, b_first, b_least, b_most):
    for name, value in (("B_FIRST", b_first), ("B_LEAST", b_least), ("B_MOST", b_most)):
        monkeypatch.setattr(vector_codes, name, value)
    rows = clouds(900, 8, 5)
    rows += [(9000 + i, rows[0][1], None) for i in range(300)]  # one vector, very common
    rows += [(3, rows[7][1], 1), (3, rows[7][1], 1), (None, rows[9][1], 2), (-5, [0.0] * 8, None), (70, [], 3), (71, [0.5, -0.25], 3)]
    rows += [(80, None, 1), (81, [None] * 8, 1), (82, [math.nan] * 8, 1), (83, [math.inf] + [0.0] * 7, 1), (84, [1.0, None], 4)]
    assert held(spark, rows) == brute(rows)


def test_ties_few_rows_and_odd_widths(spark):
    rows = [(i, [float(x) for x in (i % 3, -i % 2, i % 5, 0.0, 0.5 / 1024)], i % 2) for i in range(40)]
    assert held(spark, rows) == brute(rows)
    assert held(spark, [(1, [], None), (2, [], 0)]) == brute([(1, [], None), (2, [], 0)])


def test_very_large_components(spark):
    rows = [(i, [1e30 * (i % 4), -3.4e38, 1.0, 0.1 * i], i % 2) for i in range(30)] + [(50, [1.7e308, 0.0, -1.7e308, 5e-324], 1)]
    assert held(spark, rows) == brute(rows)


def test_nothing_usable(spark):
    assert held(spark, []) == []
    assert held(spark, [(1, None, 1), (2, [None], 2)]) == []


def test_whole_table_and_decoding(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert sorted((tuple(r) for r in vector_codes.vector_codes(table).collect()), key=str) == brute(rows)
    coded, books = vector_codes.compress(vector_codes.usable(table))
    one = coded.orderBy("vec_id").first()
    back = vector_codes.decoded(one.code, books)
    exact = [math.floor(x * 1024) for x in dict((k, v) for k, v, _ in rows)[one.vec_id]]
    assert one.error == sum((round(a * 1024) - b) ** 2 for a, b in zip(back, exact))
