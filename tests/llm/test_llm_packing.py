import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from cartpulse.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_word_encoder_equals_the_tokenizer():
    plain, ours, rng = Tokenizer.from_file(PATH), packing.WordEncoder(PATH), random.Random(1)
    parts = ["a", "It's", "don't", " ", "  ", "\n", "\t", "É", "é", "ΑΣ", "İ", "ß", "!!", "..", ".,", ",", "x1", "123", "\U0001f600", " ", "　",
             "<|endoftext|>", "<|STARTOFTEXT|>", "word", "日本", "ﬁ", "́", "ll", "'s", "'", "-", "_", "\x1c", "​", "A.", "B|", "ÿ", "µ", "Straße,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(4000)]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ours.encode(texts) == want


def test_letters_that_normalising_takes_apart_join_the_marks_after_them():
    plain, ours = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    texts = ["\u0958. \u0958!? a\u0958, \ufb1d;", "\u0130. \u0130!", "stone... stone%%% STONE*** \xc9t\xc9.##", "stone.<|endoftext|> stone|endoftext|>"]
    want = [np.array(plain.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    assert ours.encode(texts) == want


def test_words_that_come_once_are_not_kept():
    ours = packing.WordEncoder(PATH)
    once = ["".join(w) for w in itertools.product("abcdefgh", repeat=4)]
    ours.encode([" ".join([*once, "river", "stones,"]), "river stones,"])
    assert set(ours.cache) == {"river", "stones,"}


def test_the_word_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHED_WORDS", 500)
    plain, ours = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    for first in "abcdefgh":
        text = " ".join(first + "".join(w) for w in itertools.product("abcdefgh", repeat=3))
        assert ours.encode([text, text])[1] == np.array(plain.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert len(ours.cache) <= 500 + 512


@pytest.mark.parametrize("histogram", [{}, {2048: 3}, {5: 1}, {1: 5000}, {1025: 100, 1023: 100}, {700: 10, 600: 11, 1448: 10, 3: 7}, {2047: 4, 1: 4}])
def test_plan_places_every_piece_once(histogram):
    plan = packing.plan_lengths(histogram)
    used = np.zeros(plan.sequences, dtype=int)
    spans = []
    for length, many in histogram.items():
        runs = plan.places[length]
        assert runs[0][0] == 0 and [a[0] for a in runs] == sorted(a[0] for a in runs)
        for k, (first, sequence, offset) in enumerate(runs):
            n = (runs[k + 1][0] if k + 1 < len(runs) else many) - first
            used[sequence : sequence + n] += length
            spans += [(s, offset, offset + length) for s in range(sequence, sequence + n)]
    spans.sort()
    assert all(used > 0) and all(used <= 2048)
    for (a, _, end), (b, begin, _) in zip(spans, spans[1:], strict=False):
        assert begin == (end if a == b else 0)


def test_plan_is_close_to_the_bound():
    rng = random.Random(5)
    histogram: dict[int, int] = {}
    for _ in range(40_000):
        n = min(2047, max(4, int(rng.lognormvariate(6.3, 0.9))))
        histogram[n] = histogram.get(n, 0) + 1
    bound = sum(s * n for s, n in histogram.items()) / 2048
    assert packing.plan_lengths(histogram).sequences <= 1.01 * bound + 1


def test_pack_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["river", "of", "stones,", "bread"]) for _ in range(rng.randrange(1, 900)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, "stone " * 9000), (None, "bread"), (7, "again"), (7, "again"), *((300 + i, "same text") for i in range(300))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS length", "2 AS piece").repartition(4)
    got = packing.pack(docs, PATH).collect()
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for key, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((key, piece, start, len(part), zlib.crc32(part.tobytes())))
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(sequences) <= 1.03 * sum(w[3] for w in want) / 2048 + 1


def test_pieces_carry_their_ids(spark):
    docs = spark.createDataFrame([(1, "stone bread " * 2000)], "doc_id long, text string")
    rows = packing.token_pieces(docs, PATH, with_ids=True).collect()
    ids = b"".join(r.ids for r in sorted(rows, key=lambda r: r.piece))
    assert np.frombuffer(ids, dtype="<u4").tolist() == [*Tokenizer.from_file(PATH).encode("stone bread " * 2000, add_special_tokens=False).ids, 0]


def test_pack_empty_table(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
