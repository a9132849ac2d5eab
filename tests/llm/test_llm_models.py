import random
import zlib

import numpy as np

from cartpulse.llm import cotraining, langid, toxicity

SF = "/root/testdata/sf0.01"
CLEAN = "the house stands by a river where children play and old people talk of weather and bread".split()


def test_held_out_rule(spark):
    df = spark.range(200).withColumnRenamed("id", "doc_id")
    got = {r.doc_id: r.h for r in df.select("doc_id", langid.held_out().alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(200)}


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r for r in langid.predict(docs, langid.train(docs)).collect()}
    rows = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) / len(rows) >= 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert sum(r.rejected for r in got.values()) <= 0.02 * len(got)


def test_language_edge_rows(spark):
    schema = "doc_id long, text string, lang string, score double, row int"
    texts = {"aa": "kano maru tiko", "bb": "zzek vrrol plinth"}
    rows = [(i, " ".join(random.Random(i).choices(texts[l].split(), k=30)), l, 0.5, 1) for i in range(40) for l in ("aa", "bb")]
    rows += [(100, None, "aa", None, None), (101, "", None, None, None), (102, "123 !!", "bb", None, None), (None, "kano maru", None, None, None), (103, "zzek " * 50_000, None, None, None)]
    docs = spark.createDataFrame(rows, schema)
    model = langid.train(docs)
    assert set(model) == {"aa", "bb"}
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in langid.predict(docs, model).collect() if r.doc_id is None or r.doc_id >= 100}
    assert {(100, "und", True), (101, "und", True), (102, "und", True), (103, "bb", False)} <= got
    kept = langid.accepted(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} >= {0, 39, 103} and not {100, 101, 102} & {r.doc_id for r in kept.collect()}
    nothing = langid.predict(docs, langid.train(docs.limit(0)))
    assert {r.lang_pred for r in nothing.collect()} == {"und"}
    assert langid.predict(docs.limit(0), model).count() == 0


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter("lang <> 'en'"))
    assert "en" not in model
    foreign = docs.filter("lang = 'en' AND length(text) >= 200")
    got = [r.rejected for r in langid.predict(foreign, model).collect()]
    assert sum(got) >= 0.9 * len(got)  # a margin of one byte rejected under a tenth of them
    known = [r.rejected for r in langid.predict(docs.filter("lang <> 'en'"), model).collect()]
    assert sum(known) <= 0.03 * len(known)
    rng = random.Random(1)
    noise = [(i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(100))) for i in range(100)]
    full = langid.train(docs)
    assert langid.accepted(spark.createDataFrame(noise, "doc_id long, text string"), full).count() <= 3


def test_number_signs_are_no_letters_and_marks_stay(spark):
    assert [langid.letters(t).strip() for t in ("½ ²", "Ⅷ", "①", "12 3", "\u0301", "_")] == [b""] * 6
    assert langid.letters("हिन्दी, Ça ½").decode() == " हिन्दी ça "
    docs = spark.createDataFrame([(i, "some words of a tongue", "aa") for i in range(40)] + [(50, "½ ²", "bb"), (51, "Ⅷ", "bb")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.rejected) for r in langid.predict(docs, langid.train(docs)).collect()}
    assert got[50] == got[51] == ("und", True) and got[0][0] == "aa"


def test_smallest_encoding_wins_and_ties_are_rejected():
    assert langid.judge([10, 12, 30], ["a", "b", "c"])[0] == "a"
    lang, score, margin = langid.judge([10, 10], ["a", "b"])
    assert (lang, score, margin) == ("a", 0.5, 0.0) and margin < langid.MARGIN_BYTES


def toxic_rows(n: int) -> list[tuple]:
    rng = random.Random(8)
    rows = []
    for i in range(n):
        words = rng.choices(CLEAN, k=60)
        if i % 5 == 0:
            words[rng.randrange(60)] = rng.choice(["scoundrel", "blockhead"])
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").selectExpr("*", "1 AS k", "2 AS y", "3 AS score")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].predicted == y for i, y in held)
    more = spark.createDataFrame([(1, None), (1, ""), (2, "blockhead " * 30_000), (None, "ok")], "doc_id long, text string")
    out = toxicity.score(more, model).collect()
    assert len(out) == 4 and all(0 <= r.score <= 1 for r in out)
    assert {r.predicted for r in out if r.doc_id == 2} == {1} and {r.predicted for r in out if r.doc_id == 1} == {0}
    assert toxicity.score(more.limit(0), model).count() == 0


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, model).collect()} == {0.5}


def test_features_are_distinct_and_whole():
    last = np.zeros(1 << toxicity.BITS, dtype=np.int32)
    text = "abc " * 40_000 + "finale"
    slots = toxicity.features(text, last)
    assert len(slots) == len(set(slots.tolist()))
    assert set(toxicity.features("finale", last).tolist()) & set(slots.tolist())
    assert len(toxicity.features("", last)) == 0


def test_quality_on_held_out_documents(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in cotraining.score(docs, cotraining.train(docs, labels)).collect()}
    held = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(p == y for p, y in held) / len(held) >= 0.93
    assert len(got) == docs.count()


def test_quality_edge_rows(spark):
    docs = spark.createDataFrame([(1, None, None), (1, "", -5), (None, "x " * 50_000, 3)], "doc_id long, text string, n_chars long").selectExpr("*", "1 AS k", "2 AS t")
    model = cotraining.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    out = cotraining.score(docs, model).collect()
    assert len(out) == 3 and {r.score for r in out} == {0.5}
    assert cotraining.score(docs.limit(0), model).count() == 0


def test_views_exchange_labels():
    rng = np.random.default_rng(2)
    y = (rng.random(80) < 0.5).astype(float)
    pool_y = (rng.random(800) < 0.5).astype(float)
    view = lambda t, s: t[:, None] * 3 + rng.standard_normal((len(t), 4)) * s
    model = cotraining.co_train([view(y, 1.5), view(y, 1.5)], y, [view(pool_y, 1.5), view(pool_y, 1.5)])
    test_y = (rng.random(500) < 0.5).astype(float)
    scores = model.scores([view(test_y, 1.5), view(test_y, 1.5)])
    assert ((scores >= 0.5) == test_y).mean() >= 0.95
    alone = model.views[0].logit(view(test_y, 1.5)) >= 0
    assert ((scores >= 0.5) == test_y).mean() >= (alone == test_y).mean() - 0.02
