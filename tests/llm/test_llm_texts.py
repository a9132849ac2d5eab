import random

import brute
import pytest

from cartpulse.llm import decontamination, licenses, pii



def personal_rows() -> list[tuple]:
    rng = random.Random(2)
    parts = ["a@b.c", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 222-3333", "é", "\U0001f600 ", " ", "\n", "x", "9", "-", "+", ".", "@",
             "300.1.1.1", "007.0.0.1", "ab.c%d@e-f.gh.", "5500-0000-0000-0004", "word", "call", "%", "_d@e.f"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(1, 40)))) for i in range(150)]
    rows += [(5000, None), (5001, ""), (5002, "a" * 200_000), (5003, "a@b.c " * 60), (5004, "1." * 200), (5005, "1 " * 2000)]
    rows += [(5006, "a." * 2000 + "@" + "b." * 2000), (5007, "+" + "1 " * 2000), (None, "mail a@b.c now"), (7, "dup 1.2.3.4"), (7, "dup 1.2.3.4")]
    return rows


def test_base_spans_equal_python(spark):
    rows = personal_rows()
    got = pii.detect(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS row", "2 AS id").repartition(4)).collect()
    want = sorted(((k, *brute.personal(t)) for k, t in rows), key=str)
    have = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("term:"))) for r in got), key=str)
    assert have == want


def test_terms_that_disclose_are_masked(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200))) for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(words) for _ in range(100)) + f" mailbox q{i}@x.org " + " ".join(rng.choice(words) for _ in range(100))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS row", "'k' AS told")
    found = {r.doc_id: r for r in pii.detect(docs).collect()}
    texts = dict(rows)
    for i in range(30):
        start = texts[1000 + i].index("mailbox")
        assert f"term:{start}:{start + 7}" in found[1000 + i].spans.split(",")
        assert found[1000 + i].n_term <= 2
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    after = {r.doc_id: r.text for r in clean.collect()}
    assert all(after[i] == texts[i] for i in range(200))
    assert all("@" not in after[1000 + i] and "mailbox" not in after[1000 + i] and "[EMAIL]" in after[1000 + i] for i in range(30))


def test_flagged_terms_are_masked_in_the_whole_document(spark):
    rng = random.Random(4)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(300)) for i in range(400)] + [(399, "a mailbox without any address " + text(50))]
    rows += [(1000 + i, f"Mailbox {text(60)} mailbox q{i}@x.org {text(60)} Mailbox") for i in range(30)]
    rows += [(2000 + i, f"{text(100)} zimmerli r{i}@x.org {text(100)} zimmerli") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    after = {r.doc_id: r.text for r in pii.sanitise(docs.filter("doc_id <> 399")).collect()}
    assert all("mailbox" not in after[1000 + i].lower() and "[EMAIL]" in after[1000 + i] for i in range(30))
    assert all("zimmerli" not in after[2000 + i] for i in range(3))  # fewer than SUPPORT contexts
    assert all(len(after[1000 + i].split()) >= 100 for i in range(30))
    kept = {r.text for r in pii.sanitise(docs).collect()}
    assert rows[400][1] in kept  # no entity, nothing to disclose


def test_masks_never_leave_a_span(spark):
    rows = [r for r in personal_rows() if r[1] and len(r[1]) < 2000]
    after = {}
    for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        after.setdefault(r.doc_id, []).append(r.text)
    for key, text in rows:
        spans = [s.split(":") for s in brute.personal(text)[-1].split(",") if s]
        for _, start, end in spans:
            if int(end) - int(start) > 6:  # short ones may stand elsewhere by chance
                piece = text[int(start) : int(end)]
                assert sum(t.count(piece) for t in after[key]) <= sum(t.count(piece) for k, t in rows if k == key) - 1


def test_texts_are_written_once(spark):
    rows = [(1, "write to jane@example.org or 10.0.0.1 now"), (2, "nothing here"), (None, None), (1, "call +1 415 555 0100"), (3, "")]
    near, _ = pii.find(spark.createDataFrame(rows, "doc_id long, text string"))
    stored = spark.read.parquet(*near.inputFiles())
    assert [f.name for f in stored.schema if f.dataType.simpleString() == "string" and f.name != "id"] == []
    assert sorted((r.name, r.text_) for r in near.select("name", "text_").collect()) == [(1, rows[3][1]), (1, rows[0][1])]


def test_personal_data_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pii.detect(empty).count() == 0 and pii.sanitise(empty).count() == 0


ITEMS = [
    (1, "A train leaves Boston at 5 pm and travels 60 miles per hour toward Chicago for 3 hours, how far is Boston then?"),
    (2, None), (3, "too short"), (4, "seven plus nine makes how many?"), (5, "seven plus nine makes how many?"),
]


def test_templates_catch_changed_questions(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    changed = "A train leaves Denver at 7 pm and travels 80 miles per hour toward Dallas for 4 hours, how far is {} then?"
    rows = [
        (1, "Intro words here. " + changed.format("Denver") + " End."), (2, changed.format("Boston")), (3, None), (4, ""), (5, "x " * 50_000),
        (6, "ask: seven plus nine makes how many? ok"), (6, "ask: seven plus nine makes how many? ok"),
        (None, "Seven plus nine makes how many?"), (7, ITEMS[0][1]), (8, "A train leaves Boston and nothing else is alike here at all, is it?"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS item", "'q' AS name", "0 AS hash")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(1, 1, "reparameterised"), (7, 1, "verbatim"), *((d, i, "verbatim") for d in (6, None) for i in (4, 5))}
    left = decontamination.without_leaks(docs, items)
    assert left.columns == docs.columns
    # 2 has the template, but "Boston" and "Denver" stand for one name: not the item with other values
    assert sorted(r.doc_id for r in left.collect()) == [2, 3, 4, 5, 8]


def test_numbers_that_are_equal_by_chance_hide_no_item(spark):
    same = "Anna has a bag with {} red and {} blue marbles in it and takes one out without looking, what is the chance of red?"
    rows = [(1, same.format(5, 8)), (2, same.format(4, 4)), (3, same.format(3, 3)), (4, same.replace("Anna", "Otto").format(7, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, same.format(3, 3)), (2, same.format(5, 3))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.kind, r.coverage) for r in decontamination.leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 3, 4) for i in (1, 2)}
    assert got[3, 1] == ("verbatim", 1.0) and got[1, 2] == ("reparameterised", 1.0)
    assert 0.9 < got[1, 1][1] < 1 and got[1, 1][0] == "reparameterised"  # the slot of 8 goes against 3 -> 5
    assert decontamination.without_leaks(docs, items).count() == 0


def test_verbatim_items_of_numbers_names_and_few_words_are_found(spark):
    texts = [
        "Compute 12 * 7 + 5 - 3 * 2", "Choose among Anna Karenina, Emma Bovary, Effi Briest, Jane Eyre, Moby Dick and Don Quixote now",
        "1) 12 2) 15 3) 18 4) 21 5) 24", "Who wrote Hamlet?", "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u3002", "Seven plus nine makes how many?", "Add 3 + 4 quickly",
    ]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    rows = [(i, f"some words before: {t} And after, some 9 words.") for i, t in enumerate(texts)]
    rows += [(50, "Compute 13 * 7 + 5 - 3 * 2"), (51, "Who wrote Macbeth?"), (52, "Seven plus 9 makes how many?"), (53, "Add 3 + 5 quickly"), (54, "7")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.kind) for r in decontamination.leaks(docs, items).collect()}
    assert got == {(i, i, "verbatim") for i in range(len(texts))}


def test_items_of_one_word_count_as_answers_of_their_own(spark):
    items = spark.createDataFrame([(1, "Yes"), (2, "C++ (1998)."), (3, "No way!")], "item_id long, text string")
    rows = [(1, "yes we can, said the man"), (2, "The answer is yes indeed."), (3, "Is it so?\nYes.\nThen go."), (4, "Answer: Yes"), (5, "Yes"), (6, "there is no way out of here")]
    rows += [(7, "No way! He said."), (8, "written in c++  (1998) then"), (9, "Language: C++ (1998)."), (10, None), (11, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == {(3, 1), (4, 1), (5, 1), (7, 3), (9, 2)}
    assert sorted(r.doc_id for r in decontamination.without_leaks(docs, items).collect()) == [1, 2, 6, 8, 10, 11]


def test_contained_items_are_found_in_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, t in texts if t in r.text}
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).collect()} == want


def test_decontamination_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.leaks(docs, items).count() == 0
    some = spark.createDataFrame([(1, "a b c d e f g h i j")], "doc_id long, text string")
    assert decontamination.without_leaks(some, items.limit(0)).count() == 1


def dice(body: str) -> list[tuple]:
    a = set(licenses.bigrams(body))
    out = []
    for name, text in licenses.TEMPLATES.items():
        b = set(licenses.bigrams(text))
        if a and 2 * len(a & b) / (len(a) + len(b)) >= licenses.THRESHOLD:
            out.append((-2 * len(a & b) / (len(a) + len(b)), name))
    return sorted(out)


def test_license_units_equal_brute_force(spark):
    rng = random.Random(6)
    rows = []
    for name, body in licenses.TEMPLATES.items():
        for cuts in range(4):
            words = body.split()
            for _ in range(cuts):
                words[rng.randrange(len(words))] = rng.choice(["", "other", "it's"])
            rows.append((len(rows), f"First line of {name}\n{' '.join(words).upper()}\n\nlast"))
    rows += [(900, None), (900, ""), (901, "\n\n \n"), (902, "word " * 50_000), (None, licenses.TEMPLATES["ISC-grant"].replace(" ", "\n")), (903, "Released under the MIT License. " * 40)]
    got = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS unit", "'b' AS body")).collect()
    import re

    want = []
    for key, text in rows:
        if text is None:
            continue
        lines, paragraphs = text.split("\n"), re.split(r"\n[ \t]*\n", text)
        units = [("line", i, x) for i, x in enumerate(lines)]
        units += [("paragraph", i, x) for i, x in enumerate(paragraphs) if len(paragraphs) > 1 and "\n" in x.strip("\n")]
        units += [("text", 0, text)] if len(lines) > 1 else []
        want += [(key, level, i, best[0][1], -best[0][0]) for level, i, x in units if (best := dice(x))]
    assert sorted(((r.doc_id, r.level, r.unit, r.license_id, r.dice) for r in got), key=str) == sorted(want, key=str)


def test_notices_inside_other_words_are_found(spark):
    header = licenses.TEMPLATES["Apache-2.0-header"].split()
    wrapped = "\n".join(["package org.foo;", "import x.y.z;", *(" * " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9)), "public class Foo {", "int a;", "}"] + [f"x{i} = y{i} + z{i};" for i in range(60)])
    rows = [
        (1, "Copyright 2020 Foo. Released under the MIT License. All rights reserved."),
        (2, "We like it. This work is licensed under the GNU General Public License, version 3. Come and see us on Monday morning, please do."),
        (3, wrapped), (4, "Released under the MIT License."), (5, "First\nReleased under the MIT License.\nlast"),
        (6, "Released under the terms of any other thing."), (7, None), (8, ""), (9, "a, Released under the MIT License, b, Released under the MIT License, c d e f g h i j"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.unit, r.license_id, r.dice) for r in licenses.windows(docs).collect())
    assert got == [(1, 3, "MIT-notice", 1.0), (2, 3, "GPL-3.0-notice", 1.0), (3, 7, "Apache-2.0-header", 1.0), (9, 1, "MIT-notice", 1.0), (9, 7, "MIT-notice", 1.0)]
    assert {r.doc_id for r in licenses.scan(docs).collect()} & {1, 2, 9} == set()


@pytest.mark.parametrize("name", ["op3_license_dice", "op6_template_windows"])
def test_sql_gives_the_same(spark, name):
    import duckdb

    from cartpulse.llm import queries

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '/root/testdata/sf0.001/{table}.parquet'")
    have = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, have.collect())) == sorted(con.execute(queries.ORACLE_SQL[name]).fetchall())
