"""Benchmark decontamination by template canonicalisation.

Texts become sequences of words in which numbers, names (capitalised words inside a sentence) and units are
typed placeholders.  Windows of ``WINDOW`` such tokens of the documents are hash-joined with those of the benchmark
items, so that a question with other numbers or names still meets its template.  Where a document covers
enough of an item, the slots are checked: within an alignment a name of the item must always stand for the
same name of the document and the other way round, as in a copy whose parameters were changed, and not
in a chance meeting of templates.  Numbers and units may be equal by chance (3 and 3 become 5 and 8): a slot that goes against
the more frequent (then the earlier) pairs of values only doesn't count as covered.  The SQL drops such alignments.

Windows that are mostly placeholders, and those of items below ``MIN_ITEM`` tokens (down to one), are literal: they are joined by
what stands in them (in lower case), so they meet verbatim copies only.  An item of at most ``FEW`` tokens ("Yes") counts where it
is a sentence, line or answer of its own, not inside another one.  The SQL leaves them out.

DataFrame functions only.  The windows of the documents are never shuffled if the benchmark's windows are proven
few (they are counted); beyond that both sides are joined by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import checked_broadcast, written

WINDOW = 8
MIN_WORDS = 4  # a template's window has at least so many words that aren't placeholders, or all of them in items below WINDOW tokens
MIN_ITEM = 5  # shorter items are no templates
FEW = 2
COVERAGE = 0.6  # share of an item's tokens within common windows

# Units of measure and currency that stand for a unit slot.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons ounce ounces pound pounds ml l liter liters litre "
    "litres gallon gallons second seconds minute minutes hour hours day days week weeks month months year years cent cents "
    "dollar dollars euro euros percent degree degrees watt watts volt volts meter meters metre metres kilometer kilometers "
    "kilogram kilograms gram grams"
).split()

# A word or number, with the end of the sentence before it if there is one.
_TOKEN = r"(?:[.!?\n][^\p{L}\p{N}]*)?(?:\p{L}[\p{L}\p{M}]*|[0-9]+(?:[.,:/][0-9]+)*)"
NUMBER, NAME, UNIT = "#", "@", "%"


def _raw(text: str) -> str:
    return f"regexp_extract_all({text}, r'{_TOKEN}', 0)"


def _canonical(raw: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    plain = lambda w: f"CASE WHEN lower({w}) IN ({units}) THEN '{UNIT}' ELSE lower({w}) END"
    bare = r"regexp_replace(w, r'^[^\p{L}\p{N}]+', '')"
    return (
        f"transform({raw}, (w, i) -> CASE WHEN substring(w, 1, 1) BETWEEN '0' AND '9' THEN '{NUMBER}' "
        f"WHEN substring(w, 1, 1) IN ('.', '!', '?', '\\n') THEN CASE WHEN {bare} rlike '^[0-9]' THEN '{NUMBER}' ELSE {plain(bare)} END "
        f"WHEN i > 0 AND substring(w, 1, 1) <> lower(substring(w, 1, 1)) THEN '{NAME}' ELSE {plain('w')} END)"
    )


def _values(raw: str) -> str:
    """What stands in the slots: the tokens without the ends of sentences."""
    return rf"transform({raw}, w -> regexp_replace(w, r'^[^\p{{L}}\p{{N}}]+', ''))"


def _windows(width: str, kind: str = "template") -> str:
    """SQL: hashes of the windows of ``width`` tokens, by position, over the columns ``tokens`` and ``lows`` (values in lower case).

    ``kind``: ``template`` (by tokens), ``literal`` (by values), or ``mixed`` (by values where the window is mostly placeholders).
    """
    template = f"xxhash64({width}, slice(tokens, i + 1, {width}))"
    literal = f"xxhash64({width}, 'literal', slice(lows, i + 1, {width}))"
    mixed = f"CASE WHEN {_words('i', width)} >= least({MIN_WORDS}, {width}) THEN {template} ELSE {literal} END"
    one = {"template": template, "literal": literal, "mixed": mixed}[kind]
    return f"CASE WHEN size(tokens) >= {width} THEN transform(sequence(0, size(tokens) - {width}), i -> {one}) ELSE CAST(array() AS ARRAY<BIGINT>) END"


def _words(at: str, width: str) -> str:
    """SQL: how many tokens of the window aren't placeholders?"""
    return f"size(filter(slice(tokens, {at} + 1, {width}), w -> w NOT IN ('{NUMBER}', '{NAME}', '{UNIT}')))"


# SQL: does the item ``body`` stand in the text ``t`` as a sentence, line or answer of its own?
_ALONE = (
    r"regexp_like(t, concat(r'(?iu)(?:^|[.!?:;\n。！？])[\s\x22(“]*', regexp_replace(regexp_replace(body, r'([^\p{L}\p{M}\p{N}\s])', r'\\$1'), r'\s+', r'\\s+'), "
    r"r'[\s\x22)”]*(?:$|[.!?\n。！？])'))"
)

_LOWS = "transform(vals, v -> lower(v))"


# SQL of the slot check: the pair of values at a slot, the pairs of names, their type
_PAIR = "named_struct('type', tokens[q], 'ours', vals[q], 'theirs', theirs[q + shift])"
_NAME_PAIRS = f"filter(pairs, p -> p.type = '{NAME}')"
_PAIRS = "ARRAY<STRUCT<type: STRING, ours: STRING, theirs: STRING>>"


def _one_to_one(pairs: str) -> str:
    """SQL: does each value stand for one other, both ways, within its type?"""
    return " AND ".join(
        f"size({pairs}) = size(array_distinct(transform({pairs}, p -> named_struct('type', p.type, 'v', p.{side}))))" for side in ("ours", "theirs")
    )


def templates(items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """item, body (without punctuation around it), tokens (canonical), vals, width of its windows, for items that have a token."""
    df = items.select(F.col(key).alias("item"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    df = df.select("item", F.regexp_replace("t", r"^[^\p{L}\p{N}]+|[^\p{L}\p{M}\p{N}]+$", "").alias("body"), F.expr(_raw("t")).alias("raw"))
    df = df.select("item", "body", F.expr(_canonical("raw")).alias("tokens"), F.expr(_values("raw")).alias("vals"))
    return df.filter(F.size("tokens") > 0).withColumn("width", F.least(F.size("tokens"), F.lit(WINDOW)))


def _known(items: DataFrame) -> DataFrame:
    """The windows of the items: item, at, hash, width, literal."""
    whole = F.size("tokens") <= WINDOW
    # the first token is no name in the item; inside a sentence of a document it may be one, which counts where no other window is left
    named = F.expr(f"CASE WHEN substring(vals[0], 1, 1) <> lower(substring(vals[0], 1, 1)) THEN concat(array('{NAME}'), slice(tokens, 2, size(tokens))) ELSE tokens END")
    both = items.unionByName(items.filter(whole & (F.size("tokens") >= MIN_ITEM)).withColumn("tokens", named)).withColumn("lows", F.expr(_LOWS))
    at = lambda kind: F.posexplode(F.expr(_windows("width", kind))).alias("at", "hash")
    columns = ["item", "width", "tokens", "lows"]
    enough = F.expr(f"{_words('at', 'width')} >= least({MIN_WORDS}, width)")
    template = both.filter(F.size("tokens") >= MIN_ITEM).select(*columns, at("template")).filter(enough).withColumn("literal", F.lit(False))
    literal = both.select(*columns, at("literal")).filter(~enough | (F.size("tokens") < MIN_ITEM)).withColumn("literal", F.lit(True))
    return template.unionByName(literal).select("item", "at", "hash", "width", "literal").distinct()


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per contaminated document and item: key, item_id, coverage, n_windows, n_slots, n_changed, kind, text_hash.

    ``kind`` is ``verbatim`` if no slot has another value, else ``reparameterised``.  Null texts hold nothing; a null
    item text is no template; items with the same text each match; documents that repeat a key are told apart by
    ``text_hash``; whole rows that repeat give one row.
    """
    items_ = written(templates(items, item_key, item_text), "templates")
    known = written(_known(items_), "template-windows")
    # short items have windows of their own width; there are at most WINDOW widths
    kinds: dict[int, set[bool]] = {}
    for r in known.select("width", "literal").distinct().collect():
        kinds.setdefault(r["width"], set()).add(r["literal"])
    widths = sorted(kinds) or [WINDOW]
    kind = lambda w: "literal" if w < MIN_ITEM else "mixed" if True in kinds.get(w, ()) else "template"
    windows = ", ".join(_windows(str(w), kind(w)) for w in widths)
    literal = any(kind(w) != "template" for w in widths)
    texts = docs.select(F.col(key).alias("name"), F.col(text).alias("t")).filter(F.col("t").isNotNull())
    tokens = texts.select("name", F.xxhash64("t").alias("id"), F.expr(_raw("t")).alias("raw"))
    tokens = tokens.select("name", "id", F.expr(_canonical("raw")).alias("tokens"), *([F.expr(f"transform({_values('raw')}, v -> lower(v))").alias("lows")] if literal else []))
    seen = tokens.select("name", "id", F.posexplode(F.expr(f"concat({windows})")).alias("place", "hash"), *([] if len(widths) == 1 else [F.size("tokens").alias("n")]))
    if len(widths) > 1:  # positions of the second and further widths follow those of the first
        start = F.lit(0)
        place = F.col("place")
        for w in widths:
            many = F.greatest(F.col("n") - w + 1, F.lit(0))
            place = F.when((F.col("place") >= start) & (F.col("place") < start + many), F.col("place") - start).otherwise(place)
            start = start + many
        seen = seen.withColumn("place", place)
    met = seen.join(checked_broadcast(known.select("item", "at", "hash")), "hash").select("name", "id", "item", "at", (F.col("place") - F.col("at")).alias("shift"))
    met = written(
        met.groupBy("name", "id", "item", "shift").agg(F.array_sort(F.collect_set("at")).alias("ats")), "template-matches"
    )
    # the documents that met a template, with their tokens once per alignment
    hit = checked_broadcast(written(met.select("name", "id").distinct(), "template-documents"))
    again = texts.withColumn("id", F.xxhash64("t"))
    values = (
        again.join(hit.withColumnRenamed("name", "name_").withColumnRenamed("id", "id_"), F.col("name").eqNullSafe(F.col("name_")) & (F.col("id") == F.col("id_")))
        .select("name", "id", "t").dropDuplicates(["name", "id"])
        .select(F.col("name").alias("name_"), F.col("id").alias("id_"), "t", F.expr(_raw("t")).alias("raw"))
        .select("name_", "id_", F.expr(_values("raw")).alias("theirs"), "t")
    )
    aligned = (
        met.join(values, F.col("name").eqNullSafe(F.col("name_")) & (F.col("id") == F.col("id_")))
        .join(items_, "item")
        .filter(F.expr(f"CASE WHEN size(tokens) > {FEW} THEN true ELSE {_ALONE} END"))
        .withColumn("covered", F.expr("array_distinct(flatten(transform(ats, p -> sequence(p, p + width - 1))))"))
        .withColumn("slots", F.expr(f"filter(covered, q -> tokens[q] IN ('{NUMBER}', '{NAME}', '{UNIT}'))"))
        .withColumn("pairs", F.expr(f"array_distinct(transform(slots, q -> {_PAIR}))"))
        .filter(_one_to_one(_NAME_PAIRS))
        # numbers and units: pairs by frequency, then place; one that shares one side with a pair before it is against it
        .withColumn(
            "against",
            F.expr(
                f"CASE WHEN {_one_to_one('pairs')} THEN CAST(array() AS {_PAIRS}) ELSE array_except(pairs, aggregate(array_sort(transform(pairs, (p, i) -> "
                f"named_struct('rare', -size(filter(slots, q -> {_PAIR} = p)), 'i', i, 'p', p))), CAST(array() AS {_PAIRS}), "
                "(kept, x) -> CASE WHEN exists(kept, k -> k.type = x.p.type AND (k.ours = x.p.ours OR k.theirs = x.p.theirs)) THEN kept ELSE concat(kept, array(x.p)) END)) END"
            ),
        )
        .withColumn("covered", F.expr(f"CASE WHEN size(against) = 0 THEN covered ELSE filter(covered, q -> NOT array_contains(slots, q) OR NOT array_contains(against, {_PAIR})) END"))
        .select(
            "name", "id", "item", F.size("tokens").alias("size"), "covered", F.size("ats").alias("windows"), F.size("slots").alias("slots"),
            F.expr("size(filter(slots, q -> vals[q] <> theirs[q + shift]))").alias("changed"),
        )
    )
    whole = aligned.groupBy("name", "id", "item").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("covered")))).alias("tokens"), F.max("size").alias("size"),
        F.sum("windows").alias("n_windows"), F.sum("slots").alias("n_slots"), F.sum("changed").alias("n_changed"),
    )
    return (
        whole.withColumn("coverage", F.col("tokens") / F.col("size"))
        .filter(F.col("coverage") >= COVERAGE)
        .select(
            F.col("name").alias(key), F.col("item").alias("item_id"), "coverage", "n_windows", "n_slots", "n_changed",
            F.when(F.col("n_changed") > 0, "reparameterised").otherwise("verbatim").alias("kind"), F.col("id").alias("text_hash"),
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without its contaminated documents; all others (null texts too) stay as they are."""
    bad = checked_broadcast(written(leaks(docs, items, key, text).select(F.col(key).alias("leak"), "text_hash").distinct(), "leaks"))
    same = docs[key].eqNullSafe(bad["leak"]) & (F.xxhash64(docs[text]) == bad["text_hash"])
    return docs.join(bad, same, "left_anti")


def oracle() -> str:
    """DuckDB SQL for ``leaks`` over ``documents`` and ``benchmark`` (without ``text_hash``): windows as lists, joined by value."""
    token = _TOKEN.replace("\\n", "\n")
    units = ", ".join(f"'{u}'" for u in UNITS)
    plain = lambda w: f"CASE WHEN lower({w}) IN ({units}) THEN '{UNIT}' ELSE lower({w}) END"
    bare = r"regexp_replace(w, '^[^\p{L}\p{N}]+', '')"
    canonical = (
        f"list_transform(raw, lambda w, i: CASE WHEN w[1] BETWEEN '0' AND '9' THEN '{NUMBER}' "
        f"WHEN w[1] IN ('.', '!', '?', chr(10)) THEN CASE WHEN regexp_matches({bare}, '^[0-9]') THEN '{NUMBER}' ELSE {plain(bare)} END "
        f"WHEN i > 1 AND w[1] <> lower(w[1]) THEN '{NAME}' ELSE {plain('w')} END)"
    )
    parsed = f"SELECT id, raw, {canonical} AS tokens, list_transform(raw, lambda w: {bare}) AS vals FROM (SELECT <id> AS id, regexp_extract_all(text, '{token}') AS raw FROM <table> WHERE text IS NOT NULL)"
    of = lambda name, table: parsed.replace("<id>", name).replace("<table>", table)
    slot = f"IN ('{NUMBER}', '{NAME}', '{UNIT}')"
    return f"""
WITH item AS (SELECT *, len(tokens) AS n, least(len(tokens), {WINDOW}) AS width FROM ({of('item_id', 'benchmark')}) WHERE len(tokens) >= {MIN_ITEM}),
doc AS ({of('doc_id', '(SELECT DISTINCT doc_id, text FROM documents)')}),
iw AS (SELECT id, width, pos, tokens[pos + 1:pos + width] AS win FROM (SELECT *, unnest(range(0, n - width + 1)) AS pos FROM item)),
known AS (SELECT * FROM iw WHERE len(list_filter(win, lambda w: w NOT {slot})) >= least({MIN_WORDS}, width)),
dw AS (SELECT id, width, place, tokens[place + 1:place + width] AS win
       FROM (SELECT id, tokens, width, unnest(range(0, greatest(len(tokens) - width + 1, 0))) AS place
             FROM doc, (SELECT DISTINCT width FROM known))),
met AS (SELECT DISTINCT dw.id AS doc_id, k.id AS item_id, k.pos, k.width, dw.place - k.pos AS shift
        FROM dw JOIN known k ON k.width = dw.width AND k.win = dw.win),
windows AS (SELECT doc_id, item_id, shift, count(*) AS windows FROM met GROUP BY ALL),
covered AS (SELECT DISTINCT doc_id, item_id, shift, pos + unnest(range(0, width)) AS q FROM met),
slots AS (SELECT c.*, i.n, i.tokens[q + 1] {slot} AS slot, i.tokens[q + 1] AS kind, i.vals[q + 1] AS ours, d.vals[q + shift + 1] AS theirs
          FROM covered c JOIN item i ON i.id = c.item_id JOIN doc d ON d.id = c.doc_id),
aligned AS (SELECT doc_id, item_id, shift, count(*) FILTER (slot) AS slots, count(*) FILTER (slot AND ours <> theirs) AS changed,
                   count(DISTINCT (kind, ours, theirs)) FILTER (slot) AS pairs, count(DISTINCT (kind, ours)) FILTER (slot) AS left_,
                   count(DISTINCT (kind, theirs)) FILTER (slot) AS right_
            FROM slots GROUP BY ALL),
good AS (SELECT a.*, w.windows FROM aligned a JOIN windows w USING (doc_id, item_id, shift) WHERE pairs = left_ AND pairs = right_),
tokens AS (SELECT s.doc_id, s.item_id, count(DISTINCT s.q) AS tokens, max(s.n) AS n
           FROM slots s JOIN good g USING (doc_id, item_id, shift) GROUP BY ALL),
whole AS (SELECT doc_id, item_id, sum(windows) AS n_windows, sum(slots) AS n_slots, sum(changed) AS n_changed FROM good GROUP BY ALL)
SELECT doc_id, item_id, CAST(t.tokens AS DOUBLE) / t.n AS coverage, CAST(n_windows AS BIGINT) AS n_windows, CAST(n_slots AS BIGINT) AS n_slots,
       CAST(n_changed AS BIGINT) AS n_changed, CASE WHEN n_changed > 0 THEN 'reparameterised' ELSE 'verbatim' END AS kind
FROM whole JOIN tokens t USING (doc_id, item_id) WHERE CAST(t.tokens AS DOUBLE) / t.n >= {COVERAGE}
"""
