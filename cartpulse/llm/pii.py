"""Personal data: base entities by pattern, and terms that disclose them by corpus co-occurrence.

After Sanchez and Batet's information-theoretic sanitisation: a protected entity (an e-mail
address, IP address, card or phone number) has the information content ``-log2 p`` of its contexts, where p is the
share of the corpus (in characters) within ``CONTEXT`` characters of an entity.  A term of those contexts discloses
``log2(p(context | term) / p)`` bits of it, where p(context | term) is the share of all the term's occurrences in the corpus
that are in a context.  A term that discloses more than ``GENERALISE`` of the information content is replaced
by a general word, more than ``REMOVE`` is removed, at every place in the documents that hold an entity.  p(context | term)
is smoothed by ``SUPPORT`` occurrences at p, so rare terms count for what little is known of them.

DataFrame functions only.  Positions are code points; starts of matches are prefix sums over the parts between them,
in two levels so that a text with many thousand matches costs no quadratic work.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartpulse.llm.common import at_most, checked_broadcast, written

CONTEXT = 60
SUPPORT = 5
GENERALISE = 0.6
REMOVE = 0.8
KINDS = ("email", "ip", "card", "phone", "term")

# The given patterns, with a start and possessive runs that find the same matches without rescanning long runs.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WORD = r"\p{L}{3,}"
_BLOCK = 256
OVERLAP = 64  # more spans than can start inside one card (19 digits) or phone (15 digits)


def _quoted(pattern: str) -> str:
    return "r'" + pattern + "'"


def _prefix(lengths: str, i: str) -> str:
    """SQL: sum of the first ``i`` items of the array ``lengths``, given the sums before each block as ``heads``."""
    return (
        f"element_at(heads, CAST({i} div {_BLOCK} AS INT) + 1) + aggregate(slice({lengths}, CAST({i} div {_BLOCK} AS INT) * {_BLOCK} + 1, "
        f"CAST({i} % {_BLOCK} AS INT)), 0L, (s, x) -> s + x)"
    )


def _spans(df: DataFrame, text: str, pattern: str, valid: str, kind: int, out: str) -> DataFrame:
    """``df`` plus ``out``: array of (kind, start, end) of the matches of ``pattern`` that pass ``valid`` (SQL on ``m``)."""
    rest = df.columns
    found = df.withColumn("hits", F.expr(f"regexp_extract_all({text}, {_quoted(pattern)}, 0)")).withColumn(
        "gaps", F.expr(f"CASE WHEN size(hits) > 0 THEN split({text}, {_quoted(pattern)}, -1) END")
    )
    found = found.withColumn(
        "steps", F.expr("zip_with(slice(gaps, 1, size(hits)), hits, (g, m) -> CAST(char_length(g) + char_length(m) AS BIGINT))")
    ).withColumn(
        "heads",
        F.expr(
            f"transform(sequence(0, CAST((size(hits) - 1) div {_BLOCK} AS INT)), c -> aggregate(slice(steps, 1, c * {_BLOCK}), 0L, (s, x) -> s + x))"
        ),
    )
    end = _prefix("steps", "(i + 1)")
    # one more head than blocks: the last match may end a block
    found = found.withColumn("heads", F.expr("CASE WHEN size(hits) > 0 THEN concat(heads, array(aggregate(steps, 0L, (s, x) -> s + x))) END"))
    spans = (
        f"CASE WHEN size(hits) > 0 THEN filter(transform(hits, (m, i) -> CASE WHEN {valid} THEN "
        f"named_struct('kind', {kind}, 'start', {end} - char_length(m), 'end', {end}) END), x -> x IS NOT NULL) "
        f"ELSE CAST(array() AS ARRAY<STRUCT<kind: INT, start: BIGINT, end: BIGINT>>) END"
    )
    return found.select(*rest, F.expr(spans).alias(out))


_DIGITS = "regexp_replace(m, '[^0-9]', '')"
_LUHN = (
    f"(aggregate(sequence(1, char_length({_DIGITS})), 0, (s, k) -> s + CASE WHEN k % 2 = 1 THEN "
    f"CAST(substring({_DIGITS}, -k, 1) AS INT) ELSE CAST(substring('0246813579', CAST(substring({_DIGITS}, -k, 1) AS INT) + 1, 1) AS INT) END) % 10) = 0"
)
# "of 16 to 19 digits" is tested first, so long runs of digits cost nothing
_VALID = {
    "email": "true",
    "ip": r"forall(split(m, r'\.'), p -> char_length(ltrim('0', p)) <= 3 AND coalesce(CAST(nullif(right(ltrim('0', p), 3), '') AS INT), 0) <= 255)",
    "card": f"CASE WHEN char_length({_DIGITS}) BETWEEN 16 AND 19 THEN {_LUHN} ELSE false END",
    "phone": f"char_length({_DIGITS}) BETWEEN 8 AND 15",
}
_PATTERN = {"email": _EMAIL, "ip": _IP, "card": _CARD, "phone": _PHONE}


def _scanned(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Documents that may hold an entity: row, name, text_, base (valid spans), pieces (what is between them)."""
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(key).alias("name"), F.col(text).alias("text_")).filter(
        F.col("text_").rlike("[0-9@]")
    )
    for k, kind in enumerate(KINDS[:4]):
        df = _spans(df, "text_", _PATTERN[kind], _VALID[kind], k, kind)
    df = df.withColumn("base", F.concat(*KINDS[:4])).drop(*KINDS[:4])
    # masks: the base spans by start, each from where those before it end; overlaps are masked once
    df = df.withColumn("marks", F.expr("array_sort(transform(base, s -> named_struct('start', s.start, 'end', s.end, 'kind', s.kind)))"))
    # spans of a kind are disjoint, and a card or phone has few digits: what ends last is among the OVERLAP spans before
    before = f"aggregate(slice(marks, greatest(1, i + 1 - {OVERLAP}), least(i, {OVERLAP})), 0L, (e, x) -> greatest(e, x.end))"
    df = df.withColumn(
        "masks", F.expr(f"transform(marks, (x, i) -> named_struct('from', {before}, 'start', x.start, 'end', x.end, 'kind', x.kind))")
    )
    return df.drop("marks")


def _terms_near(masks: str) -> str:
    """SQL: the words (lower case) in the contexts of the entities, with their places: (term, start, end)."""
    words = _quoted(_WORD)
    # a context is the text before (after) an entity, up to CONTEXT characters and no further than the next entity;
    # a word that the window cuts is left out by asking for a non-letter at its edge
    chars = lambda a, n: f"aggregate(slice(part.{a}, 1, {n}), 0L, (s, x) -> s + char_length(x))"
    side = (
        "transform(sequence(0, size(part.words) - 1), i -> named_struct('term', lower(element_at(part.words, i + 1)), "
        f"'start', part.at + {chars('gaps', 'i + 1')} + {chars('words', 'i')}, "
        f"'end', part.at + {chars('gaps', 'i + 1')} + {chars('words', 'i + 1')}))"
    )
    left = (
        f"transform({masks}, m -> named_struct('at', greatest(m.from, m.start - {CONTEXT}), "
        f"'body', substring(text_, CAST(greatest(m.from, m.start - {CONTEXT}) AS INT) + 1, CAST(greatest(0L, m.start - greatest(m.from, m.start - {CONTEXT})) AS INT))))"
    )
    right = (
        f"transform({masks}, (m, i) -> named_struct('at', greatest(m.from, m.end), 'body', substring(text_, CAST(greatest(m.from, m.end) AS INT) + 1, "
        f"CAST(greatest(0L, least(CAST({CONTEXT} AS BIGINT), coalesce(try_element_at({masks}, i + 2).start, char_length(text_)) - greatest(m.from, m.end))) AS INT))))"
    )
    # a part is taken apart once, not for every word of it
    parts = (
        f"transform(filter(concat({left}, {right}), part -> part.body rlike {words}), part -> named_struct("
        f"'at', part.at, 'words', regexp_extract_all(part.body, {words}, 0), 'gaps', split(part.body, {words}, -1)))"
    )
    return f"array_distinct(flatten(transform({parts}, part -> {side})))"


def _whole(term: str) -> str:
    """SQL: is the word no fragment: no letter right before or after it in the text?"""
    return (
        f"NOT (substring(text_, CAST({term}.start AS INT), CASE WHEN {term}.start > 0 THEN 1 ELSE 0 END) rlike r'\\p{{L}}') "
        f"AND NOT (substring(text_, CAST({term}.end AS INT) + 1, 1) rlike r'\\p{{L}}')"
    )


def find(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with an entity or a digit or @: row, name, text_, base, masks, terms; disclosing terms: term, disclosure, action)."""
    scanned = _scanned(docs, key, text)
    near = scanned.withColumn("terms", F.expr(f"CASE WHEN size(masks) > 0 THEN {_terms_near('masks')} ELSE CAST(array() AS ARRAY<STRUCT<term: STRING, start: BIGINT, end: BIGINT>>) END"))
    near = near.withColumn("terms", F.expr(f"filter(terms, t -> {_whole('t')})"))
    near = near.withColumn("id", F.sha2(F.concat_ws("\x01", F.col("name").cast("string"), "text_"), 256))
    near = written(near.drop("text_"), "pii-near").withColumn("text_", F.col(f"row.`{text}`"))  # the row has the text: it is written once
    seen = near.select(F.explode("terms").alias("t")).groupBy(F.col("t.term").alias("term")).agg(F.count(F.lit(1)).alias("near"))
    seen = written(seen, "pii-terms")
    occurrences = docs.select(F.explode(F.expr(f"regexp_extract_all({text}, {_quoted(_WORD)}, 0)")).alias("w")).select(F.lower("w").alias("term"))
    if at_most(seen):  # few terms: their occurrences are picked before the count, else all words are counted first
        counted = occurrences.join(F.broadcast(seen.select("term")), "term", "left_semi").groupBy("term").count()
    else:
        counted = occurrences.groupBy("term").count().join(seen.select("term"), "term", "left_semi")
    spread = near.select(
        F.expr(f"aggregate(masks, 0L, (s, m) -> s + {2 * CONTEXT})").alias("c")
    ).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("near_chars")).crossJoin(  # one row each
        docs.agg(F.coalesce(F.sum(F.char_length(text)), F.lit(0)).alias("all_chars"))
    )
    prior = spread.select(F.least(F.col("near_chars") / F.greatest("all_chars", F.lit(1)), F.lit(0.999)).alias("p")).first()["p"]
    if not prior:
        return near, seen.select("term", F.lit(0.0).alias("disclosure"), F.lit("").alias("action")).limit(0)
    telling = seen.join(counted, "term").select(
        "term", (F.log2((F.col("near") + F.lit(SUPPORT * prior)) / (F.col("count") + SUPPORT) / F.lit(prior)) / -F.log2(F.lit(prior))).alias("disclosure")
    ).filter(F.col("disclosure") >= GENERALISE)
    return near, telling.withColumn("action", F.when(F.col("disclosure") >= REMOVE, "remove").otherwise("generalise"))


def _told(near: DataFrame, telling: DataFrame) -> DataFrame:
    """``near`` plus ``told``: the disclosing terms' places outside the masks in documents with an entity, sorted: (start, end, action)."""
    words = near.filter(F.size("masks") > 0).select("id", "text_").withColumn("words", F.expr(f"transform(regexp_extract_all(text_, {_quoted(_WORD)}, 0), w -> lower(w))"))
    # every match is valid, so words and places go together
    places = (
        _spans(words, "text_", _WORD, "true", 4, "at")
        .select("id", F.explode(F.arrays_zip("words", "at")).alias("t"))
        .select("id", F.col("t.words").alias("term"), F.col("t.at.start").alias("start"), F.col("t.at.end").alias("end"))
        .join(checked_broadcast(written(telling, "pii-telling")), "term")
        .groupBy("id")
        .agg(F.array_sort(F.collect_set(F.struct("start", "end", "action"))).alias("told"))
    )
    outside = "filter(told, t -> NOT exists(masks, m -> t.start < m.end AND t.end > greatest(m.from, m.start)))"
    return near.join(places, "id", "left").withColumn(
        "told", F.coalesce(F.expr(outside), F.expr("CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT, action: STRING>>)"))
    )


def _listed(base: str) -> str:
    return f"array_join(transform({base}, s -> concat_ws(':', element_at(array({', '.join(repr(k) for k in KINDS)}), s.kind + 1), s.start, s.end)), ',')"


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term.

    Null and empty texts have no span.  Rows that repeat a key, or a whole document, are rows of their own.
    """
    near, telling = find(docs.select(*dict.fromkeys((key, text))), key, text)
    some = _told(near, telling).withColumn(
        "all", F.expr("concat(base, transform(told, t -> named_struct('kind', 4, 'start', t.start, 'end', t.end)))")
    ).select("name", "base", "all")
    none = docs.select(F.col(key).alias("name"), F.col(text).alias("text_")).filter(
        F.col("text_").isNull() | ~F.col("text_").rlike("[0-9@]")
    ).select("name", *(F.expr("CAST(array() AS ARRAY<STRUCT<kind: INT, start: BIGINT, end: BIGINT>>)").alias(c) for c in ("base", "all")))
    count = lambda k: F.expr(f"CAST(size(filter(all, s -> s.kind = {k})) AS BIGINT)")
    return some.unionByName(none).select(
        F.col("name").alias(key),
        *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])),
        F.sha2(F.expr(_listed("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(_listed("all")).alias("spans"),
        count(4).alias("n_term"),
    )


def sanitise(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the same columns and rows, entities replaced by their kind in brackets and disclosing terms generalised or removed."""
    near, telling = find(docs, key, text)
    kinds = ", ".join(repr(f"[{k.upper()}]") for k in KINDS)
    # cuts in the order of the text: masks (each from where those before it end) and terms, which never overlap them
    cuts = (
        "array_sort(concat(transform(masks, m -> named_struct('start', greatest(m.from, m.start), 'end', greatest(m.from, m.end), "
        f"'put', CASE WHEN m.start >= m.from THEN element_at(array({kinds}), m.kind + 1) ELSE '' END)), "
        "transform(told, t -> named_struct('start', t.start, 'end', t.end, 'put', CASE WHEN t.action = 'remove' THEN '' ELSE '[TERM]' END))))"
    )
    clean = (
        _told(near, telling).withColumn("cuts", F.expr(cuts))
        .withColumn(
            "clean",
            F.expr(
                "CASE WHEN size(cuts) = 0 THEN text_ ELSE concat(array_join(transform(cuts, (c, i) -> concat(substring(text_, "
                "CAST(CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1].end END AS INT) + 1, CAST(c.start - CASE WHEN i = 0 THEN 0 ELSE cuts[i - 1].end END AS INT)), c.put)), ''), "
                "substring(text_, CAST(element_at(cuts, -1).end AS INT) + 1)) END"
            ),
        )
    )
    columns = [F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rest = docs.filter(F.col(text).isNull() | ~F.col(text).rlike("[0-9@]"))
    return clean.select(*columns).union(rest)
