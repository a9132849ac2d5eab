"""Language identification by compression.

Benedetto, Caglioti and Loreto's idea with zstandard: a raw-content
dictionary per language is cut from training texts, a text is encoded with each
of them, and the language whose dictionary gives the fewest bytes wins.
Margins that are narrow make the prediction a rejected one: narrow for the encoded size, as texts of that
language that the dictionary has not seen measure it.  So texts in languages without a dictionary and gibberish are
rejected too.  With a single dictionary there is no second best, and only texts without a letter are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
# The training sample: bounds of what reaches the driver.
TRAIN_ROWS = 200  # rows a language
TRAIN_CHARS = 20_000  # longer training texts are left out (not cut)
DICTIONARY_BYTES = 112 * 1024
MAX_LANGUAGES = 64
LEVEL = 5
CHUNK = 4 * 1024  # long texts are encoded in chunks of this many bytes, each with the dictionary
SHORT = 1024  # texts below this many bytes are encoded at SHORT_LEVEL
SHORT_LEVEL = 12
# Bytes saved by the best dictionary over the second best: below this many, or below the language's share of
# the encoded bytes, the prediction is rejected.
MARGIN_BYTES = 3.0
# The share is a third of what all but 5% of CALIBRATION texts of the language reach with dictionaries that lack them,
# MOST_SHARE at most.
CALIBRATION = 40  # texts a language
CALIBRATION_QUANTILE, CALIBRATION_PART = 0.05, 1 / 3
MOST_SHARE = 0.05  # texts of no learned language seldom reach more, and repetitive texts of a learned one save little
FEWEST = 8  # fewer texts calibrate nothing: MARGIN_SHARE is taken
MARGIN_SHARE = 0.03

# A letter by Unicode category and the letters and marks after it: no number signs, and marks stay with their letters.
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*+")


def letters(text: str) -> bytes:
    """What is encoded: the lower-cased words (runs of letters and their marks), space-separated."""
    return f" {' '.join(_WORDS.findall(text.lower()))} ".encode()



def held_out(key: str = "doc_id"):
    """Rows that no model may learn from: crc32 of the key as text, mod 4, is 2.  False for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Model(dict):
    """Dictionary bytes per language; ``shares``: the least margin per language, as a share of the encoded bytes."""

    def __init__(self, dictionaries: dict[str, bytes], shares: dict[str, float]):
        super().__init__(dictionaries)
        self.shares = shares


def _dictionary(texts: list[bytes]) -> bytes:
    return b"".join(texts)[-DICTIONARY_BYTES:]


def calibrated(texts: dict[str, list[bytes]]) -> dict[str, float]:
    """Least margin per language, as a share of the encoded bytes: every fourth text is measured with dictionaries of the others."""
    encoder = Compressors({l: _dictionary([t for i, t in enumerate(x) if i % 4]) for l, x in texts.items() if len(x) > 1})
    shares = {}
    for l in encoder.languages:
        margins = []
        for data in texts[l][::4][-CALIBRATION:]:
            sizes = encoder.sizes(data)
            best, _, margin = judge(sizes, encoder.languages)
            if best == l:
                margins.append(margin / min(sizes))
        if len(encoder.languages) > 1 and len(margins) >= FEWEST:
            shares[l] = min(MOST_SHARE, sorted(margins)[int(len(margins) * CALIBRATION_QUANTILE)] * CALIBRATION_PART)
    return shares


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Dictionary bytes per language, and its least margin, from rows that aren't held out and have a language.

    A sample of at most ``TRAIN_ROWS`` texts a language, chosen by a hash of
    the key (so by no order of the input) with a threshold taken from exact
    counts over all rows; the texts that hash lowest come last, nearest to the encoded text.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).filter(
        F.col("l").isNotNull() & F.col("k").isNotNull() & F.col("t").isNotNull()
        & (F.length("t") > 0) & (F.length("t") <= TRAIN_CHARS) & ~held_out("k")
    )
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not counts:
        return Model({}, {})
    draw = F.pmod(F.xxhash64("k", F.lit(7)), F.lit(1 << 30))
    share = F.create_map(*(F.lit(x) for l, n in sorted(counts.items()) for x in (l, min(1 << 30, int((1 << 30) * TRAIN_ROWS * 0.75 / n) + 1))))
    drawn = rows.withColumn("d", draw).filter(F.col("d") < share[F.col("l")])
    sample = drawn.groupBy("l", "t").agg(F.min(F.struct("d", "k")).alias("x")).select("l", "t", "x.d", "x.k")  # copies once, always the same way
    got: dict[str, list[tuple[int, int, str]]] = {l: [] for l in counts}
    for r in sample.select("l", "k", "d", "t").limit(TRAIN_ROWS * len(counts)).collect():
        got[r["l"]].append((r["d"], r["k"], r["t"]))
    encoded = {l: [x for _, _, t in sorted(texts, reverse=True)[:TRAIN_ROWS] if (x := letters(t)).strip()] for l, texts in got.items()}
    encoded = {l: texts for l, texts in encoded.items() if texts}
    return Model({l: _dictionary(texts) for l, texts in encoded.items()}, calibrated(encoded))


class Compressors:
    """For each language, encoders that start from its dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.languages = sorted(dictionaries)
        kind = zstandard.DICT_TYPE_RAWCONTENT
        self.by_level = {}
        for level in (LEVEL, SHORT_LEVEL):
            self.by_level[level] = []
            for l in self.languages:
                d = zstandard.ZstdCompressionDict(dictionaries[l], dict_type=kind)
                d.precompute_compress(level=level)
                self.by_level[level].append(
                    zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False)
                )

    def sizes(self, data: bytes) -> list[int]:
        """Encoded bytes by language."""
        level = LEVEL if len(data) >= SHORT else SHORT_LEVEL
        chunks = [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]
        return [sum(len(c.compress(x)) for x in chunks) for c in self.by_level[level]]


def judge(sizes: list[int], languages: list[str]) -> tuple[str, float, float]:
    """(language, score, margin in bytes); equal sizes go to the first language in order.

    The score is the winner's share of evidence, a byte saved counting as one bit (not
    eight: the bytes of a word aren't independent).
    """
    least = min(sizes)
    best = sizes.index(least)
    rest = [x for i, x in enumerate(sizes) if i != best]
    margin = float(min(rest) - least) if rest else float("inf")
    score = 1.0 / sum(2.0 ** -min(x - least, 1000) for x in sizes)
    return languages[best], score, margin


def narrow(margin: float, least: int, share: float) -> bool:
    """Is the margin too narrow for ``least`` encoded bytes (always in a tie)?"""
    return margin < max(MARGIN_BYTES, share * least)


def _label(dictionaries: dict[str, bytes], text: str):
    """Column: struct of lang_pred, score, margin, rejected."""
    state: dict[str, Compressors] = {}
    shares = dict(getattr(dictionaries, "shares", {}))
    dictionaries = dict(dictionaries)

    @F.pandas_udf("struct<lang_pred:string,score:double,margin:double,rejected:boolean>")
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if "c" not in state:
            state["c"] = Compressors(dictionaries)
        encoder = state["c"]
        for batch in batches:
            out = []
            for t in batch.tolist():
                data = letters(t) if t and encoder.languages else b""
                if not data.strip():
                    out.append((UNKNOWN, 0.0, 0.0, True))
                    continue
                sizes = encoder.sizes(data)
                lang, score, margin = judge(sizes, encoder.languages)
                out.append((lang, score, min(margin, 1e9), narrow(margin, min(sizes), shares.get(lang, MARGIN_SHARE))))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "margin", "rejected"])

    return label(F.col(text))


def predict(docs: DataFrame, dictionaries: dict[str, bytes], key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, held_out, lang_pred, score, margin, rejected.

    Only the text is looked at, and all of it.  Null texts, texts without a
    letter, and any text if nothing was learned: ``und``, score 0, rejected.
    A margin under ``MARGIN_BYTES`` (ties too), or under the language's share of the encoded bytes, is rejected, but
    has its best language.
    """
    return docs.select(F.col(key), _label(dictionaries, text).alias("_label")).select(
        key, held_out(key).alias("held_out"), "_label.lang_pred", "_label.score", "_label.margin", "_label.rejected"
    )


def accepted(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text") -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with the columns they have."""
    kept = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), _label(dictionaries, text).alias("label"))
    return kept.filter(~F.col("label.rejected")).select("row.*")
