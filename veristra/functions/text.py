"""Text functions as Columns. Only Unicode forms and sentence spans, which Spark lacks, are Arrow UDFs.

``normalized``/``matching`` take any text; the ``plain_*`` forms skip the Unicode step and hold for NFC input in which
``ß`` is the only letter that case folding changes beyond lower case.
"""

from __future__ import annotations

import hashlib
import re
import string
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and signs of the text rules.
WORD_RUN = "[\\p{L}\\p{N}_\\x{0900}-\\x{097F}]+"
TOKEN_RUN = "[\\p{L}\\p{M}\\p{N}]+"
NOT_TRANSCRIPT = "[^\\p{L}\\p{N}\\p{M}]"
CLOSING = ",.;:!?।॥"
TERMINATORS = ".!?।॥"
ABBREVIATIONS = ("dr.", "mr.", "mrs.", "ms.", "prof.", "sr.", "jr.", "st.", "vs.", "no.", "fig.", "dept.", "govt.", "e.g.", "i.e.")
SPACE = "[\\s\\x{0085}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{001C}-\\x{001F}]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with value computed once: a lambda's argument is bound, an expression would be repeated."""
    return F.element_at(F.transform(F.array(value), use), 1)


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


@F.pandas_udf(T.StringType())
def casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def fold(text: Column) -> Column:
    """Case folding without a UDF: lower case, and ß to ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def plain_normalized(text: Column) -> Column:
    """White space collapsed and trimmed, none before closing signs or after opening brackets; null becomes empty."""
    spaced = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit(" "), F.lit(" ")), F.lit("​"), F.lit(""))
    spaced = F.trim(F.regexp_replace(spaced, SPACE, " "))
    return F.regexp_replace(F.regexp_replace(spaced, f" +([{CLOSING}])", "$1"), "([\\[(]) +", "$1")


def normalized(text: Column) -> Column:
    return plain_normalized(nfc(text))


def _runs(folded: Column) -> Column:
    return F.array_join(F.regexp_extract_all(folded, F.lit(WORD_RUN), 0), " ")


def matching(text: Column) -> Column:
    """Case-folded word runs joined by a space."""
    return _runs(casefold(normalized(text)))


def plain_matching(text: Column) -> Column:
    return _runs(fold(plain_normalized(text)))


def transcript(text: Column) -> Column:
    """Compatibility form, case-folded; all but letters, digits and marks becomes a space."""
    return F.trim(F.regexp_replace(F.regexp_replace(nfkc_casefold(F.coalesce(text, F.lit(""))), NOT_TRANSCRIPT, " "), " +", " "))


def plain_transcript(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), NOT_TRANSCRIPT, " "), " +", " "))


def distinct_form(text: Column) -> Column:
    """Case-folded, white space collapsed."""
    return F.trim(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), SPACE, " "))


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(fold(plain_normalized(text)), F.lit(TOKEN_RUN), 0)


def word_count(text: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[\\p{L}\\p{N}_]+"))


def split_count(text: Column) -> Column:
    """White-space separated tokens."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("\\S+"))


def sentence_count(text: Column) -> Column:
    """Runs of terminators, and one for a tail with something in it; decimals are not protected."""
    content = F.coalesce(text, F.lit(""))
    tail = F.regexp_replace(content, f"(?s)^.*[{TERMINATORS}]+", "")
    return F.when(F.trim(content) == "", 0).otherwise(F.regexp_count(content, F.lit(f"[{TERMINATORS}]+")) + (F.length(F.trim(F.regexp_replace(tail, SPACE, ""))) > 0).cast("int"))


def estimate_tokens(text: Column) -> Column:
    """A quarter of a Latin run's length, half of any other run's, one for each other sign; each rounded up."""
    pieces = F.regexp_extract_all(plain_normalized(text), F.lit("[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]"), 0)
    size = lambda p: F.when(p.rlike("^[A-Za-z0-9_]+$"), F.ceil(F.length(p) / 4)).when(p.rlike("^[\\p{L}\\p{N}_]+$"), F.ceil(F.length(p) / 2)).otherwise(1)
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda a, p: a + size(p).cast("long"))


def sha_id(*parts: Column | str) -> Column:
    """SHA-256 of the parts joined by the unit separator; null if a part is null."""
    parts = tuple(F.col(p) if isinstance(p, str) else p for p in parts)
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.sha2(F.concat_ws("\x1f", *parts), 256))


def canonical_id(text: Column) -> Column:
    """SHA-256 of the normalised text; null for an empty one."""
    return let(plain_normalized(text), lambda form: F.when(form != "", F.sha2(form, 256)))


def edit_similarity(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if either is empty."""
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("\\b\\d+(?:[./:-]\\d+)*\\b"), 0)


def char_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """All n-grams of the matching form between two spaces, named by size; blank ones left out.

    A gram is the gram of one character less and the character that follows, so each size costs one pass over the text.
    """

    def longer(signs: Column, grams: Column, n: int) -> Column:
        named = F.transform(F.filter(grams, lambda g: F.trim(g) != ""), lambda g: F.concat(F.lit(f"c{n}:"), g))
        if n < low:
            named = F.array().cast("array<string>")
        if n == high:
            return named
        # the grams are fewer than the characters that follow them: what has no partner is cut off
        step = F.zip_with(grams, F.slice(signs, n + 1, F.size(signs)), lambda g, c: F.concat(g, c))
        return F.concat(named, let(F.slice(step, 1, F.greatest(F.lit(0), F.size(signs) - n)), lambda grown: longer(signs, grown, n + 1)))

    padded = F.concat(F.lit(" "), text, F.lit(" "))
    return let(F.filter(F.split(padded, ""), lambda c: c != ""), lambda signs: longer(signs, signs, 1))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def feature_hash(features: pd.Series) -> pd.Series:
    """BLAKE2b of each feature, 8 bytes big-endian, modulo 2 ** 20."""
    return features.map(lambda xs: None if xs is None else [int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "big") % (1 << 20) for x in xs])


SPANS = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_stop = re.compile(f"[{TERMINATORS}]+[\"'”’)\\]]*")
_in_word = string.ascii_letters + "."


def _inside(text: str, at: int, end: int) -> bool:
    """Whether a lone period stands inside a sentence: in a number, an abbreviation, initials or before a small letter."""
    if text[at] != "." or end - at > 1 and text[at:end].rstrip("\"'”’)]") != ".":
        return False
    if end < len(text) and not text[end].isspace() or text[at - 1 : at].isdigit() and text[at + 1 : at + 2].isdigit():
        return True
    near = text[max(0, at - 64) : at + 1]
    word = near[len(near.rstrip(_in_word)) :].casefold()
    if word in ABBREVIATIONS or word[1:2] == "." and re.fullmatch(r"([a-z]\.)+", word):
        return True
    if "." not in word[:-1]:
        return False
    rest = text[end : end + 256].lstrip() or text[end:].lstrip()
    return rest[:1].islower()


def split_sentences(text: str) -> list[tuple[str, int, int]]:
    """(text, start, end) of each sentence in code points; together they hold all but the white space between."""
    ends = [m.end() for m in _stop.finditer(text) if not _inside(text, m.start(), m.end())]
    out, at = [], 0
    for end in [*ends, len(text)]:
        start = end - len(text[at:end].lstrip())
        if start < end:
            out.append((text[start:end], start, end))
        at = end
    return out


@F.pandas_udf(SPANS)
def sentence_spans(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else [dict(zip(("text", "start", "end"), s, strict=True)) for s in split_sentences(x)])


def cut_at_marks(text: str, most: int) -> list[tuple[str, int, int]]:
    """Pieces of at most so many code points, none of which begins with a combining mark if that can be helped."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + most)
        while at < end < len(text) and unicodedata.category(text[end])[0] == "M":
            end -= 1
        end = end if end > at else min(len(text), at + most)
        out.append((text[at:end], at, end))
        at = end
    return out


def fixed_spans(most: int):
    @F.pandas_udf(SPANS)
    def spans(text: pd.Series) -> pd.Series:
        return text.map(lambda x: None if x is None else [dict(zip(("text", "start", "end"), s, strict=True)) for s in cut_at_marks(x, most)])

    return spans


PCM = T.StructType([T.StructField("samples", T.IntegerType()), T.StructField("rms", T.IntegerType()), T.StructField("duration_ms", T.DoubleType()), T.StructField("trailing_silence_ms", T.DoubleType())])


@F.pandas_udf(PCM)
def pcm_stats(audio: pd.Series) -> pd.DataFrame:
    """Of 16-bit little-endian mono samples at 16 kHz; silence: below 80 in size at the end."""
    import numpy as np

    rows = []
    for raw in audio:
        x = np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.int64) if raw else np.zeros(0, np.int64)
        loud = np.flatnonzero(np.abs(x) >= 80)
        tail = len(x) - (loud[-1] + 1 if len(loud) else 0)
        rows.append((len(x), int((x * x).mean() ** 0.5) if len(x) else 0, len(x) / 16.0, tail / 16.0))
    return pd.DataFrame(rows, columns=["samples", "rms", "duration_ms", "trailing_silence_ms"])


def exact_quote(quote: Column, source: Column) -> Column:
    """Contained as it is, or after folding case and white space."""
    return source.contains(quote) | distinct_form(source).contains(distinct_form(quote))


def numbers_supported(claim: Column, quotes: Column) -> Column:
    found = F.regexp_extract_all(claim, F.lit("(?<![\\p{L}\\p{N}])\\d+(?:[.,:/-]\\d+)*"), 0)
    return F.forall(found, lambda n: quotes.contains(n))
