"""Scripts, languages and Roman Hindi as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veristra.functions.text import TOKEN_RUN, fold, plain_normalized, word_tokens

# Scripts with their code point classes, languages with their script and tags, default language of a script.
SCRIPTS = {
    "Arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}",
    "Bengali": "\\x{0980}-\\x{09FF}",
    "Devanagari": "\\x{0900}-\\x{097F}",
    "Gujarati": "\\x{0A80}-\\x{0AFF}",
    "Gurmukhi": "\\x{0A00}-\\x{0A7F}",
    "Kannada": "\\x{0C80}-\\x{0CFF}",
    "Latin": "A-Za-z",
    "Malayalam": "\\x{0D00}-\\x{0D7F}",
    "Odia": "\\x{0B00}-\\x{0B7F}",
    "Tamil": "\\x{0B80}-\\x{0BFF}",
    "Telugu": "\\x{0C00}-\\x{0C7F}",
}
LANGUAGES = {
    "as": ("Bengali", "as asm asm_beng"),
    "bn": ("Bengali", "bn ben ben_beng"),
    "en": ("Latin", "en eng eng_latn"),
    "gu": ("Gujarati", "gu guj guj_gujr"),
    "hi": ("Devanagari", "hi hin hin_deva"),
    "kn": ("Kannada", "kn kan kan_knda"),
    "ml": ("Malayalam", "ml mal mal_mlym"),
    "mr": ("Devanagari", "mr mar mar_deva"),
    "ne": ("Devanagari", "ne nep npi npi_deva"),
    "or": ("Odia", "or ori ory ory_orya"),
    "pa": ("Gurmukhi", "pa pan pan_guru"),
    "sa": ("Devanagari", "sa san san_deva"),
    "ta": ("Tamil", "ta tam tam_taml"),
    "te": ("Telugu", "te tel tel_telu"),
    "ur": ("Arabic", "ur urd urd_arab"),
}
DEFAULTS = {"Arabic": "ur", "Bengali": "bn", "Devanagari": "hi", "Gujarati": "gu", "Gurmukhi": "pa", "Kannada": "kn", "Latin": "en", "Malayalam": "ml", "Odia": "or", "Tamil": "ta", "Telugu": "te"}
MIXED, UNKNOWN = "hi-en", "unknown"
ROMAN_FACTUAL = "kab kahaan kahan kaun kis kitna kitne kitni kya".split()
ROMAN_DESCRIPTIVE = "bataie bataiye batao kaise kyon kyu kyun samjhaie samjhaiye samjhao".split()
ROMAN_STRONG = "hai hain ka ki ko liye matlab mein nahi nahin tha thi".split()
ROMAN_WEAK = "aur ke par se ya".split()
REWRITES = {
    "bataie": "बताइए", "bataiye": "बताइए", "batao": "बताओ", "hai": "है", "hain": "हैं", "ka": "का", "kahaan": "कहाँ", "kahan": "कहाँ",
    "kaise": "कैसे", "kaun": "कौन", "ke": "के", "ki": "की", "kis": "किस", "kitna": "कितना", "kitne": "कितने", "kitni": "कितनी",
    "ko": "को", "kya": "क्या", "kyon": "क्यों", "kyu": "क्यों", "kyun": "क्यों", "liye": "लिए", "matlab": "मतलब", "mein": "में",
    "nahi": "नहीं", "nahin": "नहीं", "samjhaie": "समझाइए", "samjhaiye": "समझाइए", "samjhao": "समझाओ", "tha": "था", "thi": "थी",
}
MOST_CHARACTERS, LEAST_TOKENS, MOST_TOKENS = 512, 2, 64


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def script_counts(text: Column) -> Column:
    """array<struct<script, n>> of the scripts that occur, most frequent first, ties by name."""
    each = F.array(*[F.struct(F.lit(s).alias("script"), F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[{c}]")).alias("n")) for s, c in SCRIPTS.items()])
    return F.transform(F.array_sort(F.transform(F.filter(each, lambda x: x["n"] > 0), lambda x: F.struct((-x["n"]).alias("minus"), x["script"].alias("script"), x["n"].alias("n")))), lambda x: F.struct(x["script"].alias("script"), x["n"].alias("n")))


def language_of_tag(tag: Column) -> Column:
    """Language of a full tag, else of what stands before the first separator."""
    known = _map({alias: code for code, (_, tags) in LANGUAGES.items() for alias in tags.split()})
    clean = F.replace(F.lower(F.trim(F.coalesce(tag, F.lit("")))), F.lit("-"), F.lit("_"))
    get = lambda key: F.try_element_at(known, key)
    return F.coalesce(get(clean), get(F.split_part(clean, F.lit("_"), F.lit(1))), F.lit(UNKNOWN))


def components(scripts: Column) -> Column:
    """Languages written in the scripts, in the scripts' order."""
    of = {s: [code for code, (script, _) in LANGUAGES.items() if script == s] for s in SCRIPTS}
    lists = F.create_map(*[x for s, codes in of.items() for x in (F.lit(s), F.array(*[F.lit(c) for c in codes]))])
    return F.flatten(F.transform(scripts, lambda s: F.try_element_at(lists, s)))


def analyze(text: Column, hint: Column | None = None) -> Column:
    """struct<language, scripts, components, code_mixed, confidence, source, ambiguous>; hint: a language code or null."""
    counts = script_counts(text)
    scripts = F.transform(counts, lambda x: x["script"])
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x["n"])
    n = F.size(counts)
    first = F.try_element_at(scripts, F.lit(1))
    share = F.when(n > 0, F.try_element_at(counts, F.lit(1))["n"] / total)
    hinted = F.coalesce(hint, F.lit(UNKNOWN)) if hint is not None else F.lit(UNKNOWN)
    concrete = ~hinted.isin(UNKNOWN, MIXED)
    language = F.when(hinted == MIXED, MIXED).when(n > 1, MIXED).when(concrete, hinted).when(n == 0, UNKNOWN).otherwise(F.try_element_at(_map(DEFAULTS), first))
    named = components(scripts)
    parts = F.when(concrete, F.array_distinct(F.concat(F.array(hinted), named))).otherwise(named)
    mixed = (hinted == MIXED) | (n > 1)
    script_of = F.try_element_at(_map({c: s for c, (s, _) in LANGUAGES.items()}), hinted)
    ambiguous = F.when(hinted == MIXED, False).when(concrete, (n > 0) & ~F.array_contains(scripts, script_of)).when(n == 0, True).when(n > 1, F.size(named) > n).otherwise(F.size(named) > 1)
    source = F.when(hinted == MIXED, "provider_hint").when(concrete & (n > 1), "script_codemix").when(concrete, "provider_hint").when(n == 0, "fallback").when((n == 1) & (F.size(named) > 1), "script_fallback").otherwise("script")
    confidence = F.when((hinted == MIXED) | concrete, F.lit(None)).otherwise(share)
    return F.struct(language.alias("language"), scripts.alias("scripts"), parts.alias("components"), mixed.alias("code_mixed"), confidence.cast("double").alias("confidence"), source.alias("source"), F.coalesce(ambiguous, F.lit(False)).alias("ambiguous"))


def _any(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def roman_hindi(text: Column, hint: Column) -> Column:
    """Bounded Roman Hindi: hinted, without Devanagari, one strong or two weak markers among two Latin tokens."""
    tokens = F.array_distinct(F.filter(word_tokens(text), lambda t: t.rlike("^[a-z]+$")))
    n = F.size(word_tokens(text))
    form = plain_normalized(text)
    weak = F.size(F.array_intersect(tokens, F.array(*[F.lit(w) for w in ROMAN_WEAK])))
    marked = _any(tokens, ROMAN_FACTUAL + ROMAN_DESCRIPTIVE + ROMAN_STRONG) | (weak >= 2)
    return F.coalesce(hint.isin("hi", MIXED), F.lit(False)) & (F.length(form) <= MOST_CHARACTERS) & ~form.rlike("[\\x{0900}-\\x{097F}]") & n.between(LEAST_TOKENS, MOST_TOKENS) & (F.size(tokens) >= 2) & marked


def rewritten(text: Column) -> Column:
    """ASCII words of the rewrite list replaced; all else stays."""
    swap = lambda out, pair: F.regexp_replace(out, f"(?i)(?<![A-Za-z]){pair[0]}(?![A-Za-z])", pair[1])
    return reduce(swap, REWRITES.items(), plain_normalized(text))


__all__ = ["TOKEN_RUN", "analyze", "components", "fold", "language_of_tag", "rewritten", "roman_hindi", "script_counts"]
