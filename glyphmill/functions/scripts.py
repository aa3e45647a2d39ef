"""Which scripts a text is written in, by counts of characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code ranges of the scripts told apart, in the order that decides ties.
RANGES = {
    "arabic": "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}",
    "latin": "A-Za-z\\x{00C0}-\\x{024F}",
    "hiragana": "\\x{3040}-\\x{309F}",
    "katakana": "\\x{30A0}-\\x{30FF}\\x{31F0}-\\x{31FF}",
    "han": "\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}\\x{F900}-\\x{FAFF}",
    "hangul": "\\x{AC00}-\\x{D7AF}\\x{1100}-\\x{11FF}\\x{3130}-\\x{318F}",
    "cyrillic": "\\x{0400}-\\x{04FF}",
}
LANGUAGES = {"fa": ["arabic"], "ar": ["arabic"], "fas": ["arabic"], "per": ["arabic"], "ja": ["hiragana", "katakana", "han"], "jpn": ["hiragana", "katakana", "han"], "ko": ["hangul"], "kor": ["hangul"], "zh": ["han"], "zho": ["han"], "cmn": ["han"], "en": ["latin"], "eng": ["latin"]}


def count(text: Column, script: str) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{RANGES[script]}]+", "")).cast("long")


def counts(text: Column) -> dict[str, Column]:
    return {name: count(text, name) for name in RANGES}


def dominant(counted: dict[str, Column]) -> Column:
    """The script of most characters, the earlier one on ties, `none` without any."""
    names = list(RANGES)
    best = F.greatest(*(counted[n] for n in names))
    chain = F.when(best == 0, "none")
    for n in names:
        chain = chain.when(counted[n] == best, n)
    return chain


def looks_like(counted: dict[str, Column], language: Column) -> Column:
    """Whether the counts are plausible for a language; of an unknown one, any letters are."""
    total = sum(counted.values(), F.lit(0))
    chain = F.when(total == 0, False)
    for lang, scripts in LANGUAGES.items():
        share = sum((counted[s] for s in scripts), F.lit(0)) / total
        chain = chain.when(language == lang, share > (0.4 if "hangul" in scripts else 0.5))
    return chain.otherwise(True)


def is_persian(text: Column, counted: dict[str, Column]) -> Column:
    return F.coalesce(text, F.lit("")).rlike("[گچپژکی]") & looks_like(counted, F.lit("fa"))


def source_left(counted: dict[str, Column]) -> Column:
    return counted["hiragana"] + counted["katakana"] + counted["han"] + counted["hangul"]
