"""Persian prose: a normal form with a count of edits per rule, and what is only reported.

Code, addresses and version numbers are lifted out first and set back last. The rest runs through
one table of rules in order; a rule works on the whole text, on every line, or on lines that hold
more Persian letters than Latin ones. Defined results: a null text stays null and has no edits.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters, suffixes and stop words of Persian, spans that stay, and phrases of bureaucratic style.
LETTER = "ء-يٮ-ەۺ-ۼۿ"
MARKED = LETTER + "\u064b-\u0652\u0670"
CONTEXT = LETTER + "۰-۹٠-٩\u200c"
PLURALS = "هایشان|هایتان|هایمان|هایی|هایم|هایت|هایش|های|ها"
ENCLITICS = "اند|ایم|اید|ام|ات|اش|ای"
NO_ENCLITIC = {"که", "چه", "نه", "به", "سه", "بله", "آنچه", "چنانچه", "اگرچه", "گرچه"}
STAYS = re.compile(r"(```.*?```|`[^`\n]*`|^(?: {4,}|\t)\S.*$|(?:https?://|www\.)\S+|[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\bv\d+(?:\.\d+)+\b|\b\d+\.\d+\.\d+\b)", re.S | re.M)
STYLE = {
    "is": r"می‌باشد|می‌باشند|میباشد", "passive": r"می‌گردد|می‌گردند", "subject to": r"مورد\s+\S+\s+قرار\s+(?:می‌گیرد|گرفت|گرفته|داد|می‌دهد)", "has": r"\bدارای\b",
    "by": r"\bتوسط\b", "as": r"\bبه[ \u200c]عنوان\b", "in order to": r"\bبه[ \u200c]منظور\b|\bدر راستای\b|\bدر جهت\b", "announced": r"لازم به ذکر است|شایان ذکر است|قابل ذکر است|قابل توجه است که",
    "not only": r"نه تنها .{0,60}? بلکه", "summary": r"\bدر نهایت\b|\bدر پایان\b|\bبه طور کلی\b|\bدر مجموع\b", "this matter": r"\bاین امر\b|\bاین موضوع\b|\bاین مسئله\b",
    "plays a role": r"\bایفا می‌کند\b|\bنقش (?:مهم|کلیدی|حیاتی)", "a": r"\bیک\s+\S+ی?\s+است\b",
}
#: Words that begin like the verbal prefix and are none.
NO_PREFIX = set("میز میزان میزبان میان میانه میانگین میانبر میدان میدانی میوه میهن میهمان میمون میل میلاد میلادی میلی میلیون میلیارد میله میخ میت میثاق میراث میکروب میکرو مینا مینو میش میگو میکده میکس میرزا میر میگرن میخانه میخک میکروفون میکروسکوپ میلیمتر میانی میسر میترا".split())
#: Stands for what was lifted out.
HOLE = "\ue000"
SPACED = " \t"


def is_persian(line: str) -> bool:
    return len(re.findall(f"[{LETTER}]", line)) > len(re.findall("[A-Za-z]", line))


def _digits(line: str) -> tuple[str, int]:
    """Whole figures in Persian digits, but for the number of a list and tokens with Latin letters."""
    head = re.match(r"\s*\d+[.)]\s", line)
    start, edits = (head.end() if head else 0), 0

    def one(m: re.Match) -> str:
        nonlocal edits
        if re.search("[A-Za-z]", m[0]):
            return m[0]
        edits += sum(c.isdigit() for c in m[0])
        return m[0].translate(FIGURES)

    return line[:start] + re.sub(r"[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)*", one, line[start:]), edits


FIGURES = str.maketrans("0123456789٠١٢٣٤٥٦٧٨٩", "۰۱۲۳۴۵۶۷۸۹" * 2)


def _mark(latin: str, persian: str, between_figures: bool) -> Callable[[str, bool], tuple[str, int]]:
    """A mark of Persian text: on a Persian line, or with Persian on both sides."""
    figure = "[0-9۰-۹]"
    bare = re.escape(latin) if between_figures else rf"(?<!{figure}){re.escape(latin)}|{re.escape(latin)}(?!{figure})"
    inside = re.compile(rf"(?<=[{CONTEXT}])(?:{bare})(?=[ \t]*[{CONTEXT}])")
    anywhere = re.compile(bare)
    return lambda line, own: (anywhere if own else inside).subn(persian, line)


def _quotes(line: str, own: bool) -> tuple[str, int]:
    edits = 0

    def one(m: re.Match) -> str:
        nonlocal edits
        inner = m[1] if m[1] is not None else m[2]
        if own or is_persian(inner):
            edits += 1
            return f"«{inner}»"
        return m[0]

    return re.sub('"([^"\n]*)"|“([^“”\n]*)”', one, line), edits


def _enclitics(text: str) -> tuple[str, int]:
    edits = 0

    def one(m: re.Match) -> str:
        nonlocal edits
        if len(m[1]) < 2 or m[1] in NO_ENCLITIC:
            return m[0]
        edits += 1
        return f"{m[1]}\u200c{m[2]}"

    return re.sub(rf"([{LETTER}]*ه)[ \t]+({ENCLITICS})(?![{LETTER}])", one, text), edits


def _whole(pattern: str, new: str | Callable) -> Callable[[str], tuple[str, int]]:
    compiled = re.compile(pattern, re.M)
    return lambda text: compiled.subn(new, text)


def _line(pattern: str, new: str) -> Callable[[str, bool], tuple[str, int]]:
    compiled = re.compile(pattern)
    return lambda line, own: compiled.subn(new, line) if own else (line, 0)


BEFORE = [
    *(("letters", _whole(a, b)) for a, b in zip("يىكة", "ییکه", strict=True)),
    ("dash", _whole(r"(?:(?<=\s)|^)ـ+(?=\s|$)", "–")),
    ("elongation", _whole("ـ", "")),
    ("digits", _whole("[٠-٩]", lambda m: m[0].translate(FIGURES))),
]
LINES = [
    ("percent", lambda line, own: re.subn("(?<=[۰-۹])%", "٪", line)),
    ("comma", _mark(",", "،", False)),
    ("semicolon", _mark(";", "؛", True)),
    ("question mark", _mark("?", "؟", True)),
    ("quotes", _quotes),
    ("space before mark", _line(r"(?<=\S)[ \t]+([.!:،؛؟»])", r"\1")),
    ("space after mark", _line(rf"(!)(?=[^\s»)\]{HOLE}،؛؟!.…])", r"\1 ")),
]
AFTER = [
    ("ellipsis", _whole(rf"(?<=[{LETTER}\u200c])\.{{3,}}", "…")),
    ("verbal prefix", _whole(rf"(?<![{LETTER}\u200c])(نمی|می)[ \t]+(?=[{LETTER}])", "\\1\u200c")),
    ("plural", _whole(rf"(?<=[{MARKED}])[ \t]+({PLURALS})(?![{LETTER}])(?! و هوی)", "\u200c\\1")),
    ("superlative", _whole(rf"(?<=[{MARKED}])[ \t]+(ترین)(?![{LETTER}])", "\u200c\\1")),
    ("enclitic", _enclitics),
    ("space before mark", _whole(rf"(?<=[{CONTEXT}])[ \t]+([،؛؟»])", r"\1")),
    ("space after quote", _whole(r"(«)[ \t]+", r"\1")),
    ("space after mark", _whole(rf"([،؛؟])(?=[^\s»)\]{HOLE}،؛؟!.…])", r"\1 ")),
    ("spaces", _whole(r"(?<=\S)[ \t]{2,}(?=\S)", " ")),
    ("space at the end", _whole(r"[ \t]+(\n|\Z)", r"\1")),
]


def normalize(text: str | None) -> tuple[str | None, Counter]:
    """The normal form and the number of edits per rule."""
    edits: Counter = Counter()
    if not text:
        return text, edits
    pieces = STAYS.split(text)
    kept, plain = pieces[1::2], HOLE.join(pieces[::2])
    if plain.count(HOLE) != len(kept):
        return text, edits  # the text holds the sign itself

    def run(rules: list, value: str) -> str:
        for name, rule in rules:
            value, n = rule(value)
            edits[name] += n
        return value

    plain = run(BEFORE, plain)
    whole = is_persian(plain)
    lines = plain.split("\n")
    for i, line in enumerate(lines):
        own = is_persian(line)
        if own or whole and not re.search("[A-Za-z]", line):
            line, n = _digits(line)
            edits["digits"] += n
        for name, rule in LINES:
            line, n = rule(line, own)
            edits[name] += n
        lines[i] = line
    plain = run(AFTER, "\n".join(lines))
    out = plain.split(HOLE)
    return "".join(p + k for p, k in zip(out, [*kept, ""], strict=True)), +edits


def suggestions(text: str | None, style: bool = False) -> list[tuple[str, str]]:
    """What is reported and never changed: kind and context."""
    plain = HOLE.join(STAYS.split(text or "")[::2])
    found = [("comparative", m) for m in re.finditer(rf"(?<=[{MARKED}])[ \t]+تر(?![{LETTER}])", plain)]
    for m in re.finditer(rf"(?<![{LETTER}\u200c])ن?می[{LETTER}]+", plain):
        stem = m[0].removeprefix("ن")
        if stem not in NO_PREFIX and stem.rstrip("ی") not in NO_PREFIX:
            found.append(("glued prefix", m))
    found += [("em dash", m) for m in re.finditer("—", plain)]
    if style:
        found += [(f"style: {name}", m) for name, pattern in STYLE.items() for m in re.finditer(pattern, plain)]
    return [(kind, plain[max(0, m.start() - 12) : m.end() + 12].replace("\n", " ")) for kind, m in found]


@F.pandas_udf(T.MapType(T.StringType(), T.IntegerType()))
def edits_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: dict(normalize(t)[1]) if isinstance(t, str) else {})


@F.pandas_udf(T.ArrayType(T.StringType()))
def kinds_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: [k for k, _ in suggestions(t, True)] if isinstance(t, str) else [])
