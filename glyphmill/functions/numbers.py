"""Written quantities and approved forms, compared as text.

These rest on look-around and on every decimal digit of Unicode, so they run over Arrow batches.
Defined results: a null text holds no quantity and uses no form.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from glyphmill.functions.persian import LETTER

NUMBER = re.compile(r"(?<![\w.,+\-])([+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+))((?:[eE][+-]?\d+)?)(?!\d|[.,]\d)")
#: Identifiers, and versions with two dots or more, hold no quantity.
NAMES = re.compile(r"(?<!\w)(?:[A-Za-z_][\w./:+\-]*|\d+[A-Za-z_]\w*[./:+\-][\w./:+\-]*)|\d+(?:\.\d+){2,}", re.A)
BOUNDED = re.compile(r"[A-Za-z\u00C0-\u024F\u1E00-\u1EFF0-9_\u0300-\u036f ./:@+#'’\-]+")


def ascii_digits(text: str) -> str:
    """Every decimal digit as 0 to 9, the Persian decimal mark and the minus sign as ASCII."""
    if text.isascii():
        return text
    return "".join(str(unicodedata.decimal(c)) if c.isdecimal() else {"٫": ".", "−": "-"}.get(c, c) for c in text)


def canonical(token: str) -> str:
    """One spelling of a finite decimal, without rounding."""
    text = ascii_digits(token).replace(",", ".")
    digits = text.lstrip("+-")
    whole, _, rest = digits.partition(".")
    value = (whole.lstrip("0") or "0") + (f".{r}" if (r := rest.rstrip("0")) else "")
    return value if value == "0" or not text.startswith("-") else "-" + value


def quantities(text: str | None) -> list[str]:
    """Canonical quantities of a text, each once, sorted."""
    plain = ascii_digits(text or "")
    names = [m.span() for m in NAMES.finditer(plain)]
    found = (m for m in NUMBER.finditer(plain) if not m[2] and not any(a < m.end() and m.start() < b for a, b in names))
    return sorted({canonical(m[1]) for m in found})


def uses(text: str | None, candidates: Iterable[str | None]) -> bool:
    """Whether a text writes one of the forms: Latin ones between word bounds, Arabic-script ones
    not next to another Persian letter, any other as it stands."""
    return any(form_pattern(f).search(text or "") for f in candidates if f)


def form_pattern(form: str) -> re.Pattern[str]:
    if BOUNDED.fullmatch(form) and any(c.isalnum() for c in form):
        ends = ["" if c.isalnum() else re.escape(c) for c in (form[0], form[-1])]
        more = r"|[./:\-]\w" if any(c.isdecimal() for c in form) else ""
        return re.compile(rf"(?<![\w\u0300-\u036f{ends[0]}]){r'\s+'.join(map(re.escape, form.split()))}(?![\w\u0300-\u036f{ends[1]}]{more})")
    if re.search(f"[{LETTER}]", form):
        return re.compile(f"(?<![{LETTER}]){re.escape(form)}(?![{LETTER}])")
    return re.compile(re.escape(form))


@F.pandas_udf(T.ArrayType(T.StringType()))
def quantities_of(text: pd.Series) -> pd.Series:
    return text.map(quantities)


@F.pandas_udf(T.BooleanType())
def uses_form(text: pd.Series, candidates: pd.Series) -> pd.Series:
    return pd.Series([uses(t, c if c is not None else ()) for t, c in zip(text, candidates)])


def spelling_used(spelling: str, answer: str | None) -> bool:
    """Whether an answer writes a quantity as asked.

    A single number may be spelt otherwise; a compound (`3:30`, `1/2`) must keep its numbers in
    order with the same marks between them; words stand between word bounds, joined ones excluded.
    """
    wanted, text = ascii_digits(spelling).strip(), ascii_digits(answer or "")
    if re.fullmatch(r"[+-]?(?:\d+(?:[.,]\d+)?|[.,]\d+)", wanted):
        return canonical(wanted) in quantities(text)
    if not any(c.isdecimal() for c in wanted):
        body = r"\s+".join(map(re.escape, spelling.split()))
        return bool(body) and re.search(rf"(?<![\w\u200c]){body}(?![\w\u200c])", answer or "") is not None
    asked = _tokens(wanted)
    if not asked or wanted[: asked[0].start()] or wanted[asked[-1].end() :]:
        whole = re.sub(r"\\?([:/])", r"\\s*\1\\s*", re.escape(wanted))
        return re.search(rf"(?<![\w:/]){whole}(?!\w|[.:/]\d)", text) is not None
    there, many = _tokens(text), len(asked)
    for i in range(len(there) - many + 1):
        window = there[i : i + many]
        apart = re.search(r"\w$|[:/+\-]\s*$", text[: window[0].start()]) or re.match(r"\w|\s*[:/]|\.\d", text[window[-1].end() :])
        if not apart and _shape(text, window) == _shape(wanted, asked):
            return True
    return False


def _tokens(text: str) -> list[re.Match]:
    return [m for m in NUMBER.finditer(text) if not m[2]]


def _shape(text: str, tokens: list[re.Match]) -> list[str]:
    """Canonical numbers and the marks between them, spaces around colons and slashes aside."""
    out = [canonical(tokens[0][1])]
    for a, b in zip(tokens, tokens[1:]):
        out += [re.sub(r"\s*([:/])\s*", r"\1", text[a.end() : b.start()]), canonical(b[1])]
    return out
