"""The bank term that each hand-typed entry means.

An entry is folded to bare words: glyph form, case, marks, remarks in brackets, articles and
separators are taken off. An automaton over the bank's folded English and Persian terms and their
aliases (words in the other order, run together, in the plural) finds embedded mentions; the
longest that do not overlap win. A mention with other words beside it counts if the term has
several words or the others are remarks, so that a person named like a term is none.

What that misses goes to token-set similarity: the words of the entry and of a term are paired in
either order, every word may be misspelt by a few letters inserted, deleted, replaced or swapped,
and none may be another word. Candidates come from keys with up to two letters deleted, which two
spellings within two letters always share.

The bank is a reference table of fixed size and is sent to the workers whole. Defined results: a
null or blank entry has no row; an entry that writes no term has ''; ties go to the term first in
the alphabet; a null term means nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.glyphs import glyph_form
from glyphmill.session import spread

REMARK = re.compile(r"[(\[{].*?[)\]}]|\s[-–—]\s+\w+\s*$")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z][a-z])")
#: Words that readers add to a term.
REMARKS = {"term", "place", "new", "order", "weapon", "title", "approved", "see", "vol", "p", "page"}
#: Longer entries are not remembered.
LONGEST_KEPT = 100
ARTICLES = {"the", "a", "an", "that", "this"}
FOLD = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "ة": "ه", "أ": "ا", "إ": "ا"})
TRIM = "\\s\\p{Z}\\x{200B}-\\x{200F}\\x{2060}\\x{FEFF}"


def words(entry: str) -> list[str]:
    """Bare words of an entry or term."""
    text = unicodedata.normalize("NFKC", glyph_form(entry) or "")
    kept = REMARK.sub(" ", text)
    text = kept if any(c.isalnum() for c in kept) else text
    text = HUMP.sub(" ", text).casefold().translate(FOLD)
    text = re.sub(r"['’]s\b", "", text)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn").replace("‌", "")
    found = re.findall(r"[^\W_]+", text)
    return found[1:] if len(found) > 1 and found[0] in ARTICLES else found


def distance(a: str, b: str, most: int) -> int:
    """Letters inserted, deleted, replaced or swapped (also around a change); ``most + 1`` beyond ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    seen: dict[str, int] = {}
    for i, x in enumerate(a, 1):
        row, same = [far, i], 0
        for j, y in enumerate(b, 1):
            k, m = seen.get(y, 0), same
            d = min(rows[i][j] + (x != y), row[j] + 1, rows[i][j + 1] + 1, rows[k][m] + (i - k - 1) + 1 + (j - m - 1))
            if x == y:
                same = j
            row.append(d)
        seen[x] = i
        rows.append(row)
    return min(rows[-1][-1], most + 1)


def shortened(key: str, most: int = 2) -> set[str]:
    """``key`` with up to ``most`` letters deleted."""
    return {"".join(c for i, c in enumerate(key) if i not in gone) for n in range(most + 1) for gone in combinations(range(len(key)), n)}


def allowed(word: str) -> int:
    return 0 if len(word) < 4 else 1 if len(word) < 6 else 2


def forms(split: list[str]) -> set[str]:
    """A term's words and aliases, as runs of words between spaces."""
    last = split[-1]
    plurals = [last + "s", last + "es"] + ([last[:-1] + "ies"] if last.endswith("y") else []) if last.isascii() else []
    made = set()
    for order in (split, split[::-1]):
        made |= {" ".join(order), "".join(order)}
    for x in plurals:
        made |= {" ".join([*split[:-1], x]), "".join([*split[:-1], x]), " ".join([x, *split[:-1]])}
    return {f" {x} " for x in made}


class Bank:
    def __init__(self, rows: list[tuple[str, str | None]]):
        self.near: dict[str, set[tuple[str, tuple[str, ...]]]] = {}
        self.known: set[str] = set()
        self.known_near: set[str] = set()
        self.longest = 0
        names: dict[str, tuple[str, int]] = {}
        for c0, c1 in sorted(rows, key=lambda r: r[0]):
            for text in (c0, c1):
                if not (split := words(text or "")):
                    continue
                self.known.update(split)
                for form in forms(split):
                    names.setdefault(form, (c0, len(split)))
                for order in {tuple(split), tuple(reversed(split))}:
                    self.longest = max(self.longest, len("".join(order)))
                    for key in shortened("".join(order)):
                        self.near.setdefault(key, set()).add((c0, order))
        self.automaton = ahocorasick.Automaton()
        for form, (c0, size) in names.items():
            self.automaton.add_word(form, (len(form), c0, size))
        if names:
            self.automaton.make_automaton()
        for word in self.known:
            self.known_near |= shortened(word, 1)
        self._kept = lru_cache(200_000)(self._find)

    def find(self, entry: str) -> str:
        return self._kept(entry) if len(entry) <= LONGEST_KEPT else self._find(entry)

    def mentions(self, split: list[str]) -> list[tuple[int, int, str, int]]:
        """Start, end, term and number of words of the longest mentions that do not overlap, longest first."""
        if not len(self.automaton):
            return []
        found = [(end + 1 - size, end + 1, c0, many) for end, (size, c0, many) in self.automaton.iter(f" {' '.join(split)} ")]
        chosen: list[tuple[int, int, str, int]] = []
        for m in sorted(found, key=lambda m: (m[0] - m[1], m[0])):
            # neighbours may share the space between them
            if all(m[1] <= a + 1 or m[0] >= b - 1 for a, b, _, _ in chosen):
                chosen.append(m)
        return chosen

    def _mentioned(self, split: list[str]) -> str | None:
        """The term of the longest mention; '' if only a person is named like one; None without any."""
        chosen = self.mentions(split)
        if not chosen:
            return None
        start, end, c0, many = chosen[0]
        text = f" {' '.join(split)} "
        others = [w for w in (text[:start] + " " + text[end:]).split() if w not in REMARKS and w not in ARTICLES and not w.isdigit()]
        return c0 if many > 1 or not others else ""

    def is_term(self, entry: str) -> bool:
        """Whether ``entry`` writes a term or holds a longer word of one."""
        return any(len(w) > 3 and w in self.known for w in words(entry)) or self.find(entry) != ""

    def _apart(self, typed: list[str], term: tuple[str, ...]) -> int:
        """Misspelt letters of ``typed`` against ``term``; 3 or more if a word is another word."""
        if len(typed) == len(term):
            pairs = [list(zip(typed, term, strict=True))]
        elif len(term) == 2:
            key = "".join(typed)
            pairs = [[(key[:i], term[0]), (key[i:], term[1])] for i in range(1, len(key))]
        else:
            pairs = [[("".join(typed), "".join(term))]]
        return min(map(self._sum, pairs), default=3)

    def _sum(self, pairs: list[tuple[str, str]]) -> int:
        total = 0
        for typed, word in pairs:
            if typed == word:
                continue
            most = allowed(word)
            d = distance(typed, word, most)
            if d > most or (len(pairs) > 1 and self._nearer(typed, d)):
                return 3
            total += d
        return total

    def _nearer(self, typed: str, d: int) -> bool:
        """Whether a word of the bank is nearer to ``typed`` than ``d`` letters."""
        if typed in self.known:
            return True
        if d < 2 or self.known_near.isdisjoint(shortened(typed, 1)):
            return False
        return any(distance(typed, word, 1) <= 1 for word in self.known)

    def _find(self, entry: str) -> str:
        split = words(entry)
        if not split:
            return ""
        if (c0 := self._mentioned(split)) is not None:
            return c0
        return self._similar(split)

    def _similar(self, split: list[str]) -> str:
        """The term whose set of words is nearest to ``split``, all misspelt words counted."""
        key = "".join(split)
        if len(key) > self.longest + 4:
            return ""  # more letters than any misspelling adds
        typed = [split]
        if key.isascii() and key.endswith("s"):  # a plural
            typed.append([*split[:-1], split[-1][:-1]])
            if key.endswith("ies"):
                typed.append([*split[:-1], split[-1][:-3] + "y"])
        best: dict[str, int] = {}
        for form in typed:
            for c0, term in {x for short in shortened("".join(form)) for x in self.near.get(short, ())}:
                d = self._apart(form, term)
                if d <= 2:
                    best[c0] = min(d, best.get(c0, 3))
        least = min(best.values(), default=3)
        return min((c0 for c0, d in best.items() if d == least), default="")


@lru_cache(2)
def bank_of(rows: tuple[tuple[str, str | None], ...]) -> Bank:
    """One per worker process and bank; it outlives the task."""
    return Bank(list(rows))


def bank_rows(bank: DataFrame) -> tuple[tuple[str, str | None], ...]:
    """The bank's terms, in order; a reference table of fixed size."""
    return tuple((r.c0, r.c1) for r in bank.select("c0", "c1").where("c0 is not null").orderBy("c0", "c1").collect())


def entries(propose: Column) -> Column:
    """Trimmed entries that are not blank, in order."""
    parts = F.transform(F.split(propose, "[,،]"), lambda x: F.regexp_replace(x, f"\\A[{TRIM}]++|[{TRIM}]++\\z", ""))
    return F.filter(parts, lambda x: x != "")


def match_terms(worksheet: DataFrame, bank: DataFrame) -> DataFrame:
    """``ws_key``, ``entry_no`` and ``c0`` of every entry of ``propose``; '' for none."""
    rows = bank_rows(bank)
    said = worksheet.select("ws_key", F.posexplode(entries(F.col("propose"))).alias("at", "entry"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = bank_of(rows).find
        for batch in batches:
            c0 = pa.array([find(x) for x in batch.column(2).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), c0], names=["ws_key", "entry_no", "c0"])

    numbered = spread(said.select("ws_key", (F.col("at") + 1).alias("entry_no"), "entry"), 1)
    return numbered.mapInArrow(run, "ws_key bigint, entry_no int, c0 string")
