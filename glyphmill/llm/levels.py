"""Reading level of running prose.

Texts are cut into sentences, and every sentence gets features of its own: words, word length, long
words, rarity of its words in the whole corpus, connectives, clause depth (commas and connectives)
and lexical diversity. A regularised ordinal regression (proportional odds), fitted on the graded
documents, gives each sentence a level; a document has the level of most of its sentences. Since a
graded text may hold sentences of a neighbouring level, the fit is repeated without the sentences
that it puts elsewhere than their document.

The rarity comes from word counts of all documents, kept in a table of fixed size by hash. The
fit alone uses a sample: no more than `GRADED` graded documents, those with the least hashes of
their keys.

Defined results: null, empty and short texts, and texts mostly in other tongues, do not come out;
a document two of whose levels hold equally many sentences has the lower one; without graded documents
nothing comes out.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.session import spread

GRADED = 2_000
LEAST_WORDS = 60
BUCKETS = 1 << 16
#: Tokens a worker remembers before it starts afresh.
MOST_KEPT = 300_000
#: Characters taken together; a longer document is taken alone.
TEXT_AT_ONCE = 2_000_000
RIDGE = 1e-3
#: Newton's method ends after so many steps at the latest.
STEPS = 60
#: Least share of function words in prose of a language.
FUNCTION_WORDS = 0.08
LEVELS = (1, 2, 3, 4)

# Connectives and other function words of both languages.
CONNECTIVES = {
    "en": "although though because since whereas while whereby which whose whom unless until when whenever where wherever if provided that so whether thereby therefore thus hence however moreover furthermore nevertheless nonetheless notwithstanding albeit insofar inasmuch despite besides before after once lest rather than neither nor either consequently accordingly yet",
    "fa": "که چون زیرا اگر اگرچه هرچند گرچه تا وقتی هنگامی زمانی چنانچه مگر ولی اما بلکه لذا بنابراین درحالی حالی آنکه آنچه هرگاه پس سپس نیز همچنین خواه ضمن بدون نه یا بی جایی چنان مبنی لاجرم خاصه حیث رو",
}
FUNCTION = {
    "en": "the a an of to in on at by for with from and or but not no is are was were be been it its he she they we you i this that these those my your his her their our as had has have do does did will would can could should there here what where who how all",
    "fa": "و در به از با را این آن است بود شد های ها می هم یک برای بر او ما شما من تو خود هر همه چند دیگر هیچ کرد کند دارد داشت باید هستند دارند نیست کجاست گفت آمد برو ببین امروز پیش بعد بی روی زیر کنار",
}
FOLD = str.maketrans({"ي": "ی", "ى": "ی", "ك": "ک", "أ": "ا", "إ": "ا", "ة": "ه", "’": "'", "…": "."} | {chr(c): None for c in [0xAD, 0x640, 0x200B, *range(0x200D, 0x2010), 0x2060, 0xFEFF, *range(0x64B, 0x653)]})
FOLDED = re.compile("[" + re.escape("".join(map(chr, FOLD))) + "]")
TOKEN = re.compile(r"[^\W\d_]+(?:['‌-][^\W\d_]+)*|[.!?؟。！？]+|\n+|[,،;؛]")
ASIDE = re.compile(r"\([^()\n]{0,80}\)|https?://\S+|^[ \t]*(?:[-*•>#]+|\d+[.)])[ \t]+", re.M)
SPEAKER = re.compile(r"^[^\W\d_]{2,14}(?: [^\W\d_]{1,14})?: ", re.M)
WRAP = re.compile(r"(?<=[^\s.!?؟])\n(?=[a-z])")

WORDS, LENGTH, LONG, RARE, LINKS, DEPTH, DIVERSITY = range(7)
EN, FA, OTHER = 0, 1, 2


def plain(text: str) -> str:
    """Folded text without asides, bullets and the lines of a dialogue."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if FOLDED.search(text):
            text = text.translate(FOLD)
    text = ASIDE.sub(" ", text)
    if ": " in text and len(SPEAKER.findall(text)) >= 3 and 5 * len(SPEAKER.findall(text)) >= text.count("\n") + 1:
        return ""
    return WRAP.sub(" ", text).lower()


class Tokens(dict):
    """Token to its number in tables of what the features need."""

    def __init__(self):
        super().__init__()
        sets = {k: {lang: set(v.split()) for lang, v in table.items()} for k, table in (("link", CONNECTIVES), ("function", FUNCTION))}
        self.links = sets["link"]["en"] | sets["link"]["fa"]
        self.functions = sets["function"]["en"] | sets["function"]["fa"] | self.links
        self.rows: list[tuple[int, ...]] = []

    def __missing__(self, token: str) -> int:
        first = token[0]
        if first == "\n" or first in ".!?؟。！？":
            row = (1, 0, 0, 0, 0, 0, OTHER, 0)
        elif first in ",،;؛":
            row = (0, 1, 0, 0, 0, 0, OTHER, 0)
        else:
            tongue = EN if token.isascii() or "a" <= first <= "ɏ" else FA if "؀" <= first <= "ۿ" else OTHER
            letters = len(token) if tongue != OTHER else max(1, len(token) // 2)
            row = (0, 0, letters, int(letters >= (8 if tongue == EN else 7)), zlib.crc32(token.encode("utf-8", "replace")) % BUCKETS, int(token in self.links), tongue, int(token in self.functions))
        self.rows.append(row)
        self[token] = len(self.rows) - 1
        return self[token]

    def table(self) -> np.ndarray:
        return np.asarray(self.rows, dtype=np.int32).reshape(-1, 8)


class Reader:
    """Tokens and sentences of batches of texts; the memory of tokens is bounded."""

    def __init__(self):
        self.tokens = Tokens()

    def read(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of all tokens, their numbers, and the text each belongs to."""
        if len(self.tokens) > MOST_KEPT:
            self.tokens = Tokens()
        get, numbers, many = self.tokens.__getitem__, [], []
        for text in texts:
            found = TOKEN.findall(plain(text)) if text else []
            numbers += map(get, found)
            many.append(len(found))
        ids = np.asarray(numbers, dtype=np.int64)
        return self.tokens.table()[ids], ids, np.repeat(np.arange(len(texts)), many)

    def buckets(self, texts: list[str | None]) -> np.ndarray:
        rows, _, _ = self.read(texts)
        return np.bincount(rows[rows[:, 2] > 0, 4], minlength=BUCKETS)

    def sentences(self, texts: list[str | None], rarity: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, language, number of words and features of every sentence of prose.

        Of a text that is not mostly English or Persian, or not prose, none is given.
        """
        rows, ids, owner = self.read(texts)
        empty = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 7))
        if not len(rows):
            return empty
        new = np.concatenate(([0], (owner[1:] != owner[:-1]) | (rows[:-1, 0] == 1))).astype(np.int64)
        sentence = np.cumsum(new)
        count = int(sentence[-1]) + 1
        text_of = owner[np.flatnonzero(np.concatenate(([1], new[1:])))]
        is_word = rows[:, 2] > 0
        tongue = rows[:, 6]

        def total(values: np.ndarray) -> np.ndarray:
            return np.bincount(sentence, weights=values, minlength=count)

        words = total(is_word)
        per = np.maximum(words, 1)
        persian, english = total(is_word & (tongue == FA)), total(is_word & (tongue == EN))
        links, commas = total(rows[:, 5]), total(rows[:, 1])
        first = np.unique(sentence[is_word] * (int(ids.max()) + 1) + ids[is_word], return_index=True)[1]
        types = np.bincount(sentence[is_word][first], minlength=count)
        features = np.stack(
            [np.log1p(words), total(rows[:, 2]) / per, total(rows[:, 3]) / per, total(np.where(is_word, rarity[rows[:, 4]], 0.0)) / per, np.log1p(links), np.log1p(links + commas), types / per],
            axis=1,
        )
        lang = np.where(persian > english, FA, EN)
        own = np.maximum(persian, english)
        all_words = np.bincount(text_of, weights=words, minlength=len(texts))
        ours = np.bincount(text_of, weights=persian + english, minlength=len(texts))
        function = np.bincount(text_of, weights=total(rows[:, 7]), minlength=len(texts))
        prose_text = (ours * 2 > all_words) & (function >= FUNCTION_WORDS * all_words)
        good = (words >= 2) & (own >= 0.8 * words) & prose_text[text_of]
        return text_of[good], lang[good], words[good].astype(np.int64), features[good]


class Ordinal:
    """Proportional odds with a ridge; features are standardised, with a share of their own for Persian."""

    def fit(self, features: np.ndarray, lang: np.ndarray, level: np.ndarray, weight: np.ndarray) -> Ordinal:
        self.mean = np.stack([features[lang == k].mean(axis=0) if (lang == k).any() else np.zeros(features.shape[1]) for k in (EN, FA)])
        self.scale = np.stack([features[lang == k].std(axis=0) + 1e-6 if (lang == k).any() else np.ones(features.shape[1]) for k in (EN, FA)])
        x = self._design(features, lang)
        above = (level[:, None] > np.asarray(LEVELS[:-1])[None, :]).astype(float)
        weight = weight / weight.sum()
        share = np.clip((above * weight[:, None]).sum(axis=0), 0.02, 0.98)
        theta = np.concatenate([np.zeros(x.shape[1]), np.log(share / (1 - share))])
        ridge = np.concatenate([np.full(x.shape[1], RIDGE), np.full(len(share), RIDGE / 100)])
        n = x.shape[1]

        def loss(t: np.ndarray) -> float:
            z = (x @ t[:n])[:, None] + t[None, n:]
            return float((weight[:, None] * (np.logaddexp(0, z) - above * z)).sum() + (ridge * t * t).sum() / 2)

        now = loss(theta)
        for _ in range(STEPS):  # Newton's method; a step that does not lower the loss is halved
            p = 1 / (1 + np.exp(-np.clip((x @ theta[:n])[:, None] + theta[None, n:], -30, 30)))
            err, curve = (p - above) * weight[:, None], p * (1 - p) * weight[:, None]
            grad = np.concatenate([x.T @ err.sum(axis=1), err.sum(axis=0)]) + ridge * theta
            cross = x.T @ curve
            hess = np.block([[(x * curve.sum(axis=1)[:, None]).T @ x, cross], [cross.T, np.diag(curve.sum(axis=0))]]) + np.diag(ridge)
            step, size = np.linalg.solve(hess, grad), 1.0
            while size > 1e-4 and (then := loss(theta - size * step)) >= now:
                size /= 2
            if size <= 1e-4 or now - then < 1e-9:
                break
            theta, now = theta - size * step, then
        self.w, self.cut = theta[:n], np.sort(theta[n:])[::-1]
        return self

    def _design(self, features: np.ndarray, lang: np.ndarray) -> np.ndarray:
        z = np.clip((features - self.mean[lang]) / self.scale[lang], -4, 4)
        fa = (lang == FA)[:, None]
        return np.concatenate([z, z * fa, fa], axis=1)

    def levels(self, features: np.ndarray, lang: np.ndarray) -> np.ndarray:
        score = self._design(features, lang) @ self.w
        return 1 + (score[:, None] + self.cut[None, :] > 0).sum(axis=1)


def vote(text: np.ndarray, level: np.ndarray, words: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Level of most sentences of each text, and the text's words."""
    table = np.zeros((count, len(LEVELS)), dtype=np.int64)
    np.add.at(table, (text, level - 1), 1)
    return 1 + table.argmax(axis=1), np.bincount(text, weights=words, minlength=count)


def train(texts: list[str], grades: list[int], rarity: np.ndarray) -> Ordinal | None:
    text, lang, words, features = Reader().sentences(texts, rarity)
    level = np.asarray(grades)[text] if len(text) else text
    if not len(level):
        return None
    keep = np.ones(len(level), dtype=bool)
    model = None
    for _ in range(4):
        # every document counts alike, however long
        share = 1.0 / np.bincount(text[keep], weights=words[keep], minlength=len(texts))[text[keep]]
        model = Ordinal().fit(features[keep], lang[keep], level[keep], words[keep] * share)
        own = model.levels(features, lang) == level
        if not own.any() or (own == keep).all():
            break
        keep = own
    return model


def rarities(documents: DataFrame, text: str) -> np.ndarray:
    """Minus the log share of each bucket among all words of the corpus; a table of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, total = Reader(), np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for part in _parts(batch.column(0)):
                total += reader.buckets(part)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    counts = spread(documents.select(text), 1).mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(BUCKETS)
    total[counts["bucket"].to_numpy()] = counts["n"].to_numpy()
    return -np.log((total + 0.5) / (total.sum() + 0.5 * BUCKETS))


def _parts(column: pa.Array) -> Iterator[list[str | None]]:
    part, size = [], 0
    for text in column.to_pylist():
        part.append(text)
        size += len(text or "")
        if size > TEXT_AT_ONCE:
            yield part
            part, size = [], 0
    if part:
        yield part


def reading_levels(documents: DataFrame, graded: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``reading_level`` of every document of running English or Persian prose."""
    read = documents.select(F.col(key), F.col(text))
    kind = dict(read.dtypes)[key]
    rarity = rarities(read, text)
    sample = graded.select(F.col(key), F.col("reading_level").alias("level")).where(F.col("level").isin(*LEVELS)).orderBy(F.xxhash64(key), key).limit(GRADED)
    rows = read.where(F.col(text).isNotNull()).join(F.broadcast(sample), key).select(key, text, "level").toArrow().sort_by([(key, "ascending"), ("level", "ascending")])
    model = train(rows[text].to_pylist(), rows["level"].to_pylist(), rarity)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader()
        for batch in batches:
            levels, found = [], []
            at = 0
            for part in _parts(batch.column(1)) if model else ():
                which, lang, words, features = reader.sentences(part, rarity)
                level, size = vote(which, model.levels(features, lang), words, len(part)) if len(which) else (np.empty(0), np.empty(0))
                good = np.flatnonzero(size >= LEAST_WORDS)
                found.append(good + at)
                levels.append(level[good])
                at += len(part)
            keys = batch.column(0).take(pa.array(np.concatenate(found) if found else [], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array(np.concatenate(levels) if levels else [], pa.int32())], names=[key, "reading_level"])

    return spread(read, 1).mapInArrow(run, f"{key} {kind}, reading_level int")
