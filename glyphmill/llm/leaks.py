"""Documents that give away held-out passages.

Documents and items are folded to words (a character of Chinese, Japanese or Korean is a word).
Every window of an item, as long as what must be found of it, has a SimHash over its words,
weighted by their rarity among the items; words that no item holds weigh nothing. Windows of
documents are hashed at every fourth word, which meets each passage in step, since items are
hashed at every word. A multi-index of blocks, one more than the radius, then yields every pair of
fingerprints within the radius, and each candidate is verified on the words around it: in-order
words (a longest common subsequence) and weighted three-word shingles.

The items are held-out material. No more than a fixed number of them is sent to the workers at
once; a larger set is taken in slices, each run over all documents.

Defined results: null, empty and blank texts and items give nothing away; repeated documents are
reported each; a passage of fewer words than the shortest window is found by no window.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm.glyphs import LOOK_ALIKE
from glyphmill.session import spread

BITS = 64
RADIUS = 7
STEP = 4
SIZES = (8, 12, 16, 24, 32, 48, 64)
#: Share of a context's words that make a leak, in their order, and of the weight of its shingles.
CONTEXT_WORDS, CONTEXT_SHINGLES = 0.5, 0.4
#: Shares of the words of a source and of the answer that goes with it; single words may differ.
SOURCE_WORDS, ANSWER_WORDS = 0.7, 0.65
SHINGLE = 3
#: Share of the least weight of an item's window that a window must hold to be hashed at all.
LEAST_WEIGHT = 0.5
#: Items sent to the workers at a time.
ITEMS_AT_ONCE = 5_000
#: Windows hashed, and fingerprint pairs compared, at a time.
WINDOWS_AT_ONCE, PAIRS_AT_ONCE = 4_096, 2_000_000
#: Bytes of text taken together; a longer document is taken alone.
TEXT_AT_ONCE = 2_000_000

CJK = "぀-ヿ㐀-鿿가-힯"
WORD = re.compile(rf"[{CJK}]|[^\W_{CJK}]+")
PLAIN_WORD = re.compile(r"[a-z0-9]+")
_latin = {ord(k): v.lower() for k, v in LOOK_ALIKE.items() if not "぀" <= k <= "鿿"}
_folds = {ord(a): b for a, b in zip("يىكةأإ", "ییکهاا", strict=True)} | dict.fromkeys([0xAD, 0x640, *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2065), 0xFEFF, *range(0x64B, 0x653), *range(0xFE00, 0xFE10)])
FOLD = _latin | _folds | {ord(chr(k).casefold()): v for k, v in _latin.items() if len(chr(k).casefold()) == 1}

FOLDED = re.compile("[" + re.escape("".join(map(chr, FOLD))) + "]")


def words(text: str | None) -> list[str]:
    if not text:
        return []
    if text.isascii():
        return PLAIN_WORD.findall(text.lower())
    form = unicodedata.normalize("NFKC", text).casefold().replace("\u200c", "")
    return WORD.findall(form.translate(FOLD) if FOLDED.search(form) else form)


def in_order(item: dict[int, int], size: int, text: list[int]) -> int:
    """Length of the longest common subsequence; ``item`` has the places of each word as bits."""
    full = (1 << size) - 1
    free = full
    for w in text:
        if places := item.get(w):
            hit = free & places
            free = ((free + hit) | (free - hit)) & full
    return size - free.bit_count()


class Passage:
    def __init__(self, ids: list[int]):
        self.ids, self.size = ids, len(ids)
        self.places: dict[int, int] = defaultdict(int)
        for i, w in enumerate(ids):
            self.places[w] |= 1 << i
        self.shingles = [tuple(ids[i : i + SHINGLE]) for i in range(len(ids) - SHINGLE + 1)]

    def share(self, text: list[int]) -> float:
        return in_order(self.places, self.size, text) / self.size if self.size else 0.0

    def best_share(self, text: list[int]) -> float:
        """The largest share over the places of ``text`` where words of the passage stand thick."""
        if not self.size:
            return 0.0
        hits = np.isin(np.asarray(text), np.asarray(self.ids)).astype(np.int64)
        span = self.size + self.size // 2
        if len(text) <= span:
            return self.share(text)
        total = np.concatenate(([0], np.cumsum(hits)))
        thick = total[span:] - total[:-span]
        best = 0.0
        for start in range(0, len(thick), max(1, self.size // 4)):
            if thick[start] > best * self.size:
                best = max(best, self.share(text[start : start + span]))
        return best


class Items:
    """Held-out items: per item a context, a source, and the answers to it."""

    def __init__(self, rows: list[tuple[str, str | None, str | None, list[str]]]):
        texts = [[words(context), words(source), *map(words, answers)] for _, context, source, answers in rows]
        self.names = [r[0] for r in rows]
        spread_of = Counter(w for item in texts for w in {x for part in item for x in part})
        self.known = {w: i for i, w in enumerate(sorted(spread_of), 1)}
        self.weight = np.zeros(len(self.known) + 1, dtype=np.float32)
        bits = np.zeros((len(self.known) + 1, BITS), dtype=np.float32)
        for w, i in self.known.items():
            self.weight[i] = math.log(1 + len(rows) / spread_of[w])
            mixed = np.frombuffer(xxhash.xxh3_64_digest(w.encode("utf-8", "replace")), dtype=np.uint8)
            bits[i] = np.unpackbits(mixed) * 2.0 - 1.0
        self.vectors = bits * self.weight[:, None]
        self.parts = [[Passage([self.known[w] for w in part]) for part in item] for item in texts]
        shingles = Counter(s for item in self.parts for s in set(item[0].shingles))
        self.rarity = {s: math.log(1 + len(rows) / n) for s, n in shingles.items()}
        by_size: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for k, item in enumerate(self.parts):
            for part, share in ((0, CONTEXT_WORDS), (1, 1.0)):
                enough = int(item[part].size * share) - STEP + 1
                if fitting := [s for s in SIZES if s <= enough]:
                    by_size[fitting[-1]] += [(k, part, at) for at in range(item[part].size - fitting[-1] + 1)]
        self.indexes = {size: Blocks(self, size, where) for size, where in by_size.items()}

    def fingerprints(self, ids: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.empty(len(starts), dtype=np.uint64)
        for a in range(0, len(starts), WINDOWS_AT_ONCE):
            part = starts[a : a + WINDOWS_AT_ONCE]
            total = np.zeros((len(part), BITS), dtype=np.float32)
            for k in range(size):
                total += self.vectors[ids[part + k]]
            out[a : a + len(part)] = np.packbits(total > 0, axis=1).view(np.uint64).ravel()
        return out

    def leaked(self, text: list[int], item: int, part: int, at: int, size: int) -> bool:
        """Whether ``text`` gives away the item, a window of which it seems to hold at ``at``."""
        passages = self.parts[item]
        own = passages[part]
        near = text[max(0, at - own.size) : at + size + own.size]
        if part == 0:
            if own.share(near) < CONTEXT_WORDS:
                return False
            there = {tuple(near[i : i + SHINGLE]) for i in range(len(near) - SHINGLE + 1)}
            weights = [(self.rarity[s], s in there) for s in own.shingles]
            return sum(w for w, hit in weights if hit) >= CONTEXT_SHINGLES * sum(w for w, _ in weights)
        return own.share(near) >= SOURCE_WORDS and any(p.best_share(text) >= ANSWER_WORDS for p in passages[2:])


class Blocks:
    """Multi-index of the fingerprints of all item windows of one size."""

    def __init__(self, items: Items, size: int, where: list[tuple[int, int, int]]):
        flat, starts = [], []
        for k, part, at in where:
            starts.append(len(flat))
            flat += items.parts[k][part].ids[at : at + size]
        ids = np.asarray(flat, dtype=np.int64)
        self.size = size
        prints = items.fingerprints(ids, np.asarray(starts, dtype=np.int64), size)
        weights = items.weight[ids].reshape(-1, size).sum(axis=1)
        self.least = float(weights.min()) * LEAST_WEIGHT
        seen: dict[tuple[int, int, int], None] = {}
        for (k, part, _), p in zip(where, prints.tolist(), strict=True):
            seen.setdefault((k, part, p))
        self.item, self.part = (np.asarray([s[i] for s in seen], dtype=np.int32) for i in (0, 1))
        self.prints = np.asarray([s[2] for s in seen], dtype=np.uint64)
        cuts = np.linspace(0, BITS, RADIUS + 2).astype(int)
        self.blocks = []
        for a, b in zip(cuts, cuts[1:]):
            shift, mask = np.uint64(a), np.uint64((1 << int(b - a)) - 1)
            value = (self.prints >> shift) & mask
            order = np.argsort(value, kind="stable")
            first = np.searchsorted(value[order], np.arange((1 << int(b - a)) + 1, dtype=np.uint64))
            self.blocks.append((shift, mask, order, first))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every pair of a given print and an item print within the radius."""
        left, right = [], []
        for shift, mask, order, first in self.blocks:
            value = ((prints >> shift) & mask).astype(np.int64)
            many = first[value + 1] - first[value]
            for a, b in _slices(many, PAIRS_AT_ONCE):
                n = many[a:b]
                who = np.repeat(np.arange(a, b), n)
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[value[a:b]], n)
                other = order[at]
                close = np.bitwise_count(prints[who] ^ self.prints[other]) <= RADIUS
                left.append(who[close])
                right.append(other[close])
        return (np.concatenate(left), np.concatenate(right)) if left else (np.empty(0, int), np.empty(0, int))


def _slices(many: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges whose counts add up to about ``most``."""
    ends = np.cumsum(many)
    a = 0
    while a < len(many):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right")))
        yield a, b
        a = b


def find(items: Items, texts: list[str | None]) -> list[tuple[int, int]]:
    """Place of a text and number of an item it gives away, in order."""
    get = items.known.get
    ids: list[list[int]] = [[get(w, 0) for w in words(t)] for t in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int64)
    flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in ids]) if ids else np.empty(0, np.int64)
    total = np.concatenate(([0.0], np.cumsum(items.weight[flat], dtype=np.float64)))
    owner = np.repeat(np.arange(len(ids)), np.diff(starts))
    in_step = (np.arange(len(flat)) - starts[owner]) % STEP == 0
    seen: dict[tuple[int, int], bool] = {}
    for size, index in sorted(items.indexes.items()):
        if len(flat) < size:
            continue
        last = len(flat) - size
        good = in_step[: last + 1] & (owner[: last + 1] == owner[size - 1 :]) & (total[size:] - total[: last + 1] >= index.least)
        spots = np.flatnonzero(good)
        if not len(spots):
            continue
        who, other = index.near(items.fingerprints(flat, spots, size))
        found = np.unique(np.stack([owner[spots[who]], index.item[other], index.part[other], spots[who] - starts[owner[spots[who]]]], axis=1), axis=0)
        tried: dict[tuple[int, int, int], int] = {}
        for doc, item, part, at in found.tolist():
            # windows in steps of a quarter of their size see the same words around them
            if seen.get((doc, item)) or at < tried.get((doc, item, part), -1):
                continue
            tried[doc, item, part] = at + max(STEP, size // 4)
            if items.leaked(ids[doc], item, part, at, size):
                seen[doc, item] = True
    return sorted(seen)


def leaks(documents: DataFrame, cases: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``case_id`` of each document and each case that it gives away."""
    read = documents.select(F.col(key), F.col(text))
    rows = cases.where("id is not null").select("id", "context", "source", "gloss", F.get("accept", F.lit(0)).alias("first")).orderBy("id")
    held = tuple((r.id, r.context, r.source, tuple(x for x in (r.gloss, r.first) if x)) for r in rows.toLocalIterator())
    kind = dict(read.dtypes)[key]
    slices = [held[i : i + ITEMS_AT_ONCE] for i in range(0, len(held), ITEMS_AT_ONCE)] or [()]
    out = None
    for part in slices:
        found = spread(read).mapInArrow(_run(part, key), f"{key} {kind}, case_id string")
        out = found if out is None else out.unionByName(found)
    return out


@lru_cache(2)
def items_of(rows: tuple) -> Items:
    """One per worker process and slice of items; it outlives the task."""
    return Items(list(rows))


def _run(rows: tuple, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = items_of(rows)
        for batch in batches:
            pairs = []
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in _slices(lengths, TEXT_AT_ONCE):
                pairs += [(a + doc, item) for doc, item in find(items, batch.column(1).slice(a, b - a).to_pylist())]
            keys = batch.column(0).take(pa.array([d for d, _ in pairs], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([items.names[i] for _, i in pairs], pa.string())], names=[key, "case_id"])

    return run
