"""Byte-level BPE of a whole corpus.

Each distinct pre-token is resolved once per worker. The first tier is a minimal perfect hash over
the vocabulary's byte strings: one probe says whether the whole pre-token is a vocabulary entry.
What it misses is merged by a heap of candidate pairs over a doubly linked list of byte pieces.
Ids of a batch are then gathered from the resolved pre-tokens with one ragged numpy take, so the
work per occurrence is one hash lookup.

Defined results: an empty text and a null text both give an empty list; strings of special tokens
are plain text.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import xxhash
from pyspark.sql import DataFrame

from glyphmill.session import spread

#: Fixed value: the pre-token pattern of the public byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens longer than this many characters are merged each time instead of being remembered.
LONGEST_KEPT = 64
#: A worker remembers no more resolved pre-tokens than this; at the next batch it starts afresh.
MOST_KEPT = 400_000
#: Bytes of text encoded together; a longer text is encoded alone.
BYTES_AT_ONCE = 8_000_000
WRAP = 0xFFFFFFFFFFFFFFFF
TOKENIZERS = os.environ.get("GLYPHMILL_TOKENIZERS", "/opt/tokenizers")


def read_ranks(path: str) -> list[bytes]:
    """Byte strings of a rank file in id order."""
    with open(path, "rb") as lines:
        ranks = sorted((int(rank), base64.b64decode(text)) for text, rank in (line.split() for line in lines if line.strip()))
    if [r for r, _ in ranks] != list(range(len(ranks))):
        raise ValueError(f"{path}: ranks are not 0..n-1")
    return [text for _, text in ranks]


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings, by hash and displace.

    Keys fall into buckets; buckets, largest first, get the first displacement that sends all
    their keys to free slots. Buckets of one key hold their slot itself, as a negative number.
    Every slot holds one key, so the probe compares a single stored string.
    """

    def __init__(self, keys: list[bytes], load: int = 4):
        self.n = n = len(keys)
        self.buckets = max(1, n // load)
        self.shift = [0] * self.buckets
        self.slot_key: list[bytes] = [b""] * n
        self.slot_id = [0] * n
        members: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            a, b = self._hashes(key)
            members[a % self.buckets].append((a >> 20, b, i))
        free = bytearray(b"\1") * n
        for bucket in sorted(range(self.buckets), key=lambda x: -len(members[x])):
            own = members[bucket]
            if len(own) < 2:
                break
            d = self._displacement(own, free)
            self.shift[bucket] = d
            for a, b, i in own:
                self._put(((a + d * b) & WRAP) % n, keys[i], i, free)
        rest = iter([s for s in range(n) if free[s]])
        for bucket, own in enumerate(members):
            if len(own) == 1:
                slot = next(rest)
                self.shift[bucket] = -slot - 1
                self._put(slot, keys[own[0][2]], own[0][2], free)

    def _displacement(self, own: list[tuple[int, int, int]], free: bytearray) -> int:
        """The first displacement that sends all keys of a bucket to free slots.

        Sums wrap at 64 bits before they are taken modulo ``n``: modulo ``n`` alone, a step that
        shares factors with ``n`` comes to few slots, and the search need not end.
        """
        a, b = (np.array([x[k] for x in own], dtype=np.uint64)[:, None] for k in (0, 1))
        open_slot = np.frombuffer(free, dtype=np.uint8)
        first, many = 0, 64
        while True:
            slots = (a + np.arange(first, first + many, dtype=np.uint64) * b) % np.uint64(self.n)
            for k in np.flatnonzero(open_slot[slots].all(axis=0)):
                if len(set(slots[:, k].tolist())) == len(own):
                    return first + int(k)
            first, many = first + many, min(4096, many * 4)

    def _put(self, slot: int, key: bytes, i: int, free: bytearray) -> None:
        free[slot] = 0
        self.slot_key[slot], self.slot_id[slot] = key, i

    @staticmethod
    def _hashes(key: bytes) -> tuple[int, int]:
        whole = xxhash.xxh3_128_intdigest(key)
        return whole & 0xFFFFFFFFFFFFFFFF, (whole >> 64) | 1

    def get(self, key: bytes) -> int:
        """Id of ``key``, or -1."""
        a, b = self._hashes(key)
        d = self.shift[a % self.buckets]
        slot = -d - 1 if d < 0 else (((a >> 20) + d * b) & WRAP) % self.n
        return self.slot_id[slot] if self.slot_key[slot] == key else -1


class Encoder:
    def __init__(self, path: str):
        vocab = read_ranks(path)
        self.hash = PerfectHash(vocab)
        ids = {text: i for i, text in enumerate(vocab)}
        self.byte_id = [ids[bytes([b])] for b in range(256)]
        # Every way to split an entry into two entries is a pair that may merge into it.
        self.pairs: dict[int, int] = {}
        for text, i in ids.items():
            for cut in range(1, len(text)):
                left, right = ids.get(text[:cut]), ids.get(text[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = i
        self.find = regex.compile(PATTERN).findall

    def merge(self, raw: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, until no neighbouring pair merges."""
        pairs = self.pairs
        piece = [self.byte_id[b] for b in raw]
        n = len(piece)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            made = pairs.get(piece[i] << 20 | piece[i + 1])
            if made is not None:
                heap.append(made << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            made, i = top >> 32, top & 0xFFFFFFFF
            if piece[i] < 0:
                continue
            j = after[i]
            if j >= n or pairs.get(piece[i] << 20 | piece[j]) != made:
                continue  # one of the two has been merged since
            piece[i], piece[j] = made, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                made = pairs.get(piece[i] << 20 | piece[k])
                if made is not None:
                    heapq.heappush(heap, made << 32 | i)
            h = before[i]
            if h >= 0:
                made = pairs.get(piece[h] << 20 | piece[i])
                if made is not None:
                    heapq.heappush(heap, made << 32 | h)
        return [p for p in piece if p >= 0]

    def resolve(self, token: str) -> list[int]:
        raw = token.encode("utf-8", "replace")
        whole = self.hash.get(raw)
        return [whole] if whole >= 0 else self.merge(raw)

    def encode(self, text: str | None) -> list[int]:
        return [i for token in self.find(text or "") for i in self.resolve(token)]


class Ragged:
    """Id lists end to end in an array that doubles as it grows."""

    def __init__(self):
        self.ids, self.used = np.empty(1024, dtype=np.int32), 0
        self.start, self.many = np.zeros(1024, dtype=np.int64), 0

    def append(self, ids: list[int]) -> int:
        end = self.used + len(ids)
        if end > len(self.ids):
            self.ids = np.resize(self.ids, max(end, 2 * len(self.ids)))
        if self.many + 2 > len(self.start):
            self.start = np.resize(self.start, 2 * len(self.start))
        self.ids[self.used : end] = ids
        self.used, self.many = end, self.many + 1
        self.start[self.many] = end
        return self.many - 1

    def gather(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and ids of the lists ``which``, in order."""
        lengths = self.start[which + 1] - self.start[which]
        ends = np.cumsum(lengths)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[which] - ends + lengths, lengths)
        return lengths, self.ids[take]


class Resolved(dict):
    """Pre-token to its number in a growing table of id lists.

    What is too long or too much to remember goes to a table of the batch alone, by the negative
    numbers -1, -2 and so on.
    """

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.kept = Ragged()
        self.forget()

    def forget(self) -> None:
        self.once = Ragged()

    def __missing__(self, token: str) -> int:
        ids = self.encoder.resolve(token)
        if len(token) > LONGEST_KEPT or len(self) >= MOST_KEPT:
            return -1 - self.once.append(ids)
        self[token] = number = self.kept.append(ids)
        return number


class BatchEncoder:
    def __init__(self, path: str):
        self.encoder = Encoder(path)
        self.seen = Resolved(self.encoder)

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and values of the id lists of ``texts``."""
        if len(self.seen) >= MOST_KEPT:
            self.seen = Resolved(self.encoder)
        find, seen = self.encoder.find, self.seen
        numbers: list[int] = []
        ends = np.zeros(len(texts) + 1, dtype=np.int64)
        for k, text in enumerate(texts):
            if text:
                numbers += map(seen.__getitem__, find(text))
            ends[k + 1] = len(numbers)
        which = np.asarray(numbers, dtype=np.int64)
        once = which < 0
        lengths, flat = seen.kept.gather(np.where(once, 0, which) if seen.kept.many else which[:0])
        if once.any():
            # the few that are not remembered are set between the others
            lengths = np.zeros(len(which), dtype=np.int64)
            lengths[~once], kept = seen.kept.gather(which[~once])
            lengths[once], rare = seen.once.gather(-1 - which[once])
            flat = np.empty(lengths.sum(), dtype=np.int32)
            mask = np.repeat(once, lengths)
            flat[mask], flat[~mask] = rare, kept
            seen.forget()
        out_end = np.concatenate(([0], np.cumsum(lengths)))
        return out_end[ends], flat


_encoders: dict[str, BatchEncoder] = {}


def batch_encoder(path: str) -> BatchEncoder:
    """One per worker process and vocabulary; it outlives the task."""
    if path not in _encoders:
        _encoders[path] = BatchEncoder(path)
    return _encoders[path]


def parts(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about `BYTES_AT_ONCE`, so that offsets fit and memory is bounded."""
    ends = np.cumsum(lengths, dtype=np.int64)
    a = 0
    while a < len(lengths):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + BYTES_AT_ONCE, side="right")))
        yield a, b
        a = b


def encode_corpus(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``key`` and ``ids`` of every row; nulls and empty texts give empty lists.

    A map over the two needed columns: no shuffle beyond spreading a small input over the cores,
    nothing is gathered, and a lost task is simply run again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = batch_encoder(vocabulary)
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            for a, b in parts(lengths):
                part = batch.slice(a, b - a)
                ends, values = encode(part.column(1).to_pylist())
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    kind = dict(df.dtypes)[key]
    return spread(df.select(key, text)).mapInArrow(run, f"{key} {kind}, ids array<int>")
