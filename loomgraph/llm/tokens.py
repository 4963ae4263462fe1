"""Columnar splitting of whole texts into words inside Arrow tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text that a task takes up at a time; a longer text is taken by itself, and cut where its parts add up.
CHUNK = 800_000
#: Bytes of a word up to which it is hashed in steps of eight, with all others at once.
SHORT_WORD = 64
#: Characters that bare words don't begin or end with.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~“”‘’«»„…–—¿¡"


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", chars: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of at most that many bytes of text, so that memory doesn't follow the batch's rows."""
    for b in batches:
        if not b.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + chars, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi
        pa.default_memory_pool().release_unused()  # workers live on from task to task


_BLANK = re.compile(rb"[\x20\x09-\x0D]")


def pieces(texts: pa.Array, size: int = CHUNK, words: bool = True) -> Iterator[pa.Array]:
    """The texts as they are or, if they are one text of over twice that size, parts of it that end at white space.

    Unless words, a word of over `size` bytes is cut too, between characters: so no part is larger than twice the size.
    """
    if len(texts) != 1 or not texts[0].is_valid or len(b := texts.cast(pa.large_binary())[0].as_buffer()) <= 2 * size:
        yield texts
        return
    view, lo = memoryview(b), 0
    while lo < len(view):
        end = len(view)
        if lo + 2 * size < end:
            m = _BLANK.search(view, lo + size, end if words else lo + 2 * size)
            end = m.start() if m else end if words else lo + 2 * size
            while end < len(view) and view[end] & 0xC0 == 0x80:
                end -= 1
        yield pa.array([bytes(view[lo:end])], pa.large_binary()).cast(pa.large_string())
        lo = end


def whole(texts: pa.Array) -> pa.Array:
    """Texts as large strings in buffers of their own, null as empty: Arrow's ascii_lower reads a slice's buffers from their start."""
    return pc.fill_null(texts.take(pa.array(np.arange(len(texts)))).cast(pa.large_string()), "")


class Words:
    """The words of some texts: `unique` (Arrow), `codes` into it for each word, `ends` and `doc` by text."""

    def __init__(self, texts: pa.Array, lower: bool = True) -> None:
        texts = whole(texts)
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        flat = lists.flatten()
        at = np.asarray(lists.offsets) - lists.offsets[0].as_py()
        full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        self.ends = np.r_[0, np.cumsum(full)][at][1:]
        coded = flat.filter(pa.array(full)).dictionary_encode()
        self.unique, self.codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.counts = np.diff(np.r_[0, self.ends])

    def bare(self) -> Words:
        """The same words in lower case without marks around them; those of marks alone go."""
        coded = pc.utf8_trim(pc.utf8_lower(self.unique), characters=MARKS).dictionary_encode()
        full = pc.greater(pc.binary_length(coded.dictionary), 0).to_numpy(zero_copy_only=False)
        code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.codes = code[self.codes] if len(code) else self.codes
        keep = full[self.codes] if len(full) else np.empty(0, bool)
        self.ends = np.r_[0, np.cumsum(keep)][self.ends]
        self.codes, self.unique, self.counts = self.codes[keep], coded.dictionary, np.diff(np.r_[0, self.ends])
        return self

    @property
    def starts(self) -> np.ndarray:
        return self.ends - self.counts

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.ends)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each unique word."""
        return hashes(self.unique)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(strings: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: eight bytes at a time of all short ones, XXH64 of the others."""
    a = strings.cast(pa.large_binary())
    n = pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    h = mix((n + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    if not len(n) or not n.max():
        return h
    starts = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)[:-1]
    data = np.concatenate([np.frombuffer(a.buffers()[2], np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # those from each byte on
    left = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    at = np.flatnonzero((n > 0) & (n <= SHORT_WORD))
    k = 0
    while at.size:
        x = eight[starts[at] + k] & left[np.minimum(n[at] - k, 8)]
        h[at] = mix((h[at] ^ x) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(k + 1))
        k += 8
        at = at[n[at] > k]
    for i in np.flatnonzero(n > SHORT_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(a[i].as_buffer())
    return h


def strings(a: pa.Array) -> list[str]:
    return a.to_numpy(zero_copy_only=False).tolist()


class Memo:
    """Rows of a worker's own tables by word. Words that come again stay; over the limit those that came once go."""

    def __init__(self, limit: int) -> None:
        self.limit, self.at, self.hits = limit, {}, np.zeros(0, np.int32)

    def shrink(self) -> np.ndarray | None:
        """If there are too many: the rows that stay, in their new order."""
        if len(self.at) <= self.limit:
            return None
        keep = np.flatnonzero(self.hits > 1)
        if len(keep) > self.limit // 2:
            keep = np.sort(keep[np.argsort(-self.hits[keep], kind="stable")[: self.limit // 2]])
        names = list(self.at)
        self.at, self.hits = {names[k]: i for i, k in enumerate(keep.tolist())}, self.hits[keep] // 2 + 1
        return keep

    def find(self, words: list[str]) -> tuple[np.ndarray, list[str]]:
        """(rows of distinct words, the new ones among them, whose rows follow those before)."""
        new = [w for w in words if w not in self.at]
        self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
        rows = np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        self.hits = np.r_[self.hits, np.zeros(len(new), np.int32)]
        self.hits[rows] += 1
        return rows, new


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions starts[i] .. starts[i] + lengths[i] - 1 for each i, in a row."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def runs_sum(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of values (by their first axis) over runs of that many rows; empty runs give 0."""
    out = np.zeros((len(counts), *values.shape[1:]))
    full = np.flatnonzero(counts)
    if len(full):
        out[full] = np.add.reduceat(values, (np.cumsum(counts) - counts)[full], axis=0, dtype=np.float64)
    return out
