"""Hierarchical multi-length packing of token sequences.

A document goes to the tier of the smallest window that holds it; what is over a full window leaves as full windows first. Tiers are
packed from the longest: a rest opens a window of its tier, shorter rests fill the gap from the largest down, and the last of the gap
is cut from the shortest rest that covers it. So a window closes only when it is full. Each task packs what it has read and hands on
its one open window; the open windows of many tasks are packed together. Full windows of a tier are dealt to step groups of equal
tokens in alternating order of their attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.tokens import Memo, chunks, pieces, ragged, strings, whole

WINDOW = 4096
TIERS = (512, 1024, 2048, 4096)
END_ID = 2
#: Tokens and documents that a task packs at a time, tokens of a step group, tasks whose open windows are packed together.
POOL_TOKENS, POOL_DOCS = 2_000_000, 20_000
STEP_TOKENS = 64 * WINDOW
TAILS = 512
#: Words whose ids a worker remembers.
MEMO = 300_000
#: Marks that may close a word, and the last character of one that they surely are no part of.
CLOSING, LETTER_LAST = ".,;:!?%$&*#", "[a-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u03b1-\u03c9\u0430-\u044f]$"
VOCABULARY = "word_bpe_49k.json"

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long, part long, ids binary"
FIELDS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group", "part", "ids"]


@cache
def _tokenizer(path: str):  # noqa: ANN202
    import os

    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizer.from_file(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _tails(all_: pa.Array, starts: pa.Array) -> pa.Array:
    """What follows in each large string after its given beginning."""
    skip, n = (pc.binary_length(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in (starts, all_))
    at = np.frombuffer(all_.buffers()[1], np.int64, len(all_) + 1, all_.offset * 8)[:-1] + skip
    data = np.frombuffer(all_.buffers()[2] or b"", np.uint8)[ragged(at, n - skip)]
    return pa.LargeStringArray.from_buffers(len(n), pa.py_buffer(np.r_[0, np.cumsum(n - skip)].astype(np.int64)), pa.py_buffer(data))


class Encoder:
    """Token ids of whole texts, by way of their stretches between spaces and line feeds: the tokenizer never joins across those.

    A stretch's closing marks are a token group of their own, so that it is looked up as two words: one without them in lower case
    (the tokenizer lower-cases all), and the marks. A worker keeps what it has learned from task to task.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer, self.memo = _tokenizer(path), Memo(MEMO)
        self.flat, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int32)

    def _rows(self, words: list[str]) -> np.ndarray:
        if (keep := self.memo.shrink()) is not None:
            n = self.lengths[keep]
            self.flat = self.flat[ragged(self.starts[keep], n)]
            self.starts, self.lengths = np.cumsum(n) - n, n
        rows, new = self.memo.find(words)
        if new:
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), np.int32, len(ids))
            self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(n) - n]
            self.lengths = np.r_[self.lengths, n]
            self.flat = np.r_[self.flat, np.fromiter(chain.from_iterable(ids), np.uint32, int(n.sum()))]
        return rows

    def _part(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's end)."""
        lists = pc.split_pattern(pc.replace_substring(whole(texts), "\n", " "), " ")
        coded = lists.flatten().dictionary_encode()
        low = pc.ascii_lower(coded.dictionary)
        core = pc.ascii_rtrim(low, characters=CLOSING)
        core = pc.if_else(pc.match_substring_regex(core, LETTER_LAST), core, low)
        both = pa.concat_arrays([core, _tails(low, core)]).dictionary_encode()
        row = self._rows(strings(both.dictionary))[both.indices.to_numpy(zero_copy_only=False)] if len(both) else np.empty(0, np.int64)
        row = row.reshape(2, -1).T.ravel()  # each stretch's word, then its marks
        sizes = self.lengths[row].astype(np.int64)
        own = self.flat[ragged(self.starts[row], sizes)]
        sizes = sizes.reshape(-1, 2).sum(axis=1)
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = sizes[at]
        ids = own[ragged((np.cumsum(sizes) - sizes)[at], n)]
        return ids, np.r_[0, np.cumsum(n)][(np.asarray(lists.offsets) - lists.offsets[0].as_py())[1:]]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row with END_ID after each, tokens of each text)."""
        parts = [self._part(x) for x in pieces(texts)]
        ids, ends = parts[0] if len(parts) == 1 else (np.concatenate([x for x, _ in parts]), np.array([sum(len(x) for x, _ in parts)]))
        return np.insert(ids, ends, END_ID), np.diff(ends, prepend=0) + 1


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Pool:
    """Rests of documents: (length, start, document), and the windows made of them."""

    def __init__(self) -> None:
        self.rests: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int | None, int, int, np.ndarray]] = []  # doc_id, all its tokens, where the ids here start, ids
        self.windows: list[tuple[int, list[tuple[int, int, int]]]] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray, total: int | None = None, start: int = 0) -> None:
        d = len(self.docs)
        self.docs.append((doc_id, len(ids) if total is None else total, start, ids))
        self.tokens += len(ids)
        at, end = start, start + len(ids)
        while end - at >= WINDOW:
            self.windows.append((WINDOW, [(WINDOW, at, d)]))
            at += WINDOW
        if end > at:
            self.rests.append((end - at, at, d))

    def pack(self) -> list[tuple[int, int, int]]:
        """Fills windows; returns the rests of the one that stays open."""
        rests = sorted(self.rests)
        self.rests = []
        while rests:
            n, at, d = rests.pop()
            tier = next(t for t in TIERS if t >= n)
            window, gap = [(n, at, d)], tier - n
            while gap and rests:
                k = bisect_right(rests, (gap, 1 << 62, 0))
                if k:
                    n, at, d = rests.pop(k - 1)
                else:
                    whole, at, d = rests.pop(0)
                    n = gap
                    insort(rests, (whole - gap, at + gap, d))
                window.append((n, at, d))
                gap -= n
            if gap:
                return window
            self.windows.append((tier, window))
        return []

    def rows(self, first_sequence: int, first_group: int) -> list[tuple]:
        """A row for each piece of the full windows."""
        order = sorted(range(len(self.windows)), key=lambda i: (self.windows[i][0], -sum(n * n for n, _, _ in self.windows[i][1]), i))
        group, out, base = {}, [], first_group
        for tier in TIERS:
            own = [i for i in order if self.windows[i][0] == tier]
            groups = -(-len(own) * tier // STEP_TOKENS)
            for k, i in enumerate(own):
                lap, seat = divmod(k, groups)
                group[i] = base + (seat if lap % 2 == 0 else groups - 1 - seat)
            base += groups
        for i, (tier, window) in enumerate(self.windows):
            offset = 0
            for n, at, d in window:
                out.append((*self.piece(n, at, d), first_sequence + i, offset, tier, group[i], None, None))
                offset += n
        return out

    def piece(self, n: int, at: int, d: int) -> tuple:
        doc_id, total, start, ids = self.docs[d]
        return doc_id, at, n, zlib.crc32(ids[at - start : at - start + n].astype("<u4").tobytes()), total

    def ids(self, n: int, at: int, d: int) -> np.ndarray:
        _, _, start, ids = self.docs[d]
        return ids[at - start : at - start + n]


def _frame(rows: list[tuple]) -> pd.DataFrame:
    d = pd.DataFrame(rows, columns=FIELDS)
    return d.astype({c: "Int64" for c in FIELDS if c not in ("ids", "tier")} | {"tier": "Int32"})


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32() if f == "tier" else pa.binary() if f == "ids" else pa.int64() for f in FIELDS]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], FIELDS)


def _pack_task(path: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        base = part << 32
        encode, pool, sequences, groups = encoder(path), Pool(), 0, 0

        def close(pool: Pool) -> tuple[Pool, pa.RecordBatch]:
            nonlocal sequences, groups
            left = pool.pack()
            rows = pool.rows(base + sequences, base + groups)
            sequences += len(pool.windows)
            groups += len(pool.windows) + 1
            new = Pool()
            for n, at, d in left:
                doc_id, total, _, _ = pool.docs[d]
                new.add(doc_id, pool.ids(n, at, d), total, at)
            return new, _batch(rows)

        for b in chunks(batches):
            ids, counts = encode(b.column("text"))
            ends = np.cumsum(counts)
            for doc_id, lo, hi in zip(b.column("doc_id").to_pylist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                pool.add(doc_id, ids[lo:hi])
                if pool.tokens >= POOL_TOKENS or len(pool.docs) >= POOL_DOCS:
                    pool, rows = close(pool)
                    yield rows
        pool, rows = close(pool)
        yield rows
        open_window = [(*pool.piece(n, at, d), None, None, None, None, part, pool.ids(n, at, d).astype("<u4").tobytes()) for n, at, d in pool.rests]
        yield _batch(open_window)

    return run


def _pack_tails(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Packs the open windows of up to TAILS tasks; the last one stays short and is padded."""
    base = (1 << 62) | (int(key[0]) << 32)
    pool = Pool()
    for doc_id, start, total, ids in rows.sort_values(["part", "doc_id", "start"])[["doc_id", "start", "doc_tokens", "ids"]].itertuples(index=False):
        pool.add(None if pd.isna(doc_id) else int(doc_id), np.frombuffer(ids, "<u4"), int(total), int(start))
    if left := pool.pack():
        pool.windows.append((WINDOW, left))
    return _frame(pool.rows(base, base))


def pack(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """One row for each piece of a packed sequence: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    Every id of every text, END_ID after it, lies in one piece; null texts are one END_ID. All sequences are full windows of their
    tier but one for each TAILS tasks. Rows that repeat are packed each; a null doc_id stays null. Other columns are not read.
    """
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    made = settle(d.mapInArrow(_pack_task(tokenizer_path or vocabulary_path()), PIECE), "pieces")
    tails = made.where("sequence_id is null").withColumn("tails", F.expr(f"part div {TAILS}"))
    packed = tails.groupBy("tails").applyInPandas(_pack_tails, PIECE)
    return made.where("sequence_id is not null").unionByName(packed).drop("part", "ids")
