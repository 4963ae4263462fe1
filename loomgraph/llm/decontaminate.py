"""Benchmark decontamination by latent semantic retrieval.

Documents are windows of words (passages), weighted by TF-IDF over hashed terms. A randomised SVD, whose products with the term matrix
are summed by Spark over all passages of all documents and all benchmark items, gives the latent space; a block of items has a space of
its own. Every passage of every document, at the window size that suits an item's length, is projected and compared by cosine with the
items. Items whose first words stand in a document as they are come in by these too, so that no verbatim leak hangs on a cosine. Of
these candidates the longest common subsequence of words, and for paraphrases the answer, decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.tokens import Words, chunks

#: Words of a block; windows are of that many blocks, and start at every quarter of that, for items of up to that many words (the last: any).
STRIDE, WINDOWS = 8, ((2, 12), (4, 28), (8, 1 << 30))
#: Words of a passage that the space is fitted on; passages begin at every half of that. Bytes of terms that a task multiplies at a time.
FIT_WORDS, FIT_BYTES = 64, 1 << 20
#: Hashed terms, terms of the latent space (all of the items', then the most frequent), its dimensions, extra columns and rounds of the SVD.
BITS, TERMS, RANK, EXTRA, ROUNDS = 18, 24_000, 64, 8, 2
#: Benchmark items to a space, and spaces that one pass over the documents searches.
ITEMS, SPACES = 1024, 8
COSINE = 0.4
#: Share of an item's words, in order: a leak as such, or one if the answer's words are there too. Shorter items must be whole.
VERBATIM, PARAPHRASE, ANSWER, LEAST_WORDS = 0.75, 0.5, 0.8, 8
BLOCK = 1 << 14
#: Blobs of a block that are added up together, and passages to a task of a product where there are more than tasks at a time: its blobs are of fixed size.
FAN, PASSAGES = 64, 1 << 19


def bare_words(texts: pa.Array) -> Words:
    """Words in lower case without the marks around them."""
    return Words(texts, lower=False).bare()


def buckets(w: Words) -> np.ndarray:
    """The hashed term of each unique word."""
    shift = np.uint64(64 - BITS)
    return (w.hashes() >> shift).astype(np.int64)


def block_starts(counts: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """First words of blocks of stride words, none across texts, and the text of each block."""
    per = -(-counts // stride)
    doc = np.repeat(np.arange(len(counts)), per)
    first = np.cumsum(per) - per
    return (np.cumsum(counts) - counts)[doc] + (np.arange(len(doc)) - first[doc]) * stride, doc


def _gather_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed terms of each document's words, in order, and how many passages they make; numbers of documents by hashed term as blobs."""
    df = np.zeros(1 << BITS, np.int64)
    for b in chunks(batches):
        w = bare_words(b.column("text"))
        terms = buckets(w)[w.codes]
        df += np.bincount(np.unique(w.doc << BITS | terms) & (1 << BITS) - 1, minlength=1 << BITS)
        n = len(w.counts)
        offsets = np.r_[0, w.ends].astype(np.int32) * 4
        blobs = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(terms.astype("<i4").tobytes())])
        yield _row([None] * n, [None] * n, [None] * n, blobs, -(-w.counts // (FIT_WORDS // 2)))
    parts = [df[i : i + BLOCK].astype("<i8").tobytes() for i in range(0, 1 << BITS, BLOCK)]
    n = len(parts)
    yield _row([TaskContext.get().partitionId()] * n, list(range(n)), parts, [None] * n, [None] * n)


def _row(slot: list, block: list, blob: list, terms: pa.Array | list, passages: np.ndarray | list) -> pa.RecordBatch:
    terms = terms if isinstance(terms, pa.Array) else pa.array(terms, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(slot, pa.int64()), pa.array(block, pa.int32()), pa.array(blob, pa.binary()), terms, pa.array(passages, pa.int64())], ["slot", "block", "blob", "terms", "passages"])


def _total(t: pa.Table, kind: str) -> pa.Array:
    return pa.array([np.sum([np.frombuffer(x.as_py(), kind) for x in t.column("blob")], axis=0).astype(kind).tobytes()], pa.binary())


def _sum_blobs(kind: str):  # noqa: ANN202
    return lambda key, t: pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "blob": _total(t, kind)})


def _sum_slots(kind: str, step: int):  # noqa: ANN202
    return lambda key, t: pa.table({"slot": pa.array([key[0].as_py() * step], pa.int64()), "block": pa.array([key[1].as_py()], pa.int32()), "blob": _total(t, kind)})


def summed_blobs(blobs: DataFrame, kind: str, tasks: int = 1) -> np.ndarray:
    """Blobs (slot, block, blob), slot being the number of the task that made them, added up by block and put in a row: a vector or matrix of fixed size.

    They are added up in a tree, so that a group holds FAN blobs of a block at most, however many tasks there are.
    """
    step = FAN
    while step < tasks:
        up = blobs.groupBy(F.floor(F.col("slot") / step).alias("up"), "block").applyInArrow(_sum_slots(kind, step), "slot long, block int, blob binary")
        blobs, step = up, step * FAN
    rows = blobs.groupBy("block").applyInArrow(_sum_blobs(kind), "block int, blob binary").collect()
    return np.concatenate([np.frombuffer(r.blob, kind) for r in sorted(rows, key=lambda r: r.block)]) if rows else np.empty(0, kind)


@dataclass
class Space:
    """place: of each hashed term among the terms of the space (-1: none); v: its right singular vectors, times the term's IDF, and a row of zeros."""

    place: np.ndarray
    v: np.ndarray
    singular: np.ndarray

    def __post_init__(self) -> None:
        self.v = np.concatenate([self.v, np.zeros((1, self.v.shape[1]))]).astype(np.float32)  # the last row: of no term

    def rows(self, of: np.ndarray) -> np.ndarray:
        """The row of v of each hashed term."""
        return self.place[of] % len(self.v)


def flat(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the terms of all rows, how many each row has)."""
    rows = blobs.to_pylist()
    return np.frombuffer(b"".join(rows), "<i4"), np.fromiter(map(len, rows), np.int64, len(rows)) // 4


def weighted(at: np.ndarray, counts: np.ndarray, weights: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, value) of TF-IDF rows of length 1 times their weight; at: places of the rows' terms, the last one of none."""
    row = np.repeat(np.arange(len(counts)), counts)
    row, at = row[at < len(idf)], at[at < len(idf)].astype(np.int64)
    both, tf = np.unique(row * (len(idf) + 1) + at, return_counts=True)
    row, at = both // (len(idf) + 1), both % (len(idf) + 1)
    x = tf * idf[at]
    norm = np.sqrt(np.bincount(row, x**2, len(counts)))
    return row, at, (x * weights[row] / np.maximum(norm[row], 1e-12)).astype(np.float32)


def halves(at: np.ndarray, counts: np.ndarray, none: int, most: int = 8192) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places of the terms of half passages, filled up with none, and of one half more; whether the next half is the same text's), most passages at a time. A passage is a half and the next one of its text, if there is one."""
    starts, doc = block_starts(counts, FIT_WORDS // 2)
    ends = np.cumsum(counts)[doc]
    for lo in range(0, len(starts), most):
        words = starts[lo : lo + most + 1, None] + np.arange(FIT_WORDS // 2)
        h = np.where(words < ends[lo : lo + most + 1, None], at[np.minimum(words, len(at) - 1)], at.dtype.type(none))
        d = doc[lo : lo + most + 1]
        if lo + most >= len(starts):
            h, d = np.concatenate([h, np.full_like(h[:1], none)]), np.r_[d, -1]
        yield h, d[1:] == d[:-1]


def lengths_of(h: np.ndarray, goes_on: np.ndarray, squares: np.ndarray) -> np.ndarray:
    """The length of each passage's TF-IDF row; squares: of each term's IDF, and 0 for none."""
    both = np.concatenate([h[:-1], np.where(goes_on[:, None], h[1:], h.dtype.type(len(squares) - 1))], axis=1)
    both.sort(axis=1)
    nth = np.arange(both.shape[1], dtype=np.int16)
    first = np.zeros(both.shape, np.int16)
    first[:, 1:] = np.where(both[:, 1:] != both[:, :-1], nth[1:], 0)
    times = nth - np.maximum.accumulate(first, axis=1)  # a term's n places give 1 + 3 + ... = n * n
    return np.maximum(np.sqrt(np.einsum("ij,ij->i", np.take(squares, both, mode="clip"), 2 * times + 1)), 1e-12)


def summed(rows: np.ndarray, at: np.ndarray, step: int = 512) -> np.ndarray:
    """The sum of rows[at[i]] for each i, at having two axes; in steps that stay in a processor's cache."""
    out, more = np.empty((len(at), rows.shape[1]), rows.dtype), np.empty((min(step, len(at)), rows.shape[1]), rows.dtype)
    for lo in range(0, len(at), step):
        columns = np.ascontiguousarray(at[lo : lo + step].T, np.intp)
        total, one = out[lo : lo + step], more[: columns.shape[1]]
        np.take(rows, columns[0], axis=0, out=total, mode="clip")
        for c in columns[1:]:
            total += np.take(rows, c, axis=0, out=one, mode="clip")
    return out


def add_rows(z: np.ndarray, to: np.ndarray, rows: np.ndarray, at: np.ndarray, step: int = 8) -> None:
    """z[to[i]] += rows[at[i]] for every i: those of one place are added some at a time until one is left."""
    order = np.argsort(to, kind="stable")
    to, at = to[order], at[order]
    while len(to):
        first = np.flatnonzero(np.r_[True, to[1:] != to[:-1]])
        n = np.diff(np.r_[first, len(to)])
        one = first[n == 1]
        z[to[one]] += rows[at[one]]
        first, n = first[n > 1], n[n > 1]
        per = -(-n // step)
        begin = np.repeat(first - step * (np.cumsum(per) - per), per) + step * np.arange(per.sum())
        i = begin[:, None] + np.arange(step)
        i = np.where(i < np.repeat(first + n, per)[:, None], at[np.minimum(i, len(at) - 1)], len(rows))
        rows = summed(np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)]), i)
        to, at = np.repeat(to[first], per), np.arange(len(rows))


def _products(sent, what: str):  # noqa: ANN001, ANN202
    """For rows A of the task, all passages of texts and the items, which have weights: A'(A Q) in blobs by rows of terms, or (A Q)'(A Q) as one blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, idf, q = sent.value
        k, none = q.shape[1], len(idf)
        places = np.where(place < 0, none, place).astype(np.uint16 if none < 1 << 16 else np.uint32)
        own = np.concatenate([idf[:, None] * q, np.zeros((1, k))]).astype(np.float32)
        squares = np.r_[idf**2, 0].astype(np.float32)
        z, of_items, gram = np.zeros((none + 1, k), np.float32), np.zeros((none, k), np.float32), np.zeros((k, k))
        for b in chunks(batches, "terms", FIT_BYTES):
            item = pc.is_valid(b.column("weight"))
            c = b.filter(item)
            if c.num_rows:
                terms, counts = flat(c.column("terms"))
                row, at, x = weighted(places[terms], counts, c.column("weight").to_numpy(), idf)
                y = np.zeros((len(counts), k), np.float32)
                np.add.at(y, row, x[:, None] * q[at])
                if what == "gram":
                    gram += y.T.astype(float) @ y
                else:
                    np.add.at(of_items, at, x[:, None] * y[row])
            terms, counts = flat(b.filter(pc.invert(item)).column("terms"))
            for h, goes_on in halves(places[terms], counts, none):
                by = (1 / lengths_of(h, goes_on, squares))[:, None].astype(np.float32)
                y = summed(own, h)
                y = (y[:-1] + y[1:] * goes_on[:, None]) * by
                if what == "gram":
                    gram += y.T.astype(float) @ y
                    continue
                share = np.concatenate([y * by, np.zeros((1, k), np.float32)])
                share[1:] += share[:-1] * goes_on[:, None]
                there = np.flatnonzero(h.ravel() < none)
                add_rows(z, h.ravel()[there], share, there // h.shape[1])
        z = z[:-1] * idf[:, None].astype(np.float32) + of_items
        blobs = [gram.tobytes()] if what == "gram" else [z[i : i + 4096].tobytes() for i in range(0, len(z), 4096)]
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()] * len(blobs), pa.int64()), pa.array(range(len(blobs)), pa.int32()), pa.array(blobs, pa.binary())], ["slot", "block", "blob"])

    return run


@dataclass
class Corpus:
    """rows and document frequencies of all documents, their words' hashed terms (terms, a row for each) and how many passages they make."""

    rows: int
    df: np.ndarray
    texts: DataFrame
    passages: int


def gather(docs: DataFrame) -> Corpus:
    got = settle(docs.select("text").mapInArrow(_gather_task, "slot long, block int, blob binary, terms binary, passages long"), "passages")
    rows, passages, last = got.agg(F.count("passages"), F.sum("passages"), F.max("slot")).first()
    df = summed_blobs(got.where("blob is not null").select("slot", "block", "blob"), "<i8", (last or 0) + 1)
    return Corpus(rows, df if len(df) else np.zeros(1 << BITS, np.int64), got.where("terms is not null").select("terms"), passages or 0)


def fit(corpus: Corpus, items: list[np.ndarray]) -> Space:
    """The latent space of the items (the hashed terms of each) and all passages of all documents; IDF over all documents."""
    spark = corpus.texts.sparkSession
    own = np.unique(np.concatenate([np.zeros(0, np.int64), *items]))
    df, rows = corpus.df, corpus.rows
    rank = df.copy()
    rank[own] += rows + 1
    chosen = np.sort(np.argsort(-rank, kind="stable")[: min(max(TERMS, len(own)), int((rank > 0).sum()))])
    place = np.full(1 << BITS, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    idf = np.log((1 + rows) / (1 + df[chosen])) + 0.05
    k = min(RANK + EXTRA, max(1, len(chosen)))
    if not len(chosen):
        return Space(place, np.zeros((0, k)), np.zeros(k))
    weight = float(np.sqrt(max(1.0, corpus.passages / max(1, len(items)))))  # half of all weight is the items'
    given = spark.createDataFrame([(t.astype("<i4").tobytes(), weight) for t in items], "terms binary, weight double").coalesce(1)
    tasks = max(spark.sparkContext.defaultParallelism, -(-corpus.passages // PASSAGES))
    a = corpus.texts.withColumn("weight", F.lit(None).cast("double")).coalesce(tasks).unionByName(given)

    def product(q: np.ndarray, what: str, kind: str) -> np.ndarray:
        sent = spark.sparkContext.broadcast((place, idf, q))  # bounded by 2 ** BITS x RANK
        out = summed_blobs(a.mapInArrow(_products(sent, what), "slot long, block int, blob binary"), kind, tasks + 1)
        sent.unpersist()
        return out.reshape(-1, k)

    q = np.linalg.qr(np.random.default_rng(11).normal(size=(len(chosen), k)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        q = np.linalg.qr(product(q, "z", "<f4"))[0].astype(np.float32)
    values, turn = np.linalg.eigh(product(q, "gram", "<f8"))
    order = np.argsort(-values)[:RANK]
    q, values = q @ turn[:, order], values[order]
    return Space(place, q * idf[:, None], np.sqrt(np.maximum(values, 0)))


SENTENCE = re.compile(r"[.!?]\s+")


def answer_of(text: str, answer: str | None) -> str:
    """The given answer, else the last sentence, or the last third of a single one."""
    if answer:
        return answer
    parts = [p for p in SENTENCE.split(text.strip()) if p.split()]
    if len(parts) > 1:
        return parts[-1]
    w = text.split()
    return " ".join(w[-max(1, len(w) // 3) :])


@dataclass
class Items:
    """A block of benchmark items: ids, words as hashes, answers' words, latent directions; by size of window those it serves; by number of first words their hashes and items; all words in order, and how often (up to 255) each item has each of them, a last one being none."""

    ids: list
    words: list[list[int]]
    answers: list[set[int]]
    directions: np.ndarray
    by_window: dict[int, np.ndarray]
    anchors: dict[int, tuple[np.ndarray, np.ndarray]]
    vocabulary: np.ndarray
    uses: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return np.fromiter(map(len, self.words), np.int64, len(self.words))

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """The place in the vocabulary of each word, its end for others."""
        n = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, words), max(n - 1, 0))
        return np.where(self.vocabulary[at] == words, at, n).astype(np.int32) if n else np.full(len(words), n, np.int32)


def joined(h: np.ndarray, upto: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of n words from each on), for n from 1 to upto."""
    g = h
    for n in range(1, upto + 1):
        if n > len(h):
            return
        if n > 1:
            g = g[: len(h) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + h[n - 1 :]
        yield n, g


def prepare(rows: list, space: Space) -> Items:
    """Items without a word match nothing and fall out."""
    w = bare_words(pa.array([r["text"] for r in rows], pa.large_string()))
    rows, keep = [r for r, n in zip(rows, w.counts.tolist(), strict=True) if n], w.counts > 0
    a = bare_words(pa.array([answer_of(r["text"], r["answer"]) for r in rows], pa.large_string()))
    h, g = w.hashes()[w.codes], a.hashes()[a.codes]
    v = np.zeros((len(w.counts), space.v.shape[1]))
    np.add.at(v, w.doc, space.v[space.rows(buckets(w))[w.codes]])
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    starts, n = w.starts[keep], w.counts[keep]
    serves, least = {}, 0
    for blocks, most in WINDOWS:
        serves[blocks] = np.flatnonzero((n > least) & (n <= most))
        least = most
    anchors = {}
    for k, first in joined(h, LEAST_WORDS):
        own = np.flatnonzero(n == k if k < LEAST_WORDS else n >= k)
        if own.size:
            key = first[starts[own]]
            order = np.argsort(key, kind="stable")
            anchors[k] = (key[order], own[order])
    vocabulary, code = np.unique(h, return_inverse=True)
    uses = np.zeros((len(rows), len(vocabulary) + 1), np.int64)
    np.add.at(uses, (np.repeat(np.arange(len(rows)), n), code), 1)
    return Items([r["item_id"] for r in rows], [h[s : s + k].tolist() for s, k in zip(starts, n, strict=True)], [set(g[s:e].tolist()) for s, e in zip(a.starts, a.ends, strict=True)], v[keep].astype(np.float32), serves, anchors, vocabulary, np.minimum(uses, 255).astype(np.uint8))


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a column of the table in the bits of one integer."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := at.get(y):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def judge(item: list[int], answer: set[int], words: list[int]) -> tuple[float, float, bool]:
    """(share of the item's words in order, share of the answer's words, leak)."""
    share = lcs(item, words) / len(item)
    found = len(answer & set(words)) / max(1, len(answer))
    if len(item) < LEAST_WORDS:
        n = len(item)
        whole = any(words[i : i + n] == item for i in range(len(words) - n + 1))
        return share, found, whole
    return share, found, share >= VERBATIM or (share >= PARAPHRASE and found >= ANSWER)


def verbatim(h: np.ndarray, items: Items) -> Iterator[tuple[int, int]]:
    """(word, item) wherever an item's first words stand."""
    for k, g in joined(h, max(items.anchors, default=0)):
        if k in items.anchors:
            keys, own = items.anchors[k]
            mark = np.zeros(1 << 16, bool)
            mark[keys >> np.uint64(48)] = True
            at = np.flatnonzero(mark[g >> np.uint64(48)])
            lo, hi = np.searchsorted(keys, g[at], "left"), np.searchsorted(keys, g[at], "right")
            for p, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                for i in own[a:b].tolist():
                    yield p, i


def similar(rows: np.ndarray, numbers: np.ndarray, counts: np.ndarray, space: Space, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """(first words, items, cosines, words of the window) of windows near items in which enough of the item's words stand, in any order.

    rows: of space.v, and numbers: in the items' vocabulary, for each word of the texts.
    """
    starts, doc = block_starts(counts)
    ends, ahead, none = np.cumsum(counts), WINDOWS[-1][0], len(items.vocabulary)
    nth, lengths = np.arange(len(starts)) - np.searchsorted(doc, doc), items.lengths
    for lo in range(0, len(starts), 4096):
        hi = min(lo + 4096, len(starts))
        s = starts[lo : hi + ahead]
        d = doc[lo : hi + ahead]
        at = s[:, None] + np.arange(STRIDE)
        at = np.where(at < ends[d][:, None], rows[np.minimum(at, len(rows) - 1)], len(space.v) - 1)
        sums = summed(space.v, at)
        size = 1
        for blocks, _ in WINDOWS:
            while size < blocks:  # the window and the next one after it
                more = np.zeros_like(sums)
                more[:-size] = sums[size:] * (d[size:] == d[:-size])[:, None]
                sums = sums + more
                size *= 2
            own = items.by_window[blocks]
            if not own.size:
                continue
            first = np.flatnonzero(nth[lo:hi] % max(1, blocks // 4) == 0)
            x = sums[first]
            cosine = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)) @ items.directions[own].T
            longest = int(lengths[own].max())
            for a in range(0, len(first), 512):
                p, i = np.nonzero(cosine[a : a + 512] >= COSINE)
                if not len(p):
                    continue
                windows, p = np.unique(p, return_inverse=True)
                w = first[a + windows]
                at = s[w][:, None] + np.arange(-longest, blocks * STRIDE + longest)
                inside = (at >= (ends - counts)[d[w]][:, None]) & (at < ends[d[w]][:, None])
                there = np.sort(np.where(inside, numbers[np.clip(at, 0, len(numbers) - 1)], none), axis=1)
                there[:, 1:][there[:, 1:] == there[:, :-1]] = none
                width = max(1, int((there < none).sum(axis=1).max()))
                there = np.sort(there, axis=1)[:, :width]
                i, c = own[i], cosine[a + windows[p], i]
                enough = np.concatenate([items.uses[i[k : k + 8192, None], there[p[k : k + 8192]]].sum(axis=1, dtype=np.int64) for k in range(0, len(p), 8192)]) >= PARAPHRASE * lengths[i]
                if enough.any():
                    yield s[w[p[enough]]], i[enough], c[enough], blocks * STRIDE


def leaks(texts: pa.Array, searched: list[tuple[Space, Items]]) -> list[tuple[int, int, int, float, float, float, int]]:
    """(text, block, item, cosine, share, answer, first word), the best passage of each text and item; the cosine is 0 where the first words led to it."""
    w = bare_words(texts)
    if not len(w.codes):
        return []
    words, of = w.hashes(), buckets(w)
    h, out = words[w.codes], []
    for block, (space, items) in enumerate(searched):
        if not items.ids:
            continue
        best: dict[tuple[int, int], tuple] = {}
        pairs = [(np.array(x, np.int64).reshape(-1, 2), None, None) for x in [list(verbatim(h, items))]]
        pairs += [(np.stack([f, i], axis=1), c, n) for f, i, c, n in similar(space.rows(of)[w.codes], items.numbers(words)[w.codes], w.counts, space, items)]
        begins = w.starts
        for pair, cosine, window in pairs:
            last = (-1, -1)
            docs = np.searchsorted(w.ends, pair[:, 0], "right").tolist()
            for k, ((first, i), d) in enumerate(zip(pair.tolist(), docs, strict=True)):
                item = items.words[i]
                if best.get((d, i), (0, 0, 0, 0))[3] == 1:
                    continue
                reach = 2 * len(item) if window is None else window + len(item)
                a, b = max(int(begins[d]), first - (0 if window is None else len(item))), min(int(w.ends[d]), first + reach)
                if (a, b) != last:
                    last, near = (a, b), h[a:b].tolist()
                share, found, leak = judge(item, items.answers[i], near)
                if leak and share > best.get((d, i), (0, 0, 0, -1.0))[3]:
                    best[d, i] = (d, block, i, share, float(cosine[k]) if cosine is not None else 0.0, found, first - int(begins[d]))
        out += [(d, block, i, c, share, found, at) for d, block, i, share, c, found, at in best.values()]
    return out


def _searched(docs: DataFrame, benchmark: DataFrame) -> list[list[tuple[Space, Items]]]:
    """The spaces and items, SPACES blocks of ITEMS at a time. Items come to the driver by blocks; the corpus is gathered once for all."""
    answer = F.col("answer").cast("string") if "answer" in benchmark.columns else F.lit(None).cast("string")
    b = benchmark.select("item_id", F.coalesce("text", F.lit("")).alias("text"), answer.alias("answer"))
    corpus, rows, out = gather(docs), [], []

    def block() -> None:
        w = bare_words(pa.array([r["text"] for r in rows], pa.large_string()))
        of = buckets(w)[w.codes]
        space = fit(corpus, [of[s:e] for s, e in zip(w.starts, w.ends, strict=True)])
        out.append((space, prepare(rows, space)))

    for r in b.toLocalIterator():
        rows.append(r)
        if len(rows) == ITEMS:
            block()
            rows = []
    if rows:
        block()
    return [out[i : i + SPACES] for i in range(0, len(out), SPACES)]


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_share, first_word) for each document and benchmark item leaked into it.

    Null and empty texts and items match nothing. A benchmark with a column answer is checked against it. Repeated rows are judged
    each. An empty table gives an empty result.
    """
    kind = benchmark.schema["item_id"].dataType.simpleString()
    fields = f"doc_id long, item_id {kind}, cosine double, lcs_share double, answer_share double, first_word int"
    out = docs.sparkSession.createDataFrame([], fields)
    for blocks in _searched(docs, benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(blocks)  # bounded by SPACES x (2 ** BITS x RANK + ITEMS)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in chunks(batches):
                found, ids = leaks(b.column("text"), sent.value), b.column("doc_id")
                if found:
                    d, block, i, c, s, a, at = zip(*found, strict=True)
                    yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(d)), "item_id": [sent.value[x][1].ids[k] for x, k in zip(block, i, strict=True)], "cosine": c, "lcs_share": s, "answer_share": a, "first_word": pa.array(at, pa.int32())})

        out = out.unionByName(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, fields))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the documents that hold a benchmark item; all columns as they were."""
    for blocks in _searched(docs, benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for b in chunks(batches):
                keep = np.ones(b.num_rows, bool)
                keep[[x[0] for x in leaks(b.column("text"), sent.value)]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
