"""Interpolated modified Kneser-Ney n-gram model, counted in Spark, kept as sorted hash arrays that workers map into memory.

Words are counted by ranges of their 64-bit hashes; a word's number is its range and its place there. The longest n-grams are counted, as
numbers; how many left neighbours they have gives the counts of all shorter ones. N-grams are dealt to the part of the last word but one, so
that one part holds all that its shorter n-grams and their contexts need; words with more n-grams than an average part holds (or over 1 / HOT of all)
spread theirs by the last two words' hash, and their contexts are added up in a second step. Each part is a few sorted arrays in the shared folder: of an
n-gram's 64-bit hash they keep some first bits as a table of places and the next 32, so an unseen one is taken for another once in 10^8
times. A scoring task maps the parts that its texts touch and looks up distinct n-grams in order.
"""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Any
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import scratch, settle
from loomgraph.llm.tokens import CHUNK, Words, chunks, runs_sum

#: Words in the longest n-grams.
ORDER = 3
#: The end's hash (it is a token). Numbers of what stands before the start, of the start (a context only), and of unknown words.
END, NONE, START, UNKNOWN = np.uint64(0xE2D0F7A95C1B4483), np.uint64(0), np.uint64(1), np.uint64(1 << 63)
#: Bytes of text to a part; with few parts, the share of tokens above which a word is hot. With more than HOT parts it is that of a part, so
#: no part holds more than twice its share, and hot words are no more than parts.
PART_BYTES, HOT = 8_000_000, 64
#: Entries that a task gathers before it adds them up, and hands them on if over half are distinct.
PENDING = 2_000_000
#: Bytes of text that a task scores at a time: more of them spread the visit to each part over more n-grams.
SCORED = 2 * CHUNK
#: Files that a worker keeps mapped.
MAPS = 16_384
PSEUDO = 0.5
STATS = ("n1", "n2", "n3", "t")
HANDED = "part int, kind int, a binary"


def pair(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Hash of a context (or word) and one more word."""
    x = (v ^ (v >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + w
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def context(v: list[np.ndarray]) -> np.ndarray:
    """Hash of the words before a token, the nearest first."""
    out = v[0]
    for x in v[1:]:
        out = pair(out, x)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash, in order."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def home(v: np.ndarray, key: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    """The part of the word numbered v or, if that is hot (as the start is), of the key."""
    return np.where(np.isin(v, hot), part_of(key, parts), ((v - np.uint64(2)) % np.uint64(parts)).astype(np.int64))


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their sums, and where each first stands."""
    order = np.argsort(keys)
    k = keys[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    return k[first], np.add.reduceat(n[order], first) if len(k) else n[:0], order[first]


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    """Arrays of whole numbers from 0 on, each in the narrowest type that holds it, behind a line that names them."""
    narrow = {f: a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0)) for f, a in arrays.items()}
    head = json.dumps([(f, a.dtype.str, len(a)) for f, a in narrow.items()]).encode()
    return b"".join([head, b" " * (-(len(head) + 1) % 8), b"\n", *[x for a in narrow.values() for x in (a.tobytes(), bytes(-a.nbytes % 8))]])


def unpacked(data: np.ndarray) -> dict[str, np.ndarray]:
    """Views into packed bytes."""
    at = bytes(data[:1024]).index(b"\n") + 1
    out = {}
    for f, kind, n in json.loads(bytes(data[:at])):
        size = n * np.dtype(kind).itemsize
        out[f] = data[at : at + size].view(kind)
        at += size + -size % 8
    return out


def planes(a: np.ndarray) -> np.ndarray:
    """The numbers' first bytes, then their second ones and so on: high ones shrink to nothing in the shuffle."""
    a = a.astype(np.min_scalar_type(int(a.max()) if len(a) else 0))
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).ravel()


def numbers(flat: np.ndarray, n: int) -> np.ndarray:
    """The n numbers again."""
    return np.ascontiguousarray(flat.reshape(-1, n).T).view(f"<u{len(flat) // n}").ravel().astype(np.uint64) if n else np.empty(0, np.uint64)


def compact(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Ordered keys as places by their first bits (some 16 to 32 keys to a place) and their next 32 bits."""
    bits = max((len(keys) // 16).bit_length() - 1, 0)
    first = keys >> np.uint64(64 - bits) if bits else np.zeros(len(keys), np.uint64)
    at = np.searchsorted(first, np.arange(2**bits + 1, dtype=np.uint64))
    return {f"{name}.at": at, name: (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)}


def find_compact(x: dict[str, np.ndarray], name: str, keys: np.ndarray) -> np.ndarray:
    """Positions of keys, -1 where absent: halves all keys' ranges at once."""
    at, rest = x[f"{name}.at"], x[name]
    if not len(rest) or not len(keys):
        return np.full(len(keys), -1)
    bits = len(at).bit_length() - 1 if len(at) > 2 else 0
    first = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    want = (keys >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)
    lo, end = at[first].astype(np.int64), at[first + 1].astype(np.int64)
    hi = end.copy()
    for _ in range(int((hi - lo).max()).bit_length()):
        mid = (lo + hi) >> 1
        less = (lo < hi) & (rest[np.minimum(mid, len(rest) - 1)] < want)
        lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
    return np.where((lo < end) & (rest[np.minimum(lo, len(rest) - 1)] == want), lo, -1)


class Sequence:
    """The tokens of some texts (words, then the end) as codes into their distinct hashes."""

    def __init__(self, texts: pa.Array) -> None:
        w = Words(texts)
        self.counts = w.counts + 1
        self.h = np.r_[w.hashes() if len(w.unique) else np.empty(0, np.uint64), END]
        self.code = np.insert(w.codes, w.ends, len(self.h) - 1)

    def history(self, n: int) -> list[np.ndarray]:
        """Codes of the n words before each token, the nearest first; len(h) is the start, len(h) + 1 what stands before it."""
        size = len(self.code)
        at = np.arange(size) - np.repeat(np.cumsum(self.counts) - self.counts, self.counts)
        out = []
        for j in range(n):
            v = np.full(size, len(self.h) + 1)
            v[j + 1 :] = self.code[: max(size - j - 1, 0)]
            v[at == j], v[at < j] = len(self.h), len(self.h) + 1
            out.append(v)
        return out


class Store:
    """Packed arrays under the shared folder: direct where it is mounted, else by way of its file system and an unlinked local copy."""

    def __init__(self, root: str) -> None:
        self.root = root

    def _fs(self) -> tuple[Any, str]:
        from pyarrow import fs

        u = urlparse(self.root)
        return (None, u.path) if u.scheme in ("", "file") else fs.FileSystem.from_uri(self.root)

    def write(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        fs, path = self._fs()
        end, draft = f"{path}/{name}", f"{path}/{name}.{os.getpid()}-{os.urandom(4).hex()}"
        if fs is None:
            os.makedirs(path, exist_ok=True)
            with open(draft, "wb") as f:
                f.write(packed(arrays))
            os.replace(draft, end)
        else:
            with fs.open_output_stream(draft) as f:
                f.write(packed(arrays))
            fs.move(draft, end)

    def open(self, name: str) -> dict[str, np.ndarray]:
        """The mapped arrays; none where nothing was written."""
        fs, path = self._fs()
        at = f"{path}/{name}"
        if fs is None:
            return unpacked(np.asarray(np.memmap(at, np.uint8, "r"))) if os.path.exists(at) else {}
        if not fs.get_file_info(at).is_file:
            return {}
        with tempfile.NamedTemporaryFile() as t, fs.open_input_stream(at) as f:
            while block := f.read(1 << 22):
                t.write(block)
            t.flush()
            return unpacked(np.asarray(np.memmap(t.name, np.uint8, "r")))


def runs(part: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Each value of an ordered array, and where it begins and ends."""
    values, lo = np.unique(part, return_index=True)
    yield from zip(values.tolist(), lo.tolist(), np.r_[lo[1:], len(part)][: len(lo)].tolist(), strict=True)


def by_part(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs, and where."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")
    for p, a, b in runs(part[order]):
        yield p, order[a:b]


def dealt(part: np.ndarray, arrays: dict[str, np.ndarray]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """Each part that occurs, with its rows of the arrays."""
    for p, own in by_part(part):
        yield p, {f: a[own] for f, a in arrays.items()}


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.Table:
    p, k, a = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.table({"part": pa.array(p, pa.int32()), "kind": pa.array(k, pa.int32()), "a": pa.array(a, pa.binary())})


def _blobs(t: pa.Table) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for kind, a in zip(t.column("kind").to_pylist(), t.column("a"), strict=True):
        yield kind, unpacked(np.frombuffer(a.as_buffer(), np.uint8))


class Vocabulary:
    """Numbers of words by the mapped hashes."""

    def __init__(self, root: str, parts: int) -> None:
        self.parts, self.open = parts, lru_cache(MAPS)(Store(root).open)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Of hashes, then of the start and of what stands before it."""
        out = np.r_[np.full(len(h), UNKNOWN), START, NONE]
        for p, own in by_part(part_of(h, self.parts)):
            if x := self.open(f"words-{p}"):
                at = np.minimum(np.searchsorted(x["h"], h[own]), len(x["h"]) - 1)
                ok = x["h"][at] == h[own]
                out[own[ok]] = number(at[ok], p, self.parts)
        return out


def number(at: np.ndarray, part: int, parts: int) -> np.ndarray:
    return (at * parts + part + 2).astype(np.uint64)


def _word_task(parts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = np.empty(0, np.uint64), np.empty(0, np.int64)

        def handed_on() -> Iterator[pa.RecordBatch]:
            for p, x in dealt(part_of(keys, parts), {"h": keys, "c": n}):
                yield from _rows([(p, 0, packed(x))]).to_batches()

        for b in chunks(batches):
            s = Sequence(b.column("text"))
            keys, n, _ = summed(np.r_[keys, s.h], np.r_[n, np.bincount(s.code, minlength=len(s.h))])
            if len(keys) > PENDING:
                yield from handed_on()
                keys, n = keys[:0], n[:0]
        yield from handed_on()

    return run


def _word_part(root: str, parts: int):  # noqa: ANN202
    def run(key: tuple, t: pa.Table) -> pa.Table:
        blobs = [x for _, x in _blobs(t)]
        p = key[0].as_py()
        h, c, _ = summed(np.concatenate([x["h"].astype(np.uint64) for x in blobs]), np.concatenate([x["c"].astype(np.int64) for x in blobs]))
        Store(root).write(f"words-{p}", {"h": h, "c": c})
        big = np.argsort(-c, kind="stable")[: 2 * max(HOT, parts)]
        return pa.table({"tokens": [int(c.sum())], "words": [len(h)], "top": pa.array([number(big, p, parts).astype(np.int64).tolist()], pa.list_(pa.int64())), "top_n": pa.array([c[big].tolist()], pa.list_(pa.int64()))})

    return run


def _gram_task(root: str, order: int, parts: int, hot: np.ndarray):  # noqa: ANN202
    """Hands on distinct n-grams by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(root, parts)
        held: list[list[np.ndarray]] = []  # columns w, v1, v2 ..., n

        def add_up() -> None:
            *words, n = [np.concatenate(c) for c in zip(*held, strict=True)]
            _, n, at = summed(pair(context(words[1:]), words[0]), n)
            held[:] = [[*[x[at] for x in words], n]]

        def handed_on() -> Iterator[pa.RecordBatch]:
            w, *v, n = held.pop()
            for p, x in dealt(home(v[0], pair(v[0], w), hot, parts), {"w": w, **{f"v{j}": a for j, a in enumerate(v)}, "n": n}):
                sort = np.lexsort([x["w"], *[x[f"v{j}"] for j in range(order - 2, -1, -1)]])  # by the nearest word first: runs shrink too
                yield from _rows([(p, len(sort), packed({f: planes(a[sort]) for f, a in x.items()}))]).to_batches()

        for b in chunks(batches):
            s = Sequence(b.column("text"))
            of = vocabulary.numbers(s.h)
            held.append([of[s.code], *[of[v] for v in s.history(order - 1)], np.ones(len(s.code), np.int64)])
            if sum(len(x[0]) for x in held) > PENDING:
                add_up()
                if len(held[0][0]) * 2 > PENDING:
                    yield from handed_on()
        if held:
            add_up()
            yield from handed_on()

    return run


def _stats(ctx: np.ndarray, a: np.ndarray) -> dict[str, np.ndarray]:
    """Of each distinct context in order: how many n-grams follow once, twice and more, and their sum."""
    k, t, _ = summed(ctx, a)
    code = np.searchsorted(k, ctx)
    return {"k": k, **{f: np.bincount(code[m], minlength=len(k)) for f, m in zip(STATS, (a == 1, a == 2, a > 2), strict=False)}, "t": t}


def _split(x: dict[str, np.ndarray], last: str) -> dict[str, np.ndarray]:
    """Those whose sum (and so everything else) is one are kept as keys alone."""
    more = x[last] > 1
    return {**compact("one", x["k"][~more]), **compact("k", x["k"][more]), **{f: a[more] for f, a in x.items() if f != "k"}}


def _gram_part(root: str, order: int, parts: int, hot: np.ndarray):  # noqa: ANN202
    """Writes the part's n-grams of all orders and its contexts of two words or more. Hands on, with their kind: contexts of one word and
    those of hot words (their length), each word's number of contexts (0), how many n-grams have the counts 1 to 4 (the order, negative), and
    the start's numbers (-1)."""

    def by_word(k: np.ndarray, x: dict[str, np.ndarray], kind: int) -> list[tuple[int, int, bytes]]:
        own = k != START
        place = (k[own] - np.uint64(2)).astype(np.int64)
        each = dealt(place % parts, {"at": place // parts, **{f: a[own] for f, a in x.items()}})
        return [(q, kind, packed(y)) for q, y in each]

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p, store = key[0].as_py(), Store(root)
        blobs = list(_blobs(t))
        w, *v, n = [np.concatenate([numbers(b[f], size) for size, b in blobs]) for f in ("w", *[f"v{j}" for j in range(order - 1)], "n")]
        del blobs
        _, n, at = summed(pair(context(v), w), n.astype(np.int64))
        w, v = w[at], [x[at] for x in v]
        rows: list[tuple[int, int, bytes]] = []
        own = np.flatnonzero(v[-1] != NONE)
        a = n[own]
        for k in range(order, 1, -1):
            if k < order:  # left neighbours of the n-grams of order k, then those that begin a text
                _, a, at = summed(pair(context([x[own] for x in v[: k - 1]]), w[own]), np.ones(len(own), np.int64))
                first = np.flatnonzero(v[k - 2] == START)
                g, n_first, at_first = summed(pair(context([x[first] for x in v[: k - 1]]), w[first]), n[first])
                own, a = np.r_[own[at], first[at_first]], np.r_[a, n_first]
            ctx, near = context([x[own] for x in v[: k - 1]]), v[0][own]
            g = pair(ctx, w[own])
            sort = np.argsort(g, kind="stable")
            store.write(f"gram{k}-{p}", _split({"k": g[sort], "n": a[sort]}, "n"))
            rows.append((p, -k, packed({"n": np.bincount(np.minimum(a, 5), minlength=6)[1:5]})))
            far = np.isin(near, hot) if k > 2 else np.ones(len(own), bool)
            if k > 2:
                store.write(f"own{k - 1}-{p}", _split(_stats(ctx[~far], a[~far]), "t"))
            x = _stats(ctx[far], a[far])
            if k > 2:
                rows += [(q, k - 1, packed(y)) for q, y in dealt(part_of(x["k"], parts), x)]
        rows += [(p, -1, packed({"n": np.r_[0, *[x[f][x["k"] == START].sum() for f in STATS]]}))]
        rows += by_word(x.pop("k"), x, 1)
        words, cc = np.unique(w[own], return_counts=True)
        rows += by_word(words, {"n": cc}, 0)
        return _rows(rows)

    return run


def _finish_part(root: str, order: int):  # noqa: ANN202
    """Adds up what was handed on and writes it: the words' numbers, in the order of the part's words, and the contexts of hot words.
    Returns numbers to be summed: (order, i, n) for counts of counts, order 0 for all contexts of words, -1 for the start's numbers."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        p, store = key[0].as_py(), Store(root)
        size = len(store.open(f"words-{p}").get("h", ()))
        word = {f: np.zeros(size, np.int64) for f in ("cc", *STATS)}
        start, counts = np.zeros(5, np.int64), {k: np.zeros(4, np.int64) for k in range(1, order + 1)}
        far: dict[int, list] = {j: [] for j in range(2, order)}
        for kind, x in _blobs(t):
            if kind == -1:
                start += x["n"].astype(np.int64)
            elif kind < 0:
                counts[-kind] += x["n"].astype(np.int64)
            elif kind == 0:
                word["cc"][x["at"]] += x["n"].astype(np.int64)
            elif kind == 1:
                for f in STATS:
                    word[f][x["at"]] += x[f].astype(np.int64)
            else:
                far[kind].append(x)
        for j, found in far.items():
            if found:
                keys = np.concatenate([x["k"].astype(np.uint64) for x in found])
                each = {f: summed(keys, np.concatenate([x[f].astype(np.int64) for x in found])) for f in STATS}
                store.write(f"far{j}-{p}", _split({"k": each["t"][0], **{f: y[1] for f, y in each.items()}}, "t"))
        if size:
            store.write(f"ends-{p}", word)
        counts[1] += np.bincount(np.minimum(word["cc"], 5), minlength=6)[1:5]
        rows = [(0, 0, int(word["cc"].sum())), *[(-1, i, int(x)) for i, x in enumerate(start[1:])], *[(k, i, int(x)) for k, c in counts.items() for i, x in enumerate(c)]]
        o, i, n = zip(*rows, strict=True)
        return pa.table({"order": pa.array(o, pa.int32()), "i": pa.array(i, pa.int32()), "n": pa.array(n, pa.int64())})

    return run


def discounts(n: list[int]) -> tuple[float, float, float]:
    """From how many were seen once to four times; the usual halves where a number is missing."""
    if min(n[:3]) <= 0:
        return 0.5, 1.0, 1.5
    y = n[0] / (n[0] + 2 * n[1])
    raw = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return tuple(float(np.clip(d, 0.05, k + 0.95)) for k, d in enumerate(raw))  # type: ignore[return-value]


@dataclass
class Model:
    """Where the arrays are, and the few numbers for the whole model."""

    root: str
    order: int
    parts: int
    hot: np.ndarray
    tokens: int
    words: int
    start: list[int]
    d: dict[int, tuple[float, float, float]]
    cc: int
    spare: float


def fit(docs: DataFrame, order: int = ORDER) -> Model:
    """Counts all texts of docs (null: empty); order is two or more."""
    if order < 2:
        raise ValueError("order must be two or more")
    spark = docs.sparkSession
    d = docs.select("text")
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts, root = max(4, -(-size // PART_BYTES)), scratch(spark, "lm")
    blobs = d.mapInArrow(_word_task(parts), HANDED)
    found = blobs.groupBy("part").applyInArrow(_word_part(root, parts), "tokens long, words long, top array<long>, top_n array<long>")
    found = settle(found, "lm-words")
    tokens, words = (x or 0 for x in found.agg(F.sum("tokens"), F.sum("words")).first())
    hot = found.select(F.explode(F.arrays_zip("top", "top_n")).alias("t")).where(F.col("t.top_n") * max(HOT, parts) > tokens).select("t.top")
    hot = np.array([START, *[r[0] for r in hot.collect()]], np.uint64)  # no more rows than HOT or parts
    blobs = d.mapInArrow(_gram_task(root, order, parts, hot), HANDED)
    grams = blobs.groupBy("part").applyInArrow(_gram_part(root, order, parts, hot), HANDED)
    ends = grams.groupBy("part").applyInArrow(_finish_part(root, order), "order int, i int, n long")
    each = {(r.order, r.i): r.n for r in ends.groupBy("order", "i").agg(F.sum("n").alias("n")).collect()}  # 4 * order + 5 rows
    d_of = {k: discounts([each.get((k, i), 0) for i in range(4)]) for k in range(1, order + 1)}
    kinds, cc = [each.get((1, i), 0) for i in range(2)], each.get((0, 0), 0)
    spare = sum(x * n for x, n in zip(d_of[1], [*kinds, words - sum(kinds)], strict=True)) / cc if cc else 1.0
    return Model(root, order, parts, hot, tokens, words, [each.get((-1, i), 0) for i in range(4)], d_of, cc, spare)


class Reader:
    """A worker's view of the mapped arrays."""

    def __init__(self, model: Model) -> None:
        self.m, self.vocabulary = model, Vocabulary(model.root, model.parts)
        self.open = self.vocabulary.open

    def words(self, of: np.ndarray) -> dict[str, np.ndarray]:
        """Of words' numbers: c, cc and the numbers of n-grams that follow; zero for unknown words."""
        out = {f: np.zeros(len(of), np.int64) for f in ("c", "cc", *STATS)}
        known = np.flatnonzero((of > START) & (of != UNKNOWN))
        place = (of[known] - np.uint64(2)).astype(np.int64)
        for p, own in by_part(place % self.m.parts):
            x = {**self.open(f"words-{p}"), **self.open(f"ends-{p}")}
            for f, a in out.items():
                a[known[own]] = x[f][place[own] // self.m.parts]
        for f, n in zip(STATS, self.m.start, strict=True):
            out[f][of == START] = n
        return out

    def _look(self, name: str, part: np.ndarray, keys: np.ndarray, one: dict[str, int]) -> dict[str, np.ndarray]:
        """What the parts hold of ordered keys: the values of one for those kept as keys alone, zero where absent."""
        out = {f: np.zeros(len(keys), np.int64) for f in one}
        for p, own in by_part(part):
            if x := self.open(f"{name}-{p}"):
                at = find_compact(x, "k", keys[own])
                single = own[at < 0]
                single = single[find_compact(x, "one", keys[single]) >= 0]
                for f, n in one.items():
                    out[f][own[at >= 0]] = x[f][at[at >= 0]]
                    out[f][single] = n
        return out

    def grams(self, k: int, near: np.ndarray, w: np.ndarray, g: np.ndarray) -> np.ndarray:
        return self._look(f"gram{k}", home(near, pair(near, w), self.m.hot, self.m.parts), g, {"n": 1})["n"]

    def contexts(self, j: int, near: np.ndarray, ctx: np.ndarray) -> dict[str, np.ndarray]:
        """The numbers of contexts of two words or more."""
        out = {f: np.zeros(len(ctx), np.int64) for f in STATS}
        hot, part = np.isin(near, self.m.hot), home(near, ctx, self.m.hot, self.m.parts)
        for name, own in (("own", ~hot), ("far", hot)):
            found = self._look(f"{name}{j}", part[own], ctx[own], dict(zip(STATS, (1, 0, 0, 1), strict=True)))
            for f in STATS:
                out[f][own] = found[f]
        return out

    @staticmethod
    def _discount(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return np.array([0.0, *d])[np.minimum(n, 3)]

    def score(self, texts: pa.Array) -> dict[str, np.ndarray]:
        """Of each text: n_tokens, n_known, base_score, score."""
        m, s = self.m, Sequence(texts)
        of = self.vocabulary.numbers(s.h)
        word = self.words(of)
        base = np.log10((word["c"] + PSEUDO) / (m.tokens + PSEUDO * (m.words + 1)))
        p = ((word["cc"] - self._discount(word["cc"], m.d[1])).clip(0) / max(m.cc, 1) + m.spare / (m.words + 1))[s.code]
        codes = s.history(m.order - 1)
        w, v = of[s.code], [of[c] for c in codes]
        for k in range(2, m.order + 1):
            at = np.flatnonzero(v[k - 2] != NONE)
            ctx, near = context([x[at] for x in v[: k - 1]]), v[0][at]
            if k == 2:
                x, c_of = word, codes[0][at]
            else:
                c, c_at, c_of = np.unique(ctx, return_index=True, return_inverse=True)
                x = self.contexts(k - 1, near[c_at], c)
            g, g_at, g_of = np.unique(pair(ctx, w[at]), return_index=True, return_inverse=True)
            n = self.grams(k, near[g_at], w[at][g_at], g)
            seen = np.maximum(x["t"], 1)
            gamma = np.where(x["t"] > 0, sum(d * x[f] for f, d in zip(STATS, m.d[k], strict=False)) / seen, 1.0)
            p[at] = (n - self._discount(n, m.d[k]))[g_of] / seen[c_of] + gamma[c_of] * p[at]
        return {
            "n_tokens": s.counts,
            "n_known": runs_sum((word["c"] > 0)[s.code].astype(float), s.counts).astype(np.int64),
            "base_score": runs_sum(base[s.code], s.counts),
            "score": runs_sum(np.log10(p), s.counts),
        }


_readers: dict[str, Reader] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity) of every row of docs, held_out taken over."""
    fields = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.root not in _readers:
            _readers.clear()
            _readers[model.root] = Reader(model)
        reader = _readers[model.root]
        for b in chunks(batches, chars=SCORED):
            r = reader.score(b.column("text"))
            new = [pa.array(x) for x in (r["n_tokens"], r["n_known"], np.full(b.num_rows, model.tokens), r["base_score"], r["score"], 10 ** (-r["score"] / r["n_tokens"]))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), *new], [f.split()[0] for f in fields.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(run, fields)


def report(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 5 is not 1 (null doc_ids too) and scores all; null texts are empty, repeated rows count each."""
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))
    d = docs.select("doc_id", "text", held_out.alias("held_out"))
    return score(d, fit(d.where(~F.col("held_out")), order))
