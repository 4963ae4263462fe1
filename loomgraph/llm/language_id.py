"""Language ID of mixed texts: scripts narrow the candidates, character grams score each word, Viterbi labels the spans."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.tokens import Memo, Words, chunks, pieces, ragged, runs_sum, strings

#: Hashed grams of 1 to GRAM characters and of the whole word; pseudo-count; weight of a word's log-likelihood.
BUCKETS, GRAM, ALPHA, WEIGHT = 1 << 16, 4, 0.3, 0.5
#: Log-probability that a change of language costs; what a word loses in a language that doesn't use its script.
SWITCH, FOREIGN = 12.0, 40.0
#: Documents that the model is fitted on at most; a language uses a script that holds at least this share of its letters.
FIT_DOCS, SCRIPT_SHARE = 20_000, 0.01
#: Words whose scores a worker remembers; bytes of a long text that are looked at a time.
MEMO, PIECE = 100_000, 500_000
#: In the pipeline a document stays from this score on.
LEAST_SCORE = 0.2
#: Code point ranges by script.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF)],
}
NAMES = list(SCRIPTS)


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: its script (the last one: other letters), whether it is a letter, its lower case."""
    n = 0x110000
    script = np.full(n, len(NAMES), np.int8)
    for k, ranges in enumerate(SCRIPTS.values()):
        for lo, hi in ranges:
            script[lo : hi + 1] = k
    letter, lower = np.zeros(n, bool), np.arange(n, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if unicodedata.category(ch)[0] == "L":
            letter[c] = True
            if len(low := ch.lower()) == 1:
                lower[c] = ord(low)
    letter[0x20000:0x32000] = True
    return script, letter, lower


class Grams:
    """Hashed grams of the letters of unique words, in a row, with the count for each word."""

    def __init__(self, unique: pa.Array) -> None:
        script, letter, lower = _tables()
        words = strings(unique)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        of = np.repeat(np.arange(len(words)), size)
        keep = letter[np.minimum(code, 0x10FFFF)]
        code, of = lower[code[keep]], of[keep]
        self.letters = np.bincount(of, minlength=len(words))
        self.scripts = np.zeros((len(words), len(NAMES) + 1), np.int64)
        np.add.at(self.scripts, (of, script[code]), 1)
        padded = self.letters + 2 * (self.letters > 0)  # a mark before and after
        ends = np.cumsum(padded)
        c = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
        c[ragged((ends - padded + 1)[self.letters > 0], self.letters[self.letters > 0])] = code
        word = np.repeat(np.arange(len(words)), padded)
        hashes, owners = [], []
        h = np.zeros(len(c), np.uint64)
        for k in range(1, GRAM + 1):
            if len(c) < k:
                break
            h = (h[: len(c) - k + 1] * np.uint64(0x100000001B3) + c[k - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
            inside = word[: len(c) - k + 1] == word[k - 1 :]
            if k == 1:
                inside = c > 0
            hashes.append((h + np.uint64(k))[inside] >> np.uint64(48))
            owners.append(word[: len(c) - k + 1][inside])
        if hashes:
            full = np.flatnonzero(self.letters)
            rank = np.arange(len(c), dtype=np.uint64) - np.repeat((ends - padded).astype(np.uint64), padded)
            whole = np.add.reduceat((c + np.uint64(7)) * (rank * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1)) ** np.uint64(3), (ends - padded)[full]) if len(full) else np.empty(0, np.uint64)
            hashes.append((whole * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(48))
            owners.append(full)
        self.bucket = np.concatenate(hashes).astype(np.int64) if hashes else np.empty(0, np.int64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(owner, kind="stable")
        self.bucket, self.counts = self.bucket[order], np.bincount(owner, minlength=len(words))


COUNTS = "lang string, kind int, bucket int, n double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in chunks(batches, chars=PIECE):
        lang = np.array(b.column("lang").to_pylist(), object)
        for texts in pieces(b.column("text"), PIECE, words=False):
            w = Words(texts, lower=False)
            g = Grams(w.unique)
            for name in set(lang):
                use = np.bincount(w.codes[(lang == name)[w.doc]], minlength=len(w.unique))
                grams, scripts = total.setdefault(name, (np.zeros(BUCKETS), np.zeros(len(NAMES) + 1)))
                grams += np.bincount(g.bucket, weights=np.repeat(use, g.counts).astype(float), minlength=BUCKETS)
                scripts += use @ g.scripts
    for name, arrays in total.items():
        for kind, a in enumerate(arrays):
            at = np.flatnonzero(a)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at.astype(np.int32)), pa.array(a[at])], ["lang", "kind", "bucket", "n"])


class Model:
    """langs, log-probabilities by bucket and language, and whether a language uses a script."""

    def __init__(self, counts: pd.DataFrame) -> None:
        self.name = uuid.uuid4().hex
        self.langs = sorted(counts["lang"].unique())
        at = {x: i for i, x in enumerate(self.langs)}
        grams, scripts = np.zeros((BUCKETS, len(at))), np.zeros((len(NAMES) + 1, len(at)))
        for kind, into in ((0, grams), (1, scripts)):
            c = counts[counts["kind"] == kind]
            into[c["bucket"].to_numpy(), c["lang"].map(at).to_numpy(int)] = c["n"]
        self.logp = np.log(grams + ALPHA) - np.log(grams.sum(axis=0) + ALPHA * BUCKETS)
        if at:
            self.logp = (self.logp - self.logp.mean(axis=1, keepdims=True)).astype(np.float32)  # only differences count
        self.uses = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)

    def words(self, g: Grams) -> np.ndarray:
        """Score of each unique word in each language; 0 without letters."""
        s = WEIGHT * runs_sum(self.logp[g.bucket], g.counts)
        foreign = (g.scripts @ ~self.uses) > g.letters[:, None] / 2
        narrow = foreign.any(axis=1) & ~foreign.all(axis=1)
        s[narrow] -= FOREIGN * foreign[narrow]
        return s


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> Model:
    """Counts of labelled texts (text, lang) by language. At most about `limit` documents, taken by the hash of their text."""
    d = docs.where("lang is not null and text is not null").select("text", "lang")
    share = min(1.0, limit / max(1, d.select("lang").count()))
    d = d.where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    counts = d.mapInArrow(_count, COUNTS).groupBy("lang", "kind", "bucket").agg(F.sum("n").alias("n"))
    return Model(counts.toPandas())  # bounded by languages times buckets


class Scorer:
    """A worker's scores and letters of words, kept from task to task."""

    def __init__(self, model: Model) -> None:
        self.model, self.memo = model, Memo(MEMO)
        self.scores, self.letters = np.empty((0, len(model.langs)), np.float32), np.empty(0, np.int32)

    def __call__(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(score by language, letters) of each of the unique words."""
        if (keep := self.memo.shrink()) is not None:
            self.scores, self.letters = self.scores[keep], self.letters[keep]
        rows, new = self.memo.find(strings(w.unique))
        if new:
            g = Grams(pa.array(new, pa.large_string()))
            self.scores = np.concatenate([self.scores, self.model.words(g).astype(np.float32)])
            self.letters = np.r_[self.letters, g.letters.astype(np.int32)]
        return self.scores[rows], self.letters[rows]


def forward(s: np.ndarray, before: list[float] | None, switch: float) -> tuple[list[float], np.ndarray, np.ndarray]:
    """One more stretch of words: (best sums after it, for each word the best language before it, and which languages are entered from that one)."""
    rows = s.tolist()
    best, tops, jumps = before, [], []
    for row in rows:
        if best is None:
            best = row
            tops.append(0)
            jumps.append([False] * len(row))
            continue
        most = max(best)
        least = most - switch
        jump = [x < least for x in best]
        tops.append(best.index(most))
        jumps.append(jump)
        best = [(least if j else x) + y for j, x, y in zip(jump, best, row, strict=True)]
    return best, np.array(tops, np.int16), np.packbits(np.array(jumps, bool).reshape(len(rows), -1), axis=1)


def backward(at: int, tops: np.ndarray, jumps: np.ndarray, langs: int) -> tuple[np.ndarray, int]:
    """(the languages of a stretch that ends in language at, the language before it)."""
    path = []
    jump = np.unpackbits(jumps, axis=1, count=langs).tolist()
    for top, j in zip(reversed(tops.tolist()), reversed(jump), strict=True):
        path.append(at)
        at = top if j[at] else at
    return np.array(path[::-1], np.int16), at


def viterbi(s: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language for each word (rows of s), where each change costs switch."""
    best, tops, jumps = forward(s, None, switch)
    return backward(best.index(max(best)), tops, jumps, s.shape[1])[0]


def steady(s: np.ndarray, doc: np.ndarray, best: np.ndarray, docs: int, switch: float = SWITCH) -> np.ndarray:
    """Whether a text surely keeps its best language: no run of its words gains more than one change costs, whatever language each word took."""
    own, gain = s[np.arange(len(s)), best[doc]], np.full(len(s), -np.inf)
    for k in range(s.shape[1]):
        np.maximum(gain, np.where(best[doc] == k, -np.inf, s[:, k]), out=gain)
    gain = gain - own if s.shape[1] > 1 else np.full(len(s), -1.0)
    total = np.cumsum(gain)
    reach = float(np.abs(total).max(initial=0)) * 2 + 1
    before = (total - gain) - doc * reach
    most = total - doc * reach - np.minimum.accumulate(before)
    out = np.full(docs, -np.inf)
    np.maximum.at(out, doc, most)
    return out < switch


def spans_of(path: np.ndarray, langs: list[str]) -> list[tuple[int, int, str]]:
    turn = np.flatnonzero(np.r_[True, path[1:] != path[:-1]]).tolist() if len(path) else []
    return [(lo, hi, langs[path[lo]]) for lo, hi in zip(turn, [*turn[1:], len(path)], strict=True)]


def label_long(texts: pa.Array, scorer: Scorer) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """As label, for one long text: piece by piece, so that only a few bytes a word are held of the whole."""
    langs, best, kept = scorer.model.langs, None, []
    total = np.zeros(len(langs))
    for x in pieces(texts, PIECE, words=False):
        w = Words(x, lower=False)
        if len(w.codes):
            score, letters = scorer(w)
            total += np.bincount(w.codes, minlength=len(score)) @ score.astype(float)
            best, tops, jumps = forward(score[w.codes], best, SWITCH)
            kept.append((tops, jumps, letters[w.codes]))
    if best is None:
        return ["und"], np.zeros(1), [[]]
    at, paths = best.index(max(best)), []
    for tops, jumps, _ in reversed(kept):
        path, at = backward(at, tops, jumps, len(langs))
        paths.append(path)
    path = np.concatenate(paths[::-1])
    share = np.bincount(path, np.concatenate([x for _, _, x in kept]), len(langs))
    found, score = decided(share[None], total[None], langs)
    return found, score, [spans_of(path, langs)]


def decided(share: np.ndarray, total: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """Languages and scores from each text's letters by language and its words' summed scores."""
    n, every, pred, best = len(share), share.sum(axis=1), share.argmax(axis=1), total.argmax(axis=1)
    p = np.exp(total - total.max(axis=1, keepdims=True))
    p = (p / p.sum(axis=1, keepdims=True))[np.arange(n), pred]
    part = share[np.arange(n), pred] / np.maximum(every, 1)
    score = np.where(every > 0, part * np.where(pred == best, np.maximum(p, 0.5), 0.5), 0.0)
    return [langs[k] if c else "und" for k, c in zip(pred, every, strict=True)], score


def label(texts: pa.Array, scorer: Scorer) -> tuple[list[str], np.ndarray, list[list[tuple[int, int, str]]]]:
    """Language, score and spans (first word, end word, language) of each text."""
    langs, n = scorer.model.langs, len(texts)
    if not langs:
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    if n == 1 and (pc.binary_length(texts)[0].as_py() or 0) > 2 * PIECE:
        return label_long(texts, scorer)
    w = Words(texts, lower=False)
    if not len(w.codes):
        return ["und"] * n, np.zeros(n), [[] for _ in range(n)]
    score, letters = scorer(w)
    s, letters = score[w.codes], letters[w.codes]
    total = runs_sum(s, w.counts)
    best = total.argmax(axis=1)
    path = best[w.doc]
    for d in np.flatnonzero(~steady(s, w.doc, best, n)):
        at = slice(w.starts[d], w.ends[d])
        path[at] = viterbi(s[at])
    share = np.bincount(w.doc * len(langs) + path, letters, n * len(langs)).reshape(n, -1)
    found, score = decided(share, total, langs)
    turn = np.flatnonzero(np.r_[True, (path[1:] != path[:-1]) | (w.doc[1:] != w.doc[:-1])])
    spans: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
    for lo, hi in zip(turn.tolist(), [*turn[1:].tolist(), len(path)], strict=True):
        d = int(w.doc[lo])
        spans[d].append((lo - int(w.starts[d]), hi - int(w.starts[d]), langs[path[lo]]))
    return found, score, spans


_scorers: dict[str, Scorer] = {}


def scorer_of(model: Model) -> Scorer:
    """The worker's scorer of this model; another model's goes."""
    if model.name not in _scorers:
        _scorers.clear()
        _scorers[model.name] = Scorer(model)
    return _scorers[model.name]


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score (0 to 1) and spans; every column stays.

    `und` and score 0 for null texts, for texts without a letter, and for all texts if no language was learned. Ties go to the
    first language by name. A word of over half a million bytes counts as several in a text of over a million.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by languages times buckets
    fields = "lang_pred string, score double, spans array<struct<first:int,until:int,lang:string>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("first", pa.int32()), ("until", pa.int32()), ("lang", pa.string())]))
        scorer = scorer_of(sent.value)
        for b in chunks(batches):
            langs, score, spans = label(b.column("text"), scorer)
            new = [pa.array(langs, pa.string()), pa.array(score), pa.array([[{"first": f, "until": u, "lang": x} for f, u, x in y] for y in spans], span)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], [*b.schema.names, "lang_pred", "score", "spans"])

    kept = docs.drop("lang_pred", "score", "spans")
    return kept.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields) + ", " + fields)


def report(docs: DataFrame) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2 and predicts all."""
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    model = fit(docs.where(F.coalesce(~held_out, F.lit(True))))
    d = docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    return identify(d, model).select("doc_id", "held_out", "lang_pred", "score", F.size("spans").alias("n_spans"))


def keep_known(docs: DataFrame) -> DataFrame:
    """The documents that have a language; all columns as they were."""
    found = identify(docs.withColumnsRenamed({c: f"__{c}" for c in docs.columns if c != "text"}), fit(docs))
    found = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return found.select(*[F.col(c if c == "text" else f"__{c}").alias(c) for c in docs.columns])
