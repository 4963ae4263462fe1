"""Toxicity by a factorization machine over hashed terms: linear weights and pairwise interactions through latent factors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.tokens import Words, chunks

#: Hashed terms, latent factors, epochs, documents to a step, step size, decay of the weights.
BITS, FACTORS, EPOCHS, STEP_DOCS, RATE, DECAY = 20, 8, 15, 32, 0.1, 1e-5
#: Beginnings of words that are terms beside the words, and marks that are no part of a word.
BEGINNINGS, MARKS = (3, 4, 5), "!\"#$%&'()*+,-./:;<=>?@[]^_`{|}~"
#: Labelled documents that the model is fitted on at most; a term counts from this many of them on, if a chi-square test against the
#: label gives it at least LEAST_CHI, or if together with another of the PAIRED terms that split the documents best it tells the label
#: by LEAST_PAIR more than the two do by themselves.
FIT_DOCS, LEAST_DOCS, LEAST_CHI, PAIRED, LEAST_PAIR = 8192, 3, 6.6, 1024, 40.0


def _hashed(strings: pa.Array, valid: np.ndarray, end: bytes = b"") -> np.ndarray:
    coded = strings.cast(pa.large_binary()).dictionary_encode()
    h = np.fromiter((xxhash.xxh64_intdigest(x + end) >> 64 - BITS for x in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return np.where(valid, h[coded.indices.to_numpy(zero_copy_only=False)], -1) if len(h) else np.full(len(strings), -1)


def word_terms(words: pa.Array) -> np.ndarray:
    """Hashed terms of each word, a row each: the word and its beginnings without marks around it, lower-cased; -1 for none."""
    core = pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)
    size = pc.utf8_length(core).to_numpy(zero_copy_only=False)
    return np.stack([_hashed(core, size > 0, b"$"), *(_hashed(pc.utf8_slice_codeunits(core, 0, k), size >= k) for k in BEGINNINGS)], axis=1)


def terms(texts: pa.Array, use: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text, in a row, and the number of each text's. use: the terms that count, if not all."""
    w = Words(texts, lower=False)
    of = word_terms(w.unique)
    if use is not None:
        of = np.where((of >= 0) & use[of], of, -1)
    n = len(w.ends)
    some = (of >= 0).any(axis=1)[w.codes] if len(w.codes) else np.empty(0, bool)
    at, doc = of[w.codes[some]], w.doc[some]
    both = np.unique((doc[:, None] << BITS | at)[at >= 0])
    return both & ((1 << BITS) - 1), np.bincount(both >> BITS, minlength=n)


@dataclass
class Model:
    """place: of each hashed term among the weights (-1: none)."""

    place: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def margins(self, bucket: np.ndarray, counts: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(counts)), counts)
        at = self.place[bucket] if len(self.w) else np.full(len(bucket), -1)
        at, doc = at[at >= 0], doc[at >= 0]
        out = np.full(len(counts), self.bias)
        np.add.at(out, doc, self.w[at])
        s, q = np.zeros((len(counts), FACTORS)), np.zeros(len(counts))
        np.add.at(s, doc, self.v[at])
        np.add.at(q, doc, (self.v[at] ** 2).sum(axis=1))
        return out + 0.5 * ((s**2).sum(axis=1) - q)


def _chi(n: np.ndarray, pos: np.ndarray, total: float, toxic: float) -> np.ndarray:
    """Chi-square of groups of n rows, pos of them toxic, against the share of toxic rows in all."""
    share = toxic / total
    return np.divide((pos - n * share) ** 2, n * share * (1 - share), out=np.zeros(np.shape(n)), where=n > 0)


def paired_terms(bucket: np.ndarray, counts: np.ndarray, y: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Hashed terms that tell the label in pairs, though maybe not alone: of each two of the PAIRED terms that are nearest to half of the
    documents, the four cells' chi-square exceeds the sum of both terms' own by LEAST_PAIR."""
    total, toxic = float(len(y)), float(y.sum())
    if not 0 < toxic < total:
        return np.empty(0, np.int64)
    some = np.flatnonzero((df >= LEAST_DOCS) & (df <= total - LEAST_DOCS))
    some = np.sort(some[np.argsort(-np.minimum(df[some], total - df[some]), kind="stable")[:PAIRED]])
    at = np.full(1 << BITS, -1)
    at[some] = np.arange(len(some))
    doc, col = np.repeat(np.arange(len(counts)), counts), at[bucket]
    both, hits = (np.zeros((len(some), len(some))) for _ in range(2))
    for lo in range(0, len(counts), 2048):
        x = np.zeros((min(2048, len(counts) - lo), len(some)), np.float32)
        use = (doc >= lo) & (doc < lo + len(x)) & (col >= 0)
        x[doc[use] - lo, col[use]] = 1
        both += x.T @ x
        hits += x.T @ (x * y[lo : lo + len(x), None].astype(np.float32))
    n, p = np.diag(both), np.diag(hits)
    cells = _chi(both, hits, total, toxic) + _chi(n[:, None] - both, p[:, None] - hits, total, toxic) + _chi(n - both, p - hits, total, toxic) + _chi(total - n[:, None] - n + both, toxic - p[:, None] - p + hits, total, toxic)
    own = _chi(n, p, total, toxic) + _chi(total - n, toxic - p, total, toxic)
    gain = cells - own[:, None] - own
    np.fill_diagonal(gain, 0)
    return some[gain.max(axis=1, initial=0) >= LEAST_PAIR]


def learn(bucket: np.ndarray, counts: np.ndarray, y: np.ndarray) -> Model:
    """Logistic loss, AdaGrad steps; documents in a fixed shuffled order. Without both labels the bias alone speaks."""
    df = np.bincount(bucket, minlength=1 << BITS).astype(float)
    pos, total, toxic = np.bincount(bucket, np.repeat(y, counts), 1 << BITS), max(len(y), 1), y.sum()
    spread = df * (total - df) * toxic * (total - toxic)
    chi = np.divide(total * (total * pos - df * toxic) ** 2, spread, out=np.zeros_like(df), where=spread > 0)
    keep = (df >= LEAST_DOCS) & (chi >= LEAST_CHI)
    keep[paired_terms(bucket, counts, y, df)] = True
    place = np.where(keep, np.cumsum(keep) - 1, -1)
    n = int((place >= 0).sum())
    rng = np.random.default_rng(7)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias, w, v = float(np.log(prior / (1 - prior))), np.zeros(n), rng.normal(0, 0.02, (n, FACTORS))
    if n and 0 < y.sum() < len(y):
        at_all, doc_all = place[bucket], np.repeat(np.arange(len(counts)), counts)
        at_all, doc_all = at_all[at_all >= 0], doc_all[at_all >= 0]
        ends = np.searchsorted(doc_all, np.arange(len(counts)), "right")
        starts = np.r_[0, ends[:-1]]
        gw, gv, gb = np.full(n, 1e-2), np.full((n, FACTORS), 1e-2), 1e-2
        for _ in range(EPOCHS):
            order = rng.permutation(len(counts))
            for lo in range(0, len(order), STEP_DOCS):
                docs = order[lo : lo + STEP_DOCS]
                size = ends[docs] - starts[docs]
                at = np.concatenate([at_all[a:b] for a, b in zip(starts[docs], ends[docs], strict=True)])
                doc = np.repeat(np.arange(len(docs)), size)
                vv = v[at]
                s = np.zeros((len(docs), FACTORS))
                np.add.at(s, doc, vv)
                q = np.bincount(doc, (vv**2).sum(axis=1), len(docs))
                m = bias + np.bincount(doc, w[at], len(docs)) + 0.5 * ((s**2).sum(axis=1) - q)
                g = 1 / (1 + np.exp(-np.clip(m, -30, 30))) - y[docs]
                scale = g[doc] / np.sqrt(np.maximum(size, 1))[doc]  # long texts don't outweigh short ones
                u, back = np.unique(at, return_inverse=True)
                dw = np.bincount(back, scale, len(u)) + DECAY * w[u]
                dv = np.zeros((len(u), FACTORS))
                np.add.at(dv, back, scale[:, None] * (s[doc] - vv))
                dv += DECAY * v[u]
                gw[u] += dw**2
                gv[u] += dv**2
                w[u] -= RATE * dw / np.sqrt(gw[u])
                v[u] -= 0.2 * RATE * dv / np.sqrt(gv[u])
                gb += float(g.mean()) ** 2
                bias -= RATE * float(g.mean()) / np.sqrt(gb)
    return Model(place.astype(np.int32), bias, w, v)


def _terms_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in chunks(batches):
        bucket, counts = terms(b.column("text"))
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(bucket.astype(np.int32)))
        yield pa.RecordBatch.from_arrays([b.column("order"), b.column("label"), lists], ["order", "label", "terms"])


def _learn_task(key: tuple, t: pa.Table) -> pa.Table:
    t = t.sort_by("order").combine_chunks()
    lists = t.column("terms").combine_chunks()
    m = learn(lists.flatten().to_numpy(), np.diff(np.asarray(lists.offsets)), t.column("label").to_numpy().astype(float))
    parts = [m.place.astype("<i4").tobytes(), np.array([m.bias]).tobytes(), m.w.tobytes(), m.v.tobytes()]
    return pa.table({"place": pa.array(parts[:1], pa.binary()), "bias": pa.array(parts[1:2], pa.binary()), "w": pa.array(parts[2:3], pa.binary()), "v": pa.array(parts[3:], pa.binary())})


def fit(docs: DataFrame, limit: int = FIT_DOCS) -> Model:
    """From (text, label 0/1): at most about `limit` documents, taken by the hash of their text, meet in one task."""
    d = docs.where("label is not null").select(F.coalesce("text", F.lit("")).alias("text"), F.col("label").cast("int").alias("label"))
    d = d.withColumn("order", F.xxhash64("text", "label"))
    share = min(1.0, limit / max(1, d.select("label").count()))
    d = d.where(F.pmod("order", F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    t = settle(d.mapInArrow(_terms_task, "order long, label int, terms array<int>"), "terms")
    rows = t.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_learn_task, "place binary, bias binary, w binary, v binary").collect()  # one row of bounded size
    if not rows:
        return learn(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    r = rows[0]
    return Model(np.frombuffer(r.place, "<i4"), float(np.frombuffer(r.bias)[0]), np.frombuffer(r.w), np.frombuffer(r.v).reshape(-1, FACTORS))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; null texts are empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the hashed terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            p = 1 / (1 + np.exp(-np.clip(sent.value.margins(*terms(b.column("text"), sent.value.place >= 0)), -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text")
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from labelled documents whose crc32(doc_id) mod 5 is not 0 and scores all.

    Null doc_ids have no label. Labels that repeat count once; without labels every score is 0.5.
    """
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    d = docs.select("doc_id", "text", held_out.alias("held_out"))
    marked = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("label")).where("label is not null").distinct()
    marked = marked.where(F.pmod(F.crc32(F.col("id").cast("string")), F.lit(5)) != 0)
    share = min(1.0, FIT_DOCS / max(1, marked.count()))
    marked = marked.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))
    sample = d.join(F.broadcast(marked), F.col("doc_id") == F.col("id"))  # about FIT_DOCS rows of two numbers
    return score(d, fit(sample.where(~F.col("held_out")).select("text", "label")))
