"""SimHash near-duplicates over a Gray-order hierarchical index.

Of four blocks of bits a pair within three bits agrees on one. For each block, fingerprints hang under upper nodes that share the
first bits of that block. Below a node they lie in Gray order of the block, then of the whole, neighbours in leaves, leaves in inner
nodes; each factors the bits that all below it share. The search goes down by pairs of nodes and drops a pair, with all below, as soon
as the shared bits differ in the block, or in more than the radius. A node with too many fingerprints is split by more bits of its
block and, where they agree on the whole block, by four blocks of the remaining bits: so no task gets an unbounded node and no link is
lost. A task returns links to representatives only, never the pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import bit_votes, hex16, majority, settle, shingles, words
from loomgraph.llm.components import components
from loomgraph.llm.gray_index import LEAF, _Forest, _small_links, gray_links, gray_rank  # noqa: F401
from loomgraph.llm.near_copies import keep_one  # noqa: F401

RADIUS, BLOCKS, WIDTH = 3, 4, 3
#: Fingerprints under one node, above which it is split; over 2 ** 15, what the last level can hold at most. Bits of a block by which nodes are split at a time.
NODE, STEP = 40_000, 4
KEY = ["depth", "path", "head"]


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Rows (doc_id, text_hash, fp, copies): 64 bits by majority of the XXH64 (seed 42) of the shingles of lower-cased whole texts.

    Null and empty texts get 0. Repeated rows become one with their number (their votes and their total grow alike); different texts
    under one doc_id stay apart. Columns but doc_id and text are not read.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.select("doc_id", F.xxhash64("text").alias("text_hash"), F.length("text").alias("size"), shingles(words(F.col("text")), width).alias("s"))
    d = d.select("doc_id", "text_hash", F.posexplode_outer("s").alias("pos", "s")).select("doc_id", "text_hash", F.coalesce("pos", F.lit(0)).alias("pos"), "s.*")
    h = F.when(F.col("s0").isNotNull(), F.xxhash64(F.concat_ws(" ", *[f"s{i}" for i in range(width)]))).otherwise(F.lit(0).cast("long"))
    d = d.select("doc_id", "text_hash", h.alias("h"), F.col("s0").isNotNull().cast("long").alias("one"), "pos")
    votes = d.groupBy("doc_id", "text_hash").agg(F.sum("one").alias("n"), F.count_if(F.col("pos") == 0).alias("copies"), *bit_votes("h"))
    return votes.select("doc_id", "text_hash", majority("n").alias("fp"), "copies")


@cache
def block_masks(level: int) -> list[int]:
    """For each path of that many choices of one block in four, the bits fixed along it. The blocks of a level cut what the path has left."""
    paths = [(0, list(range(64)))]
    for _ in range(level + 1):
        step = []
        for fixed, left in paths:
            cuts = [len(left) * i // BLOCKS for i in range(BLOCKS + 1)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                step.append((fixed | sum(1 << b for b in left[lo:hi]), left[:lo] + left[hi:]))
        paths = step
    return [fixed for fixed, _ in paths]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def head_masks(bits: int) -> list[int]:
    """The first bits of each block of the first level."""
    width = 64 // BLOCKS
    return [((1 << bits) - 1) << (m.bit_length() - bits) for m in block_masks(0) if width >= bits]


def _at(masks: list[int]) -> Column:
    """The mask of column path."""
    return F.get(F.expr(f"array({', '.join(f'{_signed(m)}L' for m in masks)})"), F.col("path"))


def nodes(fps: DataFrame, limit: int = NODE) -> DataFrame:
    """Rows (fp, depth, path, head, block) of distinct fingerprints under nodes (depth, path, head) of at most limit members; block: the Gray rank of the bits that a pair must agree on."""
    level, bits, rest, done = 0, STEP, None, []
    while True:
        if level or bits == STEP:  # a new level: each fingerprint once for each block
            step = (fps.select("fp", F.lit(0).alias("path")) if rest is None else rest).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
            rest = step.select("fp", (F.col("path") * BLOCKS + F.col("block")).alias("path"))
        at = rest.withColumn("head", F.col("fp").bitwiseAND(_at(block_masks(level) if level else head_masks(bits))))
        mark = lambda d, level=level, bits=bits: d.select("fp", F.lit(level * 64 + bits).alias("depth"), "path", "head", gray_rank(F.col("head") if level else F.col("fp").bitwiseAND(_at(block_masks(0)))).alias("block"))
        crowded = at.groupBy("path", "head").count().where(F.col("count") > limit).drop("count")
        if crowded.isEmpty():
            done.append(mark(at))
            return reduce(DataFrame.unionByName, done)
        crowded = settle(crowded, "crowded")
        done.append(settle(mark(at.join(crowded, ["path", "head"], "left_anti")), "nodes"))
        rest = settle(at.join(crowded, ["path", "head"], "left_semi").select("fp", "path"), "rest")
        if level or bits == 64 // BLOCKS:  # below whole blocks by whole blocks
            level, bits = level + 1, 64
        else:
            bits += STEP


def _linked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of whole nodes; the rows come sorted by node and Gray rank, the last node of a batch waits for the next one."""
    keep: list[pd.DataFrame] = []

    def flush(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        x = rows["fp"].to_numpy(np.int64).view(np.uint64)
        key = rows[KEY].to_numpy(np.int64)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[first, len(x)])
        group = np.repeat(np.arange(len(first)), sizes)
        size = sizes[group]
        low = np.flatnonzero((size <= LEAF) & (size > 1))
        found = [(lambda at, root: (x[low][at], x[low][root]))(*_small_links(x[low], group[low], size[low], RADIUS))] if low.size else []
        for lo, n in zip(first, sizes, strict=True):
            if n > LEAF:
                y, (depth, path) = x[lo : lo + n], key[lo, :2].tolist()
                found.append((lambda at, root, y=y: (y[at], y[root]))(*gray_links(y, block_masks(depth // 64)[path], RADIUS)))
        if found:
            a, b = (np.concatenate(v).view(np.int64) for v in zip(*found, strict=True))
            yield pd.DataFrame({"a": a, "b": b})

    for batch in batches:
        if not len(batch):
            continue
        last = batch[KEY].iloc[-1]
        same = (batch[KEY] == last).all(axis=1).to_numpy()
        cut = int(np.argmin(same[::-1])) if not same.all() else len(batch)
        head, tail = batch.iloc[: len(batch) - cut], batch.iloc[len(batch) - cut :]
        if keep and (len(head) or (keep[-1][KEY].iloc[-1] != last).any()):
            whole = pd.concat([*keep, head])
            keep = []
            yield from flush(whole)
        elif len(head):
            yield from flush(head)
        keep.append(tail)
    if keep:
        yield from flush(pd.concat(keep))


def links(fps: DataFrame, limit: int = NODE) -> DataFrame:
    """Links (a, b) that connect distinct fingerprints fp just as all pairs within the radius do."""
    n = nodes(fps, limit).withColumn("rank", gray_rank(F.col("fp")))
    dealt = n.repartition(*KEY).sortWithinPartitions(*KEY, "block", "rank")
    return dealt.select("fp", *KEY).mapInPandas(_linked, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = NODE) -> DataFrame:
    """Rows (doc_id, text_hash, fp, copies, component_id): the smallest doc_id reachable over fingerprints within three bits.

    All rows whose fingerprints are equal share a component, texts without words (fingerprint zero) too. Null doc_ids never name a
    component unless all of it are null. An empty table gives an empty result.
    """
    d = settle(fingerprints(docs), "fingerprints")
    each = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = settle(components(links(each.select("fp"), limit)), "components")
    root = each.join(found, each.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = root.join(root.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return d.join(named, "fp")


def report(docs: DataFrame) -> DataFrame:
    """One row for each row of docs, repeated ones too."""
    d = near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id", "copies")
    more = d.where("copies > 1").select("doc_id", "fingerprint", "component_id", F.explode(F.sequence(F.lit(2), F.col("copies"))).alias("copy")).drop("copy")
    return d.drop("copies").unionByName(more)
