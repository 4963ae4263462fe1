"""Near copies: a Gray-order index of SimHash fingerprints proposes, the shingle sets decide.

Texts of one shingle set are one node, with a fingerprint of 256 bits: each the sign of a random projection of the set, so that sets of
similarity SIMILAR differ in a bit with a probability of P at most. The index is that of simhash_dedup, with more and smaller blocks: the
bits are dealt into blocks several times over, fingerprints that agree on a block are a node of the index, and its Gray hierarchy is
searched for what is within RADIUS. Blocks get longer as the corpus grows, and more of them are taken then: as many as leave a pair of
similarity SIMILAR unproposed with a probability of MISS at most, a closer one less often.

Links of the index make components, and in each every pair of similar sets counts: a few proposed links of each member and those of a few
representatives with all members are verified first, then those of the member with most links. Where a component still falls into several classes,
members of which more than a 1 - SIMILAR share of their shingles stands in no other set surely have no partner and leave, and only the
rest has all its pairs compared, blocks of members against blocks. Every pair is verified on the whole shingle sets, so no link is a guess.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.llm.components import components
from loomgraph.llm.gray_index import LEAF, _small_links, gray_links, gray_rank
from loomgraph.llm.tokens import Words, chunks, ragged

WIDTH, SIMILAR = 5, 0.8
#: Bits of a fingerprint; words of it that a search compares; bits of these in which a pair may differ: 29 on average at SIMILAR, over 50 once in 50,000.
BITS, SEEN, RADIUS = 256, 3, 50
#: Probability with which two sets of similarity SIMILAR differ in a bit: their angle over pi.
P = math.acos(2 * SIMILAR / (1 + SIMILAR)) / math.pi
MISS = 0.0003
#: Fingerprints of a node, above which it is searched by pairs of parts.
NODE = 40_000
#: Proposed links of a node that are verified, least ids first; all of them count for components of the index.
CLOSE = 8
#: Members of a bucket that are compared with as many others at a time, distinct shingles looked at together then.
BLOCK, SLICE = 128, 8192
#: Votes of a shingle in a projection: VOTES fair coins. As many shingles as a byte can count the votes of.
VOTES = 7
RUN = 255 // VOTES
_RANDOM = np.random.default_rng(20)
_SEEDS = _RANDOM.integers(0, 1 << 64, BITS // 64, dtype=np.uint64)
#: For each byte of a shingle's hashes the votes for eight bits, one in each byte of a word. Half of the values vote against the others,
#: so that votes are even over all values: else large sets that share nothing would look alike.
_HALF = _RANDOM.binomial(VOTES, 0.5, (BITS // 8, 128, 8)).astype(np.uint8)
_LANES = np.concatenate([_HALF, VOTES - _HALF], axis=1).view(np.uint64)[:, :, 0]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts): each text's distinct shingles in order, and how many it has; one of all words where there are fewer than width."""
    w = Words(texts)
    words = w.hashes()[w.codes] if len(w.codes) else np.empty(0, np.uint64)
    size = np.minimum(w.counts, width)
    n = w.counts - size + (size > 0)
    at, doc = ragged(w.starts, n), np.repeat(np.arange(len(n)), n)
    h = np.zeros(len(at), np.uint64)
    for i in range(width):
        there = i < size[doc]
        h[there] = _mix(h[there] * np.uint64(31) + words[at[there] + i] + np.uint64(i + 1))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], np.bincount(doc[new], minlength=len(n))


def projected(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints, a row of words for each set of hashes h, none of them empty: a bit is 1 if over half of its votes are."""
    runs = -(-counts // RUN)
    first = np.cumsum(runs) - runs
    starts = ragged(np.zeros(len(runs), np.int64), runs) * RUN + np.repeat(np.cumsum(counts) - counts, runs)
    bits = np.empty((len(counts), BITS), bool)
    for k, seed in enumerate(_SEEDS):
        at = _mix(h ^ seed).view(np.uint8).reshape(-1, 8)
        for i in range(8):
            j = k * 8 + i
            votes = np.add.reduceat(_LANES[j][at[:, i]], starts).view(np.uint8).reshape(-1, 8)
            bits[:, j * 8 : j * 8 + 8] = 2 * np.add.reduceat(votes, first, axis=0, dtype=np.int64) > VOTES * counts[:, None]
    return np.packbits(bits, axis=1).view(np.uint64)


def signatures(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, node, f0..f3): the shingle set's hash, 0 for none, and its fingerprint, null for none."""
    names = [f"f{i}" for i in range(BITS // 64)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, counts = shingle_sets(b.column("text"))
            full = np.flatnonzero(counts)
            node, f = np.zeros(len(counts), np.uint64), np.zeros((len(counts), BITS // 64), np.uint64)
            if len(full):
                node[full] = _mix(np.add.reduceat(_mix(h), (np.cumsum(counts) - counts)[full]) + counts[full].astype(np.uint64)) | np.uint64(1)
                f[full] = projected(h, counts[full])
            words = [pa.array(f[:, i].view(np.int64), mask=counts == 0) for i in range(BITS // 64)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text_hash"), pa.array(node.view(np.int64)), *words], ["doc_id", "text_hash", "node", *names])

    d = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, text_hash long, node long, " + ", ".join(f"{f} long" for f in names))


def blocks_for(n: int) -> tuple[int, int]:
    """(bits of a block, times that the bits are dealt into blocks) for n fingerprints.

    A node holds some LEAF fingerprints that don't belong together, up to 16 LEAF once there are very many. Of a pair that differs in d of
    the bits, a block agrees with probability C(BITS - d, bits) / C(BITS, bits).
    """
    bits = min(max(math.ceil(math.log2(max(n, 1) / LEAF)), 8), max(14, math.ceil(math.log2(max(n, 1) / LEAF / 16))))
    odds = [math.comb(BITS, d) * P**d * (1 - P) ** (BITS - d) for d in range(BITS + 1)]
    agree = [math.comb(BITS - d, bits) / math.comb(BITS, bits) for d in range(BITS + 1)]
    deals = 1
    while sum(o * (1 - a) ** (deals * (BITS // bits)) for o, a in zip(odds, agree, strict=True)) > MISS:
        deals += 1
    return bits, deals


def block_values(f: np.ndarray, bits: int, deals: int) -> np.ndarray:
    """For each fingerprint the numbers of its nodes: block and the block's value."""
    ones, each = np.unpackbits(f.view(np.uint8), axis=1), BITS // bits
    out = np.empty((len(f), deals * each), np.int64)
    for k in range(deals):
        order = np.random.default_rng(k).permutation(BITS)[: each * bits]
        value = ones[:, order].reshape(len(f), each, bits) @ (1 << np.arange(bits, dtype=np.int64))
        out[:, k * each : (k + 1) * each] = value + ((k * each + np.arange(each)) << bits)
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of whole nodes to their least member; rows come sorted by node, the last node of a batch waits for the next one."""
    keep: list[pa.RecordBatch] = []

    def flush(rows: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(rows)
        key = np.stack([t.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        node, x = t.column("node").to_numpy(), np.stack([t.column(f"f{i}").to_numpy().view(np.uint64) for i in range(SEEN)], axis=1)
        first = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(axis=1)])
        sizes = np.diff(np.r_[first, len(x)])
        root, size = np.arange(len(x)), np.repeat(sizes, sizes)
        low = np.flatnonzero((size <= LEAF) & (size > 1))
        if low.size:
            at, top = _small_links(x[low], np.repeat(np.arange(len(first)), sizes)[low], size[low], RADIUS)
            root[low[at]] = low[top]
        for lo, n in zip(first, sizes, strict=True):
            if n > LEAF:
                at, top = gray_links(x[lo : lo + n], 0, RADIUS)
                root[lo + at] = lo + top
        least = node.copy()
        np.minimum.at(least, root, node)
        links = np.unique(np.stack([node, least[root]], axis=1)[node != least[root]], axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.stack([batch.column(c).to_numpy() for c in ("key", "lo", "hi")], axis=1)
        changes = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        if keep and any(keep[-1].column(c)[-1] != batch.column(c)[0] for c in ("key", "lo", "hi")):
            yield from flush(keep)
            keep = []
        if len(changes):
            yield from flush([*keep, batch.slice(0, changes[-1])])
            keep = [batch.slice(changes[-1])]
        else:
            keep.append(batch)
    if keep:
        yield from flush(keep)


def proposed(nodes: DataFrame, limit: int = NODE) -> DataFrame:
    """Links (a, b), repeated ones too, that connect nodes (node, f0..f3) as do all pairs within RADIUS that agree on a block.

    A node of the index with over limit fingerprints is dealt to parts by their hash, and two parts at a time meet in a task: so no task
    gets an unbounded one and no link is lost. Each row's first id is greater than its second, and has one row a block at most.
    """
    full = nodes.where("f0 is not null").select("node", *[f"f{i}" for i in range(BITS // 64)])
    n = full.count()
    bits, deals = blocks_for(n)

    def keys(batch: pa.RecordBatch) -> np.ndarray:
        return block_values(np.stack([batch.column(f"f{i}").to_numpy().view(np.uint64) for i in range(BITS // 64)], axis=1), bits, deals)

    def frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, count = 0, np.zeros(deals * (BITS // bits) << bits, np.int64)
        for b in batches:
            rows += b.num_rows
            count += np.bincount(keys(b).ravel(), minlength=len(count))
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(count * n > rows * limit))], ["key"])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                key = keys(part)
                at = pa.array(np.repeat(np.arange(len(key)), key.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), *[part.column(c).take(at) for c in ["node", *words]]], ["key", "node", *words])

    words = [f"f{i}" for i in range(SEEN)]
    d = full.mapInArrow(dealt, "key long, node long, " + ", ".join(f"{f} long" for f in words))
    d = d.withColumns({"lo": F.lit(0), "hi": F.lit(0)})
    if n > limit:  # of over limit rows among n, some task has more than that share: only what is frequent somewhere is counted
        some = settle(full.mapInArrow(frequent, "key long").distinct(), "frequent")
        crowded = some.withColumn("n", F.lit(0).cast("long"))
        if not some.isEmpty():
            crowded = settle(d.select("key").join(some, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit), "crowded")
        if not crowded.isEmpty():
            parts = d.drop("lo", "hi").join(crowded.select("key", F.ceil(2 * F.col("n") / limit).cast("int").alias("parts")), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
            parts = parts.withColumn("i", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
            d = parts.select("key", "node", *words, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
    d = d.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", gray_rank(F.col("f0")))
    return d.mapInArrow(_searched, "a long, b long")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __id, __null and __hash, which name a row's doc_id and text without nulls."""
    return docs.withColumns({"__id": F.coalesce("doc_id", F.lit(0)), "__null": F.col("doc_id").isNull(), "__hash": F.xxhash64(F.coalesce("text", F.lit("")))})


KEY = ["__id", "__null", "__hash"]


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of wanted rows (node, __id, __null, __hash)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, counts = shingle_sets(b.column("text"))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("node"), lists], ["node", "s"])

    d = keyed(docs).select(*KEY, "text").join(wanted, KEY).select("node", "text")
    return d.mapInArrow(run, "node long, s array<long>").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of SIMILAR at least."""
    d = pairs.join(sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    # n, m >= SIMILAR * max(n, m) is needed for the similarity and spares the intersection
    near = F.least(F.size("sa"), F.size("sb")) >= SIMILAR * F.greatest(F.size("sa"), F.size("sb"))
    return d.where(near).where(both >= SIMILAR * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def shortened(near: DataFrame) -> DataFrame:
    """Links (a, b) with the components of near (a, bs), where bs are a's links in order: each a to its least b, and the others to that one.

    Of a large group, blocks propose a link a member and block, to as many representatives; these are few beside the members, so that
    little more than a link a member is left.
    """
    least = F.get("bs", F.lit(0))
    others = near.select(least.alias("b"), F.explode(F.slice("bs", 2, F.size("bs"))).alias("a"))
    return near.select("a", least.alias("b")).unionByName(others.select("a", "b").distinct())


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (node, first), first being the struct (__null, __id, __hash) of the smallest row with that set, and the components (node, root) of those that have links."""
    rows = signatures(docs)
    first = F.struct(F.col("doc_id").isNull().alias("__null"), F.coalesce("doc_id", F.lit(0)).alias("__id"), F.col("text_hash").alias("__hash"))
    nodes = settle(rows.groupBy("node").agg(F.min(first).alias("first"), *[F.first(f"f{i}").alias(f"f{i}") for i in range(BITS // 64)]), "nodes")
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    near = settle(proposed(nodes).groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs")), "near")
    at = settle(components(shortened(near)).select(F.lit(0).alias("band"), F.col("root").alias("key"), "node"), "members")
    met = at.groupBy("band", "key").agg(F.max("node").alias("r1"), F.min_by("node", F.xxhash64("node")).alias("r2"))
    members = at.join(met, ["band", "key"])
    stars = members.select("node", F.explode(F.array("key", "r1", "r2")).alias("r")).where("r <> node")
    close = near.select(F.col("a").alias("node"), F.explode(F.slice("bs", 1, CLOSE)).alias("r"))
    pairs = settle(close.unionByName(stars).select(*ordered("node", "r")).distinct(), "pairs")
    wanted = members.select("node").distinct().join(nodes.select("node", "first.*"), "node")
    sets = settle(sets_of(docs, wanted), "sets")
    links = settle(verified(pairs, sets), "links")
    found = settle(components(links), "components")
    rooted = settle(mixed(members.select("band", "key", "node"), found), "mixed")
    rooted = settle(mixed(rooted.join(lonely(sets.join(rooted.select("node").distinct(), "node", "left_semi")), "node", "left_anti").select("band", "key", "node"), found), "mixed")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    hubs = rooted.join(degree, "node", "left").groupBy("band", "key").agg(F.max_by("node", F.struct(F.coalesce("count", F.lit(0)), F.xxhash64("node"))).alias("r"))
    spokes = rooted.join(hubs, ["band", "key"]).where("r <> node").select(*ordered("node", "r")).distinct().join(pairs, ["a", "b"], "left_anti")
    spokes = settle(spokes, "pairs")
    joined = lambda more: settle(components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)), "components")  # noqa: E731  classes stand for their links
    more = settle(verified(spokes, sets), "links")
    if not more.isEmpty():
        found = joined(more)
        rooted = settle(mixed(rooted.select("band", "key", "node"), found), "mixed")
    more = settle(across(rooted, sets), "links")
    if not more.isEmpty():
        found = joined(more)
    return nodes.select("node", "first"), found


def across(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect members (band, key, node, root) of one bucket as all their pairs across roots do.

    A bucket's members are dealt to blocks of about BLOCK by their hash, and two blocks at a time meet in a task: so a member is sent
    once for each block of its bucket, and no task gets an unbounded bucket.
    """
    sizes = members.groupBy("band", "key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    d = members.join(sizes, ["band", "key"]).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    d = d.select("band", "key", "node", "root", "i", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"))
    d = d.select("band", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "node", "root")
    return d.join(sets, "node").groupBy("band", "key", "lo", "hi").applyInArrow(_links_across, "a long, b long")


def overlaps(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Numbers of common values of each two sets, given in a row."""
    _, code = np.unique(values, return_inverse=True)
    order, out = np.argsort(code, kind="stable"), np.zeros((len(counts), len(counts)), np.float32)
    code, of = code[order], np.repeat(np.arange(len(counts)), counts)[order]
    ends = np.searchsorted(code, np.arange(SLICE, int(code[-1]) + SLICE + 1, SLICE)) if len(code) else []
    lo = 0
    for k, hi in enumerate(ends):  # a slice of the values at a time
        has = np.zeros((len(counts), SLICE), np.float32)
        has[of[lo:hi], code[lo:hi] - k * SLICE] = 1
        out += has @ has.T
        lo = hi
    return out


def _links_across(t: pa.Table) -> pa.Table:
    lists = t.column("s").combine_chunks()
    node, root = (t.column(c).to_numpy() for c in ("node", "root"))
    n = np.diff(np.asarray(lists.offsets))
    both = overlaps(lists.flatten().to_numpy(), n)
    near = (both >= SIMILAR * (n[:, None] + n - both)) & (root[:, None] != root)
    tops = {int(r): int(r) for r in root}

    def top(x: int) -> int:
        while tops[x] != x:
            x = tops[x]
        return x

    links = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(near))), strict=True):
        x, y = top(int(root[i])), top(int(root[j]))
        if x != y:
            tops[max(x, y)] = min(x, y)
            links.append((int(node[i]), int(node[j])))
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def mixed(members: DataFrame, found: DataFrame) -> DataFrame:
    """Members (band, key, node) with their root, of buckets that hold several components."""
    rooted = members.join(found, "node", "left").select("band", "key", "node", F.coalesce("root", "node").alias("root"))
    several = rooted.groupBy("band", "key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1").select("band", "key")
    return rooted.join(several, ["band", "key"])


def lonely(sets: DataFrame) -> DataFrame:
    """Nodes of sets (node, s) so many of whose shingles are in no other set that none of these can be similar."""
    once = sets.select("node", F.size("s").alias("n"), F.explode("s").alias("h")).groupBy("h").agg(F.count("*").alias("sets"), F.min("node").alias("node"), F.min("n").alias("n")).where("sets = 1")
    return once.groupBy("node").agg(F.count("*").alias("own"), F.min("n").alias("n")).where(F.col("n") - F.col("own") < SIMILAR * F.col("n")).select("node")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component of near copies, all columns as they were: that of the smallest doc_id, then text hash, nulls last.

    Repeated rows are copies too; different texts under one doc_id are judged by their texts. Texts without words are one component.
    """
    nodes, found = classes(docs)
    root = nodes.join(found, "node", "left").select(F.coalesce("root", "node").alias("root"), "first")
    chosen = root.groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    rows = keyed(docs.select(F.struct(*docs.columns).alias("row"), "doc_id", "text")).select("row", *KEY)  # columns of docs keep their names, whatever these are
    return rows.join(chosen, KEY, "left_semi").dropDuplicates(KEY).select("row.*")
