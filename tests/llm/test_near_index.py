"""The near-duplicate stage's index: fingerprints of shingle sets, nodes by blocks of bits, Gray search, against brute force."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import components, near_copies


def similar_pairs(rng, sizes, n):
    """(hashes, counts) of n pairs of sets, one after another, of similarity 0.8 exactly: sizes are those of the common part and the two rests."""
    both, one, other = sizes
    sets = []
    for _ in range(n):
        c = rng.integers(0, 1 << 63, both, dtype=np.uint64)
        sets += [np.r_[c, rng.integers(0, 1 << 63, k, dtype=np.uint64)] for k in (one, other)]
    return np.concatenate(sets), np.array([len(s) for s in sets])


@pytest.mark.parametrize("sizes", [(4, 0, 1), (8, 1, 1), (8, 2, 0), (40, 5, 5), (40, 0, 10), (400, 50, 50)])
def test_pairs_of_similarity_08_are_proposed(spark, sizes):
    """Fingerprints differ as the sets' angle says, for small sets too, and the index proposes the pairs, whatever the length of its blocks."""
    h, counts = similar_pairs(np.random.default_rng(3), sizes, 3000)
    f = near_copies.projected(h, counts)
    differ = np.bitwise_count(f[::2] ^ f[1::2])
    assert differ.sum(axis=1).mean() / near_copies.BITS < near_copies.P + 0.006
    assert (differ[:, : near_copies.SEEN].sum(axis=1) > near_copies.RADIUS).mean() < 0.001
    for n in (50_000, 250_000, 15_000_000):
        bits, deals = near_copies.blocks_for(n)
        values = near_copies.block_values(f, bits, deals)
        assert (values[::2] == values[1::2]).any(axis=1).mean() > 0.998


def test_unrelated_sets_differ_in_half_the_bits():
    rng = np.random.default_rng(6)
    counts = np.tile([3, 300, 20_000], 40)
    f = near_copies.projected(rng.integers(0, 1 << 63, counts.sum(), dtype=np.uint64), counts)
    for k in range(3):
        same = [np.bitwise_count(a ^ b).sum() for a, b in itertools.combinations(f[k::3], 2)]
        assert 0.48 < np.mean(same) / near_copies.BITS < 0.52 and np.min(same) > 70


@pytest.mark.parametrize("limit", [30, 40_000])
def test_index_matches_all_pairs(spark, limit):
    """Far, near and crowded fingerprints: links connect what all pairs within the radius that share a block connect, for nodes in parts too."""
    rng = np.random.default_rng(limit)
    f = rng.integers(0, 1 << 63, (500, 4), dtype=np.uint64)
    noise = np.packbits(rng.random((700, 256)) < np.repeat([0.005, 0.1], [300, 400])[:, None], axis=1).view(np.uint64)
    f = np.concatenate([f, f[0] ^ noise[:300], f[rng.integers(1, 60, 400)] ^ noise[300:]])
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(f.view(np.int64).tolist())] + [(-1, None, None, None, None)], "node long, f0 long, f1 long, f2 long, f3 long")
    got = {r.node: r.root for r in components.components(near_copies.proposed(d.repartition(3), limit)).collect()}
    values = near_copies.block_values(f, *near_copies.blocks_for(len(f)))
    root = list(range(len(f)))
    for a, b in itertools.combinations(range(len(f)), 2):
        if root[a] != root[b] and np.bitwise_count(f[a, :3] ^ f[b, :3]).sum() <= near_copies.RADIUS and (values[a] == values[b]).any():
            x, y = sorted((root[a], root[b]))
            root = [x if r == y else r for r in root]
    assert {i: got.get(i, i) for i in range(len(f))} == dict(enumerate(root)) and -1 not in got
    assert 440 < len(set(root)) < 560


def test_stage_takes_its_pairs_from_the_index(spark, monkeypatch):
    """Without the index's links no near copy is found: nothing else proposes pairs."""
    rng = random.Random(4)
    w = [f"w{rng.random()}" for _ in range(200)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:100], "edited", *w[101:]])), (3, " ".join(reversed(w)))]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_copies.keep_one(d).collect()) == [1, 3]
    index = near_copies.proposed
    monkeypatch.setattr(near_copies, "proposed", lambda nodes: index(nodes).limit(0))
    assert sorted(r.doc_id for r in near_copies.keep_one(d).collect()) == [1, 2, 3]


def test_links_of_a_large_group_are_shortened(spark):
    """2,000 near copies, a link a block for each: the components stay, and little more than a link a member is left."""
    rng = np.random.default_rng(9)
    f = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64) ^ np.packbits(rng.random((2000, 256)) < 0.05, axis=1).view(np.uint64)
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(f.view(np.int64).tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
    links = near_copies.proposed(d.repartition(3)).persist()
    near = links.groupBy("a").agg(F.array_sort(F.collect_set("b")).alias("bs"))
    short = near_copies.shortened(near).persist()
    assert links.distinct().count() > 20_000 and short.count() < 4000 and short.where("a <= b").count() == 0
    root = {r.node: r.root for r in components.components(links).collect()}
    assert {r.node: r.root for r in components.components(short).collect()} == root and len(root) > 1990


def test_only_frequent_nodes_are_counted(spark, monkeypatch):
    """Among fingerprints with nothing in common none is counted; a node over the limit is, wherever its rows lie, and keeps its links."""
    rng, rows, settle = np.random.default_rng(12), {}, near_copies.settle

    def counted(d, name):
        out = settle(d, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(near_copies, "settle", counted)
    f = rng.integers(0, 1 << 63, (9000, 4), dtype=np.uint64) ^ (rng.integers(0, 2, (9000, 4), dtype=np.uint64) << np.uint64(63))
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(f.view(np.int64).tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
    assert near_copies.proposed(d.repartition(6), 2000).count() == 0 and rows == {"frequent": 0}
    f[::3] = f[0] ^ np.packbits(rng.random((3000, 256)) < 0.01, axis=1).view(np.uint64)
    d = spark.createDataFrame([(i, *x) for i, x in enumerate(f.view(np.int64).tolist())], "node long, f0 long, f1 long, f2 long, f3 long")
    values, size = np.unique(near_copies.block_values(f, *near_copies.blocks_for(len(f))), return_counts=True)
    for spread in (d.repartition(6), d.repartitionByRange(6, F.pmod("node", F.lit(3)), "node")):
        rows.clear()
        got = components.components(near_copies.proposed(spread, 2000)).where("root = 0").count()
        assert rows["crowded"] == (size > 2000).sum() > 0 and rows["crowded"] <= rows["frequent"] < len(values) / 10
        assert got == 3000


def test_components_end_once_all_links_lead_to_roots(spark, monkeypatch):
    """Links that lead to roots take no round; paths, rings, repeated links and loops match a walk over all links."""
    rounds, settle = [], components.settle
    monkeypatch.setattr(components, "settle", lambda d, name: rounds.append(name) or settle(d, name))
    found = lambda links: {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found([(i, i % 7) for i in range(7, 200)]) == {i: i % 7 for i in range(200)} and len(rounds) == 1
    assert found([]) == {} and len(rounds) == 2
    rng = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(100 + i, 100 + (i + 1) % 30) for i in range(30)] + [(rng.randrange(200, 500), rng.randrange(200, 500)) for _ in range(170)] + [(700, 700)]
    root = {x: x for a, b in links if a != b for x in (a, b)}
    for a, b in links:
        if a != b and root[a] != root[b]:
            x, y = sorted((root[a], root[b]))
            root = {k: x if r == y else r for k, r in root.items()}
    assert found(links + links[:40]) == root
