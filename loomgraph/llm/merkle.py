"""Merkle manifest of a table of documents, its trees stored in van Emde Boas order.

Leaves are numbered within their source (`ranks.numbered`), so a source's tree is cut into aligned subtrees of RUN ** DEPTH leaves: a
block is one row, its nodes one binary column in van Emde Boas order. A tree of L levels is its top L // 2 levels, then the subtrees
below them one behind another, each laid out in the same way: wherever a cache line or a page ends, a path from leaf to root crosses
few of them. The blocks' roots are the leaves of the next layer, until a source has one root; the sources' roots then go through the
same layers as one tree. Proofs go the other way: a layer's siblings are found in its blocks by address, what lies above a block comes
from the layer over it. Every step is grouped by (source, block), a bounded group, so a source with a third of all rows is spread.

Null values count as `-`, a null doc_id comes first in its source and is never tampered with, a null source is a source of its own,
first of all. Rows of one doc_id and source come by their leaf; repeated rows are leaves of their own, with one proof each. An empty
table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, settle
from loomgraph.operators.ranks import numbered

#: Nodes of a run, levels of runs in a block (so RUN ** DEPTH leaves), bytes of a digest.
RUN, DEPTH, BYTES = 16, 3, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Every how manieth crc32 of a doc_id is tampered with.
TAMPERED = 5


def digest(values: list[Column]) -> Column:
    """The binary sha256 of values, each as its UTF-8 bytes' number, `:` and itself, or `-` for null."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def size(levels: int) -> int:
    """Nodes of a complete tree."""
    return (RUN**levels - 1) // (RUN - 1)


def address(levels: int, depth: int, i: np.ndarray) -> np.ndarray:
    """Places in the van Emde Boas order of a complete tree with so many levels of its i-th nodes at a depth (0: the root)."""
    at = np.zeros(len(i), np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
        else:
            below = RUN ** (depth - top)
            at += size(top) + (i // below) * size(levels - top)
            i, depth, levels = i % below, depth - top, levels - top
    return at


def levels_of(n: int) -> int:
    """Levels of the block of a tree of n leaves: all that a block can have if there are several."""
    levels = 1
    while levels <= DEPTH and RUN ** (levels - 1) < n:
        levels += 1
    return levels


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _runs(level: list[str]) -> list[str]:
    return ["".join(level[k : k + RUN]) for k in range(0, len(level), RUN)]


def _stored(t: pa.Table) -> pa.Table:
    """One block's row (key, block, n, count, nodes, root) of its leaves (key, n, block, i, h); n: leaves of the whole tree."""
    order = np.argsort(t.column("i").to_numpy())
    n, count = t.column("n")[0].as_py(), len(order)
    levels = levels_of(n)
    hashes = t.column("h").to_pylist()
    level = [hashes[k].hex() for k in order]
    nodes = np.zeros((size(levels), BYTES), np.uint8)
    for depth in range(levels - 1, -1, -1):
        nodes[address(levels, depth, np.arange(len(level)))] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, BYTES)
        level = [_hash(r) for r in _runs(level)] if depth else level
    return pa.table({"key": t.column("key").slice(0, 1).combine_chunks(), "block": t.column("block").slice(0, 1).combine_chunks(), "n": [n], "count": [count], "nodes": pa.array([nodes.tobytes()], pa.binary()), "root": pa.array([bytes.fromhex(level[0])], pa.binary())})


def blocks_of(leaves: DataFrame) -> DataFrame:
    """Stored blocks (key, block, n, count, nodes, root) of leaves (key, n, i from 0, h)."""
    d = leaves.select("key", "n", F.floor(F.col("i") / RUN**DEPTH).alias("block"), "i", "h")
    return d.groupBy("key", "block").applyInArrow(_stored, f"key {d.schema['key'].dataType.simpleString()}, block long, n long, count long, nodes binary, root binary")


def layers(leaves: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """All layers of blocks of the trees of leaves (key, n, i, h), each written to the shared folder, and (key, root) of all trees."""
    out, roots = [], None
    while True:
        out.append(settle(blocks_of(leaves), "blocks"))
        done = out[-1].where(F.col("n") <= RUN**DEPTH).select("key", "root")
        roots = done if roots is None else roots.unionByName(done)
        leaves = out[-1].where(F.col("n") > RUN**DEPTH).select("key", F.ceil(F.col("n") / RUN**DEPTH).alias("n"), F.col("block").alias("i"), F.col("root").alias("h"))
        if leaves.isEmpty():
            return out, roots


def _levels(block: pa.Table) -> list[list[str]]:
    """Digests of a stored block by level, leaves first, read by their addresses."""
    n, count = block.column("n")[0].as_py(), block.column("count")[0].as_py()
    nodes, levels, out = np.frombuffer(block.column("nodes")[0].as_py(), np.uint8).reshape(-1, BYTES), levels_of(n), []
    for depth in range(levels - 1, -1, -1):
        text = nodes[address(levels, depth, np.arange(count))].tobytes().hex()
        out.append([text[k : k + 2 * BYTES] for k in range(0, len(text), 2 * BYTES)])
        count = -(-count // RUN)
    return out


def _siblings(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """What lies left and right of leaf i's path in its runs, level by level, up to the block's root."""
    out = []
    for level in levels[:-1]:
        k = i - i % RUN
        out.append(("".join(level[k:i]), "".join(level[i + 1 : k + RUN])))
        i //= RUN
    return out


def _packed(path: list[tuple[str, str]]) -> tuple[bytes, bytes]:
    """A path as a byte for each level (digests to the left times RUN plus those to the right) and all digests."""
    return bytes(len(a) // (2 * BYTES) * RUN + len(b) // (2 * BYTES) for a, b in path), bytes.fromhex("".join(a + b for a, b in path))


def _unpacked(shape: bytes, digests: bytes) -> list[tuple[str, str]]:
    text, at, out = digests.hex(), 0, []
    for s in shape:
        a, b = (2 * BYTES * x for x in divmod(s, RUN))
        out.append((text[at : at + a], text[at + a : at + a + b]))
        at += a + b
    return out


def _fold(h: str, path: list[tuple[str, str]]) -> str:
    for a, b in path:
        h = _hash(a + h + b)
    return h


def _descend(leaves: DataFrame, blocks: DataFrame, answer: Callable, schema: str) -> DataFrame:  # noqa: ANN001
    """answer(leaves of a block, its levels, the path above it) for each block; leaves (key, block, j, ...), blocks with shape and digests."""

    def run(mine: pa.Table, block: pa.Table) -> pa.Table:
        above = _unpacked(block.column("shape")[0].as_py(), block.column("digests")[0].as_py())
        return answer(mine, _levels(block), above)

    return leaves.groupBy("key", "block").cogroup(blocks.groupBy("key", "block")).applyInArrow(run, schema)


def paths(built: list[DataFrame], top: DataFrame) -> DataFrame:
    """The lowest layer's blocks with shape and digests, the packed path from their root to the top; top: (key, shape, digests) above each tree."""
    kind, above = built[0].schema["key"].dataType.simpleString(), None

    def answer(mine: pa.Table, levels: list[list[str]], rest: list[tuple[str, str]]) -> pa.Table:
        out = [_packed(_siblings(levels, j) + rest) for j in mine.column("j").to_pylist()]
        return pa.table({"key": mine.column("key"), "i": mine.column("i"), "shape": pa.array([a for a, _ in out], pa.binary()), "digests": pa.array([b for _, b in out], pa.binary())})

    for k in reversed(range(len(built))):
        whole = built[k].where(F.col("n") <= RUN**DEPTH)
        d = whole.join(top.withColumnRenamed("key", "__key"), F.col("key").eqNullSafe(F.col("__key"))).drop("__key")
        if above is not None:
            over = above.select(F.col("key").alias("__key"), F.col("i").alias("__i"), "shape", "digests")
            d = d.unionByName(built[k].join(over, F.col("key").eqNullSafe(F.col("__key")) & (F.col("block") == F.col("__i"))).drop("__key", "__i"))
        if k:
            roots = built[k - 1].where(F.col("n") > RUN**DEPTH)  # they are this layer's leaves
            nodes = roots.select("key", F.floor(F.col("block") / RUN**DEPTH).alias("block"), (F.col("block") % RUN**DEPTH).alias("j"), F.col("block").alias("i"))
            above = settle(_descend(nodes, d, answer, f"key {kind}, i long, shape binary, digests binary"), "paths")
    return d


def manifest(docs: DataFrame, altered: Column | None = None, when: Column | None = None) -> tuple[DataFrame, list[DataFrame], DataFrame, list[DataFrame]]:
    """(leaves, blocks, sources, top): leaves (doc_id, key, i, h and, where `when` holds, tampered: the leaf with the text `altered`), the layers of the
    sources' trees, sources (key, i, root), and the layers of the tree over them. Texts never leave the scan: only digests are shuffled."""
    c = {f: F.col(f) for f in FIELDS}
    h = digest([c[f] for f in FIELDS])
    other = F.when(when, digest([*[c[f] for f in FIELDS[:-1]], altered])) if when is not None else F.lit(None).cast("binary")
    rows = numbered(docs.select(F.col("doc_id"), F.col("source").alias("key"), h.alias("h"), other.alias("tampered")), ["key"], ["doc_id", "h"], "place")
    leaves = settle(rows.select("doc_id", "key", (F.col("place") - 1).alias("i"), "h", "tampered"), "leaves")
    counts = leaves.groupBy(F.col("key").alias("__key")).agg(F.count("*").alias("n"))
    blocks, roots = layers(leaves.join(counts, F.col("key").eqNullSafe(F.col("__key"))).select("key", "n", "i", "h"))
    sources = settle(numbered(roots, [], ["key"], "place").select("key", (F.col("place") - 1).alias("i"), "root"), "sources")
    n = sources.count()
    top, _ = layers(sources.select(F.lit("").alias("key"), F.lit(n).cast("long").alias("n"), "i", F.col("root").alias("h"))) if n else ([], None)
    return leaves, blocks, sources, top


def report(docs: DataFrame) -> DataFrame:
    """Per row its leaf, subroot, the root, its proof's digest, and the root that its siblings fold a tampered (else its own) leaf to."""
    tampered = F.crc32(F.col("doc_id").cast("string")) % TAMPERED == 0
    leaves, blocks, sources, top = manifest(docs, ascii_lower(F.col("text")), tampered)
    schema = "doc_id {}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean".format(docs.schema["doc_id"].dataType.simpleString())
    if not top:
        return docs.sparkSession.createDataFrame([], schema)
    root = top[-1].select("root").first()[0].hex()
    empty = docs.sparkSession.createDataFrame([("", b"", b"")], "key string, shape binary, digests binary")
    # the tree over the sources: the path above each source's root
    under = paths(top, empty)
    nodes = sources.select(F.lit("").alias("key"), F.floor(F.col("i") / RUN**DEPTH).alias("block"), (F.col("i") % RUN**DEPTH).alias("j"), F.col("key").alias("source"))

    def over(mine: pa.Table, levels: list[list[str]], rest: list[tuple[str, str]]) -> pa.Table:
        out = [_packed(_siblings(levels, j) + rest) for j in mine.column("j").to_pylist()]
        return pa.table({"key": mine.column("source"), "shape": pa.array([a for a, _ in out], pa.binary()), "digests": pa.array([b for _, b in out], pa.binary())})

    above = settle(_descend(nodes, under, over, "key string, shape binary, digests binary"), "paths")
    # the sources' own trees
    low = paths(blocks, above).join(sources.select(F.col("key").alias("__key"), F.col("root").alias("subroot")), F.col("key").eqNullSafe(F.col("__key"))).select("key", "block", "n", "count", "nodes", "shape", "digests", "subroot")
    rows = leaves.select("key", F.floor(F.col("i") / RUN**DEPTH).alias("block"), (F.col("i") % RUN**DEPTH).alias("j"), "doc_id", "h", "tampered")

    def prove(mine: pa.Table, block: pa.Table) -> pa.Table:
        rest = _unpacked(block.column("shape")[0].as_py(), block.column("digests")[0].as_py())
        levels, tail, out, known = _levels(block), "".join(a + b for a, b in rest), [], {}
        for j, h, t in zip(mine.column("j").to_pylist(), mine.column("h").to_pylist(), mine.column("tampered").to_pylist(), strict=True):
            path = _siblings(levels, j)
            got = _fold((h if t is None else t).hex(), path)
            if got not in known:  # the same node folds to the same root
                known[got] = _fold(got, rest)
            out.append((h.hex(), _hash("".join(a + b for a, b in path) + tail), known[got]))
        leaf, proof, folded = (list(x) for x in zip(*out, strict=True))
        n, sub = len(leaf), block.column("subroot")[0].as_py().hex()
        return pa.table({"doc_id": mine.column("doc_id"), "leaf": leaf, "subroot": [sub] * n, "root": [root] * n, "proof_sha256": proof, "folded_root": folded, "verified": [f == root for f in folded]})

    return rows.groupBy("key", "block").cogroup(low.groupBy("key", "block")).applyInArrow(prove, schema)


def _sql(levels: int = 9) -> str:
    """The same rows in SQL, for sources of up to RUN ** (levels - 1) documents."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(enc(c) for c in FIELDS[:-1]) + f" || {enc(text)})"
    # a CRC step for each byte (its value) and each of its bits (-1)
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    crc = f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {bits}), lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, CAST(3988292384 AS BIGINT)) ELSE a >> 1 END), CAST(4294967295 AS BIGINT))"
    lower = f"translate(text, '{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}')"
    ctes = [f"D AS (SELECT row_number() OVER () AS r, doc_id, source, {leaf('text')} AS leaf, CASE WHEN ({crc}) % {TAMPERED} = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS cur0 FROM documents)"]

    def tree(name: str, first: str) -> str:
        """Levels name_0 (g, i, h) up to the one where each g has one node."""
        ctes.append(f"{name}0 AS ({first})")
        for k in range(1, levels):
            ctes.append(f"{name}{k} AS (SELECT g, i // {RUN} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k - 1}) GROUP BY g, i // {RUN})")
        return f"{name}{levels - 1}"

    def climb(name: str, start: str, cur: str) -> str:
        """Rows of start (r, g, i, cur, sib) with cur folded and siblings added, level by level."""
        ctes.append(start)
        at = cur
        for k in range(levels - 1):
            side = f"SELECT g, i // {RUN} AS p, list({{'i': i, 'h': h}} ORDER BY i) AS run, any_value(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}) GROUP BY g, i // {RUN}"
            left, right = (f"coalesce(array_to_string(list_transform(list_filter(s.run, lambda x: x.i {op} c.i), lambda x: x.h), ''), '')" for op in "<>")
            ctes.append(f"{cur}_{k} AS (SELECT c.r, c.g, c.i // {RUN} AS i, CASE WHEN s.n = 1 THEN c.cur ELSE sha256({left} || c.cur || {right}) END AS cur, c.sib || {left} || {right} AS sib FROM {at} c JOIN ({side}) s ON c.g = s.g AND c.i // {RUN} = s.p)")
            at = f"{cur}_{k}"
        return at

    # rows of a source have a number g, the sources' tree is one group
    ctes.append("O AS (SELECT *, dense_rank() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM D)")
    sub = tree("A", "SELECT g, i, leaf AS h FROM O")
    root = tree("B", f"SELECT 0 AS g, g AS i, h FROM {sub}")
    one = climb("A", "P AS (SELECT r, g, i, cur0 AS cur, '' AS sib FROM O)", "P")
    two = climb("B", f"Q AS (SELECT r, 0 AS g, g AS i, cur, sib FROM {one})", "Q")
    return f"WITH {', '.join(ctes)} SELECT O.doc_id, O.leaf, S.h AS subroot, R.h AS root, sha256(q.sib) AS proof_sha256, q.cur AS folded_root, q.cur = R.h AS verified FROM O JOIN {two} q ON q.r = O.r JOIN {sub} S ON S.g = O.g JOIN {root} R ON TRUE"


SQL = _sql()
