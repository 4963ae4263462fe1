"""Hard negatives: the best-scored rows of other labels within a window below each positive, found block by block.

Rows are put in the order of a Hilbert curve over the dimensions that vary most and written as Parquet blocks of up to BLOCK rows with
the least and greatest component of each dimension. Of an anchor and a block, interval arithmetic gives the least and greatest score
that any row can have: a block is read for a search only if these bounds meet the search's window, its labels can match, and the
greatest score is not below the k-th best one known. Each search goes in two rounds: its most promising blocks first, then all others
that the bounds, with the k-th score found so far, can't exclude. So nothing is left out; loose bounds only cost reading.

Anchors are a stated set, one row in ANCHOR_EVERY: batches of them meet blocks, one batch and one block in a task at a time, and all
that is sent of a block's rows is each search's k best. Copies of one vector, however many, are spread over blocks by vec_id.

Rows without vec_id, label or vector, or with a null or non-finite component, take no part. Missing components of a shorter vector
count as 0, components beyond the 32-bit range as its end. Identical rows count once; other rows of one vec_id are rows of their own,
but none of an anchor's vec_id is its positive. An empty table, or one without anchors, gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import settle
from loomgraph.operators.ranks import numbered

SCALE, ANCHOR_EVERY, POSITIVES, NEGATIVES = 256, 100, 5, 10
#: A window below a positive's score, in tenths.
LOW, HIGH = 3, 9
BLOCK, BATCH, PAGE = 2048, 512, 1024
#: Dimensions and bits of the curve, and how many blocks of a page a search reads first.
CURVE, BITS, SEEDS = 16, 4, 2
NONE = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places (uint64) on a Hilbert curve of rows of cells, one column a dimension, each under 2 ** bits; dimensions times bits is 64 at most."""
    x = cells.T.astype(np.uint64).copy()
    q = np.uint64(1 << (bits - 1))
    while q > 1:  # undo the turns of the sub-cubes, from the largest
        low = q - np.uint64(1)
        for i in range(len(x)):
            inside = (x[i] & q) > 0
            swap = np.where(inside, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(inside, low, swap)
            x[i] ^= swap
        q >>= np.uint64(1)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn, q = np.zeros(x.shape[1], np.uint64), np.uint64(1 << (bits - 1))
    while q > 1:
        turn ^= np.where((x[-1] & q) > 0, q - np.uint64(1), np.uint64(0))
        q >>= np.uint64(1)
    x ^= turn
    place = np.zeros(x.shape[1], np.uint64)
    for b in reversed(range(bits)):
        for row in x:
            place = (place << np.uint64(1)) | ((row >> np.uint64(b)) & np.uint64(1))
    return place


def quantised(rows: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; v: floor(SCALE * x) of each component."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    d = rows.select("vec_id", "label", x.alias("x")).where("vec_id is not null and label is not null and x is not null")
    d = d.where(F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("long")
    v = F.transform("x", lambda c: F.least(F.greatest(F.floor(c * SCALE).cast("double"), F.lit(-(2.0**31))), F.lit(2.0**31 - 1)).cast("int"))
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), v.alias("v"))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Lists as rows of a matrix, short ones filled with 0."""
    counts = np.asarray(vectors.value_lengths())
    m = np.zeros((len(counts), int(counts.max(initial=0))), np.int32)
    m[np.repeat(np.arange(len(counts)), counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)] = np.asarray(vectors.flatten())
    return m


BLOCKS = "block long, rows int, width int, ids binary, labels binary, vectors binary, low binary, high binary, least_label long, most_label long"


def _packed_block(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> dict[str, Any]:
    order = np.lexsort((labels, ids))  # columns in the order of ids, which settles ties
    ids, labels, vectors = ids[order], labels[order], vectors[order]
    return {"block": number, "rows": len(ids), "width": vectors.shape[1], "ids": ids.tobytes(), "labels": labels.tobytes(), "vectors": vectors.tobytes(), "low": vectors.min(0).tobytes(), "high": vectors.max(0).tobytes(), "least_label": int(labels.min()), "most_label": int(labels.max())}


def blocks_of(rows: DataFrame) -> DataFrame:
    """Blocks of quantised rows in curve order, written to the shared folder with their zone maps."""
    stats = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))
    stats = {r["d"]: (r["mean"], r["sd"]) for r in stats.collect()}  # one row for each dimension
    used = sorted(sorted(stats, key=lambda d: (-stats[d][1], d))[:CURVE])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = _matrix(b.column("v"))
            cells = np.zeros((len(m), max(1, len(used))), np.uint64)
            for k, d in enumerate(used):
                if d < m.shape[1]:
                    mean, sd = stats[d]
                    cells[:, k] = np.clip((m[:, d] - mean + 2 * sd) / (4 * sd or 1) * 2**BITS, 0, 2**BITS - 1).astype(np.uint64)
            key = (hilbert(cells) ^ np.uint64(1 << 63)).view(np.int64)  # in the order of signed numbers
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(key)], [*b.schema.names, "place"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, n = TaskContext.get().partitionId() << 33, [], 0
        kinds = pa.schema([("block", pa.int64()), ("rows", pa.int32()), ("width", pa.int32()), *[(c, pa.binary()) for c in ("ids", "labels", "vectors", "low", "high")], ("least_label", pa.int64()), ("most_label", pa.int64())])
        last: tuple[int, int, bytes] | None = None

        def flush(parts: list) -> pa.RecordBatch:  # noqa: ANN001
            t = pa.Table.from_batches(parts).combine_chunks()
            return pa.RecordBatch.from_pylist([_packed_block(number, t.column("vec_id").to_numpy(), t.column("label").to_numpy(), _matrix(t.column("v").combine_chunks()))], kinds)

        for b in batches:
            m, ids, labels = _matrix(b.column("v")), np.asarray(b.column("vec_id")), np.asarray(b.column("label"))
            if not len(ids):
                continue
            new = np.ones(len(ids), bool)
            lengths = np.asarray(b.column("v").value_lengths())
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (lengths[1:] != lengths[:-1]) | (m[1:] != m[:-1]).any(1)
            first = (int(ids[0]), int(labels[0]), m[0, : lengths[0]].tobytes())
            new[0] = first != last
            last = (int(ids[-1]), int(labels[-1]), m[-1, : lengths[-1]].tobytes())
            b = b.filter(pa.array(new))
            while len(b):
                held.append(b.slice(0, BLOCK - n))
                n, b = n + len(held[-1]), b.slice(BLOCK - n)
                if n == BLOCK:
                    yield flush(held)
                    number, held, n = number + 1, [], 0
        if n:
            yield flush(held)

    placed = rows.mapInArrow(place, "vec_id long, label long, v array<int>, place long")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sort = ["place", "vec_id", "label", "v"]
    return settle(placed.repartitionByRange(parts, *sort).sortWithinPartitions(*sort).mapInArrow(pack, BLOCKS), "vector-blocks")


def _vectors(row: dict[str, Any]) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int32).reshape(row["rows"], row["width"])


def anchors_of(blocks: DataFrame) -> DataFrame:
    """(n, batch, anchor_id, label, v) of the anchors, numbered along the curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(len(b)):
                row = b.slice(k, 1).to_pylist()[0]
                ids, labels, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), _vectors(row)
                at = np.flatnonzero(ids % ANCHOR_EVERY == 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"])), pa.array(at), pa.array(ids[at]), pa.array(labels[at]), pa.array([v[i].tobytes() for i in at], pa.binary())], ["block", "at", "anchor_id", "label", "v"])

    d = numbered(blocks.mapInArrow(run, "block long, at long, anchor_id long, label long, v binary"), [], ["block", "at"])
    return settle(d.select("n", F.floor((F.col("n") - 1) / BATCH).alias("batch"), "anchor_id", "label", "v"), "anchors")


def _padded(values: list[bytes]) -> np.ndarray:
    rows = [np.frombuffer(v, np.int32) for v in values]
    m = np.zeros((len(rows), max((len(r) for r in rows), default=0)), np.int32)
    for i, r in enumerate(rows):
        m[i, : len(r)] = r
    return m


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers: by floating point where that is exact."""
    w = min(a.shape[1], b.shape[1])
    a, b = a[:, :w], b[:, :w]
    top = float(np.abs(a.astype(np.float64)).max(initial=0)) * float(np.abs(b.astype(np.float64)).max(initial=0)) * w
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if top < 2**53 else a.astype(np.int64) @ b.astype(np.int64).T


def _bounds(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest scores of anchors (rows of a) in blocks (rows of low and high)."""
    plus, minus = np.maximum(a, 0), np.minimum(a, 0)
    return _product(plus, low) + _product(minus, high), _product(plus, high) + _product(minus, low)


def choose(requests: DataFrame, zones: DataFrame, pages: int, seeds: bool) -> DataFrame:
    """(batch, block, picks): for each batch of requests (n, p, batch, label, v, same, lo, hi, t) the blocks to read and the requests to read them for.

    seeds: the SEEDS most promising blocks of each page; else all others that the bounds, with the k-th score t known, can't exclude.
    """

    def run(req: pa.Table, zone: pa.Table) -> pa.Table:
        if not len(req) or not len(zone):
            return pa.table({"batch": pa.array([], pa.int64()), "block": pa.array([], pa.int64()), "picks": pa.array([], pa.binary())})
        col = {c: req.column(c).to_numpy(zero_copy_only=False) for c in ("n", "p", "label", "same", "lo", "hi", "t")}
        wide = pa.concat_tables([zone]).sort_by("block")
        low, high = (_padded(wide.column(c).to_pylist()) for c in ("low", "high"))
        # a zone shorter than another has no component there, so 0
        lb, ub = _bounds(_padded(req.column("v").to_pylist()), low, high)
        least, most = (wide.column(c).to_numpy()[None, :] for c in ("least_label", "most_label"))
        label, same = col["label"][:, None], col["same"][:, None]
        can = np.where(same, (least <= label) & (label <= most), ~((least == label) & (most == label)))
        can &= (ub >= col["lo"][:, None]) & (lb <= col["hi"][:, None])
        # the blocks read first are those of the greatest bounds, in both rounds found in the same way
        rank = np.argsort(np.argsort(np.where(can, -ub, np.iinfo(np.int64).max), axis=1, kind="stable"), axis=1, kind="stable")
        hit = can & (rank < SEEDS) if seeds else can & (rank >= SEEDS) & (ub >= col["t"][:, None])
        names, key, out = wide.column("block").to_numpy(), np.stack([col["n"], col["p"]], 1).astype(np.int64), []
        for k in np.flatnonzero(hit.any(0)):
            out.append((int(names[k]), key[hit[:, k]].tobytes()))
        return pa.table({"batch": pa.array([req.column("batch")[0].as_py()] * len(out), pa.int64()), "block": pa.array([b for b, _ in out], pa.int64()), "picks": pa.array([x for _, x in out], pa.binary())})

    every = F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page")
    batches = requests.agg(F.max("batch")).first()[0]
    z = zones.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(batches or 0).cast("long"))).alias("batch"))
    return requests.select("*", every).groupBy("batch", "page").cogroup(z.groupBy("batch", "page")).applyInArrow(run, "batch long, block long, picks binary")


def _best(score: np.ndarray, ok: np.ndarray, k: int) -> list[np.ndarray]:
    """Columns of each row's k best scores among those that are ok, the best first, ties by column."""
    out, columns = [], score.shape[1]
    if np.abs(score).max(initial=0) < 2**50:
        key = np.where(ok, score * columns - np.arange(columns), NONE)
        if k < columns:
            top = np.argpartition(key, columns - k, axis=1)[:, columns - k :]
        else:
            top = np.tile(np.arange(columns), (len(key), 1))
        for i, t in enumerate(top):
            t = t[key[i, t] > NONE]
            out.append(t[np.argsort(-key[i, t])])
        return out
    for i in range(len(score)):
        t = np.flatnonzero(ok[i])
        out.append(t[np.lexsort((t, -score[i, t]))][:k])
    return out


def scan(picked: DataFrame, requests: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(n, p, score, id, label): of each request the k best rows of each block that it reads, within its window and sense."""
    packs = requests.groupBy("batch").agg(F.collect_list(F.struct("n", "p", "anchor_id", "label", "v", "same", "lo", "hi")).alias("reqs"))  # BATCH anchors at most

    def run(t: pa.Table) -> pa.Table:
        cols = {c: [] for c in ("n", "p", "score", "id", "label")}
        for r in range(len(t)):
            row = t.slice(r, 1).to_pylist()[0]
            wanted = {tuple(x) for x in np.frombuffer(row["picks"], np.int64).reshape(-1, 2).tolist()}
            reqs = [q for q in row["reqs"] if (q["n"], q["p"]) in wanted]
            ids, labels, m = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), _vectors(row)
            for at in range(0, len(reqs), BATCH):
                part = reqs[at : at + BATCH]
                score = _product(_padded([q["v"] for q in part]), m)
                f = lambda c: np.array([q[c] for q in part])[:, None]  # noqa: E731, B023
                ok = (f("same") == (f("label") == labels)) & (ids != f("anchor_id")) & (score >= f("lo")) & (score <= f("hi"))
                for q, best, s in zip(part, _best(score, ok, k), score, strict=True):
                    for c, v in (("n", [q["n"]] * len(best)), ("p", [q["p"]] * len(best)), ("score", s[best].tolist()), ("id", ids[best].tolist()), ("label", labels[best].tolist())):
                        cols[c] += v
        return pa.table({c: pa.array(v, pa.int64()) for c, v in cols.items()})

    d = picked.join(packs, "batch").join(blocks.select("block", "rows", "width", "ids", "labels", "vectors"), "block")
    return d.groupBy("block", "batch").applyInArrow(run, "n long, p long, score long, id long, label long")


def search(requests: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """(n, p, rank, id, score): the k best rows of each request (n, p, batch, anchor_id, label, v, same, lo, hi) over all blocks."""
    pages = -(-blocks.count() // PAGE)
    zones = numbered(blocks.select("block", "low", "high", "least_label", "most_label"), [], ["block"], "place")
    zones = settle(zones.withColumn("page", F.floor((F.col("place") - 1) / PAGE).cast("int")).drop("place"), "zones")
    order = Window.partitionBy("n", "p").orderBy(F.desc("score"), "id", "label")

    def top(d: DataFrame) -> DataFrame:
        return d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = settle(top(scan(choose(requests.withColumn("t", F.lit(int(NONE))), zones, pages, True), requests, blocks, k)), "best")
    kth = first.where(F.col("rank") == k).select("n", "p", F.col("score").alias("t"))
    known = settle(requests.join(kth, ["n", "p"], "left").withColumn("t", F.coalesce("t", F.lit(int(NONE)))), "requests")
    rest = scan(choose(known, zones, pages, False), known, blocks, k)
    return settle(top(first.drop("rank").unionByName(rest)).select("n", "p", "rank", "id", "score"), "best")


def mine(rows: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of all anchors of rows (vec_id, embedding, label)."""
    blocks = blocks_of(quantised(rows))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    anchors = anchors_of(blocks)
    if anchors.isEmpty():
        return rows.sparkSession.createDataFrame([], schema)
    whole = {"lo": F.lit(int(NONE) + 1), "hi": F.lit(int(np.iinfo(np.int64).max))}
    positives = search(anchors.withColumns({"p": F.lit(0).cast("long"), "same": F.lit(True), **whole}), blocks, POSITIVES)
    positives = positives.select("n", F.col("rank").cast("long").alias("p"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # HIGH and LOW tenths of the score, rounded into the window; a window with nothing in it is not searched
    window = {"lo": F.expr(f"-((-{LOW} * positive_score - pmod(-{LOW} * positive_score, 10)) div 10)"), "hi": F.expr(f"({HIGH} * positive_score - pmod({HIGH} * positive_score, 10)) div 10")}
    asked = settle(anchors.join(positives, "n").withColumns({"same": F.lit(False), **window}).where("lo <= hi"), "windows")
    found = search(asked.drop("positive_id", "positive_score"), blocks, NEGATIVES)
    named = asked.select("n", "p", "anchor_id", "positive_id", "positive_score")
    return named.join(found, ["n", "p"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


report = mine

SQL = f"""WITH V AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 P AS (SELECT a.vec_id AS a, a.label AS l, b.vec_id AS b, b.label AS m, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS s FROM V a JOIN V b ON a.vec_id <> b.vec_id WHERE a.vec_id % {ANCHOR_EVERY} = 0),
 Y AS (SELECT * FROM (SELECT a, b AS p, s AS ps, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM P WHERE l = m) WHERE n <= {POSITIVES}),
 Z AS (SELECT Y.a, Y.p, Y.ps, P.b, P.s, row_number() OVER (PARTITION BY Y.a, Y.p ORDER BY P.s DESC, P.b) AS n FROM Y JOIN P ON Y.a = P.a AND P.l <> P.m AND {10 * LOW} * ps <= 100 * s AND 100 * s <= {10 * HIGH} * ps)
 SELECT a AS anchor_id, p AS positive_id, CAST(n AS INTEGER) AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM Z WHERE n <= {NEGATIVES}"""
