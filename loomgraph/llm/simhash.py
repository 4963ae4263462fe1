"""Weighted SimHash fingerprints of 128 bits and their search by permuted block tables; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm.common import bit_votes, hex16, majority, settle, shingles, words

WIDTH = 3
#: A term (a shingle) of more bytes than this votes twice: it holds fewer function words.
LONG_TERM = 14
#: Splits of the doc_id range, for next_keys.
SPLITS = 64
#: report counts fingerprints within this Hamming radius, for rows whose doc_id is divisible by QUERY_STEP.
RADIUS, QUERY_STEP = 3, 20
#: Members that a cell of a block's bucket has on average at most.
CELL = 1024


def votes(texts: DataFrame, keys: list[str], width: int = WIDTH) -> DataFrame:
    """keys and the 128 bits (hi, lo) of column text: each term's two hashes vote on the signed bits with the term's weight."""
    d = texts.select(*keys, F.explode_outer(shingles(words(F.col("text")), width)).alias("s")).select(*keys, "s.*")
    term = [f"s{i}" for i in range(width)]
    there = F.col("s0").isNotNull()
    weight = F.when(there, 1 + (F.octet_length(F.concat_ws(" ", *term)) > LONG_TERM).cast("int")).otherwise(0)
    d = d.select(*keys, F.xxhash64(*term).alias("h1"), F.xxhash64(F.lit(1), *term).alias("h2"), weight.alias("w"))
    d = d.groupBy(*keys).agg(F.sum("w").alias("total"), *bit_votes("h1", F.col("w"), "a"), *bit_votes("h2", F.col("w"), "b"))
    return d.select(*keys, majority("total", "a").alias("hi"), majority("total", "b").alias("lo"))


def likeness(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return 1 - (F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))) / F.lit(128.0)


def next_keys(keys: DataFrame) -> DataFrame:
    """For distinct rows (doc_id, h, n, copies): the row before each in descending doc_id, then h, nulls last; before the first comes the last.

    Rows are dealt by splits of the doc_id range; only the last row of each range (65 at most) meets the others' ends.
    """
    splits = keys.agg(F.percentile_approx("doc_id", [i / SPLITS for i in range(1, SPLITS)], 10_000)).first()[0] or []
    above = F.filter(F.array(*[F.lit(x) for x in sorted(set(splits))]), lambda s: s >= F.col("doc_id")) if splits else None
    part = F.lit(0) if above is None else F.when(F.col("doc_id").isNull(), SPLITS + 1).otherwise(F.size(above))
    row = F.struct("doc_id", "h", "n", "copies")
    w = Window.partitionBy("part").orderBy(F.desc_nulls_last("doc_id"), "h")
    d = keys.withColumn("part", part).withColumn("before", F.lag(row).over(w)).withColumn("after", F.lead(row).over(w))
    d = settle(d.select("doc_id", "h", "n", "copies", "part", "before", F.col("after").isNull().alias("ends")), "order")
    ends = d.where("ends").select("part", row.alias("last"))
    every = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select("part", F.coalesce(F.lag("last").over(Window.orderBy("part")), F.last("last").over(every)).alias("last"))
    d = d.join(F.broadcast(ends), "part")  # a row for each range
    return d.select("doc_id", "h", F.coalesce("before", "last").alias("before"))


def fingerprint_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document.

    Null texts count as empty; empty texts have fingerprint 0. Rows that repeat doc_id and text are fingerprinted as one document, whose
    next is the next other one; it has one row here, with their number in copies, and as many in report; different texts under one doc_id follow each other in the order
    of their hash; null doc_ids come last. Other columns are not read.
    """
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # k and h name a row without nulls, so that joins and sums by them share one way of dealing rows out
    d = d.select("doc_id", F.coalesce("doc_id", F.lit(0)).alias("k"), F.xxhash64("text", F.col("doc_id").isNull()).alias("h"), F.length("text").alias("n"), "text")
    order = settle(next_keys(d.groupBy("doc_id", "h", "n").agg(F.count("*").alias("copies"))), "next").withColumn("k", F.coalesce("doc_id", F.lit(0)))
    before_k = F.coalesce("before.doc_id", F.lit(0))
    t = d.join(order.select("k", "h", "before"), ["k", "h"]).select("k", "h", "n", "text", "before")
    # reads n as the join below does, so that both share one exchange of the texts
    heads = t.select(before_k.alias("k"), F.col("before.h").alias("h"), F.expr("substring(text, 1, least(n, before.n div 3))").alias("head"))
    heads = heads.dropDuplicates(["k", "h"])
    own = d.join(heads, ["k", "h"]).select("k", "h", "n", "text", F.expr("concat(substring(text, 1, n - n div 3), head)").alias("edited"))
    keys = ["k", "h", "n", "sha"]
    own = own.select("k", "h", "n", F.sha2("edited", 256).alias("sha"), F.explode(F.array(F.struct(F.lit(0).alias("edit"), "text"), F.struct(F.lit(1).alias("edit"), F.col("edited").alias("text")))).alias("t"))
    v = votes(own.select(*keys, "t.edit", "t.text"), [*keys, "edit"])
    both = v.groupBy(*keys).agg(*[F.max(F.when(F.col("edit") == e, F.col(c))).alias(f"{c}{e}") for e in (0, 1) for c in ("hi", "lo")])
    both = settle(both, "votes")
    nxt = order.select(before_k.alias("k"), F.col("before.h").alias("h"), F.col("before.doc_id").alias("doc_id"), F.col("before.copies").alias("copies"), F.col("k").alias("next_k"), F.col("h").alias("next_h"))
    b = both.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("hi0").alias("hi2"), F.col("lo0").alias("lo2"))
    return both.join(nxt, ["k", "h"]).join(b, ["next_k", "next_h"])


def report(docs: DataFrame) -> DataFrame:
    """The columns of fingerprint_pairs for each row, and n_near: how many other rows' fingerprints are within RADIUS bits.

    n_near is counted for rows whose doc_id is divisible by QUERY_STEP, against all rows; it is null for the others and for null doc_ids.
    """
    show = lambda e: F.concat(hex16(F.col(f"hi{e}")), hex16(F.col(f"lo{e}")))
    c = F.col
    d = settle(fingerprint_pairs(docs), "pairs")
    index = d.groupBy(c("hi0").alias("hi"), c("lo0").alias("lo")).agg(F.sum("copies").alias("docs"))
    asked = d.where(c("doc_id") % QUERY_STEP == 0)
    near = count_within(asked.select(c("hi0").alias("hi"), c("lo0").alias("lo")).distinct(), index, RADIUS)
    near = near.select(c("hi").alias("hi0"), c("lo").alias("lo0"), (c("docs") - 1).alias("n_near"), F.lit(True).alias("asked"))
    d = d.withColumn("asked", F.when(c("doc_id") % QUERY_STEP == 0, True)).join(near, ["hi0", "lo0", "asked"], "left")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return d.select(
        "doc_id", F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), show(0).alias("fingerprint"), show(1).alias("edited_fingerprint"),
        likeness(c("hi0"), c("lo0"), c("hi1"), c("lo1")).alias("near_edited"), likeness(c("hi0"), c("lo0"), c("hi2"), c("lo2")).alias("near_next"), "n_near",
    )


def _blocks(radius: int) -> list[tuple[int, int]]:
    """Masks (of hi, of lo) that cut the 128 bits into radius + 1 blocks."""
    cuts = [128 * i // (radius + 1) for i in range(radius + 2)]
    return [(_mask(lo, min(up, 64)), _mask(lo - 64, up - 64)) for lo, up in zip(cuts, cuts[1:], strict=False)]


def block_table(fps: DataFrame, radius: int) -> DataFrame:
    """Each fingerprint (hi, lo, other columns) once for each of radius + 1 blocks of its bits, with the block and its value."""
    keys = []
    for b, masks in enumerate(_blocks(radius)):
        part = [F.col(s).bitwiseAND(F.lit(m)) for s, m in zip(("hi", "lo"), masks, strict=True) if m]
        keys.append(F.struct(F.lit(b).alias("block"), F.xxhash64(*part).alias("value")))
    return fps.select("*", F.explode(F.array(*keys)).alias("k")).select("*", "k.*").drop("k")


def _mask(lo: int, up: int) -> int:
    m = sum(1 << b for b in range(max(lo, 0), max(up, 0)))
    return m - (1 << 64) if m >> 63 else m


def _bits(hi: Column, lo: Column, hi2: Column, lo2: Column) -> Column:
    return F.bit_count(hi.bitwiseXOR(hi2)) + F.bit_count(lo.bitwiseXOR(lo2))


def within(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """All fingerprints of index within the Hamming radius of those of queries, distinct pairs (q_hi, q_lo, hi, lo, bits).

    Of radius + 1 blocks two such fingerprints agree on one, so they meet in that block's table. The pairs grow with what lies
    within the radius: give as queries a stated set, not all rows of a corpus full of copies. Where their number is enough,
    count_within makes no pairs.
    """
    table = lambda fps: block_table(fps.select("hi", "lo").distinct(), radius)
    q = table(queries).select(F.col("hi").alias("q_hi"), F.col("lo").alias("q_lo"), "block", "value")
    d = q.join(table(index), ["block", "value"])
    bits = _bits(F.col("hi"), F.col("lo"), F.col("q_hi"), F.col("q_lo"))
    return d.select("q_hi", "q_lo", "hi", "lo", bits.alias("bits")).where(F.col("bits") <= radius).distinct()


def count_within(queries: DataFrame, index: DataFrame, radius: int) -> DataFrame:
    """(hi, lo, docs): for each of the distinct fingerprints of queries, the sum of docs over those of index within the Hamming radius.

    index: distinct (hi, lo) with their number of documents, docs. Both meet in the block tables; a pair that agrees on several blocks
    counts in the first of them. A block value's members are dealt over cells of about CELL, each one row, and a query meets the
    cells of its values: rows grow with queries times cells, no pair is a row, and no task holds all members of a value.
    """
    members = block_table(index.select("hi", "lo", "docs"), radius)
    asked = block_table(queries.select("hi", "lo"), radius)
    sizes = members.select("block", "value", F.lit(1).alias("m"), F.lit(0).alias("q")).unionByName(asked.select("block", "value", F.lit(0).alias("m"), F.lit(1).alias("q")))
    sizes = sizes.groupBy("block", "value").agg(F.sum("m").alias("m"), F.sum("q").alias("q")).where("m > 0 and q > 0")
    sizes = settle(sizes.select("block", "value", F.ceil(F.col("m") / CELL).alias("cells")), "sizes")
    # a cell's number is one hash, so that rows are dealt by it and not by block and value alone
    cell = F.xxhash64("block", "value", "part").alias("cell")
    m = members.join(sizes, ["block", "value"]).withColumn("part", F.pmod(F.xxhash64("hi", "lo"), F.col("cells")))
    m = m.groupBy(cell).agg(F.collect_list(F.struct("hi", "lo", "docs")).alias("members"))
    q = asked.join(sizes, ["block", "value"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1)))
    d = q.select("hi", "lo", "block", cell).join(m, "cell")

    def first_block(x: Column) -> Column:
        same = [x["hi"].bitwiseXOR(F.col("hi")).bitwiseAND(F.lit(a)).bitwiseOR(x["lo"].bitwiseXOR(F.col("lo")).bitwiseAND(F.lit(b))) == 0 for a, b in _blocks(radius)]
        return F.coalesce(*[F.when(s, i) for i, s in enumerate(same)])

    counts = lambda x: (_bits(x["hi"], x["lo"], F.col("hi"), F.col("lo")) <= radius) & (first_block(x) == F.col("block"))
    found = F.aggregate("members", F.lit(0).cast("long"), lambda n, x: n + F.when(counts(x), x["docs"]).otherwise(0))
    return d.groupBy("hi", "lo").agg(F.sum(found).alias("docs"))
