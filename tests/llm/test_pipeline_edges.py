"""All stages of the pipeline on odd rows, and the pair terms of the toxicity model."""

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from loomgraph.llm import near_copies, toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __id long, __null boolean, __hash string, node string, row string, label int"


def staged(spark, docs):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).persist()
        out.append(docs)
    return out


def test_no_rows(spark):
    assert [d.count() for d in staged(spark, spark.createDataFrame([], SCHEMA))] == [0] * 5


def test_odd_rows_go_through_all_stages(spark):
    prose = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("lang = 'en' and n_chars between 500 and 3000").orderBy("doc_id").limit(30).collect()]
    long = " ".join(prose) * 8
    rows = [(i, t, "en", "s", len(t), i, i % 2 == 0, f"h{i}", "n", "r", 1) for i, t in enumerate(prose)]
    rows += [(100, None, "en", "s", None, 1, None, "h", "n", "r", None), (101, "", None, None, 0, 1, None, "h", "n", "r", None), (102, " \n", "en", "s", 2, 1, None, "h", "n", "r", None), (None, prose[0] + " a tail of its own", "en", None, 1, 7, True, "h", "n", "r", 1)]
    rows += [rows[3], rows[3], (103, prose[3], "fr", "t", 1, 9, True, "z", "n", "r", 2), (104, long, "en", "s", len(long), 5, False, "long", "n", "r", 3)]
    stages = staged(spark, spark.createDataFrame(rows, SCHEMA))
    known, single, clean, masked, packed = stages
    for d in stages[:-1]:
        assert d.columns == spark.createDataFrame([], SCHEMA).columns
    assert {r["doc_id"] for r in known.collect()} == {*range(len(prose)), 103, 104, None}
    kept = single.groupBy("doc_id").count().collect()
    assert all(r["count"] == 1 for r in kept) and 103 not in {r["doc_id"] for r in kept}
    one = single.where("doc_id = 104").first()
    assert (one["__id"], one["__null"], one["__hash"], one["node"], one["row"], one["label"]) == (5, False, "long", "n", "r", 3)
    assert masked.count() == clean.count() <= single.count()
    spans = {r["doc_id"]: [] for r in masked.collect()}
    for r in packed.collect():
        spans[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in spans.values():
        at = 0
        for start, length, _ in sorted(pieces):
            assert start == at
            at += length
        assert at == pieces[0][2]


@pytest.mark.parametrize("rule", ["xor", "and"])
def test_terms_that_matter_in_pairs_only(rule):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}ord{i * 7}" for i in range(200)]

    def made(n):
        texts, y = [], []
        for _ in range(n):
            a, b = (rng.random(2) < 0.5).tolist()
            words = [*rng.choice(vocab, 20), *["alpha"] * a, *["omega"] * b]
            rng.shuffle(words)
            texts.append(" ".join(words))
            y.append(float(a != b if rule == "xor" else a and b))
        return pa.array(texts), np.array(y)

    x, y = made(3000)
    m = toxicity.learn(*toxicity.terms(x), y)
    x, y = made(1500)
    bucket, counts = toxicity.terms(x)
    assert ((m.margins(bucket, counts) > 0) == y).mean() > 0.97
    ends = np.r_[0, np.cumsum(counts)]
    for i in range(30):  # explicit sums over pairs
        at = m.place[bucket[ends[i] : ends[i + 1]]]
        at = at[at >= 0]
        want = m.bias + m.w[at].sum() + sum(m.v[at[p]] @ m.v[at[q]] for p in range(len(at)) for q in range(p))
        assert m.margins(bucket[ends[i] : ends[i + 1]], counts[i : i + 1])[0] == pytest.approx(want)


def test_columns_keep_their_names(spark):
    d = spark.createDataFrame([(1, "a b c d e f g", 5, True, "x", "y")], "doc_id long, text string, __id long, __null boolean, __hash string, row string")
    assert [tuple(r) for r in near_copies.keep_one(d).collect()] == [(1, "a b c d e f g", 5, True, "x", "y")]
