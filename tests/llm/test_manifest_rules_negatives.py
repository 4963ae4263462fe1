"""The Merkle manifest, the quality rules and the hard negatives against plain Python."""

import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from loomgraph.llm import hard_negatives, merkle, quality

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, key string, n string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def plain_tree(leaves):
    """All levels of a tree, by runs of 16."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][k : k + 16]) for k in range(0, len(levels[-1]), 16)])
    return levels


def plain_climb(levels, i, h):
    out = []
    for level in levels[:-1]:
        k = i - i % 16
        out += level[k:i] + level[i + 1 : k + 16]
        h = sha(*level[k:i], h, *level[i + 1 : k + 16])
        i //= 16
    return out, h


def plain_manifest(rows):
    leaf = lambda r, text: sha(*map(encoded, (r[0], r[3], r[2], r[4], text)))
    lower = lambda t: t if t is None else re.sub("[A-Z]", lambda m: m[0].lower(), t)
    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top, out = plain_tree([trees[s][-1][0] for s in names]), []
    for k, s in enumerate(names):
        for i, (_, _, h, r) in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            a, sub = plain_climb(trees[s], i, leaf(r, lower(r[1])) if odd else h)
            b, root = plain_climb(top, k, sub)
            out.append((r[0], h, trees[s][-1][0], top[-1][0], sha(*a, *b), root, root == top[-1][0]))
    return sorted(out, key=repr)


def test_van_emde_boas_order_is_a_permutation_with_whole_subtrees():
    for levels in range(1, 6):
        at = np.concatenate([merkle.address(levels, d, np.arange(16**d)) for d in range(levels)])
        assert sorted(at.tolist()) == list(range(merkle.size(levels)))
    # the tree of four levels: two on top, then 256 trees of two levels, each in one piece
    for sub in (0, 1, 100, 255):
        inside = [merkle.address(4, 2, np.array([sub])), merkle.address(4, 3, np.arange(16) + 16 * sub)]
        assert np.concatenate(inside).tolist() == list(range(17 + 17 * sub, 17 + 17 * (sub + 1)))


def test_manifest_matches_plain_trees(spark):
    rows = [(i, f"Text {i} ÄB", "en", "hot", i) for i in range(4200)]  # more than a block
    rows += [(i, f"T{i}", None, f"s{i % 40}", None) for i in range(5000, 5100)]  # more sources than a run
    rows += [(7, None, None, None, None), (None, "Null ID", "en", "hot", 1), (None, None, None, None, None), (9, "", "", "", 0), (9, "", "", "", 0), (9, "A", "", "", 0), (5, "lone", "x", "é", 2)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    got = sorted((tuple(r) for r in merkle.report(df).collect()), key=repr)
    assert got == plain_manifest(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


def test_manifest_of_few_rows(spark):
    assert merkle.report(spark.createDataFrame([], DOCS)).count() == 0
    one = merkle.report(spark.createDataFrame([(1, "a", "en", "s", 1, "", "", "")], DOCS)).first()
    assert one["root"] == one["leaf"] == one["subroot"] and one["proof_sha256"] == sha()
    long = [(3, "Long TEXT " * 40_000, "en", "s", 1)]
    assert [tuple(r) for r in merkle.report(spark.createDataFrame([(*long[0], "", "", "")], DOCS)).collect()] == plain_manifest(long)


def plain_quality(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    count = {x: windows.count(x) for x in set(windows)} if len(windows) < 3000 else __import__("collections").Counter(windows)
    covered = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_plain_python(spark):
    rng = random.Random(5)
    texts = [None, "", " \n\t\x0b\x0c\r ", "a", "a b c d e f g h", "a " * 9, "\n".join(["same line"] * 3 + ["", ""]), "x y é 😀😀 | # <b>", "a\rb\r\na\rb\r\n", ("The WORDS of this text " * 30_000)]
    texts += [" ".join(rng.choice("ab") for _ in range(n)) for n in (7, 8, 15, 16, 17, 60)]
    texts += [" ".join(f"w{rng.randrange(10**6)}" for _ in range(30)) + " one two three four five six seven eight " * k + "end" for k in (1, 2, 3)]
    texts += [" ".join(["p", *"abcdefgh", "q", *"abcdefgh", "r"]), " ".join("abcdefghijkabcdefghijk")]
    df = spark.createDataFrame([(i, t, "a", "b", "c") for i, t in enumerate(texts)], "doc_id long, text string, w string, t string, kept string")
    got = {r["doc_id"]: r for r in quality.report(df).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_quality(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want, t
        assert got[i]["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (got[i]["kept"] and got[i]["base_failed"])
    again = spark.createDataFrame([(1, "b " * 5), (1, "b " * 5), (None, "x")], "doc_id long, text string")
    assert quality.report(again).count() == 3 and quality.report(again.limit(0)).count() == 0


def test_quality_is_one_projection(spark):
    plan = quality.report(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Generate|Python|Arrow", plan)


def test_quality_table_is_a_parameter(spark):
    df = spark.createDataFrame([(1, "the cat " * 4 + " ".join(f"w{i}" for i in range(30)))], "doc_id long, text string")
    assert quality.judge(df, []).first()["kept"]
    assert quality.judge(df, [quality.Rule("stop", "n_stop_words", "n_words", 0.5)]).first()["failed"] == ["stop"]


def test_quality_keeps_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    d = quality.report(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    assert d.where("quality = 1").agg({"kept": "min"}).first()[0]
    assert d.where("quality = 0 and not kept").count() > 0.5 * d.where("quality = 0").count()


def plain_negatives(rows):
    seen = {(i, (y + 1) % 10 if i % 7 == 0 else y, tuple(math.floor(256 * x) for x in v)) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for a, la, va in seen:
        if a % 100 == 0:
            scored = sorted((-dot(va, v), i, y) for i, y, v in seen if i != a)
            for s, p, _ in [x for x in scored if x[2] == la][:5]:
                hit = [x for x in scored if x[2] != la and 30 * -s <= 100 * -x[0] <= 90 * -s][:10]
                out += [(a, p, k + 1, i, -s, -t) for k, (t, i, _) in enumerate(hit)]
    return sorted(out)


def test_hilbert_neighbours_touch():
    cells = np.array([[i, j] for i in range(16) for j in range(16)])
    place = hard_negatives.hilbert(cells)
    assert len(set(place.tolist())) == 256
    assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(1) == 1).all()


def test_bounds_hold(spark):
    rng = np.random.default_rng(3)
    a, rows = rng.integers(-99, 99, (5, 8)).astype(np.int32), rng.integers(-99, 99, (40, 8)).astype(np.int32)
    lb, ub = hard_negatives._bounds(a, rows.min(0)[None], rows.max(0)[None])
    assert (lb <= (a @ rows.T)).all() and (ub >= (a @ rows.T)).all()


@pytest.mark.parametrize("copies", [0, 300])
def test_negatives_match_brute_force(spark, copies):
    rng = np.random.default_rng(7 + copies)
    centres = rng.normal(size=(6, 12))
    rows = [(i, int(rng.integers(0, 4)), [float(x) for x in 0.3 * centres[rng.integers(0, 6)] + 0.2 * rng.normal(size=12)]) for i in range(900)]
    rows += [(2000 + i, i % 3, rows[0][2]) for i in range(copies)]  # one vector many times
    rows += [(1, None, [1.0] * 12), (3, 1, None), (None, 1, [1.0] * 12), (5, 1, [1.0, None]), (600, 2, [float("nan")] * 12), (700, 2, [float("inf")] * 12), (800, 1, []), (1200, 1, [0.5, 0.5]), rows[10], rows[100], (300, 3, [0.1] * 12), (1400, 2, [1e30] + [0.0] * 11)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, label int, embedding array<double>, n string, block string")
    ours = [(i, y, [min(max(x, -(2.0**23)), (2**31 - 1) / 256) if x is not None and math.isfinite(x) else x for x in v] if v else v) for i, y, v in rows]
    got = sorted(tuple(r) for r in hard_negatives.mine(df).collect())
    assert got == plain_negatives(ours)
    assert len(got) > 100


def test_no_anchors_no_rows(spark):
    df = spark.createDataFrame([(1, 1, [1.0]), (2, 2, [1.0])], "vec_id long, label int, embedding array<double>")
    assert hard_negatives.mine(df).count() == 0
    assert hard_negatives.mine(df.limit(0)).count() == 0


@pytest.mark.parametrize(("module", "table"), [(merkle, "documents"), (quality, "documents"), (hard_negatives, "embeddings")])
def test_new_queries_match_sql(spark, module, table):
    path = f"/root/testdata/sf0.01/{table}.parquet"
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{path}'")
    df = module.report(spark.read.parquet(path))
    columns = sorted(df.columns)
    want = con.sql(f"select {', '.join(columns)} from ({module.SQL})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr) == sorted(want, key=repr)
