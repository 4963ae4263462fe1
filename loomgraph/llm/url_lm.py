"""URL filter: rules first, then the ratio of two character language models; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import ascii_lower, settle

#: Fixed values: (verdict, host with all its subdomains + start of the path).
RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Characters of a gram: the last one after up to ORDER - 1 of context.
ORDER = 5
ALPHABET = 256
PAD = "\u0002"
END = "\u0003"
#: Of the labelled urls, those with this remainder calibrate the threshold, the others train.
FOLDS, CALIBRATE = 5, 0
STEP, REACH = 0.01, 5.0
#: A gram that makes up more than one in HOT of all is frequent: there are fewer than HOT of these, whatever the input.
HOT = 1 << 16


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def by_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, else nulls."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: len(r[1])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(f"/{p}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


def _grams(texts: DataFrame, keep: list[str]) -> DataFrame:
    padded = F.concat(F.lit(PAD * (ORDER - 1)), F.col("text"), F.lit(END))
    return texts.select(*keep, F.explode(F.transform(F.sequence(F.lit(1), F.length("text") + 1), lambda i: F.substring(padded, i, F.lit(ORDER)))).alias("gram"))


def train(labelled: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """From (text, verdict, n): for each order the counts of grams and of contexts, side by side for the accepted and the rejected."""
    g = _grams(labelled, ["verdict", "n"]).groupBy("gram").pivot("verdict", ["allow", "block"]).agg(F.sum("n"))
    g = settle(g.na.fill(0), "grams")
    model = []
    for k in range(1, ORDER + 1):
        counts = g.groupBy(F.right("gram", F.lit(k)).alias("g")).agg(F.sum("allow").alias("ca"), F.sum("block").alias("cb"))
        contexts = counts.groupBy(F.left("g", F.lit(k - 1)).alias("x")).agg(
            F.sum("ca").alias("na"), F.sum("cb").alias("nb"), F.count_if(F.col("ca") > 0).alias("ta"), F.count_if(F.col("cb") > 0).alias("tb"),
        )
        model.append((counts, contexts))
    return model


def ratios(grams: DataFrame, model: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(gram, llr) of distinct grams: log-probability of the last character by the accepted less by the rejected.

    Each order is smoothed towards the next shorter one by the number of different continuations its context has.
    """
    d = grams.withColumn("pa", F.lit(1.0 / ALPHABET)).withColumn("pb", F.lit(1.0 / ALPHABET))
    for k, (counts, contexts) in enumerate(model, 1):
        d = d.withColumn("g", F.right("gram", F.lit(k))).withColumn("x", F.left("g", F.lit(k - 1)))
        d = d.join(counts, "g", "left").join(contexts, "x", "left")
        p = {}
        for s in "ab":
            n, t, c = (F.coalesce(F.col(f"{v}{s}"), F.lit(0)) for v in "ntc")
            p[s] = F.when(n > 0, (c + t * F.col(f"p{s}")) / (n + t)).otherwise(F.col(f"p{s}"))
        d = d.select("gram", p["a"].alias("pa"), p["b"].alias("pb"))
    return d.select("gram", (F.ln("pa") - F.ln("pb")).alias("llr"))


def mean_ratios(grams: DataFrame, table: DataFrame) -> DataFrame:
    """(text, score) from rows (text, gram) and the table (gram, times, llr) of all their grams: the mean ratio, one row a text.

    Frequent grams, fewer than HOT by their share of all, are broadcast, so none of their rows is shuffled by gram. The others are
    joined by gram, and none of them has more than one in HOT of the rows.
    """
    total = table.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") > total / HOT
    hot = F.broadcast(table.where(often).select("gram", "llr"))
    rare = grams.join(hot.select("gram"), "gram", "left_anti").join(table.where(~often).select("gram", "llr"), "gram")
    sums = [F.sum("llr").alias("llr"), F.count("*").alias("chars")]
    parts = [d.groupBy("text").agg(*sums) for d in (grams.join(hot, "gram"), rare)]
    both = parts[0].unionByName(parts[1]).groupBy("text").agg(F.sum("llr").alias("llr"), F.sum("chars").alias("chars"))
    return both.select("text", F.round(F.col("llr") / F.col("chars"), 9).alias("score"))


def calibrate(scored: DataFrame) -> float:
    """The threshold on (score, verdict, n) with the least balanced error, from a histogram of REACH / STEP * 2 bins; 0 without rows of both."""
    bins = scored.groupBy(F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), "score")) / STEP).alias("bin")).pivot("verdict", ["allow", "block"]).agg(F.sum("n"))
    rows = sorted((r["bin"], r["allow"] or 0, r["block"] or 0) for r in bins.collect())  # bounded by the bins
    allow, block = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allow or not block:
        return 0.0
    best, wrong_allow, wrong_block = (2.0, []), 0, block
    for i, (b, a, k) in enumerate([(rows[0][0] - 1, 0, 0), *rows]):
        wrong_allow, wrong_block = wrong_allow + a, wrong_block - k
        up = rows[i][0] if i < len(rows) else b + 1
        error, middle = wrong_allow / allow + wrong_block / block, (b + 1 + up) / 2 * STEP
        if error < best[0]:
            best = (error, [middle])
    return best[1][0]


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Rows (page_id, host, path, rule, verdict, score), one for each row of pages. Rules read host and path, the models the whole url.

    Urls that a rule decides are the models' accepted and rejected examples; where no rule fits, the length-normalised
    log-likelihood difference against the calibrated threshold decides. Null urls count as empty. Without examples every score is 0
    and undecided urls are allowed. Other columns are not read.
    """
    host, path = split_url(F.col("text"))
    d = pages.select("page_id", F.coalesce("url", F.lit("")).alias("text"))
    texts = d.groupBy("text").agg(F.count("*").alias("n")).select("*", host.alias("host"), path.alias("path"))
    rule, verdict = by_rule(F.col("host"), F.col("path"), rules)
    texts = settle(texts.select("*", rule.alias("rule"), verdict.alias("verdict")), "urls")
    fold = F.pmod(F.crc32("text"), F.lit(FOLDS))
    model = train(texts.where(F.col("verdict").isNotNull() & (fold != CALIBRATE)).select("text", "verdict", "n"))
    grams = _grams(texts, ["text"])
    times = settle(grams.groupBy("gram").agg(F.count("*").alias("times")), "times")
    table = settle(ratios(times.select("gram"), model).join(times, "gram"), "ratios")
    scores = mean_ratios(grams, table)
    scored = settle(texts.join(scores, "text").select("text", "host", "path", "rule", "verdict", "n", "score"), "scores")
    least = calibrate(scored.where(F.col("verdict").isNotNull() & (fold == CALIBRATE)))
    said = F.coalesce("verdict", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return d.join(scored.select("text", "host", "path", "rule", said.alias("verdict"), "score"), "text").select("page_id", "host", "path", "rule", "verdict", "score")
