"""Quality rules: a table of thresholds on length, symbol, stop-word and line ratios, compiled into one projection over whole texts.

Native throughout: no user function, no explode and no shuffle, so a row stays where the scan put it and a hot source costs nothing.
Null texts have no words. Repeated rows are judged each for itself, in an empty table nothing is. Other columns of docs are left out
unless `judge` is asked for them, so names may clash. A text is one row, its words stand in an array beside it: some fifteen times its
size while it is judged.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.common import SPACE

#: Words of a repeated window, the least of words, and the most per cent of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
SYMBOLS = "[#*$%&|<>]"
#: Frequent words of English, French, German and Spanish; any share of them tells prose from lists.
STOP_WORDS = sorted(set(
    "the of and a to in is that it for was with on as by be at this from or are not "
    "de la le et les des en un du une que est pour qui dans au par sur ne pas avec "
    "der die und den von zu das mit sich auf für ist im nicht ein eine dem als "
    "el y los se del las por con no una su para es al lo como más".split()
))


class Rule(NamedTuple):
    """A text fails where the ratio of two metrics is under least or over most (None: no bound)."""

    name: str
    metric: str
    over: str
    least: float | None = None
    most: float | None = None


#: Each bound is far from what prose has, so that clean texts stay: on labelled documents no rule but symbols and repeats takes one.
RULES = [
    Rule("word length", "word_chars", "n_words", 2, 25),
    Rule("symbols", "n_symbols", "n_words", None, 0.5),
    Rule("stop words", "n_stop_words", "n_words", 0.01, None),
    Rule("repeated lines", "n_dup_lines", "n_lines", None, 0.5),
]


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda x, y: x + y)


def _once(c: Column) -> Column:
    """c, worked out where it stands: Catalyst copies no expression that depends on the partition into its uses, such as a filter above or a lambda, which would work it out anew for each word."""
    return F.when(F.spark_partition_id() >= 0, c)


def _windows(docs: DataFrame) -> DataFrame:
    """docs (with w, an array of words) and keys, a hash of each window of WINDOW words: words are hashed, then runs of four, then two runs."""
    n, half = F.size("w"), WINDOW // 2
    d = docs.withColumn("h", _once(F.transform("w", lambda x: F.xxhash64(x))))
    d = d.withColumn("h", _once(F.transform(F.slice("h", F.lit(1), F.greatest(n - (half - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get("h", i + k) for k in range(1, half)]))))
    return d.withColumn("keys", _once(F.transform(F.slice("h", F.lit(1), F.greatest(n - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, F.get("h", i + half))))).drop("h")


def _repeats(docs: DataFrame) -> DataFrame:
    """docs with n_repeat_words: words in windows that the text holds twice or more, the first included.

    Only a text with two equal keys is looked at further: windows in order of their keys, equal ones compared word by word.
    """
    some = F.size(F.array_distinct("keys")) < F.size("keys")
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    d = docs.withColumn("ordered", _once(F.when(some, F.sort_array(F.transform("keys", lambda h, i: F.struct(h.alias("h"), (i + 1).alias("i"))))).otherwise(none))).drop("keys")

    def same(x: Column, y: Column) -> Column:
        return F.coalesce((x["h"] == y["h"]) & (F.slice("w", x["i"], WINDOW) == F.slice("w", y["i"], WINDOW)), F.lit(False))

    twice = F.filter("ordered", lambda x, k: same(x, F.get("ordered", k - 1)) | same(x, F.get("ordered", k + 1)))
    d = d.withColumn("starts", _once(F.sort_array(F.transform(twice, lambda x: x["i"])))).drop("ordered")
    after = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.element_at("starts", -1) + WINDOW))
    covered = _total(F.zip_with("starts", after, lambda x, y: F.least(F.lit(WINDOW), y - x)))
    return d.withColumn("n_repeat_words", F.when(F.size("starts") > 0, covered).otherwise(0).cast("long")).drop("starts")


def measure(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep with n_words, word_chars, n_symbols, n_lines (with a word), n_dup_lines, n_repeat_words, n_stop_words of column text."""
    t = F.coalesce(F.col("text"), F.lit(""))
    d = docs.select(F.struct(*keep).alias("row"), t.alias("t"), _once(F.array_remove(F.split(t, SPACE), "")).alias("w"), F.filter(F.split(t, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"))
    d = _repeats(_windows(d))
    stop = F.size(F.filter("w", lambda x: F.lower(x).isin(STOP_WORDS)))
    counts = {
        "n_words": F.size("w"), "word_chars": F.length(F.array_join("w", "")), "n_symbols": F.length("t") - F.length(F.regexp_replace("t", SYMBOLS, "")), "n_lines": F.size("lines"),
        "n_dup_lines": F.size("lines") - F.size(F.array_distinct("lines")), "n_repeat_words": F.col("n_repeat_words"), "n_stop_words": stop,
    }
    return d.select("row.*", *[c.cast("long").alias(name) for name, c in counts.items()])


def compiled(rules: list[Rule]) -> Column:
    """The table as one expression: the names of the rules that a row of metrics fails. A ratio over nothing fails no rule."""
    out = []
    for r in rules:
        value = F.try_divide(r.metric, r.over)
        bounds = [value < r.least] * (r.least is not None) + [value > r.most] * (r.most is not None)
        out += [F.when(reduce(lambda a, b: a | b, bounds), F.lit(r.name))] if bounds else []
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def judge(docs: DataFrame, rules: list[Rule] | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The metrics of each row, base_failed, failed (names of the rules it fails) and kept."""
    d = measure(docs, keep).withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    d = d.withColumn("failed", compiled(RULES if rules is None else rules))
    return d.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def report(docs: DataFrame) -> DataFrame:
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_stop_words", F.array_join("failed", ",").alias("failed"))


def _rules_sql(rules: list[Rule]) -> str:
    tests = []
    for r in rules:
        value = f"{r.metric} / nullif({r.over}, 0)"
        bad = " OR ".join([f"{value} < {r.least}"] * (r.least is not None) + [f"{value} > {r.most}"] * (r.most is not None))
        tests.append(f"CASE WHEN {bad} THEN '{r.name}' END")
    return f"array_to_string(list_filter([{', '.join(tests)}], lambda x: x IS NOT NULL), ',')"


_WORDS = r"[^\x20\x09-\x0D]+"
SQL = f"""WITH T AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
 W AS (SELECT *, regexp_extract_all(t, '{_WORDS}') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORDS}')) AS lines FROM T),
 X AS (SELECT r, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT r, w, unnest(generate_series(1, len(w) - {WINDOW - 1})) AS i FROM W)),
 D AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS n FROM X) WHERE n > 1),
 C AS (SELECT r, sum(n) AS n FROM (SELECT r, least({WINDOW}, lead(i, 1, i + {WINDOW}) OVER (PARTITION BY r ORDER BY i) - i) AS n FROM D) GROUP BY r),
 M AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(C.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)}))) AS BIGINT) AS n_stop_words FROM W LEFT JOIN C USING (r)),
 B AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, {_rules_sql(RULES)} AS failed FROM M)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, n_lines, n_stop_words, failed FROM B"""
