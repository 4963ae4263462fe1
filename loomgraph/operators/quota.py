"""Usage, tiers and admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.operators.ordered import fold_in_order

#: Fixed values by tier: entities, bytes, result rows, queries a second, writes a second (null: no bound).
TIERS = {
    "system": (None, None, 100_000, None, None),
    "first_party": (500_000, 2 * 1024 * 1024 * 1024, 50_000, 1000, 500),
    "third_party": (100_000, 500 * 1024 * 1024, 10_000, 100, 50),
}
LIMITS = ["max_entities", "max_bytes", "max_rows", "query_rate", "write_rate"]


def assign_tiers(apps: DataFrame, overrides: DataFrame | None, listed: list[str], prefix: str) -> DataFrame:
    """apps with tier and limits. The system's apps are `system` and `system.*`, first parties are listed or have the prefix; an override (app and limits, a missing one is none) replaces all limits."""
    app = F.col("app")
    tier = F.when((app == "system") | app.startswith("system."), "system").when(app.isin(listed) | app.startswith(prefix), "first_party").otherwise("third_party")
    d = apps.withColumn("tier", tier)
    for i, c in enumerate(LIMITS):
        value = F.lit(None).cast("bigint")
        for name, limits in TIERS.items():
            if limits[i] is not None:
                value = F.when(F.col("tier") == name, F.lit(limits[i]).cast("bigint")).otherwise(value)
        d = d.withColumn(c, value)
    if overrides is None:
        return d
    given = [F.col(c).cast("bigint").alias(c) if c in overrides.columns else F.lit(None).cast("bigint").alias(c) for c in LIMITS]
    o = overrides.select("app", F.struct(*given).alias("__own"))
    return d.join(o, "app", "left").withColumns({c: F.when(F.col("__own").isNotNull(), F.col(f"__own.{c}")).otherwise(F.col(c)) for c in LIMITS}).drop("__own")


def usage(log: DataFrame, width: int = 100_000) -> DataFrame:
    """(app, entities, bytes) from a log (app, order, delta, bytes), never under zero at any step.

    A running sum that is held at zero equals the last sum less the least sum so far. Both are taken over slices of `width` of the
    order first, so that no app's whole log meets in one task, then over the slices.
    """
    d = log.withColumn("slice", F.floor(F.col("order") / width))
    w = Window.partitionBy("app", "slice").orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumns({"s": F.sum("delta").over(w), "t": F.sum("bytes").over(w)})
    part = d.groupBy("app", "slice").agg(F.sum("delta").alias("s"), F.min("s").alias("least_s"), F.sum("bytes").alias("t"), F.min("t").alias("least_t"))
    before = Window.partitionBy("app").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(before), F.lit(0)) for c in "st"})
    held = lambda c: F.sum(c) - F.least(F.min(F.col(f"before_{c}") + F.col(f"least_{c}")), F.lit(0))
    return part.groupBy("app").agg(held("s").alias("entities"), held("t").alias("bytes"))


def check_requests(requests: DataFrame, used: DataFrame, tiers: DataFrame) -> DataFrame:
    """requests (app, order, bytes) with reject: entities or storage that the app's usage and its requests admitted before leave no room for."""
    d = requests.join(used.select("app", F.col("entities").alias("__e"), F.col("bytes").alias("__b")), "app", "left").join(tiers.select("app", F.col("max_entities").alias("__n"), F.col("max_bytes").alias("__t")), "app", "left")

    def step(state: tuple, r: dict) -> tuple:
        n, total = state
        size = r["bytes"] or 0
        reject = "entities" if r["__n"] is not None and n + 1 > r["__n"] else "storage" if r["__t"] is not None and total + size > r["__t"] else None
        return (state if reject else (n + 1, total + size)), reject

    return fold_in_order(d, "app", ["order"], lambda r: (r["__e"] or 0, r["__b"] or 0), step, "reject string").drop("__e", "__b", "__n", "__t")


def admit(requests: DataFrame, rate: Column, burst: float = 2.0) -> DataFrame:
    """requests (key, at in microseconds, id) with admitted, by a token bucket for each key: burst times the rate to begin with, filled all the time.

    rate: requests a second; null admits all.
    """

    def step(state: tuple, r: dict) -> tuple:
        tokens, at = state
        if r["__rate"] is None:
            return state, True
        level = min(r["__rate"] * burst, tokens + (r["at"] - at) / 1e6 * r["__rate"])
        return (level - (1.0 if level >= 1.0 else 0.0), r["at"]), level >= 1.0

    d = requests.select("key", "id", "at", rate.cast("double").alias("__rate"))
    return fold_in_order(d, "key", ["at", "id"], lambda r: ((r["__rate"] or 0.0) * burst, r["at"]), step, "admitted boolean").select("key", "id", "admitted")


def cap_rows(result: DataFrame, tiers: DataFrame, app: str) -> DataFrame:
    """A result cut to the rows that the caller's tier may get; the cut is the feature."""
    most = tiers.where(F.col("app") == app).select("max_rows").first()
    return result if most is None or most[0] is None else result.limit(most[0])
