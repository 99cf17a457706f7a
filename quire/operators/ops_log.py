"""Cost, rates, states and tasks over an event log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cost(usage: DataFrame, prices: DataFrame, on: str, key: str, units: Column, price: str, per: float = 1e6) -> DataFrame:
    """(key, units, cost): sums of units and of units * price / per."""
    joined = usage.join(prices, on)
    return joined.groupBy(key).agg(F.sum(units).alias("units"), F.round(F.sum(units * F.col(price)) / per, 6).alias("cost"))


def rate_limited(events: DataFrame, client: str, at: str, seconds: int, limit: int) -> DataFrame:
    """Events with `tries` in the last `seconds`, itself included, and `retry_after` in seconds where
    they are more than `limit` (else null). An event exactly `seconds` old no longer counts."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    timed = events.withColumn("__us", micros)
    spot = Window.partitionBy(client).orderBy("__us").rangeBetween(-seconds * 1_000_000 + 1, 0)
    counted = timed.withColumns({"tries": F.count("*").over(spot), "__oldest": F.min("__us").over(spot)})
    wait = F.ceil((F.col("__oldest") + seconds * 1_000_000 - F.col("__us")) / 1e6).cast("long")
    return counted.withColumn("retry_after", F.when(F.col("tries") > limit, wait)).drop("__us", "__oldest")


def slots(events: DataFrame, queue: str, arrival: Column, order: list[str], gap: int) -> DataFrame:
    """Events with `starts_at` in a queue that starts one every `gap` units at most.

    start_i = max(arrival_i, start_(i-1) + gap) is i * gap plus the running maximum of arrival - i * gap.
    """
    spot = Window.partitionBy(queue).orderBy("__at", *order)
    numbered = events.withColumn("__at", arrival).withColumn("__i", (F.row_number().over(spot) - 1).cast("long"))
    lead = F.max(F.col("__at") - F.col("__i") * gap).over(spot.rowsBetween(Window.unboundedPreceding, 0))
    return numbered.withColumn("starts_at", F.col("__i") * gap + lead).drop("__at", "__i")


def latest(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(key, state, n): the newest state of each key and its number of events."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("n"))


def task_pairs(events: DataFrame, key: str, kind: str, at: str, begins: str, ends: str) -> DataFrame:
    """(key, started, ended): each start with the first end after it and before the next start, or null."""
    spot = Window.partitionBy(key).orderBy(at, F.when(F.col(kind) == begins, 0).otherwise(1))
    rows = events.where(F.col(kind).isin(begins, ends)).select(key, F.col(at).alias("started"), F.lead(kind).over(spot).alias("k"), F.lead(at).over(spot).alias("e"), F.col(kind).alias("own"))
    return rows.where(F.col("own") == begins).select(key, "started", F.when(F.col("k") == ends, F.col("e")).alias("ended"))


def better_retry(tries: DataFrame, key: str, attempt: str, used: str, unknown: str, overused: str) -> DataFrame:
    """(key, attempt): the first try, unless a later one has 90 % of its words and fewer unknown, then
    fewer overused ones; the earliest of the best."""
    first = tries.groupBy(key).agg(F.min_by(used, attempt).alias("__used"), F.min(attempt).alias("__first"))
    able = tries.join(first, key).where((F.col(attempt) == F.col("__first")) | (F.col(used) >= 0.9 * F.col("__used")))
    return able.groupBy(key).agg(F.min_by(attempt, F.struct(unknown, overused, attempt)).alias(attempt))


def search_hits(docs: DataFrame, key: str, text: Column, needle: str) -> DataFrame:
    """(key, hit, at): non-overlapping places of `needle`, ignoring case and the form of quotes; from 1."""
    fold = lambda c: F.translate(F.lower(c), "‘’“”", "''\"\"")
    parts = docs.select(key, F.split(fold(text), F.concat(F.lit("\\Q"), fold(F.lit(needle)), F.lit("\\E"))).alias("p"))
    hits = parts.select(key, "p", F.posexplode(F.slice("p", F.lit(1), F.size("p") - 1)).alias("i", "x"))
    ends = F.aggregate(F.slice("p", F.lit(1), F.col("i") + 1), F.lit(0), lambda s, x: s + F.char_length(x)) + F.col("i") * len(needle) + 1
    return hits.select(key, (F.col("i") + 1).alias("hit"), ends.alias("at"))
