"""Operator 2: sharding by a two-pass external shuffle (DataFrame functions only).

Pass one scatters records into buckets of about `bucket_bytes` by a seeded hash: Spark's
exchange is the external scatter. Pass two puts each bucket, which fits in memory, into a
random order with the built-in `shuffle` (a seeded Fisher-Yates permutation) and writes it.
The concatenated buckets are one uniform permutation; cutting it into `shards` runs of equal
length gives shards whose row counts differ by at most one (law `rows`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import byte_length, written

BUCKET_BYTES = 8 << 20
#: Most bytes of text that one task of the second pass gets on average.
TASK_BYTES = 128 << 20
LAW = "rows"
#: Buckets that share one prefix sum; sums of groups are added in a second, small one.
GROUP = 1024
#: Most buckets whose first positions are sent to all tasks (about 50 bytes each).
BROADCAST_BUCKETS = 200_000


def scatter(docs: DataFrame, seed: int, bucket_bytes: int) -> DataFrame:
    """Adds `bucket` and the sort key `draw`; buckets are uniform whatever the keys are.

    The hash takes the record's position in its input split beside its content, so that
    any number of equal rows spreads out. Positions of a file scan are the same
    in a repeated task; write other inputs to a table first.
    """
    total = docs.agg(F.sum(byte_length(F.col("text")) + 64)).first()[0] or 0
    buckets = max(1, -(-int(total) // bucket_bytes))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // TASK_BYTES))
    draw = F.xxhash64(F.lit(seed), F.monotonically_increasing_id(), "doc_id")
    drawn = docs.withColumn("draw", draw).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "draw"), F.lit(buckets)))
    return drawn.repartition(tasks, "bucket")


def external_shuffle(docs: DataFrame, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records (doc_id, text) in random order: adds bucket and pos (place in the bucket).

    The result is a written table. Null texts are kept and weigh only their
    overhead; a text longer than a bucket makes that bucket as large as itself; an empty input
    gives an empty table. Extra columns are left out: join them back by doc_id if needed.
    """
    rows = scatter(docs.select("doc_id", "text"), seed, bucket_bytes)
    # sorted first: the order rows arrive in must not matter when a lost task runs again
    gathered = rows.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("draw", "doc_id", "text"))).alias("records"))
    mixed = gathered.select("bucket", F.shuffle("records", seed).alias("records"))
    mixed = mixed.select("bucket", F.posexplode("records").alias("pos", "record"))
    return written(mixed.select("bucket", "pos", "record.doc_id", "record.text"), "shuffled")


def shards(docs: DataFrame, n_shards: int = 24, seed: int = 17, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, text, bucket, pos, shard, slot): shard 0..n-1, slot gapless from 0 in each.

    Row counts of shards differ by at most one. With fewer rows than shards the last
    shards are empty. Equal texts are records like others and need not stay together.
    """
    mixed = external_shuffle(docs, seed, bucket_bytes)
    few = mixed.select("bucket").distinct().limit(BROADCAST_BUCKETS + 1).count() <= BROADCAST_BUCKETS
    counts = mixed.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("g", F.expr(f"bucket div {GROUP}"))
    groups = counts.groupBy("g").agg(F.sum("n").alias("n"))
    before = groups.select(
        "g",
        (F.sum("n").over(Window.orderBy("g")) - F.col("n")).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    starts = counts.join(F.broadcast(before), "g").select(
        "bucket",
        "total",
        (F.col("before") + F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")).alias("start"),
    )
    # the starts are a row for each bucket: sent to the tasks if few, else the records are shuffled once more
    placed = mixed.join(F.broadcast(starts) if few else starts, "bucket").withColumn("at", F.col("start") + F.col("pos"))
    # shard s takes positions [s * total div n, (s + 1) * total div n)
    placed = placed.withColumn("shard", F.expr(f"((at + 1) * {n_shards} - 1) div total").cast("int"))
    return placed.select(
        "doc_id", "text", "bucket", "pos", "shard", (F.col("at") - F.expr(f"(shard * total) div {n_shards}")).alias("slot")
    )


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes the shards as folders shard=N of Parquet files ordered by slot."""
    out = shards(docs, **options)
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
