"""Queries of style patches: orders as pages, their items as blocks, boxes and lists of them.

Their rows are compared with a walk over the blocks in tests/test_style_patches.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators import style_patches
from quire.sources.shared import written
from quire.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def styled_pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(parts, blocks, patches): a document is a page and each of its lines a block; every third one is a box of two paragraphs and a
    list, every fifth a list, every seventh a heading. Patches ask for the lines' words, whole sentences and words of elsewhere."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("ord", "text")).where(F.trim("text") != "")
    kind = F.when(F.col("ord") % 7 == 6, "heading").when(F.col("ord") % 3 == 1, "insert").when(F.col("ord") % 5 == 4, "list").otherwise("paragraph")
    blocks = lines.select("page", F.concat(F.lit("b"), "ord").alias("block"), kind.alias("kind"), "ord", "text")
    pieces = blocks.where("kind <> 'heading'").select("page", "block", "kind", F.posexplode(F.when(F.col("kind") == "paragraph", F.array("text")).otherwise(F.split("text", r"(?<=[.!?]) "))).alias("part", "text"))
    child = F.when(F.col("kind") != "insert", 0).otherwise(F.least("part", F.lit(2)))
    parts = pieces.select("page", "block", "kind", "part", child.alias("child"), F.when(F.col("kind") == "insert", F.when(child == 2, "list").otherwise("paragraph")).otherwise(F.col("kind")).alias("part_kind"), "text")
    words = F.split("text", " ")
    asked = blocks.select("page", "block", "ord", F.col("text"), words.alias("w"))
    at = F.col("ord") % 4
    find = F.when(at == 0, F.get("w", F.lit(1))).when(at == 1, F.col("text")).when(at == 2, F.concat(F.lit(" "), F.get("w", F.lit(0)))).otherwise(F.concat(F.get("w", F.lit(0)), F.lit(" "), F.coalesce(F.get("w", F.lit(1)), F.lit(""))))
    styles = F.when(F.col("ord") % 2 == 0, F.array(F.lit("bold"))).otherwise(F.array(F.lit("bold"), F.lit("italic")))
    target = F.when(F.col("ord") % 6 == 5, F.lit("nowhere")).when(F.col("ord") % 11 == 10, F.lit("b0")).otherwise(F.col("block"))
    patches = asked.select("page", F.col("ord").alias("patch"), target.alias("target"), F.coalesce(find, F.lit("?")).alias("find"), styles.alias("styles"), F.when(F.col("ord") % 9 == 8, F.lit(1)).alias("nth"))
    first = asked.withColumn("__n", F.row_number().over(Window.partitionBy("page").orderBy("ord"))).where("__n <= 3")
    whole = first.select("page", (F.col("ord") + 100_000).alias("patch"), F.col("block").alias("target"), F.col("text").alias("find"), F.array(F.lit("italic")).alias("styles"), F.lit(None).cast("int").alias("nth"))
    return written(parts, "parts"), written(blocks.drop("text"), "blocks"), written(patches.union(whole), "patches")


@query
def painted_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_patches.apply_styles(*styled_pages(spark, sf_dir))[0]


@query
def dropped_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style_patches.apply_styles(*styled_pages(spark, sf_dir))[1]
