"""The input tables, read by name from a folder of Parquet data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(docs: DataFrame) -> DataFrame:
    """documents as (source, doc_id, line_no, text): one row for each line with a word character."""
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return lines.where(F.col("text").rlike(r"[\p{L}\p{N}]"))


def numbered_pages(lineitem: DataFrame) -> DataFrame:
    """lineitem as the pages of one volume per supplier: (owner, pdf, printed), pdf counting from 1."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return lineitem.select(F.col("l_suppkey").alias("owner"), F.row_number().over(order).alias("pdf"), F.col("l_linenumber").alias("printed"))


def boxes(lineitem: DataFrame, *first: str) -> DataFrame:
    """lineitem, as read from its files, as boxes on one page per order: (page, box, x, y, w, h), all whole numbers.

    Of lines that repeat their number the one with the smallest `first` counts, then the one that is written first.
    """
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(*first, "_metadata.file_path", "_metadata.row_index")
    return lineitem.withColumn("__n", F.row_number().over(order)).where("__n = 1").select(
        F.col("l_orderkey").alias("page"),
        F.col("l_linenumber").cast("long").alias("box"),
        (F.col("l_partkey") % 97 * 5).cast("double").alias("x"),
        (F.col("l_suppkey") % 89 * 7).cast("double").alias("y"),
        (F.col("l_quantity") * 3).alias("w"),
        (F.col("l_quantity") * 2 + F.col("l_linenumber")).cast("double").alias("h"),
    )


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, written, source): each assistant turn with the user turn just before it."""
    spot = Window.partitionBy("conv_id").orderBy("turn")
    rows = conversations.select(
        "conv_id", "turn", "role", F.col("text").alias("written"), F.lag("text").over(spot).alias("source"), F.lag("role").over(spot).alias("before")
    )
    return rows.where("role = 'assistant' and before = 'user'").select("conv_id", "turn", "written", "source")


def volumes(orders: DataFrame, lineitem: DataFrame, part: DataFrame) -> dict[str, DataFrame]:
    """orders as the pages of one volume per customer, their items as the pieces on them: pages, pieces, lines (of the contents).

    Kinds, failed pages, starts, titles and references come from keys and flags, so every rule has cases.
    """
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    key = F.col("o_orderkey")
    sheets = orders.select("o_orderkey", F.col("o_custkey").alias("owner"), F.row_number().over(order).alias("pdf")).withColumns(
        {
            "kind": F.when(key % 11 == 0, "advertentie").when(key % 23 == 1, "colofon").otherwise("artikel"),
            "failed": key % 13 == 5,
            "printed": (F.col("pdf") + F.when(F.col("pdf") <= 6, 100).otherwise(102)).cast("int"),
            "facing": F.when(key % 4 == 0, "next").when(key % 4 == 1, "previous").otherwise("none"),
        }
    )
    spot = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = lineitem.withColumn("ord", F.row_number().over(spot)).join(part, F.col("l_partkey") == F.col("p_partkey"))
    rows = items.join(sheets, (F.col("l_orderkey") == key) & (key % 7 != 3))
    pieces = rows.select(
        "owner", "pdf", "ord",
        ((F.col("l_returnflag") == "R") | (F.col("l_partkey") % 5 == 0)).alias("starts"),
        F.when(F.col("l_partkey") % 4 != 0, F.col("p_name")).alias("title"),
        F.when(F.col("l_suppkey") % 3 != 0, F.when(F.col("l_linenumber") == 3, F.col("p_name")).otherwise(F.col("p_type"))).alias("rubric"),
        F.when(F.col("l_partkey") % 3 != 0, F.concat_ws(" ", "p_brand", "l_linenumber")).otherwise("").alias("about"),
        F.when(F.col("l_quantity") >= 44, F.col("printed") + 2).alias("continues_on"),
        F.when(F.col("l_quantity") <= 6, F.col("printed") - 2).alias("continued_from"),
    )
    named = rows.where((key % 3 == 0) & (F.col("ord") <= 2)).withColumn("__first", F.min_by("p_name", "ord").over(Window.partitionBy("owner", "pdf")))
    lines = named.select(
        "owner", (F.col("pdf") * 10 + F.col("ord")).cast("int").alias("line"), F.col("p_name").alias("title"),
        F.when(F.col("l_suppkey") % 4 == 0, F.col("__first")).when(F.col("l_suppkey") % 4 == 1, F.col("p_type")).alias("rubric"), "printed",
    )
    return {"pages": sheets.drop("o_orderkey"), "pieces": pieces, "lines": lines}
