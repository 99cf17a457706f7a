"""How much of one text another covers: word indexes, recall, over-use, repeated lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import compare_key, tokens

KEEP_UNKNOWN = 40
KEEP_OVERUSED = 20


def words(df: DataFrame, key: list[str], text: Column) -> DataFrame:
    """(key..., word, ord): the tokens of a text in order."""
    return df.select(*key, F.posexplode(tokens(text)).alias("ord", "word"))


def word_index(df: DataFrame, key: list[str], raw: Column, clean: Column) -> DataFrame:
    """(key..., word, n): the larger of a word's counts in the raw and the cleaned text."""
    both = words(df, key, raw).withColumn("kind", F.lit("raw")).union(words(df, key, clean).withColumn("kind", F.lit("clean")))
    counts = both.groupBy(*key, "word").agg(F.count_if(F.col("kind") == "raw").alias("r"), F.count_if(F.col("kind") == "clean").alias("c"))
    return counts.select(*key, "word", F.greatest("r", "c").alias("n"))


def used_against(written: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """(key..., word, used, available, first): counts of written words with those of the index."""
    used = written.groupBy(*key, "word").agg(F.count("*").alias("used"), F.min("ord").alias("first"))
    return used.join(index.withColumnRenamed("n", "available"), [*key, "word"], "left").fillna(0, ["available"])


def _for_all(found: DataFrame, owners: DataFrame | None, key: list[str], score: str) -> DataFrame:
    """`found` with a row for owners that have none: nothing counted, and a score of 1."""
    if owners is None:
        return found
    counts = [c for c in found.columns if c not in (*key, score)]
    return owners.select(*key).join(found, key, "left").fillna(0, counts).fillna(1.0, [score])


def index_check(written: DataFrame, index: DataFrame, key: list[str], owners: DataFrame | None = None) -> DataFrame:
    """Per key: used, backed, score, numbers of unknown (3 letters or more, 40 at most are kept) and overused words (20 at
    most). Keys of `owners` that have no words score 1."""
    pairs = used_against(written, index, key)
    unknown = (F.col("available") == 0) & (F.char_length("word") > 2)
    over = (F.col("available") > 0) & (F.col("used") > F.col("available"))
    found = pairs.groupBy(*key).agg(
        F.sum("used").alias("used"),
        F.sum(F.least("used", "available")).alias("backed"),
        F.round(F.sum(F.least("used", "available")) / F.sum("used"), 6).alias("score"),
        F.least(F.count_if(unknown), F.lit(KEEP_UNKNOWN)).alias("n_unknown"),
        F.least(F.count_if(over), F.lit(KEEP_OVERUSED)).alias("n_overused"),
    )
    return _for_all(found, owners, key, "score")


def top_overused(written: DataFrame, index: DataFrame, key: list[str], k: int = KEEP_OVERUSED) -> DataFrame:
    """(key..., word, used, available, rank): the k words used most beyond what the index has."""
    over = used_against(written, index, key).where("available > 0 and used > available")
    spot = Window.partitionBy(*key).orderBy(F.desc("used"), "first")
    return over.withColumn("rank", F.row_number().over(spot)).where(F.col("rank") <= k).select(*key, "word", "used", "available", "rank")


def first_unknown(written: DataFrame, index: DataFrame, key: list[str], k: int = KEEP_UNKNOWN) -> DataFrame:
    """(key..., word, rank): the first k words of three letters or more that the index lacks."""
    lacking = used_against(written, index, key).where("available = 0 and char_length(word) > 2")
    spot = Window.partitionBy(*key).orderBy("first")
    return lacking.withColumn("rank", F.row_number().over(spot)).where(F.col("rank") <= k).select(*key, "word", "rank")


def recall(written: DataFrame, index: DataFrame, key: list[str], owners: DataFrame | None = None) -> DataFrame:
    """(key..., words, found, recall): how much of the index, words of two letters or more, the written text has. Keys of
    `owners` without such words have all."""
    have = written.groupBy(*key, "word").agg(F.count("*").alias("have"))
    pairs = index.where("char_length(word) >= 2").join(have, [*key, "word"], "left").fillna(0, ["have"])
    found = pairs.groupBy(*key).agg(
        F.sum("n").alias("words"), F.sum(F.least("n", "have")).alias("found"), F.round(F.sum(F.least("n", "have")) / F.sum("n"), 6).alias("recall")
    )
    return _for_all(found, owners, key, "recall")


def agreement(written: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """(key..., words, known, percent): written words that the index has at all, whole percent."""
    pairs = used_against(written, index, key)
    known = F.sum(F.when(F.col("available") > 0, F.col("used")).otherwise(0))
    return pairs.groupBy(*key).agg(F.sum("used").alias("words"), known.alias("known"), F.round(100 * known / F.sum("used")).cast("int").alias("percent"))


def repeated_lines(lines: DataFrame, owner: str, page: str, line: Column, least: int, share: float = 0.0, most_chars: int = 90) -> DataFrame:
    """(owner, key, pages): short lines on at least `least` pages, and at least `share` of all pages, of an owner."""
    short = lines.where(F.char_length(F.trim(line)).between(1, most_chars)).select(owner, page, compare_key(line).alias("key")).where("key <> ''")
    counts = short.distinct().groupBy(owner, "key").agg(F.count("*").alias("pages"))
    totals = lines.groupBy(owner).agg(F.countDistinct(page).alias("total"))
    return counts.join(totals, owner).where(F.col("pages") >= F.greatest(F.lit(least), F.ceil(F.lit(share) * F.col("total")))).select(owner, "key", "pages")
