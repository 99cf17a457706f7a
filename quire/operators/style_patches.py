"""Style marks found on a page, laid on the texts of its blocks.

`parts` are the texts that can carry a mark, in printed order: (page, block, kind, part, part_kind, text), where `kind` is that of
the block at the top (a paragraph, a list with an item to each part, an insert with its children's texts, or another kind without parts) and
`part_kind` that of the block the text stands in; `child` tells the blocks inside an insert apart. A heading inside a box is no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.shared import written

#: A mark is a whole block's if it covers so much of it, and the block has so many characters.
WHOLE_SHARE, WHOLE_LEAST = 0.9, 30
#: Whole blocks with a mark that make it the face of a box, and the share of a page's blocks that makes it the page's.
BOX_LIMIT, PAGE_SHARE = 1, 0.5
BODY = ("paragraph", "list")


def times(text: Column, needle: Column) -> Column:
    """How often a text holds a needle, overlapping places counted; an empty needle is nowhere."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    return F.when(needle == "", 0).otherwise(F.regexp_count(text, quoted))


def accepted(parts: DataFrame, blocks: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches (page, patch, target, find, styles, nth) with `block`: the target if it is on the page, else the first block that
    holds the piece; `block` is null where that block doesn't hold it. `blocks` is (page, block, kind, ord)."""
    asked = patches.withColumn("find", F.trim("find"))
    target = blocks.select("page", F.col("block").alias("target"), F.lit(True).alias("__there"))
    met = asked.select("page", "patch", "find").join(parts.select("page", "block", "text"), "page").where(F.contains("text", "find") & (F.col("find") != ""))
    held = written(met.select("page", "patch", "block").distinct().join(blocks.select("page", "block", "ord"), ["page", "block"]), "held")
    first = held.groupBy("page", "patch").agg(F.min_by("block", "ord").alias("__first"))
    told = asked.select("page", "patch", "target").join(target, ["page", "target"], "left").join(first, ["page", "patch"], "left")
    told = told.select("page", "patch", F.when(F.col("__there"), F.col("target")).otherwise(F.col("__first")).alias("block"))
    inside = told.join(held, ["page", "patch", "block"], "left_semi")  # texts travel once, with the block that was found for them
    return asked.join(inside, ["page", "patch"], "left")


def faces(parts: DataFrame, blocks: DataFrame, placed: DataFrame) -> DataFrame:
    """(page, box, style): marks that swallow whole blocks, so that they are the face of the type. `box` is an insert, or
    empty for the running text: there over half of the paragraphs and lists must be marked whole, in a box one."""
    box = F.when(F.col("kind") == "insert", F.col("block")).otherwise("")
    whole = parts.where(F.col("part_kind").isin(*BODY)).groupBy("page", "block", "child").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "text"))), lambda x: x["text"]), " ")).alias("text")
    )
    covered = placed.join(whole, ["page", "block"]).where(
        (F.char_length("text") >= WHOLE_LEAST) & F.contains("text", "find") & (F.char_length("find") >= F.char_length("text") * WHOLE_SHARE)
    )
    each = covered.select("page", "block", "patch").distinct().join(placed.select("page", "patch", "styles"), ["page", "patch"])
    kinds = blocks.select("page", "block", "kind")
    counts = each.join(kinds, ["page", "block"]).select("page", box.alias("box"), F.explode("styles").alias("style")).groupBy("page", "box", "style").agg(F.count("*").alias("n"))
    body = blocks.where(F.col("kind").isin(*BODY)).groupBy("page").agg(F.count("*").alias("blocks"))
    share = counts.join(body, "page", "left")
    swallowed = F.when(F.col("box") == "", (F.col("blocks") > 0) & (F.col("n") / F.col("blocks") > PAGE_SHARE)).otherwise(F.col("n") >= BOX_LIMIT)
    return share.where(swallowed).select("page", "box", "style")


def apply_styles(parts: DataFrame, blocks: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((page, patch, block, part, at, find, styles), (page, patch, reason)): marks as they are painted, and those that are not.

    `part` is the text that carries a mark and `at` the occurrence inside it, when occurrences are counted over all parts of
    the block in order and the patch asks for number `nth` (from 0). Reasons: `absent`, where the block doesn't hold the piece;
    `face`, where all its styles are the face of the type around it; `beyond`, where there are fewer occurrences than it asks for.
    """
    # what several steps start from is written: each is worked out once, and what was shuffled for it goes
    found = written(accepted(parts, blocks, patches), "found")
    placed = found.where("block is not null")
    box = F.when(F.col("kind") == "insert", F.col("block")).otherwise("")
    refused = faces(parts, blocks, placed).groupBy("page", "box").agg(F.collect_set("style").alias("refused"))
    kept = placed.join(blocks.select("page", "block", "kind"), ["page", "block"]).withColumn("box", box).join(refused, ["page", "box"], "left")
    kept = kept.withColumn("styles", F.when(F.col("refused").isNull(), F.col("styles")).otherwise(F.array_except("styles", "refused")))
    kept = written(kept, "kept")
    left = kept.where(F.size("styles") > 0)

    counted = left.join(parts.select("page", "block", "part", "text"), ["page", "block"]).withColumn("n", times(F.col("text"), F.col("find")))
    before = Window.partitionBy("page", "patch").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    wanted = F.coalesce(F.col("nth"), F.lit(0)) - F.col("before")
    painted = counted.withColumn("at", wanted.cast("int")).where((F.col("at") >= 0) & (F.col("at") < F.col("n")))
    painted = painted.select("page", "patch", "block", "part", "at", "find", "styles")
    absent = found.where("block is null").select("page", "patch", F.lit("absent").alias("reason"))
    face = kept.where(F.size("styles") == 0).select("page", "patch", F.lit("face").alias("reason"))
    beyond = left.select("page", "patch").join(painted.select("page", "patch"), ["page", "patch"], "left_anti").withColumn("reason", F.lit("beyond"))
    return painted, absent.union(face).union(beyond)
