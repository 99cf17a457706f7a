"""Page numbers, spreads, intervals and paragraphs across page breaks; everything is per owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import joined_halves, runs_on


def offset_segments(pages: DataFrame, owner: str, pdf: str, printed: str, step: int = 1) -> DataFrame:
    """(owner, from_page, to_page, offset, support): runs of pages with the same printed number offset.

    Pages without a number vote nothing. Runs of one vote are misreadings once there are four votes;
    equal neighbours merge; the first segment begins at page 1 and each ends where the next begins.
    """
    per = Window.partitionBy(owner)
    votes = pages.where(F.col(printed).isNotNull()).select(owner, F.col(pdf).alias("pdf"), (F.col(printed) - F.col(pdf) * step).alias("offset"))
    last = pages.groupBy(owner).agg(F.max(pdf).alias("last"))

    def runs(df: DataFrame) -> DataFrame:
        spot = per.orderBy("pdf")
        changed = F.coalesce((F.col("offset") != F.lag("offset").over(spot)).cast("int"), F.lit(1))
        return df.withColumn("run", F.sum(changed).over(spot))

    first = runs(votes).groupBy(owner, "run", "offset").agg(F.min("pdf").alias("pdf"), F.count("*").alias("support"))
    total = F.sum("support").over(per)
    kept = first.withColumn("total", total).where("support >= 2 or total < 4").drop("run", "total")
    merged = runs(kept).groupBy(owner, "run", "offset").agg(F.min("pdf").alias("pdf"), F.sum("support").alias("support"))
    spot = per.orderBy("pdf")
    ends = merged.join(last, owner).select(
        owner,
        F.when(F.lag("pdf").over(spot).isNull(), F.lit(1)).otherwise(F.col("pdf")).cast("long").alias("from_page"),
        F.coalesce(F.lead("pdf").over(spot) - 1, F.col("last")).cast("long").alias("to_page"),
        F.col("offset").cast("long").alias("offset"),
        F.col("support").cast("long").alias("support"),
    )
    return ends


def folio_lookup(pages: DataFrame, segments: DataFrame, owner: str, pdf: str, step: int = 1) -> DataFrame:
    """Pages with `folio`, the printed number their segment gives them (null outside all segments)."""
    s = segments.select(F.col(owner).alias("__o"), "from_page", "to_page", "offset")
    inside = (pages[owner] == F.col("__o")) & pages[pdf].between(F.col("from_page"), F.col("to_page"))
    return pages.join(s, inside, "left").select(*[pages[c] for c in pages.columns], (pages[pdf] * step + F.col("offset")).alias("folio"))


def page_ranges(pages: DataFrame, owner: str, page: str) -> DataFrame:
    """(owner, ranges): distinct page numbers written as "12-15,18"."""
    numbers = pages.select(owner, F.col(page).alias("p")).distinct()
    island = F.col("p") - F.row_number().over(Window.partitionBy(owner).orderBy("p"))
    runs = numbers.withColumn("island", island).groupBy(owner, "island").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    label = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    listed = F.sort_array(F.collect_list(F.struct("a", label.alias("label"))))
    return runs.groupBy(owner).agg(F.array_join(F.transform(listed, lambda x: x["label"]), ",").alias("ranges"))


def seams(paragraphs: DataFrame, owner: str, page: str, order: str, text: str, flagged: Column | None = None) -> DataFrame:
    """(owner, page, next_page, joined): last and first paragraphs of neighbouring pages that are one."""
    ends = paragraphs.groupBy(owner, page).agg(F.max_by(text, order).alias("last"), F.min_by(text, order).alias("first"))
    spot = Window.partitionBy(owner).orderBy(page)
    pairs = ends.select(owner, page, F.lead(page).over(spot).alias("next_page"), "last", F.lead("first").over(spot).alias("after")).where("after is not null")
    torn = runs_on(F.col("last"), F.col("after"), flagged if flagged is not None else F.lit(False))
    return pairs.where(torn).select(owner, page, "next_page", joined_halves(F.col("last"), F.col("after")).alias("joined"))


def interval_assign(starts: DataFrame, points: DataFrame, owner: str, order: Column, start_id: str) -> DataFrame:
    """Points with `start_id` of the last start at or before them (null before the first).

    As-of join without a join: both are one ordered stream per owner, and the last start seen is carried.
    """
    spot = Window.partitionBy(owner).orderBy("__at", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = starts.select(owner, order.alias("__at"), F.lit(0).alias("__kind"), F.col(start_id).alias("__start"))
    both = points.withColumns({"__at": order, "__kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    carried = both.withColumn(start_id, F.last("__start", ignorenulls=True).over(spot)) if start_id not in points.columns else None
    if carried is None:
        raise ValueError(f"points already have a column {start_id}")
    return carried.where("__kind = 1").drop("__at", "__kind", "__start")


def transitions(starts: DataFrame, owner: str, page: str, name: str) -> DataFrame:
    """(owner, from_name, to_name, page): neighbouring starts in page order; equal starts count once."""
    one = starts.groupBy(owner, page).agg(F.min(name).alias("n"))
    spot = Window.partitionBy(owner).orderBy(page)
    return one.select(owner, F.lag("n").over(spot).alias("from_name"), F.col("n").alias("to_name"), page).where("from_name is not null")


def spreads(pages: DataFrame, owner: str, pdf: str, facing: str, printed: str) -> DataFrame:
    """(owner, left_page, right_page, mutual): facing pages. Both sides say so, or one does and the
    left page has an even printed number. A page is in one pair at most: of a chain the odd places open pairs."""
    spot = Window.partitionBy(owner).orderBy(pdf)
    nxt = lambda c: F.lead(c).over(spot)
    forward, back = F.col(facing) == "next", nxt(facing) == "previous"
    pair = (nxt(pdf) == F.col(pdf) + 1) & ((forward & back) | ((forward | back) & (F.col(printed) % 2 == 0)))
    marked = pages.select(owner, F.col(pdf).alias("p"), pair.alias("pair"), (forward & back).alias("mutual")).where("pair")
    island = F.col("p") - F.row_number().over(Window.partitionBy(owner).orderBy("p"))
    place = F.row_number().over(Window.partitionBy(owner, "island").orderBy("p"))
    chosen = marked.withColumn("island", island).withColumn("place", place).where("place % 2 = 1")
    return chosen.select(owner, F.col("p").alias("left_page"), (F.col("p") + 1).alias("right_page"), F.coalesce("mutual", F.lit(False)).alias("mutual"))


def shared_pages(owned: DataFrame, page: str, owner: str) -> DataFrame:
    """(page, owners, shared): number of distinct owners of each page, and whether it has several."""
    return owned.select(page, owner).distinct().groupBy(page).agg(F.count("*").alias("owners")).withColumn("shared", F.col("owners") > 1)


def stitched(pieces: DataFrame, owner: str, page: str, order: str, starts: str, from_page: str) -> DataFrame:
    """Pieces with `article`: the number of the article, per owner, that each belongs to.

    A piece that starts opens an article; one that does not belongs to the running one. A piece
    that says which page it continues from goes to the article that was last on that page, however many
    others came between. Pieces before the first start are article 0. Pages that are no part of any
    article are left out before.
    """
    spot = Window.partitionBy(owner).orderBy(page, order)
    running = F.sum(F.col(starts).cast("int")).over(spot.rowsBetween(Window.unboundedPreceding, 0))
    numbered = pieces.withColumn("__run", running)
    last = numbered.groupBy(F.col(owner).alias("__o"), F.col(page).alias("__p")).agg(F.max_by("__run", order).alias("__there"))
    jumped = numbered.join(last, (F.col(owner) == F.col("__o")) & (F.col(from_page) == F.col("__p")) & ~F.col(starts) & (F.col(from_page) < F.col(page)), "left")
    return jumped.withColumn("article", F.coalesce("__there", "__run")).drop("__run", "__o", "__p", "__there")


def merged_by_verdict(articles: DataFrame, owner: str, order: str, verdict: str, merge: str = "same") -> DataFrame:
    """(owner, first, last, parts): neighbouring articles joined where the verdict on the boundary before one says so.

    Verdicts count in page order; a first article's own verdict has nothing to join.
    """
    spot = Window.partitionBy(owner).orderBy(order)
    opens = F.when((F.col(verdict) == merge) & F.lag(order).over(spot).isNotNull(), 0).otherwise(1)
    runs = articles.withColumn("__open", opens).withColumn("__run", F.sum("__open").over(spot))
    return runs.groupBy(owner, "__run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("parts")).drop("__run")
