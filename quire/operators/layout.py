"""Boxes on a page: decoration, hero images, touching groups, nearby text, body type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.sources.shared import checkpointed


def decorative_reason(width: Column, height: Column, w: Column, h: Column, area_pct: Column, part_of: Column) -> Column:
    """Why an image is decoration: shard, pixels, points, aspect or share; null if it is not."""
    aspect = w / h
    return (
        F.when(part_of.isNotNull(), "shard")
        .when(F.least(width, height) < 20, "pixels")
        .when(F.least(w, h) < 8, "points")
        .when((aspect > 20) | (aspect < 1 / 20), "aspect")
        .when(area_pct < 0.15, "share")
    )


def hero(images: DataFrame, owner: str, page: str, area: str, ident: str, least: float) -> DataFrame:
    """(owner, hero): the largest image of the first page if its area is at least `least`."""
    first = images.withColumn("__first", F.min(page).over(Window.partitionBy(owner))).where(F.col(page) == F.col("__first"))
    best = first.groupBy(owner).agg(F.max(F.struct(F.col(area).alias("a"), (-F.col(ident)).alias("i"))).alias("best"))
    return best.where(F.col("best.a") >= least).select(owner, (-F.col("best.i")).alias("hero"))


def touching(boxes: DataFrame, page: str, ident: str, gap: float) -> DataFrame:
    """(page, a, b), a < b: boxes (x, y, w, h) of a page that touch within `gap`, both axes."""
    a = boxes.select(F.col(page).alias("__p"), F.col(ident).alias("a"), *[F.col(c).alias(f"a{c}") for c in "xywh"])
    b = boxes.select(F.col(page).alias("__q"), F.col(ident).alias("b"), *[F.col(c).alias(f"b{c}") for c in "xywh"])
    near = (
        (F.col("ax") <= F.col("bx") + F.col("bw") + gap) & (F.col("bx") <= F.col("ax") + F.col("aw") + gap)
        & (F.col("ay") <= F.col("by") + F.col("bh") + gap) & (F.col("by") <= F.col("ay") + F.col("ah") + gap)
    )
    return a.join(b, (F.col("__p") == F.col("__q")) & (F.col("a") < F.col("b")) & near).select(F.col("__p").alias(page), "a", "b")


def groups(boxes: DataFrame, page: str, ident: str, gap: float) -> DataFrame:
    """(page, ident, group): components of touching boxes; group is the smallest ident."""
    return _components(touching(boxes, page, ident, gap), boxes, page, ident)


def _components(links: DataFrame, boxes: DataFrame, page: str, ident: str) -> DataFrame:
    """(page, ident, group) from links (page, a, b): all pages at once take the smallest label around them, and then that label's own
    label, so that a chain of n boxes settles in about log n rounds."""
    both = checkpointed(links.union(links.select(page, F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = boxes.select(page, F.col(ident).alias("a"), F.col(ident).alias("g"))
    while True:
        nearest = both.join(labels.select(page, F.col("a").alias("b"), F.col("g").alias("ng")), [page, "b"]).groupBy(page, "a").agg(F.min("ng").alias("ng"))
        step = checkpointed(labels.join(nearest, [page, "a"], "left").select(page, "a", F.least("g", F.coalesce("ng", "g")).alias("g"), (F.col("ng") < F.col("g")).alias("moved")))
        if step.where("moved").limit(1).count() == 0:
            return step.select(page, F.col("a").alias(ident), F.col("g").alias("group"))
        jump = step.select(page, F.col("a").alias("g"), F.col("g").alias("further"))
        labels = checkpointed(step.join(jump, [page, "g"]).select(page, "a", F.col("further").alias("g")))


#: Of the larger line's height: how far runs of one block may be apart, down and across.
LINE_DOWN, LINE_ACROSS = 0.9, 0.8


def adjacent_runs(runs: DataFrame, page: str, ident: str, cell: float = 64.0) -> DataFrame:
    """(page, a, b), each pair once: runs of text (x, y, w, h, chars) on the same line or the next that overlap or nearly so across.

    The larger run reaches out by its own measure, so pairs meet in grid cells of `cell` points: the cells of what the larger
    one reaches and of the smaller one itself. A pair counts in the cell where both begin to overlap alone. Runs without characters or
    size are none.
    """
    usable = runs.where("chars > 0 and w > 0 and h > 0").select(page, ident, "x", "y", "w", "h")
    at = lambda c: F.floor(c / cell)

    def celled(df: DataFrame, name: str, across: Column, down: Column) -> DataFrame:
        x0, x1, y0, y1 = F.col("x") - across, F.col("x") + F.col("w") + across, F.col("y") - down, F.col("y") + F.col("h") + down
        grid = df.select(page, F.col(ident).alias(name), F.struct("x", "y", "w", "h", x0.alias("x0"), y0.alias("y0")).alias(f"{name}_"), F.explode(F.sequence(at(x0), at(x1))).alias("cx"), F.sequence(at(y0), at(y1)).alias("cys"))
        return grid.select(page, name, f"{name}_", "cx", F.explode("cys").alias("cy"))

    big = celled(usable, "a", F.col("h") * LINE_ACROSS, F.col("h") * LINE_DOWN)
    small = celled(usable, "b", F.lit(0.0), F.lit(0.0))
    met = big.join(small, [page, "cx", "cy"])
    larger = (F.col("a_.h") > F.col("b_.h")) | ((F.col("a_.h") == F.col("b_.h")) & (F.col("a") < F.col("b")))
    gap = lambda c, size: F.greatest(f"a_.{c}", f"b_.{c}") - F.least(F.col(f"a_.{c}") + F.col(f"a_.{size}"), F.col(f"b_.{c}") + F.col(f"b_.{size}"))
    near = (gap("y", "h") <= F.col("a_.h") * LINE_DOWN) & (gap("x", "w") <= F.col("a_.h") * LINE_ACROSS)
    here = (F.col("cx") == at(F.greatest("a_.x0", "b_.x0"))) & (F.col("cy") == at(F.greatest("a_.y0", "b_.y0")))
    return met.where(larger & near & here).select(page, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def text_blocks(runs: DataFrame, page: str, ident: str, cell: float = 64.0) -> DataFrame:
    """(page, block, runs, x, y, w, h, chars): runs that sit together as one box each; `block` is the smallest ident."""
    usable = runs.where("chars > 0 and w > 0 and h > 0")
    home = _components(adjacent_runs(runs, page, ident, cell), usable, page, ident).withColumnRenamed("group", "block")
    made = usable.join(home, [page, ident]).groupBy(page, "block").agg(
        F.count("*").alias("runs"), F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.sum("chars").alias("chars")
    )
    return made.select(page, "block", "runs", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"), "chars")


def mosaics(boxes: DataFrame, page: str, ident: str, gap: float, least: int = 3, largest_share: float = 0.6) -> DataFrame:
    """(page, group, pieces, width, height): groups of at least `least` boxes, none of which fills
    `largest_share` of the group's own box."""
    g = groups(boxes, page, ident, gap).join(boxes, [page, ident])
    out = g.groupBy(page, "group").agg(
        F.count("*").alias("pieces"),
        (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("width"),
        (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("height"),
        F.max(F.col("w") * F.col("h")).alias("largest"),
    )
    return out.where((F.col("pieces") >= least) & (F.col("largest") < largest_share * F.col("width") * F.col("height"))).drop("largest")


def weighted_mode(df: DataFrame, owner: str, value: Column, weight: Column, name: str) -> DataFrame:
    """(owner, name, weight): the value with the largest total weight; the smaller value wins ties."""
    sums = df.groupBy(owner, value.alias(name)).agg(F.sum(weight).alias("weight"))
    best = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("weight"), name))
    return sums.withColumn("__r", best).where("__r = 1").drop("__r")


def nearest_text(images: DataFrame, text: DataFrame, page: str, ident: str, most: int = 3) -> DataFrame:
    """(page, ident, nearby): text close to an image: below it within 36 points, else above within 36,
    else beside within 18; below and above need 40 % overlap in x. At most `most` lines, nearest first."""
    i = images.select(F.col(page).alias("__p"), F.col(ident).alias("__i"), *[F.col(c).alias(f"i{c}") for c in "xywh"])
    t = text.select(F.col(page).alias("__q"), F.col("text"), *[F.col(c).alias(f"t{c}") for c in "xywh"])
    met = i.join(t, F.col("__p") == F.col("__q"))
    overlap = F.least(F.expr("ix + iw"), F.expr("tx + tw")) - F.greatest("ix", "tx")
    wide = overlap >= 0.4 * F.least("iw", "tw")
    below, above = F.expr("ty - (iy + ih)"), F.expr("iy - (ty + th)")
    beside = F.greatest(F.expr("tx - (ix + iw)"), F.expr("ix - (tx + tw)"))
    level = (F.expr("least(iy + ih, ty + th) - greatest(iy, ty)") > 0) & beside.between(0, 18)
    ranked = met.withColumn(
        "rank", F.when(wide & below.between(0, 36), 1).when(wide & above.between(0, 36), 2).when(level, 3)
    ).where("rank is not null").withColumn("far", F.when(F.col("rank") == 1, below).when(F.col("rank") == 2, above).otherwise(beside))
    best = ranked.withColumn("b", F.min("rank").over(Window.partitionBy("__p", "__i"))).where("rank = b")
    lines = F.slice(F.sort_array(F.collect_list(F.struct("far", "text"))), 1, most)
    return best.groupBy(F.col("__p").alias(page), F.col("__i").alias(ident)).agg(F.array_join(F.transform(lines, lambda x: x["text"]), " ").alias("nearby"))


def face_of_type(blocks: DataFrame, container: str, style: str, marked: Column, share: float = 0.5) -> DataFrame:
    """(container, style, share): styles that more than `share` of a container's blocks wear whole:
    they are the face of the type there, not emphasis."""
    counts = blocks.groupBy(container).agg(F.count("*").alias("all"))
    whole = blocks.where(marked).groupBy(container, style).agg(F.count("*").alias("n"))
    out = whole.join(counts, container).select(container, style, F.round(F.col("n") / F.col("all"), 6).alias("share"))
    return out.where(F.col("share") > share)


def unplaced(images: DataFrame, ident: list[str], reason: Column, used: DataFrame) -> DataFrame:
    """Ids of images that are no decoration and that no placed block uses."""
    return images.where(reason.isNull()).select(*ident).join(used.select(*ident), ident, "left_anti")
