"""What a cut of type means, read against the type that a page's running text is set in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of cuts and their place on the foundries' ladder, the most telling name first; others are REGULAR.
LADDER = (
    (r"(?i)black|heavy|fat|ultra(?!light)", 90),
    (r"(?i)extrabold|ultrabold", 80),
    (r"(?i)semib|demib|semi|demi", 60),
    (r"(?i)bold", 70),
    (r"(?i)medium", 50),
    (r"(?i)book", 45),
    (r"(?i)extralight|ultralight", 20),
    (r"(?i)light", 30),
    (r"(?i)thin|hairline", 10),
)
REGULAR, BOLD = 40, 70
#: Fixed value: names of slanted cuts.
SLANTED = r"(?i)italic|oblique|kursiv"
#: How far sizes may be apart to be that of the running text.
SAME_SIZE = 0.6


def weight(font: Column) -> Column:
    """Place of a cut on the ladder, by its name."""
    return reduce(lambda made, step: F.when(font.rlike(step[0]), step[1]).otherwise(made), reversed(LADDER), F.lit(REGULAR))


def family(font: Column) -> Column:
    """The name without its cut: what stands before the first dash."""
    return F.substring_index(font, "-", 1)


def styles(font: Column, size: Column, body: Column, body_size: Column) -> Column:
    """Styles of a cut: bold by its name, or as a heavier cut of the body's own family at the body's size (to a tenth, or half a
    point); italic by its name. Without a body only the name counts."""
    near = F.abs(size - body_size) <= F.greatest(F.lit(0.5), body_size * 0.1)
    heavier = (family(font) == family(body)) & near & (weight(font) > weight(body))
    bold = (weight(font) >= BOLD) | F.coalesce(heavier, F.lit(False))
    return F.array_compact(F.array(F.when(bold, F.lit("bold")), F.when(font.rlike(SLANTED), F.lit("italic"))))


def body_faces(pieces: DataFrame, page: str, order: str) -> DataFrame:
    """(page, size, font, weight): the size with most characters on a page (the smaller of equals) and the font with most among
    pieces of about that size (of equals the one seen first). White space around pieces doesn't count."""
    chars = F.char_length(F.trim("text"))
    sizes = pieces.groupBy(page, "size").agg(F.sum(chars).alias("n"))
    body = sizes.groupBy(page).agg(F.min_by("size", F.struct(-F.col("n"), "size")).alias("body"))
    near = pieces.join(body, page).where(F.abs(F.col("size") - F.col("body")) <= SAME_SIZE)
    fonts = near.groupBy(page, "body", "font").agg(F.sum(chars).alias("weight"), F.min(order).alias("first")).where("weight > 0")
    best = fonts.groupBy(page, "body").agg(F.min_by(F.struct("font", "weight"), F.struct(-F.col("weight"), "first")).alias("b"))
    return best.select(page, F.col("body").alias("size"), "b.font", "b.weight")


def styled(pieces: DataFrame, page: str, order: str) -> DataFrame:
    """`pieces` with `styles`, each read against the body of its page."""
    body = body_faces(pieces, page, order).select(page, F.col("font").alias("__font"), F.col("size").alias("__size"))
    told = pieces.join(body, page, "left").withColumn("styles", styles(F.col("font"), F.col("size"), F.col("__font"), F.col("__size")))
    return told.drop("__font", "__size")
