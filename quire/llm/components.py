"""Connected components of a link table as Spark jobs (alternating star contraction).

No link, component or label goes through the driver; only three numbers a round do
(edge count and two checksums, to see that nothing changed any more).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import removed, written


def _to_minimum(links: DataFrame) -> DataFrame:
    """(u, v) rows with u > v, each once."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every id in `links(a, b)`; component is the smallest id reachable.

    Large-star and small-star steps in turn (Kiveris et al., 2014): the first ties larger
    neighbours to the local minimum, the second smaller ones. Ends when the set of links is a
    set of stars. Null ends and self links are ignored; an empty table gives an empty result.
    An id that only links to itself is not returned: its component is itself. Only the last round's links stay on disk.
    """

    def next_(old: DataFrame, new: DataFrame) -> DataFrame:
        out = written(_to_minimum(new), "edges")
        removed(old)
        return out

    edges = written(_to_minimum(links.select(F.col("a").alias("u"), F.col("b").alias("v")).dropna()), "edges")
    seen = None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1000003), F.sum(F.hash("v", "u").cast("long"))).first()
        if mark == seen or mark[0] == 0:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
                edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            )
        seen = mark
        # large star: around every node, larger neighbours go to the minimum
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = next_(edges, both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        # small star: smaller neighbours and the node itself go to the minimum
        low = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = next_(edges, small.union(low.select("u", F.col("m").alias("v"))))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
