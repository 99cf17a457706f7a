"""Queries of stitching: volumes derived from orders, led by their contents lines or by their pages.

Their rows are compared with an ordered replay, volume by volume, in tests/test_stitching.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.operators import pages, stitching
from quire.sources.shared import written
from quire.sources.tables import table, volumes

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def volume_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """pages, pieces, lines, segments and facing pages of all volumes; what several steps read is worked out once and written."""
    made = {n: written(df, n) for n, df in volumes(*[table(spark, sf_dir, n) for n in ("orders", "lineitem", "part")]).items()}
    segments = written(pages.offset_segments(made["pages"], "owner", "pdf", "printed"), "segments")
    return made | {"segments": segments, "facing": pages.spreads(made["pages"], "owner", "pdf", "facing", "printed")}


def contents_led(spark: SparkSession, sf_dir: str) -> stitching.Stitched:
    v = volume_tables(spark, sf_dir)
    return stitching.by_contents(v["lines"], v["pages"], v["pieces"], v["segments"])


def page_led(spark: SparkSession, sf_dir: str) -> stitching.Stitched:
    return _by_pages(volume_tables(spark, sf_dir))


def _by_pages(v: dict[str, DataFrame]) -> stitching.Stitched:
    return stitching.by_pages(v["pages"], v["pieces"], v["segments"], v["facing"])


@query
def contents_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents_led(spark, sf_dir).articles


@query
def contents_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents_led(spark, sf_dir).owned


@query
def contents_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contents_led(spark, sf_dir).doubtful


@query
def page_led_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of the pages, with what the contents lines say of them."""
    v = volume_tables(spark, sf_dir)
    return stitching.with_contents(_by_pages(v), v["lines"], v["segments"])


@query
def page_led_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_led(spark, sf_dir).owned
