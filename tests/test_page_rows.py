"""What is sought inside one page stays in its row: the right rows, and little or nothing that goes through a shuffle."""

from pyspark.sql import functions as F

from quire import catalog
from quire.operators import rules


def shuffles(df):
    """Exchanges in the plan that Spark would run."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def test_sister_lines_stay_in_their_row(spark, sf):
    texts = ["de rode kat slaapt\nde rode kat slaapt\nnu slaapt de rode kat lang\neen twee", "de rode kat slaapt", None, ""]
    pages = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lines = F.split("text", "\n")
    got = rules.said_elsewhere(pages, ["k"], lines, lines).collect()
    assert sorted(map(tuple, got)) == [(0, 0), (0, 1)]  # the third line shares three of its four longer words, too few
    assert shuffles(catalog.QUERIES["sister_lines"](spark, sf)) == 0


def test_page_status_keeps_a_page_in_its_row(spark, sf):
    long = "|| a line of the source with many words " * 20
    rows = [(0, long, long, "other words " * 50, None), (1, long, long, long, None), (2, "", "", None, "time-out"), (3, long + "\n" + long, long, "a line of", None), (4, None, None, None, None)]
    pages = spark.createDataFrame(rows, "k int, source string, clean string, text string, failed string")
    got = {r["k"]: r for r in rules.page_status(pages, ["k"]).collect()}
    assert {k: (r["words"], r["found"], r["written"], r["status"]) for k, r in got.items()} == {0: (140, 20, 100, "extra"), 2: (0, 0, 0, "failed"), 3: (280, 2, 2, "missing")}
    assert got[0]["evidence"].startswith("a line of the source") and got[2]["evidence"] == ""
    assert shuffles(catalog.QUERIES["page_status"](spark, sf)) == 1  # two documents meet in the query itself


def test_unknown_words_are_found_in_their_row(spark, sf):
    for name in ("unknown_word_findings", "changed_word_findings"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan  # words and sentences don't meet by joins, only findings are shuffled, to be numbered


def test_styles_start_from_written_tables(spark, sf):
    for name in ("painted_styles", "dropped_styles"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan and plan.count("Scan parquet") < 9  # each table is worked out once


def test_lines_are_scored_where_they_are(spark, sf):
    plan = catalog.QUERIES["best_line"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1  # only the best lines of a task
