from pyspark.sql import functions as F

from quire.operators import align


def test_every_suspect_of_a_large_turn_is_paired(spark):
    """Eight and eight words at equal distance: each round pairs one."""
    s = spark.createDataFrame([(1, f"woord{c}", i) for i, c in enumerate("abcdefgh")], "k int, word string, ord int")
    t = spark.createDataFrame([(1, f"woord{c}", i) for i, c in enumerate("stuvwxyz")], "k int, word string, ord int")
    out = align.near_words(s, t, "k").collect()
    assert sorted((r["word"], r["near"]) for r in out) == [(f"woord{a}", f"woord{b}") for a, b in zip("abcdefgh", "stuvwxyz")]


def test_what_is_left_takes_the_closest_word_of_its_own_turn(spark):
    s = spark.createDataFrame([(1, "abcdefgh", 0), (1, "wordx", 1), (2, "alone", 0)], "k int, word string, ord int")
    t = spark.createDataFrame([(1, "xbcdzzzy", 0), (1, "words", 1), (1, "qqqqqqqqqq", 2), (3, "alone", 0)], "k int, word string, ord int")
    out = align.near_words(s, t, "k").orderBy(F.col("word")).collect()
    assert [(r["word"], r["near"], r["edits"]) for r in out] == [("abcdefgh", "xbcdzzzy", 5), ("wordx", "words", 1)]
