import json

from pyspark.sql import functions as F

from quire.operators import align, coverage, layout, markup, ops_log, package, pages
from quire.sources import archive
from quire.streaming import live


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_offsets(spark):
    folio = [(1, None), (2, None), (3, 1), (4, 2), (5, 9), (6, 4), (7, 5), (8, 1), (9, 2)]
    df = spark.createDataFrame([("m", *x) for x in folio], "owner string, pdf int, printed int")
    assert rows(pages.offset_segments(df, "owner", "pdf", "printed"), "from_page", "to_page", "offset", "support") == [(1, 7, -2, 4), (8, 9, -7, 2)]
    found = pages.folio_lookup(df, pages.offset_segments(df, "owner", "pdf", "printed"), "owner", "pdf")
    assert rows(found, "pdf", "folio")[4] == (5, 3)


def test_page_ranges_and_spreads(spark):
    df = spark.createDataFrame([("a", p) for p in (12, 13, 14, 15, 18, 18)], "o string, p int")
    assert rows(pages.page_ranges(df, "o", "p"), "ranges") == [("12-15,18",)]
    facing = [(1, "none", 1), (2, "next", 2), (3, "previous", 3), (4, "next", 4), (5, "none", 5)]
    df = spark.createDataFrame([("m", *x) for x in facing], "o string, pdf int, facing string, printed int")
    assert rows(pages.spreads(df, "o", "pdf", "facing", "printed"), "left_page", "mutual") == [(2, True), (4, False)]


def test_boxes(spark):
    df = spark.createDataFrame([(1, i, *map(float, b)) for i, b in enumerate([(0, 0, 10, 10), (11, 0, 10, 10), (22, 0, 10, 10), (60, 60, 5, 5)])], "page int, box int, x double, y double, w double, h double")
    assert rows(layout.groups(df, "page", "box", 1.5), "box", "group") == [(0, 0), (1, 0), (2, 0), (3, 3)]
    assert rows(layout.mosaics(df, "page", "box", 1.5), "group", "pieces", "width", "height") == [(0, 3, 32.0, 10.0)]


def test_decorative(spark):
    data = [(1, 10, 300, 50, 50, 5.0, None), (2, 300, 300, 5, 50, 5.0, None), (3, 300, 300, 500, 20, 5.0, None), (4, 300, 300, 20, 20, 0.1, None), (5, 300, 300, 100, 100, 8.0, None), (6, 300, 300, 100, 100, 8.0, "t")]
    df = spark.createDataFrame(data, "id int, pw int, ph int, w int, h int, area double, part string")
    got = df.select("id", layout.decorative_reason(*map(F.col, ("pw", "ph", "w", "h", "area", "part"))).alias("r"))
    assert [x[1] for x in rows(got, "id", "r")] == ["pixels", "points", "aspect", "share", None, "shard"]


def test_nearest_text(spark):
    image = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 100.0)], "page int, id int, x double, y double, w double, h double")
    near = [("under", 0.0, 110.0, 80.0, 10.0), ("far", 0.0, 300.0, 80.0, 10.0), ("side", 105.0, 10.0, 50.0, 10.0)]
    text = spark.createDataFrame([(1, *t) for t in near], "page int, text string, x double, y double, w double, h double")
    assert rows(layout.nearest_text(image, text, "page", "id"), "nearby") == [("under",)]


def test_index_check(spark):
    source = spark.createDataFrame([(1, "een twee twee drie")], "k int, t string")
    written = spark.createDataFrame([(1, "een twee twee twee vier")], "k int, t string")
    index = coverage.words(source, ["k"], F.col("t")).groupBy("k", "word").agg(F.count("*").alias("n"))
    got = coverage.index_check(coverage.words(written, ["k"], F.col("t")), index, ["k"]).first()
    assert (got["used"], got["backed"], got["score"], got["n_unknown"], got["n_overused"]) == (5, 3, 0.6, 1, 1)


def test_repeated_lines_share(spark):
    data = [("m", p, "Blad 7") for p in (1, 2, 3)] + [("m", p, "Tekst") for p in (1, 4)] + [("m", 5, "slot")]
    df = spark.createDataFrame(data, "o string, p int, t string")
    assert rows(coverage.repeated_lines(df, "o", "p", F.col("t"), 2, 0.6), "key", "pages") == [("blad 7", 3)]


def test_spelling(spark):
    words = [("dümny", False), ("dûmny", True), ("gáát", False), ("gaat", True), ("een", False), ("één", True), ("cafe", False), ("café", True)]
    assert rows(align.respellings(spark.createDataFrame(words, "word string, known boolean")), "word", "correction") == [("dümny", "dûmny")]


def test_near_words(spark):
    s = spark.createDataFrame([(1, "worde", 0), (1, "wordt", 1), (1, "zzz", 2)], "k int, word string, ord int")
    t = spark.createDataFrame([(1, "wordt", 0), (1, "words", 1)], "k int, word string, ord int")
    # suspects choose in their order, so the first takes the first of equally close words
    assert rows(align.near_words(s, t, "k"), "word", "near", "edits") == [("worde", "wordt", 1), ("wordt", "words", 1)]


def test_best_line_ties_and_threshold(spark):
    s = spark.createDataFrame([(1, "de rode kat slaapt"), (2, "niets van dit al"), (3, "")], "sid int, text string")
    t = spark.createDataFrame([(1, 0, "een rode kat slaapt nu"), (1, 1, "de rode kat eet"), (0, 5, "niets hier"), (2, 0, None)], "d int, l int, text string")
    assert rows(align.best_lines(s, t, "sid", ["d", "l"]), "sid", "d", "l", "overlap") == [(1, 1, 0, 3)]


def test_rate_limit_window(spark):
    df = spark.range(12).selectExpr("'c' client", "timestamp_seconds(id * 60) at", "id").where("id < 11")
    got = rows(ops_log.rate_limited(df, "client", "at", 600, 10), "id", "tries", "retry_after")
    assert got[-1] == (9, 10, None) or (10, 10, None) in got
    assert (9, 10, 60) in rows(ops_log.rate_limited(df, "client", "at", 600, 9), "id", "tries", "retry_after")


def test_slots(spark):
    df = spark.createDataFrame([(i, a) for i, a in enumerate((0, 0, 5000, 5100, 20000))], "i int, a long").withColumn("q", F.lit(1))
    assert [x[1] for x in rows(ops_log.slots(df, "q", F.col("a"), ["i"], 1000), "i", "starts_at")] == [0, 1000, 5000, 6000, 20000]


def test_slots_of_a_long_queue(spark):
    df = spark.range(3000).selectExpr("'q' as q", "id as i", "cast(0 as bigint) as a")
    last = ops_log.slots(df, "q", F.col("a"), ["i"], 1_000_000).agg(F.max("starts_at")).first()[0]
    assert last == 2999 * 1_000_000


def test_retry(spark):
    cols = "k string, a int, used int, unknown int, over int"
    data = [("x", 0, 100, 8, 2), ("x", 1, 85, 0, 0), ("y", 0, 100, 8, 2), ("y", 1, 95, 8, 1)]
    assert rows(ops_log.better_retry(spark.createDataFrame(data, cols), "k", "a", "used", "unknown", "over"), "k", "a") == [("x", 0), ("y", 1)]


def test_markers(spark):
    page = "## Kop\n~ Inleiding\nEen regel\nverder\n\n- a\n- b\n\n- alleen\n[insert]\n## Kader\n1. x\n2. y\n"
    got = markup.parse_markers(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t").orderBy("ord").collect()
    assert [(r["kind"], r["box"], r["items"] or r["text"]) for r in got] == [
        ("heading", 0, "Kop"), ("lead", 0, "Inleiding"), ("paragraph", 0, "Een regel verder"), ("list", 0, ["a", "b"]), ("paragraph", 0, "alleen"),
        ("heading", 1, "Kader"), ("ordered", 1, ["x", "y"]),
    ]


def test_json_repair(spark):
    texts = ['{"a": 1, "b": [1, 2', '{"a": "x, y", "b": "cut', '{"a": 1}', "{", "nothing", None, '{"a": {"b": 1, "c"']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r["r"] for r in df.select("i", markup.repaired_json(F.col("t")).alias("r")).orderBy("i").collect()]
    assert [g and json.loads(g) for g in got] == [{"a": 1, "b": [1, 2]}, {"a": "x, y"}, {"a": 1}, {}, None, None, {"a": {"b": 1}}]


def test_archives(spark):
    files = spark.createDataFrame([(1, [("a.txt", b"x"), ("a.txt", b"y"), ("__MACOSX/z", b"")]), (2, [])], "k int, files array<struct<path string, content binary>>")
    made = archive.write_archives(files, "k")
    assert rows(archive.read_archives(made, "k"), "k", "path", "error") == [(1, "a.txt", None)]
    broken = spark.createDataFrame([(3, b"no archive"), (4, None)], "k int, archive binary")
    assert rows(archive.read_archives(broken, "k"), "k", "error") == [(3, "BadZipFile"), (4, "BadZipFile")]


def test_package_rejects(spark):
    df = spark.createDataFrame([(1, "no json"), (2, '{"version": 2, "nodes": []}'), (3, '﻿{"version": 1, "external_id": "e", "nodes": [{"ord": 0, "kind": "heading", "text": "t"}]}')], "k int, p string")
    assert rows(package.read_packages(df, "k", "p"), "k", "kind", "text") == [(3, "heading", "t")]


def test_html_is_escaped(spark):
    nodes = spark.createDataFrame([(1, 0, "paragraph", 'a < b & "c"')], "k int, ord int, kind string, text string")
    assert package.html(nodes, "k").first()["html"] == "<p>a &lt; b &amp; &quot;c&quot;</p>"


def test_fold_batch(spark):
    df = spark.createDataFrame([(1, 1, "ab"), (1, 2, "\f"), (1, 3, "cd"), (2, 1, None)], "k int, o int, t string")
    assert rows(live.fold_text_batch(df, "k", "o", "t"), "k", "text") == [(1, "cd"), (2, "")]


def test_first_of_similar_is_greedy(spark):
    data = [(1, 5, 0, "grote reis naar zee"), (1, 5, 1, "reis zee"), (1, 5, 2, "iets anders"), (1, 6, 3, "grote reis naar zee"), (1, 5, 4, None)]
    df = spark.createDataFrame(data, "m int, n int, ord int, title string")
    assert rows(align.first_of_similar(df, ["m", "n"], "ord", "title"), "ord") == [(0,), (2,), (3,)]  # no title, no entry


def test_stitched_articles(spark):
    data = [(1, False, None), (2, True, None), (3, False, None), (4, True, None), (5, False, 3), (6, False, None)]
    df = spark.createDataFrame([("m", p, 0, s, f) for p, s, f in data], "o string, p int, i int, s boolean, f int")
    assert [a for _, a in rows(pages.stitched(df, "o", "p", "i", "s", "f"), "p", "article")] == [0, 1, 1, 2, 1, 2]


def test_containing(spark):
    q = spark.createDataFrame([(1, "rode kat slaapt"), (2, "kat"), (3, "nergens te vinden"), (4, "de kat")], "q int, text string")
    t = spark.createDataFrame([(5, "de rode kat slaapt nu"), (6, "een kat"), (7, None)], "t int, text string")
    assert rows(align.containing(q, t, "q", "t"), "q", "t") == [(1, 5), (2, 5), (4, 5)]  # "rode kat" holds "de kat"


def test_place_fragments(spark):
    from quire.operators.placing import place_fragments

    blocks = [(1, 0, "De kat zag de kat."), (1, 1, "Een café in Parijs, onvergetelijke dagen"), (2, 0, "niets")]
    asked = [(1, 0, "kat", "zag de"), (1, 1, "cafe", ""), (1, 2, "onvergetelijkke dagen", ""), (1, 3, "kat", "De"), (1, 4, "ontbreekt", ""), (2, 0, None, None)]
    b = spark.createDataFrame(blocks, "page int, block int, text string")
    f = spark.createDataFrame(asked, "page int, fragment int, text string, before string")
    got = rows(place_fragments(b, f, "page"), "page", "fragment", "block", "start", "how")
    assert got == [(1, 0, 0, 14, "context"), (1, 1, 1, 4, "alone"), (1, 2, 1, 20, "near"), (1, 3, None, None, None), (1, 4, None, None, None), (2, 0, None, None, None)]


def test_context_goes_on_over_line_ends(spark):
    from quire.operators.placing import place_fragments

    text = "Hij zag de kat.\nDe de de hond"  # accents and case aside, "de de" begins at "De" too
    b = spark.createDataFrame([(1, 0, text)], "page int, block int, text string")
    f = spark.createDataFrame([(1, 0, "de de", "de kat.\nDe")], "page int, fragment int, text string, before string")
    assert rows(place_fragments(b, f, "page"), "start", "how") == [(text.index("de de"), "context")]
    f = spark.createDataFrame([(1, 0, "de de", "zag de kat. De")], "page int, fragment int, text string, before string")
    assert rows(place_fragments(b, f, "page"), "start", "how") == [(text.index("de de"), "context")]
