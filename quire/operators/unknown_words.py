"""Words of a written page that its source lacks, each sentence with the source line it came from.

A page is one row; what is sought in it stays in that row: sentences, lines, words and the unknown words are arrays of the
page's own. Only the findings leave it, to be numbered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import bare_line, clipped, in_order, sentences, tokens
from quire.operators.coverage import KEEP_UNKNOWN

#: Words that only marks in the text hold.
MARKERS = ("image", "crop", "img", "insert", "continues", "previous")
#: Findings of a page that are told one by one, and least words left over that make one finding together.
SENTENCES, MANY = 6, 5
#: Least letters of a piece of a broken word, and of what it lacks.
PIECE, REST = 4, 3
EVIDENCE = 260


def nearest_in_order(suspects: Column, others: Column) -> Column:
    """For each suspect in turn the closest word of `others` that no suspect before took, the first of equally close ones:
    array of (word, near, edits). A single other word goes to the first suspect; suspects beyond the others have none."""
    kind = "struct<used: array<string>, out: array<struct<word: string, near: string, edits: int>>>"
    empty = F.from_json(F.lit('{"used": [], "out": []}'), kind)

    def step(s: Column, w: Column) -> Column:
        free = F.filter(F.transform(others, lambda o, i: F.struct(F.levenshtein(w, o).alias("edits"), i.alias("at"), o.alias("near"))), lambda o: ~F.array_contains(s["used"], o["near"]))
        return F.struct(s.alias("s"), w.alias("w"), F.array_min(free).alias("best"))

    def settle(x: Column) -> Column:
        s, best = x["s"], x["best"]
        pair = F.struct(x["w"].alias("word"), best["near"].alias("near"), best["edits"].alias("edits"))
        taken = F.struct(F.array_append(s["used"], best["near"]).alias("used"), F.array_append(s["out"], pair).alias("out"))
        return F.when(best.isNull(), s).otherwise(taken.cast(kind))

    return F.aggregate(suspects, empty, lambda s, w: F.get(F.transform(F.array(step(s, w)), settle), F.lit(0)), lambda s: s["out"])


def _torn(word: Column, line: Column) -> Column:
    """Whether a word of the line is the beginning or the end of `word`, or the other way round, and lacks some letters."""
    near = lambda t: F.startswith(word, t) | F.startswith(t, word) | F.endswith(word, t) | F.endswith(t, word)
    long = lambda t: (F.char_length(t) >= PIECE) & (t != word) & (F.abs(F.char_length(word) - F.char_length(t)) >= REST)
    return (F.char_length(word) >= PIECE) & F.exists(line, lambda t: long(t) & near(t))


def _bound(value: Column, make) -> Column:
    """`make(x)` with x worked out once, however often `make` uses it."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def best_line(sentence: Column, suspects: Column, lines: Column) -> Column:
    """The first of the lines that share most distinct words of three letters or more with the sentence, suspects aside: at
    least half of these words and three of them (or all, if fewer); null if none does or there are fewer than two such words.
    `lines` and `sentence` are (text, words)."""
    own = F.array_distinct(F.filter(sentence["words"], lambda w: (F.char_length(w) > 2) & ~F.array_contains(suspects, w)))

    def chosen(x: Column) -> Column:
        own, counts = x["own"], x["counts"]
        top = F.array_max(counts)
        enough = (F.size(own) >= 2) & (top >= F.least(F.lit(3), F.size(own))) & (top * 2 >= F.size(own))
        return F.when(enough, F.get(lines, F.array_position(counts, top).cast("int") - 1))

    counted = lambda o: F.struct(o.alias("own"), F.transform(lines, lambda c: F.size(F.array_intersect(c["words"], o))).alias("counts"))
    return _bound(_bound(own, counted), chosen)


def _sister(line: Column, sentence: Column, all_sentences: Column) -> Column:
    """Whether another sentence of the page has 0.8 of the line's words of three letters or more, and three of them."""
    goal = F.array_distinct(F.filter(line["words"], lambda w: F.char_length(w) > 2))

    def said(g: Column) -> Column:
        hits = F.transform(all_sentences, lambda z: F.when(z["text"] != sentence["text"], F.size(F.array_intersect(g, z["words"]))).otherwise(0))
        most = F.coalesce(F.array_max(hits), F.lit(0))
        return (F.size(g) >= 2) & (most >= F.least(F.lit(3), F.size(g))) & (most * 5 >= F.size(g) * 4)

    return F.coalesce(_bound(goal, said), F.lit(False))


def unknown_word_findings(pages: DataFrame, key: list[str], written: str, source: str) -> DataFrame:
    """(key, place, kind, words, counterparts, sentence, line) for pages with a written text and its source.

    An unknown word (three letters or more, not in the source; the first 40 of a page count) belongs to the first sentence that
    has it. Torn and joined words, judged against the line their sentence came from, are no finding; nor is a line
    that another sentence of the page says as well. `swap` findings, at most `SENTENCES` a page and numbered by `place`, have the
    sentence's words and the line's words in their stead, closest first come first served. Words without a sentence or line and
    those of further sentences make one `rest` finding if they are `MANY` or more.
    """
    text = F.coalesce(written, F.lit(""))
    empty = F.array().cast("array<string>")
    unknown = F.filter(F.array_except(tokens(F.col(written)), F.coalesce(tokens(F.col(source)), empty)), lambda w: F.char_length(w) > 2)
    ranked = F.transform(F.slice(unknown, 1, KEEP_UNKNOWN), lambda w, i: F.struct((i + 1).alias("rank"), w.alias("word")))
    # generators between the steps: what is worked out below them isn't worked out again for each use above
    asked = pages.select(*key, written, source, F.explode(F.array(F.filter(ranked, lambda x: ~x["word"].isin(*MARKERS)))).alias("__asked")).where(F.size("__asked") > 0)
    lines = F.filter(F.transform(F.split(F.coalesce(source, F.lit("")), r"\n+"), lambda r: bare_line(r)), lambda r: r != "")
    worded = lambda texts: F.transform(texts, lambda t: F.struct(t.alias("text"), tokens(t).alias("words")))
    whole = F.struct(worded(sentences(text)).alias("zs"), worded(F.flatten(F.transform(lines, sentences))).alias("cands"))
    page = asked.select(*key, "__asked", F.explode(F.array(whole)).alias("page"))
    spot = lambda w: F.array_position(F.transform("page.zs", lambda z: F.array_contains(z["words"], w)), True).cast("int")
    spotted = F.transform("__asked", lambda x: F.struct(x["rank"].alias("rank"), x["word"].alias("word"), spot(x["word"]).alias("z")))
    held = page.select(*key, "page", F.explode(F.array(spotted)).alias("held"))

    there = F.array_remove(F.array_distinct(F.transform("held", lambda h: h["z"])), 0)
    one = held.select(*key, "page", "held", F.explode(there).alias("z"))
    one = one.select(*key, "page", "z", F.explode(F.array(F.filter("held", lambda h: h["z"] == F.col("z")))).alias("hs"))
    met = one.select(*key, F.get("hs", F.lit(0))["rank"].alias("first"), F.get("page.zs", F.col("z") - 1).alias("z"), F.col("page.zs").alias("zs"), F.col("page.cands").alias("cands"), F.transform("hs", lambda x: x["word"]).alias("ws"))

    def judged(x: Column) -> Column:
        ws, line = x["ws"], x["line"]
        words_there = F.coalesce(line["words"], empty)
        whole = (F.size(ws) >= 2) & F.exists(words_there, lambda t: F.contains(t, F.array_join(ws, "")))
        suspects = F.when(whole, empty).otherwise(F.filter(ws, lambda w: ~_torn(w, words_there)))
        return F.struct(line["text"].alias("line"), words_there.alias("lt"), suspects.alias("suspects"), _sister(line, F.col("z"), F.col("zs")).alias("sister"))

    placed = lambda ws: F.struct(ws.alias("ws"), best_line(F.col("z"), ws, F.col("cands")).alias("line"))
    found = _bound(_bound(in_order(F.col("ws"), F.col("z.text")), placed), judged)
    met = met.select(*key, "first", F.col("z.text").alias("sentence"), F.explode(F.array(found)).alias("x")).select(*key, "first", "sentence", "x.*")
    met = met.where("size(suspects) > 0 and not sister")
    place = F.when(F.col("line").isNotNull(), F.row_number().over(Window.partitionBy(*key, F.col("line").isNull()).orderBy("first")))
    met = met.withColumn("place", place)

    def others(own: Column) -> Column:
        return F.array_distinct(F.filter("lt", lambda w: (F.char_length(w) > 2) & ~F.array_contains(own, w) & ~F.array_contains("suspects", w)))

    pairs = _bound(_bound(tokens(F.col("sentence")), others), lambda o: nearest_in_order(F.col("suspects"), o))
    swaps = met.where(F.col("place") <= SENTENCES).select(
        *key, "place", F.lit("swap").alias("kind"), F.array_join("suspects", " ").alias("words"),
        F.array_join(F.transform(pairs, lambda p: p["near"]), " ").alias("counterparts"), clipped(F.col("sentence"), EVIDENCE).alias("sentence"), clipped(F.col("line"), EVIDENCE).alias("line"),
    )
    loose = held.select(*key, F.explode(F.filter("held", lambda h: h["z"] == 0)).alias("h")).select(*key, F.lit(0).alias("o"), "h.rank", F.lit(0).alias("i"), "h.word")
    later = met.where(F.col("line").isNull() | (F.col("place") > SENTENCES)).select(*key, F.lit(1).alias("o"), F.col("first").alias("rank"), F.posexplode("suspects").alias("i", "word"))
    rest = loose.union(later).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("o", "rank", "i", "word"))).alias("all")).where(F.size("all") >= MANY)
    none = F.lit(None).cast("string")
    left = rest.select(*key, F.lit(None).cast("int").alias("place"), F.lit("rest").alias("kind"), F.array_join(F.transform("all", lambda x: x["word"]), " ").alias("words"), none.alias("counterparts"), none.alias("sentence"), none.alias("line"))
    return swaps.union(left)
