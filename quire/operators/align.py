"""Which line a sentence came from, repeated passages, spelling by letters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import accent_marks, tokens, unaccented
from quire.operators.unknown_words import nearest_in_order
from quire.sources.shared import checkpointed


def best_lines(sentences: DataFrame, lines: DataFrame, sentence_key: str, line_keys: list[str], least: int = 3, share: float = 0.5) -> DataFrame:
    """(sentence_key, line_keys..., overlap, n_words): for each sentence the line that shares most of
    its distinct words, if those are at least min(least, n) and `share` of n; the first line wins ties.

    Inverted index with a prefix filter: a line that shares `need` of a sentence's n words
    holds one of its n - need + 1 rarest, so only these are joined on; overlaps are counted for the candidates.
    Both inputs have a `text` column.
    """
    own = sentences.select(sentence_key, F.array_distinct(tokens(F.col("text"))).alias("ws")).where(F.size("ws") > 0)
    theirs = lines.select(*line_keys, F.array_distinct(tokens(F.col("text"))).alias("lw")).where(F.size("lw") > 0)
    asked = own.select(F.explode("ws").alias("w")).distinct()
    spread = theirs.select(*line_keys, "lw", F.explode("lw").alias("w"))
    rarity = spread.select("w").join(F.broadcast(asked) if _small(asked) else asked, "w").groupBy("w").agg(F.count("*").alias("df"))
    n = F.size("ws")
    need = F.greatest(F.least(F.lit(least), n), F.ceil(n * share).cast("int"))
    ranked = own.select(sentence_key, "ws", need.alias("need"), F.explode("ws").alias("w")).join(rarity, "w")
    rank = F.row_number().over(Window.partitionBy(sentence_key).orderBy("df", "w"))
    # words that no line has are the rarest of all and take no rank
    absent = F.size("ws") - F.count("*").over(Window.partitionBy(sentence_key))
    probes = ranked.withColumn("rank", rank + absent).where(F.col("rank") <= F.size("ws") - F.col("need") + 1).select(sentence_key, "ws", "need", "w")
    probes = checkpointed(probes)
    few = (probes.agg(F.sum(F.size("ws"))).first()[0] or 0) <= 10 * BROADCAST_WORDS
    # lines go to the probes where they are and are scored there: only the best of a task is shuffled
    scored = spread.join(F.broadcast(probes) if few else probes, "w").withColumn("overlap", F.size(F.array_intersect("ws", "lw"))).where("overlap >= need")
    first = F.min(F.struct((-F.col("overlap")).alias("o"), *line_keys, F.size("ws").alias("n_words"))).alias("x")
    best = scored.groupBy(sentence_key).agg(first)
    return best.select(sentence_key, *[F.col(f"x.{k}").alias(k) for k in line_keys], (-F.col("x.o")).alias("overlap"), "x.n_words")


#: Words of the query side that may be sent to all tasks.
BROADCAST_WORDS = 200_000


def _small(words: DataFrame) -> bool:
    return words.limit(BROADCAST_WORDS + 1).count() <= BROADCAST_WORDS


def repeated_ngrams(docs: DataFrame, key: str, text: Column, n: int = 8) -> DataFrame:
    """(key, i, first): token windows of n that occurred at least n tokens earlier in the same text."""
    ws = docs.select(key, tokens(text).alias("t")).where(F.size("t") >= 2 * n)
    grams = ws.select(key, F.posexplode(F.expr(f"transform(sequence(0, size(t) - {n}), i -> xxhash64(array_join(slice(t, i + 1, {n}), ' ')))")).alias("i", "g"))
    first = F.min("i").over(Window.partitionBy(key, "g"))
    return grams.withColumn("first", first).where(F.col("i") >= F.col("first") + n).select(key, "i", "first")


def passage_runs(hits: DataFrame, key: str, n: int = 8) -> DataFrame:
    """(key, start, first, length): neighbouring hits with the same shift, merged to passages."""
    shifted = hits.withColumn("shift", F.col("i") - F.col("first"))
    island = F.col("i") - F.row_number().over(Window.partitionBy(key, "shift").orderBy("i"))
    runs = shifted.withColumn("island", island).groupBy(key, "shift", "island")
    return runs.agg(F.min("i").alias("start"), F.min("first").alias("first"), (F.count("*") + n - 1).alias("length")).select(key, "start", "first", "length")


_PASSAGES = "struct<until: int, seen: array<struct<h: bigint, i: int>>, told: array<bigint>, out: array<struct<start: int, first: int, length: int>>>"


def repeated_passages(docs: DataFrame, key: str, text: Column, n: int = 8) -> DataFrame:
    """(key, start, first, length, passage): passages of n words or more that the text had before, n words earlier or more.

    The text is read once from front to back: a window of n words is compared with its first reading; a passage goes on as long as
    both readings do and don't overlap, what was told isn't told again, and reading goes on behind a passage. `passage` is spelt as in
    the text. Each text decides for itself, so nothing is shuffled; only windows that occur more than once are gone through.
    """
    words = docs.select(key, text.alias("text"), tokens(text).alias("t")).where(F.size("t") >= 2 * n)
    grams = F.transform(F.sequence(F.lit(0), F.size("t") - n), lambda i: F.struct(F.xxhash64(F.array_join(F.slice("t", i + 1, n), " ")).alias("h"), i.cast("int").alias("i")))
    # a generator between the steps: what is worked out below it isn't worked out again for each use above
    ordered = words.select(key, "text", "t", F.explode(F.array(F.array_sort(grams))).alias("g"))
    beside = lambda x, k: (F.get("g", k - 1)["h"] == x["h"]) | (F.get("g", k + 1)["h"] == x["h"])
    again = F.filter("g", lambda x, k: F.coalesce(beside(x, k), F.lit(False)))
    back = F.array_sort(F.transform(again, lambda x: F.struct(x["i"].alias("i"), x["h"].alias("h"))))
    twice = ordered.select(key, "text", "t", F.explode(F.array(back)).alias("w")).where(F.size("w") > 0)
    empty = F.from_json(F.lit('{"until": 0, "seen": [], "told": [], "out": []}'), _PASSAGES)

    def step(s: Column, w: Column) -> Column:
        first = F.get(F.filter(s["seen"], lambda x: x["h"] == w["h"]), F.lit(0))["i"]
        return F.struct(s.alias("s"), w.alias("w"), first.alias("first"))

    def measured(x: Column) -> Column:
        w, first = x["w"], x["first"]
        new = (w["i"] - first >= n) & ~F.array_contains(x["s"]["told"], w["h"])
        most = F.least(F.size("t") - w["i"], w["i"] - first)
        differs = F.array_position(F.transform(F.sequence(F.lit(n), F.greatest(most, F.lit(n))), lambda k: (k < most) & (F.get("t", first + k) == F.get("t", w["i"] + k))), False)
        return F.struct(x["s"].alias("s"), w.alias("w"), first.alias("first"), F.when(new, (n - 1 + differs).cast("int")).alias("length"))

    def settle(x: Column) -> Column:
        s, w, first, length = x["s"], x["w"], x["first"], x["length"]
        inside = F.filter("w", lambda o: (o["i"] >= w["i"]) & (o["i"] <= w["i"] + length - n))
        told = F.struct(
            (w["i"] + length).alias("until"), s["seen"].alias("seen"), F.concat(s["told"], F.transform(inside, lambda o: o["h"])).alias("told"),
            F.array_append(s["out"], F.struct(w["i"].alias("start"), first.alias("first"), length.alias("length"))).alias("out"),
        )
        seen = F.struct(s["until"].alias("until"), F.array_append(s["seen"], F.struct(w["h"].alias("h"), w["i"].alias("i"))).alias("seen"), s["told"].alias("told"), s["out"].alias("out"))
        return F.when(w["i"] < s["until"], s).when(first.isNull(), seen.cast(_PASSAGES)).when(length.isNull(), s).otherwise(told.cast(_PASSAGES))

    bound = lambda value, make: F.get(F.transform(F.array(value), make), F.lit(0))
    fold = F.aggregate("w", empty, lambda s, w: bound(bound(step(s, w), measured), settle), lambda s: s["out"])
    found = twice.select(key, "text", F.explode(fold).alias("p"))
    return found.select(key, "p.*", original_spelling(F.col("text"), F.col("p.start"), F.col("p.length")).alias("passage"))


def original_spelling(text: Column, start: Column, length: Column) -> Column:
    """The part of a text that `length` words from word number `start` (from 0) on make, with its capitals and marks."""
    words = F.slice(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), start + 1, length)
    between = F.slice(F.split(text, r"[\p{L}\p{N}]+"), start + 2, F.greatest(length - 1, F.lit(0)))
    return F.array_join(F.zip_with(words, between, lambda w, b: F.concat(w, F.coalesce(b, F.lit("")))), "")


def respellings(words: DataFrame, word: str = "word", least: int = 3) -> DataFrame:
    """(word, correction): a word with accents whose letters have one other known spelling, with as
    many accents. Words that the known spellings hold themselves stay; `words` has (word, known boolean)."""
    forms = words.where(F.char_length(word) >= least).select(F.col(word).alias("word"), "known").distinct()
    forms = forms.withColumn("bare", unaccented(F.col("word"))).withColumn("marks", accent_marks(F.col("word")))
    known = forms.where("known").groupBy("bare").agg(F.count_distinct("word").alias("n"), F.min("word").alias("correction"), F.min("marks").alias("m"))
    odd = forms.where("not known and marks > 0").join(forms.where("known").select("word"), "word", "left_anti")
    return odd.join(known.where("n = 1"), "bare").where("marks = m").select("word", "correction")


def near_words(suspects: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """(key, word, near, edits): each suspect takes the closest source word of its key that none before it took.

    Suspects go in order, and of equally close words the first is taken, so a key is one ordered fold over the arrays of its
    words (a sentence or a page). Both sides have (key, word, ord).
    """
    listed = lambda df, name: df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "word"))), lambda x: x["word"]).alias(name))
    both = listed(suspects, "suspects").join(listed(source, "others"), key)
    pairs = both.select(key, F.explode(nearest_in_order(F.col("suspects"), F.array_distinct("others"))).alias("p"))
    return pairs.select(key, "p.word", "p.near", "p.edits")


def containing(quotes: DataFrame, texts: DataFrame, quote_key: str, text_key: str, on: tuple[str, ...] = ()) -> DataFrame:
    """(on, quote_key, text_key): for each quote the first text, of the same `on`, that contains it, word for word.

    A text that contains a quote has all its inner words, so both meet on the quote's rarest inner word
    (or its first, if it has no inner one) and the containment is tested on these pairs. Both have `text`.
    """
    ws = tokens(F.col("text"))
    inner = F.when(F.size(ws) > 2, F.slice(ws, F.lit(2), F.size(ws) - 2)).otherwise(ws)
    asked = quotes.select(*on, quote_key, F.col("text").alias("__quote"), F.explode(F.array_distinct(inner)).alias("__w"))
    known = asked.select(*on, "__w").distinct()
    index = texts.select(*on, text_key, F.explode(F.array_distinct(ws)).alias("__w")).join(F.broadcast(known) if _small(known) else known, [*on, "__w"])
    rarity = index.groupBy(*on, "__w").agg(F.count("*").alias("__df"))
    probe = asked.join(rarity, [*on, "__w"]).groupBy(*on, quote_key, "__quote").agg(F.min_by("__w", F.struct("__df", "__w")).alias("__w"), F.count("*").alias("__n"))
    whole = asked.groupBy(*on, quote_key).agg(F.count("*").alias("__all"))  # a word that no text has rules the quote out
    probe = probe.join(whole, [*on, quote_key]).where("__n = __all").select(*on, quote_key, "__quote", "__w")
    met = probe.join(index, [*on, "__w"]).join(texts.select(*on, text_key, "text"), [*on, text_key]).where(F.contains("text", "__quote"))
    return met.groupBy(*on, quote_key).agg(F.min(text_key).alias(text_key))


def occurrences(texts: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, word, place, nth): every word of a text with its place and its running number among equal words."""
    ws = texts.select(key, F.posexplode(tokens(text)).alias("place", "word"))
    return ws.withColumn("nth", F.row_number().over(Window.partitionBy(key, "word").orderBy("place")))


def first_of_similar(entries: DataFrame, keys: list[str], order: str, title: str) -> DataFrame:
    """Entries of a group without those whose title is similar to that of an earlier one that stayed; entries without a title go.

    First wins, one after the other, so each group (entries with one number: a handful) is gone through in order.
    """
    import re

    import pandas as pd

    def keep(group: pd.DataFrame) -> pd.DataFrame:
        kept, sets = [], []
        for i, t in group.sort_values(order)[title].items():
            own = set(re.findall(r"[^\W_]+", (t or "").lower()))
            if not any(own and s and len(own & s) >= 0.5 * min(len(own), len(s)) for s in sets):
                kept.append(i)
                sets.append(own)
        return group.loc[kept]

    return entries.where(F.trim(title) != "").groupBy(*keys).applyInPandas(keep, entries.schema)
