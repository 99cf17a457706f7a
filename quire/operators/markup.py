"""Marked-up page text to blocks, style spans to runs, and truncated JSON."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def parse_markers(pages: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, kind, box, items, text): blocks of marked-up text.

    "## " opens a heading, "> " a quote, "~ " a lead, "- " and "1. " list items, [insert] and [/insert] a box;
    neighbouring items form one list, of one item a paragraph, and neighbouring plain lines a
    paragraph. An unclosed box ends with the text. Blank lines part paragraphs. ord is the first line's number.
    """
    lines = pages.select(key, F.posexplode(F.split(text, "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    spot = Window.partitionBy(key).orderBy("i")
    l = F.col("line")  # noqa: E741
    kind = (
        F.when(l == "[insert]", "open").when(l == "[/insert]", "close").when(l == "", "blank").when(l.startswith("## "), "heading")
        .when(l.startswith("> "), "quote").when(l.startswith("~ "), "lead").when(l.startswith("- "), "list").when(l.rlike(r"^\d+\. "), "ordered")
        .otherwise("paragraph")
    )
    marked = lines.withColumn("kind", kind)
    opened, closed = F.sum(F.when(F.col("kind") == "open", 1).otherwise(0)).over(spot), F.sum(F.when(F.col("kind") == "close", 1).otherwise(0)).over(spot)
    joins = F.col("kind").isin("paragraph", "list", "ordered", "quote")
    new = F.when(joins & (F.lag("kind").over(spot) == F.col("kind")), 0).otherwise(1)
    runs = marked.withColumns({"box": F.when(opened > closed, opened).otherwise(0), "new": new}).withColumn("run", F.sum("new").over(spot))
    body = F.regexp_replace("line", r"^(## |> |~ |- |\d+\. )", "")
    rows = runs.where(~F.col("kind").isin("open", "close", "blank")).withColumn("body", body)
    blocks = rows.groupBy(key, "run", "kind", "box").agg(F.min("i").alias("ord"), F.array_sort(F.collect_list(F.struct("i", "body"))).alias("parts"))
    items = F.transform("parts", lambda x: x["body"])
    listed = F.col("kind").isin("list", "ordered") & (F.size("parts") > 1)
    final = F.when(F.col("kind").isin("list", "ordered") & (F.size("parts") == 1), "paragraph").otherwise(F.col("kind"))
    return blocks.select(
        key, "ord", final.alias("kind"), F.col("box").cast("int").alias("box"), F.when(listed, items).alias("items"), F.when(~listed, F.array_join(items, " ")).alias("text")
    )


def paint(texts: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """(key, start, length, styles): runs of equal style from overlapping spans (key, at, n, style).

    Cuts at every span's ends: a run is between neighbouring cuts, its styles those of the spans over it,
    and neighbours with the same styles merge. Spans past the text are clipped; places count from 0.
    """
    size = texts.select(key, F.char_length(text).alias("size"))
    clipped = spans.join(size, key).select(key, "style", "size", F.greatest("at", F.lit(0)).alias("a"), F.least(F.col("at") + F.col("n"), "size").alias("b")).where("a < b")
    cuts = clipped.select(key, "size", F.explode(F.array("a", "b")).alias("c")).union(size.select(key, "size", F.explode(F.array(F.lit(0), "size")).alias("c"))).distinct()
    spot = Window.partitionBy(key).orderBy("c")
    parts = cuts.select(key, F.col("c").alias("start"), F.lead("c").over(spot).alias("end")).where("end is not null")
    over = parts.join(clipped, [key], "left").groupBy(key, "start", "end").agg(
        F.array_join(F.array_sort(F.collect_set(F.when((F.col("a") <= F.col("start")) & (F.col("end") <= F.col("b")), F.col("style")))), "+").alias("styles")
    )
    line = Window.partitionBy(key).orderBy("start")
    new = F.coalesce((F.lag("styles").over(line) != F.col("styles")).cast("int"), F.lit(1))
    merged = over.withColumn("new", new).withColumn("run", F.sum("new").over(line))
    return merged.groupBy(key, "run", "styles").agg(F.min("start").alias("start"), F.max("end").alias("e")).select(key, "start", (F.col("e") - F.col("start")).alias("length"), "styles")


def _closed(text: str) -> str | None:
    """The longest beginning of a JSON text that is whole values, closed; None if there is none."""
    stack, ends, quoted, escaped = [], [], False, False
    for i, ch in enumerate(text):
        if quoted:
            if escaped:
                escaped = False
            elif ch == "\\":
                escaped = True
            elif ch == '"':
                quoted = False
        elif ch == '"':
            quoted = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
            ends.append((i + 1, "".join(reversed(stack))))
        elif ch in "}]" and stack:
            stack.pop()
            ends.append((i + 1, "".join(reversed(stack))))
        elif ch == ",":
            ends.append((i, "".join(reversed(stack))))
    ends.append((len(text), "".join(reversed(stack))))
    for at, rest in reversed(ends):
        made = text[:at] + rest
        try:
            json.loads(made)
            return made
        except ValueError:
            continue
    return None


def repaired_json(text: Column) -> Column:
    """A cut-off JSON text up to its last whole field, closed; null if nothing of it is whole."""

    def repair(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _closed(t) if isinstance(t, str) else None)

    return F.pandas_udf(repair, "string")(text)


def outer_json(text: Column) -> Column:
    """The outermost braces of an answer, without the fence around it."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))
