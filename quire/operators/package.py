"""Articles as nested packages and as Markdown, HTML and CMS documents, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import safe_link, slug

NODE = "struct<ord:int,kind:string,text:string>"
PACKAGE = f"struct<version:int,external_id:string,title:string,lang:string,done:boolean,nodes:array<{NODE}>>"


def nodes(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """(key, ord, kind, text): one node for each line with a word. A line of bars is a table row, one
    that begins with - or * a list item, a short one without end mark a heading, others paragraphs."""
    lines = docs.select(key, F.posexplode(F.split(text, "\n")).alias("ord", "text")).withColumn("text", F.trim("text")).where(F.col("text").rlike(r"[\p{L}\p{N}]"))
    kind = (
        F.when(F.col("text").rlike(r"\S \| \S"), "row")
        .when(F.col("text").rlike(r"^[-*] "), "item")
        .when((F.char_length("text") < 40) & ~F.col("text").rlike(r"[.!?…:;,]$"), "heading")
        .otherwise("paragraph")
    )
    return lines.select(key, "ord", kind.alias("kind"), "text")


def packages(docs: DataFrame, key: str, text: Column, title: Column, lang: Column) -> DataFrame:
    """(key, package): the JSON package of each document; one without a line has no nodes."""
    heads = docs.select(key, title.alias("title"), lang.alias("lang"))
    bodies = nodes(docs, key, text).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "kind", "text"))).alias("nodes"))
    full = heads.join(bodies, key, "left")
    body = F.coalesce("nodes", F.array().cast(f"array<{NODE}>"))
    whole = F.struct(
        F.lit(1).alias("version"), F.concat(F.lit("doc:"), F.col(key)).alias("external_id"), "title", "lang", F.lit(False).alias("done"), body.alias("nodes")
    )
    return full.select(key, F.to_json(whole).alias("package"))


def read_packages(rows: DataFrame, key: str, package: str) -> DataFrame:
    """(key, external_id, title, lang, ord, kind, text): packages read back, one row for each node.

    A byte order mark is skipped; text that is not JSON, another version and packages without
    a node give no row.
    """
    parsed = rows.select(key, F.from_json(F.regexp_replace(package, "^﻿", ""), PACKAGE).alias("p")).where("p.version = 1")
    return parsed.select(key, "p.external_id", "p.title", "p.lang", F.explode("p.nodes").alias("n")).select(key, "external_id", "title", "lang", "n.*")


def _rendered(made: DataFrame, key: str, part: Column, glue: str, name: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct("ord", part.alias("part"))))
    return made.groupBy(key).agg(F.array_join(F.transform(parts, lambda x: x["part"]), glue).alias(name))


def markdown(made: DataFrame, key: str) -> DataFrame:
    """(key, markdown) from nodes: headings at level three, items with a dash, paragraphs that would
    read as marks escaped, parts apart by a blank line."""
    escaped = F.regexp_replace("text", r"^([#>+*-]|\d+\.)", r"\\$1")
    part = F.when(F.col("kind") == "heading", F.concat(F.lit("### "), "text")).when(F.col("kind") == "item", F.concat(F.lit("- "), F.substr("text", F.lit(3)))).otherwise(escaped)
    return _rendered(made, key, part, "\n\n", "markdown")


def escape_html(text: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def html(made: DataFrame, key: str) -> DataFrame:
    """(key, html) from nodes: one element for each, text escaped."""
    tag = F.when(F.col("kind") == "heading", "h3").when(F.col("kind") == "item", "li").otherwise("p")
    return _rendered(made, key, F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.col("text")), F.lit("</"), tag, F.lit(">")), "\n", "html")


def html_link(label: Column, target: Column) -> Column:
    """The link, or the bare label if the target's scheme is not allowed."""
    link = safe_link(target)
    return F.when(link.isNull(), escape_html(label)).otherwise(F.concat(F.lit('<a href="'), escape_html(link), F.lit('">'), escape_html(label), F.lit("</a>")))


def cms_documents(made: DataFrame, key: str) -> DataFrame:
    """(id, type, key, json): one block document per node; ids are hashes of owner and place, so that
    writing twice changes nothing."""
    ident = F.concat(F.lit("block-"), F.left(F.sha1(F.concat_ws("/", key, "ord")), F.lit(16)))
    style = F.when(F.col("kind") == "heading", "h3").otherwise("normal")
    return made.select(ident.alias("id"), F.lit("block").alias("type"), key, F.to_json(F.struct(style.alias("style"), F.col("kind").alias("kind"), "text")).alias("json"))


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """Rows of both; for a key in both the incoming row with the largest `order` wins."""
    from pyspark.sql.window import Window

    newest = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    fresh = incoming.withColumn("__r", newest).where("__r = 1").drop("__r")
    return existing.join(fresh.select(key), key, "left_anti").unionByName(fresh)


def resolve_dimension(names: DataFrame, name: str, dimension: DataFrame, dim_name: str, dim_id: str) -> DataFrame:
    """(name, id, created): the dimension's id for each distinct name, equal but for case and outer
    spaces, smallest id first; a name that it lacks gets an id from its slug."""
    lookup = dimension.groupBy(F.lower(F.trim(dim_name)).alias("__k")).agg(F.min(dim_id).cast("string").alias("id"))
    asked = names.select(F.col(name).alias("name")).distinct().withColumn("__k", F.lower(F.trim("name")))
    joined = asked.join(lookup, "__k", "left")
    return joined.select("name", F.coalesce("id", F.concat(F.lit("new-"), slug(F.col("name")))).alias("id"), F.col("id").isNull().alias("created"))
