"""Markup, span, JSON and archive queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import markup, package
from quire.plans.page_queries import NODES
from quire.sources import archive
from quire.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"with {NODES} select doc_id, kind, count(*) n, md5(string_agg(text, '|' order by ord)) digest from nd where kind in ('heading', 'row') group by all")
def parse_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document lines written with markers (headings as such, table rows as leads) and parsed again."""
    nodes = package.nodes(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("## "), "text")).when(F.col("kind") == "row", F.concat(F.lit("~ "), "text")).otherwise(F.concat("text", F.lit("\n")))
    parts = F.array_sort(F.collect_list(F.struct("ord", line.alias("line"))))
    pages = nodes.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("page"))
    blocks = markup.parse_markers(pages, "doc_id", "page").where("kind in ('heading', 'lead')")
    kind = F.when(F.col("kind") == "lead", "row").otherwise(F.col("kind"))
    rows = blocks.groupBy("doc_id", kind.alias("kind")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("p"))
    return rows.select("doc_id", "kind", "n", F.md5(F.array_join(F.transform("p", lambda x: x["text"]), "|")).alias("digest"))


@query("""with s as (select p_partkey, p_name, length(p_name) size, 0 a1, least(p_size % 12 + 2, length(p_name)) b1, p_size % 5 a2, least(p_size % 5 + 6, length(p_name)) b2 from part),
c as (select p_partkey, size, a1, b1, a2, b2, unnest(range(0, size)) i from s),
m as (select p_partkey, i, array_to_string(list_filter([case when i >= a1 and i < b1 then 'bold' end, case when i >= a2 and i < b2 then 'italic' end], lambda x: x is not null), '+') styles from c),
r as (select *, i - row_number() over (partition by p_partkey, styles order by i) g from m)
select p_partkey, min(i)::int "start", count(*)::int length, styles from r group by p_partkey, g, styles""")
def paint_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two overlapping style spans on every part name, as runs of equal style."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    bold = parts.select("p_partkey", F.lit(0).alias("at"), (F.col("p_size") % 12 + 2).alias("n"), F.lit("bold").alias("style"))
    italic = parts.select("p_partkey", (F.col("p_size") % 5).alias("at"), F.lit(6).alias("n"), F.lit("italic").alias("style"))
    return markup.paint(parts, bold.union(italic), "p_partkey", "p_name")


@query("""select event_id, case when event_id % 3 = 0 then event_type end event_type, case when event_id % 3 <> 2 then event_id end id from events""")
def json_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON, cut off inside the last or the second field, repaired and read."""
    whole = F.to_json(F.struct(F.col("event_id").alias("id"), "event_type", F.lit("x y").alias("rest")))
    kind = F.col("event_id") % 3
    keep = F.when(kind == 0, F.char_length(whole) - 2).when(kind == 1, F.instr(whole, '"event_type"') + 15).otherwise(F.lit(4))
    cut = table(spark, sf_dir, "events").select("event_id", F.substr(whole, F.lit(1), keep).alias("t"))
    fixed = cut.select("event_id", F.from_json(markup.repaired_json(F.col("t")), "id long, event_type string").alias("j"))
    return fixed.select("event_id", "j.event_type", "j.id")


@query("select doc_id, 'text.md' path, octet_length(encode(text))::bigint size, md5(text) digest from documents union all select doc_id, 'meta/lang.txt', octet_length(encode(lang)), md5(lang) from documents")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a ZIP archive of two entries, read back."""
    entry = lambda path, c: F.struct(F.lit(path).alias("path"), F.to_binary(F.col(c), F.lit("utf-8")).alias("content"))
    files = table(spark, sf_dir, "documents").select("doc_id", F.array(entry("text.md", "text"), entry("meta/lang.txt", "lang")).alias("files"))
    back = archive.read_archives(archive.write_archives(files, "doc_id"), "doc_id")
    return back.select("doc_id", "path", F.octet_length("content").cast("long").alias("size"), F.md5("content").alias("digest"))


@query(f"with {NODES} select doc_id, count(*) paragraphs, count(*) filter (kind = 'heading') headings from nd group by 1")
def docx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as word processor files; paragraphs and headings are counted in what was written."""
    made = archive.docx(package.nodes(table(spark, sf_dir, "documents"), "doc_id", F.col("text")), "doc_id")
    body = archive.read_archives(made, "doc_id").where("path = 'word/document.xml'").select("doc_id", F.decode("content", "utf-8").alias("x"))
    count = lambda mark: F.size(F.split("x", mark)) - 1
    return body.select("doc_id", count("<w:p>").cast("long").alias("paragraphs"), count('"Heading3"').cast("long").alias("headings"))
