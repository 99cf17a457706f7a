"""Article queries: stitching, verdicts, quotes, headlines, images, occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.text import tokens
from quire.operators import align, layout, pages
from quire.plans.page_queries import PAGES
from quire.plans.text_queries import _index_of
from quire.sources.tables import numbered_pages, table, turn_pairs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""with {PAGES}, p as materialized (select "owner", pdf, printed = 1 starts, case when printed = 4 then pdf - 6 end fr from pg),
r as materialized (select *, sum(starts::int) over (partition by "owner" order by pdf rows unbounded preceding) run from p),
j as materialized (select "owner", pdf, fr from r where fr is not null and not starts),
h as (select j."owner", j.pdf, r.run there from j join r on r."owner" = j."owner" and r.pdf = j.fr)
select r."owner", r.pdf::int pdf, coalesce(there, run)::bigint article from r left join h on h."owner" = r."owner" and h.pdf = r.pdf""")
def stitch_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume pages to articles: number 1 opens one, number 4 goes on from six pages before."""
    pieces = numbered_pages(table(spark, sf_dir, "lineitem")).select(
        "owner", "pdf", F.lit(0).alias("ord"), (F.col("printed") == 1).alias("starts"), F.when(F.col("printed") == 4, F.col("pdf") - 6).alias("from_page")
    )
    return pages.stitched(pieces, "owner", "pdf", "ord", "starts", "from_page").select("owner", "pdf", "article")


@query("""with x as (select o_custkey, o_orderkey, case when o_orderstatus = 'O' and lag(o_orderkey) over w is not null then 0 else 1 end op from orders window w as (partition by o_custkey order by o_orderkey)),
r as (select *, sum(op) over (partition by o_custkey order by o_orderkey) run from x)
select o_custkey, min(o_orderkey) "first", max(o_orderkey) "last", count(*) parts from r group by o_custkey, run""")
def apply_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders as articles; status O says that an order is one with the order before."""
    return pages.merged_by_verdict(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "o_orderstatus", "O")


@query("select item_id, min(doc_id) doc_id from benchmark b join documents d on contains(d.text, b.text) group by item_id")
def pull_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document that holds each benchmark text."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return align.containing(quotes, table(spark, sf_dir, "documents").select("doc_id", "text"), "item_id", "doc_id")


@query("""with s as (select page_id, split_part(html, '</title>', 1) t, substr(html, greatest(strpos(html, '</title>') + 8, strpos(html, '</h1>') + 5)) b from pages),
k as (select page_id, list_distinct(regexp_extract_all(lower(regexp_extract(t, '<title>(.*)', 1, 's')), '[\\p{L}\\p{N}]+')) tw, list_distinct(regexp_extract_all(lower(b), '[\\p{L}\\p{N}]+')) bw from s),
m as (select page_id, list_sort(list_filter(tw, lambda w: length(w) >= 3 and not list_contains(bw, w))) missing from k)
select page_id, array_to_string(missing, ' ') missing from m where len(missing) > 0""")
def headline_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title words of three letters or more that the page's text after its heading does not have."""
    cut = F.greatest(F.instr("html", "</title>") + 8, F.instr("html", "</h1>") + 5)
    title = F.regexp_extract(F.substring_index("html", "</title>", 1), r"(?s)<title>(.*)", 1)
    body = F.substr("html", cut)
    sets = table(spark, sf_dir, "pages").select("page_id", F.array_distinct(tokens(title)).alias("t"), F.array_distinct(tokens(body)).alias("b"))
    missing = sets.select("page_id", F.array_sort(F.filter(F.array_except("t", "b"), lambda w: F.char_length(w) >= 3)).alias("m"))
    return missing.where(F.size("m") > 0).select("page_id", F.array_join("m", " ").alias("missing"))


@query("""select l_orderkey, l_linenumber from lineitem where not (l_returnflag = 'R' or l_quantity * 4 < 20 or l_linenumber * 9 < 20 or l_quantity < 8 or l_linenumber * 4 < 8
 or l_quantity / (l_linenumber * 4) > 20 or l_quantity / (l_linenumber * 4) < 0.05 or l_discount * 100 < 0.15)
 and not exists (select 1 from orders where o_orderkey = l_orderkey and o_orderstatus = 'F')""")
def images_unplaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items, read as images, that are no decoration and belong to no finished order."""
    items = table(spark, sf_dir, "lineitem")
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    reason = layout.decorative_reason(q * 4, n * 9, q, n * 4, F.col("l_discount") * 100, F.when(F.col("l_returnflag") == "R", F.lit("text")))
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    used = items.select("l_orderkey", "l_linenumber").join(done, "l_orderkey", "left_semi")
    return layout.unplaced(items, ["l_orderkey", "l_linenumber"], reason, used)


@query("""with c as (select l_orderkey, count(*) n from lineitem group by 1), w as (select l_orderkey, l_returnflag, count(*) m from lineitem where l_quantity > 25 group by all)
select l_orderkey, l_returnflag, round(m / n, 6) "share" from w join c using (l_orderkey) where round(m / n, 6) > 0.5""")
def face_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags that over half of an order's items wear at a quantity over 25."""
    return layout.face_of_type(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_quantity") > 25)


@query("""with t as (select doc_id, unnest(w) word, generate_subscripts(w, 1) - 1 place from (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') w from documents)),
n as (select *, row_number() over (partition by doc_id, word order by place) nth from t)
select doc_id, max(nth)::int most, arg_max(word, (nth, -place)) word, count(*) filter (nth > 1) repeats from n group by doc_id""")
def occurrence_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word that occurs most often in each document, reached first, and how many words are repeats."""
    every = align.occurrences(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return every.groupBy("doc_id").agg(
        F.max("nth").alias("most"), F.max_by("word", F.struct("nth", -F.col("place"))).alias("word"), F.count_if(F.col("nth") > 1).alias("repeats")
    )


@query()
def toc_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as contents lines (brand, size as number, name as title) without similar later ones."""
    entries = table(spark, sf_dir, "part").select("p_brand", "p_size", "p_partkey", "p_name")
    return align.first_of_similar(entries, ["p_brand", "p_size"], "p_partkey", "p_name")


@query()
def near_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown words of an answer, each with the closest word of the question."""
    from quire.operators.coverage import used_against, words

    written, index, key = _index_of(spark, sf_dir)
    one = lambda df: df.withColumn("k", F.concat_ws("/", *key))
    suspects = used_against(written, index, key).where("available = 0 and char_length(word) > 3").withColumnRenamed("first", "ord")
    source = words(turn_pairs(table(spark, sf_dir, "conversations")), key, F.col("source")).groupBy(*key, "word").agg(F.min("ord").alias("ord"))
    return align.near_words(one(suspects).select("k", "word", "ord"), one(source.where("char_length(word) > 3")).select("k", "word", "ord"), "k")


@query()
def unknown_word_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers with words that the question before lacks, each with the question's line in its stead."""
    from quire.operators.unknown_words import unknown_word_findings as found

    return found(turn_pairs(table(spark, sf_dir, "conversations")), ["conv_id", "turn"], "written", "source")


@query()
def changed_word_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read twice: each word of seven letters or more that ends a line has its third letter doubled in the written text."""
    from quire.operators.unknown_words import unknown_word_findings as found

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("source"))
    written = F.regexp_replace("source", r"(?m)(\b\p{L}{2})(\p{L})(\p{L}{4,}\P{L}*)$", "$1$2$2$3")
    return found(docs.withColumn("written", written), ["doc_id"], "written", "source")


@query("select doc_id, case when length(text) > 40 then left(text, 40) || '…' else text end head, case when length(text) > 40 then '…' || right(text, 40) else text end tail from documents")
def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions import text

    return table(spark, sf_dir, "documents").select("doc_id", text.head(F.col("text"), 40).alias("head"), text.tail(F.col("text"), 40).alias("tail"))


@query("""with t as (select doc_id, text, string_split(text, ' ') w from documents where len(string_split(text, ' ')) >= 12),
f as (select doc_id, text, 0 fragment, array_to_string(w[3:5], ' ') b, array_to_string(w[6:7], ' ') f from t union all select doc_id, text, 1, array_to_string(w[8:9], ' '), array_to_string(w[10:11], ' ') from t)
select doc_id, fragment, length(f)::int "length", (strpos(text, b || ' ' || f) + length(b))::int start from f
where length(text) - length(replace(lower(text), lower(f), '')) = length(f)""")
def place_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fragments of each document of twelve words or more, its words 6-7 and 10-11 with what stands
    before them: all are in the text, so all are placed. Words
    that come more than once are not asked for."""
    from quire.operators.placing import place_fragments as place

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("text"), F.split("text", " ").alias("w")).where(F.size("w") >= 12)
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    parts = F.array(
        F.struct(F.lit(0).alias("fragment"), cut(6, 2).alias("text"), cut(3, 3).alias("before")),
        F.struct(F.lit(1).alias("fragment"), cut(10, 2).alias("text"), cut(8, 2).alias("before")),
    )
    fragments = docs.select("doc_id", F.lower("text").alias("own"), F.explode(parts).alias("f")).select("doc_id", "own", "f.*")
    once = F.char_length("own") - F.char_length(F.replace("own", F.lower("text"), F.lit(""))) == F.char_length("text")
    fragments = fragments.where(once).drop("own")
    placed = place(docs.select("doc_id", F.lit(0).alias("block"), "text"), fragments, "doc_id")
    return placed.select("doc_id", "fragment", "length", "start")
