"""Text and coverage queries over documents, pages, conversations and benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import ids, text
from quire.operators import align, coverage
from quire.sources.tables import table, text_lines, turn_pairs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


TOKENS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"

PAIRS = """
p as (select conv_id, turn, role, text, lag(text) over w src, lag(role) over w r0
      from conversations window w as (partition by conv_id order by turn)),
t as (select conv_id, turn, text written, src source from p where role = 'assistant' and r0 = 'user'),
u0 as (select conv_id, turn, unnest(regexp_extract_all(lower(written), '[\\p{L}\\p{N}]+')) word,
        generate_subscripts(regexp_extract_all(lower(written), '[\\p{L}\\p{N}]+'), 1) ord from t),
u as (select conv_id, turn, word, count(*) used, min(ord) first from u0 group by all),
s as (select conv_id, turn, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) word from t),
i as (select conv_id, turn, word, count(*) n from s group by all),
j as (select u.conv_id, u.turn, u.word, used, first, coalesce(n, 0) available from u left join i using (conv_id, turn, word))
"""


def _index_of(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    key = ["conv_id", "turn"]
    pairs = turn_pairs(table(spark, sf_dir, "conversations"))
    index = coverage.words(pairs, key, F.col("source")).groupBy(*key, "word").agg(F.count("*").alias("n"))
    return coverage.words(pairs, key, F.col("written")), index, key


@query(f"""with {PAIRS}
select conv_id, turn, sum(used)::bigint used, sum(least(used, available))::bigint backed,
  round(sum(least(used, available)) / sum(used), 6) score,
  least(count(*) filter (available = 0 and length(word) > 2), 40)::bigint n_unknown,
  least(count(*) filter (available > 0 and used > available), 20)::bigint n_overused from j group by conv_id, turn
union all select conv_id, turn, 0, 0, 1.0, 0, 0 from t where (conv_id, turn) not in (select (conv_id, turn) from j)""")
def index_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    written, index, key = _index_of(spark, sf_dir)
    out = coverage.index_check(written, index, key, turn_pairs(table(spark, sf_dir, "conversations")))
    return out.withColumns({c: F.col(c).cast("long") for c in ("n_unknown", "n_overused")})


@query(f"""with {PAIRS}
select conv_id, turn, word, used, available, rank::int rank from (
  select *, row_number() over (partition by conv_id, turn order by used desc, first) rank from j where available > 0 and used > available)
where rank <= 20""")
def overused_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.top_overused(*_index_of(spark, sf_dir))


@query(f"""with {PAIRS}
select conv_id, turn, word, rank::int rank from (
  select *, row_number() over (partition by conv_id, turn order by first) rank from j where available = 0 and length(word) > 2)
where rank <= 40""")
def unknown_first40(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.first_unknown(*_index_of(spark, sf_dir))


@query(f"""with {PAIRS}
select conv_id, turn, sum(n)::bigint words, sum(least(n, coalesce(used, 0)))::bigint found, round(sum(least(n, coalesce(used, 0))) / sum(n), 6) recall
from i left join u using (conv_id, turn, word) where length(word) >= 2 group by conv_id, turn
union all select conv_id, turn, 0, 0, 1.0 from t where (conv_id, turn) not in (select (conv_id, turn) from i where length(word) >= 2)""")
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.recall(*_index_of(spark, sf_dir), turn_pairs(table(spark, sf_dir, "conversations")))


@query(f"""with {PAIRS}
select conv_id, turn, sum(used)::bigint words, sum(case when available > 0 then used else 0 end)::bigint known,
  round(100 * sum(case when available > 0 then used else 0 end) / sum(used))::int percent from j group by conv_id, turn""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.agreement(*_index_of(spark, sf_dir))


@query(f"""with {PAIRS},
c as (select conv_id, turn, sum(least(used, available)) / sum(used) score,
  count(*) filter (available = 0 and length(word) > 2) unknown from j group by conv_id, turn)
select conv_id, round(min(score), 2) reliability, bool_or(score < 0.7) body, bool_or(unknown > 0) words,
  string_agg(turn::varchar, ',' order by turn) filter (score < 0.7) doubtful from c group by conv_id""")
def page_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lowest score of a conversation's turns, what is doubtful, and the turns below 0.7."""
    pairs = coverage.used_against(*_index_of(spark, sf_dir))
    score = pairs.groupBy("conv_id", "turn").agg(
        (F.sum(F.least("used", "available")) / F.sum("used")).alias("score"),
        F.count_if((F.col("available") == 0) & (F.char_length("word") > 2)).alias("unknown"),
    )
    low = F.array_sort(F.collect_list(F.when(F.col("score") < 0.7, F.col("turn"))))
    return score.groupBy("conv_id").agg(
        F.round(F.min("score"), 2).alias("reliability"), F.bool_or(F.col("score") < 0.7).alias("body"), F.bool_or(F.col("unknown") > 0).alias("words"),
        F.nullif(F.array_join(low, ","), F.lit("")).alias("doubtful"),
    )


@query(f"select word, count(*) n from (select unnest({TOKENS.format('text')}) word from documents) group by word")
def tokens_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.explode(text.tokens(F.col("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@query("""with r as (select source, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) word, 1 raw, 0 clean from documents
  union all select source, unnest(regexp_extract_all(lower(regexp_replace(text, '[*#_~`]+', '', 'g')), '[\\p{L}\\p{N}]+')), 0, 1 from documents)
select source, word, greatest(sum(raw), sum(clean))::bigint n from r group by source, word""")
def word_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return coverage.word_index(docs, ["source"], F.col("text"), F.regexp_replace("text", "[*#_~`]+", ""))


@query("""with k as (select doc_id, trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) k from documents),
g as (select k, min(doc_id) group_id, count(*) size from k group by k having count(*) > 1)
select doc_id, group_id, size from k join g using (k)""")
def compare_key_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal wording: the hash of the key groups them, so no text is shuffled."""
    keyed = table(spark, sf_dir, "documents").select("doc_id", F.sha2(text.compare_key(F.col("text")), 256).alias("k"))
    groups = keyed.groupBy("k").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("size")).where("size > 1")
    return keyed.join(groups, "k").select("doc_id", "group_id", "size")


@query(r"""with m as (select doc_id, regexp_replace(text, '([.!?…])[ \t]+([\p{Lu}"''“‘(])', '\1' || chr(10) || '\2', 'g') t from documents),
m2 as (select doc_id, regexp_replace(t, '([.!?…])[ \t]+([\p{Lu}"''“‘(])', '\1' || chr(10) || '\2', 'g') t from m),
s as (select doc_id, list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') s from m2)
select doc_id, len(s)::int sentences, coalesce(list_max(list_transform(s, lambda x: length(x))), 0)::int longest from s""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return made.select("doc_id", F.size("s").alias("sentences"), F.coalesce(F.array_max(F.transform("s", lambda x: F.char_length(x))), F.lit(0)).alias("longest"))


def _rewritten(text: str, steps: tuple) -> str:
    for find, put in steps:
        text = f"regexp_replace({text}, '{find}', '{put}', 'g')"
    return text


KEPT = "|".join(text.KEPT_AFTER_HYPHEN)
BROKEN = r"(\p{Ll})[-\x{00AD}]\s*\n\s*"
CLEAN_STEPS = (
    (r"!\[[^\]]*\]\([^)]*\)", " "), (r"(?m)^\s{0,3}#{1,6}\s+", ""), (r"(?m)^\s{0,3}>\s?", ""),
    (BROKEN + rf"((?i:{KEPT}))([^\p{{L}}]|$)", r"\1- \2\3"), (BROKEN + r"(\p{L}+)", r"\1\2"), (r"\s*\n\s*", " "),
    (r"\*{1,3}([^*\s](?:[^*]*[^*\s])?)\*{1,3}", r"\1"), (r"~~([^~\s](?:[^~]*[^~\s])?)~~", r"\1"), (r"`([^`]+?)`", r"\1"),
    (r"(^|[^\w/])_{1,2}([^_\s](?:[^_]*[^_\s])?)_{1,2}($|[^\w/])", r"\1\2\3"), (r"\s*[→⟶➔➜▶►]+\s*$", ""), (r"\x{00A0}", " "),
    (r"[ \t]{2,}", " "), (r"^\s+|\s+$", ""),
)


@query(f"select doc_id, length(t)::int n_chars, md5(t) digest from (select doc_id, {_rewritten('text', CLEAN_STEPS)} t from documents)")
def cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned running text of each document, as its length and hash."""
    made = table(spark, sf_dir, "documents").select("doc_id", text.cleaned(F.col("text")).alias("t"))
    return made.select("doc_id", F.char_length("t").alias("n_chars"), F.md5("t").alias("digest"))


FROM, TO = text.ACCENTED, text.FOLDED


@query(f"""select page_id, regexp_replace(left(regexp_replace(regexp_replace(translate(lower(replace(replace(title, '&', ' en '), 'ß', 'ss')), '{FROM}', '{TO}'),
  '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 96), '-+$', '') slug from (select page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) title from pages)""")
def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    return pages.select("page_id", text.slug(F.col("title")).alias("slug"))


@query()
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses in the page source, in order of first appearance."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.array_distinct(text.links(F.concat_ws(" ", "url", "html"))).alias("l"))
    return pages.select("page_id", F.posexplode("l").alias("ord", "link"))


@query(r"""with m as (select doc_id, ' ' || regexp_replace(text, '[^\p{L}\p{N}''’-]', '  ', 'g') || ' ' t from documents),
e as (select doc_id, unnest(regexp_extract_all(t, ' ([b-tv-z]) ', 1)) letter from m)
select doc_id, letter, count(*) n from e group by doc_id, letter""")
def stray_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(text.stray_letters(F.col("text"))).alias("letter"))
    return found.groupBy("doc_id", "letter").agg(F.count("*").alias("n"))


@query("select o_orderkey, day(o_orderdate)::int \"day\", month(o_orderdate)::int \"month\", year(o_orderdate)::int \"year\" from orders")
def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates printed in words and read back."""
    names = F.array(*[F.lit(m) for m in ("januari", "februari", "maart", "april", "mei", "juni", "juli", "augustus", "september", "oktober", "november", "december")])
    printed = F.concat_ws(" ", F.dayofmonth("o_orderdate"), F.element_at(names, F.month("o_orderdate")), F.year("o_orderdate"))
    read = table(spark, sf_dir, "orders").select("o_orderkey", text.printed_date(printed).alias("d"))
    return read.select("o_orderkey", "d.day", "d.month", "d.year")


@query("select p_partkey, md5(p_name) name_key, substr(sha1(p_name), 1, 12) name_sha from part")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", F.md5("p_name").alias("name_key"), F.left(F.sha1("p_name"), F.lit(12)).alias("name_sha"))


@query()
def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """External and finding ids of pages from their address."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", ids.fnv1a(F.col("url")).alias("fnv"), ids.djb2(F.col("url")).alias("finding_id"), ids.external_id(F.col("url"), F.col("page_id"), F.col("page_id")).alias("external_id"))


LINES = "select source, doc_id, line_no - 1 line_no, text from (select source, doc_id, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line_no from documents) where regexp_matches(text, '[\\p{L}\\p{N}]')"


@query(f"""with l as ({LINES}),
k as (select distinct source, doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) key from l where length(trim(text)) between 1 and 90)
select source, key, count(*) pages from k where key <> '' group by source, key having count(*) >= 3""")
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.repeated_lines(text_lines(table(spark, sf_dir, "documents")), "source", "doc_id", F.col("text"), 3)


@query(f"""with l as ({LINES}),
lw as (select doc_id, line_no, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) ws from l),
lt as (select doc_id, line_no, unnest(ws) w from lw),
b as (select item_id, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) ws from benchmark),
bt as (select item_id, len(ws) n, unnest(ws) w from b),
o as (select item_id, n, doc_id, line_no, count(*) overlap from bt join lt using (w) group by all),
r as (select *, row_number() over (partition by item_id order by overlap desc, doc_id, line_no) rn from o where overlap >= least(3, n) and overlap >= 0.5 * n)
select item_id, doc_id, line_no::int line_no, overlap::int overlap, n::int n_words from r where rn = 1""")
def best_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = text_lines(table(spark, sf_dir, "documents"))
    return align.best_lines(table(spark, sf_dir, "benchmark"), lines, "item_id", ["doc_id", "line_no"])


GRAMS = """t as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') t from documents),
e as (select doc_id, t, unnest(range(0, len(t) - 7)) i from t where len(t) >= 16),
g as (select doc_id, i, array_to_string(list_slice(t, i + 1, i + 8), ' ') g from e),
f as (select doc_id, i, min(i) over (partition by doc_id, g) "first" from g),
h as (select doc_id, i, "first" from f where i >= "first" + 8)"""


@query(f"with {GRAMS} select doc_id, count(*) repeats from h group by doc_id")
def duplicate_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = align.repeated_ngrams(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return hits.groupBy("doc_id").agg(F.count("*").alias("repeats"))


@query(f"""with {GRAMS}, s as (select *, i - "first" shift, i - row_number() over (partition by doc_id, i - "first" order by i) island from h)
select doc_id, min(i)::int "start", min("first")::int "first", (count(*) + 7)::bigint length from s group by doc_id, shift, island""")
def duplicate_passage_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = align.passage_runs(align.repeated_ngrams(table(spark, sf_dir, "documents"), "doc_id", F.col("text")), "doc_id")
    return runs.select("doc_id", F.col("start").cast("int").alias("start"), F.col("first").cast("int").alias("first"), F.col("length").cast("long").alias("length"))


@query()
def duplicate_passage_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of eight words or more that a document has twice, as it prints them."""
    return align.repeated_passages(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))


SPELL = f"""w as (select lang, unnest({TOKENS.format('text')}) word from documents),
f as (select word, count(*) >= 5 known from w group by word having length(word) >= 3),
b as (select word, known, translate(word, '{FROM}', '{TO}') bare, length(regexp_replace(word, '[^{FROM}]', '', 'g')) marks from f),
k as (select bare, count(distinct word) n, min(word) correction, min(marks) m from b where known group by bare)"""


@query(f"with {SPELL} select word, correction from b join k using (bare) where not known and marks > 0 and n = 1 and marks = m")
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare accented words of documents that have the letters of one frequent word."""
    words = tokens_freq(spark, sf_dir).select("word", (F.col("n") >= 5).alias("known"))
    return align.respellings(words)


@query("""with s as (select doc_id, lower(text) t from documents), p as (select doc_id, string_split(t, 'tion') p from s)
select doc_id, (len(p) - 1)::bigint hits, (length(p[1]) + 1)::int first_at from p where len(p) > 1""")
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.operators.ops_log import search_hits as search

    hits = search(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "tion")
    return hits.groupBy("doc_id").agg(F.count("*").alias("hits"), F.min("at").cast("int").alias("first_at"))


@query("""with x as (select doc_id, text, n_chars, lag(text) over w before, lead(text) over w after from documents window w as (partition by source order by doc_id))
select doc_id, right(before, 30) before_tail, left(after, 30) after_head from x""")
def neighbour_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last characters of the document before and first of the one after, within a source."""
    from pyspark.sql.window import Window

    spot = Window.partitionBy("source").orderBy("doc_id")
    ends = table(spark, sf_dir, "documents").select("source", "doc_id", F.right("text", F.lit(30)).alias("t"), F.left("text", F.lit(30)).alias("h"))
    return ends.select("doc_id", F.lag("t").over(spot).alias("before_tail"), F.lead("h").over(spot).alias("after_head"))
