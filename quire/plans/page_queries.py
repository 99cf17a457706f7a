"""Page, layout, log, finding and package queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import findings, layout, ops_log, package, pages
from quire.plans.text_queries import LINES, _index_of
from quire.sources.tables import boxes, numbered_pages, table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


PAGES = """pg as (select l_suppkey "owner", row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_shipdate) pdf, l_linenumber printed from lineitem)"""
SEGMENTS = f"""{PAGES},
v as (select "owner", pdf, printed - pdf o from pg),
r as (select *, sum(case when o = l then 0 else 1 end) over (partition by "owner" order by pdf) run from (select *, lag(o) over (partition by "owner" order by pdf) l from v)),
a as (select "owner", run, o, min(pdf) pdf, count(*) support from r group by all),
b as (select * from (select *, sum(support) over (partition by "owner") total from a) where support >= 2 or total < 4),
c as (select *, sum(case when o = l then 0 else 1 end) over (partition by "owner" order by pdf) run2 from (select *, lag(o) over (partition by "owner" order by pdf) l from b)),
m as (select "owner", run2, o, min(pdf) pdf, sum(support) support from c group by all),
z as (select "owner", max(pdf) last from pg group by 1),
seg as (select "owner", case when lag(pdf) over w is null then 1 else pdf end from_page, coalesce(lead(pdf) over w - 1, last) to_page, o "offset", support::bigint support
  from m join z using ("owner") window w as (partition by "owner" order by pdf))"""


@query(f'with {SEGMENTS} select "owner", from_page::bigint from_page, to_page::bigint to_page, "offset"::bigint "offset", support from seg')
def offset_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.offset_segments(numbered_pages(table(spark, sf_dir, "lineitem")), "owner", "pdf", "printed")


@query(f"""with {SEGMENTS} select pg."owner", pg.pdf::int pdf, printed, (pg.pdf + "offset")::bigint folio from pg left join seg on pg."owner" = seg."owner" and pg.pdf between from_page and to_page""")
def folio_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbered = numbered_pages(table(spark, sf_dir, "lineitem"))
    return pages.folio_lookup(numbered, pages.offset_segments(numbered, "owner", "pdf", "printed"), "owner", "pdf")


@query("""with n as (select distinct l_suppkey "owner", l_orderkey p from lineitem),
i as (select *, p - row_number() over (partition by "owner" order by p) g from n),
r as (select "owner", min(p) a, max(p) b from i group by "owner", g)
select "owner", string_agg(case when a = b then a::varchar else a || '-' || b end, ',' order by a) ranges from r group by 1""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.page_ranges(table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "owner"), "owner", "l_orderkey")


@query(f"""with l as ({LINES}),
e as (select source, doc_id, arg_max(text, line_no) last, arg_min(text, line_no) first from l group by all),
n as (select source, doc_id, lead(doc_id) over w next_doc, last, lead(first) over w after from e window w as (partition by source order by doc_id))
select source, doc_id, next_doc, case when regexp_matches(last, '[-­]$') then regexp_replace(last, '[-­]$', '') || after else last || ' ' || after end joined
from n where after is not null and (regexp_matches(last, '[-­]\\s*$') or regexp_matches(after, '^\\s*\\p{{Ll}}'))""")
def seams(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.sources.tables import text_lines

    out = pages.seams(text_lines(table(spark, sf_dir, "documents")), "source", "doc_id", "line_no", "text")
    return out.withColumnRenamed("next_page", "next_doc")


@query("""with e as (select * from events)
select event_id, user_id, event_type, (select max_by(s.event_id, s.ts) from events s where s.user_id = e.user_id and s.event_type = 'signup' and s.ts <= e.ts) section from e where event_type <> 'signup'""")
def interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event with the user's last signup before it."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    starts = events.where("event_type = 'signup'").withColumnRenamed("event_id", "section")
    points = events.where("event_type <> 'signup'")
    return pages.interval_assign(starts, points, "user_id", F.col("ts"), "section").select("event_id", "user_id", "event_type", "section")


@query("""with s as (select o_custkey, o_orderdate::date d, min(o_orderkey) n from orders group by all),
w as (select o_custkey, lag(n) over (partition by o_custkey order by d) from_order, n to_order, d "at" from s)
select * from w where from_order is not null""")
def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").withColumn("at", F.to_date("o_orderdate"))
    return pages.transitions(days, "o_custkey", "at", "o_orderkey").withColumnsRenamed({"from_name": "from_order", "to_name": "to_order"})


@query(f"""with {PAGES}, f as (select "owner", pdf, printed, case printed % 3 when 0 then 'next' when 1 then 'previous' else 'none' end facing from pg),
x as (select *, lead(facing) over w nf, lead(pdf) over w np from f window w as (partition by "owner" order by pdf)),
y as (select "owner", pdf p, facing = 'next' and nf = 'previous' mutual from x where np = pdf + 1 and ((facing = 'next' and nf = 'previous') or ((facing = 'next' or nf = 'previous') and printed % 2 = 0))),
i as (select *, p - row_number() over (partition by "owner" order by p) g from y),
k as (select *, row_number() over (partition by "owner", g order by p) k from i)
select "owner", p::int left_page, (p + 1)::int right_page, mutual from k where k % 2 = 1""")
def spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    facing = F.when(F.col("printed") % 3 == 0, "next").when(F.col("printed") % 3 == 1, "previous").otherwise("none")
    return pages.spreads(numbered_pages(table(spark, sf_dir, "lineitem")).withColumn("facing", facing), "owner", "pdf", "facing", "printed")


@query("select l_partkey, count(distinct l_suppkey) owners, count(distinct l_suppkey) > 1 shared from lineitem group by 1")
def shared_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.shared_pages(table(spark, sf_dir, "lineitem"), "l_partkey", "l_suppkey")


BOXES = """bx as (select distinct on (l_orderkey, l_linenumber) l_orderkey page, l_linenumber::bigint box, (l_partkey % 97 * 5)::double x, (l_suppkey % 89 * 7)::double y,
 l_quantity * 3 w, l_quantity * 2 + l_linenumber h from lineitem)"""
TOUCH = f"""{BOXES},
tc as (select a.page, a.box a, b.box b from bx a join bx b on a.page = b.page and a.box <> b.box
  and a.x <= b.x + b.w + 1.5 and b.x <= a.x + a.w + 1.5 and a.y <= b.y + b.h + 1.5 and b.y <= a.y + a.h + 1.5),
rc(page, a, r) as (select page, box, box from bx union select rc.page, rc.a, tc.b from rc join tc on rc.page = tc.page and rc.r = tc.a),
gr as (select page, a box, min(r) "group" from rc group by all)"""


@query("""select l_orderkey, l_linenumber, case when l_returnflag = 'R' then 'shard' when least(l_quantity * 4, l_linenumber * 9) < 20 then 'pixels'
 when least(l_quantity, l_linenumber * 4) < 8 then 'points' when l_quantity / (l_linenumber * 4) > 20 or l_quantity / (l_linenumber * 4) < 0.05 then 'aspect'
 when l_discount < 0.0015 then 'share' end reason from lineitem""")
def decorative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each line item, read as an image of its quantity and line number, would be decoration."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    part_of = F.when(F.col("l_returnflag") == "R", F.lit("text"))
    reason = layout.decorative_reason(q * 4, n * 9, q, n * 4, F.col("l_discount") * 100, part_of)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


@query("""with f as (select *, min(o_orderdate::date) over (partition by o_custkey) d0 from orders)
select o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) hero from f where o_orderdate::date = d0 group by 1 having max(o_totalprice) >= 100000""")
def hero(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("page", F.to_date("o_orderdate"))
    return layout.hero(orders, "o_custkey", "page", "o_totalprice", "o_orderkey", 100000)


@query(f'with recursive {TOUCH} select page, box, "group" from gr')
def touching_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.groups(boxes(table(spark, sf_dir, "lineitem")), "page", "box", 1.5)


@query(f"""with recursive {TOUCH}, g as (select page, "group", count(*) pieces, max(x + w) - min(x) width, max(y + h) - min(y) height, max(w * h) largest from gr join bx using (page, box) group by all)
select page, "group", pieces, width, height from g where pieces >= 3 and largest < 0.6 * width * height""")
def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.mosaics(boxes(table(spark, sf_dir, "lineitem")), "page", "box", 1.5)


@query(f"""with recursive {BOXES}, rn as (select page, box, x, y, w, 6 + box % 5 * 4.0 h, (w // 3)::bigint chars from bx where w // 3 > 0),
tc as (select a.page, a.box a, b.box b from rn a join rn b on a.page = b.page and a.box <> b.box and greatest(a.y, b.y) - least(a.y + a.h, b.y + b.h) <= greatest(a.h, b.h) * 0.9
  and greatest(a.x, b.x) - least(a.x + a.w, b.x + b.w) <= greatest(a.h, b.h) * 0.8),
rc(page, a, r) as (select page, box, box from rn union select rc.page, rc.a, tc.b from rc join tc on rc.page = tc.page and rc.r = tc.a),
gr as (select page, a box, min(r) block from rc group by all)
select page, block, count(*) runs, min(x) x, min(y) y, max(x + w) - min(x) w, max(y + h) - min(y) h, sum(chars)::bigint chars from gr join rn using (page, box) group by page, block""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as runs of text of five sizes: the blocks they make."""
    runs = boxes(table(spark, sf_dir, "lineitem")).withColumns({"h": (6 + F.col("box") % 5 * 4).cast("double"), "chars": F.floor(F.col("w") / 3).cast("long")})
    return layout.text_blocks(runs, "page", "box")


@query("""with s as (select l_suppkey, round(l_quantity / 5) / 2 size, sum(l_linenumber)::bigint weight from lineitem group by all)
select l_suppkey, size, weight from (select *, row_number() over (partition by l_suppkey order by weight desc, size) r from s) where r = 1""")
def body_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.weighted_mode(table(spark, sf_dir, "lineitem"), "l_suppkey", F.round(F.col("l_quantity") / 5) / 2, F.col("l_linenumber"), "size")


@query("select p_brand, sum(l_quantity) units, round(sum(l_quantity * p_retailprice) / 1e6, 6) cost from lineitem join part on l_partkey = p_partkey group by 1")
def run_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey")
    return ops_log.cost(items, table(spark, sf_dir, "part"), "p_partkey", "p_brand", F.col("l_quantity"), "p_retailprice")


@query("""with c as (select *, count(*) over w tries, min(ts) over w oldest from events
  window w as (partition by user_id order by ts range between interval 599999999 microseconds preceding and current row))
select event_id, user_id, tries, case when tries > 2 then ceil(epoch(oldest + interval 600 seconds - ts))::bigint end retry_after from c""")
def rate_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_log.rate_limited(table(spark, sf_dir, "events"), "user_id", "ts", 600, 2).select("event_id", "user_id", "tries", "retry_after")


@query("""with n as (select event_id, event_type, epoch_us(ts) // 1000 t, row_number() over (partition by event_type order by epoch_us(ts) // 1000, event_id) - 1 i from events)
select event_id, event_type, (i * 1000000 + max(t - i * 1000000) over (partition by event_type order by i))::bigint starts_at from n""")
def slot_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_millis(F.col("ts").cast("timestamp")))
    return ops_log.slots(events, "event_type", F.col("at"), ["event_id"], 1_000_000).select("event_id", "event_type", "starts_at")


@query("select user_id, arg_max(event_type, (ts, event_id)) event_type, count(*) n from events group by 1")
def latest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_log.latest(table(spark, sf_dir, "events"), "user_id", "event_type", ["ts", "event_id"])


@query("""with r as (select user_id, event_type k0, ts started, lead(event_type) over w k, lead(ts) over w e from events where event_type in ('view', 'purchase')
  window w as (partition by user_id order by ts, case event_type when 'view' then 0 else 1 end))
select user_id, started, case when k = 'purchase' then e end ended from r where k0 = 'view'""")
def task_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops_log.task_pairs(table(spark, sf_dir, "events"), "user_id", "event_type", "ts", "view", "purchase")


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey and l_returnflag = 'R')")
def resume_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps still to do: orders none of whose items is marked done."""
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query()
def retry_better(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each conversation's answers, read as tries, the one that the retry rule keeps."""
    from quire.operators.coverage import index_check

    checks = index_check(*_index_of(spark, sf_dir))
    return ops_log.better_retry(checks, "conv_id", "turn", "used", "n_unknown", "n_overused")


@query("""with p as (select page_id, try_cast(regexp_extract(url, '(\\d+)', 1) as int) n from pages) select page_id, case when n between 1 and 9999 then n end printed from p""")
def printed_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.functions.text import printed_number

    return table(spark, sf_dir, "pages").select("page_id", printed_number(F.col("url")).alias("printed"))


DOC_FINDINGS = f"""l as ({LINES}),
k as (select source, doc_id, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) key, length(trim(text)) n from l),
c as (select source, key from k where n between 1 and 90 and key <> '' group by all having count(distinct doc_id) >= 3),
m as (select doc_id, ' ' || regexp_replace(text, '[^\\p{{L}}\\p{{N}}''’-]', '  ', 'g') || ' ' t from documents),
e as (select distinct doc_id, unnest(regexp_extract_all(t, ' ([b-tv-z]) ', 1)) letter from m),
fl as (select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) f from documents where regexp_matches(regexp_extract(text, '^\\s*(\\S)', 1), '\\p{{Ll}}')),
f as (select doc_id "owner", 'empty' kind, 'solve' severity, '' evidence from documents where trim(coalesce(text, '')) = ''
 union all select doc_id, 'symbols', 'solve', (length(text) - length(regexp_replace(text, '[*#$%&|<>]', '', 'g')))::varchar from documents where 20 * (length(text) - length(regexp_replace(text, '[*#$%&|<>]', '', 'g'))) > length(text)
 union all select doc_id, 'repeated_line', 'check', count(*)::varchar from k join c using (source, key) group by doc_id
 union all select doc_id, 'stray_letters', 'info', string_agg(letter, ' ' order by letter) from e group by doc_id
 union all select doc_id, 'lower_case_start', 'check', case when length(f) <= 20 then f else regexp_replace(left(f, 20), '\\s+\\S*$', '') || '…' end from fl)"""


@query(f'with {DOC_FINDINGS} select * from f')
def document_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return findings.document_findings(table(spark, sf_dir, "documents"))


@query(f"""with {DOC_FINDINGS}, v as (select "owner", count(*) filter (severity = 'solve') solve, count(*) filter (severity = 'check') "check", count(*) filter (severity = 'info') info from f group by 1)
select doc_id "owner", coalesce(solve, 0)::bigint solve, coalesce("check", 0)::bigint "check", coalesce(info, 0)::bigint info,
 case when coalesce(solve, 0) > 0 then 'to solve' when coalesce("check", 0) > 0 then 'to check' else 'ready' end verdict from documents left join v on v."owner" = doc_id""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return findings.verdicts(docs.select(F.col("doc_id").alias("owner")), findings.document_findings(docs))


@query(f"""with {DOC_FINDINGS} select f.* from f left join labels on doc_id = "owner" and quality = 1 where doc_id is null""")
def open_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of documents that no label calls good."""
    kinds = F.array(*map(F.lit, ("empty", "symbols", "repeated_line", "stray_letters", "lower_case_start")))
    ticked = table(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("owner"), F.explode(kinds).alias("kind"))
    return findings.open_findings(findings.document_findings(table(spark, sf_dir, "documents")), ticked)


NODES = """ln as (select doc_id, trim(t) text, ord - 1 ord from (select doc_id, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) ord from documents) where regexp_matches(t, '[\\p{L}\\p{N}]')),
nd as (select doc_id, ord::int ord, case when regexp_matches(text, '\\S \\| \\S') then 'row' when regexp_matches(text, '^[-*] ') then 'item'
  when length(text) < 40 and not regexp_matches(text, '[.!?…:;,]$') then 'heading' else 'paragraph' end kind, text from ln)"""


@query(f"with {NODES} select doc_id, 'doc:' || doc_id external_id, lang, ord, kind, text from nd join documents using (doc_id)".replace("kind, text from nd", "kind, nd.text from nd"))
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON packages and read back node by node."""
    docs = table(spark, sf_dir, "documents")
    made = package.packages(docs, "doc_id", F.col("text"), F.col("source"), F.col("lang"))
    return package.read_packages(made, "doc_id", "package").select("doc_id", "external_id", "lang", "ord", "kind", "text")


@query(f"""with {NODES} select doc_id, md5(string_agg(case kind when 'heading' then '### ' || text when 'item' then '- ' || substr(text, 3)
 else regexp_replace(text, '^([#>+*-]|\\d+\\.)', '\\\\\\1') end, chr(10) || chr(10) order by ord)) digest from nd group by 1""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return package.markdown(package.nodes(docs, "doc_id", F.col("text")), "doc_id").select("doc_id", F.md5("markdown").alias("digest"))


@query(f"""with {NODES}, t as (select *, case kind when 'heading' then 'h3' when 'item' then 'li' else 'p' end tag from nd)
select doc_id, md5(string_agg('<' || tag || '>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</' || tag || '>', chr(10) order by ord)) digest from t group by 1""")
def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return package.html(package.nodes(docs, "doc_id", F.col("text")), "doc_id").select("doc_id", F.md5("html").alias("digest"))


@query(f"with {NODES} select 'block-' || substr(sha1(doc_id || '/' || ord), 1, 16) id, doc_id, kind from nd")
def cms_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = package.cms_documents(package.nodes(docs, "doc_id", F.col("text")), "doc_id")
    return made.select("id", "doc_id", F.get_json_object("json", "$.kind").alias("kind"))


@query("""with a as (select distinct p_type || case when p_size % 2 = 0 then '' else ' ' end "name" from part), d as (select lower(trim(c_mktsegment)) k, min(c_custkey)::varchar id from customer group by 1)
select "name", coalesce(id, 'new-' || regexp_replace(regexp_replace(lower("name"), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) id, id is null created from a left join d on lower(trim("name")) = k""")
def resolve_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part types looked up among market segments, created where missing."""
    names = table(spark, sf_dir, "part").select(F.concat("p_type", F.when(F.col("p_size") % 2 == 0, "").otherwise(" ")).alias("n"))
    return package.resolve_dimension(names, "n", table(spark, sf_dir, "customer"), "c_mktsegment", "c_custkey")


@query("""select c_custkey, case when c_custkey % 3 = 0 then c_acctbal + 1 else c_acctbal end c_acctbal from customer""")
def upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with every third row replaced by its newest incoming version."""
    have = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(0).alias("v"))
    fresh = have.where("c_custkey % 3 = 0")
    incoming = fresh.withColumn("v", F.lit(1)).union(fresh.withColumns({"c_acctbal": F.col("c_acctbal") + 1, "v": F.lit(2)}))
    return package.upsert(have, incoming, "c_custkey", "v").select("c_custkey", "c_acctbal")
