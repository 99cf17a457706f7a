"""Queries of the rules on pages, boxes, pieces of text and findings, with the SQL that states the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions import text
from quire.operators import rules
from quire.operators import type_styles as type_styles_of
from quire.sources.tables import boxes, table, turn_pairs

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


BOXES = """
bx as (select l_orderkey page, l_linenumber::bigint box, (l_partkey % 97 * 5)::double x, (l_suppkey % 89 * 7)::double y, l_quantity * 3 w,
  (l_quantity * 2 + l_linenumber)::double h from lineitem
  qualify row_number() over (partition by l_orderkey, l_linenumber order by l_partkey) = 1)
"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as boxes, of lines that repeat their number the one with the smallest part."""
    return boxes(table(spark, sf_dir, "lineitem"), "l_partkey")


@query(r"select doc_id, trim(regexp_replace(l, '^[#>*\-\s]+', '')) line, trim(regexp_replace(l, '^[#>*\-|\s]+', '')) row_ from (select doc_id, unnest(string_split(text, chr(10))) l from documents)")
def bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    return lines.select("doc_id", text.bare_line(F.col("l")).alias("line"), text.bare_line(F.col("l"), True).alias("row_"))


MONTHS = "[" + ", ".join(f"'{m}'" for m in text.MONTH_NAMES) + "]"


@query(f"""with d as (select o_orderkey, day(o_orderdate) d, {MONTHS}[month(o_orderdate)] m, year(o_orderdate) y from orders)
select o_orderkey, case o_orderkey % 3 when 0 then d || ' ' || m || ' ' || y when 1 then upper(m[1]) || m[2:] || ' ' || y else upper(m[1]) || m[2:] end printed from d""")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderkey") % 3 == 0, "day").when(F.col("o_orderkey") % 3 == 1, "month_year").otherwise("month")
    made = text.date_text(kind, F.dayofmonth("o_orderdate"), F.month("o_orderdate"), F.year("o_orderdate"))
    return table(spark, sf_dir, "orders").select("o_orderkey", made.alias("printed"))


@query(f"""with {BOXES}, p as (select *, greatest(0, least(100, floor(100 * x / 595 + 0.5)))::bigint x0, greatest(0, least(100, floor(100 * (x + w) / 595 + 0.5)))::bigint x1,
  greatest(0, least(100, floor(100 * y / 842 + 0.5)))::bigint y0, greatest(0, least(100, floor(100 * (y + h) / 842 + 0.5)))::bigint y1 from bx)
select page, box, round(100 * w * h / (595 * 842), 2) area_pct, round(1200 / (w / 72)) dpi, w > 1.15 * h spread,
  case when (y0 + y1) / 2 < 34 then 'top' when (y0 + y1) / 2 > 66 then 'bottom' else 'middle' end || ' ' ||
  case when (x0 + x1) / 2 < 34 then 'left' when (x0 + x1) / 2 > 66 then 'right' else 'centre' end ||
  ' of the page, ' || x0 || '-' || x1 || '% across and ' || y0 || '-' || y1 || '% down' spot from p""")
def box_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the page, resolution, shape and place of every box."""
    c, w, h = F.col, F.lit(595), F.lit(842)
    return _boxes(spark, sf_dir).select(
        "page", "box", rules.area_share(c("w"), c("h"), w, h).alias("area_pct"), rules.dots_per_inch(F.lit(1200), c("w")).alias("dpi"),
        (c("w") > 1.15 * c("h")).alias("spread"), rules.placed_at(c("x"), c("y"), c("w"), c("h"), w, h).alias("spot"),
    )


@query(f"""with {BOXES}, u as (select page, min(x) x, min(y) y, max(x + w) x1, max(y + h) y1 from bx group by page)
select page, x, y, x1 - x w, y1 - y h, x + (x1 - x) / 2 cx, y + (y1 - y) / 2 cy, greatest(0, least(1, (x1 - x) / 595)) filled, lpad(page::varchar, greatest(length(page::varchar), 2)::int, '0') label from u""")
def page_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The box around all boxes of a page, its centre, and the share of the width that it fills, at most 1."""
    x1, y1 = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    u = _boxes(spark, sf_dir).groupBy("page").agg(F.min("x").alias("x"), F.min("y").alias("y"), x1.alias("x1"), y1.alias("y1"))
    u = u.withColumns({"w": F.col("x1") - F.col("x"), "h": F.col("y1") - F.col("y")})
    label = F.lpad(F.col("page").cast("string"), F.greatest(F.char_length(F.col("page").cast("string")), F.lit(2)), F.lit("0"))
    return u.select(
        "page", "x", "y", "w", "h", (F.col("x") + F.col("w") / 2).alias("cx"), (F.col("y") + F.col("h") / 2).alias("cy"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("w") / 595)).alias("filled"), label.alias("label"),
    )


PIECES = """
pc as (select l_orderkey page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::bigint piece, p_name text,
  8 + p_size % 5 size, (l_partkey % 4 * 60)::double x, (l_suppkey % 3 * 12)::double y, 5.0 * length(p_name) w, p_brand font, l_partkey % 4096 colour
  from lineitem join part on l_partkey = p_partkey)
"""


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as pieces of type on one page per order: (page, piece, text, size, x, y, w, font, colour)."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = table(spark, sf_dir, "lineitem").withColumn("piece", F.row_number().over(order).cast("long"))
    return lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("page"), "piece", F.col("p_name").alias("text"), (8 + F.col("p_size") % 5).alias("size"),
        (F.col("l_partkey") % 4 * 60).cast("double").alias("x"), (F.col("l_suppkey") % 3 * 12).cast("double").alias("y"),
        (5.0 * F.char_length("p_name")).alias("w"), F.col("p_brand").alias("font"), (F.col("l_partkey") % 4096).alias("colour"),
    )


@query(f"""with {PIECES}, n as (select *, x - lag(x + w) over l g0, lag(size) over l s0, lead(x) over l - (x + w) g1, lead(size) over l s1 from pc
  window l as (partition by page, round(y * 2) order by x, piece))
select page, piece, coalesce(g0 <= greatest(size, s0) * 1.2, false) leftward, coalesce(g1 <= greatest(size, s1) * 1.2, false) rightward from n""")
def baseline_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.beside(_pieces(spark, sf_dir), "page").select("page", "piece", "leftward", "rightward")


@query(f"""with {PIECES}, m as (select *, lag(y) over l y0, lag(x + w) over l e0, greatest(size, lag(size) over l) me from pc window l as (partition by page order by piece))
select page, string_agg(case when y0 is null then '' when abs(y0 - y) >= me * 0.5 then chr(10) when x - e0 > me * 0.15 then ' ' else '' end || text, '' order by piece) text from m group by page""")
def glued_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.glued(_pieces(spark, sf_dir), "page", "piece")


@query(f"""with {PIECES}, m as (select *, case when lag(font) over l is not distinct from font then 0 else 1 end nw from pc window l as (partition by page order by piece)),
r as (select *, sum(nw) over (partition by page order by piece)::bigint run from m)
select page, run, font, min(piece) "first", max(piece) "last", count(*) pieces from r group by page, run, font""")
def type_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.face_runs(_pieces(spark, sf_dir), "page", "piece", "font")


BODY = """b as (select page, size, row_number() over (partition by page order by sum(length(trim(text))) desc, size) k from pc group by page, size),
f as (select pc.page, b.size, font, sum(length(trim(text)))::bigint weight, min(piece) seen from pc join b on b.page = pc.page and k = 1 and abs(pc.size - b.size) <= 0.6 group by pc.page, b.size, font),
bf as (select page, size, font, weight from f qualify row_number() over (partition by page order by weight desc, seen) = 1)"""


@query(f"with {PIECES}, {BODY} select page, font, weight from bf")
def body_face(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The font with most characters among the pieces set in the size of the running text."""
    return type_styles_of.body_faces(_pieces(spark, sf_dir), "page", "piece").select("page", "font", "weight")


#: Cuts that stand-in fonts are given by their part's number.
CUTS = ("Light", "Roman", "SemiBold", "BoldItalic", "ExtraLight", "Heavy", "MediumOblique", "Book", "Thin", "DemiKursiv")
CUT = "[" + ", ".join(f"'{c}'" for c in CUTS) + "]"
WEIGHT = """case when regexp_matches({0}, '(?i)black|heavy|fat|ultra[^l]|ultra$') then 90 when regexp_matches({0}, '(?i)extrabold|ultrabold') then 80
 when regexp_matches({0}, '(?i)semib|demib|semi|demi') then 60 when regexp_matches({0}, '(?i)bold') then 70 when regexp_matches({0}, '(?i)medium') then 50 when regexp_matches({0}, '(?i)book') then 45
 when regexp_matches({0}, '(?i)extralight|ultralight') then 20 when regexp_matches({0}, '(?i)light') then 30 when regexp_matches({0}, '(?i)thin|hairline') then 10 else 40 end"""


@query(f"""with {PIECES.replace("p_brand font", f"'F' || p_partkey % 3 || '-' || {CUT}[p_partkey // 3 % 10 + 1] font")}, {BODY}
select pc.page, piece, case when {WEIGHT.format("pc.font")} >= 70 or (split_part(pc.font, '-', 1) = split_part(bf.font, '-', 1) and abs(pc.size - bf.size) <= greatest(0.5, bf.size * 0.1)
  and {WEIGHT.format("pc.font")} > {WEIGHT.format("bf.font")}) then 'bold ' else '' end || case when regexp_matches(pc.font, '(?i)italic|oblique|kursiv') then 'italic' else '' end styles
from pc left join bf using (page)""")
def type_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces in cuts of three families, as bold or italic against the face of their own page."""
    parts = table(spark, sf_dir, "lineitem").withColumn("piece", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long"))
    cut = F.element_at(F.array(*map(F.lit, CUTS)), (F.floor(F.col("l_partkey") / 3) % 10 + 1).cast("int"))
    fonts = parts.select(F.col("l_orderkey").alias("page"), "piece", F.concat(F.lit("F"), F.col("l_partkey") % 3, F.lit("-"), cut).alias("cut"))
    pieces = _pieces(spark, sf_dir).join(fonts, ["page", "piece"]).withColumn("font", F.col("cut")).drop("cut")
    made = type_styles_of.styled(pieces, "page", "piece")
    shown = F.concat(F.when(F.array_contains("styles", "bold"), "bold ").otherwise(""), F.when(F.array_contains("styles", "italic"), "italic").otherwise(""))
    return made.select("page", "piece", shown.alias("styles"))


@query(f"""with {PIECES}, c as (select page, colour, count(*) n from pc group by page, colour),
m as (select page, colour from c qualify row_number() over (partition by page order by n desc, colour) = 1)
select page, (colour // 256) * 16 + 8 r, (colour // 16 % 16) * 16 + 8 g, colour % 16 * 16 + 8 b, abs((colour // 256) * 16 + 8 - 128) + abs((colour // 16 % 16) * 16 + 8 - 128) + abs(colour % 16 * 16 + 8 - 128) distance from m""")
def page_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest 12-bit colour of a page, and how far it is from mid grey."""
    mode = rules.commonest(_pieces(spark, sf_dir), "page", "colour", F.lit(1))
    part = lambda shift: F.shiftright("colour", shift).bitwiseAND(15) * 16 + 8
    made = mode.select("page", part(8).alias("r"), part(4).alias("g"), part(0).alias("b"))
    return made.withColumn("distance", F.abs(F.col("r") - 128) + F.abs(F.col("g") - 128) + F.abs(F.col("b") - 128))


TURNS = """
p as (select conv_id, turn, role, text, lag(text) over w src, lag(role) over w r0 from conversations window w as (partition by conv_id order by turn)),
t as (select conv_id, turn, text written, src source from p where role = 'assistant' and r0 = 'user'),
ww as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(written), '[\\p{L}\\p{N}]+')) word from t),
sw as (select distinct conv_id, turn, unnest(regexp_extract_all(lower(source), '[\\p{L}\\p{N}]+')) word from t)
"""


def _turn_words(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    pairs = turn_pairs(table(spark, sf_dir, "conversations"))
    return pairs.select("conv_id", "turn", F.explode(text.tokens(F.col(side))).alias("word"))


@query(f"""with {TURNS} select distinct w.conv_id, w.turn, w.word from ww w join sw s on w.conv_id = s.conv_id and w.turn = s.turn and length(w.word) >= 4 and length(s.word) >= 4
  and (starts_with(w.word, s.word) or starts_with(s.word, w.word) or ends_with(w.word, s.word) or ends_with(s.word, w.word)) and abs(length(w.word) - length(s.word)) >= 3""")
def broken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of an answer that are torn off a word of the question, or the other way round."""
    return rules.broken_off(_turn_words(spark, sf_dir, "written"), _turn_words(spark, sf_dir, "source"), ["conv_id", "turn"])


@query(f"""with {TURNS}, o as (select conv_id, turn, unnest(regexp_extract_all(lower(written), '[\\p{{L}}\\p{{N}}]+')) word, generate_subscripts(regexp_extract_all(lower(written), '[\\p{{L}}\\p{{N}}]+'), 1) ord from t),
u as (select o.*, s.word is null lacks from o left join sw s using (conv_id, turn, word)),
g as (select conv_id, turn, word || lead(word) over w glue, lacks and lead(lacks) over w pair from u window w as (partition by conv_id, turn order by ord))
select distinct g.conv_id, g.turn, glue from g join sw on sw.conv_id = g.conv_id and sw.turn = g.turn and contains(sw.word, glue) where pair""")
def compound_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unknown neighbours in an answer that glued together are in a word of the question."""
    key = ["conv_id", "turn"]
    source = _turn_words(spark, sf_dir, "source").distinct()
    pairs = turn_pairs(table(spark, sf_dir, "conversations"))
    own = pairs.select(*key, F.posexplode(text.tokens(F.col("written"))).alias("ord", "word"))
    told = own.join(source.withColumn("known", F.lit(True)), [*key, "word"], "left")
    spot = Window.partitionBy(*key).orderBy("ord")
    both = F.col("known").isNull() & F.lead("known").over(spot).isNull() & F.lead("word").over(spot).isNotNull()
    glue = told.select(*key, F.concat("word", F.lead("word").over(spot)).alias("glue"), both.alias("both")).where("both").select(*key, "glue").distinct()
    return glue.join(source, key).where(F.contains("word", "glue")).select(*key, "glue").distinct()


@query(r"""with l as (select doc_id, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) line from documents),
w as (select doc_id, line, text, list_distinct(list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda x: length(x) > 2)) ws from l),
a as (select doc_id, line, text, len(ws) n, unnest(ws) w from w where len(ws) >= 2), b as (select doc_id, line sentence, text other, unnest(ws) w from w)
select distinct doc_id, line::int - 1 line from (select a.doc_id, line, sentence, count(*) hit, any_value(n) n from a join b on a.doc_id = b.doc_id and a.w = b.w and a.text <> b.other group by all)
where hit >= least(3, n) and hit >= 0.8 * n""")
def sister_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document that another line of it says too."""
    lines = F.split("text", "\n")
    return rules.said_elsewhere(table(spark, sf_dir, "documents"), ["doc_id"], lines, lines)


WORDS = "list_filter(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 2)"


@query(f"""with t as (select doc_id, text source, regexp_replace(text, '[*#_~`]+', '', 'g') clean, case when doc_id % 2 = 0 then string_split(text, chr(10))[1] else lead(text) over (partition by doc_id // 2 order by doc_id desc) end written from documents),
x as (select doc_id, unnest({WORDS.format("source")}) w, 1 a, 0 b from t union all select doc_id, unnest({WORDS.format("clean")}), 0, 1 from t),
y as (select doc_id, unnest({WORDS.format("written")}) w from t),
xs as (select doc_id, w, greatest(sum(a), sum(b)) n from x group by doc_id, w), ys as (select doc_id, w, count(*) have from y group by all),
f as (select doc_id, sum(least(n, coalesce(have, 0)))::bigint found, sum(n)::bigint words from xs left join ys using (doc_id, w) group by doc_id),
g as (select doc_id, sum(have)::bigint written from ys where w not in ('image', 'crop', 'img', 'insert', 'continues', 'previous') group by doc_id),
l as (select doc_id, i, r from (select doc_id, unnest(ls) r, generate_subscripts(ls, 1) i from (select doc_id, list_transform(regexp_split_to_array(source, '\\n+'), lambda r: trim(regexp_replace(r, '^[#>*\\-|\\s]+', ''))) ls from t)) where length(r) > 20),
lw as (select doc_id, i, unnest({WORDS.format("r")}) w from l),
k as (select doc_id, i from lw left join ys using (doc_id, w) group by doc_id, i having count(*) >= 3 and count(have) < 0.4 * count(*)),
e as (select doc_id, string_agg(r, ' ' order by i) ev from l join k using (doc_id, i) group by doc_id), a as (select doc_id, string_agg(r, ' ' order by i) every from l group by doc_id),
z as (select doc_id, coalesce(words, 0) words, coalesce(found, 0) found, coalesce(g.written, 0) written, trim(regexp_replace(coalesce(nullif(ev, ''), every, ''), '\\s+', ' ', 'g')) ev from t left join f using (doc_id) left join g using (doc_id) left join e using (doc_id) left join a using (doc_id))
select doc_id, words, found, written, case when doc_id % 50 = 0 then 'failed' when written >= 80 then 'extra' else 'missing' end status,
  case when length(ev) <= 260 then ev else regexp_replace(left(ev, 260), '\\s+\\S*$', '') || '…' end evidence
from z where doc_id % 50 = 0 or (words >= 80 and found < 0.5 * words)""")
def page_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages: of an even one its first line was written, of an odd one the text of the one before; some failed."""
    docs = table(spark, sf_dir, "documents")
    two = Window.partitionBy(F.floor(F.col("doc_id") / 2)).orderBy(F.desc("doc_id"))
    written = F.when(F.col("doc_id") % 2 == 0, F.split("text", "\n")[0]).otherwise(F.lead("text").over(two))
    clean = F.regexp_replace("text", "[*#_~`]+", "")
    pages = docs.select("doc_id", F.col("text").alias("source"), clean.alias("clean"), written.alias("text"), F.when(F.col("doc_id") % 50 == 0, "time-out").alias("failed"))
    return rules.page_status(pages, ["doc_id"])


@query(r"""with b as (select doc_id, source, lang, ord, text, case ord % 4 when 3 then 'quote' when 2 then 'image' else 'paragraph' end kind, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) key,
  trim(regexp_replace(lower(first_value(text) over (partition by doc_id order by ord)), '[^\p{L}\p{N}]+', ' ', 'g')) head
  from (select doc_id, source, lang, unnest(string_split(text, chr(10))) text, generate_subscripts(string_split(text, chr(10)), 1) - 1 ord from documents)),
n as (select source, key from b where kind = 'paragraph' and length(key) between 1 and 90 group by source, key having count(distinct doc_id) >= 3)
select doc_id, ord::int ord, kind from b where kind = 'image' or not (key = '' or key = head or (length(head) > 12 and (starts_with(head, key) or starts_with(key, head)))
  or (kind = 'paragraph' and ((source, key) in (select (source, key) from n) or regexp_matches(trim(text), '^(?i:\d{1,4}|[ivxlcdm]{1,7}|pagina\s*\d+|blz\.?\s*\d+)$')
    or (length(key) <= 120 and trim(replace(replace(key, 'source ' || source, ' '), lang, ' ')) = ''))))""")
def kept_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as blocks, without furniture, credits and what the first line already says."""
    lines = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.split("text", "\n")[0].alias("head"), F.posexplode(F.split("text", "\n")).alias("ord", "text")
    )
    kind = F.when(F.col("ord") % 4 == 3, "quote").when(F.col("ord") % 4 == 2, "image").otherwise("paragraph")
    blocks = lines.withColumn("kind", kind)
    keyed = blocks.where("kind = 'paragraph'").select("source", "doc_id", text.compare_key(F.col("text")).alias("key"))
    short = keyed.where(F.char_length("key").between(1, 90))
    noise = short.groupBy("source", "key").agg(F.countDistinct("doc_id").alias("n")).where("n >= 3").select("source", "key")
    names = F.array(F.concat(F.lit("source "), "source"), "lang")
    return rules.kept_blocks(blocks, noise, "source", F.array("head"), names).select("doc_id", "ord", "kind")


@query("""with o as (select o_orderkey, case when o_orderkey % 2 = 0 then o_orderpriority end title from orders),
c as (select l_orderkey o_orderkey, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::bigint - 1 ord, l_returnflag text from lineitem)
select o_orderkey, 0::bigint ord, 'subheading' kind, title text from o where title <> ''
union all select o_orderkey, ord + (title is not null)::bigint, 'paragraph', text from c left join o using (o_orderkey)""")
def titles_as_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as boxes, their priority as the old title, their lines as children."""
    made = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("title"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    children = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), (F.row_number().over(order) - 1).cast("long").alias("ord"), F.lit("paragraph").alias("kind"), F.col("l_returnflag").alias("text")
    )
    return rules.titles_as_heads(made, children, "o_orderkey")


BLOCKS = "bk as (select l_orderkey page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice)::bigint - 1 ord, l_partkey part, l_quantity qty from lineitem)"


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), (F.row_number().over(order) - 1).cast("long").alias("ord"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty")
    )


@query(f"""with {BLOCKS}, m as (select page, min(part) % 5 f, max(part) % 5 t from bk group by page)
select page, row_number() over (partition by page order by case when ord = f then t + case when t > f then 0.5 else -0.5 end else ord end)::bigint - 1 ord, part, qty from bk join m using (page)""")
def moved_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One block of each page moved to another place."""
    rows = _blocks(spark, sf_dir)
    moves = rows.groupBy("page").agg((F.min("part") % 5).alias("from"), (F.max("part") % 5).alias("to"))
    return rules.moved(rows, moves, "page", "ord")


@query(f"""with {BLOCKS}, s as (select bk.*, case when qty < 10 then ord + 1 + part % 3 end src from bk), k as (select page, max(ord) last from bk group by page),
q as (select s.*, case when src <= last then src end source from s join k using (page))
select page, row_number() over (partition by page order by case when source > ord then source else ord end, coalesce(source > ord, false), case when source > ord then -ord else ord end)::bigint - 1 ord, part, qty from q""")
def pulls_after_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small blocks as quotes that go right behind their source, the last of several first."""
    rows = _blocks(spark, sf_dir)
    last = rows.groupBy("page").agg(F.max("ord").alias("last"))
    pulls = rows.where("qty < 10").join(last, "page").select("page", "ord", "last", (F.col("ord") + 1 + F.col("part") % 3).alias("source")).where("source <= last")
    return rules.after_source(rows, pulls.select("page", "ord", "source"), "page")


KEY = r"trim(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


@query(f"""with l as (select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 ord, unnest(string_split(text, chr(10))) t from documents),
k as (select doc_id, ord, {KEY.format("t")} k from l), e as (select doc_id, arg_max(k, ord) k from k where k <> '' group by 1),
q as (select doc_id, array_to_string(string_split(k, ' ')[2:7], ' ') q from e)
select q.doc_id, min(k.ord)::bigint source from q join k on k.doc_id = q.doc_id and contains(k.k, q.q) where length(q) >= 12 group by 1""")
def quote_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each document six words of its last line as a quote, and the first line that holds them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "text"), F.lit("paragraph").alias("kind"))
    keyed = lines.withColumn("k", text.compare_key(F.col("text"))).where("k <> ''").groupBy("doc_id").agg(F.max_by("k", "ord").alias("k"))
    quotes = keyed.select("doc_id", F.lit(-1).alias("ord"), F.array_join(F.slice(F.split("k", " "), 2, 6), " ").alias("text"), F.lit("quote").alias("kind"))
    found = rules.quote_sources(lines.union(quotes.select(*lines.columns)), "doc_id")
    return found.select("doc_id", F.col("source").cast("long").alias("source"))


@query("""with a as (select s_suppkey asset, s_name || '.png' file from supplier), i as (select p_partkey image, case when p_partkey % 3 = 0 then 'none.png' else 'Supplier#' || lpad((p_partkey % 1000)::varchar, 9, '0') || '.png' end file from part)
select image, i.file, coalesce(a.asset, b.asset) asset from i left join a using (file) left join a b on b.asset = i.image""")
def asset_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as images that name a supplier's file, else mean the supplier of their own number."""
    assets = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("asset"), F.concat("s_name", F.lit(".png")).alias("file"))
    name = F.concat(F.lit("Supplier#"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 9, "0"), F.lit(".png"))
    images = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), F.when(F.col("p_partkey") % 3 == 0, "none.png").otherwise(name).alias("file"))
    return rules.claimed(images, assets)


@query("""select user_id, row_number() over (partition by user_id order by case event_type when 'error' then 0 when 'purchase' then 1 else 2 end, coalesce(nullif(floor(value), 0), 0), event_id)::bigint place, event_id from events""")
def ordered_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as findings of a user: by severity, then page (none is 0), then as they came."""
    rank = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(rank, F.coalesce(F.floor("value"), F.lit(0)), "event_id"))
    return table(spark, sf_dir, "events").select("user_id", place.cast("long").alias("place"), "event_id")


@query("""select user_id, event_type, count(*) n, string_agg(event_id::varchar, ',' order by event_id) ids from events group by user_id, event_type having count(*) >= 3""")
def tally_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many events of a kind a user has, and which; kinds with fewer than three are left out."""
    made = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("event_id")).alias("ids"))
    return made.where("n >= 3").withColumn("ids", F.array_join("ids", ","))


@query("""select p.url_owner, p.place, p.page_id, sum(length(p.html)) over (partition by p.url_owner order by p.place)::bigint size from
(select regexp_extract(url, '^https?://([^/]*)', 1) url_owner, row_number() over (partition by regexp_extract(url, '^https?://([^/]*)', 1) order by page_id desc)::bigint place, page_id, html from pages) p""")
def newest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a host, newest first, with the characters up to each."""
    pages = table(spark, sf_dir, "pages").withColumn("url_owner", F.regexp_extract("url", "^https?://([^/]*)", 1))
    spot = Window.partitionBy("url_owner").orderBy(F.desc("page_id"))
    return pages.select("url_owner", F.row_number().over(spot).cast("long").alias("place"), "page_id", F.sum(F.char_length("html")).over(spot).alias("size"))


@query("""select event_id, '{"event_id":' || event_id || ',"user_id":' || user_id || ',"event_type":"' || event_type || '"}' line from events
where event_type in ('error', 'purchase', 'click') and value is not null""")
def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known events as one JSON line each."""
    known = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "purchase", "click") & F.col("value").isNotNull())
    return known.select("event_id", F.to_json(F.struct("event_id", "user_id", "event_type")).alias("line"))


@query("""select event_id, coalesce(nullif(trim(case when event_id % 3 = 0 then '' when event_id % 3 = 1 then event_type end), ''), 'plain') setting,
  coalesce(try_cast(json_extract_string(props, '$.k') as int), 50) price from events""")
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Settings with their defaults: empty is unset, what is no number is the default, and 0 is a price."""
    raw = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 1, F.col("event_type"))
    price = F.coalesce(F.get_json_object("props", "$.k").try_cast("int"), F.lit(50))
    return table(spark, sf_dir, "events").select("event_id", text.or_default(raw, F.lit("plain")).alias("setting"), price.alias("price"))


@query("""select p_partkey, p_name from part where (p_brand, p_size) in (select (p_brand, p_size) from part where p_partkey % 7 = 0) and lower(split_part(p_type, ' ', 1)) not in ('economy')""")
def pages_of_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as pages of the articles (brand and size) that are chosen, without the kind that holds none."""
    parts = table(spark, sf_dir, "part")
    chosen = parts.where("p_partkey % 7 = 0").select("p_brand", "p_size").distinct()
    kind = F.lower(F.split("p_type", " ")[0])
    return parts.join(chosen, ["p_brand", "p_size"], "left_semi").where(~kind.isin("economy")).select("p_partkey", "p_name")


@query(r"""with w as (select doc_id, list_filter(regexp_split_to_array(left(text, 200), '[^\p{L}\p{N}]+'), lambda x: x <> '') w from documents)
select doc_id, list_filter(list_transform(range(2, len(w) + 1), lambda i: lower(array_to_string(w[i:], ''))), lambda x: length(x) >= 4) tails from w""")
def context_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ever shorter contexts from the opening of each document (its first 200 characters are the context)."""
    return table(spark, sf_dir, "documents").select("doc_id", text.shorter_tails(F.left("text", F.lit(200))).alias("tails"))


FROM, TO = text.ACCENTED, text.FOLDED


@query(f"""select doc_id, translate(lower(text), '{FROM}', '{TO}') plain, length(regexp_replace(lower(text), '[^{FROM}]', '', 'g'))::int marks,
  nullif(trim(regexp_replace(text, '\\s+', ' ', 'g')), '') tidied from documents""")
def plain_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.unaccented(t).alias("plain"), text.accent_marks(t).alias("marks"), text.tidy(t).alias("tidied"))


@query("""select p_partkey, '#' || printf('%06X', (p_partkey * 7919 % 16777216)::int) colour, case when p_retailprice / 30 < 6 then 'small' when p_retailprice / 30 < 25 then 'medium' when p_retailprice / 30 < 55 then 'large' else 'full' end size,
  case when p_partkey % 2 = 0 then 'https://x.nl/' || p_partkey end link, split_part(p_name, ' ', 1) || ' en ' || split_part(p_name, ' ', 2) names from part""")
def printed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours, sizes, safe links and lists of names as they are printed."""
    key = F.col("p_partkey")
    colour = F.concat(F.lit("#"), F.lower(F.lpad(F.hex(key * 7919 % 16777216), 6, "0")))
    link = F.concat(F.when(key % 2 == 0, "https://x.nl/").otherwise("javascript:"), key)
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.hex_colour(colour).alias("colour"), text.printed_size(F.col("p_retailprice") / 30).alias("size"),
        text.safe_link(link).alias("link"), text.listed(F.slice(F.split("p_name", " "), 1, 2)).alias("names"),
    )


@query("""with p as (select p_partkey, p_name, p_brand, p_size, lag(p_name) over (partition by p_brand order by p_partkey) n0 from part),
s as (select *, list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+')) a, list_distinct(regexp_extract_all(lower(n0), '[\\p{L}\\p{N}]+')) b from p where n0 is not null)
select p_partkey, least(len(a), len(b)) > 0 and len(list_intersect(a, b)) >= 0.5 * least(len(a), len(b)) "same" from s""")
def similar_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a part's name is similar to that of the brand's part before it."""
    before = F.lag("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    made = table(spark, sf_dir, "part").withColumn("n0", before).where("n0 is not null")
    return made.select("p_partkey", text.similar(F.col("p_name"), F.col("n0")).alias("same"))
