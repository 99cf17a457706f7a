"""Articles of a volume: led by its table of contents, or by its pages where the contents are of no use.

A volume has pages (owner, pdf, kind, failed) and on them pieces (owner, pdf, ord, starts, title, rubric, about, continues_on,
continued_from), contents lines (owner, line, title, rubric, printed) and segments that turn printed numbers into pages. The results
are relations: articles, the pages each owns (a page may have several owners) and the pieces that are doubtful.

Contents-led stitching is joins and windows: lines and heads of a page meet on their words, pages go to the last line before
them, and doubt, which sets, resets or stays from page to page, is the last value that is not "stays". Page-led stitching is
one ordered fold over the pieces of a volume (`aggregate` over an array), since who owns a piece depends on what was owned before.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.functions.text import similar, tokens
from quire.operators.rules import NOT_EDITORIAL
from quire.sources.shared import written

#: Fewer contents lines than this that lie in the volume are too few to build on.
LEAST_LINES = 3
#: A section takes short pieces up to so many pages after its last page.
SECTION_GAP = 2
SHARE = 0.5


class Stitched(NamedTuple):
    """articles (owner, article, basis, title, rubric, about, line, certain), owned (owner, article, pdf, how),
    doubtful (owner, article, pdf, ord)."""

    articles: DataFrame
    owned: DataFrame
    doubtful: DataFrame


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def with_page(rows: DataFrame, segments: DataFrame, owner: str, printed: str, name: str, step: int = 1) -> DataFrame:
    """`rows` with `name`: the page that a printed number means, by the first segment that holds it, or null."""
    of = segments.groupBy(F.col(owner).alias("__o")).agg(F.array_sort(F.collect_list(F.struct("from_page", "to_page", "offset"))).alias("__segments"))
    place = lambda s: F.floor((F.col(printed) - s["offset"]) / step)
    held = F.filter("__segments", lambda s: place(s).between(s["from_page"], s["to_page"]))
    joined = rows.join(of, F.col(owner) == F.col("__o"), "left")
    return joined.withColumn(name, F.get(F.transform(held, place), F.lit(0)).cast("int")).drop("__o", "__segments")


def similar_on(left: DataFrame, right: DataFrame, on: list[str], a: str, b: str) -> DataFrame:
    """(on, a, b) of rows (on, a, text) and (on, b, text) whose word sets overlap by half of the smaller or more; both meet on words."""
    side = lambda df, i, n: df.select(*on, i, F.array_distinct(tokens(F.col("text"))).alias("w")).select(*on, i, F.size("w").alias(n), F.explode("w").alias("w"))
    met = side(left, a, "x").join(side(right, b, "y"), [*on, "w"]).groupBy(*on, a, b)
    return met.agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y")).where(F.col("n") >= SHARE * F.least("x", "y")).select(*on, a, b)


def placed_lines(lines: DataFrame, pages: DataFrame, pieces: DataFrame, segments: DataFrame) -> DataFrame:
    """Contents lines in reading order with the page they name: (owner, line, title, rubric, pdf, place, sharing, head, last_here, until).

    Lines outside the volume go, volumes with under `LEAST_LINES` others have none, and of several lines for one page
    those that only describe another go: lines whose rubric is another's title, and, beyond the heads on that page, lines
    that are like no head (the first line stays if none is). `head` is the index of the first like head on the page; `place` counts
    from 1, lines of a page by their heads; `until` is the page where the next page's line begins; `last_here` marks
    the line that what follows goes to.
    """
    page, on = Window.partitionBy("owner", "pdf"), ["owner", "pdf"]
    named = with_page(lines.where(_filled(F.trim("title"))), segments, "owner", "printed", "pdf").where("pdf is not null")
    inside = named.join(pages.select(*on), on, "left_semi")
    enough = inside.withColumn("__n", F.count("*").over(Window.partitionBy("owner"))).where(F.col("__n") >= LEAST_LINES).drop("__n")
    heads = _heads(pieces)
    titles = enough.select(*on, F.col("line"), F.col("title").alias("text"))
    like = similar_on(titles, heads.select(*on, "at", F.col("title").alias("text")), on, "line", "at").groupBy(*on, "line").agg(F.min("at").alias("head"))
    rubrics = enough.where(_filled(F.col("rubric"))).select(*on, "line", F.col("rubric").alias("text"))
    told = similar_on(rubrics, titles.withColumnRenamed("line", "other"), on, "line", "other").where("line <> other").select(*on, "line").distinct()
    counts = heads.groupBy(*on).agg(F.count("*").alias("heads"))

    marked = enough.join(like, [*on, "line"], "left").join(told.withColumn("told", F.lit(True)), [*on, "line"], "left").join(counts, on, "left")
    marked = marked.withColumns({"told": F.coalesce("told", F.lit(False)), "room": F.greatest(F.lit(1), F.coalesce("heads", F.lit(0)))})
    marked = marked.withColumns({"here": F.count("*").over(page), "left": F.count_if(~F.col("told")).over(page)})
    kept = marked.where((F.col("here") < 2) | ~F.col("told"))
    kept = kept.withColumn("liked", F.count("head").over(page))
    order = F.row_number().over(page.orderBy(F.col("head").isNull(), "line"))
    tight = (F.col("here") >= 2) & (F.col("left") > F.col("room"))
    chosen = F.when(F.col("liked") > 0, F.col("head").isNotNull() & (F.col("__order") <= F.col("room"))).otherwise(F.col("__order") == 1)
    kept = kept.withColumn("__order", order).where(~tight | chosen)

    size = pieces.groupBy(*on).agg(F.count("*").alias("__pieces"))
    ranked = kept.join(size, on, "left").withColumn("__rank", F.coalesce("head", "__pieces", F.lit(0)))
    reading = Window.partitionBy("owner").orderBy("pdf", "__rank", "line")
    last = pages.groupBy(F.col("owner").alias("__o")).agg((F.max("pdf") + 1).alias("__end"))
    following = F.lead("pdf").over(reading)
    out = ranked.withColumns({"place": F.row_number().over(reading), "sharing": F.count("*").over(page), "__next": following})
    out = out.join(last, F.col("owner") == F.col("__o")).withColumns(
        {"last_here": F.col("__next").isNull() | (F.col("__next") != F.col("pdf")), "until": F.coalesce("__next", "__end").cast("int")}
    )
    return out.select("owner", "line", "title", "rubric", "pdf", "place", "sharing", "head", "last_here", "until")


def _heads(pieces: DataFrame) -> DataFrame:
    """Pieces that start something and have a title, with `at`, their index among the pieces of their page."""
    at = F.row_number().over(Window.partitionBy("owner", "pdf").orderBy("ord")) - 1
    return pieces.withColumn("at", at).where(F.col("starts") & _filled(F.col("title")))


def headlines(placed: DataFrame, pieces: DataFrame) -> DataFrame:
    """`placed` with the article's title, rubric and about: (head_title, head_rubric, about).

    The like head on the page gives them; so does the page's only head where only one line names the page, in whatever
    words; else the line itself does, and `about` is that of the page's first piece.
    """
    on, heads = ["owner", "pdf"], _heads(pieces)
    only = heads.groupBy(*on).agg(F.count("*").alias("__heads"), F.min("at").alias("__only"))
    first = pieces.groupBy(*on).agg(F.min_by("about", "ord").alias("__first"))
    chosen = F.coalesce("head", F.when((F.col("sharing") == 1) & (F.col("__heads") == 1), F.col("__only")))
    told = placed.join(only, on, "left").join(first, on, "left").withColumn("at", chosen)
    shown = heads.select(*on, "at", F.col("title").alias("__title"), F.col("rubric").alias("__rubric"), F.col("about").alias("__about"))
    met = told.join(shown, [*on, "at"], "left")
    return met.withColumns(
        {
            "head_title": F.coalesce("__title", "title"),
            "head_rubric": F.coalesce("__rubric", "rubric"),
            "about": F.coalesce(F.when(F.col("at").isNotNull(), F.col("__about")).otherwise(F.col("__first")), F.lit("")),
        }
    ).drop("at", "__heads", "__only", "__first", "__title", "__rubric", "__about")


def by_contents(lines: DataFrame, pages: DataFrame, pieces: DataFrame, segments: DataFrame) -> Stitched:
    """Each contents line opens an article on its page, and the pages up to the next line's belong to it.

    Failed pages come along (the article is then not certain), pages of a kind that holds no article don't, pages without pieces
    do. A piece there that starts something, and what runs on from doubted pieces of the page before, is doubtful unless its title or
    rubric is like the article's. The head of the next line's page belongs to the article if something stands before
    it; so do the pages it "continues on". What stands before the first line becomes articles that are not certain.
    """
    on = ["owner", "pdf"]
    # what several results start from is written: each is worked out once, and its plan stays small
    placed = written(placed_lines(lines, pages, pieces, segments), "placed")
    articles = written(headlines(placed, pieces).withColumnRenamed("place", "article"), "articles")
    opened = articles.where("last_here").select("owner", F.col("pdf").alias("__at"), "article", "until", "title", "rubric", "head_title", "head_rubric")
    start = articles.select("owner", "article", "pdf", F.lit("start").alias("how"))

    # the last line before a page: an as-of join as one ordered stream, pages before the lines of the same page
    spot = Window.partitionBy("owner").orderBy("pdf", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    marks = opened.select("owner", F.col("__at").alias("pdf"), F.lit(1).alias("__kind"), F.struct("article", "until", "title", "rubric", "head_title", "head_rubric").alias("__mark"))
    stream = pages.select("owner", "pdf", "kind", "failed", F.lit(0).alias("__kind")).unionByName(marks, allowMissingColumns=True)
    inner = stream.withColumn("of", F.last("__mark", ignorenulls=True).over(spot)).where("__kind = 0 and of is not null and pdf < of.until").select("owner", "pdf", "kind", "failed", "of.*")
    inner = written(inner, "inner")

    like = lambda x, *ys: F.coalesce(F.exists(F.array(*[similar(x, y) for y in ys]), lambda s: F.coalesce(s, F.lit(False))), F.lit(False))
    renamed = pieces.withColumnsRenamed({"title": "p_title", "rubric": "p_rubric"})
    own_title = like(F.col("p_title"), F.col("title"), F.col("head_title"))
    own_rubric = like(F.col("p_rubric"), F.col("rubric"), F.col("head_rubric"), F.col("title"))
    text = written(inner.join(renamed, on).select("owner", "article", "pdf", "ord", "starts", "about", (own_title | own_rubric).alias("own")), "text")
    foreign = text.groupBy("owner", "article", "pdf").agg(
        F.count("*").alias("n"), F.bool_or(F.col("starts") & ~F.col("own")).alias("new"), F.bool_or(~F.col("starts") & ~F.col("own")).alias("running")
    )
    held = inner.join(foreign, ["owner", "article", "pdf"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    apart = F.col("kind").isin(*NOT_EDITORIAL)
    # doubt is set, reset, or stays as it was on the page before (null)
    state = F.when(F.col("failed"), None).when(apart, False).when(F.col("n") == 0, None).when(F.col("new"), True).when(F.col("running"), None).otherwise(False)
    before = Window.partitionBy("owner", "article").orderBy("pdf").rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("doubted", F.coalesce(F.last(state, ignorenulls=True).over(before), F.lit(False)))
    how = F.when(F.col("failed"), "failed").when(apart, None).when(F.col("n") == 0, "photo").otherwise("inside")
    inside = written(held.withColumn("how", how).where("how is not null").select("owner", "article", "pdf", "doubted", "how"), "inside")
    doubts = inside.where("how = 'inside'").select("owner", "article", "pdf", "doubted").join(text, ["owner", "article", "pdf"])
    doubts = doubts.withColumn("doubt", (F.col("starts") | F.col("doubted")) & ~F.col("own"))
    doubtful = doubts.where("doubt").select("owner", "article", "pdf", "ord")

    at = F.row_number().over(Window.partitionBy(*on).orderBy("ord")) - 1
    opens = pieces.withColumn("__i", at).where("starts").groupBy(*on).agg(F.min("__i").alias("opens")).where("opens > 0")
    whole = pages.where(~F.col("failed")).select(*on)
    tails = opened.select("owner", "article", F.col("until").alias("pdf")).join(opens, on).join(whole, on, "left_semi").select("owner", "article", "pdf", F.lit("tail").alias("how"))

    reached = inside.select("owner", "article", "pdf", "how").union(tails)
    ours = reached.union(start.join(opened.select("owner", "article"), ["owner", "article"], "left_semi"))
    onward = ours.join(pieces.where("continues_on is not null").select(*on, "continues_on"), on).select("owner", "article", "continues_on").distinct()
    target = with_page(onward, segments, "owner", "continues_on", "pdf").where("pdf is not null").select("owner", "article", "pdf").distinct()
    jumps = target.join(ours, ["owner", "article", "pdf"], "left_anti").withColumn("how", F.lit("jump"))

    first = articles.groupBy("owner").agg(F.min("pdf").alias("__first"), F.max("article").alias("__last"))
    early = pieces.join(pages.where(~F.col("failed") & ~apart).select(*on), on, "left_semi").join(first, "owner").where(F.col("pdf") < F.col("__first"))
    reading = Window.partitionBy("owner").orderBy("pdf", "ord")
    early = early.withColumn("__opens", F.when(F.col("starts") | (F.row_number().over(reading) == 1), 1).otherwise(0))
    early = early.withColumn("article", F.col("__last") + F.sum("__opens").over(reading.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    extra = early.select("owner", "article", "pdf", F.lit("extra").alias("how")).distinct()

    certain = inside.where("how = 'failed'").select("owner", "article").union(articles.join(pages.where("failed").select(*on), on, "left_semi").select("owner", "article")).distinct()
    spare = doubts.where("not doubt").groupBy("owner", "article", "pdf").agg(F.min_by("about", "ord").alias("about"))
    spare = spare.where(_filled(F.col("about"))).groupBy("owner", "article").agg(F.min_by("about", "pdf").alias("__spare"))
    made = articles.join(certain.withColumn("__doubt", F.lit(True)), ["owner", "article"], "left").join(spare, ["owner", "article"], "left").select(
        "owner", "article", F.lit("contents").alias("basis"), F.col("head_title").alias("title"), F.col("head_rubric").alias("rubric"),
        F.when(_filled(F.col("about")), F.col("about")).otherwise(F.coalesce("__spare", F.lit(""))).alias("about"), "line", F.col("__doubt").isNull().alias("certain"),
    )
    lead = early.where("__opens = 1").select("owner", "article", F.lit("contents").alias("basis"), "title", "rubric", F.col("about").alias("__a"))
    told = early.where(_filled(F.col("about"))).groupBy("owner", "article").agg(F.min_by("about", F.struct("pdf", "ord")).alias("about"))
    lead = lead.join(told, ["owner", "article"], "left").select("owner", "article", "basis", "title", "rubric", F.coalesce("about", F.lit("")).alias("about"), F.lit(None).cast("int").alias("line"), F.lit(False).alias("certain"))
    owned = start.union(reached).union(jumps).union(extra).groupBy("owner", "article", "pdf").agg(F.min("how").alias("how"))
    return Stitched(made.unionByName(lead), owned, doubtful)


#: What the fold keeps of a volume: the running article and the one before this page, the open section, and who owns which page.
_STATE = (
    "struct<made: int, running: int, before: int, page: int, opened: boolean, section: int, words: array<string>, near: int, "
    "owned: array<struct<article: int, pdf: int>>, ahead: array<struct<pdf: int, article: int>>, out: array<struct<pdf: int, ord: int, article: int, how: string>>>"
)


def _owners(events: DataFrame) -> DataFrame:
    """(owner, pdf, ord, article, how) of the pieces and failed pages of a volume, given in one ordered array `events`.

    `how` is `opens`, `section`, `from` (continued from a page), `onto` (a page named before), `back` (the article that ran when the
    page began, after one opened here), `runs` or `failed`; failed pages have ord -1.
    """
    none = F.lit(None).cast("int")
    empty = F.from_json(F.lit('{"made": 0, "page": -1, "opened": false, "owned": [], "ahead": [], "out": []}'), _STATE)

    def step(s: Column, e: Column) -> Column:
        fresh = e["pdf"] != s["page"]
        before = F.when(fresh, s["running"]).otherwise(s["before"])
        opened = F.when(fresh, False).otherwise(s["opened"])
        source = F.array_min(F.transform(F.filter(s["owned"], lambda o: o["pdf"] == e["from_pdf"]), lambda o: o["article"]))
        source = F.when(~e["failed"] & ~e["starts"] & e["from_pdf"].isNotNull(), source)
        onto = F.when(~e["failed"] & ~e["starts"], F.element_at(F.concat(F.array(F.struct(F.lit(0).alias("pdf"), none.alias("article"))), F.filter(s["ahead"], lambda j: j["pdf"] == e["pdf"])), -1)["article"])
        shared = F.size(F.array_intersect(e["words"], s["words"]))
        near = s["section"].isNotNull() & (e["pdf"] - s["near"] <= SECTION_GAP)
        under = F.coalesce(e["starts"] & near & (shared > 0) & (shared >= SHARE * F.least(F.size(e["words"]), F.size(s["words"]))), F.lit(False))
        how = (
            F.when(e["failed"], F.when(s["running"].isNotNull(), "failed"))
            .when(source.isNotNull(), "from")
            .when(onto.isNotNull(), "onto")
            .when(under, "section")
            .when(e["starts"] | s["running"].isNull(), "opens")
            .when(opened & before.isNotNull(), "back")
            .otherwise("runs")
        )
        return F.struct(s.alias("s"), e.alias("e"), how.alias("how"), before.alias("before"), opened.alias("opened"), source.alias("source"), onto.alias("onto"))

    def settle(x: Column) -> Column:
        s, e, how = x["s"], x["e"], x["how"]
        new = s["made"] + 1
        article = (
            F.when(how == "from", x["source"]).when(how == "onto", x["onto"]).when(how == "section", s["section"]).when(how == "opens", new)
            .when(how == "back", x["before"]).otherwise(s["running"])
        )
        opens, jumped = how == "opens", how.isin("from", "onto")
        sections = opens & e["sections"]
        section = F.when(sections, new).otherwise(s["section"])
        add = lambda a, cond, x: F.when(cond, F.array_append(a, x)).otherwise(a)
        return F.struct(
            F.when(opens, new).otherwise(s["made"]).alias("made"),
            F.when(opens | (how == "section"), article).otherwise(s["running"]).alias("running"),
            x["before"].alias("before"),
            # a failed page begins nothing that a later piece could come back from
            F.when(e["failed"], s["page"]).otherwise(e["pdf"]).alias("page"),
            (x["opened"] | opens).alias("opened"),
            section.alias("section"),
            F.when(sections, e["words"]).otherwise(s["words"]).alias("words"),
            F.when(article == section, e["pdf"]).otherwise(s["near"]).alias("near"),
            add(s["owned"], how.isNotNull(), F.struct(article.alias("article"), e["pdf"].alias("pdf"))).alias("owned"),
            add(s["ahead"], e["on_pdf"].isNotNull() & ~F.coalesce(jumped, F.lit(False)), F.struct(e["on_pdf"].alias("pdf"), article.alias("article"))).alias("ahead"),
            add(s["out"], how.isNotNull(), F.struct(e["pdf"].alias("pdf"), e["ord"].alias("ord"), article.alias("article"), how.alias("how"))).alias("out"),
        ).cast(_STATE)

    # `transform` over one element names what a step works out, so that it is worked out once
    fold = F.aggregate("events", empty, lambda s, e: F.transform(F.array(step(s, e)), settle).getItem(0), lambda s: s["out"])
    return events.select("owner", F.explode(fold).alias("x")).select("owner", "x.*")


def by_pages(pages: DataFrame, pieces: DataFrame, segments: DataFrame, facing: DataFrame) -> Stitched:
    """Articles from the pages themselves.

    A piece that starts opens an article; others run on: from the page they are "continued from", on a page that an earlier
    piece "continues on", in the article that ran when the page began if one opened on it before them, else in the
    running one. An article opened without a title, or under a title like its rubric, is a section: starting pieces with
    a rubric like its own belong to it until it was `SECTION_GAP` pages ago. Failed pages go to the running article, which
    is then not certain; pages of kind "artikel" without pieces go to the article of the page they face (`facing` has
    (owner, left_page, right_page)), first to one that begins there. An article that begins without a start is not certain.
    """
    on = ["owner", "pdf"]
    apart = F.col("kind").isin(*NOT_EDITORIAL)
    words = F.when(_filled(F.col("rubric")), F.array_distinct(tokens(F.col("rubric"))))
    sections = words.isNotNull() & (~_filled(F.col("title")) | F.coalesce(similar(F.col("title"), F.col("rubric")), F.lit(False)))
    linked = with_page(with_page(pieces, segments, "owner", "continued_from", "from_pdf"), segments, "owner", "continues_on", "on_pdf")
    told = linked.join(pages.where(~F.col("failed") & ~apart).select(*on), on, "left_semi")
    event = F.struct("pdf", F.col("ord").cast("int").alias("ord"), "failed", "starts", "from_pdf", "on_pdf", words.alias("words"), sections.alias("sections"))
    failed = pages.where("failed").select("owner", "pdf", F.lit(-1).alias("ord"), "failed", F.lit(False).alias("starts"), *[F.lit(None).cast("int").alias(c) for c in ("from_pdf", "on_pdf")], *[F.lit(None).cast("string").alias(c) for c in ("title", "rubric")])
    rows = told.withColumn("failed", F.lit(False)).select(*failed.columns).union(failed)
    # one volume is one row: its pages are as many as a printed volume has
    events = rows.groupBy("owner").agg(F.array_sort(F.collect_list(event)).alias("events"))
    owned = written(_owners(events), "owned")

    on_page = owned.groupBy("owner", "article", "pdf").agg(F.when(F.bool_and(F.col("how") == "failed"), "failed").otherwise("text").alias("how"))
    first = owned.groupBy("owner", "article").agg(F.min_by("pdf", F.struct("pdf", "ord")).alias("begins"))
    both = facing.select("owner", F.col("left_page").alias("pdf"), F.col("right_page").alias("other")).union(facing.select("owner", "right_page", "left_page"))
    silent = pages.where("kind = 'artikel' and not failed").join(pieces.select(*on).distinct(), on, "left_anti").select(*on).join(both, on)
    across = silent.join(on_page.select("owner", "article", F.col("pdf").alias("other")), ["owner", "other"]).join(first, ["owner", "article"])
    photos = across.groupBy(*on).agg(F.min(F.struct((F.col("begins") != F.col("other")).alias("later"), "article")).alias("x")).select("owner", F.col("x.article").alias("article"), "pdf", F.lit("photo").alias("how"))

    parts = owned.where("ord >= 0").join(linked.select("owner", "pdf", F.col("ord").cast("int").alias("ord"), "title", "rubric", "about", "starts"), ["owner", "pdf", "ord"])
    order = F.struct("pdf", "ord")
    own_rubric = F.min_by(F.when(F.col("how").isin("opens", "runs"), F.nullif("rubric", F.lit(""))), F.when(F.col("how").isin("opens", "runs") & _filled(F.col("rubric")), order))
    made = parts.groupBy("owner", "article").agg(
        F.min_by("title", F.when(F.col("how") == "opens", order)).alias("title"), own_rubric.alias("rubric"),
        F.coalesce(F.min_by("about", F.when(_filled(F.col("about")), order)), F.lit("")).alias("about"),
        F.bool_and(~((F.col("how") == "opens") & ~F.col("starts"))).alias("headed"),
    )
    whole = owned.groupBy("owner", "article").agg((~F.bool_or(F.col("how") == "failed")).alias("whole"))
    articles = made.join(whole, ["owner", "article"]).select(
        "owner", "article", F.lit("pages").alias("basis"), "title", "rubric", "about", F.lit(None).cast("int").alias("line"), (F.col("headed") & F.col("whole")).alias("certain")
    )
    none = owned.where("false").select("owner", "article", "pdf", "ord")
    return Stitched(articles, on_page.union(photos), none)


def with_contents(found: Stitched, lines: DataFrame, segments: DataFrame) -> DataFrame:
    """The articles of `found` with what the contents say of them: title and rubric where the pages have none, `lines` (how many lines
    name the article's first page), `other_titles` (titles of such lines that are not like its own), and not certain where a
    line names a page inside it on which no article begins."""
    named = with_page(lines.where(_filled(F.trim("title"))), segments, "owner", "printed", "pdf").where("pdf is not null")
    named = named.select("owner", "line", F.col("title").alias("said"), F.col("rubric").alias("of"), "pdf")
    pages = found.owned.where("how <> 'photo'").groupBy("owner", "article").agg(F.min("pdf").alias("pdf"))
    first = pages.groupBy("owner", "pdf").agg(F.min("article").alias("article"))
    hits = first.join(named, ["owner", "pdf"]).groupBy("owner", "article").agg(
        F.count("*").alias("lines"), F.min_by("said", "line").alias("__title"), F.min_by("of", F.when(_filled(F.col("of")), F.col("line"))).alias("__rubric"), F.array_sort(F.collect_list(F.struct("line", "said"))).alias("__said")
    )
    inside = named.join(first, ["owner", "pdf"], "left_anti").join(found.owned, ["owner", "pdf"]).groupBy("owner", "pdf", "line").agg(F.min("article").alias("article"))
    doubted = inside.select("owner", "article").distinct().withColumn("__inside", F.lit(True))
    title = F.coalesce(F.nullif("title", F.lit("")), "__title")
    told = found.articles.join(hits, ["owner", "article"], "left").join(doubted, ["owner", "article"], "left").withColumn("title", title)
    other = F.filter(F.transform("__said", lambda s: s["said"]), lambda t: ~F.coalesce(similar(t, F.col("title")), F.lit(False)))
    return told.withColumns(
        {"rubric": F.coalesce(F.nullif("rubric", F.lit("")), "__rubric"), "lines": F.coalesce("lines", F.lit(0)), "other_titles": F.coalesce(other, F.array().cast("array<string>")), "certain": F.col("certain") & F.col("__inside").isNull()}
    ).drop("__title", "__rubric", "__said", "__inside")

