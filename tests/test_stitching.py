"""Stitching of all derived volumes against a replay, volume by volume and page by page."""

import re
from collections import defaultdict

import pytest

from quire.operators import stitching
from quire.operators.rules import NOT_EDITORIAL
from quire.plans import stitch_queries

SF = "/root/testdata/sf0.01"


def bag(text):
    return set(re.findall(r"[^\W_]+", (text or "").lower()))


def alike(a, b):
    x, y = bag(a), bag(b)
    return bool(x and y) and 2 * len(x & y) >= min(len(x), len(y))


class Volume:
    def __init__(self, pages, pieces, lines, segments, facing):
        self.pages = {p["pdf"]: p for p in pages}
        self.order = sorted(self.pages)
        self.on = defaultdict(list)
        for x in sorted(pieces, key=lambda x: (x["pdf"], x["ord"])):
            self.on[x["pdf"]].append(x)
        self.lines = sorted(lines, key=lambda x: x["line"])
        self.segments = sorted(segments, key=lambda s: s["from_page"])
        self.partner = {}
        for f in facing:
            self.partner[f["left_page"]], self.partner[f["right_page"]] = f["right_page"], f["left_page"]

    def page_of(self, printed):
        spots = [printed - s["offset"] for s in self.segments if printed is not None and s["from_page"] <= printed - s["offset"] <= s["to_page"]]
        return spots[0] if spots else None

    def editorial(self, pdf):
        return not self.pages[pdf]["failed"] and self.pages[pdf]["kind"] not in NOT_EDITORIAL

    def contents(self):
        """(articles, owned, doubts), or nothing where the contents are too few."""
        named = [(self.page_of(e["printed"]), e) for e in self.lines if (e["title"] or "").strip()]
        named = [(pdf, e) for pdf, e in named if pdf in self.pages]
        if len(named) < 3:
            return [], set(), set()
        kept = []
        for pdf in sorted({pdf for pdf, _ in named}):
            here = [e for p, e in named if p == pdf]
            heads = [(i, x) for i, x in enumerate(self.on[pdf]) if x["starts"] and x["title"]]
            seat = lambda e: next((i for i, x in heads if alike(x["title"], e["title"])), None)
            if len(here) > 1:
                own = [e for e in here if not any(o is not e and e["rubric"] and alike(e["rubric"], o["title"]) for o in here)]
                if len(own) > max(1, len(heads)):
                    seated = [e for e in own if seat(e) is not None]
                    own = seated[: max(1, len(heads))] if seated else own[:1]
                here = own
            kept += sorted(((pdf, len(self.on[pdf]) if seat(e) is None else seat(e), e["line"], e, heads) for e in here), key=lambda t: t[:3])
        articles, owned, doubts = [], set(), set()
        for n, (pdf, _, _, e, heads) in enumerate(kept, 1):
            sharing = sum(k[0] == pdf for k in kept)
            head = next((x for _, x in heads if alike(x["title"], e["title"])), None)
            if head is None and sharing == 1 and len(heads) == 1:
                head = heads[0][1]
            title, rubric = (head["title"], head["rubric"] if head["rubric"] is not None else e["rubric"]) if head else (e["title"], e["rubric"])
            about = (head["about"] if head else self.on[pdf][0]["about"] if self.on[pdf] else "") or ""
            certain, own = not self.pages[pdf]["failed"], {pdf}
            owned.add((n, pdf))
            if not any(k[0] == pdf for k in kept[n:]):
                stop = next((k[0] for k in kept if k[0] > pdf), max(self.order) + 1)
                doubted = False
                for p in [p for p in self.order if pdf < p < stop]:
                    if self.pages[p]["failed"]:
                        own.add(p)
                        certain = False
                    elif not self.editorial(p):
                        doubted = False
                    elif not self.on[p]:
                        own.add(p)
                    else:
                        own.add(p)
                        ours = lambda x: any(alike(x["title"], t) for t in (e["title"], title)) or any(alike(x["rubric"], t) for t in (e["rubric"], rubric, e["title"]))
                        odd = [x for x in self.on[p] if (x["starts"] or doubted) and not ours(x)]
                        doubts |= {(n, p, x["ord"]) for x in odd}
                        about = about or next((x["about"] for x in self.on[p] if x not in odd), "") or ""
                        doubted = bool(odd)
                if stop in self.pages and not self.pages[stop]["failed"]:
                    begin = next((i for i, x in enumerate(self.on[stop]) if x["starts"]), 0)
                    own |= {stop} if begin > 0 else set()
                for p in list(own):
                    for x in self.on[p]:
                        target = self.page_of(x["continues_on"])
                        own |= {target} - {None}
            owned |= {(n, p) for p in own}
            articles.append((n, title, rubric, about, e["line"], certain))
        n = len(kept)
        for p in self.order if kept else []:
            if p >= kept[0][0]:
                break
            for x in self.on[p] if self.editorial(p) else []:
                if x["starts"] or n == len(kept):
                    n += 1
                    articles.append((n, x["title"], x["rubric"], "", None, False))
                if not articles[-1][3] and x["about"]:
                    articles[-1] = (*articles[-1][:3], x["about"], *articles[-1][4:])
                owned.add((n, p))
        return articles, owned, doubts

    def by_pages(self):
        made, silent, ahead = [], [], {}
        running = section = None

        def take(a, p, x=None):
            if p not in a["pages"]:
                a["pages"].append(p)
            if x is not None and x["about"] and not a["about"]:
                a["about"] = x["about"]

        for p in self.order:
            if self.pages[p]["failed"]:
                if running:
                    take(running, p)
                    running["certain"] = False
                continue
            if not self.editorial(p) or not self.on[p]:
                silent.append(p)
                continue
            earlier, fresh = running, False
            for x in self.on[p]:
                source = self.page_of(x["continued_from"]) if not x["starts"] else None
                origin = next((a for a in made if source in a["pages"]), None) if source is not None else None
                if origin or (not x["starts"] and p in ahead):
                    take(origin or ahead[p], p, x)
                    continue
                if x["starts"] and section and x["rubric"] and alike(x["rubric"], section["rubric"]) and any(p - q <= 2 for q in section["pages"]):
                    owner = running = section
                elif x["starts"] or not running:
                    owner = running = {"title": x["title"], "rubric": x["rubric"], "about": "", "pages": [], "certain": bool(x["starts"])}
                    made.append(owner)
                    fresh = True
                    if x["rubric"] and (not x["title"] or alike(x["title"], x["rubric"])):
                        section = owner
                elif fresh and earlier:
                    owner = earlier
                else:
                    owner = running
                    owner["rubric"] = owner["rubric"] or x["rubric"]
                take(owner, p, x)
                target = self.page_of(x["continues_on"])
                if target is not None:
                    ahead[target] = owner
        for p in silent:
            other = self.partner.get(p)
            if self.pages[p]["kind"] == "artikel" and other is not None:
                owner = next((a for a in made if a["pages"][0] == other), None) or next((a for a in made if other in a["pages"]), None)
                if owner:
                    take(owner, p)
        owned = {(n, p) for n, a in enumerate(made, 1) for p in a["pages"]}
        for e in self.lines:
            pdf = self.page_of(e["printed"])
            hit = next((a for a in made if a["pages"][0] == pdf), None) if pdf is not None else None
            if hit:
                hit["lines"] = hit.get("lines", 0) + 1
                if not hit["title"]:
                    hit["title"] = e["title"]
                elif not alike(hit["title"], e["title"]):
                    hit.setdefault("other", []).append(e["title"])
                hit["rubric"] = hit["rubric"] or e["rubric"]
            else:
                inside = next((a for a in made if pdf in a["pages"]), None)
                if inside:
                    inside["certain"] = False
        rows = [(n, a["title"], a["rubric"], a["about"], a["certain"], a.get("lines", 0), tuple(a.get("other", ()))) for n, a in enumerate(made, 1)]
        return rows, owned


@pytest.fixture(scope="module")
def volumes(spark):
    found = defaultdict(lambda: {k: [] for k in ("pages", "pieces", "lines", "segments", "facing")})
    for name, df in stitch_queries.volume_tables(spark, SF).items():
        for r in df.collect():
            found[r["owner"]][name].append(r)
    assert len(found) > 1000
    return {k: Volume(**v) for k, v in found.items()}


def by_owner(rows, made):
    out = defaultdict(list)
    for r in rows:
        out[r["owner"]].append(made(r))
    return out


def test_contents_led(spark, volumes):
    found = stitch_queries.contents_led(spark, SF)
    articles = by_owner(found.articles.collect(), lambda r: (r["article"], r["title"], r["rubric"], r["about"], r["line"], r["certain"]))
    owned = by_owner(found.owned.collect(), lambda r: (r["article"], r["pdf"]))
    doubts = by_owner(found.doubtful.collect(), lambda r: (r["article"], r["pdf"], r["ord"]))
    seen = 0
    for k, v in volumes.items():
        rows, pages, odd = v.contents()
        assert sorted(articles[k]) == sorted(rows), k
        assert sorted(owned[k]) == sorted(pages), k
        assert sorted(doubts[k]) == sorted(odd), k
        seen += bool(odd)
    assert seen > 100


def test_page_led(spark, volumes):
    rows = stitch_queries.page_led_articles(spark, SF).collect()
    articles = by_owner(rows, lambda r: (r["article"], r["title"], r["rubric"], r["about"], r["certain"], r["lines"], tuple(r["other_titles"])))
    pages = stitch_queries.page_led_pages(spark, SF).collect()
    owned = by_owner(pages, lambda r: (r["article"], r["pdf"]))
    for k, v in volumes.items():
        made, own = v.by_pages()
        assert sorted(owned[k]) == sorted(own), k
        assert sorted(articles[k], key=str) == sorted(made, key=str), k
    assert {"text", "failed", "photo"} == {r["how"] for r in pages}


def test_empty_volumes(spark):
    v = {k: d.limit(0) for k, d in stitch_queries.volume_tables(spark, SF).items()}
    assert all(d.count() == 0 for d in stitching.by_contents(v["lines"], v["pages"], v["pieces"], v["segments"]))
    assert all(d.count() == 0 for d in stitching.by_pages(v["pages"], v["pieces"], v["segments"], v["facing"]))
