"""Style patches on pages of nested blocks against a walk over each page."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quire.operators import style_patches
from quire.plans import style_queries


def places(text, needle):
    return [i for i in range(len(text)) if needle and text.startswith(needle, i)]


def walk(blocks, parts, patches):
    """(painted, dropped) of one page: blocks in order, each with its texts and the texts of its inner blocks."""
    blocks = sorted(blocks, key=lambda b: b["ord"])
    texts = {b["block"]: [p["text"] for p in sorted(parts, key=lambda p: p["part"]) if p["block"] == b["block"]] for b in blocks}
    kinds = {b["block"]: b["kind"] for b in blocks}
    inner = defaultdict(lambda: defaultdict(list))
    for p in sorted(parts, key=lambda p: p["part"]):
        if p["part_kind"] in ("paragraph", "list"):
            inner[p["block"]][p["child"]].append(p["text"])
    taken, dropped = [], {}
    for p in patches:
        find = p["find"].strip(" ")
        holds = lambda b: bool(find) and any(find in t for t in texts[b])
        block = p["target"] if p["target"] in kinds else next((b["block"] for b in blocks if holds(b["block"])), None)
        if block is None or not holds(block):
            dropped[p["patch"]] = "absent"
        else:
            taken.append((p, block, find))
    world = lambda b: b if kinds[b] == "insert" else ""
    whole = Counter()
    for p, b, find in taken:
        if any(len(t) >= 30 and find in t and len(find) >= 0.9 * len(t) for t in (" ".join(ts).strip(" ") for ts in inner[b].values())):
            whole.update((world(b), s) for s in p["styles"])
    body = sum(k in ("paragraph", "list") for k in kinds.values())
    face = {k for k, n in whole.items() if (n >= 1 if k[0] else body and n / body > 0.5)}
    painted = []
    for p, b, find in taken:
        styles = [s for s in p["styles"] if (world(b), s) not in face]
        if not styles:
            dropped[p["patch"]] = "face"
            continue
        spots = [(i, n) for i, t in enumerate(texts[b]) for n, _ in enumerate(places(t, find))]
        if len(spots) > (p["nth"] or 0):
            painted.append((p["patch"], b, *spots[p["nth"] or 0], find, tuple(styles)))
        else:
            dropped[p["patch"]] = "beyond"
    return sorted(painted), sorted(dropped.items())


def by_page(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["page"]].append(r)
    return out


def test_documents_as_pages(spark, sf):
    parts, blocks, patches = (by_page(d) for d in style_queries.styled_pages(spark, sf))
    painted, dropped = by_page(style_queries.painted_styles(spark, sf)), by_page(style_queries.dropped_styles(spark, sf))
    reasons = Counter()
    for page in blocks:
        want, lost = walk(blocks[page], parts[page], patches[page])
        assert sorted((r["patch"], r["block"], r["part"], r["at"], r["find"], tuple(r["styles"])) for r in painted[page]) == want, page
        assert sorted((r["patch"], r["reason"]) for r in dropped[page]) == lost, page
        reasons.update(r for _, r in lost)
    assert {"absent", "face", "beyond"} <= set(reasons) and sum(map(len, painted.values())) > 500


@pytest.mark.parametrize("text, needle, n", [("aaaa", "aa", 3), ("a.b a.b", "a.b", 2), ("x\\Ey \\E", "\\E", 2), ("abc", "", 0), ("", "a", 0)])
def test_overlapping_places_count(spark, text, needle, n):
    assert spark.createDataFrame([(text, needle)], "t string, n string").select(style_patches.times(F.col("t"), F.col("n"))).first()[0] == n


def test_empty_pages(spark, sf):
    assert all(d.count() == 0 for d in style_patches.apply_styles(*[d.limit(0) for d in style_queries.styled_pages(spark, sf)]))
