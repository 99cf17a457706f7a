"""Unknown words, their source lines and their counterparts against a replay in plain Python."""

import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import align, rules
from quire.operators.unknown_words import MARKERS, nearest_in_order, unknown_word_findings
from quire.plans import article_queries
from quire.sources.tables import table, turn_pairs


def tokens(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def parts(t):
    return [x.strip(" ") for x in re.split(r"\n+|(?<=[.!?…])[ \t]+(?=[A-ZÀ-ÖØ-Þ\"'“‘(])", t or "") if x.strip(" ")]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last if x == y else 1 + min(last, row[j], row[j - 1])
    return row[-1]


def clip(t, most=260):
    flat = re.sub(r"\s+", " ", t).strip(" ")
    return flat if len(flat) <= most else re.sub(r"\s+\S*$", "", flat[:most]) + "…"


def counterparts(suspects, others):
    used = []
    for w in suspects:
        free = [o for o in others if o not in used]
        if free:
            used.append(min(free, key=lambda o: edits(w, o)))
    return used


def replay(written, source):
    known = set(tokens(source))
    lacking = [w for w in dict.fromkeys(tokens(written)) if len(w) > 2 and w not in known][:40]
    said = parts(written)
    lines = [x for x in (re.sub(r"^[#>*\-\s]+", "", r).strip(" ") for r in re.split(r"\n+", source or "")) if x]
    lines = [c for r in lines for c in parts(r)]
    held, loose = {}, []
    for w in lacking:
        if w in MARKERS:
            continue
        z = next((z for z in said if w in tokens(z)), None)
        loose.append(w) if z is None else held.setdefault(z, []).append(w)
    out, rest = [], loose
    for z, ws in held.items():
        inside = tokens(z)
        ws = sorted(ws, key=inside.index)
        own = {w for w in inside if w not in ws and len(w) > 2}
        scores = [len(own & set(tokens(c))) for c in lines]
        top = max(scores, default=0)
        line = lines[scores.index(top)] if len(own) >= 2 and top >= min(3, len(own)) and 2 * top >= len(own) else None
        there = tokens(line)
        torn = lambda w: len(w) >= 4 and any(len(t) >= 4 and t != w and abs(len(w) - len(t)) >= 3 and (w.startswith(t) or t.startswith(w) or w.endswith(t) or t.endswith(w)) for t in there)
        if len(ws) >= 2 and any("".join(ws) in t for t in there):
            continue
        suspects = [w for w in ws if not torn(w)]
        if not suspects:
            continue
        if line is None:
            rest = rest + suspects
            continue
        goal = {w for w in there if len(w) > 2}
        hits = [len(goal & set(tokens(o))) for o in said if o != z]
        if len(goal) >= 2 and any(h >= min(3, len(goal)) and 5 * h >= 4 * len(goal) for h in hits):
            continue
        if len(out) >= 6:
            rest = rest + suspects
            continue
        others = [w for w in dict.fromkeys(there) if len(w) > 2 and w not in inside and w not in suspects]
        out.append((len(out) + 1, "swap", " ".join(suspects), " ".join(counterparts(suspects, others)), clip(z), clip(line)))
    if len(rest) >= 5:
        out.append((None, "rest", " ".join(rest), None, None, None))
    return out


def compare(found, rows, key):
    got = defaultdict(list)
    for r in found.collect():
        got[tuple(r[k] for k in key)].append((r["place"], r["kind"], r["words"], r["counterparts"], r["sentence"], r["line"]))
    kinds = defaultdict(int)
    for r in rows:
        want = replay(r["written"], r["source"])
        assert sorted(got[tuple(r[k] for k in key)], key=str) == sorted(want, key=str), r[key[0]]
        for x in want:
            kinds[x[1]] += 1
    return kinds


def test_answers(spark, sf):
    rows = turn_pairs(table(spark, sf, "conversations")).collect()
    compare(article_queries.unknown_word_findings(spark, sf), rows, ["conv_id", "turn"])


def test_changed_documents(spark, sf):
    found = article_queries.changed_word_findings(spark, sf)
    docs = table(spark, sf, "documents").collect()
    twice = lambda t: re.sub(r"(?m)(\b[^\W\d_]{2})([^\W\d_])([^\W\d_]{4,}(?![^\W\d_])[\W\d_]*?)$", r"\1\2\2\3", t or "")
    written = {r["doc_id"]: r["w"] for r in table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", r"(?m)(\b\p{L}{2})(\p{L})(\p{L}{4,}\P{L}*)$", "$1$2$2$3").alias("w")).collect()}
    assert any(twice(r["text"]) == written[r["doc_id"]] for r in docs)
    rows = [{"doc_id": r["doc_id"], "written": written[r["doc_id"]], "source": r["text"]} for r in docs]
    assert compare(found, rows, ["doc_id"])["swap"] > 50


SMALL = [
    ("De gemeente kocht zeven happyness woningen aan.", "De gemeente kocht zeven happiness woningen aan."),
    ("Het honk vast team speelde gisteren goed mee.", "Het honkvast team speelde gisteren goed mee."),
    ("Aantal vakantiewoningen per gemeente hier. Aantal vakantiewoningen per provincie hier.", "Aantal vakantiewoningen per provincie hier."),
    ("Alfa bravo charlie delta echo foxtrot. Golf hotel.", "iets heel anders staat daar"),
    (None, "bron"),
    ("tekst zonder bron hierbij geplaatst vandaag", None),
    ("image crop vreemd", ""),
]


def test_small_pages(spark):
    rows = [{"k": i, "written": w, "source": s} for i, (w, s) in enumerate(SMALL)]
    df = spark.createDataFrame([(r["k"], r["written"], r["source"], "x") for r in rows], "k int, written string, source string, rank string")
    found = unknown_word_findings(df.select("k", "written", "source"), ["k"], "written", "source")
    kinds = compare(found, rows, ["k"])
    assert kinds["swap"] and kinds["rest"]
    assert unknown_word_findings(df.limit(0).select("k", "written", "source"), ["k"], "written", "source").count() == 0


def test_suspects_go_in_order(spark):
    s = spark.createDataFrame([(1, "word", 0), (1, "worded", 1), (2, "one", 0), (2, "two", 1)], "k int, word string, ord int")
    t = spark.createDataFrame([(1, "wordex", 0), (1, "zzzzzzzzz", 1), (2, "twx", 0)], "k int, word string, ord int")
    out = {(r["k"], r["word"]): r["near"] for r in align.near_words(s, t, "k").collect()}
    assert out == {(1, "word"): "wordex", (1, "worded"): "zzzzzzzzz", (2, "one"): "twx"}
    df = spark.createDataFrame([([], ["a"]), (["a"], [])], "s array<string>, o array<string>")
    assert [r[0] for r in df.select(nearest_in_order(F.col("s"), F.col("o"))).collect()] == [[], []]


@pytest.mark.parametrize("tail, kept", [(".).).).).)", ""), ("(b).", "(b)"), ("))!)", ""), ("…)\"", ""), ("((x)).", "((x))")])
def test_ends_come_off_links(spark, tail, kept):
    out = spark.createDataFrame([(f"zie http://x.nl/a{tail} en meer",)], "t string").select(text.links(F.col("t")).alias("l")).first()["l"]
    assert out == [f"http://x.nl/a{kept}"]


def test_moved_quotes_stand_last_first(spark):
    long = "de zin die ook als quote in het blad staat"
    rows = [(0, "quote", long), (1, "streamer", "als quote in het"), (2, "paragraph", "Iets anders."), (3, "paragraph", f"Hier: {long}!"), (4, "quote", "ook als quote"), (5, "quote", "te kort")]
    blocks = spark.createDataFrame([(1, *r) for r in rows], "owner int, ord int, kind string, text string")
    sources = rules.quote_sources(blocks, "owner")
    assert {(r["ord"], r["source"]) for r in sources.collect()} == {(0, 3), (1, 3), (4, 3)}
    out = rules.after_source(blocks, sources, "owner").orderBy("ord").collect()
    assert [r["text"] for r in out] == ["Iets anders.", f"Hier: {long}!", "als quote in het", long, "ook als quote", "te kort"]
