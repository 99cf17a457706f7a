"""Repeated passages of whole texts against a reader that goes through them word by word."""

import re

from pyspark.sql import functions as F

from quire.operators import align, rules
from quire.plans import text_queries
from quire.sources.tables import table


def read(text, n=8):
    spans = [m.span() for m in re.finditer(r"[^\W_]+", text or "")]
    words = [text[a:b].lower() for a, b in spans]
    first, told, out, i = {}, set(), [], 0
    gram = lambda k: tuple(words[k : k + n])
    while i + n <= len(words):
        before = first.setdefault(gram(i), i)
        if i - before >= n and gram(i) not in told:
            length = n
            while i + length < len(words) and before + length < i and words[before + length] == words[i + length]:
                length += 1
            told |= {gram(k) for k in range(i, i + length - n + 1)}
            out.append((i, before, length, text[spans[i][0] : spans[i + length - 1][1]]))
            i += length
        else:
            i += 1
    return out


def found(df, key="doc_id"):
    out = {}
    for r in df.collect():
        out.setdefault(r[key], []).append((r["start"], r["first"], r["length"], r["passage"]))
    return {k: sorted(v) for k, v in out.items()}


def test_documents(spark, sf):
    got = found(text_queries.duplicate_passage_findings(spark, sf))
    docs = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    want = {k: w for k, t in docs.items() if (w := read(t))}
    assert got == want and len(want) > 10
    norm = lambda t: [w.lower() for w in re.findall(r"[^\W_]+", t)]
    assert all(norm(p) == norm(docs[k])[s : s + n] for k, v in got.items() for s, _, n, p in v)


def test_small_texts(spark):
    a = "Een, twee drie vier vijf zes zeven acht negen tien."
    texts = [f"{a} {a} {a}", f"{a} los {a.upper()} en {a[:40]}", "x " * 40, f"{a} {a[5:]} {a} {a[10:]}", None, "", a, "a b c d e f g h " * 3 + "z " + "e f g h a b c d z a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    assert found(align.repeated_passages(df, "doc_id", F.col("text"))) == {k: w for k, t in enumerate(texts) if (w := read(t))}
    assert align.repeated_passages(df.limit(0), "doc_id", F.col("text")).count() == 0


def test_reasons_of_failed_pages(spark):
    rows = [("Tijd op na 480 s", 0, [], "duurde te lang"), (None, 0, ["let op", "antwoord afgekapt"], "stopte halverwege"), (None, 3, ["afgekapt"], None), ("x is not defined", 0, [], "Er ging iets mis"), ("Fetch failed", 0, [], "verbinding"), ("raar", 0, [], "(raar).")]
    df = spark.createDataFrame([r[:3] for r in rows], "failed string, blocks int, warnings array<string>")
    got = [r[0] for r in df.select(rules.plain_reason(rules.failure(F.col("failed"), F.col("blocks"), F.col("warnings")))).collect()]
    assert all((g is None) if w is None else w in g for g, (*_, w) in zip(got, rows))
