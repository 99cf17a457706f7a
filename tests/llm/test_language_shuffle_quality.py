import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quire.llm import external_shuffle, language_id, quality_cascade
from quire.llm.queries import QUERIES


def test_language_held_out_accuracy(spark, sf):
    rows = QUERIES["op1_language_id"](spark, sf).collect()
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    held = [r for r in rows if r["held_out"]]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)


def test_language_odd_rows(make, odd_rows, spark):
    model = {"en": b"the of and to in is that it was for on with as are this be", "fr": b"le la les des est dans une pour que qui sur pas avec"}
    found = {r["doc_id"]: r for r in language_id.predict(make(odd_rows).withColumn("score", F.lit("clash")), model).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] in model
    assert language_id.predict(make([(1, "this is the")]), model).first()["lang_pred"] == "en"
    assert language_id.predict(make([(1, "text")]), {}).first()["lang_pred"] == "und"
    assert language_id.fit(make([]).limit(0)) == {} and language_id.predict(make([]).limit(0), model).count() == 0
    assert language_id.classify("12 34 !!", language_id._compressors(model))[0] == "und"


def test_language_sample_is_bounded(make):
    rows = [(7, f"text number {i} " * 50) for i in range(400)]
    model = language_id.fit(make(rows), texts_each=10, chars=30)
    assert 0 < len(model["en"]) <= 10 * 31


def test_shards_law(make, odd_rows, spark):
    rng = random.Random(1)
    rows = odd_rows + [(100 + i, "copy" if i % 3 else str(rng.random())) for i in range(300)]
    out = external_shuffle.shards(make(rows).withColumn("bucket", F.lit(1)), 24, bucket_bytes=2000).collect()
    assert Counter((r["doc_id"], r["text"]) for r in out) == Counter(rows)
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(24)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in sizes:
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(sizes[s]))
    assert len({r["bucket"] for r in out}) > 10


def test_shards_are_mixed(make):
    out = external_shuffle.shards(make([(i, "x" * 20) for i in range(2000)]), 4, bucket_bytes=20_000).collect()
    order = [r["doc_id"] for r in sorted(out, key=lambda r: (r["shard"], r["slot"]))]
    # ranks of neighbours in a random order are far apart on average
    assert 500 < sum(abs(a - b) for a, b in zip(order, order[1:])) / 1999 < 850
    again = external_shuffle.shards(make([(i, "x" * 20) for i in range(2000)]), 4, seed=18, bucket_bytes=20_000).collect()
    assert order != [r["doc_id"] for r in sorted(again, key=lambda r: (r["shard"], r["slot"]))]


def test_shards_few_rows(make):
    assert external_shuffle.shards(make([]).limit(0), 24).count() == 0
    few = external_shuffle.shards(make([(1, None), (1, None)]), 24).collect()
    assert len(few) == 2 and len({r["shard"] for r in few}) == 2


def test_shards_written(make, tmp_path, spark):
    external_shuffle.write_shards(make([(i, str(i)) for i in range(50)]), str(tmp_path / "out"), n_shards=5)
    assert spark.read.parquet(str(tmp_path / "out")).groupBy("shard").count().collect() and len(list((tmp_path / "out").glob("shard=*"))) == 5


def brute_quality(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    counts = Counter(zip(ws, ws[1:], ws[2:]))
    cover = set()
    for i, x in enumerate(zip(ws, ws[1:], ws[2:])):
        if counts[x] > 1:
            cover |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:i] for i, x in enumerate(lines)), len(cover)


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_quality_statistics_against_brute_force(make, odd_rows, spark, sf):
    rows = odd_rows[:9] + [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(150).collect()]
    want = {i: brute_quality(t) for i, t in rows}
    for r in quality_cascade.cascade(make(rows), statistics=BASE).collect():
        assert tuple(r[c] for c in BASE) == want[r["doc_id"]], r["doc_id"]


def test_quality_order_does_not_change_the_verdict(make, odd_rows):
    docs = make([r for r in odd_rows if r[0] not in (None, 9)])
    names = [r.name for r in quality_cascade.RULES]
    verdicts = []
    for running in (names, names[::-1], None):
        verdicts.append({r["doc_id"]: r["kept"] for r in quality_cascade.cascade(docs, running).collect()})
    assert verdicts[0] == verdicts[1] == verdicts[2] and not verdicts[0][1] and verdicts[0][5]


def test_quality_order_prefers_rejections_for_their_cost(make):
    rules = (
        quality_cascade.Rule("never", lambda t: False, "false"),
        quality_cascade.Rule("slow", lambda t: sum(range(200_000)) > 0, "true"),
        quality_cascade.Rule("quick", lambda t: True, "true"),
    )
    names, found = quality_cascade.order(make([(i, "some words") for i in range(40)]), rules)
    assert names == ["quick", "slow", "never"] and found[0]["rejected"] == 1
    assert quality_cascade.order(make([]).limit(0), rules)[0] == ["never", "slow", "quick"]


def test_quality_query_and_labels(spark, sf):
    rows = QUERIES["op3_quality_cascade"](spark, sf)
    assert rows.where("base_failed and kept").count() == 0
    good = rows.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("quality = 1 and not base_failed")
    assert good.where("kept").count() >= 0.95 * good.count()


@pytest.mark.parametrize("name", ["op1_language_id", "op2_external_shuffle", "op3_quality_cascade"])
def test_columns(spark, sf, name):
    want = {
        "op1_language_id": {"doc_id", "held_out", "lang_pred", "score"},
        "op2_external_shuffle": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op3_quality_cascade": {"doc_id", *BASE, "base_failed", "kept"},
    }[name]
    assert want <= set(QUERIES[name](spark, sf).columns)
