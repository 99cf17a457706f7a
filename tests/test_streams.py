"""Streams give the same end state, whatever micro-batches their input falls into."""

import json
import random
import uuid

import pytest
from pyspark.sql import functions as F

from quire.streaming import live

SPLITS = ["whole", "forward", "backward", "shuffled"]


def batches(spark, rows, schema, split, order):
    """A stream of the rows as one file, or one file to a row in some order."""
    at = live.folder(spark, "input")
    rows = sorted(rows, key=order, reverse=split == "backward")
    if split == "shuffled":
        random.Random(3).shuffle(rows)
    step = len(rows) if split == "whole" else max(1, len(rows) // 6)
    for n, k in enumerate(range(0, len(rows), step)):
        spark.createDataFrame(rows[k : k + step], schema).coalesce(1).write.mode("append").parquet(f"{at}/in{n:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{at}/in*")


@pytest.mark.parametrize("split", SPLITS)
def test_text_folds_in_order(spark, split):
    rows = [(k, n, ("\f" if n == 4 else "") + f"{k}.{n} " + ("\fx" if (k, n) == (2, 7) else "")) for k in (1, 2, 3) for n in range(9)] + [(4, 0, None)]
    stream = batches(spark, rows, "k int, n long, t string", split, lambda r: (r[1], r[0]))
    out = {r["k"]: (r["text"], r["updates"]) for r in live.run_updates(spark, live.fold_text(stream, "k", "n", "t"), uuid.uuid4().hex, "k", "updates").collect()}
    batch = live.fold_text_batch(spark.createDataFrame(rows, "k int, n long, t string"), "k", "n", "t")
    assert out == {r["k"]: (r["text"], r["updates"]) for r in batch.collect()}


def head(k):
    return json.dumps({"title": f"Kop {k} \"q\"", "n": 10 + k, "tags": ["a", k], "more": {"x": None}, "intro": "é\\u00e9"}, ensure_ascii=False)


@pytest.mark.parametrize("split", SPLITS)
def test_fields_come_once_each_when_they_end(spark, split):
    rows = [(k, n, head(k)[3 * n : 3 * n + 3]) for k in (1, 2) for n in range(len(head(k)) // 3 + 1)]
    stream = batches(spark, rows, "k int, n long, t string", split, lambda r: (r[1], r[0]))
    out = live.run_available(spark, live.fields_as_they_end(stream, "k", "n", "t"), uuid.uuid4().hex, "append").collect()
    for k in (1, 2):
        got = sorted((r["seq"], r["field"], r["value"]) for r in out if r["k"] == k)
        want, shown = [], {}
        for n in range(len(head(k)) // 3 + 1):
            for f, v in live.complete_fields(head(k)[: 3 * n + 3]).items():
                if shown.get(f) != v:
                    shown[f] = v
                    want.append((n, f, v))
        assert got == sorted(want) and {f: json.loads(v) for _, f, v in got} == json.loads(head(k))


def test_only_ended_values_are_complete():
    assert live.complete_fields('{"a": 12') == {}
    assert live.complete_fields('{"a": 12,') == {"a": "12"}
    assert live.complete_fields('{"a": "x", "b": "unf') == {"a": '"x"'}
    assert live.complete_fields('{"a": [1, 2') == {} and live.complete_fields("") == {} and live.complete_fields("no json") == {}


@pytest.mark.parametrize("split", SPLITS)
def test_late_and_early_patches_reach_their_pages(spark, split):
    rng = random.Random(5)
    words = ["alfa", "bravo", "charlie", "delta"]
    rows = [(d, p, 10 * p + v, f"{rng.choice(words)} {rng.choice(words)} v{v}", None) for d in (1, 2, 3) for p in range(4) for v in range(2)]
    rows += [(d, p, 100 + n, None, rng.choice(words)) for d in (1, 2, 3) for p in range(5) for n in range(3)] + [(4, 0, 1, None, "alfa")]
    schema = "doc int, page long, seq long, text string, find string"
    stream = batches(spark, rows, schema, split, lambda r: (r[2], r[0]))
    out = live.run_updates(spark, live.live_pages(stream, "doc"), uuid.uuid4().hex, ["doc", "page"], "version")
    pages = lambda df: sorted((r["doc"], r["page"], r["text"], tuple(r["marks"])) for r in df.collect())
    want = pages(live.live_pages_batch(spark.createDataFrame(rows, schema), "doc"))
    assert pages(out) == want and len(want) == 12 and any(m for *_, m in want)
    assert live.live_pages_batch(spark.createDataFrame([], schema), "doc").where(F.lit(True)).count() == 0
