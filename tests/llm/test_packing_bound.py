import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quire.llm import packing


def mixed(n):
    """A third of the items can't be joined with anything else; every share also gets something small."""
    rng = random.Random(7)
    sizes = {f"a{i}": 1500 for i in range(n // 3)} | {f"b{i}": rng.randint(600, 2048) for i in range(n - n // 3)} | {f"c{i}": 100 for i in range(5)}
    return sizes


def packed(spark, sizes, each, **more):
    out = packing.pack(spark.createDataFrame(list(sizes.items()), "item string, size long"), 2048, each, **more).collect()
    used = defaultdict(int)
    for r in out:
        used[r["sequence"]] += sizes[r["item"]]
    assert len(out) == len(sizes) == len({r["item"] for r in out}) and max(used.values()) <= 2048
    return used


@pytest.mark.parametrize("fan_in", [2, 8])
def test_merges_stay_within_their_bound_from_100_to_400_shares(spark, monkeypatch, fan_in):
    most = defaultdict(int)
    real = packing._merge

    def watched(bins, number, capacity, spare, fan):
        out = real(bins, number, capacity, spare, fan)
        rows = out.groupBy("share").count().agg(F.max("count")).first()[0]
        most[len(sizes)] = max(most[len(sizes)], rows or 0)
        return out

    monkeypatch.setattr(packing, "_merge", watched)
    for n in (10_000, 40_000):
        sizes = mixed(n)
        used = packed(spark, sizes, 100, fan_in=fan_in)
        assert sum(2 * u <= 2048 for u in used.values()) <= 1
    few, many = (most[k] for k in sorted(most))
    # more shares find more of the 1,024 fills taken, up to fan_in bins of each
    assert 0 < few <= many <= fan_in * 1024


def test_tree_packs_about_as_well_as_one_task(spark):
    sizes = mixed(6_000)
    one, tree = packed(spark, sizes, 10_000), packed(spark, sizes, 200)
    assert len(tree) <= 1.02 * len(one)


def test_a_sampled_difference_turns_the_quick_encoder_off():
    from quire.llm.queries import vocabulary

    coder = packing.Encoder(vocabulary("byte_bpe_50k.json"))
    texts = [f"text number {i}" for i in range(200)] + [None, ""]
    want = coder.encode(texts)
    coder.quick = lambda t: [1, 2, 3]
    assert coder.encode(texts) == want and coder.quick is None
