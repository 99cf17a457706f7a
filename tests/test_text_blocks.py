import random

from quire.operators import layout


def test_cells_give_the_pairs_of_all_pairs(spark):
    rng = random.Random(6)
    rows = [(p, i, rng.uniform(-50, 600), rng.uniform(0, 800), rng.choice([0.0, 5.0, 80.0, 400.0]), rng.choice([6.0, 10.0, 60.0, 0.0]), rng.randint(0, 9)) for p in range(3) for i in range(120)]
    runs = spark.createDataFrame(rows, "page int, run int, x double, y double, w double, h double, chars int")
    use = [r for r in rows if r[4] > 0 and r[5] > 0 and r[6] > 0]
    want = set()
    for p, i, x, y, w, h, _ in use:
        for q, j, u, v, s, t, _ in use:
            line = max(h, t)
            if p == q and i < j and max(y, v) - min(y + h, v + t) <= line * 0.9 and max(x, u) - min(x + w, u + s) <= line * 0.8:
                want.add((p, i, j))
    for cell in (16.0, 64.0, 1000.0):
        got = [tuple(r) for r in layout.adjacent_runs(runs, "page", "run", cell).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert want and layout.adjacent_runs(runs.limit(0), "page", "run").count() == 0


def test_a_long_column_is_one_block(spark):
    runs = spark.createDataFrame([(1, i, 0.0, 12.0 * i, 100.0, 10.0, 5) for i in range(40)], "page int, run int, x double, y double, w double, h double, chars int")
    assert [(r["block"], r["runs"], r["chars"]) for r in layout.text_blocks(runs, "page", "run").collect()] == [(0, 40, 200)]
