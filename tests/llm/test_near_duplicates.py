import random
import re
import zlib
from collections import defaultdict
from pathlib import Path

import pytest
import xxhash
from pyspark.sql import functions as F

from quire.llm import common, compact_windows, components, line_dedup, simhash
from quire.llm.queries import QUERIES

from tests.llm.conftest import words


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


@pytest.mark.parametrize("seed", range(3))
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 240)] + [(500, i) for i in range(501, 560)]
    sets = Sets()
    for a, b in pairs:
        sets.join(a, b)
    got = {r["id"]: r["component"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: sets.find(x) for p in pairs if p[0] != p[1] for x in p}


def test_components_keep_one_table(spark):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("edges-*"))
    found = components.components(spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert found.count() == 301 and found.where("id <> component and component <> 0").count() == 0
    assert len(set(folder.glob("edges-*")) - before) == 1


def test_components_empty(spark):
    assert components.components(spark.createDataFrame([(None, 3), (4, 4)], "a long, b long")).count() == 0


def brute_print(text, n=4):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))]
    hs = [xxhash.xxh64_intdigest(g.encode("utf-8"), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_simhash(rows, distance=4):
    prints = [brute_print(t) for _, t in rows]
    sets = Sets()
    for i in range(len(rows)):
        sets.find(i)
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                sets.join(i, j)
    low = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        low[sets.find(i)].append(d)
    return sorted((d, f"{prints[i]:016x}", min(x for x in low[sets.find(i)] if x is not None)) for i, (d, _) in enumerate(rows) if d is not None)


def near_copies(rng, n):
    base = words(rng, 300).split()
    for _ in range(n):
        own = list(base)
        own[rng.randrange(300)] = words(rng, 1)
        yield " ".join(own)


def test_simhash_against_brute_force(make, odd_rows, spark, sf):
    rng = random.Random(2)
    rows = [r for r in odd_rows if r[0] is not None]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(rng, 60))]
    rows += [(5000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = make(rows).withColumn("fp", F.lit("clash"))
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("f"), "component_id")
    got = sorted(tuple(r) for r in out.collect())
    assert got == brute_simhash(rows)
    assert len({c for d, _, c in got if 1000 <= d < 1060}) < 20


@pytest.mark.parametrize("distance", [0, 1, 2, 4, 6])
def test_links_connect_all_at_any_distance(spark, distance):
    rng = random.Random(distance)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(12):
            values.add(b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 8))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    got = {(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()}
    mask = (1 << 64) - 1
    near = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= distance]
    whole, linked = Sets(), Sets()
    for sets, pairs in ((whole, near), (linked, got)):
        for a, b in pairs:
            sets.join(a, b)
    assert got <= set(near) and {v: whole.find(v) for v in signed} == {v: linked.find(v) for v in signed}


def test_a_crowd_of_near_fingerprints_makes_few_links(spark):
    base = 0x0123456789ABCDEF
    values = {base} | {base ^ (1 << i) for i in range(64)} | {base ^ (1 << i) ^ (1 << j) for i in range(8) for j in range(i + 1, 30)}
    links = simhash.links(spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long"))
    found = components.components(links)
    assert len(values) > 232 and links.count() < 2000
    assert found.count() == len(values) and found.select("component").distinct().count() == 1


def test_thresholds_obey_the_general_pigeonhole_principle(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    bits = rng.random((500, 64)) < np.linspace(0.05, 0.95, 64)
    counts = bits.T.astype(float) @ bits
    for parts in range(1, 7):
        groups = simhash.group_bits(500, counts, parts)
        assert sorted(b for g in groups for b in g) == list(range(64))
        _, chosen = simhash.allocate(10**6, np.diag(counts) / 500, groups, 4)
        assert sum(t + 1 for t in chosen) == 5


def test_simhash_keeps_one_of_each_group(make):
    text = "one two three four five six seven eight"
    out = simhash.keep_first(make([(3, text), (2, text), (5, "other words entirely here now again"), (7, None), (8, "")]))
    assert sorted(r["doc_id"] for r in out.collect()) == [2, 5, 7] and out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert simhash.near_duplicates(make([]).limit(0)).count() == 0


def shingle_set(line, n=5):
    return {line[i : i + n] for i in range(len(line) - n + 1)} or {line}


def brute_lines(rows, similarity=0.8):
    nodes = sorted({x for _, t in rows if t for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)})
    sets, grams = Sets(), [shingle_set(x) for x in nodes]
    for i in range(len(nodes)):
        sets.find(nodes[i])
        for j in range(i):
            shared = len(grams[i] & grams[j])
            if shared >= similarity * (len(grams[i]) + len(grams[j]) - shared):
                sets.join(nodes[i], nodes[j])
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        kept = []
        for x in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", x):
                c = sets.find(x)
                if c in seen:
                    continue
                seen.add(c)
            kept.append(x)
        out[d] = "\n".join(kept)
    return out


def line_rows():
    rng = random.Random(8)
    lines = [words(rng, rng.randint(8, 40)) for _ in range(60)]
    rows = []
    for d in range(40):
        own = []
        for _ in range(6):
            x = rng.choice(lines).split()
            if rng.random() < 0.3 and len(x) > 20:
                x[rng.randrange(len(x))] = words(rng, 1)
            own.append(" ".join(x))
        rows.append((d, "\n".join([*own, "", "Licensed under X."])))
    return rows


def test_line_dedup_against_brute_force(make):
    rows = line_rows() + [(90, None), (91, ""), (92, " \n\t"), (93, "ab"), (94, "ab"), (95, "Ünï\nÜnï")]
    docs = make(rows).withColumn("lines", F.lit("clash")).withColumn("h", F.lit(1))
    out = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(docs).collect()}
    want = brute_lines(rows)
    assert out.keys() == dict(rows).keys() and out[90] is None
    assert {k: v for k, v in out.items() if v is not None} == want


def test_line_dedup_shuffled_candidates_agree(make, monkeypatch):
    rows = line_rows()
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", 0)
    assert {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(make(rows)).collect()} == brute_lines(rows)


def test_line_dedup_empty_null_id_and_long(make, odd_rows):
    docs = make([])
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
    out = line_dedup.dedup_lines(make(odd_rows)).collect()
    assert len(out) == len(odd_rows) and [r["text"] for r in out if r["doc_id"] is None] == ["null id text"]
    assert [r["text"] for r in out if r["doc_id"] == 7] == [dict(odd_rows)[7]]


def test_line_dedup_repeated_id_loses_no_line_of_its_own(make):
    rows = [(1, "common line here\nthe first row"), (2, "common line here\nfirst row of id two"), (2, "another unique opening\nsecond row of id two")]
    out = sorted(r["text"] for r in line_dedup.dedup_lines(make(rows)).collect())
    assert out == ["another unique opening\nsecond row of id two", "common line here\nthe first row", "first row of id two"]


def test_line_dedup_query_counts(spark, sf):
    rows = QUERIES["op4_line_dedup"](spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_lines(sorted(texts.items()))
    wrong = [r["doc_id"] for r in rows if r["kept_crc32"] != zlib.crc32(want[r["doc_id"]].encode())]
    assert len(rows) == len(texts) and len(wrong) <= 0.02 * len(rows)


def passage_fixture():
    rng = random.Random(4)
    shared, near = words(rng, 70), words(rng, 80).split()
    changed = list(near)
    changed[40] = "changed"
    rows = [(1, f"{words(rng, 90)} {shared} {words(rng, 40)}"), (2, f"{words(rng, 10)} {shared} {words(rng, 200)}"), (3, words(rng, 300))]
    rows += [(4, f"{words(rng, 50)} {' '.join(near)} {words(rng, 30)}"), (5, f"{words(rng, 33)} {' '.join(changed)}")]
    rows += [(6, words(rng, 60)), (8, words(rng, 30))]
    rows += [(7, dict(rows)[6]), (9, dict(rows)[8])]
    return rows


def test_passages_are_found(make):
    rows = passage_fixture() + [(20, None), (21, ""), (22, "few words")]
    out = compact_windows.passages(make(rows).withColumn("th", F.lit("clash"))).collect()
    spans = {(r["doc_id"], r["other_doc_id"]): (r["start_word"], r["end_word"]) for r in out}
    assert set(spans) == {(1, 2), (2, 1), (4, 5), (5, 4), (7, 6)}
    assert spans[1, 2] == (90, 160) and spans[2, 1] == (10, 80) and spans[7, 6] == (0, 60)
    assert spans[4, 5] == (50, 130) and spans[5, 4] == (33, 113)


def test_passages_leave_no_table_that_the_result_does_not_read(make, spark):
    folder = Path(common.shared_dir(spark).removeprefix("file:"))
    before = set(folder.glob("passage*"))
    rows = passage_fixture()
    out = compact_windows.passages(make(rows))
    left = {p.name.rpartition("-")[0] for p in set(folder.glob("passage*")) - before}
    assert left == {"passages", "passage-homes", "passage-classes"} and out.count()


def test_passages_of_many_documents(make):
    rng = random.Random(6)
    shared = words(rng, 64)
    rows = [(i, f"{words(rng, rng.randint(1, 80))} {shared} {words(rng, rng.randint(1, 60))}") for i in range(60)]
    out = compact_windows.passages(make(rows))
    assert {r["doc_id"] for r in out.collect()} == set(range(60)) and out.count() < 600


def test_passages_empty_and_repeated_ids(make):
    assert compact_windows.passages(make([]).limit(0)).count() == 0
    rng = random.Random(9)
    text = words(rng, 80)
    out = compact_windows.passages(make([(1, text), (2, text), (2, text), (3, words(rng, 5000))])).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in out} == {(2, 1)}


def test_compact_windows_partition_all_subsequences():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 40, 60).astype(np.uint64)
    found = compact_windows.compact_windows(h, 5)
    for i in range(60):
        for j in range(i + 4, 60):
            hold = [(left, c, right) for left, c, right in found if left <= i <= c <= j <= right]
            assert len(hold) == 1 and h[hold[0][1]] == h[i : j + 1].min()


def test_passage_beside_looser_text_is_cut_out():
    rng = random.Random(8)
    ws = [f"w{i}" for i in range(200)]
    own = list(ws)
    own[30] = "other"
    for k in range(66, 200, 12):
        own[k] = f"x{k}"
    a, b = (compact_windows.shingles([w.encode() for w in x]) for x in (["l1", "l2", *ws], ["r1", *own, "r2", "r3"]))
    found = compact_windows.pair_passages(a, b, [(40, 39)], 46, 0.8)
    assert len(found) == 1 and found[0][4] >= 0.8 and found[0][1] - found[0][0] >= 55


@pytest.mark.parametrize("size", [20, 45])
def test_partners_are_found_behind_a_phrase_all_share(make, size):
    rng = random.Random(size)
    phrase, rows = words(rng, size), []
    for i in range(40):
        passage = f"{words(rng, (60 - size) // 2)} {phrase} {words(rng, 60 - size - (60 - size) // 2)}"
        rows += [(2 * i + k, f"{words(rng, 30)} {passage} {words(rng, 30)}") for k in range(2)]
    got = {(r["doc_id"], r["other_doc_id"]) for r in compact_windows.passages(make(rows)).collect()}
    missed = [i for i in range(40) if (2 * i, 2 * i + 1) not in got]
    assert len(missed) <= 2


def test_no_passage_is_lost_between_others_under_its_minima(make, monkeypatch):
    """Texts that share a phrase and, some of them, a passage around it: all pairs, then classes where the phrase is a crowd."""
    rng = random.Random(12)
    rows, groups = [], {}
    phrase = words(rng, 24)
    for i in range(12):
        left, right = words(rng, 20).split(), words(rng, 20).split()
        for k in range(3):
            own = list(left) if k < 2 else [*left[:10], "x", *left[11:]]
            groups[3 * i + k] = 3 * i
            rows.append((3 * i + k, f"{words(rng, 20)} {' '.join(own)} {phrase} {' '.join(right)} {words(rng, 20)}"))
    out = compact_windows.passages(make(rows)).collect()
    assert {(r["doc_id"], r["other_doc_id"]) for r in out} == {(a, b) for a in groups for b in groups if a != b and groups[a] == groups[b]}
    monkeypatch.setattr(compact_windows, "CROWD", 3)
    out = compact_windows.passages(make(rows)).collect()
    assert {r["doc_id"]: r["class_id"] for r in out} == groups


def test_a_text_goes_once_to_the_pairs_of_a_phrase(make, monkeypatch):
    """40 texts with one phrase and no passage: 780 pairs are compared, of few pieces of text."""
    rng = random.Random(14)
    phrase, rows = words(rng, 40), []
    for i in range(40):
        rows.append((i, f"{words(rng, 60)} {phrase} {words(rng, 60)}"))
    rows += [(100, f"{words(rng, 9)} {rows[0][1]}")]
    compared, sent = [], []
    frame, write = type(make([])), compact_windows.written

    def arrow(self, func, schema, *more, f=frame.mapInArrow):
        out = f(self, func, schema, *more)
        if func.__name__ == "cut":
            sent.append(out.count())
        return out

    def counted(df, name, by=()):
        out = write(df, name, by)
        if name == "passage-pairs":
            compared.append(out.count())
        return out

    monkeypatch.setattr(frame, "mapInArrow", arrow)
    monkeypatch.setattr(compact_windows, "written", counted)
    got = {(r["doc_id"], r["other_doc_id"]) for r in compact_windows.passages(make(rows)).collect()}
    assert got == {(0, 100), (100, 0)} and sum(compared) >= 500 and sum(sent) <= 8 * len(rows)
