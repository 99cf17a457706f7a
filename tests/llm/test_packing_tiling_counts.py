import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from quire.llm import packing, string_tiling, wordpiece_count
from quire.llm.queries import QUERIES, vocabulary
from tests.llm.conftest import words


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))


def check_packing(rows, out, tokenizer, capacity):
    want = Counter()
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        rest = len(ids) % capacity
        cuts = [0, *range(rest or capacity, len(ids) + 1, capacity)]
        for k, (a, b) in enumerate(pairwise(cuts)):
            want[d, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= capacity
    return len(sequences), sum(r["length"] for r in out)


def test_packing_exact_pieces_and_few_sequences(make, odd_rows, tokenizer, spark, sf):
    rows = odd_rows + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    rows += [(5000, "a <|endoftext|> b"), (5001, "x  y\n\n z\t\t "), (5002, "don't 12 ½ ﷺ 🙂")]
    docs = make(rows).withColumn("row", F.lit(7)).withColumn("piece", F.lit(1))
    out = packing.best_fit_packing(docs, vocabulary("byte_bpe_50k.json"), 256).collect()
    made, total = check_packing(rows, out, tokenizer, 256)
    assert made <= -(-total // 256) * 1.01 + 1


def test_packing_in_many_rounds(make, tokenizer):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(1, 60))) for i in range(900)]
    out = packing.best_fit_packing(make(rows), vocabulary("byte_bpe_50k.json"), 128, items_each=20).collect()
    made, total = check_packing(rows, out, tokenizer, 128)
    assert made <= -(-total // 128) * 1.15


def test_packing_empty(make):
    assert packing.best_fit_packing(make([]).limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_best_fit_takes_the_fullest_bin():
    assert packing.best_fit([6, 5, 4, 3, 2], 10) == [0, 1, 0, 1, 1]
    assert packing.best_fit([], 10) == [] and packing.best_fit([10, 10], 10) == [0, 1]


def test_packing_query(spark, sf, tokenizer):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    made, total = check_packing(rows, QUERIES["op10_best_fit_packing"](spark, sf).collect(), tokenizer, 2048)
    assert made <= -(-total // 2048) + 2


def brute_pieces(word, initial, continuing):
    n, at = 0, 0
    while at < len(word):
        pool = initial if at == 0 else continuing
        size = next((k for k in range(len(word) - at, 0, -1) if word[at : at + k] in pool), 0)
        if not size:
            return 0
        n, at = n + 1, at + size
    return n


@pytest.mark.parametrize("seed", range(5))
def test_automaton_against_longest_match(seed):
    rng = random.Random(seed)
    some = lambda k: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(k)}
    initial, continuing = some(12), some(12)
    counter = wordpiece_count.Automaton(initial, continuing)
    for _ in range(3000):
        word = "".join(rng.choice("abcd" if rng.random() < 0.05 else "abc") for _ in range(rng.randint(1, 14)))
        assert counter.count(word) == brute_pieces(word, initial, continuing), word


def test_token_counts_against_longest_match(make, odd_rows, spark, sf):
    path = vocabulary("piece_bpe_32k.model")
    initial, continuing = map(set, wordpiece_count.pieces_of(path))
    rows = odd_rows[:9] + [(1000 + r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = {}
    for d, t in rows:
        counts = [brute_pieces(w, initial, continuing) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        want[d] = (len(counts), counts.count(0), sum(counts) + counts.count(0))
    for r in wordpiece_count.token_counts(make(rows).withColumn("n_words", F.lit(1)), path).collect():
        assert (r["n_words"], r["n_unknown"], r["n_tokens"]) == want[r["doc_id"]]
    assert wordpiece_count.token_counts(make([]).limit(0), path).count() == 0


def test_token_counts_are_those_of_a_word_piece_model(make, tmp_path):
    from tokenizers import models

    path = vocabulary("piece_bpe_32k.model")
    initial, continuing = wordpiece_count.pieces_of(path)
    vocab = {p: i for i, p in enumerate(["[UNK]", *dict.fromkeys(initial), *dict.fromkeys("##" + p for p in continuing)])}
    model = models.WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=1000)
    counter = wordpiece_count.automaton(path)
    for word in ["unbelievable", "ouiereau", "schtzbever,", "worthless.", "naïveté", "漢字", "x" * 300, "a%%%"]:
        assert (counter.count(word) or 1) == len(model.tokenize(word)), word


def brute_tiles(item, text, least):
    """Plain greedy tiling on whole texts: the longest match first, ties by place."""
    free_a, free_b, total = [True] * len(item), [True] * len(text), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_a[p + n] and free_b[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return total
        free_a[p : p + n], free_b[t : t + n] = [False] * n, [False] * n
        total += n


def test_tiling_against_plain_greedy_tiling():
    rng = random.Random(7)
    for _ in range(150):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 30))]
        text = [rng.choice("abcdefghxyz") for _ in range(20)]
        for _ in range(rng.randint(1, 3)):
            a = rng.randrange(len(item) - 3)
            text += item[a : a + rng.randint(3, 15)] + [rng.choice("xyz")]
        index = string_tiling.Index([(1, " ".join(item))], 3)
        found = index.candidates([w.encode() for w in text]).get(0, [])
        assert string_tiling.covered(index.items[0][1], found, 3) == brute_tiles(item, text, 3)


def fixture_items():
    rng = random.Random(11)
    items = [(i, words(rng, 40, 6)) for i in range(6)] + [(90, "tiny item"), (91, None), (92, " "), (0, words(rng, 30, 6))]
    first = items[0][1].split()
    rows = [
        (1, f"{words(rng, 50)} {items[1][1].upper()} {words(rng, 20)}"),
        (2, f"{words(rng, 5)} {' '.join(first[25:])} {words(rng, 9)} {' '.join(first[:25])}"),  # in another order
        (3, f"{words(rng, 30)} {' '.join(first[:9])} {words(rng, 30)}"),  # too little
        (4, f"{words(rng, 12)} a Tiny ITEM here"), (5, None), (6, ""), (7, words(rng, 9000)), (None, items[2][1]), (8, items[3][1]), (8, items[4][1]),
    ]
    return items, rows


def test_decontamination_pairs(make, spark):
    items, rows = fixture_items()
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = make(rows).withColumn("item_id", F.lit(5))
    want = {(1, 1), (2, 0), (4, 90), (None, 2), (8, 3), (8, 4)}
    assert {(r["doc_id"], r["item_id"]) for r in string_tiling.matches(docs, bench).collect()} == want
    blocks = string_tiling.matches(docs, bench, block_bytes=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in blocks} == want
    kept = string_tiling.clean(docs, bench)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 5, 6, 7] and kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in string_tiling.clean(docs, bench, block_bytes=200).collect()) == [3, 5, 6, 7]


def test_decontamination_empty(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert string_tiling.matches(make([(1, "x")]), none).count() == 0 and string_tiling.clean(make([(1, "x")]), none).count() == 1
    some = spark.createDataFrame([(1, "x y z")], "item_id long, text string")
    assert string_tiling.matches(make([]).limit(0), some).count() == 0


def test_decontamination_query_finds_whole_items(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    want = {(d["doc_id"], b["item_id"]) for d in docs for b in bench if b["text"] in d["text"]}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op6_string_tiling"](spark, sf).collect()}
    assert want and want <= got
