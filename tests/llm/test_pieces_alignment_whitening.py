import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quire.llm import contour, piece_bpe, queries, token_alignment, whitening
from quire.llm.queries import vocabulary
from quire.llm.token_units import ByteVocabulary, units

BYTES, PIECES = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return piece_bpe.PieceModel(PIECES)


def odd_texts(n, seed=3):
    rng = random.Random(seed)
    letters = [*"ab \n\té漢▁\r;.'█\x00\x02e's", "<|endoftext|>", "<s>", "<0x0A>", " ", " ", "🙂", "é", "  ", "\n\n"]
    for k in range(n):
        kind = k % 5
        if kind == 0:
            yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 50)))
        elif kind == 1:
            yield "".join(rng.choice("aehilnrst ") for _ in range(rng.randint(0, 90)))
        elif kind == 2:
            yield " " * rng.randint(0, 70) + "x" * rng.randint(0, 30) + " " * rng.randint(0, 40)
        elif kind == 3:
            spans = [(32, 0x2FF), (0x400, 0x4FF), (0x4E00, 0x9FFF), (0x1F300, 0x1F6FF)]
            yield "".join(chr(rng.randint(*rng.choice(spans))) for _ in range(rng.randint(0, 40)))
        else:
            yield " ".join(rng.choice(["It's", "12.5%", "don't", "Übung", "naïve…", "(a,b);", "x\n", "\ty", "##", "a  b"]) for _ in range(rng.randint(0, 15)))


def test_encoding_and_decoding_are_the_librarys(model, library):
    for text in odd_texts(3000):
        ids = model.encode(text)
        assert ids == library.encode(text)
        assert model.decode(ids) == library.decode(ids)


def test_any_ids_decode_as_in_the_library(model, library):
    rng = random.Random(9)
    for _ in range(3000):
        ids = [rng.choice([rng.randint(0, 300), rng.randint(0, 31999)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_a_long_text_without_spaces_is_linear(model, library):
    rng = random.Random(2)
    for text in ("".join(rng.choice("aehilnrst") for _ in range(60_000)), "a" * 60_000):
        assert model.encode(text) == library.encode(text)


def test_backtracking_happens(model):
    """Texts whose longest first piece is not the right one: the encoder must step back or try shorter ones."""
    greedy = 0
    for text in ("ations", "unbelievableness", "therestings", "onsthersing", "inthereforeach"):
        tokens = [model.pieces[i] for i in model.tokens(text)]
        assert tokens == model.merged(text)
        longest = max((p for p in model.id if text.startswith(p)), key=len)
        greedy += tokens[0] != longest
    assert greedy


def test_op11_rows(spark, make, odd_rows, library):
    docs = make(odd_rows).withColumnRenamed("lang", "ids")
    enc = piece_bpe.encode(docs, PIECES)
    got = sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in piece_bpe.decode(enc, PIECES).collect())
    assert got == sorted((str(i), library.encode(t or ""), library.decode(library.encode(t or ""))) for i, t in odd_rows)
    assert got == sorted((str(r["doc_id"]), r["ids"], r["text"]) for r in piece_bpe.round_trip(docs, PIECES).collect())
    assert piece_bpe.decode(piece_bpe.encode(make([]), PIECES), PIECES).count() == 0 == piece_bpe.round_trip(make([]), PIECES).count()


def test_op11_query(spark, sf, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op11_piece_round_trip(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = library.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_units_are_encoded_each_for_itself():
    for as_text in (True, False):
        vocab = ByteVocabulary(BYTES, as_text)
        for text in odd_texts(1500, 5):
            assert "".join(units(text)) == text
            assert [i for ids in vocab.encode(units(text)) for i in ids] == (vocab.encode([text])[0] if text else [])


def test_aligned_groups_are_those_of_common_ends():
    rng = random.Random(4)
    for _ in range(2000):
        n = rng.randint(1, 60)
        dense = rng.random()
        a = [x for x in range(1, n) if rng.random() < dense] + [n]
        b = [x for x in range(1, n) if rng.random() < (dense if rng.random() < 0.5 else 0.9)] + [n]
        if rng.random() < 0.3:
            b = [x for x in a[:-1] if rng.random() < 0.95] + [n]
        got = []
        for i, p, j, q, single in token_alignment.aligned(a, b):
            got += [(k, k + 1, k + j - i, k + j - i + 1) for k in range(i, p)] if single else [(i, p, j, q)]
        ends = [(a.index(c) + 1, b.index(c) + 1) for c in sorted(set(a) & set(b))]
        starts = [(0, 0), *ends[:-1]]
        assert got == [(s[0], e[0], s[1], e[1]) for s, e in zip(starts, ends)]


def brute_alignment(rows, library):
    """The contract of op12 word for word, by sets of ends."""
    a_model = Tokenizer.from_file(BYTES)
    a_model.encode_special_tokens = True
    entry = ByteVocabulary(BYTES, True).entry_bytes()
    docs, links = [], Counter()
    for key, text in rows:
        made = ([], [], [])
        if text:
            a, b = a_model.encode(" " + text, add_special_tokens=False).ids, library.encode(text)
            left = [entry[i] for i in a]
            right = [bytes([int(library.id_to_piece(i)[3:5], 16)]) if library.is_byte(i) else library.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(left) == (" " + text).encode() == b"".join(right):
                ends_a, ends_b = np.cumsum([len(x) for x in left]).tolist(), np.cumsum([len(x) for x in right]).tolist()
                at_a, at_b = {e: k for k, e in enumerate(ends_a)}, {e: k for k, e in enumerate(ends_b)}
                cuts = [(at_a[e], at_b[e]) for e in sorted(at_a.keys() & at_b.keys())]
                said = []
                for (i, j), (p, q) in zip([(-1, -1), *cuts], cuts):
                    said.append(",".join(map(str, a[i + 1 : p + 1])) + "|" + ",".join(map(str, b[j + 1 : q + 1])))
                made = (a, b, [(a[p], b[q]) for p, q in cuts])
                links.update(made[2])
                docs.append((key, made, hashlib.sha256(";".join(said).encode()).hexdigest()))
                continue
        docs.append((key, made, ""))
    most = Counter()
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    return sorted(
        (str(k), len(a), len(b), len(ls), len(ls), sum(links[x] == most[x[1]] for x in ls), sum(links[x] for x in ls), h) for k, (a, b, ls), h in docs
    )


@pytest.mark.parametrize("block", [1, 500, 8 << 20])
def test_op12_rows(make, odd_rows, library, block):
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(odd_texts(120, 8))] + [(900, "▁ mark"), (901, "<|endoftext|> <s>")]
    docs = make(rows).withColumnRenamed("lang", "block").withColumnRenamed("source", "pairs")
    got = sorted((str(r[0]), *r[1:]) for r in token_alignment.align(docs, BYTES, PIECES, block).collect())
    assert got == brute_alignment(rows, library)


def test_op12_empty_tables(make):
    assert token_alignment.align(make([]), BYTES, PIECES).count() == 0
    rows = token_alignment.align(make([(1, None), (2, ""), (None, None)]), BYTES, PIECES).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == ["1", "2", "None"] and {r["groups_sha256"] for r in rows} == {""}


def test_op12_query(spark, sf, library):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted((str(r[0]), *r[1:]) for r in queries.op12_token_alignment(spark, sf).collect())
    assert got == brute_alignment(docs, library)


@pytest.mark.parametrize(
    "v",
    [
        np.eye(20),
        np.diag([1.0] * 3 + [0] * 17),
        np.diag([1e6] * 4 + [5.0] * 8 + [1e-3] * 20),
        np.diag(10.0 ** -np.arange(30)),
        np.array([[2.0]]),
        np.array([[2.0, 1], [1, 2]]),
    ],
)
def test_leading_pairs_of_hard_matrices(v):
    values, vectors = contour.leading(v, 8)
    want = np.linalg.eigvalsh(v)[::-1][:8]
    want = want[want > 1e-12 * np.trace(v)]
    np.testing.assert_allclose(values, want, rtol=1e-8)
    assert np.abs(v @ vectors - vectors * values).max() < 1e-12 * np.trace(v)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)


def test_leading_pairs_of_random_matrices():
    rng = np.random.default_rng(7)
    for d in (3, 9, 40, 100):
        a = rng.standard_normal((3 * d, d)) * np.exp(-np.arange(d) / 9)
        v = a.T @ a
        values, vectors = contour.leading(v, 8)
        np.testing.assert_allclose(values, np.linalg.eigvalsh(v)[::-1][:8], rtol=1e-10)
        assert np.abs(v @ vectors - vectors * values).max() < 1e-13 * np.trace(v)


def test_inertia_counts():
    rng = np.random.default_rng(8)
    a = rng.standard_normal((30, 30))
    v = a @ a.T
    count, own = contour.Inertia(v), np.linalg.eigvalsh(v)
    for place in rng.uniform(0, own[-1] * 1.1, 200):
        assert count.above(float(place)) == int((own > place).sum())


SCHEMA = "vec_id long, embedding array<double>, whitened string"


def whitened(spark, rows, components=8):
    got = whitening.whiten(spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA), components).collect()
    return got


def brute_whitening(rows, components=8):
    good = [(i, v) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in good], object)
    n, sums = len(x), x.sum(axis=0)
    part = x * n - sums
    centred = part.astype(float) / n
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:components], u[:, ::-1][:, :components]
    return [i for i, _ in good], (part * part).sum(axis=1), centred @ u / np.sqrt(e), e / np.trace(v), n


def test_op13_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(k, (rng.standard_normal(12) * np.arange(1, 13)).tolist()) for k in range(200)]
    rows += [(None, rows[0][1]), (5, rows[5][1]), (300, None), (301, [1.0] * 11 + [None]), (302, [float("nan")] * 12), (303, [float("inf")] * 12)]
    got = whitened(spark, rows)
    ids, deviation, white, explained, n = brute_whitening(rows)
    assert len(got) == 8 * len(ids) and {r["n"] for r in got} == {n}
    keyed = {(r["vec_id"], r["component"]): r for r in got}
    for c in range(8):
        own = np.array([keyed[i, c + 1]["whitened"] for i in ids])
        assert min(np.abs(own - white[:, c]).max(), np.abs(own + white[:, c]).max()) < 1e-9
        assert abs(keyed[ids[0], c + 1]["explained"] / explained[c] - 1) < 1e-10
    assert [keyed[i, 1]["deviation"] for i in ids] == deviation.tolist()
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-10


def test_op13_odd_tables(spark):
    assert whitened(spark, []) == []
    assert whitened(spark, [(1, None), (2, []), (3, [float("nan")])]) == []
    assert whitened(spark, [(1, [1.0, 2.0])]) == []  # one vector varies in nothing
    assert whitened(spark, [(k, [1.0, 2.0]) for k in range(9)]) == []
    two = whitened(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (3, [2.0, 2.0]), (4, [7.0])])
    assert {r["vec_id"] for r in two} == {1, 2, 3} and {r["component"] for r in two} == {1}
    large = whitened(spark, [(k, [2.0**33 * (k % 2), float(k)]) for k in range(50)])
    assert {r["deviation"] for r in large} == {None}  # no long holds it; the components still stand
    assert large[0]["identity_error"] < 1e-6


def test_op13_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    ids, deviation, white, explained, n = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in queries.op13_embedding_whitening(spark, sf).collect()}
    assert len(got) == 8 * n
    assert [got[i, 3]["deviation"] for i in ids] == deviation.tolist()
    assert all(abs(got[ids[0], c + 1]["explained"] / explained[c] - 1) < 1e-9 for c in range(8))
    assert got[ids[0], 1]["identity_error"] < 1e-9
