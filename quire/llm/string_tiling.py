"""Operator 6: benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds, runs of `SEED_WORDS` words. For each such pair
the longest common runs of words are marked again and again, without overlap, down to the seed
length; a running Karp-Rabin hash finds them. The share of the item's words that the tiles
cover decides, so passages that were put in another order are found too.

The benchmark is the query set: it goes to the tasks in blocks of bounded size, and every
document is read once for each block. No document text is shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import byte_length, own_columns, slices, texts, words_lower

SEED_WORDS = 5
COVERAGE = 0.5
#: Bytes of benchmark text that travel to the tasks at a time.
BLOCK_BYTES = 8 << 20

PRIME = (1 << 61) - 1
BASE = 1_000_003
MIX = np.uint64(0x9E3779B97F4A7C15)

_INDEXES: dict[str, "Index"] = {}


class Index:
    """Words and seeds of one block of benchmark items [(item_id, text)]."""

    def __init__(self, items: list[tuple], seed_words: int):
        self.words: dict[bytes, int] = {}
        self.items: list[tuple] = []
        seeds: dict[int, dict[int, set[int]]] = {}
        for item_id, text in items:
            ids = [self.words.setdefault(w, len(self.words)) for w in words_lower(text)]
            if not ids:
                continue
            k = len(self.items)
            size = min(seed_words, len(ids))
            self.items.append((item_id, ids, size))
            for h in self.hashes(np.array(ids, np.int64), size).tolist():
                seeds.setdefault(size, {}).setdefault(h, set()).add(k)
        self.seeds = {n: (np.array(sorted(of), np.uint64), of) for n, of in seeds.items()}

    @staticmethod
    def hashes(ids: np.ndarray, size: int) -> np.ndarray:
        """A 64-bit hash of every `size` neighbouring ids."""
        n = len(ids) - size + 1
        h = np.zeros(max(n, 0), np.uint64)
        if n > 0:
            for j in range(size):
                h = (h ^ ids[j : j + n].astype(np.uint64)) * MIX
                h ^= h >> np.uint64(29)
        return h

    def candidates(self, words: list[bytes]) -> dict[int, list[tuple[int, list[int]]]]:
        """{item: [(start, ids)]}: for each item that shares a seed, the document's runs of words
        that its seeds cover. Words outside them can't be in a tile."""
        get = self.words.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        found: dict[int, list[tuple[int, int]]] = {}
        for size, (sorted_hashes, of) in self.seeds.items():
            if len(ids) < size:
                continue
            unknown = np.concatenate(([0], np.cumsum(ids < 0)))
            at = np.nonzero(unknown[size:] == unknown[:-size])[0]
            if not len(at):
                continue
            h = self.hashes(ids, size)[at]
            place = np.minimum(np.searchsorted(sorted_hashes, h), len(sorted_hashes) - 1)
            hit = sorted_hashes[place] == h
            for p, x in zip(at[hit].tolist(), h[hit].tolist()):
                for k in of[x]:
                    runs = found.setdefault(k, [])
                    if runs and p <= runs[-1][1]:
                        runs[-1] = (runs[-1][0], p + size)
                    else:
                        runs.append((p, p + size))
        return {k: [(a, ids[a:b].tolist()) for a, b in runs] for k, runs in found.items()}


def _windows(ids: list[int], free: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, rolling hash) of the windows of `size` ids that hold no marked place."""
    top = pow(BASE, size - 1, PRIME)
    h = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = run = 0
            continue
        if run >= size:
            h = (h - (ids[i - size] + 1) * top) % PRIME
        h = (h * BASE + x + 1) % PRIME
        run += 1
        if run >= size:
            yield i - size + 1, h


def tiles(item: list[int], runs: list[tuple[int, list[int]]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling: [(start in the item, start in the document, length)], longest first.

    Equal lengths go by the item's place, then the document's. Each word of either side is in
    one tile at most; no tile is shorter than `least`.
    """
    # runs are joined with a gap that matches nothing
    text, origin = [], []
    for start, ids in runs:
        text += [*ids, -2]
        origin += [*range(start, start + len(ids)), -1]
    free_item, free_text = [True] * len(item), [x >= 0 for x in text]
    out, size = [], min(len(item), max((len(ids) for _, ids in runs), default=0))
    while size >= least:
        table: dict[int, list[int]] = {}
        for p, h in _windows(item, free_item, size):
            table.setdefault(h, []).append(p)
        matches = []
        for t, h in _windows(text, free_text, size):
            for p in table.get(h, ()):
                if item[p : p + size] == text[t : t + size]:
                    n = size
                    while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and free_item[p + n] and free_text[t + n]:
                        n += 1
                    matches.append((-n, p, t))
        matches.sort()
        for n, p, t in matches:
            n = -n
            if all(free_item[p : p + n]) and all(free_text[t : t + n]):
                free_item[p : p + n] = [False] * n
                free_text[t : t + n] = [False] * n
                out.append((p, origin[t], n))
        # what a longer tile now cuts is found again at its own length
        size = size - 1 if size <= 2 * least else max(size // 2, least)
    return out


def covered(item: list[int], runs: list[tuple[int, list[int]]], least: int) -> int:
    return sum(n for _, _, n in tiles(item, runs, least))


def _index(key: str, block) -> Index:
    if key not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[key] = Index(*block.value)
    return _INDEXES[key]


def blocks(benchmark: DataFrame, seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES) -> Iterator[tuple]:
    """(key, broadcast) for each block of the benchmark; a block holds about `block_bytes` of text."""
    rows = own_columns(benchmark, ("item_id", "text")).where("text is not null")
    total = rows.agg(F.sum(byte_length(F.col("text")) + 16)).first()[0] or 0
    n = max(1, -(-int(total) // block_bytes))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for k in range(n):
        items = sorted(((r["item_id"], r["text"]) for r in rows.where(block == k).collect()), key=repr)
        yield uuid.uuid4().hex, benchmark.sparkSession.sparkContext.broadcast((items, seed_words))


def matches(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, item_id, item_words, covered_words, coverage): the contaminated pairs.

    A pair is contaminated if tiles cover at least `coverage` of the item's words.
    Items with fewer than `seed_words` words count if the document holds them whole; items without a word,
    null texts and empty tables give no pair. Rows that repeat a doc_id or an item_id
    give their pairs each. Words are runs without ASCII white space with A-Z lower-cased.
    """
    kinds = (docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString())
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, item_words int, covered_words int, coverage double"
    found = None
    for key, block in blocks(benchmark, seed_words, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, block=block) -> Iterator[pa.RecordBatch]:
            index = _index(key, block)
            for batch in slices(batches):
                rows = []
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch)):
                    for k, runs in index.candidates(words_lower(text)).items():
                        item_id, ids, least = index.items[k]
                        n = covered(ids, runs, least)
                        if n >= coverage * len(ids):
                            rows.append((doc_id, item_id, len(ids), n, n / len(ids)))
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("doc_id", "item_id", "item_words", "covered_words", "coverage"), r)) for r in rows], arrow_schema
                )

        from pyspark.sql.pandas.types import to_arrow_schema
        from pyspark.sql.types import _parse_datatype_string

        arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
        part = own_columns(docs, ("doc_id", "text")).mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of `docs`, all columns, that no benchmark item contaminates; `text` is their text."""
    for key, block in blocks(benchmark, seed_words, block_bytes):

        def run(batches: Iterator[pa.RecordBatch], key: str = key, block=block) -> Iterator[pa.RecordBatch]:
            index = _index(key, block)
            for batch in slices(batches):
                keep = []
                for text in texts(batch):
                    pairs = index.candidates(words_lower(text)).items()
                    keep.append(not any(covered(index.items[k][1], r, index.items[k][2]) >= coverage * len(index.items[k][1]) for k, r in pairs))
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
