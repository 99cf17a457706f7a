"""Operator 12: alignment of two tokenizers' tokens by diagonal run skipping, and counts of linked ids.

Both tokenizers write the same bytes, so a text's tokens are two rising arrays of byte ends. Where both end
together, one to one, the arrays agree at a fixed shift of the indices: slices that double in length are
compared at that shift, and a slice that differs is halved, so a stretch of k tokens takes about log k
steps. What stops a stretch is an irregular group, walked token by token to the next common end, where the shift
is taken anew.

A pair of ids is linked where a token of each ends at the same byte; tokens have at least one byte, so each group
has one link, of its last tokens. How often a pair is linked in the whole corpus is counted in Spark: documents are
taken in blocks of bounded text, a block asks once for each of its pairs, and gets the counts back as one row set
that is joined to the block's documents.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import own_columns, slices, texts, written
from quire.llm.piece_bpe import SPACE, lists
from quire.llm.token_units import ByteVocabulary, Kept, units

#: UTF-8 bytes of text that make a block.
BLOCK_BYTES = 8 << 20
#: A pair is one number: the A id times this, plus the B id.
PAIR = 1 << 31

_MODELS: dict[tuple[str, str], "Tokens"] = {}


def aligned(a: list[int], b: list[int]) -> Iterator[tuple[int, int, int, int, bool]]:
    """Groups of two rising lists of ends with the same last end: (from_a, to_a, from_b, to_b, single).

    `single` marks a whole stretch of one-to-one groups at one shift of the indices, as long as it goes.
    """
    i = j = 0
    n = len(a)
    while i < n:
        at, step = i, 1
        if a[i] == b[j]:
            at, step = i + 1, 2
        while step > 1 and at < n and a[at : at + step] == b[j + at - i : j + at - i + step]:
            at = min(at + step, n)
            step *= 2
        while step > 1 and at < n:
            step //= 2
            if a[at : at + step] == b[j + at - i : j + at - i + step]:
                at = min(at + step, n)
        if at > i:
            yield i, at, j, j + at - i, True
            i, j = at, j + at - i
        if i < n:
            p, q = i, j
            while a[p] != b[q]:
                if a[p] < b[q]:
                    p += 1
                else:
                    q += 1
            yield i, p + 1, j, q + 1, False
            i, j = p + 1, q + 1


class Tokens:
    """A and B tokens of texts, unit by unit."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self.a = ByteVocabulary(byte_path, special_as_text=True)
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        every = range(self.b.get_piece_size())
        pieces = [self.b.id_to_piece(i) for i in every]
        spelled = self.a.entry_bytes()
        self.spell_a = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        self.spell_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int32) for x in (self.spell_a, self.spell_b))
        own = [p for i, p in enumerate(pieces) if not self.b.is_byte(i)]
        #: Units may be encoded each for itself if no piece has a space after another character, or a line feed at all.
        self.cut = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in own)
        self.kept = Kept()

    def _learn(self, new: list[str]) -> Iterator[tuple[str, tuple[bytes, ...]]]:
        """A and B ids of each unit; nothing for units that a vocabulary doesn't give back."""
        # the space that B sets before a text stands for the first space, or goes again where there is none
        bare = [not u.startswith(" ") for u in new]
        made = self.b.encode([u if b else u[1:] for u, b in zip(new, bare)], num_threads=1)
        spell_a, spell_b, space = self.spell_a, self.spell_b, [self.b.piece_to_id(SPACE)]
        for unit, ids, own, drop in zip(new, self.a.encode(new), made, bare):
            own = own[1:] if drop else own or space
            same = b"".join([spell_a[i] for i in ids]) == unit.encode("utf-8", "surrogatepass") == b"".join([spell_b[i] for i in own])
            yield unit, (array("i", ids).tobytes(), array("i", own).tobytes()) if same else ()

    def of(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, list[int], np.ndarray, list[int]] | None]:
        """(A ids, A ends, B ids, B ends) of each text, None where it has no tokens."""
        # a text with U+2581 can't come back from B, so no time is spent on it
        parts = [(units(" " + t) if self.cut else [" " + t]) if t and SPACE not in t else [] for t in texts]
        got = [list(map(self.kept.get, each)) for each in parts]
        new = dict(self._learn(list({u: None for each, found in zip(parts, got) for u, x in zip(each, found) if x is None})))
        for each, found in zip(parts, got):
            if None in found:
                found = [new[u] if x is None else x for u, x in zip(each, found)]
            if not found or () in found:
                yield None
                continue
            ids_a, ids_b = (np.frombuffer(b"".join(c), np.int32) for c in zip(*found))
            yield ids_a, np.cumsum(self.size_a[ids_a]).tolist(), ids_b, np.cumsum(self.size_b[ids_b]).tolist()
        for unit, found in new.items():
            self.kept.keep(unit, found)


def tokens(byte_path: str, piece_path: str) -> Tokens:
    """The two vocabularies, opened once in each worker."""
    key = (byte_path, piece_path)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = Tokens(*key)
    return _MODELS[key]


#: Ids as text with what follows them: `,` inside a group, `|` after its A ids, `;` after its B ids.
_SAID: list[list[str]] = [[], []]


def _said(at: int, ids: np.ndarray) -> list[str]:
    """Text of numbers 2 * id + (1 if the id is the last of its side of a group)."""
    known = _SAID[at]
    for i in range(len(known) // 2, int(ids.max()) // 2 + 1):
        known += [f"{i},", f"{i}{'|;'[at]}"]
    return list(map(known.__getitem__, ids.tolist()))


def groups(ids_a: np.ndarray, ends_a: list[int], ids_b: np.ndarray, ends_b: list[int]) -> tuple[int, str, np.ndarray]:
    """Number of groups, the groups as text (`a1,a2|b1;a3|b2`) and the pair of last ids of each."""
    to_a: list[int] = []  # ends of the groups
    to_b: list[int] = []
    for i, p, j, q, single in aligned(ends_a, ends_b):
        to_a += range(i + 1, p + 1) if single else (p,)
        to_b += range(j + 1, q + 1) if single else (q,)
    a, b = np.array(to_a), np.array(to_b)
    last_a, last_b = np.zeros(len(ids_a), np.int64), np.zeros(len(ids_b), np.int64)
    last_a[a - 1] = last_b[b - 1] = 1
    # an A token comes after the B tokens of the groups before, a B token after the A tokens of its own group too
    place_a = np.arange(len(ids_a)) + np.repeat(np.concatenate(([0], b[:-1])), np.diff(a, prepend=0))
    place_b = np.arange(len(ids_b)) + np.repeat(a, np.diff(b, prepend=0))
    words = np.empty(len(ids_a) + len(ids_b), object)
    words[place_a] = _said(0, 2 * ids_a + last_a)
    words[place_b] = _said(1, 2 * ids_b + last_b)
    return len(a), "".join(words.tolist())[:-1], ids_a[a - 1].astype(np.int64) * PAIR + ids_b[b - 1]


_FIELDS = [("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string())]


def _align(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int) -> DataFrame:
    """Rows of documents (their digest and their pairs), and one row for each block with the pairs of all its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, number, held = tokens(byte_path, piece_path), 0, 0
        seen: list[np.ndarray] = []
        times: list[np.ndarray] = []
        kind = None
        first = TaskContext.get().partitionId() << 32

        def block() -> pa.RecordBatch:
            keys, where = np.unique(np.concatenate(seen) if seen else np.empty(0, np.int64), return_inverse=True)
            many = np.zeros(len(keys), np.int64)
            np.add.at(many, where, np.concatenate(times) if times else np.empty(0, np.int64))
            return rows([None], [[0, 0, 0, 0, ""]], [keys], [many], True)

        def rows(ids, values, pairs, counts, is_block) -> pa.RecordBatch:
            columns = [pa.array([first + number] * len(values), pa.int64()), pa.array(ids, kind), pa.array([is_block] * len(values))]
            columns += [pa.array(c, k) for c, (_, k) in zip(zip(*values), _FIELDS)]
            return pa.RecordBatch.from_arrays(
                [*columns, lists(pairs, pa.int64()), lists(counts, pa.int64())],
                names=["block", "doc_id", "is_block", *[n for n, _ in _FIELDS], "pairs", "times"],
            )

        for batch in slices(batches, 64):
            kind = batch.schema.field("doc_id").type
            values, pairs, counts = [], [], []
            of_batch = texts(batch)
            for found in maker.of(of_batch):
                if found is None:
                    values.append([0, 0, 0, 0, ""])
                    pairs.append(np.empty(0, np.int64))
                    counts.append(np.empty(0, np.int64))
                    continue
                n, said, links = groups(*found)
                own, many = np.unique(links, return_counts=True)
                values.append([len(found[0]), len(found[2]), n, len(links), hashlib.sha256(said.encode()).hexdigest()])
                pairs.append(own)
                counts.append(many)
            if values:
                yield rows(batch.column("doc_id"), values, pairs, counts, False)
            seen += pairs
            times += counts
            held += sum(len(t) for t in of_batch if t)
            if held >= block_bytes:
                yield block()
                seen, times, held, number = [], [], 0, number + 1
        if seen:
            yield block()

    kind = docs.schema["doc_id"].dataType.simpleString()
    fields = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<long>"
    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, f"block long, doc_id {kind}, is_block boolean, {fields}")


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, links, best): links of each id pair in all blocks, and whether no other pair of its B id has more."""
    counted = (
        blocks.select(F.explode(F.arrays_zip("pairs", "times")).alias("z"))
        .groupBy(F.col("z.pairs").alias("pair"))
        .agg(F.sum("z.times").alias("links"))
        .withColumn("b", F.col("pair") % PAIR)
    )
    counted = written(counted, "pair-counts")
    most = counted.groupBy("b").agg(F.max("links").alias("most"))
    return counted.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row for each row of `docs`.

    n_best counts links whose pair is linked as often as any pair of its B id in the whole corpus (ties included), and
    count_sum adds the corpus-wide counts of the links' pairs. Texts that are null, empty, or that one of the
    tokenizers doesn't give back byte by byte have zeros and an empty groups_sha256. Repeated and null ids are
    rows of their own; an empty table gives an empty one. Only doc_id and text are read.
    """
    made = written(_align(docs, byte_path, piece_path, block_bytes), "aligned", ["is_block"])
    blocks = made.where("is_block").select("block", "pairs", "times")
    asked = blocks.select(F.col("block").alias("of_block"), F.explode("pairs").alias("pair")).join(pair_counts(blocks), "pair")
    own = made.where(~F.col("is_block")).drop("is_block")
    kind = made.schema["doc_id"].dataType.simpleString()

    def settle(left: pa.Table, right: pa.Table) -> pa.Table:
        """Sums over the documents of one block, whose size is bounded."""
        order = right.sort_by("pair")
        pair, links = order["pair"].to_numpy(), order["links"].to_numpy()
        best = order["best"].to_numpy().astype(bool)
        pairs, times = left["pairs"].combine_chunks(), left["times"].combine_chunks()
        row = np.repeat(np.arange(left.num_rows), np.diff(pairs.offsets.to_numpy()))
        at = np.searchsorted(pair, pairs.flatten().to_numpy())
        many = times.flatten().to_numpy()
        n_best, total = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        if len(at):
            np.add.at(n_best, row, many * best[at])
            np.add.at(total, row, many * links[at])
        return pa.table({**{n: left[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")}, "n_best": n_best, "count_sum": total, "groups_sha256": left["groups_sha256"]})

    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("block").cogroup(asked.groupBy("of_block")).applyInArrow(settle, out)
