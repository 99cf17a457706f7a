"""Operator 10: best-fit packing of tokenised documents by hierarchical residual packing.

Documents become token ids, are cut into pieces of at most `capacity`, and the pieces are packed
into sequences of that size: every partition packs its items best-fit, largest first, sends its nearly full
bins out and is left with at most one bin that is half full or less. Fuller bins can't join each other, so a tree of
merges, `FAN_IN` shares to a group, packs those few with the bins that could take them, as items, until one group
is left: a task's rows depend on the fan-in and the capacity alone. Only lengths travel after the first pass.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import own_columns, slices, texts, written
from quire.llm.token_units import byte_letters

CAPACITY = 2048
#: Ends each document (fixed value).
END_ID = 0
ID_BYTES = 4
#: Items that one task packs.
ITEMS_EACH = 200_000
#: A bin with at most this many free places is sent out before the last round.
NEARLY_FULL = 16
#: Shares, or groups of them, that one merge takes.
FAN_IN = 8
#: One text of so many is encoded by both libraries.
COMPARED = 64

_ENCODERS: dict[str, "Encoder"] = {}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes; the ids are those of `tokenizers`.

    The vocabulary file's own entries also drive a `tiktoken` encoder, about six times as fast on
    the same vocabulary. Both are compared on a probe when the file is opened and, in every batch, on the texts
    whose crc32 is divisible by `COMPARED`; if they ever differ, that batch and all later ones are encoded by `tokenizers` alone. So
    are texts that hold the string of a special token.
    """

    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: byte-level pre-tokens
    PROBE = "It's a  test,\nof Übung 12.5%  \n\n\tnaïve… don't 漢字 !!"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.special = [t.content for t in self.model.get_added_tokens_decoder().values()]
        self.quick = self._quick()

    def _plain(self, text: str) -> list[int]:
        return self.model.encode(text, add_special_tokens=False).ids

    def _quick(self):
        import tiktoken

        letters = byte_letters()
        try:
            ranks = {bytes(letters[c] for c in w): i for w, i in self.model.get_vocab(with_added_tokens=False).items() if w not in self.special}
            made = tiktoken.Encoding("byte-level", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})
        except (KeyError, ValueError):
            return None
        return made.encode_ordinary if made.encode_ordinary(self.PROBE) == self._plain(self.PROBE) else None

    def _ids(self, text: str) -> list[int]:
        return self._plain(text) if self.quick is None or any(s in text for s in self.special) else self.quick(text)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text of a batch; null and empty texts have none."""
        made = [self._ids(t) if t else [] for t in texts]
        if self.quick is not None:
            checked = [(t, ids) for t, ids in zip(texts, made) if t and zlib.crc32(t.encode()) % COMPARED == 0]
            if any(self._plain(t) != ids for t, ids in checked):
                self.quick = None
                return self.encode(texts)
        return [struct.pack(f"<{len(ids)}I", *ids) for ids in made]


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: full ones, and before them one with the rest."""
    rest = n % capacity
    starts = ([0] if rest else []) + list(range(rest, n, capacity))
    return [(s, e - s) for s, e in zip(starts, [*starts[1:], n])]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, row, piece, start, length, ids_crc32), the pieces of each row's ids and its end id.

    `row` tells rows apart, also such as repeat a doc_id. Null and empty texts are one
    piece, the end id alone.
    """
    end = END_ID.to_bytes(ID_BYTES, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in slices(batches):
            out: list[list] = [[], [], [], [], [], []]
            keys, rows = batch.column("doc_id").to_pylist(), batch.column("row").to_pylist()
            for key, row, ids in zip(keys, rows, coder.encode(texts(batch))):
                data = ids + end
                for k, (start, length) in enumerate(cut(len(data) // ID_BYTES, capacity)):
                    crc = zlib.crc32(data[start * ID_BYTES : (start + length) * ID_BYTES])
                    for column, value in zip(out, (key, row, k, start, length, crc)):
                        column.append(value)
            kinds = [batch.schema.field("doc_id").type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "row", "piece", "start", "length", "ids_crc32"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = own_columns(docs, ("doc_id", "text")).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(run, f"doc_id {kind}, row long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item: largest first, each into the fullest bin it fits, else a new bin."""
    free: list[int] = []  # distinct free sizes of open bins, sorted
    bins: dict[int, list[int]] = {}
    out, made = [0] * len(sizes), 0
    for k in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size = sizes[k]
        at = bisect_left(free, size)
        if at == len(free):
            b, left, made = made, capacity - size, made + 1
        else:
            left = free[at]
            b = bins[left].pop()
            if not bins[left]:
                del bins[left], free[at]
            left -= size
        out[k] = b
        if left:
            if left not in bins:
                bins[left] = []
                insort(free, left)
            bins[left].append(b)
    return out


_ROUND = "item string, size long, bin string, used long, done boolean, share long"


def _placed(rows: pa.Table, share: int, number: int, capacity: int, spare: int) -> pa.Table:
    """(item, size, bin, used, done, share): one best-fit round over the rows (item, size) of one share."""
    order = rows.sort_by([("size", "descending"), ("item", "ascending")])  # arrival order must not matter
    names, sizes = order["item"].to_pylist(), order["size"].to_pylist()
    placed = best_fit(sizes, capacity)
    used: dict[int, int] = {}
    head: dict[int, str] = {}
    for name, size, b in zip(names, sizes, placed):
        used[b] = used.get(b, 0) + size
        head.setdefault(b, name)
    return pa.table(
        {
            "item": pa.array(names, pa.string()),
            "size": pa.array(sizes, pa.int64()),
            "bin": pa.array([f"{number}:{head[b]}" for b in placed], pa.string()),
            "used": pa.array([used[b] for b in placed], pa.int64()),
            "done": pa.array([capacity - used[b] <= spare for b in placed], pa.bool_()),
            "share": pa.array([share] * len(names), pa.int64()),
        }
    )


def _shares(items: DataFrame, parts: int, capacity: int, spare: int) -> DataFrame:
    """The first round: items (item, size) dealt to `parts` shares, each packed for itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if rows:
            yield from _placed(pa.Table.from_batches(rows), TaskContext.get().partitionId(), 0, capacity, spare).to_batches()

    dealt = items.repartition(parts, "item") if parts > 1 else items.coalesce(1)
    return dealt.mapInArrow(run, _ROUND)


def _merge(bins: DataFrame, number: int, capacity: int, spare: int, fan_in: int) -> DataFrame:
    """One level of the tree: `fan_in` shares of open bins (item, size, share) become one, packed as items.

    A share has at most one bin that is half full or less, so a group has `fan_in` such bins, and of each fill it needs no more
    than that many bins to take them: at most fan_in * capacity / 2 rows are packed together.
    """
    grouped = bins.withColumn("share", F.floor(F.col("share") / fan_in))
    small = grouped.where(2 * F.col("size") <= capacity)
    place = F.row_number().over(Window.partitionBy("share", "size").orderBy("item"))
    takers = grouped.where(2 * F.col("size") > capacity).withColumn("place", place).where(F.col("place") <= fan_in).drop("place")

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _placed(rows, key[0].as_py(), number, capacity, spare)

    return small.union(takers).groupBy("share").applyInArrow(run, _ROUND)


def pack(sized: DataFrame, capacity: int = CAPACITY, items_each: int = ITEMS_EACH, fan_in: int = FAN_IN) -> DataFrame:
    """(item, bin) for all rows (item string, size long) with 1 <= size <= capacity; items differ.

    Shares of about `items_each` items are packed each for itself. At most one bin of a share is half full or
    less (two would have been one), and fuller bins can't be joined: what is left to do is to place these few bins, which
    a tree of merges does level by level, `fan_in` groups to one.
    """
    parts = max(1, -(-sized.count() // items_each))
    step = written(_shares(sized.select("item", "size"), parts, capacity, NEARLY_FULL), "packing")
    packed = step.select("item", F.col("bin").alias("sequence"))
    left = step.agg(F.max("share")).first()[0] if parts > 1 else 0
    moved, number = None, 0
    while left:
        bins = step.where("not done").groupBy("bin").agg(F.max("used").alias("size"), F.max("share").alias("share"))
        number += 1
        step = written(_merge(bins.withColumnRenamed("bin", "item"), number, capacity, NEARLY_FULL, fan_in), "packing")
        level = step.select(F.col("item").alias("sequence"), F.col("bin").alias("final"))
        # bins of a level were bins of the level before, so the moves follow each other
        later = level.select(F.col("sequence").alias("final"), F.col("final").alias("next"))
        moved = level if moved is None else moved.join(later, "final", "left").select("sequence", F.coalesce("next", "final").alias("final"))
        left //= fan_in
    if moved is None:
        return packed
    return packed.join(moved, "sequence", "left").select("item", F.coalesce("final", "sequence").alias("sequence"))


def best_fit_packing(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, items_each: int = ITEMS_EACH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row for each piece.

    Offsets are gapless from 0 in each sequence of at most `capacity` tokens. Rows that repeat
    a doc_id are packed each for itself. An empty table gives an empty one. sequence_id is any
    number, another one for each sequence.
    """
    cuts = written(pieces(docs, vocabulary, capacity), "pieces")
    named = cuts.withColumn("item", F.concat_ws("/", "row", "piece"))
    placed = named.join(pack(named.select("item", F.col("length").alias("size")), capacity, items_each), "item")
    sequences = placed.groupBy("sequence").agg(
        F.sort_array(F.collect_list(F.struct(F.xxhash64("item").alias("h"), "item", "doc_id", "piece", "start", "length", "ids_crc32"))).alias("all")
    )
    laid = sequences.select(
        F.monotonically_increasing_id().alias("sequence_id"),
        "all",
        F.expr("transform(all, (x, i) -> aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.length))").alias("offsets"),
    )
    each = laid.select("sequence_id", F.explode(F.arrays_zip("all", "offsets")).alias("z"))
    return each.select(
        "z.all.doc_id", "z.all.piece", "z.all.start", "z.all.length", "z.all.ids_crc32", "sequence_id", F.col("z.offsets").alias("offset")
    )
