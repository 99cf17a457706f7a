"""Operator 8: SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints within `distance` bits of each other are found exactly: the 64 bits are split into
partitions of correlated bits, partition i gets a threshold t_i with
sum(t_i + 1) = distance + 1, and two fingerprints that are within `distance` overall are within t_i in at least
one partition. Dynamic programming chooses the thresholds by the probes and candidates they
are expected to cost. A threshold of t is probed by masking every set of t bits of the
partition: two values within t bits agree under one of the masks. The statistics cover
all distinct fingerprints; every candidate is verified on all 64 bits in the join itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.common import own_columns, slices, texts, words_lower, written
from quire.llm.components import components

WIDTH = 64
SEED = 42
#: Cost of one probe row against one candidate pair compared.
PROBE_COST = 20.0
MOST_PARTITIONS = 6
#: Shingle hashes whose bits are counted at once.
PIECE = 16_384


def fingerprint(words: list[bytes], shingle: int) -> int:
    """64-bit SimHash: a bit is 1 if set in over half the shingle hashes; no words: 0."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[s : e - 1], SEED) for s, e in zip(starts, ends[shingle - 1 :])] or [digest(joined, SEED)]
    octets = np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8)
    # in pieces: a bit takes a byte once unpacked
    ones = sum(np.unpackbits(octets[k : k + PIECE], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(octets), PIECE))
    return int.from_bytes(np.packbits(ones * 2 > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp), one row for each input row; fp is the 64 bits as a signed long.

    Words are runs without ASCII white space of the whole text with A-Z lower-cased; a text of fewer
    than `shingle` words is one shingle; null and empty texts have fingerprint 0.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [fingerprint(words_lower(t), shingle) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, fp long")


def together(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """(number of fingerprints, 64 x 64 counts of bits set together), summed over all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = 0, np.zeros((WIDTH, WIDTH))
        for batch in batches:
            values = np.ascontiguousarray(batch.column("fp").to_numpy().astype(">i8")).view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1).astype(np.float32)[:, ::-1]
            n += len(bits)
            counts += bits.T @ bits
        k = np.arange(WIDTH * WIDTH + 1)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(np.append(counts.ravel(), n))], names=["k", "n"])

    rows = distinct.select("fp").mapInArrow(run, "k long, n double").groupBy("k").agg(F.sum("n").alias("n")).collect()
    flat = np.zeros(WIDTH * WIDTH + 1)
    for r in rows:
        flat[r["k"]] = r["n"]
    return int(flat[-1]), flat[:-1].reshape(WIDTH, WIDTH)


def group_bits(n: int, counts: np.ndarray, parts: int) -> list[list[int]]:
    """`parts` sets of bits, near equal in size: each grows from one seed bit by the bit
    most correlated with what it has, so that correlated bits share a partition."""
    p = np.diag(counts) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(counts / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, out = list(range(WIDTH)), []
    for k in range(parts):
        size = WIDTH // parts + (k < WIDTH % parts)
        own = [max(left, key=lambda b: (related[b, left].sum(), -b))]
        left.remove(own[0])
        while len(own) < size:
            best = max(left, key=lambda b: (related[b, own].sum(), -b))
            own.append(best)
            left.remove(best)
        out.append(sorted(own))
    return out


def _cost(n: int, p: np.ndarray, bits: list[int], t: int) -> float:
    """Expected cost of a partition at threshold t; -1 leaves it out."""
    if t < 0:
        return 0.0
    same = p[bits] ** 2 + (1 - p[bits]) ** 2
    masks = list(combinations(range(len(bits)), t)) if math.comb(len(bits), t) <= 3000 else None
    if masks is None:
        return math.inf
    whole = float(np.prod(same))
    agree = whole * sum(1 / float(np.prod(same[list(m)])) for m in masks)
    return PROBE_COST * n * len(masks) + n * n / 2 * agree


def allocate(n: int, p: np.ndarray, parts: list[list[int]], distance: int) -> tuple[float, list[int]]:
    """(cost, thresholds): the cheapest with sum(t + 1) = distance + 1, by dynamic programming."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for bits in parts:
        step: dict[int, tuple[float, list[int]]] = {}
        prices = [_cost(n, p, bits, t) for t in range(-1, distance + 1)]
        for used, (cost, chosen) in best.items():
            for t in range(-1, distance + 1 - used):
                made = (cost + prices[t + 1], [*chosen, t])
                if used + t + 1 not in step or made < step[used + t + 1]:
                    step[used + t + 1] = made
        best = step
    return best[distance + 1]


def plan(n: int, counts: np.ndarray, distance: int) -> list[int]:
    """Bit masks to probe with: equal values under one of them make a candidate pair."""
    p = np.diag(counts) / max(n, 1)
    options = []
    for parts in range(1, min(MOST_PARTITIONS, distance + 2) + 1):
        groups = group_bits(n, counts, parts)
        cost, chosen = allocate(n, p, groups, distance)
        options.append((cost, parts, groups, chosen))
    _, _, groups, chosen = min(options, key=lambda x: (x[0], x[1]))
    masks = []
    for bits, t in zip(groups, chosen):
        for hidden in combinations(bits, t) if t >= 0 else ():
            masks.append(sum(1 << b for b in bits if b not in hidden))
    return masks


def links(distinct: DataFrame, distance: int = 4) -> DataFrame:
    """(a, b): pairs of distinct fingerprints `fp` at 1 to `distance` bits, enough of them to connect all that any such pairs
    connect. In a bucket each fingerprint is first compared with the smallest and with the one before it; only
    where that leaves several components are the others compared, and across components alone, and one link
    of a fingerprint to a component is enough."""
    n, counts = together(distinct)
    masks = plan(n, counts, distance)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    slots = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(m).alias("mask")) for i, m in enumerate(signed)])
    keyed = distinct.select("fp", F.explode(slots).alias("s")).select("fp", "s.slot", F.col("fp").bitwiseAND(F.col("s.mask")).alias("key"))
    place = Window.partitionBy("slot", "key").orderBy("fp")
    before, after = F.lag("fp").over(place), F.lead("fp").over(place)
    met = keyed.select("slot", "key", "fp", before.alias("before"), after.alias("after"), F.first("fp").over(place).alias("least"))
    shared = written(met.where("before is not null or after is not null").drop("after"), "simhash-shared")

    def near(x: str, y: str) -> Column:
        return F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= distance

    tries = shared.where("before is not null").select(F.col("fp").alias("b"), F.explode(F.array("before", "least")).alias("a"))
    first = written(tries.where(near("a", "b")).select("a", "b").distinct(), "simhash-links")
    home = shared.join(components(first), F.col("fp") == F.col("id"), "left").select("slot", "key", "fp", F.coalesce("component", "fp").alias("c"))
    home = written(home, "simhash-home")
    split = home.groupBy("slot", "key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("slot", "key")
    left = home.join(split, ["slot", "key"])
    x, y = left.alias("x"), left.alias("y")
    same = (F.col("x.slot") == F.col("y.slot")) & (F.col("x.key") == F.col("y.key"))
    across = x.join(y, same & (F.col("x.c") < F.col("y.c")) & near("x.fp", "y.fp")).groupBy(F.col("x.fp").alias("a"), F.col("y.c").alias("c"))
    return first.union(across.agg(F.min("y.fp").alias("b")).select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable by links.

    Every input row gets one row. Documents with equal fingerprints (all null and
    empty texts among them) are linked. Copies stay one fingerprint until the last join, so groups
    of copies make no pairs. Rows that share a doc_id each keep their row; null ids come out with
    the component of their fingerprint.
    """
    prints = written(fingerprints(docs, shingle), "simhash")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    found = components(links(distinct, distance))
    joined = distinct.join(found, distinct.fp == found.id, "left")
    home = joined.select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    first = home.groupBy("component").agg(F.min("first_id").alias("component_id"))
    home = home.join(first, "component").select("fp", "component_id")
    return prints.join(home, "fp").select("doc_id", "fp", "component_id")


def hex_fingerprint(fp):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_first(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The rows of `docs`, all columns, without near-duplicates: of each group the document with the
    smallest doc_id stays, and rows that repeat that id stay with it. A null id stays only if its group has no other."""
    found = near_duplicates(docs.select("doc_id", "text"), distance, shingle)
    stay = found.where("doc_id <=> component_id").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(stay, docs["doc_id"].eqNullSafe(F.col("__id")), "left_semi")
