"""Event and text streams as Structured Streaming queries.

Each function takes a streaming or a batch DataFrame and returns the same kind, so that the batch form
is the check of the stream. `run_available` drives a stream over everything there is now.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from quire.sources.shared import shared_dir

#: Fixed value: the character that clears what was received and starts anew.
RESTART = "\f"


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table's files as a stream. The path is a pattern, which may name one file or a folder."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name}.parque[t]")


def folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_available(spark: SparkSession, out: DataFrame, name: str, mode: str) -> DataFrame:
    """Runs `out` over all available input and returns what it wrote.

    Append mode writes files as they come; in complete mode the last micro-batch replaces the earlier ones.
    State and progress are in the shared folder, so that a lost executor or driver costs one micro-batch.
    """
    at = folder(spark, name)
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/progress").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{at}/out").start()
    else:

        def replace(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{at}/out")

        query = writer.foreachBatch(replace).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{at}/out")


def latest_state(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """(key, state, n): newest state and number of events; a running aggregation."""
    return events.groupBy(key).agg(F.max_by(state, F.struct(*order)).alias(state), F.count("*").alias("n"))


def rates(events: DataFrame, key: str, at: str, width: str, late: str) -> DataFrame:
    """(key, starts, n): events for each key and time window; later ones than `late` are left out."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    counts = timed.groupBy(key, F.window("__at", width)).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("starts"), "n")


def once(events: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """The first event of each key within the watermark: a finished step is not run again."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    return timed.dropDuplicatesWithinWatermark(keys).select(*keys)


def unfinished(events: DataFrame, key: str, kind: str, ends: str) -> DataFrame:
    """(key, n): keys of which no event of kind `ends` came."""
    counts = events.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.col(kind) == ends).alias("e"))
    return counts.where("e = 0").select(key, "n")


def fold_text(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, text, updates): deltas of each key joined in order, whatever micro-batch brings them; a delta that holds RESTART drops
    what comes before its last one. State is the deltas from the last restart on; each trigger emits changed keys."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        orders, kept, updates = state.get if state.exists else ([], [], 0)
        new = pd.concat(parts)
        rows = sorted([*zip(orders, kept), *zip(new[order].tolist(), new[text].fillna(""))], key=lambda r: r[0])
        last = max((i for i, (_, t) in enumerate(rows) if RESTART in t), default=0)
        rows = [(o, RESTART + t.rpartition(RESTART)[2] if RESTART in t else t) for o, t in rows[last:]]
        state.update(([o for o, _ in rows], [t for _, t in rows], updates + len(new)))
        yield pd.DataFrame({key: [k[0]], "text": ["".join(t for _, t in rows).rpartition(RESTART)[2]], "updates": [updates + len(new)]})

    kind, number = (deltas.schema[c].dataType.simpleString() for c in (key, order))
    return deltas.select(key, order, text).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, text string, updates long", f"orders array<{number}>, kept array<string>, updates long", "update", GroupStateTimeout.NoTimeout
    )


def fold_text_batch(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """The same over a finished table."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.coalesce(text, F.lit("")).alias("t"))))
    joined = F.array_join(F.transform(parts, lambda x: x["t"]), "")
    last = F.substring_index(joined, RESTART, -1)
    return deltas.groupBy(key).agg(last.alias("text"), F.count("*").alias("updates"))


def complete_fields(text: str) -> dict[str, str]:
    """The fields of a JSON object that has only come in part, as JSON texts: those whose value has ended."""
    reader, out = json.JSONDecoder(), {}
    at = text.find("{") + 1
    while at:
        try:
            name, at = reader.raw_decode(text, re.compile(r"[\s,]*").match(text, at).end())
            start = re.compile(r"\s*:\s*").match(text, at)
            value, at = reader.raw_decode(text, start.end())
        except (ValueError, AttributeError):
            break
        # a number may go on; what closes itself doesn't
        if isinstance(value, (str, list, dict)) or re.compile(r"\s*[,}\]]").match(text, at):
            out[str(name)] = json.dumps(value, ensure_ascii=False)
    return out


def fields_as_they_end(deltas: DataFrame, key: str, order: str, text: str) -> DataFrame:
    """(key, seq, field, value): each field of a JSON object when the delta number `seq` ends or changes it.

    Deltas count from 0 without gaps; one that comes before its predecessor waits for it, so what is emitted doesn't depend
    on how deltas fall into micro-batches. State is the text so far, the values shown and the deltas that wait.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        so_far, following, names, values, ahead, held = state.get if state.exists else ("", 0, [], [], [], [])
        shown, waiting = dict(zip(names, values)), dict(zip(ahead, held))
        for part in parts:
            waiting |= dict(zip(part[order].tolist(), part[text].fillna("")))
        out = []
        while following in waiting:
            so_far += waiting.pop(following)
            for name, value in complete_fields(so_far).items():
                if shown.get(name) != value:
                    shown[name] = value
                    out.append((k[0], following, name, value))
            following += 1
        state.update((so_far, following, list(shown), list(shown.values()), list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=[key, "seq", "field", "value"])

    kind = deltas.schema[key].dataType.simpleString()
    held = "so_far string, following long, names array<string>, shown array<string>, ahead array<long>, held array<string>"
    return deltas.select(key, F.col(order).cast("long").alias(order), text).groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, seq long, field string, value string", held, "append", GroupStateTimeout.NoTimeout
    )


def live_pages(events: DataFrame, key: str) -> DataFrame:
    """(key, page, text, marks, version): a document's pages as they stand, from one stream of pages and patches.

    `events` has (key, page, seq, text, find): a page has a text, and the newest (largest `seq`) stands; a patch has a piece to be marked. Patches
    that come before their page are kept back and laid on when it comes; `marks` are the pieces, in order of `seq`, that the text
    holds. Each trigger emits the pages that changed, with a rising `version`.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        pages, seqs, texts, at, order, finds, version = state.get if state.exists else ([], [], [], [], [], [], 0)
        have = dict(zip(pages, zip(seqs, texts)))
        patches = set(zip(at, order, finds))
        changed: set[int] = set()
        for row in pd.concat(parts).itertuples():
            if pd.isna(row.find):
                if row.page not in have or have[row.page][0] < row.seq:
                    have[row.page] = (row.seq, row.text or "")
            else:
                patches.add((row.page, row.seq, row.find))
            changed.add(row.page)
        version += 1
        state.update((list(have), [s for s, _ in have.values()], [t for _, t in have.values()], *map(list, zip(*sorted(patches)) if patches else ([], [], [])), version))
        out = []
        for page in sorted(changed & have.keys()):
            text = have[page][1]
            out.append((k[0], page, text, [f for p, _, f in sorted(patches) if p == page and f in text], version))
        yield pd.DataFrame(out, columns=[key, "page", "text", "marks", "version"])

    kind = events.schema[key].dataType.simpleString()
    held = "pages array<long>, seqs array<long>, texts array<string>, at array<long>, at_seq array<long>, finds array<string>, version long"
    rows = events.select(key, F.col("page").cast("long").alias("page"), F.col("seq").cast("long").alias("seq"), "text", "find")
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, page long, text string, marks array<string>, version long", held, "update", GroupStateTimeout.NoTimeout)


def live_pages_batch(events: DataFrame, key: str) -> DataFrame:
    """The same over finished tables, without `version`."""
    pages = events.where("find is null").groupBy(key, "page").agg(F.coalesce(F.max_by("text", "seq"), F.lit("")).alias("text"))
    patches = events.where("find is not null").groupBy(key, "page").agg(F.array_sort(F.collect_set(F.struct("seq", "find"))).alias("p"))
    finds = F.transform(F.coalesce("p", F.array()), lambda p: p["find"])
    return pages.join(patches, [key, "page"], "left").select(key, "page", "text", F.filter(finds, lambda f: F.contains("text", f)).alias("marks"))


def run_updates(spark: SparkSession, out: DataFrame, name: str, key: str | list[str], order: str) -> DataFrame:
    """Runs an update-mode stream and keeps each key's last row (largest `order`)."""
    at = folder(spark, name)

    def add(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number)).write.mode("overwrite").parquet(f"{at}/out/part={number}")

    merge: Callable = add
    query = out.writeStream.outputMode("update").option("checkpointLocation", f"{at}/progress").trigger(availableNow=True).foreachBatch(merge).start()
    query.awaitTermination()
    rows = spark.read.parquet(f"{at}/out")
    keys = [key] if isinstance(key, str) else key
    columns = [c for c in out.columns if c not in keys]
    return rows.groupBy(*keys).agg(*[F.max_by(c, F.struct("__batch", order)).alias(c) for c in columns])
