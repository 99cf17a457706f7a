"""Operator 3: quality rules as a short-circuit cascade.

Each rule has a statistic of the text, which costs time, and a bound. On a sample every rule is
timed and its share of rejected texts counted; the rules then run in the order of
rejections per second, and the first that rejects ends the cascade for that text. The order
changes the time only: a text is kept if no rule rejects it, in whatever order.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import own_columns, slices, texts

#: Fixed characters: those counted as symbols, and ASCII white space.
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\f\r"
#: Rows of the sample that the order of rules is estimated on.
SAMPLE_ROWS = 400


class Text:
    """One text; each statistic is computed when first asked for and then kept."""

    def __init__(self, text: str | None):
        self.text = text or ""
        self._words: list[bytes] | None = None
        self._made: dict[str, int] = {}

    @property
    def words(self) -> list[bytes]:
        if self._words is None:
            self._words = self.text.encode("utf-8", "surrogatepass").split()
        return self._words

    def get(self, name: str) -> int:
        if name not in self._made:
            self._made[name] = STATISTICS[name](self)
        return self._made[name]


def _word_chars(t: Text) -> int:
    return len(t.text) - sum(map(t.text.count, SPACES))


def _n_symbols(t: Text) -> int:
    return sum(map(t.text.count, SYMBOLS))


def _lines(t: Text) -> list[str]:
    return [x for x in t.text.split("\n") if x.strip(SPACES)]


def _n_dup_lines(t: Text) -> int:
    lines = _lines(t)
    return len(lines) - len(set(lines))


def _n_repeat_words(t: Text) -> int:
    """Words inside a 3-word window that occurs twice or more, each word counted once."""
    w = t.words
    windows = list(zip(w, w[1:], w[2:]))
    first: dict[tuple, int] = {}
    repeats = set()
    if len(set(windows)) == len(windows):
        return 0
    for i, x in enumerate(windows):
        j = first.setdefault(x, i)
        if j != i:
            repeats.add(j)
            repeats.add(i)
    count, end = 0, 0
    for i in sorted(repeats):
        count += i + 3 - max(i, end)
        end = i + 3
    return count


STATISTICS: dict[str, Callable[[Text], int]] = {
    "n_words": lambda t: len(t.words),
    "word_chars": _word_chars,
    "n_symbols": _n_symbols,
    "n_lines": lambda t: len(_lines(t)),
    "n_dup_lines": _n_dup_lines,
    "n_repeat_words": _n_repeat_words,
}


@dataclass(frozen=True)
class Rule:
    """Rejects a text if `test` holds; `sql` says the same over the columns of STATISTICS."""

    name: str
    test: Callable[[Text], bool]
    sql: str


RULES = (
    Rule("few_words", lambda t: t.get("n_words") < 50, "n_words < 50"),
    Rule("repeated_words", lambda t: 100 * t.get("n_repeat_words") > 50 * t.get("n_words"), "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", lambda t: 100 * t.get("n_symbols") > 10 * t.get("n_words"), "100 * n_symbols > 10 * n_words"),
    Rule("repeated_lines", lambda t: 100 * t.get("n_dup_lines") > 30 * t.get("n_lines"), "100 * n_dup_lines > 30 * n_lines"),
    Rule("long_words", lambda t: t.get("word_chars") > 40 * t.get("n_words"), "word_chars > 40 * n_words"),
)
BASE = ("few_words", "repeated_words")


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], list[dict]]:
    """(rule names in running order, estimates) from at most `sample_rows` texts.

    The sample are rows spread over the table by a hash of doc_id. On an
    empty table the given order stays. The estimates hold seconds a text, share rejected and
    the ratio that decides; ties keep the given order.
    """
    total = docs.count()
    if not total:
        return [r.name for r in rules], []
    share = min(1.0, 2.0 * sample_rows / total)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = own_columns(docs, ("doc_id", "text")).where(draw).select("text").limit(sample_rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spent, hits, seen = [0.0] * len(rules), [0] * len(rules), 0
        for batch in slices(batches):
            for text in texts(batch):
                seen += 1
                for k, rule in enumerate(rules):
                    t = Text(text)  # nothing shared: the cost of the rule alone
                    began = time.perf_counter()
                    hits[k] += rule.test(t)
                    spent[k] += time.perf_counter() - began
        columns = [pa.array(x) for x in (list(range(len(rules))), spent, hits, [seen] * len(rules))]
        yield pa.RecordBatch.from_arrays(columns, names=["k", "spent", "hits", "seen"])

    rows = (
        sample.mapInArrow(measure, "k long, spent double, hits long, seen long")
        .groupBy("k")
        .agg(F.sum("spent").alias("spent"), F.sum("hits").alias("hits"), F.sum("seen").alias("seen"))
        .collect()
    )
    found = []
    for r in rows:
        n = max(1, r["seen"])
        cost, rejected = r["spent"] / n, r["hits"] / n
        found.append({"rule": rules[r["k"]].name, "k": r["k"], "cost": cost, "rejected": rejected, "ratio": rejected / max(cost, 1e-9)})
    found.sort(key=lambda x: (-x["ratio"], x["k"]))
    return [x["rule"] for x in found], found


def judge(t: Text, rules: list[Rule]) -> tuple[str | None, int]:
    """(first rejecting rule or None, rules tried)."""
    for k, rule in enumerate(rules):
        if rule.test(t):
            return rule.name, k + 1
    return None, len(rules)


def cascade(
    docs: DataFrame, running: list[str] | None = None, rules: tuple[Rule, ...] = RULES, statistics: tuple[str, ...] = ()
) -> DataFrame:
    """(doc_id, kept, rejected_by, n_tried) and the asked `statistics`, one row for each input row.

    Without `running` the order is estimated first. rejected_by is null for kept texts and, since it
    depends on the order, may differ between runs; kept does not. Null and empty texts
    have no words. Statistics that the cascade did not need are computed only if asked for.
    """
    running = running if running is not None else order(docs, rules)[0]
    by_name = {r.name: r for r in rules}
    ordered = [by_name[x] for x in running]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[list] = [[] for _ in range(3 + len(statistics))]
            for text in texts(batch):
                t = Text(text)
                by, tried = judge(t, ordered)
                for column, value in zip(out, (by is None, by, tried, *map(t.get, statistics))):
                    column.append(value)
            kinds = [pa.bool_(), pa.string(), pa.int32()] + [pa.int64()] * len(statistics)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")] + [pa.array(c, k) for c, k in zip(out, kinds)],
                names=["doc_id", "kept", "rejected_by", "n_tried", *statistics],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, kept boolean, rejected_by string, n_tried int" + "".join(f", {s} long" for s in statistics)
    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, schema)
