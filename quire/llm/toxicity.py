"""Operator 9: toxicity by gradient-boosted trees over dense features, calibrated isotonically.

A lexicon of words and word beginnings is learned from a bounded sample of labelled texts. Each
whole text then becomes a dozen numbers: lexicon densities, how near lexicon words stand to the
second person, capitals, punctuation, obfuscation and repetition. Spark ML fits the trees on one
part of the sample and the isotonic curve on the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import own_columns, slices, texts, written

#: Bound of the training sample: texts of each label.
SAMPLE_EACH = 4000
#: Lexicon: most entries, least weight (toxic texts times log ratio of shares), least ratio, prefix lengths.
ENTRIES, WEIGHT, RATIO = 600, 12.0, 4.0
PREFIXES = range(2, 8)
#: Fixed word list: the second person in the four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself du dich dir dein deine deinen deiner tu te toi ton ta tes vous votre vos usted tú ti tuyo tus su".split()
)
#: Fixed characters: cut from the ends of a word; those that hide letters; their plain letters.
EDGES = ".,;:!?\"'()[]{}|&%$#*<>~`"
HIDING = frozenset("@0134578$*!")
PLAIN = str.maketrans("@0134578$!", "aoieastbsi")
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NEAR = 5

FEATURES = (
    "log_words", "word_share", "prefix_share", "log_word_hits", "log_prefix_hits", "log_kinds", "weight_share",
    "near_person", "person_share", "capitals", "shouted", "marks", "exclaimed", "hidden", "hidden_hits", "repeated",
)


@dataclass
class Model:
    lexicon: dict[str, float]
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    base: float


def _word(raw: str) -> str:
    return raw.strip(EDGES).lower()


def _entries(text: str | None) -> set[str]:
    """Words, and beginnings of words marked with a dash, that could be lexicon entries."""
    found = set()
    for w in {_word(x) for x in (text or "").split()}:
        if w:
            found.add(w)
            found.update([w[:n] + "-" for n in PREFIXES if n < len(w)])
    return found


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """{entry: weight} from rows (text, toxic): entries far commoner in toxic texts.

    At most ENTRIES entries, the weightiest first; ties go by support and spelling. No toxic or
    no other text gives an empty lexicon.
    """
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            found, marks = [], []
            for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
                own = _entries(text)
                found += own
                marks += [toxic] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int32())], names=["entry", "toxic"])

    counts = (
        sample.select("text", "toxic").mapInArrow(run, "entry string, toxic int").groupBy("entry")
        .agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("f"))
    )
    ratio = (F.col("t") / bad) / ((F.col("f") + 0.5) / good)
    weight = F.col("t") * F.log("r")
    rows = counts.where("t > 1").select("entry", "t", ratio.alias("r")).where((F.col("r") >= RATIO) & (weight >= WEIGHT))
    best = rows.orderBy(F.desc(weight), "entry").limit(ENTRIES).collect()
    return {r["entry"]: math.log(r["r"]) for r in best}


class Reader(dict):
    """What is notable about a word as it stands in a text: None for most, else
    (hit, value, odd, uncovered, person, shouted, word). Frequent words are looked up once."""

    #: Most words kept.
    KEPT = 300_000

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.longest = max((len(e) for e in lexicon if e.endswith("-")), default=1) - 1

    def __missing__(self, raw: str) -> tuple | None:
        w = _word(raw)
        hit, value = 1, self.lexicon.get(w, 0.0)
        if not value:
            hit = 0
            for m in range(min(self.longest, len(w) - 1), 1, -1):
                value = self.lexicon.get(w[:m] + "-", 0.0)
                if value:
                    hit = 2
                    break
        odd = not raw.isalpha() and not HIDING.isdisjoint(raw[1:-1]) and any(map(str.isalpha, raw))
        uncovered = odd and not hit and _word(raw.translate(PLAIN)) in self.lexicon
        person, shouted = w in SECOND_PERSON, len(raw) > 2 and raw.isupper()
        found = (hit, value, odd, uncovered, person, shouted, w) if hit or odd or person or shouted else None
        if len(self) >= self.KEPT:
            self.clear()
        self[raw] = found
        return found


def features(text: str | None, reader: Reader) -> list[float]:
    """The numbers named by FEATURES of one whole text; a null text counts as empty."""
    text = text or ""
    raw = text.split()
    n = len(raw)
    if not n:
        return [0.0] * len(FEATURES)
    word_hits = prefix_hits = hidden = hidden_hits = shouts = 0
    weight, kinds, hit_at, person_at = 0.0, set(), [], []
    for i, seen in enumerate(map(reader.__getitem__, raw)):
        if seen is None:
            continue
        hit, value, odd, uncovered, person, shouted, w = seen
        if hit:
            word_hits += hit == 1
            prefix_hits += hit == 2
            weight += value
            kinds.add(w)
            hit_at.append(i)
        hidden += odd
        hidden_hits += uncovered
        shouts += shouted
        if person:
            person_at.append(i)
    near, j = 0, 0
    for i in hit_at:
        while j < len(person_at) and person_at[j] < i - NEAR:
            j += 1
        near += j < len(person_at) and person_at[j] <= i + NEAR
    letters = sum(map(len, raw))
    data = text.encode("utf-8", "surrogatepass")
    capitals = len(data) - len(data.translate(None, CAPITALS))
    marks = len(data) - len(data.translate(None, EDGES.encode()))
    return [
        math.log1p(n), word_hits / n, prefix_hits / n, math.log1p(word_hits), math.log1p(prefix_hits), math.log1p(len(kinds)),
        weight / n, near / n, len(person_at) / n, capitals / letters, shouts / n, marks / letters,
        (text.count("!") + text.count("?")) / n, hidden / n, hidden_hits / n, 1 - len(set(raw)) / n,
    ]


def featured(docs: DataFrame, lexicon: dict[str, float], keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns and one double for each of FEATURES; one row for each input row."""
    kept = own_columns(docs, tuple(dict.fromkeys((*keep, text))))
    schema = ", ".join(f"`{k}` {kept.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(lexicon)
        for batch in slices(batches):
            rows = [features(t, reader) for t in texts(batch, text)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(k) for k in keep] + [pa.array([r[i] for r in rows], pa.float64()) for i in range(len(FEATURES))],
                names=[*keep, *FEATURES],
            )

    return kept.mapInArrow(run, schema + "".join(f", {f} double" for f in FEATURES))


def _assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(df)


def labelled_sample(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH) -> DataFrame:
    """(doc_id, text, toxic): at most `each` texts of a label, those with the smallest hash of doc_id.

    Labels other than 0 and 1 are left out; a doc_id labelled twice keeps its larger label.
    The ids, at most 2 * each, are broadcast; texts with a null are left out.
    """
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    order = (F.xxhash64("doc_id"), "doc_id")
    chosen = marks.where("toxic = 1").orderBy(*order).limit(each).union(marks.where("toxic = 0").orderBy(*order).limit(each))
    ids = docs.sparkSession.createDataFrame(chosen.collect(), chosen.schema)
    rows = own_columns(docs, ("doc_id", "text")).where("text is not null").join(F.broadcast(ids), "doc_id")
    # a bound against rows that repeat an id; dealt out again since a limit leaves one partition
    return rows.select("doc_id", "text", "toxic").limit(4 * each).repartition(16)


def fit(docs: DataFrame, labels: DataFrame, each: int = SAMPLE_EACH, trees: int = 20, depth: int = 3) -> Model:
    """Learns from the sample alone; with one label only, every score is that label's share.

    Each half of the sample gets features by the lexicon of the other half, so that words seen by chance
    don't pass for evidence; the model keeps the lexicon of the whole sample.
    """
    sample = written(labelled_sample(docs, labels, each), "toxic-sample")
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(10))
    totals = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    base = totals.get(1, 0) / max(1, sum(totals.values()))
    if len(totals) < 2:
        return Model({}, None, None, base)
    halves = [sample.where(part % 2 == k) for k in (0, 1)]
    crossed = [featured(half, learn_lexicon(other), ("doc_id", "toxic")) for half, other in (halves, halves[::-1])]
    made = written(_assembled(crossed[0].union(crossed[1])).select("doc_id", "toxic", "features"), "toxic-features")
    # trees on eight tenths, the curve on the rest
    learn = made.where(part < 8)
    if learn.select("toxic").distinct().count() < 2 or made.where(part >= 8).limit(1).count() == 0:
        learn = made
    model = GBTClassifier(labelCol="toxic", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=7, maxBins=64).fit(learn)
    rest = made.where(part >= 8) if learn is not made else made
    raw = _scored(rest, model).select("toxic", "p")
    # weights undo the even mix of labels in the sample
    rate = labels.where("toxic in (0, 1)").agg(F.avg("toxic")).first()[0]
    share = {1: rate / max(base, 1e-9), 0: (1 - rate) / max(1 - base, 1e-9)}
    weighted = raw.withColumn("weight", F.when(F.col("toxic") == 1, share[1]).otherwise(share[0])).withColumn("label", F.col("toxic").cast("double"))
    curve = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight").fit(weighted)
    return Model(learn_lexicon(sample), model, curve, rate)


def _scored(made: DataFrame, model: GBTClassificationModel) -> DataFrame:
    return model.transform(made).withColumn("p", vector_to_array("probability")[1])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score): probability of label 1, one row for each input row.

    Empty and null texts get the score of a text without words. The isotonic curve is flat in
    places; a hundredth of the trees' own probability keeps the order of texts inside a flat part.
    """
    if model.trees is None or model.curve is None:
        return docs.select("doc_id", F.lit(float(model.base)).alias("score"))
    made = _scored(_assembled(featured(docs, model.lexicon)), model.trees)
    calibrated = model.curve.transform(made.select("doc_id", "p"))
    return calibrated.select("doc_id", (0.99 * F.col("prediction") + 0.01 * F.col("p")).alias("score"))


def clean(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of `docs`, all columns, whose score is below `threshold`."""
    if model.trees is None or model.curve is None:
        return docs.where(F.lit(model.base < threshold))
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # no clash with features or model columns
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    made = _scored(_assembled(featured(kept, model.lexicon, tuple(names.values()), names["text"])), model.trees)
    rated = model.curve.transform(made.select(*names.values(), "p"))
    stays = rated.where(0.99 * F.col("prediction") + 0.01 * F.col("p") < threshold)
    return stays.select(*[F.col(n).alias(c) for c, n in names.items()])
