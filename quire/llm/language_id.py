"""Operator 1: language identification by compression.

A bounded sample of labelled texts gives each language a raw-content zstandard dictionary.
A text loses its ASCII marks, digits and capitals, which no language owns, and is cut into pieces
of `PIECE` bytes; every piece (so the whole text) is compressed once with each dictionary, and the language with the smallest total wins. A win by less than
`MARGIN` of the winner's size is marked as rejected.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import own_columns, slices, texts

UNKNOWN = "und"
#: Bound of the training sample: texts for each language and bytes taken of each.
SAMPLE_TEXTS, SAMPLE_CHARS = 384, 400
PIECE = 1024
LEVEL = 9
MARGIN = 0.01
#: Bytes of difference that make a score e times as certain.
SCALE = 4.0

#: Bytes that become spaces: all ASCII but letters.
_BLANKED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))

_COMPRESSORS: dict[str, list[tuple[str, zstandard.ZstdCompressor]]] = {}


def fit(labelled: DataFrame, texts_each: int = SAMPLE_TEXTS, chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries {language: content} from rows (doc_id, text, lang).

    The sample is bounded: about `texts_each` texts a language, chosen by a hash of id and text, and
    at most `chars` characters of each. Rows without text or language are not used; no
    usable row gives an empty model. The collected rows never exceed 4 * texts_each * languages.
    """
    rows = own_columns(labelled, ("doc_id", "text", "lang")).where("text is not null and lang is not null")
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not counts:
        return {}
    chance = F.xxhash64("doc_id", "text")
    draw = F.pmod(chance, F.lit(1 << 30)) / float(1 << 30)
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 1.5 * texts_each / n))])
    sample = (
        rows.where(draw < share[F.col("lang")])
        .select("lang", chance.alias("h"), F.substring("text", 1, chars).alias("piece"))
        .limit(4 * texts_each * len(counts))
        .collect()
    )
    model: dict[str, bytes] = {}
    for lang in sorted(counts):
        own = sorted((r["h"], r["piece"]) for r in sample if r["lang"] == lang)[:texts_each]
        content = plain("\n".join(p for _, p in own))
        if content:
            model[lang] = content
    return model


def plain(text: str) -> bytes:
    """UTF-8 with ASCII letters in lower case and single spaces for all other ASCII."""
    return b" ".join(text.encode("utf-8", "surrogatepass").translate(_BLANKED).lower().split())


def _compressors(model: dict[str, bytes]) -> list[tuple[str, zstandard.ZstdCompressor]]:
    key = hashlib.sha1(repr(sorted((k, hashlib.sha1(v).hexdigest()) for k, v in model.items())).encode()).hexdigest()
    if key not in _COMPRESSORS:
        made = []
        for lang, content in sorted(model.items()):
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            made.append((lang, zstandard.ZstdCompressor(dict_data=d, write_content_size=False, write_checksum=False)))
        _COMPRESSORS.clear()
        _COMPRESSORS[key] = made
    return _COMPRESSORS[key]


def classify(text: str | None, compressors: list) -> tuple[str, float, float, bool]:
    """(language, score, margin, rejected) of one whole text."""
    if text is None or not compressors or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, True
    data = plain(text)
    pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
    sizes = [(sum(len(c.compress(p)) for p in pieces), lang) for lang, c in compressors]
    sizes.sort()
    best, lang = sizes[0]
    weight = sum(math.exp(max(-700.0, (best - s) / SCALE)) for s, _ in sizes)
    margin = (sizes[1][0] - best) / best if len(sizes) > 1 else 1.0
    return lang, 1.0 / weight, margin, margin < MARGIN


def predict(docs: DataFrame, model: dict[str, bytes]) -> DataFrame:
    """(doc_id, lang_pred, score, margin, rejected), one row for each input row.

    Null texts and texts without a letter give `und`, score 0 and rejected. Ties go to the
    language first in alphabetical order. Only `doc_id` and `text` are read. The
    dictionaries (at most texts_each * chars * languages characters) travel with the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressors = _compressors(model)
        for batch in slices(batches):
            found = [classify(t, compressors) for t in texts(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id")]
                + [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.float64(), pa.bool_()))],
                names=["doc_id", "lang_pred", "score", "margin", "rejected"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, ("doc_id", "text")).mapInArrow(
        run, f"doc_id {kind}, lang_pred string, score double, margin double, rejected boolean"
    )
