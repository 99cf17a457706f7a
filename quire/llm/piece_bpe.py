"""Operator 11: exact merge-type encoding by backtracking, and decoding, of sentence-piece BPE vocabularies.

Merging adjacent pieces by score until nothing merges gives one sequence, and a sequence is that one exactly
if each two adjacent tokens stay apart when their joined text is merged again. So the encoder needs no merge queue
over the text: it takes the longest piece at each place (Aho-Corasick over reversed pieces and reversed text, one
pass), checks that piece against the token before it by re-merging the two, tries shorter pieces, and steps back where none
fits. A bit for each place remembers that no sequence goes on from there, so no place is given up twice and the work is linear.

Text has a space before it, spaces are U+2581, and a character in no piece becomes its UTF-8 bytes' pieces. No
piece spans a U+2581 after another character, so texts are cut there and parts met before are looked up.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import own_columns, slices, texts
from quire.llm.token_units import Kept

#: The mark of a space, what an unknown id decodes to, and what a stray byte decodes to.
SPACE, UNKNOWN_TEXT, STRAY = "▁", " ⁇ ", "�"
#: In place of a token: a character in no piece, and nothing.
FOREIGN, NONE = -1, -2
#: Most token pairs whose check a worker keeps.
KEPT_PAIRS = 500_000

_MODELS: dict[str, "PieceModel"] = {}


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.id: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte = [0] * 256
        self.text: list[str | int | None] = []  # a piece, a byte's value, or nothing
        found = ahocorasick.Automaton()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.text.append(int(piece[3:5], 16))
            elif model.is_control(i):
                self.text.append(None)
            elif model.is_unknown(i):
                self.text.append(UNKNOWN_TEXT)
            else:
                self.id[piece], self.score[piece] = i, model.get_score(i)
                self.text.append(piece)
                found.add_word(piece[::-1], i)
        found.make_automaton()
        self.found = found
        self.pieces = [t if isinstance(t, str) else "" for t in self.text]
        self.size = list(map(len, self.pieces))
        self.shorter: list[int | None] = [None] * len(self.pieces)
        known = set(chain.from_iterable(self.id))
        #: Pieces hold U+2581 only in front, so texts can be cut there; a line feed in no piece is a cut as well.
        alone = "" if "\n" in known else r"\n"
        cut = not any(SPACE in p.lstrip(SPACE) for p in self.id)
        self.parts = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|{alone or '(?!)'}" if cut else r"(?s).+")
        self.kept = Kept()
        self.pairs: list[dict[int, bool]] = [{} for _ in range(len(self.pieces) + 1)]  # by the left token; the last for none
        self.checked = 0
        self.spell = [t.replace(SPACE, " ").encode() if isinstance(t, str) else bytes([t]) if isinstance(t, int) else b"" for t in self.text]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best score first, of equal ones the leftmost."""
        pieces, score, none = list(text), self.score.get, -inf
        ranks = [score(x + y, none) for x, y in zip(pieces, pieces[1:])]
        while ranks and (best := max(ranks)) > none:
            k = ranks.index(best)
            pieces[k : k + 2] = [pieces[k] + pieces[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = score(pieces[k - 1] + pieces[k], none)
            if k < len(ranks):
                ranks[k] = score(pieces[k] + pieces[k + 1], none)
        return pieces

    def apart(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are when their text is merged again; `left` may be NONE."""
        self.checked += 1
        if self.checked % KEPT_PAIRS == 0:
            for known in self.pairs:
                known.clear()
        both = [self.pieces[left], self.pieces[right]] if left != NONE else [self.pieces[right]]
        stays = self.pairs[max(left, -1)][right] = self.merged("".join(both)) == both
        return stays

    def next_shorter(self, token: int) -> int:
        """The longest piece that is a proper prefix of the token; FOREIGN if that is a character in no piece, NONE for single characters."""
        if token == FOREIGN:
            return NONE
        if self.shorter[token] is None:
            piece = self.pieces[token]
            found = (self.id[piece[:k]] for k in range(len(piece) - 1, 0, -1) if piece[:k] in self.id)
            self.shorter[token] = next(found, FOREIGN if len(piece) > 1 else NONE)
        return self.shorter[token]

    def tokens(self, part: str) -> list[int]:
        """Pieces of a part that starts and ends where tokens do; FOREIGN for characters in no piece."""
        n = len(part)
        found = list(self.found.iter(part[::-1]))
        found.reverse()  # the longest piece of each place comes first, so the last one written here
        longest = dict(found)
        failed = None  # a bit for each place, once one failed
        pairs, shorter, sizes = self.pairs, self.shorter, self.size
        out: list[int] = []
        at, token, last = 0, longest.get(n - 1, FOREIGN), NONE
        known = pairs[-1]
        while at < n:
            while token >= 0:
                end = at + sizes[token]
                if failed is None or not failed[end >> 3] >> (end & 7) & 1:
                    stays = known.get(token)
                    if self.apart(last, token) if stays is None else stays:
                        break
                less = shorter[token]
                token = self.next_shorter(token) if less is None else less
            if token == FOREIGN:  # nothing merges with it
                end = at + 1
                if failed is not None and failed[end >> 3] >> (end & 7) & 1:
                    token = NONE
            if token != NONE:
                out.append(token)
                at, last = end, token if token >= 0 else NONE
                token = longest.get(n - 1 - at, FOREIGN) if at < n else NONE
            else:  # nothing fits after `last`: back to where it began, with something shorter
                failed = failed or bytearray(n // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                gone = out.pop()
                at -= sizes[gone] if gone >= 0 else 1
                token = self.next_shorter(gone)
                last = out[-1] if out and out[-1] >= 0 else NONE
            known = pairs[max(last, -1)]
        return out

    def part_ids(self, part: str) -> bytes:
        """Ids of a part as 32-bit numbers."""
        ids = self.tokens(part)
        if FOREIGN in ids:
            at, whole = 0, []
            for i in ids:
                whole += [i] if i >= 0 else map(self.byte.__getitem__, part[at].encode("utf-8", "surrogatepass"))
                at += self.size[i] if i >= 0 else 1
            ids = whole
        made = array("i", ids).tobytes()
        self.kept.keep(part, made)
        return made

    def packed(self, text: str | None) -> bytes:
        """Ids of a whole text as 32-bit numbers; null and empty texts have none."""
        if not text:
            return b""
        parts = self.parts.findall(SPACE + text.replace(" ", SPACE))
        found = list(map(self.kept.get, parts))
        if None in found:
            found = [self.kept.get(p) or self.part_ids(p) if ids is None else ids for p, ids in zip(parts, found)]
        return b"".join(found)

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids: list[int] | None) -> str:
        """Text of ids: U+2581 is a space, the space before the text goes, bytes that are no UTF-8 are U+FFFD each."""
        spell = self.spell
        first = next((i for i in ids or () if self.text[i] is not None), None)
        if first is None:
            return ""
        data = b"".join([spell[i] for i in ids])
        lead = isinstance(self.text[first], str) and self.text[first].startswith(SPACE)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = _stray(data)
        return text[1:] if lead else text


def _stray(data: bytes) -> str:
    """UTF-8 with each byte that can't be read as U+FFFD."""
    return "".join(STRAY if 0xDC80 <= ord(c) <= 0xDCFF else c for c in data.decode("utf-8", "surrogateescape"))


def model(path: str) -> PieceModel:
    """The model of a vocabulary file, built once in each worker."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def lists(rows: list[list[int]], kind: pa.DataType) -> pa.ListArray:
    """A column of lists of numbers."""
    ends = np.fromiter(accumulate(map(len, rows), initial=0), np.int32, len(rows) + 1)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(rows), np.int64, ends[-1])).cast(kind))


def _encoded(docs: DataFrame, vocabulary: str, decoded: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(vocabulary)
        for batch in slices(batches):
            rows = [coder.packed(t) for t in texts(batch)]
            ends = np.cumsum([0, *map(len, rows)]) // 4
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(rows), np.int32)))
            columns = {"doc_id": batch.column("doc_id"), "ids": ids}
            if decoded:
                columns["text"] = pa.array([coder.decode(np.frombuffer(r, np.int32).tolist()) for r in rows], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, ids array<int>{', text string' if decoded else ''}")


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids array<int>), one row for each row of `docs`; only doc_id and text are read.

    Null and empty texts give an empty array; repeated and null ids are kept as they are; an
    empty table gives an empty one. Texts of any length are encoded whole.
    """
    return _encoded(docs, vocabulary, False)


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text): `decode(encode(docs))` in one pass; `text` is what the ids decode to."""
    return _encoded(docs, vocabulary, True)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids, text) for rows (doc_id, ids array<int>); null and empty arrays give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(vocabulary)
        for batch in slices(batches):
            ids = batch.column("ids")
            rows = [coder.decode(i) for i in ids.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(rows, pa.string())], names=["doc_id", "ids", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return own_columns(encoded, ("doc_id", "ids")).mapInArrow(run, f"doc_id {kind}, ids array<int>, text string")
