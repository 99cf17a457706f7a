"""Operator 7: token counts by a linear longest-match automaton.

Greedy word pieces (the longest known piece, again and again) are counted without being built.
A trie of the vocabulary has, at each node, the node reached after the longest matches are taken
off (failure link) and how many pieces that took off (popped count), so one pass
over a word's characters gives the number of pieces (Song et al., 2021).

The vocabulary is that of a public sentence-piece model: a piece that begins with the mark U+2581
starts a word, any other continues one. A word with a part that no piece covers is one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.common import own_columns, slices, texts

#: Fixed value: the mark of word starts in sentence-piece vocabularies.
WORD_START = "▁"
FAIL = -1
#: Most words whose counts a worker keeps; beyond it the memory starts anew.
KEPT_WORDS = 400_000

_AUTOMATA: dict[str, "Automaton"] = {}


class Automaton:
    """Counts pieces of words over `initial` and `continuing` pieces (plain strings)."""

    ROOT, INNER = 0, 1

    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = {}
        for start, pieces in ((self.ROOT, initial), (self.INNER, continuing)):
            for piece in pieces:
                node = start
                for ch in piece:
                    node = self.next[node].setdefault(ch, len(self.next))
                    if node == len(self.next):
                        self.next.append({})
                if node != start:
                    ends[node] = True
        self.fail = [FAIL] * len(self.next)
        self.popped = [0] * len(self.next)
        self._link(ends)
        self.seen: dict[str, int] = {}

    def _link(self, ends: dict[int, bool]) -> None:
        queue = [self.ROOT, self.INNER]
        for node in queue:  # grows while it is read: breadth first
            for ch, child in self.next[node].items():
                queue.append(child)
                if child in ends:  # the whole string is one piece
                    self.fail[child], self.popped[child] = self.INNER, 1
                    continue
                at, popped = self.fail[node], self.popped[node]
                while at != FAIL and ch not in self.next[at]:
                    popped += self.popped[at]
                    at = self.fail[at]
                if at != FAIL:
                    self.fail[child], self.popped[child] = self.next[at][ch], popped

    def count(self, word: str) -> int:
        """Pieces of the word, or 0 if it is unknown."""
        node, popped = self.ROOT, 0
        for ch in word:
            while ch not in self.next[node]:
                popped += self.popped[node]
                node = self.fail[node]
                if node == FAIL:
                    return 0
            node = self.next[node][ch]
        while node not in (self.ROOT, self.INNER):
            popped += self.popped[node]
            node = self.fail[node]
            if node == FAIL:
                return 0
        return popped

    def counts(self, words: list[str]) -> list[int]:
        seen = self.seen
        out = []
        for word in words:
            n = seen.get(word)
            if n is None:
                if len(seen) >= KEPT_WORDS:
                    seen.clear()
                n = self.count(word)
                if len(word) <= 64:
                    seen[word] = n
            out.append(n)
        return out


def pieces_of(path: str) -> tuple[list[str], list[str]]:
    """(initial, continuing) pieces of a sentence-piece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    ]
    initial = [p[len(WORD_START) :] for p in pieces if p.startswith(WORD_START) and len(p) > len(WORD_START)]
    return initial, [p for p in pieces if WORD_START not in p]


def automaton(path: str) -> Automaton:
    """The automaton of a vocabulary file, built once in each worker."""
    if path not in _AUTOMATA:
        _AUTOMATA.clear()
        _AUTOMATA[path] = Automaton(*pieces_of(path))
    return _AUTOMATA[path]


def words_of(text: str | None) -> list[str]:
    """Runs without ASCII white space; bytes.split() knows no other kind."""
    if not text:
        return []
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()] if not text.isascii() else _ascii(text)


def _ascii(text: str) -> list[str]:
    # str.split() would also cut at the four separators U+001C..U+001F
    if any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return [w.decode() for w in text.encode().split()]
    return text.split()


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_unknown, n_tokens), one row for each input row.

    n_tokens counts an unknown word as one token. Null and empty texts have none. Every word of the
    whole text counts, of any length. Only doc_id and text are read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = automaton(vocabulary)
        for batch in slices(batches):
            rows = [counter.counts(words_of(t)) for t in texts(batch)]
            unknown = [c.count(0) for c in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(map(len, rows), pa.int64()), pa.array(unknown, pa.int64())]
                + [pa.array([sum(c) + u for c, u in zip(rows, unknown)], pa.int64())],
                names=["doc_id", "n_words", "n_unknown", "n_tokens"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return own_columns(docs, ("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_unknown long, n_tokens long")
