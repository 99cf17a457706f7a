"""Units of text that no token of a vocabulary spans, and the ids of units by a byte-level vocabulary.

A unit is white space with the run of other characters after it. Byte-level pre-tokens never hold a
character of a word followed by white space, so a text's ids are those of its units one after the other, and
each unit met before costs one look-up.
"""

from __future__ import annotations

import os
import re

_PLAIN = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
#: Any other white space (fixed value: what \s matches beyond space and line feed).
_OTHER_SPACE = re.compile(r"[^\S \n]")
_BORDER = re.compile(r"(?<=\S)(?=[ \n])")
#: Most units kept by a worker, and the longest that is kept.
KEPT_UNITS, KEPT_CHARACTERS = 600_000, 64


def units(text: str) -> list[str]:
    """`text` cut before each space or line feed that follows something else than white space."""
    if not text:
        return []
    return _BORDER.split(text) if _OTHER_SPACE.search(text) else _PLAIN.findall(text)


class Kept(dict):
    """A dictionary for what units are made of: long keys aren't kept, and when it is full, later ones aren't
    either, since the common ones come first. It starts anew when very many were turned away."""

    def __init__(self):
        super().__init__()
        self.turned_away = 0

    def keep(self, key: str, value) -> None:
        if len(key) > KEPT_CHARACTERS:
            return
        if len(self) < KEPT_UNITS:
            self[key] = value
            return
        self.turned_away += 1
        if self.turned_away > 10 * KEPT_UNITS:
            self.clear()
            self.turned_away = 0


class ByteVocabulary:
    """Ids of units by a byte-level BPE file of `tokenizers`, without special tokens added.

    `special_as_text`: the strings of special tokens inside a text are plain text.
    """

    def __init__(self, path: str, special_as_text: bool):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = special_as_text
        self._batch = getattr(self.model, "encode_batch_fast", self.model.encode_batch)
        self.special = {t.content for t in self.model.get_added_tokens_decoder().values()}

    def encode(self, some: list[str]) -> list[list[int]]:
        """Ids of each of `some` units or texts."""
        return [e.ids for e in self._batch(some, add_special_tokens=False)] if some else []

    def entry_bytes(self) -> dict[int, bytes]:
        """The bytes each id stands for; special entries stand for their own string."""
        letters = byte_letters()
        return {
            i: w.encode() if w in self.special else bytes(letters[c] for c in w) for w, i in self.model.get_vocab(with_added_tokens=True).items()
        }


def byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write bytes with: printable Latin-1 bytes stand for
    themselves, the others for the letters from U+0100 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}

