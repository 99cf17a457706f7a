"""Where style fragments stand in the blocks of their page."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import DataFrame

#: Letters that a fragment must have to be placed without its context, and to be placed with errors.
LOOSE, FUZZY = 4, 8
#: Share of a fragment's letters that may differ, and letters at its start that may not.
ERRORS, ANCHOR = 0.12, 5


def folded(text: str) -> str:
    """Lower case without accents, character for character."""
    return "".join((unicodedata.normalize("NFD", c)[0].lower() or c)[0] for c in text)


def letters(text: str) -> int:
    return sum(map(str.isalnum, text))


def whole_words(text: str, needle: str) -> list[int]:
    """Places where `needle` stands and no word goes on beyond either end."""
    if not needle:
        return []
    found = [m.start() for m in re.finditer(f"(?={re.escape(needle)})", text)]
    return [
        i for i in found
        if not (needle[0].isalnum() and i and text[i - 1].isalnum())
        and not (needle[-1].isalnum() and i + len(needle) < len(text) and text[i + len(needle)].isalnum())
    ]


def behind(text: str, lead: list[str], needle: str) -> list[int]:
    """Places where `needle` stands whole behind the words of `lead`, whatever white space is between them."""
    pattern = r"\s+".join(map(re.escape, [*lead, ""]))
    found = [(m.start(), m.end(1)) for m in re.finditer(f"(?=({pattern}){re.escape(needle)})", text)]
    return [
        at for i, at in found
        if not (lead[0][0].isalnum() and i and text[i - 1].isalnum())
        and not (needle and needle[-1].isalnum() and at + len(needle) < len(text) and text[at + len(needle)].isalnum())
    ]


def edits(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or most + 1 if it is larger."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


class Page:
    """The blocks of one page and the places already taken."""

    def __init__(self, blocks: list[tuple[int, str]]):
        self.blocks = [(k, t, folded(t)) for k, t in blocks]
        self.taken: list[tuple[int, int, int]] = []

    def take(self, block: int, start: int, length: int, how: str) -> tuple | None:
        if any(b == block and start < e and s < start + length for b, s, e in self.taken):
            return None
        self.taken.append((block, start, start + length))
        return block, start, length, how

    def in_context(self, text: str, before: str) -> tuple | None:
        """Behind the longest ending of `before`, from whole to its last word, that has LOOSE letters."""
        words = before.split()
        for k in range(len(words)):
            if letters(" ".join(words[k:])) < LOOSE:
                return None
            for block, body, _ in self.blocks:
                for i in behind(body, words[k:], text):
                    if found := self.take(block, i, len(text), "context"):
                        return found
        return None

    def alone(self, text: str) -> tuple | None:
        """The one place on the page, accents aside; the first free one if it has LOOSE letters; else one
        with few errors that begins alike, if that is the only one."""
        needle = folded(text)
        spots = [(b, i) for b, _, body in self.blocks for i in whole_words(body, needle)]
        if len(spots) == 1 or letters(text) >= LOOSE:
            for b, i in spots:
                if found := self.take(b, i, len(text), "alone" if len(spots) == 1 else "first"):
                    return found
        if spots or letters(text) < FUZZY:
            return None
        most, n = int(ERRORS * letters(text)), len(needle.split())
        near = []
        for b, _, body in self.blocks:
            at = [m.span() for m in re.finditer(r"\S+", body)]
            for i in range(len(at) - n + 1):
                s, e = at[i][0], at[i + n - 1][1]
                if body[s : s + ANCHOR] == needle[:ANCHOR] and edits(body[s:e], needle, most) <= most:
                    near.append((b, s, e - s))
        return self.take(*near[0], "near") if len(near) == 1 else None


def place_fragments(blocks: DataFrame, fragments: DataFrame, page: str) -> DataFrame:
    """(page, fragment, block, start, length, how): each fragment's place, null where it has none.

    blocks has (page, block, text), fragments (page, fragment, text, before); both are gone through in order,
    first all fragments by their context, then the rest by themselves, and a place is taken once. This
    greed is sequential, so a page, which is small, is one group; pages are spread over the cluster.
    """

    def place(own: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if asked.empty:
            return pd.DataFrame(columns=[page, "fragment", "block", "start", "length", "how"], index=[])
        sheet = Page([(b, t or "") for b, t in own.sort_values("block")[["block", "text"]].itertuples(index=False)])
        todo = [(f, t or "", c or "") for f, t, c in asked.sort_values("fragment")[["fragment", "text", "before"]].itertuples(index=False)]
        done = {f: sheet.in_context(t, c) for f, t, c in todo}
        for f, t, _ in todo:
            done[f] = done[f] or sheet.alone(t)
        rows = [(asked[page].iloc[0], f, *(done[f] or (None,) * 4)) for f, _, _ in todo]
        out = pd.DataFrame(rows, columns=[page, "fragment", "block", "start", "length", "how"])
        return out.astype({"block": "Int64", "start": "Int64", "length": "Int64"})

    kind = blocks.schema[page].dataType.simpleString()
    schema = f"{page} {kind}, fragment int, block int, start int, length int, how string"
    return blocks.select(page, "block", "text").groupBy(page).cogroup(fragments.select(page, "fragment", "text", "before").groupBy(page)).applyInPandas(place, schema)
