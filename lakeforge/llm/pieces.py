"""Pieces of a text that a byte-level BPE tokenizer encodes independently of each other.

The split pattern of the tokenizers used here starts a new match at every single space that stands between two
characters that are not white space: no alternative crosses it, and every alternative may begin with it.  So the text
before such a space and the text from it on are encoded alike alone and together.  Those spaces are the *proven*
boundaries.  A piece is the text between two of them; the pieces of natural text repeat, so their encodings are
remembered in each Python worker, up to ``MEMO`` pieces.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Space that is no boundary: beside white space, or at an end.
IRREGULAR = re.compile(r"\s | \s|^ | $")
BOUNDARY = re.compile(r"(?<=\S) (?=\S)")
#: Remembered pieces of a worker, and the longest that is remembered.
MEMO, LONGEST = 300_000, 64


def split(text: str, before: str = "") -> list[str]:
    """The pieces, in order; each but the first begins with the space of its boundary.  ``before`` is put before the first."""
    parts = BOUNDARY.split(text) if IRREGULAR.search(text) else text.split(" ")
    if before:
        return [before + parts[0], *[" " + p for p in parts[1:]]]
    return [parts[0], *[" " + p for p in parts[1:]]] if parts[0] or len(parts) > 1 else []


class Memo:
    """Encodings of pieces by ``encode(list of pieces) -> list``, remembered."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode, self.known = encode, {}

    def of(self, pieces: list[str]) -> list:
        known = self.known
        missing = list(dict.fromkeys(p for p in pieces if p not in known))
        if missing:
            if len(known) > MEMO:
                known.clear()
                missing = list(dict.fromkeys(pieces))
            fresh = dict(zip(missing, self.encode(missing)))
            out = [known[p] if p in known else fresh[p] for p in pieces]
            known.update((p, v) for p, v in fresh.items() if len(p) <= LONGEST)
            return out
        return [known[p] for p in pieces]
