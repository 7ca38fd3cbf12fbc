"""Token ids of long texts, piece by piece."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np

#: Characters after which a text may be cut.
PIECE_CHARS = 1 << 18

_CUT = re.compile(r"\S (?=\S)")


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """``text`` cut before single spaces between words, at the first such place from ``size`` characters on.

    The byte-level pattern begins a new word at every space behind another character and looks only
    ahead, so the pieces' ids are the text's; an added token holds no space.  A text without such a
    place is one piece.
    """
    at = 0
    while len(text) - at > size:
        found = _CUT.search(text, at + size)
        if found is None:
            break
        yield text[at:found.start() + 1]
        at = found.start() + 1
    yield text[at:] if at else text


def encoded(coder: Callable[[str], np.ndarray], text: str, size: int = PIECE_CHARS) -> Iterator[np.ndarray]:
    """The ids of ``text``, a piece at a time."""
    for piece in pieces(text, size):
        yield coder(piece)
