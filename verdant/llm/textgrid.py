"""Texts of a task as flat arrays of code points, so that numpy passes replace Python loops over characters."""

from __future__ import annotations

import numpy as np

CHARS = 1_500_000  # code points handled at once; a longer text is a chunk of its own


def chunks(texts: list[str]):
    """Index ranges of ``texts`` of about CHARS code points each."""
    start, size = 0, 0
    for i, t in enumerate(texts):
        if i > start and size + len(t) > CHARS:
            yield start, i
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        yield start, len(texts)


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Words:
    """The maximal runs of letters of some texts: ``start`` and ``end`` in ``code`` (0 at other
    characters, after each text and at both ends) and the text ``doc`` of each."""

    def __init__(self, texts: list[str], is_letter: np.ndarray):
        texts = [t.lower() for t in texts]
        ends = np.cumsum([len(t) + 1 for t in texts])
        code = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        code = np.where(is_letter[code], code, np.uint32(0))
        self.code = np.concatenate((np.zeros(1, np.uint32), code, np.zeros(2, np.uint32)))
        edge = np.flatnonzero(np.diff((self.code > 0).view(np.int8)))
        self.start, self.end = edge[0::2] + 1, edge[1::2] + 1
        self.doc = np.searchsorted(ends, self.start - 1, side="right")
        self.docs = len(texts)
