"""Cutting texts where byte-level BPE cuts them anyway, and remembering the pieces.

The tokenizer's pattern always ends a piece before a single space that stands
between two characters that are not white space. Texts can be cut there without
changing a single token, and the same words come back so often that each is
encoded once for each worker and looked up afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

#: Pieces in a generation of a worker's memory. A full one becomes the old one, whose
#: entries are moved back when they are met again. Bounds memory, not results.
MEMORY_ENTRIES = 200_000
#: Characters whose pieces are held at once.
BLOCK_CHARS = 1_000_000
#: All characters of white space.
WHITE = frozenset(c for c in map(chr, range(0x3001)) if c.isspace())
CUT = re.compile(r"(?<=\S) (?=\S)")


def blocks(text: str) -> Iterator[str]:
    """``text`` in blocks of about BLOCK_CHARS characters, cut where tokens end anyway."""
    start = 0
    while len(text) - start > BLOCK_CHARS and (m := CUT.search(text, start + BLOCK_CHARS)):
        yield text[start : m.start()]
        start = m.start()
    yield text[start:] if start else text


def pieces(block: str) -> list[str]:
    """Pieces of a block in order; all but the first are to be read with a space before them."""
    white = WHITE.intersection(block)
    if block[:1] in white or block[-1:] in white or any(f" {w}" in block or f"{w} " in block for w in white):
        return CUT.split(block)
    # No space next to other white space: every space is a place to cut.
    return block.split(" ")


class Memory:
    """Encodes texts by pieces, which ``encode_all`` turns into the bytes of their ids."""

    def __init__(self, encode_all: Callable[[list[str]], list[bytes]]) -> None:
        self._encode_all = encode_all
        self._first: dict[str, bytes] = {}
        self._inner: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def clear(self) -> None:
        """Forget all pieces. Idle workers must not hold memory that other stages need."""
        self._first, self._inner, self._old = {}, {}, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as bytes. Texts are taken together up to BLOCK_CHARS characters."""
        done: list[bytes] = []
        held: list[str] = []
        size = 0
        for text in texts:
            if size + len(text) > BLOCK_CHARS and held:
                done.extend(self._encode_held(held))
                held, size = [], 0
            if len(text) > BLOCK_CHARS:
                done.append(b"".join(self._encode_held([b])[0] for b in blocks(text)))
            else:
                held.append(text)
                size += len(text)
        return [*done, *self._encode_held(held)]

    def _encode_held(self, texts: list[str]) -> list[bytes]:
        cut = [pieces(text) for text in texts]
        first = [p.pop(0) for p in cut]
        if len(self._inner) > MEMORY_ENTRIES:
            self._old, self._inner = self._inner, {}
        if len(self._first) > MEMORY_ENTRIES:
            self._first.clear()
        new_first = list(set(first).difference(self._first))
        missing = set().union(*cut).difference(self._inner)
        old, new = self._old, []
        for piece in missing:
            if piece in old:
                self._inner[piece] = old[piece]
            else:
                new.append(piece)
        ids = self._encode_all(new_first + [" " + p for p in new])
        self._first.update(zip(new_first, ids, strict=False))
        self._inner.update(zip(new, ids[len(new_first) :], strict=True))
        inner, head = self._inner.__getitem__, self._first
        return [head[f] + b"".join(map(inner, p)) for f, p in zip(first, cut, strict=True)]
