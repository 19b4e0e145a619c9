"""Texts of an Arrow batch as words, each distinct word worked out once.

A word ends where a single space stands between two characters that are not white
space; the next word begins with that space. Tokenizers that never join tokens
across such a place give the same tokens for a text as for its words in a row.

Words are slices of the batch's own bytes: Arrow tells the distinct ones apart,
results for them are looked up or computed, and numpy lays them out in the order
of the text. A worker keeps the results of words that it met twice in one block,
up to ``WORDS_KEPT``; what is forgotten is computed again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; longer texts are cut between words.
BLOCK_BYTES = 16 << 20
WORDS_KEPT = 300_000
SPACE = 0x20
# The ASCII white space, and the UTF-8 bytes of all other white space.
ASCII_WHITE = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32])
WIDE_WHITE = [c.encode("utf-8") for c in map(chr, range(0x80, 0x3001)) if c.isspace()]
IS_WHITE = np.isin(np.arange(256), ASCII_WHITE)


@dataclass
class Ragged:
    """Lists of unequal length: all values in a row, and the length of each list."""

    values: np.ndarray
    counts: np.ndarray

    def take(self, index: np.ndarray) -> Ragged:
        starts = np.cumsum(self.counts) - self.counts
        counts = self.counts[index]
        before = np.cumsum(counts) - counts
        at = np.arange(int(counts.sum())) + np.repeat(starts[index] - before, counts)
        return Ragged(self.values[at], counts)

    def joined(self, other: Ragged) -> Ragged:
        return Ragged(np.concatenate([self.values, other.values]), np.concatenate([self.counts, other.counts]))

    def bounds(self) -> np.ndarray:
        """Where each list starts, and the end of the last one."""
        return np.concatenate([[0], np.cumsum(self.counts)])


@dataclass
class Items:
    """One Python object for each word."""

    values: np.ndarray

    def take(self, index: np.ndarray) -> Items:
        return Items(self.values[index])

    def joined(self, other: Items) -> Items:
        return Items(np.concatenate([self.values, other.values]))


Columns = dict[str, "Ragged | Items"]


def _wide_white_ends(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a wide white-space character ends just before each place."""
    found = np.zeros(len(at), dtype=bool)
    for white in WIDE_WHITE:
        same = at >= len(white)
        for k, byte in enumerate(reversed(white), 1):
            same &= data[np.maximum(at - k, 0)] == byte
        found |= same
    return found


def _wide_white_starts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether a wide white-space character starts at each place."""
    found = np.zeros(len(at), dtype=bool)
    last = len(data) - 1
    for white in WIDE_WHITE:
        same = at + len(white) <= len(data)
        for k, byte in enumerate(white):
            same &= data[np.minimum(at + k, last)] == byte
        found |= same
    return found


def cuts(data: np.ndarray) -> np.ndarray:
    """Places in one text's or several joined texts' bytes where a word may begin."""
    at = np.flatnonzero(data == SPACE)
    at = at[(at > 0) & (at < len(data) - 1)]
    at = at[~IS_WHITE[data[at - 1]] & ~IS_WHITE[data[at + 1]]]
    wide = (data[at - 1] >= 0x80) | (data[at + 1] >= 0x80)
    if wide.any():
        some = at[wide]
        keep = np.ones(len(at), dtype=bool)
        keep[wide] = ~_wide_white_ends(data, some) & ~_wide_white_starts(data, some + 1)
        at = at[keep]
    return at


@dataclass
class Block:
    """Words of some texts or parts of texts, in order."""

    #: The text that each part belongs to, and the number of words in the part.
    owners: np.ndarray
    words_of: np.ndarray
    #: Distinct words, and the place of each word among them.
    distinct: pa.Array
    codes: np.ndarray


def _block(parts: list[tuple[int, np.ndarray]]) -> Block:
    owners = np.array([owner for owner, _ in parts], dtype=np.int64)
    sizes = np.array([len(part) for _, part in parts], dtype=np.int64)
    data = np.concatenate([part for _, part in parts]) if parts else np.zeros(0, dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    # A cut on a text's first byte is that text's start; one on its last byte has only
    # another text's byte behind it.
    inner = cuts(data)
    inside = np.ones(len(data) + 1, dtype=bool)
    inside[starts] = False
    inside[np.maximum(ends - 1, 0)] = False
    inner = inner[inside[inner]]
    bounds = np.sort(np.concatenate([inner, starts[sizes > 0]]))
    offsets = np.concatenate([bounds, [len(data)]]).astype(np.int32)
    words = pa.BinaryArray.from_buffers(
        pa.binary(), len(bounds), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    )
    coded = words.dictionary_encode()
    words_of = np.searchsorted(bounds, ends) - np.searchsorted(bounds, starts)
    return Block(owners, words_of, coded.dictionary, coded.indices.to_numpy())


def blocks(texts: pa.Array, space_first: bool = False, block_bytes: int | None = None) -> Iterator[Block]:
    """The words of a string array; null counts as empty, and empty texts have no words.

    ``space_first`` puts a space before every text that is not empty.
    """
    most = block_bytes or BLOCK_BYTES
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    empty = texts.is_null().to_numpy(zero_copy_only=False) if texts.null_count else np.zeros(len(texts), dtype=bool)
    lead = np.full(1, SPACE, dtype=np.uint8)
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i in range(len(texts)):
        text = data[offsets[i] : offsets[i + 1]] if not empty[i] else data[:0]
        if space_first and len(text):
            text = np.concatenate([lead, text])
        if size and size + len(text) > most:
            yield _block(held)
            held, size = [], 0
        while len(text) > most:
            # The last byte looked at may be the first of a wide white space.
            places = cuts(text[:most])
            places = places[places < most - 4]
            step = most
            while not len(places) and step < len(text):
                # One word longer than a block: look on until it ends.
                step *= 2
                places = cuts(text[:step])
                places = places[places < min(step, len(text)) - 4]
            if not len(places):
                break
            at = int(places[-1] if step == most else places[0])
            yield _block([(i, text[:at])])
            text = text[at:]
        held.append((i, text))
        size += len(text)
    if held:
        yield _block(held)


class WordMemory:
    """Results of words by column; ``compute`` gives them for a list of distinct words."""

    def __init__(self, compute: Callable[[list[bytes]], Columns]) -> None:
        self._compute = compute
        self.clear()

    def clear(self) -> None:
        self._slots: dict[bytes, int] = {}
        self._columns: Columns | None = None

    def columns(self, block: Block) -> tuple[np.ndarray, Columns]:
        """(row of each word, columns): the words' results are those rows of the columns."""
        words = block.distinct.to_pylist()
        get = self._slots.get
        rows = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        new = np.flatnonzero(rows < 0)
        known = self._columns
        if len(new):
            found = self._compute([words[i] for i in new.tolist()])
            rows[new] = len(self._slots) + np.arange(len(new))
            columns = found if known is None else {k: known[k].joined(found[k]) for k in found}
            twice = np.bincount(block.codes, minlength=len(words))[new] > 1
            if len(self._slots) + int(twice.sum()) > WORDS_KEPT:
                self.clear()
                known = None
            at = np.flatnonzero(twice)
            for i in new[at].tolist():
                self._slots[words[i]] = len(self._slots)
            kept = {k: found[k].take(at) for k in found}
            self._columns = kept if known is None else {k: known[k].joined(kept[k]) for k in kept}
        else:
            columns = known
        return rows[block.codes], columns
