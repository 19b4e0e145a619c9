"""Words of a batch: cuts, whole texts, bounded memory."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from assayer.llm import bpe, token_store, words

PARTS = [*"abcdeth  \n\t'.,s1", "é", "à", "½", "中", "🙂", "\xa0", " ", " ", "　", "\x85", "\x1c", "<|endoftext|>", " the", "\n\n", " un"]


def odd_texts(seed, n=2500):
    draw = random.Random(seed)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 50))) for _ in range(n)]
    return [*texts, "", None, " ", "a", " a ", "a\0b \0b", "xy " * 3000, "z" * 900, "", None]


def ids_by_text(texts, memory):
    found = [[] for _ in texts]
    for owner, ids in token_store.ids_of_texts(pa.array(texts, pa.string()), memory):
        found[owner].extend(ids.tolist())
    return found


def test_ids_equal_the_librarys(monkeypatch):
    texts = odd_texts(5)
    encoder = token_store.LibraryEncoder(bpe.default_path())
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    for block_bytes, kept in ((1 << 20, 400_000), (300, 40)):
        monkeypatch.setattr(words, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(words, "WORDS_KEPT", kept)
        memory = words.WordMemory(encoder.encode_words)
        for _ in range(2):  # the second time from memory
            assert ids_by_text(texts, memory) == want
            assert len(memory._slots) <= kept


def test_words_make_up_the_texts(monkeypatch):
    monkeypatch.setattr(words, "BLOCK_BYTES", 200)
    texts = odd_texts(6, 500)
    for first in (False, True):
        got = [b"" for _ in texts]
        for block in words.blocks(pa.array(texts, pa.string()), space_first=first):
            listed = block.distinct.to_pylist()
            at = 0
            for owner, n in zip(block.owners, block.words_of, strict=True):
                got[owner] += b"".join(listed[c] for c in block.codes[at : at + n])
                at += n
            assert at == len(block.codes)
        assert got == [(" " * (first and bool(t)) + (t or "")).encode() for t in texts]
    sliced = pa.array(["x y", "a b c", None, "d"], pa.string()).slice(1, 3)
    assert [b.words_of.tolist() for b in words.blocks(sliced)] == [[3, 0, 1]]
    assert list(words.blocks(pa.array([], pa.string()))) == []


def test_ragged():
    lists = words.Ragged(np.arange(6), np.array([2, 0, 3, 1]))
    taken = lists.take(np.array([2, 1, 0, 2]))
    assert taken.values.tolist() == [2, 3, 4, 0, 1, 2, 3, 4] and taken.counts.tolist() == [3, 0, 2, 3]
    assert lists.bounds().tolist() == [0, 2, 2, 5, 6]
