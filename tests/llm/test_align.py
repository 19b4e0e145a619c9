"""Alignments against the libraries on whole texts and plain loops."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import pyarrow as pa
import pytest
from assayer.llm import align, bpe, words

PARTS = [*"abcdeth  \n\t'.,s1", "é", "½", "中", "🙂", "\xa0", " ", "▁", "<|endoftext|>", "</s>", "<0x41>", " the", "\n\n", " under", " straightforward", "ing"]


def odd_texts(n):
    draw = random.Random(23)
    weights = [1 if p == "▁" else 20 for p in PARTS]
    texts = ["".join(draw.choices(PARTS, weights, k=draw.randint(0, 60))) for _ in range(n)]
    return [*texts, "", None, " ", "a", "▁", "a\0b", "x" * 700, "one two three " * 400]


@pytest.fixture(scope="module")
def sides():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(bpe.default_path())
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=align.default_piece_path())


def ends_of(parts):
    at, found = 0, []
    for part in parts:
        at += len(part)
        found.append(at)
    return found


def plain_groups(text, sides):
    """[(A ids, B ids)] of the text's groups, and its linked pairs."""
    a, b = sides
    alphabet = bpe.byte_alphabet()
    if not text:
        return [], []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.encode(text)
    bytes_a = [bytes(alphabet[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    if not b"".join(bytes_a) == b"".join(bytes_b) == (" " + text).encode():
        return [], []
    ends_a, ends_b = ends_of(bytes_a), ends_of(bytes_b)
    both = set(ends_a) & set(ends_b)
    groups, own, other, j = [], [], [], 0
    for i, end in enumerate(ends_a):
        own.append(ids_a[i])
        if end in both:
            while ends_b[j] < end:
                other.append(ids_b[j])
                j += 1
            groups.append((own, [*other, ids_b[j]]))
            own, other, j = [], [], j + 1
    at_end = dict(zip(ends_b, ids_b, strict=True))
    links = [(x, at_end[e]) for x, e in zip(ids_a, ends_a, strict=True) if e in both]
    return groups, links


def spelled(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)


def plain_rows(rows, sides):
    worked = [(doc_id, *plain_groups(text, sides)) for doc_id, text in rows]
    counts = Counter(link for _, _, links in worked for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return sorted(
        (
            (
                doc_id,
                sum(len(a) for a, _ in groups),
                sum(len(b) for _, b in groups),
                len(groups),
                hashlib.sha256(spelled(groups).encode()).hexdigest() if groups else "",
                len(links),
                sum(counts[x] == most[x[1]] for x in links),
                sum(counts[x] for x in links),
            )
            for doc_id, groups, links in worked
        ),
        key=str,
    )


def test_texts_equal_plain_alignment(sides, monkeypatch):
    texts = odd_texts(700)
    want = [spelled(plain_groups(t, sides)[0]) or None for t in texts]
    assert sum(w is None for w in want) > 10
    known = align.aligner(bpe.default_path(), align.default_piece_path())
    for block_bytes, kept in ((1 << 20, 400_000), (400, 50)):
        monkeypatch.setattr(align, "BLOCK_BYTES", block_bytes)
        monkeypatch.setattr(words, "WORDS_KEPT", kept)
        known.memory.clear()
        assert align.align_texts(pa.array(texts, pa.string()), known, with_groups=True).groups == want


@pytest.mark.parametrize("held", [align.PAIRS_HELD, 3])
def test_rows_equal_plain_counts(docs, awkward, sides, held):
    rows = [(i % 90 if i % 7 else None, t) for i, t in enumerate(odd_texts(150))]
    rows += [(r.doc_id, r.text) for r in awkward.collect()]
    got = sorted((tuple(r) for r in align.link_figures(docs(rows), held=held).collect()), key=str)
    assert got == plain_rows(rows, sides)


def test_no_rows(docs):
    assert align.link_figures(docs([])).collect() == []
    only_empty = align.link_figures(docs([(1, None), (2, "")])).collect()
    assert sorted(tuple(r) for r in only_empty) == [(1, 0, 0, 0, "", 0, 0, 0), (2, 0, 0, 0, "", 0, 0, 0)]


def test_every_overlap_is_expanded():
    import numpy as np

    draw = random.Random(3)
    for _ in range(100):
        size = draw.randrange(2, 40)
        cut = [np.array(sorted(draw.sample(range(1, size), draw.randrange(size - 1))) + [size]) for _ in "ab"]
        (ends_a, ends_b), (starts_a, starts_b) = cut, [np.concatenate([[0], c[:-1]]) for c in cut]
        got = set(zip(*(x.tolist() for x in align.overlaps(starts_a, ends_a, starts_b, ends_b))))
        want = {
            (i, j) for i in range(len(ends_a)) for j in range(len(ends_b))
            if starts_a[i] < ends_b[j] and starts_b[j] < ends_a[i]
        }
        assert got == want
        groups_a, groups_b, n = align.coalesced(starts_a, ends_a, starts_b, ends_b)
        assert n == len(set(ends_a) & set(ends_b))
        assert all(groups_a[i] == groups_b[j] for i, j in want)
