"""Suffix arrays and the bytes that earlier documents have, against plain loops."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
from assayer.llm import queries, suffixes

SIZE = suffixes.MATCH_BYTES


def test_suffix_array_equals_sorting():
    draw = random.Random(1)
    for _ in range(1500):
        letters = draw.choice([1, 2, 3, 9])
        text = [draw.randrange(letters) + 1 for _ in range(draw.randrange(1, 40))] + [0]
        got = suffixes.suffix_array(np.array(text)).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])


def plain_cover(docs):
    """Of each (doc_id, bytes), whether each byte goes."""
    least = {}
    for doc_id, text in docs:
        for at in range(len(text) - SIZE + 1):
            piece = text[at : at + SIZE]
            least[piece] = min(least.get(piece, suffixes.NO_ID), doc_id)
    found = []
    for doc_id, text in docs:
        gone = bytearray(len(text))
        for at in range(len(text) - SIZE + 1):
            if least[text[at : at + SIZE]] < doc_id:
                gone[at : at + SIZE] = b"\1" * SIZE
        found.append(bytes(gone))
    return found


def plain_rows(rows):
    docs = [(suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    found = []
    for (doc_id, _), (_, data), gone in zip(rows, docs, plain_cover(docs), strict=True):
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        runs = sum(g and not before for g, before in zip(gone, b"\0" + gone[:-1], strict=True)) if gone else 0
        found.append((doc_id, len(data), len(data) - len(kept), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def drawn(seed, n=60):
    """Documents with shared passages at any place, copies, edits, runs of one sign and short texts."""
    draw = random.Random(seed)
    letters = "abcdefg é中\n "
    word = lambda k: "".join(draw.choice(letters) for _ in range(k))
    pool = [word(draw.randrange(30, 200)) for _ in range(6)] + ["z" * 130, "ab" * 70, "-" * 50]
    rows = []
    for i in range(n):
        kind = draw.randrange(8)
        text = word(draw.randrange(40)) + "".join(draw.choice(pool) + word(draw.randrange(12)) for _ in range(draw.randrange(4)))
        if kind == 0 and rows:
            text = draw.choice(rows)[1] or ""
        if kind == 1 and rows and (old := draw.choice(rows)[1]):
            at = draw.randrange(len(old))
            text = old[:at] + "#" + old[at + 1 :]
        if kind == 2:
            text = draw.choice(pool)
        doc_id = None if draw.random() < 0.05 else draw.randrange(-20, 200)
        rows.append((doc_id, None if kind == 3 else text))
    return rows


def found_rows(table):
    return sorted((tuple(r) for r in suffixes.deduplicated(table).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_plain_loops(docs, seed):
    rows = drawn(seed)
    assert found_rows(docs(rows).repartition(3)) == plain_rows(rows)


def test_hot_anchors_give_the_same(docs, monkeypatch):
    """The flags are set by the driver's own functions, run here without workers."""
    rows = drawn(9, 80)
    data = [(suffixes.NO_ID if i is None else i, (t or "").encode()) for i, t in rows]
    joined = b"".join(t for _, t in data)
    sizes = [len(t) for _, t in data]
    for limit in (64, 2, 1):
        monkeypatch.setattr(suffixes, "BLOCK_SEGMENTS", limit)
        block = suffixes.Block([i for i, _ in rows], sizes, joined, 5)
        listed = list(block.buckets())
        assert [b for b, *_ in listed] == sorted(b for b, *_ in listed)
        assert sum(len(s) for _, s, _, _ in listed) == len(block.listed) == len(np.unique(block.listed_as))
        flags = {b: bytes(range(k, k + len(s))) if len(s) < 200 else bytes(len(s)) for k, (b, s, _, _) in enumerate(listed)}
        assert len(block.marks(flags)) == len(block.start)


def test_hot_anchors_by_hash(docs):
    """More different segments around one anchor in a block than its bound."""
    draw = random.Random(5)
    gram = "THE SAME ANCHOR!"
    noise = lambda k: "".join(draw.choice("abcdefghij") for _ in range(k))
    rows = []
    for i in range(260):
        same = noise(8) if i % 3 else "samesame"
        rows.append((i, f"{noise(30)}{gram * 3}{same}{noise(draw.randrange(30))}"))
    rows += [(500 + i, draw.choice(rows)[1]) for i in range(30)]
    table = docs(rows).coalesce(1)
    blocks = suffixes.stored(suffixes.text_blocks(table), "test-blocks")
    assert suffixes.segment_flags(blocks, 1).where("hot").count() > 0
    assert found_rows(table) == plain_rows(rows)


def test_awkward_rows(docs, awkward):
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.deduplicated(awkward).collect()}
    sizes = {r.doc_id: len((r.text or "").encode()) for r in awkward.collect() if r.doc_id not in (5, None)}
    long = sizes[6]
    assert {(6, long, long - 0, 1)} not in got
    assert (9, long, long, 1) in got and (7, long + 1, long, 1) in got
    assert {d for d, *_ in got} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 9}
    assert suffixes.deduplicated(docs([])).collect() == []


def test_kept_bytes_and_spans(docs):
    rows = [(1, "x" + "passage " * 9), (2, "passage " * 9 + "end"), (3, "passage " * 9)]
    got = {r.doc_id: r for r in suffixes.deduplicated(docs(rows), with_text=True).collect()}
    assert bytes(got[1].kept).decode() == rows[0][1] and got[1].spans == []
    assert bytes(got[2].kept) == b"end" and [tuple(s) for s in got[2].spans] == [(0, 72)]
    assert bytes(got[3].kept) == b"" and [tuple(s) for s in got[3].spans] == [(0, 72)]


def test_query_over_the_small_table(spark, docs, folder):
    documents = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    want = plain_rows([(d["doc_id"], d["text"]) for d in documents])
    got = sorted((tuple(r) for r in queries.QUERIES["op13_suffix_dedup"](spark, folder).collect()), key=str)
    assert got == want and sum(r[2] for r in got) > 0


def test_rows_for_tasks_grow_with_the_text_alone():
    """Every block has a row for every task: tasks grow by what one task holds, not by what it sorts at once."""
    assert suffixes.sorting_tasks(0, 32) == (1, 1)
    assert suffixes.sorting_tasks(600_000, 32) == (32, 2)
    for segments in (40_000_000, 80_000_000):
        tasks, parts = suffixes.sorting_tasks(segments, 32)
        assert tasks <= segments / suffixes.TASK_SEGMENTS + 1
        assert segments / (tasks * parts) <= suffixes.SORT_SEGMENTS


def test_a_task_sorts_its_segments_in_parts(docs, monkeypatch):
    rows = drawn(4)
    monkeypatch.setattr(suffixes, "sorting_tasks", lambda segments, least: (2, 3))
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 500)
    assert found_rows(docs(rows).repartition(2)) == plain_rows(rows)


def test_stretches_of_hot_anchors_are_counted(docs, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_SEGMENTS", 1)
    data = [t.encode() for _, t in drawn(9, 80) if t]
    block = suffixes.Block(list(range(len(data))), [len(t) for t in data], b"".join(data), 3)
    hot = block.hot[block.entry]
    met = {block.data[at : at + SIZE].tobytes() for a, b in zip(block.start[hot], block.end[hot]) for at in range(a, b - SIZE + 1)}
    assert len(block.hot_stretches()) == len(list(block.buckets()))
    assert sum(block.hot_stretches()) >= len(met) > 0
