"""Exact and near copies, lines and passages against brute force."""

from __future__ import annotations

import hashlib
import random

import pytest
from assayer.llm import exact, graph, lines, simhash, spans

ALPHABET = "the of and a in that over under stone river light runs deep cold wind".split()


def brute_groups(rows):
    by_text = {}
    for doc_id, text in rows:
        by_text.setdefault(text or "", []).append(doc_id)
    found = []
    for doc_id, text in rows:
        ids = by_text[text or ""]
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        digest = hashlib.sha256((text or "").encode()).hexdigest()
        found.append((doc_id, keep, len(ids), doc_id == keep, digest))
    return sorted(found, key=str)


def test_exact_groups_match_brute_force(awkward):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    got = [tuple(r) for r in exact.duplicate_groups(awkward).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


def test_blocks_are_compared_whole(docs, monkeypatch):
    monkeypatch.setattr(exact, "BLOCK_CHARS", 3)
    rows = [(i, t) for i, t in enumerate(["abcabcab", "abcabcab", "abcabc", "abc", "abcabcabc", "abcab", "ab", ""])]
    got = [tuple(r) for r in exact.duplicate_groups(docs(rows)).collect()]
    assert sorted(got, key=str) == brute_groups(rows)


def test_exact_stage_keeps_columns_and_one_row(awkward):
    kept = exact.keep_last_of_equals(awkward)
    assert kept.columns == awkward.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(i for i, t in rows if t == "One short line.") == [5]
    assert sorted(i for i, t in rows if not t) == [2]
    assert len(rows) == len({t or "" for _, t in rows})


@pytest.mark.parametrize("operator", ["exact", "simhash", "lines", "spans"])
def test_empty_tables(docs, operator):
    none = docs([])
    result = {
        "exact": lambda: exact.duplicate_groups(none),
        "simhash": lambda: simhash.near_duplicates(none),
        "lines": lambda: lines.duplicate_lines(none),
        "spans": lambda: spans.remove_spans(none, spans.repeated_spans(none)),
    }[operator]()
    assert result.count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 105), (105, 103), (7, 7), (200, 200)]
    found = dict(graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert found == {i: 0 for i in range(41)} | {100: 100, 103: 100, 105: 100}


def brute_links(prints):
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {p: root(p) for p in prints}


def test_links_lose_none_in_crowded_buckets(spark):
    draw = random.Random(3)
    prints = set()
    for _ in range(6):
        centre = draw.getrandbits(62)
        for _ in range(60):
            value = centre
            for bit in draw.sample(range(62), draw.randint(0, 4)):
                value ^= 1 << bit
            prints.add(value)
    prints.update(draw.getrandbits(62) for _ in range(200))
    entries = spark.createDataFrame([(p,) for p in prints], "fp bigint")
    found = {r.node: r.component for r in graph.components(simhash.links(entries)).collect()}
    for p, least in brute_links(sorted(prints)).items():
        assert found.get(p, p) == least


def test_simhash_classes(awkward):
    found = {}
    for r in simhash.near_duplicates(awkward).collect():
        found.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert all(len(v) == 1 for v in found.values())
    assert {found[i].copy().pop()[1] for i in (1, 2, 3)} == {1}
    assert found[1] == {("0" * 16, 1)}
    assert found[5].copy().pop()[1] == 4 and found[9].copy().pop()[1] == 6
    kept = simhash.keep_one_per_class(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 4, 6, 8}
    assert not {r.doc_id for r in kept.collect()} & {2, 3, 5, 9}


def brute_lines(rows):
    seen = []
    for doc_id, text in sorted(r for r in rows if r[0] is not None and r[1]):
        for n, line in enumerate(text.split("\n")):
            if words := line.encode().split():
                seen.append(((doc_id, n), words))
    gone = {}
    for i, (place, words) in enumerate(seen):
        for other, earlier in seen[:i]:
            if words == earlier or lines.one_word_apart(words, earlier):
                gone[place] = other
                break
    return gone


def test_lines_match_brute_force(docs):
    draw = random.Random(5)
    base = [[draw.choice(ALPHABET) for _ in range(draw.randint(1, 14))] for _ in range(30)]
    rows = []
    for doc_id in range(40):
        content = []
        for _ in range(draw.randint(0, 6)):
            line = list(draw.choice(base))
            for _ in range(draw.choice([0, 0, 1, 1, 2])):
                at = draw.randrange(len(line) + 1)
                kind = draw.randrange(3)
                line[at : at + (kind != 0)] = [draw.choice(ALPHABET)] if kind != 1 else []
            content.append(" ".join(line))
        rows.append((doc_id, "\n".join(content)))
    rows += [(50, None), (51, ""), (None, rows[0][1])]
    table = docs(rows)
    found = lines.duplicate_lines(table)
    got = {(r.doc_id, r.line_no): (r.first_doc_id, r.first_line_no) for r in found.collect()}
    assert got == brute_lines(rows)
    cleaned = lines.remove_lines(table, found)
    assert cleaned.columns == table.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    for doc_id, text in rows:
        if doc_id is not None and text is not None:
            left = [t for n, t in enumerate(text.split("\n")) if (doc_id, n) not in got]
            assert texts[doc_id] == "\n".join(left)


def test_passages_go_but_their_first_occurrence(docs):
    draw = random.Random(7)

    def prose(sentences):
        return " ".join(
            " ".join(draw.choice(ALPHABET) + str(draw.randrange(900)) for _ in range(draw.randint(3, 15))) + "."
            for _ in range(sentences)
        )

    passage = " ".join(f"Planted{i} words stand here in number {i}." for i in range(10))
    rows = [(i, prose(6) + "\n" + passage + "\n" + prose(5)) for i in (2, 5, 9)]
    rows += [(11, prose(20)), (12, None), (13, ""), (14, "Is it. " * 300), (None, passage)]
    found = {r.doc_id: r for r in spans.remove_spans(docs(rows), spans.repeated_spans(docs(rows))).collect()}
    assert set(found) == {5, 9, 14}
    for doc_id, text in rows:
        if doc_id in (5, 9):
            assert found[doc_id].text == text.replace(passage, "")
            assert found[doc_id].first_doc_ids == [2]
    assert found[14].text == "Is it."


def test_long_sentences_are_cut_the_same_way():
    text = "x " * 100
    assert [len(w) for _, _, w in spans.sentences(text)] == [20] * 5
    assert spans.runs("too short.") == []
