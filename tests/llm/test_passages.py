"""Repeated passages whose ends or starts fall outside the runs from each sentence on."""

from __future__ import annotations

import random

from assayer.llm import spans


def removed(docs, rows):
    table = docs(rows)
    return {r.doc_id: r.text for r in spans.remove_spans(table, spans.repeated_spans(table)).collect()}


def words(name, n):
    return " ".join(f"{name}{i}" for i in range(n))


def test_last_sentence_of_a_passage_goes(docs):
    passage = f"{words('a', 19)}. {words('b', 19)}. {words('c', 5)}."
    rows = [(i, f"{words(f'own{i}x', i)}.\n{passage}\n{words(f'own{i}p', 9)}.") for i in (1, 8)]
    found = removed(docs, rows)
    assert set(found) == {8}
    assert found[8].split() == rows[1][1].replace(passage, "").split()


def test_passages_off_sentence_bounds_go(docs):
    short_end = f"{words('a', 19)}. {words('b', 19)}. {words('c', 5)}."
    unaligned = f"{words('d', 24)}. {words('e', 6)}. {words('f', 18)}. {words('g', 24)}"
    bare = words("h", 51)
    chance = words("k", 40)
    rows = []
    for i, lead in ((1, 3), (2, 8)):
        own = f"own{i}x"
        rows.append((i, f"{words(own, lead)}.\n{short_end}\n{words(own + 'p', 9)}."))
        rows.append((i + 10, f"{words(own + 'q', lead)} {unaligned} {words(own + 'r', 7)}."))
        rows.append((i + 20, f"{words(own + 's', lead)} {bare} {words(own + 't', 30)}"))
        rows.append((i + 30, f"{words(own + 'u', lead)} {chance} {words(own + 'v', 30)}"))
    found = removed(docs, rows)
    assert set(found) == {2, 12, 22}
    for doc_id, passage in ((2, short_end), (12, unaligned), (22, bare)):
        assert found[doc_id].split() == dict(rows)[doc_id].replace(passage, "").split()


def test_seeds_lose_nothing():
    draw = random.Random(2)
    shared = [f"s{draw.randrange(40)}" for _ in range(300)]
    for _ in range(200):
        at = draw.randrange(270)
        part = shared[at : at + spans.RUN_WORDS]
        one, two = ([f"{side}{draw.random()}" for _ in range(draw.randrange(40))] for side in "xy")
        assert set(spans.seeds(one + part + two)[0]) & set(spans.seeds(two + part + one)[0])
