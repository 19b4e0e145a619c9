"""The pipeline's near-dedup stage against all pairs of its rows."""

from __future__ import annotations

import random

import corpus_pipeline
from assayer.llm import near


def similarity(a, b):
    def cut(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    x, y = cut(a), cut(b)
    return len(x & y) / len(x | y)


def stage(spark):
    return dict(corpus_pipeline.STAGES)["near-dedup"]


def kept_of(spark, table):
    kept = stage(spark)(spark, table, "")
    assert kept.columns == table.columns
    return [(r.doc_id, r.text) for r in kept.collect()]


def test_stage_drops_copies_at_the_bound(spark, docs):
    draw = random.Random(11)

    def edited(words, times):
        words = list(words)
        for _ in range(times):
            words[draw.randrange(len(words))] = f"new{draw.randrange(10**6)}"
        return words

    rows = []
    for family in range(12):
        base = [f"w{draw.randrange(3000)}" for _ in range(draw.choice([60, 200, 700]))]
        for _ in range(6):
            words = edited(base, draw.choice([0, 1, len(base) // 60, len(base) // 40, len(base) // 8]))
            rows.append((len(rows), " ".join(words)))
    kept = kept_of(spark, docs(rows))
    texts = [t for _, t in kept]
    near_pairs = [(a, b) for i, (_, a) in enumerate(rows) for _, b in rows[:i] if similarity(a, b) >= 0.8]
    assert len(near_pairs) > 20
    assert not [1 for i, a in enumerate(texts) for b in texts[:i] if similarity(a, b) >= 0.8]
    # What went has a chain of near copies to a smaller id.
    for doc_id, text in set(rows) - set(kept):
        assert any(similarity(text, b) >= 0.8 for i, b in rows if i != doc_id)


def test_null_and_repeated_ids_go_by_their_texts(spark, docs):
    base = [f"word{i}" for i in range(100)]
    copy = " ".join(["other", *base[1:]])
    rows = [
        (None, " ".join(base)), (None, copy), (None, "a clean row of its own words"),
        (7, "some text that stands alone here"), (7, copy),
        (None, "nameless one two three four five six seven"), (None, "NAMELESS one two three four five six seven"),
    ]
    kept = kept_of(spark, docs(rows))
    assert (7, rows[3][1]) in kept and (7, copy) in kept and (None, rows[2][1]) in kept
    assert (None, " ".join(base)) not in kept and (None, copy) not in kept
    assert len([1 for _, t in kept if t.lower().startswith("nameless")]) == 1
    assert len(kept) == 4


def test_bands_find_pairs_at_the_bound():
    import numpy as np

    draw = np.random.Generator(np.random.PCG64(1))
    mixers = near._mixers()
    for _ in range(300):
        values = draw.integers(0, 1 << 63, 110, dtype=np.uint64)
        a, b = near.band_keys(values[:99], mixers), near.band_keys(values[11:], mixers)
        assert set(a) & set(b)


def test_large_groups_and_templates(spark, docs, monkeypatch):
    """Many copies of one document, and many documents of one template that are none."""
    monkeypatch.setattr(near, "BUCKET", 5)
    draw = random.Random(7)
    template = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join([*template, *(f"own{draw.randrange(10**7)}" for _ in range(40))])) for i in range(150)]
    base = [f"b{i}" for i in range(150)]
    for i in range(60):
        words = list(base)
        words[draw.randrange(150)] = f"edit{i}"
        rows.append((1000 + i, " ".join(words)))
    kept = {i for i, _ in kept_of(spark, docs(rows))}
    assert kept == {*range(150), 1000}


def test_templates_make_no_candidates(spark, docs):
    sizes = []
    for n in (100, 200):
        draw = random.Random(n)
        template = [f"t{i}" for i in range(120)]
        texts = [(i, " ".join([*template, *(f"own{draw.randrange(10**7)}" for _ in range(40))])) for i in range(n)]
        table = docs(texts)
        rows = near.signatures(table)
        entries = rows.selectExpr("doc_id as entry", "named_struct('doc_id', doc_id, 'digest', digest) as at", "bands")
        sizes.append(near.rarest(near._sets(table, entries)).count())
    assert sizes == [0, 0]


def test_no_rows_and_null_texts(spark, docs):
    assert kept_of(spark, docs([])) == []
    assert len(kept_of(spark, docs([(1, None), (2, ""), (3, " \n"), (4, "a b c d e f")]))) == 2


def test_links_between_members_that_other_ones_stand_for(spark, docs, monkeypatch):
    """Two large groups that only one pair of rows joins, which shares no rare bucket alone."""
    monkeypatch.setattr(near, "BUCKET", 5)
    rows = []
    for family in range(8):
        base = [f"f{family}w{i}" for i in range(300)]

        def state(edits, own=None, base=base):
            words = [f"{w}new" if i % 12 == 0 and i < 12 * edits else w for i, w in enumerate(base)]
            if own is not None:
                words[200 + 8 * own] += "own"
            return " ".join(words)

        texts = [state(0, i) for i in range(10)] + [state(5), state(10)] + [state(15, i) for i in range(10)]
        assert similarity(texts[10], texts[11]) >= 0.8
        assert min(similarity(texts[10], t) for t in texts[:10]) >= 0.8 > similarity(texts[0], texts[11])
        assert min(similarity(texts[11], t) for t in texts[12:]) >= 0.8 > similarity(texts[12], texts[10])
        rows += [(100 * family + i, t) for i, t in enumerate(texts)]
    kept = near.keep_one_of_near_copies(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == [100 * family for family in range(8)]


def test_pairs_of_a_crowded_bucket(spark, monkeypatch):
    """All pairs of different classes, each once; none of one class alone."""
    monkeypatch.setattr(near, "BUCKET", 4)
    classes = {i: 0 if i < 30 else 1000 + i // 2 for i in range(44)}
    rows = [(1, i, 100, 100, c) for i, c in classes.items()] + [(2, i, 100, 100, 7) for i in range(50)]
    table = spark.createDataFrame(rows, "shingle bigint, entry bigint, size int, rest int, class bigint")
    found = [tuple(r) for r in near.pairs_of_classes(table, ["shingle"]).collect()]
    assert sorted(found) == [(a, b) for a in classes for b in classes if a < b and classes[a] != classes[b]]
    # Too little of the sets is left, or they differ too much in size.
    for size, rest in ((100, 88), (70, 70)):
        two = [(1, 1, 100, 100, 1), (1, 2, size, rest, 2)]
        table = spark.createDataFrame(two, "shingle bigint, entry bigint, size int, rest int, class bigint")
        assert near.pairs_of_classes(table, ["shingle"]).count() == 0
