"""Decontamination, extraction and toxicity on small cases with known answers."""

from __future__ import annotations

import random

import numpy as np
import pytest
from assayer.llm import decontaminate, html_text, toxicity

WORDS = "stone river light quiet morning window carry under bright field seldom winter harbor letter".split()


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + draw.choice("aeiou") * draw.randint(0, 2) for _ in range(n))


def least_edits(item, text):
    costs = np.zeros(len(text) + 1, dtype=int)
    codes = np.array([ord(c) for c in text])
    for i, c in enumerate(item, 1):
        best = np.minimum(costs[:-1] + (codes != ord(c)), costs[1:] + 1)
        row = np.concatenate([[i], best])
        steps = np.arange(len(row))
        costs = np.minimum.accumulate(row - steps) + steps
    return int(costs.min())


def test_matches_are_those_of_brute_force(spark, docs):
    draw = random.Random(11)
    items = [(i, sentence(draw, draw.randint(8, 30))) for i in range(12)] + [(90, None), (91, "short"), (92, "")]
    rows = [(1, None), (2, ""), (3, "tiny")]
    for doc_id in range(10, 50):
        text = list(draw.choice(items[:12])[1])
        for _ in range(draw.randint(0, len(text) // 6)):
            at = draw.randrange(len(text))
            text[at : at + draw.randint(0, 1)] = draw.choice(["", "q", "Z", "zz"])
        rows.append((doc_id, sentence(draw, 30) + ("\n" if doc_id % 2 else "  ") + "".join(text) + " " + sentence(draw, 9)))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    want = {}
    for doc_id, text in rows:
        for item_id, item in items:
            own, whole = decontaminate.normalized(item), decontaminate.normalized(text)
            if len(own) >= decontaminate.Q and whole:
                edits = least_edits(own, whole)
                if edits <= decontaminate.budget(len(own)):
                    want[doc_id, item_id] = edits
    assert got == want and len(want) > 5
    kept = decontaminate.keep_uncontaminated(docs(rows), benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert kept.columns == docs(rows).columns


def test_items_in_blocks_and_texts_in_stretches(spark, docs, monkeypatch):
    draw = random.Random(13)
    items = [(i, sentence(draw, 20)) for i in range(6)]
    long = " ".join([sentence(draw, 400), items[2][1], sentence(draw, 400), items[5][1], sentence(draw, 50)])
    rows = [(1, long), (2, sentence(draw, 300)), (None, items[1][1])]
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 400)
    monkeypatch.setattr(decontaminate, "STRETCH", 1000)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs(rows), benchmark).collect()}
    assert got == {(1, 2), (1, 5), (None, 1)}
    empty = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.contaminated(docs(rows), empty).count() == 0
    assert decontaminate.contaminated(docs([]), benchmark).count() == 0


BODY = "<p>Words, and more words, fill this paragraph of the article with text.</p>" * 3


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<html><body><script>var a = '<p>no</p>';</script></body></html>", ""),
        ("<article><h1>Head</h1><p>One &amp; two,\n three<br>four<p>Five &eacute;</article>", "Head\n\nOne & two, three four\n\nFive é"),
        (
            "<nav><a href=x>Menu</a></nav><div class='sidebar'>" + BODY + "</div><div id=content><p>This is the text, "
            "which is long enough, to be found here.</p></div><div class='comments'>" + BODY + "</div>",
            "This is the text, which is long enough, to be found here.",
        ),
        ("<article><p>Kept text <b>bold</b> here.</p><aside>No</aside><form>No</form><ul><li>a<li>b</ul></article><foo", "Kept text bold here.\n\na\n\nb"),
        ("<div><p>Cut off in the middle, as pages are, when loading ends &am", "Cut off in the middle, as pages are, when loading ends &am"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_deep_and_repeated_pages(spark):
    deep = "<div>" * 5000 + "<p>Deep text, but text it is, and it stays whole.</p>"
    rows = [(1, "u", deep, "x"), (1, "u", deep, "x"), (None, None, None, "y")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = [tuple(r) for r in html_text.extracted(pages).collect()]
    line = "Deep text, but text it is, and it stays whole."
    assert sorted(got, key=str) == sorted([(1, "u", line, len(line))] * 2 + [(None, None, "", 0)], key=str)


def test_toxicity_learns_and_never_sees_held_out_labels(spark, docs):
    draw = random.Random(17)
    rows, labels = [], []
    for doc_id in range(900):
        toxic = doc_id % 4 == 0
        text = sentence(draw, 40) + (" vilewort badling vilewort " if toxic else " ") + sentence(draw, 20)
        rows.append((doc_id, text))
        labels.append((doc_id, 0, int(toxic)))
    rows += [(1000, None), (1001, ""), (None, "vilewort badling")]
    table = docs(rows)
    known = spark.createDataFrame(labels + [(5, 0, None), (5, 0, 0), (7777, 0, 1)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scored(table, known).collect()}
    assert len(got) == len(rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    held = [i for i in range(900) if got[i].held_out]
    assert 200 < len(held) < 400
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.97
    flipped = known.withColumn("toxic", toxicity.F.when(toxicity.held_out(known["doc_id"]), 1 - known["toxic"]).otherwise(known["toxic"]))
    again = {r.doc_id: r.score for r in toxicity.scored(table, flipped).collect()}
    assert again == {i: r.score for i, r in got.items()}
    clean = toxicity.keep_clean(table, known)
    assert clean.columns == table.columns and {1000, 1001} <= {r.doc_id for r in clean.collect()}


def test_nothing_to_learn(spark, docs):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    table = docs([(1, "text"), (2, None)])
    assert {r.score for r in toxicity.scored(table, labels).collect()} == {0.0}
    assert toxicity.keep_clean(table, labels).count() == 2
    assert toxicity.scored(docs([]), labels).count() == 0
