"""What op7 hashes: no more than what can recur, and all of that."""

from __future__ import annotations

import random

import numpy as np
from assayer.llm import spans


def test_only_stretches_whose_seeds_all_recur_are_hashed():
    """Two halves recur, the middle of the document does not: no window reaches across it."""
    draw = random.Random(3)
    words = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]
    left, right = words(80), words(80)
    text = " ".join([*left, "new", "words", *right])
    recurring = np.concatenate([spans.seeds(left)[0], spans.seeds(right)[0]])
    place = {m.start(): i for i, m in enumerate(spans.WORD.finditer(text))}
    found = [(place[start], len(text[start:end].split())) for _, start, end in spans.runs(text, recurring)]
    windows = {i for i, n in found if n == spans.WINDOW_WORDS}
    alike = len(left) - spans.WINDOW_WORDS + 1
    assert windows >= {*range(alike), *range(82, 82 + alike)}
    # Up to a seed that both texts have, the edge of what recurs is not known more closely.
    assert all(i <= alike + spans.SEED_SPREAD or i >= 82 - spans.SEED_SPREAD for i in windows)


def test_what_recurs_is_hashed_wherever_it_stands():
    draw = random.Random(4)
    for _ in range(40):
        word = lambda: f"w{draw.randrange(12)}" + "." * (draw.random() < 0.1)
        shared = [word() for _ in range(draw.randrange(30, 120))]
        texts = [" ".join([word() for _ in range(draw.randrange(40))] + shared + [word() for _ in range(draw.randrange(40))]) for _ in "ab"]
        seeds = [set(spans.seeds(t.split())[0].tolist()) for t in texts]
        recurring = np.array(sorted(seeds[0] & seeds[1]), dtype=np.int64)
        every = [{h for h, _, _ in spans.runs(t)} for t in texts]
        for t, whole in zip(texts, every, strict=True):
            assert {h for h, _, _ in spans.runs(t, recurring)} >= every[0] & every[1]
            assert {h for h, _, _ in spans.runs(t, recurring)} <= whole
