"""Merkle manifests against a plain tree, on awkward rows and on its own twin."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from assayer.llm import manifest, queries
from compare import difference, duck


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def levels(nodes):
    found = [nodes]
    while len(found[-1]) > 1:
        below = found[-1]
        found.append([digest(*below[i : i + 3]) for i in range(0, len(below), 3)])
    return found


def plain(rows):
    """The contract's rows, tree by tree."""
    trees = {}
    for r in rows:
        even = r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
        changed = r.text.replace("\n", "") if even and r.text is not None else r.text
        trees.setdefault(r.source, []).append((r.doc_id, leaf(r, r.text), leaf(r, changed)))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in trees.values():
        leaves.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    grown = {s: levels([x[1] for x in trees[s]]) for s in order}
    top = levels([grown[s][-1][0] for s in order])
    found = []
    for place, s in enumerate(order):
        for i, (doc_id, own, other) in enumerate(trees[s]):
            siblings, folded = [], other
            for tree, at in ((grown[s], i), (top, place)):
                for level in tree[:-1]:
                    run, k = level[at - at % 3 : at - at % 3 + 3], at % 3
                    siblings += run[:k] + run[k + 1 :]
                    folded = digest(*run[:k], folded, *run[k + 1 :])
                    at //= 3
            root = top[-1][0]
            found.append((doc_id, own, grown[s][-1][0], root, digest(*siblings), folded, folded == root))
    return sorted(found, key=str)


def tampered(table, depth=manifest.DEPTH):
    return sorted((tuple(r) for r in manifest.tamper_checks(table, depth).collect()), key=str)


@pytest.fixture(scope="module")
def rows(spark):
    draw = random.Random(4)
    sources = [None, "", "a", "ab", "é", "中", "hot", "hot", "hot"]
    made = [
        (i, f"line {i}\nsecond\n" * draw.randrange(3), draw.choice(["en", None]), draw.choice(sources), draw.choice([None, i]), "own")
        for i in draw.sample(range(-40, 400), 150)
    ]
    made += [(None, "no id\nat all", "en", "a", 3, "own"), (None, None, None, None, None, "own")]
    made += [made[0], (made[1][0], "another text", "en", made[1][3], 5, "own"), (7_000, "x" * 300_000, "en", "alone", 1, "own")]
    return spark.createDataFrame(
        made, "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string"
    )


@pytest.mark.parametrize("depth", [1, 2, 7])
def test_rows_equal_the_plain_trees(docs, rows, depth):
    assert tampered(rows, depth) == plain(rows.collect())


def test_one_row_and_none(docs):
    one = docs([(3, "a\nb")])
    assert tampered(one) == plain(one.collect())
    built = manifest.build(one)
    assert built.root() == built.leaves.first().digest
    none = docs([])
    assert tampered(none) == [] and manifest.build(none).root() is None


def test_proofs_hold_only_the_siblings(docs, awkward):
    built = manifest.build(awkward)
    for row in manifest.proofs(built).collect():
        at = row.leaf
        for step in row.proof:
            assert (len(step.left) + len(step.right)) // 64 < manifest.ARITY
            at = digest(step.left, at, step.right)
        assert at == row.root == built.root()


def test_missing_nodes_are_few_and_enough():
    draw = random.Random(8)
    for _ in range(300):
        total = draw.randrange(1, 200)
        first = draw.randrange(total)
        last = draw.randrange(first, total)
        have = {(0, i) for i in range(first, last + 1)}
        asked = manifest.missing(first, last, total)
        assert len(set(asked)) == len(asked) and not have & set(asked)
        have |= set(asked)
        size, level = total, 0
        while size > 1:
            for parent in range(manifest.above(size)):
                run = [(level, i) for i in range(3 * parent, min(3 * parent + 3, size))]
                if all(n in have for n in run):
                    # Nothing that can be derived was asked for.
                    assert (level + 1, parent) not in asked
                    have.add((level + 1, parent))
            size, level = manifest.above(size), level + 1
        assert (level, 0) in have


def test_twin(spark, docs, folder):
    mine = queries.QUERIES["op12_merkle_manifest"](spark, folder).toPandas()
    theirs = duck(folder).execute(queries.ORACLES["op12_merkle_manifest"]).df()
    assert len(mine) > 0 and difference(mine, theirs) is None
