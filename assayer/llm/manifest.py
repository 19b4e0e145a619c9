"""Merkle manifest of a table, with membership proofs made a partition at a time.

A row's leaf is a hash of its fields. The leaves of one source ascend by doc_id
and form a tree: while several nodes remain, every ``ARITY`` consecutive ones
become the hash of their digests. The sources' roots, ordered by source, form
one more tree of the same kind, whose root stands for the whole table.

Only digests move. Leaves are ranked by ranges of (source, doc_id), so that a
source of any size is spread over the tasks; a range adds the number of leaves
before it. The ``ARITY ** DEPTH`` leaves under one node are a leaf partition, whose subtree one
task folds; its apex alone goes on to the next ``DEPTH`` levels.

Proofs are octopus multiproofs: a leaf partition names the coordinates of the
nodes that its leaves' paths need and that it cannot derive (``missing``), fetches
each once, derives what the paths share, and expands every leaf's own proof from
that.

Null fields are part of the leaf. A null source is a source of its own, before all
others; null doc_ids come first in theirs. Rows that repeat a doc_id are leaves of
their own, in the order of their leaf digests; equal rows are equal leaves, in any
order. Columns that are not fields are ignored. An empty table has no rows and no
root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from assayer.llm.common import stored
from assayer.session import join_small

ARITY = 3
#: Levels that one task folds at once.
DEPTH = 7
FIELDS = {"doc_id": "bigint", "source": "string", "lang": "string", "n_chars": "bigint", "text": "string"}
#: Names of trees: that of the sources' roots; other trees have another first letter.
TOP = "top"
NODE_SCHEMA = "tree string, level int, idx bigint, digest string, total bigint, apex boolean"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 in hex of the fields: ``-`` for null, else length in bytes, colon and value."""
    parts = []
    for name in FIELDS:
        value = fields[name].cast(FIELDS[name]).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def digest_of(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def above(size: int) -> int:
    """Number of nodes on the level above ``size`` nodes."""
    return -(-size // ARITY)


def fold(digests: list[str], levels: int) -> list[list[str]]:
    """The nodes of each level from the given ones up."""
    found = [digests]
    for _ in range(levels):
        below = found[-1]
        found.append([digest_of(below[i : i + ARITY]) for i in range(0, len(below), ARITY)])
    return found


def levels_to_fold(total: int, depth: int) -> int:
    """Levels above ``total`` nodes up to their root, ``depth`` at most."""
    levels = 0
    while total > 1 and levels < depth:
        total, levels = above(total), levels + 1
    return levels


def missing(first: int, last: int, total: int) -> list[tuple[int, int]]:
    """(level, index) of the nodes that a proof for leaves first..last of ``total`` needs.

    Nothing is listed that the leaves themselves give, and nothing twice.
    """
    found, level = [], 0
    while total > 1:
        start = first - first % ARITY
        end = min(last - last % ARITY + ARITY, total)
        found += [(level, i) for i in (*range(start, first), *range(last + 1, end))]
        first, last, total, level = first // ARITY, last // ARITY, above(total), level + 1
    return found


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``idx``, the place in their tree by ``order``, and ``total``, the tree's size."""

    def number(batches: Iterator) -> Iterator:
        from pyspark import TaskContext

        part, tree, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            # Rows of a tree stand together, and a batch continues the one before.
            local = batch.groupby("tree", sort=False).cumcount().to_numpy().astype("int64")
            if len(batch):
                same = (batch["tree"] == tree).to_numpy()
                local[same] += seen
                tree, seen = batch["tree"].iloc[-1], int(local[-1]) + 1
            yield batch.assign(part=part, local=local)

    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes) + ", part int, local bigint"
    numbered = stored(
        rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).mapInPandas(number, schema),
        "manifest-ranks",
    )
    # One row for each range and tree in it.
    counts = numbered.groupBy("tree", "part").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("tree")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        "tree",
        "part",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
        F.sum("n").over(whole).alias("total"),
    )
    return (
        join_small(numbered, bases, ["tree", "part"])
        .withColumn("idx", F.col("base") + F.col("local"))
        .drop("part", "local", "base")
    )


def part_of(idx: str, depth: int) -> Column:
    """The leaf partition of a place: its ancestor ``depth`` levels up."""
    return F.expr(f"{idx} div {ARITY**depth}")


def _folded(nodes: DataFrame, with_leaves: bool, depth: int) -> DataFrame:
    """What tasks fold from ``nodes`` (tree, level, idx, digest, total), those with one ancestor each."""

    def build(rows):
        import pandas as pd

        rows = rows.sort_values("idx")
        tree, level, total = rows["tree"].iloc[0], int(rows["level"].iloc[0]), int(rows["total"].iloc[0])
        first, found = int(rows["idx"].iloc[0]), []
        folded = fold(rows["digest"].tolist(), levels_to_fold(total, depth))
        for step, digests in enumerate(folded):
            top = step == len(folded) - 1
            if step or with_leaves or top:
                found += [(tree, level + step, first + i, d, total, top) for i, d in enumerate(digests)]
            first, total = first // ARITY, above(total)
        return pd.DataFrame(found, columns=["tree", "level", "idx", "digest", "total", "apex"])

    return (
        nodes.select("tree", "level", "idx", "digest", "total", part_of("idx", depth).alias("part"))
        .groupBy("tree", "part")
        .applyInPandas(lambda rows: build(rows), NODE_SCHEMA)
    )


def tree_nodes(leaves: DataFrame, depth: int, with_leaves: bool = False) -> DataFrame:
    """Nodes from the leaf partitions' apexes up; all of them from the leaves up on demand.

    One round folds ``depth`` levels: the largest tree's levels, divided by that, are
    the rounds.
    """
    found = stored(_folded(leaves.withColumn("level", F.lit(0)), with_leaves, depth), "manifest-nodes")
    if not with_leaves:
        found = found.where("apex")
    current = found.where("apex and total > 1")
    while current.limit(1).count():
        upper = stored(_folded(current, False, depth), "manifest-nodes")
        found = found.unionByName(upper)
        current = upper.where("apex and total > 1")
    return found


@dataclass
class Manifest:
    """``leaves``: one row per document with its place; ``nodes``: digests above the leaf partitions;
    ``trees``: each source's root, and its place among the sources."""

    leaves: DataFrame
    nodes: DataFrame
    trees: DataFrame
    #: Levels inside a leaf partition.
    depth: int

    def root(self) -> str | None:
        """The digest of the whole table; None of an empty one."""
        row = self.nodes.where((F.col("tree") == TOP) & (F.col("total") == 1)).select("digest").first()
        return row[0] if row else None


def build(docs: DataFrame, altered: dict[str, Column] | None = None, depth: int = DEPTH) -> Manifest:
    """The manifest of ``docs``. ``altered`` replaces fields in a second leaf, ``other_leaf``,
    that is no part of the tree and only kept to be held against it."""
    own = {name: docs[name] for name in FIELDS}
    source = own["source"].cast("string")
    columns = [
        F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("tree"),
        own["doc_id"].cast("bigint").alias("doc_id"),
        leaf_digest(own).alias("digest"),
    ]
    if altered:
        columns.append(leaf_digest({**own, **altered}).alias("other_leaf"))
    leaves = stored(ranked(stored(docs.select(*columns), "manifest-leaves"), ["doc_id", "digest"]), "manifest-places")
    nodes = tree_nodes(leaves, depth)
    roots = nodes.where("total = 1").select("digest", F.lit(TOP).alias("tree"), F.col("tree").alias("name"))
    trees = stored(ranked(stored(roots, "manifest-roots"), ["name"]), "manifest-trees")
    return Manifest(leaves, nodes.unionByName(tree_nodes(trees, depth, with_leaves=True)), trees, depth)


def _requests(manifest: Manifest) -> DataFrame:
    """(tree, part, of, level, idx): the nodes that each leaf partition must fetch."""

    depth, span = manifest.depth, ARITY**manifest.depth

    def name(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            found = []
            for tree, part, total, place, trees in batch.itertuples(index=False, name=None):
                apexes = -(-total // span)
                found += [(tree, part, tree, depth + level, i) for level, i in missing(part, part, apexes)]
                found += [(tree, part, TOP, level, i) for level, i in missing(place, place, trees)]
            yield pd.DataFrame(found, columns=["tree", "part", "of", "level", "idx"])

    places = manifest.trees.select(
        F.col("name").alias("tree"), F.col("idx").alias("place"), F.col("total").alias("trees")
    )
    parts = manifest.leaves.select("tree", part_of("idx", depth).alias("part"), "total").distinct()
    return join_small(parts, places, "tree").mapInPandas(
        name, "tree string, part bigint, of string, level int, idx bigint"
    )


def proofs(manifest: Manifest) -> DataFrame:
    """Every leaf's own proof: the leaf's columns, subroot, root and ``proof``.

    ``proof`` has one entry for each level up to the root: the digests of the
    siblings to the left and those to the right, each joined to one text.
    """
    known = manifest.nodes.select(F.col("tree").alias("of"), "level", "idx", "digest")
    fetched = join_small(_requests(manifest), known, ["of", "level", "idx"])
    places = manifest.trees.select(
        F.col("name").alias("tree"), F.col("idx").alias("place"), F.col("total").alias("trees")
    )
    leaves = join_small(
        manifest.leaves.withColumn("part", part_of("idx", manifest.depth)).withColumn("leaf", F.col("digest")),
        places,
        "tree",
    )
    kept = [name for name in leaves.columns if name in ("doc_id", "leaf", "other_leaf")]
    depth, span = manifest.depth, ARITY**manifest.depth

    def expand(rows, nodes):
        import pandas as pd

        rows = rows.sort_values("idx", kind="stable")
        nodes = {
            (of, level, i): digest
            for of, level, i, digest in zip(nodes["of"], nodes["level"], nodes["idx"], nodes["digest"], strict=True)
        }
        tree, part, total = rows["tree"].iloc[0], int(rows["part"].iloc[0]), int(rows["total"].iloc[0])
        folded = fold(rows["leaf"].tolist(), levels_to_fold(total, depth))

        def climb(of, level, index, size, digest):
            """The path's entries from a node to its tree's root, and that root."""
            path = []
            while size > 1:
                start = index - index % ARITY
                sides = [
                    "".join(nodes[of, level, i] for i in side)
                    for side in (range(start, index), range(index + 1, min(start + ARITY, size)))
                ]
                path.append({"left": sides[0], "right": sides[1]})
                digest = digest_of([sides[0], digest, sides[1]])
                level, index, size = level + 1, index // ARITY, above(size)
            return path, digest

        apex = folded[-1][0]
        path, subroot = climb(tree, depth, part, -(-total // span), apex)
        to_root, root = climb(TOP, 0, int(rows["place"].iloc[0]), int(rows["trees"].iloc[0]), subroot)
        shared = path + to_root
        sides = [
            [
                {
                    "left": "".join(level[i - i % ARITY : i]),
                    "right": "".join(level[i + 1 : i - i % ARITY + ARITY]),
                }
                for i in range(len(level))
            ]
            for level in folded[:-1]
        ]
        found = []
        for i in range(len(rows)):
            at, own = i, []
            for level in sides:
                own.append(level[at])
                at //= ARITY
            found.append(own + shared)
        return rows[kept].assign(subroot=subroot, root=root, proof=found)

    kinds = dict(leaves.dtypes)
    schema = ", ".join(f"{name} {kinds[name]}" for name in kept)
    return (
        leaves.groupBy("tree", "part")
        .cogroup(fetched.groupBy("tree", "part"))
        .applyInPandas(
            lambda rows, nodes: expand(rows, nodes),
            f"{schema}, subroot string, root string, proof array<struct<left:string,right:string>>",
        )
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256 of all siblings, level by level and left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda p: F.concat(p["left"], p["right"])), ""), 256)


def folded_root(leaf: Column, proof: Column) -> Column:
    """The root that this leaf and this proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, p: F.sha2(F.concat(p["left"], digest, p["right"]), 256))


def tamper_checks(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Proofs of all rows, held against rows of which half have lost their line breaks.

    Rows whose doc_id has an even CRC-32 are altered; a null doc_id has none.
    """
    doc_id = docs["doc_id"].cast("bigint").cast("string")
    text = docs["text"].cast("string")
    even = F.coalesce(F.crc32(doc_id.cast("binary")) % 2 == 0, F.lit(False))
    stripped = F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)
    manifest = build(docs, {"text": stripped}, depth)
    return proofs(manifest).select(
        "doc_id",
        "leaf",
        "subroot",
        "root",
        proof_digest(F.col("proof")).alias("proof_sha256"),
        folded_root(F.col("other_leaf"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
