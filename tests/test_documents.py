"""Chunking against a plain reading of the packing rules, and evidence."""

from __future__ import annotations

import hashlib
import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assayer.operators import chunking, evidence
from assayer.sources import tables


def pack(pieces, size, overlap):
    """Brute-force packing of (page, text) pieces: lists, no indexes."""
    weight = lambda items: sum(max(1, len(t) // 4) for _, t in items)
    out, open_ = [], []
    for piece in pieces:
        if open_ and weight([*open_, piece]) > size:
            out.append(open_)
            kept = []
            for earlier in reversed(open_):
                if kept and weight([earlier, *kept]) > overlap:
                    break
                kept = [earlier, *kept]
            if overlap == 0:
                kept = []
            open_ = kept[1:] if len(kept) == len(open_) else kept
        open_ = [*open_, piece]
    return out + ([open_] if open_ else [])


def pages_of(seed):
    rng = random.Random(seed)
    return [
        (page, "\n\n".join("w" * rng.randint(1, 60) for _ in range(rng.randint(0, 6))))
        for page in range(1, 8)
    ]


@pytest.mark.parametrize("size, overlap", [(20, 0), (20, 6), (30, 29), (8, 3)])
def test_both_packers_match_brute_force(spark, size, overlap):
    settings = chunking.ChunkSettings(size, overlap)
    documents = {f"D{i}": pages_of(i) for i in range(12)}
    expected = {}
    for name, pages in documents.items():
        pieces = []
        for page, text in pages:
            for block in filter(None, text.split("\n\n")):
                whole = max(1, len(block) // 4) <= size
                step = len(block) if whole else 4 * size
                pieces += [(page, block[i : i + step]) for i in range(0, len(block), step)]
        for i, members in enumerate(pack(pieces, size, overlap)):
            expected[name, i] = (
                "\n\n".join(t for _, t in members), sorted({p for p, _ in members}),
            )
    wide = spark.createDataFrame(
        list(documents.items()), "document_id string, pages array<struct<page_number:int,text:string>>"
    )
    tall = wide.select("document_id", F.inline("pages")).withColumn(
        "tables", F.array().cast("array<array<array<string>>>")
    )
    for chunks in (chunking.chunk_documents(wide, settings), chunking.chunk_pages(tall, settings)):
        got = {(r.document_id, r.ordinal): (r.text, r.page_numbers) for r in chunks.collect()}
        assert got == expected


def test_packing_is_linear_in_the_segments():
    """A document of 100,000 segments, and ten times as many, in about ten times the time."""
    draw = random.Random(2)
    settings = chunking.ChunkSettings(20, 5)
    spent = []
    for n in (100_000, 1_000_000):
        weights = [draw.randint(1, 9) for _ in range(n)]
        started = time.process_time()
        firsts, lasts, _ = chunking.pack(weights, settings)
        spent.append(time.process_time() - started)
        assert lasts[-1] == n - 1 and all(a <= b + 1 for a, b in zip(firsts[1:], lasts))
    assert spent[0] < 2 and spent[1] < 30 * spent[0] + 0.5


def test_open_chunks_go_on_over_batches(spark):
    """Batches of any size give the chunks of one."""
    draw = random.Random(6)
    rows = [(f"D{d}", draw.randint(1, 12)) for d in range(9) for _ in range(draw.choice([1, 3, 60]))]
    table = pa.table(
        {
            "document_id": [d for d, _ in rows],
            "weight": pa.array([w for _, w in rows], pa.int32()),
            "member": [{"text": str(i), "page_number": i, "is_table": False} for i in range(len(rows))],
        }
    )
    for settings in (chunking.ChunkSettings(15, 4), chunking.ChunkSettings(8, 7), chunking.ChunkSettings(5, 0)):
        whole = None
        for size in (1000, 1, 2, 7):
            out = [r for b in chunking._pack_stream(iter(table.to_batches(max_chunksize=size)), settings) for r in b.to_pylist()]
            got = [(r["document_id"], r["ordinal"], [m["page_number"] for m in r["members"]]) for r in out]
            whole = whole or got
            assert got == whole
        assert list(chunking._pack_stream(iter([]), settings)) == []


def test_chunk_id_covers_document_position_and_text(spark):
    row = spark.range(1).select(
        chunking.chunk_id(F.lit("D"), F.lit(12345), F.lit(" a  b ")).alias("x")
    )
    digest = hashlib.sha256("D\x0012345\x00a b".encode()).hexdigest()[:12]
    assert row.first()["x"] == f"D::c12345::{digest}"


def test_tables_become_their_own_segments(spark):
    rows = spark.createDataFrame(
        [("D", 1, "intro", [[["a", "b"], ["1", "2"]]])],
        "document_id string, page_number int, text string, tables array<array<array<string>>>",
    )
    chunk = chunking.chunk_pages(rows).first()
    assert chunk["text"] == "intro\n\na | b\n1 | 2" and chunk["contains_table"]


def test_neighbours_clamp_and_default(spark):
    chunks = spark.createDataFrame(
        [(f"c{i}", "D", i) for i in range(6)], "chunk_id string, document_id string, ordinal int"
    )
    near = chunking.neighbours(chunks, before=9, after=0).filter("chunk_id = 'c4'")
    assert sorted(r.neighbour_id for r in near.collect()) == ["c1", "c2", "c3", "c4", "c5"]


def test_reportable_guard(spark):
    chunks = spark.createDataFrame([("c", "fixture")], "chunk_id string, provenance string")
    with pytest.raises(Exception, match="not reportable"):
        chunking.require_reportable(chunks).collect()


CHUNKS = [("A1", "A", [1, 2]), ("A2", "A", [2, 3]), ("B1", "B", [7])]


def test_evidence_resolution(spark):
    chunks = spark.createDataFrame(CHUNKS, "chunk_id string, document_id string, page_numbers array<int>")
    refs = spark.createDataFrame(
        [("q", r) for r in ("A::p2", "A::p9", "B::p?", "C::p1", "oops")],
        "question_id string, reference string",
    )
    got = {tuple(r) for r in evidence.resolve(refs, chunks).collect()}
    assert got == {
        ("q", "A::p2", "A1", "resolved"),
        ("q", "A::p2", "A2", "resolved"),
        ("q", "A::p9", None, "unresolved"),
        ("q", "B::p?", "B1", "unknown_page"),
        ("q", "C::p1", None, "unknown_document"),
        ("q", "oops", None, "unresolved"),
    }


def results(spark, rows):
    return spark.createDataFrame(
        rows, "question_id string, retriever string, recall double, hit boolean, n_gold int, measurable boolean"
    )


def test_disagreement_golden(spark):
    rows = results(spark, [
        ("1", "a", 1.0, True, 1, True), ("2", "a", 0.0, False, 1, True),
        ("1", "b", 0.0, False, 1, True), ("2", "b", 1.0, True, 1, True),
        ("3", "a", 1.0, True, 1, True), ("3", "b", 0.0, False, 0, False),
    ])
    pair = evidence.disagreement(rows, ["a", "b"]).first()
    assert (pair["both"], pair["a_only"], pair["b_only"], pair["neither"]) == (0, 1, 1, 0)
    assert (pair["disagreement_rate"], pair["complementarity"]) == (1.0, 0.5)
    assert evidence.oracle_hit_rate(rows).first()["oracle_hit_rate"] == 1.0


def test_question_lines(spark):
    lines = spark.createDataFrame(
        [
            ('{"financebench_id": "1", "company": "", "doc_name": "X_2020_10K", "question": " q? ", "answer": "5",'
             ' "evidence": [{"evidence_page_num": 3}, {"evidence_page_num": 3}, {"doc_name": "Y", "evidence_text": "t"}]}',),
            ("  ",), ("{bad",), ('{"company": "C"}',),
        ],
        "line string",
    )
    questions, failures = tables.parse_questions(lines)
    row = questions.first()
    assert (row["question_id"], row["group_key"], row["question_text"]) == ("1", "X_2020_10K", "q?")
    assert row["reference_evidence"] == ["X_2020_10K::p3", "Y::p?"]
    assert sorted(r["reason"] for r in failures.collect()) == ["invalid JSON", "row has no identifier"]


def test_delimited_pages(spark, tmp_path):
    (tmp_path / "DOC.txt").write_text("one \n<<<PAGE>>>\n two\n<<<PAGE>>>\n")
    rows = tables.delimited_documents(spark, str(tmp_path)).orderBy("page_number").collect()
    assert [tuple(r) for r in rows] == [("DOC", 1, "one"), ("DOC", 2, "two"), ("DOC", 3, "")]


def test_split_files_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("dev", "g", "q1"), ("test", "h", "q2")], "split string, group_key string, question_id string")
    tables.write_splits(rows, str(tmp_path / "s"))
    assert sorted(tables.read_splits(spark, str(tmp_path / "s")).collect()) == sorted(rows.collect())
