"""Files written and read back: line numbers, the response store, frozen splits."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from assayer.sources import lines, responses, splits


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_lines_have_their_numbers_in_cut_files(spark, tmp_path, small_blocks):
    texts = {
        "a.jsonl": [f"line {i} " + "x" * (i * 37 % 90) for i in range(200)],
        "b.jsonl": ["", "one", "", "two"],
        "empty.jsonl": [],
        "c.jsonl": ["y" * 3000, "after a long one"],
    }
    for name, listed in texts.items():
        (tmp_path / name).write_text("".join(line + "\n" for line in listed))
    read = lines.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).select(F.spark_partition_id()).distinct().count() > 10
    got = {(os.path.basename(r.file), r.line_number): r.line for r in read.collect()}
    assert got == {(n, i): line for n, listed in texts.items() for i, line in enumerate(listed, 1)}


def test_failures_name_their_line(spark, tmp_path, small_blocks):
    good = '{"financebench_id": "%d", "question": "q"}'
    listed = [good % i if i % 9 else "{bad" if i % 2 else '{"company": "C"}' for i in range(1, 100)]
    (tmp_path / "q.jsonl").write_text("\n".join(["", *listed]))
    questions, failures = lines.load_questions(spark, str(tmp_path))
    want = {f"line {i + 1}: {'invalid JSON' if i % 2 else 'row has no identifier'}" for i in range(9, 100, 9)}
    assert {r.message for r in failures.collect()} == want
    assert questions.count() == 99 - len(want)


def given(spark, rows):
    return spark.createDataFrame(rows, "cache_key string, n int, text string, finish_reason string")


def test_store_keeps_the_first_and_adds_nothing_twice(spark, tmp_path):
    path = str(tmp_path / "store")
    assert responses.read(spark, path) is None
    first = given(spark, [("00a", 2, "later", "stop"), ("00a", 1, "first", "stop"), ("01b", 1, "cut", "length")])
    assert responses.insert(first, path, "n") == 1
    assert responses.insert(first, path, "n") == 0
    more = given(spark, [("00a", 0, "too late", None), ("01b", 3, "whole", None), ("ffc", 1, None, "tool")])
    assert responses.insert(more, path, "n") == 2
    held = {(r.cache_key, r.text, r.shard, r.sequence) for r in responses.read(spark, path).collect()}
    assert held == {("00a", "first", "00", 1), ("01b", "whole", "01", 3), ("ffc", None, "ff", 3)}
    asked = spark.createDataFrame([("01b",), ("zz",)], "cache_key string")
    assert {(r.cache_key, r.text, r.from_cache) for r in responses.look_up(asked, path).collect()} == {
        ("01b", "whole", True), ("zz", None, False),
    }


def test_an_insert_without_its_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "store")
    responses.insert(given(spark, [("aa1", 1, "seen", "stop")]), path, "n")
    lost = given(spark, [("aa2", 1, "unseen", "stop")]).withColumn("shard_of", F.lit("xaa")).withColumn("batch", F.lit("dead"))
    lost.write.mode("append").partitionBy("batch", "shard_of").parquet(f"{path}/data")
    assert [r.cache_key for r in responses.read(spark, path).collect()] == ["aa1"]
    # Its key is not taken for stored either.
    assert responses.insert(given(spark, [("aa2", 2, "again", "stop")]), path, "n") == 1


def assigned(spark, n):
    return spark.range(n).select(
        F.format_string("q%04d", "id").alias("question_id"),
        F.concat(F.lit("g"), F.col("id") % 7).alias("group_key"),
        F.get(F.array(F.lit("dev"), F.lit("test"), F.lit("dev"), F.lit("validation")), (F.col("id") % 7 % 4)).alias("split"),
    )


def test_frozen_split_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(splits, "SHARD_ROWS", 60)
    rows, path = assigned(spark, 500), str(tmp_path / "frozen")
    splits.write_frozen(rows, path, "finance", "v1", "company", 13)
    files = [f for f in os.listdir(f"{path}/shards") if f.endswith(".json")]
    assert len(files) > 5
    for name in files:
        for split_lists in json.loads(open(f"{path}/shards/{name}").read()).values():
            assert all(keys == sorted(keys) and len(keys) <= 120 for keys in split_lists.values())
    got = splits.read_questions(spark, f"{path}/shards")
    assert sorted(got.collect()) == sorted(rows.select("question_id", "split").collect())
    assert sorted(splits.read_groups(spark, f"{path}/shards").collect()) == sorted(
        rows.select("group_key", "split").distinct().collect()
    )
    header = splits.read_header(spark, path).first()
    assert (header.dataset, header.dataset_version, header.group_by, header.seed) == ("finance", "v1", "company", 13)
    assert sum(header.counts.values()) == 500 and sum(header.group_counts.values()) == 7
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        splits.write_frozen(rows, path, "finance", "v2", "company", 14)


def test_one_nested_document_is_read_alike(spark, tmp_path):
    whole = {"dataset": "d", "seed": 1, "counts": {"dev": 2}, "splits": {"dev": ["a", "b"], "test": ["c"]}, "groups": {"dev": ["g"]}}
    (tmp_path / "splits.json").write_text(json.dumps(whole, indent=2))
    path = str(tmp_path / "splits.json")
    assert sorted(map(tuple, splits.read_questions(spark, path).collect())) == [("a", "dev"), ("b", "dev"), ("c", "test")]
    assert [tuple(r) for r in splits.read_groups(spark, path).collect()] == [("g", "dev")]
