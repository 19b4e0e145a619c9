"""Tokens, shards and archives against the libraries and exact round trips."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from assayer.llm import bpe, chunks, token_store, warc, words

PARTS = [*"abcdeth  \n\t'.,s1", "é", "½", "中", "🙂", "\xa0", " ", "\x85", "\x1c", "<|endoftext|>", "'ll", " the", "\n\n", " un"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def odd_texts():
    draw = random.Random(19)
    texts = ["".join(draw.choice(PARTS) for _ in range(draw.randint(0, 50))) for _ in range(3000)]
    return [*texts, "", " ", "a", " a ", "a\0b \0b", "xy " * 3000, "z" * 500]


def test_encoders_agree_with_the_library(tokenizer, odd_texts, monkeypatch):
    want = [e.ids for e in tokenizer.encode_batch(odd_texts, add_special_tokens=False)]
    monkeypatch.setattr(chunks, "BLOCK_CHARS", 700)
    monkeypatch.setattr(chunks, "MEMORY_ENTRIES", 100)
    monkeypatch.setattr(bpe, "WORDS_REMEMBERED", 100)
    own = bpe.Vocabulary(bpe.default_path())
    got = [np.frombuffer(b, "<u4").tolist() for b in chunks.Memory(own.encode_all).encode(odd_texts)]
    assert got == want
    assert [own.decode(ids) for ids in want] == [tokenizer.decode(i, skip_special_tokens=False) for i in want]
    assert own.decode([255, 200, 50256]) == tokenizer.decode([255, 200, 50256], skip_special_tokens=False)
    library = token_store.LibraryEncoder(bpe.default_path())
    stored = [[] for _ in odd_texts]
    for owner, ids in token_store.ids_of_texts(pa.array(odd_texts), words.WordMemory(library.encode_words)):
        stored[owner].extend(ids.tolist())
    assert stored == want


def test_encoded_rows(awkward, tokenizer):
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(awkward).collect()}
    want = set()
    for r in awkward.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(decoded)))
    assert got == want


def test_store_round_trip(awkward, tokenizer):
    keys = token_store.keys_of(awkward)
    assert keys.count() == awkward.count()
    store = token_store.TokenStore.write(awkward)
    got = sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in store.read(keys).collect()), key=lambda r: r[1])
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    want, start = [], 0
    for r in rows:
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, token_store.END_ID]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    spark = awkward.sparkSession
    strange = spark.createDataFrame([(i, 0) for i in range(10_000, 10_500)], "doc_id bigint, ordinal bigint")
    assert store.read(strange).count() == 0


def test_rows_without_an_id_are_spread(docs, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 1 << 11)
    table = docs([(None, f"text {i % 90} of none") for i in range(400)] + [(i, f"text {i}") for i in range(40)])
    store = token_store.TokenStore.write(table)
    spark = table.sparkSession
    assert spark.read.parquet(f"{store.folder}/bases").count() > 2
    rows = store.read(token_store.keys_of(table)).collect()
    starts = sorted((r.start, r.n_tokens) for r in rows)
    assert len(rows) == 440 and sum(r.doc_id is None for r in rows) == 400
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_empty_store(docs):
    none = docs([])
    assert token_store.TokenStore.write(none).read(token_store.keys_of(none)).count() == 0
    assert bpe.encoded(none).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_perfect_hash_is_minimal(n):
    hashes = token_store.key_hashes(np.arange(n) * 7 - 3, np.zeros(n, dtype=np.int64), 0)
    levels = token_store._unpack(token_store._pack(token_store.build_hash(hashes)))
    assert sorted(token_store.find_slots(hashes, levels).tolist()) == list(range(n))


def archive_rows(spark):
    big, other = "x" * 1200, "é" * 500 + "\r\n\r\nWARC/1.1"
    rows = [(1, "http://a", big), (2, "http://b b\n", big), (9, None, big), (3, "u", "tiny"), (4, "u", "tiny")]
    rows += [(5, "u", None), (6, "u", ""), (7, "u", other), (7, "u", other), (8, "u", other), (None, "u", big)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string"), rows


def test_archive_round_trip(spark, docs, monkeypatch):
    pages, rows = archive_rows(spark)
    index, bundles = warc.archive(pages)
    got = sorted((tuple(r) for r in warc.read_records(index, bundles).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [i for i, _, h in rows if (h or "").encode() == data and i is not None]
        revisit = len(data) >= 1000 and same and page_id != max(same)
        kind = "revisit" if revisit else "response"
        want.append((page_id, len(data), hashlib.sha1(data).hexdigest(), kind, max(same) if revisit else None))
    assert got == sorted(want, key=str)


def test_bundles_are_seekable_and_plain_zstandard(spark, docs):
    import glob
    import io

    import zstandard

    pages, rows = archive_rows(spark)
    index, bundles = warc.archive(pages)
    sizes = 0
    for path in glob.glob(bundles.removeprefix("file://").replace("file:", "") + "/*.zst"):
        with open(path, "rb") as file:
            data = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(file.read()), read_across_frames=True).read()
        sizes += data.count(b"WARC-Record-ID: ")
    assert sizes == len(rows) == index.count()


def test_frames_are_cut_and_found(tmp_path):
    writer = warc.BundleWriter(f"file://{tmp_path}", "one.warc.zst")
    records = [warc.record(i, "u", bytes([i % 256]) * 50_000, None) for i in range(30)]
    places = [writer.add(r) for r in records]
    writer.close()
    reader = warc.BundleReader(f"file://{tmp_path}", "one.warc.zst")
    assert len(reader.frames) > 4
    for (frame, offset, length), r in reversed(list(zip(places, records, strict=True))):
        assert reader.frame(frame)[offset : offset + length] == r
