"""Token ids in raw binary shards, reached by document key through a perfect hash.

Shards hold ids alone, in ascending order of doc_id: a 16-byte head, then the ids
as little-endian integers of two bytes (four where the vocabulary needs them).
Every document ends with ``END_ID``.

The index has one entry per bucket of keys: a minimal perfect hash (levels of bit
arrays, Limasset et al. 2017), which sends each key to a slot of its own, and for
each slot the key's fingerprint, shard, offset and count. A lookup hashes the key,
tests a bit per level, checks the fingerprint and has the place of the ids; a key
that was never stored fails the fingerprint but for 1 in 2**32.

A row's key is (doc_id, ordinal): rows that repeat a doc_id are numbered in the
order of their texts. Rows with a null doc_id come first, in an order by their
texts' hashes, and have keys of their own. Null texts are empty and hold the end id alone.

A shard is written under a name of the task attempt and renamed when it is whole,
so that a rerun task replaces it by the same bytes.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from assayer.llm.bpe import default_path
from assayer.llm.common import ids_and_texts, new_folder, open_folder, stored
from assayer.llm.words import Ragged, WordMemory, blocks
from assayer.session import join_small

END_ID = 2
MAGIC = b"ASSAYIDS"
HEAD = "<8sII"  # magic, version, bytes of an id
HEAD_BYTES = struct.calcsize(HEAD)
#: Mean number of keys in a bucket of the index.
BUCKET_KEYS = 4096
#: Bits per key that is left, in each level of the perfect hash.
LEVEL_LOAD = 2
READ_SPAN = 1 << 22
#: Bytes of text that a shard's task encodes.
SHARD_BYTES = 32 << 20
#: New words that the library gets at once.
WORDS_IN_A_ROW = 2000
ASCII_SPACES = frozenset(c for c in range(0x80) if chr(c).isspace())
NULL_DOC = 0


class LibraryEncoder:
    """Encodes lists of words with the tokenizers library."""

    def __init__(self, path: str, special_as_text: bool = False) -> None:
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = special_as_text
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        # A token's name has one character for each of its bytes.
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.lengths = np.array([len(n) for n in names], dtype=np.int64)
        self.dtype = np.dtype("<u2" if size < 1 << 16 else "<u4")

    def encode_words(self, words: list[bytes]) -> dict[str, Ragged]:
        """Ids of each word. Words that start with one space are encoded side by side.

        A word ends where the next one's space begins, so the ids of many words in a
        row are those of each; they are told apart by their bytes.
        """
        import numpy as np

        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        in_row = np.fromiter(map(_stands_in_a_row, words), dtype=bool, count=len(words))
        found, counts = [], np.zeros(len(words), dtype=np.int64)
        together, alone = np.flatnonzero(in_row), np.flatnonzero(~in_row)
        for start in range(0, len(together), WORDS_IN_A_ROW):
            run = together[start : start + WORDS_IN_A_ROW]
            text = b"".join([words[i] for i in run.tolist()]).decode("utf-8")
            encoded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(encoded[0].ids, dtype=np.int64)
            ends, token_ends = np.cumsum(sizes[run]), np.cumsum(self.lengths[ids])
            cuts = np.searchsorted(token_ends, ends) + 1
            if not np.array_equal(token_ends[cuts - 1], ends):
                raise ValueError("a token crosses the end of a word")
            counts[run] = np.diff(cuts, prepend=0)
            found.append(ids.astype(self.dtype))
        for i in alone.tolist():
            ids = self.tokenizer.encode(words[i].decode("utf-8"), add_special_tokens=False).ids
            counts[i] = len(ids)
            found.append(np.array(ids, dtype=self.dtype))
        order = np.concatenate([together, alone])
        values = np.concatenate(found) if found else np.zeros(0, dtype=self.dtype)
        return {"ids": Ragged(values, counts[order]).take(np.argsort(order))}


def _stands_in_a_row(word: bytes) -> bool:
    """Whether the word starts with one space and ends with no white space."""
    if len(word) < 2 or word[0] != 0x20:
        return False
    if word[1] < 0x80 and word[-1] < 0x80:
        return word[1] not in ASCII_SPACES and word[-1] not in ASCII_SPACES
    text = word.decode("utf-8")
    return not text[1].isspace() and not text[-1].isspace()


_ENCODERS: dict[str, tuple[LibraryEncoder, WordMemory]] = {}


def library(path: str) -> tuple[LibraryEncoder, WordMemory]:
    if path not in _ENCODERS:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        encoder = LibraryEncoder(path)
        _ENCODERS[path] = (encoder, WordMemory(encoder.encode_words))
    return _ENCODERS[path]


def ids_of_texts(texts, memory: WordMemory) -> Iterator:
    """(texts, ids): the number of each text, or part of one, and its ids, in order."""
    import numpy as np

    for block in blocks(texts):
        rows, columns = memory.columns(block)
        ids = columns["ids"].take(rows) if columns else Ragged(np.zeros(0, np.uint16), np.zeros(0, np.int64))
        bounds = ids.bounds()[np.concatenate([[0], np.cumsum(block.words_of)])].tolist()
        for k, owner in enumerate(block.owners.tolist()):
            yield owner, ids.values[bounds[k] : bounds[k + 1]]


def shard_name(number: int) -> str:
    return f"shard-{number:06d}.ids"


def write_shards(docs: DataFrame, folder: str, path: str, shards: int) -> DataFrame:
    """Write the shards; the entries (doc_id, ordinal, shard, offset, n) say where each row is."""

    def write(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        fs = out = None
        offset, last, ordinal = 0, object(), 0
        for batch in batches:
            if out is None:
                encoder, memory = library(path)
                fs, base = open_folder(folder)
                fs.create_dir(base, recursive=True)
                draft = f"{base}/_{shard_name(shard)}.{uuid.uuid4().hex}"
                out = fs.open_output_stream(draft)
                out.write(struct.pack(HEAD, MAGIC, 1, encoder.dtype.itemsize))
                end = np.array([END_ID], dtype=encoder.dtype).tobytes()
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            counts, owner = np.ones(len(keys), dtype=np.int64), 0
            for number, ids in ids_of_texts(batch.column(2), memory):
                for _ in range(owner, number):
                    out.write(end)
                owner = number
                out.write(ids.astype(encoder.dtype, copy=False).data)
                counts[number] += len(ids)
            for _ in range(owner, len(keys)):
                out.write(end)
            ordinals = []
            for key in keys:
                ordinal = ordinal + 1 if key == last else 0
                last = key
                ordinals.append(-1 - ordinal if key[1] else ordinal)
            offsets = offset + np.cumsum(counts) - counts
            offset += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(ordinals, pa.int64()),
                    pa.array([shard] * len(keys), pa.int32()),
                    pa.array(offsets),
                    pa.array(counts),
                ],
                ["doc_id", "ordinal", "shard", "offset", "n"],
            )
        if out is not None:
            out.close()
            fs.move(draft, f"{base}/{shard_name(shard)}")

    keyed = ids_and_texts(docs).select(
        F.coalesce("doc_id", F.lit(NULL_DOC)).alias("key_id"), F.col("doc_id").isNull().alias("is_null"), "text"
    )
    # Nulls first, then ascending ids; one range to a shard. Rows without an id are
    # dealt to ranges by their texts.
    order = [
        F.when(F.col("is_null"), None).otherwise(F.col("key_id")).asc_nulls_first(),
        F.when(F.col("is_null"), F.xxhash64("text")),
    ]
    return (
        keyed.repartitionByRange(shards, *order)
        .sortWithinPartitions(*order, "text")
        .mapInArrow(write, "doc_id bigint, ordinal bigint, shard int, offset bigint, n bigint")
    )


def _mix(values):
    """SplitMix64 finalizer over an array of unsigned 64-bit integers."""
    import numpy as np

    z = values + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def key_hashes(doc_ids, ordinals, seed: int):
    import numpy as np

    ids = np.asarray(doc_ids, dtype=np.int64).view(np.uint64)
    places = np.asarray(ordinals, dtype=np.int64).view(np.uint64)
    return _mix(ids ^ _mix(places + np.uint64(seed)))


def _slots_of(hashes, level: int, size: int):
    import numpy as np

    return (_mix(hashes ^ np.uint64(level * 0x5851F42D4C957F2D % (1 << 64))) % np.uint64(size)).astype(np.int64)


def build_hash(hashes) -> list:
    """Levels of bit arrays; a key's slot is the rank of the first bit it owns alone."""
    import numpy as np

    levels, left = [], hashes
    while len(left):
        size = max(8, LEVEL_LOAD * len(left))
        slots = _slots_of(left, len(levels), size)
        alone = np.bincount(slots, minlength=size) == 1
        levels.append(alone)
        left = left[~alone[slots]]
        if len(levels) > 64:
            raise ValueError("two keys share a 64-bit hash")
    return levels


def find_slots(hashes, levels: list):
    """Slot of each key, -1 where no level has a bit for it."""
    import numpy as np

    found = np.full(len(hashes), -1, dtype=np.int64)
    open_rows = np.arange(len(hashes))
    before = 0
    for number, bits in enumerate(levels):
        slots = _slots_of(hashes[open_rows], number, len(bits))
        hit = bits[slots]
        ranks = np.cumsum(bits) - 1
        found[open_rows[hit]] = before + ranks[slots[hit]]
        open_rows = open_rows[~hit]
        before += int(bits.sum())
    return found


def _pack(levels: list) -> bytes:
    import numpy as np

    head = np.array([len(levels), *map(len, levels)], dtype="<u4").tobytes()
    return head + b"".join(np.packbits(bits).tobytes() for bits in levels)


def _unpack(data: bytes) -> list:
    import numpy as np

    count = int(np.frombuffer(data, "<u4", 1)[0])
    sizes = np.frombuffer(data, "<u4", count, 4).tolist()
    at, levels = 4 + 4 * count, []
    for size in sizes:
        packed = np.frombuffer(data, np.uint8, -(-size // 8), at)
        levels.append(np.unpackbits(packed, count=size).astype(bool))
        at += len(packed)
    return levels


INDEX_SCHEMA = (
    "bucket bigint, seed int, keys int, hash binary, fingerprints binary, shards binary, "
    "offsets binary, counts binary"
)


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("doc_id", "ordinal"), F.lit(buckets).cast("bigint"))


def build_index(entries: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket of keys: its perfect hash and the slots' contents."""

    def build(rows):
        import numpy as np
        import pandas as pd

        for seed in range(16):
            hashes = key_hashes(rows["doc_id"], rows["ordinal"], seed)
            if len(np.unique(hashes)) == len(hashes):
                break
        levels = build_hash(hashes)
        place = np.argsort(find_slots(hashes, levels))
        column = lambda values, kind: np.asarray(values)[place].astype(kind).tobytes()
        return pd.DataFrame(
            [
                (
                    rows["bucket"].iloc[0],
                    seed,
                    len(rows),
                    _pack(levels),
                    column(hashes & np.uint64(0xFFFFFFFF), "<u4"),
                    column(rows["shard"], "<u4"),
                    column(rows["offset"], "<u8"),
                    column(rows["n"], "<u4"),
                )
            ],
            columns=[c.split(" ")[0] for c in INDEX_SCHEMA.split(", ")],
        )

    return entries.withColumn("bucket", _bucket(buckets)).groupBy("bucket").applyInPandas(build, INDEX_SCHEMA)


def look_up(keys: DataFrame, index: DataFrame, buckets: int) -> DataFrame:
    """Where the ids of each key (doc_id, ordinal) are; keys that are not stored give no row."""

    def find(wanted, bucket):
        import numpy as np
        import pandas as pd

        columns = ["doc_id", "ordinal", "shard", "offset", "n"]
        if not len(wanted) or not len(bucket):
            return pd.DataFrame(columns=columns)
        entry = bucket.iloc[0]
        hashes = key_hashes(wanted["doc_id"], wanted["ordinal"], int(entry["seed"]))
        slots = find_slots(hashes, _unpack(entry["hash"]))
        prints = np.frombuffer(entry["fingerprints"], "<u4")
        known = (slots >= 0) & (prints[np.maximum(slots, 0)] == (hashes & np.uint64(0xFFFFFFFF)))
        rows, slots = wanted[known], slots[known]
        return pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "ordinal": rows["ordinal"].to_numpy(),
                "shard": np.frombuffer(entry["shards"], "<u4")[slots].astype(np.int32),
                "offset": np.frombuffer(entry["offsets"], "<u8")[slots].astype(np.int64),
                "n": np.frombuffer(entry["counts"], "<u4")[slots].astype(np.int64),
            }
        )

    return (
        keys.select("doc_id", "ordinal")
        .withColumn("bucket", _bucket(buckets))
        .groupBy("bucket")
        .cogroup(index.groupBy("bucket"))
        .applyInPandas(find, "doc_id bigint, ordinal bigint, shard int, offset bigint, n bigint")
    )


def read_ids(places: DataFrame, folder: str, tasks: int) -> DataFrame:
    """The ids at each place, read from the shards: the columns of ``places`` and ids_crc32."""
    schema = places.schema.simpleString()[len("struct<") : -1].replace(":", " ") + ",ids_crc32 bigint"

    def read(batches: Iterator) -> Iterator:
        import numpy as np

        fs, base = open_folder(folder)
        shard, file, width = None, None, 0
        for batch in batches:
            sums = []
            for number, offset, n in zip(batch["shard"], batch["offset"], batch["n"], strict=True):
                if number != shard:
                    if file is not None:
                        file.close()
                    shard, file = number, fs.open_input_file(f"{base}/{shard_name(number)}")
                    magic, _, width = struct.unpack(HEAD, file.read(HEAD_BYTES))
                    if magic != MAGIC:
                        raise ValueError(f"{shard_name(number)} is not a shard of ids")
                file.seek(HEAD_BYTES + int(offset) * width)
                data = file.read(int(n) * width)
                if len(data) != n * width:
                    raise ValueError(f"{shard_name(number)} ends early")
                sums.append(zlib.crc32(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes()))
            yield batch.assign(ids_crc32=np.array(sums, dtype=np.int64))
        if file is not None:
            file.close()

    # By the number of ids, not of the rows that name them.
    span = F.expr(f"offset div {READ_SPAN}")
    return places.repartition(tasks, "shard", span).sortWithinPartitions("shard", "offset").mapInPandas(read, schema)


class TokenStore:
    """Shards and index in one folder."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    @classmethod
    def write(cls, docs: DataFrame, folder: str | None = None, path: str | None = None) -> TokenStore:
        spark = docs.sparkSession
        folder = folder or new_folder(spark, "token-store")
        size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
        shards = max(1, -(-size // SHARD_BYTES))
        written = stored(
            write_shards(docs, f"{folder}/shards", path or default_path(), shards), "token-entries"
        )
        # Ids, and rows without a doc_id, before each shard: one row per shard.
        totals = written.groupBy("shard").agg(
            F.sum("n").alias("total"), F.count_if(F.col("ordinal") < 0).alias("unnamed")
        )
        earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
        totals.select(
            "shard",
            "total",
            F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"),
            F.coalesce(F.sum("unnamed").over(earlier), F.lit(0)).alias("unnamed_before"),
        ).coalesce(1).write.parquet(f"{folder}/bases")
        bases = spark.read.parquet(f"{folder}/bases").select("shard", "unnamed_before")
        ordinal = F.when(F.col("ordinal") < 0, F.col("ordinal") - F.col("unnamed_before")).otherwise(F.col("ordinal"))
        entries = join_small(written, bases, "shard").withColumn("ordinal", ordinal).drop("unnamed_before")
        buckets = max(1, -(-written.count() // BUCKET_KEYS))
        build_index(entries, buckets).write.parquet(f"{folder}/index")
        return cls(spark, folder, buckets)

    def read(self, keys: DataFrame) -> DataFrame:
        """start, n_tokens and ids_crc32 of each key (doc_id, ordinal) that is stored."""
        index = self.spark.read.parquet(f"{self.folder}/index")
        bases = self.spark.read.parquet(f"{self.folder}/bases")
        total = bases.agg(F.coalesce(F.max(F.col("before") + F.col("total")), F.lit(0))).first()[0]
        places = look_up(keys, index, self.buckets)
        found = read_ids(places, f"{self.folder}/shards", max(1, -(-total // READ_SPAN)))
        return found.join(bases, "shard").select(
            F.when(F.col("ordinal") >= 0, F.col("doc_id")).alias("doc_id"),
            (F.col("before") + F.col("offset")).alias("start"),
            F.col("n").alias("n_tokens"),
            "ids_crc32",
        )


def keys_of(docs: DataFrame) -> DataFrame:
    """The key (doc_id, ordinal) of every row."""
    counted = docs.groupBy(F.col("doc_id").cast("bigint").alias("id")).agg(F.count("*").alias("rows"))
    numbers = F.sequence(F.lit(0).cast("bigint"), F.col("rows") - 1)
    return counted.select("id", F.explode(numbers).alias("k")).select(
        F.coalesce("id", F.lit(NULL_DOC)).alias("doc_id"),
        F.when(F.col("id").isNull(), -1 - F.col("k")).otherwise(F.col("k")).alias("ordinal"),
    )
