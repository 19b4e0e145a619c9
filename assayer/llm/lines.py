"""Near-duplicate lines, found by joining deletion neighbourhoods.

A line is its words (separated by white space). Two lines are equal up to the
bound if one insertion, deletion or substitution of a word turns one into the
other and that is at most a fifth of the longer line's words (similarity 0.8):
lines under five words must be equal. Every line that has an earlier line equal
up to the bound goes; "earlier" is by (doc_id, line_no), and the earlier line
need not itself stay. Blank lines are never duplicates.

All variants of a line with one word left out are emitted as hashed keys and
equal keys are joined, each with the earliest line at its key. Keys that carry
the place of the missing word make every member of a group differ from every
other by one substitution, so that the earliest member alone decides and no
bucket is expanded into pairs. The distance of each decided pair is verified.

Variants need not be made for lines that cannot have a partner: if two lines are
one edit apart, they share their first or their last h words, where h is at most
half of the shorter one. Only lines that share such a half emit variants, and
only for places outside it. That filter loses nothing.

Rows with a null doc_id take no part. Rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.common import ids_and_texts, stored

#: The longer line of a pair that differs by one word has at least so many words.
LEAST_WORDS = 5
#: Place of the variant that leaves nothing out.
WHOLE = -1
PREFIX, SUFFIX = 1, 2


def shared_half(words: int) -> int:
    """Words of a half, at most half of ``words``, on a coarse grid.

    Rounding down to 2, 3, 4, 6, 8, 12, ... lets lines of n and n - 1 words have
    the same half but where the grid steps.
    """
    half = words // 2
    power = 1 << (half.bit_length() - 1)
    return power + power // 2 if half >= power + power // 2 else power


def half_keys(words: list[bytes]) -> dict[int, tuple[int, int]]:
    """Hash of each half that a line may share -> (PREFIX or SUFFIX, words of the half)."""
    import xxhash

    keys = {}
    for shorter in (len(words), len(words) - 1):
        if shorter >= LEAST_WORDS - 1:
            h = shared_half(shorter)
            for side, part in ((PREFIX, words[:h]), (SUFFIX, words[-h:])):
                value = xxhash.xxh64_intdigest(b" ".join(part), 4 * h + side)
                keys[value - (1 << 63)] = (side, h)
    return keys


def _words(line: str) -> list[bytes]:
    return line.encode("utf-8").split()


def occurrences(docs: DataFrame) -> DataFrame:
    """Every line that is not blank: key (128-bit hash of its words), place, halves."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                for line_no, line in enumerate(text.split("\n")):
                    if words := _words(line):
                        key = xxhash.xxh3_128_digest(b" ".join(words))
                        rows.append((key, doc_id, line_no, list(half_keys(words))))
            yield pd.DataFrame(rows, columns=["key", "doc_id", "line_no", "halves"])

    return (
        ids_and_texts(docs)
        .where("doc_id is not null")
        .mapInPandas(run, "key binary, doc_id bigint, line_no int, halves array<bigint>")
    )


def distinct_lines(places: DataFrame) -> DataFrame:
    """One row for each line text: key, first (doc_id, line_no), times, halves."""
    return places.groupBy("key").agg(
        F.min(F.struct("doc_id", "line_no")).alias("first"),
        F.count("*").alias("times"),
        F.min("halves").alias("halves"),
    )


def _tied(lines: DataFrame) -> DataFrame:
    """Lines that share a half with another line: key, first, tied (hashes of those halves)."""
    halves = lines.select("key", "first", F.explode("halves").alias("half"))
    shared = (
        halves.groupBy("half")
        .agg(F.min("key").alias("a"), F.max("key").alias("b"))
        .where("a <> b")
        .select("half")
    )
    return halves.join(shared, "half").groupBy("key", "first").agg(F.collect_set("half").alias("tied"))


def _neighbourhoods(docs: DataFrame, tied: DataFrame) -> DataFrame:
    """Variants of tied lines: variant hash, place of the missing word, key and place of the line."""
    found = tied.select(
        F.col("first.doc_id").alias("at_doc"), F.col("first.line_no").alias("line_no"), "key", "tied"
    )
    wanted = found.groupBy("at_doc").agg(
        F.collect_list(F.struct("line_no", "key", "tied")).alias("wanted")
    )
    texts = ids_and_texts(docs)

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text, lines in zip(batch["doc_id"], batch["text"], batch["wanted"], strict=True):
                content = text.split("\n")
                for line in lines:
                    if line["line_no"] >= len(content):
                        continue
                    words = _words(content[line["line_no"]])
                    if xxhash.xxh3_128_digest(b" ".join(words)) != line["key"]:
                        continue  # another row with this id
                    for place in _places(words, set(line["tied"])):
                        rest = words if place == WHOLE else words[:place] + words[place + 1 :]
                        value = xxhash.xxh64_intdigest(b" ".join(rest), len(rest)) - (1 << 63)
                        rows.append((value, place, line["key"], doc_id, line["line_no"]))
                    if len(rows) >= 200_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    columns = ["variant", "place", "key", "doc_id", "line_no"]
    return (
        texts.join(wanted, texts["doc_id"] == wanted["at_doc"])
        .select("doc_id", "text", "wanted")
        .mapInPandas(run, "variant bigint, place int, key binary, doc_id bigint, line_no int")
    )


def _places(words: list[bytes], tied: set[int]) -> list[int]:
    """Places whose word is left out: those that lie outside a half shared with another line."""
    outside = {WHOLE}
    for value, (side, h) in half_keys(words).items():
        if value in tied and len(words) >= LEAST_WORDS:
            outside.update(range(h, len(words)) if side == PREFIX else range(len(words) - h))
    return sorted(outside)


def earlier_neighbours(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(key, earlier): for line texts with an earlier one a word away, the earliest such place."""
    variants = _neighbourhoods(docs, _tied(lines))
    variants = stored(
        variants.select("variant", "place", "key", F.struct("doc_id", "line_no").alias("first")),
        "line-variants",
    )
    met = (
        variants.groupBy("variant")
        .agg(F.min("key").alias("a"), F.max("key").alias("b"))
        .where("a <> b")
        .select("variant")
    )
    members = stored(variants.join(met, "variant", "left_semi"), "line-variants-met")
    by_place = members.groupBy("variant", "place").agg(F.min(F.struct("first", "key")).alias("least"))
    whole = by_place.where(F.col("place") == WHOLE).select("variant", "least")
    longer = by_place.where(F.col("place") != WHOLE).groupBy("variant").agg(F.min("least").alias("least"))
    pairs = (
        # One word substituted: the same word is missing at the same place.
        members.where(F.col("place") != WHOLE).join(by_place, ["variant", "place"])
        # One word more: a whole line equals the variant of a longer one.
        .select("key", "first", "least")
        .unionByName(
            members.where(F.col("place") != WHOLE).join(whole, "variant").select("key", "first", "least")
        )
        .unionByName(
            members.where(F.col("place") == WHOLE).join(longer, "variant").select("key", "first", "least")
        )
    )
    best = (
        pairs.where("least.first < first")
        .groupBy("key", "first")
        .agg(F.min("least").alias("least"))
    )
    return _verified(docs, best)


def one_word_apart(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one insertion, deletion or substitution of a word is enough, within the bound."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) < LEAST_WORDS or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs whose texts, read again, are one word apart."""
    pairs = stored(
        pairs.select(
            "key",
            F.col("first").alias("at"),
            F.col("least.first").alias("earlier"),
            F.col("least.key").alias("earlier_key"),
        ),
        "line-pairs",
    )
    places = (
        pairs.select("at")
        .unionByName(pairs.select(F.col("earlier").alias("at")))
        .distinct()
        .groupBy(F.col("at.doc_id").alias("at_doc"))
        .agg(F.collect_list("at.line_no").alias("line_nos"))
    )
    texts = ids_and_texts(docs)

    def pick(batches: Iterator) -> Iterator:
        import pandas as pd
        import xxhash

        for batch in batches:
            rows = []
            for doc_id, text, line_nos in zip(batch["doc_id"], batch["text"], batch["line_nos"], strict=True):
                content = text.split("\n")
                for n in line_nos:
                    if n < len(content):
                        words = _words(content[n])
                        normal = b" ".join(words)
                        rows.append((doc_id, int(n), xxhash.xxh3_128_digest(normal), normal.decode("utf-8")))
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "line_key", "line"])

    lines = stored(
        texts.join(places, texts["doc_id"] == places["at_doc"])
        .select("doc_id", "text", "line_nos")
        .mapInPandas(pick, "doc_id bigint, line_no int, line_key binary, line string")
        .select(F.struct("doc_id", "line_no").alias("place"), "line_key", "line")
        .dropDuplicates(["place", "line_key"]),
        "line-texts",
    )
    both = pairs.join(
        lines.select(F.col("place").alias("at"), F.col("line_key").alias("key"), F.col("line").alias("own")),
        ["at", "key"],
    ).join(
        lines.select(
            F.col("place").alias("earlier"),
            F.col("line_key").alias("earlier_key"),
            F.col("line").alias("other"),
        ),
        ["earlier", "earlier_key"],
    )

    @F.pandas_udf("boolean")
    def close(own, other):
        import pandas as pd

        return pd.Series(
            [one_word_apart(_words(a), _words(b)) for a, b in zip(own, other, strict=True)], dtype=bool
        )

    return both.where(close("own", "other")).select("key", "earlier")


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """Lines to remove: doc_id, line_no, and the earliest line that stands for each.

    Columns: doc_id, line_no, first_doc_id, first_line_no, edits (0: equal
    words, 1: one word apart). One row for each line that goes; texts without
    such lines are not listed.
    """
    places = stored(occurrences(docs), "line-places")
    lines = stored(distinct_lines(places), "line-texts-distinct")
    near = stored(earlier_neighbours(docs, lines), "line-neighbours")
    verdicts = (
        lines.select("key", "first", "times")
        .join(near, "key", "left")
        .where("times > 1 or earlier is not null")
        .select("key", "first", "earlier")
    )
    at = F.struct("doc_id", "line_no")
    stands = F.least("first", "earlier")
    return (
        places.select("key", "doc_id", "line_no")
        .distinct()
        .join(verdicts, "key")
        .where((at != F.col("first")) | F.col("earlier").isNotNull())
        .select(
            "doc_id",
            F.col("line_no").cast("bigint").alias("line_no"),
            stands["doc_id"].alias("first_doc_id"),
            stands["line_no"].cast("bigint").alias("first_line_no"),
            (stands != F.col("first")).cast("int").alias("edits"),
        )
    )


def remove_lines(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the listed lines (doc_id, line_no) cut out; all other columns stay."""
    key, listed = "__line_doc", "__line_nos"
    gone = removed.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("line_no").alias(listed))
    joined = docs.join(gone, docs["doc_id"].cast("bigint") == gone[key], "left")
    kept = F.filter(
        F.split(docs["text"], "\n"), lambda _, i: ~F.array_contains(F.col(listed), i.cast("bigint"))
    )
    text = F.when(F.col(listed).isNull(), docs["text"]).otherwise(F.array_join(kept, "\n"))
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])
