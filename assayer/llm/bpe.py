"""Byte-level BPE encoding by traversal of a prefix trie, and decoding.

For every prefix of a word, BPE has exactly one last token. That token is the
suffix of the prefix that is itself a token and that keeps apart from the last
token of what stands before it. So one state for each prefix, its last token, is
enough to encode a word, and words that begin alike share those states.

Distinct words of a batch are put into a trie of their bytes. A depth-first walk
gives every node its last token from the states of its ancestors; shared prefixes
are computed once. A word's ids are read back from its node through the states.

Two tokens keep apart if no merge across their seam comes before the merges that
build them. ``Vocabulary.apart`` follows both sides of the seam through those
merges in their order; answers are remembered.

Texts are encoded whole, null as empty. The vocabulary's special tokens are
found in texts as the tokenizer itself finds them.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayer.llm.chunks import Memory

# The published pattern of byte-level BPE, and its white space.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = (
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
SIGNS = ".,;:!?"
#: Bounds on what a worker remembers, of words and of pairs of tokens.
WORDS_REMEMBERED = 300_000
SEAMS_REMEMBERED = 400_000
NEVER = 1 << 60
State = tuple[dict[int, "State"], tuple[tuple[int, int], ...], bytes]


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for the 256 bytes in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Tokens and merges of a byte-level BPE file, and encodings made with them."""

    def __init__(self, path: str) -> None:
        import regex

        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model, alphabet = whole["model"], byte_alphabet()
        to_bytes = lambda text: bytes(alphabet[c] for c in text)
        ids = model["vocab"]
        self.id_of = {to_bytes(token): i for token, i in ids.items()}
        self.bytes_of = {i: token for token, i in self.id_of.items()}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(merges):
            pair = (ids[left], ids[right])
            self.rank.setdefault(pair, rank)
            self.parts.setdefault(ids[left + right], (*pair, rank))
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.bytes_of |= {i: content.encode("utf-8") for content, i in self.special.items()}
        self.spelled = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.lengths = [len(token) for token in self.spelled]
        # Lazy automaton over ends of a path that begin some token: each state has its
        # following states by byte, and the tokens that end there, longest first.
        self._beginnings = {token[:n] for token in self.id_of for n in range(1, len(token) + 1)}
        self._start: State = ({}, (), b"")
        self._states: dict[bytes, State] = {b"": self._start}
        self._split = regex.compile(PATTERN)
        self._special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._edges: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._apart: dict[int, bool] = {}
        #: Encoded words; a special token's id stands for itself.
        self.words: dict[bytes | int, bytes] = {}

    def _edge(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Tokens on one edge of ``token`` as it is built, with the rank at which each is merged on."""
        known = self._edges.get((token, right))
        if known is None:
            known, at, until = [], token, NEVER
            while True:
                known.append((at, until))
                if at not in self.parts:
                    break
                left_part, right_part, until = self.parts[at]
                at = right_part if right else left_part
            known.reverse()
            self._edges[token, right] = known
        return known

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves ``left`` and ``right`` as two tokens when they are neighbours."""
        a, b = self._edge(left, True), self._edge(right, False)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = a[i], b[j]
            across = self.rank.get((x, y), NEVER)
            # Equal ranks: the place further left is merged first.
            if across < x_until and across <= y_until and across != NEVER:
                return False
            if x_until == NEVER and y_until == NEVER:
                return True
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _step(self, state: State, byte: int) -> State:
        """The state after one more byte."""
        end = state[2] + bytes((byte,))
        while end not in self._beginnings:
            end = end[1:]
        following = self._states.get(end)
        if following is None:
            ids = self.id_of
            ends = tuple((len(end) - i, ids[end[i:]]) for i in range(len(end)) if end[i:] in ids)
            following = self._states[end] = ({}, ends, end)
        state[0][byte] = following
        return following

    def learn(self, words: set[bytes]) -> None:
        """Encode ``words`` in one depth-first walk over their trie and remember them.

        Sorted words are the trie in depth-first order: what a word shares with
        the one before it is the path that stays, and its states are kept.
        """
        apart_of, lengths, base = self._apart, self.lengths, len(self.lengths)
        if len(apart_of) > SEAMS_REMEMBERED:
            apart_of.clear()
        states: list[State] = [self._start]
        last: list[int] = []
        before = b""
        for word in sorted(words):
            shared = 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                shared += 1
            del states[shared + 1 :]
            del last[shared:]
            state, depth = states[shared], shared
            for byte in word[shared:]:
                state = state[0].get(byte) or self._step(state, byte)
                depth += 1
                for length, token in state[1]:
                    if length == depth:
                        break
                    seam = last[depth - length - 1] * base + token
                    apart = apart_of.get(seam)
                    if apart is None:
                        apart = apart_of[seam] = self.apart(last[depth - length - 1], token)
                    if apart:
                        break
                states.append(state)
                last.append(token)
            ids = []
            while depth:
                token = last[depth - 1]
                ids.append(token)
                depth -= lengths[token]
            ids.reverse()
            self.words[word] = array("I", ids).tobytes()
            before = word

    def _cut(self, text: str) -> list[bytes | int]:
        """Words of ``text`` as the pattern cuts it; special tokens as their ids."""
        # Most pieces are letters after a space, with or without a sign after them.
        if text[1:].isalpha() and text[0] == " ":
            return [text.encode("utf-8")]
        if text[1:-1].isalpha() and text[0] == " " and text[-1] in SIGNS:
            return [text[:-1].encode("utf-8"), text[-1:].encode("utf-8")]
        for name in self.special:
            if name in text:
                break
        else:
            return [w.encode("utf-8") for w in self._split.findall(text)]
        found: list[bytes | int] = []
        for part in self._special.split(text):
            if part in self.special:
                found.append(self.special[part])
            else:
                found.extend(w.encode("utf-8") for w in self._split.findall(part))
        return found

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; all texts share one trie."""
        if len(self.words) > WORDS_REMEMBERED or not self.words:
            self.words = {i: array("I", [i]).tobytes() for i in self.special.values()}
        cut = [self._cut(text) for text in texts]
        self.learn(set().union(*cut).difference(self.words))
        known = self.words.__getitem__
        return [known(w[0]) if len(w) == 1 else b"".join(map(known, w)) for w in cut]

    def forget(self) -> None:
        """Forget encoded words and seams, but not the vocabulary."""
        self.words, self._apart = {}, {}

    def decode(self, ids) -> str:
        """The text of ``ids``, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.spelled.__getitem__, ids)).decode("utf-8", errors="replace")


_VOCABULARIES: dict[str, tuple[Vocabulary, Memory]] = {}


def vocabulary(path: str) -> tuple[Vocabulary, Memory]:
    """The vocabulary at ``path`` and this worker's memory of encoded pieces."""
    if path not in _VOCABULARIES:
        known = Vocabulary(path)
        _VOCABULARIES[path] = (known, Memory(known.encode_all))
    return _VOCABULARIES[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encoded(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row; token_ids on request.

    Runs inside the scan without a shuffle. Each Arrow batch is one trie; workers
    remember pieces up to a bound.
    """
    path = path or default_path()
    columns = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        known, memory = vocabulary(path)
        decimal = [str(i) for i in range(len(known.spelled))]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            rows = []
            values = []
            for ids in memory.encode(texts):
                numbers = np.frombuffer(ids, dtype="<u4").tolist()
                listed = ",".join(map(decimal.__getitem__, numbers))
                text = known.decode(numbers)
                rows.append(
                    (
                        len(numbers),
                        hashlib.sha256(listed.encode()).hexdigest(),
                        hashlib.sha256(text.encode("utf-8")).hexdigest(),
                    )
                )
                values.append(np.frombuffer(ids, dtype="<i4") if with_ids else None)
            arrays = [batch.column(0)] + [
                pa.array([r[k] for r in rows], kind)
                for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays.append(pa.array(values, pa.list_(pa.int32())))
                names.append("token_ids")
            yield pa.RecordBatch.from_arrays(arrays, names)
        memory.clear()
        known.forget()

    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    return texts.mapInArrow(run, columns + (", token_ids array<int>" if with_ids else ""))
