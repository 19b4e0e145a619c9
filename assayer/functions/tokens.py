"""The token patterns of ``text`` and ``dense`` inside Python workers, one pass over a text.

The columns of ``text`` hold every token of a row in arrays that lambdas run over. Where a
scan hands on only what it counted, tokens are found and counted here instead; patterns
and results are the same.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

from assayer.functions import text as tx

#: Fixed value: the embedder's own token pattern.
EMBED_PATTERN = r"[a-z0-9][a-z0-9,.%$]*"
#: Tokens whose places a worker remembers.
REMEMBERED = 200_000

# The digits of these patterns are ASCII, as they are to the JVM.
words = re.compile(tx.TOKEN_PATTERN_LOWER, re.ASCII).findall
embed_words = re.compile(EMBED_PATTERN).findall
_digit = re.compile(r"\d", re.ASCII).search
_brackets = re.compile(r"^[()]+|[()]+$")
_signs = re.compile(r"^[$€£]+|%+$")
_zeros = re.compile(r"\.?0*$")


def normalize_number(surface: str) -> str:
    """``text.normalize_number`` of one token."""
    digits = _signs.sub("", _brackets.sub("", surface)).replace(",", "")
    if "." in digits:
        digits = _zeros.sub("", digits)
    negative = surface.startswith("(") and surface.endswith(")")
    return "-" + digits if negative and digits else digits


def term_counts(lowered: str) -> Counter:
    """How often each retrieval term occurs; the text is lower in A-Z."""
    counts = Counter(words(lowered))
    for word in tx.STOPWORDS:
        counts.pop(word, None)
    if _digit(lowered):
        for token, times in list(counts.items()):
            if _digit(token):
                variant = normalize_number(token)
                if variant and variant != token:
                    counts[variant] += times
    return counts


class HashedPlaces(dict):
    """A token's signed place among ``dimensions``: the place, or its complement for minus one."""

    def __init__(self, dimensions: int, seed: int) -> None:
        super().__init__()
        self.dimensions, self.salt = dimensions, f"{seed}\x00".encode()

    def __missing__(self, token: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        digest = hashlib.sha256(self.salt + token.encode("utf-8")).digest()
        place = int.from_bytes(digest[:4], "big") % self.dimensions
        self[token] = place = ~place if digest[4] % 2 else place
        return place
