"""Lexical and numeric text functions as Column expressions."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled out: the (?U) flag slows every class down.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = f"[{WHITESPACE}]"

# The token pattern (number first, then word) and the stop list.
TOKEN_PATTERN = r"\(?[$€£]?\d[\d,]*(?:\.\d+)?\)?%?|[A-Za-z]+(?:'[A-Za-z]+)?"
TOKEN_PATTERN_LOWER = r"\(?[$€£]?\d[\d,]*(?:\.\d+)?\)?%?|[a-z]+(?:'[a-z]+)?"
STOPWORDS = (
    "a", "an", "and", "are", "as", "at", "be", "been", "by", "for", "from", "has", "have", "in",
    "is", "it", "its", "of", "on", "or", "that", "the", "to", "was", "were", "what", "which",
    "with",
)

# The magnitude pattern and the scale words. "trillions" is
# matched by the pattern but has no scale, so it multiplies by one.
NUMBER_PATTERN = (
    r"(?i)(-|\()?\s*[$€£]?\s*(\d[\d,]*(?:\.\d+)?)\s*\)?\s*"
    r"(thousands?|millions?|billions?|trillions?|mm|bn)?"
)
SCALES = {
    "thousand": 1e3,
    "thousands": 1e3,
    "million": 1e6,
    "millions": 1e6,
    "mm": 1e6,
    "billion": 1e9,
    "billions": 1e9,
    "bn": 1e9,
    "trillion": 1e12,
}

# Paragraph and sentence boundaries.
PARAGRAPH_PATTERN = rf"\n{SPACE}*\n"
SENTENCE_PATTERN = rf"(?<=[.!?]){SPACE}+"
CHARS_PER_TOKEN = 4


def normalize_number(surface: Column) -> Column:
    """Reduce a formatted number to comparable digits.

    Accounting parentheses become a minus sign; currency, percent and thousands
    separators go; trailing decimal zeros go.
    """
    digits = F.regexp_replace(surface, r"^[()]+|[()]+$", "")
    digits = F.regexp_replace(digits, r"^[$€£]+|%+$", "")
    digits = F.replace(digits, F.lit(","), F.lit(""))
    digits = F.when(
        F.contains(digits, F.lit(".")), F.regexp_replace(digits, r"\.?0*$", "")
    ).otherwise(digits)
    negative = F.startswith(surface, F.lit("(")) & F.endswith(surface, F.lit(")"))
    return F.when(negative & (digits != ""), F.concat(F.lit("-"), digits)).otherwise(digits)


def tokens(text: Column, expand_numbers: bool = True, remove_stopwords: bool = True) -> Column:
    """Ordered retrieval terms of a text, duplicates kept."""
    found = F.regexp_extract_all(ascii_lower(text), F.lit(TOKEN_PATTERN_LOWER), F.lit(0))
    if remove_stopwords:
        found = F.filter(found, lambda token: ~token.isin(*STOPWORDS))
    if not expand_numbers:
        return found
    # Most prose carries no digit at all, so the per-token expansion is guarded
    # by one test of the whole text.
    expanded = F.flatten(F.transform(found, _with_variant))
    return F.when(has_digits(text), expanded).otherwise(found)


def _with_variant(token: Column) -> Column:
    variant = normalize_number(token)
    differs = has_digits(token) & (variant != "") & (variant != token)
    return F.when(differs, F.array(token, variant)).otherwise(F.array(token))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only, so no other character can turn into a letter."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def has_digits(text: Column) -> Column:
    return text.rlike(r"\d")


def estimate_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))


def squeeze_space(text: Column) -> Column:
    """Collapse every run of whitespace to one blank and trim the ends."""
    return F.trim(F.regexp_replace(plain_spaces(text), r"\s+", " "))


def plain_spaces(text: Column) -> Column:
    """Turn exotic white space into blanks; ASCII text is passed through."""
    replaced = F.translate(text, WHITESPACE, " " * len(WHITESPACE))
    return F.when(F.octet_length(text) > F.length(text), replaced).otherwise(text)


def strip(text: Column) -> Column:
    """Trim all whitespace, not only blanks."""
    return F.trim(text, F.lit(WHITESPACE))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, PARAGRAPH_PATTERN), strip), lambda p: p != "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_PATTERN), strip), lambda s: s != "")


def numbers(text: Column) -> Column:
    """Magnitudes in a text, scale words applied, in order of appearance."""
    matches = F.regexp_extract_all(plain_spaces(F.coalesce(text, F.lit(""))), F.lit(NUMBER_PATTERN), F.lit(0))
    scales = F.create_map(*[part for k, v in SCALES.items() for part in (F.lit(k), F.lit(v))])

    def magnitude(match: Column) -> Column:
        digits = F.replace(F.regexp_extract(match, NUMBER_PATTERN, 2), F.lit(","), F.lit(""))
        word = F.lower(F.regexp_extract(match, NUMBER_PATTERN, 3))
        value = digits.try_cast("double") * F.coalesce(
            F.try_element_at(scales, word), F.lit(1.0)
        )
        return F.when(F.regexp_extract(match, NUMBER_PATTERN, 1) != "", -value).otherwise(value)

    return F.filter(F.transform(matches, magnitude), lambda value: value.isNotNull())


def render_table(rows: Column) -> Column:
    """Render ARRAY<ARRAY<STRING>> cells as pipe-separated lines."""
    return F.array_join(
        F.transform(rows, lambda row: F.array_join(F.transform(row, strip), " | ")), "\n"
    )


def evidence_reference(document: Column, page: Column) -> Column:
    """``DOCUMENT::p<page>``, or ``DOCUMENT::p?`` when the page is unknown."""
    shown = page.cast("string")
    known = shown.isNotNull() & (shown != "")
    return F.concat(document, F.lit("::p"), F.when(known, shown).otherwise(F.lit("?")))


REFERENCE_PATTERN = r"^(.+)::p(\d+|\?)$"


def parse_reference(reference: Column) -> Column:
    """Struct of document, page (NULL when unknown) and a malformed flag."""
    clean = strip(reference)
    matches = clean.rlike(REFERENCE_PATTERN)
    page = F.regexp_extract(clean, REFERENCE_PATTERN, 2)
    return F.struct(
        F.when(matches, F.regexp_extract(clean, REFERENCE_PATTERN, 1)).alias("document_id"),
        F.when(matches & (page != "?"), page.try_cast("int")).alias("page_number"),
        F.coalesce(~matches, F.lit(True)).alias("malformed"),
    )


def format_evidence(items: Column) -> Column:
    """Citable evidence blocks from ARRAY<STRUCT<chunk_id, text>>."""
    blocks = F.transform(
        items,
        lambda i: F.concat(
            F.lit("["), i["chunk_id"], F.lit("]\n"), strip(F.coalesce(i["text"], F.lit("")))
        ),
    )
    return F.when(F.coalesce(F.size(items), F.lit(0)) == 0, "(no evidence was retrieved)").otherwise(
        F.array_join(blocks, "\n\n")
    )
