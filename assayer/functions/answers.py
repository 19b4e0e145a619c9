"""Reading structured answers and tool calls out of model responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from assayer.functions.calculator import evaluate
from assayer.functions.once import with_once
from assayer.functions.text import strip

#: Scalar fields of the response contract; citations arrive in two shapes.
ANSWER_SCHEMA = (
    "answer STRING, confidence DOUBLE, abstained BOOLEAN, abstention_reason STRING, "
    "reasoning STRING, citations ARRAY<STRING>"
)
CITATION_SCHEMA = "chunk_id STRING, quoted_text STRING, claim STRING"
FENCE_PATTERN = r"(?is)```(?:json)?\s*(.*?)```"


def json_object_text(raw: Column) -> Column:
    """The first of whole text, fenced block and outermost braces that parses.

    ``try_parse_json`` decides validity inside the JVM; a scalar or an array is
    not an object and is passed over.
    """
    fenced = strip(F.regexp_extract(raw, FENCE_PATTERN, 1))
    braces = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)

    def if_object(candidate: Column) -> Column:
        opens = F.startswith(candidate, F.lit("{"))
        return F.when(opens & F.try_parse_json(candidate).isNotNull(), candidate)

    return F.coalesce(if_object(strip(raw)), if_object(fenced), if_object(braces))


def parse_answers(responses: DataFrame, raw: str, output: str = "parsed_answer") -> DataFrame:
    """Parse responses into answer, citations, confidence and abstention.

    ``parsed`` false means a ``parse_error`` outcome. A reason code implies
    abstention, an empty answer is no answer, and citations may be bare
    identifiers. The JSON is read once, in a step of its own.
    """
    body = with_once(responses, "__body", json_object_text(F.col(raw)))
    read = with_once(body, "__f", F.from_json("__body", ANSWER_SCHEMA))
    fields = F.col("__f")
    citations = F.transform(
        F.coalesce(fields["citations"], F.array().cast("array<string>")),
        lambda c: F.when(
            F.startswith(F.ltrim(c), F.lit("{")), F.from_json(c, CITATION_SCHEMA)
        ).otherwise(
            F.struct(
                c.alias("chunk_id"),
                F.lit(None).cast("string").alias("quoted_text"),
                F.lit(None).cast("string").alias("claim"),
            )
        ),
    )
    citations = F.filter(citations, lambda c: F.coalesce(c["chunk_id"], F.lit("")) != "")
    reason = F.nullif(fields["abstention_reason"], F.lit(""))
    answer = F.nullif(fields["answer"], F.lit(""))
    abstained = F.coalesce(fields["abstained"], F.lit(False)) | reason.isNotNull()
    consistent = F.when(abstained, reason.isNotNull() & answer.isNull()).otherwise(
        answer.isNotNull()
    )
    in_range = F.coalesce(fields["confidence"].between(0.0, 1.0), F.lit(True))
    struct = F.struct(
        (F.col("__body").isNotNull() & consistent & in_range).alias("parsed"),
        answer.alias("answer"),
        citations.alias("citations"),
        fields["confidence"].alias("confidence"),
        abstained.alias("abstained"),
        reason.alias("abstention_reason"),
    )
    return read.withColumn(output, struct).drop("__body", "__f")


def split_citations(cited: Column, retrieved: Column) -> Column:
    """Citations of retrieved chunks (a bag) and of unseen chunks (a sorted set)."""
    return F.struct(
        F.filter(cited, lambda c: F.array_contains(retrieved, c)).alias("cited"),
        F.sort_array(F.array_except(cited, retrieved)).alias("hallucinated"),
    )


def call_signature(tool: Column, arguments: Column) -> Column:
    """Identity of a tool call: name plus arguments sorted by key.

    ``arguments`` maps a name to its value as a JSON literal, so that the number 1
    and the text "1" are two calls; see ``json_literal``.
    """
    parts = F.array_sort(
        F.transform(
            F.map_entries(arguments), lambda e: F.concat(e["key"], F.lit("="), e["value"])
        )
    )
    return F.concat(tool, F.lit("("), F.array_join(parts, ", "), F.lit(")"))


def json_literal(value: Column) -> Column:
    """A value as JSON: texts quoted and escaped, numbers bare."""
    listed = F.to_json(F.array(value), {"ignoreNullFields": "false"})
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def request_key(**fields: Column) -> Column:
    """Content hash of everything that can change a response."""
    ordered = [fields[name].alias(name) for name in sorted(fields)]
    return F.sha2(F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"}), 256)


_ARITHMETIC = T.StructType(
    [T.StructField("value", T.DoubleType()), T.StructField("error", T.StringType())]
)


@F.pandas_udf(_ARITHMETIC)
def arithmetic(expressions: pd.Series) -> pd.DataFrame:
    """Evaluate arithmetic text; the one interpreter Spark has no built-in for."""
    return pd.DataFrame([evaluate(e) for e in expressions], columns=["value", "error"])
