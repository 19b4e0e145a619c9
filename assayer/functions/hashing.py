"""Deterministic draws from stable keys.

Sampling never uses ``rand()``: its value depends on partitioning, so a retried
task could draw differently. These draws are pure functions of a key and a
stream number, and use only 64-bit integer arithmetic that stays inside
whole-stage codegen and overflows in no SQL engine.
"""

from __future__ import annotations

from fractions import Fraction
from math import e

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = 2147483647


def stable_long(text: Column) -> Column:
    """A non-negative BIGINT identifying a string key."""
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def mixed(key: Column, stream: Column | int) -> Column:
    """A well-mixed integer in [0, PRIME) for a BIGINT key and a stream."""
    stream = F.lit(stream) if isinstance(stream, int) else stream
    # Both halves of a key count: folding alone would make keys a PRIME apart draw alike.
    whole, prime = key.cast("bigint"), F.lit(PRIME).cast("bigint")
    key = F.pmod(whole, prime)
    high = F.pmod(F.call_function("div", whole - key, prime), prime)
    stream = stream.cast("bigint")
    first = (key * 48271 + high * 40692 + stream * 69621 + 12345) % PRIME
    second = (first * (first + 16807) + stream) % PRIME
    return (second * (second + 39373) + key) % PRIME


def uniform(key: Column, stream: Column | int) -> Column:
    """A draw in [0, 1)."""
    return mixed(key, stream) / F.lit(float(PRIME))


def uniform_array(keys: np.ndarray, streams: np.ndarray | int) -> np.ndarray:
    """The same draws for arrays of 64-bit integers, inside a worker."""
    key = keys % PRIME
    high = (keys - key) // PRIME % PRIME
    first = (key * 48271 + high * 40692 + streams * 69621 + 12345) % PRIME
    second = (first * (first + 16807) + streams) % PRIME
    return (second * (second + 39373) + key) % PRIME / float(PRIME)


def uniform_sql(key: str, stream: str) -> str:
    """The same draw as SQL text, for reports that are written in SQL."""
    folded = f"(({key}) % {PRIME})"
    high = f"((({key}) // {PRIME}) % {PRIME})"
    first = f"(({folded} * 48271 + {high} * 40692 + ({stream}) * 69621 + 12345) % {PRIME})"
    second = f"(({first} * ({first} + 16807) + ({stream})) % {PRIME})"
    return (
        f"((({second} * ({second} + 39373) + {folded}) % {PRIME})"
        f" / CAST({PRIME} AS DOUBLE))"
    )


def _poisson_one_cdf() -> tuple[float, ...]:
    """Cumulative Poisson(1) probabilities of 0, 1, 2, ... events, as far as doubles tell them from 1."""
    term, total, found = Fraction(1), Fraction(0), []
    for events in range(18):
        total += term
        found.append(float(total) / e)
        term /= events + 1
    return tuple(p for p in found if p < 1.0)


POISSON_ONE_CDF = _poisson_one_cdf()


def poisson_one(draw: Column) -> Column:
    """Turn a uniform draw into a Poisson(1) resampling weight.

    Pass a draw that is already a column: it is read once per threshold.
    """
    weight = F.lit(0)
    for threshold in POISSON_ONE_CDF:
        weight = weight + (draw >= threshold).cast("int")
    return weight
