"""Contextual bandits over full-information outcome matrices.

``learn_in_batches`` runs over a whole matrix: a policy is fixed for a batch,
Spark aggregates the batch's sufficient statistics, and the policy is refreshed
between batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayer import vocabulary as v
from assayer.functions.hashing import uniform

K = len(v.ACTIONS)


@dataclass
class LinearArms:
    """Ridge statistics of every arm: A = ridge*I + sum(x x'), b = sum(r x)."""

    width: int
    ridge: float = 1.0
    a: np.ndarray = field(init=False)
    b: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.a = np.stack([np.eye(self.width) * self.ridge] * K)
        self.b = np.zeros((K, self.width))

    def inverse(self) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.linalg.inv(self.a)
        return inverse, np.einsum("kij,kj->ki", inverse, self.b)


def first_argmax(scores: Column) -> Column:
    """Index of the largest score; ties go to the lowest arm."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def choose(
    x: np.ndarray, draws: np.ndarray, arms: LinearArms, algorithm: str, parameter: float
) -> np.ndarray:
    """Arms for a block of contexts under the current statistics.

    ``draws`` holds two hash draws per context and arm, so a retried task repeats
    its choices. A posterior draw enters a score only through x'theta, which is
    normal with the spread LinUCB uses, so one normal per arm suffices.
    """
    inverse, theta = arms.inverse()
    scores = x @ theta.T
    spread = np.sqrt(np.einsum("ni,kij,nj->nk", x, inverse, x))
    if algorithm == "linucb":
        scores = scores + parameter * spread
    elif algorithm == "thompson":
        radius = np.sqrt(-2.0 * np.log(1.0 - draws[:, :K]))
        scores = scores + parameter * spread * radius * np.cos(2.0 * np.pi * draws[:, K:])
    elif algorithm != "epsilon_greedy":
        raise ValueError(f"unknown bandit {algorithm!r}")
    best = np.argmax(np.round(scores, 9), axis=1)
    if algorithm == "epsilon_greedy":
        return np.where(draws[:, 0] < parameter, (draws[:, 1] * K).astype(int), best)
    return best


def learn_in_batches(
    matrix: DataFrame,
    algorithm: str = "linucb",
    parameter: float = 1.0,
    batches: int = 10,
    ridge: float = 1.0,
) -> DataFrame:
    """Run a bandit over (question_key, x ARRAY<DOUBLE>, rewards ARRAY<DOUBLE>).

    Returns one row per batch and arm: rounds, reward and the oracle's reward.
    Between batches only the arm statistics (arms x width^2 numbers) are read
    back. A batch is a hash slice of the matrix, so every plan starts from the
    table and no lineage accumulates over batches.
    """
    if batches <= 0:
        raise ValueError("batches must be positive")
    spark = matrix.sparkSession
    batch_no = F.floor(uniform(F.col("question_key"), 7) * batches).cast("int")
    # Read once per batch; lost blocks are recomputed from the table.
    sliced = matrix.select("question_key", "x", "rewards", batch_no.alias("batch")).persist(
        StorageLevel.MEMORY_AND_DISK
    )
    width = sliced.select(F.max(F.size("x"))).first()[0] or 1
    arms = LinearArms(width, ridge)
    report: list[tuple] = []
    cells = width * width
    schema = (
        "arm int, n bigint, reward double, best double, b array<double>, a array<double>"
    )
    for batch in range(batches):

        def play(frames: Iterator[pd.DataFrame], arms=arms) -> Iterator[pd.DataFrame]:
            """Partial sums of a partition: at most one row per arm."""
            total = np.zeros((K, 3 + width + cells))
            for frame in frames:
                if frame.empty:
                    continue
                x = np.vstack(frame["x"].to_numpy())
                rewards = np.vstack(frame["rewards"].to_numpy())
                draws = np.vstack(frame["draws"].to_numpy())
                arm = choose(x, draws, arms, algorithm, parameter)
                earned = rewards[np.arange(len(arm)), arm]
                outer = np.einsum("ni,nj->nij", x, x).reshape(len(arm), cells)
                ones = np.ones(len(arm))
                parts = np.column_stack(
                    [ones, earned, rewards.max(axis=1), x * earned[:, None], outer]
                )
                np.add.at(total, arm, parts)
            used = np.flatnonzero(total[:, 0])
            yield pd.DataFrame(
                {
                    "arm": used,
                    "n": total[used, 0].astype("int64"),
                    "reward": total[used, 1],
                    "best": total[used, 2],
                    "b": list(total[used, 3 : 3 + width]),
                    "a": list(total[used, 3 + width :]),
                }
            )

        played = (
            sliced.filter(F.col("batch") == batch)
            .select(
                "x",
                "rewards",
                F.array(
                    *[uniform(F.col("question_key"), 100 * (batch + 1) + i) for i in range(2 * K)]
                ).alias("draws"),
            )
            .mapInPandas(play, schema)
        )
        stats = played.groupBy("arm").agg(
            F.sum("n").alias("n"),
            F.sum("reward").alias("reward"),
            F.sum("best").alias("best"),
            F.array(*[F.sum(F.get("b", F.lit(i))) for i in range(width)]).alias("b"),
            F.array(*[F.sum(F.get("a", F.lit(i))) for i in range(cells)]).alias("a"),
        )
        # At most one row per arm.
        for row in stats.orderBy("arm").collect():
            k = row["arm"]
            arms.b[k] += row["b"]
            arms.a[k] += np.reshape(row["a"], (width, width))
            report.append((batch, v.ACTIONS[k], row["n"], row["reward"], row["best"]))
    sliced.unpersist()
    return spark.createDataFrame(
        report,
        "batch int, action_id string, n_rounds bigint, reward double, oracle_reward double",
    )
