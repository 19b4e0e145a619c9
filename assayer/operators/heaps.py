"""The k best rows of many questions, held by a task while it scans blocks."""

from __future__ import annotations

import numpy as np
import pandas as pd

ORDER = ["question", "score", "ordinal", "chunk_id"]


class TopRows:
    """Rows that reach a question's k-th best score, cut to k whenever enough has come together.

    ``floor`` holds for each question the least score that still counts; ties at
    the floor are kept until ordinal and chunk id decide.
    """

    def __init__(self, questions: int, k: int, floor: np.ndarray | float) -> None:
        self.k = k
        self.floor = np.array(np.broadcast_to(floor, questions), dtype=float)
        self._held: list[pd.DataFrame] = []
        self._rows = 0

    def take(self, scores: np.ndarray, keys: pd.DataFrame, questions: np.ndarray | None = None) -> None:
        """``scores`` has a row for each of ``keys`` and a column for each question, or for those named."""
        floor = self.floor if questions is None else self.floor[questions]
        keep = scores >= floor
        if len(scores) > self.k and np.count_nonzero(keep) > 2 * self.k * keep.shape[1]:
            keep &= scores >= np.partition(scores, len(scores) - self.k, axis=0)[-self.k]
        rows, columns = np.nonzero(keep)
        if not len(rows):
            return
        of = columns if questions is None else questions[columns]
        self._held.append(keys.take(rows).assign(question=of, score=scores[rows, columns]))
        self._rows += len(rows)
        if self._rows > 2 * self.k * len(self.floor) + 1_000:
            self.cut()

    def cut(self) -> pd.DataFrame | None:
        """The k best of each question so far, or None if there are no rows at all."""
        if not self._held:
            return None
        held = pd.concat(self._held).sort_values(ORDER, ascending=[True, False, True, True])
        best = held.groupby("question", sort=False).head(self.k)
        last = best.groupby("question")["score"].agg(["size", "min"])
        full = last[last["size"] >= self.k]
        at = full.index.to_numpy()
        self.floor[at] = np.maximum(self.floor[at], full["min"].to_numpy())
        self._held, self._rows = [best], len(best)
        return best
