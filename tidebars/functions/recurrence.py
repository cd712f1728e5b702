"""Linear recurrences with two states, solved block by block with small matrices."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

BLOCK = 64


class Recurrence:
    """``state = steps[t] @ state + gains[t] * x[t]``; what comes out is the state's first
    entry. The last step and gain hold from there on.

    What a block of rows makes of its own values and of the state it starts from are
    matrices that don't depend on the data: 64 rows are one matrix product, and only one
    state per block is handed on in a loop."""

    def __init__(self, steps: np.ndarray, gains: np.ndarray):
        self.steps, self.gains, self.last = steps, gains, len(gains) - 1
        self.block = lru_cache(4096)(self._block)

    def _block(self, t: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the steps from ``t`` on: rows by values, rows by first state, last state by
        values, last state by first state."""
        by_value, by_state = np.zeros((BLOCK, BLOCK)), np.empty((BLOCK, 2))
        of_values, of_state = np.zeros((2, BLOCK)), np.eye(2)
        for i in range(BLOCK):
            at = min(t + i, self.last)
            of_values, of_state = self.steps[at] @ of_values, self.steps[at] @ of_state
            of_values[:, i] += self.gains[at]
            by_value[i], by_state[i] = of_values[0], of_state[0]
        return by_value, by_state, of_values, of_state

    def solve(self, x: np.ndarray, state: tuple[float, float], t: int = 0) -> np.ndarray:
        """First entries of the states for values without gaps, from step ``t`` on."""
        n, count = len(x), -(-len(x) // BLOCK)
        rows = np.zeros((count, BLOCK))
        rows.reshape(-1)[:n] = x
        out, (p, q) = np.empty((count, BLOCK)), state
        early = min(count, max(0, -(-(self.last - t) // BLOCK)))
        for k in range(early):
            by_value, by_state, of_values, of_state = self.block(t + k * BLOCK)
            out[k] = by_value @ rows[k] + by_state @ (p, q)
            p, q = (of_state @ (p, q) + of_values @ rows[k]).tolist()
        if early < count:
            by_value, by_state, of_values, of_state = self.block(self.last)
            (a, b), (c, d) = of_state.tolist()
            starts = []
            for u, v in (rows[early:] @ of_values.T).tolist():
                starts.append((p, q))
                p, q = a * p + b * q + u, c * p + d * q + v
            out[early:] = rows[early:] @ by_value.T + np.array(starts) @ by_state.T
        return out.reshape(-1)[:n]


def second_order(one: np.ndarray, two: np.ndarray) -> Recurrence:
    """``y = x - one * y_before - two * y_before_that``; states are the last two results."""
    steps = np.zeros((len(one), 2, 2))
    steps[:, 0, 0], steps[:, 0, 1], steps[:, 1, 0] = -one, -two, 1.0
    return Recurrence(steps, np.tile([1.0, 0.0], (len(one), 1)))
