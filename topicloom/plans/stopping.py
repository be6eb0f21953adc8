"""Early stopping on held-out perplexity."""

from __future__ import annotations


class EarlyStopping:
    """Stops after ``patience`` values in a row that do not beat the best by more than ``min_delta``; 0 stops at once."""

    def __init__(self, patience: int, min_delta: float = 1.0) -> None:
        self.patience, self.min_delta = patience, min_delta
        self.best, self.best_at, self.waited, self.seen = float("inf"), -1, 0, 0
        self.kept = None

    def step(self, value: float, state=None) -> bool:
        """Take the next value; True if training should stop. ``kept`` is the best value's state."""
        if value < self.best - self.min_delta:
            self.best, self.best_at, self.waited, self.kept = value, self.seen, 0, state
        else:
            self.waited += 1
        self.seen += 1
        return self.waited >= self.patience


def replay(values: list[float], patience: int, min_delta: float = 1.0) -> tuple[int | None, int, float]:
    """(index at which a curve stops, or None; index of its best value; that value)."""
    rule = EarlyStopping(patience, min_delta)
    for i, x in enumerate(values):
        if rule.step(x):
            return i, max(rule.best_at, 0), values[max(rule.best_at, 0)]
    return None, rule.best_at, rule.best
