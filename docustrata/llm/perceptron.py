"""An averaged perceptron over string features, as plain dictionaries that travel with a job."""

from __future__ import annotations

from collections import defaultdict

Weights = dict[str, dict[str, float]]


def scores(weights: Weights, features: list[str]) -> dict[str, float]:
    total: dict[str, float] = defaultdict(float)
    for f in features:
        for label, w in weights.get(f, {}).items():
            total[label] += w
    return total


def predict(weights: Weights, features: list[str], default: str) -> str:
    """The label of the highest score, the first in order on a tie; ``default`` where nothing is known."""
    total = scores(weights, features)
    return max(sorted(total), key=total.__getitem__) if total else default


def train(examples: list[tuple[list[str], str]], default: str, epochs: int = 4) -> Weights:
    """Weights averaged over all steps; examples are taken in the given order, so the result is the same every time."""
    weights: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    totals: dict[tuple[str, str], float] = defaultdict(float)
    stamps: dict[tuple[str, str], int] = defaultdict(int)
    step = 0

    def shift(f: str, label: str, by: float) -> None:
        totals[f, label] += (step - stamps[f, label]) * weights[f][label]
        stamps[f, label] = step
        weights[f][label] += by

    for epoch in range(epochs):
        order = examples if epoch % 2 == 0 else examples[::-1]
        for features, label in order:
            step += 1
            guess = predict(weights, features, default)
            if guess != label:
                for f in features:
                    shift(f, label, 1.0)
                    shift(f, guess, -1.0)
    out: Weights = {}
    for f, by in weights.items():
        kept = {label: (totals[f, label] + (step - stamps[f, label]) * w) / max(step, 1) for label, w in by.items()}
        kept = {label: round(w, 4) for label, w in kept.items() if abs(w) > 1e-4}
        if kept:
            out[f] = kept
    return out
