"""Weak supervision: expectation-maximisation over counted vote patterns."""

from __future__ import annotations

import math

GOOD, BAD, ABSTAIN = 1, 0, -1
#: The belief that a rule which votes is right, and how much it weighs against the rows.
RIGHT, BELIEF = 0.9, 0.05


def fit_votes(patterns: list[tuple[tuple[int, ...], float]], rounds: int = 60) -> tuple[float, list[dict[int, float]]]:
    """Log-odds of being good: a constant, and per rule one weight for each vote.

    ``patterns`` are distinct vote rows with their numbers of rows, so the work
    doesn't grow with the corpus. Rules are independent given the class; each has
    its own chances of voting good, bad or not at all, smoothed by the belief,
    which also fixes which class is the good one. No rows: the belief alone.
    """
    rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns) or 1.0
    weight = BELIEF * total
    belief = ({GOOD: RIGHT / 2, BAD: (1 - RIGHT) / 2, ABSTAIN: 0.5}, {GOOD: (1 - RIGHT) / 2, BAD: RIGHT / 2, ABSTAIN: 0.5})
    chances = [[dict(belief[c]) for _ in range(rules)] for c in (0, 1)]
    prior = 0.8
    for _ in range(rounds):
        mass = [0.0, 0.0]
        cells = [[{v: weight * belief[c][v] for v in (GOOD, BAD, ABSTAIN)} for _ in range(rules)] for c in (0, 1)]
        for votes, n in patterns:
            odds = math.log(prior / (1 - prior)) + sum(
                math.log(chances[0][j][v] / chances[1][j][v]) for j, v in enumerate(votes)
            )
            good = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
            for c, share in ((0, n * good), (1, n * (1 - good))):
                mass[c] += share
                for j, v in enumerate(votes):
                    cells[c][j][v] += share
        prior = min(0.99, max(0.01, mass[0] / total))
        chances = [[{v: x / sum(cell.values()) for v, x in cell.items()} for cell in side] for side in cells]
    weights = [{v: math.log(chances[0][j][v] / chances[1][j][v]) for v in (GOOD, BAD, ABSTAIN)} for j in range(rules)]
    return math.log(prior / (1 - prior)), weights
