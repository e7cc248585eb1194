"""Expectation-maximisation over the votes of overlapping rules (Dawid and Skene's model with abstention).

Rules vote 1 (good), -1 (bad) or 0 (abstain). Given the hidden class, rules vote independently; the
model has the share of good rows and, for each rule and class, the probability of each vote. Rows
with the same votes count together: R rules give at most 3**R different rows, which is the proven
bound of what reaches the driver, whatever the size of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class LabelModel:
    """good: the share of good rows; chance[j, y, v]: of vote VOTES[v] by rule j where the class is y (0 bad, 1 good)."""

    good: float
    chance: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """The probability that each row of votes is of a good document. Only votes that are cast count."""
        log = np.tile(np.log([1 - self.good, self.good]), (len(votes), 1))
        for j in range(votes.shape[1]):
            cast = votes[:, j] != 0
            log[cast] += np.log(self.chance[j][:, votes[cast, j] + 1]).T
        odds = np.exp(log - log.max(axis=1, keepdims=True))
        return odds[:, 1] / odds.sum(axis=1)

    def accuracy(self) -> np.ndarray:
        """For each rule, the probability that a vote it casts is right."""
        share = np.array([1 - self.good, self.good])
        cast = (self.chance[:, :, [0, 2]] * share[None, :, None]).sum(axis=(1, 2))
        right = self.chance[:, 0, 0] * share[0] + self.chance[:, 1, 2] * share[1]
        return right / np.maximum(cast, 1e-12)


def fit(votes: np.ndarray, n: np.ndarray, good: float = 0.85, right: float = 0.95, weight: float = 0.02, rounds: int = 100) -> LabelModel:
    """The model of votes (one row for each different row of votes) seen n times.

    The share `good` of good rows is given. Starts from votes of which a share `right` is right. Prior rows of
    that kind, `weight` times as many as there are rows (20 at least), keep a rule that seldom votes
    from running away, and say which class is which. Abstention says nothing of the class.
    """
    rules, total = votes.shape[1], n.sum()
    seen = np.stack([(votes == v) for v in VOTES], axis=2).astype(float)  # row, rule, vote
    prior_rows = max(20.0, weight * total)
    says = (np.einsum("r,rjv->jv", n, seen) + 0.5) / (total + 1.5)  # rule, vote
    prior = np.empty((rules, 2, 3))
    prior[:, 0, 0], prior[:, 0, 2] = says[:, 0] * right / (1 - good), says[:, 2] * (1 - right) / (1 - good)
    prior[:, 1, 0], prior[:, 1, 2] = says[:, 0] * (1 - right) / good, says[:, 2] * right / good
    prior[:, :, [0, 2]] = np.clip(prior[:, :, [0, 2]], 1e-6, None)
    prior[:, :, [0, 2]] /= np.maximum(1, prior[:, :, [0, 2]].sum(axis=2, keepdims=True) / 0.95)
    prior[:, :, 1] = 1 - prior[:, :, 0] - prior[:, :, 2]
    model = LabelModel(good, prior)
    for _ in range(rounds):
        p = model.posterior(votes)
        mass = np.stack([(1 - p) * n, p * n])  # class, row
        counts = np.einsum("yr,rjv->jyv", mass, seen) + prior_rows * prior
        new = LabelModel(good, counts / counts.sum(axis=2, keepdims=True))
        done = np.abs(new.chance - model.chance).max() < 1e-6
        model = new
        if done:
            break
    return model


def code(votes: list[Column]) -> Column:
    """The votes of a row as one number, three values a rule."""
    return sum(((v + 1).cast("int") * 3**j for j, v in enumerate(votes)), F.lit(0))


def decode(codes: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([codes // 3**j % 3 - 1 for j in range(rules)], axis=1) if len(codes) else np.empty((0, rules), int)


def fit_codes(df: DataFrame, column: str, rules: int, **prior) -> tuple[LabelModel, DataFrame]:
    """The model of all rows' votes, and a table of the posterior of each code that occurs (3**rules rows at most)."""
    seen = df.groupBy(column).count().orderBy(column).collect()
    codes, n = np.array([r[0] for r in seen], int), np.array([r[1] for r in seen], float)
    votes = decode(codes, rules)
    model = fit(votes, n, **prior)
    p = model.posterior(votes)
    rows = [(int(c), float(x)) for c, x in zip(codes, p)]
    return model, df.sparkSession.createDataFrame(rows, f"{column} int, p_good double")
