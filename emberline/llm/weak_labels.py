"""A label model for rules that vote or abstain, fitted by expectation-maximisation.

Every rule says good, bad or nothing about a document. Nobody knows the truth; the model treats it as
hidden and alternates between (E) the probability of each class for each document, given how the rules
are believed to vote in it, and (M) the rates at which each rule says good, bad or nothing in each class.

Rules depend on each other: a text of symbols alone is bare, has few letters and one top word, and says
nothing of shouting. So the documents that aren't good may be of several kinds, one for each rule to
begin with, and rules need be independent within a kind only. A model with one kind and one with a kind
for each rule are fitted; the one that explains the votes better for its number of rates is kept
(Akaike's criterion). In the model of kinds a rule is taken to err on one to five good documents in a
hundred, so a rare vote that no other rule shares proves nothing, while a frequent one is a kind of its
own. A rule that calls most documents bad describes the corpus, and begins no kind.

All a fit needs is how often each combination of votes occurs, and with R rules there are at most 3**R
combinations however many documents there are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ABSTAIN, GOOD, BAD = 0, 1, 2
MAX_RULES = 10


LEAST_ERROR, MOST_ERROR = 0.01, 0.05
LEAST_PRIOR = 1e-6


@dataclass(frozen=True)
class LabelModel:
    """``rates[k, r, v]``: how often rule r votes v on documents of class k; class 0 is good, all others are bad."""

    priors: np.ndarray
    rates: np.ndarray

    @property
    def prior_good(self) -> float:
        return float(self.priors[0])

    @property
    def accuracies(self) -> np.ndarray:
        """Per rule, the share of its votes that agree with the estimated truth."""
        share = self.priors[:, None, None] * self.rates
        right = share[0, :, GOOD] + share[1:, :, BAD].sum(axis=0)
        return right / np.maximum(share[:, :, GOOD:].sum(axis=(0, 2)), 1e-12)

    def joint(self, votes: np.ndarray) -> np.ndarray:
        """Logarithms of the probability of each class together with each row of votes."""
        rule = np.arange(self.rates.shape[1])
        return np.log(self.priors)[None, :] + np.log(self.rates)[:, rule, votes].sum(axis=2).T

    def classes(self, votes: np.ndarray) -> np.ndarray:
        """The probability of each class for each row of votes."""
        logs = self.joint(votes)
        odds = np.exp(logs - logs.max(axis=1, keepdims=True))
        return odds / odds.sum(axis=1, keepdims=True)

    def posterior_good(self, votes: np.ndarray) -> np.ndarray:
        """The probability of good for each row of votes."""
        return self.classes(votes)[:, 0]

    def likelihood(self, votes: np.ndarray, weight: np.ndarray) -> float:
        logs = self.joint(votes)
        top = logs.max(axis=1)
        return float(weight @ (top + np.log(np.exp(logs - top[:, None]).sum(axis=1))))


def pattern(votes: list[int]) -> int:
    """The combination of votes as one number in base three."""
    code = 0
    for vote in reversed(votes):
        code = code * 3 + vote
    return code


def unpack(codes: np.ndarray, n_rules: int) -> np.ndarray:
    return (np.asarray(codes, dtype=np.int64)[:, None] // 3 ** np.arange(n_rules)) % 3


def maximised(
    votes: np.ndarray, weight: np.ndarray, shares: np.ndarray, rounds: int, kinds: np.ndarray | None = None
) -> LabelModel:
    """Expectation-maximisation from a first guess of the classes of each row of votes.

    One pseudo document per class keeps every rate positive. With one bad class its votes are right;
    with ``kinds``, the rule that begins each bad class, it is right by that rule and like all documents
    by the others. The rate at which those rules call good documents bad is kept between two limits.
    """
    n_classes, n_rules = shares.shape[1], votes.shape[1]
    counted = np.stack([weight @ (votes == vote) for vote in (ABSTAIN, GOOD, BAD)], axis=1)
    pseudo = np.full((n_classes, n_rules, 3), 0.1)
    pseudo[0, :, GOOD] = 1.0
    if kinds is None:
        pseudo[1:, :, BAD] = 1.0
    else:
        pseudo[1:] += counted / max(weight.sum(), 1.0)
        pseudo[np.arange(1, n_classes), kinds] = [0.1, 0.1, 1.0]
    model = None
    for _ in range(rounds):
        rates = pseudo.copy()
        for vote in (ABSTAIN, GOOD, BAD):
            rates[:, :, vote] += (weight[:, None] * shares).T @ (votes == vote)
        rates /= rates.sum(axis=2, keepdims=True)
        if kinds is not None:
            error = np.clip(rates[0, kinds, BAD], LEAST_ERROR, MOST_ERROR)
            rates[0, kinds] *= ((1 - error) / (1 - rates[0, kinds, BAD]))[:, None]
            rates[0, kinds, BAD] = error
        priors = weight @ shares + np.array([1.0] + [1.0 / (n_classes - 1)] * (n_classes - 1))
        priors = np.maximum(priors / priors.sum(), LEAST_PRIOR)
        model = LabelModel(priors / priors.sum(), rates)
        shares = model.classes(votes)
    return model


def fit_patterns(codes: np.ndarray, counts: np.ndarray, n_rules: int, rounds: int = 60) -> LabelModel:
    """Fit to combinations of votes and their counts.

    The first guess is that documents with a bad vote are probably bad, of the kind of that vote, which
    also fixes which of the hidden classes is the good one. Without documents the model is that guess.
    """
    if n_rules > MAX_RULES:
        raise ValueError(f"at most {MAX_RULES} rules: the table of combinations must stay small")
    votes = unpack(codes, n_rules)
    weight = np.asarray(counts, dtype=np.float64)
    bad_share = weight @ (votes == BAD) / max(weight.sum(), 1.0)
    telling = np.flatnonzero((bad_share > 0) & (bad_share <= 0.5))
    n_good, said = (votes == GOOD).sum(axis=1), (votes == BAD)[:, telling]
    n_bad = said.sum(axis=1)
    good = np.where(n_bad > 0, 0.15, np.where(n_good > 0, 0.95, 0.5))
    simple = maximised(votes, weight, np.stack([good, 1 - good], axis=1), rounds)
    if len(telling) < 2:
        return simple
    even = np.full(len(telling), 1.0 / len(telling))
    kinds = np.where(n_bad[:, None] > 0, said / np.maximum(n_bad, 1)[:, None], even)
    # a kind holds together only if its documents are there from the first round on
    good = np.where(n_bad > 0, LEAST_ERROR, good)
    several = maximised(votes, weight, np.concatenate([good[:, None], (1 - good)[:, None] * kinds], axis=1), rounds, telling)
    gain = several.likelihood(votes, weight) - simple.likelihood(votes, weight)
    return several if gain > (len(several.priors) - 2) * (2 * n_rules + 1) else simple


def fit(votes: DataFrame, code: str, n_rules: int, rounds: int = 60) -> LabelModel:
    """Fit to a table with one vote code per document; at most 3**n_rules rows reach the driver."""
    rows = votes.groupBy(F.col(code).alias("code")).count().collect()
    rows = sorted((row["code"], row["count"]) for row in rows)
    return fit_patterns(
        np.array([row[0] for row in rows], dtype=np.int64), np.array([row[1] for row in rows]), n_rules, rounds
    )


def posterior(model: LabelModel, code: Column) -> Column:
    """The posterior of good as an expression of the vote code: odds of each kind against good."""
    logs, priors = np.log(model.rates), np.log(model.priors)
    votes = [F.floor(code / F.lit(3**rule)) % 3 for rule in range(model.rates.shape[1])]
    odds = F.lit(0.0)
    for k in range(1, len(priors)):
        margin = F.lit(float(priors[k] - priors[0]))
        for rule, vote in enumerate(votes):
            weights = (logs[k, rule] - logs[0, rule]).tolist()
            margin = margin + F.when(vote == GOOD, weights[GOOD]).when(vote == BAD, weights[BAD]).otherwise(weights[ABSTAIN])
        odds = odds + F.exp(margin)
    return F.lit(1.0) / (F.lit(1.0) + odds)
