"""Text quality by ordinal regression on graded ratings.

A cumulative-link model: a text has one value, the sum of its hashed terms' weights, and the odds of a grade of at
least j are the logistic of that value less the j-th of a row of rising thresholds. All grades share the weights. It
is trained on at most `most` rated texts, a documented bound, with the terms that tell grades apart, and applied to
every whole text where it lies.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.llm.hashed_terms import batches_of, design, labelled_sample, scored, telling_terms
from sunfold.llm.toxicity import held_out

SAMPLE = 16_000


def tails(model: tuple, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each row the odds that its grade is at least 1, 2, ..."""
    w, cut = model
    return 1 / (1 + np.exp(-np.clip(np.add.reduceat(w[x], first)[:, None] - cut[None, :], -30, 30)))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, grades: int, rounds: int = 16, batch: int = 128, rate: float = 0.1, decay: float = 1e-3, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights of features 0 to size - 1 (feature 0 stays 0: the thresholds are the intercepts) and rising thresholds, by AdaGrad."""
    share = np.array([np.clip((y >= j).mean() if len(y) else 0.5, 1e-3, 1 - 1e-3) for j in range(1, grades)])
    w, cut = np.zeros(size), np.maximum.accumulate(np.log((1 - share) / share) + 1e-3 * np.arange(grades - 1))
    gw, gc = np.full(size, 1e-2), np.full(grades - 1, 1e-2)
    for bx, bf, by in batches_of(x, first, y, batch, rounds, seed):
        full = np.hstack([np.ones((len(by), 1)), tails((w, cut), bx, bf), np.zeros((len(by), 1))])
        rows = np.arange(len(by))
        low, high = full[rows, by], full[rows, by + 1]  # the odds of reaching the grade, and the next
        p = np.maximum(low - high, 1e-9)
        each = -(1 - low - high)  # of the value: d(-log p)
        dc = np.zeros(grades - 1)
        np.add.at(dc, np.maximum(by - 1, 0), np.where(by > 0, low * (1 - low) / p, 0))
        np.add.at(dc, np.minimum(by, grades - 2), np.where(by < grades - 1, -high * (1 - high) / p, 0))
        used = np.bincount(bx, minlength=size) > 0
        used[0] = False
        a = np.bincount(bx, np.repeat(each, np.diff(np.r_[bf, len(bx)])), size) / len(by) + decay * w
        a = np.where(used, a, 0)
        gw += a**2
        w -= rate * a / np.sqrt(gw)
        gc += (dc / len(by)) ** 2
        cut = np.maximum.accumulate(cut - rate * dc / len(by) / np.sqrt(gc) - 1e-3 * np.arange(grades - 1)) + 1e-3 * np.arange(grades - 1)
    return w, cut


def quality_grades(docs: DataFrame, ratings: DataFrame, grade: F.Column, grades: int, key: str = "doc_id", text: str = "text", at_least: int = 1, odds: float = 0.5, most: int = SAMPLE, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns of every row of docs, with held_out, expected_grade, tails (array: the odds of at least grade
    1, 2, ...) and selected: the odds of at least `at_least` are `odds` or more.

    Learns from rated rows that are not held out. `grade` is an expression over ratings, 0 to grades - 1; rows where it
    is null or none of these are left out. What the grades are is the caller's; nothing but their order counts. Nulls count as empty
    texts. Without ratings the odds are even. Repeated rows stay; carried columns named like results are replaced, others have any
    names; an empty table gives an empty result.
    """
    grade = F.when(grade.between(0, grades - 1), grade)
    sample = labelled_sample(docs, ratings.filter(~held_out(F.col(key))), grade, key, text, most)
    found = telling_terms(sample, grades)
    model = train(*design(sample, found), len(found) + 1, grades)

    def score(x, first):
        p = tails(model, x, first)
        return [p.sum(1), list(p)]

    names = ("held_out", "expected_grade", "tails", "selected")
    carry = [c for c in carry if c not in names]
    columns = [*(docs[f"`{c}`"] for c in carry), held_out(docs[f"`{key}`"])]
    out = scored(docs, text, found, columns, "expected_grade double, tails array<double>", ["expected_grade", "tails"], score)
    return out.withColumn("selected", F.col("tails")[at_least - 1] >= odds).toDF(*carry, *names)
