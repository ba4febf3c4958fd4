"""Toxicity by a factorization machine over hashed terms.

The score of a text is the logistic of a sum of its terms' weights and of the products of its terms' factors, so that
pairs of terms count beyond what each says alone. It is trained on at most `most` labelled texts, a documented bound,
with all terms that a share of the toxic or of the other texts have, so that those whose pairs tell are there even if
they tell nothing alone, and with rare ones that do. It is then applied to every whole text where it lies; nothing of the
texts is shuffled but the sample's.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sunfold.llm.hashed_terms import batches_of, design, labelled_sample, scored, telling_terms

SAMPLE, SHARE, FACTORS = 16_000, 0.03, 8


def held_out(key) -> F.Column:
    """Rows never learnt from: crc32 of the key as text is divisible by 5."""
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def margins(model: tuple, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    w, v = model
    s, q = np.add.reduceat(v[x], first), np.add.reduceat(v[x] ** 2, first)
    return np.add.reduceat(w[x], first) + 0.5 * (s**2 - q).sum(1)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(x: np.ndarray, first: np.ndarray, y: np.ndarray, size: int, factors: int = FACTORS, rounds: int = 16, batch: int = 128, rate: float = 0.1, decay: float = 1e-3, seed: int = 1, flat: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Weights and factors of features 0 to size - 1, by AdaGrad on the logistic loss. Feature 0 is the intercept. flat: factors stay 0."""
    rng = np.random.default_rng(seed)
    w, v = np.zeros(size), rng.normal(0, 0.02, (size, factors))
    v[slice(None) if flat else 0] = 0
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3) if len(y) else 1e-3
    w[0] = np.log(p / (1 - p))
    gw, gv = np.full(size, 1e-2), np.full((size, factors), 1e-2)
    rows = np.zeros((batch, size), np.float32)
    for bx, bf, by in batches_of(x, first, y, batch, rounds, seed):
        at = np.repeat(np.arange(len(by)), np.diff(np.r_[bf, len(bx)]))
        rows[at, bx] = 1
        own, whole = rows[: len(by)], np.hstack([w[:, None], v, v**2]).astype(np.float32)
        sums = (own @ whole).astype(float)
        s = sums[:, 1 : factors + 1]
        each = _logistic(sums[:, 0] + 0.5 * (s**2 - sums[:, factors + 1 :]).sum(1)) - by
        back = (own.T @ np.hstack([np.ones((len(by), 1)), each[:, None], each[:, None] * s]).astype(np.float32)).astype(float)
        rows[at, bx] = 0
        used, a = back[:, 0] > 0, back[:, 1] / len(by)
        b = (back[:, 2:] - back[:, 1:2] * v) / len(by) + decay * v
        a, b[0] = np.where(used, a + decay * w, 0), 0
        b[~used] = 0
        gw += a**2
        gv += b**2
        w -= rate * a / np.sqrt(gw)
        v -= rate * b / np.sqrt(gv)
    return w, v


def toxicity_scores(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = SAMPLE, share: float = SHARE, carry: tuple[str, ...] = ("doc_id",), names: tuple[str, str, str] = ("held_out", "score", "predicted")) -> DataFrame:
    """The carried columns of every row of docs, with held_out, score (0 to 1) and predicted (1 from a score of 0.5), or other `names`.

    Learns from labelled rows that are not held out, at most `most` of them. Nulls count as empty texts, which score by
    their shape and the intercept. Without usable labels every score is the share of label 1 among them, or 0.001.
    Repeated rows stay; a null key is not held out. Carried columns named like results are replaced, others have any names. An
    empty table gives an empty result.
    """
    grade = F.when(F.col(label) > 0, 1).when(F.col(label).isNotNull(), 0)
    sample = labelled_sample(docs, labels.filter(~held_out(F.col(key))), grade, key, text, most)
    found = telling_terms(sample, 2, share=share)
    model = train(*design(sample, found), len(found) + 1)
    carry = [c for c in carry if c not in names]
    columns = [*(docs[f"`{c}`"] for c in carry), held_out(docs[f"`{key}`"])]
    out = scored(docs, text, found, columns, "score double", ["score"], lambda x, first: [_logistic(margins(model, x, first))])
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return out.withColumn("predicted", predicted).toDF(*carry, *names)  # until here the carried columns have names of their own
