"""Linear hinge-loss models: dual coordinate descent, calibration, labelled samples."""

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on, at most.
SAMPLE = 4000
#: Every so many-th row of the sample calibrates the scores instead.
FOLD = 4
HELD_OUT = 5


def held_out(id_col: str) -> Column:
    """Rows whose labels must not be learned: crc32 of the id as text divides by `HELD_OUT`."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % HELD_OUT == 0


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, rows: int = SAMPLE) -> DataFrame:
    """At most `rows` rows of `docs` with `y` (0 or 1), those of the smallest hash of the id.

    NULL labels and held-out rows are left out; of several labels of an id the larger
    counts, of several rows of an id one.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    chosen = (
        known.groupBy(id_col)
        .agg(F.max(F.col(label).cast("int")).alias("y"))
        .orderBy(F.xxhash64(id_col), id_col)
        .limit(rows)
    )
    return docs.join(F.broadcast(chosen), id_col).dropDuplicates([id_col])


def hinge_fit(rows: list[tuple], signs: np.ndarray, size: int, cost: float = 1.0, epochs: int = 10, seed: int = 1) -> np.ndarray:
    """Weights of the linear support vector machine (L1 loss) by dual coordinate descent.

    Each row is (indices, values); the last weight is a bias if the rows have it.
    """
    weights, alpha = np.zeros(size), np.zeros(len(rows))
    squares = np.array([float(np.dot(values, values)) for _, values in rows])
    positive = max(1, int((signs > 0).sum()))
    bound = np.where(signs > 0, cost * len(signs) / (2 * positive), cost * len(signs) / (2 * max(1, len(signs) - positive)))
    order, shuffle = np.arange(len(rows)), np.random.default_rng(seed)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for i in order.tolist():
            if not squares[i]:
                continue
            at, values = rows[i]
            slope = signs[i] * float(np.dot(weights[at], values)) - 1
            new = min(max(alpha[i] - slope / squares[i], 0.0), bound[i])
            if new != alpha[i]:
                weights[at] += (new - alpha[i]) * signs[i] * values
                alpha[i] = new
    return weights


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a * margin + b))) estimates the chance of label 1."""
    a, b = 1.0, 0.0
    ones = int(y.sum())
    if not 0 < ones < len(y):
        return 0.0, float(np.log((ones + 1) / (len(y) - ones + 1)))
    goal = np.where(y == 1, (ones + 1) / (ones + 2), 1 / (len(y) - ones + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ (a, b), -30, 30)))
        grad = x.T @ (p - goal) + 1e-3 * np.array([a, 0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 4 / max(1e-9, float(np.abs(step).max())))
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def logistic(margins: np.ndarray, a: float, b: float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
