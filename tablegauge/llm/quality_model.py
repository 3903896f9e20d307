"""A quality classifier: naive Bayes support vectors over n-gram indicators.

An indicator says that a text has an n-gram of words, of bytes, or of repetition marks
(is a word new to the text, seen before, or the same as the last one). Each indicator is
scaled by the log ratio of its counts in the two classes; a linear hinge-loss model is
fitted to the scaled indicators by dual coordinate descent.
"""

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablegauge.llm.linear import FOLD, SAMPLE, calibrate, held_out, hinge_fit, labelled_sample, logistic
from tablegauge.llm.shipping import ship
from tablegauge.llm.words import mixed, shingle_hashes, text_chunks, word_hashes

FEATURES = 1 << 17
MARKS = 8
THRESHOLD = 0.3


@dataclass(frozen=True)
class Model:
    """Weights with the class ratios multiplied in, squared ratios for the norm, and calibration."""

    weights: np.ndarray
    squares: np.ndarray
    bias: float
    a: float
    b: float


def indicators(column: pa.Array) -> Iterator[np.ndarray]:
    """Per text of a column the sorted distinct feature numbers."""
    size = np.uint64(FEATURES)
    flags = np.zeros(FEATURES, bool)
    for _, data, offsets in text_chunks(column):
        words, bounds = word_hashes(data, offsets)
        wide = data.astype(np.uint64)
        grams = (mixed((wide[:-2] << np.uint64(16)) + (wide[1:-1] << np.uint64(8)) + wide[2:] + np.uint64(1 << 40)) % size) if len(data) > 2 else wide[:0]
        single = mixed(words) % size
        for k, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
            own = words[lo:hi]
            flags[single[lo:hi]] = True
            flags[shingle_hashes(own, 2) % size] = True
            flags[grams[offsets[k] : max(offsets[k], offsets[k + 1] - 2)]] = True
            mark = np.ones(len(own), np.uint64)
            mark[np.unique(own, return_index=True)[1]] = 0
            mark[1:][own[1:] == own[:-1]] = 2
            flags[shingle_hashes(mark + np.uint64(3), MARKS) % size] = True
            on = np.flatnonzero(flags)
            flags[on] = False
            yield on.astype(np.int32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array(list(indicators(batch.column("text"))), pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("y"), found], names=["y", "features"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE) -> Model:
    """A model from at most `rows` labelled rows; without two classes it scores their share."""
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col), F.col(text).alias("text"))
    sample = labelled_sample(given, labels.select(id_col, label), label, id_col, rows).select("y", "text")
    table = sample.mapInArrow(_featured, "y int, features array<int>").toArrow()
    y = np.array(table.column("y").to_pylist(), np.int64)
    column = table.column("features").combine_chunks()
    bounds, flat = column.offsets.to_numpy(), column.values.to_numpy()
    found = [flat[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:])]
    order = sorted(range(len(y)), key=lambda i: (y[i], len(found[i]), found[i].tobytes()))
    learn, check = [i for n, i in enumerate(order) if n % FOLD], order[::FOLD]
    counts = np.ones((2, FEATURES))
    for i in learn:
        counts[y[i], found[i]] += 1
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    if not 0 < int(y.sum()) < len(y):
        return Model(np.zeros(FEATURES, np.float32), np.zeros(FEATURES, np.float32), 0.0, *calibrate(np.zeros(len(y)), y))

    def scaled(i: int) -> tuple[np.ndarray, np.ndarray]:
        values = ratios[found[i]]
        return np.append(found[i], np.int32(FEATURES)), np.append(values / max(float(np.linalg.norm(values)), 1e-9), 1.0).astype(np.float32)

    weights = hinge_fit([scaled(i) for i in learn], np.where(y[learn] == 1, 1, -1), FEATURES + 1)
    margins = np.array([float(np.dot(weights[at], values)) for at, values in map(scaled, check)])
    a, b = calibrate(margins, y[check])
    return Model((weights[:-1] * ratios).astype(np.float32), (ratios**2).astype(np.float32), float(weights[-1]), a, b)


def _scorer(model: Model) -> Callable:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            margins = [
                float(model.weights[on].sum(dtype=np.float64)) / max(float(np.sqrt(model.squares[on].sum(dtype=np.float64))), 1e-9) + model.bias
                for on in indicators(batch.column("text"))
            ]
            scores = logistic(np.array(margins, float), model.a, model.b)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    return work


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, held_out, score in [0, 1]; NULL and empty texts are scored too.

    Rows are independent: those that repeat an id or are equal are scored each. Further
    columns, whatever their names, are not read. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(_scorer(model), f"id {kind}, score double")
    return found.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score")
