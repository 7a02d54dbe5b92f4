"""What the trained models of this subpackage share: a bounded sample of rows, and steps of Adam."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of rows that a sample aims at is in parts of this.
PARTS = 1 << 20


def by_crc(id_column: str, modulus: int) -> Column:
    """The fold of a row: CRC32 of its id as text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")) % modulus


#: Characters of a text that are learnt from at most; of longer ones a run of so many, which begins where the id's hash says.
TRAINING_CHARACTERS = 200_000


def bounded_sample(rows: DataFrame, most: int, id_column: str = "doc_id") -> DataFrame:
    """About `most` rows, those of the smallest hashes of their ids, and never over twice as many, those of the smallest hashes of all their columns; all where there are fewer. One more count of the rows is what it takes."""
    n = rows.count()
    if n <= most:
        return rows
    some = rows.where(F.pmod(F.xxhash64(F.col(id_column), F.lit("sample")), F.lit(PARTS)) < F.lit(most * PARTS // n))
    return least_hashes(some, 2 * most)


def least_hashes(rows: DataFrame, most: int) -> DataFrame:
    """At most so many rows, the same ones whatever order they come in."""
    return rows.orderBy(F.xxhash64(*rows.columns)).limit(most)


def training_text(id_column: str, text_column: str) -> Column:
    """The text, or a run of TRAINING_CHARACTERS of a longer one, so that what is brought to the driver is bounded."""
    text, over = F.col(text_column), F.length(text_column) - TRAINING_CHARACTERS
    start = F.pmod(F.xxhash64(F.col(id_column), F.lit("start")), F.greatest(over, F.lit(1)).cast("bigint")).cast("int")
    return F.when(over > 0, text.substr(start + 1, F.lit(TRAINING_CHARACTERS))).otherwise(text)


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray], rate: float) -> None:
        self.parameters, self.rate, self.step = parameters, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.square = {k: np.zeros_like(v) for k, v in parameters.items()}

    def update(self, gradients: dict[str, np.ndarray]) -> None:
        self.step += 1
        for k, g in gradients.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.parameters[k] -= self.rate * self.mean[k] / (1 - 0.9**self.step) / (np.sqrt(self.square[k] / (1 - 0.999**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)
