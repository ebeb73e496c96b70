"""Spectra of growing tables: Gram matrices add up, so a stream keeps one small matrix."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame

from .. import dense
from ..operators import basis


class RunningGram:
    """The Gram matrix of all rows (i, x array) seen. ``write`` is a sink for ``foreachBatch``: a batch that is replayed
    under its old number is not counted twice."""

    def __init__(self, on_change: Callable[[RunningGram], None] | None = None):
        self.gram: np.ndarray | None = None
        self.rows, self.last, self.on_change = 0, -1, on_change

    def write(self, batch: DataFrame, number: int) -> None:
        if number <= self.last:
            return
        batch = batch.select("x").where("x IS NOT NULL")
        part = basis.reduced(batch, lambda b: np.vstack([(x := basis.rows_of(b)).T @ x, np.full((1, x.shape[1]), float(len(x)))]))
        if part is not None:
            self.gram = part[:-1] if self.gram is None else self.gram + part[:-1]
            self.rows += int(part[-1, 0])
        self.last = number
        if self.on_change is not None:
            self.on_change(self)

    def singular_values(self) -> np.ndarray:
        w, _ = dense.hep(self.gram)
        return np.sqrt(np.maximum(w[::-1], 0))
