"""Sums of arrays by key: each partition adds up its own, the executors add those, the driver gets the totals.

An array that is mostly zeros travels as places and values (at, total); one without `at` has a value for each place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

ARRAYS = "site long, size long, at array<int>, total array<double>"
_NAMES = ["site", "size", "at", "total"]


def array_rows(keys: list[int], arrays: list[np.ndarray]) -> pa.RecordBatch:
    at, total = [], []
    for x in arrays:
        some = np.flatnonzero(x)
        sparse = 2 * len(some) < len(x)
        at.append(some.astype(np.int32) if sparse else None)
        total.append(x[some] if sparse else x)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in arrays], pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(total, pa.list_(pa.float64()))], _NAMES)


def add_rows(total: dict[int, np.ndarray], rows: pa.RecordBatch | pa.Table) -> None:
    """Adds the arrays of rows to those in total, by site."""
    for site, size, at, x in zip(rows.column("site").to_pylist(), rows.column("size").to_pylist(), rows.column("at"), rows.column("total")):
        held = total.setdefault(site, np.zeros(size))
        if at.is_valid:
            held[at.values.to_numpy()] += x.values.to_numpy()
        else:
            held += x.values.to_numpy()


def summed(parts: DataFrame) -> dict[int, np.ndarray]:
    """Totals by site of rows (site, size, at, total); keys and widths are those of a model, not of the data."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            add_rows(total, b)
        for site, x in total.items():
            yield array_rows([site], [x])

    out: dict[int, np.ndarray] = {}
    add_rows(out, parts.repartition("site").mapInArrow(added, ARRAYS).toArrow())
    return out
