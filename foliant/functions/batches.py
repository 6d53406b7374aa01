"""Arrow batches of term lists, a few rows at a time, so that a worker's memory does not grow with the table."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

_MOST = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Send at most so many rows at once to Python workers. The setting stays changed, as plans run later."""
    now = int(spark.conf.get(_MOST))
    if not 0 < now <= rows:
        spark.conf.set(_MOST, rows)


class Terms(NamedTuple):
    """Some rows, the row and the code of each of their terms, and the distinct terms that codes stand for."""

    rows: pa.RecordBatch
    row: np.ndarray
    code: np.ndarray
    terms: pa.Array


def slices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def coded(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[Terms]:
    """Batches with a column terms (lists of strings), coded rows by rows."""
    for part in slices(batches, rows):
        lists = part.column("terms")
        row = np.repeat(np.arange(part.num_rows), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        found = lists.flatten().dictionary_encode()
        yield Terms(part, row, found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary)


def matrix(lists: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of width, padded or cut, and their lengths: -1 of null ones and of those that hold a null."""
    length = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten()
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.maximum(length, 0)
    if values.null_count == 0 and (length == width).all():
        return flat.reshape(len(length), width), length
    row = np.repeat(np.arange(len(length)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = np.zeros((len(length), width))
    gone = values.is_null().to_numpy(zero_copy_only=False)
    fits = (place < width) & ~gone
    out[row[fits], place[fits]] = flat[fits]
    length[row[gone]] = -1
    return out, length


def rounded(x: np.ndarray, places: int = 6) -> np.ndarray:
    """As Spark rounds: halves away from zero, and no negative zero."""
    return np.copysign(np.floor(np.abs(x) * 10**places + 0.5), x) / 10**places + 0.0


class Best:
    """The k best of each of n queries by score, then by the least id, of hits that come in parts. A null score is -inf here."""

    def __init__(self, k: int, n: int):
        self.k, self.least, self.waiting = k, np.full(n, -np.inf), []

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        if len(query):
            self.waiting.append(pa.table([pa.array(query), pa.array(score), ids], ["query", "score", "id"]))
            if sum(len(t) for t in self.waiting) > 4 * self.k * len(self.least):
                self.held()

    def held(self) -> pa.Table | None:
        """The hits so far; least is set to the scores that later ones must reach."""
        if not self.waiting:
            return None
        found = pa.concat_tables(self.waiting)
        found = found.take(pc.sort_indices(found, sort_keys=[("query", "ascending"), ("score", "descending"), ("id", "ascending")], null_placement="at_start"))
        query = found["query"].to_numpy()
        place = np.arange(len(query)) - np.searchsorted(query, query)
        found = found.filter(pa.array(place < self.k))
        last = place == self.k - 1
        self.least[query[last]] = pc.filter(found["score"], pa.array(place[place < self.k] == self.k - 1)).to_numpy()
        self.waiting = [found]
        return found
