"""Packed token-id matrices: best-fit-decreasing packing within blocks, with a segment tree over free capacities.

A task packs its documents block by block (of at least `BLOCK` tokens, so that what the last sequences of a block
leave free is under a thousandth), without any exchange. Each sequence becomes one matrix row of ids with the
cumulative lengths of its segments, the places where positions restart at 0, and which piece of which document
each segment is, so that every document can be put together again.

Defined results: a null or empty text is one segment of one token; rows that repeat a doc_id, or have none, are
documents of their own; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import tokens
from foliant.llm._cluster import column, cut, small_batches

BLOCK = 2_000_000
PAD = 0


class Capacities:
    """Open sequences by free space, in a segment tree that finds the tightest one with room."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.open = [0] * (2 * self.size)  # number of sequences below each node
        self.of: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, space: int, n: int) -> None:
        i = space + self.size
        while i:
            self.open[i] += n
            i >>= 1

    def put(self, space: int, sequence: int) -> None:
        if space:
            self.of[space].append(sequence)
            self._add(space, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(space, sequence) of an open sequence with the least space that is at least least."""
        i = least + self.size
        if not self.open[i]:
            while i > 1 and (i & 1 or not self.open[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i + (not self.open[2 * i])
        space = i - self.size
        self._add(space, -1)
        return space, self.of[space].pop()


def fitted(lengths: list[int], capacity: int = tokens.LENGTH) -> list[list[int]]:
    """Best fit decreasing: for each sequence the indices of its pieces."""
    tree, sequences = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if (found := tree.take(lengths[i])) is None:
            found = capacity, len(sequences)
            sequences.append([])
        space, k = found
        sequences[k].append(i)
        tree.put(space - lengths[i], k)
    return sequences


FIELDS = "ids binary, n_tokens int, cu_seqlens array<int>, position_resets array<int>, pieces array<int>, starts array<long>"


def matrices(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = tokens.LENGTH, wide: bool = False) -> DataFrame:
    """(sequence_id, doc_ids, ids, n_tokens, cu_seqlens, position_resets, pieces, starts): a row for each sequence.

    ids are length little-endian numbers of two bytes (wide: four), padded with PAD from n_tokens on.
    """
    path = path or tokens.default_path()
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    small_batches(docs.sparkSession)
    kind = rows.schema["doc_id"].dataType.simpleString()
    dtype = np.dtype("<u4" if wide else "<u2")

    def block(number: int, parts: list[tuple[object, int, int, array]], id_type: pa.DataType) -> pa.RecordBatch:
        rows = fitted([len(p[3]) for p in parts], length)
        matrix = np.full((len(rows), length), PAD, dtype)
        sums = []
        for r, row in enumerate(rows):
            ends = np.cumsum([0] + [len(parts[i][3]) for i in row])
            for i, a, z in zip(row, ends, ends[1:], strict=False):
                matrix[r, a:z] = parts[i][3]
            sums.append(ends.astype(np.int32))
        base = (TaskContext.get().partitionId() << 40) | (number << 20)
        listed = lambda k, kind: pa.array([[parts[i][k] for i in row] for row in rows], pa.list_(kind))
        cols = [
            pa.array(base + np.arange(len(rows))), listed(0, id_type), pa.array([m.tobytes() for m in matrix], pa.binary()), pa.array([int(s[-1]) for s in sums], pa.int32()),
            pa.array(sums, pa.list_(pa.int32())), pa.array([s[:-1] for s in sums], pa.list_(pa.int32())), listed(1, pa.int32()), listed(2, pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["sequence_id", "doc_ids", "ids", "n_tokens", "cu_seqlens", "position_resets", "pieces", "starts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[object, int, int, array]] = []
        held = number = 0
        for b in batches:
            kind = b.schema.field("doc_id").type
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = tokens.encoded(path, t)
                for k, (s, n) in enumerate(tokens.cuts(len(ids), length)):
                    parts.append((i, k, s, ids[s : s + n]))
                held += len(ids)
                if held >= BLOCK:
                    yield block(number, parts, kind)
                    parts, held, number = [], 0, number + 1
        if parts:
            yield block(number, parts, kind)

    return rows.mapInArrow(run, f"sequence_id long, doc_ids array<{kind}>, {FIELDS}")


def op7_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the matrices in the shared folder and returns a digest of what reads back."""
    written, _ = cut(matrices(spark.read.parquet(f"{sf_dir}/documents.parquet")), "matrices")
    return written.select("sequence_id", "doc_ids", "pieces", "starts", "n_tokens", "cu_seqlens", "position_resets", F.crc32("ids").alias("ids_crc32"))
