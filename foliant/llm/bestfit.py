"""Best-fit packing planned over a histogram of lengths.

Documents are token ids and an end token; only those longer than a sequence are cut. The plan is best fit
decreasing over counts: all pieces of one length are placed together, into the open sequences whose free space is
tightest, as many to each as fit. It has a few entries for each length, whatever the number of pieces. Pieces take
their slots by rank within their length, numbered from counts of hashed buckets, which are added up within runs of
buckets and then over the runs, so that neither a length's pieces nor its buckets meet in one task.

Defined results: a null or empty text is one piece of one token; rows that repeat a doc_id, or have none, are packed as
documents of their own; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm import tokens
from foliant.llm._cluster import column, cut, small_batches

#: Pieces of a bucket, about, and the buckets of a run.
BUCKET, RUN = 500, 1000


def plan(counts: dict[int, int], capacity: int = tokens.LENGTH) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, first sequence, pieces in each sequence, offset): entries by length and rank."""
    entries = []
    free: dict[int, list[tuple[int, int]]] = {}
    sequences = 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            space = min((r for r in free if r >= length), default=None)
            if space is None:
                bins = -(-left // (capacity // length))
                free[capacity], space = [(sequences, bins)], capacity
                sequences += bins
            first, bins = free[space].pop()
            each = space // length
            use = min(bins, left // each)
            if not use:
                each, use = left, 1
            if use < bins:
                free[space].append((first + use, bins - use))
            if not free[space]:
                del free[space]
            entries.append((length, rank, first, each, capacity - space))
            if rest := space - each * length:
                free.setdefault(rest, []).append((first, use))
            rank += use * each
            left -= use * each
    return entries


def pieces(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = tokens.LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every row."""
    path = path or tokens.default_path()
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"))
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, piece, start, size, crc = [], [], [], [], []
            done: dict[str | None, list[tuple[int, int, int]]] = {}
            for i, t in enumerate(b.column("text").to_pylist()):
                if t not in done:
                    ids = tokens.encoded(path, t)
                    done[t] = [(s, n, zlib.crc32(ids[s : s + n])) for s, n in tokens.cuts(len(ids), length)]
                for k, (s, n, c) in enumerate(done[t]):
                    row.append(i), piece.append(k), start.append(s), size.append(n), crc.append(c)
            cols = [b.column("doc_id").take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, size, crc))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def _before(order: WindowSpec) -> Column:
    """The sum of n over the rows before."""
    return F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def placed(found: DataFrame, capacity: int = tokens.LENGTH) -> DataFrame:
    """found (rows with length, stored) with sequence_id and offset."""
    spark = found.sparkSession
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}  # at most one row for each length
    entries = sorted(plan(counts, capacity))
    buckets = sum(counts.values()) // BUCKET + 1
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    sums = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    sums = sums.withColumn("run", F.floor(F.col("bucket") / RUN))
    runs = sums.groupBy("length", "run").agg(F.sum("n").alias("n"))
    runs = runs.select("length", "run", _before(W.partitionBy("length").orderBy("run")).alias("start"))
    sums = sums.withColumn("before", _before(W.partitionBy("length", "run").orderBy("bucket"))).join(runs, ["length", "run"])
    sums = sums.select("length", "bucket", (F.col("start") + F.col("before")).alias("before"))
    within = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1
    ranked = dealt.withColumn("within", within).join(sums, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("within"))
    names = found.columns
    table = spark.sparkContext.broadcast(np.array(entries, np.int64).reshape(-1, 5))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        keys = (t[:, 0] << 48) + t[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            e = t[np.searchsorted(keys, (length << 48) + rank, "right") - 1]
            k = rank - e[:, 1]
            new = [pa.array(e[:, 2] + k // e[:, 3]), pa.array(e[:, 4] + k % e[:, 3] * length)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), *new], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema)
    return ranked.select(*found.columns, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def packed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", path: str | None = None, length: int = tokens.LENGTH) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of docs."""
    found, _ = cut(pieces(docs, text, doc_id, path, length), "pieces")
    return placed(found, length)


def op8_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
