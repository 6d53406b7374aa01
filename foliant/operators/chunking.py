"""Blocks to chunks in reading order: runs of blocks, topic cuts, carried-over words, inserts that keep the first, resets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.functions.batches import slices, small_batches
from foliant.operators import ingest

# Blocks of these types are one chunk each.
ATOMIC = ("table", "image_description")


def is_atomic(block_type: Column) -> Column:
    return block_type.isin(*ATOMIC)


def atomic_chunks(blocks: DataFrame) -> DataFrame:
    """(block_id, chunk_index, chunk_type, start_word, end_word, text_content) of atomic blocks with a text."""
    text = T.stripped(F.col("text_content"))
    words = F.size(T.words(F.col("text_content")))
    df = blocks.where(is_atomic(F.col("block_type"))).where(F.length(text) > 0)
    return df.select("block_id", F.lit(0).alias("chunk_index"), F.col("block_type").alias("chunk_type"), F.lit(0).alias("start_word"), F.greatest(words - 1, F.lit(0)).alias("end_word"), text.alias("text_content"))


def reading_order(blocks: DataFrame) -> list[Column]:
    return [F.coalesce("page_id", F.lit(0)), F.col("block_index"), F.col("block_id")]


def runs(blocks: DataFrame) -> DataFrame:
    """blocks with run_no: a document's blocks in reading order share one until page, section or atomic type changes.

    Words are carried over only within a run, so runs can be chunked apart.
    """
    order = W.partitionBy("document_id").orderBy(*reading_order(blocks))
    texts = F.length(T.stripped(F.col("text_content"))) > 0
    own = F.struct(F.col("page_id"), F.col("section_title"))
    breaks = ~F.coalesce(F.lag(own).over(order).eqNullSafe(own), F.lit(False)) | is_atomic(F.col("block_type")) | F.coalesce(F.lag(is_atomic(F.col("block_type")) | ~texts).over(order), F.lit(True))
    return blocks.withColumn("run_no", F.sum(F.coalesce(breaks, F.lit(True)).cast("long")).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))


def cut_points(vectors: DataFrame, percentile: float = DEFAULT.topic_percentile, least: float = DEFAULT.topic_similarity) -> DataFrame:
    """(block_id, sentence_no, drop) before which a topic ends, of unit vectors (block_id, sentence_no, embedding).

    A cut is where the cosine with the sentence before drops by at least the block's percentile of drops, and by 1 - least.
    """
    block = W.partitionBy("block_id")
    dot = F.aggregate(F.zip_with("embedding", "before", lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    df = vectors.withColumns({"before": F.lag("embedding").over(block.orderBy("sentence_no")), "n": F.count("*").over(block)})
    df = df.where("before IS NOT NULL AND n >= 3").withColumn("drop", F.round(1 - dot, 6))
    df = df.withColumn("cutoff", F.greatest(F.percentile("drop", F.lit(percentile / 100)).over(block), F.lit(round(1 - least, 6))))
    return df.where(F.col("drop") >= F.round("cutoff", 6)).select("block_id", "sentence_no", "drop")


def topic_cuts(vectors: np.ndarray, percentile: float = DEFAULT.topic_percentile, least: float = DEFAULT.topic_similarity) -> set[int]:
    """The sentences before which a topic ends, from unit vectors of a block's sentences."""
    if len(vectors) < 3:
        return set()
    drops = 1 - np.einsum("ij,ij->i", vectors[1:], vectors[:-1])
    return set((np.flatnonzero(drops >= max(np.percentile(drops, percentile), 1 - least)) + 1).tolist())


def split(sentences: Iterable[list[str]], max_words: int, overlap: int, cuts: set[int] = frozenset()) -> list[tuple[list[str], int]]:
    """(words, first word's place) of chunks: sentences up to max_words, also cut before the sentences in cuts."""
    out: list[tuple[list[str], int]] = []
    held: list[str] = []
    at = 0
    for number, words in enumerate(sentences):
        long = len(words) > max_words
        if held and (long or number in cuts or len(held) + len(words) > max_words):
            out.append((held, at))
            carried = [] if long or not overlap else held[-overlap:]
            at += len(held) - len(carried)
            held = list(carried)
        if long:
            out += [(words[i : i + max_words], at + i) for i in range(0, len(words), max(1, max_words - overlap))]
            at += len(words)
        else:
            held = held + words
    return [*out, (held, at)] if held else out


_CHUNK = "document_id long, page_id long, block_id long, run_no long, chunk_index int, chunk_type string, start_word int, end_word int, text_content string, prefix_words int, chunk_method string, section_title string"


class _Block(NamedTuple):
    document_id: int
    page_id: int | None
    block_id: int
    run_no: int
    block_type: str
    text_content: str | None
    section_title: str | None


def _run_chunks(rows: list[_Block], max_words: int, overlap: int, embed) -> Iterator[tuple]:
    """Chunks of one run's blocks in order; each block but the first begins with the last words of the one before."""
    tail: list[str] = []
    for r in rows:
        text = (r.text_content or "").strip()
        if not text:
            tail = []
            continue
        if r.block_type in ATOMIC:
            yield r.document_id, r.page_id, r.block_id, r.run_no, 0, r.block_type, 0, max(0, len(text.split()) - 1), text, 0, "atomic", r.section_title
            continue
        said = [(s, ws) for s in ingest.SENTENCE.split(" ".join([*tail, text]) if tail else text) if (ws := s.split())]
        cuts = topic_cuts(embed([s for s, _ in said])) if embed else frozenset()
        chunks = split([ws for _, ws in said], max_words, overlap, cuts)
        for number, (words, start) in enumerate(chunks):
            first, last = (max(0, x - len(tail)) for x in (start, start + len(words) - 1))
            yield r.document_id, r.page_id, r.block_id, r.run_no, number, r.block_type, first, last, " ".join(words), len(tail), "semantic" if embed else "word_count", r.section_title
        tail = chunks[-1][0][-overlap:] if chunks and overlap else []


def chunked(blocks: DataFrame, max_words: int = DEFAULT.max_words, overlap: int = DEFAULT.overlap_words, embed=None) -> DataFrame:
    """Chunks of blocks (document_id, page_id, block_id, block_index, block_type, text_content, section_title), run by run.

    embed(sentences) gives unit vectors, and makes topics end chunks too. Runs are dealt by document, and end at pages.
    """
    fields = [c.split() for c in _CHUNK.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    made = lambda held: pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[_Block]:
            for part in slices(batches, 64):
                yield from map(_Block, *(part.column(c).to_pylist() for c in _Block._fields))

        held: list[tuple] = []
        for _, own in groupby(rows(), key=lambda r: (r.document_id, r.run_no)):
            held += _run_chunks(list(own), max_words, overlap, embed)
            if len(held) >= 2000:
                yield made(held)
                held = []
        if held:
            yield made(held)

    small_batches(blocks.sparkSession)
    sorted_runs = runs(blocks).repartition("document_id", "run_no").sortWithinPartitions("document_id", "run_no", *reading_order(blocks))
    return sorted_runs.select(*_Block._fields).mapInArrow(run, _CHUNK)


def inserted(store: DataFrame, new: DataFrame) -> DataFrame:
    """store and the rows of new whose (block_id, chunk_index) it lacks; of new rows with one key, the least text is the first."""
    key = ["block_id", "chunk_index"]
    first = new.groupBy(*key).agg(F.min("text_content").alias("text_content"))
    return store.select(*key, "text_content").unionByName(first.join(store.select(*key), key, "left_anti").select(*key, "text_content"))


def reset(chunks: DataFrame, derived: DataFrame, document_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """chunks and a table derived from them (chunk_id), without a document's, or empty."""
    gone = chunks if document_id is None else chunks.where(F.col("document_id") == document_id)
    ids = gone.select("chunk_id")
    return chunks.join(ids, "chunk_id", "left_anti"), derived.join(ids, "chunk_id", "left_anti")
