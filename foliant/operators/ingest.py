"""Documents to pages, blocks and chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.functions.batches import slices, small_batches

SENTENCE = regex.compile(r"(?<=[.!?…])\s+")


def content_hash(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """(doc_id, content_hash, outcome): the least id of equal contents is ingested, the others are skipped."""
    hashed = content_hash(docs)
    first = hashed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"))
    return hashed.join(first, "content_hash").select("doc_id", "content_hash", F.when(F.col("doc_id") == F.col("first_id"), "ingested").otherwise("skipped").alias("outcome"))


def text_stats(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(T.words(F.col("text"))).cast("long").alias("n_words"), F.length(T.stripped(F.col("text"))).cast("long").alias("n_chars_stripped"))


def page_source(n_words: Column, n_chars: Column) -> Column:
    """A text layer with enough words and characters is used; other pages go to OCR."""
    return F.when((n_words >= DEFAULT.dominant_words) & (n_chars >= DEFAULT.dominant_chars), "text").otherwise("ocr")


def classified(docs: DataFrame) -> DataFrame:
    return text_stats(docs).select("doc_id", page_source(F.col("n_words"), F.col("n_chars_stripped")).alias("source"))


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_no", "sentence"))


def hard_windows(docs: DataFrame, max_words: int = DEFAULT.max_words, overlap: int = DEFAULT.overlap_words) -> DataFrame:
    """Windows of max_words words, each overlap words into the last."""
    step = max(1, max_words - overlap)
    df = docs.select("doc_id", T.words(F.col("text")).alias("w")).where(F.size("w") > 0)
    df = df.select("doc_id", "w", F.posexplode(F.sequence(F.lit(0), F.size("w") - 1, F.lit(step))).alias("chunk_index", "start_word"))
    part = F.slice("w", F.col("start_word") + 1, max_words)
    return df.select("doc_id", "chunk_index", "start_word", (F.col("start_word") + F.size(part) - 1).alias("end_word"), F.array_join(part, " ").alias("text_content"))


def packed_lines(text: str | None, limit: int = DEFAULT.block_chars) -> list[str]:
    """Stripped lines joined up to limit characters; a longer line is cut into pieces of its own."""
    out: list[str] = []
    open_lines: list[str] = []
    size = 0
    for line in filter(None, map(str.strip, (text or "").splitlines())):
        grown = size + len(line) + bool(open_lines)
        if open_lines and grown > limit:
            out.append("\n".join(open_lines))
            open_lines, grown = [], len(line)
        if len(line) > limit:
            out += [piece for i in range(0, len(line), limit) if (piece := line[i : i + limit].strip())]
            size = 0
        else:
            open_lines.append(line)
            size = grown
    return out + (["\n".join(open_lines)] if open_lines else [])


def sentence_chunks(text: str | None, max_words: int = DEFAULT.max_words, overlap: int = DEFAULT.overlap_words) -> list[tuple[str, int, int]]:
    """(chunk, first word, last word): whole sentences up to max_words, each chunk begun with the last one's final overlap words.

    A longer sentence ends the open chunk and stands in windows of its own; nothing is carried over from it or into it.
    """
    out: list[tuple[str, int, int]] = []
    held: list[str] = []
    at = 0  # the text's words before held

    def emit() -> None:
        out.append((" ".join(held), at, at + len(held) - 1))

    for sentence in SENTENCE.split((text or "").strip()):
        ws = sentence.split()
        if not ws:
            continue
        if len(ws) > max_words:
            if held:
                emit()
                at += len(held)
                held = []
            for i in range(0, len(ws), max(1, max_words - overlap)):
                part = ws[i : i + max_words]
                out.append((" ".join(part), at + i, at + i + len(part) - 1))
            at += len(ws)
            continue
        if held and len(held) + len(ws) > max_words:
            emit()
            tail = held[-overlap:] if overlap else []
            at += len(held) - len(tail)
            held = list(tail)
        held += ws
    if held:
        emit()
    return out


def _exploded(docs: DataFrame, make: Callable[[str | None], list[tuple]], fields: list[tuple[str, str]]) -> DataFrame:
    """A row (doc_id, number, fields) for each piece of each text, some texts at a time."""
    types = {"string": pa.string(), "int": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 32):
            made = [make(t) for t in b.column("text").to_pylist()]
            owner = pa.array([i for i, m in enumerate(made) for _ in m], pa.int64())
            number = pa.array([k for m in made for k in range(len(m))], pa.int32())
            cols = [pa.array([piece[j] for m in made for piece in m], types[t]) for j, (_, t) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(owner), number, *cols], ["doc_id", "number", *(n for n, _ in fields)])

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, number int, " + ", ".join(f"{n} {t}" for n, t in fields))


def blocks(docs: DataFrame) -> DataFrame:
    return _exploded(docs, lambda t: [(x,) for x in packed_lines(t)], [("text_content", "string")]).withColumnRenamed("number", "block_index")


def chunks(docs: DataFrame) -> DataFrame:
    return _exploded(docs, sentence_chunks, [("text_content", "string"), ("start_word", "int"), ("end_word", "int")]).withColumnRenamed("number", "chunk_index")
