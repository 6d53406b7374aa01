"""Readers and writers of files; paths may be on any store that Spark reads."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import text as T

EVAL = "question string, reference_answer string, expected_source string, expected_substrings array<string>"


def eval_set(spark: SparkSession, path: str) -> DataFrame:
    """Items of a JSONL file in order (item_no, question, ...). Blank lines are passed over; a line that isn't JSON, or lacks a question, raises with its number."""
    raw = spark.read.text(path, wholetext=True)
    lines = raw.select(F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    df = lines.withColumn("item", F.from_json("line", EVAL + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    wrong = F.when(F.col("item").isNull() | F.col("item._bad").isNotNull(), "no JSON").when(F.coalesce(F.trim("item.question"), F.lit("")) == "", "no question")
    checked = F.when(wrong.isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no") + 1, F.lit(": "), wrong)).cast("string")).otherwise(F.col("item.question"))
    return df.select(
        (F.col("line_no") + 1).alias("item_no"), checked.alias("question"), F.coalesce("item.reference_answer", F.lit("")).alias("reference_answer"), F.col("item.expected_source").alias("expected_source"),
        F.coalesce("item.expected_substrings", F.array().cast("array<string>")).alias("expected_substrings"),
    )


def write_report(path: str, config: dict, aggregate: dict, items: list[dict]) -> None:
    """An evaluation's report as JSON."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"config": config, "aggregate": aggregate, "items": items}, f, ensure_ascii=False, indent=2)


def pack_vector(vector: list[float]) -> bytes:
    """A vector as little-endian 32-bit floats."""
    return struct.pack(f"<{len(vector)}f", *vector)


def unpack_vector(data: bytes) -> list[float]:
    return list(struct.unpack(f"<{len(data) // 4}f", data))


def page_text(html: Column) -> Column:
    """A page's text without scripts, styles and tags: white space as one space."""
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return T.stripped(F.regexp_replace(bare, r"\s+", " "))


def parsed_files(spark: SparkSession, path: str, parse: Callable[[bytes], list[str]]) -> DataFrame:
    """(path, content_hash, page_number, text_content, error) of files, by a parser of a file to its pages' texts.

    A file that the parser fails on gives one row with its error; others are not affected.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("content_hash"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "content_hash", "page_number", "text_content", "error"]
        for frame in frames:
            rows = []
            for r in frame.itertuples(index=False):
                try:
                    rows += [(r.path, r.content_hash, n, (t or "").strip(), None) for n, t in enumerate(parse(bytes(r.content)), 1)]
                except Exception as error:
                    rows.append((r.path, r.content_hash, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, "path string, content_hash string, page_number int, text_content string, error string")


def outcomes(files: DataFrame, stored: DataFrame, force: bool = False) -> DataFrame:
    """(path, outcome) of parsed files: failed, skipped if the store or a lesser path has the content, else ingested. force ingests what the store has."""
    each = files.groupBy("path", "content_hash").agg(F.max("error").alias("error"))
    known = each.join(stored.select("content_hash").distinct().withColumn("known", F.lit(True)), "content_hash", "left")
    good = known.where("error IS NULL").groupBy("content_hash").agg(F.min("path").alias("first_path"))
    named = known.join(good, "content_hash", "left")
    skipped = (F.col("path") != F.col("first_path")) | (F.coalesce("known", F.lit(False)) & F.lit(not force))
    return named.select("path", F.when(F.col("error").isNotNull(), "failed").when(skipped, "skipped").otherwise("ingested").alias("outcome"))
