"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Test items are partitioned by size class (the power of two below their number of distinct five-word shingles).
Each class has a sketch length set from its upper size bound u: the floor(0.2 u) + 1 shingles with the least
hashes. A document that holds 0.8 of an item's shingles misses at most floor(0.2 n) of its n shingles, so it
holds one of the sketch: the search loses nothing. Candidates are then verified on the shingles themselves.

Words are maximal runs of letters and digits of the lower-cased text.

Defined results: texts (or items) that are null or have fewer than five words have no shingles and match
nothing; a null id is an id like any other; contained() joins rows that repeat an id as one document, whose best
containment counts, and clean() judges each row by its own text; empty tables give an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm._cluster import column, cut

SHINGLE = 5
CONTAINMENT = 0.8
#: The sketches of all items are broadcast up to this many hashes (16 bytes each), and their shingles up to this many bytes; beyond, they are joined by shuffle.
MAX_BROADCAST_HASHES, MAX_BROADCAST_BYTES = 1_000_000, 32_000_000
#: Documents found are broadcast up to this many (an id and a few items' ids each).
MAX_BROADCAST_FOUND = 200_000


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, make) -> Column:
    at = lambda i: make([F.get(words, i + j) for j in range(SHINGLE)])
    return F.when(F.size(words) >= SHINGLE, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(words) - SHINGLE), at)))


def _hashes(words: Column) -> Column:
    return _shingles(words, lambda ws: F.xxhash64(*ws))


def _strings(words: Column) -> Column:
    return _shingles(words, lambda ws: F.concat_ws(" ", *ws))


def items_of(benchmark: DataFrame) -> DataFrame:
    """item_id, its distinct shingles and sketch."""
    df = benchmark.select(column(benchmark, "item_id").alias("item_id"), _words(column(benchmark, "text")).alias("w")).distinct()
    df = df.select("item_id", _strings(F.col("w")).alias("shingles"), _hashes(F.col("w")).alias("hashes")).where("shingles IS NOT NULL")
    n = F.size("shingles")
    upper = F.pow(F.lit(2.0), F.floor(F.log2(n.cast("double"))) + 1) - 1
    length = F.floor(F.lit(1 - CONTAINMENT + 1e-9) * upper).cast("int") + 1
    return df.select("item_id", "shingles", n.cast("long").alias("n_shingles"), F.slice(F.array_sort("hashes"), F.lit(1), length).alias("sketch"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_shared, containment) of each item held by a document to CONTAINMENT or more."""
    items = items_of(benchmark).cache()
    sums = items.agg(F.sum(F.size("sketch")).alias("hashes"), F.sum(F.aggregate("shingles", F.lit(0).cast("long"), lambda s, x: s + F.octet_length(x))).alias("bytes")).first()
    size, whole = sums["hashes"] or 0, (sums["bytes"] or 0) <= MAX_BROADCAST_BYTES
    small = F.broadcast if size <= MAX_BROADCAST_HASHES else lambda df: df
    keys = small(items.select("item_id", "n_shingles", F.size("sketch").alias("k"), F.explode("sketch").alias("h")))
    # words are a column of their own: within a lambda, an expression would be evaluated again for each element
    texts = docs.select(column(docs, "doc_id").alias("doc_id"), _words(column(docs, "text")).alias("words"))
    found = texts.select("doc_id", F.explode(_hashes(F.col("words"))).alias("h")).join(keys, "h")
    missed = F.floor(F.lit(1 - CONTAINMENT + 1e-9) * F.col("n_shingles"))
    found = found.groupBy("doc_id", "item_id", "n_shingles", "k").agg(F.count_distinct("h").alias("hits") if size > MAX_BROADCAST_HASHES else F.count("*").alias("hits"))
    found = found.where(F.col("hits") >= F.col("k") - missed).groupBy(F.col("doc_id").alias("found_id")).agg(F.collect_set("item_id").alias("ids"), F.max(F.col("item_id").isNull()).alias("null_id"))
    ids = F.when(F.col("null_id"), F.array_append("ids", F.lit(None))).otherwise(F.col("ids"))
    found, _ = cut(found.select("found_id", ids.alias("ids")), "found")
    # few documents are found; their ids are broadcast if they are, and only their texts are split and compared
    found = F.broadcast(found) if found.count() <= MAX_BROADCAST_FOUND else found
    own = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text")).join(found, F.col("doc_id").eqNullSafe(F.col("found_id")))
    own = own.select("doc_id", "ids", _words(F.col("text")).alias("words"))
    pairs = own.select("doc_id", _strings(F.col("words")).alias("of_doc"), F.explode("ids").alias("maybe"))
    shared = pairs.join(F.broadcast(items) if whole else items, F.col("maybe").eqNullSafe(F.col("item_id"))).select("doc_id", "item_id", "n_shingles", F.size(F.array_intersect("shingles", "of_doc")).cast("long").alias("n_shared"))
    best = shared.groupBy("doc_id", "item_id").agg(F.max_by("n_shingles", F.col("n_shared") / F.col("n_shingles")).alias("n_shingles"), F.max_by("n_shared", F.col("n_shared") / F.col("n_shingles")).alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_shingles")).where(F.col("n_shared") >= F.lit(CONTAINMENT - 1e-9) * F.col("n_shingles"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no item, with docs' own columns. Rows are judged by their own texts, whatever their ids."""
    digest = F.md5(F.coalesce(column(docs, "text"), F.lit("")))
    held = contained(docs.select(digest.alias("doc_id"), column(docs, "text").alias("text")), benchmark).select(F.col("doc_id").alias("digest")).distinct()
    packed = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("row"), digest.alias("digest"))
    return packed.join(held, "digest", "left_anti").select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def found_sql(documents: str) -> str:
    """A WITH list that ends in found: (doc_id, item_id, n_shingles, n_shared) over the relation named."""
    words = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    gram = " || ' ' || ".join(f"w[i + {j}]" for j in range(SHINGLE))

    def grams(key: str, rel: str) -> str:
        return f"SELECT DISTINCT {key}, {gram} AS s FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {SHINGLE - 1})) AS i FROM (SELECT {key}, {words} AS w FROM {rel}) WHERE len(w) >= {SHINGLE})"

    return f"""
of_docs AS ({grams("doc_id", documents)}),
of_items AS ({grams("item_id", "benchmark")}),
item_sizes AS (SELECT item_id, count(*) AS n_shingles FROM of_items GROUP BY item_id),
found AS (SELECT doc_id, item_id, n_shingles, count(*) AS n_shared FROM of_docs JOIN of_items USING (s) JOIN item_sizes USING (item_id)
          GROUP BY ALL HAVING count(*) / n_shingles >= {CONTAINMENT})"""


SQL = f"WITH {found_sql('documents')} SELECT doc_id, item_id, n_shingles, n_shared, n_shared / n_shingles AS containment FROM found"
