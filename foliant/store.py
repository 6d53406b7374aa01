"""A corpus as versioned Parquet tables in one folder, with an inverted index that grows by what is new.

A table's versions are written beside each other, and a pointer file names the current one, so a reader never sees half
a table and a lost job leaves the last version. Appends write files into a new version's own folder and keep the old
folders in the pointer; only deletes rewrite.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.functions.stems import index_forms
from foliant.operators import search as lookup

SCHEMAS = {
    "documents": "document_id long, filename string, filepath string, content_hash string, page_count int, processed_at timestamp",
    "pages": "page_id long, document_id long, page_number int, source string, text_content string",
    "images": "image_id long, page_id long, image_index int, bbox string, width int, height int, description string, description_source string",
    "tables": "table_id long, document_id long, page_id long, table_index int, bbox string, row_count int, col_count int, header_names array<string>, markdown string, cells array<array<string>>, source string, accuracy double",
    "semantic_blocks": "block_id long, document_id long, page_id long, image_id long, table_id long, block_index int, block_type string, source string, bbox string, text_content string, confidence double, section_title string",
    "chunks": "chunk_id long, document_id long, page_id long, block_id long, chunk_index int, chunk_type string, source string, start_word int, end_word int, text_content string, section_title string",
    "chunk_embeddings": "chunk_id long, embedding array<float>, model string",
    "postings": "chunk_id long, term string, tf long",
    "doc_lengths": "chunk_id long, dl int",
    "vocabulary": "word string, term string",
    "conversations": "conv_id long, title string, created_at timestamp, updated_at timestamp",
    "chat_messages": "message_id long, conv_id long, role string, content string, sources array<string>, created_at timestamp",
}


class CorpusStore:
    """Tables of a corpus. Opening one that must exist and doesn't raises FileNotFoundError."""

    def __init__(self, spark: SparkSession, path: str, must_exist: bool = False):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm.org.apache.hadoop.fs
        self._make = jvm.Path
        self._fs = jvm.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if must_exist and not self._fs.exists(self._make(self.path)):
            raise FileNotFoundError(path)

    def _pointer(self, name: str) -> str:
        return f"{self.path}/{name}/current.json"

    def _folders(self, name: str) -> list[str]:
        at = self._make(self._pointer(name))
        if not self._fs.exists(at):
            return []
        return json.loads(self.spark.sparkContext.wholeTextFiles(self._pointer(name), 1).values().first())

    def _point(self, name: str, folders: list[str]) -> None:
        """Write the pointer beside the current one, then put it in its place."""
        new, at = self._make(f"{self.path}/{name}/{uuid.uuid4().hex}.json"), self._make(self._pointer(name))
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(folders).encode()))
        out.close()
        if self._fs.exists(at):
            self._fs.delete(at, False)
        self._fs.rename(new, at)

    def exists(self, name: str) -> bool:
        return bool(self._folders(name))

    def read(self, name: str) -> DataFrame:
        """A table, with nulls for columns that its files lack; an empty one if nothing was written."""
        folders = self._folders(name)
        schema = SCHEMAS[name]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{name}/{f}" for f in folders))

    def _written(self, name: str, df: DataFrame) -> str:
        version = f"v-{uuid.uuid4().hex}"
        empty = self.spark.createDataFrame([], SCHEMAS[name])
        empty.unionByName(df, allowMissingColumns=True).select(empty.columns).write.parquet(f"{self.path}/{name}/{version}")
        return version

    def append(self, name: str, df: DataFrame) -> None:
        self._point(name, [*self._folders(name), self._written(name, df)])

    def replace(self, name: str, df: DataFrame) -> None:
        """A new table in place of the current one, which df may be read from."""
        old, new = self._folders(name), self._written(name, df)
        self._point(name, [new])
        for f in old:
            self._fs.delete(self._make(f"{self.path}/{name}/{f}"), True)

    def append_new(self, name: str, df: DataFrame, *key: str) -> None:
        """Rows whose key the table lacks; of several new ones with a key, one."""
        self.append(name, df.dropDuplicates([*key]).join(self.read(name).select(*key), [*key], "left_anti"))

    def delete_document(self, document_id: int) -> None:
        """A document's rows go from all tables, those derived from its chunks and pages first."""
        ids = {"chunk_id": self.read("chunks"), "page_id": self.read("pages")}
        for name in ("postings", "doc_lengths", "chunk_embeddings", "images"):
            key = "page_id" if name == "images" else "chunk_id"
            if self.exists(name):
                self.replace(name, self.read(name).join(ids[key].where(F.col("document_id") == document_id).select(key), key, "left_anti"))
        for name, schema in SCHEMAS.items():
            if "document_id " in schema and self.exists(name):
                self.replace(name, self.read(name).where(~F.col("document_id").eqNullSafe(document_id)))

    def reset(self) -> int:
        """Delete the corpus, but not its conversations; how many documents there were."""
        n = self.read("documents").count()
        for name in SCHEMAS:
            if name not in ("conversations", "chat_messages") and self.exists(name):
                self.replace(name, self.spark.createDataFrame([], SCHEMAS[name]))
        return n

    def index(self) -> None:
        """Index the chunks that the index lacks. Only words that the vocabulary lacks are stemmed."""
        new = self.read("chunks").select("chunk_id", F.col("text_content").alias("text")).join(self.read("doc_lengths").select("chunk_id"), "chunk_id", "left_anti")
        counted = new.select("chunk_id", T.index_terms(F.col("text")).alias("words"))
        words = counted.select("chunk_id", F.explode("words").alias("word")).groupBy("chunk_id", "word").agg(F.count("*").alias("tf"))
        unknown = words.select("word").distinct().join(self.read("vocabulary").select("word"), "word", "left_anti")
        self.append("vocabulary", unknown.withColumn("term", index_forms(F.col("word"))))
        terms = words.join(self.read("vocabulary"), "word").groupBy("chunk_id", "term").agg(F.sum("tf").alias("tf"))
        # a term's postings lie together, so that a query reads few row groups
        self.append("postings", terms.repartition("term").sortWithinPartitions("term", "chunk_id"))
        self.append("doc_lengths", counted.select("chunk_id", F.size("words").alias("dl")))

    def indexed(self) -> None:
        """Build the index if there is none."""
        if not self.exists("doc_lengths"):
            self.index()

    def search(self, queries: DataFrame, k: int = DEFAULT.top_k) -> DataFrame:
        """(query_id, rank, chunk_id, score) by BM25 over the stored postings, for queries (query_id, query)."""
        self.indexed()
        asked = queries.select("query_id", F.explode(T.query_terms(F.col("query"))).alias("word"))
        bag = asked.withColumn("term", index_forms(F.col("word"))).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        return lookup.ranked(lookup.scored(self.read("postings").join(self.read("doc_lengths"), "chunk_id"), self.read("doc_lengths"), bag), k).select("query_id", "rank", "chunk_id", "score")

    def embed(self, model: str, encode: Callable[[DataFrame], DataFrame] = lookup.hashed_vectors, again: bool = False) -> None:
        """Encode chunks without a vector; with again, vectors of other models go first."""
        if again and self.exists("chunk_embeddings"):
            self.replace("chunk_embeddings", self.read("chunk_embeddings").where(F.col("model").eqNullSafe(model)))
        new = self.read("chunks").select("chunk_id", F.col("text_content").alias("text")).join(self.read("chunk_embeddings").select("chunk_id"), "chunk_id", "left_anti")
        self.append("chunk_embeddings", encode(new).withColumn("model", F.lit(model)))
