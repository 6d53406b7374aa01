"""A corpus store with its whole path: ingest, chunk, index, retrieve, pack, ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.chat import prompts
from foliant.chat.models import LlmClient
from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.operators import chunking, ingest, layout, records, search
from foliant.sources import files
from foliant.store import CorpusStore


def plain_pages(content: bytes) -> list[str]:
    """Pages of a text file, which form feeds part."""
    return content.decode("utf-8").split("\f")


class Engine:
    """What the command line and the chat do with a store."""

    def __init__(self, spark: SparkSession, path: str, must_exist: bool = False):
        self.store = CorpusStore(spark, path, must_exist)
        self.spark = spark

    def ingest(self, path: str, parse: Callable[[bytes], list[str]] = plain_pages, force: bool = False) -> DataFrame:
        """Files to documents, pages and blocks; (path, outcome) of each. Ids are made from contents, so they are the same in every run."""
        parsed = files.parsed_files(self.spark, path, parse)
        found = files.outcomes(parsed, self.store.read("documents"), force)
        new = parsed.join(found.where("outcome = 'ingested'").select("path"), "path", "left_semi").where("error IS NULL").withColumn("document_id", F.abs(F.xxhash64("content_hash")))
        if force:
            for r in new.select("document_id").distinct().collect():
                self.store.delete_document(r[0])
        outcomes = found.collect()
        name = F.element_at(F.split("path", "/"), -1)
        docs = new.groupBy("document_id", "content_hash").agg(F.min("path").alias("filepath"), F.max("page_number").alias("page_count"), F.min(name).alias("filename")).withColumn("processed_at", F.current_timestamp())
        pages = new.select("document_id", F.abs(F.xxhash64("content_hash", "page_number")).alias("page_id"), "page_number", "text_content")
        words, chars = F.size(T.words(F.col("text_content"))), F.length(T.stripped(F.col("text_content")))
        self.store.append_new("pages", pages.withColumn("source", ingest.page_source(words, chars)), "page_id")
        pages = self.store.read("pages").join(self.store.read("semantic_blocks").select("page_id").distinct(), "page_id", "left_anti")
        split = ingest.blocks(pages.select(F.col("page_id").alias("doc_id"), F.col("text_content").alias("text"))).withColumnRenamed("doc_id", "page_id")
        blocks = split.join(pages.select("page_id", "document_id", "source"), "page_id").select("*", F.lit("text").alias("block_type"), F.abs(F.xxhash64("page_id", "block_index")).alias("block_id"))
        self.store.append("semantic_blocks", layout.sections(blocks))
        self.store.append_new("documents", docs, "document_id")
        return self.spark.createDataFrame(outcomes, "path string, outcome string")

    def chunk(self, again: bool = False, semantic: bool = False) -> int:
        """Chunk blocks without chunks (again: all); how many chunks were added."""
        if again:
            for name in ("postings", "doc_lengths", "vocabulary", "chunk_embeddings", "chunks"):
                self.store.replace(name, self.spark.createDataFrame([], self.store.read(name).schema))
        before = self.store.read("chunks").count()
        made = chunking.chunked(self.store.read("semantic_blocks"), embed=search.sentence_vectors if semantic else None)
        made = made.withColumns({"chunk_id": F.abs(F.xxhash64("block_id", "chunk_index")), "source": F.lit("text")})
        self.store.append_new("chunks", made, "block_id", "chunk_index")
        return self.store.read("chunks").count() - before

    def index(self, embed: bool = True) -> None:
        self.store.index()
        if embed:
            self.store.embed("hashed")

    def retrieve(self, query: str, k: int = DEFAULT.top_k, mode: str = "hybrid", rerank: bool = True, variants: list[str] = ()) -> DataFrame:
        """(pos, chunk_id, text, citation) for a question; other wordings of it are searched beside it."""
        said = [query, *variants]
        asked = self.spark.createDataFrame([(n, q) for n, q in enumerate(said)], "query_id long, query string")
        pool = DEFAULT.rerank_candidates if rerank else 2 * k
        chunks = self.store.read("chunks").select("chunk_id", F.col("text_content").alias("text"))
        lexical = self.store.search(asked, 2 * pool) if mode != "semantic" else None
        dense = None
        if mode != "lexical":
            self.store.embed("hashed")
            vectors = search.hashed_vectors(asked.select(F.col("query_id").alias("chunk_id"), F.col("query").alias("text"))).withColumnRenamed("chunk_id", "query_id")
            dense = search.cosine(self.store.read("chunk_embeddings").where("model = 'hashed'").select("chunk_id", "embedding"), vectors, 2 * pool)
        found = search.hybrid(lexical, dense, pool, guaranteed=DEFAULT.guaranteed_semantic).withColumnRenamed("pos", "rank") if mode == "hybrid" else lexical if dense is None else dense
        legs = [found.where(F.col("query_id") == n).withColumn("query_id", F.lit(0).cast("long")) for n in range(len(said))]
        hits = search.retrieved(legs, chunks, asked.where("query_id = 0"), k, rerank)
        full = hits.join(self.store.read("chunks"), "chunk_id").join(self.store.read("pages").select("page_id", "page_number"), "page_id", "left").join(self.store.read("documents").select("document_id", "filename"), "document_id", "left")
        return full.select("query_id", "pos", "chunk_id", F.col("text_content").alias("text"), records.citation(F.col("filename"), F.col("page_number"), F.col("section_title")).alias("citation"), "chunk_type")

    def context(self, hits: DataFrame) -> str:
        packed = search.packed_context(hits.select("query_id", "pos", F.col("citation").alias("header"), "text"))
        return "\n\n".join(r.block for r in packed.orderBy("pos").collect())

    def ask(self, client: LlmClient, question: str, history: str = "", **how) -> str:
        alone = prompts.rewritten(client, question, history)
        return prompts.asked(client, question, self.context(self.retrieve(alone, **how)), history)

    def summarise(self, client: LlmClient, ref: str) -> str:
        from foliant.operators import routing

        docs = self.store.read("documents")
        found = routing.found_documents(self.spark.createDataFrame([(ref,)], "ref string"), docs).first()
        if found is None:
            return prompts.NOTHING
        chunks = self.store.read("chunks").where(F.col("document_id") == found.document_id).join(self.store.read("pages").select("page_id", "page_number"), "page_id", "left")
        ordered = records.summary_chunks(chunks).select(F.lit(0).alias("query_id"), "pos", F.lit(ref).alias("citation"), F.col("text_content").alias("text"))
        return prompts.summarised(client, ref, self.context(ordered))

    def diagnose(self) -> dict[str, int]:
        """Row counts, and rows without what they belong to."""
        s = self.store
        out = {name: s.read(name).count() for name in ("documents", "pages", "semantic_blocks", "chunks")}
        out["orphan_pages"] = records.orphans(s.read("pages"), s.read("documents"), "document_id").count()
        out["orphan_images"] = records.orphans(s.read("images"), s.read("pages"), "page_id").count()
        return out
