"""Catalogue, maintenance, conversation and evaluation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.config import DEFAULT


def filename(doc_id: Column) -> Column:
    return F.concat(F.lit("doc_"), doc_id, F.lit(".pdf"))


def citation(filename: Column, page: Column, section: Column) -> Column:
    """The parts that are there, or what stands for none."""
    quoted = F.when(F.length(section) > 0, F.concat(F.lit('"'), section, F.lit('"')))
    made = F.concat_ws(" · ", filename, F.concat(F.lit("p."), page), quoted)
    return F.when(made == "", "unknown source").otherwise(made)


def titles(messages: DataFrame) -> DataFrame:
    """(conv_id, title): the first user message, cut."""
    user = messages.where("role = 'user'")
    return user.groupBy("conv_id").agg(F.substring(F.min_by("text", "turn"), 1, DEFAULT.title_chars).alias("title"))


def turns(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, question, answer): assistants' messages with the user message right before them; other roles are passed over."""
    own = W.partitionBy("conv_id").orderBy("turn")
    df = messages.where("role IN ('user', 'assistant')")
    df = df.withColumns({"before": F.lag("role").over(own), "question": F.lag("text").over(own)})
    return df.where("role = 'assistant' AND before = 'user'").select("conv_id", "turn", "question", F.col("text").alias("answer"))


def memory(messages: DataFrame, n: int = DEFAULT.memory_turns) -> DataFrame:
    """The last n turns of each conversation."""
    newest = W.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns(messages).withColumn("age", F.row_number().over(newest)).where(F.col("age") <= n)


def transcript(messages: DataFrame) -> DataFrame:
    """(conv_id, transcript) of the remembered turns, long answers cut."""
    limit = DEFAULT.answer_chars
    answer = F.when(F.length("answer") > limit, F.concat(F.rtrim(F.substring("answer", 1, limit)), F.lit("…"))).otherwise(F.col("answer"))
    said = memory(messages).select("conv_id", "turn", F.concat(F.lit("User: "), "question", F.lit("\nAssistant: "), answer).alias("said"))
    return said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "said"))).alias("s")).select("conv_id", F.array_join("s.said", "\n").alias("transcript"))


def scores(hits: DataFrame) -> DataFrame:
    """(query_id, hit, recall, first_rank, reciprocal_rank, n_relevant, n_retrieved) of hits (query_id, rank, relevant); recall is that of the list's hits."""
    out = hits.groupBy("query_id").agg(F.sum(F.col("relevant").cast("long")).alias("n_relevant"), F.count("*").alias("n_retrieved"), F.min(F.when(F.col("relevant"), F.col("rank").cast("double"))).alias("first_rank"))
    return out.select(
        "query_id", (F.col("n_relevant") > 0).alias("hit"), F.round(F.col("n_relevant") / F.col("n_retrieved"), 3).alias("recall"), "first_rank",
        F.round(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0)), 3).alias("reciprocal_rank"), "n_relevant", "n_retrieved",
    )


def summary(scored: DataFrame) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 3)
    return scored.agg(mean(F.col("hit").cast("double")).alias("hit_rate"), mean("recall").alias("recall"), mean("reciprocal_rank").alias("mrr"), F.count("*").alias("n_scored"))


# Sources, sections and prompts


def distinct_sources(hits: DataFrame) -> DataFrame:
    """(query_id, pos, citation, chunk_type): citations of hits (query_id, pos, citation, chunk_type) where first seen."""
    first = hits.groupBy("query_id", "citation").agg(F.min("pos").alias("pos"), F.min_by("chunk_type", "pos").alias("chunk_type"))
    return first.select("query_id", "pos", "citation", "chunk_type")


def section_titles(chunks: DataFrame) -> DataFrame:
    """(document_id, section_title, first_chunk): a document's sections and where they appear first."""
    return chunks.where("section_title IS NOT NULL").groupBy("document_id", "section_title").agg(F.min("chunk_id").alias("first_chunk"))


def summary_chunks(chunks: DataFrame, section: str | None = None) -> DataFrame:
    """chunks (document_id, page_number, chunk_index, block_id, section_title, ...) with their place in the document's summary."""
    df = chunks if section is None else chunks.where(F.col("section_title") == section)
    order = W.partitionBy("document_id").orderBy(F.coalesce("page_number", F.lit(0)), "chunk_index", "block_id")
    return df.withColumn("pos", F.row_number().over(order))


def all_documents(chunks: DataFrame, documents: DataFrame, n: int = DEFAULT.summary_chunks) -> DataFrame:
    """(document_id, context): the first chunks of every document that has any."""
    first = summary_chunks(chunks).where(F.col("pos") <= n)
    said = first.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text_content"))), lambda x: x["text_content"]), "\n").alias("body"))
    return said.join(documents, "document_id").select("document_id", F.concat(F.lit("=== Document: "), "filename", F.lit(" ===\n"), "body").alias("context"))


def question_prompt(question: Column, context: Column, history: Column) -> Column:
    """The message to a model: what was said before, if anything, the context and the question."""
    before = F.when(F.length(F.trim(F.coalesce(history, F.lit("")))) > 0, F.concat(F.lit("Conversation so far:\n"), history, F.lit("\n\n"))).otherwise("")
    return F.concat(before, F.lit("Context:\n"), context, F.lit("\n\nQuestion: "), question)


# Maintenance


def without_document(tables: dict[str, DataFrame], document_id: int) -> dict[str, DataFrame]:
    """All tables without a document's rows: by document_id, or by the chunks, pages or conversations that go with it."""
    gone = {key: tables[t].where(F.col("document_id") == document_id).select(key) for t, key in (("chunks", "chunk_id"), ("pages", "page_id")) if t in tables}
    out = {}
    for name, df in tables.items():
        if "document_id" in df.columns:
            out[name] = df.where(~F.col("document_id").eqNullSafe(document_id))
            continue
        key = next((k for k in gone if k in df.columns), None)
        out[name] = df if key is None else df.join(gone[key], key, "left_anti")
    return out


def document_diagnosis(documents: DataFrame, pages: DataFrame, images: DataFrame) -> DataFrame:
    """(document_id, page_count, n_pages, n_images): what a document should have and what is stored."""
    n_pages = pages.groupBy("document_id").agg(F.count("*").alias("n_pages"))
    n_images = images.join(pages.select("page_id", "document_id"), "page_id").groupBy("document_id").agg(F.count("*").alias("n_images"))
    df = documents.select("document_id", "page_count").join(n_pages, "document_id", "left").join(n_images, "document_id", "left")
    return df.select("document_id", "page_count", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("n_images", F.lit(0)).alias("n_images"))


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    """child's rows whose key parent lacks."""
    return child.join(parent.select(key).distinct(), key, "left_anti")


# Conversations


def conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, title, n_messages, updated_turn): what a list of conversations shows; the last changed one has the greatest turn."""
    counted = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.max("turn").alias("updated_turn"))
    return counted.join(titles(messages), "conv_id", "left").select("conv_id", "title", "n_messages", "updated_turn")


def loaded(messages: DataFrame) -> DataFrame:
    """messages (conv_id, turn, role, text, sources as JSON) with sources decoded; none where they can't be."""
    return messages.withColumn("sources", F.coalesce(F.from_json("sources", "array<string>"), F.array().cast("array<string>")))


def empty_conversations(known: DataFrame, messages: DataFrame) -> DataFrame:
    return known.select("conv_id").distinct().join(messages.select("conv_id").distinct(), "conv_id", "left_anti")


# Evaluation


def relevant(filename: Column, text: Column, source: Column, substrings: Column) -> Column:
    """Whether a hit is from the expected file (null: any) and holds all expected substrings, in any case."""
    own = F.coalesce(F.lower(filename) == F.lower(source), source.isNull())
    return own & F.forall(F.coalesce(substrings, F.array().cast("array<string>")), lambda s: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(s)))


def has_signal(source: Column, substrings: Column) -> Column:
    return source.isNotNull() | (F.coalesce(F.size(substrings), F.lit(0)) > 0)


def grades(text: Column) -> Column:
    """(faithfulness, relevance, correctness) from the JSON object in a judge's text; 0 where missing."""
    found = F.from_json(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)(\{.*\})", 1), "faithfulness string, relevance string, correctness string")
    number = lambda c: F.coalesce(found[c].try_cast("int"), F.lit(0)).alias(c)
    return F.struct(*(number(c) for c in ("faithfulness", "relevance", "correctness")))


def mean_grades(graded: DataFrame) -> DataFrame:
    """Means of graded answers, to two places."""
    mean = lambda c: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 2).alias(c)
    return graded.agg(*(mean(c) for c in ("faithfulness", "relevance", "correctness")), F.count("*").alias("n_scored"))
