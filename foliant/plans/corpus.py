"""Queries of layout, chunking, routing, maintenance, conversation and evaluation operators over the driver's tables, and their SQL.

Lines of documents stand for blocks, orders for pages, their items for what lies on a page.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.functions.stems import index_forms
from foliant.operators import chunking, ingest, layout, records, routing, search
from foliant.plans.registry import _QUERY_TERMS, _STRIPPED, _TERMS, _TURNS, _WORDS, K, _bm25_sql, _chunks, _hits, _legs, _query, _register, _table
from foliant.sources import files


def _sql_words(text: str) -> str:
    return _WORDS.replace("coalesce(text, '')", f"coalesce({text}, '')")


def _sql_stripped(text: str) -> str:
    return _STRIPPED.replace("coalesce(text, '')", f"coalesce({text}, '')")


# Words and blocks


@_query("word_tokens", f"SELECT doc_id, (i - 1)::INT AS pos, w[i] AS word FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM (SELECT doc_id, {_WORDS} AS w FROM documents))")
def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.words(F.col("text"))).alias("pos", "word"))


_BARE = r"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')"
_register("page_text", "pages", lambda df: df.select("page_id", files.page_text(F.col("html")).alias("text")), f"SELECT page_id, {_sql_stripped(_BARE)} AS text FROM pages")


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents: every third is a table, short ones are headings."""
    lines = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_index", "text_content"))
    kind = F.when(F.size(T.words(F.col("text_content"))) <= 4, "heading").when(F.col("block_index") % 3 == 2, "table").otherwise("text")
    return lines.select("document_id", F.col("document_id").alias("page_id"), (F.col("document_id") * 100000 + F.col("block_index")).alias("block_id"), "block_index", kind.alias("block_type"), "text_content")


_BLOCKS = f"""blocks AS (SELECT doc_id AS document_id, doc_id AS page_id, doc_id * 100000 + i - 1 AS block_id, (i - 1)::INT AS block_index,
    CASE WHEN len({_sql_words("l[i]")}) <= 4 THEN 'heading' WHEN (i - 1) % 3 = 2 THEN 'table' ELSE 'text' END AS block_type, l[i] AS text_content
    FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)))"""
_SECTIONS = f"""sections AS (SELECT *, last_value(CASE WHEN block_type = 'heading' THEN array_to_string({_sql_words("text_content")}, ' ') END IGNORE NULLS)
    OVER (PARTITION BY page_id ORDER BY block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section_title FROM blocks)"""


@_query("section_carry", f"WITH {_BLOCKS}, {_SECTIONS} SELECT block_id, block_type, section_title FROM sections")
def _carried(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.sections(_blocks(spark, sf_dir)).select("block_id", "block_type", "section_title")


@_query("chunk_atomic", f"WITH {_BLOCKS} SELECT block_id, 0 AS chunk_index, block_type AS chunk_type, 0 AS start_word, greatest(len({_sql_words('text_content')}) - 1, 0)::INT AS end_word, {_sql_stripped('text_content')} AS text_content FROM blocks WHERE block_type = 'table' AND {_sql_stripped('text_content')} <> ''")
def _atomic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.atomic_chunks(_blocks(spark, sf_dir))


@_query(
    "chunk_overlap_runs",
    f"""WITH {_BLOCKS}, {_SECTIONS},
    b AS (SELECT *, block_type = 'table' AS atomic, lag(block_type = 'table' OR {_sql_stripped('text_content')} = '') OVER w AS after, lag(section_title) OVER w AS title, lag(block_id) OVER w AS before
          FROM sections WINDOW w AS (PARTITION BY document_id ORDER BY block_index))
    SELECT block_id, sum(CASE WHEN before IS NULL OR title IS DISTINCT FROM section_title OR atomic OR after THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY block_index)::BIGINT AS run_no FROM b""",
)
def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.runs(layout.sections(_blocks(spark, sf_dir))).select("block_id", "run_no")


@_query("chunk_corpus")
def _chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunked(layout.sections(_blocks(spark, sf_dir)))


@_query("chunk_semantic")
def _semantic_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.col("doc_id").alias("page_id"), F.col("doc_id").alias("block_id"), F.lit(0).alias("block_index"), F.lit("text").alias("block_type"), F.col("text").alias("text_content"), F.lit(None).cast("string").alias("section_title"))
    return chunking.chunked(whole, embed=search.sentence_vectors)


_WINDOWS = f"""windows AS (SELECT doc_id, (s // 240)::INT AS chunk_index, array_to_string(w[s + 1:s + 300], ' ') AS text_content
    FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 240)) AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents) WHERE len(w) > 0))"""


@_query("rechunk_counts", f"WITH {_WINDOWS} SELECT doc_id, count(*) AS n_chunks FROM windows GROUP BY doc_id")
def _rechunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.hard_windows(_table(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@_query(
    "topic_cut_points",
    """WITH v AS (SELECT label AS block_id, vec_id AS sentence_no, embedding, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS before, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
    d AS (SELECT block_id, sentence_no, round(1 - list_sum(list_transform(list_zip(embedding, before), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6)::DOUBLE AS drop FROM v WHERE before IS NOT NULL AND n >= 3),
    c AS (SELECT block_id, greatest(quantile_cont(drop, 0.9), 0.5::DOUBLE) AS cutoff FROM d GROUP BY block_id)
    SELECT block_id, sentence_no, drop FROM d JOIN c USING (block_id) WHERE drop >= round(cutoff, 6)""",
)
def _cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.cut_points(_table(spark, sf_dir, "embeddings").select(F.col("label").alias("block_id"), F.col("vec_id").alias("sentence_no"), "embedding"))


@_query("chunk_upsert", "SELECT doc_id AS block_id, 0 AS chunk_index, CASE WHEN doc_id % 2 = 0 THEN 'stored' ELSE source END AS text_content FROM documents")
def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("block_id"), F.lit(0).alias("chunk_index"), F.col("source").alias("text_content"))
    return chunking.inserted(own.where("block_id % 2 = 0").withColumn("text_content", F.lit("stored")), own)


@_query("chunk_reset", "SELECT 'chunks' AS name, count(*) AS n FROM documents WHERE lang <> 'fr' OR lang IS NULL UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'fr')")
def _reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.when(F.col("lang") == "fr", 1).otherwise(2).alias("document_id"))
    left = chunking.reset(chunks, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), 1)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in zip(("chunks", "labels"), left, strict=True)]
    return counts[0].unionByName(counts[1])


# Layout

_ITEM = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_returnflag"


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, items) with the items of each order in order."""
    columns = _ITEM.split(", ")
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("items"))


_ORDERS = f"orders_items AS (SELECT l_orderkey, list(struct_pack({', '.join(f'{c} := {c}' for c in _ITEM.split(', '))}) ORDER BY {_ITEM}) AS items FROM lineitem GROUP BY l_orderkey)"


def _grid() -> list:
    cells = F.transform("items", lambda x: F.array(x["l_linenumber"].cast("string"), F.concat(F.lit(" part|"), x["l_partkey"].cast("string")), F.when(x["l_returnflag"] == "N", F.lit(None)).otherwise(F.concat(x["l_returnflag"], F.lit("\n")))))
    return F.concat(F.array(F.array(F.lit("line"), F.lit("part"), F.lit("flag"))), cells)


_MARKDOWN = "'| line | part | flag |' || chr(10) || '| --- | --- | --- |' || chr(10) || array_to_string(list_transform(items, lambda x: '| ' || x.l_linenumber || ' | part&#124;' || x.l_partkey || ' | ' || CASE WHEN x.l_returnflag = 'N' THEN '' ELSE x.l_returnflag END || ' |'), chr(10))"


@_query("table_markdown", f"WITH {_ORDERS} SELECT l_orderkey, {_MARKDOWN} AS markdown FROM orders_items")
def _markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("l_orderkey", layout.markdown(_grid()).alias("markdown"))


@_query("table_validate", f"WITH {_ORDERS} SELECT l_orderkey, len(list_filter(items, lambda x: x.l_returnflag = 'N')) <= 0.3::DOUBLE * (len(items) + 1) AS valid FROM orders_items")
def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    # rows of one column for items of flag N, of three else
    grid = F.concat(F.array(F.array(F.lit("a"), F.lit("b"), F.lit("c"))), F.transform("items", lambda x: F.when(x["l_returnflag"] == "N", F.array(F.lit("1"))).otherwise(F.array(F.lit("1"), F.lit("2"), F.lit("3")))))
    return _orders(spark, sf_dir).select("l_orderkey", layout.valid_grid(grid).alias("valid"))


_DEALT = "SELECT l_orderkey % 500 AS page_id, CASE WHEN l_orderkey % 2 = 0 THEN '1_grid' ELSE '2_stream' END AS strategy, l_orderkey AS ord, CASE WHEN l_orderkey % 2 = 1 THEN 80.0::DOUBLE + l_orderkey % 10 END AS accuracy"


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small tables of orders, dealt to 500 pages, so that pages hold repeats."""
    key = F.col("l_orderkey")
    grid = F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("n"), F.size("items").cast("string")))
    return _orders(spark, sf_dir).select((key % 500).alias("page_id"), F.when(key % 2 == 0, "1_grid").otherwise("2_stream").alias("strategy"), key.alias("ord"), grid.alias("grid"), F.when(key % 2 == 1, 80.0 + key % 10).alias("accuracy"))


_TABLES = f"""kept AS (SELECT * FROM ({_DEALT}, '| a | b |' || chr(10) || '| --- | --- |' || chr(10) || '| n | ' || len(items) || ' |' AS markdown FROM orders_items) WHERE accuracy IS NULL OR accuracy >= 85)"""


@_query("table_accuracy_gate", f"WITH {_ORDERS}, {_TABLES} SELECT page_id, strategy, ord, 2 AS row_count, 2 AS col_count, markdown, accuracy FROM kept")
def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.table_records(_tables(spark, sf_dir)).select("page_id", "strategy", "ord", "row_count", "col_count", "markdown", "accuracy")


@_query(
    "table_dedup",
    f"""WITH {_ORDERS}, {_TABLES}, f AS (SELECT *, row_number() OVER (PARTITION BY page_id, markdown ORDER BY strategy, ord) AS again FROM kept)
    SELECT page_id, strategy, ord, (row_number() OVER (PARTITION BY page_id ORDER BY strategy, ord) - 1)::INT AS table_index FROM f WHERE again = 1""",
)
def _distinct_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.distinct_tables(layout.table_records(_tables(spark, sf_dir))).select("page_id", "strategy", "ord", "table_index")


@_query(
    "table_grid_exists",
    """WITH l AS (SELECT l_orderkey, l_partkey % 90 AS x0, l_partkey % 90 + l_quantity AS x1, l_suppkey AS top, l_suppkey + l_linenumber * 3 - 3 AS bottom FROM lineitem),
    h AS (SELECT * FROM l WHERE x1 - x0 >= 20 AND bottom - top < 3), v AS (SELECT * FROM l WHERE x1 - x0 < 3 AND bottom - top >= 15)
    SELECT l_orderkey, count(*) FILTER (WHERE x1 - x0 >= 20 AND bottom - top < 3)::INT AS horizontal, count(*) FILTER (WHERE x1 - x0 < 3 AND bottom - top >= 15)::INT AS vertical,
    l_orderkey IN (SELECT h.l_orderkey FROM h JOIN v ON h.l_orderkey = v.l_orderkey WHERE v.x0 BETWEEN h.x0 - 5 AND h.x1 + 5 AND (h.top + h.bottom) / 2 BETWEEN v.top - 5 AND v.bottom + 5) AS forms_grid FROM l GROUP BY l_orderkey""",
)
def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    x0 = lambda x: (x["l_partkey"] % 90).cast("double")
    line = lambda x: F.struct(x0(x).alias("x0"), (x0(x) + x["l_quantity"]).alias("x1"), x["l_suppkey"].cast("double").alias("top"), (x["l_suppkey"] + x["l_linenumber"] * 3 - 3).cast("double").alias("bottom"))
    df = _orders(spark, sf_dir).select("l_orderkey", layout.page_lines(F.transform("items", line)).alias("lines"))
    return df.select("l_orderkey", F.size("lines.horizontal").alias("horizontal"), F.size("lines.vertical").alias("vertical"), layout.forms_grid(F.col("lines")).alias("forms_grid"))


@_query(
    "visual_flag",
    f"""WITH {_ORDERS}, s AS (SELECT l_orderkey, len(list_filter(items, lambda x: x.l_quantity * x.l_linenumber / 20000 >= 0.004))::INT AS drawings, round(least(list_sum(list_transform(items, lambda x: x.l_quantity * x.l_linenumber)) / 20000, 1), 6) AS coverage FROM orders_items)
    SELECT l_orderkey, drawings, coverage, l_orderkey % 100 = 0 OR drawings >= 4 OR coverage >= 0.03 AS visual FROM s""",
)
def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = F.transform("items", lambda x: F.struct(x["l_quantity"].alias("width"), x["l_linenumber"].cast("double").alias("height")))
    df = _orders(spark, sf_dir).select("l_orderkey", layout.vector_stats(rects, F.lit(20000.0)).alias("s"))
    return df.select("l_orderkey", "s.drawings", F.round("s.coverage", 6).alias("coverage"), layout.has_visuals((F.col("l_orderkey") % 100 == 0).cast("int"), F.col("s")).alias("visual"))


_MEDIAN = "list_sort(list_transform(items, lambda x: x.l_quantity))[len(items) // 2 + 1]"


@_query("page_median_font", f"WITH {_ORDERS} SELECT l_orderkey, {_MEDIAN} AS median FROM orders_items")
def _median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir).select("l_orderkey", layout.upper_median(F.transform("items", lambda x: x["l_quantity"])).alias("median"))


@_query(
    "heading_detect",
    f"""WITH {_ORDERS}, m AS (SELECT l_orderkey, {_MEDIAN} AS median FROM orders_items)
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_quantity > 1.2 * median AND l_linenumber * 4 <= 20) OR (l_returnflag = 'R' AND l_linenumber * 4 <= 15 AND l_quantity >= 0.95 * median) AS heading FROM lineitem JOIN m USING (l_orderkey)""",
)
def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _orders(spark, sf_dir).select("l_orderkey", layout.upper_median(F.transform("items", lambda x: x["l_quantity"])).alias("median"), F.inline("items"))
    return df.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", layout.is_heading(F.col("l_quantity"), F.col("median"), F.col("l_linenumber") * 4, F.col("l_returnflag") == "R").alias("heading"))


_register("bbox_format", "part", lambda df: df.select("p_partkey", layout.bbox_text(F.array(F.col("p_size").cast("double"), F.col("p_size") / 2, F.col("p_retailprice"), F.lit(0.0))).alias("bbox")), "SELECT p_partkey, printf('%.1f,%.1f,%.1f,0.0', p_size::DOUBLE, p_size / 2, p_retailprice) AS bbox FROM part")
_register("image_size_filter", "part", lambda df: layout.large_images(df.select("p_partkey", (F.col("p_size") * 2).alias("width"), (F.col("p_size") * 3).alias("height"))), "SELECT p_partkey, p_size * 2 AS width, p_size * 3 AS height FROM part WHERE p_size * 2 >= 50 AND p_size * 3 >= 50")
_register("ocr_dominant", "documents", lambda df: df.select("doc_id", layout.ocr_dominant(F.size(T.words(F.col("text"))), F.col("doc_id") % 100 / 100).alias("dominant")), f"SELECT doc_id, len({_WORDS}) >= 20 AND doc_id % 100 / 100 >= 0.25 AS dominant FROM documents")
_register(
    "image_route", "documents", lambda df: ingest.classified(df).select("doc_id", layout.image_route(F.col("source"), F.col("doc_id") % 3 == 0).alias("route")),
    f"SELECT doc_id, CASE WHEN n_words >= 30 AND n_chars >= 180 THEN CASE WHEN doc_id % 3 = 0 THEN 'page_vision' ELSE 'each_image' END ELSE 'page_ocr_or_vision' END AS route FROM (SELECT doc_id, len({_WORDS}) AS n_words, length({_STRIPPED}) AS n_chars FROM documents)",
)
_register("image_blocks", "documents", lambda df: df.select("doc_id", layout.described(F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.when(F.col("doc_id") % 3 == 0, F.col("lang"))).alias("text_content")), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND length(source) > 0 THEN source ELSE '[no description]' END || CASE WHEN doc_id % 3 = 0 AND length(lang) > 0 THEN chr(10) || chr(10) || '[OCR text in image]:' || chr(10) || lang ELSE '' END AS text_content FROM documents")

# Index and search


@_query("fts_incremental", f"SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)) GROUP BY ALL")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_chunks(spark, sf_dir).join(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("chunk_id")), "chunk_id", "left_anti"))


@_query("fts_stems")
def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _table(spark, sf_dir, "documents").select(F.explode(T.index_terms(F.col("text"))).alias("word")).distinct()
    return words.withColumn("term", index_forms(F.col("word")))


@_query("embed_texts")
def _embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hashed_vectors(_chunks(spark, sf_dir))


_register("reembed_stale", "embeddings", lambda df: search.stale(df.select("vec_id", F.nullif(F.col("label").cast("string"), F.lit("0")).alias("model")), "3").select("vec_id"), "SELECT vec_id FROM embeddings WHERE nullif(label::VARCHAR, '0') IS DISTINCT FROM '3'")


@_query("bm25_search_doc", f"WITH {_bm25_sql(3 * K)}, f AS (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN 'en' END AS held FROM benchmark) SELECT query_id, rank, chunk_id, score FROM lexical JOIN f USING (query_id) JOIN documents ON chunk_id = doc_id WHERE (held IS NULL AND rank <= {K}) OR lang = held")
def _bm25_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("document_id"))
    held = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, "en").alias("document_id"))
    return search.on_document(_hits(spark, sf_dir, 3 * K), chunks, held, K)


_COSINE = "round(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)), 6)"


@_query("semantic_search_doc", f"SELECT query_id, rank, chunk_id, score FROM (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, {_COSINE} AS score, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_COSINE} DESC, a.vec_id) AS rank FROM embeddings a JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b USING (label)) WHERE rank <= {K}")
def _dense_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "embeddings").select(F.col("label").alias("document_id"), F.col("vec_id").alias("chunk_id"), "embedding")
    asked = own.where("chunk_id % 50 = 0").select("document_id", F.col("chunk_id").alias("query_id"), F.col("embedding").alias("q"))
    near = own.join(asked, "document_id").select("query_id", "chunk_id", F.round(search.dot(F.col("embedding"), F.col("q")), 6).alias("score"))
    return search.ranked(near, K).select("query_id", "rank", "chunk_id", "score")


@_query("cosine_pairs", f"SELECT a.vec_id, {_COSINE} AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "embeddings")
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("q"))
    return own.join(after, "vec_id").select("vec_id", F.round(search.dot(F.col("embedding"), F.col("q")), 6).alias("cosine"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


_ASKED_TERMS = _QUERY_TERMS.replace("coalesce(text, '')", "coalesce(q, '')")


@_query(
    "rerank",
    f"""WITH {_bm25_sql(2 * K)}, h AS (SELECT query_id, rank, chunk_id, list_distinct({_ASKED_TERMS}) AS asked, {_TERMS} AS ts FROM lexical JOIN documents ON chunk_id = doc_id JOIN (SELECT item_id, text AS q FROM benchmark) ON item_id = query_id),
    s AS (SELECT query_id, rank, chunk_id, round(len(list_intersect(asked, ts)) / len(asked), 6) AS rerank_score FROM h)
    SELECT query_id, pos, chunk_id, rerank_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS pos FROM s) WHERE pos <= {K}""",
)
def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, 2 * K).withColumnRenamed("rank", "pos").join(_chunks(spark, sf_dir), "chunk_id").join(_benchmark(spark, sf_dir), "query_id")
    return search.reranked(hits, K)


@_query("retrieve_pipeline")
def _retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.retrieved(list(_legs(spark, sf_dir)), _chunks(spark, sf_dir), _benchmark(spark, sf_dir))


_VARIANT = r"regexp_replace(regexp_replace(regexp_replace(x, '^[\s\x0B]+|[\s\x0B]+$', '', 'g'), '^(?:[-*•]|[0-9]+[.)])\s*', ''), '^[\"'']+|[\"'']+$', '', 'g')"
_register(
    "parse_variants", "conversations", lambda df: df.where("role = 'assistant'").select("conv_id", "turn", F.array_join(routing.variants(F.concat(F.lit("- one\n2) 'two'\n* ONE\n"), "text")), "|").alias("variants")),
    f"""WITH l AS (SELECT conv_id, turn, list_filter(list_transform(string_split('- one' || chr(10) || '2) ''two''' || chr(10) || '* ONE' || chr(10) || text, chr(10)), lambda x: trim({_VARIANT})), lambda x: x <> '') AS v FROM conversations WHERE role = 'assistant')
    SELECT conv_id, turn, array_to_string(list_filter(v, lambda x, i: list_position(list_transform(v, lambda y: lower(y)), lower(x)) = i), '|') AS variants FROM l""",
)
_register("result_metadata", "events", lambda df: df.select("event_id", F.from_json(F.coalesce("props", F.lit("{}")), "k long, section_title string").alias("m")).select("event_id", F.col("m.k").alias("k"), F.col("m.section_title").alias("section_title")), "SELECT event_id, (props ->> 'k')::BIGINT AS k, props ->> 'section_title' AS section_title FROM events")

# Context and prompts


@_query("source_list", f"WITH {_bm25_sql(K)} SELECT query_id, min(rank) AS pos, source AS citation, arg_min(lang, rank) AS chunk_type FROM lexical JOIN documents ON chunk_id = doc_id GROUP BY query_id, source")
def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("citation"), F.col("lang").alias("chunk_type"))
    return records.distinct_sources(_hits(spark, sf_dir, K).withColumnRenamed("rank", "pos").join(own, "chunk_id"))


_register(
    "qa_prompt", "conversations", lambda df: records.turns(df).select("conv_id", "turn", records.question_prompt(F.col("question"), F.col("answer"), F.when(F.col("turn") % 2 == 0, F.col("question"))).alias("prompt")),
    f"SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND trim(question) <> '' THEN 'Conversation so far:' || chr(10) || question || chr(10) || chr(10) ELSE '' END || 'Context:' || chr(10) || answer || chr(10) || chr(10) || 'Question: ' || question AS prompt FROM {_TURNS} WHERE role = 'assistant' AND before = 'user'",
)


def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.hard_windows(_table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page_number"), "chunk_index", F.col("doc_id").alias("block_id"), F.lit(None).cast("string").alias("section_title"), "text_content")


@_query("summary_chunks", f"WITH {_WINDOWS} SELECT doc_id AS document_id, chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS pos FROM windows")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary_chunks(_windows(spark, sf_dir)).select("document_id", "chunk_index", "pos")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), records.filename(F.col("doc_id")).alias("filename"))


@_query("all_docs_context", f"WITH {_WINDOWS} SELECT doc_id AS document_id, '=== Document: doc_' || doc_id || '.pdf ===' || chr(10) || string_agg(text_content, chr(10) ORDER BY chunk_index) AS context FROM windows WHERE chunk_index < 3 GROUP BY doc_id")
def _all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.all_documents(_windows(spark, sf_dir), _documents(spark, sf_dir))


# Catalogue and routing


@_query("find_document", "SELECT item_id::VARCHAR AS ref, item_id AS document_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents) UNION ALL SELECT 'DOC_' || item_id || '.Pdf', item_id FROM benchmark WHERE item_id IN (SELECT doc_id FROM documents)")
def _found(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark")
    refs = items.select(F.col("item_id").cast("string").alias("ref")).unionByName(items.select(F.concat(F.lit("DOC_"), "item_id", F.lit(".Pdf")).alias("ref"))).unionByName(items.select(F.concat(F.lit("none_"), "item_id").alias("ref")))
    return routing.found_documents(refs, _documents(spark, sf_dir))


_register("list_sections", "documents", lambda df: records.section_titles(df.select(F.col("lang").alias("document_id"), F.col("source").alias("section_title"), F.col("doc_id").alias("chunk_id"))), "SELECT lang AS document_id, source AS section_title, min(doc_id) AS first_chunk FROM documents WHERE source IS NOT NULL GROUP BY ALL")

_PADDED = r"' ' || regexp_replace(lower(left(coalesce(text, ''), 2000)), '[^\p{L}\p{N}_]+', '  ', 'g') || ' '"
_COUNTS = ", ".join(f"len(regexp_extract_all(padded, ' ({words.replace(' ', '  ')}) ')) AS {name}" for name, words in routing.LANGUAGES.items())
_LANGUAGES = f"languages AS (SELECT doc_id AS document_id, CASE WHEN greatest(French, English, German, Spanish) = 0 THEN 'Unknown' {' '.join(f'''WHEN {n} = greatest(French, English, German, Spanish) THEN '{n}' ''' for n in routing.LANGUAGES)} END AS language FROM (SELECT doc_id, {_COUNTS} FROM (SELECT doc_id, {_PADDED} AS padded FROM documents)))"


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.detected_languages(_chunks(spark, sf_dir).select(F.col("chunk_id").alias("document_id"), "chunk_id", F.coalesce("text", F.lit("")).alias("text")))


_query("detect_language", f"WITH {_LANGUAGES} SELECT document_id, language FROM languages")(_languages)


@_query("docs_by_language", f"WITH {_LANGUAGES} SELECT language, count(*) AS n, min(document_id) AS first_document FROM languages GROUP BY language")
def _by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _languages(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"), F.min("document_id").alias("first_document"))


# what users ask, by document; % stands for its id
_SAID = ("How many documents do you have?", "list the files about topic %", "What is doc_%.pdf about?", "Which documents are in French?", "summarise document %", "tell me about oc_%.pdf", "introduce each document, please", "quels fichiers sont disponibles (%)?", "describe none_%.pdf", "do you have files with DOC_%.PDF?")
_MESSAGES = "messages AS (SELECT doc_id AS message_id, replace(CASE doc_id % 10 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_SAID)) + " END, '%', doc_id::VARCHAR) AS text FROM documents)"


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 10 + 1).cast("int"))
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("message_id"), F.replace(said, F.lit("%"), F.col("doc_id").cast("string")).alias("text"))


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _judged(name: str, column: str, judge, sql: str) -> None:
    _query(name, f"WITH {_MESSAGES} SELECT message_id, {sql} AS {column} FROM messages")(lambda spark, sf_dir: _messages(spark, sf_dir).select("message_id", judge(F.col("text")).alias(column)))


_match = lambda p: f"regexp_matches(text, {_quoted(p)})"
_judged(
    "meta_intent", "intent", routing.intent,
    f"CASE WHEN {_match(routing.LANGUAGE)} THEN 'language' WHEN {_match(routing.LIST_DOCS)} AND NOT regexp_matches(regexp_replace(text, '(?i)\\bdo you have\\b', '', 'g'), {_quoted(routing.CONTENT)}) THEN 'listing' WHEN {_match(routing.ABOUT_FILE)} THEN 'about_file' WHEN {_match(routing.SUMMARISE)} THEN 'summarise' ELSE 'question' END",
)
_judged("meta_intent_ui", "intent", routing.ui_intent, f"CASE WHEN {_match(routing.UI_LIST)} AND NOT {_match(routing.UI_CONTENT)} THEN 'listing' ELSE 'question' END")
_judged("intent_all_docs", "all_documents", routing.wants_all, _match(routing.ALL_DOCS))
_judged("summarise_ref", "ref", routing.summary_ref, f"coalesce(nullif(lower(regexp_extract(text, {_quoted(routing.ABOUT_FILE)}, 2)), ''), nullif(lower(regexp_extract(text, {_quoted(routing.SUMMARISE)}, 3)), ''))")

_FILES = "docs AS (SELECT doc_id AS document_id, 'doc_' || doc_id || '.pdf' AS file, 'doc_' || doc_id AS stem FROM documents)"
_NAMED = f"named AS (SELECT message_id, nullif(regexp_extract(text, {_quoted(routing.FILE_NAME)}, 1), '') AS name FROM messages)"
_MATCHED = r"""names AS (SELECT DISTINCT name, lower(name) AS low, regexp_replace(lower(name), '\.pdf$', '') AS own FROM named WHERE name IS NOT NULL),
near AS (SELECT name, document_id, CASE WHEN file = low THEN 0 WHEN starts_with(stem, own) OR starts_with(own, stem) THEN 1 ELSE 2 END AS stage FROM names JOIN docs ON contains(stem, own) OR contains(own, stem)),
best AS (SELECT name, stage, count(*) AS n, min(document_id) AS document_id FROM near GROUP BY name, stage),
matched AS (SELECT name, document_id FROM best b WHERE stage = (SELECT min(stage) FROM best c WHERE c.name = b.name) AND (stage = 0 OR n = 1))"""


@_query("match_document", f"WITH {_MESSAGES}, {_FILES}, {_NAMED}, {_MATCHED} SELECT name, document_id FROM matched")
def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = _messages(spark, sf_dir).select(F.nullif(F.regexp_extract("text", routing.FILE_NAME, 1), F.lit("")).alias("name")).where("name IS NOT NULL")
    return routing.matched_documents(names, _documents(spark, sf_dir))


@_query("document_scope", f"WITH {_MESSAGES}, {_FILES}, {_NAMED}, {_MATCHED} SELECT message_id, document_id, CASE WHEN document_id IS NULL THEN name END AS unknown_name FROM named LEFT JOIN matched USING (name)")
def _scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.scope(_messages(spark, sf_dir), _documents(spark, sf_dir))


@_query("route_document", f"WITH {_MESSAGES}, {_FILES} SELECT message_id, coalesce(min(document_id), any_value(CASE WHEN regexp_matches(text, '(?i)introduce') THEN 7 END)) AS document_id FROM messages LEFT JOIN docs ON contains(lower(text), file) GROUP BY message_id HAVING coalesce(min(document_id), any_value(CASE WHEN regexp_matches(text, '(?i)introduce') THEN 7 END)) IS NOT NULL")
def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.routed(_messages(spark, sf_dir), _documents(spark, sf_dir), [("introduce", "DOC_7.pdf")])


# Maintenance


@_query(
    "ingest_outcomes",
    """WITH e AS (SELECT doc_id::VARCHAR AS path, sha256(coalesce(text, '')) AS h, doc_id % 17 = 0 AS bad, doc_id % 10 = 0 AS stored FROM documents)
    SELECT path, CASE WHEN bad THEN 'failed' WHEN h IN (SELECT h FROM e WHERE stored) OR path <> min(CASE WHEN NOT bad THEN path END) OVER (PARTITION BY h) THEN 'skipped' ELSE 'ingested' END AS outcome FROM e""",
)
def _outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = ingest.content_hash(_table(spark, sf_dir, "documents")).select(F.col("doc_id").cast("string").alias("path"), "content_hash", F.when(F.col("doc_id") % 17 == 0, "unreadable").alias("error"), "doc_id")
    return files.outcomes(each, each.where("doc_id % 10 = 0"))


@_query("delete_cascade", "SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id <> 3 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id <> 3 UNION ALL SELECT 'pages', count(*) FROM pages WHERE page_id <> 3 UNION ALL SELECT 'images', count(*) FROM embeddings WHERE vec_id <> 3")
def _deleted(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda table, key, *names: _table(spark, sf_dir, table).select(*(F.col(key).alias(n) for n in names))
    left = records.without_document({"documents": of("documents", "doc_id", "document_id"), "labels": of("labels", "doc_id", "document_id"), "pages": of("pages", "page_id", "document_id", "page_id"), "images": of("embeddings", "vec_id", "page_id")}, 3)
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


_register("reset_counts", "documents", lambda df: df.agg(F.count("*").alias("n_deleted")), "SELECT count(*) AS n_deleted FROM documents")


@_query("diagnose_documents", "SELECT doc_id AS document_id, 1 AS page_count, (SELECT count(*) FROM pages WHERE page_id = doc_id) AS n_pages, (SELECT count(*) FROM pages p JOIN labels l ON l.doc_id = p.page_id WHERE p.page_id = documents.doc_id) AS n_images FROM documents")
def _diagnosed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", F.col("page_id").alias("document_id"))
    return records.document_diagnosis(_documents(spark, sf_dir).withColumn("page_count", F.lit(1)), pages, _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")))


@_query("orphan_pages", "SELECT vec_id AS page_id FROM embeddings WHERE vec_id NOT IN (SELECT item_id FROM benchmark)")
def _orphan_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.orphans(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id")), _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id")), "page_id")


@_query("orphan_images", "SELECT doc_id AS page_id FROM labels WHERE doc_id NOT IN (SELECT page_id FROM pages)")
def _orphan_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.orphans(_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), _table(spark, sf_dir, "pages"), "page_id")


# Conversations

_register("list_conversations", "conversations", records.conversations, "SELECT conv_id, left(arg_min(text, turn) FILTER (WHERE role = 'user'), 120) AS title, count(*) AS n_messages, max(turn) AS updated_turn FROM conversations GROUP BY conv_id")
_register("conversation_updated", "conversations", lambda df: records.conversations(df).select("conv_id", "updated_turn"), "SELECT conv_id, max(turn) AS updated_turn FROM conversations GROUP BY conv_id")
_register(
    "load_messages", "conversations", lambda df: records.loaded(df.withColumn("sources", F.when(F.col("turn") % 3 == 0, F.concat(F.lit('["'), "role", F.lit('","x"]'))).when(F.col("turn") % 3 == 1, "[broken"))).select("conv_id", "turn", "role", F.array_join("sources", ";").alias("sources")),
    "SELECT conv_id, turn, role, CASE WHEN turn % 3 = 0 THEN role || ';x' ELSE '' END AS sources FROM conversations",
)
_register("delete_conversation", "conversations", lambda df: df.where(~F.col("conv_id").eqNullSafe(3)).select("conv_id", "turn"), "SELECT conv_id, turn FROM conversations WHERE conv_id IS DISTINCT FROM 3")
_register("empty_conversations", "conversations", lambda df: records.empty_conversations(df, df.where("role = 'system'")), "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM conversations WHERE role = 'system')")

# Evaluation


@_query(
    "eval_relevance",
    f"""WITH {_bm25_sql(K)} SELECT query_id, chunk_id, (query_id % 3 > 0 OR lower(source) = 'WEB'.lower()) AND contains(lower(d.text), lower(left(b.text, 20))) AND contains(lower(d.text), 'e') AS relevant
    FROM lexical JOIN documents d ON chunk_id = doc_id JOIN benchmark b ON item_id = query_id WHERE query_id % 5 > 0""",
)
def _relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, "WEB").alias("expected"), F.when(F.col("item_id") % 5 > 0, F.array(F.substring("text", 1, 20), F.lit("E"))).alias("subs"))
    items = items.where(records.has_signal(F.when(F.col("query_id") % 5 > 0, F.col("expected")), F.col("subs")))
    own = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    hits = _hits(spark, sf_dir, K).join(own, "chunk_id").join(items, "query_id")
    return hits.select("query_id", "chunk_id", records.relevant(F.col("source"), F.col("text"), F.col("expected"), F.col("subs")).alias("relevant"))


def _verdicts(df: DataFrame) -> DataFrame:
    said = F.concat(F.lit('Sure: {"faithfulness": '), F.col("doc_id") % 6, F.lit(', "relevance": "'), F.col("doc_id") % 5, F.lit('"}\ndone'))
    return df.select("doc_id", records.grades(F.when(F.col("doc_id") % 7 == 0, "no grades").otherwise(said)).alias("g")).select("doc_id", "g.*")


_GRADES = "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 6 END::INT AS faithfulness, CASE WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 5 END::INT AS relevance, 0 AS correctness FROM documents"
_register("judge_parse", "documents", _verdicts, _GRADES)
_register("judge_aggregate", "documents", lambda df: records.mean_grades(_verdicts(df)), f"SELECT round(avg(faithfulness), 2) AS faithfulness, round(avg(relevance), 2) AS relevance, round(avg(correctness), 2) AS correctness, count(*) AS n_scored FROM ({_GRADES})")
