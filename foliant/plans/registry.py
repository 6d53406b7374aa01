"""Queries of the retrieval operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.config import DEFAULT
from foliant.functions import text as T
from foliant.operators import ingest, records, search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

K = 10


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _register(name: str, table: str, make: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(_table(spark, sf_dir, table))
    if sql:
        ORACLE_SQL[name] = sql


def _query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as one chunk each."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


# Ingest

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\s\x0B]+'), lambda w: w <> '')"
_STRIPPED = r"regexp_replace(coalesce(text, ''), '^[\s\x0B]+|[\s\x0B]+$', '', 'g')"
_STATS = f"SELECT doc_id, len({_WORDS})::BIGINT AS n_words, length({_STRIPPED})::BIGINT AS n_chars_stripped FROM documents"

_register("doc_content_hash", "documents", ingest.content_hash, "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash FROM documents")
_register(
    "ingest_dedup", "documents", ingest.deduplicated,
    "SELECT doc_id, sha256(coalesce(text, '')) AS content_hash, CASE WHEN doc_id = min(doc_id) OVER (PARTITION BY coalesce(text, '')) THEN 'ingested' ELSE 'skipped' END AS outcome FROM documents",
)
_register("text_stats", "documents", ingest.text_stats, _STATS)
_register("page_classify", "documents", ingest.classified, f"SELECT doc_id, CASE WHEN n_words >= 30 AND n_chars_stripped >= 180 THEN 'text' ELSE 'ocr' END AS source FROM ({_STATS})")
_register(
    "sentence_split", "documents", ingest.sentences,
    r"""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?…])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, (i - 1)::INT AS sentence_no, l[i] AS sentence FROM (SELECT doc_id, l, unnest(generate_series(1, len(l))) AS i FROM s)""",
)
_register(
    "chunk_hard_windows", "documents", ingest.hard_windows,
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
        SELECT doc_id, (s // 240)::INT AS chunk_index, s::INT AS start_word, least(s + 299, len(w) - 1)::INT AS end_word, array_to_string(w[s + 1:s + 300], ' ') AS text_content
        FROM (SELECT doc_id, w, unnest(generate_series(0, len(w) - 1, 240)) AS s FROM w WHERE len(w) > 0)""",
)
_register("blocks_from_text", "documents", ingest.blocks)
_register("chunk_word_count", "documents", ingest.chunks)

# Index and search

_TERMS = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}\p{Co}]+'), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_QUERY_TERMS = f"CASE WHEN len(list_filter({_TERMS}, lambda w: w NOT IN ({_STOP}))) > 0 THEN list_filter({_TERMS}, lambda w: w NOT IN ({_STOP})) ELSE {_TERMS} END"

_register("fts_postings", "documents", lambda docs: search.postings(docs.withColumnRenamed("doc_id", "chunk_id")), f"SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY ALL")
_register(
    "term_stats", "documents", lambda docs: search.postings(docs.withColumnRenamed("doc_id", "chunk_id")).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("occurrences")),
    f"SELECT term, count(DISTINCT doc_id) AS df, count(*)::BIGINT AS occurrences FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY term",
)
_register(
    "query_terms", "conversations", lambda df: df.where("role = 'user'").select("conv_id", "turn", F.array_join(T.query_terms(F.col("text")), " ").alias("terms")),
    f"SELECT conv_id, turn, array_to_string({_QUERY_TERMS}, ' ') AS terms FROM conversations WHERE role = 'user'",
)


def _bm25_sql(k: int) -> str:
    return f"""
lex_d AS (SELECT doc_id AS chunk_id, {_TERMS} AS ts FROM documents),
lex_n AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM lex_d),
lex_tf AS (SELECT chunk_id, dl, term, count(*) AS tf FROM (SELECT chunk_id, len(ts) AS dl, unnest(ts) AS term FROM lex_d) GROUP BY ALL),
lex_df AS (SELECT term, count(*) AS df FROM lex_tf GROUP BY term),
lex_q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_QUERY_TERMS}) AS term FROM benchmark) GROUP BY ALL),
lex_s AS (SELECT query_id, chunk_id, round(sum(times * CASE WHEN ln((n - df + 0.5) / (df + 0.5)) > 0 THEN ln((n - df + 0.5) / (df + 0.5)) ELSE 1e-6 END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
          FROM lex_q JOIN lex_tf USING (term) JOIN lex_df USING (term), lex_n GROUP BY ALL),
lexical AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex_s) WHERE rank <= {k})"""


def _cosine_sql(k: int, queries: str) -> str:
    dot = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))"
    return f"""
dense_s AS (SELECT b.vec_id AS query_id, a.vec_id AS chunk_id, round({dot}, 6) AS score FROM embeddings a, (SELECT * FROM embeddings WHERE {queries}) b),
dense AS (SELECT query_id, rank, chunk_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM dense_s) WHERE rank <= {k})"""


def _lexical(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return search.bm25(_chunks(spark, sf_dir), _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")), k)


def _hits(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The lexical hits, to be joined with documents."""
    return search.light(_lexical(spark, sf_dir, k), _table(spark, sf_dir, "benchmark"), k)


def _dense(spark: SparkSession, sf_dir: str, k: int, queries: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.where(queries.replace("vec_id", "chunk_id")).withColumnRenamed("chunk_id", "query_id")
    return search.cosine(vectors, asked, k)


_ASKED = "vec_id % 50 = 0"
#: Benchmark items stand for vectors of the same id in hybrid queries.
_PAIRED = "vec_id IN (SELECT item_id FROM benchmark)"


@_query("bm25_search", f"WITH {_bm25_sql(K)} SELECT query_id, rank, chunk_id, score FROM lexical")
def _bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lexical(spark, sf_dir, K)


@_query("semantic_search", f"WITH {_cosine_sql(K, _ASKED)} SELECT query_id, rank, chunk_id, score FROM dense")
def _semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dense(spark, sf_dir, K, _ASKED)


_register("l2_normalize", "embeddings", lambda df: df.select("vec_id", F.round(search.norm(F.col("embedding")), 6).alias("norm")), "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = 2 * DEFAULT.top_k
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    asked = vectors.join(_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id")), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id")
    return _lexical(spark, sf_dir, k), search.cosine(vectors, asked, k)


def _hybrid_sql(guaranteed: int) -> str:
    k = DEFAULT.top_k
    return f"""WITH {_bm25_sql(2 * k)}, {_cosine_sql(2 * k, _PAIRED)},
both_legs AS (SELECT query_id, chunk_id, l.rank AS rl, d.rank AS rd, round(0.4 / (60 + coalesce(l.rank, {2 * k + 1})) + 0.6 / (60 + coalesce(d.rank, {2 * k + 1})), 9) AS score
         FROM lexical l FULL JOIN dense d USING (query_id, chunk_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rl NULLS LAST, rd NULLS LAST, chunk_id) AS p FROM both_legs)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY least(p, {k + 1}), CASE WHEN p > {k} THEN rd ELSE 0 END) AS pos, chunk_id, score::DOUBLE AS score
FROM placed WHERE p <= {k} OR coalesce(rd, {guaranteed + 1}) <= {guaranteed}"""


@_query("hybrid_rrf", _hybrid_sql(0))
def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(*_legs(spark, sf_dir))


@_query("hybrid_guaranteed", _hybrid_sql(DEFAULT.guaranteed_semantic))
def _guaranteed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.hybrid(*_legs(spark, sf_dir), guaranteed=DEFAULT.guaranteed_semantic)


@_query(
    "fuse_rankings",
    f"""WITH {_bm25_sql(2 * DEFAULT.top_k)}, {_cosine_sql(2 * DEFAULT.top_k, _PAIRED)},
    l AS (SELECT query_id, 0 AS list_no, rank, chunk_id FROM lexical UNION ALL SELECT query_id, 1, rank, chunk_id FROM dense),
    t AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score, min(list_no * 1000 + rank) AS seen FROM l GROUP BY ALL)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen, chunk_id) AS pos, chunk_id, score FROM t""",
)
def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexical, dense = _legs(spark, sf_dir)
    listed = lambda df, n: df.select("query_id", F.lit(n).alias("list_no"), "rank", "chunk_id")
    return search.fused(listed(lexical, 0).unionByName(listed(dense, 1)))


@_query("dedup_greedy")
def _distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, 2 * DEFAULT.top_k).withColumnRenamed("rank", "pos").join(_chunks(spark, sf_dir), "chunk_id")
    return search.distinct_hits(hits).select("query_id", "pos", "chunk_id")


@_query(
    "context_pack",
    f"""WITH {_bm25_sql(K)},
    h AS (SELECT query_id, rank AS pos, 'doc_' || chunk_id || '.pdf · p.1' AS header, {_STRIPPED} AS t FROM lexical JOIN documents ON chunk_id = doc_id),
    b AS (SELECT *, '[' || header || ']' || chr(10) || t AS block FROM h),
    c AS (SELECT *, 12000 - (sum(length(block) + 2) OVER (PARTITION BY query_id ORDER BY pos) - length(block) - 2) AS room, length(block) + 2 AS cost FROM b),
    o AS (SELECT *, sum(CASE WHEN cost > room THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY pos) AS n_over FROM c)
    SELECT query_id, pos, CASE WHEN cost > room THEN '[' || header || ']' || chr(10) || left(t, (room - length(header) - 4)::INT) || '…' ELSE block END AS block
    FROM o WHERE (n_over = 0) OR (n_over = 1 AND cost > room AND room >= 200)""",
)
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _hits(spark, sf_dir, K).join(_chunks(spark, sf_dir), "chunk_id")
    header = records.citation(records.filename(F.col("chunk_id")), F.lit(1), F.lit(None).cast("string"))
    return search.packed_context(hits.select("query_id", F.col("rank").alias("pos"), header.alias("header"), "text"))


_SCORES_SQL = f"""WITH {_bm25_sql(K)},
r AS (SELECT query_id, rank, contains(lower(d.text), lower(b.text)) AS relevant FROM lexical JOIN documents d ON chunk_id = d.doc_id JOIN benchmark b ON query_id = b.item_id),
s AS (SELECT query_id, sum(relevant::INT) > 0 AS hit, round(sum(relevant::INT)::DOUBLE / count(*), 3) AS recall, min(CASE WHEN relevant THEN rank::DOUBLE END) AS first_rank,
             round(coalesce(1.0::DOUBLE / min(CASE WHEN relevant THEN rank END), 0), 3) AS reciprocal_rank, sum(relevant::INT)::BIGINT AS n_relevant, count(*) AS n_retrieved FROM r GROUP BY query_id)"""


@_query("eval_scores", f"{_SCORES_SQL} SELECT * FROM s")
def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.lower("text").alias("passage"))
    hits = _hits(spark, sf_dir, K).join(_chunks(spark, sf_dir), "chunk_id").join(items, "query_id")
    return records.scores(hits.select("query_id", "rank", F.contains(F.lower("text"), F.col("passage")).alias("relevant")))


@_query("eval_aggregate", f"{_SCORES_SQL} SELECT round(avg(hit::INT), 3) AS hit_rate, round(avg(recall), 3) AS recall, round(avg(reciprocal_rank), 3) AS mrr, count(*) AS n_scored FROM s")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.summary(_scored(spark, sf_dir))


# Catalogue and maintenance

_register("list_documents", "documents", lambda df: df.select("doc_id", records.filename(F.col("doc_id")).alias("filename"), F.lit(1).alias("page_count")), "SELECT doc_id, 'doc_' || doc_id || '.pdf' AS filename, 1 AS page_count FROM documents")
_register("citations", "documents", lambda df: df.select("doc_id", records.citation(records.filename(F.col("doc_id")), F.lit(1), F.col("source")).alias("citation")), "SELECT doc_id, 'doc_' || doc_id || '.pdf · p.1' || CASE WHEN length(source) > 0 THEN ' · \"' || source || '\"' ELSE '' END AS citation FROM documents")


@_query("embed_incremental", "SELECT doc_id AS chunk_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def _unembedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    return _chunks(spark, sf_dir).select("chunk_id").join(done, "chunk_id", "left_anti")


@_query("orphan_labels", "SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id IS NOT NULL)")
def _orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "labels").select("doc_id").join(_table(spark, sf_dir, "documents"), "doc_id", "left_anti")


@_query(
    "diagnose_totals",
    "SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'conversations', count(*) FROM conversations",
)
def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [_table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("documents", "pages", "embeddings", "conversations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


# Conversations

_TURNS = "(SELECT conv_id, turn, text AS answer, role, lag(role) OVER w AS before, lag(text) OVER w AS question FROM conversations WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"
_MEMORY = f"(SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM {_TURNS} WHERE role = 'assistant' AND before = 'user')"
_register("conversation_titles", "conversations", records.titles, "SELECT conv_id, left(arg_min(text, turn), 120) AS title FROM conversations WHERE role = 'user' GROUP BY conv_id")
_register("conversation_turns", "conversations", records.turns, f"SELECT conv_id, turn, question, answer FROM {_TURNS} WHERE role = 'assistant' AND before = 'user'")
_register("memory_window", "conversations", lambda df: records.memory(df).select("conv_id", "turn", "age"), f"SELECT conv_id, turn, age FROM {_MEMORY} WHERE age <= 6")
_register(
    "memory_transcript", "conversations", records.transcript,
    f"SELECT conv_id, string_agg('User: ' || question || chr(10) || 'Assistant: ' || CASE WHEN length(answer) > 600 THEN rtrim(left(answer, 600)) || '…' ELSE answer END, chr(10) ORDER BY turn) AS transcript FROM {_MEMORY} WHERE age <= 6 GROUP BY conv_id",
)
