"""Steps that must not grow faster than their input, held against naive models, and their plans."""

import math
import random
import re
import zlib

import pyarrow as pa
from pyspark.sql import functions as F

from foliant.functions import batches
from foliant.operators import chunking, ingest, layout, routing, search


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _naive_vector(text: str | None, size: int) -> list[float]:
    out = [0.0] * size
    for term in re.findall(r"[^\W_]+", (text or "").lower()):
        out[zlib.crc32(term.encode()) % size] += 1 if zlib.crc32(b"+" + term.encode()) % 2 == 0 else -1
    length = math.sqrt(sum(x * x for x in out)) or 1
    return [x / length for x in out]


def test_hashed_vectors_need_no_shuffle(spark):
    rows = [(1, "One two, two. Ünï"), (2, None), (3, "..."), (None, "one")]
    got = search.hashed_vectors(spark.createDataFrame(rows, "chunk_id long, text string"), 16)
    assert "Exchange" not in _plan(got) and "try_element_at" not in _plan(got)
    found = {r.chunk_id: r.embedding for r in got.collect()}
    assert found.keys() == {1, 2, 3, None}
    assert all(abs(x - y) < 1e-6 for i, t in rows for x, y in zip(found[i], _naive_vector(t, 16), strict=True))


def test_names_are_matched_as_pair_by_pair(spark):
    """Against all pairs, and with no table of names broadcast."""
    rng = random.Random(4)
    files = sorted({"".join(rng.choice("ab_") for _ in range(rng.randrange(1, 7))) + rng.choice([".pdf", ".PDF", ""]) for _ in range(60)}) + [None]
    asked = sorted({"".join(rng.choice("abA_") for _ in range(rng.randrange(0, 9))) + ".pdf" for _ in range(150)})
    docs = spark.createDataFrame(list(enumerate(files)), "document_id long, filename string")
    got = routing.matched_documents(spark.createDataFrame([(x,) for x in asked * 2], "name string"), docs)
    # only the single rows of lengths are broadcast
    assert _plan(got).count("BroadcastExchange") == _plan(got).count("BroadcastNestedLoopJoin") == 2
    bare = lambda x: re.sub(r"\.pdf$", "", x.lower())
    want = {}
    for name in asked:
        own, stages = bare(name), {}
        for i, file in enumerate(files[:-1] if own else []):
            a = bare(file)
            if own in a or (a and a in own):
                kind = 0 if file.lower() == name.lower() else 1 if a.startswith(own) or own.startswith(a) else 2
                stages.setdefault(kind, []).append(i)
        if stages and (min(stages) == 0 or len(stages[min(stages)]) == 1):
            want[name] = min(stages[min(stages)])
    assert {r.name: r.document_id for r in got.collect()} == want and len(want) > 20


def test_bm25_in_place_is_that_of_joins(spark, monkeypatch):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(30)]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(40)))) for i in range(700)] + [(-1, None), (-2, "w1 w2"), (-3, "w1 w2")]
    asked = [("a", "w1 w2 w2 the"), ("b", "w3"), (None, "w4 w5"), ("none", "zebra"), ("empty", ""), ("a", "w7")]
    chunks = spark.createDataFrame(texts, "chunk_id long, text string").repartition(3)
    queries = spark.createDataFrame(asked, "query_id string, query string")
    got = search.bm25(chunks, queries, 5)
    assert _plan(got).count("explode") == 0  # texts' terms are not rows
    monkeypatch.setattr(search, "MAX_BAG", 3)
    want = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in search.bm25(chunks, queries, 5).collect()}
    assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in got.collect()} == want and len(want) == 15


def test_cosine_in_cells_is_that_of_all_pairs(spark):
    """With ties, and vectors without numbers or of another length, which come last without a score."""
    rng = random.Random(7)
    rows = [(i, [rng.choice([-0.5, 0.25, 0.5]) for _ in range(4)]) for i in range(300)] + [(900, None), (901, [1.0]), (902, [0.5, None, 0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "chunk_id long, embedding array<float>")
    asked = [(f"q{i}", v) for i, v in rows[:40]] + [("null", None), ("short", [1.0])]
    queries = spark.createDataFrame(asked, "query_id string, embedding array<float>")
    # a null score is last
    score = lambda a, b: round(sum(x * y for x, y in zip(a, b)), 6) if a and b and len(a) == len(b) and None not in [*a, *b] else None
    for k, vs in ((5, rows), (10, rows[-6:])):
        got = search.cosine(vectors.where(f"chunk_id >= {vs[0][0]}"), queries, k, block=16, pairs=1000)
        want = {}
        for q, a in asked:
            found = sorted(((score(a, b), i) for i, b in vs), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))
            want |= {(q, n): (i, s) for n, (s, i) in enumerate(found[:k], 1)}
        assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in got.collect()} == want
    assert "collect_list" not in _plan(got) and "zip_with" not in _plan(got)


def test_hits_are_broadcast_to_texts(spark):
    from foliant.plans import corpus, registry  # noqa: F401 (corpus registers its queries)

    for name in ("context_pack", "eval_scores", "rerank", "source_list", "eval_relevance", "bm25_search_doc"):
        first = next(x for x in _plan(registry.QUERIES[name](spark, "/root/testdata/sf0.001")).splitlines()[::-1] if "Join" in x and "chunk_id" in x)
        assert "BroadcastHashJoin" in first, name


def test_a_grid_is_worked_out_once(spark):
    df = spark.createDataFrame([(1, ["a", " b\n"]), (2, [])], "id long, cells array<string>")
    made = df.select("id", layout.markdown(F.when(F.size("cells") > 0, F.array(F.array(F.lit("onlyhere")), F.col("cells"))).otherwise(F.array().cast("array<array<string>>"))).alias("m"))
    assert _plan(made).count("onlyhere") <= 2  # the plan's tree and its details
    assert [r.m for r in made.orderBy("id").collect()] == ["| onlyhere |\n| --- |\n| a |", ""]


def test_texts_go_through_workers_some_at_a_time(spark):
    batch = pa.RecordBatch.from_pydict({"x": list(range(70))})
    assert [b.num_rows for b in batches.slices(iter([batch]), 32)] == [32, 32, 6]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10000)
    docs = spark.createDataFrame([(i, "one. two.") for i in range(200)], "doc_id long, text string").coalesce(1)
    ingest.chunks(docs)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 1000
    # a batch of texts that a worker has made into pieces is no larger than a slice
    made = ingest.chunks(docs).mapInArrow(lambda bs: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in bs), "n long")
    assert sum(r.n for r in made.collect()) == 200


def test_postings_need_no_shuffle(spark):
    rows = [(1, "b a b"), (2, None), (None, "a")]
    got = search.postings(spark.createDataFrame(rows, "chunk_id long, text string"))
    assert "Exchange" not in _plan(got)
    assert {(r.chunk_id, r.term): r.tf for r in got.collect()} == {(1, "a"): 1, (1, "b"): 2, (None, "a"): 1}
    twice = search.postings(spark.createDataFrame([*rows, (1, "b c")], "chunk_id long, text string"))
    assert {(r.chunk_id, r.term): r.tf for r in twice.collect()} == {(1, "a"): 1, (1, "b"): 3, (1, "c"): 1, (None, "a"): 1}


def test_similar_hits_go_in_order(spark):
    rng = random.Random(9)
    rows = [(q, pos, rng.randrange(99), rng.choice([None, "", " ".join(rng.choices("abcd", k=rng.randrange(1, 6)))])) for q in (None, 1, 2) for pos in range(1, 30)]
    got = search.distinct_hits(spark.createDataFrame(rows, "query_id long, pos int, chunk_id long, text string"), 0.6)
    assert "array_intersect" not in _plan(got)
    want = []
    for q in (None, 1, 2):
        kept = []
        for _, _, chunk, text in (r for r in rows if r[0] == q):
            own = set((text or "").split())
            if not any((t and text and (t in text or text in t)) or (w | own and len(w & own) >= 0.6 * len(w | own)) for t, w in kept):
                kept.append((text, own))
                want.append((q, len(kept), chunk, text))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_sentence_vectors_are_the_naive_ones_and_runs_go_as_arrow(spark):
    said = ["One two, two.", "Ünï çode", "", "..."]
    for row, s in zip(search.sentence_vectors(said, 16), said, strict=True):
        assert all(abs(x - y) < 1e-12 for x, y in zip(row, _naive_vector(s, 16), strict=True))
    rows = [(1, None, 2, 0, "text", "a b. c d.", None), (1, None, 1, 0, "table", " t ", "s"), (1, 7, 3, 0, "text", None, "s")]
    blocks = spark.createDataFrame(rows, "document_id long, page_id long, block_id long, block_index int, block_type string, text_content string, section_title string")
    made = chunking.chunked(blocks, embed=search.sentence_vectors)
    assert "MapInPandas" not in _plan(made)
    assert sorted((r.block_id, r.page_id, r.text_content, r.section_title, r.chunk_method) for r in made.collect()) == [(1, None, "t", "s", "atomic"), (2, None, "a b. c d.", None, "semantic")]
