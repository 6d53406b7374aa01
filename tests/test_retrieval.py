import random

import pytest

from foliant.config import EngineConfig
from foliant.operators import ingest, records, search

DATA = "/root/testdata/sf0.001"


def test_config_is_checked():
    EngineConfig()
    with pytest.raises(ValueError):
        EngineConfig(overlap_words=300)


def test_sentence_chunks_cover_all_words():
    rng = random.Random(3)
    for _ in range(60):
        text = " ".join(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.choice((1, 4, 30)))) + "." for _ in range(rng.randrange(12)))
        words = text.split()
        seen = set()
        for chunk, first, last in ingest.sentence_chunks(text, 12, 3):
            assert chunk.split() == words[first : last + 1] and last - first < 15
            seen.update(range(first, last + 1))
        assert seen == set(range(len(words)))


def test_packed_lines():
    assert ingest.packed_lines(None) == []
    assert ingest.packed_lines("ab\n\n cd \nefg", 5) == ["ab\ncd", "efg"]
    assert ingest.packed_lines("x\n" + "y" * 12, 5) == ["x", "yyyyy", "yyyyy", "yy"]


def test_citation(spark):
    df = spark.createDataFrame([("a.pdf", 1, "s"), (None, None, None)], "f string, p int, s string")
    got = [r[0] for r in df.select(records.citation(df.f, df.p, df.s)).collect()]
    assert got == ['a.pdf · p.1 · "s"', "unknown source"]


def test_context_is_cut_at_the_first_overflow(spark):
    hits = spark.createDataFrame([(1, 1, "h", "a" * 30), (1, 2, "h", "b" * 50), (1, 3, "h", "c")], "query_id int, pos int, header string, text string")
    got = [r.block for r in search.packed_context(hits, 70, 20).orderBy("pos").collect()]
    assert got == ["[h]\n" + "a" * 30, "[h]\n" + "b" * (70 - 36 - 5) + "…"]
    assert search.packed_context(hits, 50, 20).count() == 1


def test_similar_hits_go(spark):
    hits = spark.createDataFrame([(1, 1, 7, "one two three"), (1, 2, 8, "two"), (1, 3, 9, "four"), (1, 4, 10, "three two one")], "query_id int, pos int, chunk_id int, text string")
    assert [r.chunk_id for r in search.distinct_hits(hits).orderBy("pos").collect()] == [7, 9]


def test_turns(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "a"), (1, 2, "user", "b"), (1, 3, "assistant", "c"), (1, 4, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert [(r.question, r.answer) for r in records.turns(df).collect()] == [("b", "c")]


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
