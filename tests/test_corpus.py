"""Operators against naive models of one document, and against SQLite's full-text index."""

import json
import random
import re
import sqlite3

import pytest

from foliant.chat import models, prompts
from foliant.cli import chat, main
from foliant.engine import Engine
from foliant.functions import stems
from foliant.operators import chunking, ingest, layout, records, routing, search
from foliant.sources import files
from foliant.store import CorpusStore


def _text(rng: random.Random, sentences: int, longest: int = 9) -> str:
    return " ".join(" ".join(f"w{rng.randrange(50)}" for _ in range(rng.randrange(1, longest))) + rng.choice(".!?…") for _ in range(sentences))


def _naive_chunks(text: str, most: int, overlap: int) -> list[tuple[str, int, int]]:
    """Chunks as spelt out: places are counted word by word."""
    out, held, places, at = [], [], [], 0
    put = lambda ws, ps: out.append((" ".join(ws), ps[0], ps[0] + len(ws) - 1))
    for s in re.split(r"(?<=[.!?…])\s+", text):
        ws = s.split()
        ps = list(range(at, at + len(ws)))
        at += len(ws)
        if not ws:
            continue
        if len(ws) > most:
            if held:
                put(held, places)
            held, places = [], []
            for i in range(0, len(ws), max(1, most - overlap)):
                put(ws[i : i + most], ps[i : i + most])
            continue
        if held and len(held) + len(ws) > most:
            put(held, places)
            held, places = (held[-overlap:], places[-overlap:]) if overlap else ([], [])
        held, places = held + ws, places + ps
    if held:
        put(held, places)
    return out


@pytest.mark.parametrize(("most", "overlap"), [(12, 3), (12, 0), (5, 4), (3, 1)])
def test_chunks_are_the_naive_ones(most, overlap):
    rng = random.Random(most * 10 + overlap)
    for _ in range(80):
        text = _text(rng, rng.randrange(12), 16)
        assert ingest.sentence_chunks(text, most, overlap) == _naive_chunks(text, most, overlap)
        said = [s.split() for s in re.split(r"(?<=[.!?…])\s+", text) if s.split()]
        assert [(" ".join(w), a, a + len(w) - 1) for w, a in chunking.split(said, most, overlap)] == _naive_chunks(text, most, overlap)


def test_chunks_of_blocks_are_those_of_one_pass(spark):
    rng = random.Random(5)
    rows = []
    for doc in range(12):
        for page in range(2):
            title = None
            for i in range(rng.randrange(1, 7)):
                if rng.random() < 0.2:
                    title = f"t{rng.randrange(2)}"
                kind = "table" if rng.random() < 0.2 else "text"
                rows.append((doc, doc * 10 + page, doc * 100 + page * 10 + i, i, kind, rng.choice(["", _text(rng, 4), _text(rng, 2, 30)]), title))
    df = spark.createDataFrame(rows, "document_id long, page_id long, block_id long, block_index int, block_type string, text_content string, section_title string")
    got = {(r.block_id, r.chunk_index): (r.text_content, r.start_word, r.end_word, r.prefix_words) for r in chunking.chunked(df, 20, 4).collect()}
    want, tail, last = {}, [], None
    for doc, page, block, _, kind, text, title in rows:
        if (doc, page, title) != last:
            tail = []
        last = (doc, page, title)
        if kind == "table":
            tail = []
            if text.strip():
                want[block, 0] = (text.strip(), 0, len(text.split()) - 1, 0)
            continue
        if not text.strip():
            tail = []
            continue
        chunks = _naive_chunks(" ".join([*tail, text]), 20, 4)
        for n, (said, a, b) in enumerate(chunks):
            want[block, n] = (said, max(0, a - len(tail)), max(0, b - len(tail)), len(tail))
        tail = chunks[-1][0].split()[-4:]
    assert got == want


def test_topics_end_chunks(spark):
    text = "red apples grow. red apples fall. red apples rot. cold iron rusts. cold iron bends."
    said = [s.split() for s in re.split(r"(?<=[.])\s+", text)]
    cuts = chunking.topic_cuts(search.sentence_vectors([" ".join(s) for s in said]))
    assert cuts == {3}
    assert [" ".join(w) for w, _ in chunking.split(said, 300, 0, cuts)] == [text[:49], text[50:]]


def test_stems_and_scores_are_sqlites(spark, tmp_path):
    rng = random.Random(8)
    parts = ["relat", "hop", "happ", "caress", "pon", "trouble", "conform", "adjust", "electr", "caf", "é", "formal", "oper", "ator", "ational", "ing", "ed", "s", "ies", "y", "ness", "ful", "ement", "ion", "ize", "ll", "e", "eed", "able", "iveness"]
    words = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(1500)} | {"the", "sky", "by", "generalizations", "oscillators", "agreed", "falling", "hissing", "sized", "roll", "controlling"})
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(body, tokenize='porter unicode61')")
    db.execute("CREATE VIRTUAL TABLE v USING fts5vocab(t, 'instance')")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", list(enumerate(words, 1)))
    theirs = {words[doc - 1]: term for term, doc in db.execute("SELECT term, doc FROM v")}
    assert {w: stems.index_form(w) for w in words} == theirs

    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(3, 40)))) for i in range(300)]
    db.execute("DELETE FROM t")
    db.executemany("INSERT INTO t(rowid, body) VALUES (?, ?)", docs)
    store = CorpusStore(spark, str(tmp_path / "s"))
    rows = [(i, t) for i, t in docs]
    for part in (rows[:200], rows[200:]):  # the index grows
        store.append("chunks", spark.createDataFrame(part, "chunk_id long, text_content string"))
        store.index()
    store.index()
    assert store.read("doc_lengths").count() == 300
    query = " ".join(rng.choice(words) for _ in range(6)) + " zebra"
    got = {r.chunk_id: r.score for r in store.search(spark.createDataFrame([(1, query)], "query_id long, query string"), 1000).collect()}
    match = " OR ".join(f'"{w}"' for w in query.split())
    want = {i: -s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (match,))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-5 for i in want)


def test_engine_from_files_to_answers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "fish.txt").write_text("Herrings swim in cold water.\fSalmon climb rivers in autumn. " * 8)
    (tmp_path / "in" / "copy.txt").write_text("Herrings swim in cold water.\fSalmon climb rivers in autumn. " * 8)
    (tmp_path / "in" / "trees.txt").write_text("Oaks lose their leaves in autumn.")
    (tmp_path / "in" / "bad.txt").write_bytes(b"\xff\xfe\xff")
    said = []
    say = lambda *x: said.append(" ".join(map(str, x)))
    store = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        main(["list", "--store", store], spark)
    main(["ingest", str(tmp_path / "in"), "--store", store], spark, say=say)
    assert [x.rsplit("/", 1)[1] for x in said] == ["bad.txt failed", "copy.txt ingested", "fish.txt skipped", "trees.txt ingested"]
    said.clear()
    main(["build", "--store", store], spark, say=say)
    main(["chunk", "--store", store], spark, say=say)
    assert int(said[0].split()[0]) > 0 and said[1] == "0 chunks added"
    engine = Engine(spark, store, must_exist=True)
    assert engine.store.read("doc_lengths").count() == engine.store.read("chunks").count() == int(said[0].split()[0])
    best = engine.retrieve("leaves of oaks").orderBy("pos").first()
    assert best.citation == "trees.txt · p.1" and "Oaks" in best.text
    assert "Oaks lose" in engine.ask(models.Echo(), "oak leaves", k=2)
    assert "Salmon" in engine.summarise(models.Echo(), "COPY.txt")
    assert engine.diagnose()["orphan_pages"] == 0
    lines = iter(["how many documents do you have", "where do oaks lose leaves", "forget", "quit"])
    said.clear()
    chat(engine, models.Echo(), read=lambda _: next(lines), say=say, k=2, mode="lexical")
    assert "trees.txt" in said[0] and "Oaks" in said[1]
    gone = engine.store.read("documents").where("filename = 'trees.txt'").first().document_id
    engine.store.delete_document(gone)
    assert engine.store.read("chunks").where(f"document_id = {gone}").count() == 0 and engine.diagnose()["documents"] == 1
    assert engine.store.read("doc_lengths").count() == engine.store.read("chunks").count()
    assert engine.store.reset() == 1 and engine.store.read("pages").count() == 0


def test_provider_chain():
    slept = []
    gone, quota, busy = (RuntimeError(x) for x in ("model does not exist", "429 quota", "503 overloaded"))
    a, b = models.Scripted([gone, quota]), models.Scripted([busy, busy, "b1", "b2"])
    chain = models.Chain([("a", a), ("b", b), ("a", models.Echo())], sleep=slept.append)
    assert [n for n, _ in chain.providers] == ["a", "b"]
    assert chain.generate("", "x") == "b1" and slept == [3.0, 3.0] and chain.name == "b"
    assert list(chain.stream("", "x")) == ["b2"]
    with pytest.raises(RuntimeError, match="all providers"):
        models.Chain([("a", models.Scripted([busy] * 3))], sleep=slept.append).generate("", "x")
    with pytest.raises(ValueError):
        models.Chain([("a", models.Scripted([ValueError("bad request")])), ("b", models.Echo())]).generate("", "x")
    with pytest.raises(RuntimeError):
        models.Chain([])


def test_prompts():
    assert prompts.variants("1. a\n- 'B'\n\nb\n* c") == ["a", "B", "c"]
    assert prompts.expanded(models.Scripted(["x\nq\ny\nz"]), "q", 2) == ["q", "x", "y"]
    assert prompts.expanded(models.Scripted([OSError()]), "q", 2) == ["q"] == prompts.expanded(models.Echo(), "q", 0)
    assert prompts.rewritten(models.Scripted([]), "q", " ") == "q" and prompts.rewritten(models.Scripted(["r"]), "q", "User: a") == "r"
    assert prompts.asked(models.Echo(), "q", " ") == prompts.NOTHING
    assert models.ocr_image(models.missing("engine"), b"") == ("", 0, 0.0)
    assert models.describe_image(models.missing("client"), b"", "c") == "[no description]"


def test_span_blocks(spark):
    span = "struct<text:string,size:double,flags:int>"
    schema = f"page_id long, blocks array<struct<type:int,lines:array<struct<spans:array<{span}>>>>>"
    line = lambda *s: {"spans": [dict(zip(("text", "size", "flags"), x, strict=True)) for x in s]}
    blocks = [{"type": 0, "lines": [line((" Big ", 20.0, 0), ("title", 20.0, 0))]}, {"type": 1, "lines": []}, {"type": 0, "lines": [line((" ", 10.0, 0))]}, {"type": 0, "lines": [line(("body", 10.0, 0)), line(("more", 10.0, 0))]}, {"type": 0, "lines": [line(("bold", 10.0, 16))]}]
    got = layout.span_blocks(spark.createDataFrame([(1, blocks), (2, [])], schema)).orderBy("block_index").collect()
    assert [(r.block_index, r.block_type, r.text_content) for r in got] == [(0, "heading", "Big title"), (3, "text", "body\nmore"), (4, "heading", "bold")]


def test_scanned_lines_and_drawings(spark):
    box = [{"x": 0.0, "y": 0.0}, {"x": 4.0, "y": 1.0}, {"x": 4.0, "y": 3.0}, {"x": 0.0, "y": 2.0}]
    df = spark.createDataFrame([(1, [{"box": box, "text": " a b "}, {"box": box, "text": ""}]), (2, [])], "id long, lines array<struct<box:array<struct<x:double,y:double>>,text:string>>")
    got = [tuple(r.o) for r in df.select("id", layout.ocr_lines(df.lines).alias("o")).orderBy("id").collect()]
    assert got == [("a b", 2, 24.0), ("", 0, 0.0)]
    rects = spark.createDataFrame([(0.0, [(1.0, 1.0)]), (10.0, [(-1.0, 5.0), (9.0, 2.0)])], "area double, rects array<struct<width:double,height:double>>")
    assert [tuple(r.s) for r in rects.select("area", layout.vector_stats(rects.rects, rects.area).alias("s")).orderBy("area").collect()] == [(0, 0.0), (1, 1.0)]


def test_grids(spark):
    grids = [[["a", None], ["b|c", "d\ne", "x"]], [["a"]], [], [["h", "k"], ["x" * 501, "y"]], [["h", "k"], ["", None]]]
    df = spark.createDataFrame(list(enumerate(grids)), "id long, grid array<array<string>>")
    got = df.select("id", layout.markdown(df.grid).alias("m"), layout.valid_grid(df.grid).alias("v")).orderBy("id").collect()
    assert got[0].m == "| a |  |\n| --- | --- |\n| b&#124;c | d<br>e |" and got[2].m == ""
    assert [r.v for r in got] == [True, False, False, False, True]


def test_sources(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"question": "q", "expected_substrings": ["a"]}\n\n{"question": "r", "expected_source": "f.pdf"}\n')
    got = files.eval_set(spark, str(path)).orderBy("item_no").collect()
    assert [(r.item_no, r.question, r.expected_source, r.expected_substrings, r.reference_answer) for r in got] == [(1, "q", None, ["a"], ""), (3, "r", "f.pdf", [], "")]
    for bad, says in (("{", "line 1: no JSON"), ('{"question": "q"}\n{"x": 1}', "line 2: no question")):
        path.write_text(bad)
        with pytest.raises(Exception, match=says):
            files.eval_set(spark, str(path)).collect()
    files.write_report(str(tmp_path / "r.json"), {"k": 8}, {}, [])
    assert json.loads((tmp_path / "r.json").read_text())["config"] == {"k": 8}
    assert files.unpack_vector(files.pack_vector([1.0, -0.5])) == [1.0, -0.5]


def test_relevance(spark):
    df = spark.createDataFrame([("F.pdf", "A text", "f.PDF", ["a", "TEXT"]), ("g.pdf", "A text", "f.pdf", []), ("g.pdf", None, None, ["a"]), ("g.pdf", "b", None, None)], "f string, t string, s string, subs array<string>")
    assert [r[0] for r in df.select(records.relevant(df.f, df.t, df.s, df.subs)).collect()] == [True, False, False, True]
    assert [r[0] for r in df.select(records.has_signal(df.s, df.subs)).collect()] == [True, True, True, False]


def test_ambiguous_names_match_nothing(spark):
    docs = spark.createDataFrame([(0, "tmp_im.pdf"), (1, "report1.pdf"), (2, "report2.pdf"), (3, "ab.pdf")], "document_id long, filename string")
    names = spark.createDataFrame([("im.pdf",), ("report.pdf",), ("REPORT2.pdf",), ("abc.pdf",), ("zz.pdf",)], "name string")
    assert {r.name: r.document_id for r in routing.matched_documents(names, docs).collect()} == {"im.pdf": 0, "REPORT2.pdf": 2, "abc.pdf": 3}
