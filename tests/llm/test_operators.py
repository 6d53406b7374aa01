import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliant.llm._bytes import buffers as _buffers
from foliant.llm import bestfit, decontaminate, extract, katz, matrices, neardup, quality, suffixes, tokens, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, held string, words string"


def words(rng, n, kinds=200):
    return " ".join(f"w{rng.randrange(kinds)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = words(rng, 120)
    shared = words(rng, 60)
    near = base.split()
    near[60] = "changed"
    return [None, "", " \n", "one two", base, base, " ".join(near), words(rng, 50) + " " + shared + " " + words(rng, 50), words(rng, 40) + " " + shared, "line\n" * 30, words(rng, 3000), "é ü 😀 " * 40]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None, "s", None, "x", "y") for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, (None, "a null id", None, None, None, None, None), rows[4]], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_quality_matches_sql(docs, empty):
    good = docs.where("doc_id IS NOT NULL").distinct()
    documents = good.select("doc_id", "text").toPandas()
    con = duckdb.connect()
    con.register("documents", documents)
    want = sorted(con.sql(quality.SQL).fetchall())
    assert sorted(tuple(r) for r in quality.rated(good.select("doc_id", "text")).select(*quality.RESULT).collect()) == want
    assert quality.accepted(docs).columns == docs.columns and quality.accepted(empty).count() == 0


def test_near_duplicates(docs, empty):
    got = {(r.doc_id): r.class_id for r in neardup.grouped(docs).distinct().collect()}
    assert got[4] == got[5] == got[6] == 4 and got[0] == got[1] and got[7] == 7 and len(got) == 13
    assert neardup.representatives(docs).columns == docs.columns
    assert neardup.grouped(empty).count() == 0


def test_near_duplicates_of_a_hub(spark):
    rng = random.Random(3)
    base = [f"b{k}" for k in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 151):
        edited = list(base)
        for q in range(4):
            edited[50 * q + rng.randrange(5, 45)] = f"e{i}x{q}"
        rows.append((i, " ".join(edited)))
    split = [t.split() for _, t in rows]
    bags = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in split]
    alike = lambda x, y: len(x & y) / len(x | y) >= neardup.SIMILARITY
    assert all(alike(bags[0], x) for x in bags[1:]) and sum(alike(x, y) for i, x in enumerate(bags[1:]) for y in bags[1 : i + 1]) < 150
    # so many other texts that no shingle is common
    rows += [(1000 + i, f"other text {i}") for i in range(7600)]
    got = {r.doc_id: r.class_id for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(151)} == {0} and all(got[i] == i for i, _ in rows[151:])


def test_links_of_near_duplicates_are_found(spark):
    """Recall against all pairs: groups of copies, each with more edits than the one before, and their own originals."""
    rng = random.Random(11)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(150)]
        for i in range(40):
            edited = list(base)
            for _ in range(rng.randrange(0, 9)):
                edited[rng.randrange(150)] = f"e{rng.randrange(10**9)}"
            rows.append((g * 1000 + i, " ".join(edited)))
    # so many other texts that no shingle is common
    rows += [(10**6 + i, words(rng, 12, 10**6)) for i in range(2000)]
    got = {r.doc_id: r.class_id for r in neardup.grouped(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    bags = {i: Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)) for i, ws in ((i, t.split()) for i, t in rows[:480])}
    n = both = 0
    for i in bags:
        for j in bags:
            if i < j and i // 1000 == j // 1000 and (bags[i] & bags[j]).total() >= neardup.SIMILARITY * (bags[i] | bags[j]).total():
                n, both = n + 1, both + (got[i] == got[j])
    assert n > 500 and both >= 0.97 * n
    # nothing else is joined: what is in one group is connected by links
    parent = {i: i for i in bags}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in bags:
        for j in bags:
            if i < j and i // 1000 == j // 1000 and (bags[i] & bags[j]).total() >= (neardup.SIMILARITY - 0.01) * (bags[i] | bags[j]).total():
                parent[root(j)] = root(i)
    assert all(root(i) == root(got[i]) for i in bags) and all(got[i] == i for i, _ in rows[480:])


def twins():
    """80 pairs of similar texts, (2 g, 2 g + 1), all of one origin and otherwise not similar, among so many others that no shingle is common."""
    rng = random.Random(21)
    base = [f"b{k}" for k in range(800)]
    rows = []
    for g in range(80):
        places = rng.sample(range(5, 795, 6), 20)
        for side in (0, 1):
            edited = list(base)
            for k, p in enumerate(places):
                if k < 4 or k % 2 == side:
                    edited[p] = f"e{g}x{p}x{side if k >= 4 else 2}"
            rows.append((2 * g + side, " ".join(edited)))
    bags = [set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    links = [(i, j) for i in range(160) for j in range(i) if len(bags[i] & bags[j]) >= neardup.SIMILARITY * len(bags[i] | bags[j])]
    assert links == [(2 * g + 1, 2 * g) for g in range(80)]
    return rows + [(1000 + i, f"other text {i}") for i in range(8200)]


def test_links_in_large_buckets_are_found(spark, monkeypatch):
    """Twins share buckets of over EVERY texts with others that they are not similar to."""
    monkeypatch.setattr(neardup, "BLOCK", 16, raising=False)  # buckets take several blocks
    got = {r.doc_id: r.class_id for r in neardup.grouped(spark.createDataFrame(twins(), "doc_id long, text string")).collect()}
    assert sum(got[2 * g] == got[2 * g + 1] for g in range(80)) >= 79 and all(got[i] in (i, i - i % 2) for i in range(160))


def test_pipeline_keeps_one_of_similar_texts_in_large_buckets(spark):
    import corpus_pipeline

    rows = twins()
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()}
    assert kept >= {2 * g for g in range(80)} | {i for i, _ in rows[160:]} and len(kept) <= len(rows) - 79


def test_blocks_join_all_that_similar_texts_join():
    rng = random.Random(22)
    for t in range(60):
        made = [" ".join(f"w{rng.randrange(3) if rng.random() < 0.1 else k}" for k in range(rng.randrange(5, 60))) for _ in range(rng.randrange(2, 30))]
        h, n, first = neardup._bags(*_buffers(pa.array(made)))
        side = np.array([rng.randrange(2) if t % 2 else 0 for _ in made])
        side[0] = 0
        label = np.array([rng.randrange(len(made)) for _ in made])
        bag = lambda i: (h[first[i] : first[i + 1]], n[first[i] : first[i + 1]].astype(float))  # noqa: B023, E731
        similar = [(i, j) for i in range(len(made)) for j in range(i) if (side[i] != side[j] or not side.any()) and neardup.jaccard(bag(i), bag(j)) >= neardup.SIMILARITY - 1e-12]

        def groups(pairs):
            name = label.copy()  # noqa: B023
            for i, j in pairs:
                name[name == name[i]] = name[j]
            return {tuple(np.flatnonzero(name == x)) for x in name}

        got = neardup.linked(h, n.astype(float), first, label, side)
        assert groups(got) == groups(similar) and all((max(p), min(p)) in similar for p in got) and len(got) < len(made)


def test_weights_are_those_of_counted_documents(spark):
    rng = random.Random(4)
    rows = [(f"{'the same five words here ' * (i % 3 == 0)}{words(rng, 20, 10**6)}",) for i in range(900)]
    found = neardup.weights(spark.createDataFrame(rows, "text string"))
    h, n, _ = neardup._bags(*_buffers(pa.array(["the same five words here", "never seen before this one"])))
    got = found.of(h, np.ones(len(h)))
    want = 1 + math.log(3) / math.log(1 / neardup.FLOOR)
    assert min(abs(x - want) for x in got) < 0.01 and 1.9 < max(got) <= 2.001


def removed(rows):
    seen, out = set(), {}
    for i, t in sorted(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for at in range(len(raw) - 99):
            s = raw[at : at + 100]
            if s in seen:
                gone[at : at + 100] = True
            seen.add(s)
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(raw) else 0
        out[i] = (len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


def test_refined_pointers_are_those_of_sorted_strings():
    rng = random.Random(13)
    for t in range(400):
        raw = bytes(rng.choice(b"ab\0"[: t % 3 + 1]) for _ in range(rng.randrange(300))) + bytes(rng.randrange(256) for _ in range(rng.randrange(1, 120))) * rng.randrange(1, 5)
        depth = rng.choice([8, 12, 33, 100])
        got = suffixes.refined(np.frombuffer(raw, np.uint8), depth)
        by = {}
        for i in range(len(raw) - depth + 1):
            by.setdefault(raw[i : i + depth], set()).add(int(got[i]))
        heads = [min(v) for _, v in sorted(by.items())]
        assert all(len(v) == 1 for v in by.values()) and heads == sorted(set(heads))
    assert len(suffixes.refined(np.zeros(0, np.uint8))) == 0


def test_suffix_workers_hold_little():
    rng = random.Random(14)
    given = [pa.RecordBatch.from_arrays([pa.array(range(k * 1000, k * 1000 + 1000)), pa.array([words(rng, 300, 10**6) for _ in range(1000)])], ["doc", "text"]) for k in range(6)]
    edges = [pa.RecordBatch.from_arrays([*b.columns, pa.array([[int(suffixes._pack(np.int64(0), np.int64(1500), 0))]] * 1000)], ["doc", "text", "ats"]) for b in given]
    for step, batches in ((suffixes._dealt, given), (suffixes._sorted_edges, edges)):
        tracemalloc.start()
        assert sum(b.num_rows for b in step(iter(batches))) > 0
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 80e6, (step, peak)


def test_suffixes_write_few_files_and_executors_shrink(spark, monkeypatch):
    """Files start processes, and heaps keep their size: both are kept low, as an executor's memory is bounded."""
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    cut, collectors = suffixes.cut, spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    files, collected = [], []

    def counted(df, label):
        out, path = cut(df, label)
        files.append(len(out.inputFiles()))
        return out, path

    monkeypatch.setattr(suffixes, "cut", counted)
    monkeypatch.setattr(suffixes, "release", lambda spark: collected.append(sum(c.getCollectionCount() for c in collectors())))
    try:
        rows = [(i, "the same passage " * 20 + t) for i, t in enumerate("abcdef" * 20)]
        suffixes.repeats(spark.createDataFrame(rows, "doc_id long, text string")).count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(files) == 2 and max(files) <= 16
    n = spark.sparkContext.defaultParallelism
    assert sum(c.getCollectionCount() for c in collectors()) >= collected[-1] + n


def test_suffixes(spark, empty):
    rows = list(enumerate(texts()))
    rng = random.Random(12)
    long = words(rng, 60_000)
    rows += [(20, long), (21, "x " + long[5000:250_000] + words(rng, 30)), (22, "ab" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.spans(docs).collect()}
    assert got == removed(rows)
    named = spark.createDataFrame([(f"{i:03}", t) for i, t in rows], "doc_id string, text string")
    assert {int(r.doc_id): (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.spans(named).collect()} == got
    assert suffixes.spans(empty).count() == 0 and suffixes.deduplicated(empty).columns == empty.columns


def test_containment(spark, docs, empty):
    passage = " ".join(texts()[8].split()[-40:])
    items = spark.createDataFrame([(1, passage), (2, words(random.Random(1), 30, 10**6)), (None, None)], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contained(docs, items).collect()) == [(7, 1), (8, 1)]
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()}.isdisjoint({7, 8})
    assert decontaminate.contained(empty, items).count() == 0


def test_rows_are_told_apart_by_more_than_their_id(spark):
    rng = random.Random(8)
    held, shared = words(rng, 30, 10**6), words(rng, 60, 10**6)
    group = words(rng, 200, 10**6)
    own = [words(rng, 40, 10**6) for _ in range(3)]
    rows = [(None, held), (None, own[0] + " " + shared), (None, own[1] + " " + shared), (7, own[2]), (7, held), (None, group), (None, group + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    items = spark.createDataFrame([(1, held)], "item_id long, text string")
    assert sorted(r.text for r in decontaminate.clean(docs, items).collect()) == sorted(t for _, t in rows if t != held)
    kept = [r.text for r in neardup.representatives(docs.where("doc_id IS NULL")).collect()]
    assert len(kept) == 4 and sum(t.startswith(group) for t in kept) == 1
    two = spark.createDataFrame([rows[1], rows[2], rows[3]], "doc_id long, text string")
    got = [r.text for r in suffixes.deduplicated(two).collect()]
    assert own[2] in got and sum(shared in t for t in got) == 1 and all(sum(t.startswith(o) for t in got) == 1 for o in own)


CLASHING = ["_doc", "_ats", "_held", "_tid", "_first", "_text", "_words", "_lines", "_row", "given", "row", "tid", "id", "ats", "digest", "root", "one", "ids", "words", "rank", "bucket"]


def test_columns_of_clashing_names_stay(spark):
    rng = random.Random(9)
    base = words(rng, 120, 10**6)
    held = words(rng, 30, 10**6)
    prose = "The old house by the river is one that people of the town have known for a long time and like to visit in the summer."
    rows = [(i, t, *[f"{c}{i}" for c in CLASHING]) for i, t in enumerate([base, base + " end", held, prose, None, "", prose])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))
    items = spark.createDataFrame([(1, held)], "item_id long, text string")
    for out, kept in ((neardup.representatives(docs), {0, 2, 3, 4}), (suffixes.deduplicated(docs), set(range(7))), (decontaminate.clean(docs, items), {0, 1, 3, 4, 5, 6}), (quality.accepted(docs), {3, 6})):
        got = out.collect()
        assert out.columns == docs.columns and {r.doc_id for r in got} == kept
        assert all(r[c] == f"{c}{r.doc_id}" for r in got for c in CLASHING)
    rated = quality.rated(docs).collect()
    assert all(r["_words"] == f"_words{r.doc_id}" and r.kept == (r.doc_id in (3, 6)) for r in rated)
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    assert {r.doc_id for r in neardup.representatives(named).collect()} == {"d0", "d2", "d3", "d4"}


def test_representatives_do_not_depend_on_partitioning(spark):
    rows = [(5, "the same text", f"x{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other string")
    assert len({tuple(r) for n in (1, 3, 11) for r in neardup.representatives(df.repartition(n, "other")).collect()}) == 1


def naive_sequences(lengths, capacity):
    """How many sequences best fit decreasing opens, piece by piece."""
    free = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in free if r >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(capacity - n)
    return len(free)


def test_plans_are_best_fit_decreasing():
    rng = random.Random(6)
    for _ in range(60):
        capacity = rng.randrange(5, 60)
        lengths = [rng.randrange(1, capacity + 1) for _ in range(rng.randrange(1, 120))]
        entries = bestfit.plan(dict(Counter(lengths)), capacity)
        assert max(first + (n - 1) // each for n, first, each in ((entries_count(entries, k, lengths), e[2], e[3]) for k, e in enumerate(entries))) + 1 == naive_sequences(lengths, capacity)


def entries_count(entries, k, lengths):
    """The pieces of the k-th entry: up to the next one of its length, or all that are left."""
    length, rank = entries[k][:2]
    later = [e[1] for e in entries if e[0] == length and e[1] > rank]
    return (min(later) if later else lengths.count(length)) - rank


@pytest.mark.parametrize("bucket, run", [(500, 1000), (1, 2)])
def test_packing(docs, empty, monkeypatch, bucket, run):
    monkeypatch.setattr(bestfit, "BUCKET", bucket)
    monkeypatch.setattr(bestfit, "RUN", run)
    rows = bestfit.packed(docs).collect()
    assert len(set(r.sequence_id for r in rows)) == naive_sequences([r.length for r in rows], 1024)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in rows) == sum(len(tokens.encoded(tokens.default_path(), r.text)) for r in docs.collect())
    assert bestfit.packed(empty).count() == 0


def test_ids_are_those_of_tokenizers(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    given = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    for t in [*given, *texts(), "a<|endoftext|>b", "  tab\t\r\n\n x y  ", "don't 123456 ***"]:
        assert list(tokens.encoded(tokens.default_path(), t))[:-1] == whole.encode(t or "", add_special_tokens=False).ids


def test_matrices_round_trip(docs, empty):
    back = {}
    for r in matrices.matrices(docs.where("doc_id IS NOT NULL").distinct()).collect():
        ids = np.frombuffer(r.ids, "<u2")
        for k, (d, piece) in enumerate(zip(r.doc_ids, r.pieces, strict=True)):
            back.setdefault(d, {})[piece] = ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()
    for i, t in enumerate(texts()):
        assert sum((back[i][k] for k in sorted(back[i])), []) == list(tokens.encoded(tokens.default_path(), t))
    assert matrices.matrices(empty).count() == 0


def test_salvage():
    made = [warc.member(warc.record("response", i, None, f"<p>{i}</p>".encode() * 50, 400, "0" * 40)) for i in range(5)]
    whole = b"".join(made)
    assert [f.length for f in warc.salvaged(whole)] == [len(m) for m in made]
    broken = bytearray(whole)
    broken[len(made[0]) + 40] ^= 0xFF
    found = list(warc.salvaged(bytes(broken)))
    assert [f.headers.get("warc-record-id", "gap") for f in found] == ["<urn:page:0>", "gap", "<urn:page:2>", "<urn:page:3>", "<urn:page:4>"]
    assert found[1].offset == len(made[0]) and sum(f.length for f in found) == len(whole)
    assert list(warc.salvaged(b"")) == [] and [f.error is not None for f in warc.salvaged(b"junk")] == [True]


def test_warc_round_trip(spark, tmp_path):
    page = "<p>" + "x" * 2000
    rows = [(1, "http://a/", page), (7, None, page), (3, "http://b/ c", "short"), (4, "u", "short"), (5, "u", None), (None, "u", page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/w", "page_id", "html", "url")
    got = {r.record_id: (r.warc_type, r.refers_to) for r in warc.read(spark, f"{tmp_path}/w").where("error IS NULL").collect()}
    assert got["<urn:page:7>"] == ("response", None) and got["<urn:page:1>"] == got["<urn:page:None>"] == ("revisit", "<urn:page:7>")
    assert len(got) == 6 and got["<urn:page:3>"][0] == got["<urn:page:4>"][0] == got["<urn:page:5>"][0] == "response"


def test_extraction(spark):
    page = "<html><title>t</title><body><nav><a>m</a></nav><div class='cookie-notice'>c</div><article><h1>T {0}</h1><p>a{0} &amp;<br>b<p>c<div class=comments>no</div></article><footer>f</footer>"
    rows = [(i, f"http://h/{i}", page.format(i)) for i in range(6)] + [(90, None, None), (91, "odd", "")]
    got = {r.page_id: r.text for r in extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "T 3 a3 & b c" and got[90] == got[91] == ""


def test_wrappers_decide_without_names():
    plain = [f"<div>Slogan</div><div><a>Home</a> <a>News</a></div><div><h2>T{i}</h2><p>text {'x' * i} and more of it</p><p>more {i}</p></div><div>Imprint {i}</div>" for i in range(1, 10)]
    template = extract.inferred(plain)
    assert [extract.main_text(p, template) for p in plain] == [f"T{i} text {'x' * i} and more of it more {i}" for i in range(1, 10)]
    assert extract.expression(template.w) == "(<div>#</>)+<div><h2>#</>(<p>#</>)+</><div>#</>"


def test_names_and_elements_of_all_pages_can_go(spark):
    """On the given pages, the wrapper alone finds what it finds with their elements' names."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    bare = lambda h: re.sub(r' (class|id)="[^"]*"', "", re.sub(r"<(/?)(article|nav|footer)\b", r"<\1div", h or ""))
    rows = [(r.page_id, r.url, bare(r.html)) for r in pages.collect()]
    stripped = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {r.page_id: (r.text, r.by_wrapper) for r in extract.extracted(pages).collect()}
    assert {r.page_id: (r.text, r.by_wrapper) for r in extract.extracted(stripped).collect()} == want
    assert all(own for _, own in want.values()) and len(want) == len(rows)


def test_wrappers_fold_repeat_and_leave_out():
    pages = ["<ul><li>a<li>b</ul><h3>x</h3><p>1</p><h3>y</h3><p>2</p><p>3</p>", "<h3>z</h3><p>4</p>", "<ul><li>c</ul><h3>w</h3><p>5</p><hr><i>6</i>"]
    template = extract.inferred(pages)
    assert extract.expression(template.w) == "(<ul>(<li>#</>)+</>)?(<h3>#</>(<p>#</>)+)+#?"
    # a text on most pages is template wherever it repeats; scripts end in any case, whatever letters change length in lower case
    pages = [f"{'İ' * 40}<script>var a = 1</SCRIPT><h1>T{i}</h1><p>one {i} two three</p><p>Share this</p><p>four {i}</p>" for i in range(12)]
    template = extract.inferred(pages)
    assert extract.main_text(pages[3], template) == "T3 one 3 two three four 3"


def test_extraction_is_the_same_for_any_partitioning(spark, monkeypatch):
    page = "<div>{1}</div><div><h1>T{0}</h1><p>a {0} {2}</p><p>b</p></div><div class=comments>c{0}</div>"
    rows = [(i, "http://h/" if i % 3 else "http://k:8/", page.format(i, "x" * (i % 4), "y" * i), 1, 2) for i in range(60)] * 2
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host int, wrapper int")
    want = sorted(tuple(r) for r in extract.extracted(pages).collect())
    assert len(want) == 120 and dict((r[0], r[2]) for r in want)[5] == "T5 a 5 yyyyy"  # b is template
    assert sorted(tuple(r) for r in extract.extracted(pages.repartition(7, "html")).collect()) == want
    monkeypatch.setattr(extract, "SPLIT", 5)  # hosts are split, and wrappers go before their pages
    monkeypatch.setattr(extract, "FAN", 3)
    monkeypatch.setattr(extract, "MAX_BROADCAST_BYTES", 0)
    assert sorted(tuple(r) for r in extract.extracted(pages).collect()) == want
    assert extract.extracted(pages.limit(0)).count() == 0


def test_copies_of_a_page_are_one_page(spark):
    page = "<div><h2>Title</h2><section>main text</section>" + "<p>again</p>" * 6 + "</div>"
    rows = [(i, "http://h/", page) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    assert {r.text for r in extract.extracted(pages).collect()} == {"Title main text" + " again" * 6}


def test_katz_is_normalised_and_exact(docs, empty):
    rows = [(r.doc_id, r.text) for r in docs.where("doc_id IS NOT NULL").distinct().collect()]
    held = {2, 4, 8}
    got = {r.doc_id: r for r in katz.scored(docs.where("doc_id IS NOT NULL").distinct(), F.col("doc_id").isin(*held)).collect()}
    split = {i: [*(t or "").lower().split(), None] for i, t in rows}
    one, two, context = Counter(), Counter(), Counter()
    for i, ws in split.items():
        if i not in held:
            one.update(ws)
            for u, w in zip([0, *ws], ws, strict=False):
                two[u, w] += 1
                context[u] += 1

    def good_turing(c):
        """By count: the discount, as in Katz 1987 with k = 5, or 1 - 1 / (2 r) where that is none."""
        n = Counter(c.values())
        least = 6 * n[6] / n[1] if n[1] else 1
        d = {r: ((r + 1) * n[r + 1] / (r * n[r]) - least) / (1 - least) if n[r] and least < 1 else 0 for r in range(1, 6)}
        return {r: x if 0 < x < 1 else 1 - 1 / (2 * r) for r, x in d.items()} | {6: 1}

    d1, d = good_turing(one), good_turing(two)
    total = sum(one.values())
    left = total - sum(d1[min(c, 6)] * c for c in one.values())
    assert left > 0
    p1 = lambda w: d1[min(one[w], 6)] * one[w] / total if one[w] else left / total
    assert math.isclose(sum(map(p1, one)) + p1("?"), 1)

    def p(u, w):
        if not context[u]:
            return p1(w)
        mine = {x: c for (y, x), c in two.items() if y == u}
        freed = context[u] - sum(d[min(c, 6)] * c for c in mine.values())
        over = context[u] if freed > 1e-12 else context[u] + 1
        if w in mine:
            return d[min(mine[w], 6)] * mine[w] / over
        return (1 - sum(d[min(c, 6)] * c for c in mine.values()) / over) / (1 - sum(map(p1, mine))) * p1(w)

    assert math.isclose(sum(p("w3", w) for w in [*one, "?"]), 1)
    for i, ws in split.items():
        assert got[i].n_tokens == len(ws) and got[i].n_known == sum(w in one for w in ws)
        assert math.isclose(got[i].score, sum(math.log10(p(u, w)) for u, w in zip([0, *ws], ws, strict=False)), rel_tol=1e-9)
    assert katz.scored(empty, F.lit(False)).count() == 0


def test_toxicity_models_are_kneser_ney():
    """The evidence against both classes' models written out with dictionaries."""
    rng = random.Random(17)
    made = [" ".join(f"w{min(int(rng.expovariate(0.2 if c else 0.3)), 30)}" for _ in range(rng.randrange(1, 30))) for c in (0, 1) for _ in range(60)]
    pairs = [Counter(), Counter()]
    for k, t in enumerate(made):
        ws = t.split()
        pairs[k >= 60].update(zip([None, *ws], ws, strict=False))

    def less(counts):
        n = Counter(counts)
        if not all(n[i] for i in (1, 2, 3, 4)):
            return lambda c: 0.5 if c else 0
        y = n[1] / (n[1] + 2 * n[2])
        d = [0, *(min(max(i - (i + 1) * y * n[i + 1] / n[i], 0), i - 0.05) for i in (1, 2, 3))]
        return lambda c: d[min(c, 3)]

    every = set(pairs[0]) | set(pairs[1])
    vocabulary = {w for _, w in every}
    shared = Counter(w for _, w in every)
    d_shared = less(shared.values())
    freed_shared = sum(map(d_shared, shared.values())) / len(every)
    base = lambda w: (shared[w] - d_shared(shared[w])) / len(every) + freed_shared / (len(vocabulary) + 1)
    assert math.isclose(sum(map(base, vocabulary)) + base("?"), 1)

    def model(c):
        after = Counter(w for _, w in c)
        context = Counter()
        for (u, _), n in c.items():
            context[u] += n
        d1 = less([after[w] for w in vocabulary if after[w]])
        d2 = less(c.values())

        def p1(w):
            return (after[w] - d1(after[w])) / len(c) + sum(d1(n) for n in after.values()) / len(c) * base(w)

        def p(u, w):
            if not context[u]:
                return p1(w)
            freed = sum(d2(n) for (x, _), n in c.items() if x == u)
            return (c[u, w] - d2(c[u, w])) / context[u] + freed / context[u] * p1(w)

        return p1, p

    (low0, p0), (low1, p1) = map(model, pairs)
    assert math.isclose(sum(p1("w1", w) for w in [*vocabulary, "?"]), 1)
    u, w, first = toxicity._bigrams(pa.array(made))
    keys, at, of = np.unique(toxicity._key(u, w), return_index=True, return_inverse=True)
    toxic = np.repeat(np.arange(len(made)) >= 60, np.diff(first))
    counts = np.stack([np.bincount(of[toxic == c], minlength=len(at)) for c in (False, True)], axis=1)
    found = toxicity.Models.of(u[at], w[at], counts)
    asked = [*made, "w1 never w2 w2", "other words"]
    u, w, first = toxicity._bigrams(pa.array(asked))
    got, got_low = found.evidence(u, w)
    want = [(math.log(p1(a, b) / p0(a, b)), math.log(low1(b) / low0(b))) for t in asked for a, b in zip([None, *t.split()], t.split(), strict=False)]
    assert np.allclose(got, [x for x, _ in want], atol=1e-4) and np.allclose(got_low, [x for _, x in want], atol=1e-4)


def test_toxicity(spark, empty):
    rng = random.Random(2)
    rows = [(i, words(rng, 40) + (" vile" if i % 3 == 0 else "") + " " + words(rng, 40), int(i % 3 == 0)) for i in range(300)]
    both = spark.createDataFrame([*rows, (900, None, None)], "doc_id long, text string, toxic int")
    found = toxicity.fitted(both, both, F.col("doc_id") < 200)
    got = {r.doc_id: r.score for r in toxicity.scored(both, found).collect()}
    assert all((got[i] >= 0.5) == bool(y) for i, _, y in rows if i >= 200) and 0 <= got[900] <= 1
    nothing = toxicity.fitted(empty, both)
    assert toxicity.scored(empty, nothing).count() == 0 and toxicity._chance(np.zeros((1, 1)), np.zeros(2))[0] == 0.5
    assert toxicity.Models.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros((0, 2))).features(pa.array([""])).shape == (1, 10)


def test_pipeline_keeps_columns(spark, docs, empty, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(1, words(random.Random(1), 30, 10**6))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    prose = "The old house by the river is one that people of the town have known for a long time and like to visit in the summer, as it was built with care."
    more = spark.createDataFrame([(70, prose, None, None, None, None, None)], SCHEMA)
    for df, least in ((docs.unionByName(more), 1), (empty, 0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, str(tmp_path))
            assert df.columns == docs.columns
        assert df.count() >= least
