"""Suffix-array deduplication by bucket-pointer refinement (Schuermann and Stoye 2007), over all texts together.

Every byte is removed that a 100-byte string covers which also starts earlier: in a document with a smaller id,
or earlier in the same one. Strings are judged on the texts as given, and never cross documents.

Refining every suffix of a corpus would move every byte many times. Equal 100-byte strings have equal anchors,
though: the position of the q-gram (q = 32) with the least hash in the string, leftmost on ties. So only anchors,
about one in 35 positions, are dealt out; their q-grams are the initial buckets of the refinement.

1. A bucket of one anchor is final: its strings are unique. Anchors whose whole neighbourhood (all the strings
   they anchor) equals an earlier one's are repeats altogether.
2. What remains is where repeated passages begin and end. There all suffixes are sorted to depth 100 or more by
   bucket-pointer refinement: buckets by 8-byte prefixes, refined by sorting on the bucket pointers 8, 16, 32 and
   64 positions on, and only buckets of several suffixes. A pass takes the buckets in portions and sets the pointers
   after each, so that the portions after it sort by pointers this pass has refined already, which may stand for
   many more bytes than the offset. Neighbours in that order whose 100 bytes are equal then share a pointer.
   Equal pointers are equal strings within a block; across blocks each block's first one meets by its hash.

A block sends a string or neighbourhood once, so no key has more rows than there are blocks, however many
documents share a passage. A q-gram with several neighbourhoods in one block is spread by neighbourhood.

Defined results: a null text has no bytes; texts of fewer than 100 bytes stay whole; a null doc_id comes before all
others; rows that repeat both doc_id and text are taken as one document, so that exact repeats of a row don't remove each other;
different texts with one doc_id (null included) are documents of their own, in the order of their digests;
ids of any orderable type will do, and others than integers are numbered in their order first; very long texts are
read whole; an empty table gives an empty result; other columns, whatever their names, are not read, and deduplicated()
returns them as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType, StructField, StructType

from foliant.llm import _bytes as B
from foliant.llm._cluster import NULL_ID, column, cut, drop, fewer, give_back, release, small_batches

LENGTH = 100
GRAM = 32
_WIDE = LENGTH - GRAM + 1
#: The portions of a refining pass.
PORTIONS = 8
#: Bytes of text that a task works on at once, and the anchors of a block, about: a worker holds some 70 MB of arrays.
_SLICE = 500_000
_HELD = 150_000
_ROW = "k long, s long, doc long, at long"
_ORDINARY, _SPREAD, _SUMMARY, _DONE = range(4)
_EMPTY = np.zeros(0, np.int64)


def refined(data: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Bucket pointers of all suffixes of data: the number of suffixes before the first one with the same depth bytes.

    Suffixes of fewer than depth bytes stand in the order too, but their pointers say nothing. depth is 8 at least.
    """
    n = len(data)
    x = np.zeros(n + depth + 8, B.U)
    x[:n] = data
    first = np.zeros(n + depth, B.U)
    for j in range(8):
        first |= x[j : j + n + depth] << B.U(56 - 8 * j)
    order = np.argsort(first[:n])
    pointer = np.full(n + 2 * depth, -1, np.int64)  # past its end, data is less than any bucket
    active = _named(pointer, order, first[order], np.zeros(n, np.int64))
    known = 8
    while known < depth and len(active):
        left = []
        for run in _portions(pointer, active):
            later = pointer[run + known] + 1  # stands for known bytes at least, and more where a portion before refined it
            keys = (pointer[run].astype(B.U) << B.U(32)) | later.astype(B.U)
            order = np.argsort(keys)
            left.append(_named(pointer, run[order], keys[order], pointer[run[order]]))
        active = np.concatenate(left)
        known *= 2
    order = np.argsort(pointer[:n])
    a, b = order[:-1], order[1:]
    same = pointer[a] == pointer[b]
    maybe = np.flatnonzero(~same)
    for at in (*range(0, depth - 8, 8), depth - 8):
        maybe = maybe[first[a[maybe] + at] == first[b[maybe] + at]]
    same[maybe] = True
    heads = np.where(np.concatenate([[False], same])[:n], 0, np.arange(n))
    pointer[order] = np.maximum.accumulate(heads)
    return pointer[:n]


def _portions(pointer: np.ndarray, active: np.ndarray) -> list[np.ndarray]:
    """active, cut between buckets into about PORTIONS."""
    opens = np.append(np.flatnonzero(_changes(pointer[active])), len(active))
    ends = opens[np.searchsorted(opens, np.arange(1, PORTIONS) * len(active) // PORTIONS)]
    return [run for run in np.split(active, ends) if len(run)]


def _named(pointer: np.ndarray, order: np.ndarray, keys: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Set the pointers of suffixes sorted by key within their buckets; returns those in buckets of several."""
    n = len(order)
    if not n:
        return order
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    opens = np.ones(n, bool)
    opens[1:] = bucket[1:] != bucket[:-1]
    at = np.arange(n)
    run = np.maximum.accumulate(np.where(new, at, 0))
    base = np.maximum.accumulate(np.where(opens, at, 0))
    pointer[order] = bucket + run - base
    single = new & np.append(new[1:], True)
    return order[~single]


def _anchors(offsets: np.ndarray, ranges: B.Ranges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, lo, hi, anchor) of runs of 100-byte windows, by their first and last starts in the byte array."""
    m = B.mix(ranges.grams(GRAM))
    if len(m) < _WIDE:
        return _EMPTY, _EMPTY, _EMPTY, _EMPTY
    m = (m & B.U(0xFFFFFFFF00000000)) | np.arange(len(m), dtype=B.U)
    wide = 1
    while wide * 2 <= _WIDE:
        m = np.minimum(m[:-wide], m[wide:])
        wide *= 2
    m = np.minimum(m[: len(m) - (_WIDE - wide)], m[_WIDE - wide :])
    anchor = (m & B.U(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(offsets)
    ok = np.flatnonzero(sizes >= LENGTH)
    reps = sizes[ok] - LENGTH + 1
    before = np.cumsum(reps) - reps
    starts = np.repeat(offsets[:-1][ok] - before, reps) + np.arange(int(reps.sum()))
    a = anchor[starts]
    if not len(a):
        return _EMPTY, _EMPTY, _EMPTY, _EMPTY
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    last = np.append(new[1:], len(a)) - 1
    text = np.searchsorted(offsets, starts[new], "right") - 1
    return text, starts[new], starts[last], a[new]


def _pack(lo: np.ndarray, more: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (lo << 24) | (more << 2) | kind


def _unpack(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return at >> 24, (at >> 2) & 0x3FFFFF, at & 3


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before in any column."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


def _runs(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


def _batch(*columns: np.ndarray, names: tuple[str, ...] = ("k", "s", "doc", "at")) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64) if c.dtype != np.uint64 else c.view(np.int64)) for c in columns], list(names))


def _local(q: np.ndarray, s: np.ndarray, doc: np.ndarray, lo: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    """Of a block's anchors: each neighbourhood's first one to compare, its repeats as done."""
    order = np.lexsort((lo, doc, s, q))
    q, s, doc, lo, more = (x[order] for x in (q, s, doc, lo, more))
    group = _runs(new := _changes(q, s))
    heads = np.flatnonzero(new)
    again = (doc != doc[heads][group]) | (lo != lo[heads][group])
    several = np.bincount(_runs(_changes(q[heads])))[_runs(_changes(q[heads]))] > 1
    f = heads[new[heads]]
    kind = np.where(several, _SPREAD, _ORDINARY)
    first_of_q = several & _changes(q[f])
    k = np.concatenate([np.where(several, B.mix(s[f] ^ q[f]), q[f]), q[f][first_of_q], B.mix(doc[again].view(B.U))])
    z = lambda c: np.concatenate([c[f], c[f][first_of_q], c[again]])
    kinds = np.concatenate([kind, np.full(int(first_of_q.sum()), _SUMMARY), np.full(int(again.sum()), _DONE)])
    return _batch(k, z(s), z(doc), _pack(z(lo), z(more), kinds))


def _ids(b: pa.RecordBatch) -> np.ndarray:
    return b.column("doc").to_numpy().astype(np.int64)


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of all texts, block by block."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0
    for b in B.gathered(batches, "text", _SLICE):
        offsets, data = B.buffers(b.column("text"))
        ranges = B.Ranges(data)
        text, lo, hi, anchor = _anchors(offsets, ranges)
        s = B.mix(ranges.of(lo, hi + LENGTH) + (anchor - lo).astype(B.U))
        held.append((ranges.of(anchor, anchor + GRAM), s, _ids(b)[text], lo - offsets[text], hi - lo))
        count += len(lo)
        if count >= _HELD:
            yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held, count = [], 0
    if count:
        yield _local(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _grouped(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[np.ndarray, ...]]:
    """Columns of sorted rows, cut between different values of the first column."""
    tail: tuple[np.ndarray, ...] | None = None
    for b in batches:
        now = tuple(b.column(n).to_numpy() for n in names)
        if tail is not None:
            now = tuple(np.concatenate(x) for x in zip(tail, now, strict=True))
        if not len(now[0]):
            continue
        end = int(np.searchsorted(now[0], now[0][-1]))
        if end:
            yield tuple(x[:end] for x in now)
        tail = tuple(x[end:] for x in now)
    if tail is not None:
        yield tail


def _classified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of dealt anchors: repeats (kind 1) and those to be sorted (kind 0); unique ones go."""
    for k, s, doc, at in _grouped(batches, "k", "s", "doc", "at"):
        lo, more, kind = _unpack(at)
        done, summary = kind == _DONE, kind == _SUMMARY
        of_k = _runs(_changes(k))
        summed = np.bincount(of_k[summary], minlength=of_k[-1] + 1) > 0
        rows = np.flatnonzero(~done & ~summary)
        group = _changes(k[rows], s[rows])
        heads = rows[group][_runs(group)] if len(rows) else rows
        again = (doc[rows] != doc[heads]) | (lo[rows] != lo[heads])
        kinds = np.bincount(of_k[rows[group]], minlength=of_k[-1] + 1)
        check = ~again & ((kind[rows] == _SPREAD) | summed[of_k[rows]] | (kinds[of_k[rows]] > 1))
        out = np.concatenate([np.flatnonzero(done), rows[again], rows[check]])
        as_kind = np.concatenate([np.ones(int(done.sum()) + int(again.sum()), np.int64), np.zeros(int(check.sum()), np.int64)])
        yield _batch(doc[out], _pack(lo[out], more[out], as_kind), names=("doc", "at"))


def _sorted_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, text, ats): strings of the given neighbourhoods, each distinct one of a block once, and its repeats as runs."""
    for b in B.gathered(batches, "text", _SLICE):
        offsets, data = B.buffers(b.column("text"))
        ats = b.column("ats")
        lists = ats.flatten().to_numpy()
        text = np.repeat(np.arange(b.num_rows), np.diff(ats.offsets.to_numpy()))
        lo, more, _ = _unpack(lists)
        order = np.lexsort((lo, text))
        text, lo, more = text[order], lo[order] + offsets[text[order]], more[order]
        piece = 0
        width = more + LENGTH
        ends = np.cumsum(width)
        while piece < len(lo):
            upto = max(piece + 1, int(np.searchsorted(ends, (ends[piece - 1] if piece else 0) + _SLICE, "right")))
            yield _edges(data, offsets, _ids(b), text[piece:upto], lo[piece:upto], more[piece:upto])
            piece = upto


def _edges(data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, text: np.ndarray, lo: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
    width = more + LENGTH
    base = np.cumsum(width) - width
    spans = np.repeat(lo - base, width) + np.arange(int(width.sum()))
    x = data[spans]
    pointer = refined(x)
    n = more + 1
    w = np.repeat(base - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))  # starts of whole strings in x
    owner = np.repeat(text, n)
    doc, pos = ids[owner], spans[w] - offsets[owner]
    name = pointer[w]
    order = np.lexsort((pos, doc, name))
    heads = np.flatnonzero(_changes(name[order]))
    group = _runs(_changes(name[order]))
    head = order[heads][group]
    again = np.zeros(len(w), bool)
    again[order] = (doc[order] != doc[head]) | (pos[order] != pos[head])
    f = order[heads]
    ranges = B.Ranges(x)
    at = w[f]
    half = LENGTH // 2
    h1 = ranges.of(at, at + LENGTH)
    h2 = B.mix(ranges.of(at, at + half)) ^ (ranges.of(at + half, at + LENGTH) * B.U(3))
    r = np.flatnonzero(again)
    opens = _changes(doc[r], pos[r] - np.arange(len(r))) if len(r) else np.zeros(0, bool)
    starts = np.flatnonzero(opens)
    run = np.diff(np.append(starts, len(r))) - 1
    done_doc, done_pos = doc[r][starts], pos[r][starts]
    return _batch(
        np.concatenate([h1, B.mix(done_doc.view(B.U))]), np.concatenate([h2, np.zeros(len(starts), B.U)]), np.concatenate([doc[f], done_doc]),
        np.concatenate([_pack(pos[f], np.zeros(len(f), np.int64), _ORDINARY), _pack(done_pos, run, _DONE)]),
    )


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the blocks' strings: those that start earlier elsewhere, and the runs found within blocks."""
    for k, s, doc, at in _grouped(batches, "k", "s", "doc", "at"):
        pos, more, kind = _unpack(at)
        done = np.flatnonzero(kind == _DONE)
        rows = np.flatnonzero(kind != _DONE)
        group = _changes(k[rows], s[rows])
        heads = rows[group][_runs(group)] if len(rows) else rows
        again = rows[(doc[rows] != doc[heads]) | (pos[rows] != pos[heads])]
        out = np.concatenate([done, again])
        yield _batch(doc[out], _pack(pos[out], more[out], 1), names=("doc", "at"))


def _texts(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(F.coalesce(column(docs, doc_id), F.lit(NULL_ID)).alias("doc"), F.coalesce(column(docs, text), F.lit("")).alias("text"))


def repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc, ats): for each document with repeats, its packed runs of repeated strings; null ids are NULL_ID."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = _texts(docs, text, doc_id)
    order = ("k", "s", "doc", "at")
    anchors = texts.mapInArrow(_dealt, _ROW).repartition("k").sortWithinPartitions(*order)
    marked, _ = cut(fewer(anchors.mapInArrow(_classified, "doc long, at long")), "anchors")
    release(spark)
    give_back(spark)
    edges = marked.where("at & 3 = 0").groupBy("doc").agg(F.collect_list("at").alias("ats"))
    strings = texts.where(F.octet_length("text") >= LENGTH).join(edges, "doc").mapInArrow(_sorted_edges, _ROW).repartition("k").sortWithinPartitions(*order)
    found, _ = cut(fewer(strings.mapInArrow(_repeats, "doc long, at long")), "strings")
    release(spark)
    give_back(spark)
    return marked.where("at & 3 = 1").unionByName(found).groupBy("doc").agg(F.collect_list("at").alias("ats"))


def _covered(ats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes (starts, ends) that the runs of strings cover."""
    lo, more, _ = _unpack(np.sort(ats))
    hi = np.maximum.accumulate(lo + more + LENGTH)
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    at = np.flatnonzero(new)
    return lo[at], hi[np.append(at[1:], len(lo)) - 1]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[tuple[bytes, bytes, np.ndarray, np.ndarray]]]]:
    """For each row's text: its bytes, those that stay, and the removed runs' starts and ends."""
    for b in batches:
        found = []
        for t, ats in zip(b.column("text"), b.column("ats"), strict=True):
            raw = (t.as_py() or "").encode()
            if not ats.is_valid:
                found.append((raw, raw, _EMPTY, _EMPTY))
                continue
            starts, ends = _covered(ats.values.to_numpy())
            keep, at = [], 0
            for i, j in zip(starts.tolist(), ends.tolist(), strict=True):
                keep.append(raw[at:i])
                at = j
            found.append((raw, b"".join([*keep, raw[at:]]), starts, ends))
        yield b, found


def _told_apart(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """docs (of our own columns) with _doc, an integer for each pair of doc_id and text, in the order of doc_id."""
    digest = F.unhex(F.md5(F.coalesce(column(docs, text), F.lit(""))))
    whole = isinstance(docs.schema[doc_id].dataType, IntegralType)
    key = F.coalesce(column(docs, doc_id).cast("long"), F.lit(NULL_ID)) if whole else column(docs, doc_id)
    ids = docs.select(key.alias("_id"), digest.alias("_digest"))
    if whole and ids.groupBy("_id").agg((F.min("_digest") != F.max("_digest")).alias("several")).where("several").isEmpty():
        return docs.withColumn("_doc", key)
    # ranges of ids are numbered in order
    order = ids.distinct().repartitionByRange("_id", "_digest").sortWithinPartitions("_id", "_digest")
    order, _ = cut(order.withColumn("_doc", F.monotonically_increasing_id()), "row-ids")
    rows = docs.withColumns({"_id": key, "_digest": digest}).alias("r").join(order.alias("o"), F.col("r._id").eqNullSafe(F.col("o._id")) & (F.col("r._digest") == F.col("o._digest")))
    return cut(rows.select(*(column(docs, c) for c in docs.columns), "o._doc"), "rows")[0]


def spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the removed byte ranges starts and ends."""
    told = _told_apart(docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text")), "text", "doc_id")
    rows = told.withColumnRenamed("_doc", "doc").join(repeats(told, "text", "_doc"), "doc", "left").select("doc_id", "text", "ats")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, each in _each(batches):
            cols = [
                b.column("doc_id"), pa.array([len(r) for r, _, _, _ in each], pa.int64()), pa.array([len(r) - len(k) for r, k, _, _ in each], pa.int64()), pa.array([len(s) for _, _, s, _ in each], pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for _, k, _, _ in each], pa.string()), pa.array([s for _, _, s, _ in each], pa.list_(pa.int64())), pa.array([e for _, _, _, e in each], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digests, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>")


def deduplicated(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with the repeated bytes removed from their texts; parts of characters left over at a cut are dropped too."""
    given = F.struct(*(column(docs, c) for c in docs.columns if c != text), F.lit(0).alias("")).alias("given")
    told = _told_apart(docs.select(given, column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text")), "text", "doc_id")
    rows = told.withColumnRenamed("_doc", "doc").join(repeats(told, "text", "_doc"), "doc", "left")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, each in _each(batches):
            new = pa.array([None if not t.is_valid else k.decode(errors="ignore") for t, (_, k, _, _) in zip(b.column("text"), each, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("given"), new], ["given", "text"])

    packed = rows.select("given", "text", "ats")
    out = packed.mapInArrow(kept, StructType([StructField("given", packed.schema["given"].dataType), StructField("text", StringType())]))
    return out.select(*[(F.col("text").alias(c) if c == text else F.col("given")[c].alias(c)) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return spans(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
