"""Language-model scores by a Katz backoff bigram model over the whole training part of a corpus.

Counts up to `K` are discounted by Good-Turing; what that frees in a context goes to the words not seen in it, in
proportion to the discounted unigram model, whose freed mass is that of the unknown word. So

    P(w | u) = d(c(u, w)) c(u, w) / c(u)    if u w was seen,  else alpha(u) P(w),
    alpha(u) = (1 - sum of the first over the w seen after u) / (1 - sum of their P(w)),

and over all known words and the unknown one the probabilities of each context add to 1 exactly. A text's first word
stands after a start symbol; its end is a token. After a context without counts, P(w) holds.

No count is kept by document or on the driver. Texts become blocks of token codes with the block's own vocabulary. A
block sends each distinct word once to the part of the word table that its hash falls in, and gets its count and its
number back; then each distinct bigram, by those numbers, to a part of the bigram table, and gets counts and backoff
weights back. So a word or bigram has at most one entry from each block, however frequent it is. A context's bigrams
stand in one part of the table, but those of contexts with more than a part's share of all tokens are spread.

Where a count of counts is zero or a discount not between 0 and 1, the discount of r is 1 - 1 / (2 r). Where a context
(or the whole table) would free no mass, all its counts are divided by one more than their sum.

Defined results: a null text is empty, and an empty text is one end token; a null doc_id is trained on; rows that repeat
a doc_id are scored and trained on each; without training tokens every word is unknown, with probability 1; an empty
table gives an empty result; other columns, whatever their names, are not read. Word numbers have 32 bits; more
distinct words raise an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import _bytes as B
from foliant.llm._cluster import batches, blocks_for, column, cut, drop, release

#: Counts up to this are discounted.
K = 5
_SLICE = 4_000_000
#: Words or tokens in a part of a table, about.
_PART = 1_000_000
_END = B.U(0x9AE16A3B2F90404F)
_UNKNOWN = (1 << 32) - 1
_START = _UNKNOWN - 1
_ROWS = 4


def _pack(a: np.ndarray) -> bytes:
    """Numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def _unpack(data: bytes, dtype: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def _steps(a: np.ndarray) -> np.ndarray:
    """The first number and the differences of sorted ones; np.cumsum() undoes it."""
    return np.diff(a, prepend=a.dtype.type(0))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of texts as token codes: numbers in the block's sorted vocabulary."""
    base, number = TaskContext.get().partitionId() << 24, 0
    for b in B.gathered(batches, "text", _SLICE):
        offsets, data = B.buffers(b.column("text"))
        words, first = B.hashed_words(offsets, B.LOWER[data])
        n = np.diff(first) + 1
        tokens = np.insert(words, first[1:], _END)
        kinds, codes = np.unique(tokens, return_inverse=True)
        train = ~b.column("held").to_numpy(zero_copy_only=False)
        counts = np.bincount(codes[np.repeat(train, n)], minlength=len(kinds))
        at = pa.array([0, b.num_rows], pa.int32())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([base + number]), pa.ListArray.from_arrays(at, b.column("doc_id")), pa.ListArray.from_arrays(at, b.column("held")), pa.array([_pack(n.astype(np.uint32))]),
                pa.array([_pack(codes.astype(np.uint32))]), pa.array([_pack(_steps(kinds))]), pa.array([_pack(counts.astype(np.uint32))]), pa.array([len(kinds)]), pa.array([len(tokens)]),
                pa.array([int(n[train].sum())]), pa.array([int(train.sum())]),
            ],
            ["block", "doc_ids", "held", "lengths", "codes", "words", "counts", "n_words", "n_tokens", "n_train", "train_docs"],
        )
        number += 1


_TOKENS = "lengths binary, codes binary, words binary, counts binary, n_words long, n_tokens long, n_train long, train_docs long"


def _word_parts(words: np.ndarray, parts: int) -> np.ndarray:
    """Ends of the parts' ranges in sorted hashes."""
    bounds = [min((i << 64) // parts, 2**64 - 1) for i in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(words, np.array(bounds, B.U)), [len(words)]]).astype(np.int64)


def _word_asks(parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, words, counts in zip(*(b.column(c).to_pylist() for c in ("block", "words", "counts")), strict=True):
                w, n = np.cumsum(_unpack(words, B.U), dtype=B.U), _unpack(counts, np.uint32)
                ends = _word_parts(w, parts)
                rows = [(p, block, _pack(_steps(w[i:j])), _pack(n[i:j])) for p, (i, j) in enumerate(zip(ends, ends[1:], strict=False)) if j > i]
                yield pa.RecordBatch.from_pylist([dict(zip(("part", "block", "w", "n"), r, strict=True)) for r in rows], pa.schema([("part", pa.int32()), ("block", pa.int64()), ("w", pa.binary()), ("n", pa.binary())]))

    return run


def _by(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Rows of sorted batches with the same key."""
    held: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if held and held[0][key] != r[key]:
                yield held
                held = []
            held.append(r)
    if held:
        yield held


_MERGED = "part int, {keys}, n binary, blocks array<long>, sizes array<int>, places binary"


def _merged_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The word table's part: words and their training counts, and where in it each block's words are."""
    for rows in _by(batches, "part"):
        each = [np.cumsum(_unpack(r["w"], B.U), dtype=B.U) for r in rows]
        kinds, of = np.unique(np.concatenate(each), return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([_unpack(r["n"], np.uint32) for r in rows]), minlength=len(kinds)).astype(B.U)
        # words of held-out texts only come last: the others' places are their numbers
        order = np.lexsort((kinds, n == 0))
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[0]["part"]], pa.int32()), pa.array([_pack(kinds[order])]), pa.array([_pack(n[order])]), pa.array([[r["block"] for r in rows]]), pa.array([[len(x) for x in each]], pa.list_(pa.int32())), pa.array([_pack(place[of])])],
            ["part", "w", "n", "blocks", "sizes", "places"],
        )


def _counts_of(table: DataFrame) -> tuple[list[int], dict[int, int]]:
    """How many distinct entries have count 1, 2, ... K + 1; and by part, how many were seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True):
                n = _unpack(n, B.U)
                of = np.bincount(np.minimum(n[n > 0], K + 2).astype(np.int64), minlength=K + 3)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([int((n > 0).sum())]), pa.array([of[1 : K + 2].tolist()], pa.list_(pa.int64()))], ["part", "seen", "of"])

    # a few numbers for each part
    rows = table.select("part", "n").mapInArrow(run, "part int, seen long, of array<long>").collect()
    return [sum(r["of"][i] for r in rows) for i in range(K + 1)], {r["part"]: r["seen"] for r in rows}


def discounts(of: list[int]) -> np.ndarray:
    """Katz's discounts of counts 0 to K + 1 (the last, for all larger ones, is 1), from the counts of counts 1 to K + 1."""
    n = [0, *of]
    d = np.ones(K + 2)
    common = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        good = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common) if n[r] and common < 1 else 0.0
        d[r] = good if 0 < good < 1 else 1 - 1 / (2 * r)
    return d


def _discounted(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, K + 1).astype(np.int64)] * counts


class Unigrams:
    """P(w) by training count; the unknown word has count 0."""

    def __init__(self, of: list[int], tokens: int):
        self.d = discounts(of)
        self.tokens = tokens
        freed = sum(n * r * (1 - self.d[r]) for r, n in enumerate(of[:K], 1))
        self.over = max(tokens, 1) if freed > 0 else tokens + 1
        self.unknown = (freed if freed > 0 else 1) / self.over if tokens else 1.0

    def of(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, _discounted(self.d, counts) / self.over, self.unknown)


def _answers(offsets: dict[int, int]):
    """To each block, from each part: counts and numbers of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                n, places, at = _unpack(r["n"], B.U), _unpack(r["places"], np.uint32), 0
                ids = np.where(n > 0, offsets[r["part"]] + np.arange(len(n)), _UNKNOWN).astype(np.uint32)
                for block, size in zip(r["blocks"], r["sizes"], strict=True):
                    own = places[at : at + size]
                    at += size
                    yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([r["part"]], pa.int32()), pa.array([_pack(n[own])]), pa.array([_pack(ids[own])])], ["block", "part", "n", "ids"])

    return run


def _hot(limit: int, offsets: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, n in zip(b.column("part").to_pylist(), b.column("n").to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(_unpack(n, B.U) > limit) + offsets[part])], ["id"])

    return run


class _Block:
    """A block's tokens with their counts and numbers, and its distinct bigrams in the order they are asked for."""

    def __init__(self, r: dict, hot: np.ndarray, parts: int):
        got = sorted(r["words_got"], key=lambda x: x["part"])
        self.n = np.concatenate([_unpack(x["n"], B.U) for x in got])
        ids = np.concatenate([_unpack(x["ids"], np.uint32) for x in got]).astype(np.int64)
        self.codes, self.lengths = _unpack(r["codes"], np.uint32), _unpack(r["lengths"], np.uint32).astype(np.int64)
        w = ids[self.codes]
        u = np.empty_like(w)
        u[1:] = w[:-1]
        self.first = np.concatenate([[0], np.cumsum(self.lengths)])
        u[self.first[:-1]] = _START
        self.asked = np.flatnonzero(u != _UNKNOWN)
        keys, where, self.of = np.unique((u[self.asked].astype(B.U) << B.U(32)) | w[self.asked].astype(B.U), return_index=True, return_inverse=True)
        self.u, self.w = (keys >> B.U(32)).astype(np.int64), (keys & B.U(_UNKNOWN)).astype(np.int64)
        self.wn = self.n[self.codes[self.asked[where]]]
        spread = np.isin(self.u, hot) | (self.u == _START)
        self.part = (B.mix(np.where(spread, B.mix(keys), self.u.astype(B.U))) % B.U(parts)).astype(np.int64)
        # keys are sorted, so that a stable sort by part leaves each part's sorted
        self.order = np.argsort(self.part, kind="stable")
        self.ends = np.searchsorted(self.part[self.order], np.arange(parts + 1))


def _bigram_asks(hot: np.ndarray, parts: int):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("u", pa.binary()), ("w", pa.binary()), ("wn", pa.binary()), ("n", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                b = _Block(r, hot, parts)
                train = np.repeat(~np.array(r["held"], bool), b.lengths)[b.asked]
                n = np.bincount(b.of[train], minlength=len(b.u)).astype(np.uint32)
                rows = []
                for p, (i, j) in enumerate(zip(b.ends, b.ends[1:], strict=False)):
                    if j > i:
                        k = b.order[i:j]
                        rows.append({"part": p, "block": r["block"], "u": _pack(_steps(b.u[k])), "w": _pack(b.w[k].astype(np.uint32)), "wn": _pack(b.wn[k]), "n": _pack(n[k])})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return run


def _merged_bigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bigram table's part: contexts, words, training counts of the words and of the bigrams; and where each block's are."""
    for rows in _by(batches, "part"):
        each = [(np.cumsum(_unpack(r["u"], np.int64)).astype(B.U) << B.U(32)) | _unpack(r["w"], np.uint32).astype(B.U) for r in rows]
        keys, where, of = np.unique(np.concatenate(each), return_index=True, return_inverse=True)
        n = np.bincount(of, weights=np.concatenate([_unpack(r["n"], np.uint32) for r in rows]), minlength=len(keys)).astype(B.U)
        wn = np.concatenate([_unpack(r["wn"], B.U) for r in rows])[where]
        ends = np.cumsum([len(x) for x in each])
        places = np.concatenate([_steps(x) for x in np.split(of.astype(np.int64), ends[:-1])])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[0]["part"]], pa.int32()), pa.array([_pack(_steps((keys >> B.U(32)).astype(np.int64)))]), pa.array([_pack((keys & B.U(_UNKNOWN)).astype(np.uint32))]), pa.array([_pack(wn)]), pa.array([_pack(n)]),
                pa.array([[r["block"] for r in rows]]), pa.array([[len(x) for x in each]], pa.list_(pa.int32())), pa.array([_pack(places.astype(np.uint32))]),
            ],
            ["part", "u", "w", "wn", "n", "blocks", "sizes", "places"],
        )


def _context_sums(u: np.ndarray, n: np.ndarray, wn: np.ndarray, d: np.ndarray, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rows of contexts, context of each row, sums): of counts, of discounted counts, and of P(w) of the words seen."""
    first = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
    of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(u))))
    p = np.where(n > 0, unigrams.of(wn), 0.0)
    return first, of, np.stack([np.add.reduceat(x.astype(float), first) for x in (n, _discounted(d, n), p)], axis=1)


def _hot_sums(hot: np.ndarray, d: np.ndarray, unigrams: Unigrams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u = np.cumsum(_unpack(r["u"], np.int64))
                first, _, sums = _context_sums(u, _unpack(r["n"], B.U), _unpack(r["wn"], B.U), d, unigrams)
                own = np.flatnonzero(np.isin(u[first], hot) | (u[first] == _START))
                yield pa.RecordBatch.from_arrays([pa.array(u[first][own]), *(pa.array(sums[own, i]) for i in range(3))], ["u", "c", "a", "p"])

    return run


def _weights(sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(alpha, what counts are divided by) of contexts."""
    c, a, p = sums.T
    over = np.where(c - a > 0, c, c + 1)
    return np.where(c > 0, (1 - a / np.maximum(over, 1)) / (1 - p), 1.0), over


def _bigram_answers(hot: np.ndarray, hot_sums: np.ndarray, d: np.ndarray, unigrams: Unigrams):
    """To each block, from each part: counts of its bigrams; alpha and divisor of those of its contexts that back off or differ from their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                u, n = np.cumsum(_unpack(r["u"], np.int64)), _unpack(r["n"], B.U)
                first, of, sums = _context_sums(u, n, _unpack(r["wn"], B.U), d, unigrams)
                if len(hot):
                    i = np.minimum(np.searchsorted(hot, u[first]), len(hot) - 1)
                    hit = hot[i] == u[first]
                    sums[hit] = hot_sums[i[hit]]
                alpha, over = _weights(sums)
                steps, at = _unpack(r["places"], np.uint32), 0
                for block, size in zip(r["blocks"], r["sizes"], strict=True):
                    own = np.cumsum(steps[at : at + size].astype(np.int64))
                    at += size
                    back = np.flatnonzero(n[own] == 0)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([block]), pa.array([r["part"]], pa.int32()), pa.array([_pack(n[own])]), pa.array([_pack((over - sums[:, 0])[of[own]].astype(np.uint8))]), pa.array([_pack(alpha[of[own[back]]])])],
                        ["block", "part", "n", "more", "alpha"],
                    )

    return run


def _scores(hot: np.ndarray, parts: int, d: np.ndarray, unigrams: Unigrams, kinds: int, starts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_ids = batch.column("doc_ids")
            for k, r in enumerate(batch.select([c for c in batch.schema.names if c != "doc_ids"]).to_pylist()):
                b = _Block(r, hot, parts)
                p = unigrams.of(b.n)[b.codes]
                if len(b.asked):
                    got = sorted(r["bigrams_got"], key=lambda x: x["part"])
                    n, more = np.empty(len(b.u), B.U), np.empty(len(b.u))
                    n[b.order] = np.concatenate([_unpack(x["n"], B.U) for x in got])
                    more[b.order] = np.concatenate([_unpack(x["more"], np.uint8) for x in got])
                    alpha = np.ones(len(b.u))
                    alpha[b.order[n[b.order] == 0]] = np.concatenate([_unpack(x["alpha"], np.float64) for x in got])
                    count = np.empty(len(b.codes))
                    count[1:] = b.n[b.codes[:-1]]
                    count[b.first[:-1]] = starts
                    n, more, alpha = n[b.of], more[b.of], alpha[b.of]
                    own = count[b.asked]
                    p[b.asked] = np.where(n > 0, _discounted(d, n) / np.maximum(own + more, 1), alpha * p[b.asked])
                c = b.n[b.codes]
                base = np.log10((c + 1.0) / (unigrams.tokens + kinds + 1))
                add = lambda x: np.add.reduceat(x, b.first[:-1])
                ids = doc_ids.slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(r["held"], pa.bool_()), pa.array(b.lengths), pa.array(add((c > 0).astype(np.int64))), pa.array(np.full(len(ids), unigrams.tokens)), pa.array(add(base)), pa.array(add(np.log10(p)))],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return run


def _replies(answers: DataFrame, name: str, *columns: str) -> DataFrame:
    """A block's answers from all parts, in one row."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("part", *columns)).alias(name))


def scored(docs: DataFrame, held: Column, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of docs; held: rows not trained on."""
    spark = docs.sparkSession
    rows = docs.select(column(docs, doc_id).alias("doc_id"), column(docs, text).alias("text"), held.alias("held"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    with batches(spark, 1000):
        tokens, tokens_at = cut(rows.mapInArrow(_tokenised, f"block long, doc_ids array<{kind}>, held array<boolean>, {_TOKENS}"), "lm-tokens")
    with batches(spark, _ROWS):  # a row holds a block's words
        out = _scored(tokens, kind)
    drop(spark, tokens_at)
    release(spark)
    return out


def _scored(tokens: DataFrame, kind: str) -> DataFrame:
    """The scores of tokenised blocks; doc_id is of type kind."""
    spark = tokens.sparkSession
    sums = tokens.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_tokens", "n_train", "train_docs"))).first()

    parts = blocks_for(sums["n_words"], _PART)
    asks = tokens.select("block", "words", "counts").mapInArrow(_word_asks(parts), "part int, block long, w binary, n binary")
    words, words_at = cut(asks.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_merged_words, _MERGED.format(keys="w binary")), "lm-words")
    release(spark)
    of, seen = _counts_of(words)
    unigrams = Unigrams(of, sums["n_train"])
    offsets, at = {}, 0
    for part in sorted(seen):
        offsets[part], at = at, at + seen[part]
    known = at
    if known >= _START:
        raise OverflowError(f"{known} distinct words are more than word numbers of 32 bits hold")
    replies, replies_at = cut(words.select("part", "n", "blocks", "sizes", "places").mapInArrow(_answers(offsets), "block long, part int, n binary, ids binary"), "lm-word-counts")

    parts = blocks_for(sums["n_tokens"], _PART)
    # fewer than parts + 1 words can have more than a part's share of all tokens
    limit = sums["n_train"] // parts
    hot = np.array(sorted(r["id"] for r in words.select("part", "n").mapInArrow(_hot(limit, offsets), "id long").collect()), np.int64)
    drop(spark, words_at)
    whole = tokens.select("block", "doc_ids", "held", "lengths", "codes").join(_replies(replies, "words_got", "n", "ids"), "block")
    asks = whole.drop("doc_ids").mapInArrow(_bigram_asks(hot, parts), "part int, block long, u binary, w binary, wn binary, n binary")
    bigrams, bigrams_at = cut(asks.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(_merged_bigrams, _MERGED.format(keys="u binary, w binary, wn binary")), "lm-bigrams")
    release(spark)
    d = discounts(_counts_of(bigrams)[0])
    of_hot = bigrams.select("u", "n", "wn").mapInArrow(_hot_sums(hot, d, unigrams), "u long, c double, a double, p double").groupBy("u").agg(F.sum("c").alias("c"), F.sum("a").alias("a"), F.sum("p").alias("p")).orderBy("u").collect()
    spread = np.array([r["u"] for r in of_hot], np.int64)
    spread_sums = np.array([[r["c"], r["a"], r["p"]] for r in of_hot], float).reshape(-1, 3)
    answers = bigrams.select("part", "u", "n", "wn", "blocks", "sizes", "places").mapInArrow(_bigram_answers(spread, spread_sums, d, unigrams), "block long, part int, n binary, more binary, alpha binary")
    got = _replies(answers, "bigrams_got", "n", "more", "alpha")
    out = whole.join(got, "block", "left").mapInArrow(
        _scores(hot, parts, d, unigrams, known, sums["train_docs"]), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )
    out, _ = cut(out, "lm-scores")
    drop(spark, replies_at, bigrams_at)
    return out


def op9_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scored(docs, held_out(F.col("doc_id")))
