"""Near-duplicate groups: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A text is the bag of its five-word shingles, each weighted by its count in the text times its inverse document
frequency. Document frequency counts distinct texts, all of them, in a count-min sketch of fixed size (`WIDTH` cells in
two rows, less their average load), so it is graded for shingles in `FLOOR` of all texts or more: one in every text
weighs 1, one in at most FLOOR of them 2, logarithmically between. Rarer ones are not told apart.

Each text gets `BANDS` x `ROWS` consistent weighted samples (Ioffe 2010). Two texts meet in a band if its samples
agree, which happens with the weighted Jaccard similarity to the power ROWS: at 0.8 some band agrees with probability
0.998. Pairs are verified by the weighted Jaccard similarity of the whole texts, after two tests that pairs of 0.8 pass:
that of their total weights (always), and that of `BITS` bits of 64 samples, of which at least 64 - `DIFFERENT` must
agree (with probability 0.9999). Both are tested within the join, so other pairs are never written. The second only
chooses what is verified first.

In each bucket, its least text (the leader) meets all others. Of buckets whose texts are then still in several groups,
those of more than `EVERY` texts meet the text with the most links too, which joins most of a large group at little cost.
What is left is compared throughout: a bucket still in several groups is dealt into blocks of about `BLOCK` texts, and
each two blocks (and each one with itself) meet in a task, which compares all their texts of different groups on whole
shingles, without the test of sampled bits. So nothing is capped, and no link between two texts that share a bucket is
lost: at the end they are in one group. That costs time with the square of such a bucket, dealt over tasks. Groups are the
connected components of verified links; a group's name is the least doc_id in it.

Equal texts are one text from the start; only one row of them is compared.

Defined results: null texts count as empty; texts without words are equal only to each other; a text of one to
four words has one shingle, of all its words; every row, repeated or with a null doc_id, gets the group of its text;
an empty table gives an empty result; other columns, whatever their names, are kept out of the comparison and are
returned as they are by representatives(), which keeps of rows that tie the one whose values hash least; doc_id may be
of any orderable type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm import _bytes as B
from foliant.llm._cluster import column, cut, drop, release, small_batches
from foliant.llm.components import components

SIMILARITY = 0.8
#: The share of texts up to which shingles are equally rare.
FLOOR = 0.02
#: Cells in a row of the sketch of document frequencies, a power of two; and the parts it is summed in.
WIDTH = 1 << 20
_PARTS = 32
ROWS, BANDS = 5, 16
#: Bits of a sample that are compared first, and of 64 samples, those that may differ in them.
BITS, DIFFERENT = 4, 24
#: Buckets of more texts meet their text with the most links before they are compared throughout.
EVERY = 64
#: Texts of a block, about, and their total weight (about a megabyte).
BLOCK, WEIGHT = 256, 200_000
_SKETCH = [f"s{i}" for i in range(BITS)]
#: Ids and pairs are broadcast to their texts up to this many (32 bytes each); beyond, they are joined by shuffle.
MAX_BROADCAST_PAIRS = 1_000_000
#: Pairs of one text that one task verifies together, about.
TOGETHER = 1000
_SLICE = 2_000_000
_CACHED = 32_000
_BITS = 16
_MASK = B.U((1 << 48) - 1)


def _bags(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct 48-bit shingles sorted by text, counts, first), for fewer than 2**16 texts."""
    h, first = B.shingles(*B.hashed_words(offsets, data))
    owner = np.repeat(np.arange(len(first) - 1, dtype=B.U), np.diff(first))
    keys = np.sort((owner << B.U(48)) | (h >> B.U(16)))
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return keys & _MASK, counts, np.searchsorted(keys, np.arange(len(first), dtype=B.U) << B.U(48))


def _cells(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where shingles stand in the two rows of the sketch."""
    return (h & B.U(WIDTH - 1)).astype(np.int64), ((h >> B.U(24)) & B.U(WIDTH - 1)).astype(np.int64)


class Weights:
    """Weights of shingles, from the sketch of their document frequencies (2 x WIDTH) and the number of texts."""

    def __init__(self, df: np.ndarray, total: int):
        load = df.sum(axis=1, keepdims=True) / WIDTH
        share = np.clip((df - load) / max(total, 1), FLOOR, 1)
        self.idf = (1 + np.log(1 / share) / np.log(1 / FLOOR)).astype(np.float32)

    def of(self, h: np.ndarray, counts: np.ndarray) -> np.ndarray:
        i, j = _cells(h)
        return np.maximum(self.idf[0][i], self.idf[1][j]).astype(float) * counts


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted shingles, weights)."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    i = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][i] == a[0]
    low = float(np.minimum(a[1][hit], b[1][i[hit]]).sum())
    return low / (float(a[1].sum()) + float(b[1].sum()) - low)


class Sampler:
    """Improved consistent weighted sampling. r and c are Gamma(2, 1), beta is uniform, drawn from tables by hash."""

    def __init__(self, k: int = ROWS * BANDS):
        g = np.random.default_rng(7)
        n = 1 << _BITS
        self.r = g.gamma(2.0, 1.0, n)
        self.beta = g.random(n)
        self.log_c = np.log(g.gamma(2.0, 1.0, n)).astype(np.float32)
        self.odd = g.integers(1, 2**63, k, dtype=np.uint64) * B.U(2) + B.U(1)
        self.usual = self._scores(np.full(n, np.log(2.0)), np.arange(n))

    def _steps(self, log_w: np.ndarray, i: np.ndarray) -> np.ndarray:
        return np.floor(log_w / self.r[i] + self.beta[i])

    def _scores(self, log_w: np.ndarray, i: np.ndarray) -> np.ndarray:
        return (-self.r[i] * (self._steps(log_w, i) - self.beta[i] + 1)).astype(np.float32)

    def of(self, h: np.ndarray, w: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Samples, one row for each text; texts without shingles get zeros. Runs of texts that fit a processor's cache are sampled together."""
        out = np.zeros((len(first) - 1, len(self.odd)), B.U)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(first, first[i] + _CACHED, "right")) - 1)
            self._run(h[first[i] : first[j]], w[first[i] : first[j]], first[i : j + 1] - first[i], out[i:j])
            i = j
        return out

    def _run(self, h: np.ndarray, w: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        full = np.flatnonzero(np.diff(first))
        if not len(full):
            return
        starts, sizes = first[full], np.diff(first)[full]
        other = np.flatnonzero(w != 2.0)
        log_w = np.log(w)
        high, low = B.U(64 - _BITS), B.U(64 - 2 * _BITS)
        mask = B.U((1 << _BITS) - 1)
        for k, odd in enumerate(self.odd):
            x = h * odd
            x ^= x >> B.U(32)
            x *= odd
            i, j = (x >> high).astype(np.int64), ((x >> low) & mask).astype(np.int64)
            score = self.usual[i]
            if len(other):
                score[other] = self._scores(log_w[other], i[other])
            score += self.log_c[j]
            least = np.repeat(np.minimum.reduceat(score, starts), sizes)
            at = np.flatnonzero(score == least)
            at = at[np.searchsorted(at, starts)]
            t = self._steps(log_w[at], i[at]).astype(np.int64)
            out[full, k] = B.mix(h[at] + B.mix(t.astype(B.U) + B.U(k)))


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketch of document frequencies, in parts."""
    df = np.zeros((2, WIDTH), np.uint32)
    for b in B.gathered(batches, "text", _SLICE):
        h, _, _ = _bags(*B.buffers(b.column("text")))
        for row, cells in zip(df, _cells(h), strict=True):
            row += np.bincount(cells, minlength=WIDTH).astype(np.uint32)
    packer = zstandard.ZstdCompressor(level=1)
    for part, piece in enumerate(df.reshape(_PARTS, -1)):
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([packer.compress(piece.tobytes())])], ["part", "df"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the sketch, summed over tasks."""
    sums: dict[int, np.ndarray] = {}
    unpacker = zstandard.ZstdDecompressor()
    for b in batches:
        for part, df in zip(b.column("part").to_pylist(), b.column("df").to_pylist(), strict=True):
            more = np.frombuffer(unpacker.decompress(df), np.uint32)
            sums[part] = sums.get(part, 0) + more.astype(np.uint64)
    for part, df in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([df.tobytes()])], ["part", "df"])


def weights(texts: DataFrame) -> Weights:
    """Weights over a table of distinct texts (column text). The driver gets the sketch, of fixed size."""
    sketched = texts.select("text").mapInArrow(_sketched, "part long, df binary")
    parts = sketched.repartition("part").mapInArrow(_summed, "part long, df binary").orderBy("part").collect()
    df = np.frombuffer(b"".join(r["df"] for r in parts), np.uint64) if parts else np.zeros(2 * WIDTH)
    return Weights(df.reshape(2, WIDTH).astype(float), texts.count())


def _sign(shared: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler()
        for b in B.gathered(batches, "text", _SLICE):
            h, n, first = _bags(*B.buffers(b.column("text")))
            w = shared.value.of(h, n)
            s = sampler.of(h, w, first)
            keys = np.zeros((b.num_rows, BANDS), B.U)
            for band in range(BANDS):
                for row in range(ROWS):
                    keys[:, band] = B.mix(keys[:, band] * B.U(31) + s[:, band * ROWS + row] + B.U(band))
            bands = B.pieces(keys.reshape(-1).view(np.int64), np.arange(b.num_rows + 1) * BANDS)
            size = np.diff(np.concatenate([[0.0], np.cumsum(w)])[first]).astype(np.float32)
            planes = [np.packbits(((s[:, :64] >> B.U(i)) & B.U(1)).astype(np.uint8), axis=1).view(np.int64).ravel() for i in range(BITS)]
            yield pa.RecordBatch.from_arrays([b.column("tid"), bands, pa.array(size), *map(pa.array, planes)], ["tid", "bands", "size", *_SKETCH]).filter(pa.array(np.diff(first) > 0))

    return run


def _verify(shared: Broadcast):
    """Of rows (a, b, text), the text of a (without b) before those of its b: the pairs (a, b) whose similarity reaches SIMILARITY."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = None
        for batch in B.slices(batches, "text", _SLICE):
            h, n, f = _bags(*B.buffers(batch.column("text")))
            w = shared.value.of(h, n)
            ok = np.zeros(batch.num_rows, bool)
            for i, new in enumerate(batch.column("b").is_null().to_pylist()):
                bag = h[f[i] : f[i + 1]], w[f[i] : f[i + 1]]
                if new:
                    first = bag
                else:
                    ok[i] = jaccard(first, bag) >= SIMILARITY - 1e-12
            first = first[0].copy(), first[1].copy()  # the rest of the slice goes
            yield batch.select(["a", "b"]).filter(pa.array(ok))

    return run


def _few(rows: DataFrame):
    """F.broadcast, if rows are few enough for it."""
    return F.broadcast if rows.count() <= MAX_BROADCAST_PAIRS else lambda df: df


def _similar(pairs: DataFrame, texts: DataFrame, shared: Broadcast) -> tuple[DataFrame, list[str]]:
    """The pairs (a, b) that are similar. The pairs of one a are dealt into parts, as many as they need."""
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    dealt, dealt_at = cut(pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part")), "dealt")
    near = _few(dealt)
    first = near(dealt.select("a", "part").distinct()).join(texts.select(F.col("tid").alias("a"), "text"), "a").select("a", "part", F.lit(None).cast("binary").alias("b"), "text")
    others = near(dealt).join(texts.select(F.col("tid").alias("b"), "text"), "b").select("a", "part", "b", "text")
    rows = first.unionByName(others).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    links, links_at = cut(rows.select("a", "b", "text").mapInArrow(_verify(shared), "a binary, b binary"), "links")
    return links, [dealt_at, links_at]


def _met(signed: DataFrame) -> DataFrame:
    """(key, tid, size, sketch, leader) of texts that share a bucket; its least text leads. One shuffle, and no bucket is held."""
    order = W.partitionBy("key").orderBy("tid")
    in_band = signed.select(F.explode("bands").alias("key"), "tid", "size", *_SKETCH)
    leader = F.first(F.struct("tid", "size", *_SKETCH)).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))
    return in_band.withColumns({"leader": leader, "next": F.lead("tid").over(order)}).where("tid <> leader.tid OR next IS NOT NULL").drop("next")


def _pairs(met: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) of texts and leaders that may be similar."""
    near = F.least("size", "leader.size") >= F.lit(SIMILARITY - 1e-5) * F.greatest("size", "leader.size")
    differ = [F.col(c).bitwiseXOR(F.col(f"leader.{c}")) for c in _SKETCH]
    any_bit = differ[0]
    for d in differ[1:]:
        any_bit = any_bit.bitwiseOR(d)
    possible = met.where(F.col("tid") != F.col("leader.tid")).where(near & (F.bit_count(any_bit) <= DIFFERENT))
    return possible.select(F.least("tid", "leader.tid").alias("a"), F.greatest("tid", "leader.tid").alias("b")).distinct()


def linked(h: np.ndarray, w: np.ndarray, first: np.ndarray, label: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Similar pairs of texts with different labels, as many as it takes to join all that such pairs join.

    All texts are compared, or where there are two sides, those of one with those of the other. No text is empty.
    """
    label = label.copy()
    total = np.add.reduceat(w, first[:-1])
    _, ids = np.unique(h, return_inverse=True)
    dense = np.zeros(len(h))
    here, there = np.flatnonzero(side == 0), np.flatnonzero(side)
    found = []
    for k, a in enumerate(here):
        others = there if len(there) else here[k + 1 :]
        others = others[label[others] != label[a]]
        others = others[np.minimum(total[others], total[a]) >= (SIMILARITY - 1e-9) * np.maximum(total[others], total[a])]
        if not len(others):
            continue
        sizes = first[others + 1] - first[others]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(first[others] - starts, sizes) + np.arange(int(sizes.sum()))
        own = slice(first[a], first[a + 1])
        dense[ids[own]] = w[own]
        low = np.add.reduceat(np.minimum(dense[ids[at]], w[at]), starts)
        dense[ids[own]] = 0
        for b in others[low / (total[a] + total[others] - low) >= SIMILARITY - 1e-12]:
            if label[b] != label[a]:
                found.append((int(a), int(b)))
                label[label == label[b]] = label[a]
    return found


def _whole(batches: Iterator[pa.RecordBatch], names: list[str], limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows, cut between different values of names into batches of about limit bytes of text (or one value), and where values begin."""
    tail = None
    for last, batch in _with_last(batches):
        rows = batch if tail is None else pa.Table.from_batches([tail, batch]).combine_chunks().to_batches()[0]
        keys = [rows.column(n).to_numpy() for n in names]
        opens = np.flatnonzero(np.concatenate([[True], np.any([k[1:] != k[:-1] for k in keys], axis=0)]))
        ends = np.append(opens[1:], rows.num_rows) if last else opens[1:]
        upto = np.append(0, np.cumsum(np.diff(B.buffers(rows.column("text"))[0])))
        i = 0
        while i < len(ends):
            j = max(i + 1, int(np.searchsorted(upto[ends], upto[opens[i]] + limit, "right")))
            yield rows.slice(opens[i], ends[j - 1] - opens[i]), np.append(opens[i:j], ends[j - 1]) - opens[i]
            i = j
        tail = rows.slice(opens[-1])


def _with_last(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches that have rows, each with whether it is the last."""
    before = None
    for batch in batches:
        if batch.num_rows:
            if before is not None:
                yield False, before
            before = batch
    if before is not None:
        yield True, before


def _compared(shared: Broadcast):
    """Of rows (key, i, j, side, tid, root, text) sorted by key, i and j: the links found within each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, opens in _whole(batches, ["key", "i", "j"], _SLICE):
            bags = []
            for part in B.slices([rows], "text", _SLICE):
                h, n, first = _bags(*B.buffers(part.column("text")))
                bags.append((h, shared.value.of(h, n), np.diff(first)))
            h, w, sizes = (np.concatenate(x) for x in zip(*bags, strict=True))
            first = np.append(0, np.cumsum(sizes))
            label = rows.column("root").dictionary_encode().indices.to_numpy()
            side = rows.column("side").to_numpy()
            pairs = []
            for i, j in zip(opens[:-1], opens[1:], strict=True):
                own = slice(first[i], first[j])
                pairs += [(a + i, b + i) for a, b in linked(h[own], w[own], first[i : j + 1] - first[i], label[i:j], side[i:j])]
            a, b = np.array(pairs, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([rows.column("tid").take(pa.array(a)), rows.column("tid").take(pa.array(b))], ["a", "b"])

    return run


def _live(rest: DataFrame, found: DataFrame) -> tuple[DataFrame, list[str]]:
    """rest (key, tid, size, sketch) with root, n and parts, of buckets whose texts are in several groups; of buckets of the same texts, one."""
    named = rest.join(found.select(F.col("node").alias("tid"), "root"), "tid", "left").withColumn("root", F.coalesce("root", "tid"))
    named, named_at = cut(named, "named")
    # a text stands once in a bucket, so one of several texts in one group has other roots or is done
    of_key = named.groupBy("key").agg(
        F.min("root").alias("least"), F.max("root").alias("most"), F.count("*").alias("n"), F.sum("size").alias("weight"), F.bit_xor(F.xxhash64("tid")).alias("x"), F.bit_xor(F.xxhash64("tid", F.lit(1))).alias("y")
    )
    parts = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("weight") / WEIGHT)).cast("int").alias("parts")
    one = of_key.where("least <> most").groupBy("n", "x", "y").agg(F.min(F.struct("key", parts)).alias("one"))
    apart, apart_at = cut(one.select("one.key", "n", "one.parts"), "apart")
    live, live_at = cut(named.join(_few(apart)(apart), "key"), "live")
    return live, [named_at, apart_at, live_at]


def _met_throughout(live: DataFrame, texts: DataFrame, shared: Broadcast) -> tuple[DataFrame, list[str]]:
    """Links (a, b) between the texts of each bucket, block by block, as many as it takes to join all that are similar."""
    own = F.pmod(F.xxhash64("tid"), F.col("parts")).cast("int")
    dealt = live.select("key", "tid", "root", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    i = F.least("own", "other")
    dealt = dealt.select("key", i.alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") != i).cast("int").alias("side"), "tid", "root")
    ids, ids_at = cut(live.select("tid").distinct(), "live-ids")
    rows = dealt.join(texts.join(_few(ids)(ids), "tid", "left_semi"), "tid").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    links, links_at = cut(rows.select("key", "i", "j", "side", "tid", "root", "text").mapInArrow(_compared(shared), "a binary, b binary"), "throughout")
    return links, [ids_at, links_at]


def _closed(rest: DataFrame, links: DataFrame, tried: DataFrame, texts: DataFrame, shared: Broadcast) -> tuple[DataFrame, list[str]]:
    """(node, root) of the links and of those found between texts that met, given the rows (key, tid, size, sketch) of all buckets."""
    found = components(links)
    live, paths = _live(rest, found)
    large = live.where(F.col("n") > EVERY)
    if not large.isEmpty():
        ends = links.select(F.col("a").alias("tid")).unionByName(links.select(F.col("b").alias("tid")))
        ranked = large.join(ends.groupBy("tid").agg(F.count("*").alias("degree")), "tid", "left")
        best = ranked.groupBy("key").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("degree"), "tid", "size", *_SKETCH, "root")).alias("leader"))
        leaders, leaders_at = cut(best.select("key", F.struct(*(f"leader.{c}" for c in ("tid", "size", *_SKETCH, "root"))).alias("leader")), "leaders")
        pairs = _pairs(large.join(_few(leaders)(leaders), "key").where("root <> leader.root")).join(tried, ["a", "b"], "left_anti")
        pairs, pairs_at = cut(pairs, "pairs")
        new, new_at = _similar(pairs, texts, shared)
        found = _joined(found, new)
        live, live_at = _live(live.drop("root", "n", "parts"), found)
        paths += [leaders_at, pairs_at, *new_at, *live_at]
        release(rest.sparkSession)
    if not live.isEmpty():
        new, new_at = _met_throughout(live, texts, shared)
        found = _joined(found, new)
        paths += new_at
        release(rest.sparkSession)
    return found, paths


def _joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """found (node, root) with the groups joined that links join."""
    return found if links.isEmpty() else components(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))


def text_id(text: Column) -> Column:
    """What stands for a text: 16 bytes of its MD5."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def classes(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(tid, class_id, first_id, root) for each distinct text: the least doc_id in its group and in its own copies, and the group's least tid."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(text_id(column(docs, text)).alias("tid"), column(docs, doc_id).alias("doc_id"), F.coalesce(column(docs, text), F.lit("")).alias("text"))
    texts, texts_at = cut(rows.groupBy("tid").agg(F.min("doc_id").alias("first_id"), F.first("text").alias("text")), "texts")
    release(spark)
    shared = spark.sparkContext.broadcast(weights(texts))
    signed, signed_at = cut(texts.select("tid", "text").mapInArrow(_sign(shared), "tid binary, bands array<long>, size float, " + ", ".join(f"{c} long" for c in _SKETCH)), "signed")
    met, met_at = cut(_met(signed), "buckets")
    star, star_at = cut(_pairs(met), "star")
    ids, ids_at = cut(met.select("tid").distinct(), "ids")
    release(spark)
    plain, plain_at = cut(texts.select("tid", "text").join(_few(ids)(ids), "tid", "left_semi"), "compared")
    links, links_at = _similar(star, plain, shared)
    final, paths = _closed(met.drop("leader"), links, star, plain, shared)
    drop(spark, signed_at, met_at, star_at, ids_at, plain_at, *links_at, *paths)
    named = texts.select("tid", "first_id").join(final, texts.tid == final.node, "left").select("tid", "first_id", F.coalesce("root", "tid").alias("root"))
    least = named.where("tid <> root").groupBy("root").agg(F.min("first_id").alias("least"))
    out = named.join(least, "root", "left").join(named.where("tid = root").select("root", F.col("first_id").alias("own")), "root")
    out, _ = cut(out.select("tid", F.least("own", "least").alias("class_id"), "first_id", "root"), "classes")
    drop(spark, texts_at)
    release(spark)
    return out


def grouped(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, class_id) for each row of docs."""
    rows = docs.select(column(docs, doc_id).alias("doc_id"), text_id(column(docs, text)).alias("tid"))
    return rows.join(classes(docs, text, doc_id), "tid").select("doc_id", "class_id")


def representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row of each group: of the rows with its least doc_id (null where all are) and least tid, that whose values hash least. The columns are docs' own."""
    one = F.min(F.struct("tid", F.col("first_id").alias("id"))).alias("one")
    kept = classes(docs, text, doc_id).where("class_id <=> first_id").groupBy("root").agg(one).select("one.tid", "one.id")
    packed = docs.select(F.struct(*(column(docs, c) for c in docs.columns)).alias("row"), text_id(column(docs, text)).alias("tid"), column(docs, doc_id).alias("id"))
    packed, kept = packed.alias("p"), kept.alias("k")
    same = (F.col("p.tid") == F.col("k.tid")) & F.col("p.id").eqNullSafe(F.col("k.id"))
    found = packed.join(kept, same, "left_semi").groupBy("tid", "id").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return found.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouped(spark.read.parquet(f"{sf_dir}/documents.parquet"))
