"""Toxicity by class-conditional Kneser-Ney models.

Each class has an interpolated bigram model with Kneser-Ney discounts, which backs off to the class's continuation
counts, and these back off to continuation counts that both classes share, so that an expression too rare for one
class costs both alike. A text's evidence is the difference of its log-likelihoods under both, divided by its
number of words; it is also taken over its densest stretches (`STRETCHES`), since a long text can be toxic in a few words. A
logistic calibration, fitted on rows that the counts left out, turns the evidence into a score from 0 to 1.

The models are fitted on a bounded sample of the labelled rows: at most `SAMPLE` of each class, those with the least
hashes, of texts of at most `SAMPLE_BYTES`. One in `CALIBRATE` of them calibrates. Every whole text is scored.

Defined results: null and empty texts, and those without words, have no evidence and get the calibration's score for
that; rows that repeat a doc_id are scored each; contradictory labels of a doc_id all count; rows without a label (or a
null one) are not learned from; where a class has no rows, all scores are the share of toxic labels (0 without any);
an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import _bytes as B
from foliant.llm._cluster import column, cut, small_batches

SAMPLE = 4000
SAMPLE_BYTES = 32_768
CALIBRATE = 5
#: Lengths of stretches, in words, and the evidence from which a word counts as strong.
STRETCHES = (1, 4, 16)
STRONG = 2.0
TOXIC = 0.7
_SLICE = 2_000_000
_PART = 4_000_000
_START = B.U(0x5BD1E9955BD1E995)

#: Letters, digits and everything beyond ASCII make words.
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def _bigrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, word, first) of all words of the texts, case-folded."""
    offsets, data = B.buffers(texts)
    words, first = B.hashed_words(offsets, B.LOWER[data], _WORD)
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[first[:-1][np.diff(first) > 0]] = _START
    return before, words, first


def _key(u: np.ndarray, w: np.ndarray) -> np.ndarray:
    return B.mix(u * B.U(0x9E3779B97F4A7C15) + w)


def _less(counts: np.ndarray) -> np.ndarray:
    """The modified Kneser-Ney discount of each count: one for 1, one for 2, one for more."""
    n = np.array([(counts == i).sum() for i in (1, 2, 3, 4)], float)
    if not n.all():
        return np.where(counts > 0, 0.5, 0.0)
    y = n[0] / (n[0] + 2 * n[1])
    d = np.array([0.0, *(min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), i - 0.05) for i in (1, 2, 3))])
    return d[np.minimum(counts, 3).astype(np.int64)]


def _at(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, found) of wanted in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    i = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return i, keys[i] == wanted


@dataclass
class Models:
    """Both classes' models, as sorted keys and values for class 0 and 1."""

    pairs: np.ndarray
    pair_mass: np.ndarray  # max(c(u, w) - D, 0) / c(u)
    contexts: np.ndarray
    backoff: np.ndarray  # weight of the lower order after u
    words: np.ndarray
    lower: np.ndarray  # P(w) of the lower order
    unseen: np.ndarray  # P of a word in neither class

    @classmethod
    def of(cls, u: np.ndarray, w: np.ndarray, counts: np.ndarray) -> Models:
        """counts: (rows, 2) of each distinct (u, w), for class 0 and 1."""
        words, wi = np.unique(w, return_inverse=True)
        contexts, ui = np.unique(u, return_inverse=True)
        types = counts > 0
        # the shared order: in how many contexts a word stands, in whichever class
        shared = np.bincount(wi, minlength=len(words)).astype(float)
        d = _less(shared)
        total = max(shared.sum(), 1)
        spread = d.sum() / total / (len(words) + 1)
        base, base_unseen = (shared - d) / total + spread, max(spread, 1e-12)
        lower, unseen = np.zeros((len(words), 2)), np.zeros(2)
        backoff, mass = np.ones((len(contexts), 2)), np.zeros((len(w), 2))
        for c in (0, 1):
            cont = np.bincount(wi, weights=types[:, c], minlength=len(words))
            d, total = _less(cont), max(cont.sum(), 1)
            rest = d.sum() / total if cont.any() else 1.0
            lower[:, c] = (cont - d) / total + rest * base
            unseen[c] = rest * base_unseen
            d = _less(counts[:, c])
            of_u = np.bincount(ui, weights=counts[:, c], minlength=len(contexts))
            freed = np.bincount(ui, weights=d, minlength=len(contexts))
            known = of_u > 0
            backoff[known, c] = freed[known] / of_u[known]
            mass[:, c] = (counts[:, c] - d) / np.maximum(of_u[ui], 1)
        keys = _key(u, w)
        order = np.argsort(keys)
        small = np.float32
        return cls(keys[order], mass[order].astype(small), contexts, backoff.astype(small), words, lower.astype(small), unseen.astype(small))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{f.name: getattr(self, f.name) for f in fields(self)})
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Models:
        with np.load(io.BytesIO(data)) as found:
            return cls(**{f.name: found[f.name] for f in fields(cls)})

    def evidence(self, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log P(w | u), and log P(w) of the lower order, of class 1 less those of class 0."""
        kinds, of = np.unique(w, return_inverse=True)
        i, hit = _at(self.words, kinds)
        p = np.where(hit[:, None], self.lower[i], self.unseen) if len(self.words) else np.ones((len(kinds), 2))
        of_word = np.log(p[:, 1] / p[:, 0])[of]
        p0, p1 = p[of, 0], p[of, 1]
        i, after = _at(self.contexts, np.append(kinds, _START))
        weight = np.where(after[:, None], self.backoff[i], 1.0) if len(self.contexts) else np.ones((len(kinds) + 1, 2))
        before = np.empty(len(w), np.int64)  # the context's place in kinds
        before[1:] = of[:-1]
        before[u == _START] = len(kinds)
        p0 *= weight[before, 0]
        p1 *= weight[before, 1]
        known = np.flatnonzero(hit[of] & after[before])
        keys = _key(u[known], w[known])
        order = np.argsort(keys)
        i, found = _at(self.pairs, keys[order])
        known, i = known[order][found], i[found]
        p0[known] += self.pair_mass[i, 0]
        p1[known] += self.pair_mass[i, 1]
        return np.log(p1 / p0), of_word

    def features(self, texts: pa.Array) -> np.ndarray:
        """For each text the evidence per word, of all and of its densest stretches, from both orders, and how short it is."""
        u, w, first = _bigrams(texts)
        n = np.diff(first)
        whole, of_word = self.evidence(u, w)
        strong = np.cumsum(np.concatenate([[0.0], np.maximum(of_word - STRONG, 0)]))
        out = [np.log1p(strong[first[1:]] - strong[first[:-1]]), 1 / np.sqrt(n + 1.0)]
        for e in (whole, of_word):
            sums = np.concatenate([[0.0], np.cumsum(e)])
            mean = (sums[first[1:]] - sums[first[:-1]]) / np.maximum(n, 1)
            out += [mean, *(_densest(sums, first, mean, size) for size in STRETCHES)]
        return np.stack(out, axis=1)


def _densest(sums: np.ndarray, first: np.ndarray, mean: np.ndarray, size: int) -> np.ndarray:
    """The largest mean of size neighbouring words in each text; shorter texts have their own mean."""
    out, n = mean.copy(), np.diff(first)
    long = np.flatnonzero(n >= size)
    if len(long):
        part = (sums[size:] - sums[:-size]) / size
        # stretches that cross into the next text count for none
        for k in range(1, size):
            cross = first[1:-1] - k
            part[cross[(cross >= 0) & (cross < len(part))]] = -np.inf
        out[long] = np.maximum.reduceat(part, np.minimum(first[:-1][long], len(part) - 1))
    return out


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (the last for 1) of a logistic regression with a ridge on standardised columns, by Newton's method."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    x = np.hstack([(x - mean) / spread, np.ones((len(x), 1))])
    b = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(b))
    penalty[-1, -1] = 1e-9
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b += step
        if np.abs(step).max() < 1e-9:
            break
    return np.append(b[:-1] / spread, b[-1] - (b[:-1] * mean / spread).sum())


@dataclass
class Classifier:
    """Broadcast models (packed), calibration weights, and the score of all texts where a class had no rows."""

    models: Broadcast | None
    weights: np.ndarray | None
    share: float


def _chance(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    z = np.hstack([x, np.ones((len(x), 1))]) @ weights
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bigram counts by class of a task's blocks of texts."""
    for b in B.gathered(batches, "text", _SLICE):
        u, w, first = _bigrams(b.column("text"))
        toxic = np.repeat(b.column("toxic").to_numpy(), np.diff(first))
        _, at, group = np.unique(_key(u, w), return_index=True, return_inverse=True)
        n = [np.bincount(group[toxic == c], minlength=len(at)).astype(np.int64) for c in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(u[at].view(np.int64)), pa.array(w[at].view(np.int64)), pa.array(n[0]), pa.array(n[1])], ["u", "w", "n0", "n1"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The models of all bigram counts, packed, in numbered parts."""
    got = pa.Table.from_batches(batches).combine_chunks()
    column = lambda name: got[name].to_numpy()
    counts = np.stack([column("n0"), column("n1")], axis=1)
    data = Models.of(column("u").view(B.U), column("w").view(B.U), counts).packed()
    for part, at in enumerate(range(0, len(data), _PART)):
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([data[at : at + _PART]], pa.binary())], ["part", "data"])


def _featured(models: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Models.unpacked(models.value)
        for b in B.gathered(batches, "text", _SLICE):
            x = found.features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["toxic", "x"])

    return run


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, seen: Column | None = None) -> Classifier:
    """Learn from rows of docs (doc_id, text) that labels marks toxic or not. seen: a condition on docs' rows."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), F.coalesce(column(docs, "text"), F.lit("")).alias("text"))
    rows = rows.where(seen if seen is not None else F.lit(True))
    marks = labels.select(column(labels, "doc_id").alias("doc_id"), column(labels, "toxic").cast("int").alias("toxic")).where("toxic IN (0, 1) AND doc_id IS NOT NULL").distinct()
    rows = rows.where(F.octet_length("text") <= SAMPLE_BYTES).withColumn("h", F.xxhash64("doc_id", "text"))
    # the sample is chosen by hashes, so only its own texts move
    ranked = rows.select("doc_id", "h").join(marks, "doc_id").distinct()
    parts = [ranked.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(SAMPLE) for c in (0, 1)]
    chosen, _ = cut(parts[0].unionByName(parts[1]), "chosen-labels")
    found = rows.join(F.broadcast(chosen), ["doc_id", "h"]).select("toxic", "h", "doc_id", "text").dropDuplicates(["toxic", "h", "doc_id"])
    sample, _ = cut(found, "labelled-sample")
    part = F.pmod(F.xxhash64(F.lit("part"), "h"), F.lit(CALIBRATE)) == 0
    shares = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = shares.get(1, 0) / max(sum(shares.values()), 1)
    learned = sample.where(~part).groupBy("toxic").count().count()
    check = sample.where(part).select("text", "toxic")
    if learned < 2 or check.select("toxic").distinct().count() < 2:
        return Classifier(None, None, share)
    # the sample is bounded, so one task holds its counts; the driver gets the packed models only
    counted = sample.where(~part).mapInArrow(_counted, "u long, w long, n0 long, n1 long").groupBy("u", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    models, _ = cut(counted.repartition(1).mapInArrow(_fit, "part int, data binary"), "toxicity-models")
    shared = spark.sparkContext.broadcast(b"".join(bytes(r["data"]) for r in models.orderBy("part").collect()))
    found = check.mapInArrow(_featured(shared), "toxic int, x array<double>").collect()
    x, y = np.array([r["x"] for r in found]), np.array([r["toxic"] for r in found], float)
    return Classifier(shared, _logistic(x, y), share)


def scored(docs: DataFrame, classifier: Classifier) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    models, weights, share = classifier.models, classifier.weights, classifier.share
    rows = docs.select(column(docs, "doc_id").alias("doc_id"), column(docs, "text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Models.unpacked(models.value) if models is not None else None
        for b in B.gathered(batches, "text", _SLICE):
            p = _chance(found.features(b.column("text")), weights) if found is not None else np.full(b.num_rows, share)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p, pa.float64())], ["doc_id", "score"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    classifier = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~held_out(F.col("doc_id")))
    return scored(docs, classifier).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
