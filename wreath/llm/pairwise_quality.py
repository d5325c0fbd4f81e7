"""Document quality by Bradley-Terry pairwise ranking (operator 6).

Each labelled good document is preferred to each labelled bad one. A linear score
on text statistics is learned from preference pairs by logistic loss on the
difference of their features, so only the order of documents matters while
learning. The cut between good and bad is the quantile of the scores at the share
of bad labels, moved to the widest gap within ``SLACK`` of it; scores become numbers from 0 to 1 by a logistic curve that has
``CUT`` at that quantile.

Statistics look at whole texts: capitals, symbols, digits, table bars, repeated
neighbours, distinct words, word lengths, line breaks, very short texts.

Null, empty or word-less text has its own statistics (all 0 but ``no words``) and
gets a score like any other; repeated rows are scored alike, row by row. Without
labels of both kinds every score is 1 or 0 as the only label says (no labels: 1).
Other columns pass through.

Every labelled row is learned from. Each is in ``pairs_each`` rounds of pairs (good
and bad rows of a group of about ``GROUP`` rows, the rarer label copied to
as many groups as the other fills), the pairs are stored, and a Newton step is one job whose
tasks send 31 x 32 sums to the driver. The quantile is found by counting all
labelled scores, the gap by a sorted scan of those around it.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import fold, maybe_in, prepare, read, stored
from wreath.operators.ranges import _from_bits, double_key, select_ranks

CUT = 0.3
SLACK = 0.01
FEATURES = 31
GROUP = 2_048
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_SENTENCE = np.zeros(256, bool)
_SENTENCE[[ord(c) for c in ".,;:?'\"-()"]] = True
_SYMBOL = ~(_CAPITAL | _SMALL | _DIGIT | _SPACE | _SENTENCE)
_SYMBOL[128:] = False
_KEEP_CASE = np.arange(256, dtype=np.uint8)
_KEEP_CASE[_SPACE] = 0


def statistics(column) -> np.ndarray:
    """(texts, features): shares from 0 to 1 and their square roots."""
    data, offsets = TB.utf8(column)
    out = []
    for i, j in TB.row_slices(offsets):
        n = j - i
        off = offsets[i: j + 1] - offsets[i]
        d = data[offsets[i]: offsets[j]]
        row_of = np.repeat(np.arange(n), np.diff(off))
        size = np.maximum(np.diff(off), 1)

        def bytes_with(mask):
            return np.bincount(row_of[mask[d]], minlength=n)

        mapped, s, e, rows = TB.word_spans(d, off, _KEEP_CASE)
        h = TB.span_hashes(mapped, s, e)
        words = np.bincount(rows, minlength=n)
        many = np.maximum(words, 1)
        per_word = lambda mask: np.bincount(rows[mask], minlength=n) / many
        length = e - s
        last, first = d[e - 1] if len(e) else d[:0], d[s] if len(s) else d[:0]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
        order = np.lexsort((h, rows))
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[order][1:] != h[order][:-1]) | (rows[order][1:] != rows[order][:-1])
        distinct = np.bincount(rows[order][fresh], minlength=n)
        caps = np.append(0, np.cumsum(_CAPITAL[d]))
        shout = (caps[e] - caps[s]) >= np.maximum(2, (length + 1) // 2)
        capitals, small = bytes_with(_CAPITAL), bytes_with(_SMALL)
        shares = np.c_[
            capitals / np.maximum(capitals + small, 1),
            bytes_with(_SYMBOL) / size,
            bytes_with(_DIGIT) / size,
            bytes_with(_SENTENCE) / size,
            per_word(_SYMBOL[last]),
            per_word(_SYMBOL[last] & _SYMBOL[first] & (length == 1)),
            per_word(again),
            1 - distinct / many,
            per_word(shout),
            per_word(length > 25),
            per_word(length == 1),
            np.bincount(row_of[d == 10], minlength=n) / many,
            np.minimum(np.bincount(rows, length, n) / many / 20, 1),
            1 / (1 + words / 5),
            1 / (1 + words / 100),
        ].clip(0, 1)
        out.append(np.c_[shares, np.sqrt(shares), (words == 0)[:, None]])
    return np.concatenate(out) if out else np.zeros((0, 31))


@dataclass
class PairwiseRanker:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(31))
    at: float = 0.0           # score at the cut
    constant: float | None = None

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = x @ self.weights - self.at + np.log(CUT / (1 - CUT))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def preferences(good: np.ndarray, bad: np.ndarray, rounds: int, draw) -> np.ndarray:
    """Feature differences of pairs in which each row comes at least ``rounds`` times, the rows of the larger side exactly so."""
    n = max(len(good), len(bad)) * rounds
    g = np.resize(draw.permutation(len(good)), n)
    b = draw.integers(0, len(bad), n) if len(bad) > len(good) else np.resize(draw.permutation(len(bad)), n)
    if len(bad) > len(good):
        g, b = draw.integers(0, len(good), n), np.resize(draw.permutation(len(bad)), n)
    return good[g] - bad[b]


def moments(diff: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of pairs, gradient and Hessian of their loss, as one row."""
    p = 1 / (1 + np.exp(np.clip(diff @ w, -30, 30)))
    return np.concatenate([[len(diff)], -(diff * p[:, None]).sum(0), ((diff * (p * (1 - p))[:, None]).T @ diff).ravel()])


def newton(total, size: int, ridge: float, steps: int, tolerance: float) -> np.ndarray:
    """Weights at which ``total(w)``, the moments of all pairs, has no gradient with the ridge."""
    w = np.zeros(size)
    for _ in range(steps):
        t = total(w)
        grad = t[1: size + 1] / t[0] + ridge * w
        hess = t[size + 1:].reshape(size, size) / t[0] + ridge * np.eye(size)
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -3, 3)
        if np.abs(move).max() < tolerance:
            break
    else:
        warnings.warn(f"pairwise weights still move by {np.abs(move).max():.1g} after {steps} steps")
    return w


def learn_order(good: np.ndarray, bad: np.ndarray, pairs_each: int, seed: int, ridge: float = 3e-4, steps: int = 60,
                tolerance: float = 1e-7) -> np.ndarray:
    """Weights that minimise the mean of log(1 + exp(-w . (good - bad))) over the
    pairs plus a ridge on standardised features (Newton steps)."""
    scale = np.concatenate([good, bad]).std(0) + 1e-6
    diff = preferences(good, bad, pairs_each, np.random.default_rng(seed)) / scale
    return newton(lambda w: moments(diff, w), diff.shape[1], ridge, steps, tolerance) / scale


def _summed(df: DataFrame, of, size: int) -> np.ndarray:
    """Sum of ``of(batch)``, ``size`` numbers, over all batches; a task sends one row."""
    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for batch in batches:
            total += of(batch)
        TB.give_back()
        yield pa.record_batch([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["part", "block"])

    rows = df.mapInArrow(add, "part long, block binary").orderBy("part").collect()
    return np.sum([np.frombuffer(r["block"], np.float64) for r in rows], axis=0) if rows else np.zeros(size)


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), FEATURES)


def stored_preferences(rows: DataFrame, n: dict[int, int], rounds: int, seed: int) -> DataFrame:
    """Stored pairs of all ``rows`` (__id, __y, x), a group of them as one row of differences."""
    rare = 0 if n[0] <= n[1] else 1
    buckets = max(1, n[rare] * 2 // GROUP)
    parts = -(-n[1 - rare] // (buckets * GROUP))
    of = lambda salt, k: F.pmod(F.xxhash64("__id", "x", "round", F.lit(seed + salt)), F.lit(k)).cast("int")
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("round")).withColumn("bucket", of(0, buckets))
    common = each.where(F.col("__y") != rare).withColumn("part", of(1, parts))
    spread = each.where(F.col("__y") == rare).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def pair(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
        x, y = _matrix(group["x"].combine_chunks()), group["__y"].to_numpy()
        order = np.lexsort((*x.T, y))                 # the pairs do not depend on how rows arrive
        x, y = x[order], y[order]
        good, bad = x[y == 1], x[y == 0]
        if not len(good) or not len(bad):
            return pa.table({"diff": pa.array([], pa.binary())})
        diff = preferences(good, bad, 1, np.random.default_rng([seed, *[k.as_py() for k in key]]))
        out = pa.table({"diff": pa.array([diff.tobytes()], pa.binary())})
        del x, y, good, bad, diff
        TB.give_back()
        return out

    groups = common.unionByName(spread).groupBy("bucket", "part", "round")
    return stored(groups.applyInArrow(pair, "diff binary"), "preferences")


def widest_gap(scores: DataFrame, lo: int, hi: int, n: int) -> float:
    """Middle of the widest gap between neighbours of the sorted ``scores`` (score double) from rank ``lo``
    to ``hi`` + 1; the lowest of equal ones."""
    spark = scores.sparkSession
    keys = stored(scores.select(F.lit("").alias("g"), double_key(F.col("score")).alias("key")), "scores")
    ends = select_ranks(keys, spark.createDataFrame([("", lo), ("", hi + 1)], "g string, rank long"), n)
    ends = sorted(r["key"] for r in ends.select("key").collect())

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        best = (0.0, 0.0, 0.0)
        for batch in batches:
            v = _from_bits(batch.column(0)).to_numpy()
            if not len(v):
                continue
            first = v[0] if first is None else first
            v = v if last is None else np.append(last, v)
            last = v[-1]
            if len(v) > 1:
                k = int(np.argmax(np.diff(v)))
                best = max(best, (v[k + 1] - v[k], v[k], v[k + 1]), key=lambda t: t[0])
        if first is not None:
            yield pa.record_batch([pa.array([float(x)]) for x in (first, last, *best[1:])], ["first", "last", "low", "high"])

    inside = keys.where(F.col("key").between(ends[0], ends[-1])).select("key").distinct().orderBy("key")
    found = sorted(inside.mapInArrow(gaps, "first double, last double, low double, high double").collect())
    best, last = (found[0]["first"],) * 2, found[0]["first"]
    for r in found:
        for low, high in ((last, r["first"]), (r["low"], r["high"])):
            if high - low > best[1] - best[0]:
                best = (low, high)
        last = r["last"]
    return float(sum(best) / 2)


def feature_udf():
    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        x = statistics(texts)
        TB.give_back()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * 31, pa.int32()), pa.array(x.ravel()))

    return features


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "quality",
        pairs_each: int = 4, seed: int = 6, ridge: float = 3e-4, steps: int = 60, tolerance: float = 1e-7) -> PairwiseRanker:
    """Learn the ranking; ``labels`` must already be the rows to learn from. An id with both labels counts as 0."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(
        F.col(id_col).cast(docs.schema[id_col].dataType).alias("__id"), F.col(label_col).cast("int").alias("__y"))
    known = stored(known.where("__id is not null").groupBy("__id").agg(F.min("__y").alias("__y")), "labels")
    count = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}
    if len(count) < 2:
        return PairwiseRanker(constant=float(next(iter(count), 1)))
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    measured = texts.where(maybe_in(known, "__id")).select("__id", feature_udf()("__text").alias("x"))   # no text is shuffled
    rows = stored(measured.join(known, "__id"), "features")
    n = {r["__y"]: r["count"] for r in rows.groupBy("__y").count().collect()}
    if len(n) < 2:
        return PairwiseRanker(constant=float(max(count, key=count.get)))
    total = n[0] + n[1]

    def powers(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.concatenate([x.sum(0), (x * x).sum(0)])

    mean, square = _summed(rows.select("x"), powers, 2 * FEATURES).reshape(2, -1) / total
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-6
    pairs = stored_preferences(rows, n, pairs_each, seed)

    def of_pairs(w: np.ndarray):
        return lambda batch: sum((moments(np.frombuffer(d.as_buffer(), np.float64).reshape(-1, FEATURES) / scale, w) for d in batch.column(0)),
                                 np.zeros(1 + FEATURES + FEATURES ** 2))

    w = newton(lambda w: _summed(pairs, of_pairs(w), 1 + FEATURES + FEATURES ** 2), FEATURES, ridge, steps, tolerance) / scale

    @F.arrow_udf("double")
    def weighed(x: pa.Array) -> pa.Array:
        return pa.array((_matrix(x) * w).sum(1))

    # quantile of all labelled scores at the share of bad labels
    level = total * count[0] / (count[0] + count[1])
    lo, hi = (int(np.clip(np.ceil(level + d * SLACK * total) - 1, 0, total - 2)) for d in (-1, 1))
    return PairwiseRanker(w, widest_gap(rows.select(weighed("x").alias("score")), lo, hi, total))


def quality_udf(spark, ranker: PairwiseRanker):
    shared = spark.sparkContext.broadcast(ranker)      # 31 numbers

    @F.arrow_udf("double")
    def quality(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(shared.value.score(statistics(column)))
            TB.give_back()

    return quality


def score_quality(docs: DataFrame, ranker: PairwiseRanker, text_col: str = "text", out_col: str = "quality") -> DataFrame:
    """``docs`` with one more column, the score of each whole text."""
    return docs.withColumn(out_col, quality_udf(docs.sparkSession, ranker)(F.col(text_col)))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    """Contract query: score and prediction of every document."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranker = fit(docs, read(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    scored = score_quality(docs, ranker, out_col="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))
