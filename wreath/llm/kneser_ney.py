"""Toxicity by class-conditional Kneser-Ney models (operator 9).

Two interpolated Kneser-Ney models over the letters (UTF-8 bytes) of words, one
learned from toxic and one from ordinary documents. Only the longest context
has counts of its class; every shorter context is *shared*: its continuation
counts come from both classes together, so a rare expression that neither class
knows well gets the same backoff probability in both and decides nothing.

A document is judged by length-normalised log-likelihoods: per word (divided by
the word's length) and over the whole text (divided by its length). A logistic
link, learned on labelled documents that the two models did not see, turns the
differences into a score from 0 to 1.

Defined results: null or empty text, or text without a word, gives the score of
a document with no evidence (all differences 0); repeated rows and ids are
scored row by row; other columns pass through; with no usable labels (none, or
one class only) every score is near 1 or 0, as the only label says (0 with none);
when a class has fewer than two drawn documents, one for the counts and one for the
link, every score is near 0 and nothing is called toxic.

Bounds: ``max_rows`` labelled documents and ``max_bytes`` of their text per class
(drawn by a hash of the id, on average); everything is scored whole.
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
from wreath.llm.common import bounded_share, fold, labelled_sample, prepare, read, stored, unit_hash

ORDER = 7            # longest n-gram, in bytes (7 at most: a key is 64 bits)
FEATURES = 5
WORD_BATCH = 16_384  # distinct words judged at a time
EDGE = 32            # byte before and after a word


def _windows(words: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte contexts, word of each row): for every byte of every word and its
    closing edge, the ``order`` bytes that end there."""
    pad = bytes([EDGE]) * (order - 1)
    buf = np.frombuffer(b"".join(pad + w + bytes([EDGE]) for w in words), np.uint8)
    lens = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
    first = np.cumsum(lens + order - 1) - (lens + order - 1)
    which = np.repeat(np.arange(len(words)), lens)
    at = np.arange(lens.sum()) - np.repeat(np.cumsum(lens) - lens, lens) + np.repeat(first, lens)
    win = np.empty((len(at), order), np.uint8)
    for j in range(order):
        win[:, j] = buf[at + j]
    return win, which


def _keys(win: np.ndarray, k: int) -> np.ndarray:
    """One integer per row for its last ``k`` bytes (k <= 7)."""
    key = np.full(len(win), k, np.uint64)
    for j in range(win.shape[1] - k, win.shape[1]):
        key = key << np.uint64(8) | win[:, j].astype(np.uint64)
    return key


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return at, table[at] == keys


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5


@dataclass
class KneserNeyPair:
    """Tables of the two models; ``link`` and ``bias`` map differences to a logit."""

    order: int = ORDER
    levels: dict = field(default_factory=dict)   # (k, name) -> grams, own part, contexts, backoff weight
    link: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = 0.0

    @staticmethod
    def _level(grams: np.ndarray, counts: np.ndarray) -> tuple:
        """Interpolated level from distinct grams with counts."""
        d = _discount(counts)
        ctx = grams >> np.uint64(8)
        c, start = np.unique(ctx, return_index=True)
        total = np.add.reduceat(counts, start) if len(start) else np.zeros(0)
        kinds = np.diff(np.append(start, len(ctx)))
        of = np.repeat(np.arange(len(c)), kinds)
        own = (counts - d).clip(0) / total[of]
        return grams, own.astype(np.float32), c, (d * kinds / total).astype(np.float32)

    def fit(self, words: list[bytes], toxic: np.ndarray, ordinary: np.ndarray) -> "KneserNeyPair":
        win, which = _windows(words, self.order)
        top = _keys(win, self.order)
        grams, inverse = np.unique(top, return_inverse=True)
        for name, weight in (("toxic", toxic), ("ordinary", ordinary)):
            n = np.bincount(inverse, weights=weight[which], minlength=len(grams))
            self.levels[self.order, name] = self._level(grams[n > 0], n[n > 0])
        # continuation counts: in how many distinct longer grams each shorter one occurs
        longer = np.unique(top, return_index=True)[1]
        longer = win[longer]
        for k in range(self.order - 1, 0, -1):
            g, n = np.unique(_keys(longer, k), return_counts=True)
            self.levels[k, "shared"] = self._level(g, n.astype(np.float64))
            longer = longer[np.unique(_keys(longer, k), return_index=True)[1]]
        return self

    def _step(self, key: tuple, grams: np.ndarray, lower: np.ndarray) -> np.ndarray:
        table, own, ctx, back = self.levels[key]
        at, hit = _find(table, grams)
        p = np.where(hit, own[at] if len(own) else 0.0, 0.0)
        # the context key keeps the level's leading marker: same layout as _level's
        at, hit = _find(ctx, grams >> np.uint64(8))
        return p + np.where(hit, back[at] if len(back) else 1.0, 1.0) * lower

    def word_logs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: log-likelihood under toxic and ordinary, and its length."""
        if not words:
            return (np.zeros(0),) * 3
        win, which = _windows(words, self.order)
        p = np.full(len(win), 1 / 256)
        for k in range(1, self.order):
            p = self._step((k, "shared"), _keys(win, k), p)
        top = _keys(win, self.order)
        t = np.log(self._step((self.order, "toxic"), top, p))
        o = np.log(self._step((self.order, "ordinary"), top, p))
        n = len(words)
        return (np.bincount(which, t, n), np.bincount(which, o, n), np.bincount(which, minlength=n).astype(float))

    def differences(self, column) -> np.ndarray:
        """Per text: length-normalised difference of the whole text, the largest
        difference of a word, of a word per byte, the mean of the three largest,
        and the logarithm of the number of words (chance finds grow with it)."""
        out = np.zeros((len(column), FEATURES))
        data, offsets = TB.utf8(column)
        for i, j in TB.row_slices(offsets, 4 << 20):      # long slices: fewer distinct words to judge
            off = offsets[i: j + 1] - offsets[i]
            mapped, s, e, rows = TB.word_spans(data[offsets[i]: offsets[j]], off, TB.ALNUM)
            if not len(s):
                continue
            _, first, inverse = np.unique(TB.span_hashes(mapped, s, e), return_index=True, return_inverse=True)
            distinct = [mapped[a:b].tobytes() for a, b in zip(s[first], e[first])]
            parts = [self.word_logs(distinct[k: k + WORD_BATCH]) for k in range(0, len(distinct), WORD_BATCH)]
            t, o, n = (np.concatenate(x) for x in zip(*parts))
            gain, length = (t - o)[inverse], n[inverse]
            m = j - i
            total, size = np.bincount(rows, gain, m), np.bincount(rows, length, m)
            out[i:j, 0] = total / np.maximum(size, 1)
            order = np.lexsort((-gain, rows))
            head = np.flatnonzero(np.r_[True, np.diff(rows[order]) > 0])
            ends = np.append(head[1:], len(order))
            docs = rows[order][head] + i
            best = gain[order]
            out[docs, 1] = best[head]
            np.maximum.at(out[:, 2], rows + i, gain / length)
            out[docs, 3] = sum(best[np.minimum(head + k, ends - 1)] for k in range(3)) / 3
            out[docs, 4] = np.log1p(ends - head)
        return out

    def score(self, column) -> np.ndarray:
        z = self.differences(column) @ self.link + self.bias if self.levels else np.full(len(column), self.bias)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_link(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50, tolerance: float = 1e-8,
             power: float = 0.5) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps on standardised columns; a class
    of n rows weighs n to the ``power``."""
    mean, std = x.mean(0), x.std(0) + 1e-9
    a = np.c_[(x - mean) / std, np.ones(len(x))]
    n1, n0 = max(1, (y > 0).sum()), max(1, (y <= 0).sum())
    weight = np.where(y > 0, n1 ** (power - 1.0), n0 ** (power - 1.0))
    weight /= weight.sum()
    w = np.zeros(a.shape[1])
    penalty = np.diag([ridge] * (a.shape[1] - 1) + [0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + penalty @ w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + penalty + 1e-9 * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < tolerance:
            break
    else:
        warnings.warn(f"the link still moves by {np.abs(move).max():.1g} after {steps} steps")
    coef = w[:-1] / std
    return coef, float(w[-1] - coef @ mean)


def _word_counter():
    @F.arrow_udf("array<struct<w:binary,n:long>>")
    def count_words(texts: pa.Array) -> pa.Array:
        data, offsets = TB.utf8(texts)
        lists, flat_w, flat_n = [0], [], []
        for i, j in TB.row_slices(offsets):
            off = offsets[i: j + 1] - offsets[i]
            mapped, s, e, rows = TB.word_spans(data[offsets[i]: offsets[j]], off, TB.ALNUM)
            h = TB.span_hashes(mapped, s, e)
            for r in range(j - i):
                a, b = np.searchsorted(rows, [r, r + 1])
                _, first, n = np.unique(h[a:b], return_index=True, return_counts=True)
                flat_w += [mapped[s[a + k]: e[a + k]].tobytes() for k in first]
                flat_n += n.tolist()
                lists.append(len(flat_w))
        values = pa.StructArray.from_arrays([pa.array(flat_w, pa.binary()), pa.array(flat_n, pa.int64())], ["w", "n"])
        del flat_w, flat_n
        TB.give_back()
        return pa.ListArray.from_arrays(pa.array(lists, pa.int32()), values)

    return count_words


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
        max_rows: int = 8_000, max_bytes: int = 6_000_000, seed: int = 9, order: int = ORDER) -> KneserNeyPair:
    """Learn the pair of models and the link from labelled documents.

    ``labels`` must already be restricted to the rows to learn from. Three
    quarters of the drawn documents give the counts, one the link, and at least one
    document of each class either. What comes to
    the driver is bounded by the sample: its distinct words with counts and four
    numbers a document."""
    sample, count, _ = labelled_sample(docs.where(F.col(text_col).isNotNull()), labels, id_col, text_col, label_col, max_rows, seed)
    model = KneserNeyPair(order)
    if len(count) < 2:
        model.bias = 30.0 if 1 in count else -30.0
        return model
    sample = stored(sample, "sample")
    size = {r["__y"]: r["b"] for r in sample.groupBy("__y").agg(F.sum(F.octet_length("__text")).alias("b")).collect()}
    less = {y: bounded_share(0, b, 1, max_bytes) for y, b in size.items()}
    sample = sample.where(unit_hash("__id", F.lit(seed + 2)) < F.when(F.col("__y") == 1, less.get(1, 0.0)).otherwise(less.get(0, 0.0)))
    part = unit_hash("__id", F.lit(seed + 1))
    ends = {r["__y"]: (r["a"], r["b"]) for r in sample.groupBy("__y").agg(F.min(part).alias("a"), F.max(part).alias("b")).collect()}
    if any(y not in ends or ends[y][0] == ends[y][1] for y in (0, 1)):
        model.bias = -30.0
        return model
    cut = {y: 3 / 4 if a < 3 / 4 <= b else b for y, (a, b) in ends.items()}
    linked = part >= F.when(F.col("__y") == 1, cut[1]).otherwise(cut[0])
    counted = (sample.where(~linked).select("__y", F.explode(_word_counter()("__text")).alias("c"))
               .groupBy(F.col("c.w").alias("w")).pivot("__y", [0, 1]).agg(F.sum("c.n")).toArrow())
    model.fit(counted["w"].to_pylist(), *(np.nan_to_num(counted[k].to_numpy().astype(float)) for k in ("1", "0")))
    rest = sample.where(linked).select("__y", difference_udf(docs.sparkSession, model)("__text").alias("d")).toArrow()
    if rest.num_rows:
        x = np.array(rest["d"].to_pylist(), float).reshape(rest.num_rows, FEATURES)
        model.link, model.bias = fit_link(x, rest["__y"].to_numpy())
    return model


def difference_udf(spark, model: KneserNeyPair):
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def differences(texts: pa.Array) -> pa.Array:
        x = shared.value.differences(texts)
        TB.give_back()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32()), pa.array(x.ravel()))

    return differences


def score_udf(spark, model: KneserNeyPair):
    """Column function text -> score. The broadcast model is bounded by the
    sample it was learned from."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def toxicity(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            yield pa.array(shared.value.score(column))
            TB.give_back()

    return toxicity


def score_toxicity(docs: DataFrame, model: KneserNeyPair, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with one more column, the score of each whole text."""
    return docs.withColumn(out_col, score_udf(docs.sparkSession, model)(F.col(text_col)))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Contract query: score and prediction of every document."""
    prepare(spark)
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    scored = score_toxicity(docs.select("doc_id", "text"), model, out_col="score")
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))
