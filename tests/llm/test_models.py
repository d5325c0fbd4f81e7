"""Learned models and span merging against plain Python versions."""

import math
import random
import warnings
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from wreath.llm import kneser_ney as KN
from wreath.llm import pairwise_quality as PQ
from wreath.llm import winnowing as WN
from wreath.llm.common import prepare


@pytest.fixture(scope="module")
def spark(spark):
    return prepare(spark)


# 5 -------------------------------------------------------------------------

def test_many_spans_are_merged(spark):
    rng = random.Random(5)
    lists = [[(a, a + rng.randrange(1, 30)) for a in (rng.randrange(n * 12) for _ in range(n))] for n in (40_000, 1, 300, 5)] + [[], [(3, 4), (4, 6), (8, 9)]]
    df = spark.createDataFrame(list(enumerate(lists)), "id long, r array<struct<lo:int,hi:int>>")
    got = {r["id"]: [tuple(x) for x in r["s"]] for r in df.select("id", WN.merge_udf()("r").alias("s")).collect()}
    for i, ranges in enumerate(lists):
        want = []
        for lo, hi in sorted(ranges):
            if want and want[-1][1] >= lo:
                want[-1] = (want[-1][0], max(want[-1][1], hi))
            else:
                want.append((lo, hi))
        assert got[i] == want


def test_a_text_full_of_benchmark_passages(spark):
    rng = random.Random(7)
    items = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(400)) for _ in range(14)) for _ in range(60)]
    text = " ".join(f"{items[i % 60]} between{i}" for i in range(3_000))
    bench = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(100 + i, items[0]) for i in range(40)], "item_id long, text string")
    got = WN.contamination(spark.createDataFrame([(1, text)], "doc_id long, text string"), bench).first()
    assert (got["n_words"], got["n_hit"], len(got["spans"]), len(got["items"])) == (45_000, 42_000, 3_000, 100)


# 6 -------------------------------------------------------------------------

def test_order_is_the_plain_bradley_terry_fit():
    rng = np.random.default_rng(3)
    good, bad = rng.normal(0.6, 0.3, (9, 3)), rng.normal(0.3, 0.3, (1, 3))      # one bad row: every good one is paired with it
    got = PQ.learn_order(good, bad, 2, 1, ridge=0.05)
    scale = [float(np.std([*good[:, c], *bad[:, c]])) + 1e-6 for c in range(3)]
    diffs = [[(g[c] - bad[0][c]) / scale[c] for c in range(3)] for g in good.tolist()]
    w = [0.0] * 3
    for _ in range(30_000):          # plain gradient descent on the mean logistic loss of the pairs
        grad = [0.05 * w[c] - math.fsum(d[c] / (1 + math.exp(sum(a * b for a, b in zip(w, d)))) for d in diffs) / len(diffs) for c in range(3)]
        w = [a - 0.05 * b for a, b in zip(w, grad)]
    assert np.allclose(got, [a / s for a, s in zip(w, scale)], atol=1e-6)


def test_unfinished_fits_are_told():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((40, 2)), np.arange(40) % 2
    with pytest.warns(UserWarning, match="link"):
        KN.fit_link(x, y, steps=1)
    with pytest.warns(UserWarning, match="weights"):
        PQ.learn_order(x[y == 1], x[y == 0], 2, 0, steps=1)
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        KN.fit_link(x, y)
        PQ.learn_order(x[y == 1], x[y == 0], 2, 0)


# 9 -------------------------------------------------------------------------

def plain_kneser_ney(words, weights, order):
    """weights: per class, word -> count. Returns log-likelihood of a word in a class."""
    def windows(word):
        padded = b" " * (order - 1) + word + b" "
        return [padded[i: i + order] for i in range(len(word) + 1)]

    def level(counts):
        once, twice = sum(n == 1 for n in counts.values()), sum(n == 2 for n in counts.values())
        d = min(0.95, max(0.1, once / (once + 2 * twice))) if once else 0.5
        total, kinds = defaultdict(float), Counter()
        for gram, n in counts.items():
            total[gram[:-1]] += n
            kinds[gram[:-1]] += 1

        def p(gram, lower):
            t = total.get(gram[:-1])
            if t is None:
                return lower
            own = max(counts[gram] - d, 0) / t if gram in counts else 0.0
            return own + d * kinds[gram[:-1]] / t * lower
        return p

    top = {}
    for name, weight in weights.items():
        counts = Counter()
        for word in words:
            for g in windows(word):
                if weight[word]:
                    counts[g] += weight[word]
        top[name] = level(counts)
    shared, longer = {}, {g for word in words for g in windows(word)}
    for k in range(order - 1, 0, -1):
        shared[k] = level(Counter(g[1:] for g in longer))
        longer = {g[1:] for g in longer}

    def log(word, name):
        out = 0.0
        for g in windows(word):
            p = 1 / 256
            for k in range(1, order):
                p = shared[k](g[-k:], p)
            out += math.log(top[name](g, p))
        return out
    return log


@pytest.mark.parametrize("order", [3, 5, 7])
def test_kneser_ney_equals_plain_python(order):
    rng = random.Random(order)
    words = sorted({"".join(rng.choice("aeklmnsü") for _ in range(rng.randrange(1, 9))).encode() for _ in range(150)})
    weights = {c: {w: rng.choice([0, 1, 1, 2, 5]) for w in words} for c in ("toxic", "ordinary")}
    model = KN.KneserNeyPair(order).fit(words, *(np.array([weights[c][w] for w in words], float) for c in ("toxic", "ordinary")))
    plain = plain_kneser_ney(words, weights, order)
    asked = words[:40] + [b"q", b"neverseen", "äöü".encode(), b"mmmmmmmmmmmmmmmmmmmmmm"]
    toxic, ordinary, length = model.word_logs(asked)
    assert length.tolist() == [len(w) + 1 for w in asked]
    assert np.allclose(toxic, [plain(w, "toxic") for w in asked], rtol=1e-5)
    assert np.allclose(ordinary, [plain(w, "ordinary") for w in asked], rtol=1e-5)


def test_differences_are_those_of_the_words():
    words = [b"idiot", b"scum", b"house", b"green", b"the"]
    model = KN.KneserNeyPair(4).fit(words, np.array([3., 2, 1, 0, 4]), np.array([0., 0, 5, 4, 9]))
    text = "The idiot, the GREEN house! unknown"
    t, o, n = model.word_logs([b"the", b"idiot", b"the", b"green", b"house", b"unknown"])
    gain = t - o
    want = [gain.sum() / n.sum(), gain.max(), (gain / n).max(), np.sort(gain)[-3:].mean(), math.log1p(6)]
    got = model.differences(pa.array([None, text, "", text]))
    assert np.allclose(got[1], want) and (got[1] == got[3]).all() and not got[[0, 2], :4].any()


def test_every_labelled_row_is_in_the_pairs(spark, monkeypatch):
    """All rows of both labels, the rarer copied to as many groups as the other fills."""
    monkeypatch.setattr(PQ, "GROUP", 16)
    draw = np.random.default_rng(1)
    rows = [(i, int(i % 10 > 0), [float(i)] + draw.random(PQ.FEATURES - 1).tolist()) for i in range(300)]
    table = spark.createDataFrame(rows, "__id long, __y int, x array<double>")
    found = PQ.stored_preferences(table, {0: 30, 1: 270}, 2, 5).collect()
    diff = np.concatenate([np.frombuffer(r["diff"]).reshape(-1, PQ.FEATURES) for r in found])
    ids = {(g, b): g - b for g in range(300) for b in range(0, 300, 10) if g % 10}
    assert len(found) > 8 and len(diff) >= 2 * 270 and set(diff[:, 0]) <= set(ids.values())
    same = {tuple(r) for r in diff[:, 1:].round(9)}
    x = np.array([r[2] for r in rows])[:, 1:]
    used = {g for g in range(300) if g % 10 and any(tuple((x[g] - x[b]).round(9)) in same for b in range(0, 300, 10))}
    assert len(used) == 270


def test_widest_gap_as_in_memory(spark):
    v = np.sort(np.random.default_rng(2).normal(size=500)).round(3)
    scores = spark.createDataFrame([(float(x),) for x in v], "score double").repartition(5)
    for lo, hi in ((0, 498), (100, 140), (7, 7)):
        k = lo + int(np.argmax(np.diff(v)[lo: hi + 1]))
        assert PQ.widest_gap(scores, lo, hi, 500) == (v[k] + v[k + 1]) / 2
