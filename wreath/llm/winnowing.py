"""Benchmark decontamination by winnowing (operator 5).

Windows are ``t`` consecutive words (13). Every text keeps, of each run of
``t - k + 1`` consecutive k-gram hashes, the smallest; two texts that share a
window keep the same hash there, so joining the kept hashes of training and
test texts finds every shared window. Each joined pair of positions is then
extended word by word to both sides; runs of at least ``t`` words are hits.
A test text of fewer than ``t`` words is one window of its own length; for
those lengths every training n-gram is compared.

Training texts first drop kept hashes that cannot occur in the test set, by a
bit field of fixed size (``FILTER_BITS``); the join decides what is left, so the
field only saves shuffling. Test texts with the same surroundings of a kept hash
are one row, with the list of their items.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. Null or
word-less texts have no words, no hits, and are clean; a null item id hits words
but is no item; repeated rows are judged one by one; an empty test set hits
nothing. Other columns of the input are kept by :func:`decontaminate`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import prepare, read, stored

WINDOW = 13
GRAM = 7
FILTER_BITS = 1 << 22        # 512 KB, whatever the test set's size


def selected(grams: np.ndarray, inside: np.ndarray, run: int) -> np.ndarray:
    """Positions of the smallest of every ``run`` consecutive hashes (the last
    of equals); ``inside[i]`` says that the run starting at i is within one text."""
    n = len(grams) - run + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, run):
        lower = grams[j: j + n] <= best
        best = np.where(lower, grams[j: j + n], best)
        at[lower] = j
    return np.unique((np.arange(n) + at)[inside[:n]])


def anchors(h: np.ndarray, rows: np.ndarray, t: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept k-grams."""
    g = TB.grams(h, k)
    inside = np.zeros(len(h), bool)
    if len(h) >= t:
        inside[: len(h) - t + 1] = rows[: len(h) - t + 1] == rows[t - 1:]
    at = selected(g, inside, t - k + 1)
    return at, g[at] if len(at) else np.zeros(0, np.uint64)


def _context(h: np.ndarray, rows: np.ndarray, at: np.ndarray, reach: int, k: int) -> np.ndarray:
    """Word hashes around each position; 0 beyond the text."""
    idx = at[:, None] + np.arange(-reach, k + reach)
    ok = (idx >= 0) & (idx < len(h))
    idx = idx.clip(0, max(0, len(h) - 1))
    ok &= rows[idx] == rows[at][:, None]
    return np.where(ok, h[idx], np.uint64(0)) if len(at) else np.zeros((0, k + 2 * reach), np.uint64)


def anchor_udf(spark, t: int, k: int, short: list[int] | None, field: np.ndarray | None):
    """Text -> number of words and anchors. ``short``: lengths of short windows
    to look for (None: the text is a test text and is itself one if short).
    ``field``: anchors that it excludes are left out."""
    shared = spark.sparkContext.broadcast(field) if field is not None else None
    reach = t - k

    def passes(g: np.ndarray) -> np.ndarray:
        if shared is None:
            return np.ones(len(g), bool)
        bit = g & np.uint64(FILTER_BITS - 1)
        return (shared.value[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 > 0

    @F.arrow_udf("struct<n_words:long,anchors:array<struct<pos:int,n:int,h:long,ctx:binary>>>")
    def find(texts: pa.Array) -> pa.Array:
        total, counts = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        pos, size, hashes, ctx = [], [], [], []
        for i, j, h, rows in TB.words(texts, TB.ALNUM):
            n = np.bincount(rows, minlength=j - i)
            total[i:j] = n
            head = np.cumsum(n) - n
            at, g = anchors(h, rows, t, k)
            ok = passes(g)
            found = [(at[ok], g[ok], np.zeros(ok.sum(), np.int64))]
            for length in range(1, t) if short is None else short:
                g = TB.grams(h, length, salt=length)
                at = np.flatnonzero(rows[: len(g)] == rows[length - 1:]) if len(g) else np.zeros(0, np.int64)
                if short is None:
                    at = at[n[rows[at]] == length]
                at = at[passes(g[at])]
                found.append((at, g[at], np.full(len(at), length)))
            at, g, kind = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(at, kind="stable")
            at, g, kind = at[order], g[order], kind[order]
            around = _context(h, rows, at, reach, k)
            around[kind > 0] = 0
            ctx += [x.tobytes() if not s else b"" for x, s in zip(around, kind)]
            pos.append(at - head[rows[at]])
            size.append(kind)
            hashes.append(g)
            counts[i:j] = np.bincount(rows[at], minlength=j - i)
        join = lambda x, d: np.concatenate(x) if x else np.zeros(0, d)
        values = pa.StructArray.from_arrays(
            [pa.array(join(pos, np.int64).astype(np.int32)), pa.array(join(size, np.int64).astype(np.int32)),
             pa.array(TB.signed(join(hashes, np.uint64).astype(np.uint64))), pa.array(ctx, pa.binary())],
            ["pos", "n", "h", "ctx"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)
        pos = size = hashes = ctx = None
        TB.give_back()
        return pa.StructArray.from_arrays([pa.array(total), lists], ["n_words", "anchors"])

    return find


def extend_udf(t: int, k: int):
    """Contexts of a training and a test anchor -> words shared to the left and
    right of it, or null if the run is shorter than ``t``."""
    reach = t - k

    @F.arrow_udf("struct<l:int,r:int>")
    def extend(x: pa.Array, y: pa.Array) -> pa.Array:
        n, width = len(x), k + 2 * reach
        a, b = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(n, width) for c in (x, y))
        same = (a == b) & (a != 0)
        left = np.cumprod(same[:, :reach][:, ::-1], axis=1).sum(1)
        right = np.cumprod(same[:, reach + k:], axis=1).sum(1)
        good = same[:, reach: reach + k].all(1) & (left + k + right >= t)
        return pa.StructArray.from_arrays(
            [pa.array(left.astype(np.int32)), pa.array(right.astype(np.int32))], ["l", "r"], mask=pa.array(~good))

    return extend


def merge_udf():
    """Ranges of one text, in any order -> the ranges they cover together, in order."""
    @F.arrow_udf("array<struct<lo:int,hi:int>>")
    def merge(ranges: pa.Array) -> pa.Array:
        sizes = np.diff(ranges.offsets.to_numpy())
        flat = ranges.flatten()
        text = np.repeat(np.arange(len(ranges)), sizes)
        lo, hi = (flat.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
        order = np.lexsort((lo, text))
        text, lo, hi = text[order], lo[order], hi[order]
        # ends reached so far in the text: each text gets its own stretch of numbers
        lane = text * (int(hi.max()) + 1 if len(hi) else 1)
        reached = np.maximum.accumulate(hi + lane)
        starts = np.ones(len(lo), bool)
        starts[1:] = (text[1:] != text[:-1]) | (lo[1:] + lane[1:] > reached[:-1])
        head = np.flatnonzero(starts)
        last = np.append(head[1:], len(lo))[: len(head)] - 1
        values = pa.StructArray.from_arrays([pa.array(lo[head].astype(np.int32)), pa.array((reached[last] - lane[last]).astype(np.int32))], ["lo", "hi"])
        counts = np.bincount(text[head], minlength=len(ranges))
        return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)).astype(np.int32)), values)

    return merge


def test_anchors(bench: DataFrame, item_col: str, text_col: str, t: int, k: int) -> DataFrame:
    """(h, n, ctx, items): distinct anchors of the test texts with the sorted
    ids, as strings, of the items that have them."""
    found = bench.select(F.col(item_col).cast("string").alias("item"), anchor_udf(
        bench.sparkSession, t, k, None, None)(F.col(text_col)).alias("a"))
    return stored(found.select("item", F.explode("a.anchors").alias("x")).groupBy("x.h", "x.n", "x.ctx").agg(
        F.array_sort(F.collect_set("item")).alias("items")), "test")


def bit_field(test: DataFrame) -> np.ndarray:
    """Bits of the hashes in ``test``; what comes to the driver is at most
    FILTER_BITS / 32 numbers."""
    bit = F.col("h").bitwiseAND(FILTER_BITS - 1)
    rows = test.groupBy(F.shiftright(bit, 5).alias("at")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(h & 31 as int))")).alias("bits")).toArrow()
    field = np.zeros(FILTER_BITS // 32, np.uint32)
    field[rows["at"].to_numpy()] = rows["bits"].to_numpy().astype(np.uint32)
    return field.view(np.uint8)


def contamination(docs: DataFrame, bench: DataFrame, text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", t: int = WINDOW, k: int = GRAM,
                  keep_text: bool = True) -> DataFrame:
    """One row per document: row (its columns), n_words, n_hit, spans (merged
    [from, to) word ranges that are hit) and items (sorted item ids as strings)."""
    spark = docs.sparkSession
    test = test_anchors(bench, item_col, item_text_col, t, k)
    short = [r["n"] for r in test.where("n > 0").select("n").distinct().collect()]   # at most t - 1 lengths
    # the text itself is kept only if the caller wants it back
    row = F.struct(*[F.col(c) for c in (docs.columns if keep_text else [c for c in docs.columns if c != text_col])])
    base = stored(docs.select(row.alias("row"), anchor_udf(spark, t, k, sorted(short), bit_field(test))(
        F.col(text_col)).alias("a")).select(F.monotonically_increasing_id().alias("uid"), "row", "a.*"), "anchors")
    probes = base.where(F.size("anchors") > 0).select("uid", F.explode("anchors").alias("x")).select("uid", "x.*")
    pairs = probes.alias("p").join(test.alias("q"), F.expr("p.h = q.h and p.n = q.n"))
    runs = pairs.where("p.n = 0").select(
        "uid", "pos", "items", extend_udf(t, k)(F.col("p.ctx"), F.col("q.ctx")).alias("e")).where("e is not null").select(
        "uid", "items", (F.col("pos") - F.col("e.l")).alias("lo"), (F.col("pos") + k + F.col("e.r")).alias("hi"))
    whole = pairs.where("p.n > 0").select("uid", "items", F.col("pos").alias("lo"), (F.col("pos") + F.col("p.n")).alias("hi"))
    hits = stored(runs.union(whole), "hits")
    # the ranges of one document: each word range once, then merged in order
    spans = hits.groupBy("uid").agg(F.collect_set(F.struct("lo", "hi")).alias("r")).select("uid", merge_udf()("r").alias("spans"))
    # a passage that many items share is one set of items at all its anchors
    items = hits.select("uid", "items").distinct().select("uid", F.explode("items").alias("item")).groupBy("uid").agg(
        F.array_sort(F.collect_set("item")).alias("items"))
    return (base.select("uid", "row", "n_words").join(spans, "uid", "left").join(items, "uid", "left")
            .select("row", "n_words",
                    F.expr("coalesce(aggregate(spans, 0L, (s, x) -> s + x.hi - x.lo), 0L)").alias("n_hit"),
                    F.coalesce("spans", F.expr("cast(array() as array<struct<lo:int,hi:int>>)")).alias("spans"),
                    F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items")))


def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words"))


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """The clean documents, with their own columns."""
    return contamination(docs, bench, **options).where(~contaminated()).select("row.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contract query: hit words and items of every document."""
    prepare(spark)
    found = contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"),
                          keep_text=False)
    return found.select("row.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
                        contaminated().alias("contaminated"))
