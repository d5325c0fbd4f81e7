"""Near duplicates by ProbMinHash signatures (operator 1).

A document is the multiset of its five-word shingles, weighted by how often each
occurs. Every (shingle, weight) starts a Poisson process whose rate is its
weight; each arrival hits one of ``m`` registers, and a register keeps the
shingle of its earliest arrival. Two registers agree with the *probability
Jaccard* similarity of the two documents (plain Jaccard when every weight is 1).
Arrivals later than the time by which all registers are filled cannot change
anything; they are never drawn (early termination).

1. Documents with the same word sequence are one class before anything else.
2. Registers are cut into bands; classes that share a band are candidates.
3. Candidates are verified with the exact probability Jaccard of their whole
   shingle multisets. First every class meets the busiest class of its buckets
   (linear in the bucket); then only pairs that share a bucket and are not yet
   connected are compared. That happens inside tasks, block against block of a
   bucket: registers first, then the exact similarity of those that could reach
   the threshold, and only links that join two groups leave the task. No pair
   becomes a row, yet no link that could change a group is left out.
4. Groups are the connected components of the links.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased. A text of
one to four words is a single shingle. Null, empty or word-less texts have no
shingle: each is a group of its own. Repeated rows and ids are documents of
their own that land in one group; the smallest id stays (null ids last, then any
one row). Other columns are ignored by the operator.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import join_groups, maybe_in, prepare, read, stored
from wreath.llm.components import connected_components

SHINGLE = 5
BANDS, ROWS = 28, 7
THRESHOLD = 0.8
SLICE = 1 << 18      # bytes of text whose arrivals are drawn at a time
BLOCK = 256          # members of a bucket compared in one task at a time
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def shingles(hashes: np.ndarray, rows: np.ndarray, n_rows: int, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count) of the distinct shingles of each row, sorted."""
    g = TB.grams(hashes, k)
    inside = rows[: len(g)] == rows[k - 1:] if len(g) else np.zeros(0, bool)
    row, gram = rows[: len(g)][inside], g[inside]
    n = np.bincount(rows, minlength=n_rows)
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        start = np.searchsorted(rows, short)
        whole = np.array([TB.grams(hashes[s: s + c], int(c), salt=int(c))[0] for s, c in zip(start, n[short])], np.uint64)
        row, gram = np.r_[row, short], np.r_[gram, whole]
    order = np.lexsort((gram, row))
    row, gram = row[order], gram[order]
    if not len(row):
        return row, gram, np.zeros(0)
    first = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])
    return row[first], gram[first], np.diff(np.append(first, len(row))).astype(float)


def prob_min_hash(row: np.ndarray, gram: np.ndarray, weight: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """(n_rows, m) registers; rows without a shingle keep 0."""
    registers = np.zeros(n_rows * m, np.uint64)
    if not len(row):
        return registers.reshape(n_rows, m)
    rate = weight / np.bincount(row, weight, n_rows)[row]
    best = np.full(n_rows * m, np.inf)
    element = np.arange(len(row))
    time, drawn = np.zeros(len(row)), np.zeros(len(row), np.int64)
    until = m * (np.log(m) + 3.0)           # nearly every register is hit by then
    open_rows = np.bincount(row, minlength=n_rows) > 0
    while len(element):
        waiting, later = element, []
        while len(waiting):
            block = np.maximum(1, np.ceil(rate[waiting] * (until - time[waiting]))).astype(np.int64)
            e = np.repeat(waiting, block)
            ends = np.cumsum(block)
            k = np.arange(len(e)) - np.repeat(ends - block, block) + np.repeat(drawn[waiting], block)
            with np.errstate(over="ignore"):
                h = TB.mix(gram[e] + (k.astype(np.uint64) + np.uint64(1)) * _GOLD)
            gap = -np.log(((h >> np.uint64(24)).astype(np.float64) + 0.5) / (1 << 40))
            total = np.cumsum(gap)
            base = np.repeat(total[ends - block] - gap[ends - block], block)
            t = np.repeat(time[waiting], block) + (total - base) / rate[e]
            slot = row[e] * m + (((h & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)).astype(np.int64)
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            registers[slot[won]] = gram[e[won]]
            drawn[waiting] += block
            time[waiting] = t[ends - 1]
            more = t[ends - 1] < until
            later.append(waiting[~more])
            waiting = waiting[more]
        filled = np.isfinite(best.reshape(n_rows, m)).all(1)
        element = np.concatenate(later)
        element = element[~filled[row[element]] & open_rows[row[element]]]
        until *= 2
    return registers.reshape(n_rows, m)


def band_hashes(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(registers), bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            acc = np.full(len(registers), np.uint64(b + 1), np.uint64)
            for r in range(b * rows, (b + 1) * rows):
                acc = TB.mix(acc * TB.BASE + registers[:, r])
            out[:, b] = acc
    return out


def _sequence_keys(h: np.ndarray, rows: np.ndarray, n_rows: int) -> np.ndarray:
    """Two 64-bit hashes of each row's whole word sequence."""
    keys = np.zeros((n_rows, 2), np.uint64)
    if len(h):
        head = np.flatnonzero(np.r_[True, np.diff(rows) > 0])
        at = np.arange(len(h)) - np.repeat(head, np.diff(np.append(head, len(h))))
        with np.errstate(over="ignore"):
            for c, salt in enumerate((0x2545F4914F6CDD1D, 0x369DEA0F31A53F85)):
                keys[rows[head], c] = TB.mix(np.add.reduceat(
                    TB.mix(h + np.uint64(salt) * (at.astype(np.uint64) * np.uint64(2) + np.uint64(1))), head))
    return keys


def signature_udf(bands: int, rows: int, k: int):
    @F.arrow_udf("struct<n_words:long,k1:long,k2:long,bands:array<long>>")
    def signature(texts: pa.Array) -> pa.Array:
        n = len(texts)
        words, keys = np.zeros(n, np.int64), np.zeros((n, 2), np.uint64)
        out = np.zeros((n, bands), np.uint64)
        for i, j, h, r in TB.words(texts, TB.ALNUM, SLICE):
            words[i:j] = np.bincount(r, minlength=j - i)
            keys[i:j] = _sequence_keys(h, r, j - i)
            out[i:j] = band_hashes(prob_min_hash(*shingles(h, r, j - i, k), j - i, bands * rows), bands, rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(TB.signed(out.ravel())))
        TB.give_back()
        return pa.StructArray.from_arrays(
            [pa.array(words), pa.array(TB.signed(keys[:, 0])), pa.array(TB.signed(keys[:, 1])), lists],
            ["n_words", "k1", "k2", "bands"])

    return signature


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    return np.frombuffer(blob, np.uint64, n), np.frombuffer(blob, np.uint32, n, 8 * n).astype(float)


def probability_jaccard(ga: np.ndarray, wa: np.ndarray, gb: np.ndarray, wb: np.ndarray) -> float:
    """Exact probability Jaccard of two weighted sets with sorted keys.

    For a common key with ratio r = b/a the term is
    a / (sum of a where b/a <= r  +  sum of b/r elsewhere); sorting by the ratio
    turns both sums into prefix sums."""
    _, ia, ib = np.intersect1d(ga, gb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    only_a = wa.sum() - wa[ia].sum()
    a, b = wa[ia], wb[ib]
    ratio = b / a
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    below = only_a + np.cumsum(a)            # b/a <= r, keys only in a among them
    above = wb.sum() - np.cumsum(b)          # b/a > r, keys only in b among them
    return float((a / (below + above / ratio)).sum())


def similarity_udf():
    @F.arrow_udf("double")
    def similarity(x: pa.Array, y: pa.Array) -> pa.Array:
        out = pa.array([probability_jaccard(*unpack(a.as_py()), *unpack(b.as_py())) for a, b in zip(x, y)], pa.float64())
        TB.give_back()
        return out

    return similarity


def verified(pairs: DataFrame, profiles: DataFrame, threshold: float) -> DataFrame:
    """Those (a, b) of ``pairs`` whose shingle sets reach the threshold."""
    joined = (pairs.join(profiles.select(F.col("uid").alias("a"), F.col("s").alias("sa")), "a")
              .join(profiles.select(F.col("uid").alias("b"), F.col("s").alias("sb")), "b"))
    return joined.select("a", "b", similarity_udf()("sa", "sb").alias("similarity")).where(F.col("similarity") >= threshold)


def profile_udf(m: int, k: int):
    """Text -> 16 bits of each register, and its packed shingles."""
    @F.arrow_udf("struct<r:binary,s:binary>")
    def profile(texts: pa.Array) -> pa.Array:
        regs, sets = [], []
        for i, j, h, r in TB.words(texts, TB.ALNUM, SLICE):
            row, gram, n = shingles(h, r, j - i, k)
            regs += [x.tobytes() for x in (TB.mix(prob_min_hash(row, gram, n, j - i, m)) >> np.uint64(48)).astype(np.uint16)]
            at = np.searchsorted(row, np.arange(j - i + 1))
            sets += [gram[a:b].tobytes() + n[a:b].astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:])]
        TB.give_back()
        return pa.StructArray.from_arrays([pa.array(regs, pa.binary()), pa.array(sets, pa.binary())], ["r", "s"])

    return profile


def block_links(m: int, bands: int, rows: int, threshold: float):
    """Links between two blocks of one bucket that join different groups."""
    # five standard deviations of the estimate below the threshold
    enough = (threshold - 5 * np.sqrt(threshold * (1 - threshold) / m)) * m
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def compare(key, table):
        band, p, q = int(key[1].as_py()), key[2].as_py(), key[3].as_py()
        side = table["side"].to_numpy()
        ia, ib = np.flatnonzero(side == p), np.flatnonzero(side == q)
        uid, group = table["uid"].to_numpy(), table["c"].to_numpy().copy()
        regs = np.frombuffer(b"".join(table["r"].to_pylist()), np.uint16).reshape(-1, m)
        sets = table["s"]
        found = []
        for at, x in enumerate(ia):
            ys = ib[at + 1:] if p == q else ib
            ys = ys[group[ys] != group[x]]
            if not len(ys):
                continue
            same = regs[ys] == regs[x]
            hit = same.sum(1) >= enough
            ys, same = ys[hit], same[hit]
            # a pair is looked at in the first band that it shares
            firsts = same[:, : band * rows].reshape(len(ys), band, rows).all(2).any(1) if band else np.zeros(len(ys), bool)
            for y in ys[~firsts]:
                if group[x] == group[y]:
                    continue
                value = probability_jaccard(*unpack(sets[int(x)].as_py()), *unpack(sets[int(y)].as_py()))
                if value >= threshold:
                    found.append((int(uid[x]), int(uid[y]), value))
                    group[group == group[y]] = group[x]
        cols = list(zip(*found)) if found else [[], [], []]
        return pa.table([pa.array(c, t.type) for c, t in zip(cols, schema)], schema=schema)

    return compare


def cross_links(members: DataFrame, comp: DataFrame, profiles: DataFrame, bands: int, rows: int, threshold: float) -> DataFrame:
    """Links between members of a bucket (h, band, uid) in different groups."""
    placed = members.select("h", "band", "uid").join(comp.withColumnRenamed("node", "uid"), "uid", "left").select(
        "h", "band", "uid", F.coalesce("component", "uid").alias("c"))
    sizes = placed.groupBy("h", "c").agg(F.count("*").alias("n")).groupBy("h").agg(
        F.max(F.struct("n", "c")).alias("top"), F.sum("n").alias("n")).where("n > top.n")
    left = stored(placed.join(sizes, "h").select(
        "h", "band", "uid", "c", (F.col("c") == F.col("top.c")).alias("big"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).alias("no"), F.ceil(F.col("top.n") / BLOCK).alias("nb")), "mixed")
    # the largest group of a bucket only meets the others; they meet everyone
    rest = F.pmod(F.xxhash64("uid"), F.col("no"))
    big = -1 - F.pmod(F.xxhash64("uid"), F.col("nb"))
    keyed = left.select("h", "band", "uid", "c", F.when(F.col("big"), big).otherwise(rest).alias("side"), "no", "nb")
    meets = F.explode(F.expr("""if(side < 0, transform(sequence(0L, no - 1), o -> struct(o as p, side as q)),
        concat(transform(sequence(0L, no - 1), o -> struct(least(o, side) as p, greatest(o, side) as q)),
               transform(sequence(1L, nb), i -> struct(side as p, -i as q))))"""))
    return (keyed.withColumn("meet", meets).select("h", "band", "uid", "c", "side", "meet.*").join(profiles, "uid")
            .groupBy("h", "band", "p", "q").applyInArrow(
                block_links(bands * rows, bands, rows, threshold), "a long, b long, similarity double"))


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS,
                          rows: int = ROWS, k: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: uid, row (its columns), n_words, component,
    group_size, keep_id and kept. ``uid`` numbers the rows of this run."""
    base = stored(docs.select(F.struct("*").alias("row")).select(
        "row", signature_udf(bands, rows, k)(F.col(f"row.{text_col}")).alias("s")).select(
        F.monotonically_increasing_id().alias("uid"), "row", "s.*"), "signatures")
    worded = base.where("n_words > 0")
    classes = stored(worded.groupBy("k1", "k2", "n_words").agg(
        F.min("uid").alias("cls"), F.count("*").alias("copies")), "classes")
    reps = classes.select(F.col("cls").alias("uid"))
    band = base.select("uid", "bands").join(reps, "uid", "left_semi").select("uid", F.posexplode("bands").alias("band", "h"))
    busy = band.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    members = stored(band.join(busy, "h"), "buckets")
    hub = members.groupBy("uid").agg(F.sum("n").alias("hub"))
    ranked = members.select("h", "uid", "n").join(hub, "uid").select(
        "h", "uid", F.struct("hub", (-F.col("uid")).alias("neg")).alias("rank"))
    centre = ranked.groupBy("h").agg(F.max("rank").alias("top"))
    first = (ranked.join(centre, "h").where("rank <> top").groupBy("uid").agg(F.max("top").alias("top"))
             .select((-F.col("top.neg")).alias("a"), F.col("uid").alias("b")))
    wanted = stored(members.select("uid").distinct(), "wanted")
    texts = base.select("uid", F.col(f"row.{text_col}").alias("text")).where(maybe_in(wanted, "uid")).join(wanted, "uid", "left_semi")
    profiles = stored(texts.select("uid", profile_udf(bands * rows, k)("text").alias("x")).select("uid", "x.*"), "profiles")
    links = stored(verified(stored(first, "pairs"), profiles, threshold), "links")
    comp = connected_components(links)
    links = stored(links.union(cross_links(members, comp, profiles, bands, rows, threshold)), "links")
    comp = connected_components(links)
    of_class = stored(classes.join(comp.withColumnRenamed("node", "cls"), "cls", "left").select(
        "k1", "k2", "n_words", "copies", F.coalesce("component", "cls").alias("component")), "classes")
    known = base.select("uid", F.col(f"row.{id_col}").alias("id"), "n_words", "k1", "k2")
    grouped = stored(join_groups(known.where("n_words > 0"), of_class, ["k1", "k2", "n_words"], "copies").select(
        "uid", "id", "n_words", "component").union(
        known.where("n_words = 0").select("uid", "id", "n_words", F.col("uid").alias("component"))), "groups")
    keep = stored(grouped.groupBy("component").agg(
        F.min(F.struct(F.col("id").isNull().alias("none"), "id", "uid")).alias("first"), F.count("*").alias("group_size")), "sizes")
    result = join_groups(grouped, keep, ["component"], "group_size").select(
        "uid", "n_words", "component", "group_size", F.col("first.id").alias("keep_id"),
        (F.col("uid") == F.col("first.uid")).alias("kept"))
    return base.select("uid", "row").join(result, "uid")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one of each group, with their own columns."""
    return near_duplicate_groups(docs, **options).where("kept").select("row.*")


def op1_near_duplicates(spark, sf_dir: str) -> DataFrame:
    """One row per document with its group: the smallest doc_id stands for it."""
    prepare(spark)
    g = near_duplicate_groups(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return g.select("row.doc_id", "keep_id", "group_size", "kept", "n_words")
