"""Language-model scores by deleted interpolation (operator 10).

The model mixes the maximum-likelihood bigram and unigram estimates and a uniform
share over the vocabulary and one unknown word; the mixture weights depend on how
often the context was seen (buckets of doubling frequency) and are learned by
expectation-maximisation on *deleted* counts: every training token is predicted
from the counts of all training text but itself.

Counting runs over the whole corpus without rows per word. Texts are gathered into
chunks of some hundred thousand tokens; a chunk sends its distinct n-grams, hashed,
sorted and packed, to the hash ranges they belong to, a range adds the counts of
all chunks, and answers each chunk with the totals in the order of its question.
A frequent word is one entry per chunk, so no range is hot. The chunk table is
bucketed by chunk: looking the answers up does not move it again.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased and one end per
text. Null or empty text is one end. Unigrams are compared by 64-bit hashes,
bigrams by as many bits as make a clash of one bigram rarer than 2**-22. Without
training text every token has the uniform probability. Repeated rows count and
are scored as often as they occur; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.llm import textbytes as TB
from wreath.llm.common import fold, prepare, read, shared_path

CHUNK_TOKENS = 600_000
RANGE_ENTRIES = 1_000_000
BUCKETS = 48                      # context frequencies 0, 1, 2-3, 4-7, ...
STEPS = 8                         # histogram steps per factor of two
END = np.uint64(0xE9D2F1C3A5B49687)
START = np.uint64(0x5BD1E9955BD1E995)
UNIGRAM, BIGRAM = 1, 2


def pack(x: np.ndarray) -> bytes:
    """Bytes of a non-negative integer array, most similar bytes together."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def unpack(b: bytes, dtype) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(dtype).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b, np.uint64), dtype=np.uint64)


def bigram_hashes(token: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of (previous token, token); ``first`` marks the first of each text."""
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[first] = START
    with np.errstate(over="ignore"):
        return TB.mix(TB.mix(before) * TB.BASE + token)


def range_of(h: np.ndarray, bits: int, ranges: int) -> np.ndarray:
    """Range of each hash; growing with the hash, so sorted hashes stay together."""
    top = h >> np.uint64(max(0, bits - 32))
    return (top * np.uint64(ranges) >> np.uint64(min(32, bits))).astype(np.int64)


def chunk_rows(id_type: pa.DataType, tokens: int):
    """Batches of (id, held, text) -> rows of the chunk table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, nth = TaskContext.get().partitionId(), 0
        ids, held, sizes, hashes, total = [], [], [], [], 0

        def flush():
            h = np.concatenate(hashes)
            distinct, inverse, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.argsort(-n, kind="stable")          # frequent tokens get small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            one = pa.array([0, len(ids)], pa.int32())
            return pa.RecordBatch.from_arrays([
                pa.array([part << 24 | nth], pa.int64()), pa.array([len(h)], pa.int64()),
                pa.ListArray.from_arrays(one, pa.array(ids, id_type)),
                pa.array([pack(np.array(held, np.uint8))]), pa.array([pack(np.array(sizes, np.uint32))]),
                pa.array([pack(distinct[order])]), pa.array([pack(rank[inverse])])],
                ["chunk", "n_tokens", "ids", "held", "sizes", "vocabulary", "tokens"])

        for batch in batches:
            texts = batch.column(2)
            for i, j, h, rows in TB.words(texts, TB.SPACED):
                n = np.bincount(rows, minlength=j - i)
                ends = np.cumsum(n)
                hashes.append(np.insert(h, ends, END))
                ids += batch.column(0).slice(i, j - i).to_pylist()
                held += batch.column(1).slice(i, j - i).to_pylist()
                sizes += (n + 1).tolist()
                total += len(h) + j - i
                if total >= tokens:
                    yield flush()
                    nth += 1
                    ids, held, sizes, hashes, total = [], [], [], [], 0
        if ids:
            yield flush()

    return run


class Chunk:
    """One row of the chunk table, unpacked."""

    def __init__(self, row: dict):
        self.ids, self.chunk = row["ids"], row["chunk"]
        self.held = unpack(row["held"], np.uint8).astype(bool)
        self.sizes = unpack(row["sizes"], np.uint32).astype(np.int64)
        self.vocabulary = unpack(row["vocabulary"], np.uint64)
        self.tokens = unpack(row["tokens"], np.uint32)
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.train = ~self.held[self.doc]

    def unigrams(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sorted hashes, training counts, place of each token among them)."""
        order = np.argsort(self.vocabulary)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        at = place[self.tokens]
        return self.vocabulary[order], np.bincount(at[self.train], minlength=len(order)), at

    def bigrams(self, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = bigram_hashes(self.vocabulary[self.tokens], self.first) >> np.uint64(64 - bits)
        distinct, at = np.unique(h, return_inverse=True)
        return distinct, np.bincount(at[self.train], minlength=len(distinct)), at


QUESTION = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])
ANSWER = pa.schema([("kind", pa.int32()), ("range", pa.int64()), ("chunk", pa.int64()), ("counts", pa.binary()), ("types", pa.int64()), ("tokens", pa.int64())])


def questions(bits: int, ranges: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                c = Chunk(batch.slice(i, 1).to_pylist()[0])
                for kind, width, (h, n, _) in ((UNIGRAM, 64, c.unigrams()), (BIGRAM, bits, c.bigrams(bits))):
                    of = range_of(h, width, ranges[kind])
                    at = np.append(np.flatnonzero(np.diff(of, prepend=-1)), len(of))
                    n = n.astype(np.uint32)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(at) - 1, kind, np.int32)), pa.array(of[at[:-1]]),
                        pa.array(np.full(len(at) - 1, c.chunk)),
                        pa.array([pack_sorted(h[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary()),
                        pa.array([pack(n[a:b]) for a, b in zip(at[:-1], at[1:])], pa.binary())], schema=QUESTION)

    return run


def answers():
    def add(key, asked):
        hashes = [unpack_sorted(x.as_py()) for x in asked["hashes"]]
        counts = np.concatenate([unpack(x.as_py(), np.uint32) for x in asked["counts"]])
        _, at = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(at, weights=counts).astype(np.uint64)
        cut = np.cumsum([len(h) for h in hashes])[:-1]
        n = len(hashes)
        own = np.split(total[at], cut)
        kind, rng = key[0].as_py(), key[1].as_py()
        # the last row carries how many types and tokens of training text the range has
        return pa.table([
            pa.array([kind] * (n + 1), pa.int32()), pa.array([rng] * (n + 1), pa.int64()),
            pa.array(asked["chunk"].to_pylist() + [-1], pa.int64()),
            pa.array([pack(x) for x in own] + [None], pa.binary()),
            pa.array([None] * n + [int((total > 0).sum())], pa.int64()),
            pa.array([None] * n + [int(total.sum())], pa.int64())], schema=ANSWER)

    return add


def looked_up(left, right, bits: int):
    """Chunk and its tokens' counts: of the token, of its context, of the bigram."""
    c = Chunk(left.slice(0, 1).to_pylist()[0])
    totals = {}
    rows = sorted(zip(right["kind"].to_pylist(), right["range"].to_pylist(), right["counts"].to_pylist()), key=lambda r: r[:2])
    for kind in (UNIGRAM, BIGRAM):
        totals[kind] = np.concatenate([unpack(b, np.uint64) for k, _, b in rows if k == kind]).astype(np.float64)
    h, _, at = c.unigrams()
    word = totals[UNIGRAM][at]
    context = np.empty(len(word))
    context[1:] = word[:-1]
    context[c.first] = totals[UNIGRAM][np.searchsorted(h, END)]      # as many starts as ends
    _, _, at = c.bigrams(bits)
    return c, word, context, totals[BIGRAM][at]


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(np.maximum(context, 0))[1], BUCKETS - 1)


def deleted_histogram(bits: int, n_train: int):
    """Per chunk: how many training tokens have which deleted estimates."""

    def run(left, right):
        c, word, context, both = looked_up(left, right, bits)
        word, context, both = (x[c.train] - 1 for x in (word, context, both))
        two = np.where(context > 0, both / np.maximum(context, 1), 0.0)
        one = word / max(1, n_train - 1)
        level = lambda p: np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEPS), -1).astype(np.int64)
        key = (bucket_of(context) << 40) | ((level(two) + 1) << 20) | (level(one) + 1)
        k, n = np.unique(key, return_counts=True)
        return pa.table([pa.array(k, pa.int64()), pa.array(n, pa.int64())], names=["cell", "n"])

    return run


def learn_weights(cells: np.ndarray, n: np.ndarray, uniform: float, tolerance: float = 1e-6, max_rounds: int = 500) -> np.ndarray:
    """(BUCKETS, 3) mixture weights of bigram, unigram and uniform by EM, each
    bucket on its own; a bucket without tokens takes the weights of the next lower."""
    of = cells >> 40
    back = lambda x: np.where(x > 0, 2.0 ** (-(x - 1) / STEPS), 0.0)
    p = np.c_[back((cells >> 20) & 0xFFFFF), back(cells & 0xFFFFF), np.full(len(cells), uniform)]
    weights = np.full((BUCKETS, 3), 1 / 3)
    if len(cells):
        for _ in range(max_rounds):
            part = weights[of] * p
            part *= (n / part.sum(1))[:, None]
            now = np.stack([np.bincount(of, part[:, i], BUCKETS) for i in range(3)], 1)
            mass = now.sum(1, keepdims=True)
            now = np.where(mass > 0, now / np.maximum(mass, 1e-300), weights)
            moved = np.abs(now - weights).max()
            weights = now
            if moved < tolerance:
                break
    seen = np.bincount(of, minlength=BUCKETS) > 0 if len(cells) else np.zeros(BUCKETS, bool)
    for b in range(BUCKETS):
        if not seen[b]:
            weights[b] = weights[b - 1] if b else (0.0, 0.0, 1.0) if not seen.any() else (0.0, 0.5, 0.5)
    weights = np.maximum(weights, 1e-9)
    weights[0, 0] = 0.0                    # an unseen context has no bigram estimate
    return weights / weights.sum(1, keepdims=True)


def scores(bits: int, n_train: int, n_types: int, weights: np.ndarray, id_type: pa.DataType):
    def run(left, right):
        c, word, context, both = looked_up(left, right, bits)
        w = weights[bucket_of(context)]
        two = np.where(context > 0, both / np.maximum(context, 1), 0.0)
        p = w[:, 0] * two + w[:, 1] * word / max(1, n_train) + w[:, 2] / (n_types + 1)
        base = np.log10((word + 1) / (n_train + n_types + 1))
        m = len(c.sizes)
        return pa.table([
            pa.array(c.ids, id_type), pa.array(c.held), pa.array(c.sizes),
            pa.array(np.bincount(c.doc[word > 0], minlength=m)), pa.array(np.full(m, n_train, np.int64)),
            pa.array(np.bincount(c.doc, base, m)), pa.array(np.bincount(c.doc, np.log10(p), m))],
            names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_texts(docs: DataFrame, held, id_col: str = "doc_id", text_col: str = "text",
                chunk_tokens: int = CHUNK_TOKENS, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens,
    base_score, score. ``held`` (a Column) marks the rows not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    arrow_kind = rows.select("id").limit(0).toArrow().schema.field("id").type
    long, blob = T.LongType(), T.BinaryType()
    table = T.StructType([T.StructField("chunk", long), T.StructField("n_tokens", long), T.StructField("ids", T.ArrayType(kind)),
                          *[T.StructField(c, blob) for c in ("held", "sizes", "vocabulary", "tokens")]])
    name = f"wreath_chunks_{uuid.uuid4().hex[:12]}"
    (rows.mapInArrow(chunk_rows(arrow_kind, chunk_tokens), table).write.format("parquet")
     .option("path", shared_path(spark, "chunks")).option("compression", "zstd")
     .bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "chunk").saveAsTable(name))
    chunks = spark.table(name)
    total = chunks.agg(F.sum("n_tokens")).first()[0] or 0
    bits = min(64, 22 + max(1, int(total).bit_length()))
    ranges = {UNIGRAM: max(1, -(-total // (8 * range_entries))), BIGRAM: max(1, -(-total // range_entries))}
    asked = chunks.mapInArrow(questions(bits, ranges), "kind int, range long, chunk long, hashes binary, counts binary")
    answer_path = shared_path(spark, "answers")
    (asked.groupBy("kind", "range").applyInArrow(answers(), "kind int, range long, chunk long, counts binary, types long, tokens long")
     .write.option("compression", "zstd").parquet(answer_path))
    answered = spark.read.parquet(answer_path)
    size = answered.where((F.col("kind") == UNIGRAM) & (F.col("chunk") < 0)).agg(F.sum("types"), F.sum("tokens")).first()
    n_types, n_train = size[0] or 0, size[1] or 0
    replies = answered.where("chunk >= 0").select("chunk", "kind", "range", "counts")

    def with_counts(f, schema):
        return chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(f, schema)

    cells = with_counts(deleted_histogram(bits, n_train), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    order = np.argsort(cells["cell"].to_numpy())
    weights = learn_weights(cells["cell"].to_numpy()[order], cells["n"].to_numpy()[order].astype(float), 1 / (n_types + 1))
    out = T.StructType([T.StructField("id", kind), T.StructField("held_out", T.BooleanType()), T.StructField("n_tokens", long),
                        T.StructField("n_known", long), T.StructField("train_tokens", long),
                        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return with_counts(scores(bits, n_train, n_types, weights, arrow_kind), out)


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Contract query: base and model score of every document."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, fold("doc_id", 7) == 2).withColumnRenamed("id", "doc_id")
