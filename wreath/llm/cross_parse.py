"""Language identification by cross-parsing (operator 7).

For each language a suffix automaton is built from labelled text. A text is
parsed greedily against it: from the current position take the longest piece
that occurs anywhere in the language's text, start the next phrase behind it, and
count. The phrases per byte estimate the cross-entropy; the language that needs
the fewest, normalised by what it needs for its own held-back text, wins.

Letters are lower-cased by Spark; every ASCII byte that is no letter counts as a
space, and runs of spaces as one. Texts are parsed in pieces of ``PIECE`` bytes
side by side, against all languages at once, so a very long text takes no longer
than many short ones; a phrase also ends with its piece.

Null text or text without a letter gives ``und`` and score 0; with no labelled
text every row is ``und``. Rows are judged one by one, repeated ones alike, and
ties go to the first language by name. Other columns pass through.

Every language value is learned. Bounds: ``max_bytes`` of labelled text per language,
drawn in pieces of ``SAMPLE_PIECE`` characters by a hash of id and piece number, and
``total_bytes`` of all languages together: with many of them each has an equal part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import fold, prepare, read, unit_hash

PIECE = 512
SAMPLE_PIECE = 500
UNKNOWN = "und"

#: bytes after Spark's lower(): letters and all non-ASCII bytes stay, the rest is a space
_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[65:91] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def cleaned(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with single spaces between words, and the new offsets."""
    b = _CLEAN[data]
    if not len(b):
        return b, offsets - offsets[0]
    space = b == 32
    keep = np.ones(len(b), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    edges = offsets[:-1][offsets[:-1] < len(b)]
    keep[edges] = ~space[edges]
    total = np.append(0, np.cumsum(keep))
    return b[keep], total[offsets]


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the automaton of all pieces of ``text``; state 0 is the
    start. A path exists exactly for the pieces that occur."""
    following: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in text:
        cur = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in following[p]:
            following[p][c] = cur
            p = link[p]
        if p >= 0:
            q = following[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                twin = len(following)
                following.append(following[q].copy())
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(c) == q:
                    following[p][c] = twin
                    p = link[p]
                link[q] = link[cur] = twin
        last = cur
    return following


class CrossParser:
    """Automata of all languages in one transition table.

    ``table[state * letters + letter]`` is the next state's row, or -1; letters
    that no language has are letter 0, which never continues a phrase."""

    def __init__(self, texts: dict[str, bytes]):
        self.langs = sorted(texts)
        seen = np.zeros(256, bool)
        for t in texts.values():
            seen[np.frombuffer(t, np.uint8)] = True
        self.letter = np.zeros(256, np.int32)
        self.letter[seen] = np.arange(1, seen.sum() + 1)
        self.letters = int(seen.sum()) + 1
        self.start, parts, size = [], [], 0
        for lang in self.langs:
            moves = suffix_automaton(texts[lang])
            t = np.full((len(moves), self.letters), -1, np.int32)
            n = np.fromiter(map(len, moves), np.int64, len(moves))
            t[np.repeat(np.arange(len(moves)), n),
              self.letter[np.fromiter((c for m in moves for c in m), np.int64, n.sum())]] = (
                np.fromiter((s for m in moves for s in m.values()), np.int64, n.sum()) + size) * self.letters
            self.start.append(size * self.letters)
            size += len(moves)
            parts.append(t)
        self.table = np.concatenate(parts).ravel() if parts else np.zeros(0, np.int32)
        self.norm = np.ones(len(self.langs))

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        n, m = len(offsets) - 1, len(self.langs)
        size = np.diff(offsets)
        count = -(-size // PIECE)
        row = np.repeat(np.arange(n), count)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        begin = offsets[:-1][row] + nth * PIECE
        length = np.minimum(size[row] - nth * PIECE, PIECE)
        order = np.argsort(-length, kind="stable")
        begin, length, row = begin[order], length[order], row[order]
        letters = self.letter[data]
        starts = np.array(self.start, np.int32)
        state = np.tile(starts, (len(row), 1))
        total = np.zeros((len(row), m), np.int32)
        alive = np.searchsorted(-length, -np.arange(1, PIECE + 1), side="right")
        for k in range(int(length[0]) if len(length) else 0):
            a = alive[k]
            c = letters[begin[:a] + k][:, None]
            step = self.table[state[:a] + c]
            cut = step < 0
            total[:a] += cut
            again = np.maximum(self.table[starts + c], starts)      # an unknown letter stays at the start
            state[:a] = np.where(cut, again, step)
        out = np.zeros((n, m))
        for i in range(m):
            out[:, i] = np.bincount(row, total[:, i] + 1, n)
        return out

    def judge(self, column) -> tuple[np.ndarray, np.ndarray]:
        """(index of the language, score) of each text."""
        data, offsets = TB.utf8(column)
        best, score = np.zeros(len(column), np.int64), np.zeros(len(column))
        for i, j in TB.row_slices(offsets, 2 << 20):
            d, off = cleaned(data[offsets[i]: offsets[j]], offsets[i: j + 1] - offsets[i])
            rate = self.phrases(d, off) / np.maximum(np.diff(off), 1)[:, None] / self.norm
            best[i:j] = rate.argmin(1)
            odds = np.exp(-12 * (rate / np.maximum(rate.min(1, keepdims=True), 1e-9) - 1))
            score[i:j] = odds.max(1) / odds.sum(1)
        return best, score


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        max_bytes: int = 60_000, total_bytes: int = 480_000, seed: int = 7) -> CrossParser:
    """Build the automata from labelled rows (``docs`` is already restricted to
    them). At most ``max_bytes`` per language come to the driver: pieces of a
    hash-drawn sample; a tenth of them is held back to normalise the counts."""
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("__id"), F.col(lang_col).cast("string").alias("__l"), F.lower(text_col).alias("__t"))
    sizes = labelled.groupBy("__l").agg(F.sum(F.length("__t")).alias("n")).where("n > 0").collect()
    if not sizes:
        return CrossParser({})
    max_bytes = min(max_bytes, max(1, total_bytes // len(sizes)))
    # draw about twice the bound, twenty pieces at least, then cut each language at the bound
    shares = docs.sparkSession.createDataFrame(
        [(r["__l"], min(1.0, max(2 * max_bytes, 20 * SAMPLE_PIECE) / r["n"])) for r in sizes], "__l string, __share double")
    drawn = (labelled.join(F.broadcast(shares), "__l").select(
        "__id", "__l", "__share", "__t", F.explode(F.expr("filter(sequence(0, cast(ceil(length(__t) / %d) as int)), i -> "
        "cast(shiftrightunsigned(xxhash64(__id, i, %d), 11) as double) / %d < __share and i * %d < length(__t))" % (
            SAMPLE_PIECE, seed, 1 << 53, SAMPLE_PIECE))).alias("__i"))
        .select("__l", F.xxhash64("__id", "__i").alias("__h"), F.expr(f"substring(__t, __i * {SAMPLE_PIECE} + 1, {SAMPLE_PIECE})").alias("__p")))
    texts, held = {}, {}
    by_lang: dict[str, list[tuple[int, str]]] = {}
    for r in drawn.toArrow().to_pylist():
        by_lang.setdefault(r["__l"], []).append((r["__h"], r["__p"]))
    for lang, found in by_lang.items():
        found.sort()
        joined = [p.encode() for _, p in found]
        raw, off = cleaned(np.frombuffer(b"".join(joined), np.uint8), np.append(0, np.cumsum([len(p) for p in joined])))
        parts = [raw[a:b].tobytes() for a, b in zip(off[:-1], off[1:])]
        keep = max(1, min(len(parts) - len(parts) // 10, int(np.searchsorted(np.cumsum([len(p) for p in parts]), max_bytes)) or 1))
        texts[lang] = b" ".join(parts[:keep])[:max_bytes]
        held[lang] = parts[keep:] or parts
    parser = CrossParser(texts)
    for i, lang in enumerate(parser.langs):
        raw = np.frombuffer(b"".join(held[lang]), np.uint8)
        off = np.append(0, np.cumsum([len(p) for p in held[lang]]))
        if len(raw):
            parser.norm[i] = parser.phrases(raw, off)[:, i].sum() / len(raw)
    if len(parser.norm):
        parser.norm /= parser.norm.mean()
    return parser


def language_udf(spark, parser: CrossParser):
    """Column function lower-cased text -> struct(lang, score). The broadcast
    table is bounded by languages x max_bytes x letters."""
    shared = spark.sparkContext.broadcast(parser)

    @F.arrow_udf("struct<lang:string,score:double>")
    def language(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        names = pa.array(shared.value.langs, pa.string())
        for column in texts:
            best, score = shared.value.judge(column)
            yield pa.StructArray.from_arrays([names.take(pa.array(best)), pa.array(score)], ["lang", "score"])

    return language


def identify(docs: DataFrame, parser: CrossParser, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column (lang, score)."""
    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"))
    if not parser.langs:
        return docs.withColumn(out_col, nothing)
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return docs.withColumn(out_col, F.when(has_letter, language_udf(docs.sparkSession, parser)(F.lower(text_col))).otherwise(nothing))


def op7_language(spark, sf_dir: str) -> DataFrame:
    """Contract query: language and score of every document."""
    prepare(spark)
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = fold("doc_id", 4) == 2
    found = identify(docs.select("doc_id", "text"), fit(docs.where(~held)), out_col="l")
    return found.select("doc_id", held.alias("held_out"), F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"))
