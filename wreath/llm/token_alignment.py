"""Alignment of two tokenizers' tokens by diagonal run skipping (operator 13).

A text is encoded by a byte-level BPE (A, over a space and the text) and by a
sentence-piece BPE (B, which adds the space itself); special tokens' strings are plain
text. Both give the same bytes, so the byte offsets where tokens end can be compared:
where both end, the tokens are cut into groups.

The walk keeps an index into each array of ends; their difference is the shift. A
window of the arrays at the current shift is compared, and as long as all its ends
agree the window doubles, so one-to-one stretches are jumped. At the first end that
differs the irregular group is resolved locally, by advancing the array that is
behind until the ends meet, and the walk goes on with the new shift. Texts of a slice
are laid end to end and walked in lanes side by side, each from one common end
(found by binary search) to the next lane's.

An A and a B token that end together are linked. How often a pair of ids is linked in
the whole corpus comes from counts by chunk: a chunk of documents asks for each of its
pairs once, the requests are summed and joined with the sums, and the answers
meet the chunk again. So no table of pairs is broadcast, and a pair that is linked
everywhere is one row for each chunk; only the highest count of each B id, bounded by the
vocabulary, is.

Texts are encoded in units cut at a single space between two characters that are no
space, where neither tokenizer has a token that reaches across; the ids of units seen
before are looked up in a table of bounded size. Null and empty texts, and
texts whose bytes a tokenizer changes, have no tokens. Repeated rows count each. An
empty table gives no rows. Other columns are ignored. The vocabulary files are
parameters; the driver reads them and their bytes are broadcast (about 2 MB).
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.llm import textbytes as TB
from wreath.llm.common import prepare, read, stored

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
SLICE_BYTES = 1 << 20
BLOCK_CHARS = 1 << 20      # characters of a text that are cut into units at a time
UNIT_CHARS = 1 << 23       # characters of units whose ids are remembered
LANE = 128                 # tokens of A from the start of one lane to that of the next
FIRST_WINDOW, LAST_WINDOW = 4, 1 << 12
CHUNK_LINKS = 1 << 21
SEAM = re.compile(r"(?<=\S) (?=\S)")


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1
    letters stand for themselves, the others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class _Rows:
    """Lists of ids laid end to end, growing by doubling."""

    def __init__(self):
        self.flat, self.ends, self.n = np.zeros(1 << 12, np.int32), np.zeros(1, np.int64), 0

    def add(self, lists: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        new = np.fromiter(chain.from_iterable(lists), np.int32, int(sizes.sum()))
        if self.n + len(new) > len(self.flat):
            self.flat = np.r_[self.flat[: self.n], np.zeros(max(len(self.flat), 2 * len(new)), np.int32)]
        self.flat[self.n: self.n + len(new)] = new
        self.n += len(new)
        self.ends = np.r_[self.ends, self.ends[-1] + np.cumsum(sizes)]

    def take(self, rows: np.ndarray) -> np.ndarray:
        start = self.ends[rows]
        n = self.ends[rows + 1] - start
        return self.flat[np.repeat(start, n) + _ragged(n)]


class Pair:
    """The two tokenizers with the bytes of their tokens."""

    def __init__(self, a_json: bytes, b_model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # one core a task
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_json.decode())
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        self.a_bytes = [bytes(letters[c] for c in self.a.id_to_token(i)) if all(c in letters for c in self.a.id_to_token(i))
                        else self.a.id_to_token(i).encode() for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in pieces]
        self.seams = not any("▁" in p.lstrip("▁") for p in pieces)
        self.a_len = np.array([len(x) for x in self.a_bytes], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.n_names = max(len(self.a_len), len(self.b_len))
        self.names = np.array([f"{i}{s}" for s in ",|;" for i in range(self.n_names)], object)
        self.forget()

    def forget(self) -> None:
        self.units: dict[str, int] = {}
        self.unit_chars = 0
        self.a_ids, self.b_ids = _Rows(), _Rows()
        self.good = np.zeros(0, bool)

    def pieces(self, text: str) -> Iterator[str]:
        """The text in units, each without the space before it."""
        if not self.seams:
            yield text
            return
        at = 0
        while True:
            seam = SEAM.search(text, at + BLOCK_CHARS) if len(text) - at > BLOCK_CHARS else None
            if seam is None:
                yield from SEAM.split(text[at:])
                return
            yield from SEAM.split(text[at: seam.start()])
            at = seam.end()

    def learn(self, units: list[str]) -> None:
        """Encode new units and check their bytes."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]
        b = self.b.encode(units, num_threads=1)
        good = [b"".join([self.a_bytes[i] for i in x]) == (" " + u).encode() == b"".join([self.b_bytes[i] for i in y]) for u, x, y in zip(units, a, b)]
        self.a_ids.add(a)
        self.b_ids.add(b)
        self.good = np.r_[self.good, good]
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units))))
        self.unit_chars += sum(map(len, units))

    def numbers(self, text: str) -> np.ndarray:
        """Number of each unit of a text; unknown units are learned, some thousands at a time."""
        out, held = [], []

        def settle() -> None:
            new = list(dict.fromkeys(u for u in held if u not in self.units))
            if new:
                self.learn(new)
            out.append(np.fromiter(map(self.units.__getitem__, held), np.int64, len(held)))
            held.clear()

        for u in self.pieces(text):
            held.append(u)
            if len(held) >= BLOCK_CHARS // 4:
                settle()
        settle()
        return np.concatenate(out)

    def encode(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both tokenizers for each text; none where the bytes differ.

        Neither tokenizer has a token across a seam, so a text's ids are those of its units,
        and units that come again are looked up."""
        if self.unit_chars > UNIT_CHARS:
            self.forget()
        # texts of usual length are cut once; a longer one goes through numbers() block by block
        cut = [SEAM.split(t) if t and self.seams and len(t) <= BLOCK_CHARS else None for t in texts]
        new = set().union(*(units for units in cut if units)) - self.units.keys()
        if new:
            self.learn(list(new))
        a, b, none = [], [], np.zeros(0, np.int32)
        for t, units in zip(texts, cut):
            at = np.fromiter(map(self.units.__getitem__, units), np.int64, len(units)) if units else self.numbers(t) if t else np.zeros(0, np.int64)
            same = self.good[at].all()
            a.append(self.a_ids.take(at) if same else none)
            b.append(self.b_ids.take(at) if same else none)
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``"""
        if not len(a):
            return ""
        a_to, b_to = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1
        names = np.empty(len(a) + len(b), np.int64)      # in steps of n_names: followed by , or | or ;
        names[np.arange(len(a)) + np.r_[0, b_to][np.cumsum(a_cut) - a_cut]] = a + a_cut * self.n_names
        names[np.arange(len(b)) + a_to[np.cumsum(b_cut) - b_cut]] = b + b_cut * (2 * self.n_names)
        return "".join(self.names[names].tolist())[:-1]


@lru_cache(maxsize=2)
def _pair(a_json: bytes, b_model: bytes) -> Pair:
    return Pair(a_json, b_model)


def _ragged(n: np.ndarray) -> np.ndarray:
    """0 .. n[0]-1, 0 .. n[1]-1, ..."""
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)


def common_cuts(a_end: np.ndarray, b_end: np.ndarray, lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens of each side end where one of the other side ends. Both arrays rise
    strictly and have the same last value."""
    a_cut, b_cut = np.zeros(len(a_end), bool), np.zeros(len(b_end), bool)
    if not len(a_end):
        return a_cut, b_cut
    # lanes begin after common ends
    i = np.arange(lane, len(a_end), lane)
    j = np.searchsorted(b_end, a_end[i - 1])
    good = b_end[j] == a_end[i - 1]
    i, j = np.r_[0, i[good]], np.r_[0, j[good] + 1]
    i_stop, j_stop = np.r_[i[1:], len(a_end)], np.r_[j[1:], len(b_end)]
    window = np.full(len(i), FIRST_WINDOW)
    while len(i):
        n = np.minimum(window, np.minimum(i_stop - i, j_stop - j))
        t, first = _ragged(n), np.cumsum(n) - n
        at_a, at_b = np.repeat(i, n) + t, np.repeat(j, n) + t
        same = np.minimum.reduceat(np.where(a_end[at_a] == b_end[at_b], LAST_WINDOW + 1, t), first)
        run = np.minimum(same, n)                         # ends that agree at this shift
        inside = t < np.repeat(run, n)
        a_cut[at_a[inside]] = True
        b_cut[at_b[inside]] = True
        i, j = i + run, j + run
        whole = run == n
        window = np.where(whole, np.minimum(window * 2, LAST_WINDOW), FIRST_WINDOW)
        odd = np.flatnonzero(~whole)                      # irregular groups: walk to where the ends meet
        p, q, todo = i[odd], j[odd], np.arange(len(odd))
        while len(todo):
            x, y = a_end[p[todo]], b_end[q[todo]]
            todo, x, y = todo[x != y], x[x != y], y[x != y]
            p[todo] += x < y
            q[todo] += y < x
        a_cut[p] = True
        b_cut[q] = True
        i[odd], j[odd] = p + 1, q + 1
        left = i < i_stop
        i, j, i_stop, j_stop, window = i[left], j[left], i_stop[left], j_stop[left], window[left]
    return a_cut, b_cut


def aligned(pair: Pair, texts: list[str | None], lane: int = LANE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(A ids, B ids, A cuts, B cuts) of each text."""
    a, b = pair.encode(texts)
    a_all, b_all = np.concatenate([*a, np.zeros(0, np.int32)]), np.concatenate([*b, np.zeros(0, np.int32)])
    a_cut, b_cut = common_cuts(np.cumsum(pair.a_len[a_all]), np.cumsum(pair.b_len[b_all]), lane)
    i = j = 0
    for x, y in zip(a, b):
        yield x, y, a_cut[i: i + len(x)], b_cut[j: j + len(y)]
        i, j = i + len(x), j + len(y)


def _slices(batches: Iterator[pa.RecordBatch], files) -> Iterator[tuple[pa.RecordBatch, list]]:
    pair = _pair(*files.value)
    for batch in batches:
        _, offsets = TB.utf8(batch["text"])
        for i, j in TB.row_slices(offsets, SLICE_BYTES):
            part = batch.slice(i, j - i)
            yield part, list(aligned(pair, part["text"].to_pylist()))


def vocabulary_files(spark, folder: str = TOKENIZERS, a_file: str = A_FILE, b_file: str = B_FILE):
    """Broadcast bytes of both vocabularies."""
    raw = []
    for name in (a_file, b_file):
        with open(os.path.join(folder, name), "rb") as f:
            raw.append(f.read())
    return spark.sparkContext.broadcast(tuple(raw))


def align_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS) -> DataFrame:
    """(id, a_ids, b_ids, a_counts, b_counts): ids of both tokenizers, and how many of them each group takes."""
    files = vocabulary_files(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = pa.list_(pa.int32())
        for part, found in _slices(batches, files):
            sizes = [(np.diff(np.r_[-1, np.flatnonzero(f[2])]), np.diff(np.r_[-1, np.flatnonzero(f[3])])) for f in found]
            yield pa.RecordBatch.from_arrays([part["id"], pa.array([f[0] for f in found], ints), pa.array([f[1] for f in found], ints),
                                              pa.array([s[0].astype(np.int32) for s in sizes], ints), pa.array([s[1].astype(np.int32) for s in sizes], ints)],
                                             ["id", "a_ids", "b_ids", "a_counts", "b_counts"])

    return rows.mapInArrow(run, f"id {id_type}, a_ids array<int>, b_ids array<int>, a_counts array<int>, b_counts array<int>")


def linked_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str = TOKENIZERS,
                     chunk_links: int = CHUNK_LINKS) -> DataFrame:
    """Stored (id, n_a, n_b, n_groups, groups_sha256, links, chunk); links: A id * 65536 + B id of each
    common end as little-endian 32-bit numbers, chunk: documents of about ``chunk_links`` links."""
    files = vocabulary_files(docs.sparkSession, folder)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        pair = _pair(*files.value)
        for part, found in _slices(batches, files):
            out = []
            for a, b, a_cut, b_cut in found:
                links = a[a_cut].astype("<u4") << np.uint32(16) | b[b_cut].astype("<u4")
                text = pair.groups(a, b, a_cut, b_cut)
                if held and held + len(links) > chunk_links:
                    chunk, held = chunk + 1, 0
                held += len(links)
                out.append((len(a), len(b), len(links), hashlib.sha256(text.encode()).hexdigest() if text else "", links.tobytes(), chunk))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([part["id"], *(pa.array([o[k] for o in out], t) for k, t in enumerate(types))],
                                             ["id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "chunk"])

    return stored(rows.mapInArrow(run, f"id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, chunk long"),
                  "links", compression="zstd")


def _links(column) -> tuple[np.ndarray, np.ndarray]:
    """(all links, first link of each row and the end) of a binary column."""
    data, offsets = TB.utf8(column.cast(pa.large_binary()))
    return np.ascontiguousarray(data).view("<u4"), offsets // 4


def _requests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's pairs with their number of links."""
    chunk, held = None, []

    def rows() -> pa.RecordBatch:
        pairs, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), chunk, np.int64)), pa.array(pairs.astype(np.int64)), pa.array(n.astype(np.int64))],
                                          ["chunk", "pair", "n"])

    for batch in batches:
        if not batch.num_rows:
            continue
        links, offsets = _links(batch["links"])
        chunks = batch["chunk"].to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, chunks[1:] != chunks[:-1]])
        for a, b in zip(starts, np.r_[starts[1:], len(chunks)]):
            if held and chunk != chunks[a]:
                yield rows()
                held = []
            chunk = int(chunks[a])
            held.append(links[offsets[a]: offsets[b]].copy())
    if held:
        yield rows()


def _answered(docs: pa.Table, answers: pa.Table) -> pa.Table:
    """Counts of a chunk's links from the answers to its requests."""
    docs = docs.combine_chunks()
    links, offsets = _links(docs["links"].combine_chunks()) if docs.num_rows else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
    pairs, first = np.unique(answers["pair"].to_numpy().astype(np.uint32), return_index=True)
    total, best = answers["total"].to_numpy()[first], answers["best"].to_numpy(zero_copy_only=False)[first]
    at = np.searchsorted(pairs, links)
    sums, bests = (np.r_[0, np.cumsum(x[at].astype(np.int64))] if len(at) else np.zeros(1, np.int64) for x in (total, best))
    ends = offsets if len(at) else np.zeros(docs.num_rows + 1, np.int64)
    return docs.select(["id", "n_a", "n_b", "n_groups", "groups_sha256"]).append_column(
        "n_best", pa.array(np.diff(bests[ends]))).append_column("count_sum", pa.array(np.diff(sums[ends])))


def counted_links(linked: DataFrame) -> DataFrame:
    """(id, n_a, n_b, n_groups, groups_sha256, n_best, count_sum) for :func:`linked_documents`."""
    asked = stored(linked.select("chunk", "links").mapInArrow(_requests, "chunk long, pair long, n long"), "requests")
    totals = stored(asked.groupBy("pair").agg(F.sum("n").alias("total")), "totals")
    b_id = F.col("pair").bitwiseAND(0xFFFF).alias("b")
    highest = totals.groupBy(b_id).agg(F.max("total").alias("highest"))      # a row for each B id at most
    told = totals.withColumn("b", b_id).join(F.broadcast(highest), "b").select("pair", "total", (F.col("total") == F.col("highest")).alias("best"))
    answers = asked.select("chunk", "pair").join(told, "pair").select("chunk", "pair", "total", "best")
    id_type = linked.schema["id"].dataType.simpleString()
    return linked.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(
        _answered, f"id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, n_best long, count_sum long")


def op13_token_alignment(spark, sf_dir: str) -> DataFrame:
    """Contract query: tokens, groups and link counts of every document."""
    prepare(spark)
    found = counted_links(linked_documents(read(spark, sf_dir, "documents")))
    return found.select(F.col("id").cast("long").alias("doc_id"), "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"),
                        "n_best", "count_sum", "groups_sha256")
