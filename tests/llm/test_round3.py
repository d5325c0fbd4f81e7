"""Line dedup, conversation repair and token alignment against brute force, with the
odd shapes: nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns with clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from wreath.llm import conversation_repair as CR
from wreath.llm import line_dedup as LD
from wreath.llm import token_alignment as TA
from wreath.llm.common import prepare

SF = "/root/testdata/sf0.001"
WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def spark(spark):
    return prepare(spark)


@pytest.fixture(params=[1, 7])
def ranges(spark, request):
    """The same jobs over one range and over several."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", request.param)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.set("spark.sql.shuffle.partitions", before)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# --- operator 11 -----------------------------------------------------------

def brute_lines(texts, min_docs, min_chars=1, keep_first=False):
    """Kept flags of each text's lines; texts in the order that counts."""
    keys = [[low(x.strip(WHITE)) for x in (t or "").split("\n")] for t in texts]
    n = Counter(k for ks in keys for k in set(ks))
    seen, out = set(), []
    for ks in keys:
        row = []
        for k in ks:
            often = len(k) >= min_chars and n[k] >= min_docs
            row.append(not often or (keep_first and k not in seen))
            seen.add(k)
        out.append(row)
    return out


LINES = ["Menu", " menu\t", "MENU", "a", "b", "", "  ", "Ünï", "ÜNÏ", "same line", "other line", "x" * 40]


@pytest.fixture(scope="module")
def line_docs(spark):
    rng = random.Random(5)
    texts = [None, "", "\n", "\n\n", "menu", "\nmenu\n", "no other line like this", "menu\n" * 500, "tail\n" + "z\n" * 300]
    texts += ["\n".join(rng.choice(LINES) for _ in range(rng.randrange(1, 9))) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    names = ["uid", "id", "pos", "h1", "keep", "n_lines", "positions", "n_dropped", "part", "first"]
    return rows, df.select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])


@pytest.mark.parametrize("min_docs, min_chars, keep_first", [(10, 1, False), (2, 3, False), (2, 1, True), (40, 1, True), (1, 1, False)])
def test_line_bitmaps_equal_brute_force(line_docs, ranges, min_docs, min_chars, keep_first):
    rows, df = line_docs
    got = LD.dedup_lines(df, min_docs=min_docs, min_chars=min_chars, keep_first=keep_first).collect()
    want = brute_lines([t for _, t in rows], min_docs, min_chars, keep_first)
    assert sorted(r["id"] for r in got) == [i for i, _ in rows]
    for r in got:
        keep = want[r["id"]]
        assert r["n_lines"] == len(keep) and r["n_dropped"] == keep.count(False)
        assert LD.decode_bitmap(r["keep"], r["n_lines"]).tolist() == keep


def test_line_key_over_many_ranges(spark, ranges):
    """One key holds nearly all lines, so its lines fill several ranges; the others stand at borders."""
    rows = [(i, "HOT\n" * 40 + f"own {i % 13}\nhot") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_docs, keep_first in ((60, False), (61, False), (4, True)):
        want = brute_lines([t for _, t in rows], min_docs, 1, keep_first)
        got = {r["id"]: LD.decode_bitmap(r["keep"], r["n_lines"]).tolist() for r in LD.dedup_lines(df, min_docs=min_docs, keep_first=keep_first).collect()}
        assert got == {i: w for i, w in enumerate(want)}


def test_line_dedup_odd_rows(spark):
    rows = [(None, "x\ny"), (None, "x\ny"), (3, "x"), (3, "x"), (4, None)]
    got = LD.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=4).collect()
    assert sorted((r["id"] or 0, r["n_lines"], r["n_dropped"]) for r in got) == [(0, 2, 1), (0, 2, 1), (3, 1, 1), (3, 1, 1), (4, 1, 0)]
    empty = spark.createDataFrame([], "doc_id string, text string")
    assert LD.dedup_lines(empty).collect() == []


def test_line_blocks_and_pieces():
    raw = b"aa\nbb\n\ncc" * 50
    for block in (1, 3, 7, 1000):
        assert sum(LD.line_blocks(raw, block), []) == raw.split(b"\n")
    keep = [i % 3 > 0 for i in range(len(raw.split(b"\n")))]
    bitmap = LD.encode_bitmap([i for i, k in enumerate(keep) if not k], len(keep))
    want = b"\n".join(x for x, k in zip(raw.split(b"\n"), keep) if k)
    assert b"".join(LD.kept_lines(raw, bitmap, len(keep))) == want
    assert b"".join(LD.kept_lines(raw, None, len(keep))) == raw


def test_line_query_on_extremes(spark, line_docs, tmp_path):
    rows, df = line_docs
    df.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in LD.op11_line_dedup(spark, str(tmp_path)).collect()}
    for (i, t), keep in zip(rows, brute_lines([t for _, t in rows], 10)):
        kept = "\n".join(x for x, k in zip((t or "").split("\n"), keep) if k)
        assert (got[i]["n_lines"], got[i]["n_dropped"], got[i]["kept_sha256"]) == (len(keep), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())


# --- operator 12 -----------------------------------------------------------

def brute_edits(codes):
    """All cheapest edits by exhaustive search over a bounded number of inserts: the least (cost, edits)."""
    best = {(0, "s0"): (0, "")}
    # uniform-cost search over (turns passed, last role), with whole edits as tie-break
    import heapq
    heap, done = [(0, "", 0, 0)], {}
    while heap:
        cost, edits, at, state = heapq.heappop(heap)
        if (at, state) in done:
            continue
        done[at, state] = True
        if at == len(codes) and state in (0, 3):
            return cost, edits
        for e in "IDKR":
            if e == "I":
                heapq.heappush(heap, (cost + 5, edits + "I", at, 3 if state == 2 else 2))
            elif at < len(codes):
                c = codes[at]
                if e == "D":
                    heapq.heappush(heap, (cost + 2, edits + "D", at + 1, state))
                elif not c & (CR.BLANK | CR.DUPLICATE):
                    more, kind = (5 if c & CR.TRUNCATED else 0), c & 3
                    if e == "K" and (kind == 1 and state == 0 or kind == 2 and state in (0, 1, 3) or kind == 3 and state == 2):
                        heapq.heappush(heap, (cost + more, edits + "K", at + 1, kind))
                    if e == "R":
                        heapq.heappush(heap, (cost + more + 1, edits + "R", at + 1, 3 if state == 2 else 2))


def all_codes(rng, n):
    return bytes(rng.choice([0, 1, 2, 3]) + rng.choice([0, 0, 0, CR.TRUNCATED, CR.BLANK]) + rng.choice([0, 0, 0, CR.DUPLICATE]) for _ in range(n))


def test_hirschberg_equals_search():
    rng = random.Random(1)
    cases = [bytes(c) for n in range(4) for c in itertools.product([0, 1, 2, 3, 5, 6, 7, 8], repeat=n)]
    cases += [all_codes(rng, rng.randrange(4, 30)) for _ in range(400)]
    for codes in cases:
        cost, edits = brute_edits(codes)
        got = CR.hirschberg(codes)
        assert (CR.edit_cost(codes, got), got) == (cost, edits), codes


def test_borders_equal_whole_solution():
    rng = random.Random(2)
    for _ in range(300):
        codes = all_codes(rng, rng.randrange(1, 40))
        cuts = sorted(rng.sample(range(1, len(codes)), min(len(codes) - 1, rng.randrange(0, 5))))
        runs = [codes[a:b] for a, b in zip([0, *cuts], [*cuts, len(codes)])]
        states = CR.border_states([CR.transfer(r) for r in runs])
        edits = "".join(CR.hirschberg(r, b, e) for r, b, e in zip(runs, [0, *states], [*states[:-1], None]))
        assert edits == CR.hirschberg(codes)


def test_hirschberg_long():
    rng = random.Random(3)
    codes = all_codes(rng, 20_000)
    assert CR.hirschberg(codes) == brute_edits(codes)[1]


def brute_conversation(rows):
    """Contract columns from the damaged rows (turn, role, text) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = [r[0] for r in rows if r[0] is not None]
    codes, seen, counts = [], set(), Counter()
    for _, role, text in rows:
        s = text.strip(WHITE)
        code = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
        if not s:
            code, fault = code | CR.BLANK, "blank"
        elif (role, text) in seen:
            code, fault = code | CR.DUPLICATE, "duplicate"
        elif s[-1] not in ".!?":
            code, fault = code | CR.TRUNCATED, "truncated"
        else:
            fault = ""
        counts[fault] += 1
        seen.add((role, text))
        codes.append(code)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = brute_edits(bytes(codes))
    out, at, state = [], 0, 0
    for e in audit:
        if e in "IR":
            state = 3 if state == 2 else 2
            out.append(("user:" if state == 2 else "assistant:") + ("" if e == "I" else rows[at][2]))
        elif e == "K":
            state = codes[at] & 3
            out.append(f"{rows[at][1]}:{rows[at][2]}")
        at += e != "I"
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def brute_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if f:
            role, text = "user" if f == 4 else role, "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            out[conv] += [(turn, role, text)] * (2 if f == 3 else 1)
    return out


CONV = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", None, "", "s", "User"]
    texts = ["Hello.", "What?", "cut off", None, "", " \n", "Yes!", "ünï 漢字.", "word " * 3_000 + "end."]
    rows = [(c, rng.choice([None, *range(8)]) if rng.random() < 0.2 else t, rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts) if rng.random() < 0.5 else f"turn {t} of {c}.")
            for c in range(40) for t in range(rng.randrange(0, 9))]
    rows += [(None, rng.randrange(40) or None, rng.choice(roles), rng.choice(texts)) for _ in range(150)]       # one long conversation, many ties
    rows += [(99, t, rng.choice(roles[:3]), f"t{t % 50}{rng.choice('. ')}") for t in range(1_200)]
    rows += [(77, 1, "user", "Again.")] * 30
    return rows


def test_repair_equals_brute_force(spark, talks, ranges, tmp_path):
    df = spark.createDataFrame(talks, CONV).withColumns({n: F.lit(1) for n in ("key", "seq", "mark", "code", "part", "h", "uid", "n", "s")})
    df.repartition(6).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: tuple(r)[1:] for r in CR.op12_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: brute_conversation(rows) for c, rows in brute_damage(talks).items()}
    assert got == want


def test_repaired_turns_are_well_formed(spark, talks):
    rows = CR.ordered_turns(spark.createDataFrame(talks, CONV))
    runs = CR.solved_runs(rows)
    by_key = {}
    for r in CR.repaired_turns(rows, runs).orderBy("key", "seq", "nth").collect():
        by_key.setdefault(r["key"], []).append(r)
    assert len(by_key) == len({r[0] for r in talks})
    audits = {r["key"]: r["audit"] for r in CR.reports(rows, runs).collect()}
    for key, edits in by_key.items():
        assert "".join(e["edit"] for e in edits) == audits[key]
        assert re.fullmatch("(s?(ua)+)?", "".join(e["role"][0] for e in edits if e["edit"] != "D"))
        assert all(e["text"] == "" and e["turn"] is None for e in edits if e["edit"] == "I")


def test_repair_empty(spark, tmp_path):
    spark.createDataFrame([], CONV).write.parquet(f"{tmp_path}/conversations.parquet")
    assert CR.op12_conversation_repair(spark, str(tmp_path)).collect() == []


# --- operator 13 -----------------------------------------------------------

@pytest.fixture(scope="module")
def pair(spark):
    return TA._pair(*TA.vocabulary_files(spark).value)


def brute_alignment(pair, text):
    """(A ids, B ids, groups as text, links) from the two encodings and sets of ends."""
    if not text:
        return [], [], "", []
    a = pair.a.encode(" " + text, add_special_tokens=False).ids
    b = pair.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(pair.a_bytes[i] for i in a) != raw or b"".join(pair.b_bytes[i] for i in b) != raw:
        return [], [], "", []
    a_end = list(itertools.accumulate(len(pair.a_bytes[i]) for i in a))
    b_end = list(itertools.accumulate(len(pair.b_bytes[i]) for i in b))
    both = sorted(set(a_end) & set(b_end))
    groups, links, p = [], [], 0
    for e in both:
        groups.append(",".join(str(i) for i, x in zip(a, a_end) if p < x <= e) + "|" + ",".join(str(i) for i, x in zip(b, b_end) if p < x <= e))
        links.append((a[a_end.index(e)], b[b_end.index(e)]))
        p = e
    return a, b, ";".join(groups), links


TEXTS = [None, "", " ", "  two  spaces ", "Hello world", "Hello world", "naïve café — résumé", "漢字かな交じり文", "🙂🙃 emoji 👩‍👩‍👧", "<|endoftext|> and <s> </s> <unk>",
         "a literal <0x41> piece", "a real ▁ mark", "tabs\tand\nlines\r\n", "\x00nul", "x" * 3_000, "don't can't we'll", "1234567890 3.14159", "supercalifragilistic " * 200,
         "é combining", " no-break", "ﬁ ligature", "﻿bom", "mixed漢字word and МОСКВА"]


@pytest.mark.parametrize("lane", [1, 3, 128])
def test_cuts_equal_common_ends(lane):
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 400))
        a, b = (np.unique(np.r_[rng.choice(n, int(rng.integers(0, n)), replace=False) + 1, n]) for _ in range(2))
        a_cut, b_cut = TA.common_cuts(a, b, lane)
        assert (a_cut == np.isin(a, b)).all() and (b_cut == np.isin(b, a)).all()


def test_alignment_equals_brute_force(spark, pair):
    for text, (a, b, a_cut, b_cut) in zip(TEXTS, TA.aligned(pair, TEXTS)):
        want = brute_alignment(pair, text)
        assert (a.tolist(), b.tolist(), pair.groups(a, b, a_cut, b_cut), list(zip(a[a_cut].tolist(), b[b_cut].tolist()))) == want, text


def test_long_text_in_pieces(pair):
    rng = random.Random(0)
    text = " ".join(rng.choice(["alpha", "Beta7", "  gap", "naïve", "x,y", "漢字", "end.\n"]) for _ in range(60_000))
    assert len(list(pair.pieces(text))) > 3 and " ".join(pair.pieces(text)) == text
    a, b = (x[0].tolist() for x in pair.encode([text]))
    assert a == pair.a.encode(" " + text, add_special_tokens=False).ids and b == pair.b.encode(text)


def brute_counts(pair, texts):
    found = [brute_alignment(pair, t) for t in texts]
    n = Counter(x for f in found for x in f[3])
    top = {}
    for (_, b), c in n.items():
        top[b] = max(top.get(b, 0), c)
    return [(len(a), len(b), len(links), len(links), sum(n[x] == top[x[1]] for x in links), sum(n[x] for x in links),
             hashlib.sha256(g.encode()).hexdigest() if g else "") for a, b, g, links in found]


@pytest.mark.parametrize("chunk_links", [1, 40, TA.CHUNK_LINKS])
def test_link_counts_equal_brute_force(spark, pair, chunk_links):
    texts = TEXTS + ["Hello world"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    df = df.select("*", *[F.lit(0).alias(n) for n in ("id", "links", "chunk", "pair", "n", "n_a", "best")])
    got = {r["id"]: r for r in TA.counted_links(TA.linked_documents(df, chunk_links=chunk_links)).collect()}
    for i, w in enumerate(brute_counts(pair, texts)):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_groups"], r["n_best"], r["count_sum"], r["groups_sha256"]) == w


def test_alignment_query_on_the_table(spark, pair):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: tuple(r)[1:] for r in TA.op13_token_alignment(spark, SF).collect()}
    assert got == {r["doc_id"]: w for r, w in zip(rows, brute_counts(pair, [r["text"] for r in rows]))}


def test_align_tokens_counts(spark, pair):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "doc_id string, text string")
    for r in TA.align_tokens(df).collect():
        assert sum(r["a_counts"]) == len(r["a_ids"]) and sum(r["b_counts"]) == len(r["b_ids"]) and len(r["a_counts"]) == len(r["b_counts"])
        assert b"".join(pair.a_bytes[i] for i in r["a_ids"]) == b"".join(pair.b_bytes[i] for i in r["b_ids"])


def test_alignment_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert TA.counted_links(TA.linked_documents(empty)).collect() == []


# --- operator 8: given targets and clashing columns; labels with both values -----

MIX = "doc_id long, text string, lang string, source string, n_chars long"


def test_given_targets(spark):
    from wreath.llm import raking as RK

    words = lambda n: " ".join(["w"] * n)          # noqa: E731
    rows = [(i, words(10 + i % 5), "en", "a" if i % 4 else "b", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, MIX)
    axes = {"source": F.col("source")}
    to = lambda *rs: {"source": spark.createDataFrame(list(rs), "source string, share double")}
    got = {(r["m"]["source"], r["m"]["probability"]) for r in RK.mixing_probabilities(docs, axes=axes, targets=to(("a", 0.5), ("b", 0.5)), out_col="m").select("m").collect()}
    tokens = Counter()
    for _, t, _, s, _ in rows:
        tokens[s] += len(t.split())
    assert {s for s, _ in got} == {"a", "b"} and dict(got)["b"] == 1.0
    assert abs(dict(got)["a"] - tokens["b"] / tokens["a"]) < 1e-3
    only = RK.mixing_probabilities(docs, axes=axes, targets=to(("a", 1.0), ("b", 0.0)), out_col="m").groupBy("source").agg(F.max("m.kept").alias("k")).collect()
    assert {r["source"]: r["k"] for r in only} == {"a": True, "b": False}
    for bad in (to(("a", 1.0)), to(("a", 0.5), ("b", 0.4)), to(("a", 0.5), ("b", 0.25), ("c", 0.25)), to(("a", 0.5), ("a", 0.5)), to(("a", 1.5), ("b", -0.5))):
        with pytest.raises(ValueError):
            RK.mixing_probabilities(docs, axes=axes, targets=bad)


def test_mixing_keeps_columns_of_any_name(spark):
    from wreath.llm import raking as RK

    names = ["__source", "__mix", "__p", "__toxicity", "row", "mix", "cell", "chance", "p", "of", "a.b"]
    docs = spark.createDataFrame([(i, "some words here", "en", "a", 1) for i in range(20)], MIX).select("*", *[F.lit(i).alias(n) for i, n in enumerate(names)])
    kept = RK.mix_sources(docs)
    assert kept.columns == docs.columns and [r["__mix"] for r in kept.limit(1).collect()] == [1]
    with pytest.raises(ValueError):
        RK.mixing_probabilities(docs)


def test_conflicting_labels_do_not_depend_on_partitions(spark):
    from wreath.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, "text") for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i in range(200) for y in ((0, 1) if i % 2 else (1,))], "doc_id long, toxic int")
    found = set()
    for parts in (1, 3, 7):
        sample, count, _ = labelled_sample(docs, labels.repartition(parts), "doc_id", "text", "toxic", 10_000, 0)
        found.add((tuple(sorted(count.items())), tuple(sorted((r["__id"], r["__y"]) for r in sample.collect()))))
    assert len(found) == 1 and next(iter(found))[0] == ((0, 100), (1, 100))
