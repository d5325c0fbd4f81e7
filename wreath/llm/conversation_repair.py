"""Conversation structure repair by divide and conquer (operator 12).

Turns are edited so that the roles' initials read ``(s?(ua)+)?``: Keep costs 0,
Rerole to user or assistant 1, Delete 2, Insert of an empty user or assistant turn 5;
a truncated turn that is not deleted costs 5 more; blank turns and repeats of an
earlier turn must be deleted. Of the cheapest edits those whose initials come
first as text are taken.

A conversation is in one of four states: nothing yet, after the system turn, after a
user, after an assistant turn. Cost vectors over these states run forward from the
beginning and backward from the end and meet in the middle (Hirschberg); of the
crossings with the least sum the one whose edits come first is taken, and both
halves are solved the same way, so no table of all turns is kept. A forward
vector holds, beside the costs, the order of the best edits of its states: edits of
equally many turns that end with a turn are never prefixes of each other, so the
order of the states is that of the whole edits.

Rows are sorted by (conversation, turn, role, text) in ranges, also between ranges.
Each conversation gives one run of one-byte codes in every range it touches. A run
that is a whole conversation is solved by itself; the others, two a range at most,
send their 4 x 4 costs to the driver, which picks the states at the borders. So a
conversation with a third of all rows is solved by many tasks.

Order: turn (null first), role, first characters of the text, its hash. Null role or
text counts as one space. Repeated rows are turns of their own (all but the first
are duplicates). Rows without a conversation id form one conversation. Very long
texts are never compared, only their hashes. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wreath.llm.common import join_groups, prepare, read, stored

WHITE = " \t\n\x0b\x0c\r"
HEAD = 128                       # characters of a text that order tied turns
START, SYSTEM, USER, ASSISTANT = range(4)
DELETE_COST, REROLE_COST, INSERT_COST, TRUNCATED_COST = 2, 1, 5, 5
#: code of a turn: class of its role, and bits
OTHER_ROLE, TRUNCATED, BLANK, DUPLICATE = 0, 4, 8, 16
#: class of a role: the state that keeping it leads to; 0 for other roles
CLASSES = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}     # what an insert or a new role makes
KEEPS = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: useful numbers of inserts in a row and the state after them; more would come back to a state reached before
INSERTS = {START: ((0, START), (1, USER), (2, ASSISTANT)), SYSTEM: ((0, SYSTEM), (1, USER), (2, ASSISTANT)),
           USER: ((0, USER), (1, ASSISTANT)), ASSISTANT: ((0, ASSISTANT), (1, USER))}
#: cost of ending the conversation in each state: the inserts that complete it
ACCEPT = (0, 2 * INSERT_COST, INSERT_COST, 0)
ENDINGS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
ROLE = {USER: "user", ASSISTANT: "assistant"}


@lru_cache(maxsize=None)
def moves(code: int, state: int) -> tuple[tuple[int, str, int], ...]:
    """(cost, edits, next state) of passing one turn, inserts before it included."""
    out = []
    for n, at in INSERTS[state]:
        before, cost = "I" * n, n * INSERT_COST
        out.append((cost + DELETE_COST, before + "D", at))
        if code & (BLANK | DUPLICATE):
            continue
        extra = TRUNCATED_COST if code & TRUNCATED else 0
        if (at, code & 3) in KEEPS:
            out.append((cost + extra, before + "K", code & 3))
        out.append((cost + extra + REROLE_COST, before + "R", NEXT[at]))
    return tuple(out)


def _normal(costs) -> tuple[tuple, float]:
    least = min(costs)
    return (tuple(costs), 0) if least == math.inf else (tuple(c - least for c in costs), least)


@lru_cache(maxsize=1 << 16)
def _forward(vector: tuple, code: int) -> tuple[tuple, float]:
    """((costs, ranks) after a turn, what was taken off the costs). Vectors repeat, since
    their differences are bounded, so a step is mostly a look-up."""
    costs, ranks = vector
    best: dict[int, tuple] = {}
    for state in range(4):
        if costs[state] == math.inf:
            continue
        for cost, edits, then in moves(code, state):
            found = (costs[state] + cost, ranks[state], edits)
            if then not in best or found < best[then]:
                best[then] = found
    order = sorted(best, key=lambda s: best[s][1:])
    least = min(b[0] for b in best.values())
    return (tuple(best[s][0] - least if s in best else math.inf for s in range(4)),
            tuple(order.index(s) if s in best else -1 for s in range(4))), least


@lru_cache(maxsize=1 << 16)
def _backward(costs: tuple, code: int) -> tuple[tuple, float]:
    return _normal([min(cost + costs[then] for cost, _, then in moves(code, state)) for state in range(4)])


@lru_cache(maxsize=1 << 16)
def _single(code: int, state: int, after: tuple) -> tuple[str, int]:
    _, edits, then = min((cost + after[then], edits, then) for cost, edits, then in moves(code, state))
    return edits, then


def _unit(state: int) -> tuple:
    return tuple(0 if s == state else math.inf for s in range(4))


def _run_forward(codes, state: int) -> tuple[tuple, tuple, float]:
    vector, total = (_unit(state), tuple(0 if s == state else -1 for s in range(4))), 0
    for code in codes:
        vector, less = _forward(vector, code)
        total += less
    return vector[0], vector[1], total


def hirschberg(codes: bytes, begin: int = START, end: int | None = None) -> str:
    """Edits that lead through all turns from state ``begin`` to state ``end`` (None:
    to the end of the conversation, with the inserts that complete it)."""
    out, state = [], begin
    last = ACCEPT if end is None else _unit(end)
    todo = [(0, len(codes), last)]         # a stack of pieces from left to right; each begins where the one before ended
    while todo:
        lo, hi, after = todo.pop()
        if hi - lo == 0:
            continue
        if hi - lo == 1:
            edits, state = _single(codes[lo], state, after)
            out.append(edits)
            continue
        mid = (lo + hi) // 2
        costs, ranks, _ = _run_forward(codes[lo:mid], state)
        back = after
        for code in reversed(codes[mid:hi]):
            back, _ = _backward(back, code)
        cross = min((costs[s] + back[s], ranks[s], s) for s in range(4) if costs[s] < math.inf)[2]
        todo.append((mid, hi, after))
        todo.append((lo, mid, _unit(cross)))
    return "".join(out) + (ENDINGS[state] if end is None else "")


def transfer(codes: bytes) -> list[list]:
    """For every state to begin with: [costs, ranks] of the states after the turns."""
    found = []
    for state in range(4):
        costs, ranks, total = _run_forward(codes, state)
        found.append([[None if c == math.inf else int(c + total) for c in costs], list(ranks)])
    return found


def border_states(transfers: list[list[list]]) -> list[int]:
    """States after each run of one conversation, from the runs' :func:`transfer`: cost vectors
    forward over the runs, then back along the choices."""
    costs, ranks, chosen = [0, None, None, None], [0, -1, -1, -1], []
    for run in transfers:
        best = {}
        for then in range(4):
            ways = [(costs[s] + run[s][0][then], ranks[s], run[s][1][then], s) for s in range(4)
                    if costs[s] is not None and run[s][0][then] is not None]
            if ways:
                best[then] = min(ways)
        order = sorted(best, key=lambda t: best[t][1:3])
        costs = [best[t][0] if t in best else None for t in range(4)]
        ranks = [order.index(t) if t in best else -1 for t in range(4)]
        chosen.append({t: b[3] for t, b in best.items()})
    state = min((costs[s] + ACCEPT[s], ranks[s], s) for s in range(4) if costs[s] is not None)[2]
    out = []
    for back in reversed(chosen):
        out.append(state)
        state = back[state]
    return out[::-1]


def edited(codes: bytes, edits: str, begin: int) -> Iterator[tuple[int, str, str | None]]:
    """(turn, edit, new role) of each edit; an insert at the very end belongs to the last turn."""
    at, state = 0, begin
    for e in edits:
        here = min(at, len(codes) - 1)
        if e in "IR":
            state = NEXT[state]
            yield here, e, ROLE[state]
        else:
            state = codes[at] & 3 if e == "K" else state
            yield here, e, None
        at += e != "I"


def edit_cost(codes: bytes, edits: str) -> int:
    passed = [e for e in edits if e != "I"]
    cut = sum(1 for c, e in zip(codes, passed) if e != "D" and c & TRUNCATED)
    return (edits.count("I") * INSERT_COST + edits.count("D") * DELETE_COST + edits.count("R") * REROLE_COST + cut * TRUNCATED_COST)


_SOLVED = "struct<audit:string,cost:long,blank:long,duplicate:long,truncated:long,illegal:long,first:int,last:int>"
_RUNS = ("part long, run long, key string, conv_part boolean, seqs array<long>, codes binary")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation of a sorted range; ``conv_part``: the first or the last one, which may go on elsewhere."""
    from pyspark import TaskContext

    part, number, key, codes, seqs = TaskContext.get().partitionId(), 0, None, [], []

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([
            pa.array([part] * len(found), pa.int64()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.string()),
            pa.array([f[2] for f in found], pa.bool_()), pa.array([np.concatenate(f[3]) for f in found], pa.list_(pa.int64())),
            pa.array([np.concatenate(f[4]).tobytes() for f in found], pa.binary())], ["part", "run", "key", "conv_part", "seqs", "codes"])

    for batch in batches:
        if not batch.num_rows:
            continue
        mark = batch["mark"].to_numpy(zero_copy_only=False) == 1
        code = batch["code"].to_numpy(zero_copy_only=False).astype(np.uint8)
        at = np.flatnonzero(mark)
        if len(at) and at[0] == 0:
            codes[-1][-1] |= DUPLICATE          # the marked turn ended the batch before
            at = at[1:]
        code[at - 1] |= DUPLICATE
        names = np.array(batch["key"].to_pylist(), object)[~mark]
        seq, code = batch["seq"].to_numpy(zero_copy_only=False)[~mark], code[~mark]
        if not len(seq):
            continue
        starts = np.flatnonzero(np.r_[names[0] != key, names[1:] != names[:-1]])
        head = int(starts[0]) if len(starts) else len(seq)
        if head:
            codes.append(code[:head].copy())
            seqs.append(seq[:head])
        done = []
        for a, b in zip(starts, np.r_[starts[1:], len(seq)]):
            if key is not None:
                done.append((number, key, number == 0, seqs, codes))
                number += 1
            key, seqs, codes = names[a], [seq[a:b]], [code[a:b].copy()]
        if done:
            yield rows(done)
    if key is not None:
        yield rows([(number, key, True, seqs, codes)])


def ordered_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """Stored (seq, key, conv, turn, role, text): ``seq`` numbers all turns in their order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("key"), F.col(conv_col).alias("conv"),
                        F.col(turn_col).alias("turn"), space(role_col).alias("role"), space(text_col).alias("text"))
    rows = rows.withColumn("head", F.substring("text", 1, HEAD)).withColumn("h", F.xxhash64("text")).withColumn("uid", F.monotonically_increasing_id())
    order = ["key", "turn", "role", "head", "h", "uid"]      # the last one only deals out equal rows
    return stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(
        F.monotonically_increasing_id().alias("seq"), "key", "conv", "turn", "role", "text"), "turns")


def turn_code(role: Column, text: Column) -> Column:
    stripped = F.btrim(text, F.lit(WHITE))
    initial, kind = F.substring(role, 1, 1), F.lit(OTHER_ROLE)
    for letter, n in CLASSES.items():
        kind = F.when(initial == letter, F.lit(n)).otherwise(kind)
    bits = F.when(stripped == "", F.lit(BLANK)).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), F.lit(0)).otherwise(F.lit(TRUNCATED))
    return (kind + bits).cast("int")


def _transfers(codes: pa.Array) -> pa.Array:
    return pa.array([transfer(c.as_py()) for c in codes], pa.list_(pa.list_(pa.list_(pa.int32()))))


def _solve(codes: pa.Array, begin: pa.Array, end: pa.Array) -> pa.Array:
    out = []
    for c, b, e in zip(codes, begin.to_pylist(), end.to_pylist()):
        raw = c.as_py()
        audit = hirschberg(raw, b, e)
        x = np.frombuffer(raw, np.uint8)
        kinds, blank = x & 3, (x & BLANK) > 0
        repeat = ~blank & ((x & DUPLICATE) > 0)
        legal = (kinds[1:] > 0) & np.isin(kinds[:-1] * 4 + kinds[1:], [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER])
        out.append((audit, edit_cost(raw, audit), int(blank.sum()), int(repeat.sum()), int((~blank & ~repeat & ((x & TRUNCATED) > 0)).sum()),
                    int((~legal).sum()), int(kinds[0]), int(kinds[-1])))
    names = ["audit", "cost", "blank", "duplicate", "truncated", "illegal", "first", "last"]
    types = [pa.string(), *[pa.int64()] * 5, pa.int32(), pa.int32()]
    return pa.StructArray.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], names)


def solved_runs(rows: DataFrame) -> DataFrame:
    """Stored (part, run, key, seqs, codes, begin, s) for :func:`ordered_turns`; ``s``: edits, cost and counts of the run."""
    spark = rows.sparkSession
    said = rows.select("seq", "key", F.xxhash64("role", "text").alias("d1"), F.xxhash64(F.lit(1), "text", "role").alias("d2"))
    groups = stored(said.groupBy("key", "d1", "d2").agg(F.min("seq").alias("first"), F.count("*").alias("n")).where("n > 1"), "repeats")
    again = join_groups(said, groups, ["key", "d1", "d2"], "n").where("seq > first").select(
        "seq", "key", F.lit(1).alias("mark"), F.lit(0).alias("code"))
    coded = rows.select("seq", "key", F.lit(0).alias("mark"), turn_code(F.col("role"), F.col("text")).alias("code")).unionByName(again)
    runs = stored(coded.repartitionByRange("seq").sortWithinPartitions("seq", "mark").mapInArrow(_runs, _RUNS), "runs")
    # conversations that reach over the border of a range: two runs a range at most
    parts = runs.where("conv_part").select("part", "run", "key", F.arrow_udf(_transfers, "array<array<array<int>>>")("codes").alias("t")).orderBy("part", "run").collect()
    borders, i = [], 0
    while i < len(parts):
        j = i + 1
        while j < len(parts) and parts[j]["key"] == parts[i]["key"]:
            j += 1
        states = border_states([p["t"] for p in parts[i:j]])
        borders += [(p["part"], p["run"], b, e) for p, b, e in zip(parts[i:j], [START, *states], [*states[:-1], None])]
        i = j
    at = spark.createDataFrame(borders, "part long, run long, begin int, end int")
    met = runs.join(F.broadcast(at), ["part", "run"], "left").withColumn("begin", F.coalesce("begin", F.lit(START)))
    return stored(met.select("part", "run", "key", "seqs", "codes", "begin", F.arrow_udf(_solve, _SOLVED)("codes", "begin", "end").alias("s")), "solved")


def reports(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation with turns."""
    span = rows.where("turn is not null").select("key", "turn").distinct().groupBy("key").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "run", "s")))
    told = runs.groupBy("key").agg(pieces.alias("p"))
    total = lambda c: F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["s"][c])
    # neighbouring turns in different ranges
    kinds = [SYSTEM * 4 + USER, USER * 4 + ASSISTANT, ASSISTANT * 4 + USER]
    across = F.aggregate(F.sequence(F.lit(1), F.size("p")), F.lit(0).cast("long"), lambda a, i: a + F.when(i < F.size("p"), F.when(
        (F.get("p", i - 1)["s"]["last"] * 4 + F.get("p", i)["s"]["first"]).isin(kinds) & (F.get("p", i)["s"]["first"] > 0), 0).otherwise(1)).otherwise(0))
    return told.join(span, "key", "left").select(
        "key", F.coalesce("gaps", F.lit(0).cast("long")).cast("long").alias("gaps"), total("blank").alias("blank"), total("duplicate").alias("duplicate"),
        total("truncated").alias("truncated"), (total("illegal") + across).alias("illegal"), total("cost").alias("cost"),
        F.array_join(F.transform("p", lambda x: x["s"]["audit"]), "").alias("audit"))


def _edit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for seqs, codes, audit, begin in zip(*(batch[c] for c in ("seqs", "codes", "audit", "begin"))):
            made = list(edited(codes.as_py(), audit.as_py(), begin.as_py()))
            at = seqs.values.to_numpy(zero_copy_only=False)[[m[0] for m in made]] if made else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.arange(len(made))), pa.array([m[1] for m in made], pa.string()),
                                              pa.array([m[2] for m in made], pa.string())], ["seq", "nth", "edit", "new_role"])


def repaired_turns(rows: DataFrame, runs: DataFrame) -> DataFrame:
    """(key, conv, seq, nth, edit, turn, role, text) of every edit in order of (seq, nth); the
    turns of the repaired conversations are those whose edit is not D."""
    edits = runs.select("seqs", "codes", "s.audit", "begin").mapInArrow(_edit_rows, "seq long, nth long, edit string, new_role string")
    made = F.col("edit") == "I"
    return rows.join(edits, "seq").select(
        "key", "conv", "seq", "nth", "edit", F.when(~made, F.col("turn")).alias("turn"), F.coalesce("new_role", "role").alias("role"),
        F.when(made, F.lit("")).otherwise(F.col("text")).alias("text"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines, which arrive in order; only its state is held."""
    key, sha, begun = None, None, False

    def row(key: str, sha) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([sha.hexdigest()], pa.string())], ["key", "repaired_sha256"])

    for batch in batches:
        for k, line in zip(batch["key"].to_pylist(), batch["line"]):
            if k != key or sha is None:
                if sha is not None:
                    yield row(key, sha)
                key, sha, begun = k, hashlib.sha256(), False
            sha.update((b"\n" if begun else b"") + line.as_py().encode())
            begun = True
    if sha is not None:
        yield row(key, sha)


def damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage: by crc32 of ``conv_id:turn`` modulo 20 a row is dropped,
    emptied, cut, repeated or given the role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies)).drop("col")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Contract query: faults, edits and repaired text of every conversation.

    A SHA-256 is computed in one go, so the lines of a conversation pass through one
    task for it, one line at a time; the repair itself is spread over ranges."""
    prepare(spark)
    turns = read(spark, sf_dir, "conversations")
    rows = ordered_turns(damaged(turns))
    runs = solved_runs(rows)
    lines = repaired_turns(rows, runs).where("edit <> 'D'").select("key", "seq", "nth", F.concat("role", F.lit(":"), "text").alias("line"))
    sha = lines.repartition("key").sortWithinPartitions("key", "seq", "nth").select("key", "line").mapInArrow(
        _digests, "key string, repaired_sha256 string")
    every = turns.select(F.col("conv_id"), F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("key")).distinct()
    found = every.join(reports(rows, runs), "key", "left").join(sha, "key", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return found.select("conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                        F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS i)),
w AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                 lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 20 AS f
      FROM (SELECT *, (SELECT t FROM crc_table) AS t FROM conversations)),
g AS (SELECT conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role,
             CASE f WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
             unnest(CASE f WHEN 3 THEN [0, 1] ELSE [0] END) AS copy FROM w WHERE f <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n,
             trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS s, left(role, 1) AS k FROM g),
q AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS again, lag(k) OVER (PARTITION BY conv_id ORDER BY n) AS before FROM o),
r AS (SELECT *, s = '' AS blank, s <> '' AND again AS dup, s <> '' AND NOT again AND right(s, 1) NOT IN ('.', '!', '?') AS cut FROM q),
st AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS n, {c: CAST(0 AS BIGINT), a: '', o: CAST([] AS VARCHAR[])} AS z, {c: CAST(100000000 AS BIGINT), a: '', o: CAST([] AS VARCHAR[])} AS y,
         {c: CAST(100000000 AS BIGINT), a: '', o: CAST([] AS VARCHAR[])} AS u, {c: CAST(100000000 AS BIGINT), a: '', o: CAST([] AS VARCHAR[])} AS v FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {c: z.c + 2, a: z.a || 'D', o: z.o},
         list_min([{c: y.c + 2, a: y.a || 'D', o: y.o}] || CASE WHEN keep AND k = 's' THEN [{c: z.c + more, a: z.a || 'K', o: list_append(z.o, role || ':' || text)}] ELSE [] END),
         list_min([{c: u.c + 2, a: u.a || 'D', o: u.o}]
           || CASE WHEN keep AND k = 'u' THEN list_transform([z, y, v], lambda p: {c: p.c + more, a: p.a || 'K', o: list_append(p.o, role || ':' || text)}) ELSE [] END
           || CASE WHEN keep THEN list_transform([z, y, v], lambda p: {c: p.c + more + 1, a: p.a || 'R', o: list_append(p.o, 'user:' || text)}) ELSE [] END),
         list_min([{c: v.c + 2, a: v.a || 'D', o: v.o}]
           || CASE WHEN keep AND k = 'a' THEN [{c: u.c + more, a: u.a || 'K', o: list_append(u.o, role || ':' || text)}] ELSE [] END
           || CASE WHEN keep THEN [{c: u.c + more + 1, a: u.a || 'R', o: list_append(u.o, 'assistant:' || text)}] ELSE [] END)
  FROM (SELECT st.conv_id, r.n, r.k, r.role, r.text, NOT (r.blank OR r.dup) AS keep, CASE WHEN r.cut THEN 5 ELSE 0 END AS more, st.z, st.y,
               list_min([st.u] || list_transform([st.z, st.y, st.v], lambda p: {c: p.c + 5, a: p.a || 'I', o: list_append(p.o, 'user:')})) AS u,
               list_min([st.v, {c: st.u.c + 5, a: st.u.a || 'I', o: list_append(st.u.o, 'assistant:')}]
                        || list_transform([st.z, st.y], lambda p: {c: p.c + 10, a: p.a || 'II', o: list_append(list_append(p.o, 'user:'), 'assistant:')})) AS v
        FROM st JOIN r ON st.conv_id IS NOT DISTINCT FROM r.conv_id AND r.n = st.n + 1)),
e AS (SELECT conv_id, list_min([z, v, {c: u.c + 5, a: u.a || 'I', o: list_append(u.o, 'assistant:')},
                                {c: y.c + 10, a: y.a || 'II', o: list_append(list_append(y.o, 'user:'), 'assistant:')}]) AS b
      FROM st QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank,
             count(*) FILTER (WHERE dup) AS duplicate, count(*) FILTER (WHERE cut) AS truncated,
             count(*) FILTER (WHERE n > 1 AND before || k NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
SELECT e.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
       CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(b.c AS BIGINT) AS cost, b.a AS audit,
       sha256(array_to_string(b.o, chr(10))) AS repaired_sha256
FROM e LEFT JOIN m ON e.conv_id IS NOT DISTINCT FROM m.conv_id
"""
