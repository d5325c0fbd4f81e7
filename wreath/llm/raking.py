"""Mixing sources to target weights by iterative proportional fitting (operator 8).

Token counts are summed per cell (source, language, topic). Raking scales the
cells until the tokens of every source, language and topic have their target
shares; the ratio of a cell's raked weight to its tokens is its sampling rate.
Rates are divided by the largest one, so that its cell is taken whole, no cell is
asked for more than it has and every raked share holds in the sample. Each document
is kept with its cell's probability, by a hash of id and text (the same document is
always kept or always left).

Targets that contradict each other (a value of one axis only inside a value of
another) cannot all be met: after ``max_rounds`` the last raked cells are used and a
warning names the largest deviation of each axis; :func:`deviations` has them all.

Targets are shares per plain value, for every value that has tokens (0 leaves a value's
documents out; anything else missing, unknown or not summing to 1 raises); without
them an axis gets its own shares raised to ``temper`` (below 1 flattens). A null value is a value of its own. Documents
without a token have no weight and are kept; repeated rows share one fate; an
empty table gives no rows. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wreath.llm.common import prepare, read, stored, unit_hash

TEMPER = 0.85
TOLERANCE = 1e-4
MAX_ROUNDS = 40


def token_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def topic_of(text: str, tokens: Column) -> Column:
    """A coarse topic from the form of a text."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (F.when(t.contains(" | "), "table")
            .when(t.contains("License") | t.contains("Copyright"), "notice")
            .when(tokens < 200, "note").when(tokens < 1_000, "article").otherwise("long"))


def _key(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def rake(cells: DataFrame, axes: list[str], targets: dict[str, DataFrame], tolerance: float = TOLERANCE,
         max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int, bool]:
    """Cells with ``weight`` raked to ``targets`` (axis value, share), the rounds
    taken and whether every share is within ``tolerance`` of its target."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = stored(cells.withColumn("weight", F.col("tokens").cast("double")), "cells")
    for done in range(1, max_rounds + 1):
        off = []
        for axis in axes:
            sums = now.groupBy(axis).agg(F.sum("weight").alias("__s")).join(targets[axis], axis).select(
                axis, F.when(F.col("__s") > 0, F.col("share") * total / F.col("__s")).otherwise(0.0).alias(f"__{axis}"),
                (F.col("share") > 0).alias(f"__{axis}_in"))
            now = now.join(sums, axis)
            off.append(F.max(F.when(F.col(f"__{axis}_in"), F.abs(F.col(f"__{axis}") - 1))).alias(axis))
            now = now.withColumn("weight", F.col("weight") * F.col(f"__{axis}"))
        now = stored(now, "cells")
        worst = now.where("tokens > 0").agg(*off).first()
        now = now.drop(*[f"__{a}" for a in axes], *[f"__{a}_in" for a in axes])
        if all((x or 0.0) <= tolerance for x in worst):
            return now, done, True
    return now, max_rounds, False


def deviations(raked: DataFrame, axes: list[str], targets: dict[str, DataFrame]) -> DataFrame:
    """(axis, value, share, target, deviation): what raking reached for every
    value, and by which part of its target it misses."""
    total = raked.agg(F.sum("weight")).first()[0] or 1.0
    each = [raked.groupBy(F.col(a).alias("value")).agg((F.sum("weight") / total).alias("share"))
            .join(targets[a].select(F.col(a).alias("value"), F.col("share").alias("target")), "value")
            .select(F.lit(a).alias("axis"), "value", "share", "target", (F.try_divide(F.col("share"), F.col("target")) - 1).alias("deviation")) for a in axes]
    return reduce(DataFrame.unionByName, each)


def tempered(cells: DataFrame, axis: str, temper: float) -> DataFrame:
    """Target shares: the axis' own shares to the power ``temper``."""
    own = cells.groupBy(axis).agg(F.sum("tokens").alias("n")).where("n > 0").select(
        axis, F.pow(F.col("n").cast("double"), F.lit(temper)).alias("p"))
    return own.select(axis, (F.col("p") / F.lit(own.agg(F.sum("p")).first()[0] or 1.0)).alias("share"))


def checked_targets(cells: DataFrame, axis: str, wanted: DataFrame, axis_col: str) -> DataFrame:
    """Stored targets (axis value in its inner form, share) from plain (value, share) rows.

    Raises when a value is named twice, a share is null or negative, the shares do not sum to 1, a value with a
    positive share has no tokens, or a value with tokens has no target (0 leaves it out)."""
    own = stored(wanted.select(_key(F.col(axis_col)).alias(axis), F.col("share").cast("double").alias("share")), "target")
    total = own.agg(F.sum("share").alias("sum"), F.count("*").alias("n"), F.count_distinct(axis).alias("values"),
                    F.count_if(F.col("share").isNull() | (F.col("share") < 0)).alias("bad")).first()
    if total["n"] != total["values"] or total["bad"] or abs((total["sum"] or 0.0) - 1) > 1e-6:
        raise ValueError(f"targets of {axis}: {total['n']} rows, {total['values']} values, {total['bad']} bad shares, sum {total['sum']}")
    held = cells.where("tokens > 0").select(axis).distinct()
    show = lambda df: [r[0][1:] if r[0] else None for r in df.select(axis).limit(5).collect()]
    if unknown := show(own.where("share > 0").join(held, axis, "left_anti")):
        raise ValueError(f"targets of {axis} name values without tokens: {unknown}")
    if missing := show(held.join(own, axis, "left_anti")):
        raise ValueError(f"targets of {axis} leave out values with tokens: {missing}")
    return own


def _mixed(docs: DataFrame, id_col: str, text_col: str, axes: dict[str, Column] | None, targets: dict[str, DataFrame] | None,
           temper: float, max_rounds: int) -> DataFrame:
    """(row, mix): every document's own columns, and its cell, probability and fate."""
    tokens = token_count(text_col)
    axes = axes or {"source": F.col("source"), "lang": F.col("lang"), "topic": topic_of(text_col, tokens)}
    names = list(axes)
    chance = unit_hash(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    # own columns stay inside one struct, so no name of theirs meets one of these
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), chance.alias("chance"),
                        F.struct(tokens.alias("tokens"), *[_key(c).alias(a) for a, c in axes.items()]).alias("cell"))
    cells = stored(keyed.groupBy(*[F.col("cell")[a].alias(a) for a in names]).agg(F.sum("cell.tokens").alias("tokens")), "counts")
    if targets and set(targets) != set(names):
        raise ValueError(f"targets for {sorted(targets)}, axes are {sorted(names)}")
    shares = {a: checked_targets(cells, a, targets[a], a) if targets else stored(tempered(cells, a, temper), "target") for a in names}
    raked, rounds, reached = rake(cells.where("tokens > 0"), names, shares, max_rounds=max_rounds)
    if not reached:
        most = deviations(raked, names, shares).groupBy("axis").agg(
            F.max_by(F.struct("value", "deviation"), F.abs("deviation")).alias("m")).orderBy("axis").collect()
        warnings.warn(f"targets not reached in {rounds} rounds: " + ", ".join(
            f"{r['axis']} {r['m']['value'][1:] or None!r} {r['m']['deviation']:+.2%}" for r in most if r["m"]), stacklevel=3)
    rates = raked.select(*names, (F.col("weight") / F.col("tokens")).alias("rate"))
    most = rates.agg(F.max("rate")).first()[0] or 1.0
    chances = stored(rates.select(F.struct(*names).alias("of"), (F.col("rate") / most).alias("p")), "chances")
    met = keyed.join(chances, F.struct(*[F.col("cell")[a].alias(a) for a in names]) == F.col("of"), "left")
    # every cell with tokens has a rate; documents without a token have no weight
    p = F.when(F.col("cell.tokens") > 0, F.col("p")).otherwise(1.0)
    value = [F.when(F.col("cell")[a] != "", F.substring(F.col("cell")[a], 2, 1 << 20)).alias(a) for a in names]
    return met.select("row", F.struct(F.col("cell.tokens").alias("tokens"), *value, p.alias("probability"), (F.col("chance") < p).alias("kept")).alias("mix"))


def mixing_probabilities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", axes: dict[str, Column] | None = None,
                         targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, max_rounds: int = MAX_ROUNDS,
                         out_col: str = "__mix") -> DataFrame:
    """``docs`` with ``out_col``: struct of tokens, axis values, probability, kept. ``targets`` has a
    (axis, share) table of plain values for each axis. Warns when they are not reached."""
    if out_col in docs.columns:
        raise ValueError(f"documents have a column {out_col}; name another out_col")
    return _mixed(docs, id_col, text_col, axes, targets, temper, max_rounds).select("row.*", F.col("mix").alias(out_col))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", axes: dict[str, Column] | None = None,
                targets: dict[str, DataFrame] | None = None, temper: float = TEMPER, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """The documents that the calibrated sample keeps, with their own columns."""
    return _mixed(docs, id_col, text_col, axes, targets, temper, max_rounds).where("mix.kept").select("row.*")


def op8_mix_sources(spark, sf_dir: str) -> DataFrame:
    """Every document with its cell, its calibrated probability and its fate."""
    prepare(spark)
    m = mixing_probabilities(read(spark, sf_dir, "documents"))
    return m.select("doc_id", "__mix.*")
