"""Count encoding of list columns: one count column per frequent value.

Fit: explode the list columns (equal lengths move together), count each
value, keep values seen in at least ``min_frequency`` of the exploded rows;
the rest (and values unseen at fit time) share one infrequent bucket. The
kept values are a bounded constant (at most 1 / min_frequency per column).
Transform: explode, then one aggregate per key with a conditional count
per output column (partial aggregation, no pivot discovery pass), joined
back to the untouched columns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wreath.operators.relational import explode_zip
from wreath.session import materialize

INFREQUENT = "infrequent_sklearn"
NULL_NAME = "None"


def _exploded(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    return explode_zip(df.select(key, *cols), list(cols))


@dataclass
class CountEncoderModel:
    key: str
    columns: list[str]
    kept: dict[str, list]          # frequent values per column (None = null value)
    infrequent: dict[str, bool]    # whether the column has an infrequent bucket

    def feature_names(self) -> list[str]:
        out = []
        for c in self.columns:
            out += [f"{c}_{NULL_NAME if v is None else v}" for v in self.kept[c]]
            if self.infrequent[c]:
                out.append(f"{c}_{INFREQUENT}")
        return out

    def transform(self, df: DataFrame, counts_only: bool = False) -> DataFrame:
        """Counts per key joined back to the untouched columns (inner join
        on the key), or just (key, counts...) when ``counts_only``."""
        ex = _exploded(df, self.key, self.columns)
        aggs = []
        for c in self.columns:
            kept = self.kept[c]
            non_null = [v for v in kept if v is not None]
            for v in kept:
                cond = F.col(c).isNull() if v is None else (F.col(c) == F.lit(v))
                aggs.append(F.count_if(cond).cast("bigint").alias(f"{c}_{NULL_NAME if v is None else v}"))
            if self.infrequent[c]:
                is_kept = F.col(c).isin(*non_null) if non_null else F.lit(False)
                if None in kept:
                    is_kept = is_kept | F.col(c).isNull()
                else:
                    is_kept = F.coalesce(is_kept, F.lit(False))
                aggs.append(F.count_if(~is_kept).cast("bigint").alias(f"{c}_{INFREQUENT}"))
        counts = ex.groupBy(self.key).agg(*aggs)
        if counts_only:
            return counts
        return df.drop(*self.columns).join(counts, self.key, "inner")


class CountEncoder:
    def __init__(self, columns: Sequence[str], key: str, min_frequency: float = 0.01):
        self.columns = list(columns)
        self.key = key
        self.min_frequency = min_frequency

    def fit(self, df: DataFrame) -> CountEncoderModel:
        # the input is read once a column, when its values are counted
        ex = _exploded(df, self.key, self.columns)
        kept, infrequent = {}, {}
        for c in self.columns:
            freq = materialize(ex.groupBy(c).agg(F.count(F.lit(1)).alias("n")))
            n = freq.agg(F.sum("n").alias("n")).first()["n"] or 0
            floor = math.ceil(self.min_frequency * n) if self.min_frequency < 1 else int(self.min_frequency)
            stats = freq.agg(F.count_if(F.col("n") < floor).alias("rare")).first()
            # at most 1 / min_frequency values reach a relative floor
            rows = freq.filter(F.col("n") >= floor).collect()
            vals = [r[c] for r in rows]
            kept[c] = sorted([v for v in vals if v is not None]) + ([None] if None in vals else [])
            infrequent[c] = bool(stats["rare"])
        return CountEncoderModel(self.key, self.columns, kept, infrequent)
