"""Quoted CSV read in splits: the same rows as written, however small the splits are."""

import csv
import random

import pytest

from wreath.sources import io as IO
from wreath.sources.csv_splits import read_records

SCHEMA = "id LONG, text STRING, note STRING"
AWKWARD = [None, "", " ", "\n", "\n\n", "\r\n", "a\r\nb", "\r", 'say "hi"', '"', '""', '"\n"', ",", "\t", "\\", "tail\n", "\nhead", "x" * 5_000,
           "line\n" * 400, 'q"\n' * 301, "ünï 漢字\n🙂", "# no comment", "a,b\n1,2"]


@pytest.fixture(params=[64, 1_000, 10_000_000])
def split_bytes(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 0)
    spark.conf.set("spark.sql.files.minPartitionNum", 1)
    yield request.param
    for k in ("maxPartitionBytes", "openCostInBytes", "minPartitionNum"):
        spark.conf.unset(f"spark.sql.files.{k}")


@pytest.mark.parametrize("fmt", ["csv", "tsv"])
def test_awkward_texts_round_trip(spark, split_bytes, fmt, tmp_path):
    rng = random.Random(1)
    rows = [(i, t, rng.choice(AWKWARD)) for i, t in enumerate(AWKWARD * 3)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(2)
    path = f"file://{tmp_path}/t"
    IO.write_table(df, path, fmt)
    back = IO.read_table(spark, path, fmt, SCHEMA)
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == rows
    if split_bytes == 1_000:
        assert read_records(spark, path).rdd.getNumPartitions() > 10     # a file is no longer one task


def test_files_of_others(spark, split_bytes, tmp_path):
    """Bare fields, CRLF line ends, blank lines, no newline at the end, a header over several lines."""
    rows = [(i, f'v "{i}"\r\nnext' if i % 3 else "plain", "z") for i in range(200)]
    with open(tmp_path / "a.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, lineterminator="\r\n")
        w.writerow(["id", "te\nxt " + "long " * 50, "note"])
        w.writerows(rows)
        f.write("\r\n\r\n")
    with open(tmp_path / "b.csv", "w", encoding="utf-8") as f:
        f.write("id,text,note\n1000,,last")
    got = IO.read_table(spark, f"file://{tmp_path}/*.csv", "csv", SCHEMA, nullValue="")
    assert sorted(map(tuple, got.collect())) == rows + [(1000, None, "last")]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,text,note\n")
    assert IO.read_table(spark, f"file://{tmp_path}/*.csv", "csv", SCHEMA).collect() == []
