from pyspark.sql import functions as F

from wreath.operators.encode import CountEncoder
from wreath.sources import io as IO


def test_csv_multiline_quotes_round_trip(spark):
    df = spark.createDataFrame([(1, 'line one\nline "two", with comma'), (2, None)], "k long, d string")
    path = IO.scratch_path(spark, "t-csv")
    IO.write_table(df, path, "csv")
    back = IO.read_table(spark, path, "csv", "k long, d string")
    assert sorted(back.collect(), key=lambda r: r.k) == sorted(df.collect(), key=lambda r: r.k)


def test_json_year_as_string(spark):
    path = IO.scratch_path(spark, "t-json")
    spark.createDataFrame([("a", "1977", "3")], "id string, year string, month string").write.json(path)
    wrong = spark.read.schema("id string, year int").json(path).first()
    assert wrong.year is None  # an int schema over a quoted number gives null
    back = IO.cast_columns(IO.read_table(spark, path, "json", "id string, year string, month string"),
                           {"year": "int", "month": "int"}).first()
    assert (back.year, back.month) == (1977, 3)


def test_flatten_docs_missing_levels(spark):
    docs = ('{"response": {"docs": [{"_id": "a", "print_page": "1", "headline": {"print_headline": "H"}, '
            '"abstract": "A"}, {"_id": "b", "print_page": "2"}, {"_id": "c", "print_page": "1"}]}}')
    df = spark.createDataFrame([(docs, "1977", "3")], "j string, year string, month string")
    out = sorted(IO.flatten_docs(df, "j").collect(), key=lambda r: r.id)
    assert [(r.id, r.headline, r.abstract, r.year, r.month) for r in out] == [
        ("a", "H", "A", 1977, 3), ("c", None, None, 1977, 3)]


def test_flatten_bindings_missing_keys(spark):
    df = spark.createDataFrame([('{"item": {"value": "x"}}',)], "j string")
    r = IO.flatten_bindings(df, "j", ["item", "label"]).first()
    assert (r.item, r.label) == ("x", None)


def test_pending_requests(spark):
    req = spark.createDataFrame([("1977/1.json",), ("1977/2.json",)], "path string").withColumn(
        "key", IO.request_key("path"))
    cache = req.filter(F.col("path") == "1977/1.json").select("key")
    assert [r.path for r in IO.pending_requests(req, cache).collect()] == ["1977/2.json"]


def test_parquet_zstd_level(spark):
    path = IO.scratch_path(spark, "t-pq")
    IO.write_table(spark.range(10), path, "parquet", codec="zstd", level=15)
    assert spark.read.parquet(path).count() == 10


def test_count_encoder_infrequent_and_unknown(spark):
    rows = [(i, ["a", "b"] if i % 2 else ["a"]) for i in range(50)] + [(100, ["rare"]), (101, [])]
    df = spark.createDataFrame(rows, "k int, g array<string>")
    model = CountEncoder(["g"], "k", 0.05).fit(df)
    assert model.kept["g"] == ["a", "b", None] or model.kept["g"] == ["a", "b"]
    new = spark.createDataFrame([(7, ["a", "a", "unseen"])], "k int, g array<string>")
    r = model.transform(new).first()
    assert r.g_a == 2 and r.g_infrequent_sklearn == 1


def test_balanced_weights(spark):
    from wreath.operators.stats import balanced_weights
    df = spark.createDataFrame([(i % 3,) for i in range(30)] + [(7,)], "y int")
    a = sorted((r.y, round(r.weight, 12)) for r in balanced_weights(df, "y").collect())
    assert dict(a)[7] == round(31 / (4 * 1), 12)


def test_count_encoder_fit_reads_its_input_once_a_column(spark):
    from wreath.operators.encode import CountEncoder
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", None])], "k long, v array<string>").mapInArrow(seen, "k long, v array<string>")
    model = CountEncoder(["v"], "k", 0.5).fit(df)
    assert model.kept == {"v": ["a"]} and model.infrequent == {"v": True}
    assert read.value == 2
