from wreath.llm import cross_parse as CP
from wreath.llm.common import prepare


def test_every_language_is_learned(spark):
    prepare(spark)
    word = lambda i, k: "".join(chr(97 + i * (7 + k) // 26 ** j % 26) for j in range(3)) + "qxzw"[k % 4] + chr(97 + i % 26)
    rows = [(i, f"l{i:03}", " ".join(word(i, k % 9) for k in range(60))) for i in range(230)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    parser = CP.fit(docs, max_bytes=300)
    assert parser.langs == [r[1] for r in rows]
    found = CP.identify(docs, parser, out_col="l").select("lang", "l.lang").toPandas()
    assert (found.iloc[:, 0] == found.iloc[:, 1]).mean() > 0.95
    small = CP.fit(docs, total_bytes=230 * 100)
    assert len(small.langs) == 230 and len(small.table) // small.letters <= 2 * 230 * 100 + 230
