"""Model-slot rows: embeddings, text classification, vector packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from wreath.functions import vectors as V
from wreath.operators import models as M
from wreath.operators import vectors as VO
from wreath.plans.fixtures import Fixtures
from wreath.plans.registry import query


@query("j1_embed_texts")
def j1_embed_texts(spark, sf):
    """Every document's whole text to a 384-value float32 vector with the
    default encoder (rows-only: a model output)."""
    d = Fixtures(spark, sf).documents.select("doc_id", "text")
    e = M.embed(d, "text", seed=5)
    return e.select("doc_id", V.round_vec("embedding").alias("embedding"))


@query("j1_embed_headlines_then_align")
def j1_embed_headlines_then_align(spark, sf):
    """Embed cleaned conversation turns, then score them against the label
    centroids of the given vectors (embed -> alignment, rows-only)."""
    from wreath.functions.text import clean_headline
    fx = Fixtures(spark, sf)
    turns = fx.conversations.select(F.concat_ws("-", "conv_id", "turn").alias("id"),
                                    clean_headline(F.col("text")).alias("text"))
    vecs = M.embed(turns, "text", dim=64, seed=5)
    cents = VO.mean_vector(fx.vec, "label", "embedding").withColumnRenamed("label", "topic")
    return VO.alignment(vecs.select("id", "embedding"), cents, "embedding", p=2, mod_sim=True) \
        .select("id", F.round("alignment", 6).alias("alignment"))


def _positive_words():
    # a tiny lexicon classifier used to exercise the Arrow UDF slot
    def clf(texts):
        return ["POSITIVE" if (" the " in f" {t.lower()} ") else "NEGATIVE" for t in texts]
    return clf


@query("j23_sentiment_udf", oracle="""
SELECT doc_id, CASE WHEN strpos(' ' || lower(text) || ' ', ' the ') > 0 THEN 'POSITIVE' ELSE 'NEGATIVE' END AS sentiment
FROM documents
""")
def j23_sentiment_udf(spark, sf):
    """The Arrow (pandas) UDF slot with an injected classifier, over whole texts."""
    d = Fixtures(spark, sf).documents.select("doc_id", "text")
    return M.sentiment(d, "text", classifier_factory=_positive_words).select("doc_id", "sentiment")


@query("j23_sentiment_model")
def j23_sentiment_model(spark, sf):
    """Default slot: a Spark ML text classifier fitted on the labelled
    documents (toxic flag), applied to every document (rows-only)."""
    fx = Fixtures(spark, sf)
    train = fx.documents.join(fx.labels, "doc_id").select("text", "toxic")
    model = M.fit_text_classifier(train, "text", "toxic")
    return M.sentiment(fx.documents.select("doc_id", "text"), "text", model=model,
                       labels=("NON_TOXIC", "TOXIC")).select("doc_id", "sentiment")


@query("i24_pack_unpack_vectors", oracle="""
SELECT vec_id, len(embedding) AS dim, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings
""")
def i24_pack_unpack_vectors(spark, sf):
    """Arrays to ML vectors and back (the estimator edge) without change."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    v = Fixtures(spark, sf).vec
    packed = v.select("vec_id", array_to_vector(V.as_double("embedding")).alias("features"))
    back = packed.select("vec_id", vector_to_array("features").alias("embedding"))
    tot = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return back.select("vec_id", F.size("embedding").cast("bigint").alias("dim"), F.round(tot, 6).alias("total"))
