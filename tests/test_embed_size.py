from wreath.plans.queries_models import j1_embed_texts


def test_texts_are_embedded_at_the_default_size(spark):
    assert len(j1_embed_texts(spark, "/root/testdata/sf0.001").first()["embedding"]) == 384
