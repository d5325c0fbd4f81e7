"""Model slots: text embedding and text classification.

The reference loads pretrained networks; none ship here, so both slots take
an injected model and come with a small deterministic default:

* ``embed``: Arrow batches through ``mapInPandas``; the encoder is built
  once per Python worker from a factory (so a heavy model loads once, not
  per batch). Default: hashed token counts projected by a fixed seeded
  Gaussian matrix, generated row by row per token hash (the matrix is never
  materialised), L2-normalised, float32.
* ``sentiment``: a scalar Arrow UDF around an injected classifier
  (list[str] -> list[str]); or, by default, a Spark ML text pipeline fitted
  on labelled rows, which stays entirely in the JVM.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(r"\w+", re.UNICODE)
_WORKER_CACHE: dict = {}


class HashedProjectionEncoder:
    """Deterministic bag-of-words encoder: token hash -> one of ``buckets`` rows
    of a seeded N(0,1) matrix; a text is the normalised sum of its token rows."""

    def __init__(self, dim: int = 384, seed: int = 0, lowercase: bool = True, buckets: int = 1 << 14):
        self.dim, self.seed, self.lowercase, self.buckets = dim, seed, lowercase, buckets
        # buckets x dim numbers, drawn at once: 25 MB at the defaults, and never more
        self._rows = np.random.default_rng(seed).standard_normal((buckets, dim), dtype=np.float32)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float32)
        for i, t in enumerate(texts):
            if not t:
                continue
            toks = _TOKEN.findall(t.lower() if self.lowercase else t)
            hashes = [zlib.crc32(tok.encode("utf-8")) % self.buckets for tok in toks]
            which, n = np.unique(np.array(hashes, np.int64), return_counts=True)
            out[i] = n.astype(np.float32) @ self._rows[which]
            n = np.linalg.norm(out[i])
            if n > 0:
                out[i] /= n
        return out


def embed(df: DataFrame, text: str, out: str = "embedding",
          encoder_factory: Callable[[], Callable[[list[str]], np.ndarray]] | None = None,
          dim: int = 384, seed: int = 0) -> DataFrame:
    """Append ``out`` = float32 vector of ``text`` for every row (J1)."""
    factory = encoder_factory or (lambda: HashedProjectionEncoder(dim, seed))
    key = ("embed", id(factory), dim, seed)
    schema = T.StructType(df.schema.fields + [T.StructField(out, T.ArrayType(T.FloatType(), False))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _WORKER_CACHE.get(key)
        if enc is None:
            enc = _WORKER_CACHE[key] = factory()
        for b in batches:
            vecs = enc(b[text].fillna("").tolist())
            b = b.copy()
            b[out] = list(np.asarray(vecs, dtype=np.float32))
            yield b

    return df.mapInPandas(run, schema)


def sentiment_udf(classifier_factory: Callable[[], Callable[[list[str]], list[str]]]):
    """Scalar Arrow UDF (string -> string) around an injected classifier;
    the classifier is built once per Python worker (K1 surface)."""
    key = ("sentiment", id(classifier_factory))

    @F.pandas_udf(T.StringType())
    def _udf(s: pd.Series) -> pd.Series:
        clf = _WORKER_CACHE.get(key)
        if clf is None:
            clf = _WORKER_CACHE[key] = classifier_factory()
        return pd.Series(clf(s.fillna("").tolist()), dtype="object")

    return _udf


def fit_text_classifier(train: DataFrame, text: str, label: str, num_features: int = 1 << 16,
                        reg: float = 0.01, max_iter: int = 50):
    """Default classifier: tokens -> hashed term frequencies -> IDF ->
    logistic regression, all Spark ML (JVM) stages."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    pipe = Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="__tok", pattern=r"\W+", toLowercase=True),
        HashingTF(inputCol="__tok", outputCol="__tf", numFeatures=num_features),
        IDF(inputCol="__tf", outputCol="__features"),
        LogisticRegression(featuresCol="__features", labelCol="__label", predictionCol="__pred",
                           regParam=reg, maxIter=max_iter),
    ])
    return pipe.fit(train.select(text, F.col(label).cast("double").alias("__label")))


def sentiment(df: DataFrame, text: str, model=None, classifier_factory=None,
              labels=("NEGATIVE", "POSITIVE"), out: str = "sentiment") -> DataFrame:
    """Label every text (J23): with ``classifier_factory`` through the Arrow
    UDF, otherwise with a fitted Spark ML ``model`` (predictions 0/1 mapped
    to ``labels``)."""
    if classifier_factory is not None:
        return df.withColumn(out, sentiment_udf(classifier_factory)(F.col(text)))
    if model is None:
        raise ValueError("pass a fitted model or a classifier factory")
    pred = model.transform(df)
    lab = F.when(F.col("__pred") >= 0.5, F.lit(labels[1])).otherwise(F.lit(labels[0]))
    return pred.withColumn(out, lab).select(*df.columns, out)
