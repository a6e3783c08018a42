"""Texts to unit vectors with a model of the user's or the TF-IDF projection."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import types as Ty

from gavilla.operators.tfidf import COMPONENTS, VOCABULARY, tfidf_vectors

TFIDF = "tfidf_svd"


def encode(df: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 512) -> DataFrame:
    """(id, vec) of (id, comentario_clean); ``make_encoder`` runs once per worker and returns texts -> matrix."""

    def load():
        model = make_encoder()

        def unit_rows(texts: np.ndarray) -> np.ndarray:
            out = np.asarray(model(texts), dtype=np.float64)
            length = np.sqrt((out * out).sum(1, keepdims=True))
            return (out / np.where(length > 0, length, 1)).astype(np.float32)

        return unit_rows

    predict = predict_batch_udf(load, return_type=Ty.ArrayType(Ty.FloatType()), batch_size=batch_size)
    return df.select("id", predict("comentario_clean").alias("vec"))


def embed(df: DataFrame, encoder: str | Callable = TFIDF, batch_size: int = 512, components: int = COMPONENTS, max_terms: int = VOCABULARY, seed: int = 42) -> DataFrame:
    """Vectors from the named choice: a callable as in ``encode``, or the TF-IDF projection."""
    if encoder == TFIDF:
        return tfidf_vectors(df, components, seed, max_terms)
    if not callable(encoder):
        raise ValueError(f"unknown encoder {encoder!r}: name {TFIDF!r} or give a callable")
    return encode(df, encoder, batch_size)
