"""From raw texts to cleaned, filtered and numbered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavilla.functions import text as T
from gavilla.operators.keys import number_rows


def clean_texts(df: DataFrame, text: str = "comentario") -> DataFrame:
    return df.withColumn("comentario_clean", T.clean(F.col(text)))


def drop_invalid(df: DataFrame) -> DataFrame:
    return df.where(T.is_valid(F.col("comentario_clean")))


def load_metrics(df: DataFrame, text: str = "comentario") -> DataFrame:
    """One row: rows read, filtered and valid."""
    valid = F.count_if(T.is_valid(F.col("comentario_clean")))
    return clean_texts(df, text).agg(
        F.count("*").alias("read_rows"),
        (F.count("*") - valid).alias("filtered_rows"),
        valid.alias("valid_rows"),
    )


def load_and_clean(df: DataFrame, keys: list[str], text: str = "comentario") -> DataFrame:
    """(id, comentario, comentario_clean): valid rows numbered 0..n-1 in the order of ``keys``."""
    picked = df.select(*keys, F.col(text).alias("comentario"))
    valid = drop_invalid(clean_texts(picked))
    return number_rows(valid, keys).select("id", "comentario", "comentario_clean")
