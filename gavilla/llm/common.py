"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def free_name(df: DataFrame, base: str) -> str:
    """``base``, lengthened until no column of ``df`` has that name (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def per_process(key: object, make: Callable[[], object]) -> object:
    """``make()`` once per Python worker process; later tasks of that process get the same object."""
    store = sys.modules.setdefault("gavilla_worker_objects", types.ModuleType("gavilla_worker_objects")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


def strings(array: pa.Array, step: int = 256) -> Iterator[str | None]:
    """Python strings of an Arrow column, a few rows at a time so that long texts are not all copied at once."""
    for start in range(0, len(array), step):
        yield from array.slice(start, step).to_pylist()


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About ``limit`` rows (never more) of ``df``, chosen by a hash of ``key``: the same rows on every run."""
    total = df.count()
    if total <= limit:
        return df
    # 3 % over the share keeps the count near the limit; the limit itself then binds only by chance.
    share = int(1.03 * limit / total * (1 << 30))
    spot = F.xxhash64(F.col(key), F.lit("sample"))
    return df.where(F.pmod(spot, F.lit(1 << 30)) < share).orderBy(spot, key).limit(limit)
