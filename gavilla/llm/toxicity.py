"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Learning rates are kept per coordinate and L1 leaves few weights, so the model is a short list of (slot, weight) that fits
any broadcast. It is learned in a fixed number of shards from a bounded sample of labelled rows, and the shards' weights
are averaged.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import bounded_sample, free_name, strings
from gavilla.session import materialise

SLOTS = 1 << 20
WORD = re.compile(r"\w+")
KNOWN = 300_000  # words whose hash a worker remembers; fewer only cost time
THRESHOLD = 0.3
# The learners' sample: at most so many labelled rows, of texts with at most so many distinct slots (about 3,000 words),
# and about so many slots in all for each learner, which bounds its memory.
LIMIT, MOST_SLOTS, ALL_SLOTS = 30_000, 8192, 24_000_000


class Words(dict):
    """Hash of each word, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KNOWN:
            self.clear()
        data = word.encode("utf-8", "surrogatepass")
        found = self[word] = (zlib.crc32(data) << 32 | zlib.crc32(data, 0x9E3779B9)) & (2**64 - 1)
        return found


def slots(text: str | None, hashes: Words) -> np.ndarray:
    """Slots 1..SLOTS-1 of the words, pairs, triples and pairs with one word skipped; repeats included."""
    words = WORD.findall((text or "").lower())
    h = np.array([hashes[w] for w in words], dtype=np.uint64)
    one, two, three = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    with np.errstate(over="ignore"):
        pair = h[:-1] * one + h[1:] * two
        grams = [h * three, pair * three, h[:-2] * two + h[2:] * three, (pair[:-1] + h[2:] * three) * one]
        mixed = np.concatenate(grams)
        mixed ^= mixed >> np.uint64(29)
        mixed *= two
    return (mixed >> np.uint64(44)).astype(np.int64) % (SLOTS - 1) + 1


class Ftrl:
    """FTRL-proximal over binary features; slot 0 is the intercept, which L1 leaves alone."""

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 3.0, l2: float = 1.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(SLOTS), np.zeros(SLOTS)

    def _weights(self, z: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Weights of slots that begin with slot 0."""
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        shrunk[0] = z[0]
        return -shrunk / ((self.beta + root) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, np.sqrt(self.n))

    def learn(self, at: np.ndarray, label: int) -> None:
        """One row; ``at`` holds 0 and then distinct slots."""
        z, n = self.z[at], self.n[at]
        root = np.sqrt(n)
        w = self._weights(z, root)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n += g * g
        self.z[at] = z + g - (np.sqrt(n) - root) / self.alpha * w
        self.n[at] = n


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, limit: int = LIMIT, shards: int = 2, passes: int = 2) -> DataFrame:
    """(slot, weight) learned from at most ``limit`` labelled rows of ``docs`` that are not held out.

    The rows are chosen by a hash of the id, further ones are left out if their slots are more than ``shards`` times
    ``ALL_SLOTS``, and they are dealt to ``shards`` learners, each of which goes over its rows ``passes``
    times in the order of another hash. Labels are the only thing besides the text that a learner sees.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    chosen = bounded_sample(known, "doc_id", limit)
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``limit`` pairs

    @F.arrow_udf("array<int>")
    def features(texts: pa.Array) -> pa.Array:
        hashes = Words()
        return pa.array([np.unique(slots(t, hashes)).astype(np.int32) for t in strings(texts)], pa.list_(pa.int32()))

    spot = F.xxhash64("doc_id", F.lit("order"))
    seen = materialise(
        rows.select(features(F.col("text").cast("string")).alias("slots"), (F.col("toxic") > 0).cast("int").alias("label"), spot.alias("spot")),
        "toxic-features",
    ).where(F.size("slots") <= MOST_SLOTS)

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["spot", "label"], kind="stable")
        model = Ftrl()
        for _ in range(passes):
            for at, label in zip(frame.slots, frame.label):
                model.learn(np.concatenate([[0], at]).astype(np.int64), int(label))
        weights = model.weights()
        weights[0] = weights[0] or 1e-9
        at = np.flatnonzero(weights)
        return pd.DataFrame({"slot": at.astype(np.int32), "weight": weights[at]})

    held = seen.agg(F.sum(F.size("slots"))).first()[0] or 0
    share = int(min(1.0, shards * ALL_SLOTS / max(held, 1)) * (1 << 30))
    dealt = seen.where(F.pmod(F.xxhash64("spot"), F.lit(1 << 30)) < share).withColumn("shard", F.pmod("spot", F.lit(shards)))
    learned = materialise(dealt.groupBy("shard").applyInPandas(learn, "slot int, weight double"), "toxic-shards")
    # Slot 0 comes once from each shard that has rows.
    count = learned.where("slot = 0").count()
    return learned.groupBy("slot").agg((F.sum("weight") / max(count, 1)).alias("weight"))


def with_score(docs: DataFrame, weights: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with ``out`` in 0..1; 0 for all if nothing was learned. Narrow; at most SLOTS weights are broadcast."""
    found = weights.toPandas()
    if not len(found):
        return docs.withColumn(out, F.lit(0.0))
    dense = np.zeros(SLOTS, dtype=np.float32)
    dense[found.slot] = found.weight
    shared = docs.sparkSession.sparkContext.broadcast(dense)

    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        hashes, table = Words(), shared.value
        sums = []
        for t in strings(texts):
            at = slots(t, hashes)
            at = np.unique(at[table[at] != 0])
            sums.append(float(table[at].sum(dtype=np.float64)) + float(table[0]))
        return pa.array(1 / (1 + np.exp(-np.clip(np.array(sums), -35, 35))), pa.float64())

    return docs.withColumn(out, of(F.col(text).cast("string")))


def score(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``.

    Null and empty texts get the score of the intercept alone. Rows that repeat get the same score. Without labelled
    rows every score is 0. Labels of held-out ids are not read.
    """
    scored = with_score(docs.select("doc_id", "text"), fit(docs, labels, limit), "score")
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_civil(docs: DataFrame, labels: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with all their columns."""
    name = free_name(docs, "_toxicity")
    return with_score(docs, fit(docs, labels, limit), name).where(F.col(name) < THRESHOLD).drop(name)
