"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Grams of one to four characters inside space-padded words are hashed to a fixed number of slots. Document frequencies are
counted over all documents that may be learned from; the weights are learned by follow-the-regularised-leader with L1 and
L2 penalties on a bounded sample of them, and a temperature, set on rows the learners did not see, makes the scores
probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import per_process, strings
from gavilla.session import materialise

BITS = 16
SLOTS = 1 << BITS
GRAMS = 4
# Characters that a kernel works on at a time; longer texts come in overlapping blocks, so memory does not grow with them.
BLOCK = 1 << 20
# The learners' sample: about so many rows in all, shared out evenly over the languages, of texts with at most so many
# distinct slots; a tenth of it sets the temperature.
LIMIT, MOST_SLOTS = 12_000, 20_000
UNKNOWN = "und"

# Fixed odd multipliers of a gram's characters, and one for the last mixing step.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)
MIX = 0xFF51AFD7ED558CCD


def _letters() -> np.ndarray:
    """For each code point: itself if it is a letter, else 0."""
    return np.array([c if chr(c).isalpha() else 0 for c in range(0x110000)], dtype=np.uint32)


def _padded(text: str) -> Iterator[np.ndarray]:
    """Code points of the lower-cased letters, words apart and padded by a single 0, in overlapping blocks."""
    letters = per_process("letters", _letters)
    carry = np.zeros(1, np.uint32)
    for start in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[start : start + BLOCK].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = np.concatenate([carry, letters[codes]])
        last = start + BLOCK >= len(text)
        if last:
            codes = np.append(codes, np.uint32(0))
        codes = codes[np.append(True, (codes[1:] != 0) | (codes[:-1] != 0))]
        yield codes
        # What the next block needs: the last GRAMS - 1 characters; grams that lie wholly in them are not counted again.
        carry = codes[-(GRAMS - 1) :]


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(slots, counts) of the hashed grams; both empty if the text has no letter."""
    total, old = None, 0
    for codes in _padded(text or ""):
        h, found = codes.astype(np.uint64), []
        with np.errstate(over="ignore"):
            mixed = np.zeros(len(h), np.uint64)
            for size in range(1, GRAMS + 1):
                mixed = mixed[: len(h) - size + 1] + (h[size - 1 :] + np.uint64(size)) * np.uint64(MULTIPLIERS[size - 1])
                hashed = mixed ^ (mixed >> np.uint64(31))
                hashed = (hashed * np.uint64(MIX)) >> np.uint64(64 - BITS)
                # A gram of one character that is no letter says nothing; grams wholly in the carried part were counted.
                from_here = max(old - size + 1, 0)
                found.append(hashed[from_here:][h[from_here:] != 0] if size == 1 else hashed[from_here:])
        counts = np.bincount(np.concatenate(found).astype(np.int64), minlength=SLOTS) if len(codes) > 2 or h.any() else None
        if counts is not None:
            total = counts if total is None else total + counts
        old = min(GRAMS - 1, len(codes))
    if total is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.flatnonzero(total != 0)
    return at, total[at]


def tfidf(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sublinear counts times ``idf``, of unit length."""
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt((x * x).sum())


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


class Multinomial:
    """FTRL-proximal for softmax regression: a rate for each coordinate, L1 and L2 penalties; the intercept is penalised too."""

    def __init__(self, classes: int, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last row is the intercept.
        self.z, self.n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def _weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def weights(self) -> np.ndarray:
        return self._weights(self.z, self.n)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        """One row: slots ``at`` (the intercept's included) with values ``x``."""
        z, n = self.z[at], self.n[at]
        w = self._weights(z, n)
        g = x[:, None] * (softmax(x @ w) - (np.arange(z.shape[1]) == label))
        after = n + g * g
        self.z[at] = z + g - (np.sqrt(after) - np.sqrt(n)) / self.alpha * w
        self.n[at] = after


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max())
    return e / e.sum()


def held_out(doc_id: F.Column) -> F.Column:
    """Whether crc32 of the id as text leaves 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _with_bias(at: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.append(at, SLOTS), np.append(x, 1.0)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents with each slot) over all rows of ``docs`` (text). At most SLOTS + 1 sums are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in batches:
            for text in strings(batch.column(0)):
                total[gram_counts(text)[0]] += 1
            total[SLOTS] += batch.num_rows
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["slot", "df"])

    sums = np.zeros(SLOTS + 1, np.int64)
    found = docs.select("text").mapInArrow(count, "slot int, df bigint").groupBy("slot").agg(F.sum("df").alias("df")).toPandas()
    sums[found["slot"]] = found["df"]
    return int(sums[SLOTS]), sums[:SLOTS]


class Model(NamedTuple):
    """Languages, idf, weights and temperature: some 0.8 MB for each language."""

    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0


def logits(text: str | None, idf: np.ndarray, weights: np.ndarray) -> np.ndarray:
    at, counts = gram_counts(text)
    if not len(at):
        return weights[SLOTS]
    return tfidf(at, counts, idf) @ weights[at] + weights[SLOTS]


# Temperatures tried: from 1/32 to 32 in steps of a sixteenth of an octave.
TEMPERATURES = 2.0 ** (np.arange(-80, 81) / 16)


def fit(docs: DataFrame, limit: int = LIMIT, shards: int = 2, passes: int = 2) -> Model | None:
    """The model learned from the rows of ``docs`` that have a language and are not held out; None if there are none.

    Document frequencies count all of these rows. The learners see about ``limit`` of them: each language gives an equal
    share (all its rows if it has fewer), chosen by a hash of the id and taken in the order of another. Nine tenths are dealt
    to ``shards`` learners, whose weights are averaged; the last tenth sets the temperature by its least log loss.
    """
    spark = docs.sparkSession
    known = docs.where("lang IS NOT NULL").where(~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return None
    n, df = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    spot = F.xxhash64("doc_id", F.lit("language"))
    quota = limit / len(langs)
    shares = spark.createDataFrame([(lang, i, int(min(1.0, quota / sizes[lang]) * (1 << 30))) for i, lang in enumerate(langs)], "lang string, label int, share long")
    rows = known.select("text", "lang", spot.alias("spot")).join(F.broadcast(shares), "lang").where(F.pmod("spot", F.lit(1 << 30)) < F.col("share"))
    shared_idf = spark.sparkContext.broadcast(idf)

    @F.arrow_udf("struct<at:array<int>,x:array<float>>")
    def features(texts: pa.Array) -> pa.Array:
        out = []
        for text in strings(texts):
            at, counts = gram_counts(text)
            out.append({"at": at.astype(np.int32), "x": tfidf(at, counts, shared_idf.value).astype(np.float32)} if len(at) else {"at": [], "x": []})
        return pa.array(out, pa.struct([("at", pa.list_(pa.int32())), ("x", pa.list_(pa.float32()))]))

    order = F.xxhash64("spot", F.lit("order"))
    seen = rows.select("label", order.alias("spot"), features(F.col("text").cast("string")).alias("f")).select("label", "spot", "f.at", "f.x")
    seen = materialise(seen, "language-features").where(F.size("at").between(1, MOST_SLOTS))
    role = F.pmod("spot", F.lit(10))

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["spot", "label"], kind="stable")
        model = Multinomial(len(langs))
        for _ in range(passes):
            for at, x, label in zip(frame["at"], frame["x"], frame["label"]):
                model.learn(*_with_bias(at, x), int(label))
        weights = model.weights()
        slot, label = np.nonzero(weights)
        return pd.DataFrame({"slot": slot.astype(np.int32), "label": label.astype(np.int32), "weight": weights[slot, label]})

    dealt = seen.where(role < 9).withColumn("shard", F.pmod(F.shiftright("spot", 20), F.lit(shards)))
    learned = materialise(dealt.groupBy("shard").applyInPandas(learn, "slot int, label int, weight double"), "language-shards")
    learners = max(dealt.select("shard").distinct().count(), 1)
    weights = np.zeros((SLOTS + 1, len(langs)))
    # At most (SLOTS + 1) x languages sums, most of them absent.
    found = learned.groupBy("slot", "label").agg((F.sum("weight") / learners).alias("weight")).toPandas()
    weights[found["slot"], found["label"]] = found["weight"]
    return Model(langs, idf, weights, temperature(seen.where(role == 9), weights))


def temperature(rows: DataFrame, weights: np.ndarray) -> float:
    """The one of TEMPERATURES with the least log loss over ``rows`` (label, at, x); 1 without rows."""
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(len(TEMPERATURES)), False
        for batch in batches:
            for label, at, x in zip(*[batch.column(i).to_pylist() for i in range(3)]):
                at, x = _with_bias(np.array(at), np.array(x))
                scaled = (x @ shared.value[at])[None] / TEMPERATURES[:, None]
                top = scaled.max(axis=1)
                total += top + np.log(np.exp(scaled - top[:, None]).sum(axis=1)) - scaled[:, label]
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["i", "loss"])

    found = rows.select("label", "at", "x").mapInArrow(losses, "i int, loss double").groupBy("i").agg(F.sum("loss").alias("loss")).toPandas()
    # Of equal losses the temperature nearest to 1.
    tried = sorted(zip(found["loss"].round(9), np.abs(np.log(TEMPERATURES[found["i"]])), TEMPERATURES[found["i"]]))
    return float(tried[0][2]) if tried else 1.0


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``guess`` (lang_pred, score). Narrow; the model is broadcast."""
    if model is None:
        return docs.withColumn("guess", F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score")))
    shared = docs.sparkSession.sparkContext.broadcast(tuple(model))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def guess(texts: pa.Array) -> pa.Array:
        names, idf, weights, heat = shared.value
        langs, scores = [], []
        for t in strings(texts):
            if has_letter(t):
                p = softmax(logits(t, idf, weights) / heat)
                best = int(p.argmax())
                langs.append(names[best])
                scores.append(float(p[best]))
            else:
                langs.append(UNKNOWN)
                scores.append(0.0)
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return docs.withColumn("guess", guess(F.col(text).cast("string")))


def identify(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs`` (doc_id, text, lang).

    A null text, or one without a letter, gives ``und`` with score 0, and so does every row if there is nothing to learn
    from. Of equal scores the language that sorts first is taken. Rows that repeat get the same result; a null id is not held
    out. The language column is read only where rows are learned from.
    """
    own = docs.select("doc_id", "text", "lang")
    guessed = predict(own.select("doc_id", "text"), fit(own, limit))
    return guessed.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "guess.lang_pred", "guess.score")
