"""URL filter: rules first, then the ratio of two character language models.

URLs that a rule decides train a model of accepted and one of rejected URLs: Markov models of every order up to ``ORDER``,
each smoothed by the next shorter context. The difference of the log-likelihoods per character is compared with a
threshold calibrated on ruled URLs that were kept from training.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gavilla.llm.common import free_name, strings
from gavilla.session import materialise

# The rules of the registered query.
RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
ORDER = 5
SLOTS = 1 << 20  # counters of each of the four tables; grams are hashed to them, so a model never outgrows them
SHIFT = np.uint64(44)  # leaves as many bits of a hash as number the slots
STRENGTH = 2.0  # weight of the shorter context, in observations
FOLDS = 4  # one of so many parts of the ruled URLs calibrates
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS = 4096


def host_of(url: Column) -> Column:
    """Between the first :// and the next / ? or #, A-Z in lower case; empty for a null url or one without ://."""
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From the end of the host up to ? or #."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def decided(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, null if none does. Rules are a short list."""
    found = F.lit(None).cast("struct<rule: string, verdict: string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, slash, start = rule.partition("/")
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(slash + start)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


# -- the models ------------------------------------------------------------------------------------


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every character of all texts and every order 0..ORDER: slot of the gram and of its context; and text numbers.

    Bytes stand for characters; each text is preceded by ORDER zero bytes.
    """
    data = [b"\0" * ORDER + t.encode("utf-8", "surrogatepass") for t in texts]
    flat = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    text = np.repeat(np.arange(len(data)), sizes)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.flatnonzero(inside >= ORDER)
    mix, turn = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    gram, context = np.empty((ORDER + 1, len(at)), np.int64), np.empty((ORDER + 1, len(at)), np.int64)
    with np.errstate(over="ignore"):
        seen = np.zeros(len(at), dtype=np.uint64)
        for k in range(ORDER + 1):
            if k:
                seen = (seen + flat[at - k] + np.uint64(1)) * mix
            base = (seen + np.uint64(k + 1)) * turn
            context[k] = ((base ^ (base >> np.uint64(31))) * mix >> SHIFT).astype(np.int64)
            both = (base + (flat[at] + np.uint64(1)) * mix) * turn
            gram[k] = ((both ^ (both >> np.uint64(31))) * mix >> SHIFT).astype(np.int64)
    return gram, context, text[at]


def count_models(urls: DataFrame) -> np.ndarray:
    """Four tables of SLOTS counters over all rows of ``urls`` (url, accepted); tasks send at most one row per counter."""

    def count(batches):
        tables = np.zeros((4, SLOTS), dtype=np.int64)
        for batch in batches:
            accepted = np.asarray(batch.column(1))
            for side, wanted in ((0, True), (2, False)):
                texts = [t for t, a in zip(batch.column(0).to_pylist(), accepted) if a == wanted]
                if texts:
                    gram, context, _ = grams(texts)
                    tables[side] += np.bincount(gram.ravel(), minlength=SLOTS)
                    tables[side + 1] += np.bincount(context.ravel(), minlength=SLOTS)
        slot = np.flatnonzero(tables.ravel())
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), pa.array(tables.ravel()[slot])], names=["slot", "n"])

    found = urls.select("url", "accepted").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    tables = np.zeros(4 * SLOTS)
    tables[found.slot] = found.n
    return tables.reshape(4, SLOTS).astype(np.float32)


def difference(texts: list[str], tables: np.ndarray) -> np.ndarray:
    """Mean log-likelihood per character under the accepted model less that under the rejected one; 0 for an empty text."""
    gram, context, text = grams(texts)
    sums, sizes = np.zeros(len(texts)), np.maximum(np.bincount(text, minlength=len(texts)), 1)
    for sign, (of_gram, of_context) in ((1, tables[:2]), (-1, tables[2:])):
        chance = np.full(gram.shape[1], 1 / 256)
        for k in range(ORDER + 1):
            chance = (of_gram[gram[k]] + STRENGTH * chance) / (of_context[context[k]] + STRENGTH)
        sums += sign * np.bincount(text, weights=np.log(chance), minlength=len(texts))
    return sums / sizes


def with_difference(urls: DataFrame, tables: np.ndarray, url: str, out: str) -> DataFrame:
    shared = urls.sparkSession.sparkContext.broadcast(tables)  # 4 x SLOTS counters, whatever the input

    @F.arrow_udf("double")
    def of(column: pa.Array) -> pa.Array:
        held, found, size = [], [], 0
        for text in strings(column):
            held.append(text or "")
            size += len(held[-1])
            if size > 200_000:
                found.append(difference(held, shared.value))
                held, size = [], 0
        found.append(difference(held, shared.value) if held else np.zeros(0))
        return pa.array(np.concatenate(found), pa.float64())

    return urls.withColumn(out, of(F.col(url)))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, url: str = "url", out: str = "url_verdict") -> DataFrame:
    """``pages`` with struct ``out``: host, path, rule, score, verdict.

    All ruled rows count towards the models or the calibration. The threshold is the one with the best mean of the shares
    of accepted and rejected URLs judged right; without ruled URLs of both kinds every score is allowed. Null urls have
    an empty host and path and, as an empty text, the score 0. Rows that repeat get the same verdict.
    """
    text = F.col(url).cast("string")
    host, path = host_of(F.coalesce(text, F.lit(""))), path_of(F.coalesce(text, F.lit("")))
    ruled = pages.select(F.concat(host, path).alias("url"), decided(host, path, rules).alias("found")).where("found IS NOT NULL")
    ruled = ruled.select("url", (F.col("found.verdict") == "allow").alias("accepted"), F.pmod(F.xxhash64("url"), F.lit(FOLDS)).alias("fold"))
    ruled = materialise(ruled, "ruled-urls")
    tables = count_models(ruled.where("fold <> 0"))
    threshold = -np.inf
    if tables[0].any() and tables[2].any():
        scored = with_difference(ruled.where("fold = 0"), tables, "url", "score")
        bins = F.least(F.greatest(F.floor((F.col("score") + 4) * (BINS / 8)), F.lit(0)), F.lit(BINS - 1)).cast("int")
        counts = np.zeros((2, BINS))
        for row in scored.groupBy("accepted", bins.alias("bin")).count().collect():
            counts[int(row.accepted), row.bin] = row["count"]
        if counts.sum(axis=1).all():
            below = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)
            threshold = (np.argmax(below[0] - below[1]) + 1) / (BINS / 8) - 4
    joined, score, rule = (free_name(pages, c) for c in ("_joined", "_score", "_rule"))
    scored = with_difference(pages.withColumn(joined, F.concat(host, path)), tables, joined, score).withColumn(rule, decided(host, path, rules))
    verdict = F.coalesce(F.col(f"{rule}.verdict"), F.when(F.col(score) >= float(threshold), "allow").otherwise("block"))
    struct = F.struct(host.alias("host"), path.alias("path"), F.col(f"{rule}.rule").alias("rule"), F.col(score).alias("score"), verdict.alias("verdict"))
    return scored.withColumn(out, struct).drop(joined, score, rule)


def verdicts(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score of every row."""
    found = judge(pages.select("page_id", "url"), rules)
    return found.select("page_id", *[f"url_verdict.{c}" for c in ("host", "path", "rule", "verdict", "score")])
