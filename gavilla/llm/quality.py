"""Quality rules: an isolation forest on the statistics that rules look at.

Trees cut a small sample of labelled documents by random splits; documents that few splits set apart are anomalous. The
mean path length over all trees gives a score in (0, 1), and the threshold is the one that labelled rows ask for: the
most low-quality rows rejected while ``keep`` of the good ones stay.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gavilla.llm.common import bounded_sample, free_name, strings
from gavilla.session import materialise

WORD = re.compile(r"[^ \t-\r]+")
# Characters that count as symbols, and the base rule's limits.
SYMBOLS = "#*$%&|<>"
SYMBOL = re.compile(r"[#*$%&|<>]")
# ASCII marks but for those of ordinary sentences.
MARK = np.array([33 <= c < 127 and not chr(c).isalnum() and chr(c) not in ".,:;?'-" for c in range(256)])
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# What the base rule already judges (repeated windows) and what few, chance events move (repeated lines, digits) stays out.
RATES = ["word_size", "symbol_rate", "symbol_words", "mark_rate", "bang_rate", "same_rate", "distinct_rate"]
# Counts of few, chance events are set against this many words, so that short texts do not stand out. Sizes and counts a word
# enter as logarithms, without an upper bound.
CALM = 200
SCHEMA = "struct<" + ", ".join([f"{c}: bigint" for c in BASE] + ["rates: array<float>"]) + ">"


def repeated_words(ids: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of ``window`` (a power of two) words found at two or more places.

    Windows are numbered by doubling: a pair of windows of half the length is a window, so equal numbers mean equal words.
    """
    n = len(ids)
    if n <= window:
        return 0
    names, size = ids.astype(np.int64), 1
    counts = np.zeros(1)
    while size < window:
        pair = names[: len(names) - size] * np.int64(n + 1) + names[size:]
        _, names, counts = np.unique(pair, return_inverse=True, return_counts=True)
        size *= 2
        if counts.max() == 1:
            return 0
    change = np.zeros(n + 1, dtype=np.int64)
    again = np.flatnonzero(counts[names] > 1)
    np.add.at(change, again, 1)
    np.add.at(change, again + window, -1)
    return int((np.cumsum(change[:n]) > 0).sum())


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The base counts and the rates of one whole text; all zero for a null text or one without words."""
    text = text or ""
    words = WORD.findall(text)
    n = len(words)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    base = [n, sum(map(len, words)), sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), 0]
    if not n:
        return base, [0.0] * len(RATES)
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words])
    if len(number) < n:
        base[4] = repeated_words(ids)
    chars = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    marks = int(MARK[chars].sum())
    tagged = sum(map(bool, map(SYMBOL.search, words))) if base[2] else 0
    same = int((ids[1:] == ids[:-1]).sum()) if len(number) < n else 0
    return base, [
        np.log1p(base[1] / n), np.log1p(base[2] / n), tagged / n, np.log1p(marks / n), np.log1p(text.count("!") / n),
        same / (n + CALM), distinct_rate(len(number), n),
    ]


def distinct_rate(distinct: int, n: int) -> float:
    """Distinct words of a whole text against its words, beyond CALM words against the square root at which they would grow.

    Ordinary text brings new words faster than that. More of them are no sign of anything, so the rate ends at 1 there; it
    has no lower bound, and a long text of few words falls with its length.
    """
    return min(1.0, distinct / n if n <= CALM else distinct / (n * CALM) ** 0.5)


def with_statistics(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with struct ``out`` of the base counts and rates; narrow, a few texts at a time."""

    @F.arrow_udf(SCHEMA)
    def of(texts: pa.Array) -> pa.Array:
        found = [statistics(t) for t in strings(texts)]
        columns = [pa.array([base[i] for base, _ in found], pa.int64()) for i in range(len(BASE))]
        rates = np.array([rate for _, rate in found], dtype=np.float32).reshape(-1)
        offsets = np.arange(len(found) + 1, dtype=np.int32) * len(RATES)
        columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(rates)))
        return pa.StructArray.from_arrays(columns, names=[*BASE, "rates"])

    return docs.withColumn(out, of(F.col(text).cast("string")))


def base_failed(stats: str) -> F.Column:
    words, repeated = F.col(f"{stats}.n_words"), F.col(f"{stats}.n_repeat_words")
    return (words < LEAST_WORDS) | (repeated * 100 > words * MOST_REPEATED)


# -- the forest ------------------------------------------------------------------------------------


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


class Forest:
    """Isolation trees over rates, each a full binary tree in arrays (children of i: 2i + 1, 2i + 2)."""

    def __init__(self, rows: np.ndarray, trees: int = 150, sample: int = 256, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.depth = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        size = 2 ** (self.depth + 1) - 1
        self.feature = np.full((trees, size), -1, dtype=np.int16)
        self.split = np.zeros((trees, size), dtype=np.float32)
        self.path = np.zeros((trees, size), dtype=np.float32)
        for t in range(trees):
            stack = [(0, 0, rows[rng.choice(len(rows), self.sample, replace=False)])]
            while stack:
                node, depth, part = stack.pop()
                # A side can be empty where rounding puts the split on the largest value.
                low, high = (part.min(axis=0), part.max(axis=0)) if len(part) else (np.zeros(rows.shape[1]),) * 2
                open_ = np.flatnonzero(high > low)
                if depth == self.depth or len(part) < 2 or not len(open_):
                    self.path[t, node] = depth + _expected(len(part))
                    continue
                f = rng.choice(open_)
                at = np.float32(rng.uniform(low[f], high[f]))
                right = part[:, f] > at
                self.feature[t, node], self.split[t, node] = f, at
                stack += [(2 * node + 1, depth + 1, part[~right]), (2 * node + 2, depth + 1, part[right])]

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Anomaly score in (0, 1) of each row."""
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for feature, split, path in zip(self.feature, self.split, self.path):
            node = np.zeros(len(rows), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[node]
                step = 2 * node + 1 + (rows[every, np.maximum(f, 0)] > split[node])
                node = np.where(f >= 0, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(_expected(self.sample), 1e-9))


BINS = 4096


def with_score(marked: DataFrame, forest: Forest | None, stats: str, out: str) -> DataFrame:
    """``marked`` with ``out``, the forest's score of the rates in ``stats``; 0 without a forest."""
    if forest is None:
        return marked.withColumn(out, F.lit(0.0))
    shared = marked.sparkSession.sparkContext.broadcast(forest)  # trees x 511 nodes, whatever the input

    @F.arrow_udf("double")
    def of(rates: pa.Array) -> pa.Array:
        rows = np.asarray(rates.flatten()).reshape(-1, len(RATES))
        return pa.array(np.concatenate([shared.value.score(rows[i : i + 8192]) for i in range(0, len(rows), 8192)] or [np.zeros(0)]))

    return marked.withColumn(out, of(F.col(f"{stats}.rates")))


def fit(marked: DataFrame, labels: DataFrame, stats: str, keep: float, limit: int) -> tuple[Forest | None, float]:
    """The forest and its threshold.

    The forest is fitted on at most ``limit`` labelled rows, chosen by a hash of the id. The threshold comes from a
    histogram over all labelled rows that pass the base rule: of the bins that keep at least ``keep`` of the good rows,
    the one with the best sum of the two shares. Without good or without bad rows nothing is rejected.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").select("doc_id", "quality")
    rows = marked.where(~base_failed(stats)).select("doc_id", stats).join(known, "doc_id")
    rows = materialise(rows, "labelled-rates")
    fitted = bounded_sample(rows.select("doc_id", F.col(f"{stats}.rates").alias("rates")), "doc_id", limit).toPandas()
    if len(fitted) < 2:
        return None, 1.0
    forest = Forest(np.stack(fitted.rates.to_numpy()).astype(np.float32))
    scored = with_score(rows, forest, stats, "_score")
    bins = scored.groupBy(F.floor(F.col("_score") * BINS).cast("int").alias("bin"), (F.col("quality") > 0).alias("good")).count().collect()
    counts = np.zeros((2, BINS + 1))
    for row in bins:
        counts[int(row.good), row.bin] += row["count"]
    if not counts.sum(axis=1).all():
        return forest, 1.0
    kept = np.cumsum(counts, axis=1) / counts.sum(axis=1, keepdims=True)  # share at or below each bin
    gain = np.where(kept[1] >= keep, kept[1] - kept[0], -1.0)
    return forest, float((np.argmax(gain) + 1) / BINS)


def judge(docs: DataFrame, labels: DataFrame, columns: list[str], keep: float = 0.995, limit: int = 20_000) -> tuple[DataFrame, str]:
    """``columns`` of every row of ``docs`` (doc_id, text, ...) with a struct of verdicts, whose name comes second.

    The struct holds the base counts, ``base_failed``, ``score`` and ``kept``. Texts are read once: the statistics are
    written beside the columns asked for and read again for fitting, calibration and scoring. Null and empty texts fail
    the base rule; repeated rows get the same verdict; rows without a doc_id are judged but never train.
    """
    stats = free_name(docs, "_stats")
    wanted = [F.col(f"`{c}`") for c in dict.fromkeys([*columns, "doc_id"])]
    marked = materialise(with_statistics(docs, stats).select(*wanted, stats), "quality")
    forest, threshold = fit(marked, labels, stats, keep, limit)
    score = free_name(marked, "_score")
    failed = base_failed(stats)
    verdict = F.struct(
        *[F.col(f"{stats}.{c}").alias(c) for c in BASE],
        failed.alias("base_failed"),
        F.col(score).alias("score"),
        (~failed & (F.col(score) < threshold)).alias("kept"),
    )
    scored = with_score(marked, forest, stats, score)
    return scored.select(*[F.col(f"`{c}`") for c in columns], verdict.alias(stats)), stats


def verdicts(docs: DataFrame, labels: DataFrame, keep: float = 0.995) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept of every row."""
    judged, struct = judge(docs, labels, ["doc_id"], keep)
    return judged.select("doc_id", *[f"{struct}.{c}" for c in [*BASE, "base_failed", "score", "kept"]])


def keep_good(docs: DataFrame, labels: DataFrame, keep: float = 0.995) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    judged, struct = judge(docs, labels, docs.columns, keep)
    return judged.where(F.col(f"{struct}.kept")).drop(struct)
