"""Benchmark decontamination by templates: DataFrame functions only.

Numbers, units and names become typed placeholders, so a question keeps its template when its parameters are changed.
Windows of template tokens are hash-joined with those of the benchmark. Windows without placeholders always count; those
with them count only if the slots are consistent: along one alignment, equal values stand for equal values and different
for different.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavilla.llm.common import free_name
from gavilla.session import materialise

WINDOW = 8  # tokens of a window
LEAST_ITEM = 4  # an item of fewer tokens is no passage and never matches
LEAST_PLAIN = 4  # tokens of a window that are no placeholders; of a shorter one, all but half
COVERAGE = 0.3  # share of an item's windows that a document must hold
BROADCAST_ROWS = 500_000  # benchmark windows that are broadcast (16 bytes each); more are joined by a shuffle

# Units that may follow a number.
UNITS = (
    "mm|cm|dm|m|km|in|inch|inches|ft|feet|yd|mi|mile|miles|mg|g|kg|t|lb|lbs|oz|ml|cl|dl|l|s|sec|min|h|hr|hrs|hour|hours|"
    "day|days|week|weeks|month|months|year|years|km/h|mph|m/s|usd|eur|gbp|dollars|euros|percent|degrees|kb|mb|gb|tb|hz|khz|"
    "mhz|ghz|w|kw|mw|v|kv|a|ma|j|kj|cal|kcal|pa|kpa|c|f|k"
)
# A placeholder token starts with \x01 and its type (n, u, p); \x03 stands for a mark inside a number.
SPLIT = r"[^\p{L}\p{N}\p{M}\x{01}\x{03}]+"


def marked(text: Column) -> Column:
    """The text in lower case with \\x01n before numbers, \\x01u before their units and \\x01p before names.

    A name is a capitalised word after a space that follows a letter, digit, comma or the like, so that it does not start
    a sentence. White space is folded first, so a text that is wrapped otherwise has the same names.
    """
    t = F.coalesce(text.cast("string"), F.lit(""))
    t = F.when(t.rlike("[\x01-\x03]"), F.translate(t, "\x01\x02\x03", "   ")).otherwise(t)
    t = F.when(t.rlike(r"[\t-\r]|  "), F.regexp_replace(t, r"[\t-\r ]+", " ")).otherwise(t)
    joined = F.regexp_replace(F.regexp_replace(t, r"([0-9])[.,]([0-9])", "$1\x03$2"), r"([0-9])[.,]([0-9])", "$1\x03$2")
    number = r"([0-9][0-9\x{03}]*)(?: ?((?i)" + UNITS + r")([^\p{L}\p{N}\x{03}]|$))?"
    numbers = F.regexp_replace(joined, number, " \x01n$1 \x01u$2 $3")
    numbers = F.regexp_replace(numbers, "\x01u ", " ")
    t = F.when(t.rlike("[0-9]"), numbers).otherwise(t)
    return F.lower(F.regexp_replace(t, r"\p{Lu}(?<=[\p{L}\p{N},;)\"'] .)\p{Ll}+", "\x01p$0"))


def tokens(text: Column) -> Column:
    """Tokens of a text; the first or last one is empty if marks stand there."""
    return F.split(text, SPLIT)


def template(text: Column) -> Column:
    """Marked text with the values of its placeholders left out; it has as many tokens."""
    return F.regexp_replace(text, r"\x{01}([nup])[\p{L}\p{N}\p{M}\x{03}]*", "\x01$1")


def window_hashes(names: Column, size: int) -> Column:
    """Hash of each window of ``size`` tokens, in order; an empty array for fewer tokens."""
    starts = F.sequence(F.lit(1), F.size(names) - (size - 1))
    return F.when(F.size(names) >= size, F.transform(starts, lambda i: F.xxhash64(F.slice(names, i, size)))).otherwise(
        F.array().cast("array<bigint>")
    )


def _is_slot(token: Column) -> Column:
    return token.startswith("\x01")


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, size, at, hash, n_windows) of every window that has enough plain tokens.

    Windows have ``WINDOW`` tokens, those of a shorter item all of its tokens.
    """
    named = benchmark.where("item_id IS NOT NULL").select("item_id", tokens(template(marked(F.col("text")))).alias("names"))
    named = named.withColumn("names", F.array_remove("names", ""))
    named = named.distinct().where(F.size("names") >= LEAST_ITEM).withColumn("size", F.least(F.lit(WINDOW), F.size("names")))
    starts = F.sequence(F.lit(1), F.size("names") - F.col("size") + 1)
    windows = named.select("item_id", "size", "names", F.posexplode(starts).alias("at", "start")).select(
        "item_id", "size", "at", F.slice("names", F.col("start"), F.col("size")).alias("window")
    )
    plain = F.size(F.filter("window", lambda x: ~_is_slot(x)))
    windows = windows.where(plain >= F.least(F.lit(LEAST_PLAIN), F.ceil(F.col("size") / 2)))
    hashed = windows.select("item_id", "size", "at", F.xxhash64("window").alias("hash"), F.exists("window", _is_slot).alias("slots"))
    total = hashed.groupBy(F.col("item_id").alias("item")).agg(F.countDistinct("at").alias("n_windows"))
    return hashed.join(total, F.col("item_id") == F.col("item")).drop("item")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_matched, n_windows, coverage, changed) of documents that hold a benchmark passage.

    ``coverage`` is the share of the item's windows found in the whole text, those with slots along consistent alignments, at
    least ``COVERAGE``; ``changed`` tells whether a counted slot holds another value than the item's. Null and empty texts and
    items of fewer than ``LEAST_ITEM`` tokens match nothing, nor do rows without an id; repeated rows count once. Windows
    are joined by hash: the benchmark's by broadcast up to ``BROADCAST_ROWS`` rows, else by a shuffle.
    """
    wanted = materialise(benchmark_windows(benchmark), "benchmark-windows")
    rows, sizes = wanted.count(), [r.size for r in wanted.select("size").distinct().collect()]
    small = F.broadcast if rows <= BROADCAST_ROWS else lambda df: df
    names = docs.where("doc_id IS NOT NULL").select("doc_id", tokens(template(marked(F.col("text")))).alias("names"))
    found = None
    for size in sorted(sizes):
        hashes = names.select("doc_id", F.posexplode(window_hashes(F.col("names"), size)).alias("place", "hash"))
        item = wanted.where(F.col("size") == size).select("item_id", "at", "hash", "slots", "n_windows")
        hit = hashes.join(small(item), "hash").select("doc_id", "item_id", "place", "at", "slots", "n_windows", F.lit(size).alias("size"))
        found = hit if found is None else found.unionByName(hit)
    if found is None:
        return docs.sparkSession.createDataFrame(
            [], f"doc_id {dict(docs.dtypes)['doc_id']}, item_id {dict(benchmark.dtypes)['item_id']}, n_matched bigint, n_windows bigint, coverage double, changed boolean"
        )
    found = materialise(found, "window-matches").withColumn("shift", F.col("place") - F.col("at"))
    lines = found.groupBy("doc_id", "item_id", "shift").agg(
        F.collect_set("at").alias("at"), F.max("n_windows").alias("n_windows"), F.max("size").alias("size"), F.max("slots").alias("slots"),
        F.collect_set(F.when(~F.col("slots"), F.col("at"))).alias("literal"),
    )
    lines = materialise(lines, "alignments")
    checked = lines.where(F.size("literal") > 0).select("doc_id", "item_id", F.col("literal").alias("at"), "n_windows", F.lit(False).alias("changed"))
    checked = checked.unionByName(_consistent(lines.where("slots"), docs, benchmark))
    total = checked.groupBy("doc_id", "item_id").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("bigint").alias("n_matched"),
        F.max("n_windows").alias("n_windows"),
        F.max("changed").alias("changed"),
    )
    coverage = F.col("n_matched") / F.col("n_windows")
    return total.withColumn("coverage", coverage).where(F.col("coverage") >= COVERAGE).select(
        "doc_id", "item_id", "n_matched", "n_windows", "coverage", "changed"
    )


def _consistent(lines: DataFrame, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The alignments whose slot values correspond one to one.

    Only their documents are read again; a document's tokens meet an alignment in a row of their own.
    """
    values = tokens(marked(F.col("text")))
    some = lines.select("doc_id").distinct()
    theirs = docs.join(some, "doc_id", "left_semi").select("doc_id", values.alias("theirs")).distinct()
    ours = benchmark.select("item_id", F.array_remove(values, "").alias("ours")).distinct()
    covered = F.array_distinct(F.flatten(F.transform("at", lambda a: F.sequence(a, a + F.col("size") - 1))))
    # (ours, theirs) at each covered place that holds a placeholder.
    pairs = F.transform(
        covered, lambda p: F.struct(F.get("ours", p.cast("int")).alias("a"), F.get("theirs", (p + F.col("shift")).cast("int")).alias("b"))
    )
    pairs = F.array_distinct(F.filter(pairs, lambda x: _is_slot(x["a"])))
    met = lines.join(theirs, "doc_id").join(ours, "item_id").withColumn("pairs", pairs)
    one = (F.size(F.array_distinct(F.transform("pairs", lambda x: x["a"]))) == F.size("pairs")) & (
        F.size(F.array_distinct(F.transform("pairs", lambda x: x["b"]))) == F.size("pairs")
    )
    return met.where(one).select("doc_id", "item_id", "at", "n_windows", F.exists("pairs", lambda x: x["a"] != x["b"]).alias("changed"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark passage, with all their columns; rows without an id stay."""
    name = free_name(docs, "_leak")
    leaks = matches(docs.select("doc_id", "text"), benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaks, F.col("doc_id") == F.col(name), "left_anti")
