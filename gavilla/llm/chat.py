"""Chat formatting by quotation linking: DataFrame functions only.

Quoted lines are told by their level, their normalised text is hashed and joined to the message that said it first, and a
message replies to the one that most of its outermost quotes come from; without quotes it goes on from the turn before.
Following the replies gives each message its thread, its depth and its place in a reply-ordered conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gavilla.operators.keys import attach
from gavilla.session import materialise, release

QUOTE = r"^ {0,3}>[> ]*"
# Fixed value: a line that only says who is quoted.
ATTRIBUTION = r"^[^>].*(?:wrote|writes|said|says|schrieb|a écrit|escribió) ?:\s*$"


def level_of(line: Column) -> Column:
    """Number of quote marks that a line starts with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTE, 0), "[^>]", ""))


def normalised(line: Column) -> Column:
    """The line without quote marks, in lower case, each run of other characters than letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, QUOTE, "")), r"[^\p{L}\p{N}]+", " "))


def own_text(text: Column) -> Column:
    """The message without quoted lines and the attributions before them, trimmed."""
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x, i: ~x.rlike(QUOTE) & ~(x.rlike(ATTRIBUTION) & F.coalesce(F.get(lines, i + 1).rlike(QUOTE), F.lit(False))))
    return F.regexp_replace(F.array_join(kept, "\n"), r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def _lines(turns: DataFrame) -> DataFrame:
    lines = turns.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn", F.explode(F.split("text", "\n")).alias("line"))
    hashed = lines.select("conv_id", "turn", level_of(F.col("line")).alias("level"), normalised(F.col("line")).alias("norm"))
    return hashed.where("norm <> ''").select("conv_id", "turn", "level", F.xxhash64("norm").alias("hash"))


def quote_links(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, n_quotes, quote_levels, n_linked, quoted_turn) of the turns that quote.

    Each distinct quoted line goes to the first message of the conversation that said it, if that is an earlier one;
    ``quoted_turn`` is where most lines of the outermost level come from, the latest of several. A line that very many
    messages say is one row here, since only its first is kept.
    """
    lines = materialise(_lines(turns).distinct(), "lines")
    quotes = materialise(lines.where("level > 0"), "quotes")
    said = lines.where("level = 0").groupBy("conv_id", "hash").agg(F.min("turn").alias("first"))
    asked = quotes.groupBy("conv_id", "hash").agg(F.count("*").alias("n"))
    groups = materialise(asked.join(said, ["conv_id", "hash"]), "sayings")
    total = groups.agg(F.sum("n")).first()[0] or 0
    linked = attach(quotes, groups, ["conv_id", "hash"], total, "n").where("first < turn")
    votes = linked.groupBy("conv_id", "turn", "level", "first").agg(F.count("*").alias("votes"))
    best = votes.groupBy("conv_id", "turn").agg(
        F.sum("votes").alias("n_linked"), F.max(F.struct(-F.col("level"), F.col("votes"), F.col("first"))).alias("best")
    )
    counts = quotes.groupBy("conv_id", "turn").agg(F.count("*").alias("n_quotes"), F.max("level").cast("bigint").alias("quote_levels"))
    best = best.select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "n_linked", F.col("best.first").alias("quoted_turn"))
    same = (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t"))
    return counts.join(best, same, "left").drop("c", "t")


def threads(parents: DataFrame) -> DataFrame:
    """(conv_id, turn, thread, depth) of distinct (conv_id, turn, parent): the root of each message and the steps to it.

    Each round joins a message with what its ancestor so far has reached, so the steps double; messages that have reached
    their root take no more part.
    """
    reach = materialise(
        parents.select(
            "conv_id", "turn", F.coalesce("parent", "turn").alias("up"),
            F.col("parent").isNotNull().cast("bigint").alias("steps"), F.col("parent").isNotNull().alias("open"),
        ),
        "reach",
    )
    while not reach.where("open").isEmpty():
        above = reach.select(
            F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still")
        )
        moved = reach.where("open").join(above, (F.col("conv_id") == F.col("c")) & (F.col("up") == F.col("t"))).select(
            "conv_id", "turn", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open")
        )
        farther = materialise(moved.unionByName(reach.where("NOT open")), "reach")
        release(reach)
        reach = farther
    return reach.select("conv_id", "turn", F.col("up").alias("thread"), F.col("steps").alias("depth"))


def reply_ordered(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, reply_to, thread, depth, n_quotes, quote_levels, n_linked, message of every row.

    ``text`` is the message without quotes; ``message`` is it in chat form. Rows ordered by (conv_id, thread, depth, turn)
    are the reply-ordered conversation: each message comes after the one it replies to. ``reply_to`` is the quoted turn,
    else the turn before if there is one, else null (the message starts a thread). A conversation is never brought
    together in one row or task. Null texts are empty; rows that repeat (conv_id, turn) share its place, and their lines
    count together; rows without conv_id or turn have no place (thread and depth null).
    """
    told = turns.select("conv_id", "turn", "role", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    links = materialise(quote_links(told), "quote-links")
    nodes = told.where("conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", "turn").distinct()
    before = nodes.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("turn").alias("before"))
    linked = nodes.join(before, ["conv_id", "turn"], "left").join(links, ["conv_id", "turn"], "left")
    linked = materialise(linked.withColumn("parent", F.coalesce("quoted_turn", "before")), "replies")
    placed = linked.join(threads(linked), ["conv_id", "turn"])
    own = told.withColumn("text", own_text(F.col("text")))
    count = lambda name: F.coalesce(name, F.lit(0)).cast("bigint").alias(name)
    return own.join(placed, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", F.col("parent").alias("reply_to"), "thread", "depth",
        count("n_quotes"), count("quote_levels"), count("n_linked"),
        F.concat(F.lit("<|"), F.coalesce("role", F.lit("user")), F.lit("|>\n"), "text", F.lit("\n<|end|>")).alias("message"),
    )
