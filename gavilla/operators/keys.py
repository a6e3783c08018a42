"""Dense numbering, copies and joins that stay even when one key holds much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from gavilla.session import materialise

# A group above total / HOT_SLOTS rows is joined by broadcast; there are fewer than HOT_SLOTS such groups.
HOT_SLOTS = 2000
# So many rows are a light task, whatever their keys.
PLAIN = 100_000


def number_rows(df: DataFrame, keys: list[str], name: str = "id") -> DataFrame:
    """Add ``name`` = 0..n-1 in the order of the unique ``keys``.

    Range partitions are numbered on their own and shifted by the rows of the partitions before, so no
    task sees more than its range; only one count per partition is ever brought together.
    """
    spot = F.col("_spot")
    placed = materialise(
        df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_spot", F.monotonically_increasing_id()),
        "numbered",
    ).withColumn("_part", F.shiftright(spot, 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_rows"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    within = spot.bitwiseAND(F.lit((1 << 33) - 1))
    return (
        placed.join(F.broadcast(starts), "_part")
        .withColumn(name, (F.col("_start") + within).cast("bigint"))
        .drop("_spot", "_part", "_start")
    )


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Dealt evenly over the shuffle partitions by its unique ``keys``, before work that is heavy per row."""
    return df.repartition(*(keys or ("id",)))


def attach(
    members: DataFrame,
    groups: DataFrame,
    keys: list[str],
    total: int,
    size: str = "n",
    how: str = "inner",
) -> DataFrame:
    """Join each member to its group's row (one row per key, ``size`` = members in the group).

    ``groups`` must be cheap to read twice and ``total`` is the sum of ``size``. Groups over
    total / HOT_SLOTS rows, of which there are fewer than HOT_SLOTS, go by broadcast and never shuffle
    their members; what is left has no key of more than that share.
    """
    limit = max(total // HOT_SLOTS, 1)
    hot = groups.where(F.col(size) > limit).drop(size)
    cold = groups.where(F.col(size) <= limit).drop(size)
    tagged = members.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
    columns = members.columns + [c for c in groups.columns if c not in keys and c != size]
    rest = tagged.where(F.col("_hot").isNull()).select(*members.columns).join(cold, keys, how)
    return tagged.where(F.col("_hot")).select(*columns).unionByName(rest.select(*columns))


def look_up(members: DataFrame, table: DataFrame, key: str, total: int, how: str = "inner") -> DataFrame:
    """Each of ``total`` members with the one row of ``table`` for its ``key``, which any number of members may share.

    ``members`` must be cheap to read twice. Up to PLAIN of them a key cannot be large, and the join is left to Spark.
    """
    if total <= PLAIN:
        return members.join(table, key, how)
    sizes = members.groupBy(key).agg(F.count("*").alias("n"))
    return attach(members, materialise(table.join(sizes, key), "lookup"), [key], total, how=how)


def collapse_copies(df: DataFrame, key: Column, total: int | None = None) -> DataFrame:
    """(id, rep): rep is the smallest id among the rows with an equal ``key`` expression."""
    keyed = materialise(df.select("id", key.alias("_key")), "copykeys")
    groups = materialise(keyed.groupBy("_key").agg(F.min("id").alias("rep"), F.count("*").alias("n")), "copies")
    total = keyed.count() if total is None else total
    return attach(keyed, groups, ["_key"], total).select("id", "rep")


def smallest_per_group(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """First ``limit`` rows of each group.

    Spark applies the rank filter before the shuffle as well (WindowGroupLimit), so at most ``limit``
    rows per group leave a map task.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= limit)
