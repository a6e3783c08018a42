"""Prefix trie of conversations by the Euler-tour technique.

Conversations are rebuilt on the shared start of their block. A sequence of turns is known by the sum of one digest for
each (place, role, text), so prefixes are running sums, which range partitions and their totals give however long a
conversation is. Equal sums of a depth are one node. Each node then has an arc in and an arc out; an arc's follower is known
from the node's children and siblings, the arcs are ranked as a linked list, and what a subtree holds is the difference of
two prefix sums at the places of the node's arcs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from gavilla.operators.keys import attach, number_rows
from gavilla.session import materialise, settle

# Conversations of one block start alike, by up to STARTS - 1 turns.
BLOCK, STARTS = 100, 6
# Sums of digests are taken modulo 2^60, in two halves.
HALF = 60
# One in SPLIT arcs is a station of the next coarser list; a list of at most SMALL arcs is ranked in one piece.
SPLIT, SMALL = 24, 4096
# Ids of one packed row of ends.
PACK = 2048


# -- running sums over range partitions --------------------------------------------------------------


def running_sums(df: DataFrame, keys: list[str], values: list[str], modulus: int | None = None) -> DataFrame:
    """``df`` in the order of its unique ``keys`` with ``sum_<value>``: the sum of each of ``values`` up to and with the row.

    Partitions are summed on their own and shifted by the totals of those before, so no task sees more than its range.
    ``modulus`` keeps sums below it; values must then be so too.
    """
    part = F.spark_partition_id()
    placed = df.repartitionByRange(*keys).withColumn("_part", part).sortWithinPartitions(*keys)
    schema = StructType([*placed.schema.fields, *(StructField(f"sum_{v}", LongType()) for v in values)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = dict.fromkeys(values, 0)
        for batch in batches:
            out = list(batch.columns)
            for v in values:
                x = batch.column(batch.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                if modulus:
                    # Sums of 2^60 leave 64 bits after eight rows; they wrap round there, which a power of two does not mind.
                    sums = ((np.cumsum(x.astype(np.uint64)) + np.uint64(last[v])) % np.uint64(modulus)).astype(np.int64)
                else:
                    sums = np.cumsum(x) + last[v]
                last[v] = int(sums[-1]) if len(sums) else last[v]
                out.append(pa.array(sums))
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, *(f"sum_{v}" for v in values)])

    summed = materialise(placed.mapInArrow(add, schema), "running")
    # One row a partition.
    totals = summed.groupBy("_part").agg(*[F.sum(F.col(v).cast("decimal(38,0)")).alias(v) for v in values])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = lambda v: F.coalesce(F.sum(v).over(before), F.lit(0))
    cut = lambda c: (c % F.lit(modulus) if modulus else c).cast("bigint")
    starts = totals.select("_part", *[cut(shift(v)).alias(f"_start_{v}") for v in values])
    shifted = summed.join(F.broadcast(starts), "_part")
    return shifted.withColumns({f"sum_{v}": cut(F.col(f"sum_{v}") + F.col(f"_start_{v}")) for v in values}).drop(
        "_part", *[f"_start_{v}" for v in values]
    )


# -- rebuilt conversations ---------------------------------------------------------------------------


def digest_halves(c: Column) -> tuple[Column, Column]:
    """Two numbers below 2^60 from the SHA-256 of a string."""
    hexed = F.sha2(c, 256)
    half = lambda at: F.conv(F.substring(hexed, at, HALF // 4), 16, 10).cast("bigint")
    return half(1), half(1 + HALF // 4)


def rebuilt_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, place, said, n_chars) of every rebuilt turn, (conv_id, turns) of every conversation, turnless ones too).

    Turns are ordered by turn (null first), equal ones by ``said``; rows that repeat are so many turns. ``said`` is the
    hash of role and text. Rows without a conv_id belong to no conversation.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("said"),
        role.alias("role"), F.substring(text, 1, 64).alias("head"), F.length(text).cast("bigint").alias("n_chars"),
    )
    numbered = number_rows(turns.select("conv_id", "turn", "said", "n_chars"), ["conv_id", "turn", "said"], "spot")
    numbered = materialise(numbered, "turns")
    own = materialise(numbered.groupBy("conv_id").agg(F.min("spot").alias("first"), F.count("*").alias("n")), "owners")
    total = numbered.count()
    shared = F.crc32(F.col("conv_id").cast("string").cast("binary")) % STARTS
    base = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_turns"))
    own = own.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BLOCK, "shared": shared}).join(base, "base", "left")
    # At most BLOCK conversations of either sign refer to one base.
    own = own.select("conv_id", "base", "first", "n", "shared", F.least("shared", F.coalesce("base_turns", F.lit(0))).alias("lent"))
    own = materialise(own, "owners").withColumn("turns", F.col("lent") + F.greatest(F.col("n") - F.col("shared"), F.lit(0)))
    placed = attach(numbered, own.select("conv_id", "n", "first", "shared", "lent"), ["conv_id"], total)
    placed = placed.withColumn("at", F.col("spot") - F.col("first"))
    kept = placed.where("at >= shared").select("conv_id", (F.col("at") - F.col("shared") + F.col("lent")).alias("place"), "said", "n_chars")
    heads = placed.where(F.col("at") < STARTS - 1).where(F.col("conv_id") % BLOCK == 0).select(F.col("conv_id").alias("base"), "at", "said", "n_chars")
    lent = own.where("lent > 0").select("conv_id", "base", "lent").join(heads, "base").where("at < lent")
    rebuilt = kept.unionByName(lent.select("conv_id", F.col("at").alias("place"), "said", "n_chars"))
    return rebuilt, own.select("conv_id", "turns")


def trie_nodes(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends): depth, the node's key (a, b) and its parent's (pa, pb), conv_id, n_convs and n_chars; and (depth, a, b, conv_id) of each conversation's last node.

    The root, of depth 0 and key (0, 0), has no parent.
    """
    rebuilt, own = rebuilt_turns(conversations)
    a, b = digest_halves(F.concat_ws(":", F.col("place").cast("string"), "said"))
    terms = rebuilt.select("conv_id", "place", "n_chars", a.alias("a"), b.alias("b"))
    sums = materialise(running_sums(terms, ["conv_id", "place"], ["a", "b"], 1 << HALF), "prefixes")
    # What was summed before a conversation begins.
    starts = sums.groupBy("conv_id").agg(F.count("*").alias("n"), F.min(F.struct("place", "sum_a", "a", "sum_b", "b")).alias("f"))
    less = lambda x, y: F.pmod(x - y, F.lit(1 << HALF))
    starts = materialise(starts.select("conv_id", "n", F.col("n").alias("turns"), less(F.col("f.sum_a"), F.col("f.a")).alias("from_a"), less(F.col("f.sum_b"), F.col("f.b")).alias("from_b")), "starts")
    keyed = attach(sums, starts, ["conv_id"], sums.count()).select(
        "conv_id", (F.col("place") + 1).alias("depth"), "n_chars", less(F.col("sum_a"), F.col("from_a")).alias("a"), less(F.col("sum_b"), F.col("from_b")).alias("b"),
        F.col("a").alias("last_a"), F.col("b").alias("last_b"), "turns",
    )
    keyed = materialise(keyed, "keyed")
    nodes = keyed.groupBy("depth", "a", "b").agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars"),
        F.min("last_a").alias("last_a"), F.min("last_b").alias("last_b"),
    )
    nodes = nodes.select("depth", "a", "b", less(F.col("a"), F.col("last_a")).alias("pa"), less(F.col("b"), F.col("last_b")).alias("pb"), "conv_id", "n_convs", "n_chars")
    nothing = F.lit(None).cast("bigint")
    root = own.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0").select(
        F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
        nothing.alias("pa"), nothing.alias("pb"), "conv_id", "n_convs", F.lit(0).cast("bigint").alias("n_chars"),
    )
    ends = keyed.where("depth = turns")
    turnless = own.where("turns = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"), "conv_id")
    return nodes.unionByName(root), ends.select("depth", "a", "b", "conv_id").unionByName(turnless)


# -- list ranking ------------------------------------------------------------------------------------


def _rank_small(arcs: pd.DataFrame) -> pd.DataFrame:
    """(arc, rank) of a bounded list (arc, to, hops) by pointer doubling: hops from each arc to the end."""
    at = {arc: i for i, arc in enumerate(arcs["arc"])}
    to = np.array([at.get(t, -1) if t is not None and t == t else -1 for t in arcs["to"]])
    hops = arcs["hops"].to_numpy(np.int64).copy()
    while (to >= 0).any():
        live = to >= 0
        hops[live] += hops[to[live]]
        to[live] = to[to[live]]
    return pd.DataFrame({"arc": arcs["arc"], "rank": hops})


def list_rank(arcs: DataFrame, level: int = 0, small: int = SMALL) -> DataFrame:
    """(arc, rank): the hops from each arc to the end of the list (arc, to, hops), whose last arc has a null ``to``.

    One in SPLIT arcs, by a hash, is a station. Pointers double, as far as the next station, until every arc knows the
    station ahead and the way there; only arcs on their way are joined, so after a few rounds there are few. The stations are
    a list again, ranked in the same way, and the others add their rank. A list of at most ``small`` arcs is one bounded group.
    """
    if arcs.count() <= small:
        return arcs.groupBy(F.lit(0).alias("g")).applyInPandas(_rank_small, "arc bigint, rank bigint")
    stop = lambda c: F.pmod(F.xxhash64(c, F.lit(level)), F.lit(SPLIT)) == 0
    here = materialise(arcs.select("arc", "to", "hops", (F.col("to").isNull() | stop("to")).alias("there")), "list")
    settled = []
    while True:
        settled.append(here.where("there"))
        away = here.where("NOT there")
        if away.isEmpty():
            break
        # An arc that has arrived hands on its station, one on its way the place it has reached.
        ahead = here if len(settled) == 1 else here.unionByName(reduce_union(settled[:-1]))
        ahead = ahead.select(F.col("arc").alias("to"), F.col("to").alias("to2"), F.col("hops").alias("hops2"), F.col("there").alias("there2"))
        here = materialise(away.join(ahead, "to").select("arc", F.col("to2").alias("to"), (F.col("hops") + F.col("hops2")).alias("hops"), F.col("there2").alias("there")), "list")
    known = materialise(reduce_union(settled), "settled")
    stations = known.where(stop("arc")).select("arc", "to", "hops")
    ranked = materialise(list_rank(materialise(stations, "stations"), level + 1, small), "ranked")
    ways = known.where(~stop("arc"))
    through = ways.join(ranked.select(F.col("arc").alias("to"), "rank"), "to", "left")
    return ranked.select("arc", "rank").unionByName(through.select("arc", (F.col("hops") + F.coalesce("rank", F.lit(0))).alias("rank")))


def reduce_union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# -- tour and totals ---------------------------------------------------------------------------------


def numbered_nodes(nodes: DataFrame) -> DataFrame:
    """``nodes`` with dense ids, brothers side by side: (id, parent, parent_conv_id, first, n_children, last_child).

    ``first`` is the first child's id; ``last_child`` tells whether the node is the last of its parent's.
    """
    keys = ["depth", "pa", "pb", "conv_id", "a", "b"]
    rows = materialise(number_rows(nodes, keys), "nodes")
    # Grouped by the parent's key; a parent with a great many children is broadcast to them.
    kids = rows.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b")).agg(
        F.min("id").alias("first"), F.count("*").alias("n")
    )
    parents = rows.join(kids, ["depth", "a", "b"], "left")
    parents = materialise(parents.withColumn("n_children", F.coalesce("n", F.lit(0))).drop("n"), "parents")
    above = parents.where("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("n_children").alias("n"), F.col("id").alias("parent"),
        F.col("conv_id").alias("parent_conv_id"), (F.col("first") + F.col("n_children") - 1).alias("last"),
    )
    below = attach(parents.where("depth > 0"), above, ["depth", "pa", "pb"], rows.count())
    nothing = F.lit(None).cast("bigint")
    root = parents.where("depth = 0").select("*", nothing.alias("parent"), nothing.alias("parent_conv_id"), F.col("id").alias("last"))
    return below.unionByName(root).withColumn("last_child", F.col("id") == F.col("last")).drop("last")


def subtree_totals(nodes: DataFrame, small: int = SMALL) -> DataFrame:
    """(id, n_leaves, saved_tokens) of every node's subtree from (id, parent, first, n_children, last_child, own).

    Node v has the arcs 2v (in) and 2v + 1 (out); ``own`` is what the node itself saves.
    """
    down = F.when(F.col("n_children") > 0, 2 * F.col("first")).otherwise(2 * F.col("id") + 1)
    up = F.when(F.col("parent").isNull(), F.lit(None)).when(F.col("last_child"), 2 * F.col("parent") + 1).otherwise(2 * F.col("id") + 2)
    leaf = (F.col("n_children") == 0).cast("bigint")
    zero = F.lit(0).cast("bigint")
    arcs = nodes.select(
        F.inline(
            F.array(
                F.struct((2 * F.col("id")).alias("arc"), down.alias("to"), leaf.alias("leaves"), F.col("own").alias("saved")),
                F.struct((2 * F.col("id") + 1).alias("arc"), up.alias("to"), zero.alias("leaves"), zero.alias("saved")),
            )
        )
    )
    arcs = materialise(arcs, "arcs")
    ranks = list_rank(arcs.select("arc", "to", F.lit(1).cast("bigint").alias("hops")), small=small)
    tour = arcs.drop("to").join(ranks, "arc").select("arc", "leaves", "saved", (-F.col("rank")).alias("place"))
    sums = running_sums(tour, ["place"], ["leaves", "saved"])
    inwards = F.col("arc") % 2 == 0
    total = lambda v: (F.sum(F.when(~inwards, F.col(f"sum_{v}"))) - F.sum(F.when(inwards, F.col(f"sum_{v}") - F.col(v)))).alias(f"total_{v}")
    found = sums.groupBy(F.shiftright("arc", 1).alias("id")).agg(total("leaves"), total("saved"))
    return found.select("id", F.col("total_leaves").alias("n_leaves"), F.col("total_saved").alias("saved_tokens"))


def end_digests(ends: DataFrame, key: list[str]) -> DataFrame:
    """``key`` and ends_sha256: hash of the group's conv_ids, ascending and comma-joined.

    Range partitions pack runs of ids, so what one group brings to its task is a row for PACK ids, taken in order; a hash over
    a sequence cannot be shared out further, and its memory is one packed row.
    """
    order = [*key, "conv_id"]
    schema = ", ".join([*(f"{k} bigint" for k in key), "conv_id bigint", "packed string"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(len(order))]
            rows, last = [], None
            for *at, conv in zip(*columns):
                if at == last and len(rows[-1][-1]) < PACK:
                    rows[-1][-1].append(str(conv))
                else:
                    rows.append([*at, conv, [str(conv)]])
                last = at
            out = list(zip(*[[*r[:-1], ",".join(r[-1])] for r in rows])) or [()] * (len(order) + 1)
            arrays = [pa.array(c, pa.int64()) for c in out[:-1]] + [pa.array(out[-1], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*order, "packed"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, hasher = None, None

        def done(found):
            arrays = [pa.array([f[0][i] for f in found], pa.int64()) for i in range(len(key))]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([f[1] for f in found], pa.string())], names=[*key, "ends_sha256"])

        for batch in batches:
            found = []
            for *at, _, packed in zip(*[batch.column(i).to_pylist() for i in range(len(order) + 1)]):
                if at == last:
                    hasher.update(b"," + packed.encode())
                else:
                    if last is not None:
                        found.append((last, hasher.hexdigest()))
                    last, hasher = at, hashlib.sha256(packed.encode())
            yield done(found)
        if last is not None:
            yield done([(last, hasher.hexdigest())])

    packed = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, schema)
    dealt = packed.repartition(*key).sortWithinPartitions(*order)
    return dealt.mapInArrow(digest, ", ".join([*(f"{k} bigint" for k in key), "ends_sha256 string"]))


def prefix_trie(conversations: DataFrame, small: int = SMALL) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: a row for each node.

    Null roles and texts are empty. Without conversations there is no node. Negative ids belong to the block that division
    towards zero gives.
    """
    return settle(lambda: _trie_rows(conversations, small), "trie")


def _trie_rows(conversations: DataFrame, small: int) -> DataFrame:
    nodes, ends = trie_nodes(conversations)
    rows = materialise(numbered_nodes(nodes).withColumn("own", (F.col("n_convs") - 1) * F.col("n_chars")), "numbered")
    totals = subtree_totals(rows, small)
    digests = end_digests(ends, ["depth", "a", "b"])
    found = rows.join(totals, "id").join(digests, ["depth", "a", "b"], "left")
    nobody = F.sha2(F.lit("").cast("binary"), 256)
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", nobody).alias("ends_sha256")
    )
