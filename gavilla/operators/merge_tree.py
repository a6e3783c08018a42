"""The single-linkage merge tree of a spanning tree, in a logarithmic number of grouped steps.

Boruvka levels of the tree's edges, ordered by rank, cut the merge tree into chains. On each level every vertex picks its
lightest edge, the picked edges contract, and the others stay for the next level. Seen from a vertex of a level, the picked
edges inside it that are lighter than its own lightest edge are merged one after the other: they are a chain, and the chain's
last merge hangs on that lightest edge. Heavier ones are handed up until a level's vertex has nothing lighter that leaves it.
So each edge belongs to one chain; sizes are running sums along chains, from the lowest level up, and places are handed down
from the highest. Nothing here walks edge by edge, and no task holds a chain.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from gavilla.operators.keys import PLAIN, look_up, number_rows
from gavilla.operators.scans import scan
from gavilla.session import materialise, release

MERGES = "node bigint, left bigint, right bigint, dist double, size bigint, lo bigint"
LEAVES = "id bigint, lo bigint"


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def climb(start: DataFrame, total: int, max_rounds: int = 64) -> DataFrame:
    """(x, top) from ``total`` rows (x, up): follow ``up`` until an x whose ``up`` is null; the reach doubles per round."""
    here = materialise(start.select("x", "up", F.coalesce("up", "x").alias("top")), "climb")
    for _ in range(max_rounds):
        if here.where("up IS NOT NULL").isEmpty():
            return here.select("x", "top")
        above = here.select(F.col("x").alias("up"), F.col("up").alias("up2"), F.col("top").alias("top2"))
        jump = lambda rows: look_up(rows, above, "up", total, "left").select(
            "x", F.col("up2").alias("up"), F.coalesce("top2", "top").alias("top")
        )
        if total <= PLAIN:  # a light join, so two at once
            moved = jump(jump(here))
        else:
            moved = jump(here.where("up IS NOT NULL")).unionByName(here.where("up IS NULL"))
        after = materialise(moved, "climb")
        release(here)
        here = after
    raise RuntimeError("pointers do not end")


def relabel(edges: DataFrame, roots: DataFrame, ends: list[str], total: int) -> DataFrame:
    """``edges`` with each of the columns ``ends`` replaced by its root of ``roots`` (vertex, root)."""
    vertex, root = roots.columns
    for end in ends:
        if total > PLAIN:
            edges = materialise(edges, "relabel")
        to = roots.select(F.col(vertex).alias(end), F.col(root).alias("_root"))
        edges = look_up(edges, to, end, total).withColumn(end, F.col("_root")).drop("_root")
    return edges


def _levels(edges: DataFrame) -> tuple[list[DataFrame], list[DataFrame], list[int]]:
    """Per level: (rank, level, c1, c2) of the edges picked there, by one vertex or by both (else c2 is null); and
    (rank, k, v) of the edges that belong to the chain of vertex v of level k, with how many there are."""
    picked, chains, counts = [], [], []
    open_edges, pending, level = edges.select("rank", F.col("a").alias("u"), F.col("b").alias("w")), None, 0
    while True:
        total = open_edges.count()
        waiting = pending.count() if pending is not None else 0
        if not total:
            if waiting:
                chains.append(pending.select("rank", F.lit(level).alias("k"), "v"))
                counts.append(waiting)
            return picked, chains, counts
        sides = open_edges.select(
            "rank", F.inline(F.array(F.struct(F.col("u").alias("v"), F.col("w").alias("far")), F.struct(F.col("w").alias("v"), F.col("u").alias("far"))))
        )
        low = materialise(sides.groupBy("v").agg(F.min(F.struct("rank", "far")).alias("e")).select("v", F.col("e.rank").alias("low"), "e.far"), "low")
        rest, n_rest = None, 0
        if waiting:
            met = materialise(look_up(pending, low.select("v", "low"), "v", waiting, "left"), "met")
            done = met.where("low IS NULL OR rank < low")
            chains.append(done.select("rank", F.lit(level).alias("k"), "v"))
            counts.append(done.count())
            rest, n_rest = met.where("rank > low").select("rank", "v"), waiting - counts[-1]
        both = F.count("*") == 2
        own = low.groupBy(F.col("low").alias("rank")).agg(F.min("v").alias("c1"), F.when(both, F.max("v")).alias("c2"))
        own = materialise(own.select("rank", F.lit(level).alias("level"), "c1", "c2"), "picked")
        picked.append(own)
        # Each vertex points along its edge; of two that picked the same edge, the smaller is the root.
        pairs = own.where("c2 IS NOT NULL").select(F.col("c1").alias("x"), F.lit(True).alias("root"))
        pointers = low.select(F.col("v").alias("x"), "far").join(pairs, "x", "left").select("x", F.when(F.col("root"), F.lit(None)).otherwise(F.col("far")).alias("up"))
        n_vertices = low.count()
        roots = climb(pointers, n_vertices).select(F.col("x").alias("v"), F.col("top").alias("root"))
        fresh = own.select("rank", F.col("c1").alias("v")).join(roots, "v").select("rank", F.col("root").alias("v"))
        if n_rest:
            fresh = fresh.unionByName(look_up(rest, roots, "v", n_rest).select("rank", F.col("root").alias("v")))
        pending = materialise(fresh, "pending")
        open_edges = relabel(open_edges.join(own.select("rank"), "rank", "left_anti"), roots, ["u", "w"], total)
        open_edges, level = materialise(open_edges, "left"), level + 1


def merge_tree(tree: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, left, right, dist, size, lo) of every merge and (id, lo) of every leaf, from tree edges (a, b, weight) and (id, copies).

    Edges merge by (weight, a, b). Leaves keep their ids and the merge over the edge of rank r is node -(r + 1), its children
    ``left`` < ``right``. Points lie in an order in which every subtree is one run: of node x it begins at ``lo`` and has
    ``size`` points, copies counted. Edges that connect several trees give a tree each; leaves without an edge have no place.
    """
    spark = tree.sparkSession
    ordered = tree.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight")
    edges = materialise(number_rows(ordered, ["weight", "a", "b"], "rank"), "ranked")
    picked, chains, counts = _levels(edges)
    if not picked:
        return spark.createDataFrame([], MERGES), spark.createDataFrame([], LEAVES)
    # Where each picked edge holds what its pickers have come to: one or two hooks.
    hooks = _union(picked).join(_union(chains), "rank")
    side = lambda c, i: F.struct(F.col(c).alias("c"), F.lit(i).alias("side"))
    hooks = hooks.select("rank", "level", "k", "v", F.explode(F.array(side("c1", 1), side("c2", 2))).alias("s"))
    hooks = materialise(hooks.where("s.c IS NOT NULL").select("rank", "level", "k", "v", "s.c", "s.side"), "hooks")
    node = lambda rank: -rank - 1
    # Upwards: sizes. A level's chains take what hangs on them from the levels below.
    leaves = sizes.select(F.col("id").alias("c"), F.col("id").alias("hung"), F.col("copies").cast("bigint").alias("weight"))
    hung = [materialise(hooks.where("level = 0").join(leaves, "c"), "hung")]
    done = []
    for k in range(1, len(picked) + 1):
        own = _union(hung).where(F.col("k") == k)
        one = own.groupBy("rank").agg(
            F.first("v").alias("v"), F.sum("weight").alias("weight"), F.min_by("hung", "side").alias("first"),
            F.when(F.count("*") == 2, F.max_by("hung", "side")).alias("second"), F.min_by("weight", "side").alias("first_weight"),
        )
        along = scan(materialise(one, "chain"), ["v", "rank"], "v", ("weight",), (), ("rank",))
        other = F.coalesce(F.col("second"), node(F.col("high_rank")))
        merged = materialise(along.select(
            "rank", "v", F.least("first", other).alias("left"), F.greatest("first", other).alias("right"), F.col("sum_weight").alias("size"),
            (F.col("sum_weight") - F.col("weight")).alias("before"), "first_weight",
        ), "chain")
        done.append(merged)
        tops = merged.groupBy("v").agg(F.max(F.struct("rank", "size")).alias("top"))
        tops = tops.select(F.col("v").alias("c"), node(F.col("top.rank")).alias("hung"), F.col("top.size").alias("weight"))
        hung.append(materialise(hooks.where(F.col("level") == k).join(tops, "c"), "hung"))
    # Downwards: places. Whole trees come one after the other, and a chain's hooks in the order of the chain.
    hooked = hooks.select(F.col("level").alias("k"), F.col("c").alias("v"))
    ends = _union([m.groupBy("v").agg(F.max("size").alias("size")).select(F.lit(k).alias("k"), "v", "size") for k, m in enumerate(done, 1)])
    roots = scan(materialise(ends.join(hooked, ["k", "v"], "left_anti"), "roots"), ["k", "v"], None, ("size",))
    starts = [materialise(roots.select("k", "v", (F.col("sum_size") - F.col("size")).alias("lo")), "starts")]
    placed = []
    for k in range(len(picked), 0, -1):
        here = _union(starts).where(F.col("k") == k).select("v", "lo")
        at = materialise(look_up(done[k - 1], here, "v", counts[k - 1]), "placed")
        placed.append(at)
        spot = F.col("lo") + F.col("before") + F.when(F.col("side") == 2, F.col("first_weight")).otherwise(0)
        below = hooks.where(F.col("k") == k).drop("v").join(at.select("rank", "lo", "before", "first_weight"), "rank")
        starts.append(materialise(below.select(F.col("level").alias("k"), F.col("c").alias("v"), spot.alias("lo")), "starts"))
    merges = _union(placed).join(edges.select("rank", "weight"), "rank").select(
        node(F.col("rank")).alias("node"), "left", "right", F.col("weight").alias("dist"), "size", "lo"
    )
    return merges, _union(starts).where("k = 0").select(F.col("v").alias("id"), "lo")
