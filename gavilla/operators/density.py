"""Density clustering: core distances, mutual reachability, spanning tree, hierarchy and chosen clusters.

Equal vectors are one weighted point throughout, so a group of copies costs one point however large it is.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from gavilla.operators import neighbours as N
from gavilla.operators.keys import PLAIN, attach, look_up, number_rows
from gavilla.operators.merge_tree import climb, merge_tree, relabel
from gavilla.operators.scans import scan
from gavilla.session import materialise, release, settle

# Neighbours of the core distance, least cluster size.
MIN_SAMPLES = 5
MIN_CLUSTER_SIZE = 20
# Shortest distance told apart from zero; it keeps 1 / distance finite for copies.
TINY = 1e-10
# Stands for "in no chosen cluster".
NONE = -(1 << 63)


def vector_knn(points: DataFrame, k: int) -> DataFrame:
    """(id, rank, nbr_id, dist) of the exact ``k`` nearest points (id, vec) by Euclidean distance."""
    n = points.count()
    index = N.build_cells(points, N.sample_pivots(points, N.default_cells(n)), single=False)
    found = N.exact_search(points, index, k, "reach")
    return found.select("id", "rank", "nbr_id", F.col("cost").alias("dist"))


def core_distances(knn: DataFrame, copies: DataFrame | None = None, min_samples: int = MIN_SAMPLES, count_self: bool = False) -> DataFrame:
    """(id, core): distance to the ``min_samples``-th neighbour, copies counted as neighbours at distance 0.

    Without that many neighbours the farthest known one counts.
    """
    need = F.lit(min_samples - (1 if count_self else 0))
    if copies is None:
        near = knn.where(F.col("rank") <= need)
        return near.groupBy("id").agg(F.max("dist").alias("core"))
    weighted = knn.where(F.col("rank") <= need).join(copies.select(F.col("id").alias("nbr_id"), F.col("copies").alias("n")), "nbr_id")
    run = Window.partitionBy("id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    reached = weighted.withColumn("seen", F.sum("n").over(run)).join(copies.select("id", "copies"), "id")
    enough = F.col("seen") + F.col("copies") - 1 >= need
    found = reached.groupBy("id").agg(F.coalesce(F.min(F.when(enough, F.col("dist"))), F.max("dist")).alias("core"))
    return copies.join(found, "id", "left").select(
        "id", F.when(F.col("copies") - 1 >= need, F.lit(0.0)).otherwise(F.coalesce("core", F.lit(0.0))).alias("core")
    )


def mutual_reachability(knn: DataFrame, core: DataFrame) -> DataFrame:
    """(a, b, weight) with a < b: greatest of the distance and both core distances."""
    left = core.select(F.col("id"), F.col("core").alias("core_a"))
    right = core.select(F.col("id").alias("nbr_id"), F.col("core").alias("core_b"))
    both = knn.join(left, "id").join(right, "nbr_id")
    return both.select(
        F.least("id", "nbr_id").alias("a"), F.greatest("id", "nbr_id").alias("b"),
        F.greatest("dist", "core_a", "core_b").alias("weight"),
    ).distinct()


# -- spanning tree -------------------------------------------------------------------------------


def spanning_tree(points: DataFrame, knn: DataFrame, core: DataFrame, k: int, exact: bool = True, complete: bool = True) -> DataFrame:
    """(a, b, weight): minimum spanning tree of mutual reachability over distinct points (id, vec).

    Boruvka rounds. A known neighbour edge is a component's lightest way out only if it is lighter than
    anything its points have not seen; otherwise the points that could do better are searched again
    through the cells, within the best weight so far. The cells are packed once; a round only makes the groups
    of their points anew. Edges carry the groups of their ends, and those within a group are dropped.

    ``complete`` says that ``knn`` holds the true nearest neighbours; of an approximate list a point has only seen
    that nothing is nearer than its core distance. ``exact=False`` keeps to the known edges, and parts they do not connect
    stay apart.
    """
    edges = mutual_reachability(knn, core).select("a", "b", F.round("weight", 12).alias("weight"), F.col("a").alias("ga"), F.col("b").alias("gb"))
    edges = materialise(edges, "reach")
    unseen = knn.groupBy("id").agg(F.max("rank").alias("last"), F.max("dist").alias("far"))
    # With fewer than k neighbours a point has seen every other one.
    far = F.when(F.col("last") < k, F.lit(float("inf"))).otherwise(F.col("far")) if complete else F.lit(0.0)
    unseen = unseen.select("id", far.alias("far"))
    placed = core.join(unseen, "id", "left").select(
        "id", "core", F.greatest("core", F.coalesce("far", F.lit(float("inf") if complete else 0.0))).alias("unseen"), F.col("id").alias("grp")
    )
    groups = materialise(placed, "points")
    total, n_edges = groups.count(), edges.count()
    left, chosen, index = total, [], None
    while left > 1:
        best = materialise(_lightest(edges), "lightest")
        if exact:
            doubt = look_up(groups, best.select("grp", F.col("weight").alias("bound")), "grp", total, "left")
            doubt = doubt.withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).where("unseen <= bound")
            doubt = materialise(doubt.select("id", "core", "grp", "bound"), "doubt")
            n_doubt = doubt.count()
            if n_doubt:
                if index is None:
                    members = points.join(core, "id").select("id", "vec", "core")
                    index = N.build_cells(members, N.sample_pivots(points, N.default_cells(total)), single=False)
                    spots = materialise(N.block_of(index), "spots")
                cells = N.regrouped(index, groups.select("id", "grp").join(spots, "id"))
                best = materialise(_lowest(best.unionByName(_search_out(points, cells, doubt, n_doubt))), "lightest")
        # An edge that both its groups choose counts once, and the smaller of the two leads.
        both = best.groupBy("a", "b").agg(F.first("weight").alias("weight"), F.when(F.count("*") == 2, F.min("grp")).alias("lead"))
        picked = materialise(both, "picked")
        joined = picked.count()
        if not joined:
            break
        chosen.append(picked.select("a", "b", "weight"))
        # The picked edges form a forest over the groups, so each of them joins two.
        left -= joined
        if left > 1:
            leads = picked.where("lead IS NOT NULL").select(F.col("lead").alias("x"), F.lit(True).alias("root"))
            pointers = best.select(F.col("grp").alias("x"), "far").join(leads, "x", "left")
            pointers = pointers.select("x", F.when(F.col("root"), F.lit(None)).otherwise(F.col("far")).alias("up"))
            roots = climb(pointers, left + joined).select(F.col("x").alias("grp"), F.col("top").alias("root"))
            moved = look_up(groups, roots, "grp", total, "left")
            next_groups = materialise(moved.select("id", "core", "unseen", F.coalesce("root", "grp").alias("grp")), "points")
            next_edges = materialise(relabel(edges, roots, ["ga", "gb"], n_edges).where("ga <> gb"), "reach")
            release(groups, edges)
            groups, edges, n_edges = next_groups, next_edges, next_edges.count()
    if not chosen:
        return points.sparkSession.createDataFrame([], "a bigint, b bigint, weight double")
    return reduce(DataFrame.unionByName, chosen)


def _lowest(edges: DataFrame) -> DataFrame:
    """(grp, weight, a, b, far): the lightest edge of each group, ties by the ids of its ends."""
    least = edges.groupBy("grp").agg(F.min(F.struct("weight", "a", "b", "far")).alias("edge"))
    return least.select("grp", "edge.weight", "edge.a", "edge.b", "edge.far")


def _lightest(edges: DataFrame) -> DataFrame:
    """The lightest known edge leaving each group."""
    ways = F.array(F.struct(F.col("ga").alias("grp"), F.col("gb").alias("far")), F.struct(F.col("gb").alias("grp"), F.col("ga").alias("far")))
    return _lowest(edges.select("weight", "a", "b", F.inline(ways)))


def _search_out(points: DataFrame, cells: N.Cells, doubt: DataFrame, n_doubt: int) -> DataFrame:
    """(grp, weight, a, b, far): lightest edges out of the groups of the doubtful points, within their bounds.

    The nearest cells come first; what they give bounds the visit to the others.
    """
    asked = points.join(doubt, "id").select("id", "vec", "grp", "core", "bound")
    near = materialise(_as_edges(N.search(asked, cells, 1, "reach", 2, False, n_doubt, per_group=True)), "near")
    bounds = near.select("grp", F.col("weight").alias("limit"))
    if n_doubt > PLAIN:
        asked = materialise(asked, "asked")
    tight = look_up(asked, bounds, "grp", n_doubt, "left").withColumn("bound", F.least("bound", "limit")).drop("limit")
    # The second pass visits the remaining cells that can hold something at least as light.
    rest = _as_edges(N.search(tight.where("core <= bound"), cells, 1, "reach", 2, True, n_doubt, per_group=True))
    return _lowest(near.unionByName(rest))


def _as_edges(found: DataFrame) -> DataFrame:
    return _lowest(
        found.select("grp", F.col("cost").alias("weight"), F.least("id", "nbr_id").alias("a"), F.greatest("id", "nbr_id").alias("b"), "far")
    )


# -- hierarchy -----------------------------------------------------------------------------------


def single_linkage(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, left, right, dist, size) from tree edges (a, b, weight) and leaf sizes (id, copies).

    Leaves keep their ids and the merge over the edge of rank r is node -(r + 1).
    """
    return merge_tree(tree, sizes)[0].drop("lo")


def condensed_tree(merges: DataFrame, spots: DataFrame, leaves: DataFrame, min_size: int = MIN_CLUSTER_SIZE) -> tuple[DataFrame, DataFrame]:
    """(cluster, parent, birth, size, stability) and (lo, cluster, exit, size) from the merge tree and leaves (id, copies, core).

    Walking down from the root, a merge whose two sides both hold ``min_size`` points starts two clusters;
    a smaller side drops out of the cluster at the merge's density 1 / distance. The second table has one row for each
    side that drops out: the run of points from ``lo`` on, null cluster for a tree without a large part.

    In the order of places, a larger part before those inside it, the large parts of one cluster stand together behind
    its first one. So the cluster of each is the last first one, and no walk up the tree is needed.
    """
    merges = materialise(merges, "merges")
    density = lambda dist: 1 / F.greatest(dist, F.lit(TINY))
    nodes = merges.select(F.col("node").alias("x"), "size", "lo", F.lit(None).cast("double").alias("core")).unionByName(
        leaves.join(spots, "id").select(F.col("id").alias("x"), F.col("copies").alias("size"), "lo", "core")
    )
    down = merges.select(
        F.explode(F.array("left", "right")).alias("x"), F.col("node").alias("up"), density(F.col("dist")).alias("density")
    )
    nodes = nodes.join(down, "x", "left").withColumn("big", F.col("size") >= min_size)
    # A merge has two sides, so both are known to each other after one grouping.
    bigs = nodes.where("up IS NOT NULL").groupBy("up").agg(F.count_if("big").alias("bigs"))
    nodes = materialise(nodes.join(bigs, "up", "left"), "condense")
    births = F.col("big") & (F.col("up").isNull() | (F.col("bigs") == 2))
    large = nodes.where("big").select("x", "up", "lo", (-F.col("size")).alias("rev"), F.when(births, F.col("x")).alias("head"), "core", "density")
    owner = materialise(scan(materialise(large, "large"), ["lo", "rev"], None, (), ("head",)).withColumnRenamed("last_head", "cluster"), "owner")
    above = owner.select(F.col("x").alias("up"), F.col("cluster").alias("parent"))
    fallen = nodes.where("NOT big").join(above, "up").select("lo", F.col("parent").alias("cluster"), F.col("density").alias("exit"), "size")
    # A leaf of many copies is large itself: its points leave at its core distance.
    heavy = owner.where("x >= 0").select("lo", "cluster", density(F.col("core")).alias("exit"), (-F.col("rev")).alias("size"))
    nothing = nodes.where("NOT big AND up IS NULL").select("lo", F.lit(None).cast("bigint").alias("cluster"), F.lit(0.0).alias("exit"), "size")
    exits = materialise(fallen.unionByName(heavy).unionByName(nothing), "exits")
    heads = owner.where("head IS NOT NULL").select("cluster", "up", F.coalesce("density", F.lit(0.0)).alias("birth"), (-F.col("rev")).alias("size"))
    heads = materialise(heads.join(above, "up", "left").select("cluster", "parent", "birth", "size"), "heads")
    gains = exits.where("cluster IS NOT NULL").groupBy("cluster").agg(
        F.sum(F.col("exit") * F.col("size")).alias("mass"), F.sum("size").alias("points")
    )
    gains = gains.unionByName(
        heads.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(
            F.sum(F.col("birth") * F.col("size")).alias("mass"), F.sum("size").alias("points")
        )
    )
    total = gains.groupBy("cluster").agg(F.sum("mass").alias("mass"), F.sum("points").alias("points"))
    clusters = heads.join(total, "cluster").withColumn("stability", F.col("mass") - F.col("birth") * F.col("points"))
    return materialise(clusters.select("cluster", "parent", "birth", "size", "stability"), "clusters"), exits


def choose_clusters(clusters: DataFrame, max_rounds: int = 128) -> DataFrame:
    """(cluster, chosen): the chosen cluster at or above each, null where there is none.

    A cluster is kept when its stability is at least the best total below it; the root never is. The best
    totals run bottom-up: finished clusters hand theirs to the parent, while along runs with one
    unfinished child the step x -> max(stability, base + x) is composed pairwise, so that long runs take
    logarithmic rounds.
    """
    kids = clusters.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(
        F.count("*").alias("pending"), F.sum("cluster").alias("kid")
    )
    state = clusters.join(kids, "cluster", "left").select(
        "cluster", "parent", F.col("stability").alias("floor"), F.lit(0.0).alias("base"),
        F.coalesce("pending", F.lit(0)).cast("bigint").alias("pending"), "kid",
    )
    state, values, carried = materialise(state, "eom"), [], None
    for _ in range(max_rounds):
        if state.isEmpty():
            break
        value = state.where("pending = 0").select("cluster", "parent", F.greatest("floor", "base").alias("value"))
        value = materialise(value, "values")
        values.append(value)
        rest = state.where("pending > 0")
        given = value.groupBy(F.col("parent").alias("cluster")).agg(
            F.sum("value").alias("got"), F.count("*").alias("done"), F.sum("cluster").alias("done_kid")
        )
        # Two unfinished children: count off those that finished. One: look at the child itself.
        open_two = rest.where("pending = 2").join(given, "cluster", "left").select(
            "cluster", "parent", "floor", (F.col("base") + F.coalesce("got", F.lit(0.0))).alias("base"),
            (F.col("pending") - F.coalesce("done", F.lit(0))).alias("pending"), (F.col("kid") - F.coalesce("done_kid", F.lit(0))).alias("kid"),
        )
        # A composed step may point at a cluster that finished in an earlier round; only such totals are carried on.
        known = value if carried is None else value.unionByName(carried)
        ahead = known.select(F.col("cluster").alias("kid"), F.col("value"), F.lit(None).cast("double").alias("floor2"), F.lit(None).cast("double").alias("base2"), F.lit(None).cast("bigint").alias("kid2"))
        runs = rest.where("pending = 1")
        ahead = ahead.unionByName(runs.select(F.col("cluster").alias("kid"), F.lit(None).cast("double").alias("value"), F.col("floor").alias("floor2"), F.col("base").alias("base2"), F.col("kid").alias("kid2")))
        open_one = runs.join(ahead, "kid", "left").select(
            "cluster", "parent", F.greatest("floor", F.col("base") + F.col("floor2")).alias("floor"),
            (F.col("base") + F.coalesce("value", "base2", F.lit(0.0))).alias("base"),
            F.when(F.col("value").isNotNull(), F.lit(0)).otherwise(F.lit(1)).cast("bigint").alias("pending"), F.coalesce("kid2", "kid").alias("kid"),
        )
        after = materialise(open_two.unionByName(open_one), "eom")
        wanted = after.where("pending = 1").select(F.col("kid").alias("cluster"))
        carried = materialise(known.join(wanted, "cluster", "left_semi"), "carried")
        release(state)
        state = after
    else:
        raise RuntimeError("cluster totals did not settle")
    best = reduce(DataFrame.unionByName, values)
    below = best.where("parent IS NOT NULL").groupBy(F.col("parent").alias("cluster")).agg(F.sum("value").alias("below"))
    kept = clusters.join(below, "cluster", "left").withColumn(
        "kept", F.col("parent").isNotNull() & (F.col("stability") >= F.coalesce("below", F.lit(float("-inf"))))
    )
    # The highest kept cluster on the way to the root.
    n_clusters = clusters.count()
    path = materialise(kept.select("cluster", F.col("parent").alias("up"), F.when(F.col("kept"), F.col("cluster")).alias("chosen")), "path")
    for _ in range(max_rounds):
        if path.where("up IS NOT NULL").isEmpty():
            break
        above = path.select(F.col("cluster").alias("up"), F.col("up").alias("up2"), F.col("chosen").alias("chosen2"))
        moved = look_up(path.where("up IS NOT NULL"), above, "up", n_clusters)
        moved = moved.select("cluster", F.col("up2").alias("up"), F.coalesce("chosen2", "chosen").alias("chosen"))
        after = materialise(moved.unionByName(path.where("up IS NULL")), "path")
        release(path)
        path = after
    return path.select("cluster", "chosen")


# -- labels --------------------------------------------------------------------------------------


def density_graph(points: DataFrame, k: int = 30, min_samples: int = MIN_SAMPLES, exact: bool = True, knn: DataFrame | None = None):
    """(leaves, tree edges, copies): the weighted distinct points, their spanning tree and (id, rep).

    ``knn`` is taken as approximate: core distances are those within it.
    """
    reps, copies = N.distinct_vectors(points)
    k, complete = max(k, min_samples), knn is None
    knn = materialise(vector_knn(reps, k) if complete else knn, "knn")
    core = materialise(core_distances(knn, reps, min_samples), "core")
    tree = materialise(spanning_tree(reps, knn, core, k, exact, complete), "mst")
    leaves = materialise(reps.select("id", "copies").join(core, "id"), "leaves")
    return leaves, tree, copies


def full_tree(leaves: DataFrame, tree: DataFrame, copies: DataFrame) -> DataFrame:
    """(a, b, weight) over all ids: each copy hangs on its representative at the core distance."""
    hung = copies.where("id <> rep").join(leaves.select(F.col("id").alias("rep"), "core"), "rep")
    return tree.unionByName(hung.select(F.col("rep").alias("a"), F.col("id").alias("b"), F.col("core").alias("weight")))


def density_clusters(points: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES, k: int = 30, exact: bool = True, knn: DataFrame | None = None) -> DataFrame:
    """(id, cluster) of (id, vec): chosen clusters numbered by their smallest id, everything else -1."""
    return settle(lambda: _density_labels(points, min_cluster_size, min_samples, k, exact, knn), "density")


def _density_labels(points: DataFrame, min_cluster_size: int, min_samples: int, k: int, exact: bool, knn: DataFrame | None) -> DataFrame:
    leaves, tree, copies = density_graph(points, k, min_samples, exact, knn)
    merges, spots = merge_tree(tree, leaves.select("id", "copies"))
    spots = materialise(spots, "spots")
    clusters, exits = condensed_tree(merges, spots, leaves, min_cluster_size)
    if clusters.isEmpty():
        return copies.select("id", F.lit(-1).alias("cluster"))
    chosen = choose_clusters(clusters).where("chosen IS NOT NULL")
    # Each part that drops out is a run of points; its points come behind it in the order of places.
    parts = look_up(exits.select("lo", "cluster"), chosen, "cluster", exits.count(), "left").select("lo", F.lit(0).alias("turn"), F.lit(None).cast("bigint").alias("id"), F.coalesce("chosen", F.lit(NONE)).alias("chosen"))
    both = parts.unionByName(spots.select("lo", F.lit(1).alias("turn"), "id", F.lit(None).cast("bigint").alias("chosen")))
    found = scan(materialise(both, "parts"), ["lo", "turn"], None, (), ("chosen",)).where("turn = 1").select(F.col("id").alias("rep"), F.col("last_chosen").alias("chosen"))
    found = materialise(found.where(F.col("chosen") != NONE), "found")
    firsts = found.groupBy("chosen").agg(F.min("rep").alias("first"), F.count("*").alias("n"))
    numbers = materialise(number_rows(firsts, ["first"], "cluster"), "numbers")
    labelled = attach(found, numbers.select("chosen", "n", "cluster"), ["chosen"], found.count()).select("rep", "cluster")
    sized = leaves.select(F.col("id").alias("rep"), F.col("copies").alias("n")).join(labelled, "rep", "left")
    sized = materialise(sized.select("rep", "n", F.coalesce("cluster", F.lit(-1)).cast("int").alias("cluster")), "replabels")
    return attach(copies, sized, ["rep"], copies.count()).select("id", "cluster")
