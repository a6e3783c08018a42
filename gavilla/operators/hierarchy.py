"""Average and Ward linkage over clusters, and the trees they give."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gavilla.operators.keys import number_rows
from gavilla.operators.neighbours import build_cells, default_cells, exact_search, sample_pivots
from gavilla.operators.summary import TREE_CLUSTERS
from gavilla.session import materialise, release

MERGES = "round int, a bigint, b bigint, a_tip int, b_tip int, distance double, size bigint"
TREE_MERGES = "node_id bigint, left_id bigint, right_id bigint, distance double, size bigint"


def representative_distances(reps: DataFrame) -> DataFrame:
    """(a, b, dist) with a < b over the representatives (cluster, sig) of all clusters that share a signature position.

    All other pairs are at distance 1 and are not listed. Pairs meet in an equi-join on (position, value), which only
    brings together clusters that the tree does join below 1.
    """
    cells = reps.select(F.col("cluster").cast("bigint").alias("cluster"), F.size("sig").alias("n"), F.posexplode("sig").alias("pos", "value"))
    cells = materialise(cells, "positions")
    left = cells.withColumnRenamed("cluster", "a")
    right = cells.select(F.col("cluster").alias("b"), "pos", "value")
    met = left.join(right, ["pos", "value"]).where("a < b").groupBy("a", "b").agg(F.count("*").alias("same"), F.max("n").alias("n"))
    return met.select("a", "b", (1 - F.col("same") / F.col("n")).alias("dist"))


SIDE = ["tip", "height", "size", "within"]


def _pair_linkage(pairs: DataFrame, method: str) -> DataFrame:
    """Merges from leaf pairs (a, b, total): similarities for "average", squared distances for "ward".

    Average linkage needs only the pairs with a similarity above 0: clusters without a link are at distance 1.

    Every reciprocal nearest pair of a round is merged at once, which gives the same tree as one merge at
    a time because both linkages are reducible. A cluster is named by its smallest leaf; per pair only the
    sum over its leaf pairs is kept, and per cluster the sum within it, which give both distances.
    """
    spark = pairs.sparkSession
    fresh = {"tip": F.lit(-1), "height": F.lit(0.0), "size": F.lit(1).cast("bigint"), "within": F.lit(0.0)}
    links = materialise(
        pairs.select(
            F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), "total",
            *[value.alias(f"{side}_{name}") for side in "ab" for name, value in fresh.items()],
        ), "links",
    )
    na, nb = F.col("a_size"), F.col("b_size")
    if method == "average":
        dist = 1 - F.col("total") / (na * nb)
    else:
        apart = F.col("total") / (na * nb) - F.col("a_within") / (na * na) - F.col("b_within") / (nb * nb)
        dist = F.sqrt(2 * na * nb / (na + nb) * F.greatest(apart, F.lit(0.0)))
    done, rounds = [], 0
    while not links.isEmpty():
        row = F.struct(F.round(dist, 12).alias("d"), "a", "b")
        sides = links.withColumn("dist", dist).select(
            F.explode(F.array("a", "b")).alias("c"), row.alias("order"), F.struct(*links.columns, "dist").alias("link")
        )
        nearest = sides.groupBy("c").agg(F.min_by("link", "order").alias("link"))
        both = nearest.groupBy("link.a", "link.b").agg(F.count("*").alias("n"), F.first("link").alias("link"))
        merged = materialise(both.where("n = 2").select(
            F.lit(rounds).alias("round"), "a", "b", "link.a_tip", "link.b_tip",
            # Neither linkage ever shrinks; the maximum only removes rounding in equal heights.
            F.greatest("link.dist", "link.a_height", "link.b_height").alias("distance"),
            (F.col("link.a_size") + F.col("link.b_size")).alias("size"),
            (F.col("link.a_within") + F.col("link.b_within") + F.col("link.total")).alias("within"),
        ), "merged")
        done.append(merged.drop("within"))
        into = merged.select(
            F.explode(F.array("a", "b")).alias("old"), F.col("a").alias("new"), F.col("round").alias("tip"),
            F.col("distance").alias("height"), "size", "within",
        )

        def moved(df: DataFrame, side: str) -> DataFrame:
            to = into.select(F.col("old").alias(side), F.col("new"), *[F.col(n).alias(f"new_{n}") for n in SIDE])
            fields = {f"{side}_{n}": F.coalesce(f"new_{n}", f"{side}_{n}") for n in SIDE}
            joined = df.join(to, side, "left").withColumns({**fields, side: F.coalesce("new", side)})
            return joined.drop("new", *[f"new_{n}" for n in SIDE])

        shifted = moved(moved(links, "a"), "b").where("a <> b")
        # Names are kept in order, so the sides of a pair may have to change places.
        swapped = F.col("a") > F.col("b")
        ordered = shifted.select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total",
            *[F.when(swapped, F.col(f"{o}_{n}")).otherwise(F.col(f"{s}_{n}")).alias(f"{s}_{n}")
              for s, o in (("a", "b"), ("b", "a")) for n in SIDE],
        )
        same = [F.first(f"{s}_{n}").alias(f"{s}_{n}") for s in "ab" for n in SIDE]
        grown = materialise(ordered.groupBy("a", "b").agg(F.sum("total").alias("total"), *same), "links")
        release(links)
        links = grown
        rounds += 1
    return _all(spark, done)


def average_linkage(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Merges of average linkage over ``clusters`` (cluster) from their pairs (a, b, dist) below distance 1.

    What no pair links any more is joined at distance 1, one cluster after the other in the order of their smallest leaves.
    """
    similar = pairs.where("dist < 1").select("a", "b", (1 - F.col("dist")).alias("total"))
    merges = materialise(_pair_linkage(similar, "average"), "average")
    return merges.unionByName(_join_rest(merges, clusters))


PER_BLOCK = 10_000


def _join_rest(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    """Merges at distance 1 of the clusters that ``merges`` leave, named by their smallest leaves."""
    rounds = merges.agg(F.coalesce(F.max("round") + 1, F.lit(0)).alias("r")).first()["r"]
    names = clusters.select(F.col("cluster").cast("bigint").alias("c")).distinct()
    gone = merges.select(F.col("b").alias("c"))
    last = merges.groupBy(F.col("a").alias("c")).agg(F.max_by(F.struct("round", "size"), "round").alias("top"))
    tops = names.join(gone, "c", "left_anti").join(last, "c", "left").select(
        "c", F.coalesce("top.round", F.lit(-1)).alias("tip"), F.coalesce("top.size", F.lit(1)).cast("bigint").alias("size")
    )
    ranked = materialise(number_rows(tops, ["c"], "rank"), "tops").withColumn("block", F.floor(F.col("rank") / PER_BLOCK))
    # Leaves so far: within blocks of ranks, and of the blocks before.
    sums = ranked.groupBy("block").agg(F.sum("size").alias("n"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    within = Window.partitionBy("block").orderBy("rank")
    placed = ranked.withColumn("run", F.sum("size").over(within)).join(starts, "block")
    first = ranked.where("rank = 0").select(F.col("c").alias("a"), F.col("tip").alias("first_tip"))
    order = F.col("rank").cast("int")
    return placed.where("rank > 0").join(F.broadcast(first)).select(
        (order - 1 + rounds).alias("round"), "a", F.col("c").alias("b"),
        F.when(order == 1, F.col("first_tip")).otherwise(order - 2 + rounds).alias("a_tip"), F.col("tip").alias("b_tip"),
        F.lit(1.0).alias("distance"), (F.col("start") + F.col("run")).alias("size"),
    )


def _ranked_pairs(rows: DataFrame, value) -> DataFrame:
    """(a, b, total) over all pairs of few rows (cluster, x): each row names its partners by rank."""
    ranked = materialise(number_rows(rows, ["cluster"], "rank"), "ranked")
    last = F.lit(ranked.count() - 1)
    asked = ranked.where(F.col("rank") < last).select(
        F.col("cluster").alias("a"), F.col("x").alias("xa"), F.explode(F.sequence(F.col("rank") + 1, last)).alias("rank")
    )
    other = ranked.select("rank", F.col("cluster").alias("b"), F.col("x").alias("xb"))
    return asked.join(other, "rank").select("a", "b", value(F.col("xa"), F.col("xb")).alias("total"))


def _all(spark: SparkSession, parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], MERGES)


def ward_linkage(centres: DataFrame, pair_limit: int = TREE_CLUSTERS) -> DataFrame:
    """Merges of Ward linkage over (cluster, centroid), each leaf of weight one.

    Up to ``pair_limit`` centroids all pairs are held; beyond it the nearest clusters come from the
    bounded cell search and pairs never are.
    """
    if centres.limit(pair_limit + 1).count() > pair_limit:
        return _ward_by_search(centres)
    rows = centres.select("cluster", F.col("centroid").cast("array<double>").alias("x"))
    squared = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, v: acc + v)
    return _pair_linkage(_ranked_pairs(rows, squared), "ward")


def _state(ids: DataFrame, *extra: str) -> DataFrame:
    """Every leaf as a cluster of its own: last merge round (-1), height and leaf count."""
    return ids.select(
        F.col("c").cast("bigint").alias("c"), *extra,
        F.lit(-1).alias("tip"), F.lit(0.0).alias("height"), F.lit(1).cast("bigint").alias("size"),
    )


def _merges(pairs: DataFrame, state: DataFrame, round_no: int) -> DataFrame:
    side = ["tip", "height", "size"]
    left = state.select(F.col("c").alias("a"), *[F.col(c).alias(f"a_{c}") for c in side])
    right = state.select(F.col("c").alias("b"), *[F.col(c).alias(f"b_{c}") for c in side])
    return pairs.join(left, "a").join(right, "b").select(
        F.lit(round_no).alias("round"), "a", "b", "a_tip", "b_tip",
        F.greatest("dist", "a_height", "b_height").alias("distance"),
        (F.col("a_size") + F.col("b_size")).alias("size"),
    )


def _ward_by_search(centres: DataFrame) -> DataFrame:
    """Rounds of reciprocal nearest pairs, each cluster's nearest found through cells."""
    spark = centres.sparkSession
    leaves = centres.select(F.col("cluster").alias("c"), F.col("centroid").cast("array<double>").alias("vec"))
    state = materialise(_state(leaves, "vec"), "state")
    left, done, known = state.count(), [], None
    while left > 1:
        points = state.select(F.col("c").alias("id"), "vec", F.col("size").cast("double").alias("wt"))
        index = build_cells(points, sample_pivots(points, 1 if left <= 1024 else default_cells(left)), single=False)
        asked = points if known is None else points.join(known.select(F.col("c").alias("id")), "id", "left_anti")
        found = exact_search(asked, index, 1, "ward").select(
            F.col("id").alias("c"), F.col("nbr_id").alias("nbr"), F.round("cost", 12).alias("dist")
        )
        nearest = materialise(found if known is None else found.unionByName(known), "nearest")
        # Equal distances: the pair with the smallest ids goes first, so at least one pair is reciprocal.
        merged = materialise(_merges(_ward_pairs(nearest), state, len(done)), "merges")
        done.append(merged)
        joined = merged.join(state.select(F.col("c").alias("a"), F.col("vec").alias("va"), F.col("size").alias("na")), "a")
        joined = joined.join(state.select(F.col("c").alias("b"), F.col("vec").alias("vb"), F.col("size").alias("nb")), "b")
        mean = F.zip_with("va", "vb", lambda x, y: (x * F.col("na") + y * F.col("nb")) / (F.col("na") + F.col("nb")))
        grown = joined.select(F.col("a").alias("c"), mean.alias("vec"), F.col("round").alias("tip"), F.col("distance").alias("height"), "size")
        touched = merged.select(F.explode(F.array("a", "b")).alias("c"))
        next_state = materialise(state.join(touched, "c", "left_anti").unionByName(grown), "state")
        # A nearest cluster stays nearest unless it or its owner was merged.
        kept = nearest.join(touched, "c", "left_anti").join(touched.withColumnRenamed("c", "nbr"), "nbr", "left_anti")
        known = materialise(kept.select("c", "nbr", "dist"), "known")
        release(state, index.blocks, nearest)
        state, left = next_state, next_state.count()
    return _all(spark, done)


def _ward_pairs(nearest: DataFrame) -> DataFrame:
    """Reciprocal pairs, where a cluster is also reciprocal to one at exactly its own nearest distance."""
    each = nearest.select(F.least("c", "nbr").alias("a"), F.greatest("c", "nbr").alias("b"), "dist", "c")
    own = nearest.select("c", F.col("dist").alias("own"))
    pairs = each.select("a", "b", "dist").distinct()
    pairs = pairs.join(own.withColumnRenamed("c", "a").withColumnRenamed("own", "da"), "a")
    pairs = pairs.join(own.withColumnRenamed("c", "b").withColumnRenamed("own", "db"), "b")
    pairs = pairs.where("dist <= da AND dist <= db").select("a", "b", "dist")
    # Of several equal pairs at one cluster, each cluster takes the one with the smallest ids.
    sides = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct("a", "b").alias("pair"), "dist")
    first = sides.groupBy("c").agg(F.min("pair").alias("pair"), F.min("dist").alias("dist"))
    return first.groupBy("pair").agg(F.count("*").alias("n"), F.min("dist").alias("dist")).where("n = 2").select(
        F.col("pair.a").alias("a"), F.col("pair.b").alias("b"), "dist"
    )


def tree_merges(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node_id, left_id, right_id, distance, size): leaves 0..k-1 in cluster order, inner nodes by height."""
    leaves = materialise(number_rows(clusters.select("cluster").distinct(), ["cluster"], "leaf"), "leaves")
    k = leaves.count()
    merges = materialise(merges, "merges")
    ranked = materialise(number_rows(merges, ["distance", "round", "a"], "rank"), "ranked")
    ranked = ranked.withColumn("node_id", F.col("rank") + F.lit(k))

    def side(df: DataFrame, name: str) -> DataFrame:
        leaf = leaves.select(F.col("cluster").cast("bigint").alias(name), F.col("leaf").alias(f"{name}_leaf"))
        inner = ranked.select(F.col("a").alias(name), F.col("round").alias(f"{name}_tip"), F.col("node_id").alias(f"{name}_node"))
        return df.join(leaf, name, "left").join(inner, [name, f"{name}_tip"], "left")

    both = side(side(ranked, "a"), "b")
    left, right = F.coalesce("a_node", "a_leaf"), F.coalesce("b_node", "b_leaf")
    return both.select(
        "node_id", F.least(left, right).alias("left_id"), F.greatest(left, right).alias("right_id"), "distance", "size"
    )


def tree_nodes(merges: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node_id, parent_id, side, name, cluster_id, distance, leaves) of the tree of ``tree_merges``."""
    leaves = number_rows(clusters.select("cluster").distinct(), ["cluster"], "node_id")
    top = merges.agg(F.max("node_id").alias("top"))
    inner = merges.select("node_id", F.lit(None).cast("int").alias("cluster_id"), "distance", F.col("size").alias("leaves"))
    ends = leaves.select("node_id", F.col("cluster").cast("int").alias("cluster_id"), F.lit(None).cast("double").alias("distance"), F.lit(1).cast("bigint").alias("leaves"))
    up = merges.select(F.col("node_id").alias("parent_id"), F.inline(F.array(
        F.struct(F.col("left_id").alias("node_id"), F.lit("left").alias("side")),
        F.struct(F.col("right_id").alias("node_id"), F.lit("right").alias("side")),
    )))
    nodes = inner.unionByName(ends).join(up, "node_id", "left").join(F.broadcast(top))
    name = (
        F.when(F.col("cluster_id").isNotNull(), F.concat(F.lit("cluster_"), "cluster_id"))
        .when(F.col("node_id") == F.col("top"), F.lit("root"))
        .otherwise(F.concat(F.lit("node_"), "node_id"))
    )
    return nodes.select("node_id", "parent_id", "side", name.alias("name"), "cluster_id", "distance", "leaves")


def tree_lines(nodes: DataFrame) -> DataFrame:
    """(line_no, line) of the nested JSON document, so that it can be written by many tasks in order.

    A subtree of L leaves takes 10 L - 6 lines, so each node's first line and depth follow from its
    ancestors; they are summed by doubling the reach of a pointer to the ancestor, in log(depth) joins.
    """
    lines = F.col("leaves") * 10 - 6
    first = nodes.where("side = 'left'").select("parent_id", lines.alias("before"))
    steps = nodes.join(first, "parent_id", "left").select(
        "node_id", F.col("parent_id").alias("up"),
        F.when(F.col("side") == "left", F.lit(3)).when(F.col("side") == "right", F.col("before") + 3).otherwise(F.lit(0)).alias("at"),
        F.when(F.col("side").isNull(), F.lit(0)).otherwise(F.lit(1)).alias("depth"),
    )
    spots = materialise(steps, "spots")
    while not spots.where("up IS NOT NULL").isEmpty():
        above = spots.select(F.col("node_id").alias("up"), F.col("up").alias("up2"), F.col("at").alias("at2"), F.col("depth").alias("depth2"))
        climbing = spots.where("up IS NOT NULL").join(above, "up").select(
            "node_id", F.col("up2").alias("up"), (F.col("at") + F.col("at2")).alias("at"), (F.col("depth") + F.col("depth2")).alias("depth")
        )
        climbed = materialise(climbing.unionByName(spots.where("up IS NULL")), "spots")
        release(spots)
        spots = climbed
    pad = F.repeat(F.lit("    "), F.col("depth"))
    inside = F.concat(pad, F.lit("  "))
    close = F.concat(pad, F.when(F.col("side") == "left", F.lit("},")).otherwise(F.lit("}")))
    size = F.col("leaves") * 10 - 6

    def text(offset, value):
        return F.struct((F.col("at") + offset).cast("bigint").alias("line_no"), value.alias("line"))

    title = F.concat(inside, F.lit('"name": "'), "name", F.lit('",'))
    leaf = F.array(
        text(F.lit(0), F.concat(pad, F.lit("{"))), text(F.lit(1), title),
        text(F.lit(2), F.concat(inside, F.lit('"cluster_id": '), F.col("cluster_id").cast("string"))), text(F.lit(3), close),
    )
    inner = F.array(
        text(F.lit(0), F.concat(pad, F.lit("{"))), text(F.lit(1), title),
        text(F.lit(2), F.concat(inside, F.lit('"children": ['))), text(size - 3, F.concat(inside, F.lit("],"))),
        text(size - 2, F.concat(inside, F.lit('"distance": '), F.col("distance").cast("string"))), text(size - 1, close),
    )
    placed = nodes.join(spots.select("node_id", "at", "depth"), "node_id")
    return placed.select(F.inline(F.when(F.col("cluster_id").isNotNull(), leaf).otherwise(inner)))


def small_tree_lines(clusters: DataFrame) -> DataFrame:
    """The document for fewer than two clusters."""
    one = clusters.agg(F.coalesce(F.min("cluster"), F.lit(-1)).alias("c"))
    rows = F.array(F.lit("{"), F.concat(F.lit('  "name": "cluster_'), "c", F.lit('",')), F.lit('  "children": []'), F.lit("}"))
    return one.select(F.posexplode(rows).alias("line_no", "line")).select(F.col("line_no").cast("bigint").alias("line_no"), "line")


def tree_document(merges: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(numbered merges, document lines) from linkage merges and the (cluster) rows they join."""
    spark = clusters.sparkSession
    if clusters.select("cluster").distinct().limit(2).count() < 2:
        return spark.createDataFrame([], TREE_MERGES), small_tree_lines(clusters)
    numbered = materialise(tree_merges(merges, clusters), "tree")
    return numbered, tree_lines(materialise(tree_nodes(numbered, clusters), "nodes"))
