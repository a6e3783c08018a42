import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavilla.functions import text as T
from gavilla.operators import components as C, density as D, hierarchy as H, minhash as M, neighbours as N, summary as S, tfidf as TF
from gavilla.operators.descent import descent_topk
from tests import brute
from tests.test_merge_tree import plain as plain_merges


def vectors(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "id bigint, vec array<double>")


@pytest.fixture(scope="module")
def blobs():
    r = np.random.RandomState(3)
    centres = r.normal(size=(3, 6))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    parts = [c + s * r.normal(size=(n, 6)) for c, n, s in zip(centres, (60, 70, 50), (0.15, 0.08, 0.2))]
    x = np.concatenate([*parts, r.normal(size=(40, 6))])
    x = np.concatenate([x, np.repeat(x[70:71], 7, 0)])
    return x / np.linalg.norm(x, axis=1)[:, None]


def test_signature_is_the_minimum_over_grams(spark):
    df = spark.createDataFrame([(0, "hola mundo"), (1, "ab"), (2, "hola mundos")], "id bigint, comentario_clean string")
    hashes = {r["id"]: r["h"] for r in df.select("id", F.transform(T.gram_set(F.col("comentario_clean")), T.gram_hash).alias("h")).collect()}
    for row in M.signatures(df, 16).collect():
        assert row["sig"] == [min((h * a + b) % T.PRIME for h in hashes[row["id"]]) for a, b in M.coefficients(16)]


def test_estimate_is_near_the_true_jaccard(spark):
    words = ["gato", "perro", "casa", "mesa", "luna", "sol", "mar", "rio"]
    r = np.random.RandomState(0)
    texts = [" ".join(r.choice(words, 6)) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, comentario_clean string")
    sigs = {row["id"]: np.array(row["sig"]) for row in M.signatures(df).collect()}
    sets = [{t[i : i + n] for n in (3, 4, 5) for i in range(len(t) - n + 1)} for t in texts]
    errors = [
        abs(np.mean(sigs[i] == sigs[j]) - len(sets[i] & sets[j]) / len(sets[i] | sets[j])) for i in range(30) for j in range(i)
    ]
    assert np.mean(errors) < 1 / np.sqrt(128)


def test_components_of_chains_and_stars(spark):
    edges = [(0, 1), (1, 2), (5, 9)] + [(100, i) for i in range(101, 140)] + [(i, i + 1) for i in range(200, 240)]
    found = C.connected_components(spark.createDataFrame(edges, "a bigint, b bigint"))
    roots = {r["id"]: r["root"] for r in found.collect()}
    assert roots == {0: 0, 1: 0, 2: 0, 5: 5, 9: 5, **{i: 100 for i in range(100, 140)}, **{i: 200 for i in range(200, 241)}}
    labels = C.label_components(spark.range(10), found.where("id < 10")).orderBy("id").collect()
    assert [r["cluster"] for r in labels] == [0, 0, 0, -1, -1, 1, -1, -1, -1, 1]


def test_empty_input_gives_empty_frames(spark):
    edges = spark.createDataFrame([], "a bigint, b bigint")
    labels = C.label_components(spark.range(0), C.connected_components(edges))
    assert labels.count() == 0
    assert S.run_metrics(labels).first().asDict() == {"n_texts": 0, "n_clusters": 0, "n_noise": 0, "noise_pct": None}


def test_star_edges_of_hot_buckets(spark):
    """Three buckets of thirty, and one that holds a third of all rows."""
    df = spark.createDataFrame([(0, f"b{i % 3}", i) for i in range(90)], "band int, bucket string, id bigint")
    assert sorted(map(tuple, M.star_edges(df).collect())) == [(i, i % 3) for i in range(3, 90)]
    df = spark.range(6000).selectExpr("0 as band", "if(id % 3 = 0, 'hot', concat('b', id % 1500)) as bucket", "id")
    found = {(r.id, r.hub) for r in M.star_edges(df).collect()}
    first = {}
    wanted = {(i, first.setdefault("hot" if i % 3 == 0 else i % 1500, i)) for i in range(6000)}
    assert found == {(i, h) for i, h in wanted if i != h}


def test_probes_of_a_hot_bucket(spark, monkeypatch):
    """A third of all rows share a bucket that most probes ask for; cut into parts it gives the same pairs."""
    rows = [(0, "hot" if i % 3 == 0 else f"b{i % 400}", i) for i in range(3000)]
    asked = [(0, "hot", p) for p in range(5)] + [(0, "b7", 0), (0, "b10", 9), (0, "none", 3), (1, "hot", 8)]
    wanted = {(p, i) for band, bucket, p in asked for b, other, i in rows if (b, other) == (band, bucket)}
    frames = [spark.createDataFrame(x, "band int, bucket string, id bigint") for x in (asked, rows)]
    for part in (M.LEAST_PART, 16):
        monkeypatch.setattr(M, "LEAST_PART", part)
        found = M.query_candidates(*frames).collect()
        assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_vocabulary_cut_with_ties(spark):
    r = np.random.RandomState(2)
    totals = {f"t{i}": int(x) for i, x in enumerate(r.choice([1, 1, 1, 2, 5, 900, 70_000, 70_001, 3_000_000], 300))}
    counts = spark.createDataFrame([(0, t, n - n // 3) for t, n in totals.items()] + [(1, t, n // 3) for t, n in totals.items() if n // 3], "id bigint, term string, tf bigint")
    for limit in (1, 40, 150, 260, 299, 300, 999):
        found = [(x["term"], x["total"]) for x in TF.vocabulary(counts, limit).collect()]
        assert sorted(found) == sorted(sorted(totals.items(), key=lambda x: (-x[1], x[0]))[:limit])
    assert TF.vocabulary(counts.limit(0), 5).count() == 0


def test_topk_with_a_large_group_of_copies(spark):
    r = np.random.RandomState(1)
    x = r.normal(size=(60, 5))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x = np.concatenate([x, np.repeat(x[5:6], 40, 0), x[:3]])
    sim = np.round(x @ x.T, 12)
    np.fill_diagonal(sim, -9)
    wanted = np.array([np.lexsort((np.arange(len(x)), -row))[:8] for row in sim])
    rows = N.cosine_topk(vectors(spark, x), 8).orderBy("id", "rank").collect()
    assert np.array_equal(np.array([r["nbr_id"] for r in rows]).reshape(-1, 8), wanted)


def test_pruned_search_and_probing_agree_with_all_pairs(spark, blobs):
    x = np.unique(blobs, axis=0)
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    wanted = np.argsort(-sim, axis=1, kind="stable")[:, :10]
    exact = N.cosine_topk(vectors(spark, x), 10, cells=12).orderBy("id", "rank").collect()
    assert np.array_equal(np.array([r["nbr_id"] for r in exact]).reshape(-1, 10), wanted)
    probed = N.ivf_topk(vectors(spark, x), 10, nlist=6, nprobe=6).orderBy("id", "rank").collect()
    assert np.array_equal(np.array([r["nbr_id"] for r in probed]).reshape(-1, 10), wanted)


def test_spanning_tree_and_density_labels(spark, blobs):
    weight = brute.reach(blobs, 5)
    leaves, tree, copies = D.density_graph(vectors(spark, blobs), 8)
    edges = D.full_tree(leaves, tree, copies).toPandas()
    assert np.abs(np.sort(edges["weight"]) - brute.prim(weight)).max() < 1e-9
    # The hierarchy is that of merging edge by edge.
    copies_of = {r["id"]: r["copies"] for r in leaves.collect()}
    merges = {r["node"]: (r["left"], r["right"], r["dist"], r["size"]) for r in D.single_linkage(tree, leaves.select("id", "copies")).collect()}
    assert merges == plain_merges(map(tuple, tree.collect()), copies_of)[0] and max(m[3] for m in merges.values()) == len(blobs)
    labels = D.density_clusters(vectors(spark, blobs), 20, k=8).orderBy("id").toPandas()["cluster"].to_numpy()
    wanted = brute.density_labels(weight, 20)
    # Equal merge distances leave single points free to fall on either side of a split.
    assert (labels == wanted).mean() > 0.97 and set(labels) == set(wanted)


def test_cluster_choice_along_a_run(spark):
    # A run of nested clusters with side branches; the best totals are known from a direct recursion.
    rows, r = [(0, None, 0.0, 99, 1.0)], np.random.RandomState(2)
    for i in range(1, 30):
        parent = 0 if i == 1 else 2 * i - 3
        rows += [(2 * i - 1, parent, 0.0, 30, float(r.rand() * 3)), (2 * i, parent, 0.0, 30, float(r.rand()))]
    df = spark.createDataFrame(rows, "cluster bigint, parent bigint, birth double, size bigint, stability double")
    kids = {c: [x[0] for x in rows if x[1] == c] for c, *_ in rows}
    own = {x[0]: x[4] for x in rows}

    def best(c):
        below = [best(k) for k in kids[c]]
        total = sum(b for b, _ in below)
        if c != 0 and own[c] >= total:
            return own[c], {c}
        return max(own[c], total), set().union(*[s for _, s in below])

    found = {row["chosen"] for row in D.choose_clusters(df).where("chosen IS NOT NULL").collect()}
    assert found == best(0)[1]


def naive_linkage(n, cost):
    groups, heights = {i: [i] for i in range(n)}, []
    while len(groups) > 1:
        keys = sorted(groups)
        d, a, b = min((cost(groups[p], groups[q]), p, q) for i, p in enumerate(keys) for q in keys[i + 1 :])
        heights.append(d)
        groups[a] += groups.pop(b)
    return np.array(heights)


def check_document(lines, n):
    text = "\n".join(r["line"] for r in lines.orderBy("line_no").collect())
    tree = json.loads(text)
    assert json.dumps(tree, indent=2) == text and tree["name"] == "root"

    def leaves(node):
        return [node["cluster_id"]] if "cluster_id" in node else sum((leaves(c) for c in node["children"]), [])

    assert sorted(leaves(tree)) == list(range(n))


def test_ward_linkage(spark):
    n, r = 12, np.random.RandomState(0)
    x = r.normal(size=(n, 4))
    clusters = spark.range(n).withColumnRenamed("id", "cluster")
    centres = vectors(spark, x).withColumnsRenamed({"id": "cluster", "vec": "centroid"})

    def ward(a, b):
        return np.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(x[a].mean(0) - x[b].mean(0))

    for limit in (500, 2):
        found = H.tree_document(H.ward_linkage(centres, limit), clusters)[0].orderBy("node_id").collect()
        assert np.allclose([m["distance"] for m in found], naive_linkage(n, ward))


def test_average_tree_of_sparse_signatures(spark):
    """Every head is a leaf; heads that share no position are joined at distance 1."""
    n, r = 30, np.random.RandomState(3)
    sigs = 1000 * np.arange(n)[:, None] + np.arange(64)
    for i, j in [(0, 1), (1, 2), (3, 4), (5, 6), (6, 7), (5, 8), (10, 20), (20, 21), (0, 10)]:
        at = r.choice(64, r.randint(5, 40), replace=False)
        sigs[j, at] = sigs[i, at]
    dist = 1 - (sigs[:, None] == sigs[None]).mean(-1)
    heads = spark.createDataFrame([(i, i, s.tolist()) for i, s in enumerate(sigs)], "cluster int, id bigint, sig array<bigint>")
    pairs = H.representative_distances(heads)
    found = {(p["a"], p["b"]): p["dist"] for p in pairs.collect()}
    assert found == {(i, j): dist[i, j] for i in range(n) for j in range(i + 1, n) if dist[i, j] < 1}
    merges, lines = H.tree_document(H.average_linkage(pairs, heads), heads)
    rows = merges.orderBy("node_id").collect()
    assert np.allclose([m["distance"] for m in rows], naive_linkage(n, lambda a, b: dist[np.ix_(a, b)].mean()))
    assert len(rows) == n - 1 and rows[-1]["size"] == n and sorted(x for m in rows for x in (m["left_id"], m["right_id"])) == list(range(2 * n - 2))
    check_document(lines, n)


def test_trees_of_none_and_one(spark):
    one = spark.range(1).select(F.lit(4).alias("cluster"))
    for clusters, name in ((one, "cluster_4"), (one.where("cluster < 0"), "cluster_-1")):
        merges, lines = H.tree_document(H.average_linkage(spark.createDataFrame([], "a bigint, b bigint, dist double"), clusters), clusters)
        text = "\n".join(r["line"] for r in lines.orderBy("line_no").collect())
        assert json.loads(text) == {"name": name, "children": []} and merges.count() == 0


def test_descent_finds_the_neighbours(spark, blobs):
    """Copies, a point that many name, and fewer points than list places."""
    x = np.random.RandomState(6).normal(size=(400, 16))
    x = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.repeat(x[:1] / np.linalg.norm(x[0]), 30, 0)])
    sim = x @ x.T
    np.fill_diagonal(sim, -9)
    rows = descent_topk(vectors(spark, x), 10).collect()
    found = {}
    for r in rows:
        found.setdefault(r["id"], []).append(r)
        assert abs(sim[r["id"], r["nbr_id"]] - r["sim"]) < 1e-9
    worst = np.sort(sim, axis=1)[:, -10]
    hits = [np.mean([r["sim"] >= worst[i] - 1e-9 for r in found[i]]) for i in range(len(x))]
    assert len(rows) == 10 * len(x) and np.mean(hits) > 0.95
    few = descent_topk(vectors(spark, x[:4]), 10).collect()
    assert sorted((r["id"], r["nbr_id"]) for r in few) == [(i, j) for i in range(4) for j in range(4) if i != j]
    assert descent_topk(vectors(spark, x[:1]), 10).count() == 0


def test_tree_over_approximate_neighbours_is_exact_for_its_core_distances(spark, blobs):
    """Lists that miss near points: with the bound of exact lists the tree would miss them too."""
    x = np.unique(blobs, axis=0)
    dist = brute.pairwise(x)
    r = np.random.RandomState(0)
    knn = [(i, rank, int(j), float(dist[i, j])) for i in range(len(x)) for rank, j in enumerate(sorted(r.choice([k for k in range(len(x)) if k != i], 8, False), key=lambda j: dist[i, j]), 1)]
    lists = spark.createDataFrame(knn, "id bigint, rank int, nbr_id bigint, dist double")
    _, tree, _ = D.density_graph(vectors(spark, x), 8, knn=lists)
    core = {r["id"]: r["core"] for r in D.core_distances(lists).collect()}
    c = np.array([core[i] for i in range(len(x))])
    weight = np.maximum(dist, np.maximum(c[:, None], c[None]))
    np.fill_diagonal(weight, np.inf)
    assert np.abs(np.sort([r["weight"] for r in tree.collect()]) - brute.prim(weight)).max() < 1e-9
