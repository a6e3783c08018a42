import numpy as np
import pytest

from gavilla.operators import keys, merge_tree as MT


def plain(edges, copies):
    """Merges edge by edge."""
    top, size, out = {}, dict(copies), {}
    find = lambda x: find(top[x]) if x in top else x
    members = {i: {i} for i in copies}
    for rank, (w, a, b) in enumerate(sorted((w, min(a, b), max(a, b)) for a, b, w in edges)):
        left, right, node = find(a), find(b), -rank - 1
        top[left] = top[right] = node
        size[node], members[node] = size[left] + size[right], members[left] | members[right]
        out[node] = (min(left, right), max(left, right), w, size[node])
    return out, members


def check(spark, edges, copies):
    tree = spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "a bigint, b bigint, weight double")
    sizes = spark.createDataFrame([(int(i), int(n)) for i, n in copies.items()], "id bigint, copies bigint")
    merges, leaves = MT.merge_tree(tree, sizes)
    rows, spots = merges.collect(), {r.id: r.lo for r in leaves.collect()}
    wanted, members = plain(edges, copies)
    assert {r.node: (r.left, r.right, r.dist, r["size"]) for r in rows} == wanted and len(rows) == len(wanted)
    # Every subtree is the run of its points.
    for r in rows:
        inside = sorted((spots[i], copies[i]) for i in members[r.node])
        assert inside[0][0] == r.lo and sum(n for _, n in inside) == r["size"]
        assert all(s + n == t for (s, n), (t, _) in zip(inside, inside[1:]))


def random_tree(n, seed, ties):
    r = np.random.RandomState(seed)
    ids = r.permutation(10 * n)[:n]
    weights = r.randint(0, 4, n) / 4 if ties else r.rand(n)
    return [(ids[r.randint(max(0, i - (3 if seed % 2 else i)), i)], ids[i], weights[i]) for i in range(1, n)], {int(i): int(r.randint(1, 4)) for i in ids}


@pytest.mark.parametrize("seed", range(4))
def test_merges_and_places_of_random_trees(spark, seed):
    check(spark, *random_tree(150, seed, ties=seed > 1))


def test_path_of_equal_steps_and_rising_path(spark):
    for step in (lambda i: 1.0, lambda i: float(i), lambda i: float(-i % 17)):
        check(spark, [(i, i + 1, step(i)) for i in range(200)], {i: 1 for i in range(201)})


@pytest.mark.parametrize("plain_rows", [keys.PLAIN, 10])
def test_star_and_forest(spark, monkeypatch, plain_rows):
    """A hub that a third of all points hang on, several trees and a leaf without edges; once with hot keys split."""
    monkeypatch.setattr(keys, "PLAIN", plain_rows)
    star = [(0, i, i % 7) for i in range(1, 80)]
    pairs = [(1000 + i, 1001 + i, 3) for i in range(0, 20, 2)]
    copies = {i: 1 for i in range(80)} | {1000 + i: 2 for i in range(20)} | {5000: 9}
    check(spark, star + pairs, copies)


def test_no_edges(spark):
    check(spark, [], {1: 1})


def test_long_path(spark):
    """10,000 equal steps: merges in the order of the ids, in a bounded number of levels."""
    n = 10_000
    tree = spark.range(n).selectExpr("id AS a", "id + 1 AS b", "1.0D AS weight")
    merges, _ = MT.merge_tree(tree, spark.range(n + 1).selectExpr("id", "1L AS copies"))
    found = merges.orderBy("size").toPandas()
    assert found["size"].tolist() == list(range(2, n + 2)) and found["node"].tolist() == [-r - 1 for r in range(n)]
    assert (found["right"] == np.append([1], np.arange(2, n + 1))).all() and (found["lo"] == 0).all()
