import glob
import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gavilla.operators import prepare as P, tfidf as TF
from gavilla.plans import catalog, pipelines as R
from gavilla.sources import files
from gavilla.sources.stages import stage


def read_parts(path):
    return "".join(open(p, encoding="utf-8").read() for p in sorted(glob.glob(f"{path}/part-*")))


def test_projection_matches_a_dense_decomposition(spark, sf):
    rows, terms = TF.tfidf_rows(catalog.short_texts(spark, sf))
    n = terms.count()
    found = rows.orderBy("id").collect()
    dense = np.zeros((len(found), n))
    for i, row in enumerate(found):
        dense[i, row["term_ids"]] = row["weights"]
    assert np.allclose(np.linalg.norm(dense, axis=1), 1)
    u, s, _ = np.linalg.svd(dense, full_matrices=False)
    values, directions = TF.right_vectors(rows, n, 10)
    assert np.allclose(directions.T @ directions, np.eye(10), atol=1e-6) and np.all(np.diff(values) <= 0)
    width = min(256, n - 1, len(found) - 1)
    vectors = np.array([r["vec"] for r in TF.svd_vectors(rows, terms).orderBy("id").collect()], dtype=float)
    full = (u * s)[:, :width]
    full /= np.linalg.norm(full, axis=1)[:, None]
    assert np.abs(vectors @ vectors.T - full @ full.T).max() < 0.05


def test_sparse_products_with_dense_and_rare_terms():
    rng = np.random.RandomState(3)
    dense = rng.normal(size=(3 * TF.RUN // 2, 700)) * (rng.rand(3 * TF.RUN // 2, 700) < np.r_[np.full(100, 0.3), np.full(600, 0.001)])
    dense[5] = 0  # a row without terms
    cells = [np.flatnonzero(row) for row in dense]
    batch = pa.RecordBatch.from_arrays([pa.array(cells, pa.list_(pa.int64())), pa.array([row[c] for row, c in zip(dense, cells)], pa.list_(pa.float64()))], names=["term_ids", "weights"])
    right, total = rng.normal(size=(700, 6)), np.zeros((700, 6))
    assert np.allclose(TF._times(batch, right), dense @ right)
    for dealt in TF._dealt(batch, 700, np.float64):
        assert 100 <= len(dealt[2]) < 200  # the frequent terms are one matrix
        TF._add_back(dealt, TF._forward(dealt, right), total)
    assert np.allclose(total, dense.T @ (dense @ right))


def test_both_methods_end_to_end(spark, sf, tmp_path):
    df = catalog.turns(spark, sf)
    config = R.Config(min_cluster_size=4, encoder=catalog.letter_encoder, encoder_id="letters")
    results = R.run(df, ["conv_id", "turn"], config, str(tmp_path), text="text")
    total = catalog.short_texts(spark, sf).count()
    for name, result in results.items():
        rows = [json.loads(line) for line in read_parts(tmp_path / f"clusters_{name}").splitlines()]
        groups = [json.loads(line) for line in read_parts(tmp_path / f"clusters_agregados_{name}").splitlines()]
        tree = json.loads(read_parts(tmp_path / f"dendrograma_{name}"))
        assert sorted(r["id"] for r in rows) == list(range(total)) and sum(g["size"] for g in groups) == total
        assert {g["cluster"] for g in groups} == {r["cluster"] for r in rows} and "name" in tree
        assert result.metrics.first()["n_texts"] == total
        array = json.loads("\n".join(r["line"] for r in files.assignment_lines(result.assigned).orderBy("line_no").collect()))
        assert sorted(r["id"] for r in array) == list(range(total))
        keyed = json.loads("\n".join(r["line"] for r in files.aggregate_lines(result.aggregates).orderBy("line_no").collect()))
        assert {int(k): v["size"] for k, v in keyed.items()} == {g["cluster"]: g["size"] for g in groups}


def test_stage_is_made_again_when_parameters_or_input_change(spark, tmp_path):
    made = []

    def run(n, params):
        def make():
            made.append(params)
            return spark.range(n)

        return stage(spark, str(tmp_path / "s"), params, spark.range(n), make).count()

    assert run(3, {"k": 1}) == 3 and run(3, {"k": 1}) == 3 and len(made) == 1
    assert run(3, {"k": 2}) == 3 and len(made) == 2
    assert run(4, {"k": 2}) == 4 and len(made) == 3


def test_changed_encoder_is_not_taken_for_the_saved_one(spark, tmp_path, monkeypatch):
    # Only the vectors matter here.
    monkeypatch.setattr(R.D, "density_clusters", lambda points, *_, **__: points.select("id", F.lit(-1).alias("cluster")))
    rows = [(i, f"text {i}", f"{'ab' * (i % 5)} text {'c' * (i % 3)} {i % 7}") for i in range(40)]
    texts = spark.createDataFrame(rows, "id bigint, comentario string, comentario_clean string")

    def encoder(letters):
        return lambda: lambda texts: np.array([[1.0 + str(t).count(c) for c in letters] for t in texts])

    def vectors(name, letters):
        config = R.Config(min_cluster_size=4, encoder=encoder(letters), encoder_id=name)
        R.run_coseno(texts, config, checkpoints=str(tmp_path))
        return [r["vec"] for r in spark.read.parquet(f"{tmp_path}/vectors/data").orderBy("id").collect()]

    first = vectors("one", "abc")
    assert vectors("one", "abc") == first and vectors("two", "xyz") != first
    with pytest.raises(ValueError):
        R.run_coseno(texts, R.Config(encoder=encoder("abc")), checkpoints=str(tmp_path))
    with pytest.raises(ValueError):
        R.run_coseno(texts, R.Config(encoder="no such name"))


@pytest.mark.parametrize("neighbours", ["ivf", "hyperplane"])
def test_approximate_neighbours_find_separate_groups(spark, neighbours):
    rng = np.random.RandomState(5)
    centre = rng.normal(size=(3, 8)) * 4
    x = np.concatenate([c + rng.normal(size=(30, 8)) * 0.1 for c in centre])
    texts = spark.createDataFrame([(i, str(i), str(i)) for i in range(90)], "id bigint, comentario string, comentario_clean string")
    config = R.Config(min_cluster_size=10, top_k=8, neighbours=neighbours, encoder=lambda: lambda names: np.array([x[int(n)] for n in names]))
    labels = {r["id"]: r["cluster"] for r in R.run_coseno(texts, config).labels.collect()}
    assert [len({labels[i] for i in range(g * 30, g * 30 + 30)} - {-1}) for g in range(3)] == [1, 1, 1]


def test_literal_tree_limit_is_reported(spark):
    rows = [(2 * i + j, w, w) for i, w in enumerate(["the quick brown fox", "lorem ipsum dolor", "a third thing here"]) for j in range(2)]
    texts = spark.createDataFrame(rows, "id bigint, comentario string, comentario_clean string")
    for limit, left_out in ((None, 0), (2, 1)):
        result = R.run_jaccard(texts, R.Config(tree_clusters=limit))
        assert result.metrics.first()["n_left_out_of_tree"] == left_out
        assert result.merges.count() == 2 - left_out


def test_large_single_line_csv_uses_many_partitions(spark, tmp_path, request):
    path = tmp_path / "big.csv"
    path.write_text("comentario\n" + "".join(f"text number {i}\n" for i in range(40_000)), encoding="utf-8")
    # Small as it is, the file is to be cut and dealt as a large one would be.
    for key, value in (("adaptive.coalescePartitions.enabled", "false"), ("files.maxPartitionBytes", "64k"), ("files.openCostInBytes", "0")):
        before = spark.conf.get(f"spark.sql.{key}")
        request.addfinalizer(lambda key=key, before=before: spark.conf.set(f"spark.sql.{key}", before))
        spark.conf.set(f"spark.sql.{key}", value)
    loaded = P.load_and_clean(files.read_csv_texts(spark, str(path), multi_line=False), files.POSITION)
    sizes = [r["count"] for r in loaded.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 20_000
    assert [r["comentario"] for r in loaded.orderBy("id").limit(3).collect()] == [f"text number {i}" for i in range(3)]


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (found.apply(i).getName() for i in range(found.size())) if name.startswith("shuffle_")}


def test_written_tables_and_passes_of_the_projection_leave_no_shuffle_files(spark):
    import time

    import numpy as np

    from gavilla.operators import tfidf as TF
    from gavilla.session import CLEANUP_KEY, materialise

    rows = spark.range(40).selectExpr("id", "array(id % 3, 3L) AS term_ids", "array(0.6D, 0.8D) AS weights").repartition(3, "id")
    had, before = spark.conf.get(CLEANUP_KEY, None), shuffle_files(spark)
    assert materialise(rows).count() == 40
    assert TF._gram_times(rows, np.eye(4)).round(5)[3, 3] == 25.6
    left = lambda: {f for f in shuffle_files(spark) - before if f.endswith(".data")}
    until = time.time() + 20
    while len(left()) > 2 and time.time() < until:
        time.sleep(0.2)
    # The count of the written table has a shuffle of its own.
    assert len({f.split("_")[1] for f in left()}) <= 1
    assert spark.conf.get(CLEANUP_KEY, None) == had
