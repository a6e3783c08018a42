"""Per-cluster sizes, samples, centroids, representatives and run metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gavilla.operators.keys import smallest_per_group

NOISE = -1
# Fixed values of the exports: samples per cluster, leaves of the literal tree.
SAMPLES = 10
TREE_CLUSTERS = 500


def attach_labels(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, comentario, cluster) with the text as it was read."""
    return texts.select("id", "comentario").join(labels, "id").select("id", "comentario", "cluster")


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("size"))


def cluster_samples(assigned: DataFrame, n_samples: int = SAMPLES) -> DataFrame:
    """(cluster, sample_comments): first texts of each cluster in id order."""
    first = smallest_per_group(assigned, "cluster", [F.col("id")], n_samples)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "comentario")))
    return first.groupBy("cluster").agg(F.transform(ordered, lambda s: s["comentario"]).alias("sample_comments"))


def drop_noise(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("cluster") != NOISE)


def centroids(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, centroid): element-wise mean without noise, not rescaled.

    Means are combined before the shuffle, one buffer per cluster and map task, so a cluster holding most
    rows costs no more than a small one.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    members = vectors.join(drop_noise(labels), "id")
    vector = array_to_vector(F.col("vec").cast("array<double>"))
    means = members.groupBy("cluster").agg(Summarizer.mean(vector).alias("mean"))
    return means.select("cluster", vector_to_array("mean").alias("centroid"))


def aggregates(assigned: DataFrame, centres: DataFrame | None = None, n_samples: int = SAMPLES) -> DataFrame:
    """(cluster, size, sample_comments[, centroid])."""
    joined = cluster_sizes(assigned).join(cluster_samples(assigned, n_samples), "cluster")
    if centres is not None:
        joined = joined.join(centres, "cluster", "left")
    return joined


def largest_clusters(labels: DataFrame, limit: int = TREE_CLUSTERS) -> DataFrame:
    """(cluster, size) of the ``limit`` largest clusters, equal sizes in label order."""
    return cluster_sizes(drop_noise(labels)).orderBy(F.desc("size"), "cluster").limit(limit)


def representatives(sigs: DataFrame, labels: DataFrame) -> DataFrame:
    """(cluster, id, sig) of the smallest id in each cluster."""
    heads = drop_noise(labels).groupBy("cluster").agg(F.min("id").alias("id"))
    return sigs.join(heads, "id").select("cluster", "id", "sig")


def distinct_labels(labels: DataFrame) -> DataFrame:
    return labels.select("cluster").distinct().orderBy("cluster")


def run_metrics(labels: DataFrame) -> DataFrame:
    """One row: ids, clusters, noise ids and noise percentage (null without rows)."""
    noise = F.col("cluster") == NOISE
    total = F.sum("size")
    sizes = cluster_sizes(labels)
    return sizes.agg(
        F.coalesce(total, F.lit(0)).alias("n_texts"),
        F.count_if(~noise).alias("n_clusters"),
        F.coalesce(F.sum(F.when(noise, F.col("size"))), F.lit(0)).alias("n_noise"),
        F.round(100.0 * F.coalesce(F.sum(F.when(noise, F.col("size"))), F.lit(0)) / total, 6).alias("noise_pct"),
    )
