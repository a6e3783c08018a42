"""The semantic and the literal run, alone or together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from gavilla.functions.banding import choose_bands
from gavilla.functions.vectors import as_float
from gavilla.operators import components as C, density as D, encode as E, hierarchy as H, keys as K, minhash as M, neighbours as N, summary as S, tfidf as TF
from gavilla.operators.descent import descent_topk
from gavilla.operators.prepare import load_and_clean
from gavilla.session import materialise
from gavilla.sources import files
from gavilla.sources.stages import stage

METHODS = ("coseno", "jaccard", "ambos")


@dataclass(frozen=True)
class Config:
    """Parameters of a run; the defaults are the usual ones for short comments."""

    method: str = "ambos"
    batch_size: int = 512
    min_cluster_size: int = 20
    top_k: int = 30
    num_perm: int = 128
    threshold: float = 0.3
    bands: int | None = None
    rows: int | None = None
    encoder: str | Callable = E.TFIDF
    # Name of a callable encoder; asked for where stages are saved, since code cannot be told apart by itself.
    encoder_id: str | None = None
    exact: bool = True
    # How the semantic run finds neighbours: "exact", "descent", "ivf" or "hyperplane". With the approximate ones core distances
    # are those among the neighbours found; the tree over them stays exact, unless ``exact`` is False.
    neighbours: str = "exact"
    nprobe: int = N.PROBE
    n_min: int = 3
    n_max: int = 5
    n_samples: int = S.SAMPLES
    # Clusters in the literal tree, the largest first; None for all. The metrics tell how many were left out.
    tree_clusters: int | None = S.TREE_CLUSTERS
    components: int = TF.COMPONENTS
    max_terms: int = TF.VOCABULARY
    # Results as one JSON document each (in numbered parts) instead of JSON lines.
    documents: bool = False


# Parameters suggested for large inputs.
LARGE = Config(batch_size=256, min_cluster_size=50, top_k=20)
FAST = Config(num_perm=64)
STRICT = Config(threshold=0.4)
WIDE = Config(threshold=0.2)


@dataclass
class Result:
    """Tables of one method; ``lines`` is the tree document."""

    labels: DataFrame
    assigned: DataFrame
    aggregates: DataFrame
    merges: DataFrame
    lines: DataFrame
    metrics: DataFrame


def _saved(path: str | None, name: str, params: dict, source: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """A stage under ``path``, or only an intermediate table without one."""
    if path is None:
        return materialise(make(), name)
    return stage(source.sparkSession, f"{path}/{name}", params, source, make)


def _export(result: Result, name: str, output: str | None, documents: bool = False) -> Result:
    if output is not None:
        if documents:
            files.write_document(files.assignment_lines(result.assigned), f"{output}/clusters_{name}")
            files.write_document(files.aggregate_lines(result.aggregates), f"{output}/clusters_agregados_{name}")
        else:
            files.write_assignments(result.assigned, f"{output}/clusters_{name}")
            files.write_aggregates(result.aggregates, f"{output}/clusters_agregados_{name}")
        files.write_document(result.lines, f"{output}/dendrograma_{name}")
    return result


def run_jaccard(texts: DataFrame, config: Config = Config(), output: str | None = None, checkpoints: str | None = None) -> Result:
    """Literal clusters of (id, comentario, comentario_clean).

    Equal cleaned texts are one text until the labels are given out, so a group of copies of any size
    costs one signature.
    """
    bands, rows = config.bands, config.rows
    if bands is None or rows is None:
        bands, rows = choose_bands(config.threshold, config.num_perm)
    keys = texts.select("id", "comentario_clean")
    copies = _saved(checkpoints, "copies", {}, keys, lambda: K.collapse_copies(keys, F.unhex(F.sha2("comentario_clean", 256))))
    singles = keys.join(copies.where("id = rep").select("id"), "id", "left_semi")
    params = {"num_perm": config.num_perm, "n_min": config.n_min, "n_max": config.n_max}
    make = lambda: M.signatures(singles, config.num_perm, config.n_min, config.n_max)
    sigs = _saved(checkpoints, "signatures", params, keys, make)

    def label() -> DataFrame:
        stars = M.star_edges(M.buckets(sigs, bands, rows))
        edges = stars.unionByName(copies.where("id <> rep").select("id", F.col("rep").alias("hub")))
        return C.label_components(texts, C.connected_components(edges))

    params = {**params, "bands": bands, "rows": rows}
    labels = _saved(checkpoints, "jaccard_labels", params, keys, label)
    heads = materialise(S.representatives(sigs, labels), "heads")
    if config.tree_clusters is not None:
        kept = materialise(S.largest_clusters(labels, config.tree_clusters).select("cluster"), "kept")
        heads = materialise(heads.join(kept, "cluster"), "heads")
    merges, lines = H.tree_document(H.average_linkage(H.representative_distances(heads), heads), heads)
    assigned = materialise(S.attach_labels(texts, labels), "assigned")
    metrics = S.run_metrics(labels).withColumn("n_left_out_of_tree", F.col("n_clusters") - F.lit(heads.count()))
    result = Result(labels, assigned, S.aggregates(assigned, n_samples=config.n_samples), merges, lines, metrics)
    return _export(result, "jaccard", output, config.documents)


def _neighbours(vectors: DataFrame, config: Config) -> DataFrame | None:
    """(id, rank, nbr_id, dist) by the configured approximate search over the distinct vectors; None for the exact one."""
    if config.neighbours == "exact":
        return None
    k = max(config.top_k, D.MIN_SAMPLES)
    reps, _ = N.distinct_vectors(vectors)
    find = {"ivf": lambda: N.ivf_topk(reps, k, nprobe=config.nprobe), "hyperplane": lambda: N.hyperplane_topk(reps, k), "descent": lambda: descent_topk(reps, k)}
    found = find[config.neighbours]()
    # Of unit vectors; rounding may lift a product above 1.
    return found.select("id", "rank", "nbr_id", F.sqrt(F.greatest(2 - 2 * F.col("sim"), F.lit(0.0))).alias("dist"))


def run_coseno(texts: DataFrame, config: Config = Config(), output: str | None = None, checkpoints: str | None = None) -> Result:
    """Semantic clusters of (id, comentario, comentario_clean)."""
    keys = texts.select("id", "comentario_clean")
    if config.neighbours not in ("exact", "ivf", "hyperplane", "descent"):
        raise ValueError(f"unknown neighbours {config.neighbours!r}")
    name = config.encoder if isinstance(config.encoder, str) else config.encoder_id
    if name is None and checkpoints is not None:
        raise ValueError("saved stages of a callable encoder need Config.encoder_id")
    params = {"encoder": name, "components": config.components, "max_terms": config.max_terms}
    embed = lambda: E.embed(keys, config.encoder, config.batch_size, config.components, config.max_terms)
    vectors = _saved(checkpoints, "vectors", params, keys, embed)
    # Later stages are told apart by the vectors themselves, whatever made them.
    params = {"top_k": config.top_k, "neighbours": config.neighbours, "nprobe": config.nprobe}
    knn = None
    if config.neighbours != "exact":
        knn = _saved(checkpoints, "neighbours", params, vectors, lambda: _neighbours(vectors, config))
    params = {**params, "min_cluster_size": config.min_cluster_size, "exact": config.exact}
    labels = _saved(
        checkpoints, "coseno_labels", params, vectors,
        lambda: D.density_clusters(vectors, config.min_cluster_size, k=config.top_k, exact=config.exact, knn=knn),
    )
    centres = materialise(S.centroids(vectors, labels), "centres")
    # Distances of the tree are taken between single-precision centroids.
    single = centres.select("cluster", as_float(F.col("centroid")).alias("centroid"))
    merges, lines = H.tree_document(H.ward_linkage(single), centres)
    assigned = materialise(S.attach_labels(texts, labels), "assigned")
    found = S.aggregates(assigned, centres, config.n_samples)
    result = Result(labels, assigned, found, merges, lines, S.run_metrics(labels))
    return _export(result, "coseno", output, config.documents)


def run(df: DataFrame, keys: list[str], config: Config = Config(), output: str | None = None, text: str = "comentario") -> dict[str, Result]:
    """Load once, then the chosen method or both."""
    if config.method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    texts = materialise(load_and_clean(df, keys, text), "texts")
    folder = lambda name: None if output is None else f"{output}/checkpoints_{name}"
    results = {}
    if config.method in ("coseno", "ambos"):
        results["coseno"] = run_coseno(texts, config, output, folder("coseno"))
    if config.method in ("jaccard", "ambos"):
        results["jaccard"] = run_jaccard(texts, config, output, folder("jaccard"))
    return results


def run_csv(
    spark, path: str, output: str, config: Config = Config(), column: str = "comentario", multi_line: bool = True
) -> dict[str, Result]:
    """``multi_line`` False lets Spark split a large file whose texts hold no line breaks."""
    return run(files.read_csv_texts(spark, path, column, multi_line), files.POSITION, config, output)
