"""Registered queries: each runs an operator over whole driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gavilla.functions import text as T, vectors as V
from gavilla.operators import components as C, density as D, encode as E, hierarchy as H, keys as K, minhash as M
from gavilla.operators import neighbours as N, prepare as P, summary as S, tfidf as TF
from gavilla.operators.descent import descent_topk
from gavilla.operators.merge_tree import merge_tree
from gavilla.plans import pipelines as R
from gavilla.session import materialise, scratch_root
from gavilla.sources import files as FI
from gavilla.sources.stages import saved_cells, stage

# Bands and rows that separate the long documents; conversations use the threshold's own choice.
DOC_BANDS, DOC_ROWS = 16, 8
SHORT_BANDS, SHORT_ROWS = 37, 3
NUM_PERM = 128


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("comentario"))


def cleaned(spark, sf) -> DataFrame:
    return P.clean_texts(documents(spark, sf))


def spread_texts(spark, sf) -> DataFrame:
    """Cleaned documents rebalanced for work that is heavy per text."""
    return P.clean_texts(K.spread(documents(spark, sf)))


def turns(spark, sf) -> DataFrame:
    """Short texts keyed by (conv_id, turn)."""
    return table(spark, sf, "conversations")


def short_texts(spark, sf) -> DataFrame:
    return P.load_and_clean(turns(spark, sf), ["conv_id", "turn"], "text")


def joined(col) -> F.Column:
    return F.array_join(col, ",")


# -- text ---------------------------------------------------------------------------------------


def clean_text(spark, sf):
    return cleaned(spark, sf).select("id", "comentario_clean")


def mixed_rows(spark, sf):
    """All documents, and beside them bad rows with negative ids: numbers, blanks and nulls in turn."""
    rows = documents(spark, sf)
    third = F.col("id") % 3
    bad = F.when(third == 0, F.col("id").cast("string")).when(third == 1, F.lit(" "))
    return rows.unionByName(rows.select((-1 - F.col("id")).alias("id"), bad.alias("comentario")))


def valid_filter(spark, sf):
    return P.drop_invalid(P.clean_texts(mixed_rows(spark, sf))).select("id", "comentario_clean")


def load_metrics(spark, sf):
    return P.load_metrics(mixed_rows(spark, sf))


def dense_id(spark, sf):
    rows = mixed_rows(spark, sf).withColumnRenamed("id", "doc_id")
    valid = P.drop_invalid(P.clean_texts(rows)).select("doc_id")
    return K.number_rows(valid, ["doc_id"]).select("doc_id", "id")


def load_and_clean(spark, sf):
    return short_texts(spark, sf)


def char_ngrams(spark, sf):
    grams = T.gram_set(T.clean(F.col("text")))
    turns = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(grams).alias("gram"))
    return turns


def ngram_counts(spark, sf):
    return spread_texts(spark, sf).select("id", F.size(T.gram_set(F.col("comentario_clean"))).cast("bigint").alias("n_grams"))


def short_text_grams(spark, sf):
    """Two-letter codes have no 3-grams and fall back to their characters."""
    codes = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), T.clean(F.col("lang")).alias("c"))
    return codes.select("id", F.explode(T.gram_set(F.col("c"))).alias("gram"))


def gram_hash(spark, sf):
    hashes = F.transform(T.gram_set(F.col("comentario_clean")), T.gram_hash)
    return spread_texts(spark, sf).select(
        "id", F.aggregate(hashes, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("hash_sum")
    )


# -- signatures and candidates -------------------------------------------------------------------


def doc_signatures(spark, sf, num_perm=NUM_PERM):
    return M.signatures(cleaned(spark, sf), num_perm)


def doc_entries(spark, sf):
    return M.buckets(doc_signatures(spark, sf), DOC_BANDS, DOC_ROWS)


def minhash_signature(spark, sf):
    return doc_signatures(spark, sf).select("id", joined("sig").alias("sig"))


def lsh_buckets(spark, sf):
    return doc_entries(spark, sf)


def lsh_star_edges(spark, sf):
    return M.star_edges(doc_entries(spark, sf))


def lsh_collisions(spark, sf):
    return M.bucket_collisions(doc_entries(spark, sf))


def lsh_query(spark, sf):
    """Benchmark passages looked up in the index of the documents."""
    probes = table(spark, sf, "benchmark").select(
        F.col("item_id").alias("id"), T.clean(F.col("text")).alias("comentario_clean")
    )
    asked = M.buckets(M.signatures(probes), SHORT_BANDS, SHORT_ROWS)
    indexed = M.buckets(doc_signatures(spark, sf), SHORT_BANDS, SHORT_ROWS)
    return M.query_candidates(asked, indexed)


def jaccard_estimate(spark, sf):
    """Estimate along each star edge."""
    sigs = materialise(doc_signatures(spark, sf), "signatures")
    edges = M.star_edges(M.buckets(sigs, DOC_BANDS, DOC_ROWS))
    pairs = materialise(edges.join(sigs.withColumnRenamed("sig", "sig_a"), "id"), "pairs")
    # One hub may stand for a large part of all rows.
    hubs = pairs.groupBy("hub").agg(F.count("*").alias("n"))
    hubs = materialise(hubs.join(sigs.select(F.col("id").alias("hub"), F.col("sig").alias("sig_b")), "hub"), "hubs")
    both = K.attach(pairs, hubs, ["hub"], pairs.count())
    return both.select("id", "hub", F.round(M.estimated_jaccard(F.col("sig_a"), F.col("sig_b")), 6).alias("jaccard"))


# -- components and cluster summaries ------------------------------------------------------------


def literal_labels(texts, bands, rows):
    """(id, cluster) of (id, comentario_clean) by shared buckets."""
    edges = M.star_edges(M.buckets(M.signatures(texts, NUM_PERM), bands, rows))
    return C.label_components(texts, C.connected_components(edges))


def doc_labels(spark, sf):
    return literal_labels(cleaned(spark, sf), DOC_BANDS, DOC_ROWS)


def components(spark, sf):
    return C.connected_components(M.star_edges(doc_entries(spark, sf)))


def component_labels(spark, sf):
    return doc_labels(spark, sf)


def short_text_labels(spark, sf):
    return literal_labels(short_texts(spark, sf), SHORT_BANDS, SHORT_ROWS)


def assignments(spark, sf):
    texts = short_texts(spark, sf)
    return S.attach_labels(texts, literal_labels(texts, SHORT_BANDS, SHORT_ROWS))


def cluster_sizes(spark, sf):
    return S.cluster_sizes(doc_labels(spark, sf))


def cluster_samples(spark, sf):
    assigned = materialise(assignments(spark, sf), "assigned")
    return S.cluster_samples(assigned).select("cluster", F.array_join("sample_comments", " | ").alias("samples"))


def cluster_aggregates(spark, sf):
    """The flagship: near-duplicate documents grouped, counted and sampled."""
    raw = documents(spark, sf).withColumnRenamed("id", "doc_id")
    texts = P.load_and_clean(raw, ["doc_id"])
    assigned = S.attach_labels(texts, literal_labels(texts, DOC_BANDS, DOC_ROWS))
    found = S.aggregates(materialise(assigned, "assigned"))
    return found.select("cluster", "size", F.array_join("sample_comments", " | ").alias("samples"))


def top_clusters(spark, sf):
    return S.largest_clusters(doc_labels(spark, sf), 20)


def distinct_labels(spark, sf):
    return S.distinct_labels(doc_labels(spark, sf))


def clustered_texts(spark, sf):
    """Ids in a cluster, noise removed."""
    return S.drop_noise(doc_labels(spark, sf))


def representatives(spark, sf):
    sigs = materialise(doc_signatures(spark, sf), "signatures")
    edges = M.star_edges(M.buckets(sigs, DOC_BANDS, DOC_ROWS))
    labels = C.label_components(sigs, C.connected_components(edges))
    return S.representatives(sigs, labels).select("cluster", "id", joined("sig").alias("sig"))


def run_metrics(spark, sf):
    return S.run_metrics(doc_labels(spark, sf))


# -- vectors -------------------------------------------------------------------------------------


def vectors(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def vector_labels(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("cluster"))


def l2_normalise(spark, sf):
    stretched = F.transform("vec", lambda x: x.cast("double") * (F.col("id") % 7))
    unit = vectors(spark, sf).select("id", V.unit(stretched).alias("vec"))
    return unit.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round("x", 6).alias("x"))


def precision_cast(spark, sf):
    third = F.transform("vec", lambda x: x.cast("double") / 3)
    single = vectors(spark, sf).select("id", V.as_float(third).alias("vec"))
    return single.select("id", F.posexplode("vec").alias("pos", "x")).select(
        "id", "pos", F.round(F.col("x").cast("double"), 9).alias("x")
    )


def centroids(spark, sf):
    found = S.centroids(vectors(spark, sf), vector_labels(spark, sf))
    return found.select("cluster", F.posexplode("centroid").alias("pos", "x")).select(
        "cluster", "pos", F.round("x", 6).alias("x")
    )


def labelled_vectors(spark, sf) -> DataFrame:
    """Vectors with ten dense regions: unit(one_hot(label) + 0.3 * embedding)."""
    rows = table(spark, sf, "embeddings")
    shifted = F.transform(
        "embedding", lambda x, i: F.lit(0.3) * x.cast("double") + F.when(i == F.col("label"), F.lit(1.0)).otherwise(F.lit(0.0))
    )
    return rows.select(F.col("vec_id").alias("id"), V.unit(shifted).alias("vec"))


def cosine_topk(spark, sf):
    return N.cosine_topk(vectors(spark, sf), 30).select("id", "rank", "nbr_id", F.round("sim", 6).alias("sim"))


def truth(spark, sf) -> DataFrame:
    return materialise(N.cosine_topk(vectors(spark, sf), 30), "truth")


def ivf_recall(spark, sf):
    """Share of the true neighbours found in three of four cells; the vectors have no structure that would help."""
    points = vectors(spark, sf)
    cells = N.default_cells(points.count())
    return N.recall(N.ivf_topk(points, 30, nlist=cells, nprobe=-(-3 * cells // 4)), truth(spark, sf))


def descent_recall(spark, sf):
    """Share of the true neighbours that descent finds."""
    return N.recall(descent_topk(vectors(spark, sf), 30), truth(spark, sf))


def ivf_topk(spark, sf):
    """Every cell probed, which is the exact answer."""
    found = N.ivf_topk(vectors(spark, sf), 30, nprobe=N.MAX_CELLS)
    return found.select("id", "rank", "nbr_id", F.round("sim", 6).alias("sim"))


def saved_index_topk(spark, sf):
    """Cells written, loaded again and probed in full."""
    points = vectors(spark, sf)
    folder = f"{scratch_root(spark)}/gavilla/index-{uuid.uuid4().hex}"
    saved_cells(points, folder, 16)
    found = N.ivf_search(points, saved_cells(points, folder, 16), 30, 16)
    return found.select("id", F.col("rank").cast("int").alias("rank"), "nbr_id", F.round(-F.col("cost"), 6).alias("sim"))


def hyperplane_recall(spark, sf):
    """Share of the true neighbours that share the signs of one of 24 bands of three projections."""
    return N.recall(N.hyperplane_topk(vectors(spark, sf), 30, bands=24, bits=3), truth(spark, sf))


def knn_and_core(spark, sf):
    knn = materialise(D.vector_knn(materialise(vectors(spark, sf), "points"), 10), "knn")
    return knn, D.core_distances(knn)


def core_distance(spark, sf):
    _, core = knn_and_core(spark, sf)
    return core.select("id", F.round("core", 6).alias("core"))


def mutual_reachability(spark, sf):
    knn, core = knn_and_core(spark, sf)
    return D.mutual_reachability(knn, core).select("a", "b", F.round("weight", 6).alias("weight"))


def spanning_tree(spark, sf):
    leaves, tree, copies = D.density_graph(labelled_vectors(spark, sf), 10)
    return D.full_tree(leaves, tree, copies).withColumn("weight", F.round("weight", 6))


def single_linkage(spark, sf):
    leaves, tree, _ = D.density_graph(labelled_vectors(spark, sf), 10)
    return D.single_linkage(tree, leaves.select("id", "copies")).withColumn("dist", F.round("dist", 6))


def condensed_clusters(spark, sf):
    leaves, tree, _ = D.density_graph(labelled_vectors(spark, sf), 10)
    clusters, _ = D.condensed_tree(*merge_tree(tree, leaves.select("id", "copies")), leaves)
    found = clusters.join(D.choose_clusters(clusters), "cluster")
    return found.withColumns({c: F.round(c, 6) for c in ("birth", "stability")})


def density_clusters(spark, sf):
    return D.density_clusters(labelled_vectors(spark, sf), k=10)


def ward_tree(spark, sf):
    """Ward tree over the means of the labels."""
    centres = materialise(S.centroids(labelled_vectors(spark, sf), vector_labels(spark, sf)), "centres")
    return H.tree_document(H.ward_linkage(centres), centres)[0].withColumn("distance", F.round("distance", 6))


def turn_heads(spark, sf) -> DataFrame:
    """Representatives of the short-text clusters."""
    sigs = materialise(M.signatures(short_texts(spark, sf), NUM_PERM), "signatures")
    edges = M.star_edges(M.buckets(sigs, SHORT_BANDS, SHORT_ROWS))
    labels = materialise(C.label_components(sigs, C.connected_components(edges)), "labels")
    return materialise(S.representatives(sigs, labels), "heads")


def representative_distances(spark, sf):
    found = H.representative_distances(turn_heads(spark, sf))
    return found.select("a", "b", F.round("dist", 6).alias("dist"))


def average_tree(spark, sf):
    heads = turn_heads(spark, sf)
    found = H.tree_document(H.average_linkage(H.representative_distances(heads), heads), heads)[0]
    return found.withColumn("distance", F.round("distance", 6))


def tree_json(spark, sf):
    """Lines of the nested document."""
    heads = turn_heads(spark, sf)
    merges = H.average_linkage(H.representative_distances(heads), heads)
    return H.tree_document(merges.withColumn("distance", F.round("distance", 6)), heads)[1]


# -- terms and encoders --------------------------------------------------------------------------


def term_counts(spark, sf):
    return TF.term_counts(short_texts(spark, sf))


def vocabulary(spark, sf):
    # Counts are read once only, so they are added up as they are made.
    return TF.vocabulary(TF.term_counts(cleaned(spark, sf)))


def tfidf_weights(spark, sf):
    rows, terms = TF.tfidf_rows(short_texts(spark, sf))
    return TF.tfidf_cells(rows, terms).select("id", "term", F.round("weight", 6).alias("weight"))


def svd_vectors(spark, sf):
    found = TF.tfidf_vectors(short_texts(spark, sf))
    return found.select("id", joined(F.transform("vec", lambda x: x.cast("string"))).alias("vec"))


def letter_encoder():
    """A stand-in model: counts of the letters a to z in whole texts."""
    import numpy as np

    letters = [chr(97 + i) for i in range(26)]
    return lambda texts: np.array([[str(text).count(letter) for letter in letters] for text in texts])


def encoded_vectors(spark, sf):
    found = E.encode(cleaned(spark, sf), letter_encoder)
    return found.select("id", F.posexplode("vec").alias("pos", "x")).select("id", "pos", F.round(F.col("x").cast("double"), 5).alias("x"))


# -- files, stages and whole runs ----------------------------------------------------------------


def csv_scan(spark, sf):
    """Documents written as CSV and read back by header name."""
    folder = f"{scratch_root(spark)}/gavilla/csv-{uuid.uuid4().hex}"
    source = documents(spark, sf).select("id", "comentario", F.lit("x").alias("other"))
    source.write.options(header=True, quote='"', escape='"', quoteAll=True).csv(folder)
    return FI.read_csv_texts(spark, folder).select("comentario")


def assignment_file(spark, sf):
    """Assignments written as JSON lines and read back."""
    folder = f"{scratch_root(spark)}/gavilla/json-{uuid.uuid4().hex}"
    FI.write_assignments(assignments(spark, sf), folder)
    return spark.read.schema("id bigint, comentario string, cluster int").json(folder)


def aggregate_file(spark, sf):
    """Cluster aggregates written as JSON lines and read back."""
    folder = f"{scratch_root(spark)}/gavilla/json-{uuid.uuid4().hex}"
    FI.write_aggregates(S.aggregates(materialise(assignments(spark, sf), "assigned")), folder)
    found = spark.read.schema("cluster int, size bigint, sample_comments array<string>").json(folder)
    return found.select("cluster", "size", F.array_join("sample_comments", " | ").alias("samples"))


def csv_load(spark, sf):
    """Documents written as CSV files in the order of their ids, read by header name, cleaned and numbered."""
    folder = f"{scratch_root(spark)}/gavilla/csv-{uuid.uuid4().hex}"
    source = documents(spark, sf).select("id", "comentario", F.lit("x").alias("other"))
    source.repartitionByRange("id").sortWithinPartitions("id").write.options(header=True, quote='"', escape='"', quoteAll=True).csv(folder)
    return P.load_and_clean(FI.read_csv_texts(spark, folder), FI.POSITION)


def saved_stage(spark, sf):
    """Cleaned texts made once and then taken from the saved stage."""
    folder = f"{scratch_root(spark)}/gavilla/stage-{uuid.uuid4().hex}"
    source = documents(spark, sf)
    make = lambda: P.clean_texts(source).select("id", "comentario_clean")
    stage(spark, folder, {"step": "clean"}, source, make)
    return stage(spark, folder, {"step": "clean"}, source, make)


def literal_run(spark, sf):
    """The whole literal method at its defaults; its clusters."""
    texts = materialise(short_texts(spark, sf), "texts")
    found = R.run_jaccard(texts).aggregates
    return found.select("cluster", "size", F.array_join("sample_comments", " | ").alias("samples"))


def semantic_run(spark, sf):
    """The whole semantic method on all turns; its clusters."""
    texts = materialise(short_texts(spark, sf), "texts")
    found = R.run_coseno(texts, R.Config(min_cluster_size=5)).aggregates
    return found.select("cluster", "size", F.array_join("sample_comments", " | ").alias("samples"))


QUERIES = [
    clean_text, valid_filter, load_metrics, dense_id, load_and_clean, char_ngrams, ngram_counts, short_text_grams,
    gram_hash, minhash_signature, lsh_buckets, lsh_star_edges, lsh_collisions, lsh_query, jaccard_estimate,
    components, component_labels, short_text_labels, assignments, cluster_sizes, cluster_samples,
    cluster_aggregates, top_clusters, distinct_labels, clustered_texts, representatives, run_metrics,
    l2_normalise, precision_cast, centroids, cosine_topk, ivf_topk, ivf_recall, saved_index_topk,
    hyperplane_recall, descent_recall, core_distance, mutual_reachability, spanning_tree, single_linkage, condensed_clusters,
    density_clusters, ward_tree, representative_distances, average_tree, tree_json, term_counts, vocabulary,
    tfidf_weights, svd_vectors, encoded_vectors, csv_scan, csv_load, assignment_file, aggregate_file,
    saved_stage, literal_run, semantic_run,
]


def queries():
    return {query.__name__: query for query in QUERIES}
