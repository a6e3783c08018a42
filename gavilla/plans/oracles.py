"""SQL that gives the registered queries' results from the same tables."""

from __future__ import annotations

from gavilla.functions.text import PRIME
from gavilla.operators.minhash import coefficients

# Written out here, so that a slip in the engine shows.
DOC_BANDS, DOC_ROWS, SHORT_BANDS, SHORT_ROWS, NUM_PERM = 16, 8, 37, 3, 128


def clean(col: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({col}, '')), '\s+', ' ', 'g'))"


DOCS = f"docs AS (SELECT doc_id AS id, text AS comentario, {clean('text')} AS c FROM documents)"
MIXED = f"""raw AS (SELECT doc_id, text AS comentario FROM documents UNION ALL
    SELECT -1 - doc_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS VARCHAR) WHEN doc_id % 3 = 1 THEN ' ' END FROM documents),
  mixed AS (SELECT doc_id, {clean('comentario')} AS c FROM raw)"""
VALID = r"length(c) >= 2 AND NOT regexp_full_match(c, '\d+')"
TURNS = f"""turns AS (SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS id, comentario, c FROM (
    SELECT conv_id, turn, text AS comentario, {clean('text')} AS c FROM conversations)
    WHERE {VALID})"""


def grams(source: str, ids: str = "id", prefix: str = "") -> str:
    """(ids, gram) of distinct 3-5 grams, or characters of shorter texts, from ``source`` (ids, c)."""
    after = [f"lead(ch, {k}) OVER (PARTITION BY {ids} ORDER BY pos)" for k in range(1, 5)]
    parts = " UNION ".join(
        f"SELECT {ids}, concat(ch, {', '.join(f'n{k}' for k in range(1, n))}) AS gram FROM {prefix}ahead WHERE n{n - 1} IS NOT NULL"
        for n in (3, 4, 5)
    )
    return f"""{prefix}chars AS (SELECT {ids}, length(c) AS len, unnest(string_split(c, '')) AS ch,
    unnest(range(length(c))) AS pos FROM {source}),
  {prefix}ahead AS (SELECT {ids}, len, ch, {', '.join(f'{a} AS n{k + 1}' for k, a in enumerate(after))} FROM {prefix}chars),
  {prefix}grams AS ({parts} UNION SELECT {ids}, ch FROM {prefix}ahead WHERE len < 3)"""


GRAM_HASH = f"CAST(concat('0x', substr(sha1(gram), 1, 8)) AS BIGINT) % {PRIME}"


def signatures(source: str, name: str = "sigs", prefix: str = "") -> str:
    """(id, sig list) of ``source`` (id, c)."""
    lows = ", ".join(f"min((h * {a} + {b}) % {PRIME})" for a, b in coefficients(NUM_PERM))
    return f"""{grams(source, prefix=prefix)},
  {prefix}hashed AS (SELECT id, {GRAM_HASH} AS h FROM {prefix}grams),
  {name} AS (SELECT id, [{lows}] AS sig FROM {prefix}hashed GROUP BY id)"""


def entries(bands: int, rows: int, sigs: str = "sigs", name: str = "entries") -> str:
    return f"""{name} AS (SELECT CAST(band AS INTEGER) AS band,
    array_to_string(sig[band * {rows} + 1:band * {rows} + {rows}], ',') AS bucket, id
    FROM {sigs}, range({bands}) AS b(band))"""


STARS = """hubs AS (SELECT band, bucket, min(id) AS hub FROM entries GROUP BY band, bucket),
  stars AS (SELECT DISTINCT id, hub FROM entries JOIN hubs USING (band, bucket) WHERE id <> hub)"""
ROOTS = """sides AS (SELECT id AS a, hub AS b FROM stars UNION SELECT hub, id FROM stars),
  reach(id, r) AS (SELECT a, a FROM sides UNION SELECT reach.id, sides.b FROM reach JOIN sides ON sides.a = reach.r),
  roots AS (SELECT id, min(r) AS root FROM reach GROUP BY id)"""


def labels(source: str, bands: int, rows: int) -> str:
    return f"""{signatures(source)}, {entries(bands, rows)}, {STARS}, {ROOTS},
  ranked AS (SELECT root, row_number() OVER (ORDER BY root) - 1 AS cluster FROM (SELECT DISTINCT root FROM roots)),
  labels AS (SELECT s.id, CAST(coalesce(cluster, -1) AS INTEGER) AS cluster FROM {source} s
    LEFT JOIN roots USING (id) LEFT JOIN ranked USING (root))"""


DOC_LABELS = f"WITH RECURSIVE {DOCS}, {labels('docs', DOC_BANDS, DOC_ROWS)}"
TURN_LABELS = f"WITH RECURSIVE {TURNS}, {labels('turns', SHORT_BANDS, SHORT_ROWS)}"
SAMPLED = """assigned AS (SELECT id, comentario, cluster FROM {0} JOIN labels USING (id)),
  firsts AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY id) AS rank FROM assigned),
  sampled AS (SELECT cluster, string_agg(comentario, ' | ' ORDER BY id) AS samples FROM firsts
    WHERE rank <= 10 GROUP BY cluster)"""
DOC_ENTRIES = f"WITH {DOCS}, {signatures('docs')}, {entries(DOC_BANDS, DOC_ROWS)}"

SIMS = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
  sims AS (SELECT a.id, b.id AS nbr_id, list_dot_product(a.vec, b.vec) AS sim, list_distance(a.vec, b.vec) AS dist
    FROM v a JOIN v b ON a.id <> b.id)"""
TOPK = f"""WITH {SIMS}, ranked AS (SELECT id, nbr_id, sim, row_number() OVER (PARTITION BY id ORDER BY sim DESC, nbr_id) AS rank FROM sims)
  SELECT id, CAST(rank AS INTEGER) AS rank, nbr_id, round(sim, 6) AS sim FROM ranked WHERE rank <= 30"""
CORE = f"""{SIMS}, knn AS (SELECT * FROM (SELECT id, nbr_id, dist, row_number() OVER (PARTITION BY id ORDER BY dist, nbr_id) AS rank FROM sims)
    WHERE rank <= 10), core AS (SELECT id, max(dist) AS core FROM knn WHERE rank <= 5 GROUP BY id)"""


# Prim's algorithm over the whole matrix: one point joins per step. Its ways are [weight, from], by place in ``p``.
SHIFTED = """p AS MATERIALIZED (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS i, list_transform(raw, lambda x: x / sqrt(list_sum(list_transform(raw, lambda y: y * y)))) AS vec
    FROM (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x, j: 0.3 * x + CASE WHEN j = label + 1 THEN 1.0 ELSE 0.0 END) AS raw FROM embeddings)),
  apart AS (SELECT a.i, b.i AS j, a.id AS id_a, b.id AS id_b, list_distance(a.vec, b.vec) AS dist FROM p a JOIN p b ON a.i <> b.i),
  cores AS (SELECT i, max(dist) AS core FROM (SELECT i, dist, row_number() OVER (PARTITION BY i ORDER BY dist, id_b) AS rank FROM apart) WHERE rank <= 5 GROUP BY i),
  reach AS MATERIALIZED (SELECT i, list({'w': w, 'a': a, 'b': b, 'j': j} ORDER BY j) AS ways FROM (
    SELECT x.i, x.j, round(greatest(dist, c.core, d.core), 12) AS w, least(id_a, id_b) AS a, greatest(id_a, id_b) AS b
    FROM apart x JOIN cores c ON c.i = x.i JOIN cores d ON d.i = x.j) GROUP BY i)"""
TREE = f"""{SHIFTED},
  grow(step, ways, edge) AS (
    SELECT 1, ways, {{'w': CAST(NULL AS DOUBLE), 'a': CAST(NULL AS BIGINT), 'b': CAST(NULL AS BIGINT), 'j': CAST(NULL AS BIGINT)}} FROM reach WHERE i = 1
    UNION ALL
    SELECT step + 1, list_transform(list_filter(list_zip(open, fresh), lambda z: z[1].j <> edge.j), lambda z: least(z[1], z[2])), edge
    FROM (SELECT step, edge, open, list_filter(r.ways, lambda y: list_contains(js, y.j) OR y.j = edge.j) AS others, r.ways AS way_rows, js,
        list_transform(open, lambda o: CASE WHEN o.j = edge.j THEN o ELSE r.ways[CASE WHEN o.j < edge.j THEN o.j ELSE o.j - 1 END] END) AS fresh
      FROM (SELECT step, ways AS open, list_min(ways) AS edge, list_transform(ways, lambda o: o.j) AS js FROM grow WHERE len(ways) > 0) g JOIN reach r ON r.i = g.edge.j)),
  mst AS MATERIALIZED (SELECT edge.a AS a, edge.b AS b, edge.w AS weight, row_number() OVER (ORDER BY edge.w, edge.a, edge.b) AS rank FROM grow WHERE step > 1)"""
# Edges merge in order; tops[i] is the node that point i has come to.
LINKED = f"""{TREE},
  merge(rank, tops, node, "left", "right", dist, size) AS (
    SELECT CAST(0 AS BIGINT), (SELECT list(id ORDER BY i) FROM p), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS DOUBLE), CAST(NULL AS BIGINT)
    UNION ALL
    SELECT rank, list_transform(tops, lambda t: CASE WHEN t = x OR t = y THEN -rank ELSE t END), -rank, least(x, y), greatest(x, y), weight,
      len(list_filter(tops, lambda t: t = x OR t = y))
    FROM (SELECT m.rank, tops, weight, tops[pa.i] AS x, tops[pb.i] AS y FROM merge JOIN mst m ON m.rank = merge.rank + 1 JOIN p pa ON pa.id = m.a JOIN p pb ON pb.id = m.b)),
  merges AS MATERIALIZED (SELECT node, "left", "right", dist, size FROM merge WHERE rank > 0)"""
# Down from the root: the cluster that a node belongs to and, of parts below the least size, where they fell out.
CONDENSED = f"""{LINKED},
  size_of AS (SELECT node AS x, size FROM merges UNION ALL SELECT id, 1 FROM p),
  down AS MATERIALIZED (SELECT c AS x, node AS up, 1 / greatest(dist, 1e-10) AS density FROM (SELECT node, dist, unnest(["left", "right"]) AS c FROM merges)),
  side AS MATERIALIZED (SELECT x, up, density, size, size >= 20 AS big, sum(CASE WHEN size >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY up) AS bigs FROM down JOIN size_of USING (x)),
  walk(x, cluster, parent, birth, size, big, fell) AS (
    SELECT node, node, CAST(NULL AS BIGINT), CAST(0 AS DOUBLE), size, true, CAST(NULL AS DOUBLE) FROM merges WHERE node NOT IN (SELECT x FROM down) AND size >= 20
    UNION ALL
    SELECT s.x, CASE WHEN s.big AND bigs = 2 THEN s.x ELSE w.cluster END, CASE WHEN s.big AND bigs = 2 THEN w.cluster ELSE w.parent END,
      CASE WHEN s.big AND bigs = 2 THEN s.density ELSE w.birth END, s.size, s.big, CASE WHEN NOT s.big THEN s.density END
    FROM side s JOIN walk w ON w.x = s.up AND w.big),
  heads AS MATERIALIZED (SELECT cluster, parent, birth, size FROM walk WHERE x = cluster),
  gains AS (SELECT cluster, sum(mass) AS mass, sum(points) AS points FROM (
    SELECT cluster, fell * size AS mass, size AS points FROM walk WHERE NOT big UNION ALL
    SELECT parent, birth * size, size FROM heads WHERE parent IS NOT NULL) GROUP BY cluster),
  clusters AS MATERIALIZED (SELECT h.*, mass - birth * points AS stability, row_number() OVER (ORDER BY h.cluster DESC) AS turn FROM heads h JOIN gains USING (cluster)),
  -- Clusters from the lightest merge on, so that those inside one come before it; best holds their totals.
  total(turn, best, kept, cluster) AS (
    SELECT CAST(0 AS BIGINT), MAP([CAST(0 AS BIGINT)], [CAST(0 AS DOUBLE)]), false, CAST(NULL AS BIGINT)
    UNION ALL
    SELECT turn, map_concat(best, MAP([cluster], [greatest(stability, below)])), parent IS NOT NULL AND (stability >= below OR NOT kids), cluster
    FROM (SELECT c.turn, best, c.cluster, parent, stability, kids IS NOT NULL AS kids,
        coalesce(list_sum(list_transform(kids, lambda k: best[k])), 0) AS below
      FROM total t JOIN clusters c ON c.turn = t.turn + 1 LEFT JOIN (SELECT parent AS p, list(cluster) AS kids FROM clusters GROUP BY parent) k ON k.p = c.cluster)),
  picked(cluster, chosen) AS (
    SELECT cluster, CASE WHEN kept THEN cluster END FROM clusters JOIN total USING (cluster) WHERE parent IS NULL
    UNION ALL
    SELECT c.cluster, coalesce(p.chosen, CASE WHEN t.kept THEN c.cluster END) FROM clusters c JOIN picked p ON c.parent = p.cluster JOIN total t ON t.cluster = c.cluster)"""


def linkage(leaves: str, pairs: str, dist: str, rest: bool) -> str:
    """tree (node_id, left_id, right_id, distance, size) over ``leaves`` (leaf) from ``pairs`` (a, b, value).

    Rounds that merge every pair of clusters that are each other's nearest; a cluster is named by its smallest leaf. ``dist``
    is the distance by ``total`` (of the values between), sizes ``na``, ``nb`` and values within, ``wa``, ``wb``. With ``rest``,
    what no pair links is joined at distance 1 in the order of the names.
    """
    links = f"""SELECT *, {dist} AS d FROM (
      SELECT x.round, least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, sum(value) AS total FROM w x JOIN pair ON pair.a = x.leaf JOIN w y ON y.leaf = pair.b
        AND y.round = x.round WHERE x.c <> y.c GROUP BY ALL)
      JOIN (SELECT round, c AS a, count(*) AS na FROM w GROUP BY ALL) USING (round, a) JOIN (SELECT round, c AS b, count(*) AS nb FROM w GROUP BY ALL) USING (round, b)
      LEFT JOIN (SELECT x.round, x.c AS a, sum(value) AS wa FROM w x JOIN pair ON pair.a = x.leaf JOIN w y ON y.leaf = pair.b AND y.round = x.round AND y.c = x.c GROUP BY ALL) USING (round, a)
      LEFT JOIN (SELECT x.round, x.c AS b, sum(value) AS wb FROM w x JOIN pair ON pair.a = x.leaf JOIN w y ON y.leaf = pair.b AND y.round = x.round AND y.c = x.c GROUP BY ALL) USING (round, b)"""
    mutual = """SELECT round, a, b, d, na + nb AS size FROM (
        SELECT *, row_number() OVER (PARTITION BY round, a, b) AS copy, count(*) OVER (PARTITION BY round, a, b) AS n FROM (
          SELECT *, row_number() OVER (PARTITION BY round, c ORDER BY round(d, 12), a, b) AS near FROM (
            SELECT *, unnest([a, b]) AS c FROM ({links}))) WHERE near = 1) WHERE n = 2 AND copy = 1"""
    tops = f"""tops AS (SELECT c, count(*) AS size, row_number() OVER (ORDER BY c) - 1 AS i FROM w WHERE round = (SELECT max(round) FROM w) GROUP BY c),
  joined AS (SELECT round, a, b, d, size FROM merged UNION ALL
    SELECT (SELECT max(round) FROM w) + i - 1, (SELECT min(c) FROM tops), c, 1.0, CAST(sum(size) OVER (ORDER BY c) AS BIGINT) FROM tops QUALIFY i > 0)""" if rest else "joined AS (SELECT round, a, b, d, size FROM merged)"
    return f"""pair AS MATERIALIZED ({pairs}),
  w(round, leaf, c) AS (
    SELECT 0, leaf, leaf FROM ({leaves}) UNION ALL
    SELECT w.round + 1, leaf, coalesce(m.a, c) FROM w LEFT JOIN ({mutual.format(links=links)}) m ON m.b = w.c WHERE EXISTS (FROM ({mutual.format(links=links)}))),
  merged AS MATERIALIZED ({mutual.format(links=links)}),
  {tops},
  numbered AS (SELECT *, row_number() OVER (ORDER BY d, round, a) - 1 + (SELECT count(*) FROM ({leaves})) AS node_id FROM joined),
  ids AS (SELECT leaf AS c, -1 AS round, row_number() OVER (ORDER BY leaf) - 1 AS id FROM ({leaves}) UNION ALL SELECT a, round, node_id FROM numbered),
  halves AS (SELECT node_id, d, size, n.round, unnest([a, b]) AS c FROM numbered n),
  tree AS MATERIALIZED (SELECT node_id, min(id) AS left_id, max(id) AS right_id, round(any_value(d), 6) AS distance, any_value(size) AS size FROM (
    SELECT s.node_id, s.d, s.size, arg_max(i.id, i.round) AS id FROM halves s JOIN ids i ON i.c = s.c AND i.round < s.round GROUP BY s.node_id, s.c, s.d, s.size) GROUP BY node_id)"""


HEADS = f"""{TURN_LABELS}, heads AS (SELECT cluster, min(id) AS id FROM labels WHERE cluster <> -1 GROUP BY cluster),
  reps AS MATERIALIZED (SELECT cluster, sig FROM heads JOIN sigs USING (id))"""
ALIKE = f"""SELECT x.cluster AS a, y.cluster AS b, list_sum(list_transform(range(1, {NUM_PERM + 1}), lambda i: CASE WHEN x.sig[i] = y.sig[i] THEN 1 ELSE 0 END)) / {NUM_PERM}.0 AS value
      FROM reps x JOIN reps y ON x.cluster < y.cluster WHERE value > 0"""
AVERAGE = f"{HEADS}, {linkage('SELECT cluster AS leaf FROM reps', ALIKE, '1 - total / (na * nb)', True)}"
WARD = f"""WITH RECURSIVE {SHIFTED}, cell AS (SELECT label AS leaf, CAST(unnest(range(len(vec))) AS INTEGER) AS pos, unnest(vec) AS x FROM p JOIN embeddings ON vec_id = id),
  centre AS MATERIALIZED (SELECT leaf, list(x ORDER BY pos) AS vec FROM (SELECT leaf, pos, avg(x) AS x FROM cell GROUP BY ALL) GROUP BY leaf),
  {linkage("SELECT leaf FROM centre", "SELECT x.leaf AS a, y.leaf AS b, list_distance(x.vec, y.vec) ^ 2 AS value FROM centre x JOIN centre y ON x.leaf < y.leaf",
           "sqrt(2 * na * nb / (na + nb) * greatest(total / (na * nb) - coalesce(wa, 0) / (na * na) - coalesce(wb, 0) / (nb * nb), 0))", False)}"""  # fmt: skip
# A subtree of L leaves takes 10 L - 6 lines.
LINES = f"""{AVERAGE}, names AS (SELECT cluster, row_number() OVER (ORDER BY cluster) - 1 AS id FROM reps),
  sizes AS (SELECT node_id AS id, size FROM tree UNION ALL SELECT id, 1 FROM names),
  spot(id, line_no, depth, side) AS (
    SELECT max(node_id), CAST(0 AS BIGINT), 0, '' FROM tree UNION ALL
    SELECT CASE k WHEN 0 THEN left_id ELSE right_id END, line_no + 3 + CASE k WHEN 0 THEN 0 ELSE 10 * z.size - 6 END, depth + 1, CASE k WHEN 0 THEN ',' ELSE '' END
    FROM spot JOIN tree ON node_id = id JOIN sizes z ON z.id = left_id, range(2) r(k)),
  drawn AS (SELECT s.line_no, repeat('    ', depth) AS pad, side, cluster, distance, 10 * z.size - 6 AS n,
    CASE WHEN cluster IS NOT NULL THEN 'cluster_' || cluster WHEN depth = 0 THEN 'root' ELSE 'node_' || s.id END AS name
    FROM spot s JOIN sizes z USING (id) LEFT JOIN names USING (id) LEFT JOIN tree ON node_id = s.id)
  SELECT line_no, pad || '{{' AS line FROM drawn UNION ALL
  SELECT line_no + 1, pad || '  "name": "' || name || '",' FROM drawn UNION ALL
  SELECT line_no + 2, pad || '  ' || CASE WHEN cluster IS NULL THEN '"children": [' ELSE '"cluster_id": ' || cluster END FROM drawn UNION ALL
  SELECT line_no + n - 3, pad || '  ],' FROM drawn WHERE cluster IS NULL UNION ALL
  SELECT line_no + n - 2, pad || '  "distance": ' || distance FROM drawn WHERE cluster IS NULL UNION ALL
  SELECT line_no + n - 1, pad || '}}' || side FROM drawn"""


def term_counts(source: str) -> str:
    """counts (id, term, tf) of word-bounded grams of ``source`` (id, c)."""
    parts = " UNION ALL ".join(
        f"SELECT id, substr(word, CAST(unnest(range(1, length(word) - {n} + 2)) AS INTEGER), {n}) AS term FROM words" for n in (3, 4, 5)
    )
    return f"""words AS (SELECT id, concat(' ', unnest(string_split(c, ' ')), ' ') AS word FROM {source}),
  terms AS ({parts}), counts AS (SELECT id, term, count(*) AS tf FROM terms GROUP BY id, term)"""


VOCABULARY = """vocabulary AS (SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM counts GROUP BY term
    ORDER BY total DESC, term LIMIT {0})"""

ORACLES = {
    "clean_text": f"WITH {DOCS} SELECT id, c AS comentario_clean FROM docs",
    "valid_filter": f"WITH {MIXED} SELECT doc_id AS id, c AS comentario_clean FROM mixed WHERE {VALID}",
    "load_metrics": f"""WITH {MIXED} SELECT count(*) AS read_rows, count(*) FILTER (WHERE NOT ({VALID})) AS filtered_rows,
      count(*) FILTER (WHERE {VALID}) AS valid_rows FROM mixed""",
    "dense_id": f"WITH {MIXED} SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS id FROM mixed WHERE {VALID}",
    "load_and_clean": f"WITH {TURNS} SELECT id, comentario, c AS comentario_clean FROM turns",
    "char_ngrams": f"""WITH src AS (SELECT conv_id, turn, {clean('text')} AS c FROM conversations),
      {grams('src', 'conv_id, turn')} SELECT conv_id, turn, gram FROM grams""",
    "ngram_counts": f"WITH {DOCS}, {grams('docs')} SELECT id, count(*) AS n_grams FROM grams GROUP BY id",
    "short_text_grams": f"""WITH src AS (SELECT doc_id AS id, {clean('lang')} AS c FROM documents),
      {grams('src')} SELECT id, gram FROM grams""",
    "gram_hash": f"""WITH {DOCS}, {grams('docs')}
      SELECT id, CAST(sum({GRAM_HASH}) AS BIGINT) AS hash_sum FROM grams GROUP BY id""",
    "minhash_signature": f"WITH {DOCS}, {signatures('docs')} SELECT id, array_to_string(sig, ',') AS sig FROM sigs",
    "lsh_buckets": f"{DOC_ENTRIES} SELECT band, bucket, id FROM entries",
    "lsh_star_edges": f"{DOC_ENTRIES}, {STARS} SELECT id, hub FROM stars",
    "lsh_collisions": f"""{DOC_ENTRIES}, sized AS (SELECT band, bucket, count(*) AS n FROM entries GROUP BY band, bucket)
      SELECT count(*) FILTER (WHERE n > 1) AS shared_buckets, CAST(sum(n * (n - 1)) AS BIGINT) AS ordered_collisions,
      max(n) AS largest_bucket FROM sized""",
    "lsh_query": f"""WITH {DOCS}, items AS (SELECT item_id AS id, {clean('text')} AS c FROM benchmark),
      {signatures('docs')}, {entries(SHORT_BANDS, SHORT_ROWS)},
      {signatures('items', 'probe_sigs', 'p_')}, {entries(SHORT_BANDS, SHORT_ROWS, 'probe_sigs', 'probes')}
      SELECT DISTINCT p.id AS probe_id, e.id FROM probes p JOIN entries e USING (band, bucket)""",
    "jaccard_estimate": f"""{DOC_ENTRIES}, {STARS} SELECT s.id, s.hub, round(list_sum(list_transform(range(1, {NUM_PERM + 1}),
      lambda i: CASE WHEN a.sig[i] = b.sig[i] THEN 1 ELSE 0 END)) / {NUM_PERM}.0, 6) AS jaccard
      FROM stars s JOIN sigs a ON a.id = s.id JOIN sigs b ON b.id = s.hub""",
    "components": f"WITH RECURSIVE {DOCS}, {signatures('docs')}, {entries(DOC_BANDS, DOC_ROWS)}, {STARS}, {ROOTS} SELECT id, root FROM roots",
    "component_labels": f"{DOC_LABELS} SELECT id, cluster FROM labels",
    "short_text_labels": f"{TURN_LABELS} SELECT id, cluster FROM labels",
    "assignments": f"{TURN_LABELS} SELECT id, comentario, cluster FROM turns JOIN labels USING (id)",
    "cluster_sizes": f"{DOC_LABELS} SELECT cluster, count(*) AS size FROM labels GROUP BY cluster",
    "cluster_samples": f"{TURN_LABELS}, {SAMPLED.format('turns')} SELECT cluster, samples FROM sampled",
    "cluster_aggregates": f"""WITH RECURSIVE {DOCS.replace("docs AS", "raw AS")}, docs AS (
      SELECT row_number() OVER (ORDER BY id) - 1 AS id, comentario, c FROM raw WHERE {VALID}),
      {labels('docs', DOC_BANDS, DOC_ROWS)}, {SAMPLED.format('docs')},
      sized AS (SELECT cluster, count(*) AS size FROM labels GROUP BY cluster)
      SELECT cluster, size, samples FROM sized JOIN sampled USING (cluster)""",
    "top_clusters": f"""{DOC_LABELS} SELECT cluster, count(*) AS size FROM labels WHERE cluster <> -1
      GROUP BY cluster ORDER BY size DESC, cluster LIMIT 20""",
    "distinct_labels": f"{DOC_LABELS} SELECT DISTINCT cluster FROM labels",
    "clustered_texts": f"{DOC_LABELS} SELECT id, cluster FROM labels WHERE cluster <> -1",
    "representatives": f"""{DOC_LABELS}, heads AS (SELECT cluster, min(id) AS id FROM labels WHERE cluster <> -1 GROUP BY cluster)
      SELECT cluster, id, array_to_string(sig, ',') AS sig FROM heads JOIN sigs USING (id)""",
    "run_metrics": f"""{DOC_LABELS} SELECT count(*) AS n_texts, count(DISTINCT cluster) FILTER (WHERE cluster <> -1) AS n_clusters,
      count(*) FILTER (WHERE cluster = -1) AS n_noise,
      round(100.0 * count(*) FILTER (WHERE cluster = -1) / count(*), 6) AS noise_pct FROM labels""",
    "l2_normalise": """WITH v AS (SELECT vec_id AS id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * (vec_id % 7)) AS vec
        FROM embeddings), n AS (SELECT id, vec, sqrt(list_sum(list_transform(vec, lambda x: x * x))) AS len FROM v)
      SELECT id, CAST(unnest(range(len(vec))) AS INTEGER) AS pos,
        round(unnest(list_transform(vec, lambda x: x / CASE WHEN len > 0 THEN len ELSE 1 END)), 6) AS x FROM n""",
    "precision_cast": """SELECT vec_id AS id, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
      round(CAST(unnest(list_transform(embedding, lambda x: CAST(CAST(x AS DOUBLE) / 3 AS FLOAT))) AS DOUBLE), 9) AS x FROM embeddings""",
    "centroids": """WITH cells AS (SELECT label AS cluster, CAST(unnest(range(len(embedding))) AS INTEGER) AS pos,
        CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings)
      SELECT cluster, pos, round(avg(x), 6) AS x FROM cells GROUP BY cluster, pos""",
    "cosine_topk": TOPK,
    "ivf_topk": TOPK,
    "saved_index_topk": TOPK,
    "core_distance": f"WITH {CORE} SELECT id, round(core, 6) AS core FROM core",
    "mutual_reachability": f"""WITH {CORE} SELECT DISTINCT least(k.id, k.nbr_id) AS a, greatest(k.id, k.nbr_id) AS b,
      round(greatest(dist, x.core, y.core), 6) AS weight FROM knn k JOIN core x ON x.id = k.id JOIN core y ON y.id = k.nbr_id""",
    "spanning_tree": f"WITH RECURSIVE {TREE} SELECT a, b, round(weight, 6) AS weight FROM mst",
    "single_linkage": f"""WITH RECURSIVE {LINKED} SELECT node, "left", "right", round(dist, 6) AS dist, size FROM merges""",
    "condensed_clusters": f"""WITH RECURSIVE {CONDENSED} SELECT cluster, parent, round(birth, 6) AS birth, size, round(stability, 6) AS stability, chosen
      FROM clusters JOIN picked USING (cluster)""",
    "density_clusters": f"""WITH RECURSIVE {CONDENSED},
      inside(id, x) AS (SELECT id, id FROM p UNION ALL SELECT id, up FROM inside JOIN down USING (x)),
      found AS (SELECT id, chosen FROM inside JOIN walk USING (x) JOIN picked USING (cluster) WHERE NOT big AND chosen IS NOT NULL),
      numbers AS (SELECT chosen, row_number() OVER (ORDER BY min(id)) - 1 AS n FROM found GROUP BY chosen)
      SELECT p.id, CAST(coalesce(n, -1) AS INTEGER) AS cluster FROM p LEFT JOIN found USING (id) LEFT JOIN numbers USING (chosen)""",
    "average_tree": f"{AVERAGE} SELECT * FROM tree",
    "ward_tree": f"{WARD} SELECT * FROM tree",
    "tree_json": LINES,
    "representative_distances": f"""{TURN_LABELS}, heads AS (SELECT cluster, min(id) AS id FROM labels WHERE cluster <> -1 GROUP BY cluster),
      reps AS (SELECT cluster, sig FROM heads JOIN sigs USING (id))
      SELECT x.cluster AS a, y.cluster AS b, round(1 - list_sum(list_transform(range(1, {NUM_PERM + 1}),
      lambda i: CASE WHEN x.sig[i] = y.sig[i] THEN 1 ELSE 0 END)) / {NUM_PERM}.0, 6) AS dist
      FROM reps x JOIN reps y ON x.cluster < y.cluster WHERE list_has_any(
        list_transform(range(1, {NUM_PERM + 1}), lambda i: concat(i, ':', x.sig[i])), list_transform(range(1, {NUM_PERM + 1}), lambda i: concat(i, ':', y.sig[i])))""",
    "term_counts": f"WITH {TURNS}, {term_counts('turns')} SELECT id, term, tf FROM counts",
    "vocabulary": f"WITH {DOCS}, {term_counts('docs')}, {VOCABULARY.format(50000)} SELECT term, total, df FROM vocabulary",
    "tfidf_weights": f"""WITH {TURNS}, {term_counts('turns')}, {VOCABULARY.format(50000)},
      raw AS (SELECT id, term, (1 + ln(tf)) * (ln((1 + (SELECT count(*) FROM turns)) / CAST(1 + df AS DOUBLE)) + 1) AS w
        FROM counts JOIN vocabulary USING (term))
      SELECT id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight FROM raw""",
    "encoded_vectors": f"""WITH {DOCS}, letters AS (SELECT id, range AS pos,
        length(c) - length(replace(c, chr(CAST(97 + range AS INTEGER)), '')) AS n FROM docs, range(26))
      SELECT id, CAST(pos AS INTEGER) AS pos, round(CAST(CAST(n / greatest(sqrt(sum(n * n) OVER (PARTITION BY id)), 1e-30) AS FLOAT) AS DOUBLE), 5) AS x
      FROM letters""",
    "csv_scan": "SELECT text AS comentario FROM documents",
    "assignment_file": f"{TURN_LABELS} SELECT id, comentario, cluster FROM turns JOIN labels USING (id)",
    "aggregate_file": f"""{TURN_LABELS}, {SAMPLED.format('turns')}, sized AS (SELECT cluster, count(*) AS size FROM labels GROUP BY cluster)
      SELECT cluster, size, samples FROM sized JOIN sampled USING (cluster)""",
    "csv_load": f"""WITH {DOCS} SELECT row_number() OVER (ORDER BY id) - 1 AS id, comentario, c AS comentario_clean FROM docs WHERE {VALID}""",
    "saved_stage": f"WITH {DOCS} SELECT id, c AS comentario_clean FROM docs",
    "literal_run": f"""{TURN_LABELS}, {SAMPLED.format('turns')}, sized AS (SELECT cluster, count(*) AS size FROM labels GROUP BY cluster)
      SELECT cluster, size, samples FROM sized JOIN sampled USING (cluster)""",
}


def oracle_sql():
    return dict(ORACLES)
