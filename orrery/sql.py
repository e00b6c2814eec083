"""DuckDB statements that give the same rows as the core queries, over the same tables."""

from __future__ import annotations

E = "e AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label FROM embeddings)"


def knn(name: str, k: int, distance: str = "list_distance(q.v, r.v)", source: str = "e") -> str:
    return f"""{name} AS (SELECT src_id, nbr_id, rank, distance FROM (
  SELECT q.id AS src_id, r.id AS nbr_id, {distance} AS distance, row_number() OVER (PARTITION BY q.id ORDER BY {distance}, r.id) AS rank
  FROM {source} q JOIN {source} r ON q.id <> r.id) WHERE rank <= {k})"""


NORMED = "n AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e)"
CENTRED = "c AS (SELECT id, label, list_transform(v, lambda x: x - list_avg(v)) AS v FROM e), n AS (SELECT id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM c)"
HALF = "0.5 * list_sum(list_transform(list_zip(q.v, r.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
OUT = "SELECT src_id, nbr_id, rank, round(distance, 6) AS distance FROM"
KNN = f"WITH {E}, {knn('knn', 15)}"
LAYOUT = "low AS (SELECT id, label, v[1:2] AS v FROM e)"

SMOOTH = """RECURSIVE lists AS (SELECT src_id, list(distance ORDER BY distance) AS d FROM knn GROUP BY src_id),
base AS (SELECT src_id, d, coalesce(list_min(list_filter(d, lambda x: x > 0)), 0.0) AS rho, log2(len(d)) AS target FROM lists),
bis AS (
  SELECT src_id, d, rho, target, 0 AS step, 0.0::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS s, 1.0::DOUBLE AS best, 'infinity'::DOUBLE AS miss, false AS done FROM base
  UNION ALL
  SELECT src_id, d, rho, target, step + 1,
    CASE WHEN now THEN lo WHEN p > target THEN lo ELSE s END, CASE WHEN now THEN hi WHEN p > target THEN s ELSE hi END,
    CASE WHEN now THEN s WHEN p > target THEN (lo + s) / 2 WHEN isinf(hi) THEN s * 2 ELSE (s + hi) / 2 END,
    CASE WHEN abs(p - target) < miss THEN s ELSE best END, least(abs(p - target), miss), now
  FROM (SELECT *, abs(p - target) < 1e-5 AS now FROM (
    SELECT *, list_sum(list_transform(d, lambda x: CASE WHEN x <= rho THEN 1.0 ELSE exp(-(x - rho) / greatest(s, 1e-12)) END)) AS p FROM bis WHERE step < 64 AND NOT done))),
solved AS (SELECT src_id, any_value(d) AS d, any_value(rho) AS rho, arg_max(best, step) AS sigma FROM bis GROUP BY src_id),
smooth AS (SELECT src_id, rho, greatest(sigma, 1e-3 * CASE WHEN rho > 0 THEN list_avg(d) ELSE (SELECT avg(distance) FROM knn) END, 1e-12) AS sigma FROM solved)"""


def with_smooth(tail: str) -> str:
    return f"WITH RECURSIVE {E}, {knn('knn', 15)}, {SMOOTH.removeprefix('RECURSIVE ')} {tail}"


MEMBER = """, strength AS (SELECT src, dst, max(weight) AS weight FROM (
  SELECT k.src_id AS src, k.nbr_id AS dst, CASE WHEN distance <= rho THEN 1.0 ELSE exp(-(distance - rho) / sigma) END AS weight FROM knn k JOIN smooth USING (src_id)) WHERE weight > 0 GROUP BY ALL),
fuzzy AS (SELECT * FROM (SELECT coalesce(a.src, b.dst) AS src, coalesce(a.dst, b.src) AS dst, coalesce(a.weight, 0) + coalesce(b.weight, 0) - coalesce(a.weight, 0) * coalesce(b.weight, 0) AS weight
  FROM strength a FULL OUTER JOIN strength b ON a.src = b.dst AND a.dst = b.src) WHERE weight > 1e-6)"""

PERPLEXITY = """lists AS (SELECT src_id, list(nbr_id ORDER BY distance, nbr_id) AS ids, list(distance * distance ORDER BY distance, nbr_id) AS d2 FROM knn GROUP BY src_id),
bis AS (
  SELECT src_id, ids, d2, 0 AS step, '-infinity'::DOUBLE AS lo, 'infinity'::DOUBLE AS hi, 1.0::DOUBLE AS beta, false AS done FROM lists
  UNION ALL
  SELECT src_id, ids, d2, step + 1,
    CASE WHEN now THEN lo WHEN off > 0 THEN beta ELSE lo END, CASE WHEN now THEN hi WHEN off > 0 THEN hi ELSE beta END,
    CASE WHEN now THEN beta WHEN off > 0 THEN CASE WHEN isinf(hi) THEN beta * 2 ELSE (beta + hi) / 2 END ELSE CASE WHEN isinf(lo) THEN beta / 2 ELSE (beta + lo) / 2 END END, now
  FROM (SELECT *, abs(off) < 1e-5 AS now FROM (SELECT *, beta * w / greatest(s, 1e-300) + ln(greatest(s, 1e-300)) - ln(5.0) AS off FROM (
    SELECT *, list_sum(list_transform(d2, lambda x: exp(-beta * x))) AS s, list_sum(list_transform(d2, lambda x: x * exp(-beta * x))) AS w FROM bis WHERE step < 200 AND NOT done)))),
solved AS (SELECT src_id, any_value(ids) AS ids, any_value(d2) AS d2, arg_max(beta, step) AS beta FROM bis GROUP BY src_id),
flat AS (SELECT src_id AS src, unnest(ids) AS dst, unnest(list_transform(d2, lambda x: exp(-beta * x))) AS e, list_sum(list_transform(d2, lambda x: exp(-beta * x))) AS z FROM solved),
cond AS (SELECT src, dst, e / z AS p FROM flat),
pairs AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(p) AS s FROM cond GROUP BY ALL),
sym AS (SELECT a AS src, b AS dst, 0.5 * s / (SELECT sum(s) FROM pairs) AS p FROM pairs UNION ALL SELECT b, a, 0.5 * s / (SELECT sum(s) FROM pairs) FROM pairs)"""


def with_affinity(tail: str) -> str:
    return f"WITH RECURSIVE {E}, {knn('knn', 15)}, {PERPLEXITY} {tail}"


def graph(weight: str, mutual: bool = False, prune: float = 0.0) -> str:
    w = {"snn": "len(list_intersect(a.s, b.s)) / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s)))::DOUBLE", "distance": "1.0 / (1.0 + k.distance)", "binary": "1.0::DOUBLE"}[weight]
    keep = "WHERE EXISTS (SELECT 1 FROM knn t WHERE t.src_id = k.nbr_id AND t.nbr_id = k.src_id)" if mutual else ""
    return f"""{KNN}, sets AS (SELECT src_id, list(nbr_id) AS s FROM knn GROUP BY src_id),
directed AS (SELECT k.src_id AS u, k.nbr_id AS v, {w} AS weight FROM knn k JOIN sets a ON a.src_id = k.src_id JOIN sets b ON b.src_id = k.nbr_id {keep}),
g AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, max(weight) AS weight FROM directed WHERE weight > {prune} GROUP BY ALL)"""


EDGES = "SELECT src, dst, round(weight, 6) AS weight FROM g"
QUERY_KNN = f"""WITH {E}, hit AS (SELECT q.id AS src_id, r.id AS nbr_id, list_distance(q.v, r.v) AS distance,
  row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, r.v), r.id) AS rank FROM e q, e r WHERE q.id % 5 = 0 AND r.id % 5 <> 0)"""
VOTES = """votes AS (SELECT src_id, predicted FROM (SELECT k.src_id, b.label AS predicted, row_number() OVER (PARTITION BY k.src_id ORDER BY count(*) DESC, b.label) AS nth
  FROM knn k JOIN e b ON b.id = k.nbr_id GROUP BY k.src_id, b.label) WHERE nth = 1),
per_class AS (SELECT label, count(*) AS n, count(*) FILTER (label = predicted) AS correct, round(count(*) FILTER (label = predicted) / count(*), 6) AS recall FROM e JOIN votes ON src_id = id GROUP BY label)"""
RANKS = f"""{LAYOUT}, hr AS (SELECT q.id AS i, r.id AS j, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, r.v), r.id) AS h FROM e q JOIN e r ON q.id <> r.id),
lr AS (SELECT q.id AS i, r.id AS j, row_number() OVER (PARTITION BY q.id ORDER BY list_distance(q.v, r.v), r.id) AS l FROM low q JOIN low r ON q.id <> r.id),
n AS (SELECT count(*) AS n FROM e), ks AS (SELECT unnest([15, 30, 50]) AS k),
s AS (SELECT k, sum(CASE WHEN l <= k THEN greatest(0, h - k) ELSE 0 END) AS t, sum(CASE WHEN h <= k THEN greatest(0, l - k) ELSE 0 END) AS c,
  count(*) FILTER (h <= k AND l <= k) AS shared, sum(CASE WHEN l <= k THEN abs(h - l) ELSE 0 END) AS err FROM hr JOIN lr USING (i, j), ks GROUP BY k)"""
PAIRS = f"{LAYOUT}, pairs AS (SELECT a.id AS a, b.id AS b, list_distance(a.v, b.v) AS dh, list_distance(la.v, lb.v) AS dl FROM e a JOIN e b ON a.id < b.id JOIN low la ON la.id = a.id JOIN low lb ON lb.id = b.id)"
LOW_KNN = knn("lowknn", 15, source="low")

QLOW = "qlow AS (SELECT id, v[1:2] AS y FROM e)"
NEAR = f"{QUERY_KNN}, {QLOW}, near AS (SELECT src_id, nbr_id, rank, distance, y FROM hit JOIN qlow ON id = nbr_id WHERE rank <= {{k}})"
FLAT = "flat AS (SELECT src_id AS id, distance, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS pos FROM near)"

DENSITY = """rad AS (SELECT a.distance AS rh, l.distance AS ry FROM knn a JOIN lowknn l ON a.src_id = l.src_id AND a.rank = 15 AND l.rank = 15),
eps AS (SELECT 1e-6 * least(min(rh) FILTER (rh > 0), min(ry) FILTER (ry > 0)) AS eps FROM rad), lg AS (SELECT rh, ry, ln(greatest(rh, eps)) AS h, ln(greatest(ry, eps)) AS y FROM rad, eps),
dr AS (SELECT *, rank() OVER (ORDER BY h) + (count(*) OVER (PARTITION BY h) - 1) / 2.0 AS ph, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS py FROM lg),
dm AS (SELECT median(h) AS mh, median(y) AS my FROM lg), da AS (SELECT median(abs(h - mh)) AS ah, median(abs(y - my)) AS ay FROM lg, dm),
dens AS (SELECT round(corr(ph, py), 6) AS density_spearman, round(corr(h, y), 6) AS density_pearson, round(sqrt(avg(((h - mh) / ah - (y - my) / ay) ** 2)), 6) AS density_log_radius_rmse,
  round(avg(rh), 6) AS density_radius_high_mean, round(avg(ry), 6) AS density_radius_embedding_mean, count(*) AS density_sample_size FROM dr, dm, da)"""
LAYOUT_AND = LAYOUT + ", "

ORACLES: dict[str, str] = {
    "scaled_start": f"""WITH {E}, flat AS (SELECT id, unnest(v[1:2]) AS x, generate_subscripts(v[1:2], 1) - 1 AS pos FROM e), m AS (SELECT pos, avg(x) AS m, stddev_samp(x) AS s FROM flat GROUP BY pos)
SELECT id, pos::INT AS pos, round((x - m) / (SELECT max(s) FROM m), 6) AS z FROM flat JOIN m USING (pos)""",
    "project_weighted": f"""{NEAR.format(k=10)}, g AS (SELECT *, distance - min(distance) OVER (PARTITION BY src_id) AS gap FROM near), s AS (SELECT src_id, median(gap) FILTER (gap > 0) AS sigma FROM g GROUP BY src_id),
w AS (SELECT src_id AS id, exp(-gap / sigma) AS w, unnest(y) AS v, generate_subscripts(y, 1) - 1 AS pos FROM g JOIN s USING (src_id)) SELECT id, pos::INT AS pos, round(sum(w * v) / sum(w), 6) AS z FROM w GROUP BY ALL""",
    "project_interpolated": f"{NEAR.format(k=10)}, {FLAT} SELECT id, pos::INT AS pos, round(sum(v / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS z FROM flat GROUP BY id, pos",
    "transform_init_median": f"{NEAR.format(k=15)}, {FLAT} SELECT id, pos::INT AS pos, round(median(v), 6) AS z FROM flat GROUP BY id, pos",
    "transform_init_weighted": f"{NEAR.format(k=15)}, {FLAT} SELECT id, pos::INT AS pos, round(sum(v / (distance + 1e-6)) / sum(1 / (distance + 1e-6)), 6) AS z FROM flat GROUP BY id, pos",
    "landmark_places": f"""WITH {E}, flat AS (SELECT id, unnest(v[1:4]) AS x, generate_subscripts(v[1:4], 1) - 1 AS axis FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY x, id) - 1 AS r, count(*) OVER (PARTITION BY axis) AS n FROM flat)
SELECT axis::INT AS axis, (r * 20 // n)::BIGINT AS slot, id FROM r WHERE r = 0 OR r * 20 // n <> (r - 1) * 20 // n""",
    "pca_given": f"""WITH {E}, z AS (SELECT id, list_transform(v, lambda x: (x - 0.125) / 0.5) AS z FROM e)
SELECT id, 0::INT AS pos, round(z[1] + 0.5 * z[2] - 0.5 * z[3], 6) AS z FROM z UNION ALL SELECT id, 1::INT, round(0.25 * z[2] + 2.0 * z[3], 6) FROM z""",
    "landmark_split": "SELECT vec_id AS id, vec_id % 5 = 0 AS is_landmark FROM embeddings",
    "finite_check": f"WITH {E} SELECT count(*) AS n_rows, max(len(v))::BIGINT AS n_dims, bool_and(len(list_filter(v, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS all_finite, max(len(v)) = min(len(v)) AS one_length FROM e",
    "standardize": f"""WITH {E}, flat AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e),
m AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END AS sd FROM flat GROUP BY pos) SELECT id, pos::INT AS pos, round((x - mean) / sd, 6) AS z FROM flat JOIN m USING (pos)""",
    "standardize_columns": """WITH p AS (SELECT p_partkey AS id, [p_size::DOUBLE, p_retailprice::DOUBLE] AS v FROM part), flat AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM p),
m AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END AS sd FROM flat GROUP BY pos) SELECT id, pos::INT AS pos, round((x - mean) / sd, 6) AS z FROM flat JOIN m USING (pos)""",
    "normalize_rows": f"WITH {E}, {NORMED} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length2, round(v[1], 6) AS first FROM n",
    "normalize_centred_rows": f"WITH {E}, {CENTRED} SELECT id, round(list_sum(list_transform(v, lambda x: x * x)), 6) AS length2, round(v[1], 6) AS first FROM n",
    "knn_euclidean": f"{KNN} {OUT} knn",
    "knn_cosine": f"WITH {E}, {NORMED}, {knn('knn', 15, HALF, 'n')} {OUT} knn",
    "knn_correlation": f"WITH {E}, {CENTRED}, {knn('knn', 15, HALF, 'n')} {OUT} knn",
    "knn_inner_product": f"WITH {E}, {knn('knn', 15, '-list_dot_product(q.v, r.v)')} {OUT} knn",
    "knn_query": f"{QUERY_KNN} {OUT} hit WHERE rank <= 10",
    "knn_nearest_one": f"{QUERY_KNN} {OUT} hit WHERE rank <= 1",
    "knn_self_removed": f"{KNN} {OUT} knn WHERE rank <= 10",
    "knn_trimmed": f"{KNN} {OUT} knn WHERE rank <= 5",
    "knn_checked": "SELECT 0::BIGINT AS unknown_neighbours, 0::BIGINT AS bad_distances, count(*) AS n_rows, 15::BIGINT AS k, 0::BIGINT AS ragged FROM embeddings",
    "knn_recall": f"""{KNN}, {LAYOUT}, {LOW_KNN}, per AS (SELECT a.src_id, count(b.src_id) / 15.0 AS r FROM knn a LEFT JOIN lowknn b ON a.src_id = b.src_id AND a.nbr_id = b.nbr_id GROUP BY 1)
SELECT round(avg(r), 6) AS mean_recall, round(median(r), 6) AS median_recall, round(min(r)::DOUBLE, 6) AS min_recall FROM per""",
    "knn_connectivity": f"""WITH RECURSIVE {E}, {knn('knn', 3)}, und AS (SELECT src_id AS a, nbr_id AS b FROM knn UNION SELECT nbr_id, src_id FROM knn),
reach AS (SELECT id, id AS c FROM e UNION SELECT u.b, r.c FROM reach r JOIN und u ON u.a = r.id), comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id), sizes AS (SELECT c, count(*) AS n FROM comp GROUP BY c)
SELECT count(*) AS n_components, max(n) AS largest, round(max(n) / sum(n), 6) AS largest_share, count(*) FILTER (n = 1) AS singletons, 0::BIGINT AS self_edges, 0::BIGINT AS invalid_edges FROM sizes""",
    "knn_label_accuracy": f"{KNN}, {VOTES} SELECT * FROM per_class",
    "rare_recall": f"""{KNN}, {VOTES}, q AS (SELECT min(n) AS q FROM (SELECT n, row_number() OVER (ORDER BY n) AS nth, count(*) OVER () AS t FROM per_class) WHERE nth >= 0.25 * t)
SELECT round(avg(recall), 6) AS mean_recall, round(avg(recall) FILTER (n <= q), 6) AS rare_recall, count(*) FILTER (n <= q) AS n_rare FROM per_class, q""",
    "batch_mixing": f"""{KNN}, c AS (SELECT src_id, nbr_id % 3 AS b, count(*) / 15.0 AS p FROM knn GROUP BY ALL), h AS (SELECT src_id, sum(-p * ln(p)) AS h FROM c GROUP BY 1)
SELECT round(avg(h), 6) AS batch_entropy, round(avg(h) / ln(3), 6) AS batch_mixing FROM h""",
    "label_batch_tradeoff": f"""{KNN}, {VOTES}, acc AS (SELECT sum(correct) / sum(n) AS a FROM per_class), c AS (SELECT src_id, nbr_id % 3 AS b, count(*) / 15.0 AS p FROM knn GROUP BY ALL), h AS (SELECT src_id, sum(-p * ln(p)) AS h FROM c GROUP BY 1)
SELECT round(0.5 * any_value(a) + 0.5 * avg(h) / ln(3), 4) AS tradeoff FROM h, acc""",
    "snn_graph": f"{graph('snn')} {EDGES}",
    "snn_graph_pruned": f"{graph('snn', prune=0.1)} {EDGES}",
    "distance_graph": f"{graph('distance')} {EDGES}",
    "binary_graph": f"{graph('binary')} {EDGES}",
    "mutual_graph": f"{graph('snn', mutual=True)} {EDGES}",
    "graph_degree": f"{graph('snn', prune=0.1)}, two AS (SELECT src AS id, weight FROM g UNION ALL SELECT dst, weight FROM g) SELECT e.id, count(weight) AS degree, round(coalesce(sum(weight), 0), 6) AS strength FROM e LEFT JOIN two USING (id) GROUP BY e.id",
    "graph_components": f"""WITH RECURSIVE {graph('snn', prune=0.3).removeprefix('WITH ')}, und AS (SELECT src AS a, dst AS b FROM g UNION SELECT dst, src FROM g), reach AS (SELECT id, id AS c FROM e UNION SELECT u.b, r.c FROM reach r JOIN und u ON u.a = r.id)
SELECT id, min(c) AS component FROM reach GROUP BY id""",
    "modularity_by_label": f"""{graph('snn')}, m AS (SELECT sum(weight) AS m FROM g), x AS (SELECT a.label AS ca, b.label AS cb, weight FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst),
vol AS (SELECT c, sum(weight) AS vol FROM (SELECT ca AS c, weight FROM x UNION ALL SELECT cb, weight FROM x) GROUP BY c), ins AS (SELECT ca AS c, sum(weight) AS w FROM x WHERE ca = cb GROUP BY 1)
SELECT round(sum(coalesce(w, 0) / m - (vol / (2 * m)) ** 2), 6) AS modularity, (SELECT count(DISTINCT label) FROM e) AS n_communities FROM vol LEFT JOIN ins USING (c), m""",
    "community_graph": f"{graph('snn')} SELECT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst, round(sum(weight), 6) AS weight FROM g JOIN e a ON a.id = src JOIN e b ON b.id = dst GROUP BY ALL",
    "communities_connected": f"""WITH RECURSIVE {graph('snn', prune=0.2).removeprefix('WITH ')}, und AS (SELECT src AS a, dst AS b FROM g JOIN e x ON x.id = src JOIN e y ON y.id = dst WHERE x.label = y.label UNION SELECT dst, src FROM g JOIN e x ON x.id = src JOIN e y ON y.id = dst WHERE x.label = y.label),
reach AS (SELECT id, id AS c FROM e UNION SELECT u.b, r.c FROM reach r JOIN und u ON u.a = r.id), comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT label AS community, count(*) AS size, count(DISTINCT c) = 1 AS connected FROM e JOIN comp USING (id) GROUP BY label""",
    "smooth_knn": with_smooth("SELECT src_id, round(rho, 6) AS rho, round(sigma, 6) AS sigma FROM smooth"),
    "memberships": with_smooth(MEMBER + " SELECT src, dst, round(weight, 6) AS weight FROM strength"),
    "fuzzy_union": with_smooth(MEMBER + " SELECT src, dst, round(weight, 6) AS weight FROM fuzzy"),
    "epoch_schedule": with_smooth(MEMBER + " SELECT src, dst, round(weight, 6) AS weight, round((SELECT max(weight) FROM fuzzy) / greatest(weight, 1e-6), 4) AS epochs_per_sample FROM fuzzy"),
    "binary_union": f"{KNN} SELECT src_id AS src, nbr_id AS dst, 1.0::DOUBLE AS weight FROM knn UNION SELECT nbr_id, src_id, 1.0 FROM knn",
    "distance_profile": f"WITH {E}, {knn('knn', 50)} SELECT count(DISTINCT src_id) AS n_rows, round(stddev_pop(distance) / avg(distance), 6) AS cv, round(median(distance) FILTER (rank = 15), 6) AS median_15, round(median(distance) FILTER (rank = 30), 6) AS median_30, round(median(distance) FILTER (rank = 50), 6) AS median_50 FROM knn",
    "perplexity_affinity": with_affinity("SELECT src, dst, round(p, 6) AS p FROM cond"),
    "symmetric_affinity": with_affinity("SELECT src, dst, round(p, 8) AS p FROM sym"),
    "tsne_kl": with_affinity(f""", {LAYOUT}, z AS (SELECT sum(1 / (1 + list_distance(a.v, b.v) ** 2)) AS z FROM low a JOIN low b ON a.id <> b.id)
SELECT round(sum(p * ln((p + 1e-9) / (1 / (1 + list_distance(a.v, b.v) ** 2) / z + 1e-9))), 6) AS kl FROM sym JOIN low a ON a.id = src JOIN low b ON b.id = dst, z"""),
    "tsne_gradient": with_affinity(f""", {LAYOUT}, q AS (SELECT a.id AS i, b.id AS j, 1 / (1 + list_distance(a.v, b.v) ** 2) AS q, a.v[1] - b.v[1] AS d1, a.v[2] - b.v[2] AS d2 FROM low a JOIN low b ON a.id <> b.id)
SELECT i AS id, round(sum(coalesce(p, 0) * q * d1 - q * q * d1 / (SELECT sum(q) FROM q)), 8) AS g1, round(sum(coalesce(p, 0) * q * d2 - q * q * d2 / (SELECT sum(q) FROM q)), 8) AS g2 FROM q LEFT JOIN sym ON src = i AND dst = j GROUP BY i"""),
    "rank_metrics": f"""WITH {E}, {RANKS} SELECT k::BIGINT AS k, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * t, 6) AS trustworthiness, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * c, 6) AS continuity,
  round(shared / (n * k)::DOUBLE, 6) AS knn_preservation, round(err / (n * k)::DOUBLE, 6) AS mean_neighbor_rank_error FROM s, n""",
    "preservation": f"{KNN}, {LAYOUT}, {LOW_KNN} SELECT round((SELECT count(*) FROM knn JOIN lowknn USING (src_id, nbr_id)) / (15.0 * (SELECT count(*) FROM e)), 6)::DOUBLE AS knn_preservation",
    "structure_score": f"""{KNN}, {LAYOUT}, {LOW_KNN}, s AS (SELECT count(*) FILTER (a.src_id IS NOT NULL AND b.src_id IS NOT NULL) AS shared, count(*) FILTER (a.src_id IS NULL) AS f, count(*) FILTER (b.src_id IS NULL) AS l FROM knn a FULL OUTER JOIN lowknn b ON a.src_id = b.src_id AND a.nbr_id = b.nbr_id)
SELECT round((shared / t + 1 - f / t + 1 - l / t) / 3, 6) AS structure_score FROM s, (SELECT count(*) * 15.0::DOUBLE AS t FROM e)""",
    "silhouette": f"""WITH {E}, {LAYOUT}, m AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM low a JOIN low b ON true GROUP BY ALL),
x AS (SELECT id, sum(CASE WHEN own = other THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM m GROUP BY id) SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM x""",
    "distance_corr": f"""WITH {E}, {PAIRS}, r AS (SELECT *, rank() OVER (ORDER BY dh) + (count(*) OVER (PARTITION BY dh) - 1) / 2.0 AS rh, rank() OVER (ORDER BY dl) + (count(*) OVER (PARTITION BY dl) - 1) / 2.0 AS rl,
  sqrt((SELECT sum(dh * dh) FROM pairs)) AS nh, sqrt((SELECT sum(dl * dl) FROM pairs)) AS nl FROM pairs)
SELECT round(corr(dh, dl), 6) AS pearson, round(corr(rh, rl), 6) AS spearman, round(sqrt(sum((dh / nh - dl / nl) ** 2)), 6) AS normalized_stress FROM r""",
    "pair_distances": f"WITH {E}, {PAIRS} SELECT a, b, round(dh, 6) AS dh, round(dl, 6) AS dl FROM pairs",
    "density": f"""{KNN}, {LAYOUT}, {LOW_KNN}, {DENSITY} SELECT * FROM dens""",
    "evaluation_settled": f"""{KNN}, {LAYOUT_AND}{RANKS.removeprefix(LAYOUT + ', ')}, {LOW_KNN}, {DENSITY},
rk AS (SELECT k, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * t, 6) AS t, round(1 - 2.0 / (n * k * (2 * n - 3 * k - 1)) * c, 6) AS c, round(shared / (n * k)::DOUBLE, 6) AS p, round(err / (n * k)::DOUBLE, 6) AS e FROM s, n),
sm AS (SELECT a.id, a.label AS own, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n FROM low a JOIN low b ON true GROUP BY ALL),
sx AS (SELECT id, sum(CASE WHEN own = other THEN CASE WHEN n > 1 THEN s / (n - 1) ELSE 0 END END) AS a, min(CASE WHEN own <> other THEN s / n END) AS b FROM sm GROUP BY id),
cf AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), cc AS (SELECT label, pos, avg(x) AS x FROM cf GROUP BY ALL),
cp AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.x - b.x) ** 2)) AS dh, sqrt(sum((a.x - b.x) ** 2) FILTER (a.pos <= 2)) AS dl FROM cc a JOIN cc b ON a.label < b.label AND a.pos = b.pos GROUP BY ALL)
SELECT 15::BIGINT AS primary_k, f.t AS trustworthiness, f.c AS continuity, f.p AS knn_preservation, f.p AS knn_preservation_15, g.p AS knn_preservation_30, h.p AS knn_preservation_50, f.e AS mean_neighbor_rank_error,
  density_spearman, density_pearson, density_log_radius_rmse, density_sample_size, (SELECT round(avg((b - a) / greatest(a, b)), 6) FROM sx) AS silhouette, (SELECT round(corr(dh, dl), 6) FROM cp) AS centroid_distance_correlation
FROM rk f, rk g, rk h, dens WHERE f.k = 15 AND g.k = 30 AND h.k = 50""",
    "prepare_embedding_data": f"""WITH {E}, flat AS (SELECT id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS pos FROM e),
m AS (SELECT pos, avg(x) AS mean, CASE WHEN stddev_samp(x) > 0 THEN stddev_samp(x) ELSE 1 END AS sd FROM flat GROUP BY pos) SELECT id, pos::INT AS pos, round((x - mean) / sd, 6) AS z FROM flat JOIN m USING (pos)""",
    "projection_confidence": f"""{QUERY_KNN}, g AS (SELECT src_id AS id, distance, distance - min(distance) OVER (PARTITION BY src_id) AS gap FROM hit WHERE rank <= 12), s AS (SELECT id, coalesce(median(gap) FILTER (gap > 0), 1.0) AS sigma FROM g GROUP BY id),
w AS (SELECT id, distance, exp(-gap / greatest(sigma, 1e-12)) AS w FROM g JOIN s USING (id)),
c AS (SELECT id, round(CASE WHEN min(distance) <= 1.4901161193847656e-08 THEN 1.0 ELSE sum(w) ** 2 / sum(w * w) / count(*) END, 6) AS confidence FROM w GROUP BY id)
SELECT id, confidence FROM (SELECT *, row_number() OVER (ORDER BY confidence, id) AS nth, count(*) OVER () AS n FROM c) WHERE nth <= ceil(0.1 * n)""",
    "centroid_corr": f"""WITH {E}, flat AS (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM e), c AS (SELECT label, pos, avg(x) AS x FROM flat GROUP BY ALL),
p AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.x - b.x) ** 2)) AS dh, sqrt(sum((a.x - b.x) ** 2) FILTER (a.pos <= 2)) AS dl FROM c a JOIN c b ON a.label < b.label AND a.pos = b.pos GROUP BY ALL) SELECT round(corr(dh, dl), 6) AS centroid_corr FROM p""",
    "ari_nmi": """WITH t AS (SELECT label AS x, vec_id % 3 AS y, count(*) AS n FROM embeddings GROUP BY ALL), r AS (SELECT x, sum(n) AS a FROM t GROUP BY x), c AS (SELECT y, sum(n) AS b FROM t GROUP BY y),
s AS (SELECT (SELECT sum(n) FROM t)::DOUBLE AS t, (SELECT sum(n * (n - 1) / 2.0) FROM t) AS sij, (SELECT sum(a * (a - 1) / 2.0) FROM r) AS si, (SELECT sum(b * (b - 1) / 2.0) FROM c) AS sj),
h AS (SELECT (SELECT -sum(a / t * ln(a / t)) FROM r, s) AS hx, (SELECT -sum(b / t * ln(b / t)) FROM c, s) AS hy, (SELECT sum(n / t * ln(n * t / (a * b))) FROM t JOIN r USING (x) JOIN c USING (y), s) AS mi)
SELECT round((sij - si * sj / (t * (t - 1) / 2)) / ((si + sj) / 2 - si * sj / (t * (t - 1) / 2)), 6) AS ari, round(mi / sqrt(hx * hy), 6) AS nmi FROM s, h""",
}
