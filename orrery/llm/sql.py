"""DuckDB statements that give the same rows as the queries of this package, over the same tables."""

USABLE = """newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY loaded_at DESC NULLS LAST) AS nth FROM float_matrix WHERE row_id IS NOT NULL)
  WHERE nth = 1 AND dataset IS NOT NULL),
usable AS (
  SELECT row_id, dataset, coalesce(probe, false) AS probe, list_transform(matrix_values, lambda x: x::DOUBLE) AS v FROM newest
  WHERE len(matrix_values) = ncol
    AND len(list_filter(matrix_values, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(matrix_values, lambda x: x <> 0)) > 0)"""

P1_FOUND = f"""WITH {USABLE},
near AS (
  SELECT q.row_id AS q, o.row_id AS o, row_number() OVER (PARTITION BY q.row_id ORDER BY list_distance(q.v, o.v), o.row_id) AS nth
  FROM usable q JOIN usable o ON q.dataset = o.dataset AND q.row_id <> o.row_id WHERE q.probe)
SELECT DISTINCT least(q, o) AS row_a, greatest(q, o) AS row_b FROM near WHERE nth <= 10"""

MEASURES = """once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY loaded_at DESC NULLS LAST) AS nth FROM compare_r_package_embeddings WHERE run_id IS NOT NULL)
  WHERE nth = 1 AND status = 'success' AND implementation IS NOT NULL),
long AS (
  SELECT run_id, dataset, implementation, 'embedding_time_sec' AS measure_name, embedding_time_sec AS value FROM once
  UNION ALL SELECT run_id, dataset, implementation, 'total_time_sec', total_time_sec FROM once),
vals AS (SELECT * FROM long WHERE value > 0 AND NOT isnan(value) AND NOT isinf(value)),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, implementation, measure_name ORDER BY value) AS nth,
            count(*) OVER (PARTITION BY dataset, implementation, measure_name) AS n FROM vals)"""

P2_FOUND = f"""WITH {MEASURES},
p95 AS (SELECT dataset, implementation, measure_name, value FROM ranked WHERE nth = (n * 950 + 999) // 1000)
SELECT v.run_id, v.measure_name FROM vals v JOIN p95 p
ON v.dataset IS NOT DISTINCT FROM p.dataset AND v.implementation = p.implementation AND v.measure_name = p.measure_name
WHERE v.value > 3 * p.value"""

P2_PERCENTILES = f"""WITH {MEASURES}, q AS (SELECT unnest([500, 900, 950, 990]) AS permille)
SELECT dataset, implementation, measure_name, permille, n, value FROM ranked, q WHERE nth = greatest(1, (n * permille + 999) // 1000)"""

P4_FOUND = """WITH best AS (
  SELECT search_id, id, min(distance) AS distance FROM node_distance
  WHERE search_id IS NOT NULL AND id IS NOT NULL AND distance >= 0 AND NOT isnan(distance) AND NOT isinf(distance) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY search_id ORDER BY distance, id) AS position FROM best)
SELECT search_id, id FROM ranked WHERE position <= 10"""

P4_TOP = P4_FOUND.replace("SELECT search_id, id FROM ranked", "SELECT search_id, id, distance, position FROM ranked")

FUSED = """once AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY panel_id, item_id, thread_id ORDER BY scored_at DESC NULLS LAST) AS nth
                 FROM score_accum WHERE panel_id IS NOT NULL AND item_id IS NOT NULL) WHERE nth = 1),
parts AS (
  SELECT panel_id, item_id, 'trust' AS score_name, trust_sum AS x, scored AS c FROM once
  UNION ALL SELECT panel_id, item_id, 'continuity', continuity_sum, scored FROM once
  UNION ALL SELECT panel_id, item_id, 'preservation', preservation_sum, scored FROM once
  UNION ALL SELECT panel_id, item_id, 'label_accuracy', label_accuracy_sum, label_accuracy_n FROM once),
summed AS (
  SELECT panel_id, item_id, score_name, printf('%.14e', fsum(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE x END))::DOUBLE / sum(c) AS score
  FROM parts WHERE c > 0 AND x IS NOT NULL GROUP BY ALL HAVING max((isnan(x) OR isinf(x))::INT) = 0),
counted AS (SELECT * FROM summed WHERE (panel_id, item_id) IN (SELECT (panel_id, item_id) FROM summed WHERE score_name <> 'label_accuracy')),
placed AS (SELECT *, rank() OVER (PARTITION BY panel_id, score_name ORDER BY score DESC) AS place FROM counted),
fused AS (
  SELECT panel_id, item_id, list_sort(list(place))[(count(*)::INT + 1) // 2]::DOUBLE AS median_rank, avg(place) AS mean_rank, count(*) AS n_scores
  FROM placed GROUP BY ALL)"""

P6_FOUND = f"""WITH {FUSED},
ordered AS (SELECT *, row_number() OVER (PARTITION BY panel_id ORDER BY mean_rank, median_rank, item_id) AS position FROM fused)
SELECT panel_id, item_id FROM ordered WHERE position <= 5"""

P6_RANKING = f"""WITH {FUSED}
SELECT panel_id, item_id, row_number() OVER (PARTITION BY panel_id ORDER BY median_rank, mean_rank, item_id) AS position, median_rank, mean_rank, n_scores FROM fused"""

ORACLES = {
    "p1_found": P1_FOUND, "p2_found": P2_FOUND, "p2_percentiles": P2_PERCENTILES, "p4_found": P4_FOUND, "p4_top": P4_TOP, "p6_found": P6_FOUND, "p6_ranking": P6_RANKING,
}
