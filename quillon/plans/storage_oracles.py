"""DuckDB SQL with the rows of the queries of scans, sinks, incremental runs and audits."""

from __future__ import annotations

from quillon.plans.oracles import _ALL, _CM, _CU, _MSGS, _PRINT, _S, _hash, _norm, _r, _union

_FINGER = f"""fa AS (SELECT label::VARCHAR AS name, sum(len(raw))::BIGINT AS numel, sum(list_sum(raw)) AS sm, sum(list_dot_product(raw, raw)) AS sq FROM r WHERE label <> 7 GROUP BY label),
    fb AS (SELECT label::VARCHAR AS name, sum(len(v))::BIGINT AS numel, sum(list_sum(v)) AS sm, sum(list_dot_product(v, v)) AS sq FROM (SELECT label, CASE WHEN label = 5 THEN raw[1:8] ELSE raw END AS v FROM r WHERE label <> 3) GROUP BY label)"""

ORACLES = {
    "q60_scan_dataset": f"WITH {_MSGS} SELECT idx, len(cm) AS n_chosen, len(rm) AS n_rejected, cm[1].role AS first_role FROM pm WHERE idx < 25",
    "q61_scan_shards": f"WITH {_S} SELECT vec_id AS idx, {_r('gnorm')} AS gnorm, {_r('raw[1]')} AS head, CASE WHEN vec_id < 5 THEN 2 ELSE 1 END AS n FROM r",
    "q62_cluster_runs": "SELECT n_clusters, label % n_clusters AS cluster, count(*) AS n FROM embeddings, (VALUES (10), (5)) t(n_clusters) GROUP BY 1, 2",
    "q63_exact_norms": f"WITH {_S} SELECT vec_id AS idx, {_r('gnorm')} AS gnorm FROM r",
    "q64_centroid_scan": f"WITH {_S}, {_CM}, {_CU} SELECT 'mean' AS kind, label AS k, n AS n_averaged, {_r(_norm('c'))} AS norm, {_r('c[1]')} AS head FROM cm UNION ALL SELECT 'meannorm', label, n, {_r(_norm('c'))}, {_r('c[1]')} FROM cu",
    "q65_token_products": f"""WITH {_S}, {_CM}, {_ALL}, d AS (SELECT 'k' || lpad(label::VARCHAR, 2, '0') AS direction, c FROM cm UNION ALL SELECT 'aggregated', c FROM al)
        SELECT idx, t, direction, {_r('list_dot_product(raw, c)')} AS dot, {_r(f"list_dot_product(raw, c) / (greatest({_norm('raw')}, 1e-12) * greatest({_norm('c')}, 1e-12))")} AS cos FROM r, d""",
    "q66_scalar_norms": f"WITH {_S}, {_ALL} SELECT 'aggregated' AS direction, {_r(_norm('c'))} AS norm FROM al UNION ALL SELECT 'single', {_r('avg(' + _norm('raw') + ')')} FROM r UNION ALL SELECT 'largest', {_r('max(' + _norm('raw') + ')')} FROM r",
    "q67_complete_examples": f"WITH {_S} SELECT printf('example_%05d', idx) AS name, count(*) AS products FROM s WHERE idx % 7 <> 3 AND idx % 5 <> 0 GROUP BY idx ORDER BY 1 LIMIT 20",
    "q68_length_mismatch": f"WITH {_S} SELECT DISTINCT idx, idx % 4 <> 0 AS kept FROM s",
    "q69_frozen_subset": f"SELECT vec_id AS idx, label FROM embeddings WHERE {_hash('vec_id', 'frozen')} % 3 = 0",
    "q70_versions": f"""WITH {_S} SELECT 'version 1' AS what, count(*) AS n, {_r('sum(gnorm)')} AS total FROM s UNION ALL SELECT 'version 2', count(*), {_r('sum(gnorm)')} FROM s WHERE vec_id >= 100
        UNION ALL SELECT 'train 1', 1, {_r('avg(gnorm)')} FROM s UNION ALL SELECT 'eval 2', 1, {_r('2 * avg(gnorm)')} FROM s""",
    "q71_html_report": f"WITH {_S} SELECT '</script><b>' || label AS name, count(*) AS n, {_r('quantile_cont(gnorm, 0.5)')} AS median_norm, true AS escaped FROM s GROUP BY label",
    "q72_display_texts": f"""WITH {_MSGS} SELECT idx, substr(list_filter(cm, lambda m: m.role = 'user')[-1].content, 1, 1200) AS prompt, substr(cm[-1].content, 1, 1200) AS chosen, substr(rm[-1].content, 1, 1200) AS rejected FROM pm""",
    "q73_key_difference": f"""WITH {_S}, {_FINGER} SELECT name, CASE WHEN b.numel IS NULL THEN 'missing' WHEN a.numel IS NULL THEN 'extra' WHEN a.numel <> b.numel THEN 'shape'
        WHEN abs(b.sm - a.sm) <= 1e-3 + 1e-4 * abs(a.sm) AND abs(b.sq - a.sq) <= 1e-3 + 1e-4 * abs(a.sq) THEN 'ok' ELSE 'values' END AS status,
        CASE WHEN b.numel IS NULL THEN 'first' WHEN a.numel IS NULL THEN 'second' END AS only_in FROM fa a FULL JOIN fb b USING (name)""",
    "q74_establish": f"""WITH {_S}, a AS ({_PRINT} r GROUP BY label), b AS ({_PRINT} (SELECT label, CASE WHEN label IN (2, 4) THEN list_transform(raw, lambda x: x * -1.01::DOUBLE) ELSE raw END AS raw FROM r) GROUP BY label)
        SELECT 'drifted' AS run, name, 'values' AS status FROM a JOIN b USING (name) WHERE NOT (abs(b.sm - a.sm) <= 1e-3 + 1e-4 * abs(a.sm) AND abs(b.sq - a.sq) <= 1e-3 + 1e-4 * abs(a.sq))""",
    "q75_sources": "SELECT source_id::VARCHAR AS source_id, count(*) AS tables FROM (SELECT DISTINCT n, label % n AS source_id FROM embeddings, (VALUES (1), (2), (3)) t(n)) GROUP BY 1",
    "q76_stream_resume": f"SELECT event_type, count(*) AS n, {_r('sum(value * 2)')} AS total FROM events GROUP BY event_type",
    "q77_accumulate": f"WITH {_S}, {_CU} SELECT label AS k, n, i - 1 AS i, {_r('m')} AS value FROM cu_a",
    "q78_run_names": _union([f"SELECT {k}::BIGINT AS i, '{n}' AS name, '{m}' AS method" for k, (n, m) in enumerate([("dpo", "sigmoid_dot"), ("dpo_direction-maxclu_mean_K8", "sigmoid_dot"), ("dpo_method-altcos_seed-7", "altcos"), ("dpo_sum_mode-ignore_dot_scale-unit_beta-0.05", "sigmoid_dot")])]),
}
