"""DuckDB SQL with the rows of the queries of long vectors and of what a clustering means.

A long vector is a short one times a fixed matrix with one entry a column, so inner products and components of long vectors
are those of 64 coordinates, each times the root of its column's squares; the SQL works on these.
"""

from __future__ import annotations

from quillon.operators.inspection import STOPWORDS
from quillon.plans.method_oracles import _TW
from quillon.plans.oracles import _CU, _LAB, _OWN, _S, _compare, _cos, _hash, _norm, _r

_FACTOR = "pow(0.85::DOUBLE, j % 64) * (1 + (j * 31 % 97) / 97.0::DOUBLE)"


def _wide(n: int = 128) -> str:
    """y: for each vector the 64 coordinates whose inner products are those of the long vectors; ms: the columns' squares."""
    return f"""ms AS (SELECT j % 64 AS i, sum(pow({_FACTOR}, 2.0::DOUBLE)) AS m FROM range({n}) t(j) GROUP BY 1),
ml AS (SELECT list(sqrt(m) ORDER BY i) AS ml FROM ms),
y AS (SELECT vec_id, label, gnorm, raw, list_transform(raw, lambda x, k: x * ml[k]) AS y FROM r, ml)"""


def _moments(source: str, v: str) -> str:
    """mt: the covariance matrix of *v* as a list of rows, its trace, and the mean."""
    return f"""cx AS (SELECT vec_id, unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM {source}),
cc AS (SELECT a.i, b.i AS j, covar_samp(a.x, b.x) AS c FROM cx a JOIN cx b USING (vec_id) GROUP BY a.i, b.i),
mt AS (SELECT list(row ORDER BY i) AS mat FROM (SELECT i, list(c ORDER BY j) AS row FROM cc GROUP BY i)),
tr AS (SELECT sum(c) AS trace FROM cc WHERE i = j),
mu AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM cx GROUP BY i))"""


def _leading(n: int, steps: int = 400) -> str:
    """e1, e2, ...: leading unit eigenvectors v with their values lam, by the power method and deflation."""
    out, mat = [], "mt"
    for k in range(1, n + 1):
        out.append(f"""p{k} AS (SELECT 0 AS t, list_transform(range(64), lambda q: 1.0::DOUBLE / (1 + (q * 7 + {k}) % 11)) AS v UNION ALL
    SELECT t + 1, list_transform(w, lambda z: z / {_norm('w')}) FROM (SELECT t, list_transform(mat, lambda row: list_dot_product(row, v)) AS w FROM p{k}, {mat} WHERE t < {steps})),
e{k} AS (SELECT v, list_dot_product(v, list_transform(mat, lambda row: list_dot_product(row, v))) AS lam FROM p{k}, {mat} WHERE t = {steps}),
d{k} AS (SELECT list_transform(mat, lambda row, a: list_transform(row, lambda z, b: z - lam * v[a] * v[b])) AS mat FROM {mat}, e{k})""")
        mat = f"d{k}"
    return ",\n".join(out)


_PROBS = (0.01, 0.25, 0.5, 0.75, 0.99)
_H0 = "(j + 7000021) & 4294967295"
_H1 = f"(xor({_H0}, ({_H0}) >> 16) * 2146121005) & 4294967295"
_TERM = "[a-z][a-z'']+"


def _eta(x: str, source: str) -> str:
    return f"""(SELECT coalesce(sum(n * pow(m - g, 2.0::DOUBLE)) / any_value(t), 0.0::DOUBLE) FROM (SELECT label, count(*) AS n, avg({x}) AS m FROM {source} GROUP BY label),
        (SELECT avg({x}) AS g FROM {source}), (SELECT nullif(sum(pow({x} - (SELECT avg({x}) FROM {source}), 2.0::DOUBLE)), 0) AS t FROM {source}))"""


def _shown(source: str) -> str:
    return f"""(SELECT string_agg({source}.vec_id || ':' || coalesce(length(chosen)::VARCHAR, '-') || ':' || coalesce(length(rejected)::VARCHAR, '-') || ':' || md5(concat_ws('|', left(prompt, 1200), left(chosen, 1200), left(rejected, 1200))), ',' ORDER BY rk)
        FROM {source} LEFT JOIN tx USING (vec_id) WHERE {source}.label = s.label AND rk <= 10)"""


ORACLES: dict[str, str] = {
    "q108_structure_diagnostic": f"""WITH RECURSIVE {_S}, {_wide()}, v AS (SELECT vec_id, list_transform(y, lambda z: z / {_norm('y')}) AS v FROM y), k AS (SELECT v, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM v), n AS (SELECT count(*) AS n FROM v),
        pd AS (SELECT floor({_hash('p', 'i0')} / 4294967296.0::DOUBLE * n)::BIGINT AS i, floor({_hash('p', 'j0')} / 4294967296.0::DOUBLE * n)::BIGINT AS j FROM range(200000) t(p), n),
        cs AS (SELECT {_cos('a.v', 'b.v')} AS cos FROM pd JOIN k a ON a.rn = i JOIN k b ON b.rn = j WHERE i <> j), {_moments('v', 'v')}, {_leading(4)}
        SELECT {_r('avg(cos)')} AS mean_cos, {_r('stddev_samp(cos)')} AS std_cos, {', '.join(f"{_r(f'quantile_cont(cos, {q})')} AS q{k}" for k, q in enumerate(_PROBS))},
            (SELECT {_r(f"avg(list_dot_product(v, mu) / {_norm('mu')})")} FROM v, mu) AS mean_dir_mean, (SELECT {_r(f"min(list_dot_product(v, mu) / {_norm('mu')})")} FROM v, mu) AS mean_dir_min,
            {', '.join(f"(SELECT {_r('lam / trace')} FROM e{k}, tr) AS share{k}" for k in range(1, 5))}, (SELECT {_r('(e1.lam + e2.lam + e3.lam + e4.lam) / trace')} FROM e1, e2, e3, e4, tr) AS pc_cumulative,
            CASE WHEN avg(cos) > 0.5 AND (SELECT lam / trace FROM e1, tr) > 0.5 THEN 'CENTER' ELSE 'AS IS' END AS advice FROM cs""",
    "q109_principal_points": f"""WITH RECURSIVE {_S}, {_wide()}, {_moments('y', 'y')}, {_leading(2)},
        q AS (SELECT vec_id, label, list_dot_product(list_transform(y, lambda z, k: z - mu[k]), e1.v) AS a, list_dot_product(list_transform(y, lambda z, k: z - mu[k]), e2.v) AS b FROM y, mu, e1, e2),
        g AS (SELECT sign(a) AS ga, sign(b) AS gb FROM q ORDER BY vec_id LIMIT 1)
        SELECT vec_id, label, {_r('a * ga')} AS pc1, {_r('b * gb')} AS pc2, (SELECT {_r('lam / trace')} FROM e1, tr) AS share1, (SELECT {_r('lam / trace')} FROM e2, tr) AS share2 FROM q, g""",
    "q110_block_means": f"""WITH {_S}, x AS (SELECT label, gnorm, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i FROM r), m AS (SELECT label, i, count(*) AS n, avg(x) AS plain, avg(gnorm * x) AS by_norm FROM x GROUP BY label, i),
        w AS (SELECT label, n, i, 'plain' AS weighting, plain AS m FROM m UNION ALL SELECT label, n, i, 'by_norm', by_norm FROM m), c AS (SELECT j, j % 64 AS i, {_FACTOR} AS f FROM range(2048) t(j))
        SELECT label, j // 512 * 512 AS "offset", any_value(n) AS n, weighting, count(*)::INT AS numel, {_r('sum(m * f)')} AS total, {_r('sum(pow(m * f, 2.0::DOUBLE))')} AS squares, {_r('min_by(m * f, j)')} AS first FROM w JOIN c USING (i) GROUP BY label, weighting, j // 512""",
    "q111_wide_centroids": f"""WITH {_S}, {_wide(320)}, x AS (SELECT label, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i, {_norm('y')} AS size FROM y), m AS (SELECT label, i, count(*) AS n, avg(x) AS a, avg(x / size) AS b FROM x GROUP BY label, i),
        c AS (SELECT j, j % 64 AS i, {_FACTOR} AS f FROM range(320) t(j)) SELECT 'mean' AS kind, label, n AS n_averaged, j AS i, {_r('a * f')} AS value FROM m JOIN c USING (i) UNION ALL SELECT 'meannorm', label, n, j, {_r('b * f')} FROM m JOIN c USING (i)""",
    "q112_block_sketch": f"""WITH {_S}, h0 AS (SELECT j, {_H1} AS h FROM range(2048) t(j)), h1 AS (SELECT j, (xor(h, h >> 15) * 1540483477) & 4294967295 AS h FROM h0), h AS (SELECT j, xor(h, h >> 15) AS h FROM h1),
        c AS (SELECT h % 64 AS b, j % 64 AS i, sum((CASE WHEN h >> 31 = 1 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * {_FACTOR}) AS f FROM h GROUP BY 1, 2), q AS (SELECT j % 64 AS i, sum(pow({_FACTOR}, 2.0::DOUBLE)) AS m FROM range(2048) t(j) GROUP BY 1),
        x AS (SELECT vec_id, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i FROM r), z AS (SELECT vec_id, b, sum(x * f) AS value FROM x JOIN c USING (i) GROUP BY vec_id, b), n AS (SELECT vec_id, sqrt(sum(x * x * m)) AS size FROM x JOIN q USING (i) GROUP BY vec_id)
        SELECT vec_id, 4 AS n_blocks, {_r('size')} AS sketch_norm, g.b, {_r('coalesce(value, 0)')} AS value FROM n CROSS JOIN range(64) g(b) LEFT JOIN z USING (vec_id, b)""",
    "q113_inspection_report": f"""WITH {_S}, {_LAB}, tx AS (SELECT doc_id AS vec_id, left(text, length(text) // 4) AS prompt, substr(text, length(text) // 4 + 1) AS chosen, left(text, length(text) // 2) AS rejected FROM documents WHERE text IS NOT NULL),
        l AS (SELECT label, ln(greatest(length(chosen), 1)::DOUBLE) AS lc, ln(greatest(gnorm, 1)::DOUBLE) AS lg, ln(greatest(length(prompt), 1)::DOUBLE) AS lp, length(chosen) AS n_chosen FROM s JOIN tx USING (vec_id)),
        w AS (SELECT label, unnest(regexp_extract_all(lower(chosen), '{_TERM}')) AS term FROM s JOIN tx USING (vec_id)), c AS (SELECT label, term, count(*) AS c FROM w WHERE length(term) > 2 AND term NOT IN ({', '.join(f"'{x}'" for x in STOPWORDS)}) GROUP BY label, term),
        t AS (SELECT term, sum(c) AS tot FROM c GROUP BY term), kk AS (SELECT label, sum(c) AS n_k FROM c GROUP BY label), a AS (SELECT count(*) AS v, sum(tot) AS n_all FROM t),
        o AS (SELECT label, term, c, ln(((c + 1)::DOUBLE / (n_k + v)::DOUBLE) / ((tot + 1)::DOUBLE / (n_all + v)::DOUBLE)) AS logodds FROM c JOIN t USING (term) JOIN kk USING (label), a WHERE c >= 15),
        tt AS (SELECT label, term, c, row_number() OVER (PARTITION BY label ORDER BY logodds DESC, term DESC, c DESC) AS rank FROM o),
        nn AS (SELECT label, other, cos FROM (SELECT a.label, b.label AS other, {_cos('a.c', 'b.c')} AS cos FROM cu a JOIN cu b ON a.label <> b.label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos DESC, other) = 1),
        md AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS rk FROM lb), sm AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash('vec_id', 'sample', 1234)}, vec_id) AS rk FROM md WHERE rk > 10)
        SELECT s.label, count(*) AS n, any_value(nn.other) AS nearest, (SELECT floor(quantile_cont(n_chosen, 0.5))::BIGINT FROM l WHERE l.label = s.label) AS median_chars, {_r('count(*)::DOUBLE / (SELECT count(*) FROM s)')} AS share,
            (SELECT {_r('avg(cos)')} FROM lb WHERE lb.label = s.label) AS cohesion, {_r('any_value(nn.cos)')} AS nearest_cos, {_r('quantile_cont(gnorm, 0.5)')} AS median_size, {_r(_eta('lc', 'l'))} AS eta_log_chosen, {_r(_eta('lg', 'l'))} AS eta_log_size, {_r(_eta('lp', 'l'))} AS eta_log_prompt,
            coalesce((SELECT string_agg(term || ':' || c, ',' ORDER BY rank) FROM tt WHERE tt.label = s.label AND rank <= 12), '') AS terms, {_shown('md')} AS medoids, {_shown('sm')} AS others FROM s LEFT JOIN nn ON nn.label = s.label GROUP BY s.label""",
    "q114_provenance_guard": f"""WITH {_S}, h AS (SELECT count(*) AS rows_held, {_r('sum(raw[1])')} AS dot_held FROM r WHERE vec_id % 6 IN (3, 5)), g(step, source_id, accepted) AS (VALUES (0, 'full', TRUE), (1, 'full', TRUE), (2, 'sampled', FALSE), (3, 'sampled', TRUE), (4, 'full', FALSE), (5, 'sampled', TRUE))
        SELECT step, source_id, accepted, rows_held, dot_held, 'sampled' AS source_held, 1 AS sources_held FROM g, h""",
    "q115_order_scans": """WITH e AS (SELECT event_id, event_type, user_id, floor(coalesce(value, 0) * 100)::BIGINT AS cents, md5(event_id::VARCHAR) AS name FROM events)
        SELECT event_id, event_type, coalesce(sum(cents) OVER (ORDER BY name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_name, coalesce(sum(cents) OVER (ORDER BY user_id NULLS FIRST, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before_pair,
            row_number() OVER (PARTITION BY event_type ORDER BY cents, event_id) - 1 AS place FROM e""",
    "q116_huge_channel": f"""WITH x AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS i, CASE WHEN l_orderkey % 100 = 0 THEN 'small' ELSE 'huge' END AS channel, l_extendedprice AS ref,
        l_extendedprice * (1 + l_quantity / 10000) AS got FROM lineitem) {_compare('x', 'channel')}""",
    "q119_bucketed_lookups": f"""WITH {_S}, {_OWN}, n AS (SELECT idx, max(gnorm) AS top FROM s GROUP BY idx)
        SELECT idx, t, {_r('list_dot_product(raw, c)')} AS dot, {_r('list_dot_product(raw, c) / greatest(top, 1e-12)')} AS scaled FROM r JOIN own USING (idx) JOIN n USING (idx)""",
    "q118_state_accumulator": f"""WITH {_S}, {_TW}, w AS (SELECT vec_id, label, unnest(u) AS x, generate_subscripts(u, 1) - 1 AS i, w0, w1, w2 FROM tw),
        g AS (SELECT 'went on' AS run, label, i, count(*) AS n, avg(w0 * x) AS m0, avg(w1 * x) AS m1, avg(w2 * x) AS m2 FROM w GROUP BY label, i UNION ALL
            SELECT 'started over', label, i, count(*), avg(w0 * x), avg(w1 * x), avg(w2 * x) FROM w WHERE vec_id % 2 = 0 GROUP BY label, i)
        """ + " UNION ALL ".join(f"SELECT run, label, n, '{w}' AS weighting, i, {_r(f'm{k}')} AS value FROM g" for k, w in enumerate(("unweighted", "weighted_norm1", "weighted_norm2"))),
    "q117_exact_quantiles": f"""WITH l AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem WHERE l_extendedprice IS NOT NULL)
        SELECT 'linear' AS kind, l_returnflag, {', '.join(f"{_r(f'quantile_cont(x, {q})')} AS q{k}" for k, q in enumerate(_PROBS))} FROM l GROUP BY l_returnflag
        UNION ALL SELECT 'lower', l_returnflag, {', '.join(f"{_r(f'min(x) FILTER (rn >= {q}::DOUBLE * n)')} AS q{k}" for k, q in enumerate(_PROBS))} FROM l GROUP BY l_returnflag""",
}
