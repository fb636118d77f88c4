"""DuckDB SQL with the rows of :mod:`quillon.plans.method_queries`."""

from __future__ import annotations

from quillon.functions import weights
from quillon.operators import directions
from quillon.plans.oracles import _ALL, _CM, _CU, _D, _FORMULAS, _LAB, _LOGITS, _PAIRS, _S, _SIG, _SINGLE, _SKETCH, _cos, _hash, _ls, _lse, _norm, _pair_rows, _r, _sg, _union

_TW = f"""{_LOGITS}, tw AS (SELECT r.*, 1.0::DOUBLE AS w0, 1 / (2 * (1 - least(exp(logp), 1 - 1e-6))) AS w1,
    1 / sqrt(greatest(1 - 2 * least(exp(logp), 1 - 1e-6) + exp({_lse('tl.z', '2')} - 2 * {_lse('tl.z')}), 1e-12)) AS w2 FROM r JOIN tl USING (vec_id)),
tx AS (SELECT idx, unnest(u) AS x, generate_subscripts(u, 1) AS i, w0, w1, w2 FROM tw),
ta AS (SELECT i, avg(w0 * x) AS m0, avg(w1 * x) AS m1, avg(w2 * x) AS m2, count(*) AS n FROM tx GROUP BY i),
tm AS (SELECT list(m0 ORDER BY i) AS g0, list(m1 ORDER BY i) AS g1, list(m2 ORDER BY i) AS g2 FROM ta),
ti AS (SELECT idx, i, avg(w0 * x) AS m0, avg(w1 * x) AS m1, avg(w2 * x) AS m2 FROM tx GROUP BY idx, i),
tq AS (SELECT idx, list(m0 ORDER BY i) AS o0, list(m1 ORDER BY i) AS o1, list(m2 ORDER BY i) AS o2 FROM ti GROUP BY idx)"""


def _best(name: str, cte: str) -> str:
    return f"""{name} AS (SELECT idx, t, max(list_dot_product(raw, c) / greatest({_norm('c')}, 1e-12)) AS dot, max({_cos('raw', 'c')}) AS cos FROM r, {cte} GROUP BY idx, t)"""


_NAMED = {
    "single_weighted_norm1": f"SELECT idx, t, list_dot_product(raw, o1) AS dot, {_cos('raw', 'o1')} AS cos FROM r JOIN tq USING (idx)",
    "aggregated_weighted_norm2": f"SELECT idx, t, list_dot_product(raw, g2) AS dot, {_cos('raw', 'g2')} AS cos FROM r, tm",
    "max_weighted_norm1": f"SELECT idx, t, greatest(list_dot_product(raw, o1), list_dot_product(raw, g1)) AS dot, greatest({_cos('raw', 'o1')}, {_cos('raw', 'g1')}) AS cos FROM r JOIN tq USING (idx), tm",
    "clusteronly_mean_K10": "SELECT idx, t, dot, cos FROM bm",
    "maxclu_meannorm_K10": f"SELECT r.idx, r.t, greatest(bu.dot, list_dot_product(raw, o0)) AS dot, greatest(bu.cos, {_cos('raw', 'o0')}) AS cos FROM r JOIN tq USING (idx) JOIN bu ON bu.idx = r.idx AND bu.t = r.t",
}
_MAPS = {"reverse_kl": "{}", "forward_kl": "-exp(-{})", "js_divergence": None, "alpha_divergence": "exp(least(-0.5::DOUBLE * {}, 80)) / -0.5::DOUBLE"}


def _scores(kind: str) -> tuple[str, str]:
    return tuple(_ls(x) if kind == "js_divergence" else "(" + _MAPS[kind].format(x) + ")" for x in ("cs", "rs"))


def _ratio_loss(name: str, kind: str) -> str:
    if name == "apo_zero":
        return f"1 - {_sg('0.1::DOUBLE * cs')} + {_sg('0.1::DOUBLE * rs')}"
    c, r = _scores(kind)
    return f"{_sg('0.1::DOUBLE * cs')} + 1 - {_sg(f'0.1::DOUBLE * ({c} - {r})')}"


_PATTERN = "(clusteronly|maxclu)_(mean|meannorm)_K([0-9]+)"
_ALL_NAMES = [*directions.BASES, *(f"{p}_{kind}_K{k}" for p in ("clusteronly", "maxclu") for kind in ("mean", "meannorm") for k in (2, 8))]
_SHARES = (0.001, 0.1, 0.25, 0.5, 0.75, 0.9, 0.999)


def _uniform(x: str, tag: str) -> str:
    return f"({_hash(x, tag)} / 4294967296.0::DOUBLE)"


def _plus_plus(k: int) -> str:
    ctes = [f"p0 AS (SELECT 0 AS rank, vec_id, u FROM s ORDER BY {_uniform('vec_id', 'first0')}, vec_id LIMIT 1)"]
    for j in range(1, k):
        found = _union([f"SELECT u AS c FROM p{i}" for i in range(j)])
        ctes.append(f"""d{j} AS (SELECT vec_id, u, max({_cos('u', 'c')}) AS cos FROM s, ({found}) GROUP BY vec_id, u),
        p{j} AS (SELECT {j} AS rank, vec_id, u FROM d{j} ORDER BY -ln(1 - {_uniform('vec_id', f'pick0:{j}')}) / greatest(pow(greatest(0.0::DOUBLE, 1 - cos), 2.0::DOUBLE), 1e-300), vec_id LIMIT 1)""")
    return f"WITH {_S}, {', '.join(ctes)} " + _union([f"SELECT rank, vec_id FROM p{j}" for j in range(k)])


_STARTS = _union([
    f"SELECT {k} AS K, {r} AS restart, avg(cos) AS objective FROM (SELECT vec_id, max({_cos('s.u', 'c.u')}) AS cos FROM s, (SELECT u FROM o WHERE rn BETWEEN {r * k} AND {r * k + k - 1}) c GROUP BY vec_id)" for k in (2, 4) for r in range(3)
])

ORACLES = {
    "q80_pad_batches": r"""WITH c AS (SELECT conv_id, list_transform(list_filter(flatten(list(regexp_split_to_array(text, '\s+') ORDER BY turn)), lambda w: w <> ''), lambda w: length(w)) AS ids FROM conversations GROUP BY conv_id),
        b AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 4 AS batch FROM c), w AS (SELECT *, max(len(ids)) OVER (PARTITION BY batch) AS width FROM b)
        SELECT conv_id, batch, width, list_sum(ids)::BIGINT AS sum, len(ids) AS n, width - len(ids) AS pad FROM w""",
    "q81_place_weights": f"""WITH {_S}, {_SINGLE}, w AS (SELECT idx, list({_SIG} ORDER BY t) AS w FROM si GROUP BY idx), i AS (SELECT idx, w, unnest(range(8 + idx % 9)) AS i FROM w)
        SELECT idx, i, {_r('CASE WHEN i >= idx % 5 AND i < idx % 5 + len(w) THEN w[i - idx % 5 + 1] ELSE 0 END')} AS w FROM i""",
    "q82_resolve_names": f"""WITH n AS (SELECT unnest([{', '.join(f"'{x}'" for x in _ALL_NAMES)}]) AS name), p AS (SELECT name, nullif(regexp_extract(name, '{_PATTERN}', 1), '') AS f, regexp_extract(name, '{_PATTERN}', 2) AS kd, regexp_extract(name, '{_PATTERN}', 3) AS k FROM n),
        b AS (SELECT name, coalesce(f, split_part(name, '_', 1)) AS family, nullif(kd, '') AS kind, nullif(k, '')::INT AS K,
            CASE WHEN f = 'maxclu' THEN 'single_unweighted' WHEN f IS NOT NULL THEN '' WHEN name LIKE 'max%' THEN 'single' || substr(name, 4) || ',aggregated' || substr(name, 4) ELSE name END AS bases FROM p)
        SELECT *, bases IN ('', 'single_unweighted', 'aggregated_unweighted', 'single_unweighted,aggregated_unweighted') AS ready FROM b""",
    "q83_weighted_means": f"WITH {_S}, {_TW} " + _union([f"SELECT n AS n_averaged, '{w}' AS weighting, i - 1 AS i, {_r(f'm{k}')} AS value FROM ta" for k, w in enumerate(("unweighted", "weighted_norm1", "weighted_norm2"))]),
    "q84_direction_scores": f"""WITH {_S}, {_TW}, {_CM}, {_CU}, {_best('bm', 'cm')}, {_best('bu', 'cu')}, a AS ({_union([f"SELECT '{n}' AS direction, * FROM ({q})" for n, q in _NAMED.items()])})
        SELECT direction, idx, t, {_r('dot')} AS dot, {_r('cos')} AS cos, {_r('dot / greatest(max(abs(dot)) OVER (PARTITION BY direction, idx), 1e-12)')} AS pn FROM a""",
    "q85_batch_metrics": f"""WITH {_S}, {_LOGITS} SELECT {_r(f"avg({_lse('z')} - list_sum(list_transform(z, lambda x: exp(x - {_lse('z')}) * x)))")} AS entropy, {_r('avg(list_avg(z)) FILTER (side = $$c$$)')} AS logits_chosen,
        {_r('avg(list_avg(z)) FILTER (side = $$r$$)')} AS logits_rejected, {_r('avg((list_position(z, list_max(z)) - 1 = label)::INT) FILTER (side = $$c$$)')} AS mean_token_accuracy FROM tl WHERE done""",
    "q86_ratio_losses": f"WITH {_S}, {_PAIRS} " + _union([f"SELECT pair_id, '{n}' AS loss, '{d}' AS divergence, {_r(f'({_ratio_loss(n, d)})::DOUBLE')} AS value FROM p" for n in ("apo_zero", "apo_down") for d in _MAPS]),
    "q87_prospect_loss": f"""WITH {_S}, {_LOGITS}, q AS (SELECT pair_id, side, sum((logp - ref) * done::INT) AS x FROM tl GROUP BY pair_id, side), k AS (SELECT greatest(avg(x), 0) AS kl FROM q)
        SELECT pair_id, side, {_r(f"CASE WHEN side = 'c' THEN 1 - {_sg('0.1::DOUBLE * (x - kl)')} ELSE 0.5::DOUBLE * (1 - {_sg('0.1::DOUBLE * (kl - x)')}) END")} AS loss FROM q, k""",
    "q88_blocks": f"""WITH {_S}, b(name, "offset", numel) AS (VALUES ('a', 0, 10), ('b', 10, 20), ('c', 30, 30), ('d', 60, 4)), f AS (SELECT vec_id, list_transform(raw, lambda x, i: CASE WHEN vec_id % 3 = 0 AND i BETWEEN 11 AND 30 THEN 0.0::DOUBLE ELSE x END) AS v FROM r)
        SELECT vec_id, name, "offset", numel, {_r('list_sum(v["offset" + 1:"offset" + numel])')} AS total, {_r(_norm('v'))} AS length FROM f, b""",
    "q89_shift_and_last": f"""WITH {_S}, m AS (SELECT idx, t, label, t >= 2 AND t < 10 - idx % 3 AND idx % 8 <> 5 AS on_ FROM s), g AS (SELECT idx, count(*) AS n, max(t) FILTER (on_) AS last, coalesce(sum(label + 1) FILTER (on_ AND t > 0), 0)::BIGINT AS label_sum, max(t) FILTER (on_ AND t > 0) AS l1 FROM m GROUP BY idx)
        SELECT idx, n - 1 AS n, coalesce(last, n - 1) AS last, coalesce(l1 - 1, n - 2) AS last_shifted, label_sum FROM g""",
    "q90_zip": f"WITH {_S} SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, vec_id, {_r('gnorm')} AS gnorm FROM s",
    "q91_centroid_pairs": f"""WITH {_S}, {_CM}, cx AS (SELECT label, unnest(c) AS x, generate_subscripts(c, 1) - 1 AS i FROM cm), h AS (SELECT i, {_hash('i', 'b')} % 16 AS b, 2 * ({_hash('i', 's')} % 2) - 1 AS sg FROM range(64) t(i)),
        k AS (SELECT cx.label, g.b, coalesce(sum(h.sg * cx.x) FILTER (h.b = g.b), 0)::DOUBLE AS y FROM cx JOIN h USING (i) CROSS JOIN range(16) g(b) GROUP BY cx.label, g.b), l AS (SELECT label, list(y ORDER BY b) AS sk FROM k GROUP BY label), w AS (SELECT cm.label, c, sk FROM cm JOIN l USING (label))
        SELECT a.label AS i, b.label AS j, {_r(_cos('a.c', 'b.c'))} AS cos_center, {_r(_cos('a.sk', 'b.sk'))} AS cos_sketch FROM w a JOIN w b ON a.label < b.label""",
    "q92_mean_cosines": f"""WITH {_S}, v AS (SELECT vec_id, list_transform(raw, lambda y: y / {_norm('raw')}) AS v FROM r), x AS (SELECT unnest(v) AS x, generate_subscripts(v, 1) AS i FROM v), m AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM x GROUP BY i))
        SELECT {_r(f"avg(list_dot_product(v, c) / {_norm('c')})")} AS mean_dir_mean, {_r(f"min(list_dot_product(v, c) / {_norm('c')})")} AS mean_dir_min FROM v, m""",
    "q93_centered": f"""WITH {_S}, x AS (SELECT vec_id, unnest(raw) AS x, generate_subscripts(raw, 1) AS i FROM r), d AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY i) AS x FROM x)
        SELECT vec_id, i - 1 AS i, {_r('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY vec_id)), 1e-12)')} AS value FROM d""",
    "q94_block_plan": "SELECT k AS chunk, k * 4194304 AS \"offset\", least(4194304, 159907840 - k * 4194304) AS length, 7 * 1000003 + k AS seed FROM range(39) t(k)",
    "q95_dense_projections": f"""WITH {_S}, e AS (SELECT id, id // 64 AS b, id % 64 AS i, 2.0::DOUBLE * ({_hash('id', 's', 1)} % 2) - 1 AS sg, sqrt(-2 * ln(1 - {_hash('id', 'u', 1)} / 4294967296.0::DOUBLE)) * cos(2 * pi() * ({_hash('id', 'v', 1)} / 4294967296.0::DOUBLE)) AS g FROM range(512) t(id)),
        x AS (SELECT vec_id, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i FROM r), y AS (SELECT vec_id, b, sum(sg * x) / sqrt(8) AS a, sum(g * x) / sqrt(8) AS c FROM x JOIN e USING (i) GROUP BY vec_id, b)
        SELECT 'rademacher' AS method, vec_id, b, {_r('a')} AS value FROM y UNION ALL SELECT 'gaussian', vec_id, b, {_r('c')} FROM y""",
    "q96_sketch_self_test": f"""WITH {_S}, {_SKETCH}, sl AS (SELECT vec_id, list(y ORDER BY b) AS sk FROM sk GROUP BY vec_id), p AS (SELECT q.*, sl.sk FROM {_pair_rows('pair', 400)} q JOIN sl USING (vec_id)),
        c AS (SELECT abs(list_dot_product(a.sk, b.sk) - list_dot_product(a.raw, b.raw)) / ({_norm('a.raw')} * {_norm('b.raw')}) AS e FROM p a JOIN p b ON a.rn % 2 = 0 AND b.rn = a.rn + 1)
        SELECT count(*) AS n, {_r('avg(e)')} AS mean_error, {_r('max(e)')} AS max_error, 0.0::DOUBLE AS norm_error, 0.25::DOUBLE AS bound FROM c""",
    "q97_weight_methods": f"WITH {_S}, {_SINGLE} " + _union([
        f"SELECT idx, t, '{m}' AS method, {_r(f'({_FORMULAS[f]})::DOUBLE')} AS w FROM si" if n == "none" else
        f"SELECT idx, t, '{m}' AS method, {_r('e / sum(e) OVER (PARTITION BY idx)')} AS w FROM (SELECT idx, t, exp(({_FORMULAS[f]} - max({_FORMULAS[f]}) OVER (PARTITION BY idx)) / 0.1::DOUBLE) AS e FROM si)" for m, (f, n) in weights.METHODS.items()
    ]),
    "q98_reseeded_step": f"""WITH {_S}, f AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, u AS c FROM (SELECT * FROM s ORDER BY vec_id LIMIT 3)), c0 AS (SELECT * FROM f UNION ALL SELECT 3, c FROM f WHERE k = 0),
        a AS (SELECT vec_id, u, k, cos FROM (SELECT vec_id, u, k, {_cos('u', 'c')} AS cos FROM s, f) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, k) = 1),
        x AS (SELECT k, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM a), m AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM x GROUP BY k, i) GROUP BY k UNION ALL SELECT * FROM (SELECT 3, u FROM a ORDER BY cos, vec_id LIMIT 1)),
        n AS (SELECT k, list_transform(c, lambda y: y / {_norm('c')}) AS c FROM m) SELECT k, (SELECT {_r('avg(cos)')} FROM a) AS objective, generate_subscripts(c, 1) - 1 AS i, unnest(list_transform(c, lambda y: {_r('y')})) AS value FROM n""",
    "q99_plus_plus": _plus_plus(5),
    "q100_inverse_cdf": f"""WITH {_S}, c AS (SELECT vec_id, sum(gnorm) OVER (ORDER BY vec_id) AS after, sum(gnorm) OVER () AS total, gnorm FROM s), u AS (SELECT unnest([{', '.join(f'{x}::DOUBLE' for x in _SHARES)}]) AS u)
        SELECT vec_id, {_r('u')} AS u FROM c, u WHERE u * total > after - gnorm AND u * total <= after""",
    "q101_best_restarts": f"WITH {_S}, o AS (SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM s), q AS ({_STARTS}) SELECT K, restart, {_r('objective')} AS objective FROM q QUALIFY row_number() OVER (PARTITION BY K ORDER BY objective DESC, restart) = 1",
    "q102_sorted_ids": f"""WITH {_S}, {_LAB}, i AS (SELECT vec_id FROM lb QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) <= 3 UNION SELECT vec_id FROM lb QUALIFY row_number() OVER (PARTITION BY label ORDER BY {_hash('vec_id', 'sample', 1234)}, vec_id) <= 5)
        SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS rank FROM i""",
    "q103_upstream_filter": "SELECT doc_id, length(text) AS n FROM documents WHERE lang = 'en' AND length(text) <= 8000",
    "q104_round_half_even": "SELECT vec_id, round_even(vec_id + 0.5::DOUBLE, 0) AS whole, round_even(vec_id / 8.0::DOUBLE, 2) AS hundredths FROM embeddings",
    "q105_throughput": f"""WITH e AS (SELECT count(*) AS n, sum(value) AS s FROM events) SELECT n AS rows, {_r('s')} AS seconds, {_r('s / n')} AS seconds_a_row, {_r('n / s')} AS rows_a_second,
        {_r('s / n * 210000 / 3600')} AS hours, {_r('s / n * 210000 / 3600 / 8')} AS hours_by_shards FROM e""",
    "q106_inspection_bundle": f"""WITH {_S}, {_LAB}, z AS (SELECT label, ln(gnorm) AS x FROM s), g AS (SELECT avg(x) AS grand FROM z), kk AS (SELECT count(*) AS n, avg(x) AS m FROM z GROUP BY label),
        et AS (SELECT (SELECT sum(n * pow(m - grand, 2.0::DOUBLE)) FROM kk, g) / sum(pow(x - grand, 2.0::DOUBLE)) AS eta FROM z, g),
        nn AS (SELECT label, other, cos FROM (SELECT a.label, b.label AS other, {_cos('a.c', 'b.c')} AS cos FROM cu a JOIN cu b ON a.label <> b.label) QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos DESC, other) = 1),
        md AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS rk FROM lb), sm AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY {_hash('vec_id', 'sample', 1234)}, vec_id) AS rk FROM md WHERE rk > 3)
        SELECT s.label, count(*) AS n, {_r('count(*)::DOUBLE / (SELECT count(*) FROM s)')} AS share, {_r('quantile_cont(gnorm, 0.5)')} AS median_size, {_r('(SELECT eta FROM et)')} AS eta_log_size, any_value(nn.other) AS other, {_r('any_value(nn.cos)')} AS cos,
            (SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY rk) FROM md WHERE md.label = s.label AND rk <= 3) AS medoids, (SELECT string_agg(vec_id::VARCHAR, ',' ORDER BY rk) FROM sm WHERE sm.label = s.label AND rk <= 3) AS others FROM s LEFT JOIN nn ON nn.label = s.label GROUP BY s.label""",
}
