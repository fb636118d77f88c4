"""DuckDB SQL with the rows of the reference queries."""

from __future__ import annotations

from quillon.operators.inspection import STOPWORDS

_S = """s AS (SELECT vec_id, vec_id // 10 AS idx, vec_id % 10 AS t, label, 1 + (vec_id * 37 % 100) / 10.0::DOUBLE AS gnorm,
    list_transform(embedding, lambda x: x::DOUBLE) AS u FROM embeddings),
r AS (SELECT *, list_transform(u, lambda x: x * gnorm) AS raw FROM s)"""


def _mean(name: str, key: str, v: str) -> str:
    part = f"{key}, " if key else ""
    group = f"GROUP BY {key}" if key else ""
    return f"""{name}_x AS (SELECT {part}unnest({v}) AS x, generate_subscripts({v}, 1) AS i FROM r),
{name}_a AS (SELECT {part}i, avg(x) AS m, count(*) AS n FROM {name}_x GROUP BY {part}i),
{name} AS (SELECT {part}list(m ORDER BY i) AS c, max(n) AS n FROM {name}_a {group})"""


def _norm(v: str) -> str:
    return f"sqrt(list_dot_product({v}, {v}))"


def _r(x: str) -> str:
    return f"round({x}, 6) + 0.0::DOUBLE"


_OWN = _mean("own", "idx", "u")
_ALL = _mean("al", "", "u")
_CM = _mean("cm", "label", "raw")
_CU = _mean("cu", "label", "u")
_SINGLE = f"""{_OWN},
si0 AS (SELECT r.*, list_dot_product(raw, own.c) AS dot, list_dot_product(raw, own.c) / (greatest({_norm('raw')}, 1e-12) * greatest({_norm('own.c')}, 1e-12)) AS cos
    FROM r JOIN own USING (idx)),
si AS (SELECT *, dot / greatest(max(abs(dot)) OVER (PARTITION BY idx), 1e-12) AS pn FROM si0)"""
_CLU = f"""{_CM},
cl AS (SELECT idx, t, max(list_dot_product(raw, c) / greatest({_norm('c')}, 1e-12)) AS dot,
    max(list_dot_product(raw, c) / (greatest({_norm('raw')}, 1e-12) * greatest({_norm('c')}, 1e-12))) AS cos FROM r, cm GROUP BY idx, t)"""
_SIG = "1 / (1 + exp(pn))"


def _lse(z: str, k: str = "1") -> str:
    return f"({k} * list_max({z}) + ln(list_sum(list_transform({z}, lambda x: exp({k} * (x - list_max({z})))))))"


_LOGITS = f"""z AS (SELECT vec_id, idx, t, label, idx // 2 AS pair_id, CASE WHEN idx % 2 = 0 THEN 'c' ELSE 'r' END AS side, t >= 2 AS done,
    list_transform(u[1:16], lambda x: x * 4.0::DOUBLE) AS z, list_transform(u[17:32], lambda x: x * 4.0::DOUBLE) AS rz FROM s),
tl AS (SELECT *, z[label + 1] - {_lse('z')} AS logp, rz[label + 1] - {_lse('rz')} AS ref FROM z)"""
_PAIRS = f"""{_LOGITS},
sq AS (SELECT pair_id, side, sum(logp * done::INT) AS logp, sum(ref * done::INT) AS ref, sum(done::INT)::DOUBLE AS n FROM tl GROUP BY pair_id, side),
pr AS (SELECT pair_id, max(logp) FILTER (side = 'c') AS c_logp, max(ref) FILTER (side = 'c') AS c_ref, max(n) FILTER (side = 'c') AS c_n,
    max(logp) FILTER (side = 'r') AS r_logp, max(ref) FILTER (side = 'r') AS r_ref, max(n) FILTER (side = 'r') AS r_n FROM sq GROUP BY pair_id),
p AS (SELECT *, c_logp - c_ref AS cs, r_logp - r_ref AS rs FROM pr)"""


def _ls(x: str) -> str:
    return f"(-(greatest(-({x}), 0.0::DOUBLE) + ln(1 + exp(-abs({x})))))"


def _sg(x: str) -> str:
    return f"(1 / (1 + exp(-({x}))))"


_CONF = f"""cf0 AS (SELECT pair_id, side, exp(sum(CASE WHEN done THEN logp - ({_lse('z', '2')} - 2 * {_lse('z')}) ELSE 0 END) / greatest(sum(done::INT), 1)) AS c FROM tl GROUP BY pair_id, side),
cf AS (SELECT pair_id, max(c) FILTER (side = 'c') AS cc, max(c) FILTER (side = 'r') AS rc FROM cf0 GROUP BY pair_id)"""
_D = "0.1::DOUBLE * (cs - rs)"
_LOSSES = {
    "sigmoid": f"-{_ls(_D)}",
    "hinge": f"greatest(1 - {_D}, 0.0::DOUBLE)",
    "ipo": "pow(cs / greatest(c_n, 1) - rs / greatest(r_n, 1) - 5.0::DOUBLE, 2.0::DOUBLE)",
    "robust": f"(0.9::DOUBLE * -{_ls(_D)} + 0.1::DOUBLE * {_ls('-' + _D)}) / 0.8::DOUBLE",
    "exo_pair": f"exp({_ls(_D)}) * ({_ls(_D)} - ln(0.9::DOUBLE)) + exp({_ls('-' + _D)}) * ({_ls('-' + _D)} - ln(0.1::DOUBLE))",
    "nca_pair": f"-{_ls('0.1::DOUBLE * cs')} - 0.5::DOUBLE * {_ls('-0.1::DOUBLE * cs')} - 0.5::DOUBLE * {_ls('-0.1::DOUBLE * rs')}",
    "bco_pair": f"-{_ls('0.1::DOUBLE * cs')} - {_ls('-0.1::DOUBLE * rs')}",
    "sppo_hard": "pow(cs - 5.0::DOUBLE, 2.0::DOUBLE) + pow(rs + 5.0::DOUBLE, 2.0::DOUBLE)",
    "apo_zero": f"1 - {_sg('0.1::DOUBLE * cs')} + {_sg('0.1::DOUBLE * rs')}",
    "apo_down": f"{_sg('0.1::DOUBLE * cs')} + 1 - {_sg(_D)}",
    "discopop": f"-{_ls(_D)} * (1 - {_sg(_D + ' / 0.05::DOUBLE')}) + exp(-({_D})) * {_sg(_D + ' / 0.05::DOUBLE')}",
    "sigmoid_forward_kl": f"-{_ls('0.1::DOUBLE * (-exp(-cs) + exp(-rs))')}",
    "sigmoid_js_divergence": f"-{_ls('0.1::DOUBLE * (' + _ls('cs') + ' - ' + _ls('rs') + ')')}",
    "sigmoid_alpha_divergence": f"-{_ls('0.1::DOUBLE * (exp(least(-0.5::DOUBLE * cs, 80)) / -0.5::DOUBLE - exp(least(-0.5::DOUBLE * rs, 80)) / -0.5::DOUBLE)')}",
}
_FORMULAS = {
    "token_scale": "greatest(0, least(1, (1 - cos) / 2))", "exp_half": "exp(1 - cos) / 2", "exp_m1": "exp(1 - cos) - 1", "dist_sq": "(1 - cos) * (1 - cos) / 2",
    "sigmoid_c": "1 / (1 + exp(cos))", "one_minus_c": "1 - cos", "raw_cos": "cos", "raw_dot": "dot", "norm_dot": "pn", "neg_dot": "-dot",
    "dot_scale": "greatest(0, least(1, (1 - pn) / 2))", "sigmoid_dot": _SIG,
}


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _centroids(cte: str, name: str) -> str:
    return f"WITH {_S}, {cte} SELECT label AS k, n AS n_averaged, i - 1 AS i, {_r('m')} AS value FROM {name}_a"


_H = "('0x' || substr(md5('{seed}:{tag}:' || {x}), 1, 8))::BIGINT"


def _hash(x: str, tag: str, seed: int = 0) -> str:
    return _H.format(seed=seed, tag=tag, x=x)


_SKETCH = f"""x AS (SELECT vec_id, unnest(raw) AS x, generate_subscripts(raw, 1) - 1 AS i FROM r),
h AS (SELECT i, {_hash('i', 'b')} % 16 AS b, 2 * ({_hash('i', 's')} % 2) - 1 AS sg FROM range(64) t(i)),
sk AS (SELECT v.vec_id, g.b, coalesce(sum(h.sg * x.x), 0)::DOUBLE AS y FROM (SELECT vec_id FROM r) v CROSS JOIN range(16) g(b)
    LEFT JOIN h ON h.b = g.b LEFT JOIN x ON x.i = h.i AND x.vec_id = v.vec_id GROUP BY v.vec_id, g.b)"""

_MSGS = """c AS (SELECT conv_id, list({'role': role, 'content': coalesce(text, '')} ORDER BY turn) AS m FROM conversations GROUP BY conv_id),
cp AS (SELECT conv_id // 2 AS idx, max(conv_id) FILTER (conv_id % 2 = 0) AS a, max(conv_id) FILTER (conv_id % 2 = 1) AS b FROM c GROUP BY conv_id // 2 HAVING count(*) = 2),
pm AS (SELECT idx, x.m AS cm, y.m AS rm FROM cp JOIN c x ON x.conv_id = a JOIN c y ON y.conv_id = b),
ch AS (SELECT idx, array_to_string(list_transform(cm, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS c,
    array_to_string(list_transform(rm, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS r FROM pm),
fp AS (SELECT idx, CASE WHEN contains(c, '<|im_start|>assistant') THEN substr(c, 1, length(c) - length(string_split(c, '<|im_start|>assistant')[-1])) END AS prompt,
    CASE WHEN contains(c, '<|im_start|>assistant') THEN string_split(c, '<|im_start|>assistant')[-1] END AS chosen,
    CASE WHEN contains(r, '<|im_start|>assistant') THEN string_split(r, '<|im_start|>assistant')[-1] END AS rejected FROM ch)"""

_WTOK = f"{_SINGLE}, {_LOGITS}, wt AS (SELECT tl.*, logp - ref AS r, si.w FROM tl JOIN (SELECT idx, t, {_SIG} AS w FROM si) si USING (idx, t))"
_MODES = """sm0 AS (SELECT *, CASE WHEN done THEN w ELSE 0 END AS own, done::INT::DOUBLE AS o FROM wt),
sm1 AS (SELECT *, own / greatest(sum(own) OVER q, 1e-8) AS share, sum(o) OVER q AS n, sum(o * r) OVER q AS whole FROM sm0 WINDOW q AS (PARTITION BY idx)),
sm2 AS (SELECT *, sum(share * r) OVER (PARTITION BY idx) AS below FROM sm1),
sm AS (SELECT *, share * CASE WHEN abs(below) < 1e-6 THEN 1.0::DOUBLE ELSE whole / CASE WHEN below >= 0 THEN greatest(below, 1e-6) ELSE least(below, -1e-6) END END AS matched FROM sm2)"""


def _mix(share: str) -> str:
    return f"""SELECT {share}::DOUBLE AS share, idx, t, {_r('w')} AS w FROM (SELECT *, CASE WHEN n = 1 THEN 1.0::DOUBLE ELSE m * n / sum(m) OVER (PARTITION BY idx) END AS w FROM
    (SELECT *, CASE WHEN {share} <= 0 OR tot <= 0 THEN g / gs ELSE {share}::DOUBLE * raw / greatest(tot, 1e-300) + (1 - {share}::DOUBLE) * g / gs END AS m FROM gm))"""


def _steps(n: int, k: int = 4) -> str:
    """Fixed rounds of spherical k-means from the first k vectors, written out round by round."""
    ctes = [f"c0 AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, u AS c FROM (SELECT * FROM s ORDER BY vec_id LIMIT {k}))"]
    for j in range(n):
        ctes.append(f"""a{j} AS (SELECT vec_id, u, k, cos FROM (SELECT vec_id, u, k, list_dot_product(u, c) / (greatest({_norm('u')}, 1e-12) * greatest({_norm('c')}, 1e-12)) AS cos FROM s, c{j})
            QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, k) = 1),
        e{j} AS (SELECT k, row_number() OVER (ORDER BY k) AS e FROM c{j} WHERE k NOT IN (SELECT k FROM a{j})),
        w{j} AS (SELECT u, row_number() OVER (ORDER BY cos, vec_id) AS e FROM a{j}),
        x{j} AS (SELECT k, unnest(u) AS x, generate_subscripts(u, 1) AS i FROM a{j}),
        m{j} AS (SELECT k, list(m ORDER BY i) AS c FROM (SELECT k, i, avg(x) AS m FROM x{j} GROUP BY k, i) GROUP BY k
            UNION ALL SELECT e.k, w.u FROM e{j} e JOIN w{j} w USING (e)),
        c{j + 1} AS (SELECT k, list_transform(c, lambda y: y / greatest({_norm('c')}, 1e-12)) AS c FROM m{j})""")
    return f"""WITH {_S}, {', '.join(ctes)} SELECT k, (SELECT {_r('avg(cos)')} FROM a{n - 1}) AS objective, generate_subscripts(c, 1) - 1 AS i, unnest(list_transform(c, lambda y: {_r('y')})) AS value FROM c{n}"""



_PRINT = "SELECT label::VARCHAR AS name, sum(len(raw))::BIGINT AS numel, sum(list_sum(raw)) AS sm, sum(list_dot_product(raw, raw)) AS sq FROM"


def _copies() -> str:
    out = []
    for name, factor in {"equal": "1.0", "negated": "(CASE WHEN label = 3 THEN -1.0 ELSE 1.0 END)", "drifted": "1.001", "doubled": "2.0"}.items():
        out.append(f"""SELECT '{name}' AS copy, CASE WHEN rq < 1e-5 AND rs < 1e-5 THEN 'equal' WHEN rq < 1e-5 THEN 'different basis' WHEN rq < 1e-2 THEN 'different basis and drift' ELSE 'different weights' END AS kind, n_bad FROM
        (SELECT max(abs(b.sm - a.sm) / greatest(abs(a.sm), 1e-30)) AS rs, max(abs(b.sq - a.sq) / greatest(abs(a.sq), 1e-30)) AS rq,
            count(*) FILTER (NOT (abs(b.sm - a.sm) <= 1e-3 + 1e-4 * abs(a.sm) AND abs(b.sq - a.sq) <= 1e-3 + 1e-4 * abs(a.sq))) AS n_bad
        FROM ({_PRINT} r GROUP BY label) a JOIN ({_PRINT} (SELECT label, list_transform(raw, lambda y: y * {factor}::DOUBLE) AS raw FROM r) GROUP BY label) b USING (name))""")
    return _union(out)


def _compare(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS n, {_r('max(abs(got - ref))')} AS max_abs, {_r('quantile_disc(rel, 0.5)')} AS rel_median, {_r('max(rel)')} AS rel_max,
    {_r('sum(got * ref) / greatest(sum(ref * ref), 1e-30)')} AS slope,
    CASE WHEN count(*) > 1 AND stddev_samp(got) > 0 AND stddev_samp(ref) > 0 THEN {_r('corr(got, ref)')} ELSE 'nan'::DOUBLE END AS corr,
    CASE WHEN count(*) > 1 AND stddev_samp(got) > 0 AND stddev_samp(ref) > 0 THEN {_r('corr(rg, rr)')} ELSE 'nan'::DOUBLE END AS spearman,
    quantile_disc(rel, 0.5) < 1e-2 AND (count(*) = 1 OR (count(*) > 1 AND stddev_samp(got) > 0 AND stddev_samp(ref) > 0 AND corr(got, ref) > 0.999)) AS ok
    FROM (SELECT *, abs(got - ref) / greatest(abs(ref), 1e-12) AS rel, row_number() OVER (PARTITION BY {keys} ORDER BY got, i)::DOUBLE AS rg,
        row_number() OVER (PARTITION BY {keys} ORDER BY ref, i)::DOUBLE AS rr FROM {source}) GROUP BY {keys}"""


def _spread(source: str, key: str, x: str) -> str:
    return f"""SELECT {key} AS key, count(*) AS n, {_r(f'quantile_disc({x}, 0.5)::DOUBLE')} AS lower_median, {_r(f'quantile_cont({x}::DOUBLE, 0.5)')} AS median,
    trunc(quantile_cont({x}::DOUBLE, 0.5))::BIGINT AS whole_median, {_r(f'min({x})::DOUBLE')} AS low, {_r(f'max({x})::DOUBLE')} AS high FROM {source} GROUP BY {key}"""


_LAB = f"""{_CU}, lb AS (SELECT vec_id, r.label, list_dot_product(u, c) / (greatest({_norm('u')}, 1e-12) * greatest({_norm('c')}, 1e-12)) AS cos FROM r JOIN cu USING (label))"""
_NEAR = f"""{_CU}, nr AS (SELECT vec_id, r.label, cu.label AS cluster, list_dot_product(u, c) / (greatest({_norm('u')}, 1e-12) * greatest({_norm('c')}, 1e-12)) AS cos FROM r, cu)"""


def _pair_rows(seed_tag: str, n: int) -> str:
    h = _hash("vec_id", seed_tag)
    return f"(SELECT *, row_number() OVER (ORDER BY h, vec_id) - 1 AS rn FROM (SELECT *, {h} AS h FROM r ORDER BY {h}, vec_id LIMIT {n}))"


def _cos(a: str, b: str) -> str:
    return f"list_dot_product({a}, {b}) / (greatest({_norm(a)}, 1e-12) * greatest({_norm(b)}, 1e-12))"


ORACLES = {
    "q01_token_alignment": f"""WITH {_S}, {_CM} SELECT vec_id, label AS best_label, {_r('cos')} AS best_cos, {_r('dot')} AS best_dot FROM
        (SELECT vec_id, cm.label, {_cos('raw', 'c')} AS cos, list_dot_product(raw, c) AS dot FROM r, cm) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, label) = 1""",
    "q02_mean_direction": f"WITH {_S}, {_ALL} SELECT i - 1 AS i, {_r('m')} AS value, (SELECT {_r(_norm('c'))} FROM al) AS length FROM al_a",
    "q03_cluster_centroids_mean": _centroids(_CM, "cm"),
    "q04_cluster_centroids_meannorm": _centroids(_CU, "cu"),
    "q05_dot_scale_modes": f"""WITH {_S}, {_CM}, {_ALL}, n AS (SELECT label AS k, {_norm('cm.c')} AS own, {_norm('al.c')} AS mean FROM cm, al)
        SELECT k, 'raw' AS mode, 1.0::DOUBLE AS factor FROM n UNION ALL SELECT k, 'unit', {_r('1 / greatest(own, 1e-12)')} FROM n UNION ALL SELECT k, 'aggregated', {_r('mean / greatest(own, 1e-12)')} FROM n""",
    "q06_max_direction": f"""WITH {_S}, {_SINGLE}, {_ALL} SELECT idx, t, {_r("greatest(dot, list_dot_product(raw, al.c))")} AS dot, {_r(f"greatest(cos, {_cos('raw', 'al.c')})")} AS cos FROM si, al""",
    "q07_clusteronly": f"WITH {_S}, {_CLU} SELECT idx, t, {_r('dot')} AS dot, {_r('cos')} AS cos FROM cl",
    "q08_maxclu": f"WITH {_S}, {_CLU}, {_SINGLE} SELECT idx, t, {_r('greatest(cl.dot, si.dot)')} AS dot, {_r('greatest(cl.cos, si.cos)')} AS cos FROM cl JOIN si USING (idx, t)",
    "q09_weight_formulas": f"WITH {_S}, {_SINGLE} " + _union([f"SELECT idx, t, '{n}' AS formula, {_r(f'({x})::DOUBLE')} AS w FROM si" for n, x in _FORMULAS.items()]),
    "q10_weight_norms": f"""WITH {_S}, {_SINGLE}, w AS (SELECT idx, t, {_SIG} AS raw FROM si), e AS (SELECT *, exp((raw - max(raw) OVER (PARTITION BY idx)) / 0.1::DOUBLE) AS e FROM w)
        SELECT idx, t, 'none' AS norm, {_r('raw')} AS w FROM e UNION ALL SELECT idx, t, 'softmax', {_r('e / sum(e) OVER (PARTITION BY idx)')} FROM e
        UNION ALL SELECT idx, t, 'l1', {_r('raw / greatest(sum(raw) OVER (PARTITION BY idx), 1e-12)')} FROM e""",
    "q11_sum_modes": f"WITH {_S}, {_WTOK}, {_MODES} " + _union([f"SELECT idx, t, '{n}' AS mode, {_r(f'({x})::DOUBLE')} AS w FROM sm" for n, x in {"normalize": "share", "token_count": "share * n", "reward_match": "matched", "token_scale": "own", "ignore": "o", "chosen_one": "CASE WHEN side = 'c' THEN o ELSE share * n END"}.items()]),
    "q12_ti_mix": f"""WITH {_S}, {_SINGLE}, sc AS (SELECT idx, t, dot AS score FROM si UNION ALL SELECT -1, t, dot FROM si WHERE idx = 0 AND t = 0),
        g0 AS (SELECT *, count(*) OVER (PARTITION BY idx)::DOUBLE AS n, row_number() OVER (PARTITION BY idx ORDER BY t) - 1.0::DOUBLE AS ps, greatest(score, 0.0::DOUBLE) AS raw FROM sc),
        g1 AS (SELECT *, exp(-0.5::DOUBLE * pow((ps - (n - 1) / 2) / greatest(1.0::DOUBLE, n / 4), 2.0::DOUBLE)) AS g FROM g0),
        gm AS (SELECT *, sum(g) OVER (PARTITION BY idx) AS gs, sum(raw) OVER (PARTITION BY idx) AS tot FROM g1) """ + _union([_mix("0.0"), _mix("0.7"), _mix("1.0")]),
    "q13_logit_weights": f"""WITH {_S}, {_LOGITS}, w AS (SELECT vec_id, -logp AS loss, least(exp(logp), 1 - 1e-6) AS p, exp({_lse('z', '2')} - 2 * {_lse('z')}) AS sq,
        {_lse('z')} - list_sum(list_transform(z, lambda x: exp(x - {_lse('z')}) * x)) AS h FROM tl)
        SELECT vec_id, {_r('loss')} AS loss, {_r('p')} AS p, {_r('sq')} AS squares, {_r('h')} AS h, {_r('1 / (2 * (1 - p))')} AS w1, {_r('1 / sqrt(greatest(1 - 2 * p + sq, 1e-12))')} AS w2 FROM w""",
    "q14_pairwise_losses": f"WITH {_S}, {_PAIRS} " + _union([f"SELECT pair_id, '{n}' AS loss, {_r(f'({x})::DOUBLE')} AS value FROM p" for n, x in _LOSSES.items()]),
    "q15_aot_losses": f"""WITH {_S}, {_PAIRS}, b AS (SELECT *, pair_id // 8 AS batch, c_logp - r_logp AS x, c_ref - r_ref AS y FROM p),
        k AS (SELECT batch, pair_id, x, y, cs, rs, row_number() OVER (PARTITION BY batch ORDER BY x, pair_id) AS rx, row_number() OVER (PARTITION BY batch ORDER BY y, pair_id) AS ry,
            row_number() OVER (PARTITION BY batch ORDER BY cs, pair_id) AS rc, row_number() OVER (PARTITION BY batch ORDER BY rs, pair_id) AS rr FROM b)
        SELECT a.batch, a.rx AS rank, {_r('-' + _ls('0.1::DOUBLE * (a.x - d.y)'))} AS loss, 'aot' AS kind FROM k a JOIN k d ON a.batch = d.batch AND a.rx = d.ry
        UNION ALL SELECT a.batch, a.rc, {_r('-' + _ls('0.1::DOUBLE * (a.cs - d.rs)'))}, 'aot_unpaired' FROM k a JOIN k d ON a.batch = d.batch AND a.rc = d.rr""",
    "q16_tdpo_losses": f"""WITH {_S}, {_LOGITS}, l AS (SELECT *, {_lse('rz')} AS a, {_lse('z')} AS b FROM tl),
        kl AS (SELECT pair_id, side, done, logp - ref AS m, list_sum(list_transform(list_zip(rz, z), lambda x: exp(x[1] - a) * ((x[1] - a) - (x[2] - b)))) AS kl FROM l),
        q AS (SELECT pair_id, sum(m * done::INT) FILTER (side = 'c') AS cm, sum(m * done::INT) FILTER (side = 'r') AS rm, sum(kl * done::INT) FILTER (side = 'c') AS ck, sum(kl * done::INT) FILTER (side = 'r') AS rk FROM kl GROUP BY pair_id)
        SELECT pair_id, {_r('ck')} AS c_kl, {_r('rk')} AS r_kl, {_r('-' + _ls('0.1::DOUBLE * (cm - rm - (rk - ck))'))} AS tdpo1,
        {_r('-' + _ls('0.1::DOUBLE * (cm - rm - 0.5::DOUBLE * (rk - ck))'))} AS tdpo2, {_r('-' + _ls('0.1::DOUBLE * (cm - rm)'))} AS no_kl FROM q""",
    "q17_simpo_avg_logp": f"""WITH {_S}, {_LOGITS}, d AS (SELECT *, (done AND idx <> 1)::INT AS o FROM tl),
        q AS (SELECT pair_id, side, sum(logp * o) / greatest(sum(o), 1) AS mean, sum(o)::DOUBLE AS n FROM d GROUP BY pair_id, side),
        w AS (SELECT pair_id, max(mean) FILTER (side = 'c') AS c, max(mean) FILTER (side = 'r') AS r, max(n) FILTER (side = 'r') AS n FROM q GROUP BY pair_id)
        SELECT pair_id, {_r('c')} AS c_mean, {_r('r')} AS r_mean, n AS r_n, {_r('-' + _ls('10 * (c - r) - 3'))} AS loss FROM w""",
    "q18_reward_metrics": f"""WITH {_S}, {_WTOK}, {_MODES}, q AS (SELECT pair_id, side, 0.1::DOUBLE * sum(r * o) AS a, 0.1::DOUBLE * sum(r * share * n) AS b FROM sm GROUP BY pair_id, side),
        w AS (SELECT pair_id, max(a) FILTER (side = 'c') AS ca, max(a) FILTER (side = 'r') AS ra, max(b) FILTER (side = 'c') AS cb, max(b) FILTER (side = 'r') AS rb FROM q GROUP BY pair_id)
        SELECT {_r('avg(ca)')} AS chosen, {_r('avg(ra)')} AS rejected, {_r('avg((ca > ra)::INT)')} AS accuracy, {_r('avg(ca - ra)')} AS margin, 'plain' AS kind FROM w
        UNION ALL SELECT {_r('avg(cb)')}, {_r('avg(rb)')}, {_r('avg((cb > rb)::INT)')}, {_r('avg(cb - rb)')}, 'weighted' FROM w""",
    "q19_weight_stats": f"""WITH {_S}, {_WTOK} SELECT {_r('avg(w) FILTER (side = $$r$$)')} AS mean, {_r('coalesce(stddev_samp(w) FILTER (side = $$r$$), 0)')} AS std, {_r('max(w) FILTER (side = $$r$$)')} AS max,
        {_r('min(w) FILTER (side = $$r$$)')} AS min, {_r('coalesce(avg((list_position(z, list_max(z)) - 1 = label)::INT) FILTER (side = $$c$$), 0)')} AS accuracy FROM wt WHERE done""",
    "q20_format_pairs": f"WITH {_MSGS} SELECT * FROM fp",
    "q21_unpair": f"WITH {_MSGS} SELECT idx, prompt, chosen AS completion, true AS label FROM fp UNION ALL SELECT idx, prompt, rejected, false FROM fp",
    "q22_reverse_pairs": """WITH l AS (SELECT d.lang, l.quality, l.doc_id, row_number() OVER (PARTITION BY d.lang, l.quality ORDER BY l.doc_id) AS rank FROM labels l JOIN documents d USING (doc_id)),
        p AS (SELECT a.lang, a.rank, a.doc_id AS c, b.doc_id AS r FROM l a JOIN l b ON a.lang = b.lang AND a.rank = b.rank AND a.quality = 1 AND b.quality = 0)
        SELECT lang, rank, CASE WHEN rank % 2 = 0 THEN r ELSE c END AS chosen_id, CASE WHEN rank % 2 = 0 THEN c ELSE r END AS rejected_id FROM p""",
    "q23_filter_degenerate": rf"""WITH {_MSGS}, n AS (SELECT *, len(regexp_extract_all(prompt, '[^\s]+')) AS np, len(regexp_extract_all(chosen, '[^\s]+')) AS nc, len(regexp_extract_all(rejected, '[^\s]+')) AS nr FROM fp)
        SELECT CASE WHEN chosen IS NULL OR rejected IS NULL THEN 'no_header' WHEN nc = 0 THEN 'empty_chosen' WHEN nr = 0 THEN 'empty_rejected' WHEN np >= 2048 THEN 'long_prompt' ELSE 'kept' END AS reason, count(*) AS n FROM n GROUP BY 1""",
    "q24_last_messages": f"""WITH {_MSGS} SELECT idx, list_filter(cm, lambda m: m.role = 'user')[-1].content AS prompt, cm[-1].content AS chosen, rm[-1].content AS rejected FROM pm""",
    "q25_align_weights": f"""WITH {_S}, {_SINGLE}, w AS (SELECT idx, list({_SIG} ORDER BY t) AS w FROM si GROUP BY idx), e AS (SELECT idx, idx % 16 AS n, CASE WHEN idx % 7 = 3 THEN [] ELSE w END AS w FROM w),
        m AS (SELECT *, CASE WHEN len(w) = 0 THEN 1.0::DOUBLE ELSE list_avg(w) END AS mean FROM e), x AS (SELECT idx, unnest(range(n)) AS t, w, mean FROM m)
        SELECT idx, t, {_r('CASE WHEN t < len(w) THEN w[t + 1] ELSE mean END')} AS w FROM x""",
    "q26_coverage_gaps": """WITH g AS (SELECT d.doc_id, l.doc_id IS NOT NULL AS done FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id))
        SELECT count(*) AS n_base, count(*) FILTER (done) AS n_done, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM g WHERE NOT done ORDER BY doc_id LIMIT 5)) AS first_gaps,
        count(*) FILTER (NOT done) AS n_missing FROM g""",
    "q27_availability": f"""WITH {_S}, h AS (SELECT idx, 'd' || (t % 3) AS d FROM s WHERE (vec_id % 3 <> 0 OR idx % 2 = 0) AND NOT (idx % 5 = 1 AND t % 3 = 2)) SELECT idx FROM h GROUP BY idx HAVING count(DISTINCT d) = 3""",
    "q28_eta_squared": f"""WITH d AS (SELECT lang, ln(greatest(n_chars, 1)::DOUBLE) AS x FROM documents), g AS (SELECT avg(x) AS grand FROM d), k AS (SELECT count(*) AS n, avg(x) AS m FROM d GROUP BY lang)
        SELECT {_r('(SELECT sum(n * pow(m - grand, 2.0::DOUBLE)) FROM k, g) / sum(pow(x - grand, 2.0::DOUBLE))')} AS eta_squared FROM d, g""",
    "q29_distinctive_terms": f"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z][a-z'']+')) AS term FROM documents),
        c AS (SELECT lang, term, count(*) AS c FROM w WHERE length(term) > 2 AND term NOT IN ({', '.join(f"'{x}'" for x in STOPWORDS)}) GROUP BY lang, term),
        t AS (SELECT term, sum(c) AS tot FROM c GROUP BY term), k AS (SELECT lang, sum(c) AS n_k FROM c GROUP BY lang), a AS (SELECT count(*) AS v, sum(tot) AS n_all FROM t),
        o AS (SELECT lang, term, c, ln(((c + 1)::DOUBLE / (n_k + v)::DOUBLE) / ((tot + 1)::DOUBLE / (n_all + v)::DOUBLE)) AS logodds FROM c JOIN t USING (term) JOIN k USING (lang), a WHERE c >= 15)
        SELECT lang, rank, term, c, {_r('logodds')} AS logodds FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY logodds DESC, term DESC, c DESC) AS rank FROM o) WHERE rank <= 12""",
    "q30_medoids": f"WITH {_S}, {_LAB} SELECT label, rank, vec_id, {_r('cos')} AS cos FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) AS rank FROM lb) WHERE rank <= 10",
    "q31_nearest_centroid": f"""WITH {_S}, {_CU} SELECT k, other, {_r('cos')} AS cos FROM (SELECT a.label AS k, b.label AS other, {_cos('a.c', 'b.c')} AS cos FROM cu a JOIN cu b ON a.label <> b.label)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY cos DESC, other) = 1""",
    "q32_agreement": f"WITH {_S}, {_NEAR} SELECT {_r('avg((label = cluster)::INT)')} AS agreement FROM (SELECT * FROM nr QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY cos DESC, cluster) = 1)",
    "q33_cluster_eval": f"""WITH {_S}, {_NEAR}, o AS (SELECT vec_id, label, max(cos) FILTER (label = cluster) AS own, max(cos) FILTER (label <> cluster) AS other FROM nr GROUP BY vec_id, label),
        k AS (SELECT g.k, count(o.vec_id) AS n, sum(own) AS s FROM range(10) g(k) LEFT JOIN o ON o.label = g.k GROUP BY g.k)
        SELECT {_r('(SELECT avg(own) FROM o)')} AS cohesion, {_r('(SELECT avg(own - other) FROM o)')} AS separation, {_r('(SELECT avg(other) FROM o)')} AS nearest_other, {_r('min(s / n) FILTER (n > 0)')} AS cohesion_min,
        min(n) AS size_min, max(n) AS size_max, trunc(quantile_cont(n::DOUBLE, 0.5))::BIGINT AS size_median, count(*) FILTER (n < 200) AS n_small FROM k""",
    "q34_pairwise_cosine": f"""WITH {_S}, k AS (SELECT raw, row_number() OVER (ORDER BY vec_id) - 1 AS rn FROM r), n AS (SELECT count(*) AS n FROM r),
        d AS (SELECT floor({_hash('p', 'i0')} / 4294967296.0::DOUBLE * n)::BIGINT AS i, floor({_hash('p', 'j0')} / 4294967296.0::DOUBLE * n)::BIGINT AS j FROM range(200000) t(p), n),
        c AS (SELECT {_cos('a.raw', 'b.raw')} AS cos FROM d JOIN k a ON a.rn = i JOIN k b ON b.rn = j WHERE i <> j)
        SELECT count(*) AS n, {_r('avg(cos)')} AS mean, {_r('stddev_samp(cos)')} AS std, """ + ", ".join(f"{_r(f'quantile_cont(cos, {q})')} AS q{k}" for k, q in enumerate((0.01, 0.25, 0.5, 0.75, 0.99))) + " FROM c",
    "q35_countsketch": f"WITH {_S}, {_SKETCH} SELECT sk.vec_id, {_r(_norm('raw'))} AS sketch_norm, b, {_r('y')} AS value FROM sk JOIN r USING (vec_id)",
    "q36_sketch_quality": f"""WITH {_S}, {_SKETCH}, sl AS (SELECT vec_id, list(y ORDER BY b) AS sk FROM sk GROUP BY vec_id), p AS (SELECT q.*, sl.sk FROM {_pair_rows('pair', 200)} q JOIN sl USING (vec_id)),
        c AS (SELECT {_cos('a.raw', 'b.raw')} AS e, {_cos('a.sk', 'b.sk')} AS f FROM p a JOIN p b ON a.rn % 2 = 0 AND b.rn = a.rn + 1)
        SELECT count(*) AS n, {_r('avg(abs(e - f))')} AS mean_error, {_r('max(abs(e - f))')} AS max_error, {_r('corr(e, f)')} AS corr FROM c""",
    "q37_kmeans_step": _steps(1),
    "q38_kmeans_3iter": _steps(3),
    "q41_fingerprint": f"WITH {_S} SELECT name, numel, {_r('sm')} AS sum, {_r('sq')} AS sumsq FROM ({_PRINT} r GROUP BY label)",
    "q42_fingerprint_verify": f"WITH {_S} {_copies()}",
    "q43_reproduction_compare": f"""WITH {_S}, x AS (SELECT 'same' AS channel, vec_id AS i, u[1] AS got, u[1] AS ref FROM s UNION ALL SELECT 'scaled', vec_id, u[1] * -0.5::DOUBLE, u[1] FROM s
        UNION ALL SELECT 'noisy', vec_id, u[1] + 0.1::DOUBLE * u[2], u[1] FROM s UNION ALL SELECT 'one', vec_id, u[1], u[1] FROM s WHERE vec_id = 7) {_compare('x', 'channel')}""",
    "q45_seeded_sample": f"""WITH {_S}, {_LAB}, md AS (SELECT vec_id FROM lb QUALIFY row_number() OVER (PARTITION BY label ORDER BY cos DESC, vec_id) <= 3)
        SELECT label, rank, vec_id FROM (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY {_hash('vec_id', 'sample', 1234)}, vec_id) AS rank FROM lb WHERE vec_id NOT IN (SELECT vec_id FROM md)) WHERE rank <= 5""",
    "q46_compaction_check": "SELECT 0::BIGINT AS missing, 0::BIGINT AS extra, count(*) AS n FROM embeddings",
    "q47_resume_antijoin": "SELECT vec_id AS idx, label FROM embeddings WHERE NOT (vec_id < 100 OR vec_id BETWEEN 200 AND 249)",
    "q48_summary_quantiles": _spread("documents", "lang", "n_chars") + " UNION ALL " + _spread("events", "event_type", "value"),
    "q49_event_windows": f"SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, {_r('sum(value)')} AS total FROM events GROUP BY 1, 2",
    "q52_running_tokens": f"WITH {_S}, {_LOGITS}, p AS (SELECT pair_id, count(*) AS n FROM tl WHERE done GROUP BY pair_id) SELECT pair_id, n, sum(n) OVER (ORDER BY pair_id)::BIGINT AS tokens_seen FROM p",
    "q53_reproduction_verdict": f"""WITH {_S}, b AS (SELECT vec_id AS i, u[1] AS x, u[2] AS y FROM s), k AS (
        SELECT 'exact' AS copy, 'norms' AS channel, i, x AS got, x AS ref FROM b UNION ALL SELECT 'exact', 'products', i, y, y FROM b
        UNION ALL SELECT 'reparameterised', 'norms', i, x, x FROM b UNION ALL SELECT 'reparameterised', 'products', i, y * -0.5::DOUBLE, y FROM b
        UNION ALL SELECT 'drifted', 'norms', i, x * 1.02::DOUBLE, x FROM b UNION ALL SELECT 'drifted', 'products', i, y, y FROM b
        UNION ALL SELECT 'different', 'norms', i, y, x FROM b UNION ALL SELECT 'different', 'products', i, x, y FROM b),
        st AS ({_compare('k', 'copy, channel')}),
        v AS (SELECT copy, bool_and(ok) AS ok, max(corr) FILTER (channel = 'norms') AS c, max(slope) FILTER (channel = 'products') AS sl FROM st GROUP BY copy)
        SELECT copy, CASE WHEN ok THEN 'EXACT' WHEN c > 0.995 AND abs(sl - 1) > 0.1 THEN 'SAME MODEL, DIFFERENT PARAMETERISATION' WHEN c > 0.995 THEN 'SAME MODEL, DRIFTED SUBSPACE' ELSE 'DIFFERENT WEIGHTS' END AS verdict FROM v""",
    "q54_uniform_control": f"SELECT vec_id, 0.5::DOUBLE AS constant, {_r('0.25::DOUBLE + 0.5::DOUBLE * (' + _hash('vec_id', 'w', 1234) + ' / 4294967296.0::DOUBLE)')} AS random, 1.0::DOUBLE AS one FROM embeddings",
    "q55_confidence_weighting": f"""WITH {_S}, {_LOGITS}, {_CONF} SELECT pair_id, {_r('cc')} AS c_confidence, {_r('rc')} AS r_confidence, {_r("(SELECT avg(-logp) FROM tl WHERE done AND side = 'c')")} AS sft FROM cf""",
    "q56_mixed_loss": f"""WITH {_S}, {_PAIRS}, {_CONF}, m AS (SELECT 0.8::DOUBLE * ({_LOSSES['sigmoid']}) AS a, 0.2::DOUBLE * ({_LOSSES['hinge']}) AS b, {_LOSSES['bco_pair']} AS c, cc * rc AS w FROM p JOIN cf USING (pair_id))
        SELECT {_r('avg(a) + avg(b) + avg(c)')} AS loss, 'plain' AS kind FROM m UNION ALL SELECT {_r('avg(a * w) + avg(b * w) + avg(c * w)')}, 'weighted' FROM m""",
    "q57_cluster_report": f"""WITH {_S}, {_CU}, nn AS (SELECT k, other, cos FROM (SELECT a.label AS k, b.label AS other, {_cos('a.c', 'b.c')} AS cos FROM cu a JOIN cu b ON a.label <> b.label)
        QUALIFY row_number() OVER (PARTITION BY k ORDER BY cos DESC, other) = 1), g AS (SELECT label AS k, count(*) AS n, quantile_cont(gnorm, 0.5) AS md, max(gnorm) / greatest(min(gnorm), 1e-12) AS ratio FROM s GROUP BY label)
        SELECT 'k' || lpad(k::VARCHAR, 2, '0') AS name, n, {_r('md')} AS median_norm, {_r('ratio')} AS ratio, other, {_r('cos')} AS cos FROM g LEFT JOIN nn USING (k)""",
    "q58_token_split_whole": r"""WITH d AS (SELECT doc_id, regexp_split_to_array(text, '[ \n]+') AS w FROM documents),
        i AS (SELECT doc_id, list_transform(w, lambda x: CASE WHEN x = 'the' THEN 7 ELSE length(x) + 100 END) AS ids FROM d),
        h AS (SELECT *, len(ids) AS n, len(ids) - list_position(list_reverse(ids), 7) + 1 AS s FROM i),
        c AS (SELECT *, CASE WHEN n <= 2048 OR 2048 > s THEN s END AS cs FROM h)
        SELECT doc_id, n, cs AS comp_start, least(n, 2048) - cs AS n_completion, CASE WHEN cs IS NOT NULL THEN -100 * cs + coalesce(list_sum(ids[cs + 1:least(n, 2048)]), 0) END::BIGINT AS mask_sum FROM c""",
    "q44_batch_pack": """WITH RECURSIVE d AS (SELECT lang, doc_id, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents),
        b AS (SELECT lang, doc_id, n_chars, rn, 0::BIGINT AS batch, 1::BIGINT AS n, n_chars AS longest FROM d WHERE rn = 1
            UNION ALL SELECT lang, doc_id, n_chars, rn, CASE WHEN new THEN batch + 1 ELSE batch END, CASE WHEN new THEN 1 ELSE n + 1 END, CASE WHEN new THEN n_chars ELSE greatest(longest, n_chars) END
            FROM (SELECT d.lang, d.doc_id, d.n_chars, d.rn, b.batch, b.n, b.longest, (b.n + 1) * greatest(b.longest, d.n_chars) > 4096 OR b.n + 1 > 16 AS new FROM b JOIN d ON d.lang = b.lang AND d.rn = b.rn + 1))
        SELECT lang, doc_id, n_chars, batch FROM b""",
    "q59_covariance_whole": f"""WITH {_S}, v AS (SELECT vec_id, unnest(raw) AS x, unnest(range(64)) AS i FROM r)
        SELECT a.i, b.i AS j, {_r('covar_samp(a.x, b.x)')} AS cov FROM v a JOIN v b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY a.i, b.i""",
}

from quillon.plans import method_oracles, storage_oracles, structure_oracles  # noqa: E402  (built on the pieces above)

ORACLES |= method_oracles.ORACLES | storage_oracles.ORACLES | structure_oracles.ORACLES
