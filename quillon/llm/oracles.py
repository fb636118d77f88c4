"""DuckDB SQL with the same results as those queries that SQL can express."""

from __future__ import annotations

_WORD = r"[^\x20\x09-\x0D]+"
_PHRASE = r"[\x20\x09-\x0D]*(?:[^\x20\x09-\x0D]+[\x20\x09-\x0D]*){1,8}|[\x20\x09-\x0D]+"


def _tree(name: str, source: str, text: str) -> str:
    """CTEs that add l (nested leaves), root, fp (the fingerprint) and ls (the leaf set) to the rows of *source*."""
    return f"""
{name}_l AS (SELECT *, list_transform(string_split({text}, chr(10) || chr(10)), lambda s: list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '{_PHRASE}'), lambda w: substr(md5(w), 1, 8)))) AS l FROM {source}),
{name}_p AS (SELECT *, list_transform(l, lambda s: list_transform(s, lambda p: md5(coalesce(array_to_string(p, ''), '')))) AS ph FROM {name}_l),
{name}_s AS (SELECT *, list_transform(ph, lambda s: md5(array_to_string(s, ''))) AS sh FROM {name}_p),
{name} AS (SELECT *, md5(array_to_string(sh, '')) AS root, md5(array_to_string(sh, '')) || '/' || array_to_string(list_transform(
    range(1, len(sh) + 1), lambda i: substr(sh[i], 1, 8) || ':' || array_to_string(list_transform(range(1, len(l[i]) + 1),
    lambda j: substr(ph[i][j], 1, 8) || '=' || coalesce(array_to_string(l[i][j], ''), '')), ';')), '|') AS fp,
    list_distinct(flatten(flatten(l))) AS ls FROM {name}_s)"""


def _like(a: str, b: str) -> str:
    return f"""CASE WHEN {a}.root = {b}.root THEN 1.0::DOUBLE WHEN len({a}.ls) + len({b}.ls) = 0 THEN 0.0::DOUBLE
    ELSE len(list_intersect({a}.ls, {b}.ls)) * 2.0::DOUBLE / (len({a}.ls) + len({b}.ls)) END"""


_OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(coalesce(text, ''))) AS r,
    count(*) OVER () AS n FROM documents),
{_tree('o', 'd', 't')},
e AS (SELECT a.doc_id, a.r, length(a.t)::BIGINT AS n_chars, substr(a.t, 1, length(a.t) - length(a.t) // 4) || substr(b.t, 1, length(a.t) // 4) AS et,
    b.r AS nr FROM d a JOIN d b ON b.r = a.r % a.n + 1),
{_tree('f', 'e', 'et')}
SELECT f.doc_id, f.n_chars, sha256(f.et) AS edited_sha256, o.fp AS fingerprint, f.fp AS edited_fingerprint,
    {_like('o', 'f')} AS near_edited, {_like('o', 'x')} AS near_next
FROM f JOIN o ON o.r = f.r JOIN o x ON x.r = f.nr"""

_OP10 = f"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5(coalesce(text, '')) AS m FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size, m) - 1 AS copy FROM d),
k AS (SELECT *, md5('1729:' || coalesce(doc_id::VARCHAR, 'null') || ':' || m || ':' || copy::VARCHAR) AS key FROM n),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS c, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1.0::DOUBLE AS weight FROM s),
q AS (SELECT *, coalesce(sum(source_size * 3) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS fixed,
    sum(weight) OVER (ORDER BY source_size * 3 / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
    sum(source_size) OVER ()::DOUBLE AS total FROM w),
lv AS (SELECT min_by((total - fixed) / free, source_size * 3 / weight) AS level FROM q WHERE weight * ((total - fixed) / free) <= source_size * 3),
t AS (SELECT source, c, source_size, least(weight * level, (source_size * 3)::DOUBLE) AS target FROM w, lv),
a AS (SELECT k.*, t.* EXCLUDE (source), coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
b AS (SELECT *, list_transform(range(0, 3), lambda r: greatest(0, least(size, floor(target + 0.5)::BIGINT - start - r * source_size))) AS words FROM a),
h AS (SELECT *, list_sum(words)::BIGINT AS taken, len(list_filter(words, lambda x: x > 0))::BIGINT AS copies, c * 0.5::DOUBLE - 0.5 AS ramp FROM b),
u AS (SELECT *, CASE WHEN target > 0 THEN least(1.0::DOUBLE, (start + words[1] / 2.0::DOUBLE) / target) ELSE 0.0::DOUBLE END AS u FROM h)
SELECT doc_id, size, source_size, target, taken, source, copies,
    CASE WHEN copies > 0 THEN CASE WHEN ramp = 0 THEN u ELSE (sqrt(pow(1 - ramp, 2.0::DOUBLE) + 4 * ramp * u) - (1 - ramp)) / (2 * ramp) END END AS first_position
FROM u"""

ORACLES = {"op8_merkle_fingerprints": _OP8, "op10_curriculum_mix": _OP10}
