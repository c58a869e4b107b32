"""The quality rules as DuckDB SQL, written out from the method's formulas apart from the DataFrame code."""

from __future__ import annotations

from .quality import C_STEPS, CONSISTENCY, COVERAGE, CUTOFF, FLOOR, MIN_GROUP, TRIAL_STEPS

_D = ("len", "word", "sym", "dup")
_PAIRS = [(a, b) for i, a in enumerate(_D) for b in _D[: i + 1]]
_FIT = ", ".join([f"c_{a}" for a in _D] + [f"l_{a}_{b}" for a, b in _PAIRS])

_STATISTICS = r"""
     d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     g AS (SELECT r, i, md5(array_to_string(list_slice(w, i, i + 4), ' ')) AS h FROM d, unnest(range(1, greatest(len(w) - 3, 1))) u(i)),
     rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, h) > 1), range(5) o(k) GROUP BY r),
     ln AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
     s AS (SELECT r, doc_id, lang, source, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(ln.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
                  greatest(len(w), 1)::DOUBLE AS n, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM d LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
     v AS (SELECT *, round_even(1000 * ln(1 + n_words::DOUBLE), 0)::BIGINT AS z_len, round_even(1000 * ln(greatest(word_chars, 1) / n), 0)::BIGINT AS z_word, round_even(1000 * ln(1 + 10 * n_symbols / n), 0)::BIGINT AS z_sym,
                  round_even(1000 * ln(1 + sqrt(10 * n_repeat_words / n) + n_dup_lines / n), 0)::BIGINT AS z_dup FROM s)"""


def _distance() -> str:
    """Columns y_* and d2 of a row with z_*, centre and factor."""
    parts = []
    for i, a in enumerate(_D):
        rest = "".join(f" - l_{a}_{b} * y_{b}" for b in _D[:i])
        parts.append(f"(z_{a} - c_{a}{rest}) / l_{a}_{a} AS y_{a}")
    return ", ".join(parts) + ", " + " + ".join(f"y_{a} * y_{a}" for a in _D) + " AS d2"


def _factor() -> str:
    """Columns l_* of a row with the covariance v_*; each variance has a floor."""
    parts = []
    for i, a in enumerate(_D):
        for j, b in enumerate(_D[: i + 1]):
            rest = "".join(f" - l_{a}_{c} * l_{b}_{c}" for c in _D[:j])
            floor = float(FLOOR[i] ** 2)
            parts.append(f"sqrt(greatest(v_{a}_{a} + {floor}{rest}, {floor}::DOUBLE)) AS l_{a}_{a}" if i == j else f"(v_{a}_{b}{rest}) / l_{b}_{b} AS l_{a}_{b}")
    return ", ".join(parts)


def _step(k: int, fit: str) -> str:
    """CTEs of one C-step: fit_k from `fit`."""
    sums = ", ".join([f"sum(z_{a}) AS s_{a}" for a in _D] + [f"sum(z_{a} * z_{b}) AS s_{a}_{b}" for a, b in _PAIRS])
    again = ", ".join([f"sum(s_{a}) AS s_{a}" for a in _D] + [f"sum(s_{a}_{b}) AS s_{a}_{b}" for a, b in _PAIRS])
    means = ", ".join([f"s_{a}::DOUBLE / m AS c_{a}" for a in _D] + [f"s_{a}_{b}::DOUBLE / m - c_{a} * c_{b} AS v_{a}_{b}" for a, b in _PAIRS])
    return f"""
     bin_{k} AS (SELECT *, greatest(-320, least(1280, floor(log2(d2 + 1e-9) * 32)))::INTEGER AS bin FROM (SELECT x.*, start, share, {_distance()} FROM x JOIN {fit} USING (grp))),
     sum_{k} AS (SELECT grp, start, share, bin, count(*) AS m, {sums} FROM bin_{k} GROUP BY ALL),
     cut_{k} AS (SELECT *, coalesce(sum(m) OVER (PARTITION BY grp, start ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM sum_{k}),
     near_{k} AS (SELECT grp, start, sum(m)::DOUBLE AS m, {again} FROM cut_{k} JOIN size USING (grp) WHERE before < ceil(n * share) GROUP BY grp, start),
     fit_{k} AS (SELECT grp, start, {COVERAGE} AS share, {means}, {_factor()} FROM near_{k})"""


def quality_sql() -> str:
    quartile = ", ".join(f"quantile_disc(z_{a}, {p}) AS {n}_{a}" for a in _D for n, p in (("lo", 0.25), ("m", 0.5), ("hi", 0.75)))
    scale = ", ".join(f"greatest((hi_{a} - lo_{a}) / 1.349::DOUBLE, {float(f)}::DOUBLE) AS r_{a}" for a, f in zip(_D, FLOOR))
    unit = ", ".join(f"(z_{a} - m_{a}) / r_{a} AS u_{a}" for a in _D)
    length = "sqrt(" + " + ".join(f"u_{a} * u_{a}" for a in _D) + ")"
    sign = ", ".join(f"CASE WHEN length > 0 THEN round_even(1000 * u_{a} / length, 0)::BIGINT ELSE 0 END AS g_{a}" for a in _D)
    spread = ", ".join([f"sum(abs(z_{a} - m_{a}))::DOUBLE / any_value(n) AS a_{a}" for a in _D] + [f"sum(g_{a} * g_{b})::DOUBLE / any_value(n) * 4 / 1e6 * any_value(r_{a}) * any_value(r_{b}) AS v_{a}_{b}" for a, b in _PAIRS])
    centre = ", ".join(f"m_{a}::DOUBLE AS c_{a}" for a in _D)
    plain = ", ".join(f"greatest(a_{a}, {float(FLOOR[_D.index(a)])}::DOUBLE) AS l_{a}_{a}" if a == b else f"0::DOUBLE AS l_{a}_{b}" for a, b in _PAIRS)
    size_of = "round(" + " + ".join(f"ln(l_{a}_{a})" for a in _D) + ", 9)"
    steps, fit = [], "fit_start"
    for k in range(C_STEPS):
        if k == TRIAL_STEPS:
            steps.append(f"\n     best AS (SELECT * FROM {fit} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY {size_of}, start) = 1)")
            fit = "best"
        steps.append(_step(k, fit))
        fit = f"fit_{k}"
    z = ", ".join(f"z_{a}" for a in _D)
    return f"""
WITH {_STATISTICS.strip()},
     cnt AS (SELECT lang, source, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL),
     lg AS (SELECT lang, sum(n) AS nl, bool_or(n < {MIN_GROUP}) AND sum(n) >= {MIN_GROUP} AS needed FROM cnt GROUP BY lang),
     k AS (SELECT lang, source, CASE WHEN n >= {MIN_GROUP} THEN 'own|' || lang || '|' || source WHEN nl >= {MIN_GROUP} THEN 'lang|' || lang ELSE 'all' END AS grp FROM cnt JOIN lg USING (lang)),
     x AS (SELECT grp, {z} FROM v JOIN k USING (lang, source) WHERE NOT base_failed AND grp LIKE 'own|%' UNION ALL SELECT 'lang|' || lang, {z} FROM v JOIN lg USING (lang) WHERE NOT base_failed AND needed
           UNION ALL SELECT 'all', {z} FROM v WHERE NOT base_failed AND EXISTS (SELECT 1 FROM k WHERE grp = 'all')),
     size AS (SELECT *, {scale} FROM (SELECT grp, count(*) AS n, {quartile} FROM x GROUP BY grp)),
     sp AS (SELECT grp, {spread} FROM (SELECT *, {sign} FROM (SELECT *, {unit}, {length} AS length FROM x JOIN size USING (grp))) GROUP BY grp),
     fit_start AS (SELECT grp, start, share, {_FIT} FROM (SELECT grp, {centre}, {plain} FROM size JOIN sp USING (grp)), (VALUES (0, {COVERAGE}), (1, 0.5)) AS o(start, share)
                   UNION ALL SELECT grp, 2, {COVERAGE}, {_FIT} FROM (SELECT grp, {centre}, {_factor()} FROM size JOIN sp USING (grp))),{",".join(steps)},
     judged AS (SELECT v.*, {_distance()} FROM v LEFT JOIN k USING (lang, source) LEFT JOIN {fit} USING (grp))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(d2, 0) <= {CUTOFF * CONSISTENCY}::DOUBLE AS kept FROM judged
"""
