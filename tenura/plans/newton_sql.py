"""SQL of the ridge Cox fit with any number of covariates: Newton steps as CTEs, each linear system solved by
Gauss-Jordan elimination on a (row, column, value) relation. Used only to check the fits."""

from __future__ import annotations

from collections.abc import Sequence


def _solved(name: str, cells: str, p: int) -> str:
    """A recursive CTE: step s clears column s; at s = p the matrix is the identity and the further columns hold the
    solutions. The matrix is positive definite, so no pivot vanishes."""
    return f"""{name} AS (
  SELECT 0 AS s, k, i, j, v FROM ({cells})
  UNION ALL
  SELECT s + 1, k, i, j, CASE WHEN i = s + 1 THEN v / corner ELSE v - in_row * in_col / corner END
  FROM (SELECT *, max(CASE WHEN j = s + 1 THEN v END) OVER (PARTITION BY k, i) AS in_row,
               max(CASE WHEN i = s + 1 THEN v END) OVER (PARTITION BY k, j) AS in_col,
               max(CASE WHEN i = s + 1 AND j = s + 1 THEN v END) OVER (PARTITION BY k) AS corner
        FROM {name} WHERE s < {p}))"""


def newton_steps(models: str, p: int, steps: int, penalizer: float = 0.1) -> str:
    """CTEs that fit models with `p` covariates, one per k, from zero. `models` selects (k, t, e, x1 .. xp); a
    covariate that is constant in a model takes no part in it. The last step leaves:

    scale (k, n, m*, s*), fit (k, b*, loglik) on the standardised scale, inverse (k, i, j, v), and by event time
    at_fit (k, t, d, n, x*, g*): sums of covariates over deaths and their expectations.
    """
    each = range(1, p + 1)
    pairs = [(a, b) for a in each for b in each if a <= b]
    join = lambda text, items=each: ", ".join(text.format(j=j) for j in items)
    product = lambda text: ", ".join(text.format(a=a, b=b) for a, b in pairs)
    ctes = [
        f"rows_in AS MATERIALIZED ({models})",
        "scale AS MATERIALIZED (SELECT k, count(*) AS n, "
        + join("avg(x{j}) AS m{j}, CASE WHEN stddev_samp(x{j}) > 0 THEN stddev_samp(x{j}) ELSE 1 END AS s{j}")
        + " FROM rows_in GROUP BY k)",
        f"z AS MATERIALIZED (SELECT r.k, t, e, {join('(x{j} - m{j}) / s{j} AS z{j}')} FROM rows_in r JOIN scale s ON r.k = s.k)",
        f"b0 AS MATERIALIZED (SELECT k, {join('0.0::DOUBLE AS b{j}')} FROM scale)",
    ]
    for q in range(steps + 1):
        eta = " + ".join(f"b{j} * z{j}" for j in each)
        cell = lambda a, b: f"w_{min(a, b)}_{max(a, b)} - o_{min(a, b)}_{max(a, b)}" + (f" + {penalizer} * n" if a == b else "")
        matrix = [(a, b, cell(a, b)) for a in each for b in each]
        matrix += [(a, p + 1, f"x{a} - g{a} - {penalizer} * n * b{a}") for a in each]
        if q == steps:
            matrix += [(a, p + 1 + b, "1.0::DOUBLE" if a == b else "0.0::DOUBLE") for a in each for b in each]
        listed = lambda at: ", ".join(str(m[at]) for m in matrix)
        ctes += [
            f"r{q} AS MATERIALIZED (SELECT z.*, eta, exp(eta) AS r FROM (SELECT z.*, {eta} AS eta FROM z JOIN b{q} b ON z.k = b.k) z)",
            f"t{q} AS MATERIALIZED (SELECT k, t, count(*) AS n, CAST(sum(e) AS BIGINT) AS d, sum(r) AS r0, sum(r * e) AS d0, "
            f"sum(e * eta) AS eta, {join('sum(e * z{j}) AS x{j}, sum(r * z{j}) AS r{j}, sum(r * e * z{j}) AS d{j}')} FROM r{q} GROUP BY k, t)",
            f"u{q} AS (SELECT *, sum(r0) OVER w AS s0, {join('sum(r{j}) OVER w AS s{j}')} FROM t{q} "
            "WINDOW w AS (PARTITION BY k ORDER BY t DESC))",
            f"l{q} AS MATERIALIZED (SELECT k, t, f, phi, {join('(s{j} - f * d{j}) / phi AS g{j}')} FROM (SELECT *, l / d AS f, "
            f"s0 - l / d * d0 AS phi FROM (SELECT *, unnest(range(0, d)) AS l FROM u{q} WHERE d > 0)))",
            f"a{q} AS MATERIALIZED (SELECT k, t, sum(1 / phi) AS inv, sum(f / phi) AS frac, sum(ln(phi)) AS logphi, "
            f"{join('sum(g{j}) AS g{j}')} FROM l{q} GROUP BY k, t)",
            f"o{q} AS MATERIALIZED (SELECT k, {product('sum(g{a} * g{b}) AS o_{a}_{b}')} FROM l{q} GROUP BY k)",
            f"h{q} AS MATERIALIZED (SELECT t.k, t.t, coalesce(frac, 0) AS frac, sum(coalesce(inv, 0)) OVER (PARTITION BY t.k ORDER BY t.t) AS hazard "
            f"FROM t{q} t LEFT JOIN a{q} a ON t.k = a.k AND t.t = a.t)",
            f"w{q} AS MATERIALIZED (SELECT k, {product('sum(w * z{a} * z{b}) AS w_{a}_{b}')} FROM (SELECT r.*, r * (hazard - e * frac) AS w "
            f"FROM r{q} r JOIN h{q} h ON r.k = h.k AND r.t = h.t) GROUP BY k)",
            f"v{q} AS MATERIALIZED (SELECT t.k, eta - logphi AS loglik, {join('t.x{j}, a.g{j}')} FROM "
            f"(SELECT k, sum(eta) AS eta, {join('sum(x{j}) AS x{j}')} FROM t{q} GROUP BY k) t JOIN "
            f"(SELECT k, sum(logphi) AS logphi, {join('sum(g{j}) AS g{j}')} FROM a{q} GROUP BY k) a ON t.k = a.k)",
            _solved(
                f"gj{q}",
                f"SELECT s.k, unnest([{listed(0)}]) AS i, unnest([{listed(1)}]) AS j, unnest([{listed(2)}]) AS v "
                f"FROM scale s JOIN b{q} b ON s.k = b.k JOIN o{q} o ON s.k = o.k JOIN w{q} w ON s.k = w.k JOIN v{q} v ON s.k = v.k",
                p,
            ),
            f"b{q + 1} AS MATERIALIZED (SELECT b.k, {join('max(b{j}) + max(CASE WHEN i = {j} THEN v END) AS b{j}')} FROM b{q} b JOIN gj{q} g "
            f"ON b.k = g.k AND g.s = {p} AND g.j = {p + 1} GROUP BY b.k)",
        ]
    ctes += [
        f"fit AS (SELECT b.*, loglik FROM b{steps} b JOIN v{steps} v ON b.k = v.k)",
        f"inverse AS MATERIALIZED (SELECT k, i, j - {p + 1} AS j, v FROM gj{steps} WHERE s = {p} AND j > {p + 1})",
        f"at_fit AS (SELECT t.k, t.t, d, n, {join('x{j}, coalesce(g{j}, 0) AS g{j}')} FROM t{steps} t "
        f"LEFT JOIN a{steps} a ON t.k = a.k AND t.t = a.t)",
    ]
    return ",\n".join(ctes)


def normal_tail(z: str) -> str:
    """Two-sided normal tail beyond |z|, by Simpson's rule on 2,000 intervals up to |z| + 12."""
    return (
        f"(SELECT 0.004::DOUBLE * sum(CASE WHEN q IN (0, 2000) THEN 1 WHEN q % 2 = 1 THEN 4 ELSE 2 END "
        f"* exp(-((abs({z}) + 0.006 * q) * (abs({z}) + 0.006 * q)) / 2)) / sqrt(2 * pi()) FROM range(0, 2001) AS simpson(q))"
    )
