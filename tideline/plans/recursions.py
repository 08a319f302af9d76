"""SQL twins of learners and clusterings that go over rows in order: recursive queries with the state in a row.

Numbers that a learner draws are drawn here too and enter as a list. SQL is for tables of test size.
EXP3 with random choices has no twin: a last digit's difference in a weight grows with every step.
"""

from __future__ import annotations

import numpy as np

#: More draws than the orders tables have days.
DRAWS = 2500
_REST = "SELECT day, round(p, {d}) + 0.0 AS prediction, round(l, {d}) AS loss, round(sum({cost}) OVER (ORDER BY rn ROWS UNBOUNDED PRECEDING), {d}) AS regret FROM g WHERE rn > 0"


def _numbers(values) -> str:
    return "[" + ", ".join(f"'{float(v)!r}'" for v in values) + "]::DOUBLE[]"


def rows(source: str) -> str:
    """Days in order with y, the total in millions."""
    return f"y AS (SELECT day, total / 1000000 AS y, row_number() OVER (ORDER BY day) AS rn FROM {source})"


def gradient(source: str, start: str, columns: dict[str, tuple[str, str]], move: str, digits: int = 6) -> str:
    """A learner of one parameter theta that predicts theta. columns: further state, as (begin, next); in next and move, s is the slope theta - y, and x_new the next value of a column x."""
    own = "".join(f", {c}" for c in columns)
    made = "".join(f", {f} AS {c}_new" for c, (_, f) in columns.items())
    begin = "".join(f", {b} AS {c}" for c, (b, _) in columns.items())
    new = "".join(f", {c}_new" for c in columns)
    return f"""WITH RECURSIVE {rows(source)},
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, {start}::DOUBLE AS theta{begin}
UNION ALL SELECT rn, day, theta, 0.5::DOUBLE * s * s, {move}{new} FROM (SELECT *{made} FROM (SELECT y.rn, y.day, theta, theta - y AS s{own} FROM g JOIN y ON y.rn = g.rn + 1)))
{_REST.format(d=digits, cost="l")}"""


def _newton(scale: str, keep: str) -> tuple[dict, str]:
    a = f"(a / {keep})"
    g = f"(s * {scale})"
    return {"a": ("1.0::DOUBLE", f"{a} - ({a} * {g}) * ({a} * {g}) / (1 + {g} * ({a} * {g}))")}, "theta - 0.1::DOUBLE * a_new * s"


def newton(source: str) -> str:
    return gradient(source, "0.0", *_newton("1.0::DOUBLE", "1.0::DOUBLE"))


def forgetful_newton(source: str) -> str:
    return gradient(source, "0.0", *_newton("sqrt(1.0::DOUBLE - 0.9::DOUBLE)", "0.9::DOUBLE"))


def bandit_descent(source: str) -> str:
    """Of one dimension: a random direction is a sign."""
    u = np.sign(np.random.default_rng(0).normal(0, 1, DRAWS))
    return f"""WITH RECURSIVE {rows(source)}, u AS (SELECT {_numbers(u)} AS u),
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, 0.0::DOUBLE AS theta
UNION ALL SELECT rn, day, p, l, theta - 0.001::DOUBLE * (1 / 0.1::DOUBLE * l * s) FROM (SELECT *, 0.5::DOUBLE * (p - y) * (p - y) AS l FROM (SELECT y.rn, y.day, y.y, theta, u[y.rn] AS s, theta + 0.1::DOUBLE * u[y.rn] AS p FROM g JOIN y ON y.rn = g.rn + 1, u)))
{_REST.format(d=6, cost="l")}"""


def sign_linear(source: str) -> str:
    rng = np.random.default_rng(0)
    size, bias = np.abs(rng.normal(size=(2, 1, 1))).ravel(), rng.normal(size=1)[0]
    made = _numbers([size[0], -size[1], 0.0])
    return f"""WITH RECURSIVE {rows(source)}, u AS (SELECT {_numbers(rng.random(DRAWS))} AS u, {made} AS w, '{float(bias)!r}'::DOUBLE AS b),
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, [1.0 / 3, 1.0 / 3, 1.0 / 3]::DOUBLE[] AS share
UNION ALL SELECT rn, day, p, l, list_transform(mixed, lambda v: v / list_sum(mixed)) FROM (SELECT *, list_transform(range(1, 4), lambda i: 0.85::DOUBLE * CASE WHEN i = k THEN share[i] * exp(-0.1::DOUBLE * l / share[i]) ELSE share[i] END + 0.15::DOUBLE / 3) AS mixed
FROM (SELECT *, 0.5::DOUBLE * (p - y) * (p - y) AS l FROM (SELECT *, w[k] + b AS p FROM (SELECT y.rn, y.day, y.y, share, w, b, CASE WHEN share[1] >= u[y.rn] THEN 1 WHEN share[1] + share[2] >= u[y.rn] THEN 2 ELSE 3 END AS k FROM g JOIN y ON y.rn = g.rn + 1, u)))))
{_REST.format(d=6, cost="l")}"""


_SIX = "range(1, 7)"


def exp3_median(source: str) -> str:
    """EXP3 over six constants (0, 0.2 .. 1) at rate 0.1; the weighted median of the constants is followed."""
    return f"""WITH RECURSIVE {rows(source)},
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, 0.0::DOUBLE AS cost, list_transform({_SIX}, lambda i: 1 / 6.0::DOUBLE) AS w
UNION ALL SELECT rn, day, p, l, cost, list_transform(up, lambda v: v / list_sum(up)) FROM (SELECT *, list_transform(made, lambda v: greatest(v, 0.000001::DOUBLE)) AS up, l / own * made[k] AS cost FROM (SELECT *, list_transform(raw, lambda v: v / list_sum(raw)) AS made
FROM (SELECT *, list_transform({_SIX}, lambda i: CASE WHEN i = k THEN w[i] * exp(-0.1::DOUBLE * (l / w[i])) ELSE w[i] END) AS raw, w[k] AS own FROM (SELECT *, 0.5::DOUBLE * (p - y) * (p - y) AS l FROM (SELECT *, (k - 1) / 5.0::DOUBLE AS p
FROM (SELECT y.rn, y.day, y.y, w, least(1 + len(list_filter(range(1, 7), lambda i: list_sum(w[1:i]) < 0.5)), 6) AS k FROM g JOIN y ON y.rn = g.rn + 1)))))))
{_REST.format(d=6, cost="cost")}"""


def upper_bounds(source: str) -> str:
    return f"""WITH RECURSIVE {rows(source)},
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS mean, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS seen
UNION ALL SELECT rn, day, p, l, list_transform({_SIX}, lambda i: CASE WHEN i = k THEN mean[i] + (l - mean[i]) / (seen[i] + 1) ELSE mean[i] END), list_transform({_SIX}, lambda i: seen[i] + CASE WHEN i = k THEN 1 ELSE 0 END)
FROM (SELECT *, 0.5::DOUBLE * (p - y) * (p - y) AS l FROM (SELECT *, (k - 1) / 5.0::DOUBLE AS p FROM (SELECT y.rn, y.day, y.y, mean, seen, CASE WHEN list_min(seen) = 0 THEN list_position(seen, 0.0::DOUBLE) ELSE list_position(bound, list_min(bound)) END AS k
FROM (SELECT *, list_transform({_SIX}, lambda i: CASE WHEN seen[i] = 0 THEN 0 ELSE mean[i] - sqrt(1.001::DOUBLE * ln(greatest(rn, 1)) / seen[i] / 2) END) AS bound FROM g) g JOIN y ON y.rn = g.rn + 1))))
{_REST.format(d=6, cost="l")}"""


_LOSSES = f"list_transform({_SIX}, lambda i: 0.5::DOUBLE * pow((i - 1) / 5.0::DOUBLE - y, 2))"


def fixed_share(source: str) -> str:
    return f"""WITH RECURSIVE {rows(source)},
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, 0.0::DOUBLE AS cost, list_transform({_SIX}, lambda i: 1 / 6.0::DOUBLE) AS w
UNION ALL SELECT rn, day, 0.0::DOUBLE, list_avg(ls), list_sum(list_transform({_SIX}, lambda i: ls[i] * made[i])), list_transform(made, lambda v: 0.88::DOUBLE * v + 0.12::DOUBLE / 6)
FROM (SELECT *, list_transform(raw, lambda v: v / list_sum(raw)) AS made FROM (SELECT *, list_transform({_SIX}, lambda i: w[i] * exp(-(ls[i] - list_min(ls)))) AS raw FROM (SELECT y.rn, y.day, w, {_LOSSES} AS ls FROM g JOIN y ON y.rn = g.rn + 1))))
{_REST.format(d=6, cost="cost")}"""


def time_fixed_share(source: str) -> str:
    """Features 1 and sin(t / 10)."""
    return f"""WITH RECURSIVE {rows(source)},
g AS (SELECT 0::BIGINT AS rn, NULL::DATE AS day, 0.0::DOUBLE AS p, 0.0::DOUBLE AS l, 0.0::DOUBLE AS cost, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS a, [0, 0, 0, 0, 0, 0]::DOUBLE[] AS b
UNION ALL SELECT rn, day, 0.0::DOUBLE, list_avg(ls), list_sum(list_transform({_SIX}, lambda i: ls[i] * up[i])) / list_sum(up), a, b
FROM (SELECT *, list_transform(h, lambda v: exp(-(v - list_min(h)))) AS up FROM (SELECT *, list_transform({_SIX}, lambda i: a[i] + b[i] * f) AS h
FROM (SELECT rn, day, f, ls, list_transform({_SIX}, lambda i: a[i] - m[i]) AS a, list_transform({_SIX}, lambda i: b[i] - m[i] * f) AS b
FROM (SELECT *, list_transform({_SIX}, lambda i: h0[i] + ln(0.88::DOUBLE * exp(-h0[i] - ls[i]) + 0.12::DOUBLE / 6)) AS m FROM (SELECT *, list_transform({_SIX}, lambda i: a[i] + b[i] * f) AS h0
FROM (SELECT y.rn, y.day, a, b, sin((y.rn - 1) / 10.0::DOUBLE) AS f, {_LOSSES} AS ls FROM g JOIN y ON y.rn = g.rn + 1)))))))
{_REST.format(d=6, cost="cost")}"""


# clustering: five centres, the first five vectors

_VECTORS = "v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, row_number() OVER (ORDER BY vec_id) AS rn, count(*) OVER () AS n FROM embeddings), first AS (SELECT list(x ORDER BY rn) AS m FROM v WHERE rn <= 5)"
_CENTRES = "SELECT CAST(k - 1 AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS dim, round(m[k][i], {d}) + 0.0 AS value FROM last, (SELECT unnest(range(1, 6)) AS k), (SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i)"
_DISTANCES = "list_transform(m, lambda c: list_distance(c, x)) AS d"


def weighted_means(most: int = 300, digits: int = 6) -> str:
    """Batch k-means with distance weights, until the centres move by less than 1e-4; that move isn't made."""
    return f"""WITH RECURSIVE {_VECTORS},
g AS (SELECT 0 AS step, m, NULL::DOUBLE AS moved FROM first
UNION ALL SELECT step + 1, new, sqrt(list_sum(list_transform(range(1, 6), lambda k: pow(list_distance(new[k], m[k]), 2)))) FROM (SELECT step, m, (SELECT list(c ORDER BY k) FROM (SELECT k, list(s ORDER BY i) AS c FROM (SELECT k, i, sum(w * x[i]) / sum(w) AS s
FROM (SELECT x, k, CASE WHEN k = own THEN d[k] + 2 * list_sum(d) WHEN d[k] = 0 THEN 0 ELSE d[own] * d[own] / d[k] END AS w FROM (SELECT x, d, list_position(d, list_min(d)) AS own FROM (SELECT x, list_transform(g.m, lambda c: list_distance(c, x)) AS d FROM v)), (SELECT unnest(range(1, 6)) AS k)),
(SELECT unnest(range(1, (SELECT max(len(x)) FROM v) + 1)) AS i) GROUP BY k, i) GROUP BY k)) AS new FROM g WHERE step < {most} AND coalesce(moved, 1) >= 0.0001)),
last AS (SELECT m FROM g WHERE coalesce(moved, 1) >= 0.0001 ORDER BY step DESC LIMIT 1)
{_CENTRES.format(d=digits)}"""


def online_means(passes: int, move: str, shift: float = 0.0, mass: str = "", digits: int = 6) -> str:
    """Rows in order, `passes` times. move: the new value of m[k][i] by x, d (distances), own (the nearest's number), a (see mass); mass: a list, each centre's weight of a row."""
    a = mass or "range(1, 6)"
    return f"""WITH RECURSIVE {_VECTORS},
g AS (SELECT 0 AS step, list_transform(m, lambda c: list_transform(c, lambda e: e + {shift}::DOUBLE)) AS m, [1, 1, 1, 1, 1]::DOUBLE[] AS held FROM first
UNION ALL SELECT step + 1, list_transform(range(1, 6), lambda k: list_transform(range(1, len(x) + 1), lambda i: {move})), {"list_transform(range(1, 6), lambda k: held[k] + a[k])" if mass else "held"}
FROM (SELECT *, {a} AS a FROM (SELECT *, list_position(d, list_min(d)) AS own, list_min(d) AS least FROM (SELECT step, m, held, x, {_DISTANCES} FROM g JOIN v ON v.rn = g.step % v.n + 1 WHERE g.step < {passes} * v.n)))),
last AS (SELECT m FROM g ORDER BY step DESC LIMIT 1)
{_CENTRES.format(d=digits)}"""


def winner_means() -> str:
    return online_means(10, "CASE WHEN k = own THEN m[k][i] + 0.05::DOUBLE * (x[i] - m[k][i]) ELSE m[k][i] END")


def inverse_mass_means(n: int = 3, p: int = 2) -> str:
    rest = f"list_sum(list_transform(d, lambda e: CASE WHEN e <> least THEN 1 / pow(e, {p}) ELSE 0 END))"
    own = f"-({n} - {p}) * pow(least, {n - p - 2}) - {n} * pow(least, {n - 2}) * {rest}"
    mass = f"list_transform(range(1, 6), lambda k: CASE WHEN k = own THEN {own} WHEN d[k] > 0 THEN {p} * pow(least, {n}) / pow(d[k], {p + 2}) ELSE 0 END)"
    return online_means(1, "(m[k][i] * held[k] + a[k] * x[i]) / (held[k] + a[k])", 0.01, mass)


def inverse_gradient_means(rate: float = 0.001) -> str:
    own = "-3 * least - 2 * list_sum(list_transform(d, lambda e: CASE WHEN e <> least THEN e ELSE 0 END))"
    return online_means(1, f"m[k][i] - {rate}::DOUBLE * CASE WHEN k = own THEN {own} WHEN d[k] > 0 THEN -least * least / d[k] ELSE 0 END * (x[i] - m[k][i])", 0.01)


def harmonic_means() -> str:
    inverse = "list_sum(list_transform(d, lambda e: CASE WHEN e > 0 THEN 1 / (e * e) ELSE 0 END))"
    return online_means(10, f"m[k][i] + CASE WHEN d[k] > 0 THEN 0.05::DOUBLE * 10 * (x[i] - m[k][i]) / (pow(d[k], 4) * pow({inverse}, 2)) ELSE 0 END")
