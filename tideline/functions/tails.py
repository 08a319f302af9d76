"""Tail probabilities on the driver, for a handful of coefficients."""

from __future__ import annotations

import math


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_upper(z: float) -> float:
    return math.erfc(z / math.sqrt(2)) / 2


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)) / a
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1 - (a + b) * x / (a + 1), 1e-300)
    f = d
    for m in range(1, 400):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def t_two_sided(t: float, dof: float) -> float:
    return incomplete_beta(dof / 2, 0.5, dof / (dof + t * t))


def correlation_p(r: float | None, n: int) -> float | None:
    """Two-sided p of a correlation of n pairs by the t distribution with n - 2 degrees of freedom."""
    if r is None or n < 3:
        return None
    if abs(r) >= 1:
        return 0.0
    return t_two_sided(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)


def kendall_exact(discordant: int, n: int) -> float:
    """Two-sided p of `discordant` inversions among n values without ties, by counting permutations."""
    ways = [1.0]
    for k in range(2, n + 1):  # a k-th value adds 0 .. k-1 inversions
        sums, total, out = [0.0, *ways], 0.0, []
        for i in range(1, len(sums)):
            sums[i] += sums[i - 1]
        for i in range(len(ways) + k - 1):
            hi, lo = min(i + 1, len(ways)), max(0, i + 1 - k)
            total = (sums[hi] - sums[lo]) / k
            out.append(total)
        ways = out
    low = min(discordant, n * (n - 1) // 2 - discordant)
    return min(1.0, 2 * sum(ways[: low + 1]))


def kendall_p(con_minus_dis: float, discordant: float, n: int, ties_x: tuple[float, float, float], ties_y: tuple[float, float, float]) -> float | None:
    """Exact for up to 33 values without ties, else normal with the variance corrected for ties.

    ties_x, ties_y: sums over groups of t equal values of t(t-1), t(t-1)(t-2) and t(t-1)(2t+5).
    """
    if n < 2:
        return None
    if not ties_x[0] and not ties_y[0] and n <= 33:
        return kendall_exact(int(discordant), n)
    m = float(n) * (n - 1)
    var = (m * (2 * n + 5) - ties_x[2] - ties_y[2]) / 18 + ties_x[0] * ties_y[0] / (2 * m)
    if n > 2:
        var += ties_x[1] * ties_y[1] / (9 * m * (n - 2))
    return normal_two_sided(con_minus_dis / math.sqrt(var)) if var > 0 else None
