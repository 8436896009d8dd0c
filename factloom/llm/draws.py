"""Draws without replacement of any size.

numpy's hypergeometric draw takes populations under a thousand million. Above,
the same law is drawn by rejection: a point is drawn under a table-mountain hat
around the mode (ratio of uniforms, Stadlober 1990) and accepted with the exact
probability ratio, whose logarithms have 40 digits, so that nothing is lost to
the cancelling of large terms.
"""

from __future__ import annotations

import math
from decimal import Decimal, localcontext

import numpy as np

#: numpy's own limit of a population.
NUMPY_LIMIT = 1_000_000_000
DIGITS = 40
#: Fixed values of the hat: 2 sqrt(2 / e) and 3 - 2 sqrt(3 / e).
WIDTH, SLACK = 2 * math.sqrt(2 / math.e), 3 - 2 * math.sqrt(3 / math.e)
#: Coefficients of Stirling's series at n^-1, n^-3, ...
SERIES = ((1, 12), (-1, 360), (1, 1260), (-1, 1680), (1, 1188))
_TWO_PI = Decimal("6.283185307179586476925286766559005768394")


def log_factorial(n: int) -> Decimal:
    """ln(n!) to some 25 places at least, whatever the size."""
    if n < 256:
        return Decimal(math.factorial(n)).ln()
    x = Decimal(n)
    tail = sum((Decimal(a) / (b * x ** (2 * i + 1)) for i, (a, b) in enumerate(SERIES)), Decimal(0))
    return x * x.ln() - x + (_TWO_PI * x).ln() / 2 + tail


def by_rejection(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good`` + ``bad``, at any size."""
    n = good + bad
    rare, rest = min(good, bad), max(good, bad)
    m = min(draws, n - draws)
    if not m or not rare:
        few = 0
    else:
        with localcontext() as context:
            context.prec = DIGITS
            share = rare / n
            centre = m * share + 0.5
            spread = math.sqrt(m * share * (1 - share) * ((n - m) / (n - 1)) + 0.5)
            width = WIDTH * spread + SLACK
            mode = (m + 1) * (rare + 1) // (n + 2)

            def weight(x: int) -> Decimal:
                return -sum(log_factorial(k) for k in (x, rare - x, m - x, rest - m + x))

            top, last = weight(mode), min(m, rare)
            while True:
                u, v = rng.random(), rng.random()
                if not u:
                    continue
                at = math.floor(centre + width * (v - 0.5) / u)
                if max(0, m - rest) <= at <= last and 2 * math.log(u) <= float(weight(at) - top):
                    few = at
                    break
    # ``few`` rare ones are among the m: turn to the draws and to the good ones
    found = few if m == draws else rare - few
    return found if good == rare else draws - found


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` of ``good`` + ``bad`` without replacement."""
    if good + bad < NUMPY_LIMIT:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    return by_rejection(rng, good, bad, draws)


def split_draw(rng: np.random.Generator, counts: np.ndarray, draws: int) -> np.ndarray:
    """How many of each source are among ``draws`` slots, drawn without replacement from ``counts``."""
    got, rest = np.zeros_like(counts), int(counts.sum())
    if rest < NUMPY_LIMIT:
        return rng.multivariate_hypergeometric(counts, draws, method="marginals")
    for i, c in enumerate(counts.tolist()):
        rest -= c
        got[i] = hypergeometric(rng, c, rest, draws)
        draws -= int(got[i])
    return got
