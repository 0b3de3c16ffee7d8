"""EM that fits the transitions as well: admixture shares and the archaic share, from expected pairs of states.

Rates have their closed form. The transitions' three free numbers are raised by a quasi-Newton search on the driver, over the 25
sums that a step brings there; a step never lowers the likelihood but for the pull towards the last values."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import em_state, hmm, hmm_blocks

#: Greatest archaic share, weight of the pull towards the values before a step, least rate. Fixed values.
MOST_ARCHAIC, PULL, LEAST_RATE = 0.2, 1e-4, 1e-12


def free(t: Transitions) -> np.ndarray:
    """Unbounded numbers for a, b (against the third share) and the archaic share."""
    shares = np.clip([t.a, t.b, 1 - t.a - t.b], 1e-12, 1)
    c = np.clip(t.c1 / MOST_ARCHAIC, 1e-11, 1 - 1e-11)
    return np.array([*np.log(shares[:2] / shares[2]), np.log(c / (1 - c))])


def bound(t: Transitions, x: np.ndarray) -> Transitions:
    """t with the shares that x stands for; both ancestries have one archaic share."""
    top = max(0.0, x[0], x[1])
    weight = np.exp(np.array([x[0], x[1], 0.0]) - top)
    a, b, _ = weight / weight.sum()
    c = MOST_ARCHAIC / (1 + np.exp(-np.clip(x[2], -500, 500)))
    return replace(t, a=float(a), b=float(b), c1=float(c), c2=float(c))


def lowest(f: Callable[[np.ndarray], float], x: np.ndarray, steps: int = 200, tol: float = 1e-9) -> np.ndarray:
    """A local minimum of a smooth f of few numbers: BFGS with central differences and halved steps."""
    width = 1e-6
    slope = lambda x: np.array([(f(x + d) - f(x - d)) / (2 * width) for d in np.eye(len(x)) * width])
    inverse, g, y = np.eye(len(x)), slope(x), f(x)
    for _ in range(steps):
        way = -inverse @ g
        if way @ g >= 0:
            inverse, way = np.eye(len(x)), -g
        length = min(1.0, 4.0 / (np.abs(way).max() + 1e-300))
        while length > 1e-12 and not f(x + length * way) <= y + 1e-4 * length * (way @ g):
            length /= 2
        if length <= 1e-12:
            break
        s = length * way
        x, after = x + s, f(x + s)
        change = slope(x) - g
        g, gain, y = g + change, y - after, after
        if (sy := s @ change) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, change) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
        if gain <= tol * (abs(y) + 1) and np.abs(s).max() < 1e-6:
            break
    return x


def refitted(t: Transitions, pairs: np.ndarray) -> Transitions:
    """t with the shares under which pairs [5, 5] are likeliest, pulled a little towards those of t."""
    start = free(t)
    scale = max(float(pairs.sum()), 1.0)
    lost = lambda x: (-np.sum(pairs * bound(t, x).log_matrix()) + PULL * np.sum((x - start) ** 2)) / scale
    return bound(t, lowest(lost, start))


def sums(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """Expected counts and exposures of the rates, pairs [5, 5] and log likelihood over all rows; None if there is none."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)"))
    row = hmm_blocks.expectations(packed, keys, rates, log_trans).agg(*map(exact, [*hmm_blocks.SUMS, *hmm_blocks.PAIRS, "loglik"])).first()
    if row[-1] is None:
        return None
    x = np.array(row, float)
    return x[:5], x[5:10], x[10:35].reshape(5, 5), x[35]


def em(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], t: Transitions, steps: int = 20, tol: float = 1e-8, state: str | None = None) -> tuple[np.ndarray, Transitions, list[float]]:
    """Rates, transitions, and the log likelihood before each step: hmm.em with transitions, over packed with blocks or
    without, which should be cached."""
    lam, t, seen = np.asarray(rates, float), replace(t, c2=t.c1), []
    if state:
        seen, last = em_state.seen(packed.sparkSession, state)
        if last is not None:
            lam, t = last[:5], replace(t, a=float(last[5]), b=float(last[6]), c1=float(last[7]), c2=float(last[7]))
    while len(seen) < steps and not (len(seen) > 1 and abs(seen[-1] - seen[-2]) < tol):
        got = sums(packed, keys, lam, t.log_matrix())
        if got is None:
            break
        num, den, pairs, ll = got
        seen.append(ll)
        lam, t = np.maximum(hmm.maximised(lam, num, den), LEAST_RATE), refitted(t, pairs)
        if state:
            em_state.add(packed.sparkSession, state, len(seen), ll, [*lam, t.a, t.b, t.c1])
    return lam, t, seen
