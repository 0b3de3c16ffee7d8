"""The Poisson hidden Markov model: emissions as columns, decoding and expectation as kernels over packed sequences.

pack() puts a haplotype's windows into arrays once, by one shuffle; kernels then take batches of haplotypes of one length
together, so that a step of the recursion is one vector operation over all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.operators import em_state

OBS = ("o_eu", "o_na", "o_af", "o_nd")
#: Of each state, the rate (index in RATES) that each of OBS is drawn from. Fixed values.
PANELS = ((4, 3, 2, 1), (4, 3, 1, 0), (3, 4, 2, 1), (3, 4, 1, 0), (2, 2, 4, 1))


def zero_uncovered(rows: DataFrame) -> DataFrame:
    """Counts in windows without exposure become 0."""
    return rows.withColumns({o: F.when(F.col(_exposure(o)) > 0, F.col(o)).otherwise(0) for o in OBS})


def _exposure(o: str) -> str:
    return "l_anc" if o == "o_nd" else "l_mod"


def invalid_windows(rows: DataFrame) -> DataFrame:
    """One row: windows with counts but no exposure, modern and ancient."""
    return rows.agg(
        F.count_if((F.col("l_mod") <= 0) & (F.col("o_eu") + F.col("o_na") + F.col("o_af") > 0)).alias("invalid_modern"),
        F.count_if((F.col("l_anc") <= 0) & (F.col("o_nd") > 0)).alias("invalid_ancient"),
    )


def component(o: str, rate: float) -> Column:
    """Poisson log score of a count without its factorial, 0 without exposure."""
    n, x = F.col(o), F.col(_exposure(o))
    return F.when(x > 0, n * F.lit(float(np.log(rate + 1e-300))) - F.lit(float(rate)) * x).otherwise(F.lit(0.0))


def emissions(rows: DataFrame, rates: Sequence[float]) -> DataFrame:
    """rows with e0 to e4, the log score of each state."""
    return rows.withColumns({f"e{s}": sum((component(o, rates[r]) for o, r in zip(OBS[1:], panel[1:], strict=True)), component(OBS[0], rates[panel[0]])) for s, panel in enumerate(PANELS)})


def pack(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each key: windows in order and their counts and exposures as arrays."""
    names = ["win", "s", "e", *OBS, "l_mod", "l_anc"]
    seq = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*names))).alias("x"))
    return seq.select(*keys, *[F.col(f"x.{c}").alias(c) for c in names])


def log_emissions(obs: np.ndarray, exposure: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """[m, n, 5] of counts and exposures [4, m, n]; each panel's score is made once and added where it belongs."""
    out = np.zeros((*obs.shape[1:], len(PANELS)))
    for k in range(len(OBS)):
        covered = exposure[k] > 0
        for r in {panel[k] for panel in PANELS}:
            score = np.where(covered, obs[k] * np.log(rates[r] + 1e-300) - exposure[k] * rates[r], 0.0)
            for state, panel in enumerate(PANELS):
                if panel[k] == r:
                    out[:, :, state] += score
    return out


#: Units of a log score, and a whole score that no state with a score has.
UNITS, LOW = 1 << 30, -(1 << 61)


def whole(scores: np.ndarray) -> np.ndarray:
    """Log scores as whole numbers of 2^-30, less the greatest of each last axis for emissions [m, n, 5]: sums of them are
    exact in any order, so ties are ties and blocks of windows can be put together. Below -2^29 they are not told apart."""
    if scores.ndim == 3:
        scores = scores - scores.max(2, keepdims=True)
    return np.rint(np.maximum(scores, -float(1 << 29)) * UNITS).astype(np.int64)


def viterbi(emit: np.ndarray, log_trans: np.ndarray) -> np.ndarray:
    """Best paths of [m, n, 5] log scores from a uniform start; of equal scores the lowest state."""
    m, n, k = emit.shape
    emit, trans = whole(emit), whole(log_trans)
    best = emit[:, 0]
    back = np.zeros((n, m, k), np.int8)
    for t in range(1, n):
        step = best[:, :, None] + trans
        back[t] = step.argmax(1)
        best = step.max(1) + emit[:, t]
        best -= best.max(1, keepdims=True)
    path = np.zeros((m, n), np.int32)
    path[:, -1] = best.argmax(1)
    for t in range(n - 1, 0, -1):
        path[:, t - 1] = back[t, np.arange(m), path[:, t]]
    return path


def forward_backward(emit: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """State probabilities [m, n, k] and log likelihood [m] of log scores from a uniform start. The greatest score of each
    window is taken out before exp() and put back into the likelihood, so none underflows."""
    m, n, k = emit.shape
    top = emit.max(2)
    likely = np.exp(emit - top[:, :, None])
    gamma, scale = np.empty((m, n, k)), np.empty((m, n))
    for t in range(n):
        x = (gamma[:, t - 1] @ trans if t else np.full((m, k), 1 / k)) * likely[:, t]
        scale[:, t] = x.sum(1) + 1e-300
        gamma[:, t] = x / scale[:, t, None]
    # The forward shares are multiplied by the backward ones in place.
    beta = np.ones((m, k))
    for t in range(n - 1, -1, -1):
        gamma[:, t] *= beta
        beta = (likely[:, t] * beta) @ trans.T / scale[:, t, None]
    gamma /= gamma.sum(2, keepdims=True) + 1e-300
    return gamma, np.log(scale).sum(1) + top.sum(1)


def sufficient(gamma: np.ndarray, obs: np.ndarray, exposure: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expected counts and exposures of each rate, [m, 5] each: every panel of every state gives to its rate."""
    m = gamma.shape[0]
    num, den = np.zeros((m, 5)), np.zeros((m, 5))
    covered = exposure > 0
    for state, panel in enumerate(PANELS):
        for k, r in enumerate(panel):
            num[:, r] += (gamma[:, :, state] * np.where(covered[k], obs[k], 0)).sum(1)
            den[:, r] += (gamma[:, :, state] * np.where(covered[k], exposure[k], 0)).sum(1)
    return num, den


#: Bytes of one [m, n, 5] array of a kernel, about: haplotypes of one length go through it in groups of that size, one at
#: least. A kernel holds three such arrays, and its group's rows on their way out.
KERNEL_BYTES = 4 << 20
#: Columns that kernels read of packed rows.
READ = (*OBS, "l_mod", "l_anc")


def _batches(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray]]:
    for b in batches:
        for n, same in b.groupby(b[OBS[0]].map(len), sort=False):
            many = max(1, KERNEL_BYTES // (40 * max(n, 1)))
            for part in (same.iloc[lo : lo + many] for lo in range(0, len(same), many)):
                yield part, *_arrays(part)


def _arrays(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    stack = lambda c: np.stack(part[c].to_list()).astype(float)
    modern, ancient = stack("l_mod"), stack("l_anc")
    exposure = np.stack([ancient if _exposure(o) == "l_anc" else modern for o in OBS])
    return np.stack([stack(o) for o in OBS]), exposure


def decode(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray, mask: bool = True) -> DataFrame:
    """Rows (keys, win, s, e, state) of the best path; with mask, -1 in windows that have no exposure at all."""
    lam = np.asarray(rates, float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, obs, exposure in _batches(batches):
            path = viterbi(log_emissions(obs, exposure, lam), log_trans)
            if mask:
                path[(exposure[0] == 0) & (exposure[3] == 0)] = -1
            yield part[[*keys, "win", "s", "e"]].assign(state=list(path))

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{c} {kinds[c]}" for c in ("win", "s", "e")), "state array<int>"])
    out = packed.mapInPandas(run, schema).select(*keys, F.explode(F.arrays_zip("win", "s", "e", "state")).alias("x"))
    return out.select(*keys, "x.win", "x.s", "x.e", "x.state")


#: Probabilities go out as an array for each state: one for each window would be an object in Python for each.
BY_STATE = ", ".join(f"g{i} array<double>" for i in range(5))


def by_state(gamma: np.ndarray) -> dict[str, list[np.ndarray]]:
    return {f"g{i}": list(np.ascontiguousarray(gamma[:, :, i])) for i in range(5)}


def each_window(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each window of rows (keys, win, g0..g4, loglik) of arrays."""
    names = ["win", *(f"g{i}" for i in range(5))]
    return rows.select(*keys, "loglik", F.explode(F.arrays_zip(*names)).alias("x")).select(*keys, *[F.col(f"x.{n}").alias(n) for n in names], "loglik")


def posteriors(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray) -> DataFrame:
    """Rows (keys, win, g0..g4, loglik): state probabilities of each window."""
    lam, trans = np.asarray(rates, float), np.exp(log_trans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, obs, exposure in _batches(batches):
            gamma, ll = forward_backward(log_emissions(obs, exposure, lam), trans)
            yield part[[*keys, "win"]].assign(**by_state(gamma), loglik=ll)

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"win {kinds['win']}", BY_STATE, "loglik double"])
    return each_window(packed.select(*keys, "win", *READ).mapInPandas(run, schema), keys)


def expectations(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray) -> DataFrame:
    """A row for each key: num0..num4, den0..den4, loglik."""
    lam, trans = np.asarray(rates, float), np.exp(log_trans)
    names = [*(f"num{i}" for i in range(5)), *(f"den{i}" for i in range(5))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, obs, exposure in _batches(batches):
            gamma, ll = forward_backward(log_emissions(obs, exposure, lam), trans)
            num, den = sufficient(gamma, obs, exposure)
            out = part[list(keys)].reset_index(drop=True)
            yield out.join(pd.DataFrame(np.hstack([num, den]), columns=names)).assign(loglik=ll)

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema.fields}
    return packed.select(*keys, *READ).mapInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"{n} double" for n in names), "loglik double"]))


def maximised(rates: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    """Rates after one step; one without exposure stays."""
    return np.where(den > 1e-8, num / (den + 1e-20), rates)


def em(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray, steps: int = 20, tol: float = 1e-8, expect: Callable[..., DataFrame] = expectations, state: str | None = None) -> tuple[np.ndarray, list[float]]:
    """Rates, and the log likelihood before each step. packed should be cached: every step reads it, and only eleven sums
    come to the driver. They are sums of decimals, so the order in which tasks end changes none. expect is hmm_blocks.expectations
    where packed has blocks. With state, a path, each step is kept there and steps found there are not made again."""
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,12)"))
    lam, seen = np.asarray(rates, float), []
    if state:
        seen, last = em_state.seen(packed.sparkSession, state)
        lam = lam if last is None else last
    while len(seen) < steps and not (len(seen) > 1 and abs(seen[-1] - seen[-2]) < tol):
        row = expect(packed, keys, lam, log_trans).agg(*[exact(f"num{i}") for i in range(5)], *[exact(f"den{i}") for i in range(5)], exact("loglik")).first()
        if row[10] is None:
            return lam, seen
        seen.append(float(row[10]))
        lam = maximised(lam, np.array(row[:5], float), np.array(row[5:10], float))
        if state:
            em_state.add(packed.sparkSession, state, len(seen), seen[-1], lam)
    return lam, seen


def sample(spark, haps: int, windows: int, rates: Sequence[float], log_trans: np.ndarray, seed: int = 1) -> DataFrame:
    """Rows (chrom, hap, win, s, e, o_*, l_mod, l_anc, state) drawn from the model, a haplotype in a task of its own."""
    lam, trans = np.asarray(rates, float), np.exp(log_trans)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for hap in b["id"].tolist():
                rng = np.random.default_rng((seed, hap))
                state = np.zeros(windows, int)
                state[0] = rng.integers(5)
                draws, cum = rng.random(windows), trans.cumsum(1)
                for t in range(1, windows):
                    state[t] = min(int(np.searchsorted(cum[state[t - 1]], draws[t])), 4)
                panels = np.array(PANELS)[state]
                obs = rng.poisson(lam[panels])
                win = np.arange(windows)
                yield pd.DataFrame({"chrom": "chr1", "hap": hap, "win": win, "s": win * 1000, "e": win * 1000 + 1000, **{o: obs[:, k] for k, o in enumerate(OBS)}, "l_mod": 1.0, "l_anc": 1.0, "state": state})

    return spark.range(haps).repartition(haps if haps < 64 else 64).mapInPandas(run, "chrom string, hap long, win long, s long, e long, o_eu long, o_na long, o_af long, o_nd long, l_mod double, l_anc double, state int")


def exposure_summary(rows: DataFrame) -> DataFrame:
    """One row: windows with both exposures, one of them, or none."""
    mod, anc = F.col("l_mod") > 0, F.col("l_anc") > 0
    return rows.agg(F.count_if(mod & anc).alias("both"), F.count_if(mod & ~anc).alias("mod_only"), F.count_if(~mod & anc).alias("anc_only"), F.count_if(~mod & ~anc).alias("neither"))


def max_count(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: the greatest count and where it stands first, by keys, window and panel."""
    long = rows.select(*keys, "win", F.explode(F.array(*[F.struct(F.lit(k).alias("panel"), F.col(o).alias("n")) for k, o in enumerate(OBS)])).alias("x"))
    order = [F.desc("x.n"), *keys, "win", "x.panel"]
    return long.orderBy(*order).limit(1).select(F.col("x.n").alias("n"), *keys, "win", F.get(F.array(*[F.lit(o) for o in OBS]), F.col("x.panel")).alias("panel"))


