"""The model over blocks of windows, so that one haplotype is many tasks.

What a block does to the state before it is a 5 x 5 product: the best score (Viterbi) or the total weight (forward) from each
first to each last state. Products are associative: every block makes its own, a scan over a haplotype's products, a row of
25 numbers for each block, gives each block what comes from before and what follows, and every block replays its windows
from there. Viterbi scores are whole numbers (hmm.whole), so paths are those of the kernel over whole haplotypes, ties too."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import hmm
from strandloom.operators.hmm import LOW, whole

#: Windows of a block.
BLOCK = 4096


def pack(rows: DataFrame, keys: Sequence[str], block: int = BLOCK) -> DataFrame:
    """A row for each key and block of windows: see hmm.pack. Blocks are counted from window 0; a key's windows may begin
    anywhere and leave some out."""
    return hmm.pack(rows.withColumn("block", F.floor(F.col("win") / block)), [*keys, "block"])


def best_products(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """[m, 5, 5] of whole scores [m, n, 5]: the best from each state of the first window to each of the last."""
    m, n, k = emit.shape
    best = np.full((m, k, k), LOW)
    best[:, np.arange(k), np.arange(k)] = emit[:, 0]
    for t in range(1, n):
        best = (best[:, :, :, None] + trans).max(2) + emit[:, t, None]
        best -= best.max((1, 2), keepdims=True)
    return best


def replayed(emit: np.ndarray, trans: np.ndarray, entry: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """[n, m, 5]: the state before each state of each window, for blocks entered with the scores entry [m, 5] of the window
    before them; those that begin a haplotype have none before."""
    m, n, k = emit.shape
    back = np.zeros((n, m, k), np.int8)
    step = entry[:, :, None] + trans
    back[0] = step.argmax(1)
    best = np.where(begins[:, None], 0, step.max(1)) + emit[:, 0]
    for t in range(1, n):
        best = best - best.max(1, keepdims=True)
        step = best[:, :, None] + trans
        back[t] = step.argmax(1)
        best = step.max(1) + emit[:, t]
    return back


def total_products(like: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[m, 5, 5] of weights [m, n, 5], each row scaled to sum to one, and the logarithms [m, 5] of what was taken out."""
    m, n, k = like.shape
    total, logs = np.zeros((m, k, k)), np.zeros((m, k))
    total[:, np.arange(k), np.arange(k)] = 1
    for t in range(n):
        total = (total @ trans if t else total) * like[:, t, None]
        size = total.sum(2) + 1e-300
        total, logs = total / size[:, :, None], logs + np.log(size)
    return total, logs


def smooth(like: np.ndarray, trans: np.ndarray, entry: np.ndarray, begins: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """State probabilities [m, n, 5], expected pairs of states of neighbouring windows [m, 5, 5] and log likelihood [m] of
    weights [m, n, 5]; entry holds the shares of the window before, after the backward weights of the last window."""
    m, n, k = like.shape
    alpha, scale = np.empty((m, n, k)), np.empty((m, n))
    for t in range(n):
        x = (alpha[:, t - 1] @ trans if t else np.where(begins[:, None], 1 / k, entry @ trans)) * like[:, t]
        scale[:, t] = x.sum(1) + 1e-300
        alpha[:, t] = x / scale[:, t, None]
    gamma, pairs, beta = alpha.copy(), np.zeros((m, k, k)), after
    for t in range(n - 1, -1, -1):
        gamma[:, t] *= beta
        ahead = like[:, t] * beta
        both = (alpha[:, t - 1] if t else np.where(begins[:, None], 0.0, entry))[:, :, None] * trans * ahead[:, None]
        pairs += both / (both.sum((1, 2), keepdims=True) + 1e-300)
        beta = ahead @ trans.T / scale[:, t, None]
        beta /= beta.max(1, keepdims=True) + 1e-300
    gamma /= gamma.sum(2, keepdims=True) + 1e-300
    return gamma, pairs, np.log(scale).sum(1)


def _kinds(df: DataFrame, *names: str) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return ", ".join(f"{n} {kinds[n]}" for n in names)


#: What scans give to blocks.
MET = ("entry", "begins", "after", "last", "exit")


def _each(packed: DataFrame, keep: Sequence[str], schema: str, rates: Sequence[float], make: Callable) -> DataFrame:
    """make(part, scores, obs, exposure) -> columns, over groups of blocks of one length; keep of their columns stay."""
    lam = np.asarray(rates, float)
    packed = packed.select(*dict.fromkeys([*keep, *hmm.READ, *(c for c in packed.columns if c in MET)]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, obs, exposure in hmm._batches(batches):
            yield part[list(keep)].assign(**make(part, hmm.log_emissions(obs, exposure, lam), obs, exposure))

    return packed.mapInPandas(run, f"{_kinds(packed, *keep)}, {schema}")


def _runs(batches: Iterator[pd.DataFrame], keys: Sequence[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """The rows of whole keys, as many as a batch has, of batches that come in order of keys, and where each key begins."""
    held = None
    for b in batches:
        b = b if held is None else pd.concat([held, b], ignore_index=True)
        if not len(b):
            continue
        now, before = b[list(keys)], b[list(keys)].shift()
        new = ((now != before) & ~(now.isna() & before.isna())).any(axis=1).to_numpy()
        new[0] = True
        begins = np.flatnonzero(new)
        if len(begins) > 1:
            yield b.iloc[: begins[-1]], begins[:-1]
        held = b.iloc[begins[-1] :]
    if held is not None:
        yield held, np.zeros(1, np.int64)


def _scan(rows: DataFrame, keys: Sequence[str], schema: str, make: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]]) -> DataFrame:
    """make(columns) -> columns, for all keys of a batch that have as many blocks: columns are arrays [keys, blocks in order,
    ...], so a step along the blocks is one vector operation. A row for each block comes and goes."""
    keep = [*keys, "block"]
    read = [c for c in rows.columns if c not in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, begins in _runs(batches, keys):
            sizes = np.diff(np.append(begins, len(b)))
            for n in np.unique(sizes):
                at = (begins[sizes == n][:, None] + np.arange(n)).ravel()
                part = b.iloc[at]
                made = make({c: np.stack(part[c].to_list()).reshape(len(at) // n, n, *np.shape(part[c].iloc[0])) for c in read})
                yield part[keep].assign(**{c: list(x.reshape(len(at), *x.shape[2:])) for c, x in made.items()})

    return rows.repartition(*keys).sortWithinPartitions(*keep).mapInPandas(run, f"{_kinds(rows, *keep)}, {schema}")


def _first(k: int, n: int) -> np.ndarray:
    return np.repeat(np.arange(n)[None] == 0, k, 0)


def decode(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray, mask: bool = True) -> DataFrame:
    """hmm.decode over blocks. packed is read three times and should be cached; on (keys, block) it is not dealt anew."""
    trans, at = whole(log_trans), [*keys, "block"]
    made = _each(packed, at, "m array<bigint>", rates, lambda part, score, *_: {"m": list(best_products(whole(score), trans).reshape(len(part), 25))})

    def entries(x: dict) -> dict:
        k, n, _ = x["m"].shape
        m, out, v = x["m"].reshape(k, n, 5, 5), np.zeros((k, n, 5), np.int64), np.zeros((k, 5), np.int64)
        for i in range(n):
            out[:, i] = v
            before = (v[:, :, None] + trans).max(1) if i else v
            v = (before[:, :, None] + m[:, i]).max(1)
            v = v - v.max(1, keepdims=True)
        return {"entry": out, "begins": _first(k, n), "last": np.repeat(v.argmax(1).astype(np.int32)[:, None], n, 1)}

    entered = _scan(made, keys, "entry array<bigint>, begins boolean, last int", entries)
    met = packed.join(entered, at)

    def back(part: pd.DataFrame, score: np.ndarray) -> np.ndarray:
        return replayed(whole(score), trans, np.stack(part["entry"].to_list()), part["begins"].to_numpy())

    def traced(back: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states [m, n] that lead to last [m], and the state before them."""
        n, m, _ = back.shape
        path, row = np.empty((m, n), np.int32), np.arange(m)
        for t in range(n - 1, -1, -1):
            path[:, t] = last
            last = back[t, row, last]
        return path, last

    def led(part: pd.DataFrame, score: np.ndarray, *_) -> dict:
        b = back(part, score)
        return {"led": list(np.stack([traced(b, np.full(len(part), q))[1] for q in range(5)], 1).astype(np.int32))}

    def exits(x: dict) -> dict:
        k, n, _ = x["led"].shape
        out, q = np.zeros((k, n), np.int32), x["last"][:, -1]
        for i in range(n - 1, -1, -1):
            out[:, i] = q
            q = x["led"][np.arange(k), i, q]
        return {"exit": out}

    left = _scan(_each(met, [*at, "last"], "led array<int>", rates, led), keys, "exit int", exits)

    def states(part: pd.DataFrame, score: np.ndarray, obs: np.ndarray, exposure: np.ndarray) -> dict:
        path = traced(back(part, score), part["exit"].to_numpy())[0]
        if mask:
            path[(exposure[0] == 0) & (exposure[3] == 0)] = -1
        return {"state": list(path)}

    out = _each(met.join(left, at), [*keys, "win", "s", "e"], "state array<int>", rates, states)
    return out.select(*keys, F.explode(F.arrays_zip("win", "s", "e", "state")).alias("x")).select(*keys, "x.win", "x.s", "x.e", "x.state")


def _weights(score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = score.max(2)
    return np.exp(score - top[:, :, None]), top.sum(1)


def _entered(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], trans: np.ndarray) -> DataFrame:
    """packed with entry, begins and after of each block, and loglik of the haplotype."""

    def products(part: pd.DataFrame, score: np.ndarray, *_) -> dict:
        like, top = _weights(score)
        total, logs = total_products(like, trans)
        return {"m": list(total.reshape(len(part), 25)), "logs": list(logs + top[:, None])}

    def scan(x: dict) -> dict:
        k, n, _ = x["logs"].shape
        m, logs, entry, after = x["m"].reshape(k, n, 5, 5), x["logs"], np.empty((k, n, 5)), np.empty((k, n, 5))
        ll, v, beta = np.zeros(k), np.full((k, 5), 0.2), np.ones((k, 5))
        for i in range(n):
            entry[:, i] = v
            w = v @ trans if i else v
            top = np.where(w > 0, logs[:, i], -np.inf).max(1)
            v = ((w * np.exp(np.minimum(logs[:, i] - top[:, None], 0.0)))[:, None] @ m[:, i])[:, 0]
            ll, v = ll + top + np.log(v.sum(1)), v / v.sum(1, keepdims=True)
        for i in range(n - 1, -1, -1):
            after[:, i] = beta
            beta = (np.exp(logs[:, i] - logs[:, i].max(1, keepdims=True)) * (m[:, i] @ beta[:, :, None])[:, :, 0]) @ trans.T
            beta = beta / beta.max(1, keepdims=True)
        return {"entry": entry, "begins": _first(k, n), "after": after, "loglik": np.repeat(ll[:, None], n, 1)}

    at = [*keys, "block"]
    made = _each(packed, at, "m array<double>, logs array<double>", rates, products)
    return packed.join(_scan(made, keys, "entry array<double>, begins boolean, after array<double>, loglik double", scan), at)


def _smoothed(part: pd.DataFrame, score: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    like, top = _weights(score)
    m = len(part)
    entry, begins, after = (np.stack(part["entry"].to_list()), part["begins"].to_numpy(), np.stack(part["after"].to_list())) if "entry" in part else (np.zeros((m, 5)), np.ones(m, bool), np.ones((m, 5)))
    gamma, pairs, ll = smooth(like, trans, entry, begins, after)
    return gamma, pairs, ll + top


def posteriors(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray) -> DataFrame:
    """hmm.posteriors over blocks."""
    trans = np.exp(log_trans)
    made = _each(_entered(packed, keys, rates, trans), [*keys, "win", "loglik"], hmm.BY_STATE, rates, lambda part, score, *_: hmm.by_state(_smoothed(part, score, trans)[0]))
    return hmm.each_window(made, keys)


SUMS = [*(f"num{i}" for i in range(5)), *(f"den{i}" for i in range(5))]
PAIRS = [f"xi{p}{q}" for p in range(5) for q in range(5)]


def expectations(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray) -> DataFrame:
    """SUMS, PAIRS and loglik of each row of packed, whose sums are those of all windows: of each block where packed has
    blocks, else of each haplotype. PAIRS are the expected numbers of neighbours in states p and q."""
    trans = np.exp(log_trans)
    rows = _entered(packed, keys, rates, trans).drop("loglik") if "block" in packed.columns else packed

    def sums(part: pd.DataFrame, score: np.ndarray, obs: np.ndarray, exposure: np.ndarray) -> dict:
        gamma, pairs, ll = _smoothed(part, score, trans)
        num, den = hmm.sufficient(gamma, obs, exposure)
        return dict(zip([*SUMS, *PAIRS], np.hstack([num, den, pairs.reshape(-1, 25)]).T)) | {"loglik": ll}

    return _each(rows, keys, ", ".join(f"{n} double" for n in [*SUMS, *PAIRS, "loglik"]), rates, sums)
