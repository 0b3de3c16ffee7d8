"""Counts, tracts and the forward filter over a stream of events: an extension beyond the batch engine."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators import hmm


def window_counts(events: DataFrame, kinds: dict[str, str], width: str, late: str) -> DataFrame:
    """Counts of each kind by haplotype and window of events (hap, ts, kind); rows later than late are dropped by the
    watermark, and a window is emitted once it is closed."""
    return (
        events.withWatermark("ts", late)
        .groupBy("hap", F.window("ts", width).alias("w"))
        .agg(*[F.count_if(F.col("kind") == k).alias(o) for k, o in kinds.items()])
        .select("hap", F.col("w.start").alias("start"), F.col("w.end").alias("end"), *kinds.values())
    )


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Stretches of one kind without a pause of gap: hap, kind, start, end, n."""
    return events.withWatermark("ts", late).groupBy("hap", "kind", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("hap", "kind", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def forward_filter(counts: DataFrame, rates: Sequence[float], log_trans: np.ndarray) -> DataFrame:
    """State probabilities given all windows so far, for a stream of counts (hap, win, o_*, l_mod, l_anc) that comes in the
    order of win for each haplotype: hap, win, g0..g4. The state kept for a haplotype is five numbers."""
    lam, trans = np.asarray(rates, float), np.exp(log_trans)

    def step(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        prior = np.array(state.get[0]) if state.exists else None
        for b in batches:
            b = b.sort_values("win")
            obs = np.stack([b[o].to_numpy(float)[None] for o in hmm.OBS])
            exposure = np.stack([b["l_anc" if o == "o_nd" else "l_mod"].to_numpy(float)[None] for o in hmm.OBS])
            emit = hmm.log_emissions(obs, exposure, lam)[0]
            rows = []
            for score in emit:
                x = (np.full(5, 0.2) if prior is None else prior @ trans) * np.exp(score - score.max())
                prior = x / x.sum()
                rows.append(prior)
            yield pd.DataFrame(np.array(rows).reshape(-1, 5), columns=[f"g{i}" for i in range(5)]).assign(hap=key[0], win=b["win"].to_numpy())[["hap", "win", *(f"g{i}" for i in range(5))]]
        if prior is not None:
            state.update((prior.tolist(),))

    out = "hap long, win long, " + ", ".join(f"g{i} double" for i in range(5))
    return counts.groupBy("hap").applyInPandasWithState(step, out, "p array<double>", "append", "NoTimeout")
