"""The two runs of the engine, from counts to segments."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame

from strandloom.functions.hmm_params import Transitions
from strandloom.operators import em_state, hmm, hmm_blocks, hmm_refit, intervals, tracts


def _segments(tracts_: DataFrame, gaps: DataFrame | None, width: int) -> DataFrame:
    if gaps is not None:
        tracts_ = tracts.clean_gaps(tracts_, intervals.merge(gaps, ["chrom"]), ["chrom"], width)
    return tracts.inclusive(tracts_)


def _packed(counts: DataFrame, keys: Sequence[str], block: int | None) -> DataFrame:
    return hmm_blocks.pack(counts, keys, block) if block else hmm.pack(counts, keys)


def _decoded(packed: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray, mask: bool) -> DataFrame:
    return (hmm_blocks if "block" in packed.columns else hmm).decode(packed, keys, rates, log_trans, mask)


def em_run(
    counts: DataFrame, keys: Sequence[str], rates: Sequence[float], trans: Transitions | np.ndarray, gaps: DataFrame | None, width: int, steps: int = 20,
    block: int | None = None, refit: bool = False, state: str | None = None,
) -> tuple[DataFrame, np.ndarray, list[float]]:
    """Segments with fitted rates: counts without exposure are zeroed, windows without any are absorbed. counts has rows
    (keys, win, s, e, o_*, l_mod, l_anc); they are packed once and every step reads them: from memory, which is freed when the
    steps are done (decoding packs anew), or with state, a path in the shared folder, from a table there, beside which
    each step is kept, so that a run that was stopped goes on; a folder that another start was made in is refused. block: windows of a block, for haplotypes of very many windows.
    refit: transitions, then given as Transitions, are fitted too."""
    spark = counts.sparkSession
    fresh = _packed(hmm.zero_uncovered(counts), keys, block)
    if state:
        shown = trans if isinstance(trans, Transitions) else np.asarray(trans).tolist()
        em_state.guard(spark, f"{state}/start", f"{list(map(float, rates))} {shown} {block} {refit}")
        if not em_state.table(spark, f"{state}/packed"):
            fresh.write.mode("overwrite").parquet(f"{state}/packed")
        packed = fresh = spark.read.schema(fresh.schema).parquet(f"{state}/packed")
    else:
        packed = fresh.persist()
    at = f"{state}/steps" if state else None
    if refit:
        fitted, trans, seen = hmm_refit.em(packed, keys, rates, trans, steps, state=at)
    log_trans = trans.log_matrix() if isinstance(trans, Transitions) else trans
    if not refit:
        expect = hmm_blocks.expectations if block else hmm.expectations
        fitted, seen = hmm.em(packed, keys, rates, log_trans, steps, expect=expect, state=at)
    if not state:
        packed.unpersist()
        fresh = _packed(hmm.zero_uncovered(counts), keys, block)
    path = _decoded(fresh, keys, fitted, log_trans, True)
    return _segments(tracts.absorb_tracts(path, keys), gaps, width), fitted, seen


def fixed_run(counts: DataFrame, keys: Sequence[str], rates: Sequence[float], log_trans: np.ndarray, gaps: DataFrame | None, width: int, block: int | None = None) -> DataFrame:
    """Segments with given rates: nothing is zeroed or masked, and every change of state cuts."""
    path = _decoded(_packed(counts, keys, block), keys, rates, log_trans, False)
    return _segments(tracts.split_tracts(path, keys), gaps, width)
