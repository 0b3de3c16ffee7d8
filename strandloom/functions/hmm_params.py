"""Rates and transitions of the five-state model: plain numbers on the driver, and columns for tables of parameters."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order of the rates; fixed values.
RATES = ("i", "n", "af", "ea", "mex")


@dataclass(frozen=True)
class Transitions:
    """Times in generations, rate by unit, unit length of a window, admixture shares."""

    ti: float
    tmex: float
    rr: float
    a: float
    b: float
    c1: float
    c2: float
    width: float

    def log_matrix(self) -> np.ndarray:
        """5 x 5, from row to column. A lineage keeps its state through both epochs, or is drawn anew in the later one
        (by ancestry, then archaic or not) or in the earlier one (archaic or not, within its ancestry)."""
        scale = self.rr * self.width
        stay, early, late = math.exp(-self.ti * scale), math.exp(-(self.ti - self.tmex) * scale), math.exp(-self.tmex * scale)
        drawn = (1 - late) * np.array([self.a, self.b, 1 - self.a - self.b])
        archaic = np.array([[1 - self.c1, self.c1], [1 - self.c2, self.c2]])
        out = np.zeros((5, 5))
        out[:, 4] = drawn[2]
        out[4, 4] += late
        for to in (0, 1):
            block = slice(2 * to, 2 * to + 2)
            out[:, block] = drawn[to] * archaic[to]
            out[block, block] = ((1 - early) * late + drawn[to]) * archaic[to] + stay * np.eye(2)
        return np.log(np.maximum(out, 1e-300))


def from_config(p: dict) -> tuple[np.ndarray, Transitions]:
    """Starting rates and transitions of a run's parameters_initial."""
    theta = p["mutation"] * p["window_length"] / p["generation_time"]
    rates = theta * np.array([p[f"t_{x}_c"] for x in ("introgression", "n", "af", "ea", "mexicans")], float)
    a, b = p["admixture_modern"][:2]
    years = p["generation_time"]
    return rates, Transitions(p["t_introgression"] / years, p["t_mexicans"] / years, p["rr"], a, b, p["admixture_nd"], p["admixture_nd"], p["window_length"])


def rate_columns(mutation: Column, window_length: Column, generation_time: Column, times: dict[str, Column]) -> dict[str, Column]:
    """Starting rates of a table of parameters; times has the coalescence time of each of RATES."""
    theta = mutation * window_length / generation_time
    return {r: theta * times[r] for r in RATES}


def transition_columns(ti: Column, tmex: Column, rr: Column, a: Column, b: Column, c1: Column, c2: Column, width: Column) -> list[list[Column]]:
    """Transitions.log_matrix of a table of parameters: 5 x 5 columns of probabilities."""
    scale = rr * width
    stay, early, late = F.exp(-ti * scale), F.exp(-(ti - tmex) * scale), F.exp(-tmex * scale)
    drawn = [(1 - late) * x for x in (a, b, 1 - a - b)]
    archaic = [[1 - c1, c1], [1 - c2, c2]]
    out = []
    for p in range(5):
        row = []
        for q in range(5):
            if q == 4:
                row.append(drawn[2] + late if p == 4 else drawn[2])
                continue
            kept = drawn[q // 2] if p == 4 or p // 2 != q // 2 else (1 - early) * late + drawn[q // 2]
            row.append(kept * archaic[q // 2][q % 2] + (stay if p == q else 0))
        out.append(row)
    return out
