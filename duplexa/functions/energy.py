"""The nearest-neighbour energy model: tables in 1/100 kcal/mol at 37 degrees, and vectorised loop energies.

Small tables are constants. The tables of 1x1, 1x2 and 2x2 interior loops are a parameter: `load_loops` reads them from a long table (table, t1, t2, b1..b4, value); without one, `rule_loops` makes them from a rule by closing pairs.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession

INF = 1_000_000
TURN, MAXLOOP = 3, 30
#: cal/mol
KT = (37 + 273.15) * 1.98717

# Pair types CG 1, GC 2, GU 3, UG 4, AU 5, UA 6 by bases (unknown, A, C, G, U), and the type read from the other side.
PAIR = np.array([[0, 0, 0, 0, 0], [0, 0, 0, 0, 5], [0, 0, 0, 1, 0], [0, 0, 2, 0, 3], [0, 6, 0, 4, 0]])
REVERSE = np.array([0, 2, 1, 4, 3, 6, 5])

# Stacking energies by the types of the outer pair and the inner pair, the latter read from the other side.
STACK = np.array(
    [
        [INF, INF, INF, INF, INF, INF, INF],
        [INF, -133, -207, -146, -37, -139, -132],
        [INF, -207, -205, -150, -91, -129, -123],
        [INF, -146, -150, -22, -67, -81, -58],
        [INF, -37, -91, -67, -38, -14, -2],
        [INF, -139, -129, -81, -14, -84, -69],
        [INF, -132, -123, -58, -2, -69, -68],
    ]
)
# Loop initiation by the number of unpaired bases, 0 to 30.
HAIRPIN = np.array([INF, INF, INF, 364, 282, 297, 287, 259, 259, 272, 283, 293, 303, 311, 319, 327, 334, 340, 346, 352, 358, 363, 368, 373, 377, 382, 386, 390, 394, 398, 401])
BULGE = np.array([INF, 281, 157, 201, 288, 298, 272, 288, 303, 315, 327, 337, 346, 355, 363, 370, 377, 384, 390, 396, 401, 407, 412, 416, 421, 425, 430, 434, 438, 442, 445])
INTERIOR = np.array([INF, INF, INF, INF, 83, 118, 90, 106, 121, 133, 145, 155, 164, 173, 181, 188, 195, 202, 208, 214, 219, 225, 230, 234, 239, 243, 248, 252, 256, 260, 263])
# Terminal mismatches of hairpins by pair type, then by the bases after and before the pair's partners (unknown, A, C, G, U).
MISMATCH_HAIRPIN = np.array(
    [
        [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0], [0, 0, 0, 0, 0]],
        [[0, 0, 0, 0, 0], [-90, -35, -13, 3, 13], [-90, -12, -17, -98, -22], [-90, -51, -24, -1, 3], [-90, -16, -57, -97, -38]],
        [[0, 0, 0, 0, 0], [-70, 1, -22, -65, 110], [-70, 11, -27, -17, 0], [-70, -67, 1, -45, 36], [-70, 8, -39, -55, -92]],
        [[0, 0, 0, 0, 0], [0, 60, 75, 43, 180], [0, 50, 44, 70, -1], [0, -92, 15, 39, 114], [0, 25, 7, 67, 36]],
        [[0, 0, 0, 0, 0], [0, 43, 52, 87, 109], [0, 52, 35, -10, 40], [0, -26, -28, 5, 92], [0, 42, -38, -14, -30]],
        [[0, 0, 0, 0, 0], [0, 41, 77, 65, 117], [0, -2, 8, 44, 43], [0, -31, 23, 15, 60], [0, 29, -6, 32, -10]],
        [[0, 0, 0, 0, 0], [0, 17, 52, 76, 68], [0, 53, 36, 37, 11], [0, -39, 46, 16, 68], [0, 50, -16, 46, 29]],
    ]
)
# Dangling bases by pair type (none, CG, GC, GU, UG, AU, UA) and base (unknown, A, C, G, U).
DANGLE5 = np.array([[INF] * 5, [INF, -8, 0, 0, 0], [INF, -10, 0, 0, 0], [INF, 0, 0, 0, 0], [INF, 0, 0, 0, 0], [INF, -10, 0, 0, 0], [INF, -3, 0, 0, 0]])
DANGLE3 = np.array([[INF] * 5, [INF, -10, -9, -51, -14], [INF, -41, 0, -46, -35], [INF, -10, 0, -50, -2], [INF, -10, -40, -60, 0], [INF, -10, -13, -25, -7], [INF, -10, -30, -44, -7]])
# Scalars.
TERMINAL_AU, ML_CLOSING, ML_INTERN, ML_BASE, NINIO, NINIO_MOST, LXC = 56, 315, 15, -2, 50, 300, 107.856


def _mismatch_interior() -> np.ndarray:
    """63 for pairs other than CG and GC, less 50 for A against G and 45 for U against U; nothing next to an unknown base."""
    out = np.zeros((7, 5, 5), int)
    out[3:, 1:, 1:] = 63
    for a, b, bonus in ((1, 3, -50), (3, 1, -50), (4, 4, -45)):
        out[1:, a, b] += bonus
    return out


# Fixed values, from their rule: terminal mismatches of interior loops.
MISMATCH_INTERIOR = _mismatch_interior()


@dataclass(frozen=True)
class Loops:
    """Energies of the small interior loops by pair types (0 to 6) and bases (unknown, A, C, G, U)."""

    int11: np.ndarray
    int21: np.ndarray
    int22: np.ndarray


def rule_loops() -> Loops:
    """From a rule: a start by how many of the closing pairs aren't CG or GC, and a bonus for G against G (1x1) or for the mismatches (2x2)."""
    weak = (np.arange(7) > 2).astype(int)[:, None] + (np.arange(7) > 2).astype(int)[None, :]
    real = (np.arange(7) > 0)[:, None] & (np.arange(7) > 0)[None, :]
    int11 = np.where(real, 60 + 48 * weak, 0)[:, :, None, None] * np.ones((5, 5), int)
    int11[:, :, 3, 3] -= np.where(real, 55, 0)
    int21 = np.where(real, 171 + 66 * weak, 0)[:, :, None, None, None] * np.ones((5, 5, 5), int)
    int22 = np.where(real, 110 + 55 * weak, 0)[:, :, None, None, None, None] * np.ones((5, 5, 5, 5), int)
    bonus = MISMATCH_INTERIOR[1]
    int22 = int22 + np.where(real, 1, 0)[:, :, None, None, None, None] * (bonus[:, None, None, :] + bonus.T[None, :, :, None])
    return Loops(int11, int21, int22)


def load_loops(spark: SparkSession, path: str) -> Loops:
    """From a CSV (header) or Parquet table: table (int11, int21 or int22), t1, t2, b1, b2, b3, b4, value; unused bases null, what isn't given 0. It has at most 37,975 rows, so the driver may hold it."""
    table: DataFrame = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True, schema="table string, t1 int, t2 int, b1 int, b2 int, b3 int, b4 int, value int")
    out = {"int11": np.zeros((7, 7, 5, 5), int), "int21": np.zeros((7, 7, 5, 5, 5), int), "int22": np.zeros((7, 7, 5, 5, 5, 5), int)}
    for r in table.limit(37_976).collect():
        at = (r.t1, r.t2, *(b for b in (r.b1, r.b2, r.b3, r.b4) if b is not None))
        if len(at) != out[r.table].ndim:
            raise ValueError(f"{r.table} takes {out[r.table].ndim - 2} bases, got {at}")
        out[r.table][at] = r.value
    return Loops(**out)


def _stand_in() -> Loops:
    warnings.warn("energies of 1x1, 1x2 and 2x2 loops come from a rule, not from published tables; give Model(load_loops(spark, path)), or Model(rule_loops()) if that is meant", stacklevel=4)
    return rule_loops()


@dataclass(frozen=True)
class Model:
    """All tables, as used by the kernels. Without loops those of the rule stand in, and a warning says so; rule_loops() given outright is taken as meant."""

    loops: Loops = field(default_factory=_stand_in)

    def bulge(self, u: np.ndarray) -> np.ndarray:
        return np.where(u <= MAXLOOP, BULGE[np.minimum(u, MAXLOOP)], BULGE[MAXLOOP] + LXC * np.log(np.maximum(u, 1) / MAXLOOP))

    def loop(self, t1, t2, u1, u2, a, b, c, d, asymmetry: bool = False) -> np.ndarray:
        """Energy of the loop between an outer pair of type t1 and an inner one of type t2 (read from inside), with u1 unpaired bases on the first strand, of which a is the first and b the last, and u2 on
        the second, of which c is the first after the inner pair and d the last. All arrays of one shape; bases of an empty side don't count. asymmetry: whether lopsided loops cost more."""
        t1, t2, u1, u2, a, b, c, d = np.broadcast_arrays(*map(np.asarray, (t1, t2, u1, u2, a, b, c, d)))
        out = np.zeros(t1.shape)
        small, n = np.minimum(u1, u2), u1 + u2
        stack = n == 0
        out[stack] = STACK[t1[stack], t2[stack]]
        m = (small == 0) & (n == 1)
        out[m] = BULGE[1] + STACK[t1[m], t2[m]]
        m = (small == 0) & (n > 1)
        out[m] = self.bulge(n[m]) + TERMINAL_AU * ((t1[m] > 2).astype(int) + (t2[m] > 2))
        m = (u1 == 1) & (u2 == 1)
        out[m] = self.loops.int11[t1[m], t2[m], a[m], d[m]]
        m = (u1 == 1) & (u2 == 2)
        out[m] = self.loops.int21[t1[m], t2[m], a[m], c[m], d[m]]
        m = (u1 == 2) & (u2 == 1)
        out[m] = self.loops.int21[t2[m], t1[m], c[m], a[m], b[m]]
        m = (u1 == 2) & (u2 == 2)
        out[m] = self.loops.int22[t1[m], t2[m], a[m], b[m], c[m], d[m]]
        m = (small > 0) & (n > 3) & ~((u1 == 2) & (u2 == 2))
        lopsided = np.minimum(NINIO_MOST, NINIO * np.abs(u1 - u2)) if asymmetry else np.zeros(n.shape, int)
        # beyond the table, loops cost as much as its last entry
        out[m] = INTERIOR[np.minimum(n[m], MAXLOOP)] + MISMATCH_INTERIOR[t1[m], a[m], d[m]] + MISMATCH_INTERIOR[t2[m], c[m], b[m]] + lopsided[m]
        return out

    def hairpin(self, t, u, a, b) -> np.ndarray:
        """Energy of a hairpin of u bases closed by type t; a and b are the bases beside the pair."""
        size = np.where(u <= MAXLOOP, HAIRPIN[np.minimum(u, MAXLOOP)], HAIRPIN[MAXLOOP] + LXC * np.log(np.maximum(u, 1) / MAXLOOP))
        return size + np.where(u == TURN, TERMINAL_AU * (t > 2), MISMATCH_HAIRPIN[t, a, b])


def weight(energy: np.ndarray) -> np.ndarray:
    """Boltzmann weights of energies in 1/100 kcal/mol."""
    return np.exp(-np.asarray(energy, float) * 10 / KT)
