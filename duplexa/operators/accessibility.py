"""Accessibility profiles: what it costs to keep a window of bases unpaired, from the partition function over secondary structures of limited span.

The kernel works on padded batches of sequences and fills its tables span by span, each span as whole-array operations over all positions of all sequences. Tables over spans hold Boltzmann weights; the sums over
whole sequences are kept as logarithms, and the outside pass starts from probabilities, so that nothing overflows at any length.

The weight of an interior loop is a product of the outer pair's part, the inner pair's part and the size's, but for the six smallest; so the sums over all sizes are matrix products with a table of sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import base_codes
from ..functions.energy import BULGE, DANGLE3, DANGLE5, INTERIOR, KT, MAXLOOP, MISMATCH_INTERIOR, ML_BASE, ML_CLOSING, ML_INTERN, NINIO, NINIO_MOST, PAIR, REVERSE, STACK, TERMINAL_AU, TURN, Model, weight

#: Bases of a padded batch.
BATCH = 6000
#: Bases that a task should get, at about a millisecond each; partitions follow the work, not the bytes, of which there are few.
TASK_BASES = 4096
MOST_TASKS = 100_000
#: Unpaired bases on either side of the loops that have a table of their own.
SMALL = ((0, 1), (1, 0), (1, 1), (1, 2), (2, 1), (2, 2))


def _by_size() -> tuple[np.ndarray, np.ndarray]:
    """Weights by the unpaired bases on either side, 0 where another rule holds: of interior loops and of bulges."""
    loops, bulges = np.zeros((2, MAXLOOP + 1, MAXLOOP + 1))
    for u1 in range(MAXLOOP + 1):
        for u2 in range(MAXLOOP + 1 - u1):
            if u1 and u2 and (u1, u2) not in SMALL:
                loops[u1, u2] = weight(INTERIOR[u1 + u2] + min(NINIO_MOST, NINIO * abs(u1 - u2)))
            elif u1 + u2 > 1 and not (u1 and u2):
                bulges[u1, u2] = weight(BULGE[u1 + u2])
    return loops, bulges


LOOPS, BULGES = _by_size()


def _taps(sizes: np.ndarray) -> np.ndarray:
    """A table of sizes by the bases on the first side and on both."""
    out = np.zeros_like(sizes)
    for u1 in range(MAXLOOP + 1):
        out[u1, u1:] = sizes[u1, : MAXLOOP + 1 - u1]
    return out


def _paired(table: np.ndarray) -> np.ndarray:
    """Weights of energies by two pair types, 0 without a pair."""
    out = weight(table)
    out[0] = out[:, 0] = 0
    return out


class Fold:
    """The inside and outside tables of a batch. codes: B by N, 0 behind each sequence's end; x[s][:, i] belongs to the interval of bases i + 1 to i + s, counted from 1."""

    def __init__(self, codes: list[np.ndarray], span: int, model: Model):
        self.w, self.model = span, model
        self.length = np.array([len(c) for c in codes])
        self.n = int(self.length.max())
        self.top = min(span + 1, self.n)
        pad = span + 2 * MAXLOOP + 8
        self.c = np.zeros((len(codes), self.n + 2 * pad), np.int64)
        self.pad = pad
        for row, c in enumerate(codes):
            self.c[row, pad + 1 : pad + 1 + len(c)] = c
        self.shape = (len(codes), self.n + 1)
        self.mi = weight(MISMATCH_INTERIOR)
        self.d5 = weight(DANGLE5)
        self.d3 = weight(DANGLE3 + TERMINAL_AU * (np.arange(7) > 2)[:, None])
        self.base, self.intern, self.closing = weight(ML_BASE), weight(ML_INTERN), weight(ML_CLOSING)
        self.au = np.where(np.arange(7) > 0, weight(TERMINAL_AU * (np.arange(7) > 2)), 0.0)
        self.stack, self.bulge = _paired(STACK), _paired(STACK + BULGE[1])
        self.int11, self.int21, self.int22 = (_paired(x) for x in (model.loops.int11, model.loops.int21, model.loops.int22))
        self.pairs = {}
        self.run()

    def at(self, k: int) -> np.ndarray:
        """Base i + k for all i."""
        return self.c[:, self.pad + k : self.pad + k + self.n + 1]

    def pair(self, first: int, last: int) -> np.ndarray:
        """Type of bases i + first and i + last for all i."""
        if (first, last) not in self.pairs:
            self.pairs[first, last] = PAIR[self.at(first), self.at(last)].astype(np.int8)
        return self.pairs[first, last]

    def shifted(self, table: dict, s: int, k: int) -> np.ndarray:
        """table[s] at i + k for all i, 0 outside."""
        x = table.get(s)
        if x is None:
            return np.zeros(self.shape)
        if k == 0:
            return x
        out = np.zeros(self.shape)
        if 0 < k <= self.n:
            out[:, :-k] = x[:, k:]
        elif -self.n <= k < 0:
            out[:, -k:] = x[:, :k]
        return out

    def fits(self, s: int) -> np.ndarray:
        return np.arange(self.n + 1)[None, :] + s <= self.length[:, None]

    def dangle(self, t: np.ndarray, s: int) -> np.ndarray:
        """Weight of the bases beside a pair of type t that closes the interval (i, i + s) from outside."""
        i = np.arange(self.n + 1)[None, :]
        end = i + s == self.length[:, None]
        out = np.where(i > 0, self.d5[t, self.at(0)], 1.0) * np.where(end, weight(TERMINAL_AU * (t > 2)), self.d3[t, self.at(s + 1)])
        return np.where(t > 0, out, 0.0)

    def enclosing(self, s: int) -> np.ndarray:
        """Type of bases i and i + s + 1, 0 where one lies outside."""
        i = np.arange(self.n + 1)[None, :]
        return np.where((i > 0) & (i + s < self.length[:, None]), self.pair(0, s + 1), 0)

    def special(self, s: int, u1: int, u2: int) -> np.ndarray:
        """Weights of loops with a table of their own, by i: outer pair (i, i + s + 1), inner interval (i + u1, i + s - u2)."""
        t1, t2 = self.enclosing(s), REVERSE[self.pair(u1 + 1, s - u2)]
        a, b, c, d = self.at(1), self.at(u1), self.at(s - u2 + 1), self.at(s)
        if u1 + u2 == 1:
            return self.bulge[t1, t2]
        if u1 + u2 == 2:
            return self.int11[t1, t2, a, d]
        if u1 + u2 == 4:
            return self.int22[t1, t2, a, b, c, d]
        return self.int21[t1, t2, a, c, d] if u1 == 1 else self.int21[t2, t1, c, a, b]

    def over_sizes(self, x: np.ndarray, taps: np.ndarray, back: bool = False) -> np.ndarray:
        """By i and the number of unpaired bases in all: the sum over those on the first side, u1, of their weight times x at i + u1; back: at i - u1."""
        wide = np.zeros((len(x), self.n + 1 + MAXLOOP))
        at = MAXLOOP if back else 0
        wide[:, at : at + self.n + 1] = x
        near = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(wide, MAXLOOP + 1, axis=1))
        return near @ (taps[::-1] if back else taps)

    def stacked(self, table: dict, extra: int = 0) -> np.ndarray:
        """table as one array by span, from TURN on, each shifted on by `extra` times the span: 1 names intervals by their end."""
        return np.stack([self.shifted(table, s, -s * extra) for s in range(TURN, self.top + 1)])

    def multi_close(self, s: int) -> np.ndarray:
        t = self.enclosing(s)
        r = REVERSE[t]
        return np.where(t > 0, self.closing * self.intern * self.d3[r, self.at(1)] * self.d5[r, self.at(s)], 0.0)

    def run(self) -> None:
        stem, end, bif, m1, m2, multi = ({} for _ in range(6))
        inner, outer_mi, inner_au, outer_au = {}, {}, {}, {}
        zero = np.zeros(self.shape)
        loops, bulges = ({s: zero.copy() for s in range(TURN, self.top + 1)} for _ in range(2))
        loop_taps, bulge_taps = _taps(LOOPS), _taps(BULGES)
        self.hair = {}
        for s in range(TURN, self.top + 1):
            fits = self.fits(s)
            t = np.where(fits, self.pair(1, s), 0)
            stem[s] = np.where(t > 0, self.shifted(stem, s - 2, 1) * self.stack[t, REVERSE[self.pair(2, s - 1)]] + self.shifted(end, s - 2, 1), 0)
            total = zero.copy()
            for k in range(1, s):
                if k in m1 and s - k in m2:
                    total += m1[k] * self.shifted(m2, s - k, k)
            bif[s] = total * fits
            m2[s] = (stem[s] * self.intern * self.dangle(t, s) + m2.get(s - 1, zero) * self.base) * fits
            m1[s] = m2[s] + bif[s]
            multi[s] = (self.shifted(multi, s - 1, 1) * self.base + bif[s]) * fits
            te = self.enclosing(s)
            self.hair[s] = np.where(te > 0, weight(np.where(te > 0, self.model.hairpin(te, s, self.at(1), self.at(s)), 0)), 0)
            inner[s] = stem[s] * self.mi[REVERSE[t], self.at(s + 1), self.at(0)]
            outer_mi[s] = np.where(te > 0, self.mi[te, self.at(1), self.at(s)], 0)
            inner_au[s], outer_au[s] = stem[s] * self.au[t], self.au[te]
            for table, part, taps in ((loops, inner[s], loop_taps), (bulges, inner_au[s], bulge_taps)):
                sums = self.over_sizes(part, taps)
                for n in range(2, min(MAXLOOP, self.top - s) + 1):
                    table[s + n] += sums[:, :, n]
            own = zero.copy()
            for u1, u2 in SMALL:
                if s - u1 - u2 in stem:
                    own += self.special(s, u1, u2) * self.shifted(stem, s - u1 - u2, u1)
            end[s] = np.where(te > 0, self.hair[s] + loops.pop(s) * outer_mi[s] + bulges.pop(s) * outer_au[s] + own + multi[s] * self.multi_close(s), 0)
        self.stem, self.m1, self.m2, self.multi = stem, m1, m2, multi
        # whole sequences, as logarithms
        b = len(self.length)
        with np.errstate(divide="ignore"):
            arm = np.stack([np.log(stem[s] * self.dangle(np.where(self.fits(s), self.pair(1, s), 0), s)) for s in stem]) if stem else np.zeros((0, *self.shape))
        low = np.zeros((b, self.n + 1))
        for j in range(1, self.n + 1):
            spans = np.arange(TURN, min(self.top, j) + 1)
            low[:, j] = np.logaddexp(low[:, j - 1], np.logaddexp.reduce(arm[spans - TURN, :, j - spans] + low[:, j - spans].T, axis=0))
        self.log_z = low[np.arange(b), self.length]
        high = np.full((b, self.n + 2), -np.inf)
        high[np.arange(b), self.length] = 0
        for i in range(self.n - 1, -1, -1):
            inside = i < self.length
            spans = np.arange(TURN, min(self.top, self.n - i) + 1)
            value = np.logaddexp(high[:, i + 1], np.logaddexp.reduce(arm[spans - TURN, :, i] + high[:, i + spans].T, axis=0))
            high[:, i] = np.where(inside, value, high[:, i])
        self.low, self.high = low, high
        self.inner, self.inner_au = inner, inner_au
        self.outside(outer_mi, outer_au, loop_taps, bulge_taps)

    def outside(self, outer_mi: dict, outer_au: dict, loop_taps: np.ndarray, bulge_taps: np.ndarray) -> None:
        stem, m1, m2 = self.stem, self.m1, self.m2
        b_stem, b_end, b_multi, b_m1, b_m2, b_bif = ({} for _ in range(6))
        zero = np.zeros(self.shape)
        i = np.arange(self.n + 1)[None, :]
        h, h_au = {}, {}
        loops, bulges = ({s: zero.copy() for s in range(TURN, self.top + 1)} for _ in range(2))
        for s in range(self.top, TURN - 1, -1):
            enclosed = (i > 0) & (i + s < self.length[:, None])
            b_end[s] = np.where(enclosed, self.shifted(b_stem, s + 2, -1), 0) if s < self.w else zero
            b_end[s] = np.where(self.enclosing(s) > 0, b_end[s], 0)
            b_multi[s] = np.where(enclosed, self.shifted(b_multi, s + 1, -1) * self.base + b_end[s] * self.multi_close(s), 0)
            total = zero.copy()
            for k in range(s + TURN, min(self.top, self.w) + 1):
                total += b_bif[k] * self.shifted(m2, k - s, s)
            b_m1[s] = np.where(enclosed, total, 0)
            total = b_m1[s] + (b_m2.get(s + 1, zero) * self.base if s <= self.w else 0)
            for k in range(s + TURN, min(self.top, self.w) + 1):
                total += self.shifted(b_bif, k, s - k) * self.shifted(m1, k - s, s - k)
            b_m2[s] = np.where(enclosed, total, 0)
            b_bif[s] = b_m1[s] + b_multi[s]
            h[s], h_au[s] = b_end[s] * outer_mi[s], b_end[s] * outer_au[s]
            for table, part, taps in ((loops, h[s], loop_taps), (bulges, h_au[s], bulge_taps)):
                sums = self.over_sizes(part, taps, back=True)
                for n in range(2, min(MAXLOOP, s - TURN) + 1):
                    table[s - n] += sums[:, :, n]
            t = np.where(self.fits(s), self.pair(1, s), 0)
            seed = np.exp(self.low + self._high(s) - self.log_z[:, None])
            out = seed * self.dangle(t, s) + b_m2[s] * self.intern * self.dangle(t, s)
            for u1, u2 in SMALL:
                k = s + u1 + u2
                if k in b_end:
                    out += self.shifted({0: b_end[k] * self.special(k, u1, u2)}, 0, -u1)
            out += loops.pop(s) * self.mi[REVERSE[t], self.at(s + 1), self.at(0)] + bulges.pop(s) * self.au[t]
            if s + 2 in b_stem:
                out += self.shifted(b_stem, s + 2, -1) * self.stack[self.enclosing(s), REVERSE[t]]
            b_stem[s] = np.where(t > 0, out, 0)
        self.b_end, self.b_multi, self.b_m2, self.h, self.h_au = b_end, b_multi, b_m2, h, h_au

    def _high(self, s: int) -> np.ndarray:
        out = np.full(self.shape, -np.inf)
        out[:, : self.n + 1 - s] = self.high[:, s : self.n + 1]
        return out

    def unpaired(self, w: int, ml_base: bool = True) -> np.ndarray:
        """Probability that bases x to x + w - 1 are unpaired, at column x - 1. ml_base: whether unpaired bases of a multiloop are weighted as in the tables."""
        if not hasattr(self, "left"):
            self._sides()
        change = np.zeros((self.shape[0], self.n + self.w + 2 * MAXLOOP + 8))

        def windows(x: np.ndarray, first: int, count: int) -> None:
            """x at i counts for windows that start at bases i + first, ..., i + first + count - 1."""
            if count > 0:
                change[:, first : first + self.n + 1] += x
                change[:, first + count : first + count + self.n + 1] -= x

        for s, x in self.b_end.items():
            windows(x * self.hair[s], 1, s - w + 1)
        for u, x in self.left.items():
            windows(x, 1, u - w + 1)
        for u, x in self.right.items():
            windows(x, 1, u - w + 1)
        total = np.cumsum(change, 1)[:, 1 : self.n + 1]
        out = np.zeros((self.shape[0], self.n))
        m = max(0, self.n - w + 1)
        out[:, :m] += np.exp(self.low[:, :m] + self.high[:, w : w + m] - self.log_z[:, None])
        out += total
        factor = self.base**w if ml_base else 1.0
        for s in range(w, self.top + 1):  # the window at the left end of a multiloop's rest, or behind its last stem
            if s in self.b_multi and s - w in self.multi:
                out += factor * (self.b_multi[s] * self.shifted(self.multi, s - w, w))[:, : self.n]
            if s in self.b_m2 and s - w in self.m2:
                x = self.b_m2[s] * self.m2[s - w]
                out[:, s - w :] += factor * x[:, : self.n - (s - w)]
        return out

    def _sides(self) -> None:
        """Probability that base i closes a loop with so many unpaired bases on its first strand, and that base i ends the inner pair of one with so many on the second."""
        self.left = {u: np.zeros(self.shape) for u in range(1, MAXLOOP + 1)}
        self.right = {u: np.zeros(self.shape) for u in range(1, MAXLOOP + 1)}
        if self.top < TURN:
            return
        spans = np.arange(TURN, self.top + 1)
        more = spans[:, None] - spans[None, :]  # unpaired bases in all, by the outer and the inner span
        for own, near, sizes in ((self.h, self.inner, LOOPS), (self.h_au, self.inner_au, BULGES)):
            # by their starts for the first side, and by their ends for the second
            for out, outer, inner, table in ((self.left, self.stacked(own), self.stacked(near), sizes), (self.right, self.stacked(own, 1), self.stacked(near, 1), sizes.T)):
                for u in range(1, min(MAXLOOP, self.n) + 1):
                    other = more - u
                    weights = np.where((other >= 0) & (other <= MAXLOOP), table[u, np.clip(other, 0, MAXLOOP)], 0.0)
                    first, second = (outer, inner) if out is self.left else (inner, outer)
                    # first side: inner pairs start u further on; second side: outer pairs end u further on
                    met = (weights if out is self.left else weights.T) @ second.reshape(len(spans), -1)
                    x = first[:, :, : self.n + 1 - u] * met.reshape(second.shape)[:, :, u:]
                    out[u][:, : self.n + 1 - u] += x.sum(0)
        for s in self.b_end:
            for u1, u2 in SMALL:
                if s - u1 - u2 in self.stem:
                    p = self.b_end[s] * self.special(s, u1, u2) * self.shifted(self.stem, s - u1 - u2, u1)
                    if u1:
                        self.left[u1] += p
                    if u2:
                        q = s - u2
                        self.right[u2][:, q:] += p[:, : self.n + 1 - q]


def profiles(seqs: list[str], span: int = 70, least: int = 5, model: Model | None = None, ml_base: bool = True) -> list[tuple[np.ndarray, np.ndarray]]:
    """(acc, cond) of each sequence in kcal/mol, as 32-bit floats: acc[x] for the window of `least` bases from x, cond[x + least] for one base more. A sequence shorter than the window has zeros."""
    if least <= 1:
        raise ValueError("the accessible length must be over 1")
    model = model or Model()
    out = [(np.zeros(len(s), np.float32), np.zeros(len(s), np.float32)) for s in seqs]
    order = sorted((i for i in range(len(seqs)) if len(seqs[i]) >= least), key=lambda i: len(seqs[i]))
    while order:
        take = max(1, BATCH // len(seqs[order[-1]]))
        rows, order = order[-take:], order[:-take]
        fold = Fold([base_codes(seqs[i]) for i in rows], span, model)
        with np.errstate(divide="ignore"):
            one, more = (-np.log(np.clip(fold.unpaired(w, ml_base), 1e-300, 1)) * KT / 1000 for w in (least, least + 1))
        for k, i in enumerate(rows):
            n = len(seqs[i])
            acc = one[k, : n - least + 1].astype(np.float32)
            out[i][0][: n - least + 1] = acc
            out[i][1][least:] = (more[k, : n - least] - acc[: n - least]).astype(np.float32)
    return out


def accessibility(sequences: DataFrame, span: int = 70, least: int = 5, model: Model | None = None) -> DataFrame:
    """sequences (seq_id, seq) with acc and cond, arrays of floats; a null sequence has null profiles.

    One pass counts the bases, which sets how many tasks share them; within a task, batches are of like length.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            known = pdf[pdf["seq"].notna()]
            done = profiles(known["seq"].tolist(), span, least, model)
            for k, name in enumerate(("acc", "cond")):
                column = np.full(len(pdf), None, object)
                for place, profile in zip(np.flatnonzero(pdf["seq"].notna()), done, strict=True):
                    column[place] = profile[k]
                pdf[name] = column
            yield pdf

    bases = sequences.agg(F.sum(F.length("seq"))).first()[0] or 0
    tasks = min(MOST_TASKS, max(1, -(-bases // TASK_BASES)))
    return sequences.select("seq_id", "seq").repartition(tasks, "seq_id").mapInPandas(run, "seq_id long, seq string, acc array<float>, cond array<float>")
