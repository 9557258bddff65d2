"""Removal of dominated hits: of two hits of one pair of sequences of which one covers the other on both strands, the one of higher energy goes.

The rule depends on the order of hits, from the target's 3' end on: a hit that is there at its turn drops those it covers that come later, unless its own energy is higher: then it goes itself, but only after its turn. So whether a hit is there
at its turn depends on those before that cover it, and whether it goes afterwards on the ones it covers that nothing before it has dropped.

Hits whose targets don't overlap, not even through others, can't meet: they are islands, found by gaps, and the unit that is dealt. Within islands one sweep looks back from each hit at the hits that are still open, which is all it keeps.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAIR = ("query_id", "target_id")


def islands(hits: DataFrame) -> DataFrame:
    """hits (query_id, target_id, q_start, t_start, q_len, t_len, energy, ...) with island: a number within each pair of sequences, in the order of falling target ends."""
    order = Window.partitionBy(*PAIR).orderBy(*_order())
    lowest = F.min("t_start").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("t_start") + F.col("t_len") <= lowest).cast("int"), F.lit(0))
    return hits.withColumn("island", begins).withColumn("island", F.sum("island").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def _order() -> list:
    return [F.desc(F.col("t_start") + F.col("t_len")), F.asc("q_start"), F.desc("t_len"), F.desc("q_len"), F.asc("energy")]


class _Open:
    """Hits that were there at their turn and whose targets aren't passed yet, in order. number: of the row in the batches held."""

    def __init__(self):
        self.n = 0
        self.ints, self.energy = np.zeros((4, 64), np.int64), np.zeros(64)  # q_start, q_end, t_start, number

    def add(self, q_start: int, q_end: int, t_start: int, number: int, energy: float) -> None:
        if self.n == len(self.energy):
            self.ints, self.energy = np.concatenate((self.ints, self.ints), 1), np.concatenate((self.energy, self.energy))
        self.ints[:, self.n], self.energy[self.n] = (q_start, q_end, t_start, number), energy
        self.n += 1

    def pass_by(self, t_end: int) -> None:
        """Forget those that nothing from this target end on can overlap."""
        on = np.flatnonzero(self.ints[2, : self.n] < t_end)
        if len(on) < self.n:
            self.ints[:, : len(on)], self.energy[: len(on)] = self.ints[:, on], self.energy[on]
            self.n = len(on)


def sweep(keys: np.ndarray, q_start: np.ndarray, q_end: np.ndarray, t_start: np.ndarray, t_end: np.ndarray, energy: np.ndarray, first: int, state: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Which of these rows (in order, numbered from `first`; keys tell islands apart) are there at their turn, the numbers of rows that go after theirs, and the state for the rows to come."""
    there, gone = np.zeros(len(keys), bool), []
    key, open_ = state if state else (None, _Open())
    for k, own in enumerate(map(tuple, keys.tolist())):
        if own != key:
            key, open_ = own, _Open()
        open_.pass_by(int(t_end[k]))
        ints, other = open_.ints[:, : open_.n], open_.energy[: open_.n]
        over = np.flatnonzero((ints[0] <= q_start[k]) & (ints[1] >= q_end[k]) & (ints[2] <= t_start[k]))  # those before end no lower
        drops = over[other[over] <= energy[k]]
        before = over if not len(drops) else over[over < drops[0]]  # at whose turn this hit is still there
        gone += ints[3][before[other[before] > energy[k]]].tolist()
        if not len(drops):
            there[k] = True
            open_.add(int(q_start[k]), int(q_end[k]), int(t_start[k]), first + k, float(energy[k]))
    return there, np.array(gone, np.int64), (key, open_)


def undominated(hits: DataFrame, threshold: float) -> DataFrame:
    """hits (query_id, target_id, q_start, t_start, q_len, t_len, energy, ...) of energy up to the threshold without those dominated. Of equal hits one stays. Null columns of these take no part."""
    columns = hits.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, pa.RecordBatch, np.ndarray]] = []  # first number, rows, which stay so far
        state, number = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            q, t, m, n = (batch.column(k).to_numpy().astype(np.int64) for k in ("q_start", "t_start", "q_len", "t_len"))
            keys = np.stack([batch.column(k).to_numpy() for k in (*PAIR, "island")], 1)
            there, gone, state = sweep(keys, q, q + m, t, t + n, batch.column("energy").to_numpy().astype(float), number, state)
            held.append((number, batch.select(columns).filter(pa.array(there)), np.flatnonzero(there) + number))
            number += batch.num_rows
            open_ = state[1]
            oldest = int(open_.ints[3, : open_.n].min(initial=number))
            left = []
            for first, rows, numbers in held:
                kept = ~np.isin(numbers, gone)
                rows, numbers = rows.filter(pa.array(kept)), numbers[kept]
                done = int(np.searchsorted(numbers, oldest))  # rows before the oldest that is open can't change any more
                if done:
                    yield rows.slice(0, done)
                if done < len(numbers):
                    left.append((first, rows.slice(done), numbers[done:]))
            held = left
        for _, rows, _ in held:
            yield rows

    known = hits.where(F.col("energy") <= threshold).na.drop(subset=[*PAIR, "q_start", "t_start", "q_len", "t_len"])
    dealt = islands(known).repartition(*PAIR, "island").sortWithinPartitions(*PAIR, "island", *_order())
    return dealt.mapInArrow(run, hits.schema)
