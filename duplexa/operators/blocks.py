"""Sequences and their profiles as a table of blocks, and what it costs to open a window, as a difference of two running sums.

A block is the context of all that starts in its SIZE bases: these and REACH bases on either side, with their costs and the running sum of the conditional ones from the sequence's start. So a hit takes the two blocks that it starts in, of a
bounded length, however long its sequences are; only what reaches a block's border needs a wider one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, REACH = 256, 256

SCHEMA = "seq_id long, block int, offset int, total int, seq string, acc array<float>, cond array<float>, run array<double>"
_ARROW = pa.schema([("seq_id", pa.int64()), ("block", pa.int32()), ("offset", pa.int32()), ("total", pa.int32()), ("seq", pa.string()), ("acc", pa.list_(pa.float32())), ("cond", pa.list_(pa.float32())), ("run", pa.list_(pa.float64()))])


def blocks(sequences: DataFrame, profiles: DataFrame, size: int = SIZE, reach: int = REACH) -> DataFrame:
    """seq_id, block, offset (of its context), total (bases of the sequence), seq, acc, cond and run (sums of cond in front of each base of the context, and behind the last) of sequences (seq_id, seq) with profiles (seq_id, acc, cond).
    Sequences without a profile, or null, have no block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seq_id, seq, acc, cond in zip(*(batch.column(k) for k in ("seq_id", "seq", "acc", "cond")), strict=True):
                text, a, c = seq.as_py(), acc.values.to_numpy(zero_copy_only=False), cond.values.to_numpy(zero_copy_only=False)
                sums = np.concatenate(([0.0], np.cumsum(c, dtype=float)))
                rows = []
                for block in range(-(-len(text) // size)):
                    low, high = max(0, block * size - reach), min(len(text), (block + 1) * size + reach)
                    rows.append({"seq_id": seq_id.as_py(), "block": block, "offset": low, "total": len(text), "seq": text[low:high], "acc": a[low:high], "cond": c[low:high], "run": sums[low : high + 1]})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    both = sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "seq").join(profiles.select("seq_id", "acc", "cond"), "seq_id")
    return both.where("seq is not null and acc is not null and cond is not null").select("seq_id", "seq", "acc", "cond").mapInArrow(run, SCHEMA)


def opening(table: DataFrame, windows: DataFrame, least: int, size: int = SIZE) -> DataFrame:
    """windows (seq_id, pos, length) with cost: what it costs to keep so many bases from pos on open, from a table of blocks of that size: the first window of `least`, and each further base given those before it. Null where the sequence ends
    before, or no profile is; windows may be as long as the blocks reach."""
    at = F.col("pos") - F.col("offset")
    run = lambda k: F.get("run", k)
    cost = F.when((F.col("pos") + F.col("length") <= F.col("total")) & (F.col("length") >= least), F.get("acc", at).cast("double") + (run(at + F.col("length")) - run(at + least)))
    own = table.select(F.col("seq_id"), "block", "offset", "total", "acc", "run")
    return windows.withColumn("block", F.floor(F.col("pos") / size).cast("int")).join(own, ["seq_id", "block"], "left").select(*windows.columns, cost.alias("cost"))
