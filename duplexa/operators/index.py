"""The window index of a set of sequences, and positions on their concatenation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.bases import base_codes

_CHUNK = 4096
#: Bases that a kernel handles at once; a longer single sequence is handled alone.
PART = 1 << 20


def _numbered(codes: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers (base 4, A C G U as 0 to 3) of all windows of k known bases of sequences that stand one after another; ends: where each ends."""
    total = len(codes) - k + 1
    if total <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    number = np.zeros(total, np.int64)
    for j in range(k):
        number = 4 * number + codes[j : j + total] - 1
    unknown = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes == 0, out=unknown[1:])
    ok = unknown[k:] == unknown[:-k]
    for j in range(1, k):  # a window may not go on into the next sequence
        over = ends - j
        ok[over[(over >= 0) & (over < total)]] = False
    at = np.flatnonzero(ok)
    return at, number[at]


def _parts(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of rows of about PART bases, or one longer one: first row, codes and where each row's begin (and end)."""
    rows, low = batch.column("seq").to_pylist(), 0
    while low < len(rows):
        high, size = low, 0
        while high < len(rows) and (high == low or size + len(rows[high] or "") <= PART):
            size += len(rows[high] or "")
            high += 1
        parts = [base_codes(x) if x else np.zeros(0, np.int64) for x in rows[low:high]]
        yield low, np.concatenate(parts), np.cumsum([0, *map(len, parts)])
        low = high


def kmer_index(sequences: DataFrame, k: int) -> DataFrame:
    """kmer (its number, A C G U as 0 to 3), seq_id, pos for all windows of k known upper-case bases of sequences (seq_id, seq). Null sequences have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("seq_id").to_numpy(zero_copy_only=False)
            for low, codes, at in _parts(batch):
                place, number = _numbered(codes, at[1:], k)
                for first in range(0, len(place), PART):
                    own = slice(first, first + PART)
                    row = np.searchsorted(at, place[own], "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(number[own]), pa.array(ids[low + row].astype(np.int64)), pa.array((place[own] - at[row]).astype(np.int32))], names=["kmer", "seq_id", "pos"])

    return _known(sequences.where("seq_id is not null")).mapInArrow(run, "kmer long, seq_id long, pos int")


def kmer_counts(sequences: DataFrame, most: int = 8) -> DataFrame:
    """k, kmer and n for k from 1 to most. Each run of rows is counted where it is read, so what is shuffled is at most 4**k counts a run and k, whatever the bases."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(4**k, np.int64) for k in range(1, most + 1)]
        for batch in batches:
            for _, codes, at in _parts(batch):
                for k, own in enumerate(total, 1):
                    own += np.bincount(_numbered(codes, at[1:], k)[1], minlength=4**k)
        for k, own in enumerate(total, 1):
            kmer = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kmer), k, np.int32)), pa.array(kmer), pa.array(own[kmer])], names=["k", "kmer", "n"])

    return _known(sequences).mapInArrow(run, "k int, kmer long, n long").groupBy("k", "kmer").agg(F.sum("n").alias("n"))


def _known(sequences: DataFrame) -> DataFrame:
    """seq_id and seq with all but upper-case A, C, G and U made unknown: a kernel knows no case."""
    ids = F.col("seq_id").cast("long") if "seq_id" in sequences.columns else F.lit(0).cast("long")
    return sequences.select(ids.alias("seq_id"), F.regexp_replace("seq", "[^ACGU]", "N").alias("seq"))


def prefix_ranges(counts: DataFrame) -> DataFrame:
    """k, kmer, first and last place among all windows of that k in the order of their numbers. At most 4**k rows to a k."""
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("kmer").rowsBetween(Window.unboundedPreceding, 0))
    return counts.select("k", "kmer", (upto - F.col("n")).alias("first"), (upto - 1).alias("last"))


def start_positions(sequences: DataFrame) -> DataFrame:
    """seq_id, start and length, where each sequence starts if all stand one after another in the order of ord with one separator between: chunk by chunk, and within chunks, so no task sees all."""
    sized = sequences.select("seq_id", "ord", F.length("seq").cast("long").alias("length")).withColumn("chunk", F.floor(F.col("ord") / _CHUNK))
    sums = sized.groupBy(F.col("chunk").alias("c")).agg(F.sum(F.col("length") + 1).alias("total"))
    offsets = sums.select("c", F.coalesce(F.sum("total").over(Window.orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    within = F.coalesce(F.sum(F.col("length") + 1).over(Window.partitionBy("chunk").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sized.withColumn("within", within).join(offsets, F.col("chunk") == F.col("c")).select("seq_id", (F.col("offset") + F.col("within")).cast("long").alias("start"), "length")


def locate(positions: DataFrame, starts: DataFrame, width: int = 4096) -> DataFrame:
    """position, seq_id and offset for each position (column position) that falls within a sequence of starts: both sides by buckets of so many positions, then a range check."""
    spans = starts.where("length > 0").select("seq_id", "start", "length", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("length") - 1) / width))).alias("bucket"))
    asked = positions.select("position", F.floor(F.col("position") / width).alias("bucket"))
    return asked.join(spans, "bucket").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("start") + F.col("length"))).select("position", "seq_id", (F.col("position") - F.col("start")).alias("offset"))
