"""Columns that place work: contiguous blocks, longest first, and balanced bins. They change where rows are worked on, never results."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups of rows that are placed as one when balancing.
GROUPS = 4096


def blocks(sequences: DataFrame, bins: int, total: int | None = None) -> DataFrame:
    """seq_id and bin: runs of total // bins + 1 rows in the order of ord (0, 1, ...)."""
    n = sequences.count() if total is None else total
    return sequences.select("seq_id", F.floor(F.col("ord") / (n // bins + 1)).cast("int").alias("bin"))


def longest_first(sequences: DataFrame) -> DataFrame:
    """seq_id and length, the longest first, ties by seq_id."""
    return sequences.select("seq_id", F.length("seq").cast("long").alias("length")).orderBy(F.desc("length"), "seq_id")


def _groups(sequences: DataFrame, groups: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """Rows with their group, and the groups' lengths in all, the heaviest first: at most `groups` sums, at any size of the table."""
    grouped = sequences.select("seq_id", F.length("seq").cast("long").alias("length"), F.pmod(F.xxhash64("seq_id"), F.lit(groups)).alias("group"))
    sums = grouped.groupBy("group").agg(F.sum("length").alias("load")).collect()
    return grouped, sorted(((r.load or 0, r.group) for r in sums), reverse=True)


def _placed(grouped: DataFrame, places: list[tuple[int, int]]) -> DataFrame:
    table = grouped.sparkSession.createDataFrame(places, "group long, bin int")
    return grouped.join(F.broadcast(table), "group").select("seq_id", "bin")


def balanced(sequences: DataFrame, bins: int, groups: int = GROUPS) -> DataFrame:
    """seq_id and bin with about equal lengths in all: rows are hashed into a fixed number of groups, and the heaviest group goes to the lightest bin."""
    grouped, loads = _groups(sequences, groups)
    heap, places = [(0, b) for b in range(bins)], []
    for load, group in loads:
        least, b = heapq.heappop(heap)
        places.append((group, b))
        heapq.heappush(heap, (least + load, b))
    return _placed(grouped, places)


def packed(sequences: DataFrame, bins: int, groups: int = GROUPS) -> DataFrame:
    """seq_id and bin: bin after bin takes the heaviest groups that still fit its share of the total; the last takes the rest."""
    grouped, left = _groups(sequences, groups)
    share = sum(load for load, _ in left) // bins
    places = []
    for b in range(bins - 1):
        room, rest = share, []
        for load, group in left:
            if load <= room:
                places.append((group, b))
                room -= load
            else:
                rest.append((load, group))
        left = rest
    return _placed(grouped, places + [(group, bins - 1) for _, group in left])
