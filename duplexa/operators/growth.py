"""Seeds by growing distinct windows of both sides together, one base a level.

A level has each pair of a query window and a target window of that length that pair all along, once, however often both occur; their counts and energy go along. Pairs whose energy is under the threshold are seeds and grow no more, all others
meet the windows one base longer that occur. Only at the end are seeds' windows replaced by their places, so that rows that are made are level pairs, of which there are few, and seeds.

Windows that occur very often are dealt into parts by the counts known, on both sides, before their places meet: a low-complexity window is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.settled import settled
from .seeds import pair_types, stacks, window_pairs, windows

#: Places of a window that meet in one part.
PART = 20_000


def occurrences(sequences: DataFrame, least: int = 5, most: int = 20, target: bool = False) -> DataFrame:
    """seq_id, pos and beyond: all places of sequences (seq_id, seq) from which a window of `least` known bases starts, with up to `most` bases from there on, up to the first unknown one. Targets are read from their 3' end, pos is where."""
    made = windows(sequences, least, most, target)
    return made.select(F.col("seq_id").cast("long").alias("seq_id"), "pos", F.substring_index("beyond", "N", 1).alias("beyond"))


def levels(places: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """k, window and n for all distinct windows of `least` to `most` bases and how often they occur. Places are counted by what lies beyond them first, so a frequent window is one row a task."""
    distinct = places.groupBy("beyond").agg(F.count("*").alias("n"))
    k = F.explode(F.sequence(F.lit(least), F.least(F.lit(most), F.length("beyond"))))
    cut = distinct.where(F.length("beyond") >= least).select(k.alias("k"), "beyond", "n")
    return cut.groupBy("k", F.expr("left(beyond, k)").alias("window")).agg(F.sum("n").alias("n"))


def grown(spark: SparkSession, query_levels: DataFrame, target_levels: DataFrame, least: int = 5, most: int = 20, threshold: int = -600) -> DataFrame:
    """q_window, t_window, length, energy, n_q and n_t: pairs of windows that occur whose energy first falls under the threshold at their length, from settled levels. Each level is settled, as the next reads it twice."""
    at = lambda table, k, name: table.where(F.col("k") == k).select(F.col("window").alias(f"{name}_window"), F.col("n").alias(f"n_{name}"))
    last = pair_types(spark).select(F.col("qb").alias("q_last"), F.col("tb").alias("t_last"), "type")
    step = last.join(stacks(spark), F.col("type") == F.col("inner_type")).select("q_last", "t_last", F.col("type").alias("next"), "outer_type", F.col("energy").alias("more"))
    pairs = window_pairs(spark, least).withColumns({"q_last": F.right("q_window", F.lit(1)), "t_last": F.right("t_window", F.lit(1))}).join(F.broadcast(last), ["q_last", "t_last"]).drop("q_last", "t_last")
    level = settled(pairs.join(at(query_levels, least, "q"), "q_window").join(at(target_levels, least, "t"), "t_window").select("q_window", "t_window", F.col("energy").cast("int").alias("energy"), "type", "n_q", "n_t"))
    done, open_ = F.col("energy") < threshold, F.col("energy") >= threshold
    out = level.where(done)
    for k in range(least + 1, most + 1):
        on = level.where(open_)
        if on.isEmpty():
            break
        queries = at(query_levels, k, "q").withColumns({"q_before": F.left("q_window", F.lit(k - 1)), "q_last": F.right("q_window", F.lit(1))})
        longer = on.select(F.col("q_window").alias("q_before"), F.col("t_window").alias("t_before"), "energy", "type").join(queries, "q_before").join(F.broadcast(step), (F.col("type") == F.col("outer_type")) & (step.q_last == queries.q_last))
        made = longer.select("q_window", F.concat("t_before", "t_last").alias("t_window"), (F.col("energy") + F.col("more")).cast("int").alias("energy"), F.col("next").alias("type"), "n_q")
        level = settled(made.join(at(target_levels, k, "t"), "t_window").select("q_window", "t_window", "energy", "type", "n_q", "n_t"))
        out = out.union(level.where(done))
    return out.select("q_window", "t_window", F.length("q_window").alias("length"), "energy", "n_q", "n_t")


def _by_window(places: DataFrame, lengths: list[int], name: str) -> DataFrame:
    """Places with each of their windows of these lengths."""
    k = F.explode(F.filter(F.array(*map(F.lit, lengths)), lambda k: k <= F.length("beyond")))
    return places.select(F.col("seq_id").alias(f"{'query' if name == 'q' else 'target'}_id"), F.col("pos").alias(f"{name}_pos"), "beyond", k.alias("k")).select("*", F.expr("left(beyond, k)").alias(f"{name}_window")).drop("beyond", "k")


def _part(parts: Column, *place: str) -> Column:
    return F.pmod(F.xxhash64(*place), parts).cast("int")


def placed(found: DataFrame, queries: DataFrame, targets: DataFrame, part: int = PART) -> DataFrame:
    """query_id, target_id, q_start, t_start, length and energy: the places of pairs of windows (as grown gives them), from those of both sides. Of windows that very many places have, places are dealt into parts on both sides, each of
    which meets all of the other."""
    lengths = sorted(r.length for r in found.select("length").distinct().collect())  # at most one a level
    if not lengths:
        return found.sparkSession.createDataFrame([], "query_id long, target_id long, q_start int, t_start int, length int, energy int")
    of = found.groupBy("t_window").agg(F.ceil(F.sum("n_q") / part).cast("int").alias("q_parts"), F.ceil(F.max("n_t") / part).cast("int").alias("t_parts"))
    of = settled(of)
    dealt = found.join(of, "t_window")
    left = _by_window(queries, lengths, "q").join(dealt, "q_window").select("query_id", "q_pos", "t_window", "length", "energy", _part(F.col("q_parts"), "query_id", "q_pos").alias("q_part"), F.explode(F.sequence(F.lit(0), F.col("t_parts") - 1)).alias("t_part"))
    right = _by_window(targets, lengths, "t").join(of, "t_window").select("target_id", "t_pos", "t_window", _part(F.col("t_parts"), "target_id", "t_pos").alias("t_part"), F.explode(F.sequence(F.lit(0), F.col("q_parts") - 1)).alias("q_part"))
    met = left.join(right, ["t_window", "q_part", "t_part"])
    return met.select("query_id", "target_id", F.col("q_pos").alias("q_start"), (F.col("t_pos") - F.col("length") + 1).cast("int").alias("t_start"), "length", "energy")


def cogrown_seeds(queries: DataFrame, targets: DataFrame | None, least: int = 5, most: int = 20, threshold: int = -600, target_levels: DataFrame | None = None, target_places: DataFrame | None = None, part: int = PART) -> DataFrame:
    """As seed_search. target_levels and target_places: what a stored index has of the targets; levels longer than it has are counted from the places."""
    own = settled(occurrences(queries, least, most))
    other = settled(occurrences(targets, least, most, True)) if target_places is None else target_places
    query_levels = settled(levels(own, least, most))
    if target_levels is None:
        target_levels = settled(levels(other, least, most))
    else:
        stored = target_levels.agg(F.max("k")).first()[0] or least - 1
        if stored < most:  # the index may have been built for shorter windows
            target_levels = target_levels.union(settled(levels(other, stored + 1, most)))
    return placed(grown(queries.sparkSession, query_levels, target_levels, least, most, threshold), own, other, part)
