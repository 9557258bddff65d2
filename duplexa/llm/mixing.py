"""Mixing sources to target sizes by pivotal dependent rounding.

A source's target is a share of its size, so each of its documents wants that many copies: a whole number and a fraction. Fractions are rounded in pairs: mass moves
between two documents, weighted by their sizes so that the taken size stays, until one of the two is whole; which way is random, with probabilities that keep each
one's expected copies. A block of documents so ends with one fraction at most. Blocks are tasks; their remaining documents meet in blocks again, in a reduction
tree of a factor of BLOCK a level, until one is left of each source, which is rounded by chance. So a source's taken size misses its target by no more than one document.

Random numbers come from a hash of the seed, the document, its number among rows alike, and the level: reruns agree, in any partitioning.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

WEIGHTS = (5, 2, 1)
SHARE = 1.5
AT_MOST = 2.0
#: Documents that a task rounds together.
BLOCK = 2048
SEED = 7

WORD = "[^\\x20\\x09-\\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source and size, the number of words; 0 for a null text."""
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sources: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, at_most: float = AT_MOST) -> DataFrame:
    """source, source_size, target, for a settled table (source, source_size) of one row a source.

    Sources take the weights in turn by code point, null last. Targets share the total by weight; one that passes at_most times its source's size stops there and what is
    left is shared again among the others, until none passes. Only sums return to the driver.
    """
    ranked = sources.select("source", "source_size").orderBy(F.col("source").isNull(), "source").rdd.zipWithIndex()
    table = ranked.map(lambda x: (x[0][0], x[0][1], float(weights[x[1] % len(weights)]))).toDF("source string, source_size long, weight double")
    table = settle(table)
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    cap = F.col("source_size") * at_most
    level = 0.0
    while True:
        stopped = F.col("weight") * level >= cap
        free, used = table.agg(F.sum(F.when(~stopped, F.col("weight"))), F.sum(F.when(stopped, cap))).first()
        if not free:
            break
        risen = (total - (used or 0.0)) / free
        if risen <= level:
            break
        level = risen
    return table.select("source", "source_size", F.least(F.col("weight") * level, cap).alias("target"))


def numbered(sized: DataFrame) -> DataFrame:
    """Rows (doc_id, source, size) with number, from 1 on among rows that are alike: they are counted before they move, and made anew from their count, so that no group of them meets."""
    counts = sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n"))
    return counts.select("doc_id", "source", "size", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("number"))


def _uniform(seed: int, level: int) -> Column:
    """A number from 0 to 1 for a document, from its id and size and its number among rows alike; so these spread over blocks as others do."""
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size", "number"), F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))


def _pivotal(block: pd.DataFrame) -> pd.DataFrame:
    """Round a block's fractions (extra) in pairs, in the order of u; at most one document keeps a fraction. u2: a random number for each pair."""
    block = block.sort_values(["u", "doc_id", "size", "number"], kind="mergesort").reset_index(drop=True)
    x, w, u = block["extra"].to_numpy(copy=True), block["size"].to_numpy(float), block["u2"].to_numpy()
    i = 0
    for j in range(1, len(x)):
        if x[i] <= 0 or x[i] >= 1:
            i = j
            continue
        # what i can gain from j and what it can lose to it, in words; taking either by the other's odds keeps each one's expectation
        gain, loss = min((1 - x[i]) * w[i], x[j] * w[j]), min(x[i] * w[i], (1 - x[j]) * w[j])
        gains = u[j] * (gain + loss) < loss
        moved = gain if gains else -loss
        first_is_whole = (1 - x[i]) * w[i] <= x[j] * w[j] if gains else x[i] * w[i] <= (1 - x[j]) * w[j]
        if first_is_whole:
            x[i], x[j] = float(gains), min(max(x[j] - moved / w[j], 0.0), 1.0)
            i = j
        else:
            x[i], x[j] = min(max(x[i] + moved / w[i], 0.0), 1.0), float(not gains)
    block["extra"] = x
    return block[["doc_id", "source", "size", "number", "whole", "extra"]]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, at_most: float = AT_MOST, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target (its source's), taken (size times the copies that the mix takes) and source; a row for each row of docs.

    Null texts have size 0 and are taken 0 times; a null source is a source. Rows that repeat id, source and size are numbered, and so have random numbers of their own.
    An empty table gives an empty one. Other columns are ignored.
    """
    docs = settle(numbered(sizes(docs)))
    sources = settle(docs.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")))
    goals = settle(_with_counts(targets(sources, weights, share, at_most), sources))
    wanted = docs.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left").drop("of")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    whole = F.floor(ratio + 1e-12)
    state = wanted.select("doc_id", "source", "size", "number", whole.alias("whole"), F.when((F.col("size") > 0) & (ratio - whole > 1e-12), ratio - whole).otherwise(0.0).alias("extra"), "n")
    schema = "doc_id long, source string, size long, number long, whole long, extra double"
    open_ = (F.col("extra") > 0) & (F.col("extra") < 1)
    done, level = [settle(state.where(~open_).select("doc_id", "source", "size", "number", "whole", "extra"))], 0
    left = settle(state.where(open_))
    n = sources.agg(F.max("n")).first()[0] or 0
    blocks = F.ceil(F.col("n") / block)
    while True:
        u = _uniform(seed, 2 * level)
        left = left.withColumns({"u": u, "u2": _uniform(seed, 2 * level + 1), "block": F.floor(u * F.greatest(blocks, F.lit(1)))})
        rounded = settle(left.groupBy("source", "block").applyInPandas(_pivotal, schema))
        done.append(rounded.where(~open_))
        n, blocks, level = -(-n // block), F.lit(max(1, -(-(-(-n // block)) // block))), level + 1
        left = rounded.where(open_)
        if n <= 1:
            break
    done.append(left.withColumn("extra", F.when(_uniform(seed, -1) < F.col("extra"), 1.0).otherwise(0.0)))
    all_ = done[0]
    for part in done[1:]:
        all_ = all_.union(part)
    return (
        all_.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")), "left")
        .select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.col("extra").cast("long"))).alias("taken"), "source")
    )


def _with_counts(goals: DataFrame, sources: DataFrame) -> DataFrame:
    counts = sources.select(F.col("source").alias("of"), "n")
    return goals.join(counts, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")


def _key() -> Column:
    """One number for an id and a source, either of which may be null."""
    return F.xxhash64("doc_id", "source", F.col("doc_id").isNull())


def repeated(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Each row of docs as often as the mix takes it, with all its columns and copy, from 1. Rows without words are never taken.

    Rows that repeat id, source and size are numbered, and the first of them take the copies beyond the least that mix gives one of them; so together they take what mix gives them. They are numbered within partitions of docs, from where
    the partitions before end: no group of repeated rows meets in one task.
    """
    taken = mix(docs, seed=seed).where("size > 0").withColumn("copies", F.round(F.col("taken") / F.col("size")).cast("int"))
    given = settle(taken.groupBy(_key().alias("_key"), F.col("size").alias("_size")).agg(F.min("copies").alias("_least"), F.sum("copies").alias("_all"), F.count("*").alias("_rows")).where("_all > 0"))
    named = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long").alias("_size"), F.spark_partition_id().alias("_part"))
    sized = named.withColumn("_key", _key()).drop("doc_id", "source")
    own = ["_key", "_size", "_part"]
    counts = settle(sized.groupBy(*own).agg(F.count("*").alias("n")).join(given.where("_rows > 1"), ["_key", "_size"], "left_semi"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_key", "_size").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = settle(counts.select(*own, before.alias("_before")))
    placed = sized.withColumn("_at", F.row_number().over(Window.partitionBy(*own).orderBy("_part"))).join(offsets, own, "left").join(given, ["_key", "_size"])
    copies = F.col("_least") + F.when(F.col("_at") + F.coalesce("_before", F.lit(0)) <= F.col("_all") - F.col("_rows") * F.col("_least"), 1).otherwise(0)
    return placed.where(copies > 0).select("_doc.*", F.explode(F.sequence(F.lit(1), copies.cast("int"))).alias("copy"))
