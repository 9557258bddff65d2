"""The energy model as tables, and energies of loops as joins with them.

A loop lies between an outer and an inner pair of a duplex. Its energy is a sum of what small dimension tables say of its pair types, its numbers of unpaired bases and the bases beside the pairs; which of them count depends on its kind. All
tables are of fixed size and are broadcast up to BROADCAST rows; the tables of 1x1, 1x2 and 2x2 loops come from the model, whether from a rule or loaded.
"""

from __future__ import annotations

from itertools import product
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.energy import BULGE, INTERIOR, LXC, MAXLOOP, MISMATCH_INTERIOR, REVERSE, TERMINAL_AU, Model
from .seeds import BROADCAST, pair_types, stacks

_BASES = "ACGU"
STACK, BULGE_1, BULGED, INT11, INT12, INT21, INT22, OTHER = "stack", "bulge1", "bulge", "int11", "int12", "int21", "int22", "other"


def kind_of(u1: Column, u2: Column) -> Column:
    """By the unpaired bases on either side."""
    n, small = u1 + u2, F.least(u1, u2)
    return (
        F.when(n == 0, STACK).when((small == 0) & (n == 1), BULGE_1).when(small == 0, BULGED)
        .when((u1 == 1) & (u2 == 1), INT11).when((u1 == 1) & (u2 == 2), INT12).when((u1 == 2) & (u2 == 1), INT21).when((u1 == 2) & (u2 == 2), INT22).otherwise(OTHER)
    )


def size_table(spark: SparkSession, most: int = MAXLOOP) -> DataFrame:
    """kind, n and by_size: what a loop of so many unpaired bases costs to start."""
    rows = [(BULGE_1, 1, float(BULGE[1]))]
    rows += [(BULGED, n, float(BULGE[n]) if n <= MAXLOOP else float(BULGE[MAXLOOP] + LXC * log(n / MAXLOOP))) for n in range(2, most + 1)]
    rows += [(OTHER, n, float(INTERIOR[min(n, MAXLOOP)])) for n in range(4, most + 1)]
    return spark.createDataFrame(rows, "kind string, n int, by_size double")


def mismatch_table(spark: SparkSession) -> DataFrame:
    """type, after, before and mismatch: for interior loops, by the bases beside a pair."""
    rows = [(t, a, b, float(MISMATCH_INTERIOR[t, i + 1, j + 1])) for t in range(1, 7) for (i, a), (j, b) in product(enumerate(_BASES), repeat=2)]
    return spark.createDataFrame(rows, "type int, after string, before string, mismatch double")


def small_table(spark: SparkSession, model: Model) -> DataFrame:
    """kind, outer_type, inner_type (as written from the query's side), beside (the unpaired bases in the order of a, b, c, d that the kind looks at) and by_bases: 1x1, 1x2, 2x1 and 2x2 loops."""
    at, rows = {b: k + 1 for k, b in enumerate(_BASES)}, []
    loops = model.loops
    for o, i in product(range(1, 7), repeat=2):
        r = int(REVERSE[i])
        rows += [(INT11, o, i, a + d, float(loops.int11[o, r, at[a], at[d]])) for a, d in product(_BASES, repeat=2)]
        rows += [(INT12, o, i, a + c + d, float(loops.int21[o, r, at[a], at[c], at[d]])) for a, c, d in product(_BASES, repeat=3)]
        rows += [(INT21, o, i, a + b + c, float(loops.int21[r, o, at[c], at[a], at[b]])) for a, b, c in product(_BASES, repeat=3)]
        rows += [(INT22, o, i, a + b + c + d, float(loops.int22[o, r, at[a], at[b], at[c], at[d]])) for a, b, c, d in product(_BASES, repeat=4)]
    return spark.createDataFrame(rows, "kind string, outer_type int, inner_type int, beside string, by_bases double")


def _small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST else table


def loop_energies(loops: DataFrame, model: Model) -> DataFrame:
    """loops (outer_type, inner_type: as written from the query's side; u1, u2: unpaired bases of query and target; a, b: the first and last of the query, c, d: of the target, c beside the inner pair) with energy, in 1/100 kcal/mol. Bases of an
    empty side don't count. Null where a base that counts is unknown or a side has more than the tables."""
    spark = loops.sparkSession
    weak = (F.col("outer_type") > 2).cast("int") + (F.col("inner_type") > 2).cast("int")
    beside = F.when(F.col("kind") == INT11, F.concat("a", "d")).when(F.col("kind") == INT12, F.concat("a", "c", "d")).when(F.col("kind") == INT21, F.concat("a", "b", "c")).when(F.col("kind") == INT22, F.concat("a", "b", "c", "d"))
    marked = loops.withColumn("kind", kind_of(F.col("u1"), F.col("u2"))).withColumns({"n": F.col("u1") + F.col("u2"), "beside": beside})
    reverse = F.element_at(F.array(*(F.lit(int(x)) for x in REVERSE[1:])), F.col("inner_type"))
    side = lambda name: _small(mismatch_table(spark).select(F.col("type").alias(f"{name}_t"), F.col("after").alias(f"{name}_a"), F.col("before").alias(f"{name}_b"), F.col("mismatch").alias(name)), 96)
    outer, inner = side("outer_mm"), side("inner_mm")
    joined = (
        marked.join(_small(stacks(spark).select(F.col("outer_type"), F.col("inner_type"), F.col("energy").alias("by_stack")), 36), ["outer_type", "inner_type"], "left")
        .join(_small(size_table(spark), 2 * MAXLOOP), ["kind", "n"], "left")
        .join(_small(small_table(spark, model), 36 * 400), ["kind", "outer_type", "inner_type", "beside"], "left")
        .join(outer, (F.col("outer_type") == F.col("outer_mm_t")) & (F.col("a") == F.col("outer_mm_a")) & (F.col("d") == F.col("outer_mm_b")), "left")
        .join(inner, (reverse == F.col("inner_mm_t")) & (F.col("c") == F.col("inner_mm_a")) & (F.col("b") == F.col("inner_mm_b")), "left")
    )
    energy = (
        F.when(F.col("kind") == STACK, F.col("by_stack")).when(F.col("kind") == BULGE_1, F.col("by_size") + F.col("by_stack")).when(F.col("kind") == BULGED, F.col("by_size") + TERMINAL_AU * weak)
        .when(F.col("kind") == OTHER, F.col("by_size") + F.col("outer_mm") + F.col("inner_mm")).otherwise(F.col("by_bases"))
    )
    return joined.select(*loops.columns, energy.alias("energy"))


def stem_loops(stems: DataFrame, queries: DataFrame, targets: DataFrame, model: Model, reach: int = 8) -> DataFrame:
    """query_id, target_id, q_start, t_start, length, q_next, t_next, next_length, u1, u2 and energy: stems (query_id, target_id, q_start, t_start, length) with each stem that begins behind their end within `reach` unpaired bases, and the loop
    between. Stems are brought together by where the next may begin on the query, so rows follow the stems of a band, not all pairs."""
    spark = stems.sparkSession
    key = ["query_id", "target_id"]
    ends = stems.withColumns({"q_end": F.col("q_start") + F.col("length") - 1, "q_next": F.explode(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda u: F.col("q_start") + F.col("length") + u))})
    begins = stems.select(*key, F.col("q_start").alias("q_next"), F.col("t_start").alias("t_next"), F.col("length").alias("next_length"))
    u1, u2 = F.col("q_next") - F.col("q_end") - 1, F.col("t_start") - F.col("t_next") - F.col("next_length")
    met = ends.join(begins, [*key, "q_next"]).withColumns({"u1": u1.cast("int"), "u2": u2.cast("int")}).where((F.col("u2") >= 0) & (F.col("u1") + F.col("u2") <= reach) & (F.col("u1") + F.col("u2") > 0))
    side = lambda df, name: df.select(F.col("seq_id").alias(f"{name}_id"), F.col("seq").alias(f"{name}_seq"))
    at = lambda seq, place: F.substring(seq, place + 1, F.lit(1))
    inner_q, inner_t = F.col("q_next"), F.col("t_next") + F.col("next_length") - 1
    based = met.join(side(queries, "query"), "query_id").join(side(targets, "target"), "target_id")
    based = based.withColumns({
        "qo": at(F.col("query_seq"), F.col("q_end")), "to": at(F.col("target_seq"), F.col("t_start")), "qi": at(F.col("query_seq"), inner_q), "ti": at(F.col("target_seq"), inner_t),
        "a": at(F.col("query_seq"), F.col("q_end") + 1), "b": at(F.col("query_seq"), inner_q - 1), "c": at(F.col("target_seq"), inner_t + 1), "d": at(F.col("target_seq"), F.col("t_start") - 1),
    }).drop("query_seq", "target_seq")
    types = lambda q, t, name: F.broadcast(pair_types(spark).select(F.col("qb").alias(q), F.col("tb").alias(t), F.col("type").alias(name)))  # noqa: E731  six rows
    typed = based.join(types("qo", "to", "outer_type"), ["qo", "to"]).join(types("qi", "ti", "inner_type"), ["qi", "ti"])
    out = loop_energies(typed, model)
    return out.select(*key, "q_start", "t_start", "length", "q_next", "t_next", "next_length", "u1", "u2", F.round("energy").cast("int").alias("energy"))
