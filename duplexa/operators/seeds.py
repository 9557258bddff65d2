"""Seeds: the complementary-substring join of queries and targets, in integers of 1/100 kcal/mol.

Every window of `least` query bases is expanded to the target windows that can pair with it, by a table of fixed size, and equi-joined to the target's windows. What the window's stacking energy doesn't settle goes on along the
diagonal, base by base, for at most `most` positions carried by both sides: a numpy kernel takes the step for a whole Arrow batch of window pairs at once, only for pairs still open. There is no product of sequences: rows
grow with the pairs of windows that do pair.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bases import BASE_CODES
from ..functions.energy import PAIR, REVERSE, STACK

_BASES = "ACGU"
#: Rows of the window table up to which it is broadcast.
BROADCAST = 50_000
_TYPE = {(a, b): int(PAIR[i + 1, j + 1]) for i, a in enumerate(_BASES) for j, b in enumerate(_BASES)}


def pair_types(spark: SparkSession) -> DataFrame:
    """qb, tb, type: the six pairs."""
    return spark.createDataFrame([(a, b, t) for (a, b), t in _TYPE.items() if t], "qb string, tb string, type int")


def stacks(spark: SparkSession) -> DataFrame:
    """outer_type, inner_type (as written from the query's side) and energy."""
    return spark.createDataFrame([(a, b, int(STACK[a, REVERSE[b]])) for a, b in product(range(1, 7), repeat=2)], "outer_type int, inner_type int, energy int")


def window_pairs(spark: SparkSession, size: int) -> DataFrame:
    """q_window, t_window (from its 3' end) and energy for all windows that pair all along: 6**size rows, made on Spark from the six pairs."""
    out = pair_types(spark).select(F.col("qb").alias("q_window"), F.col("tb").alias("t_window"), F.lit(0).alias("energy"), "type")
    step = pair_types(spark).join(stacks(spark), F.col("type") == F.col("inner_type")).select("qb", "tb", F.col("type").alias("next"), "outer_type", F.col("energy").alias("more"))
    for _ in range(size - 1):
        out = out.join(F.broadcast(step), out.type == step.outer_type).select(F.concat("q_window", "qb").alias("q_window"), F.concat("t_window", "tb").alias("t_window"), (F.col("energy") + F.col("more")).alias("energy"), F.col("next").alias("type"))
    return out.select("q_window", "t_window", "energy")


def once(value: Column, make) -> Column:
    """make(value), with value worked out once however often make's lambdas refer to it."""
    return F.element_at(F.transform(F.array(value), make), 1)


#: Bases of a piece, within which places are counted; a long sequence is cut into pieces once, so that windows stay linear in its length.
PIECE = 1024


def pieces(text: Column, overlap: int) -> Column:
    """Array of (offset, piece): the text in runs of PIECE characters, each with up to `overlap` (at most PIECE) that follow."""

    def make(parts: Column) -> Column:
        return F.transform(parts, lambda p, i: F.struct((i * PIECE).alias("offset"), F.concat(p, F.coalesce(F.left(F.get(parts, i + 1), F.lit(overlap)), F.lit(""))).alias("piece"), F.length(p).alias("own")))

    return once(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), make)


def windows(sequences: DataFrame, size: int, reach: int, target: bool) -> DataFrame:
    """seq_id, pos, window and beyond for all windows of known bases of sequences (seq_id, seq); beyond: `reach` bases, the window first, unknown ones and what is past the end as N. Targets: pos is the window's 3' end, and both strings
    run from there to the 5' end. Sequences are cut into pieces that become rows first, so no row grows with a sequence."""
    text = F.reverse("seq") if target else F.col("seq")
    cut = sequences.select("seq_id", F.length("seq").alias("total"), F.explode(pieces(F.regexp_replace(text, "[^ACGU]", "N"), reach - 1)).alias("x")).select("seq_id", "total", "x.*")
    places = cut.select("seq_id", "total", "offset", "piece", F.explode(F.sequence(F.lit(0), F.col("own") - 1)).alias("i"))
    at = F.col("offset") + F.col("i")
    made = places.select("seq_id", (F.col("total") - 1 - at if target else at).cast("int").alias("pos"), F.rpad(F.substring("piece", F.col("i") + 1, F.lit(reach)), reach, "N").alias("beyond"))
    whole = made.withColumn("window", F.left("beyond", F.lit(size))).where(~F.contains("window", F.lit("N")))
    return whole.select("seq_id", "pos", "window", "beyond")


_KIND = np.zeros((5, 5), np.int8)
_KIND[1:, 1:] = np.array([[_TYPE[a, b] for b in _BASES] for a in _BASES])
_MORE = np.zeros((7, 7), np.int32)
_MORE[1:, 1:] = np.array([[int(STACK[a, REVERSE[b]]) for b in range(1, 7)] for a in range(1, 7)])
#: Rows of a batch that the kernel takes at once.
ROWS = 1 << 16


def _codes(column: pa.Array, width: int) -> np.ndarray:
    """A row of base codes for each string of that width."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    first = int(np.frombuffer(offsets, np.int64)[column.offset])
    return BASE_CODES[np.frombuffer(data, np.uint8)[first : first + len(column) * width]].reshape(len(column), width)


def grown(query: np.ndarray, target: np.ndarray, energy: np.ndarray, least: int, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Length and energy of the shortest stretch under the threshold from each pair of windows (0 without one), from codes of what lies along the diagonal on both sides and the windows' energies."""
    kinds, total = _KIND[query, target], energy.astype(np.int32).copy()
    length = np.where(total < threshold, least, 0).astype(np.int32)
    open_ = np.flatnonzero(length == 0)
    for i in range(least, kinds.shape[1]):
        open_ = open_[kinds[open_, i] > 0]
        if not len(open_):
            break
        total[open_] += _MORE[kinds[open_, i - 1], kinds[open_, i]]
        under = total[open_] < threshold
        length[open_[under]] = i + 1
        open_ = open_[~under]
    return length, total


def seed_search(queries: DataFrame, targets: DataFrame, least: int = 5, most: int = 20, threshold: int = -600) -> DataFrame:
    """query_id, target_id, q_start, t_start, length and energy from queries and targets (seq_id, seq), whose masked or unknown bases are not in ACGU.

    At each pair of starting bases the shortest duplex of at least `least` and at most `most` pairs whose stacking energy is under the threshold. Null sequences have none.
    """
    spark = queries.sparkSession
    side = lambda df, name, target: windows(df, least, most, target).select(F.col("seq_id").cast("long").alias(name), F.col("pos").alias(f"{name[0]}_pos"), F.col("window").alias(f"{name[0]}_window"), F.col("beyond").alias(f"{name[0]}_beyond"))
    table = window_pairs(spark, least)  # 6**least rows, whatever the sequences: sent around up to BROADCAST of them
    table = F.broadcast(table) if 6**least <= BROADCAST else table
    # sequences are few bytes and much work: as many tasks as shuffles have partitions, whatever the bytes
    queries = queries.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "seq_id")
    met = side(queries, "query_id", False).join(table, "q_window").join(side(targets, "target_id", True), "t_window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, whole.num_rows, ROWS):
                batch = whole.slice(low, ROWS)
                length, energy = grown(_codes(batch.column("q_beyond"), most), _codes(batch.column("t_beyond"), most), batch.column("energy").to_numpy(), least, threshold)
                found = np.flatnonzero(length)
                at = pa.array(found)
                length = length[found]
                t_start = (batch.column("t_pos").to_numpy()[found] - length + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("query_id").take(at), batch.column("target_id").take(at), batch.column("q_pos").take(at), pa.array(t_start), pa.array(length), pa.array(energy[found])], names=["query_id", "target_id", "q_start", "t_start", "length", "energy"])

    rows = met.select("query_id", "target_id", "q_pos", "t_pos", "q_beyond", "t_beyond", F.col("energy").cast("int").alias("energy"))
    return rows.mapInArrow(run, "query_id long, target_id long, q_start int, t_start int, length int, energy int")


def paired_runs(queries: DataFrame, targets: DataFrame, least: int = 5) -> DataFrame:
    """Maximal runs of `least` paired bases or more on each diagonal: query_id, target_id, diagonal (query position + target position), q_start, q_end, pairs. Windows that pair meet by the table of all that can, and follow one another without a
    gap within a run."""
    side = lambda df, name, target: windows(df, least, least, target).select(F.col("seq_id").cast("long").alias(name), F.col("pos").alias(f"{name[0]}_pos"), F.col("window").alias(f"{name[0]}_window"))
    table = window_pairs(queries.sparkSession, least).select("q_window", "t_window")
    met = side(queries, "query_id", False).join(F.broadcast(table) if 6**least <= BROADCAST else table, "q_window").join(side(targets, "target_id", True), "t_window")
    lane = ["query_id", "target_id", "diagonal"]
    cells = met.select("query_id", "target_id", "q_pos", (F.col("q_pos") + F.col("t_pos")).alias("diagonal"))
    island = F.col("q_pos") - F.row_number().over(Window.partitionBy(*lane).orderBy("q_pos"))
    runs = cells.withColumn("island", island).groupBy(*lane, "island").agg(F.min("q_pos").alias("q_start"), (F.max("q_pos") + least - 1).alias("q_end"), (F.count("*") + least - 1).alias("pairs"))
    return runs.drop("island")
