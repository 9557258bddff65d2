"""The target database: Parquet tables of sequences, accessibility profiles, their blocks, the window index, and the parameters that a search takes over.

The window index has two tables: all places from which a window of known bases starts, with the bases from there on, sorted by these; and by length the distinct windows with their counts, up to the size the index is built for. A search grows
its windows over the second and only looks up places of those that are seeds, so it reads no sequence of the database; it has to meet the blocks of those alone that have seeds.
"""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.energy import Model
from ..operators.accessibility import accessibility
from ..operators.blocks import blocks
from ..operators.growth import levels, occurrences

#: Bases that the index has from each place on.
BEYOND = 20
SCHEDULES = ("block", "heap", "dynamic")


@dataclass(frozen=True)
class BuildParameters:
    """repeat: 0 hard mask, 1 soft mask, 2 none; index: longest windows that the stored index has counts of; span: most bases that a pair encloses; least: accessible length; page: sequences to a page, None for one page."""

    repeat: int = bases.HARD
    index: int = 8
    span: int = 70
    least: int = 5
    page: int | None = None
    schedule: str = "heap"

    def __post_init__(self):
        if self.repeat not in (0, 1, 2):
            raise ValueError(f"repeat mode must be 0, 1 or 2, not {self.repeat!r}")
        if self.least <= 1:
            raise ValueError("the accessible length must be over 1")
        if self.schedule not in SCHEDULES:
            raise ValueError(f"schedule must be one of {SCHEDULES}, not {self.schedule!r}")


def build(sequences: DataFrame, path: str, parameters: BuildParameters = BuildParameters(), model: Model | None = None) -> None:
    """Write the database of sequences (ord, name, seq) to a folder. Pages are a column, for storage only; results don't depend on them."""
    spark = sequences.sparkSession
    page = F.floor(F.col("ord") / parameters.page).cast("int") if parameters.page else F.lit(0)
    rows = sequences.select(F.col("ord").alias("seq_id"), "name", "seq", F.length("seq").alias("length"), bases.residue_count(F.col("seq"), parameters.repeat).alias("known_length"), page.alias("page_id"))
    rows.write.mode("overwrite").parquet(f"{path}/sequences.parquet")
    stored = spark.read.parquet(f"{path}/sequences.parquet")
    accessibility(stored, parameters.span, parameters.least, model).select("seq_id", "acc", "cond").write.mode("overwrite").parquet(f"{path}/accessibility.parquet")
    masked = stored.select("seq_id", bases.masked(F.col("seq"), parameters.repeat).alias("seq"))
    upper = masked.select("seq_id", F.upper("seq").alias("seq"))  # what a hit may be extended over
    blocks(upper, spark.read.parquet(f"{path}/accessibility.parquet")).write.mode("overwrite").parquet(f"{path}/blocks.parquet")
    occurrences(masked, parameters.least, max(BEYOND, parameters.least), True).repartitionByRange("beyond", "seq_id").sortWithinPartitions("beyond").write.mode("overwrite").parquet(f"{path}/window_index.parquet")
    most = max(parameters.least, min(parameters.index, BEYOND))
    levels(spark.read.parquet(f"{path}/window_index.parquet"), parameters.least, most).repartitionByRange("k", "window").sortWithinPartitions("k", "window").write.mode("overwrite").parquet(f"{path}/window_levels.parquet")
    spark.createDataFrame([{k: v for k, v in asdict(parameters).items() if k in ("repeat", "index", "span", "least")}], "repeat int, index int, span int, least int").coalesce(1).write.mode("overwrite").parquet(f"{path}/parameters.parquet")


@dataclass(frozen=True)
class Store:
    """A database that was built: lazy tables, and what was fixed when building it."""

    sequences: DataFrame
    accessibility: DataFrame
    blocks: DataFrame
    window_index: DataFrame
    window_levels: DataFrame
    repeat: int
    index: int
    span: int
    least: int

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Store:
        row = spark.read.parquet(f"{path}/parameters.parquet").first()
        return cls(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("sequences", "accessibility", "blocks", "window_index", "window_levels")), *(row[k] for k in ("repeat", "index", "span", "least")))
