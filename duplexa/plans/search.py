"""The interaction search as one plan: profiles, seeds, extension per pair, and formatted rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bases
from ..functions.energy import Model
from ..operators.accessibility import accessibility
from ..operators.dominance import undominated
from ..operators.extend import Blocks, gapped_hits, ungapped_hits
from ..operators.growth import cogrown_seeds
from ..operators.seeds import seed_search
from ..sources.settled import settled
from ..sources.store import BEYOND, Store


@dataclass(frozen=True)
class SearchParameters:
    """most: longest seed; seed, interaction and final: energy thresholds in kcal/mol; drop_ungapped and drop_gapped: bases without improvement that end a pass; helix: least pairs of a new helix; style: 0 ranges, 1 all pairs."""

    most: int = 20
    seed: float = -6.0
    interaction: float = -4.0
    final: float = -8.0
    drop_gapped: int = 16
    drop_ungapped: int = 5
    helix: int = 3
    style: int = 0

    def __post_init__(self):
        if self.drop_ungapped > 16 or self.drop_gapped > 30:
            raise ValueError("loops longer than the energy tables: drop-out lengths are at most 16 and 30")


_masked = lambda df, repeat: df.select("seq_id", bases.masked(F.col("seq"), repeat).alias("seq"))
_upper = lambda df, repeat: df.select("seq_id", F.upper(bases.masked(F.col("seq"), repeat)).alias("seq"))  # noqa: E731  soft-masked bases can't seed but can be extended over


def _extended(seeds: DataFrame, table: Blocks, least: int, p: SearchParameters, model: Model) -> DataFrame:
    """Final hits from seeds: extended without gaps, dominated ones removed, extended with gaps, dominated ones removed."""
    seeds = seeds.withColumn("hyb", F.col("energy") / 100.0)
    plain = undominated(ungapped_hits(seeds, table, least, p.drop_ungapped, model), p.interaction)
    return undominated(gapped_hits(plain, table, least, p.drop_gapped, p.helix, model), p.final)


def search(queries: DataFrame, targets: DataFrame, profiles: DataFrame, repeat: int = 0, span: int = 70, least: int = 5, parameters: SearchParameters = SearchParameters(), model: Model | None = None, own: DataFrame | None = None) -> DataFrame:
    """Hits of queries (seq_id, seq) on targets (seq_id, seq) with profiles (seq_id, acc, cond). Rows are hits throughout; they take blocks of the sequences they lie on, never whole ones. own: the queries' profiles, where the caller has them;
    else they are made here, and settled, as folding is the dearest step."""
    p, model = parameters, model or Model()
    own = settled(accessibility(queries, span, least, model).select("seq_id", "acc", "cond")) if own is None else own
    seeds = seed_search(_masked(queries, repeat), _masked(targets, repeat), least, p.most, round(p.seed * 100))
    target_side = _upper(targets, repeat), profiles
    table = Blocks(target_side if queries is targets and own is profiles else (_upper(queries, repeat), own), target_side)
    return _extended(seeds, table, least, p, model)


def store_seeds(queries: DataFrame, store: Store, parameters: SearchParameters = SearchParameters()) -> DataFrame:
    """Seeds of queries (seq_id, seq) on a database, by its window index; its sequences are only read if seeds may be longer than the index has bases."""
    p, queries = parameters, _masked(queries.select("seq_id", "seq"), store.repeat)
    if p.most > max(BEYOND, store.least):
        return cogrown_seeds(queries, _masked(store.sequences, store.repeat), store.least, p.most, round(p.seed * 100))
    return cogrown_seeds(queries, None, store.least, p.most, round(p.seed * 100), store.window_levels, store.window_index)


def search_store(queries: DataFrame, store: Store, parameters: SearchParameters = SearchParameters(), model: Model | None = None, own: DataFrame | None = None) -> DataFrame:
    """Hits of queries (seq_id, name, seq) on a database, with what was fixed when it was built, and names and lengths. Seeds come from its window index, contexts from its blocks."""
    p, model = parameters, model or Model()
    own = settled(accessibility(queries, store.span, store.least, model).select("seq_id", "acc", "cond")) if own is None else own
    table = Blocks((_upper(queries, store.repeat), own), (_upper(store.sequences, store.repeat), store.accessibility), stored=store.blocks)
    hits = _extended(store_seeds(queries, store, p), table, store.least, p, model)
    q = queries.select(F.col("seq_id").alias("query_id"), F.col("name").alias("query_name"), bases.residue_count(F.col("seq"), store.repeat).alias("query_length"))
    t = store.sequences.select(F.col("seq_id").alias("target_id"), F.col("name").alias("target_name"), F.col("known_length").alias("target_length"))
    return hits.join(q, "query_id").join(t, "target_id")


def shortest(x: Column) -> Column:
    """A number with up to six significant digits and no zeros at its end."""
    plain = F.format_string("%.6g", x)
    return F.when(F.contains(plain, F.lit(".")), F.regexp_replace(plain, r"\.?0+(e|$)", "$1")).otherwise(plain)


def pair_text(pairs: Column, style: int) -> Column:
    """Base pairs (q, t) as one range of first and last, or all of them; each with a blank behind."""
    if style == 0:
        first, last = F.element_at(pairs, 1), F.element_at(pairs, -1)
        return F.when(F.size(pairs) > 0, F.concat(F.lit("("), first["q"].cast("string"), F.lit("-"), last["q"].cast("string"), F.lit(":"), first["t"].cast("string"), F.lit("-"), last["t"].cast("string"), F.lit(") "))).otherwise("")
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.lit("("), p["q"].cast("string"), F.lit(":"), p["t"].cast("string"), F.lit(") "))), "")


def formatted(hits: DataFrame, style: int = 0) -> DataFrame:
    """The columns of ORDER and the text line of each hit, without its number."""
    return hits.select(*ORDER, F.concat_ws(",", "query_name", F.col("query_length").cast("string"), "target_name", F.col("target_length").cast("string"), shortest(F.col("acc_energy")), shortest(F.col("hyb_energy")), shortest(F.col("energy")), pair_text(F.col("base_pairs"), style)).alias("line"))


ORDER = ("query_id", "target_id", "q_start", "t_start", "q_len", "t_len")


def numbered(hits: DataFrame, first: Column | int = 0) -> DataFrame:
    """Hits with id: first, first + 1, ... in the order of query, target and place, whatever their partitions: how many hits the queries before have, and the place among a query's own."""
    counts = hits.groupBy(F.col("query_id").alias("_query")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_query").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("query_id").orderBy(*ORDER[1:]))
    first = F.lit(first) if isinstance(first, int) else first
    return hits.withColumn("_own", own).join(counts.select("_query", before.alias("_before")), F.col("query_id") == F.col("_query")).withColumn("id", (first + F.col("_before") + F.col("_own") - 1).cast("long")).drop("_own", "_query", "_before")


COLUMNS = "Id,Query name, Query Length, Target name, Target Length, Accessibility Energy, Hybridization Energy, Interaction Energy, BasePair"


def write_text(hits: DataFrame, path: str, store: Store, parameters: SearchParameters = SearchParameters(), source: str = "", database: str = "") -> None:
    """Numbered lines in the order of query, target and place, under three header lines, as text part files: sorted by range, so the parts read one after another are the file."""
    p = parameters
    settings = f"input:{source},database:{database},RepeatFlag:{store.repeat},MaximalSpan:{store.span},MinAccessibleLength:{store.least},MaxSeedLength:{p.most},InteractionEnergyThreshold:{p.interaction:g},HybridEnergyThreshold:{p.seed:g},FinalThreshold:{p.final:g},DropOutLengthWoGap:{p.drop_ungapped},DropOutLengthWGap:{p.drop_gapped}"
    hits = settled(numbered(hits))
    lines = formatted(hits, p.style).join(hits.select(*ORDER, "id"), list(ORDER)).select("id", F.concat_ws(",", F.col("id").cast("string"), "line").alias("value"))
    head = hits.sparkSession.createDataFrame([(-3, "RNA-RNA interaction search"), (-2, settings), (-1, COLUMNS)], "id long, value string")
    head.union(lines).orderBy("id").select("value").write.mode("overwrite").text(path)
