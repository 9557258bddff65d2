"""The queries of the library's own operators by name, with the SQL that gives the same rows.

Sequences are derived from the tables' texts letter by letter, whole tables and whole texts: `documents` where work grows with the bases, `benchmark` against itself where it grows with pairs of sequences.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bases
from .functions.energy import Model, rule_loops
from .operators.accessibility import accessibility
from .operators.dominance import undominated
from .operators.extend import Blocks, ungapped_hits
from .operators.growth import cogrown_seeds
from .operators.index import kmer_counts, kmer_index, locate, prefix_ranges, start_positions
from .operators.loops import stem_loops
from .operators.schedule import balanced, blocks, longest_first, packed
from .operators.seeds import _TYPE, paired_runs, seed_search
from .plans.search import pair_text, search, shortest
from .sources.datasource import register
from .sources.fasta import split_by_name, wrapped
from .sources.settled import settled, shared_dir

_LETTERS, _AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGUUGCAACGUGCUAUCAGGAUCCU"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id, ord, name and seq of all documents."""
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.col("doc_id").alias("ord"), F.concat_ws("_", "lang", "source").alias("name"), bases.from_text(F.col("text")).alias("seq"))


def _benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("seq_id"), bases.from_text(F.col("text")).alias("seq"))


def _cased(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq_id and seq of all documents, in which capitals give upper-case bases and small letters lower-case ones."""
    letters = F.regexp_replace("text", "[^A-Za-z]", "")
    return _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq_id"), F.translate(letters, _LETTERS.upper() + _LETTERS, _AS_BASES + _AS_BASES.lower()).alias("seq"))


def _encode(mode: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _cased(spark, sf_dir).select("seq_id", bases.encoded_text(F.col("seq"), mode, target=True).alias("codes"), bases.residue_count(F.col("seq"), mode).alias("known"))

    return query


def base_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _documents(spark, sf_dir).select("name", F.length("seq").cast("long").alias("length"), *bases.base_counts(F.col("seq")))
    return counted.groupBy("name").agg(F.count("*").alias("records"), *(F.sum(c).alias(c) for c in ("length", "n_a", "n_c", "n_g", "n_u")))


def seq_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select((F.col("ord") + 1).alias("number"), F.length("seq").cast("long").alias("length"))


def kmer_index_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_index(_benchmark(spark, sf_dir), 8)


def kmer_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_counts(_documents(spark, sf_dir), 8)


def prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_ranges(kmer_counts(_documents(spark, sf_dir), 8))


def start_positions_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return start_positions(_documents(spark, sf_dir))


def pos_to_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return locate(_table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 37).alias("position")), start_positions(_documents(spark, sf_dir)))


def diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paired_runs(_benchmark(spark, sf_dir), _benchmark(spark, sf_dir))


def seeds_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seed_search(_benchmark(spark, sf_dir), _benchmark(spark, sf_dir))


def seed_search_kmer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cogrown_seeds(_benchmark(spark, sf_dir), _benchmark(spark, sf_dir))


def seed_energy_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds_query(spark, sf_dir).groupBy("length", F.floor(F.col("energy") / 100).alias("kcal")).agg(F.count("*").alias("n"), F.sum("energy").alias("total"))


def ungapped_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.explode(F.sequence(F.lit(0), F.col("length") - 1))
    return seeds_query(spark, sf_dir).select("query_id", "target_id", "q_start", "t_start", at.alias("k"), "length").select("query_id", "target_id", "q_start", "t_start", (F.col("q_start") + F.col("k")).alias("q"), (F.col("t_start") + F.col("length") - 1 - F.col("k")).alias("t"))


def dominance_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds that lie within another seed of the same pair of sequences, on both."""
    seeds = seeds_query(spark, sf_dir)
    inner = seeds.select("query_id", "target_id", F.col("q_start").alias("q_in"), F.col("t_start").alias("t_in"), F.col("length").alias("m"))
    within = (F.col("q_in") >= F.col("q_start")) & (F.col("t_in") >= F.col("t_start")) & (F.col("q_in") + F.col("m") <= F.col("q_start") + F.col("length")) & (F.col("t_in") + F.col("m") <= F.col("t_start") + F.col("length"))
    return seeds.join(inner, ["query_id", "target_id"]).where(within & (F.col("m") < F.col("length"))).select("query_id", "target_id", "q_start", "t_start", "length", "q_in", "t_in", F.col("m").alias("inner_length"))


def dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds of up to -7 kcal/mol that no other dominates."""
    seeds = seeds_query(spark, sf_dir).select("query_id", "target_id", "q_start", "t_start", F.col("length").alias("q_len"), F.col("length").alias("t_len"), "energy")
    return undominated(seeds, -700).select("query_id", "target_id", "q_start", "t_start", F.col("q_len").alias("length"), "energy")


def ungapped_extension_hyb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds extended without gaps where nothing costs to be opened, in 1/100 kcal/mol."""
    targets = _benchmark(spark, sf_dir)
    nothing = F.array_repeat(F.lit(0.0).cast("float"), F.length("seq"))
    side = targets, targets.select("seq_id", nothing.alias("acc"), nothing.alias("cond"))
    seeds = seeds_query(spark, sf_dir).withColumn("hyb", F.col("energy") / 100.0)
    hits = ungapped_hits(seeds, Blocks(side, side), 5, 5, Model(rule_loops()))
    return hits.select("query_id", "target_id", "q_start", "t_start", F.col("q_len").alias("length"), F.round(F.col("hyb_energy") * 100).cast("int").alias("energy")).distinct()


def stem_loops_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds with those that follow within eight unpaired bases, and the energy of the loop between."""
    items = _benchmark(spark, sf_dir)
    return stem_loops(seeds_query(spark, sf_dir).drop("energy"), items, items, Model(rule_loops()))


def log_sum_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ln of the sum of exp(value) by type, from the largest value, so that nothing overflows."""
    events = _table(spark, sf_dir, "events")
    top = events.groupBy(F.col("event_type").alias("t")).agg(F.max("value").alias("top"))
    return events.join(top, F.col("event_type") == F.col("t")).groupBy("event_type").agg(F.round(F.first("top") + F.ln(F.sum(F.exp(F.col("value") - F.col("top")))), 6).alias("lse"))


def partition_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_documents(spark, sf_dir), 16)


def schedule_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return longest_first(_documents(spark, sf_dir))


def partition_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(_documents(spark, sf_dir), 16)


def partition_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(_documents(spark, sf_dir), 16)


def split_by_name_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, all_ = split_by_name(_documents(spark, sf_dir), "fr_")
    length = F.length("seq").cast("long").alias("length")
    return part.select(F.lit("part").alias("file"), "ord", "name", length).union(all_.select(F.lit("all"), "ord", "name", length))


def fasta_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("seq_id", wrapped(F.col("seq")).alias("lines"))


def fasta_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' sequences, written as FASTA and read again."""
    register(spark)
    path = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    _documents(spark, sf_dir).select(F.concat_ws(" ", F.col("seq_id").cast("string"), "name").alias("name"), "seq").write.format("fasta").mode("append").save(path)
    return spark.read.format("fasta").load(path).select("name", "seq", F.col("length").cast("long").alias("length"))


def _pairs(seeds: DataFrame) -> Column:
    return F.transform(F.sequence(F.lit(0), F.col("length") - 1), lambda k: F.struct((F.col("q_start") + k).alias("q"), (F.col("t_start") + F.col("length") - 1 - k).alias("t")))


def _format(style: int) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        seeds = seeds_query(spark, sf_dir)
        return seeds.select("query_id", "target_id", "q_start", "t_start", F.concat_ws(",", F.col("length").cast("string"), shortest(F.col("energy") / 100.0), pair_text(_pairs(seeds), style)).alias("line"))

    return query


def accessibility_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accessibility(_benchmark(spark, sf_dir), model=Model(rule_loops())).select("seq_id", F.posexplode(F.arrays_zip("acc", "cond")).alias("pos", "x")).select("seq_id", "pos", "x.acc", "x.cond")


def interaction_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = _benchmark(spark, sf_dir)
    model = Model(rule_loops())
    profiles = settled(accessibility(targets, model=model).select("seq_id", "acc", "cond"))
    return search(targets, targets, profiles, model=model, own=profiles).select("query_id", "target_id", "q_start", "t_start", "q_len", "t_len", "acc_energy", "hyb_energy", "energy", pair_text(F.col("base_pairs"), 1).alias("base_pairs"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "encode_hard": _encode(0), "encode_soft": _encode(1), "encode_nomask": _encode(2), "base_composition": base_composition, "seq_stats": seq_stats,
        "kmer_index": kmer_index_query, "kmer_ranges": kmer_ranges, "prefix_hash": prefix_hash, "start_positions": start_positions_query, "pos_to_seq": pos_to_seq,
        "diagonal_runs": diagonal_runs, "seed_search": seeds_query, "seed_search_kmer": seed_search_kmer, "seed_energy_hist": seed_energy_hist, "ungapped_pairs": ungapped_pairs, "dominance_candidates": dominance_candidates, "dominance": dominance, "ungapped_extension_hyb": ungapped_extension_hyb, "stem_loops": stem_loops_query,
        "log_sum_exp": log_sum_exp, "partition_block": partition_block, "schedule_sorted": schedule_sorted, "partition_balanced": partition_balanced, "partition_packed": partition_packed, "split_by_name": split_by_name_query,
        "fasta_wrap": fasta_wrap, "fasta_round_trip": fasta_round_trip, "format_style0": _format(0), "format_style1": _format(1), "accessibility": accessibility_query, "interaction_search": interaction_search,
    }


def _as_bases(text: str) -> str:
    return f"translate(regexp_replace(lower({text}), '[^a-z]', '', 'g'), '{_LETTERS}', '{_AS_BASES}')"


_DOCS = f"d as (select doc_id seq_id, doc_id ord, concat_ws('_', lang, source) as name, {_as_bases('text')} seq from documents)"
_CASED = f"d as (select doc_id seq_id, translate(regexp_replace(text, '[^A-Za-z]', '', 'g'), '{_LETTERS.upper() + _LETTERS}', '{_AS_BASES + _AS_BASES.lower()}') seq from documents)"
_NUMBER = "list_aggregate(list_transform(range(1, k + 1), lambda i: cast(pow(4, k - i) as bigint) * (instr('ACGU', substr(s, i, 1)) - 1)), 'sum')::bigint"
_KMERS = "x as (select substr(seq, p, 8) s, count(*) n from d, unnest(range(1, length(seq) + 1)) b(p) group by 1), w as (select k, left(x.s, k) s, sum(n)::bigint n from x, unnest(range(1, 9)) a(k) where k <= length(x.s) group by all)"
_COUNTS = f"n as (select k::int k, {_NUMBER} kmer, n from w)"
_STARTS = "s as (select seq_id, coalesce(sum(length(seq) + 1) over (order by ord rows between unbounded preceding and 1 preceding), 0)::bigint as start, length(seq)::bigint length from d)"
_TYPES = ", ".join(f"('{a}','{b}',{t})" for (a, b), t in _TYPE.items() if t)


def _stack_rows() -> str:
    from .functions.energy import REVERSE, STACK

    return ", ".join(f"({a},{b},{int(STACK[a, REVERSE[b]])})" for a in range(1, 7) for b in range(1, 7))


def _seeds(least: int = 5, most: int = 20, threshold: int = -600) -> str:
    """Seeds base by base: runs of pairs on each diagonal, running stacking energies, and the shortest stretch under the threshold from each pair."""
    return f"""pt(qb, tb, ty) as (values {_TYPES}), st(a, b, e) as (values {_stack_rows()}),
q as (select item_id id, {_as_bases('text')} seq from benchmark),
b as (select id, (i - 1)::int pos, substr(seq, i, 1) c from q, unnest(range(1, length(seq) + 1)) u(i)),
w as (select id, (p - 1)::int pos, substr(seq, p, {least}) s from q, unnest(range(1, length(seq) - {least - 2})) u(p)),
can(n, a, b) as (select 1, qb, tb from pt union all select n + 1, a || qb, tb || b from can, pt where n < {least}),
met as (select x.id query_id, y.id target_id, x.pos i, x.pos + y.pos + {least - 1} diag from w x join can on a = x.s and n = {least} join w y on y.s = can.b),
far as (select distinct query_id, target_id, (i + k)::int i, diag from met, unnest(range(0, {least})) u(k)),
cells as (select query_id, target_id, far.i, diag, ty from far join b x on x.id = query_id and x.pos = far.i join b y on y.id = target_id and y.pos = diag - far.i join pt on qb = x.c and tb = y.c),
isl as (select *, i - row_number() over (partition by query_id, target_id, diag order by i) island from cells),
big as (select *, count(*) over (partition by query_id, target_id, diag, island) m, lag(ty) over (partition by query_id, target_id, diag, island order by i) prev from isl),
run as (select query_id, target_id, diag, island, i, sum(coalesce(e, 0)) over (partition by query_id, target_id, diag, island order by i rows unbounded preceding)::int total from (select * from big where m >= {least}) left join st on a = prev and b = ty),
hit as (select x.query_id, x.target_id, x.i q_start, x.diag, min(y.i - x.i + 1)::int length from run x join run y using (query_id, target_id, diag, island) where y.i - x.i + 1 between {least} and {most} and y.total - x.total < {threshold} group by x.query_id, x.target_id, x.i, x.diag, x.island),
seeds as (select h.query_id, h.target_id, h.q_start, (h.diag - h.q_start - h.length + 1)::int t_start, h.length, (y.total - x.total)::int energy from hit h join run x on x.query_id = h.query_id and x.target_id = h.target_id and x.diag = h.diag and x.i = h.q_start join run y on y.query_id = h.query_id and y.target_id = h.target_id and y.diag = h.diag and y.i = h.q_start + h.length - 1)"""


#: Pair by pair and hit by hit in order: hits that are there (with their place in the order), and places of those that went after their turn.
_DOMINANCE = """, h as (select query_id, target_id, q_start qs, q_start + length qe, t_start ts, t_start + length te, energy e, row_number() over (partition by query_id, target_id order by t_start + length desc, q_start, length desc, energy) r from seeds where energy <= -700),
step(query_id, target_id, r, there, gone) as (
 select query_id, target_id, 0::bigint, []::struct(qs int, qe int, ts int, te int, e int, r bigint)[], []::bigint[] from (select distinct query_id, target_id from h)
 union all
 select query_id, target_id, r, case when k is null then list_append(there, {'qs': qs, 'qe': qe, 'ts': ts, 'te': te, 'e': e, 'r': r}) else there end, list_concat(gone, list_transform(list_filter(over_, lambda x: x.e > h.e and (k is null or x.r < k)), lambda x: x.r))
 from (select s.there, s.gone, h.*, list_filter(s.there, lambda x: x.qs <= h.qs and x.qe >= h.qe and x.ts <= h.ts and x.te >= h.te) over_, list_min(list_transform(list_filter(s.there, lambda x: x.qs <= h.qs and x.qe >= h.qe and x.ts <= h.ts and x.te >= h.te and x.e <= h.e), lambda x: x.r)) k
       from step s join h on h.query_id = s.query_id and h.target_id = s.target_id and h.r = s.r + 1) h),
final as (select query_id, target_id, arg_max(there, r) there, arg_max(gone, r) gone from step group by 1, 2)
select query_id, target_id, x.qs q_start, x.ts t_start, (x.qe - x.qs)::int length, x.e energy from (select query_id, target_id, unnest(list_filter(there, lambda y: not list_contains(gone, y.r))) x from final)"""


def _ungapped(drop: int = 5) -> str:
    """Each seed to both sides, a pair of bases a step: the last pair, its energy, and the best of the way so far; loops of the rule's tables have as many unpaired bases on both sides."""
    from .functions.energy import INTERIOR

    sizes = ", ".join(f"({n}, {int(INTERIOR[n])})" for n in range(5, 31))
    bonus = "(case when ({0} = 'A' and {1} = 'G') or ({0} = 'G' and {1} = 'A') then -50 when {0} = 'U' and {1} = 'U' then -45 else 0 end)"
    weak = "((y.o > 2)::int + (y.n > 2)::int)"
    # a, b: first and last unpaired base of the outer pair's 3' way on the query; c, d: on the target, beside the inner and the outer pair
    loop = f"""case when y.u = 0 then e1.e when y.u = 1 then 60 + 48 * {weak} - case when y.a = 'G' and y.d = 'G' then 55 else 0 end
 when y.u = 2 then 110 + 55 * {weak} + {bonus.format('y.a', 'y.d')} + {bonus.format('y.c', 'y.b')} else i.e + 63 * {weak} + {bonus.format('y.a', 'y.d')} + {bonus.format('y.c', 'y.b')} end"""
    return f""", sz(n, e) as (values {sizes}), ways(w) as (values (-1), (1)),
x0 as (select distinct query_id, target_id, q_start, t_start, length, energy from seeds),
walk(query_id, target_id, q_start, t_start, length, w, k, v, lk, lv, lt, now, best, bk, goes) as (
 select s.query_id, s.target_id, q_start, t_start, length, w, case w when 1 then q_start + length - 1 else q_start end, case w when 1 then t_start else t_start + length - 1 end, case w when 1 then q_start + length - 1 else q_start end, case w when 1 then t_start else t_start + length - 1 end, ty, 0, 0, case w when 1 then q_start + length - 1 else q_start end, true
 from x0 s, ways join q a on a.id = query_id join q b on b.id = target_id join pt on qb = substr(a.seq, (case w when 1 then q_start + length - 1 else q_start end) + 1, 1) and tb = substr(b.seq, (case w when 1 then t_start else t_start + length - 1 end) + 1, 1)
 union all
 select query_id, target_id, q_start, t_start, length, w, k, v, case when ty is null then lk else k end, case when ty is null then lv else v end, coalesce(ty, lt), coalesce(now + le, now), case when now + le < best then now + le else best end, case when now + le < best then k else bk end, abs(k - case when now + le < best then k else bk end) < {drop}
 from (select y.*, {loop} le from (select z.*, ty, abs(z.k - lk) - 1 u, case w when 1 then lt else ty end o, case w when 1 then ty else lt end n,
   substr(qs, case w when 1 then lk + 2 else z.k + 2 end, 1) a, substr(qs, case w when 1 then z.k else lk end, 1) b, substr(ts, case w when 1 then z.v + 2 else lv + 2 end, 1) c, substr(ts, case w when 1 then lv else z.v end, 1) d
   from (select s.* exclude (k, v), s.k + w k, s.v - w v, a.seq qs, b.seq ts from walk s join q a on a.id = query_id join q b on b.id = target_id where goes and s.k + w between 0 and length(a.seq) - 1 and s.v - w between 0 and length(b.seq) - 1) z
   left join pt on qb = substr(qs, z.k + 1, 1) and tb = substr(ts, z.v + 1, 1)) y left join st e1 on e1.a = y.o and e1.b = y.n left join sz i on i.n = 2 * y.u)),
ends as (select query_id, target_id, q_start, t_start, length, w, arg_max(bk, w * k) bk, min(best) best from walk group by all)
select distinct s.query_id, s.target_id, l.bk q_start, (s.t_start + s.length - 1 - (r.bk - s.q_start))::int t_start, (r.bk - l.bk + 1)::int length, (s.energy + l.best + r.best)::int energy
from x0 s join ends l on l.w = -1 and (l.query_id, l.target_id, l.q_start, l.t_start) = (s.query_id, s.target_id, s.q_start, s.t_start) join ends r on r.w = 1 and (r.query_id, r.target_id, r.q_start, r.t_start) = (s.query_id, s.target_id, s.q_start, s.t_start)"""


def _stem_loops(reach: int = 8) -> str:
    """Each kind of loop by its rule."""
    from .functions.energy import BULGE, INTERIOR

    tables = "sz(n, bulge, loop) as (values " + ", ".join(f"({n}, {int(BULGE[n])}, {int(INTERIOR[n])})" for n in range(1, reach + 1)) + ")"
    bonus = "(case when ({0} = 'A' and {1} = 'G') or ({0} = 'G' and {1} = 'A') then -50 when {0} = 'U' and {1} = 'U' then -45 else 0 end)"
    both = f"{bonus.format('y.a', 'y.d')} + {bonus.format('y.c', 'y.b')}"
    weak = "((y.o > 2)::int + (y.i > 2)::int)"
    return f""", {tables},
m as (select x.query_id, x.target_id, x.q_start, x.t_start, x.length, y.q_start q_next, y.t_start t_next, y.length next_length, (y.q_start - x.q_start - x.length)::int u1, (x.t_start - y.t_start - y.length)::int u2
 from seeds x join seeds y using (query_id, target_id) where y.q_start - x.q_start - x.length >= 0 and x.t_start - y.t_start - y.length >= 0 and y.q_start - x.q_start - x.length + x.t_start - y.t_start - y.length between 1 and {reach}),
y as (select m.*, po.ty o, pi.ty i, substr(f.seq, q_start + length + 1, 1) a, substr(f.seq, q_next, 1) b, substr(g.seq, t_next + next_length + 1, 1) c, substr(g.seq, t_start, 1) d
 from m join q f on f.id = query_id join q g on g.id = target_id join pt po on po.qb = substr(f.seq, q_start + length, 1) and po.tb = substr(g.seq, t_start + 1, 1) join pt pi on pi.qb = substr(f.seq, q_next + 1, 1) and pi.tb = substr(g.seq, t_next + next_length, 1))
select query_id, target_id, q_start, t_start, length, q_next, t_next, next_length, u1, u2, (case when least(u1, u2) = 0 and u1 + u2 = 1 then bulge + st.e when least(u1, u2) = 0 then bulge + 56 * {weak}
 when u1 = 1 and u2 = 1 then 60 + 48 * {weak} - case when y.a = 'G' and y.d = 'G' then 55 else 0 end when u1 + u2 = 3 then 171 + 66 * {weak} when u1 = 2 and u2 = 2 then 110 + 55 * {weak} + {both} else loop + 63 * {weak} + {both} end)::int energy
from y join sz on sz.n = u1 + u2 join st on st.a = y.o and st.b = y.i"""


def oracle_sql() -> dict[str, str]:
    def encode(mask: str, digits: str, source: str = "NACGUacgu") -> str:
        return f"with {_CASED}, m as (select seq_id, {mask} seq from d) select seq_id, reverse(translate(seq, '{source}', '{digits}')) || '0' codes, length(regexp_replace(seq, '[^ACGU]', '', 'g'))::bigint known from m"

    line = "length || ',' || regexp_replace(regexp_replace(printf('%.2f', energy / 100.0), '0+$', ''), '\\.$', '') || ',' ||"
    pairs = "string_agg('(' || (q_start + k) || ':' || (t_start + length - 1 - k) || ') ', '' order by k)"
    return {
        "encode_hard": encode("regexp_replace(seq, '[^ACGU]', 'N', 'g')", "123456789"),
        "encode_soft": encode("seq", "123456789"),
        "encode_nomask": encode("upper(seq)", "123456789"),
        "base_composition": f"with {_DOCS} select name, count(*) records, sum(length(seq))::bigint length, " + ", ".join(f"sum(length(seq) - length(replace(seq, '{b}', '')))::bigint n_{b.lower()}" for b in "ACGU") + " from d group by name",
        "seq_stats": f"with {_DOCS} select ord + 1 number, length(seq)::bigint length from d",
        "kmer_index": f"with d as (select item_id seq_id, {_as_bases('text')} seq from benchmark) select list_aggregate(list_transform(range(1, 9), lambda i: cast(pow(4, 8 - i) as bigint) * (instr('ACGU', substr(seq, p + i - 1, 1)) - 1)), 'sum')::bigint kmer, seq_id, (p - 1)::int pos from d, unnest(range(1, length(seq) - 6)) b(p)",
        "kmer_ranges": f"with {_DOCS}, {_KMERS}, {_COUNTS} select * from n",
        "prefix_hash": f'with {_DOCS}, {_KMERS}, {_COUNTS} select k, kmer, (sum(n) over w - n)::bigint as "first", (sum(n) over w - 1)::bigint as "last" from n window w as (partition by k order by kmer rows unbounded preceding)',
        "start_positions": f"with {_DOCS}, {_STARTS} select * from s",
        "pos_to_seq": f'with {_DOCS}, {_STARTS}, o as (select o_orderkey * 37 "position" from orders) select "position", seq_id, "position" - start as "offset" from o asof join s on "position" >= start where "position" < start + length',
        "diagonal_runs": f"with recursive {_seeds()}, g as (select *, i - row_number() over (partition by query_id, target_id, diag order by i) run from met) select query_id, target_id, diag diagonal, min(i)::int q_start, (max(i) + 4)::int q_end, (count(*) + 4)::bigint pairs from g group by query_id, target_id, diag, run",
        "seed_search": f"with recursive {_seeds()} select * from seeds",
        "seed_search_kmer": f"with recursive {_seeds()} select * from seeds",
        "seed_energy_hist": f"with recursive {_seeds()} select length, floor(energy / 100.0)::bigint kcal, count(*)::bigint n, sum(energy)::bigint total from seeds group by 1, 2",
        "ungapped_pairs": f"with recursive {_seeds()} select query_id, target_id, q_start, t_start, (q_start + k)::int q, (t_start + length - 1 - k)::int t from seeds, unnest(range(0, length)) u(k)",
        "dominance_candidates": f"with recursive {_seeds()} select x.query_id, x.target_id, x.q_start, x.t_start, x.length, y.q_start q_in, y.t_start t_in, y.length inner_length from seeds x join seeds y using (query_id, target_id) where y.q_start >= x.q_start and y.t_start >= x.t_start and y.q_start + y.length <= x.q_start + x.length and y.t_start + y.length <= x.t_start + x.length and y.length < x.length",
        "dominance": f"with recursive {_seeds()}{_DOMINANCE}",
        "ungapped_extension_hyb": f"with recursive {_seeds()}{_ungapped()}",
        "stem_loops": f"with recursive {_seeds()}{_stem_loops()}",
        "log_sum_exp": "with m as (select event_type, max(value) top from events group by 1) select event_type, round(any_value(top) + ln(sum(exp(value - top))), 6) lse from events join m using (event_type) group by event_type",
        "partition_block": "select doc_id seq_id, floor(doc_id / ((select count(*) from documents) // 16 + 1))::int bin from documents",
        "schedule_sorted": f"with {_DOCS} select seq_id, length(seq)::bigint length from d",
        "split_by_name": f"with {_DOCS}, l as (select * from d qualify row_number() over (partition by name order by ord desc) = 1) select 'part' file, ord, name, length(seq)::bigint length from l where contains(name, 'fr_') union all select 'all', ord, name, length(seq)::bigint from l",
        "fasta_wrap": f"with {_DOCS} select seq_id, regexp_replace(regexp_replace(seq, '(.{{60}})', '\\1' || chr(10), 'g'), chr(10) || '$', '') as lines from d",
        "fasta_round_trip": f"with {_DOCS} select concat_ws(' ', seq_id, name) as name, coalesce(seq, '') seq, coalesce(length(seq), 0)::bigint length from d",
        "format_style0": f"with recursive {_seeds()} select query_id, target_id, q_start, t_start, {line} '(' || q_start || '-' || (q_start + length - 1) || ':' || (t_start + length - 1) || '-' || t_start || ') ' as line from seeds",
        "format_style1": f"with recursive {_seeds()} select query_id, target_id, q_start, t_start, {line} {pairs} as line from seeds, unnest(range(0, length)) u(k) group by query_id, target_id, q_start, t_start, length, energy",
    }
