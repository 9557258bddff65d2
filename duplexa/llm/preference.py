"""Preference formatting with built-in functions only: paired conversations, their common prompt rendered once, and two masked completions.

All of it is windows and one aggregation over the turns, dealt by pair: a turn's place in its conversation, whether the other side has the same turn there, whether all turns so far were common, and running
lengths for the spans that are trained on. So the work is linear in the turns, and a conversation is only put together as the text it becomes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
#: Turns of this role are what the model learns to write.
TRAINED = "assistant"


def preference_format(turns: DataFrame, trained: str = TRAINED) -> DataFrame:
    """A row for each pair of conversations from turns (pair_id, side, turn, role, text), side being chosen or rejected.

    pair_id, n_common (turns of the longest common prefix), prompt (those turns rendered), chosen and rejected (the other turns of each rendered, null if that side has no
    conversation), and chosen_mask and rejected_mask: the spans of each completion that are trained on, start:end in code points, end exclusive, comma-joined: the text and end mark of each turn of the trained role.

    Turns go by number, nulls first, ties by role and text; repeated rows are turns of their own. A null role is `unknown`, a null text empty. Rows without pair_id or side are left out. With one
    side only nothing is common. A hot pair is one output row; nothing but its own turns meets in a task.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("unknown")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.where("pair_id is not null and side in ('chosen', 'rejected')").select(F.col("pair_id").cast("long").alias("pair_id"), "side", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).repartition("pair_id")
    head = F.concat(F.lit(OPEN), F.col("role"), F.lit(CLOSE))
    place = F.row_number().over(Window.partitionBy("pair_id", "side").orderBy(F.col("turn").asc_nulls_first(), "role", "text"))
    rows = rows.withColumn("place", place).withColumn("head", F.length(head)).withColumn("rendered", F.concat(head, F.col("text"), F.lit(END)))
    same = Window.partitionBy("pair_id", "place")
    rows = rows.withColumn("equal", (F.count("*").over(same) == 2) & (F.min("rendered").over(same) == F.max("rendered").over(same)) & (F.min("role").over(same) == F.max("role").over(same)))
    so_far = Window.partitionBy("pair_id").orderBy("place").rangeBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("common", F.min("equal").over(so_far))
    own = Window.partitionBy("pair_id", "side").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.when(~F.col("common"), F.length("rendered"))).over(own), F.lit(0)) + F.col("head")
    rows = rows.withColumn("start", before)
    span = F.concat_ws(":", F.col("start").cast("string"), (F.col("start") + F.length("text") + len(END)).cast("string"))

    def joined(which, what, by: str):
        return F.array_join(F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("place", what.alias("x"))))), lambda p: p["x"]), by)

    def side(name: str):
        mine, rest = F.col("side") == name, ~F.col("common")
        there = F.max(mine)
        return F.when(there, joined(mine & rest, F.col("rendered"), "")).alias(name), F.when(there, joined(mine & rest & (F.col("role") == trained), span, ",")).alias(f"{name}_mask")

    chosen, rejected = side("chosen"), side("rejected")
    return rows.groupBy("pair_id").agg(
        F.count(F.when((F.col("side") == "chosen") & F.col("common"), 1)).alias("n_common"),
        joined((F.col("side") == "chosen") & F.col("common"), F.col("rendered"), "").alias("prompt"),
        chosen[0], rejected[0], chosen[1], rejected[1],
    )


def paired_by_id(conversations: DataFrame) -> DataFrame:
    """Turns of conversations whose ids are neighbours, as pairs: 2n is the chosen one, 2n + 1 the rejected one. Rows without conv_id are left out."""
    pair = F.floor(F.col("conv_id") / 2).cast("long")
    return conversations.where("conv_id is not null").select(pair.alias("pair_id"), F.when(F.col("conv_id") - 2 * pair == 0, "chosen").otherwise("rejected").alias("side"), "turn", "role", "text")


def paired_by_answer(conversations: DataFrame, trained: str = TRAINED) -> DataFrame:
    """Turns of each conversation up to its last answer as chosen, and the same turns before that answer with the last answer of its neighbour (2n and 2n + 1 are neighbours) in its place as rejected: pairs with a common prompt.

    Turns are numbered as preference_format orders them. A conversation without an answer is chosen whole; with that, or without a neighbour that has an answer, there is no rejected side. Rows without conv_id are left out.
    """
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = Window.partitionBy("pair_id")
    rows = rows.withColumn("place", F.row_number().over(own.orderBy(F.col("turn").asc_nulls_first(), "role", "text")).cast("long")).withColumn("last", F.max(F.when(F.col("role") == trained, F.col("place"))).over(own))
    answers = rows.where("place = last").select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("text").alias("other"))
    both = rows.where("place <= coalesce(last, place)").join(answers, "pair_id", "left")
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    sides = F.array_compact(F.array(side("chosen", F.col("text")), F.when(F.col("other").isNotNull() & F.col("last").isNotNull(), side("rejected", F.when(F.col("place") == F.col("last"), F.col("other")).otherwise(F.col("text"))))))
    return both.select("pair_id", F.col("place").alias("turn"), "role", F.explode(sides).alias("s")).select("pair_id", "s.side", "turn", "role", "s.text")


#: DuckDB SQL for preference_format(paired_by_answer(conversations)).
SQL = r"""
with p as (
  select conv_id pair_id, coalesce(role, 'unknown') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, 'unknown'), coalesce(text, '')) turn
  from conversations where conv_id is not null),
l as (select *, max(case when role = 'assistant' then turn end) over (partition by pair_id) last from p),
n as (select xor(pair_id, 1) pair_id, text other from l where turn = last),
t as (
  select pair_id, 'chosen' side, turn, role, text from l where turn <= coalesce(last, turn)
  union all
  select pair_id, 'rejected', turn, role, case when turn = last then other else text end from l join n using (pair_id) where turn <= last),
r as (select *, row_number() over (partition by pair_id, side order by turn nulls first, role, text) place, length(role) + 5 head,
        '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) rendered from t),
e as (select *, count(*) over w = 2 and min(rendered) over w = max(rendered) over w and min(role) over w = max(role) over w equal from r window w as (partition by pair_id, place)),
c as (select *, bool_and(equal) over (partition by pair_id order by place range unbounded preceding) common from e),
s as (select *, head + coalesce(sum(case when not common then length(rendered) end) over (partition by pair_id, side order by place rows between unbounded preceding and 1 preceding), 0) start from c)
select pair_id,
  count(*) filter (side = 'chosen' and common) n_common,
  coalesce(string_agg(rendered, '' order by place) filter (side = 'chosen' and common), '') prompt,
  case when bool_or(side = 'chosen') then coalesce(string_agg(rendered, '' order by place) filter (side = 'chosen' and not common), '') end chosen,
  case when bool_or(side = 'rejected') then coalesce(string_agg(rendered, '' order by place) filter (side = 'rejected' and not common), '') end rejected,
  case when bool_or(side = 'chosen') then coalesce(string_agg(start::bigint || ':' || (start + length(text) + 8)::bigint, ',' order by place) filter (side = 'chosen' and not common and role = 'assistant'), '') end chosen_mask,
  case when bool_or(side = 'rejected') then coalesce(string_agg(start::bigint || ':' || (start + length(text) + 8)::bigint, ',' order by place) filter (side = 'rejected' and not common and role = 'assistant'), '') end rejected_mask
from s group by pair_id
"""
