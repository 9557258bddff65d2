"""Personal data by proposing patterns, checksum validators and context words, with built-in functions only.

Positions come from splitting a text at a pattern: what stands between matches and the matches themselves, one after the other, give starts as running sums, so
long texts with many matches stay linear. Patterns use possessive repeats, and a look-behind for runs that cannot match from their middle, so that no text makes the regular
expression engine backtrack or recurse; they match what the plain forms match.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters before and after a match in which context words count.
NEAR = 48
#: What context words add and detracting words take.
ADJUST = 0.3
#: Spans of kinds without a checksum of their own are reported from this score on.
ENOUGH = 0.6

_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; read from its end, every second digit counts doubled."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    at = lambda i: F.ascii(F.substr(F.reverse(digits), i, F.lit(1))) - 48
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + F.when(i % 2 == 0, doubled(at(i))).otherwise(at(i)))
    return F.when(F.length(digits) > 0, total % 10 == 0).otherwise(False)


def mod97(account: Column) -> Column:
    """Whether an IBAN without blanks has the remainder 1 modulo 97."""
    turned = F.concat(F.substr(account, F.lit(5)), F.substr(account, F.lit(1), F.lit(4)))
    value = lambda c: F.when(c >= 65, c - 55).otherwise(c - 48)
    step = lambda acc, c: (acc * F.when(F.ascii(c) >= 65, 100).otherwise(10) + value(F.ascii(c))) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c))) == 1


@dataclass(frozen=True)
class Kind:
    """A sort of personal data: what proposes it, a cheap test of a whole text that must hold first, what confirms a match, and words beside it."""

    name: str
    pattern: str
    possible: Callable[[Column], Column]
    confirm: Callable[[Column], Column]
    score: float
    near: str
    base: bool = True


KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: F.contains(t, F.lit("@")), lambda m: F.lit(True), 0.9, "mail|contact|write|escrib|schreib|correo|courriel"),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: F.rlike(t, F.lit(r"[0-9]\.[0-9]")), lambda m: F.rlike(m, F.lit(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")), 0.7, r"\bip\b|server|host|address|login"),
    Kind("card", r"[0-9](?:[ -]?[0-9])++", lambda t: F.rlike(t, F.lit("[0-9](?:[ -]?[0-9]){13}")), lambda m: F.when(F.length(_digits(m)).between(14, 19), luhn(_digits(m))).otherwise(False), 0.8, "card|visa|credit|karte|carte|tarjeta|master|amex"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", lambda t: F.contains(t, F.lit("+")), lambda m: F.length(_digits(m)).between(10, 15), 0.8, "call|tel|phone|mobil|fax|llam|appel|anruf"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", lambda t: F.rlike(t, F.lit("[A-Z]{2}[0-9]{2} ?[A-Z0-9]")), lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.9, "iban|bank|konto|compte|cuenta|account", base=False),
    Kind("local_phone", r"(?<![0-9+A-Za-z.()-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])", lambda t: F.rlike(t, F.lit("[0-9]{3}[ .-][0-9]{4}")), lambda m: F.lit(True), 0.4, "call|tel|phone|mobil|fax|llam|appel|anruf", base=False),
    Kind("national_id", r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])", lambda t: F.rlike(t, F.lit("[0-9]{3}-[0-9]{2}-[0-9]{4}")), lambda m: ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$")), 0.4, r"ssn|social|security|tax|identi", base=False),
)
BASE = tuple(k.name for k in KINDS if k.base)
#: Words that speak against personal data next to a match.
AGAINST = r"version|invoice|order no|isbn|example number"


def scored(text: Column, kind: Kind) -> Column:
    """All matches of a kind in order, as gap (characters since the last match), match, score and ok; at the end one without match.

    The score starts from the kind's own if its validator confirms the match, else 0, and moves by ADJUST for words near it. A confirmed match of a base kind is always ok.
    """
    between, found = F.split(text, kind.pattern, -1), F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pairs = F.zip_with(between, found, lambda p, m: F.struct(p.alias("p"), m.alias("m")))
    beside = F.zip_with(pairs, F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0))), lambda x, n: F.struct(x["p"].alias("p"), x["m"].alias("m"), F.concat(F.right(x["p"], F.lit(NEAR)), F.lit(" "), F.left(F.coalesce(n, F.lit("")), F.lit(NEAR))).alias("near")))

    def judged(x: Column) -> Column:
        sure = F.when(x["m"].isNull(), False).otherwise(kind.confirm(x["m"]))
        score = F.when(sure, F.lit(kind.score) + F.when(F.rlike(F.lower(x["near"]), F.lit(kind.near)), ADJUST).otherwise(0.0) - F.when(F.rlike(F.lower(x["near"]), F.lit(AGAINST)), ADJUST).otherwise(0.0)).otherwise(0.0)
        return F.struct(F.length(x["p"]).alias("gap"), x["m"].alias("m"), F.least(F.lit(1.0), score).alias("score"), (sure if kind.base else score >= ENOUGH).alias("ok"), x["p"].alias("p"))

    return F.transform(beside, judged)


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), and for each span ord (the kind's place in KINDS), start, end (code points, end exclusive), value and score; a row without ord for each document, with the number of its copies.

    Null and empty texts have no spans. Rows that repeat an id with another text are looked at one by one; those that repeat id and text are one document with copies, put together on the map side already. Other columns are ignored.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    shape = "array<struct<ord:int,gap:int,m:string,score:double,ok:boolean>>"
    none = F.array(F.struct(F.lit(None).cast("int").alias("ord"), F.lit(0).alias("gap"), F.lit(None).cast("string").alias("m"), F.lit(0.0).alias("score"), F.lit(False).alias("ok"))).cast(shape)
    empty = F.array().cast(shape)

    def tagged(i: int, kind: Kind) -> Column:
        parts = F.transform(scored(F.col("text"), kind), lambda x: F.struct(F.lit(i).alias("ord"), x["gap"].alias("gap"), x["m"].alias("m"), x["score"].alias("score"), x["ok"].alias("ok")))
        return F.when(kind.possible(F.col("text")), parts.cast(shape)).otherwise(empty)

    rows = (
        docs.select("doc_id", text.alias("text"))
        .withColumn("row", F.xxhash64("text"))
        .select("doc_id", "row", F.posexplode(F.concat(none, *(tagged(i, k) for i, k in enumerate(KINDS)))).alias("at", "x"))
        .select("doc_id", "row", "at", "x.*")
        .groupBy("doc_id", "row", "at", "ord", "gap", "m", "score", "ok")
        .agg(F.count("*").alias("copies"))
    )
    before = Window.partitionBy("doc_id", "row", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.coalesce(F.length("m"), F.lit(0))).over(before)
    return rows.withColumn("end", end.cast("long")).where("ord is null or ok").select("doc_id", "row", "ord", (F.col("end") - F.length("m")).alias("start"), "end", F.col("m").alias("value"), "score", "copies")


def find_pii(docs: DataFrame) -> DataFrame:
    """A row for each document: counts of the base kinds, a digest of their spans, all spans as kind:start:end, and the highest score (0 if none)."""
    name = F.element_at(F.array(*(F.lit(k.name) for k in KINDS)), F.col("ord") + 1)
    line = F.struct("start", "ord", F.concat_ws(":", name, F.col("start").cast("string"), F.col("end").cast("string")).alias("line"))
    base = F.col("ord") < len(BASE)
    joined = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["line"]), ",")
    return (
        spans(docs)
        .groupBy("doc_id", "row")
        .agg(*(F.count(F.when(F.col("ord") == i, 1)).alias(f"n_{k}") for i, k in enumerate(BASE)), F.collect_list(F.when(base, line)).alias("own"), F.collect_list(F.when(F.col("ord").isNotNull(), line)).alias("all"), F.max("score").alias("score"), F.max(F.when(F.col("ord").isNull(), F.col("copies"))).alias("copies"))
        .withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("doc_id", *(f"n_{k}" for k in BASE), F.sha2(joined(F.col("own")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), "score")
    )


def _masked(kind: Kind) -> Callable[[Column], Column]:
    return lambda x: F.concat(x["p"], F.when(x["ok"], F.lit(f"[{kind.name.upper()}]")).otherwise(F.coalesce(x["m"], F.lit(""))))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each span that find_pii reports replaced by its kind in brackets, kind after kind; a null text stays null, n_chars follows the text if there is such a column."""
    out = docs
    for kind in KINDS:
        masked = F.array_join(F.transform(scored(F.col("text"), kind), _masked(kind)), "")
        out = out.withColumn("text", F.when(kind.possible(F.col("text")), masked).otherwise(F.col("text")))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out
