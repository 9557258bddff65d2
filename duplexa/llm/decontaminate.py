"""Benchmark decontamination by template canonicalisation, with built-in functions only.

Numbers, names inside a sentence and units after a number become typed placeholders, so that re-parameterised items are alike. Items that are alike, and that repeat their own values at the same slots, are one template; windows
of canonical words of all documents meet those of the distinct templates in a hash join, so a thousand variants of one question cost as much as one, and a document is reported once for all of them. members says which items a
template has. A template found in a document by enough of its windows must have its slots filled consistently in one of its occurrences there, whatever others hold: a value of the item stands for one value of the
document and the reverse, so that re-parameterised questions are caught and chance agreement of number-laden text is not.

A window says something only by its plain words, PLAIN at least. Windows have WINDOW words, or for items laden with numbers and names the least length of LENGTHS at which half of an item's windows have as many. Items
without that, and items of fewer words than a window, are looked for word for word: their windows (of a short one, the whole) are of words as they stand, lower-cased. Items of fewer than SHORTEST words are in all speech, and so are found
only where they are the whole document.

Documents meet a template by its rarest windows first, as many as one of which must be there if the template is to count; only such pairs are looked at in full, so that openings which many items share cost no more than others.

The templates' windows are settled, so Spark broadcasts them only if their true size is under its broadcast threshold, and shuffles both sides otherwise; windows of documents carry no text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

WINDOW = 8
#: Lengths of windows for items that need longer ones.
LENGTHS = (WINDOW, 12, 16, 24, 32, 48, 64, 96, 128)
#: Plain words that a window of canonical words needs.
PLAIN = 4
SHORTEST = 4
#: A template is found from this share of its windows on, or from so many words in one piece.
SHARE, RUN = 0.4, 30
#: Slot values that conflict, as a share of the slots, up to which slots count as consistently filled.
CONFLICTS = 0.2

NUMBER, UNIT, NAME = "0", "qunit", "qname"
UNITS = ("mm", "cm", "m", "km", "mg", "g", "kg", "t", "ml", "cl", "l", "ms", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "meters", "metres", "kilometers", "kilometres", "grams", "kilograms", "liters", "litres", "miles", "feet", "inches", "pounds", "dollars", "euros", "cents", "percent", "degrees", "w", "kw", "v", "hz", "mb", "gb")

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_POINT = r"(?<=[0-9])[.,](?=[0-9])"
_NAME = r"(?<=[\p{Ll},;] )\p{Lu}\p{Ll}+(?![\p{L}\p{N}])"
_NUMBER = r"[0-9]+(?:·[0-9]+)*"
_UNIT = rf"(?<=0 ?)(?i:{'|'.join(sorted(UNITS, key=len, reverse=True))})(?![\p{{L}}\p{{N}}])"


def _joined(text: Column) -> Column:
    """A text whose decimal numbers are one word each."""
    return F.when(F.rlike(text, F.lit("[0-9][.,][0-9]")), F.regexp_replace(text, _POINT, "·")).otherwise(text)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, _BETWEEN), lambda w: w != "")


def raw_words(text: Column) -> Column:
    """Words as they stand; each has its canonical word at the same place."""
    return _words(_joined(text))


def canonical_words(text: Column) -> Column:
    """Words in lower case, with placeholders for names, numbers and units."""
    named = F.regexp_replace(_joined(text), _NAME, NAME)
    numbered = F.regexp_replace(F.regexp_replace(named, _NUMBER, NUMBER), _UNIT, UNIT)
    return _words(F.lower(F.when(F.rlike(text, F.lit("[0-9]")), numbered).otherwise(named)))


def _is_slot(word: Column) -> Column:
    return (word == NAME) | (word == NUMBER) | (word == UNIT) | (word == NUMBER + UNIT)


CANONICAL, VERBATIM, WHOLE = "canonical", "verbatim", "whole"


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _key(mode: str, length: Column | int, hashes: Column, place: Column) -> Column:
    return F.xxhash64(F.lit(mode), F.slice(hashes, place + 1, length if isinstance(length, Column) else F.lit(length)))


def _window_keys(words: Column, mode: str, lengths: list[int]) -> Column:
    """(at, key) of each run of so many words; nested, so that the words are made once."""

    def keys(h: Column, length: int) -> Column:
        some = F.size(h) == length if mode == WHOLE else F.size(h) >= length
        return F.when(some, F.transform(F.sequence(F.lit(0), F.size(h) - length), lambda i: F.struct(i.alias("at"), _key(mode, length, h, i).alias("key")))).otherwise(F.array().cast("array<struct<at:int,key:bigint>>"))

    return F.element_at(F.transform(F.array(_hashes(words)), lambda h: F.concat(*(keys(h, n) for n in lengths))), 1)


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, words (canonical), raw (lower case), mode and length of its windows, template (a hash) and filled (a hash of the slots' values), a row for each distinct text of an item."""
    text = F.col("text").cast("string")
    rows = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), canonical_words(text).alias("words"), F.transform(raw_words(text), F.lower).alias("raw")).distinct()
    rows = settle(rows.where(F.size("words") > 0))
    n = F.size("words")

    def telling(length: int) -> Column:
        """Whether half of the windows of this length have enough plain words."""
        have = F.filter(F.sequence(F.lit(0), n - length), lambda i: F.size(F.filter(F.slice("words", i + 1, F.lit(length)), lambda w: ~_is_slot(w))) >= PLAIN)
        return F.when(n >= length, 2 * F.size(have) >= n - length + 1).otherwise(False)

    fits = F.coalesce(*(F.when(telling(k), F.lit(k)) for k in LENGTHS))
    rows = rows.withColumn("fits", fits).select(
        "item_id", "words", "raw",
        F.when(n < SHORTEST, WHOLE).when(F.col("fits").isNull(), VERBATIM).otherwise(CANONICAL).alias("mode"),
        F.coalesce("fits", F.least(n, F.lit(WINDOW))).alias("length"),
        F.transform(F.filter(F.arrays_zip("words", "raw"), lambda x: _is_slot(x["words"])), lambda x: x["raw"]).alias("values"),
    )
    pattern = F.transform("values", lambda v: F.array_position(F.col("values"), v))
    alike = F.when(F.col("mode") == CANONICAL, F.xxhash64(F.lit(CANONICAL), "words", F.lit("|"), pattern)).otherwise(F.xxhash64(F.col("mode"), "raw"))
    return rows.select("item_id", "words", "raw", "mode", "length", alike.alias("template"), F.xxhash64("values").alias("filled"))


def members(benchmark: DataFrame) -> DataFrame:
    """item_id (the least of a template's items, which leaks reports) and member, a row for each item of each template."""
    items = _items(benchmark).select("template", "item_id").distinct()
    return items.join(items.groupBy("template").agg(F.min("item_id").alias("first")), "template").select(F.col("first").alias("item_id"), F.col("item_id").alias("member")).distinct()


def _occurrences(found: DataFrame) -> DataFrame:
    """doc_id, template, shift, level and first, a row for each occurrence of a template that a shift is part of: the whole document (level 0), its run of shifts less than a window apart (1; words were put in or left
    out) and itself (2; word for word). Two copies of an item are as far apart as it is long, a window or more."""
    shifts = found.select("doc_id", "template", "shift", "length").distinct()
    each = Window.partitionBy("doc_id", "template").orderBy("shift")
    begun = shifts.withColumn("begun", F.when(F.coalesce(F.col("shift") - F.lag("shift").over(each) >= F.col("length"), F.lit(True)), F.col("shift")))
    runs = begun.withColumn("run", F.last("begun", ignorenulls=True).over(each))
    levels = F.array(*(F.struct(F.lit(i).alias("level"), x.cast("long").alias("first")) for i, x in enumerate((F.lit(0), F.col("run"), F.col("shift")))))
    return runs.select("doc_id", "template", "shift", F.explode(levels).alias("x")).select("doc_id", "template", "shift", "x.*")


def _rarest(keyed: DataFrame, totals: DataFrame, share: float, run: int) -> DataFrame:
    """key and template: of a template that is found from `need` of its n windows on, the n - need + 1 windows that fewest templates share. A document without any of these has fewer than `need`, so only those with one need be looked at: windows
    that very many items have in common bring nothing together unless they are a large part of the items."""
    shared = keyed.groupBy("key").agg(F.count_distinct("template").alias("sharing"))
    need = F.greatest(F.lit(1), F.least(F.ceil(F.col("item_windows") * share), run - F.col("length") + 1))
    order = Window.partitionBy("template").orderBy("sharing", "key", "place")
    ranked = keyed.select("key", "template", "place").join(shared, "key").join(totals, "template").withColumn("rank", F.row_number().over(order))
    return settle(ranked.where(F.col("rank") <= F.col("item_windows") - need + 1).select("key", "template").distinct())


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, run: int = RUN) -> DataFrame:
    """A row for each document and template found in it: doc_id, item_id (the template's least item), n_items, n_windows, item_windows, share, n_slots, n_conflicts, exact_item, reparameterised.

    Only pairs that count as leaks are returned: an occurrence of the template (see _occurrences) has share of its windows or more, or run words of it in one piece, and at most CONFLICTS of the slots filled in conflict; the figures are
    those of the passing occurrence with most windows and slots. exact_item is the least item whose values fill all slots somewhere in the document (null if none does); reparameterised says that there is none and that some slot
    differs from that of item_id. Rows that repeat a doc_id are one document, rows that repeat an item_id one item, with each of its texts; rows without id or text are found nowhere, nor are items without a word. Other columns are ignored.
    """
    items = settle(_items(benchmark))
    templates = settle(items.groupBy("template").agg(F.countDistinct("item_id").alias("n_items"), F.min(F.struct("item_id", "raw", "words", "mode", "length")).alias("x")).select("template", "n_items", "x.*"))
    places = templates.select("template", "mode", "length", "words", _hashes(F.when(F.col("mode") == CANONICAL, F.col("words")).otherwise(F.col("raw"))).alias("h"))
    places = places.select("*", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("length"))).alias("place"))
    plain = F.size(F.filter(F.slice("words", F.col("place") + 1, F.col("length")), lambda w: ~_is_slot(w)))
    key = F.xxhash64("mode", F.slice("h", F.col("place") + 1, F.col("length")))
    keyed = settle(places.where((F.col("mode") != CANONICAL) | (plain >= PLAIN)).select(key.alias("key"), "template", "place", "mode", "length"))
    totals = keyed.groupBy("template", "length").agg(F.countDistinct("place").alias("item_windows"))
    lengths: dict[str, list[int]] = {}
    for r in keyed.select("mode", "length").distinct().orderBy("mode", "length").collect():  # a few of LENGTHS and those under WINDOW
        lengths.setdefault(r.mode, []).append(r.length)
    texts = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words_of = {CANONICAL: canonical_words(F.col("text"))}
    verbatim = F.transform(raw_words(F.col("text")), F.lower)
    all_keys = [_window_keys(words_of.get(mode, verbatim), mode, own) for mode, own in lengths.items()]
    keys = F.concat(*all_keys) if all_keys else F.array().cast("array<struct<at:int,key:bigint>>")
    # windows of documents that any template has, a row each, however many templates share them
    hits = settle(texts.where("text is not null").select("doc_id", F.explode(keys).alias("x")).select("doc_id", "x.*").join(keyed.select("key").distinct(), "key", "left_semi"))
    candidates = settle(hits.select("doc_id", "key").join(_rarest(keyed, totals, share, run), "key").select("doc_id", "template").distinct())
    found = settle(
        candidates.join(keyed.select("template", "key", "place"), "template")
        .join(hits, ["doc_id", "key"])
        .select("doc_id", "template", "place", (F.col("at") - F.col("place")).alias("shift"))
        .distinct()
    )
    enough_of = (F.col("n_windows") >= share * F.col("item_windows")) | (F.col("n_windows") > run - F.col("length"))
    pairs = settle(found.groupBy("doc_id", "template").agg(F.countDistinct("place").alias("n_windows")).join(totals, "template").where(enough_of).drop("n_windows"))
    found = settle(found.join(pairs, ["doc_id", "template"]))
    occurrences = settle(_occurrences(found))
    in_pair, in_shift, in_one = ["doc_id", "template"], ["doc_id", "template", "shift"], ["doc_id", "template", "level", "first"]
    counted = found.join(occurrences, in_shift).groupBy(*in_one, "item_windows", "length").agg(F.countDistinct("place").alias("n_windows")).withColumn("share", F.col("n_windows") / F.col("item_windows"))
    # words in one piece are those of one shift
    enough = settle(counted.where((F.col("share") >= share) | (F.col("level") == 2) & (F.col("n_windows") > run - F.col("length"))))
    slots = settle(templates.where(F.col("mode") == CANONICAL).select("template", F.posexplode(F.arrays_zip("words", "raw")).alias("slot", "x")).where(_is_slot(F.col("x.words"))).select("template", "slot", F.col("x.words").alias("kind"), F.col("x.raw").alias("value")))
    filled = found.join(slots, "template").where((F.col("slot") >= F.col("place")) & (F.col("slot") < F.col("place") + F.col("length"))).select(*in_shift, "slot", "kind", "value").distinct()
    asked = settle(filled.groupBy("doc_id").agg(F.collect_set(F.struct("template", "shift", "kind", "value", "slot", (F.col("slot") + F.col("shift")).alias("at"))).alias("asked")))
    values = texts.join(asked, "doc_id").select("doc_id", "asked", F.transform(raw_words(F.col("text")), F.lower).alias("raw"))
    values = values.select("doc_id", F.explode(F.transform("asked", lambda x: F.struct(*(x[c].alias(c) for c in ("template", "shift", "kind", "value", "slot", "at")), F.try_element_at("raw", (x["at"] + 1).cast("int")).alias("own")))).alias("x")).select("doc_id", "x.*")
    values = settle(values)
    inside = values.join(occurrences, in_shift)
    by_item = inside.groupBy(*in_one, "kind", "value").agg(F.countDistinct("at").alias("n"), F.countDistinct("own").alias("k"), F.max(F.col("own") != F.col("value")).alias("other"))
    by_doc = inside.groupBy(*in_one, "kind", "own").agg(F.countDistinct("value").alias("k")).groupBy(*in_one).agg(F.sum(F.col("k") - 1).alias("back"))
    slot_stats = by_item.groupBy(*in_one).agg(F.sum("n").alias("n_slots"), F.sum(F.col("k") - 1).alias("forth"), F.max("other").alias("other")).join(by_doc, in_one)
    none = F.lit(0).cast("long")
    passed = (
        enough.join(slot_stats, in_one, "left")
        .select(*in_one, "n_windows", "item_windows", "share", F.coalesce("n_slots", none).alias("n_slots"), F.coalesce(F.col("forth") + F.col("back"), none).alias("n_conflicts"), F.coalesce("other", F.lit(False)).alias("other"))
        .where(F.col("n_conflicts") <= CONFLICTS * F.col("n_slots"))
    )
    given = ["n_windows", "item_windows", "share", "n_slots", "n_conflicts", "other"]
    best = passed.groupBy(*in_pair).agg(F.max_by(F.struct(*given), F.struct("n_windows", "n_slots", -F.col("level"), -F.col("first"))).alias("x")).select(*in_pair, "x.*")
    # the items whose values stand in all slots at one shift
    by_slot = values.groupBy(*in_shift).agg(F.xxhash64(F.transform(F.array_sort(F.collect_set(F.struct("slot", "own"))), lambda x: x["own"])).alias("filled"))
    exact = by_slot.join(items.groupBy("template", "filled").agg(F.min("item_id").alias("item")), ["template", "filled"]).groupBy(*in_pair).agg(F.min("item").alias("exact"))
    out = best.join(templates.select("template", "n_items", "item_id"), "template").join(exact, in_pair, "left")
    exact_item = F.when(F.col("n_slots") == 0, F.col("item_id")).otherwise(F.col("exact"))
    out = out.select("doc_id", "item_id", "n_items", *given[:-1], exact_item.alias("exact_item"), (F.col("other") & exact_item.isNull()).alias("reparameterised"))
    # an item with several texts may be the least of several templates
    rest = [c for c in out.columns if c not in ("doc_id", "item_id")]
    return out.groupBy("doc_id", "item_id").agg(F.max_by(F.struct(*rest), F.struct("n_windows", "share", "n_slots", "n_items", "exact_item")).alias("x")).select("doc_id", "item_id", *(F.col(f"x.{c}") for c in rest))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item leaks; rows without id stay."""
    caught = settle(leaks(docs, benchmark).select(F.col("doc_id").alias("_leak")).distinct())
    kept = docs.join(caught, F.col("doc_id").cast("long") == caught["_leak"], "left_anti")
    return kept.select(*docs.columns)
