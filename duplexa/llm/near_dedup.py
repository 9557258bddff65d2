"""Near-duplicate groups by min-max hashing, confirmed on full shingle sets.

Each hash function serves twice: a set's smallest and its largest value under it are both kept, so a signature of 2 x PERMUTATIONS
values costs PERMUTATIONS evaluations a shingle, and the share of equal values is an unbiased estimate of the Jaccard similarity with less variance
than as many values from minima alone would have at that cost. Signatures are cut into BANDS of ROWS values; texts that agree in a band are candidates.

Texts with equal sets form a class at once, by 128 bits over the set; only one of a class takes part in the search, so groups of exact copies cost nothing.
Search goes in two steps, because within a group of near copies all pairs would be many:

1. each text in a bucket is held against the bucket's smallest id, its hub; what holds gives components;
2. where a hub has texts outside of its component, those are held against all others of the hub. Texts of a hub are dealt into blocks of about BLOCK shingles and TEXTS texts, and pairs of blocks are tasks' work:
   what each two texts of them have in common comes from products of their incidence matrices, COLUMNS shingles at a time. So no group of any size meets in one task, and only a spanning forest of the links leaves it. Pairs within one
   component need no look, as they cannot change it. No bucket, text or pair is capped.

A link at similarity s is found with probability 1 - (1 - s**ROWS)**BANDS at least: at 0.85, 0.999999. Confirmation is exact, on full sets. Texts are sent to candidates by id in a shuffle,
never broadcast, as their number grows with the input; those that share a bucket are settled once and serve every confirmation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .components import components
from .shared import forget, settle, slices

PERMUTATIONS = 60
ROWS = 5
BANDS = 2 * PERMUTATIONS // ROWS
SHINGLE = 5
#: Pairs with one hub that are confirmed together.
PART = 256
#: Shingles of a block in the second step.
BLOCK = 1 << 16
#: Texts of a block in the second step; its matrices have the square of twice as many values.
TEXTS = 1 << 10
#: Shingles that a product takes at once.
COLUMNS = 1 << 11
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85

_R = np.random.Generator(np.random.PCG64(61))
_MULTIPLY = _R.integers(1, 2**63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_CROSS = _R.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)


def sets_of(column: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    offsets, data = K.text_bytes(column)
    _, _, hashes, begins = K.words(offsets, data, K.SPACED, K.FOLDED)
    return K.shingle_sets(hashes, begins, shingle)


def band_keys(sets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set that isn't empty."""
    begins = at[:-1]
    signature = np.empty((2 * PERMUTATIONS, len(begins)), np.uint64)
    with np.errstate(over="ignore"):
        for p in range(PERMUTATIONS):
            values = (sets ^ _CROSS[p]) * _MULTIPLY[p]
            np.minimum.reduceat(values, begins, out=signature[2 * p])
            np.maximum.reduceat(values, begins, out=signature[2 * p + 1])
        keys = np.empty((len(begins), BANDS), np.uint64)
        for b in range(BANDS):
            total = np.full(len(begins), np.uint64(b + 1))
            for row in signature[b * ROWS : (b + 1) * ROWS]:
                total = K.mix(total * K.STEP + row)
            keys[:, b] = total
    return keys


def signatures(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, the set's fingerprint (two longs) and its band keys; null keys where the set is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets, at = sets_of(batch.column("text"), shingle)
                n = np.diff(at)
                full = n > 0
                prints = np.zeros((2, len(n)), np.uint64)
                keys = np.zeros((0, BANDS), np.uint64)
                if full.any():
                    begins = at[:-1][full]
                    prints[0, full] = np.add.reduceat(K.mix(sets + np.uint64(1)), begins)
                    prints[1, full] = np.add.reduceat(K.mix(sets ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begins)
                    keys = band_keys(sets, np.append(begins, at[-1]))
                ends = np.zeros(len(n) + 1, np.int32)
                np.cumsum(full * BANDS, out=ends[1:])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(n), *(pa.array(p.view(np.int64)) for p in prints), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.ravel().view(np.int64)))],
                    names=["doc_id", "n_shingles", "print_a", "print_b", "bands"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, print_a long, print_b long, bands array<long>")


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b, text_a and text_b; pairs of a b with many of them are dealt into parts of about PART pairs, to each of which b's text goes."""
    parts = settle(pairs.groupBy("b").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts")))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int"))
    of_a = texts.join(dealt.hint("merge"), texts.id == dealt.a).select("a", "b", "part", F.col("text").alias("text_a"))
    of_b = texts.hint("merge").join(parts.hint("merge"), F.col("id") == F.col("b")).select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("text_b"))
    return of_a.join(of_b.hint("merge"), ["b", "part"]).select("a", "b", "text_a", "text_b")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """For each (a, b) of pairs, whether their full sets are similar enough (linked), and a's set size (n). texts has id and text; b is the side that many pairs have in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[int | None, np.ndarray] = (None, np.zeros(0, np.uint64))
        for whole in batches:
            for batch in slices(whole, "text_a"):
                sets, at = sets_of(batch.column("text_a"), shingle)
                linked = np.zeros(batch.num_rows, bool)
                right = batch.column("text_b")
                for i, b in enumerate(batch.column("b").to_pylist()):
                    if b != known[0]:  # rows of one b come together
                        known = (b, sets_of(right.slice(i, 1), shingle)[0])
                    both = np.concatenate((sets[at[i] : at[i + 1]], known[1]))
                    both.sort()
                    common = int((both[1:] == both[:-1]).sum())
                    linked[i] = 0 < 100 * common >= percent * (len(both) - common)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked), pa.array(np.diff(at))], names=["a", "b", "linked", "n"])

    return _with_texts(pairs, texts).mapInArrow(run, "a long, b long, linked boolean, n long")


def _links_within(component: np.ndarray, sets: np.ndarray, at: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows i > j of different components whose sets are similar enough."""
    n = np.diff(at)
    owner = np.repeat(np.arange(len(n), dtype=np.int32), n)
    order = np.argsort(sets, kind="stable")
    values, owner = sets[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    begins = np.flatnonzero(new)
    column = np.cumsum(new) - 1
    several = np.diff(np.append(begins, len(values)))[column] > 1
    owner, column = owner[several], np.cumsum(new[several]) - 1
    common = np.zeros((len(n), len(n)))
    has = np.empty((len(n), COLUMNS), np.float32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, (low, low + COLUMNS)))
        has[:] = 0
        has[owner[part], column[part] - low] = 1
        common += has @ has.T
    found = []
    for low in range(0, len(n), TEXTS):  # in strips, as what follows makes several matrices more
        strip = common[low : low + TEXTS]
        ok = (100 * strip >= percent * (n[low : low + TEXTS, None] + n[None, :] - strip)) & (component[low : low + TEXTS, None] != component[None, :]) & (strip > 0)
        i, j = np.nonzero(ok)
        found.append((i + low, j))
    i, j = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(2))
    return i[i > j], j[i > j]


def _forest(component: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Those of the links i, j (in ascending i) that first connect two groups of components: as few as join all that the links join."""
    group, kept = np.unique(component, return_inverse=True)[1], []
    bounds = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        own, others = i[low], j[low:high]
        told, first = np.unique(group[others], return_index=True)
        new = told != group[own]
        if new.any():
            kept += [(own, x) for x in others[first[new]].tolist()]
            group[np.isin(group, told[new])] = group[own]
    return tuple(np.array(kept, np.int64).reshape(-1, 2).T)


def loose_links(checked: DataFrame, found: DataFrame, texts: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block: int = BLOCK, most: int = TEXTS) -> DataFrame:
    """Links (a, b) between texts that met one hub and were left in different components, of which one isn't the hub's: of the links that two blocks have, those that join components, fewer than the blocks have texts.
    checked: what confirm gave for texts and their hubs."""
    rows = (
        checked.join(found.withColumnRenamed("node", "a"), "a", "left")
        .join(found.select(F.col("node").alias("b"), F.col("component").alias("of_hub")), "b", "left")
        .select("a", F.col("b").alias("hub"), "n", F.coalesce("component", "a").alias("component"), (F.coalesce("component", "a") != F.coalesce("of_hub", "b")).alias("out"))
    )
    total = lambda which, what: F.coalesce(F.sum(F.when(which, what)), F.lit(0))
    out, blocks_of = F.col("out"), lambda name: F.ceil(F.greatest(F.col(f"{name}.n") / block, F.col(f"{name}.texts") / most)).cast("int").alias(name)
    sums = rows.groupBy("hub").agg(*(F.struct(total(which, F.col("n")).alias("n"), total(which, F.lit(1)).alias("texts")).alias(name) for name, which in (("outer", out), ("inner", ~out)))).where("outer.texts > 0 and outer.texts + inner.texts > 1")
    # settled, so that a hub with very many texts is only dealt by hub where the table of hubs is too large to send around
    blocks = settle(sums.select("hub", blocks_of("outer"), blocks_of("inner")))
    upto = lambda n, make: F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), make)).otherwise(F.array().cast("array<struct<within:boolean,i:int,j:int>>"))
    meet = lambda within, i, j: F.struct(F.lit(within).alias("within"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    own = F.pmod(F.xxhash64("a"), F.when(F.col("out"), F.col("outer")).otherwise(F.col("inner")))
    meetings = F.when(F.col("out"), F.concat(upto(F.col("outer"), lambda k: meet(True, F.least(F.col("own"), k), F.greatest(F.col("own"), k))), upto(F.col("inner"), lambda k: meet(False, F.col("own"), k)))).otherwise(upto(F.col("outer"), lambda k: meet(False, k, F.col("own"))))
    dealt = rows.join(blocks, "hub").withColumn("own", own).select("hub", F.explode(meetings).alias("m"), "a", "component").select("hub", "m.*", "a", "component")
    with_text = texts.join(dealt.hint("merge"), texts.id == dealt.a)
    key = ["hub", "within", "i", "j"]

    def links_of(rows: pa.Table) -> pa.RecordBatch:
        a = rows.column("a").to_numpy()
        component = rows.column("component").to_numpy()
        i, j = _forest(component, *_links_within(component, *sets_of(rows.column("text"), shingle), percent))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a[i], a[j])), pa.array(np.minimum(a[i], a[j]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []  # the rows of the key that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([*waiting, batch])
            keys = np.stack([table.column(k).cast(pa.int64()).to_numpy() for k in key])
            cuts = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
            for low, high in zip([0, *cuts], cuts, strict=False):
                yield links_of(table.slice(low, high - low))
            waiting = table.slice(cuts[-1] if cuts else 0).to_batches()
        if waiting:
            yield links_of(pa.Table.from_batches(waiting))

    return with_text.select(*key, "a", "component", "text").repartition(*key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group) and kept, a row for each row of docs.

    Words are what stands between ASCII white space, A-Z lower-cased. A null or empty text or one of white space has no shingle: it is linked with nothing and kept.
    A null doc_id gets a null component unless its set equals another's, and is not kept. Rows that repeat an id share its component; if their
    texts differ, each text's set is looked for, and the first text in order stands for the id in confirmations.
    Any columns besides doc_id and text are ignored; an empty table gives an empty one.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marks = settle(signatures(docs, shingle))
    classes = settle(marks.where("n_shingles > 0 and doc_id is not null").groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands")))
    buckets = classes.select("id", F.explode("bands").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1").select("key", "hub")
    stars = settle(buckets.join(shared, "key").where("id <> hub").select(F.col("id").alias("a"), F.col("hub").alias("b")).distinct())
    wanted = stars.select(F.col("a").alias("doc_id")).union(stars.select("b")).distinct()
    texts = settle(docs.join(wanted.hint("merge"), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.min("text").alias("text")))
    checked = settle(confirm(stars, texts, percent, shingle))
    links = checked.where("linked").select("a", "b")
    found = components(links)
    more = settle(loose_links(checked, found, texts, percent, shingle))
    if not more.isEmpty():
        found = components(links.union(more))
    forget(stars, texts, checked, more)
    ids = classes.join(found.withColumnRenamed("node", "id"), "id", "left").select("print_a", "print_b", "n_shingles", F.coalesce("component", "id").alias("component_id"))
    return (
        marks.drop("bands")
        .join(ids, ["print_a", "print_b", "n_shingles"], "left")
        .select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
    )


def keep_one(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, with all their columns, that near_duplicates keeps: of each group the smallest doc_id. Rows without id stay, repeated rows of a kept id stay."""
    gone = settle(near_duplicates(docs, percent, shingle).where("doc_id is not null and not kept").select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone.hint("merge"), docs["doc_id"].cast("long") == gone["_gone"], "left_anti")


#: DuckDB SQL for near_duplicates(documents): all common shingles of all pairs counted, and what each document reaches over links.
SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') g from d, unnest(range(1, len(w) - 3)) u(i) union select doc_id, array_to_string(w, ' ') from d where len(w) between 1 and 4),
n as (select doc_id, count(*) n from s group by 1),
c as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= {PERCENT} * (x.n + y.n - c)),
e as (select a, b from l union all select b, a from l),
r(x, y) as (select doc_id, doc_id from d union select x, b from r join e on y = a),
m as (select x doc_id, min(y) component_id from r group by 1)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id = component_id kept from m left join n using (doc_id)
"""
