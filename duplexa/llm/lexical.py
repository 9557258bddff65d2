"""Ranked lexical search, score at a time over impact-ordered postings.

Documents are dealt into shards, each of which is an index of its own. A posting's impact is what it gives to a score for each unit of its term's weight; it depends on the document's length and the table's, so it's an exact integer.
A term's postings in a shard stand in the order of falling impact, in groups of equal impact. A query takes the groups of all its terms from the largest contribution to a score downwards and adds them to its documents' sums. What the groups
to come can still add to a document is bounded by the next group of each term. Once that bound leaves so few documents that could be among the first TOP that they can be looked at one by one, the query stops and completes their scores from
the postings by document; without such a proof it goes on to the end. Groups between two looks at the bound are added together, as sums don't depend on their order.

Each shard answers every query with its first TOP documents, which are merged; so no list of a frequent term, no document and no query meets whole in one task. Only postings of terms that queries hold are kept while there are at most
TERMS of these, beyond that postings of all terms. Queries are dealt into blocks, which go to all shards: broadcast while small, else by a join on block and part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import settle, slices

TOP = 10
#: Bytes of text of a shard, about; a longer text is a shard alone.
SHARD = 32 << 20
#: Distinct terms of queries up to which only their postings are kept.
TERMS = 1 << 20
#: Queries of a block.
QUERIES = 1024
#: Terms of all queries together up to which the blocks are broadcast, 16 bytes each.
BROADCAST = 1 << 20
#: Documents up to which a stopped query completes scores.
COMPLETE = 64
#: Groups down to this part of the largest contribution left are added before the bound is looked at again.
STEP = 0.6


def terms_of(queries: DataFrame) -> DataFrame:
    """item_id, term (a 64-bit hash) and times of queries (item_id, text). Of rows that repeat an item_id the smallest text counts; null and empty texts have no term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                _, _, hashes, begins = K.words(*K.text_bytes(batch.column("text")), K.WORDY, K.FOLDED)
                found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
                ids = batch.column("item_id").take(pa.array(np.repeat(np.arange(len(found)), [len(t) for t, _ in found])))
                terms, times = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([ids, pa.array(terms.view(np.int64)), pa.array(times.astype(np.int64))], names=["item_id", "term", "times"])

    one = queries.groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    return one.mapInArrow(run, "item_id long, term long, times long")


_SHARD = "shard long, n_docs long, n_terms long, ids binary, no_id binary, lengths binary, doc binary, term binary, tf binary"


def shards(docs: DataFrame, terms: np.ndarray | None = None, size: int = SHARD) -> DataFrame:
    """Documents (doc_id, text) as shards: how many documents with a term and how many terms each holds, and as packed arrays its documents' ids and lengths and its postings (document by place, term, times), in the order of documents.
    terms: keep only postings of these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        wanted = None if terms is None else pd.Index(terms)
        number, held, parts, n_docs = TaskContext.get().partitionId() << 33, 0, [], 0

        def take() -> pa.RecordBatch:
            nonlocal number, held, parts, n_docs
            ids, no_id, lengths, doc, term, tf = (np.concatenate([p[k] for p in parts]) for k in range(6))
            columns = [number, int((lengths > 0).sum()), int(lengths.sum()), *(x.tobytes() for x in (ids, no_id, lengths, doc, term, tf))]
            number, held, parts, n_docs = number + 1, 0, [], 0
            return pa.RecordBatch.from_arrays([pa.array([c]) for c in columns], names=["shard", "n_docs", "n_terms", "ids", "no_id", "lengths", "doc", "term", "tf"])

        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, data = K.text_bytes(batch.column("text"))
                _, _, hashes, begins = K.words(offsets, data, K.WORDY, K.FOLDED)
                lengths = np.diff(begins)
                if wanted is None:
                    code, known = pd.factorize(hashes)
                else:
                    code, known = wanted.get_indexer(hashes), terms
                place = np.flatnonzero(code >= 0)
                owner = np.repeat(np.arange(len(lengths)), lengths)[place]
                keys, tf = np.unique(owner * max(1, len(known)) + code[place], return_counts=True)
                doc, at = np.divmod(keys, max(1, len(known)))
                own = batch.column("doc_id")
                parts.append((own.fill_null(0).to_numpy().astype(np.int64), own.is_null().to_numpy(zero_copy_only=False), lengths.astype(np.int64), (doc + n_docs).astype(np.int32), known[at].astype(np.uint64), tf.astype(np.int32)))
                n_docs, held = n_docs + len(lengths), held + int(offsets[-1] - offsets[0])
                if held >= size:
                    yield take()
        if parts:
            yield take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SHARD)


def document_frequencies(index: DataFrame) -> DataFrame:
    """term and df from shards: counts of each shard are summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("term").to_pylist():
                term, df = np.unique(np.frombuffer(x, np.uint64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    return index.select("term").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


class Shard:
    """A shard's postings in the order of falling impact by term, and by document."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, lengths: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, documents: int, terms: int):
        """documents and terms: how many the whole table has."""
        self.ids, self.no_id = ids, no_id
        m = 25 + (75 * lengths * documents) // max(1, terms)
        tf = tf.astype(np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        code, self.terms = pd.factorize(term, sort=True)
        self.by_doc = np.searchsorted(doc, np.arange(len(ids) + 1))  # postings come by document
        self.doc_code, self.doc_impact = code, impact
        order = np.lexsort((-impact, code))
        self.doc, self.falling = doc[order], -impact[order]
        self.begins = np.searchsorted(code[order], np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)
        self.taken = 0

    def first(self, terms: np.ndarray, weights: np.ndarray, top: int = TOP, complete: int = COMPLETE) -> list[tuple[int, int]]:
        """(document by place, score) of the documents with the highest scores above 0 for a query of terms with weights, by falling score, ties by ascending id."""
        code = np.searchsorted(self.terms, terms)
        code[code == len(self.terms)] = 0
        here = (self.terms[code] == terms) & (weights > 0) if len(self.terms) else np.zeros(len(terms), bool)
        code, weights = code[here], weights[here]
        at, end = self.begins[code].copy(), self.begins[code + 1]
        total = np.zeros(len(self.ids), np.int64)
        while True:
            left = at < end
            head = np.where(left, -self.falling[np.minimum(at, len(self.falling) - 1)] * weights, 0)
            bound = int(head.sum())
            able = np.flatnonzero(total + bound >= max(1, self._kth(total, top)))
            if not bound or len(able) <= complete:
                break
            level = max(1, int(head.max() * STEP))
            for i in np.flatnonzero(head >= level).tolist():
                least = -(-level // int(weights[i]))  # smallest impact that gives so much
                to = at[i] + int(np.searchsorted(self.falling[at[i] : end[i]], -least, "right"))
                total[self.doc[at[i] : to]] += -self.falling[at[i] : to] * weights[i]
                self.taken += to - at[i]
                at[i] = to
        scores = self._complete(able, code, weights) if bound else total[able]
        able, scores = able[scores > 0], scores[scores > 0]
        order = np.lexsort((self.ids[able], self.no_id[able], -scores))[:top]
        return list(zip(able[order].tolist(), scores[order].tolist(), strict=True))

    @staticmethod
    def _kth(total: np.ndarray, top: int) -> int:
        return int(np.partition(total, len(total) - top)[len(total) - top]) if len(total) >= top else 0

    def _complete(self, docs: np.ndarray, code: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of a few documents, from their own postings."""
        self.weight[code] = weights
        ranges = [slice(a, b) for a, b in zip(self.by_doc[docs].tolist(), self.by_doc[docs + 1].tolist(), strict=True)]
        scores = np.array([int((self.weight[self.doc_code[r]] * self.doc_impact[r]).sum()) for r in ranges], np.int64)
        self.weight[code] = 0
        return scores


def search(docs: DataFrame, queries: DataFrame, top: int = TOP, size: int = SHARD, most_terms: int = TERMS, block: int = QUERIES, broadcast: int = BROADCAST) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: each query's `top` documents of the highest scores above 0, equal ones by ascending doc_id, null ids last.

    Null and empty texts have no term, on either side. Each row of docs is a document, repeated ids too; queries that repeat an item_id count once, by their smallest text, and a null item_id is one. Other columns are ignored; empty tables give
    an empty result.
    """
    spark = docs.sparkSession
    asked = settle(terms_of(queries))
    distinct = asked.select("term").distinct()
    few = distinct.limit(most_terms + 1).count() <= most_terms
    terms = np.sort(np.array([r.term for r in distinct.collect()], np.int64).view(np.uint64)) if few else None
    index = settle(shards(docs, terms, size))
    documents, all_terms = (x or 0 for x in index.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    n_items, n_terms = asked.agg(F.count_distinct(F.coalesce("item_id", F.lit(0)), F.col("item_id").isNull()), F.count("*")).first()
    blocks = max(1, -(-n_items // block))
    ln = F.ln((2 * F.lit(documents) + 2).cast("double") / (2 * F.col("df") + 1).cast("double"))
    weighted = asked.join(document_frequencies(index), "term").withColumn("weight", F.floor(1000 * ln) * F.col("times")).where("weight > 0")
    packed = weighted.groupBy(F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int").alias("block")).agg(F.sort_array(F.collect_list(F.struct("item_id", "term", "weight"))).alias("asked"))
    parts = 1 if n_terms <= broadcast else int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = settle(packed)
    dealt = packed.select("block", "asked", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    dealt = F.broadcast(dealt) if parts == 1 else dealt
    met = index.withColumn("part", F.pmod("shard", F.lit(parts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(dealt, ["block", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, shard = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                one = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)  # noqa: B023, E731
                if row.column("shard")[0].as_py() != number:
                    number = row.column("shard")[0].as_py()
                    shard = Shard(one("ids", np.int64), one("no_id", bool), one("lengths", np.int64), one("doc", np.int32), one("term", np.uint64), one("tf", np.int32), documents, all_terms)
                flat = row.column("asked").flatten()
                item, term, weight = (flat.field(k) for k in ("item_id", "term", "weight"))
                term, weight = term.to_numpy().view(np.uint64), weight.to_numpy()
                same = item.fill_null(0).to_numpy(), item.is_null().to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero((same[0][1:] != same[0][:-1]) | (same[1][1:] != same[1][:-1])) + 1
                out = []
                for low, high in zip([0, *cuts.tolist()], [*cuts.tolist(), len(term)], strict=True):
                    for doc, score in shard.first(term[low:high], weight[low:high], top):
                        out.append((item[low].as_py(), None if shard.no_id[doc] else int(shard.ids[doc]), score))
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "doc_id", "score"])

    columns = ["shard", "ids", "no_id", "lengths", "doc", "term", "tf", "asked"]
    found = met.select(*columns).mapInArrow(run, "item_id long, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
#: DuckDB SQL for search(documents, benchmark): every score in full.
SQL = f"""
with d as (select doc_id, {_WORDS} w from documents),
g as (select count(*)::bigint nn, sum(len(w))::bigint ll from d where len(w) > 0),
q as (select item_id, t, count(*)::bigint times from (select item_id, unnest({_WORDS}) t from benchmark) group by all),
p as (select doc_id, n, t, count(*)::bigint tf from (select doc_id, len(w)::bigint n, unnest(w) t from d) where t in (select t from q) group by all),
f as (select t, floor(1000 * ln((2 * nn + 2)::double / (2 * count(*) + 1)::double))::bigint w from p, g group by t, nn),
s as (select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::bigint score from q join f using (t) join p using (t), g group by all),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int "rank", doc_id, score from s where score > 0)
select * from r where "rank" <= {TOP}
"""
