import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from duplexa.llm import lexical
from duplexa.llm.lexical import SQL, Shard, search

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(docs, items, top=10):
    """(item_id, rank, doc_id, score) from every score in full; docs and items are (id, text)."""
    texts = {}
    for item, text in items:
        if item not in texts or texts[item] is None or (text is not None and text.encode() < texts[item].encode()):
            texts[item] = text
    counted = [(doc, Counter(WORD.findall((text or "").translate(FOLD)))) for doc, text in docs]
    n, total = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in texts.items():
        scored = []
        for doc, c in counted:
            m = 25 + (75 * sum(c.values()) * n) // max(1, total)
            score = 0
            for t in WORD.findall((text or "").translate(FOLD)):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                scored.append((-score, doc is None, doc))
        out |= {(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(sorted(scored)[:top], 1)}
    return out


def rows(df):
    assert dict(df.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    found = [tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_whole_tables(spark):
    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    got = rows(search(docs, items))
    assert got == plain([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert got == set(con.execute(SQL).fetchall())
    # shards, blocks of queries, postings of all terms, and a join in place of the broadcast change nothing
    assert got == rows(search(docs.repartition(3), items, size=20_000, block=7, broadcast=0))
    assert got == rows(search(docs, items, most_terms=3))


def test_odd_rows(spark):
    docs = [(1, "Aa bb AA"), (2, None), (3, ""), (4, " .,! "), (5, "aa\nbb,aa"), (None, "aa bb aa"), (7, "x " * 50_000 + "aa"), (8, "cc"), (8, "cc"), (9, "é\u00c9 ba\u00a0bb")]
    items = [(1, "aa bb aa"), (2, None), (3, ""), (4, "zzz"), (5, "cc"), (5, "aa"), (6, "ba\u00a0bb x"), (None, "bb"), (1, "aa bb aa")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9)).withColumn("score", F.lit("s"))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = plain(docs, items)
    found = search(table, asked)
    got = [tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert search(table.where("false"), asked).collect() == [] and search(table, asked.where("false")).collect() == []
    repeated = spark.createDataFrame([(3, "cc dd"), (3, "cc dd"), (2, "cc dd"), (1, "ee")], "doc_id long, text string")
    got = search(repeated, spark.createDataFrame([(1, "dd")], "item_id long, text string"), top=2).orderBy("rank").collect()
    assert [(r.rank, r.doc_id) for r in got] == [(1, 2), (2, 3)]


def test_a_stopped_query_has_whole_scores():
    rng = random.Random(4)
    n, vocabulary = 4000, 40
    docs = []
    for _ in range(n):
        docs.append(Counter(min(vocabulary - 1, int(rng.expovariate(0.15))) for _ in range(rng.randint(1, 60))))
    docs[17] = Counter({39: 30, 38: 30, 0: 1})
    doc = np.array([i for i, c in enumerate(docs) for _ in c], np.int32)
    term = np.array([t for c in docs for t in c], np.uint64)
    tf = np.array([x for c in docs for x in c.values()], np.int32)
    lengths = np.array([sum(c.values()) for c in docs])
    shard = Shard(np.arange(n), np.zeros(n, bool), lengths, doc, term, tf, n, int(lengths.sum()))
    m = 25 + (75 * lengths * n) // int(lengths.sum())
    stopped = 0
    for trial in range(60):
        terms = np.array(sorted(rng.sample(range(vocabulary + 3), rng.randint(1, 6))), np.uint64) if trial else np.array([0, 38, 39], np.uint64)
        weights = np.array([rng.randint(1, 9000) for _ in terms])
        score = [sum(int(w) * ((1_000_000_000 * c[int(t)]) // (1000 * c[int(t)] + 8 * int(m[i]))) for t, w in zip(terms, weights, strict=True) if c[int(t)]) for i, c in enumerate(docs)]
        want = [(i, score[i]) for i in sorted(range(n), key=lambda i: (-score[i], i))[:10] if score[i]]
        shard.taken = 0
        assert shard.first(terms, weights) == want
        stopped += shard.taken < sum((term == t).sum() for t in terms)
    assert stopped > 20  # many queries needn't see all postings
    assert lexical.COMPLETE >= lexical.TOP
    assert Shard(*(np.zeros(0, t) for t in (int, bool, int, np.int32, np.uint64, np.int32)), 0, 0).first(np.array([1], np.uint64), np.array([5])) == []
