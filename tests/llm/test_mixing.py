import random

import pytest
from pyspark.sql import functions as F

from duplexa.llm.mixing import mix, repeated


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 10, 200])), rng.choice(["a", "a", "a", "b", "é", "Z", None]), "x") for i in range(3000)] + [(3000, None, "a", "x"), (None, "x y", "b", "x")]
    docs = table(spark, rows)
    return rows, docs, mix(docs, block=16).toPandas()


def shares(sizes):
    """Targets by sharing again and again, as the contract words it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    out, free, rest = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > 2 * sizes[s]}
        if not over:
            return out | {s: rest * weight[s] / total for s in free}
        out |= {s: 2.0 * sizes[s] for s in over}
        rest -= sum(out[s] for s in over)
        free -= over
    return out


def test_targets_and_taken(mixed):
    rows, _, got = mixed
    sizes = {}
    for _, t, s, _ in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = shares(sizes)
    assert len(got) == len(rows)
    source = {r[0]: r[2] for r in rows}
    got["source"] = [source[None if i != i else int(i)] for i in got.doc_id]
    for s, size in sizes.items():
        part = got[got.source == s] if s is not None else got[got.source.isna()]
        assert (part.source_size == size).all()
        assert part.target.sub(want[s]).abs().max() < 1e-6
        assert abs(part.taken.sum() - want[s]) <= part["size"].max()
    assert (got.taken <= 2 * got["size"]).all()
    assert (got.taken[got["size"] > 0] % got["size"][got["size"] > 0] == 0).all()


def test_reruns_agree_in_another_partitioning(mixed):
    _, docs, got = mixed
    again = mix(docs.repartition(7), block=16).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))


def test_expected_copies_are_kept(spark):
    docs = table(spark, [(i, "w " * (1 + i % 5), "ab"[i % 2], "x") for i in range(200)])
    runs = [mix(docs, block=8, seed=s).select("doc_id", (F.col("taken") / F.col("size")).alias("c")).toPandas().set_index("doc_id").c for s in range(6)]
    mean = sum(runs) / len(runs)
    assert abs(mean[mean.index % 2 == 1].mean() - runs[0][runs[0].index % 2 == 1].mean()) < 0.1


def test_empty_and_repeated(spark):
    assert mix(table(spark, []).limit(0)).count() == 0
    got = mix(table(spark, [(1, "a b", "s", "x")] * 4)).toPandas()
    assert len(got) == 4 and got.taken.sum() == 12
    assert mix(table(spark, [(1, None, None, "x")])).toPandas().taken.tolist() == [0]


def test_copies_of_repeated_rows_are_what_the_mix_takes(spark):
    rows = [(1, "a b c", "s", "x")] * 7 + [(1, "d e f", "s", "y")] * 4 + [(1, "a b c", "t", "x")] * 5 + [(None, "q r", None, None)] * 9 + [(2, None, "s", "x"), (3, "", "t", "x")] + [(i, "w " * (i % 7 + 1), "st"[i % 2], "_doc") for i in range(10, 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _size string").repartition(5)
    want = {(r.doc_id, r.source, r.size): r.n for r in mix(docs).where("size > 0").groupBy("doc_id", "source", "size").agg(F.sum(F.col("taken") / F.col("size")).alias("n")).collect() if r.n}
    got = repeated(docs)
    assert got.columns == [*docs.columns, "copy"]
    rows = got.collect()
    n = {}
    for r in rows:
        key = (r.doc_id, r.source, len(r.text.split()))
        n[key] = n.get(key, 0) + 1
    assert n == {k: int(v) for k, v in want.items()} and max(r.copy for r in rows) <= 2
    assert repeated(docs.limit(0)).count() == 0


def test_very_long_texts(spark):
    docs = table(spark, [(1, "w " * 1_500_000, "a", "x"), (2, "w " * 10, "a", "x"), (3, None, "b", "x"), (4, "w", "b", "x")])
    got = {r.doc_id: r for r in mix(docs).collect()}
    assert got[1].size == 1_500_000 and got[3].taken == 0 and all(r.taken <= 2 * r.size for r in got.values())


def test_rows_alike_spread_over_blocks(spark):
    """Rows without id and of one size are a third of all: they are as many random numbers, blocks stay near their size, and the mix still meets its target."""
    from duplexa.llm import mixing as M

    n = 100_000
    alike = spark.range(n).selectExpr("cast(null as long) doc_id", "'a' source", "5L size")
    rows = M.numbered(alike)
    assert rows.agg(F.count_distinct("number")).first()[0] == n and rows.where("source <> 'a' or size <> 5 or doc_id is not null").count() == 0
    blocks = rows.select(F.floor(M._uniform(M.SEED, 0) * -(-n // M.BLOCK)).alias("b")).groupBy("b").count().agg(F.max("count"), F.count("*")).first()
    assert blocks[1] == -(-n // M.BLOCK) and blocks[0] < 1.2 * M.BLOCK
    docs = spark.range(5000).selectExpr("cast(null as long) doc_id", "'w w w' text", "if(id % 3 = 0, 'b', 'a') source")
    got = mix(docs)
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.count("*").alias("n")).collect()
    assert sum(r.n for r in sums) == 5000 and all(abs(r.taken - r.target) <= 3 for r in sums)
    again = mix(docs.repartition(5))
    assert sorted(r.taken for r in got.collect()) == sorted(r.taken for r in again.collect())
