import math
import random

import duckdb
import numpy as np
from pyspark.sql import functions as F

from duplexa.llm import negatives as N
from duplexa.llm.negatives import SQL, mine, relabelled, whole_numbers

SF = "/root/testdata/sf0.001"
ANCHORS = "vec_id % 50 = 0"


def plain(rows, is_anchor, positives=5, negatives=3):
    """All rows from every score; rows are (vec_id, label, vector of whole numbers)."""
    def dot(a, b):
        return sum(x * y for x, y in zip(a, b, strict=False))

    out = set()
    for a, y, v in rows:
        if not is_anchor(a):
            continue
        scored = sorted((-dot(v, w), b, z) for b, z, w in rows if b != a)
        for p, b, _ in [s for s in scored if s[2] == y][:positives]:
            found = [(n, c) for n, c, z in scored if z != y and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out |= {(a, b, rank, c, -p, -n) for rank, (n, c) in enumerate(found, 1)}
    return out


def rows(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert [t for _, t in df.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    want = set(con.execute(SQL).fetchall())
    own = relabelled(whole_numbers(table))
    own_rows = [(r.vec_id, r.label, r.v) for r in own.collect()]
    assert want == plain(own_rows, lambda i: i % 50 == 0) and want
    assert rows(mine(own, ANCHORS)) == want
    # blocks, groups and few cells change nothing
    assert rows(mine(own, ANCHORS, cells=5, size=37, per_block=2, groups=(2, 2))) == want


def test_bounds_hold_and_spare_exact_scores():
    rng = np.random.default_rng(3)
    x = np.floor(rng.normal(0, 30, (3000, 16))).astype(np.int64)
    x[0] = 10**6  # far outside of the cells of equal width
    stats = np.stack((x.min(0), *np.quantile(x, (0.005, 0.995), axis=0), x.max(0)), 1)
    for cells in (N.Cells(stats, 64), N.Cells(stats, 4), N.Cells(stats, 256)):
        low, high = cells.between(cells.quantised(x))
        assert (low <= x).all() and (x <= high).all()
        least, most = N._bounds(x[:50], low, high)
        exact = x[:50] @ x.T
        assert (least <= exact).all() and (exact <= most).all()
    cells = N.Cells(stats, 64)
    block = N._Block.__new__(N._Block)
    block.ids, block.labels, block.exact = np.arange(3000), np.repeat(np.arange(3), 1000), x
    block.low, block.high = cells.between(cells.quantised(x))
    count, best = [0], {}
    N._positives(block, (block.ids[1:40], block.labels[1:40], x[1:40]), best, 5, count)
    assert len(best) == 39 and count[0] < 0.2 * 39 * 1000
    spared, scores = [0], x @ x[5]
    window = np.array([[1, int(np.sort(scores[1000:])[-400]), int(np.sort(scores[1000:])[-20])]])
    found = {}
    N._negatives(block, (block.ids[5:6], block.labels[5:6], x[5:6], [window]), found, 3, spared)
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i >= 1000 and window[0][1] <= s <= window[0][2])[:3]
    assert [(-s, i) for s, i in zip(*(z.tolist() for z in found[5, 1]), strict=True)] == want
    assert spared[0] < 0.3 * 2000


def test_odd_rows(spark):
    rng = random.Random(8)
    data = [(i, i % 3, [rng.gauss(0.05, 0.2) for _ in range(6)]) for i in range(1, 130)]
    data += [(200, 1, None), (201, None, [0.1] * 6), (None, 1, [0.1] * 6), (202, 1, [0.1, None]), (203, 1, [float("nan")] * 6), (204, 1, [float("inf")] * 6), (205, 1, []), (206, 2, [0.5, 0.5]), (207, 2, [0.5] * 9)]
    data += [data[20], data[20], (50, 2, data[49][2]), (150, 1, data[49][2]), (151, 1, data[49][2]), (250, 0, [0.0] * 6), (300, 7, [0.3] * 6)]
    table = spark.createDataFrame(data, "vec_id long, label int, embedding array<float>").withColumn("score", F.lit("x")).withColumn("number", F.lit(1)).withColumn("anchor_id", F.lit(None).cast("string"))
    kept = whole_numbers(table)
    got = sorted((r.vec_id, r.label, r.v) for r in kept.collect())
    best = {}
    for i, y, v in data:
        if i is None or y is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = (y, [math.floor(256 * float(np.float32(x))) for x in v])
        best[i] = min(best.get(i, own), own)
    assert got == sorted((i, y, v) for i, (y, v) in best.items())
    for anchors, is_anchor in ((ANCHORS, lambda i: i % 50 == 0), ("true", lambda i: True)):
        want = plain(got, is_anchor)
        assert rows(mine(kept, anchors)) == want and want
        assert rows(mine(kept, anchors, size=20, per_block=7, groups=(3, 2))) == want
    assert mine(kept, "false").collect() == [] and mine(kept.where("false"), ANCHORS).collect() == []
    assert mine(kept.where("label = 1"), ANCHORS).collect() == []  # no other label
    far = spark.createDataFrame([(i, i % 2, [1e4 * (i + 1), -1e4 * i]) for i in range(20)], "vec_id long, label long, embedding array<double>")
    assert rows(mine(whole_numbers(far), ANCHORS)) == plain([(r.vec_id, r.label, r.v) for r in whole_numbers(far).collect()], lambda i: i % 50 == 0)
