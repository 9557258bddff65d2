import random

import pytest
from pyspark.sql import functions as F

from duplexa.operators import growth
from duplexa.operators.growth import cogrown_seeds, grown, levels, occurrences, placed
from duplexa.operators.seeds import seed_search
from duplexa.plans.search import SearchParameters, search, search_store, store_seeds
from duplexa.operators.accessibility import accessibility
from duplexa.sources.store import BuildParameters, Store, build


def table(spark, seqs):
    return spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")


def some(seed, n=6, length=60):
    rng = random.Random(seed)
    return ["".join(rng.choice("GGCCAUN" if i % 2 else "GCGCAUa") for _ in range(length)) for i in range(n)] + ["", "GC", "GC" * 15, "A" * 40 + "N" + "U" * 40]


def test_levels_count_distinct_windows(spark):
    seqs = [*some(2), None]
    for target in (False, True):
        got = {(r.k, r.window): r.n for r in levels(occurrences(table(spark, seqs), 3, 6, target), 3, 6).collect()}
        want = {}
        for s in seqs:
            text = "".join(c if c in "ACGU" else "N" for c in ((s or "")[::-1] if target else s or ""))
            for k in range(3, 7):
                for p in range(len(text) - k + 1):
                    if "N" not in text[p : p + k]:
                        want[k, text[p : p + k]] = want.get((k, text[p : p + k]), 0) + 1
        assert got == want


@pytest.mark.parametrize("least, most, threshold", [(5, 20, -600), (3, 6, -300), (4, 4, -400)])
def test_grown_seeds_equal_joined_ones(spark, least, most, threshold):
    queries, targets = table(spark, [*some(3), None]), table(spark, some(4))
    want = sorted(map(tuple, seed_search(queries, targets, least, most, threshold).collect()))
    for part in (growth.PART, 3):  # parts change nothing
        assert sorted(map(tuple, cogrown_seeds(queries, targets, least, most, threshold, part=part).collect())) == want
    assert want


def test_no_seeds(spark):
    assert cogrown_seeds(table(spark, ["AAAA"]), table(spark, ["AAAA"])).collect() == []
    assert cogrown_seeds(table(spark, [None]), table(spark, [""])).collect() == []


def test_rows_made_are_level_pairs_and_seeds(spark):
    rng = random.Random(1)
    seqs = table(spark, ["".join(rng.choices("ACGU", k=400)) for _ in range(12)])
    own, other = occurrences(seqs), occurrences(seqs, target=True)
    found = grown(spark, levels(own), levels(other))
    n = seed_search(seqs, seqs).count()
    assert found.agg(F.sum(F.col("n_q") * F.col("n_t"))).first()[0] == n and found.count() <= n


def test_a_frequent_window_is_no_hot_key(spark):
    """One sequence of 200,000 A's: its windows' places spread evenly over parts."""
    queries, targets = table(spark, ["A" * 200_000]), table(spark, ["U" * 12])
    own, other = occurrences(queries, 8, 8), occurrences(targets, 8, 8, True)
    found = grown(spark, levels(own, 8, 8), levels(other, 8, 8), 8, 8, -400)
    assert [(r.q_window, r.n_q, r.n_t) for r in found.collect()] == [("A" * 8, 199_993, 5)]
    placed_ = placed(found, own, other)
    assert placed_.count() == 5 * 199_993
    keys = own.select(F.pmod(F.xxhash64(F.col("seq_id").alias("query_id"), F.col("pos").alias("q_pos")), F.lit(-(-199_993 // growth.PART))).alias("part")).groupBy("part").count().collect()
    sizes = sorted(r["count"] for r in keys)
    assert len(sizes) == 10 and sizes[-1] < 1.1 * sizes[5]


def test_a_search_reads_the_stored_index(spark, tmp_path):
    targets = table(spark, some(7, 4, 90)).select(F.col("seq_id").alias("ord"), F.concat(F.lit("t"), F.col("seq_id").cast("string")).alias("name"), "seq")
    queries = table(spark, some(8, 3, 70)).select("seq_id", F.lit("q").alias("name"), "seq")
    p = SearchParameters(seed=-4.0, interaction=-1.0, final=-3.0)
    found = []
    for n, index in enumerate((8, 5)):  # levels beyond the index are counted from its places
        at = f"file://{tmp_path}/db{n}"
        build(targets, at, BuildParameters(index=index))
        store = Store.open(spark, at)
        assert store.window_levels.agg(F.max("k")).first()[0] == index
        seeds = store_seeds(queries, store, p)
        plan = seeds._jdf.queryExecution().optimizedPlan().toString()
        assert "window_index.parquet" in str(store.window_index.inputFiles()) and "accessibility" not in plan
        assert all("/sequences.parquet" not in f for f in seeds.inputFiles()) and any("/window_index.parquet" in f for f in seeds.inputFiles())
        found.append(sorted(map(tuple, seeds.collect())))
    masked = lambda df, key: df.select(F.col(key).alias("seq_id"), F.regexp_replace("seq", "[^ACGU]", "N").alias("seq"))
    want = sorted(map(tuple, seed_search(masked(queries, "seq_id"), masked(targets, "ord"), 5, 20, -400).collect()))
    assert found == [want] * 2 and want
    # the places of the database aren't shuffled: few windows go to them
    lines = store_seeds(queries, store, p)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    scans = [i for i, line in enumerate(lines) if "FileScan" in line and "beyond#" in line]
    assert len(scans) == 2  # places of queries and of targets
    for i in scans:
        above, at = [], depth(lines[i])
        for line in reversed(lines[:i]):
            if depth(line) < at:
                at = depth(line)
                above.append(line.lstrip(" :+-*()0123456789"))
        joined = next(k for k, x in enumerate(above) if "Join" in x)
        assert above[joined].startswith("BroadcastHashJoin") and not any(x.startswith("Exchange") for x in above[:joined])
    hits = search_store(queries, store, p)
    own = accessibility(queries.select("seq_id", "seq"))
    plain = search(queries.select("seq_id", "seq"), targets.select(F.col("ord").alias("seq_id"), "seq"), store.accessibility, parameters=p, own=own.select("seq_id", "acc", "cond"))
    key = lambda df: sorted((r.query_id, r.target_id, r.q_start, r.t_start, r.q_len, r.t_len, round(r.energy, 6)) for r in df.collect())
    assert key(hits) == key(plain) and hits.count() > 3
