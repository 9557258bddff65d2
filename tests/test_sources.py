import shutil

import pytest
from pyspark.sql import functions as F

from duplexa.cli import main
from duplexa.functions import bases
from duplexa.operators.schedule import balanced, packed
from duplexa.plans.search import SearchParameters, numbered, search_store, shortest
from duplexa.sources.fasta import by_order, first_record, paged, read_fasta, split_by_name, write_fasta
from duplexa.sources.store import BuildParameters, Store, build
from duplexa.streaming.search import stream_search

FASTA = ">a lncRNA x\r\nACGU\r\nacgu\r\n\r\n>b\nGGG>GG\n>empty\n>a lncRNA x\nUUUU\n"
TARGETS = ">t1\nAAAAGGGGCGCGAAAAUUUUCCCCAAGCGCGCAAAA\n>t2\nUUUUUUUUUUUUUUUUUUU\n>t3\nACG\n"
QUERIES = ">q1\nAAUUCGCGCCCCAAUU\n>q2\nAAAAAAAA\n"


def test_fasta_round_trip(spark, tmp_path):
    (tmp_path / "x.fa").write_bytes(FASTA.encode())
    rows = read_fasta(spark, f"file://{tmp_path}/x.fa").orderBy("ord").collect()
    assert [(r.ord, r.name, r.seq) for r in rows] == [(0, "a lncRNA x", "ACGUacgu"), (1, "b", "GGG>GG"), (2, "empty", ""), (3, "a lncRNA x", "UUUU")]
    table = read_fasta(spark, f"file://{tmp_path}/x.fa")
    write_fasta(table.withColumn("seq", F.repeat("seq", 20)), f"file://{tmp_path}/out")
    again = read_fasta(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r.name, r.length) for r in again) == sorted((r.name, 20 * r.length) for r in rows)
    assert [r.ord for r in by_order(table, spark.createDataFrame([(1,), (3,), (9,)], "ord long")).orderBy("ord").collect()] == [1, 3]
    assert first_record(table).first().name == "a lncRNA x" and [r.page for r in paged(table, 2).orderBy("ord").collect()] == [0, 0, 1, 1]
    part, all_ = split_by_name(table)
    assert [(r.ord, r.seq) for r in part.collect()] == [(3, "UUUU")] and all_.count() == 3
    assert {r.name for r in split_by_name(table, complement=True)[1].collect()} == {"b", "empty"}


def test_masks_and_codes(spark):
    df = spark.createDataFrame([("ACGUTNacgutx-é",)], "seq string")
    one = lambda c: df.select(c).first()[0]
    assert [one(bases.masked(F.col("seq"), m)) for m in (0, 1, 2)] == ["ACGUUNNNNNNNNN", "ACGUUNacguuNNN", "ACGUUNACGUUNNN"]
    assert one(bases.encoded(F.col("seq"), 1)) == [2, 3, 4, 5, 5, 1, 6, 7, 8, 9, 9, 1, 1, 1, 0]
    assert one(bases.encoded(F.col("seq"), 0, target=True))[-6:] == [5, 5, 4, 3, 2, 0]
    assert one(bases.residue_count(F.col("seq"), 2)) == 10
    with pytest.raises(ValueError):
        bases.masked(F.col("seq"), 3)
    with pytest.raises(ValueError):
        BuildParameters(least=1)


def test_numbers_as_text(spark):
    df = spark.createDataFrame([(-8.5,), (-12.0,), (-0.1234567,), (100.0,), (1e-7,)], "x double")
    assert [r[0] for r in df.select(shortest(F.col("x"))).collect()] == ["-8.5", "-12", "-0.123457", "100", "1e-07"]


def test_balanced_bins(spark):
    rows = spark.createDataFrame([(i, "A" * (i % 97 + 1)) for i in range(3000)], "seq_id long, seq string")
    loads = [r.n for r in balanced(rows, 7).join(rows, "seq_id").groupBy("bin").agg(F.sum(F.length("seq")).alias("n")).collect()]
    assert len(loads) == 7 and max(loads) < 1.05 * min(loads)
    loads = {r.bin: r.n for r in packed(rows, 7).join(rows, "seq_id").groupBy("bin").agg(F.sum(F.length("seq")).alias("n")).collect()}
    share = sum(loads.values()) // 7
    assert sorted(loads) == list(range(7)) and all(loads[b] <= share for b in range(6))


def test_database_search_and_stream(spark, tmp_path):
    for name, text in (("t.fa", TARGETS), ("q.fa", QUERIES)):
        (tmp_path / name).write_text(text)
    at = f"file://{tmp_path}"
    main(["db", "-i", f"{at}/t.fa", "-o", f"{at}/db", "-d", "5", "-c", "2"], spark)
    store = Store.open(spark, f"{at}/db")
    assert (store.least, store.index, store.repeat) == (5, 8, 0)
    assert [(r.name, r.page_id, r.known_length) for r in store.sequences.orderBy("seq_id").collect()] == [("t1", 0, 36), ("t2", 0, 19), ("t3", 1, 3)]
    main(["ris", "-i", f"{at}/q.fa", "-d", f"{at}/db", "-o", f"{at}/hits", "-s", "1", "-g", "-2", "-f", "-1"], spark)
    lines = [line for p in sorted((tmp_path / "hits").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines[2].startswith("Id,Query name") and len(lines) > 3
    assert lines[3].split(",")[1:5] == ["q1", "16", "t1", "36"] and lines[3].endswith(") ")
    p = SearchParameters(final=-2.0, interaction=-1.0)
    queries = read_fasta(spark, f"{at}/q.fa").withColumnRenamed("ord", "seq_id").select("seq_id", "name", "seq")
    hits = search_store(queries, store, p)
    want = sorted((r.query_id, r.target_id, r.q_start, r.t_start, round(r.energy, 6)) for r in hits.collect())
    assert len(want) == len(lines) - 3
    for e in hits.collect():
        assert e.energy <= -2 and all(0 <= b.q < 16 and 0 <= b.t < 36 for b in e.base_pairs)
    # pages don't matter
    build(read_fasta(spark, f"{at}/t.fa"), f"{at}/db2", BuildParameters(least=5))
    other = search_store(queries.repartition(3), Store.open(spark, f"{at}/db2"), p)
    assert sorted((r.query_id, r.target_id, r.q_start, r.t_start, round(r.energy, 6)) for r in other.collect()) == want
    # three files, one batch each: numbered as one search over all is
    files = [(0, 1), (1, 2), (2, 3)]
    more = queries.union(queries.where("seq_id = 0").select(F.lit(2).cast("long"), "name", "seq"))
    whole = {(r.query_id, r.target_id, r.q_start, r.t_start): r.id for r in numbered(search_store(more, store, p)).collect()}
    assert sorted(whole.values()) == list(range(len(whole))) and len(whole) > len(want)

    def run():
        stream_search(spark, f"{at}/incoming", f"{at}/db", f"{at}/streamed", f"{at}/state", p).awaitTermination(240)
        return {(r.query_id, r.target_id, r.q_start, r.t_start): r.id for r in spark.read.parquet(f"{at}/streamed").collect()}

    for low, high in files[:2]:
        more.where((F.col("seq_id") >= low) & (F.col("seq_id") < high)).coalesce(1).write.mode("append").parquet(f"{at}/incoming")
        run()
    # a batch that ended without Spark knowing is done again
    shutil.rmtree(tmp_path / "streamed" / "batch=1")
    (tmp_path / "state" / "stream" / "commits" / "1").unlink()
    for crc in (tmp_path / "state" / "stream" / "commits").glob(".1*"):
        crc.unlink()
    more.where("seq_id >= 2").coalesce(1).write.mode("append").parquet(f"{at}/incoming")
    assert run() == whole
