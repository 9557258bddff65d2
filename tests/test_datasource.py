import io
import random

import pytest
from pyspark.sql import functions as F

from duplexa.sources import datasource
from duplexa.sources.datasource import FastaReader, records, register
from duplexa.sources.fasta import read_fasta

ODD = b"lost line\n>a one\r\nACGU\r\nac gu\r\n\r\n>b\nGGG>GG\n>\n>empty\n>e\nUU"


def plain(data):
    """(offset, name, seq) line by line."""
    out, at = [], 0
    for line in data.split(b"\n"):
        if line.startswith(b">"):
            out.append([at, line[1:].decode().rstrip("\r"), ""])
        elif out:
            out[-1][2] += "".join(line.decode().split())
        at += len(line) + 1
    return [tuple(x) for x in out]


@pytest.mark.parametrize("read", [1, 2, 3, 7, 1 << 20])
def test_splits_have_each_record_once(read, monkeypatch):
    monkeypatch.setattr(datasource, "READ", read)
    rng = random.Random(read)
    texts = [ODD, b"", b">", b"\n>x\nA", b"no record", b">a\n>b\n>c"] + [bytes(rng.choice(b">\n\rACG") for _ in range(rng.randrange(60))) for _ in range(30)]
    for data in texts:
        for size in (1, 2, 5, 17, 1000):
            got = [datasource._row("f", o, r)[1:4] for s in range(0, len(data), size) for o, r in records(io.BytesIO(data), s, min(s + size, len(data)))]
            assert got == plain(data), (data, size)


def test_read_write_and_filters(spark, tmp_path):
    register(spark)
    (tmp_path / "x.fa").write_bytes(ODD * 20)
    want = plain(ODD * 20)
    df = spark.read.format("fasta").option("split", 64).load(f"file://{tmp_path}/x.fa")
    assert df.rdd.getNumPartitions() > 10
    assert sorted((r.offset, r.name, r.seq) for r in df.collect()) == want
    assert all(r.length == len(r.seq) for r in df.collect())
    middle = want[40][0]
    assert df.where(F.col("offset") == middle).count() == 1 and df.where("offset > 100000").count() == 0 and df.count() == len(want)
    part = spark.read.format("fasta").option("split", 64).option("from", middle).option("to", middle + 200)
    assert sorted((r.offset, r.name, r.seq) for r in part.load(f"file://{tmp_path}").collect()) == [w for w in want if middle <= w[0] < middle + 200]
    assert part.option("file", "y.fa").load(f"file://{tmp_path}").count() == 0
    options = {"path": f"file://{tmp_path}/x.fa", "split": "64"}
    assert len(FastaReader(options | {"from": str(middle), "to": str(middle + 1)}).partitions()) <= 2 < len(FastaReader(options).partitions())
    out = f"file://{tmp_path}/out"
    df.repartition(3).write.format("fasta").mode("append").option("width", 3).save(out)
    again = spark.read.format("fasta").load(out)
    key = lambda rows: sorted((r.name, r.seq) for r in rows)
    assert key(again.collect()) == key(df.collect())
    assert [r for r in key(df.collect()) if any(r)] == key(read_fasta(spark, out).collect())  # which knows no record without a name and a sequence
    lines = next((tmp_path / "out").glob("part*")).read_text().split("\n")
    assert max(len(x) for x in lines if ">" not in x) <= 3
    df.limit(2).write.format("fasta").mode("overwrite").save(out)
    assert spark.read.format("fasta").load(out).count() == 2 and not list((tmp_path / "out").glob("_*"))
    with pytest.raises(Exception, match="name and seq"):
        spark.range(1).write.format("fasta").mode("append").save(out)
    with pytest.raises(Exception, match="(?i)not ?found|nowhere"):
        spark.read.format("fasta").load(f"file://{tmp_path}/nowhere").count()


def test_a_stream_takes_each_file_once(spark, tmp_path):
    register(spark)
    (tmp_path / "in").mkdir()

    def run():
        q = spark.readStream.format("fasta").load(f"file://{tmp_path}/in").writeStream.format("parquet").option("checkpointLocation", f"file://{tmp_path}/state").option("path", f"file://{tmp_path}/got").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r.name for r in spark.read.parquet(f"file://{tmp_path}/got").collect())

    (tmp_path / "in" / "b.fa").write_text(">one\nAC\n>two\nGG\n")
    assert run() == ["one", "two"]
    (tmp_path / "in" / "a.fa").write_text(">three\nU\n")
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]
