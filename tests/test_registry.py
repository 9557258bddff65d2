import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from duplexa import registry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    own, want = registry.queries()[name](spark, DIR).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    columns = sorted(own.columns)
    assert columns == sorted(want.columns)
    own, want = (x[columns].sort_values(columns).reset_index(drop=True).astype(str) for x in (own, want))
    assert own.equals(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.queries()) <= set(entry.queries())


def test_windows_of_long_and_odd_sequences(spark, monkeypatch):
    from duplexa.operators import index
    from duplexa.operators.seeds import PIECE, windows

    seqs = ["", "ACG", "ACGUN" * 700, "A" * (PIECE + 2), "ACGU" * (PIECE // 2), "acguACGUé"]
    df = spark.createDataFrame(list(enumerate([*seqs, None])), "seq_id long, seq string")
    for target in (False, True):
        got = sorted((r.seq_id, r.pos, r.window, r.beyond) for r in windows(df, 4, 9, target).collect())
        want = []
        for n, s in enumerate(seqs):
            text = "".join(c if c in "ACGU" else "N" for c in (s[::-1] if target else s))
            want += [(n, len(s) - 1 - p if target else p, text[p : p + 4], text[p : p + 9].ljust(9, "N")) for p in range(len(s) - 3) if "N" not in text[p : p + 4]]
        assert got == sorted(want)
    number = lambda w: int(w.translate(str.maketrans("ACGU", "0123")), 4)
    for part in (index.PART, 5):
        monkeypatch.setattr(index, "PART", part)
        got = sorted((r.seq_id, r.pos, r.kmer) for r in index.kmer_index(df, 4).collect())
        assert got == sorted((n, p, number(s[p : p + 4])) for n, s in enumerate(seqs) for p in range(len(s) - 3) if set(s[p : p + 4]) <= set("ACGU"))
        want = Counter((k, number(s[p : p + k])) for s in seqs for k in (1, 2, 3) for p in range(len(s) - k + 1) if set(s[p : p + k]) <= set("ACGU"))
        assert {(r.k, r.kmer): r.n for r in index.kmer_counts(df, 3).collect()} == want


def test_seeds_equal_plain_growth(spark):
    """Base by base, also from sequences with masked and unknown bases, and for windows of other sizes."""
    from duplexa.functions.energy import REVERSE, STACK
    from duplexa.operators.seeds import _TYPE, seed_search

    rng = random.Random(3)
    seqs = ["".join(rng.choice("GGCCAUN" if i % 2 else "GCGCAUa") for _ in range(60)) for i in range(5)] + ["", "GC", "GCGCGCGCGCGCGCGCGCGCGCGCGCGCGC"]
    df = spark.createDataFrame(list(enumerate([*seqs, None])), "seq_id long, seq string")
    for least, most, threshold in ((5, 20, -600), (3, 6, -300), (4, 4, -400)):
        want = []
        for qi, q in enumerate(seqs):
            for ti, t in enumerate(seqs):
                for i in range(len(q)):
                    for j in range(len(t)):
                        energy, last = 0, 0
                        for n in range(most):
                            kind = _TYPE.get((q[i + n], t[j - n]), 0) if i + n < len(q) and j - n >= 0 else 0
                            if not kind:
                                break
                            energy += int(STACK[last, REVERSE[kind]]) if last else 0
                            last = kind
                            if n + 1 >= least and energy < threshold:
                                want.append((qi, ti, i, j - n, n + 1, energy))
                                break
        assert sorted(map(tuple, seed_search(df, df, least, most, threshold).collect())) == sorted(want) and want
