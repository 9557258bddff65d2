import random

import numpy as np
import pytest

from duplexa.functions.energy import REVERSE, Loops, Model, rule_loops
from duplexa.operators.loops import loop_energies, stem_loops

COLUMNS = "outer_type int, inner_type int, u1 int, u2 int, a string, b string, c string, d string"


def tables():
    """Loop tables in which each place has its own value."""
    rng = np.random.default_rng(3)
    return Loops(*(rng.integers(-300, 600, (7, 7, *(5,) * k)) for k in (2, 3, 4)))


@pytest.mark.parametrize("loops", [rule_loops(), tables()])
def test_joins_give_the_kernels_energies(spark, loops):
    rng, rows = random.Random(4), []
    for u1 in range(8):
        for u2 in range(8):
            for _ in range(12):
                a, b, c, d = rng.choices("ACGU", k=4)
                a, b = (a, a) if u1 == 1 else (a, b)
                c, d = (c, c) if u2 == 1 else (c, d)
                rows.append((rng.randint(1, 6), rng.randint(1, 6), u1, u2, a, b, c, d))
    got = loop_energies(spark.createDataFrame(list(dict.fromkeys(rows)), COLUMNS), Model(loops)).collect()
    assert len(got) == len(set(rows))
    code = {b: k + 1 for k, b in enumerate("ACGU")}
    for r in got:
        want = Model(loops).loop(r.outer_type, int(REVERSE[r.inner_type]), r.u1, r.u2, code[r.a], code[r.b], code[r.c], code[r.d])
        assert r.energy == pytest.approx(float(want)), r


def test_unknown_bases_and_long_sides_have_no_energy(spark):
    rows = [(1, 1, 1, 1, "N", "N", "A", "A"), (1, 1, 40, 40, "A", "A", "A", "A"), (1, 1, 3, 3, None, "A", "A", "A"), (1, 1, 0, 3, "N", "N", "A", "A")]
    got = [r.energy for r in loop_energies(spark.createDataFrame(rows, COLUMNS), Model(rule_loops())).collect()]
    assert sum(e is None for e in got) == 3


def test_stems_of_a_band(spark):
    q, t = "GGGGAACCCCAAAAAAAAAAAACCCC", "GGGGGGGGAGGGGCCCC"
    df = lambda s: spark.createDataFrame([(0, s)], "seq_id long, seq string")
    stems = spark.createDataFrame([(0, 0, 0, 13, 4), (0, 0, 6, 9, 4), (0, 0, 6, 4, 4), (0, 0, 22, 0, 4)], "query_id long, target_id long, q_start int, t_start int, length int")
    got = {(r.q_start, r.q_next, r.t_next): (r.u1, r.u2) for r in stem_loops(stems, df(q), df(t), Model(rule_loops())).collect()}
    assert got == {(0, 6, 9): (2, 0), (0, 6, 4): (2, 5)}
    assert stem_loops(stems.where("false"), df(q), df(t), Model(rule_loops())).collect() == []


def test_a_stand_in_is_told():
    with pytest.warns(UserWarning, match="rule"):
        Model()
