import numpy as np
import pytest

from duplexa.functions.bases import base_codes
from duplexa.functions.energy import DANGLE3, DANGLE5, ML_BASE, ML_CLOSING, ML_INTERN, PAIR, REVERSE, TERMINAL_AU, TURN, Model, weight
from duplexa.operators.accessibility import Fold, profiles

MODEL = Model()


def structures(c, lo, hi, span):
    """All sets of nested pairs over bases lo..hi (from 1)."""
    if hi - lo < TURN + 1:
        yield ()
        return
    for rest in structures(c, lo + 1, hi, span):
        yield rest
    for j in range(lo + TURN + 1, min(hi, lo + span) + 1):
        if PAIR[c[lo], c[j]]:
            for a in structures(c, lo + 1, j - 1, span):
                for b in structures(c, j + 1, hi, span):
                    yield ((lo, j), *a, *b)


def scalar(x):
    return float(np.asarray(x).reshape(-1)[0])


def energy(c, n, pairs):
    total = 0.0

    def outside(i, j):
        t = PAIR[c[i], c[j]]
        e = DANGLE5[t, c[i - 1]] if i > 1 else 0
        e += DANGLE3[t, c[j + 1]] + TERMINAL_AU * (t > 2) if j < n else TERMINAL_AU * (t > 2)
        return e

    own = sorted(pairs)
    for i, j in own:
        kids = [(p, q) for p, q in own if i < p and q < j and not any(i < a < p and q < b < j for a, b in own)]
        t = PAIR[c[i], c[j]]
        if not any(a < i and j < b for a, b in own):
            total += outside(i, j)
        if not kids:
            total += scalar(MODEL.hairpin(np.array([t]), np.array([j - i - 1]), np.array([c[i + 1]]), np.array([c[j - 1]])))
        elif len(kids) == 1:
            p, q = kids[0]
            total += scalar(MODEL.loop([t], [REVERSE[PAIR[c[p], c[q]]]], [p - i - 1], [j - q - 1], [c[i + 1]], [c[p - 1]], [c[q + 1]], [c[j - 1]], asymmetry=True))
        else:
            r = REVERSE[t]
            total += ML_CLOSING + ML_INTERN * (1 + len(kids)) + DANGLE3[r, c[i + 1]] + TERMINAL_AU * (r > 2) + DANGLE5[r, c[j - 1]] + sum(outside(p, q) for p, q in kids)
            total += ML_BASE * (j - i - 1 - sum(q - p + 1 for p, q in kids))
    return total


@pytest.mark.parametrize(("seed", "n", "span"), [(1, 12, 70), (2, 14, 70), (3, 15, 10), (4, 16, 70), (5, 17, 70)])
def test_against_all_structures(seed, n, span):
    rng = np.random.default_rng(seed)
    seq = "".join(rng.choice(list("GCGCAU"), n)) if seed != 3 else "GGGAAACNCCAGUCC"[:n]
    if seed == 5:
        seq = "GGCAAAGCGAAACGCCA"[:n]
    c = np.r_[0, base_codes(seq), 0, 0]
    z, free = 0.0, {w: np.zeros(n) for w in (2, 3)}
    for s in structures(c, 1, n, span + 1 - 1):
        f = float(weight(energy(c, n, s)))
        z += f
        used = np.zeros(n + 1, bool)
        for i, j in s:
            used[[i, j]] = True
        for w in free:
            for x in range(1, n - w + 2):
                if not used[x : x + w].any():
                    free[w][x - 1] += f
    other = "".join(rng.choice(list("ACGU"), n - 3))
    fold = Fold([base_codes(seq), base_codes(other)], span, MODEL)
    assert fold.log_z[0] == pytest.approx(np.log(z), abs=1e-9)
    for w, p in free.items():
        assert fold.unpaired(w)[0, : n - w + 1] == pytest.approx((p / z)[: n - w + 1], abs=1e-9)


def test_padding_and_batches_do_not_matter():
    rng = np.random.default_rng(0)
    seqs = ["".join(rng.choice(list("ACGUN"), k, p=[0.24, 0.25, 0.25, 0.25, 0.01])) for k in (0, 3, 5, 6, 40, 41, 120)]
    together = profiles(seqs, 30, 5)
    for s, (acc, cond) in zip(seqs, together, strict=True):
        (a, b), = profiles([s], 30, 5)
        assert np.allclose(acc, a, atol=1e-5) and np.allclose(cond, b, atol=1e-5)
        assert len(acc) == len(cond) == len(s)
    assert (together[-1][0] >= 0).all()


def test_null_and_short_sequences(spark):
    from duplexa.operators.accessibility import accessibility

    rows = spark.createDataFrame([(1, None), (2, ""), (3, "ACG"), (4, "GGGGAAAACCCC"), (4, "GGGGAAAACCCC")], "seq_id long, seq string")
    got = sorted((r.seq_id, None if r.acc is None else len(r.acc)) for r in accessibility(rows).collect())
    assert got == [(1, None), (2, 0), (3, 3), (4, 12), (4, 12)]
    assert accessibility(rows.limit(0)).count() == 0
