import functools
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duplexa.functions.bases import base_codes
from duplexa.functions.energy import DANGLE3, DANGLE5, PAIR, REVERSE, TERMINAL_AU, Model
from duplexa.operators import extend
from duplexa.operators.accessibility import profiles
from duplexa.operators.blocks import blocks, opening
from duplexa.operators.dominance import islands, sweep, undominated
from duplexa.operators.extend import Strand
from duplexa.plans.search import SearchParameters, search

MODEL = Model()
LEAST = 3


class Duplex:
    """A query and a target as plain lists; places on the target count from its 3' end."""

    def __init__(self, query, target, flat=True):
        self.names = query, target
        self.q, self.t = base_codes(query).tolist(), base_codes(target)[::-1].tolist()
        self.profiles = [(np.zeros(len(s), np.float32), np.zeros(len(s), np.float32)) for s in (query, target)] if flat else profiles([query, target], 30, LEAST)
        (self.qa, self.qc), (self.ta, self.tc) = ([x.astype(float).tolist() for x in p] for p in self.profiles)

    def type(self, k, v):
        return int(PAIR[self.q[k] if 0 <= k < len(self.q) else 0, self.t[v] if 0 <= v < len(self.t) else 0])

    def known(self, k, v):
        return 0 <= k < len(self.q) and 0 <= v < len(self.t) and self.q[k] > 0 and self.t[v] > 0

    def step(self, k, v, back):
        f = len(self.t) - 1 - v
        q = self.qa[k] - self.qa[k + 1] + self.qc[k + LEAST] if back else self.qc[k]
        return q, self.tc[f] if back else self.ta[f] - self.ta[f + 1] + self.tc[f + LEAST]

    def loop(self, i, j, p, r):
        """Between the outer pair (i, j) and the inner one (p, r)."""
        at = lambda s, x: s[x] if 0 <= x < len(s) else 0
        return float(MODEL.loop(self.type(i, j), int(REVERSE[self.type(p, r)]), p - i - 1, r - j - 1, at(self.q, i + 1), at(self.q, p - 1), at(self.t, r - 1), at(self.t, j + 1))) / 100

    def open_cost(self, k, v, size):
        f = len(self.t) - v - size
        return self.qa[k] + sum(self.qc[k + LEAST : k + size]) + self.ta[f] + sum(self.tc[f + LEAST : f + size])

    def seed(self, k, v, size):
        """(k, v, size, acc, hyb)"""
        return k, v, size, self.open_cost(k, v, size), sum(self.loop(k + x, v + x, k + x + 1, v + x + 1) for x in range(size - 1))


def strands(duplexes, pad=6):
    out = []
    for side, reverse in ((0, False), (1, True)):
        lists = lambda xs, t: pa.array([x.tolist() for x in xs], pa.list_(t))
        acc, cond = ([d.profiles[side][k] for d in duplexes] for k in (0, 1))
        n = np.array([len(d.names[side]) for d in duplexes])
        out.append(Strand(pa.array([d.names[side] for d in duplexes]), lists(acc, pa.float32()), lists(cond, pa.float32()), lists([np.concatenate(([0.0], np.cumsum(c, dtype=float))) for c in cond], pa.float64()), np.zeros(len(n), int), n, LEAST, reverse, pad))
    return out


def flat(q, t, row, hits):
    k, v, size, acc, hyb = (np.array(x) for x in zip(*hits, strict=True))
    row = np.array(row)
    return row, q.at[row] + k, t.at[row] + v, size, acc.astype(float), hyb.astype(float)


def ungapped(duplexes, row, hits, drop):
    q, t = strands(duplexes)
    row, k, v, size, acc, hyb = flat(q, t, row, hits)
    start = np.array([len(duplexes[r].names[1]) for r in row]) - (v - t.at[row]) - size
    assert np.allclose(q.opening(row, k - q.at[row], size, LEAST) + t.opening(row, start, size, LEAST), acc)
    k, v, size, acc, hyb, cut = extend.ungapped(q, t, MODEL, k, v, size, acc, hyb, drop)
    assert not cut.any()
    return list(zip((k - q.at[row]).tolist(), (v - t.at[row]).tolist(), size.tolist(), acc.tolist(), hyb.tolist(), strict=True))


def plain_ungapped(d, hit, drop):
    k0, v0, size, acc, hyb = hit
    ends = []
    for way in (-1, 1):
        near = k, v = (k0, v0) if way < 0 else (k0 + size - 1, v0 + size - 1)
        best, a, h, best_a, best_h = k, acc, hyb, acc, hyb
        while abs(k - best) < drop and d.known(k + way, v + way):
            k, v = k + way, v + way
            a += sum(d.step(k, v, way < 0))
            if d.type(k, v):
                h += d.loop(k, v, *near) if way < 0 else d.loop(*near, k, v)
                near = k, v
                if a + h < best_a + best_h:
                    best_a, best_h, best = a, h, k
        acc, hyb = best_a, best_h
        ends.append(best)
    return ends[0], v0 + ends[0] - k0, ends[1] - ends[0] + 1, acc, hyb


def some_seeds(duplexes, sizes=(3, 4, 5)):
    for r, d in enumerate(duplexes):
        for k, v, size in itertools.product(range(len(d.q)), range(len(d.t)), sizes):
            if all(d.type(k + x, v + x) for x in range(size)):
                yield r, d.seed(k, v, size)


def random_duplexes(seed, n=12, letters="ACGUN", weights=(4, 6, 6, 4, 0.5), lengths=(4, 7, 30, 60)):
    rng = random.Random(seed)
    return [Duplex(*("".join(rng.choices(letters, weights, k=rng.choice(lengths))) for _ in range(2)), flat=False) for _ in range(n)]


def test_ungapped_takes_the_whole_duplex():
    d = Duplex("AAGGGCCCGGAA", "UUCCGGGCCCUU")
    k, v, size, _, hyb = ungapped([d], [0], [d.seed(3, 3, 4)], 5)[0]
    assert (k, v, size) == (0, 0, 12) and hyb < -15
    blocked = Duplex("AAGGGCCCGGAA", "UUCCGGGCCNUU")  # position 2 of the reversed target is unknown
    assert ungapped([blocked], [0], [blocked.seed(3, 3, 4)], 5)[0][1] == 3


def test_ungapped_of_many_pairs_equals_one_by_one():
    """Also at the ends of strands, beside unknown bases, and for strands hardly longer than a seed."""
    duplexes = random_duplexes(5)
    rows, hits = zip(*some_seeds(duplexes), strict=True)
    assert len(hits) > 500 and len(set(rows)) > 8
    for drop in (1, 2, 5, 16):
        got, want = ungapped(duplexes, rows, hits, drop), [plain_ungapped(duplexes[r], h, drop) for r, h in zip(rows, hits, strict=True)]
        assert [g[:3] for g in got] == [w[:3] for w in want] and np.allclose([g[3:] for g in got], [w[3:] for w in want], atol=1e-12)


def plain_outwards(d, k0, v0, energy, back, drop, helix):
    """(added on the query, on the target, energy, opening cost, pairs) of the best duplex beyond a pair, by recursion from each pair inwards."""
    way = -1 if back else 1
    place = lambda i, j: (k0 + way * i, v0 + way * j)
    free = [next(n for n in itertools.count() if not d.known(*(place(n + 1, 0) if side == 0 else place(0, n + 1)))) for side in (0, 1)]
    wobble = lambda i, j: d.type(*place(i, j)) in (3, 4)
    kind = lambda i, j: d.type(*place(i, j)) if 0 <= i <= free[0] and 0 <= j <= free[1] else 0

    def before(i, j):
        """All places nearer by that a loop of up to `drop` bases leads to, in the order in which they are found going outwards."""
        near = [(a, b) for a in range(max(0, i - 1 - drop), i) for b in range(max(0, j - 1 - drop), j) if i + j - a - b - 2 <= drop and cell(a, b)]
        return sorted(near, key=lambda x: (sum(x), x[0]))

    @functools.cache
    def cell(i, j):
        """None, or (energy, place before, whether that place's pair is a wobble or None without one)."""
        if (i, j) == (0, 0):
            return energy, None, wobble(0, 0)
        if i < 1 or j < 1 or not kind(i, j):
            return None
        inner = cell(i - 1, j - 1)
        if inner is None or inner[2] is None or (wobble(i, j) and inner[2]):
            if not all(kind(i + x, j + x) for x in range(1, helix)) or (helix > 1 and wobble(i, j) and wobble(i + 1, j + 1)):
                return None
        best, source = 1e6, None
        for a, b in before(i, j):
            e = (d.loop(*place(i, j), *place(a, b)) if back else d.loop(*place(a, b), *place(i, j))) + cell(a, b)[0]
            if e < best:
                best, source = e, (a, b)
        if source is None:  # sees the first cell that is near enough to be looked at, if any
            first = next(((a, s - a) for s in range(max(0, i + j - 2 - drop), i + j + 1) for a in range(s + 1) if (s < i + j or a < i) and cell(a, s - a)), None)
            return best, None, None if first is None else wobble(*first)
        return best, source, wobble(*source)

    total, opened, at, found = energy, 0.0, None, 0
    cost = [[0.0], [0.0]]
    for length in itertools.count(1):
        if length - 1 - found >= drop or length > max(free) + 1:
            break
        for side in (0, 1):
            if length <= free[side]:
                cost[side].append(cost[side][-1] + d.step(*place(length, length), back)[side])
        for i in range(max(1, length - free[1]), min(free[0], length - 1) + 1):
            j = length - i
            if cell(i, j) and cost[0][i] + cost[1][j] + cell(i, j)[0] < total:
                opened, at, found = cost[0][i] + cost[1][j], (i, j), length
                total = opened + cell(i, j)[0]
    pairs, x = [], at
    while x and x != (0, 0):
        pairs.append(place(*x))
        x = cell(*x)[1]
    return (*(at or (0, 0)), total, opened, sorted(pairs))


class Sides(Duplex):
    """A duplex whose costs are asked for one side at a time, with the other out of range."""

    def step(self, k, v, back):
        f = len(self.t) - 1 - v
        g = lambda x, i: x[i] if 0 <= i < len(x) else 0.0
        return (self.qa[k] - self.qa[k + 1] + self.qc[k + LEAST] if back else self.qc[k]) if 0 <= k < len(self.q) else 0.0, (g(self.tc, f) if back else g(self.ta, f) - g(self.ta, f + 1) + g(self.tc, f + LEAST))


@pytest.mark.parametrize("drop, helix", [(16, 3), (6, 2), (3, 1), (10, 4)])
def test_gapped_equals_plain_recursion(drop, helix):
    rng = random.Random(drop)
    duplexes = [Sides(*("".join(rng.choices("ACGUN", (3, 5, 5, 3, 0.2), k=rng.choice((12, 25, 40)))) for _ in range(2)), flat=False) for _ in range(6)]
    rows, hits = zip(*((r, h) for r, h in some_seeds(duplexes, (4,)) if h[4] < -3), strict=True)
    keep = range(0, len(rows), max(1, len(rows) // 40))
    rows, hits = [rows[i] for i in keep], [hits[i] for i in keep]
    q, t = strands(duplexes)
    row, k, v, size, acc, hyb = flat(q, t, rows, hits)
    grown = 0
    for back in (True, False):
        end_k, end_v = (k, v) if back else (k + size - 1, v + size - 1)
        add_q, add_t, best, opened, cut, pairs = extend.outwards(q, t, MODEL, end_k, end_v, acc + hyb, back, drop, helix)
        assert not cut.any()
        for n, r in enumerate(rows):
            d = duplexes[r]
            want = plain_outwards(d, int(end_k[n] - q.at[r]), int(end_v[n] - t.at[r]), float(acc[n] + hyb[n]), back, drop, helix)
            own = sorted(zip((pairs[1] - q.at[r])[pairs[0] == n].tolist(), (pairs[2] - t.at[r])[pairs[0] == n].tolist(), strict=True))
            assert (int(add_q[n]), int(add_t[n])) == want[:2] and own == want[4]
            assert best[n] == pytest.approx(want[2], abs=1e-9) and opened[n] == pytest.approx(want[3], abs=1e-9)
            grown += want[0] > 0
    assert grown > 10


def test_dangles():
    d = Duplex("AGGGCA", "UGCCCA")
    q, t = strands([d])
    one = lambda k, v, m, n: float(extend.dangling(q, t, q.at[:1] + k, t.at[:1] + v, np.array([m]), np.array([n]))[0])
    first, last = d.type(1, 1), int(REVERSE[d.type(4, 4)])
    assert one(1, 1, 4, 4) == pytest.approx((DANGLE5[first, d.q[0]] + DANGLE3[first, d.t[0]] + DANGLE5[last, d.t[5]] + DANGLE3[last, d.q[5]]) / 100)
    whole = Duplex("AGGGU", "ACCCU")
    q, t = strands([whole])
    assert one(0, 0, 5, 5) == pytest.approx(2 * TERMINAL_AU / 100)  # the target ends with AU pairs on both sides
    beside = Duplex("NGGGC", "GCCCN")
    q, t = strands([beside])
    assert one(1, 1, 3, 3) > 1000  # unknown neighbours are forbidden


def plain_undominated(hits, threshold):
    """The full double loop over (q_start, t_start, q_len, t_len, energy)."""
    hits = sorted(hits, key=lambda h: (-(h[1] + h[3]), h[0], -h[3], -h[2], h[4]))
    gone = [h[4] > threshold for h in hits]
    for a, x in enumerate(hits):
        if gone[a]:
            continue
        for b in range(a + 1, len(hits)):
            y = hits[b]
            if not gone[b] and x[0] <= y[0] and x[0] + x[2] >= y[0] + y[2] and x[1] <= y[1] and x[1] + x[3] >= y[1] + y[3]:
                gone[a if x[4] > y[4] else b] = True
    return sorted(h for h, g in zip(hits, gone, strict=True) if not g)


HITS = "query_id long, target_id long, q_start int, t_start int, q_len int, t_len int, energy double, note string"


def test_dominance_equals_the_full_double_loop(spark):
    rng = random.Random(4)
    groups = {(q, t): [(rng.randrange(12), rng.randrange(40 if t else 12), rng.randrange(3, 12), rng.randrange(3, 12), float(-rng.randrange(2, 12))) for _ in range(60)] for q in range(6) for t in range(3)}
    # going from the target's end, h drops j first, so j can't drop i: a plain anti-join would give h alone
    groups[9, 9] = [(0, 2, 21, 11, -20.0), (0, 0, 21, 11, -10.0), (5, 3, 11, 6, -15.0)]
    groups[9, 8] = [(0, 0, 9, 9, -5.0), (1, 3, 5, 5, -9.0)]
    groups[9, 7] = [(0, 0, 9, 9, -5.0)] * 3
    groups[9, 6] = [(0, 0, 9, 9, -4.0), (0, 20, 9, 9, -3.9)]
    rows = [(q, t, *h, "x") for (q, t), hits in groups.items() for h in hits]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, HITS)
    want = sorted((q, t, *h) for (q, t), hits in groups.items() for h in plain_undominated(hits, -4.0))
    assert sorted(tuple(r)[:7] for r in undominated(df, -4.0).collect()) == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # hits stay open over batches
    try:
        assert sorted(tuple(r)[:7] for r in undominated(df, -4.0).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert undominated(df.where("false"), -4.0).collect() == []
    with_null = df.limit(3).union(spark.createDataFrame([(1, None, 1, 1, 1, 1, -9.0, None), (1, 1, 1, 1, None, 1, -9.0, None), (1, 1, 1, 1, 3, 3, None, None)], HITS))
    assert undominated(with_null, 0.0).where("q_len is null or target_id is null or energy is null").count() == 0


def test_islands_cut_a_pair_where_nothing_overlaps(spark):
    rows = [(1, 1, 0, s, 3, n, -5.0, "x") for s, n in ((0, 4), (2, 5), (7, 2), (9, 3), (20, 5), (24, 1))]
    got = {r.t_start: r.island for r in islands(spark.createDataFrame(rows, HITS)).collect()}
    assert got == {24: 0, 20: 0, 9: 1, 7: 2, 2: 3, 0: 3}


def test_the_sweep_holds_only_open_hits():
    n = 5000
    t_end = np.arange(10 * n, 0, -10)
    zero = np.zeros(n, int)
    there, gone, (_, open_) = sweep(np.zeros((n, 3), int), zero, zero + 5, t_end - 10, t_end, np.full(n, -5.0), 0, None)
    assert there.all() and not len(gone) and open_.n == 1 and open_.ints.shape[1] == 64


def test_opening_is_a_difference_of_running_sums(spark):
    seqs = ["ACGGGAAACCCAUAUGCGC" * 5, "GGGAAACCCUU", "AC", None]
    own = profiles([s or "" for s in seqs], 30, 5)
    sequences = spark.createDataFrame(list(enumerate(seqs)), "seq_id long, seq string")
    known = spark.createDataFrame([(i, a.tolist(), c.tolist()) for i, (a, c) in enumerate(own)], "seq_id long, acc array<float>, cond array<float>")
    table = blocks(sequences, known, 16, 32)
    assert {(r.seq_id, r.block, r.offset, len(r.seq)) for r in table.where("seq_id = 0").collect()} == {(0, b, max(0, 16 * b - 32), min(95, 16 * b + 48) - max(0, 16 * b - 32)) for b in range(6)}
    asked = [(i, p, n) for i, s in enumerate(seqs) for p in range(0, len(s or "."), 3) for n in (3, 5, 8, 20)]
    got = {(r.seq_id, r.pos, r.length): r.cost for r in opening(table, spark.createDataFrame(asked, "seq_id long, pos int, length int"), 5, 16).collect()}
    for i, p, n in asked:
        a, c = own[i]
        if n < 5 or p + n > len(seqs[i] or ""):
            assert got[i, p, n] is None
        else:
            assert got[i, p, n] == pytest.approx(float(a[p]) + float(c[p + 5 : p + n].astype(float).sum()), abs=1e-9)


def test_short_blocks_give_the_same_hits(spark, monkeypatch):
    """Blocks that reach hardly further than a seed: what comes to their border is taken again in wider ones."""
    from duplexa.plans import search as plan

    rng = random.Random(8)
    seqs = ["".join(rng.choices("ACGU", (3, 4, 4, 3), k=n)) for n in (150, 90, 40, 400)]
    df = spark.createDataFrame(list(enumerate([*seqs, "", None])), "seq_id long, seq string")
    p = SearchParameters(seed=-5.0, interaction=-2.0, final=-5.0)
    keys = ["query_id", "target_id", "q_start", "t_start", "q_len", "t_len", "base_pairs"]
    own = spark.createDataFrame([(i, a.tolist(), c.tolist()) for i, (a, c) in enumerate(profiles(seqs, 30, 5))], "seq_id long, acc array<float>, cond array<float>")
    want = search(df, df, own, span=30, parameters=p, own=own).collect()
    levels = []

    class Short(extend.Blocks):
        def __init__(self, queries, targets):
            super().__init__(queries, targets, 8, 24)

        def reaching(self, level):
            levels.append(level)
            return super().reaching(level)

    monkeypatch.setattr(plan, "Blocks", Short)
    got = search(df, df, own, span=30, parameters=p, own=own).collect()
    assert max(levels) >= 1 and len(want) > 20
    order = lambda rows: sorted(rows, key=lambda r: [r[k] for k in keys[:6]])
    assert [[r[k] for k in keys] for r in order(got)] == [[r[k] for k in keys] for r in order(want)]
    assert np.allclose([r.energy for r in order(got)], [r.energy for r in order(want)], atol=1e-9)
    for r in want:
        query, target = seqs[r.query_id], seqs[r.target_id]
        assert r.energy == pytest.approx(r.acc_energy + r.hyb_energy) and r.energy <= -5
        assert all(PAIR[base_codes(query)[b.q], base_codes(target)[b.t]] for b in r.base_pairs)
        assert all(b.q > a.q and b.t < a.t for a, b in itertools.pairwise(r.base_pairs))
        assert (r.base_pairs[0].q, r.base_pairs[-1].t) == (r.q_start, r.t_start) and r.base_pairs[-1].q == r.q_start + r.q_len - 1
    tight = {tuple(r[k] for k in keys[:6]) for r in search(df, df, own, span=30, parameters=SearchParameters(seed=-5.0, interaction=-2.0, final=-7.0), own=own).collect()}
    assert tight <= {tuple(r[k] for k in keys[:6]) for r in want}


def test_no_exchange_carries_a_whole_profile(spark):
    """A sequence of 5,000 bases goes to its hits in contexts of bounded length."""
    long = "".join(random.Random(1).choices("ACGU", k=5000))
    flat_profile = spark.createDataFrame([(0, [0.0] * 5000, [0.0] * 5000)], "seq_id long, acc array<float>, cond array<float>")
    table = extend.Blocks(*((spark.createDataFrame([(0, long)], "seq_id long, seq string"), flat_profile),) * 2)
    seeds = spark.createDataFrame([(0, 0, 4000, 100, 5, -3.0)], "query_id long, target_id long, q_start int, t_start int, length int, hyb double")
    met = extend._in_contexts(seeds, ["q_start", "t_start", "length", "hyb"], *table.reaching(0), table.size)
    assert met.agg(F.max(F.size("q_acc")), F.max(F.size("t_run"))).first() == (3 * 256, 100 // 256 * 256 + 512 + 1)
