import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from duplexa.llm import quality as Q

TEXTS = [None, "", " \n\t", "a b c a b c", "x\nx\n\n \n \nx y\nx", "é# é|é é# é|é é# é|é\x1c<>", "one\r\ntwo\none\r\n", "w " * 40000, "z" * 3_000_000 + " a b c", "a b\na b\na  b\n"]


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    runs = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    again = {i + j for i in range(len(words) - 2) if runs[tuple(words[i : i + 3])] > 1 for j in range(3)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again)]


def test_counts_equal_plain_ones():
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab \n\té#") for _ in range(rng.randrange(60))) for _ in range(400)]
    got = [c.tolist() for c in Q.counts_of(pa.array(texts))[:5]]
    assert list(map(list, zip(*got))) == [plain(t) for t in texts]
    assert [c.tolist() for c in Q.counts_of(pa.array(texts).slice(3, 200))[:5]] == [row[3:203] for row in got]


SCHEMA = "own long, in_lang long, " + ", ".join(f"{c} double" for c in Q.X)


def table_of(spark, keys, x):
    """Rows as models takes them, from (language, source) pairs: each group is a number, its language another."""
    langs = sorted({k[0] for k in keys})
    owns = sorted(set(keys))
    return spark.createDataFrame([(owns.index(k) + 1, 1000 + langs.index(k[0]), *map(float, v)) for k, v in zip(keys, x)], SCHEMA), {k: owns.index(k) + 1 for k in owns}


def unpacked(model):
    mean = np.array([model[f"m{i}"] for i in range(Q.DIM)])
    inverse = np.zeros((Q.DIM, Q.DIM))
    for i, j in Q.PAIRS:
        inverse[i, j] = inverse[j, i] = model[f"p{i}_{j}"]
    return mean, inverse


def plain_models(own, lang, x):
    """The regularised minimum covariance determinant of each group without bins, step by step: distances sorted, moments of the nearest."""
    groups = {("own", o): own == o for o in set(own.tolist())} | {("lang", g): lang == g for g in set(lang.tolist())} | {("all", 0): np.ones(len(x), bool)}
    up = {("own", o): ("lang", lang[own == o][0].item()) for o in set(own.tolist())} | {("lang", g): ("all", 0) for g in set(lang.tolist())} | {("all", 0): None}
    size = {g: rows.sum() for g, rows in groups.items()}

    def regular(raw, g):
        mean, cov = raw[g]
        if up[g] is None:
            return mean, cov
        other, wide = regular(raw, up[g])
        w = size[g] / (size[g] + Q.PRIOR)
        return w * mean + (1 - w) * other, w * cov + (1 - w) * wide + w * (1 - w) * np.outer(mean - other, mean - other)

    def distances(raw, g):
        mean, cov = regular(raw, g)
        d = x[groups[g]] - mean
        return np.einsum("ni,ij,nj->n", d, np.linalg.inv(Q.floored(cov)), d)

    best = {}
    for start in (0, 1):
        raw = {}
        for g, rows in groups.items():
            own_x = x[rows]
            low, mid, high = np.quantile(own_x, (0.25, 0.5, 0.75), axis=0, method="inverted_cdf")
            raw[g] = (mid, np.diag(((high - low) / 1.349) ** 2)) if start == 0 else (own_x.mean(0), np.cov(own_x.T, bias=True))
        spread = None
        while True:
            after = {}
            for g, rows in groups.items():
                own_x, d = x[rows], distances(raw, g)
                weight = np.clip(Q.HALF * len(d) - np.arange(len(d)), 0, 1)
                own_x = own_x[np.argsort(d, kind="stable")]
                mean = (weight[:, None] * own_x).sum(0) / weight.sum()
                after[g] = mean, (weight[:, None] * own_x).T @ own_x / weight.sum() - np.outer(mean, mean)
            fall = {g: np.linalg.slogdet(Q.floored(after[g][1]))[1] for g in groups}
            if spread is None:
                raw, spread = after, fall
                continue
            better = [g for g in groups if fall[g] + Q.LOWER < spread[g]]
            if not better:
                break
            for g in better:
                raw[g], spread[g] = after[g], fall[g]
        for g in groups:
            if g not in best or spread[g] < best[g][0]:
                best[g] = spread[g], raw[g]
    raw = {g: b[1] for g, b in best.items()}
    scale = {g: max(0.0, np.log(np.sort(distances(raw, g))[int(np.ceil(size[g] / 2)) - 1] / Q._chi(0.0))) for g in groups}
    smooth = lambda g: scale[g] if up[g] is None else (size[g] * scale[g] + Q.PRIOR * smooth(up[g])) / (size[g] + Q.PRIOR)
    return {o: (*regular(raw, ("own", o)), np.exp(smooth(("own", o))) * Q._chi(Q.CUT)) for o in set(own.tolist())}


def test_estimate_equals_moments_of_the_nearest_half(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(3, 1, (900, Q.DIM)), rng.normal(30, 0.5, (200, Q.DIM))])
    model = Q.models(table_of(spark, [("en", "s")] * len(x), x)[0]).first()
    mean, inverse = unpacked(model)
    assert np.abs(mean - 3).max() < 0.25  # a fifth of outliers doesn't move it
    d = np.einsum("ni,ij,nj->n", x - mean, inverse, x - mean)
    assert (d[:900] <= model.cut).mean() > 0.995 and (d[900:] > model.cut).all()


def test_whole_table_against_a_plain_estimate(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = Q.judge(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").toPandas()
    stats = Q.statistics(docs).select("doc_id", *(c.alias(n) for n, c in zip(Q.X, Q._vector()))).toPandas().set_index("doc_id").loc[got.doc_id]
    used = ~got.base_failed.to_numpy()
    x, own, lang = stats.to_numpy()[used], got.groupby(["lang", "source"]).ngroup().to_numpy()[used], got.groupby("lang").ngroup().to_numpy()[used]
    want = plain_models(own, lang, x)
    distance, cut = np.empty(len(x)), np.empty(len(x))
    for o, (mean, cov, c) in want.items():
        d = x[own == o] - mean
        distance[own == o], cut[own == o] = np.einsum("ni,ij,nj->n", d, np.linalg.inv(Q.floored(cov)), d), c
    kept, ratio = got.kept.to_numpy()[used], got.distance.to_numpy()[used] / distance
    assert len(want) > 60 and np.abs(np.log(ratio)).mean() < 0.05
    clear = np.abs(np.log(distance / cut)) > 0.2
    assert clear.mean() > 0.9 and (kept == (distance <= cut))[clear].all() and 0 < (~kept).sum() < len(kept)


def test_estimates_of_skewed_groups_equal_plain_ones(spark):
    """Many groups of sizes from 1 to 1,500 with means, spreads and outliers of their own."""
    rng = np.random.default_rng(6)
    keys, x = [], []
    for g, n in enumerate((1500, 400, 150, 60, 20, 6, 2, 1, 1)):
        centre, wide = rng.normal(3, 1, Q.DIM), rng.uniform(0.3, 2, Q.DIM)
        own = centre + rng.normal(0, 1, (n, Q.DIM)) * wide
        own[: n // 8] += 15
        keys += [("en" if g % 2 else "de", f"s{g}")] * n
        x.append(own)
    x = np.vstack(x)
    table, number = table_of(spark, keys, x)
    got = {r.own: r for r in Q.models(table).collect()}
    own, lang = np.array([number[k] for k in keys]), np.array([k[0] == "en" for k in keys])
    want = plain_models(own, lang, x)
    assert set(got) == set(want)
    for o, (mean, cov, cut) in want.items():
        m, inverse = unpacked(got[o])
        assert np.abs(m - mean).max() < 0.15 and abs(np.linalg.slogdet(inverse)[1] + np.linalg.slogdet(Q.floored(cov))[1]) < 0.5 and abs(np.log(got[o].cut / cut)) < 0.15, o


def test_verdicts(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = Q.judge(base).join(labels, "doc_id", "left").toPandas()
    assert len(got) == base.count()
    assert not got[got.base_failed].kept.any()
    fine = got[~got.base_failed]
    assert fine[fine.quality == 1].kept.mean() > 0.99 and fine[fine.quality == 0].kept.mean() < 0.05


def test_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None, None, 1.0), (None, "a b", "en", None, 2.0), (2, "w v " * 60, None, "s", 0.0), (2, "w v " * 60, None, "s", 0.0)], "doc_id long, text string, lang string, source string, cut double")
    assert sorted((str(r.doc_id), r.n_words, r.base_failed, r.kept) for r in Q.judge(docs).collect()) == [("1", 0, True, False), ("2", 120, True, False), ("2", 120, True, False), ("None", 2, True, False)]
    assert Q.judge(docs.limit(0)).count() == 0
    words = [f"w{i}" for i in range(70)]
    long = " ".join(f"w{i}x{i % 977}" for i in range(400_000))  # with nulls in each key, and one text that is very long
    rows = [(i, " ".join(words[i % 9 :]), (None, "en")[i % 2], (None, "s")[i // 2 % 2]) for i in range(40)] + [(99, long, None, None), (99, long, None, None)]
    got = Q.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert len(got) == 42 and all(r.kept and r.cut > 0 for r in got if r.doc_id < 99) and len({(r.kept, r.n_words) for r in got if r.doc_id == 99}) == 1


def test_small_groups_lean_on_their_whole_language(spark):
    rng = np.random.default_rng(2)
    keys = [("en", "large")] * 900 + [("en", "small")] * 20 + [("de", "other")] * 280 + [("en", "lone"), ("fr", "lone")]
    x = np.vstack([rng.normal(3, 1, (1200, Q.DIM)), np.full((2, Q.DIM), 30.0)])
    table, number = table_of(spark, keys, x)
    got = {r.own: r for r in Q.models(table).collect()}
    assert len(got) == 5
    assert np.abs(unpacked(got[number["en", "small"]])[0] - 3).max() < 0.3
    for key in (("en", "lone"), ("fr", "lone")):  # however bad, a lone document doesn't judge itself
        mean, inverse = unpacked(got[number[key]])
        assert np.abs(mean - 3).max() < 1 and (30 - mean) @ inverse @ (30 - mean) > got[number[key]].cut


def test_weight_of_a_group_grows_smoothly(spark):
    """The mean of a group that lies elsewhere moves from its language's to its own with its size; there's no size at which it jumps."""
    rest = np.random.default_rng(3).normal(0, 1, (1500, Q.DIM))
    sizes = (5, 50, 199, 200, 201, 600)
    keys = [(f"l{n}", of) for n in sizes for of in ["rest"] * len(rest) + ["own"] * n]
    table, number = table_of(spark, keys, np.vstack([part for n in sizes for part in (rest, np.full((n, Q.DIM), 2.0))]))
    got = {r.own: r.m0 for r in Q.models(table).collect()}
    means = [got[number[f"l{n}", "own"]] for n in sizes]
    assert all(b > a - 1e-6 for a, b in zip(means, means[1:])) and means[4] - means[2] < 0.05 and means[0] < 0.4 < 1.6 < means[-1]


def test_each_statistic_alone_can_reject(spark):
    rng = np.random.default_rng(4)
    usual = np.array([1.8, 0, 0, 0, 0.95, 1.35])
    x = usual + rng.normal(0, 1, (1000, Q.DIM)) * [0.03, 0, 0, 0, 0.14, 0.12]
    model = Q.models(table_of(spark, [("en", "s")] * len(x), x)[0]).first()

    def passes(**own):
        d = np.array([own.get(c, u) for c, u in zip(Q.X, usual)]) - [model[f"m{i}"] for i in range(Q.DIM)]
        return sum((1 if i == j else 2) * model[f"p{i}_{j}"] * d[i] * d[j] for i, j in Q.PAIRS) <= model.cut

    rate = lambda percent: float(np.log1p(percent))
    for planted in ({"x0": 2.3}, {"x1": rate(3)}, {"x2": rate(50)}, {"x3": rate(30)}, {"x4": rate(40)}, {"x5": rate(40)}, {"x2": rate(90), "x3": rate(50)}):
        assert not passes(**planted), planted
    assert passes() and passes(x1=rate(0.5)) and passes(x2=rate(15), x3=rate(12))
