import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from duplexa.llm import near_dedup as N
from duplexa.llm.components import components


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def groups(rows):
    """Sizes, and the smallest id that each id reaches over links of 85 % or more, by counting all common shingles."""
    sets = {i: shingles(t) for i, t in rows}
    where, up = defaultdict(list), {i: i for i in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in where[s])
        for j, c in common.items():
            if 100 * c >= 85 * (len(sets[i]) + len(sets[j]) - c):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
        for s in sets[i]:
            where[s].append(i)
    return {i: len(s) for i, s in sets.items()}, {i: top(i) for i in sets}


def check(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, key string").repartition(5)
    got = {r.doc_id: r for r in N.near_duplicates(docs, **options).collect()}
    sizes, tops = groups(rows)
    assert {i: r.n_shingles for i, r in got.items()} == sizes
    assert {i: r.component_id for i, r in got.items()} == tops
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_real_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(spark, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_one_large_group_of_near_copies(spark):
    """Copies of one text, altered in 0 to 9 words: many are linked with each other or over others, many with none."""
    rng = random.Random(2)
    base = [f"w{rng.randrange(500)}" for _ in range(150)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.randrange(10)):
            words[rng.randrange(150)] = rng.choice(["a", "b", f"n{rng.randrange(9)}"])
        rows.append((1000 - i, " ".join(words)))
    check(spark, rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "one two"), (5, "One\nTWO"), (6, "one two three"), (7, "a b c d e"), (8, "A b  c d e "), (9, "a b c d e f"), (10, "x\x1cy"), (11, "é É")]
    check(spark, rows)
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "q"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in N.near_duplicates(docs).collect())
    assert got == [("1", "1", True), ("1", "1", True), ("2", "1", False), ("None", "1", False), ("None", "None", False)]
    assert sorted(str(r.doc_id) for r in N.keep_one(docs).collect()) == ["1", "1", "None", "None"]
    assert N.near_duplicates(docs.limit(0)).count() == 0


def test_blocks_do_not_matter(spark):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(60)]
    texts = spark.createDataFrame([(i, " ".join(w if rng.random() > 0.02 else "z" for w in base)) for i in range(60)], "id long, text string")
    stars = texts.where("id > 0").selectExpr("id a", "0L b")
    checked = N.settle(N.confirm(stars, texts))
    found = components(checked.where("linked").select("a", "b"))
    links = [N.loose_links(checked, found, texts, block=b) for b in (1 << 20, 130)]
    one, many = ({(r.node, r.component) for r in components(checked.where("linked").select("a", "b").union(x)).collect()} for x in links)
    assert one == many and one
    sets = {r.id: N.sets_of(pa.array([r.text]))[0] for r in texts.collect()}
    for a, b in {(r.a, r.b) for x in links for r in x.collect()}:
        common = len(np.intersect1d(sets[a], sets[b]))
        assert 100 * common >= N.PERCENT * (len(sets[a]) + len(sets[b]) - common)


def test_mutual_copies_off_their_hub_give_a_forest(spark):
    """800 texts alike that aren't like their hub: n - 1 links at most leave the tasks of each pair of blocks."""
    base = [f"w{k}" for k in range(80)]
    rows = [(0, " ".join(base[:40]))] + [(i, " ".join([*base, f"x{i}"])) for i in range(1, 801)]
    texts = spark.createDataFrame(rows, "id long, text string")
    stars = texts.where("id > 0").selectExpr("id a", "0L b")
    checked = N.settle(N.confirm(stars, texts))
    found = components(checked.where("linked").select("a", "b"))
    assert found.count() == 0
    links = N.loose_links(checked, found, texts).collect()
    assert len(links) <= 799
    got = components(spark.createDataFrame([(r.a, r.b) for r in links], "a long, b long")).collect()
    assert {r.node for r in got} == set(range(1, 801)) and {r.component for r in got} == {1}


def test_forests_join_what_links_join():
    rng = random.Random(2)
    for n in (1, 5, 40):
        for _ in range(30):
            component = np.array([rng.randrange(n) for _ in range(n)])
            links = sorted({(a, b) for a in range(n) for b in range(a) if component[a] != component[b] and rng.random() < 0.1})
            i, j = (np.array([x[k] for x in links], np.int64) for k in range(2))
            a, b = N._forest(component, i, j)

            def joined(pairs):
                lab = component.copy()
                for x, y in pairs:
                    lab[lab == lab[x]] = lab[y]
                return {frozenset(np.flatnonzero(lab == v).tolist()) for v in lab}

            assert joined(zip(a, b, strict=True)) == joined(links) and len(a) < max(1, len(set(component.tolist())))
            assert set(zip(a.tolist(), b.tolist(), strict=True)) <= set(links)


def test_signatures_estimate_without_bias():
    rng = np.random.default_rng(0)
    equal = []
    for _ in range(40):
        both = rng.integers(0, 2**63, 300, dtype=np.uint64)
        a, b = np.sort(np.r_[both, rng.integers(0, 2**63, 50, dtype=np.uint64)]), np.sort(np.r_[both, rng.integers(0, 2**63, 50, dtype=np.uint64)])
        x, y = N.band_keys(np.r_[a, b], np.array([0, 350, 700]))
        equal.append((x == y).mean())
    assert np.mean(equal) == pytest.approx(0.75**N.ROWS, abs=0.05)


def test_words_of_cut_texts_hash_alike(monkeypatch):
    from duplexa.llm import kernels as K

    texts = pa.array(["alpha beta " * 50, None, "gamma" * 30 + " d", "x", "", "é ö " * 40])
    offsets, data = K.text_bytes(texts)
    whole = K.words(offsets, data, K.SPACED)
    monkeypatch.setattr(K, "REGION", 64)
    parts = K.words(offsets, data, K.SPACED)
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(None, 3), (7, 7)]
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: top(x) for x in up}


@pytest.mark.parametrize("step", [1, -1])
def test_a_long_chain_takes_few_rounds(spark, monkeypatch, step):
    from duplexa.llm import components as C

    seeds, rank = set(), C._rank
    monkeypatch.setattr(C, "_rank", lambda seed, node: seeds.add(seed) or rank(seed, node))
    nodes = list(range(1000))[::step]
    got = {r.node: r.component for r in components(spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")).collect()}
    assert got == dict.fromkeys(range(1000), 0) and len(seeds) <= 15


def test_no_table_of_a_past_round_stays(spark):
    import glob

    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(glob.glob(f"{folder}/*"))
    got = components(spark.createDataFrame([(i, i + 1) for i in range(50)], "a long, b long"))
    assert set(glob.glob(f"{folder}/*")) - before == {got.settled_at.removeprefix("file://")}


def test_products_of_blocks_count_what_is_common(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(N, "COLUMNS", 7)
    monkeypatch.setattr(N, "TEXTS", 5)
    sets = [sorted(rng.sample(range(40), rng.randrange(1, 12))) for _ in range(60)] + [[1, 2, 3], [1, 2, 3]]
    component = np.array([rng.randrange(6) for _ in sets])
    at = np.cumsum([0, *map(len, sets)])
    i, j = N._links_within(component, np.concatenate(sets).astype(np.uint64), at, 50)
    want = {(a, b) for a in range(len(sets)) for b in range(a) if component[a] != component[b] and 2 * len({*sets[a]} & {*sets[b]}) >= len({*sets[a]} | {*sets[b]})}
    assert set(zip(i.tolist(), j.tolist())) == want and want


def test_many_short_texts_round_one_hub_stay_small():
    """Two blocks of most texts: the matrices are of TEXTS squared, whatever the hub has."""
    import tracemalloc

    n = 2 * N.TEXTS
    sets = np.sort((np.arange(10) * 3 + np.random.default_rng(0).integers(0, 3, (n, 10))).astype(np.uint64), axis=1).ravel()
    tracemalloc.start()
    N._links_within(np.arange(n), sets, np.arange(0, 10 * n + 1, 10), 85)
    assert tracemalloc.get_traced_memory()[1] < 400 << 20
    tracemalloc.stop()


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    other = words.copy()
    for k in range(0, len(other), 4000):
        other[k] = "changed"
    docs = spark.createDataFrame([(5, " ".join(words)), (3, " ".join(other)), (4, " ".join(words[:60_000])), (9, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in N.near_duplicates(docs).collect()} == {5: 3, 3: 3, 9: 3, 4: 4}


def test_equals_sql(spark):
    import duckdb

    path = "/root/testdata/sf0.001/documents.parquet"
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{path}'")
    want = con.sql(N.SQL).df().sort_values("doc_id").reset_index(drop=True)
    own = N.near_duplicates(spark.read.parquet(path)).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert own[want.columns].equals(want)


def test_stars_about_their_smallest_ids_join_in_one_round(spark, monkeypatch):
    from duplexa.llm import components as C

    settled, plain = [], C.settle
    monkeypatch.setattr(C, "settle", lambda df: (settled.append(df), plain(df))[1])
    edges = [(hub + i, hub) for hub in (-7, 10_000, 20_000) for i in range(1, 3000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {a: b for a, b in edges} | {b: b for _, b in edges}
    assert len(settled) == 4  # three of the round and the result
