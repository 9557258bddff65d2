import pytest
import random
import re

from duplexa.llm import decontaminate as D

ITEMS = [
    (1, "On Monday the farmer Alice sold 12 kg of apples to Bob for 3.50 euros, then Alice gave 12 apples away and counted what was left over."),
    (2, "the entire lengthy passage of plain words without any slot stands here so that exact copies of it can be found again"),
    (3, "too short"),
    (None, "nothing to see in this line of text at all because it has no identifier whatsoever"),
    (4, None),
]
COPY = "It began so. On Monday the farmer Carol sold 7 kg of apples to David for 12.25 euros, then Carol gave 7 apples away and counted what was left over. And more."
WRONG = "On Monday the farmer Carol sold 7 kg of apples to David for 12.25 euros, then Erwin gave 9 apples away and counted what was left over."
DOCS = [
    (10, ITEMS[0][1], 0),
    (11, COPY, 0),
    (12, WRONG, 0),
    (13, "intro words\n" + ITEMS[1][1].upper() + " and a tail", 0),
    (14, "the entire lengthy passage of plain words without", 0),
    (15, None, 0),
    (16, "", 0),
    (17, "1 2 3 4 5 6 7 8 9 10 11 12 kg 13 kg " * 50, 0),
    (13, "another row of the same id", 0),
    (None, ITEMS[1][1], 0),
    (18, "word " * 30000 + ITEMS[1][1], 0),
]


def run(spark, docs=DOCS, items=ITEMS):
    docs = spark.createDataFrame(docs, "doc_id long, text string, item_id int")
    return docs, spark.createDataFrame(items, "item_id long, text string")


def test_copies_and_reparameterised_items_are_found(spark):
    got = {(r.doc_id, r.item_id): r for r in D.leaks(*run(spark)).collect()}
    assert set(got) == {(10, 1), (11, 1), (13, 2), (18, 2)}
    assert got[11, 1].reparameterised and not got[10, 1].reparameterised and got[11, 1].n_slots >= 7
    assert got[13, 2].share == 1.0 and got[13, 2].n_slots == 0


def test_filter_keeps_the_rest_with_all_columns(spark):
    docs, items = run(spark)
    kept = D.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["12", "14", "15", "16", "17", "None"]
    assert D.decontaminate(docs.limit(0), items).count() == 0
    assert D.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_words_align(spark):
    docs = spark.createDataFrame([("Mr Smith paid 1,200.50 dollars, and Anna 5km. McDonald's, 3 %",)], "text string")
    r = docs.select(D.raw_words(docs.text).alias("raw"), D.canonical_words(docs.text).alias("c")).first()
    assert len(r.raw) == len(r.c)
    assert dict(zip(r.raw, r.c))["1·200·50"] == "0" and dict(zip(r.raw, r.c))["Anna"] == "qname" and "qunit" in r.c


def test_against_brute_force_on_plain_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    words = lambda t: [w for w in re.split(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub(r"(?<=[a-zß-öø-ÿ,;] )[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?![^\W_])", "qname", t).lower()) if w]
    grams = {r.item_id: [tuple(w[i : i + 8]) for w in [words(r.text)] for i in range(len(w) - 7)] for r in items.collect()}
    want = set()
    for d in docs.collect():
        w = words(d.text)
        own = {tuple(w[i : i + 8]) for i in range(len(w) - 7)}
        want |= {(d.doc_id, i) for i, g in grams.items() if g and sum(x in own for x in g) >= 0.4 * len(g)}
    assert {(r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()} == want and want


def test_variants_in_one_document_are_judged_one_by_one(spark):
    sold = "On Monday the farmer {} sold {} kg of apples to {} for {} euros, then {} gave {} apples away and counted what was left over."
    fill = [("Alice", 12, "Bob", "3.50"), ("Carol", 7, "David", "12.25"), ("Erwin", 5, "Frank", "8.75"), ("Grete", 31, "Heinz", "99.10")]
    chapter = [sold.format(*f, f[0], f[1]) for f in fill]
    longer = COPY.replace("the farmer Carol", "the very old farmer Carol").replace("away and", "all away at last and")
    other = sold.format("Xaver", 3, "Yann", "1.10", "Zora", 4)
    docs = [(1, ITEMS[0][1] + " " + COPY, 0), (2, " ".join(chapter), 0), (3, WRONG + " " + other, 0), (4, WRONG + " " + COPY, 0), (5, ITEMS[0][1] + " " + longer, 0)]
    docs, items = run(spark, docs, [ITEMS[0], *((10 + i, t) for i, t in enumerate(chapter))])
    got = {r.doc_id: r for r in D.leaks(docs, items).collect()}  # all are one template
    assert set(got) == {1, 2, 4, 5} and {(r.item_id, r.n_items) for r in got.values()} == {(1, 5)}
    assert {(r.item_id, r.member) for r in D.members(items).collect()} == {(1, i) for i in (1, 10, 11, 12, 13)}
    assert got[1].exact_item == got[2].exact_item == 1 and got[4].exact_item == 11 and not any(r.reparameterised for r in got.values())


SOLD = "On Monday the farmer {} sold {} kg of apples to {} for {} euros, then {} gave {} apples away and counted what was left over."


def test_many_variants_of_one_template_are_one_row_a_document(spark):
    names = [a + b for a in ("Al", "Ber", "Cor", "Dan", "Ed") for b in ("a", "in", "ex", "us", "or", "ic")]
    fill = lambda k: SOLD.format(names[k % 30], k + 100, names[(k + 7) % 30], f"{k}.5", names[k % 30], k + 100)
    docs, items = run(spark, [(i, "Some intro. " + fill(i + 150) + f" tail {i}", 0) for i in range(300)], [(i, fill(i)) for i in range(300)])
    got = D.leaks(docs, items).collect()
    assert len(got) == 300 and {(r.item_id, r.n_items) for r in got} == {(0, 300)} and D.members(items).count() == 300
    for r in got:  # the first half are copies of items, the others of none
        assert (r.exact_item, r.reparameterised) == ((r.doc_id + 150, False) if r.doc_id < 150 else (None, True))


def test_short_items_and_such_full_of_numbers(spark):
    items = [
        (1, "which planet has the most known moons"), (2, "3 5 8 13 21 34 55 89 144 233"), (3, "name it"), (4, "Take 12 and 7 and 9, add 5 to 12 and 7, divide by 3 and 2."), (5, "?!"),
        (6, "then 4 8 15 16 23 42 more 4 8 15 16 23 42 less"), (7, "the year 1815 was good"),
    ]
    docs = [
        (1, "they ask: Which planet has the MOST known moons?", 0), (2, "which planet has the least known moons", 0), (3, "see 1 2 3 5 8 13 21 34 55 89 144 233 377", 0), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18", 0),
        (5, "Name it!", 0), (6, "you name it and go", 0), (7, "x Take 31 and 8 and 44, add 6 to 31 and 8, divide by 9 and 4. y", 0), (8, "x Take 31 and 8 and 44, add 6 to 99 and 77, divide by 9 and 4. y", 0), (9, "???", 0),
        (10, "then 4 8 15 16 23 42 more 4 8 15 16 23 42 less", 0), (11, "then 5 9 16 17 24 43 more 5 9 16 17 24 43 less", 0), (12, "the year 1816 was good", 0), (13, "and the year 1815 was good too", 0),
    ]
    got = {(r.doc_id, r.item_id) for r in D.leaks(*run(spark, docs, items)).collect()}
    assert got == {(1, 1), (3, 2), (5, 3), (7, 4), (10, 6), (13, 7)}


def test_a_long_piece_of_a_longer_item_is_found(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    piece = lambda n: "before " + " ".join(words[100 : 100 + n]) + " after"
    scattered = " ".join(" ".join(words[i : i + 9]) + " gap" for i in range(0, 90, 30))
    got = {r.doc_id for r in D.leaks(*run(spark, [(1, piece(100), 0), (2, piece(D.RUN), 0), (3, piece(D.RUN - 1), 0), (4, scattered, 0)], [(1, " ".join(words))])).collect()}
    assert got == {1, 2}


def plain_leaks(docs, items):
    """(doc, item) of all leaks of canonical templates with windows of WINDOW words, by looking at every pair of places."""

    def words(text):
        raw = re.findall(r"[0-9]+(?:[.,][0-9]+)*|[A-Za-z]+", text)
        out = []
        for i, w in enumerate(raw):
            if w[0].isdigit():
                out.append("0")
            elif i and w[0].isupper() and len(w) > 1 and re.search(r"[a-z,;] " + w, text):
                out.append("qname")
            elif i and raw[i - 1][0].isdigit() and w in ("kg", "euros"):
                out.append("qunit")
            else:
                out.append(w.lower())
        return out, [w.lower() for w in raw]

    slots = ("0", "qname", "qunit")
    found = set()
    for item_id, text in items:
        c, raw = words(text)
        places = [p for p in range(len(c) - 7) if sum(w not in slots for w in c[p : p + 8]) >= D.PLAIN]
        for doc_id, t, _ in docs:
            own, own_raw = words(t)
            hits = {(p, a - p) for p in places for a in range(len(own) - 7) if own[a : a + 8] == c[p : p + 8]}
            shifts = sorted({s for _, s in hits})
            runs, last = [], None
            for s in shifts:
                if last is None or s - last >= 8:
                    runs.append([])
                runs[-1].append(s)
                last = s
            for group, one in [(shifts, False)] + [(r, False) for r in runs] + [([s], True) for s in shifts]:
                inside = {(p, s) for p, s in hits if s in group}
                n = len({p for p, _ in inside})
                if n < D.SHARE * len(places) and not (one and n > D.RUN - 8):
                    continue
                pairs = {(c[p + k], raw[p + k], p + k + s) for p, s in inside for k in range(8) if c[p + k] in slots}
                forth, back, n_slots = {}, {}, {}
                for kind, value, at in pairs:
                    forth.setdefault((kind, value), set()).add(own_raw[at])
                    back.setdefault((kind, own_raw[at]), set()).add(value)
                    n_slots.setdefault((kind, value), set()).add(at)
                conflicts = sum(len(x) - 1 for x in [*forth.values(), *back.values()])
                if conflicts <= D.CONFLICTS * sum(map(len, n_slots.values())):
                    found.add((doc_id, item_id))
    return found


def test_slots_against_brute_force(spark):
    """Documents with templates filled consistently, with conflicts, cut, doubled and with words put in."""
    rng = random.Random(12)
    shapes = [SOLD, "Each of the two trains from {} to {} leaves at {} hours and the one from {} arrives {} hours later with {} tonnes of freight on board.", "A class of {} children and {} teachers buys {} tickets for {} euros so that {} and {} can go there as well."]
    names = ["Alice", "Bob", "Carol", "David", "Erwin"]
    kinds = [["name", "num", "name", "num", "name", "num"], ["name", "name", "num", "name", "num", "num"], ["num", "num", "num", "num", "name", "name"]]

    def fill(k, least):
        return shapes[k].format(*(rng.choice(names) if kind == "name" else rng.randint(least, least + 6) for kind in kinds[k]))

    items = [(i, fill(i % 3, 2)) for i in range(12)]
    docs = []
    for d in range(90):
        parts = [fill(rng.randrange(3), rng.choice((2, 40))) for _ in range(rng.randint(1, 3))]
        if rng.random() < 0.4:
            parts[0] = parts[0].replace(" and ", " and also ", 1)
        if rng.random() < 0.3:
            w = parts[-1].split(" ")
            parts[-1] = " ".join(w[: rng.randint(8, len(w))])
        docs.append((d, "plain words first, " + " so it goes on, ".join(parts), 0))
    table, bench = run(spark, docs, items)
    own = D.leaks(table, bench)
    got = {(r.doc_id, r.member) for r in own.join(D.members(bench), "item_id").collect()}
    want = plain_leaks(docs, items)
    assert got == want and 0 < len(want) < len(docs) * len(items) / 2
    assert own.where("n_slots > 0").count() > 20


def test_clashing_columns_and_nulls(spark):
    docs = spark.createDataFrame([(10, ITEMS[0][1], 1, "a", None), (None, None, None, None, None), (11, None, 2, None, "x")], "doc_id int, text string, _leak int, words string, template string")
    items = spark.createDataFrame([(*i, 3, None) for i in ITEMS], "item_id long, text string, key int, raw string")
    kept = D.decontaminate(docs, items)
    assert kept.schema == docs.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["11", "None"]
    assert D.leaks(docs, items.limit(0)).count() == D.members(items.limit(0)).count() == 0


def test_windows_that_all_items_share_bring_nothing_together(spark):
    """1,000 items with one opening and 1,000 documents that have just that: few rows, and an item is still found by its own windows."""
    import duplexa.llm.decontaminate as D

    opening = "please answer the following question with one of the options that are given below it"
    told = lambda i: "".join("abcdefghij"[int(c)] for c in f"{i:03}")
    own = lambda i: " ".join(f"{c}{told(i)}{c}" for c in "klmnopqrstuvwxyzkl")
    items = spark.createDataFrame([(i, f"{opening} {own(i)}") for i in range(1000)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{opening} and nothing else of {i} but chatter") for i in range(1000)] + [(5000, f"so {opening} {own(7)} end"), (5001, f"{own(8)}")], "doc_id long, text string")
    settled = []
    monkey = D.settle

    def counting(df):
        out = monkey(df)
        settled.append(out.count())
        return out

    D.settle = counting
    try:
        got = sorted((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect())
    finally:
        D.settle = monkey
    assert got == [(5000, 7), (5001, 8)]
    assert max(settled) < 60_000  # the table of windows itself, not documents times items


@pytest.mark.parametrize("share, run", [(0.4, 30), (0.1, 12), (0.9, 9), (1.0, 1000)])
def test_rarest_windows_lose_no_leak(spark, share, run, monkeypatch):
    import random

    import duplexa.llm.decontaminate as D

    rng = random.Random(run)
    vocabulary = [f"{a}{b}" for a in "bcdfg" for b in "aeiou"]
    items = [" ".join(rng.choices(vocabulary, k=rng.randrange(8, 40))) for _ in range(12)]
    items += [" ".join([*items[0].split()[:8], *rng.choices(vocabulary, k=12)]) for _ in range(3)] + [("x1 y2 " * 12).strip()]
    texts = []
    for _ in range(60):
        words = rng.choice(items).split()
        a = rng.randrange(len(words))
        part = words[a : a + rng.randrange(4, 40)]
        texts.append(" ".join([*rng.choices(vocabulary, k=5), *part, *rng.choices(vocabulary, k=5)]))
    docs, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = sorted(map(str, D.leaks(docs, bench, share, run).collect()))
    monkeypatch.setattr(D, "_rarest", lambda keyed, *_: keyed.select("key", "template").distinct())  # all windows instead
    assert got == sorted(map(str, D.leaks(docs, bench, share, run).collect()))
