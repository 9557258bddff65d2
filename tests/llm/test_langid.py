import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from duplexa.llm import langid as L
from duplexa.llm import kernels as K


def test_features_are_the_grams_of_each_word():
    texts = ["abc Éa 12x", "", None, "a" * 5000]
    ids, at = L.features(pa.array(texts))

    def gram(codes, tag):
        with K.np.errstate(over="ignore"):
            v = K.np.uint64(0)
            f = K.np.uint64(1)
            for c in codes:
                v, f = v + c * f, f * K.STEP
            return int((K.mix(K.np.array([v + K.np.uint64(tag)])) * L._FEATURE >> K.np.uint64(48))[0]) % L.BUCKETS

    def of(word):
        codes = [K.np.uint64(1), *(K.FOLDED[b] for b in word.lower().encode()), K.np.uint64(1)]  # capitals of Latin-1 too
        return [gram(codes[i : i + k], k) for k in (3, 4) for i in range(len(codes) - k + 1)]

    want = of("abc") + of("Éa") + of("x")
    got = ids[at[0] : at[1]].tolist()
    words = ["abc", "Éa", "x"]
    for w in words:
        for g in of(w):
            assert g in got
    assert len(got) == len(want) + len(words)
    assert at[1] == at[2] == at[3] and at[4] - at[3] == 10000


def test_held_out_accuracy_and_fields(spark):
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = L.identify(base).join(base.select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == base.count()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.doc_id]).all()
    held = got[got.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert got.score.between(0, 1).all() and got.rejected.mean() <= 0.005


def test_labels_of_held_out_documents_are_never_used(spark):
    base = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    spoiled = base.withColumn("lang", F.when(L.held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    a, b = (L.identify(d).orderBy("doc_id").toPandas() for d in (base, spoiled))
    assert a.equals(b)


def test_texts_without_letters_are_unknown(spark):
    rows = [(i, "the of and there", "en", "s") for i in range(40)] + [(100, None, "en", "s"), (101, "", None, "s"), (102, "12 ** €", "en", "s"), (None, "the", None, None), (103, "中", "en", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = {r.doc_id: r for r in L.identify(docs).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3 and got[100].score == 0 and got[100].rejected
    assert got[None].lang_pred == got[103].lang_pred == "en" and not got[None].rejected and got[103].rejected
    kept = L.drop_rejected(docs)
    assert kept.schema == docs.schema and kept.count() == 41
    assert L.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in L.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


STRANGERS = [
    "Это предложение написано на русском языке и должно быть отвергнуто", "これは日本語の文章です。モデルはこれを拒否しなければなりません。", "이 문장은 한국어로 쓰여 있으며 모델은 그것을 모릅니다", "הטקסט הזה כתוב בעברית והמודל אינו מכיר אותו כלל",
    "asdkjh qwlekjh zxcmnb qpwoeiru tyghvbn xxzzq wqkjh lkjhqw mnbzxcv", "Zażółć gęślą jaźń i wszystkie polskie znaki w tym zdaniu które nie jest znane", "Tämä lause on kirjoitettu suomeksi eikä mallin pitäisi tuntea sitä lainkaan",
    "def main(argv): import sys; return [x for x in range(len(argv)) if argv[x].startswith('--') and not None]", "for (int i = 0; i < buf.length(); ++i) { printf(\"%s\", buf[i].c_str()); free(buf); }",
]


@pytest.fixture(scope="module")
def table():
    return pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text", "lang"])


def sample_of(table, without=None, each=600):
    """A sample as _sampled gives it, put together plainly."""
    rng, out, seen = np.random.default_rng(5), [], {}
    for row in table.to_pylist():
        if row["lang"] == without or zlib.crc32(str(row["doc_id"]).encode()) % 4 == 2 or seen.setdefault(row["lang"], 0) >= each:
            continue
        seen[row["lang"]] += 1
        own = L.features(pa.array([row["text"]]))[0]
        out.append((row["lang"], False, *np.unique(own, return_counts=True)))
        for n in L.PIECES:
            if n < len(own):
                c = int(rng.integers(len(own) - n + 1))
                out.append((row["lang"], True, *np.unique(own[c : c + n], return_counts=True)))
    return out


def test_strangers_are_rejected_and_mixtures_of_known_languages_are_not(table):
    model = L.fit(sample_of(table))
    assert 1e-4 < model.temperature < 1e2 and np.isfinite(model.limit)
    lang, score, rejected = L._guesses(model, pa.array(STRANGERS))
    assert rejected.all() and (score < 0.5).all() and set(lang) <= set(model.languages)
    by = {}
    for row in table.slice(0, 400).to_pylist():
        by.setdefault(row["lang"], []).append(row["text"])
    mixed = [a[:600] + " " + b[:600] for a, b in zip(by["en"], by["fr"])] + [a[:600] + " " + b[:600] for a, b in zip(by["de"], by["es"])]
    assert L._guesses(model, pa.array(mixed))[2].mean() <= 0.02


@pytest.mark.parametrize("left_out", ["de", "es", "fr"])
def test_a_language_left_out_of_training_is_rejected(table, left_out):
    model = L.fit(sample_of(table, left_out, 400))
    held = [r for r in table.to_pylist() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert L._guesses(model, pa.array([r["text"] for r in held if r["lang"] == left_out]))[2].mean() >= 0.9
    assert L._guesses(model, pa.array([r["text"] for r in held if r["lang"] != left_out]))[2].mean() <= 0.005


def test_scores_equal_plain_ones(table):
    """Averages, softmax, familiarity and the limit, feature by feature, for more languages than dimensions and for fewer."""
    texts = [r["text"][:300] for r in table.slice(0, 60).to_pylist()]
    for languages in (3, L.DIMENSIONS + 4):
        sample = [(f"l{i % languages:02}", False, *np.unique(L.features(pa.array([t]))[0], return_counts=True)) for i, t in enumerate(texts)]
        model = L.fit(sample)
        assert (model.weights is None) == (languages == 3)
        ids, at = L.features(pa.array(texts))
        z, familiar = model.scores(ids, at)
        for i in range(len(texts)):
            own = ids[at[i] : at[i + 1]].tolist()
            mean = sum(model.table[f].astype(float) for f in own) / len(own)
            want = mean[:-1] if model.weights is None else mean[:-1] @ model.weights
            assert np.allclose(z[i], want + model.bias, atol=1e-4) and np.isclose(familiar[i], mean[-1], atol=1e-3)
        seen = Counter()
        held = [i for i in range(len(texts)) if i % 5 == 4]
        for i in sorted(set(range(len(texts))) - set(held)):
            own = ids[at[i] : at[i + 1]].tolist()
            for f in own:
                seen[f] += 1 / len(own)
        total = len(texts) - len(held) + L.UNSEEN * L.BUCKETS
        assert np.allclose(model.table[:, -1], [np.log((seen[f] + L.UNSEEN) / total) for f in range(L.BUCKETS)], atol=1e-4)
        lang, score, rejected = L._guesses(model, pa.array(texts))
        for i in range(len(texts)):
            p = np.exp((z[i] - z[i].max()) / model.temperature)
            best = int(z[i].argmax())
            mean, between, within = model.usual[:, best]
            over = (familiar[i] - mean) / np.sqrt(between + within / (at[i + 1] - at[i])) - model.limit
            assert lang[i] == model.languages[best] and rejected[i] == (over < 0) and np.isclose(score[i], (p / p.sum()).max() * np.exp(min(over, 0)), atol=1e-4)


def test_training_steps_equal_plain_gradient_descent():
    """One language more than zero, few texts: every step redone with plain loops."""
    rng = np.random.default_rng(9)
    sample = [("ab"[i % 2], False, np.unique(rng.integers(0, 50, 6) + 50 * (i % 2)), None) for i in range(40)]
    sample = [(a, b, c, np.ones(len(c), int)) for a, b, c, _ in sample]
    train = [i for i in range(40) if i % 5 != 4]
    rng = np.random.default_rng(1)
    table, weights, bias = rng.normal(0, 0.1, (L.DIMENSIONS, L.BUCKETS)).astype(np.float32).T.astype(float), np.zeros((L.DIMENSIONS, 2)), np.zeros(2)
    step, steps = 0, L.EPOCHS * 1
    for _ in range(L.EPOCHS):
        rate = L.RATE * (1 - step / steps)
        step += 1
        moves, dw, db = [], np.zeros_like(weights), np.zeros(2)
        for i in rng.permutation(np.array(train)):
            own, y = sample[i][2], int(sample[i][0] == "b")
            mean = table[own].mean(0)
            p = np.exp(mean @ weights + bias)
            p /= p.sum()
            p[y] -= 1
            dw, db = dw + np.outer(mean, p), db + p
            moves.append((own, rate * 16 * (weights @ p) / len(own)))
        weights, bias = weights - rate * dw, bias - rate * 0.1 * db
        for own, move in moves:
            table[own] -= move
    model = L.fit(sample)
    assert np.allclose(model.table[:, :2], table @ weights, atol=1e-3) and np.allclose(model.bias, bias, atol=1e-4)


def test_long_and_repeated_texts(spark):
    long = "the quick and the slow of it " * 60000
    docs = spark.createDataFrame([(i, "the of and there it is quick and slow", "en", 0) for i in range(30)] + [(50, long, "en", 0), (50, long, "en", 0), (50, "der die das und nicht", "de", 0)], "doc_id long, text string, lang string, rejected int")
    got = L.identify(docs).collect()
    assert len(got) == 33 and [r.doc_id for r in got].count(50) == 3
    assert len({(r.lang_pred, r.score, r.rejected) for r in got if r.doc_id == 50 and r.lang_pred == "en"}) <= 2


def test_sample_is_even_and_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"text number {'abcdefghij'[i % 10]} of this {'klmno'[i % 5]}", "en" if i % 20 else "de") for i in range(2000)], "doc_id long, text string, lang string")
    shape = lambda s: [(a, b, c.tolist(), d.tolist()) for a, b, c, d in s]
    a, b = (L._sampled(docs.repartition(n), 100) for n in (3, 7))
    assert shape(a) == shape(b)
    whole = Counter(x[0] for x in a if not x[1])
    assert sum(whole.values()) == 100 and 30 <= whole["de"] <= 70


def test_the_sample_is_bounded_in_features_and_knows_no_repeats(spark, monkeypatch):
    rows = [(i, f"das ist ein text {i} " * 30, "de") for i in range(1, 40) if zlib.crc32(str(i).encode()) % 4 != 2]
    docs = spark.createDataFrame(rows + rows[:3] * 50, "doc_id long, text string, lang string")
    whole = L._sampled(docs, 1000)
    assert len([1 for _, piece, *_ in whole if not piece]) == len(rows)
    assert len(L._sampled(docs.repartition(5), 4)) == 4 * len(whole) // len(rows)
    most = 2 * len(rows[0][1]) + sum(L.PIECES)
    monkeypatch.setattr(L, "TRAIN_FEATURES", int(3.5 * most))
    bounded = L._sampled(docs, 1000)
    assert len([1 for _, piece, *_ in bounded if not piece]) == 3 and sum(len(ids) for _, _, ids, _ in bounded) <= L.TRAIN_FEATURES
    monkeypatch.setattr(L, "TRAIN_FEATURES", 10)
    assert L._sampled(docs, 1000) == []


def test_capitals_count_as_small_letters():
    texts = ["ÉTÉ À LA ÖÜ ÇA ÞÝ ×Ã", "été à la öü ça þý ×ã", "x", None]
    ids, at = L.features(pa.array(["before É", *texts]).slice(1))
    assert ids[at[0] : at[1]].tolist() == ids[at[1] : at[2]].tolist() and at[1] > 0


def test_the_sample_and_its_training_take_little_of_the_drivers_memory(spark):
    import tracemalloc

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    sample = L._sampled(docs, 4000)
    n = sum(len(x[2]) for x in sample)
    assert all(len(x[2]) == len(x[3]) and (np.diff(x[2].astype(int)) > 0).all() and x[3].min(initial=1) > 0 for x in sample)
    assert n > 100_000 and sum(x[2].nbytes + x[3].nbytes for x in sample) < 3.5 * n

    rng = np.random.default_rng(5)
    many = [(("en", "de")[i % 2], False, np.sort(rng.choice(L.BUCKETS, 8000, replace=False)).astype("<u2"), np.ones(8000, np.uint8)) for i in range(600)]
    tracemalloc.start()
    L.fit(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20  # all texts at once took five times the sample's 8 bytes a feature


def test_packed_features_come_back_as_they_were():
    for most in (1, 255, 256, 65_535, 65_536):
        ids, counts = np.array([0, 1, 32_768, L.BUCKETS - 1]), np.array([1, 2, 3, most])
        a, b = L.unpacked(*(pa.scalar(x, pa.binary()) for x in L.packed(ids, counts)))
        assert a.tolist() == ids.tolist() and b.tolist() == counts.tolist()
    a, b = L.unpacked(*(pa.scalar(x, pa.binary()) for x in L.packed(np.zeros(0, int), np.zeros(0, int))))
    assert len(a) == len(b) == 0
