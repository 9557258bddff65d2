import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duplexa.llm.packing import CAPACITY, END, TOKENIZER, Encoder, differencing, digests, pack, sequences, windows_of, with_fillers

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def encoder():
    return Encoder(public_tokenizers.path(TOKENIZER))


def plain(encoder, text):
    return encoder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_tokens_equal_those_of_whole_texts(encoder):
    rng = random.Random(3)
    letters = list("ab\'sStTŚ\u0308\u0301é \t\n\x0b\x0c\r\x1c\x85\xa0\u3000Σς<|>1٣!.,-\u200d👍🏽\u0338=")
    texts = ["a b", "it's don't'S", "é ,", "ΣΑΣ ΌΣ", "<|endoftext|>x<|startoftext|>", "x<|ENDOFTEXT|>", None, "", "  ", "a\x00b", "==\u0338", "x" * 3000, "İ ß ﬁ 1234"]
    texts += ["".join(rng.choices(letters, k=40)) for _ in range(2000)]
    for column in (pa.array(texts), pa.array(["cut", *texts]).slice(1)):
        ids, at = encoder.encode(column)
        for i, text in enumerate(texts):
            assert plain(encoder, text) == ids[at[i] : at[i + 1]].tolist(), repr(text)


def test_regions_and_a_full_memory_change_nothing(encoder, monkeypatch):
    from duplexa.llm import kernels, packing

    texts = ["one two, three's " * 40, "", "x" * 500, "four\n" * 99]
    want, at = encoder.encode(pa.array(texts))
    monkeypatch.setattr(kernels, "REGION", 64)
    monkeypatch.setattr(packing, "PIECES", 1)
    small = Encoder(public_tokenizers.path(TOKENIZER))
    for _ in range(2):
        ids, begins = small.encode(pa.array(texts))
        assert ids.tolist() == want.tolist() and begins.tolist() == at.tolist()


def test_differencing():
    assert sorted(sum([4, 5, 6, 7, 8][i] for i in w) for w in differencing([4, 5, 6, 7, 8], 2)) == [14, 16]  # the known result of two-way differencing
    rng = random.Random(5)
    for n, windows in ((1, 1), (2, 3), (40, 7), (300, 40), (500, 3)):
        sizes = [rng.randint(1, 4096) for _ in range(n)]
        found = differencing(sizes, windows)
        assert sorted(i for w in found for i in w) == list(range(n)) and len(found) <= windows
        if n == 500:
            loads = [sum(sizes[i] for i in w) for w in found]
            assert max(loads) - min(loads) < 100
    assert differencing([], 0) == [] and windows_of([]) == []


def test_windows_rise_until_all_fits():
    found = windows_of([3000] * 5)  # four windows would do by their sum
    assert len(found) == 5 and all(len(w) == 1 for w in found)
    rng = random.Random(6)
    sizes = [rng.randint(1, 4096) for _ in range(2048)]
    parts = with_fillers(sizes)
    assert sorted({i for i, _, _ in parts}) == list(range(2048))
    for i, size in enumerate(sizes):
        own = sorted((at, n) for j, at, n in parts if j == i)
        assert sum(n for _, n in own) == size and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False))
    found = windows_of([n for _, _, n in parts])
    assert max(sum(parts[k][2] for k in w) for w in found) <= CAPACITY
    assert len(found) * CAPACITY < 1.012 * sum(sizes)


def whole(rows, want):
    """rows hold each id of the wanted documents (lists of ids by doc_id) in one piece, sequences are gapless and within the capacity."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == want.keys()
    for doc_id, pieces in by_doc.items():
        at, ids = 0, want[doc_id]
        for r in sorted(pieces, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            own = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert bytes(r.ids) == own if "ids" in r else r.ids_crc32 == zlib.crc32(own)
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= CAPACITY
    return len(by_sequence)


def test_whole_table(spark, encoder):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = {r.doc_id: plain(encoder, r.text) + [END] for r in docs.collect()}
    rows = digests(pack(docs.repartition(3))).collect()
    n = whole(rows, want)
    assert n * CAPACITY < 1.1 * sum(map(len, want.values()))  # three small groups
    packed = pack(docs)
    got = sequences(packed).collect()
    assert all(len(s.ids) == 4 * (s.n_tokens if bin(s.n_tokens).count("1") == 1 else CAPACITY) for s in got)
    assert sum(s.n_tokens for s in got) == sum(map(len, want.values()))
    first = {(r.sequence_id, r.offset): r for r in packed.collect()}
    for s in got[:20]:
        joined = b"".join(bytes(first[k].ids) for k in sorted(first) if k[0] == s.sequence_id)
        assert bytes(s.ids)[: len(joined)] == joined and not any(bytes(s.ids)[len(joined) :])


def test_odd_rows(spark, encoder):
    long = "word, " * 30_000
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n", "z"), (None, "a b", None), (4, long, "x"), (5, "same", "x"), (5, "same", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string").withColumn("ids", F.lit(1)).withColumn("sequence_id", F.lit("s"))
    got = pack(docs.coalesce(1)).collect()
    assert sum(r.doc_id == 5 for r in got) == 2 and len({r.sequence_id for r in got if r.doc_id == 5}) >= 1
    want = {1: [END], 2: [END], 3: [END], None: [*plain(encoder, "a b"), END], 4: [*plain(encoder, long), END]}
    rest = [r for r in got if r.doc_id != 5]
    by_doc = defaultdict(int)
    for r in rest:
        by_doc[r.doc_id] += r.length
    assert by_doc == {k: len(v) for k, v in want.items()}
    full = [r for r in got if r.doc_id == 4 and r.length == CAPACITY]
    assert len(full) == len(want[4]) // CAPACITY and all(r.offset == 0 for r in full)
    assert pack(docs.where("false")).collect() == []
    assert [r.doc_id for r in pack(docs.where("doc_id < 5 or doc_id is null"), end=None).select("doc_id").distinct().orderBy("doc_id").collect()] == [None, 4]
    assert dict(digests(pack(docs)).dtypes)["ids_crc32"] == "bigint"
