"""Language identification by averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent in numpy, with calibrated rejection.

A text's features are the byte 3-grams and 4-grams of its words (with a mark at either end) and the whole words, hashed into BUCKETS rows of an embedding table; the text is their mean, and a linear
layer with softmax tells languages apart. Where there are no more languages than dimensions the two layers are multiplied out for prediction, so that a feature costs one row of a bucket-by-language table.

Training reads a bounded sample, at most TRAIN_ROWS labelled texts, evenly many per language, each whole. Every fifth isn't trained on, but calibrates two things: the temperature of the probabilities, against targets
smoothed by the sample's size, and rejection. A softmax can't know a stranger, as it shares all mass among what it has learned; so rejection rests on a text's familiarity, the mean log frequency of its features
in the training texts. It is standardised by the language told and the number of features (whole calibration texts and pieces of them give mean and spread at each length), and a text is rejected under the score
that REJECT of texts like the training ones stay under, by an exponential tail through the lowest of the calibration texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import slices

BUCKETS = 1 << 16
DIMENSIONS = 16
#: Labelled texts that are read for training and calibration; of each come at most BUCKETS distinct features to the driver.
TRAIN_ROWS = 4000
#: Features of all of them and of their pieces, at 3 to 6 bytes each (see packed), as bounded by the lengths of texts: the sample ends before it has more.
TRAIN_FEATURES = 32_000_000
EPOCHS = 4
RATE = 0.5
#: Share of texts in learned languages that calibration lets go.
REJECT = 0.0001
#: Share of the calibration texts whose scores make the tail.
TAIL = 0.05
#: Features of the pieces of calibration texts.
PIECES = (8, 32, 128, 512)
#: Frequency of a feature that was never seen, in texts.
UNSEEN = 1e-5
UNKNOWN = "und"

_FEATURE = np.uint64(0xC2B2AE3D27D4EB4F)


def _lower(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts with the capitals of Latin-1 (two bytes, C3 and 80 to 9E but for the times sign) as small letters."""
    low = int(offsets[0])
    data, offsets = data[low : int(offsets[-1])], offsets - low
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    if len(second):
        data = data.copy()
        data[second] += 0x20
    return offsets, data


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of whole texts, and where each text's begin. Digits and ASCII punctuation are no part of words; A-Z count as a-z, and the capitals of Latin-1 as its small letters."""
    offsets, data = _lower(*K.text_bytes(column))
    start, end, hashes, begins = K.words(offsets, data, LETTERS, K.FOLDED)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    # all words one after another, each with a mark in front and behind
    length = end - start
    at = np.zeros(len(start) + 1, np.int64)
    np.cumsum(length + 2, out=at[1:])
    body = np.ones(at[-1] + 3, np.uint64)
    place = np.ones(at[-1], bool)
    place[at[:-1]] = place[at[1:] - 1] = False
    inside = np.flatnonzero(place)
    body[inside] = K.FOLDED[data[inside - np.repeat(at[:-1] + 1 - start, length)]]
    with np.errstate(over="ignore"):
        three = body[:-2] + body[1:-1] * K.STEP + body[2:] * (K.STEP * K.STEP)
        four = K.mix(three[:-1] + body[3:] * (K.STEP * K.STEP * K.STEP) + np.uint64(4))
        three = K.mix(three + np.uint64(3))
    # an n-gram may not pass a word's last mark: of a word of m bytes (m + 2 with marks) there are m 3-grams and m - 1 4-grams
    n = 2 * length  # m + (m - 1) + the word
    put = np.zeros(len(start) + 1, np.int64)
    np.cumsum(n, out=put[1:])
    out = np.empty(put[-1], np.uint64)
    row = np.repeat(np.arange(len(start)), length)
    step = np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
    out[put[row] + step] = three[at[row] + step]
    cut = step < length[row] - 1
    out[put[row[cut]] + length[row[cut]] + step[cut]] = four[at[row[cut]] + step[cut]]
    out[put[1:] - 1] = hashes
    with np.errstate(over="ignore"):
        return ((out * _FEATURE) >> np.uint64(48)).astype(np.int64) % BUCKETS, put[begins]


LETTERS = K.byte_class("".join(chr(c) for c in range(128) if not chr(c).isalpha()))
ASCII_LETTER = LETTERS & (np.arange(256) < 128)


def held_out(doc_id: Column) -> Column:
    """Whether a document is one of those that training never sees; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def packed(ids: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Feature ids in two bytes each, and how often each in as few as the most frequent one takes."""
    assert BUCKETS <= 1 << 16
    return ids.astype("<u2").tobytes(), counts.astype(np.min_scalar_type(int(counts.max(initial=0)))).tobytes()


def unpacked(ids: pa.BinaryScalar, counts: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray]:
    """What was packed, as views of the table's memory."""
    ids, counts = np.frombuffer(ids.as_buffer(), "<u2"), counts.as_buffer()
    return ids, np.frombuffer(counts, f"<u{counts.size // max(len(ids), 1) or 1}")


def _sampled(docs: DataFrame, rows: int) -> list[tuple[str, bool, np.ndarray, np.ndarray]]:
    """(label, whether a piece, distinct features, how often) of the training sample and of pieces of its texts, in an order that doesn't depend on partitions.

    Texts are chosen by a random number times the frequency of their language, the smallest first: so each language has about as many. Only languages and keys are shuffled for that; texts stay where they are read and
    are met by the chosen keys, of which there are at most `rows`, and fewer where long texts have TRAIN_FEATURES before. Rows that repeat an id, a language and a text count once.
    """
    usable = docs.where("text is not null and lang is not null").where(~held_out(F.col("doc_id"))).select("lang", "text", F.xxhash64(F.lit(3), "doc_id", "text").alias("key"))
    most = F.least(F.lit(BUCKETS).cast("long"), 2 * F.octet_length("text").cast("long")) + sum(PIECES)
    keys = usable.select(F.col("lang").alias("of"), "key", most.alias("most"))
    keys = keys.groupBy("of", "key").agg(F.max("most").alias("most"))
    counts = keys.groupBy("of").agg(F.count("*").alias("n_lang"))
    chance = F.pmod(F.col("key"), F.lit(1 << 40)) / F.lit(float(1 << 40)) * F.col("n_lang")
    first = keys.join(counts, "of").select("of", "key", chance.alias("rank"), "most").orderBy("rank", "key", "of").limit(rows).toArrow()
    within = np.cumsum(first.column("most").to_numpy()) <= TRAIN_FEATURES
    if not within.any():
        return []
    picked = docs.sparkSession.createDataFrame([tuple(r.values()) for r in first.select(["of", "key", "rank"]).slice(0, int(within.sum())).to_pylist()], "of string, picked long, rank double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                ids, at = features(batch.column("text"))
                out = []
                for i, (lang, key, rank) in enumerate(zip(batch.column("lang").to_pylist(), batch.column("key").to_pylist(), batch.column("rank").to_pylist(), strict=True)):
                    own = ids[at[i] : at[i + 1]]
                    cuts = [(key >> 8) % (len(own) - n + 1) for n in PIECES if n < len(own)]
                    for piece, part in enumerate((own, *(own[c : c + n] for c, n in zip(cuts, PIECES, strict=False)))):
                        out.append((lang, key, rank, piece, *packed(*np.unique(part, return_counts=True))))
                for low in range(0, len(out), 256):
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out[low : low + 256]], schema=arrow)

    names = ("lang", "key", "rank", "piece", "ids", "counts")
    arrow = pa.schema(list(zip(names, (pa.string(), pa.int64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()), strict=True)))
    chosen = usable.join(F.broadcast(picked), (F.col("lang") == F.col("of")) & (F.col("key") == F.col("picked"))).select("lang", "text", "key", "rank")
    found = chosen.mapInArrow(run, "lang string, key long, rank double, piece int, ids binary, counts binary").dropDuplicates(["lang", "key", "piece"]).orderBy("rank", "key", "lang", "piece").toArrow()
    return [(lang, piece > 0, *unpacked(ids, n)) for lang, piece, ids, n in zip(found.column("lang").to_pylist(), found.column("piece").to_pylist(), found.column("ids"), found.column("counts"), strict=True)]


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


class Model:
    """languages, a table of a row per bucket (embedding or scores, then log frequency), the linear layer where the table holds embeddings, a bias, the temperature, and per language the usual familiarity:
    mean, variance between texts and variance per feature, with the limit of the standardised one."""

    def __init__(self, languages: list[str], table: np.ndarray, weights: np.ndarray, bias: np.ndarray, familiar: np.ndarray):
        if len(languages) <= len(weights):
            table, weights = table @ weights, None
        self.languages, self.weights, self.bias = languages, weights, bias.astype(np.float64)
        self.table = np.ascontiguousarray(np.column_stack([table, familiar]), np.float32)
        self.temperature, self.limit = 1.0, -np.inf
        self.usual = np.tile([[0.0], [1.0], [0.0]], len(languages))

    def scores(self, ids: np.ndarray, at: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Uncalibrated scores by language, and familiarity, of texts that have at least one feature each."""
        rows = self.table[ids]
        if counts is not None:
            rows = rows * counts[:, None].astype(np.float32)
        n = np.diff(at) if counts is None else np.add.reduceat(counts, at[:-1])
        mean = np.add.reduceat(rows, at[:-1], axis=0).astype(np.float64) / n[:, None]
        return (mean[:, :-1] if self.weights is None else mean[:, :-1] @ self.weights) + self.bias, mean[:, -1]

    def standard(self, familiar: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Familiarity against what is usual for the language told and so many features."""
        mean, between, within = self.usual[:, best]
        return (familiar - mean) / np.sqrt(between + within / n)


def _flat(texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of all, where each text's begin, how often each, and the number of each text's."""
    at = np.cumsum([0, *(len(x[0]) for x in texts)])
    return np.concatenate([x[0] for x in texts], dtype=np.int32), at, np.concatenate([x[1] for x in texts], dtype=np.int32), np.array([x[1].sum(dtype=np.int64) for x in texts])


def fit(sample: list[tuple[str, bool, np.ndarray, np.ndarray]], seed: int = 1) -> Model | None:
    """None without a labelled text that has a feature."""
    sample = [x for x in sample if len(x[2])]
    if not sample:
        return None
    languages = sorted({x[0] for x in sample})
    place = {x: i for i, x in enumerate(languages)}
    whole = np.cumsum([not x[1] for x in sample]) - 1  # the text that a piece is of
    held = whole % 5 == 4
    texts = [(x[2], x[3]) for x in sample]
    y = np.array([place[x[0]] for x in sample])
    train = np.array([i for i, x in enumerate(sample) if not x[1] and not held[i]])
    rng = np.random.default_rng(seed)
    table, weights, bias = rng.normal(0, 0.1, (DIMENSIONS, BUCKETS)).astype(np.float32), np.zeros((DIMENSIONS, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    steps, step = EPOCHS * -(-len(train) // 32), 0
    for _ in range(EPOCHS):
        order = rng.permutation(train)
        for low in range(0, len(order), 32):
            rows = order[low : low + 32]
            rate = RATE * (1 - step / steps)
            step += 1
            ids, at, counts, n = _flat([texts[r] for r in rows])
            mean = (np.add.reduceat(table[:, ids] * counts.astype(np.float32), at[:-1], axis=1) / n).T
            error = _softmax(mean @ weights + bias)
            error[np.arange(len(rows)), y[rows]] -= 1
            back = rate * 16 * (error @ weights.T) / n[:, None]
            weights -= rate * (mean.T @ error).astype(np.float32)
            bias -= rate * 0.1 * error.sum(0).astype(np.float32)
            owner = np.repeat(np.arange(len(rows)), np.diff(at))
            for d in range(DIMENSIONS):  # each text's features move by its own step; repeated ones add up
                table[d] -= np.bincount(ids, back[owner, d] * counts, BUCKETS).astype(np.float32)
    seen = np.zeros(BUCKETS)
    for r in train:  # one after another, as all at once take five times their memory
        ids, counts = texts[r]
        seen[ids] += counts / counts.sum(dtype=np.int64)  # each text counts as one
    model = Model(languages, table.T, weights, bias, np.log((seen + UNSEEN) / (len(train) + UNSEEN * BUCKETS)))
    if held.any():
        _calibrate(model, [texts[i] for i in np.flatnonzero(held)], y[held], np.array([x[1] for x in sample])[held])
    return model


def _calibrate(model: Model, texts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, piece: np.ndarray) -> None:
    """Set the temperature, the usual familiarity and the limit from texts, and pieces of texts, that weren't trained on."""
    parts = [_flat(texts[low : low + 64]) for low in range(0, len(texts), 64)]
    n = np.concatenate([x[3] for x in parts])
    z, familiar = (np.concatenate(x) for x in zip(*(model.scores(*x[:3]) for x in parts), strict=True))
    whole = np.flatnonzero(~piece)
    # a target of 1 would have no best temperature where all are told right
    size = len(whole)
    target = np.full((size, len(model.languages)), 1 / (size + 2) / max(len(model.languages) - 1, 1))
    target[np.arange(size), y[whole]] = (size + 1) / (size + 2)
    grid = np.geomspace(1e-4, 1e2, 241)
    losses = [-(target * np.log(np.maximum(_softmax(z[whole] / t), 1e-300))).sum(1).mean() for t in grid]
    model.temperature = float(grid[int(np.argmin(losses))]) if len(model.languages) > 1 else 1.0
    best = z.argmax(1)
    # squared deviations are a part that each text has and one that shrinks with its features; few texts of a language lean on all
    slope = lambda d, m: np.linalg.lstsq(np.column_stack([np.ones(len(m)), 1 / m]) / (1 + 1 / np.sqrt(m))[:, None], d / (1 + 1 / np.sqrt(m)), rcond=None)[0]
    spread = float(familiar.std()) ** 2 + 1e-3
    means = np.array([(familiar[best == c].sum() + familiar.mean()) / ((best == c).sum() + 1) for c in range(len(model.languages))])
    shared = np.maximum(slope(np.square(familiar - means[best]), n), [1e-3 * spread, 0.0]) if len(n) > 2 else np.array([spread, 0.0])
    for c in range(len(model.languages)):
        own = best == c
        k = own.sum()
        fitted = np.maximum(slope(np.square(familiar[own] - means[c]), n[own]), [1e-3 * spread, 0.0]) if k > 2 else shared
        model.usual[:, c] = means[c], *((k * fitted + 20 * shared) / (k + 20))
    score = np.sort(model.standard(familiar, best, n))
    upto = max(1, int(np.ceil(TAIL * len(score))))
    edge = score[min(upto, len(score) - 1)]
    model.limit = float(edge - ((edge - score[:upto]).sum() + 0.5) / (upto + 1) * np.log(TAIL / REJECT))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Fit on labelled documents that aren't held out; lang, source and doc_id serve to choose and label them, never as inputs."""
    return fit(_sampled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")), rows))


def _guesses(model: Model | None, column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    ids, at = features(column)
    n = np.diff(at)
    lang, score, rejected = [UNKNOWN] * len(n), np.zeros(len(n)), np.ones(len(n), bool)
    full = n > 0
    if full.any():  # beyond ASCII not all is a letter
        offsets, data = K.text_bytes(column)
        plain = np.zeros(int(offsets[-1] - offsets[0]) + 1, np.int64)
        np.cumsum(ASCII_LETTER[data[offsets[0] : offsets[-1]]], out=plain[1:])
        for i in np.flatnonzero(full & (np.diff(plain[offsets - offsets[0]]) == 0)):
            full[i] = any(map(str.isalpha, column[int(i)].as_py()))
    if model and full.any():
        some = np.flatnonzero(n > 0)
        z, familiar = model.scores(ids, np.append(at[some], len(ids)))
        best = z.argmax(1)
        over = model.standard(familiar, best, n[some]) - model.limit
        score[some] = _softmax(z / model.temperature).max(1) * np.exp(np.minimum(over, 0))
        rejected[some] = over < 0
        for i, b in zip(some, best, strict=True):
            if full[i]:
                lang[i] = model.languages[b]
        score[~full], rejected[~full] = 0.0, True
    return lang, score, rejected


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the calibrated probability, less the further a rejected text lies under the limit; 0 to 1) and rejected, a row for each row of docs; the model is trained on docs unless given.

    A text whose features are too strange for the language told is rejected, whatever its probability; a mix of learned languages isn't strange. Of two languages that share all features nothing tells a text apart; it gets
    one of them. Repeated rows are texts of their own. Fewer than five labelled texts calibrate nothing: then no text with a letter is rejected. A null text or one without a letter is `und` with score 0 and rejected; so is any text if nothing could be learned. Other columns are ignored.
    """
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                lang, score, rejected = _guesses(shared.value, batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score), pa.array(rejected)], names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def drop_rejected(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose text identify doesn't reject."""
    model = model or train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                yield batch.filter(pa.array(~_guesses(shared.value, batch.column("text"))[2]))

    return docs.mapInArrow(run, docs.schema)
