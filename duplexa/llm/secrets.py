"""Secret scans: patterns of known kinds, and character Markov models of random strings and ordinary identifiers compared by log-likelihood ratio.

Both models are first-order over the characters of tokens, smoothed by transitions between classes of characters, from transitions that Spark counts in labelled samples; what the driver gets is a table of fixed size. Every fifth labelled token isn't counted: from
their ratios come the limits, in all and per character, over which a token is reported as random, unless it begins like a file in base 64. Under the ordinary model a ratio of ln(1 / FALSE) has a probability of FALSE at most; the limit is higher where an exponential
tail through the held-out ordinary tokens says so. Tokens of all lengths are looked at; it is their ratio that short ones lack.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .shared import slices

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]{24,}")
ALPHABET = "".join(map(chr, (*range(48, 58), *range(65, 91), *range(97, 123)))) + "+/_=-"
SIZE = len(ALPHABET) + 1  # and the start
#: Tokens are runs of ALPHABET.
TOKEN = K.byte_class("".join(chr(c) for c in range(128) if chr(c) not in ALPHABET)) & (np.arange(256) < 128)
#: Labelled samples of each class.
SAMPLES = 10_000
#: Least information of a random token, in bits under the model of random strings: what can be guessed is no secret.
BITS = 48.0
#: Share of ordinary tokens that may be taken for random.
FALSE = 1e-6
#: Weight of classes of characters in a transition: labelled samples have far fewer words than texts have.
SMOOTH = 0.2
#: Digits, capitals, small letters, each sign, the start.
_CLASS = np.zeros((9, SIZE))
_CLASS[0, :10] = _CLASS[1, 10:36] = _CLASS[2, 36:62] = 1
_CLASS[np.arange(3, 9), np.arange(62, 68)] = 1
#: Held-out ordinary tokens over this quantile make the tail.
TAIL = 0.01
#: Least length of held-out tokens whose ratio per character counts.
LONG = 16

#: Words that ordinary identifiers are made of.
WORDS = (
    "account action active add address admin all application array async attribute available backup base batch block body border bottom buffer build button byte cache callback cancel category change channel char check child class clear click client close code collection color column command comment commit component config connection content context control convert copy count create current custom data database date default delete description detail device dialog directory disable display document domain download draft edit element email empty enable encode end entry error event example execute export extend factory feature field file filter final find first flag folder font format forward frame from function gateway generate get global graph group handle handler header height hidden history home host icon identity image import index info init input insert instance interface internal invoice item job join key label language last layout left length level library license limit line link list listener load local location lock log main manager map mask match max menu merge message method model module monitor move name network next node not notification null number object offset open option order output package page panel parent parse password path pattern payment permission phone pixel player plugin pointer policy position post prefix price print process product profile progress project property provider public query queue random range read record refresh region register remove render repeat replace request reset resource response result return right role root route rule sample save scale schedule schema scope screen script search section select sender sequence server service session set shape share signal size sort source space start state status step stop storage store stream string style submit suffix support switch system table target task template test text theme thread time title toggle token tool total track transaction transfer trigger type unit update upload url user util valid value vector version video view visible warning widget width window worker wrapper write zone"
).split()


#: Common words of prose in four languages.
PROSE = (
    "about after again because before between could different during every first found great house know large little made might never other people place public school should small something still their there these thing think those three through under water where which while without world would years "
    "aber alle auch dass durch eine einem einen einer gegen haben heute ihre jahr kann kein leben machen mehr menschen nach nicht noch oder schon sehr sein sich sind stadt unter viel wenn werden wieder wird zeit zwischen "
    "alors apres aussi autre avant avec cette comme dans depuis deux donc elle encore entre faire grand homme jour leur mais monde notre nous plus pour quand sans sous temps toujours tout vous "
    "ahora ante antes aunque bien cada casa ciudad como contra cuando desde donde ellos entre entonces gente hacer hasta mismo mucho mundo nada nuestro otro para parte porque siempre sobre tiempo todo vida"
).split()
#: How image, document and archive files begin in base 64; tokens that begin so are files.
FILES = ("iVBORw0KGgo", "JVBERi0", "R0lGODlh", "R0lGODdh", "UEsDB", "/9j/", "H4sIA", "UklGR")
#: Rows of letters and keys.
ROWS = (ALPHABET[:10], ALPHABET[10:36], ALPHABET[36:62], ALPHABET[10:62], "qwertyuiopasdfghjklzxcvbnm", "1234567890")


def samples(spark: SparkSession, n: int = SAMPLES, seed: int = 11) -> DataFrame:
    """token and is_random: n random strings over usual alphabets, and n ordinary tokens and more: identifiers and paths of WORDS, prose, numbers and dates, rules and runs of each character, rows of letters, and names in hexadecimal digits."""
    rng = random.Random(seed)
    sets = (ALPHABET[:62], ALPHABET[:62] + "+/", ALPHABET[:62] + "-_", ALPHABET[:36])  # hexadecimal ones are names, or of a known kind
    rows = [("".join(rng.choices(rng.choice(sets), k=rng.randint(8, 64))), True) for _ in range(n)]
    styles = ("_".join, "-".join, "".join, "/".join, lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "".join(x.capitalize() for x in w), lambda w: "_".join(w).upper(), lambda w: "-".join(w).title())

    def identifier() -> str:
        return rng.choice(styles)(rng.choices(WORDS, k=rng.randint(1, 5))) + (str(rng.randint(1, 2030)) if rng.random() < 0.2 else "")

    def prose() -> str:
        words = rng.choices(PROSE, k=rng.choice((1, 1, 1, 2, 3)))
        return rng.choice((str, str.capitalize, str.upper))(rng.choice(("", "-")).join(words))

    def number() -> str:
        digits = lambda k: "".join(rng.choices("0123456789", k=k))
        dated = f"{rng.randint(1900, 2100)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
        return rng.choice((digits(rng.randint(1, 20)), dated, f"{dated}T{rng.randint(0, 23):02}", "-".join(digits(rng.choice((2, 3, 4))) for _ in range(rng.randint(2, 5))), f"v{rng.randint(0, 40)}", "/" + dated.replace("-", "/") + "/" + identifier()))

    def rule() -> str:
        run = rng.choice(ALPHABET[62:] if rng.random() < 0.7 else ALPHABET) * rng.randint(3, 80)
        return rng.choice((run, run, "+-" * rng.randint(2, 30), "=-" * rng.randint(2, 30), "+" + "-".join([run] * 2) + "+", run + identifier() + run))

    def row() -> str:
        keys = rng.choice(ROWS)
        keys = keys if rng.random() < 0.8 else keys[::-1]
        at = rng.randrange(len(keys) - 2)
        return (keys[at:] + keys)[: rng.randint(3, 40)]

    def path() -> str:
        return ("/" if rng.random() < 0.5 else "") + "/".join(identifier() for _ in range(rng.randint(2, 6)))

    def name() -> str:
        """A universally unique id, a digest in capitals, or an address or counter in such digits: names of things, without a secret in them."""
        hexes = lambda *sizes: "-".join("".join(rng.choices("0123456789abcdef", k=k)) for k in sizes)
        made = rng.choice((hexes(8, 4, 4, 4, 12), hexes(8, 4, 4, 4, 12), hexes(rng.choice((8, 12, 16, 20))), hexes(32), hexes(40), hexes(64), hexes(*[2] * 6), "urn/" + hexes(8, 4, 4, 4, 12)))
        return made.upper() if rng.random() < 0.4 else made

    kinds = (identifier, identifier, identifier, path, prose, prose, number, rule, row, name)
    rows += [(rng.choice(kinds)(), False) for _ in range(n)]
    rows += [(c * k, False) for c in ALPHABET for k in range(6, 78, 8)]
    return spark.createDataFrame(rows, "token string, is_random boolean")


class Model(NamedTuple):
    """SIZE by SIZE tables of log-likelihood ratios of transitions, random against ordinary, and of their information in bits in random strings; and the limits in all and per character."""

    table: np.ndarray
    bits: np.ndarray
    limit: float
    each: float


def transitions(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The tables from all tokens (token, is_random). Characters outside ALPHABET and null tokens are left out."""
    steps = labelled.select("is_random", F.explode(F.filter(F.transform(F.split(F.concat(F.lit(" "), "t"), ""), lambda c, i: F.struct(i.alias("i"), c.alias("c"))), lambda x: x["c"] != "")).alias("x"), "t")
    pairs = steps.where("x.i > 0").groupBy("is_random", F.expr("case when x.i = 1 then ' ' else substr(t, x.i - 1, 1) end").alias("a"), F.col("x.c").alias("b")).count()
    counts = np.zeros((2, SIZE, SIZE))
    place = {c: i for i, c in enumerate(ALPHABET)} | {" ": SIZE - 1}
    for r in pairs.collect():  # at most 2 * SIZE * SIZE rows
        counts[int(r.is_random), place[r.a], place[r.b]] += r["count"]
    # how often a character of one class follows one of another, shared evenly by the characters of the class
    by_class = np.einsum("ap,kpq,bq->kab", _CLASS, counts, _CLASS) + 1
    usual = np.einsum("ap,kab,bq->kpq", _CLASS, by_class / by_class.sum(2, keepdims=True), _CLASS / _CLASS.sum(1, keepdims=True))
    own = counts.sum(2, keepdims=True)
    logs = np.log(np.where(own > 0, (1 - SMOOTH) * counts / np.maximum(own, 1) + SMOOTH * usual, usual))
    return logs[1] - logs[0], -logs[1] / np.log(2.0)


def fit(labelled: DataFrame, false: float = FALSE) -> Model:
    """Transitions from four fifths of the labelled tokens, by a hash of the token, and limits from the others; without such the limit is the bound that holds under the model itself."""
    clean = labelled.where("token is not null and is_random is not null").select("is_random", F.regexp_replace("token", "[^A-Za-z0-9+/_=-]", "").alias("t"))
    held = F.pmod(F.xxhash64("t"), F.lit(5)) == 4
    table, bits = transitions(clean.where(~held))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column("t").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("is_random"), pa.array([ratio(table, t) for t in tokens]), pa.array(list(map(len, tokens)), pa.int64())], names=["is_random", "ratio", "n"])

    told = clean.where(held & (F.length("t") > 0)).mapInArrow(run, "is_random boolean, ratio double, n long")
    each, ordinary, long = F.col("ratio") / F.col("n"), ~F.col("is_random"), F.col("n") >= LONG
    # exact up to tables of the size of samples, and then within a ten-thousandth of the rank
    at = lambda which, column, share: F.percentile_approx(F.when(which, column), share, 10_000)
    edge, low, high = told.agg(at(ordinary, F.col("ratio"), 1 - TAIL), at(ordinary & long, each, 0.999), at(~ordinary & long, each, 0.01)).first()
    beyond = told.where(ordinary & (F.col("ratio") > F.lit(edge))).agg(F.avg(F.col("ratio") - F.lit(edge))).first()[0] if edge is not None else None
    bound = float(-np.log(false))
    limit = bound if edge is None else max(bound, edge + (beyond or 0.0) * float(np.log(TAIL / false)))
    return Model(table, bits, limit, 0.0 if low is None or high is None else max(0.0, (low + high) / 2))


_CODE = np.full(256, SIZE - 1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


def ratio(table: np.ndarray, token: str) -> float:
    codes = _CODE[np.frombuffer(token.encode(), np.uint8)]
    return float(table[SIZE - 1, codes[0]] + table[codes[:-1], codes[1:]].sum())


def tokens(column: pa.Array, model: Model, files: tuple[str, ...] = FILES) -> tuple[np.ndarray, list[list[tuple[int, int, int]]]]:
    """The largest ratio of a token of each text (0 without one), and the spans (start, place in KINDS, end) of random tokens in each."""
    offsets, data = K.text_bytes(column)
    low, files = int(offsets[0]), tuple(f.encode() for f in files)
    start, end, _, begins = K.words(offsets, data, TOKEN, None)
    best, found = np.zeros(len(column)), [[] for _ in range(len(column))]
    if not len(start):
        return best, found
    codes = _CODE[data[low : offsets[-1]]]
    bounds = np.column_stack([start, end]).ravel() - low

    def sums(table: np.ndarray) -> np.ndarray:
        steps = np.zeros(len(codes) + 1)
        steps[1:-1] = table[codes[:-1], codes[1:]]
        steps[start - low] = table[SIZE - 1, codes[start - low]]
        return np.add.reduceat(steps, bounds)[::2]

    scores = sums(model.table)
    full = np.flatnonzero(np.diff(begins))
    best[full] = np.maximum.reduceat(scores, begins[full])
    over = (scores >= model.limit) & (scores >= model.each * (end - start))
    random_ = np.flatnonzero(over & (sums(model.bits) >= BITS)) if over.any() else np.zeros(0, np.int64)
    if len(random_):
        points = K.code_points(offsets, data)
        text = np.searchsorted(offsets, start[random_], "right") - 1
        for t, a, b in zip(text.tolist(), start[random_] - low, end[random_] - low, strict=True):
            if not data[low + a : low + b].tobytes().startswith(files):
                zero = points[offsets[t] - low]
                found[t].append((int(points[a] - zero), 3, int(points[b] - zero)))
    return best, found


def patterns(text: str) -> list[tuple[int, int, int]]:
    """(start, place in KINDS, end) of all spans of known kinds, in order."""
    spans = []
    if ":" in text or "=" in text:
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def apart(spans: list[tuple[int, int, int]], random_: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """spans, and those random ones that overlap none of them."""
    # spans of a kind don't overlap, so what may overlap a token begins before its end; reach: the furthest end so far
    starts, reach = [s[0] for s in spans], np.maximum.accumulate([s[2] for s in spans]) if spans else []
    added = [r for r in random_ if not (before := int(np.searchsorted(starts, r[2]))) or reach[before - 1] <= r[0]]
    return sorted(spans + added)


def scan(docs: DataFrame, labelled: DataFrame | None = None, files: tuple[str, ...] = FILES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 (of the base spans as kind:start:end), spans (all of them, so written), n_random and score, a row for each row of docs.

    labelled: samples (token, is_random) to train from, by default samples(). files: how tokens begin that are files, which are never reported as random.
    score is 0 to 1, from the largest log-likelihood ratio of a token, 0.5 at the limit; 0 without a token. Null and empty texts have no spans; repeated rows are scanned one by one; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(samples(docs.sparkSession) if labelled is None else labelled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                best, random_ = tokens(batch.column("text"), model.value, files)
                counts, digests, lines = [], [], []
                for text, own in zip(batch.column("text"), random_, strict=True):
                    spans = apart(patterns(text.as_py() or ""), own)
                    told = [f"{KINDS[k]}:{a}:{b}" for a, k, b in spans]
                    counts.append([sum(s[1] == k for s in spans) for k in range(len(KINDS))])
                    digests.append(hashlib.sha256(",".join(t for t, s in zip(told, spans, strict=True) if s[1] < 3).encode()).hexdigest())
                    lines.append(",".join(told))
                scores = np.where(best == 0, 0.0, 1 / (1 + np.exp(-np.clip((best - model.value.limit) / 4, -500, 500))))
                n = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *n[:3], pa.array(digests, pa.string()), pa.array(lines, pa.string()), n[3], pa.array(scores)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long, score double")
