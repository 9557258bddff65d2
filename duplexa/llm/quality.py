"""Quality rules: robust multivariate outliers among text statistics, by language and source.

Each document gives rates (word length, symbols, duplicate lines, repeated words, capitals, punctuation), transformed by logarithms. For each language and source the minimum covariance determinant is sought by concentration
steps: distances under the current mean and covariance, then mean and covariance of the HALF nearest documents, from two starts (medians and quartiles; plain moments). A step's result is taken while it makes a
determinant smaller; steps end when none does. The smaller determinant of the two wins, and documents whose Mahalanobis distance under it is too large are rejected.

One rule holds for groups of all sizes: the estimate is regularised (the minimum regularised covariance determinant). A group's language takes part in it like PRIOR documents more, and all documents take part in that of a
language in the same way; so the weight of a group's own documents, n / (n + PRIOR), grows smoothly, and a lone document is judged by its language. Languages and the whole are estimated from all their documents.

A step is one distributed aggregation: counts and moments per group and logarithmic bin of the distance. So all documents take part at any size, the largest group is never brought together, and what is solved per group
is at most BINS rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import forget, settle, slices

#: Share of a group's documents whose spread is made smallest.
HALF = 0.75
#: Documents that a group's language, or the whole of a language, counts for in its estimate.
PRIOR = 100.0
#: A step is taken while it lowers the logarithm of a determinant by more than this.
LOWER = 0.01
#: Standard normal score of the cut, by the Wilson-Hilferty form of the chi-squared distribution.
CUT = 3.7
#: Least standard deviation that counts, by statistic; only what an estimate lacks of it is put on. The cut is about 5.3 of them, so that each statistic alone can pass it: in a group that has none, 2% symbols, 39% duplicate
#: lines or 24% repeated words do.
FLOORS = np.array((0.06, 0.2, 0.8, 0.7, 0.4, 0.35))
DIM = len(FLOORS)
#: What is lacking in two statistics correlates so much: repeated lines repeat their words, so the two say less together than twice.
TOGETHER = np.eye(DIM)
TOGETHER[2, 3] = TOGETHER[3, 2] = 0.5
BINS = 400

SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
PUNCTUATION = np.array([i < 128 and chr(i).isprintable() and not chr(i).isalnum() and chr(i) != " " for i in range(256)])
LINES = K.byte_class("\n")
LEAD = (np.arange(256) & 0xC0) != 0x80

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks")


def _within(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[offsets - offsets[0]])


def counts_of(column: pa.Array) -> list[np.ndarray]:
    """COUNTS of each text; a null text is empty."""
    offsets, data = K.text_bytes(column)
    part = data[offsets[0] : offsets[-1]]
    start, end, hashes, begins = K.words(offsets, data, K.SPACED)
    n_words = np.diff(begins)
    chars = _within(LEAD[part] & K.SPACED[part], offsets)
    low, high, line, first = K.words(offsets, data, LINES)
    solid = np.zeros(len(part) + 1, np.int64)
    np.cumsum(K.SPACED[part], out=solid[1:])
    real = solid[high - offsets[0]] > solid[low - offsets[0]]  # lines with a word
    kept = np.zeros(len(line) + 1, np.int64)
    np.cumsum(real, out=kept[1:])
    n_lines = np.diff(kept[first])
    _, distinct = K.shingle_sets(line[real], kept[first], 1)
    runs, at = K.windows(hashes, begins, 3)
    owner = np.repeat(np.arange(len(n_words)), np.diff(at))
    with np.errstate(over="ignore"):
        _, place, times = np.unique(K.mix(runs + owner.astype(np.uint64) * K.STEP), return_inverse=True, return_counts=True)
    again = np.flatnonzero(times[place] > 1)
    covered = np.zeros(len(hashes), bool)
    where = again - at[owner[again]] + begins[owner[again]]
    for j in range(3):
        covered[where + j] = True
    repeats = np.zeros(len(hashes) + 1, np.int64)
    np.cumsum(covered, out=repeats[1:])
    return [n_words, chars, _within(SYMBOLS[part], offsets), n_lines - np.diff(distinct), np.diff(repeats[begins]), n_lines, _within(UPPER[part], offsets), _within(PUNCTUATION[part], offsets)]


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS, a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), batch.column("source"), *(pa.array(c) for c in counts_of(batch.column("text")))], names=["doc_id", "lang", "source", *COUNTS])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}")


def _vector() -> list[Column]:
    words, chars, lines = (F.greatest(F.col(c), F.lit(1)) for c in ("n_words", "word_chars", "n_lines"))
    rate = lambda c, of: F.log1p(100.0 * F.col(c) / of)
    return [F.log1p(F.col("word_chars") / words), rate("n_symbols", chars), rate("n_dup_lines", lines), rate("n_repeat_words", words), rate("n_upper", chars), rate("n_marks", chars)]


X = [f"x{i}" for i in range(DIM)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
MOMENTS = [f"s{i}" for i in range(DIM)] + [f"s{i}_{j}" for i, j in PAIRS]
#: A raw estimate: documents, ln determinant, mean and covariance.
RAW = ["n", "spread", *(f"m{i}" for i in range(DIM)), *(f"c{i}_{j}" for i, j in PAIRS)]
RAW_SCHEMA = "grp long, start int, " + ", ".join(f"{c} double" for c in RAW)
#: What a distance takes: mean and inverse.
MODEL = [f"m{i}" for i in range(DIM)] + [f"p{i}_{j}" for i, j in PAIRS]


def _moments() -> list[Column]:
    return [F.count("*").alias("n"), *(F.sum(F.col(x)).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}_{j}") for i, j in PAIRS)]


def _distance() -> Column:
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + (1 if i == j else 2) * F.col(f"p{i}_{j}") * (F.col(f"x{i}") - F.col(f"m{i}")) * (F.col(f"x{j}") - F.col(f"m{j}"))
    return F.greatest(total, F.lit(0.0))


def _bin(distance: Column) -> Column:
    """Eight bins to a doubling of the squared distance."""
    return F.least(F.greatest(F.floor(8 * F.log2(distance + 1e-9)) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")


def floored(cov: np.ndarray) -> np.ndarray:
    """Covariances (any number of them) with what their variances lack of FLOORS put on."""
    lack = np.sqrt(np.maximum(np.square(FLOORS) - np.diagonal(cov, axis1=-2, axis2=-1), 0))
    return cov + lack[..., :, None] * lack[..., None, :] * TOGETHER


def blended(weight: np.ndarray, mean: np.ndarray, cov: np.ndarray, other_mean: np.ndarray, other_cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of a mixture, weight being the first part's."""
    apart, w = mean - other_mean, weight[..., None, None]
    return weight[..., None] * mean + (1 - weight[..., None]) * other_mean, w * cov + (1 - w) * other_cov + w * (1 - w) * apart[..., :, None] * apart[..., None, :]


def _chi(score: float) -> float:
    return DIM * (1 - 2 / (9 * DIM) + score * np.sqrt(2 / (9 * DIM))) ** 3


def _solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Raw estimates from sums of moments over h documents."""
    for rows in batches:
        h, m = np.maximum(rows["h"].to_numpy(float), 1e-9), rows[MOMENTS].to_numpy(float)
        mean, cov = m[:, :DIM] / h[:, None], np.empty((len(rows), DIM, DIM))
        for k, (i, j) in enumerate(PAIRS):
            cov[:, i, j] = cov[:, j, i] = m[:, DIM + k] / h - mean[:, i] * mean[:, j]
        spread = np.linalg.slogdet(floored(cov))[1] if len(rows) else h
        yield pd.DataFrame(np.column_stack([rows["grp"], rows["start"]]), columns=["grp", "start"]).join(pd.DataFrame(np.column_stack([rows["n"], spread, mean, *(cov[:, i, j] for i, j in PAIRS)]), columns=RAW))


def _concentrated(binned: DataFrame) -> DataFrame:
    """The next estimates, from moments by group, start and bin of the distance under the last: those of the HALF nearest, a bin's share of them where it is cut."""
    own = Window.partitionBy("grp", "start")
    before = F.coalesce(F.sum("n").over(own.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shares = binned.withColumns({"total": F.sum("n").over(own), "before": before}).withColumn("share", F.least(F.greatest((HALF * F.col("total") - F.col("before")) / F.col("n"), F.lit(0.0)), F.lit(1.0)))
    sums = shares.groupBy("grp", "start").agg(F.max("total").cast("double").alias("n"), F.sum(F.col("n") * F.col("share")).alias("h"), *(F.sum(F.col(c) * F.col("share")).alias(c) for c in MOMENTS))
    return sums.mapInPandas(_solved, RAW_SCHEMA)


def _quantiles(histogram: DataFrame, keys: list[str], value: str, shares: tuple[float, ...]) -> DataFrame:
    """keys, n and q0, q1 ..: the least value up to which these shares of a group's documents lie, from a table of keys, value and n."""
    own = Window.partitionBy(*keys)
    upto = histogram.withColumns({"total": F.sum("n").over(own), "upto": F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))})
    return upto.groupBy(*keys).agg(F.max("total").cast("double").alias("n"), *(F.min(F.when(F.col("upto") >= q * F.col("total"), F.col(value))).alias(f"q{k}") for k, q in enumerate(shares)))


def _first(histogram: DataFrame) -> DataFrame:
    """The starting estimates from medians and quartiles, by histograms of each statistic (grp, i, value in 32nds, n), as moments of as many documents."""
    at = _quantiles(histogram, ["grp", "i"], "value", (0.25, 0.5, 0.75)).select("grp", "i", "n", (F.col("q1") / 32).alias("mid"), ((F.col("q2") - F.col("q0")) / 32 / 1.349).alias("deviation"))
    wide = at.groupBy("grp").agg(F.max("n").alias("n"), *(F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}{i}") for i in range(DIM) for c in ("mid", "deviation")))
    moment = lambda i, j: F.col(f"mid{i}") * F.col(f"mid{j}") + (F.col(f"deviation{i}") * F.col(f"deviation{i}") if i == j else 0.0)
    return wide.select("grp", F.lit(0).alias("start"), "n", F.lit(1.0).alias("h"), *(F.col(f"mid{i}").alias(f"s{i}") for i in range(DIM)), *(moment(i, j).alias(f"s{i}_{j}") for i, j in PAIRS)).mapInPandas(_solved, RAW_SCHEMA)


def _with_parents(table: DataFrame, tree: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """table with the columns of a group's parent (b_) and that one's (c_) beside its own (a_), null where there is none."""
    own = table.select("grp", *keys, *(F.col(c).alias(f"a_{c}") for c in columns)).join(tree, "grp")
    for prefix, up in (("b", "up"), ("c", "top")):
        own = own.join(table.select(F.col("grp").alias(up), *keys, *(F.col(c).alias(f"{prefix}_{c}") for c in columns)), [up, *keys], "left")
    return own


def _regular(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean and inverse of each group's regularised estimate, from raw ones of it and its parents."""
    for rows in batches:
        n = len(rows)
        mean, cov = np.zeros((n, DIM)), np.zeros((n, DIM, DIM))
        for prefix in "cba":
            raw = rows[[f"{prefix}_{c}" for c in RAW]].to_numpy(float)
            own = np.zeros((n, DIM, DIM))
            for k, (i, j) in enumerate(PAIRS):
                own[:, i, j] = own[:, j, i] = raw[:, 2 + DIM + k]
            there, known = ~np.isnan(raw[:, 0]), cov.any((1, 2)) | mean.any(1)
            weight = np.where(known, raw[:, 0] / (raw[:, 0] + PRIOR), 1.0)
            new_mean, new_cov = blended(weight, raw[:, 2 : 2 + DIM], own, mean, cov)
            mean[there], cov[there] = new_mean[there], new_cov[there]
        inverse = np.linalg.inv(floored(cov)) if n else cov
        yield pd.concat([rows[["grp", "start"]].reset_index(drop=True), pd.DataFrame(np.column_stack([mean, *(inverse[:, i, j] for i, j in PAIRS)]), columns=MODEL)], axis=1)


def _cuts(table: DataFrame, tree: DataFrame) -> DataFrame:
    """grp and cut: the chi-squared quantile at CUT, scaled by how far distances spread in the group and its parents, weighted as the estimates are."""
    wide, scale = _with_parents(table, tree, ["n", "scale"], []), F.lit(None).cast("double")
    for prefix in "cba":
        n, own = F.col(f"{prefix}_n"), F.col(f"{prefix}_scale")
        scale = F.coalesce((n * own + PRIOR * scale) / (n + PRIOR), own, scale)
    return wide.select("grp", (F.exp(scale) * float(_chi(CUT))).alias("cut"))


def models(rows: DataFrame, lower: float = LOWER) -> DataFrame:
    """own (the hash of a language and source), MODEL and cut of each, from a settled table of own, its language's hash in_lang, and the vectors X."""
    members = settle(rows.select("own", "in_lang").distinct().select("own", "in_lang", F.explode(F.array("own", "in_lang", F.lit(0).cast("long"))).alias("grp")))
    whole, own = F.lit(0).cast("long"), F.col("grp") == F.col("own")
    tree = settle(members.select("grp", F.when(own, F.col("in_lang")).when(F.col("grp") != 0, whole).alias("up"), F.when(own, whole).alias("top")).distinct())

    def rolled(df: DataFrame, *keys: str) -> DataFrame:
        """Sums by group of what was summed by language and source."""
        return df.join(members.drop("in_lang"), "own").groupBy("grp", *keys).agg(*(F.sum(c).alias(c) for c in df.columns if c not in ("own", *keys)))

    def regular(raw: DataFrame) -> DataFrame:
        return _with_parents(raw, tree, RAW, ["start"]).mapInPandas(_regular, "grp long, start int, " + ", ".join(f"{c} double" for c in MODEL))

    def binned(model: DataFrame, *what: Column) -> DataFrame:
        by_own = settle(members.drop("in_lang").join(model, "grp"))
        return rows.join(by_own, "own").withColumn("bin", _bin(_distance())).groupBy("grp", "start", "bin").agg(*what)

    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.round(F.col(x) * 32).cast("int").alias("value")) for i, x in enumerate(X))))
    histogram = rows.select("own", values.alias("v")).groupBy("own", "v.i", "v.value").agg(F.count("*").alias("n"))
    medians = _first(rolled(histogram, "i", "value"))
    plain = rolled(rows.groupBy("own").agg(*_moments())).select("*", F.lit(1).alias("start"), F.col("n").alias("h")).mapInPandas(_solved, RAW_SCHEMA)
    raw = settle(medians.union(plain).withColumn("new", F.lit(0)))
    first = True
    while first or raw.where("new = 1").limit(1).count():
        step = _concentrated(binned(regular(raw), *_moments())).withColumn("new", F.lit(1))
        if first:  # the starts are no estimates of the nearest: what they lead to is taken as it is
            after = settle(step)
        else:
            best = F.min_by(F.struct(*RAW, "new"), F.struct(F.col("spread") + lower * F.col("new"), "new"))
            after = settle(raw.withColumn("new", F.lit(0)).union(step).groupBy("grp", "start").agg(best.alias("x")).select("grp", "start", "x.*"))
        forget(raw)
        raw, first = after, False
    chosen = settle(raw.groupBy("grp").agg(F.min_by(F.struct(*RAW), F.struct("spread", "start")).alias("x")).select("grp", F.lit(0).alias("start"), "x.*"))
    model = settle(regular(chosen))
    middle = _quantiles(binned(model, F.count("*").alias("n")), ["grp"], "bin", (0.5,))
    # ln of the middle squared distance against that of the chi-squared distribution
    scales = settle(middle.select("grp", "n", F.greatest(F.lit(0.0), float(np.log(2.0)) * (F.col("q0") - BINS // 2 + 0.5) / 8 - float(np.log(_chi(0.0)))).alias("scale")))
    return settle(model.drop("start").join(_cuts(scales, tree), "grp").join(members.where("grp = own").select("grp", "own"), "grp").drop("grp"))


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance (squared) and cut (both null for one that no group's estimate judges), a row for each row of docs.

    A null or empty text has no words and fails the base rule. Documents that fail it take no part in the estimates, and are judged by one only where other documents of their language and source make it. Null languages and sources are
    groups like others; repeated rows count each. Other columns are ignored.
    """
    stats = statistics(docs).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    groups = (F.xxhash64(F.lit("s"), "lang", "source", F.col("lang").isNull()).alias("own"), F.xxhash64(F.lit("l"), "lang").alias("in_lang"))
    stats = settle(stats.select("doc_id", *COUNTS[:5], "base_failed", *groups, *(x.alias(name) for name, x in zip(X, _vector(), strict=True))))
    known = models(stats.where("not base_failed").select("own", "in_lang", *X))
    judged = stats.join(known, "own", "left").withColumn("distance", F.when(F.col("cut").isNotNull(), _distance()))
    return judged.select("doc_id", *COUNTS[:5], "base_failed", (~F.col("base_failed") & F.coalesce(F.col("distance") <= F.col("cut"), F.lit(True))).alias("kept"), "distance", "cut")
