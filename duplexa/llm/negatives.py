"""Hard negatives by a vector-approximation file.

Each component of a vector is quantised into one of CELLS cells of its dimension; cells are of equal width between two quantiles of a sample, and the two outermost reach to the least and largest value of all rows. A row's cells are a byte
a component. An inner product with an anchor lies between two bounds, which tables by cell give: each component adds the anchor's component times the cell's lower or upper edge, as its sign has it. Rows are held against anchors block by
block by these bounds alone; an exact score is only worked out for a row that may still enter an anchor's first positives, or one of its windows of negatives, given the bounds of the others and the best so far.

Two passes over the file: positives first, whose scores make the windows, then negatives. Rows are packed where they are read, so labels are no keys and a hot label is no hot task; blocks of rows meet blocks of anchors by a join on
group numbers, so that no side has to fit anywhere as a whole. Anchors are a fixed share of the rows, so the work grows with their product, as asked; what leaves a task is a few rows for each anchor it saw.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import settle

CELLS = 64
#: Share of a sample's values on each side that is left to the outermost cells, and rows of the sample, the first by a hash of their id. All rows are in the file; the sample only moves edges.
TAIL, SAMPLE = 0.005, 20_000
SCALE = 256
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is this percentage of the positive's at least and at most.
LEAST, MOST = 50, 95
#: Rows of a block, anchors of a block, and blocks of each that a join key brings together.
ROWS, ANCHORS = 4096, 256
ROW_BLOCKS, ANCHOR_BLOCKS = 64, 64
#: Anchors whose best rows a task holds before it gives them away.
HELD = 1 << 16


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and v (floor(SCALE * x) of each component) of rows (vec_id, label, embedding) that take part: all but those with a null id, label, vector or component, or one that isn't finite. Of rows that repeat an id the first by
    label and vector counts."""
    x = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.when(F.isnotnull(c) & ~F.isnan(c) & (F.abs(c) < float("inf")), F.floor(c * SCALE).cast("long")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("v")).where("vec_id is not null and label is not null and v is not null and not exists(v, c -> c is null)")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.label", "r.v")


def components(rows: DataFrame, tail: float = TAIL, sample: int = SAMPLE) -> np.ndarray:
    """A row for each dimension: the least value of all rows, two quantiles of the sample, the largest of all; rows that lack a component count as 0. Tasks give extremes; the driver gets one row a dimension, and the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), None)
            if x.size:
                columns = [np.arange(x.shape[1], dtype=np.int32), np.full(x.shape[1], len(x)), x.min(0), x.max(0)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["d", "n", "lo", "hi"])

    found = rows.select("v").mapInArrow(run, "d int, n long, lo long, hi long").groupBy("d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("d").collect()
    if not found:
        return np.zeros((0, 4))
    n = max(r.n for r in found)
    least, most = (np.array([f(getattr(r, k), 0) if r.n < n else getattr(r, k) for r in found], float) for f, k in ((min, "lo"), (max, "hi")))
    drawn = [r.v for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").collect()]
    some = np.array([v + [0] * (len(found) - len(v)) for v in drawn], float)
    return np.stack((least, *np.quantile(some, (tail, 1 - tail), axis=0), most), 1)


def _matrix(column: pa.Array, width: int | None) -> np.ndarray:
    """Vectors as rows, short ones with zeros behind."""
    lengths = np.diff(column.offsets.to_numpy())
    width = int(lengths.max(initial=0)) if width is None else width
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width)[None, :] < lengths[:, None]] = values
    return out


class Cells:
    """The edges of all cells: low and high by dimension and cell."""

    def __init__(self, components: np.ndarray, cells: int = CELLS):
        least, low, high, most = components.T
        inner = np.ceil(low[:, None] + (high - low)[:, None] * np.linspace(0, 1, cells - 1)[None, :])
        self.inner = np.clip(inner, least[:, None], most[:, None] + 1)
        self.low = np.concatenate((least[:, None], self.inner), 1)
        self.high = np.maximum(np.concatenate((self.inner - 1, most[:, None]), 1), self.low)  # values are whole; an empty cell is never looked up

    def quantised(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for d in range(x.shape[1]):
            out[:, d] = np.searchsorted(self.inner[d], x[:, d], "right")
        return out

    def between(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = np.arange(codes.shape[1])[None, :]
        return self.low[d, codes], self.high[d, codes]


_ROWS = "r_block long, ids binary, labels binary, codes binary, exact binary, kind string"


def approximation(rows: DataFrame, cells: Cells, size: int = ROWS) -> DataFrame:
    """The file: blocks of up to `size` rows as they are read, sorted by label and id, as packed arrays of ids, labels, cells and exact vectors."""
    width = len(cells.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        for whole in batches:
            for at in range(0, whole.num_rows, size):
                batch = whole.slice(at, size)
                ids, labels = (batch.column(k).to_numpy() for k in ("vec_id", "label"))
                order = np.lexsort((ids, labels))
                x = _matrix(batch.column("v"), width)[order]
                kind = "<i2" if np.abs(x).max(initial=0) < 1 << 15 else "<i8"
                values = number, ids[order].tobytes(), labels[order].tobytes(), cells.quantised(x).tobytes(), x.astype(kind).tobytes(), kind
                yield pa.RecordBatch.from_arrays([pa.array([v]) for v in values], names=["r_block", "ids", "labels", "codes", "exact", "kind"])
                number += 1

    return rows.select("vec_id", "label", "v").mapInArrow(run, _ROWS)


def _bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest inner product of each anchor with each row, from the edges of the rows' cells."""
    up, down = np.maximum(anchors, 0).astype(float), np.minimum(anchors, 0).astype(float)
    least, most = up @ low.T + down @ high.T, up @ high.T + down @ low.T
    slack = 1e-12 * (np.abs(anchors).astype(float) @ np.maximum(np.abs(low), np.abs(high)).max(0, initial=0))[:, None]  # of rounding, where numbers are so large that doubles do
    return least - slack, most + slack


def _best(scores: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first by falling score, then ascending id."""
    return np.lexsort((ids, -scores))[:keep]


class _Block:
    def __init__(self, row: pa.RecordBatch, width: int, cells: Cells):
        one = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)
        self.ids, self.labels = one("ids", np.int64), one("labels", np.int64)
        self.low, self.high = cells.between(one("codes", np.uint8).reshape(len(self.ids), width))
        self.exact = one("exact", np.dtype(row.column("kind")[0].as_py())).reshape(len(self.ids), width).astype(np.int64)

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, (label, label + 1)))


def _positives(block: _Block, anchor: tuple, best: dict, keep: int, count: list[int]) -> None:
    ids, labels, vectors = anchor
    for label in np.unique(labels).tolist():
        own, rows = np.flatnonzero(labels == label), block.of_label(label)
        if rows.start == rows.stop:
            continue
        least, most = _bounds(vectors[own], block.low[rows], block.high[rows])
        for k, i in enumerate(own.tolist()):
            other = block.ids[rows] != ids[i]
            scores, found = best.get((int(ids[i]), 0), _NONE)
            certain = np.concatenate((scores, least[k][other]))
            limit = np.partition(certain, len(certain) - keep)[len(certain) - keep] if len(certain) >= keep else -np.inf
            able = np.flatnonzero(other & (most[k] >= limit))
            count[0] += len(able)
            _enter(best, (int(ids[i]), 0), scores, found, block.exact[rows][able] @ vectors[i], block.ids[rows][able], keep)


_NONE = np.zeros(0, np.int64), np.zeros(0, np.int64)


def _enter(best: dict, key: tuple, scores: np.ndarray, found: np.ndarray, more: np.ndarray, ids: np.ndarray, keep: int) -> None:
    scores, found = np.concatenate((scores, more)), np.concatenate((found, ids))
    order = _best(scores, found, keep)
    best[key] = scores[order], found[order]


def _negatives(block: _Block, anchor: tuple, best: dict, keep: int, count: list[int]) -> None:
    """anchor: ids, labels, vectors, and for each anchor its windows, rows of (positive's number, least, most)."""
    ids, labels, vectors, windows = anchor
    least, most = _bounds(vectors, block.low, block.high)
    for i in range(len(ids)):
        if not len(windows[i]):
            continue
        lo, hi = least[i].copy(), most[i].copy()
        same = block.of_label(int(labels[i]))
        hi[same] = -np.inf
        lo[same] = np.inf
        may = np.flatnonzero((hi >= windows[i][:, 1].min()) & (lo <= windows[i][:, 2].max()))
        if not len(may):
            continue
        lo, hi = lo[may], hi[may]
        able = np.zeros(len(may), bool)
        for number, first, last in windows[i].tolist():
            scores = best.get((int(ids[i]), number), _NONE)[0]
            certain = np.concatenate((scores, lo[(lo >= first) & (hi <= last)]))
            limit = max(first, np.partition(certain, len(certain) - keep)[len(certain) - keep]) if len(certain) >= keep else first
            able |= (hi >= limit) & (lo <= last)
        rows = may[able]
        count[0] += len(rows)
        exact, own = block.exact[rows] @ vectors[i], block.ids[rows]
        for number, first, last in windows[i].tolist():
            inside = (exact >= first) & (exact <= last)
            if inside.any():
                _enter(best, (int(ids[i]), number), *best.get((int(ids[i]), number), _NONE), exact[inside], own[inside], keep)


def _blocks_of_anchors(anchors: DataFrame, blocks: int) -> DataFrame:
    """a_block and its anchors (structs with a_number), about ANCHORS each."""
    return anchors.groupBy(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("a_block")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "label", "v", "windows"))).alias("anchors"))


_FOUND = "anchor_id long, number long, row_id long, score long"


def _scan(file: DataFrame, anchors: DataFrame, cells: Cells, n_blocks: int, n_anchors: int, negatives: bool, keep: int, per_block: int, groups: tuple[int, int]) -> DataFrame:
    """anchor_id, number, row_id and score: the first `keep` rows of each anchor and window number (0 for positives) of what each task saw."""
    width = len(cells.low)
    a_blocks = max(1, -(-n_anchors // per_block))
    r_groups, a_groups = max(1, -(-n_blocks // groups[0])), max(1, -(-a_blocks // groups[1]))
    several = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = file.withColumn("r_group", F.pmod(F.xxhash64("r_block"), F.lit(r_groups)).cast("int")).withColumn("a_group", several(a_groups))
    right = settle(_blocks_of_anchors(anchors, a_blocks).withColumn("a_group", (F.col("a_block") % a_groups).cast("int"))).withColumn("r_group", several(r_groups))
    met = left.join(right, ["r_group", "a_group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict = {}
        block = number = None
        count = [0]

        def given() -> pa.RecordBatch:
            sizes = [len(x[0]) for x in best.values()]
            keys = np.array(list(best), np.int64).reshape(-1, 2)
            columns = [np.repeat(keys[:, 0], sizes), np.repeat(keys[:, 1], sizes), *(np.concatenate([x[k] for x in best.values()]) if best else np.zeros(0, np.int64) for k in (1, 0))]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=["anchor_id", "number", "row_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                if row.column("r_block")[0].as_py() != number:
                    number = row.column("r_block")[0].as_py()
                    block = _Block(row, width, cells)
                flat = row.column("anchors").flatten()
                ids, labels = (flat.field(k).to_numpy() for k in ("vec_id", "label"))
                vectors = _matrix(flat.field("v"), width)
                if negatives:
                    windows = [np.array(w, np.int64).reshape(-1, 3) for w in flat.field("windows").to_pylist()]
                    _negatives(block, (ids, labels, vectors, windows), best, keep, count)
                else:
                    _positives(block, (ids, labels, vectors), best, keep, count)
                if len(best) >= HELD:
                    yield given()
        if best:
            yield given()

    return met.select("r_block", "ids", "labels", "codes", "exact", "kind", "anchors").mapInArrow(run, _FOUND)


def _first(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "number").orderBy(F.desc("score"), "row_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(rows: DataFrame, is_anchor: str, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST, cells: int = CELLS, size: int = ROWS, per_block: int = ANCHORS, groups: tuple[int, int] = (ROW_BLOCKS, ANCHOR_BLOCKS)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score, from rows as whole_numbers gives them (vec_id, label, v) and a condition on them, which of them are anchors.

    A score is the inner product of whole numbers, which must fit 64 bits; short vectors have zeros behind. An anchor's positives are its first other rows of its label by falling score, ties by smaller id; for each of them, negatives are the
    first rows of other labels whose score is from least to most percent of the positive's. Anchors without positives and positives without negatives have no row; an empty table gives an empty one.
    """
    rows = settle(rows)
    file_of = Cells(components(rows), cells)
    file = settle(approximation(rows, file_of, size))
    anchors = settle(rows.where(is_anchor).select("vec_id", "label", "v"))
    n_blocks, n_anchors = file.count(), anchors.count()
    no_windows = F.array().cast("array<array<bigint>>").alias("windows")
    near = settle(_first(_scan(file, anchors.select("*", no_windows), file_of, n_blocks, n_anchors, False, positives, per_block, groups), positives).select("anchor_id", F.col("rank").cast("long").alias("number"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")))
    hundredth = lambda x: F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))  # noqa: E731  rounded down
    window = F.array("number", -hundredth(-F.col("positive_score") * least), hundredth(F.col("positive_score") * most))
    windows = near.groupBy("anchor_id").agg(F.sort_array(F.collect_list(window)).alias("windows"))
    with_windows = anchors.join(windows, anchors.vec_id == windows.anchor_id).drop("anchor_id")
    far = _first(_scan(file, with_windows, file_of, n_blocks, n_anchors, True, negatives, per_block, groups), negatives)
    return far.join(near, ["anchor_id", "number"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def relabelled(rows: DataFrame) -> DataFrame:
    """Rows with the label of every id divisible by 7 moved on by one of ten."""
    return rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


#: DuckDB SQL for mine(relabelled(whole_numbers(embeddings)), vec_id % 50 = 0): every score in full.
SQL = f"""
with e as (select vec_id::bigint id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint y, embedding x from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
c as (select id, y, unnest(range(len(x))) d, unnest(list_transform(x, lambda c: floor({SCALE} * c::double)::bigint)) v from e),
a as (select * from c where id % 50 = 0),
s as (select a.id a, c.id b, a.y ya, c.y yb, sum(a.v * c.v)::bigint score from a join c on a.d = c.d and a.id <> c.id group by all),
p as (select a, b, score from s where ya = yb qualify row_number() over (partition by a order by score desc, b) <= {POSITIVES}),
n as (select p.a, p.b, s.b n, p.score ps, s.score ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b)::int r from p join s on s.a = p.a and s.ya <> s.yb and {LEAST} * p.score <= 100 * s.score and 100 * s.score <= {MOST} * p.score)
select a anchor_id, b positive_id, r "rank", n negative_id, ps positive_score, ns negative_score from n where r <= {NEGATIVES}
"""
