"""Extension of hits in both directions, without and with gaps, for all hits of many pairs of blocks at once.

A hit is a row; hits that start in the same two blocks share their contexts. Both strands of a duplex count upwards here: the query from its 5' end, the target from its 3' end. The passes walk outwards step by step, each step as whole-array
operations over all hits that still go on. A hit that comes to the border of its context, where its sequence goes on, is marked as cut; with contexts that reach further it is taken again.

With gaps, the best duplex that ends with a pair i query and j target bases further out is the best over all pairs nearer by plus the loop between. Pairs with the same i + j make a diagonal; those of a diagonal only depend on the diagonals
before, as far back as loops may be long. So the pass goes by diagonals, keeps what may end there as one list of cells over all hits, and finds the cells nearer by in a ring of the last diagonals. Hits stop on their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import BASE_CODES
from ..functions.energy import DANGLE3, DANGLE5, PAIR, REVERSE, TERMINAL_AU, Model
from ..sources.settled import settled
from .blocks import REACH, SIZE, blocks

#: Energy of a cell that nothing leads to.
NOWHERE = 1e6
#: Hits that are extended with gaps at once, and bases of the contexts that are taken at once.
HITS, BASES = 1024, 1 << 20


class Strand:
    """One side of many contexts as flat arrays, with barriers between: codes (0: a barrier or an unknown base), whether a barrier is a border where the sequence goes on, and what it costs to open a base on the way back and on."""

    def __init__(self, seqs: pa.Array, acc: pa.Array, cond: pa.Array, run: pa.Array, offset: np.ndarray, total: np.ndarray, least: int, reverse: bool, pad: int):
        text = seqs.cast(pa.large_string())
        _, starts, data = text.buffers()
        starts = np.frombuffer(starts, np.int64)[text.offset : text.offset + len(text) + 1]
        n = np.diff(starts)
        self.n, self.reverse = n, reverse
        self.at = np.cumsum(n + 2) - n - 2 + pad + 1  # of each context's first base here
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        place = self.at[row] + (n[row] - 1 - within if reverse else within)
        size = int((n + 2).sum()) + 2 * pad
        self.code, self.border = np.zeros(size, np.int64), np.zeros(size, bool)
        self.code[place] = BASE_CODES[np.frombuffer(data, np.uint8)[starts[0] : starts[-1]]] if len(place) else 0
        before, behind = offset > 0, offset + n < total
        first, last = (behind, before) if reverse else (before, behind)
        self.border[(self.at - 1)[first]] = True
        self.border[(self.at + n)[last]] = True
        a, c = (x.flatten().to_numpy(zero_copy_only=False).astype(float) for x in (acc, cond))
        further = np.zeros(len(a))
        inside = np.flatnonzero(within + least < n[row])
        further[inside] = a[inside] - a[inside + 1] + c[inside + least]
        self.back, self.on = np.zeros(size), np.zeros(size)
        self.back[place], self.on[place] = (c, further) if reverse else (further, c)
        # where sums and first windows stand, by context
        self.first, self.a, self.run, self.run_at = np.cumsum(n) - n, a, run.flatten().to_numpy(zero_copy_only=False), np.cumsum(n + 1) - n - 1

    def flat(self, row: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Where stretches that start at these places of their contexts, counted from the 5' end, begin here."""
        return self.at[row] + (self.n[row] - start - size if self.reverse else start)

    def opening(self, row: np.ndarray, start: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
        at = self.run_at[row] + start
        return self.a[self.first[row] + start] + (self.run[at + size] - self.run[at + least])

    def room(self, at: np.ndarray, way: int) -> np.ndarray:
        """Known bases beyond these places, up to the next barrier."""
        stops = np.flatnonzero(self.code == 0)
        if way > 0:
            return stops[np.searchsorted(stops, at, "right")] - at - 1
        return at - stops[np.searchsorted(stops, at, "left") - 1] - 1


def _types(q: Strand, t: Strand, k: np.ndarray, v: np.ndarray) -> np.ndarray:
    return PAIR[q.code[k], t.code[v]]


def _between(model: Model, q: Strand, t: Strand, outer: np.ndarray, inner: np.ndarray, i: np.ndarray, j: np.ndarray, p: np.ndarray, r: np.ndarray) -> np.ndarray:
    """kcal/mol of the loops between outer pairs (i, j) and inner ones (p, r) of these types, the inner as read from inside."""
    return model.loop(outer, inner, p - i - 1, r - j - 1, q.code[i + 1], q.code[p - 1], t.code[r - 1], t.code[j + 1]) / 100


def ungapped(q: Strand, t: Strand, model: Model, k: np.ndarray, v: np.ndarray, size: np.ndarray, acc: np.ndarray, hyb: np.ndarray, drop: int) -> tuple[np.ndarray, ...]:
    """Extend hits at flat places on both sides without gaps, each as long as its energy has improved within the last `drop` bases: new k, v, size, acc, hyb, and whether cut."""
    acc, hyb, cut = acc.copy(), hyb.copy(), np.zeros(len(k), bool)
    ends = []
    for back in (True, False):
        way = -1 if back else 1
        at_k, at_v = (k.copy(), v.copy()) if back else (k + size - 1, v + size - 1)
        shift, best_k = at_v - at_k, at_k.copy()
        a, h = acc.copy(), hyb.copy()
        live, here = np.arange(len(k)), at_k.copy()
        q_steps, v_steps = (q.back, t.back) if back else (q.on, t.on)
        while len(live):
            here = here + way
            there = here + shift[live]
            cut[live] |= q.border[here] | t.border[there]
            on = (q.code[here] > 0) & (t.code[there] > 0)
            live, here, there = live[on], here[on], there[on]
            a[live] += q_steps[here] + v_steps[there]
            kind = _types(q, t, here, there)
            met = kind > 0
            hit, x, y = live[met], here[met], there[met]
            near = _types(q, t, at_k[hit], at_v[hit])
            if back:
                h[hit] += _between(model, q, t, kind[met], REVERSE[near], x, y, at_k[hit], at_v[hit])
            else:
                h[hit] += _between(model, q, t, near, REVERSE[kind[met]], at_k[hit], at_v[hit], x, y)
            at_k[hit], at_v[hit] = x, y
            better = a[hit] + h[hit] < acc[hit] + hyb[hit]
            hit = hit[better]
            acc[hit], hyb[hit], best_k[hit] = a[hit], h[hit], x[better]
            on = np.abs(here - best_k[live]) < drop
            live, here = live[on], here[on]
        ends.append(best_k)
    return ends[0], v + ends[0] - k, ends[1] - ends[0] + 1, acc, hyb, cut


class _Cells:
    """Cells of all hits by number: energy, the type that the next loop out sees, that of the cell it came from, which one that is (-1: none), and places."""

    def __init__(self):
        self.n, self.capacity = 0, 1 << 12
        self.energy = np.zeros(self.capacity)
        self.ints = np.zeros((6, self.capacity), np.int64)  # type, type before, before, hit, i, j

    def add(self, energy: np.ndarray, *ints: np.ndarray) -> np.ndarray:
        end = self.n + len(energy)
        while end > self.capacity:
            self.energy, self.ints = np.concatenate((self.energy, self.energy)), np.concatenate((self.ints, self.ints), 1)
            self.capacity *= 2
        self.energy[self.n : end], self.ints[:, self.n : end] = energy, ints
        number = np.arange(self.n, end)
        self.n = end
        return number


def _nearer(drop: int) -> tuple[np.ndarray, np.ndarray]:
    """Unpaired bases on both sides of all loops of up to `drop`, those to cells that were made first in front."""
    u = np.array([(a, b) for a in range(drop + 1) for b in range(drop + 1 - a)])
    u = u[np.lexsort((-u[:, 0], -u.sum(1)))]
    return u[:, 0], u[:, 1]


def outwards(q: Strand, t: Strand, model: Model, k: np.ndarray, v: np.ndarray, energy: np.ndarray, back: bool, drop: int, helix: int) -> tuple[np.ndarray, ...]:
    """The best duplex beyond pairs at flat places: bases added on the query and the target, the energy in all, the opening costs among it, whether cut, and the new pairs as (hit, k, v). What doesn't improve on the energy given adds nothing."""
    way, n = (-1 if back else 1), len(k)
    turned = np.arange(7) if back else REVERSE  # a pair further out, as the loop to it is read
    room_q, room_t = q.room(k, way), t.room(v, way)
    last = np.maximum(room_q, room_t) + 1
    q_steps, t_steps = (q.back, t.back) if back else (q.on, t.on)
    u1, u2 = _nearer(drop)
    depth, width = drop + 3, 32
    ring = np.full((depth, n, width), -1, np.int64)
    leading = np.full((depth, n), -1, np.int64)  # type of a diagonal's first cell
    own = _types(q, t, k, v)
    own = REVERSE[own] if back else own
    cells = _Cells()
    zero = np.zeros(n, np.int64)
    ring[0, :, 0] = cells.add(energy, own, own, zero - 1, np.arange(n), zero, zero)
    leading[0] = own
    open_q, open_t = np.zeros((n, 1)), np.zeros((n, 1))
    best, best_open, best_at, best_length = energy.copy(), np.zeros(n), zero - 1, zero.copy()
    ended = zero.copy()
    length = 1
    while True:
        live = np.flatnonzero((length - 1 - best_length < drop) & (length <= last))
        if not len(live):
            break
        ended[live] = length
        if length >= width:
            ring = np.concatenate((ring, np.full_like(ring, -1)), 2)
            width *= 2
        # what opening so many bases costs; beyond a barrier nothing asks for it
        open_q, open_t = (np.column_stack((sums, sums[:, -1] + steps[np.clip(place + way * length, 0, len(steps) - 1)])) for sums, steps, place in ((open_q, q_steps, k), (open_t, t_steps, v)))
        ring[length % depth], leading[length % depth] = -1, -1
        low, high = np.maximum(1, length - room_t[live]), np.minimum(room_q[live], length - 1)
        count = np.maximum(0, high - low + 1)
        hit = np.repeat(live, count)
        i = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        j = length - i
        kind = turned[_types(q, t, k[hit] + way * i, v[hit] + way * j)]
        met = kind > 0
        hit, i, j, kind = hit[met], i[met], j[met], kind[met]
        # a helix that begins has `helix` pairs, of which the first two aren't both wobbles; one goes on from the cell next to it, unless both that came from and this are wobbles
        inner = ring[(length - 2) % depth, hit, i - 1] if length > 1 else hit
        before = np.where(inner >= 0, cells.ints[1][inner], 0)
        wobble = (kind == 3) | (kind == 4)
        begins = (before == 0) | (wobble & ((before == 3) | (before == 4)))
        good = np.ones(len(hit), bool)
        at_k, at_v = k[hit] + way * i, v[hit] + way * j
        for x in range(1, helix):
            further = turned[_types(q, t, np.clip(at_k + way * x, 0, len(q.code) - 1), np.clip(at_v + way * x, 0, len(t.code) - 1))]
            good &= further > 0
            if x == 1:
                good &= ~(wobble & ((further == 3) | (further == 4)))
        may = good | ~begins
        hit, i, j, kind, at_k, at_v = hit[may], i[may], j[may], kind[may], at_k[may], at_v[may]
        if len(hit):
            a, b = i[:, None] - 1 - u1, j[:, None] - 1 - u2
            number = np.where((a >= 0) & (b >= 0), ring[(length - 2 - u1 - u2) % depth, hit[:, None], np.maximum(a, 0)], -1)
            number = np.where((length - 2 - u1 - u2 >= 0)[None, :], number, -1)
            cell, offset = np.nonzero(number >= 0)
            number = number[cell, offset]
            near_k, near_v = (x[cell] - way * (y[cell] - cells.ints[z][number]) for x, y, z in ((at_k, i, 4), (at_v, j, 5)))
            seen = cells.ints[0][number]
            if back:
                more = _between(model, q, t, kind[cell], seen, at_k[cell], at_v[cell], near_k, near_v)
            else:
                more = _between(model, q, t, seen, kind[cell], near_k, near_v, at_k[cell], at_v[cell])
            more = more + cells.energy[number]
            least, source = np.full(len(hit), NOWHERE), np.full(len(hit), -1, np.int64)
            if len(cell):
                first = np.flatnonzero(np.diff(cell, prepend=-1))
                lowest = np.minimum.reduceat(more, first)
                of = cell[first]
                where = np.flatnonzero(more == lowest[np.searchsorted(of, cell)])
                where = where[np.flatnonzero(np.diff(cell[where], prepend=-1))]  # the first made of equal ones
                reached = lowest < NOWHERE
                least[of[reached]], source[of[reached]] = lowest[reached], number[where[reached]]
            came = cells.ints[0][source]
            lost = np.flatnonzero(source < 0)
            if len(lost):  # nothing leads there; such a cell sees the first one that is near enough to be looked at
                came[lost] = 0
                head = np.flatnonzero(np.diff(hit, prepend=-1))
                head = head[np.searchsorted(head, lost, "right") - 1]
                came[lost] = np.where(head < lost, REVERSE[kind[head]], 0)
                for diagonal in range(length - 1, max(0, length - 2 - drop) - 1, -1):
                    there = leading[diagonal % depth, hit[lost]]
                    came[lost] = np.where(there >= 0, there, came[lost])
            ring[length % depth, hit, i] = cells.add(least, REVERSE[kind], came, source, hit, i, j)
            head = np.flatnonzero(np.diff(hit, prepend=-1))
            leading[length % depth, hit[head]] = REVERSE[kind[head]]
            opened = open_q[hit, i] + open_t[hit, j]
            total = opened + least
            lowest = np.minimum.reduceat(total, head)
            where = np.flatnonzero(total == np.repeat(lowest, np.diff(np.append(head, len(hit)))))
            where = where[np.flatnonzero(np.diff(hit[where], prepend=-1))]
            where = where[total[where] < best[hit[where]]]
            to = hit[where]
            best[to], best_open[to], best_at[to], best_length[to] = total[where], opened[where], ring[length % depth, to, i[where]], length
        length += 1
    cut = np.zeros(n, bool)
    for strand, place, room in ((q, k, room_q), (t, v, room_t)):
        cut |= (ended > room) & strand.border[place + way * (room + 1)]
    grown = best_at >= 0
    add_q, add_t = (np.where(grown, cells.ints[x][best_at], 0) for x in (4, 5))
    number, pairs = best_at[grown], []
    while len(number):
        number = number[cells.ints[4][number] > 0]
        of, i, j = cells.ints[3:, number]
        pairs.append(np.stack((of, k[of] + way * i, v[of] + way * j)))
        number = cells.ints[2][number]
        number = number[number >= 0]
    pairs = np.concatenate(pairs, 1) if pairs else np.zeros((3, 0), np.int64)
    return add_q, add_t, best, best_open, cut, pairs


def dangling(q: Strand, t: Strand, k: np.ndarray, v: np.ndarray, m: np.ndarray, n: np.ndarray) -> np.ndarray:
    """kcal/mol of the bases beside duplexes; the terminal penalty counts where the target ends."""
    out = np.zeros(len(k))
    for kind, a, b, five, three in ((_types(q, t, k, v), k - 1, v - 1, "q", "t"), (REVERSE[_types(q, t, k + m - 1, v + n - 1)], k + m, v + n, "t", "q")):
        q_there, t_there = _is_base(q, a), _is_base(t, b)
        table = {"q": DANGLE5 if five == "q" else DANGLE3, "t": DANGLE5 if five == "t" else DANGLE3}
        beside = np.where(q_there, table["q"][kind, q.code[a]], 0) + np.where(t_there, table["t"][kind, t.code[b]], TERMINAL_AU * (kind > 2))
        out += np.where(kind > 0, beside, 0) / 100
    return out


def _is_base(strand: Strand, at: np.ndarray) -> np.ndarray:
    """Whether places are within a sequence, known bases or not."""
    row = np.searchsorted(strand.at, at, "right") - 1
    return (row >= 0) & (at < strand.at[row] + strand.n[row])


def gapped(q: Strand, t: Strand, model: Model, k: np.ndarray, v: np.ndarray, m: np.ndarray, n: np.ndarray, acc: np.ndarray, hyb: np.ndarray, drop: int, helix: int) -> tuple[np.ndarray, ...]:
    """Extend hits at flat places on both sides with bulges and interior loops, then add what dangles: new k, v, m, n, acc, hyb, whether cut, and the new pairs as (hit, k, v)."""
    cut, pairs = np.zeros(len(k), bool), []
    for back in (True, False):
        end_k, end_v = (k, v) if back else (k + m - 1, v + n - 1)
        add_q, add_t, best, opened, short, new = outwards(q, t, model, end_k, end_v, acc + hyb, back, drop, helix)
        grown = add_q > 0
        more = acc + opened
        acc, hyb = np.where(grown, more, acc), np.where(grown, best - more, hyb)
        k, v, m, n = (k - add_q, v - add_t, m + add_q, n + add_t) if back else (k, v, m + add_q, n + add_t)
        cut |= short
        pairs.append(new)
    return k, v, m, n, acc, hyb + dangling(q, t, k, v, m, n), cut, np.concatenate(pairs, 1)


# As Spark stages: hits by the two blocks that they start in.

_PAIR_LIST = pa.list_(pa.struct([("q", pa.int32()), ("t", pa.int32())]))
_HIT = [("query_id", pa.int64()), ("target_id", pa.int64()), ("q_start", pa.int32()), ("t_start", pa.int32()), ("q_len", pa.int32()), ("t_len", pa.int32()), ("acc_energy", pa.float64()), ("hyb_energy", pa.float64()), ("energy", pa.float64()), ("base_pairs", _PAIR_LIST)]
HITS_SCHEMA = "query_id long, target_id long, q_start int, t_start int, q_len int, t_len int, acc_energy double, hyb_energy double, energy double, base_pairs array<struct<q:int,t:int>>"
_CONTEXT = ("seq", "acc", "cond", "run", "offset", "total")


def _side(batch: pa.RecordBatch, name: str, least: int, reverse: bool, pad: int) -> Strand:
    x = {c: batch.column(f"{name}_{c}") for c in _CONTEXT}
    return Strand(x["seq"], x["acc"], x["cond"], x["run"], x["offset"].to_numpy(), x["total"].to_numpy(), least, reverse, pad)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows whose contexts have about BASES bases together."""
    for batch in batches:
        sizes = sum(pc.utf8_length(batch.column(c)).to_numpy() for c in ("q_seq", "t_seq"))
        upto, low = np.cumsum(sizes), 0
        while low < batch.num_rows:
            high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + BASES, "right")))
            yield batch.slice(low, high - low)
            low = high


def _given(batch: pa.RecordBatch) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of which row each hit is, and the hits' columns."""
    hits = batch.column("hits")
    row = np.repeat(np.arange(batch.num_rows), np.diff(hits.offsets.to_numpy()))
    flat = hits.flatten()
    return row, {f.name: flat.field(f.name) if pa.types.is_list(f.type) else flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def _ungapped_part(batch: pa.RecordBatch, least: int, drop: int, model: Model) -> pa.RecordBatch:
    row, x = _given(batch)
    q, t = _side(batch, "q", least, False, 4), _side(batch, "t", least, True, 4)
    q_off, t_off = (batch.column(f"{s}_offset").to_numpy()[row] for s in "qt")
    q_at, t_at, size = x["q_start"] - q_off, x["t_start"] - t_off, x["length"].astype(np.int64)
    acc = q.opening(row, q_at, size, least) + t.opening(row, t_at, size, least)
    good = np.flatnonzero(acc + x["hyb"] < 0)
    row, size = row[good], size[good]
    k, v = q.flat(row, q_at[good], size), t.flat(row, t_at[good], size)
    new_k, new_v, new, acc, hyb, cut = ungapped(q, t, model, k, v, size, acc[good], x["hyb"][good].astype(float), drop)
    columns = [batch.column("query_id").take(pa.array(row)), batch.column("target_id").take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in _forward(q, t, row, new_k, new_v, new, q_off[good], t_off[good])), *(pa.array(new.astype(np.int32)),) * 2]
    columns += [pa.array(acc), pa.array(hyb), pa.array(acc + hyb), pa.array(x["q_start"][good]), pa.array(x["t_start"][good]), pa.array(x["length"][good]), pa.array(x["hyb"][good]), pa.array(cut)]
    return pa.RecordBatch.from_arrays(columns, names=_UNGAPPED)


_UNGAPPED = ["query_id", "target_id", "q_start", "t_start", "q_len", "t_len", "acc_energy", "hyb_energy", "energy", "q_seed", "t_seed", "length", "hyb", "cut"]


def _forward(q: Strand, t: Strand, row: np.ndarray, k: np.ndarray, v: np.ndarray, n: np.ndarray, q_off: np.ndarray, t_off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts on query and target, both from the 5' end, of hits at flat places."""
    return k - q.at[row] + q_off, t.n[row] - (v - t.at[row]) - n + t_off


def _gapped_part(batch: pa.RecordBatch, least: int, drop: int, helix: int, model: Model) -> Iterator[pa.RecordBatch]:
    every, x = _given(batch)
    q, t = _side(batch, "q", least, False, helix + 2), _side(batch, "t", least, True, helix + 2)
    offsets = {s: batch.column(f"{s}_offset").to_numpy() for s in "qt"}
    for low in range(0, len(every), HITS):
        own = slice(low, low + HITS)
        row = every[own]
        q_off, t_off = offsets["q"][row], offsets["t"][row]
        size = x["q_len"][own].astype(np.int64)  # no gaps so far
        k, v = q.flat(row, x["q_start"][own] - q_off, size), t.flat(row, x["t_start"][own] - t_off, size)
        new_k, new_v, m, n, acc, hyb, cut, more = gapped(q, t, model, k, v, size, size, x["acc_energy"][own], x["hyb_energy"][own], drop, helix)
        # pairs of the hit itself, then of what was added, in order
        of = np.repeat(np.arange(len(row)), size)
        step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        paired = _types(q, t, k[of] + step, v[of] + step) > 0
        pairs = np.concatenate((np.stack((of, k[of] + step, v[of] + step))[:, paired], more), 1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        q_pair, t_pair = pairs[1] - q.at[row][pairs[0]] + q_off[pairs[0]], t.n[row][pairs[0]] - 1 - (pairs[2] - t.at[row][pairs[0]]) + t_off[pairs[0]]
        ends = np.searchsorted(pairs[0], np.arange(len(row) + 1)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(q_pair.astype(np.int32)), pa.array(t_pair.astype(np.int32))], ["q", "t"]))
        q_new, t_new = _forward(q, t, row, new_k, new_v, n, q_off, t_off)
        columns = [batch.column("query_id").take(pa.array(row)), batch.column("target_id").take(pa.array(row)), *(pa.array(c.astype(np.int32)) for c in (q_new, t_new, m, n)), pa.array(acc), pa.array(hyb), pa.array(acc + hyb), lists]
        columns += [pa.array(x[c][own]) for c in ("q_start", "t_start", "q_len", "acc_energy", "hyb_energy")] + [pa.array(cut)]
        yield pa.RecordBatch.from_arrays(columns, names=_GAPPED)


_GAPPED = [n for n, _ in _HIT] + ["q_before", "t_before", "before", "acc_before", "hyb_before", "cut"]


def _in_contexts(hits: DataFrame, columns: list[str], queries: DataFrame, targets: DataFrame, size: int) -> DataFrame:
    """A row for each two blocks that hits start in, with the hits and both contexts. Starts in two blocks are a bounded number."""
    spark = hits.sparkSession
    keys = ["query_id", "q_block", "target_id", "t_block"]
    block = lambda c: F.floor(F.col(c) / size).cast("int")
    met = hits.withColumns({"q_block": block("q_start"), "t_block": block("t_start")}).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("hits"))
    side = lambda table, s, name: table.select(F.col("seq_id").alias(name), F.col("block").alias(f"{s}_block"), *(F.col(c).alias(f"{s}_{c}") for c in _CONTEXT))
    met = met.join(side(queries, "q", "query_id"), ["query_id", "q_block"]).join(side(targets, "t", "target_id"), ["target_id", "t_block"])
    # few bytes, much work: as many tasks as shuffles have partitions, whatever the bytes
    return met.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys)


class Blocks:
    """Sequences and profiles of both sides, as tables of blocks that reach as far as asked. stored: the targets' blocks of the usual reach, where the caller has them."""

    def __init__(self, queries: tuple[DataFrame, DataFrame], targets: tuple[DataFrame, DataFrame], size: int = SIZE, reach: int = REACH, stored: DataFrame | None = None):
        self.sides, self.size, self.reach, self.made = (queries, targets), size, reach, {}
        if stored is not None:
            self.made[0, 1] = stored

    def reaching(self, level: int) -> tuple[DataFrame, DataFrame]:
        for k, side in enumerate(self.sides):
            if (level, k) not in self.made:
                self.made[level, k] = self.made[level, 0] if k and side is self.sides[0] else settled(blocks(*side, self.size, self.reach * 8**level))
        return self.made[level, 0], self.made[level, 1]


def _until_whole(hits: DataFrame, columns: list[str], table: Blocks, run, schema: str, again: dict[str, str]) -> DataFrame:
    """What run gives for hits in contexts, of which those that are cut are taken again in contexts that reach eight times as far, until none is."""
    out, level = None, 0
    while True:
        got = settled(_in_contexts(hits, columns, *table.reaching(level), table.size).mapInArrow(run, schema + ", cut boolean"))
        whole = got.where("not cut")
        out = whole if out is None else out.union(whole)
        hits = got.where("cut")
        if hits.isEmpty():
            return out.drop("cut")
        hits = hits.select("query_id", "target_id", *(F.col(old).alias(new) for new, old in again.items()))
        level += 1


def ungapped_hits(seeds: DataFrame, table: Blocks, least: int, drop: int, model: Model) -> DataFrame:
    """Hits (query_id, target_id, q_start, t_start, q_len, t_len, acc_energy, hyb_energy, energy) from seeds (query_id, target_id, q_start, t_start, length, hyb): those whose energy in all is below 0, extended without gaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield _ungapped_part(batch, least, drop, model)

    schema = HITS_SCHEMA.split(", base_pairs")[0] + ", q_seed int, t_seed int, length int, hyb double"
    again = {"q_start": "q_seed", "t_start": "t_seed", "length": "length", "hyb": "hyb"}
    return _until_whole(seeds, list(again), table, run, schema, again).drop("q_seed", "t_seed", "length", "hyb")


def gapped_hits(hits: DataFrame, table: Blocks, least: int, drop: int, helix: int, model: Model) -> DataFrame:
    """Hits without gaps, extended with gaps, with what dangles and their base pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            yield from _gapped_part(batch, least, drop, helix, model)

    again = {"q_start": "q_before", "t_start": "t_before", "q_len": "before", "acc_energy": "acc_before", "hyb_energy": "hyb_before"}
    schema = HITS_SCHEMA + ", q_before int, t_before int, before int, acc_before double, hyb_before double"
    return _until_whole(hits, list(again), table, run, schema, again).drop(*again.values())
