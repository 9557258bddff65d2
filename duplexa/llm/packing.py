"""Packing of documents into sequences of at most CAPACITY tokens by multiway differencing (Karmarkar and Karp).

A document longer than a sequence fills whole sequences; what is left of it, or the whole of a shorter one, is a remainder. Remainders of a group are partitioned among the least number of windows: each starts as a partial partition
of its own (its size in one window, all others empty); always the two partial partitions of the widest imbalance are merged, the heaviest windows of one onto the lightest of the other, until one is left, whose windows are near-equal.
If a window then passes the capacity, the number of windows rises and the group is partitioned again. Differencing ends as even as its smallest items are small, so the longest remainders, of FILL of the group's tokens, are cut into fillers
of FILLER tokens; all others stay whole. Padding so is about 0.7% of a full group.

Documents stay in the task that reads them: a group is a run of at least GROUP remainders there (or all that a small partition has), so memory is bounded, no text moves and no key is hot.

Tokens are the tokenizer's own. Its pre-tokens reach neither over ASCII white space nor from an ASCII letter, digit or most marks to one of another kind, so a text's tokens are those of the pieces between such places; each distinct piece is
encoded once in a task's process and looked up by a 64-bit hash after that.
"""

from __future__ import annotations

import heapq
import os
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import slices

CAPACITY = 4096
#: Remainders of a group, at least; groups have less than twice as many.
GROUP = 2048
#: Share of a group's tokens that is cut into fillers, and a filler's tokens.
FILL, FILLER = 0.02, 64
TOKENIZER = "word_bpe_49k.json"
#: The token after each document.
END = 2
#: Distinct pieces whose tokens a process keeps; beyond it starts anew.
PIECES = 1 << 20
#: Pieces that are encoded as one text.
RUN = 256


#: Bytes by kind: 0 white space, 1 letters, 2 digits, 3 marks, 4 all others: what may be part of a contraction, a special token or beyond ASCII.
KIND = np.full(256, 4, np.uint8)
for _kind, _chars in ((0, " \t\n\x0b\x0c\r"), (1, "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~")):
    KIND[[ord(c) for c in _chars]] = _kind
#: Whether a text may be cut between bytes of two kinds, neither white space.
CUT = np.zeros((5, 5), bool)
CUT[1, 2:4] = CUT[2, 1:4] = CUT[3, 1:3] = True


def pieces(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and hashes of the pieces of all texts, and where each text's begin. Regions bound the memory in use; each ends where a text may be cut."""
    parts, low, high = [], int(offsets[0]), int(offsets[-1])
    while low < high:
        stop = min(low + K.REGION, high)
        while stop < high and (found := np.flatnonzero(KIND[data[stop : stop + K.REGION]] == 0)).size == 0:
            stop = min(stop + K.REGION, high)
        stop = stop + int(found[0]) if stop < high else high
        kind = KIND[data[low:stop]]
        forced = offsets[np.searchsorted(offsets, low) : np.searchsorted(offsets, stop)] - low
        cut = np.ones(len(kind) + 1, bool)
        cut[1:-1] = CUT.ravel().take(kind[:-1] * 5 + kind[1:]) | ((kind[:-1] == 0) != (kind[1:] == 0))
        cut[forced] = True
        at = np.flatnonzero(cut)
        start, end = at[:-1], at[1:]
        solid = kind[start] > 0
        start, end = start[solid], end[solid]
        up, down = K._Powers.of(len(kind) + 1)
        sums = np.zeros(len(kind) + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(K.BYTE_VALUES[data[low:stop]] * up[: len(kind)], out=sums[1:])
            hashes = K.mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))
        parts.append((start + low, end + low, hashes))
        low = stop
    start, end, hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    return start, end, hashes.astype(np.uint64), np.searchsorted(start, offsets)


class Encoder:
    """Token ids of many texts at once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        """Encode pieces, many as one text with blanks between; a token belongs to the piece that its first character is in."""
        runs = [texts[i : i + RUN] for i in range(0, len(texts), RUN)]
        found, count = [self.ids], []
        for run, encoding in zip(runs, self.tokenizer.encode_batch([" ".join(r) for r in runs], add_special_tokens=False), strict=True):
            begins = np.cumsum([0, *(len(x) + 1 for x in run)])
            found.append(np.array(encoding.ids, np.uint32))
            place = np.fromiter((a for a, _ in encoding.offsets), np.int64, len(encoding.ids))
            count.append(np.bincount(np.searchsorted(begins, place, "right") - 1, minlength=len(run)))
        count = np.concatenate(count)
        first = len(self.ids) + np.cumsum(count) - count
        known = np.concatenate((self.known, hashes))
        order = np.argsort(known, kind="stable")
        self.known, self.first, self.count = known[order], np.concatenate((self.first, first))[order], np.concatenate((self.count, count))[order]
        self.ids = np.concatenate(found)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and where each text's begin; a null text has none."""
        offsets, data = K.text_bytes(column)
        start, end, hashes, begins = pieces(offsets, data)
        if not len(hashes):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        code, distinct = pd.factorize(hashes)
        if len(self.known) > PIECES:
            self._forget()
        new = ~np.isin(distinct, self.known)
        if new.any():
            place = np.zeros(len(distinct), np.int64)
            place[code[::-1]] = np.arange(len(code))[::-1]  # where each stands first
            at = place[new]
            self._learn(distinct[new], [data[a:b].tobytes().decode() for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)])
        entry = np.searchsorted(self.known, distinct)
        first, count = self.first[entry][code], self.count[entry][code]
        upto = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=upto[1:])
        return self.ids[np.repeat(first - upto[:-1], count) + np.arange(upto[-1])], upto[begins]


#: A window's load, a number that tells windows apart, and what is in it: None, an item, or a pair of contents.
Window = tuple[int, int, object]


def _merged(a: list[Window], b: list[Window], windows: int) -> list[Window]:
    """Two partial partitions as one, the heaviest windows of one onto the lightest of the other. Lists are in ascending order, without empty windows."""
    if len(a) < len(b):
        a, b = b, a
    over = len(a) + len(b) - windows
    if len(b) == 1:
        (size, number, content) = b[0]
        if over > 0:
            load, number, own = a.pop(0)
            size, content = size + load, (own, content)
        insort(a, (size, number, content))
        return a
    both = [(x[0] + y[0], x[1], (x[2], y[2])) for x, y in zip(a[:over], reversed(b[:over]), strict=True)] if over > 0 else []
    over = max(over, 0)
    out = both + a[over:] + b[over:]
    out.sort()
    return out


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items (by place) of each window, by multiway differencing."""
    heap = [(-size, i, [(size, i, i)]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    number = len(sizes)
    while len(heap) > 1:
        wide = heapq.heappop(heap)[2]
        out = _merged(wide, heap[0][2], windows)
        spread = out[-1][0] - (out[0][0] if len(out) == windows else 0)
        heapq.heapreplace(heap, (-spread, number, out))
        number += 1
    result = []
    for _, _, content in heap[0][2] if heap else []:
        items, left = [], [content]
        while left:
            x = left.pop()
            if isinstance(x, tuple):
                left.extend(x)
            else:
                items.append(x)
        result.append(sorted(items))
    return result


def windows_of(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items of each window, in as few near-equal windows as keep within the capacity; every size is at most that."""
    windows = -(-sum(sizes) // capacity)
    while True:
        found = differencing(sizes, windows)
        over = max((sum(sizes[i] for i in w) for w in found), default=0) - capacity
        if over <= 0:
            return found
        windows += max(1, over * windows // capacity)


def with_fillers(sizes: list[int], share: float = FILL, filler: int = FILLER) -> list[tuple[int, int, int]]:
    """(item, start, size) of all remainders, the longest of which, up to that share of all, are cut into fillers."""
    left, out = share * sum(sizes), []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        step = filler if sizes[i] <= left else sizes[i]
        left -= sizes[i] if step == filler else 0
        out += [(i, at, min(step, sizes[i] - at)) for at in range(0, sizes[i], step)]
    return out


_FIELDS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


class _Packer:
    """Takes documents one by one, gives rows of pieces."""

    def __init__(self, first: int, capacity: int):
        self.next, self.capacity = first, capacity
        self.left: list[tuple] = []
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, whole = len(ids), len(ids) - len(ids) % self.capacity
        for at in range(0, whole, self.capacity):
            self.rows.append((doc_id, at, self.capacity, ids[at : at + self.capacity].tobytes(), total, self.next, 0))
            self.next += 1
        if whole < total:
            self.left.append((doc_id, whole, ids[whole:].copy(), total))

    def pack(self, n: int) -> None:
        group, self.left = self.left[:n], self.left[n:]
        parts = with_fillers([len(x[2]) for x in group])
        for window in windows_of([size for _, _, size in parts], self.capacity):
            offset = 0
            for i, at, size in (parts[k] for k in window):
                doc_id, start, ids, total = group[i]
                self.rows.append((doc_id, start + at, size, ids[at : at + size].tobytes(), total, self.next, offset))
                offset += size
            self.next += 1

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[]] * len(_FIELDS)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _FIELDS, strict=True)], names=[n for n, _ in _FIELDS])


def pack(docs: DataFrame, tokenizer: str | None = None, end: int | None = END, capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """A row for each piece: doc_id, start (its document's ids before it), length, ids (unsigned 32-bit, little-endian), doc_tokens (its document's ids), sequence_id, offset (there, gapless from 0).

    tokenizer: a file of the tokenizers library, by default TOKENIZER of the public ones, as each executor has it. end: an id after each document, or None.
    A null, empty or blank text has no id but the end. Without an end such documents have no piece. Each row of docs is a document, repeated ids too; a null doc_id stays null. Other columns are ignored; an empty table gives an empty one.
    Sequence ids are distinct, with gaps between tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        encoder = None
        packer = _Packer(TaskContext.get().partitionId() << 33, capacity)
        tail = np.array([] if end is None else [end], np.uint32)
        for whole in batches:
            for batch in slices(whole, "text"):
                encoder = encoder or Encoder(path)
                ids, at = encoder.encode(batch.column("text"))
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    packer.add(doc_id, np.concatenate((ids[a:b], tail)))
                while len(packer.left) >= 2 * group:
                    packer.pack(group)
                if packer.rows:
                    yield packer.take()
        packer.pack(len(packer.left))
        if packer.rows:
            yield packer.take()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 (unsigned) in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, capacity: int = CAPACITY, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens and ids: the pieces of each sequence one after another, padded to the capacity unless their number is a power of two. A group is one sequence, so bounded."""
    placed = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids")))).alias("p"), F.sum("length").alias("n_tokens"))
    lacking = F.when(F.bit_count("n_tokens") == 1, 0).otherwise(capacity - F.col("n_tokens")).cast("int")
    padding = F.repeat(F.lit(int(pad).to_bytes(4, "little").hex().upper()), lacking)
    return placed.select("sequence_id", "n_tokens", F.unhex(F.concat(F.array_join(F.transform("p", lambda x: x["ids"]), ""), padding)).alias("ids"))
