"""Words and shingles of many texts at once, as numpy operations on their UTF-8 bytes.

A word's hash is polynomial over seeded random values of its bytes, modulo 2**64 and then mixed, from differences of one running sum; so no
Python object is made for a word. Every function covers whole texts; regions only bound the memory in use.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes for which the running sums are held at once.
REGION = 1 << 20
_R = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _R.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
BASE = 0x9E3779B97F4A7C15 | 1
STEP = U(0xD1342543DE82EF95)


def byte_class(separators: str) -> np.ndarray:
    """A table of 256 booleans: False for the given ASCII characters."""
    out = np.ones(256, bool)
    out[[ord(c) for c in separators]] = False
    return out


#: Words are what stands between white space.
SPACED = byte_class(" \t\n\x0b\x0c\r")
#: Words are ASCII letters and digits and all else beyond ASCII.
WORDY = byte_class("".join(chr(c) for c in range(128) if not chr(c).isalnum()))
#: Hash values by byte, A-Z as a-z or as they are.
FOLDED = BYTE_VALUES.copy()
FOLDED[65:91] = BYTE_VALUES[97:123]


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were needed so far."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, REGION + 4096)
            with np.errstate(over="ignore"):
                for name, base in (("up", BASE), ("down", pow(BASE, -1, 2**64))):
                    values = np.full(size, U(base))
                    values[0] = 1
                    setattr(cls, name, np.multiply.accumulate(values))
        return cls.up, cls.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of strings; a null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    column = column.fill_null("") if column.null_count else column
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    return at, np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)


def _region(data: np.ndarray, bounds: np.ndarray, is_word: np.ndarray, values: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    low, high = int(bounds[0]), int(bounds[-1])
    part = data[low:high]
    inside = is_word[part]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = bounds[1:-1] - low
    cuts = cuts[(cuts > 0) & (cuts < len(part))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if values is None:
        return start + low, end + low, np.zeros(0, np.uint64)
    up, down = _Powers.of(len(part) + 1)
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(values[part] * up[: len(part)], out=sums[1:])
    return start + low, end + low, mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def words(offsets: np.ndarray, data: np.ndarray, is_word: np.ndarray, values: np.ndarray | None = BYTE_VALUES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts, ends and hashes of all words, and where each text's words begin in them (one more than texts). No values: no hashes."""
    parts, text, n = [], 0, len(offsets) - 1
    with np.errstate(over="ignore"):
        while text < n:
            to = min(max(int(np.searchsorted(offsets, offsets[text] + REGION, "right")) - 1, text + 1), n)
            at, stop = int(offsets[text]), int(offsets[to])
            if stop - at <= REGION:
                parts.append(_region(data, offsets[text : to + 1], is_word, values))
            while stop - at > REGION:  # one long text: cut where no word is
                cut = at + REGION
                while cut < stop and (found := np.flatnonzero(~is_word[data[cut : min(cut + REGION, stop)]])).size == 0:
                    cut += REGION
                cut = min(stop, cut + int(found[0])) if cut < stop else stop
                parts.append(_region(data, np.array([at, cut]), is_word, values))
                at = cut
                if stop - at <= REGION and at < stop:
                    parts.append(_region(data, np.array([at, stop]), is_word, values))
            text = to
    start, end, hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(3))
    return start, end, hashes.astype(np.uint64), np.searchsorted(start, offsets)


def windows(hashes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a text, and where each text's begin. Texts of fewer than k words have none."""
    counts = np.diff(begins)
    n = np.maximum(counts - k + 1, 0)
    total = len(hashes) - k + 1
    at = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(n, out=at[1:])
    if total <= 0 or not at[-1]:
        return np.zeros(0, np.uint64), at
    with np.errstate(over="ignore"):
        run, factor = hashes[:total].copy(), U(1)
        for j in range(1, k):
            factor = factor * STEP
            run += hashes[j : j + total] * factor
    keep = np.arange(at[-1]) + np.repeat(begins[:-1] - at[:-1], n)
    return mix(run[keep]), at


def shingle_sets(hashes: np.ndarray, begins: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's sorted distinct k-word shingles, one after another, and where each text's begin; a text of 1 to k - 1 words has one, of all its words."""
    runs, at = windows(hashes, begins, k)
    counts = np.diff(begins)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if short.size:
        sizes = np.diff(at)
        sizes[short] = 1
        wider = np.zeros(len(at), np.int64)
        np.cumsum(sizes, out=wider[1:])
        out = np.empty(wider[-1], np.uint64)
        own = np.ones(len(out), bool)
        own[wider[short]] = False
        out[own] = runs
        with np.errstate(over="ignore"):
            for t in short:
                total, factor = U(counts[t]), U(1)
                for h in hashes[begins[t] : begins[t + 1]]:
                    total, factor = total + h * factor, factor * STEP
                out[wider[t]] = mix(np.array([total ^ U(0x5851F42D4C957F2D)]))[0]
        runs, at = out, wider
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        runs[a:b].sort()
    if not runs.size:
        return runs, at
    new = np.ones(len(runs), bool)
    new[1:] = runs[1:] != runs[:-1]
    new[at[:-1][np.diff(at) > 0]] = True
    kept = np.zeros(len(runs) + 1, np.int64)
    np.cumsum(new, out=kept[1:])
    return runs[new], kept[at]


def code_points(offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Before each byte, how many characters of the bytes from offsets[0] on."""
    low, high = int(offsets[0]), int(offsets[-1])
    out = np.zeros(high - low + 1, np.int64)
    np.cumsum((data[low:high] & 0xC0) != 0x80, out=out[1:])
    return out
