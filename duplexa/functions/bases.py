"""Columns over nucleotide strings: masks, codes, counts, and sequences derived from any text."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

HARD, SOFT, NONE = 0, 1, 2


def from_text(text: Column) -> Column:
    """A sequence of A, C, G and U for any text: its ASCII letters in lower case, letter by letter; null stays null."""
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", "ACGUUGCAACGUGCUAUCAGGAUCCU")


def masked(seq: Column, mode: int = HARD) -> Column:
    """The sequence over A, C, G, U and N. HARD: lower case and all else become N. SOFT: lower-case bases stay in lower case; they can't seed. NONE: case doesn't count."""
    if mode == HARD:
        return F.regexp_replace(F.translate(seq, "T", "U"), "[^ACGU]", "N")
    if mode == SOFT:
        return F.regexp_replace(F.translate(seq, "Tt", "Uu"), "[^ACGUacgu]", "N")
    if mode == NONE:
        return F.regexp_replace(F.translate(F.upper(seq), "T", "U"), "[^ACGU]", "N")
    raise ValueError(f"repeat mode must be 0, 1 or 2, not {mode!r}")


def encoded_text(seq: Column, mode: int = HARD, target: bool = False) -> Column:
    """Codes as a string of digits, one a base: 0 at the end, 1 unknown, 2 to 5 A C G U, 6 to 9 lower-case ones. Targets run from their 3' end."""
    digits = F.translate(masked(seq, mode), "NACGUacgu", "123456789")
    return F.concat(F.reverse(digits) if target else digits, F.lit("0"))


def encoded(seq: Column, mode: int = HARD, target: bool = False) -> Column:
    """The codes of encoded_text as an array."""
    return F.transform(F.filter(F.split(encoded_text(seq, mode, target), ""), lambda c: c != ""), lambda c: c.cast("tinyint"))


def residue_count(seq: Column, mode: int = HARD) -> Column:
    """How many bases are known and not masked."""
    return F.length(F.regexp_replace(masked(seq, mode), "[^ACGU]", "")).cast("long")


def base_counts(seq: Column) -> list[Column]:
    return [F.regexp_count(F.upper(seq), F.lit(b)).cast("long").alias(f"n_{b.lower()}") for b in "ACGU"]


#: 0 unknown, 1 to 4 A C G U, by byte, whatever the case.
BASE_CODES = np.zeros(256, np.int64)
for _letter, _code in zip("ACGUTacgut", (1, 2, 3, 4, 4, 1, 2, 3, 4, 4), strict=True):
    BASE_CODES[ord(_letter)] = _code


def base_codes(seq: str) -> np.ndarray:
    """0 unknown, 1 to 4 A C G U, whatever the case; for kernels. A character beyond ASCII is one unknown base."""
    return BASE_CODES[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
