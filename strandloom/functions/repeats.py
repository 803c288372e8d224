"""Repeats of one and two symbols: compression with coordinates, dimers, occurrences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions.sequences import symbols


def shrink_dimers(seq: Column) -> Column:
    """Alternating runs ABAB... (also of one symbol) of over five symbols as four or five, parity kept."""
    return F.regexp_replace(seq, r"(.)(.)(?=\1\2\1\2)", "")


def run_starts(seq: Column) -> Column:
    """Places (from 0) at which runs of equal symbols begin: the coordinate map of a run-compressed sequence."""
    return F.filter(F.transform(symbols(seq), lambda x, i: F.when((i == 0) | (F.get(symbols(seq), i - 1) != x), i)), lambda x: x.isNotNull())


def uncompressed(seq: Column, starts: Column, lo: Column, hi: Column) -> Column:
    """What lies between two places of the compressed sequence, as it was."""
    return F.substring(seq, F.get(starts, lo) + 1, F.get(starts, hi) - F.get(starts, lo))


def compress_with_map(read: str, most: int) -> tuple[str, list[int]]:
    """Runs as one symbol, and after ``most`` alternations of two symbols no more of either: what is left, and its places in the read."""
    out, places = [], []
    for i, c in enumerate(read):
        if i and c == read[i - 1]:
            continue
        if len(out) > 2 * most and c in (out[-1], out[-2]):
            tail = out[1 - 2 * most :]
            if len(set(tail[::2])) <= 1 and len(set(tail[1::2])) <= 1:
                continue
        out.append(c)
        places.append(i)
    return "".join(out), places


def compressed_read(seq: Column, most: int) -> Column:
    """Struct (seq, places) of compress_with_map."""

    @F.pandas_udf("seq string, places array<int>")
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([("", []) if s is None else compress_with_map(s, most) for s in x], columns=["seq", "places"])

    return run(seq)


def dimer_repeats(seq: str, least: int = 10) -> list[tuple[int, int, str]]:
    """(start, multiplicity, dimer) of repeats of two symbols, left to right; one that is reported isn't entered again."""
    s = np.frombuffer(seq.encode(), np.uint8)
    if len(s) < 2:
        return []
    equal = np.r_[s[2:] == s[:-2], False, False]
    stop = np.flatnonzero(~equal)  # first place from which the symbol two on differs
    out, start = [], 0
    while start + 1 < len(s):
        end = int(stop[np.searchsorted(stop, start)])
        times = (end - start + 2) // 2
        if times >= least:
            out.append((start, times, seq[start : start + 2]))
            start += 1
        start += max(2 * times - 1, 1)
    return out


def dimers(seq: Column, least: int = 10) -> Column:
    @F.pandas_udf("array<struct<start: int, times: int, dimer: string>>")
    def run(x: pd.Series) -> pd.Series:
        return pd.Series([[] if s is None else [{"start": a, "times": n, "dimer": d} for a, n, d in dimer_repeats(s, least)] for s in x])

    return run(seq)


def dimer_code(seq: Column) -> Column:
    """Array of (dimer, times): a code goes on while a symbol equals the one two before; the next one begins with the two last symbols."""
    s = symbols(seq)
    n = F.length(seq)
    breaks = F.filter(F.transform(s, lambda x, i: F.when((i == 1) | ((i > 1) & (F.get(s, i - 2) != x)), i)), lambda x: x.isNotNull())
    following = F.concat(F.slice(breaks, 2, F.greatest(F.size(breaks), F.lit(1))), F.array(n))
    coded = F.zip_with(breaks, following, lambda a, b: F.struct(F.substring(seq, a, F.lit(2)).alias("dimer"), (b - a).alias("times")))
    return F.when(n >= 2, coded).otherwise(F.slice(coded, 1, 0))


def code_difference(a: Column, b: Column) -> Column:
    """How many codes differ in their number; null if the dimers are not the same."""
    same = (F.size(a) == F.size(b)) & ~F.exists(F.zip_with(a, b, lambda x, y: x["dimer"] != y["dimer"]), lambda x: x)
    return F.when(same, F.size(F.filter(F.zip_with(a, b, lambda x, y: x["times"] != y["times"]), lambda x: x)))


def dimer_around(seq: str, pos: int) -> int:
    """How often the two symbols at a place alternate around it, the second being the next other symbol on either side."""
    most = 0
    for way in (-1, 1):
        other = pos
        while 0 <= other < len(seq) and seq[other] == seq[pos]:
            other += way
        if not 0 <= other < len(seq):
            continue
        switches = 0
        for step in (-1, 1):
            at = pos
            while 0 < at < len(seq) - 1:
                following = seq[at + step]
                if following not in (seq[at], seq[pos], seq[other]):
                    break
                switches += following != seq[at]
                at += step
        most = max(most, switches // 2)
    return most


def dimer_multiplicity(seq: Column, pos: Column) -> Column:
    @F.pandas_udf("long")
    def run(s: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or pd.isna(i) or not 0 <= i < len(x) else dimer_around(x, int(i)) for x, i in zip(s, p, strict=True)], dtype="Int64")

    return run(seq, pos)


def occurrences(seq: Column, sub: str) -> Column:
    """All places of a part, overlapping ones too."""
    n = F.length(seq) - len(sub) + 1
    return F.when(n > 0, F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: F.substring(seq, i + 1, F.lit(len(sub))) == sub)).otherwise(F.array().cast("array<int>"))


def separate_occurrences(seq: Column, sub: str) -> Column:
    """How often a part occurs from left to right without overlaps."""
    return ((F.length(seq) - F.length(F.replace(seq, F.lit(sub), F.lit("")))) / len(sub)).cast("long")


def closest(values: Column, x: Column) -> Column:
    """The value of an array nearest to x, the smaller of two equally near ones."""
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - x).alias("far"), v.alias("value"))))["value"]


def longest_overlap(a: Column, b: Column) -> Column:
    """Length of the longest suffix of a that b begins with."""
    n = F.least(F.length(a), F.length(b))
    return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(0), n), lambda i: F.right(a, i) == F.left(b, i))), F.lit(0)).cast("long")


def longest_common(a: str, b: str) -> str:
    """Longest common substring, the first in a."""
    x, y = (np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in (a, b))
    row, best, end = np.zeros(len(y) + 1, np.int64), 0, 0
    for i, c in enumerate(x):
        new = np.zeros_like(row)
        new[1:] = np.where(y == c, row[:-1] + 1, 0)
        row = new
        if len(row) and row.max() > best:
            best, end = int(row.max()), i + 1
    return a[end - best : end]


def cigar_counts(parts: Column) -> Column:
    """Struct of a parsed CIGAR: symbols matched, differing, of the first and of the second sequence."""
    total = lambda ops: F.aggregate(F.filter(parts, lambda x: x["op"].isin(*ops)), F.lit(0).cast("long"), lambda acc, x: acc + x["len"])
    return F.struct(total("=").alias("matched"), total("XID").alias("differing"), total("=XMD").alias("first"), total("=XMI").alias("second"))


def polynomial_hash(seq: Column, base: int = 239) -> Column:
    """Polynomial hash of up to 7 symbols of ACGT, exact in 64 bits."""
    return F.aggregate(symbols(seq), F.lit(0).cast("long"), lambda acc, x: acc * base + F.instr(F.lit("ACGT"), x) - 1)


def rolled(hash_: Column, gone: Column, new: Column, k: int, base: int = 239) -> Column:
    """The hash one place on: without the first symbol and with a new last one."""
    code = lambda x: F.instr(F.lit("ACGT"), x) - 1
    return (hash_ - code(gone) * base ** (k - 1)) * base + code(new)


def mutated(seq: Column, rate: float, seed: Column) -> Column:
    """Each symbol replaced with probability ``rate`` by the next one of ACGT; what is replaced follows from the seed and the place."""
    hit = lambda i: F.pmod(F.xxhash64(seed, i), F.lit(1 << 20)) < int(rate * (1 << 20))
    return F.array_join(F.transform(symbols(seq), lambda x, i: F.when(hit(i), F.translate(x, "ACGT", "CGTA")).otherwise(x)), "")


def random_sequence(n: Column, seed: Column) -> Column:
    """n symbols of ACGT that follow from the seed."""
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(F.lit("ACGT"), F.pmod(F.xxhash64(seed, i), F.lit(4)).cast("int") + 1, F.lit(1))), "")).otherwise("")
