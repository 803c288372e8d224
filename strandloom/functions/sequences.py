"""Column functions on sequences over a small alphabet."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"


def project(text: Column) -> Column:
    """Any text as a sequence over ACGT: letters only, by place in the alphabet modulo 4."""
    return F.translate(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), LETTERS, BASES)


def clean(seq: Column) -> Column:
    """Upper case, N as A."""
    return F.translate(F.upper(seq), "N", "A")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def canonical(seq: Column) -> Column:
    """The smaller of both strands."""
    return F.least(seq, reverse_complement(seq))


def compress_runs(seq: Column) -> Column:
    """Runs of a symbol as one symbol."""
    return F.regexp_replace(seq, r"(.)\1+", "$1")


def cap_dimers(seq: Column, most: int = 32) -> Column:
    """Alternating runs ABAB... longer than ``most`` symbols cut to it, parity kept."""
    if most < 4 or most % 2:
        raise ValueError("most must be even and at least 4")
    return F.regexp_replace(seq, r"((.)(?!\2)(.))\1{%d}(\1)*" % (most // 2 - 1), "$1" * (most // 2))


def symbols(seq: Column) -> Column:
    return F.filter(F.split(seq, ""), lambda x: x != "")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by doubling steps of whole comparisons."""
    n = F.least(F.length(a), F.length(b))
    differ = F.array_position(F.zip_with(symbols(F.left(a, n)), symbols(F.left(b, n)), lambda x, y: x != y), True)
    return F.when(differ == 0, n.cast("long")).otherwise(differ - 1)


def hamming(a: Column, b: Column) -> Column:
    """Differing places over the common length; ? matches anything."""
    n = F.least(F.length(a), F.length(b))
    pairs = F.zip_with(symbols(F.left(a, n)), symbols(F.left(b, n)), lambda x, y: (x != y) & (x != "?") & (y != "?"))
    return F.size(F.filter(pairs, lambda x: x))


def non_contradicting(a: Column, b: Column) -> Column:
    n = F.least(F.length(a), F.length(b))
    return F.left(a, n) == F.left(b, n)


def as_number(seq: Column) -> Column:
    """Base-4 value of up to 31 symbols."""
    return F.aggregate(symbols(seq), F.lit(0).cast("long"), lambda acc, x: acc * 4 + F.instr(F.lit("ACGT"), x) - 1)


def min_rotation(seq: Column) -> Column:
    """Smallest cyclic shift."""
    n = F.length(seq)
    return F.array_min(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(seq, i, n), F.left(seq, i - 1))))


def toggle_strand(name: Column) -> Column:
    """Names of reverse strands begin with -."""
    return F.when(F.startswith(name, F.lit("-")), F.substring(name, F.lit(2), F.length(name))).otherwise(F.concat(F.lit("-"), name))


def parse_cigar(cigar: Column) -> Column:
    """Array of (len, op)."""
    parts = F.regexp_extract_all(cigar, F.lit(r"(\d+[=XIDMSHN])"), 1)
    return F.transform(parts, lambda x: F.struct(F.substring(x, F.lit(1), F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))
