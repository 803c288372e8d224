"""Streaming forms of the counting and clustering operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.kmers import pieces


def running_spectrum(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, cnt) so far, in update or complete mode, of a stream of (read_id, seq)."""
    at = F.explode(F.expr(f"transform(sequence(1, length(piece) - {k - 1}), i -> substr(piece, i, {k}))"))
    return pieces(reads, k).select(at.alias("kmer")).groupBy("kmer").agg(F.count("*").alias("cnt"))


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Event-time clusters: (key, lo, hi, n) of events with gaps shorter than ``gap``."""
    grouped = events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return grouped.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("lo"), F.col("w.end").alias("hi"), "n")
