"""Polishing: runs of reads vote on the runs of compressed contigs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.kmers import runs
from strandloom.operators.stats import assembled, consensus_votes

_STEP = re.compile(r"(\d+)([=XIDMSHN])")


def _votes(seq: str, read_from: int, contig_from: int, cigar: str, margin: int) -> tuple[np.ndarray, ...]:
    """Places, symbols and lengths of a read's runs along the matched stretches of its alignment."""
    codes = np.frombuffer(seq.encode("utf-32-le"), np.uint32)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    lengths = np.diff(np.r_[starts, len(codes)])
    r, c, at, where = read_from, contig_from, [], []
    for n, op in _STEP.findall(cigar):
        n = int(n)
        if op in "=XM":
            if n > 2 * margin:
                at.append(np.arange(r + margin, r + n - margin))
                where.append(np.arange(c + margin, c + n - margin))
        r += n if op in "=XMIS" else 0
        c += n if op in "=XMDN" else 0
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
    at, where = np.concatenate(at), np.concatenate(where)
    fine = at < len(starts)  # an alignment that runs beyond its read has nothing to say there
    return where[fine], codes[starts[at[fine]]], lengths[at[fine]]


def run_votes(reads: DataFrame, alignments: DataFrame, margin: int = 0) -> DataFrame:
    """(contig, pos, symbol, run_len), a row for each run of a read (read_id, seq) that its alignment (read_id, contig, read_from, contig_from, cigar) of
    compressed sequences puts on a place of the contig; ``margin`` runs at both ends of a stretch have no vote. Nulls in any column: no votes."""
    rows = alignments.select("read_id", "contig", "read_from", "contig_from", "cigar").join(reads.select("read_id", "seq"), "read_id").dropna()
    kind = dict(alignments.dtypes)["contig"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["contig"]).to_pylist()):
                pos, symbol, length = _votes(row["seq"], row["read_from"], row["contig_from"], row["cigar"], margin)
                name = batch.column("contig").take(pa.array(np.full(len(pos), i, np.int64)))
                yield pa.RecordBatch.from_arrays([name, pa.array(pos, pa.int64()), pa.array([chr(x) for x in symbol], pa.string()), pa.array(length, pa.int32())], names=["contig", "pos", "symbol", "run_len"])

    return rows.select("contig", "read_from", "contig_from", "cigar", "seq").mapInArrow(run, f"contig {kind}, pos long, symbol string, run_len int")


def polished(contigs: DataFrame, votes: DataFrame) -> DataFrame:
    """(contig, seq): each run of a contig (contig, seq) as long as the lower median of the votes that agree on its symbol; without such votes a run is
    one symbol long."""
    places = runs(contigs.withColumnRenamed("contig", "read_id")).select(F.col("read_id").alias("contig"), F.col("pos").cast("long").alias("pos"), "symbol")
    voted = consensus_votes(votes.join(places, ["contig", "pos", "symbol"], "left_semi"))
    return assembled(places.join(voted, ["contig", "pos"], "left").withColumn("run_len", F.coalesce("run_len", F.lit(1))))
