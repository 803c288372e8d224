"""k-mer operators on tables (read_id, seq)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import canonical
from strandloom.operators.shared import materialise, partitions

#: Symbols of a piece: long reads are cut, overlapping, so that no substring walks a whole read.
PIECE = 256
MULTIPLIER = 239
_CODES = np.full(256, 0, np.int64)
_CODES[[65, 67, 71, 84]] = (0, 1, 2, 3)


def spread(df: DataFrame) -> DataFrame:
    """More tasks than input splits: exploding makes rows many times larger."""
    return df.repartition(max(partitions(df.sparkSession), df.sparkSession.sparkContext.defaultParallelism))


def pieces(reads: DataFrame, k: int, step: int = PIECE) -> DataFrame:
    """(read_id, start, piece): overlapping by k - 1, so each k-mer is in one piece."""
    cut = reads.filter(F.length("seq") >= k).withColumn("start", F.explode(F.expr(f"sequence(0, length(seq) - {k}, {step})")))
    return cut.select("read_id", "start", F.expr(f"substr(seq, start + 1, {step + k - 1})").alias("piece"))


def kmers(reads: DataFrame, k: int) -> DataFrame:
    """(read_id, pos, kmer), pos from 0."""
    at = F.posexplode(F.expr(f"transform(sequence(1, length(piece) - {k - 1}), i -> substr(piece, i, {k}))"))
    return pieces(spread(reads), k).select("read_id", "start", at.alias("i", "kmer")).select("read_id", (F.col("start") + F.col("i")).alias("pos"), "kmer")


def spectrum(reads: DataFrame, k: int, both_strands: bool = False) -> DataFrame:
    """(kmer, cnt); with both strands each k-mer and its reverse complement count as one."""
    found = kmers(reads, k)
    return found.groupBy((canonical(F.col("kmer")) if both_strands else F.col("kmer")).alias("kmer")).agg(F.count("*").alias("cnt"))


def sequence_hashes(seq: bytes, k: int) -> np.ndarray:
    """Canonical polynomial hash of each k-mer: exact for k <= 8, modulo 2**64 beyond."""
    code = _CODES[np.frombuffer(seq, np.uint8)]
    n = len(code) - k + 1
    forward, backward = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    for j in range(k):
        part = code[j : j + n].astype(np.uint64)
        forward = forward * np.uint64(MULTIPLIER) + part
        backward += (np.uint64(3) - part) * np.uint64(pow(MULTIPLIER, j, 1 << 64))
    return np.minimum(forward, backward).view(np.int64)


def minimizers(reads: DataFrame, k: int, w: int) -> DataFrame:
    """(read_id, h): the distinct least hashes of windows, the first of w k-mers and all later ones of w + 1. Reads
    shorter than k + w - 1 have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for read, seq in zip(batch.column(0), batch.column(1).cast(pa.binary()), strict=True):
                data = seq.as_py() or b""
                if len(data) < k + w - 1:
                    continue
                h = sequence_hashes(data, k)
                found = [h[:w].min()[None]]
                if len(h) > w:
                    best, step = h, 1
                    while 2 * step <= w + 1:
                        best, step = np.minimum(best[:-step], best[step:]), 2 * step
                    n = len(h) - w
                    found.append(np.minimum(best[:n], best[w + 1 - step :][:n]))
                own = np.unique(np.concatenate(found))
                ids.append(pa.repeat(read, len(own)))
                out.append(own)
            if out:
                yield pa.RecordBatch.from_arrays([pc.cast(pa.concat_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in ids]), pa.int64()), pa.array(np.concatenate(out))], names=["read_id", "h"])

    return spread(reads.select(F.col("read_id").cast("long").alias("read_id"), "seq")).mapInArrow(run, "read_id long, h long")


def minimizer_set(reads: DataFrame, k: int, w: int) -> DataFrame:
    return minimizers(reads, k, w).select("h").distinct()


def junctions(reads: DataFrame, k: int) -> DataFrame:
    """Canonical k-mers whose left or right one-symbol extensions, over both strands, are not exactly one."""
    edges = spectrum(reads, k + 1, True).select(F.col("kmer").alias("e"))
    both = edges.unionByName(edges.select(F.reverse(F.translate("e", "ACGT", "TGCA")).alias("e"))).distinct()
    ends = both.select(F.expr(f"substr(e, 1, {k})").alias("kmer"), F.expr(f"substr(e, {k + 1}, 1)").alias("r"), F.lit(None).cast("string").alias("l")).unionByName(
        both.select(F.expr(f"substr(e, 2, {k})").alias("kmer"), F.lit(None).cast("string").alias("r"), F.expr("substr(e, 1, 1)").alias("l"))
    )
    counted = ends.groupBy("kmer").agg(F.count("r").alias("n_right"), F.count("l").alias("n_left"))
    return counted.filter("n_right <> 1 or n_left <> 1").select(canonical(F.col("kmer")).alias("kmer")).distinct()


def kmer_index(reads: DataFrame, low: int, high: int) -> DataFrame:
    """(k, kmer, cnt) for each k of a range."""
    out = None
    for k in range(low, high + 1):
        own = spectrum(reads, k).select(F.lit(k).alias("k"), "kmer", "cnt")
        out = own if out is None else out.unionByName(own)
    return out


def frequent(reads: DataFrame, k: int, least: int, rescue: int = 4) -> DataFrame:
    """k-mers with cnt >= least, and those with cnt >= min(rescue, least) between a read's first and last frequent one."""
    found = kmers(reads, k)
    counted = found.groupBy("kmer").agg(F.count("*").alias("cnt"))
    often = counted.filter(F.col("cnt") >= least)
    span = found.join(often.select("kmer"), "kmer", "left_semi").groupBy("read_id").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    some = counted.filter(F.col("cnt") >= min(rescue, least))
    inside = found.join(span, "read_id").filter("pos between a and b").select("kmer").distinct()
    return often.unionByName(some.join(inside, "kmer", "left_semi")).distinct()


def unique(reads: DataFrame, k: int) -> DataFrame:
    """(kmer, read_id, pos) of k-mers that occur once."""
    return kmers(reads, k).groupBy("kmer").agg(F.count("*").alias("cnt"), F.min("read_id").alias("read_id"), F.min("pos").alias("pos")).filter("cnt = 1").drop("cnt")


def anchors(edges: DataFrame, k: int, w: int) -> DataFrame:
    """Every w-th interior k-mer of sequences longer than w."""
    return kmers(edges.filter(F.length("seq") > w), k).filter((F.col("pos") > 0) & (F.col("pos") % w == 0)).select("read_id", "pos", "kmer")


def seed_offsets(reads: DataFrame, contigs: DataFrame, k: int, w: int) -> DataFrame:
    """Distinct (read_id, contig, offset) at which a read may lie on a contig: contig k-mers every w places against all read k-mers."""
    index = kmers(contigs, k).filter(F.col("pos") % w == 1).select("kmer", F.col("read_id").alias("contig"), F.col("pos").alias("cpos"))
    return kmers(reads, k).join(index, "kmer").select("read_id", "contig", (F.col("cpos") - F.col("pos")).alias("at")).distinct()


def _blocks(rows: DataFrame, key: str, member: str, most: int) -> DataFrame:
    """(key, tile, ids): the members of each key that has two at least, in lists of about ``most``."""
    sizes = rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key, F.ceil(F.col("n") / most).alias("tiles"))
    tiled = rows.join(sizes, key).withColumn("tile", F.pmod(F.xxhash64(member), "tiles"))
    return tiled.groupBy(key, "tile").agg(F.collect_list(member).alias("ids"))


def _pairs(blocks: DataFrame, key: str) -> DataFrame:
    """(key, a, b), a < b: all pairs of members of a key, by pairs of its lists, which are dealt out evenly before they are unfolded."""
    other = blocks.select(key, F.col("tile").alias("tile2"), F.col("ids").alias("ids2"))
    met = blocks.join(other, key).filter("tile <= tile2")
    met = spread(met).withColumn("x", F.explode("ids")).drop("ids").withColumn("y", F.explode("ids2"))
    return met.filter("tile < tile2 or x < y").select(key, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def shared_pairs(reads: DataFrame, k: int, tile: int = 512) -> DataFrame:
    """(a, b, n): all pairs a < b of sequences that share a k-mer, and how many distinct ones. Rows with one id are one sequence.

    Equal sequences are counted once, by the least id of their class, and named at the end; the pairs themselves are
    as many as the result has. No list that is unfolded is much longer than ``tile``."""
    spark = reads.sparkSession
    texts = reads.filter(F.col("read_id").isNotNull() & (F.length("seq") >= k))
    texts = texts.groupBy("read_id").agg(F.array_sort(F.collect_set("seq")).alias("seqs"))
    classes = texts.groupBy("seqs").agg(F.min("read_id").alias("rep"))
    member, _ = materialise(texts.join(classes, "seqs").select("read_id", "rep", F.when(F.col("read_id") == F.col("rep"), F.col("seqs")).alias("seqs")), "classes")
    reps = member.filter("read_id = rep").select(F.col("rep").alias("read_id"), F.explode("seqs").alias("seq"))
    own, _ = materialise(kmers(reps, k).select(F.col("read_id").alias("rep"), "kmer").distinct(), "kmers")
    found, _ = materialise(_pairs(_blocks(own, "kmer", "rep", tile), "kmer").groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    # back from classes to sequences
    sizes = member.groupBy("rep").agg(F.ceil(F.count("*") / tile).alias("tiles"))
    lists = member.join(sizes, "rep").groupBy("rep", F.pmod(F.xxhash64("read_id"), "tiles").alias("tile")).agg(F.collect_list("read_id").alias("ids"))
    sides = [lists.select(F.col("rep").alias(c), F.col("ids").alias(f"ids_{c}")) for c in ("a", "b")]
    across = spread(found.join(sides[0], "a").join(sides[1], "b").select("ids_a", "ids_b", "n"))
    across = across.withColumn("x", F.explode("ids_a")).drop("ids_a").withColumn("y", F.explode("ids_b"))
    across = across.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "n")
    within = _pairs(_blocks(member.select("read_id", "rep"), "rep", "read_id", tile), "rep").join(own.groupBy("rep").agg(F.count("*").alias("n")), "rep")
    return across.unionByName(within.select("a", "b", "n"))


def lookup(counts: DataFrame, asked: DataFrame) -> DataFrame:
    """(kmer, cnt) of the asked k-mers, 0 for those not there."""
    return asked.join(counts, "kmer", "left").select("kmer", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def whole_places(reads: DataFrame, contigs: DataFrame, seed: int = 20) -> DataFrame:
    """(read_id, contig, pos): first place of each contig (contig, seq) in each read that holds it whole.

    Contigs are looked up by their first ``seed`` symbols; for shorter ones there is a pass over the reads for each of the at most seed - 1 lengths. Empty contigs are nowhere."""
    short = [r[0] for r in contigs.filter(F.length("seq").between(1, seed - 1)).select(F.length("seq")).distinct().collect()]
    found = None
    for n in [*sorted(short), seed]:
        those = contigs.filter(F.length("seq") >= seed if n == seed else F.length("seq") == n).select("contig", F.col("seq").alias("cseq"), F.left("seq", F.lit(n)).alias("kmer"))
        part = kmers(reads, n).join(those, "kmer").select("read_id", "contig", "cseq", "pos")
        found = part if found is None else found.unionByName(part)
    return found.join(reads, "read_id").filter("substr(seq, pos + 1, length(cseq)) = cseq").groupBy("read_id", "contig").agg(F.min("pos").cast("long").alias("pos"))


def runs(reads: DataFrame) -> DataFrame:
    """(read_id, pos, symbol, run_len): runs of equal symbols, pos counted in runs."""
    coded = reads.select("read_id", F.posexplode(F.regexp_extract_all("seq", F.lit(r"((.)\2*)"), 1)).alias("pos", "run"))
    return coded.select("read_id", "pos", F.left("run", F.lit(1)).alias("symbol"), F.length("run").alias("run_len"))


def numbered(reads: DataFrame) -> Window:
    return Window.partitionBy("read_id").orderBy("pos")
