"""Reads, placements and paths: cutting, choosing, classifying."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequences import reverse_complement


def chunks(reads: DataFrame, size: int, overlap: int) -> DataFrame:
    """(read_id, start, seq): pieces of ``size`` that overlap; a piece is cut off while more than 2 * size - overlap symbols are left, the rest is the last."""
    step = size - overlap
    more = F.greatest(F.lit(0), F.ceil((F.length("seq") - (2 * size - overlap)) / step)).cast("int")
    rows = reads.withColumn("last", more).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("last"))))
    start = F.col("at") * step
    seq = F.when(F.col("at") < F.col("last"), F.substring("seq", start + 1, F.lit(size))).otherwise(F.substring("seq", start + 1, F.length("seq")))
    return rows.select("read_id", start.cast("long").alias("start"), seq.alias("seq"))


def split_header(header: Column) -> tuple[Column, Column]:
    """Id and comment of a record's header: up to the first space, and all after it (empty if there is none)."""
    at = F.instr(header, F.lit(" "))
    return F.when(at == 0, header).otherwise(F.left(header, at - 1)), F.when(at == 0, "").otherwise(F.substring(header, at + 1, F.length(header)))


def header_score(header: Column) -> Column:
    """The last word of a header as a number; null if it is none."""
    return F.try_element_at(F.split(header, " "), F.lit(-1)).try_cast("long")


def forward(lo: Column, hi: Column, size: Column, strand: Column) -> tuple[Column, Column]:
    """A range on the reverse strand in coordinates of the reversed target."""
    back = strand == "-"
    return F.when(back, size - hi).otherwise(lo), F.when(back, size - lo).otherwise(hi)


def regions(points: DataFrame, references: DataFrame, radius: int) -> DataFrame:
    """(key, seq): what lies within ``radius`` of a place, clamped to the reference."""
    both = points.join(references.select(F.col("read_id").alias("contig"), "seq"), "contig")
    lo, hi = F.greatest(F.col("pos") - radius, F.lit(0)), F.least(F.col("pos") + radius, F.length("seq"))
    return both.select("key", F.substring("seq", (lo + 1).cast("int"), F.greatest(hi - lo, F.lit(0)).cast("int")).alias("seq"))


def named_segment(references: DataFrame, asked: DataFrame) -> DataFrame:
    """(name, seq) of asked (name, lo, hi); a name that begins with - means the reverse strand, whose coordinates count from its own start."""
    rows = asked.withColumn("back", F.startswith("name", F.lit("-"))).withColumn("read_id", F.regexp_replace("name", "^-", ""))
    both = rows.join(references.select(F.col("read_id").cast("string").alias("read_id"), "seq"), "read_id")
    whole = F.when(F.col("back"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    return both.select("name", F.substring(whole, (F.col("lo") + 1).cast("int"), (F.col("hi") - F.col("lo")).cast("int")).alias("seq"))


def selected(placements: DataFrame) -> DataFrame:
    """Placements whose span is over max(max(len, 1000) - 1000, 3/4 len) of the read."""
    least = F.greatest(F.greatest("len", F.lit(1000)) - 1000, F.col("len") * 0.75)
    return placements.filter(F.col("hi") - F.col("lo") > least)


def best_placement(placements: DataFrame) -> DataFrame:
    """One placement for each read: those within 50 of the read's length first, then by identity, then by order."""
    near = F.col("hi") - F.col("lo") + 50 >= F.col("len")
    return placements.groupBy("read_id").agg(F.min_by("ord", F.struct((~near).alias("far"), (-F.col("identity")).alias("worse"), "ord")).alias("ord"))


def identity(matches: Column, a: Column, b: Column) -> Column:
    """Matches over the longer of both spans."""
    return matches / F.greatest(a, b)


def read_kinds(placements: DataFrame) -> DataFrame:
    """(kind, n) of reads (read_id, matched, errors, score): unaligned if nothing matched, perfect without errors, else bad
    with a score over 25,000, strange with any other positive score, nonperfect without."""
    kind = F.when(F.col("matched") == 0, "unaligned").when(F.col("errors") == 0, "perfect").when(F.col("score") > 25000, "bad").when(F.col("score") > 0, "strange").otherwise("nonperfect")
    return placements.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def error_histogram(placements: DataFrame, most: int = 30) -> DataFrame:
    return placements.groupBy(F.least("errors", F.lit(most)).cast("long").alias("errors")).agg(F.count("*").alias("n"))


def trimmed_tips(steps: DataFrame, least: int = 2) -> DataFrame:
    """Steps (read_id, i, cov, dangling) without a first or last one that is dangling and of low coverage; a read goes if any other step is low."""
    by = Window.partitionBy("read_id")
    low = F.col("cov") < least
    edge = (F.col("i") == F.min("i").over(by)) | (F.col("i") == F.max("i").over(by))
    kept = steps.withColumn("edge", edge).filter(~(F.col("edge") & F.col("dangling") & low))
    return kept.withColumn("worst", F.min("cov").over(by)).filter(F.col("worst") >= least).drop("edge", "worst")


def absorbed(labels: DataFrame, by: str = "src") -> DataFrame:
    """Labels of a vertex that are no prefix of another one there: in sorted order a prefix comes just before a label it begins."""
    after = F.lead("label").over(Window.partitionBy(by).orderBy("label"))
    return labels.select(by, "label").distinct().withColumn("after", after).filter(~F.coalesce(F.startswith("after", F.col("label")), F.lit(False))).drop("after")


def not_mirrored(edges: DataFrame) -> DataFrame:
    """Labels whose reverse complement is no label: none in a consistent graph of both strands."""
    return edges.select("label").join(edges.select(reverse_complement(F.col("label")).alias("label")), "label", "left_anti")


def mutual_best(pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) in which neither end has another partner."""
    lone = [pairs.groupBy(x).agg(F.count("*").alias("n")).filter("n = 1").select(x) for x in ("a", "b")]
    return pairs.join(lone[0], "a", "left_semi").join(lone[1], "b", "left_semi")


def coverage_drops(depth: DataFrame, ratio: int) -> DataFrame:
    """Places (by contig and pos) whose depth times a ratio is still under the greatest depth on either side: joints that reads do not support."""
    order = Window.partitionBy("contig").orderBy("pos")
    left = F.max("depth").over(order.rowsBetween(Window.unboundedPreceding, -1))
    right = F.max("depth").over(order.rowsBetween(1, Window.unboundedFollowing))
    return depth.withColumn("around", F.when(left.isNotNull() & right.isNotNull(), F.least(left, right))).filter(F.col("depth") * ratio < F.col("around")).drop("around")


def repetitive(counts: DataFrame, share: float) -> DataFrame:
    """k-mers with a count over the given quantile of all counts."""
    cut = counts.groupBy("cnt").agg(F.count("*").alias("n")).agg(F.expr(f"percentile(cnt, {share}, n)").alias("cut"))
    return counts.crossJoin(F.broadcast(cut)).filter(F.col("cnt") > F.col("cut")).drop("cut")


def default_threshold(mode: Column, k: Column) -> Column:
    """Least multiplicity of a frequent k-mer by kind of data and k; null for unknown kinds."""
    # 1 for assemblies; accurate reads 3 up to k = 25, then 1; noisy reads 20, 15, 10, 1 from k = 1, 100, 301, 401.
    accurate = F.when(k <= 25, 3).otherwise(1)
    noisy = F.when(k < 100, 20).when(k <= 300, 15).when(k <= 400, 10).otherwise(1)
    return F.when(mode == "assembly", 1).when(mode == "hifi", accurate).when(mode == "ont", noisy)
