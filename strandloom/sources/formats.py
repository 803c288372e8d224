"""Readers and writers of sequence, graph and placement text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fasta(spark: SparkSession, *paths: str) -> DataFrame:
    """(read_id, comment, seq): records begin at >, lines of a sequence are joined; .gz by its name. The name ends at the first blank."""
    rows = spark.read.option("lineSep", "\n>").text(list(paths))
    record = F.regexp_replace("value", "^>", "")
    head = F.regexp_replace(F.element_at(F.split(record, "\n", 2), 1), "\r$", "")
    body = F.regexp_replace(F.coalesce(F.try_element_at(F.split(record, "\n", 2), F.lit(2)), F.lit("")), r"\s", "")
    out = rows.filter(F.trim("value") != "").select(head.alias("head"), body.alias("seq"))
    return out.select(F.element_at(F.split("head", " ", 2), 1).alias("read_id"), F.coalesce(F.try_element_at(F.split("head", " ", 2), F.lit(2)), F.lit("")).alias("comment"), "seq")


def _fastq_records(text: str) -> list[tuple[str, str, str, str]]:
    out, lines, at = [], text.splitlines(), 0
    while at < len(lines):
        if not lines[at].startswith("@"):
            at += 1
            continue
        name, _, comment = lines[at][1:].partition(" ")
        at, seq = at + 1, ""
        while at < len(lines) and not lines[at].startswith("+"):
            seq, at = seq + lines[at].strip(), at + 1
        at, quality = at + 1, ""
        while at < len(lines) and len(quality) < len(seq):
            quality, at = quality + lines[at].strip(), at + 1
        out.append((name, comment, seq, quality))
    return out


def read_fastq(spark: SparkSession, *paths: str) -> DataFrame:
    """(read_id, comment, seq, quality): sequences and qualities may be wrapped; a file is one task's work, as its records can't be told apart from its middle."""
    import gzip

    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = _fastq_records((gzip.decompress(content) if path.endswith(".gz") else content).decode())
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["read_id", "comment", "seq", "quality"])

    return spark.read.format("binaryFile").load(list(paths)).select("path", "content").mapInArrow(run, "read_id string, comment string, seq string, quality string")


def read_paf(spark: SparkSession, *paths: str) -> DataFrame:
    """Placements; on the reverse strand the target gets a - and its coordinates are mirrored in target_lo, target_hi."""
    c = F.split(F.trim("value"), r"\s+")
    num = lambda i: c[i].cast("long")
    rows = spark.read.text(list(paths)).filter(F.trim("value") != "").select(c[0].alias("query"), num(1).alias("qlen"), num(2).alias("qs"), num(3).alias("qe"), c[4].alias("strand"), c[5].alias("target"), num(6).alias("tlen"), num(7).alias("ts"), num(8).alias("te"))
    back = F.col("strand") == "-"
    return rows.withColumn("local", F.when(back, F.concat(F.lit("-"), "target")).otherwise(F.col("target"))).withColumn("target_lo", F.when(back, F.col("tlen") - F.col("te")).otherwise(F.col("ts"))).withColumn("target_hi", F.when(back, F.col("tlen") - F.col("ts")).otherwise(F.col("te")))


def read_bed(spark: SparkSession, *paths: str) -> DataFrame:
    """(contig, lo, hi); lines without three columns are left out."""
    c = F.split("value", r"\s+")
    return spark.read.text(list(paths)).filter((F.size(c) >= 3) & c[1].rlike(r"^\d+$") & c[2].rlike(r"^\d+$")).select(c[0].alias("contig"), c[1].cast("long").alias("lo"), c[2].cast("long").alias("hi"))


def read_gfa(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """Segments (name, seq, coverage) and links (a, a_strand, b, b_strand, overlap)."""
    rows = spark.read.text(list(paths)).select(F.split("value", "\t").alias("c"))
    segments = rows.filter(F.col("c")[0] == "S").select(F.col("c")[1].alias("name"), F.col("c")[2].alias("seq"), F.regexp_extract(F.coalesce(F.get("c", F.lit(3)), F.lit("")), r"^\w\w:\w:(.*)$", 1).cast("double").alias("coverage"))
    links = rows.filter(F.col("c")[0] == "L").select(F.col("c")[1].alias("a"), F.col("c")[2].alias("a_strand"), F.col("c")[3].alias("b"), F.col("c")[4].alias("b_strand"), F.regexp_extract(F.col("c")[5], r"(\d+)M", 1).cast("int").alias("overlap"))
    return segments, links


def read_alignments(spark: SparkSession, *paths: str) -> DataFrame:
    """(read, rs, re, contig, cs, ce, reverse): a - before the contig means the reverse strand."""
    c = F.split(F.trim("value"), r"\s+")
    return spark.read.text(list(paths)).filter(F.size(c) >= 6).select(c[0].alias("read"), c[1].cast("long").alias("rs"), c[2].cast("long").alias("re"), F.regexp_replace(c[3], "^-", "").alias("contig"), c[4].cast("long").alias("cs"), c[5].cast("long").alias("ce"), F.startswith(c[3], F.lit("-")).alias("reverse"))


def fasta_lines(name: Column, seq: Column, width: int = 0) -> Column:
    body = F.regexp_replace(seq, f"(.{{{width}}})(?=.)", "$1\n") if width else seq
    return F.concat(F.lit(">"), name, F.lit("\n"), body)


def write_fasta(df: DataFrame, path: str, name: Column, seq: Column, width: int = 0) -> None:
    df.select(fasta_lines(name, seq, width).alias("value")).write.text(path)


def edge_fasta(edges: DataFrame) -> DataFrame:
    """Edge records: header index_src_dst_len_cov."""
    beyond = F.length("label") - F.length("src")
    name = F.concat_ws("_", F.lit("e"), "src", "dst", beyond.cast("string"), F.col("cov").cast("string"))
    return edges.select(name.alias("name"), F.col("label").alias("seq"))


def gfa_lines(edges: DataFrame, k: int) -> DataFrame:
    """GFA 1: an S line for each edge, an L line for each way through a vertex."""
    name = F.concat_ws(">", "src", "dst")
    s = edges.select(F.concat_ws("\t", F.lit("S"), name, "label", F.concat(F.lit("KC:i:"), F.col("cov").cast("string"))).alias("value"))
    a, b = edges.select(F.col("dst").alias("v"), name.alias("a")), edges.select(F.col("src").alias("v"), name.alias("b"))
    link = a.join(b, "v").select(F.concat_ws("\t", F.lit("L"), "a", F.lit("+"), "b", F.lit("+"), F.lit(f"{k - 1}M")).alias("value"))
    return s.unionAll(link)


def dot_lines(edges: DataFrame, label: Column | None = None) -> DataFrame:
    text = label if label is not None else F.concat_ws(" ", F.length("label").cast("string"), F.col("cov").cast("string"))
    body = edges.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), text, F.lit('"]')).alias("value"))
    return body


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """The paths if all are there; raises with the names of those that are not."""
    conf = spark._jsc.sc().hadoopConfiguration()
    found = {p: spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths}
    missing = [p for p, x in found.items() if not x.getFileSystem(conf).exists(x)]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return list(paths)


def read_sequences(spark: SparkSession, *paths: str) -> DataFrame:
    """(read_id, comment, seq) of files by their names: .fastq, .fq, also .gz, as FASTQ, all others as FASTA."""
    quality = [p for p in paths if p.removesuffix(".gz").endswith((".fastq", ".fq"))]
    plain = [p for p in paths if p not in quality]
    out = [read_fastq(spark, *quality).drop("quality")] if quality else []
    out += [read_fasta(spark, *plain)] if plain else []
    return out[0] if len(out) == 1 else out[0].unionByName(out[1])


def read_bed_until_malformed(spark: SparkSession, *paths: str) -> DataFrame:
    """(contig, lo, hi) of each file's lines before the first one without three columns of that kind."""
    c = F.split("value", r"\s+")
    good = (F.size(c) >= 3) & F.get(c, F.lit(1)).rlike(r"^\d+$") & F.get(c, F.lit(2)).rlike(r"^\d+$")
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    rows = spark.read.text(list(paths)).select("value", F.col("_metadata.file_path").alias("file"), place.alias("place"), F.coalesce(good, F.lit(False)).alias("good"))
    first = rows.filter("not good").groupBy("file").agg(F.min("place").alias("first"))
    kept = rows.join(first, "file", "left").filter("first is null or place < first")
    return kept.select(c[0].alias("contig"), c[1].cast("long").alias("lo"), c[2].cast("long").alias("hi"))


def read_vertex_gfa(spark: SparkSession, *paths: str) -> tuple[DataFrame, DataFrame]:
    """A GFA whose segments are vertices: vertices (name, seq), edges (src, dst, overlap) on both strands, -name being the other one."""
    segments, links = read_gfa(spark, *paths)
    signed = lambda name, strand: F.when(F.col(strand) == "-", F.concat(F.lit("-"), name)).otherwise(F.col(name))
    turned = lambda name, strand: F.when(F.col(strand) == "-", F.col(name)).otherwise(F.concat(F.lit("-"), name))
    both = links.select(signed("a", "a_strand").alias("src"), signed("b", "b_strand").alias("dst"), "overlap").unionByName(links.select(turned("b", "b_strand").alias("src"), turned("a", "a_strand").alias("dst"), "overlap"))
    return segments.select("name", "seq"), both.distinct()


def write_numbers(df: DataFrame, path: str, column: str) -> None:
    """A list of numbers as text, one a line, under a folder; a line ``hashes N`` says how many."""
    numbers = df.select(F.col(column).cast("long").cast("string").alias("value"))
    numbers.unionAll(df.select(F.concat(F.lit("hashes "), F.count("*").cast("string")).alias("value"))).write.text(path)


def read_numbers(spark: SparkSession, path: str, column: str = "h") -> DataFrame:
    """The numbers of such a list; raises when they are not as many as it says. Lists without that line are read as they are."""
    rows = spark.read.text(path)
    said = rows.filter(F.startswith("value", F.lit("hashes "))).select(F.substring("value", 8, 20).cast("long").alias("n")).collect()
    out = rows.filter(~F.startswith("value", F.lit("hashes "))).select(F.col("value").cast("long").alias(column))
    if said and sum(r["n"] for r in said) != out.count():
        raise ValueError("the list is not complete")
    return out


def read_kmer_list(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.text(list(paths)).select(F.trim("value").alias("kmer")).filter("kmer <> ''").distinct()


def write_coverages(edges: DataFrame, path: str) -> None:
    """Coverages as text: label and coverage of each edge."""
    edges.select(F.concat_ws(" ", "label", F.col("cov").cast("string")).alias("value")).write.text(path)


def with_coverages(edges: DataFrame, path: str) -> DataFrame:
    """Edges with the coverages of such a file, 0 where it has none."""
    c = F.split("value", " ")
    saved = edges.sparkSession.read.text(path).select(c[0].alias("label"), c[1].cast("long").alias("saved"))
    return edges.drop("cov").join(saved, "label", "left").withColumn("cov", F.coalesce("saved", F.lit(0))).drop("saved")


def read_hmm(path: str):
    """A model file: numbers of events and states, then rows of transitions and of observations; arrays of probabilities."""
    import numpy as np

    with open(path, encoding="utf-8") as file:
        values = file.read().split()
    n, m = int(values[0]), int(values[1])
    numbers = np.array([float(x) for x in values[2 : 2 + m * m + m * n]])
    if len(numbers) != m * m + m * n:
        raise ValueError("the model file is not complete")
    return numbers[: m * m].reshape(m, m), numbers[m * m :].reshape(m, n)


def symbols_at(references: DataFrame, points: DataFrame) -> DataFrame:
    """(key, symbol) at places (key, contig, pos) of references; none beyond their ends."""
    both = points.join(references.select(F.col("read_id").alias("contig"), "seq"), "contig").filter("pos >= 0 and pos < length(seq)")
    return both.select("key", F.expr("substr(seq, cast(pos as int) + 1, 1)").alias("symbol"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """One edge of each pair of strands: the one whose label is not greater than its reverse complement."""
    from strandloom.functions.sequences import reverse_complement

    return edges.filter(F.col("label") <= reverse_complement(F.col("label")))


def edge_names(edges: DataFrame) -> DataFrame:
    """(name, seq) in the older form: the smaller strand of the source vertex, whether it is the vertex's own, and the first symbol beyond."""
    from strandloom.functions.sequences import canonical

    own = (F.col("src") == canonical(F.col("src"))).cast("int").cast("string")
    return edges.select(F.concat(canonical(F.col("src")), own, F.expr("substr(label, length(src) + 1, 1)")).alias("name"), F.col("label").alias("seq"))


def dot_by_component(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """(component, value): DOT lines of each component; write with partitionBy("component") for a file of each."""
    of = edges.join(parts.select(F.col("node").alias("src"), "component"), "src")
    text = F.concat_ws(" ", F.length("label").cast("string"), F.col("cov").cast("string"))
    return of.select("component", F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), text, F.lit('"]')).alias("value"))


def coloured_dot_lines(edges: DataFrame, colour: Column) -> DataFrame:
    """DOT lines of edges with a colour, then of the vertices that no covered edge touches, in yellow."""
    text = F.concat_ws(" ", F.length("label").cast("string"), F.col("cov").cast("string"))
    lines = edges.select(F.concat(F.lit('"'), "src", F.lit('" -> "'), "dst", F.lit('" [label="'), text, F.lit('" color="'), colour, F.lit('"]')).alias("value"))
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v"), "cov").groupBy("v").agg(F.max("cov").alias("top")).filter("top = 0")
    return lines.unionAll(ends.select(F.concat(F.lit('"'), "v", F.lit('" [style=filled fillcolor="yellow"]')).alias("value")))


def alignment_lines(paths: DataFrame) -> DataFrame:
    """Lines ``id start symbols`` of compact paths (read_id, src, symbols) and, as -id, of the same paths on the other strand."""
    from strandloom.functions.sequences import reverse_complement

    whole = reverse_complement(F.concat("src", "symbols"))
    n = F.length("src")
    own = paths.select(F.concat_ws(" ", F.col("read_id").cast("string"), "src", "symbols").alias("value"))
    other = paths.select(F.concat_ws(" ", F.concat(F.lit("-"), F.col("read_id").cast("string")), F.left(whole, n), F.substring(whole, n + 1, F.length("symbols"))).alias("value"))
    return own.unionAll(other)


def path_lines(steps: DataFrame, edges: DataFrame) -> DataFrame:
    """Lines of paths (read_id, i, label): the read and its edges' lengths and coverages in order."""
    both = steps.join(edges.select("label", F.concat_ws(":", F.length("label").cast("string"), F.col("cov").cast("string")).alias("x")), "label")
    by = both.groupBy("read_id").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p"))
    return by.select(F.concat_ws(" ", F.col("read_id").cast("string"), F.array_join(F.transform("p", lambda p: p["x"]), " ")).alias("value"))


def change_log(changes: DataFrame) -> DataFrame:
    """(read_id, at, before, after) of changed paths (read_id, old, new): what differs between their common beginning and end."""
    from strandloom.functions.sequences import common_prefix

    changed = changes.filter("old <> new").withColumn("at", common_prefix(F.col("old"), F.col("new")))
    rest = changed.select("read_id", "at", F.expr("substr(old, cast(at as int) + 1)").alias("a"), F.expr("substr(new, cast(at as int) + 1)").alias("b"))
    rest = rest.withColumn("tail", common_prefix(F.reverse("a"), F.reverse("b")))
    cut = lambda x: F.left(x, (F.length(x) - F.col("tail")).cast("int"))
    return rest.select("read_id", "at", cut("a").alias("before"), cut("b").alias("after"))


def vertex_gfa_lines(edges: DataFrame) -> DataFrame:
    """GFA 1 with vertices as segments: an S line for each vertex, an L line for each edge, whose overlap is what both ends share."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("v")).distinct()
    s = ends.select(F.concat_ws("\t", F.lit("S"), "v", "v").alias("value"))
    shared = F.length("src") + F.length("dst") - F.length("label")
    link = edges.select(F.concat_ws("\t", F.lit("L"), "src", F.lit("+"), "dst", F.lit("+"), F.concat(F.greatest(shared, F.lit(0)).cast("string"), F.lit("M"))).alias("value"))
    return s.unionAll(link)


def resolver_names(edges: DataFrame) -> DataFrame:
    """(name, seq): header edge_src_len_dst_len."""
    name = F.concat_ws("_", F.col("edge_id").cast("string"), "src", F.length("src").cast("string"), "dst", F.length("dst").cast("string"))
    return edges.select(name.alias("name"), F.col("label").alias("seq"))


def edge_labels(places: DataFrame, most: int = 10) -> DataFrame:
    """(edge, labels): the first names of what lies on an edge (edge, name), at most ``most`` as a legend shows them."""
    from pyspark.sql import Window

    first = places.distinct().withColumn("r", F.row_number().over(Window.partitionBy("edge").orderBy("name"))).filter(F.col("r") <= most)
    return first.groupBy("edge").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("labels"))


def save_graph(edges: DataFrame, path: str) -> None:
    edges.write.parquet(path)


def load_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def staged(spark: SparkSession, folder: str, stages: list) -> DataFrame:
    """Run named stages (name, function of the table before), each written under the folder; those already complete there are read again."""
    table = None
    for name, run in stages:
        path = f"{folder}/{name}"
        try:
            existing(spark, f"{path}/_SUCCESS")
        except FileNotFoundError:
            run(table).write.mode("overwrite").parquet(path)
        table = spark.read.parquet(path)
    return table
