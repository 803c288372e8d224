"""Registered queries and their DuckDB equivalents, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import alignment as D
from strandloom.functions import sequences as S
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import kmers as K
from strandloom.operators import paths as P
from strandloom.operators import stats as A
from strandloom.operators.components import connected_components
from strandloom.sources import formats as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its own name, with the SQL that gives the same rows."""

    def add(run):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def seqs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), S.project(F.col("text")).alias("seq"))


def contigs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("read_id"), S.project(F.col("text")).alias("seq"))


def event_strings(spark: SparkSession, sf: str) -> DataFrame:
    """One symbol for each event of a user, in order."""
    rows = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", F.left("event_type", F.lit(1)).alias("c")))).alias("e"))
    return rows.select(F.col("user_id").alias("read_id"), F.array_join(F.transform("e", lambda x: x["c"]), "").alias("seq"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    low = F.col("l_partkey") % 1000
    return table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("contig"), low.alias("lo"), (low + F.col("l_quantity").cast("long")).alias("hi"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") % 100 + 1).alias("contig"), (F.col("p_size") * 20).cast("long").alias("pos"))


_MAP = "translate(lower(regexp_replace(text,'[^A-Za-z]','','g')),'abcdefghijklmnopqrstuvwxyz','ACGTACGTACGTACGTACGTACGTAC')"
SEQS = f"(SELECT doc_id AS read_id, {_MAP} AS seq FROM documents)"
CONTIGS = f"(SELECT item_id AS read_id, {_MAP} AS seq FROM benchmark)"
EVENTS = "(SELECT user_id AS read_id, string_agg(left(event_type,1),'' ORDER BY ts, event_id) AS seq FROM events GROUP BY user_id)"
SEGMENTS = "(SELECT l_suppkey AS contig, l_partkey % 1000 AS lo, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS hi, l_orderkey * 10 + l_linenumber AS key FROM lineitem)"
POINTS = "(SELECT p_partkey AS key, p_partkey % 100 + 1 AS contig, CAST(p_size * 20 AS BIGINT) AS pos FROM part)"


def KMERS(source: str, k: int) -> str:
    return f"(SELECT read_id, i AS pos, substr(seq, i + 1, {k}) AS kmer FROM (SELECT read_id, seq, unnest(range(0, length(seq) - {k - 1})) AS i FROM {source}))"


def SPECTRUM(source: str, k: int) -> str:
    return f"(SELECT kmer, count(*) AS cnt FROM {KMERS(source, k)} GROUP BY kmer)"


def EDGES(source: str, k: int) -> str:
    return f"(SELECT substr(kmer,1,{k - 1}) AS src, substr(kmer,2,{k - 1}) AS dst, kmer AS label, cnt AS cov FROM {SPECTRUM(source, k)})"


def DEGREES(edges: str) -> str:
    return f"(SELECT v, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out FROM (SELECT src AS v, 0 AS i, 1 AS o FROM {edges} UNION ALL SELECT dst, 1, 0 FROM {edges}) GROUP BY v)"


def RC(x: str) -> str:
    return f"reverse(translate({x},'ACGT','TGCA'))"


MERGED = f"(SELECT contig, min(lo) AS lo, max(hi) AS hi, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY contig ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {SEGMENTS})) GROUP BY contig, part)"
PAIRS = f"(SELECT x.read_id AS a, y.read_id AS b, x.seq AS s, y.seq AS t FROM {CONTIGS} x JOIN {CONTIGS} y ON y.read_id = x.read_id + 1)"


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    c = contigs(spark, sf)
    return c.select(F.col("read_id").alias("a"), (F.col("read_id") + 1).alias("b"), F.col("seq").alias("s")).join(c.select(F.col("read_id").alias("b"), F.col("seq").alias("t")), "b")


# sequence functions


@query(f"SELECT read_id, {RC('seq')} AS rc FROM {SEQS}")
def d1_revcomp(spark, sf):
    return seqs(spark, sf).select("read_id", S.reverse_complement(F.col("seq")).alias("rc"))


@query(f"SELECT s.read_id, coalesce(c, '') AS compressed FROM {SEQS} s LEFT JOIN (SELECT read_id, string_agg(kmer,'' ORDER BY pos) AS c FROM (SELECT *, lag(kmer) OVER (PARTITION BY read_id ORDER BY pos) AS p FROM {KMERS(SEQS, 1)}) WHERE p IS NULL OR p <> kmer GROUP BY read_id) x USING (read_id)")
def d2_homopolymer(spark, sf):
    return seqs(spark, sf).select("read_id", S.compress_runs(F.col("seq")).alias("compressed"))


@query(f"SELECT read_id, CAST(pos AS BIGINT) AS pos, CAST(sum(CASE WHEN p IS NULL OR p <> kmer THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS lifted FROM (SELECT *, lag(kmer) OVER (PARTITION BY read_id ORDER BY pos) AS p FROM {KMERS(CONTIGS, 1)})")
def d7_coord_lift(spark, sf):
    w = Window.partitionBy("read_id").orderBy("pos")
    new = F.when(F.col("kmer") == F.lag("kmer").over(w), 0).otherwise(1)
    rows = K.kmers(contigs(spark, sf), 1).withColumn("new", new)
    return rows.select("read_id", F.col("pos").cast("long").alias("pos"), (F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).alias("lifted"))


@query(f"SELECT a, b, coalesce(min(i) FILTER (WHERE substr(s, i + 1, 1) <> substr(t, i + 1, 1)), min(least(length(s), length(t)))) AS n FROM (SELECT *, unnest(range(0, least(length(s), length(t)))) AS i FROM {PAIRS}) GROUP BY a, b")
def d9_common_prefix(spark, sf):
    return pairs(spark, sf).select("a", "b", S.common_prefix(F.col("s"), F.col("t")).alias("n"))


@query(f"SELECT a, b, levenshtein(s, t) AS distance FROM {PAIRS}")
def d17_levenshtein(spark, sf):
    return pairs(spark, sf).select("a", "b", F.levenshtein("s", "t").cast("long").alias("distance"))


@query(f"SELECT a, b, CASE WHEN last = least_ THEN n ELSE first_ END AS n FROM (SELECT a, b, max(n) AS n, min(d) AS least_, arg_max(d, n) AS last, min(n) FILTER (WHERE d = m) AS first_ FROM (SELECT *, min(d) OVER (PARTITION BY a, b) AS m FROM (SELECT a, b, j AS n, levenshtein(s, left(t, j)) AS d FROM (SELECT *, CAST(unnest(range(0, length(t) + 1)) AS BIGINT) AS j FROM {PAIRS}))) GROUP BY a, b)")
def d18_best_prefix(spark, sf):
    return pairs(spark, sf).select("a", "b", D.best_prefix_length(F.col("s"), F.col("t")).alias("n"))


@query(f"SELECT a, b, count(*) FILTER (WHERE substr(s, i + 1, 1) <> substr(t, i + 1, 1)) AS n FROM (SELECT *, unnest(range(0, least(length(s), length(t)))) AS i FROM {PAIRS}) GROUP BY a, b")
def d23_hamming(spark, sf):
    return pairs(spark, sf).select("a", "b", S.hamming(F.col("s"), F.col("t")).cast("long").alias("n"))


@query(f"SELECT read_id, min(substr(seq, i, length(seq)) || left(seq, i - 1)) AS rotation FROM (SELECT read_id, seq, CAST(unnest(range(1, length(seq) + 1)) AS BIGINT) AS i FROM {CONTIGS}) GROUP BY read_id")
def d24_min_rotation(spark, sf):
    return contigs(spark, sf).filter("seq <> ''").select("read_id", S.min_rotation(F.col("seq")).alias("rotation"))


@query("SELECT a.l_orderkey, greatest(0, greatest(a.l_partkey, b.l_partkey) - least(a.l_partkey + CAST(a.l_quantity AS BIGINT), b.l_partkey + CAST(b.l_quantity AS BIGINT))) AS gap, greatest(a.l_partkey, b.l_partkey) < least(a.l_partkey + CAST(a.l_quantity AS BIGINT), b.l_partkey + CAST(b.l_quantity AS BIGINT)) AS meets, greatest(0, least(a.l_partkey + CAST(a.l_quantity AS BIGINT), b.l_partkey + CAST(b.l_quantity AS BIGINT)) - greatest(a.l_partkey, b.l_partkey)) AS common, greatest(a.l_partkey + CAST(a.l_quantity AS BIGINT), b.l_partkey + CAST(b.l_quantity AS BIGINT)) - least(a.l_partkey, b.l_partkey) AS united FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = 1 AND b.l_linenumber = 2")
def d30_segment_algebra(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("lo"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("hi"))
    both = rows.filter("l_linenumber = 1").drop("l_linenumber").join(rows.filter("l_linenumber = 2").select("l_orderkey", F.col("lo").alias("lo2"), F.col("hi").alias("hi2")), "l_orderkey")
    parts = I.segment_algebra(F.col("lo"), F.col("hi"), F.col("lo2"), F.col("hi2"))
    return both.select("l_orderkey", *[c.cast("long").alias(n) if n != "meets" else c.alias(n) for n, c in parts.items()])


@query(f"SELECT key, CAST(sum(hi - lo) OVER (PARTITION BY contig ORDER BY key, lo, hi ROWS UNBOUNDED PRECEDING) AS BIGINT) AS prefix FROM {SEGMENTS}")
def d31_prefix_sums(spark, sf):
    return A.prefix_sums(segments(spark, sf).withColumn("size", F.col("hi") - F.col("lo")), "contig", ["key", "lo", "hi"], "size").select("key", "prefix")


# filters


@query(f"SELECT read_id, length(seq) AS len FROM {SEQS} WHERE length(seq) >= 1000")
def c1_length_filter(spark, sf):
    return seqs(spark, sf).select("read_id", F.length("seq").cast("long").alias("len")).filter("len >= 1000")


@query(f"SELECT read_id, seq FROM {SEQS} WHERE seq <= {RC('seq')}")
def c4_canonical_only(spark, sf):
    return seqs(spark, sf).filter(F.col("seq") <= S.reverse_complement(F.col("seq")))


@query(f"SELECT read_id, substr(seq, 11, 50) AS part FROM {SEQS}")
def c5_subseq(spark, sf):
    return seqs(spark, sf).select("read_id", F.expr("substr(seq, 11, 50)").alias("part"))


# k-mers


@query(f"SELECT kmer, cnt FROM {SPECTRUM(SEQS, 7)}")
def e1_kmers(spark, sf):
    return K.spectrum(seqs(spark, sf), 7)


def _hash(x: str, k: int) -> str:
    return " + ".join(f"(instr('ACGT', substr({x}, {i + 1}, 1)) - 1) * CAST({239 ** (k - 1 - i)} AS BIGINT)" for i in range(k))


MINIMIZERS = f"""(WITH h AS (SELECT read_id, pos, least(f, r) AS h, count(*) OVER (PARTITION BY read_id) AS n FROM (SELECT read_id, pos, {_hash('kmer', 7)} AS f, {_hash(RC('kmer'), 7)} AS r FROM {KMERS(SEQS, 7)})),
    w AS (SELECT read_id, min(h) OVER (PARTITION BY read_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS h, pos, n FROM h)
    SELECT DISTINCT read_id, h FROM (SELECT read_id, h FROM w WHERE pos + 10 < n UNION ALL SELECT read_id, min(h) FROM h WHERE pos < 10 AND n >= 10 GROUP BY read_id))"""


@query(f"SELECT read_id, CAST(h AS BIGINT) AS h FROM {MINIMIZERS}")
def e2_minimizers(spark, sf):
    return K.minimizers(seqs(spark, sf), 7, 10)


@query(f"SELECT DISTINCT CAST(h AS BIGINT) AS h FROM {MINIMIZERS}")
def e3_minimizer_set(spark, sf):
    return K.minimizer_set(seqs(spark, sf), 7, 10)


_E10 = f"(SELECT DISTINCT e FROM (SELECT kmer AS e FROM {KMERS(SEQS, 10)} UNION ALL SELECT {RC('kmer')} FROM {KMERS(SEQS, 10)}))"


@query(f"SELECT DISTINCT least(kmer, {RC('kmer')}) AS kmer FROM (SELECT kmer, count(r) AS a, count(l) AS b FROM (SELECT substr(e, 1, 9) AS kmer, substr(e, 10, 1) AS r, NULL AS l FROM {_E10} UNION ALL SELECT substr(e, 2, 9), NULL, substr(e, 1, 1) FROM {_E10}) GROUP BY kmer) WHERE a <> 1 OR b <> 1")
def e4_junctions(spark, sf):
    return K.junctions(seqs(spark, sf), 9)


@query(" UNION ALL ".join(f"SELECT {k} AS k, kmer, cnt FROM {SPECTRUM(EVENTS, k)}" for k in (2, 3, 4)))
def e7_kmer_index(spark, sf):
    return K.kmer_index(event_strings(spark, sf), 2, 4)


@query(f"WITH m AS (SELECT * FROM {KMERS(CONTIGS, 5)}), c AS (SELECT kmer, count(*) AS cnt FROM m GROUP BY kmer), s AS (SELECT read_id, min(pos) AS a, max(pos) AS b FROM m WHERE kmer IN (SELECT kmer FROM c WHERE cnt >= 20) GROUP BY read_id) SELECT kmer, cnt FROM c WHERE cnt >= 20 OR (cnt >= 4 AND kmer IN (SELECT kmer FROM m JOIN s USING (read_id) WHERE pos BETWEEN a AND b))")
def e8_frequent_kmers(spark, sf):
    return K.frequent(contigs(spark, sf), 5, 20)


@query(f"SELECT kmer, min(read_id) AS read_id, CAST(min(pos) AS BIGINT) AS pos FROM {KMERS(SEQS, 11)} GROUP BY kmer HAVING count(*) = 1")
def e12_unique_kmers(spark, sf):
    return K.unique(seqs(spark, sf), 11).select("kmer", "read_id", F.col("pos").cast("long").alias("pos"))


@query(f"SELECT read_id, CAST(pos AS BIGINT) AS pos, kmer FROM {KMERS(SEQS, 15)} JOIN (SELECT read_id, length(seq) AS n FROM {SEQS}) USING (read_id) WHERE n > 50 AND pos > 0 AND pos % 50 = 0")
def e13_anchors(spark, sf):
    return K.anchors(seqs(spark, sf), 15, 50).withColumn("pos", F.col("pos").cast("long"))


# graphs


@query(f"SELECT src, dst, label, cov FROM {EDGES(EVENTS, 4)}")
def f11_dbg_edges(spark, sf):
    return G.edges_of(event_strings(spark, sf), 4)


@query(f"WITH e AS (SELECT * FROM {EDGES(EVENTS, 6)}), d AS (SELECT * FROM {DEGREES('e')}) SELECT src, dst, label, cov FROM e JOIN d a ON a.v = src JOIN d b ON b.v = dst WHERE cov >= 3 OR (a.n_in > 0 AND b.n_out > 0)")
def f11_tip_round(spark, sf):
    return G.without_tips(G.edges_of(event_strings(spark, sf), 6), 3)


def _language(spark, sf, lang):
    return table(spark, sf, "documents").filter(F.col("lang") == lang).select(F.col("doc_id").alias("read_id"), S.project(F.col("text")).alias("seq"))


_LANG = lambda x: f"(SELECT doc_id AS read_id, {_MAP} AS seq FROM documents WHERE lang = '{x}')"


@query(f"SELECT kmer, CASE WHEN b.cnt IS NULL THEN 'first' WHEN a.cnt IS NULL THEN 'second' ELSE 'both' END AS color, coalesce(a.cnt, 0) AS cnt_a, coalesce(b.cnt, 0) AS cnt_b FROM {SPECTRUM(_LANG('en'), 8)} a FULL JOIN {SPECTRUM(_LANG('fr'), 8)} b USING (kmer)")
def f13_three_color(spark, sf):
    return G.three_colors(_language(spark, sf, "en"), _language(spark, sf, "fr"), 8)


#: Customers tied to one a few numbers on, within blocks of fifty: as many components as blocks.
BLOCKS = "(SELECT c_custkey AS src, least(c_custkey + 1 + c_nationkey % 3, c_custkey - c_custkey % 50 + 49) AS dst FROM customer)"


def customer_blocks(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey").cast("long")
    return table(spark, sf, "customer").select(key.alias("src"), F.least(key + 1 + F.col("c_nationkey") % 3, key - key % 50 + 49).alias("dst"))


@query(f"WITH RECURSIVE s AS (SELECT src AS a, dst AS b FROM {BLOCKS} UNION SELECT dst, src FROM {BLOCKS}), r AS (SELECT a AS node, a AS top FROM s UNION SELECT s.b, r.top FROM r JOIN s ON r.node = s.a) SELECT CAST(node AS BIGINT) AS node, CAST(min(top) AS BIGINT) AS component FROM r GROUP BY node")
def h4_components(spark, sf):
    return connected_components(customer_blocks(spark, sf))


@query(f"SELECT v, n_in, n_out FROM {DEGREES(EDGES(EVENTS, 5))} WHERE n_in > 1 AND n_out > 1")
def h15_complex_nodes(spark, sf):
    return G.complex_vertices(G.edges_of(event_strings(spark, sf), 5))


def CONTRACTED(source: str, k: int) -> str:
    """Unbranching paths by recursion along the edges. Pure cycles, which the given tables have none of, are left out."""
    return f"""(WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES(source, k)}), inner_ AS MATERIALIZED (SELECT v FROM {DEGREES('e')} WHERE n_in = 1 AND n_out = 1),
        lin AS (SELECT src, dst, label, cov, 1 AS n, label AS last FROM e WHERE src NOT IN (SELECT v FROM inner_)
                UNION ALL SELECT l.src, e.dst, l.label || right(e.label, 1), l.cov + e.cov, l.n + 1, e.label FROM lin l JOIN e ON e.src = l.dst WHERE l.dst IN (SELECT v FROM inner_))
        SELECT src, dst, label, CAST(cov AS BIGINT) AS cov, CAST(n AS BIGINT) AS n FROM lin WHERE dst NOT IN (SELECT v FROM inner_))"""


@query(f"SELECT src, dst, label, cov, n FROM {CONTRACTED(CONTIGS, 12)}")
def h2_contract(spark, sf):
    return G.contract(G.edges_of(contigs(spark, sf), 12))


@query(f"SELECT least(n_in, 4) AS n_in, least(n_out, 4) AS n_out, count(*) AS n FROM {DEGREES(EDGES(EVENTS, 5))} GROUP BY ALL")
def i3_inout_matrix(spark, sf):
    return G.degree_matrix(G.edges_of(event_strings(spark, sf), 5)).select(F.col("n_in").cast("long").alias("n_in"), F.col("n_out").cast("long").alias("n_out"), "n")


@query(f"SELECT least(cov, 200) AS cov, count(*) AS n, CAST(sum(length(label)) AS BIGINT) AS total FROM {EDGES(SEQS, 9)} GROUP BY ALL")
def i4_cov_hist(spark, sf):
    return G.coverage_histogram(G.edges_of(seqs(spark, sf), 9))


@query(f"SELECT CAST(least(ceil(length(seq) / 500.0), 20) AS BIGINT) AS bucket, count(*) AS n FROM {SEQS} GROUP BY ALL")
def i5_histogram(spark, sf):
    return A.histogram(seqs(spark, sf), F.length("seq"), 500, 20)


@query(f"SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total, (SELECT max(len) FROM (SELECT len, sum(len) OVER (ORDER BY len DESC) AS cum, sum(len) OVER () AS t FROM (SELECT length(seq) AS len FROM {SEQS})) WHERE cum >= t * 0.5) AS ng FROM (SELECT length(seq) AS len FROM {SEQS})")
def i8_ng50(spark, sf):
    return A.ng(seqs(spark, sf).select(F.length("seq").cast("long").alias("len")))


@query(f"SELECT n, CAST(total AS BIGINT) AS total, len AS median FROM (SELECT length(seq) AS len, row_number() OVER (ORDER BY length(seq)) AS k, count(*) OVER () AS n, sum(length(seq)) OVER () AS total FROM {SEQS}) WHERE k = n // 2 + 1")
def i10_length_stats(spark, sf):
    return A.upper_median(seqs(spark, sf).select(F.length("seq").cast("long").alias("len")), "len")


@query(f"SELECT contig, max(hi - lo) AS span FROM {SEGMENTS} GROUP BY contig")
def i11_best_span(spark, sf):
    return A.best_span(segments(spark, sf), "contig")


@query("SELECT name, CAST(sum(i) AS BIGINT) AS n_in, CAST(sum(o) AS BIGINT) AS n_out, bool_or(c) AS circular FROM (SELECT l_suppkey AS name, 0 AS i, 1 AS o, l_suppkey = l_partkey % 100 AS c FROM lineitem UNION ALL SELECT l_partkey % 100, 1, 0, l_suppkey = l_partkey % 100 FROM lineitem) GROUP BY name")
def i12_degree_stats(spark, sf):
    return G.segment_degrees(table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") % 100).alias("b")))


@query("SELECT sum(l_quantity * l_linenumber) / CAST(sum(l_linenumber) AS DOUBLE) AS mean FROM lineitem")
def i18_weighted_cov(spark, sf):
    return A.weighted_mean(table(spark, sf, "lineitem"), "l_quantity", "l_linenumber")


RUNS = f"(SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY g) - 1 AS pos, symbol, run_len FROM (SELECT read_id, g, any_value(kmer) AS symbol, count(*) AS run_len FROM (SELECT *, sum(CASE WHEN p IS NULL OR p <> kmer THEN 1 ELSE 0 END) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, lag(kmer) OVER (PARTITION BY read_id ORDER BY pos) AS p FROM {KMERS(SEQS, 1)})) GROUP BY read_id, g))"


@query(f"SELECT lang AS contig, CAST(pos AS BIGINT) AS pos, CAST(quantile_disc(run_len, 0.5) AS INTEGER) AS run_len FROM {RUNS} JOIN documents ON doc_id = read_id GROUP BY lang, pos")
def i19_vote_median(spark, sf):
    votes = K.runs(K.spread(seqs(spark, sf))).join(table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), F.col("lang").alias("contig")), "read_id")
    return A.consensus_votes(votes).withColumn("pos", F.col("pos").cast("long"))


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def i20_dedup_last(spark, sf):
    return A.last_by(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value")


@query("SELECT user_id, min_by(event_type, event_id) AS event_type, min_by(value, event_id) AS value FROM events GROUP BY user_id")
def i20_dedup_first(spark, sf):
    return A.first_by(table(spark, sf, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id").select("user_id", "event_type", "value")


# joins


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def j5_semi(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").filter("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 48)")
def j6_anti(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey").join(table(spark, sf, "lineitem").filter("l_quantity > 48"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")


@query(f"WITH m AS (SELECT DISTINCT read_id, kmer FROM {KMERS(CONTIGS, 8)}), r AS (SELECT x.read_id AS a, y.read_id AS b, count(*) AS n FROM m x JOIN m y ON x.kmer = y.kmer AND x.read_id < y.read_id GROUP BY ALL) SELECT * FROM r")
def j8_shared_kmer_pairs(spark, sf):
    return K.shared_pairs(contigs(spark, sf), 8)


@query(f"SELECT p.key, count(*) AS n FROM {POINTS} p JOIN {SEGMENTS} s ON p.contig = s.contig AND lo <= pos AND pos < hi GROUP BY p.key")
def j9_point_in_interval(spark, sf):
    return I.points_in(points(spark, sf), segments(spark, sf).drop("key")).groupBy("key").agg(F.count("*").alias("n"))


def _flagged(spark, sf, flag):
    low = F.col("l_partkey") % 1000
    return table(spark, sf, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_suppkey").alias("contig"), low.alias("lo"), (low + F.col("l_quantity").cast("long")).alias("hi"))


@query("WITH s AS (SELECT l_suppkey AS contig, l_partkey % 1000 AS lo, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS hi, l_returnflag AS f FROM lineitem) SELECT a.contig, count(*) AS n, CAST(sum(least(a.hi, b.hi) - greatest(a.lo, b.lo)) AS BIGINT) AS total FROM s a JOIN s b ON a.contig = b.contig AND a.lo < b.hi AND b.lo < a.hi WHERE a.f = 'R' AND b.f = 'A' GROUP BY a.contig")
def j10_interval_overlap(spark, sf):
    both = I.overlaps(_flagged(spark, sf, "R"), _flagged(spark, sf, "A"))
    return both.groupBy("contig").agg(F.count("*").alias("n"), F.sum(F.least("hi", "hi2") - F.greatest("lo", "lo2")).alias("total"))


@query(f"SELECT contig, count(*) AS n FROM {SEGMENTS} WHERE lo < 500 AND 500 < hi GROUP BY contig")
def j11_stab(spark, sf):
    return segments(spark, sf).filter("lo < 500 and 500 < hi").groupBy("contig").agg(F.count("*").alias("n"))


@query(f"SELECT key FROM {POINTS} p WHERE NOT EXISTS (SELECT 1 FROM {SEGMENTS} s WHERE s.contig = p.contig AND lo <= pos AND pos < hi)")
def j12_uncovered_points(spark, sf):
    return I.uncovered_points(points(spark, sf), segments(spark, sf).drop("key"), "key").select("key")


@query(f"SELECT key FROM {POINTS} p WHERE EXISTS (SELECT 1 FROM {SEGMENTS} s WHERE s.contig = p.contig AND abs(lo - pos) <= 2)")
def j13_band(spark, sf):
    return I.band_semi(points(spark, sf), segments(spark, sf).select("contig", F.col("lo").alias("pos")), 2).select("key")


@query("SELECT p_brand, CASE WHEN l_quantity = p_size THEN 'same' WHEN l_quantity > p_size THEN 'more' ELSE 'less' END AS kind, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def j14_classify(spark, sf):
    kind = F.when(F.col("l_quantity") == F.col("p_size"), "same").when(F.col("l_quantity") > F.col("p_size"), "more").otherwise("less")
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT o_custkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey, l_linenumber) AS place FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def j15_ordered_join(spark, sf):
    both = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate").join(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), F.col("o_orderkey") == F.col("l_orderkey"))
    return both.select("o_custkey", "l_orderkey", "l_linenumber", G.ranked_by("o_custkey", "o_orderdate", "o_orderkey", "l_linenumber").cast("long").alias("place"))


# windows and sets


@query("SELECT event_id, m AS least FROM (SELECT event_id, min(value) OVER w AS m, count(*) OVER w AS k FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5")
def k1_sliding_min(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(0, 4)
    return table(spark, sf, "events").select("event_id", F.min("value").over(w).alias("least"), F.count("*").over(w).alias("k")).filter("k = 5").drop("k")


@query("SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity ROWS UNBOUNDED PRECEDING) AS cum FROM lineitem")
def k5_cumulative(spark, sf):
    return A.prefix_sums(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), "l_orderkey", ["l_linenumber", "l_quantity"], "l_quantity").select("l_orderkey", "l_linenumber", F.col("prefix").alias("cum"))


@query(f"SELECT key, lo - max(hi) OVER (PARTITION BY contig ORDER BY lo, hi, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM {SEGMENTS}")
def k6_last_to_end(spark, sf):
    w = Window.partitionBy("contig").orderBy("lo", "hi", "key").rowsBetween(Window.unboundedPreceding, -1)
    return segments(spark, sf).select("key", (F.col("lo") - F.max("hi").over(w)).alias("since"))


@query(f"WITH e AS (SELECT contig, pos, sum(d) AS d FROM (SELECT contig, lo AS pos, 1 AS d FROM {SEGMENTS} UNION ALL SELECT contig, hi, -1 FROM {SEGMENTS}) GROUP BY ALL), s AS (SELECT contig, pos, sum(d) OVER (PARTITION BY contig ORDER BY pos) AS depth, lead(pos) OVER (PARTITION BY contig ORDER BY pos) AS fin FROM e), t AS (SELECT *, coalesce(lag(depth) OVER (PARTITION BY contig ORDER BY pos), 0) AS bef FROM s), p AS (SELECT *, sum(CASE WHEN bef = 0 AND depth > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY contig ORDER BY pos) AS part FROM t) SELECT contig, min(pos) AS lo, max(fin) AS hi, CAST(max(depth) AS BIGINT) AS top FROM p WHERE depth > 0 GROUP BY contig, part HAVING max(depth) > 3")
def k7_depth_islands(spark, sf):
    return I.depth_islands(segments(spark, sf), 3)


@query(f"SELECT contig, lo, hi FROM (SELECT contig, coalesce(lag(hi) OVER (PARTITION BY contig ORDER BY lo), 0) AS lo, lo AS hi FROM {MERGED}) WHERE lo < hi")
def k8_uncovered_regions(spark, sf):
    return I.uncovered(segments(spark, sf))


@query(f"SELECT contig, max(t) AS covered, max(size) AS largest, count(*) FILTER (WHERE cum * 100 < t * 95) + 1 AS n FROM (SELECT contig, size, CAST(sum(size) OVER (PARTITION BY contig ORDER BY size DESC, lo ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cum, CAST(sum(size) OVER (PARTITION BY contig) AS BIGINT) AS t FROM (SELECT contig, lo, hi - lo AS size FROM {MERGED})) GROUP BY contig")
def k9_cover95(spark, sf):
    return A.covered_share(I.merged(segments(spark, sf)), "contig")


@query(f"SELECT contig, min(lo) AS lo, max(lo) AS hi, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY lo ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT contig, lo, CASE WHEN lo - lag(lo) OVER (PARTITION BY contig ORDER BY lo) <= 2 THEN 0 ELSE 1 END AS new FROM {SEGMENTS})) GROUP BY contig, part HAVING count(*) >= 4")
def k10_gap_clusters(spark, sf):
    return I.clusters(segments(spark, sf).select("contig", F.col("lo").alias("pos")), 2, 4)


@query(f"SELECT contig, lo, hi, n FROM {MERGED}")
def k11_merge_segments(spark, sf):
    return I.merged(segments(spark, sf))


@query("SELECT event_id, max(CASE WHEN value > 50 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, min(CASE WHEN value > 50 THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after FROM events")
def k12_prev_next_reliable(spark, sf):
    return A.reliable_neighbours(table(spark, sf, "events"), "user_id", "event_id", F.col("value") > 50).select("event_id", "before", "after")


@query(f"SELECT key, m AS mean FROM (SELECT key, avg(hi - lo) OVER w AS m, count(*) OVER w AS k FROM {SEGMENTS} WINDOW w AS (PARTITION BY contig ORDER BY key, lo, hi ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) WHERE k = 4")
def k14_running_mean(spark, sf):
    return A.running_mean(segments(spark, sf).withColumn("size", F.col("hi") - F.col("lo")), "contig", ["key", "lo", "hi"], "size", 4).select("key", "mean")


@query(f"SELECT read_id, length(seq) AS len FROM {SEQS} ORDER BY len DESC, read_id LIMIT 100")
def k15_topk(spark, sf):
    return seqs(spark, sf).select("read_id", F.length("seq").cast("long").alias("len")).orderBy(F.desc("len"), "read_id").limit(100)


@query("SELECT n, count(*) AS c FROM (SELECT c_nationkey AS n FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY n")
def k20_union_all(spark, sf):
    both = table(spark, sf, "customer").select(F.col("c_nationkey").alias("n")).unionAll(table(spark, sf, "supplier").select(F.col("s_nationkey").alias("n")))
    return both.groupBy("n").agg(F.count("*").alias("c"))


@query(f"SELECT kmer FROM {KMERS(_LANG('en'), 8)} INTERSECT SELECT kmer FROM {KMERS(_LANG('de'), 8)}")
def k21_intersect(spark, sf):
    return K.spectrum(_language(spark, sf, "en"), 8).select("kmer").intersect(K.spectrum(_language(spark, sf, "de"), 8).select("kmer"))


@query(f"SELECT kmer FROM {KMERS(_LANG('en'), 8)} EXCEPT SELECT kmer FROM {KMERS(_LANG('de'), 8)}")
def k21_except(spark, sf):
    return K.spectrum(_language(spark, sf, "en"), 8).select("kmer").subtract(K.spectrum(_language(spark, sf, "de"), 8).select("kmer"))


# alignment, correction, consensus


@query(f"SELECT substr(kmer, 1, 2) AS prefix, CAST(sum(cnt) AS BIGINT) AS n FROM {SPECTRUM(EVENTS, 5)} GROUP BY ALL")
def g13_count_prefix(spark, sf):
    return K.spectrum(event_strings(spark, sf), 5).groupBy(F.expr("substr(kmer, 1, 2)").alias("prefix")).agg(F.sum("cnt").alias("n"))


@query(f"SELECT DISTINCT r.read_id, c.read_id AS contig, CAST(c.pos - r.pos AS BIGINT) AS \"at\" FROM {KMERS(SEQS, 15)} r JOIN {KMERS(CONTIGS, 15)} c ON r.kmer = c.kmer AND c.pos % 5 = 1")
def g25_seed_offsets(spark, sf):
    return K.seed_offsets(seqs(spark, sf), contigs(spark, sf), 15, 5).withColumn("at", F.col("at").cast("long"))


@query(f"SELECT r.read_id, c.read_id AS contig, CAST(instr(r.seq, c.seq) - 1 AS BIGINT) AS pos FROM {SEQS} r JOIN {CONTIGS} c ON instr(r.seq, c.seq) > 0 WHERE c.seq <> ''")
def g26_exact_containment(spark, sf):
    return K.whole_places(seqs(spark, sf), contigs(spark, sf).withColumnRenamed("read_id", "contig"))


_LABELS = f"(SELECT left(label, 3) AS src, right(label, 3) AS dst, label, count(*) AS cov FROM (SELECT substr(seq, i + 1, 7) AS label FROM (SELECT seq, unnest(range(0, length(seq) - 6)) AS i FROM {EVENTS})) GROUP BY label)"


@query(f"SELECT src, dst, min(label) FILTER (WHERE cov = top) AS keep, CAST(sum(cov) AS BIGINT) AS total FROM (SELECT *, max(cov) OVER (PARTITION BY src, dst) AS top FROM {_LABELS}) GROUP BY src, dst HAVING count(*) = 2 AND sum(cov) <= 60")
def l7_bulge_choice(spark, sf):
    labels = K.spectrum(event_strings(spark, sf), 7)
    return G.bulge_choice(labels.select(F.left("kmer", F.lit(3)).alias("src"), F.right("kmer", F.lit(3)).alias("dst"), F.col("kmer").alias("label"), F.col("cnt").alias("cov")), 60)


@query(f"SELECT read_id FROM {EVENTS} WHERE read_id NOT IN (SELECT read_id FROM {KMERS(EVENTS, 4)} WHERE kmer IN (SELECT kmer FROM {SPECTRUM(EVENTS, 4)} WHERE cnt < 6))")
def l13_invalidate(spark, sf):
    found = K.kmers(event_strings(spark, sf), 4)
    bad = found.groupBy("kmer").agg(F.count("*").alias("c")).filter("c < 6").select("kmer")
    return event_strings(spark, sf).select("read_id").join(found.join(bad, "kmer", "left_semi"), "read_id", "left_anti")


@query("SELECT c_nationkey, low, bal AS high FROM (SELECT c_nationkey, bal, lag(bal) OVER (PARTITION BY c_nationkey ORDER BY bal) AS low FROM (SELECT c_nationkey, CAST(floor(c_acctbal) AS BIGINT) AS bal FROM customer WHERE c_acctbal >= 1)) WHERE bal >= low * 1.5")
def l26_ratio_gap(spark, sf):
    rows = table(spark, sf, "customer").filter("c_acctbal >= 1").select("c_nationkey", F.floor("c_acctbal").cast("long").alias("bal"))
    return A.ratio_gaps(rows, "c_nationkey", "bal")


@query(f"SELECT read_id AS contig, seq FROM {SEQS} WHERE seq <> ''")
def m12_assemble(spark, sf):
    return A.assembled(K.runs(K.spread(seqs(spark, sf))).withColumnRenamed("read_id", "contig"))


# sources and sinks


@query(f"SELECT concat_ws('_', 'e', src, dst, CAST(length(label) - length(src) AS VARCHAR), CAST(cov AS VARCHAR)) AS name, label AS seq FROM {EDGES(EVENTS, 4)}")
def b1_edge_fasta(spark, sf):
    return X.edge_fasta(G.edges_of(event_strings(spark, sf), 4))


@query(f"WITH e AS (SELECT src || '>' || dst AS name, * FROM {EDGES(EVENTS, 3)}) SELECT concat_ws(chr(9), 'S', name, label, 'KC:i:' || cov) AS value FROM e UNION ALL SELECT concat_ws(chr(9), 'L', a.name, '+', b.name, '+', '2M') FROM e a JOIN e b ON a.dst = b.src")
def b5_gfa(spark, sf):
    return X.gfa_lines(G.edges_of(event_strings(spark, sf), 3), 3)


@query(f"SELECT '\"' || src || '\" -> \"' || dst || '\" [label=\"' || length(label) || ' ' || cov || '\"]' AS value FROM {EDGES(EVENTS, 3)}")
def b6_dot(spark, sf):
    return X.dot_lines(G.edges_of(event_strings(spark, sf), 3))


_PLACED = "(SELECT key, contig % (SELECT count(*) FROM benchmark) AS contig, lo % 300 - 20 AS lo, lo % 300 - 20 + hi - lo AS hi, CASE WHEN key % 2 = 0 THEN '-' ELSE '+' END AS strand FROM " + SEGMENTS + ")"
_PART = "substr(seq, greatest(lo, 0) + 1, greatest(least(hi, length(seq)) - greatest(lo, 0), 0))"


@query(f"SELECT key, CASE WHEN strand = '-' THEN {RC(_PART)} ELSE {_PART} END AS seq FROM {_PLACED} p JOIN {CONTIGS} c ON c.read_id = p.contig")
def c16_simulated_reads(spark, sf):
    rows = segments(spark, sf)
    low = F.col("lo") % 300 - 20
    items = table(spark, sf, "benchmark").count()
    placed = rows.select("key", (F.col("contig") % items).alias("contig"), low.alias("lo"), (low + F.col("hi") - F.col("lo")).alias("hi"), F.when(F.col("key") % 2 == 0, "-").otherwise("+").alias("strand"))
    return I.simulated(placed, contigs(spark, sf))


@query(f"SELECT kmer, coalesce(c.cnt, 0) AS cnt FROM (SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 9)}) LEFT JOIN {SPECTRUM(SEQS, 9)} c USING (kmer)")
def e10_kmer_lookup(spark, sf):
    return K.lookup(K.spectrum(seqs(spark, sf), 9), K.kmers(contigs(spark, sf), 9).select("kmer").distinct())


@query(f"SELECT least(kmer, {RC('kmer')}) AS kmer, CAST(sum(cnt) AS BIGINT) AS cnt FROM {SPECTRUM(SEQS, 9)} GROUP BY ALL")
def h1_unique_edges(spark, sf):
    return K.spectrum(seqs(spark, sf), 9, True)


@query(f"SELECT contig, b AS bin, CAST(sum(least(hi, (b + 1) * 100) - greatest(lo, b * 100)) AS BIGINT) AS total FROM (SELECT *, unnest(range(lo // 100, (hi - 1) // 100 + 1)) AS b FROM {SEGMENTS} WHERE lo < hi) GROUP BY contig, b")
def i15_binned_coverage(spark, sf):
    return I.binned_coverage(segments(spark, sf), 100)


@query(f"SELECT a.contig, count(*) AS n FROM {SEGMENTS} a JOIN {SEGMENTS} b ON a.contig = b.contig AND b.lo <= a.lo AND a.hi <= b.hi WHERE a.lo < a.hi GROUP BY a.contig")
def j17_contained(spark, sf):
    rows = segments(spark, sf).drop("key")
    return I.contained(rows, rows).groupBy("contig").agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, value FROM events), l AS (SELECT user_id, pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY user_id ORDER BY pos) <= 3 THEN 0 ELSE 1 END AS new FROM e WHERE value < 20), p AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM l) SELECT user_id, min(pos) AS lo, max(pos) AS hi, count(*) AS n FROM p GROUP BY user_id, part")
def k13_low_regions(spark, sf):
    rows = table(spark, sf, "events").select("user_id", "value", G.ranked_by("user_id", "ts", "event_id").cast("long").alias("pos"))
    return I.low_regions(rows, F.col("value") < 20, 3, "user_id", "pos")


def _contracted(spark, sf):
    return P.identified(G.contract(G.edges_of(contigs(spark, sf), 12)))


_AT = f"(SELECT edge_id, off, substr(label, off + 1, 12) AS kmer FROM (SELECT label AS edge_id, label, unnest(range(0, length(label) - 11)) AS off FROM {CONTRACTED(CONTIGS, 12)}))"


@query(f"""WITH a AS MATERIALIZED (SELECT * FROM {_AT}), m AS (SELECT r.read_id, r.pos, a.edge_id, a.off FROM {KMERS(CONTIGS, 12)} r JOIN a USING (kmer)),
    w AS (SELECT *, CASE WHEN edge_id = lag(edge_id) OVER o AND off = lag(off) OVER o + 1 THEN 0 ELSE 1 END AS new FROM m WINDOW o AS (PARTITION BY read_id ORDER BY pos)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM w)
    SELECT read_id, row_number() OVER (PARTITION BY read_id ORDER BY run) - 1 AS i, edge_id AS label, CAST(min(off) AS BIGINT) AS "left", CAST(max(off) + 1 AS BIGINT) AS "right" FROM g GROUP BY read_id, run, edge_id""")
def g1_align(spark, sf):
    edges = _contracted(spark, sf)
    found = P.align(contigs(spark, sf), edges, 12).join(edges.select("edge_id", "label"), "edge_id")
    return found.select("read_id", F.col("i").cast("long").alias("i"), "label", F.col("left").cast("long").alias("left"), F.col("right").cast("long").alias("right"))


@query(f"SELECT read_id, seq FROM {CONTIGS} WHERE length(seq) >= 12")
def g6_spell(spark, sf):
    edges = _contracted(spark, sf)
    return P.spell(P.align(contigs(spark, sf), edges, 12), edges, 12)


@query(f"SELECT CAST(sum(length(seq) - 11) AS BIGINT) AS bases FROM {CONTIGS} WHERE length(seq) >= 12")
def i1_edge_coverage(spark, sf):
    edges = _contracted(spark, sf)
    return P.coverage(P.align(contigs(spark, sf), edges, 12), edges).agg(F.sum("bases").alias("bases"))


@query(None)
def i1_coverage_by_edge(spark, sf):
    reads = contigs(spark, sf)
    both = reads.unionByName(reads.select("read_id", S.reverse_complement(F.col("seq")).alias("seq")))
    return P.strand_coverage(reads, P.identified(G.contract(G.edges_of(both, 12))), 12)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e2_minimizers(spark, sf_dir)
