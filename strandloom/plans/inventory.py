"""More registered queries: reads and placements, graph predicates, extensions, ordered rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import sequences as S
from strandloom.operators import correction as C
from strandloom.operators import flow as W
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import kmers as K
from strandloom.operators import multik as M
from strandloom.operators import paths as P
from strandloom.operators import reads as R
from strandloom.operators import stats as A
from strandloom.operators.components import connected_components
from strandloom.operators.shared import materialise
from strandloom.plans.registry import BLOCKS, CONTIGS, DEGREES, EDGES, EVENTS, KMERS, POINTS, RC, SEGMENTS, SEQS, SPECTRUM, contigs, customer_blocks, event_strings, points, query, segments, seqs, table

# cutting, names, coordinates


@query(f"SELECT read_id, s * 250 AS start, CASE WHEN s < m THEN substr(seq, s * 250 + 1, 300) ELSE substr(seq, s * 250 + 1) END AS seq FROM (SELECT *, unnest(range(0, m + 1)) AS s FROM (SELECT read_id, seq, CAST(greatest(0, ceil((length(seq) - 550) / 250.0)) AS BIGINT) AS m FROM {SEQS}))")
def a4_chunks(spark, sf):
    return R.chunks(seqs(spark, sf), 300, 50)


@query("SELECT p_partkey, split_part(p_name, ' ', 1) AS id, CASE WHEN instr(p_name, ' ') = 0 THEN '' ELSE substr(p_name, instr(p_name, ' ') + 1) END AS comment FROM part")
def a5_headers(spark, sf):
    name, comment = R.split_header(F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", name.alias("id"), comment.alias("comment"))


@query(f"SELECT key, CASE WHEN key % 3 = 0 THEN '-' ELSE '' END || contig AS target, CASE WHEN key % 3 = 0 THEN 1100 - hi ELSE lo END AS lo, CASE WHEN key % 3 = 0 THEN 1100 - lo ELSE hi END AS hi FROM {SEGMENTS}")
def a20_forward_strand(spark, sf):
    back = F.col("key") % 3 == 0
    lo, hi = R.forward(F.col("lo"), F.col("hi"), F.lit(1100), F.when(back, "-").otherwise("+"))
    return segments(spark, sf).select("key", F.concat(F.when(back, "-").otherwise(""), F.col("contig").cast("string")).alias("target"), lo.alias("lo"), hi.alias("hi"))


@query("SELECT doc_id FROM (SELECT doc_id, source || ' ' || n_chars AS h FROM documents) WHERE try_cast(split_part(h, ' ', -1) AS BIGINT) < 1000")
def c3_score_filter(spark, sf):
    header = F.concat("source", F.lit(" "), F.col("n_chars").cast("string"))
    return table(spark, sf, "documents").filter(R.header_score(header) < 1000).select("doc_id")


@query(f"SELECT read_id, CASE WHEN length(seq) >= 200 THEN seq ELSE '' END AS seq FROM {SEQS}")
def c2_short_emptied(spark, sf):
    return seqs(spark, sf).select("read_id", F.when(F.length("seq") >= 200, F.col("seq")).otherwise("").alias("seq"))


@query(f"SELECT key, substr(seq, CAST(greatest(pos - 15, 0) AS BIGINT) + 1, CAST(greatest(least(pos + 15, length(seq)) - greatest(pos - 15, 0), 0) AS BIGINT)) AS seq FROM (SELECT key, contig % (SELECT count(*) FROM benchmark) AS contig, pos FROM {POINTS}) p JOIN {CONTIGS} c ON p.contig = c.read_id")
def c6_regions(spark, sf):
    return R.regions(points(spark, sf).withColumn("contig", F.col("contig") % table(spark, sf, "benchmark").count()), contigs(spark, sf), 15)


@query(f"SELECT name, CASE WHEN name LIKE '-%' THEN substr({RC('seq')}, lo + 1, hi - lo) ELSE substr(seq, lo + 1, hi - lo) END AS seq FROM (SELECT CASE WHEN key % 2 = 0 THEN '-' ELSE '' END || contig % n AS name, contig % n AS contig, lo, hi FROM {SEGMENTS}, (SELECT count(*) AS n FROM benchmark)) p JOIN {CONTIGS} c ON p.contig = c.read_id")
def c7_named_segment(spark, sf):
    items = table(spark, sf, "benchmark").count()
    name = F.concat(F.when(F.col("key") % 2 == 0, "-").otherwise(""), (F.col("contig") % items).cast("string"))
    return R.named_segment(contigs(spark, sf), segments(spark, sf).select(name.alias("name"), "lo", "hi"))


_PLACED = "(SELECT l_orderkey AS read_id, l_linenumber AS ord, l_partkey AS lo, l_partkey + CAST(l_quantity AS BIGINT) * 40 AS hi, 1600 AS len, l_suppkey % 7 AS identity FROM lineitem)"


def _placed(spark, sf) -> DataFrame:
    lo = F.col("l_partkey")
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("ord"), lo.alias("lo"), (lo + F.col("l_quantity").cast("long") * 40).alias("hi"), F.lit(1600).alias("len"), (F.col("l_suppkey") % 7).alias("identity"))


@query(f"SELECT read_id, ord FROM {_PLACED} WHERE hi - lo > greatest(greatest(len, 1000) - 1000, len * 0.75)")
def c10_selected(spark, sf):
    return R.selected(_placed(spark, sf)).select("read_id", "ord")


@query(f"SELECT read_id, ord FROM {_PLACED} QUALIFY row_number() OVER (PARTITION BY read_id ORDER BY CASE WHEN hi - lo + 50 >= len THEN 0 ELSE 1 END, identity DESC, ord) = 1")
def c11_best_placement(spark, sf):
    return R.best_placement(_placed(spark, sf))


@query(f"WITH e AS (SELECT * FROM {EDGES(EVENTS, 5)}), d AS (SELECT * FROM {DEGREES('e')}) SELECT label, (a.n_in = 0 OR b.n_out = 0) AS tip, (a.n_in <> 1 OR a.n_out <> 1) AS from_junction, (cov >= 10) AS reliable FROM e JOIN d a ON a.v = src JOIN d b ON b.v = dst")
def c12_edge_predicates(spark, sf):
    edges = G.edges_of(event_strings(spark, sf), 5)
    d = G.degrees(edges)
    both = edges.join(d.select(F.col("v").alias("src"), F.col("n_in").alias("i"), F.col("n_out").alias("o")), "src").join(d.select(F.col("v").alias("dst"), F.col("n_out").alias("next")), "dst")
    return both.select("label", ((F.col("i") == 0) | (F.col("next") == 0)).alias("tip"), ((F.col("i") != 1) | (F.col("o") != 1)).alias("from_junction"), (F.col("cov") >= 10).alias("reliable"))


_STEPS = "(SELECT l_orderkey AS read_id, l_linenumber AS i, CAST(l_quantity AS BIGINT) % 9 AS cov, l_returnflag <> 'N' AS dangling FROM lineitem)"


@query(f"SELECT read_id, i, cov FROM (SELECT *, min(cov) OVER (PARTITION BY read_id) AS worst FROM (SELECT *, i = min(i) OVER (PARTITION BY read_id) OR i = max(i) OVER (PARTITION BY read_id) AS e FROM {_STEPS}) WHERE NOT (e AND dangling AND cov < 2)) WHERE worst >= 2")
def c13_trimmed_tips(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("read_id"), F.col("l_linenumber").alias("i"), (F.col("l_quantity").cast("long") % 9).alias("cov"), (F.col("l_returnflag") != "N").alias("dangling"))
    return R.trimmed_tips(rows).select("read_id", "i", "cov")


# scalar functions

_BASE4 = " + ".join(f"(instr('ACGT', substr(kmer, {i + 1}, 1)) - 1) * {4 ** (8 - i)}" for i in range(9))


@query(f"SELECT kmer, {_BASE4} AS n FROM (SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 9)})")
def d12_as_number(spark, sf):
    return K.kmers(contigs(spark, sf), 9).select("kmer").distinct().select("kmer", S.as_number(F.col("kmer")).alias("n"))


@query(f"SELECT kmer, {RC('kmer')} AS other, kmer < {RC('kmer')} AS canonical FROM (SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 11)})")
def d16_orientation(spark, sf):
    return K.kmers(contigs(spark, sf), 11).select("kmer").distinct().select("kmer", S.reverse_complement(F.col("kmer")).alias("other"), (F.col("kmer") < S.reverse_complement(F.col("kmer"))).alias("canonical"))


@query("SELECT o_orderkey, string_agg(CASE WHEN f = 'R' THEN l_linenumber || '' ELSE '-' || l_linenumber END, ',' ORDER BY l_linenumber DESC) AS path FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) GROUP BY o_orderkey")
def d25_reversed_path(spark, sf):
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(F.min("l_returnflag").alias("f"))
    signed = F.concat(F.when(F.col("f") == "R", "-").otherwise(""), F.col("l_linenumber").cast("string"))
    lists = own.groupBy("o_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", signed.alias("s")))).alias("p"))
    return lists.select("o_orderkey", F.array_join(F.transform(F.reverse("p"), lambda x: S.toggle_strand(x["s"])), ",").alias("path"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'c' || p_size ELSE '-c' || p_size END AS name FROM part")
def d29_toggled_names(spark, sf):
    name = F.concat(F.when(F.col("p_size") % 2 == 0, "-").otherwise(""), F.lit("c"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", S.toggle_strand(name).alias("name"))


@query("SELECT l_suppkey, CAST(floor(avg(l_quantity) + 0.5) AS BIGINT) AS vote FROM lineitem GROUP BY l_suppkey")
def d36_rounded_vote(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.floor(F.avg("l_quantity") + 0.5).cast("long").alias("vote"))


# k-mers and graphs


@query(f"WITH m AS (SELECT * FROM {KMERS(SEQS, 12)}), v AS (SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 12)}) SELECT read_id, CAST(min(pos) AS BIGINT) AS pos, count(*) AS n FROM m WHERE kmer IN (SELECT kmer FROM v) GROUP BY read_id")
def e6_vertex_positions(spark, sf):
    vertices = K.kmers(contigs(spark, sf), 12).select("kmer").distinct()
    return K.kmers(seqs(spark, sf), 12).join(vertices, "kmer", "left_semi").groupBy("read_id").agg(F.min("pos").cast("long").alias("pos"), F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN m = 'assembly' THEN 1 WHEN m = 'hifi' THEN CASE WHEN k <= 25 THEN 3 ELSE 1 END WHEN k < 100 THEN 20 WHEN k <= 300 THEN 15 WHEN k <= 400 THEN 10 ELSE 1 END AS least FROM (SELECT p_partkey, p_size * 10 AS k, CASE p_partkey % 3 WHEN 0 THEN 'assembly' WHEN 1 THEN 'hifi' ELSE 'ont' END AS m FROM part)")
def e9_default_threshold(spark, sf):
    mode = F.when(F.col("p_partkey") % 3 == 0, "assembly").when(F.col("p_partkey") % 3 == 1, "hifi").otherwise("ont")
    return table(spark, sf, "part").select("p_partkey", R.default_threshold(mode, F.col("p_size") * 10).alias("least"))


_TAILS = f"(SELECT DISTINCT substr(seq, pos + 1, 3) AS src, substr(seq, pos + 4, 1 + pos % 9) AS label FROM (SELECT seq, unnest(range(0, length(seq) - 3)) AS pos FROM {EVENTS}))"


@query(f"WITH t AS (SELECT * FROM {_TAILS}) SELECT src, label FROM t WHERE NOT EXISTS (SELECT 1 FROM t u WHERE u.src = t.src AND u.label <> t.label AND starts_with(u.label, t.label))")
def f3_absorbed_prefixes(spark, sf):
    at = event_strings(spark, sf).filter("length(seq) > 3").withColumn("pos", F.explode(F.expr("sequence(0, length(seq) - 4)")))
    return R.absorbed(at.select(F.expr("substr(seq, pos + 1, 3)").alias("src"), F.expr("substr(seq, pos + 4, 1 + pos % 9)").alias("label")))


@query(f"WITH e AS (SELECT label FROM {EDGES(CONTIGS, 9)}) SELECT label FROM e WHERE {RC('label')} NOT IN (SELECT label FROM e)")
def f16_not_mirrored(spark, sf):
    return R.not_mirrored(G.edges_of(contigs(spark, sf), 9))


_EXT = f"(SELECT symbols, count(*) AS cnt FROM (SELECT substr(seq, unnest(range(1, length(seq) + 1)), 4) AS symbols FROM {EVENTS}) GROUP BY symbols)"
_NEXT = f"(SELECT left(symbols, length(symbols) - 1) AS prefix, right(symbols, 1) AS nxt, CAST(sum(cnt) AS BIGINT) AS cnt FROM {_EXT} WHERE length(symbols) > 1 GROUP BY ALL)"


@query(f"SELECT symbols, cnt FROM {_EXT}")
def g12_extensions(spark, sf):
    return P.extensions(event_strings(spark, sf).withColumnRenamed("seq", "symbols"), 4)


@query(f"SELECT prefix, max_by(nxt, cnt) AS \"next\" FROM {_NEXT} GROUP BY prefix HAVING count(*) FILTER (WHERE cnt >= 8) = 1 AND count(*) FILTER (WHERE cnt < 8 AND cnt > 6) = 0")
def g14_unique_extension(spark, sf):
    return P.unique_extension(P.extensions(event_strings(spark, sf).withColumnRenamed("seq", "symbols"), 4), 8, 6)


@query(f"WITH m AS (SELECT * FROM {KMERS(EVENTS, 5)}), w AS (SELECT DISTINCT a.kmer FROM m a JOIN m b ON a.read_id = b.read_id AND b.pos = a.pos + 1) SELECT kmer FROM (SELECT DISTINCT kmer FROM m) WHERE substr(kmer, 2) IN (SELECT left(kmer, 4) FROM m) AND kmer NOT IN (SELECT kmer FROM w)")
def g17_disconnected(spark, sf):
    found = K.kmers(event_strings(spark, sf), 5)
    goes = found.withColumn("more", F.lead("kmer").over(K.numbered(found))).groupBy("kmer").agg(F.count("more").alias("n"))
    starts = found.select(F.expr("left(kmer, 4)").alias("v")).distinct()
    return goes.filter("n = 0").withColumn("v", F.expr("substr(kmer, 2)")).join(starts, "v", "left_semi").select("kmer")


@query(f"WITH u AS (SELECT kmer, min(read_id) AS contig, min(pos) AS at FROM {KMERS(CONTIGS, 16)} GROUP BY kmer HAVING count(*) = 1), h AS (SELECT r.read_id, r.pos, u.contig, u.at - r.pos AS d FROM {KMERS(SEQS, 16)} r JOIN u ON r.kmer = u.kmer) SELECT read_id, count(DISTINCT contig || ':' || d) = 1 AS straight, count(*) AS n FROM h GROUP BY read_id")
def g23_unique_mapping(spark, sf):
    index = K.unique(contigs(spark, sf), 16).select("kmer", F.col("read_id").alias("contig"), F.col("pos").alias("at"))
    hits = K.kmers(seqs(spark, sf), 16).join(index, "kmer").select("read_id", F.struct("contig", (F.col("at") - F.col("pos")).alias("d")).alias("line"))
    return hits.groupBy("read_id").agg((F.min("line") == F.max("line")).alias("straight"), F.count("*").alias("n"))


@query(f"WITH g AS (SELECT kmer, count(*) AS c FROM {KMERS(CONTIGS, 9)} GROUP BY kmer) SELECT least(coalesce(g.c, 0), 5) AS mult, least(r.cnt, 50) AS cov, count(*) AS n FROM {SPECTRUM(SEQS, 9)} r LEFT JOIN g USING (kmer) GROUP BY ALL")
def g28_multiplicity_coverage(spark, sf):
    ref = K.spectrum(contigs(spark, sf), 9).withColumnRenamed("cnt", "c")
    both = K.spectrum(seqs(spark, sf), 9).join(ref, "kmer", "left")
    return both.groupBy(F.least(F.coalesce("c", F.lit(0)), F.lit(5)).cast("long").alias("mult"), F.least("cnt", F.lit(50)).cast("long").alias("cov")).agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE s AS (SELECT src, dst FROM {BLOCKS} UNION SELECT dst, src FROM {BLOCKS}), r AS (SELECT DISTINCT src AS v, 0 AS d FROM s WHERE src % 25 = 5 UNION SELECT s.dst, r.d + 1 FROM r JOIN s ON s.src = r.v WHERE r.d < 4) SELECT CAST(v AS BIGINT) AS v, CAST(min(d) AS BIGINT) AS dist FROM r GROUP BY v")
def h5_neighbourhood(spark, sf):
    edges = customer_blocks(spark, sf).distinct()
    named = edges.withColumn("label", F.concat(F.col("src").cast("string"), F.lit("x")))
    return G.neighbourhood(named, edges.select(F.explode(F.array("src", "dst")).alias("v")).filter("v % 25 = 5").distinct(), 4)


@query(f"WITH e AS (SELECT * FROM {EDGES(EVENTS, 5)} WHERE cov >= 4), d AS (SELECT * FROM {DEGREES('e')}) SELECT label FROM e JOIN d a ON a.v = src JOIN d b ON b.v = dst WHERE NOT (a.n_in = 0 AND a.n_out = 1 AND b.n_in = 1 AND b.n_out = 0)")
def h3_without_isolated(spark, sf):
    edges = G.edges_of(event_strings(spark, sf), 5, 4)
    d = G.degrees(edges)
    both = edges.join(d.select(F.col("v").alias("src"), F.struct("n_in", "n_out").alias("a")), "src").join(d.select(F.col("v").alias("dst"), F.struct("n_in", "n_out").alias("b")), "dst")
    return both.filter(~((F.col("a.n_in") == 0) & (F.col("a.n_out") == 1) & (F.col("b.n_in") == 1) & (F.col("b.n_out") == 0))).select("label")


def _multik(spark, sf):
    edges, _ = materialise(P.identified(G.contract(G.edges_of(contigs(spark, sf), 9))), "graph")
    paths = P.align(contigs(spark, sf), edges, 9).select("read_id", "i", F.col("edge_id").alias("edge"))
    return edges.select(F.col("edge_id").alias("edge"), "src", "dst", F.col("label").alias("seq")), paths


@query(None)
def m4_multik(spark, sf):
    edges, _, _ = M.resolve(*_multik(spark, sf), 9, 12)
    return edges


@query(None)
def m5_multik_paths(spark, sf):
    _, paths, _ = M.resolve(*_multik(spark, sf), 9, 12)
    return paths


# aggregates


@query(f"SELECT src AS v, CAST(sum(cov) AS BIGINT) AS cov FROM {EDGES(EVENTS, 4)} GROUP BY src")
def i2_vertex_coverage(spark, sf):
    return G.edges_of(event_strings(spark, sf), 4).groupBy(F.col("src").alias("v")).agg(F.sum("cov").alias("cov"))


_ERRORS = "(SELECT l_orderkey, CAST(sum(l_quantity) AS BIGINT) AS matched, CAST(sum(l_linenumber) - 1 AS BIGINT) AS errors, max(l_partkey) * 20 AS score FROM lineitem GROUP BY l_orderkey)"


def _errors(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").cast("long").alias("matched"), (F.sum("l_linenumber") - 1).alias("errors"), (F.max("l_partkey") * 20).alias("score"))


@query(f"SELECT CAST(least(errors, 30) AS BIGINT) AS errors, count(*) AS n FROM {_ERRORS} GROUP BY 1")
def i13_error_histogram(spark, sf):
    return R.error_histogram(_errors(spark, sf))


@query(f"SELECT CASE WHEN matched = 0 THEN 'unaligned' WHEN errors = 0 THEN 'perfect' WHEN score > 25000 THEN 'bad' WHEN score > 0 THEN 'strange' ELSE 'nonperfect' END AS kind, count(*) AS n FROM {_ERRORS} GROUP BY ALL")
def i14_read_kinds(spark, sf):
    return R.read_kinds(_errors(spark, sf))


@query(f"SELECT left(seq, 3) AS candidate, count(*) AS support FROM {EVENTS} GROUP BY ALL HAVING count(*) >= 2")
def i16_supported(spark, sf):
    return event_strings(spark, sf).groupBy(F.left("seq", F.lit(3)).alias("candidate")).agg(F.count("*").alias("support")).filter("support >= 2")


@query(f"SELECT count(*) AS n, CAST(sum(len) AS BIGINT) AS total, (SELECT max(len) FROM (SELECT len, sum(len) OVER (ORDER BY len DESC) AS cum, sum(len) OVER () AS t FROM (SELECT length(seq) AS len FROM {SEQS})) WHERE cum > t * 0.9) AS ng FROM (SELECT length(seq) AS len FROM {SEQS})")
def i21_n90_strict(spark, sf):
    return A.ng(seqs(spark, sf).select(F.length("seq").cast("long").alias("len")), share=0.9, strict=True)


@query(None)
def i22_lower_multiplicity(spark, sf):
    edges = table(spark, sf, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("edge"), F.col("l_orderkey").alias("src"), (F.col("l_orderkey") + 1 + F.col("l_partkey") % 7).alias("dst"))
    return M.lower_multiplicities(edges.distinct())


# joins, order


@query(f"SELECT p.key, coalesce(min(s.lo), -1) AS anchor FROM {POINTS} p LEFT JOIN {SEGMENTS} s ON s.contig = p.contig AND s.lo = p.pos GROUP BY p.key")
def j3_fallback(spark, sf):
    least = segments(spark, sf).select("contig", F.col("lo").alias("pos")).distinct().withColumn("at", F.col("pos"))
    return points(spark, sf).join(least, ["contig", "pos"], "left").groupBy("key").agg(F.coalesce(F.min("at"), F.lit(-1)).cast("long").alias("anchor"))


@query(f"WITH e AS (SELECT * FROM {EDGES(EVENTS, 4)}), d AS (SELECT * FROM {DEGREES('e')} WHERE n_in > 1 AND n_out > 1) SELECT v, a.label AS left_label, b.label AS right_label FROM d JOIN e a ON a.dst = v JOIN e b ON b.src = v")
def j18_through_pairs(spark, sf):
    edges = G.edges_of(event_strings(spark, sf), 4)
    return G.through(edges, G.complex_vertices(edges))


@query("SELECT event_id FROM (SELECT event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type")
def k2_no_repeats(spark, sf):
    before = F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, sf, "events").withColumn("p", before).filter("p is null or p <> event_type").select("event_id")


@query("SELECT event_id, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS follower FROM events")
def k3_lead_pairs(spark, sf):
    return table(spark, sf, "events").select("event_id", F.lead("event_id").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("follower"))


@query("SELECT edge, next_edge, count(*) AS cnt FROM (SELECT event_type AS edge, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_edge FROM events) WHERE next_edge IS NOT NULL GROUP BY ALL")
def k4_adjacent_pairs(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("read_id"), F.col("event_type").alias("edge_id"), G.ranked_by("user_id", "ts", "event_id").alias("i"))
    return P.adjacent(rows)


@query("SELECT l_suppkey, l_partkey FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) <= 10")
def k18_first_ten_labels(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey").distinct()
    return rows.withColumn("r", G.ranked_by("l_suppkey", "l_partkey")).filter("r <= 10").drop("r")


@query("WITH p AS (SELECT DISTINCT l_orderkey AS a, l_partkey * 100000 + l_suppkey AS b FROM lineitem) SELECT a, b FROM p WHERE a IN (SELECT a FROM p GROUP BY a HAVING count(*) = 1) AND b IN (SELECT b FROM p GROUP BY b HAVING count(*) = 1)")
def l16_mutual_pairs(spark, sf):
    return R.mutual_best(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("b")).distinct())


@query(f"WITH RECURSIVE s AS (SELECT src AS a, dst AS b FROM {BLOCKS} UNION SELECT dst, src FROM {BLOCKS}), r AS (SELECT a AS node, a AS top FROM s UNION SELECT s.b, r.top FROM r JOIN s ON r.node = s.a), c AS (SELECT node, min(top) AS component FROM r GROUP BY node) SELECT o_orderkey AS read_id, CAST(component AS BIGINT) AS component FROM orders JOIN c ON node = o_custkey")
def m1_reads_by_component(spark, sf):
    parts = connected_components(customer_blocks(spark, sf)).withColumnRenamed("node", "o_custkey")
    return table(spark, sf, "orders").join(parts, "o_custkey").select(F.col("o_orderkey").alias("read_id"), "component")


@query(f"SELECT read_id, min(pos) - 5 AS lo, max(pos) + 9 AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY read_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT read_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos - lag(pos) OVER (PARTITION BY read_id ORDER BY pos) <= 14 THEN 0 ELSE 1 END AS new FROM {KMERS(SEQS, 4)} WHERE left(kmer, 2) = right(kmer, 2) AND left(kmer, 1) <> substr(kmer, 2, 1))) GROUP BY read_id, part")
def m10_complex_regions(spark, sf):
    twice = K.kmers(seqs(spark, sf), 4).filter("left(kmer, 2) = right(kmer, 2) and left(kmer, 1) <> substr(kmer, 2, 1)")
    at = F.col("pos").cast("long")
    return I.merged(twice.select("read_id", (at - 5).alias("lo"), (at + 9).alias("hi")), "read_id").select("read_id", "lo", "hi")


@query(f"WITH c AS (SELECT * FROM {SPECTRUM(CONTIGS, 6)}) SELECT kmer, cnt FROM c WHERE cnt > (SELECT quantile_cont(cnt, 0.9) FROM c)")
def o1_repetitive_kmers(spark, sf):
    return R.repetitive(K.spectrum(contigs(spark, sf), 6), 0.9)


@query(f"WITH d AS (SELECT contig, lo // 20 AS pos, count(*) AS depth FROM {SEGMENTS} GROUP BY ALL), w AS (SELECT *, max(depth) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, max(depth) OVER (PARTITION BY contig ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM d) SELECT contig, pos, depth FROM w WHERE l IS NOT NULL AND r IS NOT NULL AND depth * 3 < least(l, r)")
def o4_coverage_drops(spark, sf):
    depth = segments(spark, sf).groupBy("contig", F.floor(F.col("lo") / 20).alias("pos")).agg(F.count("*").alias("depth"))
    return R.coverage_drops(depth, 3)


# correction, multiplicities


@query(None)
def l6_corrected(spark, sf):
    edges, _ = materialise(P.identified(G.contract(G.edges_of(contigs(spark, sf), 12))), "graph")
    return C.corrected(contigs(spark, sf), edges, 12, 2)


@query(None)
def l18_multiplicities(spark, sf):
    key = F.col("c_custkey")
    low = key % 2
    return W.multiplicities(table(spark, sf, "customer").select(F.col("c_nationkey").alias("component"), key.alias("edge"), (key % 8).alias("src"), ((key * 3 + 1) % 8).alias("dst"), low.alias("low"), (low + key % 3).alias("high")))
