"""Registered queries on sparse graphs, text formats, repeats, path algebra and graph edits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions import repeats as Z
from strandloom.functions import sequences as S
from strandloom.operators import bloom as B
from strandloom.operators import coded as C
from strandloom.operators import graph as G
from strandloom.operators import intervals as I
from strandloom.operators import kmers as K
from strandloom.operators import paths as P
from strandloom.operators import sparse as Y
from strandloom.operators.components import connected_components
from strandloom.operators.shared import materialise, new_path
from strandloom.plans.inventory import _BASE4
from strandloom.plans.registry import BLOCKS, CONTIGS, EDGES, EVENTS, KMERS, PAIRS, POINTS, RC, SEGMENTS, SEQS, SPECTRUM, contigs, customer_blocks, event_strings, pairs, points, query, segments, seqs, table
from strandloom.sources import formats as X

# sparse graphs


def CANONICAL(x: str) -> str:
    return f"least({x}, {RC(x)})"


def SPARSE(reads: str, vertex: str, k: int) -> str:
    """Distinct edges between the k-mers for which ``vertex`` (a condition on kmer) holds."""
    return f"""(WITH p AS (SELECT m.read_id, m.pos, m.kmer, r.seq FROM {KMERS(reads, k)} m JOIN {reads} r USING (read_id) WHERE {vertex}),
        w AS (SELECT *, lag(pos) OVER o AS bp, lag(kmer) OVER o AS bk, lead(pos) OVER o AS np, lead(kmer) OVER o AS nk FROM p WINDOW o AS (PARTITION BY read_id ORDER BY pos)),
        i AS (SELECT kmer AS src, nk AS dst, substr(seq, pos + 1, np - pos + {k}) AS label FROM w WHERE np IS NOT NULL AND NOT coalesce(bk = kmer AND nk = kmer AND pos - bp = np - pos AND np - pos < {k}, false))
        SELECT src, dst, label FROM i UNION SELECT {RC('dst')}, {RC('src')}, {RC('label')} FROM i
        UNION SELECT kmer, NULL, substr(seq, pos + 1) FROM w WHERE np IS NULL AND pos + {k} < length(seq)
        UNION SELECT {RC('kmer')}, NULL, {RC(f'substr(seq, 1, pos + {k})')} FROM w WHERE bp IS NULL AND pos > 0)"""


def _reads(spark, sf) -> DataFrame:
    """The documents' sequences, written once."""
    reads, _ = materialise(C.projected(table(spark, sf, "documents").select(F.col("doc_id").alias("read_id"), "text")), "reads")
    return reads


_RARE = f"{CANONICAL('kmer')} LIKE 'AAC%'"


def _rare(reads: DataFrame) -> DataFrame:
    """Canonical 11-mers that begin with AAC."""
    return C.distinct_kmers(reads, 11, "canonical").filter("kmer LIKE 'AAC%'")


@query(f"SELECT DISTINCT {CANONICAL('kmer')} AS kmer, v AS vertex FROM (SELECT kmer, unnest([kmer, {RC('kmer')}]) AS v FROM {KMERS(CONTIGS, 11)})")
def f1_vertices(spark, sf):
    found = K.kmers(contigs(spark, sf), 11).select(S.canonical(F.col("kmer")).alias("kmer")).distinct()
    return found.select("kmer", F.explode(F.array("kmer", S.reverse_complement(F.col("kmer")))).alias("vertex")).distinct()


@query(f"SELECT * FROM {SPARSE(SEQS, _RARE, 11)}")
def f2_sparse_edges(spark, sf):
    reads, _ = materialise(seqs(spark, sf), "reads")
    return Y.sparse_edges(reads, _rare(reads), 11)


_E2 = f"e AS MATERIALIZED (SELECT * FROM {SPARSE(SEQS, _RARE, 11)})"
_LABELS = "(SELECT DISTINCT label AS read_id, label AS seq FROM e)"


@query(f"WITH {_E2} SELECT * FROM {SPARSE(_LABELS, CANONICAL('kmer') + " LIKE 'AA%'", 11)}")
def f4_resplit(spark, sf):
    reads, _ = materialise(seqs(spark, sf), "reads")
    more, _ = materialise(C.distinct_kmers(reads, 11, "canonical").filter("kmer LIKE 'AA%'"), "more")
    edges, _ = materialise(Y.sparse_edges(reads, more.filter("kmer LIKE 'AAC%'"), 11, False).select("label"), "labels")
    return Y.resplit(edges, more, 11)


_ENDS = f"SELECT {CANONICAL('right(label, 11)')} FROM e WHERE dst IS NULL"


@query(f"WITH {_E2} SELECT * FROM {SPARSE(_LABELS, f'({_RARE} OR {CANONICAL("kmer")} IN ({_ENDS}))', 11)}")
def f5_tied_tips(spark, sf):
    reads = _reads(spark, sf)
    return Y.tied_edges(reads, _rare(reads), 11)


@query(None)
def f9_compacted(spark, sf):
    return Y.compacted(_reads(spark, sf), 13, 20)


_LONG = f"(SELECT * FROM {SEQS} WHERE length(seq) >= 32)"


@query(f"SELECT kmer FROM {KMERS(_LONG, 14)} UNION SELECT {RC('kmer')} FROM {KMERS(_LONG, 14)}")
def f9_spelled_kmers(spark, sf):
    """What the compacted graph spells."""
    labels = Y.compacted(_reads(spark, sf), 13, 20, False).select(F.col("label").alias("seq"))
    return C.distinct_kmers(labels, 14, "both")


@query(f"SELECT kmer FROM {KMERS(_LONG, 13)} UNION SELECT {RC('kmer')} FROM {KMERS(_LONG, 13)}")
def f8_disjointig_kmers(spark, sf):
    return C.distinct_kmers(Y.disjointigs(_reads(spark, sf), 13, 20, False), 13, "both")


@query(f"SELECT DISTINCT left(s, 11) AS src, right(s, 11) AS dst, s AS label FROM (SELECT seq AS s FROM {CONTIGS} UNION SELECT {RC('seq')} FROM {CONTIGS}) WHERE length(s) >= 11")
def a10_graph_of_edges(spark, sf):
    return Y.graph_of(contigs(spark, sf), 11)


_BREAKS = f"(SELECT DISTINCT c.read_id, p.pos, length(c.seq) AS n FROM {POINTS} p JOIN {CONTIGS} c ON c.read_id = p.contig WHERE p.pos > 0 AND p.pos + 11 < length(c.seq))"


@query(f"""WITH b AS (SELECT read_id, list(pos ORDER BY pos) AS cuts FROM {_BREAKS} GROUP BY read_id),
    r AS (SELECT c.read_id, c.seq, list_prepend(CAST(0 AS BIGINT), coalesce(cuts, [])) AS a, list_append(list_transform(coalesce(cuts, []), lambda x: x + 11), length(c.seq)) AS z FROM {CONTIGS} c LEFT JOIN b USING (read_id))
    SELECT read_id AS edge_id, i, substr(seq, a[i + 1] + 1, z[i + 1] - a[i + 1]) AS seq FROM (SELECT *, unnest(range(0, len(a))) AS i FROM r)""")
def f15_split_at(spark, sf):
    edges = contigs(spark, sf).withColumnRenamed("read_id", "edge_id")
    return Y.split_at(edges, points(spark, sf).withColumnRenamed("contig", "edge_id"), 11)


_PARTS = f"(SELECT contig, lo, hi, hi - lo AS len FROM (SELECT contig, min(lo) AS lo, max(hi) AS hi FROM (SELECT *, sum(new) OVER (PARTITION BY contig ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS part FROM (SELECT *, CASE WHEN lo <= max(hi) OVER (PARTITION BY contig ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM {SEGMENTS})) GROUP BY contig, part))"


@query(f"WITH e AS (SELECT s_suppkey AS edge_id, 1100 AS size, CAST(s_nationkey % 5 AS BIGINT) AS cov, s_suppkey % 9 <> 0 AS joint FROM supplier) SELECT edge_id, 0 AS lo, CAST(size AS BIGINT) AS hi FROM e WHERE (cov > 2 AND size > 1000) OR NOT joint UNION ALL SELECT edge_id, lo, hi FROM e JOIN {_PARTS} ON contig = edge_id WHERE NOT ((cov > 2 AND size > 1000) OR NOT joint)")
def h9_covered_pieces(spark, sf):
    edges = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.lit(1100).alias("size"), (F.col("s_nationkey") % 5).cast("long").alias("cov"), (F.col("s_suppkey") % 9 != 0).alias("joint"))
    return Y.covered_pieces(edges, I.merged(segments(spark, sf)).withColumnRenamed("contig", "edge_id"), 1000)


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT src, dst FROM {EDGES(EVENTS, 4)}), r AS (SELECT src AS a, dst AS b FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON e.src = r.b), v AS (SELECT src AS v FROM e UNION SELECT dst FROM e) SELECT v, coalesce((SELECT min(x.b) FROM r x JOIN r y ON y.a = x.b AND y.b = x.a WHERE x.a = v), v) AS component FROM v")
def h14_strong_components(spark, sf):
    found = G.strong_components(G.edges_of(event_strings(spark, sf), 4))
    return found


@query(f"WITH RECURSIVE e AS (SELECT DISTINCT c_custkey + 1 AS src, c_custkey // 3 AS dst FROM customer), r AS (SELECT src AS v, 0 AS level FROM e UNION SELECT e.dst, r.level + 1 FROM r JOIN e ON e.src = r.v) SELECT CAST(v AS BIGINT) AS v, CAST(max(level) AS BIGINT) AS level FROM r GROUP BY v")
def h7_topological_levels(spark, sf):
    key = F.col("c_custkey")
    return G.peeled(table(spark, sf, "customer").select((key + 1).cast("long").alias("src"), F.floor(key / 3).cast("long").alias("dst")))


_COMPONENTS = f"WITH RECURSIVE b AS (SELECT DISTINCT src, dst FROM {BLOCKS}), s AS (SELECT src AS x, dst AS y FROM b UNION SELECT dst, src FROM b), r AS (SELECT x AS node, x AS top FROM s UNION SELECT s.y, r.top FROM r JOIN s ON r.node = s.x), c AS (SELECT node, CAST(min(top) AS BIGINT) AS component FROM r GROUP BY node), d AS (SELECT v, sum(i) AS n_in, sum(o) AS n_out FROM (SELECT src AS v, 0 AS i, 1 AS o FROM b UNION ALL SELECT dst, 1, 0 FROM b) GROUP BY v)"


@query(f"{_COMPONENTS} SELECT component, count(*) AS n_vertices, CAST(sum(n_out) AS BIGINT) AS n_edges, count(*) FILTER (WHERE n_in + n_out = 1) AS n_tips, count(*) FILTER (WHERE n_in <> 1 OR n_out <> 1) AS n_junctions FROM d JOIN c ON node = v GROUP BY component")
def h6_component_measures(spark, sf):
    edges = customer_blocks(spark, sf).distinct()
    return G.component_measures(edges, connected_components(edges))


_PREFIX = "coalesce(list_min(list_filter(range(0, CAST(least(length({0}), length({1})) AS BIGINT)), lambda i: substr({0}, i + 1, 1) <> substr({1}, i + 1, 1))), least(length({0}), length({1})))"


@query(f"SELECT a, b, substr(s, n + 1) AS left_rest, substr(t, n + 1) AS right_rest FROM (SELECT *, CAST({_PREFIX.format('s', 't')} AS BIGINT) AS n FROM {PAIRS})")
def h11_true_divergence(spark, sf):
    both = pairs(spark, sf).withColumn("n", S.common_prefix(F.col("s"), F.col("t")).cast("int"))
    return both.select("a", "b", F.expr("substr(s, n + 1)").alias("left_rest"), F.expr("substr(t, n + 1)").alias("right_rest"))


# alignment


_DIAGONALS = f"(SELECT r.read_id, c.read_id AS contig, r.pos, CAST(r.pos AS BIGINT) - c.pos AS d FROM {KMERS(SEQS, 16)} r JOIN {KMERS(CONTIGS, 16)} c ON r.kmer = c.kmer)"


@query(f"SELECT read_id, contig, CAST(min(pos) AS BIGINT) AS pos, CAST(min(pos) - d AS BIGINT) AS cpos, CAST(count(*) + 15 AS BIGINT) AS len FROM (SELECT *, pos - row_number() OVER (PARTITION BY read_id, contig, d ORDER BY pos) AS island FROM {_DIAGONALS}) GROUP BY read_id, contig, d, island")
def g3_maximal_matches(spark, sf):
    return P.maximal_matches(seqs(spark, sf), contigs(spark, sf), 16)


@query(f"SELECT read_id, contig, CAST(pos AS BIGINT) AS pos FROM {KMERS(SEQS, 24)} r JOIN (SELECT read_id AS contig, left(seq, 24) AS kmer FROM {CONTIGS} WHERE length(seq) >= 24) USING (kmer)")
def g27_naive_search(spark, sf):
    return P.found_in(contigs(spark, sf).select("read_id", F.left("seq", F.lit(24)).alias("seq")).filter("length(seq) = 24"), seqs(spark, sf), 24)


@query(f"SELECT read_id, contig, CAST(pos AS BIGINT) AS pos FROM {KMERS(SEQS, 16)} r JOIN (SELECT read_id AS contig, left(seq, 16) AS p FROM {CONTIGS} WHERE length(seq) >= 16) ON left(kmer, 9) = left(p, 9) AND right(kmer, 6) = right(p, 6)")
def g21_wildcards(spark, sf):
    patterns = contigs(spark, sf).filter("length(seq) >= 16").select("read_id", F.expr("concat(left(seq, 9), '?', substr(seq, 11, 6))").alias("seq"))
    return P.wildcard_hits(patterns, seqs(spark, sf))


@query(f"SELECT src, right(path, 3) AS dst, symbols, count(*) AS support FROM (SELECT left(path, 3) AS src, path, substr(path, 4) AS symbols FROM (SELECT substr(seq, i + 1, 3 + n) AS path FROM (SELECT seq, i, unnest(range(1, 5)) AS n FROM (SELECT seq, unnest(range(0, length(seq) - 3)) AS i FROM {EVENTS})) WHERE i + 3 + n <= length(seq))) GROUP BY ALL HAVING count(*) >= 6")
def g15_supported_ways(spark, sf):
    return P.supported_ways(event_strings(spark, sf), 4, 4, 6)


@query("SELECT l_orderkey AS read_id, array_to_string(list_reverse(list_transform(e, lambda x: '-' || x)), ',') AS other, array_to_string(e[2:], ',') AS cut, array_to_string(e[1:2], ',') AS part, array_to_string(list_concat(e, [99]), ',') AS longer, CAST(len(e) AS BIGINT) AS n, worst FROM (SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) AS e, CAST(min(l_quantity) AS BIGINT) AS worst FROM lineitem GROUP BY l_orderkey)")
def g7_path_algebra(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("read_id")).agg(F.sort_array(F.collect_list("l_linenumber")).cast("array<string>").alias("e"), F.min("l_quantity").cast("long").alias("worst"))
    text = lambda x: F.array_join(x, ",")
    e = F.col("e")
    return rows.select("read_id", text(P.reversed_path(e)).alias("other"), text(P.cut_back(e, 1, 0)).alias("cut"), text(F.slice(e, 1, 2)).alias("part"), text(F.concat(e, F.array(F.lit("99")))).alias("longer"), F.size(e).cast("long").alias("n"), "worst")


# sinks and sources


@query(f"SELECT DISTINCT {_BASE4.replace('kmer', 'c')} AS h FROM (SELECT {CANONICAL('kmer')} AS c FROM {KMERS(CONTIGS, 9)})")
def a11_number_list(spark, sf):
    found = K.kmers(contigs(spark, sf), 9).select(S.canonical(F.col("kmer")).alias("kmer")).distinct().select(S.as_number(F.col("kmer")).alias("h")).distinct()
    path = new_path(spark, "numbers")
    X.write_numbers(found, path, "h")
    return X.read_numbers(spark, path)


@query(f"SELECT src, dst, label, cov FROM {EDGES(EVENTS, 5)}")
def a12_saved_coverages(spark, sf):
    edges, path = G.edges_of(event_strings(spark, sf), 5), new_path(spark, "coverages")
    X.write_coverages(edges, path)
    return X.with_coverages(edges, path).select("src", "dst", "label", "cov")


@query(f"SELECT src, dst, label, cov FROM {EDGES(EVENTS, 6)}")
def a17_saved_graph(spark, sf):
    path = new_path(spark, "graph")
    X.save_graph(G.edges_of(event_strings(spark, sf), 6), path)
    return X.load_graph(spark, path)


@query(f"SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 8)}")
def a18_kmer_list(spark, sf):
    path = new_path(spark, "list")
    K.kmers(contigs(spark, sf), 8).select("kmer").write.text(path)
    return X.read_kmer_list(spark, path)


@query(f"SELECT key, substr(seq, pos + 1, 1) AS symbol FROM {POINTS} JOIN {CONTIGS} ON read_id = contig WHERE pos < length(seq)")
def a19_symbols_at(spark, sf):
    return X.symbols_at(contigs(spark, sf), points(spark, sf))


@query(f"SELECT src, dst, label, cov FROM {EDGES(CONTIGS, 10)} WHERE label <= {RC('label')}")
def b2_canonical_edges(spark, sf):
    return X.canonical_edges(G.edges_of(contigs(spark, sf), 10))


@query(f"SELECT {CANONICAL('src')} || CASE WHEN src <= {RC('src')} THEN '1' ELSE '0' END || substr(label, length(src) + 1, 1) AS name, label AS seq FROM {EDGES(CONTIGS, 10)}")
def b3_older_names(spark, sf):
    return X.edge_names(G.edges_of(contigs(spark, sf), 10))


@query(f"WITH RECURSIVE e AS MATERIALIZED (SELECT * FROM {EDGES(EVENTS, 4)}), s AS (SELECT src AS x, dst AS y FROM e UNION SELECT dst, src FROM e), r AS (SELECT x AS node, x AS top FROM s UNION SELECT s.y, r.top FROM r JOIN s ON r.node = s.x), c AS (SELECT node, min(top) AS component FROM r GROUP BY node) SELECT component, '\"' || src || '\" -> \"' || dst || '\" [label=\"' || length(label) || ' ' || cov || '\"]' AS value FROM e JOIN c ON node = src")
def b7_dot_by_component(spark, sf):
    edges = G.edges_of(event_strings(spark, sf), 4)
    return X.dot_by_component(edges, connected_components(edges))


_WHOLE = f"(SELECT * FROM {CONTIGS} WHERE length(seq) >= 12)"


@query(f"SELECT read_id || ' ' || left(seq, 11) || ' ' || substr(seq, 12) AS value FROM {_WHOLE} UNION ALL SELECT '-' || read_id || ' ' || left({RC('seq')}, 11) || ' ' || substr({RC('seq')}, 12) FROM {_WHOLE}")
def b8_alignment_lines(spark, sf):
    reads = contigs(spark, sf).filter("length(seq) >= 12")
    return X.alignment_lines(reads.select("read_id", F.left("seq", F.lit(11)).alias("src"), F.expr("substr(seq, 12)").alias("symbols")))


@query(f"SELECT '>' || read_id || chr(10) || seq AS value FROM {_WHOLE}")
def b9_corrected_fasta(spark, sf):
    from strandloom.plans.registry import _contracted

    edges = _contracted(spark, sf)
    spelled = P.spell(P.align(contigs(spark, sf), edges, 12), edges, 12)
    return spelled.select(X.fasta_lines(F.col("read_id").cast("string"), F.col("seq")).alias("value"))


@query(f"WITH m AS (SELECT * FROM {KMERS(EVENTS, 4)}), c AS (SELECT kmer, count(*) AS cov FROM m GROUP BY kmer) SELECT read_id || ' ' || string_agg('4:' || cov, ' ' ORDER BY pos) AS value FROM m JOIN c USING (kmer) GROUP BY read_id")
def b10_path_lines(spark, sf):
    reads = event_strings(spark, sf)
    return X.path_lines(K.kmers(reads, 4).select("read_id", F.col("pos").alias("i"), F.col("kmer").alias("label")), G.edges_of(reads, 4))


_CHANGED = f"(SELECT *, CAST({_PREFIX.format('old', 'new')} AS BIGINT) AS p FROM (SELECT read_id, seq AS old, replace(seq, 'ACGTA', 'ACTA') AS new FROM {SEQS}) WHERE old <> new)"


@query(f"SELECT read_id, p AS \"at\", left(a, length(a) - q) AS before, left(b, length(b) - q) AS after FROM (SELECT *, CAST({_PREFIX.format('ra', 'rb')} AS BIGINT) AS q FROM (SELECT read_id, p, substr(old, p + 1) AS a, substr(new, p + 1) AS b, reverse(substr(old, p + 1)) AS ra, reverse(substr(new, p + 1)) AS rb FROM {_CHANGED}))")
def b11_change_log(spark, sf):
    rows = seqs(spark, sf).select("read_id", F.col("seq").alias("old"), F.replace("seq", F.lit("ACGTA"), F.lit("ACTA")).alias("new"))
    return X.change_log(rows).select("read_id", F.col("at").cast("long").alias("at"), "before", "after")


@query(f"WITH e AS (SELECT * FROM {EDGES(EVENTS, 4)}) SELECT 'S' || chr(9) || v || chr(9) || v AS value FROM (SELECT src AS v FROM e UNION SELECT dst FROM e) UNION ALL SELECT concat_ws(chr(9), 'L', src, '+', dst, '+', '2M') FROM e")
def b12_vertex_gfa(spark, sf):
    return X.vertex_gfa_lines(G.edges_of(event_strings(spark, sf), 4))


@query("SELECT l_orderkey AS read_id, l_linenumber AS ord, CASE WHEN l_quantity * 40 >= 1550 THEN 'good' ELSE 'partial' END AS kind FROM lineitem")
def b13_good_and_partial(spark, sf):
    from strandloom.plans.inventory import _placed

    return P.good_or_partial(_placed(spark, sf), 50).select("read_id", "ord", "kind")


@query(f"SELECT label || '_' || src || '_3_' || dst || '_3' AS name, label AS seq FROM {EDGES(EVENTS, 4)}")
def b15_resolver_names(spark, sf):
    return X.resolver_names(G.edges_of(event_strings(spark, sf), 4).withColumn("edge_id", F.col("label")))


@query(f"SELECT edge, string_agg(name, ',' ORDER BY name) AS labels FROM (SELECT DISTINCT kmer AS edge, CAST(read_id AS VARCHAR) AS name FROM {KMERS(CONTIGS, 6)} QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY name) <= 10) GROUP BY edge".replace("SELECT DISTINCT kmer AS edge, CAST(read_id AS VARCHAR) AS name FROM", "SELECT edge, name FROM (SELECT DISTINCT kmer AS edge, CAST(read_id AS VARCHAR) AS name FROM").replace("QUALIFY row_number() OVER (PARTITION BY kmer", ") QUALIFY row_number() OVER (PARTITION BY edge"))
def b16_edge_labels(spark, sf):
    return X.edge_labels(K.kmers(contigs(spark, sf), 6).select(F.col("kmer").alias("edge"), F.col("read_id").cast("string").alias("name")))


# repeats and scalar functions


@query(f"""WITH c AS (SELECT read_id, i, substr(seq, i + 1, 1) AS x, substr(seq, i + 3, 1) = substr(seq, i + 1, 1) AND i + 2 < length(seq) AS same FROM (SELECT read_id, seq, unnest(range(0, length(seq))) AS i FROM {SEQS})),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY read_id ORDER BY i) AS streak FROM c WHERE same),
    l AS (SELECT read_id, min(i) AS lo, count(*) AS n FROM g GROUP BY read_id, streak HAVING count(*) >= 4),
    gone AS (SELECT read_id, unnest(range(lo, lo + 2 * ((n - 2) // 2))) AS i FROM l)
    SELECT read_id, string_agg(x, '' ORDER BY i) AS seq FROM c ANTI JOIN gone USING (read_id, i) GROUP BY read_id""")
def d4_dimers_shrunk(spark, sf):
    return seqs(spark, sf).filter("seq <> ''").select("read_id", Z.shrink_dimers(F.col("seq")).alias("seq"))


_STARTS = f"(SELECT read_id, seq, list_filter(range(0, length(seq)), lambda i: i = 0 OR substr(seq, i + 1, 1) <> substr(seq, i, 1)) AS starts FROM {CONTIGS})"


@query(f"SELECT read_id, CAST(starts[11] AS BIGINT) AS lo, CAST(starts[41] AS BIGINT) AS hi, substr(seq, starts[11] + 1, starts[41] - starts[11]) AS seq FROM {_STARTS} WHERE len(starts) > 40")
def d6_uncompressed(spark, sf):
    rows = contigs(spark, sf).withColumn("at", Z.run_starts(F.col("seq"))).filter("size(at) > 40")
    return rows.select("read_id", F.get("at", F.lit(10)).cast("long").alias("lo"), F.get("at", F.lit(40)).cast("long").alias("hi"), Z.uncompressed(F.col("seq"), F.col("at"), F.lit(10), F.lit(40)).alias("seq"))


@query(f"SELECT a, b, starts_with(s, left(t, 2)) AS begins, ends_with(s, right(t, 2)) AS ends, substr(s, 6, 3) = left(t, 3) AS holds, left(s, least(length(s), length(t))) = left(t, least(length(s), length(t))) AS agrees FROM {PAIRS}")
def d8_contains(spark, sf):
    rows = pairs(spark, sf)
    return rows.select("a", "b", F.startswith("s", F.left("t", F.lit(2))).alias("begins"), F.endswith("s", F.right("t", F.lit(2))).alias("ends"), (F.expr("substr(s, 6, 3)") == F.left("t", F.lit(3))).alias("holds"), S.non_contradicting(F.col("s"), F.col("t")).alias("agrees"))


@query(f"SELECT read_id, regexp_matches(seq, '^[ACGT]*$') AS valid, translate(seq, 'ACGT', '0123') AS code, translate(seq, 'ACGT', 'TGCA') AS complement FROM {CONTIGS}")
def d14_encoded(spark, sf):
    return contigs(spark, sf).select("read_id", F.col("seq").rlike("^[ACGT]*$").alias("valid"), F.translate("seq", "ACGT", "0123").alias("code"), F.translate("seq", "ACGT", "TGCA").alias("complement"))


def _HASH(x: str) -> str:
    return " + ".join(f"CAST(instr('ACGT', substr({x}, {i + 1}, 1)) - 1 AS BIGINT) * {239 ** (6 - i)}" for i in range(7))


@query(f"SELECT DISTINCT kmer, {_HASH('left(kmer, 7)')} AS h, {_HASH('right(kmer, 7)')} AS following FROM {KMERS(CONTIGS, 8)}")
def d15_rolling_hash(spark, sf):
    rows = K.kmers(contigs(spark, sf), 8).select("kmer").distinct().withColumn("h", Z.polynomial_hash(F.left("kmer", F.lit(7))))
    return rows.select("kmer", "h", Z.rolled(F.col("h"), F.left("kmer", F.lit(1)), F.right("kmer", F.lit(1)), 7).cast("long").alias("following"))


@query("SELECT p_partkey, CAST(p_size + 2 * (p_partkey % 7) AS BIGINT) AS matched, CAST(3 + p_partkey % 5 AS BIGINT) AS differing, CAST(p_size + 2 * (p_partkey % 7) + 1 + p_partkey % 5 AS BIGINT) AS first, CAST(p_size + 2 * (p_partkey % 7) + 3 AS BIGINT) AS second FROM part")
def d22_cigar_counts(spark, sf):
    n = lambda x: x.cast("string")
    key = F.col("p_partkey")
    cigar = F.concat(n(F.col("p_size")), F.lit("=1X"), n(key % 7), F.lit("=2I"), n(key % 7), F.lit("="), n(key % 5), F.lit("D"))
    return table(spark, sf, "part").select("p_partkey", Z.cigar_counts(S.parse_cigar(cigar)).alias("c")).select("p_partkey", "c.*")


@query(f"SELECT a, b, CAST(list_max(list_filter(range(0, CAST(least(length(s), length(t)) + 1 AS BIGINT)), lambda i: right(s, i) = left(t, i))) AS BIGINT) AS n FROM {PAIRS}")
def d24_longest_overlap(spark, sf):
    return pairs(spark, sf).select("a", "b", Z.longest_overlap(F.col("s"), F.col("t")).alias("n"))


@query(f"SELECT read_id, array_to_string(list_filter(range(0, length(seq) - 2), lambda i: substr(seq, i + 1, 3) = 'ACA'), ',') AS places, CAST((length(seq) - length(replace(seq, 'ACA', ''))) // 3 AS BIGINT) AS separate FROM {CONTIGS}")
def d27_occurrences(spark, sf):
    rows = contigs(spark, sf)
    return rows.select("read_id", F.array_join(Z.occurrences(F.col("seq"), "ACA").cast("array<string>"), ",").alias("places"), Z.separate_occurrences(F.col("seq"), "ACA").alias("separate"))


@query("SELECT p_partkey, CAST(list_min(list_transform([5, 17, 23, 41], lambda v: {'far': abs(v - p_size), 'value': v}))['value'] AS BIGINT) AS nearest FROM part")
def d27_closest(spark, sf):
    return table(spark, sf, "part").select("p_partkey", Z.closest(F.array(*map(F.lit, (5, 17, 23, 41))), F.col("p_size")).cast("long").alias("nearest"))


@query("SELECT p_partkey, upper(trim(p_name)) AS name, lpad(CAST(p_size AS VARCHAR), 6, '0') AS padded, split_part(p_name, ' ', 1) AS first, replace(p_name, 'a', '*') AS masked, array_to_string(list_reverse(string_split(p_name, ' ')), '_') AS turned FROM part")
def d28_strings(spark, sf):
    words = F.split("p_name", " ")
    return table(spark, sf, "part").select("p_partkey", F.upper(F.trim("p_name")).alias("name"), F.lpad(F.col("p_size").cast("string"), 6, "0").alias("padded"), words[0].alias("first"), F.replace("p_name", F.lit("a"), F.lit("*")).alias("masked"), F.array_join(F.reverse(words), "_").alias("turned"))


@query(f"""WITH b AS (SELECT read_id, seq, i FROM (SELECT read_id, seq, unnest(range(1, length(seq))) AS i FROM {CONTIGS}) WHERE i = 1 OR substr(seq, i + 1, 1) <> substr(seq, i - 1, 1)),
    c AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY read_id ORDER BY i), length(seq)) AS nxt FROM b)
    SELECT read_id, string_agg(substr(seq, i, 2) || ':' || (nxt - i), ',' ORDER BY i) AS code FROM c GROUP BY read_id""")
def e15_dimer_code(spark, sf):
    rows = contigs(spark, sf).filter("length(seq) >= 2").select("read_id", Z.dimer_code(F.col("seq")).alias("c"))
    return rows.select("read_id", F.array_join(F.transform("c", lambda x: F.concat(x["dimer"], F.lit(":"), x["times"].cast("string"))), ",").alias("code"))


_BITS = f"(SELECT DISTINCT CAST('0x' || substr(md5(kmer), 1 + 8 * h, 8) AS BIGINT) % 1048576 AS p FROM (SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 10)}), (SELECT unnest(range(0, 4)) AS h))"


@query(f"SELECT p // 32 AS word, CAST(sum(CAST(1 AS BIGINT) << CAST(p % 32 AS INTEGER)) AS BIGINT) AS bits FROM {_BITS} GROUP BY 1")
def e5_bloom_filter(spark, sf):
    return B.bloom(K.kmers(contigs(spark, sf), 10).select("kmer").distinct(), "kmer", 1 << 20, 4)


_FOUND = f"(SELECT kmer FROM (SELECT kmer, CAST('0x' || substr(md5(kmer), 1 + 8 * h, 8) AS BIGINT) % 1048576 AS p FROM (SELECT DISTINCT kmer FROM {KMERS(EVENTS, 10)} UNION SELECT DISTINCT kmer FROM {KMERS(CONTIGS, 10)}), (SELECT unnest(range(0, 4)) AS h)) WHERE p IN (SELECT p FROM b) GROUP BY kmer HAVING count(*) = 4)"


@query(f"WITH b AS MATERIALIZED (SELECT p FROM {_BITS}) SELECT kmer FROM {_FOUND}")
def e5_bloom_contains(spark, sf):
    asked = K.kmers(event_strings(spark, sf), 10).select("kmer").unionByName(K.kmers(contigs(spark, sf), 10).select("kmer")).distinct()
    return B.contained(asked, "kmer", e5_bloom_filter(spark, sf), 1 << 20, 4)


@query(f"SELECT kmer, cnt FROM {SPECTRUM(EVENTS, 5)}")
def f14_graph_kmers(spark, sf):
    return P.graph_kmers(P.identified(G.contract(G.edges_of(event_strings(spark, sf), 6))), event_strings(spark, sf), 5)
