"""Graph queries: suppliers that follow each other in an order, pages and their links, events by type."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.functions.text import lookup_key
from lodestone.operators import graph as G
from lodestone.operators.ranking import cuts_of, stable_rank
from lodestone.plans import pages as P
from lodestone.sources.tables import table

ITERATIONS, TOP, DEPTH = 10, 20, 3
#: Digits of PageRank that ranks are made of.
PLACES = 14


def _nodes(spark, sf_dir):
    return table(spark, sf_dir, "supplier", "s_suppkey", "s_name").select(F.col("s_suppkey").alias("node"), F.col("s_name").alias("title"))


def graph_nodes(spark, sf_dir):
    rows = _nodes(spark, sf_dir).withColumn("key", lookup_key(F.col("title")))
    return G.ids_by_key(rows, "key", "node").select("graph_id", "node", "title", "key")


def graph_edges(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    links = lines.select(F.col("l_suppkey").alias("src"), F.lead("l_suppkey").over(w).alias("dst")).filter("dst is not null")
    return G.edges(links, _nodes(spark, sf_dir))


def graph_degrees(spark, sf_dir):
    return G.degrees(_nodes(spark, sf_dir), graph_edges(spark, sf_dir))


def _ranks(spark, sf_dir):
    """PageRank to PLACES digits, so that sums in another order give the same ranks; what is shown has nine."""
    return G.pagerank(_nodes(spark, sf_dir), graph_edges(spark, sf_dir), max_iter=ITERATIONS).select("node", F.round("pagerank", PLACES).alias("pagerank"))


def pagerank(spark, sf_dir):
    return _ranks(spark, sf_dir).withColumn("pagerank", F.round("pagerank", 9))


def pagerank_rank(spark, sf_dir):
    """Ranks by score, ties by title (without case) and then node."""
    ranks = G.step(_ranks(spark, sf_dir).join(_nodes(spark, sf_dir), "node").select("node", "pagerank", lookup_key(F.col("title")).alias("key"), F.lit(0).alias("by")))
    out = stable_rank(ranks, by=("by",), score="pagerank", key="node", rank="rank", cuts=cuts_of(ranks, "pagerank"), ties=("key",))
    return out.select("node", F.round("pagerank", 9).alias("pagerank"), "rank")


def pagerank_links(spark, sf_dir):
    links = P.page_links(spark, sf_dir).select(F.concat(F.lit("p"), "page_id").alias("src"), "href").select("src", F.col("href").alias("dst"))
    nodes = links.select(F.col("src").alias("node")).union(links.select("dst")).distinct()
    return G.pagerank(nodes, G.edges(links), max_iter=ITERATIONS).select("node", F.round("pagerank", 9).alias("pagerank"))


def graph_metadata(spark, sf_dir):
    return G.metadata(_nodes(spark, sf_dir), graph_edges(spark, sf_dir), damping=0.85, max_iterations=ITERATIONS)


def top_nodes(spark, sf_dir):
    """The TOP highest nodes: a bounded sort, no ranking of the others."""
    ranks = _ranks(spark, sf_dir).join(_nodes(spark, sf_dir), "node").orderBy(F.desc("pagerank"), lookup_key(F.col("title")), "node").limit(TOP)
    place = F.row_number().over(Window.orderBy(F.desc("pagerank"), lookup_key(F.col("title")), "node"))  # TOP rows
    return ranks.select("node", F.round("pagerank", 9).alias("pagerank"), place.cast("long").alias("rank"))


def node_by_id(spark, sf_dir):
    rows = _nodes(spark, sf_dir).withColumn("key", lookup_key(F.col("title")))
    return G.id_of(rows, "key", "node", F.col("node") == 7).select("graph_id", "node", "title", "key")


def node_by_title(spark, sf_dir, title: str = " THE SUPPLIER 9 "):
    """The node of a title or canonical title; an exact title first."""
    wanted = lookup_key(F.lit(title))
    nodes = _nodes(spark, sf_dir).withColumn("canonical_title", F.concat(F.lit("The supplier "), "node"))
    hits = nodes.filter((lookup_key(F.col("title")) == wanted) | (lookup_key(F.col("canonical_title")) == wanted))
    return hits.orderBy(F.when(lookup_key(F.col("title")) == wanted, 0).otherwise(1), "node").limit(1)


def node_suggest(spark, sf_dir, part: str = "01", n: int = 10):
    """The highest nodes whose title holds a text."""
    hits = _nodes(spark, sf_dir).filter(F.contains(lookup_key(F.col("title")), F.lit(part)))
    out = _ranks(spark, sf_dir).join(hits, "node").orderBy(F.desc("pagerank"), lookup_key(F.col("title")), "node").limit(n)
    return out.select("node", "title")


def bfs_levels(spark, sf_dir):
    root = table(spark, sf_dir, "supplier", "s_suppkey").agg(F.min("s_suppkey")).first()[0]
    return G.levels(G.step(graph_edges(spark, sf_dir)), root, DEPTH)


def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_type").groupBy("event_type").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (graph_nodes, graph_edges, graph_degrees, pagerank, pagerank_rank, pagerank_links, graph_metadata, top_nodes, node_by_id, node_by_title, node_suggest, bfs_levels, status_counts)}

KEY = "replace(lower(trim({})), 'ß', 'ss')"
EDGES = """links AS (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem),
nodes AS (SELECT s_suppkey AS node FROM supplier),
edges AS (SELECT DISTINCT src, dst FROM links WHERE src <> dst AND src IN (SELECT node FROM nodes) AND dst IN (SELECT node FROM nodes))"""
NODES = f"named AS (SELECT row_number() OVER (ORDER BY {KEY.format('s_name')}, s_suppkey) - 1 AS graph_id, s_suppkey AS node, s_name AS title, {KEY.format('s_name')} AS key FROM supplier)"


def _ranks_sql() -> str:
    out = ["outs AS (SELECT src, count(*) AS o FROM edges GROUP BY src)", "size AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT node, 1 / n AS pr FROM nodes, size)"]
    for i in range(1, ITERATIONS + 1):
        out.append(f"s{i} AS MATERIALIZED (SELECT dst AS node, sum(pr / o) AS sent FROM edges JOIN outs USING (src) JOIN r{i - 1} ON src = node GROUP BY dst)")
        out.append(f"r{i} AS MATERIALIZED (SELECT node, 0.15::DOUBLE / n + 0.85::DOUBLE * (1 - (SELECT coalesce(sum(sent), 0) FROM s{i})) / n + 0.85::DOUBLE * coalesce(sent, 0) AS pr FROM nodes LEFT JOIN s{i} USING (node), size)")
    return ",\n".join([*out, f"ranks AS (SELECT node, round(pr / (SELECT sum(pr) FROM r{ITERATIONS}), {PLACES}) AS pagerank FROM r{ITERATIONS})"])


RANKED = f"WITH {EDGES}, {_ranks_sql()}, placed AS (SELECT node, round(pagerank, 9) AS pagerank, row_number() OVER (ORDER BY ranks.pagerank DESC, {KEY.format('s_name')}, node) AS rank, s_name AS title FROM ranks JOIN supplier ON node = s_suppkey)"
ORACLE_SQL = {
    "graph_nodes": f"WITH {NODES} SELECT * FROM named",
    "graph_edges": f"WITH {EDGES} SELECT * FROM edges",
    "graph_degrees": f"WITH {EDGES} SELECT node, (SELECT count(*) FROM edges WHERE dst = node) AS in_degree, (SELECT count(*) FROM edges WHERE src = node) AS out_degree FROM nodes",
    "pagerank": f"WITH {EDGES}, {_ranks_sql()} SELECT node, round(pagerank, 9) AS pagerank FROM ranks",
    "pagerank_rank": f"{RANKED} SELECT node, pagerank, rank FROM placed",
    "pagerank_links": f"WITH {P.LINKS}, edges AS (SELECT DISTINCT 'p' || page_id AS src, href AS dst FROM links), nodes AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges), {_ranks_sql()} SELECT node, round(pagerank, 9) AS pagerank FROM ranks",
    "graph_metadata": f"WITH {EDGES} SELECT (SELECT count(*) FROM nodes) AS node_count, (SELECT count(*) FROM edges) AS edge_count, (SELECT count(*) FROM nodes WHERE node NOT IN (SELECT src FROM edges)) AS dangling_node_count, 0.85::DOUBLE AS damping, {ITERATIONS} AS max_iterations",
    "top_nodes": f"{RANKED} SELECT node, pagerank, rank FROM placed WHERE rank <= {TOP}",
    "node_by_id": f"WITH {NODES} SELECT * FROM named WHERE node = 7",
    "node_by_title": "SELECT s_suppkey AS node, s_name AS title, 'The supplier ' || s_suppkey AS canonical_title FROM supplier WHERE s_suppkey = 9",
    "node_suggest": f"{RANKED} SELECT node, title FROM placed WHERE contains({KEY.format('title')}, '01') ORDER BY rank LIMIT 10",
    "bfs_levels": f"""WITH {EDGES}, l0 AS (SELECT min(node) AS node, 0 AS level FROM nodes), l1 AS (SELECT DISTINCT dst AS node, 1 AS level FROM edges JOIN l0 ON src = node WHERE dst NOT IN (SELECT node FROM l0)),
a1 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1), l2 AS (SELECT DISTINCT dst AS node, 2 AS level FROM edges JOIN l1 ON src = node WHERE dst NOT IN (SELECT node FROM a1)),
a2 AS (SELECT * FROM a1 UNION ALL SELECT * FROM l2), l3 AS (SELECT DISTINCT dst AS node, 3 AS level FROM edges JOIN l2 ON src = node WHERE dst NOT IN (SELECT node FROM a2))
SELECT * FROM a2 UNION ALL SELECT * FROM l3""",
    "status_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
}
