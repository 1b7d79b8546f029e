"""Queries over a crawl's state. The pages stand for it: a page is titled by its first link, and the smallest page id of a title
is its node; every third node has no saved progress, every fifth one's text exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import crawl as C
from lodestone.operators import graph as G
from lodestone.plans import graphs
from lodestone.plans import pages as P
from lodestone.sources.tables import table

DEPTH = 3


def _namespace(page_id):
    return F.when(page_id % 7 == 0, 14).when(page_id % 11 == 0, 1).otherwise(0)


def _found(spark, sf_dir):
    """(title, page_id, kind, links)."""
    titles = P.href_to_title(spark, sf_dir).filter("title is not null")
    pages = titles.groupBy("page_id").agg(F.min_by("title", "pos").alias("title"), F.array_sort(F.collect_set("title")).alias("links"))
    first = pages.groupBy("title").agg(F.min(F.struct("page_id", "links")).alias("f")).select("title", "f.page_id", "f.links")
    return first.filter(C.in_scope(_namespace(F.col("page_id")))).withColumn("kind", C.kind_of(_namespace(F.col("page_id"))))


def _nodes(spark, sf_dir):
    found = _found(spark, sf_dir)
    i = F.col("page_id")
    status = F.when(i % 4 == 0, "failed").when(i % 4 == 1, "completed").when(i % 4 == 2, "")
    progress = found.filter(i % 3 != 0).select("title", F.concat(F.lit("http://a/"), i).alias("url"), "links", status.alias("fetch_status"), (i % 3).cast("int").alias("failure_count"), F.when(i % 4 == 0, F.when(i % 8 == 0, 404).otherwise(503)).cast("int").alias("last_http_status"))
    return C.with_files(C.with_progress(C.new_nodes(found), progress), _files(found))


def _files(found):
    return found.filter("page_id % 5 = 0").select("title", F.concat(F.lit("http://b/"), "page_id").alias("url"), F.lit("").alias("kind"))


def page_info(spark, sf_dir):
    i = F.col("page_id")
    pages = table(spark, sf_dir, "pages", "page_id", "url").filter(C.in_scope(_namespace(i)))
    return pages.select("page_id", C.kind_of(_namespace(i)).alias("kind"), T.href_title(F.col("url"), "http://", "HTTPS://").alias("title"))


def page_urls(spark, sf_dir):
    url = T.page_url(F.col("text"), "/wiki/")
    rows = table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", T.head_words(F.col("text"), 6).alias("text")).filter("text <> ''")
    return rows.select("doc_id", url.alias("url"), T.href_title(url, "/WIKI/").alias("back"))


def crawl_nodes(spark, sf_dir):
    return _nodes(spark, sf_dir).select("title", "page_id", "kind", "requested_title", "url", "text_file", "fetch_status", "failure_count", "last_http_status", F.size("links").alias("n_links"))


def refetch_nodes(spark, sf_dir):
    out = C.to_fetch(_nodes(spark, sf_dir), _files(_found(spark, sf_dir)), retry_failed=True)
    return out.select("title", "fetch_status", C.worth_retrying(F.col("last_http_status")).alias("retry"))


def scoped_edges(spark, sf_dir):
    return C.edge_rows(_nodes(spark, sf_dir))


def page_index(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    out = C.page_index(C.discovered_from(nodes, C.scoped_links(nodes)))
    return out.select("title", "page_id", F.array_join("discovered_from", ",").alias("discovered_from"), "link_count")


def crawl_manifest(spark, sf_dir):
    return C.manifest(_nodes(spark, sf_dir))


def bfs_parents(spark, sf_dir):
    """Two walks: the second goes on from where the first was cut off."""
    root = table(spark, sf_dir, "supplier", "s_suppkey").agg(F.min("s_suppkey")).first()[0]
    links = G.step(graphs.graph_edges(spark, sf_dir))
    out = C.levels(links, DEPTH, saved=C.levels(links, 1, root))
    return out.select("node", "level", F.size("parents").alias("n_parents"), F.array_min("parents").alias("first_parent"))


def node_json(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    return rows.select(F.col("s_suppkey").alias("node"), F.to_json(F.struct(F.col("s_suppkey").alias("node"), F.col("s_name").alias("title"))).alias("json"))


QUERIES = {f.__name__: f for f in (page_info, page_urls, crawl_nodes, refetch_nodes, scoped_edges, page_index, crawl_manifest, bfs_parents, node_json)}

NS = "CASE WHEN page_id % 7 = 0 THEN 14 WHEN page_id % 11 = 0 THEN 1 ELSE 0 END"
NODES = rf"""{P.LINKS},
pg AS (SELECT page_id, arg_min(title, pos) AS title, list_sort(list(DISTINCT title)) AS links FROM titles WHERE title IS NOT NULL GROUP BY page_id),
found AS (SELECT title, min(page_id) AS page_id, arg_min(links, page_id) AS links FROM pg GROUP BY title),
base AS (SELECT *, CASE WHEN {NS} = 14 THEN 'category' ELSE 'page' END AS kind, page_id % 3 <> 0 AS saved, page_id % 5 = 0 AS there FROM found WHERE {NS} IN (0, 14)),
prog AS (SELECT *, CASE WHEN saved THEN CASE page_id % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'completed' ELSE 'pending' END ELSE 'pending' END AS st FROM base),
nodes AS (SELECT title, page_id, kind, title AS requested_title, CASE WHEN there AND st <> 'completed' THEN 'http://b/' || page_id WHEN saved THEN 'http://a/' || page_id END AS url,
    CASE WHEN there AND st <> 'completed' THEN 'texts/' || substr(regexp_replace(regexp_replace(regexp_replace(title, '[<>:"/\|?*]', '-', 'g'), '\s+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 80) || '_' || substr(sha1(title), 1, 10) || '.txt' END AS text_file,
    CASE WHEN there THEN 'completed' ELSE st END AS fetch_status, CASE WHEN saved THEN page_id % 3 ELSE 0 END AS failure_count,
    CASE WHEN saved AND NOT (there AND st <> 'completed') AND page_id % 4 = 0 THEN CASE WHEN page_id % 8 = 0 THEN 404 ELSE 503 END END AS last_http_status,
    CASE WHEN saved AND NOT (there AND st <> 'completed') THEN links ELSE [] END AS links, there FROM prog),
ll AS (SELECT DISTINCT title AS source, unnest(links) AS target FROM nodes),
sc AS (SELECT source, target FROM ll WHERE lower(source) <> lower(target) AND target IN (SELECT title FROM nodes))"""
URL = "'/wiki/' || url_encode(replace(trim(h), ' ', '_'))"
ORACLE_SQL = {
    "page_info": f"SELECT page_id, CASE WHEN {NS} = 14 THEN 'category' ELSE 'page' END AS kind, nullif(trim(replace(url_decode(string_split(string_split(regexp_extract(url, '(?i)^https?://(.*)$', 1), '#')[1], '?')[1]), '_', ' ')), '') AS title FROM pages WHERE {NS} IN (0, 14)",
    "page_urls": rf"""WITH h AS (SELECT doc_id, array_to_string(regexp_split_to_array(trim(text), '\s+')[1:6], ' ') AS h FROM documents)
SELECT doc_id, {URL} AS url, nullif(trim(replace(trim(h), '_', ' ')), '') AS back FROM h WHERE h <> ''""",
    "crawl_nodes": f"WITH {NODES} SELECT title, page_id, kind, requested_title, url, text_file, fetch_status, failure_count, last_http_status, len(links) AS n_links FROM nodes",
    "refetch_nodes": f"WITH {NODES} SELECT title, fetch_status, coalesce(last_http_status NOT IN (404, 410), true) AS retry FROM nodes WHERE NOT (fetch_status = 'completed' AND there)",
    "scoped_edges": f"""WITH {NODES} SELECT a.title AS source_title, a.kind AS source_kind, a.page_id AS source_page_id, a.url AS source_url, b.title AS target_title, b.kind AS target_kind, b.page_id AS target_page_id, b.url AS target_url
FROM sc JOIN nodes a ON source = a.title JOIN nodes b ON target = b.title""",
    "page_index": f"""WITH {NODES} SELECT title, page_id, coalesce((SELECT string_agg(source, ',' ORDER BY source) FROM sc WHERE target = title), '') AS discovered_from, (SELECT count(*) FROM sc WHERE source = title) AS link_count FROM nodes""",
    "crawl_manifest": f"""WITH {NODES} SELECT count(*) AS node_count, count(*) FILTER (WHERE kind = 'category') AS category_count, count(*) FILTER (WHERE kind = 'page') AS page_count, count(*) FILTER (WHERE fetch_status = 'completed') AS completed_count,
count(*) FILTER (WHERE fetch_status = 'failed') AS failed_count, count(*) FILTER (WHERE fetch_status = 'pending') AS pending_count, (SELECT count(*) FROM sc) AS in_scope_edge_count FROM nodes""",
    "bfs_parents": f"""WITH walk AS ({graphs.ORACLE_SQL["bfs_levels"]}), {graphs.EDGES}
SELECT w.node, w.level, count(p.node) AS n_parents, min(p.node) AS first_parent FROM walk w LEFT JOIN edges e ON e.dst = w.node LEFT JOIN walk p ON p.node = e.src AND p.level = w.level - 1 GROUP BY w.node, w.level""",
    "node_json": """SELECT s_suppkey AS node, '{"node":' || s_suppkey || ',"title":"' || s_name || '"}' AS json FROM supplier""",
}
