"""A crawl's state as tables: nodes, saved progress, existing files, links in scope, page index and manifest.

Fetching over a network is not here; what a crawl keeps, resumes from and writes is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators.steps import step

#: Namespaces of pages and of categories.
PAGE, CATEGORY = 0, 14
#: Statuses of answers after which another try is of no use.
FINAL = (404, 410)


def kind_of(namespace: Column) -> Column:
    return F.when(namespace == CATEGORY, "category").otherwise("page")


def in_scope(namespace: Column, every: bool = False) -> Column:
    """Pages and categories, or all namespaces."""
    return F.lit(True) if every else namespace.isin(PAGE, CATEGORY)


def property_or(json: Column, name: str, default) -> Column:
    """A property of a JSON object, or the default where it is missing."""
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(default).cast("string"))


def utc_now() -> Column:
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def text_path(title: Column) -> Column:
    return F.concat(F.lit("texts/"), T.safe_stem(title), F.lit(".txt"))


def state_path(title: Column) -> Column:
    return F.concat(T.safe_stem(title), F.lit(".json"))


def same_crawl(saved: dict, root: str, every: bool) -> bool:
    """Whether a saved state belongs to the crawl that is asked for; names are compared without case."""
    names = {str(saved.get(k) or "").lower() for k in ("requested_root_category", "root_category")} - {""}
    return root.lower() in names and bool(saved.get("include_all_namespaces")) == every


def new_nodes(found: DataFrame) -> DataFrame:
    """Nodes with defaults. found: title, page_id, kind, and requested_title and discovered_from where they are known."""
    has = set(found.columns)
    asked = F.nullif(F.trim("requested_title"), F.lit("")) if "requested_title" in has else F.lit(None).cast("string")
    parents = F.col("discovered_from") if "discovered_from" in has else F.lit(None).cast("array<string>")
    return found.select(
        "title", "page_id", "kind", F.coalesce(asked, "title").alias("requested_title"), F.coalesce(parents, F.array().cast("array<string>")).alias("discovered_from"),
        F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("text_file"), F.lit(None).cast("string").alias("canonical_title"),
        F.array().cast("array<string>").alias("links"), F.lit("pending").alias("fetch_status"), F.lit(0).alias("failure_count"), F.lit(None).cast("int").alias("last_http_status"),
    )


def with_progress(nodes: DataFrame, progress: DataFrame) -> DataFrame:
    """Nodes with what was saved of them: all of it where there is a saved row (with defaults for what it lacks), else nothing."""
    defaults = {"links": F.array().cast("array<string>"), "fetch_status": F.lit("pending"), "failure_count": F.lit(0)}
    saved = [c for c in ("url", "text_file", "canonical_title", "links", "fetch_status", "failure_count", "last_http_status") if c in progress.columns]
    given = progress.select("title", F.lit(True).alias("_saved"), *[F.col(c).alias(f"_{c}") for c in saved])
    out = nodes.join(given, "title", "left")
    blank = lambda c: F.nullif(F.col(f"_{c}"), F.lit("")) if dict(nodes.dtypes)[c] == "string" else F.col(f"_{c}")
    values = {c: F.when(F.col("_saved"), F.coalesce(blank(c), defaults[c]) if c in defaults else blank(c)).otherwise(F.col(c)).alias(c) for c in saved}
    return out.select(*[values.get(c, F.col(c)) for c in nodes.columns])


def with_files(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Nodes that are not completed but whose text exists become completed, without links. files: title, and header fields."""
    fields = [c for c in ("url", "canonical_title", "kind") if c in files.columns]
    given = files.select("title", F.lit(True).alias("_there"), *[F.nullif(F.col(c), F.lit("")).alias(f"_{c}") for c in fields])
    out = nodes.join(given, "title", "left")
    taken = F.coalesce("_there", F.lit(False)) & (F.col("fetch_status") != "completed")
    new = {c: F.coalesce(F.when(taken, F.col(f"_{c}")), F.col(c)) for c in fields}
    new |= {"text_file": F.when(taken, text_path(F.col("title"))).otherwise(F.col("text_file")), "links": F.when(taken, F.array().cast("array<string>")).otherwise(F.col("links"))}
    new |= {"fetch_status": F.when(taken, "completed").otherwise(F.col("fetch_status")), "last_http_status": F.when(~taken, F.col("last_http_status"))}
    return out.select(*[new[c].alias(c) if c in new else F.col(c) for c in nodes.columns])


def to_fetch(nodes: DataFrame, files: DataFrame, retry_failed: bool = False) -> DataFrame:
    """Nodes still to be fetched: not the completed ones whose file is there, nor, unless asked for, the failed ones."""
    there = files.select("title", F.lit(True).alias("_there"))
    done = (F.col("fetch_status") == "completed") & F.coalesce("_there", F.lit(False))
    failed = (F.col("fetch_status") == "failed") & F.lit(not retry_failed)
    return nodes.join(there, "title", "left").filter(~(done | failed)).drop("_there")


def worth_retrying(http_status: Column) -> Column:
    return F.coalesce(~http_status.isin(*FINAL), F.lit(True))


def scoped_links(nodes: DataFrame) -> DataFrame:
    """(source, target): distinct links between titles of the crawl, none to the page itself (without regard to case)."""
    out = nodes.select(F.col("title").alias("source"), F.explode("links").alias("target")).distinct()
    out = out.filter(F.lower("source") != F.lower("target"))
    return out.join(nodes.select(F.col("title").alias("target")), "target", "left_semi").select("source", "target")


def edge_rows(nodes: DataFrame) -> DataFrame:
    """Links in scope with kind, page id and url of both ends."""
    ends = {side: nodes.select(*[F.col(c).alias(f"{side}_{c}") for c in ("title", "kind", "page_id", "url")]) for side in ("source", "target")}
    links = scoped_links(nodes).select(F.col("source").alias("source_title"), F.col("target").alias("target_title"))
    return links.join(ends["source"], "source_title").join(ends["target"], "target_title").select(*ends["source"].columns, *ends["target"].columns)


def discovered_from(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """nodes with the sorted distinct sources that lead to each."""
    sources = links.groupBy(F.col("target").alias("title")).agg(F.array_sort(F.collect_set("source")).alias("_from"))
    return nodes.drop("discovered_from").join(sources, "title", "left").withColumn("discovered_from", F.coalesce("_from", F.array().cast("array<string>"))).drop("_from")


def page_index(nodes: DataFrame) -> DataFrame:
    """A row a node with the number of its links in scope."""
    counts = scoped_links(nodes).groupBy(F.col("source").alias("title")).agg(F.count("*").alias("link_count"))
    out = nodes.join(counts, "title", "left").withColumn("link_count", F.coalesce("link_count", F.lit(0)))
    return out.select("title", "canonical_title", "page_id", "kind", "url", "text_file", F.array_sort("discovered_from").alias("discovered_from"), "fetch_status", "failure_count", "last_http_status", "link_count")


def manifest(nodes: DataFrame) -> DataFrame:
    """One row: nodes by kind and by status, and links in scope."""
    kinds = [F.count_if(F.col("kind") == k).alias(f"{k}_count") for k in ("category", "page")]
    states = [F.count_if(F.col("fetch_status") == s).alias(f"{s}_count") for s in ("completed", "failed", "pending")]
    edges = scoped_links(nodes).agg(F.count("*").alias("in_scope_edge_count"))
    return nodes.agg(F.count("*").alias("node_count"), *kinds, *states).join(F.broadcast(edges))  # one row each


def levels(links: DataFrame, depth: int, root=None, saved: DataFrame | None = None) -> DataFrame:
    """(node, level, parents): breadth-first levels with every node of the level before that leads to a node. saved: rows of an
    earlier, shorter walk (or of one that was cut off), from whose last level this one goes on."""
    if saved is None:
        kind = dict(links.dtypes)["src"]
        saved = links.sparkSession.createDataFrame([(root, 0)], f"node {kind}, level int").withColumn("parents", F.array().cast(f"array<{kind}>"))
    seen = step(saved.select("node", F.col("level").cast("int").alias("level"), "parents"))
    first = seen.agg(F.max("level")).first()[0]
    for level in range((first or 0) + 1, depth + 1):
        front = seen.filter(F.col("level") == level - 1).select(F.col("node").alias("src"))
        new = links.join(front, "src").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti").groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("parents"))
        seen = step(seen.unionByName(new.withColumn("level", F.lit(level))))
    return seen


def write_outputs(nodes: DataFrame, path: str) -> None:
    """page_index and manifest as JSON, links and failed pages as CSV; each is written whole or not at all by Spark's committer."""
    from lodestone.sources.sinks import write_csv

    page_index(nodes).write.mode("overwrite").json(f"{path}/page_index")
    manifest(nodes).withColumn("generated_at_utc", utc_now()).write.mode("overwrite").json(f"{path}/manifest")
    write_csv(edge_rows(nodes), f"{path}/links")
    write_csv(nodes.filter("fetch_status = 'failed'").select("title", "page_id", "kind", "url", "failure_count", "last_http_status"), f"{path}/failed_pages")
