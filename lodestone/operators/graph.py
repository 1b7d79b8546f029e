"""Link graphs: nodes, edges, degrees, PageRank, breadth-first levels, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.steps import step

#: Ranges of keys that dense ids are given in, and nodes that are looked up at once.
RANGES, LOOKUPS = 256, 1000


def ids_by_key(rows: DataFrame, key: str, tie: str, name: str = "graph_id") -> DataFrame:
    """Adds a dense id from 0 by key and tie, without one task that holds all rows: places within ranges of the key, after the
    number of rows in the ranges before. The ranges come from a sample of RANGES keys or so, and change no id."""
    n = rows.count()
    thin = F.pmod(F.xxhash64(key), F.lit(max(1, n // RANGES))) == 0
    cuts = [r[0] for r in rows.filter(thin & F.col(key).isNotNull()).select(key).distinct().orderBy(key).limit(4 * RANGES).collect()]
    cell = F.size(F.filter(F.array(*[F.lit(c) for c in cuts]), lambda c: c <= F.col(key))) if cuts else F.lit(0)
    placed = rows.withColumn("_cell", F.coalesce(cell, F.lit(-1)))
    cells = placed.groupBy("_cell").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("_before", before).drop("_n")  # a row a range: few
    at = F.row_number().over(Window.partitionBy("_cell").orderBy(key, tie))
    return placed.withColumn("_at", at).join(cells, "_cell").withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_cell", "_at", "_before")


def id_of(rows: DataFrame, key: str, tie: str, wanted, name: str = "graph_id") -> DataFrame:
    """The rows that fulfil a condition with their dense id, by counting the rows before each: no sort of the others."""
    hit = rows.filter(wanted)
    mine = hit.select(F.col(key).alias("_k"), F.col(tie).alias("_t")).distinct()
    ahead = (F.col(key) < F.col("_k")) | ((F.col(key) == F.col("_k")) & (F.col(tie) < F.col("_t")))
    counted = F.broadcast(mine.limit(LOOKUPS)).join(rows.select(key, tie), ahead, "left").groupBy("_k", "_t").agg(F.count(F.col(key)).alias(name))
    return hit.join(counted, (F.col(key) == F.col("_k")) & (F.col(tie) == F.col("_t"))).drop("_k", "_t")


def edges(links: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) without self links, both ends known."""
    out = links.filter("src <> dst").select("src", "dst").distinct()
    if nodes is not None:
        out = out.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
    return out


def degrees(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, in_degree, out_degree)."""
    ends = links.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(links.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    sums = ends.groupBy("node").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    return nodes.select("node").join(sums, "node", "left").select("node", F.coalesce("in_degree", F.lit(0)).alias("in_degree"), F.coalesce("out_degree", F.lit(0)).alias("out_degree"))


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, tol: float | None = None, max_iter: int = 10, told: dict | None = None) -> DataFrame:
    """(node, pagerank): dangling mass is spread evenly; stops after the update whose L1 change is below tol, then renormalises.

    One join and one aggregate a step; the dangling mass is what the links do not carry, so it needs no pass of its own.
    told, if given, takes the number of iterations and the last change."""
    if not 0 < damping < 1 or (tol is not None and tol <= 0) or max_iter <= 0:
        raise ValueError("0 < damping < 1, tol > 0 and max_iter > 0 are needed")
    n = nodes.count()
    if n == 0:
        return nodes.select("node", F.lit(0.0).alias("pagerank"))
    out = links.groupBy("src").agg(F.count("*").alias("out"))
    flow = step(links.join(out, "src"))
    ranks = nodes.select("node", F.lit(1.0 / n).alias("pagerank"))
    iterations, delta = 0, None
    for _ in range(max_iter):
        iterations += 1
        given = flow.join(ranks, F.col("src") == F.col("node")).groupBy("dst").agg(F.sum(F.col("pagerank") / F.col("out")).alias("sent"))
        met = step(ranks.join(given, F.col("node") == F.col("dst"), "left").select("node", F.col("pagerank").alias("old"), F.coalesce("sent", F.lit(0.0)).alias("sent")))
        carried, held = met.agg(F.sum("sent"), F.sum("old")).first()
        base = (1 - damping) / n + damping * (held - carried) / n
        new = met.select("node", "old", (F.lit(base) + damping * F.col("sent")).alias("pagerank"))
        ranks = new.select("node", "pagerank")
        if tol is not None and (delta := new.agg(F.sum(F.abs(F.col("pagerank") - F.col("old")))).first()[0]) < tol:
            break
    total = ranks.agg(F.sum("pagerank")).first()[0]
    if told is not None:
        told |= {"iterations_run": iterations, "final_delta": delta}
    return ranks.select("node", (F.col("pagerank") / total).alias("pagerank"))


def levels(links: DataFrame, root: int, depth: int) -> DataFrame:
    """(node, level): fewest links from the root, up to a depth."""
    spark = links.sparkSession
    seen = spark.createDataFrame([(root, 0)], "node long, level int")
    front = seen.select("node")
    for level in range(1, depth + 1):
        front = step(links.join(front, F.col("src") == F.col("node"), "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = seen.unionByName(front.withColumn("level", F.lit(level)))
    return seen


def metadata(nodes: DataFrame, links: DataFrame, **parameters) -> DataFrame:
    """One row: numbers of nodes, edges and dangling nodes, parameters, and nodes by status where they have one."""
    out = degrees(nodes, links).agg(F.count("*").alias("node_count"), F.sum("out_degree").alias("edge_count"), F.count_if(F.col("out_degree") == 0).alias("dangling_node_count"))
    if "fetch_status" in nodes.columns:
        statuses = nodes.groupBy("fetch_status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fetch_status", "n")))).alias("fetch_status_counts"))
        out = out.join(F.broadcast(statuses))  # one row each
    return out.select("*", *[F.lit(v).alias(k) for k, v in parameters.items()])
