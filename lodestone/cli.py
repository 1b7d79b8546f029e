"""Command line: run a query over a data folder, build and ask a graph, clean a corpus, rank it."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import lookup_key
from lodestone.operators import cleaning as C
from lodestone.operators import crawl as K
from lodestone.operators import features as X
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S
from lodestone.operators.crawl import utc_now
from lodestone.operators.ranking import cuts_of, stable_rank
from lodestone.plans import registry
from lodestone.sources import sinks, tables

def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone")
    sub = out.add_subparsers(dest="command", required=True)
    p = sub.add_parser("run", help="a registered query")
    p.add_argument("name")
    p.add_argument("--data", required=True)
    p.add_argument("--out")
    p = sub.add_parser("rank", help="rank a folder of texts for a query file")
    p.add_argument("--model", choices=["all", *R.RUNNERS], default="all")
    p.add_argument("--limit", type=int, help="so many documents, by name")
    p.add_argument("--cache", help="folder of scores that are kept between runs")
    p.add_argument("--corpus", required=True)
    p.add_argument("--queries", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("build", help="graph from a page index and a link table")
    p.add_argument("--index", required=True)
    p.add_argument("--links", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--include-categories", action="store_true")
    p.add_argument("--completed-only", action="store_true")
    p.add_argument("--damping", type=float, default=0.85)
    p.add_argument("--tol", type=float, default=1e-8)
    p.add_argument("--max-iter", type=int, default=100)
    p = sub.add_parser("query", help="one node of a graph, or suggestions")
    p.add_argument("--graph", required=True)
    p.add_argument("--title")
    p.add_argument("--page-id", type=int)
    p.add_argument("--suggest-limit", type=int, default=10)
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("top", help="the highest nodes")
    p.add_argument("--graph", required=True)
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("features")
    p.add_argument("--corpus", required=True)
    p.add_argument("--limit", type=int)
    p.add_argument("--no-sentiment", action="store_true")
    p.add_argument("--out", required=True)
    p = sub.add_parser("correlate", help="coefficients of features and ranks")
    p.add_argument("--rankings", required=True)
    p.add_argument("--features", required=True)
    p.add_argument("--kind", choices=["spearman", "kendall"], default="spearman")
    p.add_argument("--out", required=True)
    p = sub.add_parser("significance")
    p.add_argument("--coefficients", required=True)
    p.add_argument("--alpha", type=float, default=0.05)
    p.add_argument("--out", required=True)
    p = sub.add_parser("agreement", help="how tau and rho go together")
    p.add_argument("--kendall", required=True)
    p.add_argument("--spearman", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("rbo")
    p.add_argument("--rankings", required=True)
    p.add_argument("--p", type=float, default=0.9)
    p.add_argument("--depth", type=int, default=1000)
    p.add_argument("--out", required=True)
    p = sub.add_parser("clean", help="clean a folder of texts, new ones only")
    p.add_argument("--source", required=True)
    p.add_argument("--out", required=True)
    p = sub.add_parser("export-clean", help="clean exported texts: title and body")
    p.add_argument("--source", required=True)
    p.add_argument("--out", required=True)
    p.add_argument("--skip-existing", action="store_true")
    p = sub.add_parser("crawl-outputs", help="page index, links, failed pages and manifest of a saved crawl")
    p.add_argument("--inventory", required=True)
    p.add_argument("--progress")
    p.add_argument("--out", required=True)
    return out


def build(spark: SparkSession, a: argparse.Namespace) -> None:
    pages = tables.page_index(spark, a.index).filter(F.col("kind").isin(["page", "category"] if a.include_categories else ["page"]))
    if a.completed_only:
        pages = pages.filter("fetch_status = 'completed'")
    nodes = G.ids_by_key(pages.withColumn("key", lookup_key(F.col("title"))), "key", "title").withColumn("node", F.col("graph_id"))
    links = tables.csv_table(spark, a.links, "source_title string, source_kind string, source_page_id long, source_url string, target_title string, target_kind string, target_page_id long, target_url string")
    ids = nodes.select("key", "node")
    links = links.join(ids.withColumnsRenamed({"node": "src", "key": "k"}), lookup_key(F.col("source_title")) == F.col("k")).drop("k")
    links = G.edges(links.join(ids.withColumnsRenamed({"node": "dst", "key": "k"}), lookup_key(F.col("target_title")) == F.col("k")))
    told: dict = {}
    ranks = G.step(G.pagerank(nodes, links, a.damping, a.tol, a.max_iter, told).join(nodes.select("node", "key"), "node").withColumn("by", F.lit(0)))
    ranks = stable_rank(ranks, ("by",), "pagerank", "node", "rank", cuts_of(ranks, "pagerank"), ("key",)).drop("by", "key")
    whole = nodes.join(G.degrees(nodes, links), "node").join(ranks, "node")
    asked = {"input_dir": a.index.rpartition("/")[0], "output_dir": a.out, "page_index_path": a.index, "links_path": a.links, "include_categories": a.include_categories, "completed_only": a.completed_only}
    metadata = G.metadata(nodes, links, **asked, damping=a.damping, tolerance=a.tol, max_iterations=a.max_iter, **told)
    sinks.write_graph(whole, links, metadata.withColumn("generated_at_utc", utc_now()), a.out, csv=True)


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    if a.command == "run":
        df = registry.queries()[a.name](spark, a.data)
        df.write.mode("overwrite").parquet(a.out) if a.out else df.show(truncate=False)
    elif a.command == "rank":
        docs, queries = tables.text_corpus(spark, a.corpus, a.limit), tables.query_file(spark, a.queries).withColumnRenamed("query_text", "text")
        for model in R.LIGHT if a.model == "all" else [a.model]:
            def made(model=model):
                return R.with_zeros(R.RUNNERS[model](docs, queries), docs, queries)

            given = docs.select("doc_id", "text").unionByName(queries.select(F.concat(F.lit("query "), "query_id").alias("doc_id"), "text"))
            scored = tables.cached(spark, a.cache, model, given, made) if a.cache else made()
            sinks.write_rankings(_rank_text_ids(scored).withColumn("model", F.lit(model)), f"{a.out}/{model}")
    elif a.command == "build":
        build(spark, a)
    elif a.command == "query":
        if (a.title is None) == (a.page_id is None):
            parser().error("one of --title and --page-id is needed")
        nodes = spark.read.parquet(f"{a.graph}/nodes")
        wanted = lookup_key(F.lit(a.title or ""))
        hit = nodes.filter(F.col("page_id") == a.page_id) if a.page_id is not None else nodes.filter((F.col("key") == wanted) | (lookup_key(F.col("canonical_title")) == wanted)).orderBy(F.when(F.col("key") == wanted, 0).otherwise(1), "rank").limit(1)
        rows = hit.collect()
        if not rows:
            nodes.filter(F.contains("key", wanted)).orderBy("rank").limit(a.suggest_limit).select("rank", "title").show(truncate=False)
            return 1
        print(json.dumps(rows[0].asDict(True), ensure_ascii=False) if a.json else "\n".join(f"{k}: {v}" for k, v in rows[0].asDict(True).items()))
    elif a.command == "top":
        best = spark.read.parquet(f"{a.graph}/nodes").orderBy("rank").limit(a.limit).select("rank", "title", "pagerank")
        if a.json:
            print(json.dumps([r.asDict() for r in best.collect()], ensure_ascii=False))  # --limit rows
        else:
            best.show(a.limit, truncate=False)
    elif a.command == "features":
        docs, annotator = tables.text_corpus(spark, a.corpus, a.limit), X.Annotator(**({"polarity": None} if a.no_sentiment else {}))
        out = X.surface(docs).join(X.readability(docs, annotator), "doc_id").join(X.lexical(docs, annotator), "doc_id").join(X.keywords(docs, annotator), "doc_id")
        out.write.mode("overwrite").parquet(a.out)
    elif a.command == "correlate":
        features = spark.read.parquet(a.features)
        rows = S.rank_features(spark.read.parquet(a.rankings), features)
        (S.spearman if a.kind == "spearman" else S.kendall)(rows).write.mode("overwrite").parquet(a.out)
    elif a.command == "significance":
        sinks.write_csv(S.benjamini_hochberg(S.t_test(spark.read.parquet(a.coefficients)), alpha=a.alpha).orderBy(F.asc_nulls_last("p_value")), a.out)
    elif a.command == "agreement":
        sinks.write_csv(S.agreement(spark.read.parquet(a.kendall), spark.read.parquet(a.spearman)), a.out)
    elif a.command == "rbo":
        sinks.write_csv(S.rbo_summary(S.rbo_curves(spark.read.parquet(a.rankings), a.p, a.depth)).orderBy(F.desc("mean")), a.out)
    elif a.command == "clean":
        texts = tables.text_corpus(spark, a.source).select(F.col("doc_id").alias("id"), F.col("body").alias("text"))
        print("written %d, empty %d" % sinks.append_new(C.cleaned(C.without_back_matter(C.exploded(texts))).select("id", "text"), a.out, count=True))
    elif a.command == "export-clean":
        texts = tables.text_corpus(spark, a.source).select(F.col("doc_id").alias("id"), F.col("body").alias("text"))
        out = C.export_clean(texts)
        sinks.append_new(out, a.out) if a.skip_existing else out.write.mode("overwrite").parquet(a.out)
    elif a.command == "crawl-outputs":
        nodes = tables.saved_nodes(spark, a.inventory)
        if nodes is None:
            print(f"no saved inventory in {a.inventory}")
            return 1
        if a.progress:
            progress = "title string, url string, text_file string, canonical_title string, links array<string>, fetch_status string, failure_count int, last_http_status int"
            nodes = K.with_progress(nodes, spark.read.schema(progress).json(a.progress))
        K.write_outputs(nodes, a.out)
    return 0


def _rank_text_ids(scored):
    """Ranks of documents whose ids are texts: their places in the order of ids stand for the ids."""
    ids = G.ids_by_key(scored.select("doc_id").distinct().withColumn("tie", F.col("doc_id")), "doc_id", "tie", "_key").select("doc_id", "_key")
    return stable_rank(scored.join(ids, "doc_id"), key="_key").drop("_key")


if __name__ == "__main__":
    sys.exit(main())
