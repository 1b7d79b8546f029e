"""Sinks: rankings, features, coefficient tables, graphs, incremental cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rankings(ranking: DataFrame, path: str) -> None:
    """(query_id, doc_id, doc_rank, doc_score, model), a folder for each model."""
    ranking.select("query_id", "doc_id", "doc_rank", "doc_score", "model").write.mode("overwrite").partitionBy("model").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def write_wide(coefs: DataFrame, path: str, features: list[str]) -> None:
    """A row for each query, a column for each feature."""
    from lodestone.operators.stats import wide

    write_csv(wide(coefs, features), path)


def write_significance(tests: DataFrame, path: str) -> None:
    """Tests with a model column: a folder of CSV for each model, and one of all of them."""
    tests = tests.orderBy("model", F.asc_nulls_last("p_value"))
    tests.write.mode("overwrite").option("header", True).partitionBy("model").csv(f"{path}/by_model")
    write_csv(tests, f"{path}/all_models")


def write_experiments(results: DataFrame, path: str) -> None:
    write_csv(results.select("query_id", "doc_id", "old_rank", "new_rank", F.round("old_score", 6).alias("old_score"), F.round("new_score", 6).alias("new_score")), path)


def write_graph(nodes: DataFrame, edges: DataFrame, metadata: DataFrame, path: str, csv: bool = False) -> None:
    """Nodes and edges as Parquet (and as CSV), metadata as JSON. Titles and edges must be unique."""
    if not nodes.groupBy("title").count().filter("count > 1").isEmpty():
        raise ValueError("titles of nodes must differ")
    if not edges.groupBy("src", "dst").count().filter("count > 1").isEmpty():
        raise ValueError("edges must differ")
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.select("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")
    metadata.write.mode("overwrite").json(f"{path}/metadata")
    if csv:
        write_csv(nodes.select(*[c for c, kind in nodes.dtypes if not kind.startswith("array")]), f"{path}/nodes_csv")
        write_csv(edges.select("src", "dst"), f"{path}/edges_csv")


def append_new(rows: DataFrame, path: str, key: str = "id", count: bool = False) -> tuple[int, int] | None:
    """Appends the rows whose key the folder does not have; texts that came out empty are not written. With count: how many
    new rows were written, and how many rows were empty."""
    spark = rows.sparkSession
    empty = rows.filter(F.coalesce(F.length("text"), F.lit(0)) == 0).count() if count else 0
    rows = rows.filter(F.length("text") > 0)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        rows = rows.join(spark.read.parquet(path).select(key), key, "left_anti")
    had = spark.read.parquet(path).count() if count and hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop) else 0
    rows.write.mode("append").parquet(path)
    return (spark.read.parquet(path).count() - had, empty) if count else None
