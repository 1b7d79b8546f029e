"""Table and file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a Parquet table of the data folder."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def query_file(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query_text) of a JSON file: {"queries": [...]} or a plain list, whose positions become ids."""
    raw = spark.read.text(path, wholetext=True)
    records = F.from_json(F.get_json_object("value", "$.queries"), "array<struct<query_id:string,query_text:string>>")
    plain = F.from_json("value", "array<string>")
    listed = raw.filter(F.get_json_object("value", "$.queries").isNotNull()).select(F.explode(records).alias("q")).select("q.query_id", "q.query_text")
    bare = raw.filter(F.get_json_object("value", "$.queries").isNull()).select(F.posexplode(plain).alias("i", "query_text"))
    return listed.unionByName(bare.select(F.col("i").cast("string").alias("query_id"), "query_text"))


#: Stands for a genuine replacement character while undecodable bytes are dropped: two code points that no text holds.
KEPT_MARK = "\ufdd0\ufdd1"


def text_corpus(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(doc_id, title, body, text) of a folder of *.txt files, which must not be empty; undecodable bytes and a byte order mark
    are dropped. limit: so many files, by their names."""
    from lodestone.functions.text import title_from_stem

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    if raw.select("path").isEmpty():
        raise ValueError(f"no .txt files in {path}")
    stem = F.regexp_replace(F.element_at(F.split(F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B"))), "/"), -1), r"\.txt$", "")
    if limit is not None:
        raw = raw.orderBy(stem).limit(limit)
    said = F.replace(F.col("content").cast("string"), F.lit("\ufffd"), F.lit(KEPT_MARK))
    said = F.replace(F.replace(F.make_valid_utf8(said), F.lit("\ufffd"), F.lit("")), F.lit(KEPT_MARK), F.lit("\ufffd"))
    body = F.regexp_replace(F.regexp_replace(said, "^\ufeff", ""), r"^\s+|\s+$", "")
    rows = raw.select(stem.alias("doc_id"), title_from_stem(stem).alias("title"), body.alias("body"))
    return rows.withColumn("text", F.concat_ws(" ", "title", "body"))


def page_index(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a crawl's JSON index, with defaults for what is missing."""
    schema = "title string, canonical_title string, page_id long, kind string, url string, text_file string, discovered_from array<string>, fetch_status string, failure_count int, link_count int"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumns({"kind": F.coalesce("kind", F.lit("")), "fetch_status": F.coalesce("fetch_status", F.lit("pending")), "failure_count": F.coalesce("failure_count", F.lit(0))})


def csv_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"')
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def by_title(rows: DataFrame, title: str = "title") -> DataFrame:
    """Rows in the order of their titles without case, then with case."""
    return rows.orderBy(F.lower(title), title)


def wide_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, feature, coef) of a wide coefficient CSV."""
    from lodestone.operators.stats import long

    return long(csv_table(spark, path).withColumn("query_id", F.col("query_id").cast("string")))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(at)


def present(spark: SparkSession, paths: dict[str, str], say=print) -> dict[str, str]:
    """The inputs that are there; each missing one is told and skipped."""
    out = {}
    for name, path in paths.items():
        if exists(spark, path):
            out[name] = path
        else:
            say(f"skip {name}: {path} is missing")
    return out


def saved_state(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON state file, or None where it is missing or blank."""
    if not exists(spark, path):
        return None
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return None if rows.isEmpty() else rows


def saved_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """The nodes of a saved inventory {"nodes": [...]}, with defaults, or None where there is none."""
    from lodestone.operators.crawl import new_nodes

    state = saved_state(spark, path, "nodes array<struct<title:string,page_id:long,kind:string,requested_title:string,discovered_from:array<string>>>")
    return None if state is None else new_nodes(state.select(F.explode("nodes").alias("n")).select("n.*"))


def cached(spark: SparkSession, folder: str, name: str, of: DataFrame, make) -> DataFrame:
    """make(), kept as Parquet in a folder under the fingerprint of the rows that it is made of: an index, vectors or scores of
    another corpus are never read again."""
    whole = F.xxhash64(F.to_json(F.struct("*")))
    rows, digest, other = of.select(whole.alias("h")).agg(F.count("*"), F.bit_xor("h"), F.sum(F.col("h").cast("decimal(38,0)"))).first()
    path = f"{folder.rstrip('/')}/{name}-{rows}-{(digest or 0) & (1 << 64) - 1:016x}-{abs(int(other or 0)):x}"
    if not exists(spark, f"{path}/_SUCCESS"):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
