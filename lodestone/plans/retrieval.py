"""Retrieval queries over documents, benchmark items and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import STOP_WORDS, tokens
from lodestone.operators import local as L
from lodestone.operators import retrieval as R
from lodestone.sources.tables import table

#: Rows whose id is divisible by this are the queries of the vector searches and of the cross-encoder, which reads every pair; all
#: benchmark items are those of the other text searches.
EVERY = 50


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def cross_query_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query_set(spark, sf_dir).filter(F.col("query_id") % EVERY == 0)


def tokenize(spark, sf_dir):
    return corpus(spark, sf_dir).select("doc_id", F.size(tokens(F.col("text"))).alias("token_count"))


def bm25_postings(spark, sf_dir):
    return R.postings(corpus(spark, sf_dir)).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_rank(spark, sf_dir):
    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    scores = L.bm25(docs, queries)
    return R.rank_all(R.bm25(docs, queries), docs, queries) if scores is None else scores.ranking()


def bm25_top(spark, sf_dir, top: int):
    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    scores = L.bm25(docs, queries)
    return bm25_rank(spark, sf_dir).filter(F.col("doc_rank") <= top) if scores is None else scores.best(top)


def tfidf_weights(spark, sf_dir):
    return L.tfidf_weights(corpus(spark, sf_dir)).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def tfidf_rank(spark, sf_dir):
    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    scores = L.tfidf(docs, queries)
    return R.rank_all(R.tfidf(docs, queries), docs, queries) if scores is None else scores.ranking()


def tfidf_top(spark, sf_dir, top: int):
    scores = L.tfidf(corpus(spark, sf_dir), query_set(spark, sf_dir))
    return tfidf_rank(spark, sf_dir).filter(F.col("doc_rank") <= top) if scores is None else scores.best(top)


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings", "vec_id", "embedding")


def dense_rank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    docs = v.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    queries = v.filter(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    scores = L.inner(docs, queries)
    return R.stable_rank(R.dense(docs, queries)).select("query_id", "doc_id", "doc_rank", "doc_score") if scores is None else scores.ranking()


def maxsim_rank(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    docs = v.select(F.expr("vec_id div 5").alias("doc_id"), F.col("embedding").alias("v"))
    queries = v.filter(f"vec_id % {EVERY} = 0").select(F.expr(f"vec_id div {4 * EVERY}").alias("query_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    scores = L.maxsim(docs.withColumn("at", F.lit(0)), queries.select("query_id", "v"))
    return R.stable_rank(R.maxsim(docs, queries) if scores is None else scores).select("query_id", "doc_id", "doc_rank", "doc_score")


def chunk_agg(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    chunks = v.select(F.expr("vec_id div 7").alias("doc_id"), F.col("vec_id").alias("chunk"), F.col("embedding").alias("v"))
    queries = v.filter(f"vec_id % {EVERY} = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    scores = L.chunk_aggregate(chunks.withColumnRenamed("chunk", "at"), queries)
    if scores is not None:
        return scores
    q = R.small(queries.withColumnRenamed("v", "qv"))
    return R.chunk_aggregate(chunks.join(q).select("query_id", "doc_id", "chunk", R.dot(F.col("v"), F.col("qv")).alias("s")))


def hybrid_rank(spark, sf_dir):
    """BM25, the product of vectors, and PageRank. A document's vector is the one of its id, its page rank that of the node of its id."""
    from lodestone.plans import graphs

    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    vectors = _vectors(spark, sf_dir)
    asked = vectors.join(queries.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    authority = graphs.pagerank(spark, sf_dir).select(F.col("node").alias("doc_id"), F.col("pagerank").alias("authority"))
    parts = L.bm25(docs, queries, vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")).join(authority, "doc_id", "full"), "left")
    scores = L.hybrid(parts, asked, {"bm25": 0.4, "semantic": 0.4, "authority": 0.2}) if parts else None
    if scores is not None:
        return scores.ranking().withColumnsRenamed({"doc_score": "score", "doc_rank": "rank"}).select("query_id", "doc_id", "score", "rank")
    lexical = R.with_zeros(R.bm25(docs, queries), docs, queries).select("query_id", "doc_id", F.col("doc_score").alias("bm25"))
    semantic = R.dense(vectors.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), asked).withColumnRenamed("doc_score", "semantic")
    parts = lexical.join(semantic, ["query_id", "doc_id"], "left").join(authority, "doc_id", "left").fillna(0.0, ["semantic", "authority"])
    return R.hybrid(parts, {"bm25": 0.4, "semantic": 0.4, "authority": 0.2})


def encoded_rank(spark, sf_dir):
    docs, queries = corpus(spark, sf_dir), query_set(spark, sf_dir)
    raw = lambda texts, key, told: texts.select(key, R.Models().encode(F.concat(F.lit(told), F.coalesce("text", F.lit("")))).alias("v"))
    scores = L.cosines(raw(docs, "doc_id", R.PREFIXES["passage"]), raw(queries, "query_id", R.PREFIXES["query"]))
    return R.stable_rank(R.RUNNERS["e5"](docs, queries)).select("query_id", "doc_id", "doc_rank", "doc_score") if scores is None else scores.ranking()


def cross_rank(spark, sf_dir):
    docs, queries = corpus(spark, sf_dir), cross_query_set(spark, sf_dir)
    return R.stable_rank(R.RUNNERS["cross_encoder"](docs, queries)).select("query_id", "doc_id", "doc_rank", "doc_score")


def whatif_batch(spark, sf_dir):
    """Documents with the query put before their first 110 or 70 words, or before all of them."""
    docs, queries = corpus(spark, sf_dir), cross_query_set(spark, sf_dir)
    i = F.col("doc_id")
    keep = F.when(i % 3 == 0, 110).when(i % 3 == 1, 70)
    edits = docs.filter((i % 90).isin(7, 8, 9)).select("doc_id", keep.alias("keep")).join(R.small(queries.select("query_id", F.col("text").alias("lead"))))
    return R.experiments(docs, queries, edits, R.cross_edited, cross_rank(spark, sf_dir))


def as_sql_rounds(x):
    """To six digits by the product with 10^6, as DuckDB does; F.round goes by the decimal text, which differs for numbers that
    end in a 5 at the seventh digit."""
    return F.round(x * 1e6) / 1e6


def whatif_rank(spark, sf_dir):
    ranking = bm25_rank(spark, sf_dir)
    edits = ranking.filter("doc_id % 50 = 0").select("query_id", "doc_id", as_sql_rounds(F.col("doc_score") * 1.5).alias("new_score"))
    return R.whatif(ranking, edits)


QUERIES = {f.__name__: f for f in (tokenize, bm25_postings, bm25_rank, tfidf_weights, tfidf_rank, dense_rank, maxsim_rank, chunk_agg, hybrid_rank, encoded_rank, cross_rank, whatif_rank, whatif_batch)}

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def sql_tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda t: t NOT IN ({STOPS}))"


BASE = f"""
toks AS (SELECT doc_id, {sql_tokens("coalesce(text, '')")} AS t FROM documents),
flat AS (SELECT doc_id, unnest(t) AS term FROM toks),
tf AS (SELECT doc_id, term, count(*) AS tf FROM flat GROUP BY ALL),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
whole AS (SELECT count(*)::DOUBLE AS n, avg(len(t)) AS avgdl FROM toks),
qs AS (SELECT item_id AS query_id, {sql_tokens("text")} AS t FROM benchmark)"""
BM25 = f"""{BASE},
qt AS (SELECT DISTINCT query_id, unnest(t) AS term FROM qs),
hits AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(t) / avgdl))), 6) AS s
    FROM qt JOIN tf USING (term) JOIN dfs USING (term) JOIN toks USING (doc_id), whole GROUP BY query_id, doc_id),
bm AS (SELECT q.query_id, d.doc_id, coalesce(s, 0) AS doc_score FROM qs q CROSS JOIN documents d LEFT JOIN hits h ON h.query_id = q.query_id AND h.doc_id = d.doc_id),
bm_rank AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM bm)"""
WEIGHTS = """
raw AS (SELECT doc_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM tf JOIN dfs USING (term), whole),
weights AS (SELECT doc_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM raw)"""
TFIDF = f"""{WEIGHTS},
qtf AS (SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(t) AS term FROM qs) GROUP BY ALL),
qraw AS (SELECT query_id, term, tf * (ln((1 + n) / (1 + df)) + 1) AS raw FROM qtf JOIN dfs USING (term), whole),
qw AS (SELECT query_id, term, raw / sqrt(sum(raw * raw) OVER (PARTITION BY query_id)) AS qw FROM qraw),
thits AS (SELECT query_id, doc_id, round(sum(weight * qw), 6) AS s FROM weights JOIN qw USING (term) GROUP BY ALL),
ti AS (SELECT q.query_id, d.doc_id, coalesce(s, 0) AS doc_score FROM qs q CROSS JOIN documents d LEFT JOIN thits h ON h.query_id = q.query_id AND h.doc_id = d.doc_id),
ti_rank AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM ti)"""
DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def scaled(column: str) -> str:
    ends = f"(max({column}) OVER (PARTITION BY query_id) - min({column}) OVER (PARTITION BY query_id))"
    return f"coalesce(({column} - min({column}) OVER (PARTITION BY query_id)) / nullif({ends}, 0), 0)"


def graph_sql(name: str) -> str:
    from lodestone.plans import graphs

    return graphs.EDGES if name == "EDGES" else graphs._ranks_sql()


CROSS = f"""{BASE}, cr AS (SELECT query_id, doc_id, round(coalesce(len(list_intersect(list_distinct(q.t), list_distinct(d.t[1:512])))::DOUBLE / nullif(len(list_distinct(list_concat(q.t, d.t[1:512]))), 0), 0), 6) AS doc_score FROM qs q CROSS JOIN toks d WHERE query_id % {EVERY} = 0),
cr_rank AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM cr)"""
HASHED = "list_transform(range(64), lambda d: len(list_filter(list_transform({t}, lambda w: ('0x' || substr(md5(w), 1, 2))::INT % 64), lambda x: x = d))::DOUBLE)"
ORACLE_SQL = {
    "encoded_rank": f"""WITH dv AS (SELECT doc_id, {HASHED.format(t=sql_tokens("'passage: ' || coalesce(text, '')"))} AS v FROM documents), qv AS (SELECT item_id AS query_id, {HASHED.format(t=sql_tokens("'query: ' || coalesce(text, '')"))} AS v FROM benchmark),
s AS (SELECT query_id, doc_id, coalesce(round({DOT.format(a="dv.v", b="qv.v")} / nullif(sqrt({DOT.format(a="dv.v", b="dv.v")}) * sqrt({DOT.format(a="qv.v", b="qv.v")}), 0), 6), 0) AS doc_score FROM dv CROSS JOIN qv)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM s""",
    "cross_rank": f"WITH {CROSS} SELECT * FROM cr_rank",
    "whatif_batch": rf"""WITH {CROSS},
ed AS (SELECT item_id AS query_id, doc_id, {sql_tokens("b.text")} AS q, {sql_tokens("b.text || ' ' || CASE doc_id % 3 WHEN 0 THEN array_to_string(regexp_split_to_array(trim(d.text), '\\s+')[1:110], ' ') WHEN 1 THEN array_to_string(regexp_split_to_array(trim(d.text), '\\s+')[1:70], ' ') ELSE d.text END")} AS t
    FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d CROSS JOIN benchmark b WHERE item_id % {EVERY} = 0 AND doc_id % 90 IN (7, 8, 9)),
n AS (SELECT query_id, doc_id, round(coalesce(len(list_intersect(list_distinct(q), list_distinct(t[1:512])))::DOUBLE / nullif(len(list_distinct(list_concat(q, t[1:512]))), 0), 0), 6) AS new_score FROM ed)
SELECT n.query_id, n.doc_id, o.doc_rank AS old_rank, 1 + count(*) FILTER (WHERE r.doc_id <> n.doc_id AND (r.doc_score > new_score OR (r.doc_score = new_score AND r.doc_rank < o.doc_rank))) AS new_rank, any_value(o.doc_score) AS old_score, any_value(new_score) AS new_score
FROM n JOIN cr_rank o ON o.query_id = n.query_id AND o.doc_id = n.doc_id JOIN cr_rank r ON r.query_id = n.query_id GROUP BY n.query_id, n.doc_id, o.doc_rank""",
    "tokenize": f"SELECT doc_id, len({sql_tokens('text')}) AS token_count FROM documents",
    "bm25_postings": f"WITH {BASE} SELECT term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf FROM dfs, whole",
    "bm25_rank": f"WITH {BM25} SELECT * FROM bm_rank",
    "tfidf_weights": f"WITH {BASE}, {WEIGHTS} SELECT doc_id, term, round(weight, 6) AS weight FROM weights",
    "tfidf_rank": f"WITH {BASE}, {TFIDF} SELECT * FROM ti_rank",
    "dense_rank": f"""WITH s AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({DOT.format(a="d.embedding", b="q.embedding")}, 6) AS doc_score FROM embeddings d CROSS JOIN embeddings q WHERE q.vec_id % {EVERY} = 0)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM s""",
    "maxsim_rank": f"""WITH p AS (SELECT q.vec_id // {4 * EVERY} AS query_id, q.vec_id AS pos, d.vec_id // 5 AS doc_id, max({DOT.format(a="d.embedding", b="q.embedding")}) AS s FROM embeddings d CROSS JOIN embeddings q WHERE q.vec_id % {EVERY} = 0 GROUP BY 1, 2, 3),
s AS (SELECT query_id, doc_id, round(sum(s), 6) AS doc_score FROM p GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_score DESC, doc_id) AS doc_rank, doc_score FROM s""",
    "chunk_agg": f"""WITH p AS (SELECT q.vec_id AS query_id, d.vec_id // 7 AS doc_id, {DOT.format(a="d.embedding", b="q.embedding")} AS s, d.vec_id AS c FROM embeddings d CROSS JOIN embeddings q WHERE q.vec_id % {EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY s DESC, c) AS "at" FROM p)
SELECT query_id, doc_id, round(sum(CASE WHEN "at" = 1 THEN 0.4::DOUBLE * s WHEN "at" = 2 THEN 0.35::DOUBLE * s WHEN "at" = 3 THEN 0.2::DOUBLE * s ELSE 0 END) + 0.05::DOUBLE * coalesce(avg(CASE WHEN "at" > 3 THEN s END), 0), 6) AS score FROM r GROUP BY ALL""",
    "hybrid_rank": f"""WITH {BM25}, {graph_sql("EDGES")}, {graph_sql("RANKS")},
dn AS (SELECT q.vec_id AS query_id, d.vec_id AS doc_id, round({DOT.format(a="d.embedding", b="q.embedding")}, 6) AS t FROM embeddings d CROSS JOIN embeddings q WHERE q.vec_id IN (SELECT query_id FROM qs)),
p AS (SELECT bm.query_id, bm.doc_id, bm.doc_score AS b, coalesce(t, 0) AS t, coalesce(round(pagerank, 9), 0) AS a FROM bm LEFT JOIN dn ON bm.query_id = dn.query_id AND bm.doc_id = dn.doc_id LEFT JOIN ranks ON ranks.node = bm.doc_id),
s AS (SELECT query_id, doc_id, round(0.4::DOUBLE * {scaled("b")} + 0.4::DOUBLE * {scaled("t")} + 0.2::DOUBLE * {scaled("a")}, 6) AS score FROM p)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s""",
    "whatif_rank": f"""WITH {BM25}, e AS (SELECT query_id, doc_id, doc_rank AS old_rank, round(doc_score * 1.5::DOUBLE, 6) AS new_score FROM bm_rank WHERE doc_id % 50 = 0)
SELECT e.query_id, e.doc_id, old_rank, 1 + count(*) FILTER (WHERE r.doc_id <> e.doc_id AND (r.doc_score > new_score OR (r.doc_score = new_score AND r.doc_rank < old_rank))) AS new_rank
FROM e JOIN bm_rank r ON r.query_id = e.query_id GROUP BY ALL""",
}
