"""Scorers: BM25, TF-IDF, dense vectors, late interaction, hybrids, chunk aggregates and what-if ranks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import let, tokens
from lodestone.operators.ranking import ID_BITS, STEPS, stable_rank
from lodestone.operators.steps import step

K1, B = 1.5, 0.75
#: Rows of a stated query set up to which it is sent to all tasks; a larger one is dealt out.
SENT_ROWS = 100_000


def small(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """df, sent to all tasks if it, or what it has no more rows than, has at most SENT_ROWS rows; else Spark chooses how to join it."""
    return F.broadcast(df) if len((df if bound is None else bound).select(F.lit(1)).head(SENT_ROWS + 1)) <= SENT_ROWS else df


def term_counts(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.size(tokens(F.coalesce(F.col("text"), F.lit("")))).alias("dl"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): rows that hold the term. Counted before anything is shuffled, so what moves is a task's vocabulary."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def postings(docs: DataFrame) -> DataFrame:
    """(term, df, idf) with idf = ln(1 + (N - df + .5) / (df + .5))."""
    n = docs.agg(F.count("*").alias("n"))
    return document_frequencies(docs).join(F.broadcast(n)).select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))


def bm25(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_score) of documents that share a term. Documents without one have score 0 and no row here."""
    terms = query_terms(queries)
    wanted = terms.select("term").distinct()
    sized = docs.select("doc_id", tokens(F.coalesce(F.col("text"), F.lit(""))).alias("t"))
    whole = sized.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("avgdl"))
    # the few query terms go to the documents: only their postings are shuffled
    tf = sized.select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term")).join(small(wanted), "term").groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(df, "term").join(F.broadcast(whole)).select("doc_id", "term", weight.alias("w"))
    return weighted.join(small(terms), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum("w"), 6).alias("doc_score"))


def with_frequency(tf: DataFrame, df: DataFrame) -> DataFrame:
    """tf with each term's df. Terms that hold over 1/SENT_ROWS of all postings are fewer than SENT_ROWS: they are sent to all
    tasks, and their many rows stay where they are. The rest, none of them frequent, are dealt by term."""
    total = df.agg(F.sum("df")).first()[0] or 0
    frequent = F.col("df") * SENT_ROWS > total
    tf = tf.filter("term is not null")
    sent = tf.join(F.broadcast(df.filter(frequent)), "term")
    if df.filter(~frequent).isEmpty():
        return sent
    dealt = tf.join(F.broadcast(df.filter(frequent).select("term")), "term", "left_anti").join(df.filter(~frequent), "term")
    return sent.unionByName(dealt)


def tfidf_weights(docs: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, weight): tf (ln((1+N)/(1+df)) + 1), each document's weights of length 1."""
    n = docs.agg(F.count("*").alias("n"))
    tf = with_frequency(term_counts(docs), step(document_frequencies(docs)) if df is None else df)
    raw = tf.join(F.broadcast(n)).select("doc_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = raw.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return raw.join(norm, "doc_id").select("doc_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def tfidf(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_score): cosine; query terms that no document has are ignored."""
    df = step(document_frequencies(docs))
    weights = tfidf_weights(docs, df)
    n = docs.agg(F.count("*").alias("n"))
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("tf"))
    q = asked.join(df, "term").join(F.broadcast(n)).select("query_id", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("raw"))
    norm = q.groupBy("query_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    q = q.join(norm, "query_id").select("query_id", "term", (F.col("raw") / F.col("norm")).alias("qw"))
    # the query terms go to the documents' weights where they are few
    return weights.join(small(q, asked), "term").groupBy("query_id", "doc_id").agg(F.round(F.sum(F.col("weight") * F.col("qw")), 6).alias("doc_score"))


def with_zeros(scores: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """Every document for every query of the stated set; 0 where there is no score."""
    ids = docs.select("doc_id", F.lit(0.0).alias("doc_score")).join(small(queries.select("query_id")))
    return scores.select("query_id", "doc_id", "doc_score").unionByName(ids).groupBy("query_id", "doc_id").agg(F.max("doc_score").alias("doc_score"))


def rank_all(scores: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    return stable_rank(with_zeros(scores, docs, queries)).select("query_id", "doc_id", "doc_rank", "doc_score")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x / F.nullif(norm, F.lit(0.0)))


def dense(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_score): inner product of each stated query's vector with each document's."""
    q = queries.select("query_id", F.col("v").alias("qv"))
    return vectors.join(small(q)).select("query_id", "doc_id", F.round(dot(F.col("v"), F.col("qv")), 6).alias("doc_score"))


def maxsim(doc_vectors: DataFrame, query_vectors: DataFrame) -> DataFrame:
    """(query_id, doc_id, doc_score): for each query vector the best of the document's, summed."""
    q = query_vectors.select("query_id", "pos", F.col("v").alias("qv"))
    met = doc_vectors.join(small(q)).select("query_id", "pos", "doc_id", dot(F.col("v"), F.col("qv")).alias("s"))
    return met.groupBy("query_id", "doc_id", "pos").agg(F.max("s").alias("s")).groupBy("query_id", "doc_id").agg(F.round(F.sum("s"), 6).alias("doc_score"))


def chunk_aggregate(chunks: DataFrame, weights=(0.40, 0.35, 0.20), rest: float = 0.05) -> DataFrame:
    """(query_id, doc_id, score) from (query_id, doc_id, chunk, s): weighted best chunks and the mean of the rest; missing ones give 0."""
    w = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("s"), "chunk")
    placed = chunks.withColumn("at", F.row_number().over(w))
    top = sum((F.sum(F.when(F.col("at") == i + 1, F.col("s") * x).otherwise(0.0)) for i, x in enumerate(weights)), F.lit(0.0))
    tail = F.coalesce(F.avg(F.when(F.col("at") > len(weights), F.col("s"))), F.lit(0.0))
    return placed.groupBy("query_id", "doc_id").agg(F.round(top + rest * tail, 6).alias("score"))


def min_max(scores: DataFrame, column: str) -> DataFrame:
    """The column scaled to 0..1 within each query; 0 where all are equal."""
    ends = scores.groupBy("query_id").agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    scaled = F.coalesce((F.col(column) - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)), F.lit(0.0))
    return scores.join(ends, "query_id").withColumn(column, scaled).drop("_lo", "_hi")


def hybrid(parts: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, doc_id, score, rank) from a column for each metric."""
    for column in weights:
        parts = min_max(parts, column)
    total = sum((F.col(c) * w for c, w in weights.items()), F.lit(0.0))
    return stable_rank(parts.select("query_id", "doc_id", F.round(total, 6).alias("score")), score="score", rank="rank")


def whatif(ranking: DataFrame, edits: DataFrame) -> DataFrame:
    """Where one edited document would stand, others unchanged. edits: (query_id, doc_id, new_score).

    Edits and documents are put into one order; an edit's place is the number of documents before it, without its own old
    self. It is counted within steps of score, after the steps before: no edit meets all documents."""
    mine = edits.join(ranking.select("query_id", "doc_id", F.col("doc_rank").alias("old_rank"), F.col("doc_score").alias("old_score")), ["query_id", "doc_id"])
    docs = ranking.select("query_id", F.lit(None).cast(dict(ranking.dtypes)["doc_id"]).alias("doc_id"), F.col("doc_score").alias("s"), F.col("doc_rank").alias("r"), F.lit(1).alias("doc"), F.lit(None).cast("double").alias("old_score"))
    asked = mine.select("query_id", "doc_id", F.col("new_score").alias("s"), F.col("old_rank").alias("r"), F.lit(0).alias("doc"), "old_score")
    rows = docs.unionByName(asked).withColumn("_step", F.floor(F.col("s") * STEPS).cast("long")).withColumn("_part", F.when(F.col("s") == 0, F.shiftright("r", ID_BITS)).otherwise(F.lit(0)))
    cells = rows.groupBy("query_id", "_step", "_part").agg(F.sum("doc").alias("_n"))
    before = Window.partitionBy("query_id").orderBy(F.desc("_step"), "_part").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("query_id", "_step", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("query_id", "_step", "_part").orderBy(F.desc("s"), "r", "doc").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("_at", F.sum("doc").over(within)).filter("doc = 0").join(cells, ["query_id", "_step", "_part"])
    own = (F.col("old_score") > F.col("s")).cast("long")
    return placed.select("query_id", "doc_id", F.col("r").alias("old_rank"), (F.col("_before") + F.col("_at") - own + 1).alias("new_rank"))


# ---- models that are plugged in


@dataclass(frozen=True)
class Models:
    """What a model would tell. The defaults are deterministic and only stand in for models: a text's vector counts its
    tokens by a hash, a pair's score is the share of tokens that both have, and a token's vector depends on the token alone.
    A real model is put in as columns too, for instance an iterator pandas UDF that loads it once a worker."""

    encode: Callable[[Column], Column] = lambda text: hashed(tokens(text))
    cross: Callable[[Column, Column], Column] = lambda query, text: shared(query, text)
    token_vectors: Callable[[Column], Column] = lambda words: F.transform(words, lambda w: token_vector(w))
    #: What cross is given of a query and of a text: worked out once a text, not once a pair.
    cross_query: Callable[[Column], Column] = lambda text: F.array_distinct(tokens(text))
    cross_text: Callable[[Column], Column] = lambda text: F.array_distinct(F.slice(tokens(text), 1, MOST_PAIR))


#: Dimensions of the stand-ins, and the most tokens of a pair, a query and a document that the models read.
DIMENSIONS, TOKEN_DIMENSIONS, MOST_PAIR, QUERY_TOKENS, DOC_TOKENS = 64, 8, 512, 32, 220
#: What asymmetric encoders are told before a text.
PREFIXES = {"query": "query: ", "passage": "passage: "}
MASK = "[MASK]"


def _hex(token: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(F.md5(token), at, n), 16, 10).cast("int")


def hashed(words: Column) -> Column:
    """Counts of tokens by a hash of DIMENSIONS values."""
    places = F.transform(words, lambda w: _hex(w, 1, 2) % DIMENSIONS)
    return let(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(DIMENSIONS - 1)), lambda d: F.size(F.filter(p, lambda x: x == d)).cast("double")))


def shared(a: Column, b: Column) -> Column:
    """Share of the tokens of two arrays without repeats that both have."""
    return let(F.size(F.array_intersect(a, b)), lambda both: F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0)))


def token_vector(word: Column) -> Column:
    return unit(F.array(*[_hex(word, 1 + 2 * d, 2) / 255.0 - 0.5 for d in range(TOKEN_DIMENSIONS)]))


def encode(texts: DataFrame, id_col: str, models: Models = Models(), prefix: str = "") -> DataFrame:
    """(id, v): a vector of length 1 for each text."""
    return texts.select(id_col, unit(models.encode(F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))))).alias("v"))


def encoded(docs: DataFrame, queries: DataFrame, models: Models = Models(), prefixes: bool = False) -> DataFrame:
    """(query_id, doc_id, doc_score): products of the vectors of texts and queries."""
    told = PREFIXES if prefixes else {"query": "", "passage": ""}
    return dense(encode(docs, "doc_id", models, told["passage"]), encode(queries, "query_id", models, told["query"])).fillna(0.0, ["doc_score"])


def crossed(docs: DataFrame, queries: DataFrame, models: Models = Models()) -> DataFrame:
    """(query_id, doc_id, doc_score): the score that a cross-encoder gives each pair of the stated queries and all documents."""
    texts = docs.select("doc_id", models.cross_text(F.coalesce("text", F.lit(""))).alias("text"))
    met = texts.join(small(queries.select("query_id", models.cross_query(F.col("text")).alias("query"))))
    return met.select("query_id", "doc_id", F.round(models.cross(F.col("query"), F.col("text")), 6).alias("doc_score"))


def late_interaction(docs: DataFrame, queries: DataFrame, models: Models = Models()) -> DataFrame:
    """(query_id, doc_id, doc_score): queries are filled up with MASK to QUERY_TOKENS, documents cut at DOC_TOKENS; tokens of
    punctuation alone have no vector."""
    asked = F.slice(F.concat(tokens(F.col("text")), F.array_repeat(F.lit(MASK), QUERY_TOKENS)), 1, QUERY_TOKENS)
    q = queries.select("query_id", F.posexplode(models.token_vectors(asked)).alias("pos", "v"))
    words = F.filter(F.slice(tokens(F.coalesce("text", F.lit(""))), 1, DOC_TOKENS), lambda w: w.rlike(r"[\p{L}\p{N}]"))
    d = docs.select("doc_id", F.explode(models.token_vectors(F.array_distinct(words))).alias("v"))
    return maxsim(d, q)


#: All scorers by name: (docs, queries) to scores. The first four are the light ones that "all" stands for.
RUNNERS = {
    "bm25": lambda docs, queries, models=None: bm25(docs, queries), "tfidf": lambda docs, queries, models=None: tfidf(docs, queries),
    "sbert": lambda docs, queries, models=None: encoded(docs, queries, models or Models()), "e5": lambda docs, queries, models=None: encoded(docs, queries, models or Models(), prefixes=True),
    "cross_encoder": lambda docs, queries, models=None: crossed(docs, queries, models or Models()), "colbert": lambda docs, queries, models=None: late_interaction(docs, queries, models or Models()),
}
LIGHT = ("bm25", "tfidf", "sbert", "e5")


# ---- experiments with edited documents


def edited(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """(query_id, doc_id, text): a lead before the beginning of a document. edits: (query_id, doc_id, lead, keep), keep being
    the number of words that stay, or null for all. Edits of documents that are not there are left out."""
    kept = F.when(F.col("keep").isNull(), F.col("text")).otherwise(F.array_join(F.slice(F.split(F.trim("text"), r"\s+"), F.lit(1), F.col("keep")), " "))
    return edits.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "doc_id").select("query_id", "doc_id", F.concat(F.col("lead"), F.lit(" "), kept).alias("text"))


def experiments(docs: DataFrame, queries: DataFrame, edits: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], ranking: DataFrame) -> DataFrame:
    """(query_id, doc_id, old_rank, new_rank, old_score, new_score) of each edit. score: (query_id, doc_id, new_score) of edited
    texts (query_id, doc_id, text) for queries."""
    new = score(edited(docs, edits), queries)
    old = ranking.select("query_id", "doc_id", F.round("doc_score", 6).alias("old_score"))
    return whatif(ranking, new).join(new, ["query_id", "doc_id"]).join(old, ["query_id", "doc_id"]).select("query_id", "doc_id", "old_rank", "new_rank", "old_score", F.round("new_score", 6).alias("new_score"))


def cross_edited(texts: DataFrame, queries: DataFrame, models: Models = Models()) -> DataFrame:
    met = texts.join(small(queries.select("query_id", models.cross_query(F.col("text")).alias("query"))), "query_id")
    return met.select("query_id", "doc_id", F.round(models.cross(F.col("query"), models.cross_text(F.col("text"))), 6).alias("new_score"))
