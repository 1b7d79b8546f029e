"""Scalar text functions and document features."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import features as X
from lodestone.plans.pages import q
from lodestone.plans.retrieval import STOPS, sql_tokens
from lodestone.sources.tables import table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text")


def title_from_stem(spark, sf_dir):
    stem = F.concat(F.translate("p_name", " ", "_"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.substring(F.sha1("p_name"), 1, 10))).otherwise(F.lit("")))
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), T.title_from_stem(stem).alias("value"))


def norm_lookup(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), F.md5(T.lookup_key(F.col("text"))).alias("value"))


def slug(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), T.slug(F.col("text")).alias("value"))


def query_key(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), T.query_key(F.col("text")).alias("value"))


def head_words(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.col("doc_id").alias("id"), T.head_words(F.col("text"), 20).alias("value"))


def safe_stem(spark, sf_dir):
    return table(spark, sf_dir, "part", "p_partkey", "p_name").select(F.col("p_partkey").alias("id"), T.safe_stem(F.col("p_name")).alias("value"))


def syllables(spark, sf_dir):
    words = _docs(spark, sf_dir).select(F.explode(T.alphabetic(F.col("text"))).alias("w")).select(F.lower("w").alias("word")).distinct()
    return words.select("word", T.syllables(F.col("word")).alias("n"))


def surface_features(spark, sf_dir):
    return X.surface(_docs(spark, sf_dir))


def readability(spark, sf_dir):
    return X.readability(_docs(spark, sf_dir))


def lexical_features(spark, sf_dir):
    return X.lexical(_docs(spark, sf_dir))


def keyword_density(spark, sf_dir):
    return X.keywords(_docs(spark, sf_dir))


def feature_diff(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    edited = docs.select("doc_id", T.head_words(F.col("text"), 110).alias("text"))
    return X.difference(X.surface(docs), X.surface(edited))


QUERIES = {f.__name__: f for f in (title_from_stem, norm_lookup, slug, query_key, head_words, safe_stem, syllables, surface_features, readability, lexical_features, keyword_density, feature_diff)}

SYL = "greatest(len(regexp_extract_all(lower({w}), '[aeiouy]+')) - CASE WHEN ends_with(lower({w}), 'e') AND len(regexp_extract_all(lower({w}), '[aeiouy]+')) > 1 THEN 1 ELSE 0 END, 1)"
ENDS = r"len(regexp_extract_all({t}, '[.!?]+(\s|$)'))"
WORDS = r"regexp_extract_all({t}, '\p{{L}}+')"


def surface_sql(source: str) -> str:
    return rf"""SELECT doc_id, wc AS word_count, tc AS token_count, sc AS sentence_count, length(text) AS char_count, length(regexp_replace(text, '\s', '', 'g')) AS char_count_no_spaces, round(coalesce(wc / nullif(sc, 0), 0), 6) AS avg_words_per_sentence
FROM (SELECT doc_id, text, len({WORDS.format(t="text")}) AS wc, len({sql_tokens("text")}) AS tc, CASE WHEN len({WORDS.format(t="text")}) > 0 THEN greatest({ENDS.format(t="text")}, 1) ELSE 0 END AS sc FROM {source})"""


HEAD = r"array_to_string(regexp_split_to_array(trim(text), '\s+')[1:{n}], ' ')"
NUMBERS = ("word_count", "token_count", "sentence_count", "char_count", "char_count_no_spaces", "avg_words_per_sentence")
CONTENT = f"list_filter({WORDS.format(t='text')}, lambda w: lower(w) NOT IN ({STOPS}) AND length(w) > 1)"
PROPER = r"regexp_extract_all(text, '[\p{Ll},;] (\p{Lu}\p{Ll}+)', 1)"
GLAD, SAD = (str(tuple(x)) for x in (X.GLAD, X.SAD))
ORACLE_SQL = {
    "title_from_stem": "SELECT p_partkey AS id, trim(replace(regexp_replace(replace(p_name, ' ', '_') || CASE WHEN p_partkey % 3 = 0 THEN '_' || substr(sha1(p_name), 1, 10) ELSE '' END, '_[0-9a-fA-F]{8,}$', ''), '_', ' ')) AS value FROM part",
    "norm_lookup": "SELECT doc_id AS id, md5(replace(lower(trim(text)), 'ß', 'ss')) AS value FROM documents",
    "slug": r"SELECT doc_id AS id, substr(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 48) AS value FROM documents",
    "query_key": r"SELECT item_id AS id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS value FROM benchmark",
    "head_words": f"SELECT doc_id AS id, {HEAD.format(n=20)} AS value FROM documents",
    "safe_stem": rf"""SELECT p_partkey AS id, substr(regexp_replace(regexp_replace(regexp_replace(p_name, {q('[<>:"/\\|?*]')}, '-', 'g'), '\s+', '_', 'g'), '^[_.]+|[_.]+$', '', 'g'), 1, 80) || '_' || substr(sha1(p_name), 1, 10) AS value FROM part""",
    "syllables": f"SELECT DISTINCT word, {SYL.format(w='word')} AS n FROM (SELECT lower(unnest({WORDS.format(t='text')})) AS word FROM documents)",
    "surface_features": surface_sql("(SELECT doc_id, coalesce(text, '') AS text FROM documents)"),
    "readability": f"""SELECT doc_id, round(coalesce(syl / w, 0), 6) AS avg_syllables_per_word, round(coalesce(0.39::DOUBLE * w / e + 11.8::DOUBLE * syl / w - 15.59::DOUBLE, 0), 6) AS flesch_kincaid_grade, round(coalesce(0.4::DOUBLE * (w / e + 100.0::DOUBLE * c / w), 0), 6) AS gunning_fog_index
FROM (SELECT doc_id, e, nullif(len(s), 0)::DOUBLE AS w, coalesce(list_sum(s), 0)::DOUBLE AS syl, len(list_filter(s, lambda x: x >= 3)) - len(list_filter(pn, lambda x: x >= 3)) AS c FROM (SELECT doc_id, greatest({ENDS.format(t="text")}, 1) AS e, list_transform({WORDS.format(t="text")}, lambda w: {SYL.format(w="w")}) AS s, list_transform({PROPER}, lambda w: {SYL.format(w="w")}) AS pn FROM documents))""",
    "lexical_features": rf"""WITH sent AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+(?:[ \t\n\x0B\f\r]+|\z)'), lambda x: trim(x)), lambda x: x <> '')) AS s FROM documents),
balance AS (SELECT doc_id, len(ws)::DOUBLE AS w, len(list_filter(ws, lambda x: x IN {GLAD}))::DOUBLE AS g, len(list_filter(ws, lambda x: x IN {SAD}))::DOUBLE AS b FROM (SELECT doc_id, regexp_extract_all(lower(s), '\p{{L}}+') AS ws FROM sent)),
polarity AS (SELECT doc_id, sum(coalesce((g - b) / nullif(g + b, 0), 0) * w) / nullif(sum(w), 0) AS pol FROM balance GROUP BY doc_id)
SELECT doc_id, round(coalesce(c / n, 0), 6) AS lexical_density, round(coalesce(d / n, 0), 6) AS lexical_diversity, len(e) AS named_entity_count, len(list_distinct(e)) AS distinct_entities, coalesce(top.item, '') AS top_entity, coalesce(top.n, 0) AS top_entity_count, round(coalesce(pol, 0), 6) AS sentiment_polarity
FROM (SELECT d.doc_id AS doc_id, nullif(len({WORDS.format(t="text")}), 0)::DOUBLE AS n, len({CONTENT}) AS c, len(list_distinct(list_transform({WORDS.format(t="text")}, lambda w: lower(w)))) AS d, {PROPER} AS e, (SELECT {{'item': x, 'n': count(*)}} FROM (SELECT unnest({PROPER}) AS x, unnest(range(len({PROPER}))) AS i) GROUP BY x ORDER BY count(*) DESC, min(i) LIMIT 1) AS top, pol FROM documents d LEFT JOIN polarity USING (doc_id))""",
    "keyword_density": f"""WITH w AS (SELECT doc_id, len({WORDS.format(t="text")}) AS n, {CONTENT} AS c FROM documents),
f AS (SELECT doc_id, lower(unnest(c)) AS lemma, unnest(range(len(c))) AS pos FROM w), g AS (SELECT doc_id, lemma, count(*) AS k, min(pos) AS p FROM f GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k DESC, p) AS i FROM g), t AS (SELECT doc_id, sum(k) AS k, string_agg(lemma, ' ' ORDER BY i) AS keywords FROM r WHERE i <= 5 GROUP BY doc_id)
SELECT doc_id, round(coalesce(k / nullif(n, 0), 0), 6) AS keyword_density, coalesce(keywords, '') AS keywords FROM w LEFT JOIN t USING (doc_id)""",
    "feature_diff": f"""WITH a AS ({surface_sql("documents")}), b AS ({surface_sql(f"(SELECT doc_id, {HEAD.format(n=110)} AS text FROM documents)")}),
la AS (UNPIVOT (SELECT doc_id, {", ".join(f"{n}::DOUBLE AS {n}" for n in NUMBERS)} FROM a) ON {", ".join(NUMBERS)} INTO NAME feature VALUE before),
lb AS (UNPIVOT (SELECT doc_id, {", ".join(f"{n}::DOUBLE AS {n}" for n in NUMBERS)} FROM b) ON {", ".join(NUMBERS)} INTO NAME feature VALUE after)
SELECT doc_id, feature, before, after, round(after - before, 6) AS change FROM la JOIN lb USING (doc_id, feature)""",
}
