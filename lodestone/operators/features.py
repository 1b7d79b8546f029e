"""Features of documents: surface, readability, lexical and keyword measures.

What a language model would tell (content words, lemmas, proper nouns, entities, sentiment) comes from an annotator; the
default one is deterministic and only stands in for a model: content words are alphabetic words that are no stop words,
lemmas are lower-cased words, entities (and proper nouns) are capitalised words within a sentence, and a sentence's polarity
is the balance of the words of two short lists.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T

TOP, COMPLEX = 5, 3


#: Words of the stand-in for a model of sentiment.
GLAD = ("good", "great", "excellent", "happy", "love", "best", "beautiful", "nice", "wonderful", "win")
SAD = ("bad", "poor", "terrible", "sad", "hate", "worst", "ugly", "awful", "stupid", "lose")


def _balance(words: Column) -> Column:
    count = lambda known: F.size(F.filter(words, lambda w: w.isin(*known))).cast("double")
    return F.coalesce((count(GLAD) - count(SAD)) / F.nullif(count(GLAD) + count(SAD), F.lit(0.0)), F.lit(0.0))


@dataclass(frozen=True)
class Annotator:
    """Columns from a column of words (array) or of text."""

    content: Callable[[Column], Column] = lambda words: F.filter(words, lambda w: ~F.lower(w).isin(*T.STOP_WORDS) & (F.length(w) > 1))
    lemma: Callable[[Column], Column] = F.lower
    entities: Callable[[Column], Column] = lambda text: F.regexp_extract_all(text, F.lit(r"[\p{Ll},;] (\p{Lu}\p{Ll}+)"), F.lit(1))
    polarity: Callable[[Column], Column] | None = lambda sentence: _balance(T.alphabetic(F.lower(sentence)))


def weighted_mean(values: Column, weights: Column) -> Column:
    """Of two arrays; null where there is no weight."""
    total = F.aggregate(weights, F.lit(0.0), lambda s, w: s + w)
    return F.aggregate(F.zip_with(values, weights, lambda v, w: v * w), F.lit(0.0), lambda s, x: s + x) / F.nullif(total, F.lit(0.0))


def sentiment(text: Column, annotator: Annotator) -> Column:
    """Mean polarity of the sentences, by their words; null where the annotator has none, 0 for texts without words."""
    if annotator.polarity is None:
        return F.lit(None).cast("double")
    of = lambda s: weighted_mean(F.transform(s, lambda x: annotator.polarity(x)), F.transform(s, lambda x: F.size(T.alphabetic(x)).cast("double")))
    return F.coalesce(T.let(T.sentences(text), of), F.lit(0.0))


def most_frequent(items: Column) -> Column:
    """(item, n) of the most frequent item of an array, the first seen of several; ("", 0) of an empty one."""
    counted = lambda all_: F.transform(F.array_distinct(all_), lambda e, i: F.struct((-F.size(F.filter(all_, lambda x: x == e))).alias("n"), i.alias("i"), e.alias("item")))
    best = T.let(items, lambda all_: F.array_min(counted(all_)))
    return F.struct(F.coalesce(best["item"], F.lit("")).alias("item"), F.coalesce(-best["n"], F.lit(0)).alias("n"))


def surface(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), T.alphabetic(text).alias("words"))
    ends = F.when(F.size("words") > 0, F.greatest(T.sentence_ends(F.col("text")), F.lit(1))).otherwise(F.lit(0))
    rows = rows.select(
        "doc_id", F.size("words").alias("word_count"), F.size(T.tokens(F.col("text"))).alias("token_count"), ends.alias("sentence_count"),
        F.length("text").alias("char_count"), F.length(F.regexp_replace("text", r"\s", "")).alias("char_count_no_spaces"),
    )
    return rows.withColumn("avg_words_per_sentence", F.round(F.coalesce(F.col("word_count") / F.nullif("sentence_count", F.lit(0)), F.lit(0.0)), 6))


def readability(docs: DataFrame, annotator: Annotator = Annotator()) -> DataFrame:
    """Syllables a word, Flesch-Kincaid grade and Gunning fog; 0 for texts without words. Proper nouns are no complex words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    ends = T.sentence_ends(text)
    rows = docs.select("doc_id", ends.alias("ends"), F.transform(T.alphabetic(text), lambda w: T.syllables(w)).alias("s"), F.transform(annotator.entities(text), lambda w: T.syllables(w)).alias("e"))
    rows = rows.select("doc_id", F.greatest("ends", F.lit(1)).alias("ends"), F.size("s").alias("w"), F.aggregate("s", F.lit(0), lambda a, x: a + x).alias("syl"), (F.size(F.filter("s", lambda x: x >= COMPLEX)) - F.size(F.filter("e", lambda x: x >= COMPLEX))).alias("complex"))
    w = F.nullif("w", F.lit(0)).cast("double")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return rows.select(
        "doc_id",
        zero(F.col("syl") / w).alias("avg_syllables_per_word"),
        zero(0.39 * w / F.col("ends") + 11.8 * F.col("syl") / w - 15.59).alias("flesch_kincaid_grade"),
        zero(0.4 * (w / F.col("ends") + 100.0 * F.col("complex") / w)).alias("gunning_fog_index"),
    )


def lexical(docs: DataFrame, annotator: Annotator = Annotator()) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), T.alphabetic(text).alias("words"))
    rows = rows.select("doc_id", "text", F.size("words").alias("n"), F.size(annotator.content(F.col("words"))).alias("c"), F.size(F.array_distinct(F.transform("words", F.lower))).alias("d"), annotator.entities(F.col("text")).alias("e"), sentiment(F.col("text"), annotator).alias("p"))
    rows = rows.withColumn("m", most_frequent(F.col("e")))
    n = F.nullif("n", F.lit(0)).cast("double")
    return rows.select(
        "doc_id",
        F.round(F.coalesce(F.col("c") / n, F.lit(0.0)), 6).alias("lexical_density"),
        F.round(F.coalesce(F.col("d") / n, F.lit(0.0)), 6).alias("lexical_diversity"),
        F.size("e").alias("named_entity_count"),
        F.size(F.array_distinct("e")).alias("distinct_entities"),
        F.col("m.item").alias("top_entity"),
        F.col("m.n").alias("top_entity_count"),
        F.round("p", 6).alias("sentiment_polarity"),
    )


def keywords(docs: DataFrame, annotator: Annotator = Annotator(), top: int = TOP) -> DataFrame:
    """(doc_id, keyword_density, keywords): the share of the words that the most frequent content lemmas make up; ties to the
    earlier word. Counted where the document is; nothing is shuffled."""
    words = T.alphabetic(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select("doc_id", words.alias("words")).select("doc_id", F.size("words").alias("n"), F.transform(annotator.content(F.col("words")), annotator.lemma).alias("lemmas"))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute

        for batch in batches:
            lemmas = batch.column("lemmas")
            lengths = pa.compute.list_value_length(lemmas).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(batch.num_rows), lengths)
            coded = lemmas.flatten().dictionary_encode()
            code, many = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
            key, first, times = np.unique(doc * many + code, return_index=True, return_counts=True)
            order = np.lexsort((first, -times, key // many))
            key, times = key[order], times[order]
            starts = np.searchsorted(key // many, np.arange(batch.num_rows + 1))
            best = np.arange(len(key)) - starts[key // many] < top
            ends = np.searchsorted((key // many)[best], np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), coded.dictionary.take(pa.array(key[best] % many)))
            held = np.bincount((key // many)[best], times[best], batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), pa.array(held), pa.compute.binary_join(lists, " ")], ["doc_id", "n", "held", "keywords"])

    out = rows.mapInArrow(count, f"doc_id {dict(docs.dtypes)['doc_id']}, n int, held long, keywords string")
    return out.select("doc_id", F.round(F.coalesce(F.col("held") / F.nullif("n", F.lit(0)), F.lit(0.0)), 6).alias("keyword_density"), F.coalesce("keywords", F.lit("")).alias("keywords"))


def difference(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, feature, before, after, change) for all numeric columns."""
    names = [f.name for f in before.schema if f.name != key and f.dataType.typeName() in ("integer", "long", "double")]
    long = lambda df, name: df.select(key, *[F.col(n).cast("double").alias(n) for n in names]).unpivot([key], names, "feature", name)
    out = long(before, "before").join(long(after, "after"), [key, "feature"])
    return out.withColumn("change", F.round(F.col("after") - F.col("before"), 6))
