"""Benchmark decontamination in DataFrame functions: SimHash windows, multi-index Hamming blocks, exact verification.

A document's passage counts as a benchmark item if their weighted shingle similarity, sum(min)/sum(max) of the numbers of
five-word shingles, is SIMILARITY or more. The steps:

1. Anchors. A window that near an item lacks at most (1-SIMILARITY) of the item's shingle weight, so of any that many plus
   one different shingles it has one. The first ones by hash are the item's anchors. A text's shingles are asked against a
   bit table of all anchors, in the row (the table's size is bounded by BITS, whatever the benchmark's size; it only lets some
   through in vain), and the few that pass are joined with the anchors.
2. Windows. Each anchor met gives the window that would be the item: as many words, at the anchor's offset. Windows of equal
   words, for one item, are one from here on, however many documents hold them.
3. SimHash: FINGERPRINT bits, weighted by the shingles' numbers. With BLOCKS = RADIUS + 1 blocks, two fingerprints within
   RADIUS agree on a block; so the join on (item, block, value) meets every pair within the radius. The item is part of the
   key, so a window meets the items whose anchors it holds and no others.
4. Pairs within RADIUS are verified exactly.

A pair of similarity 0.8 or more is beyond the radius with probability under 0.01 at 0.8 itself, falling fast above it.

Defined results: words are lower-cased runs of letters and digits; an item of fewer than five words is one shingle of its own
words, found where the text holds just these, and once a text; items of equal words are found together; null and empty texts
hold nothing; empty tables give no rows and find nothing; a window is cut at the text's ends; texts of any length are read
whole, in one row; repeated rows each get their result; of equally near items all are told; columns other than ids and texts
are not read, and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import fresh, let, plain, settle, table

SHINGLE, SIMILARITY = 5, 0.8
#: Bits of the fingerprint, in 64-bit parts; radius and blocks of BLOCK bits each.
PARTS, BLOCK = 2, 4
BLOCKS = PARTS * 64 // BLOCK
RADIUS = BLOCKS - 1
#: Bits of the anchor table: at least 64 for each anchor, within these bounds.
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 23
#: Anchors up to which their table is sent to all tasks; a larger one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def shingle_hashes(words: Column, n: int = SHINGLE) -> Column:
    """Hash of each n words, by place; empty if there are fewer."""

    def of(w: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(w) - n)
        return F.when(F.size(w) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(n)]))).otherwise(F.array().cast("array<long>"))

    return let(words, of)


def item_hashes(words: Column, n_words: Column) -> Column:
    """Shingles of words that stand against an item of n_words: of five words, or of all if the item has fewer."""
    out = shingle_hashes(words)
    for n in range(1, SHINGLE):
        out = F.when(n_words == n, shingle_hashes(words, n)).otherwise(out)
    return out


def tagged(hashes: Column) -> Column:
    """A multiset of hashes as a set: each hash with the number of its earlier occurrences."""
    numbered = F.transform(hashes, lambda h, i: F.xxhash64(h, F.size(F.filter(F.slice(hashes, 1, i), lambda x: x == h))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.transform(hashes, lambda h: F.xxhash64(h, F.lit(0)))).otherwise(numbered)


def simhash(hashes: Column) -> Column:
    """Parts of the fingerprint; a shingle that occurs n times weighs n."""
    zeros = F.array_repeat(F.lit(0), 64)

    def part(p: int) -> Column:
        seeded = F.transform(hashes, lambda h: F.xxhash64(h, F.lit(p + 1)))
        sums = F.aggregate(seeded, zeros, lambda s, h: F.transform(s, lambda x, b: x + F.when(_shift(h, b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)))
        bits = F.transform(sums, lambda x, b: F.when(x > 0, _power(b)).otherwise(F.lit(0).cast("long")))
        return F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s.bitwiseOR(x))

    return F.array(*[part(p) for p in range(PARTS)])


def hits_of(words: Column, bits: Column, size: int, short: list[int]) -> Column:
    """(place, h) of the shingles that the bit table lets through; those of short items' sizes at their first place only."""
    hashes = shingle_hashes(words)
    hits = F.filter(F.transform(hashes, lambda h, i: F.when(in_table(h, bits, size), F.struct(i.alias("place"), h.alias("h")))), lambda x: x.isNotNull())

    def first(hashes: Column) -> Column:
        return F.transform(F.filter(F.array_distinct(hashes), lambda h: in_table(h, bits, size)), lambda h: F.struct((F.array_position(hashes, h) - 1).cast("int").alias("place"), h.alias("h")))

    return F.concat(hits, *[let(shingle_hashes(words, n), first) for n in short]) if short else hits


def _shift(h: Column, by: Column) -> Column:
    return F.call_function("shiftrightunsigned", h, by)


def _power(by: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), by)


def distance(a: Column, b: Column) -> Column:
    return sum((F.bit_count(F.get(a, F.lit(p)).bitwiseXOR(F.get(b, F.lit(p)))) for p in range(1, PARTS)), F.bit_count(F.get(a, F.lit(0)).bitwiseXOR(F.get(b, F.lit(0)))))


def blocks(fingerprint: Column) -> Column:
    """The block values, by place."""
    per = 64 // BLOCK
    return F.transform(F.sequence(F.lit(0), F.lit(BLOCKS - 1)), lambda j: _shift(F.get(fingerprint, F.floor(j / per).cast("int")), j % per * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1)))


def known_items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_ids, n_words, hashes, fingerprint) of different items; item is the hash of the words."""
    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), plain(F.col(text_col)).alias("said")).filter("said <> ''")
    rows = rows.groupBy("said").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    rows = rows.withColumn("words", F.split("said", " "))
    rows = rows.select(F.xxhash64("said").alias("item"), "item_ids", F.size("words").alias("n_words"), item_hashes(F.col("words"), F.size("words")).alias("hashes"))
    return rows.select("*", simhash(F.col("hashes")).alias("fingerprint"))


def anchor_rows(items: DataFrame, similarity: float) -> DataFrame:
    """(h, item, n_words, at): an anchor, the item and its size, and the anchor's places in it."""
    need = F.floor((1 - similarity) * F.size("hashes") + 1e-9).cast("int") + 1
    first = F.slice(F.array_sort(F.array_distinct("hashes")), 1, need)
    rows = items.select("item", "n_words", "hashes", F.explode(first).alias("h"))
    places = F.filter(F.transform("hashes", lambda x, i: F.when(x == F.col("h"), i)), lambda i: i.isNotNull())
    return rows.select("h", "item", "n_words", F.explode(places).alias("at"))


def bit_table(anchors: DataFrame, n: int) -> tuple[Column, int]:
    """A literal table of bits, of bounded size, with two bits set for each anchor."""
    size = LEAST_BITS
    while size < min(64 * n, MOST_BITS):
        size *= 2
    spots = anchors.select(F.explode(F.array(*[F.pmod(p, F.lit(size)) for p in probes(F.col("h"))])).alias("b"))
    found = spots.groupBy(F.call_function("shiftrightunsigned", "b", F.lit(6)).alias("at")).agg(F.bit_or(_power(F.col("b").bitwiseAND(F.lit(63)).cast("int"))).alias("bits")).collect()
    row = [0] * (size // 64)
    for r in found:
        row[r["at"]] = r["bits"]
    return F.split(F.lit(",".join(map(str, row))), ",").cast("array<long>"), size


def probes(h: Column) -> list[Column]:
    return [_shift(h, F.lit(1)), F.xxhash64(h)]


def in_table(h: Column, bits: Column, size: int) -> Column:
    def one(p):
        b = F.pmod(p, F.lit(size))
        return _shift(F.get(bits, _shift(b, F.lit(6)).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    first, second = probes(h)
    return one(first) & one(second)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, key, item_ids, similarity, start, n_words): passages near an item, the key being the text's hash."""
    items = settle(known_items(benchmark, *benchmark.columns[:2]))
    anchors = settle(anchor_rows(items, similarity))
    n_anchors = anchors.count()
    bits, size = bit_table(anchors, n_anchors)
    short = sorted(r["n_words"] for r in items.filter(F.col("n_words") < SHINGLE).select("n_words").distinct().collect())
    if n_anchors <= BROADCAST_ROWS:
        anchors = F.broadcast(anchors)  # the size is checked

    text = F.coalesce(F.col(text_col), F.lit(""))
    met = let(F.split(plain(F.col(text_col)), " "), lambda w: F.struct(w.alias("words"), hits_of(w, bits, size, short).alias("hits")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), met.alias("met")).filter(F.size("met.hits") > 0)
    met = rows.select("doc_id", "key", F.col("met.words").alias("words"), F.explode("met.hits").alias("hit"))
    met = met.select("doc_id", "key", "words", "hit.place", "hit.h").join(anchors, "h")
    start = F.greatest(F.col("place") - F.col("at"), F.lit(0))
    window = F.array_join(F.slice("words", start + 1, F.col("n_words")), " ")
    met = settle(met.select("doc_id", "key", "item", "n_words", start.alias("start"), window.alias("window")).distinct())

    windows = met.select("item", "n_words", "window").distinct().withColumn("theirs", item_hashes(F.split("window", " "), F.col("n_words"))).filter(F.size("theirs") > 0)
    windows = settle(windows.withColumn("print", simhash(F.col("theirs"))))
    cut = lambda df, fingerprint: df.select("*", F.posexplode(blocks(F.col(fingerprint))).alias("block", "value"))
    pairs = cut(windows.select("item", "window", "print"), "print").join(cut(items.select("item", "fingerprint"), "fingerprint"), ["item", "block", "value"])
    pairs = pairs.filter(distance(F.col("print"), F.col("fingerprint")) <= RADIUS).select("item", "window").distinct()
    a, b = tagged(F.col("theirs")), tagged(F.col("hashes"))
    near = pairs.join(windows.select("item", "window", "theirs"), ["item", "window"]).join(items.select("item", "item_ids", "hashes"), "item")
    near = near.select("item", "window", "item_ids", (F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b))).alias("similarity"))
    near = near.filter(F.col("similarity") >= similarity)
    return met.join(near, ["item", "window"]).select("doc_id", "key", "item_ids", "similarity", "start", "n_words")


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, contaminated, n_items, item_ids (sorted), best_similarity (0 if none)."""
    found = matches(docs, benchmark, id_col, text_col, similarity)
    found = found.groupBy("doc_id", "key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("item_ids"), F.max("similarity").alias("best_similarity"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("key"))
    out = rows.alias("r").join(found.alias("f"), F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.key") == F.col("f.key")), "left")
    ids = F.coalesce("f.item_ids", F.array().cast("array<long>"))
    return out.select("r.doc_id", (F.size(ids) > 0).alias("contaminated"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"), F.coalesce("f.best_similarity", F.lit(0.0)).alias("best_similarity"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs, all columns, without the rows that hold a benchmark item."""
    i, k = fresh(docs, "leak_id", "leak_key")
    found = matches(docs, benchmark).select(F.col("doc_id").alias(i), F.col("key").alias(k)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(F.coalesce(F.col("text"), F.lit(""))) == F.col(k))
    return docs.join(found, same, "left_anti")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
