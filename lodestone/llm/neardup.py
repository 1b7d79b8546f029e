"""Near-duplicate documents: weighted MinHash by darts, banded joining, exact verification, connected classes.

A text is the weighted set of its word shingles, weights being their numbers. DartMinHash throws darts into each shingle's
region of weight and rank: a unit of weight receives a Poisson process of darts along the rank, the same wherever the
shingle occurs, and only darts of low rank (about k ln k + 2k a text) are ever made. Each dart falls on one of k
coordinates; a coordinate keeps its earliest dart. Two texts agree on a coordinate with probability sum(min)/sum(max).

Texts that are equal count once. Bands of ROWS coordinates deal texts to groups. A text is first compared with the leader of
one of its groups: the text that lies in the largest groups, so most near it. Where a group still holds several classes, its
texts are compared block by block (see closing), never emitted as pairs. Each link is verified on whole texts: weighted Jaccard >=
SIMILARITY. A link left out joins only texts that are in one class already. Classes are connected components.

A pair of similarity 0.8 shares no band with probability (1-0.8^4)^32 < 5e-8.

Defined results: words are lower-cased and cut at white space; a text with fewer words than a shingle is one shingle; null
texts and texts without words are near nothing, each row its own class; repeated rows are copies; a class's id is its smallest
doc_id (rows without id have none to give); texts of any length are compared whole; an empty table gives no rows; columns
other than id and text are not read, and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import discard, fresh, in_python, settle, table
from lodestone.llm.components import components
from lodestone.llm.rolling import WORD_BASE, U, mix, stretches, windows, words

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 4
K = BANDS * ROWS
#: Texts of a block when the classes of a heap of groups are closed.
CLOSING = 128
THROWN = K * np.log(K) + 2 * K


def weighted(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text's number, shingle's hash, weight), by text and hash."""
    tokens, bounds = words([t.lower().encode() for t in texts])
    n = np.diff(bounds)
    starts, at = windows(tokens, bounds, size)
    short = np.flatnonzero((n > 0) & (n < size))
    doc = np.concatenate([np.repeat(np.arange(len(texts)), np.diff(at)), short])
    begin, end = np.concatenate([starts, bounds[short]]), np.concatenate([starts + size, bounds[short] + n[short]])
    h = mix(stretches(tokens, begin, end, WORD_BASE), 3) if len(tokens) else np.zeros(0, U)
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, int)
    return doc[new], h[new], np.diff(np.append(new, len(h)))


def uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1]."""
    return ((h >> U(11)).astype(float) + 1) * 2.0**-53


def darts(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The signatures of n weighted sets: for each coordinate the number of its earliest dart."""
    total = np.bincount(doc, weight, n)
    limit = np.where(total > 0, THROWN / np.maximum(total, 1), 0.0)
    # the region's cells of weight: [0, 1), [1, 2), [2, 4), ...
    cells = np.ceil(np.log2(weight)).astype(int) + 1
    which = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
    cell_doc, cell_weight = np.repeat(doc, cells), np.repeat(weight, cells).astype(float)
    low = np.where(which > 0, 2.0 ** (which - 1), 0.0)
    width = np.where(which > 0, low, 1.0)
    seed = mix(np.repeat(h, cells) + which.astype(U) * U(0x9E3779B97F4A7C15))
    out = np.zeros(n * K, U)
    left = np.flatnonzero(total > 0)
    while len(left):
        mine = np.isin(cell_doc, left) if len(left) < n else np.ones(len(cell_doc), bool)
        d, s, lo, wd, w = cell_doc[mine], seed[mine], low[mine], width[mine], cell_weight[mine]
        rank = np.zeros(len(d))
        at, ranks, ids = [], [], []
        step = 0
        while len(d):
            step += 1
            h1 = mix(s + U(step), 4)
            rank = rank - np.log(uniform(h1)) / wd
            low_enough = rank <= limit[d]
            d, s, lo, wd, w, rank, h1 = (x[low_enough] for x in (d, s, lo, wd, w, rank, h1))
            h2 = mix(h1, 5)
            hit = lo + uniform(mix(h1, 6)) * wd <= w
            at.append((d * K + (h2 % U(K)).astype(np.int64))[hit])
            ranks.append(rank[hit])
            ids.append(h2[hit])
        at, ranks, ids = np.concatenate(at), np.concatenate(ranks), np.concatenate(ids)
        order = np.argsort(-ranks, kind="stable")  # the earliest is written last
        out[at[order]] = ids[order]
        full = np.zeros(n * K, bool)
        full[at] = True
        left = left[~full.reshape(n, K)[left].all(1)]
        limit[left] *= 2
    return out.reshape(n, K)


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit group number for each band."""
    out = np.broadcast_to(np.arange(BANDS, dtype=U) + U(1), (len(signature), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * U(WORD_BASE) + signature[:, r::ROWS][:, :BANDS], 7)
    return out.view(np.int64)


def jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = np.minimum(a[1][i], b[1][j]).sum()
    return float(both / max(1, a[1].sum() + b[1].sum() - both))


def groups(texts: DataFrame) -> DataFrame:
    """(g, k): band groups of the rows (k, text), of texts with words."""

    def run(batches):
        for batch in batches:
            given = batch.column(1).to_pylist()
            doc, h, weight = weighted(given)
            some = np.unique(doc)
            if not len(some):
                continue
            g = bands(darts(doc, h, weight, len(given)))[some]
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(batch.column(0))[some]), pa.array(list(g), pa.list_(pa.int64()))], ["k", "g"])

    return in_python(texts, run, "k long, g array<long>").select("k", F.explode("g").alias("g"))


def verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts are near enough, with their similarity."""
    left = texts.select(F.col("k").alias("a"), F.col("text").alias("left"))
    right = texts.select(F.col("k").alias("b"), F.col("text").alias("right"))
    met = pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            a, b, x, y = (c.to_pylist() for c in batch.columns)
            lefts = {k: i for i, k in enumerate(a)}  # a leader's text is cut once a batch
            doc, h, weight = weighted([*[x[i] for i in lefts.values()], *y])
            n = len(lefts)
            edge = np.searchsorted(doc, np.arange(n + len(y) + 1))
            of = lambda i: (h[edge[i] : edge[i + 1]], weight[edge[i] : edge[i + 1]])
            place = {k: i for i, k in enumerate(lefts)}
            sims = [jaccard(of(place[k]), of(n + i)) for i, k in enumerate(a)]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sims, pa.float64())], ["a", "b", "similarity"])

    return in_python(met, run, "a long, b long, similarity double").filter(F.col("similarity") >= similarity)


def forest(ks: np.ndarray, roots: np.ndarray, side: np.ndarray, texts: list[str], similarity: float) -> list[tuple[int, int, float]]:
    """Near pairs of different classes, only as many as connect them. side: where both halves are there, pairs lie across them."""
    doc, h, weight = weighted(texts)
    # a multiset as a set: each occurrence is an element of its own
    at = np.arange(weight.sum()) - np.repeat(np.cumsum(weight) - weight, weight)
    doc, h = np.repeat(doc, weight), mix(np.repeat(h, weight) + at.astype(U) * U(0x9E3779B97F4A7C15), 8)
    _, column, times = np.unique(h, return_inverse=True, return_counts=True)
    size = np.bincount(doc, minlength=len(texts))
    shared = times[column] > 1
    doc, column = doc[shared], column[shared]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], np.unique(column[order], return_inverse=True)[1]
    both = np.zeros((len(texts), len(texts)), np.float32)
    width = 1 << 13
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, width):  # the product in slices, of bounded size
        i, j = np.searchsorted(column, [lo, lo + width])
        x = np.zeros((len(texts), width), np.float32)
        x[doc[i:j], column[i:j] - lo] = 1
        both += x @ x.T
    near = both / np.maximum(size[:, None] + size[None] - both, 1)
    fits = np.triu((near >= similarity) & (roots[:, None] != roots[None]), 1)
    if len(np.unique(side)) > 1:
        fits &= side[:, None] != side[None]
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(fits), strict=True):
        a, b = top(int(roots[i])), top(int(roots[j]))
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.append((int(ks[i]), int(ks[j]), float(near[i, j])))
    return out


def closing(open_: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links between classes that still share a group. open_: (g, k, root).

    Texts that hang together by such groups are cut into blocks of CLOSING or so, and each two blocks meet in a task of their
    own, which compares all their texts by a matrix product and tells no more links than connect the classes. So every pair
    that shares a group is compared, but what Spark moves are blocks, never pairs."""
    open_ = settle(open_.select("g", "k", "root"))
    hung = components(open_.join(open_.groupBy("g").agg(F.min("k").alias("a")), "g").select("a", F.col("k").alias("b")).distinct())
    placed = open_.select("k", F.col("root").alias("class")).distinct().join(hung.select(F.col("node").alias("k"), F.col("root").alias("heap")), "k")
    many = placed.groupBy("heap").agg(F.ceil(F.count("*") / CLOSING).cast("int").alias("blocks"))
    placed = placed.join(many, "heap").withColumn("block", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int"))
    placed = placed.join(texts, "k").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = placed.select("heap", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "k", "class", "text")

    def compare(given: pa.Table) -> pa.Table:
        got = forest(given.column("k").to_numpy(), given.column("class").to_numpy(), given.column("block").to_numpy(), given.column("text").to_pylist(), similarity)
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table({n: pa.array(c, t) for n, t, c in zip(("a", "b", "similarity"), kinds, zip(*got, strict=True) if got else ((), (), ()), strict=True)})

    return met.groupBy("heap", "i", "j").applyInArrow(compare, "a long, b long, similarity double")


def links(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Verified pairs of different texts that suffice to connect their classes, as (a, b, similarity) of text keys; and (k, root)."""
    rows = docs.select(F.xxhash64("text").alias("k"), "text").filter(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    # each text once, copies going before the shuffle: from here on no key has more rows than there are different texts
    distinct = settle(rows.groupBy("k").agg(F.min("text").alias("text")))
    every = settle(groups(distinct))  # read twice
    # a text that lies amidst many others is in large groups: it leads, for most of them are near it
    size = every.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1")
    shared = settle(every.join(size, "g").select("g", "k", "n"))
    discard(every)
    weight = shared.groupBy("k").agg(F.sum("n").alias("weight"))
    rated = shared.join(weight, "k").select("g", "k", F.struct("weight", "k").alias("rating"))
    leader = rated.groupBy("g").agg(F.max("rating").alias("lead"))
    led = settle(rated.select("g", "k").join(leader, "g"))
    discard(shared)
    texts = settle(distinct.join(led.select("k").distinct(), "k", "left_semi"))
    discard(distinct)

    first = led.groupBy("k").agg(F.max("lead").alias("lead")).filter("lead.k <> k").select(F.col("lead.k").alias("a"), F.col("k").alias("b"))
    member = led.select("g", "k", F.col("lead.k").alias("a"))
    found = settle(verified(first, texts, similarity))
    roots = components(found)

    def several(roots: DataFrame) -> DataFrame:
        """Members, with their classes, of the groups that hold several classes."""
        placed = member.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k"))
        mixed = placed.groupBy("g").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("g")
        return placed.join(mixed, "g", "left_semi")

    more = settle(closing(several(roots), texts, similarity))
    discard(led, texts)
    found = found.union(more)
    # settled, so that Spark deals both sides of the joins that follow and can split a text or class of very many rows
    return found, settle(components(found))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Per row: doc_id, class_id (smallest id of the class), class_size (rows), n_texts (different texts of the class)."""
    given = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    _, roots = links(given, similarity)
    rows = given.select("doc_id", F.when(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.xxhash64("text")).alias("k"))
    placed = settle(rows.join(roots.withColumnRenamed("node", "k"), "k", "left").select("doc_id", "k", F.coalesce("root", "k").alias("root")))
    texts = placed.filter("root is not null").groupBy("root", "k").agg(F.min("doc_id").alias("id"), F.count("*").alias("n"))
    size = settle(texts.groupBy("root").agg(F.min("id").alias("class_id"), F.sum("n").alias("class_size"), F.count("*").alias("n_texts")))
    out = placed.join(size, "root", "left")
    return out.select("doc_id", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).alias("class_size"), F.coalesce("n_texts", F.lit(1)).alias("n_texts"))


def first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs, all columns, with one row of each class: its smallest id's (of several, the smallest text's hash). Rows without words stay."""
    _, roots = links(docs.select(F.col(text_col).alias("text")), similarity)
    i, k = fresh(docs, "first_id", "first_key")
    worded = F.col(text_col).rlike(r"[^\x20\x09-\x0D]")
    rows = docs.filter(worded).select(F.col(id_col).cast("long").alias(i), F.xxhash64(text_col).alias(k))
    placed = rows.join(roots, F.col(k) == F.col("node"), "left").select(i, k, F.coalesce("root", k).alias("root"))
    first = placed.groupBy("root").agg(F.min(F.struct(F.col(i).isNull().alias("n"), i, k)).alias("f")).select(f"f.{i}", f"f.{k}")
    mine = F.col(id_col).cast("long").eqNullSafe(F.col(i)) & (F.when(worded, F.xxhash64(text_col)) == F.col(k))
    kept = docs.join(first, mine, "left_semi")
    again = rows.join(first.select(F.col(i).alias("i"), F.col(k).alias("j")), F.col(i).eqNullSafe(F.col("i")) & (F.col(k) == F.col("j")), "left_semi").groupBy(i, k).count().filter("count > 1")
    if not again.isEmpty():  # rows with the same id and text: one of each
        again = again.select(i, k)
        kept = kept.join(again, mine, "left_anti").unionByName(kept.join(again, mine, "left_semi").dropDuplicates([id_col, text_col]))
    return kept.unionByName(docs.filter(~F.coalesce(worded, F.lit(False))))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents", "doc_id", "text"))
