"""Maximum inner product search: score-aware anisotropic product quantisation, four-bit table scans, exact reranking.

The codebooks (16 centres for each SUBSPACE of dimensions, so four bits each) are fitted to a bounded sample by the
anisotropic loss: the part of a residual along its vector, which moves the score of a query that the vector is a good answer
to, weighs PARALLEL times the part across. All vectors are coded by coordinate descent on the same loss, in one pass that
writes id, vector, code and what the code leaves of the vector's length. A query makes tables of its products with the
centres, in small integers; the tables of two neighbouring parts are added to one that a byte of codes looks up, and the sums
of looked up entries rank all vectors.

A sum and the length of the residual give the most that a vector's score can be. The RERANK best sums of the first block of
vectors are scored exactly, which gives a query a least score to beat; after that every vector that can reach the query's
20th best score so far is scored exactly, in double precision, and no other. So codes only save work: what they are worth
on given rows (near copies, groups closer than centres are, lengths of several scales) changes the time, not the answer.

Each block of vectors goes once to each block of queries; blocks of queries grow with their number up to QUERY_MOST, so that
vectors travel a few times only. A task keeps the best top of each query of its block, and a strand of vectors gives no more.

Defined results: vectors that are null, all zero, of another length than most, or hold null or non-finite components take no
part; ties go to the smaller vec_id; a query has fewer rows if there are fewer candidates; repeated rows are candidates each,
but a query's own id never is; a query id that has several vectors asks with the least of them, in the order of arrays; an
empty table gives no rows; only id and vector are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.common import in_python, settle, table

CENTRES, SUBSPACE, PARALLEL = 16, 2, 4.0
SAMPLE, ROUNDS = 4000, 12
#: Vectors and queries of a block, queries of a block at most, and vectors of a strand.
ROW_BLOCK, QUERY_BLOCK, QUERY_MOST, STRAND = 8192, 512, 16384, 1 << 15
#: A query's best sums of its first block that are scored exactly before anything is ruled out.
RERANK = 100
TOP = 20


def cost_matrices(x: np.ndarray, books: np.ndarray, parallel: float):
    """Residual squares, and residual products with the vector's direction, of each part and centre."""
    n, parts = len(x), books.shape[0]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cut, dirs = x.reshape(n, parts, -1), unit.reshape(n, parts, -1)
    residual = cut[:, :, None, :] - books[None]
    return (residual**2).sum(-1), np.einsum("npkd,npd->npk", residual, dirs)


def code(x: np.ndarray, books: np.ndarray, parallel: float = PARALLEL, sweeps: int = 2) -> np.ndarray:
    """The centre of each part of each vector: coordinate descent on |r|^2 + (parallel - 1) (r . direction)^2."""
    squares, along = cost_matrices(x, books, parallel)
    out = squares.argmin(2)
    rows, parts = np.arange(len(x)), books.shape[0]
    total = np.take_along_axis(along, out[:, :, None], 2)[:, :, 0].sum(1)
    for _ in range(sweeps):
        for p in range(parts):
            rest = total - along[rows, p, out[:, p]]
            best = (squares[:, p] + (parallel - 1) * (rest[:, None] + along[:, p]) ** 2).argmin(1)
            out[:, p] = best
            total = rest + along[rows, p, best]
    return out.astype(np.uint8)


def fit(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Codebooks (parts, CENTRES, SUBSPACE): alternates coding and, for each part, weighted least squares given the other parts."""
    rng = np.random.default_rng(seed)
    parts = x.shape[1] // SUBSPACE
    books = np.stack([x.reshape(len(x), parts, SUBSPACE)[rng.choice(len(x), CENTRES, len(x) < CENTRES), p] for p in range(parts)])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    cut, dirs = x.reshape(len(x), parts, SUBSPACE), unit.reshape(len(x), parts, SUBSPACE)
    for _ in range(ROUNDS):
        codes = code(x, books, sweeps=1)
        for p in range(parts):
            made = np.stack([books[q][codes[:, q]] for q in range(parts)], 1)
            along_rest = ((cut - made) * dirs).sum((1, 2)) - ((cut[:, p] - made[:, p]) * dirs[:, p]).sum(1)
            for k in range(CENTRES):
                m = codes[:, p] == k
                if not m.any():
                    continue
                u, v = dirs[m, p], cut[m, p]
                left = m.sum() * np.eye(SUBSPACE) + (PARALLEL - 1) * u.T @ u
                right = v.sum(0) + (PARALLEL - 1) * (u * ((u * v).sum(1) + along_rest[m])[:, None]).sum(0)
                books[p, k] = np.linalg.solve(left, right)
    return books


def tables(queries: np.ndarray, books: np.ndarray):
    """(query, part, centre): products as integers of a query's own scale, and each query's least product and unit."""
    products = np.einsum("qpd,pkd->qpk", queries.reshape(len(queries), books.shape[0], SUBSPACE), books)
    low = products.min((1, 2), keepdims=True)
    scale = np.maximum(products.max((1, 2), keepdims=True) - low, 1e-30)
    return np.round((products - low) / scale * 255).astype(np.uint8), low[:, 0, 0], scale[:, 0, 0] / 255


def paired(lut: np.ndarray) -> np.ndarray:
    """One query's table (part, centre) as a table of two parts each: (pair, 256), for bytes of two codes, the first part's low."""
    lut = np.pad(lut, ((0, len(lut) % 2), (0, 0))).astype(np.uint16)
    return (lut[1::2, :, None] + lut[::2, None, :]).reshape(len(lut) // 2, -1)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes to a byte."""
    codes = np.pad(codes, ((0, 0), (0, codes.shape[1] % 2)))
    return codes[:, ::2] | codes[:, 1::2] << 4


def scan(lut: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate scores of rows of codes by one query's table (column, code)."""
    wide = np.uint16 if lut.max(1, initial=0).sum(dtype=np.int64) <= np.iinfo(np.uint16).max else np.uint32  # a sum must not wrap
    flat = lut.astype(wide)
    out = np.zeros(len(codes), wide)
    for p in range(codes.shape[1]):
        out += flat[p].take(codes[:, p])
    return out


class Best:
    """The best top rows of each query of a block so far: (score, id), higher scores first, ties to the smaller id."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, books: np.ndarray, top: int, rerank: int):
        self.query_ids, self.queries, self.books, self.top, self.rerank = query_ids, queries, books, top, max(rerank, top)
        self.found = [(np.zeros(0), np.zeros(0, np.int64)) for _ in query_ids]

    def meet(self, ids: np.ndarray, codes: np.ndarray, left: np.ndarray, vectors: np.ndarray) -> None:
        """left: the most that a unit vector's product with a row's residual can be."""
        codes, parts = np.asfortranarray(codes), self.books.shape[0]
        longest = float(np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=float).max()))
        for at in range(0, len(self.queries), QUERY_BLOCK):  # so that no more than these tables are held at once
            asked = self.queries[at : at + QUERY_BLOCK]
            luts, lows, units = tables(asked, self.books)
            for i, (q, lut, low, unit) in enumerate(zip(asked, luts, lows.tolist(), units.tolist(), strict=True), at):
                self.found[i] = self.better(i, q, scan(paired(lut), codes), parts * (low + unit / 2), unit, ids, left, vectors, longest)

    def better(self, i: int, q: np.ndarray, sums: np.ndarray, low: float, unit: float, ids: np.ndarray, left: np.ndarray, vectors: np.ndarray, longest: float):
        had, had_ids = self.found[i]
        other = ids != self.query_ids[i]
        exact = lambda rows: np.einsum("ij,j->i", vectors[rows].astype(float), q)
        floor = float(had[-1]) if len(had) == self.top else -np.inf
        if floor == -np.inf:
            first = np.flatnonzero(other)
            if len(first) > self.rerank:
                first = first[np.argpartition(sums[first], len(first) - self.rerank)[-self.rerank :]]
            if len(first) >= self.top:
                floor = float(np.partition(exact(first), len(first) - self.top)[len(first) - self.top])
        length = float(np.linalg.norm(q))
        can = np.flatnonzero((low + sums * unit + left * length >= floor) & other)
        if len(can) * 16 > len(ids) and longest * length < 1e30:  # a rough product of them all is cheaper than exact ones of so many
            rough = vectors @ q.astype(vectors.dtype)
            can = can[rough[can] >= floor - 1e-5 * longest * length - 1e-30]
        scores = exact(can)
        can, scores = can[scores >= floor], scores[scores >= floor]
        scores, ids = np.concatenate([had, scores]), np.concatenate([had_ids, ids[can]])
        order = np.lexsort((ids, -scores))[: self.top]
        return scores[order], ids[order]

    def rows(self) -> pa.RecordBatch:
        asked = np.repeat(self.query_ids, [len(f[0]) for f in self.found])
        scores, ids = (np.concatenate([f[c] for f in self.found]) for c in range(2))
        return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(ids.astype(np.int64)), pa.array(scores)], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v) of vectors that take part; v keeps its kind of number where that is float or double."""
    v = F.col(vector_col) if dict(vectors.dtypes)[vector_col] == "array<float>" else F.col(vector_col).cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.coalesce(fine, F.lit(False)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors of an Arrow column as rows of doubles, with zeros up to whole parts."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), dims)
    return np.pad(x, ((0, 0), (0, -dims % SUBSPACE)))


def search(vectors: DataFrame, every: int = 20, top: int = TOP, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows whose id is divisible by every, against all others."""
    spark = vectors.sparkSession
    given = usable(vectors, id_col, vector_col)
    schema = "query_id long, rank int, vec_id long, score double"
    sizes = given.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    dims, n = sizes[0]["d"], sizes[0]["count"]
    given = given.filter(F.size("v") == dims)
    drawn = given.filter(F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < min(1.0, 1.5 * SAMPLE / n) * (1 << 30))
    sample = [r["v"] for r in drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()] or [r["v"] for r in given.limit(SAMPLE).collect()]
    books = spark.sparkContext.broadcast(fit(matrix(pa.array(sample, pa.list_(pa.float64())), dims)))
    kind = dict(given.dtypes)["v"]
    number = np.float32 if kind == "array<float>" else np.float64

    def add_codes(batches):
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column("v"), dims)
                codes = code(x, books.value)
                made = books.value[np.arange(books.value.shape[0]), codes].reshape(len(x), -1)
                # a little more than the residual's length: sums and lengths are rounded
                left = np.linalg.norm(x - made, axis=1) * (1 + 1e-9) + 1e-9 * (np.linalg.norm(x, axis=1) + np.linalg.norm(made, axis=1))
                batch = batch.append_column("code", pa.array([c.tobytes() for c in packed(codes)], pa.binary()))
                yield batch.append_column("left", pa.array(left))

    # written once: whatever reads it later meets the same rows, also after an executor is lost
    index = settle(in_python(given, add_codes, f"vec_id long, v {kind}, code binary, left double"))
    asked = settle(index.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q")))
    n_asked = asked.count()
    most = min(QUERY_MOST, max(QUERY_BLOCK, n_asked // 8))
    many, strands = max(1, -(-n_asked // most)), max(1, -(-n // STRAND))
    # a meeting of a strand of vectors and a block of queries: the queries' rows first, then blocks of vectors as they are read

    def pack_vectors(batches):
        held, size = [], 0

        def flush():
            ids, code, left, v = (np.concatenate(c).tobytes() for c in zip(*held, strict=True))
            return pa.RecordBatch.from_pydict({n: pa.array([x], pa.binary()) for n, x in (("ids", ids), ("flat", v), ("code", code), ("left", left))})

        for batch in batches:
            if batch.num_rows:
                code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8)
                held.append((batch.column("vec_id").to_numpy(), code, batch.column("left").to_numpy(), matrix(batch.column("v"), dims).astype(number).ravel()))
                size += batch.num_rows
            if size >= ROW_BLOCK:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    def pack_queries(group: pa.Table) -> pa.Table:
        group = group.sort_by("query_id")
        flat = matrix(group.column("q").combine_chunks(), dims)
        return pa.table({"block": pa.array([group.column("block")[0].as_py()], pa.int32()), "ids": pa.array([group.column("query_id").to_numpy().tobytes()], pa.binary()), "flat": pa.array([flat.tobytes()], pa.binary())})

    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    blocks = in_python(index.select("vec_id", "v", "code", "left"), pack_vectors, "ids binary, flat binary, code binary, left binary")
    blocks = blocks.select(each(many).alias("block"), F.pmod(F.xxhash64("ids"), F.lit(strands)).cast("int").alias("strand"), F.lit(True).alias("vectors"), "ids", "flat", "code", "left")
    queries = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(many)).cast("int")).groupBy("block").applyInArrow(pack_queries, "block int, ids binary, flat binary")
    queries = queries.select("block", each(strands).alias("strand"), F.lit(False).alias("vectors"), "ids", "flat", F.lit(b"").alias("code"), F.lit(b"").alias("left"))
    met = queries.unionByName(blocks).repartition(min(many * strands, 1 << 16), "block", "strand").sortWithinPartitions("block", "strand", "vectors")

    def meet(batches):
        now, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                block, strand, vectors, ids, flat, code, left = (batch.column(c)[row].as_py() for c in range(7))
                if (block, strand) != now:
                    if best is not None:
                        yield best.rows()
                    now, best = (block, strand), None
                ids = np.frombuffer(ids, np.int64)
                if not vectors:
                    best = Best(ids, np.frombuffer(flat, float).reshape(len(ids), -1), books.value, top, rerank)
                elif best is not None:  # a block without queries asks nothing
                    best.meet(ids, np.frombuffer(code, np.uint8).reshape(len(ids), -1), np.frombuffer(left, float), np.frombuffer(flat, number).reshape(len(ids), -1))
        if best is not None:
            yield best.rows()

    found = in_python(met.select("block", "strand", "vectors", "ids", "flat", "code", "left"), meet, "query_id long, vec_id long, score double")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int"))
    return ranked.filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
