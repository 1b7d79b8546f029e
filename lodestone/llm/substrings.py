"""Exact substring deduplication: words in any window of SIZE words that starts more than once are removed.

Every window of every text gets its Rabin-Karp hash. Windows are dealt to buckets by a second, independent hash, and a
bucket's hashes are counted together; hash and bucket make over 64 bits of identity, more as buckets are added. The tasks
that read texts work through chunks of CHUNK windows: a window that repeats within a chunk is known to be repeated there,
and its hash goes on once; so a passage that a third of all documents share sends one hash a chunk, not one a document.
What returns is one bit per window of a document and bucket, and only where a bit is set. The text meets its bits in one
join, and its repeated windows merge into maximal removal intervals.

The number of buckets follows from the number of characters, so that a bucket holds BUCKET windows or so at any size.
The input must give the same rows if a task is run again (a table does).

Defined results: an empty table gives no rows; null and empty texts have no words and keep nothing; texts of any length are
read whole; a text shorter than a window loses nothing; repeated
rows (same id and text) are each other's copies, lose the same words, and each stays a row; columns other than id and text
are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import bounded_batches, free_shuffles, in_python, settle, table
from lodestone.llm.rolling import SECOND_BASE, WORD_BASE, mix, stretches, windows, words

SIZE = 35
CHUNK, BUCKET, LEAST_BUCKETS = 1_000_000, 2_000_000, 16
#: The bucket numbers of rows that tell bits of all windows, or that all windows repeat.
OWN, ALL = -1, -2


def window_hashes(texts: list[bytes], size: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bucket of each window, text by text, and where each text's windows begin."""
    tokens, bounds = words(texts)
    starts, at = windows(tokens, bounds, size)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int32), at
    first = mix(stretches(tokens, starts, starts + size, WORD_BASE))
    second = mix(stretches(mix(tokens, 1), starts, starts + size, SECOND_BASE), 2)
    return first, (second % np.uint64(buckets)).astype(np.int32), at


def local(order: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """In the given order: which rows begin a run of equal rows, and which are in a run of several."""
    n = len(order)
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([c[order][1:] != c[order][:-1] for c in columns])
    run = np.cumsum(new) - 1
    return new, np.bincount(run, minlength=1)[run] > 1 if n else np.zeros(0, bool)


def sent(keys: list[int], texts: list[bytes], size: int, buckets: int, chunk: int):
    """Rows (bucket, chunk, keys, counts, hashes, known) of a chunk of texts: for a bucket, the hashes of windows that are
    single in the chunk, by text, and the hashes that are not; for OWN and ALL, keys and bits of what the chunk itself tells."""
    once: dict[int, int] = {}
    copied: set[int] = set()
    for i, k in enumerate(keys):
        if once.setdefault(k, i) != i:
            copied.add(k)
    keys, texts = list(once), [texts[i] for i in once.values()]
    hashes, bucket, at = window_hashes(texts, size, buckets)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((hashes, bucket))
    new, several = local(order, hashes, bucket)
    again = np.zeros(len(order), bool)
    again[order] = several
    again |= np.array([k in copied for k in keys], bool)[doc] if copied else False
    # hashes that are known to repeat, once each
    send_known = np.zeros(len(order), bool)
    send_known[order] = new
    send_known &= again
    n_again = np.add.reduceat(np.append(again, False), at[:-1]) * (np.diff(at) > 0) if len(texts) else np.zeros(0, int)
    own_keys, own_bits, own_counts, all_keys = [], [], [], []
    for i in np.flatnonzero(n_again).tolist():
        if n_again[i] == at[i + 1] - at[i]:
            all_keys.append(keys[i])
        else:
            own_keys.append(keys[i])
            bits = np.packbits(again[at[i] : at[i + 1]])
            own_bits.append(bits)
            own_counts.append(len(bits))
    pack = lambda x, kind: np.asarray(x, kind).tobytes()
    if own_keys:
        yield -1 - chunk % buckets, chunk, pack(own_keys, np.int64), pack(own_counts, np.uint32), np.concatenate(own_bits).tobytes(), b""
    if all_keys:
        yield -1 - chunk % buckets, chunk, pack(all_keys, np.int64), b"", b"", b""
    # the singles by bucket, text and place
    single = np.flatnonzero(~again)
    single = single[np.argsort(bucket[single], kind="stable")]
    told = np.flatnonzero(send_known)
    told = told[np.argsort(bucket[told], kind="stable")]
    edges, told_edges = np.searchsorted(bucket[single], np.arange(buckets + 1)), np.searchsorted(bucket[told], np.arange(buckets + 1))
    key_of = np.array(keys, np.int64)
    for b in np.union1d(bucket[single], bucket[told]).tolist():
        rows = single[edges[b] : edges[b + 1]]
        owner = doc[rows]
        first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(rows) else np.zeros(0, int)
        counts = np.diff(np.append(first, len(rows)))
        yield b, chunk, key_of[owner[first]].tobytes(), pack(counts, np.uint32), hashes[rows].tobytes(), hashes[told[told_edges[b] : told_edges[b + 1]]].tobytes()


def judged(bucket: int, rows: list[tuple[int, bytes, bytes, bytes, bytes]]):
    """Rows (chunk, bucket, keys, sizes, bits) of one bucket's rows (chunk, keys, counts, hashes, known): the texts of a chunk
    that have repeated windows in the bucket, and their bits one after the other."""
    if bucket < 0:
        for chunk, keys, counts, bits, _ in rows:
            yield chunk, OWN if counts else ALL, keys, counts, bits
        return
    hashes = np.frombuffer(b"".join([r[3] for r in rows]), np.uint64)
    known = np.unique(np.frombuffer(b"".join([r[4] for r in rows]), np.uint64))
    order = np.argsort(hashes, kind="stable")
    _, several = local(order, hashes)
    again = np.zeros(len(hashes), bool)
    again[order] = several
    if len(known):
        again |= known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
    at = 0
    for chunk, keys, counts, _, _ in rows:
        sizes = np.frombuffer(counts, np.uint32).astype(np.int64)
        if not len(sizes):
            continue
        ends = at + np.cumsum(sizes)
        sums = np.concatenate([[0], np.cumsum(again[at : ends[-1]])])
        hit = np.flatnonzero(sums[ends - at] > sums[ends - sizes - at])
        bits = [np.packbits(again[ends[i] - sizes[i] : ends[i]]) for i in hit]
        if bits:
            yield chunk, bucket, np.frombuffer(keys, np.int64)[hit].tobytes(), np.array([len(x) for x in bits], np.uint32).tobytes(), np.concatenate(bits).tobytes()
        at = int(ends[-1])


def gathered(rows) -> list[tuple[int, int, list]]:
    """(key, chunk, told) of the texts of a chunk from its rows (chunk, bucket, keys, sizes, bits); told: (bucket, bits)."""
    out, full = {}, []
    for chunk, bucket, keys, sizes, bits in rows:
        ks, at = np.frombuffer(keys, np.int64).tolist(), 0
        if bucket == ALL:
            full += [(k, ALL, []) for k in ks]
            continue
        for k, n in zip(ks, np.frombuffer(sizes, np.uint32).tolist(), strict=True):
            out.setdefault((k, chunk), []).append({"bucket": bucket, "bits": bits[at : at + n]})
            at += n
    return full + [(k, chunk, told) for (k, chunk), told in out.items()]


def repeated(text: bytes, size: int, buckets: int, told: list[tuple[int, list[tuple[int, bytes]]]]) -> np.ndarray:
    """Which windows of a text repeat; told: of each chunk that the text was in, (chunk, [(bucket, bits)])."""
    n = max(0, len(text.split()) - size + 1)
    out = np.zeros(n, bool)
    if not told or not n:
        return out
    if any(chunk == ALL for chunk, _ in told):
        return ~out
    _, bucket, _ = window_hashes([text], size, buckets)
    unpack = lambda bits, m: np.unpackbits(np.frombuffer(bits, np.uint8), count=m).astype(bool)
    for _, mine in told:
        own = next((unpack(bits, n) for b, bits in mine if b == OWN), np.zeros(n, bool))
        out |= own
        for b, bits in mine:
            if b >= 0:
                at = np.flatnonzero((bucket == b) & ~own)
                out[at[unpack(bits, len(at))]] = True
    return out


def intervals(again: np.ndarray, size: int) -> list[tuple[int, int]]:
    """Maximal stretches of words (start, end) that repeated windows cover."""
    at = np.flatnonzero(again)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > size) + 1
    return [(int(a[0]), int(a[-1]) + size) for a in np.split(at, cut)]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, keep: bool = True, chunk: int = CHUNK) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256; with keep also kept (text) and removed (array of word positions start, end)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("long"), text).alias("key"))
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(LEAST_BUCKETS, total // 6 // BUCKET)

    def read(batches):
        task, n = TaskContext.get().partitionId(), 0
        keys: list[int] = []
        texts: list[bytes] = []
        held = 0

        def flush():
            got = list(sent(keys, texts, size, buckets, task << 24 | n))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), KINDS, strict=True)], NAMES) if got else None

        for batch in batches:
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys.append(k)
                texts.append(t.encode())
                held += len(t)
                if held >= 6 * chunk:
                    if (out := flush()) is not None:
                        yield out
                    keys, texts, held, n = [], [], 0, n + 1
        if keys and (out := flush()) is not None:
            yield out

    NAMES = ["bucket", "chunk", "keys", "counts", "hashes", "known"]
    KINDS = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    JUDGED = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("bits", pa.binary())])
    TOLD = pa.schema([("key", pa.int64()), ("chunk", pa.int64()), ("told", pa.list_(pa.struct([("bucket", pa.int64()), ("bits", pa.binary())])))])
    as_table = lambda got, schema: pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*got, strict=True), schema, strict=True)], schema=schema) if got else schema.empty_table()

    def count(given: pa.Table) -> pa.Table:
        of = [list(row) for row in zip(*[given.column(c).to_pylist() for c in NAMES[1:]], strict=True)]
        return as_table(list(judged(given.column("bucket")[0].as_py(), of)), JUDGED)

    def gather(given: pa.Table) -> pa.Table:
        return as_table(gathered(zip(*[given.column(c).to_pylist() for c in JUDGED.names], strict=True)), TOLD)

    flags = rows.select("key", "text").mapInArrow(read, "bucket long, chunk long, keys binary, counts binary, hashes binary, known binary")
    flags = flags.groupBy("bucket").applyInArrow(count, "chunk long, bucket long, keys binary, sizes binary, bits binary")
    flags = settle(flags.groupBy("chunk").applyInArrow(gather, "key long, chunk long, told array<struct<bucket:long,bits:binary>>"))
    free_shuffles(spark)
    told = flags.groupBy("key").agg(F.collect_set(F.struct("chunk", "told")).alias("told"))
    tail = ", kept string, removed array<struct<start:long,end:long>>" if keep else ""

    def cut(batches):
        for batch in batches:
            out = []
            for i, t, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = t.encode()
                w = raw.split()
                gone = intervals(repeated(raw, size, buckets, [(y["chunk"], [(z["bucket"], z["bits"]) for z in y["told"]]) for y in x or ()]), size)
                left, end = [], 0
                for s, e in gone:
                    left += w[end:s]
                    end = e
                left += w[end:]
                kept = b" ".join(left)
                out.append([i, len(w), len(w) - len(left), hashlib.sha256(kept).hexdigest(), *([kept.decode(), [{"start": s, "end": e} for s, e in gone]] if keep else [])])
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "removed"]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)], names[: len(out[0])])

    met = rows.join(told, "key", "left").select("doc_id", "text", "told")
    return in_python(met, cut, "doc_id long, n_words long, n_removed long, kept_sha256 string" + tail)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"), keep=False)
