"""Byte-level BPE encoding and decoding with a pair occurrence index.

The words of a batch that have not been met lie one after the other in one linked list of symbols. An index maps each
adjacent pair that has a merge rank to all its positions; the active ranks are taken in ascending order, all positions of
a rank are merged from left to right, and only the lists of the pairs beside a merge are updated. Ascending order over all
words gives each word what its own ascending order gives, for words do not touch.

Defined results: a null text counts as empty; an empty text has no ids and decodes to the empty text; texts of any length
are encoded whole; of equal pairs the leftmost is merged first; an empty table gives no rows; rows are kept one to one,
repeated ids too; other columns are not read. Words are kept between the batches of a task, at most CACHE of them.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
from array import array
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import in_python, table

VOCABULARY = "byte_bpe_50k.json"
#: The words of the byte-level pre-tokenizer. White space is Unicode's.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Every character that some definition takes for white space.
SPACES = [chr(c) for c in range(0x3001) if chr(c).isspace()]
#: Words, and pieces of text between blanks, whose ids are kept between batches, at most.
CACHE = 450_000


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


class PairIndexBPE:
    """Encodes and decodes as the vocabulary file says, without padding, truncation or added special tokens."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        of_id = {i: bytes(alphabet[c] for c in token) for token, i in vocab.items()}
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        of_id |= {i: token.encode() for token, i in self.specials.items()}
        #: bytes of the tokens, one after the other, and where each token's begin
        self.lengths = np.array([len(of_id.get(i, b"")) for i in range(max(of_id) + 1)], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(of_id.get(i, b"") for i in range(len(self.lengths))), np.uint8)
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = vocab[c]
        #: what each rank makes of its pair, and the pairs as sorted numbers with their ranks
        merges = [tuple(p.split(" ") if isinstance(p, str) else p) for p in spec["model"]["merges"]]
        self.merges = [(vocab[x], vocab[y], vocab[x + y]) for x, y in merges]
        pairs = np.array([a << 20 | b for a, b, _ in self.merges], np.int64)
        self.ranks = np.argsort(pairs, kind="stable")
        self.pairs = pairs[self.ranks]
        self.split = regex.compile(SPLIT)
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.kept: dict[str, tuple[bytes, bytes]] = {}
        self.words: dict[str, tuple[bytes, bytes]] = {}

    def by_rank(self, pairs: np.ndarray, at: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """The positions of each rank that the pairs at these positions have."""
        where = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        known = self.pairs[where] == pairs
        ranks, at = self.ranks[where[known]], at[known]
        if not len(at):
            return []
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order]
        cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(at)]
        return [(int(ranks[x]), at[x:y]) for x, y in pairwise(cuts)]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each word has; one pair index serves all words."""
        sizes = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(sizes)
        sym = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        n = len(sym)
        if not n:
            return sym, sizes
        nxt = np.arange(1, n + 1)
        nxt[ends[sizes > 0] - 1] = -1
        prv = np.arange(-1, n - 1)
        prv[(ends - sizes)[sizes > 0]] = -1
        index: dict[int, list[np.ndarray]] = {}  # positions of the pair that has a rank
        active: list[int] = []

        def add(pairs, at):
            for rank, found in self.by_rank(pairs, at):
                if rank in index:
                    index[rank].append(found)
                else:
                    index[rank] = [found]
                    heapq.heappush(active, rank)

        at = np.flatnonzero(nxt >= 0)
        add(sym[at] << 20 | sym[nxt[at]], at)
        while active:
            rank = heapq.heappop(active)
            a, b, made = self.merges[rank]
            at = index.pop(rank)
            at = np.unique(np.concatenate(at)) if len(at) > 1 else at[0]
            j = nxt[at]
            live = (sym[at] == a) & (j >= 0) & (sym[j] == b)  # the rest has gone into other merges
            at, j = at[live], j[live]
            if a == b and len(at) > 1:  # of overlapping occurrences every second one, from the left
                first = np.concatenate([[True], j[:-1] != at[1:]])
                run = np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
                even = (np.arange(len(at)) - run) % 2 == 0
                at, j = at[even], j[even]
            if not len(at):
                continue
            k = nxt[j]
            sym[at], sym[j], nxt[at] = made, -1, k
            right = k >= 0
            prv[k[right]] = at[right]
            p = prv[at]
            left = p >= 0
            add(np.concatenate([made << 20 | sym[k[right]], sym[p[left]] << 20 | made]), np.concatenate([at[right], p[left]]))
        live = sym >= 0
        counts = np.concatenate([[0], np.cumsum(live)])
        return sym[live], counts[ends] - counts[ends - sizes]

    def bytes_of(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bytes that ids decode to, and how many each has."""
        sizes = self.lengths[ids]
        total = int(sizes.sum())
        at = np.repeat(self.offsets[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)
        return self.flat[at].tobytes(), sizes

    def learn(self, words: list[str]) -> None:
        """Puts into words what each word gives: its ids, packed, and the bytes that these ids decode to."""
        ids, counts = self.encode_words([w.encode() for w in words])
        decoded, sizes = self.bytes_of(ids)
        packed, bounds = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)])
        spans = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        bounds = (4 * bounds).tolist()
        for w, x, y, s, e in zip(words, bounds, bounds[1:], spans, spans[1:], strict=False):
            self.words[w] = (packed[x:y], decoded[s:e])

    def parts(self, text: str) -> tuple[list[str], list[str]]:
        """Words of the text's beginning, and the stretches of text that each follow a blank at which a word surely begins."""
        found = [c for c in SPACES if c in text]
        if " " not in found or text[0] in SPACES or text[-1] in SPACES or any(c + d in text for c in found for d in found):
            return self.split.findall(text), []
        first, *rest = text.split(" ")
        return self.split.findall(first), rest

    def cut(self, text: str) -> list[tuple[list[str], list[str]]]:
        """The parts between special tokens; each special token is a word."""
        if not self.special or not self.special.search(text):
            return [self.parts(text)] if text else []
        out, at = [], 0
        for m in [*self.special.finditer(text), None]:
            if between := text[at : m.start() if m else None]:
                out.append(self.parts(between))
            if m:
                out.append(([m[0]], []))
                at = m.end()
        return out

    def run(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text: ids as little-endian unsigned 32-bit integers, and the UTF-8 that they decode to."""
        cuts = [self.cut(t) for t in texts]
        rests = set().union(*[rest for parts in cuts for _, rest in parts])
        if len(self.kept) + len(rests) > CACHE:
            self.kept = {}
        new = list(rests.difference(self.kept))
        split = [self.split.findall(" " + p) for p in new]
        met = set(chain.from_iterable(split)).union(*[first for parts in cuts for first, _ in parts])
        if len(self.words) + len(met) > CACHE:
            self.words = {}
        words, kept = self.words, self.kept
        for token, i in self.specials.items():
            words[token] = (array("I", [i]).tobytes(), token.encode())
        self.learn(list(met.difference(words)))
        for p, found in zip(new, split, strict=True):
            if len(found) == 1:
                kept[p] = words[found[0]]
            else:
                ids, raw = zip(*[words[w] for w in found], strict=True)
                kept[p] = (b"".join(ids), b"".join(raw))
        out = []
        for parts in cuts:
            found = [x for first, rest in parts for x in [*[words[w] for w in first], *[kept[p] for p in rest]]]
            ids, raw = zip(*found, strict=True) if found else ((), ())
            out.append((b"".join(ids), b"".join(raw).decode("utf-8", "replace").encode()))
        return out

    def forget(self) -> None:
        self.kept, self.words = {}, {}

    def decode(self, ids: list[int]) -> str:
        return self.bytes_of(np.array(ids, np.int64))[0].decode("utf-8", "replace")


_LOADED: dict[str, PairIndexBPE] = {}


def tokenizer(path: str) -> PairIndexBPE:
    """The tokenizer of a file, loaded once in a process."""
    if path not in _LOADED:
        if array("I").itemsize != 4 or sys.byteorder != "little":
            raise RuntimeError("ids are packed as little-endian 32-bit integers")
        _LOADED[path] = PairIndexBPE(path)
    return _LOADED[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: bool = True, more: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, n_tokens, ids (unsigned 32-bit, as binary), decoded (text), both digests, and the columns named in more as they are.
    keep=False leaves ids and text out."""
    path = path or default_path()
    tail = ", ids binary, decoded string" if keep else ""

    def run(batches):
        bpe = tokenizer(path)
        for batch in batches:
            found = bpe.run([t or "" for t in batch.column(1).to_pylist()])
            columns = [
                batch.column(0),
                pa.array([len(i) // 4 for i, _ in found], pa.int64()),
                pa.array([hashlib.sha256(i).hexdigest() for i, _ in found], pa.string()),
                pa.array([hashlib.sha256(t).hexdigest() for _, t in found], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep:
                columns += [pa.array([i for i, _ in found], pa.binary()), pa.array([t.decode() for _, t in found], pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns + batch.columns[2:], names + list(more))
        bpe.forget()  # the worker stays, and what runs in it next needs the memory

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *more)
    tail += "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in docs.select(*more).schema)
    return in_python(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + tail)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"), keep=False)
