"""Toxicity by weak supervision.

Voters read a text and say toxic, clean or nothing: fixed lexicons, lexicons and word beginnings (patterns) that go with
label 1 in some of the training rows, and patterns of the whole text. Labels are asked in this search for voters alone, on one
half of the sample's different texts (texts that share the least hash of their five-word stretches count once, so near copies
do not speak twice). On the other half, whose labels nobody reads, a generative label model with a hidden true label
estimates each voter's accuracy by expectation maximisation, started from the accuracies on the first half, and the voters'
correlations given the label; a voter's evidence is divided by what it shares with others. Then the halves change places. The
posterior labels of all train a linear classifier (logistic regression) on the presence of words and word beginnings, which scores all texts.

Fitted to at most SAMPLE labelled rows, none longer than TRAIN_CHARS (documented bounds); every text is scored whole.
Defined results: a null or empty text has no features and gets the classifier's intercept; without training rows all
scores are 0; a document that has several labels is learned with its largest; a label without id or without a document teaches
nothing; equal scores stay equal, whatever the id; an empty table gives no rows; rows are kept one to one.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import in_python, table
from lodestone.llm.neardup import weighted

SAMPLE, TRAIN_CHARS = 6000, 20_000
FEATURES, CACHE = 4000, 400_000
LEAST_G, LEAST_ODDS = 20.0, 4.0
#: Rows that a voter's accuracy where it was found counts for in expectation maximisation.
ADVANCE = 3000.0
#: Different texts that must hold a feature.
LEAST_TEXTS = 4
#: Fixed lexicons: insults that are toxic in most contexts.
LEXICONS = (
    ("idiot", "idiots", "moron", "morons", "imbecile", "dumb", "dumbass"),
    ("stupid", "pathetic", "worthless", "useless", "disgusting", "vile"),
    ("scum", "trash", "garbage", "filth", "vermin", "loser", "losers", "clown", "clowns", "pig", "rat"),
    ("hate", "kill", "die", "hurt", "destroy"),
)
BEGINNINGS = (4, 5, 6, 7)
EDGES = ".,;:!?\"'()[]{}<>*_-%$&#|+=~^/\\"
SHOUT = re.compile(r"!!+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def features_of(word: str) -> list[str]:
    w = word.strip(EDGES)
    return [w, *[w[:n] + "~" for n in BEGINNINGS if len(w) > n]] if len(w) > 2 else []


def words_of(text: str) -> set[str]:
    return set(text.lower().split())


def associated(texts: list[set[str]], q: np.ndarray) -> list[str]:
    """Features that go with label 1 beyond chance (likelihood ratio statistic over LEAST_G, odds over LEAST_ODDS), the strongest first."""
    on, off = Counter(), Counter()
    for words, p in zip(texts, q, strict=True):
        (on if p >= 0.5 else off).update({f for w in words for f in features_of(w)})
    n1, n0 = max(1, int((q >= 0.5).sum())), max(1, int((q < 0.5).sum()))
    rated = []
    for f, k in on.items():
        c = off[f]
        if k < LEAST_TEXTS or (k + 0.5) * n0 < LEAST_ODDS * (c + 0.5) * n1:
            continue
        e1 = (k + c) * n1 / (n1 + n0)
        g = 2 * (k * np.log(k / e1) + (c * np.log(c / (k + c - e1)) if c else 0))
        if g > LEAST_G:
            rated.append((-float(g), f))
    return [f for _, f in sorted(rated)]


def votes(texts: list[set[str]], raw: list[str], voters: list[tuple[str, frozenset]]) -> np.ndarray:
    """1 toxic, -1 clean, 0 nothing said; the last voters are patterns of the whole text."""
    has = [{f for w in words for f in features_of(w)} for words in texts]
    named = [[1 if not known.isdisjoint(h) else 0 for h in has] for _, known in voters]
    anything = frozenset().union(*[known for _, known in voters])
    none = [-1 if anything.isdisjoint(h) else 0 for h in has]
    few = [-1 if len(anything & h) <= 1 else 1 if len(anything & h) >= 3 else 0 for h in has]
    shout = [1 if len(SHOUT.findall(t)) > 3 and len(anything & h) else 0 for t, h in zip(raw, has, strict=True)]
    return np.array([*named, none, few, shout], float).T


def accuracies(v: np.ndarray, q: np.ndarray, before: np.ndarray | float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of voters, given each row's probability of label 1: how often each says what for either label, the labels' shares, and
    what share of a voter's evidence is its own. before: what is counted in advance."""
    says = np.stack([v == -1, v == 0, v == 1], 2).astype(float)
    w = np.stack([1 - q, q])
    p = np.einsum("yn,nvs->yvs", w, says) + before
    p /= p.sum(2, keepdims=True)
    prior = (w.sum(1) + 1) / (len(q) + 2)
    # correlations given the label, of what voters say beyond its mean
    common = np.zeros((v.shape[1], v.shape[1]))
    for y in range(2):
        mean = (w[y][:, None] * v).sum(0) / max(w[y].sum(), 1e-9)
        c = (w[y][:, None] * (v - mean)).T @ (v - mean)
        d = np.sqrt(np.maximum(np.diag(c), 1e-9))
        common += prior[y] * np.abs(c / d[:, None] / d[None])
    np.fill_diagonal(common, 1)
    return p, prior, 1 / np.where(common > 0.3, common, 0).sum(1).clip(1)


def posterior(v: np.ndarray, p: np.ndarray, prior: np.ndarray, share: np.ndarray) -> np.ndarray:
    says = np.stack([v == -1, v == 0, v == 1], 2).astype(float)
    evidence = np.einsum("nvs,vs,v->n", says, np.log(p[1]) - np.log(p[0]), share) + np.log(prior[1] / prior[0])
    return 1 / (1 + np.exp(-np.clip(evidence, -30, 30)))


def label_model(v: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = 25) -> np.ndarray:
    """Posterior of label 1 for each row of votes, by expectation maximisation. found: the voters' accuracies where they were
    found; they are the start, and a Dirichlet prior of ADVANCE rows for each label, so that the label stays the one meant."""
    q = posterior(v, *found)
    for _ in range(rounds):
        q = posterior(v, *accuracies(v, np.clip(q, 0.05, 0.95), ADVANCE * found[0]))
    return q


def train_linear(x: list[np.ndarray], n: int, q: np.ndarray, rounds: int = 300, rate: float = 0.05, l2: float = 1e-4) -> tuple[float, np.ndarray]:
    """Logistic regression on sets of features against posterior labels; either label weighs the same."""
    rows = np.repeat(np.arange(len(x)), [len(r) for r in x])
    cols = np.concatenate(x) if len(rows) else np.zeros(0, int)
    weight = q / max(q.sum(), 1e-9) + (1 - q) / max((1 - q).sum(), 1e-9)
    w, b = np.zeros(n), 0.0
    m, s = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, rounds + 1):
        z = np.bincount(rows, w[cols], len(x)) + b
        g = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - q)
        grad = np.append(np.bincount(cols, g[rows], n) + l2 * w, g.sum())
        m += 0.1 * (grad - m)
        s += 0.01 * (grad * grad - s)
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return b, w


def different(rows: list[tuple[str, int]]) -> list[tuple[str, int]]:
    """One row of those that share the least hash of their five-word stretches, with the largest label among them."""
    least: dict[int, int] = {}
    for lo in range(0, len(rows), 50):  # some texts at a time: their hashes take many times their size
        doc, h, _ = weighted([t for t, _ in rows[lo : lo + 50]])
        some, first = np.unique(doc, return_index=True)  # a text's hashes are sorted
        least |= dict(zip((some + lo).tolist(), h[first].tolist(), strict=True))
    out: dict[int | None, tuple[str, int]] = {}
    for d, (text, y) in enumerate(rows):
        key = least.get(d)
        first, most = out.get(key, (text, 0))
        out[key] = (first, max(most, int(bool(y))))
    return list(out.values())


def voters_of(texts: list[set[str]], labels: np.ndarray) -> list[tuple[str, frozenset]]:
    """The fixed lexicons, and those mined from labelled texts."""
    mined = associated(texts, labels)
    words, begins = [f for f in mined if not f.endswith("~")], [f for f in mined if f.endswith("~")][:60]
    out = [(f"lexicon {i}", frozenset(x)) for i, x in enumerate(LEXICONS)]
    out += [(f"mined {i}", frozenset(words[i::20])) for i in range(20) if words[i::20]]
    return out + [(f"begins {f}", frozenset([f])) for f in begins]


def fit(rows: list[tuple[str, int]]) -> dict | None:
    if not rows:
        return None
    rows = different(rows)
    texts, labels = [words_of(t) for t, _ in rows], np.array([y for _, y in rows], float)
    half, q = np.arange(len(rows)) % 2, labels.copy()
    for rest in (0, 1) if len(rows) > 1 else ():
        mine, others = half != rest, half == rest
        voters = voters_of([t for t, m in zip(texts, mine, strict=True) if m], labels[mine])
        v = votes(texts, [t for t, _ in rows], voters)
        q[others] = label_model(v[others], accuracies(v[mine], labels[mine]))
    # the classifier sees the words that tell posterior labels apart
    chosen = associated(texts, q)[:FEATURES]
    index = {f: i for i, f in enumerate(chosen)}
    b, w = train_linear([np.array(sorted({index[f] for x in t for f in features_of(x) if f in index}), int) for t in texts], len(chosen), q)
    return {"index": index, "w": w, "b": b}


class Scorer:
    def __init__(self, model: dict):
        self.index, self.w, self.b = model["index"], model["w"].tolist(), model["b"]
        self.kept: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        found: set[int] = set()
        words = words_of(text) if text else set()
        if len(self.kept) + len(words) > CACHE:
            self.kept = {}
        kept, index = self.kept, self.index
        for word in words:
            ids = kept.get(word)
            if ids is None:
                kept[word] = ids = tuple(index[f] for f in features_of(word) if f in index)
            if ids:
                found.update(ids)
        z = self.b + sum([self.w[i] for i in sorted(found)])
        return float(1 / (1 + np.exp(-max(-30.0, min(30.0, z)))))


def sample(docs: DataFrame, labels: DataFrame) -> list[tuple[str, int]]:
    """At most SAMPLE labelled training rows, half of each label where there are enough, by the order of a hash."""
    given = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {int(bool(r["toxic"])): r["count"] for r in given.groupBy("toxic").count().collect()}
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    rows = []
    for y, n in counts.items():
        ids = given.filter((F.col("toxic") != 0) == bool(y)).filter(h < min(1.0, 1.5 * SAMPLE / 2 / n) * (1 << 30))
        ids = ids.orderBy(h, "doc_id").limit(SAMPLE // 2).select("doc_id")  # a bounded table, small enough to send to all tasks
        texts = docs.filter(F.length("text") <= TRAIN_CHARS).join(F.broadcast(ids), "doc_id")
        rows += [(r["text"], y) for r in texts.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(SAMPLE // 2).collect()]
    return rows


def predict(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic"))))

    def run(batches):
        scorer = model.value and Scorer(model.value)
        for batch in batches:
            scores = [scorer.score(t) if scorer else 0.0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return in_python(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "toxic"))
