"""Language identification with string kernels.

The kernel of two texts is the number of character n-grams (n = 1..3, blended) that both hold, over the geometric mean of
their own numbers. N-grams are hashed to SLOTS. Landmarks from the training rows give the Nyström features
k(x, landmarks) K^(-1/2); one-versus-rest kernel ridge regression on them gives one value per language, near 1 for its own
and near -1 for the others. Texts are scored in batches, by products of presence matrices.

Likeness says whether a text is like those that were learned from at all: the share of its letter trigrams (exact, a blank for
each run of other characters) that training rows hold, less the share that the text's own letters would reach in random order,
over the most that this can be. Neither share depends on the text's length. A trigram is known if RARE of a language's training
texts hold it, one at least; copies, alike in letters and blanks, are one text. The limit is set from held-out training rows: half
of them teach, the others are measured. As a text that taught knows itself where few rows teach a language, it must also reach
LEAST by what others teach, its copies left out; not so if it has under MANY trigrams, or in a language whose texts mostly do not
reach it, as one that has a single text.

The model is fitted to at most PER_LANGUAGE rows of each language and TOTAL of all, none longer than TRAIN_CHARS, of at most
LANGUAGES languages (documented bounds of the sample); every text is scored whole, in stretches. Defined results: a text that
is null or has no letter is `und` with score 0, as are all texts where there is nothing to learn from; ties go to the language
that sorts first; a row without id is one to learn from; repeated rows get the same result each; an empty table gives no rows;
rows are kept one to one; columns other than id, text and language are not read.
"""

from __future__ import annotations

import functools
import hashlib
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import in_python, table

SLOTS, SIZES = 1 << 13, (1, 2, 3)
PER_LANGUAGE, LANDMARKS, TRAIN_CHARS, RIDGE = 300, 24, 20_000, 1e-3
#: Languages that are learned at most, and rows of all of them.
LANGUAGES, TOTAL = 200, 6000
#: Characters that are hashed at once, and texts scored at once.
STRETCH, TEXTS = 1 << 20, 128
#: A trigram is known if this share of a language's training texts hold it.
RARE = 0.02
#: A document is rejected if its likeness is below this share of the median of held-out training rows, or below LEAST, or if it has
#: MANY different trigrams and is below LEAST by what other texts teach.
REJECT_BELOW, LEAST, MANY = 0.5, 0.1, 10


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def presence(text: str, out: np.ndarray) -> None:
    """Sets out's slots of the n-grams of a text."""
    for at in range(0, max(len(text), 1), STRETCH):
        codes = np.frombuffer(text[max(0, at - max(SIZES) + 1) : at + STRETCH].lower().encode("utf-32-le", "replace"), np.uint32)
        h = np.zeros(len(codes), np.uint32)
        for n in SIZES:
            if n > len(codes):
                break
            h = (h[: len(codes) - n + 1] * np.uint32(0x9E3779B1) + codes[n - 1 :] + np.uint32(n)) * np.uint32(0x85EBCA6B)
            mixed = h ^ (h >> np.uint32(15))
            out[(mixed * np.uint32(0xC2B2AE35)) >> np.uint32(32 - 13)] = 1


def matrix(texts: list[str]) -> np.ndarray:
    x = np.zeros((len(texts), SLOTS), np.float32)
    for row, text in zip(x, texts, strict=True):
        presence(text, row)
    return x


def kernel(x: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    own, theirs = np.sqrt(x.sum(1)), np.sqrt(landmarks.sum(1))
    return (x @ landmarks.T) / np.maximum(own[:, None] * theirs[None], 1e-9)


@functools.lru_cache(1)
def letters() -> np.ndarray:
    """By code point, whether it is a letter or a mark on one."""
    return np.fromiter((unicodedata.category(chr(c))[0] in "LM" for c in range(0x110000)), bool, 0x110000)


def spelled(text: str, places: np.ndarray):
    """Numbers of a text's characters by places, 0 for each run of others than letters and at both ends; in stretches that
    overlap by two."""
    last = np.zeros(1, places.dtype)
    for at in range(0, len(text), STRETCH):
        codes = np.frombuffer(text[at : at + STRETCH].lower().encode("utf-32-le", "replace"), np.uint32)
        x = np.concatenate([last, places[codes], last[:0] if at + STRETCH < len(text) else np.zeros(1, places.dtype)])
        x = x[np.concatenate([[True], (x[1:] != 0) | (x[:-1] != 0)])]
        yield x
        last = x[-2:]


def trigrams(x: np.ndarray, base: int) -> np.ndarray:
    x = x.astype(np.int64)
    return (x[:-2] * base + x[1:-1]) * base + x[2:]


def learned(rows: list[tuple[str, str]]) -> dict:
    """The letters of the rows, the trigrams known from them, and by text the places of those that none but it and its copies teach."""
    alphabet = np.array(sorted({ord(c) for _, text in rows for c in text.lower()}), np.int64)
    alphabet = alphabet[letters()[alphabet]] if len(alphabet) else alphabet
    places, base, known, alone = placed(alphabet), len(alphabet) + 2, [np.zeros(0, np.int64)], {}
    for lang in sorted({lang for lang, _ in rows}):
        held = {}
        for h in (np.concatenate([trigrams(x, base) for x in spelled(text, places)]) for of, text in rows if of == lang):
            held[hashlib.blake2b(h, digest_size=16).digest()] = np.unique(h)
        found, times = np.unique(np.concatenate(list(held.values())), return_counts=True)
        least = max(1.0, RARE * len(held))
        known.append(found[times >= least])
        scarce = found[(times >= least) & (times - 1 < least)]
        for sign, h in ((sign, h) for sign, h in held.items() if len(h) >= MANY):
            alone.setdefault(sign, []).append(np.intersect1d(h, scarce, assume_unique=True))
    known, languages = np.unique(np.concatenate(known), return_counts=True)
    own = {}
    for sign, parts in alone.items():
        h, times = np.unique(np.concatenate(parts), return_counts=True)
        at = np.searchsorted(known, h)
        own[sign] = at[times == languages[at]].astype(np.int32)
    return {"alphabet": alphabet, "known": known, "own": {sign: at for sign, at in own.items() if len(at)}}


def placed(alphabet: np.ndarray) -> np.ndarray:
    """By code point: 0 for what is no letter, the place in the alphabet from 1 on, and one more for other letters."""
    places = np.where(letters(), len(alphabet) + 1, 0).astype(np.int32)
    places[alphabet] = np.arange(1, len(alphabet) + 1)
    return places


def measured(text: str, known: np.ndarray, of: tuple, places: np.ndarray, base: int) -> tuple[bytes, float]:
    """What a text shares with its copies only, and its likeness by the known trigrams. of: the three places of each."""
    n, hits, counts, sign = 0, 0, np.zeros(base), hashlib.blake2b(digest_size=16)
    for x in spelled(text, places):
        h = trigrams(x, base)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        n, hits, counts = n + len(h), hits + int((known[at] == h).sum()) if len(known) else 0, counts + np.bincount(x, minlength=base)
        sign.update(h)
    p = counts / max(counts.sum(), 1)
    # no two blanks stand side by side
    chance = float((p[of[0]] * p[of[1]] * p[of[2]]).sum()) / max(1 - 2 * p[0] ** 2 + p[0] ** 3, 1e-9)
    return sign.digest(), 0.0 if not n else 1.0 if hits == n else (hits / n - chance) / max(1 - chance, 1e-9)


def likenesses(seen: dict, texts: list[str]) -> list[tuple[bytes, float, float]]:
    """By text: what it shares with its copies only, its likeness, and its likeness by what other texts teach."""
    places, base, out = placed(seen["alphabet"]), len(seen["alphabet"]) + 2, []
    split = lambda known: (known, (known // base**2, known // base % base, known % base))
    known = split(seen["known"])
    for text in texts:
        sign, x = measured(text, *known, places, base)
        own = seen["own"].get(sign)
        out.append((sign, x, x if own is None else measured(text, *split(np.delete(seen["known"], own)), places, base)[1]))
    return out


def likeness(seen: dict, texts: list[str]) -> list[float]:
    """1 if all trigrams of a text are known, about 0 if no more are than by chance."""
    return [x for _, x, _ in likenesses(seen, texts)]


def usual(rows: list[tuple[str, str]]) -> float:
    """Median likeness of half the training rows, by what the other half teaches."""
    by = {lang: [row for row in rows if row[0] == lang] for lang in {lang for lang, _ in rows}}
    teach, rest = [row for same in by.values() for row in same[::2]], [text for same in by.values() for _, text in same[1::2]]
    return float(np.median(likeness(learned(teach), rest))) if rest else 0.0


def fit(rows: list[tuple[str, str]]) -> dict | None:
    """rows: (language, text), in the order of preference for landmarks."""
    languages = sorted({lang for lang, _ in rows})
    if not languages:
        return None
    by = {lang: [t for x, t in rows if x == lang][:PER_LANGUAGE] for lang in languages}
    landmarks = matrix([t for lang in languages for t in by[lang][:LANDMARKS]])
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks).astype(float))
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    texts, y = [t for lang in languages for t in by[lang]], np.repeat(np.arange(len(languages)), [len(by[lang]) for lang in languages])
    phi = kernel(matrix(texts), landmarks) @ root
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # each side of one versus rest weighs the same
    weight = np.where(target > 0, 0.5 / np.maximum((target > 0).sum(0), 1), 0.5 / np.maximum((target < 0).sum(0), 1))
    coef = np.stack([np.linalg.solve((phi * w[:, None]).T @ phi + RIDGE / len(texts) * np.eye(phi.shape[1]), (phi * w[:, None]).T @ t) for w, t in zip(weight.T, target.T, strict=True)], 1)
    return {"languages": languages, "landmarks": landmarks.astype(np.uint8), "coef": (root @ coef).astype(np.float32)}


def fit_likeness(rows: list[tuple[str, str]]) -> dict:
    """What likenesses() needs, and the median of held-out training rows."""
    by = {lang: [row for row in rows if row[0] == lang][:PER_LANGUAGE] for lang in sorted({lang for lang, _ in rows})}
    rows = [row for same in by.values() for row in same]
    seen = learned(rows)
    for same in [{sign: x for sign, _, x in likenesses(seen, [text for _, text in same])} for same in by.values()]:
        if np.median(list(same.values())) < LEAST:
            seen["own"] = {sign: at for sign, at in seen["own"].items() if sign not in same}
    return seen | {"usual": usual(rows)}


def lettered(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def score(model: dict | None, landmarks: np.ndarray | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    if model is None:
        return langs, scores
    some = [i for i, t in enumerate(texts) if lettered(t)]
    for lo in range(0, len(some), TEXTS):
        part = some[lo : lo + TEXTS]
        values = kernel(matrix([texts[i] for i in part]), landmarks) @ model["coef"]
        best = values.argmax(1)
        for i, k, v in zip(part, best.tolist(), values[np.arange(len(part)), best].tolist(), strict=True):
            langs[i], scores[i] = model["languages"][k], min(1.0, max(0.0, (v + 1) / 2))
    return langs, scores


def sample(docs: DataFrame) -> list[tuple[str, str]]:
    """At most PER_LANGUAGE training rows of each language and TOTAL of all, by the order of a hash; of the LANGUAGES most frequent ones."""
    eligible = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & (F.length("text") <= TRAIN_CHARS))
    counts = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()).groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES)
    counts = {r["lang"]: r["count"] for r in counts.collect()}
    if not counts:
        return []
    each = max(2, min(PER_LANGUAGE, TOTAL // len(counts)))
    share = F.lit(0.0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1.0, 2.0 * each / n)).otherwise(share)
    h = F.xxhash64("doc_id", "text")
    picked = eligible.filter(F.pmod(h, F.lit(1 << 30)) < share * (1 << 30)).select("lang", "text", F.xxhash64("text", "doc_id").alias("h"))
    rows = picked.orderBy("h", "lang", "text").limit(2 * each * len(counts)).collect()
    out, taken = [], dict.fromkeys(counts, 0)
    for r in rows:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= each:
            out.append((r["lang"], r["text"]))
    return out


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row: id, held_out, lang_pred, score."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = docs.sparkSession.sparkContext.broadcast(fit(sample(rows)))

    def run(batches):
        landmarks = model.value and model.value["landmarks"].astype(np.float32)
        for batch in batches:
            langs, scores = score(model.value, landmarks, batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return in_python(rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, lang_pred string, score double")


def accepted(docs: DataFrame, reject_below: float = REJECT_BELOW) -> DataFrame:
    """docs, all columns, without the rows whose text has no letter or is like no text that was learned from; a lang that is
    null becomes the predicted one. Where there is nothing to learn from, only rows without a letter go, and lang stays."""
    rows = sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang"))
    seen = docs.sparkSession.sparkContext.broadcast((fit(rows), fit_likeness(rows) if rows else None))
    text_at, lang_at = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        model, known = seen.value
        landmarks = model and model["landmarks"].astype(np.float32)
        for batch in batches:
            texts, langs = batch.column(text_at).to_pylist(), batch.column(lang_at).to_pylist()
            keep = [i for i, t in enumerate(texts) if lettered(t)]
            if known:
                limit = max(LEAST, reject_below * known["usual"])
                keep = [i for i, (_, x, by_others) in zip(keep, likenesses(known, [texts[i] for i in keep]), strict=True) if x >= limit and by_others >= LEAST]
            unknown = [i for i in keep if langs[i] is None] if model else []
            for i, lang in zip(unknown, score(model, landmarks, [texts[i] for i in unknown])[0], strict=True):
                langs[i] = lang
            if unknown:
                batch = batch.set_column(lang_at, batch.schema.field(lang_at).name, pa.array(langs, pa.string()))
            yield batch.take(pa.array(keep, pa.int64()))

    return in_python(docs, run, docs.schema)


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))
