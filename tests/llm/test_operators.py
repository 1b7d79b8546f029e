"""Small fixtures against brute force: nulls, empty and long texts, copies, empty tables, extra columns with clashing names."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import ann, bpe, components, decontaminate, langid, licenses, neardup, pii, substrings, toxicity, urls

WORDS = [f"w{i}" for i in range(400)]
PASSAGE = " ".join(WORDS[:60])
TEXTS = [
    (1, "alpha beta " + PASSAGE + " gamma"), (2, PASSAGE), (3, None), (4, ""), (5, "one two"), (6, "alpha beta " + PASSAGE + " gamma"),
    (6, "alpha beta " + PASSAGE + " gamma"), (7, " ".join(WORDS[100:400])), (8, " ".join(w if i % 97 else "changed" for i, w in enumerate(WORDS[100:400]))),
    (None, "no id here at all"), (9, "x " * 5000), (10, "Ünïcödé \t\n\x0b\x0c\r tokens\x1c and\x85 more 日本語"), (11, "   \n\t "), (12, ",.;!? 12 %%"),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(*r, "k", 1, "t", "g") for r in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, a int, told string, g string").repartition(3)


def as_set(df, *columns):
    return sorted([tuple(r) for r in df.select(*columns).collect()], key=str)


def test_substring_dedup(docs):
    for size, chunk in ((35, 1_000_000), (5, 40)):
        found = as_set(substrings.dedup(docs, size=size, chunk=chunk), "doc_id", "n_words", "n_removed", "kept_sha256")
        cut = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in TEXTS]
        times = collections.Counter(tuple(w[i : i + size]) for w in cut for i in range(len(w) - size + 1))
        want = []
        for (doc_id, _), w in zip(TEXTS, cut, strict=True):
            gone = {j for i in range(len(w) - size + 1) if times[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
            kept = " ".join(x for j, x in enumerate(w) if j not in gone)
            want.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
        assert found == sorted(want, key=str)


def test_intervals_are_maximal():
    assert substrings.intervals(np.array([1, 0, 0, 1, 0, 0, 0, 0, 1], bool), 3) == [(0, 6), (8, 11)]


def test_darts_estimate_weighted_similarity():
    a, b = " ".join(WORDS[:300]), " ".join(["other"] * 40 + WORDS[:300])
    doc, h, w = neardup.weighted([a, b, ""])
    e = np.searchsorted(doc, np.arange(4))
    true = neardup.jaccard((h[e[0] : e[1]], w[e[0] : e[1]]), (h[e[1] : e[2]], w[e[1] : e[2]]))
    signature = neardup.darts(doc, h, w, 3)
    assert (signature[:2] != 0).all() and (signature[2] == 0).all()
    assert abs((signature[0] == signature[1]).mean() - true) < 0.12


def test_near_duplicate_classes(docs):
    found = as_set(neardup.classes(docs), "doc_id", "class_id", "class_size")
    def shingles(t):
        w = (t or "").lower().split()
        return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None
    sets = [shingles(t) for _, t in TEXTS]
    parent = list(range(len(TEXTS)))
    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x and y and sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                old, new = parent[i], parent[j]
                parent = [new if p == old else p for p in parent]
    want = []
    for i, (doc_id, _) in enumerate(TEXTS):
        mine = [TEXTS[j][0] for j in range(len(TEXTS)) if parent[j] == parent[i]]
        ids = [x for x in mine if x is not None]
        want.append((doc_id, min(ids) if ids else None, len(mine)))
    assert found == sorted(want, key=str)


def test_columns_of_clashing_names_stay(spark, docs):
    names = ["first_id", "first_key", "leak_id", "leak_key", "node", "root", "f", "i", "j", "k", "_id", "_k", "_leak_id"]
    more = docs.select("*", *[F.lit(7).alias(n) for n in names])
    kept = neardup.first_of_class(more)
    assert kept.columns == more.columns and kept.count() == neardup.first_of_class(docs).count()
    item = docs.sparkSession.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    left = decontaminate.clean(more, item)
    assert left.columns == more.columns and sorted(r[0] for r in left.filter("doc_id is not null").select("doc_id").collect()) == [3, 4, 5, 7, 8, 9, 10, 11, 12]
    assert neardup.first_of_class(docs.limit(0)).count() == 0 and neardup.classes(docs.limit(0)).count() == 0


def test_first_of_class_keeps_one_of_each_and_all_columns(docs):
    kept = neardup.first_of_class(docs)
    assert kept.columns == docs.columns
    assert sorted([r[0] for r in kept.select("doc_id").collect()], key=str) == sorted([1, 3, 4, 5, 7, None, 9, 10, 11, 12], key=str)


def test_closing_finds_links_that_leaders_miss():
    texts = [" ".join(WORDS[:100]), " ".join([*WORDS[:98], "p", "q"]), " ".join(WORDS[200:300])]
    ks, roots = np.array([5, 6, 7]), np.array([5, 6, 7])
    assert [(a, b) for a, b, _ in neardup.forest(ks, roots, np.array([0, 1, 1]), texts, 0.8)] == [(5, 6)]
    assert neardup.forest(ks, np.array([5, 5, 7]), np.array([0, 1, 1]), texts, 0.8) == []


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (9, 10), (10, 11), (11, 12), (12, 3)], "a long, b long")
    assert dict(components.components(edges).collect()) == {n: 1 for n in (1, 2, 3, 9, 10, 11, 12)} | {4: 4, 5: 4}


def test_bpe_equals_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(bpe.default_path())
    texts = [t or "" for _, t in TEXTS] + ["<|endoftext|> a<|endoftext|>", "it's  I'LL\n\n don't aaaaaaaaa", "🙂🙂 ñ", *("x" + chr(c) + " " + chr(c) + "1" for c in range(32, 0x3100))]
    made = bpe.tokenizer(bpe.default_path()).run(texts)
    for t, (ids, raw), e in zip(texts, made, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == e.ids, t
        assert raw.decode() == library.decode(e.ids, skip_special_tokens=False)
    rows = bpe.encode(docs).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        assert len(r["ids"]) == 4 * r["n_tokens"] and hashlib.sha256(bytes(r["ids"])).hexdigest() == r["ids_sha256"]
        assert bpe.tokenizer(bpe.default_path()).decode(np.frombuffer(r["ids"], "<u4").tolist()) == r["decoded"]


def test_language_identification(spark):
    words = {"en": "the of and to in is that for", "de": "der die und zu das nicht ein ich", "fr": "le de et la les des est un"}
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i in range(150) for lang in [list(words)[i % 3]]]
    rows += [(500, None, "en"), (501, "", "de"), (502, "123 !!", "fr"), (503, "the and of", None), (None, "der die das", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = langid.predict(docs).collect()
    assert len(found) == len(rows)
    by = {r["doc_id"]: r for r in found}
    assert all(by[i]["lang_pred"] == lang for i, _, lang in rows[:150]) and all(0 <= r["score"] <= 1 for r in found)
    assert {by[i]["lang_pred"] for i in (500, 501, 502)} == {"und"} and by[503]["lang_pred"] == "en"
    kept = langid.accepted(docs.withColumn("near", F.lit(1)))
    assert kept.count() == 152 and kept.columns == ["doc_id", "text", "lang", "near"]
    assert {r["lang_pred"] for r in langid.predict(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(docs.limit(0)).count() == 0


def test_foreign_and_junk_texts_are_rejected_at_any_length(spark):
    words = {"en": "the of and to in is that for house garden rain hill before cat", "de": "der die und zu das nicht ein ich haus garten regen berg vor katze"}
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(words[lang].split(), (8, 40, 1000)[i % 3])), lang) for i in range(120) for lang in [list(words)[i % 2]]]
    kinds = [
        [chr(c) for c in range(0x4E00, 0x9000)], [chr(c) for c in range(0x430, 0x450)] + [" "] * 6, [chr(c) for c in range(0xE01, 0xE3B)],
        list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"), list("abcdefghijklmnopqrstuvwxyz    "),
    ]
    junk = [(1000 + i, "".join(rng.choice(kind, n)), None) for i, (kind, n) in enumerate((k, n) for k in kinds for n in (40, 100, 1000, 5000, 200_000))]
    junk += [(2000, "", "en"), (2001, "123 !!", "en")]
    more = [(3000, "the rain of that garden 12345 http://a.example", None), (3001, "Das Haus", None)]
    docs = spark.createDataFrame(rows + junk + more, "doc_id long, text string, lang string")
    assert {r["doc_id"] for r in langid.accepted(docs).collect()} == {i for i, *_ in rows + more}


def test_language_stage_without_anything_to_learn_from(spark):
    rows = [(1, "the cat", None, 1), (2, "日本語", None, 2), (3, "12 !", None, 3), (4, None, None, 4), (1, "the cat", None, 5), (None, "a", None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, keep int")
    assert sorted(r["keep"] for r in langid.accepted(docs).collect()) == [1, 2, 5, 6]
    assert langid.accepted(docs.limit(0)).count() == 0 and langid.accepted(docs).columns == docs.columns


def test_language_stage_fills_in_the_language(spark):
    words = {"en": "the of and to in is that for", "de": "der die und zu das nicht ein ich"}
    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(words[lang].split(), 30)), lang if i < 90 else None, lang) for i in range(100) for lang in [list(words)[i % 2]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string")
    kept = langid.accepted(docs).collect()
    assert len(kept) == 100 and all(r["lang"] == r["truth"] for r in kept)


def test_kernel_and_ridge_by_definition():
    """The prediction from kernels of sets of n-grams and a ridge solved in the kernel's own space, on ten texts."""
    rows = [("en", "the cat sat"), ("de", "die katze sitzt"), ("en", "a dog ran off"), ("de", "der hund lief weg"), ("en", "the sun is up"), ("de", "die sonne scheint"), ("en", "it rains again"), ("de", "es regnet wieder")]
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    texts = [t for lang in ("de", "en") for x, t in rows if x == lang]
    k = lambda a, b: len(grams(a) & grams(b)) / (len(grams(a)) * len(grams(b))) ** 0.5
    gram = np.array([[k(a, b) for b in texts] for a in texts])
    model = langid.fit(rows)
    assert np.abs(langid.kernel(langid.matrix(texts), model["landmarks"].astype(np.float32)) - gram).max() < 0.05  # but for slots that collide
    gram = langid.kernel(langid.matrix(texts), langid.matrix(texts)).astype(float)
    y = np.repeat([0, 1], 4)
    for lang in (0, 1):
        t = np.where(y == lang, 1.0, -1.0)
        # every text is a landmark, so that the features' products are the kernel: weighted ridge in dual form, each text weighing 1/8
        alpha = np.linalg.solve(gram + langid.RIDGE / 8 / (1 / 8) * np.eye(8), t)
        new = langid.matrix(["the katze is weg", "cat und dog"])
        assert np.abs(langid.kernel(new, langid.matrix(texts)) @ alpha - langid.kernel(new, model["landmarks"].astype(np.float32)) @ model["coef"][:, lang]).max() < 0.02


def test_labelled_junk_does_not_vouch_for_itself(spark):
    words = {"en": "the of and to in is that for house garden rain hill before cat", "de": "der die und zu das nicht ein ich haus garten regen berg vor katze"}
    rng = np.random.default_rng(3)
    rows = [(3 * i, " ".join(rng.choice(words[lang].split(), 30)), lang) for i in range(40) for lang in [list(words)[i % 2]]]
    han, keys = [chr(c) for c in range(0x4E00, 0x9000)], list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    texts = ["".join(rng.choice(kind, n)) for kind in (han, keys) for n in (40, 1000, 5000)]
    # ids of both kinds, those that teach and those held out; copies, and copies in other digits
    junk = [(1000 + 10 * i + k, text + (" 12" if k > 3 else ""), "en") for i, text in enumerate(texts) for k in range(8)]
    # the only text of a language, one too short to tell, and two of many letters that have little in common
    more = [(3000, "olen talo", "fi"), (3001, "kuu", "en"), *((4000 + i, "".join(rng.choice(han, 60)), "zh") for i in range(6))]
    docs = spark.createDataFrame(rows + junk + more, "doc_id long, text string, lang string")
    taught = {r["doc_id"] for r in docs.filter(~langid.held_out(F.col("doc_id"))).collect()}
    assert {1000, 1001, 1002, 1003, 1004} & taught and {i for i, *_ in more} & taught
    kept = {r["doc_id"] for r in langid.accepted(docs).collect()}
    assert kept >= {i for i, *_ in rows} and not kept & {i for i, *_ in junk} and kept >= {i for i, *_ in more} & taught


def test_likeness_does_not_depend_on_where_a_text_is_cut(monkeypatch):
    rows = [("en", "the cat and the dog sat -- in the sun"), ("en", "rain on the hill")]
    seen, texts = langid.learned(rows), ["the rain -- and 日本 the cow", "a", "hill"]
    whole = langid.likeness(seen, texts)
    monkeypatch.setattr(langid, "STRETCH", 1 << 10)
    assert langid.likeness(seen, texts) == whole and whole[2] == 1.0
    long = langid.likeness(seen, [" ".join(texts[:1] * 1000)])[0]
    monkeypatch.setattr(langid, "STRETCH", 1 << 20)
    assert abs(langid.likeness(seen, [" ".join(texts[:1] * 1000)])[0] - long) < 0.01


def test_urls(spark):
    rows = [
        (1, "http://A.Example.COM/en/1?x", "a.example.com", "/en/1", "example.com/en/", "block"), (2, "https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
        (3, "https://x.www.example.com/en/a#f", "x.www.example.com", "/en/a", "www.example.com/en/", "allow"), (4, "http://b.net/fr/1", "b.net", "/fr/1", "net/fr/", "block"),
        (5, "http://b.com", "b.com", "", None, None), (6, "http://com/x", "com", "/x", "com/", "allow"), (7, None, "", "", None, None), (8, "no scheme", "", "", None, None),
        (9, "http://notexample.com/en/1", "notexample.com", "/en/1", "com/", "allow"), (9, "ftp://q.org?://z", "q.org", "", None, None), (None, "a://b://c/d", "b:", "//c/d", None, None),
    ]
    pages = spark.createDataFrame([(i, u, "h", 0) for i, u, *_ in rows], "page_id long, url string, host string, score int")
    found = {(r["page_id"], r["host"]): r for r in urls.judge(pages).collect()}
    for i, _, host, path, rule, verdict in rows:
        r = found[i, host]
        assert (r["path"], r["rule"]) == (path, rule) and r["verdict"] in ("allow", "block") and verdict in (None, r["verdict"])
    seen = spark.createDataFrame([(i, "http://" + u) for i, u in enumerate([*urls.BLOCKED.split(), *urls.ALLOWED.split()])], "page_id long, url string")
    n = len(urls.BLOCKED.split())
    right = [(r["block_score"] >= 0.5) == (r["page_id"] < n) for r in urls.judge(seen).collect()]
    assert sum(right) > 0.95 * len(right)
    new = [("http://casino-bonus.example.org/play", "block"), ("http://library.example.org/catalog", "allow")]
    assert [r["verdict"] for r in urls.judge(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(new)], "page_id long, url string")).orderBy("page_id").collect()] == [v for _, v in new]


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 24))
    x[100:900] = x[100]  # many copies of one vector
    rows = [(i, [float(np.float32(v)) for v in r]) for i, r in enumerate(x)] + [(40_000, None), (40_020, [0.0] * 24), (40_040, [float("nan")] * 24), (40_060, [1.0, None] * 12), (40_080, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = collections.defaultdict(list)
    for r in ann.search(table).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    x = x.astype(np.float32).astype(float)
    assert sorted(found) == list(range(0, 3000, 20))
    hit = 0
    for q, got in found.items():
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:20].tolist()
        hit += len({v for v, _ in got} & set(best))
        assert len(got) == 20 and got == sorted(got, key=lambda g: (-g[1], g[0])) and all(abs(score - x[v] @ x[q]) < 1e-9 for v, score in got)
    assert hit >= 0.9 * 20 * len(found)
    few = {(r["query_id"], r["rank"], r["vec_id"]) for r in ann.search(table.filter("vec_id in (0, 1, 2)")).collect()}
    assert {(q, k) for q, k, _ in few} == {(0, 1), (0, 2)}
    assert ann.search(table.limit(0)).count() == 0


def test_a_repeated_query_id_asks_with_its_least_vector(spark):
    table = spark.createDataFrame([(0, [2.0, 1.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (20, [1.0, 0.0, 0.0, 0.0]), (3, [0.0, 5.0, 0.0, 0.0])], "vec_id long, embedding array<double>")
    rows = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in ann.search(table).collect()}
    assert rows == {(0, 1): (20, 1.0), (0, 2): (3, 0.0), (20, 1): (0, 2.0), (20, 2): (0, 1.0), (20, 3): (3, 0.0)}


def test_copies_of_a_vector_crowd_out_no_candidate(spark):
    """More equal vectors than candidates, among them many rows of one query's own id, beside better and worse ones."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 8))
    x[100:500] = x[0] * 1.5
    ids = np.concatenate([np.arange(500), np.full(60, 40), np.arange(560, 600)])
    x[500:560] = x[100]
    table = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.search(table, rerank=60).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], round(r["score"], 9)))
    for q, got in found.items():
        asks = min(x[ids == q].tolist())
        right = sorted([(-round(float(np.dot(v, asks)), 9), int(i)) for i, v in zip(ids, x, strict=True) if i != q])[:20]
        assert len({g for g in got} & {(i, -s) for s, i in right}) >= 0.9 * len(set(right))
    assert len(found[0]) == 20 and all(100 <= i < 500 or i == 40 for i, _ in found[0])


def test_ann_finds_the_nearest_of_large_groups_of_near_copies(spark):
    """Groups of more rows than candidates, closer to each other than centres are, and lengths of several scales."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(6, 16))[rng.integers(0, 6, 4000)] * (1 + 1e-3 * rng.normal(size=(4000, 16)))
    x[3000:] = rng.normal(size=(1000, 16)) * 10.0 ** rng.integers(-3, 2, (1000, 1))
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    found = collections.defaultdict(list)
    for r in ann.search(table, every=40).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    right = {}
    for q in range(0, 4000, 40):
        s = np.einsum("ij,j->i", x, x[q])
        s[q] = -np.inf
        right[q] = np.lexsort((np.arange(4000), -s))[:20].tolist()
    assert found == right


@pytest.mark.parametrize(("dims", "n"), [(5, 300), (1536, 300)])
def test_ann_codes_meet_only_their_blocks(spark, monkeypatch, dims, n):
    """Many blocks and strands, dimensions that fill no byte, and sums beyond 16 bits give what one block gives."""
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(rng.normal(size=(n, dims)))], "vec_id long, embedding array<double>").repartition(3, "vec_id")
    monkeypatch.setattr(ann, "SAMPLE", 60)
    monkeypatch.setattr(ann, "ROUNDS", 2)
    whole = sorted(ann.search(table, top=5, rerank=300).collect())
    for name, size in (("ROW_BLOCK", 16), ("QUERY_BLOCK", 4), ("STRAND", 90)):
        monkeypatch.setattr(ann, name, size)
    cut = sorted(ann.search(table, top=5, rerank=300).collect())
    assert [r[:3] for r in whole] == [r[:3] for r in cut] and len(cut) == 5 * n // 20


@pytest.mark.parametrize("parts", [16, 257, 258, 1000])
def test_ann_scan_sums_do_not_wrap(parts):
    lut = np.zeros((parts, ann.CENTRES), np.uint8)
    lut[:, 1], lut[:, 2] = 255, 254
    codes = np.repeat(np.arange(3, dtype=np.uint8)[:, None], parts, 1)
    assert ann.scan(lut, codes).tolist() == [0, 255 * parts, 254 * parts]


def test_licenses(spark):
    rows = [(1, "x\nReleased under the MIT License.\ny"), (2, "released UNDER the  mit license!"), (3, "All rights reserved.\n\nThis program is free software: you can redistribute it and/or modify it under\nthe terms of the GNU General Public License as published by the Free Software Foundation, either\nversion 3 of the License, or (at your option) any later version."), (4, None), (5, ""), (5, "no licence in this text " * 400), (None, "a\nb")]
    found = sorted([tuple(r)[:4] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").withColumn("name", F.lit(1))).collect()], key=str)
    want = [(1, 1, "MIT", "MIT"), (2, 1, "MIT", "MIT"), (3, 2, "GPL-3.0,Proprietary", "GPL-3.0"), (4, 0, "", None), (5, 0, "", None), (5, 0, "", None), (None, 0, "", None)]
    assert found == sorted(want, key=str)


HEADER = """{0} Copyright 2020 The Authors of this work and of its many parts
{0}
{0} This program is free software: you can redistribute it and/or modify it under the terms
{0} of the GNU General Public License as published by the Free Software Foundation, either
{0} version 3 of the License, or (at your option) any later version.
{0}
{0} This program is distributed in the hope that it will be useful, but without any warranty;
{0} not even the implied warranty of merchantability or fitness for a particular purpose.
"""


def test_licenses_in_comment_headers(spark):
    duckdb = pytest.importorskip("duckdb")
    rows = [(i, HEADER.format(sign)) for i, sign in enumerate((" *", "#", "//", "  ", "--", ""))]
    rows += [(10, HEADER.format("#").replace("\n", "\r\n")), (11, "/*\n" + HEADER.format(" *") + " */\n\nint main() {\n}\n"), (12, None), (13, "# \n#\n \n")]
    found = sorted([tuple(r) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()])
    assert [r[:4] for r in found] == [(i, 1, "GPL-3.0", "GPL-3.0") if i < 12 else (i, 0, "", None) for i, _ in rows]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert found == sorted(con.execute(licenses.ORACLE_SQL).fetchall())


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(400):
        w = list(rng.choice(WORDS, 40))
        if i % 5 < 2:
            w[3] = rng.choice(["grumblefoo", "snarkbar", "idiot"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(i % 5 < 2)))
    rows += [(900, None), (901, ""), (None, "idiot")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (1, None)], "doc_id long, toxic int")
    found = toxicity.predict(docs, table).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    truth = dict(labels)
    out = [r["predicted"] == truth[r["doc_id"]] for r in found if r["held_out"] and r["doc_id"] in truth]
    assert len(out) > 40 and sum(out) > 0.9 * len(out)
    assert {r["predicted"] for r in found if r["doc_id"] in (900, 901)} == {0}
    assert {r["score"] for r in toxicity.predict(docs, table.limit(0)).collect()} == {0.0}


def test_label_model_equals_bayes_by_enumeration():
    """With voters that share nothing, the posterior is the product of their likelihoods."""
    p = np.array([[[0.6, 0.3, 0.1], [0.5, 0.4, 0.1]], [[0.1, 0.3, 0.6], [0.2, 0.2, 0.6]]])
    prior, votes = np.array([0.7, 0.3]), np.array([[1, 1], [1, -1], [0, 0], [-1, 0]], float)
    for row, q in zip(votes, toxicity.posterior(votes, p, prior, np.ones(2)), strict=True):
        said = [prior[y] * np.prod([p[y, v, int(x) + 1] for v, x in enumerate(row)]) for y in (0, 1)]
        assert abs(q - said[1] / sum(said)) < 1e-12
    # a voter that is right nine times in ten is found out without labels, from a vague beginning
    rng = np.random.default_rng(0)
    truth = rng.random(3000) < 0.3
    said = np.stack([np.where(rng.random(3000) < r, truth, ~truth) * 2.0 - 1 for r in (0.9, 0.85, 0.8)], 1)
    vague = toxicity.accuracies(said[:40], truth[:40].astype(float))
    found = toxicity.label_model(said, vague)
    assert ((found >= 0.5) == truth).mean() > 0.93


def test_copies_teach_once():
    text = " ".join(WORDS[:30])
    rows = [(text, 0), (text, 1), (text + " end", 0), ("other words here are five six", 0), ("", 0), ("", 1)]
    kept = toxicity.different(rows)
    assert kept[0] == (text, 1) and ("", 1) in kept and len(kept) in (3, 4)


def test_pii_base_spans_and_field(spark):
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    tricky = "a@b@c.d a@@b.c x@y.z@w.v. @a.b a@b.c-d@e.f " + "a" * 300 + "@ q@r.s"
    assert pii.emails(tricky) == [m.span() for m in email.finditer(tricky)]
    text = "ä 1.2.3.4 256.1.1.1, 4111 1111 1111 1111 and +1 (456) 555-2186, 4111111111111112"
    assert [(pii.KINDS[k], text[s:e]) for k, s, e in pii.base_spans(text)] == [("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (456) 555-2186")]
    model = pii.train()
    lines = ["please call (212) 555-0147 soon", "write jim[at]example.org now", "nothing to see in 2019 or version 2.0."]
    found = pii.added_spans(model, lines, [[], [], []])
    assert [[lines[i][s:e] for _, s, e in f] for i, f in enumerate(found)] == [["(212) 555-0147"], ["jim[at]example.org"], []]
    rows = pii.find(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, lines[0]), (4, lines[0])], "doc_id long, text string")).collect()
    by = {r["doc_id"]: r for r in rows}
    assert len(rows) == 5 and by[2]["spans"] == "" and by[2]["base_sha256"] == hashlib.sha256(b"").hexdigest() and by[4]["n_phone"] == 0 and by[4]["spans"].startswith("phone:")
    masked = pii.masked(spark.createDataFrame([(1, "to a@b.co or 1.2.3.4.", 5), (2, None, 6)], "doc_id long, text string, n int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in masked] == [(1, "to <EMAIL> or <IP>.", 5), (2, None, 6)]


def test_plain_lines_are_all_outside():
    model = pii.train()
    assert all(set(x) == {0} for x in pii.viterbi(model, [["The", "phone", "number", "of", "card", "holders"], ["call"], WORDS[:0] or ["x"]]))


def test_field_adds_numbers_that_run_on():
    model = pii.train()
    lines = ["was +1 (826) 555-4081 190.137.223.204 du anviou", "so 7536784127813050 4845168114407329 aique", "a 4111111111111111 4000000000000002 b", "row 12 8812734 0.25 then 7536784127813051 97"]
    base = [pii.base_spans(t) for t in lines]
    found = [[(pii.KINDS[k], lines[i][s:e]) for k, s, e in f] for i, f in enumerate(pii.added_spans(model, lines, base))]
    valid = [x for x in ("7536784127813050", "4845168114407329") if pii.luhn(x)]
    assert found == [[("phone", "+1 (826) 555-4081")], [("card", x) for x in valid], [("card", "4111111111111111"), ("card", "4000000000000002")], []]


def test_viterbi_against_enumeration():
    """The best of all label sequences, by the definition of a linear chain."""
    import itertools

    model = pii.train()
    lines = [["call", "(212)", "555-0147"], ["at", "4111111111111111", "12"], ["x"], ["write", "a[at]b.org"], []]
    for words, labels in zip(lines, pii.viterbi(model, lines), strict=True):
        scores = np.zeros((len(words), pii.N_LABELS))
        for t, found in enumerate(pii.placed(words)):
            scores[t] = sum([model["w"][model["names"][x]] for x in found if x in model["names"]], np.zeros(pii.N_LABELS))
            if not pii.may_begin(words[t]):
                scores[t, 1::2] += pii.NEVER

        def value(path):
            return model["begin"][path[0]] + sum(scores[t, y] for t, y in enumerate(path)) + sum(model["trans"][a, b] for a, b in itertools.pairwise(path))

        assert not words or labels == list(max(itertools.product(range(pii.N_LABELS), repeat=len(words)), key=value))


def test_a_long_line_among_short_ones_takes_little_memory():
    import tracemalloc

    model = pii.train()
    text = "word 12345 " * 10_000 + "\n" + "\n".join(["a 1 b"] * 255)
    pii.added_spans(model, ["warm 1 up"], [[]])
    tracemalloc.start()
    assert pii.added_spans(model, [text], [pii.base_spans(text)]) == [[]]
    assert tracemalloc.get_traced_memory()[1] < 40 << 20
    tracemalloc.stop()


def test_decontamination_against_brute_force(spark):
    items = [(1, " ".join(WORDS[:30])), (2, " ".join(WORDS[50:64])), (3, "too few words"), (4, " ".join(WORDS[:30]).upper()), (5, None), (6, "r r r r r r r r r r")]
    edited = WORDS[:30].copy()
    edited[1] = "zz"
    rows = [
        (1, "begin " + " ".join(WORDS[:30]) + " end"), (2, " ".join(edited)), (3, " ".join(WORDS[52:62])), (4, None), (5, ""), (6, " ".join(WORDS[300:400])),
        (7, "a, " + ", ".join(WORDS[50:64]) + "! b"), (7, "other"), (None, " ".join(WORDS[50:64])), (8, "q r r r r r r r r r r r s"), (9, " ".join(WORDS[200:300] * 30 + WORDS[:30])),
    ]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, h string, key int")
    table = spark.createDataFrame(items, "item_id long, text string")
    found = sorted([(r["doc_id"], tuple(r["item_ids"])) for r in decontaminate.contaminated(docs, table).collect()], key=str)

    def words(t):
        return [w for w in re.sub(r"[\W_]+", " ", (t or "").lower()).split(" ") if w]

    def shingles(w):
        return collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    want = []
    for i, t in rows:
        hit = set()
        for j, s in items:
            w, b = words(t), words(s)
            for at in range(max(1, len(w) - len(b) + 1)) if len(b) >= 5 else ():
                x, y = shingles(w[at : at + len(b)]), shingles(b)
                if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                    hit.add(j)
        want.append((i, tuple(sorted(hit))))
    assert found == sorted(want, key=str)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, table).collect()) == sorted(i for i, ids in want if not ids)
    assert decontaminate.clean(docs, table).columns == docs.columns
    assert decontaminate.contaminated(docs.limit(0), table).count() == 0 and decontaminate.clean(docs, table.limit(0)).count() == len(rows)


def test_edited_passages_against_all_windows(spark):
    """Insertions, deletions and substitutions at random places: found wherever any window of the item's size is near enough."""
    rng = np.random.default_rng(11)
    words = [f"v{i}" for i in range(3000)]
    items = [(i, [words[j] for j in rng.integers(0, 3000, int(rng.integers(20, 60)))]) for i in range(12)]
    rows, filler = [], lambda n: [words[j] for j in rng.integers(0, 3000, n)]
    for k in range(120):
        item = list(items[k % 12][1])
        for _ in range(k // 40):
            at, kind = int(rng.integers(0, len(item))), int(rng.integers(0, 3))
            item[at : at + 1] = [[], ["zz"], [item[at], "yy"]][kind]
        rows.append((k, filler(30) + item + filler(30)))
    count = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    want = {}
    for k, w in rows:
        near = set()
        for i, b in items:
            x = count(b)
            for at in range(len(w) - len(b) + 1):
                y = count(w[at : at + len(b)])
                if sum((x & y).values()) >= 0.8 * sum((x | y).values()):
                    near.add(i)
                    break
        want[k] = sorted(near)
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")).collect()
    planted = sum(map(len, want.values()))
    hit = sum(len(set(r["item_ids"]) & set(want[r["doc_id"]])) for r in found)
    assert planted > 40 and hit >= 0.97 * planted and all(set(r["item_ids"]) <= set(want[r["doc_id"]]) for r in found)


def test_url_regression_by_definition(spark):
    """The probability of a url from its distinct hashed n-grams and the fitted weights."""
    rows = [(1, "http://library.example.org/catalog/12"), (2, "x://casino/a?b"), (3, None), (4, "http://a"), (4, "http://a")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    intercept, weights = urls.fit(spark)
    host, path = urls.host_path(F.col("url"))
    hashed = {r["page_id"]: r["b"] for r in pages.select("page_id", urls.buckets(host, path).alias("b")).collect()}
    for r in urls.judge(pages).collect():
        z = intercept + sum(weights[b] for b in set(hashed[r["page_id"]]))
        assert abs(r["block_score"] - 1 / (1 + np.exp(-z))) < 1e-12
    assert urls.judge(pages.limit(0)).count() == 0 and licenses.scan(pages.limit(0).withColumnsRenamed({"page_id": "doc_id", "url": "text"})).count() == 0
    empty = pages.limit(0).withColumnsRenamed({"page_id": "doc_id", "url": "text"})
    assert substrings.dedup(empty).count() == 0 and bpe.encode(empty).count() == 0 and pii.find(empty).count() == 0


def test_short_benchmark_items_are_matched_exactly(spark):
    items = [(1, "What is love?"), (2, "Yes"), (3, "one two three four"), (4, "what is LOVE"), (5, " ".join(WORDS[:7])), (6, "!")]
    rows = [(1, "so, what is love; what is love"), (2, "what is this love"), (3, "yes yes yes " * 50), (4, "yesterday"), (5, "zero one two three four"), (6, "one two three"), (7, "yes"), (8, "a " + " ".join(WORDS[:7])), (9, " ".join(WORDS[:3])), (None, "what is love"), (10, None), (11, "")]
    docs, table = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {1: [1, 4], 3: [2], 5: [3], 7: [2], 8: [5], None: [1, 4]}
    found = decontaminate.contaminated(docs, table).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: list(r["item_ids"]) for r in found if r["contaminated"]} == want and all(r["best_similarity"] == float(r["contaminated"]) for r in found)
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs, table).collect()) == [2, 4, 6, 9, 10, 11]
