"""Every query with SQL against DuckDB on the smallest tables, and properties of the operators."""

import math
import os

import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import cleaning as C
from lodestone.operators import graph as G
from lodestone.operators import retrieval as R
from lodestone.operators import stats as S
from lodestone.operators.ranking import stable_rank
from lodestone.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A query of each family; the driver compares all of them.
COMPARED = ("bm25_rank", "tfidf_rank", "maxsim_rank", "chunk_agg", "graph_nodes", "pagerank", "bfs_levels", "html_to_text", "clean_blocks", "export_clean", "slug", "readability", "keyword_density", "spearman_per_query", "kendall_per_query", "bh_fdr", "rbo_pairs", "rbo_curve", "crawl_nodes", "crawl_manifest", "page_urls", "sentence_chunks", "lexical_features", "whatif_batch", "node_suggest", "significance_models")


def plain(rows, columns):
    key = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(None if r[i] is None or r[i] != r[i] else round(float(r[i]), 6) + 0.0 if isinstance(r[i], (int, float)) else str(r[i]) for i in key) for r in rows], key=str)


@pytest.mark.parametrize("name", COMPARED)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = registry.queries()[name](spark, DATA)
    found = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


@pytest.mark.parametrize(("word", "n"), [("cat", 1), ("make", 1), ("table", 1), ("the", 1), ("rhythm", 1), ("banana", 3), ("b", 1)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.col("w")), w=word) == n


@pytest.mark.parametrize(("stem", "title"), [("Orange_cat_0123456789", "Orange cat"), ("Orange_cat_abcdef0", "Orange cat abcdef0"), ("Cat", "Cat")])
def test_titles(spark, stem, title):
    assert one(spark, T.title_from_stem(F.col("s")), s=stem) == title


@pytest.mark.parametrize(("href", "title"), [("/wiki/A_B#x?y", "A B"), ("/wiki/A%20B", "A B"), ("/wiki/C++", "C++"), ("http://other/wiki/A", None), ("/wiki/#x", None)])
def test_hrefs(spark, href, title):
    assert one(spark, T.href_title(F.col("h"), "/wiki/"), h=href) == title


def test_pagerank_with_dangling_and_isolated_nodes(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "node long")
    links = G.edges(spark.createDataFrame([(0, 1), (0, 1), (1, 2), (2, 2), (1, 0)], "src long, dst long"), nodes)
    got = dict(G.pagerank(nodes, links, max_iter=100, tol=1e-12).collect())
    ranks = [0.25] * 4
    out = {0: [1], 1: [2, 0], 2: [], 3: []}
    for _ in range(200):
        new = [0.15 / 4 + 0.85 * (ranks[2] + ranks[3]) / 4] * 4
        for s, ds in out.items():
            for d in ds:
                new[d] += 0.85 * ranks[s] / len(ds)
        ranks = new
    assert all(abs(got[i] - ranks[i]) < 1e-9 for i in range(4)) and abs(sum(got.values()) - 1) < 1e-12
    with pytest.raises(ValueError):
        G.pagerank(nodes, links, damping=1.5)


def test_rank_is_a_permutation_with_ties_to_the_smaller_id(spark):
    rows = [(q, d, [0.0, 1.5, 1.5, -2.0, 0.0004, 0.0005][d % 6]) for q in (1, 2) for d in range(100)]
    got = stable_rank(spark.createDataFrame(rows, "query_id int, doc_id long, doc_score double")).collect()
    for q in (1, 2):
        want = [d for _, d, _ in sorted((r for r in rows if r[0] == q), key=lambda r: (-r[2], r[1]))]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["doc_rank"])] == want


def sign(v):
    return (v > 0) - (v < 0)


def test_concord_against_pairs():
    import random

    rng = random.Random(5)
    for n in (2, 3, 10, 57):
        x, y = [rng.randrange(6) for _ in range(n)], [rng.randrange(9) for _ in range(n)]
        assert S.concord(x, y) == sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i in range(n) for j in range(i))
    assert S.concord([1, 1, 1], [1, 2, 3]) == 0 and S.concord([1, 2, 3], [1, 2, 3]) == 3 and S.concord([], []) == 0


@pytest.mark.parametrize(("block", "blocks"), [(3, 1000), (1, 8), (1 << 16, 1024)])
def test_kendall_does_not_depend_on_blocks(spark, monkeypatch, block, blocks):
    """Groups of ties far wider than a block, constant columns, nulls and NaN."""
    import random

    monkeypatch.setattr(S, "BLOCK", block)
    monkeypatch.setattr(S, "BLOCKS", blocks)
    rng, rows = random.Random(6), []
    for q, values in ((1, 50), (2, 4), (3, 1), (4, 9)):
        for i in range(60):
            v = float(rng.randrange(values)) * rng.choice([-1, 1]) if q != 4 or i % 3 else 5.0
            rows.append((q, "f", (i + 1) if q != 2 else rng.randrange(20), None if i == 7 else float("nan") if i == 8 else v))
    got = {r["query_id"]: r["coef"] for r in S.kendall(spark.createDataFrame(rows, "query_id int, feature string, doc_rank int, value double")).collect()}
    for q in (1, 2, 3, 4):
        x, y = zip(*[(r, v) for g, _, r, v in rows if g == q and v is not None and v == v], strict=True)
        s = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i in range(len(x)) for j in range(i))
        a, b = (sum(v[i] != v[j] for i in range(len(v)) for j in range(i)) for v in (x, y))
        assert got[q] == (pytest.approx(s / math.sqrt(a * b), abs=1e-12) if a and b else None)


def test_p_values(spark):
    # two-sided values of Student's t from tables
    for t, df, p in ((2.262, 9, 0.05), (2.228, 10, 0.05), (12.706, 1, 0.05), (4.303, 2, 0.05), (2.045, 29, 0.05), (0.0, 5, 1.0)):
        assert abs(one(spark, S.t_two_sided(F.col("t"), F.col("d")), t=t, d=df) - p) < 2e-4


def test_untestable_features_and_monotone_correction(spark):
    rows = [(q, f, v) for f, vs in {"a": [0.1, 0.2, 0.3, 0.2], "b": [0.1, None], "c": [0.5, -0.5, 0.1]}.items() for q, v in enumerate(vs)]
    got = {r["feature"]: r for r in S.benjamini_hochberg(S.t_test(spark.createDataFrame(rows, "query_id int, feature string, coef double"))).collect()}
    assert got["b"]["p_value"] is None and got["b"]["significant"] is False and got["a"]["p_corrected"] <= got["c"]["p_corrected"]


def test_rbo_of_identical_disjoint_and_swapped_lists(spark):
    lists = {"x": [1, 2, 3], "same": [1, 2, 3], "far": [7, 8, 9], "swap": [2, 1, 3]}
    rows = [(m, 1, d, i + 1) for m, ds in lists.items() for i, d in enumerate(ds)]
    got = {(r["a"], r["b"], r["depth"]): r["rbo"] for r in S.rbo_curves(spark.createDataFrame(rows, "model string, query_id int, doc_id long, doc_rank int")).collect()}
    assert all(abs(got["same", "x", d] - 1) < 1e-12 for d in (1, 2, 3)) and all(got["far", "x", d] == 0 for d in (1, 2, 3))
    assert got["swap", "x", 1] == 0 and 0 < got["swap", "x", 2] < 1


def test_blocks(spark):
    prose = "This is a sentence that has rather more than eight words."
    text = "\n\n".join([prose, "- a1 item\n- b item", "- c\n- d\n- e\n- f", prose, "one two", "3 4", "x y z", "History", prose, "See also:", "gone"])
    out = C.cleaned(C.without_back_matter(C.exploded(spark.createDataFrame([(1, text), (2, "")], "id long, text string")))).collect()
    assert [(r["id"], r["text"].split("\n\n")) for r in out] == [(1, [prose, "The list also includes a1 item, b item, c, d, e.", "The list also includes f.", prose, prose])]


def test_constant_features_have_no_correlation(spark):
    rows = spark.createDataFrame([(1, "f", i, 2.0) for i in range(1, 5)], "query_id int, feature string, doc_rank int, value double")
    assert S.spearman(rows).first()["coef"] is None and S.kendall(rows).first()["coef"] is None


def test_whatif(spark):
    ranking = spark.createDataFrame([(1, 10, 1, 3.0), (1, 11, 2, 2.0), (1, 12, 3, 1.0)], "query_id int, doc_id long, doc_rank int, doc_score double")
    edits = spark.createDataFrame([(1, 12, 2.0)], "query_id int, doc_id long, new_score double")
    assert R.whatif(ranking, edits).first()["new_rank"] == 3


def test_entities_are_decoded_once(spark):
    text = "a &amp;lt; b &#233;&#xE9; &eacute;&nbsp;&Alpha; &unknown; &#1114112; &#x1F600; &amp;amp;"
    assert one(spark, T.decode_entities(F.col("t")), t=text) == "a &lt; b éé é\u00a0Α &unknown; &#1114112; 😀 &amp;"


def test_fragments_and_html(spark):
    page = '<p>x</p><DIV id="mw-content-text" class="a">A<br/>B<table class="infobox y"><tr><td>no</td></tr></table><table><tr><td>yes</td></tr></table><nav>n</nav><sup class="reference">1</sup><noscript>z</noscript></div><div id="catlinks">end</div><footer id="footer">'
    assert one(spark, T.html_text(T.fragment(F.col("h"))), h=page) == "A\nB\nyes\nn"
    assert one(spark, T.fragment(F.col("h")), h="no marker") == "no marker"
    assert one(spark, F.array_join(T.links(F.col("h")), " "), h='<a data-href="n" HREF="y"><a class=x href="z"><abbr href="q">') == "y z"


def test_late_interaction_against_brute_force(spark):
    docs = [(1, "big cats purr"), (2, "dogs bark at cats"), (3, None)]
    queries = [(0, "cats purr")]
    found = {r["doc_id"]: r["doc_score"] for r in R.late_interaction(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "query_id long, text string")).collect()}
    import hashlib

    def vector(w):
        v = [int(hashlib.md5(w.encode()).hexdigest()[2 * d : 2 * d + 2], 16) / 255.0 - 0.5 for d in range(R.TOKEN_DIMENSIONS)]
        return [x / math.sqrt(sum(y * y for y in v)) for x in v]

    asked = (["cats", "purr"] + [R.MASK] * R.QUERY_TOKENS)[: R.QUERY_TOKENS]
    for i, words in ((1, ["big", "cats", "purr"]), (2, ["dogs", "bark", "cats"])):
        want = sum(max(sum(a * b for a, b in zip(vector(q), vector(d), strict=True)) for d in words) for q in asked)
        assert abs(found[i] - want) < 1e-5
    assert 3 not in found


def test_a_walk_goes_on_where_it_was_cut_off(spark):
    from lodestone.operators import crawl as K

    links = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 0)], "src long, dst long")
    whole = {r["node"]: (r["level"], list(r["parents"])) for r in K.levels(links, 5, 0).collect()}
    assert whole == {0: (0, []), 1: (1, [0]), 2: (1, [0]), 3: (2, [1, 2]), 4: (3, [3])}
    assert {r["node"]: (r["level"], list(r["parents"])) for r in K.levels(links, 5, saved=K.levels(links, 2, 0)).collect()} == whole


def test_saved_states_belong_to_their_crawl():
    from lodestone.operators import crawl as K

    assert K.same_crawl({"root_category": "Cats"}, "cats", False) and not K.same_crawl({"root_category": "Cats", "include_all_namespaces": True}, "cats", False)
    assert not K.same_crawl({}, "", False) and K.same_crawl({"requested_root_category": "A", "root_category": "B"}, "b", False)


def test_average_ranks_do_not_depend_on_cells(spark, monkeypatch):
    rows = spark.createDataFrame([(0, float(v), i) for i, v in enumerate([5, -3, 5, 0, 1e9, -3, 2.5, 1e-3])], "g long, x double, r long")
    want = {0: 6.5, 1: 1.5, 2: 6.5, 3: 3.0, 4: 8.0, 5: 1.5, 6: 5.0, 7: 4.0}
    assert {r["r"]: r["a"] for r in S.average_ranks(rows, ["g"], "x", "a").collect()} == want
    monkeypatch.setattr(S, "CELL", 3)
    assert {r["r"]: r["b"] for r in S.average_ranks(rows, ["g"], "r", "b").collect()} == {i: i + 1.0 for i in range(8)}


def test_weights_do_not_depend_on_which_terms_are_frequent(spark, monkeypatch):
    rows = [(i, " ".join(["common"] * (1 + i % 3) + [f"word{j}" for j in range(i % 7, 40, 5)] + [f"rare{i}"])) for i in range(40)] + [(40, None), (41, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    queries = spark.createDataFrame([(0, "common word3 rare5 nowhere"), (1, "word6"), (2, None)], "query_id long, text string")
    taken = lambda: (sorted((r[0], r[1], round(r[2], 9)) for r in R.tfidf_weights(docs).collect()), sorted(tuple(r) for r in R.tfidf(docs, queries).collect()))
    whole = taken()
    assert len(whole[0]) > 300 and {q for q, _, _ in whole[1]} == {0, 1}
    for rows in (20, 0):
        monkeypatch.setattr(R, "SENT_ROWS", rows)
        assert taken() == whole
    assert {r["term"]: r["df"] for r in R.document_frequencies(docs).collect()}["common"] == 40
    assert R.tfidf_weights(docs.limit(0)).collect() == []


LOCAL = [(i, " ".join(["common"] * (1 + i % 3) + [f"word{j}" for j in range(i % 7, 40, 5)] + [f"rare{i}", "the", "Straße\u00e9", "x", "\u4e2d\u6587" if i % 2 else "\u4e2d", "a\u0301b"])) for i in range(80)] + [(80, None), (81, "")]
ASKED = [(0, "common word3 rare5 nowhere \u4e2d\u6587"), (1, "word6 word6"), (2, None), (7, "nothing here")]


def both_tables(spark):
    return spark.createDataFrame(LOCAL, "doc_id long, text string"), spark.createDataFrame(ASKED, "query_id long, text string")


@pytest.mark.parametrize(("group", "sent"), [(1 << 19, 100_000), (9, 100_000), (9, 20), (1 << 19, 5)])
def test_scores_where_documents_are_equal_those_of_joins(spark, monkeypatch, group, sent):
    """Whatever the parts of a ranking, and however many terms or queries are sent to all tasks."""
    from lodestone.operators import local as L

    docs, queries = both_tables(spark)
    want = {f: sorted(tuple(r) for r in R.rank_all(getattr(R, f)(docs, queries), docs, queries).collect()) for f in ("bm25", "tfidf")}
    weights = sorted((r[0], r[1], round(r[2], 9)) for r in R.tfidf_weights(docs).collect())
    monkeypatch.setattr(L, "GROUP", group)
    monkeypatch.setattr(R, "SENT_ROWS", sent)
    assert sorted((r[0], r[1], round(r[2], 9)) for r in L.tfidf_weights(docs).collect()) == weights
    for f, rows in want.items():
        scores = getattr(L, f)(docs, queries)
        if scores is None:
            assert sent < len(ASKED) + 4
            continue
        assert sorted(tuple(r) for r in scores.ranking().collect()) == rows
        assert sorted((r["query_id"], r["doc_id"], r["doc_rank"], r["doc_score"]) for r in scores.best(3).collect()) == [r for r in rows if r[2] <= 3]


def test_tokens_in_numpy_are_those_of_the_jvm(spark):
    import pyarrow as pa

    from lodestone.operators import local as L

    points = "".join(chr(c) for c in range(1, 0x3000) if not 0xD800 <= c < 0xE000)
    texts = ["", "A b cc Ddd_1", points, " ".join(points), "\U0001d54f\U0001d7d8 \U0001f600x \U0001f600", None, "end", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {r[0]: list(r[1] or []) for r in df.select("doc_id", T.tokens(F.col("text"))).collect()}
    told = L.spelled(df).orderBy("doc_id").toArrow().combine_chunks().to_batches()[0]
    doc, found = L.runs(told.column("_lower"), L.opened(L.token_points(spark)))
    got = {i: [w for d, w in zip(doc.tolist(), found.to_pylist(), strict=True) if d == i and w not in T.STOP_WORDS] for i in want}
    assert got == want


@pytest.mark.parametrize("group", [1 << 19, 7])
def test_coefficients_of_parts_are_those_of_rows(spark, monkeypatch, group):
    from lodestone.operators import local as L

    docs, queries = both_tables(spark)
    features = spark.createDataFrame([(i, float(i % 5), i * i % 37, 2.0) for i in range(82)], "doc_id long, f double, g int, h double")
    rows = S.rank_features(R.rank_all(R.bm25(docs, queries), docs, queries), features)
    want = {(r["query_id"], r["feature"]): (t["coef"], r["coef"]) for r, t in zip(S.spearman(rows).orderBy("query_id", "feature").collect(), S.kendall(rows).orderBy("query_id", "feature").collect(), strict=True)}
    monkeypatch.setattr(L, "GROUP", group)
    monkeypatch.setattr(S, "BLOCK", 16)
    placed, untied = S.feature_places(features)
    got = {(r["query_id"], r["feature"]): (r["tau"], r["rho"]) for r in S.rank_coefficients(L.bm25(docs, queries, placed), ["f", "g", "h"], untied).collect()}
    assert got.keys() == want.keys()
    assert all(x is y is None or abs(x - y) < 1e-9 for k in want for x, y in zip(got[k], want[k], strict=True))


def test_edited_scores_are_rounded_as_sql_rounds_them(spark):
    """1.5 times a score of six digits ends in a 5 at the seventh: the decimal text of the double and its product with 10^6 differ."""
    import duckdb

    from lodestone.plans import retrieval as P

    values = [i / 1e6 for i in range(1_000_001, 1_040_000, 2)]
    con = duckdb.connect()
    want = [r[0] for r in con.execute("SELECT round(x * 1.5::DOUBLE, 6) FROM (SELECT unnest($1::DOUBLE[]) AS x)", [values]).fetchall()]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert [r[0] for r in df.select(P.as_sql_rounds(F.col("x") * 1.5)).collect()] == want
    assert [r[0] for r in df.select(F.round(F.col("x") * 1.5, 6)).collect()] != want


def test_inversions_against_pairs():
    import random

    rng = random.Random(7)
    for n in (0, 1, 2, 17, 90):
        for top in (3, 1000):
            y, w, x = ([rng.randrange(1, m + 1) for _ in range(n)] for m in (top, 5, 6))
            before = [(i, j) for i in range(n) for j in range(i + 1, n)]
            assert S.inversions(y) == sum(y[i] > y[j] for i, j in before)
            assert S.inversions(y, w) == sum(w[i] * w[j] for i, j in before if y[i] > y[j])
            assert not n or S.concord_between(x, y, w) == sum(w[i] * w[j] * sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in before)


def test_products_where_documents_are_equal_those_of_joins(spark, monkeypatch):
    """Few queries' vectors at a time, and documents of one to six vectors."""
    import random

    from lodestone.operators import local as L

    rng = random.Random(8)
    rows = [(i, i // 6 if i < 40 else i, [float(rng.randrange(-9, 10)) / 8 for _ in range(5)]) for i in range(60)]
    v = spark.createDataFrame(rows, "at long, doc_id long, v array<float>").repartition(3, "at")
    queries = spark.createDataFrame([(i // 2, i, rows[i * 4][2]) for i in range(12)], "query_id long, pos long, v array<float>")
    met = v.join(queries.select("query_id", "pos", F.col("v").alias("qv"))).select(F.col("pos").alias("query_id"), "doc_id", F.col("at").alias("chunk"), R.dot(F.col("v"), F.col("qv")).alias("s"))
    near = lambda df: sorted((r[0], r[1], round(r[2], 5)) for r in df.collect())
    monkeypatch.setattr(L, "QUERIES", 3)
    monkeypatch.setattr(L, "HELD", 7)
    assert near(L.maxsim(v, queries.select("query_id", "v"))) == near(R.maxsim(v, queries))
    single = queries.select(F.col("pos").alias("query_id"), "v")
    assert near(L.chunk_aggregate(v, single)) == near(R.chunk_aggregate(met))
    docs = v.select(F.col("at").alias("doc_id"), "v")
    assert near(L.inner(docs, single).pairs()) == near(R.dense(docs, single))
    assert L.inner(docs.union(spark.createDataFrame([(99, None)], "doc_id long, v array<float>")), single) is None


def test_keywords_stay_where_documents_are(spark):
    from lodestone.operators import features as X

    docs = spark.createDataFrame([(0, "Dog cat dog bird cat fish fox owl"), (1, None), (2, "the a of"), (3, "one")], "doc_id long, text string")
    found = X.keywords(docs)
    assert {r["doc_id"]: (r["keyword_density"], r["keywords"]) for r in found.collect()} == {0: (0.875, "dog cat bird fish fox"), 1: (0.0, ""), 2: (0.0, ""), 3: (1.0, "one")}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_cosines_that_end_in_a_five_round_as_sql(spark):
    """63 / 128 = 0.4921875, which products of vectors scaled before fall short of or not."""
    from lodestone.operators import local as L

    docs = spark.createDataFrame([(0, [8.0, 0.0, 0.0, 0.0]), (1, [0.0] * 4)], "doc_id long, v array<double>")
    queries = spark.createDataFrame([(0, [63.0, 111.0, 9.0, 3.0 * math.sqrt(3.0)])], "query_id long, v array<double>")
    v = [63.0, 111.0, 9.0, 3.0 * math.sqrt(3.0)]
    want = {0: math.floor(8 * 63.0 / (8.0 * math.sqrt(sum(x * x for x in v))) * 1e6 + 0.5) / 1e6, 1: 0.0}
    assert {r["doc_id"]: r["doc_score"] for r in L.cosines(docs, queries).pairs().collect()} == want
