"""Statistics queries: how features go with rank, how scorers agree."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestone.operators import features as X
from lodestone.operators import local as L
from lodestone.operators import stats as S
from lodestone.operators.steps import step
from lodestone.plans import retrieval as R
from lodestone.plans.features import NUMBERS, surface_sql
from lodestone.sources.tables import table

P, DEPTH, ALPHA = 0.9, 100, 0.05
DIGITS = 8
#: Added before means are rounded: a mean that ends in a 5 falls to the same side however it was summed.
NUDGE = 3e-11


def _rows(spark, sf_dir):
    return S.rank_features(R.bm25_rank(spark, sf_dir), X.surface(table(spark, sf_dir, "documents", "doc_id", "text")))


def rank_feature_join(spark, sf_dir):
    docs = R.corpus(spark, sf_dir)
    features = X.surface(docs).select("doc_id", *[F.col(n).cast("double").alias(n) for n in NUMBERS])
    scores = L.bm25(docs, R.query_set(spark, sf_dir), features)
    return _rows(spark, sf_dir) if scores is None else L.with_columns(scores)


def _coefficients(spark, sf_dir, tau: bool):
    """(query_id, feature, tau, rho), to six digits."""
    docs = R.corpus(spark, sf_dir)
    placed, untied = S.feature_places(X.surface(docs))
    scores = L.bm25(docs, R.query_set(spark, sf_dir), placed)
    if scores is None:
        rows = step(_rows(spark, sf_dir))
        rho = S.spearman(rows).withColumnRenamed("coef", "rho")
        both = rho.join(S.kendall(rows).withColumnRenamed("coef", "tau"), ["query_id", "feature"]) if tau else rho.withColumn("tau", F.lit(None).cast("double"))
    else:
        both = S.rank_coefficients(scores, list(scores.kept), untied, tau)
    return both.select("query_id", "feature", F.round("tau", 6).alias("tau"), F.round("rho", 6).alias("rho"))


def spearman_per_query(spark, sf_dir):
    return _coefficients(spark, sf_dir, False).select("query_id", "feature", F.col("rho").alias("coef"))


def kendall_per_query(spark, sf_dir):
    return _coefficients(spark, sf_dir, True).select("query_id", "feature", F.col("tau").alias("coef"))


def _rounded(tests, digits: int = 6, nudge: float = 0.0):
    return tests.select(*[F.round(F.col(c) + nudge, digits).alias(c) if kind == "double" else F.col(c) for c, kind in tests.dtypes])


def ttest_features(spark, sf_dir):
    return _rounded(S.t_test(spearman_per_query(spark, sf_dir)), DIGITS, NUDGE)


def bh_fdr(spark, sf_dir):
    return _rounded(S.benjamini_hochberg(S.t_test(spearman_per_query(spark, sf_dir)), alpha=ALPHA), DIGITS, NUDGE)


def tau_rho_agreement(spark, sf_dir):
    both = step(_coefficients(spark, sf_dir, True))
    tau, rho = (both.select("query_id", "feature", F.col(c).alias("coef")) for c in ("tau", "rho"))
    return _rounded(S.agreement(tau, rho), DIGITS, NUDGE)


def _rankings(spark, sf_dir):
    """The first DEPTH of each model; no ranking goes deeper."""
    queries = R.query_set(spark, sf_dir)
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("n_chars"), "doc_id"))  # DEPTH rows
    longest = table(spark, sf_dir, "documents", "doc_id", "n_chars").orderBy(F.desc_nulls_last("n_chars"), "doc_id").limit(DEPTH).select("doc_id", place.cast("long").alias("doc_rank"))
    parts = {"bm25": R.bm25_top(spark, sf_dir, DEPTH), "tfidf": R.tfidf_top(spark, sf_dir, DEPTH), "length": queries.select("query_id").join(F.broadcast(longest))}
    out = None
    for model, ranking in parts.items():
        part = ranking.select(F.lit(model).alias("model"), "query_id", "doc_id", "doc_rank")
        out = part if out is None else out.unionByName(part)
    return step(out)


def rbo_curve(spark, sf_dir):
    return _rounded(S.rbo_bands(S.rbo_curves(_rankings(spark, sf_dir), P, DEPTH)), DIGITS, NUDGE)


def rbo_pairs(spark, sf_dir):
    return _rounded(S.rbo_summary(S.rbo_curves(_rankings(spark, sf_dir), P, DEPTH)), DIGITS, NUDGE)


def rbo_matrix(spark, sf_dir):
    return _rounded(S.rbo_matrix(S.rbo_summary(S.rbo_curves(_rankings(spark, sf_dir), P, DEPTH)), ["bm25", "tfidf", "length"]), DIGITS, NUDGE)


def coefficients_wide(spark, sf_dir):
    return S.wide(spearman_per_query(spark, sf_dir), sorted(NUMBERS))


def coefficients_long(spark, sf_dir):
    return S.long(coefficients_wide(spark, sf_dir))


def significance_models(spark, sf_dir):
    """Tests of each model's coefficients, and how many are significant."""
    rho = step(spearman_per_query(spark, sf_dir))
    both = rho.select(F.lit("all").alias("model"), "feature", "coef").unionByName(rho.filter("query_id % 2 = 0").select(F.lit("even").alias("model"), "feature", "coef"))
    tests = S.benjamini_hochberg(S.t_test(both, ("model", "feature")), ("model",), ALPHA)
    return S.significant_counts(tests)


def tau_rho_line(spark, sf_dir):
    return _rounded(S.greiner(_coefficients(spark, sf_dir, True)), DIGITS, NUDGE)


QUERIES = {f.__name__: f for f in (rank_feature_join, spearman_per_query, kendall_per_query, ttest_features, bh_fdr, tau_rho_agreement, rbo_curve, rbo_pairs, rbo_matrix, coefficients_wide, coefficients_long, significance_models, tau_rho_line)}

LONG = f"""{R.BM25}, feats AS ({surface_sql("(SELECT doc_id, coalesce(text, '') AS text FROM documents)")}),
long AS (UNPIVOT (SELECT doc_id, {", ".join(f"{n}::DOUBLE AS {n}" for n in NUMBERS)} FROM feats) ON {", ".join(NUMBERS)} INTO NAME feature VALUE value),
cells AS MATERIALIZED (SELECT query_id, doc_id, doc_rank, feature, value FROM bm_rank JOIN long USING (doc_id))"""


def nudged(x: str) -> str:
    return f"round(({x}) + {NUDGE!r}::DOUBLE, {DIGITS})"


def corr(x: str, y: str) -> str:
    return f"covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0)"


def mean_rank(x: str, by: str) -> str:
    part = f"PARTITION BY {by}, " if by else "PARTITION BY "
    over = f"PARTITION BY {by} " if by else ""
    return f"(rank() OVER ({over}ORDER BY {x}) + (count(*) OVER ({part}{x}) - 1) / 2.0::DOUBLE)"


RHO = f"""{LONG}, rk AS (SELECT query_id, feature, {mean_rank("value", "query_id, feature")} AS x, {mean_rank("doc_rank", "query_id, feature")} AS y FROM cells),
rho AS MATERIALIZED (SELECT query_id, feature, round({corr("x", "y")}, 6) AS coef FROM rk GROUP BY ALL)"""
TAU = """pr AS (SELECT a.query_id, a.feature, sum(sign(a.value - b.value) * sign(a.doc_rank - b.doc_rank)) AS s, sum(abs(sign(a.value - b.value))) AS nx, sum(abs(sign(a.doc_rank - b.doc_rank))) AS ny
    FROM cells a JOIN cells b ON a.query_id = b.query_id AND a.feature = b.feature AND a.doc_id < b.doc_id GROUP BY ALL),
tau AS MATERIALIZED (SELECT query_id, feature, round(s / nullif(sqrt(nx::DOUBLE * ny), 0), 6) AS coef FROM pr)"""


def t_series(given: str, by: str) -> str:
    """CTEs down to tests: given's columns and the two-sided p_value of its t with n - 1 degrees of freedom, by the finite series."""
    return f"""angles AS (SELECT *, n - 1 AS df, atan(abs(t) / sqrt(n - 1)) AS th FROM {given}),
terms AS (SELECT {by}, product(CASE WHEN k = 0 THEN CASE WHEN df % 2 = 1 THEN cos(th) ELSE 1 END WHEN df % 2 = 1 THEN 2::DOUBLE * k / (2 * k + 1) * cos(th) ** 2 ELSE (2::DOUBLE * k - 1) / (2 * k) * cos(th) ** 2 END) OVER (PARTITION BY {by} ORDER BY k) AS term
    FROM (SELECT *, unnest(range(0, df // 2)) AS k FROM angles)),
totals AS (SELECT {by}, sum(term) AS total FROM terms GROUP BY ALL),
tests AS (SELECT angles.*, greatest(CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (th + sin(th) * coalesce(total, 0)) ELSE 1 - sin(th) * total END, 0) AS p_value FROM angles LEFT JOIN totals USING ({by}))"""


TESTS = f"""{RHO}, t0 AS (SELECT feature, count(coef) AS n, avg(coef) AS mean, stddev_samp(coef) AS std FROM rho GROUP BY feature),
t1 AS (SELECT *, std / sqrt(n) AS se, mean / nullif(std / sqrt(n), 0) AS t FROM t0), {t_series("t1", "feature")}"""
ROUNDED = "feature, n, " + ", ".join(f"{nudged(c)} AS {c}" for c in ("mean", "std", "se", "t", "p_value"))
RBO = f"""{R.BM25}, {R.TFIDF},
ln AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY n_chars DESC, doc_id) AS doc_rank FROM qs CROSS JOIN documents),
rks AS (SELECT 'bm25' AS model, query_id, doc_id, doc_rank FROM bm_rank WHERE doc_rank <= {DEPTH} UNION ALL SELECT 'tfidf', query_id, doc_id, doc_rank FROM ti_rank WHERE doc_rank <= {DEPTH} UNION ALL SELECT 'length', query_id, doc_id, doc_rank FROM ln WHERE doc_rank <= {DEPTH}),
ks AS (SELECT model, query_id, count(*) AS k FROM rks GROUP BY ALL),
grid AS (SELECT x.model AS a, y.model AS b, x.query_id, unnest(range(1, least(x.k, y.k) + 1)) AS depth FROM ks x JOIN ks y ON x.query_id = y.query_id AND x.model < y.model),
met AS (SELECT x.model AS a, y.model AS b, x.query_id, greatest(x.doc_rank, y.doc_rank) AS depth, count(*) AS n FROM rks x JOIN rks y ON x.query_id = y.query_id AND x.doc_id = y.doc_id AND x.model < y.model GROUP BY ALL),
ov AS (SELECT a, b, query_id, depth, sum(coalesce(n, 0)) OVER (PARTITION BY a, b, query_id ORDER BY depth) AS x FROM grid LEFT JOIN met USING (a, b, query_id, depth)),
tm AS (SELECT *, x / depth * 0.9::DOUBLE ** depth AS term FROM ov),
curves AS (SELECT a, b, query_id, depth, term + 0.1::DOUBLE / 0.9::DOUBLE * sum(term) OVER (PARTITION BY a, b, query_id ORDER BY depth) AS rbo FROM tm),
summary AS (SELECT a, b, avg(r) AS mean, coalesce(stddev_samp(r), 0) AS std, min(r) AS min, max(r) AS max, count(*) AS n_queries FROM (SELECT a, b, query_id, arg_max(rbo, depth) AS r FROM curves GROUP BY ALL) GROUP BY a, b)"""
_CELL = "(SELECT mean FROM summary WHERE (a = '{0}' AND b = '{1}') OR (a = '{1}' AND b = '{0}'))"
_MODELS = ("bm25", "length", "tfidf")
ORACLE_SQL = {
    "rank_feature_join": f"WITH {LONG} SELECT query_id, doc_id, doc_rank, feature, value FROM cells",
    "spearman_per_query": f"WITH {RHO} SELECT query_id, feature, coef FROM rho",
    "kendall_per_query": f"WITH {LONG}, {TAU} SELECT query_id, feature, coef FROM tau",
    "ttest_features": f"WITH {TESTS} SELECT {ROUNDED} FROM tests",
    "bh_fdr": f"""WITH {TESTS}, b0 AS (SELECT *, row_number() OVER (ORDER BY p_value, feature) AS i, count(*) OVER () AS m FROM tests),
b1 AS (SELECT *, least(min(p_value * m / i) OVER (ORDER BY i DESC), 1) AS pc FROM b0) SELECT {ROUNDED}, {nudged("pc")} AS p_corrected, pc <= {ALPHA} AS significant FROM b1""",
    "coefficients_wide": f"WITH {RHO} SELECT query_id, " + ", ".join(f"max(coef) FILTER (WHERE feature = '{n}') AS {n}" for n in sorted(NUMBERS)) + " FROM rho GROUP BY query_id",
    "coefficients_long": f"WITH {RHO} SELECT query_id, feature, coef FROM rho",
    "significance_models": f"""WITH {RHO}, m AS (SELECT 'all' AS model, feature, coef FROM rho UNION ALL SELECT 'even', feature, coef FROM rho WHERE query_id % 2 = 0),
t0 AS (SELECT model, feature, count(coef) AS n, avg(coef) AS mean, stddev_samp(coef) AS sd FROM m GROUP BY model, feature), t1 AS (SELECT *, mean / nullif(sd / sqrt(n), 0) AS t FROM t0), {t_series("t1", "model, feature")}, t2 AS (SELECT model, feature, CASE WHEN n >= 3 THEN p_value END AS p FROM tests),
t3 AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY p, feature) AS i, count(p) OVER (PARTITION BY model) AS k FROM t2), t4 AS (SELECT *, min(p * k / i) OVER (PARTITION BY model ORDER BY i DESC) AS pc FROM t3)
SELECT model, count(*) AS n_features, count(p) AS n_tested, count(*) FILTER (WHERE pc <= {ALPHA}) AS n_significant FROM t4 GROUP BY model""",
    "tau_rho_line": f"""WITH {RHO}, {TAU}, z AS (SELECT query_id, feature, tau.coef AS tau, rho.coef AS rho, least(greatest(1.5::DOUBLE * tau.coef, -1), 1) AS line FROM tau JOIN rho USING (query_id, feature))
SELECT query_id, feature, {nudged("tau")} AS tau, {nudged("rho")} AS rho, {nudged("line")} AS reference, {nudged("rho - line")} AS off FROM z""",
    "tau_rho_agreement": f"""WITH {RHO}, {TAU}, ag AS (SELECT tau.coef AS x, rho.coef AS y FROM tau JOIN rho USING (query_id, feature) WHERE tau.coef IS NOT NULL AND rho.coef IS NOT NULL),
ar AS (SELECT *, {mean_rank("x", "")} AS rx, {mean_rank("y", "")} AS ry FROM ag)
SELECT count(*) AS n_cells, {nudged(corr("x", "y"))} AS pearson_r, {nudged(corr("rx", "ry"))} AS spearman_rho, {nudged("avg(y - x)")} AS mean_signed_diff, {nudged("avg(abs(y - x))")} AS mean_abs_diff,
{nudged("avg(CASE WHEN abs(x) > 1e-9 AND abs(y) > 1e-9 THEN CASE WHEN sign(x) = sign(y) THEN 1.0 ELSE 0.0 END END)")} AS sign_agreement FROM ar""",
    "rbo_curve": f"""WITH {RBO}, c AS (SELECT a, b, depth, avg(rbo) AS mean, coalesce(stddev_samp(rbo), 0) AS sd FROM curves GROUP BY a, b, depth)
SELECT a, b, depth, {nudged("mean")} AS mean, {nudged("greatest(mean - sd, 0)")} AS low, {nudged("least(mean + sd, 1)")} AS high FROM c""",
    "rbo_pairs": f"WITH {RBO} SELECT a, b, {nudged("mean")} AS mean, {nudged("std")} AS std, {nudged("min")} AS min, {nudged("max")} AS max, n_queries FROM summary",
    "rbo_matrix": f"WITH {RBO} " + " UNION ALL ".join(f"SELECT '{m}' AS model, " + ", ".join(f"{nudged('1.0::DOUBLE' if m == o else _CELL.format(m, o))} AS {o}" for o in _MODELS) for m in _MODELS),
}
