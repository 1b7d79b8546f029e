"""URL filters: host and path rules, else logistic regression on hashed character n-grams of host and path.

All of it is DataFrame functions; the regression is Spark's own, fitted to the small labelled table below. The hashed
n-grams of a URL are counted once each.

Defined results: an empty table gives no rows; of rules of equal length the later one wins; urls of any length are read whole;
a null url, or one without "://", has an empty host and path, fits no rule and is judged by the
regression on its (empty) n-grams; rows are kept one to one, repeated ids too; only id and url are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import let, table

#: (verdict, host, path); a rule fits the host, its subdomains, and paths that begin with its path.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: N-gram sizes and number of hash buckets.
SIZES, BUCKETS = (3, 4), 512

BLOCKED = """
ads-track.example.org/en/1 m.ads-track.example.net/de/77 ads.example.org/banner/3 track.example.org/pixel/9
adserver.example.net/click/12 click-track.example.org/r/8 pixel.example.net/t/5 popads.example.org/en/4
casino-win.example.org/en/21 m.casino.example.net/de/8 bet-casino.example.org/play/1 slots-win.example.net/spin
poker-bonus.example.org/en/5 jackpot.example.net/bonus/2 xxx-cams.example.org/en/17 adult-xxx.example.net/video/6
porn-tube.example.org/v/5 sex-chat.example.net/room/2 adult-dating.example.org/join cheap-pills.example.net/viagra
viagra-shop.example.org/buy free-download-crack.example.net/keygen warez.example.org/crack/11 torrent-crack.example.net/iso/4
malware-drop.example.org/exe/1 phish-login.example.net/verify account-verify.example.org/secure/login free-money.example.net/win
spam-mail.example.org/en/9 spammy.example.net/offer/3 clickbait.example.org/offer/7 loan-fast.example.net/payday
replica-watches.example.org/sale miracle-diet.example.net/pills hack-tool.example.org/download crypto-double.example.net/giveaway
"""
ALLOWED = """
tionsh.example.org/en/3483 m.ththin.example.org/de/16958 blog.ththre.example.org/en/40133 therwh.example.net/fr/14706
news.example.org/en/2021/5 library.example.net/catalog/8 museum.example.org/exhibits/2 school.example.net/en/courses
blog.garden.example.org/en/12 recipes.example.net/de/brot docs.example.org/guide/install wiki.example.net/en/history
weather.example.org/today m.stories.example.net/en/9 research.example.org/papers/44 university.example.net/physics
photo.example.org/album/6 travel.example.net/en/rome music.example.org/scores/bach forum.example.net/thread/812
health.example.org/en/sleep cityhall.example.net/de/amt open.example.org/data/7 maps.example.net/en/lakes
theatre.example.org/season/3 books.example.net/novels/19 science.example.org/en/stars blog.code.example.net/en/2
m.thther.example.org/en/22783 ndorea.example.net/de/1430 ingerea.example.org/fr/31224 hevoon.example.net/en/2791
kids.example.org/stories garden.example.net/plants/9 archive.example.org/letters/4 radio.example.net/en/live
"""


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z in lower case, and path of a url."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(word)).otherwise(verdict)
    return name, verdict


def buckets(host: Column, path: Column) -> Column:
    """The distinct hash buckets of the character n-grams of host and path."""
    text = F.concat(F.lit("^"), host, F.regexp_replace(path, "[0-9]+", "0"), F.lit("$"))

    def of(chars: Column) -> Column:
        def grams(n: int) -> Column:
            gram = lambda i: F.concat_ws("", *[F.get(chars, i + k) for k in range(n)])
            last = F.greatest(F.size(chars) - n, F.lit(0))
            return F.transform(F.sequence(F.lit(0), last), lambda i: F.pmod(F.xxhash64(gram(i)), F.lit(BUCKETS)).cast("int"))

        return F.array_distinct(F.concat(*[grams(n) for n in SIZES]))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), of)


def fit(spark: SparkSession) -> tuple[float, list[float]]:
    """Intercept and weights of the buckets, from the labelled table."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import Vectors

    rows = [("http://" + u, label) for text, label in ((BLOCKED, 1.0), (ALLOWED, 0.0)) for u in text.split()]
    host, path = host_path(F.col("url"))
    hashed = spark.createDataFrame(rows, "url string, label double").select("label", buckets(host, path).alias("b")).collect()  # the fixed table's few rows
    given = spark.createDataFrame([(r["label"], Vectors.sparse(BUCKETS, sorted(r["b"]), [1.0] * len(r["b"]))) for r in hashed], ["label", "features"])
    model = LogisticRegression(regParam=0.02, standardization=False, maxIter=60).fit(given.coalesce(1))
    return float(model.intercept), [float(x) for x in model.coefficients.toArray()]


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """Per row: id, host, path, rule, verdict, and the regression's probability that the url is to be blocked."""
    intercept, weights = fit(pages.sparkSession)
    literal = F.expr("array(" + ",".join(f"{w!r}D" for w in weights) + ")")
    host, path = host_path(F.col("url"))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    score = F.aggregate(buckets(F.col("host"), F.col("path")), F.lit(intercept), lambda s, b: s + F.get(literal, b))
    rows = rows.select("*", name.alias("rule"), verdict.alias("said"), (1 / (1 + F.exp(-score))).alias("block_score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("block_score") >= threshold, "block").otherwise("allow")).alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages", "page_id", "url"))
