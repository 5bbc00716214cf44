"""URL filters: host and path rules, and a logistic regression on hashed character n-grams. DataFrame functions only.

A rule fits its host and all subdomains where the path starts with the rule's; of rules that fit the longest wins. Urls that
no rule fits are judged by a logistic regression (Spark ML) on hashed character n-grams of host and path, fitted to a small
table of labelled urls. Null urls and those without ``://`` have an empty host and path and are judged by the regression as
such. Repeated rows are judged alike, further columns stay but for those named like a result, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path)
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
GRAMS, BUCKETS = (3, 4, 5), 1 << 14
# Labelled hosts: words that unwanted sites carry in their names, and ordinary ones.
UNWANTED = "casino-win free-bets cheap-pills adult-x ads-track spam-farm poker-bonus best-casino bets-online pills-shop viagra-cheap xxx-video adult-cam ad-click track-pixel ads-server spam-mail link-farm free-prize win-money loan-fast payday-loan click-bait adserver porn-tube lottery-win crypto-double betting-odds slot-jackpot replica-watch".split()
ORDINARY = "library museum university news weather garden kitchen history science physics math journal city school travel music archive forum health hospital census maps river mountain theatre cinema poetry novels grammar atlas bakery farmhouse orchestra gallery parish council railway harbour island valley meadow fishing chess recipes climbing".split()
PATHS = ("/en/{}", "/fr/{}.html", "/de/{}/", "/es/{}", "/{}/index.html", "/article-{}", "")
TOPS = ("example.com", "example.net", "example.org", "net", "com")
PREFIXES = ("", "www.", "m.", "blog.")


def labelled_urls() -> list[tuple[str, str, float]]:
    """(host, path, label 1: block): the small table the regression is fitted to."""
    rows = []
    for label, words in ((1.0, UNWANTED), (0.0, ORDINARY)):
        for i, w in enumerate(words):
            for j in range(8):
                n = 17 * i + 5 * j
                rows.append((f"{PREFIXES[n % 4]}{w}.{TOPS[n % 5]}", PATHS[n % 7].format(n * 37 % 9973), label))
    return rows


def host_path(url: Column) -> tuple[Column, Column]:
    """After the first :// up to / ? # or the end, A-Z lower-cased; then up to ? # or the end."""
    pattern = r"(?s)^.*?://([^/?#]*+)([^?#]*+)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), UPPER, LOWER), part(2)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))

    def of_size(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))

    return F.flatten(F.array(*map(of_size, GRAMS)))


def fitted(spark: SparkSession):
    values = ", ".join(f"('{h}', '{p}', {y}D)" for h, p, y in labelled_urls())
    rows = spark.sql(f"SELECT * FROM VALUES {values} AS t(h, p, label)").coalesce(1).withColumn("_grams", grams(F.col("h"), F.col("p")))
    return LogisticRegression(featuresCol="_x", labelCol="label", maxIter=40, regParam=0.002).fit(hashed(rows))


def hashed(df: DataFrame) -> DataFrame:
    return HashingTF(inputCol="_grams", outputCol="_x", numFeatures=BUCKETS, binary=True).transform(df)


def judge(df: DataFrame, url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """df with host, path, rule, verdict and p_block, the regression's probability of block."""
    model = fitted(df.sparkSession)
    new = ("host", "path", "rule", "verdict", "p_block", "_grams", "_x", "_raw", "_p", "_y")
    host, path = host_path(F.col(url).cast("string"))
    out = df.drop(*(c for c in new if c != url)).withColumn("_host", host).withColumn("_path", path)
    rule, verdict = longest_rule(F.col("_host"), F.col("_path"), rules)
    out = hashed(out.withColumn("rule", rule).withColumn("_verdict", verdict).withColumn("_grams", grams(F.col("_host"), F.col("_path"))))
    out = model.setRawPredictionCol("_raw").setProbabilityCol("_p").setPredictionCol("_y").transform(out)
    # The sigmoid of the raw score, as the probability vector holds it.
    from pyspark.ml.functions import vector_to_array

    out = out.withColumn("p_block", vector_to_array("_p")[1])
    judged = F.coalesce("_verdict", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    keep = [c for c in df.columns if c not in new or c == url]
    return out.select(*keep, F.col("_host").alias("host"), F.col("_path").alias("path"), "rule", judged.alias("verdict"), "p_block")
