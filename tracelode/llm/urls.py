"""URL verdicts: stated rules first, gradient-boosted trees on lexical features for the rest.

Everything here is DataFrame work: features are column expressions, suffix
statistics are an aggregate, the trees are pyspark.ml's.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stash

#: (verdict, host, path); a rule fits its host and all subdomains if the path starts with the rule's.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: URLs that a rule labels, taken by the order of a hash, that the trees are fitted on at most.
SAMPLE = 20_000
TREES, DEPTH = 20, 4
#: Weight of the overall share in a suffix's share of blocked URLs.
PRIOR = 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = "://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _PARTS, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _fitting(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls where none does. Rules are a short list."""
    name = verdict = F.lit(None).cast("string")
    for says, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        name = F.when(fits, rule_host + rule_path).otherwise(name)
        verdict = F.when(fits, says).otherwise(verdict)
    return name, verdict


def _entropy(text: Column) -> Column:
    """Entropy of a text's characters in bits."""
    n = F.length(text)
    part = lambda c: (n - F.length(F.replace(text, c))) / n
    return F.when(n > 0, F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda h, c: h - F.when(c != "", part(c) * F.log2(part(c))).otherwise(0.0))).otherwise(0.0)


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "entropy", "parameters", "hyphens", "fragment", "secure", "suffix_share")


def lexical(urls: DataFrame) -> DataFrame:
    """Columns of features for columns url, host and path; texts may be empty, never null."""
    url, host, path = F.col("url"), F.col("host"), F.col("path")
    share = lambda text, of: F.when(F.length(text) > 0, F.regexp_count(text, F.lit(of)) / F.length(text)).otherwise(0.0)
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.select(
        "*",
        F.length(url).cast("double").alias("length"),
        F.length(host).cast("double").alias("host_length"),
        F.length(path).cast("double").alias("path_length"),
        F.regexp_count(path, F.lit("/[^/]")).cast("double").alias("depth"),
        F.size(F.split(host, r"\.")).cast("double").alias("labels"),
        share(url, "[0-9]").alias("digits"),
        share(host, "[0-9]").alias("host_digits"),
        _entropy(url).alias("entropy"),
        F.when(query == "", 0).otherwise(F.size(F.split(query, "[&;]"))).cast("double").alias("parameters"),
        F.regexp_count(url, F.lit("[-_]")).cast("double").alias("hyphens"),
        F.contains(url, F.lit("#")).cast("double").alias("fragment"),
        F.startswith(url, F.lit("https")).cast("double").alias("secure"),
        F.substring_index(host, ".", -1).alias("suffix"),
    )


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, rule, verdict, score) for every row of pages.

    A rule's verdict stands. URLs that rules fit are the labelled ones; trees
    fitted to at most ``sample`` of them judge the others: score is the
    likelihood of block, null where a rule decides, and 0.5 or more blocks. The
    share of blocked URLs by suffix is counted over all labelled ones. If
    rules label nothing, others are allowed; if they give one verdict only,
    others get it too. A null URL or one without :// has an empty host and
    path, and is judged by what features it has. Repeated rows and null ids
    stay; an empty table gives an empty result; other columns are not looked at.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    read = pages.select(F.col(id_col).alias("id"), url.alias("url")).select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rule, verdict = _fitting(F.col("host"), F.col("path"), rules)
    ruled = read.select("*", rule.alias("rule"), verdict.alias("said"))
    rows = lexical(ruled)
    told = rows.where(F.col("said").isNotNull()).withColumn("label", (F.col("said") == "block").cast("double"))
    counts = stash(told.groupBy("suffix").agg(F.count("*").alias("n"), F.sum("label").alias("blocked")), "suffixes")
    total, blocked, suffixes = counts.agg(F.sum("n"), F.sum("blocked"), F.count("*")).first()
    out = ["id", "host", "path", "rule"]
    if not total or blocked in (0, total):
        other = F.lit("block" if total and blocked else "allow")
        return ruled.select(*out, F.coalesce("said", other).alias("verdict"), F.lit(None).cast("double").alias("score")).withColumnRenamed("id", id_col)
    base = blocked / total
    shares = counts.select("suffix", ((F.col("blocked") + PRIOR * base) / (F.col("n") + PRIOR)).alias("suffix_share"))
    if suffixes <= BROADCAST_ROWS:
        shares = F.broadcast(shares)
    labelled = stash(told.orderBy(F.xxhash64("url"), "url").limit(sample), "labelled")
    joined = lambda df: df.join(shares, "suffix", "left").fillna(base, ["suffix_share"])
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=11, labelCol="label", featuresCol="features")
    model = trees.fit(vectors.transform(joined(labelled)).select("label", "features"))
    judged = model.transform(vectors.transform(joined(rows)))
    score = F.when(F.col("said").isNull(), vector_to_array("probability")[1])
    return judged.select(*out, F.coalesce("said", F.when(score >= 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score")).withColumnRenamed("id", id_col)


def op5_urls(spark, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "score")
