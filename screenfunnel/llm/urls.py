"""URL filter: rules by host and path first, then gradient-boosted trees on lexical features.

The trees (Spark ML) are trained on a bounded sample of labelled URLs. All features are column functions. Suffix statistics are
the smoothed shares of blocked URLs under the last one and two labels of the host; they come from the sample too, so they are
bounded by it, and a training URL does not count itself.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from screenfunnel.llm.common import let
from screenfunnel.session import scratch_path

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Fixed words of hosts that mark a URL as blocked in the labels that ``word_labels`` gives.
BLOCKED_WORDS = (
    "adult", "ads", "bet", "bets", "bingo", "casino", "cheap", "escort", "farm", "gambling", "jackpot", "lottery", "pharma", "pills", "poker",
    "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx",
)

NUMBERS = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "letter_ratio", "entropy", "host_entropy", "parameters", "hyphens", "longest_label")


@dataclass(frozen=True)
class Rule:
    """``text``: a host and a path, such as ``example.com/en/``; it fits the host and all its subdomains."""

    text: str
    verdict: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return self.text[len(self.host) :]


@dataclass(frozen=True)
class UrlModel:
    trees: GBTClassificationModel | None
    #: suffix, share: one row for each suffix in the sample.
    shares: DataFrame
    prior: float


@dataclass(frozen=True)
class Training:
    """sample: at most so many labelled URLs of each verdict are learned from; smoothing: URLs that the prior share counts as."""

    sample: int = 10_000
    smoothing: float = 20.0
    trees: int = 20
    depth: int = 4
    seed: int = 7


def host_and_path(url: Column) -> Column:
    """A struct: the host (after the first ``://`` up to ``/ ? #``, A-Z in lower case) and the path (then up to ``? #``)."""
    rest = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    text = F.coalesce(url, F.lit(""))
    return F.struct(
        F.translate(F.regexp_extract(text, rest, 1), UPPER, UPPER.lower()).alias("host"),
        F.regexp_extract(text, rest, 2).alias("path"),
    )


def fitting_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits (of equal ones the first by text) as a struct of text and verdict, or null."""
    out = F.lit(None).cast("struct<text:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.text), [-ord(c) for c in r.text])):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.text).alias("text"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def entropy(text: Column) -> Column:
    """Bits a character of the text's own distribution; 0 for an empty text."""

    def bits(chars: Column) -> Column:
        n = F.size(chars).cast("double")
        counts = F.aggregate(
            F.array_sort(chars),
            F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum")),
            lambda a, c: F.when(c == a["last"], F.struct(a["last"].alias("last"), (a["run"] + 1).alias("run"), a["sum"].alias("sum"))).otherwise(
                F.struct(c.alias("last"), F.lit(1.0).alias("run"), (a["sum"] + _weigh(a["run"])).alias("sum"))
            ),
            lambda a: a["sum"] + _weigh(a["run"]),
        )
        return F.when(n > 0, F.log2(n) - counts / n).otherwise(0.0)

    return let(F.filter(F.split(text, ""), lambda c: c != ""), bits)


def _weigh(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n)).otherwise(0.0)


def suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def features(df: DataFrame, url: str = "url") -> DataFrame:
    """``df`` (with host and path) plus the columns of ``NUMBERS``; a null URL counts as an empty one."""
    text, host = F.coalesce(F.col(url), F.lit("")), F.col("host")
    length = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    longest = F.array_max(F.transform(F.split(host, r"\."), F.length))
    return df.withColumns(
        {
            "url_length": F.length(text), "host_length": F.length(host), "path_length": F.length("path"),
            "depth": F.size(F.filter(F.split("path", "/"), lambda x: x != "")), "labels": F.size(F.split(host, r"\.")),
            "digit_ratio": F.length(F.regexp_replace(text, "[^0-9]+", "")) / length,
            "letter_ratio": F.length(F.regexp_replace(text, "[^A-Za-z]+", "")) / length,
            "entropy": entropy(text), "host_entropy": entropy(host),
            "parameters": F.size(F.filter(F.split(query, "&"), lambda x: x != "")),
            "hyphens": F.length(host) - F.length(F.replace(host, F.lit("-"), F.lit(""))), "longest_label": longest,
        }
    )


def word_labels(urls: DataFrame, url: str = "url", words: Sequence[str] = BLOCKED_WORDS) -> DataFrame:
    """url, blocked: weak labels of distinct URLs that have a host; blocked if a word of the host is in ``words``."""
    host = host_and_path(F.col(url))["host"]
    parts = F.split(host, r"[^a-z]+")
    labelled = urls.select(F.col(url).alias("url"), F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words])).alias("blocked"), host.alias("host"))
    return labelled.where("host <> ''").select("url", "blocked").distinct()


def train(labelled: DataFrame, training: Training = Training()) -> UrlModel:
    """A model of labelled URLs (url string, blocked boolean), from a bounded sample.

    Of each verdict, the ``sample`` distinct URLs with the smallest hash are learned from, so repeated rows take no more room than
    one. Rows with a null in either column are left out. With URLs of one verdict only, or none, the model has no trees and says
    that verdict (``allow`` without any).
    """
    spark = labelled.sparkSession
    known = labelled.select("url", F.col("blocked").cast("boolean").alias("blocked")).dropna().distinct()
    first = lambda on: known.where(on).orderBy(F.xxhash64("url"), "url").limit(training.sample)
    path = scratch_path(spark, "labelled_urls")
    sample = first(F.col("blocked")).unionByName(first(~F.col("blocked"))).select("url", F.col("blocked").cast("double").alias("blocked"), host_and_path(F.col("url")).alias("at"))
    sample.select("url", "blocked", "at.*").coalesce(2).write.parquet(path)
    rows = spark.read.parquet(path)
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("blocked"), F.lit(0.0))).first()
    prior = bad / n if n else 0.0
    counts = [rows.groupBy(suffix(F.col("host"), k).alias("suffix"), F.lit(k).alias("k")).agg(F.sum("blocked").alias("bad"), F.count(F.lit(1)).alias("n")) for k in (1, 2)]
    counts_path = scratch_path(spark, "url_suffixes")
    counts[0].unionByName(counts[1]).coalesce(1).write.parquet(counts_path)
    counted = spark.read.parquet(counts_path)
    share = (F.col("bad") + training.smoothing * prior) / (F.col("n") + training.smoothing)
    shares = counted.select("suffix", "k", share.alias("share"))
    if not 0 < bad < n:
        return UrlModel(None, shares, prior)
    for k in (1, 2):
        mine = counted.where(F.col("k") == k).select(F.col("suffix").alias("_suffix"), F.col("bad").alias("_bad"), F.col("n").alias("_n"))
        rest = (F.col("_bad") - F.col("blocked") + training.smoothing * prior) / (F.col("_n") - 1 + training.smoothing)
        rows = rows.join(F.broadcast(mine), suffix(F.col("host"), k) == F.col("_suffix")).withColumn(f"suffix_{k}", rest).drop("_suffix", "_bad", "_n")
    learner = GBTClassifier(labelCol="blocked", featuresCol="features", maxIter=training.trees, maxDepth=training.depth, maxBins=64, seed=training.seed, cacheNodeIds=False)
    return UrlModel(learner.fit(assembled(features(rows)).select("blocked", "features").coalesce(2)), shares, prior)


def assembled(df: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[*NUMBERS, "suffix_1", "suffix_2"], outputCol="features", handleInvalid="error").transform(df)


def judge(df: DataFrame, model: UrlModel, rules: Sequence[Rule] = (), url: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict and score (the model's share of trees' weight for blocking, 0 to 1).

    * host and path are empty for a null URL or one without ``://``; such a URL is judged by the model as the text it is.
    * The rule's verdict stands; without a rule, ``block`` from a score of one half. Rules are configuration, one comparison each.
    * A column of ``df`` with one of these names is replaced. Repeated rows are judged alike; an empty table stays empty.
    """
    at = host_and_path(F.col(url))
    rows = df.drop("host", "path", "rule", "verdict", "score", "probability", "features", "_own")
    own = F.struct(*[F.col(f"`{c}`") for c in rows.columns])
    # the caller's columns stay in a struct, so that none clashes with a feature
    rows = rows.select(own.alias("_own"), F.col(url).alias("_url"), at.alias("_at")).select("_own", "_url", "_at.*")
    for k in (1, 2):
        # bounded by the training sample
        mine = model.shares.where(F.col("k") == k).select(F.col("suffix").alias("_suffix"), F.col("share").alias("_share"))
        rows = rows.join(F.broadcast(mine), suffix(F.col("host"), k) == F.col("_suffix"), "left")
        rows = rows.withColumn(f"suffix_{k}", F.coalesce("_share", F.lit(model.prior))).drop("_suffix", "_share")
    if model.trees is None:
        rows = rows.withColumn("score", F.lit(model.prior))
    else:
        rows = model.trees.transform(assembled(features(rows, "_url"))).withColumn("score", vector_to_array("probability")[1])
    rule = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(F.col("_rule.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return rows.withColumn("_rule", rule).select("_own.*", "host", "path", F.col("_rule.text").alias("rule"), verdict.alias("verdict"), "score")
