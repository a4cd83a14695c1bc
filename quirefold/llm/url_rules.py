"""URL filters: a rule list, and association rules over URL tokens mined by FP-growth."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirefold.llm.common import LOWER, UPPER, cut, small

#: The listed rules, as verdict, host and path.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Labelled URLs that rules are mined from, at most about so many, drawn by hash.
TRAIN_URLS = 50_000
#: A rule's share of the labelled URLs, and their number, are to be so much at least.
SUPPORT, LEAST_ROWS, CONFIDENCE = 0.002, 3, 0.9
BLOCK = "=block"


def host_of(url: Column) -> Column:
    """What is between the first :// and the next / ? # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """A struct of rule and verdict, of the longest rule whose host is the URL's or a parent and whose path begins the URL's; else null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def tokens_of(url: Column) -> Column:
    """The distinct tokens of a URL: its host's names, the host without its first name, the names of its path's folders, and its query's keys; numbers as one token."""
    host, path = host_of(url), path_of(url)
    names = lambda c, by, mark: F.transform(F.filter(F.split(F.lower(c), by), lambda x: x != ""), lambda x: F.concat(F.lit(mark), F.regexp_replace(x, "[0-9]+", "0")))
    keys = F.transform(F.regexp_extract_all(F.coalesce(url, F.lit("")), F.lit("[?&]([^=&#]+)="), F.lit(1)), lambda x: F.concat(F.lit("?"), F.lower(x)))
    return F.array_distinct(F.concat(names(host, "[.]", "."), names(path, "/", "/"), keys))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> tuple[DataFrame, DataFrame]:
    """Rules (antecedent: array of tokens, confidence, support) whose consequent is block, from labelled (url, blocked), and the table (token, stands_for) that they speak of.

    Tokens that are in the same labelled URLs are one to all rules: the first of them by name stands for all, so a URL whose many folders only come together is no
    larger to the miner than one with a single folder. Tokens in fewer URLs than a rule needs are in no rule. Neither changes which URLs are blocked.
    A rule is left out if one with part of its tokens is as sure. No labelled rows or none blocked, no rules. Null URLs and labels are passed over.
    """
    spark = labelled.sparkSession
    rows = labelled.where("url IS NOT NULL AND blocked IS NOT NULL").select(F.monotonically_increasing_id().alias("row"), "blocked", tokens_of(F.col("url")).alias("tokens"))
    rows = cut(rows)
    n = rows.count()
    least = max(LEAST_ROWS, support * n)
    each = rows.select("row", F.explode("tokens").alias("token"))
    marks = [F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(38,0)")).alias(f"h{k}") for k in (1, 2)]
    often = each.groupBy("token").agg(F.count("*").alias("n"), *marks).where(F.col("n") >= least)
    stands = cut(often.withColumn("stands_for", F.min("token").over(Window.partitionBy("n", "h1", "h2"))).select("token", "stands_for"))
    kept = each.join(small(stands), "token").groupBy("row").agg(F.collect_set("stands_for").alias("items"))
    block = F.when(F.col("blocked"), F.array(F.lit(BLOCK))).otherwise(F.array().cast("array<string>"))
    baskets = cut(rows.join(kept, "row", "left").select(F.concat(F.coalesce("items", F.array().cast("array<string>")), block).alias("items")))
    if stands.isEmpty():
        return spark.createDataFrame([], "antecedent array<string>, confidence double, support double"), stands
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / n), minConfidence=confidence).fit(baskets)
    found = model.associationRules.where(F.col("consequent")[0] == BLOCK)
    found = cut(found.select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    part = found.select(F.col("antecedent").alias("_a"), F.col("confidence").alias("_c"), F.explode("antecedent").alias("_t"))
    sure = found.select("antecedent", "confidence", F.explode("antecedent").alias("_t"))
    implied = sure.join(part, "_t").where((F.size("_a") < F.size("antecedent")) & (F.col("_c") >= F.col("confidence")) & (F.size(F.array_except("_a", "antecedent")) == 0))
    return cut(found.join(implied.select("antecedent").distinct(), "antecedent", "left_anti")), stands


def matched(urls: DataFrame, rules: DataFrame, stands: DataFrame) -> DataFrame:
    """The distinct urls (url, tokens) that hold all tokens of some rule: an inverted index lists a rule under its rarest token, and the rest is compared."""
    df = rules.select(F.explode("antecedent").alias("t"), "support").groupBy("t").agg(F.max("support").alias("often"))
    post = rules.select("antecedent", F.explode("antecedent").alias("t")).join(df, "t")
    post = post.groupBy("antecedent").agg(F.min(F.struct("often", "t"))["t"].alias("token"))
    index = small(cut(post.groupBy("token").agg(F.collect_list("antecedent").alias("rules"))))
    named = urls.select("url", F.explode("tokens").alias("token")).join(small(stands), "token").groupBy("url").agg(F.collect_set("stands_for").alias("tokens"))
    seen = named.select("url", "tokens", F.explode("tokens").alias("token")).join(index, "token")
    return seen.where(F.exists("rules", lambda r: F.size(F.array_except(r, F.col("tokens"))) == 0)).select("url").distinct()


def judge(pages: DataFrame, labels: DataFrame | None = None, train_urls: int = TRAIN_URLS) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict.

    The longest listed rule decides; where none fits, a URL that matches a mined rule is blocked and any other
    allowed. Rules are mined from a bounded sample of labels (url, blocked); where none are given, the labels are the list's verdicts on the pages that it judges.
    Null URLs and URLs without :// have an empty host and path and no rule, and are allowed
    unless their tokens match. Equal URLs are matched once, and joined back with hot URLs split.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = cut(rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"))))
    known = rows.where("listed IS NOT NULL").select("url", (F.col("listed.verdict") == "block").alias("blocked")) if labels is None else labels.select("url", "blocked")
    rate = min(1.0, train_urls / max(1, known.count()))
    # A label is drawn by its URL and its row, so that one URL of very many rows is thinned too.
    rules, stands = mine(known.where(F.pmod(F.xxhash64("url", F.monotonically_increasing_id()), F.lit(1_000_000)) < round(rate * 1_000_000)))
    urls = rows.where("listed IS NULL AND url IS NOT NULL").select("url").distinct().withColumn("tokens", tokens_of(F.col("url")))
    hit = cut(matched(urls, rules, stands).withColumnRenamed("url", "_url"))
    out = rows.join(small(hit), rows["url"] == hit["_url"], "left")
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("_url").isNotNull(), "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"))
