"""URL filters by association rules.

A url is a basket of tokens: its scheme, host labels, path words, file ending,
query keys and whether it has a fragment; digits are masked.  Spark's FP-growth
mines the labelled urls together with their label for frequent combinations.
Rules that lead to the label "block" are kept when confident and frequent enough
and more often right than the labels are "block" at all, whatever their length or
number, and when no shorter such rule lies within them.  Tokens that are a rule by
themselves are found by counting and take no part in the mining, as every longer
rule with them holds a shorter one.
Rules are matched by an inverted index: each is filed under its rarest token
among the rules, joined with the urls that have it, and holds when they have all
its tokens.

Hand-written rules (host suffix, path prefix) come first; the longest that fits
decides.  Everything is DataFrame operations.

Cases: a null url or one without ``://`` has an empty host and path, no tokens and is
allowed; without labels nothing is mined; repeated rows of a page_id are judged
one by one; a long url has more tokens but is one basket; of several rules the most
confident is named, of tied ones the last by its name; other columns are ignored,
whatever their names.  The pages must be a table read from files, so that
its rows come in the same order each time they are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomframe.llm.common import fresh
from loomframe.session import durable

#: Least share and number of labelled urls under a rule with its label, least confidence.
MIN_SUPPORT, MIN_URLS, MIN_CONFIDENCE = 0.002, 5, 0.6
#: Rules with up to so many tokens in all are broadcast; more are dealt out by their token.
BROADCAST_TOKENS = 100_000

# The filter list (verdict, host suffix, path prefix).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("block", "net", "/de/"),
    ("allow", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(rest(url), "^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def tokens(url: Column) -> Column:
    """Distinct tokens of the url, in no order; none without ``://``."""
    h, p, r = host(url), path(url), rest(url)
    masked = lambda c: F.regexp_replace(F.translate(c, _UPPER, _LOWER), "[0-9]+", "9")
    words = lambda prefix, c, by: F.transform(F.filter(F.split(c, by), lambda x: x != ""), lambda x: F.concat(F.lit(prefix), x))
    query = F.regexp_extract(r, "[?]([^#]*)", 1)
    found = F.concat(
        F.array(F.concat(F.lit("s:"), F.translate(F.substring_index(url, "://", 1), _UPPER, _LOWER))),
        words("h:", masked(h), "[.]"),
        words("p:", masked(F.regexp_replace(p, "[.][^./]*$", "")), "/"),
        F.when(F.regexp_extract(p, "([.][^./]*)$", 1) != "", F.array(F.concat(F.lit("e:"), masked(F.regexp_extract(p, "([.][^./]*)$", 1))))).otherwise(F.array().cast("array<string>")),
        words("q:", masked(F.regexp_replace(query, "=[^&]*", "")), "&"),
        F.when(F.instr(r, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>")),
    )
    return F.coalesce(F.array_distinct(found), F.array().cast("array<string>"))


def filed(rules: DataFrame) -> DataFrame:
    """Each rule under ``token``, the rarest of its tokens among the rules."""
    each = rules.select("rule_id", F.explode("antecedent").alias("token"))
    often = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(often, "token").groupBy("rule_id").agg(F.min(F.struct("n", "token")).alias("key"))
    return rules.join(rarest.select("rule_id", F.col("key.token").alias("token")), "rule_id")


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS) -> DataFrame:
    """Rules (rule_id, antecedent, confidence, support) that lead to the label, none of which holds a shorter one."""
    spark = labelled.sparkSession
    mark = "label=block"
    rows = labelled.where("url is not null and blocked is not null").withColumn("items", tokens(F.col("url"))).where(F.size("items") > 0)
    rows = durable(rows.select("blocked", "items"), "url-baskets")
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("hit")).first()
    n, rate = total["n"], total["hit"] / max(total["n"], 1)
    if not total["hit"]:
        return spark.createDataFrame([], "rule_id string, antecedent array<string>, confidence double, support double")
    least = max(min_support, min_urls / n)
    each = rows.select("blocked", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("blocked").alias("hit"))
    sure = (F.col("hit") >= F.ceil(F.lit(least) * n - 1e-9)) & (F.col("hit") / F.col("n") >= min_confidence) & (F.col("hit") / F.col("n") > rate)
    single = durable(each.where(sure).select("token", (F.col("hit") / F.col("n")).alias("confidence"), (F.col("hit") / n).alias("support")), "url-tokens")
    # baskets without the tokens that are rules, dealt out by number as equal baskets are many
    numbered = durable(rows.withColumn("basket", F.monotonically_increasing_id()), "url-numbered")
    left = numbered.select("basket", "blocked", F.explode("items").alias("token")).join(single.select("token"), "token", "left_anti")
    left = left.groupBy("basket", "blocked").agg(F.collect_list("token").alias("items"))  # a url's tokens
    baskets = left.select(F.when(F.col("blocked"), F.array_append("items", F.lit(mark))).otherwise(F.col("items")).alias("items"))
    ones = single.select(F.col("token").alias("rule_id"), F.array("token").alias("antecedent"), "confidence", "support")
    # baskets without open tokens are gone, so the share is of what is left
    open_baskets = left.count()
    if not open_baskets:
        return ones
    found = FPGrowth(itemsCol="items", minSupport=min(1.0, least * n / open_baskets * (1 - 1e-12)), minConfidence=min_confidence).fit(baskets).associationRules
    found = found.where((F.size("consequent") == 1) & (F.element_at("consequent", 1) == mark) & (F.col("confidence") > rate))
    found = found.select(F.array_join(F.array_sort("antecedent"), " ").alias("rule_id"), F.array_sort("antecedent").alias("antecedent"), "confidence", (F.col("support") * open_baskets / n).alias("support"))
    found = durable(found, "url-rules")
    longer = found.where(F.size("antecedent") > 2).select("rule_id", "antecedent", F.explode("antecedent").alias("token"))
    shorter = filed(found).select("token", F.col("antecedent").alias("within"))
    inside = (F.size("within") < F.size("antecedent")) & (F.size(F.array_except("within", "antecedent")) == 0)
    kept = found.join(longer.join(shorter, "token").where(inside).select("rule_id").distinct(), "rule_id", "left_anti")
    return ones.unionByName(kept.select(*ones.columns))


def listed(h: Column, p: Column, rules: tuple = RULES) -> Column:
    """Struct (rule, verdict) of the longest listed rule that fits, or null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, suffix, prefix in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((h == suffix) | h.endswith("." + suffix)) & p.startswith(prefix)
        out = F.when(fits, F.struct(F.lit(suffix + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def judge(pages: DataFrame, mined: DataFrame, rules: tuple = RULES, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, host, path, rule, verdict and the matched mined rule of every page.

    The index of the mined rules is broadcast if they have up to
    ``broadcast_tokens`` tokens in all; else both sides are dealt out by token.
    """
    row = fresh(pages, "row_id")
    url = F.col("url").cast("string")
    base = pages.select(F.monotonically_increasing_id().alias(row), F.col("page_id").cast("long").alias("page_id"), url.alias("url"))
    index = durable(filed(mined).select("token", "rule_id", "antecedent", "confidence"), "url-index")
    total = index.agg(F.sum(F.size("antecedent")).alias("n")).first()["n"] or 0
    index = F.broadcast(index) if total <= broadcast_tokens else index.hint("shuffle_hash")
    open_ = base.select(row, tokens(F.col("url")).alias("tokens")).select(row, "tokens", F.explode("tokens").alias("token"))
    hits = open_.join(index, "token").where(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = hits.groupBy(row).agg(F.max(F.struct("confidence", "rule_id")).alias("best"))
    judged = base.join(best, row, "left").withColumn("host", host(F.col("url"))).withColumn("path", path(F.col("url")))
    judged = judged.withColumn("listed", listed(F.col("host"), F.col("path"), rules))
    verdict = F.coalesce(F.col("listed.verdict"), F.when(F.col("best").isNotNull(), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), verdict.alias("verdict"), F.col("best.rule_id").alias("mined_rule"))
