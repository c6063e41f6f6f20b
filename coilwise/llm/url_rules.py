"""URL filters: listed rules first, then association rules that FP-growth mines from labelled urls.

A url becomes a set of tokens (host labels, path segments with digits folded, query keys, extension).
Urls with a known verdict are the labels: FP-growth finds token combinations that occur with a verdict in
SUPPORT of the labelled urls; combinations whose share of that verdict is CONFIDENCE or more become rules.
A rule matches a url that has all its tokens: tokens meet an inverted index of the rules, and a rule is
hit when as many tokens met it as it has. The most confident hit decides, then the best supported.

Only distinct token sets, cut to the tokens that rules use, meet the index; pages join its verdicts.
Rules are few by nature: each itemset holds in SUPPORT of the labelled urls. They are broadcast up to
BROADCAST index rows, which is checked.

Defined cases: a null url or one without ``://`` has empty host and path, no tokens and no rule; a url
that no rule fits is allowed; repeated rows are judged each; without labelled urls no rules are mined; an
empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .registry import llm_query
from .shared import stored

SUPPORT = 0.005
CONFIDENCE = 0.9
BROADCAST = 200_000
#: Listed rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    """Host in lower case (A-Z only) and path; both empty where there is no ``://``."""
    place = F.instr(url, "://")
    rest = F.when(place > 0, F.substr(F.col(url), place + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed_rule(rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """(rule, verdict) of the longest listed rule that fits ``host`` and ``path``, else null."""
    picks = []
    for host, path, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        picks.append(F.when(fits, F.struct(F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.coalesce(*picks)


def tokens() -> Column:
    """Distinct tokens of a url from host, path and url."""
    fold = lambda c: F.regexp_replace(c, r"\d+", "#")
    named = lambda kind, items: F.transform(F.filter(items, lambda x: x != ""), lambda x: F.concat(F.lit(kind), fold(x)))
    query = F.regexp_extract(F.coalesce("url", F.lit("")), r"\?([^#]*)", 1)
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)
    return F.array_distinct(F.concat(
        named("h:", F.split("host", r"\.")), named("p:", F.split("path", "/")), named("q:", F.transform(F.split(query, "&"), lambda x: F.substring_index(x, "=", 1))),
        named("t:", F.array(F.substring_index("host", ".", -1))), named("e:", F.array(ending)),
    ))


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(rule_id, tokens, verdict, confidence, support) from (tokens, verdict)."""
    spark = labelled.sparkSession
    schema = "rule_id bigint, tokens array<string>, verdict string, confidence double, support double"
    sets = labelled.select(F.array_union("tokens", F.array(F.concat(F.lit("="), F.col("verdict")))).alias("items"))
    if sets.isEmpty():
        return spark.createDataFrame([], schema)
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence, numPartitions=int(spark.conf.get("spark.sql.shuffle.partitions"))).fit(sets)
    found = model.associationRules.where(F.startswith(F.element_at("consequent", 1), F.lit("=")) & ~F.exists("antecedent", lambda t: F.startswith(t, F.lit("="))) & (F.col("lift") > 1))
    name = F.sort_array("antecedent")
    return found.select(F.xxhash64(name).alias("rule_id"), name.alias("tokens"), F.substr(F.element_at("consequent", 1), F.lit(2)).alias("verdict"), "confidence", "support")


def matches(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, verdict) of every token set that a rule hits; ``sets`` has key and tokens."""
    index = rules.select("rule_id", F.size("tokens").alias("needs"), "verdict", "confidence", "support", F.explode("tokens").alias("token"))
    index = F.broadcast(index) if index.count() <= BROADCAST else index
    met = sets.select("key", F.explode("tokens").alias("token")).join(index, "token")
    hits = met.groupBy("key", "rule_id").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("needs", "verdict", "confidence", "support")]).where("n = needs")
    return hits.groupBy("key").agg(F.max_by("verdict", F.struct("confidence", "support", "needs", "rule_id")).alias("mined"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page; urls under listed rules are the labels."""
    host, path = host_and_path()
    p = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    p = p.select("*", listed_rule(rules).alias("listed"), tokens().alias("tokens"))
    labelled = p.where("listed IS NOT NULL").select("tokens", F.col("listed.verdict").alias("verdict"))
    mined, _ = stored(mine(labelled, support, confidence).coalesce(1), "rules")
    used = mined.agg(F.array_distinct(F.flatten(F.collect_set("tokens"))).alias("used"))  # one row, as bounded as the rules
    cut = p.join(F.broadcast(used)).select("page_id", "host", "path", "listed", F.array_join(F.sort_array(F.array_intersect("tokens", "used")), "\u0001").alias("key"))
    sets = cut.where("listed IS NULL AND key <> ''").select("key").distinct().select("key", F.split("key", "\u0001").alias("tokens"))
    out = cut.join(matches(sets, mined), "key", "left")
    return out.select("page_id", "host", "path", F.col("listed.rule").alias("rule"), F.coalesce(F.col("listed.verdict"), "mined", F.lit("allow")).alias("verdict"))


@llm_query("op7_url_rules")
def op7_url_rules(spark, sf_dir: str) -> DataFrame:
    """Verdict of every page's url."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
