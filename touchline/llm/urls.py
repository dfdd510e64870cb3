"""URL verdicts by fixed rules and mined association rules (operator 6).

Fixed rules name a host and the start of a path; the longest that fits decides. Where none does, rules mined from labels decide: labelled
pages are sets of tokens (scheme, host labels, path segments, query keys), and "label=block" where they are bad. Tokens that the same labelled
pages have are one item (the parts of a site's template, or of a single long url), told by the count and two sums of hashes of their pages:
rules with several of them can't be surer than with one, so nothing is lost, and sets of them aren't listed one by one. FP-growth finds what
goes together often enough, and rules that imply "label=block" with enough confidence stay, except those that a shorter rule makes needless.
A rule fits a url that has some token of each of its items. Rules are matched by an inverted index: each is listed under the tokens of its
rarest item only, so a page meets the few rules of its own rare tokens, and the rest of each rule is then tested against the page's tokens.

Null urls and urls without "://" have an empty host and path, fit no fixed rule and have no tokens but their lack: the mined rules can't fit, and
the verdict is allow. Labels with a null id, quality and toxicity are ignored; of several labels for a page the worst counts. Without labels
nothing is mined. One row in, one row out, repeated rows too.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import checkpointed, spread_join

#: Rules that are broadcast.
MOST_RULES = 100_000
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK, ALLOW = "block", "allow"
#: (verdict, host, path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))


@dataclass(frozen=True)
class Settings:
    min_support: float = 0.002  # of labelled pages that have a rule's tokens and its label
    min_confidence: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), UPPER, UPPER.lower())


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def fixed_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none does."""
    rule = verdict = F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda x: len(x[1] + x[2])):  # the last one that fits, the longest, wins
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Different tokens of a url; numbers are one token."""
    host, path = host_of(url), path_of(url)
    numbers = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    keys = F.regexp_extract_all(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("(^|&)([^&=]+)"), F.lit(2))
    parts = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.regexp_extract(url, "^([^:]*)://", 1))),
        F.transform(F.split(host, r"\."), lambda x: F.concat(F.lit("host:"), numbers(x))),
        F.transform(F.split(path, "/"), lambda x: F.concat(F.lit("path:"), numbers(x))),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), numbers(x))),
    )
    useful = F.filter(F.array_distinct(parts), lambda x: ~x.rlike(":$"))
    return F.when(F.coalesce(host, F.lit("")) != "", useful).otherwise(F.array().cast("array<string>"))


def mine(pages: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """u_rule (its items, each the tokens of which one is enough), u_anchors (the rarest item), u_confidence of the rules for blocking."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) > 0) | (F.coalesce(F.col("quality"), F.lit(1)) < 1)
    known = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad).alias("u_bad"))
    labelled = checkpointed(pages.select("page_id", "url", tokens_of(F.col("url")).alias("u_tokens")).join(known, "page_id").withColumn("u_row", F.monotonically_increasing_id()))
    items = checkpointed(items_of(labelled, settings))
    said = labelled.select("u_row", "u_bad", F.explode_outer("u_tokens").alias("u_token"))
    named = _met(said, items.select(F.explode("u_item").alias("u_token"), "u_name"), "u_token", "u_row")
    baskets = named.groupBy("u_row").agg(F.max("u_bad").alias("u_bad"), F.collect_set("u_name").alias("items"))
    baskets = baskets.select(F.when(F.col("u_bad"), F.array_append("items", F.lit("label=" + BLOCK))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=settings.min_support, minConfidence=settings.min_confidence).fit(baskets)
    rules = checkpointed(model.associationRules.where(F.col("consequent")[0] == "label=" + BLOCK).select(F.sort_array("antecedent").alias("u_names"), F.col("confidence").alias("u_confidence")))
    # needless: a rule one item shorter is as sure
    shorter = rules.select("u_names", "u_confidence", F.explode("u_names").alias("x")).select("u_names", "u_confidence", F.array_remove("u_names", F.col("x")).alias("part"))
    part = rules.select(F.col("u_names").alias("part"), F.col("u_confidence").alias("part_confidence"))
    needless = shorter.join(part, "part").where("part_confidence >= u_confidence").select("u_names").distinct()
    kept = rules.join(needless, "u_names", "left_anti").select("u_names", "u_confidence", F.explode("u_names").alias("u_name")).join(items, "u_name")
    return kept.groupBy("u_names", "u_confidence").agg(F.sort_array(F.collect_list("u_item")).alias("u_rule"), F.min_by("u_item", F.struct("u_freq", "u_name")).alias("u_anchors")).drop("u_names")


def items_of(labelled: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """u_name, u_item (tokens, in order), u_freq: tokens of the labelled rows that are frequent enough for a rule, those of the same rows as one item."""
    least = -(-labelled.count() * settings.min_support // 1)
    said = labelled.select(F.explode("u_tokens").alias("u_token"), F.xxhash64("page_id", "url").alias("h"), F.xxhash64(F.lit("second"), "url", "page_id").alias("k"))
    counted = said.groupBy("u_token").agg(F.count(F.lit(1)).alias("u_freq"), F.sum(F.col("h").cast("decimal(20,0)")).alias("h"), F.sum(F.col("k").cast("decimal(20,0)")).alias("k"))
    # all tokens of an item are on one page, so an item is no longer than a url
    return counted.where(F.col("u_freq") >= least).groupBy("u_freq", "h", "k").agg(F.sort_array(F.collect_list("u_token")).alias("u_item")).select(F.col("u_item")[0].alias("u_name"), "u_item", "u_freq")


def _met(rows: DataFrame, few: DataFrame, key: str, by: str) -> DataFrame:
    """rows left joined with few, which has each key once: broadcast if it has MOST_RULES rows at most, else by shuffle with frequent keys spread."""
    if few.limit(MOST_RULES + 1).count() <= MOST_RULES:
        return rows.join(F.broadcast(few), key, "left")
    return spread_join(rows, few, key, by, "left")


def judge_urls(pages: DataFrame, labels: DataFrame, settings: Settings = Settings(), rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_confidence (of the surest mined rule that fits, or null) of every row of pages(page_id, url, ...)."""
    url = F.col("url")
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), rules)
    rows = pages.select("page_id", "url", host_of(url).alias("host"), path_of(url).alias("path"), tokens_of(url).alias("u_tokens"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("u_verdict"), "u_tokens").withColumn("u_row", F.monotonically_increasing_id())
    asked = F.when(F.col("u_verdict").isNull(), F.col("u_tokens"))  # only where no fixed rule decides
    listed = checkpointed(mine(pages, labels, settings).select("u_rule", "u_confidence", F.explode("u_anchors").alias("u_anchor")))
    index = listed.groupBy("u_anchor").agg(F.collect_list(F.struct("u_rule", "u_confidence")).alias("u_rules"))
    # anchors are frequent tokens, so the support bounds them by tokens of a page / min_support; beyond MOST_RULES the index is joined by shuffle
    if listed.limit(MOST_RULES + 1).count() <= MOST_RULES:
        met = rows.select("*", F.explode_outer(asked).alias("u_anchor")).join(F.broadcast(index), "u_anchor", "left")
    else:
        met = spread_join(checkpointed(rows).select("*", F.explode_outer(asked).alias("u_anchor")), index, "u_anchor", "u_row", "left")
    met = met.select("*", F.explode_outer("u_rules").alias("u_found")).select("*", "u_found.*")
    fits = F.forall("u_rule", lambda item: F.arrays_overlap(item, F.col("u_tokens")))
    own = ["page_id", "host", "path", "rule", "u_verdict"]
    # the rows of a page lie together, so they shrink to one before they are shuffled
    found = met.groupBy("u_row").agg(*(F.first(c).alias(c) for c in own), F.max(F.when(fits, F.col("u_confidence"))).alias("mined_confidence"))
    mined = F.when(F.col("mined_confidence").isNotNull(), BLOCK).otherwise(ALLOW)
    return found.select("page_id", "host", "path", "rule", F.coalesce("u_verdict", mined).alias("verdict"), "mined_confidence")
