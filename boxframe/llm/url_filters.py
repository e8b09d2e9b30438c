"""Association-rule URL filters (native: DataFrame functions and Spark's FP-growth).

Curated rules judge the urls that they fit, which labels these. All urls are transactions of tokens, with their label if they have one; FP-growth
mines token combinations, and those that imply a label become rules for the urls without one, matched through an
inverted index from each rule's rarest token. A rule's support is the number of urls of its label; its confidence is their share in all
urls that have its tokens, labelled or not, so what holds for a label by its host alone holds little; its lift is that
share against the label's share in all urls. A rule is pruned if one token less is as confident.

Combinations double with each token of a url, so FP-growth sees of each url the TELLING tokens with the largest lift, of those that are
frequent: it finds at most 2 ** (TELLING + 1) * urls / least combinations, whatever the urls. Single tokens are all
counted, and every candidate is counted anew over the whole urls before it is judged.

The combinations of other tokens follow level by level, over all frequent tokens: exactly those that can still change a verdict. An
unlabelled url with a combination bounds its confidence, for all urls without the label that have every token of that url count
against any combination of its tokens; where this bound does not reach the url's best rule so far, nothing that contains the
combination can. A token that goes without saying (no url less) is not added. No combination is dropped otherwise, so
urls built against the bounds can still make their number double with each token.

Defined results: a null url or one without ``://`` has an empty host and path, no tokens, and is allowed;
repeated rows get equal verdicts; with no labelled url nothing is mined and all other urls are
allowed. Input columns that clash with a result's name are replaced.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, stored

#: (verdict, host, path) of the curated rules.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Of the labelled urls; few urls support nothing, whatever their share.
MIN_SUPPORT, MIN_COUNT, MIN_CONFIDENCE, MIN_LIFT = 0.005, 20, 0.9, 1.2
#: Tokens of a url that FP-growth combines; the other combinations are searched by bounds.
TELLING = 8
MAX_BROADCAST_RULES = 100_000
LABEL = "label="


def parsed(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host (A-Z lower-cased) and path; both '' for null or without ://."""
    pick = lambda g: F.coalesce(F.regexp_extract(F.col(url), r"://([^/?#]*)([^?#]*)", g), F.lit(""))
    return pages.withColumns({"host": ascii_lower(pick(1)), "path": pick(2)})


def curated(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and __bf_rule_verdict: of the longest rule that fits, else null."""
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(host: str, path: str) -> Column:
        return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)

    first = lambda value: reduce(lambda c, r: c.when(fits(r[1], r[2]), F.lit(value(r))), order, F.when(F.lit(False), F.lit("")))
    return df.withColumns({"rule": first(lambda r: r[1] + r[2]), "__bf_rule_verdict": first(lambda r: r[0])})


def tokens() -> Column:
    """Distinct tokens of a url: its host's labels with their depth from the right, and its path's words and numbers."""
    labels = F.reverse(F.filter(F.split("host", r"\."), lambda x: x != ""))
    host = F.transform(labels, lambda x, i: F.concat(F.lit("host"), i.cast("string"), F.lit("="), x))
    path = F.transform(F.filter(F.split("path", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), lambda x: x != ""), lambda x: F.concat(F.lit("path="), x))
    return F.array_distinct(F.concat(host, path))


def counted(urls: DataFrame, candidates: DataFrame) -> DataFrame:
    """items, n, block, allow of candidate token combinations: how many urls have all tokens, and how many of them have each label.

    The index holds each combination under its token of fewest urls; a url probes it once a token, and a probe is verified.
    """
    hits = probed(urls, candidates.select("items").distinct())
    return hits.groupBy("items").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow"))


def probed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Each url with each rule (a row with items) of which it has all tokens."""
    spread = rules.select(F.explode("items").alias("token")).groupBy("token").agg(F.count("*").alias("__bf_n"))
    keyed = rules.select("*", F.explode("items").alias("token")).join(spread, "token")
    index = keyed.groupBy(*rules.columns).agg(F.min(F.struct("__bf_n", "token")).token.alias("token"))
    index = broadcast_if_small(stored(index, "url_index"), MAX_BROADCAST_RULES)
    return urls.select("*", F.explode("tokens").alias("token")).join(index, "token").where(F.size(F.array_except("items", "tokens")) == 0).drop("token")


def mine(urls: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT, min_lift: float = MIN_LIFT, telling: int = TELLING) -> DataFrame:
    """items, label, confidence, support of the rules; urls (a stored table) has host, path, tokens and verdict, null if unlabelled."""
    total, blocked, allowed = urls.agg(F.count("*"), F.count_if(F.col("verdict") == "block"), F.count_if(F.col("verdict") == "allow")).first()
    least = max(min_count, math.ceil(min_support * (blocked + allowed)))
    share = {"block": max(blocked, 1) / max(total, 1), "allow": max(allowed, 1) / max(total, 1)}
    each = urls.select("verdict", F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n"), F.count_if(F.col("verdict") == "block").alias("block"), F.count_if(F.col("verdict") == "allow").alias("allow"))
    lift = F.greatest(*[F.col(k) / F.col("n") / v for k, v in share.items()])
    # A token of a rule has at least as many urls of the label as the rule.
    frequent = stored(each.where((F.col("block") >= least) | (F.col("allow") >= least)).select("*", lift.alias("lift")), "url_tokens")
    own = urls.select("host", "path", "verdict", F.explode("tokens").alias("token")).join(broadcast_if_small(frequent.select("token", "lift"), MAX_BROADCAST_RULES), "token")
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("lift")).alias("less"), "token"))), 1, telling)
    rows = own.groupBy("host", "path", "verdict").agg(F.transform(best, lambda t: t.token).alias("items"))
    rows = rows.select(F.concat("items", F.when(F.col("verdict").isNotNull(), F.array(F.concat(F.lit(LABEL), F.col("verdict")))).otherwise(F.array().cast("array<string>"))).alias("items"))
    sets = FPGrowth(itemsCol="items", minSupport=min(1.0, least / max(total, 1))).fit(rows).freqItemsets
    sets = stored(sets.select(F.array_sort(F.filter("items", lambda x: ~x.startswith(LABEL))).alias("items"), F.substring(F.try_element_at(F.filter("items", lambda x: x.startswith(LABEL)), F.lit(1)), len(LABEL) + 1, 100).alias("label"), "freq"), "url_sets")
    whole = sets.where("label is null").select("items", F.col("freq").alias("n"))
    found = sets.where("label is not null and size(items) > 0").join(whole, "items").withColumn("confidence", F.col("freq") / F.col("n")).where(F.col("confidence") >= min_confidence)
    found = found.select("items", "label", "confidence")
    shorter = found.where("size(items) > 1").select("items", "label", "confidence", F.explode(F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: F.filter("items", lambda x, i: i != k))).alias("less"))
    as_good = shorter.join(found.select(F.col("items").alias("less"), "label", F.col("confidence").alias("known")), ["less", "label"]).where("known >= confidence").select("items", "label").distinct()
    candidates = found.join(as_good, ["items", "label"], "left_anti").select("items").unionByName(frequent.select(F.array("token").alias("items")))
    exact = counted(urls, stored(candidates.distinct(), "url_candidates"))
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("support"), F.lit(v).alias("base")) for k, v in share.items()])).alias("x")
    rules = exact.select("items", "n", label).select("items", "x.label", "x.support", (F.col("x.support") / F.col("n")).alias("confidence"), "x.base")
    rules = rules.where((F.col("support") >= least) & (F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * F.col("base")))
    rules = stored(rules.select("items", "label", "confidence", "support"), "url_rules")
    needed = {k: max(min_confidence, min_lift * v) for k, v in share.items()}
    return stored(reduce(DataFrame.unionByName, further(urls, frequent, rules, least, needed), rules).distinct(), "url_rules")


def further(urls: DataFrame, frequent: DataFrame, rules: DataFrame, least: int, needed: dict[str, float]) -> list[DataFrame]:
    """A table for each level of what rules lacks: all combinations of frequent tokens that can be the best rule of an unlabelled url."""
    marks = broadcast_if_small(frequent.select("token", F.col("n").alias("of"), *[(F.col(k) >= least).alias(k) for k in needed]), MAX_BROADCAST_RULES)
    # Rarest first: what a token implies comes after it. Urls of equal frequent tokens are one row.
    own = urls.select("host", "path", "verdict", F.explode("tokens").alias("token")).join(marks, "token")
    own = own.groupBy("host", "path", "verdict").agg(F.array_sort(F.collect_list(F.struct("of", "token", *needed))).alias("t"))
    has = lambda k: lambda x: x[k]
    sets = {"tokens": F.col("t.token")} | {k: F.transform(F.filter("t", has(k)), has("token")) for k in needed}
    rows = stored(own.select("verdict", *[c.alias(k) for k, c in sets.items()]).groupBy("verdict", *sets).agg(F.count("*").alias("w")), "url_sets")
    best = probed(rows.where("verdict is null").select("tokens"), rules.select("items", "confidence")).groupBy("tokens").agg(F.max("confidence").alias("best"))
    label = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("items"), F.lit(v).alias("least")) for k, v in needed.items()])).alias("x")
    asks = rows.where("verdict is null").join(best, "tokens", "left").select("best", label).select("x.label", "x.items", F.greatest("best", "x.least").alias("bar"))
    asks = stored(asks.where("size(items) > 1").groupBy("label", "items").agg(F.min("bar").alias("bar")).where("bar < 1"), "url_asks")
    against = probed(rows, asks).where(~F.col("verdict").eqNullSafe(F.col("label"))).groupBy("label", "items", "bar").agg(F.sum("w").alias("against"))
    need = F.greatest(F.lit(least), F.col("bar") / (1 - F.col("bar")) * F.col("against") - 1e-6)
    asks = stored(against.select(F.col("label").alias("of_label"), F.col("items").alias("tokens"), need.alias("need")), "url_needs")

    def hopeful(sets: DataFrame) -> DataFrame:
        return probed(asks, sets).where((F.col("of_label") == F.col("label")) & (F.col("need") <= F.col("s"))).select(*sets.columns).distinct()

    one = F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("s")) for k in needed])).alias("x")
    level = frequent.select(F.array("token").alias("items"), "n", one).select("x.label", "items", "x.s", "n").where(F.col("s") >= least)
    level, out = stored(hopeful(level), "url_level"), []
    while not level.isEmpty():
        met = probed(rows, level.select("label", "items", F.col("n").alias("before")))
        mine = reduce(lambda c, k: c.when(F.col("label") == k, F.col(k)), needed, F.when(F.lit(False), F.col("tokens")))
        met = met.withColumn("mine", mine).withColumn("token", F.explode(F.expr("slice(mine, cast(array_position(mine, element_at(items, -1)) as int) + 1, size(mine))")))
        hit = F.when(F.col("verdict") == F.col("label"), F.col("w")).otherwise(0)
        more = met.groupBy("label", "items", "before", "token").agg(F.sum(hit).alias("s"), F.sum("w").alias("n")).where((F.col("s") >= least) & (F.col("n") < F.col("before")))
        more = stored(more.select("label", F.concat("items", F.array("token")).alias("items"), "s", "n"), "url_grown")
        # All with a token less were on the level before, in more urls.
        less = F.explode(F.transform(F.sequence(F.lit(0), F.size("items") - 1), lambda k: F.filter("items", lambda x, i: i != k))).alias("less")
        known = level.select("label", F.col("items").alias("less"), F.col("n").alias("before"))
        whole = more.select("*", less).join(known, ["label", "less"]).where("before > n").groupBy(*more.columns).agg(F.count("*").alias("k"))
        level = stored(hopeful(stored(whole.where(F.col("k") == F.size("items")).drop("k"), "url_whole")), "url_level")
        enough = reduce(lambda c, k: c.when(F.col("label") == k, F.lit(needed[k])), needed, F.when(F.lit(False), F.lit(1.0)))
        out.append(level.select(F.array_sort("items").alias("items"), "label", (F.col("s") / F.col("n")).alias("confidence"), F.col("s").alias("support")).where(F.col("confidence") >= enough))
    return out


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Per host and path the label of the strongest rule of which the url has all tokens."""
    best = F.max(F.struct("confidence", "support", F.when(F.col("label") == "block", 1).otherwise(0).alias("b"), "label"))
    hits = probed(urls.select("host", "path", "tokens"), rules).groupBy("host", "path").agg(best.alias("best"))
    return hits.select(F.col("host").alias("__bf_host"), F.col("path").alias("__bf_path"), F.col("best.label").alias("__bf_mined"))


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_count: int = MIN_COUNT) -> DataFrame:
    """pages with host, path, rule and verdict: the curated rule's, else the mined one's, else allow."""
    rows = curated(parsed(pages), rules)
    # One row per host and path: copies of a url are judged once.
    urls = stored(rows.groupBy("host", "path").agg(F.first("__bf_rule_verdict").alias("verdict")).withColumn("tokens", tokens()), "urls")
    if urls.where(F.col("verdict").isNotNull()).isEmpty():
        return rows.withColumn("verdict", F.lit("allow")).drop("__bf_rule_verdict")
    mined = matched(urls.where(F.col("verdict").isNull()), mine(urls, min_support, min_confidence, min_count))
    out = rows.join(mined, (F.col("host") == F.col("__bf_host")) & (F.col("path") == F.col("__bf_path")), "left")
    return out.withColumn("verdict", F.coalesce("__bf_rule_verdict", "__bf_mined", F.lit("allow"))).drop("__bf_rule_verdict", "__bf_mined", "__bf_host", "__bf_path")
