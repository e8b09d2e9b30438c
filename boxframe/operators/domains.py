"""Domain membership: which vocabularies a text's tokens belong to, by equi joins on tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import fnv1a
from . import bitmaps


def normalised(c: Column) -> Column:
    """Lower case, white space collapsed and trimmed: the normal form of members and tokens."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def token_hash(c: Column) -> Column:
    return fnv1a(normalised(c))


def tokens(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Distinct lower-cased tokens of each key."""
    parts = F.array_distinct(F.filter(F.split(F.lower(text), r"\s+"), lambda t: t != ""))
    return df.select(*key, F.size(parts).alias("n_tokens"), F.explode(parts).alias("token"))


def members(domains: DataFrame) -> DataFrame:
    """(domain, token) of a (domain, member) table; members of several words count by each."""
    return domains.select("domain", F.explode(F.split(normalised(F.col("member")), " ")).alias("token")).where("token != ''").distinct()


def scores(df: DataFrame, key: list[str], domains: DataFrame, text: str = "text") -> DataFrame:
    """Share of a text's distinct tokens that each domain has, above 0."""
    hit = tokens(df, key, text).join(members(domains), "token")
    return hit.groupBy(*key, "domain").agg(F.round(F.count("*") / F.max("n_tokens"), 3).alias("score"))


def best(scored: DataFrame, key: list[str]) -> DataFrame:
    """The domain of the highest score; of equals the first by name."""
    b = scored.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "domain")).alias("b"))
    return b.select(*key, F.col("b.domain").alias("domain"), (-F.col("b.s")).alias("score"))


def contained(scored: DataFrame, key: list[str]) -> DataFrame:
    """Only domains that have all tokens."""
    return best(scored.where("score = 1"), key)


def cell_probe(cells: DataFrame, key: list[str], domains: DataFrame) -> DataFrame:
    """Cells whose whole normalised text is a member, by hash first and text to exclude collisions."""
    m = domains.select("domain", normalised(F.col("member")).alias("__m"), token_hash(F.col("member")).alias("h")).distinct()
    c = cells.withColumns({"h": token_hash(F.col("text")), "__t": normalised(F.col("text"))})
    return c.join(m, "h").where("__t = __m").select(*key, "domain")


def narrow_hash(c: Column, bits: int) -> Column:
    """The hash of a normalised text in a universe of 2 ** bits."""
    return F.pmod(token_hash(c), F.lit(1 << bits))


def screened_probe(cells: DataFrame, key: list[str], domains: DataFrame, bits: int = 20) -> DataFrame:
    """cell_probe behind a screen: one bitmap of the members of all domains, 2 ** bits bits, goes to every task and lets few other cells pass.

    The bitmap has 2 ** bits / 8 bytes whatever there is in the domains: a proven bound for its broadcast.
    """
    members = domains.select(narrow_hash(F.col("member"), bits).alias("v"))
    screen = bitmaps.build(members, [], "v").select("bucket", F.col("bits").alias("__bits"))
    h = narrow_hash(F.col("text"), bits)
    passed = cells.withColumns({"__h": h, "bucket": F.bitmap_bucket_number(h + 1)}).join(F.broadcast(screen), "bucket").where(bitmaps.contains(F.col("__bits"), F.col("__h")))
    return cell_probe(passed, key, domains)


def false_positives(texts: DataFrame, domains: DataFrame, bits: list[int]) -> DataFrame:
    """bits, domain, members, set_bits, probes, predicted, measured: how many distinct texts (column text) that are not members would pass a filter of each width.

    predicted is probes * set_bits / 2 ** bits, the model's rate; measured counts the texts whose hash a member has.
    """
    m = domains.select("domain", normalised(F.col("member")).alias("m")).distinct()
    t = texts.select(normalised(F.col("text")).alias("m")).where("m != ''").distinct()
    widths = F.explode(F.array(*[F.struct(F.lit(b).alias("bits"), F.pmod(fnv1a(F.col("m")), F.lit(1 << b)).alias("h")) for b in bits])).alias("w")
    hashed = m.select("domain", "m", widths).select("domain", "m", "w.*")
    sizes = hashed.groupBy("bits", "domain").agg(F.count_distinct("m").alias("members"), F.count_distinct("h").alias("set_bits"))
    hits = t.select("m", widths).select("m", "w.*").join(hashed.select("domain", "bits", "h").distinct(), ["bits", "h"])
    known = m.select("domain", "m", F.lit(True).alias("__known"))
    hits = hits.join(known, ["domain", "m"], "left").where("__known is null").groupBy("bits", "domain").agg(F.count("*").alias("measured"))
    inside = t.join(m, "m").groupBy("domain").agg(F.count("*").alias("inside"))
    total = t.agg(F.count("*").alias("total"))
    rows = sizes.join(inside, "domain", "left").join(hits, ["bits", "domain"], "left").join(F.broadcast(total))  # one row
    probes = F.col("total") - F.coalesce("inside", F.lit(0))
    return rows.select("bits", "domain", "members", "set_bits", probes.alias("probes"), F.round(probes * F.col("set_bits") / F.pow(F.lit(2.0), F.col("bits")), 4).alias("predicted"), F.coalesce("measured", F.lit(0)).cast("long").alias("measured"))


def present_domains(cells: DataFrame, domains: DataFrame) -> DataFrame:
    """Documents and the domains of which they have any token: the screen before cell-wise probes."""
    return tokens(cells, ["doc_id"]).select("doc_id", "token").distinct().join(members(domains), "token").select("doc_id", "domain").distinct()


def unknown_tokens(df: DataFrame, key: list[str], domains: DataFrame, text: str = "text") -> DataFrame:
    """Distinct tokens of each key that no vocabulary has."""
    return tokens(df, key, text).select(*key, "token").join(members(domains).select("token"), "token", "left_anti").select(*key, "token")


def column_domains(cells: DataFrame, columns: list[str], domains: DataFrame, least: int = 2) -> DataFrame:
    """Per column the share of its cells in a domain, from ``least`` hits on."""
    total = cells.groupBy(*columns).agg(F.count("*").alias("n"))
    hit = cell_probe(cells.withColumn("__id", F.monotonically_increasing_id()), [*columns, "__id"], domains).groupBy(*columns, "domain").agg(F.count_distinct("__id").alias("hits"))
    return hit.where(F.col("hits") >= least).join(total, columns).select(*columns, "domain", "hits", F.round(F.col("hits") / F.col("n"), 3).alias("fraction"))


def coverage(cells: DataFrame, domains: DataFrame) -> DataFrame:
    """Per domain: the share of its members seen (coverage) and of probed cells that hit it (purity)."""
    m = domains.select("domain", normalised(F.col("member")).alias("m")).distinct()
    c = cells.select(normalised(F.col("text")).alias("m"))
    seen = c.groupBy("m").agg(F.count("*").alias("k"))
    total = c.agg(F.count("*").alias("total"))
    per = m.join(seen, "m", "left").groupBy("domain").agg(F.count("*").alias("members"), F.count("k").alias("seen"), F.sum("k").alias("hits"))
    return per.join(F.broadcast(total)).select("domain", "members", F.round(F.col("seen") / F.col("members"), 3).alias("coverage"), F.round(F.coalesce(F.col("hits"), F.lit(0)) / F.col("total"), 6).alias("purity"))


def without_stop_words(tok: DataFrame, stop: list[str]) -> DataFrame:
    """Tokens stripped of punctuation at both ends, without stop words and empty rests."""
    t = tok.withColumn("token", F.regexp_replace("token", r"^\p{Punct}+|\p{Punct}+$", ""))
    return t.where((F.col("token") != "") & ~F.col("token").isin(*stop))


def suffix_variants(tok: DataFrame, suffixes: list[str]) -> DataFrame:
    """Each token and the token without each suffix that it has and that leaves three letters."""
    cut = [F.when(F.col("token").endswith(s) & (F.length("token") >= len(s) + 3), F.expr(f"substring(token, 1, length(token) - {len(s)})")) for s in suffixes]
    every = F.array_distinct(F.filter(F.array(F.col("token"), *cut), lambda t: t.isNotNull()))
    return tok.withColumn("variant", F.explode(every))
