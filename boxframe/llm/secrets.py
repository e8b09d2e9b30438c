"""Secret scans over an incremental blob ledger (native: DataFrame functions only).

A text is a blob, addressed by the SHA-256 of its bytes. The ledger holds, for each blob and rule version that
was scanned, the spans found (also none). A scan takes every version of every path, reduces them to
distinct blobs, scans the pairs of blob and rule version that the ledger lacks, and joins the ledger's
spans back to all paths.

Positions come from the regex engine without Python: the pieces between matches and the
matches have lengths, whose running sums are the offsets.

Defined results: a null text is the empty blob; repeated rows and copies are scanned once and all get the
blob's findings; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Rule:
    """A pattern; of its leftmost non-overlapping matches those whose group has at least ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


RULES = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    # Maximal runs: shorter ones are never matches of [0-9a-f]+ that pass, so the engine may skip them.
    Rule("hex", 1, r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
LEDGER = "blob string, kind string, version int, spans array<struct<s:int,r:int,e:int,kind:string>>"
SPAN = "array<struct<s:int,r:int,e:int,kind:string>>"


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """All matches of a rule that pass as (s, r, e, kind), in code points, end exclusive."""
    pattern = F.lit(rule.pattern)
    whole, tested = F.regexp_extract_all(text, pattern, 0), F.regexp_extract_all(text, pattern, rule.group)
    gaps = F.split(text, rule.pattern, -1)
    steps = F.zip_with(F.transform(whole, F.length), F.transform(tested, F.length), lambda n, m: F.struct(n.alias("n"), m.alias("m")))
    steps = F.zip_with(steps, F.transform(F.slice(gaps, 1, F.size(whole)), F.length), lambda x, g: F.struct(x.n.alias("n"), x.m.alias("m"), g.alias("g")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a: Column, x: Column) -> Column:
        s = a.at + x.g
        span = F.struct(s.alias("s"), F.lit(rank).alias("r"), (s + x.n).alias("e"), F.lit(rule.kind).alias("kind"))
        return F.struct((s + x.n).alias("at"), F.when(x.m >= rule.least, F.concat(a.out, F.array(span))).otherwise(a.out).alias("out"))

    # The first test spares texts without a match the three passes that find positions.
    return F.when(F.regexp_like(text, pattern), F.aggregate(steps, start, step, lambda a: a.out)).otherwise(F.array().cast(SPAN))


def unseen(versions: DataFrame, ledger: DataFrame | None, rules=RULES) -> DataFrame:
    """blob, text and kinds: the distinct blobs with the kinds of the rule versions that the ledger lacks for them."""
    blobs = versions.select(blob_id(F.col("text")).alias("blob"), F.coalesce("text", F.lit("")).alias("text")).dropDuplicates(["blob"])
    every = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    if ledger is None:
        return blobs.withColumn("todo", every)
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws("@", "kind", "version")).alias("seen"))
    todo = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(every, F.coalesce("seen", F.array().cast("array<string>"))))
    return todo.drop("seen").where(F.size("todo") > 0)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """New ledger rows: blob, kind, version, spans."""
    each = [
        F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), F.when(F.array_contains("todo", f"{r.kind}@{r.version}"), _spans(F.col("text"), r, i)).alias("spans"))
        for i, r in enumerate(rules)
    ]
    return blobs.select("blob", F.inline(F.array(*each))).where(F.col("spans").isNotNull())


def update(versions: DataFrame, ledger: DataFrame | None = None, rules=RULES) -> DataFrame:
    """The ledger after scanning what it lacks of these versions; to be stored by the caller."""
    new = scan(unseen(versions, ledger, rules), rules)
    return new if ledger is None else ledger.unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, rules=RULES) -> DataFrame:
    """versions (without text) with blob and spans: all spans of the given rules, by start, then rule order."""
    current = F.array(*[F.lit(f"{r.kind}@{r.version}") for r in rules])
    known = ledger.where(F.array_contains(current, F.concat_ws("@", "kind", "version")) & (F.size("spans") > 0))
    known = known.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    rows = versions.withColumn("blob", blob_id(F.col("text"))).drop("text", "spans")
    # Blobs without a finding are not in the right side: their rows meet nothing and keep no spans.
    return rows.join(known, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def digest(found: DataFrame) -> DataFrame:
    """doc_id with the counts, the span list and its SHA-256."""
    count = lambda k: F.size(F.filter("spans", lambda s: s.kind == k)).cast("long")
    text = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.kind, s.s.cast("string"), s.e.cast("string"))), ",")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(text.cast("binary"), 256).alias("base_sha256"), text.alias("spans"))


def scan_with_ledger(docs: DataFrame, path: str) -> DataFrame:
    """One digest row per document; the ledger at path is read, if there is one, and what it lacked is appended to it.

    One writer at a time. A run that is lost before its rows are committed leaves the ledger as it was.
    """
    spark, versions = docs.sparkSession, docs.select("doc_id", "text")
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    known = spark.read.schema(LEDGER).parquet(path) if there else None
    scan(unseen(versions, known)).write.mode("append").parquet(path)
    return digest(findings(versions, spark.read.schema(LEDGER).parquet(path)))


def scan_documents(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """One digest row per document, after bringing the ledger up to date."""
    versions = docs.select("doc_id", "text")
    return digest(findings(versions, stored(update(versions, ledger), "ledger")))
