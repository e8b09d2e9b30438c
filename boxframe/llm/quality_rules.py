"""Quality rules with adaptive thresholds (native: DataFrame functions only).

Each document gets integer features. For every (lang, source) the distribution of each judged rate is
summarised by a mergeable quantile sketch: counts of logarithmic buckets with ``2**SUB_BITS`` linear
steps per power of two, so that a quantile is off by at most a factor ``2**-SUB_BITS``. The counts add up, in any
order, so partial sketches merge map-side, the same sketch rolls up to (lang) and to the whole corpus,
and reruns agree. A join filters by the fences read from the sketches, which replace fixed cutoffs.

Judged are symbols and characters per word, repeated lines per line, and words in repeated windows per word; the number of words
is the base rules' matter and sets the scale. A group's fences lie SPREAD times its spread outside its quartiles. The spread is
the distance of the quartiles, or what one event makes in the group's median document if that is more, as the rates of
most groups are zero throughout (of word lengths: 1/STEP of the median). No upper fence exceeds CAP times the language's, so that a junk source cannot
raise its own.

Defined results: null text has no words; null lang or source form groups of their own; a group with
fewer than ``min_group`` documents uses its language's fences, and a small language the corpus's;
repeated rows count as often as they occur; an empty table gives an empty result. Columns of the input
that clash with a result's name are replaced by the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CHARS, broadcast_if_small, space_words, stored

WINDOW = 8
SYMBOLS = "#*$%&|<>"
SUB_BITS = 7
#: Judged rates, per mille: what is counted, in what, and how much of it one event makes (0: the rate is no rate of events).
JUDGED = {"__bf_symbol_rate": ("n_symbols", "n_words", 1), "__bf_word_len": ("word_chars", "n_words", 0), "__bf_dup_rate": ("n_dup_lines", "__bf_n_lines", 1), "__bf_repeat_rate": ("n_repeat_words", "n_words", 2 * WINDOW)}
SIZES = ("n_words", "__bf_n_lines")
#: A fence lies this many spreads outside the quartile, and the upper one at most this many times as high as the language's.
SPREAD, CAP = 5, 3
#: The least spread of a rate that is no rate of events is this part of its median.
STEP = 32
MIN_GROUP = 50
MAX_BROADCAST_GROUPS = 100_000
FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _covered(starts: Column) -> Column:
    """Number of positions covered by windows at the sorted starts."""
    return F.aggregate(
        starts,
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a.n + F.least(F.lit(WINDOW), s - a.last)).alias("n"), s.alias("last")),
        lambda a: a.n,
    )


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and __bf_n_lines, the lines with a word (all long)."""
    t = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("__bf_w", F.transform(space_words(F.col(text)), lambda w: F.xxhash64(w)))
    n = F.size("__bf_w")
    window = lambda i: F.xxhash64(*[F.get("__bf_w", i + k) for k in range(WINDOW)])
    out = out.withColumn("__bf_h", F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), window)))
    # Only a text that repeats a window is sorted: equal windows then stand side by side.
    out = out.withColumn("__bf_s", F.when(F.size("__bf_h") > F.size(F.array_distinct("__bf_h")), F.array_sort(F.transform("__bf_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    twin = lambda x, i: (x.h == F.get("__bf_s", i - 1).h) | (x.h == F.get("__bf_s", i + 1).h)
    starts = F.array_sort(F.transform(F.filter("__bf_s", lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x.i))
    lines = F.filter(F.split(t, "\n"), lambda x: F.translate(x, SPACE_CHARS, "") != "")
    bare = reduce(lambda c, s: F.replace(c, F.lit(s), F.lit("")), SYMBOLS, t)
    return out.withColumn("__bf_lines", lines).withColumns(
        {
            "n_words": n.cast("long"),
            "word_chars": F.length(F.translate(t, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.octet_length(t) - F.octet_length(bare)).cast("long"),
            "n_dup_lines": (F.size("__bf_lines") - F.size(F.array_distinct("__bf_lines"))).cast("long"),
            "n_repeat_words": F.coalesce(_covered(starts), F.lit(0)).cast("long"),
            "__bf_n_lines": F.size("__bf_lines").cast("long"),
        }
    ).drop("__bf_w", "__bf_h", "__bf_s", "__bf_lines")


def _rates(df: DataFrame) -> DataFrame:
    return df.withColumns({k: F.expr(f"{count} * 1000 div greatest({size}, 1)") for k, (count, size, _) in JUDGED.items()})


def bucket(v: Column) -> Column:
    """The lowest value of v's bucket: v itself below 2**(SUB_BITS+1), then 2**SUB_BITS steps per power of two."""
    shift = F.greatest(F.length(F.bin(v)) - (SUB_BITS + 1), F.lit(0))
    unit = F.pow(F.lit(2), shift).cast("long")
    return (F.floor(v / unit) * unit).cast("long")


def sketches(rates: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket) -> n: the mergeable sketches, for documents that pass the base rules.

    Failed documents count 0 instead of being filtered first: Catalyst would push that filter below the
    features' projections and compute every array anew inside the lambdas that read it.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), bucket(F.col(k)).alias("b")) for k in (*JUDGED, *SIZES)]))
    return (
        rates.select("lang", "source", "base_failed", pairs.alias("x"))
        .groupBy("lang", "source", F.col("x.f").alias("feature"), F.col("x.b").alias("bucket"))
        .agg(F.sum(F.when(F.col("base_failed"), 0).otherwise(1)).alias("n")).where("n > 0")
    )


def fences(sketch: DataFrame, level: list[str]) -> DataFrame:
    """Merges the sketches up to a level and reads each rate's fences from them: one row per group."""
    merged = sketch.groupBy(*level, "feature", "bucket").agg(F.sum("n").alias("n"))
    # A sketch has a few thousand buckets at most, so one group's buckets fit any task.
    per = merged.groupBy(*level, "feature").agg(F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("s"), F.sum("n").alias("total"))

    def quantile(q: float) -> Column:
        return F.aggregate(
            "s",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
            lambda a, x: F.struct((a.seen + x.n).alias("seen"), F.when(a.at.isNull() & ((a.seen + x.n) >= F.col("total") * q), x.bucket).otherwise(a.at).alias("at")),
            lambda a: a.at,
        )

    per = per.select(*level, "feature", "total", F.struct(quantile(0.25).alias("q1"), quantile(0.5).alias("q2"), quantile(0.75).alias("q3")).alias("q"))
    out = per.groupBy(*level).agg(F.max("total").alias("docs"), *[F.max(F.when(F.col("feature") == k, F.col("q"))).alias(k) for k in (*JUDGED, *SIZES)])
    for k, (_, size, event) in JUDGED.items():
        unit = F.expr(f"{event} * 1000 div greatest(`{size}`.q2, 1)" if event else f"`{k}`.q2 div {STEP}")
        reach = SPREAD * F.greatest(F.col(f"{k}.q3") - F.col(f"{k}.q1"), unit)
        out = out.withColumns({f"{k}_hi": F.col(f"{k}.q3") + reach, f"{k}_lo": F.col(f"{k}.q1") - reach})
    return out.drop(*JUDGED, *SIZES)


def thresholds(rates: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """One row per (lang, source) with the fences of each judged rate."""
    sketch = stored(sketches(rates), "sketches")
    tops = [f"{k}_{end}" for k in JUDGED for end in ("hi", "lo")]
    lang = fences(sketch, ["lang"]).select(F.col("lang").alias("__bf_lang"), F.col("docs").alias("__bf_ldocs"), *[F.col(c).alias(f"{c}_l") for c in tops])
    whole = fences(sketch.withColumn("__bf_all", F.lit(1)), ["__bf_all"]).first()  # one row of numbers
    out = fences(sketch, ["lang", "source"]).join(lang, F.col("lang").eqNullSafe(F.col("__bf_lang")), "left")

    def pick(c: str) -> Column:
        wide = F.when(F.col("__bf_ldocs") >= min_group, F.col(f"{c}_l")).otherwise(F.lit(whole[c] if whole else None).cast("long"))
        own = F.least(F.col(c), CAP * wide) if c.endswith("_hi") else F.col(c)
        return F.when(F.col("docs") >= min_group, own).otherwise(wide)

    return stored(out.select(F.col("lang").alias("__bf_tlang"), F.col("source").alias("__bf_tsource"), *[pick(c).alias(c) for c in tops]), "thresholds")


def judge(docs: DataFrame, text: str = "text", min_group: int = MIN_GROUP, carry_text: bool = True) -> DataFrame:
    """docs with the features, base_failed and kept: false if the base rules or a fence of the group rule it out.

    The features are computed once and stored, with the text only if it is to be returned.
    """
    base = (F.col("n_words") < 20) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 30)
    rates = _rates(features(docs.drop("base_failed", "kept"), text).withColumn("base_failed", base))
    rates = stored(rates if carry_text else rates.drop(text), "features")
    limits = thresholds(rates, min_group)
    limits = broadcast_if_small(limits, MAX_BROADCAST_GROUPS)
    out = rates.join(limits, F.col("lang").eqNullSafe(F.col("__bf_tlang")) & F.col("source").eqNullSafe(F.col("__bf_tsource")), "left")
    # A sum and not a conjunction, of which Catalyst would push a part below the features' projections.
    faults = reduce(lambda a, b: a + b, [F.coalesce(((F.col(k) > F.col(f"{k}_hi")) | (F.col(k) < F.col(f"{k}_lo"))).cast("int"), F.lit(0)) for k in JUDGED])
    out = out.withColumn("kept", F.col("base_failed").cast("int") + faults == 0)
    return out.drop("__bf_tlang", "__bf_tsource", "__bf_n_lines", *JUDGED, *[f"{k}_{end}" for k in JUDGED for end in ("hi", "lo")])
