"""Spelling variant grouping by a rare-first prefix filter on positional bigrams.

Words are runs of letters of whole texts; of one occurrence in MUTATED, picked by a checksum, a letter is dropped first (the
contract's own misspellings). Counting combines on the map side, so a frequent word costs each task a row. Words of at least MIN_LENGTH
letters and MIN_COUNT occurrences are the vocabulary.

Two words are near if one letter is inserted, deleted or replaced. One edit changes at most two of a word's bigrams, so of its
three rarest at least one stands in the other word too, and the first such one, by frequency, then bigram, then position, is among
the other's three rarest; its positions differ by at most one. Frequency is that of the bigram at any position, since an
insertion moves the rest of a word and an order by moved bigrams would not agree between two near words.

The edit lies wholly on one side of that bigram, so the other side is equal, and of the side with the edit one half is equal.
The join's key holds the bigram with its distance from the equal side's end, the length of the longer word, that side and that half; so a
frequent bigram is no hot key, and words meet only if at most half of one side differs. What meets is verified.

A word's form is its near word of most occurrences, if at least FACTOR times its own; roots follow forms by
pointer doubling. Occurrences at least double along each step, so chains are short and have no circles.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count again; ties
go to the smaller word by code points; an empty table gives an empty result. Input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, discard, stored

MIN_LENGTH, MIN_COUNT, FACTOR = 5, 3, 2
#: A letter is dropped from an occurrence whose checksum this divides.
MUTATED = 97
#: Rarest bigrams that are joined: two that one edit can change, and one more.
RAREST = 3
LETTERS = r"[a-zÀ-ÿ]"


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, mutated: int = MUTATED) -> DataFrame:
    """word, n: words of min_length letters that occur min_count times over all texts. mutated 0 drops no letters."""
    # A run below min_length cannot become a word: the pattern takes maximal runs of that length only.
    runs = F.regexp_extract_all(ascii_lower(F.coalesce("text", F.lit(""))), F.lit(f"{LETTERS}{{{min_length},}}"), F.lit(0))
    rows = docs.select("doc_id", F.explode(runs).alias("r"))
    if mutated:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("r")).cast("binary"))
        rows = rows.withColumn("h", h)
        at = F.pmod("h", F.char_length("r")).cast("int")
        cut = F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + 2, F.char_length("r")))
        rows = rows.select(F.when(F.col("h") % mutated == 0, cut).otherwise(F.col("r")).alias("r"))
    return rows.where(F.char_length("r") >= min_length).groupBy(F.col("r").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def rarest(words: DataFrame) -> DataFrame:
    """word, n, len and rare: the positions (from 0) of the RAREST bigrams of each word (a stored table)."""
    at = F.transform(F.sequence(F.lit(0), F.char_length("word") - 2), lambda i: F.struct(i.cast("int").alias("at"), F.substring("word", i + 1, F.lit(2)).alias("gram")))
    grams = words.select("word", "n", F.inline(at))
    # 90 letters make at most 8,100 bigrams, whatever the corpus: a proven bound for this broadcast.
    often = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("often")))
    first = F.array_sort(F.collect_list(F.struct("often", "gram", "at")))
    found = grams.join(often, "gram").groupBy("word", "n").agg(F.slice(first, 1, RAREST).alias("rare"))
    return found.select("word", "n", F.char_length("word").alias("len"), F.transform("rare", lambda r: r["at"]).alias("rare"))


def _keys(i: Column) -> Column:
    """The join keys of a word with a rare bigram at i, for pairs whose longer word has len or len + 1 letters.

    An edit right of the bigram keeps what is left of it, and, of the c - i - 2 letters right of it, the first half or
    the rest; likewise to the left, seen from the end. A half without letters has no edit.
    """
    w, n = F.col("word"), F.col("len")
    out = []
    for longer in (n, n + 1):
        room = longer - i - 2
        half = F.floor(room / 2).cast("int")
        out.append(F.when(room > 0, F.struct(longer.alias("c"), F.xxhash64(F.lit(1), longer, i, F.substring(w, F.lit(1), i + 2 + half)).alias("key"))))
        out.append(F.when(half > 0, F.struct(longer.alias("c"), F.xxhash64(F.lit(2), longer, i, F.substring(w, F.lit(1), i + 2), F.substring(w, n - room + half + 1, n)).alias("key"))))
        room = longer - n + i
        half = F.floor(room / 2).cast("int")
        out.append(F.when(room > 0, F.struct(longer.alias("c"), F.xxhash64(F.lit(3), longer, n - i, F.substring(w, F.lit(1), half), F.substring(w, i + 1, n)).alias("key"))))
        out.append(F.when(half > 0, F.struct(longer.alias("c"), F.xxhash64(F.lit(4), longer, n - i, F.substring(w, i - room + half + 1, n)).alias("key"))))
    return F.array(*out)


def near(words: DataFrame) -> DataFrame:
    """a, b, n_a, n_b: all pairs a < b of words (a stored table of word, n) that one edit turns into each other."""
    keys = F.array_distinct(F.flatten(F.transform("rare", _keys)))
    rows = stored(rarest(words).select("word", "n", "len", F.inline(F.filter(keys, lambda k: k.isNotNull()))), "bigram_keys")
    a, b = (rows.select("key", "c", *[F.col(x).alias(f"{x}_{s}") for x in ("word", "n", "len")]) for s in "ab")
    pairs = a.join(b, ["key", "c"]).where("word_a < word_b and greatest(len_a, len_b) = c and levenshtein(word_a, word_b, 1) = 1")
    return pairs.select(F.col("word_a").alias("a"), F.col("word_b").alias("b"), "n_a", "n_b").distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """word, root of word, form: each word's last form, with the pointers doubled in each round."""
    at = stored(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        on = at.select(F.col("word").alias("via"), F.col("root").alias("further"))
        after = stored(at.join(on, F.col("root") == F.col("via"), "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "forms")
        done = after.where("moved").isEmpty()
        discard(at)
        at = after.drop("moved")
        if done:
            return at


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n of each of words (a stored table of word, n)."""
    pairs = near(words)
    each = pairs.select(F.inline(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")))))
    best = each.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), "other")).alias("best"))
    rows = words.join(best, "word", "left")
    enough = -F.col("best.less") >= factor * F.col("n")
    rows = rows.select("word", F.when(enough, F.col("best.other")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "near_words")
    roots = _roots(rows.where("form is not null"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def group(docs: DataFrame) -> DataFrame:
    """The vocabulary of docs (doc_id, text) with its near words, forms and roots."""
    return variants(stored(vocabulary(docs.select("doc_id", "text")), "vocabulary"))
